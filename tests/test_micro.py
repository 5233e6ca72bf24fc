"""Hand-computed cases of the scalar expressions and of the folds."""

import json
import math

import pytest
from pyspark.sql import functions as F

from fathomline.config import EngineConfig, Evidence, Retrieval, Suppression
from fathomline.functions import exprs as E
from fathomline.operators import boxes as B
from fathomline.operators import labels as L
from fathomline.operators import scoring as S
from fathomline.operators import search as K
from fathomline.plans import evaluate as V
from fathomline.sources import bank as Bank
from fathomline.sources import references as R


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lit_box(x1, y1, x2, y2):
    return {k: F.lit(float(v)) for k, v in zip(("x1", "y1", "x2", "y2"), (x1, y1, x2, y2), strict=True)}


@pytest.mark.parametrize("a, b, want", [((0, 0, 10, 10), (5, 5, 15, 15), 25 / 175), ((0, 0, 10, 10), (10, 0, 20, 10), 0.0), ((0, 0, 10, 10), (0, 0, 10, 5), 0.5)])
def test_iou(spark, a, b, want):
    assert value(spark, E.iou(lit_box(*a), lit_box(*b))) == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("x, digits, want", [(-1e-9, 6, "-0.0"), (-0.0, 6, "-0.0"), (1e-9, 6, "0.0"), (0.2568505, 6, "0.25685"), (-0.1260885, 6, "-0.126088"), (2.5, 0, "3.0"), (-2.5, 0, "-3.0"), (1e300, 6, "1e+300"), (float("nan"), 6, "nan"), (None, 6, "None")])
def test_rounding_goes_by_the_binary_value(spark, x, digits, want):
    assert str(value(spark, E.rounded(F.lit(x).cast("double"), digits))) == want


def test_confidence(spark):
    of = lambda *v: value(spark, E.confidence(*[F.lit(float(x)) for x in v]))
    assert of(0.5, 0.1, 0.05, 0.8, 1) == pytest.approx(0.993934, abs=1e-6)
    assert of(0, 0, 0, 0, 0) == 0.5


def test_boxes(spark):
    assert tuple(value(spark, E.xywh_to_xyxy(*[F.lit(x) for x in (10, 20, 30, 40)]))) == (10, 20, 40, 60)
    assert tuple(value(spark, E.crop_bounds(lit_box(-3.7, 5.9, 700, 5.2), F.lit(640), F.lit(480)))) == (0, 5, 640, 6)


@pytest.mark.parametrize("x", [0.015, 0.025, 0.125, 0.375, 0.005, 1.005, 0.0, 1.0, 0.994999])
def test_caption_rounds_like_printf(spark, x):
    assert value(spark, E.overlay_label(F.lit(None), F.lit(x), F.lit(None))) == f"object: {x:.2f}"


def hits(spark, scores, label="a"):
    return spark.createDataFrame([(1, f"r{i}", label, float(s), i + 1) for i, s in enumerate(sorted(scores, reverse=True))], "k int, id string, label string, score double, rank int")


@pytest.mark.parametrize("method, scores, top_m, want", [("weighted_mean", (0.9, 0.8, 0.1), 5, 0.884112), ("weighted_mean", (0.1, 0.9, 0.8), 2, 0.884113), ("mean", (0.1, 0.9, 0.8), 2, 0.85), ("lse", (0.9, 0.8, 0.1), 5, 1.756187), ("max", (0.1, 0.9), 5, 0.9)])
def test_aggregation(spark, method, scores, top_m, want):
    row = S.label_scores(hits(spark, scores), ["k"], EngineConfig(evidence=Evidence(method=method, best=top_m))).first()
    assert row["agg"] == pytest.approx(want, abs=1e-6)


def test_spread_and_margin_of_a_single_label(spark):
    scores = S.label_scores(hits(spark, (0.9, 0.8, 0.1)), ["k"], EngineConfig())
    assert scores.first()["consistency"] == pytest.approx(0.355903, abs=1e-6)
    one = scores.withColumn("agg", F.lit(0.5))
    assert S.best_label(one, ["k"], EngineConfig()).first()["margin"] == pytest.approx(0.499999, abs=1e-9)


def test_temperature_of_zero_is_the_maximum(spark):
    assert S.label_scores(hits(spark, (0.9, 0.8)), ["k"], EngineConfig(evidence=Evidence(temperature=0.0))).first()["agg"] == pytest.approx(0.9, abs=1e-6)


def nms_rows(spark):
    return spark.createDataFrame([(1, "a", 0, 0.9, 0.0, 0.0, 10.0, 10.0), (1, "a", 1, 0.8, 1.0, 1.0, 11.0, 11.0), (1, "b", 2, 0.7, 1.0, 1.0, 11.0, 11.0), (1, "a", 3, 0.1, 20.0, 20.0, 30.0, 30.0)], "image_id int, label string, seq int, confidence double, x1 double, y1 double, x2 double, y2 double")


def test_nms(spark):
    rows = nms_rows(spark)
    kept = B.nms(rows, ["image_id", "label"])
    assert sorted(r["seq"] for r in kept.collect()) == [0, 2, 3]
    assert sorted(r["seq"] for r in B.nms(kept, ["image_id", "label"]).collect()) == [0, 2, 3]
    gated = B.nms(rows, ["image_id", "label"], least=0.5)
    assert sorted(r["seq"] for r in gated.collect()) == sorted(r["seq"] for r in kept.where("confidence >= 0.5").collect())
    assert B.nms(rows.limit(0), ["image_id", "label"]).count() == 0


def test_suppression_is_strict_and_matching_is_not(spark):
    half = spark.createDataFrame([(1, "a", 0, 0.9, 0.0, 0.0, 10.0, 10.0), (1, "a", 1, 0.8, 0.0, 0.0, 10.0, 5.0)], "image_id int, label string, seq int, confidence double, x1 double, y1 double, x2 double, y2 double")
    assert B.nms(half, ["image_id", "label"], 0.5).count() == 2
    gt = half.where("seq = 0").select("image_id", "label", F.col("seq").alias("gt_seq"), "x1", "y1", "x2", "y2")
    got = B.match_greedy(half.where("seq = 1"), gt, ["image_id", "label"], 0.5, confidence="confidence")
    assert got.first()["tp"] == 1


def test_average_precision(spark):
    matched = spark.createDataFrame([(1, "a", i, 1 - i / 10, t) for i, t in enumerate((1, 0, 1))], "image_id int, label string, seq int, conf double, tp int")
    gt = spark.createDataFrame([("a",), ("a",), ("b",)], "label string")
    rows = {r["label"]: r for r in V.average_precision(matched, gt).collect()}
    assert rows["a"]["ap"] == pytest.approx(0.833333, abs=1e-6) and rows["a"]["ar"] == pytest.approx(1.0, abs=1e-6)
    assert (rows["b"]["ap"], rows["b"]["ar"], rows["b"]["num_gt"], rows["b"]["num_predictions"]) == (0, 0, 1, 0)
    none = V.average_precision(matched, gt.where("label = 'z'")).first()
    assert (none["ap"], none["ar"], none["num_gt"]) == (0, 0, 0)


@pytest.mark.parametrize("name, found, want", [("Cup", {"red_cup": 0.9, "cup": 0.5, "bottle": 0.6}, {"red_cup", "cup", "bottle"}), ("x", {"a": 0.3}, {"x"}), ("x", {}, {"x"}), ("  ", {"a": 0.9}, set())])
def test_label_resolution(spark, name, found, want):
    h = spark.createDataFrame([(1, label, s) for label, s in found.items()], "query_id int, label string, score double")
    q = spark.createDataFrame([(1, name)], "query_id int, query_label string")
    assert {r["label"] for r in L.resolve_labels(h, q, EngineConfig()).collect()} == want


def test_boost_mode(spark):
    h = spark.createDataFrame([("a", 0.5), ("a", 0.7), ("b", 0.6), ("b", 0.6)], "label string, score double")
    assert [tuple(r) for r in L.image_boost(h, "mode").collect()] == [("a", 2.0)]
    assert L.image_boost(h.limit(0), "mode").count() == 0
    with pytest.raises(ValueError):
        L.image_boost(h, "median")


def test_hybrid_merge(spark):
    t = spark.createDataFrame([(1, "x", "lx", 0.9, 1), (1, "y", "text", 0.4, 2)], "query_id int, id string, label string, score double, rank int")
    i = spark.createDataFrame([(1, "y", "image", 0.7, 1), (1, "z", "lz", 0.6, 2)], "query_id int, id string, label string, score double, rank int")
    assert [(r["id"], r["label"], r["score"]) for r in K.merge_hits(t, i, 2).orderBy("rank").collect()] == [("x", "lx", 0.9), ("y", "image", 0.7)]


def test_references(spark, tmp_path):
    refs = [{"label": "a", "path": "p"}, {"label": "b", "prompt": " q "}, {"label": "c", "modality": "TEXT ", "text": "t"}, {"label": " ", "text": "t"}, {"label": "d", "text": " "}, {"label": "e", "id": "own", "query": "q"}]
    (tmp_path / "r.json").write_text(json.dumps(refs))
    got = {r["id"]: (r["modality"], r["text"], r["path"]) for r in R.normalize_references(R.read_references(spark, str(tmp_path / "r.json"))).collect()}
    assert got == {"image_a": ("image", None, "p"), "text_b": ("text", "q", None), "text_c": ("text", "t", None), "own": ("text", "q", None)}


def test_coco(spark, tmp_path):
    ann = {"images": [{"id": 1, "file_name": "f.jpg", "width": 9, "height": 9}], "categories": [{"id": 1, "name": "cat"}, {"id": 2, "name": "cat"}], "annotations": [{"image_id": 1, "category_id": 1, "bbox": [1, 2, 3, 4]}, {"image_id": 1, "category_id": 1}, {"category_id": 1, "bbox": [1, 2, 3, 4]}]}
    (tmp_path / "a.json").write_text(json.dumps(ann))
    images, categories, gt = R.read_coco(spark, str(tmp_path / "a.json"))
    assert [tuple(r) for r in categories.collect()] == [("cat", 2)]
    row = gt.collect()
    assert len(row) == 1 and (row[0]["x2"], row[0]["y2"], row[0]["label"]) == (4.0, 6.0, "cat")
    files = spark.createDataFrame([("/b/f.jpg",), ("/c/f.jpg",)], "path string")
    assert R.images_with_files(images, files, ("/a", "/c", "/b")).first()["path"] == "/c/f.jpg"


def test_prompts(spark):
    rows = spark.createDataFrame([('{"a": "x", "b": ["y", "y", " "]}',)], "value string")
    assert {tuple(r) for r in R.prompts_from_map(rows).collect()} == {("a", "x", 0), ("b", "y", 0)}
    assert value(spark, E.from_csv(F.lit("a, ,b,a"))) == ["a", "b", "a"]


def bank(spark):
    return spark.createDataFrame([("r1", "a", "text", [1.0, 0.0]), ("r2", "b", "", [0.0, 1.0]), ("r3", "a", "image", [1.0, 1.0]), ("r0", "c", None, [2.0, 0.0])], "id string, label string, modality string, embedding array<float>")


def test_filters(spark):
    b = bank(spark)
    assert {r["id"] for r in K.select_candidates(b, "text").collect()} == {"r1", "r2", "r0"}
    assert {r["id"] for r in K.select_candidates(b, "text", strict_modality=True).collect()} == {"r1"}
    assert K.select_candidates(b, metadata={"absent": "x"}).count() == 0
    none = spark.createDataFrame([], "id string")
    assert K.select_candidates(b, candidate_ids=none).count() == 4
    assert K.select_candidates(b, candidate_ids=spark.createDataFrame([("r1",)], "id string")).count() == 1


def test_topk_ties_sizes_and_dimension(spark):
    b = bank(spark)
    assert [r["id"] for r in K.vector_topk(b, [1.0, 0.0], 2).collect()] == ["r0", "r1"]
    assert K.vector_topk(b, [1.0, 0.0], 99).count() == 4
    assert K.vector_topk(b.limit(0), [1.0, 0.0]).count() == 0
    with pytest.raises(Exception, match="dimensions"):
        K.vector_topk(b, [1.0, 0.0, 0.0]).collect()


def test_batch_equals_single_and_blocks(spark, monkeypatch):
    b = bank(spark)
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 1.0])], "query_id int, embedding array<float>")
    single = {(n, r["id"], i + 1) for n, v in ((1, [1.0, 0.0]), (2, [0.5, 1.0])) for i, r in enumerate(K.vector_topk(b, v, 3).collect())}
    assert {(r["query_id"], r["id"], r["rank"]) for r in K.batch_knn(q, b, 3).collect()} == single
    monkeypatch.setattr(K, "MOST_BROADCAST", 32)
    assert {(r["query_id"], r["id"], r["rank"]) for r in K.batch_knn(q, b, 3).collect()} == single
    assert K.batch_knn(q, b.limit(0), 3).count() == 0


def test_approximate_search_finds_most(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    b, q = e.select(F.col("vec_id").cast("string").alias("id"), "label", "embedding"), e.where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = {(r["query_id"], r["id"]) for r in K.batch_knn(q, b, 5, carry=("label",)).collect()}
    near = {(r["query_id"], r["id"]) for r in K.approximate_knn(q, b, 5).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_bank_files(spark, tmp_path):
    path = str(tmp_path / "bank")
    b = Bank.with_norm(bank(spark).where("modality in ('text', 'image')"))
    Bank.save_bank(b, path)
    Bank.save_bank(b.where("modality = 'text'"), path)  # the other modality stays
    assert Bank.load_bank(spark, path).count() == 2
    assert Bank.load_bank(spark, path, "image").first()["norm"] == pytest.approx(math.sqrt(2))
    Bank.append_bank(b, path, 2)
    assert Bank.load_bank(spark, path).count() == 4
    once = Bank.upsert(bank(spark).withColumn("v", F.lit(1)), bank(spark).withColumn("v", F.lit(2)), "v")
    assert [r["v"] for r in once.collect()] == [2] * 4
    assert tuple(Bank.manifest(bank(spark)).first()) == (4, 2)


def test_array_import(spark, tmp_path):
    import numpy as np

    np.save(tmp_path / "vectors.npy", np.arange(4, dtype=np.float64).reshape(2, 2))
    (tmp_path / "metadata.jsonl").write_text('{"id": "a", "label": "x"}\n\n{"id": "b", "label": "y"}\n')
    (tmp_path / "manifest.json").write_text('{"count": 2, "dim": 2}')
    got = {r["id"]: r["embedding"] for r in Bank.import_arrays(spark, str(tmp_path)).collect()}
    assert got == {"a": [0.0, 1.0], "b": [2.0, 3.0]}


def test_encoders_and_proposals(spark):
    from fathomline.functions.encoders import encode_column, hashed_words, propose

    rows = spark.createDataFrame([("a red cup",), ("",)], "text string")
    sizes = sorted(math.sqrt(sum(x * x for x in r["embedding"])) for r in encode_column(rows, "text", hashed_words(16)).collect())
    assert sizes == pytest.approx([0.0, 1.0], abs=1e-6)
    images = spark.createDataFrame([(1, bytearray(b"x"))], "image_id int, content binary")
    model = lambda: lambda data: [([0.0, 0.0, 1.0, 1.0], 0.5)] * 3
    assert propose(images, model, most=2).count() == 2
    assert propose(images, model, most=0).count() == 1


def test_stream(spark, tmp_path):
    from fathomline.streaming.resume import pending, run_stream

    spark.range(5).withColumnRenamed("id", "image_id").write.parquet(str(tmp_path / "in"))
    arrivals = spark.readStream.schema("image_id long").parquet(str(tmp_path / "in"))
    run_stream(arrivals, lambda df: df.where("image_id % 2 = 0"), str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    done = spark.read.parquet(str(tmp_path / "out" / "done"))
    assert spark.read.parquet(str(tmp_path / "out" / "detections")).count() == 3
    assert pending(spark.range(7).withColumnRenamed("id", "image_id"), done).count() == 2


def test_config():
    with pytest.raises(ValueError):
        Evidence(method="median")
    with pytest.raises(ValueError):
        Suppression(scope="never")
    with pytest.raises(ValueError):
        EngineConfig(Retrieval(top_k=0))


def test_null_vectors_have_no_hits_and_mixed_lengths_fail(spark):
    rows = spark.createDataFrame([("a", "x", "text", [1.0, 0.0]), ("b", "x", "text", None)], "id string, label string, modality string, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id int, embedding array<float>")
    assert [(r["query_id"], r["id"]) for r in K.batch_knn(q, rows, 3).collect()] == [(1, "a")]
    assert K.batch_knn(q, rows.where("id = 'b'"), 3).count() == 0
    longer = rows.unionByName(spark.createDataFrame([("c", "x", "text", [1.0, 0.0, 0.0, 0.0])], rows.schema))
    with pytest.raises(Exception, match="dimensions"):
        K.batch_knn(q, longer, 3).collect()
    with pytest.raises(Exception, match="dimensions"):
        K.batch_knn(spark.createDataFrame([(1, [1.0])], q.schema), rows, 3).collect()
    with pytest.raises(Exception, match="nulls"):
        K.batch_knn(q, spark.createDataFrame([("a", "x", "text", [1.0, None])], rows.schema), 3).collect()


def test_the_driver_holds_one_block_at_a_time(spark, monkeypatch):
    from pyspark import Broadcast

    held, most = set(), []
    whole, destroy = type(spark.sparkContext).broadcast, Broadcast.destroy

    def broadcast(self, value):
        made = whole(self, value)
        held.add(id(made))
        most.append(len(held))
        return made

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", broadcast)
    monkeypatch.setattr(Broadcast, "destroy", lambda self, blocking=False: (held.discard(id(self)), destroy(self, blocking))[1])
    monkeypatch.setattr(K, "MOST_BROADCAST", 16)
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<float>")
    assert K.batch_knn(q, bank(spark), 4).count() == 4 and len(most) == 4 and max(most) == 1


def test_prompts_keep_their_type(spark, tmp_path):
    given = {"a": '[tabby] "kitten"', "b": ["x", " ", "[y]"], "c": '["z"]', " ": "q"}
    want = {("a", '[tabby] "kitten"'), ("b", "x"), ("b", "[y]"), ("c", '["z"]')}
    (tmp_path / "map.json").write_text(json.dumps(given))
    (tmp_path / "list.json").write_text(json.dumps([{"label": k, "query": "", "text": v} for k, v in given.items()]))
    for name in ("map", "list"):
        assert {(r["label"], r["query"]) for r in R.read_prompts(spark, str(tmp_path / f"{name}.json")).collect()} == want


def test_ids_are_numbered_across_ranges(spark):
    rows = spark.range(50).select(F.col("id").alias("n"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("own"), "id")).alias("id")).repartition(5)
    got = {r["n"]: r["id"] for r in Bank.default_ids(rows, 7, "n").collect()}
    free = [n for n in range(50) if n % 3]
    assert got == {n: f"own{n}" for n in range(0, 50, 3)} | {n: f"ref_{7 + i}" for i, n in enumerate(free)}


def test_curve_of_equal_confidences(spark):
    rows = spark.range(200).select((F.col("id") % 7).alias("image_id"), F.col("id").alias("seq"), F.lit("a").alias("label"), F.lit(1.0).alias("conf"), (F.col("id") % 2).cast("int").alias("tp"))
    curve = V.pr_curve(rows, spark.range(120).select(F.lit("a").alias("label"))).orderBy("n").collect()
    order = sorted(((r["image_id"], r["seq"], r["tp"]) for r in rows.collect()))
    assert [(r["image_id"], r["seq"], r["tp"]) for r in curve] == order and [r["n"] for r in curve] == list(range(1, 201))
    assert curve[-1]["tps"] == 100 and all(a["envelope"] >= b["envelope"] for a, b in zip(curve, curve[1:], strict=False))


def test_bank_from_a_references_file(spark, tmp_path):
    from fathomline.functions.encoders import encode_column, hashed_words

    def encode(refs):
        return encode_column(refs.withColumn("_of", F.coalesce("text", "path")), "_of", hashed_words(8)).drop("_of")

    path = str(tmp_path / "bank")
    with pytest.raises(FileNotFoundError):
        Bank.load_indices(spark, path)
    (tmp_path / "one.json").write_text(json.dumps([{"id": "r1", "label": "cup", "text": "red cup"}, {"id": "r2", "label": "cat", "text": "a cat"}]))
    Bank.bank_from_file(spark, str(tmp_path / "one.json"), path, encode)
    text, image = Bank.load_indices(spark, path)
    assert text.count() == 2 and image is None
    (tmp_path / "two.json").write_text(json.dumps([{"id": "r2", "label": "cat", "text": "black cat"}, {"label": "dog", "image": "d.png"}]))
    Bank.bank_from_file(spark, str(tmp_path / "two.json"), path, encode)
    text, image = Bank.load_indices(spark, path)
    assert {r["id"]: r["text"] for r in text.collect()} == {"r1": "red cup", "r2": "black cat"} and [r["id"] for r in image.collect()] == ["image_dog"]


def png(path, pixels):
    import struct
    import zlib

    h, w, _ = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + pixels[y].tobytes() for y in range(h))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_images_are_decoded_and_cropped(spark, tmp_path):
    import numpy as np

    from fathomline.functions.images import colour_grid, crops, encode_crops, read_images

    pixels = np.zeros((8, 12, 3), np.uint8)
    pixels[:, 6:] = (255, 0, 0)
    png(tmp_path / "a.png", pixels)
    (tmp_path / "broken.png").write_bytes(b"no image")
    images = read_images(spark, str(tmp_path))
    assert [(r["height"], r["width"], r["channels"]) for r in images.collect()] == [(8, 12, 3)]
    regions = images.select("path", F.explode(F.array(F.lit(0.0), F.lit(6.0), F.lit(100.0))).alias("x1")).selectExpr("path", "x1", "0.0D as y1", "x1 + 6 as x2", "99.0D as y2")
    got = {r["x1"]: r["embedding"] for r in encode_crops(crops(images, regions), colour_grid(1)).collect()}
    assert got[0.0] == [0.0, 0.0, 0.0] and got[6.0] == [1.0, 0.0, 0.0] == got[100.0]


def test_models_load_once_per_worker_and_call():
    from fathomline.functions.encoders import loaded

    made = []
    for call in ("x", "x", "y", "y"):
        loaded(call, lambda: made.append(1) or len(made))
    assert len(made) == 2


def test_command_line(spark, sf, tmp_path):
    from fathomline import cli

    assert cli.asked_queries(" a, ,b", ["c,d"]) == ["a", "b", "c,d"] and cli.metadata_filter('{"s": 1}') == {"s": 1} and cli.metadata_filter(None) is None
    with pytest.raises(ValueError):
        cli.metadata_filter("[1]")
    at = lambda name: str(tmp_path / name)
    (tmp_path / "refs.json").write_text(json.dumps([{"label": "cup", "text": "red cup"}, {"label": "cat", "text": "small cat"}]))
    cli.main(["index", "--references", at("refs.json"), "--bank", at("bank")], spark)
    from fathomline.functions.encoders import encode_column, hashed_words

    regions = encode_column(spark.createDataFrame([(1, 5, 0.9, 0.0, 0.0, 9.0, 9.0, "red cup"), (2, 5, 0.9, 20.0, 20.0, 30.0, 30.0, "small cat")], "region_id long, image_id long, objectness double, x1 double, y1 double, x2 double, y2 double, of string"), "of", hashed_words())
    regions.write.parquet(at("regions"))
    cli.main(["detect", "--bank", at("bank"), "--regions", at("regions"), "--out", at("found"), "--query", "cup"], spark)
    payload = json.loads(spark.read.text(at("found")).first()[0])
    assert payload["image"] == 5 and payload["queries"] == ["cup"] and payload["num_detections"] >= 1 and payload["query_images"] == []
    boxes = spark.createDataFrame([(5, 1, "cup", 0.9, 0.0, 0.0, 9.0, 9.0)], "image_id long, seq int, label string, conf double, x1 double, y1 double, x2 double, y2 double")
    boxes.write.parquet(at("boxes"))
    ann = {"images": [{"id": 5, "file_name": "f.jpg", "width": 9, "height": 9}], "categories": [{"id": 1, "name": "cup"}], "annotations": [{"image_id": 5, "category_id": 1, "bbox": [0, 0, 9, 9]}]}
    (tmp_path / "ann.json").write_text(json.dumps(ann))
    cli.main(["benchmark", "--annotations", at("ann.json"), "--predictions", at("boxes"), "--out", at("summary")], spark)
    summary = json.loads(spark.read.text(at("summary")).first()[0])
    assert summary["num_labels"] == 1 and summary["mean_ar"] == pytest.approx(1.0, abs=1e-6) and summary["metrics"]["cup"]["num_gt"] == 1
    boxes.withColumnsRenamed({"conf": "confidence"}).withColumn("score", F.lit(0.1)).write.parquet(at("shown"))
    cli.main(["draw", "--predictions", at("shown"), "--out", at("captions")], spark)
    assert spark.read.parquet(at("captions")).first()["caption"] == "cup: 0.90"
