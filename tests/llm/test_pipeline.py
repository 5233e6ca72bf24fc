"""The pipeline, stage by stage, against brute force on its own input."""

import hashlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa

import corpus_pipeline
from fathomline.llm import arrow, bpe, decontaminate, simhash
from fathomline.llm.scratch import Scratch
from tests.llm.test_operators import RANKS, brute_components, brute_lines


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scratch, results = Scratch(spark, "test"), [docs]
    for name, stage in corpus_pipeline.STAGES:
        results.append(scratch.save(stage(spark, results[-1], sf)))
    before = [{r["doc_id"]: r for r in x.collect()} for x in results]
    for stage in before[1:-1]:
        assert set(next(iter(stage.values())).asDict()) == set(docs.columns)
    start, language, lines, copies, leaks, tokens = before
    assert len(language) == len(start) and sum(r["lang"] != start[i]["lang"] for i, r in language.items()) <= 2

    cut = brute_lines({i: r["text"] for i, r in language.items()}, 3)
    assert {i: r["text"] for i, r in lines.items()} == {i: t for i, t in cut.items() if t == language[i]["text"] or t.strip()}
    assert all(r["n_chars"] == len(r["text"]) for i, r in lines.items() if r["text"] != language[i]["text"])

    fps = {i: simhash.fingerprint(r["text"], 4) for i, r in lines.items()}
    roots = brute_components(fps.values(), 4)
    first = {}
    for i in sorted(fps):
        first.setdefault(roots[fps[i]], i)
    assert set(copies) == set(first.values())

    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {i for i, r in copies.items() if not decontaminate.find_leaks(r["text"], bench)}
    assert set(leaks) == clean and not any(t in leaks[i]["text"] for i in leaks for _, t in bench)

    assert set(tokens) == set(leaks)
    for i, r in tokens.items():
        text = leaks[i]["text"]
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest() and r["ids_sha256"] == hashlib.sha256(bytes(r["ids"])).hexdigest()
        assert r["n_tokens"] == len(r["ids"]) // 4
    some = next(iter(tokens))
    assert "".join(bpe.decoder(RANKS).decode(np.frombuffer(bytes(tokens[some]["ids"]), "<u4"))) == leaks[some]["text"]
    assert P.PATTERN and corpus_pipeline.ORACLE_SQL is None


def test_run_equals_stages(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert got.count() > 100 and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"} == set(got.columns)


def test_every_stage_begins_afresh(spark, sf, monkeypatch):
    """What earlier stages made executors and workers take would stay beside what the stage needs."""
    asked = []
    monkeypatch.setattr(corpus_pipeline, "shrink_executors", lambda _: asked.append("executors"))
    monkeypatch.setattr(corpus_pipeline, "shrink_workers", lambda _: asked.append("workers"), raising=False)
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(20)
    for _, stage in corpus_pipeline.STAGES:
        asked.clear()
        stage(spark, docs, sf)
        assert sorted(asked) == ["executors", "workers"]


def test_workers_empty_their_tables(spark):
    def fill(batches):
        arrow.worker_table("test", {1: bytes(1000)})
        yield from batches

    def left(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(arrow._tables.get("test", {}))] * batch.num_rows)], names=["id"])

    n = spark.sparkContext.defaultParallelism
    arrow.shrink_workers(spark)
    spark.range(0, 4 * n, 1, 4 * n).mapInArrow(fill, "id long").count()
    arrow.shrink_workers(spark)
    assert {r["id"] for r in spark.range(0, 4 * n, 1, 4 * n).mapInArrow(left, "id long").collect()} == {0}
