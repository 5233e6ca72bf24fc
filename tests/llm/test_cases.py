"""Awkward tables for every operator: nulls, empty and very long texts, ties, repeats, clashing names, no rows."""

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from fathomline.llm import passages
from fathomline.llm.bpe import decode_documents, encode_documents, round_trip
from fathomline.llm.decontaminate import decontaminate, drop_contaminated
from fathomline.llm.langid import predict_languages
from fathomline.llm.linededup import dedup_lines
from fathomline.llm.ogg import read_ogg, text_to_ogg
from fathomline.llm.passages import repeated_passages
from fathomline.llm.quality import score_quality
from fathomline.llm.simhash import simhash_groups
from fathomline.llm.toxicity import score_toxicity
from fathomline.llm.urls import judge_urls

import public_tokenizers

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
LONG = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
#: Columns named like what operators add or use inside.
EXTRA = "id long, th long, score double, fp long, _t string, n_lines long, held_out boolean, predicted int, key long, slot long, seed long"


def awkward(spark):
    rows = [(1, None, None, "s"), (2, "", "en", None), (3, "   \n\t ", "en", "s"), (4, "12345 !!! ???", "en", "s"), (5, "a", "en", "s"), (6, LONG, "en", "s"), (7, "same text here again\nand more", "en", "s"), (7, "same text here again\nand more", "en", "s"), (8, "same text here again\nand more", "en", "s"), (None, "no id at all", "de", "s"), (9, "naïve café — 🙂 \u2028 end\r\n", "fr", "s")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("*", *[F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in EXTRA.split(", ")])


def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(1, 10)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


def benchmark(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "two words"), (4, "the item asks for five or more words here")], "item_id long, text string")


OPERATORS = {
    "bpe": lambda spark, docs: round_trip(docs, RANKS, PATTERN),
    "ogg": lambda spark, docs: read_ogg(text_to_ogg(docs)),
    "language": lambda spark, docs: predict_languages(docs),
    "lines": lambda spark, docs: dedup_lines(docs),
    "simhash": lambda spark, docs: simhash_groups(docs),
    "quality": lambda spark, docs: score_quality(docs, labels(spark)),
    "toxicity": lambda spark, docs: score_toxicity(docs, labels(spark)),
    "clean": lambda spark, docs: drop_contaminated(docs, benchmark(spark)),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_row_per_row(spark, name):
    docs = awkward(spark)
    got = OPERATORS[name](spark, docs).collect()
    assert sorted((r["doc_id"] or 0) for r in got) == sorted((r["doc_id"] or 0) for r in docs.collect())
    seven = [r for r in got if r["doc_id"] == 7]
    assert len(seven) == 2 and seven[0] == seven[1]


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, awkward(spark).limit(0)).count() == 0
    assert OPERATORS[name](spark, awkward(spark).where("doc_id < 0")).count() == 0


def test_defined_results(spark):
    docs = awkward(spark)
    lang = {r["doc_id"]: r for r in predict_languages(docs).collect()}
    assert all(lang[i]["lang_pred"] == "und" and lang[i]["score"] == 0 for i in (1, 2, 3, 4))
    lines = {r["doc_id"]: r for r in dedup_lines(docs).collect()}
    assert lines[1]["text"] is None and lines[1]["n_lines"] == 0 and lines[2]["text"] == "" and lines[2]["n_lines"] == 1
    media = {r["doc_id"]: r for r in read_ogg(text_to_ogg(docs)).collect()}
    assert bytes(media[1]["payload"]) == bytes(media[2]["payload"]) == b"\0" * 64 and bytes(media[6]["payload"]).rstrip(b"\0") == LONG.encode()
    groups = {r["doc_id"]: r for r in simhash_groups(docs).collect()}
    assert groups[1]["fingerprint"] == groups[3]["fingerprint"] == "0" * 16 and groups[3]["component_id"] == 1 and groups[8]["component_id"] == 7
    tokens = {r["doc_id"]: r for r in round_trip(docs, RANKS, PATTERN).collect()}
    assert tokens[1]["n_tokens"] == tokens[2]["n_tokens"] == 0 and tokens[6]["n_tokens"] > 30_000


def test_columns_named_like_the_added_ones_are_replaced(spark):
    docs = awkward(spark)
    media = read_ogg(text_to_ogg(docs).withColumns({"payload": F.lit(1), "mean": F.lit("x")}))
    assert media.columns.count("payload") == media.columns.count("mean") == 1 and media.count() == docs.count()
    decoded = decode_documents(encode_documents(docs, RANKS, PATTERN).withColumn("decoded", F.lit(1)), RANKS)
    assert decoded.columns.count("decoded") == 1 and dict(decoded.dtypes)["decoded"] == "string"
    clash = docs.withColumns({c: F.lit(1) for c in ("_own", "_id", "_th", "_starts", "r", "bits", "w", "s", "hit")})
    assert dedup_lines(clash).count() == docs.count() and set(clash.columns) | {"n_removed"} == set(dedup_lines(clash).columns)


def test_every_stage_on_awkward_tables(spark, tmp_path):
    """Null and shared ids, null and empty texts, no rows: each stage keeps what its operator says."""
    import corpus_pipeline

    benchmark(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = awkward(spark).select(corpus_pipeline.COLUMNS)
    rows, none = docs.count(), docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, str(tmp_path))
        assert stage(spark, none, str(tmp_path)).count() == 0
        if name != "token_ids":
            assert got.columns == corpus_pipeline.COLUMNS
        kept = sorted(((r["doc_id"] or 0) for r in got.collect()))
        if name in ("leaks", "token_ids"):
            assert len(kept) == rows
        if name == "near_copies":  # 1, 2, 3 have no word; 7, 7, 8 are alike
            assert kept == [0, 1, 4, 5, 6, 7, 9]


def test_without_labels_scores_are_even(spark):
    none = labels(spark).limit(0)
    for scored in (score_quality(awkward(spark), none), score_toxicity(awkward(spark), none)):
        assert {r["score"] for r in scored.collect()} == {0.5}


def test_pairs_of_awkward_tables(spark):
    docs = awkward(spark)
    assert decontaminate(docs, benchmark(spark)).count() == 0
    assert decontaminate(docs, benchmark(spark).limit(0)).count() == 0
    assert decontaminate(docs.limit(0), benchmark(spark)).count() == 0
    assert repeated_passages(docs).count() == 0
    assert repeated_passages(docs.limit(0)).count() == 0
    twice = docs.where("doc_id = 6").unionByName(docs.where("doc_id = 6").withColumn("doc_id", F.lit(60).cast("long"))).unionByName(docs.where("doc_id = 6"))
    got = repeated_passages(twice).collect()
    assert {(r["doc_id"], r["partner"]) for r in got} == {(60, 6)}
    assert max(r["end_word"] - r["start_word"] for r in got) == 30_000


def test_awkward_pages(spark):
    rows = [(1, None, None), (2, "", ""), (3, "no scheme", "<a href='http://x.org/'>"), (4, "http://A.Example.NET/en/x?y", None), (4, "http://A.Example.NET/en/x?y", None), (5, "x://", "h"), (None, "http://b.com#f", "x"), (6, "http://B.com?q=://z", "x" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit("clash"), "trust": F.lit(1)})
    got = {r["page_id"]: r for r in judge_urls(pages).collect()}
    assert judge_urls(pages).count() == 8 and judge_urls(pages.limit(0)).count() == 0
    assert (got[1]["host"], got[3]["host"], got[5]["host"], got[6]["host"], got[6]["path"]) == ("", "", "", "b.com", "")
    assert (got[4]["rule"], got[4]["verdict"], got[4]["path"]) == ("example.net/en/", "allow", "/en/x")
    assert got[1]["verdict"] == "allow" and got[1]["rule"] is None


def test_ids_decode_to_the_text(spark):
    docs = awkward(spark)
    got = decode_documents(encode_documents(docs, RANKS, PATTERN).withColumn("more", F.lit(1)), RANKS).collect()
    assert sorted((r["doc_id"] or 0, r["decoded"]) for r in got) == sorted((r["doc_id"] or 0, r["text"] or "") for r in docs.collect())
    assert {r["more"] for r in got} == {1}


def test_words_are_told_apart_as_one_by_one():
    texts = [f"{c}A{c}b{c} x{c} {c}" for c in map(chr, range(0x3100)) if not c.isalnum() or not c.isascii()] + ["", " ", "...", "İSTANBUL ΣΑΣ ΟΔΟΣ.", "«Word,» word WORD"]
    got, starts = passages.word_hashes(texts)
    words = [[w for w in (x.strip(passages._EDGE).lower() for x in t.split()) if w] for t in texts]
    assert np.diff(starts).tolist() == [len(x) for x in words]
    assert got.tolist() == [xxhash.xxh64_intdigest(w) % 0xFFFFFF + 1 for x in words for w in x]


def test_chains_of_chance_seeds_are_judged_together(monkeypatch):
    """One seed of five words in unrelated texts, a thousand times, and two passages among them."""
    random, rows = np.random.default_rng(3), []
    for doc in range(1000, 2000):
        a, b = random.integers(1, 1 << 24, (2, passages.BLOCK_WORDS))
        size = 60 if doc in (1200, 1999) else 5
        b[20 : 20 + size] = a[30 : 30 + size]
        rows += [(doc, 1, 0, -1, -1, None, [30, 35, 20]), (doc, 1, 0, 1, 0, passages.packed(b), None), (doc, 1, 0, 0, 0, passages.packed(a), None)]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32())]
    names = ["doc", "partner", "nth", "side", "block", "words", "path"]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 700], strict=True), kinds, strict=True)], names=names) for i in range(0, len(rows), 700)]
    calls, unpacked = [], passages.unpacked
    monkeypatch.setattr(passages, "unpacked", lambda data: calls.append(1) or unpacked(data))
    got = [r for b in passages._align_pairs(40, 0.8)(iter(batches)) for r in b.to_pylist()]
    assert [(r["doc"], r["partner"], r["start_word"], r["partner_start"], r["identity"]) for r in got] == [(1200, 1, 30, 20, 1.0), (1999, 1, 30, 20, 1.0)]
    assert len(calls) < 10
