"""Operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import pairwise, product

import numpy as np
import pytest
import regex
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import public_tokenizers as P
from fathomline.llm import bpe, decontaminate, langid, linededup, ogg, passages, quality, simhash, toxicity, urls
from fathomline.llm.components import connected_components
from fathomline.llm.queries import ORACLES, QUERIES
from fathomline.llm.sample import fit_in_one_task, hash_sample, labelled_sample
from fathomline.llm.scratch import Scratch

DATA = os.environ.get("TEST_DATA", "/root/testdata")
RANKS = open(P.path("byte_bpe_50k.tiktoken"), "rb").read()


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, tables, name):
    df = QUERIES[name](spark, sf)
    result = tables.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, result.fetchall())


# --- 1 ---


def test_links_carry_trust_and_distrust(spark):
    pages = spark.createDataFrame([
        (1, "http://good.org/fr/a", '<a href="http://friend.io/x">'), (2, "http://friend.io/x", "<a HREF=http://second.io/>"), (3, "http://second.io/", None),
        (4, "http://shady.biz/", '<a href="http://bad.net/">'), (5, "http://bad.net/", ""), (6, "http://alone.biz/", ""),
    ], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in urls.judge_urls(pages).collect()}
    assert got[2]["trust"] > got[3]["trust"] > 0 and got[2]["distrust"] == 0 and got[2]["verdict"] == "allow"
    assert got[4]["distrust"] > 0 and got[4]["verdict"] == "block" and got[5]["rule"] == "net/"
    assert got[6]["verdict"] == "allow" and got[6]["trust"] == 0


def test_links_without_a_scheme_count(spark):
    pages = spark.createDataFrame([(1, "https://shady.biz/", 'see <a href="//bad.net/x">'), (2, "http://bad.net/", ""), (3, "http://plain.biz/", '<a href="/a//bad.net/">')], "page_id long, url string, html string")
    assert {r["page_id"]: r["verdict"] for r in urls.judge_urls(pages).collect()} == {1: "block", 2: "block", 3: "allow"}


def test_verdicts_do_not_depend_on_the_size_of_the_corpus(spark):
    far = spark.range(1000).select(F.concat(F.lit("http://s"), F.col("id"), F.lit(".biz/")).alias("url"), F.lit('<a href="http://bad.net/">').alias("html"))
    many = spark.range(400_000).select(F.lit("http://worse.net/").alias("url"), F.lit("").alias("html"))
    pages = far.unionByName(many).unionByName(spark.createDataFrame([("http://bad.net/", "")], "url string, html string")).withColumn("page_id", F.monotonically_increasing_id())
    got = urls.judge_urls(pages).where("host like 's%.biz'").select("verdict", "distrust").distinct().collect()
    assert [tuple(r) for r in got] == [("block", 0.0)]


@pytest.mark.parametrize("host, path, want", [("example.net", "/en/x", "example.net/en/"), ("a.example.net", "/fr/", "net/"), ("anexample.net", "/en/", "net/"), ("x.net", "", None), ("b.org", "/fr/", "org/fr/"), ("example.com", "/de", None), ("example.com", "/de/x", "example.com/de/")])
def test_longest_rule(spark, host, path, want):
    got = spark.range(1).select(urls.fitting_rule(F.lit(host), F.lit(path)).alias("r")).first()["r"]
    assert (got and got["rule"]) == want


# --- 2 ---

ITEM = "Alice Smith has 12 apples and gives 5 of them to her brother Bob. How many apples does Alice keep if each weighs 150 g and the basket holds 3 kg?"


def leaks(text, **how):
    return decontaminate.find_leaks(text, [(1, ITEM), (2, "Yes it is")], **how)


def test_reparameterised_questions_are_leaks():
    other = ITEM.replace("Alice", "Carol").replace("Bob", "Dan").replace("12", "40").replace("5 of", "7.5 of").replace("150 g", "90 kg")
    assert leaks(f"before {other} after") == leaks(ITEM.lower()) == leaks(ITEM.upper()) == leaks(ITEM) == [1]
    assert leaks("yes, it is!") == [2] and leaks("some text about apples in 12 baskets of Bob") == []


def test_slots_must_be_consistent():
    item = decontaminate.template_tokens("give Anna 3 and Anna 3 and Anna 3 then Bert 4")
    good = decontaminate.template_tokens("give Carl 9 and Carl 9 and Carl 9 then Dora 8")
    bad = decontaminate.template_tokens("give Carl 9 and Emil 7 and Fred 6 then Carl 9")
    assert decontaminate.slot_consistency(item, good) == 1.0
    assert decontaminate.slot_consistency(item, bad) < 0.8


def test_instances_of_an_item_are_judged_by_themselves():
    one = ITEM.replace("Alice", "Carol").replace("Bob", "Dan").replace("12", "40").replace("5 of", "7 of").replace("150 g", "90 kg")
    two = ITEM.replace("Alice", "Emil").replace("Bob", "Fred").replace("12", "31").replace("5 of", "8 of").replace("3 kg", "9 lb").replace("150 g", "20 kg")
    assert leaks(f"{one} {two}") == leaks(f"{ITEM} {one}") == leaks(" ".join([one, two, ITEM.replace("12", "77")] * 20)) == [1]


@pytest.mark.parametrize("item", ["Solve 3x + 5 = 20", "Compute 12*15 - 3^2", "2, 4, 8, 16, 32, 64, 128, 256", "7 kg 9 kg 11 kg 13 kg"])
def test_items_dense_in_numbers_are_found_verbatim(item):
    find = lambda text: decontaminate.find_leaks(text, [(1, item)])
    assert find(f"some words before {item} and after") == [1] and find("other numbers 1, 3, 5, 6, 7, 9 and 10 kg 12 kg") == []


def test_a_unit_needs_a_number():
    kinds = lambda text: [x & 7 for x in decontaminate.template_tokens(text).tolist()]
    U, N, L = decontaminate.UNIT, decontaminate.NUMBER, decontaminate.LITERAL
    assert kinds("in a second 5 in or $ 7 in") == [L, L, L, N, U, L, U, N, U]


def test_verbatim_items_are_found(spark, sf, docs):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    want = {(r["doc_id"], i) for r in docs.collect() for i, t in items if t in r["text"]}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.decontaminate(docs, bench).collect()}
    assert want and want <= got and len(got) <= len(want) + 2
    kept = {r["doc_id"] for r in decontaminate.drop_contaminated(docs, bench).collect()}
    assert kept == {r["doc_id"] for r in docs.select("doc_id").collect()} - {d for d, _ in got}


def test_leaks_equal_the_search_without_spark(spark, docs):
    """All documents against all items, one by one; numbers, short items, repeated items and rows among them."""
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/sf0.001/benchmark.parquet").collect()]
    more = ["12 + 35 * 4 - 7 = 151", "7 plus 8 equals 15", "Solve 3x + 5 = 20", "two words", "word", ITEM, ITEM]
    items += [(10_000 + i, t) for i, t in enumerate(more)]
    texts = [(r["doc_id"], r["text"]) for r in docs.where("doc_id % 4 = 0").collect()]
    texts += [(90_000 + i, f"some words {t} and more") for i, t in enumerate(more)] + [(91_000, "Two words!"), (91_001, "word"), (91_002, "word"), (91_003, ITEM.replace("Alice", "Carol")), (91_003, ITEM.replace("Alice", "Carol"))]
    table, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.decontaminate(table, bench).collect())
    assert got == sorted({(i, k) for i, t in texts for k in decontaminate.find_leaks(t or "", items)})
    assert {(90_000, 10_000), (90_001, 10_001), (90_002, 10_002), (91_000, 10_003), (91_001, 10_004), (91_003, 10_005), (91_003, 10_006)} <= set(got) and (90_003, 10_003) not in got
    kept = sorted(r["doc_id"] for r in decontaminate.drop_contaminated(table, bench).collect())
    assert kept == sorted(i for i, _ in texts if i not in {d for d, _ in got})


# --- 3 ---


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    for n, cuts in ((1, [0]), (6, [0, 2]), (150, [*range(0, 150, 9)])):
        e, first = rng.normal(0, 3, n), np.zeros(n, bool)
        first[cuts] = True
        start, move = rng.normal(size=2), rng.normal(size=(2, 2))
        want = []
        for a, b in zip(cuts, [*cuts[1:], n], strict=True):
            mass, total = np.zeros(b - a), 0.0
            for tags in product((0, 1), repeat=b - a):
                weight = np.exp(start[tags[0]] + sum(move[x, y] for x, y in zip(tags, tags[1:])) + sum(e[a + t] for t, x in enumerate(tags) if x))
                total += weight
                mass += weight * np.array(tags)
            want += (mass / total).tolist()
        assert np.allclose(toxicity.chain_marginals(e, first, start, move), want)


def test_scores_do_not_depend_on_the_order_of_rows(spark, sf, docs):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    mixed = [x.repartition(7, F.xxhash64("doc_id", F.lit(3))).sortWithinPartitions(F.xxhash64("doc_id", F.lit(4))) for x in (docs, labels)]
    for score in (quality.score_quality, toxicity.score_toxicity):
        one, other = (sorted(map(tuple, score(*x).drop("spans").collect())) for x in ((docs, labels), mixed))
        assert np.allclose([x[2] for x in one], [x[2] for x in other], atol=2e-6) and [x[:2] for x in one] == [x[:2] for x in other]
    assert sorted(map(tuple, langid.predict_languages(docs).collect())) == sorted(map(tuple, langid.predict_languages(mixed[0]).collect()))


def test_long_toxic_documents_teach_all_their_spans():
    chunk = ["badword nice " * 100] * 8 + ["nice day here " * 100] * 8, np.array([1] * 8 + [0] * 8), np.ones(16)
    seen = []
    whole = toxicity.train_field
    try:
        toxicity.train_field = lambda sequences, tags: seen.append(tags.sum()) or whole(sequences, tags, epochs=1)
        toxicity.fit_field(iter([chunk]))
    finally:
        toxicity.train_field = whole
    assert seen[0] >= 8 * 100


def held_out_accuracy(spark, sf, made, label):
    got = made.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    return got.select(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0]


def test_scores_equal_the_plain_field(spark, sf, docs):
    """The query's scores and spans, recomputed by a plain forward-backward over each document."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    field = fit_in_one_task(labelled_sample(docs, labels, "toxic", "doc_id", "text", 3, 1, 3000), toxicity.fit_field)
    got = {r["doc_id"]: r for r in QUERIES["op3_toxicity"](spark, sf).collect()}
    for r in docs.where("n_chars < 4000 and doc_id % 5 = 0").collect():
        tokens = list(re.finditer(r"[^\W\d_]+", r["text"] or ""))
        e = [float(field.weights[toxicity.features(t.group())].sum()) for t in tokens]
        n = len(e)
        f, b = np.zeros((n, 2)), np.zeros((n, 2))
        for t in range(n):
            own = np.array([0, e[t]])
            f[t] = own + (field.start if not t else np.logaddexp(f[t - 1, 0] + field.move[0], f[t - 1, 1] + field.move[1]))
        for t in range(n - 2, -1, -1):
            after = np.array([0, e[t + 1]]) + b[t + 1]
            b[t] = np.logaddexp(field.move[:, 0] + after[0], field.move[:, 1] + after[1])
        p = 1 / (1 + np.exp((f + b)[:, 0] - (f + b)[:, 1]))
        evidence = np.array([np.log((p**3).sum() + 0.02), p.max(initial=0.0), np.log1p(n), 1.0])
        want = 1 / (1 + np.exp(-evidence @ field.calibration))
        row = got[r["doc_id"]]
        assert abs(row["score"] - want) < 1e-4 and row["predicted"] == (row["score"] >= 0.7)
        sure = {(t.start(), t.end()) for t, x in zip(tokens, p, strict=True) if x > 0.501}
        assert all(any(s["start"] <= a and z <= s["end"] for s in row["spans"]) for a, z in sure)
        assert all(any(s["start"] <= t.start() < s["end"] for t, x in zip(tokens, p, strict=True) if x > 0.499) for s in row["spans"])


def test_toxicity_on_held_out_rows(spark):
    from tests.conftest import DATA

    sf = f"{DATA}/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    labelled = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    made = toxicity.score_toxicity(labelled, labels).cache()
    assert held_out_accuracy(spark, sf, made, "toxic") > 0.97
    for r in made.where("size(spans) > 0").join(docs.select("doc_id", "text"), "doc_id").limit(20).collect():
        assert all(re.fullmatch(r"[^\W\d_].*[^\W\d_]", r["text"][s["start"] : s["end"]], re.S) for s in r["spans"] if s["end"] - s["start"] > 1)


# --- 4 ---


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


ODD = ["", " ", "  b", "a\n b \n", "x   y", "a" * 9000, "-" * 3000, "=x" * 700, "é" * 999, "<|endoftext|> it's", "ab " * 500 + "c" * 9000, "1²½ _x_ 𝔘", "\u2028\u00a0x\x1c y"]


def test_ids_equal_tiktoken(tiktoken_encoding, docs):
    rng = random.Random(1)
    texts = ODD + [r["text"] for r in docs.limit(60).collect()] + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2FFF), rng.randrange(0x1F300, 0x1F700), 9, 10, 32, 32, 97])) for _ in range(200)) for _ in range(150)]
    encode, decode = bpe.encoder(RANKS, P.PATTERN).encode, bpe.decoder(RANKS).decode
    for t in texts:
        ids = np.frombuffer(encode(t), "<u4")
        assert ids.tolist() == tiktoken_encoding.encode_ordinary(t)
        assert "".join(decode(ids)) == t


def test_tables_may_overflow(monkeypatch, tiktoken_encoding):
    monkeypatch.setattr(bpe, "MOST_STATES", 20)
    monkeypatch.setattr(bpe, "MOST_PIECES", 4)
    encode = bpe.Encoder(bpe.read_ranks(RANKS), P.PATTERN).encode
    for t in [*ODD, "some words that are not few and not short either"]:
        assert np.frombuffer(encode(t), "<u4").tolist() == tiktoken_encoding.encode_ordinary(t)


def test_tokens_before_that_fit_alike_share_states():
    """What differs only in a token that fits the same tokens ahead is read on from one state."""
    machine = bpe.Transducer({bytes([b]): b for b in range(256)} | {b"xy": 256, b"zx": 257, b"ab": 258, b"xyz": 259})
    after = {a: machine._read(machine.start, a + b"x", []) for a in (b"a", b"b", b"z", b"ab")}
    assert after[b"a"] is after[b"b"] is after[b"ab"] and after[b"z"] is not after[b"a"]


def merged(ranks, piece):
    """BPE by its definition."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while known := [(ranks[a + b], i) for i, (a, b) in enumerate(pairwise(parts)) if a + b in ranks]:
        i = min(known)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[x] for x in parts]


@pytest.mark.parametrize("few, most", [(16, 10**6), (16, 3), (1, 10**6), (0, 5)])
def test_ids_equal_merges_of_any_vocabulary(monkeypatch, few, most):
    monkeypatch.setattr(bpe, "FEW", few)
    for table in ("MOST_STATES", "MOST_STEPS", "MOST_VERDICTS"):
        monkeypatch.setattr(bpe, table, most)
    rng = random.Random(few + most)
    for _ in range(30):
        ranks = {bytes([b]): i for i, b in enumerate(b"abc")}
        for _ in range(200):
            token = rng.choice([*ranks]) + rng.choice([*ranks])
            if token not in ranks and len(token) < 12 and len(merged(ranks, token)) == 2 and len(ranks) < 60:
                ranks[token] = len(ranks)
        machine = bpe.Transducer(ranks)
        for _ in range(60):
            piece = bytes(rng.choices(b"abc", k=rng.randrange(1, 40)))
            assert machine.encode(piece) == merged(ranks, piece)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=12))
def test_utf8_machine_equals_the_codec(data):
    state = bpe.DONE
    for b in data:
        state = bpe.utf8_step(state, b)
    try:
        data.decode()
        assert state == bpe.DONE
    except UnicodeDecodeError as error:
        assert state != bpe.DONE and (state == bpe.BAD or error.reason == "unexpected end of data")


def test_chunk_pattern_probe():
    assert bpe.Encoder(bpe.read_ranks(RANKS), P.PATTERN).cuts
    assert not bpe.Encoder(bpe.read_ranks(RANKS), r".+").cuts


def test_query_equals_tiktoken(spark, sf, docs, tiktoken_encoding):
    """The query's digests over the whole table are those of the library."""
    got = {r["doc_id"]: r for r in QUERIES["op4_byte_bpe"](spark, sf).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = tiktoken_encoding.encode_ordinary(r["text"] or "")
        row = got[r["doc_id"]]
        assert row["n_tokens"] == len(ids) and row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


@pytest.mark.parametrize("block", [1, 7, 64])
def test_tokens_are_emitted_after_bounded_lookahead(monkeypatch, tiktoken_encoding, block):
    monkeypatch.setattr(bpe, "BLOCK", block)
    machine = bpe.Transducer(bpe.read_ranks(RANKS))
    rng = random.Random(block)
    for n in (0, 1, 5, 300, 3000):
        piece = bytes(rng.choice(b"abcdefgh =-_") for _ in range(n)) + b" " * (n // 3)
        assert machine.encode(piece) == tiktoken_encoding._encode_single_piece(piece) if piece else machine.encode(piece) == []
    written, waiting = [], []
    state, emit = machine.start, machine._emit
    piece = bytes(rng.choice(b"etaoin shrdlu") for _ in range(5000))
    for at in range(0, len(piece), block):
        state = machine._read(state, piece[at : at + block], written)
        emit(written)
        waiting.append(len(written))
    assert max(waiting) <= block + 2 * machine.longest


# --- 5 ---


def brute_lines(docs, t, long_words=50):
    seen, out = set(), {}
    for i, text in sorted(docs.items()):
        lines = text.split("\n")
        own = [k for k, x in enumerate(lines) if x.strip(" \t\r")]
        keys = [lines[k].strip(" \t\r") for k in own]
        gone = set()
        windows = [(j, t, tuple(keys[j : j + t])) for j in range(len(own) - t + 1)]
        windows += [(j, 1, ("long", x)) for j, x in enumerate(keys) if long_words and len([y for y in re.split("[ \t]+", x) if y]) >= long_words]
        windows += [(0, len(own), ("whole", *keys))] * (0 < len(own) < t)
        for j, n, window in windows:
            if window in seen:
                gone |= set(own[j : j + n])
            seen.add(window)
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


@pytest.mark.parametrize("k, w", [(2, 2), (1, 3), (1, 1), (3, 4)])
def test_line_runs_equal_brute_force(spark, k, w):
    rng = random.Random(k * 10 + w)
    long = [" ".join(rng.choice("xyz") for _ in range(n)) for n in (4, 5, 6)]
    docs = {i: "\n".join(rng.choice(["a", "b", " c ", "", "d", "e\r", "f", *long]) for _ in range(rng.randrange(25))) for i in range(80)}
    table = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(table, k=k, w=w, long_words=5).collect()}
    assert got == brute_lines(docs, k + w - 1, 5)


def test_only_places_of_fingerprints_are_written():
    lines = np.random.default_rng(5).integers(0, 1 << 62, 1000).astype(np.uint64)
    fp, at, chosen = linededup.winnow(lines, 2, 4)
    assert len(at) == len(set(at.tolist())) < 600  # of 996 windows
    windows = sorted(p - i for p, c in zip(at.tolist(), chosen.tolist(), strict=True) for i in range(4) if c >> i & 1)
    assert windows == list(range(996))  # each window has one place, inside it


def test_long_lines_and_short_documents(spark):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(1, f"x\n{long}\ny"), (2, f"a\nb\nc\nd\n{long}\ne"), (3, "one line"), (4, "one line"), (5, "two\n\nlines "), (6, "two\nlines"), (7, "two\nlines\nmore"), (8, long[:-4])]
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2] == ("a\nb\nc\nd\ne", 1) and got[4] == ("", 1) and got[6] == ("", 2)
    assert all(got[i] == (t, 0) for i, t in rows if i in (1, 3, 5, 7, 8))


# --- 6 ---


def slow_crc(data):
    c = 0
    for b in data:
        c ^= b << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if c >> 31 else c << 1
    return c


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400))
def test_page_checksum(data):
    assert ogg.checksum(data) == slow_crc(data)


@pytest.mark.parametrize("segments", [1, 2, 7, 255])
def test_packets_survive_any_paging(segments):
    rng = random.Random(segments)
    packets = [rng.randbytes(rng.choice([0, 1, 254, 255, 256, 510, 2000, 70_000])) for _ in range(25)]
    pages = ogg.write_stream(5, packets, list(range(25)), segments)
    assert ogg.demux(b"".join(p for _, p in pages))[5].packets == packets


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 4000, 64_000, 700_000])
def test_payload_round_trip(n):
    payload = ogg.payload_of("é" * n)
    assert len(payload) % 64 == 0 and len(payload) > 0
    back, facts = ogg.read_samples(ogg.mux(payload))
    assert back == payload and facts["seconds"] == pytest.approx(len(payload) / ogg.RATE)


def test_query_equals_brute_force(spark, sf, docs):
    """Every column of the query over the whole table, computed from the texts without the operator's reader."""
    got = {r["doc_id"]: r for r in QUERIES["op6_ogg_media"](spark, sf).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        raw = (r["text"] or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        row, media = got[r["doc_id"]], ogg.mux(payload)
        level = np.frombuffer(payload, np.uint8).astype(float)
        pages = media.count(b"OggS") if b"OggS" not in payload else None
        assert (row["n_bytes"], row["payload_bytes"], row["tail_crc32"]) == (len(raw), len(payload), zlib.crc32(payload[-64:]))
        assert row["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert (row["media_bytes"], row["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        facts = dict(x.split("=") for x in row["feature"].split(" "))
        assert facts["streams"] == "2" and (pages is None or facts["pages"] == str(pages))
        assert abs(float(facts["mean"]) - level.mean()) < 1e-5 and abs(float(facts["deviation"]) - level.std()) < 1e-5
        assert int(facts["crossings"]) == sum(a != b for a, b in zip(level >= 128, (level >= 128)[1:], strict=False))
        assert abs(float(facts["seconds"]) - len(payload) / ogg.RATE) < 1e-5


def test_damage_is_seen_and_skipped():
    media = bytearray(ogg.mux(bytes(range(256)) * 400))
    media[len(media) // 2] ^= 1
    with pytest.raises(ogg.BrokenMedia):
        ogg.read_samples(bytes(media))
    streams = ogg.demux(bytes(media), strict=False)
    assert streams[ogg.SAMPLES].packets[0].startswith(b"Samples") and len(streams[ogg.SAMPLES].packets) < 27


def test_timestamps_count_back():
    assert ogg.timestamps([None, None, 30, None, 50], [10, 10, 10, 10, 10], 10) == [1.0, 2.0, 3.0, 4.0, 5.0]


# --- 7 ---


def test_filters_return_all_languages():
    rng = np.random.default_rng(1)
    grams = {x: rng.integers(0, 1 << 63, 3000).astype(np.uint64) for x in "abc"}
    grams["c"] = np.r_[grams["c"], grams["a"][:100]]
    f = langid.LanguageFilters.fit(grams, 16, (3,))
    assert ((f.containing(grams["a"]) & 1) == 1).all() and ((f.containing(grams["a"][:100]) & 4) == 4).all()
    other = rng.integers(0, 1 << 63, 20_000).astype(np.uint64)
    seen = np.array([((f.containing(other) >> b) & 1).mean() for b in range(3)])
    assert np.allclose(seen, f.rates, atol=0.01)


def test_a_hot_text_does_not_upset_the_sample(spark):
    rare = spark.range(4000).select(F.concat(F.lit("text number "), "id").alias("text"))
    rows = rare.unionByName(spark.range(20_000).select(F.lit("hot").alias("text"))).select("text", F.lit("en").alias("lang"), F.xxhash64("text").alias("key"))
    got = {r["text"]: r["count"] for r in hash_sample(rows, "key", "lang", 1000).groupBy("text").count().collect()}
    assert 850 < len(got) < 1150 and got.get("hot", 20_000) == 20_000


def slow_ngrams(text, sizes):
    words = " ".join(["", *"".join(c if c.isalpha() else " " for c in text.lower()).split(), ""])
    return Counter(words[i : i + n] for n in sizes for i in range(len(words) - n + 1))


def test_languages_equal_exact_sets_of_ngrams(docs):
    """The query's predictions are those of exact sets of the same n-grams, chosen by the stated rule."""
    rows = docs.where("text is not null").collect()
    rest = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 3 for r in rows}
    texts = {(r["lang"], r["text"]) for r in rows if rest[r["doc_id"]] != 1 and r["lang"] is not None}
    counts = defaultdict(Counter)
    for lang, text in texts:
        counts[lang].update(slow_ngrams(text, (2, 3, 4)))
    share = {x: {g: n / c.total() for g, n in c.items()} for x, c in counts.items()}
    sets = {x: {g for g, f in own.items() if f >= 2e-5 and all(f * 8 >= other.get(g, 0) for y, other in share.items() if y != x)} for x, own in share.items()}
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict_languages(docs).collect()}
    wrong = 0
    for r in rows:
        grams = slow_ngrams(r["text"], (2, 3, 4))
        hits = {x: sum(n for g, n in grams.items() if g in own) for x, own in sets.items()}
        if any(c.isalpha() for c in r["text"]):
            wrong += hits[got[r["doc_id"]]] < max(hits.values())
        else:
            assert got[r["doc_id"]] == "und"
    assert wrong <= 1  # a tie that false positives of the filter may turn


def test_languages_on_held_out_rows(docs):
    got = langid.predict_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.count() > 20 and got.where("lang_pred <> lang").count() <= 2


# --- 8 ---


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB é\t\n", max_size=30), max_size=8))
def test_fingerprints_equal_brute_force(texts):
    assert simhash.fingerprints(texts, 4).tolist() == [simhash.fingerprint(t, 4) for t in texts]


def brute_components(fps, bits):
    own = sorted(set(fps))
    parent = {f: f for f in own}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(own):
        for b in own[i + 1 :]:
            if (a ^ b).bit_count() <= bits:
                parent[find(b)] = find(a)
    return {f: find(f) for f in own}


@pytest.mark.parametrize("seed", range(4))
def test_buckets_span_all_links(seed):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(7))) & (1 << 64) - 1 for b in base for _ in range(25)})
    want = brute_components(fps, 4)
    fps_ = np.array(fps, np.uint64)
    links = simhash.link_bucket(fps_, 4, simhash.pivot_distances(fps_))
    assert all((fps[a] ^ fps[b]).bit_count() <= 4 for a, b in links)
    groups = defaultdict(set)
    for f, root in want.items():
        groups[root].add(f)
    assert len(links) == len(fps) - len(groups)


@pytest.mark.parametrize("cell", [4096, 8])
def test_groups_equal_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = random.Random(5)
    fps = []
    for _ in range(15):
        f = rng.getrandbits(64)
        for _ in range(12):
            f ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(7)))  # chains: neighbours are near, ends far
            fps.append(f)
    fps = list(dict.fromkeys(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.link_fingerprints(spark.createDataFrame([(f,) for f in signed], "fp long"), 4, 6).collect()
    got = {f: f for f in signed}

    def find(f):
        while got[f] != f:
            f = got[f]
        return f

    for r in links:
        got[find(r["b"])] = find(r["a"])
    want = brute_components(fps, 4)
    pairs = {frozenset((a, b)) for a in fps for b in fps if want[a] == want[b]}
    back = {f: s for f, s in zip(fps, signed, strict=True)}
    assert pairs == {frozenset((a, b)) for a in fps for b in fps if find(back[a]) == find(back[b])}


def test_pivot_distances_are_those_of_the_jvm(spark):
    fps = [0, 1, (1 << 64) - 1, 0x123456789ABCDEF0, *simhash.REFERENCES.tolist()]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = [list(r[0]) for r in spark.createDataFrame([(f,) for f in signed], "fp long").coalesce(1).select(simhash.coordinates("fp")).collect()]
    assert got == simhash.pivot_distances(np.array(fps, np.uint64)).tolist()
    assert [simhash.slices(n, 4) for n in (0, 10**6, 10**9, 10**11)] == [6, 6, 7, 8]


def test_near_copies_keep_unlike_texts(spark):
    prose = "the quick brown fox jumps over the lazy dog while seven wizards brew potions in the tower of glass by night".split()
    other = [w[::-1] for w in prose]
    a, b, c = " ".join(prose), " ".join(other), " ".join(prose[::-1])
    rows = [(None, a), (None, b), (None, b), (5, c), (5, c.upper()), (6, c), (5, "another text under the same id that is not like the one before at all"), (7, None), (8, ""), (9, "x")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, r int")
    got = sorted(((r["doc_id"], r["text"]) for r in simhash.drop_near_copies(docs).collect()), key=repr)
    fives = [t for i, t in got if i == 5]
    assert len(got) == 6 and [t for i, t in got if i is None] == sorted([a, b]) and len(fives) == 2 and {t.lower() for t in fives} == {c, rows[6][1]}
    assert (7, None) in got and (9, "x") in got and not {6, 8} & {i for i, _ in got}
    assert simhash.drop_near_copies(docs.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "u long, v long")
    got = {r["node"]: r["component"] for r in connected_components(edges, Scratch(spark, "t")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100}
    assert connected_components(edges.limit(0), Scratch(spark, "t")).count() == 0


# --- 9 ---


def test_seeds_are_shared_by_long_stretches():
    rng = np.random.default_rng(2)
    for _ in range(20):
        common = rng.integers(1, 1 << 60, 6 + 16 - 1).astype(np.uint64)
        a = np.r_[rng.integers(1, 1 << 60, 50).astype(np.uint64), common]
        b = np.r_[common, rng.integers(1, 1 << 60, 70).astype(np.uint64)]
        one, two = (set(passages.seeds(x, np.array([0, len(x)]), 6, 16)[0].tolist()) for x in (a, b))
        assert one & two


def slow_chain(segs, k):
    best = []
    for i in np.argsort(segs[:, 0], kind="stable"):
        x0, x1, y0 = segs[i]
        gain = 0.0
        for s, value in best:
            if max(s[0] + 1, s[1] - k + 1) <= x0 and max(s[2] + 1, s[2] + s[1] - s[0] - k + 1) <= y0:
                gain = max(gain, value - passages.GAP_COST * (x0 - s[1] + y0 - (s[2] + s[1] - s[0])))
        best.append(((x0, x1, y0), x1 - x0 + gain))
    return max(v for _, v in best)


def test_chain_scores_equal_the_quadratic_form():
    rng = np.random.default_rng(3)
    for _ in range(40):
        n = rng.integers(2, 14)
        x0, y0 = rng.integers(0, 300, n), rng.integers(0, 300, n)
        segs = np.stack([x0, x0 + rng.integers(6, 60, n), y0], axis=1)
        path = segs[passages.chains(segs, 6)[0]]
        score = sum(path[:, 1] - path[:, 0]) - passages.GAP_COST * sum(b[0] - a[1] + b[2] - (a[2] + a[1] - a[0]) for a, b in zip(path, path[1:], strict=False))
        assert score == pytest.approx(slow_chain(segs, 6))


def test_planted_passages(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    exact, fuzzy = text(60), text(120)
    edited = [w for i, w in enumerate(fuzzy) if i % 40 != 20]
    docs = {1: text(80) + exact + text(50), 2: text(300), 3: text(20) + exact, 4: fuzzy + text(90), 5: text(33) + edited + text(10), 6: exact}
    got = {(r["doc_id"], r["partner"]): r for r in passages.repeated_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in docs.items()], "doc_id long, text string")).collect()}
    assert set(got) == {(3, 1), (6, 1), (5, 4)}
    assert (got[3, 1]["start_word"], got[3, 1]["end_word"], got[3, 1]["partner_start"]) == (20, 80, 80)
    assert 0.9 < got[5, 4]["identity"] < 1 and got[5, 4]["end_word"] - got[5, 4]["start_word"] >= 70


def found_passages(spark, docs):
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in docs.items()], "doc_id long, text string")
    return sorted((r["doc_id"], r["partner"], r["start_word"], r["end_word"]) for r in passages.repeated_passages(table).collect())


def test_passages_with_own_text_between(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    one, two, three = text(100), text(100), text(60)
    docs = {1: one + text(100) + two + text(45) + three, 2: text(7) + one + text(100) + two + text(45) + three}
    assert found_passages(spark, docs) == [(2, 1, 7, 107), (2, 1, 207, 307), (2, 1, 352, 412)]


def test_passages_whose_seeds_are_first_met_elsewhere(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    exact, short = text(60), text(40)
    docs = {1: text(9) + exact[:30] + text(30), 2: text(40) + exact[30:] + text(9), 3: text(20) + exact + text(8), 4: exact + text(50)}
    docs |= {5: text(30) + short[:25] + text(9), 6: text(5) + short[18:] + text(30), 7: text(30) + short + text(30), 8: text(60) + short + text(12)}
    assert found_passages(spark, docs) == [(4, 3, 0, 60), (8, 7, 60, 100)]


def test_passages_scattered_over_earlier_documents(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    docs, want = {}, set()
    for i in range(0, 200, 10):  # three documents hold 38 words each of a passage of 90 that two others hold whole
        own = text(90)
        docs |= {i + j: text(20) + own[a : a + 38] + text(20) for j, a in enumerate((0, 26, 52))}
        docs |= {i + 3: text(15) + own + text(9), i + 4: text(33) + own}
        want.add((i + 4, i + 3, 33, 123))
    assert want <= set(found_passages(spark, docs))


def test_passages_repeated_in_one_document(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    own, near = text(120), text(90)
    changed = [w if i % 12 != 11 else "else" for i, w in enumerate(near)]
    docs = {1: text(10) + own + text(50) + own + text(5), 2: near + text(60) + changed, 3: text(30) + own[:39] + text(20) + own[:39]}
    got = found_passages(spark, docs)
    assert (1, 1, 180, 300) in got and [x[:2] for x in got].count((2, 2)) == 1 and all(x[1] <= x[0] for x in got) and len(got) == 2


def test_rows_that_share_an_id_are_one_document(spark):
    rng = random.Random(10)
    one, two = " ".join(f"a{rng.random()}" for _ in range(80)), " ".join(f"b{rng.random()}" for _ in range(80))
    table = spark.createDataFrame([(1, one), (1, one), (2, two), (3, one), (3, one), (4, two), (None, one), (5, None)], "doc_id long, text string")
    got = [tuple(r)[:6] for r in passages.repeated_passages(table).collect()]
    assert sorted(got) == [(3, 1, 0, 80, 0, 80), (4, 2, 0, 80, 0, 80)]
    mixed = spark.createDataFrame([(1, one), (1, two), (2, one), (3, two)], "doc_id long, text string")
    assert len(passages.repeated_passages(mixed).collect()) == 1


@pytest.mark.parametrize("period, n", [(1, 60), (3, 61), (7, 300), (15, 60), (20, 200)])
def test_passages_that_repeat_a_phrase(spark, period, n):
    rng = random.Random(period)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    run = (text(period) * n)[:n]
    assert found_passages(spark, {1: text(50) + run + text(50), 2: text(70) + run + text(20)}) == [(2, 1, 70, 70 + n)]


def test_changed_passages_whose_seeds_are_first_met_elsewhere(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    own, docs = text(60), {}
    for i in range(56):  # each run of five words stands alone in an unrelated document, a few of them in several
        docs |= {i * 3 + j: text(20) + own[i : i + 5] + text(20) for j in range(1 + i % 3)}
    docs[1000] = text(30) + own + text(30)
    docs[1001] = text(40) + [rng.choice(words) if j % 10 == 9 else x for j, x in enumerate(own)] + text(20)
    assert [(d, p) for d, p, _, _ in found_passages(spark, docs)] == [(1001, 1000)]


@pytest.mark.parametrize("n, every, share", [(60, 6, None), (120, 6, None), (60, None, 0.1), (60, None, 0.15), (120, None, 0.15)])
def test_recall_of_changed_passages(spark, n, every, share):
    rng = random.Random(n)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    docs = {}
    for i in range(100):
        own = text(n)
        gone = range(every - 1, n, every) if every else rng.sample(range(n), round(n * share))
        changed = [rng.choice(words) if j in gone else x for j, x in enumerate(own)]
        docs |= {i: text(50) + own + text(50), 1000 + i: text(70) + changed + text(30)}
    got = {(a, b) for a, b, _, _ in found_passages(spark, docs)}
    assert len(got & {(1000 + i, i) for i in range(100)}) >= 97 and all(a - 1000 == b for a, b in got)


def common(a, b):
    """Longest common subsequence of two word lists."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_rows_are_passages(docs):
    """Each row's spans lie in the texts and are as similar as it says, by the quadratic form."""
    words = {r["doc_id"]: [x for x in (w.strip(passages._EDGE).lower() for w in (r["text"] or "").split()) if x] for r in docs.collect()}
    found = passages.repeated_passages(docs).collect()
    assert found
    for r in found:
        a, b = words[r["doc_id"]][r["start_word"] : r["end_word"]], words[r["partner"]][r["partner_start"] : r["partner_end"]]
        assert len(a) == r["end_word"] - r["start_word"] >= 40 and len(b) == r["partner_end"] - r["partner_start"] >= 40
        assert r["partner"] < r["doc_id"] or r["partner"] == r["doc_id"] and r["partner_end"] <= r["start_word"]
        assert r["identity"] >= 0.8
        if len(a) * len(b) < 200_000:
            assert common(a, b) / max(len(a), len(b)) >= r["identity"] - 1e-9


def test_repeats_equal_brute_force(docs):
    k, first, want = 50, {}, set()
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        words = [x for x in (w.strip(passages._EDGE).lower() for w in r["text"].split()) if x]
        for p in range(len(words) - k + 1):
            if first.setdefault(tuple(words[p : p + k]), r["doc_id"]) != r["doc_id"]:
                want.add(r["doc_id"])
    assert want and want <= {r["doc_id"] for r in passages.repeated_passages(docs).collect()}


# --- 10 ---


def test_quality_on_held_out_rows(spark):
    from tests.conftest import DATA

    sf = f"{DATA}/sf0.01"
    made = quality.score_quality(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    assert held_out_accuracy(spark, sf, made, "quality") > 0.95


def test_scores_equal_the_plain_network(spark, sf, docs):
    """The query's scores, recomputed word by word from the fitted numbers."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    net = fit_in_one_task(labelled_sample(docs, labels, "quality", "doc_id", "text", 5, 0, 3000), quality.fit_network)
    got = {r["doc_id"]: r for r in QUERIES["op10_quality"](spark, sf).collect()}
    for r in docs.where("doc_id % 5 = 0").collect():
        total, words = np.zeros(quality.DIM), (r["text"] or "").split()
        seen, last = set(), None
        for word in words:
            stem = "".join(c for c in word.lower() if c.isalpha())
            for feature in (xxhash.xxh64_intdigest(stem) % quality.LEXICAL, quality.LEXICAL + xxhash.xxh64_intdigest(quality.shape(word)) % quality.SHAPES):
                total += net.vectors[feature]
            total += net.vectors[quality.AGAIN] * (word == last) + net.vectors[quality.SEEN] * (word in seen and len(stem) > 3)
            seen.add(word)
            last = word
        hidden = np.tanh((total / max(1, len(words)) - net.mean) / net.scale @ net.w1 + net.b1)
        want = 1 / (1 + np.exp(-(hidden @ net.w2 + net.b2) / net.temperature))
        assert abs(got[r["doc_id"]]["score"] - want) < 1e-3 and got[r["doc_id"]]["predicted"] == (got[r["doc_id"]]["score"] >= 0.3)


def test_marks_of_repeated_words():
    owner, lexical, shapes, marks = quality.document_features(["Aaaa aaaa aaaa bbbb", "", "x y x"])
    assert marks[:, 0].tolist() == [1, 0, 0] and marks[:, 1].tolist() == [1, 0, 0] and len(owner) == len(lexical) == len(shapes) == 7
    assert quality.shape("Ered***") == "Aa*" and regex.fullmatch(r"\p{L}9", quality.shape("b12"))
