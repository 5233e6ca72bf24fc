"""SimHash near-duplicates linked through pivot distance tables.

Fingerprints are 64-bit majorities of shingle hashes. Two fingerprints link when
they differ in at most ``max_bits`` bits. Candidates meet in exact pigeonhole
buckets: of ``blocks`` slices of the fingerprint at least ``blocks - max_bits``
agree in a linked pair, so each choice of that many slices is one table. The Hamming
distances of every distinct fingerprint to the reference fingerprints are computed
once, before, and travel with it: a pair whose coordinates differ by more than
``max_bits`` anywhere cannot link (triangle inequality), and only the survivors are
compared bit by bit.

A bucket reports a spanning forest of its links, never all pairs, so a family of
near copies costs rows in proportion to its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.arrow import map_texts
from fathomline.llm.components import connected_components
from fathomline.llm.scratch import Scratch
from fathomline.llm.sieve import row_key, sift

SEED = 42
#: Fixed reference fingerprints of the distance table, from a hash of 0, 1, 2 ...
REFERENCES = np.array([xxhash.xxh64_intdigest(f"pivot {i}", SEED) for i in range(16)], np.uint64)
#: Members that a bucket of random fingerprints has on average, at most; more of them get longer keys.
MEMBERS = 64
#: Fingerprints that meet in one cell of a bucket; larger buckets are cut into cells.
CELL = 4096


def fingerprint(text: str, width: int) -> int:
    """Brute-force form for tests and single texts."""
    words = text.encode().lower().split()
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), SEED) for i in range(max(1, len(words) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def fingerprints(texts: list[str], width: int) -> np.ndarray:
    """Fingerprints (unsigned) of a chunk of texts."""
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    digest = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        words = text.encode().lower().split()
        n = len(words)
        if not n:
            continue
        joined = b" ".join(words)
        if n <= width:
            hashes.append(digest(joined, SEED))
            counts[i] = 1
            continue
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = [0, *(ends[: n - width] + 1).tolist()]
        hashes += [digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)]
        counts[i] = n - width + 1
    out = np.zeros(len(texts), np.uint64)
    own = np.flatnonzero(counts)
    if len(own):
        bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at = 0
        major = np.empty((len(own), 64), bool)
        for k, n in enumerate(counts[own].tolist()):
            major[k] = 2 * bits[at : at + n].sum(axis=0, dtype=np.int32) > n
            at += n
        out[own] = np.packbits(major, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def bits_between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def pivot_distances(fps: np.ndarray) -> np.ndarray:
    """Rows of the distance table, as ``coordinates`` computes them in the JVM."""
    return bits_between(fps[:, None], REFERENCES[None, :]).astype(np.int16)


def coordinates(fp: str) -> Column:
    """Distances of a fingerprint to all references, a byte each."""
    signed = [int(x) - (1 << 64 if x >> 63 else 0) for x in REFERENCES.tolist()]
    return F.unhex(F.concat(*[F.lpad(F.hex(F.bit_count(F.col(fp).bitwiseXOR(F.lit(x)))), 2, "0") for x in signed]))


def link_bucket(fps: np.ndarray, max_bits: int, table: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest (index pairs) of the links among distinct fingerprints.

    ``table``: their distances to the references. Local pivots come first: the first fingerprint not yet taken becomes a centre
    and takes all within ``max_bits`` of it. Members of two centres are compared
    only where the centres are near enough and not yet joined, and only those pairs
    whose rows of the distance table differ by at most ``max_bits`` everywhere.
    """
    free, links, stars = np.arange(len(fps)), [], []
    while len(free):
        centre = free[0]
        maybe = (np.abs(table[free] - table[centre]) <= max_bits).all(axis=1)
        near = np.zeros(len(free), bool)
        near[maybe] = bits_between(fps[free[maybe]], fps[centre]) <= max_bits
        own = free[near]
        stars.append(own)
        links += [(int(centre), int(x)) for x in own[1:]]
        free = free[~near]
    if len(stars) == 1:
        return links
    parent = list(range(len(stars)))
    centres = np.array([s[0] for s in stars])
    wide = np.array([0 if len(s) == 1 else max_bits for s in stars])
    for a in range(len(stars) - 1):
        rest = centres[a + 1 :]
        reach = max_bits + wide[a] + wide[a + 1 :]
        close = (np.abs(table[rest] - table[centres[a]]) <= reach[:, None]).all(axis=1)
        at = np.flatnonzero(close)
        at = at[bits_between(fps[rest[at]], fps[centres[a]]) <= reach[at]]
        for b in (at + a + 1).tolist():
            ra, rb = _find(parent, a), _find(parent, b)
            if ra == rb:
                continue
            for x in stars[a]:
                ok = (np.abs(table[stars[b]] - table[x]) <= max_bits).all(axis=1)
                ys = stars[b][ok]
                ys = ys[bits_between(fps[ys], fps[x]) <= max_bits]
                if len(ys):
                    links.append((int(x), int(ys[0])))
                    parent[rb] = ra
                    break
    return links


def _link_buckets(max_bits: int):
    """A mapInArrow function over rows (key, cell, fp, coordinates) sorted by bucket: links of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def flush(keys: np.ndarray, cells: np.ndarray, fps: np.ndarray, tables: np.ndarray) -> pa.RecordBatch | None:
            edge = np.flatnonzero((keys[1:] != keys[:-1]) | (cells[1:] != cells[:-1])) + 1
            starts, ends = np.r_[0, edge], np.r_[edge, len(keys)]
            several = ends - starts > 1
            # Buckets of two, most of them, at once; the same two tests as in the larger ones.
            two = starts[ends - starts == 2]
            near = two[(np.abs(tables[two] - tables[two + 1]) <= max_bits).all(axis=1)]
            near = near[bits_between(fps[near], fps[near + 1]) <= max_bits]
            left, right = [fps[near]], [fps[near + 1]]
            for s, e in zip(starts[several].tolist(), ends[several].tolist(), strict=True):
                if e - s > 2:
                    own, at = np.unique(fps[s:e], return_index=True)
                    pairs = link_bucket(own, max_bits, tables[s:e][at])
                    left.append(own[[a for a, _ in pairs]])
                    right.append(own[[b for _, b in pairs]])
            a, b = np.concatenate(left), np.concatenate(right)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"]) if len(a) else None

        for batch in batches:
            if not batch.num_rows:
                continue
            table = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, len(REFERENCES)).astype(np.int16)
            fresh = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64), table]
            held = fresh if held is None else [np.concatenate(x) for x in zip(held, fresh, strict=True)]
            keys, cells = held[0], held[1]
            last = int(np.argmax((keys == keys[-1]) & (cells == cells[-1])))
            if last:
                if (out := flush(*[x[:last] for x in held])) is not None:
                    yield out
                held = [x[last:] for x in held]
        if held is not None and (out := flush(*held)) is not None:
            yield out

    return run


def slices(n: int, max_bits: int) -> int:
    """How many slices ``n`` distinct fingerprints need so that the buckets of random ones have few members; any number finds all links."""
    blocks = max_bits + 2
    while blocks < 16 and n / 2.0 ** (64 * (blocks - max_bits) / blocks) > MEMBERS:
        blocks += 1
    return blocks


def bucket_tables(blocks: int, max_bits: int) -> list[tuple[int, ...]]:
    """The choices of slices of which a linked pair has at least one equal."""
    return list(combinations(range(blocks), blocks - max_bits))


def link_fingerprints(fps: DataFrame, max_bits: int, blocks: int) -> DataFrame:
    """``(a, b)`` links that span every component of the distinct ``fps(fp)``.

    Buckets above ``CELL`` fingerprints are cut into chunks; every two chunks meet in
    a cell of their own, so no task holds a whole hot bucket and no link is lost.
    """
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    part = [F.shiftrightunsigned("fp", edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1)) for i in range(blocks)]
    width = max(edges[i + 1] - edges[i] for i in range(blocks))
    options = []
    for n, choice in enumerate(bucket_tables(blocks, max_bits)):
        key = F.lit(n).cast("long")
        for i in choice:
            key = F.shiftleft(key, width).bitwiseOR(part[i])
        options.append(key)
    keyed = fps.select("fp", coordinates("fp").alias("far")).select("fp", "far", F.explode(F.array(*options)).alias("key"))
    hot = keyed.groupBy("key").count().where(F.col("count") > CELL).select("key", F.ceil(F.col("count") * 2 / CELL).cast("int").alias("chunks"))
    cut = keyed.join(hot, "key", "left")
    mine = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    other = F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cells = cut.select("key", "fp", "far", F.coalesce(mine, F.lit(0)).alias("c"), other.alias("o")).select("key", (F.least("c", "o").cast("long") * F.lit(1 << 31) + F.greatest("c", "o")).alias("cell"), "fp", "far")
    placed = cells.repartition("key", "cell").sortWithinPartitions("key", "cell")
    return placed.mapInArrow(_link_buckets(max_bits), "a long, b long").distinct()


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, max_bits: int = 4, blocks: int | None = None) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``: one row for each input row.

    Null and empty texts have fingerprint zero and link like any other; texts below
    ``width`` words are one shingle; repeated rows give repeated results; rows with a
    null id get the smallest id of their component, or null if no row in it has any; an empty
    table gives an empty one. Ties: the smallest id names a component. Other columns
    of the input are ignored.
    """
    own, of = _grouped(docs, doc_id, text, width, max_bits, blocks, Scratch(docs.sparkSession, "simhash"))
    return own.join(of, "fp").select(F.col("id").alias(doc_id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _grouped(docs: DataFrame, doc_id: str, text: str, width: int, max_bits: int, blocks: int | None, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``(id, th, fp)`` of each row, and ``(fp, component, component_id)`` of each fingerprint; ``component``: the least fingerprint, always there."""
    key, th = row_key(doc_id, text)
    source = docs.select(key.alias("id"), th.alias("th"), F.col(f"`{text}`").alias("text"))
    own = scratch.save(map_texts(source, ["id", "th"], "text", "fp long", lambda texts: {"fp": fingerprints(texts, width).view(np.int64)}))
    reps = scratch.save(own.groupBy("fp").agg(F.min("id").alias("rep")))
    links = link_fingerprints(reps.select("fp"), max_bits, blocks or slices(reps.count(), max_bits))
    parts = scratch.save(connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch))
    placed = reps.join(parts, reps["fp"] == parts["node"], "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    least = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    return own, scratch.save(placed.join(least, "component").select("fp", "component", "component_id"))


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, max_bits: int = 4, blocks: int | None = None) -> DataFrame:
    """The frame with one row of each group of linked fingerprints: that of the smallest id, then text hash.

    Null ids come last, so a row without an id stays only where its group has no
    other. Ids tell no groups apart: unlike texts that share an id, or have none, all
    stay. Of repeated rows one stays. Null and empty texts and such without a word
    are one group; very long texts are read whole; an empty table gives an empty one;
    all columns are kept.
    """
    scratch = Scratch(docs.sparkSession, "near")
    own, of = _grouped(docs, doc_id, text, width, max_bits, blocks, scratch)
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "th")
    named = scratch.save(own.join(of.select("fp", "component"), "fp").select("id", "th", "component"))
    # A written table, so that a hot group can be split in the join below.
    first = scratch.save(named.groupBy("component").agg(F.min(rank).alias("first"), F.max(rank).alias("last"), F.count("*").alias("n")).where("n > 1").select("component", "first"))
    several = scratch.save(named.join(first.hint("merge"), "component").select("id", "th", F.struct("id", "th").eqNullSafe(F.struct("first.id", "first.th")).alias("stays")))
    # Rows of groups of one pass by. Of the rest those go that are not first; repeated rows that are first shrink to one.
    maybe, alone = sift(docs, doc_id, text, several.select("id", "th"), scratch)
    listed = several.groupBy("id", "th").agg(F.max("stays").alias("stays")).select(F.col("id").alias("_id"), F.col("th").alias("_th"), "stays")
    joined = maybe.join(listed.hint("merge"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left")
    once = joined.where("stays").groupBy("id", "th").agg(F.first("r").alias("r")).select("r")
    rest = joined.where("stays is null").select("r").unionByName(alone.select("r")).unionByName(once)
    return rest.select(*[F.col("r").getField(c).alias(c) for c in docs.columns])
