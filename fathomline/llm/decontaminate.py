"""Benchmark decontamination by canonical templates.

Words become template tokens: numbers, names (capitalised words) and units turn into
typed placeholders, other words are lower-cased and stripped of punctuation. Windows
of five tokens are hashed, and those of the documents are joined with those of the
benchmark items. Two templates are used side by side, with and without name placeholders,
so both renamed questions and copies in other letter case are met. Windows dense in
numbers and units, of which the placeholders would leave too little, are compared as they
are, so such items are met where they are copied, not with other parameters; items of
one or two tokens are met where a document consists of them. Where windows of one item
crowd together, the slots are compared: each value of the item must stand for one value
of the document throughout, as in a question asked again with other parameters.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.arrow import only_tables_of, text_chunks, worker_table
from fathomline.llm.scratch import Scratch
from fathomline.llm.sieve import bit_filter, has_bit, row_key, sift
from fathomline.shipping import ship

LITERAL, NAME, NUMBER, UNIT, NOTHING, SEVERAL = range(6)
#: Units and number words that count as such.
UNITS = frozenset("% $ € £ mm cm m km in ft yd mi mile miles g kg mg lb lbs oz t ton tons ml l litre litres liter liters ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years usd eur dollar dollars euro euros cent cents pound pounds percent degree degrees".split())
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
TEMPLATES = UNNAMED, NAMED, VERBATIM = range(3)
WHOLE = 3  # all tokens of a text, as they are
SIZE, LITERALS = 5, 3  # tokens of a window, and how many of them must be no placeholder
SHORTEST = 3  # items below so many tokens cannot be told from ordinary text; they are met as whole documents only
MOST_WORDS = 400_000
#: Slots of the filter of the benchmark's windows; its size is fixed (8 MB), and what passes it is joined.
SLOTS = 1 << 26
_NUMBER = re.compile(r"[+-]?\d[\d.,:/]*")
_PARTS = re.compile(r"[$€£%]|[+-]?\d[\d.,:/]*|[^\W\d]+(?:['’-][^\W\d]+)*")
_COMPOUND = re.compile(r"[\d$€£%]")
_EDGE = "".join(chr(c) for c in range(33, 128) if not chr(c).isalnum() and chr(c) not in "%$") + "“”‘’«»…–—¿¡"


class Tokens(dict):
    """A word's template token packed into one integer: hash of its value and kind."""

    def __missing__(self, word: str) -> int:
        core = word.strip(_EDGE)
        low = core.lower()
        if not core:
            made = NOTHING
        else:
            if low in NUMBER_WORDS or _NUMBER.fullmatch(core.rstrip(".,:")):
                kind = NUMBER
            elif low in UNITS:
                kind = UNIT
            elif _COMPOUND.search(core) and len(_PARTS.findall(core)) > 1:
                kind = SEVERAL
            elif len(core) > 1 and core[0].isupper() and core[1:].islower():
                kind = NAME
            else:
                kind = LITERAL
            made = xxhash.xxh64_intdigest(low) >> 4 << 3 | kind
        if len(self) >= MOST_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = made
        return made


_tokens = worker_table("decontaminate", Tokens())
#: Units that stand ahead of their number.
_AHEAD = np.array([xxhash.xxh64_intdigest(x) >> 4 for x in ("$", "€", "£", "usd", "eur")], np.uint64)
#: Hashes of the placeholders, by kind.
_HOLDERS = np.array([0, *[xxhash.xxh64_intdigest(f"<{k}>") for k in ("name", "number", "unit")]], np.uint64)


def chunk_tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Packed tokens of all texts end to end, and where each text begins (one more entry at the end).

    Words without letters, digits or units are left out; a unit counts as one after
    a number only, a currency also ahead of it (so not the word "in").
    """
    split = [t.split() for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    get = _tokens.__getitem__
    packed = np.fromiter(map(get, chain.from_iterable(split)), np.uint64, int(sizes.sum()))
    mixed = np.flatnonzero((packed & np.uint64(7)) == SEVERAL)
    if len(mixed):
        ends = np.cumsum(sizes)
        pieces, done = [], 0
        for i in np.unique(np.searchsorted(ends, mixed, "right")).tolist():
            parts = [p for w in split[i] for p in (_PARTS.findall(w) if get(w) & 7 == SEVERAL else (w,))]
            pieces += [packed[done : ends[i] - sizes[i]], np.fromiter(map(get, parts), np.uint64, len(parts))]
            done = ends[i]
            sizes[i] = len(parts)
        packed = np.concatenate([*pieces, packed[done:]])
    keep = (packed & np.uint64(7)) != NOTHING
    kept = np.r_[0, np.cumsum(keep)]
    packed, starts = packed[keep], kept[np.r_[0, np.cumsum(sizes)]]
    units = np.flatnonzero((packed & np.uint64(7)) == UNIT)
    if len(units):
        number = np.r_[(packed & np.uint64(7)) == NUMBER, False]
        text = np.searchsorted(starts, units, "right") - 1
        after = number[units - 1] & (units > starts[text])
        ahead = number[units + 1] & (units + 1 < starts[text + 1]) & np.isin(packed[units] >> np.uint64(3), _AHEAD)
        beside = after | ahead
        packed[units[~beside]] -= np.uint64(UNIT - LITERAL)
    return packed, starts


def template_tokens(text: str) -> np.ndarray:
    """Packed tokens of one text."""
    return chunk_tokens([text])[0]


def _windows(packed: np.ndarray, size: int, template: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the window that begins at each token, and whether it counts in the template.

    A window needs enough words that are no placeholder; in the template VERBATIM
    those count that lack them (without names as placeholders), as they are; in the
    template WHOLE all.
    """
    kind = (packed & np.uint64(7)).astype(np.int8)
    held = (kind == NUMBER) | (kind == UNIT)
    if template == WHOLE:
        held[:] = False
    if template == NAMED:
        held |= kind == NAME
    token = packed >> np.uint64(3)
    if template in (UNNAMED, NAMED):
        token[held] = _HOLDERS[kind[held]]
    n = len(packed) - size + 1
    h = np.full(n, size * 4 + template, np.uint64)
    for i in range(size):
        h *= np.uint64(0x9FB21C651E98DF25)
        h += token[i : i + n]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    free = np.zeros(len(packed) + 1, np.int32)
    np.cumsum(~held, out=free[1:])
    enough = free[size:] - free[:-size] >= min(LITERALS, size - 1)
    return h, ~enough if template == VERBATIM else np.ones(n, bool) if template == WHOLE else enough


def text_windows(packed: np.ndarray, starts: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, hash, place) of the windows of texts laid end to end: of each size in all templates, and short texts as a whole."""
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    for size in sizes:
        if len(packed) < size:
            continue
        inside = owner[: len(packed) - size + 1] == owner[size - 1 :]
        if size >= SHORTEST:
            for template in TEMPLATES:
                h, good = _windows(packed, size, template)
                yield size, h, np.flatnonzero(good & inside)
        else:
            at = starts[:-1][np.diff(starts) == size]
            yield size, _windows(packed, size, WHOLE)[0], at


def item_windows(packed: np.ndarray) -> Iterator[tuple[int, int]]:
    """(hash, place) of the windows of one item."""
    for _, h, at in text_windows(packed, np.array([0, len(packed)]), [min(SIZE, len(packed))] if len(packed) else []):
        yield from zip(h[at].tolist(), at.tolist(), strict=True)


def slot_consistency(item: np.ndarray, doc: np.ndarray) -> float:
    """Share of slots whose value maps as it mostly does, one to one, kind by kind."""
    kinds = (item & 7).astype(int)
    slots = np.flatnonzero((kinds != LITERAL) & (kinds == (doc & 7)))
    if not len(slots):
        return 1.0
    pairs = Counter(zip(item[slots].tolist(), doc[slots].tolist(), strict=True))
    there, back, good = set(), set(), 0
    for (a, b), n in sorted(pairs.items(), key=lambda x: (-x[1], x[0])):  # the most frequent pairs first
        if a not in there and b not in back:
            there.add(a)
            back.add(b)
            good += n
    return good / len(slots)


def instances(p: np.ndarray, a: np.ndarray, part: np.ndarray, n: int) -> list[np.ndarray]:
    """Hits of a part (by place in the text) in chains that go forward in the item and in the text."""
    chains: list[list[int]] = []
    near: list[list[int]] = []
    seen = set()
    for i in part.tolist():
        here = int(p[i]), int(a[i])
        if here in seen:  # several templates
            continue
        seen.add(here)
        near = [c for c in near if a[i] - a[c[-1]] <= n]
        fit = [(abs(int(a[i] - p[i] - a[c[-1]] + p[c[-1]])), -j) for j, c in enumerate(near) if p[c[-1]] < p[i] and a[c[-1]] < a[i]]
        shift, j = min(fit, default=(n, 0))
        if shift <= n // 2:
            near[-j].append(i)
        else:
            chains.append([i])
            near.append(chains[-1])
    return [np.array(c) for c in chains]


def judge(p: np.ndarray, a: np.ndarray, n: int, item: np.ndarray, doc: np.ndarray, coverage: float, run: int, consistency: float) -> tuple[float, int, float, int, int] | None:
    """The best instance of an item of ``n`` tokens in a text: (coverage, run, consistency, start, end), or None.

    ``p`` and ``a``: places in the item and in the text of the windows in common;
    ``item`` and ``doc``: their tokens, one row for each. Where the slots of all hits that stand
    close together are not consistent, each instance of the item is judged by itself.
    """
    size = item.shape[1]
    order = np.lexsort((p, a))
    p, a, item, doc = p[order], a[order], item[order], doc[order]
    best = None
    parts = np.split(np.arange(len(p)), np.flatnonzero(np.diff(a) > n) + 1)
    apart: list[np.ndarray] = []
    single = False
    while parts:
        part = parts.pop(0)
        covered = np.zeros(n + 1, np.int64)
        for i in range(size):
            covered[p[part] + i] = 1
        edges = np.flatnonzero(np.diff(np.r_[0, covered]))
        longest = int((edges[1::2] - edges[::2]).max())
        share = float(covered.sum() / n)
        if share >= coverage or longest >= run:
            shift = np.arange(size)
            places = ((p[part, None] + shift) << 32 | (a[part, None] + shift)).ravel()
            once = np.unique(places, return_index=True)[1]
            agree = slot_consistency(item[part].ravel()[once], doc[part].ravel()[once])
            if agree < consistency and not single:
                apart += instances(p, a, part, n)
            if agree >= consistency and (best is None or share > best[0]):
                best = share, longest, agree, int(a[part].min()), int(a[part].max()) + size
        if not parts and not single:
            parts, single = apart, True
    return best


def find_leaks(text: str, items: list[tuple[object, str]], coverage: float = 0.5, run: int = 13, consistency: float = 0.8) -> list[object]:
    """Ids of the items that one text leaks: the same search without Spark, for single texts."""
    doc = template_tokens(text)
    out = []
    for item_id, value in items:
        item = template_tokens(value)
        size = min(SIZE, len(item))
        of: dict[int, list[int]] = {}
        for h, q in item_windows(item):
            of.setdefault(h, []).append(q)
        found = sorted({(q, b) for _, h, at in text_windows(doc, np.array([0, len(doc)]), [size] if size else []) for b in at.tolist() for q in of.get(int(h[b]), ())})
        if found:
            p, a = np.array(found).T
            shift = np.arange(size)
            if judge(p, a, len(item), item[p[:, None] + shift], doc[a[:, None] + shift], coverage, run, consistency):
                out.append(item_id)
    return out


def _bank_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tid, text) to windows of items, with their raw tokens."""
    only_tables_of("decontaminate")
    for part, texts in text_chunks(batches, "text"):
        rows: list[tuple] = []
        for tid, text in zip(part.column(0).to_pylist(), texts, strict=True):
            item = template_tokens(text)
            size = min(SIZE, len(item))
            rows += [(h - (h >> 63 << 64), tid, at, len(item), size, item[at : at + size].tobytes()) for h, at in item_windows(item)]
        if rows:
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["h", "tid", "p", "n", "size", "item"])


def _document_windows(shared, sizes: list[int]):
    """Rows (id, th, text) to the windows that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_tables_of("decontaminate")
        wanted = shared.value
        for part, texts in text_chunks(batches, "text"):
            packed, starts = chunk_tokens(texts)
            for size, h, at in text_windows(packed, starts, sizes):
                at = at[has_bit(wanted, (h[at] >> np.uint64(38)).astype(np.int64))]
                if not len(at):
                    continue
                text = np.searchsorted(starts, at, "right") - 1
                owner, tokens = pa.array(text), packed[at[:, None] + np.arange(size)].tobytes()
                step = size * 8
                yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), part.column(0).take(owner), part.column(1).take(owner), pa.array((at - starts[text]).astype(np.int32)), pa.array([tokens[i : i + step] for i in range(0, len(tokens), step)], pa.binary())], names=["h", "id", "th", "a", "doc"])

    return run


def _judge_groups(coverage: float, run: int, consistency: float):
    """Rows (id, th, tid, p, a, n, item, doc) sorted by the first three to leaks."""
    names = ["id", "th", "tid", "coverage", "run", "consistency", "start_token", "end_token"]

    def judged(hits: dict[tuple[int, int], tuple[bytes, bytes]], n: int) -> tuple | None:
        p, a = np.array(list(hits)).T
        item, doc = (np.frombuffer(b"".join(x), np.uint64).reshape(len(hits), -1) for x in zip(*hits.values(), strict=True))
        return judge(p, a, n, item, doc, coverage, run, consistency)

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, hits, length, kind = None, {}, 0, None
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            kinds = [kind, pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.float64(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for part in batches:
            kind = part.schema.field(0).type
            for *now, p, a, n, item, doc in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if now != key:
                    if hits and (made := judged(hits, length)):
                        rows.append((*key, *made))
                    key, hits, length = now, {}, n
                hits[p, a] = item, doc  # the templates and repeated rows give a place again
            if len(rows) > 5000:
                yield batch()
                rows = []
        if hits and (made := judged(hits, length)):
            rows.append((*key, *made))
        if rows:
            yield batch()

    return run_


def _leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, coverage: float, run: int, consistency: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``(id, th, tid, coverage, run, consistency, start_token, end_token)`` and the items ``(item, tid)``; ``tid``: hash of an item's text."""
    spark = docs.sparkSession
    ship(spark)
    key, th = row_key(doc_id, text)
    source = docs.where(F.col(f"`{text}`").isNotNull()).select(key.alias("id"), th.alias("th"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    given = benchmark.where(F.col(f"`{item_text}`").isNotNull()).select(F.col(f"`{item_id}`").alias("item"), F.xxhash64(F.col(f"`{item_text}`").cast("string")).alias("tid"), F.col(f"`{item_text}`").cast("string").alias("text"))
    texts = given.groupBy("tid").agg(F.min("text").alias("text"))
    bank = scratch.save(texts.mapInArrow(_bank_windows, "h long, tid long, p int, n int, size int, item binary"))
    sizes = sorted(r[0] for r in bank.select("size").distinct().collect())  # 1 to SIZE
    wanted = spark.sparkContext.broadcast(bit_filter(bank.select(F.shiftrightunsigned("h", 38).alias("s")), SLOTS))
    met = source.mapInArrow(_document_windows(wanted, sizes), f"h long, id {kind}, th long, a int, doc binary")
    # Both sides are plain exchanges, so that a hot window can be split; merged at every size, as no side has a bound.
    hits = met.join(bank.hint("merge"), "h").select("id", "th", "tid", "p", "a", "n", "item", "doc")
    grouped = hits.repartition("id", "th", "tid").sortWithinPartitions("id", "th", "tid")
    schema = f"id {kind}, th long, tid long, coverage double, run int, consistency double, start_token int, end_token int"
    return scratch.save(grouped.mapInArrow(_judge_groups(coverage, run, consistency), schema)), given.select("item", "tid").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", coverage: float = 0.5, run: int = 13, consistency: float = 0.8) -> DataFrame:
    """``(doc_id, item_id, coverage, run, consistency, start_token, end_token)``: one row for each leak.

    A document leaks an item when windows in common cover at least ``coverage`` of
    the item's tokens, or ``run`` tokens on end, near each other, with slots that are
    consistent; of several instances the one that covers most is given. An item of one or two
    tokens leaks where it is all of a document. The windows of both sides are joined by their hash;
    of the benchmark a filter of fixed size reaches the driver, nothing else. Null and
    empty texts and items leak nothing; very long texts are read whole; rows with equal id and
    text are one document, rows with one id and different texts several; items with
    equal texts leak together; null ids pass through; empty tables give no rows; other
    columns are ignored.
    """
    leaks, items = _leaks(docs, benchmark, doc_id, text, item_id, item_text, coverage, run, consistency, Scratch(docs.sparkSession, "leaks"))
    return leaks.join(items, "tid").select(F.col("id").alias(doc_id), F.col("item").alias(item_id), "coverage", "run", "consistency", "start_token", "end_token")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", coverage: float = 0.5, run: int = 13, consistency: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that leak no item, with all their columns; only rows that may leak are shuffled.

    Rules and cases are those of ``decontaminate``; rows with a null text stay.
    """
    scratch = Scratch(docs.sparkSession, "leaks")
    leaks, _ = _leaks(docs, benchmark, doc_id, text, item_id, item_text, coverage, run, consistency, scratch)
    named = leaks.select(F.col("id").alias("_id"), F.col("th").alias("_th")).distinct()
    maybe, clean = sift(docs, doc_id, text, leaks.select("id", "th"), scratch)
    stays = maybe.join(named.hint("merge"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left_anti")
    return clean.select("r").unionByName(stays.select("r")).select(*[F.col("r").getField(c).alias(c) for c in docs.columns])
