"""Line deduplication by winnowing.

A document is the sequence of its lines that are not blank. Grams of ``k`` lines are
hashed and of every ``w`` neighbouring grams the least (the last of equal ones) is
kept as a fingerprint, so any run of ``w + k - 1`` lines that repeats shares a
fingerprint with its earlier copy. Only the places of fingerprints are written, each
with the hashes of the lines around it. Places whose fingerprint comes back are joined
with the first place of the same fingerprint in the same surroundings; from there the
match is extended line by line both ways, and the lines of matches that are long
enough go. No fingerprint of a run lies further than ``w - 1`` lines from its ends, so
the surroundings of the outermost ones reach both ends of every run.

Two cases that no run of ``w + k - 1`` lines covers have fingerprints of their own: a
single line of many words, and a whole document of fewer lines.

Every place is compared with one first place per window it was chosen for: the work
grows with the number of places, not with their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.arrow import give_back, only_tables_of, text_chunks
from fathomline.llm.scratch import Scratch
from fathomline.llm.sieve import row_key, sift
from fathomline.shipping import ship

#: Production parameters: runs of three lines or more are found, and single lines of so many words.
GRAM, WINDOW, LONG_WORDS = 2, 2, 50
TRIMMED = " \t\r"
#: Kinds of places.
RUN, LONG, WHOLE = 0, 1, 2


def sequence(text: str) -> tuple[list[str], list[int]]:
    """All lines of a text, and the indices of those that are not blank."""
    lines = text.split("\n")
    return lines, [i for i, x in enumerate(lines) if x.strip(TRIMMED)]


def n_words(line: str) -> int:
    """Words of a line: what stands between spaces and tabs."""
    return sum(map(bool, line.replace("\t", " ").split(" ")))


def _mixed(parts: list[np.ndarray], seed: int) -> np.ndarray:
    """A hash of the elements of equally long arrays, position by position."""
    h = np.full(len(parts[0]), seed, np.uint64)
    for x in parts:
        h = (h ^ x) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h = h * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed)
    return h ^ (h >> np.uint64(29))


def winnow(lines: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, place, windows) of the chosen grams of a sequence.

    Bit ``i`` of ``windows``: the gram was chosen for the window that begins ``i`` lines before it.
    """
    n = len(lines) - w - k + 2
    if n < 1:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    grams = _mixed([lines[i : len(lines) - k + 1 + i] for i in range(k)], 7)
    choice = np.stack([grams[i : i + n] for i in range(w)])
    back = w - 1 - np.argmin(choice[::-1], axis=0)
    at = np.arange(n) + back  # never falls from one window to the next
    fresh = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return grams[at[fresh]], at[fresh], np.bitwise_or.reduceat(np.left_shift(1, back), fresh)


def _places(k: int, w: int, long_words: int | None):
    """Rows (id, th, text) to the places of fingerprints, with 128 bits of each line around."""
    t = w + k - 1

    def of_text(lines: list[str], own: list[int], keys: list[str], low: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(kind, fingerprints, places, windows, first line around, end of lines around)."""
        if 0 < len(own) < t:
            yield WHOLE, _mixed([low[i : i + 1] for i in range(len(own))], 17 + len(own)), np.zeros(1, np.int64), np.ones(1, np.int64), np.zeros(1, np.int64), np.full(1, len(own))
        fp, at, chosen = winnow(low, k, w)
        if len(fp):
            yield RUN, fp, at, chosen, at - w + 1, at + k + w - 1
        if long_words:
            far = np.array([i for i, x in enumerate(keys) if len(x) >= 2 * long_words - 1 and n_words(x) >= long_words], np.int64)
            if len(far):
                yield LONG, _mixed([low[far]], 23), far, np.ones(len(far), np.int64), far, far + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_tables_of("lines")
        for part, texts in text_chunks(batches, "text"):
            found: list[list[np.ndarray]] = [[] for _ in range(7)]
            sums, numbers, ends, done = [], [], [], 0
            for i, text in enumerate(texts):
                lines, own = sequence(text)
                if not own:
                    continue
                keys = [lines[j].strip(TRIMMED) for j in own]
                both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x) for x in keys]), ">u8").astype(np.uint64).reshape(-1, 2)
                for kind, fp, at, chosen, begin, end in of_text(lines, own, keys, both[:, 1]):
                    for column, x in zip(found, (np.full(len(fp), i), np.full(len(fp), kind), fp.view(np.int64), at, chosen, begin + done, end + done), strict=True):
                        column.append(x)
                    ends.append(np.full((len(fp), 2), (done, done + len(own))))
                sums.append(both)
                numbers.append(np.array(own))
                done += len(own)
            if not found[0]:
                continue
            owner, kind, fp, at, chosen, begin, end = (np.concatenate(c) for c in found)
            whole, number, bounds = np.concatenate(sums), np.concatenate(numbers), np.concatenate(ends)
            sizes = end - begin
            offsets = np.r_[0, np.cumsum(sizes)]
            index = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - begin, sizes)
            outside = (index < np.repeat(bounds[:, 0], sizes)) | (index >= np.repeat(bounds[:, 1], sizes))
            index = np.clip(index, 0, done - 1)

            def around(values: np.ndarray, offsets=offsets, outside=outside) -> pa.Array:
                return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, mask=outside))

            owner = pa.array(owner)
            arrays = [part.column(0).take(owner), part.column(1).take(owner), *(pa.array(x) for x in (kind, fp, at, chosen)), around(whole[index, 1].view(np.int64)), around(whole[index, 0].view(np.int64)), around(number[index].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "th", "kind", "fp", "p", "chosen", "low", "high", "at"])
        give_back()

    return run


def _matched(k: int, w: int) -> Column:
    """Indices of the lines around a place that go: the gram, and what is equal on end to both sides of it, if long enough."""
    equal = F.zip_with(F.zip_with("low", "other.low", lambda a, b: F.coalesce(a == b, F.lit(False))), F.zip_with("high", "other.high", lambda a, b: F.coalesce(a == b, F.lit(False))), lambda a, b: a & b)
    size = F.size("low")
    first = F.when(F.col("kind") == RUN, F.lit(w - 1)).otherwise(F.lit(0))
    last = F.when(F.col("kind") == RUN, F.lit(w + k - 2)).otherwise(size - 1)
    on_end = F.filter(F.sequence(F.lit(0), size - 1), lambda j: F.forall(F.slice(equal, F.least(j, first) + 1, F.greatest(j, last) - F.least(j, first) + 1), lambda x: x))
    return F.when(F.size(on_end) >= F.when(F.col("kind") == RUN, F.lit(w + k - 1)).otherwise(size), on_end)


def repeated_lines(docs: DataFrame, scratch: Scratch, doc_id: str, text: str, k: int, w: int, long_words: int | None) -> DataFrame:
    """``(id, th, starts, ends, n_removed)``: runs of lines (of all lines, ends exclusive) that occurred earlier, for documents that have any."""
    ship(docs.sparkSession)
    key, th = row_key(doc_id, text)
    source = docs.where(F.col(f"`{text}`").isNotNull()).select(key.alias("id"), th.alias("th"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    found = scratch.save(source.mapInArrow(_places(k, w, long_words), f"id {kind}, th long, kind long, fp long, p long, chosen long, low array<long>, high array<long>, at array<long>"))
    # The small sides of the joins are written tables, so that the joins have plain exchanges below and hot keys can be
    # split. They are merged at every size: none of them has a bound, and small inputs show the plan of large ones.
    twice = scratch.save(found.groupBy("fp").count().where("count > 1").select("fp"))
    near = scratch.save(found.join(twice.hint("merge"), "fp", "left_semi"))
    t = w + k - 1
    # The window of a place that was chosen for it `i` lines ahead begins w - 1 - i lines into its surroundings.
    options = F.array(*[F.when((F.col("kind") == RUN) & (F.col("chosen").bitwiseAND(F.lit(1 << i)) != 0), F.struct(F.slice("low", w - i, t).alias("low"), F.slice("high", w - i, t).alias("high"))) for i in range(w)], F.when(F.col("kind") != RUN, F.struct("low", "high")))
    met = near.select("*", F.explode(F.filter(options, lambda x: x.isNotNull())).alias("window")).select("*", F.xxhash64("kind", "window.low").alias("a"), F.xxhash64("window.high", "kind").alias("b")).drop("window")
    here = F.struct("id", "th", "p")
    first = scratch.save(met.groupBy("a", "b").agg(F.min(F.struct("id", "th", "p", "low", "high")).alias("other"), F.max(here).alias("last")).where(~F.struct("other.id", "other.th", "other.p").eqNullSafe(F.col("last"))).select("a", "b", "other"))
    pairs = met.join(first.hint("merge"), ["a", "b"]).where(~here.eqNullSafe(F.struct("other.id", "other.th", "other.p")))
    gone = pairs.select("id", "th", "at", F.explode(_matched(k, w)).alias("j")).select("id", "th", F.get("at", F.col("j")).cast("int").alias("line"))
    lists = gone.groupBy("id", "th").agg(F.array_sort(F.collect_set("line")).alias("lines"))
    begins = F.filter("lines", lambda x, i: (i == 0) | (F.get("lines", i - 1) != x - 1))
    stops = F.transform(F.filter("lines", lambda x, i: (i == F.size("lines") - 1) | (F.get("lines", i + 1) != x + 1)), lambda x: x + 1)
    return scratch.save(lists.select("id", "th", begins.alias("starts"), stops.alias("ends"), F.size("lines").cast("long").alias("n_removed")))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = GRAM, w: int = WINDOW, long_words: int | None = LONG_WORDS) -> DataFrame:
    """The frame with later repeated runs cut out of ``text``, plus ``n_lines`` and ``n_removed``.

    A line goes when it lies in a run of ``w + k - 1`` lines (blank ones not counted,
    white space at both ends ignored) that occurred earlier, in the order of id, then
    text hash, then position; when it has ``long_words`` words or more and occurred
    earlier among such lines; and when its whole document has fewer than ``w + k - 1``
    lines and an earlier document consists of just the same. Lines are compared by 128
    bits of hash. Blank lines stay. A null text stays null with no lines,
    an empty one is one blank line; very long texts are handled whole; rows with equal
    id and text are one document and get equal results; null ids sort first; an empty
    table gives an empty one; other columns are kept (columns named like the added
    ones are replaced).
    """
    scratch = Scratch(docs.sparkSession, "lines")
    cuts = repeated_lines(docs, scratch, doc_id, text, k, w, long_words)
    rest = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    maybe, clean = sift(docs.select(*[F.col(f"`{c}`") for c in rest]), doc_id, text, cuts, scratch)
    none = clean.select("r", *[F.lit(None).cast(cuts.schema[c].dataType).alias(c) for c in ("starts", "ends", "n_removed")])
    own = cuts.select(F.col("id").alias("_id"), F.col("th").alias("_th"), "starts", "ends", "n_removed")
    some = maybe.join(own.hint("merge"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left").select("r", "starts", "ends", "n_removed")
    value = F.col("r").getField(text)
    lines = F.split(value, "\n", -1)
    begins, stops = F.concat(F.array(F.lit(0)), "ends"), F.concat("starts", F.array(F.size(lines)))
    kept = F.array_join(F.flatten(F.zip_with(begins, stops, lambda a, b: F.slice(lines, a + 1, b - a))), "\n")
    cut = F.when(F.col("n_removed").isNotNull(), kept).otherwise(value)
    n_lines = F.when(value.isNull(), 0).otherwise(F.length(value) - F.length(F.replace(value, F.lit("\n"), F.lit(""))) + 1)

    def columns(rows: DataFrame, changed: Column) -> DataFrame:
        return rows.select(*[changed.alias(c) if c == text else F.col("r").getField(c).alias(c) for c in rest], n_lines.cast("long").alias("n_lines"), F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"))

    return columns(none, value).unionByName(columns(some, cut))


def dedup_lines_sql(k: int = GRAM, w: int = WINDOW, long_words: int = LONG_WORDS) -> str:
    """The same in DuckDB SQL, by comparing all windows."""
    t = w + k - 1
    more = ", ".join(f"lead(key, {i}) OVER (PARTITION BY doc_id ORDER BY i) AS k{i}" for i in range(1, t))
    keys = ", ".join(["key", *[f"k{i}" for i in range(1, t)]])
    return f"""
WITH cut AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL),
seq AS (SELECT doc_id, i, trim(line, ' ' || chr(9) || chr(13)) AS key FROM cut WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''),
win AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS j, i, {more}, key FROM seq),
rep AS (SELECT doc_id, j, row_number() OVER (PARTITION BY {keys} ORDER BY doc_id, j) AS nth FROM win WHERE k{t - 1} IS NOT NULL),
far AS (SELECT doc_id, j, row_number() OVER (PARTITION BY key ORDER BY doc_id, j) AS nth FROM win WHERE len(regexp_extract_all(key, '[^ \\t]+')) >= {long_words}),
whole AS (SELECT doc_id, row_number() OVER (PARTITION BY keys ORDER BY doc_id) AS nth FROM (SELECT doc_id, list(key ORDER BY j) AS keys FROM win GROUP BY doc_id HAVING count(*) < {t}) z),
gone AS (SELECT DISTINCT doc_id, j + d AS j FROM rep, (SELECT unnest(range({t})) AS d) x WHERE nth > 1
  UNION SELECT doc_id, j FROM far WHERE nth > 1 UNION SELECT doc_id, j FROM win SEMI JOIN (SELECT doc_id FROM whole WHERE nth > 1) u USING (doc_id)),
lost AS (SELECT win.doc_id, win.i FROM win JOIN gone USING (doc_id, j)),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM (SELECT cut.* FROM cut ANTI JOIN lost USING (doc_id, i)) y GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM lost GROUP BY doc_id)
SELECT doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
  CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines, coalesce(n_removed, 0) AS n_removed
FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""
