"""Language identification by bit-sliced Bloom filters of character n-grams.

One Bloom filter per language, stored side by side: a slot of the table is a bit
mask with one bit per language, so the AND of the slots of an n-gram is the set of
all languages that (seem to) contain it. The hits of each language are counted
over all n-grams of a text, corrected for the filter's false positives, and the
language with the largest share decides.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.arrow import map_texts, only_tables_of, text_chunks
from fathomline.llm.sample import crc_rest, hash_sample
from fathomline.llm.scratch import Scratch
from fathomline.shipping import ship

UNKNOWN = "und"
MOST_LANGUAGES = 64
#: Text bytes handled at once: each becomes some hundred bytes of hashes and slots.
CHUNK = 1 << 18
#: Letters enter n-grams; everything else counts as one space.
_SPACE = 32


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts end to end, each between two spaces and lower-cased, and where each begins."""
    lower = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.r_[0, np.cumsum(np.fromiter(map(len, lower), np.int64, len(lower)))]


_letters: dict[int, bool] = {}


def _is_letter(codes: np.ndarray) -> np.ndarray:
    """Which code points are letters, by a table of those met so far."""
    top = int(codes.max(initial=0)) + 1
    seen = np.bincount(codes, minlength=top) > 0
    table = np.zeros(top, bool)
    for c in np.flatnonzero(seen).tolist():
        if c not in _letters:
            _letters[c] = chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False
        table[c] = _letters[c]
    return table[codes]


def ngram_hashes(texts: list[str], sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams of letters and word borders, the text of each, and whether a text has a letter."""
    codes, starts = _codes(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))
    letter = _is_letter(codes)
    has = np.zeros(len(texts), bool)
    has[owner[letter]] = True
    folded = np.where(letter, codes, _SPACE).astype(np.uint64)
    # Runs of other characters shrink to one border; every text begins with one.
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[starts[:-1]] = True
    folded, owner = folded[keep], owner[keep]
    hashes, owners = [], []
    for n in sizes:
        if len(folded) < n:
            continue
        h = np.full(len(folded) - n + 1, n, np.uint64)
        for i in range(n):
            h = (h ^ folded[i : len(folded) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        inside = owner[n - 1 :] == owner[: len(owner) - n + 1]
        hashes.append(h[inside])
        owners.append(owner[n - 1 :][inside])
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64), has
    return np.concatenate(hashes), np.concatenate(owners), has


@dataclass
class LanguageFilters:
    """The table (one mask per slot), the languages and their false-positive rates."""

    languages: list[str]
    table: np.ndarray
    rates: np.ndarray
    sizes: tuple[int, ...]
    probes: int

    @staticmethod
    def fit(grams: dict[str, np.ndarray], slots_log2: int, sizes: tuple[int, ...], probes: int = 2) -> LanguageFilters:
        """``grams``: hashes of the n-grams that each language is said to contain."""
        languages = sorted(grams)
        if len(languages) > MOST_LANGUAGES:
            raise ValueError(f"at most {MOST_LANGUAGES} languages fit a mask")
        kind = np.uint8 if len(languages) <= 8 else np.uint64
        table = np.zeros(1 << slots_log2, kind)
        for bit, language in enumerate(languages):
            for slot in LanguageFilters._slots(grams[language], slots_log2, probes):
                table[slot] |= kind(1 << bit)
        fill = np.array([float(((table >> kind(bit)) & kind(1)).mean()) for bit in range(len(languages))])
        return LanguageFilters(languages, table, fill**probes, sizes, probes)

    @staticmethod
    def _slots(hashes: np.ndarray, log2: int, probes: int) -> list[np.ndarray]:
        mask = np.uint64((1 << log2) - 1)
        step = (hashes >> np.uint64(33)) | np.uint64(1)
        return [((hashes + np.uint64(i) * step) & mask).astype(np.int64) for i in range(probes)]

    def containing(self, hashes: np.ndarray) -> np.ndarray:
        """The mask of languages of each n-gram."""
        log2 = len(self.table).bit_length() - 1
        first, *rest = self._slots(hashes, log2, self.probes)
        found = self.table[first]
        for slot in rest:
            found = found & self.table[slot]
        return found

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score (0 to 1) of each text.

        The score is the share of n-grams that the winner explains among those that
        the winner or the runner-up explain; ties go to the first language by name.
        """
        hashes, owner, has = ngram_hashes(texts, self.sizes)
        total = np.bincount(owner, minlength=len(texts)).astype(float)
        masks = self.containing(hashes)
        counts = np.empty((len(texts), len(self.languages)))
        for bit in range(len(self.languages)):
            hit = owner[(masks & masks.dtype.type(1 << bit)) != 0]
            counts[:, bit] = np.bincount(hit, minlength=len(texts))
        share = np.clip((counts - total[:, None] * self.rates) / np.maximum(1e-9, 1 - self.rates), 0, None)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best = share.argmax(axis=1)
        top = share[np.arange(len(texts)), best]
        second = np.partition(share, -2, axis=1)[:, -2] if len(self.languages) > 1 else np.zeros(len(texts))
        # A language that explains nearly as much leaves the score near one half; unexplained n-grams lower it.
        score = np.where(total > 0, (top + 1e-9) / (top + second + 2e-9) * np.minimum(1, 2 * top / np.maximum(total, 1)), 0.0)
        names = [self.languages[b] if h else UNKNOWN for b, h in zip(best.tolist(), has.tolist(), strict=True)]
        return names, np.where(has, np.clip(score, 0, 1), 0.0)


def fit_filters(labelled: DataFrame, lang: str = "lang", text: str = "text", per_language: int = 3000, sizes: tuple[int, ...] = (2, 3, 4), at_least: float = 2e-5, slots_log2: int = 20) -> LanguageFilters:
    """Filters from labelled rows; rows without a language or text teach nothing.

    The sample is bounded to about ``per_language`` distinct texts of each language;
    how often a text is repeated does not count. Its n-grams are counted once, where the rows are; an
    n-gram belongs to a language when it makes up ``at_least`` of its n-grams and is
    not at least eight times as frequent elsewhere. So a language has at most
    ``1 / at_least`` of them (50,000), which bounds what reaches the driver.
    """
    ship(labelled.sparkSession)
    scratch = Scratch(labelled.sparkSession, "language")
    known = labelled.where(F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull()).select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))
    sampled = hash_sample(known.withColumn("key", F.xxhash64("text")), "key", "lang", per_language).groupBy("lang", "key").agg(F.min("text").alias("text"))

    def count(batches):
        only_tables_of("language")
        for part, texts in text_chunks(batches, "text", CHUNK):
            langs = part.column(0).to_pylist()
            for language in sorted(set(langs)):
                own = [t for t, x in zip(texts, langs, strict=True) if x == language]
                hashes, n = np.unique(ngram_hashes(own, sizes)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([language] * len(hashes), pa.string()), pa.array(hashes.view(np.int64)), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    counts = scratch.save(sampled.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n")))
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    grams = {language: np.empty(0, np.uint64) for language in totals}
    if totals:
        total = F.element_at(F.create_map(*chain.from_iterable((F.lit(x), F.lit(float(n))) for x, n in sorted(totals.items()))), F.col("lang"))
        shares = counts.select("gram", "lang", (F.col("n") / total).alias("f")).where(F.col("f") >= at_least)
        best = shares.groupBy("gram").agg(F.max("f").alias("top"), F.collect_list(F.struct("lang", "f")).alias("all"))
        fit = best.select("gram", "top", F.explode("all").alias("x")).where(F.col("x.f") * 8 >= F.col("top")).select("x.lang", "gram").toArrow()
        names, values = fit.column(0).to_numpy(zero_copy_only=False), fit.column(1).to_numpy().view(np.uint64)
        grams = {language: values[names == language] for language in totals}
    return LanguageFilters.fit(grams, slots_log2, sizes)


def identify(docs: DataFrame, filters: LanguageFilters, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, lang_pred, score)``, plus the columns named in ``keep``.

    Null texts and texts without a letter are ``und`` with score 0; very long texts
    are read whole; repeated rows and null ids pass through; an empty table gives an
    empty one. Without any language everything is ``und``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # 1 MB for up to eight languages, by its number of slots

    def setup():
        own = shared.value

        def work(texts: list[str]) -> dict[str, object]:
            names, score = own.predict(texts)
            return {"lang_pred": pa.array(names, pa.string()), "score": score}

        return work

    return map_texts(docs, [doc_id, *keep], text, "lang_pred string, score double", None, setup, "language", CHUNK)


def predict_languages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``: learned from rows that are not held out."""
    rest = crc_rest(doc_id, 3)
    filters = fit_filters(docs.where(rest != 1), lang, text)
    return identify(docs, filters, doc_id, text).select(F.col(f"`{doc_id}`"), F.coalesce(rest == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
