"""Tells rows that a table may list from rows that it surely does not, without a shuffle.

The listed rows set bits of a filter of fixed size, which is broadcast as at most
``SLOTS / 64`` rows. Rows without their bit pass by untouched; only the others meet
the table itself in a join. A full filter sends all rows to the join: the result
never depends on it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.scratch import Scratch

#: Slots of the filter; it is broadcast as at most SLOTS / 64 rows of two longs (2 MB).
SLOTS = 1 << 23


def row_key(doc_id: str, text: str) -> tuple[Column, Column]:
    """What tells documents apart: the id (may be null) and a hash of the text (0 without text)."""
    value = F.col(f"`{text}`").cast("string")
    return F.col(f"`{doc_id}`"), F.when(value.isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(value))


def sift(docs: DataFrame, doc_id: str, text: str, listed: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(rows that ``listed(id, th)`` may name, rows that it does not), each as ``(id, th, r)`` with the whole row in ``r``.

    Each of the two scans ``docs``; nothing of ``docs`` is shuffled.
    """
    slot = F.pmod(F.xxhash64("id", "th"), F.lit(SLOTS))
    bit = F.expr("shiftleft(1L, cast(s & 63 as int))")
    words = scratch.save(listed.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(bit).alias("bits")))
    key, th = row_key(doc_id, text)
    rows = docs.select(key.alias("id"), th.alias("th"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r")).withColumn("s", slot)
    met = rows.join(F.broadcast(words), F.shiftright("s", 6) == F.col("w"), "left").withColumn("hit", F.coalesce(F.col("bits").bitwiseAND(bit) != 0, F.lit(False)))
    return met.where("hit").select("id", "th", "r"), met.where("not hit").select("id", "th", "r")


def one_per_id(docs: DataFrame, doc_id: str, text: str, scratch: Scratch) -> DataFrame:
    """``(id, text)`` of the rows with both, one for each id: that with the least text hash. Ids with one row are not shuffled."""
    key, th = row_key(doc_id, text)
    known = docs.where(key.isNotNull() & F.col(f"`{text}`").isNotNull()).select(key.alias("_i"), F.col(f"`{text}`").cast("string").alias("_t"))
    several = scratch.save(known.groupBy("_i").agg(F.count("*").alias("n"), F.min(F.xxhash64("_t")).alias("least")).where("n > 1").select("_i", "least"))
    if not several.take(1):
        return known.select(F.col("_i").alias("id"), F.col("_t").alias("text"))
    named = several.select(F.col("_i").alias("id"), F.lit(0).cast("long").alias("th"), "least")
    maybe, alone = sift(known.withColumn("_z", F.lit(None).cast("string")), "_i", "_z", named.select("id", "th"), scratch)
    joined = maybe.select("id", F.col("r._t").alias("text")).join(named.select(F.col("id").alias("_id"), "least"), F.col("id") == F.col("_id"), "left")
    kept = joined.where(F.col("least").isNull() | (F.xxhash64("text") == F.col("least"))).groupBy("id").agg(F.min("text").alias("text"))
    return alone.select("id", F.col("r._t").alias("text")).unionByName(kept)


def bit_filter(slots: DataFrame, size: int) -> np.ndarray:
    """Bits of the slots ``s`` in use, 64 a word; at most ``size / 64`` rows reach the driver."""
    bits = slots.groupBy(F.shiftright("s", 6).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("b")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[bits.column("i").to_numpy()] = bits.column("b").to_numpy().view(np.uint64)
    return out


def has_bit(filter: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Whether the bit of each slot is set."""
    return (filter[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
