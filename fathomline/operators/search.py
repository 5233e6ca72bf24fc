"""Exact nearest neighbours by cosine similarity, with filters applied before ranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.exprs import EPS, as_doubles, attributes_equal, dot, modality_passes, norm
from fathomline.shipping import ship
from fathomline.staging import Scratch

#: Bytes of vectors that are broadcast at once; a larger side is taken in blocks.
MOST_BROADCAST = 64 << 20
#: Digits of a similarity; ties beyond them go by id.
DIGITS = 9


def select_candidates(bank: DataFrame, modality: str | None = None, metadata: dict[str, object] | None = None, candidate_ids: DataFrame | None = None, strict_modality: bool = False) -> DataFrame:
    """Rows of the bank that may be found: modality, attributes and ids, all before the top-k.

    ``strict_modality`` is the store's rule: rows without a modality do not pass.
    ``candidate_ids(id)`` restricts to listed ids; a table without rows is no filter.
    """
    out = bank
    if modality:
        out = out.where(F.col("modality") == modality if strict_modality else modality_passes(F.col("modality"), modality))
    if metadata:
        out = out.where(attributes_equal({c: F.col(c) for c in bank.columns}, metadata))
    if candidate_ids is not None and candidate_ids.take(1):
        out = out.join(candidate_ids.select(F.col("id").cast("string").alias("_id")).distinct(), F.col("id").cast("string") == F.col("_id"), "left_semi")
    return out


def check_dimension(bank: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """The bank, failing on the first vector of another dimension."""
    return bank.where(F.assert_true(F.size(column) == dim, F.lit(f"vectors must have {dim} dimensions")).isNull())


def vector_topk(bank: DataFrame, query: list[float], k: int = 10) -> DataFrame:
    """The ``k`` most similar rows to one query: a projection and a top-k, nothing else.

    Adds ``score``; fewer rows where the bank is smaller, none for an empty bank.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    size = float(np.sqrt(sum(float(x) * float(x) for x in query))) + EPS
    v = as_doubles(F.col("embedding"))
    scored = check_dimension(bank, len(query)).withColumn("score", F.round(dot(v, q) / (norm(v) * F.lit(size)), DIGITS))
    return scored.orderBy(F.desc("score"), F.asc("id")).limit(k)


def _matrix(rows: pa.Table | pa.RecordBatch, column: str) -> np.ndarray:
    """Vectors over their guarded lengths; there are no nulls and one length, see ``comparable``."""
    values = rows.column(column)
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    if not len(values):
        return np.empty((0, 0))
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(float)
    v = flat.reshape(len(values), -1)
    return v / (np.sqrt((v * v).sum(axis=1, keepdims=True)) + EPS)


def comparable(rows: DataFrame, dim: int) -> DataFrame:
    """Rows with a vector; one of another length than ``dim`` or with a null in it fails the job."""
    whole = F.assert_true(~F.exists("embedding", lambda x: x.isNull()), F.lit("vectors must have no nulls inside")).isNull()
    return check_dimension(rows.where(F.col("embedding").isNotNull()), dim).where(whole)


def batch_knn(queries: DataFrame, bank: DataFrame, k: int | None, query_id: str = "query_id", carry: tuple[str, ...] = ("label", "modality")) -> DataFrame:
    """``(query_id, id, *carry, score, rank)``: the ``k`` best of the bank for each query.

    The bank is broadcast in blocks of a fixed number of bytes, counted before, and the queries
    stream past each block once; a block's hits are cut to ``k`` per query before
    anything moves. With one block there is no shuffle at all; with more, each
    block's hits are written before the next block is read, so the driver holds one block at a
    time, and a window merges ``k`` rows per block. ``k`` None returns all pairs, which is the caller's
    wish and is streamed. No cross join is planned. Null vectors on either side have no
    hits; vectors of two lengths, on one side or between the sides, fail the job.
    """
    spark = bank.sparkSession
    ship(spark)
    names = ["id", *carry]
    shape = bank.where(F.col("embedding").isNotNull()).agg(F.count("*"), F.max(F.size("embedding"))).first()
    dim = shape[1] or 0
    own = bank.select(*names, "embedding").where(F.col("embedding").isNotNull())
    own = comparable(own, dim) if shape[0] else own
    blocks = max(1, -(-(shape[0] * dim * 8) // MOST_BROADCAST))
    source = queries.select(F.col(query_id).alias("query_id"), "embedding").where(F.col("embedding").isNotNull())
    source = comparable(source, dim) if shape[0] else source.limit(0)
    fields = ", ".join(f"{c} {own.schema[c].dataType.simpleString()}" for c in names)
    schema = f"query_id {source.schema['query_id'].dataType.simpleString()}, {fields}, score double, rank int"

    def hits_of(rows: DataFrame) -> tuple[DataFrame, Broadcast]:
        shared = spark.sparkContext.broadcast(rows.toArrow().sort_by("id"))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = shared.value
            base = _matrix(table, "embedding").T
            n = table.num_rows
            for batch in batches:
                for at in range(0, batch.num_rows if n else 0, 256):
                    part = batch.slice(at, 256)
                    scores = np.round(_matrix(part, "embedding") @ base, DIGITS)
                    take = n if k is None else min(k, n)
                    if take < n:  # candidates by value, then the tie by position, that is by id
                        edge = np.partition(scores, n - take, axis=1)[:, n - take]
                        best = np.stack([np.flatnonzero(s >= e)[np.argsort(-s[s >= e], kind="stable")][:take] for s, e in zip(scores, edge, strict=True)])
                    else:
                        best = np.argsort(-scores, axis=1, kind="stable")
                    hits = table.select(names).take(pa.array(best.ravel()))
                    columns = [part.column(0).take(pa.array(np.repeat(np.arange(len(best)), take))), *[hits.column(c).combine_chunks() for c in names], pa.array(np.take_along_axis(scores, best, axis=1).ravel()), pa.array(np.tile(np.arange(1, take + 1, dtype=np.int32), len(best)))]
                    yield pa.RecordBatch.from_arrays(columns, names=["query_id", *names, "score", "rank"])

        return source.mapInArrow(search, schema), shared

    if blocks == 1:
        out = hits_of(own)[0]
    else:
        scratch, out = Scratch(spark, "knn"), None
        for block in range(blocks):
            found, shared = hits_of(own.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block))
            found = scratch.save(found)
            shared.destroy()
            out = found if out is None else out.unionByName(found)
        out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))))
        out = out if k is None else out.where(F.col("rank") <= k)
    return out.withColumnRenamed("query_id", query_id)


def approximate_knn(queries: DataFrame, bank: DataFrame, k: int, tables: int = 8, width: float = 0.4, reach: float = 1.2) -> DataFrame:
    """Optional nearest neighbours by random projections; never the default, may miss hits.

    Unit vectors within Euclidean distance ``reach`` (similarity ``1 - reach**2 / 2``)
    meet in buckets; scores are exact for what is found.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    from fathomline.functions.exprs import normalized

    def unit(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col(name), array_to_vector(normalized(F.col("embedding"))).alias("unit"))

    model = BucketedRandomProjectionLSH(inputCol="unit", outputCol="buckets", bucketLength=width, numHashTables=tables, seed=1).fit(unit(bank, "id"))
    near = model.approxSimilarityJoin(unit(queries, "query_id"), unit(bank, "id"), reach, "distance")
    scored = near.select(F.col("datasetA.query_id").alias("query_id"), F.col("datasetB.id").alias("id"), F.round(1 - F.col("distance") * F.col("distance") / 2, DIGITS).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id")))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def merge_hits(first: DataFrame, second: DataFrame, k: int, key: str = "query_id") -> DataFrame:
    """Union of two hit lists per query: equal ids (else labels) merge, the larger score and the later payload win."""
    both = first.withColumn("_list", F.lit(0)).unionByName(second.withColumn("_list", F.lit(1)))
    rest = [c for c in first.columns if c not in (key, "score", "rank")]
    name = F.coalesce(F.nullif(F.col("id").cast("string"), F.lit("")), F.nullif(F.col("label"), F.lit("")))
    merged = both.groupBy(key, name.alias("_name")).agg(F.max("score").alias("score"), F.max_by(F.struct(*rest), F.struct("_list", "rank")).alias("_row"), F.min(F.struct("_list", "rank")).alias("_first"))
    order = Window.partitionBy(key).orderBy(F.desc("score"), F.asc("_first"))
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(key, *[F.col(f"_row.{c}").alias(c) for c in rest], "score", "rank")
