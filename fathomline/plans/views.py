"""Stand-ins for banks, regions, queries, boxes and truth, derived from the test tables.

The same text runs in Spark and in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

REFS = """select concat('ref_', vec_id) as id, vec_id, concat('class_', label) as label,
  case when vec_id % 17 = 3 then '' when vec_id % 2 = 0 then 'text' else 'image' end as modality,
  concat('src', vec_id % 4) as source, embedding from {embeddings}"""
REGIONS = """select vec_id as region_id, cast((vec_id - vec_id % 5) / 5 as bigint) % 20 as image_id,
  cast(vec_id % 7 as double) / 7 as objectness,
  cast((vec_id * 7) % 40 as double) as x1, cast((vec_id * 11) % 40 as double) as y1,
  cast((vec_id * 7) % 40 + 30 + vec_id % 13 as double) as x2,
  cast((vec_id * 11) % 40 + 30 + vec_id % 11 as double) as y2, embedding from {embeddings} where vec_id % 5 = 0"""
QUERIES = "select vec_id as query_id, concat('class_', label) as query_label, embedding from {embeddings} where vec_id % 100 = 0"
BOXES = """select image_id, seq, label, is_gt, x1, y1, x1 + w as x2, y1 + w as y2, w,
  cast((partkey * 31 + suppkey * 17 + seq * 7) % 1000 as double) / 1000 as conf
from (select l_orderkey as image_id, l_partkey as partkey, l_suppkey as suppkey, l_returnflag as label,
  case when l_linestatus = 'F' then 1 else 0 end as is_gt,
  cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) as bigint) as seq,
  cast(l_partkey % 20 as double) as x1, cast(l_suppkey % 20 as double) as y1, 20 + l_quantity as w from {lineitem}) t"""
TABLES = {"refs": ("embeddings", REFS), "regions": ("embeddings", REGIONS), "queries": ("embeddings", QUERIES), "boxes": ("lineitem", BOXES)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, text = TABLES[name]
    return spark.sql(text, **{source: table(spark, sf_dir, source)})


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "boxes").where("is_gt = 1").selectExpr("image_id", "seq as gt_seq", "label", "x1", "y1", "x2", "y2", "w")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "boxes").where("is_gt = 0").select("image_id", "seq", "label", "conf", "x1", "y1", "x2", "y2")


def sql_views(*names: str) -> str:
    """Common table expressions of the views for DuckDB."""
    extra = {"truth": "select image_id, seq as gt_seq, label, x1, y1, x2, y2, w from boxes where is_gt = 1", "preds": "select image_id, seq, label, conf, x1, y1, x2, y2 from boxes where is_gt = 0"}
    return ",\n".join(f"{n} as ({TABLES[n][1].format(embeddings='embeddings', lineitem='lineitem') if n in TABLES else extra[n]})" for n in names)
