"""Reference records: JSON ingest, normalisation, prompts and COCO annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.functions.exprs import clean_list, resolved_modality, xywh_to_xyxy

TEXT_KEYS, IMAGE_KEYS = ("text", "prompt", "query"), ("path", "image", "image_path")
#: Key order of the list form of prompts.
PROMPT_KEYS = ("query", "text", "prompt", "path", "image")

REFERENCES = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "label", "modality", *TEXT_KEYS, *IMAGE_KEYS)])
COCO = T.StructType([
    T.StructField("images", T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("file_name", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]))),
    T.StructField("categories", T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())]))),
    T.StructField("annotations", T.ArrayType(T.StructType([T.StructField("image_id", T.LongType()), T.StructField("category_id", T.LongType()), T.StructField("bbox", T.ArrayType(T.DoubleType())), T.StructField("area", T.DoubleType()), T.StructField("iscrowd", T.IntegerType())]))),
])


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """References from a JSON list, with a fixed schema."""
    return spark.read.schema(REFERENCES).option("multiLine", True).json(path)


def normalize_references(raw: DataFrame) -> DataFrame:
    """``(id, label, modality, text, path)``: labels trimmed, modality resolved, ids made where absent.

    Rows without a label, or without what their modality needs, are dropped.
    """
    cols = raw.columns
    got = {c: (F.col(c) if c in cols else F.lit(None).cast("string")) for c in (*TEXT_KEYS, *IMAGE_KEYS, "id", "modality")}
    label = F.trim("label")
    modality = resolved_modality(got["modality"], [got[c] for c in TEXT_KEYS], [got[c] for c in IMAGE_KEYS])
    text, path = F.trim(F.coalesce(*[got[c] for c in TEXT_KEYS])), F.trim(F.coalesce(*[got[c] for c in IMAGE_KEYS]))
    out = raw.select(got["id"].alias("id"), label.alias("label"), modality.alias("modality"), text.alias("_text"), path.alias("_path")).where("label <> ''")
    is_text = F.col("modality") == "text"
    payload = F.when(is_text, F.col("_text")).otherwise(F.col("_path"))
    return out.where(F.coalesce(payload, F.lit("")) != "").select(F.coalesce("id", F.concat_ws("_", "modality", "label")).alias("id"), "label", "modality", F.when(is_text, F.col("_text")).alias("text"), F.when(~is_text, F.col("_path")).alias("path"))


def to_query_list(value: Column, kind: T.DataType | None = None) -> Column:
    """A query or a list of queries as trimmed, distinct, non-empty strings in order.

    ``kind`` tells how the value is held: an array is a list, a variant has the type
    of its JSON. A string is one query, whatever brackets or quotes it has, unless
    all of it is a JSON list of strings, as a reader with a fixed schema gives lists.
    """
    if isinstance(kind, T.ArrayType):
        return clean_list(value)
    if isinstance(kind, T.VariantType):
        listed = F.schema_of_variant(value).startswith("ARRAY")
        return clean_list(F.when(listed, F.try_variant_get(value, "$", "array<string>")).otherwise(F.array(F.try_variant_get(value, "$", "string"))))
    many = F.when(F.trim(value).startswith("[") & F.trim(value).endswith("]"), F.from_json(value, "array<string>"))
    return clean_list(F.coalesce(many, F.array(value)))


def prompts_from_map(raw: DataFrame, column: str = "value") -> DataFrame:
    """``(label, query, ord)`` from the dict form, one JSON object per row: label to string or list, each kept as what it is."""
    entries = raw.select(F.explode(F.from_json(F.col(column), "map<string,variant>")).alias("label", "v"))
    return _one_per_query(entries.select(F.trim("label").alias("label"), F.posexplode(to_query_list(F.col("v"), T.VariantType())).alias("ord", "query")))


def prompts_from_list(raw: DataFrame) -> DataFrame:
    """``(label, query, ord)`` from the list form: the first key with a value counts, labels merge."""
    options = [to_query_list(F.col(c), raw.schema[c].dataType) for c in PROMPT_KEYS if c in raw.columns]
    queries = F.coalesce(*[F.when(F.size(x) > 0, x) for x in options])
    return _one_per_query(raw.select(F.trim("label").alias("label"), F.posexplode(queries).alias("ord", "query")))


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """``(label, query, ord)`` of a prompts file in either form."""
    raw = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"), "value")
    listed = F.schema_of_variant("v").startswith("ARRAY")
    fields = ", ".join(["label string", *[f"{c} variant" for c in PROMPT_KEYS]])
    items = raw.where(listed).select(F.explode(F.from_json("value", f"array<struct<{fields.replace(' ', ':')}>>".replace(",:", ","))).alias("i")).select("i.*")
    return prompts_from_map(raw.where(~listed)).unionByName(prompts_from_list(items)).groupBy("label", "query").agg(F.min("ord").alias("ord"))


def _one_per_query(rows: DataFrame) -> DataFrame:
    return rows.where("label <> '' and query is not null").groupBy("label", "query").agg(F.min("ord").alias("ord"))


def resolve_prompt_paths(prompts: DataFrame, folder: str) -> DataFrame:
    """Relative paths of query images, resolved against the prompts' folder."""
    return prompts.withColumn("query", F.when(F.col("query").startswith("/"), F.col("query")).otherwise(F.concat_ws("/", F.lit(folder.rstrip("/")), "query")))


def read_coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, categories, truth): annotations without a box or image are dropped, boxes are corners.

    Categories of one name are one: the last id counts.
    """
    raw = spark.read.schema(COCO).option("multiLine", True).json(path)
    images = raw.select(F.explode("images").alias("i")).select("i.*")
    listed = raw.select(F.posexplode("categories").alias("pos", "c")).select("pos", "c.*")
    categories = listed.groupBy("name").agg(F.max_by("id", "pos").alias("id"))
    boxes = raw.select(F.posexplode("annotations").alias("gt_seq", "a")).where("a.bbox is not null and a.image_id is not null")
    corner = xywh_to_xyxy(*[F.col("a.bbox")[i] for i in range(4)])
    truth = boxes.select("gt_seq", F.col("a.image_id").alias("image_id"), F.col("a.category_id").alias("category_id"), F.coalesce("a.area", F.lit(0.0)).alias("area"), F.coalesce("a.iscrowd", F.lit(0)).alias("iscrowd"), corner.alias("b")).select("gt_seq", "image_id", "category_id", "area", "iscrowd", "b.*")
    return images, categories, truth.join(listed.select(F.col("id").alias("category_id"), F.col("name").alias("label")), "category_id", "left")


def images_with_files(images: DataFrame, files: DataFrame, folders: tuple[str, ...]) -> DataFrame:
    """Images with the first existing of their candidate paths; those without a file are dropped.

    ``files(path)`` lists what is there; ``folders`` come in order of priority.
    """
    options = images.select("*", F.posexplode(F.array(*[F.concat_ws("/", F.lit(f.rstrip("/")), "file_name") for f in folders])).alias("_n", "path"))
    found = options.join(files.select("path").distinct(), "path", "left_semi")
    return found.groupBy("id").agg(F.min_by("path", "_n").alias("path")).join(images, "id")


def read_predictions(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """Detections of predictions files, one payload a file or a line; a payload without any gives no rows."""
    raw = spark.read.schema(f"detections array<struct<{schema}>>").option("multiLine", not lines).json(path)
    return raw.select(F.explode("detections").alias("d")).select("d.*")
