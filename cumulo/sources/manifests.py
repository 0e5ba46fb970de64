"""Split manifests: nested JSON documents as rows, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType([T.StructField(n, T.StringType()) for n in ("category", "model_id", "mesh", "mesh_sha256", "official_split")])
DOCUMENT = T.StructType([
    T.StructField("version", T.IntegerType()), T.StructField("dataset", T.StringType()), T.StructField("seed", T.LongType()),
    T.StructField("splits", T.MapType(T.StringType(), T.ArrayType(RECORD))),
])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: split, category, model_id, mesh, mesh_sha256, official_split."""
    documents = spark.read.schema(DOCUMENT).option("multiLine", True).json(path)
    return documents.select(F.explode("splits").alias("split", "_records")).select("split", F.inline("_records"))


def manifest_problems(spark: SparkSession, path: str) -> DataFrame:
    """Structural problems of manifest documents, by file."""
    documents = spark.read.schema(DOCUMENT).option("multiLine", True).json(path).select("*", F.col("_metadata.file_path").alias("file"))
    structure = documents.select("file", F.explode(F.array_compact(F.array(
        F.when(F.coalesce(F.col("version"), F.lit(0)) != 1, F.lit("version must be 1")),
        F.when(F.col("dataset").isNull(), F.lit("dataset is missing")),
        F.when(F.col("splits").isNull() | (F.size("splits") == 0), F.lit("splits are missing")),
    ))).alias("reason"))
    parts = documents.select("file", F.explode("splits").alias("split", "_records"))
    empty = parts.filter(F.col("_records").isNull() | (F.size("_records") == 0)).select("file", F.concat(F.lit("split is empty: "), "split").alias("reason"))
    records = parts.select("file", "split", F.inline("_records"))
    lacking = F.col("category").isNull() | F.col("model_id").isNull() | F.col("mesh").isNull() | F.col("mesh_sha256").isNull()
    invalid = records.filter(lacking).select("file", F.concat(F.lit("invalid record in split: "), "split").alias("reason"))
    repeated = records.groupBy("file", "category", "model_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(
        "file", F.concat(F.lit("identity repeats: "), "category", F.lit("/"), "model_id").alias("reason")
    )
    return structure.unionByName(empty).unionByName(invalid).unionByName(repeated)


def manifest_document(records: DataFrame, *, dataset: str, seed: int) -> DataFrame:
    """The nested document of a manifest. It is one JSON object, so it is one row."""
    held = [n for n in RECORD.fieldNames() if n in records.columns]
    folded = records.groupBy("split").agg(F.array_sort(F.collect_list(F.struct(*held))).alias("_records"))
    return folded.groupBy().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("split", "_records")))).alias("splits")).select(
        F.lit(1).alias("version"), F.lit(dataset).alias("dataset"), F.lit(seed).cast("bigint").alias("seed"), "splits"
    )


def write_manifest(records: DataFrame, path: str, *, dataset: str, seed: int, mode: str = "errorifexists") -> None:
    manifest_document(records, dataset=dataset, seed=seed).write.mode(mode).json(path)
