"""Run grids, stored result rows and skipping of finished cells."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOUBLES = (
    "nominal_payload_bpp", "actual_stream_bpp", "encode_seconds", "decode_seconds", "chamfer_mse", "chamfer_rmse", "d1_mse_proxy",
    "d1_psnr_db_proxy", "d2_mse_proxy", "d2_psnr_db_proxy", "p95_euclidean", "p99_euclidean", "hausdorff", "sliced_wasserstein_rms_proxy",
)
ERRORS = DOUBLES[4:]
OFFICIAL = ("d1_mse", "d1_psnr_db", "d2_mse", "d2_psnr_db", "d1_hausdorff", "d1_hausdorff_psnr_db", "d2_hausdorff", "d2_hausdorff_psnr_db")

RESULT_SCHEMA = T.StructType([
    *[T.StructField(n, T.StringType()) for n in ("split", "family", "model_id")], T.StructField("sample_id", T.IntegerType()),
    T.StructField("model_seed", T.IntegerType()), T.StructField("method", T.StringType()),
    *[T.StructField(n, T.IntegerType()) for n in ("constellation_size", "coordinate_bits", "payload_bits", "stream_bytes")],
    *[T.StructField(n, T.DoubleType()) for n in DOUBLES], *[T.StructField(f"fresh_{n}", T.DoubleType()) for n in ERRORS],
    *[T.StructField(f"official_{n}", T.DoubleType()) for n in OFFICIAL],
    T.StructField("rate_point", T.StringType()), T.StructField("encoder_args", T.ArrayType(T.StringType())), T.StructField("reconstruction_points", T.IntegerType()),
])


def product_grid(spark: SparkSession, axes: dict[str, Sequence]) -> DataFrame:
    """Every combination of a few parameter values (a config-sized list)."""
    return spark.createDataFrame(list(product(*axes.values())), list(axes))


def cross_axes(spark: SparkSession, axes: dict[str, Sequence], primary: dict[str, object]) -> DataFrame:
    """Points that vary one axis while the others stay at their primary value."""
    points = {tuple(value if name == axis else primary[name] for name in axes) for axis in axes for value in axes[axis]}
    return spark.createDataFrame(sorted(points), list(axes))


def grid_of(rows: DataFrame, design: Sequence[str], unit: str) -> DataFrame:
    """Complete design x unit grid of stored rows.

    The design levels are one row of short arrays and are broadcast; units stay
    distributed.
    """
    levels = rows.select(F.lit(1).alias("_k"), F.struct(*design).alias("_d")).distinct().groupBy("_k").agg(
        *[F.collect_set(F.col(f"_d.{c}")).alias(c) for c in design]
    )
    units = rows.select(unit, F.lit(1).alias("_k")).distinct().join(F.broadcast(levels), "_k").drop("_k")
    for column in design:
        units = units.withColumn(column, F.explode(column))
    return units.select(*design, unit)


def with_fingerprint(cells: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Digest of the settings that decide a cell's result."""
    return cells.withColumn("config_fingerprint", F.sha2(F.to_json(F.struct(*columns)), 256))


def pending_cells(requested: DataFrame, completed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Requested cells without a stored result of the same settings."""
    return requested.join(completed.select(*keys, "config_fingerprint").distinct(), [*keys, "config_fingerprint"], "left_anti")


def write_rows(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Columnar form of result rows, partitioned for pruning by split and method."""
    rows.write.mode(mode).partitionBy("split", "method").parquet(path)


def write_json_rows(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).json(path)


def read_json_rows(spark: SparkSession, path: str, schema: T.StructType = RESULT_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """Stored rows for re-aggregation; nothing is recomputed."""
    return spark.read.parquet(path)


def _seed_from_path() -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), r"seed_(\d+)/", 1).try_cast("int")


def read_run_artifacts(spark: SparkSession, pattern: str, rows_schema: T.StructType = RESULT_SCHEMA, field: str = "per_cloud") -> DataFrame:
    """Rows nested in ``seed_*/…json`` documents, tagged with the seed in the path."""
    document = T.StructType([T.StructField(field, T.ArrayType(rows_schema))])
    loaded = spark.read.schema(document).option("multiLine", True).json(pattern)
    rows = loaded.select(_seed_from_path().alias("_seed"), F.explode(field).alias("_row")).select("_seed", "_row.*")
    return rows.withColumn("model_seed", F.coalesce(F.col("_seed"), F.col("model_seed"))).drop("_seed")
