"""The given tables seen as point clouds, manifests and result rows.

Each view has a Spark builder and the same definition as SQL text, so a query
and its check start from one mapping. Per-cloud means are rounded to nine digits:
summation order then cannot turn equal losses into wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cumulo.functions.formulas import square
from cumulo.operators.normalize import center_unit_radius
from cumulo.session import cut_lineage

AXES = ("x", "y", "z")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def raw_event_clouds(spark: SparkSession, folder: str) -> DataFrame:
    second = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    return table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("cloud_id"),
        F.col("event_id").alias("point_id"),
        F.col("value").alias("x"),
        second.cast("double").alias("y"),
        F.get_json_object("props", "$.k").cast("double").alias("z"),
    )


def event_clouds(spark: SparkSession, folder: str) -> DataFrame:
    """One cloud per user, mean-centred with unit radius.

    Stored: a query reads its clouds up to eight times, and all these plans of joins and
    folds would run, and hold memory, inside one task.
    """
    return cut_lineage(center_unit_radius(raw_event_clouds(spark, folder)))


def event_clouds_with_normals(spark: SparkSession, folder: str) -> DataFrame:
    """Event clouds whose normal is the outward unit direction."""
    length = F.greatest(F.sqrt(square(F.col("x")) + square(F.col("y")) + square(F.col("z"))), F.lit(1e-8))
    return event_clouds(spark, folder).withColumn("_len", length).select(
        "cloud_id", "point_id", *AXES, *[(F.col(a) / F.col("_len")).alias(f"n{a}") for a in AXES]
    )


def embedding_clouds(spark: SparkSession, folder: str) -> DataFrame:
    """One cloud per label; every three entries of a vector are a point, the last one filled up with zeros."""
    entry = lambda i: F.coalesce(F.get("embedding", i), F.lit(0.0)).cast("double")
    places = F.sequence(F.lit(0), F.ceil(F.size("embedding") / F.lit(3)).cast("int") - 1)
    return table(spark, folder, "embeddings").filter(F.size("embedding") > 0).select(
        "label", "vec_id", "embedding", F.explode(places).alias("part")
    ).select(
        F.col("label").cast("string").alias("cloud_id"),
        (F.col("vec_id") * 1024 + F.col("part")).alias("point_id"),
        *[entry(F.col("part") * 3 + i).alias(a) for i, a in enumerate(AXES)],
    )


def lineitem_points(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("cloud_id"),
        (F.col("l_quantity") / F.lit(50.0)).alias("x"),
        (F.col("l_extendedprice") / F.lit(105000.0)).alias("y"),
        (F.col("l_discount") * F.lit(10.0)).alias("z"),
    )


def part_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One record per part; the official split is the parity of a hash digit."""
    digit = F.conv(F.substring(F.sha2(F.concat(F.lit("official:"), F.col("p_partkey").cast("string")), 256), 1, 1), 16, 10)
    return table(spark, folder, "part").select(
        F.col("p_brand").alias("category"),
        F.col("p_partkey").cast("string").alias("model_id"),
        F.when(digit.cast("int") % 2 == 0, "train").otherwise("test").alias("official_split"),
    )


def result_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Per-cloud result rows: split x method x seed x cloud."""
    return table(spark, folder, "lineitem").groupBy("l_linestatus", "l_returnflag", "l_linenumber", "l_suppkey").agg(
        (F.round(F.avg(F.col("l_tax") + F.lit(0.0)), 9) + F.lit(0.001)).alias("chamfer_mse"),
        (F.round(F.avg(F.col("l_discount") + F.lit(0.0)), 9) + F.lit(0.001)).alias("fresh_chamfer_mse"),
    ).select(
        F.when(F.col("l_linestatus") == "F", "validation").otherwise("ood").alias("split"),
        F.concat(F.lit("family_"), (F.col("l_suppkey") % 7).cast("string")).alias("family"),
        F.col("l_suppkey").cast("string").alias("model_id"),
        F.lit(0).alias("sample_id"),
        F.col("l_linenumber").cast("int").alias("model_seed"),
        F.when(F.col("l_returnflag") == "A", "fps").when(F.col("l_returnflag") == "N", "free").otherwise("strict_subset").alias("method"),
        F.lit(16).alias("constellation_size"),
        "chamfer_mse", F.sqrt("chamfer_mse").alias("chamfer_rmse"), "fresh_chamfer_mse",
    )


def factorial_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Arm x decoder seed x refiner seed x cloud; method and split alternate by flag."""
    year = F.year("l_shipdate")
    return table(spark, folder, "lineitem").groupBy(
        F.when(F.col("l_linestatus") == "F", "baseline").otherwise("stabilized").alias("arm"),
        F.col("l_linenumber").cast("int").alias("decoder_seed"),
        (year % 3).cast("int").alias("refiner_seed"),
        F.col("l_suppkey"),
    ).agg(
        (F.round(F.avg(F.col("l_tax") + F.lit(0.0)), 9) + F.lit(0.001)).alias("chamfer_mse"),
        (F.round(F.avg(F.col("l_discount") + F.lit(0.0)), 9) + F.lit(0.001)).alias("fresh_chamfer_mse"),
    ).select(
        "arm", "decoder_seed", "refiner_seed",
        F.concat(F.lit("family_"), (F.col("l_suppkey") % 7).cast("string")).alias("family"),
        F.col("l_suppkey").cast("string").alias("model_id"),
        "chamfer_mse", "fresh_chamfer_mse",
    )


def rate_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rate-distortion points: k from the ship year, one curve per (split, method)."""
    size = ((F.year("l_shipdate") - 1994) * 4).cast("int")
    return table(spark, folder, "lineitem").groupBy(
        F.when(F.col("l_linestatus") == "F", "validation").otherwise("ood").alias("split"),
        F.when(F.col("l_returnflag") == "A", "fps").when(F.col("l_returnflag") == "N", "free").otherwise("strict_subset").alias("method"),
        size.alias("constellation_size"),
    ).agg(F.sqrt(F.avg(F.col("l_tax") + F.lit(0.0)) + F.lit(0.001)).alias("chamfer_rmse"))


# ---- the same views as SQL -------------------------------------------------

EVENT_CTES = """
raw AS (SELECT CAST(user_id AS VARCHAR) AS cloud_id, event_id AS point_id, value AS x,
  CAST(date_part('hour', ts) * 3600 + date_part('minute', ts) * 60 + floor(date_part('second', ts)) AS DOUBLE) AS y,
  CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS DOUBLE) AS z FROM events),
cen AS (SELECT cloud_id, avg(x) AS ox, avg(y) AS oy, avg(z) AS oz FROM raw GROUP BY cloud_id),
shifted AS (SELECT r.cloud_id, r.point_id, r.x - c.ox AS x, r.y - c.oy AS y, r.z - c.oz AS z FROM raw r JOIN cen c USING (cloud_id)),
rad AS (SELECT cloud_id, greatest(max(sqrt(x*x + y*y + z*z)), CAST(1e-8 AS DOUBLE)) AS radius FROM shifted GROUP BY cloud_id),
ev AS MATERIALIZED (SELECT s.cloud_id, s.point_id, s.x / r.radius AS x, s.y / r.radius AS y, s.z / r.radius AS z FROM shifted s JOIN rad r USING (cloud_id))"""

NORMAL_CTES = EVENT_CTES + """,
evn AS MATERIALIZED (SELECT *, x / len AS nx, y / len AS ny, z / len AS nz FROM
  (SELECT *, greatest(sqrt(x*x + y*y + z*z), CAST(1e-8 AS DOUBLE)) AS len FROM ev))"""

EMBED_CTES = """
em AS MATERIALIZED (SELECT CAST(label AS VARCHAR) AS cloud_id, vec_id * 1024 + part AS point_id,
  CAST(coalesce(embedding[3 * part + 1], 0) AS DOUBLE) AS x, CAST(coalesce(embedding[3 * part + 2], 0) AS DOUBLE) AS y,
  CAST(coalesce(embedding[3 * part + 3], 0) AS DOUBLE) AS z
  FROM (SELECT label, vec_id, embedding, unnest(range((len(embedding) + 2) // 3)) AS part FROM embeddings))"""

LINE_CTES = """
li AS (SELECT CAST(l_suppkey AS VARCHAR) AS cloud_id, l_quantity / CAST(50 AS DOUBLE) AS x,
  l_extendedprice / CAST(105000 AS DOUBLE) AS y, l_discount * CAST(10 AS DOUBLE) AS z FROM lineitem)"""

PART_CTES = """
pm AS (SELECT p_brand AS category, CAST(p_partkey AS VARCHAR) AS model_id,
  CASE WHEN ('0x' || substr(sha256('official:' || CAST(p_partkey AS VARCHAR)), 1, 1))::BIGINT % 2 = 0 THEN 'train' ELSE 'test' END AS official_split
  FROM part)"""

RESULT_CTES = """
res AS MATERIALIZED (SELECT CASE WHEN l_linestatus = 'F' THEN 'validation' ELSE 'ood' END AS split,
  'family_' || CAST(l_suppkey % 7 AS VARCHAR) AS family, CAST(l_suppkey AS VARCHAR) AS model_id, 0 AS sample_id,
  l_linenumber AS model_seed, CASE l_returnflag WHEN 'A' THEN 'fps' WHEN 'N' THEN 'free' ELSE 'strict_subset' END AS method,
  16 AS constellation_size, chamfer_mse, sqrt(chamfer_mse) AS chamfer_rmse, fresh_chamfer_mse FROM
  (SELECT l_linestatus, l_returnflag, l_linenumber, l_suppkey, round(avg(l_tax), 9) + CAST(0.001 AS DOUBLE) AS chamfer_mse,
    round(avg(l_discount), 9) + CAST(0.001 AS DOUBLE) AS fresh_chamfer_mse FROM lineitem GROUP BY ALL))"""

FACTORIAL_CTES = """
fac AS MATERIALIZED (SELECT arm, decoder_seed, refiner_seed, 'family_' || CAST(l_suppkey % 7 AS VARCHAR) AS family,
  CAST(l_suppkey AS VARCHAR) AS model_id, chamfer_mse, fresh_chamfer_mse FROM
  (SELECT CASE WHEN l_linestatus = 'F' THEN 'baseline' ELSE 'stabilized' END AS arm, l_linenumber AS decoder_seed,
    CAST(year(l_shipdate) % 3 AS INTEGER) AS refiner_seed, l_suppkey, round(avg(l_tax), 9) + CAST(0.001 AS DOUBLE) AS chamfer_mse,
    round(avg(l_discount), 9) + CAST(0.001 AS DOUBLE) AS fresh_chamfer_mse FROM lineitem GROUP BY ALL))"""

RATE_CTES = """
rate AS MATERIALIZED (SELECT CASE WHEN l_linestatus = 'F' THEN 'validation' ELSE 'ood' END AS split,
  CASE l_returnflag WHEN 'A' THEN 'fps' WHEN 'N' THEN 'free' ELSE 'strict_subset' END AS method,
  CAST((year(l_shipdate) - 1994) * 4 AS INTEGER) AS constellation_size,
  sqrt(avg(l_tax) + CAST(0.001 AS DOUBLE)) AS chamfer_rmse
  FROM lineitem GROUP BY ALL)"""


def stability_rows(spark: SparkSession, folder: str, by_method: bool = True) -> DataFrame:
    """Factorial rows with a split (cloud parity), a family and, if asked for, a method (return flag)."""
    method = [F.when(F.col("l_returnflag") == "A", "fps").otherwise("refiner").alias("method")] if by_method else []
    return table(spark, folder, "lineitem").groupBy(
        F.when(F.col("l_linestatus") == "F", "baseline").otherwise("stabilized").alias("arm"),
        F.col("l_linenumber").cast("int").alias("decoder_seed"), (F.year("l_shipdate") % 3).cast("int").alias("refiner_seed"),
        F.when(F.col("l_suppkey") % 2 == 0, "validation").otherwise("ood").alias("split"), *method,
        F.concat(F.lit("family_"), (F.col("l_suppkey") % 7).cast("string")).alias("family"),
        F.col("l_suppkey").cast("string").alias("model_id"),
    ).agg(*[(F.round(F.avg(F.col(c) + F.lit(0.0)), 9) + F.lit(0.001)).alias(m) for c, m in (("l_tax", "chamfer_mse"), ("l_discount", "fresh_chamfer_mse"))])


def stability_long(spark: SparkSession, folder: str) -> DataFrame:
    """Stability rows once per metric, with the loss as ``chamfer_mse``."""
    metrics = F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).alias("_m")) for m, c in (("chamfer_rmse", "chamfer_mse"), ("fresh_chamfer_rmse", "fresh_chamfer_mse"))]))
    rows = stability_rows(spark, folder)
    return rows.select(*[c for c in rows.columns if not c.endswith("_mse")], metrics).withColumnRenamed("_m", "chamfer_mse")


STABILITY_CTES = """
stb AS MATERIALIZED (SELECT CASE WHEN l_linestatus = 'F' THEN 'baseline' ELSE 'stabilized' END AS arm, l_linenumber AS decoder_seed,
  CAST(year(l_shipdate) % 3 AS INTEGER) AS refiner_seed, CASE WHEN l_suppkey % 2 = 0 THEN 'validation' ELSE 'ood' END AS split,
  CASE WHEN l_returnflag = 'A' THEN 'fps' ELSE 'refiner' END AS method, CAST(l_suppkey AS VARCHAR) AS model_id,
  round(avg(l_tax), 9) + CAST(0.001 AS DOUBLE) AS chamfer_mse, round(avg(l_discount), 9) + CAST(0.001 AS DOUBLE) AS fresh_chamfer_mse FROM lineitem GROUP BY ALL),
stl AS (SELECT * EXCLUDE (chamfer_mse, fresh_chamfer_mse), 'chamfer_rmse' AS metric, chamfer_mse AS m FROM stb
  UNION ALL SELECT * EXCLUDE (chamfer_mse, fresh_chamfer_mse), 'fresh_chamfer_rmse', fresh_chamfer_mse FROM stb)"""

STABILITY_FRESH_CTES = """
sf AS MATERIALIZED (SELECT CASE WHEN l_linestatus = 'F' THEN 'baseline' ELSE 'stabilized' END AS arm, l_linenumber AS decoder_seed,
  CAST(year(l_shipdate) % 3 AS INTEGER) AS refiner_seed, CASE WHEN l_suppkey % 2 = 0 THEN 'validation' ELSE 'ood' END AS split,
  'family_' || CAST(l_suppkey % 7 AS VARCHAR) AS family, CAST(l_suppkey AS VARCHAR) AS model_id,
  round(avg(l_tax), 9) + CAST(0.001 AS DOUBLE) AS chamfer_mse, round(avg(l_discount), 9) + CAST(0.001 AS DOUBLE) AS fresh_chamfer_mse
  FROM lineitem GROUP BY ALL)"""
