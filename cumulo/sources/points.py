"""ASCII PLY point files and metric logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cumulo.functions.lattice import short_decimal
from cumulo.session import cut_lineage
from cumulo.sources.meshes import _finite, _number, _texts, file_lines, found_files

AXES = ("x", "y", "z")
NORMALS = ("nx", "ny", "nz")


def read_ply(spark: SparkSession, root: str, glob: str = "*.ply") -> tuple[DataFrame, DataFrame]:
    """(points, rejected) of ASCII PLY files; ``cloud_id`` is the relative path.

    Properties are found by name; vertex rows are the first ``element vertex``
    count of lines after the header.
    """
    files = found_files(spark, root, glob)
    lines = file_lines(spark, root, glob, files)
    ends = cut_lineage(lines.filter("text = 'end_header'").groupBy("mesh_id").agg(F.min("line").alias("_end")))
    # No header is longer than the longest, so the other lines need not meet their file's end.
    longest = max(ends.agg(F.max("_end")).first()[0] or 0, 2)
    first = lines.filter(F.col("line") <= longest).join(ends, "mesh_id", "left").filter("line <= _end OR line <= 2")
    ordered = F.array_sort(F.collect_list(F.struct("line", "text")))
    heads = first.groupBy("mesh_id").agg(F.transform(ordered, lambda r: r["text"]).alias("_head"), F.any_value("_end").alias("_end"))
    # Walk the header once: which element a property belongs to, and the vertex count.
    start = F.struct(F.lit("").alias("element"), F.lit(None).cast("int").alias("n"), F.array().cast("array<string>").alias("names"))

    def step(state: Column, text: Column) -> Column:
        f = F.split(text, " ")
        element = F.get(f, F.lit(0)) == "element"
        vertex = element & (F.get(f, F.lit(1)) == "vertex")
        own = (F.get(f, F.lit(0)) == "property") & (state["element"] == "vertex")
        return F.struct(
            F.when(element, F.coalesce(F.get(f, F.lit(1)), F.lit(""))).otherwise(state["element"]).alias("element"),
            F.when(vertex, F.get(f, F.lit(2)).try_cast("int")).otherwise(state["n"]).alias("n"),
            F.when(own, F.concat(state["names"], F.array(F.element_at(f, -1)))).otherwise(state["names"]).alias("names"),
        )

    heads = heads.withColumn("_h", F.aggregate("_head", start, step))
    heads = cut_lineage(heads.select("mesh_id", F.slice("_head", 1, 2).alias("_head"), "_end", F.col("_h.n").alias("_n"), *[
        (F.array_position(F.col("_h.names"), a).cast("int") - 1).alias(f"_p{a}") for a in AXES]))
    body = lines.join(heads.select("mesh_id", "_end", "_n", *[f"_p{a}" for a in AXES]), "mesh_id").filter(
        (F.col("line") > F.col("_end")) & (F.col("line") <= F.col("_end") + F.col("_n")))
    fields = F.split("text", " ")
    points = body.select(
        F.col("mesh_id").alias("cloud_id"), (F.col("line") - F.col("_end") - 1).alias("point_id"),
        *[_number(F.get(fields, F.col(f"_p{a}"))).alias(a) for a in AXES], (F.col("text") != "").alias("_filled"))
    finite = _finite(F.col("x")) & _finite(F.col("y")) & _finite(F.col("z"))
    present = points.groupBy(F.col("cloud_id").alias("mesh_id")).agg(F.count_if("_filled").alias("_present"), F.count_if(~finite).alias("_broken"))
    problem = (
        F.when(F.coalesce(F.get("_head", F.lit(0)), F.lit("")) != "ply", "not a PLY file")
        .when(F.coalesce(F.get("_head", F.lit(1)), F.lit("")) != "format ascii 1.0", "not ASCII PLY 1.0")
        .when(F.col("_end").isNull(), "the header has no end").when(F.col("_n").isNull() | (F.col("_n") < 1), "no vertices are announced")
        .when((F.col("_px") < 0) | (F.col("_py") < 0) | (F.col("_pz") < 0), "x, y or z is not among the properties")
        .when(F.coalesce("_present", F.lit(0)) < F.col("_n"), "fewer vertices than announced")
        .when(F.col("_broken") > 0, "a coordinate is not a finite number")
    )
    judged = files.select("mesh_id").join(heads, "mesh_id", "left").join(present, "mesh_id", "left").withColumn("reason", problem)
    rejected = cut_lineage(judged.filter("reason IS NOT NULL").select(F.col("mesh_id").alias("cloud_id"), "reason"))
    # The points are many and stay where they are if no file is rejected.
    kept = points if rejected.isEmpty() else points.join(rejected.select("cloud_id"), "cloud_id", "left_anti")
    return kept.drop("_filled"), rejected


def ply_text(points: DataFrame) -> DataFrame:
    """One PLY document per cloud: (cloud_id, value). A document is one file, hence one row."""
    names = [*AXES, *(NORMALS if "nx" in points.columns else ())]
    line = F.concat_ws(" ", *[short_decimal(F.col(n), 9) for n in names])
    body = points.groupBy("cloud_id").agg(F.array_sort(F.collect_list(F.struct("point_id", line.alias("t")))).alias("_rows"))
    header = F.concat(
        F.lit("ply\nformat ascii 1.0\nelement vertex "), F.size("_rows").cast("string"), F.lit("\n"),
        F.lit("".join(f"property float {n}\n" for n in names)), F.lit("end_header\n"),
    )
    return body.select("cloud_id", F.concat(header, F.array_join(F.transform("_rows", lambda r: r["t"]), "\n")).alias("value"))


def write_ply(points: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder per cloud holding its PLY text."""
    ply_text(points).write.mode(mode).partitionBy("cloud_id").text(path)


# The metric names of the measuring tool's log and how each line is labelled.
LOG_METRICS = {
    "d1_mse": ("mseF", "p2point"), "d1_psnr_db": ("mseF,PSNR", "p2point"), "d2_mse": ("mseF", "p2plane"), "d2_psnr_db": ("mseF,PSNR", "p2plane"),
    "d1_hausdorff": ("h.", "p2point"), "d1_hausdorff_psnr_db": ("h.,PSNR", "p2point"),
    "d2_hausdorff": ("h.", "p2plane"), "d2_hausdorff_psnr_db": ("h.,PSNR", "p2plane"),
}


#: A decimal with an optional exponent, or one of the two words for what is none.
DECIMAL = r"[+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|inf)|nan"


def metrics_from_text(logs: DataFrame, text: str = "value") -> tuple[DataFrame, DataFrame]:
    """Named numbers of each log; logs that lack one are rejected with its name."""
    keys = [c for c in logs.columns if c != text]

    def found(label: str, kind: str) -> Column:
        pattern = label.replace(".", r"\.") + r"\s+\(" + kind + r"\):\s*(" + DECIMAL + ")"
        return F.regexp_extract(text, pattern, 1).try_cast("double")

    read = logs.select(*keys, *[found(*where).alias(name) for name, where in LOG_METRICS.items()])
    missing = F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in LOG_METRICS]))
    judged = read.withColumn("_missing", missing)
    return (
        judged.filter(F.size("_missing") == 0).drop("_missing"),
        judged.filter(F.size("_missing") > 0).select(*keys, F.concat(F.lit("missing "), F.array_join("_missing", ", ")).alias("reason")),
    )


def read_metric_logs(spark: SparkSession, root: str, glob: str = "*.log") -> tuple[DataFrame, DataFrame]:
    return metrics_from_text(_texts(spark, root, glob).withColumnRenamed("mesh_id", "log"))
