"""OBJ and OFF mesh files as vertex and face tables.

Files are read by splits, so one large file is the work of many tasks. Line numbers,
vertex counts and face numbers are prefix folds: a running count inside a split plus
what the splits before it hold. A broken file is reported with path, line and reason,
and none of its rows are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cumulo.operators.grouping import dealt_if_many
from cumulo.operators.ranking import top_per_key
from cumulo.session import cut_lineage
from cumulo.sources.listing import is_packed, split_lines, walked_files

AXES = ("x", "y", "z")


def _relative(root: str) -> Column:
    """File path below the root folder."""
    return F.regexp_replace(F.col("path"), "^.*?" + _quoted(root.rstrip("/")) + "/", "")


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def file_catalog(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Every file below ``root``: relative path, size and SHA-256 of its bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return files.select(
        F.col("path").alias("file"), _relative(root).alias("mesh"), "length", F.sha2("content", 256).alias("mesh_sha256")
    )


def nested_catalog(spark: SparkSession, root: str) -> DataFrame:
    """``<category>/<model>/models/model_normalized.obj`` files with their ids."""
    rule = r"^([^/]+)/([^/]+)/models/model_normalized\.obj$"
    found = file_catalog(spark, root, "model_normalized.obj").filter(F.col("mesh").rlike(rule))
    return found.select(
        F.regexp_extract("mesh", rule, 1).alias("category"), F.regexp_extract("mesh", rule, 2).alias("model_id"), "mesh", "mesh_sha256"
    )


def official_catalog(spark: SparkSession, root: str) -> DataFrame:
    """``<class>/<train|test>/*.off`` files with class, id and official split."""
    rule = r"^([^/]+)/(train|test)/([^/]+)\.off$"
    found = file_catalog(spark, root, "*.off").filter(F.col("mesh").rlike(rule))
    return found.select(
        F.regexp_extract("mesh", rule, 1).alias("category"), F.regexp_extract("mesh", rule, 3).alias("model_id"), "mesh", "mesh_sha256",
        F.regexp_extract("mesh", rule, 2).alias("official_split"),
    )


def uneven_categories(catalog: DataFrame) -> DataFrame:
    """Categories that appear in only one official split."""
    sides = catalog.groupBy("category").agg(F.count_distinct("official_split").alias("_n"), F.min("official_split").alias("only_in"))
    return sides.filter("_n < 2").select("category", "only_in")


def _texts(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """Whole small files, one row each."""
    read = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return read.select(F.col("_metadata.file_path").alias("path"), "value").select(
        F.regexp_replace(_relative(root), "^file:", "").alias("mesh_id"), "value"
    )


def found_files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(mesh_id, path, length) of every file, empty ones too; stored, no content is read."""
    walked = walked_files(spark, root, glob)
    if walked is not None:
        return walked
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return cut_lineage(files.select(F.regexp_replace(_relative(root), "^file:", "").alias("mesh_id"), F.lit(None).cast("string").alias("path"), "length"))


def file_names(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """``mesh_id`` of every file, empty ones too; no content is read."""
    return found_files(spark, root, glob).select("mesh_id")


def file_lines(spark: SparkSession, root: str, glob: str, files: DataFrame | None = None) -> DataFrame:
    """(mesh_id, block, line, text): the lines of all files with single blanks, numbered from 1; stored.

    ``block`` is the offset of the split that a line was read in. Inside a split
    rows are numbered as they come; what the splits before hold is added. ``files``
    is what ``found_files`` found.
    """
    files = found_files(spark, root, glob) if files is None else files
    text = F.trim(F.regexp_replace("value", r"\s+", " ")).alias("text")
    if files.filter("path IS NULL").isEmpty() and not is_packed(files):
        rows = cut_lineage(split_lines(files).select("mesh_id", "block", F.col("number").alias("_id"), text))
    else:
        raw = spark.read.text(root, recursiveFileLookup=True, pathGlobFilter=glob).select(
            F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("_id"), text)
        rows = cut_lineage(raw.select(F.regexp_replace(_relative(root), "^file:", "").alias("mesh_id"), "block", "_id", "text"))
    blocks = rows.groupBy("mesh_id", "block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    start = (F.coalesce(F.sum("_n").over(_before_block()), F.lit(0)) - F.col("_first") + 1).alias("_start")
    # Only what differs from 0 is joined: nothing, mostly, where tasks number the lines of small files from 1.
    shifts = blocks.select("mesh_id", "block", start).filter("_start <> 0")
    return rows.join(shifts, ["mesh_id", "block"], "left").select(
        "mesh_id", "block", (F.coalesce("_start", F.lit(0)) + F.col("_id")).alias("line"), "text")


def _before_block() -> Window:
    return Window.partitionBy("mesh_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)


def running_total(rows: DataFrame, amount: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``amount`` (not negative) over a file's rows up to and with this one."""
    inside = Window.partitionBy("mesh_id", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    counted = dealt_if_many(rows, ["mesh_id", "block"], rows.count()).withColumn("_in", F.sum(amount.cast("bigint")).over(inside))
    blocks = rows.groupBy("mesh_id", "block").agg(F.sum(amount.cast("bigint")).alias("_n"))
    # The splits before a file's first one hold nothing.
    before = blocks.select("mesh_id", "block", F.sum("_n").over(_before_block()).alias("_before")).filter("_before > 0")
    return counted.join(before, ["mesh_id", "block"], "left").withColumn(
        name, F.coalesce("_before", F.lit(0)) + F.col("_in")).drop("_before", "_in")


def _number(text: Column) -> Column:
    """Single-precision value of a decimal token, NULL if it is not one."""
    plain = text.rlike(r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$")
    return F.when(plain, text.try_cast("double").cast("float").cast("double"))


def _finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def _fan(ring: str = "ring") -> Column:
    """Triangles of a polygon that share its first corner."""
    return F.posexplode(F.transform(
        F.sequence(F.lit(1), F.size(ring) - 2),
        lambda i: F.struct(F.get(ring, F.lit(0)).alias("a"), F.get(ring, i).alias("b"), F.get(ring, i + 1).alias("c")),
    )).alias("_fan", "t")


def _finish(rows: DataFrame, errors: DataFrame | None, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Drop files with errors, triangulate polygons and number the faces.

    ``rows`` (stored): a vertex (``is_vertex``, ``vertex_ix``, x, y, z) or a polygon (``ring``) of each line, or why it is
    none (``reason``). ``errors`` are those of whole files.
    """
    corners = F.size("ring") - 2
    whole = F.col("reason").isNull() & ~F.col("is_vertex")
    sums = rows.groupBy("mesh_id").agg(F.count_if("is_vertex").alias("_v"), F.sum(F.when(whole, corners)).alias("_f"))
    broken = rows.filter("reason IS NOT NULL").select("mesh_id", "line", "reason")
    broken = broken if errors is None else broken.unionByName(errors)
    empty = files.select("mesh_id").join(sums, "mesh_id", "left").filter((F.coalesce("_v", F.lit(0)) < 3) | (F.coalesce("_f", F.lit(0)) < 1)).join(
        broken.select("mesh_id").distinct(), "mesh_id", "left_anti"
    ).select("mesh_id", F.lit(None).cast("bigint").alias("line"), F.lit("too few vertices or faces").alias("reason"))
    rejected = cut_lineage(broken.unionByName(empty))
    # The rows are many and stay where they are if no file is rejected.
    kept = rows if rejected.isEmpty() else rows.join(rejected.select("mesh_id").distinct(), "mesh_id", "left_anti")
    numbered = running_total(kept.filter("NOT is_vertex").select("mesh_id", "block", "line", "ring"), corners, "_upto")
    first = (F.col("_upto") - corners).alias("_start")
    faces = numbered.select("mesh_id", first, _fan()).select("mesh_id", (F.col("_start") + F.col("_fan")).cast("int").alias("face_ix"), "t.*")
    return kept.filter("is_vertex").select("mesh_id", "vertex_ix", *AXES), faces.select("mesh_id", "face_ix", "a", "b", "c"), rejected


def _judged(rows: DataFrame, problem: Column) -> DataFrame:
    """Stored rows with the reason why a vertex or a polygon is none."""
    finite = _finite(F.col("x")) & _finite(F.col("y")) & _finite(F.col("z"))
    reason = F.when(F.col("is_vertex"), F.when(~finite, "a coordinate is not a finite number")).otherwise(problem)
    return cut_lineage(rows.select("mesh_id", "block", "line", "is_vertex", "vertex_ix", *AXES, "ring", reason.alias("reason")))


def _obj(lines: DataFrame) -> DataFrame:
    parts = lines.withColumn("f", F.split("text", " ")).filter(F.col("text") != "")
    kind, width = F.get("f", F.lit(0)), F.size("f")
    used = parts.filter(kind.isin("v", "f") & (width >= 4)).select("mesh_id", "block", "line", "f", (kind == "v").alias("is_vertex"))
    used = running_total(used, F.col("is_vertex").cast("int"), "_seen").withColumn("_seen", F.col("_seen").cast("int"))

    def index(token: Column) -> Column:
        number = F.get(F.split(token, "/"), F.lit(0)).try_cast("int")
        return F.when(number > 0, number - 1).otherwise(F.col("_seen") + number)

    own = F.col("is_vertex")
    read = used.withColumns({
        "vertex_ix": F.when(own, F.col("_seen") - 1), "ring": F.when(~own, F.transform(F.slice("f", 2, F.size("f")), index)),
        **{a: F.when(own, _number(F.get("f", F.lit(i + 1)))) for i, a in enumerate(AXES)}})
    problem = F.when(F.col("_seen") == 0, "a face comes before any vertex").when(
        F.exists("ring", lambda i: i.isNull()), "a corner has no usable index"
    ).when(F.exists("ring", lambda i: (i < 0) | (i >= F.col("_seen"))), "a corner points past the vertices so far")
    return _judged(read, problem)


def read_obj(spark: SparkSession, root: str, glob: str = "*.obj") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vertices, faces, rejected) of all OBJ files below ``root``; ``mesh_id`` is the relative path."""
    files = found_files(spark, root, glob)
    return _finish(_obj(file_lines(spark, root, glob, files)), None, files)


def _off(lines: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    content = lines.withColumn("text", F.trim(F.regexp_replace("text", "#.*$", ""))).filter(F.col("text") != "")
    fields = F.split("text", " ")
    heads = top_per_key(content.select("mesh_id", "line", "text"), ["mesh_id"], [F.col("line")], 2).groupBy("mesh_id").agg(
        F.max(F.when(F.col("rank") == 1, fields)).alias("_head"), F.max(F.when(F.col("rank") == 2, fields)).alias("_next"))
    heads = files.select("mesh_id").join(heads, "mesh_id", "left").join(
        content.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("_lines")), "mesh_id", "left")
    magic, rest = F.get("_head", F.lit(0)), F.slice("_head", 2, F.greatest(F.size("_head"), F.lit(1)))
    fused = magic.rlike(r"^OFF\d+$")
    inline = F.when(magic == "OFF", rest).when(fused, F.concat(F.array(F.substring(magic, 4, 20)), rest))
    heads = heads.withColumn("_inline", inline).withColumn(
        "_counts", F.when(F.size("_inline") > 0, F.col("_inline")).otherwise(F.col("_next"))
    ).withColumn("_first", F.when(F.size("_inline") > 0, 1).otherwise(2))
    heads = heads.withColumns({"_v": F.get("_counts", F.lit(0)).try_cast("int"), "_f": F.get("_counts", F.lit(1)).try_cast("int")})
    problem = (
        F.when(F.col("_head").isNull(), "nothing in the file").when(F.col("_inline").isNull(), "no OFF header")
        .when(F.col("_counts").isNull(), "no line of counts").when(F.col("_v").isNull() | F.col("_f").isNull(), "counts are not whole numbers")
        .when((F.col("_v") < 3) | (F.col("_f") < 1), "too few vertices or faces")
        .when(F.col("_lines") - F.col("_first") < F.col("_v") + F.col("_f"), "fewer rows than the counts say")
    )
    heads = cut_lineage(heads.select("mesh_id", "_v", "_f", "_first", problem.alias("reason")))
    file_errors = heads.filter("reason IS NOT NULL").select("mesh_id", F.lit(1).cast("bigint").alias("line"), "reason")
    placed = running_total(content, F.lit(1), "_at").withColumn("f", fields)
    body = placed.join(heads.filter("reason IS NULL").drop("reason"), "mesh_id").withColumn(
        "_row", F.col("_at") - 1 - F.col("_first")).filter("_row >= 0 AND _row < _v + _f")
    own, size = F.col("_row") < F.col("_v"), F.get("f", F.lit(0)).try_cast("int")
    ring = F.when(size >= 3, F.transform(F.slice("f", 2, size), lambda t: t.try_cast("int")))
    read = body.withColumns({
        "is_vertex": own, "vertex_ix": F.when(own, F.col("_row").cast("int")), "_size": F.when(~own, size), "ring": F.when(~own, ring),
        **{a: F.when(own, _number(F.get("f", F.lit(i)))) for i, a in enumerate(AXES)}})
    broken = F.when(
        F.col("_size").isNull() | (F.col("_size") < 3) | (F.size("ring") < F.col("_size")) | F.exists("ring", lambda i: i.isNull()), "a face lacks corners"
    ).when(F.exists("ring", lambda i: (i < 0) | (i >= F.col("_v"))), "a corner points past the vertices")
    return _judged(read, broken), file_errors


def read_off(spark: SparkSession, root: str, glob: str = "*.off") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vertices, faces, rejected) of all OFF files below ``root``."""
    files = found_files(spark, root, glob)
    return _finish(*_off(file_lines(spark, root, glob, files), files), files)


def read_meshes(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both formats by lower-cased suffix; other files are rejected by name and not read."""
    first, second = read_obj(spark, root, "*.[oO][bB][jJ]"), read_off(spark, root, "*.[oO][fF][fF]")
    suffix = F.lower(F.regexp_extract("mesh_id", r"\.([^./]+)$", 1))
    other = file_names(spark, root, "*").filter(~suffix.isin("obj", "off")).select(
        "mesh_id", F.lit(None).cast("bigint").alias("line"), F.lit("neither OBJ nor OFF").alias("reason")
    )
    return first[0].unionByName(second[0]), first[1].unionByName(second[1]), first[2].unionByName(second[2]).unionByName(other)
