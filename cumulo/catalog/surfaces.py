"""Queries over planes and triangle surfaces, with checks in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cumulo.catalog.geometry import BITS
from cumulo.catalog.sqltext import d, hash_uniform, out, s
from cumulo.catalog.views import AXES, EMBED_CTES, EVENT_CTES, LINE_CTES, embedding_clouds, event_clouds, lineitem_points, raw_event_clouds
from cumulo.functions import formulas as fm
from cumulo.operators import plane as pl
from cumulo.operators import surface as sf
from cumulo.operators.grouping import cloud_sizes, task_count
from cumulo.operators.neighbors import nearest
from cumulo.operators.ranking import rank_in_group
from cumulo.session import cut_lineage, ensure_checkpoint_dir
from cumulo.sources.listing import write_texts
from cumulo.sources.meshes import read_obj, read_off
from cumulo.sources.points import read_ply

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(build):
        QUERIES[build.__name__] = build
        if sql is not None:
            SQL[build.__name__] = sql
        return build
    return register


_PAIRS = [(a, b) for i, a in enumerate(AXES) for b in AXES[i:]]
MOMENTS = f"mo AS (SELECT cloud_id, count(*) AS n, {', '.join(f'avg({a}) AS m{a}' for a in AXES)}, {', '.join(f'covar_pop({a}, {b}) AS c{a}{b}' for a, b in _PAIRS)} FROM li GROUP BY cloud_id)"
EIGEN = f"""q1 AS (SELECT *, (cxx + cyy + czz) / {d(3.0)} AS q FROM mo),
 q2 AS (SELECT *, sqrt(((cxx - q) * (cxx - q) + (cyy - q) * (cyy - q) + (czz - q) * (czz - q) + 2 * (cxy * cxy + cxz * cxz + cyz * cyz)) / {d(6.0)}) AS p FROM q1),
 q3 AS (SELECT *, ((cxx - q) * ((cyy - q) * (czz - q) - cyz * cyz) - cxy * (cxy * (czz - q) - cyz * cxz) + cxz * (cxy * cyz - (cyy - q) * cxz)) / (2 * p * p * p) AS dt FROM q2),
 q4 AS (SELECT *, acos(greatest(least(dt, {d(1.0)}), {d(-1.0)})) / {d(3.0)} AS t FROM q3), ei AS (SELECT *, q + 2 * p * cos(t) AS e1, q + 2 * p * cos(t + {d(2.0943951023931953)}) AS e3 FROM q4)"""


@query(f"WITH {LINE_CTES}, {MOMENTS} SELECT cloud_id, n, {', '.join(f'{out(f"m{a}")} AS m{a}' for a in AXES)}, {', '.join(f'{out(f"c{a}{b}")} AS c{a}{b}' for a, b in _PAIRS)} FROM mo")
def plane_moments(spark: SparkSession, folder: str) -> DataFrame:
    """Centroid and covariance of every supplier cloud."""
    found = pl.plane_moments(lineitem_points(spark, folder))
    return found.select("cloud_id", "n", *[fm.out(F.col(c)).alias(c) for c in found.columns if c not in ("cloud_id", "n")])


@query(f"WITH {LINE_CTES}, {MOMENTS}, {EIGEN} SELECT cloud_id, {out('sqrt(greatest(e3, 0))')} AS plane_rmse, {out('e1')} AS e1, {out('3 * q - e1 - e3')} AS e2 FROM ei")
def plane_rmse(spark: SparkSession, folder: str) -> DataFrame:
    """Distance of every cloud to its best plane."""
    planes, _ = pl.fit_planes(lineitem_points(spark, folder))
    return planes.select("cloud_id", *[fm.out(F.col(c)).alias(c) for c in ("plane_rmse", "e1", "e2")])


@query()
def plane_report(spark: SparkSession, folder: str) -> DataFrame:
    """Four-corner coding of each cloud: counts, bytes, Chamfer, Hausdorff and plane error."""
    points = event_clouds(spark, folder)
    # Corners and their samples have a fixed size per cloud; both are read several times.
    corners = cut_lineage(pl.plane_corners(points)[0])
    decoded = cut_lineage(pl.decode_corners(corners, 64))
    columns = ["cloud_id", "point_id", *AXES]
    forward = nearest(decoded, points.select(*columns)).groupBy("cloud_id").agg(F.avg("d2").alias("_f"), F.max("d2").alias("_fm"))
    backward = nearest(points.select(*columns), decoded).groupBy("cloud_id").agg(F.avg("d2").alias("_b"), F.max("d2").alias("_bm"), F.count(F.lit(1)).alias("input_points"))
    joined = forward.join(backward, "cloud_id").join(pl.corner_plane_error(points, corners), "cloud_id")
    return joined.select(
        "cloud_id", "input_points", F.lit(4).alias("stored_points"), fm.out(F.col("input_points") / F.lit(4.0)).alias("point_ratio"),
        (F.col("input_points") * 24).alias("input_bytes"), F.lit(96).alias("stored_bytes"),
        fm.out(F.sqrt(F.lit(0.5) * (F.col("_f") + F.col("_b")))).alias("chamfer_rmse"), fm.out(F.sqrt(F.greatest("_fm", "_bm"))).alias("hausdorff"),
        fm.out(F.col("corner_plane_rmse")).alias("plane_rmse"),
    )


def strip_mesh(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Each event cloud as a triangle strip over its points in id order."""
    # Read once per corner and for the sizes.
    points = cut_lineage(rank_in_group(event_clouds(spark, folder), ["cloud_id"], ["point_id"], rank="vertex_ix"))
    vertices = points.select(F.col("cloud_id").alias("mesh_id"), F.col("vertex_ix").cast("int").alias("vertex_ix"), *AXES)
    sizes = vertices.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n"))
    faces = vertices.join(sizes, "mesh_id").filter(F.col("vertex_ix") < F.col("n") - 2).select(
        "mesh_id", F.col("vertex_ix").alias("face_ix"), F.col("vertex_ix").alias("a"), (F.col("vertex_ix") + 1).alias("b"), (F.col("vertex_ix") + 2).alias("c")
    )
    return vertices, faces


_E = {f"{e}{x}": f"({e}.{x} - a.{x})" for e in "bc" for x in AXES}
STRIP = f"""vx AS MATERIALIZED (SELECT cloud_id AS mesh_id, x, y, z, CAST(row_number() OVER (PARTITION BY cloud_id ORDER BY point_id) - 1 AS INTEGER) AS i FROM ev),
 tri AS (SELECT a.mesh_id, a.i AS face_ix, {', '.join(f'{p}.{x} AS {p}{x}' for p in 'abc' for x in AXES)}, {_E['by']} * {_E['cz']} - {_E['bz']} * {_E['cy']} AS kx, {_E['bz']} * {_E['cx']} - {_E['bx']} * {_E['cz']} AS ky, {_E['bx']} * {_E['cy']} - {_E['by']} * {_E['cx']} AS kz
   FROM vx a JOIN vx b ON b.mesh_id = a.mesh_id AND b.i = a.i + 1 JOIN vx c ON c.mesh_id = a.mesh_id AND c.i = a.i + 2),
 geo AS MATERIALIZED (SELECT * FROM (SELECT *, sqrt(kx * kx + ky * ky + kz * kz) AS area FROM tri) WHERE area > {d(1e-12)})"""


@query(f"WITH {EVENT_CTES}, {STRIP} SELECT mesh_id, face_ix, {out('area')} AS double_area, {', '.join(f'{out(f"k{x} / area")} AS n{x}' for x in AXES)} FROM geo")
def triangle_geometry(spark: SparkSession, folder: str) -> DataFrame:
    """Area and normal of every strip triangle."""
    geometry = sf.face_geometry(*strip_mesh(spark, folder))
    return geometry.select("mesh_id", "face_ix", *[fm.out(F.col(c)).alias(c) for c in ("double_area", "nx", "ny", "nz")])


DRAWS = 256
_U = lambda name: hash_uniform("'surface'", "mesh_id", "role", s("draw"), f"'{name}'")
SURFACE = f"""WITH {EVENT_CTES}, {STRIP}, wt AS (SELECT mesh_id, face_ix, CAST(round_even(area / sum(area) OVER (PARTITION BY mesh_id) * {d(float(2**60))}, 0) AS BIGINT) AS w FROM geo),
 iv AS MATERIALIZED (SELECT mesh_id, face_ix, sum(w) OVER (PARTITION BY mesh_id ORDER BY face_ix) - w AS lo, sum(w) OVER (PARTITION BY mesh_id ORDER BY face_ix) AS hi, sum(w) OVER (PARTITION BY mesh_id) AS tot FROM wt),
 ms AS (SELECT DISTINCT mesh_id, tot FROM iv), dr AS (SELECT mesh_id, role, draw, CAST(floor({_U('face')} * tot) AS BIGINT) AS at, sqrt({_U('first')}) AS f, {_U('second')} AS g FROM ms, (VALUES ('source'), ('target')) v(role), range({DRAWS}) t(draw))
SELECT d.mesh_id, d.role, d.draw AS point_id, g0.face_ix, {', '.join(out(f"({d(1.0)} - d.f) * g0.a{x} + d.f * ({d(1.0)} - d.g) * g0.b{x} + d.f * d.g * g0.c{x}") + f' AS {x}' for x in AXES)}
FROM dr d JOIN iv ON iv.mesh_id = d.mesh_id AND d.at >= iv.lo AND d.at < iv.hi JOIN geo g0 ON g0.mesh_id = iv.mesh_id AND g0.face_ix = iv.face_ix"""


@query(SURFACE)
def surface_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Area-weighted points of every mesh for each of two roles."""
    drawn = sf.sample_surface(sf.face_geometry(*strip_mesh(spark, folder)), DRAWS, seed="surface")
    return drawn.select("mesh_id", "role", "point_id", "face_ix", *[fm.out(F.col(a)).alias(a) for a in AXES])


@query(f"""WITH {EMBED_CTES}, t AS (SELECT cloud_id, point_id, printf('%.9g', round(x, 3) + {d(0.0)}) || ' ' || printf('%.9g', round(y, 3) + {d(0.0)}) || ' ' || printf('%.9g', round(z, 3) + {d(0.0)}) AS l FROM em)
SELECT cloud_id, sha256('ply' || chr(10) || 'format ascii 1.0' || chr(10) || 'element vertex ' || count(*) || chr(10) || 'property float x' || chr(10) || 'property float y' || chr(10) || 'property float z' || chr(10) || 'end_header' || chr(10) || string_agg(l, chr(10) ORDER BY point_id)) AS digest FROM t GROUP BY cloud_id""")
def ply_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Digest of the PLY text of every cloud."""
    from cumulo.sources.points import ply_text
    points = embedding_clouds(spark, folder).withColumns({a: F.round(a, 3) + F.lit(0.0) for a in AXES})
    return ply_text(points).select("cloud_id", F.sha2("value", 256).alias("digest"))


METRIC_NAMES = ("d1_mse", "d1_psnr_db", "d2_mse", "d2_psnr_db", "d1_hausdorff", "d1_hausdorff_psnr_db", "d2_hausdorff", "d2_hausdorff_psnr_db")


@query(f"""SELECT CAST(c_custkey AS BIGINT) AS log, {', '.join(f"c_acctbal + {d(float(i))} AS {name}" for i, name in enumerate(METRIC_NAMES))} FROM customer""")
def metric_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers read back out of log text made from customer balances."""
    from cumulo.sources.points import LOG_METRICS, metrics_from_text
    rows = spark.read.parquet(f"{folder}/customer.parquet")
    lines = [
        F.concat(F.lit(f"   {label}  ({kind}): "), (F.col("c_acctbal") + F.lit(float(i))).cast("string"), F.lit("\n"))
        for i, (label, kind) in enumerate(LOG_METRICS[name] for name in METRIC_NAMES)
    ]
    read, _ = metrics_from_text(rows.select(F.col("c_custkey").cast("bigint").alias("log"), F.concat(*lines).alias("value")))
    return read.select("log", *METRIC_NAMES)


#: Files that one task writes, about: a small file costs more to make than its rows.
TASK_FILES = 256


def _event_lines(spark: SparkSession, folder: str, heads: list[str], vertex: str, face: str | None) -> str:
    """Writes one text file per event cloud, ``heads`` first, and returns the folder beside the checkpoints.

    Vertices are the events by id in whole numbers, faces the strip of every three in a row. Clouds are dealt
    to tasks by counted files and rows, and each task puts its own files in place.
    """
    raw = raw_event_clouds(spark, folder)
    rows, files = cloud_sizes(raw).filter("n >= 3").agg(F.sum("n"), F.count(F.lit(1))).first()
    tasks = max(task_count(raw, rows or 0), -(-files // TASK_FILES))
    ranked = rank_in_group(raw, ["cloud_id"], ["point_id"], rank="i").select(
        "cloud_id", "i", F.floor(F.col("x") * 100).alias("x"), F.col("y").cast("bigint").alias("y"), F.coalesce(F.col("z").cast("bigint"), F.lit(0)).alias("z"))
    sizes = ranked.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("n"))
    kept = ranked.join(sizes.filter("n >= 3"), "cloud_id")
    parts = [F.struct(F.lit(1).alias("part"), F.col("i").cast("bigint").alias("at"), F.concat_ws(" ", F.lit(vertex), "x", "y", "z").alias("value"))]
    if face is not None:
        offset = 1 if face == "f" else 0
        text = F.concat_ws(" ", F.lit(face), *[(F.col("i") + k + offset).cast("string") for k in range(3)])
        parts.append(F.when(F.col("i") < F.col("n") - 2, F.struct(F.lit(2).alias("part"), F.col("i").cast("bigint").alias("at"), text.alias("value"))))
    lines = kept.select("cloud_id", F.explode(F.array_compact(F.array(*parts))).alias("l")).select("cloud_id", "l.*")
    for at, head in enumerate(heads):
        filled = F.regexp_replace(F.regexp_replace(F.lit(head), "N", F.col("n").cast("string")), "M", (F.col("n") - 2).cast("string"))
        lines = lines.unionByName(sizes.filter("n >= 3").select("cloud_id", F.lit(0).alias("part"), F.lit(at).cast("bigint").alias("at"), filled.alias("value")))
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}"
    write_texts(lines.withColumn("value", F.trim("value")), "cloud_id", ["part", "at"], tasks, path)
    return path


_EVENT_VERTICES = f"""WITH {EVENT_CTES}, v AS (SELECT cloud_id, row_number() OVER (PARTITION BY cloud_id ORDER BY point_id) - 1 AS i, count(*) OVER (PARTITION BY cloud_id) AS n,
 CAST(floor(x * 100) AS BIGINT) AS vx, CAST(y AS BIGINT) AS vy, CAST(coalesce(z, 0) AS BIGINT) AS vz FROM raw)
SELECT cloud_id, count(*) AS vertices, CAST(sum((i + 1) * (vx + 2 * vy + 3 * vz)) AS BIGINT) AS weighted"""
_EVENT_MESHES = _EVENT_VERTICES + ", max(n) - 2 AS faces, CAST(sum(CASE WHEN i < n - 2 THEN 7 * i + 8 END) AS BIGINT) AS corners FROM v WHERE n >= 3 GROUP BY cloud_id"


def _cloud_of(name: str) -> Column:
    return F.regexp_extract(name, "cloud_id=([^/]+)/", 1).alias("cloud_id")


def _mesh_digest(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    weighted = F.sum((F.col("vertex_ix") + 1) * (F.col("x") + 2 * F.col("y") + 3 * F.col("z"))).cast("bigint").alias("weighted")
    left = vertices.groupBy(_cloud_of("mesh_id")).agg(F.count(F.lit(1)).alias("vertices"), weighted)
    right = faces.groupBy(_cloud_of("mesh_id")).agg(
        F.count(F.lit(1)).alias("faces"), F.sum(F.col("a") + 2 * F.col("b") + 3 * F.col("c") + F.col("face_ix")).cast("bigint").alias("corners"))
    return left.join(right, "cloud_id")


@query(_EVENT_MESHES)
def obj_files(spark: SparkSession, folder: str) -> DataFrame:
    """Event clouds written as OBJ files and read back by splits."""
    vertices, faces, _ = read_obj(spark, _event_lines(spark, folder, [], "v", "f"), "part-*")
    return _mesh_digest(vertices, faces)


@query(_EVENT_MESHES)
def off_files(spark: SparkSession, folder: str) -> DataFrame:
    """Event clouds written as OFF files and read back by splits."""
    vertices, faces, _ = read_off(spark, _event_lines(spark, folder, ["OFF", "N M 0"], "", "3"), "part-*")
    return _mesh_digest(vertices, faces)


@query(_EVENT_VERTICES + " FROM v WHERE n >= 3 GROUP BY cloud_id")
def ply_files(spark: SparkSession, folder: str) -> DataFrame:
    """Event clouds written as PLY files and read back by splits."""
    heads = ["ply", "format ascii 1.0", "element vertex N", *(f"property float {a}" for a in AXES), "end_header"]
    points, _ = read_ply(spark, _event_lines(spark, folder, heads, "", None), "part-*")
    weighted = F.sum((F.col("point_id") + 1) * (F.col("x") + 2 * F.col("y") + 3 * F.col("z"))).cast("bigint").alias("weighted")
    return points.groupBy(_cloud_of("cloud_id")).agg(F.count(F.lit(1)).alias("vertices"), weighted)
