"""Queries over clouds and anchor sets, each with its check in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cumulo.catalog.sqltext import d, d2, farthest, hash_uniform, index, out, random_subset, s, set_chamfer, snap, snapped
from cumulo.catalog.views import (
    AXES, EMBED_CTES, EVENT_CTES, LINE_CTES, NORMAL_CTES, embedding_clouds, event_clouds,
    event_clouds_with_normals, lineitem_points, raw_event_clouds,
)
from cumulo.functions import formulas as fm
from cumulo.functions import lattice as lt
from cumulo.operators import anchors as an
from cumulo.operators import folds as fo
from cumulo.operators import sampling as sm
from cumulo.operators.farthest import farthest_points, merge_path, normal_aware_points, seeded_merge
from cumulo.operators.neighbors import nearest, nearest_vectors, normal_variation, snap_to_cloud
from cumulo.operators.normalize import box_center_unit_radius, rigid_transform
from cumulo.operators.validate import check_points

K, BITS = 8, 12
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(build):
        QUERIES[build.__name__] = build
        if sql is not None:
            SQL[build.__name__] = sql
        return build
    return register


ROUND_TRIP = f"""WITH {EMBED_CTES} SELECT cloud_id, point_id, {', '.join(f'{index(a, BITS)} AS i{a}' for a in AXES)},
 {', '.join(f'{out(snap(a, BITS))} AS {a}' for a in AXES)} FROM em"""


@query(ROUND_TRIP)
def lattice_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Quantize and dequantize every point at 12 bits."""
    points = embedding_clouds(spark, folder)
    return points.select(
        "cloud_id", "point_id", *[lt.to_index(F.col(a), BITS).alias(f"i{a}") for a in AXES],
        *[fm.out(lt.snap(F.col(a), BITS)).alias(a) for a in AXES],
    )


def _error_sql(expression: str) -> str:
    position = f"(({expression} + {d(1.0)}) / {d(2.0 / 4095)})"
    return f"abs({position} - round_even({position}, 0))"


LATTICE_ERROR = f"""WITH {EMBED_CTES} SELECT cloud_id,
 {out(f"max(greatest({', '.join(_error_sql(a) for a in AXES)}))")} AS raw_error,
 bool_and(greatest({', '.join(_error_sql(snap(a, BITS)) for a in AXES)}) <= {d(1e-9)}) AS on_lattice FROM em GROUP BY cloud_id"""


@query(LATTICE_ERROR)
def lattice_error(spark: SparkSession, folder: str) -> DataFrame:
    """Largest distance to the lattice per cloud, before and after snapping."""
    points = embedding_clouds(spark, folder)
    raw = F.greatest(*[lt.index_error(F.col(a), BITS) for a in AXES])
    after = F.greatest(*[lt.index_error(lt.snap(F.col(a), BITS), BITS) for a in AXES])
    return points.groupBy("cloud_id").agg(
        fm.out(F.max(raw)).alias("raw_error"), F.bool_and(after <= 1e-9).alias("on_lattice")
    )


VALIDITY = f"""WITH {LINE_CTES}, marked AS (SELECT cloud_id, CASE WHEN NOT (x BETWEEN -1 AND 1 AND y * {d(1.001)} BETWEEN -1 AND 1 AND z BETWEEN -1 AND 1)
 THEN 'coordinate outside the domain' END AS r FROM li),
 st AS (SELECT cloud_id, count(*) AS n, count(r) AS bad FROM marked GROUP BY cloud_id)
SELECT reason, count(*) AS points, count(DISTINCT cloud_id) AS clouds FROM (SELECT cloud_id, coalesce(r, CASE WHEN bad > 0 THEN 'cloud has an invalid coordinate' END,
 CASE WHEN n < 600 THEN 'cloud has too few points' END, 'usable') AS reason FROM marked JOIN st USING (cloud_id)) GROUP BY reason"""


@query(VALIDITY)
def point_validity(spark: SparkSession, folder: str) -> DataFrame:
    """Usable and quarantined points by reason."""
    stretched = lineitem_points(spark, folder).withColumn("y", F.col("y") * F.lit(1.001))
    good, bad = check_points(stretched, minimum=600)
    return good.withColumn("reason", F.lit("usable")).unionByName(bad).groupBy("reason").agg(
        F.count(F.lit(1)).alias("points"), F.count_distinct("cloud_id").alias("clouds")
    )


@query(f"WITH {EVENT_CTES} SELECT cloud_id, point_id, {', '.join(f'{out(a)} AS {a}' for a in AXES)} FROM ev")
def normalize_clouds(spark: SparkSession, folder: str) -> DataFrame:
    """Mean-centre and scale every event cloud to unit radius."""
    return event_clouds(spark, folder).select("cloud_id", "point_id", *[fm.out(F.col(a)).alias(a) for a in AXES])


BOX = f"""WITH {EVENT_CTES.split('cen AS')[0].rstrip().rstrip(',')}, c AS (SELECT cloud_id, {', '.join(f'{d(0.5)} * (min({a}) + max({a})) AS o{a}' for a in AXES)} FROM raw GROUP BY cloud_id),
 sh AS (SELECT cloud_id, point_id, {', '.join(f'{a} - o{a} AS {a}' for a in AXES)} FROM raw JOIN c USING (cloud_id)),
 r AS (SELECT cloud_id, max(sqrt(x*x + y*y + z*z)) AS rad FROM sh GROUP BY cloud_id)
SELECT cloud_id, count(*) AS points, {', '.join(f'{out(f"max({a} / rad)")} AS max_{a}' for a in AXES)} FROM sh JOIN r USING (cloud_id) WHERE rad > {d(1e-12)} GROUP BY cloud_id"""


@query(BOX)
def box_normalize(spark: SparkSession, folder: str) -> DataFrame:
    """Bounding-box centring and unit radius, summarized per cloud."""
    moved, _ = box_center_unit_radius(raw_event_clouds(spark, folder), "cloud_id")
    return moved.groupBy("cloud_id").agg(
        F.count(F.lit(1)).alias("points"), *[fm.out(F.max(a)).alias(f"max_{a}") for a in AXES]
    )


# A quarter turn about z and a shift that depends on the cloud.
RIGID = f"""WITH {NORMAL_CTES} SELECT cloud_id, point_id, {out(f"-y + {d(0.5)}")} AS x, {out(f"x - {d(0.25)}")} AS y, {out(f"z + CAST(cloud_id AS DOUBLE) / {d(1000.0)}")} AS z,
 {out('-ny')} AS nx, {out('nx')} AS ny, {out('nz')} AS nz FROM evn"""


@query(RIGID)
def rigid_motion(spark: SparkSession, folder: str) -> DataFrame:
    """Rotate and translate points and normals per cloud."""
    points = event_clouds_with_normals(spark, folder)
    entries = {"r00": 0.0, "r01": -1.0, "r02": 0.0, "r10": 1.0, "r11": 0.0, "r12": 0.0, "r20": 0.0, "r21": 0.0, "r22": 1.0, "tx": 0.5, "ty": -0.25}
    motions = points.select("cloud_id").distinct().select(
        "cloud_id", *[F.lit(v).alias(n) for n, v in entries.items()], (F.col("cloud_id").cast("double") / F.lit(1000.0)).alias("tz")
    )
    moved = rigid_transform(points, motions)
    return moved.select("cloud_id", "point_id", *[fm.out(F.col(a)).alias(a) for a in (*AXES, "nx", "ny", "nz")])


SUBSET = f"sub AS MATERIALIZED ({snapped('(' + random_subset('ev', K, 'subset') + ')', BITS)})"
SUBSET_CHAMFER = f"""WITH {EVENT_CTES}, {SUBSET}, q AS ({set_chamfer('ev', 'sub')})
SELECT q.cloud_id, n AS points, CAST(k AS INTEGER) AS k, CAST(36 * k AS INTEGER) AS payload_bits, CAST(14 + ceil(36 * k / {d(8.0)}) AS INTEGER) AS stream_bytes,
 {out(f"{d(8.0)} * CAST(14 + ceil(36 * k / {d(8.0)}) AS INTEGER) / n")} AS bpp, {out('sqrt(mse)')} AS chamfer_rmse
FROM q JOIN (SELECT cloud_id, count(*) AS n FROM ev GROUP BY cloud_id) USING (cloud_id) JOIN (SELECT cloud_id, count(*) AS k FROM sub GROUP BY cloud_id) USING (cloud_id)"""


@query(SUBSET_CHAMFER)
def hash_subset_chamfer(spark: SparkSession, folder: str) -> DataFrame:
    """Chamfer RMSE and exact rate of a hash-ranked, quantized subset per cloud."""
    points = event_clouds(spark, folder)
    chosen = sm.quantize_anchors(sm.random_subset(points, K, "subset"), BITS)
    quality = an.set_quality(points, chosen, K)
    size = F.col("k")
    return quality.select(
        "cloud_id", F.col("n").alias("points"), size.cast("int").alias("k"), lt.payload_bits(size, BITS).alias("payload_bits"),
        lt.stream_bytes(size, BITS).alias("stream_bytes"),
        fm.out(lt.bits_per_point(lt.stream_bytes(size, BITS), F.col("n"))).alias("bpp"),
        fm.out(F.col("chamfer_rmse")).alias("chamfer_rmse"),
    )


PAIR_TAIL = f"""dist AS (SELECT p.cloud_id, p.point_id, a.slot, {d2('p', 'a')} AS dd FROM ev p JOIN sub a USING (cloud_id)),
 pooled AS (SELECT cloud_id, sqrt(min(dd)) AS e FROM dist GROUP BY cloud_id, point_id UNION ALL SELECT cloud_id, sqrt(min(dd)) FROM dist GROUP BY cloud_id, slot)"""


@query(f"""WITH {EVENT_CTES}, {SUBSET}, {PAIR_TAIL} SELECT cloud_id, {out(f"quantile_cont(e, {d(0.95)})")} AS p95, {out(f"quantile_cont(e, {d(0.99)})")} AS p99,
 {out('max(e)')} AS hausdorff FROM pooled GROUP BY cloud_id""")
def hausdorff_tails(spark: SparkSession, folder: str) -> DataFrame:
    """p95, p99 and Hausdorff over both directions pooled."""
    points = event_clouds(spark, folder)
    chosen = sm.quantize_anchors(sm.random_subset(points, K, "subset"), BITS)
    return an.tail_distances(points, chosen, K).select("cloud_id", *[fm.out(F.col(c)).alias(c) for c in ("p95", "p99", "hausdorff")])


QUALITY = f"""WITH {EVENT_CTES}, {SUBSET}, q AS ({set_chamfer('ev', 'sub')}),
 sep AS (SELECT cloud_id, avg(sqrt(m)) AS separation FROM (SELECT a.cloud_id, a.slot, min({d2('a', 'b')}) AS m FROM sub a JOIN sub b ON a.cloud_id = b.cloud_id AND a.slot <> b.slot GROUP BY a.cloud_id, a.slot) GROUP BY cloud_id),
 eff AS (SELECT cloud_id, count(DISTINCT (x, y, z)) AS effective_k, count(*) AS k FROM sub GROUP BY cloud_id)
SELECT cloud_id, {out('surface')} AS surface, {out('coverage')} AS coverage, {out('sqrt(far)')} AS hausdorff, {out('separation')} AS separation, effective_k, effective_k = k AS fully_unique
FROM q JOIN sep USING (cloud_id) JOIN eff USING (cloud_id)"""


@query(QUALITY)
def anchor_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Surface, coverage, Hausdorff, separation and effective cardinality."""
    points = event_clouds(spark, folder)
    chosen = sm.quantize_anchors(sm.random_subset(points, K, "subset"), BITS)
    distinct = chosen.groupBy("cloud_id").agg(
        F.count_distinct("ix", "iy", "iz").alias("effective_k"), F.count(F.lit(1)).alias("_k")
    )
    return an.set_quality(points, chosen, K).join(distinct, "cloud_id").select(
        "cloud_id", *[fm.out(F.col(c)).alias(c) for c in ("surface", "coverage", "hausdorff", "separation")],
        "effective_k", (F.col("effective_k") == F.col("_k")).alias("fully_unique"),
    )


@query(f"WITH {EVENT_CTES}, {farthest('ev', 4)} SELECT cloud_id, slot, point_id, {', '.join(f'{out(a)} AS {a}' for a in AXES)} FROM fps")
def fps_k4(spark: SparkSession, folder: str) -> DataFrame:
    """Four farthest points of every event cloud."""
    chosen = farthest_points(event_clouds(spark, folder), 4)
    return chosen.select("cloud_id", "slot", "point_id", *[fm.out(F.col(a)).alias(a) for a in AXES])


CURVE_K = (2, 4, 8)
CURVE_PARTS = " UNION ALL ".join(f"SELECT *, CAST({k} AS INTEGER) AS k FROM fq WHERE slot < {k}" for k in CURVE_K)
CURVE = f"""WITH {EMBED_CTES}, {farthest('em', 8)}, fq AS ({snapped('fps', BITS)}), sets AS ({CURVE_PARTS}), q AS ({set_chamfer('em', 'sets', 'cloud_id, k')}),
 c AS (SELECT k, avg(sqrt(mse)) AS rmse FROM q GROUP BY k)
SELECT k, CAST(14 + ceil(36 * k / {d(8.0)}) AS INTEGER) AS stream_bytes, {out('rmse')} AS mean_rmse, coalesce(rmse > lag(rmse) OVER (ORDER BY k) + {d(1e-12)}, false) AS violation FROM c"""


@query(CURVE)
def fps_rate_curve(spark: SparkSession, folder: str) -> DataFrame:
    """Mean Chamfer RMSE over nested farthest-point sizes, with monotonicity flags."""
    from pyspark.sql import Window
    points = embedding_clouds(spark, folder)
    chosen = sm.quantize_anchors(farthest_points(points, max(CURVE_K)), BITS)
    sizes = F.filter(F.array(*[F.lit(k) for k in CURVE_K]), lambda k: k > F.col("slot"))
    nested = chosen.withColumn("k", F.explode(sizes)).withColumnRenamed("k", "size")
    scored = an.chamfer(points, nested, max(CURVE_K), ("cloud_id", "size"))
    curve = scored.groupBy("size").agg(F.avg(F.sqrt("chamfer_mse")).alias("rmse"))
    # One row per size: the whole curve is a handful of rows.
    before = F.lag("rmse").over(Window.orderBy("size"))
    return curve.select(
        F.col("size").alias("k"), lt.stream_bytes(F.col("size"), BITS).alias("stream_bytes"), fm.out(F.col("rmse")).alias("mean_rmse"),
        F.coalesce(F.col("rmse") > before + F.lit(1e-12), F.lit(False)).alias("violation"),
    )


NEIGHBOUR = f"""knn AS MATERIALIZED (SELECT a.cloud_id, a.point_id, abs(a.nx * b.nx + a.ny * b.ny + a.nz * b.nz) AS al FROM evn a JOIN evn b
 ON a.cloud_id = b.cloud_id AND a.point_id <> b.point_id QUALIFY row_number() OVER (PARTITION BY a.cloud_id, a.point_id ORDER BY {d2('a', 'b')}, b.point_id) <= 8),
 va AS MATERIALIZED (SELECT e.*, v.variation FROM evn e JOIN (SELECT cloud_id, point_id, {d(1.0)} - avg(al) AS variation FROM knn GROUP BY cloud_id, point_id) v USING (cloud_id, point_id))"""


@query(f"WITH {NORMAL_CTES}, {NEIGHBOUR} SELECT cloud_id, point_id, {out('variation')} AS variation FROM va")
def knn_variation(spark: SparkSession, folder: str) -> DataFrame:
    """Normal variation over the eight nearest other points."""
    level = normal_variation(event_clouds_with_normals(spark, folder))
    return level.select("cloud_id", "point_id", fm.out(F.col("variation")).alias("variation"))


@query(f"""WITH {NORMAL_CTES}, {NEIGHBOUR}, {farthest('va', 4, start='p.variation', weight=f'{d(1.0)} + n.variation')}
 SELECT cloud_id, slot, point_id FROM fps""")
def normal_fps(spark: SparkSession, folder: str) -> DataFrame:
    """Farthest points weighted by normal variation."""
    level = normal_variation(event_clouds_with_normals(spark, folder))
    return normal_aware_points(level, 4).select("cloud_id", "slot", "point_id")


HALVES = f"""src AS (SELECT * FROM evn WHERE point_id % 3 = 0), tgt AS (SELECT * FROM evn WHERE point_id % 3 <> 0),
 fw AS (SELECT s.cloud_id, {d2('s', 't')} AS dd, (s.x - t.x) * t.nx + (s.y - t.y) * t.ny + (s.z - t.z) * t.nz AS pl FROM src s JOIN tgt t USING (cloud_id)
   QUALIFY row_number() OVER (PARTITION BY s.cloud_id, s.point_id ORDER BY {d2('s', 't')}, t.point_id) = 1),
 bw AS (SELECT s.cloud_id, {d2('t', 's')} AS dd, (t.x - s.x) * t.nx + (t.y - s.y) * t.ny + (t.z - s.z) * t.nz AS pl FROM src s JOIN tgt t USING (cloud_id)
   QUALIFY row_number() OVER (PARTITION BY t.cloud_id, t.point_id ORDER BY {d2('t', 's')}, s.point_id) = 1)"""
DISTORTION = f"""WITH {NORMAL_CTES}, {HALVES},
 f AS (SELECT cloud_id, avg(dd) AS m, avg(pl * pl) AS p, max(dd) AS far FROM fw GROUP BY cloud_id), b AS (SELECT cloud_id, avg(dd) AS m, avg(pl * pl) AS p, max(dd) AS far FROM bw GROUP BY cloud_id),
 al AS (SELECT cloud_id, sqrt(dd) AS e FROM fw UNION ALL SELECT cloud_id, sqrt(dd) FROM bw)
SELECT f.cloud_id, {out(f"sqrt({d(0.5)} * (f.m + b.m))")} AS chamfer_rmse, {out('greatest(f.m, b.m)')} AS d1_mse, {out(f"{d(10.0)} * log10({d(4.0)} / greatest(f.m, b.m))")} AS d1_psnr_db,
 {out('greatest(f.p, b.p)')} AS d2_mse, {out(f"{d(10.0)} * log10({d(4.0)} / greatest(f.p, b.p))")} AS d2_psnr_db, {out('q.p95')} AS p95, {out('q.p99')} AS p99, {out('sqrt(greatest(f.far, b.far))')} AS hausdorff
FROM f JOIN b USING (cloud_id) JOIN (SELECT cloud_id, quantile_cont(e, {d(0.95)}) AS p95, quantile_cont(e, {d(0.99)}) AS p99 FROM al GROUP BY cloud_id) q USING (cloud_id)"""


@query(DISTORTION)
def cloud_distortion(spark: SparkSession, folder: str) -> DataFrame:
    """Point-to-point and point-to-plane errors between two parts of each cloud."""
    from cumulo.operators.distortion import geometry_metrics
    points = event_clouds_with_normals(spark, folder)
    report = geometry_metrics(points.filter("point_id % 3 = 0"), points.filter("point_id % 3 <> 0"))
    names = ("chamfer_rmse", "d1_mse", "d1_psnr_db", "d2_mse", "d2_psnr_db", "p95", "p99", "hausdorff")
    return report.select("cloud_id", *[fm.out(F.col(c)).alias(c) for c in names])


DIRECTIONS = 32
SLICED = f"""WITH {NORMAL_CTES}, dirs AS (SELECT i, sqrt(greatest({d(1.0)} - zz * zz, {d(0.0)})) * cos(i * {d(fm.GOLDEN_ANGLE)}) AS vx, sqrt(greatest({d(1.0)} - zz * zz, {d(0.0)})) * sin(i * {d(fm.GOLDEN_ANGLE)}) AS vy, zz AS vz
   FROM (SELECT i, {d(1.0)} - {d(2.0)} * (i + {d(0.5)}) / {d(float(DIRECTIONS))} AS zz FROM range({DIRECTIONS}) t(i))),
 pr AS (SELECT cloud_id, i, point_id % 3 = 0 AS src, x * vx + y * vy + z * vz AS v, point_id FROM evn, dirs),
 rk AS MATERIALIZED (SELECT cloud_id, i, src, v, row_number() OVER (PARTITION BY cloud_id, i, src ORDER BY v, point_id) - 1 AS r, count(*) OVER (PARTITION BY cloud_id, i, src) AS n FROM pr),
 pos AS (SELECT f.cloud_id, f.i, f.v, CASE WHEN f.n = m.n THEN CAST(f.r AS DOUBLE) WHEN f.n = 1 THEN {d(0.0)} ELSE CAST(f.r AS DOUBLE) * (m.n - 1) / (f.n - 1) END AS p FROM rk f JOIN (SELECT DISTINCT cloud_id, n FROM rk WHERE NOT src) m USING (cloud_id) WHERE f.src)
SELECT cloud_id, {out('sqrt(avg((v - w) * (v - w)))')} AS sliced_wasserstein FROM (SELECT p.cloud_id, p.v, lo.v * ({d(1.0)} - (p.p - floor(p.p))) + hi.v * (p.p - floor(p.p)) AS w FROM pos p
 JOIN rk lo ON NOT lo.src AND lo.cloud_id = p.cloud_id AND lo.i = p.i AND lo.r = floor(p.p) JOIN rk hi ON NOT hi.src AND hi.cloud_id = p.cloud_id AND hi.i = p.i AND hi.r = ceil(p.p)) GROUP BY cloud_id"""


@query(SLICED)
def sliced_wasserstein(spark: SparkSession, folder: str) -> DataFrame:
    """Sliced Wasserstein distance between two unequal parts of each cloud."""
    from cumulo.operators.distortion import sliced_wasserstein as measure
    points = event_clouds(spark, folder)
    report = measure(points.filter("point_id % 3 = 0"), points.filter("point_id % 3 <> 0"), DIRECTIONS)
    return report.select("cloud_id", fm.out(F.col("sliced_wasserstein")).alias("sliced_wasserstein"))


SUBSET_EM = f"sub AS MATERIALIZED ({snapped('(' + random_subset('em', K, 'subset') + ')', BITS)})"
TAU = 0.05
PAIRS_EM = f"""pr AS MATERIALIZED (SELECT p.cloud_id, p.point_id, p.x, p.y, p.z, a.slot, {d2('p', 'a')} AS dd FROM em p JOIN sub a USING (cloud_id)),
 sz AS (SELECT cloud_id, count(DISTINCT point_id) AS n, count(DISTINCT slot) AS k FROM pr GROUP BY cloud_id),
 w AS MATERIALIZED (SELECT *, exp(-dd / {d(TAU)}) AS aff, e / sum(e) OVER (PARTITION BY cloud_id, point_id) AS share FROM
   (SELECT *, exp((min(dd) OVER (PARTITION BY cloud_id, point_id) - dd) / {d(TAU)}) AS e FROM pr))"""


@query(f"""WITH {EMBED_CTES}, {SUBSET_EM}, {PAIRS_EM} SELECT cloud_id, {out('sqrt(avg((m * k - 1) * (m * k - 1)))')} AS mass_imbalance
 FROM (SELECT cloud_id, slot, avg(share) AS m FROM w GROUP BY cloud_id, slot) JOIN sz USING (cloud_id) GROUP BY cloud_id""")
def mass_imbalance(spark: SparkSession, folder: str) -> DataFrame:
    """Relative deviation of soft anchor mass from equal shares."""
    points = embedding_clouds(spark, folder)
    chosen = sm.quantize_anchors(sm.random_subset(points, K, "subset"), BITS)
    return fo.mass_imbalance(points, chosen, TAU).select("cloud_id", fm.out(F.col("mass_imbalance")).alias("mass_imbalance"))


DENSITY = f"""WITH {EMBED_CTES}, {SUBSET_EM}, {PAIRS_EM},
 b AS (SELECT *, e2 / sum(e2) OVER (PARTITION BY cloud_id, slot) AS back FROM (SELECT *, exp((min(dd) OVER (PARTITION BY cloud_id, slot) - dd) / {d(TAU)}) AS e2 FROM w)),
 o AS (SELECT *, sum(back) OVER (PARTITION BY cloud_id, point_id) AS occ, sum(share) OVER (PARTITION BY cloud_id, slot) AS crowd FROM b),
 m AS (SELECT cloud_id, slot, n, k, share * aff / (1 + pow(crowd / (CAST(n AS DOUBLE) / k) - 1, 2)) AS second, back * aff / (1 + pow(occ / (CAST(k AS DOUBLE) / n) - 1, 2)) AS first FROM o JOIN sz USING (cloud_id))
SELECT cloud_id, {out(f"{d(0.5)} * ((1 - sum(first) / max(k)) + (1 - sum(second) / max(n)))")} AS density_aware_chamfer FROM m GROUP BY cloud_id"""


@query(DENSITY)
def density_aware_chamfer(spark: SparkSession, folder: str) -> DataFrame:
    """Density-aware Chamfer between an anchor set and its cloud."""
    points = embedding_clouds(spark, folder)
    chosen = sm.quantize_anchors(sm.random_subset(points, K, "subset"), BITS)
    return fo.density_aware_chamfer(points, chosen, TAU).select(
        "cloud_id", fm.out(F.col("density_aware_chamfer")).alias("density_aware_chamfer")
    )


@query(f"""WITH {EMBED_CTES}, {SUBSET_EM}, {PAIRS_EM} SELECT cloud_id, slot, {', '.join(out(f'sum(share * {a}) / sum(share)') + f' AS {a}' for a in AXES)}, {out('sum(share)')} AS mass FROM w GROUP BY cloud_id, slot""")
def soft_means(spark: SparkSession, folder: str) -> DataFrame:
    """One soft clustering step per anchor."""
    points = embedding_clouds(spark, folder)
    chosen = sm.quantize_anchors(sm.random_subset(points, K, "subset"), BITS)
    return fo.soft_means(points, chosen, TAU).select("cloud_id", "slot", *[fm.out(F.col(c)).alias(c) for c in (*AXES, "mass")])


SET_LOSS = f"""WITH {EVENT_CTES}, {SUBSET}, q AS ({set_chamfer('ev', 'sub')}),
 rp AS (SELECT cloud_id, sum(h) / (max(k) * max(k)) AS repulsion FROM (SELECT a.cloud_id, CASE WHEN a.slot = b.slot THEN {d(0.0)} ELSE greatest({d(0.25)} - {d2('a', 'b')}, {d(0.0)}) END AS h, count(*) OVER (PARTITION BY a.cloud_id, a.slot) AS k
   FROM sub a JOIN sub b USING (cloud_id)) GROUP BY cloud_id)
SELECT cloud_id, {out('mse')} AS chamfer, {out('surface')} AS surface, {out('repulsion')} AS repulsion, {out(f"mse + {d(0.1)} * surface + {d(0.01)} * repulsion")} AS loss FROM q JOIN rp USING (cloud_id)"""


@query(SET_LOSS)
def set_loss(spark: SparkSession, folder: str) -> DataFrame:
    """Weighted Chamfer, surface and repulsion terms per cloud."""
    points = event_clouds(spark, folder)
    chosen = sm.quantize_anchors(sm.random_subset(points, K, "subset"), BITS)
    report = an.set_loss(points, chosen, size=K, margin=0.5)
    return report.select("cloud_id", *[fm.out(F.col(c)).alias(c) for c in ("chamfer", "surface", "repulsion", "loss")])


SNAP = f"""WITH {EVENT_CTES}, {SUBSET}, moved AS (SELECT cloud_id, slot, x + {d(0.05)} AS x, y, z FROM sub)
SELECT a.cloud_id, a.slot, p.point_id, {out(d2('a', 'p'))} AS d2 FROM moved a JOIN ev p USING (cloud_id) QUALIFY row_number() OVER (PARTITION BY a.cloud_id, a.slot ORDER BY {d2('a', 'p')}, p.point_id) = 1"""


@query(SNAP)
def snap_to_input(spark: SparkSession, folder: str) -> DataFrame:
    """Shifted anchors replaced by their nearest input point."""
    points = event_clouds(spark, folder)
    chosen = sm.quantize_anchors(sm.random_subset(points, K, "subset"), BITS)
    moved = chosen.select("cloud_id", "slot", (F.col("x") + F.lit(0.05)).alias("x"), "y", "z")
    return snap_to_cloud(moved, points).select("cloud_id", "slot", "point_id", fm.out(F.col("d2")).alias("d2"))


_LINE = """SELECT 'all' AS cloud_id, l_orderkey * 8 + l_linenumber AS point_id, l_returnflag = 'R' AS src, l_quantity / CAST(50 AS DOUBLE) AS x,
 l_extendedprice / CAST(105000 AS DOUBLE) AS y, l_discount * CAST(10 AS DOUBLE) AS z FROM lineitem"""
RETURNED = f"""WITH li AS MATERIALIZED ({_LINE}), tg AS (SELECT * FROM li WHERE NOT src UNION ALL SELECT 'all', -1, false, {d(1e6)}, {d(1e6)}, {d(1e6)})
SELECT point_id, best.tid AS target_id, {out('best.dd', 9)} AS d2 FROM (SELECT a.point_id, min({{'dd': {d2('a', 'p')}, 'tid': p.point_id}}) AS best FROM li a JOIN tg p USING (cloud_id) WHERE a.src GROUP BY a.point_id)"""


@query(RETURNED)
def returned_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest kept order line of every returned one, in one cloud of all lines with a far outlier."""
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").select(
        F.lit("all").alias("cloud_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("point_id"), "l_returnflag",
        (F.col("l_quantity") / F.lit(50.0)).alias("x"), (F.col("l_extendedprice") / F.lit(105000.0)).alias("y"), (F.col("l_discount") * F.lit(10.0)).alias("z"))
    columns = ["cloud_id", "point_id", *AXES]
    outlier = spark.range(1).select(F.lit("all").alias("cloud_id"), F.lit(-1).cast("long").alias("point_id"), *[F.lit(1e6).alias(a) for a in AXES])
    found = nearest(lines.filter("l_returnflag = 'R'").select(*columns), lines.filter("l_returnflag <> 'R'").select(*columns).unionByName(outlier))
    return found.select("point_id", "target_id", fm.out(F.col("d2"), 9).alias("d2"))


VECTORS = f"""WITH v AS (SELECT CAST(label AS VARCHAR) AS cloud_id, vec_id, embedding, vec_id % 4 = 0 AS src FROM embeddings),
 u AS (SELECT cloud_id, vec_id, src, unnest(range(1, len(embedding) + 1)) AS i, CAST(unnest(embedding) AS DOUBLE) AS e FROM v),
 dd AS (SELECT s.cloud_id, s.vec_id, t.vec_id AS tid, sum((s.e - t.e) * (s.e - t.e)) AS d2 FROM u s JOIN u t ON s.cloud_id = t.cloud_id AND s.i = t.i AND s.src AND NOT t.src GROUP BY ALL)
SELECT cloud_id, vec_id AS point_id, tid AS target_id, {out('d2')} AS d2 FROM dd QUALIFY row_number() OVER (PARTITION BY cloud_id, vec_id ORDER BY dd.d2, tid) = 1"""


@query(VECTORS)
def vector_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Nearest vector of the same label in all 64 dimensions."""
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").select(
        F.col("label").cast("string").alias("cloud_id"), F.col("vec_id").alias("point_id"), F.col("embedding").alias("vector")
    )
    found = nearest_vectors(vectors.filter("point_id % 4 = 0"), vectors.filter("point_id % 4 <> 0"))
    return found.select("cloud_id", "point_id", "target_id", fm.out(F.col("d2")).alias("d2"))


MERGE = f"""WITH {EVENT_CTES}, {farthest('ev', 4)}, nn AS (SELECT p.cloud_id, p.point_id, p.x, p.y, p.z, a.slot FROM ev p JOIN fps a USING (cloud_id)
   QUALIFY row_number() OVER (PARTITION BY p.cloud_id, p.point_id ORDER BY {d2('p', 'a')}, a.slot) = 1),
 g AS (SELECT n.cloud_id, coalesce(f.slot, n.slot) AS slot, n.x, n.y, n.z FROM nn n LEFT JOIN fps f ON f.cloud_id = n.cloud_id AND f.point_id = n.point_id)
SELECT cloud_id, slot, {', '.join(out(snap(f'avg({a})', BITS)) + f' AS {a}' for a in AXES)} FROM g GROUP BY cloud_id, slot"""


@query(MERGE)
def seeded_merge_k4(spark: SparkSession, folder: str) -> DataFrame:
    """Points merged into four seeded group means on the lattice."""
    merged = seeded_merge(event_clouds(spark, folder), 4, BITS)
    return merged.select("cloud_id", "slot", *[fm.out(F.col(a)).alias(a) for a in AXES])


@query()
def merge_path_16_8_4(spark: SparkSession, folder: str) -> DataFrame:
    """Staged merge of each cloud through 16, 8 and 4 anchors."""
    path = merge_path(embedding_clouds(spark, folder), (16, 8, 4), BITS)
    return path.select("cloud_id", "k", "slot", *[fm.out(F.col(a)).alias(a) for a in AXES])
