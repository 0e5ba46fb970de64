"""Queries over selected sets: assignment, transport, search, streams, behaviour."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cumulo.catalog.geometry import BITS, K, SUBSET_EM
from cumulo.catalog.sqltext import d, d2, farthest, hash_int, hash_text, hash_uniform, index, out, random_subset, s, set_chamfer, snap, snapped
from cumulo.catalog.views import AXES, EMBED_CTES, EVENT_CTES, embedding_clouds, event_clouds
from cumulo.functions import formulas as fm
from cumulo.functions.hashing import hash_rank, hash_uniform as uniform
from cumulo.functions.lattice import jittered_snap, lattice_step
from cumulo.operators import anchors as an
from cumulo.operators import assignment as asg
from cumulo.operators import behaviour as bh
from cumulo.operators import folds as fo
from cumulo.operators import sampling as sm
from cumulo.operators import search as se
from cumulo.operators import streams as st
from cumulo.operators import transport as tr
from cumulo.operators.farthest import farthest_points, merge_path

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(build):
        QUERIES[build.__name__] = build
        if sql is not None:
            SQL[build.__name__] = sql
        return build
    return register


def subset(points: DataFrame, size: int = K, name: str = "subset") -> DataFrame:
    return sm.quantize_anchors(sm.random_subset(points, size, name), BITS)


def _greedy(rounds: int) -> str:
    """Chained picks of the globally nearest free (slot, point) pair."""
    parts = [f"pr0 AS MATERIALIZED (SELECT a.cloud_id, a.slot, p.point_id, {d2('a', 'p')} AS dd FROM moved a JOIN em p USING (cloud_id))"]
    for i in range(rounds):
        parts.append(f"pk{i} AS MATERIALIZED (SELECT * FROM pr{i} QUALIFY row_number() OVER (PARTITION BY cloud_id ORDER BY dd, slot, point_id) = 1)")
        parts.append(f"pr{i + 1} AS MATERIALIZED (SELECT r.* FROM pr{i} r JOIN pk{i} k USING (cloud_id) WHERE r.slot <> k.slot AND r.point_id <> k.point_id)")
    return ", ".join(parts)


MOVED = f"moved AS (SELECT cloud_id, slot, x * {d(0.5)} AS x, y * {d(0.5)} AS y, z * {d(0.5)} AS z FROM sub)"


@query(f"""WITH {EMBED_CTES}, {SUBSET_EM}, {MOVED}, {_greedy(K)}
 {' UNION ALL '.join(f'SELECT cloud_id, slot, point_id, {out("dd")} AS d2 FROM pk{i}' for i in range(K))}""")
def unique_projection(spark: SparkSession, folder: str) -> DataFrame:
    """Every anchor gets its own input point, nearest pairs first."""
    points = embedding_clouds(spark, folder)
    moved = subset(points).select("cloud_id", "slot", *[(F.col(a) * F.lit(0.5)).alias(a) for a in AXES])
    served = asg.unique_projection(moved, points, K)
    return served.select("cloud_id", "slot", "point_id", fm.out(F.col("d2")).alias("d2"))


EPS, SWEEPS, MANY = 0.02, 40, 128


def _sinkhorn(sweeps: int) -> str:
    lse = "max(v) + ln(sum(exp(v - m)))"
    parts = [f"kr AS MATERIALIZED (SELECT p.cloud_id, p.point_id, a.slot, {d2('p', 'a')} AS c, {d2('p', 'a')} / {d(-EPS)} AS g FROM em p JOIN sub a USING (cloud_id))",
             "mass AS (SELECT cloud_id, -ln(CAST(count(DISTINCT slot) AS DOUBLE)) AS la, -ln(CAST(count(DISTINCT point_id) AS DOUBLE)) AS lb FROM kr GROUP BY cloud_id)"]
    for i in range(1, sweeps + 1):
        value = "g" if i == 1 else "k.g + p.val"
        joined = "kr k" if i == 1 else f"kr k JOIN v{i - 1} p USING (cloud_id, point_id)"
        parts.append(f"u{i} AS MATERIALIZED (SELECT cloud_id, slot, any_value(la) - ({lse}) AS val FROM (SELECT cloud_id, slot, v, max(v) OVER (PARTITION BY cloud_id, slot) AS m FROM (SELECT k.cloud_id, k.slot, {value} AS v FROM {joined})) JOIN mass USING (cloud_id) GROUP BY cloud_id, slot)")
        parts.append(f"v{i} AS MATERIALIZED (SELECT cloud_id, point_id, any_value(lb) - ({lse}) AS val FROM (SELECT cloud_id, point_id, v, max(v) OVER (PARTITION BY cloud_id, point_id) AS m FROM (SELECT k.cloud_id, k.point_id, k.g + p.val AS v FROM kr k JOIN u{i} p USING (cloud_id, slot))) JOIN mass USING (cloud_id) GROUP BY cloud_id, point_id)")
    return ", ".join(parts)


PLAN = f"pl AS (SELECT k.cloud_id, k.slot, k.point_id, k.c, exp(k.g + u.val + v.val) AS mass FROM kr k JOIN u{SWEEPS} u USING (cloud_id, slot) JOIN v{SWEEPS} v USING (cloud_id, point_id))"


@query(f"WITH {EMBED_CTES}, {SUBSET_EM}, {_sinkhorn(SWEEPS)}, {PLAN} SELECT cloud_id, {out('sum(mass * c)', 9)} AS transport_cost FROM pl GROUP BY cloud_id")
def sinkhorn_cost(spark: SparkSession, folder: str) -> DataFrame:
    """Balanced entropic transport cost between a subset and its cloud."""
    points = embedding_clouds(spark, folder)
    cost = tr.transport_cost(points, subset(points), epsilon=EPS, iterations=SWEEPS)
    return cost.select("cloud_id", fm.out(F.col("transport_cost"), 9).alias("transport_cost"))


@query(f"WITH {EMBED_CTES}, {SUBSET_EM}, {_sinkhorn(SWEEPS)}, {PLAN} SELECT cloud_id, slot, {out('sum(mass)')} AS anchor_mass FROM pl GROUP BY cloud_id, slot")
def balanced_mass(spark: SparkSession, folder: str) -> DataFrame:
    """Mass that the balanced plan gives each anchor."""
    points = embedding_clouds(spark, folder)
    mass = tr.anchor_mass(points, subset(points), epsilon=EPS, iterations=SWEEPS)
    return mass.select("cloud_id", "slot", fm.out(F.col("mass")).alias("anchor_mass"))


@query(f"WITH {EMBED_CTES}, sub AS MATERIALIZED ({snapped('(' + random_subset('em', MANY, 'many') + ')', BITS)}), {_sinkhorn(SWEEPS)}, {PLAN} SELECT cloud_id, count(DISTINCT slot) AS anchors, {out('sum(mass * c)', 9)} AS transport_cost FROM pl GROUP BY cloud_id")
def sinkhorn_cost_k128(spark: SparkSession, folder: str) -> DataFrame:
    """Balanced entropic transport cost of 128 anchors, as folds over blocks of every cloud."""
    points = embedding_clouds(spark, folder)
    chosen = subset(points, MANY, "many")
    cost = tr.transport_cost(points, chosen, epsilon=EPS, iterations=SWEEPS, bound=0)
    counts = chosen.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("anchors"))
    return cost.join(counts, "cloud_id").select("cloud_id", "anchors", fm.out(F.col("transport_cost"), 9).alias("transport_cost"))


PERMUTATIONS = ((0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0))
MATCHED = f"""WITH {EVENT_CTES}, a AS ({random_subset('ev', 3, 'left')}), b AS ({random_subset('ev', 3, 'right')}),
 c AS (SELECT a.cloud_id, {', '.join(f"max(CASE WHEN a.slot = {i} AND b.slot = {j} THEN {d2('a', 'b')} END) AS c{i}{j}" for i in range(3) for j in range(3))} FROM a JOIN b USING (cloud_id) GROUP BY a.cloud_id)
SELECT cloud_id, {out(f"sqrt(least({', '.join(' + '.join(f'c{i}{j}' for i, j in enumerate(p)) for p in PERMUTATIONS)}) / 3)")} AS matched_rmse FROM c"""


@query(MATCHED)
def matched_set_rmse(spark: SparkSession, folder: str) -> DataFrame:
    """RMS separation of two subsets under the cheapest one-to-one matching."""
    points = event_clouds(spark, folder)
    report = asg.matched_set_rmse(sm.random_subset(points, 3, "left"), sm.random_subset(points, 3, "right"))
    return report.select("cloud_id", fm.out(F.col("matched_rmse")).alias("matched_rmse"))


@query()
def multimodal_restarts(spark: SparkSession, folder: str) -> DataFrame:
    """Comparable but separated restarts per cloud."""
    points = embedding_clouds(spark, folder)
    sets = sm.multi_start(farthest_points(points, K), points, K, 4, "restart")
    losses = se.chamfer_score(points, K)(sets)
    report = asg.multimodality(sets, losses, tolerance=0.2, separation=0.05)
    return report.select("cloud_id", fm.out(F.col("best_loss")).alias("best_loss"), "comparable", fm.out(F.col("separation")).alias("separation"), "multimodal")


TRIALS = 3
_STARTS = " UNION ALL ".join(
    [f"SELECT cloud_id, CAST(0 AS INTEGER) AS candidate_id, slot, point_id, x, y, z FROM fps"]
    + [f"SELECT cloud_id, CAST({c} AS INTEGER), slot, point_id, x, y, z FROM ({random_subset('em', K, 'best', str(c))})" for c in range(1, TRIALS + 1)]
)
STARTS = f"{farthest('em', K)}, st AS ({_STARTS}), sets AS MATERIALIZED ({snapped('st', BITS)}), sc AS MATERIALIZED ({set_chamfer('em', 'sets', 'cloud_id, candidate_id')})"


@query(f"""WITH {EMBED_CTES}, {STARTS} , won AS (SELECT * FROM sc
 QUALIFY row_number() OVER (PARTITION BY cloud_id ORDER BY mse, candidate_id) = 1)
SELECT w.cloud_id, w.candidate_id, s.slot, s.point_id, {out('w.mse', 9)} AS loss FROM won w JOIN sets s ON s.cloud_id = w.cloud_id AND s.candidate_id = w.candidate_id""")
def best_of_subsets(spark: SparkSession, folder: str) -> DataFrame:
    """Best of the farthest-point subset and random subsets."""
    best = se.best_of_subsets(embedding_clouds(spark, folder), K, TRIALS, BITS, "best")
    return best.select("cloud_id", "candidate_id", "slot", "point_id", fm.out(F.col("loss"), 9).alias("loss"))


@query(f"""WITH {EMBED_CTES}, {STARTS}, bs AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY cloud_id ORDER BY mse, candidate_id) = 1),
 r AS (SELECT sqrt(avg(b.mse)) AS best_rmse, sqrt(avg(f.mse)) AS ref, avg(CAST(b.candidate_id AS DOUBLE)) AS mc, count(*) AS clouds FROM bs b JOIN sc f ON f.cloud_id = b.cloud_id AND f.candidate_id = 0)
SELECT {out('best_rmse')} AS best_rmse, {out('ref')} AS reference_rmse, {out('mc')} AS mean_candidate, clouds, {out('100 * (best_rmse - ref) / ref')} AS gap_percent FROM r""")
def candidate_gap(spark: SparkSession, folder: str) -> DataFrame:
    """Best-of-candidates against the farthest-point set over all clouds."""
    points = embedding_clouds(spark, folder)
    sets = sm.multi_start(farthest_points(points, K), points, K, TRIALS + 1, "best")
    sets = sets.withColumns({a: sm.snap(F.col(a), BITS) for a in AXES})
    losses = se.chamfer_score(points, K)(sets)
    best = losses.groupBy("cloud_id").agg(F.min(F.struct("loss", "candidate_id")).alias("b")).select("cloud_id", "b.*")
    report = bh.candidate_gap(best, losses.filter("candidate_id = 0").select("cloud_id", "loss"))
    return report.select(*[fm.out(F.col(c)).alias(c) if c != "clouds" else F.col(c) for c in report.columns])


@query(f"""WITH {EMBED_CTES}, {STARTS}, pr AS (SELECT a.cloud_id, a.candidate_id AS ca, b.candidate_id AS cb, a.slot AS sa, b.slot AS sb, {d2('a', 'b')} AS dd FROM sets a JOIN sets b ON a.cloud_id = b.cloud_id AND a.candidate_id < b.candidate_id),
 g AS (SELECT cloud_id, ca, cb, avg(m) AS f FROM (SELECT cloud_id, ca, cb, sa, min(dd) AS m FROM pr GROUP BY ALL) GROUP BY ALL), h AS (SELECT cloud_id, ca, cb, avg(m) AS f FROM (SELECT cloud_id, ca, cb, sb, min(dd) AS m FROM pr GROUP BY ALL) GROUP BY ALL)
SELECT {out(f"sqrt(avg({d(0.5)} * (g.f + h.f)))")} AS diversity_rmse FROM g JOIN h USING (cloud_id, ca, cb)""")
def restart_diversity(spark: SparkSession, folder: str) -> DataFrame:
    """RMS set distance over pairs of restarts."""
    points = embedding_clouds(spark, folder)
    sets = sm.multi_start(farthest_points(points, K), points, K, TRIALS + 1, "best")
    report = bh.restart_diversity(sets.withColumns({a: sm.snap(F.col(a), BITS) for a in AXES}))
    return report.select(fm.out(F.col("diversity_rmse")).alias("diversity_rmse"))


@query()
def subset_mutation_search(spark: SparkSession, folder: str) -> DataFrame:
    """Swap mutations of a hash-ranked subset, scored by Chamfer."""
    points = event_clouds(spark, folder)
    start = sm.random_subset(points, K, "subset")
    best, _ = se.subset_mutation_search(points, start, se.chamfer_score(points, K), bits=BITS, population=4, generations=2)
    return best.select("cloud_id", "slot", "point_id", fm.out(F.col("loss")).alias("loss"))


@query()
def cross_entropy_search(spark: SparkSession, folder: str) -> DataFrame:
    """Gaussian population search from a hash-ranked subset."""
    points = embedding_clouds(spark, folder)
    best, _ = se.cross_entropy_search(subset(points), se.chamfer_score(points, K), bits=BITS, population=6, generations=2, initial_std=0.05)
    return best.select("cloud_id", "slot", *[fm.out(F.col(a)).alias(a) for a in AXES], fm.out(F.col("loss")).alias("loss"))


@query()
def search_accounting(spark: SparkSession, folder: str) -> DataFrame:
    """Gain, improved share and budget of both searches from one start."""
    points = embedding_clouds(spark, folder)
    start, score = sm.random_subset(points, K, "subset"), se.chamfer_score(points, K)
    _, swaps = se.subset_mutation_search(points, start, score, bits=BITS, population=4, generations=2)
    _, normal = se.cross_entropy_search(start, score, bits=BITS, population=4, generations=2)
    history = swaps.withColumn("method", F.lit("subset_mutation")).unionByName(normal.withColumn("method", F.lit("cross_entropy")))
    summary = se.search_summary(se.search_gains(history, ["method"]), ["method"])
    return summary.select("method", *[fm.out(F.col(c)).alias(c) for c in ("mean_gain", "improved_fraction", "mean_chamfer")], "evaluations")


HISTORY = """hi AS (SELECT user_id, event_id, value FROM events)"""


@query(f"WITH {HISTORY} SELECT CAST(user_id AS VARCHAR) AS cloud_id, count(DISTINCT best) AS improvements, {out('min(best)')} AS best_loss FROM (SELECT user_id, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS best FROM hi) GROUP BY user_id")
def running_best(spark: SparkSession, folder: str) -> DataFrame:
    """Running minimum along each history; the number of distinct bests."""
    rows = spark.read.parquet(f"{folder}/events.parquet").select(F.col("user_id").cast("string").alias("cloud_id"), "event_id", F.col("value").alias("loss"))
    best = se.running_best(rows, ["cloud_id"], "event_id")
    return best.groupBy("cloud_id").agg(F.count_distinct("best_loss").alias("improvements"), fm.out(F.min("best_loss")).alias("best_loss"))


# Four candidates, so the lower-loss half is two sets per cloud.
ELITE = f"""WITH {EMBED_CTES}, {STARTS}, again AS ({snapped('st', BITS)}) SELECT t.cloud_id, t.slot, {', '.join(f'{out(f"avg(t.{a})")} AS m{a}' for a in AXES)}, {', '.join(f'{out(f"greatest(stddev_pop(t.{a}), {d(0.005)})")} AS s{a}' for a in AXES)}
 FROM again t JOIN (SELECT cloud_id, candidate_id, row_number() OVER (PARTITION BY cloud_id ORDER BY mse, candidate_id) AS rk FROM sc) e ON t.cloud_id = e.cloud_id AND t.candidate_id = e.candidate_id WHERE e.rk <= 2 GROUP BY t.cloud_id, t.slot"""


@query(ELITE)
def elite_refit(spark: SparkSession, folder: str) -> DataFrame:
    """Mean and floored deviation of the lower-loss half of the restarts."""
    points = embedding_clouds(spark, folder)
    sets = sm.multi_start(farthest_points(points, K), points, K, TRIALS + 1, "best").withColumns({a: sm.snap(F.col(a), BITS) for a in AXES})
    fit = se.elite_fit(sets, se.chamfer_score(points, K)(sets), fraction=0.5, floor=0.005)
    return fit.select("cloud_id", "slot", *[fm.out(F.col(f"{p}{a}")).alias(f"{p}{a}") for p in "ms" for a in AXES])


TRIPLE_KEY = "string_agg(ix || ',' || iy || ',' || iz, ';' ORDER BY ix, iy, iz)"


def _indexed(source: str) -> str:
    return f"SELECT *, {', '.join(f'{index(a, BITS)} AS i{a}' for a in AXES)} FROM {source}"


@query(f"WITH {EMBED_CTES}, {SUBSET_EM}, sx AS ({_indexed('sub')}) SELECT cloud_id, sha256({TRIPLE_KEY}) AS set_key, count(DISTINCT (ix, iy, iz)) AS distinct_anchors FROM sx GROUP BY cloud_id")
def canonical_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Order-free key of each subset."""
    keyed = st.canonical_sets(subset(embedding_clouds(spark, folder)))
    return keyed.select("cloud_id", "set_key", F.size(F.array_distinct("triples")).cast("bigint").alias("distinct_anchors"))


COARSE = f"""WITH {EVENT_CTES}, a AS (SELECT cloud_id, 'first' AS role, x, y, z FROM ({random_subset('ev', 1, 'dup', 'first')}) UNION ALL SELECT cloud_id, 'second', x, y, z FROM ({random_subset('ev', 1, 'dup', 'second')})),
 sx AS (SELECT cloud_id, role, {', '.join(f'{index(a, 2)} AS i{a}' for a in AXES)} FROM a), k AS (SELECT cloud_id, role, sha256({TRIPLE_KEY}) AS set_key FROM sx GROUP BY cloud_id, role)
SELECT set_key, count(*) AS copies FROM k GROUP BY set_key"""


@query(COARSE)
def distinct_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Coarse one-anchor sets grouped by canonical key."""
    sets = sm.two_resamples(event_clouds(spark, folder), 1, "dup").select("cloud_id", "role", *[sm.to_index(F.col(a), 2).alias(f"i{a}") for a in AXES])
    return st.distinct_sets(sets, ["cloud_id", "role"]).select("set_key", "copies")


STREAM = f"""WITH {EMBED_CTES}, {SUBSET_EM}, sx AS ({_indexed('sub')}), n AS (SELECT cloud_id, count(*) AS n FROM em GROUP BY cloud_id),
 b AS (SELECT cloud_id, count(*) AS k, string_agg(lpad(bin(ix), {BITS}, '0') || lpad(bin(iy), {BITS}, '0') || lpad(bin(iz), {BITS}, '0'), '' ORDER BY ix, iy, iz) AS bits FROM sx GROUP BY cloud_id),
 p AS (SELECT *, rpad(bits, CAST(ceil(length(bits) / {d(8.0)}) * 8 AS INTEGER), '0') AS padded FROM b),
 h AS (SELECT cloud_id, any_value(k) AS k, any_value(n) AS n, string_agg(lpad(hex(CAST(('0b' || substr(padded, i * 8 + 1, 8)) AS BIGINT)), 2, '0'), '' ORDER BY i) AS body
   FROM (SELECT p.*, n.n, unnest(range(0, length(padded) // 8)) AS i FROM p JOIN n USING (cloud_id)) GROUP BY cloud_id)
SELECT cloud_id, '50434F4E' || '01' || '03' || lpad(hex({BITS}), 2, '0') || '01' || lpad(hex(k), 4, '0') || lpad(hex(n), 8, '0') || body AS stream_hex, CAST(14 + length(body) // 2 AS INTEGER) AS stream_bytes, true AS exact FROM h"""


@query(STREAM)
def stream_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Packed streams of every subset and whether they decode exactly."""
    points = embedding_clouds(spark, folder)
    counts = points.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("n"))
    chosen = subset(points)
    streams, _ = st.encode_sets(chosen.join(counts, "cloud_id"), bits=BITS, mode=F.lit("fps"), output_points=F.col("n"))
    decoded, _ = st.decode_sets(streams)
    report = st.round_trip_report(chosen, decoded)
    return streams.join(report, "cloud_id").select(
        "cloud_id", F.hex("stream").alias("stream_hex"), F.length("stream").alias("stream_bytes"), "exact"
    )


@query(f"""SELECT vec_id, CAST(12 + ceil(64 * 8 / {d(8.0)}) AS INTEGER) AS stream_bytes, {out(f"max(abs(e - (round_even((e + {d(1.0)}) * {d(0.5)} * {d(255.0)}, 0) * {d(2.0 / 255)} - {d(1.0)})))")} AS largest_error
 FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS e FROM embeddings) GROUP BY vec_id""")
def feature_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Embedding vectors packed at 8 bits and read back."""
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("features"))
    streams, _ = st.encode_features(vectors, bits=8, output_points=F.lit(1))
    decoded, _ = st.decode_features(streams)
    back = decoded.select("vec_id", "stream_bytes", F.col("features").alias("decoded"))
    gap = F.array_max(F.zip_with("features", "decoded", lambda a, b: F.abs(a - b)))
    return vectors.join(back, "vec_id").select("vec_id", "stream_bytes", fm.out(gap).alias("largest_error"))


@query(f"""WITH {EVENT_CTES}, {farthest('ev', 4)} SELECT {out(f"avg({d(1.0)} - hit / {d(2.0)})")} AS selection_turnover, count(*) AS clouds FROM
 (SELECT a.cloud_id, count(b.point_id) AS hit FROM ({random_subset('ev', 2, 'subset')}) a LEFT JOIN ({random_subset('ev', 4, 'other')}) b USING (cloud_id, point_id) GROUP BY a.cloud_id)""")
def selection_turnover(spark: SparkSession, folder: str) -> DataFrame:
    """How much of a small selection a larger one drops."""
    points = event_clouds(spark, folder)
    report = bh.selection_turnover(sm.random_subset(points, 2, "subset"), sm.random_subset(points, 4, "other"), 2)
    return report.select(fm.out(F.col("selection_turnover")).alias("selection_turnover"), "clouds")


def _direction(axis: str) -> str:
    return f"({hash_int(chr(39) + '0' + chr(39), 'cloud_id', s('slot'), chr(39) + axis + chr(39), s('sample'))} % 2 * 2 - 1)"


SHIFTED = f"""sh AS (SELECT cloud_id, slot, sample, {', '.join(snap(f'{a} + {d(lattice_step(6))} * {_direction(a)}', 6) + f' AS {a}' for a in AXES)}
 FROM (SELECT *, unnest(range(0, 2)) AS sample FROM s6))"""
SENSITIVITY = f"""WITH {EMBED_CTES}, s6 AS MATERIALIZED ({snapped('(' + random_subset('em', K, 'subset') + ')', 6)}), {SHIFTED}, b AS ({set_chamfer('em', 's6')}), m AS ({set_chamfer('em', 'sh', 'cloud_id, sample')})
SELECT {out('avg(m.mse - b.mse)', 9)} AS mean_change, {out('sqrt(avg((m.mse - b.mse) * (m.mse - b.mse)))', 9)} AS rms_change FROM m JOIN b USING (cloud_id)"""


@query(SENSITIVITY)
def perturbation_sensitivity(spark: SparkSession, folder: str) -> DataFrame:
    """Loss change when every coordinate moves one lattice step."""
    points = embedding_clouds(spark, folder)
    chosen = sm.quantize_anchors(sm.random_subset(points, K, "subset"), 6)
    moved = bh.shift_lattice(chosen, 6, samples=2)
    base = an.chamfer(points, chosen, K).withColumnRenamed("chamfer_mse", "loss")
    losses = an.chamfer(points, moved, K, ("cloud_id", "sample")).withColumnRenamed("chamfer_mse", "loss")
    report = bh.sensitivity(base, losses)
    return report.select(*[fm.out(F.col(c), 9).alias(c) for c in report.columns])


SCALES = (0.0, 0.05, 0.2)


def _normal(*parts: str) -> str:
    return f"(sqrt({d(-2.0)} * ln({hash_uniform(*parts, chr(39) + 'r' + chr(39))})) * cos({d(6.283185307179586)} * {hash_uniform(*parts, chr(39) + 't' + chr(39))}))"


def _noisy(axis: str) -> str:
    draw = _normal("'0'", "CAST(CAST(scale AS DECIMAL(12,6)) AS VARCHAR)", "cloud_id", s("slot"), f"'{axis}'")
    return f"CASE WHEN scale = 0 THEN {axis} ELSE greatest(least({axis} + scale * {draw}, {d(1.0)}), {d(-1.0)}) END"


@query(f"""WITH {EMBED_CTES}, {SUBSET_EM}, ns AS (SELECT cloud_id, slot, scale, {', '.join(f'{_noisy(a)} AS {a}' for a in AXES)} FROM (SELECT *, unnest([{', '.join(d(v) for v in SCALES)}]) AS scale FROM sub)),
 q AS ({set_chamfer('em', 'ns', 'cloud_id, scale')}) SELECT scale, {out('avg(mse)', 9)} AS chamfer, {out('sqrt(avg(mse))')} AS chamfer_rmse FROM q GROUP BY scale""")
def noise_response(spark: SparkSession, folder: str) -> DataFrame:
    """Chamfer of noisy copies by noise scale."""
    points = embedding_clouds(spark, folder)
    noisy = bh.gaussian_noise(subset(points), SCALES)
    losses = an.chamfer(points, noisy, K, ("cloud_id", "scale")).withColumnRenamed("chamfer_mse", "loss")
    by_scale, _ = bh.scale_response(losses)
    return by_scale.select("scale", fm.out(F.col("chamfer"), 9).alias("chamfer"), fm.out(F.col("chamfer_rmse")).alias("chamfer_rmse"))


@query(f"""WITH {EMBED_CTES}, {SUBSET_EM}, sch AS (SELECT step, exp(sum(ln({d(1.0)} - beta)) OVER (ORDER BY step)) AS ab FROM (SELECT CAST(i AS INTEGER) AS step, {d(0.01)} + i * {d(0.19 / 9)} AS beta FROM range(10) t(i))),
 m AS (SELECT cloud_id, slot, step, ab, x, y, z FROM (SELECT *, CAST(slot % 10 AS INTEGER) AS step FROM sub) JOIN sch USING (step))
SELECT cloud_id, slot, step, {', '.join(out(f"sqrt(ab) * {a} + sqrt({d(1.0)} - ab) * {_normal(chr(39) + '0' + chr(39), s('step'), 'cloud_id', s('slot'), chr(39) + a + chr(39))}") + f' AS {a}' for a in AXES)} FROM m""")
def forward_noise(spark: SparkSession, folder: str) -> DataFrame:
    """Noise-schedule mixing of anchors at per-row steps."""
    schedule = bh.noise_schedule(spark, 10, 0.01, 0.2)
    sets = subset(embedding_clouds(spark, folder)).withColumn("step", (F.col("slot") % 10).cast("int"))
    return bh.forward_noise(sets, schedule).select("cloud_id", "slot", "step", *[fm.out(F.col(a)).alias(a) for a in AXES])


@query(f"""WITH {EMBED_CTES} SELECT cloud_id, point_id, {', '.join(out(snap(f"{a} + ({hash_uniform(chr(39) + 'jitter' + chr(39), 'cloud_id', s('point_id'), chr(39) + a + chr(39))} - {d(0.5)}) * {d(lattice_step(6))}", 6)) + f' AS {a}' for a in AXES)} FROM em""")
def half_bin_jitter(spark: SparkSession, folder: str) -> DataFrame:
    """Coordinates jittered by at most half a step, then snapped."""
    return embedding_clouds(spark, folder).select("cloud_id", "point_id", *[
        fm.out(jittered_snap(F.col(a), 6, "jitter", F.col("cloud_id"), F.col("point_id"), a)).alias(a) for a in AXES
    ])


STABILITY = f"""WITH {EVENT_CTES}, a AS ({random_subset('ev', K, 'pair', 'first')}), b AS ({random_subset('ev', K, 'pair', 'second')}), q AS ({set_chamfer('a1', 'b1')})
SELECT {out('sqrt(avg(mse))')} AS stability_rmse, count(*) AS clouds FROM q""".replace(", q AS", ", a1 AS (SELECT * FROM a), b1 AS (SELECT * FROM b), q AS")


@query(STABILITY)
def resampling_stability(spark: SparkSession, folder: str) -> DataFrame:
    """RMS set distance between two resamples of each cloud."""
    both = sm.two_resamples(event_clouds(spark, folder), K, "pair")
    report = bh.resampling_stability(both.filter("role = 'first'"), both.filter("role = 'second'"))
    return report.select(fm.out(F.col("stability_rmse")).alias("stability_rmse"), "clouds")


PARTNERS = f"""{', '.join(f"mg{i} AS (SELECT * FROM ({random_subset('em', 4, 'message', str(i))}))" for i in range(2))}, {', '.join(f"pt{j} AS (SELECT * FROM ({random_subset('em', 6, 'partner', str(j))}))" for j in range(3))},
 {', '.join(f"q{i}{j} AS ({set_chamfer(f'pt{j}', f'mg{i}')})" for i in range(2) for j in range(3))}, lo AS ({' UNION ALL '.join(f'SELECT CAST({i} AS INTEGER) AS message, CAST({j} AS INTEGER) AS partner, mse FROM q{i}{j}' for i in range(2) for j in range(3))}),
 mx AS (SELECT message, partner, avg(mse) AS mse FROM lo GROUP BY ALL)"""


@query(f"""WITH {EMBED_CTES}, {PARTNERS} SELECT message, {out(f"avg(mse) + {d(0.5)} * max(mse)", 9)} AS score, {out('sqrt(avg(mse))')} AS mean_rmse, arg_max(partner, (mse, -partner)) AS worst_partner, {out('sqrt(max(mse))')} AS worst_rmse FROM mx GROUP BY message""")
def partner_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every message set against every stored partner set."""
    points = embedding_clouds(spark, folder)

    def family(name: str, count: int, size: int) -> DataFrame:
        frames = [sm.random_subset(points, size, name, str(i)).withColumn(name, F.lit(i)) for i in range(count)]
        whole = frames[0]
        for frame in frames[1:]:
            whole = whole.unionByName(frame)
        return whole

    matrix = bh.partner_matrix(bh.partner_losses(family("message", 2, 4), family("partner", 3, 6)))
    report = bh.partner_report(matrix, 0.5)
    return report.select("message", fm.out(F.col("score"), 9).alias("score"), fm.out(F.col("mean_rmse")).alias("mean_rmse"), "worst_partner", fm.out(F.col("worst_rmse")).alias("worst_rmse"))


@query(f"""WITH {EMBED_CTES} SELECT cloud_id, slot, point_id, {out('score')} AS score FROM (SELECT cloud_id, point_id, score, CAST(row_number() OVER (PARTITION BY cloud_id ORDER BY score DESC, point_id) - 1 AS INTEGER) AS slot FROM
 (SELECT cloud_id, point_id, x - ln(-ln(greatest({d(1e-6)}, least({d(1.0 - 1e-6)}, {hash_uniform(chr(39) + 'gumbel' + chr(39), 'cloud_id', s('point_id'))})))) AS score FROM em)) WHERE slot < {K}""")
def weighted_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """Score-weighted draw without replacement."""
    points = embedding_clouds(spark, folder)
    score = sm.gumbel_score(F.col("x"), "gumbel", F.col("cloud_id"), F.col("point_id"))
    return sm.top_scores(points, score, K).select("cloud_id", "slot", "point_id", fm.out(F.col("score")).alias("score"))


ENTROPY = f"""WITH c AS (SELECT user_id, CAST(day(ts) % 2 AS INTEGER) AS turn, event_type, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id, turn) AS p FROM c),
 e AS (SELECT user_id, turn, sum(-p * ln(p)) AS h FROM p GROUP BY ALL), t AS (SELECT user_id, count(DISTINCT event_type) AS n FROM events GROUP BY user_id)
SELECT {out('avg(h / ln(CAST(greatest(n - turn, 2) AS DOUBLE)))')} AS normalized_entropy FROM e JOIN t USING (user_id)"""


@query(ENTROPY)
def selection_entropy(spark: SparkSession, folder: str) -> DataFrame:
    """Normalized entropy of each user's event-type choices by turn."""
    events = spark.read.parquet(f"{folder}/events.parquet").select(
        F.col("user_id").alias("cloud_id"), (F.dayofmonth("ts") % 2).cast("int").alias("turn"), "event_type"
    )
    counts = events.groupBy("cloud_id", "turn", "event_type").agg(F.count(F.lit(1)).alias("_n"))
    totals = counts.groupBy("cloud_id", "turn").agg(F.sum("_n").alias("_t"))
    choices = counts.join(totals, ["cloud_id", "turn"]).withColumn("p", F.col("_n") / F.col("_t"))
    kinds = events.groupBy("cloud_id").agg(F.count_distinct("event_type").alias("n"))
    report = bh.selection_entropy(choices, kinds)
    return report.select(fm.out(F.col("normalized_entropy")).alias("normalized_entropy"))


@query()
def step_curves(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics by refinement step for free sets and their strict subsets."""
    points = embedding_clouds(spark, folder)
    current = subset(points).select("cloud_id", "slot", *AXES)
    frames = []
    for step in range(3):
        if step:
            moved = fo.soft_means(points, current, 0.01)
            current = se.cut_lineage(moved.select("cloud_id", "slot", *[sm.snap(F.col(a), BITS).alias(a) for a in AXES]))
        strict = asg.unique_projection(current, points, K, BITS).select("cloud_id", "slot", *AXES)
        frames += [current.withColumns({"step": F.lit(step), "mode": F.lit("free")}), strict.withColumns({"step": F.lit(step), "mode": F.lit("strict_subset")})]
    sets = frames[0]
    for frame in frames[1:]:
        sets = sets.unionByName(frame)
    sets = se.cut_lineage(sets)
    quality = an.set_quality(points, sets, K, ("cloud_id", "step", "mode"))
    curves = bh.step_curves(quality, sets, BITS)
    return curves.select("step", "mode", "clouds", *[fm.out(F.col(c)).alias(c) for c in ("chamfer_rmse", "surface_rmse", "coverage_rmse", "lattice_error")])


@query()
def staged_size_gap(spark: SparkSession, folder: str) -> DataFrame:
    """Staged merge against direct merge and farthest points at the final size."""
    points = embedding_clouds(spark, folder)
    staged = merge_path(points, (16, 8, 4), BITS).filter("k = 4").withColumn("method", F.lit("staged"))
    direct = merge_path(points, (16, 4), BITS).filter("k = 4").withColumn("method", F.lit("direct"))
    plain = sm.quantize_anchors(farthest_points(points, 4), BITS).select("cloud_id", F.lit(4).alias("k"), "slot", *AXES).withColumn("method", F.lit("fps"))
    sets = staged.unionByName(direct).unionByName(plain)
    losses = an.chamfer(points, sets.withColumnRenamed("k", "size"), 4, ("cloud_id", "method"))
    summary = losses.groupBy("method").agg(F.sqrt(F.avg("chamfer_mse")).alias("chamfer_rmse")).withColumn("k", F.lit(4))
    gap = bh.final_size_gap(summary, ("staged", "direct", "fps"), 4)
    return gap.select("k", *[fm.out(F.col(c)).alias(c) for c in gap.columns if c != "k"])
