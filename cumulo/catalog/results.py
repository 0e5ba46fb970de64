"""Queries over manifests and result rows, each with its check in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cumulo.catalog.sqltext import d, draws, hash_text, out, slice_draws
from cumulo.catalog.views import (
    FACTORIAL_CTES, PART_CTES, RATE_CTES, RESULT_CTES, STABILITY_CTES, STABILITY_FRESH_CTES, factorial_rows, part_manifest, rate_rows, result_rows, stability_long, stability_rows,
)
from cumulo.functions import formulas as fm
from cumulo.functions import lattice as lt
from cumulo.operators import sampling as sm
from cumulo.plans import gates as gt
from cumulo.plans import results as rs
from cumulo.plans import statistics as sx

QUERIES: dict = {}
SQL: dict[str, str] = {}
PAIR_KEYS = ["split", "model_seed", "family", "model_id", "sample_id"]


def query(sql: str | None = None):
    def register(build):
        QUERIES[build.__name__] = build
        if sql is not None:
            SQL[build.__name__] = sql
        return build
    return register


def rounded(frame: DataFrame, *kept: str) -> DataFrame:
    """Report form: doubles rounded, NULLs and other types as they are."""
    kinds = dict(frame.dtypes)
    names = kept or frame.columns
    return frame.select(*[fm.out(F.col(c)).alias(c) if kinds[c] == "double" else F.col(c) for c in names])


IMPROVE = "100 * ({b} - {c}) / greatest({b}, CAST(1e-12 AS DOUBLE))"


@query(f"WITH {RESULT_CTES} SELECT split, method, constellation_size, count(*) AS samples, {out('avg(chamfer_mse)')} AS chamfer_mse, {out('avg(chamfer_rmse)')} AS chamfer_rmse, {out('avg(fresh_chamfer_mse)')} AS fresh_chamfer_mse FROM res GROUP BY ALL")
def benchmark_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Mean of per-cloud metrics by split, method and size."""
    return rounded(rs.average_rows(result_rows(spark, folder), ("chamfer_mse", "chamfer_rmse", "fresh_chamfer_mse", "hausdorff")))


@query(f"WITH {RESULT_CTES} SELECT split, method, family, count(*) AS clouds, {out('avg(chamfer_mse)')} AS mean_mse, CAST(grouping(family) AS INTEGER) AS is_total, {out('sqrt(avg(chamfer_mse))')} AS rmse FROM res GROUP BY GROUPING SETS ((split, method), (split, method, family))")
def family_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Totals and per-family means in one pass."""
    return rounded(rs.family_rollup(result_rows(spark, folder)))


AGG = f"""WITH {STABILITY_CTES}, c AS (SELECT arm, decoder_seed, refiner_seed, split, method, count(*) AS clouds, avg(chamfer_mse) AS chamfer_mse, sqrt(avg(chamfer_mse)) AS chamfer_rmse FROM stb GROUP BY ALL)
SELECT c.arm, c.decoder_seed, c.refiner_seed, c.split, c.method, c.clouds, {out('c.chamfer_mse')} AS chamfer_mse, {out('c.chamfer_rmse')} AS chamfer_rmse, CASE WHEN c.method <> 'fps' THEN {out(IMPROVE.format(b='f.chamfer_rmse', c='c.chamfer_rmse'))} END AS improvement_percent
FROM c LEFT JOIN c f ON f.method = 'fps' AND f.arm = c.arm AND f.decoder_seed = c.decoder_seed AND f.refiner_seed = c.refiner_seed AND f.split = c.split"""


@query(AGG)
def aggregate_rmse(spark: SparkSession, folder: str) -> DataFrame:
    """Root of the mean error per factorial cell, against the baseline method."""
    cell = ["arm", "decoder_seed", "refiner_seed", "split"]
    return rounded(rs.against_baseline(rs.aggregate_rmse(stability_rows(spark, folder), [*cell, "method"]), cell))


PAIRS = f"""pairs AS MATERIALIZED (SELECT m.split, m.model_seed, m.family, m.model_id, m.sample_id, m.method, m.chamfer_mse AS c, m.fresh_chamfer_mse AS fc, f.chamfer_mse AS b, f.fresh_chamfer_mse AS fb
 FROM res m JOIN res f ON f.method = 'fps' AND m.method <> 'fps' AND f.split = m.split AND f.model_seed = m.model_seed AND f.model_id = m.model_id)"""
WINS = "{g}, {b} AS base_rmse, {c} AS rmse, count(*) FILTER (c < b) AS wins, count(*) AS pairs, {i} AS improvement_percent FROM pairs GROUP BY ALL"


def _wins(group: str) -> str:
    return f"WITH {RESULT_CTES}, {PAIRS} SELECT " + WINS.format(g=group, b=out("sqrt(avg(b))"), c=out("sqrt(avg(c))"), i=out(IMPROVE.format(b="sqrt(avg(b))", c="sqrt(avg(c))")))


@query(_wins("split, family, method"))
def family_wins(spark: SparkSession, folder: str) -> DataFrame:
    """Paired improvement and win counts per family."""
    return rounded(rs.paired_wins(rs.paired_rows(result_rows(spark, folder), PAIR_KEYS), ["split", "family", "method"]))


@query(_wins("split, method, model_seed"))
def paired_wins(spark: SparkSession, folder: str) -> DataFrame:
    """Paired improvement and win counts per seed."""
    return rounded(rs.paired_wins(rs.paired_rows(result_rows(spark, folder), PAIR_KEYS), ["split", "method", "model_seed"]))


@query(f"WITH {RESULT_CTES}, k AS (SELECT split, model_seed, model_id, count(*) FILTER (method = 'fps') AS a, count(*) FILTER (method = 'free') AS b, count(*) FILTER (method = 'strict_subset') AS c FROM res GROUP BY ALL) SELECT count(*) AS keys, count(*) FILTER (a <> 1 OR b <> 1 OR c <> 1) AS problems FROM k")
def pairing_problems(spark: SparkSession, folder: str) -> DataFrame:
    """Cloud keys that cannot be paired."""
    rows = result_rows(spark, folder)
    bad = rs.pairing_problems(rows, ("fps", "free", "strict_subset"), PAIR_KEYS).withColumn("bad", F.lit(1))
    keys = rows.select(*PAIR_KEYS).distinct()
    return keys.join(bad.select(*PAIR_KEYS, "bad"), PAIR_KEYS, "left").agg(F.count(F.lit(1)).alias("keys"), F.count("bad").alias("problems"))


_GAIN = IMPROVE.format(b="sqrt(b)", c="sqrt(c)")


@query(f"""WITH {RESULT_CTES}, {PAIRS} SELECT split, method, {out(f"quantile_cont(sqrt(c), {d(0.5)})")} AS median_rmse, {out(f"quantile_cont(sqrt(c), {d(0.95)})")} AS p95_rmse,
 {out(f"quantile_cont({_GAIN}, {d(0.5)})")} AS median_improvement, {out(f"quantile_cont({_GAIN}, {d(0.1)})")} AS p10_improvement FROM pairs GROUP BY split, method""")
def distribution_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Per-cloud quantiles of error and paired improvement."""
    return rounded(rs.distribution_summary(rs.paired_rows(result_rows(spark, folder), PAIR_KEYS), ["split", "method"]))


@query(f"WITH {RESULT_CTES}, w AS (SELECT method FROM res QUALIFY row_number() OVER (PARTITION BY split, model_seed, model_id ORDER BY chamfer_rmse, method) = 1) SELECT method AS winner, count(*) AS cells FROM w GROUP BY method")
def winner_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How often each method wins its cloud."""
    return rs.winner_counts(result_rows(spark, folder), ["split", "model_seed", "family", "model_id"])


def rated(spark: SparkSession, folder: str) -> DataFrame:
    size = F.col("constellation_size")
    return rate_rows(spark, folder).withColumn("payload_bits", lt.payload_bits(size, 12)).withColumn(
        "actual_stream_bpp", lt.bits_per_point(lt.stream_bytes(size, 12), F.lit(2048))
    )


RATED = f"""{RATE_CTES}, rt AS MATERIALIZED (SELECT *, CAST(36 * constellation_size AS INTEGER) AS payload_bits,
 {d(8.0)} * CAST(14 + ceil(36 * constellation_size / {d(8.0)}) AS INTEGER) / 2048 AS actual_stream_bpp FROM rate)"""


@query(f"""WITH {RATED}, l AS (SELECT *, lag(chamfer_rmse) OVER w AS p FROM rt WINDOW w AS (PARTITION BY split, method ORDER BY actual_stream_bpp))
SELECT split, method, count(*) AS rate_points, count(*) FILTER (chamfer_rmse > p + {d(1e-12)}) AS violations, {out(f"coalesce(max(CASE WHEN chamfer_rmse > p + {d(1e-12)} THEN chamfer_rmse - p END), 0)")} AS largest_rise, count(*) FILTER (chamfer_rmse > p + {d(1e-12)}) = 0 AS nonincreasing FROM l GROUP BY split, method""")
def monotonicity(spark: SparkSession, folder: str) -> DataFrame:
    """Adjacent error rises along each rate curve."""
    found = rs.monotonicity(rated(spark, folder))
    largest = F.coalesce(F.array_max(F.transform("violations", lambda v: v["change"])), F.lit(0.0))
    return found.select("split", "method", "rate_points", F.size("violations").cast("bigint").alias("violations"), fm.out(largest).alias("largest_rise"), "nonincreasing")


@query(f"WITH {RATED} SELECT split, method, constellation_size, payload_bits, {out('chamfer_rmse')} AS chamfer_rmse FROM (SELECT *, min(chamfer_rmse) OVER (PARTITION BY split, method ORDER BY payload_bits ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM rt) WHERE b IS NULL OR chamfer_rmse < b")
def pareto_running(spark: SparkSession, folder: str) -> DataFrame:
    """Rate points that strictly improve on all smaller ones."""
    found = rs.running_frontier(rated(spark, folder), ["split", "method"])
    return rounded(found, "split", "method", "constellation_size", "payload_bits", "chamfer_rmse")


@query(f"WITH {RATED} SELECT split, method, constellation_size, {out('actual_stream_bpp')} AS actual_stream_bpp, {out('chamfer_rmse')} AS chamfer_rmse FROM rt a WHERE NOT EXISTS (SELECT 1 FROM rt b WHERE a.split = b.split AND b.actual_stream_bpp <= a.actual_stream_bpp AND b.chamfer_rmse <= a.chamfer_rmse AND (b.actual_stream_bpp < a.actual_stream_bpp OR b.chamfer_rmse < a.chamfer_rmse))")
def pareto_dominance(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that nothing dominates in rate and error."""
    return rounded(rs.undominated(rated(spark, folder)), "split", "method", "constellation_size", "actual_stream_bpp", "chamfer_rmse")


LOOKUP = f"""WITH {RATED}, g AS (SELECT split, 'r' || constellation_size AS rate_point, actual_stream_bpp * {d(1.1)} AS bpp, chamfer_rmse * {d(1.001)} AS rmse FROM rt WHERE method = 'strict_subset'), n AS (SELECT * FROM rt WHERE method <> 'strict_subset')
SELECT n.split, n.method, n.constellation_size, {out('n.chamfer_rmse')} AS chamfer_rmse, {out('(SELECT min(rmse) FROM g WHERE g.split = n.split AND g.bpp <= n.actual_stream_bpp)')} AS best_error_at_or_below_rate,
 {out('(SELECT min(bpp) FROM g WHERE g.split = n.split AND g.rmse <= n.chamfer_rmse)')} AS lowest_rate_at_or_below_error, EXISTS (SELECT 1 FROM g WHERE g.split = n.split AND g.bpp <= n.actual_stream_bpp AND g.rmse <= n.chamfer_rmse) AS dominated,
 (SELECT arg_min(rate_point, rmse) FROM g WHERE g.split = n.split AND g.bpp <= n.actual_stream_bpp) AS best_point_at_or_below_rate FROM n"""


@query(LOOKUP)
def at_or_below_rate(spark: SparkSession, folder: str) -> DataFrame:
    """Measured points at or below each row's rate or error, never interpolated."""
    rows = rated(spark, folder).drop("payload_bits")
    measured = rows.filter("method = 'strict_subset'").select(
        "split", F.concat(F.lit("r"), F.col("constellation_size").cast("string")).alias("rate_point"),
        (F.col("actual_stream_bpp") * F.lit(1.1)).alias("actual_stream_bpp"), (F.col("chamfer_rmse") * F.lit(1.001)).alias("chamfer_rmse"),
    )
    found = rs.at_or_below(rows.filter("method <> 'strict_subset'"), measured)
    return rounded(found, "split", "method", "constellation_size", "chamfer_rmse", "best_error_at_or_below_rate", "lowest_rate_at_or_below_error", "dominated", "best_point_at_or_below_rate")


@query(f"""WITH {RATED}, l AS (SELECT *, 100 * (chamfer_rmse - lag(chamfer_rmse) OVER w) / lag(chamfer_rmse) OVER w AS r, first_value(chamfer_rmse) OVER w AS f, last_value(chamfer_rmse) OVER (PARTITION BY split, method ORDER BY payload_bits ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS e FROM rt WINDOW w AS (PARTITION BY split, method ORDER BY payload_bits)),
 g AS (SELECT split, method, count(*) AS points, max(100 * (f - e) / f) AS ep, max(greatest(r, 0)) FILTER (r IS NOT NULL) AS mr FROM l GROUP BY split, method)
SELECT split, method, points, {out('ep')} AS endpoint_improvement_percent, {out('mr')} AS max_adjacent_regression_percent, ep >= 1 AS endpoint_passed, mr <= {d(0.5)} AS adjacency_passed, ep >= 1 AND mr <= {d(0.5)} AS passed FROM g""")
def rate_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Endpoint and adjacency thresholds per rate curve."""
    return rounded(gt.rate_curve_gate(rated(spark, folder), ["split", "method"]))


@query(f"""WITH {RESULT_CTES}, {PAIRS}, f AS (SELECT split, model_seed, family, model_id, c - b AS delta FROM pairs WHERE method = 'free'),
 x AS (SELECT *, CAST(row_number() OVER (PARTITION BY split, model_seed ORDER BY delta, model_id) AS INTEGER) AS up, CAST(row_number() OVER (PARTITION BY split, model_seed ORDER BY delta DESC, model_id DESC) AS INTEGER) AS dn FROM f)
SELECT split, model_seed, family, model_id, {out('delta', 9)} AS delta, up AS rank, 'largest_improvement' AS selection, delta > 0 AS is_worse FROM x WHERE up <= 3 UNION ALL SELECT split, model_seed, family, model_id, {out('delta', 9)}, dn, 'worst_case', delta > 0 FROM x WHERE dn <= 3""")
def tail_examples(spark: SparkSession, folder: str) -> DataFrame:
    """Strongest improvements and worst cases per seed and split."""
    pairs = rs.paired_rows(result_rows(spark, folder).filter("method <> 'strict_subset'"), PAIR_KEYS)
    found = rs.tail_examples(pairs, ["split", "model_seed"], ["model_id"])
    return found.select("split", "model_seed", "family", "model_id", fm.out(F.col("delta"), 9).alias("delta"), "rank", "selection", "is_worse")


@query(f"WITH {RATED} SELECT split, constellation_size, method, {out('chamfer_rmse')} AS chamfer_rmse, CAST(row_number() OVER (PARTITION BY split, constellation_size ORDER BY chamfer_rmse, method) AS INTEGER) AS place FROM rt")
def method_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """Methods by error at every rate point."""
    ranked = rs.ranking(rated(spark, folder), ["split", "constellation_size"], "chamfer_rmse")
    return rounded(ranked, "split", "constellation_size", "method", "chamfer_rmse", "place")


SCORES = f"sco AS (SELECT decoder_seed, refiner_seed AS epoch, arm AS kind, sqrt(avg(chamfer_mse)) AS score FROM stb WHERE method = 'fps' GROUP BY ALL)"


@query(f"WITH {STABILITY_CTES}, {SCORES} SELECT decoder_seed, epoch, kind, {out('score')} AS calibration_chamfer_rmse FROM sco QUALIFY row_number() OVER (PARTITION BY decoder_seed ORDER BY score, epoch) = 1")
def pick_by_score(spark: SparkSession, folder: str) -> DataFrame:
    """Calibration choice per decoder seed."""
    scores = stability_rows(spark, folder).filter("method = 'fps'").groupBy(
        "decoder_seed", F.col("refiner_seed").alias("epoch"), F.col("arm").alias("kind")
    ).agg(F.sqrt(F.avg("chamfer_mse")).alias("calibration_chamfer_rmse"))
    return rounded(rs.pick_by_score(scores))


@query(f"""WITH {RATED}, ok AS (SELECT * FROM rt WHERE constellation_size <= 8 AND method <> 'fps') SELECT g.split, o.method AS selected, {out('o.chamfer_rmse')} AS selected_value, CASE WHEN o.method IS NULL THEN 'no run met the limit' END AS reason
FROM (SELECT DISTINCT split FROM rt) g LEFT JOIN (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY split ORDER BY chamfer_rmse, method) = 1) o USING (split)""")
def constrained_best(spark: SparkSession, folder: str) -> DataFrame:
    """Best method within a size limit per split."""
    rows = rated(spark, folder)
    return rounded(rs.constrained_best(rows.filter("method <> 'fps'"), rows, ["split"], limit_column="constellation_size", limit=8, metric="chamfer_rmse", label="method"))


@query(f"WITH {STABILITY_CTES}, c AS (SELECT split, arm, refiner_seed AS step, method AS mode, decoder_seed, sqrt(avg(chamfer_mse)) AS e FROM stb GROUP BY ALL) SELECT split, arm, step, mode, count(*) AS seeds, {out('sqrt(avg(e * e))')} AS aggregate_rmse FROM c GROUP BY ALL")
def convergence(spark: SparkSession, folder: str) -> DataFrame:
    """Aggregate error over seeds per step and mode."""
    curves = stability_rows(spark, folder).groupBy("split", "arm", F.col("refiner_seed").alias("step"), F.col("method").alias("mode"), "decoder_seed").agg(F.sqrt(F.avg("chamfer_mse")).alias("chamfer_rmse"))
    return rounded(rs.convergence(curves))


# ---- manifests -------------------------------------------------------------

HELD = f"""cat AS (SELECT DISTINCT category FROM pm), hc AS MATERIALIZED (SELECT category, row_number() OVER (ORDER BY {hash_text("'split'", 'category', "'heldout_category'")}, category) <= 5 AS heldout FROM cat)"""


@query(f"WITH {PART_CTES}, {HELD} SELECT category, heldout FROM hc")
def heldout_categories(spark: SparkSession, folder: str) -> DataFrame:
    """Five categories held out by hash."""
    return sm.heldout_categories(part_manifest(spark, folder), 5, "split")


RANKED = f"rk AS (SELECT p.*, h.heldout, row_number() OVER (PARTITION BY {{keys}} ORDER BY {hash_text(chr(39) + 'split' + chr(39), 'p.category', 'p.model_id')}, p.model_id) AS r FROM pm p JOIN hc h USING (category))"
PLAIN = f"{PART_CTES}, {HELD}, {RANKED.format(keys='p.category')}, sp AS (SELECT category, model_id, official_split, CASE WHEN NOT heldout AND r <= 2 THEN 'train' WHEN NOT heldout AND r <= 3 THEN 'validation' WHEN heldout AND r <= 2 THEN 'category_ood' END AS split FROM rk)"
OFFICIAL = f"""{PART_CTES}, {HELD}, {RANKED.format(keys='p.official_split, p.category')}, sp AS (SELECT category, model_id, official_split, CASE WHEN NOT heldout AND official_split = 'train' AND r <= 1 THEN 'train' WHEN NOT heldout AND official_split = 'train' AND r <= 2 THEN 'calibration'
 WHEN NOT heldout AND official_split = 'test' AND r <= 2 THEN 'validation' WHEN heldout AND official_split = 'test' AND r <= 2 THEN 'category_ood' END AS split FROM rk)"""


def plain_split(spark: SparkSession, folder: str) -> DataFrame:
    records = part_manifest(spark, folder)
    held = sm.heldout_categories(records, 5, "split").filter("heldout")
    return sm.stratified_split(records, held, train=2, validation=1, ood=2, seed="split")


def official_split_rows(spark: SparkSession, folder: str) -> DataFrame:
    records = part_manifest(spark, folder)
    held = sm.heldout_categories(records, 5, "split").filter("heldout")
    return sm.stratified_split(records, held, train=1, calibration=1, validation=2, ood=2, seed="split", official=True)


@query(f"WITH {PLAIN} SELECT category, model_id, split FROM sp WHERE split IS NOT NULL")
def stratified_split(spark: SparkSession, folder: str) -> DataFrame:
    """Hash-ranked train, validation and OOD records per category."""
    return plain_split(spark, folder).select("category", "model_id", "split")


@query(f"WITH {OFFICIAL} SELECT category, model_id, official_split, split FROM sp WHERE split IS NOT NULL")
def official_split(spark: SparkSession, folder: str) -> DataFrame:
    """Splits that respect the official membership, with calibration."""
    return official_split_rows(spark, folder).select("category", "model_id", "official_split", "split")


@query(f"""WITH {PART_CTES}, h AS (SELECT category, model_id, {hash_text("'whole'", 'category', 'model_id')} AS hx FROM pm) SELECT category, model_id, row_number() OVER (PARTITION BY category ORDER BY hx, model_id) AS rank FROM h""")
def full_hash_order(spark: SparkSession, folder: str) -> DataFrame:
    """Hash rank of every record inside its category."""
    from cumulo.functions.hashing import hash_rank
    from cumulo.operators.ranking import hash_order
    hashed = part_manifest(spark, folder).withColumn("_h", hash_rank("whole", F.col("category"), F.col("model_id")))
    return hash_order(hashed, ["category"], "_h", ["model_id"]).select("category", "model_id", "rank")


@query(f"WITH {PLAIN} SELECT h.category, CAST(CASE WHEN h.heldout THEN 2 ELSE 3 END AS INTEGER) AS expected, count(sp.split) AS actual, count(sp.split) >= CASE WHEN h.heldout THEN 2 ELSE 3 END AS enough FROM hc h LEFT JOIN sp ON sp.category = h.category AND sp.split IS NOT NULL GROUP BY h.category, h.heldout")
def split_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Records per category against the required quota."""
    held = sm.heldout_categories(part_manifest(spark, folder), 5, "split")
    expected = held.select("category", F.when(F.col("heldout"), 2).otherwise(3).alias("expected"))
    return gt.count_report(plain_split(spark, folder), expected, ["category"])


@query(f"""WITH {OFFICIAL}, ok AS (SELECT * FROM sp WHERE split IS NOT NULL), pc AS (SELECT category, count(*) FILTER (split = 'train') AS t, count(*) FILTER (split = 'calibration') AS c, count(*) FILTER (split = 'category_ood') AS h FROM ok GROUP BY category)
SELECT 'train rows outside official train' AS rule, count(*) FILTER (split IN ('train', 'calibration') AND official_split <> 'train') AS breaches FROM ok UNION ALL SELECT 'evaluation rows outside official test', count(*) FILTER (split IN ('validation', 'category_ood') AND official_split <> 'test') FROM ok
UNION ALL SELECT 'calibration category absent from train', count(*) FILTER (c > 0 AND t = 0) FROM pc UNION ALL SELECT 'calibration category is held out', count(*) FILTER (c > 0 AND h > 0) FROM pc""")
def split_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Breaches of the official-split and containment rules."""
    return gt.split_rules(official_split_rows(spark, folder))


BOTH = "bo AS (SELECT category, model_id, 'plain_' || split AS split FROM a UNION ALL SELECT category, model_id, 'official_' || split FROM b)"
_A = PLAIN.replace("sp AS (", "a0 AS (")
OVERLAP = f"""WITH {_A}, {OFFICIAL.split(HELD + ',')[1].replace('rk AS', 'rk2 AS').replace('FROM rk)', 'FROM rk2)').replace('sp AS (', 'b0 AS (')}, bo AS (SELECT category, model_id, 'plain_' || split AS split FROM a0 WHERE split IS NOT NULL UNION ALL SELECT category, model_id, 'official_' || split FROM b0 WHERE split IS NOT NULL)
SELECT x.split AS "left", y.split AS "right", count(*) AS shared FROM bo x JOIN bo y ON x.category = y.category AND x.model_id = y.model_id AND x.split < y.split GROUP BY ALL"""


@query(OVERLAP)
def split_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Records shared between the partitions of two manifests."""
    both = plain_split(spark, folder).withColumn("split", F.concat(F.lit("plain_"), "split")).unionByName(
        official_split_rows(spark, folder).withColumn("split", F.concat(F.lit("official_"), "split"))
    )
    return rs.overlap_matrix(both, ["category", "model_id"])


@query(f"""WITH {_A}, {OFFICIAL.split(HELD + ',')[1].replace('rk AS', 'rk2 AS').replace('FROM rk)', 'FROM rk2)').replace('sp AS (', 'b0 AS (')}, x AS (SELECT DISTINCT category, model_id FROM a0 WHERE split IS NOT NULL), y AS (SELECT DISTINCT category, model_id FROM b0 WHERE split IS NOT NULL)
SELECT category, model_id, 'first' AS side FROM (SELECT * FROM x EXCEPT SELECT * FROM y) UNION ALL SELECT category, model_id, 'second' FROM (SELECT * FROM y EXCEPT SELECT * FROM x)""")
def key_difference(spark: SparkSession, folder: str) -> DataFrame:
    """Records that only one of two manifests holds."""
    return rs.key_difference(plain_split(spark, folder), official_split_rows(spark, folder), ["category", "model_id"])


def _finger(keys: str) -> str:
    """Root of the hash tree of one or two levels, which do for 262,144 members a key."""
    return f"""WITH {PART_CTES}, h AS (SELECT {keys}, sha256(category || '|' || model_id || '|' || official_split) AS h, count(*) AS n FROM pm GROUP BY ALL),
 u AS (SELECT *, count(*) OVER (PARTITION BY {keys}) AS u FROM h), lf AS (SELECT {keys}, CASE WHEN u <= 1024 THEN '' ELSE substr(h, 1, 2) END AS p, sha256(string_agg(h || ':' || n, chr(10) ORDER BY h)) AS hash, sum(n) AS n FROM u GROUP BY ALL)
SELECT {keys}, CASE WHEN max(p) = '' THEN any_value(hash) ELSE sha256(string_agg(p || ':' || hash, chr(10) ORDER BY p)) END AS fingerprint, CAST(sum(n) AS BIGINT) AS members FROM lf GROUP BY {keys}"""


FINGER = _finger("category")


@query(_finger("official_split"))
def split_identity(spark: SparkSession, folder: str) -> DataFrame:
    """Order-free digest and member count of each official split."""
    return rs.dataset_fingerprint(part_manifest(spark, folder), ["category", "model_id", "official_split"], ["official_split"])


@query(FINGER)
def dataset_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    """Order-free digest and member count per category."""
    return rs.dataset_fingerprint(part_manifest(spark, folder), ["category", "model_id", "official_split"], ["category"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS occurrences FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated (order, line) identities."""
    return gt.duplicates(spark.read.parquet(f"{folder}/lineitem.parquet"), ["l_orderkey", "l_linenumber"])


@query(f"WITH {RESULT_CTES}, c AS (SELECT split, method, model_id, count(DISTINCT model_seed) AS s, count(*) AS n FROM res GROUP BY ALL) SELECT split, method, max(s) AS seeds, count(*) AS clouds, min(s) = max(s) AND max(n) = max(s) AS same_clouds FROM c GROUP BY split, method")
def aligned_seeds(spark: SparkSession, folder: str) -> DataFrame:
    """Whether all seeds of a cell cover the same clouds."""
    return gt.aligned_seeds(result_rows(spark, folder), ["split", "method"], ["family", "model_id"])


@query(f"WITH {FACTORIAL_CTES}, g AS (SELECT arm, decoder_seed, refiner_seed, model_id FROM (SELECT DISTINCT arm FROM fac), (SELECT DISTINCT decoder_seed FROM fac), (SELECT DISTINCT refiner_seed FROM fac), (SELECT DISTINCT model_id FROM fac)) SELECT count(*) AS cells, count(*) FILTER (f.arm IS NULL) AS missing FROM g LEFT JOIN fac f USING (arm, decoder_seed, refiner_seed, model_id)")
def missing_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Factorial cells without a row."""
    from cumulo.sources.runs import grid_of
    rows = factorial_rows(spark, folder)
    keys = ["arm", "decoder_seed", "refiner_seed", "model_id"]
    grid = grid_of(rows, keys[:3], "model_id")
    missing = gt.missing_cells(rows, grid, keys).withColumn("gone", F.lit(1))
    return grid.join(missing, keys, "left").agg(F.count(F.lit(1)).alias("cells"), F.count("gone").alias("missing"))


@query(f"WITH {FACTORIAL_CTES} SELECT bool_and(chamfer_mse >= 0) AS nonnegative, bool_and(chamfer_mse <= {d(0.05)}) AS small FROM fac")
def contract_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Row conditions reduced over the whole table."""
    return gt.contract_checks(factorial_rows(spark, folder), {"nonnegative": F.col("chamfer_mse") >= 0, "small": F.col("chamfer_mse") <= 0.05})


@query(f"WITH {FACTORIAL_CTES}, h AS (SELECT arm, decoder_seed, refiner_seed, sha256(string_agg(model_id, ',' ORDER BY model_id)) AS members, sha256(CAST(round(sum(chamfer_mse) * 1e9) AS BIGINT)::VARCHAR) AS state FROM fac GROUP BY ALL) SELECT arm, count(*) AS runs, count(DISTINCT state) = count(*) AS state_unique, count(DISTINCT members) = 1 AS members_equal FROM h GROUP BY arm")
def run_identity(spark: SparkSession, folder: str) -> DataFrame:
    """Digests that must differ between seeds, and digests that must agree."""
    rows = factorial_rows(spark, folder)
    seeds = ["arm", "decoder_seed", "refiner_seed"]
    runs = rs.dataset_fingerprint(rows, ["model_id"], seeds).withColumnRenamed("fingerprint", "members_hash")
    state = rows.groupBy(*seeds).agg(F.sha2(F.round(F.sum("chamfer_mse") * 1e9).cast("bigint").cast("string"), 256).alias("state"))
    joined = runs.select(*seeds, F.col("members_hash").alias("members")).join(state, seeds)
    return gt.run_identity(joined, group=["arm"], independent=["state"], shared=["members"])


_OPTIONS = "(SELECT CASE WHEN p_size % 10 = 0 THEN p_brand || ' x' ELSE p_brand END AS rate_point, CASE WHEN p_size % 7 = 0 THEN lower(p_type) ELSE '--' || lower(replace(p_type, ' ', '-')) || '=' || p_size END AS option FROM part)"


@query(f"""SELECT reason, count(*) AS options FROM (SELECT CASE WHEN rate_point LIKE '% %' THEN 'blanks in the rate point''s name' WHEN NOT regexp_matches(option, '^--[^=]*=') THEN 'not written --name=value'
 WHEN option LIKE '--s%' OR option LIKE '--promo%' THEN 'the run sets this option itself' WHEN count(*) OVER (PARTITION BY rate_point, regexp_extract(option, '^(--[^=]*)=', 1)) > 1 THEN 'given twice' END AS reason FROM {_OPTIONS}) WHERE reason IS NOT NULL GROUP BY reason""")
def option_problems(spark: SparkSession, folder: str) -> DataFrame:
    """Rate-point options that break a rule, options made of part types."""
    part = spark.read.parquet(f"{folder}/part.parquet")
    made = F.concat(F.lit("--"), F.lower(F.replace("p_type", F.lit(" "), F.lit("-"))), F.lit("="), F.col("p_size").cast("string"))
    options = part.select(
        F.when(F.col("p_size") % 10 == 0, F.concat("p_brand", F.lit(" x"))).otherwise(F.col("p_brand")).alias("rate_point"),
        F.when(F.col("p_size") % 7 == 0, F.lower("p_type")).otherwise(made).alias("option"))
    return gt.option_problems(options, ["--s", "--promo"]).groupBy("reason").agg(F.count(F.lit(1)).alias("options"))


@query("""SELECT axis, entry, CASE WHEN n > 1 THEN 'listed more than once' ELSE 'not known' END AS reason FROM (SELECT a.axis, a.entry, count(*) AS n, max(k.entry) AS k FROM
 (SELECT 'brand' AS axis, p_brand AS entry FROM part WHERE p_size = 7 UNION ALL SELECT 'kind', p_type FROM part WHERE p_size = 7) a
 LEFT JOIN (SELECT DISTINCT 'brand' AS axis, p_brand AS entry FROM part WHERE p_size < 5 UNION SELECT DISTINCT 'kind', p_type FROM part WHERE p_size < 5) k ON a.axis = k.axis AND a.entry = k.entry GROUP BY a.axis, a.entry) WHERE n > 1 OR k IS NULL""")
def plan_problems(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated and unknown entries on the two axes of a plan: parts of one size against the kinds that small parts have."""
    part = spark.read.parquet(f"{folder}/part.parquet")
    axes = lambda rows: rows.select(F.inline(F.array(
        F.struct(F.lit("brand").alias("axis"), F.col("p_brand").alias("entry")), F.struct(F.lit("kind").alias("axis"), F.col("p_type").alias("entry")))))
    return gt.plan_problems(axes(part.filter("p_size = 7")), axes(part.filter("p_size < 5")))


@query(f"WITH {RESULT_CTES} SELECT b.split, b.model_seed, count(*) AS clouds, {out('sqrt(avg(b.chamfer_mse))')} AS rmse FROM res b WHERE b.method = 'fps' AND EXISTS (SELECT 1 FROM res f WHERE f.method = 'free' AND f.split = b.split AND f.model_seed = b.model_seed AND f.family = b.family AND f.model_id = b.model_id) GROUP BY ALL")
def matched_baseline(spark: SparkSession, folder: str) -> DataFrame:
    """Baseline error over the clouds that the free method was run on."""
    rows = rs.matched_baseline(result_rows(spark, folder), "free", ["split", "model_seed"])
    return rows.groupBy("split", "model_seed").agg(F.count(F.lit(1)).alias("clouds"), fm.out(F.sqrt(F.avg("chamfer_mse"))).alias("rmse"))


@query(f"""WITH {RESULT_CTES}, a AS (SELECT split, family, model_id, model_seed, chamfer_mse, 96 + length(model_id) AS stream_bytes FROM res WHERE method = 'free'), b AS (SELECT split, family, model_id, model_seed, chamfer_mse, 96 + length(model_id) + CASE WHEN model_seed % 3 = 0 THEN 1 ELSE 0 END AS stream_bytes FROM res WHERE method = 'fps' AND model_seed <> 7)
SELECT CASE WHEN b.stream_bytes IS NULL THEN 'no reference row' WHEN a.stream_bytes <> b.stream_bytes THEN 'stream sizes differ' ELSE 'paired' END AS outcome, count(*) AS rows, {out('sum(CASE WHEN a.stream_bytes = b.stream_bytes THEN a.chamfer_mse - b.chamfer_mse END)')} AS difference FROM a LEFT JOIN b USING (split, family, model_id, model_seed) GROUP BY 1""")
def reference_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of a run against a stored reference at the same stream size, whose splits are named otherwise."""
    rows, size = result_rows(spark, folder), F.length("model_id")
    own = rows.filter("method = 'free'").withColumn("stream_bytes", 96 + size)
    stored = rows.filter("method = 'fps' AND model_seed <> 7").withColumn("stream_bytes", 96 + size + (F.col("model_seed") % 3 == 0).cast("int")).withColumn("split", F.concat(F.lit("stored_"), "split"))
    keys = ["split", "family", "model_id", "model_seed"]
    pairs, rest = rs.reference_pairs(own, stored, {"stored_validation": "validation", "stored_ood": "ood"}, keys)
    judged = pairs.select(F.lit("paired").alias("outcome"), (F.col("chamfer_mse") - F.col("reference_chamfer_mse")).alias("_d")).unionByName(
        rest.select(F.col("reason").alias("outcome"), F.lit(None).cast("double").alias("_d")))
    return judged.groupBy("outcome").agg(F.count(F.lit(1)).alias("rows"), fm.out(F.sum("_d")).alias("difference"))


@query(f"WITH {RESULT_CTES} SELECT split, method, count(*) AS rows, count(*) FILTER (method <> 'fps') AS with_fresh, {out('avg(fresh_chamfer_mse) FILTER (method <> ' + chr(39) + 'fps' + chr(39) + ')')} AS fresh FROM res GROUP BY split, method")
def united_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of which one lacks a column, as one table."""
    rows = result_rows(spark, folder)
    united = rs.union_rows([rows.filter("method <> 'fps'"), rows.filter("method = 'fps'").drop("fresh_chamfer_mse", "sample_id")])
    return united.groupBy("split", "method").agg(F.count(F.lit(1)).alias("rows"), F.count("fresh_chamfer_mse").alias("with_fresh"), fm.out(F.avg("fresh_chamfer_mse")).alias("fresh"))


# ---- statistics ------------------------------------------------------------

B = 10_000


def _long_pairs(spark: SparkSession, folder: str) -> DataFrame:
    pairs = rs.paired_rows(result_rows(spark, folder), PAIR_KEYS, ("chamfer_mse", "fresh_chamfer_mse"))
    metrics = F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"base_{m}").alias("base"), F.col(m).alias("candidate")) for m in ("chamfer_mse", "fresh_chamfer_mse")]))
    return pairs.select("split", "method", "model_seed", "family", "model_id", metrics)


def _boot(name: str, keys: str, pairs: str) -> str:
    """Bootstrap of every cell named by ``keys``; ``pairs`` selects the keys, model_seed, family, model_id, b, c."""
    stream = [f"'{name}'", *(k.strip() for k in keys.split(","))]
    return f"""WITH {RESULT_CTES}, {PAIRS}, lp AS MATERIALIZED ({pairs}),
 ix AS MATERIALIZED (SELECT *, dense_rank() OVER (PARTITION BY {keys} ORDER BY model_seed) - 1 AS s, dense_rank() OVER (PARTITION BY {keys} ORDER BY family, model_id) - 1 AS member FROM lp),
 n AS (SELECT {keys}, max(s) + 1 AS ns, max(member) + 1 AS nc FROM ix GROUP BY ALL),
 reps AS (SELECT n.*, r FROM n, range({B}) t(r)),
 sd AS (SELECT {keys}, r, u AS s, count(*) AS k FROM ({draws('reps', f'{keys}, r', 'ns', 'ns', *stream, "'seed'", 'CAST(r AS VARCHAR)')}) GROUP BY ALL),
 cd AS ({slice_draws('reps', keys, 'nc', 'nc', '0', *stream)}),
 part AS (SELECT {keys}, r, s, sum(m * b) AS tb, sum(m * c) AS tc FROM cd JOIN ix USING ({keys}, member) GROUP BY ALL),
 dr AS (SELECT {keys}, r, sum(k * tb) AS tb, sum(k * tc) AS tc FROM sd JOIN part USING ({keys}, r, s) GROUP BY ALL),
 gn AS (SELECT {keys}, {IMPROVE.format(b='sqrt(tb / (ns * nc))', c='sqrt(tc / (ns * nc))')} AS g FROM dr JOIN n USING ({keys})),
 q AS (SELECT {keys}, quantile_cont(g, {d(0.025)}) AS lo, quantile_cont(g, {d(0.975)}) AS hi FROM gn GROUP BY ALL), pt AS (SELECT {keys}, sqrt(avg(b)) AS br, sqrt(avg(c)) AS cr FROM lp GROUP BY ALL)
SELECT {keys}, {out('br')} AS base_rmse, {out('cr')} AS rmse, {out(IMPROVE.format(b='br', c='cr'))} AS improvement_percent, {out('lo')} AS ci_lower, {out('hi')} AS ci_upper, ns AS seeds, nc AS clouds FROM pt JOIN q USING ({keys}) JOIN n USING ({keys})"""


BOOT = _boot("boot", "split, method, metric", "SELECT split, method, 'chamfer_mse' AS metric, model_seed, family, model_id, b, c FROM pairs UNION ALL SELECT split, method, 'fresh_chamfer_mse', model_seed, family, model_id, fb, fc FROM pairs")


@query(BOOT)
def paired_bootstrap(spark: SparkSession, folder: str) -> DataFrame:
    """Seed-and-cloud bootstrap for every split, method and metric."""
    found = sx.paired_bootstrap(_long_pairs(spark, folder), cell=["split", "method", "metric"], cloud=["family", "model_id"], replicates=B, seed="boot")
    return rounded(found, "split", "method", "metric", "base_rmse", "rmse", "improvement_percent", "ci_lower", "ci_upper", "seeds", "clouds")


CELLS = "ce AS MATERIALIZED (SELECT arm, split, metric, decoder_seed, refiner_seed, ln(greatest(sqrt(avg(m)), CAST(1e-12 AS DOUBLE))) AS v FROM stl WHERE method = 'refiner' GROUP BY ALL)"


def _components(source: str, keys: str, row: str, column: str, name: str) -> str:
    return f"""{name}_w AS (SELECT {keys}, {row} AS rr, {column} AS cc, v, avg(v) OVER (PARTITION BY {keys}) AS g, avg(v) OVER (PARTITION BY {keys}, {row}) AS rm, avg(v) OVER (PARTITION BY {keys}, {column}) AS cm FROM {source}),
 {name}_m AS (SELECT {keys}, count(DISTINCT rr) AS nr, count(DISTINCT cc) AS nc, sum((rm - g) * (rm - g)) / (count(DISTINCT rr) - 1) AS mr, sum((cm - g) * (cm - g)) / (count(DISTINCT cc) - 1) AS mc, sum((v - rm - cm + g) * (v - rm - cm + g)) / ((count(DISTINCT rr) - 1) * (count(DISTINCT cc) - 1)) AS mi FROM {name}_w GROUP BY {keys}),
 {name} AS MATERIALIZED (SELECT *, greatest((mr - mi) / nc, 0) AS vr, greatest((mc - mi) / nr, 0) AS vc FROM {name}_m)"""


_VK = ("'var'", "arm", "split", "metric")
VARIANCE = f"""WITH {STABILITY_CTES}, {CELLS}, {_components('ce', 'arm, split, metric', 'decoder_seed', 'refiner_seed', 'pt')},
 ix AS (SELECT arm, split, metric, dense_rank() OVER (PARTITION BY arm, split, metric ORDER BY decoder_seed) - 1 AS di, dense_rank() OVER (PARTITION BY arm, split, metric ORDER BY refiner_seed) - 1 AS ri, v FROM ce),
 rp AS (SELECT arm, split, metric, nr, nc, r FROM pt, range({B}) t(r)),
 lr AS (SELECT arm, split, metric, r, a, u AS di FROM ({draws('rp', 'arm, split, metric, r, 4 * blk + quarter AS a', 'nr', 'nr', *_VK, "'row'", 'CAST(r AS VARCHAR)')})),
 lc AS (SELECT arm, split, metric, r, b, u AS ri FROM ({draws('rp', 'arm, split, metric, r, 4 * blk + quarter AS b', 'nc', 'nc', *_VK, "'column'", 'CAST(r AS VARCHAR)')})),
 lv AS (SELECT * FROM lr JOIN lc USING (arm, split, metric, r)),
 dw AS (SELECT arm, split, metric, r, a, b, v FROM lv JOIN ix USING (arm, split, metric, di, ri)), {_components('dw', 'arm, split, metric, r', 'a', 'b', 'bt')},
 q AS (SELECT arm, split, metric, quantile_cont(vr / greatest(vc + mi, {d(1e-18)}), {d(0.025)}) AS lo, quantile_cont(vr / greatest(vc + mi, {d(1e-18)}), {d(0.975)}) AS hi FROM bt GROUP BY ALL)
SELECT arm, split, metric, {out('vr', 12)} AS var_row, {out('vc', 12)} AS var_column, {out('mi', 12)} AS var_interaction, {out('vr / (vr + vc + mi)')} AS fraction_row, {out(f'vr / greatest(vc + mi, {d(1e-18)})')} AS ratio, {out('lo', 5)} AS ci_lower, {out(f'log10(greatest(hi, {d(1e-18)}))', 5)} AS log10_ci_upper,
 CASE WHEN lo > 1 THEN 'decoder_dominant' WHEN hi < 1 THEN 'refiner_or_interaction_dominant' ELSE 'inconclusive' END AS diagnosis FROM pt JOIN q USING (arm, split, metric)"""


@query(VARIANCE)
def variance_components(spark: SparkSession, folder: str) -> DataFrame:
    """Decoder against refiner variance of log error, with a bootstrap verdict."""
    cells = rs.aggregate_rmse(stability_long(spark, folder).filter("method = 'refiner'"), ["arm", "split", "metric", "decoder_seed", "refiner_seed"])
    found = sx.variance_ratio(cells, ["arm", "split", "metric"], replicates=B, seed="var")
    digits = {"var_row": 12, "var_column": 12, "var_interaction": 12, "fraction_row": 6, "ratio": 6, "ci_lower": 5}
    upper = fm.out(F.log10(F.greatest("ci_upper", F.lit(1e-18))), 5).alias("log10_ci_upper")
    return found.select("arm", "split", "metric", *[fm.out(F.col(c), n).alias(c) for c, n in digits.items()], upper, "diagnosis")


def _marginals(spark: SparkSession, folder: str) -> DataFrame:
    cells = rs.aggregate_rmse(stability_long(spark, folder), ["arm", "split", "method", "metric", "decoder_seed", "refiner_seed"])

    def side(arm: str, method: str):
        return F.sqrt(F.avg(F.when((F.col("arm") == arm) & (F.col("method") == method), F.col("chamfer_mse"))))

    return cells.groupBy("split", "metric", "decoder_seed").agg(
        side("baseline", "refiner").alias("baseline"), side("stabilized", "refiner").alias("stabilized"), side("stabilized", "fps").alias("stabilized_fps")
    )


_MARG = """cm AS (SELECT arm, split, method, metric, decoder_seed, refiner_seed, avg(m) AS m FROM stl GROUP BY ALL),
 mg AS MATERIALIZED (SELECT split, metric, decoder_seed, sqrt(avg(m) FILTER (arm = 'baseline' AND method = 'refiner')) AS b, sqrt(avg(m) FILTER (arm = 'stabilized' AND method = 'refiner')) AS s, sqrt(avg(m) FILTER (arm = 'stabilized' AND method = 'fps')) AS f FROM cm GROUP BY ALL)"""
_Q = "quantile_cont({c}, CAST({p} AS DOUBLE))"
TAIL = f"""WITH {STABILITY_CTES}, {_MARG}, ix AS (SELECT *, dense_rank() OVER (PARTITION BY split, metric ORDER BY decoder_seed) - 1 AS i, count(*) OVER (PARTITION BY split, metric) AS n FROM mg),
 dr AS (SELECT split, metric, r, u AS i FROM ({draws(f'(SELECT DISTINCT split, metric, n, r FROM ix, range({B}) t(r))', 'split, metric, r', 'n', 'n', "'tail'", 'split', 'metric', "'unit'", 'CAST(r AS VARCHAR)')})), qd AS (SELECT split, metric, r, {_Q.format(c='b', p=0.9)} AS qb, {_Q.format(c='s', p=0.9)} AS qs FROM dr JOIN ix USING (split, metric, i) GROUP BY ALL),
 ci AS (SELECT split, metric, {_Q.format(c=IMPROVE.format(b='qb', c='qs'), p=0.025)} AS lo, {_Q.format(c=IMPROVE.format(b='qb', c='qs'), p=0.975)} AS hi FROM qd GROUP BY split, metric),
 pt AS (SELECT split, metric, count(*) AS units, {_Q.format(c='b', p=0.9)} AS qb, {_Q.format(c='s', p=0.9)} AS qs, {_Q.format(c='b', p=0.5)} AS mb, {_Q.format(c='s', p=0.5)} AS ms, {_Q.format(c=IMPROVE.format(b='f', c='s'), p=0.5)} AS gf, count(*) FILTER (s < b) AS wb, count(*) FILTER (s < f) AS wf FROM mg GROUP BY split, metric)
SELECT split, metric, units, {out('qb')} AS baseline_q90, {out('qs')} AS stabilized_q90, {out(IMPROVE.format(b='qb', c='qs'))} AS q90_reduction_percent, {out('lo')} AS ci_lower, {out('hi')} AS ci_upper, {out(IMPROVE.format(b='mb', c='ms'))} AS median_reduction_percent, {out('gf')} AS median_gain_over_fps_percent, wb AS better_than_baseline, wf AS better_than_fps FROM pt JOIN ci USING (split, metric)"""


@query(TAIL)
def q90_bootstrap(spark: SparkSession, folder: str) -> DataFrame:
    """Q90 reduction over decoder marginals with shared draws."""
    found = sx.tail_reduction(_marginals(spark, folder), ["split", "metric"], replicates=B, seed="tail")
    return rounded(found, "split", "metric", "units", "baseline_q90", "stabilized_q90", "q90_reduction_percent", "ci_lower", "ci_upper", "median_reduction_percent", "median_gain_over_fps_percent", "better_than_baseline", "better_than_fps")


@query(f"""SELECT *, primary_material AND other_holds AS passed FROM (SELECT bool_or(split = 'validation' AND q90_reduction_percent >= 5 AND ci_lower > 0 AND median_reduction_percent >= -1 AND median_gain_over_fps_percent >= 10) AS primary_material,
 bool_or(split = 'ood' AND q90_reduction_percent > 0 AND median_gain_over_fps_percent >= 10) AS other_holds FROM ({TAIL}) WHERE metric = 'chamfer_rmse')""")
def stability_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on the Q90 report of the primary metric."""
    tails = sx.tail_reduction(_marginals(spark, folder), ["split", "metric"], replicates=B, seed="tail")
    return gt.stability_gate(tails.filter("metric = 'chamfer_rmse'"))


SPEAR = f"""WITH {STABILITY_CTES}, {_MARG}, u AS (SELECT split, round(b, 3) AS x, round(s, 3) AS y FROM mg WHERE metric = 'chamfer_rmse'), rk AS (SELECT split, x, y, rank() OVER (PARTITION BY split ORDER BY x) - 1 + (count(*) OVER (PARTITION BY split, x) - 1) / {d(2.0)} AS rx, rank() OVER (PARTITION BY split ORDER BY y) - 1 + (count(*) OVER (PARTITION BY split, y) - 1) / {d(2.0)} AS ry FROM u)
SELECT split, count(*) AS n, {out('CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry) END')} AS spearman, {out('CASE WHEN stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN corr(x, y) END')} AS pearson FROM rk GROUP BY split"""


@query(SPEAR)
def spearman(spark: SparkSession, folder: str) -> DataFrame:
    """Rank and linear association of two scores over decoder seeds."""
    units = _marginals(spark, folder).filter("metric = 'chamfer_rmse'").select("split", F.round("baseline", 3).alias("x"), F.round("stabilized", 3).alias("y"))
    return rounded(sx.association(units, ["split"], "x", "y"))


_FK = ["'factor'", "split", "metric"]
FACTOR = f"""WITH {STABILITY_FRESH_CTES}, lg AS MATERIALIZED (SELECT arm, split, decoder_seed, refiner_seed, family, model_id, 'chamfer_mse' AS metric, chamfer_mse AS m FROM sf UNION ALL SELECT arm, split, decoder_seed, refiner_seed, family, model_id, 'fresh_chamfer_mse', fresh_chamfer_mse FROM sf),
 co AS (SELECT * FROM lg WHERE arm = 'stabilized'), fe AS (SELECT split, metric, decoder_seed AS feature_seed, family, model_id, avg(m) AS m FROM lg WHERE arm = 'baseline' GROUP BY ALL),
 ca AS MATERIALIZED (SELECT split, metric, dense_rank() OVER (PARTITION BY split, metric ORDER BY decoder_seed) - 1 AS di, dense_rank() OVER (PARTITION BY split, metric ORDER BY refiner_seed) - 1 AS ri, family, model_id, m FROM co),
 fa AS MATERIALIZED (SELECT split, metric, dense_rank() OVER (PARTITION BY split, metric ORDER BY feature_seed) - 1 AS si, family, model_id, m FROM fe),
 mem AS MATERIALIZED (SELECT split, metric, family, model_id, row_number() OVER (PARTITION BY split, metric, family ORDER BY model_id) - 1 AS member, count(*) OVER (PARTITION BY split, metric, family) AS size FROM (SELECT DISTINCT split, metric, family, model_id FROM co)),
 fm AS MATERIALIZED (SELECT split, metric, family, size, row_number() OVER (PARTITION BY split, metric ORDER BY family) - 1 AS grp, count(*) OVER (PARTITION BY split, metric) AS ng FROM (SELECT DISTINCT split, metric, family, size FROM mem)),
 nn AS (SELECT split, metric, max(di) + 1 AS nd, max(ri) + 1 AS nr, (SELECT max(si) + 1 FROM fa WHERE fa.split = ca.split AND fa.metric = ca.metric) AS ns FROM ca GROUP BY split, metric),
 rp AS (SELECT split, metric, ng, nd, nr, ns, r FROM (SELECT DISTINCT split, metric, ng FROM fm) JOIN nn USING (split, metric), range({B}) t(r)),
 oc AS (SELECT split, metric, r, u AS grp, count(*) AS k FROM ({draws('rp', 'split, metric, r', 'ng', 'ng', *_FK, "'family'", 'CAST(r AS VARCHAR)')}) GROUP BY ALL),
 gr AS (SELECT split, metric, r, grp AS g, size, k * size AS wanted FROM oc JOIN fm USING (split, metric, grp)),
 cl AS ({slice_draws('gr', 'split, metric', 'wanted', 'size', 'g', *_FK)}),
 ck AS MATERIALIZED (SELECT split, metric, r, family, model_id, m AS k FROM cl JOIN fm USING (split, metric, grp) JOIN mem USING (split, metric, family, member)),
 wd AS (SELECT split, metric, r, u AS di, count(*) AS k FROM ({draws('rp', 'split, metric, r', 'nd', 'nd', *_FK, "'decoder'", 'CAST(r AS VARCHAR)')}) GROUP BY ALL),
 wr AS (SELECT split, metric, r, u AS ri, count(*) AS k FROM ({draws('rp', 'split, metric, r', 'nr', 'nr', *_FK, "'refiner'", 'CAST(r AS VARCHAR)')}) GROUP BY ALL),
 wf AS (SELECT split, metric, r, u AS si, count(*) AS k FROM ({draws('rp', 'split, metric, r', 'ns', 'ns', *_FK, "'feature'", 'CAST(r AS VARCHAR)')}) GROUP BY ALL),
 tot AS (SELECT split, metric, r, sum(k) AS k FROM ck GROUP BY ALL),
 pa AS (SELECT split, metric, r, di, ri, sum(k * m) AS t FROM ck JOIN ca USING (split, metric, family, model_id) GROUP BY ALL), pb AS (SELECT split, metric, r, si, sum(k * m) AS t FROM ck JOIN fa USING (split, metric, family, model_id) GROUP BY ALL),
 sa AS (SELECT split, metric, r, sum(wd.k * wr.k * t) AS t FROM pa JOIN wd USING (split, metric, r, di) JOIN wr USING (split, metric, r, ri) GROUP BY ALL), sb AS (SELECT split, metric, r, sum(wf.k * t) AS t FROM pb JOIN wf USING (split, metric, r, si) GROUP BY ALL),
 g AS (SELECT split, metric, {IMPROVE.format(b='sqrt(sb.t / (tot.k * ns))', c='sqrt(sa.t / (tot.k * nd * nr))')} AS g FROM sa JOIN sb USING (split, metric, r) JOIN tot USING (split, metric, r) JOIN nn USING (split, metric)),
 q AS (SELECT split, metric, quantile_cont(g, {d(0.025)}) AS lo, quantile_cont(g, {d(0.975)}) AS hi FROM g GROUP BY ALL),
 p AS (SELECT split, metric, (SELECT sqrt(avg(m)) FROM ca WHERE ca.split = nn.split AND ca.metric = nn.metric) AS c, (SELECT sqrt(avg(m)) FROM fa WHERE fa.split = nn.split AND fa.metric = nn.metric) AS f FROM nn)
SELECT split, metric, {out('c')} AS coordinate_rmse, {out('f')} AS feature_rmse, {out(IMPROVE.format(b='f', c='c'))} AS improvement_percent, {out('lo')} AS ci_lower, {out('hi')} AS ci_upper FROM p JOIN q USING (split, metric)"""


@query(FACTOR)
def factor_bootstrap(spark: SparkSession, folder: str) -> DataFrame:
    """Independent factors with hierarchical family and cloud draws, for every split and metric."""
    metrics = F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("mse")) for m in ("chamfer_mse", "fresh_chamfer_mse")]))
    rows = stability_rows(spark, folder, by_method=False).select("arm", "split", "decoder_seed", "refiner_seed", "family", "model_id", metrics)
    feature = rows.filter("arm = 'baseline'").groupBy("split", "metric", F.col("decoder_seed").alias("feature_seed"), "family", "model_id").agg(F.avg("mse").alias("mse"))
    found = sx.factor_bootstrap(rows.filter("arm = 'stabilized'"), feature, cell=["split", "metric"], metric="mse", replicates=B, seed="factor")
    return rounded(found, "split", "metric", "coordinate_rmse", "feature_rmse", "improvement_percent", "ci_lower", "ci_upper")


@query(f"SELECT count(*) AS comparisons, bool_or(split = 'validation' AND metric = 'chamfer_mse' AND ci_lower > 0) AS passed, max(ci_lower) FILTER (split = 'validation' AND metric = 'chamfer_mse') AS primary_ci_lower FROM ({FACTOR})")
def learned_codec_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Whether coordinate sets beat learned features on the primary split and metric."""
    return gt.learned_codec_gate(factor_bootstrap(spark, folder))


@query(f"WITH {STABILITY_CTES}, a AS (SELECT decoder_seed, refiner_seed, split, method, sqrt(avg(chamfer_mse) FILTER (arm = 'baseline')) AS b, sqrt(avg(chamfer_mse) FILTER (arm = 'stabilized')) AS s FROM stb GROUP BY ALL) SELECT decoder_seed, refiner_seed, split, method, {out('b')} AS baseline_rmse, {out('s')} AS stabilized_rmse, {out(IMPROVE.format(b='b', c='s'))} AS improvement_percent FROM a")
def arm_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """Both arms of every factorial cell."""
    return rounded(rs.arm_comparison(stability_rows(spark, folder), ["decoder_seed", "refiner_seed", "split", "method"]))


_GATE_BOOT = _boot("gate", "split", "SELECT split, model_seed, family, model_id, b, c FROM pairs WHERE method = 'free'")


@query(f"""WITH {RESULT_CTES}, {PAIRS}, ps AS (SELECT split, model_seed, sqrt(avg(b)) > sqrt(avg(c)) AS better FROM pairs WHERE method = 'free' GROUP BY ALL), es AS (SELECT split, bool_and(better) AS es FROM ps GROUP BY split),
 fb AS (SELECT bool_or(better) AS fallback_improves FROM (SELECT split, sqrt(avg(b)) > sqrt(avg(c)) AS better FROM pairs WHERE method = 'strict_subset' GROUP BY split)),
 dg AS (SELECT count(DISTINCT state) = count(*) AS runs_independent FROM (SELECT model_seed, CAST(round(sum(chamfer_mse) * 1e9) AS BIGINT) AS state FROM res GROUP BY model_seed))
SELECT *, cells > 0 AND every_seed_improves AND intervals_positive AND fallback_improves AND runs_independent AS passed FROM (SELECT count(*) AS cells, bool_and(es) AS every_seed_improves, bool_and(ci_lower > 0) AS intervals_positive FROM ({_GATE_BOOT}) g JOIN es USING (split)), fb, dg""")
def benefit_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Every seed improves, every interval excludes zero, the plain variant helps somewhere, and no two runs are the same."""
    rows = result_rows(spark, folder)
    long = _long_pairs(spark, folder).filter("metric = 'chamfer_mse'")
    intervals = sx.paired_bootstrap(long.filter("method = 'free'"), cell=["split"], cloud=["family", "model_id"], replicates=B, seed="gate")
    per_seed = rs.paired_wins(rs.paired_rows(rows.filter("method <> 'strict_subset'"), PAIR_KEYS), ["split", "model_seed"])
    fallback = rs.paired_wins(rs.paired_rows(rows.filter("method <> 'free'"), PAIR_KEYS), ["split"])
    runs = rows.groupBy("model_seed").agg(F.round(F.sum("chamfer_mse") * 1e9).cast("bigint").alias("state"))
    return gt.benefit_gate(intervals.select("split", "ci_lower"), per_seed, ["split"], fallback=fallback, runs=runs, identity="state")


@query(f"""WITH {RATED}, w AS (SELECT split, max(chamfer_rmse) FILTER (method = 'fps' AND constellation_size = 16) AS f, max(chamfer_rmse) FILTER (method = 'free' AND constellation_size = 16) AS l FROM rt GROUP BY split)
SELECT split, {out('100 * (l - f) / f')} AS learned_gap_percent, 100 * (l - f) / f <= 5 AS gap_passed FROM w""")
def matched_rate_gap(spark: SparkSession, folder: str) -> DataFrame:
    """Learned against farthest-point error at one rate per split."""
    rows = rated(spark, folder).filter("constellation_size = 16")
    wide = rows.groupBy("split").agg(*[F.max(F.when(F.col("method") == m, F.col("chamfer_rmse"))).alias(m) for m in ("fps", "free")])
    gap = fm.gap_percent(F.col("free"), F.col("fps"))
    return wide.select("split", fm.out(gap).alias("learned_gap_percent"), (gap <= 5).alias("gap_passed"))
