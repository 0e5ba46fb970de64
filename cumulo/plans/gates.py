"""Checks that end in pass or fail, each returning rows that explain the verdict."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cumulo.functions.formulas import gap_percent
from cumulo.plans.results import constrained_best, curve_statistics


def duplicates(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences")).filter("occurrences > 1")


def count_report(rows: DataFrame, expected: DataFrame, keys: Sequence[str], need: str = "expected") -> DataFrame:
    """Actual against expected rows per key; keys without rows count zero."""
    actual = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("actual"))
    return expected.join(actual, list(keys), "left").withColumn("actual", F.coalesce("actual", F.lit(0))).withColumn(
        "enough", F.col("actual") >= F.col(need)
    )


def missing_cells(rows: DataFrame, grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells of a complete design that have no row."""
    return grid.select(*keys).join(rows.select(*keys).distinct(), list(keys), "left_anti")


def aligned_seeds(rows: DataFrame, cell: Sequence[str], cloud: Sequence[str], seed: str = "model_seed") -> DataFrame:
    """Per cell: do all seeds cover the same clouds at one byte count?

    Each cloud counts its seeds, so no set of keys is gathered.
    """
    per_cloud = rows.groupBy(*cell, *cloud).agg(F.count_distinct(seed).alias("_seeds"), F.count(F.lit(1)).alias("_rows"))
    checks = [F.max("_seeds").alias("seeds"), F.min("_seeds").alias("_least"), F.max("_rows").alias("_most"), F.count(F.lit(1)).alias("clouds")]
    report = per_cloud.groupBy(*cell).agg(*checks)
    report = report.withColumn("same_clouds", (F.col("_least") == F.col("seeds")) & (F.col("_most") == F.col("seeds"))).drop("_least", "_most")
    if "stream_bytes" in rows.columns:
        report = report.join(rows.groupBy(*cell).agg((F.count_distinct("stream_bytes") == 1).alias("one_rate")), list(cell))
    return report


def split_rules(manifest: DataFrame, *, train: str = "train", calibration: str = "calibration", evaluation: Sequence[str] = ("validation", "category_ood"),
                heldout: str = "category_ood") -> DataFrame:
    """Rows that break a split rule, counted by rule (rules without breaches show zero)."""
    per_category = manifest.groupBy("category").agg(
        F.count_if(F.col("split") == train).alias("_train"), F.count_if(F.col("split") == calibration).alias("_cal"), F.count_if(F.col("split") == heldout).alias("_held")
    )
    rows = manifest.agg(
        F.count_if(F.col("split").isin(train, calibration) & (F.col("official_split") != "train")).alias("train rows outside official train"),
        F.count_if(F.col("split").isin(list(evaluation)) & (F.col("official_split") != "test")).alias("evaluation rows outside official test"),
    )
    categories = per_category.agg(
        F.count_if((F.col("_cal") > 0) & (F.col("_train") == 0)).alias("calibration category absent from train"),
        F.count_if((F.col("_cal") > 0) & (F.col("_held") > 0)).alias("calibration category is held out"),
    )

    def tall(frame: DataFrame) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(c).alias("rule"), F.col(f"`{c}`").alias("breaches")) for c in frame.columns])
        return frame.select(F.inline(pairs))

    return tall(rows).unionByName(tall(categories))


def hash_drift(manifest: DataFrame, catalog: DataFrame) -> DataFrame:
    """Manifest files that are unsafe, missing or changed: path and reason."""
    path = F.col("mesh")
    unsafe = path.rlike(r"^(/|[A-Za-z]:)") | path.rlike(r"(^|/)\.\.(/|$)")
    joined = manifest.join(catalog.select("mesh", F.col("mesh_sha256").alias("_actual")), "mesh", "left")
    reason = F.when(unsafe, "unsafe path").when(F.col("_actual").isNull(), "file is missing").when(F.col("_actual") != F.col("mesh_sha256"), "content differs")
    return joined.withColumn("reason", reason).filter("reason IS NOT NULL").select("mesh", "reason")


def matches_digest(actual: DataFrame, expected: str, column: str = "fingerprint") -> DataFrame:
    return actual.withColumn("matches", F.col(column) == F.lit(expected))


def rate_curve_gate(summary: DataFrame, keys: Sequence[str], *, min_endpoint: float = 1.0, max_adjacent: float = 0.5,
                    rate: str = "payload_bits", error: str = "chamfer_rmse", clamp_regression: bool = True) -> DataFrame:
    """Does more rate buy fidelity? Endpoint and adjacency thresholds per curve.

    A curve of a single point cannot be judged: its checks are NULL and it fails.
    """
    stats = curve_statistics(summary, keys, rate, error, clamp_regression)
    judged = stats.withColumns({
        "endpoint_passed": F.col("endpoint_improvement_percent") >= min_endpoint,
        "adjacency_passed": F.col("max_adjacent_regression_percent") <= max_adjacent,
    })
    return judged.withColumn("passed", F.coalesce(F.col("endpoint_passed") & F.col("adjacency_passed"), F.lit(False)) & (F.col("points") >= 2))


def _at(column: str, condition: Column) -> Column:
    return F.max(F.when(condition, F.col(column)))


def bottleneck_gate(runs: DataFrame, *, input_size: int, size: int, min_endpoint: float, max_adjacent: float, max_gap: float,
                    headroom: float, unchanged: bool) -> DataFrame:
    """Audit verdict over runs (condition, input_size, constellation_size, split, chamfer_rmse).

    Needs both FPS rate curves, a bounded learned gap on every split and an
    unchanged decoder; free-coordinate headroom is reported.
    """
    primary = F.col("constellation_size") == size
    at_input = runs.filter(F.col("input_size") == input_size)
    curves = rate_curve_gate(
        at_input.filter("condition = 'fps'"), ["split"], min_endpoint=min_endpoint, max_adjacent=max_adjacent,
        rate="constellation_size", clamp_regression=False,
    ).select("split", F.col("passed").alias("curve_passed"), "endpoint_improvement_percent", "max_adjacent_regression_percent")
    named = ("fps", "learned", "best_subset", "free_coordinates")
    values = at_input.groupBy("split").agg(
        *[_at("chamfer_rmse", primary & (F.col("condition") == n)).alias(f"_{n}") for n in named],
        reduce(lambda a, b: a & b, [F.count_if(primary & (F.col("condition") == n)) == 1 for n in named]).alias("runs_unique"),
    ).withColumns({
        "learned_gap_percent": gap_percent(F.col("_learned"), F.col("_fps")),
        "headroom_percent": -gap_percent(F.col("_free_coordinates"), F.col("_best_subset")),
    }).drop(*[f"_{n}" for n in named])
    per_split = curves.join(values, "split").withColumn("gap_passed", F.col("learned_gap_percent") <= max_gap)
    ok = F.col("curve_passed") & F.col("gap_passed") & F.col("runs_unique")
    return per_split.groupBy().agg(
        (F.bool_and(ok) & F.lit(unchanged)).alias("passed"), F.bool_and("curve_passed").alias("curves_passed"), F.bool_and("gap_passed").alias("gaps_passed"),
        F.max("learned_gap_percent").alias("largest_gap_percent"), F.min("headroom_percent").alias("least_headroom_percent"),
    ).withColumn("headroom_detected", F.col("least_headroom_percent") >= headroom)


def isolation_gate(runs: DataFrame, *, max_surface: float, max_gap: float) -> DataFrame:
    """Select on validation alone, then judge the selected run on both splits.

    ``runs``: condition, split (validation / parameter_ood), chamfer_rmse, surface.
    """
    wide = runs.groupBy("condition").agg(*[
        _at(m, F.col("split") == s).alias(f"{s}_{m}") for s in ("validation", "parameter_ood") for m in ("chamfer_rmse", "surface")
    ]).withColumns({f"{s}_surface_rmse": F.sqrt(f"{s}_surface") for s in ("validation", "parameter_ood")}).withColumn("_k", F.lit(1))
    reference = wide.filter("condition = 'fps'").select("_k", *[F.col(f"{s}_chamfer_rmse").alias(f"_fps_{s}") for s in ("validation", "parameter_ood")])
    learned = wide.filter("condition <> 'fps'")
    chosen = constrained_best(learned, reference, ["_k"], limit_column="validation_surface_rmse", limit=max_surface, metric="validation_chamfer_rmse", label="condition")
    report = chosen.join(reference, "_k").join(learned.drop("_k").withColumnRenamed("condition", "selected"), "selected", "left")
    gaps = {f"{s}_gap_percent": gap_percent(F.col(f"{s}_chamfer_rmse"), F.col(f"_fps_{s}")) for s in ("validation", "parameter_ood")}
    report = report.withColumns(gaps)
    checks = [F.col(f"{s}_gap_percent") <= max_gap for s in ("validation", "parameter_ood")] + [F.col(f"{s}_surface_rmse") <= max_surface for s in ("validation", "parameter_ood")]
    passed = F.coalesce(reduce(lambda a, b: a & b, checks), F.lit(False))
    return report.select("selected", "reason", *gaps, "validation_surface_rmse", "parameter_ood_surface_rmse", passed.alias("passed"))


def benefit_gate(intervals: DataFrame, per_seed: DataFrame, cell: Sequence[str], *, fallback: DataFrame | None = None,
                 runs: DataFrame | None = None, identity: str = "state") -> DataFrame:
    """Every seed improves and the interval excludes zero, over all cells.

    ``fallback`` (improvement_percent per cell of a plainer method) must improve
    somewhere, and no two ``runs`` may share their ``identity``, where given.
    """
    seeds = per_seed.groupBy(*cell).agg(F.bool_and(F.col("improvement_percent") > 0).alias("every_seed"))
    judged = intervals.join(seeds, list(cell)).withColumn("interval_positive", F.col("ci_lower") > 0)
    verdict = judged.groupBy().agg(
        F.count(F.lit(1)).alias("cells"), F.bool_and("every_seed").alias("every_seed_improves"), F.bool_and("interval_positive").alias("intervals_positive"))
    clauses = [F.col("cells") > 0, F.col("every_seed_improves"), F.col("intervals_positive")]
    # One row each, so the constant key joins one row with one.
    single = verdict.withColumn("_k", F.lit(1))
    if fallback is not None:
        helps = fallback.groupBy().agg(F.bool_or(F.col("improvement_percent") > 0).alias("fallback_improves"))
        single = single.join(helps.withColumn("_k", F.lit(1)), "_k")
        clauses.append(F.col("fallback_improves"))
    if runs is not None:
        unique = (F.count_distinct(identity) == F.count(F.lit(1))) & (F.count(F.lit(1)) > 0)
        single = single.join(runs.groupBy().agg(unique.alias("runs_independent")).withColumn("_k", F.lit(1)), "_k")
        clauses.append(F.col("runs_independent"))
    return single.drop("_k").withColumn("passed", F.coalesce(reduce(lambda a, b: a & b, clauses), F.lit(False)))


def learned_codec_gate(comparisons: DataFrame, *, split: str = "validation", metric: str = "chamfer_mse") -> DataFrame:
    """Passes where the interval of the primary comparison (split, metric, ci_lower) lies above zero."""
    primary = (F.col("split") == split) & (F.col("metric") == metric)
    return comparisons.groupBy().agg(
        F.count(F.lit(1)).alias("comparisons"), F.coalesce(F.bool_or(primary & (F.col("ci_lower") > 0)), F.lit(False)).alias("passed"),
        F.max(F.when(primary, F.col("ci_lower"))).alias("primary_ci_lower"))


def stability_gate(tails: DataFrame, *, primary: str = "validation", other: str = "ood", min_reduction: float = 5.0, min_median: float = -1.0,
                   min_gain: float = 10.0) -> DataFrame:
    """Material Q90 reduction on the primary split that also holds on the other."""
    material = (
        (F.col("q90_reduction_percent") >= min_reduction) & (F.col("ci_lower") > 0)
        & (F.col("median_reduction_percent") >= min_median) & (F.col("median_gain_over_fps_percent") >= min_gain)
    )
    holds = (F.col("q90_reduction_percent") > 0) & (F.col("median_gain_over_fps_percent") >= min_gain)
    return tails.groupBy().agg(
        F.bool_or((F.col("split") == primary) & material).alias("primary_material"), F.bool_or((F.col("split") == other) & holds).alias("other_holds")
    ).withColumn("passed", F.col("primary_material") & F.col("other_holds"))


def contract_checks(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Row-level conditions reduced with AND; NULL counts as broken."""
    return rows.groupBy().agg(*[F.bool_and(F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()])


def rate_alignment(first: DataFrame, second: DataFrame, bytes_column: str = "stream_bytes") -> DataFrame:
    """Rate points of two formats, whether both offer each byte count, and repeats."""
    tagged = first.select(bytes_column, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(second.select(bytes_column, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    return tagged.groupBy(bytes_column).agg(F.sum("_a").alias("in_first"), F.sum("_b").alias("in_second")).withColumn(
        "matched", (F.col("in_first") == 1) & (F.col("in_second") == 1)
    )


def plan_problems(axes: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(axis, entry, reason): entries of an experiment plan that are blank, repeated on their axis or not among the known ones.

    ``axes`` and ``known`` hold (axis, entry).
    """
    counted = axes.groupBy("axis", "entry").agg(F.count(F.lit(1)).alias("_n"))
    if known is None:
        counted = counted.withColumn("_known", F.lit(True))
    else:
        counted = counted.join(known.select("axis", "entry").distinct().withColumn("_known", F.lit(True)), ["axis", "entry"], "left")
    blank = F.col("entry").isNull() | (F.trim("entry") == "")
    reason = F.when(blank, "blank").when(F.col("_n") > 1, "listed more than once").when(F.col("_known").isNull(), "not known")
    return counted.withColumn("reason", reason).filter("reason IS NOT NULL").select("axis", "entry", "reason")


def option_problems(options: DataFrame, managed: Sequence[str]) -> DataFrame:
    """(rate_point, option, reason): names with blanks, options not written ``--name=value``, those that are managed elsewhere or given twice.

    ``options`` holds (rate_point, option); a managed option also stands for longer ones that start like it.
    """
    name = F.regexp_extract("option", r"^(--[^=]*)=", 1)
    judged = options.withColumn("_name", name).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("rate_point", "_name")))
    taken = reduce(lambda a, b: a | b, [F.col("option").startswith(m) for m in managed], F.lit(False))
    reason = (
        F.when(F.coalesce(F.length("rate_point"), F.lit(0)) == 0, "a rate point without a name")
        .when(F.col("rate_point").rlike(r"\s"), "blanks in the rate point's name")
        .when(F.col("option").isNull() | (F.col("_name") == ""), "not written --name=value")
        .when(taken, "the run sets this option itself").when(F.col("_n") > 1, "given twice")
    )
    return judged.withColumn("reason", reason).filter("reason IS NOT NULL").select("rate_point", "option", "reason")


def run_identity(runs: DataFrame, *, group: Sequence[str], independent: Sequence[str], shared: Sequence[str]) -> DataFrame:
    """Hashes that must differ between independent runs, and hashes that must agree."""
    n = F.count(F.lit(1))
    return runs.groupBy(*group).agg(
        n.alias("runs"), *[(F.count_distinct(c) == n).alias(f"{c}_unique") for c in independent],
        *[((F.count_distinct(c) == 1) & (F.count(c) == n)).alias(f"{c}_equal") for c in shared],
    )
