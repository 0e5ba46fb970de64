"""Resampling statistics over seeds and clouds.

Draws come from seeded hashes, so both sides of a comparison and every retry see
the same resample. A replicate is only ever a set of weights and sums: clouds are
resampled as trees of counts (``operators.resampling``), design-sized tables of
seeds travel whole to blocks of replicates.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cumulo.functions.draws import level_draws, level_weights
from cumulo.functions.formulas import FLOOR, improvement_percent, square
from cumulo.operators.ranking import rank_in_group
from cumulo.operators.resampling import cell_name, design_statistic, drawn_sums, group_counts, replicate_blocks, slice_counts
from cumulo.session import cut_lineage


def _interval(draws: DataFrame, keys: Sequence[str], value: str, confidence: float) -> DataFrame:
    """Percentile bounds over replicates; the number of replicates is a parameter."""
    tail = (1.0 - confidence) / 2.0
    return draws.groupBy(*keys).agg(
        F.percentile(value, F.lit(tail)).alias("ci_lower"), F.percentile(value, F.lit(1.0 - tail)).alias("ci_upper"),
        F.count(F.lit(1)).alias("replicates"),
    )


def _unit_index(rows: DataFrame, keys: Sequence[str], unit: Sequence[str], name: str) -> DataFrame:
    """Dense 0-based position of each distinct unit within its keys."""
    distinct = rows.select(*keys, *unit).distinct()
    return rank_in_group(distinct, keys, unit, rank=name)


def _by_position(of: str, count: Column, width: int) -> Column:
    """Values of 0 .. count - 1 in the map ``of``, one after the other; missing ones are zeros."""
    return F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), count.cast("long") - 1), lambda k: F.coalesce(
        F.element_at(of, k), F.array(*[F.lit(0.0)] * width))))


def paired_bootstrap(pairs: DataFrame, *, cell: Sequence[str], cloud: Sequence[str], seed_column: str = "model_seed",
                     base: str = "base", candidate: str = "candidate", replicates: int = 10_000,
                     confidence: float = 0.95, seed: object = 0) -> DataFrame:
    """Relative RMSE improvement with a seed-and-cloud bootstrap interval per cell.

    Seeds and clouds are drawn independently with replacement, the same for both
    sides. The clouds' draws are a tree of counts over slices of clouds; a replicate
    folds to two sums.
    """
    cell, cloud = list(cell), list(cloud)
    # Stored: pairs are read six times, and they are folds and joins of the given rows.
    pairs = cut_lineage(pairs.select(*cell, *cloud, seed_column, base, candidate))
    seeds = _unit_index(pairs, cell, [seed_column], "_s")
    clouds = cut_lineage(_unit_index(pairs, cell, cloud, "_c"))
    sizes = cut_lineage(seeds.groupBy(*cell).agg(F.count(F.lit(1)).alias("seeds")).join(
        clouds.groupBy(*cell).agg(F.count(F.lit(1)).alias("clouds")), cell
    ).withColumn("_cell", cell_name(seed, cell)))
    drawn = (sizes.agg(F.sum("clouds")).first()[0] or 0) * replicates
    summed = pairs.join(seeds, [*cell, seed_column]).join(clouds, [*cell, *cloud]).groupBy(*cell, "_c", "_s").agg(
        F.array(F.sum(base), F.sum(candidate)).alias("_v"))
    values = summed.groupBy(*cell, "_c").agg(F.map_from_entries(F.collect_list(F.struct("_s", "_v"))).alias("_of")).join(sizes, cell).select(
        "_cell", F.lit(0).cast("long").alias("_group"), F.col("clouds").alias("_size"), F.array("seeds").alias("_levels"), F.col("_c").alias("_member"),
        _by_position("_of", F.col("seeds"), 2).alias("_values"))
    groups = replicate_blocks(sizes, replicates).select(
        "_cell", F.lit(0).cast("long").alias("_group"), F.col("clouds").alias("_size"), "_first", F.array_repeat("clouds", F.col("_many")).alias("_n"))

    def fold(name: str, first: int, sums: np.ndarray, levels: list[int]) -> np.ndarray:
        weights = level_weights(name, "seed", first, len(sums), levels[0])
        return np.einsum("rs,rsk->rk", weights, sums.reshape(len(sums), levels[0], 2))

    sums = drawn_sums(values, slice_counts(groups, total=drawn), fold, 2, total=drawn).join(sizes, "_cell")
    total = F.col("_n") * F.col("seeds")
    draws = sums.withColumn("_gain", improvement_percent(F.sqrt(F.col("_sum_0") / total), F.sqrt(F.col("_sum_1") / total)))
    point = pairs.groupBy(*cell).agg(F.sqrt(F.avg(base)).alias("base_rmse"), F.sqrt(F.avg(candidate)).alias("rmse")).withColumn(
        "improvement_percent", improvement_percent(F.col("base_rmse"), F.col("rmse"))
    )
    return point.join(sizes.drop("_cell"), cell).join(_interval(draws, cell, "_gain", confidence), cell)


def two_way_components(cells: DataFrame, keys: Sequence[str], row: str, column: str, value: str) -> DataFrame:
    """Method-of-moments variance components of a balanced two-way table per key.

    Tables are design-sized (seeds x seeds), so plain windows suffice.
    """
    keys = list(keys)
    over = [Window.partitionBy(*keys), Window.partitionBy(*keys, row), Window.partitionBy(*keys, column)]
    spread = cells.select(
        *keys, F.col(row), F.col(column), F.col(value).alias("_v"), F.avg(value).over(over[0]).alias("_g"),
        F.avg(value).over(over[1]).alias("_rm"), F.avg(value).over(over[2]).alias("_cm"),
    )
    rows, columns = F.count_distinct(row), F.count_distinct(column)
    folded = spread.groupBy(*keys).agg(
        rows.alias("rows"), columns.alias("columns"), F.max("_g").alias("grand_mean"),
        F.sum(square(F.col("_rm") - F.col("_g"))).alias("_sr"), F.sum(square(F.col("_cm") - F.col("_g"))).alias("_sc"),
        F.sum(square(F.col("_v") - F.col("_rm") - F.col("_cm") + F.col("_g"))).alias("_se"),
    )
    r, c = F.col("rows"), F.col("columns")
    # _sr counts each row mean once per column, and the other way round.
    folded = folded.withColumns({
        "ms_row": F.col("_sr") / (r - 1), "ms_column": F.col("_sc") / (c - 1), "ms_interaction": F.col("_se") / ((r - 1) * (c - 1)),
    }).withColumns({
        "raw_row": (F.col("ms_row") - F.col("ms_interaction")) / c, "raw_column": (F.col("ms_column") - F.col("ms_interaction")) / r,
    }).withColumns({
        "var_row": F.greatest("raw_row", F.lit(0.0)), "var_column": F.greatest("raw_column", F.lit(0.0)), "var_interaction": F.col("ms_interaction"),
    })
    total = F.col("var_row") + F.col("var_column") + F.col("var_interaction")
    return folded.withColumns({
        f"fraction_{n}": F.when(total != 0, F.col(f"var_{n}") / total).otherwise(F.lit(0.0)) for n in ("row", "column", "interaction")
    }).drop("_sr", "_sc", "_se")


def _ratio(floor: float = 1e-18) -> Column:
    return F.col("var_row") / F.greatest(F.col("var_column") + F.col("var_interaction"), F.lit(floor))


def variance_ratio(cells: DataFrame, keys: Sequence[str], *, row: str = "decoder_seed", column: str = "refiner_seed", rmse: str = "chamfer_rmse",
                   replicates: int = 10_000, confidence: float = 0.95, seed: object = 0) -> DataFrame:
    """Row against column-plus-interaction variance of log RMSE, with interval and verdict.

    Replicates redraw row and column labels; a label drawn twice is two levels.
    """
    keys = list(keys)
    logged = cells.withColumn("_v", F.ln(F.greatest(rmse, F.lit(FLOOR))))
    point = two_way_components(logged, keys, row, column, "_v").withColumn("ratio", _ratio())
    ri = _unit_index(logged, keys, [row], "_ri")
    ci = _unit_index(logged, keys, [column], "_ci")
    tables = logged.join(ri, [*keys, row]).join(ci, [*keys, column]).groupBy(*keys).agg(
        (F.max("_ri") + 1).alias("_nr"), (F.max("_ci") + 1).alias("_nc"),
        F.transform(F.array_sort(F.collect_list(F.struct("_ri", "_ci", "_v"))), lambda v: v["_v"]).alias("_table")).withColumn(
        "_cell", cell_name(seed, keys))

    def ratios(name: str, first: int, many: int, given: dict) -> np.ndarray:
        r, c = given["_nr"], given["_nc"]
        table = np.array(given["_table"]).reshape(r, c)
        rows, columns = (level_draws(name, role, first, many, size) for role, size in (("row", r), ("column", c)))
        drawn = table[rows[:, :, None], columns[:, None, :]]
        rm, cm, g = drawn.mean(2, keepdims=True), drawn.mean(1, keepdims=True), drawn.mean((1, 2), keepdims=True)
        mr, mc = c * ((rm - g) ** 2).sum((1, 2)) / (r - 1), r * ((cm - g) ** 2).sum((1, 2)) / (c - 1)
        mi = ((drawn - rm - cm + g) ** 2).sum((1, 2)) / ((r - 1) * (c - 1))
        return np.maximum((mr - mi) / c, 0) / np.maximum(np.maximum((mc - mi) / r, 0) + mi, 1e-18)

    drawn = design_statistic(tables.select("_cell", "_nr", "_nc", "_table"), replicates, ratios).join(
        tables.select(*keys, "_cell"), "_cell").withColumnRenamed("_value", "_ratio")
    bounds = _interval(drawn, keys, "_ratio", confidence)
    verdict = F.when(F.col("ci_lower") > 1, "decoder_dominant").when(F.col("ci_upper") < 1, "refiner_or_interaction_dominant").otherwise("inconclusive")
    return point.join(bounds, keys).withColumn("diagnosis", verdict)


def tail_reduction(marginals: DataFrame, keys: Sequence[str], *, unit: str = "decoder_seed", replicates: int = 10_000,
                   confidence: float = 0.95, seed: object = 0) -> DataFrame:
    """Q90 reduction of the stabilized arm with shared bootstrap draws.

    ``marginals``: keys, unit, ``baseline``, ``stabilized``, ``stabilized_fps`` (RMSE per unit).
    """
    keys = list(keys)
    gain = improvement_percent(F.col("stabilized_fps"), F.col("stabilized"))

    def q(column: object, p: float) -> Column:
        return F.percentile(column, F.lit(p))

    point = marginals.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("units"), q("baseline", 0.9).alias("baseline_q90"), q("stabilized", 0.9).alias("stabilized_q90"),
        F.max("baseline").alias("baseline_max"), F.max("stabilized").alias("stabilized_max"),
        improvement_percent(q("baseline", 0.5), q("stabilized", 0.5)).alias("median_reduction_percent"),
        q(gain, 0.5).alias("median_gain_over_fps_percent"),
        F.count_if(F.col("stabilized") < F.col("baseline")).alias("better_than_baseline"),
        F.count_if(F.col("stabilized") < F.col("stabilized_fps")).alias("better_than_fps"),
    ).withColumn("q90_reduction_percent", improvement_percent(F.col("baseline_q90"), F.col("stabilized_q90")))
    ordered = F.array_sort(F.collect_list(F.struct(unit, "baseline", "stabilized")))
    tables = marginals.groupBy(*keys).agg(ordered.alias("_v")).select(
        *keys, cell_name(seed, keys).alias("_cell"), F.col("_v.baseline").alias("_b"), F.col("_v.stabilized").alias("_s"))

    def gains(name: str, first: int, many: int, given: dict) -> np.ndarray:
        index = level_draws(name, "unit", first, many, len(given["_b"]))
        before, after = (np.quantile(np.array(given[k])[index], 0.9, axis=1) for k in ("_b", "_s"))
        return 100.0 * (before - after) / np.maximum(before, FLOOR)

    draws = design_statistic(tables.select("_cell", "_b", "_s"), replicates, gains).join(tables.select(*keys, "_cell"), "_cell").withColumnRenamed("_value", "_gain")
    return point.join(_interval(draws, keys, "_gain", confidence), keys)


def average_ranks(rows: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """0-based ranks within keys; ties share their mean rank."""
    ordered = Window.partitionBy(*keys).orderBy(value)
    ties = Window.partitionBy(*keys, value)
    return rows.withColumn(name, F.rank().over(ordered) - 1 + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0))


def association(units: DataFrame, keys: Sequence[str], first: str, second: str) -> DataFrame:
    """Spearman and Pearson over independent units; NULL when a side is constant."""
    ranked = average_ranks(average_ranks(units, keys, first, "_ra"), keys, second, "_rb")

    def guarded(a: str, b: str) -> Column:
        # corr() itself divides by zero on a constant side.
        return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))

    return ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), guarded("_ra", "_rb").alias("spearman"), guarded(first, second).alias("pearson")
    )


def factor_bootstrap(coordinate: DataFrame, feature: DataFrame, *, cell: Sequence[str] = (), metric: str = "chamfer_mse",
                     replicates: int = 10_000, confidence: float = 0.95, seed: object = 0) -> DataFrame:
    """Coordinate against feature RMSE per cell, with independent factors and hierarchical clouds.

    ``coordinate``: cell, decoder_seed, refiner_seed, family, model_id, metric. ``feature``:
    cell, feature_seed, family, model_id, metric. Families are drawn, then clouds inside
    each drawn family (again for each occurrence); both sides share the cloud draw.
    Draws are a tree of counts: families, slices of a family, clouds of a slice.
    """
    # A constant column stands for the one cell of a comparison without keys.
    cell = [*cell, "_all"]
    coordinate, feature = [d.withColumn("_all", F.lit(0)) for d in (coordinate, feature)]
    factors = {"decoder": (coordinate, "decoder_seed"), "refiner": (coordinate, "refiner_seed"), "feature": (feature, "feature_seed")}
    index = {name: _unit_index(side, cell, [column], "_" + name) for name, (side, column) in factors.items()}
    families = _unit_index(coordinate, cell, ["family"], "_group")
    members = _unit_index(coordinate, [*cell, "family"], ["model_id"], "_member")
    sizes = members.groupBy(*cell, "family").agg(F.count(F.lit(1)).alias("_size")).join(families, [*cell, "family"])
    cells = families.groupBy(*cell).agg(F.count(F.lit(1)).alias("_groups"))
    for name in factors:
        cells = cells.join(index[name].groupBy(*cell).agg(F.count(F.lit(1)).alias("_n_" + name)), cell)
    cells = cells.withColumn("_cell", cell_name(seed, cell[:-1]))
    place = F.col("_decoder") * F.col("_n_refiner") + F.col("_refiner")
    known = coordinate.join(index["decoder"], [*cell, "decoder_seed"]).join(index["refiner"], [*cell, "refiner_seed"]).join(cells, cell).select(
        *cell, "family", "model_id", place.alias("_at"), F.col(metric).alias("_v"))
    known = known.unionByName(feature.join(index["feature"], [*cell, "feature_seed"]).join(cells, cell).select(
        *cell, "family", "model_id", (F.col("_n_decoder") * F.col("_n_refiner") + F.col("_feature")).alias("_at"), F.col(metric).alias("_v")))
    of = known.groupBy(*cell, "family", "model_id", "_at").agg(F.array(F.sum("_v")).alias("_v")).groupBy(*cell, "family", "model_id").agg(
        F.map_from_entries(F.collect_list(F.struct("_at", "_v"))).alias("_of"))
    width = F.col("_n_decoder") * F.col("_n_refiner") + F.col("_n_feature")
    values = of.join(members, [*cell, "family", "model_id"]).join(sizes, [*cell, "family"]).join(cells, cell).select(
        "_cell", "_group", "_size", F.array("_n_decoder", "_n_refiner", "_n_feature").alias("_levels"), "_member",
        _by_position("_of", width, 1).alias("_values"))
    drawn = group_counts(cells, replicates, "family").join(
        sizes.join(cells.select(*cell, "_cell"), cell).select("_cell", "_group", "_size"), ["_cell", "_group"]).withColumn(
        "_n", F.transform("_n", lambda k: k * F.col("_size")))

    def fold(name: str, first: int, sums: np.ndarray, levels: list[int]) -> np.ndarray:
        d, r, f = (level_weights(name, role, first, len(sums), size) for role, size in zip(("decoder", "refiner", "feature"), levels))
        grid = sums[:, :levels[0] * levels[1]].reshape(len(sums), levels[0], levels[1])
        return np.stack([np.einsum("bd,br,bdr->b", d, r, grid), (f * sums[:, levels[0] * levels[1]:]).sum(axis=1)], axis=1)

    sums = drawn_sums(values, slice_counts(drawn), fold, 2).join(cells, "_cell")
    draws = sums.withColumn("_gain", improvement_percent(
        F.sqrt(F.col("_sum_1") / (F.col("_n") * F.col("_n_feature"))), F.sqrt(F.col("_sum_0") / (F.col("_n") * F.col("_n_decoder") * F.col("_n_refiner")))))
    a = coordinate.groupBy(*cell).agg(F.sqrt(F.avg(metric)).alias("coordinate_rmse"), F.count_distinct("family").alias("families"), F.count_distinct("family", "model_id").alias("clouds"))
    b = feature.groupBy(*cell).agg(F.sqrt(F.avg(metric)).alias("feature_rmse"))
    return a.join(b, cell).withColumn(
        "improvement_percent", improvement_percent(F.col("feature_rmse"), F.col("coordinate_rmse"))
    ).join(_interval(draws, cell, "_gain", confidence), cell).drop("_all")
