"""Candidate scoring and population searches over all clouds at once.

A generation is one job. Its state, the current best sets, has a fixed size per
cloud and is checkpointed between generations.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cumulo.functions.hashing import hash_index, hash_normal
from cumulo.functions.lattice import snap
from cumulo.operators.anchors import chamfer
from cumulo.operators.farthest import farthest_points
from cumulo.operators.ranking import fold_before, rank_in_group
from cumulo.operators.sampling import multi_start
from cumulo.session import cut_lineage

AXES = ("x", "y", "z")
SETS = ("cloud_id", "candidate_id")

# Takes candidate sets (cloud_id, candidate_id, slot, x, y, z), returns (cloud_id, candidate_id, loss).
Score = Callable[[DataFrame], DataFrame]


def chamfer_score(points: DataFrame, size: int | None = None) -> Score:
    """Default score: Chamfer error of the candidate set against its cloud."""
    target = points.select("cloud_id", "point_id", *AXES)
    return lambda sets: chamfer(target, sets, size, SETS).withColumnRenamed("chamfer_mse", "loss")


def best_candidates(sets: DataFrame, losses: DataFrame) -> DataFrame:
    """The lowest-loss set of each cloud (first candidate on ties), with its loss."""
    best = losses.groupBy("cloud_id").agg(F.min(F.struct("loss", "candidate_id")).alias("_b"))
    best = best.select("cloud_id", F.col("_b.candidate_id").alias("candidate_id"), F.col("_b.loss").alias("loss"))
    return sets.join(best, list(SETS))


def best_of_subsets(points: DataFrame, size: int, trials: int, bits: int, seed: object = 0) -> DataFrame:
    """Best of the farthest-point subset and ``trials`` random subsets."""
    starts = multi_start(farthest_points(points, size), points, size, trials + 1, seed)
    sets = cut_lineage(starts.withColumns({a: snap(F.col(a), bits) for a in AXES}))
    return best_candidates(sets, chamfer_score(points, size)(sets))


def elite_fit(sets: DataFrame, losses: DataFrame, *, fraction: float, floor: float) -> DataFrame:
    """Mean and floored population deviation of the lowest-loss share of sets."""
    counts = losses.groupBy("cloud_id").agg(F.ceil(F.count(F.lit(1)) * F.lit(fraction)).alias("_elite"))
    ranked = losses.withColumn("_r", F.row_number().over(Window.partitionBy("cloud_id").orderBy("loss", "candidate_id")))
    elites = ranked.join(counts, "cloud_id").filter(F.col("_r") <= F.greatest(F.col("_elite"), F.lit(1))).select(*SETS)
    return sets.join(elites, list(SETS)).groupBy("cloud_id", "slot").agg(
        *[F.avg(a).alias(f"m{a}") for a in AXES],
        *[F.greatest(F.stddev_pop(a), F.lit(floor)).alias(f"s{a}") for a in AXES],
    )


def _history(loss: DataFrame, evaluations: int) -> DataFrame:
    return loss.select("cloud_id", F.lit(evaluations).alias("evaluations"), F.col("loss").alias("best_loss"))


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole


def cross_entropy_search(start: DataFrame, score: Score, *, bits: int, population: int, generations: int,
                         fraction: float = 0.25, initial_std: float = 0.1, floor: float = 0.005,
                         seed: object = 7) -> tuple[DataFrame, DataFrame]:
    """Sample sets around a moving Gaussian, refit it to the elites, keep the best.

    Returns the best sets (with ``loss``) and the best loss per evaluation count.
    """
    model = start.select(
        "cloud_id", "slot", *[F.greatest(F.least(F.col(a), F.lit(1.0)), F.lit(-1.0)).alias(f"m{a}") for a in AXES],
        *[F.lit(initial_std).alias(f"s{a}") for a in AXES],
    )
    first = model.select("cloud_id", F.lit(0).alias("candidate_id"), "slot", *[snap(F.col(f"m{a}"), bits).alias(a) for a in AXES])
    state = cut_lineage(best_candidates(first, score(first)).join(model, ["cloud_id", "slot"]))
    history = [_history(state.filter("slot = 0"), 1)]
    for generation in range(1, generations + 1):
        ids = state.withColumn("candidate_id", F.explode(F.sequence(F.lit(0), F.lit(population - 1))))

        def drawn(a: str) -> Column:
            noise = hash_normal(seed, generation, F.col("cloud_id"), F.col("candidate_id"), F.col("slot"), a)
            moved = snap(F.col(f"m{a}") + F.col(f"s{a}") * noise, bits)
            return F.when(F.col("candidate_id") == 0, F.col(a)).otherwise(moved)

        sets = cut_lineage(ids.select(*SETS, "slot", *[drawn(a).alias(a) for a in AXES]))
        losses = cut_lineage(score(sets))
        chosen = best_candidates(sets, losses).select("cloud_id", "slot", "candidate_id", *AXES, "loss")
        fitted = elite_fit(sets, losses, fraction=fraction, floor=floor)
        state = cut_lineage(chosen.join(fitted, ["cloud_id", "slot"]))
        history.append(_history(state.filter("slot = 0"), 1 + generation * population))
    return state.select("cloud_id", "slot", *AXES, "loss"), _union(history)


def _complement(draw: Column, taken: Column) -> Column:
    """The draw-th position that is not in the sorted array ``taken``."""
    return F.aggregate(taken, draw, lambda at, p: F.when(p <= at, at + F.lit(1)).otherwise(at))


def mutate(parents: DataFrame, *, population: int, swaps: int, seed: object, generation: int) -> DataFrame:
    """Candidate position arrays: the parent at 0, swapped copies after it.

    ``parents`` holds ``positions`` (array of point positions) and ``n``. Each swap
    replaces a uniform slot by a uniform position outside the set.
    """
    ids = parents.withColumn("candidate_id", F.explode(F.sequence(F.lit(0), F.lit(population - 1))))
    size = F.size("positions")
    for swap in range(swaps):
        key = (seed, generation, F.col("cloud_id"), F.col("candidate_id"), swap)
        slot = hash_index(size, *key, "slot").cast("int")
        draw = hash_index(F.greatest(F.col("n") - size, F.lit(1)), *key, "point")
        fresh = _complement(draw, F.array_sort("positions"))
        ids = ids.withColumn("_slot", slot).withColumn("_fresh", fresh).withColumn(
            "positions",
            F.when(
                (F.col("candidate_id") > 0) & (F.col("n") > size) & (F.lit(swap) < size),
                F.transform("positions", lambda p, i: F.when(i == F.col("_slot"), F.col("_fresh")).otherwise(p)),
            ).otherwise(F.col("positions")),
        ).drop("_slot", "_fresh")
    return ids


def subset_mutation_search(points: DataFrame, start: DataFrame, score: Score, *, bits: int, population: int,
                           generations: int, swaps: int = 1, seed: object = 7) -> tuple[DataFrame, DataFrame]:
    """Improve a strict input subset by swaps, accepting strict improvements only.

    ``start`` holds (cloud_id, slot, point_id). Returns the best subsets (with
    ``point_id`` and ``loss``) and the best loss per evaluation count.
    """
    placed = rank_in_group(points.select("cloud_id", "point_id", *AXES), ["cloud_id"], ["point_id"], rank="position")
    placed = cut_lineage(placed.withColumns({a: snap(F.col(a), bits) for a in AXES}))
    counts = placed.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("n"))
    parents = start.select("cloud_id", "slot", "point_id").join(
        placed.select("cloud_id", "point_id", "position"), ["cloud_id", "point_id"]
    ).groupBy("cloud_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("slot", "position"))), lambda s: s["position"]).alias("positions")
    ).join(counts, "cloud_id")

    def located(sets: DataFrame) -> DataFrame:
        flat = sets.select(*SETS, F.posexplode("positions").alias("slot", "position"))
        return flat.join(placed, ["cloud_id", "position"]).select(*SETS, "slot", "point_id", *AXES)

    first = parents.withColumn("candidate_id", F.lit(0))
    state = cut_lineage(first.join(score(located(first)), list(SETS)).select("cloud_id", "positions", "n", "loss"))
    history = [_history(state, 1)]
    for generation in range(1, generations + 1):
        sets = cut_lineage(mutate(
            state.select("cloud_id", "positions", "n"), population=population, swaps=swaps, seed=seed, generation=generation
        ))
        losses = score(located(sets))
        # Candidate 0 is the parent: the smallest (loss, candidate) only changes on strict improvement.
        best = losses.groupBy("cloud_id").agg(F.min(F.struct("loss", "candidate_id")).alias("_b")).select(
            "cloud_id", F.col("_b.candidate_id").alias("candidate_id"), F.col("_b.loss").alias("loss")
        )
        state = cut_lineage(sets.join(best, list(SETS)).select("cloud_id", "positions", "n", "loss"))
        history.append(_history(state, 1 + generation * population))
    final = located(state.withColumn("candidate_id", F.lit(0))).drop("candidate_id")
    return final.join(state.select("cloud_id", "loss"), "cloud_id"), _union(history)


def running_best(losses: DataFrame, keys: Sequence[str], order: str, loss: str = "loss") -> DataFrame:
    """Best loss so far along each stored search history; ``order`` is a whole number."""
    folded = fold_before(losses, keys, order, loss, "_before", F.min)
    return folded.withColumn("best_loss", F.least("_before", loss)).drop("_before")


def search_curve(history: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean best loss over clouds by evaluation budget."""
    return history.groupBy(*keys, "evaluations").agg(F.avg("best_loss").alias("mean_best_chamfer")).withColumn(
        "mean_best_chamfer_rmse", F.sqrt("mean_best_chamfer")
    )


def search_gains(history: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Gain from the first to the last evaluation, per cloud."""
    first = F.min_by("best_loss", "evaluations")
    last = F.max_by("best_loss", "evaluations")
    return history.groupBy("cloud_id", *keys).agg(first.alias("initial"), last.alias("best"), F.max("evaluations").alias("evaluations")).withColumns({
        "gain": F.col("initial") - F.col("best"),
        "relative_gain": (F.col("initial") - F.col("best")) / F.greatest("initial", F.lit(1e-12)),
        "improved": F.col("best") < F.col("initial"),
    })


def search_summary(gains: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return gains.groupBy(*keys).agg(
        F.avg("gain").alias("mean_gain"), F.avg(F.col("improved").cast("double")).alias("improved_fraction"),
        F.avg("best").alias("mean_chamfer"), F.max("evaluations").alias("evaluations"),
    )


def paired_start_report(history: DataFrame, method: str = "method") -> DataFrame:
    """Whether all methods began from the same loss and spent the same budget."""
    begins = history.filter(F.col("evaluations") == 1).groupBy("cloud_id").agg(
        (F.max("best_loss") - F.min("best_loss")).alias("_spread")
    ).agg(F.max("_spread").alias("largest_start_difference"))
    budgets = history.groupBy(method).agg(F.max("evaluations").alias("_e")).agg(F.count_distinct("_e").alias("distinct_budgets"))
    # Two one-row frames: joined on a constant key.
    return begins.withColumn("_one", F.lit(1)).join(budgets.withColumn("_one", F.lit(1)), "_one").drop("_one").withColumn(
        "paired", (F.col("largest_start_difference") <= F.lit(1e-6)) & (F.col("distinct_budgets") == 1)
    )
