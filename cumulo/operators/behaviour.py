"""How anchor sets respond to noise, resampling, partners and refinement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cumulo.functions.formulas import gap_percent, improvement_percent, square, squared_distance
from cumulo.functions.hashing import hash_index, hash_normal
from cumulo.functions.lattice import index_error, lattice_step, snap

AXES = ("x", "y", "z")


def shift_lattice(sets: DataFrame, bits: int, *, bins: int = 1, seed: object = 0, samples: int = 1,
                  keep_zero: bool = False) -> DataFrame:
    """Move every anchor by whole lattice steps; adds ``sample``.

    Directions depend on (cloud, slot, axis, sample) only, so different methods
    are moved alike. Without ``keep_zero`` each axis moves by -1 or +1 step; with
    it by -1, 0 or +1, except that the very first entry never stays.
    """
    step = lattice_step(bits)
    copies = sets.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))

    def moved(a: str) -> Column:
        key = (seed, F.col("cloud_id"), F.col("slot"), a, F.col("sample"))
        if keep_zero:
            direction = hash_index(3, *key) - F.lit(1)
            if a == "x":
                direction = F.when((F.col("slot") == 0) & (direction == 0), F.lit(1)).otherwise(direction)
        else:
            direction = hash_index(2, *key) * F.lit(2) - F.lit(1)
        return snap(F.col(a) + F.lit(bins * step) * direction, bits)

    return copies.withColumns({a: moved(a) for a in AXES})


def gaussian_noise(sets: DataFrame, scales: Sequence[float], seed: object = 0) -> DataFrame:
    """Clamped copies at each noise scale; scale zero stays as it is."""
    copies = sets.withColumn("scale", F.explode(F.array(*[F.lit(float(s)) for s in scales])))

    def noisy(a: str) -> Column:
        draw = hash_normal(seed, F.col("scale").cast("decimal(12,6)"), F.col("cloud_id"), F.col("slot"), a)
        return F.when(F.col("scale") == 0, F.col(a)).otherwise(
            F.greatest(F.least(F.col(a) + F.col("scale") * draw, F.lit(1.0)), F.lit(-1.0))
        )

    return copies.withColumns({a: noisy(a) for a in AXES})


def noise_schedule(spark, steps: int, first: float, last: float) -> DataFrame:
    """Linear rates with the running product of what they leave: (step, beta, alpha_bar)."""
    if steps < 2 or not 0 < first < last < 1:
        raise ValueError("need at least two steps and 0 < first < last < 1")
    rates = spark.range(steps).select(
        F.col("id").cast("int").alias("step"),
        (F.lit(first) + F.col("id") * F.lit((last - first) / (steps - 1))).alias("beta"),
    )
    # As many rows as steps: one ordered fold.
    kept = F.sum(F.ln(F.lit(1.0) - F.col("beta"))).over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    return rates.withColumn("alpha_bar", F.exp(kept))


def forward_noise(sets: DataFrame, schedule: DataFrame, seed: object = 0) -> DataFrame:
    """Noisy coordinates of every set at its own ``step``."""
    noise = {a: hash_normal(seed, F.col("step"), F.col("cloud_id"), F.col("slot"), a) for a in AXES}
    mixed = {a: F.sqrt("alpha_bar") * F.col(a) + F.sqrt(F.lit(1.0) - F.col("alpha_bar")) * noise[a] for a in AXES}
    return sets.join(schedule, "step").withColumns(mixed)


def packed_sets(sets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per set with ``anchors``: an array of coordinate structs."""
    return sets.groupBy(*keys).agg(F.collect_list(F.struct(*AXES)).alias("anchors"))


def set_gap(first: Column, second: Column) -> Column:
    """Chamfer mean squared error between two bounded anchor arrays."""

    def directed(a: Column, b: Column) -> Column:
        lows = F.transform(a, lambda p: F.array_min(F.transform(b, lambda q: squared_distance(
            p["x"], p["y"], p["z"], q["x"], q["y"], q["z"]
        ))))
        return F.aggregate(lows, F.lit(0.0), lambda s, v: s + v) / F.size(a)

    return F.lit(0.5) * (directed(first, second) + directed(second, first))


def partner_losses(messages: DataFrame, partners: DataFrame) -> DataFrame:
    """Loss of every message against every stored partner set of the same cloud.

    Both sides are few sets of fixed size per cloud: (cloud_id, message) and
    (cloud_id, partner). The matrix stays long.
    """
    left = packed_sets(messages, ("cloud_id", "message")).withColumnRenamed("anchors", "_a")
    right = packed_sets(partners, ("cloud_id", "partner")).withColumnRenamed("anchors", "_b")
    return left.join(right, "cloud_id").select("cloud_id", "message", "partner", set_gap(F.col("_a"), F.col("_b")).alias("loss"))


def partner_matrix(losses: DataFrame) -> DataFrame:
    """RMSE per (message, partner) over clouds."""
    return losses.groupBy("message", "partner").agg(F.sqrt(F.avg("loss")).alias("rmse"), F.avg("loss").alias("mse"))


def partner_report(matrix: DataFrame, worst_weight: float = 0.0) -> DataFrame:
    """Mean plus weighted worst loss, and the worst partner, per message."""
    return matrix.groupBy("message").agg(
        (F.avg("mse") + F.lit(worst_weight) * F.max("mse")).alias("score"),
        F.sqrt(F.avg("mse")).alias("mean_rmse"),
        F.max_by("partner", F.struct(F.col("rmse"), -F.col("partner"))).alias("worst_partner"), F.max("rmse").alias("worst_rmse"),
    )


def partner_delta(matrix: DataFrame, candidate, baseline) -> DataFrame:
    """Change of one message against another per partner, and its mean."""
    mine = matrix.filter(F.col("message") == F.lit(candidate)).select("partner", F.col("rmse").alias("_c"))
    base = matrix.filter(F.col("message") == F.lit(baseline)).select("partner", F.col("rmse").alias("_b"))
    return mine.join(base, "partner").select("partner", (-improvement_percent(F.col("_b"), F.col("_c"))).alias("delta_percent"))


def matrix_table(matrix: DataFrame, partners: Sequence) -> DataFrame:
    """Presentation form: one row per message, one column per partner."""
    return matrix.groupBy("message").pivot("partner", list(partners)).agg(F.first("rmse"))


def sensitivity(base: DataFrame, moved: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean and RMS change of loss under small moves.

    ``base`` has ``loss`` per (cloud, keys); ``moved`` has it per sample as well.
    """
    change = F.col("moved_loss") - F.col("loss")
    joined = moved.withColumnRenamed("loss", "moved_loss").join(base, ["cloud_id", *keys])
    return joined.groupBy(*keys).agg(F.avg(change).alias("mean_change"), F.sqrt(F.avg(square(change))).alias("rms_change"))


def resampling_stability(first: DataFrame, second: DataFrame) -> DataFrame:
    """RMS set distance over clouds between sets made from two resamples."""
    a = packed_sets(first, ("cloud_id",)).withColumnRenamed("anchors", "_a")
    b = packed_sets(second, ("cloud_id",)).withColumnRenamed("anchors", "_b")
    return a.join(b, "cloud_id").agg(
        F.sqrt(F.avg(set_gap(F.col("_a"), F.col("_b")))).alias("stability_rmse"), F.count(F.lit(1)).alias("clouds")
    )


def restart_diversity(sets: DataFrame) -> DataFrame:
    """RMS Chamfer over unordered pairs of restarts; zero for a single restart.

    Restarts are a fixed handful per cloud.
    """
    packed = packed_sets(sets, ("cloud_id", "candidate_id"))
    gathered = packed.groupBy("cloud_id").agg(F.array_sort(F.collect_list(F.struct("candidate_id", "anchors"))).alias("_s"))
    gaps = F.flatten(F.transform("_s", lambda a: F.transform(
        F.filter("_s", lambda b: b["candidate_id"] > a["candidate_id"]), lambda b: set_gap(a["anchors"], b["anchors"])
    )))
    return gathered.select(F.explode_outer(gaps).alias("_g")).agg(F.coalesce(F.sqrt(F.avg("_g")), F.lit(0.0)).alias("diversity_rmse"))


def step_curves(quality: DataFrame, anchors: DataFrame, bits: int, keys: Sequence[str] = ("step", "mode")) -> DataFrame:
    """Mean metrics and lattice error of stored sets per refinement step and mode.

    ``quality`` has chamfer_mse, surface and coverage per (cloud, keys).
    """
    error = anchors.groupBy(*keys).agg(F.max(F.greatest(*[index_error(F.col(a), bits) for a in AXES])).alias("lattice_error"))
    means = quality.groupBy(*keys).agg(
        F.avg("chamfer_mse").alias("chamfer"), F.avg("surface").alias("surface"), F.avg("coverage").alias("coverage"),
        F.count(F.lit(1)).alias("clouds"),
    )
    return means.join(error, list(keys)).withColumns({
        f"{m}_rmse": F.sqrt(m) for m in ("chamfer", "surface", "coverage")
    })


def scale_response(losses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chamfer by noise scale, and the RMSE over the non-zero scales."""
    by_scale = losses.groupBy("scale").agg(F.avg("loss").alias("chamfer")).withColumn("chamfer_rmse", F.sqrt("chamfer"))
    overall = by_scale.agg(
        F.coalesce(F.sqrt(F.avg(F.when(F.col("scale") != 0, F.col("chamfer")))), F.sqrt(F.avg("chamfer"))).alias("mean_nonzero_rmse")
    )
    return by_scale, overall


def candidate_gap(best: DataFrame, reference: DataFrame) -> DataFrame:
    """RMSE of best-of-candidates against a reference set, with the mean chosen index.

    ``best``: (cloud_id, candidate_id, loss); ``reference``: (cloud_id, loss).
    """
    joined = best.join(reference.withColumnRenamed("loss", "_ref"), "cloud_id")
    report = joined.agg(
        F.sqrt(F.avg("loss")).alias("best_rmse"), F.sqrt(F.avg("_ref")).alias("reference_rmse"),
        F.avg(F.col("candidate_id").cast("double")).alias("mean_candidate"), F.count(F.lit(1)).alias("clouds"),
    )
    return report.withColumn("gap_percent", gap_percent(F.col("best_rmse"), F.col("reference_rmse")))


def final_size_gap(summary: DataFrame, methods: tuple[str, str, str], size: int) -> DataFrame:
    """Staged against direct and farthest-point sets at the final size."""
    staged, direct, reference = methods
    at = summary.filter(F.col("k") == size)

    def value(method: str) -> Column:
        return F.max(F.when(F.col("method") == method, F.col("chamfer_rmse")))

    row = at.agg(value(staged).alias("staged_rmse"), value(direct).alias("direct_rmse"), value(reference).alias("reference_rmse"))
    floor = F.greatest("reference_rmse", F.lit(1e-12))
    return row.withColumns({
        "k": F.lit(size),
        "staged_improvement_percent": improvement_percent(F.col("direct_rmse"), F.col("staged_rmse")),
        "staged_gap_percent": F.lit(100.0) * (F.col("staged_rmse") - F.col("reference_rmse")) / floor,
        "direct_gap_percent": F.lit(100.0) * (F.col("direct_rmse") - F.col("reference_rmse")) / floor,
    })


def refinement_gain(one_shot: DataFrame, refined: DataFrame) -> DataFrame:
    """Improvement of refined over one-shot sets in aggregate RMSE."""
    joined = one_shot.withColumnRenamed("loss", "_o").join(refined.withColumnRenamed("loss", "_r"), "cloud_id")
    report = joined.agg(F.sqrt(F.avg("_o")).alias("one_shot_rmse"), F.sqrt(F.avg("_r")).alias("refined_rmse"))
    return report.withColumn("improvement_percent", -gap_percent(F.col("refined_rmse"), F.col("one_shot_rmse")))


def selection_entropy(choices: DataFrame, candidates: DataFrame) -> DataFrame:
    """Normalized entropy of selection probabilities, averaged over clouds and turns.

    ``choices``: (cloud_id, turn, p); ``candidates``: (cloud_id, n).
    """
    term = F.when(F.col("p") > 0, -F.col("p") * F.ln("p")).otherwise(F.lit(0.0))
    entropy = choices.groupBy("cloud_id", "turn").agg(F.sum(term).alias("entropy"))
    scale = F.ln(F.greatest(F.col("n") - F.col("turn"), F.lit(2)).cast("double"))
    return entropy.join(candidates, "cloud_id").agg(F.avg(F.col("entropy") / scale).alias("normalized_entropy"))


def selection_turnover(smaller: DataFrame, larger: DataFrame, size: int) -> DataFrame:
    """Mean share of the smaller selection that the larger one no longer holds."""
    kept = smaller.select("cloud_id", "point_id").join(
        larger.select("cloud_id", "point_id", F.lit(1).alias("_kept")), ["cloud_id", "point_id"], "left"
    )
    per_cloud = kept.groupBy("cloud_id").agg((F.lit(1.0) - F.count("_kept") / F.lit(float(size))).alias("turnover"))
    return per_cloud.agg(F.avg("turnover").alias("selection_turnover"), F.count(F.lit(1)).alias("clouds"))
