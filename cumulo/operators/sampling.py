"""Hash-ranked subsets, splits and weighted draws."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cumulo.functions.hashing import hash_rank, hash_uniform
from cumulo.functions.lattice import snap, to_index
from cumulo.operators.ranking import TRIMMED_LIMIT, hash_order, top_per_key

AXES = ("x", "y", "z")


def quantize_anchors(anchors: DataFrame, bits: int) -> DataFrame:
    """Snap coordinates and add their lattice indices ``ix, iy, iz``."""
    snapped = anchors.withColumns({a: snap(F.col(a), bits) for a in AXES})
    return snapped.withColumns({f"i{a}": to_index(F.col(a), bits) for a in AXES})


def random_subset(points: DataFrame, size: int, seed: object = 0, *salt: object) -> DataFrame:
    """``size`` points per cloud without replacement, by hash priority; adds ``slot``."""
    ranked = points.withColumn("_h", hash_rank(seed, *salt, F.col("cloud_id"), F.col("point_id")))
    chosen = top_per_key(ranked, ["cloud_id"], [F.col("_h"), F.col("point_id")], size, "_rank")
    return chosen.withColumn("slot", F.col("_rank") - F.lit(1)).drop("_h", "_rank")


def two_resamples(points: DataFrame, size: int, seed: object = 0) -> DataFrame:
    """Two independent subsets of every cloud, told apart by ``role``."""
    return random_subset(points, size, seed, "first").withColumn("role", F.lit("first")).unionByName(
        random_subset(points, size, seed, "second").withColumn("role", F.lit("second"))
    )


def candidate_subsets(points: DataFrame, size: int, count: int, seed: object = 0, first_id: int = 0) -> DataFrame:
    """``count`` independent random subsets per cloud, keyed by ``candidate_id``."""
    ids = F.sequence(F.lit(first_id), F.lit(first_id + count - 1))
    copies = points.withColumn("candidate_id", F.explode(ids))
    ranked = copies.withColumn("_h", hash_rank(seed, F.col("candidate_id"), F.col("cloud_id"), F.col("point_id")))
    chosen = top_per_key(ranked, ["cloud_id", "candidate_id"], [F.col("_h"), F.col("point_id")], size, "_rank")
    return chosen.withColumn("slot", F.col("_rank") - F.lit(1)).drop("_h", "_rank")


def multi_start(given: DataFrame, points: DataFrame, size: int, starts: int, seed: object = 0) -> DataFrame:
    """One given set as candidate 0 and ``starts - 1`` random subsets."""
    columns = ["cloud_id", "candidate_id", "slot", "point_id", *AXES]
    base = given.withColumn("candidate_id", F.lit(0)).select(*columns)
    if starts < 2:
        return base
    return base.unionByName(candidate_subsets(points, size, starts - 1, seed, 1).select(*columns))


def top_scores(points: DataFrame, score: Column, size: int) -> DataFrame:
    """Highest-scoring points per cloud; smaller sizes are prefixes of larger ones."""
    scored = points.withColumn("score", score)
    chosen = top_per_key(scored, ["cloud_id"], [F.col("score").desc(), F.col("point_id")], size, "_rank")
    return chosen.withColumn("slot", F.col("_rank") - F.lit(1)).drop("_rank")


def gumbel_score(score: Column, *key: object) -> Column:
    """Score perturbed so that a top-k is a weighted draw without replacement."""
    u = F.greatest(F.lit(1e-6), F.least(F.lit(1.0 - 1e-6), hash_uniform(*key)))
    return score - F.ln(-F.ln(u))


def _ranked_records(records: DataFrame, keys: Sequence[str], needed: int, seed: object) -> DataFrame:
    """Hash rank of each record within its keys, at least down to rank ``needed``."""
    hashed = records.withColumn("_h", hash_rank(seed, F.col("category"), F.col("model_id")))
    if needed <= TRIMMED_LIMIT:
        ranked = top_per_key(hashed, keys, [F.col("_h"), F.col("model_id")], needed, "_rank")
    else:
        ranked = hash_order(hashed, keys, "_h", ["model_id"], "_rank").filter(F.col("_rank") <= needed)
    return ranked.drop("_h")


def stratified_split(records: DataFrame, heldout: DataFrame, *, train: int, validation: int, ood: int,
                     calibration: int = 0, seed: object = 0, official: bool = False) -> DataFrame:
    """Assign records of each category to splits by hash rank.

    ``heldout`` lists the held-out ``category`` values. With ``official`` the
    stored ``official_split`` is kept: train and calibration come from official
    train rows, validation and OOD from official test rows. Without it, the
    validation rows follow the train rows in the same ranking.
    """
    keys = ["official_split", "category"] if official else ["category"]
    needed = max(train + calibration, validation, ood) if official else max(train + calibration + validation, ood)
    ranked = _ranked_records(records, keys, needed, seed)
    marked = ranked.join(
        heldout.select("category", F.lit(True).alias("_held")).distinct(), "category", "left"
    ).withColumn("_held", F.coalesce("_held", F.lit(False)))
    rank, held = F.col("_rank"), F.col("_held")
    trained = rank <= train
    calibrated = (rank > train) & (rank <= train + calibration)
    if official:
        from_train, from_test = F.col("official_split") == "train", F.col("official_split") == "test"
        split = (
            F.when(~held & from_train & trained, "train")
            .when(~held & from_train & calibrated, "calibration")
            .when(~held & from_test & (rank <= validation), "validation")
            .when(held & from_test & (rank <= ood), "category_ood")
        )
    else:
        split = (
            F.when(~held & trained, "train")
            .when(~held & calibrated, "calibration")
            .when(~held & (rank <= train + calibration + validation), "validation")
            .when(held & (rank <= ood), "category_ood")
        )
    return marked.withColumn("split", split).filter("split IS NOT NULL").drop("_rank", "_held")


def heldout_categories(categories: DataFrame, count: int, seed: object = 0) -> DataFrame:
    """Distinct categories with ``heldout``: the first ``count`` by hash are held out.

    The distinct categories are few; they are ranked together as one list.
    """
    distinct = categories.select("category").distinct().withColumn("_all", F.lit(1)).withColumn(
        "_h", hash_rank(seed, F.col("category"), "heldout_category")
    )
    first = top_per_key(distinct, ["_all"], [F.col("_h"), F.col("category")], count, "_rank").select(
        "category", F.lit(True).alias("heldout")
    )
    return distinct.select("category").join(first, "category", "left").withColumn(
        "heldout", F.coalesce("heldout", F.lit(False))
    )


def carve_split(records: DataFrame, split: str, kept: int, *, carved_name: str = "calibration",
                order: str = "position") -> tuple[DataFrame, DataFrame]:
    """Cut one split into a leading part and a held-out tail by stored position.

    Returns the relabelled records and a one-row report on the exact counts.
    """
    mine = F.col("split") == split
    relabelled = records.withColumn(
        "split", F.when(mine & (F.col(order) >= kept), F.lit(carved_name)).otherwise(F.col("split"))
    )
    report = records.filter(mine).agg(
        F.count(F.lit(1)).alias("available"),
        F.count_if(F.col(order) < kept).alias("kept"),
        F.count_if(F.col(order) >= kept).alias("carved"),
    ).withColumn("exact", F.col("kept") == F.lit(kept))
    return relabelled, report
