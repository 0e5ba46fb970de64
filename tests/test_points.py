import math
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cumulo.functions import lattice as lt
from cumulo.functions.formulas import radical_inverse, square_grid
from cumulo.functions.hashing import hash_rank, role_seed
from cumulo.operators import anchors as an
from cumulo.operators import folds as fo
from cumulo.operators.distortion import geometry_metrics, sliced_wasserstein
from cumulo.operators.farthest import farthest_points, merge_path, normal_aware_points
from cumulo.operators.neighbors import nearest, nearest_vectors
from cumulo.operators.normalize import box_center_unit_radius, pick_role
from cumulo.operators.ranking import fold_before, hash_order, quantiles, rank_in_group, top_per_key
from cumulo.operators.validate import check_points
from tests.helpers import AXES, anchors, clouds, pairwise, table

RNG = np.random.default_rng(5)


def random_clouds(sizes):
    made = {}
    for name, size in sizes.items():
        points = RNG.normal(size=(size, 3))
        points[: size // 5] = points[0]
        made[name] = points
    return made


@pytest.mark.parametrize("options", [{}, {"k": 3}, {"k": 2, "exclude_self": True}])
def test_nearest_large_path_equals_in_task_path(spark, options):
    a, b = clouds(spark, random_clouds({"p": 150, "q": 40})), clouds(spark, random_clouds({"p": 210, "q": 60}))
    small = table(nearest(a, b, **options), "cloud_id", "point_id", "rank")
    large = table(nearest(a, b, bound=1, **options), "cloud_id", "point_id", "rank")
    pd.testing.assert_frame_equal(small, large, check_dtype=False)


def test_nearest_matches_brute_force_with_deep_tree(spark, monkeypatch):
    import cumulo.operators.neighbors as module
    monkeypatch.setattr(module, "LEAF_LIMIT", 4)
    a, b = RNG.normal(size=(60, 3)), np.concatenate([RNG.normal(size=(80, 3)), 1e-4 * RNG.normal(size=(40, 3))])
    got = table(nearest(clouds(spark, {"c": a}), clouds(spark, {"c": b}), bound=1), "point_id")
    d = pairwise(a, b)
    assert got["target_id"].tolist() == d.argmin(axis=1).tolist()
    np.testing.assert_allclose(got["d2"], d.min(axis=1), rtol=0, atol=1e-12)


def test_sources_meet_their_own_leaf_and_few_others(spark, monkeypatch):
    import cumulo.operators.neighbors as module
    monkeypatch.setattr(module, "LEAF_LIMIT", 32)
    draw, met, meet = np.random.default_rng(11), [], module._meet_leaves
    monkeypatch.setattr(module, "_meet_leaves", lambda sources, *rest: met.append(sources.count()) or meet(sources, *rest))
    a, b = draw.random((500, 3)), np.concatenate([draw.random((1500, 3)), [[1e6, 1e6, 1e6]]])
    got = table(nearest(clouds(spark, {"c": a}), clouds(spark, {"c": b}), k=3, bound=1), "point_id", "rank")
    d = pairwise(a, b)
    assert got["target_id"].tolist() == np.argsort(d, axis=1, kind="stable")[:, :3].ravel().tolist()
    assert len(met) == 2 and met[0] == 500 and met[1] < 500 * 8  # of 47 leaves at least


def test_descent_by_arrays_finds_the_closest_leaf_and_all_others():
    import cumulo.operators.neighbors as module
    draw = np.random.default_rng(17)
    leaves = []
    for cloud, paths in (("a", ["1", "22", "241", "243", "3"]), ("b", [""])):
        for path in paths:
            low = draw.random(3) * 10
            leaves.append((cloud, path, int(draw.integers(1, 9)), *low, *(low + draw.random(3) * 3)))
    tree = module.LeafTree(leaves)
    xyz = draw.random((3, 200)) * 14 - 2
    ends = {(cloud, path): (n, np.array(ends).reshape(2, 3)) for cloud, path, n, *ends in leaves}
    for cloud in "ab":
        node, limit = tree.closest(xyz, np.full(200, tree.root[cloud]), 4)
        own = {path: (np.maximum(np.maximum(box[0][:, None] - xyz, xyz - box[1][:, None]), 0) ** 2).sum(axis=0) for (c, path), (_, box) in ends.items() if c == cloud}
        assert {tree.paths[n] for n in node} <= set(own)
        assert (limit < np.inf).all() == (sum(n for (c, _), (n, _) in ends.items() if c == cloud) >= 4)
        bound = draw.random(200) * 40
        place, leaf = tree.within(xyz, np.full(200, tree.root[cloud]), bound)
        assert sorted(zip(place.tolist(), [tree.paths[n] for n in leaf])) == sorted((i, path) for path, low in own.items() for i in np.flatnonzero(low <= bound).tolist())


@pytest.mark.parametrize("options", [{}, {"k": 3}, {"k": 2, "exclude_self": True}])
def test_sent_and_joined_boxes_give_the_same_rows(spark, monkeypatch, options):
    """Repeated sources, ids that stand for several places, and clouds without targets or sources."""
    import cumulo.operators.neighbors as module
    monkeypatch.setattr(module, "LEAF_LIMIT", 8)
    targets = random_clouds({"p": 90, "q": 30, "none": 5})
    a = clouds(spark, random_clouds({"p": 70, "q": 20, "alone": 4}))
    a = a.unionByName(a.filter("point_id < 9")).unionByName(a.filter("point_id = 3").withColumn("x", F.col("x") + 1.5))
    b = clouds(spark, targets)
    sent = table(nearest(a, b, bound=1, **options), "cloud_id", "point_id", "rank")
    monkeypatch.setattr(module, "SENT_LEAVES", 0)
    joined = table(nearest(a, b, bound=1, **options), "cloud_id", "point_id", "rank")
    pd.testing.assert_frame_equal(sent, joined)
    assert set(sent["cloud_id"]) == {"p", "q"} and len(sent) == 90 * options.get("k", 1)


def test_cells_of_uneven_clouds_are_bounded(spark, monkeypatch):
    import cumulo.operators.neighbors as module
    draw = np.random.default_rng(7)
    even = draw.normal(size=(3000, 3))
    far = np.concatenate([1e-6 * draw.normal(size=(2500, 3)), [[1e6, 1e6, 1e6]]])  # one far outlier
    tied = np.concatenate([np.stack([np.ones(2000), np.ones(2000), draw.random(2000)], axis=1), draw.random((300, 3))])
    top = np.concatenate([np.stack([np.ones(2000), draw.random(2000), np.zeros(2000)], axis=1), -draw.random((50, 3))])
    same = np.zeros((700, 3))
    points = clouds(spark, {"even": even, "far": far, "tied": tied, "top": top, "same": same, "one": same[:1]})
    placed = module.kd_cells(points, 100).toPandas()
    assert len(placed) == 3000 + 2501 + 2300 + 2050 + 701
    leaves = placed.groupby(["cloud_id", "_leaf"]).agg(n=("x", "size"), copies=("x", "nunique"), y=("y", "nunique"), z=("z", "nunique"))
    assert ((leaves["n"] <= 100) | ((leaves["copies"] == 1) & (leaves["y"] == 1) & (leaves["z"] == 1))).all()
    assert leaves.groupby("cloud_id").size().max() <= 400
    # Sources in slices, and all of a leaf's neighbours.
    monkeypatch.setattr(module, "MEETING", 64)
    source = np.concatenate([1e-6 * draw.normal(size=(300, 3)), draw.normal(size=(20, 3)) * 1e6])
    got = table(nearest(clouds(spark, {"far": source}), points.filter("cloud_id = 'far'"), k=2, bound=1), "point_id", "rank")
    d = pairwise(source, far)
    assert got[got["rank"] == 1]["target_id"].tolist() == d.argmin(axis=1).tolist()
    assert got[got["rank"] == 2]["target_id"].tolist() == np.argsort(d, axis=1, kind="stable")[:, 1].tolist()


def test_nearest_vectors_any_dimension(spark):
    a, b = RNG.normal(size=(30, 7)), RNG.normal(size=(50, 7))
    def frame(v):
        return spark.createDataFrame([("c", i, [float(x) for x in row]) for i, row in enumerate(v)], "cloud_id string, point_id long, vector array<double>")
    got = table(nearest_vectors(frame(a), frame(b)), "point_id")
    assert got["target_id"].tolist() == pairwise(a, b).argmin(axis=1).tolist()


def test_farthest_points_both_paths_and_brute_force(spark):
    data = random_clouds({"p": 90, "q": 30})
    frame = clouds(spark, data)
    small = table(farthest_points(frame, 20), "cloud_id", "slot")
    large = table(farthest_points(frame, 20, bound=1), "cloud_id", "slot")
    pd.testing.assert_frame_equal(small, large, check_dtype=False)
    points = data["p"]
    current, near, picks = ((points - points.mean(axis=0)) ** 2).sum(axis=1).argmax(), np.full(len(points), np.inf), []
    for _ in range(20):
        picks.append(current)
        near = np.minimum(near, ((points - points[current]) ** 2).sum(axis=1))
        current = near.argmax()
    assert small[small.cloud_id == "p"]["point_id"].tolist() == picks


def test_farthest_points_do_not_depend_on_row_order(spark):
    frame = clouds(spark, random_clouds({"p": 50}))
    a = table(farthest_points(frame, 6), "slot")
    b = table(farthest_points(frame.orderBy(F.desc("x")).repartition(3), 6), "slot")
    pd.testing.assert_frame_equal(a, b)


def test_normal_aware_both_paths(spark):
    frame = clouds(spark, random_clouds({"p": 60})).withColumn("variation", F.abs(F.sin("x")))
    pd.testing.assert_frame_equal(
        table(normal_aware_points(frame, 5), "slot"), table(normal_aware_points(frame, 5, bound=1), "slot"), check_dtype=False
    )


def test_merge_path_sizes(spark):
    path = merge_path(clouds(spark, {"p": RNG.uniform(-1, 1, size=(40, 3))}), (8, 4), 12).toPandas()
    assert path.groupby("k").size().to_dict() == {8: 8, 4: 4}


def test_shifted_square_metrics(spark):
    square = np.array([[0.5, 0.5, 0], [0.5, -0.5, 0], [-0.5, 0.5, 0], [-0.5, -0.5, 0]])
    up = {"c": np.tile([0, 0, 1.0], (4, 1))}
    report = geometry_metrics(clouds(spark, {"c": square + [0, 0, 0.1]}), clouds(spark, {"c": square}, up)).first()
    assert report.chamfer_rmse == pytest.approx(0.1)
    assert report.d2_mse == pytest.approx(0.01)
    assert report.hausdorff == pytest.approx(0.1)
    assert report.p99 == pytest.approx(0.1)


def test_identical_clouds_have_infinite_psnr(spark):
    points = RNG.normal(size=(20, 3))
    same = clouds(spark, {"c": points}, {"c": np.tile([0, 0, 1.0], (20, 1))})
    report = geometry_metrics(same, same).first()
    assert report.chamfer_rmse == 0 and report.hausdorff == 0 and math.isinf(report.d1_psnr_db)


@pytest.mark.parametrize("size", [3, 40])
def test_set_quality_unrolled_and_array_forms(spark, size):
    points, chosen = RNG.normal(size=(70, 3)), RNG.normal(size=(size, 3))
    frame, sets = clouds(spark, {"c": points}), anchors(spark, {"c": chosen})
    d = pairwise(chosen, points)
    for hint in (size, None):
        row = an.set_quality(frame, sets, hint).first()
        assert row.surface == pytest.approx(d.min(axis=1).mean())
        assert row.coverage == pytest.approx(d.min(axis=0).mean())
        own = pairwise(chosen, chosen)
        np.fill_diagonal(own, np.inf)
        assert row.separation == pytest.approx(np.sqrt(own.min(axis=1)).mean())


def test_density_aware_punishes_duplicates(spark):
    line = np.array([[-0.75, 0, 0], [-0.25, 0, 0], [0.25, 0, 0], [0.75, 0, 0]])
    packed = line.copy()
    packed[1:] = line[0]
    frame = clouds(spark, {"a": line, "b": line})
    rows = {r.cloud_id: r.density_aware_chamfer for r in fo.density_aware_chamfer(frame, anchors(spark, {"a": line, "b": packed})).collect()}
    assert rows["b"] > rows["a"] + 0.05
    tau, d = 0.05, pairwise(packed, line)
    aff, first = np.exp(-d / tau), np.exp(-d / tau) / np.exp(-d / tau).sum(axis=1, keepdims=True)
    back = np.exp(-d / tau) / np.exp(-d / tau).sum(axis=0, keepdims=True)
    m1 = (first * aff / (1 + (first.sum(axis=0, keepdims=True) - 1) ** 2)).sum(axis=1)
    m2 = (back * aff / (1 + (back.sum(axis=1, keepdims=True) - 1) ** 2)).sum(axis=0)
    assert rows["b"] == pytest.approx(0.5 * ((1 - m1).mean() + (1 - m2).mean()))


def test_repulsion_counts_close_pairs(spark):
    sets = anchors(spark, {"c": [[0, 0, 0], [0.05, 0, 0], [1, 0, 0]]})
    assert an.repulsion(sets, 0.1).first().repulsion == pytest.approx(2 * (0.01 - 0.0025) / 9)


def test_quantiles_both_paths(spark):
    frame = spark.createDataFrame([(k, float(v), i) for k in "ab" for i, v in enumerate(RNG.normal(size=101).round(1))], "k string, v double, i long")
    for bound in (1000, 1):
        rows = quantiles(frame, ["k"], "v", "i", (0.5, 0.95), ("m", "p"), bound=bound).toPandas().set_index("k")
        for key, group in frame.toPandas().groupby("k"):
            assert rows.loc[key, "m"] == pytest.approx(np.quantile(group.v, 0.5))
            assert rows.loc[key, "p"] == pytest.approx(np.quantile(group.v, 0.95))


def test_ranks_on_both_paths_and_by_hash(spark):
    frame = spark.range(500).withColumn("k", F.col("id") % 2).withColumn("v", F.hash("id"))
    small = table(rank_in_group(frame, ["k"], ["v", "id"]), "id")
    pd.testing.assert_frame_equal(small, table(rank_in_group(frame, ["k"], ["v", "id"], bound=1), "id"), check_like=True)
    hashed = table(hash_order(frame.withColumn("h", hash_rank("s", F.col("id"))), ["k"], "h", ["id"]), "id")
    want = hashed.sort_values(["k", "h"]).groupby("k").cumcount() + 1
    assert (hashed["rank"] == want.sort_index()).all()


def test_top_per_key_beyond_the_trimming_limit(spark):
    frame = spark.range(5000).withColumn("k", F.lit(1)).withColumn("v", F.hash("id"))
    got = table(top_per_key(frame, ["k"], [F.col("v"), F.col("id")], 1500), "rank")
    want = frame.toPandas().sort_values(["v", "id"])["id"].head(1500).tolist()
    assert got["id"].tolist() == want


def test_fold_before_spans_levels(spark, monkeypatch):
    import cumulo.operators.ranking as module
    monkeypatch.setattr(module, "LEVEL", 4)
    frame = spark.range(70).select(F.lit("k").alias("k"), "id", ((F.col("id") * 37) % 11).alias("v"))
    got = table(fold_before(frame, ["k"], "id", "v", "s", F.sum), "id")
    assert got["s"].fillna(0).astype(int).tolist() == (got["v"].cumsum() - got["v"]).tolist()
    low = table(fold_before(frame, ["k"], "id", "v", "m", F.min), "id")
    assert low["m"].tolist()[1:] == low["v"].cummin().tolist()[:-1]


def test_sliced_wasserstein_both_sizes(spark, monkeypatch):
    a, b = RNG.normal(size=(9, 3)), RNG.normal(size=(14, 3))
    got = sliced_wasserstein(clouds(spark, {"c": a}), clouds(spark, {"c": b}), 6).first().sliced_wasserstein
    i = np.arange(6)
    z = 1 - 2 * (i + 0.5) / 6
    r = np.sqrt(1 - z * z)
    t = i * math.pi * (3 - math.sqrt(5))
    v = np.stack([r * np.cos(t), r * np.sin(t), z], axis=1)
    p, q = np.sort(a @ v.T, axis=0), np.sort(b @ v.T, axis=0)
    at = np.linspace(0, 13, 9)
    lo, hi, w = np.floor(at).astype(int), np.ceil(at).astype(int), (at - np.floor(at))[:, None]
    assert got == pytest.approx(math.sqrt(((p - (q[lo] * (1 - w) + q[hi] * w)) ** 2).mean()))


def test_sliced_wasserstein_never_broadcasts_projected_rows(spark):
    """Both forms agree on odd rows; none collects rows per point and direction, which the planner takes for small."""
    import cumulo.operators.distortion as module
    draw = np.random.default_rng(5)
    rows = [("c", k, *map(float, draw.normal(size=3)), k % 3 == 0) for k in range(40)]
    rows += [rows[3], rows[5], ("c", 41, None, 1.0, 1.0, False), ("c", 42, 0.5, None, 1.0, True), ("one", 1, 1.0, 2.0, 3.0, True), ("one", 2, 1.0, 2.0, 5.0, False),
             ("alone", 3, 1.0, 1.0, 1.0, True), (None, 4, 1.0, 1.0, 1.0, True), (None, 5, 1.0, 1.0, 1.0, False)]
    tagged = spark.createDataFrame(rows, "cloud_id string, point_id long, x double, y double, z double, first boolean")
    small = sliced_wasserstein(tagged.filter("first").drop("first"), tagged.filter("NOT first").drop("first"), 6)
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Broadcast" not in plan
    spread = module._spread_gap(tagged.filter("cloud_id IS NOT NULL"), 6)
    joins = re.findall("SortMergeJoin|BroadcastHashJoin", spread._jdf.queryExecution().executedPlan().toString())
    assert joins[:2] == ["SortMergeJoin"] * 2  # the outer two, which carry the projected rows
    one, two = ({r.cloud_id: r.sliced_wasserstein for r in d.collect()} for d in (small, spread))
    assert set(one) == set(two) == {"c", "one"}
    assert all(one[c] == pytest.approx(two[c]) for c in one)


def test_lattice_halves_go_to_even_and_rates(spark):
    row = spark.range(1).select(
        lt.snap(F.lit(0.5), 2, 0.0, 3.0).alias("a"), lt.snap(F.lit(2.5), 2, 0.0, 3.0).alias("b"), lt.snap(F.lit(7.0), 12).alias("c"),
        *[lt.stream_bytes(F.lit(k), 12).alias(f"k{k}") for k in (4, 8, 16, 32, 64, 128)], lt.feature_stream_bytes(F.lit(9), 7).alias("f"),
    ).first()
    assert (row.a, row.b, row.c) == (0.0, 2.0, 1.0)
    assert [row[f"k{k}"] for k in (4, 8, 16, 32, 64, 128)] == [32, 50, 86, 158, 302, 590]
    assert row.f == 12 + 8
    with pytest.raises(ValueError):
        lt.lattice_step(25)


def test_labels_and_seeds_match_python(spark):
    import hashlib
    values = [0.05, 1e-05, 0.1, 100.0, -2.5, 123456789.0, 0.0]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r.s for r in frame.select(lt.float_slug(F.col("v")).alias("s")).collect()]
    assert got == [format(v, ".6g").replace(".", "p").replace("-", "m") for v in values]
    seed = spark.range(1).select(role_seed(7, "train", "m1", "source").alias("s")).first().s
    assert int(seed) == int.from_bytes(hashlib.sha256(b"7:train:m1:source").digest()[:8], "big")


def test_fixed_sequences(spark):
    frame = spark.range(1, 9).select(radical_inverse(F.col("id"), 2).alias("a"), radical_inverse(F.col("id"), 3).alias("b")).collect()
    assert [r.a for r in frame] == pytest.approx([0.5, 0.25, 0.75, 0.125, 0.625, 0.375, 0.875, 0.0625])
    assert [r.b for r in frame][:4] == pytest.approx([1 / 3, 2 / 3, 1 / 9, 4 / 9])
    grid = spark.range(1).select(square_grid(5).alias("g")).first().g
    assert [(p.u, p.v) for p in grid] == [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 0)]


def test_bad_points_are_quarantined(spark):
    frame = clouds(spark, {"nan": [[0, 0, 0], [float("nan"), 0, 0]], "far": [[0, 0, 2.0]], "few": [[0, 0, 0]], "ok": [[0, 0, 0], [1, 1, 1]]})
    good, bad = check_points(frame, minimum=2)
    assert [r.cloud_id for r in good.collect()] == ["ok", "ok"]
    reasons = {(r.cloud_id, r.reason) for r in bad.collect()}
    assert ("nan", "coordinate is not finite") in reasons and ("nan", "cloud has an invalid coordinate") in reasons
    assert ("far", "coordinate outside the domain") in reasons and ("few", "cloud has too few points") in reasons


def test_box_normalize_reports_flat_meshes(spark):
    frame = clouds(spark, {"a": [[0, 0, 0], [2, 0, 0], [0, 4, 0]], "b": [[1, 1, 1], [1, 1, 1]]}).withColumnRenamed("cloud_id", "mesh_id")
    good, flat = box_center_unit_radius(frame)
    assert good.select(F.max(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2)).alias("r")).first().r == pytest.approx(1.0)
    assert [r.mesh_id for r in flat.collect()] == ["b"]


def test_roles(spark):
    frame = spark.createDataFrame([("c", "source", 1), ("c", "target", 2)], "cloud_id string, role string, v int")
    assert {(r.role, r.v) for r in pick_role(frame, "source").collect()} == {("source", 1), ("target", 1), ("fresh", 2)}
    assert {(r.role, r.v) for r in pick_role(frame, "independent").collect()} == {("source", 1), ("target", 2), ("fresh", 2)}


def test_hot_keys_are_sliced_and_nothing_is_lost(spark):
    import cumulo.operators.grouping as grouping
    frame = clouds(spark, random_clouds({"hot": 300, "cold": 20}))
    rows = frame.groupBy("cloud_id").agg(F.avg("x").alias("m"))
    plain = table(grouping.attach(frame, rows), "cloud_id", "point_id")
    sliced = table(grouping.attach(frame, rows, hot_rows=50), "cloud_id", "point_id")
    pd.testing.assert_frame_equal(plain, sliced[plain.columns])
    slices = grouping.attach(frame, rows, hot_rows=50)._jdf.queryExecution().optimizedPlan().toString()
    assert "_slice" in slices


def test_bad_points_take_no_part_and_lose_no_others(spark):
    from cumulo.operators.neighbors import nearest, unusable_points
    rows = [("c", k, float(k), 0.0, 0.0) for k in range(6)]
    bad = [("c", 50, float("nan"), 0.0, 0.0), ("c", 51, None, 0.0, 0.0), ("c", 52, float("inf"), 0.0, 0.0), (None, 53, 0.0, 0.0, 0.0)]
    far = [("far", 1, 0.0, 0.0, 0.0), ("far", 2, 1e200, 0.0, 0.0)]
    kind = "cloud_id string, point_id long, x double, y double, z double"
    frame = spark.createDataFrame(rows + bad + far, kind)
    for self_too in (False, True):
        small = table(nearest(frame, frame, k=2, exclude_self=self_too), "cloud_id", "point_id", "rank")
        large = table(nearest(frame, frame, k=2, exclude_self=self_too, bound=1), "cloud_id", "point_id", "rank")
        pd.testing.assert_frame_equal(small, large[small.columns])
        assert len(small) == (14 if self_too else 16)
    assert sorted(r["point_id"] for r in unusable_points(frame).collect()) == [50, 51, 52, 53]


def test_clouds_are_dealt_by_their_counted_rows(spark, monkeypatch):
    import cumulo.operators.grouping as module
    monkeypatch.setattr(module, "TASK_ROWS", 50)
    points = clouds(spark, random_clouds({f"c{i}": 30 for i in range(20)}))
    assert module.by_cloud(points).rdd.getNumPartitions() == 12  # 600 rows, 4 shuffle partitions
    assert module.by_cloud(points.filter("cloud_id = 'c1'")).count() == 30
    good, _ = check_points(points, lower=None, upper=None)
    assert good.rdd.getNumPartitions() == 12 and good.count() == 600
    hot = clouds(spark, random_clouds({"hot": 200, "cold": 10}))
    assert module.by_cloud(hot).rdd.getNumPartitions() == hot.rdd.getNumPartitions()


def test_event_clouds_are_made_once(spark, tmp_path):
    from datetime import datetime, timedelta

    from cumulo.catalog.views import event_clouds
    rows = [(i, datetime(2024, 1, 1) + timedelta(seconds=37 * i), i % 3, float(i * i % 17), '{"k": %d}' % (i % 5)) for i in range(60)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    made = event_clouds(spark, str(tmp_path))
    assert made.count() == 60
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
