import itertools
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cumulo.operators import assignment as asg
from cumulo.operators import behaviour as bh
from cumulo.operators import folds as fo
from cumulo.operators import sampling as sm
from cumulo.operators import search as se
from cumulo.operators import streams as st
from cumulo.operators import transport as tr
from cumulo.operators.plane import decode_corners, fit_planes, plane_corners
from cumulo.operators.registry import OBJECTIVES, SAMPLERS, objective, sample
from tests.helpers import AXES, anchors, clouds, pairwise, table

RNG = np.random.default_rng(11)


def test_sinkhorn_marginals_and_both_paths(spark):
    first, second = RNG.normal(size=(4, 3)) * 0.3, RNG.normal(size=(7, 3)) * 0.3
    points, sets = clouds(spark, {"c": second}), anchors(spark, {"c": first})
    plan = table(tr.transport_plan(points, sets, epsilon=0.2, iterations=100), "slot", "point_id")
    matrix = plan["mass"].to_numpy().reshape(4, 7)
    np.testing.assert_allclose(matrix.sum(axis=1), 1 / 4, atol=1e-6)
    np.testing.assert_allclose(matrix.sum(axis=0), 1 / 7, atol=1e-6)
    small = tr.transport_cost(points, sets, epsilon=0.1, iterations=10).first().transport_cost
    large = tr.transport_cost(points, sets, epsilon=0.1, iterations=10, bound=1).first().transport_cost
    assert small == pytest.approx(large, rel=1e-9)


@pytest.mark.parametrize("size", [40])
def test_folds_over_blocks_against_matrices(spark, monkeypatch, size):
    monkeypatch.setattr(fo, "BLOCK", 16)
    monkeypatch.setattr(fo, "MATRIX", 5 * size)
    draw = np.random.default_rng(size)
    data = {"a": draw.normal(size=(90, 3)), "b": draw.normal(size=(50, 3))}
    chosen = {name: points[:size] + 0.01 for name, points in data.items()}
    points, sets, t = clouds(spark, data), anchors(spark, chosen), 0.3
    mass = {r.cloud_id: r.mass_imbalance for r in fo.mass_imbalance(points, sets, t).collect()}
    means, dense = table(fo.soft_means(points, sets, t), "cloud_id", "slot"), {r.cloud_id: r.density_aware_chamfer for r in fo.density_aware_chamfer(points, sets, t).collect()}
    cost = {r.cloud_id: r.transport_cost for r in tr.transport_cost(points, sets, epsilon=t, iterations=6, bound=0).collect()}
    early = {r.cloud_id: r.transport_cost for r in tr.transport_cost(points, sets, epsilon=t, iterations=40, tolerance=0.02, bound=0).collect()}
    for name in data:
        p, a = data[name], chosen[name]
        d2, n, k = pairwise(p, a), len(p), len(a)
        share, back = np.exp(-d2 / t), np.exp(-d2 / t)
        share, back = share / share.sum(axis=1, keepdims=True), back / back.sum(axis=0)
        assert mass[name] == pytest.approx(np.sqrt(((share.mean(axis=0) * k - 1) ** 2).mean()))
        own = means[means["cloud_id"] == name]
        np.testing.assert_allclose(own[AXES].to_numpy(), (share.T @ p) / share.sum(axis=0)[:, None], atol=1e-9)
        np.testing.assert_allclose(own["mass"].to_numpy(), share.sum(axis=0), atol=1e-9)
        point = 1 / (1 + (back.sum(axis=1) / (k / n) - 1) ** 2)
        anchor = 1 / (1 + (share.sum(axis=0) / (n / k) - 1) ** 2)
        near = np.exp(-d2 / t)
        wanted = 0.5 * ((1 - (back * near * point[:, None]).sum(axis=0)).mean() + 1 - (share * near * anchor).sum() / n)
        assert dense[name] == pytest.approx(wanted)
        u, v = np.zeros(k), np.zeros(n)
        for _ in range(6):
            u = -np.log(k) - np.log(np.exp(-d2 / t + v[:, None]).sum(axis=0))
            v = -np.log(n) - np.log(np.exp(-d2 / t + u).sum(axis=1))
        assert cost[name] == pytest.approx((np.exp(-d2 / t + u + v[:, None]) * d2).sum())
        for _ in range(2000):
            u = -np.log(k) - np.log(np.exp(-d2 / t + v[:, None]).sum(axis=0))
            v = -np.log(n) - np.log(np.exp(-d2 / t + u).sum(axis=1))
        assert early[name] == pytest.approx((np.exp(-d2 / t + u + v[:, None]) * d2).sum(), rel=0.05)


def test_cheapest_matching_equals_permutations(spark):
    for size in (1, 2, 5, 6):
        a, b = RNG.normal(size=(size, 3)), RNG.normal(size=(size, 3))
        got = asg.matched_set_rmse(anchors(spark, {"c": a}), anchors(spark, {"c": b})).first().matched_rmse
        cost = pairwise(a, b)
        best = min(sum(cost[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(size)))
        assert got == pytest.approx(np.sqrt(best / size))


def test_unique_projection_is_one_to_one_and_greedy(spark):
    points, moved = RNG.normal(size=(40, 3)), RNG.normal(size=(6, 3)) * 0.1
    got = table(asg.unique_projection(anchors(spark, {"c": moved}), clouds(spark, {"c": points}), 6), "slot")
    cost, want = pairwise(moved, points), {}
    while len(want) < 6:
        slot, point = np.unravel_index(cost.argmin(), cost.shape)
        want[slot] = point
        cost[slot, :] = np.inf
        cost[:, point] = np.inf
    assert got["point_id"].tolist() == [want[i] for i in range(6)]


def two_restarts(spark, losses):
    sets = [("c", 0, 0, 0.0, 0.0, 0.0), ("c", 0, 1, 0.5, 0.0, 0.0), ("c", 1, 0, 0.0, 0.4, 0.0), ("c", 1, 1, 0.5, 0.4, 0.0)]
    frame = spark.createDataFrame(sets, "cloud_id string, candidate_id int, slot int, x double, y double, z double")
    return frame, spark.createDataFrame([("c", i, v) for i, v in enumerate(losses)], "cloud_id string, candidate_id int, loss double")


@pytest.mark.parametrize("losses, expected", [((0.10, 0.101), True), ((0.10, 0.20), False)])
def test_multimodality(spark, losses, expected):
    report = asg.multimodality(*two_restarts(spark, losses))
    assert report.first().multimodal is expected
    assert asg.multimodality_gate(report).first().passed is expected


@pytest.mark.parametrize("bits", [2, 7, 12, 24])
def test_stream_round_trip(spark, bits):
    sets = sm.quantize_anchors(anchors(spark, {"c": [[-1, 0.3, 1], [0.25, -0.5, 0.1], [0.9, 0.9, -0.9]]}), bits)
    streams, bad = st.encode_sets(sets, bits=bits, mode=F.lit("free"), output_points=F.lit(64))
    decoded, rejected = st.decode_sets(streams)
    assert bad.isEmpty() and rejected.isEmpty()
    assert st.round_trip_report(sets, decoded).first().exact
    assert decoded.first().payload_bits == 9 * bits
    assert streams.first().stream[:4] == bytes([0x50, 0x43, 0x4F, 0x4E])


def test_stream_is_order_free_and_malformed_rows_are_named(spark):
    points = [[-1, 0.3, 1], [0.25, -0.5, 0.1], [0.9, 0.9, -0.9]]
    def stream(rows):
        return st.encode_sets(anchors(spark, {"c": rows}), bits=7, mode=F.lit("fps"), output_points=F.lit(64))[0].first().stream
    good = bytes(stream(points))
    assert good == bytes(stream(points[::-1]))
    flipped = good[:-1] + bytes([good[-1] | 1])
    broken = [("pad", bytearray(flipped)), ("long", bytearray(good + b"\0")), ("short", bytearray(good[:9])), ("magic", bytearray(b"XXXX" + good[4:]))]
    _, bad = st.decode_sets(spark.createDataFrame(broken, "cloud_id string, stream binary"))
    assert {r.cloud_id: r.reason for r in bad.collect()} == {
        "pad": "non-zero padding bits", "long": "stream length differs from header", "short": "truncated header", "magic": "wrong magic",
    }
    _, rejected = st.encode_sets(anchors(spark, {"far": [[2, 0, 0]], "nan": [[float("nan"), 0, 0]]}), bits=7, mode=F.lit("fps"), output_points=F.lit(64))
    assert {r.cloud_id: r.reason for r in rejected.collect()} == {"far": "coordinates outside the domain", "nan": "coordinates are not finite"}


def test_numbers_in_bits():
    draw = np.random.default_rng(4)
    for width in (1, 3, 8, 13, 24):
        values = draw.integers(0, 1 << width, 50)
        body = st.pack_numbers(values, width)
        text = "".join(f"{v:0{width}b}" for v in values)
        assert body == int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8))
        back, clean = st.unpack_numbers(body, width, 50)
        assert back.tolist() == values.tolist() and clean


def test_the_largest_set_round_trips(spark):
    """65,535 anchors at 24 bits, in seconds."""
    points = np.random.default_rng(6).uniform(-1, 1, size=(65_535, 3))
    sets = anchors(spark, {"c": points})
    streams, bad = st.encode_sets(sets, bits=24, mode=F.lit("free"), output_points=F.lit(65_535))
    begun = time.monotonic()
    decoded, rejected = st.decode_sets(se.cut_lineage(streams))
    got = np.sort(decoded.select("ix", "iy", "iz").toPandas().to_numpy(), axis=0)
    assert time.monotonic() - begun < 60 and bad.count() == rejected.count() == 0
    assert (got == np.sort(np.rint((points + 1) * 0.5 * (2 ** 24 - 1)).astype(int), axis=0)).all()


def test_feature_streams(spark):
    frame = spark.createDataFrame([("a", [0.5, -1.0, 1.0]), ("b", [2.0]), ("c", [])], "k string, features array<double>")
    streams, bad = st.encode_features(frame, bits=9, output_points=F.lit(16))
    vectors, rejected = st.decode_features(streams)
    assert rejected.isEmpty() and {r.k for r in bad.collect()} == {"b", "c"}
    np.testing.assert_allclose(vectors.first().features, [0.5, -1, 1], atol=1 / 511)


def brute_mutation_step(positions, n, size, slot, draw):
    left = [p for p in range(n) if p not in positions]
    changed = list(positions)
    changed[slot] = left[draw]
    return changed


def test_mutations_stay_unique_and_pick_from_the_complement(spark):
    parents = spark.createDataFrame([("c", [4, 1, 7], 10), ("d", [0, 1], 2)], "cloud_id string, positions array<bigint>, n bigint")
    rows = se.mutate(parents, population=6, swaps=2, seed=3, generation=1).collect()
    for row in rows:
        assert len(set(row.positions)) == len(row.positions) and max(row.positions) < row.n
    assert [r.positions for r in rows if r.candidate_id == 0] == [[4, 1, 7], [0, 1]]
    assert all(r.positions == [0, 1] for r in rows if r.cloud_id == "d")
    assert len({tuple(r.positions) for r in rows if r.cloud_id == "c"}) > 2


def test_searches_never_get_worse(spark):
    points = clouds(spark, {"p": RNG.uniform(-1, 1, size=(30, 3)), "q": RNG.uniform(-1, 1, size=(25, 3))})
    start = sm.random_subset(points, 4, "s")
    score = se.chamfer_score(points, 4)
    best, swaps = se.subset_mutation_search(points, start, score, bits=8, population=5, generations=2)
    sets, normal = se.cross_entropy_search(start, score, bits=8, population=5, generations=2)
    for history in (swaps, normal):
        for _, rows in table(history, "cloud_id", "evaluations").groupby("cloud_id"):
            assert rows["evaluations"].tolist() == [1, 6, 11]
            assert (rows["best_loss"].diff().dropna() <= 0).all()
    chosen = best.filter("cloud_id = 'p'").toPandas()
    data = points.filter("cloud_id = 'p'").toPandas()
    d = pairwise(chosen[AXES], data[AXES])
    assert chosen["loss"].iloc[0] == pytest.approx(0.5 * (d.min(axis=1).mean() + d.min(axis=0).mean()))
    history = swaps.withColumn("method", F.lit("a")).unionByName(normal.withColumn("method", F.lit("b")))
    assert se.paired_start_report(history).first().paired


def test_subsets_nest_and_noise_is_paired(spark):
    points = clouds(spark, {"p": RNG.uniform(-1, 1, size=(50, 3))})
    four, eight = [set(r.point_id for r in sm.random_subset(points, k, 1).collect()) for k in (4, 8)]
    assert four < eight and len(eight) == 8
    sets = anchors(spark, {"p": RNG.uniform(-0.5, 0.5, size=(3, 3))})
    a = table(bh.shift_lattice(sm.quantize_anchors(sets, 6), 6, keep_zero=True), "slot")
    b = table(bh.shift_lattice(sm.quantize_anchors(sets.withColumn("x", F.col("x") + 0.2), 6), 6, keep_zero=True), "slot")
    base = table(sm.quantize_anchors(sets, 6), "slot")
    np.testing.assert_allclose(a[["y", "z"]], b[["y", "z"]])
    assert (a["x"] - base["x"]).abs().iloc[0] > 1e-6


def test_plane_round_trip_and_rejects(spark):
    u, v = np.meshgrid(np.linspace(-1, 1, 5), np.linspace(-0.5, 0.5, 5))
    turn = np.linalg.qr(RNG.normal(size=(3, 3)))[0]
    flat = np.stack([u.ravel(), v.ravel(), np.zeros(25)], axis=1) @ turn.T + [0.1, 0.2, 0.3]
    line = np.outer(np.linspace(0, 1, 6), [1.0, 2.0, 3.0])
    ball = RNG.normal(size=(50, 3))
    corners, bad = plane_corners(clouds(spark, {"flat": flat, "ball": ball, "line": np.zeros((5, 3)), "few": flat[:3]}), max_rmse=0.05)
    assert {r.cloud_id for r in bad.collect()} == {"ball", "line", "few"}
    got = corners.toPandas()[AXES].to_numpy()
    want = np.array([[1, .5, 0], [1, -.5, 0], [-1, .5, 0], [-1, -.5, 0]]) @ turn.T + [0.1, 0.2, 0.3]
    assert pairwise(got, want).min(axis=1).max() < 1e-12
    decoded = decode_corners(corners, 21).toPandas()
    shuffled = decode_corners(corners.withColumn("corner", (F.col("corner") * 3 + 1) % 4).orderBy(F.rand(1)), 21).toPandas()
    assert len(decoded) == 21 and pairwise(decoded[AXES], shuffled[AXES]).min(axis=1).max() < 1e-12
    planes, _ = fit_planes(clouds(spark, {"flat": flat}))
    assert planes.first().plane_rmse == pytest.approx(0, abs=1e-7)


def test_registries(spark):
    data = RNG.uniform(-1, 1, size=(20, 3))
    normals = data / np.linalg.norm(data, axis=1, keepdims=True)
    points = clouds(spark, {"c": data}, {"c": normals})
    for name in SAMPLERS:
        assert sample(points, 3, name).count() == 3
    chosen = sample(points, 3, "fps")
    for name in OBJECTIVES:
        assert objective(points, chosen, name).first().loss > 0
    with pytest.raises(ValueError):
        sample(points, 3, "unknown")


def test_blocks_are_dealt_by_counted_points(spark):
    points = spark.range(4000).selectExpr("concat('c', id % 2) AS cloud_id", "id AS point_id", "id / 7 AS x", "id % 11 / 3 AS y", "id % 5 / 2 AS z")
    blocks = fo.point_blocks(points, 100)
    held = [len(part) for part in blocks.select("cloud_id").rdd.glom().collect()]
    assert len(held) == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    assert sum(held) == 40 and min(held) >= 5
    assert blocks.selectExpr("sum(size(x))").first()[0] == 4000


def test_transport_by_blocks_keeps_anchors_beyond_all_points(spark, monkeypatch):
    monkeypatch.setattr(fo, "MATRIX", 40)
    points = spark.range(60).selectExpr("'c' AS cloud_id", "id AS point_id", "id % 7 / 10 AS x", "id % 5 / 10 AS y", "id % 3 / 10 AS z")
    anchors = spark.createDataFrame([("c", 0, 0.1, 0.1, 0.1), ("c", 1, 0.5, 0.3, 0.1), ("c", 2, 40.0, 0.0, 0.0)], "cloud_id string, slot int, x double, y double, z double")
    for sweeps in (1, 2, 6):
        whole, blocks = ({r["cloud_id"]: r["potential"] for r in tr.anchor_potentials(points, anchors, epsilon=0.02, iterations=sweeps, **options).collect()}
                         for options in ({}, {"bound": 0}))
        assert np.isfinite(blocks["c"]).all()
        assert np.allclose(whole["c"], blocks["c"], rtol=1e-9, atol=1e-9)
