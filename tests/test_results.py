import hashlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cumulo.functions import draws
from cumulo.operators import resampling as rp
from cumulo.operators import sampling as sm
from cumulo.plans import gates as gt
from cumulo.plans import results as rs
from cumulo.plans import statistics as sx
from tests.helpers import table


def test_measured_points_without_interpolation(spark):
    measured = spark.createDataFrame([("v", "coarse", .2, .3), ("v", "late", .25, .35), ("v", "fine", .3, .1)], "split string, rate_point string, actual_stream_bpp double, chamfer_rmse double")
    frontier = rs.undominated(measured).orderBy("actual_stream_bpp")
    assert [r.rate_point for r in frontier.collect()] == ["coarse", "fine"]
    mine = spark.createDataFrame([("v", "free", .25, .2), ("v", "tiny", .01, .01)], "split string, method string, actual_stream_bpp double, chamfer_rmse double")
    found = {r.method: r for r in rs.at_or_below(mine, measured).collect()}
    assert found["free"].best_point_at_or_below_rate == "coarse" and found["free"].lowest_point_at_or_below_error == "fine"
    assert found["free"].dominated is False
    assert found["tiny"].best_point_at_or_below_rate is None and found["tiny"].lowest_point_at_or_below_error is None


def test_ties_stay_on_the_frontier(spark):
    rows = spark.createDataFrame([("v", "a", .2, .3), ("v", "b", .2, .3), ("v", "c", .3, .3)], "split string, method string, actual_stream_bpp double, chamfer_rmse double")
    assert {r.method for r in rs.undominated(rows).collect()} == {"a", "b"}


def test_running_frontier(spark):
    rows = spark.createDataFrame([("m", 96, .5), ("m", 144, .51), ("m", 192, .4)], "model_kind string, payload_bits int, chamfer_rmse double")
    assert [r.payload_bits for r in rs.running_frontier(rows, ["model_kind"]).orderBy("payload_bits").collect()] == [96, 192]


@pytest.mark.parametrize("middle, passed", [(.49, True), (.51, False)])
def test_rate_curve_gate(spark, middle, passed):
    rows = spark.createDataFrame([("m", 96, .5), ("m", 144, middle), ("m", 192, .48)], "model_kind string, payload_bits int, chamfer_rmse double")
    row = gt.rate_curve_gate(rows, ["model_kind"]).first()
    assert row.passed is passed and row.endpoint_improvement_percent == pytest.approx(4.0)
    single = gt.rate_curve_gate(rows.limit(1), ["model_kind"]).first()
    assert single.passed is False


def test_clamped_and_unclamped_regression(spark):
    rows = spark.createDataFrame([("m", 1, .5), ("m", 2, .4)], "k string, payload_bits int, chamfer_rmse double")
    assert rs.curve_statistics(rows, ["k"], clamp_regression=True).first().max_adjacent_regression_percent == 0
    assert rs.curve_statistics(rows, ["k"]).first().max_adjacent_regression_percent == pytest.approx(-20)


def test_isolation_gate(spark):
    rows = [("fps", .10, .0), ("hard_subset", .104, .0001), ("soft", .09, .09)]
    flat = [(c, s, v, u) for c, v, u in rows for s in ("validation", "parameter_ood")]
    runs = spark.createDataFrame(flat, "condition string, split string, chamfer_rmse double, surface double")
    row = gt.isolation_gate(runs, max_surface=.05, max_gap=5).first()
    assert row.selected == "hard_subset" and row.passed and row.validation_gap_percent == pytest.approx(4)
    none = gt.isolation_gate(runs, max_surface=.001, max_gap=5).first()
    assert none.selected is None and none.passed is False and none.reason


def test_bottleneck_gate(spark):
    values = [("fps", 4, .12), ("fps", 8, .11), ("fps", 16, .10), ("learned", 16, .104), ("best_subset", 16, .10), ("free_coordinates", 16, .08)]
    runs = spark.createDataFrame([(c, 256, k, s, v) for c, k, v in values for s in ("validation", "parameter_ood")], "condition string, input_size int, constellation_size int, split string, chamfer_rmse double")
    options = dict(input_size=256, size=16, min_endpoint=1, max_adjacent=.5, max_gap=5, headroom=5)
    row = gt.bottleneck_gate(runs, unchanged=True, **options).first()
    assert row.passed and row.headroom_detected and row.largest_gap_percent == pytest.approx(4)
    assert gt.bottleneck_gate(runs, unchanged=False, **options).first().passed is False


def seed_matrix(spark, seeds, clouds, base, candidate):
    rows = [(s, f"f{c % 2}", f"m{c}", base, candidate, "v") for s in range(seeds) for c in range(clouds)]
    return spark.createDataFrame(rows, "model_seed int, family string, model_id string, base double, candidate double, split string")


def test_constant_bootstrap(spark):
    row = sx.paired_bootstrap(seed_matrix(spark, 3, 12, 1.0, .81), cell=["split"], cloud=["family", "model_id"], replicates=40).first()
    assert row.improvement_percent == pytest.approx(10) and row.ci_lower == pytest.approx(10) and row.ci_upper == pytest.approx(10)
    assert (row.seeds, row.clouds, row.replicates) == (3, 12, 40)


def test_bootstrap_reads_its_pairs_once(spark):
    """The pairs may be folds and joins of large tables; and draws are dealt to tasks by their number."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    pairs = seed_matrix(spark, 3, 12, 1.0, .81)
    row = sx.paired_bootstrap(pairs.mapInArrow(counted, pairs.schema), cell=["split"], cloud=["family", "model_id"], replicates=40).first()
    assert row.clouds == 12 and read.value == 36
    assert rp._deal(pairs, "model_id", total=9 * rp.TASK_DRAWS + 1).rdd.getNumPartitions() == 10


def test_tallies_at_the_ends_of_blocks_and_chunks():
    """Names that fill a hash block, streams of several chunks, counts that do not fill a digest."""

    def plain(name, count, bound):
        parts = [int(hashlib.sha256(f"{name}:{k}".encode()).hexdigest()[16 * q:16 * q + 15], 16) for k in range(-(-count // 4)) for q in range(4)]
        return np.array(parts[:count], dtype=np.int64) % bound

    for length in (1, 50, 52, 53, 54, 55, 61, 62, 63, 64, 117, 126, 127, 200):
        name = "k" * length
        assert (draws.draws(name, 0, 41, 1000) == plain(name, 41, 1000)).all()
    most = draws.CHUNK * draws.PER_DIGEST + 3
    names, wanted = ["a", "b", "c", "d"], np.array([most, 0, 7, 5])
    for bound, width in ((2048, 1024), (1000, 1), (2999, 1000)):
        expected = [np.bincount(plain(n, w, bound) // width, minlength=-(-bound // width)) if w else np.zeros(-(-bound // width), int) for n, w in zip(names, wanted)]
        assert (draws.tally(names, wanted, bound, width) == np.stack(expected)).all()


def test_variance_components(spark):
    matrix = np.array([[0, .01, -.01], [1, 1.01, .99]])
    cells = spark.createDataFrame([("a", i, j, float(v)) for (i, j), v in np.ndenumerate(matrix)], "k string, d int, r int, v double")
    row = sx.two_way_components(cells, ["k"], "d", "r", "v").first()
    assert row.fraction_row > .99 and row.rows == 2 and row.columns == 3
    grand, rm, cm = matrix.mean(), matrix.mean(axis=1), matrix.mean(axis=0)
    assert row.ms_row == pytest.approx(3 * ((rm - grand) ** 2).sum())
    assert row.ms_column == pytest.approx(2 * ((cm - grand) ** 2).sum() / 2)
    still = sx.two_way_components(cells.withColumn("v", F.lit(2.0)), ["k"], "d", "r", "v").first()
    assert still.fraction_row == 0


def test_factor_bootstrap(spark):
    coordinate = spark.createDataFrame([(d, r, f, f"{f}{c}", .01) for d in range(2) for r in range(3) for f in "ab" for c in range(4)], "decoder_seed int, refiner_seed int, family string, model_id string, chamfer_mse double")
    feature = spark.createDataFrame([(s, f, f"{f}{c}", .04) for s in range(3) for f in "ab" for c in range(4)], "feature_seed int, family string, model_id string, chamfer_mse double")
    row = sx.factor_bootstrap(coordinate, feature, replicates=30).first()
    assert row.improvement_percent == pytest.approx(50) and row.ci_lower == pytest.approx(50) and row.families == 2 and row.clouds == 8


def test_resamples_by_slices(spark):
    """Trees of several slices against plain sums over the same draws; counts, sizes and spread are those of a multinomial."""
    size, replicates, width = 23, 700, 4
    values = np.random.default_rng(3).normal(size=(size, 2))
    rows = [("cell", 5, size, [1], m, [float(v) for v in values[m]]) for m in range(size)]
    frame = spark.createDataFrame(rows, "_cell string, _group long, _size long, _levels array<int>, _member long, _values array<double>")
    cells = spark.createDataFrame([("cell", 5, size)], "_cell string, _group long, _size long")
    groups = rp.replicate_blocks(cells, replicates, 300).withColumn("_n", F.array_repeat(F.col("_size"), F.col("_many")))
    counts = rp.slice_counts(groups, width)
    got = rp.drawn_sums(frame, counts, lambda cell, first, sums, levels: sums * 2, 2, width).orderBy("_r").toPandas()
    assert got["_r"].tolist() == list(range(replicates)) and (got["_n"] == size).all()
    drawn = np.zeros((replicates, size), int)
    by_slice = draws.tally(draws.replicate_names("cell", "slice:5", 0, replicates), np.full(replicates, size), size, width)
    for part in range(6):
        here = min(width, size - part * width)
        drawn[:, part * width:part * width + here] = draws.tally(
            draws.replicate_names("cell", f"inside:5:{part}", 0, replicates), by_slice[:, part], here)
    assert (drawn.sum(axis=1) == size).all()
    assert np.abs(got[["_sum_0", "_sum_1"]].to_numpy() - 2 * drawn @ values).max() < 1e-9
    assert np.abs(drawn.mean(axis=0) - 1).max() < 0.2 and np.abs(drawn.var(axis=0) - (1 - 1 / size)).max() < 0.35


def test_draws_are_dealt_to_tasks_by_count(spark):
    """Rows that stand for many draws are small, so adaptive coalescing must not put them into one task."""
    cells = spark.createDataFrame([(f"c{k}", 5, 23) for k in range(8)], "_cell string, _group long, _size long")
    groups = rp.replicate_blocks(cells, 100, 10).withColumn("_n", F.array_repeat(F.col("_size"), F.col("_many")))
    tasks = rp.slice_counts(groups, 4).select(F.spark_partition_id()).distinct().count()
    assert tasks == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_bootstrap_intervals_against_plain_resampling(spark):
    draw = np.random.default_rng(8)
    table = draw.uniform(0.01, 0.09, size=(2, 4, 30))
    rows = [(s, f"f{c % 3}", f"m{c}", float(table[0, s, c]), float(table[1, s, c]), "v") for s in range(4) for c in range(30)]
    pairs = spark.createDataFrame(rows, "model_seed int, family string, model_id string, base double, candidate double, split string")
    got = sx.paired_bootstrap(pairs, cell=["split"], cloud=["family", "model_id"], replicates=4000, seed="x").first()
    gains = []
    for _ in range(4000):
        i, j = draw.integers(0, 4, 4), draw.integers(0, 30, 30)
        a, b = (np.sqrt(side[i][:, j].mean()) for side in table)
        gains.append(100 * (a - b) / a)
    low, high = np.quantile(gains, [0.025, 0.975])
    assert abs(got.ci_lower - low) < 0.06 * (high - low) and abs(got.ci_upper - high) < 0.06 * (high - low)


def test_factor_intervals_against_plain_resampling(spark):
    draw = np.random.default_rng(2)
    families = np.array(["a"] * 3 + ["b"] * 9 + ["c"] * 5)
    left, right = draw.uniform(0.01, 0.05, size=(2, 3, 17)), draw.uniform(0.02, 0.06, size=(4, 17))
    a = [("v", d, r, families[c], f"m{c}", float(left[d, r, c])) for d in range(2) for r in range(3) for c in range(17)]
    b = [("v", f, families[c], f"m{c}", float(right[f, c])) for f in range(4) for c in range(17)]
    got = sx.factor_bootstrap(
        spark.createDataFrame(a, "split string, decoder_seed int, refiner_seed int, family string, model_id string, chamfer_mse double"),
        spark.createDataFrame(b, "split string, feature_seed int, family string, model_id string, chamfer_mse double"),
        cell=["split"], replicates=4000).first()
    gains = []
    for _ in range(4000):
        clouds = np.concatenate([draw.choice(np.flatnonzero(families == f), (families == f).sum()) for f in draw.choice(list("abc"), 3)])
        d, r, f = draw.integers(0, 2, 2), draw.integers(0, 3, 3), draw.integers(0, 4, 4)
        x, y = np.sqrt(left[d][:, r][:, :, clouds].mean()), np.sqrt(right[f][:, clouds].mean())
        gains.append(100 * (y - x) / y)
    low, high = np.quantile(gains, [0.025, 0.975])
    assert got.split == "v" and abs(got.ci_lower - low) < 0.07 * (high - low) and abs(got.ci_upper - high) < 0.07 * (high - low)


def test_benefit_and_learned_codec_gates(spark):
    intervals = spark.createDataFrame([("v", 1.0), ("o", 0.5)], "split string, ci_lower double")
    seeds = spark.createDataFrame([("v", 1, 2.0), ("v", 2, 1.0), ("o", 1, 3.0)], "split string, model_seed int, improvement_percent double")
    plain = spark.createDataFrame([("v", -1.0), ("o", 0.2)], "split string, improvement_percent double")
    runs = spark.createDataFrame([(1, "a"), (2, "b")], "model_seed int, state string")
    judge = lambda **given: gt.benefit_gate(given.pop("intervals", intervals), seeds, ["split"], **{"fallback": plain, "runs": runs, **given}).first()
    row = judge()
    assert row.passed and row.cells == 2 and row.fallback_improves and row.runs_independent
    assert not judge(fallback=plain.filter("split = 'v'")).passed
    assert not judge(runs=runs.withColumn("state", F.lit("a"))).passed
    assert not judge(intervals=intervals.withColumn("ci_lower", F.col("ci_lower") - 0.6)).passed
    found = spark.createDataFrame([("validation", "chamfer_mse", 0.1), ("ood", "chamfer_mse", -1.0)], "split string, metric string, ci_lower double")
    assert gt.learned_codec_gate(found).first().passed
    assert gt.learned_codec_gate(found.withColumn("ci_lower", -F.col("ci_lower"))).first().passed is False
    assert gt.learned_codec_gate(found.filter("split = 'ood'")).first().passed is False


def test_fingerprint_is_a_hash_tree(spark):
    def root(lines, leaf):
        seen = Counter(hashlib.sha256(line.encode()).hexdigest() for line in lines)
        digits = next((k for k in (0, 2, 4, 6) if len(seen) <= leaf * 16 ** k), 8)
        nodes = {}
        for digest, count in seen.items():
            nodes.setdefault(digest[:digits], []).append(f"{digest}:{count}")
        while True:
            nodes = {p: hashlib.sha256("\n".join(sorted(rows)).encode()).hexdigest() for p, rows in nodes.items()}
            if not digits:
                return nodes[""]
            digits, below = digits - 2, nodes
            nodes = {}
            for p, h in below.items():
                nodes.setdefault(p[:digits], []).append(f"{p}:{h}")

    lines = [f"m{k}" for k in range(700)] + ["m3", "m3"]
    frame = lambda rows: spark.createDataFrame([(x,) for x in rows], "m string").repartition(3)
    for leaf in (1024, 600, 3, 1):  # up to four digits
        got = rs.dataset_fingerprint(frame(lines), ["m"], leaf=leaf).first()
        assert (got.fingerprint, got.members) == (root(lines, leaf), 702)
    first = rs.dataset_fingerprint(frame(lines[::-1]), ["m"]).first().fingerprint
    assert first == root(lines, 1024) and first != rs.dataset_fingerprint(frame(lines[:-1]), ["m"]).first().fingerprint


def test_plan_and_option_problems(spark):
    axes = spark.createDataFrame([("m", "fps"), ("m", "fps"), ("m", "odd"), ("k", " "), ("k", None), ("k", "4")], "axis string, entry string")
    known = spark.createDataFrame([("m", "fps"), ("k", "4")], "axis string, entry string")
    assert {(r.axis, r.entry, r.reason) for r in gt.plan_problems(axes, known).collect()} == {
        ("m", "fps", "listed more than once"), ("m", "odd", "not known"), ("k", " ", "blank"), ("k", None, "blank")}
    assert {r.reason for r in gt.plan_problems(axes).collect()} == {"listed more than once", "blank"}
    given = [("r1", "--q=1"), ("r1", "--q=2"), ("r1", "--w=1"), ("r 2", "--q=1"), ("", "--q=1"), ("r3", "-q=1"), ("r3", None), ("r3", "--modeX=2"), ("r4", "--q=1")]
    found = {(r.rate_point, r.option): r.reason for r in gt.option_problems(spark.createDataFrame(given, "rate_point string, option string"), ["--mode"]).collect()}
    assert found == {("r1", "--q=1"): "given twice", ("r1", "--q=2"): "given twice", ("r 2", "--q=1"): "blanks in the rate point's name",
                     ("", "--q=1"): "a rate point without a name", ("r3", "-q=1"): "not written --name=value", ("r3", None): "not written --name=value",
                     ("r3", "--modeX=2"): "the run sets this option itself"}


def test_association_with_ties_and_constants(spark):
    frame = spark.createDataFrame([("a", float(x), float(y)) for x, y in zip([1, 2, 2, 3], [10, 30, 20, 40])] + [("b", 1.0, float(y)) for y in range(3)], "k string, x double, y double")
    rows = {r.k: r for r in sx.association(frame, ["k"], "x", "y").collect()}
    assert rows["a"].spearman == pytest.approx(np.corrcoef([0, 1.5, 1.5, 3], [0, 2, 1, 3])[0, 1])
    assert rows["b"].spearman is None and rows["b"].pearson is None


def test_categories_and_splits_are_disjoint(spark):
    categories = spark.createDataFrame([(f"class_{i}",) for i in range(10)], "category string")
    held = sm.heldout_categories(categories, 3, 41)
    assert held.filter("heldout").count() == 3 and held.filter("NOT heldout").count() == 7
    records = spark.createDataFrame([(c, f"{o}{i}", o) for c in ("alpha", "beta") for o in ("train", "test") for i in range(3)], "category string, model_id string, official_split string")
    split = sm.stratified_split(records, spark.createDataFrame([("beta",)], "category string"), train=1, calibration=1, validation=1, ood=1, seed=3, official=True)
    rows = {r.split: (r.category, r.official_split) for r in split.collect()}
    assert rows == {"train": ("alpha", "train"), "calibration": ("alpha", "train"), "validation": ("alpha", "test"), "category_ood": ("beta", "test")}
    assert rs.overlap_matrix(split, ["category", "model_id"]).isEmpty()
    assert all(r.breaches == 0 for r in gt.split_rules(split).collect())
    big = sm.stratified_split(records, spark.createDataFrame([("beta",)], "category string"), train=2000, validation=1, ood=1, seed=3)
    assert big.filter("split = 'train'").count() == 6


def test_pairing_and_matched_baseline(spark):
    rows = spark.createDataFrame([("v", 1, "fps", "a", .4), ("v", 1, "free", "a", .3), ("v", 1, "fps", "b", .2)], "split string, model_seed int, method string, model_id string, chamfer_mse double").withColumn("family", F.lit("f"))
    assert [r.model_id for r in rs.pairing_problems(rows, ("fps", "free"), ["split", "model_id"]).collect()] == ["b"]
    assert [r.model_id for r in rs.matched_baseline(rows, "free", ["split"]).collect()] == ["a"]
    pairs = rs.paired_rows(rows, ["split", "model_id"])
    assert pairs.count() == 1 and rs.paired_wins(pairs, ["split"]).first().wins == 1


def test_carve_split(spark):
    rows = spark.createDataFrame([("train", i) for i in range(5)] + [("test", 0)], "split string, position int")
    carved, report = sm.carve_split(rows, "train", 3)
    assert carved.groupBy("split").count().toPandas().set_index("split")["count"].to_dict() == {"train": 3, "calibration": 2, "test": 1}
    assert report.first().exact


def test_fingerprint_levels_read_their_nodes_once(spark):
    """Trees of different depth beside each other, in a plan that grows by one fold a level."""
    rows = spark.createDataFrame([(k, str(i)) for k, n in (("a", 3), ("b", 50), ("c", 400)) for i in range(n)], "k string, m string")
    found = rs.dataset_fingerprint(rows, ["m"], ["k"], leaf=4)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") <= 5 and "Union" not in plan
    for r in found.collect():
        alone = rs.dataset_fingerprint(rows.filter(F.col("k") == r.k), ["m"], leaf=4).first()
        assert (r.fingerprint, r.members) == (alone.fingerprint, alone.members)


def test_fingerprint_ignores_order_and_sees_changes(spark):
    frame = spark.range(50).select(F.col("id").cast("string").alias("a"))
    first = rs.dataset_fingerprint(frame, ["a"]).first()
    assert first == rs.dataset_fingerprint(frame.orderBy(F.rand(3)), ["a"]).first() and first.members == 50
    assert first.fingerprint != rs.dataset_fingerprint(frame.filter("a <> '7'"), ["a"]).first().fingerprint


def test_reference_pairs_need_equal_rates(spark):
    mine = spark.createDataFrame([("ood", "a", 86, .1), ("ood", "b", 86, .1), ("ood", "c", 86, .1)], "split string, model_id string, stream_bytes int, chamfer_mse double")
    theirs = spark.createDataFrame([("category_ood", "a", 86, .2), ("category_ood", "b", 90, .2)], "split string, model_id string, stream_bytes int, chamfer_mse double")
    good, bad = rs.reference_pairs(mine, theirs, {"category_ood": "ood", "validation": "validation"}, ["split", "model_id"])
    assert [r.model_id for r in good.collect()] == ["a"]
    assert {r.model_id: r.reason for r in bad.collect()} == {"b": "stream sizes differ", "c": "no reference row"}
