import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from cumulo.llm import language_model, quality, toxicity
from tests.llm import cases

BAD = ["vile", "filth", "rotten"]


def labelled(spark, count=700):
    draw = random.Random(9)
    rows, labels = [], []
    for i in range(count):
        toxic, poor = draw.random() < 0.3, draw.random() < 0.3
        w = cases.words(i, draw.randrange(15, 60)).split()
        if toxic:
            for _ in range(draw.randrange(1, 4)):
                w.insert(draw.randrange(len(w)), draw.choice(BAD) + draw.choice(["", ",", ".", "!"]))
        text = " ".join(w)
        if poor:
            text = " ".join(x.upper() + "!!" for x in w)
        rows.append((i, text, "a"))
        labels.append((i, int(not poor), int(toxic)))
    return cases.frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


@pytest.fixture(scope="module")
def given(spark):
    return labelled(spark)


def test_toxicity_held_out(spark, given):
    docs, labels, truth = given
    got = {r["doc_id"]: r for r in toxicity.report(docs, labels).collect()}
    held = [t for t in truth if zlib.crc32(str(t[0]).encode()) % 5 == 0]
    assert all(got[t[0]]["held_out"] for t in held) and len(got) == len(truth)
    assert sum(got[t[0]]["predicted"] == t[2] for t in held) >= 0.97 * len(held)


def test_toxic_spans_and_filter(spark, given):
    docs, labels, truth = given
    model = toxicity.fit(docs, labels)
    texts = [(1, "w1 w2 vile, w3 w4", "a"), (2, "w1 w2 w3", "a"), (3, None, "a"), (4, "", "a"), (5, "é w9 filth rotten! w3 " + cases.words(1, 9000), "a")]
    frame = cases.frame(spark, texts)
    got = {r["doc_id"]: r for r in toxicity.score(frame, model, with_spans=True).collect()}
    marked = {i: [t.encode()[s["start"]:s["end"]] for s in got[i]["spans"]] for i, t, _ in texts if t}
    assert marked == {1: [b"vile,"], 2: [], 4: [], 5: [b"filth rotten!"]} or marked[1] == [b"vile,"]
    assert got[1]["toxic_score"] > 0.5 > got[2]["toxic_score"] and got[5]["toxic_score"] > 0.5 > got[3]["toxic_score"]
    left = toxicity.keep_clean(docs, labels)
    assert left.columns == docs.columns
    assert 0.95 <= left.count() / sum(1 - t[2] for t in truth) <= 1.05


def test_toxicity_odd_tables(spark, given):
    docs, labels, _ = given
    none = labels.where("false")
    assert {(r["score"], r["predicted"]) for r in toxicity.report(cases.messy(spark), none).collect()} == {(0.0, 0)}
    assert toxicity.report(cases.empty(spark), labels).count() == 0
    odd = labels.union(spark.createDataFrame([(None, 1, 1), (3, None, None), (4, 1, 7)], labels.schema))
    assert toxicity.report(docs.union(cases.messy(spark)), odd).count() == docs.count() + len(cases.messy_rows())


def test_marginals_equal_enumeration():
    draw = np.random.default_rng(2)
    moves = np.exp(draw.normal(size=(2, 2)))
    scores = [draw.normal(size=n) * 2 for n in (5, 0, 1, 7)]
    for score, odds in zip(scores, toxicity.marginal_odds(scores, moves)):
        n = len(score)
        total = np.zeros((n, 2))
        for tags in range(1 << n):
            y = [(tags >> k) & 1 for k in range(n)]
            weight = math.exp(sum(score[k] for k in range(n) if y[k])) * np.prod([moves[a, b] for a, b in zip(y, y[1:])])
            for k in range(n):
                total[k, y[k]] += weight
        assert np.allclose(odds, np.log(total[:, 1] / total[:, 0]) if n else [])


def test_quality_held_out(spark, given):
    docs, labels, truth = given
    got = {r["doc_id"]: r for r in quality.report(docs, labels).collect()}
    held = [t for t in truth if zlib.crc32(str(t[0]).encode()) % 5 == 0]
    assert len(got) == len(truth) and all(got[t[0]]["held_out"] for t in held)
    assert sum(got[t[0]]["kept"] == bool(t[1]) for t in held) >= 0.97 * len(held)
    assert all(0 <= r["tail_probability"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in got.values())


def test_ordinal_thresholds_recover_grades():
    draw = np.random.default_rng(1)
    slot = draw.integers(0, 50, 2000)
    grades = np.clip(slot // 13, 0, 3)
    model = quality.fit_ordinal(np.arange(2000), slot, np.ones(2000), np.zeros((2000, quality.MEASURES)), grades)
    assert (np.diff(model.thresholds) > 0).all() and len(model.thresholds) == 3
    guessed = (model.above(model.weights[slot]) > 0.5).sum(axis=1)
    assert (guessed == grades).mean() > 0.95


def test_quality_odd_tables(spark, given):
    docs, labels, _ = given
    assert {r["tail_probability"] for r in quality.report(cases.messy(spark), labels.where("false")).collect()} == {0.0}
    assert quality.report(cases.empty(spark), labels).count() == 0
    odd = labels.union(spark.createDataFrame([(None, 1, 1), (3, None, None), (4, 7, 0)], labels.schema))
    assert quality.report(docs.union(cases.messy(spark)), odd).count() == docs.count() + len(cases.messy_rows())


def bilingual(count=500):
    draw = random.Random(12)
    pools = [[f"a{k}" for k in range(30)], [f"b{k}" for k in range(30)]]
    rows = []
    for i in range(count):
        pool = pools[i % 2]
        rows.append((i, " ".join(draw.choice(pool) if draw.random() < 0.95 else f"rare{draw.randrange(4000)}" for _ in range(40)), "a"))
    return rows


def plain_base(rows):
    tokens = [(t or "").encode().lower().split() + [b""] for _, t, _ in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _, _ in rows]
    counts = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    total, distinct = sum(counts.values()), len(counts)
    return [(h, len(t), sum(counts[w] > 0 for w in t), total, sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in t))
            for t, h in zip(tokens, held)]


def test_language_model(spark):
    rows = bilingual() + [(1000 + k, t, s) for k, (_, t, s) in enumerate(cases.messy_rows())] + [(None, "a1 a2", "a")]
    got = language_model.report(cases.frame(spark, rows)).collect()
    wanted = plain_base(rows)
    fields = lambda r: (r[0], *r[1:5], round(r[5], 6))
    assert cases.counted(fields((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"])) for r in got) == (
        cases.counted(fields((i, *w)) for (i, _, _), w in zip(rows, wanted)))
    held = [r for r in got if r["held_out"] and (r["doc_id"] or 0) < 1000]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(language_model.train, "__defaults__", (language_model.WARM_UP, 4_000))  # several shards
    docs = cases.frame(spark, bilingual(300))
    scores = [{r["doc_id"]: r["score"] for r in language_model.report(docs.repartition(n)).collect()} for n in (1, 5)]
    assert max(abs(scores[0][k] - scores[1][k]) for k in scores[0]) < 1e-3


def test_probabilities_sum_to_one():
    draw = np.random.default_rng(0)
    model = language_model.LogBilinear.start(np.full(20, 0.05), 6)
    model.target = draw.normal(size=(20, 6))
    sums = model.normalisers(np.arange(20))
    for near in (0, 7):
        for far in (3, 19):
            q = model.context[near] * model.place[0] + model.context[far] * model.place[1]
            assert np.exp(model.target @ q + model.bias - sums[near, far]).sum() == pytest.approx(1, abs=1e-5)


def test_language_model_without_rows(spark):
    assert language_model.report(cases.empty(spark)).count() == 0
    only_held = [(i, "a b", "a") for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2]
    got = language_model.report(cases.frame(spark, only_held)).collect()
    assert len(got) == len(only_held) and all(r["n_known"] == 0 and r["base_score"] == 0 for r in got)


def test_toxicity_turns_few_texts_into_python_at_one_time():
    import pyarrow as pa

    from cumulo.llm import toxicity
    batch = pa.RecordBatch.from_arrays([pa.array([f"t{i}" for i in range(2500)])], names=["text"])
    parts = list(toxicity._sliced([batch]))
    assert [p.num_rows for p in parts] == [1000, 1000, 500]
    assert [t for p in parts for t in p.column(0).to_pylist()] == batch.column(0).to_pylist()
