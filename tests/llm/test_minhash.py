import random
from collections import Counter

import numpy as np

from cumulo.llm import minhash_dedup
from tests.llm import cases


def shingles(text):
    w = (text or "").encode().lower().split()
    return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[k:k + 5]) for k in range(len(w) - 4)}


def expected(rows):
    sets = [shingles(t) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and sets[b]:
                parent[root(a)] = root(b)
    lowest = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            lowest[root(k)] = min(i, lowest.get(root(k), i))
    return Counter((i, len(sets[k]), lowest.get(root(k), i), i == lowest.get(root(k), i)) for k, (i, _, _) in enumerate(rows))


def near_rows():
    draw = random.Random(8)
    rows, base = [], cases.words(77, 120, 5000).split()
    for i in range(60):  # a chain of edits
        base = list(base)
        base[draw.randrange(len(base))] = f"edit{i}"
        rows.append((i, " ".join(base), "a"))
    for i in range(100, 140):  # a passage shared by otherwise different texts
        rows.append((i, cases.words(i, 60, 9000) + " " + cases.words(1, 40), "b"))
    for i in range(200, 240):  # near the threshold
        text = cases.words(i, 100, 9000).split()
        rows.append((i, " ".join(text), "c"))
        for k in range(draw.randrange(1, 4)):
            text[draw.randrange(len(text))] = "z"
        rows.append((i + 1000, " ".join(text), "c"))
    return rows


def ours(frame):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in frame.collect())


def test_messy(spark):
    assert ours(minhash_dedup.near_duplicates(cases.messy(spark))) == expected(cases.messy_rows())


def test_near_copies(spark):
    docs = cases.frame(spark, near_rows())
    wanted = expected(near_rows())
    assert ours(minhash_dedup.near_duplicates(docs)) == wanted
    # Regions so small that they are deepened to the full depth and then cut into parts.
    assert ours(minhash_dedup.near_duplicates(docs, bound=4)) == wanted


def test_keep_one(spark):
    docs = cases.messy(spark)
    left = minhash_dedup.keep_one(docs)
    assert left.columns == docs.columns
    got = Counter(r["doc_id"] for r in left.collect())
    # 5 to 8 are one class, 9 and 10 another; two texts bear the id 15, one of them twice.
    assert got == Counter({**{k: 1 for k in (1, 2, 3, 4, 5, 9, 11, 12, 13, 14, 16, 17)}, None: 2, 15: 2})


def test_empty(spark):
    assert minhash_dedup.near_duplicates(cases.empty(spark)).count() == 0
    assert minhash_dedup.keep_one(cases.empty(spark)).count() == 0


def template_rows():
    """Texts of one template; those of a family are near 0.76 alike, others near 0.68."""
    draw = random.Random(4)
    template, rows = [f"t{k}" for k in range(300)], []
    for f in range(150):
        own = list(template)
        for p in draw.sample(range(0, 300, 5), 2):
            own[p] = f"f{f}p{p}"
        for v in range(2):
            text = list(own)
            for p in draw.sample(range(2, 300, 5), 4):
                text[p] = f"f{f}v{v}p{p}"
            rows.append((2 * f + v, " ".join(text), "a"))
    return rows


def test_template_group(spark):
    rows = template_rows()
    assert ours(minhash_dedup.near_duplicates(cases.frame(spark, rows), bound=40)) == expected(rows)


def test_meetings_with_many_pairs(spark, monkeypatch):
    """With no pair allowed per member all of the second round goes by full sets, without rows per pair."""
    monkeypatch.setattr(minhash_dedup, "FEW", 0)
    rows = template_rows() + [(i + 5000, t, s) for i, t, s in near_rows()]
    assert ours(minhash_dedup.near_duplicates(cases.frame(spark, rows))) == expected(rows)


def test_shared_counts_and_forest():
    draw = np.random.default_rng(2)
    sets = [np.unique(draw.integers(0, 3000, draw.integers(1, 900)).astype(np.uint64)) for _ in range(40)]
    wanted = [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]
    got = minhash_dedup._shared(sets)
    assert all(got[i, j] == wanted[i][j] for i in range(40) for j in range(40) if i != j)
    good = draw.random((60, 60)) < 0.02
    good |= good.T
    edges = list(minhash_dedup._spanning(good))
    assert all(good[a, b] for a, b in edges)
    parent = list(range(60))
    for a, b in edges:
        old, new = parent[a], parent[b]
        assert old != new
        parent = [new if x == old else x for x in parent]
    assert all(parent[a] == parent[b] for a, b in zip(*np.nonzero(good)))


def test_least_matches_depends_on_the_number_of_values():
    assert minhash_dedup.least_matches(3) == 0
    assert 30 < minhash_dedup.least_matches(80) < 45
