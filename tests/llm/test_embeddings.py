import numpy as np
import pytest

from cumulo.llm import embedding_dedup


def vectors():
    draw = np.random.default_rng(5)
    rows, number = [], 0

    def add(vector, label):
        nonlocal number
        rows.append((number, None if vector is None else [None if v is None else float(v) for v in vector], label))
        number += 1

    for label in (0, 1):
        for _ in range(80):
            center = draw.normal(size=24)
            add(center, label)
            for _ in range(draw.integers(0, 5)):
                add(center + draw.normal(size=24) * 0.17, label)
            if draw.random() < 0.3:
                add(center * 3, label)
    for _ in range(40):
        add(np.arange(24), 1)  # copies
    add(np.zeros(24), 0)
    add(None, 0)
    add([], 0)
    add([1.0] * 23 + [None], 0)
    add([1.0] * 23 + [float("nan")], 0)
    add([1.0] * 23 + [float("inf")], 0)
    add(np.arange(24), None)
    add(np.ones(24) * 1e300, 0)
    add(np.ones(24) * 1e-300, 0)
    add([1.0, 2.0], 0)
    add([2.0, 4.0], 0)
    return rows


def expected(rows):
    def unit(v):
        if not v or None in v or not np.isfinite(v).all() or not np.any(v):
            return None
        v = np.array(v) / np.abs(v).max()
        return v / np.linalg.norm(v)

    units = [unit(v) for _, v, _ in rows]
    near = {k: set() for k in range(len(rows))}
    for a in range(len(rows)):
        for b in range(a):
            x, y = units[a], units[b]
            if x is not None and y is not None and len(x) == len(y) and rows[a][2] == rows[b][2] is not None and x @ y >= 0.98:
                near[a].add(b)
                near[b].add(a)
    found = {}
    for k in near:
        seen, todo = {k}, [k]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        found[k] = (len(near[k]), min(seen), min(seen) == k)
    return found


@pytest.mark.parametrize("block", [2000, 7])
def test_against_brute_force(spark, block):
    rows = vectors()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr(
        "*", "1 AS rep", "'x' AS unit", "2 AS copies")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(frame, block=block).collect()}
    wanted = expected(rows)
    assert got.keys() == wanted.keys()
    links = sum(w[0] for w in wanted.values())
    assert all(got[k][0] <= wanted[k][0] for k in got)  # nothing below the threshold
    assert sum(g[0] for g in got.values()) >= 0.95 * links
    assert sum(got[k] == wanted[k] for k in got) >= 0.95 * len(got)


def test_few_vectors_and_none(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], kind)).count() == 0
    rows = spark.createDataFrame([(1, [1.0, 0.0], 3), (1, [1.0, 0.0], 3), (None, [1.0, 0.01], 3), (4, None, None)], kind)
    got = sorted((tuple(r) for r in embedding_dedup.near_duplicates(rows).collect()), key=repr)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (4, 0, 4, True)], key=repr)
