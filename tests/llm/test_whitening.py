import numpy as np
import pytest
from pyspark.sql import types as T

from cumulo.llm import whitening

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("label", T.IntegerType()), T.StructField("x", T.StringType()), T.StructField("n", T.LongType()),
])


def frame(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, v, 1, "x", 5) for i, v in zip(ids, vectors)], SCHEMA).repartition(3)


@pytest.mark.parametrize("values", [[5.0], [3.0] * 6, [0.0] * 4, [4, 4, 4, 1, 1, 0, 0], list(np.exp(-np.arange(60) / 4)), list(range(1, 90))])
def test_spectrum(values):
    draw = np.random.default_rng(3)
    basis, _ = np.linalg.qr(draw.normal(size=(len(values), len(values))))
    matrix = (basis * np.array(values, float)) @ basis.T
    found, vectors = whitening.spectrum(matrix)
    top = max(max(values), 1e-300)
    assert np.abs(found - np.sort(values)[::-1]).max() <= 1e-12 * top
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
    assert np.abs(matrix @ vectors - vectors * found).max() <= 1e-12 * top


def test_against_numpy(spark):
    draw = np.random.default_rng(5)
    vectors = (draw.normal(size=(700, 12)) * np.linspace(0.1, 2, 12) @ draw.normal(size=(12, 12))).astype(np.float32)
    got = whitening.report(frame(spark, vectors.tolist())).toPandas()
    whole = np.floor(1024 * vectors.astype(float)).astype(np.int64) + 100_000
    sums = whole.sum(axis=0)
    centred = whole - sums / 700
    values, basis = np.linalg.eigh(centred.T @ centred / 700)
    values, basis = values[::-1], basis[:, ::-1]
    white = centred @ basis / np.sqrt(values)
    table = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert sorted(got["component"].unique()) == list(range(1, 9)) and len(got) == 700 * 8
    sign = np.sign((table * white[:, :8]).sum(axis=0))
    assert np.abs(table * sign - white[:, :8]).max() < 1e-8
    away = got.drop_duplicates("vec_id").set_index("vec_id")["deviation"].sort_index().to_numpy()
    assert (away == ((700 * whole - sums) ** 2).sum(axis=1)).all() and (got["n"] == 700).all()
    explained = got.drop_duplicates("component").set_index("component")["explained"].sort_index().to_numpy()
    assert np.abs(explained / (values[:8] / values.sum()) - 1).max() < 1e-9
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9


def test_messy_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 2.0, 0.0], [2.0, 1.0, 0.0], [0.0, 0.0, 0.0], [2.0, 1.0, 0.0], [-3.0, 1.0, 0.0]]
    bad = [None, [], [1.0, None, 2.0], [nan, 1.0, 1.0], [inf, 0.0, 0.0], [1.0, 2.0]]
    got = whitening.report(frame(spark, good + bad, [1, 2, 3, 3, None, *range(10, 16)])).toPandas()
    assert len(got) == 15 and set(got["vec_id"].dropna()) == {1, 2, 3} and (got["n"] == 5).all()
    assert got[got["component"] == 3]["whitened"].isna().all()  # nothing varies there
    assert got["identity_error"].iloc[0] < 1e-9 and abs(got.drop_duplicates("component")["explained"].sum() - 1) < 1e-12
    assert got.columns.tolist() == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_nothing_varies(spark):
    assert whitening.report(frame(spark, [])).count() == 0
    assert whitening.report(frame(spark, [None, [nan := float("nan"), nan]])).count() == 0
    rows = whitening.report(frame(spark, [[1.0, 2.0]] * 3)).collect()
    assert len(rows) == 6 and all(r.deviation == 0 and r.whitened is None and r.explained is None and r.identity_error is None for r in rows)


def test_large_entries(spark):
    rows = whitening.report(frame(spark, [[1e38, 1.0], [-1e38, 2.0], [0.0, 3.0]])).collect()
    assert len(rows) == 6 and {r.deviation is None for r in rows} == {True, False}
