from collections import defaultdict

import duckdb
import pandas as pd
import pytest

from cumulo.llm import mixing
from tests.llm import cases


def by_sql(rows):
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})
    db = duckdb.connect()
    db.register("documents", documents)
    return [tuple(r) for r in db.execute(mixing.SQL.strip()).fetchall()]


def rounded(rows):
    return sorted(((r[0], r[1], r[2], round(r[3], 6), r[4]) for r in rows), key=repr)


def test_messy_rows_agree_with_sql(spark):
    ours = [tuple(r) for r in mixing.mix_report(cases.messy(spark)).collect()]
    assert rounded(ours) == rounded(by_sql(cases.messy_rows()))


def test_targets_share_all_words_and_stop_at_three_times(spark):
    rows = [(i, cases.words(i, 10), "a") for i in range(300)] + [(1000 + i, cases.words(i, 7), "c") for i in range(4)] + [
        (2000 + i, cases.words(i, 9), None) for i in range(50)]
    got = mixing.mix_report(cases.frame(spark, rows)).toPandas()
    sources = got.groupby("source_size").agg(target=("target", "first"), taken=("taken", "sum"))
    assert sources["target"].sum() == pytest.approx(got["size"].sum())
    assert sources.loc[28, "target"] == 84  # three times its size
    assert (abs(sources["target"] - sources["taken"]) <= 10).all()
    assert (got["taken"] <= 3 * got["size"]).all()
    again = mixing.mix_report(cases.frame(spark, rows).repartition(5)).toPandas()
    assert got.sort_values("doc_id")["taken"].tolist() == again.sort_values("doc_id")["taken"].tolist()


def test_heavier_weights_come_first(spark):
    # Half of the documents are mostly punctuation; only a fraction of the source is taken.
    rows = [(i, " ".join(["word"] * 10) if i % 2 else " ".join(["w!!!!!!!!"] * 10), "a") for i in range(2000)]
    rows += [(5000 + i, cases.words(i, 10), "b") for i in range(2000)]
    got = mixing.mix_report(cases.frame(spark, rows)).toPandas()
    got = got[got["doc_id"] < 5000]
    taken = got.groupby(got["doc_id"] % 2)["taken"].sum()
    assert taken[1] > 2 * taken[0]


def test_mix_repeats_rows_as_reported(spark):
    docs = cases.messy(spark)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    words = defaultdict(int)
    for r in mixed.collect():
        words[r["doc_id"]] += len((r["text"] or "").split())
    told = defaultdict(int)
    for r in mixing.mix_report(docs).collect():
        told[r["doc_id"]] += r["taken"]
    assert {k: v for k, v in words.items() if v} == {k: v for k, v in told.items() if v}


def test_empty(spark):
    assert mixing.mix_report(cases.empty(spark)).count() == 0
    assert mixing.mix(cases.empty(spark)).count() == 0
