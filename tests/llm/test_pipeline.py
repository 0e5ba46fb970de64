from collections import Counter

import pandas as pd
import pytest

import __spark_entry__
import corpus_pipeline
from cumulo.llm import mixing, toxicity
from tests.llm import cases
from tests.llm.test_minhash import expected
from tests.llm.test_models import labelled


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs, labels, _ = labelled(spark, 400)
    rows = [(9000 + i, t, s) for i, (_, t, s) in enumerate(cases.messy_rows())]
    docs.union(cases.frame(spark, rows)).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_take_effect(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        sizes.append(docs.count())
        if name == "pack":
            assert docs.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()
        else:
            assert docs.columns == columns
            assert docs.select("doc_id").exceptAll(before.select("doc_id")).count() == 0 or name == "mix"
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3]


def test_stages_against_plain_python(spark, folder, tmp_path):
    """What every stage keeps, on its own input: clean documents stay, one of each group stays, words follow the mix."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
        kept = Counter(r.doc_id for r in after.collect())
        if name == "toxicity":
            judged = {r.doc_id: r.predicted for r in toxicity.report(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()}
            assert kept == Counter(i for i, p in judged.items() if p == 0) and 0 < len(kept) < len(rows)
        elif name == "exact_dedup":
            last = {}
            for i, text, _ in rows:
                last[text or ""] = max(i, last.get(text or "", i))
            assert kept == Counter(last.values())
        elif name == "near_dedup":
            assert kept == Counter({i: n for (i, _, _, stays), n in expected(rows).items() if stays})
        else:
            taken = {r.doc_id: (r.size, r.taken) for r in mixing.mix_report(docs).collect()}
            assert all(kept[i] * size == words for i, (size, words) in taken.items()) and sum(kept.values()) > 0
        docs = after


def test_run_equals_its_stages(spark, folder):
    got = corpus_pipeline.run(spark, folder).toPandas()
    assert isinstance(got, pd.DataFrame) and len(got)
    ends = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")["length"].sum()
    assert (ends <= 1024).all()
    again = corpus_pipeline.run(spark, folder).toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got[key].to_numpy().tolist())) == sorted(map(tuple, again[key].to_numpy().tolist()))


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    for n in range(1, 14):
        assert [k for k in names if k.startswith(f"op{n}_")], n
    assert "pipeline" in names
