import hashlib

import pytest

from cumulo.llm import exact_dedup
from tests.llm import cases


def expected(rows):
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = max(known) if known else None
        kept = False
        for i in ids:
            stays = i == best and not kept
            kept |= stays
            out.append((i, best, len(ids), stays, hashlib.sha256(text.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("words", [1, 1 << 22])  # the smallest filter lets every row through
def test_decisions(spark, words):
    ours = [tuple(r) for r in exact_dedup.decisions(cases.messy(spark), words).collect()]
    assert cases.counted(ours) == cases.counted(expected(cases.messy_rows()))


def test_hot_group_and_unique_rows(spark):
    rows = [(i, "same" if i % 3 == 0 else f"text {i}", "a") for i in range(3000)]
    ours = [tuple(r) for r in exact_dedup.decisions(cases.frame(spark, rows)).collect()]
    assert cases.counted(ours) == cases.counted(expected(rows))


@pytest.mark.parametrize("words", [1, 1 << 22])
def test_deduplicate_keeps_one_row_of_each_text(spark, words):
    docs = cases.messy(spark)
    left = exact_dedup.deduplicate(docs, words)
    assert left.columns == docs.columns
    ours = cases.counted((r["doc_id"], r["text"] or "") for r in left.collect())
    wanted = {}
    for text in {t or "" for _, t, _ in cases.messy_rows()}:
        known = [i for i, t, _ in cases.messy_rows() if (t or "") == text and i is not None]
        wanted[(max(known) if known else None, text)] = 1
    assert ours == wanted


def test_empty(spark):
    assert exact_dedup.decisions(cases.empty(spark)).count() == 0
    assert exact_dedup.deduplicate(cases.empty(spark)).count() == 0
