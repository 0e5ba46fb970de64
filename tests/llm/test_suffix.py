import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from cumulo.llm import suffix_dedup
from tests.llm import cases


def expected(rows, span=100):
    documents = {}
    for i, t, _ in rows:
        documents.setdefault((i is None, i or 0, t or ""), None)
    seen = set()
    for key in sorted(documents, key=lambda k: k[:2]):
        data = key[2].encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - span + 1):
            if data[s:s + span] in seen:
                gone[s:s + span] = True
            seen.add(data[s:s + span])
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        documents[key] = (len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return Counter((i, *documents[(i is None, i or 0, t or "")]) for i, t, _ in rows)


def repetitive_rows():
    draw = random.Random(3)
    passage, rows = cases.words(0, 60, 9000), []
    for i in range(120):
        text = cases.words(i, draw.randrange(1, 80), 9000)
        if i % 3 == 0:
            text = text + " " + passage[draw.randrange(0, 150):] + " " + cases.words(i + 500, 9, 9000)
        if i % 10 == 0:
            text += " " + "ab" * 90 + text
        rows.append((i, text, "a"))
    return rows + [(1000 + i, rows[i][1], "b") for i in range(0, 120, 7)]


@pytest.mark.parametrize("group", [5000, 3])  # 3: most anchors are split into single strings
def test_repeats(spark, group, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "removals", lambda d, s, f=suffix_dedup.removals: f(d, s, group=group))
    got = Counter(tuple(r) for r in suffix_dedup.deduplicate(cases.frame(spark, repetitive_rows())).collect())
    assert got == expected(repetitive_rows())


def test_messy(spark):
    rows = [r for r in cases.messy_rows() if r[0] != 15]  # one id with several texts has an order of its own
    got = Counter(tuple(r) for r in suffix_dedup.deduplicate(cases.frame(spark, rows)).collect())
    assert got == expected(rows)


def test_kept_text_and_empty(spark):
    rows = [(1, "x" * 99, "a"), (2, "y" * 300, "a"), (3, "a" + "y" * 300, "a")]
    got = {r["doc_id"]: r["kept_text"] for r in suffix_dedup.deduplicate(cases.frame(spark, rows), with_text=True).collect()}
    assert got == {1: "x" * 99, 2: "", 3: "a"} or got[1] == "x" * 99
    assert suffix_dedup.deduplicate(cases.empty(spark)).count() == 0


def test_index_finds_all_matching_lengths():
    draw = random.Random(6)
    for _ in range(30):
        contents = [bytes(draw.choice(b"ab") for _ in range(draw.randrange(1, 40))) for _ in range(draw.randrange(1, 7))]
        index = suffix_dedup.RunLengthIndex(contents)
        lengths = index.matching_lengths()
        text, order = index.symbols.tolist(), index.order.tolist()
        assert order == sorted(range(len(text)), key=lambda k: text[k:])
        for above, here in zip(order, order[1:]):
            n = 0
            while here + n < len(text) and above + n < len(text) and text[here + n] == text[above + n]:
                n += 1
            assert lengths[here] == n
        assert len(index.run_starts) == len(index.run_ends) <= len(text)


def test_hot_string_is_aggregated_and_enters_no_index(spark, monkeypatch):
    passage = cases.words(0, 40, 9000)
    rows = [(i, cases.words(i + 1, 4, 9000) + " " + passage + " " + cases.words(i + 900, 4, 9000), "a") for i in range(400)]
    split = []

    def seen(large, span, f=suffix_dedup._later_strings):
        split.append(f(large, span))
        return split[-1]

    monkeypatch.setattr(suffix_dedup, "_later_strings", seen)
    monkeypatch.setattr(suffix_dedup, "removals", lambda d, s, f=suffix_dedup.removals: f(d, s, group=3))
    got = Counter(tuple(r) for r in suffix_dedup.deduplicate(cases.frame(spark, rows)).collect())
    assert got == expected(rows)
    assert split and "MapInArrow" not in split[0]._jdf.queryExecution().toString()


@pytest.mark.parametrize("group", [5000, 1])
def test_repeated_rows_beside_a_shared_passage(spark, group, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "removals", lambda d, s, f=suffix_dedup.removals: f(d, s, group=group))
    passage = cases.words(0, 40, 9000)
    rows = [(i, cases.words(i + 1, 30, 9000) + " " + passage + " " + cases.words(i + 50, 30, 9000), "a") for i in (1, 2, 2, 2, 3)]
    got = Counter(tuple(r) for r in suffix_dedup.deduplicate(cases.frame(spark, rows)).collect())
    assert got == expected(rows)
