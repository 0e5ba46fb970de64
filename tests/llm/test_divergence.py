import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cumulo.llm import divergence
from cumulo.llm.transducer import Transducer
from tests.llm.cases import counted, empty, frame, messy, messy_rows


@settings(max_examples=60, deadline=None)
@given(st.sets(st.binary(max_size=6), max_size=60), st.lists(st.binary(max_size=7), max_size=20))
def test_transducer(terms, others):
    sorted_terms = sorted(terms)
    built = Transducer.unpack(Transducer.build(sorted_terms).pack())
    asked = [*sorted_terms, *others]
    places = {term: at for at, term in enumerate(sorted_terms)}
    assert built.ordinals(asked).tolist() == [places.get(term, -1) for term in asked]
    assert [built.term(at) for at in range(len(sorted_terms))] == sorted_terms


def test_transducer_is_minimal():
    ends = ["", "ed", "ing", "s"]
    terms = sorted((stem + end).encode() for stem in ["walk", "talk", "park", "mark"] for end in ends)
    built = Transducer.build(terms)
    # One state per different continuation of some prefix.
    behind = {frozenset(t[len(p):] for t in terms if t.startswith(p)) for p in {t[:k] for t in terms for k in range(len(t) + 1)}}
    assert len(built.final) == len(behind)
    with pytest.raises(ValueError):
        Transducer.build([b"b", b"a"])


def plain(rows, least, ranks):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(
        chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in mine for t in set(d[2]))
        kept = sorted((t for t, n in seen.items() if n >= least), key=str.encode)
        counts = {s: Counter(t for d in mine if d[1] == s for t in d[2] if seen[t] >= least) for s in {d[1] for d in mine}}
        whole = sum(counts.values(), Counter())

        def share(counter, kept=kept):
            return [1 + 10 ** 9 * (counter[t] + 5) // (sum(counter.values()) + 5 * len(kept)) for t in kept]

        shares = {s: share(c) for s, c in counts.items()}
        for s in counts:
            pairs = [(sum(abs(a - b) for a, b in zip(shares[s], shares[o])), o) for o in counts if o != s]
            terms = [(p - q, t) for p, q, t in zip(shares[s], share(whole), kept) if counts[s][t] and p > q]
            for part, found, most in (("pair", pairs, None), ("term", terms, ranks)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, rank + 1) for rank, (value, item) in enumerate(found[:most])]
    return out


def docs_of(spark, rows):
    return frame(spark, [(k, text, source) for k, (text, lang, source) in enumerate(rows)]).drop("lang").join(
        spark.createDataFrame([(k, lang) for k, (_, lang, _) in enumerate(rows)], "doc_id long, lang string"), "doc_id")


def some_rows():
    draw = random.Random(2)
    pool = [f"{a}{b}" for a in ["wor", "Éc", "日", "x", "ß"] for b in ["", "d", "ds", "É", "😀", "zz"]]
    rows = [(" ".join(draw.choices(pool, range(1, 31), k=draw.randrange(40))), draw.choice(["en", "en", "de", None]), draw.choice("abcab") + "x" * draw.randrange(2))
            for _ in range(300)]
    return rows + [(None, "en", None), ("", "fr", "a"), ("\t", "fr", "b"), ("a1b2_c", "fr", None), rows[0], rows[0]]


@pytest.mark.parametrize("settings_", [{}, {"block": 3}, {"block": 4, "round_bytes": 300}])
def test_against_plain_python(spark, settings_, monkeypatch):
    monkeypatch.setattr(divergence, "STRETCH", 7)
    monkeypatch.setattr(divergence, "TILE", 2)
    rows = some_rows()
    got = divergence.audit(docs_of(spark, rows), 20, 6, **settings_)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert counted(map(tuple, got.collect())) == counted(plain(rows, 20, 6))


def test_messy_and_empty(spark):
    rows = [(text, "en", source) for _, text, source in messy_rows()]
    assert counted(map(tuple, divergence.audit(messy(spark), 2).collect())) == counted(plain(rows, 2, 50))
    assert divergence.audit(empty(spark)).count() == 0


def test_many_entries_are_sent_in_parts(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 10)
    rows = some_rows()
    assert counted(map(tuple, divergence.audit(docs_of(spark, rows), 20).collect())) == counted(plain(rows, 20, 50))
