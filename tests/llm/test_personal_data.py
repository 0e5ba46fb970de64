import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from cumulo.llm import personal_data
from tests.llm.cases import empty, frame, messy, messy_rows

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for place, digit in enumerate(map(int, reversed(digits))):
        total += digit if place % 2 == 0 else 2 * digit - 9 * (digit > 4)
    return total % 10 == 0


def plain_spans(text):
    found = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                    "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                found.append((kind, m.start(), m.end()))
    return found


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def agrees(rows, texts):
    assert len(rows) == len(texts)
    for row in rows:
        base = plain_spans(texts[row.doc_id])
        assert row.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest(), texts[row.doc_id][:200]
        assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == tuple(sum(s[0] == k for s in base) for k in PLAIN)
        every = row.spans.split(",") if row.spans else []
        assert set(joined(base).split(",") if base else []) <= set(every) and len(every) == len(base) + row.n_added
        order = [(list(PLAIN).index(k), int(a)) for k, a, _ in (s.split(":") for s in every)]
        assert order == sorted(order)


def card(draw, separator=""):
    digits = "".join(str(draw.randrange(10)) for _ in range(15))
    digits += next(d for d in "0123456789" if luhn(digits + d))
    return separator.join(digits[k:k + 4] for k in range(0, 16, 4))


def odd_texts():
    draw = random.Random(9)
    texts = {}
    for k in range(400):
        alphabet = draw.choice(["a.@-_ b", "0123456789. ", "12 -", "+1() .-9\n", "aé😀@.1+ -２", "4 1-"])
        texts[k] = "".join(draw.choice(alphabet) for _ in range(draw.randrange(60)))
    special = [
        "a@b.c_d@e.f,x@y.z.@q.r", "a@b@c.d", "é@b.c 日a@b.c😀 a@b.c", "256.1.1.1 0255.01.1.1.1.1.1 00000000000000000001.2.3.4 1.2.3.4.",
        card(draw), card(draw, " ") + " " + card(draw, "-"), "x" + card(draw) + "0", "+1 (555) 123-4567 +12345678 +123456789 +1234567890123456 + 1", "+1-----", "",
        "x" * 30_000, "1." * 20_000, "a." * 20_000 + "@", "a@" + "b." * 20_000 + "c", "+1 " * 9_000, "1 " * 15_000, "9" * 30_000, "a@b.c " * 3_000, "@" * 9_000,
        ("x" * 700 + " a@b.com ") * 400,
    ]
    return texts | {1000 + k: t for k, t in enumerate(special)}


def test_base_spans_against_plain_python(spark):
    texts = odd_texts()
    rows = personal_data.report(frame(spark, [(k, t, "a") for k, t in texts.items()])).collect()
    agrees(rows, texts)


def mail(draw, at="@", dot="."):
    return f"{draw.choice(['ana', 'bo', 'carl'])}.{draw.randrange(10, 99)}{at}mail{draw.randrange(9)}{dot}example{dot}com"


def corpus():
    draw = random.Random(4)
    pool = ["the", "house", "at", "dot", "river.", "We", "met", "3", "42.", "2021", "call", "1999,"]
    rows = []
    for k in range(600):
        words = draw.choices(pool, k=30)
        special = {0: mail(draw), 2: card(draw), 1: f"+{draw.randrange(1, 9)} ({draw.randrange(100, 999)}) {draw.randrange(100, 999)}-{draw.randrange(1000, 9999)}"}.get(k % 4)
        if k % 60 in (3, 7):
            special = mail(draw, " at ", " dot ") if k % 60 == 3 else card(draw, ".")
        if special:
            words.insert(draw.randrange(30), f"by {special} too")
        rows.append((k, " ".join(words), "a"))
    return rows


def test_proposals_beyond_the_base(spark):
    rows = corpus()
    texts = {k: t for k, t, _ in rows}
    found = personal_data.report(frame(spark, rows)).collect()
    agrees(found, texts)
    added = {row.doc_id: set(row.spans.split(",")) - set(joined(plain_spans(texts[row.doc_id])).split(",")) for row in found if row.n_added}
    assert set(added) == {k for k in texts if k % 60 in (3, 7)}
    for key, spans in added.items():
        (kind, start, end), = (s.split(":") for s in spans)
        piece = texts[key][int(start):int(end)]
        assert (kind, bool(re.fullmatch(r"\w+\.\d\d at mail\d dot example dot com", piece))) == ("email", True) if key % 60 == 3 else re.fullmatch(r"(\d{4}\.){3}\d{4}", piece)
    clean = {row.doc_id: row.text for row in personal_data.redact(frame(spark, rows)).collect()}
    for key, text in texts.items():
        cuts = sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in added.get(key, ())))
        cuts = sorted([*cuts, *((a, b, k) for k, a, b in plain_spans(text))])
        for start, end, kind in reversed(cuts):
            text = text[:start] + f"[{kind.upper()}]" + text[end:]
        assert clean[key] == text


def test_messy_rows_and_empty_table(spark):
    rows = personal_data.report(messy(spark)).collect()
    assert len(rows) == len(messy_rows()) and sum(row.doc_id is None for row in rows) == 2
    agrees([r for r in rows if r.doc_id is not None and r.doc_id != 15], {i: t or "" for i, t, _ in messy_rows() if i is not None and i != 15})
    assert personal_data.report(empty(spark)).count() == 0
    whole = personal_data.redact(messy(spark))
    assert whole.columns == messy(spark).columns
    assert sorted(map(str, whole.collect())) == sorted(map(str, messy(spark).collect()))  # nothing personal in them


def test_trees(spark):
    draw = random.Random(1)
    cells = []
    for _ in range(200):
        cell = {k: draw.randrange(n) for k, n in personal_data.FEATURES.items()}
        good = cell["kind"] == 1 and cell["digits"] > 3 or cell["hint"] == 2
        cells.append((cell, 20.0 * good + draw.randrange(2), 20.0 * (not good) + draw.randrange(2)))

    def loss(model):
        return sum(yes * math.log1p(math.exp(-model.score(c))) + no * math.log1p(math.exp(model.score(c))) for c, yes, no in cells)

    losses = [loss(personal_data.boost(cells, rounds)) for rounds in (0, 1, 5, 24)]
    assert losses == sorted(losses, reverse=True) and losses[-1] < 0.35 * losses[0]
    model = personal_data.boost(cells)
    table = spark.createDataFrame([c for c, _, _ in cells])
    scored = table.withColumn("score", model.column(F.col)).collect()
    assert all(abs(row.score - model.score(row.asDict())) < 1e-9 for row in scored)


@pytest.mark.parametrize("seed", range(5))
def test_calibration_is_isotonic(seed):
    draw = random.Random(seed)
    scored = [(draw.randrange(8) / 4, float(draw.randrange(5)), float(draw.randrange(1, 5))) for _ in range(20)]
    steps = personal_data.calibrate(scored)
    assert [s for s, _ in steps] == sorted({s for s, _ in steps}) and [c for _, c in steps] == sorted(c for _, c in steps)
    keys = sorted({s for s, _, _ in scored})
    yes, every = ([sum(x[1] + (x[2] if whole else 0) for x in scored if x[0] == k) for k in keys] for whole in (False, True))
    for at, key in enumerate(keys):  # max over starts of min over ends of the mean
        mean = max(min(sum(yes[a:b + 1]) / sum(every[a:b + 1]) for b in range(at, len(keys))) for a in range(at + 1))
        assert abs(mean - [c for s, c in steps if s <= key][-1]) < 1e-12
