"""Personal data by candidate gradient boosting, in DataFrame functions only.

For each kind (email, ip, card, phone) a strict pattern with its checks gives the
base spans, which always stay. A loose pattern, run on the text with the base spans
of its kind blanked out, proposes more: addresses written with "at" and "dot",
numbers with other separators or without their plus sign, groups of digits of any
meaning. The spans of different kinds overlap.

Every span, base or proposed, is described by its format and its context with the
marks that tell base spans from others removed: "at" reads as "@", a card's
separators and a leading plus sign are dropped. The descriptions are counted over all documents;
there are at most ``CELLS`` different ones, so their counts fit the driver, where
boosted trees learn how likely a span so described is a base span. One fifth of the
documents is held out: an isotonic fit on it calibrates the scores, and each kind
selects from the score on where the calibrated chance reaches ``CONFIDENT``. The
trees go back into the plan as one column expression.

Texts are read once. No rows are shuffled but the counts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cumulo.llm.common import OWN, crc32_remainder, stored

KINDS = ["email", "ip", "card", "phone"]
#: Base patterns. Runs are entered at their start or where the last match ended, and never given back, so a text is walked once.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_DOT = r"(?: ?[\[(] ?(?:\.|dot|DOT) ?[\])] ?| (?:dot|DOT) |\.)"
#: Loose patterns of the generators.
LOOSE = {
    "email": r"(?:(?<![\p{L}\p{N}._%+-])|\G)[\p{L}\p{N}._%+-]++(?: ?[\[(] ?(?:at|AT|@) ?[\])] ?| (?:at|AT) | ?[@＠] ?)"
             r"[\p{L}\p{N}-]++(?:" + _DOT + r"[\p{L}\p{N}-]++)++",
    "ip": r"(?<![0-9.])[0-9]++(?:(?:" + _DOT + r"| ?\. ?)[0-9]++){3}+",
    "card": r"(?<![0-9])[0-9](?:[\x20._/‐-―-]{0,2}+[0-9]){11,}+",
    "phone": r"(?<![0-9])\+?[0-9(](?:[\x20()./‐-―-]{0,3}+[0-9]){6,}+",
}
#: Words that announce a kind, in the text just before a span.
HINTS = {
    "email": r"(?i)(?:mail|contact|write to|reach)[^\n]{0,12}$",
    "ip": r"(?i)(?:\bip|host|server|address|ping)[^\n]{0,12}$",
    "card": r"(?i)(?:card|visa|credit|debit|karte|tarjeta|carte)[^\n]{0,12}$",
    "phone": r"(?i)(?:tel|phone|call|fax|mobile|cell|ruf|llam|appel)[^\n]{0,12}$",
}
#: Cuts of the measures of a span: its length, digits, groups of letters and digits, longest group of digits.
CUTS = {"length": [12, 20], "digits": [1, 4, 7, 9, 11, 13, 16, 20], "groups": [2, 3, 4, 5], "longest": [2, 3, 4, 5, 13]}
#: Features and how many values each has.
FEATURES = {"kind": 4, **{k: len(v) + 1 for k, v in CUTS.items()}, "valid": 2, "hint": 3, "left": 2, "right": 2, "marks": 3}
#: Most descriptions that there can be.
CELLS = math.prod(FEATURES.values())
CONTEXT = 24
ROUNDS, LEAVES, RATE, SMOOTH = 24, 4, 0.3, 1.0
HELD_OUT = 5
CONFIDENT = 0.8
#: Base spans of a kind, learnt from and held out each, without which the kind selects nothing more.
LEAST_SPANS = 10
#: Running sums are taken by stretches of this many entries, so that their cost stays near the number of entries.
STEP = 128


def _with(df: DataFrame, **columns: Column) -> DataFrame:
    return df.withColumns({OWN + k: v for k, v in columns.items()})


def _own(name: str) -> Column:
    return F.col(OWN + name)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, b: a + b)


def _locate(df: DataFrame, text: str, pattern: str, name: str) -> DataFrame:
    """Adds ``name``: structs (start, end, found, before, after) of the matches from left to right, in code points.

    The text is cut at the matches; a match starts where the lengths of all pieces before it end.
    """
    df = _with(df, gaps=F.split(text, pattern), found=F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))
    df = _with(df, lengths=F.transform("__llm_found", lambda f, k: F.length(f) + F.length(_own("gaps")[k])))
    stretches = F.sequence(F.lit(0), F.floor(F.greatest(F.size("__llm_lengths") - 1, F.lit(0)) / STEP).cast("int"))
    df = _with(df, parts=F.transform(stretches, lambda c: F.slice("__llm_lengths", c * STEP + 1, STEP)))
    df = _with(df, heads=F.transform("__llm_parts", _sum))
    df = _with(df, bases=F.transform("__llm_heads", lambda _, c: _sum(F.slice("__llm_heads", F.lit(1), c))))
    df = _with(df, ends=F.flatten(F.transform("__llm_parts", lambda part, c: F.transform(
        part, lambda _, k: _own("bases")[c] + _sum(F.slice(part, F.lit(1), k + 1))))))
    spans = F.transform("__llm_found", lambda f, k: F.struct(
        (_own("ends")[k] - F.length(f)).alias("start"), _own("ends")[k].alias("end"), f.alias("found"),
        F.substring(_own("gaps")[k], -CONTEXT, CONTEXT).alias("before"), F.substring(_own("gaps")[k + 1], 1, 1).alias("after")))
    return df.withColumn(name, spans).drop(*(OWN + k for k in ["found", "lengths", "parts", "heads", "bases", "ends"]))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """13 to 19 digits whose check digit is right."""
    size = F.length(digits)
    total = F.aggregate(F.sequence(F.lit(1), F.least(size, F.lit(19))), F.lit(0), lambda s, k: s + _doubled(F.substring(digits, size + 1 - k, F.lit(1)).cast("int"), k))
    return F.when(size.between(13, 19), total % 10 == 0).otherwise(False)


def _doubled(digit: Column, place: Column) -> Column:
    return F.when(place % 2 == 1, digit).when(digit > 4, 2 * digit - 9).otherwise(2 * digit)


def _octets(text: Column) -> Column:
    """Numbers of at most 255 in all parts; zeros before them do not count."""
    def small(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+", "")
        return F.when(F.length(bare) <= 3, F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255).otherwise(False)
    return F.forall(F.split(text, r"\."), small)


def _valid(kind: str, text: Column) -> Column:
    """The kind's check on a span as the base pattern finds it or as ``_plain`` writes it."""
    if kind == "email":
        return text.rlike(r"\.[A-Za-z]{2,}$")
    if kind == "ip":
        return _octets(text)
    digits = _digits(text)
    return _luhn(digits) if kind == "card" else F.length(digits).between(9, 15)


def _plain(kind: str, text: Column) -> Column:
    """A span without the marks that tell base spans from others."""
    if kind == "email":
        text = F.regexp_replace(text, r" ?[\[(] ?(?:at|AT|@) ?[\])] ?| (?:at|AT) | ?[@＠] ?", "@")
    if kind in ("email", "ip"):
        return F.regexp_replace(text, _DOT + r"| ?\. ?", ".")
    if kind == "card":
        return _digits(text)
    return F.regexp_replace(F.regexp_replace(text, r"^(?:\+|00)", ""), "[/‐-―]", "-")


def _bin(value: Column, cuts: Sequence[int]) -> Column:
    return sum(((value >= cut).cast("int") for cut in cuts), F.lit(0))


def _described(spans: Column, kind: str, base: bool) -> Column:
    """Spans as structs (base, start, end, features)."""
    plain = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["before"].alias("before"),
                                                  s["after"].alias("after"), _plain(kind, s["found"]).alias("plain")))
    parts = F.transform(plain, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["before"].alias("before"), s["after"].alias("after"), s["plain"].alias("plain"),
        F.transform(F.regexp_extract_all(s["plain"], F.lit("[0-9]+"), F.lit(0)), F.length).alias("runs")))
    hint = HINTS[kind]
    other = "|".join(h for k, h in HINTS.items() if k != kind)

    def edge(char: Column) -> Column:
        return char.rlike(r"[\p{L}\p{N}]").cast("int")

    def features(s: Column) -> Column:
        return F.struct(
            F.lit(base).alias("base"), s["start"].alias("start"), s["end"].alias("end"), F.lit(KINDS.index(kind)).alias("kind"),
            _bin(F.length(s["plain"]), CUTS["length"]).alias("length"), _bin(_sum(s["runs"]), CUTS["digits"]).alias("digits"),
            _bin(F.size(F.regexp_extract_all(s["plain"], F.lit(r"[\p{L}\p{N}]+"), F.lit(0))), CUTS["groups"]).alias("groups"),
            _bin(F.coalesce(F.array_max(s["runs"]), F.lit(0)), CUTS["longest"]).alias("longest"),
            _valid(kind, s["plain"]).cast("int").alias("valid"),
            F.when(s["before"].rlike(hint), 2).when(s["before"].rlike(other), 1).otherwise(0).alias("hint"),
            edge(F.substring(s["before"], -1, 1)).alias("left"), edge(s["after"]).alias("right"),
            (F.when(s["plain"].rlike("[()-]"), 2).when(s["plain"].contains("."), 1).otherwise(0) if kind == "phone" else F.lit(0)).alias("marks"))

    return F.transform(parts, features)


def _base_check(kind: str) -> Callable[[Column], Column]:
    return lambda s: F.lit(True) if kind == "email" else _valid(kind, s["found"])


def propose(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with an array of described spans, base ones and proposed ones, in the column ``__llm_spans``."""
    columns = docs.columns
    df = _with(docs, text=F.coalesce(F.col(text).cast("string"), F.lit("")))
    spans = []
    for kind in KINDS:
        df = _locate(df, OWN + "text", BASE[kind], OWN + "matches")
        df = _with(df, valid=F.transform("__llm_matches", _base_check(kind)))
        df = _with(df, masked=F.concat(F.array_join(F.transform("__llm_matches", lambda s, k: F.concat(
            _own("gaps")[k], F.when(_own("valid")[k], F.repeat(F.lit("\x01"), (s["end"] - s["start"]).cast("int"))).otherwise(s["found"]))), ""),
            F.element_at("__llm_gaps", -1)), matches=F.filter("__llm_matches", lambda s, k: _own("valid")[k]))
        df = _locate(df, OWN + "masked", LOOSE[kind], OWN + "loose")
        df = _with(df, **{"of_" + kind: F.concat(_described(_own("matches"), kind, True), _described(_own("loose"), kind, False))})
        spans.append(_own("of_" + kind))
    return _with(df, spans=F.concat(*spans)).select(*columns, OWN + "spans")


class Trees:
    """Boosted trees over binned features: (feature, cut, left, right) with leaf values, logistic loss."""

    def __init__(self, start: float, trees: list):
        self.start, self.trees = start, trees

    def score(self, cell: dict[str, int]) -> float:
        total = self.start
        for tree in self.trees:
            while isinstance(tree, tuple):
                feature, cut, low, high = tree
                tree = low if cell[feature] <= cut else high
            total += tree
        return total

    def column(self, field: Callable[[str], Column]) -> Column:
        def of(tree: tuple | float) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            feature, cut, low, high = tree
            return F.when(field(feature) <= cut, of(low)).otherwise(of(high))
        return sum((of(tree) for tree in self.trees), F.lit(float(self.start)))


def _gain(g: float, h: float) -> float:
    return g * g / (h + SMOOTH)


def boost(cells: list[tuple[dict[str, int], float, float]], rounds: int = ROUNDS, leaves: int = LEAVES) -> Trees:
    """Trees fitted to cells (features, positive count, negative count); each tree grows the leaf that gains most."""
    positive, negative = (sum(c[k] for c in cells) for k in (1, 2))
    model = Trees(math.log((positive + 1) / (negative + 1)), [])
    scores = [model.start] * len(cells)
    for _ in range(rounds):
        slopes = []
        for (_, yes, no), score in zip(cells, scores):
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, score))))
            slopes.append((yes - (yes + no) * p, (yes + no) * p * (1 - p)))

        def best(members: list[int], slopes: list = slopes) -> tuple:
            g, h = (sum(slopes[k][e] for k in members) for e in (0, 1))
            found = (1e-9, "", 0)
            for feature, values in FEATURES.items():
                sums = [[0.0, 0.0] for _ in range(values)]
                for k in members:
                    entry = sums[cells[k][0][feature]]
                    entry[0] += slopes[k][0]
                    entry[1] += slopes[k][1]
                low_g = low_h = 0.0
                for cut in range(values - 1):
                    low_g += sums[cut][0]
                    low_h += sums[cut][1]
                    gain = _gain(low_g, low_h) + _gain(g - low_g, h - low_h) - _gain(g, h)
                    if gain > found[0]:
                        found = gain, feature, cut
            return found

        nodes = {(): list(range(len(cells)))}
        splits = {(): best(nodes[()])}
        inner = {}
        while len(nodes) < leaves:
            path = max(nodes, key=lambda p: (splits[p][0], -len(p)))
            gain, feature, cut = splits[path]
            if not feature:
                break
            members = nodes.pop(path)
            inner[path] = feature, cut
            for side in (0, 1):
                nodes[path + (side,)] = [k for k in members if (cells[k][0][feature] > cut) == side]
                splits[path + (side,)] = best(nodes[path + (side,)])
        values = {p: RATE * sum(slopes[k][0] for k in m) / (sum(slopes[k][1] for k in m) + SMOOTH) for p, m in nodes.items()}

        def grown(path: tuple, values: dict = values, inner: dict = inner) -> tuple | float:
            return (*inner[path], grown(path + (0,)), grown(path + (1,))) if path in inner else values[path]

        model.trees.append(grown(()))
        for path, members in nodes.items():
            for k in members:
                scores[k] += values[path]
    return model


def calibrate(scored: list[tuple[float, float, float]]) -> list[tuple[float, float]]:
    """Isotonic fit of (score, positive, negative): rising (score from which on, chance)."""
    blocks: list[list[float]] = []
    merged: dict[float, list[float]] = {}
    for score, yes, no in scored:
        entry = merged.setdefault(score, [0.0, 0.0])
        entry[0] += yes
        entry[1] += no
    for score in sorted(merged):
        yes, no = merged[score]
        blocks.append([score, yes, yes + no])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            _, yes, every = blocks.pop()
            blocks[-1][1] += yes
            blocks[-1][2] += every
    return [(score, yes / every) for score, yes, every in blocks if every]


def fit(proposed: DataFrame, id_column: str = "doc_id", confident: float = CONFIDENT) -> tuple[Trees, dict[str, float]]:
    """(trees, least score by kind) from the spans of ``propose``; a kind with too few base spans has no least score."""
    names = list(FEATURES)
    held = (crc32_remainder(id_column, HELD_OUT) == 0).alias("held")
    spans = proposed.select(held, F.explode(OWN + "spans").alias("s"))
    counts = spans.groupBy("held", *(F.col("s")[k].alias(k) for k in names)).agg(
        F.sum(F.col("s.base").cast("long")).alias("yes"), F.count(F.lit(1)).alias("every"))
    parts: dict[bool, list] = {False: [], True: []}
    for row in counts.orderBy("held", *names).collect():  # at most 2 * CELLS
        parts[row["held"]].append(({k: row[k] for k in names}, float(row["yes"]), float(row["every"] - row["yes"])))
    trees = boost(parts[False])
    least = {}
    for number, kind in enumerate(KINDS):
        learnt, kept = (sum(yes for cell, yes, _ in parts[side] if cell["kind"] == number) for side in (False, True))
        chances = calibrate([(trees.score(cell), yes, no) for cell, yes, no in parts[True] if cell["kind"] == number])
        good = [score for score, chance in chances if chance >= confident]
        if good and min(learnt, kept) >= LEAST_SPANS:
            least[kind] = good[0]
    return trees, least


def find(docs: DataFrame, text: str = "text", id_column: str = "doc_id", confident: float = CONFIDENT) -> DataFrame:
    """The rows of ``docs`` with ``spans``: structs (kind, start, end, base, score) by kind as in KINDS, then start.

    Starts and ends count code points, ends are exclusive. Null texts are empty,
    empty texts have no spans. Repeated rows get the same spans, a null id is an id
    like others, and an empty table gives no rows. A kind of which the table holds
    too few base spans gets no others, and no span is added that meets a base span. A column of the input named ``spans`` gives way.
    """
    return _select(stored(propose(docs, text)), id_column, confident)


def _select(proposed: DataFrame, id_column: str, confident: float) -> DataFrame:
    """``find`` from the stored rows of ``propose``."""
    trees, least = fit(proposed, id_column, confident)
    scored = F.transform(OWN + "spans", lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"),
        trees.column(lambda name: s[name]).alias("score")))
    df = _with(proposed, spans=scored)
    df = _with(df, spans=F.filter(OWN + "spans", lambda s: s["base"] | (s["score"] >= _least(s["kind"], least))))
    df = _with(df, base=F.filter(OWN + "spans", lambda s: s["base"]))
    df = _with(df, spans=F.filter(OWN + "spans", lambda s: s["base"] | ~F.exists(
        OWN + "base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))).drop(OWN + "base")
    named = F.transform(F.array_sort(OWN + "spans"), lambda s: F.struct(
        F.element_at(F.lit(KINDS), s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
        s["base"].alias("base"), s["score"].alias("score")))
    return df.withColumn("spans", named).drop(OWN + "spans")


def _least(kind: Column, least: dict[str, float]) -> Column:
    value = F.lit(float("inf"))
    for name, score in least.items():
        value = F.when(kind == KINDS.index(name), F.lit(score)).otherwise(value)
    return value


def redact(docs: DataFrame, text: str = "text", id_column: str = "doc_id", confident: float = CONFIDENT) -> DataFrame:
    """The rows of ``docs`` with each stretch that spans cover replaced by its first span's kind in brackets. Null texts stay null."""
    given, row = OWN + "given", OWN + "row"
    packed = docs.select(F.struct(*docs.columns).alias(row), F.col(id_column).alias(OWN + "id"), F.col(text).cast("string").alias(given))
    df = find(packed, given, OWN + "id", confident)
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))

    def take(state: Column, s: Column) -> Column:
        piece = F.concat(F.substring(F.col(given), state["at"] + 1, s["start"] - state["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"),
                        F.when(s["start"] >= state["at"], F.concat(state["done"], piece)).otherwise(state["done"]).alias("done"))

    finish = lambda state: F.concat(state["done"], F.substring(F.col(given), state["at"] + 1, F.length(F.col(given))))
    clean = F.when(F.col(given).isNotNull(), F.aggregate(ordered, start, take, finish))
    return df.select(*(clean.alias(c) if c == text else F.col(row)[c].alias(c) for c in docs.columns))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_added."""
    found = _select(stored(propose(docs.select("doc_id", "text")).drop("text")), "doc_id", CONFIDENT)  # no text is stored
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias("n_" + kind)

    return found.select("doc_id", *(count(kind) for kind in KINDS), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
                        (F.size("spans") - F.size(base)).cast("long").alias("n_added"))
