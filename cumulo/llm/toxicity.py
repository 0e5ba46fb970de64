"""Toxic spans by a linear-chain conditional random field.

Documents carry labels, tokens don't; so words and word beginnings that toxic
documents hold far more often than clean ones label the tokens first. A chain
with two states is then trained on segments of these tokens, with hashed features
of each word and learned transitions. Forward-backward marginals over whole
texts give each token's probability; a document's score is a logistic function
of its largest marginal and its expected number of toxic tokens, fitted on the
training documents.

The model is fitted on at most ``sample`` labelled rows of each class, chosen by
hash. Everything else runs over all rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cumulo.llm.common import crc32_remainder

#: Labelled rows of each class that the model is fitted on, at most.
SAMPLE = 6000
#: Segments with and without toxic tokens that the chain is trained on, at most.
SEGMENTS = 6000
SEGMENT_WORDS = 32
WEIGHTS = 1 << 18
#: Characters of the texts whose chains advance together, about.
GROUP_CHARS = 1 << 20
#: Rows of a batch that are texts of Python's at one time, and words or traits that a worker remembers, at most.
SLICE_ROWS = 1_000
MEMO = 100_000
MARKS = b".,;:!?\"'()[]{}*#$%&|<>-_"


def words_of(text: str | None) -> list[bytes]:
    """ASCII-lowered runs of anything but ASCII white space."""
    return (text or "").encode().lower().split()


def traits(word: bytes) -> list[str]:
    """Features of a word: itself without marks around it, its beginnings and its end."""
    core = word.strip(MARKS).decode("utf-8", "ignore").lower()
    return [f"w{core}"] + [f"{n}{core[:n]}" for n in (3, 4, 5, 6) if len(core) > n] + [f"s{core[-3:]}"]


def slots(word: bytes) -> list[int]:
    return [zlib.crc32(t.encode()) % WEIGHTS for t in traits(word)]


@dataclass
class ChainModel:
    """Weights of a two-state chain: 0 clean, 1 toxic; scores are odds of state 1."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(WEIGHTS, np.float32))
    bias: float = -6.0
    #: exp of the transition weights, [from, to]
    moves: np.ndarray = field(default_factory=lambda: np.ones((2, 2)))
    #: intercept, slope of the largest log-odds, slope of log(1 + expected tokens); None: nothing was learned
    document: np.ndarray | None = None

    def memo(self) -> "Emissions":
        return Emissions(self)


class Emissions(dict):
    """Memo of word -> log-odds of the toxic state before its neighbours are heard."""

    def __init__(self, model: ChainModel):
        super().__init__()
        self.model = model

    def __missing__(self, word: bytes) -> float:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = self.model.bias + float(self.model.weights[slots(word)].sum())
        return value


def marginal_odds(scores: list[np.ndarray], moves: np.ndarray) -> list[np.ndarray]:
    """Log-odds of the toxic state of every token of every sequence, by forward-backward.

    All sequences advance together, longest first; ratios of the two states stay
    within floating range by clipping.
    """
    order = sorted(range(len(scores)), key=lambda k: -len(scores[k]))
    lengths = np.array([len(scores[k]) for k in order], np.int64)
    if not len(lengths) or lengths[0] == 0:
        return [np.zeros(0) for _ in scores]
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    ratio = np.exp(np.clip(np.concatenate([scores[k] for k in order]), -30, 30))
    forward, backward = np.empty_like(ratio), np.empty_like(ratio)
    (m00, m01), (m10, m11) = moves
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # sequences longer than t
    state = np.ones(len(lengths))
    for t, n in enumerate(active.tolist()):
        at = starts[:n] + t
        before = state[:n]
        now = ratio[at] if t == 0 else ratio[at] * (m01 + m11 * before) / (m00 + m10 * before)
        state = forward[at] = np.clip(now, 1e-12, 1e12)
    heard = np.zeros(0)
    for t in range(lengths[0] - 1, -1, -1):
        n = int(active[t])
        at = starts[:n] + t
        now = np.ones(n)
        k = len(heard)
        now[:k] = (m10 + m11 * heard) / (m00 + m01 * heard)
        backward[at] = now
        heard = np.clip(ratio[at] * now, 1e-12, 1e12)
    odds = np.log(forward) + np.log(backward)
    found: list[np.ndarray] = [np.zeros(0)] * len(scores)
    for place, k in enumerate(order):
        found[k] = odds[starts[place]:starts[place] + lengths[place]]
    return found


def document_traits(odds: np.ndarray) -> tuple[float, float]:
    """Largest log-odds and log(1 + expected toxic tokens); a text without words has the lowest of both."""
    if not len(odds):
        return -30.0, 0.0
    return float(np.clip(odds.max(), -30, 30)), float(np.log1p((1 / (1 + np.exp(-np.clip(odds, -30, 30)))).sum()))


def _sample(docs: DataFrame, labels: DataFrame, sample: int, modulus: int) -> DataFrame:
    """(text, toxic) of at most ``sample`` training rows of each class, the lowest by hash."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (crc32_remainder("doc_id", modulus) != 0))
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    chosen = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in (0, 1)]
    few = chosen[0].unionByName(chosen[1])
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(few), "doc_id").select("text", "toxic")


def _sliced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of SLICE_ROWS rows, so that few texts are in Python at one time."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def _rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in _sliced(batches):
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _telling_traits(rows: DataFrame) -> set[str]:
    """Words and beginnings that mark toxic documents, from document frequencies in both classes."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = (Counter(), Counter())

        def emptied(toxic: int) -> pa.RecordBatch:
            names, numbers = pa.array(list(tables[toxic]), pa.string()), pa.array(list(tables[toxic].values()), pa.int64())
            tables[toxic].clear()
            none = pa.array([0] * len(names), pa.int64())
            return pa.RecordBatch.from_arrays([names, *((numbers, none) if toxic else (none, numbers))], names=["name", "toxic", "clean"])

        for text, toxic in _rows_of(batches):
            own = {t for w in set(words_of(text)) for t in traits(w) if t[0] in "w456"}
            tables[toxic].update(own | {""})
            if len(tables[toxic]) >= MEMO:  # sums of parts are added up below
                yield emptied(toxic)
        yield emptied(1)
        yield emptied(0)

    sums = rows.mapInArrow(counted, "name string, toxic long, clean long").groupBy("name").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where("toxic >= 3")
    found = {r["name"]: (r["toxic"], r["clean"]) for r in sums.where("name = '' OR toxic > 8 * clean").orderBy(
        F.col("name") != "", F.desc(F.col("toxic") / (F.col("clean") + 0.5)), "name").limit(20_000).collect()}
    toxic, clean = found.pop("", (0, 0))
    if not toxic:
        return set()
    chance = np.log((toxic + clean) / toxic)  # by chance, the k documents of a word are all toxic once in exp(k * chance)
    odds = lambda t, c: np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1))
    return {n for n, (t, c) in found.items() if odds(t, c) >= 2.3 and (t - 4 * c) * chance >= 7}


def _segments(rows: DataFrame, telling: set[str], most: int) -> tuple[list[list[bytes]], list[list[int]]]:
    """Labelled segments of the training texts: at most ``most`` with toxic tokens and twice as many without."""
    shared = rows.sparkSession.sparkContext.broadcast(telling)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = shared.value
        known: dict[bytes, int] = {}
        for batch in _sliced(batches):
            words, tags, some = [], [], []
            if len(known) >= MEMO:
                known.clear()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = words_of(text)
                for at in range(0, len(tokens), SEGMENT_WORDS):
                    part = tokens[at:at + SEGMENT_WORDS]
                    for w in part:
                        if w not in known:
                            known[w] = int(any(t in marks for t in traits(w)))
                    own = [known[w] if toxic else 0 for w in part]
                    words.append(b" ".join(part))
                    tags.append("".join(map(str, own)))
                    some.append(any(own))
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()), pa.array(tags, pa.string()), pa.array(some, pa.bool_())],
                names=["words", "tags", "some"])

    parts = rows.mapInArrow(cut, "words binary, tags string, some boolean")
    by_hash = F.xxhash64("words")
    got = parts.where("some").orderBy(by_hash, "tags").limit(most).collect()
    got += parts.where("NOT some").orderBy(by_hash, "tags").limit(2 * most).collect()
    return [bytes(r["words"]).split() for r in got], [[int(c) for c in r["tags"]] for r in got]


def train_chain(segments: list[list[bytes]], tags: list[list[int]], epochs: int = 12, rate: float = 0.3) -> ChainModel:
    """Maximum likelihood of the tags by AdaGrad over batches of segments, with a small penalty."""
    model = ChainModel(bias=0.0)
    if not segments:
        return model
    number: dict[bytes, int] = {}
    rows = [[number.setdefault(w, len(number)) for w in s] for s in segments]
    own = [slots(w) for w in number]
    flat = np.concatenate([np.array(x, np.int64) for x in own])
    owner = np.repeat(np.arange(len(own)), [len(x) for x in own])
    weights, squares = np.zeros(WEIGHTS), np.full(WEIGHTS, 1e-6)
    bias, bias_square = -4.0, 1e-6
    logs, log_squares = np.array([[0.5, -0.5], [-0.5, 0.5]]), np.full((2, 2), 1e-6)
    draw = np.random.default_rng(7)
    size = 512
    for _ in range(epochs):
        order = draw.permutation(len(rows))
        for begin in range(0, len(order), size):
            chosen = order[begin:begin + size]
            longest = max(len(rows[k]) for k in chosen)
            ids = np.zeros((len(chosen), longest), np.int64)
            truth = np.zeros((len(chosen), longest))
            there = np.zeros((len(chosen), longest), bool)
            for i, k in enumerate(chosen):
                n = len(rows[k])
                ids[i, :n], truth[i, :n], there[i, :n] = rows[k], tags[k], True
            value = np.bincount(owner, weights[flat], minlength=len(own))
            score = np.exp(np.clip(value[ids] + bias, -30, 30))
            move = np.exp(logs)
            # Forward and backward messages, normalised at each step; absent places pass on what they get.
            forward = np.zeros((longest, len(chosen), 2))
            backward = np.ones((longest, len(chosen), 2))
            for t in range(longest):
                message = np.ones((len(chosen), 2)) if t == 0 else forward[t - 1] @ move
                message = message * np.stack([np.ones(len(chosen)), score[:, t]], 1)
                forward[t] = message / message.sum(1, keepdims=True)
            for t in range(longest - 2, -1, -1):
                message = (backward[t + 1] * np.stack([np.ones(len(chosen)), score[:, t + 1]], 1)) @ move.T
                message /= message.sum(1, keepdims=True)
                backward[t] = np.where(there[:, t + 1, None], message, 1.0)
            both = forward * backward
            both /= both.sum(2, keepdims=True)
            wrong = np.where(there, both[:, :, 1].T - truth, 0.0)
            pair = np.zeros((2, 2))
            for t in range(1, longest):
                joint = forward[t - 1][:, :, None] * move[None] * (
                    np.stack([np.ones(len(chosen)), score[:, t]], 1) * backward[t])[:, None, :]
                joint /= joint.sum((1, 2), keepdims=True)
                seen = there[:, t]
                pair += joint[seen].sum(0)
                np.subtract.at(pair, (truth[seen, t - 1].astype(int), truth[seen, t].astype(int)), 1.0)
            scale = 1.0 / len(chosen)
            by_word = np.bincount(ids[there], wrong[there], minlength=len(own)) * scale
            slope = np.bincount(flat, by_word[owner], minlength=WEIGHTS) + 1e-6 * weights
            squares += slope**2
            weights -= rate * slope / np.sqrt(squares)
            bias_slope = wrong.sum() * scale
            bias_square += bias_slope**2
            bias -= rate * bias_slope / np.sqrt(bias_square)
            pair *= scale
            log_squares += pair**2
            logs -= 0.1 * pair / np.sqrt(log_squares)
    model.weights, model.bias, model.moves = weights.astype(np.float32), float(bias), np.exp(logs)
    return model


def _fit_document(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge."""
    rows = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(rows.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        slope = rows.T @ (p - y) + 1e-2 * w
        bend = (rows * (p * (1 - p))[:, None]).T @ rows + 1e-2 * np.eye(len(w))
        w -= np.clip(np.linalg.solve(bend, slope), -5, 5)
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, segments: int = SEGMENTS, modulus: int = 5) -> ChainModel:
    """Chain and document model from rows whose crc32(doc_id as text) mod ``modulus`` is not 0.

    Labels that are null or neither 0 nor 1 are left out; of contradicting
    labels of a document 1 counts. Without both classes nothing is learned, and
    every score is 0.
    """
    rows = _sample(docs, labels, sample, modulus)
    telling = _telling_traits(rows)
    if not telling:
        return ChainModel()
    model = train_chain(*_segments(rows, telling, segments))
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        memo = chain.memo()
        for batch in _sliced(batches):
            odds = _batch_odds(batch.column(0).to_pylist(), memo, chain)
            found = [document_traits(o) for o in odds]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.float64()), batch.column(1)],
                names=["largest", "expected", "toxic"])

    got = rows.mapInArrow(measured, "largest double, expected double, toxic int").toPandas()
    if got["toxic"].nunique() == 2:
        model.document = _fit_document(got[["largest", "expected"]].to_numpy(), got["toxic"].to_numpy(float))
    return model


def _batch_odds(texts: list[str | None], memo: Emissions, model: ChainModel) -> list[np.ndarray]:
    """Odds of every text, by groups of similar length that hold about GROUP_CHARS characters, so memory is bounded."""
    odds: list[np.ndarray] = [np.zeros(0)] * len(texts)
    group, held = [], 0

    def advance() -> None:
        emissions = [np.fromiter(map(memo.__getitem__, w), float, len(w)) for w in (words_of(texts[k]) for k in group)]
        for k, found in zip(group, marginal_odds(emissions, model.moves)):
            odds[k] = found

    for k in sorted(range(len(texts)), key=lambda k: -len(texts[k] or "")):
        group.append(k)
        held += len(texts[k] or "")
        if held >= GROUP_CHARS:
            advance()
            group, held = [], 0
    advance()
    return odds


def offending_spans(text: str, odds: np.ndarray) -> list[dict]:
    """Runs of tokens with a marginal of one half or more: byte offsets in UTF-8 and the largest probability."""
    spans: list[dict] = []
    last = -2
    places = None
    for k in np.flatnonzero(odds >= 0).tolist():
        if places is None:
            places = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text.encode())]
        p = float(1 / (1 + np.exp(-min(odds[k], 30))))
        if k == last + 1:
            spans[-1]["end"], spans[-1]["p"] = places[k][1], max(spans[-1]["p"], p)
        else:
            spans.append({"start": places[k][0], "end": places[k][1], "p": p})
        last = k
    return spans


def score(docs: DataFrame, model: ChainModel, with_spans: bool = False, keep: list[str] | None = None) -> DataFrame:
    """One row per input row: ``keep`` (doc_id unless told otherwise), toxic_score, and the offending spans if asked for.

    Null text counts as empty and is scored like any text without words. Whole
    texts are tagged, whatever their length.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = ["doc_id"] if keep is None else keep
    rows = docs.select(F.col("text").cast("string").alias("__text"), *keep)
    return _scored(rows, shared, keep, with_spans, lambda batch: batch.column(0))


def _scored(rows: DataFrame, shared: Broadcast, keep: list[str], with_spans: bool, text: Callable[[pa.RecordBatch], pa.Array]) -> DataFrame:
    """``keep`` of ``rows`` with the score of what ``text`` finds in a batch."""
    fields = [f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in keep] + ["`__llm_score` double"]
    if with_spans:
        fields.append("spans array<struct<start:bigint,end:bigint,p:double>>")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
    names = keep + ["__llm_score"] + ["spans"] * with_spans

    def tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        memo = chain.memo()
        for batch in _sliced(batches):
            texts = text(batch).to_pylist()
            odds = _batch_odds(texts, memo, chain)
            if chain.document is None:
                scores = np.zeros(len(texts))
            else:
                at = np.array([document_traits(o) for o in odds]).reshape(-1, 2) @ chain.document[1:] + chain.document[0]
                scores = 1 / (1 + np.exp(-np.clip(at, -30, 30)))
            columns = [*[batch.column(n) for n in keep], pa.array(scores, pa.float64())]
            if with_spans:
                columns.append(pa.array([offending_spans(t or "", o) for t, o in zip(texts, odds)], kind))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(tagged, ", ".join(fields)).withColumnRenamed("__llm_score", "toxic_score")


def report(docs: DataFrame, labels: DataFrame, modulus: int = 5) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted."""
    scored = score(docs, fit(docs, labels, modulus=modulus))
    return scored.select(
        "doc_id", (crc32_remainder("doc_id", modulus) == 0).alias("held_out"), F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with the columns of the input."""
    inside = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    # The text goes to the workers once, inside the row.
    rows = docs.select(F.struct(*docs.columns).alias("__llm_row"))
    scored = _scored(rows, shared, ["__llm_row"], False, lambda batch: pc.struct_field(batch.column(0), [inside]).cast(pa.string()))
    return scored.where("toxic_score < 0.5").select("__llm_row.*")
