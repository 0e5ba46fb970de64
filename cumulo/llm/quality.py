"""Quality by ordinal cumulative-link regression on graded ratings.

One weight vector over hashed words, word shapes and a few measures of the text
is shared by all grades; ordered thresholds cut its score into grades. The model
gives the expected grade and the probability of a grade or better, on which
documents are selected.

The model is fitted on at most ``sample`` rated documents of each grade, chosen
by hash; all rows are scored, on their whole text.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cumulo.llm.common import crc32_remainder

#: Rated documents of each grade that the model is fitted on, at most.
SAMPLE = 4000
SLOTS = 1 << 14
MEASURES = 8
MEMO = 400_000


def word_slots(word: bytes) -> tuple[int, int]:
    """Hashed slots of a word as written: its lower-case letters, and its shape."""
    shape = bytearray()
    for c in word:
        kind = b"A" if 65 <= c <= 90 else b"a" if 97 <= c <= 122 or c >= 128 else b"9" if 48 <= c <= 57 else bytes([c])
        if shape[-1:] != kind or shape[-2:-1] != kind:  # runs count as two
            shape += kind
    return zlib.crc32(word.lower()) % SLOTS, zlib.crc32(b"shape " + bytes(shape[:12])) % SLOTS


class WordSlots(dict):
    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = word_slots(word)
        return value


def measures(data: bytes, words: list[bytes], distinct: int) -> list[float]:
    """A few measures of a whole text, each of the order of one."""
    n = max(1, len(words))
    size = max(1, len(data))
    lines = data.split(b"\n")
    return [
        1.0, math.log1p(len(words)) / 5, distinct / n, len(set(lines)) / len(lines),
        (len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))) / size,
        5 * (len(data) - len(data.translate(None, b"0123456789"))) / size,
        5 * (len(data) - len(data.translate(None, b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"))) / size,
        len(data) / n / 10,
    ]


@dataclass
class OrdinalModel:
    """Score = weights . features; P(grade > k) = logistic(score - thresholds[k])."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(SLOTS))
    of_measures: np.ndarray = field(default_factory=lambda: np.zeros(MEASURES))
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for every threshold."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -30, 30)))


def fit_ordinal(
    rows: np.ndarray, slot: np.ndarray, share: np.ndarray, measured: np.ndarray, grades: np.ndarray, steps: int = 200, ridge: float = 1e-4,
) -> OrdinalModel:
    """Penalised maximum likelihood by Adam; features are (rows, slot, share) triples and dense measures.

    Thresholds stay in order since each is the one before plus a positive step.
    """
    levels = int(grades.max()) + 1 if len(grades) else 0
    if levels < 2:
        return OrdinalModel()
    count = len(grades)
    weight_of = count / (levels * np.maximum(1, np.bincount(grades, minlength=levels)))[grades]  # grades weigh alike
    values = np.concatenate([np.zeros(SLOTS + MEASURES), [-0.5], np.zeros(levels - 2)])
    first, second = np.zeros_like(values), np.zeros_like(values)
    cut = SLOTS + MEASURES
    one = np.arange(count)
    for step in range(1, steps + 1):
        w, m, raw = values[:SLOTS], values[SLOTS:cut], values[cut:]
        gaps = np.exp(raw[1:])
        theta = np.concatenate([[raw[0]], raw[0] + np.cumsum(gaps)])
        score = np.bincount(rows, w[slot] * share, minlength=count) + measured @ m
        below = 1 / (1 + np.exp(-np.clip(np.concatenate([[-np.inf], theta, [np.inf]])[None, :] - score[:, None], -30, 30)))
        below[:, 0], below[:, -1] = 0.0, 1.0
        density = below * (1 - below)
        p = np.maximum(below[one, grades + 1] - below[one, grades], 1e-9)
        down = weight_of * (density[one, grades + 1] - density[one, grades]) / p / count  # d loss / d score
        upper, lower = weight_of * density[one, grades + 1] / p / count, weight_of * density[one, grades] / p / count
        by_theta = np.bincount(grades, -upper, minlength=levels)[:levels - 1] + np.bincount(grades, lower, minlength=levels)[1:]
        slope = np.concatenate([
            np.bincount(slot, down[rows] * share, minlength=SLOTS) + ridge * w, measured.T @ down + ridge * m,
            [by_theta.sum()], gaps * (by_theta[::-1].cumsum()[::-1][1:])])
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        values -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    raw = values[cut:]
    return OrdinalModel(values[:SLOTS], values[SLOTS:cut], np.concatenate([[raw[0]], raw[0] + np.cumsum(np.exp(raw[1:]))]))


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 for low quality, 1 for good but toxic texts, 2 for good ones; the lowest of several."""
    grade = F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.col("toxic") == 1), 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.cast("int").alias("grade")).where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy(
        "doc_id").agg(F.min("grade").alias("grade"))


def fit(docs: DataFrame, grades: DataFrame, sample: int = SAMPLE, modulus: int = 5) -> OrdinalModel:
    """Model from rated rows whose crc32(doc_id as text) mod ``modulus`` is not 0; grades count from 0.

    With fewer than two grades among them nothing is learned.
    """
    known = grades.where(crc32_remainder("doc_id", modulus) != 0)
    by_hash = Window.partitionBy("grade").orderBy(F.xxhash64("doc_id"), "doc_id")
    few = known.withColumn("place", F.row_number().over(by_hash)).where(F.col("place") <= sample).drop("place")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(few), "doc_id").select("text", "grade")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordSlots()
        for batch in batches:
            slots, shares, dense = [], [], []
            for text in batch.column(0).to_pylist():
                data = (text or "").encode()
                words = Counter(data.split())
                own: dict[int, int] = {}
                for word, times in words.items():
                    for slot in memo[word]:
                        own[slot] = own.get(slot, 0) + times
                total = max(1, sum(words.values()))
                slots.append(list(own))
                shares.append([v / total for v in own.values()])
                dense.append(measures(data, list(words.elements()), len(words)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(slots, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32())),
                 pa.array(dense, pa.list_(pa.float64())), batch.column(1)], names=["slots", "shares", "dense", "grade"])

    got = rows.mapInArrow(counted, "slots array<int>, shares array<float>, dense array<double>, grade int").toPandas()
    if not len(got):
        return OrdinalModel()
    return fit_ordinal(
        np.repeat(np.arange(len(got)), got["slots"].map(len)), np.concatenate(got["slots"].to_list()).astype(np.int64),
        np.concatenate(got["shares"].to_list()).astype(float), np.stack(got["dense"].to_list()), got["grade"].to_numpy(np.int64))


def score(docs: DataFrame, model: OrdinalModel, tail: int = 1) -> DataFrame:
    """One row per input row: doc_id, expected_grade, tail_probability of ``tail`` or better, and the likeliest grade.

    Null text counts as empty and is scored like any text without words. A model
    that learned nothing gives 0 everywhere.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    class Values(dict):
        def __missing__(self, word: bytes) -> float:
            if len(self) >= MEMO:
                self.clear()
            a, b = word_slots(word)
            value = self[word] = float(shared.value.weights[a] + shared.value.weights[b])
            return value

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, memo = shared.value, Values()
        for batch in batches:
            raw = np.zeros(batch.num_rows)
            for k, text in enumerate(batch.column(1).to_pylist()):
                data = (text or "").encode()
                words = data.split()
                total = sum(map(memo.__getitem__, words)) / max(1, len(words))
                raw[k] = total + float(np.dot(own.of_measures, measures(data, words, len(set(words)))))
            above = own.above(raw)
            if above.shape[1]:
                expected, reach = above.sum(axis=1), above[:, tail - 1]
                chances = -np.diff(np.column_stack([np.ones(len(raw)), above, np.zeros(len(raw))]), axis=1)
                likeliest = chances.argmax(axis=1)
            else:
                expected = reach = np.zeros(len(raw))
                likeliest = np.zeros(len(raw), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(expected, pa.float64()), pa.array(reach, pa.float64()), pa.array(likeliest, pa.int32())],
                names=["doc_id", "expected_grade", "tail_probability", "grade"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(scored, "doc_id long, expected_grade double, tail_probability double, grade int")


def report(docs: DataFrame, labels: DataFrame, modulus: int = 5) -> DataFrame:
    """One row per input row: doc_id, held_out, expected_grade, tail_probability, grade, kept (tail at least one half)."""
    return score(docs, fit(docs, graded(labels), modulus=modulus)).withColumns({
        "held_out": crc32_remainder("doc_id", modulus) == 0, "kept": F.col("tail_probability") >= 0.5})
