"""Log-bilinear language model trained by noise-contrastive estimation, with normalised scores.

Symbols are the most frequent words, the end of a text, and classes of all other
words by their endings. The two symbols before a token, each through its own
position weights, predict a vector; its product with a symbol's vector plus a
bias scores the symbol. Training draws noise symbols from the unigram
distribution: a short warm-up on a bounded sample gives a common start, then
every partition passes once over all its training texts and the results are
averaged. A table of normalisers for every pair of context symbols comes from
batched matrix products, so scores are true log-probabilities. Within its class
a word has its add-one share of the class's training tokens.

Word counts cover all training texts. Counts of the ``FREQUENT`` commonest words
go to every task; only the other tokens join the count table by shuffle.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cumulo.llm.common import crc32_remainder, stored

#: Words that are symbols of their own; the end of a text is among them.
OWN_WORDS = 768
CLASSES = 256
WIDTH = 24
#: Words whose counts are sent to every task.
FREQUENT = 1 << 18
#: Entries that a counting task holds before it hands them on.
HELD = 400_000
MEMO = 500_000
#: Documents of the warm-up, at most.
WARM_UP = 3000
NOISE = 64
#: Tokens of one shard of the training pass, about.
SHARD_TOKENS = 2_000_000
BATCH = 8192
BLOCK = 4096
END = b""


def word_class(word: bytes) -> int:
    """Class of a word by its last letters, and the mark after them if there is one."""
    return zlib.crc32(word[-3:] if word[-1:] in b".,;:!?" else word[-2:]) % CLASSES


def tokens_of(text: str | None) -> list[bytes]:
    return [*(text or "").encode().lower().split(), END]


def count_words(docs: DataFrame) -> DataFrame:
    """(hash, class, count) of every token of ``docs``, added up inside tasks before they move."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            words = list(held)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64).view(np.int64)),
                 pa.array([word_class(w) for w in words], pa.int32()), pa.array(list(held.values()), pa.int64())],
                names=["hash", "class", "count"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(tokens_of(text))
                if len(held) > HELD:
                    yield out()
                    held.clear()
        yield out()

    parts = docs.select(F.col("text").cast("string")).mapInArrow(counted, "hash long, class int, count long")
    return parts.groupBy("hash", "class").agg(F.sum("count").alias("count"))


@dataclass
class Lexicon:
    """What tasks know of the vocabulary: codes below ``len(hashes)`` are frequent words, the others stand for classes."""

    hashes: np.ndarray
    symbols: np.ndarray  # by code
    log_counts: np.ndarray  # by code: log10(count + 1); 0 for classes
    class_logs: np.ndarray  # by symbol: -log10 of the class's tokens, words and one; 0 for words of their own
    unigram: np.ndarray  # by symbol
    tokens: int
    words: int

    @property
    def end(self) -> int:
        """Symbol of the end of a text; also what stands before its start."""
        return int(self.symbols[Codes(self)[END]])


class Codes(dict):
    """Memo of word -> code."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.known = dict(zip(lexicon.hashes.tolist(), range(len(lexicon.hashes))))
        self.first = len(lexicon.hashes)

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        hashed = xxhash.xxh3_64_intdigest(word)
        code = self.known.get(hashed - (1 << 64) if hashed >> 63 else hashed)
        code = self[word] = self.first + word_class(word) if code is None else code
        return code


def lexicon_of(counts: DataFrame, own: int = OWN_WORDS, frequent: int = FREQUENT) -> Lexicon:
    """Symbols and class totals from all counts (stored); what comes to the driver is bounded."""
    # The lowest count that at most ``frequent`` words reach; equal counts stay together.
    reached, least = 0, 1 << 62
    for row in counts.groupBy("count").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("count")).collect():
        reached += row["words"]
        if reached > frequent:
            break
        least = row["count"]
    top = counts.where(F.col("count") >= least).toPandas().sort_values(["count", "hash"], ascending=[False, True])
    own = min(own, len(top))
    classes = top["class"].to_numpy(np.int64)
    symbols = np.concatenate([np.arange(own), own + classes[own:], own + np.arange(CLASSES)])
    sums = counts.groupBy("class").agg(F.sum("count").alias("tokens"), F.count(F.lit(1)).alias("words")).toPandas()
    tokens, words = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    tokens[sums["class"]], words[sums["class"]] = sums["tokens"], sums["words"]
    total, distinct = int(tokens.sum()), int(words.sum())
    count = top["count"].to_numpy(np.int64)
    tokens -= np.bincount(classes[:own], count[:own], minlength=CLASSES).astype(np.int64)
    words -= np.bincount(classes[:own], minlength=CLASSES)
    seen = np.concatenate([count[:own], tokens]) + 1.0
    return Lexicon(
        top["hash"].to_numpy(np.int64), symbols, np.concatenate([np.log10(count + 1.0), np.zeros(CLASSES)]),
        np.concatenate([np.zeros(own), -np.log10(tokens + words + 1.0)]), seen / seen.sum(), total, distinct)


@dataclass
class LogBilinear:
    """Context vectors, target vectors, position weights and biases."""

    context: np.ndarray
    target: np.ndarray
    place: np.ndarray
    bias: np.ndarray

    @classmethod
    def start(cls, unigram: np.ndarray, width: int = WIDTH) -> "LogBilinear":
        draw = np.random.default_rng(3)
        return cls(*(x.astype(np.float32) for x in (
            draw.normal(0, 0.3, (len(unigram), width)), draw.normal(0, 0.1, (len(unigram), width)), np.ones((2, width)), np.log(unigram))))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.context, self.target, self.place, self.bias)]).astype(np.float32)

    @classmethod
    def of(cls, flat: np.ndarray, symbols: int, width: int = WIDTH) -> "LogBilinear":
        cut = np.cumsum([symbols * width, symbols * width, 2 * width])
        a, b, c, d = np.split(flat.astype(np.float32), cut)
        return cls(a.reshape(symbols, width), b.reshape(symbols, width), c.reshape(2, width), d)

    def normalisers(self, first: np.ndarray) -> np.ndarray:
        """log of the sum over all symbols, for each of the given symbols before the token and every symbol before that."""
        context, target, place = (x.astype(np.float64) for x in (self.context, self.target, self.place))
        far = context * place[1]
        rows = np.empty((len(first), len(self.bias)), np.float32)
        for k, symbol in enumerate(first):
            scores = (context[symbol] * place[0] + far) @ target.T + self.bias
            high = scores.max(axis=1)
            rows[k] = high + np.log(np.exp(scores - high[:, None]).sum(axis=1))
        return rows


def _add_rows(to: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    """to[at] += values, also where places repeat."""
    order = np.argsort(at, kind="stable")
    places, first = np.unique(at[order], return_index=True)
    to[places] += np.add.reduceat(values[order], first, axis=0)


class NoiseContrast:
    """AdaGrad on the noise-contrastive objective; noise is shared within a batch."""

    def __init__(self, model: LogBilinear, unigram: np.ndarray, rate: float, seed: int):
        self.model, self.rate = model, rate
        self.draw = np.random.default_rng(seed)
        self.sums = np.cumsum(unigram)
        self.floor = np.log(NOISE * unigram).astype(np.float32)
        self.squares = [np.full_like(x, 1e-2) for x in (model.context, model.target, model.place, model.bias)]
        self.seen = 0

    def step(self, token: np.ndarray, near: np.ndarray, far: np.ndarray) -> None:
        m, size = self.model, len(token)
        noise = np.minimum(np.searchsorted(self.sums, self.draw.random(NOISE)), len(self.sums) - 1)
        context_near, context_far = m.context[near], m.context[far]
        predicted = context_near * m.place[0] + context_far * m.place[1]
        true = (predicted * m.target[token]).sum(axis=1) + m.bias[token] - self.floor[token]
        false = predicted @ m.target[noise].T + m.bias[noise] - self.floor[noise]
        # Slopes of the loss by score: sigmoid minus truth.
        by_true = -1 / (1 + np.exp(np.clip(true, -30, 30)))
        by_false = 1 / (1 + np.exp(-np.clip(false, -30, 30)))
        by_predicted = by_true[:, None] * m.target[token] + by_false @ m.target[noise]
        slopes = [np.zeros_like(x) for x in self.squares]
        _add_rows(slopes[0], np.concatenate([near, far]), np.concatenate([by_predicted * m.place[0], by_predicted * m.place[1]]))
        _add_rows(slopes[1], token, by_true[:, None] * predicted)
        _add_rows(slopes[1], noise, by_false.T @ predicted)
        slopes[2][0] = (by_predicted * context_near).sum(axis=0)
        slopes[2][1] = (by_predicted * context_far).sum(axis=0)
        slopes[3] += (np.bincount(token, by_true, minlength=len(m.bias)) + np.bincount(
            noise, by_false.sum(axis=0), minlength=len(m.bias))).astype(np.float32)
        for value, square, slope in zip((m.context, m.target, m.place, m.bias), self.squares, slopes):
            slope *= np.float32(30 / size)
            square += slope**2
            value -= np.float32(self.rate) * slope / np.sqrt(square)
        self.seen += size

    def learn(self, texts: list[np.ndarray], end: int) -> None:
        """One pass over the symbols of some texts, each of which ends with ``end``."""
        if not texts:
            return
        token = np.concatenate(texts)
        starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])[:-1]])
        near, far = contexts(token, starts, end)
        for at in range(0, len(token), BATCH):
            self.step(token[at:at + BATCH], near[at:at + BATCH], far[at:at + BATCH])


def contexts(token: np.ndarray, starts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbols one and two places before each token; ``end`` before the start of a text."""
    near, far = np.concatenate([[end], token[:-1]]), np.concatenate([[end, end], token[:-2]])[:len(token)]
    near[starts] = end
    far[starts] = end
    second = starts + 1
    far[second[second < len(token)]] = end
    return near, far


def _average(parts: DataFrame) -> dict[int, np.ndarray]:
    """Token-weighted mean of every block of parameters, in two steps so that no group is large."""

    def mean(table: pa.Table) -> pa.Table:
        table = table.sort_by("shard")  # the same order of sums in every run
        weights = table.column("weight").to_numpy().astype(float)
        rows = np.stack([np.frombuffer(v, np.float32) for v in table.column("values").to_pylist()])
        total = weights.sum()
        merged = (weights @ rows / max(total, 1e-9)).astype(np.float32).tobytes()
        return pa.table({"block": table.column("block").slice(0, 1), "part": pa.array([0], pa.int32()),
                         "shard": table.column("part").slice(0, 1), "weight": pa.array([total], pa.float64()), "values": pa.array([merged], pa.binary())})

    schema = "block int, part int, shard int, weight double, values binary"
    halfway = parts.groupBy("block", "part").applyInArrow(mean, schema)
    done = halfway.groupBy("block").applyInArrow(mean, schema)
    return {r["block"]: np.frombuffer(r["values"], np.float32) for r in done.collect()}


def train(docs: DataFrame, lexicon: Lexicon, warm_up: int = WARM_UP, shard_tokens: int = SHARD_TOKENS) -> LogBilinear:
    """Warm-up on at most ``warm_up`` different texts, then one pass over all of ``docs`` and the mean of the shards.

    Texts are dealt to shards by a hash of text and id, and there are as many shards as the token
    count asks for, so the model does not depend on partitions. Only symbols move.
    """
    context = docs.sparkSession.sparkContext
    words = context.broadcast(vars(lexicon))
    model = LogBilinear.start(lexicon.unigram)
    end = lexicon.end
    rows = docs.select(F.xxhash64("text").alias("hash"), F.xxhash64("text", "doc_id").alias("mark"), F.col("text").cast("string").alias("text"))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(**words.value)
        codes, symbols = Codes(own), own.symbols
        for batch in batches:
            found = [symbols[list(map(codes.__getitem__, tokens_of(t)))].astype(np.uint16).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["mark", "symbols"])

    # The lowest hashes alone are sorted; the few texts that have them follow, one of each.
    last = rows.select("hash").orderBy("hash").limit(warm_up).agg(F.max("hash")).first()[0]
    if last is None:
        return model
    few = rows.where(F.col("hash") <= last).groupBy("hash").agg(F.first("text").alias("text")).mapInArrow(
        coded, "mark long, symbols binary").collect()
    texts = [np.frombuffer(r["symbols"], np.uint16).astype(np.int64) for r in sorted(few, key=lambda r: r["mark"])]
    warm = NoiseContrast(model, lexicon.unigram, 0.1, 1)
    for _ in range(3):
        warm.learn(texts, end)
    start = context.broadcast((model.flat(), lexicon.unigram))
    shards = max(1, -(-lexicon.tokens // shard_tokens))

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, unigram = start.value
        shard, trainer = None, None

        def finished() -> Iterator[pa.RecordBatch]:
            if trainer is not None and trainer.seen:
                values = trainer.model.flat()
                blocks = [values[at:at + BLOCK].tobytes() for at in range(0, len(values), BLOCK)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(len(blocks)), pa.int32()), pa.array([shard % 64] * len(blocks), pa.int32()), pa.array([shard] * len(blocks), pa.int32()),
                     pa.array([float(trainer.seen)] * len(blocks), pa.float64()), pa.array(blocks, pa.binary())],
                    names=["block", "part", "shard", "weight", "values"])

        held: list[np.ndarray] = []
        for batch in batches:
            for own, symbols in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if own != shard or len(held) == 500:
                    if held:
                        trainer.learn(held, end)
                    held = []
                if own != shard:
                    yield from finished()
                    shard, trainer = own, NoiseContrast(LogBilinear.of(flat, len(unigram)), unigram, 0.03, 100 + own)
                held.append(np.frombuffer(symbols, np.uint16).astype(np.int64))
        if held:
            trainer.learn(held, end)
        yield from finished()

    dealt = rows.select("mark", "text").mapInArrow(coded, "mark long, symbols binary").select(
        F.pmod(F.xxhash64("mark"), F.lit(shards)).cast("int").alias("shard"), "mark", "symbols")
    dealt = dealt.repartition("shard").sortWithinPartitions("shard", "mark")
    blocks = _average(dealt.mapInArrow(passed, "block int, part int, shard int, weight double, values binary"))
    return LogBilinear.of(np.concatenate([blocks[k] for k in sorted(blocks)]), len(lexicon.unigram)) if blocks else model


def normaliser_table(docs: DataFrame, model: LogBilinear) -> np.ndarray:
    """Normalisers of every pair of context symbols, made by tasks and gathered: symbols squared, a fixed size."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vars(model))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = LogBilinear(**shared.value)
        for batch in batches:
            rows = net.normalisers(batch.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], names=["id", "row"])

    size = len(model.bias)
    rows = spark.range(0, size, 1, 24).mapInArrow(made, "id long, row binary").collect()
    return np.stack([np.frombuffer(r["row"], np.float32) for r in sorted(rows, key=lambda r: r["id"])])


def report(docs: DataFrame, modulus: int = 7, held: int = 2) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from rows whose crc32(doc_id as text) mod ``modulus`` is not ``held``.
    Null text counts as empty, which is one token, the end. Both scores are
    log10 probabilities over the same events: a training word, or any unknown
    one. Without training rows every token has the probability of an unknown one.
    """
    training = docs.where(crc32_remainder("doc_id", modulus) != held)
    counts = stored(count_words(training))
    lexicon = lexicon_of(counts)
    model = train(training, lexicon)
    table = normaliser_table(docs, model)
    context = docs.sparkSession.sparkContext
    words = context.broadcast(vars(lexicon))
    learned = context.broadcast((vars(model), table))
    end = lexicon.end

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, (parts, sums) = Lexicon(**words.value), learned.value
        net = LogBilinear(**parts)
        codes, frequent = Codes(own), len(own.hashes)
        vectors = [(net.context * net.place[0]).astype(np.float32), (net.context * net.place[1]).astype(np.float32)]
        target, bias = net.target.astype(np.float32), net.bias.astype(np.float32)
        for batch in batches:
            size, known, base, total, rare = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                tokens = tokens_of(text)
                code = np.fromiter(map(codes.__getitem__, tokens), np.int64, len(tokens))
                symbol = own.symbols[code]
                near, far = contexts(symbol, np.zeros(1, np.int64), end)
                log_p = np.einsum("ij,ij->i", vectors[0][near] + vectors[1][far], target[symbol]) + bias[symbol] - sums[near, far]
                counted = float(own.log_counts[code].sum())
                unknown = np.flatnonzero(code >= frequent)
                size.append(len(tokens))
                known.append(len(tokens) - len(unknown))
                base.append(counted)
                # Words of their own need no count; a class's words share it by count.
                shared = float(own.log_counts[code[own.class_logs[symbol] != 0]].sum())
                total.append(float(log_p.sum(dtype=np.float64)) / np.log(10) + float(own.class_logs[symbol].sum()) + shared)
                rare.append(np.array([xxhash.xxh3_64_intdigest(tokens[k]) for k in unknown.tolist()], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()),
                 pa.array(total, pa.float64()), pa.array(rare, pa.list_(pa.int64()))], names=names)

    schema = "doc_id long, n_tokens long, n_frequent long, counted double, modelled double, rare array<long>"
    names = [c.split(" ")[0] for c in schema.split(", ")]
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scored, schema)
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()))
    others = rows.select("row", F.explode("rare").alias("hash")).groupBy("row", "hash").agg(F.count(F.lit(1)).alias("times"))
    found = others.join(counts.select("hash", "count"), "hash").groupBy("row").agg(
        F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("count") + 1)).alias("logs"))
    logs = F.coalesce("logs", F.lit(0.0))
    floor = float(np.log10(lexicon.tokens + lexicon.words + 1))
    return rows.drop("rare").join(found, "row", "left").select(
        "doc_id", (crc32_remainder("doc_id", modulus) == held).alias("held_out"), "n_tokens",
        (F.col("n_frequent") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(lexicon.tokens).cast("long").alias("train_tokens"),
        (F.col("counted") + logs - F.col("n_tokens") * F.lit(floor)).alias("base_score"),
        (F.col("modelled") + logs).alias("score"))
