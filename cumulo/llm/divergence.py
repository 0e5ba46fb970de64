"""Source divergence audit over a vocabulary held in minimal acyclic transducers.

The first scan counts in how many documents of a language each term occurs. The
kept terms are range-partitioned in UTF-8 order, and every task builds the
transducers of its stretch, blocks of at most ``BLOCK`` terms. A term's ordinal is
its block's first ordinal plus what the transducer gives. The second scan streams
the texts through the transducers and sends on only (language, source, ordinal,
count). Everything after that works on ordinals: they stand for the terms in the
sums, and as they follow the UTF-8 order, ties in rank are broken by them.

Transducers reach the tasks in rounds of at most ``ROUND_BYTES``; there are as many
scans of the texts as rounds. Sources are compared by tiles of ``TILE`` sources and
stretches of ``STRETCH`` ordinals, so a task holds a bounded matrix.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cumulo.llm.common import stored
from cumulo.llm.transducer import Transducer

LEAST_DOCUMENTS = 30
SMOOTHING = 5
UNIT = 1_000_000_000
RANKS = 50
BLOCK = 100_000
ROUND_BYTES = 64 << 20
TILE, STRETCH = 64, 4096
#: Entries that a task counts before it sends them on.
HELD = 300_000

#: Letters of a term: A to Z in lower case and every byte of a code point beyond ASCII; the rest is white space.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_LETTERS).split()


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")),
                       F.col("text").cast("string").cast("binary").alias("text"))


def kept_terms(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term) of the terms that occur in at least ``least`` rows of their language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for lang, counter in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(counter), pa.string()), pa.array(list(counter), pa.binary()), pa.array(list(counter.values()), pa.int64())],
                    names=["lang", "term", "many"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                held.setdefault(lang, Counter()).update(set(terms_of(text)))
            if sum(map(len, held.values())) > HELD:
                yield from sent()
        yield from sent()

    found = _named(docs).mapInArrow(count, "lang string, term binary, many long")
    return found.groupBy("lang", "term").agg(F.sum("many").alias("many")).where(F.col("many") >= least).select("lang", "term")


def build_blocks(kept: DataFrame, block: int = BLOCK) -> DataFrame:
    """(lang, first, place, term, size, packed): one row per block with ``packed``, and one per term with its place in the block."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, held = None, []

        def sent() -> Iterator[pa.RecordBatch]:
            if held:
                size = len(held)
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * (size + 1), pa.string()), pa.array([held[0]] * (size + 1), pa.binary()),
                    pa.array([*range(size), None], pa.int64()), pa.array([*held, None], pa.binary()),
                    pa.array([None] * size + [size], pa.int64()),
                    pa.array([None] * size + [Transducer.build(held).pack()], pa.binary())],
                    names=["lang", "first", "place", "term", "size", "packed"])

        for batch in batches:
            for own, term in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if own != lang or len(held) >= block:
                    yield from sent()
                    lang, held = own, []
                held.append(term)
        yield from sent()

    parts = max(1, -(-kept.count() // block))
    dealt = kept.repartitionByRange(parts, "lang", "term").sortWithinPartitions("lang", "term")
    return dealt.mapInArrow(build, "lang string, first binary, place long, term binary, size long, packed binary")


class Vocabulary:
    """The blocks of one round, by language."""

    def __init__(self, blocks: list[tuple[str, bytes, int, bytes]]):
        self.first: dict[str, list[bytes]] = {}
        self.parts: dict[str, list[tuple[int, Transducer]]] = {}
        for lang, first, base, packed in sorted(blocks):
            self.first.setdefault(lang, []).append(first)
            self.parts.setdefault(lang, []).append((base, Transducer.unpack(packed)))

    def recount(self, lang: str, counter: Counter) -> tuple[np.ndarray, np.ndarray]:
        """(ordinals, counts) of the counted terms that the vocabulary knows."""
        if lang not in self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        dealt: dict[int, list[bytes]] = {}
        for term in counter:
            dealt.setdefault(bisect.bisect_right(self.first[lang], term) - 1, []).append(term)
        ordinals, counts = [], []
        for at, terms in dealt.items():
            if at >= 0:
                base, part = self.parts[lang][at]
                found = part.ordinals(terms)
                many = np.fromiter(map(counter.__getitem__, terms), np.int64, len(terms))
                ordinals.append(found[found >= 0] + base)
                counts.append(many[found >= 0])
        return (np.concatenate(ordinals), np.concatenate(counts)) if ordinals else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def recount(docs: DataFrame, blocks: list[tuple[str, bytes, int, bytes]]) -> DataFrame:
    """(lang, source, ordinal, many) of the vocabulary's terms, partial sums; ordinal -1 with 0 for every group that occurs."""
    given = docs.sparkSession.sparkContext.broadcast(blocks)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary(given.value)
        held: dict[tuple[str, str], Counter] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for (lang, source), counter in held.items():
                ordinals, counts = words.recount(lang, counter)
                size = len(ordinals) + 1
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()),
                    pa.array(np.append(ordinals, -1), pa.int64()), pa.array(np.append(counts, 0), pa.int64())],
                    names=["lang", "source", "ordinal", "many"])
            held.clear()

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault((lang, source), Counter()).update(terms_of(text))
            if sum(map(len, held.values())) + len(held) > HELD:
                yield from sent()
        yield from sent()

    return _named(docs).mapInArrow(count, "lang string, source string, ordinal long, many long")


def _share(many: str, total: str, size: str) -> Column:
    """1 + floor(UNIT * (many + SMOOTHING) / (total + SMOOTHING * size)), exact: decimals divided as whole numbers."""
    return F.expr(f"1 + (CAST({UNIT} AS DECIMAL(10,0)) * CAST({many} + {SMOOTHING} AS DECIMAL(20,0))) "
                  f"DIV CAST({total} + {SMOOTHING} * {size} AS DECIMAL(20,0))")


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, ranks: int = RANKS, block: int = BLOCK, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) of the parts ``pair`` and ``term``.

    Each language keeps the terms of at least ``least`` of its rows. Part ``pair``
    gives for every group (lang, source) the other sources of its language and the
    sum of the absolute differences of their smoothed shares over all kept terms;
    part ``term`` the terms that the group uses more than its language does. Ranks
    start at 1 with the largest value; ties go by the item in UTF-8 order. Null
    text, lang and source count as ''. Repeated rows all count, ids are not used,
    other columns are ignored, and an empty table gives no rows. A language
    without kept terms has pairs of value 0 and no terms.
    """
    kept = stored(kept_terms(docs, least))
    built = stored(build_blocks(kept, block))
    order = Window.partitionBy("lang").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    blocks = built.where("packed IS NOT NULL").withColumn("base", F.coalesce(F.sum("size").over(order), F.lit(0)))
    sums = Window.orderBy("lang", "first").rowsBetween(Window.unboundedPreceding, -1)
    blocks = stored(blocks.select("lang", "first", "base", "packed").join(
        blocks.select("lang", "first", F.length("packed").alias("bytes")).withColumn(
            "round", F.floor(F.coalesce(F.sum("bytes").over(sums), F.lit(0)) / round_bytes)).drop("bytes"), ["lang", "first"]))
    terms = built.where("packed IS NULL").join(blocks.select("lang", "first", "base"), ["lang", "first"]).select(
        "lang", (F.col("base") + F.col("place")).alias("ordinal"), F.col("term").cast("string").alias("item"))
    counted = None
    for number in range((blocks.agg(F.max("round")).first()[0] or 0) + 1):
        part = recount(docs, [tuple(row) for row in blocks.where(F.col("round") == number).select("lang", "first", "base", "packed").collect()])
        counted = part if counted is None else counted.unionByName(part)
    counts = stored(counted.groupBy("lang", "source", "ordinal").agg(F.sum("many").alias("many")))
    size = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    groups = stored(counts.groupBy("lang", "source").agg(F.sum("many").alias("total")).join(size, "lang", "left").withColumn(
        "size", F.coalesce("size", F.lit(0))).withColumn("number", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1))
    postings = counts.where("ordinal >= 0").join(groups, ["lang", "source"]).withColumn(
        "p", _share("many", "total", "size"))
    return _term_part(postings, groups, terms, ranks).unionByName(_pair_part(postings, groups))


def _term_part(postings: DataFrame, groups: DataFrame, terms: DataFrame, ranks: int) -> DataFrame:
    langs = groups.groupBy("lang").agg(F.sum("total").alias("everything"), F.first("size").alias("size"))
    common = postings.groupBy("lang", "ordinal").agg(F.sum("many").alias("everywhere")).join(langs, "lang").select(
        "lang", "ordinal", _share("everywhere", "everything", "size").alias("q"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ordinal")
    over = postings.join(common, ["lang", "ordinal"]).where("p > q").select(
        "lang", "source", "ordinal", (F.col("p") - F.col("q")).alias("value"))
    best = over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)
    return best.join(terms, ["lang", "ordinal"]).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")


def _pair_part(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """Sums of absolute differences: stretches of shares meet by tiles of sources, each pair of tiles once."""
    own = postings.groupBy("lang", "source", F.floor(F.col("ordinal") / STRETCH).alias("stretch")).agg(
        F.collect_list(F.struct((F.col("ordinal") % STRETCH).alias("at"), "p")).alias("list"))
    zero = _share("0L", "total", "size")
    every = groups.where("size > 0").withColumns({
        "zero": zero, "tile": F.floor(F.col("number") / TILE), "tiles": F.max(F.floor(F.col("number") / TILE)).over(Window.partitionBy("lang")),
        "stretch": F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / STRETCH)))})
    strips = every.join(own, ["lang", "source", "stretch"], "left").withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), "tiles"))).select(
        "lang", "stretch", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "tile", "number",
        "zero", F.least(F.lit(STRETCH), F.col("size") - F.col("stretch") * STRETCH).alias("width"),
        F.col("list.at").alias("ats"), F.col("list.p").alias("ps"))

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        lang, _, a, b = (x.as_py() for x in key)
        tile, number, zeros = (table.column(c).to_numpy() for c in ("tile", "number", "zero"))
        shares = np.repeat(zeros[:, None], table.column("width")[0].as_py(), axis=1)
        for line, (ats, ps) in enumerate(zip(table.column("ats").combine_chunks(), table.column("ps").combine_chunks())):
            if ats.is_valid:
                shares[line, ats.values.to_numpy()] = ps.values.to_numpy()
        left, right = np.flatnonzero(tile == a), np.flatnonzero(tile == b)
        found = [(number[i], number[j], int(np.abs(shares[i] - shares[right[at]]).sum()))
                 for i in left for at, j in enumerate(right) if a != b or number[i] < number[j]]
        one, two, apart = zip(*found) if found else ((), (), ())
        return pa.table({"lang": pa.array([lang] * len(found), pa.string()), "one": pa.array(one, pa.int32()),
                         "two": pa.array(two, pa.int32()), "apart": pa.array(apart, pa.int64())})

    met = strips.groupBy("lang", "stretch", "a", "b").applyInArrow(compare, "lang string, one int, two int, apart long")
    apart = met.groupBy("lang", "one", "two").agg(F.sum("apart").alias("value"))
    both = apart.unionByName(apart.select("lang", F.col("two").alias("one"), F.col("one").alias("two"), "value"))
    names = groups.select("lang", "number", "source")
    pairs = both.join(names.withColumnRenamed("number", "one"), ["lang", "one"]).join(
        names.select("lang", F.col("number").alias("two"), F.col("source").alias("item")), ["lang", "two"])
    # Without kept terms every two sources of a language are alike.
    blank = groups.where("size = 0").select("lang", "source")
    alike = blank.join(blank.withColumnRenamed("source", "item"), "lang").where("source <> item").withColumn("value", F.lit(0).cast("long"))
    rows = pairs.select("lang", "source", "item", "value").unionByName(alike.select("lang", "source", "item", "value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS line, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents),
words AS (SELECT line, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT line) >= 30),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS many FROM words JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
totals AS (SELECT lang, source, coalesce(sum(many), 0) AS total FROM groups LEFT JOIN counts USING (lang, source) GROUP BY ALL),
shares AS (
    SELECT lang, source, term, coalesce(many, 0) AS many,
           1 + (1000000000::HUGEINT * (coalesce(many, 0) + 5)) // (total + 5 * v) AS p
    FROM totals JOIN sizes USING (lang) JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
common AS (
    SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(many) + 5)) // (any_value(n) + 5 * any_value(v)) AS q
    FROM shares JOIN sizes USING (lang) JOIN (SELECT lang, sum(total) AS n FROM totals GROUP BY lang) USING (lang)
    GROUP BY lang, term),
pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, p - q FROM shares JOIN common USING (lang, term) WHERE many > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value,
       (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM every
QUALIFY part = 'pair' OR rank <= 50
"""
