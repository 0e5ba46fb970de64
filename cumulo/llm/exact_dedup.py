"""Exact duplicates by two passes over a Bloom filter, in DataFrame functions only.

Pass one sets, for every text, two bits inside one 64-bit word of the filter and
keeps the bits that were set twice. Pass two tests every text against those
bits. A text whose bits were set twice may be repeated: only such rows are
shuffled and grouped by their SHA-256. All other rows are certainly unique and
pass straight through, with no shuffle.

The filter has 16 bits per row up to ``MAX_WORDS`` words, so what is broadcast
has a fixed bound. Beyond that size more unique rows are tested exactly, which
costs time and never changes the result; raise ``max_words`` with the memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cumulo.llm.common import OWN, attach_groups, stored

#: 4 M words of 64 bits: 32 MB of bits.
MAX_WORDS = 1 << 22


def text_sha256(text: Column) -> Column:
    """Lowercase hex SHA-256 of the unchanged text in UTF-8; null counts as empty."""
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256)


def filter_words(rows: int, max_words: int = MAX_WORDS) -> int:
    words = 1
    while words * 4 < rows and words < max_words:
        words *= 2
    return words


def _place(sha: Column, words: int) -> list[Column]:
    """Word of the filter and the two bits in it."""
    digest = F.xxhash64(sha)
    return [
        F.pmod(digest, F.lit(words)).alias(OWN + "word"),
        F.shiftright(digest, 40).bitwiseAND(F.lit(63)).cast("int").alias(OWN + "bit_a"),
        F.shiftright(digest, 50).bitwiseAND(F.lit(63)).cast("int").alias(OWN + "bit_b"),
    ]


def repeated_bits(hashes: DataFrame, sha: str, words: int) -> DataFrame:
    """Pass one: (word, bits that at least two rows set). At most ``words`` rows."""
    word, bit = OWN + "word", OWN + "bit"
    places = hashes.select(*_place(F.col(sha), words))
    return (
        places.select(word, F.explode(F.array_distinct(F.array(OWN + "bit_a", OWN + "bit_b"))).alias(bit))
        .groupBy(word, bit).count().where("count > 1")
        .groupBy(word).agg(F.bit_or(F.expr(f"shiftleft(1L, {bit})")).alias(OWN + "bits"))
    )


def mark_possible(rows: DataFrame, sha: str, bits: DataFrame, words: int, flag: str) -> DataFrame:
    """Pass two: ``flag`` is false only where the text certainly occurs once."""
    placed = rows.select("*", *_place(F.col(sha), words)).join(F.broadcast(bits), OWN + "word", "left")
    both = F.expr(f"getbit({OWN}bits, {OWN}bit_a) = 1 AND getbit({OWN}bits, {OWN}bit_b) = 1")
    return placed.withColumn(flag, F.coalesce(both, F.lit(False))).drop(
        OWN + "word", OWN + "bit_a", OWN + "bit_b", OWN + "bits")


def decisions(docs: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty. Of equal texts the row
    with the largest doc_id stays (null ids come last in that choice). Rows
    repeated with the same id and text: exactly one of them stays. An empty table
    gives no rows; other columns are ignored.
    """
    keyed = stored(docs.select(
        "doc_id", text_sha256(F.col("text")).alias("text_sha256"), F.monotonically_increasing_id().alias("row")))
    total = keyed.count()
    words = filter_words(total, max_words)
    flagged = mark_possible(keyed, "text_sha256", repeated_bits(keyed, "text_sha256", words), words, "possible")
    single = flagged.where("NOT possible").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256")
    possible = flagged.where("possible").drop("possible")
    groups = stored(possible.groupBy("text_sha256").agg(
        F.max(F.struct("doc_id", "row")).alias("best"), F.count(F.lit(1)).alias("group_size")))
    grouped = attach_groups(possible, groups, ["text_sha256"], "group_size", total).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256")
    return single.unionByName(grouped)


def deduplicate(docs: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """The rows that stay, with the columns of the input.

    Unique texts are not shuffled. Copies are reduced to one row inside each task
    before they move; rows that tie in doc_id too are told apart by their content.
    """
    sha, flag, columns = OWN + "sha", OWN + "possible", docs.columns
    hashed = docs.withColumn(sha, text_sha256(F.col("text")))
    hashes = stored(hashed.select(sha))
    words = filter_words(hashes.count(), max_words)
    bits = stored(repeated_bits(hashes, sha, words))
    flagged = mark_possible(hashed, sha, bits, words, flag)
    single = flagged.where(~F.col(flag)).select(*columns)
    order = F.struct(F.col("doc_id"), F.xxhash64(*columns))
    chosen = flagged.where(flag).groupBy(sha).agg(F.max_by(F.struct(*columns), order).alias("row"))
    return single.unionByName(chosen.select("row.*"))


SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
