"""Rows that every operator must take: nulls, empties, long texts, ties, repeats, extra columns."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Names that the operators use for themselves.
    T.StructField("row", T.IntegerType()), T.StructField("size", T.StringType()), T.StructField("key", T.StringType()),
    T.StructField("digest", T.StringType()), T.StructField("spans", T.IntegerType()), T.StructField("score", T.DoubleType()),
    T.StructField("hash", T.LongType()), T.StructField("tie", T.LongType()), T.StructField("length", T.IntegerType()),
])


def words(seed, count, pool=400):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(pool)}" for _ in range(count))


def frame(spark, rows):
    """rows: (doc_id, text, source)."""
    filled = [(i, t, "en", s, None if t is None else len(t), 1, "s", "k", "d", 3, 0.5, 7, 8, 9) for i, t, s in rows]
    return spark.createDataFrame(filled, SCHEMA).repartition(3)


def messy_rows():
    near = words(5, 80)
    return [
        (1, words(1, 60), "a"), (2, None, "a"), (3, "", "b"), (4, " \t\n ", "b"), (None, words(4, 60), None), (None, None, None),
        (5, near, "c"), (6, near, "c"), (7, near + " tail", "c"), (8, near.upper(), None), (9, "one two", "a"), (10, "one two", "b"),
        (11, words(11, 20_000, 50_000), "a"), (12, "x" * 30_000, "a"), (13, "ñandú çà ß 日本語 😀", "d"), (14, "<|endoftext|> a", "d"),
        (15, words(15, 60), "e"), (15, words(15, 60), "e"), (15, words(16, 60), "e"), (16, "é" * 150, "e"), (17, "ab" * 400, "e"),
    ]


def messy(spark):
    return frame(spark, messy_rows())


def empty(spark):
    return frame(spark, [])


def counted(rows):
    found = {}
    for row in rows:
        found[row] = found.get(row, 0) + 1
    return found
