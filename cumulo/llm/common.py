"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cumulo.session import cut_lineage, ensure_checkpoint_dir

#: A group with more than 1/HOT_PARTS of all rows is hot, so there are fewer than HOT_PARTS hot groups.
HOT_PARTS = 256
#: Per-group tables up to this many rows are sent to every executor.
SMALL_ROWS = 20_000
#: Rows of a narrow table (ids and numbers) that one task takes, about, where they are counted.
TASK_ROWS = 20_000
#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Prefix of the working columns that wide operators add, so that they clash with no column of the input.
OWN = "__llm_"


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def crc32_remainder(column: str, modulus: int) -> Column:
    """crc32 of an id written as text, modulo ``modulus``; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def attach_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Left join of ``rows`` with one row per group, without moving the rows of hot groups.

    ``groups`` must be stored (checkpointed). A table of at most SMALL_ROWS groups
    is broadcast. Beyond that only the groups with more than 1/HOT_PARTS of
    ``total`` rows are, which are fewer than HOT_PARTS; the other rows join by shuffle.
    """
    if counted(groups) <= SMALL_ROWS:
        return rows.join(F.broadcast(groups), keys, "left")
    mark = OWN + "hot"
    hot = groups.where(F.col(size) * HOT_PARTS > total).withColumn(mark, F.lit(True))
    cold = groups.where(F.col(size) * HOT_PARTS <= total)
    extra = [c for c in groups.columns if c not in keys]
    tried = rows.join(F.broadcast(hot), keys, "left")
    done = tried.where(mark).drop(mark)
    rest = tried.where(F.col(mark).isNull()).drop(mark, *extra).join(cold, keys, "left")
    return done.unionByName(rest)


def stored(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    return cut_lineage(df)


def few_tasks(rows: DataFrame, total: int) -> DataFrame:
    """A narrow frame of about ``total`` rows in no more tasks than these ask for.

    Each task that writes to a shuffle or a checkpoint leaves several files, so hundreds of
    tasks for a few rows take more disk than the rows. Large frames keep all their tasks.
    """
    return rows.coalesce(max(1, -(-total // TASK_ROWS)))


def counted(df: DataFrame) -> int:
    """Rows of a stored frame, counted by as many tasks as there are cores and not one for each stored part."""
    return df.coalesce(max(1, df.sparkSession.sparkContext.defaultParallelism)).count()


def stored_table(df: DataFrame) -> DataFrame:
    """Like ``stored``, as a compressed table beside the checkpoints: for large rows that resemble their neighbours."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _bits(hashed: Column, words: int) -> tuple[Column, Column]:
    """Word of a member filter and the two bits that stand for a hash in it."""
    pair = [F.shiftright(hashed, k).bitwiseAND(F.lit(63)).cast("int") for k in (40, 50)]
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), pair[0]).bitwiseOR(
        F.call_function("shiftleft", F.lit(1).cast("long"), pair[1]))
    return F.pmod(hashed, F.lit(words)), mask


def mark_members(rows: DataFrame, keys: DataFrame, hashed: Column, flag: str, max_words: int = 1 << 22) -> DataFrame:
    """Adds ``flag``: false only where a row's hash is certainly none of ``keys`` (stored), for which ``hashed`` also holds.

    What is broadcast is a Bloom filter of at most ``max_words`` 64-bit words. It
    spares rows a shuffle; an exact join decides about those it lets through.
    """
    count, words = counted(keys), 1024
    while words * 4 < count and words < max_words:
        words *= 2
    word, mask = _bits(hashed, words)
    names = [OWN + "word", OWN + "mask", OWN + "bits"]
    bits = keys.select(word.alias(names[0]), mask.alias(names[1])).groupBy(names[0]).agg(F.bit_or(names[1]).alias(names[2]))
    tried = rows.withColumns({names[0]: word, names[1]: mask}).join(F.broadcast(bits), names[0], "left")
    hit = F.col(names[2]).bitwiseAND(F.col(names[1])) == F.col(names[1])
    return tried.withColumn(flag, F.coalesce(hit, F.lit(False))).drop(*names)
