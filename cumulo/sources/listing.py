"""Folders of many files, written, listed and read by tasks.

Spark's readers hold every file below a folder, with its path and its places, in the
driver, and its writers hold every folder. On a file system that all tasks can open as
such (``file``) tasks put files in place and walk folders instead, and files are read by
splits of bounded size; the driver sees counts only. Other file systems, file names and
patterns are left to Spark's readers and writers.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cumulo.session import cut_lineage

#: Files or folders of a task, about, bytes of a split at most, and bytes that a task hands on at once.
TASK_FILES, SPLIT_BYTES, HANDED_BYTES = 1_024, 16 << 20, 1 << 20
#: Suffixes by which Spark's readers unpack a file.
PACKED = r"\.(gz|bz2|deflate|lz4|snappy|zst|zstd|xz)$"
BYTE_ORDER_MARK = b"\xef\xbb\xbf"


def local_path(spark: SparkSession, path: str) -> str | None:
    """The path as tasks can open it by themselves."""
    named = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = named.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(named).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def _hidden(name: str) -> bool:
    """Names that Spark's readers pass over."""
    if name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _name_rule(glob: str) -> str | None:
    """A glob of ``*``, ``?`` and ``[...]`` as a regular expression; NULL for others."""
    if re.search(r"[{}\\]|\[[^]]*\[|^\[\]|\[[!^]?\]", glob):
        return None
    parts = re.findall(r"\[[^]]*\]|.", glob)
    fixed = {"*": ".*", "?": "."}
    return "".join(p.replace("[!", "[^") if len(p) > 1 else fixed.get(p, re.escape(p)) for p in parts)


def _tasks(spark: SparkSession, wanted: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), wanted)


def walked_files(spark: SparkSession, root: str, glob: str) -> DataFrame | None:
    """(mesh_id, path, length) of every file below ``root``, stored; nothing if Spark's readers have to find them.

    ``mesh_id`` is the path below the root. Folders are listed level by level, those of a level by tasks.
    """
    folder, rule = local_path(spark, root), _name_rule(glob)
    if folder is None or rule is None or not os.path.isdir(folder):
        return None
    fits = re.compile(rule, re.DOTALL)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for below in batch.column(0).to_pylist():
                found = []
                with os.scandir(os.path.join(folder, below)) as listed:
                    for entry in listed:
                        if _hidden(entry.name):
                            continue
                        name = f"{below}/{entry.name}" if below else entry.name
                        if entry.is_dir():
                            found.append((name, None))
                        elif fits.fullmatch(entry.name):
                            found.append((name, entry.stat().st_size))
                        if len(found) == 8_192:
                            yield packed(found)
                            found = []
                if found:
                    yield packed(found)

    def packed(found: list[tuple[str, int | None]]) -> pa.RecordBatch:
        names, sizes = zip(*found)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=["mesh_id", "length"])

    level = spark.createDataFrame([("",)], "mesh_id string")
    files = None
    while True:
        listed = cut_lineage(level.mapInArrow(entries, "mesh_id string, length long"))
        own = listed.filter("length IS NOT NULL")
        files = own if files is None else files.unionByName(own)
        level = listed.filter("length IS NULL").select("mesh_id")
        folders = level.count()
        if not folders:
            return files.select("mesh_id", F.concat(F.lit(folder.rstrip("/") + "/"), "mesh_id").alias("path"), "length")
        level = level.repartition(_tasks(spark, -(-folders // TASK_FILES)), "mesh_id")


def is_packed(files: DataFrame) -> bool:
    return not files.filter(F.col("path").rlike(PACKED)).isEmpty()


def _split_lines(path: str, start: int, end: int) -> list[bytes]:
    """The lines that begin in ``start .. end - 1``; a line ends with ``\\n``, ``\\r`` or both, or with the file."""
    with open(path, "rb") as file:
        file.seek(max(start - 1, 0))
        before = file.read(1) if start else b"\n"
        data = file.read(end - start)
        if before == b"\r" and data[:1] == b"\n":
            data, before = data[1:], b"\n"
        if before not in b"\r\n":
            first = re.search(rb"\r\n?|\n", data)
            # A line that begins before goes on to the end of this split and beyond.
            if first is None:
                return []
            data = data[first.end():]
        if not data:
            return []
        while data[-1:] not in (b"\r", b"\n"):
            more = file.read(65_536)
            if not more:
                break
            last = re.search(rb"[\r\n]", more)
            data += more if last is None else more[:last.end()]
    if start == 0:
        data = data.removeprefix(BYTE_ORDER_MARK)
    lines = data.replace(b"\r\n", b"\n").replace(b"\r", b"\n").split(b"\n")
    return lines if lines[-1] else lines[:-1]


def split_lines(files: DataFrame) -> DataFrame:
    """(mesh_id, block, number, value): all lines of ``files`` by splits; ``number`` counts from 1 inside the split that begins at ``block``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for mesh, path, block, end in zip(*(c.to_pylist() for c in batch.columns)):
                lines = _split_lines(path, block, end)
                for at in range(0, len(lines), 65_536):
                    held.append((mesh, block, at, lines[at:at + 65_536]))
                    size += sum(map(len, held[-1][3])) + 16 * len(held[-1][3])
                    if size >= HANDED_BYTES:
                        yield packed(held)
                        held, size = [], 0
            if held:
                yield packed(held)

    def packed(held: list[tuple[str, int, int, list[bytes]]]) -> pa.RecordBatch:
        counts = [len(h[3]) for h in held]
        of = pa.array(np.repeat(np.arange(len(held)), counts))
        numbers = np.concatenate([np.arange(h[2] + 1, h[2] + 1 + n) for h, n in zip(held, counts)])
        return pa.RecordBatch.from_arrays(
            [pa.array([h[0] for h in held], pa.string()).take(of), pa.array([h[1] for h in held], pa.int64()).take(of),
             pa.array(numbers, pa.int64()), pa.array([line for h in held for line in h[3]], pa.binary())],
            names=["mesh_id", "block", "number", "value"])

    spark = files.sparkSession
    width = min(SPLIT_BYTES, spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    count, total = files.agg(F.count(F.lit(1)), F.sum("length")).first()
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(width).cast("long"))).alias("block")
    splits = files.filter("length > 0").select("mesh_id", "path", "length", block).select(
        "mesh_id", "path", "block", F.least(F.col("block") + width, F.col("length")).alias("end"))
    tasks = _tasks(spark, max(-(-count // TASK_FILES), -(-(total or 0) // width)))
    lines = splits.repartition(tasks, "mesh_id", "block").mapInArrow(read, "mesh_id string, block long, number long, value binary")
    return lines.withColumn("value", F.col("value").cast("string"))


def write_texts(lines: DataFrame, key: str, order: list[str], tasks: int, path: str) -> None:
    """One text file per value of ``key``, as ``path/<key>=<value>/part-*``, of the column ``value`` by ``order``.

    A task gets all rows of its keys, one key after the other. It puts a file in place when it is whole,
    under the same name on every attempt.
    """
    # Dealt by a hash of the key: by the key itself the planner may take a union of frames as dealt already,
    # whose parts adaptive execution then joins each in its own way.
    lines = lines.repartition(tasks, F.xxhash64(key)).sortWithinPartitions(key, *order)
    folder = local_path(lines.sparkSession, path)
    if folder is None:
        # By the first version of the committer the driver would move all files, one after the other.
        lines.select(key, "value").write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(key).text(path)
        return

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name, attempt = f"part-{task.partitionId():05d}", task.taskAttemptId()
        now, file, count = (), None, 0

        def finish() -> None:
            if file is not None:
                file.close()
                os.replace(file.name, os.path.join(os.path.dirname(file.name), name))

        for batch in batches:
            keys, values = batch.column(0), batch.column(1).to_pylist()
            runs = keys.to_pylist()
            at = 0
            while at < len(runs):
                end = at + 1
                while end < len(runs) and runs[end] == runs[at]:
                    end += 1
                if now != (runs[at],):
                    finish()
                    now, count = (runs[at],), count + 1
                    value = "__HIVE_DEFAULT_PARTITION__" if runs[at] is None else quote(runs[at], safe=" +,;@&!$()~`|<>")
                    os.makedirs(place := os.path.join(folder, f"{key}={value}"), exist_ok=True)
                    file = open(os.path.join(place, f".{name}-{attempt}"), "w", encoding="utf-8", newline="")
                file.writelines(f"{value}\n" for value in values[at:end])
                at = end
        finish()
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64())], names=["files"])

    os.makedirs(folder, exist_ok=True)
    lines.select(F.col(key).cast("string"), F.coalesce("value", F.lit(""))).mapInArrow(write, "files long").agg(F.sum("files")).first()
