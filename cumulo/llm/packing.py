"""Best-fit packing of documents into sequences, with certified bounds and repacking.

Documents become token pieces; a piece that fills a sequence stands alone. The
others are dealt over partitions of bounded size and packed best-fit decreasing
inside each. Lower bounds from dual-feasible functions certify the partitions
whose count can't be improved. The rest hand in the documents of every sequence
that has a gap; these meet in fewer, newly dealt partitions and are packed again,
as long as that saves sequences.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cumulo.llm.common import OWN, stored
from cumulo.llm.token_counts import PATTERN, byte_letters

#: Rows packed by one task.
PART_ROWS = 100_000
ROUNDS = 4
#: Above this many characters the vocabulary's own library encodes, whose splitter has no depth limit.
LONG_TEXT = 200_000


@lru_cache(maxsize=2)
def encoder(path: str):
    """Encoding function of a byte-level BPE file: text to little-endian 32-bit ids.

    The ranks of such a file are its ids, so the faster of the two installed
    libraries gives the ids of the other; tests hold them against each other.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    letters = byte_letters()
    special = {t["content"]: t["id"] for t in content["added_tokens"] if t["special"]}
    ranks = {bytes(letters[c] for c in token): number for token, number in content["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("ids", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    plain = Tokenizer.from_file(path)

    def encode(text: str) -> np.ndarray:
        if len(text) > LONG_TEXT:
            return np.array(plain.encode(text, add_special_tokens=False).ids, "<u4")
        return fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)

    return encode


def token_pieces(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: doc_id, piece, start, length, ids_crc32 (and ids).

    A document is its ids and ``end_id``; null text is the end alone. Longer
    documents are cut so that only the first piece is shorter.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        end = np.array([end_id], "<u4")
        for batch in batches:
            row, piece, start, length, crc, kept = [], [], [], [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                ids = np.concatenate([encode(text), end]) if text else end
                data, total = ids.tobytes(), len(ids)
                edges = [0, *range(total % capacity or capacity, total + 1, capacity)] if total > capacity else [0, total]
                for number, (a, b) in enumerate(zip(edges, edges[1:])):
                    row.append(k)
                    piece.append(number)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(data[4 * a:4 * b]))
                    if keep_ids:
                        kept.append(ids[a:b].astype(np.int64))
            columns = [batch.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()),
                       pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if keep_ids:
                columns.append(pa.array(kept, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if keep_ids else "")
    names = [c.split(" ")[0] for c in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, schema)


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Sequences that ``sizes`` need at least: the best of two families of dual-feasible functions.

    One rounds sizes above ``capacity - e`` up to whole and drops those below
    ``e``; the other steps sizes to multiples of 1/k. Their compositions are
    dual-feasible too. Sums are exact integers.
    """
    many = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((many * size).sum()) // capacity)
    for e in range(0, capacity // 2 + 1):
        whole, gone = size > capacity - e, size < e
        stepped = np.where(whole, capacity, np.where(gone, 0, size))
        best = max(best, -(-int((many * stepped).sum()) // capacity))
        if e % 16:
            continue
        for k in range(1, 12):
            scaled = stepped * (k + 1)
            value = np.where(scaled % capacity == 0, stepped * k, scaled // capacity * capacity)  # times k * capacity
            best = max(best, -(-int((many * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence and offset of each size, and the room left in each sequence."""
    bins = np.zeros(len(sizes), np.int64)
    offsets = np.zeros(len(sizes), np.int64)
    room: list[int] = []
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]  # sequences by the room they have
    some = 0  # bit r: a sequence with room r waits
    order = np.argsort(-sizes, kind="stable")
    for item, size in zip(order.tolist(), sizes[order].tolist()):
        fitting = some >> size
        if fitting:
            left = size + (fitting & -fitting).bit_length() - 1
            stack = waiting[left]
            chosen = stack.pop()
            if not stack:
                some &= ~(1 << left)
        else:
            left, chosen = capacity, len(room)
            room.append(capacity)
        bins[item], offsets[item] = chosen, capacity - left
        left -= size
        room[chosen] = left
        if left:
            waiting[left].append(chosen)
            some |= 1 << left
    return bins, offsets, np.array(room, np.int64)


def _pack_parts(items: DataFrame, capacity: int, parts: int, turn: int) -> DataFrame:
    """One round: deal, pack each partition, and tell which documents may move on (``open``)."""
    schema = items.schema

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = [b for b in batches if b.num_rows]
        if not given:
            return
        table = pa.Table.from_batches(given)
        sizes = table.column("length").to_numpy()
        bins, offsets, room = best_fit_decreasing(sizes, capacity)
        certified = len(room) == lower_bound(sizes, capacity)
        base = ((turn << 24) + TaskContext.get().partitionId()) << 31
        table = table.append_column("sequence_id", pa.array(-1 - (base + bins)))
        table = table.append_column("offset", pa.array(offsets))
        table = table.append_column("open", pa.array((room[bins] > 0) & (not certified)))
        yield from table.to_batches()

    dealt = items.repartition(parts, F.xxhash64(F.lit(turn), OWN + "row"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return stored(dealt.mapInArrow(packed, ddl + ", sequence_id long, offset long, open boolean"))


def pack(pieces: DataFrame, capacity: int = 1024, part_rows: int = PART_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length`` of 1 to ``capacity``; gapless from offset 0.

    Repeated rows are packed each for itself. No rows give no rows.
    """
    columns = pieces.columns
    rows = stored(pieces.withColumn(OWN + "row", F.monotonically_increasing_id()))
    full = rows.where(F.col("length") == capacity).select(
        *columns, F.col(OWN + "row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    items = rows.where(F.col("length") != capacity)
    done, best, best_bins = [full], None, 0
    for turn in range(rounds):
        parts = max(1, -(-items.count() // part_rows))
        trial = _pack_parts(items, capacity, parts, turn)
        if best is not None:
            if trial.select("sequence_id").distinct().count() >= best_bins:
                break
            done.append(best.where("NOT open"))
        best, best_bins = trial, trial.where("open").select("sequence_id").distinct().count()
        if best_bins < 2 or parts == 1:
            break
        items = trial.where("open").drop("sequence_id", "offset", "open")
    whole = best.select(*columns, "sequence_id", "offset")
    for frame in done:
        whole = whole.unionByName(frame.select(*columns, "sequence_id", "offset"))
    return whole


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row of ``docs``."""
    return pack(token_pieces(docs, path, capacity, end_id), capacity)
