"""Token counts of a byte-level BPE vocabulary, by merging with a heap and a linked list.

A piece of text starts as a chain of byte symbols. The heap holds the ranks of
adjacent pairs; the lowest is popped, its two symbols become one, and the pairs
with the new neighbours are pushed. The count of a piece is its initial number
of symbols minus the merges made; no token ids are built.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the public pattern that splits text before this vocabulary's merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words, and pieces, remembered per worker; a memo is emptied when it is full.
MEMO = 700_000
#: Longer pieces are counted anew each time.
MEMO_CHARS = 64


def byte_letters() -> dict[str, int]:
    """The letter by which a vocabulary file writes each byte: itself if visible in Latin-1, else 256 and on."""
    shown = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class PairMerger(dict):
    """Memo of word -> number of tokens of a space and the word, over the merges of one vocabulary file."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        self.special = [t["content"] for t in content.get("added_tokens", []) if t.get("special")]
        numbers: dict[str, int] = {}
        number = lambda letters: numbers.setdefault(letters, len(numbers))
        letters = byte_letters()
        self.first = [number(c) for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        merges = [m.split(" ") if isinstance(m, str) else m for m in content["model"]["merges"]]
        self.width = 1 << 20
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, (left, right) in enumerate(merges):
            self.merges.setdefault(number(left) * self.width + number(right), (rank, number(left + right)))
        self.find = regex.compile(PATTERN).findall
        self.wide = regex.compile(r" (\s|$)").search
        self.known: dict[str, int] = {}

    def merged_count(self, data: bytes) -> int:
        """Tokens of one piece given as UTF-8."""
        size = len(data)
        if size < 2:
            return size
        merges, width = self.merges, self.width
        symbols = [self.first[b] for b in data]
        after = list(range(1, size + 1))
        before = list(range(-1, size - 1))
        heap = []
        left = symbols[0]
        for place in range(size - 1):
            right = symbols[place + 1]
            found = merges.get(left * width + right)
            if found:
                heap.append(found[0] * size + place)
            left = right
        heapify(heap)
        count = size
        while heap:
            entry = heappop(heap)
            place = entry % size
            left = symbols[place]
            if left < 0:
                continue
            other = after[place]
            if other == size:
                continue
            found = merges.get(left * width + symbols[other])
            if not found or found[0] != entry // size:
                continue  # one of the two has changed since
            count -= 1
            made = symbols[place] = found[1]
            symbols[other] = -1
            far = after[place] = after[other]
            if far < size:
                before[far] = place
                found = merges.get(made * width + symbols[far])
                if found:
                    heappush(heap, found[0] * size + place)
            near = before[place]
            if near >= 0:
                found = merges.get(symbols[near] * width + made)
                if found:
                    heappush(heap, found[0] * size + near)
        return count

    def piece_count(self, piece: str) -> int:
        count = self.known.get(piece)
        if count is None:
            count = self.merged_count(piece.encode())
            if len(piece) <= MEMO_CHARS:
                if len(self.known) >= MEMO:
                    self.known.clear()
                self.known[piece] = count
        return count

    def __missing__(self, word: str) -> int:
        """Tokens of a space and ``word``, which starts with no white space."""
        count = sum(map(self.piece_count, self.find(" " + word)))
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[word] = count
        return count

    def count(self, text: str) -> int:
        """Tokens of a text; a special string inside it is one token.

        A space before anything but white space always starts a piece, so texts
        without double white space fall apart at their spaces.
        """
        for mark in self.special:
            if mark in text:
                parts = text.split(mark)
                return len(parts) - 1 + sum(map(self.count, parts))
        if self.wide(text):
            return sum(map(self.piece_count, self.find(text)))
        first, *words = text.split(" ")
        return sum(map(self.piece_count, self.find(first))) + sum(map(self.__getitem__, words))


@lru_cache(maxsize=2)
def merger(path: str) -> PairMerger:
    """One merger per worker process and file, kept between tasks."""
    return PairMerger(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    Null counts as empty: 0 bytes, 0 tokens. Texts of any length are counted
    whole. Repeated rows give repeated rows; other columns are ignored.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = merger(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens = [own.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long").withColumn(
        "over_limit", F.col("n_tokens") > limit)
