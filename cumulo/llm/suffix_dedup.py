"""Repeated passages by a run-length index over the repetitive part of a corpus.

Removes every byte covered by a string of ``span`` bytes that also starts
earlier: in a smaller doc_id, or earlier in the same document.

1. Every string of ``span`` bytes has an anchor, the least of its hashed
   ``gram``-byte pieces; equal strings have equal anchors. Neighbouring strings
   share theirs, so a text falls into stretches, one for each anchor.
2. Anchors are counted over the whole corpus. Stretches whose anchor occurs once
   hold nothing that repeats. A Bloom filter of fixed size carries the repeated
   anchors to the texts; only their stretches are written out.
3. Equal stretches are one class. All but the first of a class go as a whole.
4. Different stretches with one anchor meet in an index, but for those that
   equal no other on either side of the anchor. The index sorts their
   suffixes, run-compresses the Burrows-Wheeler transform and samples the ends
   of its runs. Matching lengths are compared byte by byte at those samples
   only; all others follow by streaming along the text, one less at each step.
   Suffixes that match in ``span`` bytes or more are equal strings, of which all
   but the first go.

The stretches of an anchor with too many different ones are split into single
strings. These enter no index: the first place of each is an aggregate over
their hashes, so no task holds an unbounded group.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cumulo.llm.common import attach_groups, mark_members, stored, stored_table

SPAN = 100
GRAM = 32
#: Bytes whose anchors are found at once, of one text or several; their places take the low bits of a hash.
BLOCK = 1 << 15
PLACE_BITS = 17
#: 64-bit words of the filter of repeated anchors, at most: 16 MB.
FILTER_WORDS = 1 << 21
#: Different stretches of one anchor that may meet in one index.
GROUP = 5_000
#: Bytes of stretches in one index, about; its arrays stay in a core's cache.
INDEX_BYTES = 250_000

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x5851F42D4C957F2D
    up = np.full(count, base, np.uint64)
    up[0] = 1
    down = np.full(count, pow(base, -1, 1 << 64), np.uint64)
    down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Anchors:
    """Stretches of texts with their anchors, for one ``span`` and ``gram``."""

    def __init__(self, span: int = SPAN, gram: int = GRAM):
        self.span, self.gram, self.reach = span, gram, span - gram + 1
        self.up, self.down = _powers(2 * (BLOCK + span))

    def stretches(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
        """Blocks of (number of the text, first start, number of starts, anchor hash, place of the anchor after the start), in order."""
        held: list[tuple[int, int, bytes]] = []
        size = 0
        for k, data in enumerate(texts):
            for offset in range(0, len(data) - self.span + 1, BLOCK):
                piece = data[offset:offset + BLOCK + self.span - 1]
                held.append((k, offset, piece))
                size += len(piece)
                if size >= BLOCK:
                    yield self._block(held)
                    held, size = [], 0
        if held:
            yield self._block(held)

    def _block(self, held: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
        text, offset = (np.array(x, np.int64) for x in list(zip(*held))[:2])
        lengths = np.array([len(piece) for _, _, piece in held], np.int64)
        begins = np.cumsum(lengths) - lengths
        codes = np.frombuffer(b"".join(piece for _, _, piece in held), np.uint8).astype(np.uint64) + np.uint64(1)
        n = len(codes)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(codes * self.up[:n], dtype=np.uint64)])
        hashed = (sums[self.gram:] - sums[:-self.gram]) * self.down[:n - self.gram + 1]
        hashed ^= hashed >> np.uint64(32)
        hashed *= _ODD
        hashed ^= hashed >> np.uint64(29)
        low = np.uint64((1 << PLACE_BITS) - 1)
        least = (hashed & ~low) | np.arange(len(hashed), dtype=np.uint64)
        width = 1
        while 2 * width <= self.reach:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < self.reach:
            rest = self.reach - width
            least = np.minimum(least[:-rest], least[rest:])
        place = (least & low).astype(np.int64)
        edge = np.concatenate([[True], place[1:] != place[:-1]])
        edge[begins] = True
        ends = begins + lengths - self.span + 1  # starts from here on reach into the next piece
        edge[ends[ends < len(edge)]] = True
        first = np.flatnonzero(edge)
        many = np.diff(np.concatenate([first, [len(place)]]))
        own = np.searchsorted(begins, first, side="right") - 1
        inside = first < ends[own]
        first, many, own = first[inside], many[inside], own[inside]
        return text[own], first - begins[own] + offset[own], many, hashed[place[first]], place[first] - first


def _document(columns: list[str]) -> list[Column]:
    """Order of a row: doc_id, null last, then a hash of the text."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc"), F.xxhash64("text").alias("tie"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *columns]


def repeated_anchors(docs: DataFrame, span: int, gram: int) -> DataFrame:
    """Hashes of the anchors that more than one stretch of the corpus has."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(span, gram)
        for batch in batches:
            found = [block[3] for block in anchors.stretches([(t or "").encode() for t in batch.column(0).to_pylist()])]
            if not found:
                continue
            hashes, times = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(times, pa.int64())], names=["anchor", "times"])

    parts = docs.select(F.col("text").cast("string")).mapInArrow(counted, "anchor long, times long")
    return parts.groupBy("anchor").agg(F.sum("times").alias("times")).where("times > 1").select("anchor")


def _filter(anchors: DataFrame, most: int = FILTER_WORDS) -> np.ndarray:
    """Bloom filter of the anchors (stored): at most ``most`` words of two bits each, made by the cluster."""
    count, words = anchors.count(), 1024
    while words * 4 < count and words < most:
        words *= 2
    bit = lambda k: F.expr(f"shiftleft(1L, cast(shiftright(anchor, {k}) & 63 AS int))")
    rows = anchors.select((F.col("anchor").bitwiseAND(F.lit(words - 1))).alias("word"), bit(40).bitwiseOR(bit(50)).alias("bits"))
    rows = rows.groupBy("word").agg(F.bit_or("bits").alias("bits")).withColumn("block", F.shiftright("word", 12))

    def whole(block: pa.Table) -> pa.Table:
        table = np.zeros(4096, np.int64)
        table[block.column("word").to_numpy() & 4095] = block.column("bits").to_numpy()
        return pa.table({"block": block.column("block").slice(0, 1), "bits": pa.array([table.tobytes()], pa.binary())})

    table = np.zeros(-(-words // 4096) * 4096, np.int64)
    for row in rows.groupBy("block").applyInArrow(whole, "block long, bits binary").collect():
        table[row["block"] << 12:(row["block"] + 1) << 12] = np.frombuffer(row["bits"], np.int64)
    return table[:words]


def _may_repeat(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    own = hashes.view(np.int64)
    bits = (np.int64(1) << ((own >> 40) & 63)) | (np.int64(1) << ((own >> 50) & 63))
    return table[own & (len(table) - 1)] & bits == bits


def repeated_stretches(docs: DataFrame, table: np.ndarray, span: int, gram: int) -> DataFrame:
    """(anchor, digest, place, doc, tie, start, starts, content) of every stretch whose anchor may repeat.

    A stretch that its own document has had before goes as a whole; runs of
    these are rows without anchor, digest, place and content.
    """
    shared = docs.sparkSession.sparkContext.broadcast(table)
    names = ["anchor", "digest", "place", "doc", "tie", "start", "starts", "content"]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, bits = Anchors(span, gram), shared.value
        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            rows: list[tuple] = []
            texts = [text.encode() for text in batch.column(2).to_pylist()]
            seen: set[int] = set()
            at = low = high = -1  # the text, and its run of starts that go
            for which, first, many, hashes, places in anchors.stretches(texts):
                keep = np.flatnonzero(_may_repeat(hashes, bits))
                columns = (x[keep].tolist() for x in (which, hashes.view(np.int64), first, many, places))
                for k, name, a, m, place in zip(*columns):
                    if k != at:
                        if high > low:
                            rows.append((at, None, None, None, low, high - low, None))
                        at, low, high = k, -1, -1
                        seen.clear()
                    own = texts[k][a:a + m + span - 1]
                    known = xxhash.xxh3_64_intdigest(own) - (1 << 63)
                    if known not in seen:
                        seen.add(known)
                        rows.append((k, name, known, place, a, m, own))
                    elif a == high:
                        high += m
                    else:
                        if high > low:
                            rows.append((k, None, None, None, low, high - low, None))
                        low, high = a, a + m
            if high > low:
                rows.append((at, None, None, None, low, high - low, None))
            row, anchor, digest, place, start, starts, content = zip(*rows) if rows else ([],) * 7
            at = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor, pa.int64()), pa.array(digest, pa.int64()), pa.array(place, pa.int32()), batch.column(0).take(at),
                 batch.column(1).take(at), pa.array(start, pa.int64()), pa.array(starts, pa.int32()), pa.array(content, pa.binary())], names=names)

    return docs.select(*_document([])).mapInArrow(
        found, "anchor long, digest long, place int, doc long, tie long, start long, starts int, content binary")


def _ordered(key: np.ndarray, bits: int) -> np.ndarray:
    """Stable order of unsigned keys of so many bits; keys and places are sorted as one number where that fits."""
    place = np.uint64(len(key).bit_length())
    if bits + int(place) > 64:
        return np.argsort(key, kind="stable")
    packed = (key << place) | np.arange(len(key), dtype=np.uint64)
    packed.sort()
    return (packed & ((np.uint64(1) << place) - np.uint64(1))).astype(np.int64)


class RunLengthIndex:
    """Suffix order of some stretches, the run-compressed transform, and its sampled run ends."""

    def __init__(self, contents: list[bytes]):
        lengths = np.array([len(c) for c in contents], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        self.longest = int(lengths.max())
        # Every stretch ends with a symbol of its own, so no match crosses an end.
        symbols = np.frombuffer(b"\0".join(contents) + b"\0", np.uint8).astype(np.int64) + len(contents)
        symbols[self.begins + lengths] = np.arange(len(contents))
        self.symbols = symbols
        self.order = self._suffix_order(lengths)
        before = symbols[self.order - 1]  # the transform; the text counts as a circle
        self.run_starts = np.concatenate([[0], np.flatnonzero(np.diff(before)) + 1])
        self.run_symbols = before[self.run_starts]
        self.run_ends = self.order[np.concatenate([self.run_starts[1:] - 1, [len(before) - 1]])]

    def _suffix_order(self, lengths: np.ndarray) -> np.ndarray:
        """Order of all suffixes, by doubling the number of symbols that ranks stand for; an end counts by its place."""
        n = len(self.symbols)
        left = np.repeat(self.begins + lengths, lengths + 1) - np.arange(n)  # bytes up to the end of the stretch
        codes = np.where(left > 0, self.symbols - (len(lengths) - 1), 0).astype(np.uint64)
        # UTF-8 has no byte above 0xF4, so a code takes 8 bits.
        width = max(1, (64 - n.bit_length()) // 8)
        key = np.zeros(n, np.uint64)
        for k in range(min(width, n)):
            key <<= np.uint64(8)
            key[:n - k] |= np.where(left[:n - k] >= k, codes[k:], np.uint64(0))
        bits = 8 * width
        while True:
            order = _ordered(key, bits)
            if width > self.longest:
                return order
            ordered = key[order]
            rank = np.empty(n, np.uint64)
            rank[order] = np.cumsum(np.concatenate([[False], ordered[1:] != ordered[:-1]]))
            if rank[order[-1]] == n - 1:
                return order
            far = np.zeros(n, np.uint64)
            far[:max(0, n - width)] = np.where(left[:max(0, n - width)] >= width, rank[width:] + np.uint64(1), np.uint64(0))
            key = (rank << np.uint64(n.bit_length())) | far
            bits, width = 2 * n.bit_length(), 2 * width

    def matching_lengths(self) -> np.ndarray:
        """Symbols that each suffix shares with the one before it in order, by place in the text.

        Compared directly where a run starts; inside a run the suffix one place
        earlier in the text has the same neighbour, so its length is one more.
        """
        n, most = len(self.symbols), self.longest + 32
        here, above = self.order[self.run_starts], np.concatenate([[-1], self.run_ends[:-1]])
        length = np.zeros(len(here), np.int64)
        active = np.flatnonzero(above >= 0)
        padded = np.concatenate([self.symbols, np.full(most, -1)])
        other = np.concatenate([self.symbols, np.full(most, -2)])  # beyond the end nothing matches
        step = 8
        while len(active):
            a = here[active, None] + length[active, None] + np.arange(step)
            b = above[active, None] + length[active, None] + np.arange(step)
            same = padded[np.minimum(a, n + most - 1)] == other[np.minimum(b, n + most - 1)]
            run = np.where(same.all(axis=1), step, same.argmin(axis=1))
            length[active] += run
            active = active[run == step]
            step = 32
        streamed = np.full(n, -1, np.int64)
        streamed[here] = length + here
        return np.maximum(np.maximum.accumulate(streamed) - np.arange(n), 0)


def later_starts(contents: list[bytes], rank: np.ndarray, span: int) -> list[np.ndarray]:
    """For every stretch the starts of strings that an earlier stretch, or an earlier place, has too.

    ``rank`` is the order of the stretches in the corpus.
    """
    index = RunLengthIndex(contents)
    matched = index.matching_lengths()[index.order] >= span
    begins = index.begins
    owner = np.searchsorted(begins, index.order, side="right") - 1
    offset = index.order - begins[owner]
    ends = np.array([len(c) for c in contents], np.int64)
    whole = ends[owner] - offset >= span
    kind = np.cumsum(~matched)  # suffixes with one number start with the same string
    place = rank[owner] * (1 << 32) + offset
    some = np.flatnonzero(whole)
    sequence = some[np.lexsort((place[some], kind[some]))]
    first = np.concatenate([[True], kind[sequence][1:] != kind[sequence][:-1]])
    later = sequence[~first]
    by_owner = later[np.argsort(owner[later], kind="stable")]
    cuts = np.searchsorted(owner[by_owner], np.arange(len(contents) + 1))
    return [np.sort(offset[by_owner[cuts[k]:cuts[k + 1]]]) for k in range(len(contents))]


def _with_partner(rows: list[tuple], span: int, gram: int) -> list[tuple]:
    """The rows of one anchor that can share a string with another one.

    A string holds the anchor and at least half of its other bytes on one side
    of it, so two rows that share one are equal there.
    """
    half = (span - gram) // 2
    sides = [(c[p - half:p + gram] if p >= half else None, c[p:p + gram + half] if len(c) >= p + gram + half else None)
             for *_, p, c in rows]
    left, right = (Counter(x) for x in zip(*sides))
    return [r for r, (a, b) in zip(rows, sides) if (a is not None and left[a] > 1) or (b is not None and right[b] > 1)]


def _index_groups(batches: Iterator[pa.RecordBatch], span: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Runs of starts to remove, from stretches sorted by key; whole groups meet in indexes of bounded size."""
    names = ["doc", "tie", "a", "b"]

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        order = sorted(range(len(rows)), key=lambda k: rows[k][1:4])
        rank = np.empty(len(rows), np.int64)
        rank[order] = np.arange(len(rows))
        doc, tie, low, high = [], [], [], []
        for (_, d, t, start, _, _), gone in zip(rows, later_starts([r[-1] for r in rows], rank, span)):
            if len(gone):
                edge = np.flatnonzero(np.diff(gone) > 1)
                for a, b in zip(np.concatenate([[0], edge + 1]), np.concatenate([edge, [len(gone) - 1]])):
                    doc.append(d)
                    tie.append(t)
                    low.append(start + int(gone[a]))
                    high.append(start + int(gone[b]) + span)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, tie, low, high)], names=names)

    every = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    held: list[tuple] = []
    size = 0
    for _, group in groupby(every, key=lambda row: row[0]):
        # Repeated rows are one document, so each of its stretches counts once.
        rows = _with_partner(list({row[1:4]: row for row in group}.values()), span, gram)
        held += rows
        size += sum(len(r[-1]) for r in rows)
        if size >= INDEX_BYTES:
            yield flush(held)
            held, size = [], 0
    if held:
        yield flush(held)


def _split_large(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """The hash of every string of a stretch, with its place."""
    for batch in batches:
        anchor, key, doc, tie, start = [], [], [], [], []
        for name, d, t, s, c in zip(*(col.to_pylist() for col in batch.columns)):
            many = len(c) - span + 1
            key += [xxhash.xxh3_64_intdigest(c[k:k + span]) - (1 << 63) for k in range(many)]
            anchor += [name] * many
            doc += [d] * many
            tie += [t] * many
            start += range(s, s + many)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, pa.int64()) for x in (anchor, key, doc, tie, start)], names=["anchor", "key", "doc", "tie", "start"])


def _later_strings(large: DataFrame, span: int) -> DataFrame:
    """(doc, tie, a, b) of every string but the first of its kind, from (anchor, doc, tie, start, content) of stretches.

    Strings with one anchor and one hash are equal. The first place is a partial
    minimum in every task, and hot strings stay where they are.
    """
    strings = stored_table(large.mapInArrow(
        lambda batches: _split_large(batches, span), "anchor long, key long, doc long, tie long, start long"))
    same, place = ["anchor", "key"], F.struct("doc", "tie", "start")
    firsts = stored(strings.groupBy(*same).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("many")).where("many > 1"))
    return attach_groups(strings, firsts, same, "many", strings.count()).where(place != F.col("first")).select(
        "doc", "tie", F.col("start").alias("a"), (F.col("start") + span).alias("b"))


def removals(docs: DataFrame, span: int = SPAN, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """(doc, tie, a, b): byte ranges to remove, perhaps overlapping, of documents known by ``_document``."""
    anchors = stored(repeated_anchors(docs, span, gram))
    found = stored_table(repeated_stretches(docs, _filter(anchors), span, gram))
    stretches = found.where("anchor IS NOT NULL")
    again = found.where("anchor IS NULL")
    first, same = F.struct("doc", "tie", "start"), ["anchor", "digest"]
    classes = stored_table(stretches.groupBy(*same).agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("size")))
    narrow = stretches.select(*same, "doc", "tie", "start", "starts")
    several = classes.where("size > 1").select(*same, "first")
    copies = mark_members(narrow, several, F.xxhash64(*same), "possible").where("possible").join(several, same)
    whole = again.select("doc", "tie", "start", "starts").unionByName(
        copies.where(first != F.col("first")).select("doc", "tie", "start", "starts")).select(
        "doc", "tie", F.col("start").alias("a"), (F.col("start") + F.col("starts") + (span - 1)).alias("b"))
    groups = stored(classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1"))
    mixed = stored_table(attach_groups(classes, groups, ["anchor"], "classes", classes.count()).where("classes IS NOT NULL").select(
        *same, "first", "classes"))
    # The filter holds the classes' first places, so other copies seldom move with their content.
    firsts = mixed.select(*same, "classes", "first.*")
    wide = mark_members(stretches, firsts, F.xxhash64(*same, "doc", "tie", "start"), "possible").where("possible").join(
        firsts, [*same, "doc", "tie", "start"])
    columns = [F.col("anchor").alias("key"), "doc", "tie", "start", "place", "content"]
    met = wide.where(F.col("classes") <= group).select(*columns).repartition("key").sortWithinPartitions("key")
    removed = whole.unionByName(met.mapInArrow(lambda batches: _index_groups(batches, span, gram), "doc long, tie long, a long, b long"))
    if groups.where(F.col("classes") > group).isEmpty():
        return removed
    large = wide.where(F.col("classes") > group).select("anchor", "doc", "tie", "start", "content")
    return removed.unionByName(_later_strings(large, span))


def deduplicate(docs: DataFrame, span: int = SPAN, with_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_text).

    Null text counts as empty. Null doc_ids come after all others; rows with one
    doc_id and different texts are different documents in the order of a hash,
    and rows alike in both are one document and get the same result. Removed
    runs may cut a character; ``kept_text`` replaces what is left of it.
    """
    ranges = removals(docs, span)
    spans = stored(ranges.groupBy("doc", "tie").agg(F.collect_list(F.struct("a", "b")).alias("spans")))
    rows = docs.select(*_document(["doc_id"]))
    tested = mark_members(rows, spans, F.xxhash64("doc", "tie"), "possible")
    touched = tested.where("possible").join(spans, ["doc", "tie"], "left").select("doc_id", "text", "spans")
    clean = tested.where("NOT possible").select("doc_id", "text", F.lit(None).cast("array<struct<a:bigint,b:bigint>>").alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, gone, runs, digest, left = [], [], [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = text.encode()
                size.append(len(data))
                kept, at, count, removed = [], 0, 0, 0
                low = high = -1
                for span in sorted((s["a"], s["b"]) for s in spans or []) + [(len(data) + 1, len(data) + 1)]:
                    if span[0] > high:
                        if high > 0:
                            kept.append(data[at:low])
                            at = high
                            count += 1
                            removed += high - low
                        low, high = span
                    else:
                        high = max(high, span[1])
                kept.append(data[at:])
                data = b"".join(kept)
                gone.append(removed)
                runs.append(count)
                digest.append(hashlib.sha256(data).hexdigest())
                if with_text:
                    left.append(data.decode("utf-8", "replace"))
            columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in (size, gone, runs)), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(left, pa.string())] if with_text else []), names=names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text
    names = [c.split(" ")[0] for c in schema.split(", ")]
    return clean.unionByName(touched).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(cut, schema)
