"""Near-duplicate texts by an LSH forest of MinHash signatures, confirmed on full shingle sets.

Every distinct shingle set gets one signature per tree, and each tree is the order
of its signatures. Signatures with a common prefix are a region; its depth adapts:
a region starts at ``SHALLOW`` common values, and where it holds more than ``bound``
signatures it falls into the regions of the next value, down to the full depth.

Two rounds keep the work small. The first confirms the neighbours by longest common
prefix in the orders of four trees. The second compares the signatures of every
region, but only between different components, as other links change nothing. A
comparison that leaves few pairs for each member sends them on to be confirmed
on the full sets; one that leaves more gets the full sets instead, counts all
intersections by matrix products, and sends on a spanning forest of the links. So
rows grow with the members of a region, not with its pairs. Regions that are large
at full depth meet by parts, and no pair of them is left out.

Equal sets are one row throughout, so copies are never paired. Full sets are
computed again for candidates only; whole texts are not shuffled.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cumulo.llm.common import OWN, attach_groups, counted, mark_members, stored
from cumulo.llm.graph import components

WORDS = 5
TREES = 24
DEPTH = 4
#: Values in which the signatures of the widest regions agree.
SHALLOW = 2
#: A region with more signatures is deepened; at full depth it is cut into parts, all of which meet.
REGION = 2000
#: Shingles of one part, about.
PART_SHINGLES = 1 << 21
#: Pairs that a meeting sends on for each member, at most; beyond that it gets the full sets.
FEW = 4
#: Shingles that one matrix product takes.
COLUMNS = 2048
#: Chance that a pair of similarity 0.75 shares fewer values than the second round asks for.
MISSED = 1e-9
#: Bytes of full sets in one block, about, and pairs that two blocks confirm in one task, about.
BLOCK_BYTES = 16 << 20
BLOCK_PAIRS = 500_000
MEMO = 400_000

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


class WordHashes(dict):
    """Memo of word -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | None, memo: dict, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``words`` words; of all words where there are fewer."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    if len(tokens) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(tokens), seed=len(tokens))], np.uint64)
    own = np.fromiter(map(memo.__getitem__, tokens), np.uint64, len(tokens))
    size = len(own) - words + 1
    mixed = np.zeros(size, np.uint64)
    for k in range(words):
        mixed = (mixed + own[k:k + size]) * _MIX[0]
        mixed ^= mixed >> np.uint64(29)
    mixed = (mixed ^ (mixed >> np.uint64(30))) * _MIX[1]
    mixed = (mixed ^ (mixed >> np.uint64(27))) * _MIX[2]
    return np.unique(mixed ^ (mixed >> np.uint64(31)))


def multipliers(count: int) -> np.ndarray:
    return (np.random.default_rng(11).integers(1, 1 << 63, count, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def signature(shingles: np.ndarray, factors: np.ndarray) -> bytes:
    """High 32 bits of the least product with each factor, big-endian."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        least = np.minimum(least, (factors[:, None] * shingles[None, at:at + 2048]).min(axis=1))
    return (least >> np.uint64(32)).astype(">u4").tobytes()


def _digest(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def describe(docs: DataFrame, words: int = WORDS, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """(doc_id, tie, n_shingles, digest, signature) of every row; digest and signature are null for empty sets."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, factors = WordHashes(), multipliers(trees * depth)
        for batch in batches:
            size, digest, signed = [], [], []
            for text in batch.column(2).to_pylist():
                shingles = shingle_set(text, memo, words)
                size.append(len(shingles))
                digest.append(_digest(shingles))
                signed.append(signature(shingles, factors) if len(shingles) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(signed, pa.binary())],
                names=["doc_id", "tie", "n_shingles", "digest", "signature"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tie"), F.col("text").cast("string"))
    return rows.mapInArrow(convert, "doc_id long, tie long, n_shingles long, digest binary, signature binary")


def _regions(classes: DataFrame, trees: int, depth: int, bound: int) -> DataFrame:
    """(tree, region, depth, size, weight, node, n, key): signatures with a common prefix, as deep as the region's size asks for.

    Two signatures that agree in all values of a tree are in one of its regions.
    """
    width = 4 * depth
    rows = classes.select("node", "n", "signature", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).select(
        "node", "n", "tree", F.substring("signature", F.col("tree") * width + 1, F.lit(width)).alias("key"))
    total, done = counted(classes) * trees, []
    for level in range(min(SHALLOW, depth), depth + 1):
        # A region goes by its hash; two that share one would only be compared in vain.
        named = rows.withColumn("region", F.xxhash64("tree", F.substring("key", 1, 4 * level)))
        sizes = stored(named.groupBy("region").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight")).where("size > 1"))
        # Most signatures are alone; a filter keeps them from moving.
        likely = mark_members(named, sizes, F.xxhash64("region"), "likely").where("likely").drop("likely")
        placed = stored(attach_groups(likely, sizes, ["region"], "size", total).where("size IS NOT NULL").withColumn("depth", F.lit(level)))
        if level == depth or sizes.where(F.col("size") > bound).isEmpty():
            return _union([*done, placed])
        done.append(placed.where(F.col("size") <= bound))
        rows = placed.where(F.col("size") > bound).select("node", "n", "tree", "key")
    raise AssertionError("the last level returns")


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _parts(bound: int) -> Column:
    return F.ceil(F.greatest(F.col("size") / bound, F.col("weight") / PART_SHINGLES)).cast("int")


def _neighbours(regions: DataFrame, bound: int) -> DataFrame:
    """Pairs that stand next to each other in a region's signature order, if their sizes allow a link."""
    part = F.pmod(F.xxhash64("node", "tree"), _parts(bound))
    order = Window.partitionBy("tree", "region", part).orderBy("key", "node")
    pairs = regions.select("node", "n", F.lead(F.struct("node", "n")).over(order).alias("next")).where(
        100 * F.least(F.col("n"), F.col("next.n")) >= 75 * F.greatest(F.col("n"), F.col("next.n")))
    return pairs.select(F.least("node", "next.node").alias("a"), F.greatest("node", "next.node").alias("b")).distinct()


def _with_depths(regions: DataFrame, classes: DataFrame, trees: int) -> DataFrame:
    """(node, signature, depths): in one byte per tree, how deep the node's region is; 255 where it has none."""
    level = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.coalesce(
        F.element_at("depth_of", t), F.lit(255)))
    found = regions.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("tree", "depth"))).alias("depth_of"))
    hexes = F.array_join(F.transform(level, lambda d: F.lpad(F.hex(d), 2, "0")), "")
    return found.select("node", F.unhex(hexes).alias("depths")).join(classes.select("node", "signature"), "node")


def least_matches(values: int) -> int:
    """Values that two signatures share at least, but for one pair in MISSED, where the sets' similarity is 0.75 or more."""
    below, matches = 0.0, 0
    while True:
        below += math.comb(values, matches) * 0.75 ** matches * 0.25 ** (values - matches)
        if below > MISSED:
            return matches
        matches += 1


def _meetings(regions: DataFrame, known: DataFrame, bound: int) -> DataFrame:
    """(meet, side, tree, node, n, of): what meets in one task, for regions with several components.

    A region of more than about ``bound`` signatures is cut into parts by hash,
    and every part meets every other one, on two sides, and itself, on side 0.
    """
    rows = stored(regions.select("tree", "region", "node", "n").join(known, "node", "left").withColumn(
        "of", F.coalesce("component", "node")).drop("component"))
    several = stored(rows.groupBy("tree", "region").agg(
        F.min("of").alias("low"), F.max("of").alias("high"), F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight")).where(
        "low <> high").drop("low", "high"))
    placed = attach_groups(rows, several, ["tree", "region"], "size", counted(rows)).where("size IS NOT NULL")
    placed = placed.withColumn("parts", _parts(bound)).withColumns(
        {"part": F.pmod(F.xxhash64("node", "tree"), F.col("parts")).cast("int"), "other": F.explode(F.sequence(F.lit(0), F.col("parts") - 1))})
    return stored(placed.select(
        F.xxhash64("tree", "region", F.least("part", "other"), F.greatest("part", "other")).alias("meet"),
        (F.col("part") > F.col("other")).cast("int").alias("side"), "tree", "node", "n", "of"))


def _alike(columns: list[np.ndarray], depths: np.ndarray, signed: np.ndarray, trees: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a, b) of one meeting that may link: of different components, with enough equal values, in the first tree where they meet."""
    side, tree, node, n, of = columns
    order = np.lexsort((of, side))
    side, node, n, of, depths, signed = side[order], node[order], n[order], of[order], depths[order], signed[order]
    own = tree[0]
    turned = np.ascontiguousarray(signed.T)
    split = int(np.searchsorted(side, 1))
    base = split if split < len(node) else 0
    other = np.arange(base, len(node))
    for at in range(0, split, 256):
        rows = np.arange(at, min(split, at + 256))
        if of[rows[0]] == of[rows[-1]] == of[other[0]] == of[other[-1]]:
            continue
        fits = of[rows, None] != of[None, other]
        if not base:
            fits &= rows[:, None] < other[None, :]
        fits &= 100 * np.minimum(n[rows, None], n[None, other]) >= 75 * np.maximum(n[rows, None], n[None, other])
        x, y = np.nonzero(fits)
        if not len(x):
            continue
        if 4 * len(x) < fits.size or fits.size < 1000:
            equal = np.concatenate([
                (signed[rows[x[k:k + 4096]]] == signed[other[y[k:k + 4096]]]).sum(axis=1) for k in range(0, len(x), 4096)])
            good = equal >= least
        else:
            shared = np.zeros(fits.shape, np.uint16)
            for values in turned:
                shared += values[rows, None] == values[None, other]
            good = shared[x, y] >= least
        x, y = rows[x[good]], other[y[good]]
        for k in range(0, len(x), 1 << 14):
            i, j = x[k:k + (1 << 14)], y[k:k + (1 << 14)]
            common = np.cumprod((signed[i] == signed[j]).reshape(len(i), trees, -1), axis=2).sum(axis=2)
            first = (common >= depths[i]).argmax(axis=1) == own
            i, j = node[i[first]], node[j[first]]
            if len(i):
                yield np.minimum(i, j), np.maximum(i, j)


def _candidates(met: DataFrame, signed: DataFrame, trees: int, depth: int) -> DataFrame:
    """(meet, a, b) of pairs of different components that the signatures do not rule out; (meet, null, null) where there are too many."""
    least, values = least_matches(trees * depth), trees * depth

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 0):
            columns = [c.to_numpy() for c in group.columns[1:6]]
            depths = np.frombuffer(b"".join(group.column(6).to_pylist()), np.uint8).reshape(-1, trees)
            rows = np.frombuffer(b"".join(group.column(7).to_pylist()), np.uint32).reshape(-1, values)
            found, many = [], 0
            for pair in _alike(columns, depths, rows, trees, least):
                found.append(pair)
                many += len(pair[0])
                if many > FEW * len(rows):
                    break
            meet = group.column(0)[0].as_py()
            if many > FEW * len(rows):
                one = [pa.array([meet], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.int64())]
            else:
                one = [pa.array([meet] * many, pa.int64()), *(
                    pa.array(np.concatenate([pair[k] for pair in found]) if found else [], pa.int64()) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays(one, names=["meet", "a", "b"])

    rows = met.join(signed, "node").select("meet", "side", "tree", "node", "n", "of", "depths", "signature")
    return rows.repartition("meet").sortWithinPartitions("meet").mapInArrow(compare, "meet long, a long, b long")


def _spanning(good: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix; every row is looked at once."""
    waiting = np.ones(len(good), bool)
    for start in range(len(good)):
        if not waiting[start]:
            continue
        waiting[start], front = False, [start]
        while front:
            here = front.pop()
            new = np.flatnonzero(good[here] & waiting)
            waiting[new] = False
            for there in new.tolist():
                yield here, there
            front += new.tolist()


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices over the shingles that several sets hold."""
    length = np.array([len(x) for x in sets])
    _, codes, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    line = np.repeat(np.arange(len(sets)), length)
    several = many[codes] > 1
    line, codes = line[several], (np.cumsum(many > 1) - 1)[codes[several]]
    order = np.argsort(codes, kind="stable")
    line, codes = line[order], codes[order]
    total = np.zeros((len(sets), len(sets)), np.float32)  # whole numbers, exact below 2^24
    for low in range(0, int((many > 1).sum()), COLUMNS):
        begin, end = np.searchsorted(codes, [low, low + COLUMNS])
        piece = np.zeros((len(sets), COLUMNS), np.float32)
        piece[line[begin:end], codes[begin:end] - low] = 1
        total += piece @ piece.T
    return total


def _dense_links(met: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): a spanning forest of the links between different components, for every meeting, from full sets."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 0):
            side, node, n, of = (c.to_numpy() for c in group.columns[1:5])
            own = [np.frombuffer(x, np.uint64) for x in group.column(5).to_pylist()]
            shared = _shared(own)
            good = 100 * shared >= 75 * (n[:, None] + n[None, :] - shared)
            good &= of[:, None] != of[None, :]
            if side.any():
                good &= side[:, None] != side[None, :]
            edges = np.array(list(_spanning(good)), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(node[edges[:, k]], pa.int64()) for k in (0, 1)], names=["a", "b"])

    rows = met.join(sets, "node").select("meet", "side", "node", "n", "of", "shingles")
    return stored(rows.repartition("meet").sortWithinPartitions("meet").mapInArrow(link, "a long, b long"))


def _groups(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[pa.Table]:
    """Tables of the rows with one value in column ``key``, by which the rows are sorted."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key).to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]])
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if held and values[low] != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(low, high - low))
            last = values[low]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _id_key() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id_key")


def _full_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of the wanted classes, from the text of each class's lowest document."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            node, found = [], []
            for own, digest, text in zip(*(c.to_pylist() for c in batch.columns)):
                shingles = shingle_set(text, memo, words)
                if _digest(shingles) == digest:  # an id may stand for other texts too
                    node.append(own)
                    found.append(shingles.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(found, pa.binary())], names=["node", "shingles"])

    ids = wanted.select("node", "digest", F.coalesce(F.col("lowest").cast("string"), F.lit("")).alias("id_key"))
    rows = docs.select(_id_key(), F.col("text").cast("string").alias("text"))
    rows = mark_members(rows, ids, F.xxhash64("id_key"), "possible").where("possible").join(ids, "id_key")
    sets = rows.select("node", "digest", "text").mapInArrow(convert, "node long, shingles binary")
    return stored(sets.groupBy("node").agg(F.first("shingles").alias("shingles")))


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs with 100 * intersection >= 75 * union of their full sets.

    ``pairs`` and ``sets`` are stored. Nodes fall into blocks by hash, and a task
    gets the sets of two blocks once each, only those that it has pairs of.
    """
    pairs_made = counted(pairs)
    size = sets.agg(F.sum(F.length("shingles"))).first()[0] or 0
    blocks = max(8, -(-size // BLOCK_BYTES), math.isqrt(2 * pairs_made // BLOCK_PAIRS))
    block = lambda c: F.pmod(F.xxhash64(c, F.lit(5)), F.lit(blocks))
    task = F.least(block("a"), block("b")) * blocks + F.greatest(block("a"), block("b"))
    keyed = pairs.select(task.alias("task"), "a", "b")
    members = keyed.select("task", F.explode(F.array("a", "b")).alias("node")).distinct().join(sets, "node")
    rows = keyed.select("task", F.lit(1).alias("kind"), "a", "b", F.lit(None).cast("binary").alias("shingles")).unionByName(
        members.select("task", F.lit(0).alias("kind"), F.col("node").alias("a"), F.lit(0).cast("long").alias("b"), "shingles"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 0):
            kind, a, b = (c.to_numpy() for c in group.columns[1:4])
            ours = np.flatnonzero(kind == 0)
            own = [np.frombuffer(x, np.uint64) for x in group.column(4).take(pa.array(ours)).to_pylist()]
            nodes = a[ours]
            order = np.argsort(nodes)
            nodes = nodes[order]
            own = [own[k] for k in order]
            length = np.array([len(x) for x in own], np.int64)
            names, codes = np.unique(np.concatenate(own), return_inverse=True) if own else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            begins = np.cumsum(length) - length
            left, right = a[kind == 1], b[kind == 1]
            if not len(left):
                continue
            i, j = (np.minimum(np.searchsorted(nodes, x), max(0, len(nodes) - 1)) for x in (left, right))
            order = np.argsort(i, kind="stable")
            i, j, left, right = i[order], j[order], left[order], right[order]
            if not ((nodes[i] == left).all() and (nodes[j] == right).all()):
                raise ValueError("a pair without its full sets")
            good = np.zeros(len(i), bool)
            marked = np.zeros(len(names), bool)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(i)) + 1, [len(i)]]).tolist()
            for low, high in zip(cuts[:-1], cuts[1:]):
                if low == high:
                    continue
                k = i[low]
                mine = codes[begins[k]:begins[k] + length[k]]
                marked[mine] = True
                for at in range(low, high, 1000):
                    with_ = j[at:min(high, at + 1000)]
                    many = length[with_]
                    starts = np.cumsum(many) - many
                    places = np.arange(int(many.sum())) + np.repeat(begins[with_] - starts, many)
                    shared = np.add.reduceat(marked[codes[places]], starts, dtype=np.int64)
                    good[at:at + len(with_)] = 100 * shared >= 75 * (length[k] + many - shared)
                marked[mine] = False
            yield pa.RecordBatch.from_arrays([pa.array(x[good], pa.int64()) for x in (left, right)], names=["a", "b"])

    met = rows.repartition("task").sortWithinPartitions("task")
    return stored(met.mapInArrow(check, "a long, b long"))


def near_duplicates(docs: DataFrame, words: int = WORDS, trees: int = TREES, depth: int = DEPTH, bound: int = REGION) -> DataFrame:
    """One row per input row: doc_id, tie (hash of the text), n_shingles, class, component_id, kept.

    Sets without shingles (null, empty or blank texts) link with nothing. Rows
    with equal sets are linked, also where a doc_id repeats. A component's id is
    its smallest doc_id; null ids come last and form no id of their own. An empty
    table gives no rows.
    """
    units = stored(describe(docs, words, trees, depth))
    classes = stored(
        units.where("digest IS NOT NULL").groupBy("digest").agg(
            F.min("doc_id").alias("lowest"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"),
            F.count(F.lit(1)).alias("copies")).withColumn("node", F.monotonically_increasing_id()))
    units = units.drop("signature")
    regions = _regions(classes, trees, depth, bound)
    near = stored(_neighbours(regions.where("tree < 4"), bound))
    wanted = regions.select("node").distinct().join(classes.select("node", "digest", "lowest"), "node")
    sets = _full_sets(docs, stored(wanted), words)
    links = _confirm(near, sets)
    known = stored(components(links))
    met = _meetings(regions, known, bound)
    wide = stored(_candidates(met, _with_depths(regions, classes, trees), trees, depth))
    many = met.join(wide.where("a IS NULL").select("meet"), "meet", "left_semi")
    pairs = stored(wide.where("a IS NOT NULL").select("a", "b").distinct().join(near, ["a", "b"], "left_anti"))
    of = components(_union([links, _confirm(pairs, sets), _dense_links(many, sets)]))
    joined = stored(classes.drop("signature").join(of, "node", "left").withColumn("component", F.coalesce("component", "node")))
    lowest = joined.groupBy("component").agg(F.min("lowest").alias("component_id"))
    table = stored(joined.join(lowest, "component").select("digest", "copies", F.col("component").alias("class"), "component_id"))
    return attach_groups(units, table, ["digest"], "copies", units.count()).select(
        "doc_id", "tie", "n_shingles", "class", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, **settings: int) -> DataFrame:
    """One document of each component, the one with the smallest doc_id, with the columns of the input.

    Of several rows with that doc_id the one with the lowest text hash stays, of
    rows that also share the text one. Only rows that may have to go are shuffled
    with their text; a Bloom filter lets the others pass.
    """
    key = ["id_key", "tie"]
    decided = near_duplicates(docs, **settings).where("class IS NOT NULL")
    texts = stored(decided.groupBy("class", F.col("doc_id").isNull().alias("unnamed"), "doc_id", "tie").agg(
        F.count(F.lit(1)).alias("many")))
    order = F.struct("unnamed", "doc_id", "tie")
    first = stored(texts.groupBy("class").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("texts")))
    chosen = attach_groups(texts, first, ["class"], "texts", counted(texts)).withColumn("stays", order == F.col("first"))
    # Rows to drop, and rows of which one stays.
    doubtful = stored(chosen.where("NOT stays OR many > 1").select(_id_key(), "tie", "stays"))
    names = {k: OWN + k for k in [*key, "stays"]}
    doubtful = doubtful.withColumnsRenamed(names)
    keyed = docs.withColumns({names["id_key"]: _id_key(), names["tie"]: F.xxhash64("text")})
    flag = OWN + "possible"
    tested = mark_members(keyed, doubtful, F.xxhash64(names["id_key"], names["tie"]), flag)
    columns = docs.columns
    on = [names[k] for k in key]
    found = tested.where(flag).join(doubtful, on, "left")
    innocent = found.where(F.col(names["stays"]).isNull())
    doubled = found.where(names["stays"]).groupBy(*on).agg(
        F.max_by(F.struct(*columns), F.xxhash64(*columns)).alias("row")).select("row.*")
    return tested.where(~F.col(flag)).select(*columns).unionByName(innocent.select(*columns)).unionByName(doubled)
