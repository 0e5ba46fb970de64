import zlib
from collections import defaultdict
from itertools import permutations

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from cumulo.llm import packing
from tests.llm import cases

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check_layout(rows, capacity):
    at = defaultdict(list)
    for r in rows:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end and length > 0
            end += length
        assert end <= capacity
    return len(at)


def test_pieces_round_trip(spark):
    library = Tokenizer.from_file(PATH)
    rows = packing.pack(packing.token_pieces(cases.messy(spark), PATH, 64, keep_ids=True), 64).collect()
    check_layout(rows, 64)
    whole = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["piece"]):
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        whole[r["doc_id"]].append(r)
    for i, t, _ in cases.messy_rows():
        if i is None or i == 15:  # ids that stand for several rows
            continue
        ids = [x for r in whole[i] for x in r["ids"]]
        assert ids == library.encode(t or "", add_special_tokens=False).ids + [2]
        assert [r["start"] for r in whole[i]] == list(np.cumsum([0] + [r["length"] for r in whole[i]])[:-1])
        assert all(r["length"] == 64 for r in whole[i][1:])


def test_exchange_saves_sequences(spark):
    rows = [(i, cases.words(i, 5 + i % 37), "a") for i in range(1500)]
    pieces = packing.token_pieces(cases.frame(spark, rows), PATH, 128)
    one = check_layout(packing.pack(pieces, 128, part_rows=100, rounds=1).collect(), 128)
    more = check_layout(packing.pack(pieces, 128, part_rows=100, rounds=4).collect(), 128)
    least = -(-sum(r["length"] for r in pieces.collect()) // 128)
    assert least <= more < one and more <= 1.02 * least  # partitions of 100 rows leave little choice


def test_empty(spark):
    assert packing.pack_documents(cases.empty(spark), PATH).count() == 0


def brute_bins(sizes, capacity):
    best = len(sizes)
    for order in permutations(sizes):
        bins = []
        for s in order:
            for k, room in enumerate(bins):
                if room >= s:
                    bins[k] -= s
                    break
            else:
                bins.append(capacity - s)
        best = min(best, len(bins))
    return best


def test_bounds_never_exceed_the_optimum():
    draw = np.random.default_rng(1)
    reached = 0
    for _ in range(60):
        sizes = draw.integers(1, 21, 6)
        bound, best = packing.lower_bound(sizes, 20), brute_bins(sizes.tolist(), 20)
        bins, _, room = packing.best_fit_decreasing(sizes, 20)
        assert bound <= best <= len(room)
        reached += bound == best
    assert reached > 50
    assert packing.lower_bound(np.array([11] * 7), 20) == 7  # sums alone would say 4
