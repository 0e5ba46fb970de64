"""Counter-based draws for numpy: a draw depends on nothing but its stream's name and its number.

One SHA-256 digest of ``name:block`` holds four draws of 60 bits, so any engine with
that hash makes the same ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np

try:  # the interpreter's own SHA-256 costs less to begin and end, the library's less for each 64 bytes
    from _sha2 import sha256 as own_sha256
except ModuleNotFoundError:
    own_sha256 = hashlib.sha256

#: Draws of one digest, digests of a stream made at once (they stay in a core's cache), and draws counted at once.
PER_DIGEST, CHUNK, COUNTED = 4, 1 << 12, 1 << 16
#: Bytes of a SHA-256 block, and of its last one at most.
BLOCK_BYTES, LAST_BYTES = 64, 55


def _digests(name: str, numbers: Sequence[bytes]) -> bytes:
    """The digests of ``name:number``, one after the other; the name is hashed once."""
    head = name.encode() + b":"
    # The interpreter's keeps a whole last block of the name unhashed.
    one_block = 0 < len(head) % BLOCK_BYTES <= LAST_BYTES - len(numbers[-1])
    begun = (own_sha256 if one_block else hashlib.sha256)(head).copy
    made = []
    for number in numbers:
        digest = begun()
        digest.update(number)
        made.append(digest.digest())
    return b"".join(made)


def _numbers(first: int, many: int) -> list[bytes]:
    return [b"%d" % k for k in range(first, first + many)]


def _bounded(digests: np.ndarray, bound: int) -> np.ndarray:
    """60 bits of each big-endian quarter of a digest, modulo ``bound``."""
    bits = digests.astype(np.uint64)
    bits >>= np.uint64(4)
    if bound & (bound - 1) == 0:
        bits &= np.uint64(bound - 1)
    else:
        bits -= bits // np.uint64(bound) * np.uint64(bound)
    return bits.view(np.int64)


def draws(name: str, first: int, count: int, bound: int) -> np.ndarray:
    """Draws ``4 * first`` to ``4 * first + count - 1`` of a stream, in 0 .. bound - 1."""
    if count <= 0:
        return np.zeros(0, np.int64)
    return _bounded(np.frombuffer(_digests(name, _numbers(first, -(-count // PER_DIGEST))), ">u8")[:count], bound)


def tally(names: Sequence[str], wanted: np.ndarray, bound: int, width: int = 1) -> np.ndarray:
    """Counts, per stream, of its first ``wanted`` draws from 0 .. bound - 1 by buckets of ``width``."""
    buckets = -(-bound // width)
    counts = np.zeros((len(names), buckets), np.int64)
    most = int(max(wanted, default=0))
    for at in range(0, most, CHUNK * PER_DIGEST):
        numbers = _numbers(at // PER_DIGEST, -(-min(most - at, CHUNK * PER_DIGEST) // PER_DIGEST))
        lines, parts, held = [], [], 0

        def count() -> None:
            drawn = _bounded(np.concatenate(parts), bound)
            if width & (width - 1):
                drawn //= width
            else:
                drawn >>= width.bit_length() - 1
            drawn += np.repeat(np.arange(len(lines)) * buckets, [len(p) for p in parts])
            counts[lines] += np.bincount(drawn, minlength=len(lines) * buckets).reshape(len(lines), buckets)

        for line, (name, many) in enumerate(zip(names, wanted)):
            here = min(int(many) - at, CHUNK * PER_DIGEST)
            if here <= 0:
                continue
            lines.append(line)
            parts.append(np.frombuffer(_digests(name, numbers[:-(-here // PER_DIGEST)]), ">u8")[:here])
            held += here
            if held >= COUNTED:
                count()
                lines, parts, held = [], [], 0
        if lines:
            count()
    return counts


def replicate_names(key: str, role: str, first: int, many: int) -> list[str]:
    return [f"{key}:{role}:{r}" for r in range(first, first + many)]


def level_weights(key: str, role: str, first: int, many: int, levels: int) -> np.ndarray:
    """How often each of ``levels`` levels is drawn in ``levels`` draws, per replicate (rows)."""
    return tally(replicate_names(key, role, first, many), np.full(many, levels), levels)


def level_draws(key: str, role: str, first: int, many: int, levels: int) -> np.ndarray:
    """``levels`` drawn levels per replicate (rows)."""
    return np.stack([draws(name, 0, levels, levels) for name in replicate_names(key, role, first, many)])
