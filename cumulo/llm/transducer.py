"""Minimal acyclic transducers: a sorted vocabulary as an automaton that gives every term its ordinal.

States with the same continuations are one state. An arc adds the number of terms
that come before those behind it, so the sum along a term's path is its place in
the sorted vocabulary, and the place leads back to the term.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np


class Transducer:
    """Arcs sorted by state * 256 + byte, each with its target and what it adds."""

    def __init__(self, keys: np.ndarray, targets: np.ndarray, adds: np.ndarray, final: np.ndarray, root: int):
        self.keys, self.targets, self.adds, self.final, self.root = keys, targets, adds, final, root

    @classmethod
    def build(cls, terms: Iterable[bytes]) -> Transducer:
        """From terms in rising order. What is behind the common prefix with the next term is final, and is shared at once."""
        register: dict[tuple, int] = {}
        behind: list[int] = []
        arcs: list[tuple[int, int, int, int]] = []
        ends: list[bool] = []

        def share(node: list) -> int:
            accepts, links = node
            name = (accepts, tuple(links))
            state = register.get(name)
            if state is None:
                state = register[name] = len(behind)
                before = int(accepts)
                for byte, target in links:
                    arcs.append((state, byte, target, before))
                    before += behind[target]
                behind.append(before)
                ends.append(accepts)
            return state

        # Open states along the last term: [accepts, [(byte, target)]].
        path: list[list] = [[False, []]]
        last = b""
        for number, term in enumerate(terms):
            if number and term <= last:
                raise ValueError("terms must rise")
            common = 0
            for a, b in zip(last, term):
                if a != b:
                    break
                common += 1
            while len(path) > common + 1:
                state = share(path.pop())
                path[-1][1].append((last[len(path) - 1], state))
            path += [[False, []] for _ in range(len(term) - common)]
            path[-1][0] = True
            last = term
        while len(path) > 1:
            state = share(path.pop())
            path[-1][1].append((last[len(path) - 1], state))
        root = share(path[0])
        table = np.array(arcs, np.int64).reshape(-1, 4)
        keys = table[:, 0] * 256 + table[:, 1]
        order = np.argsort(keys)
        return cls(keys[order], table[order, 2].astype(np.int32), table[order, 3].astype(np.int32), np.array(ends, bool), root)

    def ordinals(self, terms: list[bytes]) -> np.ndarray:
        """Ordinal of each term, -1 for those that are not in the vocabulary. All terms step through together."""
        found = np.full(len(terms), -1, np.int64)
        length = np.fromiter(map(len, terms), np.int64, len(terms))
        text = np.frombuffer(b"".join(terms), np.uint8)
        begins = np.cumsum(length) - length
        alive, place, total = np.arange(len(terms)), 0, np.zeros(len(terms), np.int64)
        state = np.full(len(terms), self.root, np.int64)
        while len(alive):
            over = length[alive] == place
            done = alive[over]
            found[done] = np.where(self.final[state[done]], total[done], -1)
            alive = alive[~over]
            if not len(alive) or not len(self.keys):
                break
            key = state[alive] * 256 + text[begins[alive] + place]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            fits = self.keys[at] == key
            alive, at = alive[fits], at[fits]
            total[alive] += self.adds[at]
            state[alive] = self.targets[at]
            place += 1
        return found

    def term(self, ordinal: int) -> bytes:
        """The term at a place of the vocabulary."""
        state, rest, spelled = self.root, ordinal, bytearray()
        while not (self.final[state] and rest == 0):
            low, high = np.searchsorted(self.keys, [state * 256, state * 256 + 256])
            at = low + int(np.searchsorted(self.adds[low:high], rest, side="right")) - 1
            if at < low:
                raise IndexError("no term has this ordinal")
            spelled.append(int(self.keys[at]) & 255)
            rest -= int(self.adds[at])
            state = int(self.targets[at])
        return bytes(spelled)

    def pack(self) -> bytes:
        sizes = np.array([len(self.keys), len(self.final), self.root], "<i8")
        return b"".join(x.tobytes() for x in (
            sizes, self.keys.astype("<i8"), self.targets.astype("<i4"), self.adds.astype("<i4"), self.final.astype("u1")))

    @classmethod
    def unpack(cls, data: bytes) -> Transducer:
        arcs, states, root = np.frombuffer(data, "<i8", 3).tolist()
        at = 24
        columns = []
        for kind, many in (("<i8", arcs), ("<i4", arcs), ("<i4", arcs), ("u1", states)):
            columns.append(np.frombuffer(data, kind, many, at))
            at += many * np.dtype(kind).itemsize
        return cls(columns[0], columns[1], columns[2], columns[3].astype(bool), root)
