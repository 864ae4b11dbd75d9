"""A minimal acyclic transducer from words to output numbers, in one flat block of bytes.

Words enter in sorted order; equal tails are shared as soon as they are complete (incremental minimisation).
Every arc carries the count of words that sort before the arc's target inside its state, so the sum along a
path is the word's rank, and outputs sit in a table by rank. The block is made for ``mmap``: opening it
copies nothing.

Layout, little endian int32: [n_states, n_arcs, n_outputs, root, first arc of each state (n+1), final flag of each
state (n), byte of each arc, target of each arc, count of each arc, first output of each rank (r+1), outputs].
"""

from __future__ import annotations

import mmap

import numpy as np


def build(entries: dict[bytes, list[int]]) -> bytes:
    """The block for ``entries``: word -> output numbers."""
    words = sorted(entries)
    registry: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []

    def settle(node) -> int:
        final, arcs = node
        key = (final, tuple(arcs))
        if key not in registry:
            registry[key] = len(states)
            states.append(key)
        return registry[key]

    path: list[list] = [[False, []]]
    last = b""
    for word in words:
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        for depth in range(len(last), same, -1):
            done = settle(path.pop())
            path[-1][1].append((last[depth - 1], done))
        for _ in word[same:]:
            path.append([False, []])
        path[-1][0] = True
        last = word
    for depth in range(len(last), 0, -1):
        done = settle(path.pop())
        path[-1][1].append((last[depth - 1], done))
    root = settle(path[0])

    below = np.zeros(len(states), np.int64)
    first, byte, target, count = [0], [], [], []
    for s, (final, arcs) in enumerate(states):
        before = int(final)
        for b, t in arcs:
            byte.append(b)
            target.append(t)
            count.append(before)
            before += int(below[t])
        below[s] = before
        first.append(len(byte))
    outputs = [entries[w] for w in words]
    starts = np.concatenate(([0], np.cumsum([len(o) for o in outputs]))) if outputs else np.zeros(1)
    flat = [x for o in outputs for x in o]
    parts = [[len(states), len(byte), len(words), root], first, [int(f) for f, _ in states], byte, target, count, starts, flat]
    return np.concatenate([np.asarray(p, dtype="<i4") for p in parts]).tobytes()


class Lexicon:
    """Look-ups in a block, from a file (mapped) or from bytes."""

    def __init__(self, block) -> None:
        data = np.frombuffer(block, dtype="<i4")
        n, m, r, self.root = (int(x) for x in data[:4])
        at = 4
        cut = []
        for size in (n + 1, n, m, m, m, r + 1):
            cut.append(data[at : at + size])
            at += size
        self.first, self.final, self.byte, self.target, self.count, self.starts = cut
        self.flat = data[at:]
        self.size, self.states = r, n
        self._arcs: dict[int, dict[int, tuple[int, int]]] = {}

    @classmethod
    def open(cls, path: str) -> "Lexicon":
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def arcs(self, state: int) -> dict[int, tuple[int, int]]:
        """A state's arcs, read from the mapped block when the state is first visited."""
        found = self._arcs.get(state)
        if found is None:
            a, b = int(self.first[state]), int(self.first[state + 1])
            found = dict(zip(self.byte[a:b].tolist(), zip(self.target[a:b].tolist(), self.count[a:b].tolist())))
            self._arcs[state] = found
        return found

    def get(self, word: bytes) -> list[int] | None:
        """The outputs of ``word``, or None if it isn't in the lexicon."""
        state, rank, known = self.root, 0, self._arcs
        for b in word:
            step = (known.get(state) or self.arcs(state)).get(b)
            if step is None:
                return None
            state, more = step
            rank += more
        if not self.final[state]:
            return None
        return self.flat[int(self.starts[rank]) : int(self.starts[rank + 1])].tolist()
