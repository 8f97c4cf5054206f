"""A minimal acyclic transducer from terms to their places in byte order.

Built from sorted terms one by one: what the next term can't share any more is frozen, and a frozen state equal to an earlier
one becomes that one.  An arc's output is the number of terms that pass before it, so outputs add up to a term's place.
Arcs are kept as sorted arrays, and a whole array of terms takes its steps together, one byte a step.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa


@dataclass
class Transducer:
    arc: np.ndarray  # state * 256 + byte, ascending
    target: np.ndarray
    output: np.ndarray
    final: np.ndarray  # of each state
    start: int
    size: int  # terms

    def to_bytes(self) -> bytes:
        head = np.array([len(self.arc), len(self.final), self.start, self.size], "<i8")
        return b"".join(x.tobytes() for x in (head, self.arc.astype("<i8"), self.target.astype("<i8"), self.output.astype("<i8"), self.final.astype(np.uint8)))

    @staticmethod
    def from_bytes(data: bytes) -> Transducer:
        arcs, states, start, size = np.frombuffer(data, "<i8", 4).tolist()
        parts = [np.frombuffer(data, "<i8", arcs, 32 + 8 * arcs * i) for i in range(3)]
        return Transducer(*parts, np.frombuffer(data, np.uint8, states, 32 + 24 * arcs).astype(bool), start, size)

    def places(self, terms: pa.Array) -> np.ndarray:
        """The place of each term (large binary) among the transducer's, -1 for one that it doesn't hold."""
        _, offsets, data = terms.buffers()
        n = len(terms)
        at = np.frombuffer(offsets, np.int64)[terms.offset : terms.offset + n + 1] if n else np.zeros(1, np.int64)
        bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        begin, length = at[:-1], np.diff(at)
        state, place = np.full(n, self.start, np.int64), np.zeros(n, np.int64)
        out = np.full(n, -1, np.int64)
        live, step = np.arange(n), 0
        while len(live):
            done = length[live] == step
            ended = live[done]
            out[ended] = np.where(self.final[state[ended]], place[ended], -1)
            live = live[~done]
            if not len(live) or not len(self.arc):
                break
            key = state[live] * 256 + bytes_[begin[live] + step]
            found = np.minimum(np.searchsorted(self.arc, key), len(self.arc) - 1)
            there = self.arc[found] == key
            live, found = live[there], found[there]
            state[live] = self.target[found]
            place[live] += self.output[found]
            step += 1
        return out


def build(terms: Iterable[bytes]) -> Transducer:
    """The transducer of distinct terms in ascending order of their bytes."""
    known: dict[tuple, int] = {}
    states: list[tuple] = []
    counts: list[int] = []

    def frozen(node: list) -> int:
        key = (node[0], tuple(node[1]))
        at = known.get(key)
        if at is None:
            at = known[key] = len(states)
            states.append(key)
            counts.append(node[0] + sum(counts[t] for _, t in node[1]))
        return at

    path: list[list] = [[False, []]]
    last = b""

    def shorten(to: int) -> None:
        while len(path) > to + 1:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], frozen(node)))

    for term in terms:
        same = 0
        most = min(len(term), len(last))
        while same < most and term[same] == last[same]:
            same += 1
        shorten(same)
        last = term
        path.extend([False, []] for _ in range(len(term) - same))
        path[-1][0] = True
    shorten(0)
    start = frozen(path[0])
    arc, target, output = [], [], []
    for state, (final, arcs) in enumerate(states):
        before = int(final)
        for byte, to in arcs:
            arc.append(state * 256 + byte)
            target.append(to)
            output.append(before)
            before += counts[to]
    longs = lambda x: np.array(x, np.int64)
    return Transducer(longs(arc), longs(target), longs(output), np.array([f for f, _ in states], bool), start, counts[start])
