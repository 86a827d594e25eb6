"""A minimal acyclic transducer from words to numbers.

States with the same continuations are shared (suffixes included), built
incrementally from sorted words; each transition carries the number of words
that sort before it, so that their sum along a word's path is the word's rank. The
automaton is kept as sorted arrays that workers map into memory and step through
for many words at once.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np

_FIELDS = ("arc", "target", "output", "final", "offsets", "ids")


@dataclass
class Lexicon:
    """arc: sorted state * 256 + byte; target and output of each arc; final: states that end a word;
    offsets, ids: the ids of the word with each rank."""

    arc: np.ndarray
    target: np.ndarray
    output: np.ndarray
    final: np.ndarray
    offsets: np.ndarray
    ids: np.ndarray

    def files(self) -> dict[str, bytes]:
        """The arrays as the contents of .npy files, in the order in which `mapped` takes them."""
        out = {}
        for name in _FIELDS:
            buffer = io.BytesIO()
            np.save(buffer, getattr(self, name))
            out[name] = buffer.getvalue()
        return out

    @classmethod
    def mapped(cls, paths: list[str]) -> Lexicon:
        return cls(*(np.load(p, mmap_mode="r") for p in paths))

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word, -1 for words that aren't in the lexicon."""
        n = len(words)
        rank = np.full(n, -1, np.int64)
        if not n or not len(self.arc):
            return rank
        length = np.fromiter(map(len, words), np.int64, n)
        start = np.cumsum(length) - length
        flat = np.frombuffer(b"".join(words), np.uint8)
        alive = np.flatnonzero(length)
        state = np.zeros(len(alive), np.int64)
        total = np.zeros(len(alive), np.int64)
        step = 0
        while len(alive):
            wanted = state * 256 + flat[start[alive] + step]
            at = np.searchsorted(self.arc, wanted)
            at[at == len(self.arc)] = 0
            there = self.arc[at] == wanted
            alive, at = alive[there], at[there]
            state, total = self.target[at].astype(np.int64), total[there] + self.output[at]
            step += 1
            done = length[alive] == step
            ended = done & self.final[state]
            rank[alive[ended]] = total[ended]
            alive, state, total = alive[~done], state[~done], total[~done]
        return rank


def compile_lexicon(words: list[bytes], ids: list[list[int]]) -> Lexicon:
    """The transducer of distinct non-empty words in sorted order, with the ids of each."""
    arcs: list[dict[int, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}
    path: list[tuple[int, int]] = []  # (state, byte) along the last word, not yet shared

    def settle(depth: int) -> None:
        while len(path) > depth:
            state, byte = path.pop()
            child = arcs[state][byte]
            key = (final[child], tuple(arcs[child].items()))
            arcs[state][byte] = register.setdefault(key, child)

    last = b""
    for word in words:
        if word <= last:
            raise ValueError("words must be distinct, sorted and not empty")
        common = next((i for i, (a, b) in enumerate(zip(word, last)) if a != b), min(len(word), len(last)))
        settle(common)
        state = arcs[path[-1][0]][path[-1][1]] if path else 0
        for byte in word[common:]:
            arcs.append({})
            final.append(False)
            arcs[state][byte] = len(arcs) - 1
            path.append((state, byte))
            state = len(arcs) - 1
        final[state] = True
        last = word
    settle(0)

    number = {0: 0}
    order = [0]
    for state in order:
        for child in arcs[state].values():
            if child not in number:
                number[child] = len(order)
                order.append(child)
    # children come before parents when counted in order of depth of the longest continuation
    count: dict[int, int] = {}
    stack = [(0, False)]
    while stack:
        state, ready = stack.pop()
        if state in count:
            continue
        if ready:
            count[state] = final[state] + sum(count[c] for c in arcs[state].values())
        else:
            stack.append((state, True))
            stack += [(c, False) for c in arcs[state].values() if c not in count]
    arc, target, output = [], [], []
    for state in order:
        before = int(final[state])
        for byte, child in sorted(arcs[state].items()):
            arc.append(number[state] * 256 + byte)
            target.append(number[child])
            output.append(before)
            before += count[child]
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    return Lexicon(
        np.array(arc, np.int64),
        np.array(target, np.int32),
        np.array(output, np.int32),
        np.array([final[s] for s in order], bool),
        np.concatenate([[0], np.cumsum(lengths)]),
        np.array([x for own in ids for x in own], np.int32),
    )
