"""Vectorised text arrays: code points, character n-gram hashes, similarity sketches.

Everything works on a batch of texts at once with numpy. Batches are cut to
SLICE_CHARS code points, so memory per worker is bounded by that and by the
longest single text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np

#: Code points handled at once in a worker.
SLICE_CHARS = 400_000

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def squeeze(text: str) -> str:
    """NFKC without any blanks and line breaks: the form in which similarity is measured."""
    return "".join(unicodedata.normalize("NFKC", text).split())


def slices(lengths: list[int], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts with about `limit` code points together."""
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= _C1
    x ^= x >> np.uint64(27)
    x *= _C2
    x ^= x >> np.uint64(31)
    return x


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points in one array, and the n + 1 offsets of the texts in it."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=offsets[1:])
    return flat, offsets


def grams(flat: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-character substrings: (text index, position in text, hash)."""
    counts = np.maximum(np.diff(offsets) - (n - 1), 0)
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    rolling = np.zeros(len(flat) - n + 1, np.uint64)
    for k in range(n):
        rolling *= _BASE
        rolling += flat[k : len(flat) - n + 1 + k]
    doc = np.repeat(np.arange(len(counts)), counts)
    pos = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
    return doc, pos, mix(rolling[pos + np.repeat(offsets[:-1], counts)])


def fast_similarity_sketch(doc: np.ndarray, hashes: np.ndarray, n_docs: int, t: int) -> np.ndarray:
    """Sketches of t coordinates for every set; two sets agree in a coordinate with probability their Jaccard similarity.

    Round i < t throws every element into a hashed bin with a value that is larger
    than all of earlier rounds; round i >= t throws all elements into bin i - t, so
    each coordinate of a non-empty set is filled after 2 t rounds at most. Later
    rounds only visit sets that still have an empty bin. Sets without elements
    keep the all-ones value.
    """
    sketch = np.full(n_docs * t, _EMPTY, np.uint64)
    todo = np.arange(n_docs)
    width = np.uint64(t)
    for i in range(2 * t):
        salt = mix(np.array([i + 1], np.uint64) * _BASE)[0]
        value = mix(hashes ^ salt)
        if i < t:
            bins = (((value >> np.uint64(32)) * width) >> np.uint64(32)).astype(np.int64)
        else:
            bins = np.full(len(value), i - t, np.int64)
        slot = doc * t + bins
        value &= np.uint64((1 << 44) - 1)
        value |= np.uint64(i << 44)
        if i:
            free = sketch[slot] == _EMPTY
            slot, value = slot[free], value[free]
        np.minimum.at(sketch, slot, value)
        filled = (sketch.reshape(n_docs, t)[todo] != _EMPTY).all(axis=1)
        if filled.any():
            todo = todo[~filled]
            active = np.zeros(n_docs, bool)
            active[todo] = True
            keep = active[doc]
            doc, hashes = doc[keep], hashes[keep]
        if not len(doc):
            break
    return sketch.reshape(n_docs, t)


def coordinate_codes(sketch: np.ndarray, bits: int) -> np.ndarray:
    """The low `bits` bits of every coordinate after mixing: the code of which the blocks are keys."""
    codes = mix(sketch)
    return codes & np.uint64((1 << bits) - 1) if bits < 64 else codes


def band_keys(codes: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each block of `rows` coordinates of the codes."""
    n, t = codes.shape
    blocks = codes.reshape(n, t // rows, rows)
    key = np.zeros((n, t // rows), np.uint64)
    for k in range(rows):
        key *= _BASE
        key += blocks[:, :, k]
        key = mix(key)
    key += np.arange(t // rows, dtype=np.uint64) * _C2
    return mix(key).view(np.int64)


def hamming(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Differing bits of equally long fingerprints."""
    if not a:
        return np.empty(0, np.int64)
    x = np.frombuffer(b"".join(a), np.uint8).reshape(len(a), -1)
    y = np.frombuffer(b"".join(b), np.uint8).reshape(len(b), -1)
    return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
