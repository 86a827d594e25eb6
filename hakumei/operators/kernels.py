"""Spans of whole batches of rows in numpy: pairing, one-to-one matching, matching at every score, token runs.

Each function takes and gives Arrow arrays and works on all rows of a batch at once; its cost
grows with the spans and with the pairs that overlap, not with the product of a row's spans.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

MATCH = "array<struct<g:int,p:int>>"
LEVEL = "array<struct<label:string,score:double,tp:int,fp:int>>"


def arrow_function(run: Callable[..., pa.Array], kind: str) -> Callable[..., Column]:
    """A function of Arrow arrays as a function of columns.

    Spark can't take its arguments out of a projection if they hold a lambda inside a lambda that uses the outer
    variable; write such a column to a table, or compute it in the function itself.
    """

    with warnings.catch_warnings():
        warnings.simplefilter("ignore", UserWarning)  # type hints would have to name every argument
        return F.arrow_udf(run, kind, F.ArrowUDFType.SCALAR)


def rows_of(column: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """The row of every element, and the elements; null lists have none."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), lengths), column.flatten()


def lists_of(row: np.ndarray, n: int, fields: dict[str, pa.Array]) -> pa.ListArray:
    """Structs of the fields as one list for each of n rows; `row` is sorted."""
    offsets = np.zeros(n + 1, np.int32)
    np.cumsum(np.bincount(row, minlength=n), out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(list(fields.values()), list(fields)))


class Spans:
    """Columns of the spans of a batch: row, start, end, label code, score."""

    def __init__(self, column: pa.ListArray, codes: dict[str, int]) -> None:
        self.row, flat = rows_of(column)
        self.start, self.end = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start_pos", "end_pos"))
        self.score = flat.field("score").to_numpy(zero_copy_only=False).astype(float)
        words = flat.field("label").dictionary_encode()
        own = [codes.setdefault(w, len(codes)) for w in words.dictionary.to_pylist()] or [0]
        self.label = np.array(own)[words.indices.to_numpy(zero_copy_only=False)] if len(words) else np.empty(0, np.int64)


def _key(group: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (group << 32) | place


def overlapping(a: Spans, b: Spans, groups_a: np.ndarray, groups_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all pairs of the same group that have a character in common."""
    order = np.lexsort((b.start, groups_b))
    starts = _key(groups_b[order], b.start[order])
    reach = np.maximum.accumulate(_key(groups_b[order], b.end[order])) if len(order) else starts
    low = np.searchsorted(reach, _key(groups_a, a.start), side="right")
    counts = np.maximum(np.searchsorted(starts, _key(groups_a, a.end)) - low, 0)
    i = np.repeat(np.arange(len(counts)), counts)
    j = order[np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts)]
    keep = b.end[j] > a.start[i]
    return i[keep], j[keep]


def taken_in_order(g: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Of pairs in order of preference those in which neither side was taken by an earlier one.

    In each round every pair that is the first of both its sides is taken, and what it blocks leaves.
    """
    open_ = np.arange(len(g))
    taken = []
    while len(open_):
        first = np.zeros(len(open_), np.int8)
        for side in (g, p):
            first[np.unique(side[open_], return_index=True)[1]] += 1
        now = open_[first == 2]
        taken.append(now)
        open_ = open_[~(np.isin(g[open_], g[now]) | np.isin(p[open_], p[now]))]
    return np.concatenate(taken) if taken else open_


def _candidates(gold: Spans, found: Spans, mode: str) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one row and label that may be matched, in order of preference."""
    width = 1 + max(gold.label.max(initial=0), found.label.max(initial=0))
    g, p = overlapping(gold, found, gold.row * width + gold.label, found.row * width + found.label)
    both = np.minimum(gold.end[g], found.end[p]) - np.maximum(gold.start[g], found.start[p])
    iou = both / ((gold.end[g] - gold.start[g]) + (found.end[p] - found.start[p]) - both)
    if mode == "exact":
        same = (gold.start[g] == found.start[p]) & (gold.end[g] == found.end[p])
        g, p, iou = g[same], p[same], iou[same]
    order = np.lexsort((p, g, found.start[p], gold.start[g], -found.score[p], -iou))
    return g[order], p[order]


def matches(gold: pa.ListArray, found: pa.ListArray, mode: str) -> pa.ListArray:
    """For each row the indices of gold and found spans matched one to one, sorted by gold span."""
    codes: dict[str, int] = {}
    a, b = Spans(gold, codes), Spans(found, codes)
    g, p = _candidates(a, b, mode)
    kept = taken_in_order(g, p)
    g, p = g[kept], p[kept]
    order = np.argsort(g)
    g, p = g[order], p[order]
    place = lambda row: np.arange(len(row)) - np.searchsorted(row, row)
    fields = {"g": pa.array(place(a.row)[g].astype(np.int32)), "p": pa.array(place(b.row)[p].astype(np.int32))}
    return lists_of(a.row[g], len(gold), fields)


def levels(gold: pa.ListArray, found: pa.ListArray, mode: str) -> pa.ListArray:
    """For each row how true and false positives change as the threshold falls to each score of its spans.

    The sum of the changes from the top down to a threshold is what matching only the spans that reach it gives.
    Spans are matched anew at each of their scores, but only among those they are connected with by
    overlaps, since nothing else can change.
    """
    codes: dict[str, int] = {}
    a, b = Spans(gold, codes), Spans(found, codes)
    names = list(codes) or [""]
    width = len(names)
    groups = np.r_[a.row * width + a.label, b.row * width + b.label]
    start, end = np.r_[a.start, b.start], np.r_[a.end, b.end]
    order = np.lexsort((end, start, groups))
    reach = np.maximum.accumulate(_key(groups[order], end[order])) if len(order) else order
    opens = np.r_[True, _key(groups[order], start[order])[1:] >= reach[:-1]][: len(order)]
    cluster = np.empty(len(order), np.int64)
    cluster[order] = np.cumsum(opens)
    own = cluster[len(a.row) :]
    # dense rank of each found span's score in its cluster, from the top
    down = np.lexsort((-b.score, own))
    new = np.r_[True, (own[down][1:] != own[down][:-1]) | (b.score[down][1:] != b.score[down][:-1])][: len(down)]
    number = np.empty(len(down), np.int64)
    number[down] = np.cumsum(new) - 1  # levels of all clusters, numbered through
    top = down[new]  # one span of each level
    level_cluster, level_score = own[top], b.score[top]
    last = np.searchsorted(level_cluster, level_cluster, side="right")  # behind the last level of the cluster
    g, p = _candidates(a, b, mode)
    times = last[number[p]] - number[p]
    which = np.repeat(np.arange(len(g)), times)
    level = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times) + number[p][which]
    n_levels = len(top)
    kept = taken_in_order(g[which] * n_levels + level, p[which] * n_levels + level)
    matched = np.bincount(level[kept], minlength=n_levels)
    added = np.bincount(number, minlength=n_levels)
    before = np.r_[0, matched[:-1]] * np.r_[False, level_cluster[1:] == level_cluster[:-1]] if n_levels else matched
    tp = matched - before
    row = b.row[top]
    sort = np.argsort(row, kind="stable")
    fields = {
        "label": pa.array(names).take(pa.array(b.label[top][sort], pa.int64())), "score": pa.array(level_score[sort]),
        "tp": pa.array(tp[sort].astype(np.int32)), "fp": pa.array((added - tp)[sort].astype(np.int32)),
    }
    return lists_of(row[sort], len(gold), fields)


#: Whether a code point up to U+3000 is a blank; there are none above.
_BLANK = np.array([chr(c).isspace() for c in range(0x3001)])


class Texts:
    """The texts of a batch as one array of code points, with the places that hold no blank."""

    def __init__(self, column: pa.Array) -> None:
        self.values = [t or "" for t in column.to_pylist()]
        codes = np.frombuffer("".join(self.values).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.offset = np.zeros(len(self.values) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, self.values), np.int64, len(self.values)), out=self.offset[1:])
        self.filled = np.flatnonzero(~_BLANK[np.minimum(codes, 0x3000)] | (codes > 0x3000))

    def trimmed(self, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """start and end without the blanks on either side; equal where there is nothing else."""
        base, top = self.offset[row], self.offset[row + 1]
        low, high = np.minimum(base + start, top), np.minimum(base + end, top)
        first, behind = np.searchsorted(self.filled, low), np.searchsorted(self.filled, high)
        some = behind > first
        padded = np.r_[self.filled, 0]
        new = np.where(some, padded[np.minimum(first, len(self.filled))], low)
        return new - base, np.where(some, padded[np.maximum(behind - 1, 0)] + 1, new) - base


def token_spans(tokens: pa.ListArray, text: pa.Array, labels: tuple[str, ...], threshold: float) -> pa.ListArray:
    """Spans of the runs of tokens that carry one label, by the rules of decode.decode_bio."""
    row, flat = rows_of(tokens)
    start, end = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start_pos", "end_pos"))
    texts = Texts(text)
    left, right = texts.trimmed(row, start, end)
    at = np.flatnonzero((end > start) & (right > left))
    probs = flat.field("probs").flatten().to_numpy(zero_copy_only=False).reshape(len(row), 1 + 2 * len(labels))[at]
    mass = probs[:, 1::2] + probs[:, 2::2]
    label = mass.argmax(axis=1) if len(at) else np.empty(0, np.int64)
    each = np.arange(len(at))
    p = mass[each, label]
    carries = p > probs[:, 0]
    row, start, end = row[at], start[at], end[at]
    goes_on = np.zeros(len(at), bool)
    goes_on[1:] = (
        carries[1:] & carries[:-1] & (row[1:] == row[:-1]) & (label[1:] == label[:-1])
        & (probs[each, 2 * label + 1] < probs[each, 2 * label + 2])[1:]
    )
    inside = np.flatnonzero(carries)
    first = np.flatnonzero(~goes_on[inside])
    score = np.minimum.reduceat(p[inside], first) if len(first) else p[:0]
    last = np.r_[first[1:], len(inside)] - 1 if len(first) else first
    keep = score >= threshold
    opening, closing, score = inside[first][keep], inside[last][keep] if len(first) else inside[:0], score[keep]
    row, label = row[opening], label[opening]
    low, high = texts.trimmed(row, start[opening], end[closing])
    values = [texts.values[r][a:b] for r, a, b in zip(row.tolist(), low.tolist(), high.tolist())]
    fields = {
        "start_pos": pa.array(low.astype(np.int32)), "end_pos": pa.array(high.astype(np.int32)),
        "label": pa.array(labels).take(pa.array(label, pa.int64())), "text": pa.array(values, pa.string()),
        "score": pa.array(score), "source": pa.array(["model"] * len(values), pa.string()),
    }
    return lists_of(row, len(tokens), fields)
