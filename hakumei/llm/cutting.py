"""Splitting oversized items at natural boundaries.

Method: a sparse-table range-maximum index over the strength of every possible
cut. For each piece the strongest cut in the window of permissible lengths is
queried, ties go to the right, and the next piece begins `overlap` characters before it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Strength of a cut: between paragraphs, after a line, after a sentence, after a clause, anywhere, inside a character.
PARAGRAPH, LINE, SENTENCE, CLAUSE, ANYWHERE, INSIDE = 4, 3, 2, 1, 0, -1

# What ends sentences and clauses, and what may follow it.
_BREAK = r"(?:\r\n|[\n\r\u2028\u2029\x85])"
_LINE_END = regex.compile(rf"{_BREAK}(?P<more>\s*{_BREAK})?")
_SENTENCE_END = regex.compile(r"(?:[。．！？｡]+[」』）】〕》”’\)\]\"']*|[.!?]+[\"'\)\]”’]*(?=\s|$))[ 　]*")
_CLAUSE_END = regex.compile(r"[、，；：;:]|,(?!\d)|[」』）】](?![。、])|[ \t　]+")
_JOINER = "\u200d"


def strengths(text: str) -> np.ndarray:
    """Strength of a cut before each code point 0..n; position n is the end of the text."""
    out = np.zeros(len(text) + 1, np.int8)
    for pattern, value in ((_CLAUSE_END, CLAUSE), (_SENTENCE_END, SENTENCE)):
        ends = [m.end() for m in pattern.finditer(text)]
        out[ends] = value
    for m in _LINE_END.finditer(text):
        out[m.end()] = PARAGRAPH if m["more"] is not None else LINE
    if not text.isascii():
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        for c in np.unique(codes).tolist():
            if c >= 0x300 and (unicodedata.category(chr(c))[0] == "M" or chr(c) == _JOINER or 0x1F3FB <= c <= 0x1F3FF):
                at = np.flatnonzero(codes == c)
                out[at] = INSIDE
                if chr(c) == _JOINER:
                    out[at + 1] = INSIDE
    if "\r\n" in text:
        out[[m.start() + 1 for m in regex.finditer("\r\n", text)]] = INSIDE
    return out


class RangeMaximum:
    """Sparse table: position of the largest value in any range up to `longest`, the rightmost among equals."""

    def __init__(self, values: np.ndarray, longest: int) -> None:
        self.values = values
        self.levels = [np.arange(len(values), dtype=np.int32)]
        half = 1
        while 2 * half <= min(longest, len(values)):
            low = self.levels[-1]
            left, right = low[:-half], low[half:]
            self.levels.append(np.where(values[left] > values[right], left, right))
            half *= 2

    def best(self, low: int, high: int) -> int:
        """For the inclusive range low..high."""
        k = (high - low + 1).bit_length() - 1
        left, right = self.levels[k][low], self.levels[k][high - (1 << k) + 1]
        return int(left if self.values[left] > self.values[right] else right)


def pieces(text: str, most: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces: none longer than `most`, each but the first beginning with the last `overlap` code points of the one before.

    Cuts are looked for in the second half of the window first, so that pieces aren't
    shorter than needed, and in all of it if there is no sentence end there.
    """
    if not 0 <= overlap < most:
        raise ValueError(f"overlap {overlap} must be less than the limit {most}")
    if len(text) <= most:
        return [(0, len(text))]
    value = strengths(text)
    width = max(16 * most, 65_536)
    base, index = 0, None  # the table covers `width` places at a time, however long the text is
    out = []
    start = end = 0
    while start + most < len(text):
        first, last = end + 1, start + most
        if index is None or last > base + width:
            base, index = first, RangeMaximum(value[first : first + width + 1], most)
        best = lambda low, high: base + index.best(low - base, high - base)  # noqa: B023, E731
        cut = best(max(first, start + most // 2), last)
        if value[cut] < SENTENCE:
            wide = best(first, last)
            if value[wide] >= SENTENCE or value[cut] == INSIDE:
                cut = wide
        out.append((start, cut))
        end = cut
        start = cut - overlap
    out.append((start, len(text)))
    return out


def cut_items(items: DataFrame, item_id: str, text: str, limit: Column, overlap: Column) -> DataFrame:
    """(item_id, piece_no, n_pieces, start_pos, end_pos, text): numbered pieces of the items with more code points than their limit.

    Items within their limit, without a limit, and with null text aren't in the result;
    an item given again with the same id and text is cut once. Concatenating the pieces
    without their overlap restores the text. Only oversized texts are moved or leave the JVM.
    """
    long = items.select(
        F.col(item_id).alias("item_id"), F.col(text).alias("text"),
        limit.cast("int").alias("most"), overlap.cast("int").alias("overlap"),
    ).where(F.length("text") > F.col("most"))
    once = long.dropDuplicates(["item_id", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            rows: list[list] = [[] for _ in range(6)]
            size = 0
            for name, text, most, step in zip(*columns):
                cuts = pieces(text, most, step or 0)
                for k, (a, b) in enumerate(cuts, 1):
                    for column, x in zip(rows, (name, k, len(cuts), a, b, text[a:b])):
                        column.append(x)
                size += len(text)
                if size > 2_000_000:
                    yield _batch(rows)
                    rows, size = [[] for _ in range(6)], 0
            if rows[0]:
                yield _batch(rows)

    return once.mapInArrow(run, "item_id string, piece_no int, n_pieces int, start_pos int, end_pos int, text string")


def _batch(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
    names = ["item_id", "piece_no", "n_pieces", "start_pos", "end_pos", "text"]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds)], names)
