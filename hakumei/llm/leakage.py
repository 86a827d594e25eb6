"""Evaluation texts leaking into training text.

Method: an inverted index of the test passages with BM25 weights and block maxima.
Every document is a query: block-max WAND moves cursors along the posting lists of its terms,
skips passages and blocks that can't reach their threshold, retrieves all passages that do, and
each is verified by looking for a common run of characters.

Terms are character n-grams of the folded text. A document with a run of `run`
characters in common with a passage contains all n-grams of some window of the
passage, so the least BM25 weight of any window is a threshold below which no true
case lies: retrieval loses nothing. The verification then decides.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles

#: Code points of test passages in one index, of about 60 bytes each; a larger test set has several, which a task loads in turn.
INDEX_CHARS = 4_000_000

#: Code points of documents that are asked of one index before the next is loaded, if there are several.
ASKED_CHARS = 20_000_000

#: Postings in a block.
BLOCK = 64

K1, B = 1.2, 0.75


def letters_and_numbers() -> np.ndarray:
    """For each code point whether it is a letter or a number."""
    return np.array([unicodedata.category(chr(c))[0] in "LN" for c in range(0x110000)], bool)


_LN: np.ndarray | None = None


def folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points and offsets of the texts NFKC-normalised, case-folded, letters and numbers only."""
    global _LN
    if _LN is None:
        _LN = letters_and_numbers()
    flat, offsets = shingles.code_points([unicodedata.normalize("NFKC", t).casefold() for t in texts])
    keep = _LN[flat]
    before = np.zeros(len(flat) + 1, np.int64)
    np.cumsum(keep, out=before[1:])
    return flat[keep], before[offsets]


@dataclass
class Index:
    """Posting lists in sorted order of their term hashes: passages and impacts, by blocks of BLOCK the last passage and largest impact.

    starts, blocks: where the postings and blocks of each term begin; least: threshold of each passage;
    seen: slots of the term hashes that occur, most other hashes fall into none.
    """

    terms: np.ndarray
    starts: np.ndarray
    blocks: np.ndarray
    passage: np.ndarray
    impact: np.ndarray
    largest: np.ndarray
    block_last: np.ndarray
    block_max: np.ndarray
    seen: np.ndarray
    least: np.ndarray
    ids: np.ndarray
    codes: np.ndarray
    offsets: np.ndarray
    n: int
    run: int

    @property
    def nbytes(self) -> int:
        return sum(getattr(self, f.name).nbytes for f in fields(self) if f.name not in ("n", "run"))


def build_index(ids: list[int], texts: list[str], n: int, run: int) -> Index | None:
    """Index of the passages with `run` folded characters at least; None if there is none."""
    codes, offsets = folded(texts)
    fit = np.flatnonzero(np.diff(offsets) >= run)
    if not len(fit):
        return None
    codes = np.concatenate([codes[offsets[i] : offsets[i + 1]] for i in fit])
    offsets = np.concatenate([[0], np.cumsum(np.diff(offsets)[fit])])
    doc, _, hashes = shingles.grams(codes, offsets, n)
    count = len(fit)
    length = np.diff(offsets).astype(float)
    order = np.lexsort((doc, hashes))
    h, d = hashes[order], doc[order]
    new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])])
    tf = np.diff(np.r_[new, len(h)]).astype(float)
    h, d = h[new], d[new]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    starts = np.r_[first, len(h)]
    df = np.diff(starts)
    idf = np.log1p((count - df + 0.5) / (df + 0.5))
    norm = K1 * (1 - B + B * length / length.mean())
    impact = (np.repeat(idf, df) * tf * (K1 + 1) / (tf + norm[d])).astype(np.float32)
    blocks = np.r_[0, np.cumsum(-(-df // BLOCK))]
    block_first = np.repeat(first, np.diff(blocks)) + BLOCK * (np.arange(blocks[-1]) - np.repeat(blocks[:-1], np.diff(blocks)))
    block_last = d[np.minimum(block_first + BLOCK, np.repeat(starts[1:], np.diff(blocks))) - 1]
    terms = h[first]
    # weight of every n-gram of every passage, and of the distinct ones in each window of `run` characters
    row = np.searchsorted(terms, hashes)
    weight = impact[np.searchsorted(np.repeat(np.arange(len(first)), df) * count + d, row * count + doc)].astype(float)
    least = _least_weights(doc, row, weight, count, run - n + 1)
    seen = np.zeros(1 << max(10, int(np.ceil(np.log2(len(terms) * 12)))), bool)
    seen[terms & np.uint64(len(seen) - 1)] = True
    return Index(
        terms, starts, blocks, d.astype(np.int32), impact, np.maximum.reduceat(impact, first), block_last.astype(np.int32),
        np.maximum.reduceat(impact, block_first), seen, least * (1 - 1e-6), np.array(ids)[fit], codes, offsets, n, run,
    )


def _least_weights(doc: np.ndarray, row: np.ndarray, weight: np.ndarray, count: int, span: int) -> np.ndarray:
    """For each passage the least summed weight of the distinct terms of `span` n-grams in a row."""
    total = len(doc)
    order = np.lexsort((np.arange(total), row, doc))
    again = np.r_[False, (row[order][1:] == row[order][:-1]) & (doc[order][1:] == doc[order][:-1])]
    before = np.full(total, -1)
    before[order[again]] = order[np.flatnonzero(again) - 1]  # where the same term stood last in the passage
    windows = np.flatnonzero(doc[: total - span + 1] == doc[span - 1 :])
    least = np.full(count, np.inf)
    for a in range(0, len(windows), 200_000):
        start = windows[a : a + 200_000]
        inside = start[:, None] + np.arange(span)
        sums = np.where(before[inside] < start[:, None], weight[inside], 0.0).sum(axis=1)
        np.minimum.at(least, doc[start], sums)
    return least


def retrieve(index: Index, rows: np.ndarray) -> list[int]:
    """Passages whose BM25 score for the distinct query terms `rows` (of the index) reaches their threshold, by block-max WAND.

    The pivot is the first passage that the largest impacts of the lists before it could lift to the least threshold of all.
    The maxima of the blocks around it are then compared with its own threshold: if they fall short, the
    cursors go past it, or past the nearest end of a block if they fall short of every threshold. Otherwise the
    cursors are brought to the pivot, and once they stand on it its score is summed exactly.
    """
    found: list[int] = []
    at, end = index.starts[rows], index.starts[rows + 1]
    block, block_end = index.blocks[rows], index.blocks[rows + 1]
    upper = index.largest[rows].astype(float)
    nowhere = len(index.least)
    floor = float(index.least.min())
    here = index.passage[at].astype(np.int64)

    def move(lists: np.ndarray, target: int) -> None:
        """Cursors of the lists to their first passage that isn't before the target."""
        low, high = at[lists], end[lists]
        while (open_ := low < high).any():
            middle = (low + high) // 2
            behind = open_ & (index.passage[np.minimum(middle, len(index.passage) - 1)] < target)
            low, high = np.where(behind, middle + 1, low), np.where(open_ & ~behind, middle, high)
        at[lists] = low
        here[lists] = np.where(low < end[lists], index.passage[np.minimum(low, len(index.passage) - 1)], nowhere)

    while True:
        order = np.argsort(here, kind="stable")
        bound = np.cumsum(upper[order])
        pivot = int(np.searchsorted(bound, floor))
        if pivot == len(order) or here[order[pivot]] == nowhere:
            return found
        p = int(here[order[pivot]])
        count = int(np.searchsorted(here[order], p, side="right"))
        lists = order[:count]
        while True:  # only block borders are looked at here
            live = block[lists] < block_end[lists]
            last = index.block_last[np.minimum(block[lists], len(index.block_last) - 1)]
            behind = live & (last < p)
            if not behind.any():
                break
            block[lists[behind]] += 1
        best = float(index.block_max[block[lists[live]]].sum(dtype=float))
        if best < index.least[p]:
            target = p + 1
            if best < floor:
                after = int(here[order[count]]) if count < len(order) else nowhere
                target = min(int(last[live].min()) + 1 if live.any() else nowhere, after)
            move(lists, target)
        elif here[lists[0]] < p:
            move(lists[here[lists] < p], p)
        else:
            if index.impact[at[lists]].sum(dtype=float) >= index.least[p]:
                found.append(p)
            move(lists, p + 1)


def shares_run(index: Index, passage: int, text: str, starts: np.ndarray) -> bool:
    """Whether the folded text contains `run` consecutive characters of the passage, beginning at one of the starts."""
    code = index.codes[index.offsets[passage] : index.offsets[passage + 1]]
    own = code.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    windows = {own[i : i + index.run] for i in range(len(own) - index.run + 1)}
    return any(text[i : i + index.run] in windows for i in starts.tolist())


def asked(index: Index, texts: list[str]) -> tuple[list[int], list[int]]:
    """(text number, passage id) of every text that shares a run with a passage."""
    at: list[int] = []
    hits: list[int] = []
    for a, b in shingles.slices([len(t) for t in texts]):
        codes, offsets = folded(texts[a:b])
        doc, pos, hashes = shingles.grams(codes, offsets, index.n)
        some = np.flatnonzero(index.seen[hashes & np.uint64(len(index.seen) - 1)])
        doc, pos, hashes = doc[some], pos[some], hashes[some]
        row = np.searchsorted(index.terms, hashes)
        row[row == len(index.terms)] = 0
        known = index.terms[row] == hashes
        doc, pos, row = doc[known], pos[known], row[known]
        cuts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1], True]) if len(doc) else []
        for i, j in zip(cuts[:-1], cuts[1:]):
            near = retrieve(index, np.unique(row[i:j]))
            if near:
                d = int(doc[i])
                own = codes[offsets[d] : offsets[d + 1]].tobytes().decode("utf-32-le", "surrogatepass")
                for p in near:
                    if shares_run(index, p, own, pos[i:j]):
                        at.append(a + d)
                        hits.append(index.ids[p])
    return at, hits


def leaked_passages(
    docs: DataFrame, tests: DataFrame, doc_id: str = "doc_id", passage_id: str = "passage_id", text: str = "text",
    run: int = 30, n: int = 15, index_chars: int = INDEX_CHARS,
) -> DataFrame:
    """(doc_id, passage_id) of documents with `run` consecutive folded characters of a passage.

    Null ids and null, empty and short texts on either side are no cases; equal passages are all
    reported. The test set is indexed in parts of index_chars code points, which bound what is built on the driver and broadcast at once.
    Documents are read once however many parts there are, and never shuffled but for the final distinct.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(
        F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0)
    )
    schema = ", ".join(
        f"{c} {df.schema[k].dataType.simpleString()}"
        for c, df, k in (("doc_id", docs, doc_id), ("passage_id", tests, passage_id))
    )
    parts = []
    for ids, texts in _parts(tests, passage_id, text, index_chars):
        index = build_index(ids, texts, n, run)
        if index is not None:
            parts.append(spark.sparkContext.broadcast(index))
    if not parts:
        return spark.createDataFrame([], schema)
    return source.mapInArrow(_searcher(parts), schema).distinct()


def leak_report(found: DataFrame, tests: DataFrame, passage_id: str = "passage_id", subset: str = "subset") -> DataFrame:
    """(passage_id, subset, n_docs) of the passages that leaked."""
    counts = found.groupBy("passage_id").agg(F.count("*").alias("n_docs"))
    names = tests.select(F.col(passage_id).alias("passage_id"), F.col(subset).alias("subset")).dropDuplicates(["passage_id"])
    return counts.join(names, "passage_id", "left").select("passage_id", "subset", "n_docs")


def _parts(tests: DataFrame, passage_id: str, text: str, index_chars: int) -> Iterator[tuple[list[int], list[str]]]:
    ids: list[int] = []
    texts: list[str] = []
    total = 0
    rows = tests.where(F.col(passage_id).isNotNull() & F.col(text).isNotNull()).select(passage_id, text).distinct()
    for row in rows.toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        total += len(row[1])
        if total > index_chars:
            yield ids, texts
            ids, texts, total = [], [], 0
    if ids:
        yield ids, texts


def _searcher(parts: list):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answers(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                index: Index = part.value
                for batch in held:
                    at, hits = asked(index, batch.column(1).to_pylist())
                    passages = np.array(hits, index.ids.dtype)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(passages)], ["doc_id", "passage_id"])
                if len(parts) > 1:
                    vars(part).pop("_value", None)  # one index at a time in memory

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.column(1).nbytes
            if len(parts) == 1 or size > 3 * ASKED_CHARS:
                yield from answers(held)
                held, size = [], 0
        if held:
            yield from answers(held)

    return search
