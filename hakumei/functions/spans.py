"""Algebra of spans kept as arrays of structs: sorting, overlap, greedy selection, mapping.

A span is struct<start_pos int, end_pos int, label string, text string, score double, source string>;
operators accept arrays of structs with at least the fields they use and keep the others.
All folds run inside one row, so no operator here shuffles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start_pos:int,end_pos:int,label:string,text:string,score:double,source:string>"

Key = Callable[[Column], Column]


def no_spans(kind: str = SPAN) -> Column:
    """An empty array. It is given as a literal of its type because taking none of an array would compute that array again."""
    return F.array().cast(f"array<{kind}>")


def present(spans: Column, kind: str = SPAN) -> Column:
    """The spans, none for null; null elements and spans without proper borders are left out."""
    kept = F.filter(spans, lambda s: s.isNotNull() & (s["start_pos"] >= 0) & (s["end_pos"] > s["start_pos"]))
    return F.coalesce(kept, no_spans(kind))


def plain(spans: Column) -> Column:
    """Spans with the six fields of SPAN only."""
    fields = ("start_pos", "end_pos", "label", "text", "score", "source")
    return F.transform(spans, lambda s: F.struct(*(s[f].alias(f) for f in fields)).cast(SPAN))


def overlaps(a: Column, b: Column) -> Column:
    return (a["start_pos"] < b["end_pos"]) & (b["start_pos"] < a["end_pos"])


def length(s: Column) -> Column:
    return s["end_pos"] - s["start_pos"]


def intersection(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a["end_pos"], b["end_pos"]) - F.greatest(a["start_pos"], b["start_pos"]))


def iou(a: Column, b: Column) -> Column:
    """Characters in both divided by characters in either, as double."""
    both = intersection(a, b)
    return both.cast("double") / (length(a) + length(b) - both)


def ordered(spans: Column, *keys: Key) -> Column:
    """Sorted by the keys ascending; ties keep their order."""
    keyed = F.transform(
        spans, lambda s, i: F.struct(*(k(s).alias(f"k{n}") for n, k in enumerate(keys)), i.alias("i"), s.alias("s"))
    )
    return F.transform(F.sort_array(keyed), lambda t: t["s"])


def by_position(spans: Column) -> Column:
    return ordered(spans, lambda s: s["start_pos"], lambda s: s["end_pos"])


def by_score(spans: Column) -> Column:
    """Highest score first, then longest, then leftmost."""
    return ordered(spans, lambda s: -s["score"], lambda s: -length(s), lambda s: s["start_pos"])


def greedy(sorted_spans: Column, kind: str = SPAN) -> Column:
    """Those that overlap none of the ones kept before them, in the given order."""
    return F.aggregate(
        sorted_spans,
        no_spans(kind),
        lambda kept, s: F.when(F.exists(kept, lambda k: overlaps(k, s)), kept).otherwise(F.concat(kept, F.array(s))),
    )


def resolve_by_score(spans: Column) -> Column:
    """Overlaps resolved in favour of the score, then length, then position; sorted by position."""
    return by_position(greedy(by_score(present(spans))))


def without_overlap(spans: Column, others: Column) -> Column:
    """Spans that overlap none of the others."""
    return F.filter(spans, lambda s: ~F.exists(others, lambda o: overlaps(s, o)))


def first_from_left(spans: Column) -> Column:
    """Left to right, the longer first at equal starts, without overlaps (what a mask replaces). Each span is compared with the last one kept only."""

    def take(kept: Column, s: Column) -> Column:
        last = F.get(kept, F.size(kept) - 1)
        return F.when(last.isNotNull() & (last["end_pos"] > s["start_pos"]), kept).otherwise(F.concat(kept, F.array(s)))

    return F.aggregate(ordered(present(spans), lambda s: s["start_pos"], lambda s: -length(s)), no_spans(), take)


def _first_of_equal(sorted_spans: Column, same: Callable[[Column, Column], Column]) -> Column:
    """The first of each run of equal neighbours."""

    def step(acc: Column, s: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        return F.when(last.isNotNull() & same(last, s), acc).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(sorted_spans, no_spans(), step)


def _same_borders(a: Column, b: Column) -> Column:
    return (a["start_pos"] == b["start_pos"]) & (a["end_pos"] == b["end_pos"])


def dedupe_max_score(spans: Column) -> Column:
    """For each (start_pos, end_pos) the highest score, the first among equals; sorted by position."""
    best = ordered(present(spans), lambda s: s["start_pos"], lambda s: s["end_pos"], lambda s: -s["score"])
    return _first_of_equal(best, _same_borders)


def merged_windows(spans: Column, text: Column) -> Column:
    """Spans found in overlapping windows as one list.

    Equal (start, end, label): the highest score stays. A span that overlaps the one
    before it and has its label is united with it at the lower score. What still overlaps
    is resolved by score.
    """
    best = ordered(present(spans), lambda s: s["start_pos"], lambda s: s["end_pos"], lambda s: s["label"], lambda s: -s["score"])
    distinct = _first_of_equal(best, lambda a, b: _same_borders(a, b) & (a["label"] == b["label"]))

    def step(acc: Column, s: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        start, end = F.least(last["start_pos"], s["start_pos"]), F.greatest(last["end_pos"], s["end_pos"])
        joined = F.struct(
            start.alias("start_pos"), end.alias("end_pos"), s["label"].alias("label"),
            F.substring(text, start + 1, end - start).alias("text"),
            F.least(last["score"], s["score"]).alias("score"), last["source"].alias("source"),
        )
        unite = last.isNotNull() & (last["label"] == s["label"]) & (last["end_pos"] > s["start_pos"])
        return F.when(unite, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(
            F.concat(acc, F.array(s))
        )

    united = F.aggregate(distinct, no_spans(), step)
    return by_position(greedy(by_score(united)))


def merged(model: Column, rules: Column, rule_types: tuple[str, ...], least: float = 0.0) -> Column:
    """Rule and model spans in five steps; each result has source 'merged' and `origin`.

    1 rule spans of the rule types, left to right without overlaps; 2 model spans that overlap one
    of them go; 3 model spans below `least` go, rule spans never; 4 the others are resolved by
    score; 5 all are sorted by position.
    """
    accepted = greedy(by_position(F.filter(present(rules), lambda s: s["label"].isin(*rule_types))))
    left = F.filter(without_overlap(present(model), accepted), lambda s: s["score"] >= least)

    def tagged(spans: Column, origin: str) -> Column:
        return F.transform(
            spans,
            lambda s: F.struct(
                s["start_pos"].alias("start_pos"), s["end_pos"].alias("end_pos"), s["label"].alias("label"),
                s["text"].alias("text"), s["score"].alias("score"), F.lit("merged").alias("source"), F.lit(origin).alias("origin"),
            ),
        )

    return by_position(F.concat(tagged(accepted, "rule"), tagged(greedy(by_score(left)), "model")))
