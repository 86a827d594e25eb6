"""Synthetic documents with known spans, in parallel: which base text and which random numbers a document gets follows from its number."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spans as S
from . import invent
from .align import numbered
from .invent import GENRES, romaji_text

LICENSE = "synthetic (CC0-1.0)"
DOCUMENT = (
    f"doc_id string, text string, spans array<{S.SPAN}>, subset string, genre string, source_license string, source_ref string, negative_kinds array<string>"
)


def romaji(col: Column, long_vowel: bool = True) -> Column:
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else romaji_text(v, long_vowel))

    return F.pandas_udf(run, "string")(col)


def base_texts(items: DataFrame, item_id: str = "item_id") -> DataFrame:
    """(number, base, license, ref): usable items numbered from 0 in order of their ids, as `documents` takes them."""
    rows = items.where((F.coalesce(F.col(item_id), F.lit("")) != "") & (F.coalesce("text", F.lit("")) != "")).dropDuplicates([item_id])
    ref = F.coalesce(*(F.when(F.col(c) != "", F.col(c)) for c in ("attribution", "source") if c in items.columns), F.col(item_id))
    license_ = F.col("license") if "license" in items.columns else F.lit(None).cast("string")
    chosen = rows.select(F.col(item_id).alias("_id"), F.col("text").alias("base"), license_.alias("license"), ref.alias("ref"))
    return numbered(chosen, F.col("_id"), out="number").drop("_id")


def _with_base(rows: DataFrame, bases: DataFrame | None, seed: int, share: float) -> DataFrame:
    """Adds base, license and ref to rows (id): for a share of them those of the base text with a hashed number."""
    if bases is None:
        return rows.withColumns({c: F.lit(None).cast("string") for c in ("base", "license", "ref")})
    count = bases.count()
    if not count:
        return _with_base(rows, None, seed, share)
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit("share"), "id"), 11).cast("double") / float(1 << 53)
    number = F.when(unit < share, F.pmod(F.xxhash64(F.lit(seed), F.lit("base"), "id"), F.lit(count)))
    return rows.withColumn("number", number).join(bases, "number", "left").drop("number")


def _spans(drafts: list[invent.Draft]) -> pa.Array:
    rows = [
        [{"start_pos": a, "end_pos": b, "label": label, "text": t, "score": 1.0, "source": "gold"} for a, b, label, t in d.spans] for d in drafts
    ]
    kind = pa.struct(
        [("start_pos", pa.int32()), ("end_pos", pa.int32()), ("label", pa.string()), ("text", pa.string()), ("score", pa.float64()), ("source", pa.string())]
    )
    return pa.array(rows, pa.list_(kind))


def documents(
    spark: SparkSession, n: int, seed: int = 0, subset: str = "train", prefix: str = "syn", genres: tuple[str, ...] = GENRES,
    bases: DataFrame | None = None, inject: float = 0.0, weights: dict[str, float] | None = None,
) -> DataFrame:
    """n documents with gold spans: doc_id, text, spans, subset, genre, source_license, source_ref, negative_kinds.

    Genres take turns. bases, from base_texts: three quarters of the documents get one, and its licence and reference if it was used.
    A third of the documents (35 %) is asked for 2 to 10 values. The first `inject` of all documents get one to three hard
    negatives, of kinds drawn by `weights`.
    """
    unknown = set(genres) - set(GENRES)
    if unknown or not genres:
        raise ValueError(f"unknown genres {sorted(unknown)}")
    rows = _with_base(spark.range(n), bases, seed, 0.75).select("id", "base", "license", "ref")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            drafts = []
            for i, base, license_, ref in zip(*(c.to_pylist() for c in batch.columns)):
                rng = random.Random(f"{seed}:{subset}:{i}")
                genre = genres[i % len(genres)]
                draft = invent.document(rng, genre, base, rng.randrange(2, 11) if rng.random() < 0.35 else None)
                text, kinds = draft.text, []
                if i < inject * n:
                    places = [s[:2] for s in draft.spans]
                    text, places, kinds = invent.injected(rng, text, places, rng.randrange(1, 4), weights)
                    draft.spans = [(a, b, *s[2:]) for (a, b), s in zip(places, draft.spans)]
                drafts.append(draft)
                used = draft.base_used
                fields = (f"{prefix}-{i:06d}", text, genre, (license_ if used else None) or LICENSE, (ref if used else None) or "", kinds)
                for column, x in zip(out, fields):
                    column.append(x)
            ids, texts, kind, licences, refs, kinds = out
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.string()), pa.array(texts, pa.string()), _spans(drafts), pa.array([subset] * len(ids), pa.string()),
                    pa.array(kind, pa.string()), pa.array(licences, pa.string()), pa.array(refs, pa.string()), pa.array(kinds, pa.list_(pa.string())),
                ],
                [c.split()[0] for c in _COLUMNS],
            )

    return rows.mapInArrow(run, DOCUMENT)


_COLUMNS = ("doc_id", "text", "spans", "subset", "genre", "source_license", "source_ref", "negative_kinds")


def ood_documents(spark: SparkSession, n: int, bases: DataFrame, seed: int = 0, prefix: str = "ood") -> DataFrame:
    """n documents at most, without templates: sentences with values between those of a base text, as `documents` has them.

    Base texts that normalisation would change are skipped, so there may be fewer.
    """
    rows = _with_base(spark.range(n), bases, seed, 1.0).where("base is not null").select("id", "base", "license", "ref")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for i, base, license_, ref in zip(*(c.to_pylist() for c in batch.columns)):
                draft = invent.prose(random.Random(f"{seed}:ood:{i}"), base)
                if draft is not None:
                    made.append((f"{prefix}-{i:06d}", draft, license_ or "unknown", ref))
            fixed = lambda x: pa.array([x] * len(made), pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([m[0] for m in made], pa.string()), pa.array([m[1].text for m in made], pa.string()), _spans([m[1] for m in made]),
                    fixed("ood"), fixed("ood_prose"), pa.array([m[2] for m in made], pa.string()), pa.array([m[3] for m in made], pa.string()),
                    pa.array([[] for _ in made], pa.list_(pa.string())),
                ],
                list(_COLUMNS),
            )

    return rows.mapInArrow(run, DOCUMENT)


def negative_documents(spark: SparkSession, n: int, seed: int = 0, weights: dict[str, float] | None = None, bases: DataFrame | None = None, prefix: str = "neg") -> DataFrame:
    """n documents without personal data, as `documents` has them: 72 % hard negatives, else half base sentences, half filler."""
    rows = _with_base(spark.range(n), bases, seed, 1.0).select("id", "base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bodies = (c.to_pylist() for c in batch.columns)
            made = [invent.negative_document(random.Random(f"{seed}:neg:{i}"), base, weights) for i, base in zip(ids, bodies)]
            fixed = lambda x: pa.array([x] * len(made), pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([f"{prefix}-{i:06d}" for i in ids], pa.string()), pa.array([m[0] for m in made], pa.string()), _spans([invent.Draft() for _ in made]),
                    fixed("negatives"), fixed("negatives"), fixed(LICENSE), fixed(""), pa.array([m[1] for m in made], pa.list_(pa.string())),
                ],
                list(_COLUMNS),
            )

    return rows.mapInArrow(run, DOCUMENT)


def build(
    spark: SparkSession, items: DataFrame, sizes: dict[str, int], seed: int = 0, inject: float = 0.45, weights: dict[str, float] | None = None
) -> DataFrame:
    """All subsets in one table: train, validation, test (with hard negatives in the first `inject` of each), ood and negatives.

    sizes: documents of each subset; ood are a quarter of test and 200 at least unless given. items: corpus items that lend their sentences.
    """
    bases = base_texts(items)
    wanted = {"ood": max(200, sizes.get("test", 0) // 4)} | sizes
    parts = [
        documents(spark, wanted.get(s, 0), seed + k, s, f"synth-{s}", bases=bases, inject=inject, weights=weights) for k, s in enumerate(("train", "validation", "test"))
    ]
    parts.append(ood_documents(spark, wanted["ood"], bases, seed + 700))
    parts.append(negative_documents(spark, wanted.get("negatives", 0), seed + 900, weights, bases))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
