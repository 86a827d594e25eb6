"""Hard negatives: classification of false positives, reweighting, injection."""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions import vocab
from . import invent, kernels

STRENGTH = 1.0


def reweighted(weights: DataFrame, counts: DataFrame, strength: float = STRENGTH) -> DataFrame:
    """(kind, weight): kinds with many false positives gain, none leaves [0.25 / K, 4 / K] before the last normalisation.

    weights: one row per kind, counts: (kind, n); kinds without counts have 0, negative counts count as 0, counts of
    other kinds count in the total. K rows, so the windows over all of them are small by definition.
    """
    every = Window.partitionBy(F.lit(1))
    total = counts.agg(F.coalesce(F.sum(F.greatest(F.col("n"), F.lit(0))), F.lit(0)).cast("double").alias("total"))
    rows = weights.select("kind", "weight").join(counts.groupBy("kind").agg(F.sum("n").alias("n")), "kind", "left")
    rows = rows.join(F.broadcast(total), F.lit(True))  # one row
    share = F.greatest(F.coalesce("n", F.lit(0)), F.lit(0)) / (F.col("total") + 1e-9)
    rows = rows.withColumn("w", F.col("weight") * (1.0 + strength * share)).withColumn("k", F.count("*").over(every))
    rows = rows.withColumn("w", F.col("w") / F.sum("w").over(every))
    rows = rows.withColumn("w", F.least(4.0 / F.col("k"), F.greatest(0.25 / F.col("k"), F.col("w"))))
    return rows.select("kind", (F.col("w") / F.sum("w").over(every)).alias("weight"))


def kind_of(surface: Column, text: Column, start: Column, end: Column, kinds: Column) -> Column:
    """Kind of a false positive: words around it, surname or place, the only kind of the document, else 'other'. A surface index comes before: see classified.

    Null fields never match.
    """
    around = X.context(text, start, end, vocab.CONTEXT_OF_KIND)
    by_words = [F.when(around.rlike(pattern), F.lit(kind)) for kind, pattern in vocab.KIND_PATTERNS]
    distinct = F.array_distinct(F.coalesce(kinds, F.array().cast("array<string>")))
    steps = [
        *by_words,
        F.when(surface.isin(*vocab.NOUN_SURNAMES), "common_noun_surname"),
        F.when(surface.isin(*vocab.PLACE_SURNAMES), "place_as_person"),
        F.when(F.size(distinct) == 1, F.get(distinct, F.lit(0))),
    ]
    return F.coalesce(*steps, F.lit("other"))


def classified(rows: DataFrame, surface: Column, kind: Column, index: DataFrame | None = None) -> DataFrame:
    """Adds kind: that of the surface in the index (surface, kind) where it is there, else the column given.

    The index is joined by its surface, each of which stands in it once, and may be of any size.
    """
    if index is None:
        return rows.withColumn("kind", kind)
    own = index.select(F.col("surface").alias("_surface"), F.col("kind").alias("_indexed"))
    found = rows.withColumns({"_surface": surface, "_kind": kind}).join(own, "_surface", "left")
    return found.withColumn("kind", F.coalesce("_indexed", "_kind")).drop("_surface", "_kind", "_indexed")


def surfaces(rows: DataFrame, kind: str = "kind", text: str = "text") -> DataFrame:
    """(surface, kind) of digit runs and of kanji and katakana runs; a surface keeps the least kind it occurs with."""
    found = F.concat(
        F.regexp_extract_all(F.col(text), F.lit(r"[0-9][0-9\-.]{4,}[0-9]"), F.lit(0)),
        F.regexp_extract_all(F.col(text), F.lit("[一-龥ァ-ヶА-я]{2,10}"), F.lit(0)),
    )
    return rows.select(F.explode(found).alias("surface"), F.col(kind).alias("kind")).groupBy("surface").agg(F.min("kind").alias("kind"))


def injected(df: DataFrame, doc_id: str, text: str, spans: str, kinds: str, k: int = 2, seed: int = 0, weights: dict[str, float] | None = None) -> DataFrame:
    """k hard negatives inserted at ends of lines or sentences outside all spans; later spans move along, kinds are appended.

    Null text stays null and gets none. Gold spans keep their text; none is added.
    """

    def run(ids: pa.Array, texts: pa.Array, places: pa.ListArray) -> pa.Array:
        out = []
        for i, t, own in zip(ids.to_pylist(), texts.to_pylist(), places.to_pylist()):
            borders = [(p["start_pos"], p["end_pos"]) for p in own or ()]
            new, borders, added = (t, borders, []) if t is None else invent.injected(random.Random(f"{seed}:{i}"), t, borders, k, weights)
            out.append({"text": new, "starts": [a for a, _ in borders], "kinds": added})
        return pa.array(out, pa.struct([("text", pa.string()), ("starts", pa.list_(pa.int32())), ("kinds", pa.list_(pa.string()))]))

    bare = F.transform(spans, lambda s: F.struct(s["start_pos"].alias("start_pos"), s["end_pos"].alias("end_pos")))
    new = kernels.arrow_function(run, "struct<text:string,starts:array<int>,kinds:array<string>>")(F.col(doc_id).cast("string"), F.col(text), bare)
    rows = df.withColumn("_new", new)
    at = lambda i: F.get(F.col("_new.starts"), i)
    moved = F.transform(spans, lambda s, i: s.withField("end_pos", s["end_pos"] - s["start_pos"] + at(i)).withField("start_pos", at(i)))
    none = F.array().cast("array<string>")
    return rows.withColumns({text: F.col("_new.text"), spans: moved, kinds: F.concat(F.coalesce(kinds, none), F.col("_new.kinds"))}).drop("_new")
