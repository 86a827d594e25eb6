"""Reversible masking: placeholders numbered per document and label, the mapping kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions import text as X
from ..functions import vocab

_SEP = "\u0001"


def with_mask(
    df: DataFrame, text: str, spans: str, masked: str = "masked", entries: str = "mask_map", style: str = "angle", fold: bool = True
) -> DataFrame:
    """Adds the masked text and the mapping array<struct<placeholder, original, label, start_pos, end_pos>>.

    Spans that overlap an earlier (then longer) one are skipped. Equal originals of one label
    share a placeholder, compared after NFKC if `fold`; numbers follow the first appearance. Offsets in
    the mapping are those of the given text. Null text gives null, null spans mask nothing. A text
    that already holds a generated placeholder is reported by `collisions`.
    """
    t = F.col(text)
    rows = df.withColumn("_s", S.first_from_left(S.plain(F.col(spans))))
    originals = F.transform("_s", lambda s: F.when(F.length(s["text"]) > 0, s["text"]).otherwise(X.slice_of(t, s["start_pos"], s["end_pos"])))
    rows = rows.withColumn("_o", originals)
    joined = F.array_join(F.transform("_o", lambda o: F.translate(o, _SEP, "\u0002")), _SEP)
    rows = rows.withColumn("_k", F.split(X.nfkc(joined) if fold else joined, _SEP, -1))
    keys = F.transform("_s", lambda s, i: F.concat(s["label"], F.lit(_SEP), F.get("_k", i)))
    rows = rows.withColumn("_k", keys).withColumn("_u", F.array_distinct("_k"))

    def entry(s: Column, i: Column) -> Column:
        own = F.filter("_u", lambda k: F.startswith(k, F.concat(s["label"], F.lit(_SEP))))
        n = F.array_position(own, F.get("_k", i))
        return F.struct(
            X.placeholder(s["label"], n, style).alias("placeholder"), F.get("_o", i).alias("original"),
            s["label"].alias("label"), s["start_pos"].alias("start_pos"), s["end_pos"].alias("end_pos"),
        )

    rows = rows.withColumn(entries, F.transform("_s", entry))
    pieces = F.transform(
        entries,
        lambda e, i: F.concat(
            X.slice_of(t, F.coalesce(F.get(F.col(entries), i - 1)["end_pos"], F.lit(0)), e["start_pos"]), e["placeholder"]
        ),
    )
    last = F.coalesce(F.get(F.col(entries), F.size(entries) - 1)["end_pos"], F.lit(0))
    out = F.when(t.isNotNull(), F.concat(F.array_join(pieces, ""), F.substring(t, last + 1, F.length(t))))
    return rows.withColumn(masked, out).drop("_s", "_o", "_k", "_u")


def unmasked(text: Column, entries: Column) -> Column:
    """Placeholders of any style replaced by their originals; unknown ones stay, the last entry of a placeholder counts."""
    between = F.split(text, vocab.PLACEHOLDER, -1)
    found = F.regexp_extract_all(text, F.lit(vocab.PLACEHOLDER), F.lit(0))

    def back(p: Column) -> Column:
        own = F.filter(entries, lambda e: e["placeholder"] == p)
        return F.coalesce(F.get(own, F.size(own) - 1)["original"], p)

    restored = F.concat(F.transform(found, back), F.array(F.lit("")))
    return F.when(F.size(entries) > 0, F.array_join(F.zip_with(between, restored, lambda a, b: F.concat(a, b)), "")).otherwise(text)


def collisions(text: Column, entries: Column) -> Column:
    """Generated placeholders that stand in the text already, which unmasking would rewrite."""
    return F.array_distinct(F.filter(F.transform(entries, lambda e: e["placeholder"]), lambda p: F.contains(text, p)))


def summary(df: DataFrame, doc_id: str, entries: str = "mask_map") -> DataFrame:
    """What was masked, without originals: (doc_id, placeholder, label, label_ja, start_pos, end_pos, length, preview)."""
    names = F.create_map(*(F.lit(x) for label, ja, _ in vocab.PII_TYPES for x in (label, ja)))
    e = F.col("e")
    return df.select(F.col(doc_id).alias("doc_id"), F.explode(entries).alias("e")).select(
        "doc_id", e["placeholder"].alias("placeholder"), e["label"].alias("label"), names[e["label"]].alias("label_ja"),
        e["start_pos"].alias("start_pos"), e["end_pos"].alias("end_pos"), F.length(e["original"]).alias("length"),
        X.summary_preview(e["original"]).alias("preview"),
    )


def mapping_rows(df: DataFrame, doc_id: str, entries: str = "mask_map") -> DataFrame:
    """The sensitive mapping as a table of its own: (doc_id, ordinal, placeholder, original, label, start_pos, end_pos)."""
    return df.select(F.col(doc_id).alias("doc_id"), F.posexplode(entries).alias("ordinal", "e")).select("doc_id", "ordinal", "e.*")


def originals(entries: Column) -> Column:
    """Distinct originals in order of appearance."""
    return F.array_distinct(F.transform(entries, lambda e: e["original"]))


def placeholders(entries: Column) -> Column:
    return F.array_distinct(F.transform(entries, lambda e: e["placeholder"]))
