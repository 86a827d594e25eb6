"""Visually identical text with different characters.

Method: compatibility normalisation in composed form, mapped blanks, hyphens and
line breaks, removal of default-ignorable characters, letters of different
scripts folded to one, vectorised per distinct value. Two parts of the named
method are narrowed because the result has to tell apart what a reader tells
apart: case is not folded, and compatibility forms with a look of their own
(superscripts, circled and fractional numbers, letter-like symbols) stay as they are.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters drawn alike, each string pair in the same order.
LATIN_OF_GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳ", "ABEZHIKMNOPTYXocj")
LATIN_OF_CYRILLIC = ("АВЕЅІЈКМНОРСТХҮԌԛԜаеорсухѕіјһԁԝӏ", "ABESIJKMHOPCTXYGqWaeopcyxsijhdwl")
KATAKANA_OF_KANJI = ("力工二八卜夕口丿厶", "カエニハトタロノム")
KATAKANA_OF_HIRAGANA = ("へべぺ", "ヘベペ")
HYPHENS = "-֊‐‑‒–—―⁃−﹘﹣－"
LINE_BREAKS = "\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]"

#: Compatibility forms of these kinds don't look like what they decompose to.
_OWN_LOOK = ("<super>", "<sub>", "<circle>", "<fraction>", "<square>")

_IGNORABLE = regex.compile(r"\p{Default_Ignorable_Code_Point}+|[\p{Cc}--[\t\n\x0b\x0c\r\x85]]+", regex.V1)
_BREAK = regex.compile(LINE_BREAKS)


@cache
def _alike() -> dict[int, str]:
    table: dict[int, str] = {}
    for others, letters in (LATIN_OF_GREEK, LATIN_OF_CYRILLIC, KATAKANA_OF_KANJI, KATAKANA_OF_HIRAGANA):
        table |= {ord(a): b for a, b in zip(others, letters, strict=True)}
    table |= {ord(c): "-" for c in HYPHENS}
    table |= {c: " " for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Zs"}
    return table | {ord("\t"): " "}


@cache
def _kept() -> regex.Pattern:
    """Characters that compatibility normalisation would turn into something that looks otherwise."""
    own = [
        chr(c)
        for c in range(0x80, sys.maxunicode + 1)
        if unicodedata.decomposition(chr(c)).startswith(_OWN_LOOK)
        or (0x2100 <= c < 0x2150 and unicodedata.decomposition(chr(c)).startswith("<compat>"))
    ]
    return regex.compile("([" + "".join(own) + "])")


def consistent_form(text: str) -> str:
    """One form for all texts that look alike; idempotent.

    Blanks of any kind become one space each, and so does a tab; a line break in any
    coding becomes one line feed. Empty text stays empty.
    """
    if text.isascii() and "\r" not in text and text.isprintable():
        return text
    text = _IGNORABLE.sub("", text)
    text = _BREAK.sub("\n", text)
    form = "".join(
        part if i % 2 else unicodedata.normalize("NFKC", part) for i, part in enumerate(_kept().split(text))
    )
    return unicodedata.normalize("NFC", _IGNORABLE.sub("", form).translate(_alike()))


def _forms(texts: list[str | None]) -> list[str | None]:
    known: dict[str | None, str | None] = {None: None}
    for t in texts:
        if t not in known:
            known[t] = consistent_form(t)
    return [known[t] for t in texts]


def normalised(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, form) for every row; null stays null, empty stays empty. Narrow, whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = pa.array(_forms(batch.column(1).to_pylist()), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), forms], ["doc_id", "form"])

    kind = df.schema[doc_id].dataType.simpleString()
    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, form string"
    )


def _identities(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, form, raw) with 128-bit hashes of form and stored text; texts without visible characters are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            forms = _forms(texts)
            seen = np.array([bool(f) and not f.isspace() for f in forms], bool)
            digest = [
                [xxhash.xxh3_128_digest(x) if ok else None for x, ok in zip(column, seen)] for column in (forms, texts)
            ]
            out = [batch.column(0), pa.array(digest[0], pa.binary()), pa.array(digest[1], pa.binary())]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "form", "raw"]).filter(pa.array(seen))

    kind = df.schema[doc_id].dataType.simpleString()
    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, form binary, raw binary"
    )


def lookalike_pairs(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: same consistent form, different stored code points.

    Copies of one stored text are no pair, in any number: a form that occurs in one
    coding only is dropped by an aggregate before anything is joined. Null texts,
    empty texts and texts without a visible character are no cases; a row given
    twice counts once. An empty table gives no rows.
    """
    from .base import materialise

    rows = materialise(_identities(df, doc_id, text).distinct(), "forms")
    several = rows.groupBy("form").agg(F.min("raw").alias("x"), F.max("raw").alias("y")).where("x != y").select("form")
    codings = rows.join(several, "form", "left_semi")
    classes = codings.select("form", "raw").distinct()
    a, b = (classes.select("form", F.col("raw").alias(f"raw_{x}")) for x in "ab")
    pairs = a.join(b, "form").where("raw_a < raw_b").select("raw_a", "raw_b")
    left, right = (codings.select(F.col("raw").alias(f"raw_{x}"), F.col("doc_id").alias(f"doc_{x}")) for x in "ab")
    found = pairs.join(left, "raw_a").join(right, "raw_b").where("doc_a != doc_b")
    return found.select(
        F.least("doc_a", "doc_b").alias("doc_id_a"), F.greatest("doc_a", "doc_b").alias("doc_id_b")
    ).distinct()
