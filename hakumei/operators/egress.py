"""The egress guard: nothing leaves that contains a masked original in any of three forms."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocab
from . import mask as M

_SEP = "\u0001"


class EgressViolation(RuntimeError):
    """A payload contained a forbidden value; the message shows its first and last character only."""


class Transport(Protocol):
    def send(self, payload: str) -> str: ...


class EchoTransport:
    """Answers with what it was sent."""

    def send(self, payload: str) -> str:
        return payload


class RecordingTransport:
    """Keeps everything it was sent, for tests."""

    def __init__(self, answer: str = "") -> None:
        self.answer, self.sent = answer, []

    def send(self, payload: str) -> str:
        self.sent.append(payload)
        return self.answer or payload


def with_violation(df: DataFrame, payload: str, forbidden: str, out: str = "violation") -> DataFrame:
    """Adds struct<form string, preview string>: the first forbidden value found in the payload, null if it is clean.

    Values of fewer than three characters are exempt. Forms: as it is; after NFKC on both
    sides; digits only, for values with seven digits and sixty per cent digits at least, against all digits
    of the payload, across its borders too. Null payloads are clean.
    """
    values = F.array_distinct(F.filter(F.coalesce(F.col(forbidden), F.array().cast("array<string>")), lambda v: F.length(v) >= vocab.GUARD_MIN_CHARS))
    rows = df.withColumn("_v", values).withColumn("_pn", X.nfkc(F.col(payload)))
    joined = F.array_join(F.transform("_v", lambda v: F.translate(v, _SEP, "\u0002")), _SEP)
    rows = rows.withColumn("_vn", F.split(X.nfkc(joined), _SEP, -1)).withColumn("_pd", X.digits(F.col(payload)))
    p = F.col(payload)

    def found(v: Column, i: Column) -> Column:
        folded = F.get("_vn", i)
        form = F.when(F.contains(p, v), "raw").when((folded != "") & F.contains(F.col("_pn"), folded), "nfkc")
        return F.struct(form.alias("form"), X.preview(v).alias("preview"))

    def numeric(v: Column) -> Column:
        d = X.digits(v)
        fit = (F.length(d) >= vocab.GUARD_MIN_DIGITS) & (F.length(d) >= F.length(v) * F.lit(vocab.GUARD_DIGIT_SHARE))
        form = F.when(fit & F.contains(F.col("_pd"), d), "digits")
        return F.struct(form.alias("form"), X.preview(d).alias("preview"))

    hits = F.filter(F.concat(F.transform("_v", found), F.transform("_v", numeric)), lambda h: h["form"].isNotNull())
    return rows.withColumn(out, F.get(hits, F.lit(0))).drop("_v", "_pn", "_vn", "_pd")


def clean(df: DataFrame, payload: str, forbidden: str) -> DataFrame:
    """Rows that may leave."""
    return with_violation(df, payload, forbidden, "_x").where("_x is null").drop("_x")


def quarantined(df: DataFrame, payload: str, forbidden: str) -> DataFrame:
    """Rows that may not, with form and preview of the value found."""
    rows = with_violation(df, payload, forbidden, "_x").where("_x is not null")
    return rows.withColumns({"form": F.col("_x.form"), "preview": F.col("_x.preview")}).drop("_x")


def strict(df: DataFrame, payload: str, forbidden: str) -> DataFrame:
    """The same rows; the job fails at the first that contains a forbidden value, naming only its preview."""
    rows = with_violation(df, payload, forbidden, "_x")
    message = F.concat(F.lit("forbidden value ("), F.col("_x.form"), F.lit(") in payload: "), F.col("_x.preview"))
    checked = F.when(F.col("_x").isNotNull(), F.raise_error(message).cast("string")).otherwise(F.col(payload))
    return rows.withColumn(payload, checked).drop("_x")


def round_trip(
    df: DataFrame, text: str, spans: str, transport: Callable[[], Transport], instruction: str = "", style: str = "angle"
) -> DataFrame:
    """Mask, guard, send, unmask: adds masked, payload, blocked, response_masked and response.

    `transport` builds one transport per partition. A payload that contains an original,
    instruction included, is never sent: blocked is true and both responses are null. The mapping
    stays in the column mask_map and isn't part of what the transport sees.
    """
    rows = M.with_mask(df, text, spans, style=style)
    head = f"{instruction}\n\n" if instruction else ""
    rows = rows.withColumn("payload", F.concat(F.lit(head), F.col("masked"))).withColumn("_f", M.originals(F.col("mask_map")))
    rows = with_violation(rows, "payload", "_f", "_x").withColumn("blocked", F.col("_x").isNotNull()).drop("_f", "_x")

    def send(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        channel = transport()
        for batch in batches:
            yield pd.Series([None if p is None else channel.send(p) for p in batch], dtype=object)

    sender = F.pandas_udf(send, "string").asNondeterministic()  # a call outside is made once per row
    rows = rows.withColumn("response_masked", sender(F.when(~F.col("blocked"), F.col("payload"))))
    return rows.withColumn("response", M.unmasked(F.col("response_masked"), F.col("mask_map")))


def send_all(df: DataFrame, payload: str, forbidden: str, transport: Callable[[], Transport]) -> int:
    """Sends every clean payload from the executors; returns how many were blocked."""
    blocked = df.sparkSession.sparkContext.accumulator(0)
    rows = with_violation(df, payload, forbidden, "_x").select(payload, F.col("_x").isNull().alias("ok"))

    def run(part) -> None:
        channel = transport()
        for row in part:
            if row["ok"]:
                channel.send(row[payload])
            else:
                blocked.add(1)

    rows.foreachPartition(run)
    return blocked.value
