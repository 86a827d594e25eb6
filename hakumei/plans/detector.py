"""The detection facade: normalise, rule layer, model spans, calibration, threshold, merge, mask."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions import text as X
from ..functions import vocab
from ..operators import decode, mask, rules
from ..operators.calibrate import Calibrator


class SpanModel(Protocol):
    """Adds a column with model spans of the normalised text; no model comes with the engine."""

    def add_spans(self, df: DataFrame, text: str, out: str) -> DataFrame: ...


@dataclass
class PrecomputedSpans:
    """Model spans from a table (doc_id, spans), such as the output of a detector that ran elsewhere."""

    table: DataFrame
    doc_id: str = "doc_id"
    column: str = "spans"

    def add_spans(self, df: DataFrame, text: str, out: str) -> DataFrame:
        own = self.table.select(F.col(self.doc_id), F.col(self.column).alias(out))
        return df.join(own, self.doc_id, "left")


@dataclass
class TokenProbabilities:
    """Model spans decoded from a table (doc_id, win, tokens array<struct<start_pos, end_pos, probs>>), all windows of a document."""

    table: DataFrame
    doc_id: str = "doc_id"
    least: float = 0.05

    def add_spans(self, df: DataFrame, text: str, out: str) -> DataFrame:
        wide = df.select(self.doc_id, F.col(text).alias("_t")).join(self.table, self.doc_id)
        spans = decode.decode_bio(F.col("tokens"), F.col("_t"), self.least)
        one = wide.withColumn("_s", spans).groupBy(self.doc_id).agg(F.flatten(F.collect_list("_s")).alias("_s"), F.first("_t").alias("_t"))
        once = S.merged_windows(decode.refined(S.merged_windows(F.col("_s"), F.col("_t")), F.col("_t")), F.col("_t"))
        return df.join(one.select(self.doc_id, once.alias(out)), self.doc_id, "left")


@dataclass
class Detector:
    """Detection as one narrow transformation: the same on batch and streaming input, without a shuffle if there is no model table."""

    threshold: float = 0.5
    use_rules: bool = True
    model: SpanModel | None = None
    calibrator: Calibrator | None = None
    rule_types: tuple[str, ...] = vocab.RULE_DETERMINISTIC
    rules: Iterable[rules.Rule] | None = None
    style: str = "angle"

    def __post_init__(self) -> None:
        if not 0 <= self.threshold <= 1:
            raise ValueError(f"threshold {self.threshold} isn't between 0 and 1")
        if self.style not in vocab.STYLES:
            raise ValueError(f"unknown style {self.style!r}")
        if not self.use_rules and self.model is None:
            raise ValueError("neither rules nor a model")

    def detect(self, df: DataFrame, text: str = "text") -> DataFrame:
        """Replaces the text by its normalised form, in which offsets count, and adds spans. Null text has no spans."""
        rows = df.withColumn(text, X.normalize(F.col(text)))
        if self.use_rules:
            rows = rules.with_rule_spans(rows, text, "_rules", types=self.rule_types, rules=self.rules)
            found = F.transform("_rules", lambda s: F.struct(*(s[c].alias(c) for c in ("start_pos", "end_pos", "label", "text", "score", "source"))))
            rows = rows.withColumn("_rules", found)
        else:
            rows = rows.withColumn("_rules", S.no_spans())
        if self.model is not None:
            rows = self.model.add_spans(rows, text, "_model")
            if self.calibrator is not None:
                rows = rows.withColumn("_model", self.calibrator.spans(F.col("_model")))
        else:
            rows = rows.withColumn("_model", S.no_spans())
        return rows.withColumn("spans", S.merged(F.col("_model"), F.col("_rules"), tuple(self.rule_types), self.threshold)).drop("_rules", "_model")

    def redact(self, df: DataFrame, text: str = "text") -> DataFrame:
        """Adds masked and mask_map; keep the mapping apart (operators.mask.mapping_rows)."""
        return mask.with_mask(self.detect(df, text), text, "spans", style=self.style)
