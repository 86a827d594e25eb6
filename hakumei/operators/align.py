"""Predictions brought to their documents, by place in the order or by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import spans as S
from ..sources.tables import materialise


def numbered(df: DataFrame, *order: Column, out: str = "position") -> DataFrame:
    """Adds the place of each row in the order, from 0. Rows are sorted in ranges, and only the ranges' sizes are summed in one window."""
    rows = df.sort(*order).withColumn("_id", F.monotonically_increasing_id())
    rows = rows.withColumns({"_part": F.shiftright("_id", 33), "_row": F.col("_id").bitwiseAND((1 << 33) - 1)}).drop("_id")
    rows = materialise(rows, "numbered")
    before = Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    starts = rows.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    return rows.join(F.broadcast(starts), "_part").withColumn(out, F.col("_start") + F.col("_row")).drop("_part", "_row", "_start")


def aligned_by_position(docs: DataFrame, predictions: DataFrame, doc_order: Column, prediction_order: Column) -> DataFrame:
    """Documents with the column `predicted` of the predictions row (spans) in the same place; as many rows on either side, else an error."""
    a = numbered(docs, doc_order)
    b = numbered(predictions.select(F.col("spans").alias("predicted"), prediction_order.alias("_o")), F.col("_o")).drop("_o")
    n, m = a.count(), b.count()
    if n != m:
        raise ValueError(f"{n} documents, but {m} rows of predictions")
    return a.join(b, "position").withColumn("predicted", F.coalesce("predicted", S.no_spans()))


def aligned_by_id(docs: DataFrame, predictions: DataFrame, order: Column) -> DataFrame:
    """Documents with the column `predicted` of the predictions (doc_id, spans) under their id; none is an empty array.

    A document without an id, null or empty, is asked for under '#' and its place in the order.
    """
    rows = numbered(docs, order)
    rows = rows.withColumn("doc_id", F.when(F.coalesce("doc_id", F.lit("")) == "", F.concat(F.lit("#"), F.col("position").cast("string"))).otherwise(F.col("doc_id")))
    own = predictions.select("doc_id", F.col("spans").alias("predicted"))
    return rows.join(own, "doc_id", "left").withColumn("predicted", F.coalesce("predicted", S.no_spans()))
