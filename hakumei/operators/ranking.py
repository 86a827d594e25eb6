"""Running totals and ranks over keys that may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def running_totals(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, sizes: dict[str, Column]) -> DataFrame:
    """For each name in `sizes` the sum of its column over the rows before each row within `keys`, in the order (bucket, *order).

    Sums are taken per (key, bucket) first, the few bucket sums are accumulated in one
    small window, and only rows of one bucket are sorted together. `bucket` is an int that grows
    with the order and spreads the rows, such as a hash prefix or a score step.
    """
    rows = df.withColumn("_bucket", bucket).withColumns({f"_size_{n}": c.cast("long") for n, c in sizes.items()})
    sums = rows.groupBy(*keys, "_bucket").agg(*(F.sum(f"_size_{n}").alias(f"_sum_{n}") for n in sizes))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_bucket", *(F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_base_{n}") for n in sizes))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"_inner_{n}": F.coalesce(F.sum(f"_size_{n}").over(inside), F.lit(0)) for n in sizes})
    joined = rows.join(sums, [*keys, "_bucket"])
    out = joined.withColumns({n: F.col(f"_base_{n}") + F.col(f"_inner_{n}") for n in sizes})
    return out.drop("_bucket", *(f"_{x}_{n}" for n in sizes for x in ("size", "base", "inner")))


def running_total(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, size: Column, out: str) -> DataFrame:
    """One running total, see running_totals."""
    return running_totals(df, keys, order, bucket, {out: size})
