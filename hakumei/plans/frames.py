"""Views of the driver's tables that several queries share, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import spans as S
from ..operators import match

_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
_NARROW = "".join(map(chr, range(0x21, 0x7F))) + " "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer partitions than cores, such as one small file, redistributed; a large table stays as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def exploded(df: DataFrame, keys: list[str], column: str, fields: tuple[str, ...] | str = "*") -> DataFrame:
    """One row per element. The outer form keeps the optimiser from adding a filter that would compute the array twice."""
    rows = df.select(*keys, F.explode_outer(column).alias("s")).where("s is not null")
    return rows.select(*keys, "s.*") if fields == "*" else rows.select(*keys, *(F.col(f"s.{f}").alias(f) for f in fields))


def narrow(col: Column) -> Column:
    """Full-width ASCII and the ideographic space to ASCII: the part of normalisation SQL can express too."""
    return F.translate(col, _WIDE, _NARROW)


def subset_name(col: Column) -> Column:
    """Subset in one spelling; null and empty are train."""
    name = F.lower(F.regexp_replace(narrow(col), r"^\s+|\s+$", ""))
    return F.when(name.isNull() | (name == ""), "train").otherwise(name)


def documents(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Annotated documents once each, the row loaded last: doc_id, text, spans, subset and the further columns asked for.

    Only the columns a query uses are moved for it.
    """
    fields = ("text", "spans", "subset", *more)
    rows = table(spark, sf_dir, "annotated_docs").groupBy("doc_id").agg(*(F.max_by(c, "loaded_at").alias(c) for c in fields))
    return rows.select("doc_id", "text", F.coalesce("spans", S.no_spans()).alias("spans"), subset_name(F.col("subset")).alias("subset"), *more)


def deliveries(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Annotated documents as often as they were delivered, without a shuffle: for what is done row by row."""
    rows = table(spark, sf_dir, "annotated_docs")
    return rows.select("doc_id", "text", F.coalesce("spans", S.no_spans()).alias("spans"), subset_name(F.col("subset")).alias("subset"), *more)


def positives(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return documents(spark, sf_dir, *more).where(F.col("subset").isin("validation", "test", "ood"))


def negatives(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return documents(spark, sf_dir, *more).where("subset = 'negatives'")


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positives and negatives in one table: doc_id, spans, negative, n_chars. Texts aren't moved."""
    rows = table(spark, sf_dir, "annotated_docs").select("doc_id", "spans", "subset", F.length("text").alias("n_chars"), "loaded_at")
    once = rows.groupBy("doc_id").agg(*(F.max_by(c, "loaded_at").alias(c) for c in ("spans", "subset", "n_chars")))
    docs = once.withColumn("subset", subset_name(F.col("subset"))).where(F.col("subset").isin("validation", "test", "ood", "negatives"))
    return docs.select("doc_id", F.coalesce("spans", S.no_spans()).alias("spans"), (F.col("subset") == "negatives").alias("negative"), "n_chars")


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_name, doc_id, spans)"""
    return match.spans_by_document(table(spark, sf_dir, "predictions"))


def shaped(df: DataFrame) -> DataFrame:
    """Results as compared: integers as bigint, doubles to nine places."""
    kinds = {f.name: f.dataType for f in df.schema}
    return df.select(
        *(
            F.round(c, 9).alias(c) if isinstance(t, T.DoubleType)
            else F.col(c).cast("long").alias(c) if isinstance(t, (T.IntegerType, T.ShortType, T.ByteType))
            else F.col(c)
            for c, t in kinds.items()
        )
    )


# ---- the same as SQL

def narrow_sql(text: str) -> str:
    low = _NARROW.replace("'", "''")
    return f"translate({text}, '{_WIDE}', '{low}')"


SUBSET_SQL = (
    "coalesce(nullif(lower(regexp_replace(" + narrow_sql("subset") + r", '^\s+|\s+$', '', 'g')), ''), 'train')"
)
SPAN_SQL = "STRUCT(start_pos INTEGER, end_pos INTEGER, label VARCHAR, text VARCHAR, score DOUBLE, source VARCHAR)"
DOCS_SQL = (
    f"docs AS (SELECT DISTINCT ON (doc_id) doc_id, text, coalesce(spans, []::{SPAN_SQL}[]) AS spans, {SUBSET_SQL} AS subset, "
    "genre, negative_kinds FROM annotated_docs)"
)
POS_SQL = "pos AS (SELECT * FROM docs WHERE subset IN ('validation', 'test', 'ood'))"
NEG_SQL = "neg AS (SELECT * FROM docs WHERE subset = 'negatives')"
PRED_SQL = (
    "pred AS (SELECT run_name, doc_id, list_sort(list(DISTINCT s)) AS spans FROM (SELECT run_name, doc_id, "
    "{'start_pos': start_pos, 'end_pos': end_pos, 'label': label, 'text': coalesce(text, ''), 'score': coalesce(score, 1.0), "
    "'source': coalesce(source, 'model')} AS s FROM predictions WHERE run_name IS NOT NULL AND doc_id IS NOT NULL "
    "AND label IS NOT NULL AND start_pos >= 0 AND end_pos > start_pos) GROUP BY run_name, doc_id)"
)


def sorted_sql(spans: str, *keys: str) -> str:
    """The list sorted by expressions over x, ties in their order."""
    fields = ", ".join(f"'k{n}': {k}" for n, k in enumerate(keys))
    return f"list_transform(list_sort(list_transform({spans}, lambda x, i: {{{fields}, 'i': i, 's': x}})), lambda t: t.s)"


def by_position_sql(spans: str) -> str:
    return sorted_sql(spans, "x.start_pos", "x.end_pos")


def by_score_sql(spans: str) -> str:
    return sorted_sql(spans, "-x.score", "-(x.end_pos - x.start_pos)", "x.start_pos")


def greedy_sql(spans: str, kind: str = SPAN_SQL) -> str:
    return (
        f"list_reduce({spans}, lambda acc, c: CASE WHEN len(list_filter(acc, lambda k: k.start_pos < c.end_pos AND "
        f"c.start_pos < k.end_pos)) > 0 THEN acc ELSE list_append(acc, c) END, []::{kind}[])"
    )


def present_sql(spans: str) -> str:
    return f"list_filter({spans}, lambda x: x IS NOT NULL AND x.start_pos >= 0 AND x.end_pos > x.start_pos)"
