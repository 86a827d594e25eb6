"""Shared plumbing of the training-data operators: reading tables, names of sources and subsets.

Intermediate tables go to the cluster's shared folder, see sources.tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import materialise, put_file, release, shared_dir

__all__ = [
    "SOURCE_GENRES", "SUBSETS", "bounded_rows", "canonical_subset", "fold_code", "materialise", "put_file", "release", "shared_dir", "table",
    "true_genre", "true_source",
]

#: The six sources with their genre, and the spellings of a source that are
#: folded to it. Fixed values of the test data's description.
SOURCE_GENRES = {
    "aozora": "novel",
    "wikipedia_ja": "wiki",
    "egov_law": "law",
    "town_notice": "notice",
    "qa_board": "qa",
    "radio_script": "script",
}

#: Subsets of annotated documents; null or empty means train.
SUBSETS = ("train", "validation", "test", "ood", "negatives")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """Rows of a table that is small by definition; more than limit rows are an error, not cut off."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows")
    return rows


#: Full-width ASCII to ASCII, for names and codes in the JVM.
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = "".join(map(chr, range(0x21, 0x7F)))


def fold_code(col: Column) -> Column:
    """A name or code without width forms, case and surrounding blanks."""
    return F.lower(F.regexp_replace(F.translate(col, _WIDE, _NARROW), r"(?U)^\s+|\s+$", ""))


def canonical_subset(col: Column) -> Column:
    """train, validation, test, ood or negatives whatever the spelling; null and empty are train."""
    folded = fold_code(col)
    return F.when(folded.isNull() | (folded == ""), F.lit("train")).otherwise(folded)


def true_source(item_id: Column) -> Column:
    """The first part of an item_id."""
    return F.split(item_id, ":")[0]


def true_genre(item_id: Column) -> Column:
    """Genre of an item's true source; null where the source is none of the six."""
    source = true_source(item_id)
    pairs = [x for pair in SOURCE_GENRES.items() for x in map(F.lit, pair)]
    return F.create_map(*pairs)[source]
