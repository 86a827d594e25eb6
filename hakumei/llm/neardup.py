"""Near-duplicate records with small edits.

Method: fast similarity sketching (rounds of hashed bin placement that fill
every coordinate), banding of the sketch, exact verification of the pairs that
share a band. See similarity for the stages and for nulls, empty texts, copies
and extra columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import materialise
from .components import connected_components
from .similarity import Similarity, colliding_classes, sketched, text_classes, verified, within_radius


@dataclass
class NearDuplicates:
    """members: doc_id, rep of its class of equal texts. links: rep_a, rep_b, similarity between classes."""

    members: DataFrame
    links: DataFrame


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", sim: Similarity = Similarity()) -> NearDuplicates:
    """Classes of equal squeezed texts and all links of `least` or more between them.

    A document in no class (null, empty or too short) appears nowhere; a class
    without links appears in members only. Documents of one class are copies of
    each other (similarity 1) and aren't listed as pairs. An empty table gives
    empty members and links.
    """
    sketches = materialise(sketched(df, doc_id, text, sim), "sketches")
    classes = text_classes(sketches)
    # every pair that shares a band is verified
    links = verified(within_radius(colliding_classes(sketches, classes, df, doc_id, text, sim), classes, None), df, doc_id, text, sim)
    reps = classes.select("hi", "lo", "rep")
    members = sketches.select("doc_id", "hi", "lo").distinct().join(reps, ["hi", "lo"]).select("doc_id", "rep")
    return NearDuplicates(materialise(members, "members"), materialise(links, "links"))


def document_pairs(found: NearDuplicates) -> DataFrame:
    """All pairs doc_id_a < doc_id_b: copies of one text, and members of linked classes."""
    a, b = (found.members.select(F.col("doc_id").alias(f"doc_id_{x}"), F.col("rep").alias(f"rep_{x}")) for x in "ab")
    several = found.members.groupBy("rep").count().where("count > 1").select("rep")
    copies = found.members.join(several, "rep")
    left, right = (copies.select("rep", F.col("doc_id").alias(f"doc_id_{x}")) for x in "ab")
    same = left.join(right, "rep").where("doc_id_a < doc_id_b").select("doc_id_a", "doc_id_b")
    linked = found.links.join(a, "rep_a").join(b, "rep_b").select(
        F.least("doc_id_a", "doc_id_b").alias("doc_id_a"), F.greatest("doc_id_a", "doc_id_b").alias("doc_id_b")
    )
    return same.unionByName(linked).distinct()


def duplicate_groups(found: NearDuplicates) -> DataFrame:
    """One row per document: group_id (smallest doc_id of all it is linked to, directly or not) and its number of linked classes."""
    edges = found.links.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    parts = connected_components(edges)
    degree = (
        edges.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    )
    joined = found.members.join(parts.withColumnRenamed("node", "rep"), "rep", "left").join(degree, "rep", "left")
    return joined.select(
        "doc_id",
        F.col("rep").alias("class_id"),
        F.coalesce("component", "rep").alias("group_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
