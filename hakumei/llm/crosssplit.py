"""Same or near-same records across splits.

Method: bit fingerprints of a similarity hash. A text's code holds CODE_BITS bits of each of
its sketch's coordinates; blocks of five coordinates (40 bits) of the code are joined
across splits, pairs whose whole codes lie within the Hamming radius are verified on the texts and
counted per evaluation subset and source. Signs of random projections (SimHash) were
rejected: at similarity 0.70 two 64-bit codes differ in 12 bits on average and 20 at times, so
that no block longer than 3 bits is sure to agree, while unrelated texts differ in 30. See
similarity for nulls, copies and empty tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import canonical_subset, materialise
from .similarity import Similarity, colliding_classes, sketched, text_classes, verified, within_radius

#: Bits of each coordinate in the code.
CODE_BITS = 8

#: Bits of the code (of 1600) in which two texts may differ. At similarity 0.70 they differ in 240 on average, with a deviation of
#: 28, so a pair is beyond the radius with a probability of 1e-9; unrelated texts differ in 800.
RADIUS = 420

TRAIN, EVALUATION = 1, 2


@dataclass
class Overlaps:
    """members: doc_id, side (TRAIN or EVALUATION), subset, rep; links: rep_a, rep_b, similarity between different texts."""

    members: DataFrame
    links: DataFrame


def split_overlaps(
    df: DataFrame, subset: Column, doc_id: str = "doc_id", text: str = "text", sim: Similarity = Similarity(code_bits=CODE_BITS, radius=RADIUS)
) -> Overlaps:
    """Links between texts of the train subset and of all others.

    subset: name of the subset in any spelling; null and empty are train.
    """
    side = F.when(canonical_subset(subset) == "train", F.lit(TRAIN)).otherwise(F.lit(EVALUATION))
    sketches = materialise(sketched(df, doc_id, text, sim, side, canonical_subset(subset)), "fingerprints")
    classes = text_classes(sketches)
    pairs = within_radius(colliding_classes(sketches, classes, df, doc_id, text, sim), classes, sim.radius)
    links = verified(pairs, df, doc_id, text, sim)
    members = sketches.select("doc_id", "side", "subset", "hi", "lo").distinct().join(classes.select("hi", "lo", "rep"), ["hi", "lo"])
    return Overlaps(materialise(members.select("doc_id", "side", "subset", "rep"), "members"), materialise(links, "links"))


def linked_classes(found: Overlaps) -> DataFrame:
    """(rep_t, rep_e, similarity): classes linked from train to evaluation; a class is linked to itself."""
    both = found.links.select(F.col("rep_a").alias("rep_t"), F.col("rep_b").alias("rep_e"), "similarity").unionByName(
        found.links.select(F.col("rep_b").alias("rep_t"), F.col("rep_a").alias("rep_e"), "similarity")
    )
    crossing = found.members.groupBy("rep").agg(F.bit_or("side").alias("sides")).where(f"sides = {TRAIN | EVALUATION}")
    same = crossing.select(F.col("rep").alias("rep_t"), F.col("rep").alias("rep_e"), F.lit(1.0).alias("similarity"))
    return both.unionByName(same)


def crossing_pairs(found: Overlaps) -> DataFrame:
    """All pairs (train_id, eval_id, similarity) of a train and an evaluation document."""
    train = found.members.where(F.col("side") == TRAIN).select(F.col("doc_id").alias("train_id"), F.col("rep").alias("rep_t"))
    held = found.members.where(F.col("side") == EVALUATION).select(F.col("doc_id").alias("eval_id"), F.col("rep").alias("rep_e"))
    return linked_classes(found).join(train, "rep_t").join(held, "rep_e").select("train_id", "eval_id", "similarity").distinct()


def overlap_report(found: Overlaps, sources: DataFrame) -> DataFrame:
    """(subset, source, n_pairs, n_eval_docs, n_train_docs) by subset and source of the evaluation document.

    Counted from classes and their numbers of members, so no pair of documents is ever built. sources:
    doc_id, source, each document once; a null source is reported as null.
    """
    held = found.members.where(F.col("side") == EVALUATION).join(sources, "doc_id", "left")
    held = held.groupBy("rep", "subset", "source").agg(F.count("*").alias("n_eval")).withColumnRenamed("rep", "rep_e")
    train = found.members.where(F.col("side") == TRAIN).groupBy("rep").agg(F.count("*").alias("n_train")).withColumnRenamed("rep", "rep_t")
    linked = linked_classes(found).select("rep_t", "rep_e").join(train, "rep_t").join(held, "rep_e")
    linked = materialise(linked, "linked-classes")
    by = ["subset", "source"]
    counts = (
        linked.groupBy(*by).agg(F.sum(F.col("n_train") * F.col("n_eval")).alias("n_pairs")),
        linked.select(*by, "rep_e", "n_eval").distinct().groupBy(*by).agg(F.sum("n_eval").alias("n_eval_docs")),
        linked.select(*by, "rep_t", "n_train").distinct().groupBy(*by).agg(F.sum("n_train").alias("n_train_docs")),
    )
    every = counts[0].unionByName(counts[1], allowMissingColumns=True).unionByName(counts[2], allowMissingColumns=True)
    return every.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("n_pairs", "n_eval_docs", "n_train_docs")))
