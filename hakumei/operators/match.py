"""Matching of predicted to gold spans, detection rates, false positives, the fixed-FPR sweep.

Matching runs inside a document's row on arrays; only the outcome is exploded and
aggregated. A document without predictions of a run needs no row of that run: what it
misses follows from the gold counts, so no runs x documents product is ever built.

The sweep over thresholds reads documents and predictions once: `evaluation` keeps, for each
run, label and score, by how much true and false positives change there. Rates at any threshold, the
threshold itself and the whole curve are sums of these changes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions import vocab
from ..sources.tables import materialise
from . import kernels
from .ranking import running_totals

MODES = ("exact", "partial")


def _bare(spans: Column) -> Column:
    """What matching needs of spans."""
    return F.transform(spans, lambda s: F.struct(*(s[f].alias(f) for f in ("start_pos", "end_pos", "label", "score"))))


def _checked(mode: str) -> str:
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    return mode


def matched(gold: Column, predicted: Column, mode: str = "partial") -> Column:
    """array<struct<g int, p int>>: indices of spans matched one to one, sorted by gold span.

    exact: equal borders and label. partial: equal label and overlap; conflicts are settled by
    IoU, score, gold start, predicted start, then by order in the arrays. Only pairs that overlap are ever built.
    """
    _checked(mode)
    run = lambda g, p: kernels.matches(g, p, mode)
    return kernels.arrow_function(run, kernels.MATCH)(_bare(gold), _bare(predicted))


def first_fit(gold: Column, predicted: Column) -> Column:
    """Number of predictions that, in their order, find a gold span of their label that overlaps and isn't taken."""

    def take(used: Column, p: Column) -> Column:
        free = F.filter(
            F.transform(gold, lambda g, i: F.struct(i.alias("i"), ((g["label"] == p["label"]) & S.overlaps(g, p)).alias("fit"))),
            lambda x: x["fit"] & ~F.array_contains(used, x["i"]),
        )
        return F.when(F.size(free) > 0, F.array_append(used, F.get(free, F.lit(0))["i"])).otherwise(used)

    return F.size(F.aggregate(predicted, F.array().cast("array<int>"), take))


def spans_by_document(rows: DataFrame, run: str = "run_name", doc_id: str = "doc_id") -> DataFrame:
    """(run, doc_id, spans) of long prediction rows, each distinct row once.

    A null score counts as 1, as for a span without one; a null run, document, label or
    border is no prediction. Spans are sorted by position, score and the other fields, so ties are settled alike everywhere.
    """
    s = F.struct(
        "start_pos", "end_pos", "label", F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("score", F.lit(1.0)).alias("score"), F.coalesce("source", F.lit("model")).alias("source"),
    )
    kept = rows.where(
        F.col(run).isNotNull() & F.col(doc_id).isNotNull() & F.col("label").isNotNull()
        & (F.col("start_pos") >= 0) & (F.col("end_pos") > F.col("start_pos"))
    )
    distinct = kept.select(F.col(run).alias("run_name"), F.col(doc_id).alias("doc_id"), s.alias("s")).distinct()
    return distinct.groupBy("run_name", "doc_id").agg(F.sort_array(F.collect_list("s")).alias("spans"))


def outcomes(docs: DataFrame, predicted: DataFrame, mode: str = "partial") -> DataFrame:
    """(run_name, doc_id, outcome, label, score, ...) of every prediction: tp or fp; and of every gold span met: hit or miss.

    docs: doc_id, spans (gold), each document once. Predictions for other documents are ignored.
    """
    gold = docs.select("doc_id", S.by_position(S.present(F.col("spans"))).alias("gold"))
    rows = predicted.join(gold, "doc_id").withColumn("m", matched(F.col("gold"), F.col("spans"), mode))
    of = lambda s, outcome: F.struct(
        outcome.alias("outcome"), s["start_pos"].alias("start_pos"), s["end_pos"].alias("end_pos"), s["label"].alias("label"),
        s["text"].alias("text"), s["score"].alias("score"),
    )
    taken = lambda field, i: F.exists("m", lambda k: k[field] == i)
    every = F.concat(
        F.transform("spans", lambda s, i: of(s, F.when(taken("p", i), "tp").otherwise("fp"))),
        F.transform("gold", lambda s, i: of(s, F.when(taken("g", i), "hit").otherwise("miss"))),
    )
    return rows.select("run_name", "doc_id", F.explode(every).alias("o")).select("run_name", "doc_id", "o.*")


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 as doubles; 0 where the denominator is 0."""
    zero = F.lit(0.0)
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(zero)
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(zero)
    return p, r, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(zero)


def detection_rates(docs: DataFrame, predicted: DataFrame, mode: str = "partial") -> DataFrame:
    """(run_name, label, tp, fp, fn, support, precision, recall, f1): one row per label, and 'micro' and 'macro'.

    micro sums all labels; macro averages those with gold spans. All documents count for every run.
    """
    return rates(evaluation(docs.select("doc_id", "text", "spans", F.lit(False).alias("negative")), predicted, mode))


def _rated(counts: DataFrame, support: DataFrame) -> DataFrame:
    """Rates from (run_name, label, tp, fp) and (run_name, label, support), with 'micro' and 'macro'; a run's labels are few."""
    zero = F.lit(0).cast("long")
    both = counts.select("run_name", "label", "tp", "fp", zero.alias("support")).unionByName(
        support.select("run_name", "label", zero.alias("tp"), zero.alias("fp"), "support")
    )
    sums = ("tp", "fp", "support")
    full = both.groupBy("run_name", "label").agg(*(F.sum(c).alias(c) for c in sums)).withColumn("fn", F.col("support") - F.col("tp"))
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    numbers, shares = ("tp", "fp", "fn", "support"), ("precision", "recall", "f1")
    row = F.struct("label", *numbers, *(c.alias(n) for n, c in zip(shares, (p, r, f))))
    averages = (F.coalesce(F.avg(F.when(F.col("support") > 0, c)), F.lit(0.0)).alias(f"_{n}") for n, c in zip(shares, (p, r, f)))
    runs = full.groupBy("run_name").agg(F.collect_list(row).alias("rows"), *(F.sum(c).alias(c) for c in numbers), *averages)
    micro = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    lines = [F.struct(F.lit("micro").alias("label"), *numbers, *(c.alias(n) for n, c in zip(shares, micro)))]
    lines.append(F.struct(F.lit("macro").alias("label"), *numbers, *(F.col(f"_{n}").alias(n) for n in shares)))
    every = runs.withColumn("rows", F.concat("rows", F.array(*lines)))
    return every.select("run_name", F.explode("rows").alias("s")).select("run_name", "s.*")


def span_scores(docs: DataFrame, predicted: DataFrame) -> DataFrame:
    """(run_name, mode, tp, fp, fn) over the documents with predictions: exact as sets of keys, partial by first fit in order of prediction."""
    gold = docs.select("doc_id", S.by_position(S.present(F.col("spans"))).alias("gold"))
    rows = predicted.join(gold, "doc_id")
    key = lambda spans: F.array_distinct(F.transform(spans, lambda s: F.struct(s["start_pos"], s["end_pos"], s["label"])))
    g, p = key(F.col("gold")), key(F.col("spans"))
    both = F.size(F.array_intersect(g, p))
    fit = first_fit(F.col("gold"), F.col("spans"))
    modes = F.array(
        F.struct(F.lit("exact").alias("mode"), both.alias("tp"), (F.size(p) - both).alias("fp"), (F.size(g) - both).alias("fn")),
        F.struct(F.lit("partial").alias("mode"), fit.alias("tp"), (F.size("spans") - fit).alias("fp"), (F.size("gold") - fit).alias("fn")),
    )
    return rows.select("run_name", F.explode(modes).alias("m")).groupBy("run_name", "m.mode").agg(
        *(F.sum(F.col(f"m.{c}").cast("long")).alias(c) for c in ("tp", "fp", "fn"))
    )


def fp_report(negatives: DataFrame, predicted: DataFrame) -> DataFrame:
    """(run_name, n_docs, n_chars, n_fp, n_docs_with_fp, fp_per_doc, fp_per_1000_chars, doc_level_fp_rate) over documents without gold.

    negatives: doc_id, text, each document once; null text has no characters. Every prediction on them is false.
    """
    total = negatives.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("n_chars"))
    on = predicted.join(negatives.select("doc_id"), "doc_id", "left_semi").groupBy("run_name").agg(
        F.sum(F.size("spans")).cast("long").alias("n_fp"), F.sum((F.size("spans") > 0).cast("long")).alias("n_docs_with_fp")
    )
    runs = predicted.select("run_name").distinct().join(on, "run_name", "left").na.fill(0, ["n_fp", "n_docs_with_fp"])
    return _fp_rated(runs, total)


def _fp_rated(counts: DataFrame, total: DataFrame) -> DataFrame:
    """The three rates from (run_name, n_fp, n_docs_with_fp) and one row (n_docs, n_chars)."""
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return counts.join(F.broadcast(total), F.lit(True)).withColumns(  # one row
        {
            "fp_per_doc": rate(F.col("n_fp"), F.col("n_docs")),
            "fp_per_1000_chars": rate(F.col("n_fp") * 1000.0, F.col("n_chars")),
            "doc_level_fp_rate": rate(F.col("n_docs_with_fp"), F.col("n_docs")),
        }
    )


def fp_by_type(negatives: DataFrame, predicted: DataFrame) -> DataFrame:
    on = predicted.join(negatives.select("doc_id"), "doc_id", "left_semi")
    return on.select("run_name", F.explode("spans").alias("s")).groupBy("run_name", F.col("s.label").alias("label")).agg(
        F.count("*").alias("n_fp")
    )


def fp_by_negative_kind(negatives: DataFrame, predicted: DataFrame) -> DataFrame:
    """All false positives of a document count once for each entry of its negative_kinds, repeated entries included."""
    on = predicted.join(negatives.select("doc_id", "negative_kinds"), "doc_id")
    return on.select("run_name", F.explode("negative_kinds").alias("kind"), F.size("spans").alias("n")).groupBy(
        "run_name", "kind"
    ).agg(F.sum("n").cast("long").alias("n_fp"))


FPR_METRICS = ("per_doc", "doc_level", "per_1000_chars")
FPR_COLUMN = {"per_doc": "fp_per_doc", "doc_level": "doc_level_fp_rate", "per_1000_chars": "fp_per_1000_chars"}

#: Points of a curve; the chosen threshold is drawn beside them.
CURVE_POINTS = 256

# Rows of an evaluation that aren't about spans found: a run, a document with false positives, documents of either side, gold spans of a label.
_RUN, _DOC, _POSITIVES, _NEGATIVES, _GOLD = "#run", "#doc", "#positives", "#negatives", "#gold "
_ENTRY = "array<struct<run_name:string,label:string,score:double,tp:int,fp:int>>"


@dataclass
class Evaluation:
    """changes: run_name, negative, label, score, tp, fp (how they change at the score); totals: label, n, n_chars."""

    changes: DataFrame
    totals: DataFrame


def evaluation(docs: DataFrame, predicted: DataFrame, mode: str = "partial") -> Evaluation:
    """What the sweep needs of documents and predictions, from one pass over either; small and materialised.

    docs: doc_id, spans, negative (boolean) and text or n_chars, each document once. Predictions for other documents are ignored, but their run is known.
    """
    _checked(mode)
    chars = F.col("n_chars") if "n_chars" in docs.columns else F.length("text")
    gold = F.when(F.col("negative"), S.no_spans()).otherwise(S.present(F.col("spans")))
    sides = docs.select("doc_id", "negative", _bare(gold).alias("gold"), F.coalesce(chars, F.lit(0)).cast("int").alias("n_chars"))
    found = predicted.select("doc_id", F.struct("run_name", _bare(F.col("spans")).alias("spans")).alias("p"))
    rows = sides.join(found.groupBy("doc_id").agg(F.collect_list("p").alias("runs")), "doc_id", "full")
    rows = rows.withColumn("gold", S.by_position(F.col("gold"))).select("negative", "gold", "n_chars", F.posexplode_outer("runs").alias("k", "p"))
    run = lambda g, p: kernels.levels(g, p, mode)
    spans = F.when(F.col("negative").isNotNull(), F.col("p.spans"))
    rows = rows.withColumn("levels", kernels.arrow_function(run, kernels.LEVEL)(F.col("gold"), spans))

    def entry(run_name: Column, label: Column, score: Column, tp: Column, fp: Column) -> Column:
        return F.struct(run_name.alias("run_name"), label.alias("label"), score.alias("score"), tp.alias("tp"), fp.alias("fp"))

    none, name = F.lit(None).cast("double"), F.col("p.run_name")
    every = F.concat(
        F.transform("levels", lambda c: entry(name, c["label"], c["score"], c["tp"], c["fp"])),
        _if(name.isNotNull(), F.array(entry(name, F.lit(_RUN), none, F.lit(0), F.lit(0)))),
        _if(F.col("negative") & (F.size("p.spans") > 0), F.array(entry(name, F.lit(_DOC), F.array_max("p.spans.score"), F.lit(0), F.lit(1)))),
        # what a document has without predictions, once
        _if(
            F.col("negative").isNotNull() & (F.coalesce("k", F.lit(0)) == 0),
            F.concat(
                F.array(entry(F.lit(None).cast("string"), F.when(F.col("negative"), _NEGATIVES).otherwise(_POSITIVES), none, F.lit(1), F.col("n_chars"))),
                F.transform("gold", lambda g: entry(F.lit(None).cast("string"), F.concat(F.lit(_GOLD), g["label"]), none, F.lit(1), F.lit(0))),
            ),
        ),
    )
    exploded = rows.select("negative", F.explode(every).alias("c")).select("negative", "c.*")
    changes = exploded.groupBy("run_name", "negative", "label", "score").agg(*(F.sum(c).cast("long").alias(c) for c in ("tp", "fp")))
    changes = materialise(changes, "changes")
    label = F.col("label")
    whole = changes.where(label.isin(_POSITIVES, _NEGATIVES) | label.startswith(_GOLD))
    name = F.when(label.startswith(_GOLD), F.substring(label, len(_GOLD) + 1, F.length(label))).otherwise(label)
    return Evaluation(changes, whole.select(name.alias("label"), F.col("tp").alias("n"), F.col("fp").alias("n_chars")))


def _if(condition: Column, entries: Column) -> Column:
    return F.when(condition, entries).otherwise(F.array().cast(_ENTRY))


def _side(ev: Evaluation, negative: bool) -> DataFrame:
    return ev.changes.where(F.col("negative") == negative).where(~F.col("label").startswith("#"))


def _negatives(ev: Evaluation) -> DataFrame:
    """One row: n_docs, n_chars of the negatives."""
    own = ev.totals.where(F.col("label") == _NEGATIVES)
    return own.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("n_chars"))


def _runs(ev: Evaluation) -> DataFrame:
    return ev.changes.where(F.col("label") == _RUN).select("run_name").distinct()


def _at_least(changes: DataFrame, thresholds: DataFrame | None) -> DataFrame:
    if thresholds is None:
        return changes
    return changes.join(F.broadcast(thresholds.select("run_name", "threshold")), "run_name").where("score >= threshold")  # a row per detector


def rates(ev: Evaluation, thresholds: DataFrame | None = None) -> DataFrame:
    """detection_rates of the positives, with only the spans that reach the threshold of their run if there are thresholds."""
    counts = _at_least(_side(ev, False), thresholds).groupBy("run_name", "label").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"))
    support = ev.totals.where(~F.col("label").startswith("#")).select("label", F.col("n").alias("support"))
    names = _runs(ev).agg(F.collect_set("run_name").alias("runs"))  # the names of the detectors
    support = support.join(F.broadcast(names), F.lit(True)).select(F.explode("runs").alias("run_name"), "label", "support")
    return _rated(counts, support)


def fp_rates(ev: Evaluation, thresholds: DataFrame | None = None) -> DataFrame:
    """fp_report of the negatives, with only the spans that reach the threshold of their run if there are thresholds."""
    reach = F.lit(True) if thresholds is None else F.col("score") >= F.col("threshold")
    count = lambda c: F.coalesce(F.sum(F.when(F.col("negative") & reach & c, F.col("fp"))), F.lit(0))
    rows = ev.changes.where("run_name is not null")
    if thresholds is not None:
        rows = rows.join(F.broadcast(thresholds.select("run_name", "threshold")), "run_name")  # a row per detector
    label = F.col("label")
    counts = rows.groupBy("run_name").agg(count(~label.startswith("#")).alias("n_fp"), count(label == _DOC).alias("n_docs_with_fp"))
    return _fp_rated(counts, _negatives(ev))


def operating_points(ev: Evaluation, target: float = 0.05, metric: str = "per_doc") -> DataFrame:
    """(run_name, threshold, rank, size, fpr, recall, meets) at every threshold of the grid, ranked from 0 upwards.

    The grid of a run are its scores, rounded to 12 places, and one above the largest, at which nothing is left. Sums are taken by score steps,
    so no run's scores are sorted in one task.
    """
    if metric not in FPR_METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    label = F.col("label")
    counts = ~label.startswith("#")
    event = F.col("negative") & ((label == _DOC) if metric == "doc_level" else counts)
    scored = ev.changes.where(F.col("score").isNotNull() & F.col("negative").isNotNull()).groupBy("run_name", F.round("score", 12).alias("score")).agg(
        F.sum(F.when(event, F.col("fp")).otherwise(0)).alias("events"), F.sum(F.when(counts & ~F.col("negative"), F.col("tp")).otherwise(0)).alias("tp")
    )
    whole = scored.groupBy("run_name").agg(
        (F.max("score") + 1e-6).alias("above"), F.sum("events").alias("all_events"), F.sum("tp").alias("all_tp"), (F.count("*") + 1).alias("size")
    )
    below = running_totals(
        scored, ["run_name"], [F.col("score")], F.floor(F.col("score") * 1024).cast("int"),
        {"rank": F.lit(1), "events_below": F.col("events"), "tp_below": F.col("tp")},
    )
    joined = below.join(F.broadcast(whole), "run_name")  # a row per detector
    inside = joined.select(
        "run_name", F.col("score").alias("threshold"), "rank", "size",
        (F.col("all_events") - F.col("events_below")).alias("events"), (F.col("all_tp") - F.col("tp_below")).alias("tp"),
    )
    zero = F.lit(0).cast("long")
    top = whole.select("run_name", F.col("above").alias("threshold"), (F.col("size") - 1).alias("rank"), "size", zero.alias("events"), zero.alias("tp"))
    support = ev.totals.where(~label.startswith("#")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("support"))
    points = inside.unionByName(top).join(F.broadcast(_negatives(ev)), F.lit(True)).join(F.broadcast(support), F.lit(True))  # one row each
    per = F.col("n_chars") / 1000.0 if metric == "per_1000_chars" else F.col("n_docs").cast("double")
    # counts are compared, so that a rate of exactly the target meets it
    return points.select(
        "run_name", "threshold", "rank", "size", F.coalesce(F.try_divide("events", per), F.lit(0.0)).alias("fpr"),
        F.coalesce(F.try_divide("tp", "support"), F.lit(0.0)).alias("recall"),
        ((F.col("events") <= F.lit(max(target, 0.0)) * per + 1e-9) | (F.col("n_docs") == 0)).alias("meets"),
    )


def fixed_fpr_threshold(ev: Evaluation, points: DataFrame, target: float = 0.05) -> DataFrame:
    """(run_name, threshold, degenerate): the least threshold at which the false-positive rate is at most `target`, or 0 if that is negative."""
    best = points.groupBy("run_name").agg(
        F.min(F.when(F.col("meets"), F.col("threshold"))).alias("t"), F.max("threshold").alias("above"), F.max("size").alias("size")
    )
    runs = _runs(ev).join(best, "run_name", "left").join(F.broadcast(_negatives(ev)), F.lit(True))
    unreachable = F.lit(target) < 0
    reason = (
        F.when(F.col("above").isNull(), "no_predictions").when(F.col("n_docs") == 0, "no_negatives")
        .when(unreachable, "target_unreachable").when(F.col("t") == F.col("above"), "only_empty_predictions_meet_target")
    )
    threshold = F.when(F.col("above").isNull(), F.lit(0.0)).otherwise(F.coalesce("t", "above"))
    return runs.select("run_name", threshold.alias("threshold"), reason.alias("degenerate"))


@dataclass
class FixedRate:
    """What holds at the threshold of each run, and around it."""

    ev: Evaluation
    target: float
    metric: str
    points: int
    grid: DataFrame
    chosen: DataFrame

    @property
    def by_type(self) -> DataFrame:
        """detection_rates of the spans that reach the threshold."""
        return rates(self.ev, self.chosen)

    @property
    def overall(self) -> DataFrame:
        """(run_name, threshold, fpr, recall, precision, f1, macro_recall, n_kept, achieved, degenerate)"""
        of = lambda label, c: F.max(F.when(F.col("label") == label, F.col(c)))
        rated = self.by_type.groupBy("run_name").agg(
            *(of("micro", c).alias(c) for c in ("recall", "precision", "f1")), of("macro", "recall").alias("macro_recall"),
            (of("micro", "tp") + of("micro", "fp")).alias("n_kept"),
        )
        fpr = fp_rates(self.ev, self.chosen).select("run_name", F.col(FPR_COLUMN[self.metric]).alias("fpr"))
        joined = self.chosen.join(rated, "run_name", "left").join(fpr, "run_name", "left")
        zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
        return joined.select(
            "run_name", "threshold", *map(zero, ("fpr", "recall", "precision", "f1", "macro_recall")), F.coalesce("n_kept", F.lit(0)).alias("n_kept"),
            (F.coalesce("fpr", F.lit(0.0)) <= self.target).alias("achieved"), "degenerate",
        )

    @property
    def curve(self) -> DataFrame:
        """(run_name, threshold, fpr, recall, chosen) at every threshold of the grid, or at `points` of them evenly by rank and the chosen one."""
        step = (F.col("size") - 1) / F.lit(float(max(self.points - 1, 1)))
        near = F.floor(F.col("rank") / step)
        even = (F.col("size") <= self.points) | F.exists(F.sequence(near - 1, near + 1), lambda k: F.bround(k * step) == F.col("rank"))
        is_chosen = F.col("threshold") == F.col("_t")
        at = self.chosen.select("run_name", F.col("threshold").alias("_t"))
        rows = self.grid.join(F.broadcast(at), "run_name").where(even | is_chosen)  # a row per detector
        return rows.select("run_name", "threshold", "fpr", "recall", is_chosen.alias("chosen"))


def at_fixed_fpr(ev: Evaluation, target: float = 0.05, metric: str = "per_doc", points: int = CURVE_POINTS) -> FixedRate:
    """Recall with the false-positive rate held at `target`: over all, by label, and as a curve. The thresholds, a row per detector, are fixed at once."""
    grid = operating_points(ev, target, metric)
    found = fixed_fpr_threshold(ev, grid, target)
    chosen = ev.changes.sparkSession.createDataFrame(found.collect(), found.schema)  # a row per detector
    return FixedRate(ev, target, metric, points, grid, chosen)


def sides(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """Documents of both sides as `evaluation` takes them."""
    fields = ["doc_id", "text", "spans"]
    return positives.select(*fields, F.lit(False).alias("negative")).unionByName(
        negatives.select("doc_id", "text", S.no_spans().alias("spans"), F.lit(True).alias("negative"))
    )


def recall_at_fixed_fpr(
    predicted: DataFrame, positives: DataFrame, negatives: DataFrame, target: float = 0.05, metric: str = "per_doc", mode: str = "partial"
) -> DataFrame:
    """The rows `overall` of at_fixed_fpr."""
    return at_fixed_fpr(evaluation(sides(positives, negatives), predicted, mode), target, metric).overall


def type_histogram(spans: DataFrame, column: str = "spans") -> DataFrame:
    return spans.select(F.explode(column).alias("s")).groupBy(F.col("s.label").alias("label")).agg(F.count("*").alias("n"))


def label_dimension(spark) -> DataFrame:
    """The ten kinds of personal data."""
    rows = [(i, *t, t[0] in vocab.RULE_DETERMINISTIC, t[0] in vocab.MODEL_DRIVEN) for i, t in enumerate(vocab.PII_TYPES)]
    return spark.createDataFrame(rows, "ordinal int, label string, ja string, en string, rule_deterministic boolean, model_driven boolean")
