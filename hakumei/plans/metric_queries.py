"""Queries of matching, detection metrics, calibration and the closed loop, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions import text as X
from ..functions import vocab
from ..operators import calibrate, match, negatives, synth
from ..sources.files import broken_spans
from ..sources.tables import materialise
from . import frames as V
from .frames import DOCS_SQL, NEG_SQL, POS_SQL, PRED_SQL, documents, predicted, shaped, table
from .frames import negatives as negative_docs
from .frames import positives as positive_docs

_OUTCOME = ("run_name", "doc_id", "outcome", "start_pos", "end_pos", "label", "score")

#: Knots of a fixed piecewise-linear calibrator, and a fixed temperature.
KNOTS_X, KNOTS_Y, TEMPERATURE = [0.1, 0.4, 0.6, 0.9], [0.05, 0.3, 0.7, 0.95], 1.7

#: Points of the curve that is asked for.
POINTS = 40


def match_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(match.outcomes(documents(spark, sf_dir), predicted(spark, sf_dir), "exact").select(*_OUTCOME))


def match_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(match.outcomes(documents(spark, sf_dir), predicted(spark, sf_dir)).select(*_OUTCOME))


def detection_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(match.detection_rates(positive_docs(spark, sf_dir), predicted(spark, sf_dir)))


def detection_rates_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(match.detection_rates(positive_docs(spark, sf_dir), predicted(spark, sf_dir), "exact"))


def span_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(match.span_scores(positive_docs(spark, sf_dir), predicted(spark, sf_dir)))


def fp_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(match.fp_report(negative_docs(spark, sf_dir), predicted(spark, sf_dir)))


def fp_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.fp_by_type(negative_docs(spark, sf_dir), predicted(spark, sf_dir))


def fp_by_negative_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.fp_by_negative_kind(negative_docs(spark, sf_dir, "negative_kinds"), predicted(spark, sf_dir))


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_name, kind) of every false positive on documents without gold."""
    docs = negative_docs(spark, sf_dir, "negative_kinds")
    rows = V.exploded(predicted(spark, sf_dir).join(docs.drop("spans"), "doc_id"), ["run_name", "text", "negative_kinds"], "spans", ("start_pos", "end_pos"))
    t = F.coalesce("text", F.lit(""))
    surface = X.slice_of(t, F.col("start_pos"), F.col("end_pos"))
    return rows.select("run_name", negatives.kind_of(surface, t, F.col("start_pos"), F.col("end_pos"), F.col("negative_kinds")).alias("kind"))


def fp_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kinds(spark, sf_dir).groupBy("run_name", "kind").agg(F.count("*").alias("n_fp"))


def fp_by_kind_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of false positives where known surfaces come first."""
    docs = negative_docs(spark, sf_dir, "negative_kinds")
    rows = V.exploded(predicted(spark, sf_dir).join(docs.drop("spans"), "doc_id"), ["run_name", "text", "negative_kinds"], "spans", ("start_pos", "end_pos"))
    t = F.coalesce("text", F.lit(""))
    surface = X.slice_of(t, F.col("start_pos"), F.col("end_pos"))
    kind = negatives.kind_of(surface, t, F.col("start_pos"), F.col("end_pos"), F.col("negative_kinds"))
    return negatives.classified(rows, surface, kind, surface_index(spark, sf_dir)).groupBy("run_name", "kind").agg(F.count("*").alias("n_fp"))


def softmax_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest probability of each embedding taken as logits, and their sum."""
    p = calibrate.softmax(F.col("embedding"))
    rows = table(spark, sf_dir, "embeddings").withColumn("p", p)
    return rows.select("vec_id", F.round(F.array_max("p"), 6).alias("p_top"), F.round(F.aggregate("p", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def reweight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New weights of the kinds after the false positives of all runs."""
    counts = _kinds(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"))
    return shaped(negatives.reweighted(table(spark, sf_dir, "kind_weights"), counts, 1.5))


def _evaluation(spark: SparkSession, sf_dir: str) -> match.Evaluation:
    return match.evaluation(V.evaluated(spark, sf_dir), predicted(spark, sf_dir))


def _fixed(metric: str, target: float):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shaped(match.at_fixed_fpr(_evaluation(spark, sf_dir), target, metric).overall)

    query.__name__ = f"recall_at_fpr_{metric}"
    return query


def recall_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates by label, micro and macro, at the threshold with 0.05 false positives a document."""
    return shaped(match.at_fixed_fpr(_evaluation(spark, sf_dir)).by_type)


def recall_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(match.at_fixed_fpr(_evaluation(spark, sf_dir), points=POINTS).curve)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_name, score, label): predictions on evaluation documents, 1 where one matched a gold span."""
    docs = documents(spark, sf_dir).where("subset != 'train'")
    rows = match.outcomes(docs, predicted(spark, sf_dir)).where(F.col("outcome").isin("tp", "fp"))
    return rows.select("run_name", "score", (F.col("outcome") == "tp").cast("int").alias("label"))


def calibration_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(_pairs(spark, sf_dir).groupBy("run_name", "label").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("score_sum")))


def ece_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(calibrate.bins(_pairs(spark, sf_dir), ["run_name"]))


def calibration_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(calibrate.calibration_errors(_pairs(spark, sf_dir), ["run_name"]))


def temperature_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "predictions").select("score").distinct()
    return shaped(rows.withColumn("calibrated", calibrate.tempered(F.col("score"), TEMPERATURE)))


def isotonic_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "predictions").select("score").distinct()
    return shaped(rows.withColumn("calibrated", calibrate.interpolated(F.col("score"), KNOTS_X, KNOTS_Y)))


def temperature_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temperature over the pairs of all runs, and the errors before and after."""
    pairs = materialise(_pairs(spark, sf_dir), "pairs")
    fitted = calibrate.fit_temperature(pairs)
    return _before_after(pairs, fitted, spark)


def isotonic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = materialise(_pairs(spark, sf_dir), "pairs")
    return _before_after(pairs, calibrate.fit_isotonic(pairs), spark)


def _before_after(pairs: DataFrame, fitted: calibrate.Calibrator, spark: SparkSession) -> DataFrame:
    both = pairs.withColumn("stage", F.lit("before")).unionByName(
        pairs.withColumns({"score": fitted.column(F.col("score")), "stage": F.lit("after")})
    )
    errors = calibrate.calibration_errors(both, ["stage"])
    return shaped(errors.withColumn("temperature", F.lit(fitted.temperature).cast("double")).withColumn("n_knots", F.lit(len(fitted.knots_x))))


def type_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.type_histogram(documents(spark, sf_dir))


def score_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per run: rates, false positives and their kinds, recall at 0.05 false positives a document, calibration.

    The calibration error is null unless both outcomes and more than two scores, rounded to 4 places, occur.
    """
    ev = _evaluation(spark, sf_dir)
    micro = match.rates(ev).where("label = 'micro'").select("run_name", "precision", "recall", "f1")
    fp = match.fp_rates(ev).select("run_name", "fp_per_doc", "fp_per_1000_chars", "doc_level_fp_rate")
    fixed = match.at_fixed_fpr(ev).overall.select(
        "run_name", "threshold", F.col("fpr").alias("fixed_fpr"), F.col("recall").alias("fixed_recall"), "degenerate"
    )
    kinds = fp_by_kind(spark, sf_dir).groupBy("run_name").agg(F.sort_array(F.collect_list(F.struct((-F.col("n_fp")).alias("n"), "kind"))).alias("k"))
    listed = F.array_join(F.transform("k", lambda x: F.concat_ws(" ", x["kind"], (-x["n"]).cast("string"))), ", ")
    errors = calibrate.gated_error(_pairs(spark, sf_dir), ["run_name"])
    joined = micro.join(fp, "run_name").join(fixed, "run_name").join(kinds.select("run_name", listed.alias("fp_kinds")), "run_name", "left")
    return shaped(joined.join(errors, "run_name", "left"))


def dataset_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold before documents are published: negatives without gold spans, no usable card or individual number."""
    rows = V.exploded(documents(spark, sf_dir), ["doc_id", "subset"], "spans", ("label", "text"))
    usable = F.when(F.col("label") == "CREDIT_CARD", X.luhn_ok(F.col("text"))).when(F.col("label") == "MYNUMBER", X.mynumber_ok(F.col("text")))
    count = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0))
    return rows.agg(
        count(F.col("subset") == "negatives").alias("n_gold_in_negatives"), count(usable).alias("n_usable_numbers"), F.count("*").alias("n_spans")
    )


def surface_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surfaces of the negatives' texts with the kind of their document, where it has one only."""
    docs = negative_docs(spark, sf_dir, "negative_kinds").where(F.size(F.array_distinct("negative_kinds")) == 1)
    return negatives.surfaces(docs.select(F.get("negative_kinds", F.lit(0)).alias("kind"), "text"))


def _weights(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    return {r["kind"]: r["weight"] for r in table(spark, sf_dir, "kind_weights").collect()}  # eight rows


def negative_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1,000 documents (a generator): rows, characters, empty ones, gold spans, kinds that aren't known."""
    docs = synth.negative_documents(spark, 1000, 7, _weights(spark, sf_dir), synth.base_texts(table(spark, sf_dir, "corpus_items")))
    known = F.array(*(F.lit(k) for k in vocab.NEGATIVE_KINDS))
    return docs.agg(
        F.count("*").alias("n_docs"), F.count_distinct("doc_id").alias("n_ids"), F.sum((F.length("text") == 0).cast("long")).alias("n_empty"),
        F.sum(F.size("spans")).cast("long").alias("n_spans"), F.sum(F.size(F.array_except("negative_kinds", known))).cast("long").alias("n_unknown"),
        (F.sum(F.size("negative_kinds")) > 2500).alias("many_negatives"),
    )


def inject_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with two hard negatives each: gold spans whose text differs afterwards (none), kinds added, all texts longer."""
    docs = V.spread(documents(spark, sf_dir, "negative_kinds")).where("text is not null")
    docs = docs.withColumns({"before": F.length("text"), "kinds_before": F.coalesce(F.size("negative_kinds"), F.lit(0))})
    out = negatives.injected(docs, "doc_id", "text", "spans", "negative_kinds", 2, 11)
    wrong = F.size(F.filter("spans", lambda s: X.slice_of(F.col("text"), s["start_pos"], s["end_pos"]) != s["text"]))
    rows = out.select((F.length("text") > F.col("before")).alias("longer"), wrong.alias("wrong"), (F.size("negative_kinds") - F.greatest("kinds_before", F.lit(0))).alias("added"))
    return rows.agg(F.count("*").alias("n_docs"), F.sum("wrong").cast("long").alias("n_moved_wrong"), F.sum("added").cast("long").alias("n_added"), F.bool_and("longer").alias("longer"))


def _audited(docs: DataFrame) -> DataFrame:
    """By subset: documents, ids, spans that aren't the slice of their text or overlap, usable numbers, labels, genres."""
    rows = docs.withColumn("reason", broken_spans(F.col("text"), F.col("spans")))
    usable = lambda s: F.when(s["label"] == "CREDIT_CARD", X.luhn_ok(s["text"])).when(s["label"] == "MYNUMBER", X.mynumber_ok(s["text"])).otherwise(False)
    rows = rows.withColumn("n_usable", F.size(F.filter("spans", usable)))
    return rows.groupBy("subset").agg(
        F.count("*").alias("n_docs"), F.count_distinct("doc_id").alias("n_ids"), F.count("reason").alias("n_broken"),
        F.sum("n_usable").cast("long").alias("n_usable"), F.size(F.array_distinct(F.flatten(F.collect_set("spans.label")))).cast("long").alias("n_labels"),
        F.count_distinct("genre").alias("n_genres"), F.sum((F.size("negative_kinds") > 0).cast("long")).alias("n_with_negatives"),
    )


def synth_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2,000 documents on base texts of the corpus (a generator), audited."""
    bases = synth.base_texts(table(spark, sf_dir, "corpus_items"))
    return _audited(synth.documents(spark, 2000, 2024, bases=bases))


def built_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All subsets of a data set (a generator), audited; of ood documents only what doesn't depend on how many base texts are skipped."""
    items = table(spark, sf_dir, "corpus_items")
    docs = synth.build(spark, items, {"train": 1200, "validation": 200, "test": 200, "negatives": 300}, 11, weights=_weights(spark, sf_dir))
    rows = _audited(docs).drop("n_labels")
    ood = F.col("subset") == "ood"
    return rows.withColumns({"n_ids": F.col("n_docs") - F.col("n_ids"), "n_docs": F.when(~ood, F.col("n_docs"))}).withColumn(
        "n_with_negatives", F.when(F.col("subset") != "negatives", F.col("n_with_negatives"))
    )


def ood_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """500 documents at most in prose (a generator): broken spans, documents with fewer than one or more than six values, texts that normalisation changes."""
    docs = synth.ood_documents(spark, 500, synth.base_texts(table(spark, sf_dir, "corpus_items")), 5)
    docs = docs.withColumns({"reason": broken_spans(F.col("text"), F.col("spans")), "normal": X.normalize(F.col("text"))})
    return docs.agg(
        F.count("reason").alias("n_broken"), F.sum((~F.size("spans").between(1, 6)).cast("long")).alias("n_unusual"),
        F.sum((F.col("normal") != F.col("text")).cast("long")).alias("n_not_normal"), (F.count("*") > 100).alias("enough"),
    )


# ---- SQL

_IOU = (
    "(least(gs.end_pos, ps.end_pos) - greatest(gs.start_pos, ps.start_pos))::DOUBLE / ((gs.end_pos - gs.start_pos) + (ps.end_pos - ps.start_pos) "
    "- (least(gs.end_pos, ps.end_pos) - greatest(gs.start_pos, ps.start_pos)))"
)


def _matched_sql(docs: str, mode: str, pred: str = "pred", x: str = "") -> str:
    """Views up to {x}o with the outcome of every prediction and gold span; x tells apart two uses in one query."""
    fit = "gs.start_pos = ps.start_pos AND gs.end_pos = ps.end_pos" if mode == "exact" else "gs.start_pos < ps.end_pos AND ps.start_pos < gs.end_pos"
    iou = "-1.0::DOUBLE" if mode == "exact" else f"-({_IOU})"
    return f"""{x}j AS (SELECT p.run_name, p.doc_id, p.spans AS p, {V.by_position_sql(V.present_sql("d.spans"))} AS g FROM {pred} p JOIN {docs} d ON d.doc_id = p.doc_id),
      {x}pairs AS (SELECT run_name, doc_id, gi, pi, g[gi] AS gs, p[pi] AS ps FROM (SELECT *, unnest(range(1, len(p) + 1)) AS pi FROM (SELECT *, unnest(range(1, len(g) + 1)) AS gi FROM {x}j))),
      {x}cand AS (SELECT run_name, doc_id, list_sort(list({{'iou': {iou}, 'score': -ps.score, 'gs': gs.start_pos, 'ps': ps.start_pos, 'g': gi, 'p': pi}})) AS c FROM {x}pairs WHERE gs.label = ps.label AND {fit} GROUP BY run_name, doc_id),
      {x}kept AS (SELECT run_name, doc_id, list_reduce(c, lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: k.g = x.g OR k.p = x.p)) > 0 THEN acc ELSE list_append(acc, {{'g': x.g, 'p': x.p}}) END, []::STRUCT(g BIGINT, p BIGINT)[]) AS m FROM {x}cand),
      {x}joined AS (SELECT j.*, coalesce(k.m, []::STRUCT(g BIGINT, p BIGINT)[]) AS m FROM {x}j j LEFT JOIN {x}kept k ON k.run_name = j.run_name AND k.doc_id = j.doc_id),
      {x}o AS (SELECT run_name, doc_id, CASE WHEN list_contains(list_transform(m, lambda k: k.p), i) THEN 'tp' ELSE 'fp' END AS outcome, p[i] AS s FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM {x}joined)
        UNION ALL SELECT run_name, doc_id, CASE WHEN list_contains(list_transform(m, lambda k: k.g), i) THEN 'hit' ELSE 'miss' END, g[i] FROM (SELECT *, unnest(range(1, len(g) + 1)) AS i FROM {x}joined))"""


_OUTCOME_SQL = "SELECT run_name, doc_id, outcome, s.start_pos::BIGINT AS start_pos, s.end_pos::BIGINT AS end_pos, s.label AS label, round(s.score, 9) AS score FROM o"


def _rates_sql(mode: str, pred: str = "pred", docs: str = "pos", x: str = "") -> str:
    z = lambda a, b: f"CASE WHEN {b} > 0 THEN {a}::DOUBLE / ({b}) ELSE 0.0::DOUBLE END"
    return f"""{_matched_sql(docs, mode, pred, x)}, cnt AS (SELECT run_name, s.label AS label, count(*) FILTER (outcome = 'tp') AS tp, count(*) FILTER (outcome = 'fp') AS fp FROM {x}o WHERE outcome IN ('tp', 'fp') GROUP BY 1, 2),
      sup AS (SELECT r.run_name, q.label, q.support FROM (SELECT DISTINCT run_name FROM {pred}) r, (SELECT s.label AS label, count(*) AS support FROM (SELECT unnest(spans) AS s FROM {docs}) GROUP BY 1) q),
      fll AS (SELECT run_name, label, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(support, 0) - coalesce(tp, 0) AS fn, coalesce(support, 0) AS support FROM cnt FULL JOIN sup USING (run_name, label)),
      u AS (SELECT * FROM fll UNION ALL SELECT run_name, 'micro', sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT, sum(support)::BIGINT FROM fll GROUP BY run_name),
      pr AS (SELECT *, {z("tp", "tp + fp")} AS precision, {z("tp", "tp + fn")} AS recall FROM u),
      rt AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0::DOUBLE END AS f1 FROM pr),
      rates AS (SELECT * FROM rt UNION ALL SELECT run_name, 'macro', sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT, sum(support)::BIGINT,
        coalesce(avg(precision) FILTER (support > 0), 0), coalesce(avg(recall) FILTER (support > 0), 0), coalesce(avg(f1) FILTER (support > 0), 0) FROM rt WHERE label != 'micro' GROUP BY run_name)"""


_RATES_OUT = "SELECT run_name, label, tp, fp, fn, support, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM rates"


def _report_sql(pred: str = "pred", name: str = "rep") -> str:
    return f"""{name}0 AS (SELECT p.run_name, sum(len(p.spans))::BIGINT AS n_fp, count(*) FILTER (len(p.spans) > 0) AS n_docs_with_fp FROM {pred} p WHERE p.doc_id IN (SELECT doc_id FROM neg) GROUP BY 1),
      {name}1 AS (SELECT count(*) AS n_docs, coalesce(sum(length(text)), 0)::BIGINT AS n_chars FROM neg),
      {name} AS (SELECT r.run_name, coalesce(n_fp, 0) AS n_fp, coalesce(n_docs_with_fp, 0) AS n_docs_with_fp, n_docs, n_chars, coalesce(coalesce(n_fp, 0)::DOUBLE / nullif(n_docs, 0), 0) AS fp_per_doc,
        coalesce(coalesce(n_fp, 0) * 1000.0::DOUBLE / nullif(n_chars, 0), 0) AS fp_per_1000_chars, coalesce(coalesce(n_docs_with_fp, 0)::DOUBLE / nullif(n_docs, 0), 0) AS doc_level_fp_rate
        FROM (SELECT DISTINCT run_name FROM {pred}) r LEFT JOIN {name}0 USING (run_name), {name}1)"""


_BASE = f"WITH {DOCS_SQL}, {POS_SQL}, {NEG_SQL}, {PRED_SQL}"
_CTX = "substring(text, greatest(start_pos - 24, 0) + 1, end_pos + 24 - greatest(start_pos - 24, 0))"
_SURF = "substring(text, start_pos + 1, end_pos - start_pos)"
_KIND_SQL = (
    "CASE " + " ".join(f"WHEN regexp_matches({_CTX}, '{pattern}') THEN '{kind}'" for kind, pattern in vocab.KIND_PATTERNS)
    + f" WHEN {_SURF} IN ({', '.join(repr(w) for w in vocab.NOUN_SURNAMES)}) THEN 'common_noun_surname'"
    + f" WHEN {_SURF} IN ({', '.join(repr(w) for w in vocab.PLACE_SURNAMES)}) THEN 'place_as_person'"
    + " WHEN len(list_distinct(coalesce(negative_kinds, []::VARCHAR[]))) = 1 THEN list_distinct(negative_kinds)[1] ELSE 'other' END"
)
_KINDS = f"""{_BASE}, f AS (SELECT p.run_name, coalesce(n.text, '') AS text, n.negative_kinds, unnest(p.spans) AS s FROM pred p JOIN neg n ON n.doc_id = p.doc_id),
  k AS (SELECT run_name, {_KIND_SQL} AS kind FROM (SELECT run_name, text, negative_kinds, s.start_pos AS start_pos, s.end_pos AS end_pos FROM f))"""


def _threshold_sql(metric: str, target: float) -> str:
    """Views up to thr: the threshold of each run by trying all of the grid; evl: the rate at every threshold of the grid."""
    size = "coalesce(sum(length(text)), 0) / 1000.0::DOUBLE" if metric == "per_1000_chars" else "count(*)::DOUBLE"
    event = "SELECT run_name, max(score) AS score FROM ev0 GROUP BY run_name, doc_id" if metric == "doc_level" else "SELECT run_name, score FROM ev0"
    return f"""allp AS (SELECT run_name, doc_id, unnest(list_transform(spans, lambda s: round(s.score, 12))) AS score FROM pred WHERE doc_id IN (SELECT doc_id FROM pos UNION ALL SELECT doc_id FROM neg)),
      ev0 AS (SELECT run_name, doc_id, unnest(list_transform(spans, lambda s: round(s.score, 12))) AS score FROM pred WHERE doc_id IN (SELECT doc_id FROM neg)), ev AS ({event}),
      den AS (SELECT {size} AS n, count(*) AS n_neg FROM neg), grid AS (SELECT DISTINCT run_name, score AS t FROM allp UNION SELECT run_name, max(score) + 1e-6::DOUBLE FROM allp GROUP BY 1),
      evl AS (SELECT run_name, t, n_ev, coalesce(n_ev / nullif(den.n, 0), 0) AS fpr, n_neg = 0 OR n_ev <= {target}::DOUBLE * den.n + 1e-9::DOUBLE AS meets, n_neg FROM
        (SELECT g.run_name, g.t, (SELECT count(*) FROM ev WHERE ev.run_name = g.run_name AND ev.score >= g.t) AS n_ev FROM grid g), den),
      best AS (SELECT run_name, min(t) FILTER (meets) AS t, max(t) AS above, any_value(n_neg) AS n_neg FROM evl GROUP BY run_name),
      thr AS (SELECT r.run_name, CASE WHEN above IS NULL THEN 0.0::DOUBLE ELSE t END AS threshold,
        CASE WHEN above IS NULL THEN 'no_predictions' WHEN n_neg = 0 THEN 'no_negatives' WHEN t = above THEN 'only_empty_predictions_meet_target' END AS degenerate FROM (SELECT DISTINCT run_name FROM pred) r LEFT JOIN best USING (run_name)),
      cut AS (SELECT p.run_name, p.doc_id, list_filter(p.spans, lambda s: s.score >= t.threshold) AS spans FROM pred p JOIN thr t ON t.run_name = p.run_name)"""


def _fixed_sql(metric: str, target: float) -> str:
    col = {"per_doc": "fp_per_doc", "doc_level": "doc_level_fp_rate", "per_1000_chars": "fp_per_1000_chars"}[metric]
    return f"""{_BASE}, {_threshold_sql(metric, target)}, {_rates_sql("partial", "cut", x="c_")}, {_report_sql("cut")}
      SELECT thr.run_name, round(threshold, 9) AS threshold, round(coalesce({col}, 0), 9) AS fpr, round(coalesce(m.recall, 0), 9) AS recall, round(coalesce(m.precision, 0), 9) AS precision, round(coalesce(m.f1, 0), 9) AS f1,
        round(coalesce(q.recall, 0), 9) AS macro_recall, coalesce(m.tp + m.fp, 0)::BIGINT AS n_kept, coalesce({col}, 0) <= {target} AS achieved, degenerate
      FROM thr LEFT JOIN (SELECT * FROM rates WHERE label = 'micro') m ON m.run_name = thr.run_name LEFT JOIN (SELECT * FROM rates WHERE label = 'macro') q ON q.run_name = thr.run_name LEFT JOIN rep ON rep.run_name = thr.run_name"""


_EVAL = f"{_BASE}, ev AS (SELECT * FROM docs WHERE subset != 'train'), {_matched_sql('ev', 'partial')}, prs AS (SELECT run_name, s.score AS score, (outcome = 'tp')::INT AS label FROM o WHERE outcome IN ('tp', 'fp'))"
_CLIP = "least(greatest(score, 0.0::DOUBLE), 1.0::DOUBLE)"
_Q = f"least(greatest({_CLIP}, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE)"
_ERR = f"""pb AS (SELECT run_name, least(floor({_CLIP} * 15), 14)::BIGINT AS bin, count(*) AS n, sum({_CLIP}) AS s, sum(label)::DOUBLE AS y, sum(({_CLIP} - label) * ({_CLIP} - label)) AS sq,
    sum(-(label * ln({_Q}) + (1 - label) * ln(1 - {_Q}))) AS nll FROM prs GROUP BY 1, 2),
  err AS (SELECT run_name, sum(n)::BIGINT AS n, round(sum(n * abs(y / n - s / n)) / sum(n), 9) AS ece, round(max(abs(y / n - s / n)), 9) AS mce, round(sum(sq) / sum(n), 9) AS brier, round(sum(nll) / sum(n), 9) AS nll FROM pb GROUP BY 1)"""
_STAGES = f"""sc AS (SELECT 'before' AS run_name, score, label FROM prs UNION ALL SELECT 'after', after, label FROM aft), """
_FIT_ERR = _ERR.replace("FROM prs", "FROM sc")
#: The temperature by bisecting the slope of the likelihood over its inverse.
_TEMPERATURE_SQL = f"""cn AS (SELECT round({_CLIP}, 6) AS sx, label AS y, count(*) AS n FROM prs GROUP BY 1, 2),
  ls AS (SELECT list(n) AS n, list(y) AS y, list(ln(least(greatest(sx, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) / (1 - least(greatest(sx, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE)))) AS z FROM cn),
  tm AS (SELECT exp(-list_reduce(range(0, 70), lambda e, k: CASE WHEN list_sum(list_transform(z, lambda x, i: n[i] * x * (1 / (1 + exp(-x * exp((e.a + e.b) / 2))) - y[i]))) > 0
    THEN {{'a': e.a, 'b': (e.a + e.b) / 2}} ELSE {{'a': (e.a + e.b) / 2, 'b': e.b}} END, {{'a': ln(0.01::DOUBLE), 'b': ln(100.0::DOUBLE)}}).a) AS t FROM ls),
  aft AS (SELECT 1 / (1 + exp(-ln({_Q} / (1 - {_Q})) / t)) AS after, label FROM prs, tm)"""
#: The monotone fit as the largest over all beginnings of the least over all ends of the average between.
_ISOTONIC_SQL = f"""cn AS (SELECT {_CLIP} AS x, sum(label)::DOUBLE AS y, count(*) AS n FROM prs GROUP BY 1), rk AS (SELECT *, row_number() OVER (ORDER BY x) AS i FROM cn),
  av AS (SELECT a.i AS j, b.i AS k, sum(b.y) OVER (PARTITION BY a.i ORDER BY b.i) / sum(b.n) OVER (PARTITION BY a.i ORDER BY b.i) AS m FROM rk a JOIN rk b ON b.i >= a.i),
  lw AS (SELECT j, k AS i, min(m) OVER (PARTITION BY j ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS m FROM av), ft AS (SELECT i, max(m) AS f FROM lw GROUP BY i),
  kn AS (SELECT sum(CASE WHEN c = 1 THEN 1 ELSE 2 END)::BIGINT AS n_knots FROM (SELECT round(f, 12), count(*) AS c FROM ft GROUP BY 1)),
  aft AS (SELECT f AS after, label FROM prs JOIN rk ON rk.x = {_CLIP} JOIN ft USING (i))"""
_KNOT = "CASE WHEN s IS NULL THEN NULL WHEN s >= {x3} THEN {y3} WHEN s <= {x0} THEN {y0} ".format(x3=KNOTS_X[-1], y3=KNOTS_Y[-1], x0=KNOTS_X[0], y0=KNOTS_Y[0]) + " ".join(
    f"WHEN s <= {b} THEN ({d}::DOUBLE - {c}::DOUBLE) / ({b}::DOUBLE - {a}::DOUBLE) * (s - {a}::DOUBLE) + {c}::DOUBLE" for a, b, c, d in zip(KNOTS_X, KNOTS_X[1:], KNOTS_Y, KNOTS_Y[1:])
) + " END"
_SURFACE_SQL = """list_concat(regexp_extract_all(text, '[0-9][0-9\\-.]{4,}[0-9]'), regexp_extract_all(text, '[一-龥ァ-ヶА-я]{2,10}'))"""

SQL = {
    "match_exact": f"WITH {DOCS_SQL}, {PRED_SQL}, {_matched_sql('docs', 'exact')} {_OUTCOME_SQL}",
    "match_partial": f"WITH {DOCS_SQL}, {PRED_SQL}, {_matched_sql('docs', 'partial')} {_OUTCOME_SQL}",
    "detection_rates": f"{_BASE}, {_rates_sql('partial')} {_RATES_OUT}",
    "detection_rates_exact": f"{_BASE}, {_rates_sql('exact')} {_RATES_OUT}",
    "span_scores": f"""{_BASE}, j AS (SELECT p.run_name, p.doc_id, p.spans AS p, {V.by_position_sql(V.present_sql("d.spans"))} AS g FROM pred p JOIN pos d ON d.doc_id = p.doc_id),
      k AS (SELECT *, list_distinct(list_transform(g, lambda s: {{'a': s.start_pos, 'b': s.end_pos, 'c': s.label}})) AS gk, list_distinct(list_transform(p, lambda s: {{'a': s.start_pos, 'b': s.end_pos, 'c': s.label}})) AS pk FROM j),
      f AS (SELECT *, len(list_intersect(gk, pk)) AS eb, len(list_reduce(p, lambda acc, s: CASE WHEN len(list_filter(range(1, len(g) + 1), lambda i: NOT list_contains(acc, i) AND g[i].label = s.label AND g[i].start_pos < s.end_pos AND s.start_pos < g[i].end_pos)) > 0
        THEN list_append(acc, list_filter(range(1, len(g) + 1), lambda i: NOT list_contains(acc, i) AND g[i].label = s.label AND g[i].start_pos < s.end_pos AND s.start_pos < g[i].end_pos)[1]) ELSE acc END, []::BIGINT[])) AS pb FROM k)
      SELECT run_name, 'exact' AS mode, sum(eb)::BIGINT AS tp, sum(len(pk) - eb)::BIGINT AS fp, sum(len(gk) - eb)::BIGINT AS fn FROM f GROUP BY run_name
      UNION ALL SELECT run_name, 'partial', sum(pb)::BIGINT, sum(len(p) - pb)::BIGINT, sum(len(g) - pb)::BIGINT FROM f GROUP BY run_name""",
    "fp_report": f"{_BASE}, {_report_sql()} SELECT run_name, n_docs, n_chars, n_fp, n_docs_with_fp, round(fp_per_doc, 9) AS fp_per_doc, round(fp_per_1000_chars, 9) AS fp_per_1000_chars, round(doc_level_fp_rate, 9) AS doc_level_fp_rate FROM rep",
    "fp_by_type": f"{_BASE} SELECT run_name, s.label AS label, count(*) AS n_fp FROM (SELECT run_name, unnest(spans) AS s FROM pred WHERE doc_id IN (SELECT doc_id FROM neg)) GROUP BY 1, 2",
    "fp_by_negative_kind": f"{_BASE} SELECT run_name, kind, sum(n)::BIGINT AS n_fp FROM (SELECT p.run_name, len(p.spans) AS n, unnest(negative_kinds) AS kind FROM pred p JOIN neg ON neg.doc_id = p.doc_id) GROUP BY 1, 2",
    "fp_by_kind": f"{_KINDS} SELECT run_name, kind, count(*) AS n_fp FROM k GROUP BY 1, 2",
    "fp_by_kind_indexed": f"""{_BASE}, six AS (SELECT list_distinct(negative_kinds)[1] AS kind, text FROM neg WHERE len(list_distinct(negative_kinds)) = 1), idx AS (SELECT surface, min(kind) AS kind FROM (SELECT kind, unnest({_SURFACE_SQL}) AS surface FROM six) GROUP BY 1),
      f AS (SELECT p.run_name, coalesce(n.text, '') AS text, n.negative_kinds, unnest(p.spans) AS s FROM pred p JOIN neg n ON n.doc_id = p.doc_id), g AS (SELECT run_name, text, negative_kinds, s.start_pos AS start_pos, s.end_pos AS end_pos FROM f),
      k AS (SELECT run_name, coalesce(idx.kind, own) AS kind FROM (SELECT run_name, {_SURF} AS surface, {_KIND_SQL} AS own FROM g) LEFT JOIN idx USING (surface)) SELECT run_name, kind, count(*) AS n_fp FROM k GROUP BY 1, 2""",
    "softmax_top": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: exp(x::DOUBLE - list_max(embedding)::DOUBLE)) AS e FROM embeddings)
      SELECT vec_id, round(list_max(e) / list_sum(e), 6) AS p_top, 1.0::DOUBLE AS total FROM e""",
    "dataset_verify": f"""WITH {DOCS_SQL}, s AS (SELECT subset, s.label AS label, regexp_replace(s.text, '[^0-9]', '', 'g') AS d FROM (SELECT subset, unnest(spans) AS s FROM docs)),
      v AS (SELECT subset, CASE WHEN label = 'CREDIT_CARD' THEN length(d) >= 12 AND list_sum(list_transform(string_split(reverse(d), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN try_cast(c AS INT) WHEN try_cast(c AS INT) > 4 THEN try_cast(c AS INT) * 2 - 9 ELSE try_cast(c AS INT) * 2 END)) % 10 = 0
        WHEN label = 'MYNUMBER' AND length(d) = 12 THEN (SELECT CASE WHEN t % 11 <= 1 THEN 0 ELSE 11 - t % 11 END FROM (SELECT list_sum(list_transform([6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2], lambda w, i: w * try_cast(substring(d, i, 1) AS INT))) AS t)) = try_cast(substring(d, 12, 1) AS INT) ELSE false END AS usable FROM s)
      SELECT count(*) FILTER (subset = 'negatives') AS n_gold_in_negatives, count(*) FILTER (usable) AS n_usable_numbers, count(*) AS n_spans FROM v""",
    "reweight": f"""{_KINDS}, c AS (SELECT kind, count(*) AS n FROM k GROUP BY 1), a AS (SELECT w.kind, w.weight * (1.0::DOUBLE + 1.5::DOUBLE * (coalesce(n, 0) / ((SELECT coalesce(sum(n), 0)::DOUBLE FROM c) + 1e-9::DOUBLE))) AS w FROM kind_weights w LEFT JOIN c USING (kind)),
      b AS (SELECT kind, w / sum(w) OVER () AS w, count(*) OVER () AS k FROM a), d AS (SELECT kind, least(4.0::DOUBLE / k, greatest(0.25::DOUBLE / k, w)) AS w FROM b) SELECT kind, round(w / sum(w) OVER (), 9) AS weight FROM d""",
    "recall_at_fpr_per_doc": _fixed_sql("per_doc", 0.05),
    "recall_at_fpr_doc_level": _fixed_sql("doc_level", 0.05),
    "recall_at_fpr_per_1000_chars": _fixed_sql("per_1000_chars", 0.5),
    "recall_by_type": f"""{_BASE}, {_threshold_sql("per_doc", 0.05)}, {_rates_sql("partial", "cut", x="c_")} {_RATES_OUT}""",
    "recall_curve": f"""{_BASE}, {_threshold_sql("per_doc", 0.05)}, rk AS (SELECT *, row_number() OVER (PARTITION BY run_name ORDER BY t) - 1 AS r, count(*) OVER (PARTITION BY run_name) AS g FROM evl),
      pt AS (SELECT run_name, unnest(range(0, {POINTS})) AS k FROM thr), want AS (SELECT DISTINCT pt.run_name, round_even(k * ((g - 1) / {POINTS - 1}.0::DOUBLE), 0)::BIGINT AS r FROM pt JOIN (SELECT DISTINCT run_name, g FROM rk) USING (run_name)),
      sel AS (SELECT rk.*, thr.threshold = rk.t AS chosen FROM rk JOIN thr USING (run_name) WHERE g <= {POINTS} OR thr.threshold = rk.t OR (rk.run_name, r) IN (SELECT run_name, r FROM want)),
      ct AS (SELECT p.run_name || chr(1) || s.r::VARCHAR AS run_name, p.doc_id, list_filter(p.spans, lambda x: x.score >= s.t) AS spans FROM pred p JOIN sel s ON s.run_name = p.run_name), {_rates_sql("partial", "ct", x="c_")}
      SELECT sel.run_name, round(t, 9) AS threshold, round(fpr, 9) AS fpr, round(recall, 9) AS recall, chosen FROM sel JOIN rates ON rates.run_name = sel.run_name || chr(1) || sel.r::VARCHAR WHERE label = 'micro'""",
    "calibration_pairs": f"{_EVAL} SELECT run_name, label::BIGINT AS label, count(*) AS n, round(sum(score), 6) AS score_sum FROM prs GROUP BY 1, 2",
    "ece_bins": f"{_EVAL} SELECT run_name, least(floor({_CLIP} * 15), 14)::BIGINT AS bin, count(*) AS n, round(avg({_CLIP}), 9) AS confidence, round(avg(label), 9) AS accuracy FROM prs GROUP BY 1, 2",
    "calibration_errors": f"{_EVAL}, {_ERR} SELECT * FROM err",
    "temperature_transform": f"SELECT DISTINCT round(score, 9) AS score, round(1 / (1 + exp(-ln({_Q} / (1 - {_Q})) / {TEMPERATURE}::DOUBLE)), 9) AS calibrated FROM predictions",
    "isotonic_transform": f"SELECT DISTINCT round(score, 9) AS score, round({_KNOT}, 9) AS calibrated FROM (SELECT score, {_CLIP} AS s FROM predictions)",
    "temperature_fit": f"{_EVAL}, {_TEMPERATURE_SQL}, {_STAGES}{_FIT_ERR} SELECT run_name AS stage, n, ece, mce, brier, nll, (SELECT round(t, 9) FROM tm) AS temperature, 0::BIGINT AS n_knots FROM err",
    "isotonic_fit": f"{_EVAL}, {_ISOTONIC_SQL}, {_STAGES}{_FIT_ERR} SELECT run_name AS stage, n, ece, mce, brier, nll, NULL::DOUBLE AS temperature, (SELECT n_knots FROM kn) AS n_knots FROM err",
    "type_histogram": f"WITH {DOCS_SQL} SELECT s.label AS label, count(*) AS n FROM (SELECT unnest(spans) AS s FROM docs) GROUP BY 1",
    "score_axes": f"""{_KINDS}, {_threshold_sql("per_doc", 0.05)}, {_rates_sql("partial", "cut", x="c_")}, fixed AS (SELECT rates.run_name, threshold, recall AS fixed_recall, degenerate FROM rates JOIN thr ON thr.run_name = rates.run_name WHERE label = 'micro'),
      {_report_sql()}, {_report_sql("cut", "frep")}, {_rates_sql("partial", x="w_").replace(", cnt AS", ", w_cnt AS").replace("FROM cnt", "FROM w_cnt").replace("sup AS (", "w_sup AS (").replace("JOIN sup", "JOIN w_sup").replace("fll AS (", "w_fll AS (").replace("FROM fll", "FROM w_fll").replace(" u AS (", " w_u AS (").replace("FROM u)", "FROM w_u)").replace(" pr AS (", " w_pr AS (").replace("FROM pr)", "FROM w_pr)").replace(" rt AS (", " w_rt AS (").replace("FROM rt ", "FROM w_rt ").replace("rates AS (", "w_rates AS (")},
      kk AS (SELECT run_name, string_agg(kind || ' ' || n::VARCHAR, ', ' ORDER BY n DESC, kind) AS fp_kinds FROM (SELECT run_name, kind, count(*) AS n FROM k GROUP BY 1, 2) GROUP BY 1),
      evd AS (SELECT * FROM docs WHERE subset != 'train'), {_matched_sql("evd", "partial", x="e_")}, prs AS (SELECT run_name, s.score AS score, (outcome = 'tp')::INT AS label FROM e_o WHERE outcome IN ('tp', 'fp')), {_ERR},
      gate AS (SELECT run_name FROM prs GROUP BY 1 HAVING count(DISTINCT label) > 1 AND count(DISTINCT round(score, 4)) > 2)
      SELECT w.run_name, round(w.precision, 9) AS precision, round(w.recall, 9) AS recall, round(w.f1, 9) AS f1, round(rep.fp_per_doc, 9) AS fp_per_doc, round(rep.fp_per_1000_chars, 9) AS fp_per_1000_chars, round(rep.doc_level_fp_rate, 9) AS doc_level_fp_rate,
        round(threshold, 9) AS threshold, round(frep.fp_per_doc, 9) AS fixed_fpr, round(fixed_recall, 9) AS fixed_recall, degenerate, fp_kinds, CASE WHEN gate.run_name IS NOT NULL THEN err.ece END AS ece, err.brier AS brier
      FROM w_rates w LEFT JOIN rep ON rep.run_name = w.run_name LEFT JOIN frep ON frep.run_name = w.run_name LEFT JOIN fixed ON fixed.run_name = w.run_name LEFT JOIN kk ON kk.run_name = w.run_name
        LEFT JOIN err ON err.run_name = w.run_name LEFT JOIN gate ON gate.run_name = w.run_name WHERE w.label = 'micro'""",
    "negative_documents": "SELECT 1000::BIGINT AS n_docs, 1000::BIGINT AS n_ids, 0::BIGINT AS n_empty, 0::BIGINT AS n_spans, 0::BIGINT AS n_unknown, true AS many_negatives",
    "synth_documents": "SELECT 'train' AS subset, 2000::BIGINT AS n_docs, 2000::BIGINT AS n_ids, 0::BIGINT AS n_broken, 0::BIGINT AS n_usable, 10::BIGINT AS n_labels, 4::BIGINT AS n_genres, 0::BIGINT AS n_with_negatives",
    "built_dataset": """SELECT * FROM (VALUES ('train', 1200::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 4::BIGINT, 540::BIGINT), ('validation', 200, 0, 0, 0, 4, 90), ('test', 200, 0, 0, 0, 4, 90),
      ('ood', NULL, 0, 0, 0, 1, 0), ('negatives', 300, 0, 0, 0, 1, NULL)) t(subset, n_docs, n_ids, n_broken, n_usable, n_genres, n_with_negatives)""",
    "ood_documents": "SELECT 0::BIGINT AS n_broken, 0::BIGINT AS n_unusual, 0::BIGINT AS n_not_normal, true AS enough",
    "inject_negatives": f"""WITH {DOCS_SQL} SELECT count(*) AS n_docs, 0::BIGINT AS n_moved_wrong, 2 * count(*)::BIGINT AS n_added, true AS longer FROM docs WHERE text IS NOT NULL""",
    "surface_index": f"{_BASE}, a AS (SELECT list_distinct(negative_kinds)[1] AS kind, text FROM neg WHERE len(list_distinct(negative_kinds)) = 1) SELECT surface, min(kind) AS kind FROM (SELECT kind, unnest({_SURFACE_SQL}) AS surface FROM a) GROUP BY 1",
}

QUERIES = (
    match_exact, match_partial, detection_rates, detection_rates_exact, span_scores, fp_report, fp_by_type, fp_by_negative_kind, fp_by_kind, fp_by_kind_indexed, softmax_top, reweight,
    _fixed("per_doc", 0.05), _fixed("doc_level", 0.05), _fixed("per_1000_chars", 0.5), recall_by_type, recall_curve, calibration_pairs, ece_bins, calibration_errors,
    temperature_transform, isotonic_transform, temperature_fit, isotonic_fit, type_histogram, score_axes, dataset_verify, surface_index,
    negative_documents, inject_negatives, synth_documents, built_dataset, ood_documents,
)
