"""Queries of span algebra, masking, egress, decoding and comparison, with their SQL."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions import text as X
from ..functions import vocab
from ..operators import compare, decode, egress, kernels, mask
from ..sources.files import broken_spans
from . import frames as V
from .frames import DOCS_SQL, PRED_SQL, SPAN_SQL, deliveries, documents, exploded, predicted, shaped, spread, table

_KEYS = ["run_name", "doc_id"]
_OUT = ("start_pos", "end_pos", "label", "score")


def _spans(df: DataFrame, col: Column) -> DataFrame:
    return shaped(exploded(df.withColumn("out", col), _KEYS, "out", _OUT))


def resolve_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(predicted(spark, sf_dir), S.resolve_by_score(F.col("spans")))


def dedupe_max_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(predicted(spark, sf_dir), S.dedupe_max_score(F.col("spans")))


def mask_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted spans a mask would replace."""
    return _spans(predicted(spark, sf_dir), S.first_from_left(F.col("spans")))


def merge_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions by rules and by models merged, model spans from 0.6."""
    s = F.col("spans")
    rules, model = F.filter(s, lambda x: x["source"] == "rule"), F.filter(s, lambda x: x["source"] != "rule")
    out = S.merged(model, rules, vocab.RULE_DETERMINISTIC, 0.6)
    return shaped(exploded(predicted(spark, sf_dir).withColumn("out", out), _KEYS, "out", (*_OUT, "origin")))


def merge_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predicted(spark, sf_dir).join(documents(spark, sf_dir).select("doc_id", "text"), "doc_id")
    out = S.merged_windows(F.col("spans"), F.coalesce("text", F.lit("")))
    return shaped(exploded(rows.withColumn("out", out), _KEYS, "out", (*_OUT, "text")))


def span_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap in characters and IoU of predicted with gold spans of the same document: an equi join with an interval condition."""
    gold = exploded(documents(spark, sf_dir), ["doc_id"], "spans", ("start_pos", "end_pos", "label"))
    gold = gold.select("doc_id", *(F.col(c).alias(f"gold_{c}") for c in ("start_pos", "end_pos", "label"))).distinct()
    found = exploded(predicted(spark, sf_dir), _KEYS, "spans", ("start_pos", "end_pos", "label")).distinct()
    rows = found.join(gold, "doc_id").where("start_pos < gold_end_pos AND gold_start_pos < end_pos")
    a = F.struct("start_pos", "end_pos")
    b = F.struct(F.col("gold_start_pos").alias("start_pos"), F.col("gold_end_pos").alias("end_pos"))
    return shaped(rows.withColumns({"n_common": S.intersection(a, b), "iou": S.iou(a, b)}))


def validate_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of documents by what is wrong with their gold spans."""
    reason = F.coalesce(broken_spans(F.coalesce("text", F.lit("")), F.col("spans")), F.lit("valid"))
    return documents(spark, sf_dir).groupBy(reason.alias("state")).agg(F.count("*").alias("n_docs"))


# ---- masking and egress


def _masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask.with_mask(spread(deliveries(spark, sf_dir)), "text", "spans")


def mask_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masked(spark, sf_dir).select("doc_id", "masked")


def mask_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(mask.mapping_rows(_masked(spark, sf_dir), "doc_id"))


def mask_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(mask.summary(_masked(spark, sf_dir), "doc_id"))


def mask_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts restored from mask and mapping: all, and those that differ (none)."""
    rows = _masked(spark, sf_dir).where("text is not null")
    same = mask.unmasked(F.col("masked"), F.col("mask_map")) == F.col("text")
    return rows.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum((~same).cast("long")), F.lit(0)).alias("n_changed"))


def _leaky(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads in which only names are masked, with all originals as forbidden values."""
    names = deliveries(spark, sf_dir).withColumn("names", F.filter("spans", lambda s: s["label"] == "NAME"))
    rows = mask.with_mask(spread(names), "text", "names", masked="payload")
    return rows.where("text is not null").select("doc_id", "payload", F.transform("spans", lambda s: s["text"]).alias("forbidden"))


def egress_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return egress.quarantined(_leaky(spark, sf_dir), "payload", "forbidden").select("doc_id", "form", "preview")


def egress_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = egress.with_violation(_leaky(spark, sf_dir), "payload", "forbidden")
    return rows.groupBy(F.col("violation").isNull().alias("clean")).agg(F.count("*").alias("n_docs"))


def llm_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked, guarded, echoed and restored: nothing differs where nothing was blocked."""
    rows = egress.round_trip(spread(deliveries(spark, sf_dir)), "text", "spans", egress.EchoTransport, "要約してください。")
    restored = F.concat(F.lit("要約してください。\n\n"), F.col("text"))
    return rows.where("text is not null").groupBy("blocked").agg(
        F.count("*").alias("n_docs"), F.coalesce(F.sum((F.col("response") != restored).cast("long")), F.lit(0)).alias("n_changed")
    )


# ---- sequences


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of three characters with deterministic probabilities around the gold spans: (doc_id, text, spans, tokens)."""
    rows = spread(documents(spark, sf_dir).where(F.length("text") > 0))
    kind = "array<struct<start_pos:int,end_pos:int,probs:array<double>>>"
    return rows.withColumn("tokens", kernels.arrow_function(_invented_tokens, kind)("text", "spans"))


def _invented_tokens(text: pa.Array, spans: pa.ListArray) -> pa.ListArray:
    """Each token has probability p for the first span it overlaps and the rest for O; all for O where there is none."""
    n = pc.utf8_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
    count = -(-n // 3)
    row = np.repeat(np.arange(len(n)), count)
    begin = np.cumsum(count) - count
    start = 3 * (np.arange(len(row)) - begin[row])
    code = np.zeros(len(row), np.int64)
    own, flat = kernels.rows_of(spans)
    found = zip(own.tolist(), *(flat.field(c).to_pylist() for c in ("start_pos", "end_pos", "label")))
    for r, a, b, label in reversed(list(found)):
        code[begin[r] + a // 3 : begin[r] + min(-(-b // 3), count[r])] = 1 + vocab.LABELS.index(label)
    k = np.where(code > 0, 2 * code - (start % 7 == 0), 0)
    p = (start * 7919 + n[row] * 31) % 1000 / 1000.0
    probs = np.zeros((len(row), 21))
    probs[:, 0] = np.where(k > 0, 1.0 - p, 1.0)
    some = np.flatnonzero(k)
    probs[some, k[some]] = p[some]
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1, dtype=np.int32) * 21), pa.array(probs.ravel()))
    ends = np.minimum(start + 3, n[row])
    fields = {"start_pos": pa.array(start.astype(np.int32)), "end_pos": pa.array(ends.astype(np.int32)), "probs": lists}
    return kernels.lists_of(row, len(n), fields)


def token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).withColumn("tokens", F.split(F.coalesce("text", F.lit("")), "", -1))
    rows = rows.withColumn("tokens", F.filter("tokens", lambda t: t != "")).withColumn("w", decode.token_windows(F.col("tokens"), 130, 64))
    rows = exploded(rows, ["doc_id"], "w")
    return shaped(rows.select("doc_id", "win", "first", F.size("tokens").alias("n_tokens"), F.array_join("tokens", "").alias("body")))


def decode_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tokens(spark, sf_dir).withColumn("out", decode.decode_bio(F.col("tokens"), F.col("text"), 0.05))
    return shaped(exploded(rows, ["doc_id"], "out", ("start_pos", "end_pos", "label", "text", "score")))


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold and decoded tag of every token."""
    rows = _tokens(spark, sf_dir)
    scored = decode.scored_tokens(F.col("tokens"))
    rows = rows.withColumn("gold", decode.bio_tags(F.col("spans"), F.col("tokens"))).withColumn(
        "found", F.transform(scored, lambda t: F.when(t["p"] > t["p_o"], F.concat(F.when(t["begins"], "B-").otherwise("I-"), t["label"])).otherwise("O"))
    )
    rows = exploded(rows.withColumn("z", F.arrays_zip("tokens", "gold", "found")), ["doc_id"], "z")
    return rows.select("doc_id", F.col("tokens.start_pos").alias("start_pos"), F.col("tokens.end_pos").alias("end_pos"), "gold", "found")


def bio_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(_tagged(spark, sf_dir).where("gold != 'O'").select("doc_id", "start_pos", "end_pos", "gold"))


def tag_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(decode.agreement(_tagged(spark, sf_dir), "doc_id", "gold", "found"))


def token_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.token_metrics(_tagged(spark, sf_dir), "gold", "found")


def refine_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted names and addresses, three characters longer on the right, refined."""
    rows = predicted(spark, sf_dir).join(documents(spark, sf_dir).select("doc_id", "text"), "doc_id").where("text is not null")
    # refined once per array: the result is exploded from a projection of its own
    wider = F.transform("spans", lambda s: s.withField("end_pos", F.least(s["end_pos"] + 3, F.length("text"))))
    rows = rows.withColumn("wide", wider).withColumn("out", decode.refined(F.col("wide"), F.col("text")))
    return shaped(exploded(rows, _KEYS, "out", (*_OUT, "text")))


# ---- comparison


def compare_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that rules and the other detectors find together and alone, by run."""
    s = F.col("spans")
    rules, others = F.filter(s, lambda x: x["source"] == "rule"), F.filter(s, lambda x: x["source"] != "rule")
    parts = compare.compared(rules, others)
    rows = predicted(spark, sf_dir).select("run_name", *(F.size(c).alias(n) for n, c in parts.items()))
    gold = predicted(spark, sf_dir).join(documents(spark, sf_dir).select("doc_id", F.col("spans").alias("gold")), "doc_id")
    against = gold.select("run_name", *(F.size(c).alias(f"gold_{n}") for n, c in compare.compared(s, F.col("gold")).items()))
    total = lambda df: df.groupBy("run_name").agg(*(F.sum(c).alias(c) for c in df.columns[1:]))
    return total(rows).join(total(against), "run_name")


def label_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.label_map(spark)


def map_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions renamed to another detector's labels and mapped back: unknown ones drop out."""
    back = {ours: theirs for theirs, ours in reversed(vocab.PRESIDIO_LABELS)}
    names = F.create_map(*(F.lit(x) for pair in back.items() for x in pair))
    theirs = F.transform("spans", lambda s: s.withField("label", F.coalesce(names[s["label"]], F.lit("UNKNOWN"))))
    return _spans(predicted(spark, sf_dir).withColumn("theirs", theirs), compare.mapped(F.col("theirs"), "presidio"))


def adjacent_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold addresses cut in two behind their sixth character, and joined again."""
    n = lambda s: s["end_pos"] - s["start_pos"]

    def part(s: Column, a: Column, b: Column, label: str) -> Column:
        return F.struct(a.alias("start_pos"), b.alias("end_pos"), F.lit(label).alias("label"))

    halves = F.flatten(
        F.transform(
            F.filter("spans", lambda s: (s["label"] == "ADDRESS") & (n(s) > 6)),
            lambda s: F.array(part(s, s["start_pos"], s["start_pos"] + 6, "City"), part(s, s["start_pos"] + 6, s["end_pos"], "Province")),
        )
    )
    rows = documents(spark, sf_dir).where("text is not null").withColumn("out", compare.joined_addresses(halves, F.col("text")))
    return shaped(exploded(rows, ["doc_id"], "out"))


def align_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a language model made from the gold spans, aligned with their texts."""
    item = F.transform("spans", lambda s: F.struct(s["label"].alias("type"), s["text"].alias("text")))
    names = {label: ja for label, ja, _ in vocab.PII_TYPES}
    ja = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    item = F.transform(item, lambda x: F.struct(ja[x["type"]].alias("type"), x["text"].alias("text")))
    rows = spread(documents(spark, sf_dir)).withColumn("answer", F.concat(F.lit("```json\n"), F.to_json(item), F.lit("\n```")))
    return shaped(exploded(compare.with_aligned(rows, "answer", "text", "out"), ["doc_id"], "out", ("start_pos", "end_pos", "label", "text")))


def recognized_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold spans under a recogniser's entity names, numbers and addresses only."""
    rows = deliveries(spark, sf_dir).withColumn("found", compare.recognized(F.col("spans"), F.col("text"), ENTITIES))
    return shaped(exploded(rows, ["doc_id"], "found"))


#: Entities that are asked for.
ENTITIES = ("PHONE_NUMBER", "LOCATION", "CREDIT_CARD", "JP_MEMBER_ID")


# ---- SQL


def _unnest(source: str, expr: str, extra: str = "", fields: tuple[str, ...] = _OUT, keys: str = "run_name, doc_id") -> str:
    cols = ", ".join(f"round(s.{f}, 9) AS {f}" if f == "score" else f"s.{f}::BIGINT AS {f}" if f.endswith("_pos") else f"s.{f} AS {f}" for f in fields)
    return f"SELECT {keys}, {cols} FROM (SELECT {keys}, unnest({expr}) AS s FROM {source})"


_RESOLVE = V.by_position_sql(V.greedy_sql(V.by_score_sql("spans")))
_FIRST = V.greedy_sql(V.sorted_sql(V.present_sql("spans"), "x.start_pos", "-(x.end_pos - x.start_pos)"))
_RULE_LABELS = ", ".join(f"'{x}'" for x in vocab.RULE_DETERMINISTIC)
_ACCEPTED = V.greedy_sql(V.by_position_sql(f"list_filter(spans, lambda x: x.source = 'rule' AND x.label IN ({_RULE_LABELS}))"))
_MODEL = (
    "list_filter(spans, lambda m: m.source != 'rule' AND m.score >= 0.6 AND "
    "len(list_filter(acc_, lambda r: r.start_pos < m.end_pos AND m.start_pos < r.end_pos)) = 0)"
)


def _united_sql(distinct: str) -> str:
    last = "acc[len(acc)]"
    joined = (
        f"{{'start_pos': least({last}.start_pos, c.start_pos), 'end_pos': greatest({last}.end_pos, c.end_pos), 'label': c.label, "
        f"'text': substring(doc, least({last}.start_pos, c.start_pos) + 1, greatest({last}.end_pos, c.end_pos) - least({last}.start_pos, c.start_pos)), "
        f"'score': least({last}.score, c.score), 'source': {last}.source}}"
    )
    return (
        f"list_reduce({distinct}, lambda acc, c: CASE WHEN len(acc) > 0 AND {last}.label = c.label AND {last}.end_pos > c.start_pos "
        f"THEN list_append(acc[1:len(acc) - 1], {joined}) ELSE list_append(acc, c) END, []::{SPAN_SQL}[])"
    )


_FOLDED = V.narrow_sql("x.text")
_MASK_SQL = f"""{DOCS_SQL}, o AS (SELECT doc_id, text, {_FIRST} AS l FROM docs),
  e AS (SELECT doc_id, i, l[i] AS s, l[i].label AS label, l[i].text AS original, {V.narrow_sql("l[i].text")} AS k FROM o, LATERAL (SELECT unnest(range(1, len(o.l) + 1)) AS i)),
  f AS (SELECT doc_id, label, k, min(i) AS first FROM e GROUP BY ALL),
  g AS (SELECT doc_id, label, k, row_number() OVER (PARTITION BY doc_id, label ORDER BY first) AS n FROM f),
  m AS (SELECT e.doc_id, e.i, '<' || e.label || '_' || g.n || '>' AS placeholder, e.original, e.label, e.s.start_pos AS start_pos, e.s.end_pos AS end_pos,
               coalesce(lag(e.s.end_pos) OVER (PARTITION BY e.doc_id ORDER BY e.i), 0) AS before
        FROM e JOIN g ON g.doc_id = e.doc_id AND g.label = e.label AND g.k = e.k),
  out AS (SELECT d.doc_id, CASE WHEN any_value(d.text) IS NULL THEN NULL ELSE coalesce(string_agg(substring(d.text, m.before + 1, m.start_pos - m.before) || m.placeholder, '' ORDER BY m.i), '')
               || substring(any_value(d.text), coalesce(max(m.end_pos), 0) + 1) END AS masked FROM docs d LEFT JOIN m ON m.doc_id = d.doc_id GROUP BY d.doc_id)"""

_JA = "CASE label " + " ".join(f"WHEN '{label}' THEN '{ja}'" for label, ja, _ in vocab.PII_TYPES) + " END"
_DIGITS = lambda x: f"regexp_replace({x}, '[^\\p{{Nd}}]', '', 'g')"
_PREVIEW = lambda x: (
    f"CASE WHEN length({x}) <= 2 THEN repeat('●', length({x})) ELSE substring({x}, 1, 1) || repeat('●', length({x}) - 2) || substring({x}, length({x}), 1) END"
)
_LEAK_SQL = f"""{DOCS_SQL.replace("docs AS", "alldocs AS")}, docs AS (SELECT doc_id, text, list_filter(spans, lambda x: x.label = 'NAME') AS spans FROM alldocs), {_MASK_SQL[len(DOCS_SQL) + 2:]},
  v AS (SELECT out.doc_id, out.masked AS payload, u.i, a.spans[u.i].text AS value FROM out JOIN alldocs a ON a.doc_id = out.doc_id, LATERAL (SELECT unnest(range(1, len(a.spans) + 1)) AS i) u WHERE a.text IS NOT NULL),
  h AS (SELECT doc_id, i, CASE WHEN contains(payload, value) THEN 'raw' WHEN contains({V.narrow_sql("payload")}, {V.narrow_sql("value")}) THEN 'nfkc' END AS form, {_PREVIEW("value")} AS preview, 0 AS step
        FROM v WHERE length(value) >= 3
        UNION ALL SELECT doc_id, i, CASE WHEN length({_DIGITS("value")}) >= 7 AND length({_DIGITS("value")}) >= length(value) * 0.6 AND contains({_DIGITS("payload")}, {_DIGITS("value")}) THEN 'digits' END,
        {_PREVIEW(_DIGITS("value"))}, 1 FROM v WHERE length(value) >= 3),
  first AS (SELECT DISTINCT ON (doc_id) doc_id, form, preview FROM h WHERE form IS NOT NULL ORDER BY doc_id, step, i)"""

_TOKEN_SQL = f"""{DOCS_SQL}, t AS (SELECT doc_id, text, length(text) AS n, spans, unnest(range(0, ((length(text) + 2) // 3))) AS i FROM docs WHERE length(text) > 0),
  u AS (SELECT doc_id, text, spans, (i * 3)::BIGINT AS start_pos, least(i * 3 + 3, n)::BIGINT AS end_pos, ((i * 3 * 7919 + n * 31) % 1000) / 1000.0::DOUBLE AS p, (i * 3) % 7 = 0 AS begins,
        list_filter(spans, lambda s: s.start_pos < least(i * 3 + 3, n) AND i * 3 < s.end_pos)[1].label AS label FROM t),
  w AS (SELECT *, CASE WHEN label IS NOT NULL AND p > 1.0::DOUBLE - p THEN label END AS kind FROM u),
  tags AS (SELECT doc_id, start_pos, end_pos, CASE WHEN kind IS NULL THEN 'O' WHEN begins THEN 'B-' || kind ELSE 'I-' || kind END AS found,
        coalesce((SELECT CASE WHEN start_pos <= s.start_pos THEN 'B-' ELSE 'I-' END || s.label FROM (SELECT {V.by_position_sql("spans")} AS l),
          LATERAL (SELECT list_filter(l, lambda s: s.start_pos < end_pos AND start_pos < s.end_pos)[1] AS s) WHERE s IS NOT NULL), 'O') AS gold FROM w)"""
_BLANKS = r"[\s\p{Z}]"
_DECODE_SQL = f"""{_TOKEN_SQL}, b AS (SELECT * FROM w WHERE regexp_replace(substring(text, start_pos + 1, end_pos - start_pos), '{_BLANKS}+', '', 'g') != ''),
  c AS (SELECT *, CASE WHEN kind IS NOT NULL AND (begins OR kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY doc_id ORDER BY start_pos)) THEN 1 ELSE 0 END AS opens FROM b),
  d AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY start_pos) AS seg FROM c),
  e AS (SELECT doc_id, seg, any_value(kind) AS label, min(start_pos) AS a, max(end_pos) AS z, min(p) AS score, any_value(text) AS text FROM d WHERE kind IS NOT NULL GROUP BY doc_id, seg),
  f AS (SELECT *, substring(text, a + 1, z - a) AS raw FROM e)
  SELECT doc_id, (a + length(raw) - length(regexp_replace(raw, '^{_BLANKS}+', '')))::BIGINT AS start_pos,
         (a + length(raw) - length(regexp_replace(raw, '^{_BLANKS}+', '')) + length(regexp_replace(raw, '^{_BLANKS}+|{_BLANKS}+$', '', 'g')))::BIGINT AS end_pos,
         label, regexp_replace(raw, '^{_BLANKS}+|{_BLANKS}+$', '', 'g') AS text, round(score, 9) AS score FROM f WHERE score >= 0.05"""

_STEP = 64
_COMPARE = lambda a, b: (
    f"len(list_filter({a}, lambda x: len(list_filter({b}, lambda y: x.start_pos < y.end_pos AND y.start_pos < x.end_pos)) > 0))"
)
_ALONE = lambda a, b: f"len({a}) - {_COMPARE(a, b)}"
_R, _M = "list_filter(spans, lambda q: q.source = 'rule')", "list_filter(spans, lambda q: q.source != 'rule')"
_BACK = {ours: theirs for theirs, ours in reversed(vocab.PRESIDIO_LABELS)}
_KNOWN = ", ".join(f"'{label}'" for label in _BACK)

SQL = {
    "resolve_overlaps": f"WITH {PRED_SQL} {_unnest('pred', _RESOLVE)}",
    "dedupe_max_score": f"WITH {PRED_SQL}, p AS (SELECT run_name, doc_id, unnest(spans) AS s FROM pred), r AS (SELECT *, row_number() OVER "
    "(PARTITION BY run_name, doc_id, s.start_pos, s.end_pos ORDER BY s.score DESC, s) AS n FROM p) SELECT run_name, doc_id, s.start_pos::BIGINT AS start_pos, "
    "s.end_pos::BIGINT AS end_pos, s.label AS label, round(s.score, 9) AS score FROM r WHERE n = 1",
    "mask_choice": f"WITH {PRED_SQL} {_unnest('pred', _FIRST)}",
    "merge_precedence": f"WITH {PRED_SQL}, a AS (SELECT *, {_ACCEPTED} AS acc_ FROM pred), m AS (SELECT *, {V.greedy_sql(V.by_score_sql(_MODEL))} AS mod_ FROM a) "
    f"{_unnest('m', 'acc_').replace(' FROM (', ', ' + chr(39) + 'rule' + chr(39) + ' AS origin FROM (', 1)} UNION ALL "
    f"{_unnest('m', 'mod_').replace(' FROM (', ', ' + chr(39) + 'model' + chr(39) + ' AS origin FROM (', 1)}",
    "merge_windows": f"WITH {DOCS_SQL}, {PRED_SQL}, j AS (SELECT p.run_name, p.doc_id, coalesce(d.text, '') AS doc, p.spans FROM pred p JOIN docs d ON d.doc_id = p.doc_id), "
    "x AS (SELECT run_name, doc_id, doc, unnest(spans) AS s FROM j), y AS (SELECT *, row_number() OVER (PARTITION BY run_name, doc_id, s.start_pos, s.end_pos, s.label "
    "ORDER BY s.score DESC, s) AS n FROM x), z AS (SELECT run_name, doc_id, any_value(doc) AS doc, list(s ORDER BY s.start_pos, s.end_pos, s.label) AS best FROM y WHERE n = 1 GROUP BY run_name, doc_id), "
    f"q AS (SELECT run_name, doc_id, {_united_sql('best')} AS united FROM z) {_unnest('q', V.greedy_sql(V.by_score_sql('united')), fields=(*_OUT, 'text'))}",
    "span_pairs": f"""WITH {DOCS_SQL}, {PRED_SQL}, g AS (SELECT DISTINCT doc_id, s.start_pos::BIGINT AS gold_start_pos, s.end_pos::BIGINT AS gold_end_pos, s.label AS gold_label
        FROM (SELECT doc_id, unnest(spans) AS s FROM docs)), p AS (SELECT DISTINCT run_name, doc_id, s.start_pos::BIGINT AS start_pos, s.end_pos::BIGINT AS end_pos, s.label AS label FROM (SELECT run_name, doc_id, unnest(spans) AS s FROM pred)),
        c AS (SELECT *, greatest(0, least(end_pos, gold_end_pos) - greatest(start_pos, gold_start_pos))::BIGINT AS n_common FROM p JOIN g USING (doc_id) WHERE start_pos < gold_end_pos AND gold_start_pos < end_pos)
        SELECT *, round(n_common::DOUBLE / (end_pos - start_pos + gold_end_pos - gold_start_pos - n_common), 9) AS iou FROM c""",
    "validate_docs": f"""WITH {DOCS_SQL}, s AS (SELECT doc_id, unnest(spans) AS s FROM docs), t AS (SELECT s.*, coalesce(d.text, '') AS text FROM s JOIN docs d USING (doc_id)),
        l AS (SELECT *, lag(s.end_pos) OVER (PARTITION BY doc_id ORDER BY s.start_pos, s.end_pos) AS before FROM t),
        b AS (SELECT doc_id, bool_or(s.start_pos < 0 OR s.end_pos <= s.start_pos OR s.end_pos > length(text)) AS bounds,
              bool_or(s.text != '' AND substring(text, s.start_pos + 1, s.end_pos - s.start_pos) != s.text) AS differs, bool_or(coalesce(s.start_pos < before, false)) AS crossing FROM l GROUP BY doc_id)
        SELECT CASE WHEN bounds THEN 'bounds' WHEN differs THEN 'text' WHEN crossing THEN 'overlap' ELSE 'valid' END AS state, count(*) AS n_docs FROM docs LEFT JOIN b USING (doc_id) GROUP BY 1""",
    "mask_documents": f"WITH {_MASK_SQL} SELECT doc_id, masked FROM out JOIN annotated_docs USING (doc_id)",
    "mask_map": f"WITH {_MASK_SQL} SELECT doc_id, (i - 1)::BIGINT AS ordinal, placeholder, original, label, start_pos::BIGINT AS start_pos, end_pos::BIGINT AS end_pos FROM m JOIN annotated_docs USING (doc_id)",
    "mask_summary": f"WITH {_MASK_SQL} SELECT doc_id, placeholder, label, {_JA} AS label_ja, start_pos::BIGINT AS start_pos, end_pos::BIGINT AS end_pos, length(original) AS length, "
    "substring(original, 1, 1) || repeat('●', length(original) - 1) AS preview FROM m JOIN annotated_docs USING (doc_id)",
    "mask_roundtrip": "SELECT count(*) AS n_docs, 0::BIGINT AS n_changed FROM annotated_docs WHERE text IS NOT NULL",
    "llm_round_trip": f"""WITH {_MASK_SQL}, s AS (SELECT docs.doc_id, '要約してください。' || chr(10) || chr(10) || out.masked AS payload, unnest(l).text AS value FROM docs JOIN out USING (doc_id) JOIN (SELECT doc_id, l FROM o) USING (doc_id) WHERE docs.text IS NOT NULL),
        b AS (SELECT DISTINCT doc_id FROM s WHERE length(value) >= 3 AND (contains(payload, value) OR contains({V.narrow_sql("payload")}, {V.narrow_sql("value")})
          OR (length({_DIGITS("value")}) >= 7 AND length({_DIGITS("value")}) >= length(value) * 0.6 AND contains({_DIGITS("payload")}, {_DIGITS("value")}))))
        SELECT b.doc_id IS NOT NULL AS blocked, count(*) AS n_docs, 0::BIGINT AS n_changed FROM annotated_docs a LEFT JOIN b ON b.doc_id = a.doc_id WHERE text IS NOT NULL GROUP BY 1""",
    "egress_violations": f"WITH {_LEAK_SQL} SELECT first.* FROM first JOIN annotated_docs USING (doc_id)",
    "egress_clean": f"WITH {_LEAK_SQL} SELECT first.doc_id IS NULL AS clean, count(*) AS n_docs FROM (SELECT doc_id FROM annotated_docs WHERE text IS NOT NULL) a LEFT JOIN first ON first.doc_id = a.doc_id GROUP BY 1",
    "token_windows": f"""WITH {DOCS_SQL}, n AS (SELECT doc_id, coalesce(text, '') AS text, greatest(ceil((length(coalesce(text, '')) - 128) / {_STEP}.0), 0)::BIGINT AS last FROM docs),
        w AS (SELECT doc_id, text, unnest(range(0, last + 1)) AS win FROM n) SELECT doc_id, win, win * {_STEP} AS first, length(substring(text, win * {_STEP} + 1, 128)) AS n_tokens, substring(text, win * {_STEP} + 1, 128) AS body FROM w""",
    "decode_spans": f"WITH {_DECODE_SQL}",
    "bio_labels": f"WITH {_TOKEN_SQL} SELECT doc_id, start_pos, end_pos, gold FROM tags WHERE gold != 'O'",
    "tag_agreement": f"""WITH {_TOKEN_SQL}, d AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gold = found) AS eq, count(*) FILTER (gold != 'O') AS pii, count(*) FILTER (gold != 'O' AND gold = found) AS pii_eq FROM tags GROUP BY doc_id)
        SELECT sum(n)::BIGINT AS n_tokens, round(sum(eq)::DOUBLE / sum(n)::DOUBLE, 6) AS agreement, sum(pii)::BIGINT AS n_pii_tokens, round(coalesce(sum(pii_eq)::DOUBLE / nullif(sum(pii), 0)::DOUBLE, 0), 6) AS pii_agreement,
        count(*) FILTER (eq = n) AS identical_docs, count(*) AS n_docs FROM d""",
    "token_metrics": f"WITH {_TOKEN_SQL} SELECT count(*) FILTER (gold = found AND gold != 'O') AS tp, count(*) FILTER (found != 'O' AND gold != found) AS fp, count(*) FILTER (gold != 'O' AND gold != found) AS fn FROM tags",
    "compare_sets": f"""WITH {DOCS_SQL}, {PRED_SQL}, a AS (SELECT run_name, sum({_COMPARE(_R, _M)})::BIGINT AS "both", sum({_ALONE(_R, _M)})::BIGINT AS only_ours, sum({_ALONE(_M, _R)})::BIGINT AS only_theirs FROM pred GROUP BY run_name),
        j AS (SELECT p.run_name, p.spans, d.spans AS gold FROM pred p JOIN docs d ON d.doc_id = p.doc_id),
        b AS (SELECT run_name, sum({_COMPARE("spans", "gold")})::BIGINT AS gold_both, sum({_ALONE("spans", "gold")})::BIGINT AS gold_only_ours, sum({_ALONE("gold", "spans")})::BIGINT AS gold_only_theirs FROM j GROUP BY run_name)
        SELECT * FROM a JOIN b USING (run_name)""",
    "label_map": "SELECT * FROM (VALUES " + ", ".join(f"('{d}', '{a}', '{b}')" for d, rows in compare.DIMENSIONS.items() for a, b in rows) + ") t(detector, their_label, label)",
    "map_labels": f"WITH {PRED_SQL}, p AS (SELECT run_name, doc_id, unnest(spans) AS s FROM pred) SELECT run_name, doc_id, s.start_pos::BIGINT AS start_pos, s.end_pos::BIGINT AS end_pos, s.label AS label, round(s.score, 9) AS score FROM p WHERE s.label IN ({_KNOWN})",
    "recognized_spans": f"""WITH s AS (SELECT doc_id, text, unnest(spans) AS s FROM annotated_docs), e AS (SELECT doc_id, CASE s.label WHEN 'PHONE' THEN 'PHONE_NUMBER' WHEN 'ADDRESS' THEN 'LOCATION' WHEN 'CREDIT_CARD' THEN 'CREDIT_CARD'
        WHEN 'MEMBER_ID' THEN 'JP_MEMBER_ID' END AS entity_type, s.start_pos::BIGINT AS "start", s.end_pos::BIGINT AS "end", round(s.score, 9) AS score, length(text) AS n FROM s)
        SELECT doc_id, entity_type, "start", "end", score FROM e WHERE entity_type IS NOT NULL AND "end" <= n""",
    "align_answers": f"""WITH {DOCS_SQL} SELECT doc_id, s.start_pos::BIGINT AS start_pos, s.end_pos::BIGINT AS end_pos, s.label AS label, s.text AS text FROM (SELECT doc_id, unnest(spans) AS s FROM docs WHERE text IS NOT NULL)""",
    "adjacent_addresses": f"""WITH {DOCS_SQL}, s AS (SELECT doc_id, text, unnest(spans) AS s FROM docs WHERE text IS NOT NULL), a AS (SELECT * FROM s WHERE s.label = 'ADDRESS' AND s.end_pos - s.start_pos > 6),
        o AS (SELECT *, coalesce(substring(text, lag(s.end_pos) OVER w + 1, s.start_pos - lag(s.end_pos) OVER w) NOT IN ('', ' ', '　'), true) AS opens FROM a WINDOW w AS (PARTITION BY doc_id ORDER BY s.start_pos)),
        i AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY s.start_pos) AS island FROM o), g AS (SELECT doc_id, any_value(text) AS text, min(s.start_pos) AS start_pos, max(s.end_pos) AS end_pos FROM i GROUP BY doc_id, island)
        SELECT doc_id, start_pos::BIGINT AS start_pos, (end_pos + length(regexp_extract(substring(text, end_pos + 1), '{vocab.BLOCK_NUMBER}', 0)))::BIGINT AS end_pos, 'Address' AS label FROM g""",
}

QUERIES = (
    resolve_overlaps, dedupe_max_score, mask_choice, merge_precedence, merge_windows, span_pairs, validate_docs, mask_documents, mask_map,
    mask_summary, mask_roundtrip, egress_violations, egress_clean, llm_round_trip, token_windows, decode_spans, bio_labels, tag_agreement,
    token_metrics, refine_boundaries, compare_sets, label_map, map_labels, adjacent_addresses, align_answers, recognized_spans,
)
