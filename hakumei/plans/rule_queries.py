"""Queries of the rule layer, scalar functions and facade; SQL for the rules is generated from the same spec table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocab
from ..operators import match, rules
from .detector import Detector
from .frames import exploded, greedy_sql, narrow, narrow_sql, shaped, sorted_sql, spread, table

_FIELDS = ("start_pos", "end_pos", "label", "text", "score", "rule_id", "matched_context", "priority", "checksum_valid")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their width forms folded, so that SQL can find the same spans."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("text", narrow(F.col("text")))


def _rows(df: DataFrame, column: str) -> DataFrame:
    return shaped(exploded(df, ["doc_id"], column, _FIELDS))


def rule_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(rules.with_candidates(_texts(spark, sf_dir), "text"), "candidates")


def rule_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(rules.with_rule_spans(_texts(spark, sf_dir), "text"), "rule_spans")


def email_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.with_candidates(_texts(spark, sf_dir), "text", types=("EMAIL",))
    return _rows(found, "candidates").select("doc_id", "start_pos", "end_pos", "text", "score")


def card_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.with_candidates(_texts(spark, sf_dir), "text", types=("CREDIT_CARD",))
    return _rows(found, "candidates").select("doc_id", "start_pos", "end_pos", "text", "checksum_valid")


def rule_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(rules.explained(rules.with_rule_spans(_texts(spark, sf_dir), "text"), "doc_id"))


def context_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a rule matched, with and without a context word."""
    rows = rule_candidates(spark, sf_dir)
    return rows.groupBy("rule_id").agg(F.count("*").alias("n"), F.count("matched_context").alias("n_context"))


#: Rules as a user may add them: neither needs a digit or an at sign.
CUSTOM = (
    rules.Rule("own.place", "NAME", "東京|大阪", 0.5, priority=5, context=("支店", "市"), negative_context=("東京都",)),
    rules.Rule("own.word", "MEMBER_ID", "会議|[A-Z]{3,}", 0.6, priority=7),
    rules.Rule("own.optional", "EMAIL", "@?担当", 0.7, priority=1),
)


def custom_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.with_rule_spans(_texts(spark, sf_dir), "text", rules=CUSTOM, types=vocab.LABELS)
    return _rows(found, "rule_spans").drop("checksum_valid")


def rule_spans_nfkc(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("text", X.normalize(F.col("text")))
    return _rows(rules.with_rule_spans(docs, "text"), "rule_spans")


def detect_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Detector().detect(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return shaped(exploded(found, ["doc_id"], "spans"))


def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return Detector().redact(docs).select("doc_id", "masked")


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.normalize(F.col("text")).alias("text"))


def rules_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(r.rule_id, r.label, r.confidence, r.require_context, r.priority, len(r.context), len(r.negative_context)) for r in rules.DEFAULT_RULES]
    return shaped(spark.createDataFrame(rows, "rule_id string, label string, confidence double, require_context boolean, priority int, n_context int, n_negative int"))


def pii_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(match.label_dimension(spark))


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of many shapes made from customer keys by integer arithmetic."""
    k = F.col("c_custkey").cast("decimal(38,0)")
    pad = lambda prime, n: F.lpad(((k * prime) % 10**n).cast("string"), n, "0")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.concat(F.lit("0"), F.element_at(F.array(*map(F.lit, ("70", "3", "120", "50", "800", "463"))), (F.col("c_custkey") % 6 + 1).cast("int")),
                 F.lit("-"), pad(7919, 3), F.lit("-"), pad(104729, 4), F.when(F.col("c_custkey") % 5 == 0, "1").otherwise("")).alias("phone"),
        F.concat(F.lit("4"), pad(48271, 14), (F.col("c_custkey") % 10).cast("string")).alias("card"),
        F.concat(pad(69621, 11), ((F.col("c_custkey") * 3) % 10).cast("string")).alias("mynumber"),
    )


def number_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbers(spark, sf_dir).select(
        "c_custkey", "phone", X.jp_phone_ok(F.col("phone")).alias("phone_ok"), X.luhn_ok(F.col("card")).alias("luhn_ok"),
        X.mynumber_ok(F.col("mynumber")).alias("mynumber_ok"),
    )


def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Previews, kana, widths, kanji numbers and era dates."""
    rows = table(spark, sf_dir, "predictions").select("text", F.to_date("logged_at").alias("day")).distinct()
    t = F.col("text")
    day = F.date_sub("day", (F.length(t) * 700).cast("int"))
    return rows.where("text is not null").select(
        "text", day.cast("string").alias("day"), X.preview(t).alias("preview"), X.summary_preview(t).alias("summary_preview"),
        X.hiragana(t).alias("hiragana"), X.fullwidth(t).alias("fullwidth"), X.kanji_number(F.length(t)).alias("kanji"),
        X.wareki(day).alias("wareki"), X.digits(narrow(t)).alias("digits"), X.looks_like_date(t).alias("date_like"),
    ).distinct()


# ---- SQL

_TOKEN, _WORD = r"0-9A-Za-z\-", "0-9A-Za-z"

#: Bodies of the rules for texts in which every character outside the token class stands twice; so a match can
#: take one copy on either side as its border. (rule, characters that stand once, body)
_BLANK = r"[\s\p{Z}]{2}"
_BODIES = {
    "phone.jp": (_TOKEN, rf"(?:\+\+81(?:-|{_BLANK})?)?0\d{{1,4}}(?:-|\(\(|\)\)|{_BLANK})?\d{{1,4}}(?:-|\)\)|{_BLANK})?\d{{3,4}}"),
    "postal.jp": (_TOKEN, r"\d{3}-\d{4}"),
    "bank.code_branch_account": (_TOKEN, r"\d{4}-\d{3}-\d{7}"),
    "card.16digit": (_TOKEN, rf"(?:\d{{4}}(?:-|{_BLANK})\d{{4}}(?:-|{_BLANK})\d{{4}}(?:-|{_BLANK})\d{{4}}|\d{{16}})"),
    "card.amex": (_TOKEN, rf"3[47]\d{{2}}(?:-|{_BLANK})\d{{6}}(?:-|{_BLANK})\d{{5}}"),
    "mynumber.12digit": (_TOKEN, rf"(?:\d{{4}}(?:-|{_BLANK})\d{{4}}(?:-|{_BLANK})\d{{4}}|\d{{12}})"),
    "member.prefixed": (_WORD, r"[A-Z]{2,6}(?:--)?\d{4,12}(?:--\d{2,6})?"),
    "member.numeric_ctx": (_TOKEN, r"\d{6,12}(?:-\d{2,6})?"),
}
_EMAIL = r"[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?)+"


def _found_sql(rule: rules.Rule) -> str:
    """doc_id, text, start_pos, value of all matches of a rule."""
    if rule.rule_id == "email.basic":
        once, before, border, after, body = "", r"()", "", r"()", _EMAIL
        doubled = "text"
    elif rule.rule_id == "bank.prose":
        once, doubled = _TOKEN, rf"regexp_replace(text, '([^{_TOKEN}])', '\1\1', 'g')"
        before, after = "()", rf"($|[^{_TOKEN}])"
        body = rf"(?:普普通通|当当座座|貯貯蓄蓄)(?:{_BLANK})*(?:預預金金)?(?:{_BLANK})*\d{{7}}"
    else:
        once, body = _BODIES[rule.rule_id]
        doubled = rf"regexp_replace(text, '([^{once}])', '\1\1', 'g')"
        before, after = rf"(^|[^{once}])", rf"($|[^{once}])"
    pattern = f"{before}({body}){after}"
    single = (lambda x: f"(length(regexp_replace({x}, '[^{once}]', '', 'g')) + length(regexp_replace({x}, '[{once}]', '', 'g')) // 2)") if once else (lambda x: f"length({x})")
    plain = pattern.replace("(", "(?:").replace("(?:?:", "(?:").replace(r"\(?:", r"\(")
    value = "substring(text, start_pos + 1, start_length)"
    return f"""
      SELECT doc_id, text, start_pos, {value} AS value FROM (
        SELECT doc_id, text, {single("prefix")} AS start_pos, {single("body")} AS start_length, prefix FROM (
          SELECT doc_id, text, substring(t2, 1, list_sum(list_transform(parts[1:i], lambda x: length(x)))::BIGINT
                   + coalesce(list_sum(list_transform(whole[1:i-1], lambda x: length(x))), 0)::BIGINT + length(lefts[i])) AS prefix, bodies[i] AS body
          FROM (SELECT doc_id, text, t2, string_split_regex(t2, '{plain}') AS parts, regexp_extract_all(t2, '{pattern}', 0) AS whole,
                       regexp_extract_all(t2, '{pattern}', 1) AS lefts, regexp_extract_all(t2, '{pattern}', 2) AS bodies
                FROM (SELECT doc_id, text, {doubled} AS t2 FROM texts)) z, LATERAL (SELECT unnest(range(1, len(z.whole) + 1)) AS i)))
      {r"WHERE start_pos = 0 OR NOT regexp_matches(substring(text, start_pos, 1), '[A-Za-z0-9._%+\-]')" if rule.rule_id == "email.basic" else ""}"""


def _phone_sql(v: str) -> str:
    d = f"regexp_replace({v}, '[^0-9]', '', 'g')"
    return (
        f"({d} LIKE '0%' AND length({d}) = CASE WHEN substring({d}, 1, 3) IN ('070', '080', '090', '050') OR substring({d}, 1, 4) = '0800' "
        "THEN 11 ELSE 10 END)"
    )


def _luhn_sql(v: str) -> str:
    d = f"reverse(regexp_replace({v}, '[^0-9]', '', 'g'))"
    return (
        f"(length({d}) >= 12 AND list_sum(list_transform(string_split({d}, ''), lambda c, i: CASE WHEN i % 2 = 1 THEN c::INT "
        "WHEN c::INT > 4 THEN c::INT * 2 - 9 ELSE c::INT * 2 END)) % 10 = 0)"
    )


def _mynumber_sql(v: str) -> str:
    d = f"regexp_replace({v}, '[^0-9]', '', 'g')"
    total = " + ".join(f"substring({d}, {i}, 1)::INT * {w}" for i, w in enumerate((6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2), 1))
    return f"CASE WHEN length({d}) = 12 THEN substring({d}, 12, 1)::INT = CASE WHEN ({total}) % 11 <= 1 THEN 0 ELSE 11 - ({total}) % 11 END ELSE false END"


def _first_sql(where: str, words: tuple[str, ...]) -> str:
    return "CASE " + " ".join(f"WHEN contains({where}, '{w}') THEN '{w}'" for w in words) + " END" if words else "NULL::VARCHAR"


def _plain_found_sql(rule: rules.Rule) -> str:
    """The same for a pattern without borders."""
    return f"""SELECT doc_id, text, (list_sum(list_transform(parts[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(whole[1:i-1], lambda x: length(x))), 0)::BIGINT) AS start_pos, whole[i] AS value
      FROM (SELECT doc_id, text, string_split_regex(text, '{rule.pattern}') AS parts, regexp_extract_all(text, '{rule.pattern}') AS whole FROM texts) z, LATERAL (SELECT unnest(range(1, len(z.whole) + 1)) AS i)"""


def _rule_sql(rule: rules.Rule) -> str:
    check = {"CREDIT_CARD": _luhn_sql("value"), "MYNUMBER": _mynumber_sql("value")}.get(rule.label, "NULL::BOOLEAN")
    keep = ["true"]
    if rule.validator:
        keep.append(_phone_sql("value"))
    if rule.negative_context:
        keep.append(f"{_first_sql('lft', rule.negative_context)} IS NULL")
    if rule.require_context:
        keep.append(f"{_first_sql('around', rule.context)} IS NOT NULL")
    hit = _first_sql("around", rule.context)
    return f"""
    SELECT doc_id, start_pos::BIGINT AS start_pos, (start_pos + length(value))::BIGINT AS end_pos, '{rule.label}' AS label, value AS text,
           least(0.99::DOUBLE, {rule.confidence}::DOUBLE + CASE WHEN {hit} IS NOT NULL THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END) AS score,
           '{rule.rule_id}' AS rule_id, {hit} AS matched_context, {rule.priority}::BIGINT AS priority, {check} AS checksum_valid
    FROM (SELECT *, substring(text, greatest(start_pos - 12, 0) + 1, start_pos - greatest(start_pos - 12, 0)) AS lft,
                 substring(text, greatest(start_pos - 12, 0) + 1, start_pos + length(value) + 12 - greatest(start_pos - 12, 0)) AS around
          FROM ({_plain_found_sql(rule) if rule in CUSTOM else _found_sql(rule)})) WHERE {" AND ".join(keep)}"""


def _candidates_sql(labels: tuple[str, ...] = vocab.RULE_DETERMINISTIC, specs: tuple[rules.Rule, ...] = rules.DEFAULT_RULES) -> str:
    chosen = [r for r in specs if r.label in labels]
    union = " UNION ALL ".join(_rule_sql(r) for r in chosen)
    return f"WITH texts AS (SELECT doc_id, {narrow_sql('text')} AS text FROM documents WHERE text IS NOT NULL), c AS ({union})"


_OUT = "doc_id, start_pos, end_pos, label, text, round(score, 9) AS score, rule_id, matched_context, priority, checksum_valid"
_CANDIDATE = (
    "STRUCT(start_pos BIGINT, end_pos BIGINT, label VARCHAR, text VARCHAR, score DOUBLE, rule_id VARCHAR, matched_context VARCHAR, "
    "priority BIGINT, checksum_valid BOOLEAN)"
)
_PACK = "{" + ", ".join(f"'{f}': {f}" for f in _FIELDS) + "}"
_ORDER = [r.rule_id for r in (*rules.DEFAULT_RULES, *CUSTOM)]
_SPEC_ORDER = "CASE rule_id " + " ".join(f"WHEN '{r}' THEN {i}" for i, r in enumerate(_ORDER)) + " END"
_RESOLVE = f"""packed AS (
  SELECT doc_id, list({_PACK} ORDER BY {_SPEC_ORDER}, start_pos) AS l FROM c GROUP BY doc_id),
  r AS (SELECT doc_id, unnest({greedy_sql(sorted_sql("l", "-x.priority", "-x.score", "-(x.end_pos - x.start_pos)", "x.start_pos"), _CANDIDATE)}) AS s FROM packed)"""
_RESOLVED_SQL = f"{_candidates_sql()}, {_RESOLVE}"


def _number_sql() -> str:
    pad = lambda prime, n: f"lpad(((c_custkey::HUGEINT * {prime}) % {10**n})::VARCHAR, {n}, '0')"
    return f"""WITH n AS (SELECT c_custkey, '0' || list_extract(['70', '3', '120', '50', '800', '463'], (c_custkey % 6 + 1)::INT) || '-' || {pad(7919, 3)}
        || '-' || {pad(104729, 4)} || CASE WHEN c_custkey % 5 = 0 THEN '1' ELSE '' END AS phone,
        '4' || {pad(48271, 14)} || (c_custkey % 10)::VARCHAR AS card, {pad(69621, 11)} || ((c_custkey * 3) % 10)::VARCHAR AS mynumber FROM customer)
      SELECT c_custkey, phone, {_phone_sql("phone")} AS phone_ok, {_luhn_sql("card")} AS luhn_ok, {_mynumber_sql("mynumber")} AS mynumber_ok FROM n"""


def _text_sql() -> str:
    kata, narrow_ = "".join(map(chr, range(0x30A1, 0x30F7))), "".join(map(chr, range(0x20, 0x7F))).replace("'", "''")
    hira, wide = "".join(chr(ord(c) - 0x60) for c in kata), "　" + "".join(map(chr, range(0xFF01, 0xFF5F)))
    era = "CASE " + " ".join(
        f"WHEN day >= DATE '{first}' THEN '{name}' || CASE WHEN year(day) = {first[:4]} THEN '元' ELSE (year(day) - {int(first[:4]) - 1})::VARCHAR END "
        "|| '年' || month(day)::VARCHAR || '月' || day(day)::VARCHAR || '日'"
        for name, first in reversed(vocab.ERAS)
    ) + " END"
    ones = "[" + ", ".join(f"'{c}'" for c in "一二三四五六七八九") + "]"
    kanji = (
        f"CASE WHEN n BETWEEN 1 AND 99 THEN CASE WHEN n // 10 = 0 THEN '' WHEN n // 10 = 1 THEN '十' ELSE {ones}[n // 10] || '十' END "
        f"|| CASE WHEN n % 10 = 0 THEN '' ELSE {ones}[n % 10] END END"
    )
    return f"""WITH p AS (SELECT DISTINCT text, (logged_at::DATE - (length(text) * 700)::INT)::DATE AS day, length(text) AS n FROM predictions WHERE text IS NOT NULL)
      SELECT DISTINCT text, day::VARCHAR AS day,
        CASE WHEN n <= 2 THEN repeat('●', n) ELSE substring(text, 1, 1) || repeat('●', n - 2) || substring(text, n, 1) END AS preview,
        substring(text, 1, 1) || repeat('●', greatest(n - 1, 0)) AS summary_preview, translate(text, '{kata}', '{hira}') AS hiragana,
        translate(text, '{narrow_}', '{wide}') AS fullwidth, {kanji} AS kanji, {era} AS wareki,
        regexp_replace({narrow_sql("text")}, '[^\\p{{Nd}}]', '', 'g') AS digits,
        regexp_matches(trim(text), '^(19|20)\\d{{2}}[-/.](0?[1-9]|1[0-2])[-/.](0?[1-9]|[12]\\d|3[01])$') AS date_like FROM p"""


def _values_sql(rows: list[tuple], names: str) -> str:
    def lit(v):
        return str(v).lower() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else f"{v}::BIGINT"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) t({names})"


SQL = {
    "rule_candidates": f"{_candidates_sql()} SELECT {_OUT} FROM c",
    "rule_spans": f"{_RESOLVED_SQL} SELECT doc_id, {', '.join(f's.{f} AS {f}' if f != 'score' else 'round(s.score, 9) AS score' for f in _FIELDS)} FROM r",
    "custom_rules": f"{_candidates_sql(vocab.LABELS, CUSTOM)}, {_RESOLVE} SELECT doc_id, {', '.join(f's.{f} AS {f}' if f != 'score' else 'round(s.score, 9) AS score' for f in _FIELDS[:-1])} FROM r",
    "email_spans": f"{_candidates_sql(('EMAIL',))} SELECT doc_id, start_pos, end_pos, text, round(score, 9) AS score FROM c",
    "card_spans": f"{_candidates_sql(('CREDIT_CARD',))} SELECT doc_id, start_pos, end_pos, text, checksum_valid FROM c",
    "rule_explain": f"{_RESOLVED_SQL} SELECT doc_id, s.text AS text, s.label AS label, s.rule_id AS rule_id, round(s.score, 3) AS score, "
    "s.matched_context AS context, s.checksum_valid AS checksum_valid, s.start_pos AS start_pos, s.end_pos AS end_pos FROM r",
    "context_gate": f"{_candidates_sql()} SELECT rule_id, count(*) AS n, count(matched_context) AS n_context FROM c GROUP BY rule_id",
    "rules_table": _values_sql(
        [(r.rule_id, r.label, r.confidence, r.require_context, r.priority, len(r.context), len(r.negative_context)) for r in rules.DEFAULT_RULES],
        "rule_id, label, confidence, require_context, priority, n_context, n_negative",
    ),
    "pii_types": _values_sql(
        [(i, *t, t[0] in vocab.RULE_DETERMINISTIC, t[0] in vocab.MODEL_DRIVEN) for i, t in enumerate(vocab.PII_TYPES)],
        "ordinal, label, ja, en, rule_deterministic, model_driven",
    ),
    "number_checks": _number_sql(),
    "text_functions": _text_sql(),
}

QUERIES = (
    rule_candidates, rule_spans, custom_rules, email_spans, card_spans, rule_explain, context_gate, rule_spans_nfkc, detect_spans, redact_documents,
    normalize_text, rules_table, pii_types, number_checks, text_functions,
)
