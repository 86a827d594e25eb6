"""The rule layer: declarative specs, candidates with context and checksum, greedy resolution."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions import text as X
from ..functions import vocab

#: Checks of a matched value, by name; further ones may be added by users.
VALIDATORS: dict[str, Callable[[Column], Column]] = {"jp_phone": X.jp_phone_ok}

#: Recorded next to a match, never a reason to drop it.
CHECKSUMS: dict[str, Callable[[Column], Column]] = {"CREDIT_CARD": X.luhn_ok, "MYNUMBER": X.mynumber_ok}


@dataclass(frozen=True)
class Rule:
    rule_id: str
    label: str
    pattern: str
    confidence: float = 0.9
    require_context: bool = False
    priority: int = 0
    context: tuple[str, ...] = ()
    negative_context: tuple[str, ...] = ()
    validator: str | None = None


DEFAULT_RULES = tuple(Rule(*row) for row in vocab.RULES)


CANDIDATE = (
    "struct<start_pos:int,end_pos:int,label:string,text:string,score:double,source:string,rule_id:string,"
    "matched_context:string,priority:int,checksum_valid:boolean,keep:boolean>"
)


def selected(rules: Iterable[Rule] | None = None, types: Iterable[str] | None = None) -> list[Rule]:
    allowed = set(vocab.RULE_DETERMINISTIC if types is None else types)
    return [r for r in (DEFAULT_RULES if rules is None else rules) if r.label in allowed]


def _of_rule(text: Column, rule: Rule, width: int) -> Column:
    check = CHECKSUMS.get(rule.label)

    def found(m: Column) -> Column:
        start, value = m["start_pos"], m["text"]
        end = start + F.length(value)
        keep = F.lit(True)
        if rule.validator:
            keep = keep & VALIDATORS[rule.validator](value)
        if rule.label == "PHONE":
            keep = keep & ~X.looks_like_date(value)
        if rule.negative_context:
            left = X.slice_of(text, F.greatest(start - width, F.lit(0)), start)
            keep = keep & X.let(left, lambda x: X.first_word(x, rule.negative_context)).isNull()
        around = X.context(text, start, end, width)
        hit = X.let(around, lambda x: X.first_word(x, rule.context)) if rule.context else F.lit(None).cast("string")
        return X.let(F.struct(keep.alias("keep"), F.when(keep, hit).alias("hit")), lambda c: candidate(m, start, end, value, c["keep"], c["hit"]))

    def candidate(m: Column, start: Column, end: Column, value: Column, keep: Column, hit: Column) -> Column:
        bonus = F.when(hit.isNotNull(), F.lit(vocab.CONTEXT_BONUS)).otherwise(F.lit(0.0))
        return F.struct(
            start.alias("start_pos"), end.alias("end_pos"), F.lit(rule.label).alias("label"), value.alias("text"),
            F.least(F.lit(vocab.SCORE_CAP), F.lit(rule.confidence) + bonus).alias("score"), F.lit("rule").alias("source"),
            F.lit(rule.rule_id).alias("rule_id"), hit.alias("matched_context"), F.lit(rule.priority).alias("priority"),
            (check(value) if check else F.lit(None).cast("boolean")).alias("checksum_valid"),
            (keep & hit.isNotNull() if rule.require_context else keep).alias("keep"),
        )

    kept = F.filter(F.transform(X.pattern_matches(text, rule.pattern), found), lambda s: s["keep"])
    # a cheap search for what the rule can't do without saves most texts the pattern
    needs = rule.context if rule.require_context else ("@",) if rule in DEFAULT_RULES and "@" in rule.pattern else ()
    if not needs:
        return kept
    return F.when(X.any_word(text, needs), kept).otherwise(S.no_spans(CANDIDATE))


def with_candidates(
    df: DataFrame, text: str, out: str = "candidates", *, rules: Iterable[Rule] | None = None,
    types: Iterable[str] | None = None, width: int = vocab.CONTEXT_CHARS,
) -> DataFrame:
    """Adds all matches of all rules that pass validator and context.

    Null and empty texts have none. Where only default rules are chosen, only texts with a digit or
    an at sign are searched, which none of them can do without; other rules search every text.
    """
    chosen = tuple(selected(rules, types))
    if not chosen:
        return df.withColumn(out, S.no_spans(CANDIDATE))
    checks = tuple(VALIDATORS[r.validator] if r.validator else None for r in chosen)
    return df.withColumn(out, _candidates(df.sparkSession.sparkContext.applicationId, text, chosen, checks, width))


@lru_cache(maxsize=64)
def _candidates(application: str, text: str, chosen: tuple[Rule, ...], checks: tuple, width: int) -> Column:
    """The expression for a text column by name; it is the same for every table, so an application builds it once for the same rules and checks."""
    col = F.col(text)
    found = F.concat(*(_of_rule(col, r, width) for r in chosen))
    searched = col.rlike(r"(?U)[\d@]") if all(r in DEFAULT_RULES for r in chosen) else col != ""
    return F.when(searched, found).otherwise(S.no_spans(CANDIDATE))


def resolved(candidates: Column) -> Column:
    """Greedy by priority, score, length, position; sorted by position."""
    order = S.ordered(
        candidates, lambda s: -s["priority"], lambda s: -s["score"], lambda s: -S.length(s), lambda s: s["start_pos"]
    )
    return S.by_position(S.greedy(order, CANDIDATE))


def with_rule_spans(df: DataFrame, text: str, out: str = "rule_spans", **options) -> DataFrame:
    found = with_candidates(df, text, "_candidates", **options)
    return found.withColumn(out, resolved(F.col("_candidates"))).drop("_candidates")


def explained(df: DataFrame, doc_id: str, spans: str = "rule_spans") -> DataFrame:
    """One row per span: what was found by which rule and why."""
    s = F.col("s")
    return df.select(F.col(doc_id).alias("doc_id"), F.explode_outer(spans).alias("s")).where("s is not null").select(
        "doc_id", s["text"].alias("text"), s["label"].alias("label"), s["rule_id"].alias("rule_id"),
        F.round(s["score"], 3).alias("score"), s["matched_context"].alias("context"),
        s["checksum_valid"].alias("checksum_valid"), s["start_pos"].alias("start_pos"), s["end_pos"].alias("end_pos"),
    )


def export_rules(rules: Iterable[Rule] | None = None) -> str:
    """The spec table as JSON, validators by name."""
    rows = [asdict(r) | {"reject_date_shape": r.label == "PHONE"} for r in selected(rules, vocab.LABELS)]
    return json.dumps(rows, ensure_ascii=False, indent=1)


def import_rules(data: str) -> list[Rule]:
    fields = Rule.__dataclass_fields__
    return [
        Rule(**{k: tuple(v) if isinstance(v, list) else v for k, v in row.items() if k in fields}) for row in json.loads(data)
    ]
