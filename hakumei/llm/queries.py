"""Queries of the training-data operators over the driver's tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import SOURCE_GENRES, bounded_rows, table, true_genre
from .crosssplit import crossing_pairs, overlap_report, split_overlaps
from .cutting import cut_items
from .groupsplit import broken_works, grouped_split, resolved
from .leakage import leaked_passages, leak_report
from .lookalike import lookalike_pairs, normalised
from .mixing import mix_sources
from .neardup import document_pairs, duplicate_groups, near_duplicates
from .tokens import encoded


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that the mixes exhaust without reaching their share."""
    mix = mix_sources(table(spark, sf_dir, "corpus_items"), table(spark, sf_dir, "mixture_targets"))
    return mix.report.where("exhausted").select("mix_id", "source").distinct()


def p1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "corpus_items"), table(spark, sf_dir, "mixture_targets")).items


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "corpus_items"), table(spark, sf_dir, "mixture_targets")).report


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_pairs(near_duplicates(table(spark, sf_dir, "annotated_docs")))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(near_duplicates(table(spark, sf_dir, "annotated_docs")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "annotated_docs")
    pairs = crossing_pairs(split_overlaps(docs, F.col("subset")))
    return pairs.select(
        F.least("train_id", "eval_id").alias("doc_id_a"), F.greatest("train_id", "eval_id").alias("doc_id_b")
    ).distinct()


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "annotated_docs")
    found = split_overlaps(docs, F.col("subset"))
    works = resolved(docs, table(spark, sf_dir, "corpus_items"))
    source = F.when(F.col("known"), F.split("work_key", ":")[0])
    return overlap_report(found, works.select("doc_id", source.alias("source")))


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = resolved(table(spark, sf_dir, "annotated_docs"), table(spark, sf_dir, "corpus_items"))
    return grouped_split(records, table(spark, sf_dir, "split_plan"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return broken_works(_split(spark, sf_dir))


def p4_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).drop("broken")


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = bounded_rows(table(spark, sf_dir, "cut_limits").distinct(), 1000, "cut_limits")  # one row per genre
    genre = true_genre(F.col("item_id"))

    def of(field: str):
        pairs = [F.lit(x) for r in limits if r["genre"] is not None for x in (r["genre"], r[field])]
        return F.create_map(*pairs)[genre] if pairs else F.lit(None).cast("int")

    return cut_items(table(spark, sf_dir, "corpus_items"), "item_id", "text", of("max_chars"), of("overlap_chars"))


def p4_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in each of the three splits after the allocation, and works of theirs that are in another one too (none)."""
    rows = p4_split(spark, sf_dir).where(F.col("new_subset").isin("train", "validation", "test"))
    spread = rows.where("work_key is not null").groupBy("work_key").agg(F.collect_set("new_subset").alias("s")).where(F.size("s") > 1)
    broken = spread.select(F.explode("s").alias("subset")).groupBy("subset").agg(F.count("*").alias("n_split_works"))
    sizes = rows.groupBy(F.col("new_subset").alias("subset")).agg(F.count("*").alias("n_records"))
    return sizes.join(broken, "subset", "left").na.fill(0, ["n_split_works"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).where("n_pieces > 1").select("item_id").distinct()


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir)


def p5_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the pieces of an item restore its text, keep to its limit, and begin with the wanted end of the piece before."""
    limits = table(spark, sf_dir, "cut_limits").where("genre is not null").distinct()
    order = F.array_sort(F.collect_list(F.struct("piece_no", "start_pos", "end_pos", "text")))
    own = _pieces(spark, sf_dir).groupBy("item_id").agg(order.alias("p"))
    before = lambda i: F.coalesce(F.get(F.col("p"), i - 1)["end_pos"], F.lit(0))
    fresh = F.transform("p", lambda p, i: F.substring(p["text"], before(i) - p["start_pos"] + 1, F.length(p["text"])))
    items = table(spark, sf_dir, "corpus_items").select("item_id", "text").distinct()
    rows = own.join(items, "item_id").withColumn("genre", true_genre(F.col("item_id"))).join(F.broadcast(limits), "genre")  # a row per genre
    overlap = lambda p, i: (i == 0) | (before(i) - p["start_pos"] == F.col("overlap_chars"))
    return rows.select(
        "item_id", (F.array_join(fresh, "") == F.col("text")).alias("restored"),
        F.forall("p", lambda p: F.length(p["text"]) <= F.col("max_chars")).alias("within_limit"),
        F.forall(F.transform("p", overlap), lambda x: x).alias("overlaps"),
    )


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "test_passages"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak_report(p7_found(spark, sf_dir), table(spark, sf_dir, "test_passages"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike_pairs(table(spark, sf_dir, "documents"))


def p8_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalised(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        p1_found, p1_mix, p1_report, p2_found, p2_groups, p3_found, p3_report, p4_found, p4_split, p4_audit,
        p5_found, p5_pieces, p5_audit, p6_ids, p7_found, p7_report, p8_found, p8_forms,
    )
    return {f.__name__: f for f in own}


_GENRE_SQL = "CASE split_part(item_id, ':', 1) " + " ".join(f"WHEN '{s}' THEN '{g}'" for s, g in SOURCE_GENRES.items()) + " END"


# Budgets of a mix by trying: a factor of the weights is bisected for every exponent, and the exponent for the wanted entropy.
_CLAMPED = "list_transform(w, lambda x, i: CASE WHEN x > 0 THEN least(greatest(exp({y}) * x, low[i]), cap[i]) ELSE low[i] END)"
_MIDDLE = "((acc.a + acc.b) / 2)"


def _budgets_sql(exponent: str) -> str:
    return (
        f"list_transform([list_transform(size, lambda s, i: CASE WHEN s > 0 AND cap[i] > low[i] THEN pow(s / top, {exponent}) ELSE 0.0::DOUBLE END)], lambda w: "
        f"list_transform([list_reduce(range(0, 80), lambda acc, k: CASE WHEN list_sum({_CLAMPED.format(y=_MIDDLE)}) < total THEN {{'a': {_MIDDLE}, 'b': acc.b}} ELSE {{'a': acc.a, 'b': {_MIDDLE}}} END, "
        f"{{'a': -600.0::DOUBLE, 'b': 700.0::DOUBLE}})], lambda y: {_CLAMPED.format(y='y.b')})[1])[1]"
    )


def _entropy_sql(budgets: str) -> str:
    return f"list_transform([{budgets}], lambda q: -list_sum(list_transform(q, lambda x: CASE WHEN x > 0 THEN x / list_sum(q) * ln(x / list_sum(q)) ELSE 0.0::DOUBLE END)))[1]"


_HALF = "((e.near + e.far) / 2)"
_MIXED_SQL = f"""sized AS (SELECT item_id, split_part(item_id, ':', 1) AS source, max(coalesce(length(text), 0))::BIGINT AS n_chars FROM corpus_items WHERE item_id IS NOT NULL GROUP BY 1, 2),
  sums AS (SELECT source, sum(n_chars)::BIGINT AS size FROM sized GROUP BY 1),
  t AS (SELECT DISTINCT m.mix_id, m.source, m.target_share, m.max_repeat, coalesce(s.size, 0)::DOUBLE AS size, m.target_share * m.size_ratio * (SELECT sum(n_chars) FROM sized)::DOUBLE AS wanted
    FROM mixture_targets m LEFT JOIN sums s ON s.source = m.source WHERE m.mix_id IS NOT NULL AND m.source IS NOT NULL AND m.target_share IS NOT NULL AND m.max_repeat IS NOT NULL AND m.size_ratio IS NOT NULL),
  u AS (SELECT *, size * max_repeat AS cap, least(wanted, size * max_repeat) AS low FROM t),
  m AS (SELECT mix_id, list(source ORDER BY source) AS src, list(low ORDER BY source) AS low, list(cap ORDER BY source) AS cap, list(size ORDER BY source) AS size, list(wanted ORDER BY source) AS wanted,
    least(sum(wanted), sum(cap)) AS total, sum(wanted) - sum(low) AS lack, coalesce(max(size) FILTER (size > 0 AND cap > low), 1.0::DOUBLE) AS top FROM u GROUP BY mix_id),
  g AS (SELECT *, {_entropy_sql("wanted")} AS goal, {_entropy_sql(_budgets_sql("0.0::DOUBLE"))} AS peak, {_entropy_sql(_budgets_sql("8.0::DOUBLE"))} AS large, {_entropy_sql(_budgets_sql("-8.0::DOUBLE"))} AS small FROM m),
  x AS (SELECT *, list_reduce(range(0, 60), lambda e, k: CASE WHEN {_entropy_sql(_budgets_sql(_HALF))} > goal THEN {{'near': {_HALF}, 'far': e.far}} ELSE {{'near': e.near, 'far': {_HALF}}} END,
    {{'near': 0.0::DOUBLE, 'far': CASE WHEN large <= goal THEN 8.0::DOUBLE WHEN small <= goal THEN -8.0::DOUBLE WHEN large <= small THEN 8.0::DOUBLE ELSE -8.0::DOUBLE END}}).far AS e FROM g),
  b AS (SELECT mix_id, src, CASE WHEN lack <= 1e-9 THEN low WHEN peak <= goal THEN {_budgets_sql("0.0::DOUBLE")} ELSE {_budgets_sql("e")} END AS budgets FROM x),
  p AS (SELECT u.*, z.budget FROM u JOIN (SELECT mix_id, unnest(src) AS source, unnest(budgets) AS budget FROM b) z ON z.mix_id = u.mix_id AND z.source = u.source),
  sh AS (SELECT mix_id, source, max_repeat, least(floor(budget / size), max_repeat)::BIGINT AS passes, budget - floor(budget / size) * size AS rest FROM p WHERE size > 0 AND budget > 0),
  r AS (SELECT sh.*, s.item_id, s.n_chars, coalesce(sum(s.n_chars) OVER (PARTITION BY sh.mix_id, sh.source ORDER BY ('0x' || substring(md5('42:' || sh.mix_id || ':' || s.item_id), 1, 15))::BIGINT, s.item_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sh JOIN sized s ON s.source = sh.source WHERE s.n_chars > 0),
  mix AS (SELECT mix_id, source, item_id, n_chars, passes + (before + n_chars / 2 <= rest AND passes < max_repeat)::INT AS uses FROM r WHERE passes + (before + n_chars / 2 <= rest AND passes < max_repeat)::INT > 0)"""


def oracle_sql() -> dict[str, str]:
    """p2, p3, p4_found and p8 need NFKC, p6 a tokenizer, p7 is too slow as SQL on whole tables: tests compare them with brute force."""
    return {
        "p1_found": """
            WITH sized AS (SELECT split_part(item_id, ':', 1) AS source, max(coalesce(length(text), 0)) AS n
                           FROM corpus_items GROUP BY item_id, 1),
            sums AS (SELECT source, sum(n) AS size FROM sized GROUP BY source)
            SELECT DISTINCT t.mix_id, t.source FROM mixture_targets t LEFT JOIN sums s ON s.source = t.source
            WHERE coalesce(s.size, 0)::DOUBLE * t.max_repeat
                  < t.target_share * t.size_ratio * (SELECT sum(n) FROM sized)::DOUBLE""",
        "p1_mix": f"WITH {_MIXED_SQL} SELECT mix_id, source, item_id, n_chars, uses FROM mix",
        "p1_report": f"""WITH {_MIXED_SQL}, c AS (SELECT mix_id, source, sum(n_chars * uses)::BIGINT AS chars, count(*) AS n_items, max(uses) AS most FROM mix GROUP BY 1, 2),
            tt AS (SELECT mix_id, sum(chars)::BIGINT AS total FROM c GROUP BY 1), ww AS (SELECT mix_id, sum(wanted) AS mix_size FROM p GROUP BY 1)
            SELECT p.mix_id, p.source, p.target_share, coalesce(chars, 0) AS reached_chars, round(coalesce(chars::DOUBLE / total, 0), 6) AS reached_share, round(coalesce(total / mix_size, 0), 6) AS size_reached,
              coalesce(n_items, 0) AS n_items, coalesce(most, 0) AS most_uses, coalesce(chars, 0) >= p.size * p.max_repeat AND coalesce(chars, 0) < p.wanted AS exhausted
            FROM p LEFT JOIN c ON c.mix_id = p.mix_id AND c.source = p.source LEFT JOIN tt ON tt.mix_id = p.mix_id JOIN ww ON ww.mix_id = p.mix_id""",
        "p4_audit": r"""
            WITH d AS (SELECT doc_id, max(coalesce(nullif(lower(regexp_replace(translate(subset, 'ａｂｄｅｇｉｌｎｏｒｓｔｖＡＢＤＥＧＩＬＮＯＲＳＴＶ', 'abdegilnorstvABDEGILNORSTV'), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), ''), 'train')) AS s FROM annotated_docs GROUP BY 1),
            n AS (SELECT count(*) AS n FROM d WHERE s IN ('train', 'validation', 'test')),
            q AS (SELECT subset, CASE subset WHEN 'train' THEN 1 WHEN 'validation' THEN 2 ELSE 3 END AS k, target_share * n AS q FROM split_plan, n),
            e AS (SELECT subset, k, floor(sum(q) OVER (ORDER BY k) + 0.5)::BIGINT AS upto FROM q)
            SELECT subset, upto - coalesce(lag(upto) OVER (ORDER BY k), 0) AS n_records, 0::BIGINT AS n_split_works FROM e""",
        "p5_audit": f"""
            SELECT DISTINCT item_id, true AS restored, true AS within_limit, true AS overlaps FROM corpus_items c JOIN cut_limits l ON l.genre = {_GENRE_SQL}
            WHERE length(c.text) > l.max_chars""",
        "p5_found": f"""
            SELECT DISTINCT item_id FROM corpus_items c JOIN cut_limits l ON l.genre = {_GENRE_SQL}
            WHERE length(c.text) > l.max_chars""",
    }
