"""Queries of corpus preparation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab
from ..operators import corpus
from ..sources import publish
from .frames import shaped, spread, table


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus items once each."""
    return corpus.first_of_id(table(spark, sf_dir, "corpus_items"))


def corpus_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    return shaped(items.select("item_id", *(c.alias(n) for n, c in corpus.quality(F.col("text")).items())))


def base_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir).withColumn("s", corpus.base_sentences(F.col("text")))
    return items.select("item_id", F.posexplode("s").alias("n", "sentence")).select("item_id", F.col("n").cast("long").alias("n"), "sentence")


def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(corpus.chunked(spread(_items(spark, sf_dir)), "item_id", "text"))


def cache_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items to append to a cache that holds all aozora items already."""
    items = table(spark, sf_dir, "corpus_items")
    cache = items.where(F.startswith("item_id", F.lit("aozora:")))
    return corpus.unseen(items, cache).select("item_id", "text")


def cache_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).select("item_id", "text")


def even_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """300 items, as even over the sources as they allow (a sampling operator)."""
    drawn = corpus.even_draw(table(spark, sf_dir, "corpus_items"), 300, F.split("item_id", ":")[0], seed=5)
    return drawn.groupBy(F.split("item_id", ":")[0].alias("source")).agg(F.count("*").alias("n_items"))


def base_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """90 items of two sources, named by short names (a sampling operator)."""
    return corpus.base_corpus(table(spark, sf_dir, "corpus_items"), 90, ("wiki", "Novel"), seed=3).select("item_id", "text")


def published_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in flat form: length of the spans' JSON, keys of meta that are left, kinds."""
    flat = publish.flat_rows(table(spark, sf_dir, "annotated_docs").select("doc_id", "spans", "meta", "negative_kinds"))
    keys = F.array_join(F.array_sort(F.map_keys(F.from_json("meta", "map<string,string>"))), ",")
    n = F.coalesce(F.size(F.from_json("spans", "array<struct<start:int,end:int,label:string>>")), F.lit(0)).cast("long")
    return flat.select("doc_id", n.alias("n_spans"), keys.alias("meta_keys"), F.array_join("negative_kinds", ",").alias("kinds"))


def license_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.license_table(spark)


def canonical_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "corpus_items").where("source is not null")
    return items.groupBy(corpus.canonical_source(F.col("source")).alias("canonical")).agg(F.count("*").alias("n_rows"))


_ITEMS_SQL = "items AS (SELECT item_id, min(text) AS text FROM corpus_items WHERE item_id IS NOT NULL AND item_id != '' AND text IS NOT NULL AND text != '' GROUP BY item_id)"
_BLANK = r"[\s\p{Z}]"


_HASH = "('0x' || substring(md5('{seed}:' || item_id), 1, 15))::BIGINT"


def _drawn_sql(n: int, source: str, seed: int, where: str = "true") -> str:
    """View drawn: the first n items by rank within their source, then hash."""
    return f"""{_ITEMS_SQL}, hashed AS (SELECT item_id, text, {source} AS source, {_HASH.format(seed=seed)} AS h FROM items),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, item_id) AS r FROM hashed WHERE {where}), drawn AS (SELECT * FROM ranked ORDER BY r, h, item_id LIMIT {n})"""


SQL = {
    "even_draw": f"WITH {_drawn_sql(300, "split_part(item_id, ':', 1)", 5)} SELECT source, count(*) AS n_items FROM drawn GROUP BY 1",
    "base_corpus": f"WITH {_drawn_sql(90, "split_part(item_id, ':', 1)", 3, "source IN ('wikipedia_ja', 'aozora')")} SELECT item_id, text FROM drawn",
    "published_rows": """SELECT doc_id, coalesce(len(spans), 0)::BIGINT AS n_spans, array_to_string(list_sort(list_filter(map_keys(coalesce(meta, MAP {}::MAP(VARCHAR, VARCHAR))), lambda k: NOT starts_with(k, '_'))), ',') AS meta_keys,
        array_to_string(coalesce(negative_kinds, []::VARCHAR[]), ',') AS kinds FROM annotated_docs""",
    "corpus_quality": rf"""WITH {_ITEMS_SQL}, m AS (SELECT item_id, text, length(text) AS n_chars, len(regexp_extract_all(text, '{corpus.JAPANESE}')) AS n_ja, len(regexp_extract_all(text, '{corpus.MARKUP}')) AS n_markup,
        list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '{_BLANK}+', '', 'g') != '') AS lines FROM items),
      k AS (SELECT *, len(lines) AS n_lines, len(list_filter(lines, lambda x: length(x) < 14)) AS n_short_lines FROM m)
      SELECT item_id, n_chars, n_ja, n_markup, n_lines, n_short_lines, n_chars >= {vocab.MIN_CHUNK // 2} AND n_ja >= {vocab.MIN_JA_CHARS} AND n_ja / n_chars >= {vocab.MIN_JA_RATIO}::DOUBLE
        AND n_markup / n_chars <= {vocab.MAX_MARKUP_RATIO}::DOUBLE AND NOT (n_lines >= 4 AND n_short_lines / n_lines > 0.6::DOUBLE) AS good FROM k""",
    "base_sentences": rf"""WITH {_ITEMS_SQL}, f AS (SELECT item_id, regexp_replace(regexp_replace(text, '{_BLANK}+', ' ', 'g'), '^ | $', '', 'g') AS t FROM items),
      p AS (SELECT item_id, list_transform(string_split(t, '。'), lambda x, i: CASE WHEN i < len(string_split(t, '。')) THEN x || '。' ELSE x END) AS parts FROM f),
      a AS (SELECT item_id, list_filter(parts, lambda s: length(s) BETWEEN 20 AND 170) AS l FROM p), c AS (SELECT item_id, l, list_filter(l, lambda s: NOT regexp_matches(s, '[「」『』]|氏|さん|様|君|@|[0-9]{{3}}-[0-9]{{4}}')) AS calm FROM a),
      o AS (SELECT item_id, CASE WHEN len(calm) > 0 THEN calm ELSE l END AS l FROM c)
      SELECT item_id, (i - 1)::BIGINT AS n, l[i] AS sentence FROM (SELECT item_id, l, unnest(range(1, len(l) + 1)) AS i FROM o)""",
    "cache_append": f"WITH {_ITEMS_SQL} SELECT item_id, text FROM items WHERE item_id NOT LIKE 'aozora:%'",
    "cache_read": f"WITH {_ITEMS_SQL} SELECT item_id, text FROM items",
    "canonical_source": "SELECT CASE lower(trim(source)) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in corpus.SOURCE_ALIASES.items())
    + " ELSE source END AS canonical, count(*) AS n_rows FROM corpus_items WHERE source IS NOT NULL GROUP BY 1",
    "license_table": "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v).lower() for v in r) + ")" for r in corpus.LICENSES)
    + ") t(source, source_ja, source_en, license, genre, share_alike)",
}

QUERIES = (corpus_quality, base_sentences, chunk_text, cache_append, cache_read, even_draw, base_corpus, published_rows, license_table, canonical_source)
