"""Corpus preparation: quality of chunks, chunking, sentences, caches, even draws from sources."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vocab

# Character classes and headings of the chunk rules.
JAPANESE = r"[々ぁ-ゟ゠-ヿ㐀-䶿一-鿿]"
MARKUP = r"[=|{}\[\]<>#*_~^\\]"
DROPPED_SECTIONS = (
    "脚注", "注釈", "出典", "参考文献", "関連項目", "外部リンク", "参照", "ギャラリー", "参考", "文献", "註", "補注",
    "リンク", "作品一覧", "ディスコグラフィ", "受賞", "参考資料",
)
MARKUP_LINE_STARTS = ("|", "!", "*", "#", ":", ";", "{", "}")
COPYRIGHT_FLAGS = ("作品著作権フラグ", "人物著作権フラグ")
SOURCE_ALIASES = {
    "wikipedia": "wikipedia_ja", "wikipedia_ja": "wikipedia_ja", "wiki": "wikipedia_ja", "egov": "egov_law",
    "egov_law": "egov_law", "law": "egov_law", "aozora": "aozora", "novel": "aozora",
}
LICENSES = (
    ("wikipedia_ja", "ウィキペディア日本語版", "Japanese Wikipedia", "CC BY-SA 4.0", "wiki", True),
    ("egov_law", "e-Gov 法令検索 (法令 API v2)", "e-Gov Japanese statute search (Law API v2)",
     "Public Domain (Japanese Copyright Act, Article 13)", "law", False),
    ("aozora", "青空文庫 (globis-university/aozorabunko-clean)", "Aozora Bunko (via globis-university/aozorabunko-clean)",
     "Public Domain (Aozora Bunko, copyright expired)", "novel", False),
)


def quality(text: Column) -> dict[str, Column]:
    """Measures and verdict of a chunk: n_chars, n_ja, n_markup, n_lines, n_short_lines, good."""
    n = F.length(text)
    ja, markup = F.regexp_count(text, F.lit(JAPANESE)), F.regexp_count(text, F.lit(MARKUP))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, r"(?U)\s+", "") != "")
    short = F.filter(lines, lambda x: F.length(x) < 14)
    listed = (F.size(lines) >= 4) & (F.size(short) / F.size(lines) > 0.6)
    good = (
        (n >= vocab.MIN_CHUNK // 2) & (ja >= vocab.MIN_JA_CHARS) & (ja / n >= vocab.MIN_JA_RATIO)
        & (markup / n <= vocab.MAX_MARKUP_RATIO) & ~listed
    )
    return {
        "n_chars": n, "n_ja": ja, "n_markup": markup, "n_lines": F.size(lines), "n_short_lines": F.size(short),
        "good": F.coalesce(good, F.lit(False)),
    }


def normalize_python(text: str) -> str:
    """The normalisation of functions.text for code that runs in Python anyway."""
    lines = unicodedata.normalize("NFKC", text).replace("\r\n", "\n").replace("\r", "\n")
    return lines.translate({ord(c): "-" for c in "‐‑‒–—―−－"})


def paragraphs(text: str) -> list[str]:
    """Runs of content lines; headings and markup end one, a heading of a dropped section ends the text."""
    runs: list[list[str]] = [[]]
    for raw in text.split("\n"):
        line = re.sub("[ \t　]+", " ", raw).strip()
        probe = unicodedata.normalize("NFKC", line).strip()
        heading = re.fullmatch(r"=+[^=]*=+", probe)
        if heading and probe.strip("= ").startswith(DROPPED_SECTIONS):
            break
        markup = probe.startswith(MARKUP_LINE_STARTS) or probe.count("|") > 1 or any(x in probe for x in ("{{", "}}", "[["))
        if not line or heading or markup:
            runs.append([])
        else:
            runs[-1].append(line)
    return ["\n".join(r) for r in runs if r]


def sentence_runs(paragraph: str, least: int, most: int) -> list[str]:
    """A long paragraph as runs of whole sentences of at most `most` characters; a longer sentence is cut hard."""
    parts = []
    for sentence in re.split(r"(?<=[。．！？!?])", paragraph):
        parts += [sentence[i : i + most] for i in range(0, len(sentence), most)]
    runs, current = [], ""
    for part in parts:
        hard = len(part) == most
        if current and (hard or len(current) + len(part) > most):
            runs.append(current)
            current = ""
        current += part
        if hard or len(current) >= max(least, (least + most) // 2):
            runs.append(current)
            current = ""
    return [*runs, current] if current else runs


def chunk(text: str, least: int = vocab.MIN_CHUNK, most: int = vocab.MAX_CHUNK) -> list[str]:
    """Chunks of `least` to `most` characters from whole paragraphs where they fit, normalised once."""
    packed: list[str] = []
    current = ""
    for p in paragraphs(text):
        fits = len(p) <= most
        if current and (not fits or len(current) + 1 + len(p) > most):
            packed.append(current)
            current = ""
        if not fits:
            packed += sentence_runs(p, least, most)
            continue
        current = f"{current}\n{p}" if current else p
        if len(current) >= most:
            packed.append(current)
            current = ""
    packed.append(current)
    return [normalize_python(c.strip()) for c in packed if len(c.strip()) >= least]


def chunked(df: DataFrame, item_id: str, text: str, least: int = vocab.MIN_CHUNK, most: int = vocab.MAX_CHUNK, limit: int | None = None) -> DataFrame:
    """(item_id, chunk_no, text) of all chunks of good quality; null and empty texts have none. `limit` chunks per item is a feature of the operator."""

    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunk(t, least, most) if t else [])

    cut_up = df.withColumn("_chunks", F.pandas_udf(cut, "array<string>")(F.col(text)))
    chunks = F.filter("_chunks", lambda c: quality(c)["good"])
    if limit is not None:
        chunks = F.slice(chunks, 1, limit)
    df = cut_up
    return df.select(F.col(item_id).alias("item_id"), F.posexplode(chunks).alias("chunk_no", "text"))


def base_sentences(text: Column, least: int = 20, most: int = 170) -> Column:
    """Sentences ending in 。 that are fit as filler: none with names, quotations, addresses or postal codes if there are any such."""
    flat = F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")
    all_ = F.filter(F.split(flat, "(?<=。)", -1), lambda s: F.length(s).between(least, most))
    calm = F.filter(all_, lambda s: ~s.rlike(r"[「」『』]|氏|さん|様|君|@|\d{3}-\d{4}"))
    return F.when(F.size(calm) > 0, calm).otherwise(all_)


def canonical_source(col: Column) -> Column:
    """Key of a source by any of its short names; others stay as they are."""
    names = F.create_map(*(F.lit(x) for pair in SOURCE_ALIASES.items() for x in pair))
    return F.coalesce(names[F.lower(F.trim(col))], col)


def license_table(spark) -> DataFrame:
    return spark.createDataFrame(
        list(LICENSES), "source string, source_ja string, source_en string, license string, genre string, share_alike boolean"
    )


def first_of_id(items: DataFrame, item_id: str = "item_id", order: list[Column] | None = None) -> DataFrame:
    """The first row of each id; rows without id or text are left out. Without `order` the least text comes first."""
    keys = order or [F.col("text")]
    rows = items.where((F.coalesce(F.col(item_id), F.lit("")) != "") & (F.coalesce(F.col("text"), F.lit("")) != ""))
    w = Window.partitionBy(item_id).orderBy(*keys)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def unseen(items: DataFrame, cache: DataFrame, item_id: str = "item_id") -> DataFrame:
    """Rows to append to a cache: one for each id the cache doesn't hold."""
    return first_of_id(items, item_id).join(cache.select(item_id).distinct(), item_id, "left_anti")


def even_draw(items: DataFrame, n: int, source: Column, item_id: str = "item_id", seed: int = 0) -> DataFrame:
    """n items, as even over the sources as their sizes allow, in hashed order (a sampling operator).

    Every item gets its hashed rank within its source, so rank 1 of all sources comes before
    rank 2 of any. Items are counted by source and hash bucket first, and only those in the buckets that hold
    the first n of their source are ranked, so a source of any size is never sorted as a whole. The hash is the first
    60 bits of the MD5 of seed and id.
    """
    h = F.conv(F.left(F.md5(F.concat_ws(":", F.lit(str(seed)), item_id).cast("binary")), F.lit(15)), 16, 10).cast("long")
    rows = first_of_id(items, item_id).withColumn("_source", F.coalesce(source, F.lit(""))).withColumn("_h", h)
    rows = rows.withColumn("_bucket", F.shiftright("_h", 48).cast("int"))
    counts = rows.groupBy("_source", "_bucket").count()
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # 4096 rows at most
    needed = counts.withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).where(F.col("_before") < n)
    low = rows.join(needed.select("_source", "_bucket"), ["_source", "_bucket"], "left_semi")
    w = Window.partitionBy("_source").orderBy("_h", item_id)
    ranked = low.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    return ranked.orderBy("_r", "_h", item_id).limit(n).drop("_source", "_bucket", "_h", "_r")


def base_corpus(items: DataFrame, n: int, sources: tuple[str, ...], item_id: str = "item_id", seed: int = 0) -> DataFrame:
    """n items of the sources (by any of their names), as even over them as their sizes allow; fewer if there are fewer."""
    keys = sorted({SOURCE_ALIASES.get(s.strip().lower(), s) for s in sources})
    source = canonical_source(F.split(item_id, ":")[0])
    return even_draw(items.where(source.isin(keys)), n, source, item_id, seed)


def free_works(records: DataFrame, meta: str = "meta") -> DataFrame:
    """Records of a library dump whose copyright flags, of work and person, are missing, empty or 'なし'; meta: map<string,string>."""
    free = [F.coalesce(F.try_element_at(F.col(meta), F.lit(k)), F.lit("なし")).isin("なし", "", "None") for k in COPYRIGHT_FLAGS]
    return records.where(free[0] & free[1])


# Tags of law texts that are skipped, and those followed by a line break or a blank.
LAW_SKIPPED = frozenset((
    "TOC", "SupplProvision", "AppdxTable", "AppdxNote", "AppdxStyle", "AppdxFig", "AppdxFormat", "Appdx", "LawNum",
    "LawTitle", "EnactStatement", "TableStruct", "Table", "FigStruct", "Fig", "Remarks", "NoteStruct", "Note",
    "StyleStruct", "Style", "FormatStruct", "ArithFormula", "Ruby", "Rt",
))
LAW_LINES = frozenset(("ArticleCaption", "Paragraph", "Item", "Subitem1", "Subitem2", "ChapterTitle", "SectionTitle"))
LAW_BLANKS = frozenset(("ArticleTitle", "ParagraphNum", "ItemTitle", "Subitem1Title", "Subitem2Title", "ColumnNum"))


def law_text(tree) -> str:
    """Text of a law tree (nested dicts with tag and children), of any depth; an element with text ends with its mark."""
    marks = dict.fromkeys(LAW_LINES, "\n") | dict.fromkeys(LAW_BLANKS, "　")
    written: list[str] = []
    todo: list[tuple[str, object]] = [("open", tree)]
    while todo:
        step, what = todo.pop()
        if step == "close":
            mark, since = what
            if len(written) > since:
                written.append(mark)
        elif isinstance(what, str):
            written += [what] if what else []
        elif isinstance(what, dict) and what.get("tag") not in LAW_SKIPPED:
            if what.get("tag") in marks:
                todo.append(("close", (marks[what["tag"]], len(written))))
            todo += [("open", child) for child in reversed(what.get("children") or ())]
    return "".join(written)


def law_articles(tree) -> list[tuple[str, str]]:
    """(number, text) of the articles of a law tree in order; numbers missing in the tree are counted."""
    found: list[tuple[str, str]] = []
    stack = [tree]
    while stack:
        node = stack.pop()
        if not isinstance(node, dict) or node.get("tag") in LAW_SKIPPED:
            continue
        if node.get("tag") == "Article":
            body = law_text(node).strip()
            if body:
                found.append((str((node.get("attr") or {}).get("Num", len(found) + 1)), body))
        else:
            stack += reversed(node.get("children") or ())
    return found


def laws(df: DataFrame, law_id: str, body: str) -> DataFrame:
    """(law_id, article, text) from JSON law trees; trees that can't be parsed and nulls have no articles."""
    import json

    def read(bodies: pd.Series) -> pd.Series:
        def one(raw):
            try:
                return law_articles(json.loads(raw)) if raw else []
            except ValueError:
                return []

        return bodies.map(lambda raw: [{"article": a, "text": t} for a, t in one(raw)])

    articles = F.pandas_udf(read, "array<struct<article:string,text:string>>")(F.col(body))
    return df.select(F.col(law_id).alias("law_id"), F.explode(articles).alias("a")).select("law_id", "a.*")
