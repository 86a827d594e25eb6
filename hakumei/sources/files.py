"""Readers and writers: documents and caches as JSON lines, whole-text files, mappings with private permissions, calibrators, rules."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spans as S
from ..operators import corpus
from ..operators.calibrate import Calibrator
from .schemas import CORPUS_ITEM, DOCUMENT


def span_to_file(spans: Column) -> Column:
    """Spans as in files: start and end, score with six places, sorted."""
    return F.transform(
        S.by_position(spans),
        lambda s: F.struct(
            s["start_pos"].alias("start"), s["end_pos"].alias("end"), s["label"].alias("label"), s["text"].alias("text"),
            F.bround(s["score"], 6).alias("score"), s["source"].alias("source"),
        ),
    )


def span_from_file(spans: Column) -> Column:
    """Spans of a file with defaults: empty text, score 1, source 'model'."""
    return F.transform(
        F.coalesce(spans, F.slice(spans, 1, 0)),
        lambda s: F.struct(
            s["start"].alias("start_pos"), s["end"].alias("end_pos"), s["label"].alias("label"),
            F.coalesce(s["text"], F.lit("")).alias("text"), F.coalesce(s["score"], F.lit(1.0)).alias("score"),
            F.coalesce(s["source"], F.lit("model")).alias("source"),
        ).cast(S.SPAN),
    )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of documents; missing fields get their defaults, blank lines are no documents."""
    raw = spark.read.schema(DOCUMENT).json(path)
    empty = {c: F.coalesce(c, F.lit("")) for c in ("doc_id", "text", "genre", "source_license", "source_ref")}
    return raw.withColumns(
        empty
        | {
            "subset": F.coalesce("subset", F.lit("train")),
            "spans": F.coalesce(span_from_file(F.col("spans")), S.no_spans()),
            "negative_kinds": F.coalesce("negative_kinds", F.array().cast("array<string>")),
            "meta": F.coalesce("meta", F.create_map().cast("map<string,string>")),
        }
    )


def broken_spans(text: Column, spans: Column) -> Column:
    """Why a document is invalid, null if it isn't: a span out of bounds, a text that isn't the slice, overlapping gold spans."""
    s = S.ordered(F.coalesce(spans, F.slice(spans, 1, 0)), lambda x: x["start_pos"], lambda x: x["end_pos"])
    bounds = F.exists(s, lambda x: (x["start_pos"] < 0) | (x["end_pos"] <= x["start_pos"]) | (x["end_pos"] > F.length(text)))
    differs = F.exists(s, lambda x: (x["text"] != "") & (F.substring(text, x["start_pos"] + 1, x["end_pos"] - x["start_pos"]) != x["text"]))
    gold = F.filter(s, lambda x: x["source"] == "gold")
    crossing = F.exists(F.transform(gold, lambda x, i: x["start_pos"] < F.get(gold, i - 1)["end_pos"]), lambda b: F.coalesce(b, F.lit(False)))
    return F.when(bounds, "bounds").when(differs, "text").when(crossing, "overlap")


def write_documents(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Documents as JSON lines. An invalid document fails the write; meta keys that begin with _ are left out."""
    reason = broken_spans(F.col("text"), F.col("spans"))
    checked = F.when(reason.isNotNull(), F.raise_error(F.concat(F.lit("invalid document "), "doc_id", F.lit(": "), reason)).cast("string"))
    rows = df.withColumn("doc_id", F.coalesce(checked, F.col("doc_id"))).withColumn("spans", span_to_file(F.col("spans")))
    if "meta" in df.columns:
        rows = rows.withColumn("meta", F.map_filter("meta", lambda k, v: ~F.startswith(k, F.lit("_"))))
    rows.write.mode(mode).json(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Cached corpus items: broken lines, items without id or text and repeated ids are skipped."""
    raw = spark.read.schema(CORPUS_ITEM).option("mode", "DROPMALFORMED").json(path)
    return corpus.first_of_id(raw)


def append_cache(items: DataFrame, path: str) -> int:
    """Appends the items whose ids the cache doesn't hold yet; returns their number."""
    spark = items.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    cache = read_cache(spark, path) if there else spark.createDataFrame([], CORPUS_ITEM)
    new = corpus.unseen(items, cache).withColumn("normalized", F.lit(True)).persist()
    n = new.count()
    if n:
        new.write.mode("append").json(path)
    new.unpersist()
    return n


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): every file is one document."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def save_private(data: str, path: str) -> None:
    """A file only its owner can read: it is created with these permissions before anything is written."""
    handle = os.open(path, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600)
    try:
        os.fchmod(handle, 0o600)
        os.write(handle, data.encode())
    finally:
        os.close(handle)


def save_map(entries: list[dict], path: str, doc_id: str = "") -> None:
    save_private(json.dumps({"version": "1", "doc_id": doc_id, "entries": entries}, ensure_ascii=False), path)


def load_map(path: str) -> list[dict]:
    return json.loads(Path(path).read_text())["entries"]


def write_mapping(rows: DataFrame, path: str) -> None:
    """The sensitive mapping as a table of its own; directories and files are private to the owner."""
    conf = rows.sparkSession._jsc.hadoopConfiguration()
    before = conf.get("fs.permissions.umask-mode")
    conf.set("fs.permissions.umask-mode", "077")
    try:
        rows.write.parquet(path)
    finally:
        if before is None:
            conf.unset("fs.permissions.umask-mode")
        else:
            conf.set("fs.permissions.umask-mode", before)


def save_calibrator(calibrator: Calibrator, path: str) -> None:
    Path(path).write_text(calibrator.to_json(), encoding="utf-8")


def load_calibrator(path: str) -> Calibrator:
    return Calibrator.from_json(Path(path).read_text(encoding="utf-8"))
