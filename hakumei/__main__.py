"""Command line: redact, restore, detect, eval."""

from __future__ import annotations

import argparse
import json
import sys
from collections import Counter
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import mask, match
from .plans.detector import Detector, PrecomputedSpans
from .ship import ship
from .sources import files


def _text(name: str) -> str:
    return sys.stdin.read() if name == "-" else Path(name).read_bytes().decode()


def _put(data: str, name: str) -> None:
    if name == "-":
        sys.stdout.write(data)
    else:
        Path(name).write_bytes(data.encode())


def _detector(args: argparse.Namespace, spark: SparkSession) -> Detector:
    model = calibrator = None
    if args.model and not args.no_model:
        if not Path(args.model).exists():
            raise RuntimeError(f"there are no model spans at {args.model}")
        model = PrecomputedSpans(spark.read.parquet(args.model))
        if args.calibrator and not args.no_calibration:
            calibrator = files.load_calibrator(args.calibrator)
    return Detector(threshold=args.threshold, use_rules=not args.no_rules, model=model, calibrator=calibrator)


def _input(args: argparse.Namespace, spark: SparkSession) -> DataFrame:
    """The whole file as one document, whose id is the name of the file."""
    return spark.createDataFrame([(args.input, _text(args.input))], "doc_id string, text string")


def redact(args: argparse.Namespace, spark: SparkSession) -> int:
    row = _detector(args, spark).redact(_input(args, spark)).select("masked", F.transform("mask_map", lambda e: e).alias("m")).first()
    _put(row["masked"], args.out)
    if args.map:
        rename = {"start_pos": "start", "end_pos": "end"}
        files.save_map([{rename.get(k, k): v for k, v in e.asDict().items()} for e in row["m"]], args.map, args.input)
    if not args.quiet:
        counts = Counter(e["label"] for e in row["m"])
        print("".join(f"{label} {n}\n" for label, n in counts.most_common()), end="", file=sys.stderr)
    return 0


def restore(args: argparse.Namespace, spark: SparkSession) -> int:
    entries = [(e["placeholder"], e["original"]) for e in files.load_map(args.map)]
    df = spark.createDataFrame([(_text(args.input), entries)], "text string, m array<struct<placeholder string, original string>>")
    _put(df.select(mask.unmasked(F.col("text"), F.col("m")).alias("t")).first()["t"], args.out)
    return 0


def detect(args: argparse.Namespace, spark: SparkSession) -> int:
    spans = [s.asDict() for s in _detector(args, spark).detect(_input(args, spark)).select("spans").first()["spans"]]
    lines = [json.dumps(spans, ensure_ascii=False)] if args.json else ["\t".join(str(v) for v in s.values()) for s in spans]
    _put("".join(f"{x}\n" for x in lines), "-")
    return 0


def evaluate(args: argparse.Namespace, spark: SparkSession) -> int:
    gold = files.read_documents(spark, f"{args.data}/test.jsonl")
    negatives = files.read_documents(spark, f"{args.data}/negatives.jsonl")
    if args.limit:
        place = F.monotonically_increasing_id()  # the order of the files
        gold, negatives = (df.withColumn("_place", place).orderBy("_place").limit(args.limit).drop("_place") for df in (gold, negatives))
    detector = _detector(args, spark)
    name = F.lit("engine").alias("run_name")
    found = [detector.detect(df.drop("spans")).select(name, "doc_id", F.col("spans")) for df in (gold, negatives)]
    predicted = found[0].unionByName(found[1]).persist()
    rates = match.detection_rates(gold, predicted, args.match)
    fixed = match.recall_at_fixed_fpr(predicted, gold, negatives, args.target_fpr, mode=args.match)
    for df in (rates, match.fp_report(negatives, predicted), fixed):
        for row in df.toJSON().collect():  # a row per label or run
            print(row)
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="hakumei", description="Detection and reversible masking of personal data. Misses have to be expected.")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, run in (("redact", redact), ("restore", restore), ("detect", detect), ("eval", evaluate)):
        sub = commands.add_parser(name)
        sub.set_defaults(run=run)
        if name != "eval":
            sub.add_argument("input", help="a file, - for standard input")
            sub.add_argument("--out", default="-")
        if name in ("redact", "restore"):
            sub.add_argument("--map", default="", required=name == "restore")
        if name != "restore":
            sub.add_argument("--threshold", type=float, default=0.5)
            sub.add_argument("--no-rules", action="store_true")
            sub.add_argument("--model", default="", help="a table of precomputed spans: doc_id, spans")
            sub.add_argument("--no-model", action="store_true")
            sub.add_argument("--calibrator", default="", help="a fitted calibrator for the model's scores")
            sub.add_argument("--no-calibration", action="store_true")
        if name == "redact":
            sub.add_argument("-q", "--quiet", action="store_true", help="no counts of what was masked")
        if name == "detect":
            sub.add_argument("--json", action="store_true")
        if name == "eval":
            sub.add_argument("--data", default="data/dataset")
            sub.add_argument("--limit", type=int, default=0, help="documents of each table, 0 for all")
            sub.add_argument("--match", choices=match.MODES, default="partial")
            sub.add_argument("--target-fpr", type=float, default=0.05)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("hakumei").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return args.run(args, spark)


if __name__ == "__main__":
    raise SystemExit(main())
