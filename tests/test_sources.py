import inspect
import json
import os
import stat

from pyspark.sql import functions as F

from hakumei import __main__ as cli
from hakumei.functions import spans as S
from hakumei.operators import mask, synth
from hakumei.operators.calibrate import Calibrator
from hakumei.sources import files
from hakumei.streaming import detect


def test_documents_round_trip(spark, tmp_path):
    docs = synth.documents(spark, 20, 1).withColumn("meta", F.create_map(F.lit("_private"), F.lit("x"), F.lit("kept"), F.lit("y")))
    files.write_documents(docs, str(tmp_path / "d"))
    back = files.read_documents(spark, str(tmp_path / "d"))
    assert {r["doc_id"]: (r["text"], r["spans"]) for r in docs.collect()} == {r["doc_id"]: (r["text"], r["spans"]) for r in back.collect()}
    assert back.select("meta").first()["meta"] == {"kept": "y"}


def test_defaults_and_blank_lines(spark, tmp_path):
    path = tmp_path / "d.jsonl"
    path.write_text('{"doc_id": "a", "text": "森", "spans": [{"start": 0, "end": 1, "label": "NAME"}]}\n\n{"doc_id": "b"}\n')
    rows = {r["doc_id"]: r for r in files.read_documents(spark, str(path)).collect()}
    assert rows["a"]["spans"][0]["score"] == 1.0 and rows["a"]["spans"][0]["source"] == "model" and rows["a"]["subset"] == "train"
    assert rows["b"]["spans"] == [] and rows["b"]["text"] == ""


def test_invalid_documents_are_told(spark):
    rows = [("ok", "森林", [(0, 1, "NAME", "森", 1.0, "gold")]), ("bounds", "森", [(0, 2, "NAME", "", 1.0, "gold")]),
            ("text", "森", [(0, 1, "NAME", "林", 1.0, "gold")]), ("overlap", "森林泉", [(0, 2, "NAME", "", 1.0, "gold"), (1, 3, "NAME", "", 1.0, "gold")])]
    df = spark.createDataFrame(rows, f"i string, t string, s array<{S.SPAN}>")
    got = {r[0]: r[1] for r in df.select("i", files.broken_spans(F.col("t"), F.col("s"))).collect()}
    assert got == {"ok": None, "bounds": "bounds", "text": "text", "overlap": "overlap"}


def test_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    items = spark.createDataFrame([("一", "a:1:0"), ("一", "a:1:0"), ("", "a:2:0"), ("二", None), ("三", "a:3:0")], "text string, item_id string")
    assert files.append_cache(items, path) == 2
    assert files.append_cache(items.unionByName(spark.createDataFrame([("四", "a:4:0")], items.schema)), path) == 1
    with open(os.path.join(path, "broken.json"), "w") as out:
        out.write("{broken\n")
    assert sorted(r["item_id"] for r in files.read_cache(spark, path).collect()) == ["a:1:0", "a:3:0", "a:4:0"]


def test_private_files(spark, tmp_path):
    path = str(tmp_path / "m.json")
    open(path, "w").close()
    os.chmod(path, 0o644)
    files.save_map([{"placeholder": "<NAME_1>", "original": "森"}], path)
    assert stat.S_IMODE(os.stat(path).st_mode) == 0o600 and files.load_map(path)[0]["original"] == "森"
    docs = mask.with_mask(synth.documents(spark, 3, 1), "text", "spans")
    files.write_mapping(mask.mapping_rows(docs, "doc_id"), str(tmp_path / "map"))
    assert stat.S_IMODE(os.stat(tmp_path / "map").st_mode) == 0o700
    files.save_calibrator(Calibrator(temperature=2.0), str(tmp_path / "c.json"))
    assert files.load_calibrator(str(tmp_path / "c.json")).temperature == 2.0


def test_command_line(spark, tmp_path, capsys):
    text = "連絡先 090-1234-5678 と taro@example.jp\r\n型番 TX-2024-0355\n"
    (tmp_path / "in.txt").write_bytes(text.replace("\r\n", "\n").encode())
    at = lambda n: str(tmp_path / n)
    assert cli.main(["redact", at("in.txt"), "--out", at("masked.txt"), "--map", at("map.json")]) == 0
    assert "090" not in (tmp_path / "masked.txt").read_text() and stat.S_IMODE(os.stat(at("map.json")).st_mode) == 0o600
    assert cli.main(["restore", at("masked.txt"), "--map", at("map.json"), "--out", at("back.txt")]) == 0
    assert (tmp_path / "back.txt").read_bytes() == (tmp_path / "in.txt").read_bytes()
    assert cli.main(["detect", at("in.txt"), "--json"]) == 0
    assert {s["label"] for s in json.loads(capsys.readouterr().out)} == {"PHONE", "EMAIL"}


def test_lateness_of_counts_is_chosen_by_the_caller():
    late = inspect.signature(detect.span_counts).parameters["late"]
    assert late.default is inspect.Parameter.empty and late.kind is inspect.Parameter.KEYWORD_ONLY


def test_stream_equals_batch(spark, tmp_path):
    docs = synth.documents(spark, 40, 5).select("doc_id", "text")
    docs.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = detect.read_stream(spark, str(tmp_path / "in"), "doc_id string, text string", files_per_batch=2)
    at = lambda n: str(tmp_path / n)
    detect.redact_stream(stream, "doc_id", "text", at("out"), at("map"), at("bad"), at("check")).awaitTermination()
    got = {r["doc_id"]: r["masked"] for r in spark.read.parquet(at("out")).collect()}
    blocked = {r["doc_id"] for r in spark.read.parquet(at("bad")).collect()}
    batch = {r["doc_id"]: r["masked"] for r in detect.Detector().redact(docs).collect()}
    assert got == {k: v for k, v in batch.items() if k not in blocked} and len(got) + len(blocked) == 40
    assert spark.read.parquet(at("map")).count() > 0


def test_published_names_and_rows(spark):
    from hakumei.sources import publish

    names = {"map.json": True, "map_2024.json": True, "tokenizer_config.json": False, "token": True, "token.txt": False, "my_SECRET.txt": True, "model.onnx": False, "README.md": False}
    rows = spark.createDataFrame([*((n,) for n in names), (None,)], "n string").select(publish.sensitive(F.col("n")).alias("x")).collect()
    assert [r["x"] for r in rows] == [*names.values(), True]
    docs = synth.documents(spark, 3, 1).withColumn("meta", F.create_map(F.lit("_index"), F.lit("x"), F.lit("kept"), F.lit("y")))
    flat = publish.flat_rows(docs).collect()
    assert all(json.loads(r["meta"]) == {"kept": "y"} for r in flat)
    assert all(list(json.loads(r["spans"])[0]) == ["start", "end", "label", "text", "score", "source"] for r in flat if r["spans"] != "[]")
