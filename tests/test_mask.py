import pytest
from pyspark.sql import functions as F

from hakumei.functions import spans as S
from hakumei.operators import egress, mask, synth
from hakumei.plans.detector import Detector, PrecomputedSpans

TEXT = "田中太郎と鈴木、田中太郎。電話090-1234-5678、FAX090-1234-5678"
NAMES = [(0, 4, "NAME"), (5, 7, "NAME"), (8, 12, "NAME"), (15, 28, "PHONE"), (32, 45, "PHONE")]


def frame(spark, text, spans):
    rows = None if spans is None else [(a, b, label, "" if text is None else text[a:b], 1.0, "gold") for a, b, label in spans]
    return spark.createDataFrame([("d", text, rows)], f"doc_id string, text string, spans array<{S.SPAN}>")


def test_numbers_follow_first_appearance(spark):
    row = mask.with_mask(frame(spark, TEXT, NAMES), "text", "spans").first()
    assert row["masked"] == "<NAME_1>と<NAME_2>、<NAME_1>。電話<PHONE_1>、FAX<PHONE_1>"
    assert [e["placeholder"] for e in row["mask_map"]] == ["<NAME_1>", "<NAME_2>", "<NAME_1>", "<PHONE_1>", "<PHONE_1>"]


@pytest.mark.parametrize("style, shape", [("angle", "<NAME_1>"), ("square", "[NAME_1]"), ("brace", "{{NAME_1}}")])
def test_styles(spark, style, shape):
    df = mask.with_mask(frame(spark, TEXT, NAMES), "text", "spans", style=style)
    row = df.select("masked", mask.unmasked(F.col("masked"), F.col("mask_map")).alias("back")).first()
    assert row["masked"].startswith(shape) and row["back"] == TEXT


def test_null_empty_and_width(spark):
    for text, spans in ((None, None), ("", []), ("なし", None)):
        row = mask.with_mask(frame(spark, text, spans), "text", "spans").first()
        assert row["masked"] == text and row["mask_map"] == []
    row = mask.with_mask(frame(spark, "ＡＢと AB", [(0, 2, "NAME"), (4, 6, "NAME")]), "text", "spans").first()
    assert row["masked"] == "<NAME_1>と <NAME_1>"


def test_unmask_unknown_reordered_and_long_numbers(spark):
    entries = [(f"<NAME_{i}>", f"人{i}") for i in range(1, 12)]
    df = spark.createDataFrame([("<NAME_11>と<NAME_1>と<FOO_9>\x01<NAME_1>", entries)], "t string, m array<struct<placeholder string, original string>>")
    assert df.select(mask.unmasked(F.col("t"), F.col("m"))).first()[0] == "人11と人1と<FOO_9>\x01人1"


def test_collisions(spark):
    df = mask.with_mask(frame(spark, "<NAME_1> 森", [(9, 10, "NAME")]), "text", "spans")
    assert df.select(mask.collisions(F.col("text"), F.col("mask_map"))).first()[0] == ["<NAME_1>"]


def test_round_trip_of_generated_documents(spark):
    docs = synth.documents(spark, 60, 1234)
    rows = mask.with_mask(docs, "text", "spans")
    bad = rows.where(mask.unmasked(F.col("masked"), F.col("mask_map")) != F.col("text"))
    leaks = rows.where(F.exists(mask.originals(F.col("mask_map")), lambda o: (F.length(o) > 4) & F.contains("masked", o)))
    assert bad.count() == 0 and leaks.count() == 0


@pytest.mark.parametrize("payload, form", [
    ("田中太郎さんへ", "raw"), ("０９０-１２３４-５６７８", "nfkc"), ("09012345678", "digits"), ("tanaka@example.com", "raw"),
    ("<NAME_1> 様 <PHONE_1>", None), ("あ", None), ("", None), (None, None),
])
def test_guard(spark, payload, form):
    df = spark.createDataFrame([(payload, ["田中太郎", "090-1234-5678", "tanaka@example.com", "あ"])], "p string, f array<string>")
    hit = egress.with_violation(df, "p", "f").first()["violation"]
    assert (hit and hit["form"]) == form
    assert not hit or "中太" not in hit["preview"]


def test_strict_names_no_value(spark):
    df = spark.createDataFrame([("田中太郎です", ["田中太郎"])], "p string, f array<string>")
    with pytest.raises(Exception) as failure:
        egress.strict(df, "p", "f").collect()
    assert "田●●郎" in str(failure.value) and "田中太郎" not in str(failure.value)


def test_blocked_payload_is_not_sent(spark):
    rows = egress.round_trip(frame(spark, "田中太郎です", [(0, 4, "NAME")]), "text", "spans", egress.EchoTransport, "田中太郎について")
    assert [rows.first()[c] for c in ("blocked", "response_masked", "response")] == [True, None, None]
    fine = egress.round_trip(frame(spark, "田中太郎です", [(0, 4, "NAME")]), "text", "spans", egress.EchoTransport, "要約").first()
    assert fine["response_masked"] == "要約\n\n<NAME_1>です" and fine["response"] == "要約\n\n田中太郎です"
    df = spark.createDataFrame([("田中太郎です", ["田中太郎"]), ("はい", ["田中太郎"])], "p string, f array<string>")
    assert egress.send_all(df, "p", "f", egress.RecordingTransport) == 1


def test_detector(spark):
    df = spark.createDataFrame([("a", "メールはａｂｃ@example.jp、担当は田中太郎"), ("b", None)], "doc_id string, text string")
    found = {r["doc_id"]: r["spans"] for r in Detector().detect(df).collect()}
    assert [s["text"] for s in found["a"]] == ["abc@example.jp"] and found["b"] == []
    model = spark.createDataFrame([("a", [(23, 27, "NAME", "田中太郎", 0.9, "model"), (4, 9, "NAME", "x", 0.99, "model")])], f"doc_id string, spans array<{S.SPAN}>")
    both = Detector(model=PrecomputedSpans(model)).detect(df).where("doc_id = 'a'").first()["spans"]
    assert [(s["label"], s["origin"]) for s in both] == [("EMAIL", "rule"), ("NAME", "model")]
    with pytest.raises(ValueError):
        Detector(use_rules=False)
    with pytest.raises(ValueError):
        Detector(threshold=2)


def test_long_placeholders_are_restored(spark):
    name = "<" + "A" * 60 + "_12345678901>"
    row = spark.createDataFrame([(f"x{name}y<A_1>{{{{B_2}}}}", [(name, "甲"), ("{{B_2}}", "乙")])], "t string, m array<struct<placeholder string, original string>>")
    assert row.select(mask.unmasked(F.col("t"), F.col("m"))).first()[0] == "x甲y<A_1>乙"
