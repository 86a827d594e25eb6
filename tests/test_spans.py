import itertools
import random

import pytest
from pyspark.sql import functions as F

from hakumei.functions import spans as S
from hakumei.functions import vocab
from hakumei.operators import compare, decode


def one(spark, column, **lists):
    """Value of a column expression over one row of span lists."""
    schema = ", ".join(f"{k} string" if isinstance(v, str) else f"{k} array<{S.SPAN}>" for k, v in lists.items())
    df = spark.createDataFrame([tuple(lists.values())], schema)
    return df.select(column.alias("x")).first()["x"]


def span(a, b, label="NAME", score=1.0, source="model", text=""):
    return (a, b, label, text, score, source)


def keys(found):
    return [(s["start_pos"], s["end_pos"], s["label"]) for s in found]


def naive_greedy(spans):
    kept = []
    for s in sorted(spans, key=lambda s: (-s[4], -(s[1] - s[0]), s[0])):
        if all(not (s[0] < k[1] and k[0] < s[1]) for k in kept):
            kept.append(s)
    return sorted((s[0], s[1], s[2]) for s in kept)


def test_greedy_against_plain_python(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(60):
        starts = [rng.randrange(30) for _ in range(rng.randrange(9))]
        rows.append([span(a, a + rng.randrange(1, 8), rng.choice("AB"), rng.choice([0.2, 0.5, 0.9])) for a in starts])
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, s array<{S.SPAN}>")
    for r in df.select("i", S.resolve_by_score(F.col("s")).alias("x")).collect():
        assert sorted(keys(r["x"])) == naive_greedy(rows[r["i"]])


def test_null_and_broken_spans(spark):
    df = spark.createDataFrame([(None,), ([],), ([None, span(3, 3), span(-1, 2), span(0, 1)],)], f"s array<{S.SPAN}>")
    assert [len(r[0]) for r in df.select(S.present(F.col("s"))).collect()] == [0, 0, 1]


def test_merge_precedence(spark):
    out = S.merged(F.col("m"), F.col("r"), vocab.RULE_DETERMINISTIC)
    found = one(spark, out, m=[span(5, 15, "MEMBER_ID", 0.99)], r=[span(5, 18, "PHONE", 0.8, "rule")])
    assert keys(found) == [(5, 18, "PHONE")] and found[0]["origin"] == "rule" and found[0]["source"] == "merged"
    assert keys(one(spark, out, m=[span(0, 4, score=0.9), span(0, 2, score=0.4)], r=[])) == [(0, 4, "NAME")]
    low = S.merged(F.col("m"), F.col("r"), vocab.RULE_DETERMINISTIC, 0.9)
    assert keys(one(spark, low, m=[span(0, 4, score=0.5)], r=[span(6, 9, "PHONE", 0.1, "rule")])) == [(6, 9, "PHONE")]


def test_windows_unite_only_neighbours(spark):
    text = "x" * 20
    out = S.merged_windows(F.col("s"), F.col("t"))
    found = one(spark, out, s=[span(0, 5, score=0.9), span(3, 8, score=0.6)], t=text)
    assert keys(found) == [(0, 8, "NAME")] and found[0]["score"] == 0.6
    split = one(spark, out, s=[span(0, 5), span(2, 3, "PHONE", 0.1), span(4, 8, score=0.5)], t=text)
    assert keys(split) == [(0, 5, "NAME")]


def test_dedupe(spark):
    found = one(spark, S.dedupe_max_score(F.col("s")), s=[span(0, 2, score=0.1), span(0, 2, "PHONE", 0.7), span(1, 2)])
    assert keys(found) == [(0, 2, "PHONE"), (1, 2, "NAME")]


@pytest.mark.parametrize("text, label, kept", [
    ("田中太郎様", "NAME", "田中太郎"), ("森さん", "NAME", "森"), ("「加藤」", "NAME", "加藤"), ("小林先生の", "NAME", "小林"),
    ("さん", "NAME", "さん"), ("マリー", "NAME", "マリー"), ("東京2-8-1に", "ADDRESS", "東京2-8-1"), ("090に", "PHONE", "090に"), ("、、", "NAME", "、、"),
])
def test_refine(spark, text, label, kept):
    found = one(spark, decode.refined(F.col("s"), F.col("t")), s=[span(0, len(text), label, text=text)], t=text)
    assert [x["text"] for x in found] == [kept]
    assert text[found[0]["start_pos"] : found[0]["end_pos"]] == kept


def tokens(spark, text, rows, threshold):
    """rows: (start, end, {tag: probability})"""
    full = [(a, b, [p.get(tag, 0.0) for tag in decode.BIO_LABELS]) for a, b, p in rows]
    df = spark.createDataFrame([(text, full)], "t string, k array<struct<start_pos int, end_pos int, probs array<double>>>")
    return df.select(decode.decode_bio(F.col("k"), F.col("t"), threshold).alias("x")).first()["x"]


def test_decode(spark):
    rows = [(0, 0, {"O": 1.0}), (0, 2, {"I-NAME": 0.9, "O": 0.1}), (2, 4, {"I-NAME": 0.6, "O": 0.4}), (4, 6, {"O": 1.0}), (0, 0, {"O": 1.0})]
    found = tokens(spark, "田中太郎です", rows, 0.05)
    assert keys(found) == [(0, 4, "NAME")] and found[0]["score"] == 0.6
    assert tokens(spark, "田中太郎です", rows, 0.7) == []
    split = tokens(spark, "田中 太郎", [(0, 2, {"B-NAME": 0.9}), (2, 3, {"O": 1.0}), (3, 5, {"B-NAME": 0.8})], 0.05)
    assert keys(split) == [(0, 2, "NAME"), (3, 5, "NAME")]
    bridged = tokens(spark, "東京 都庁 ", [(0, 2, {"B-ADDRESS": 0.9}), (2, 3, {"O": 1.0}), (3, 6, {"I-ADDRESS": 0.8})], 0.05)
    assert keys(bridged) == [(0, 5, "ADDRESS")]


def test_windows_cover_all_tokens(spark):
    for n, size, stride in itertools.product((0, 1, 6, 7, 20), (4, 8), (None, 1, 99)):
        df = spark.createDataFrame([([str(i) for i in range(n)],)], "t array<string>")
        windows = df.select(decode.token_windows(F.col("t"), size, stride).alias("w")).first()["w"]
        assert [t for w in windows for t in w["tokens"]][:1] == (["0"] if n else [])
        assert {t for w in windows for t in w["tokens"]} == {str(i) for i in range(n)}
        assert all(len(w["tokens"]) <= size - 2 for w in windows)


def test_answers():
    text = "田中さんと田中さん、電話03-1"
    answer = '<think>…</think>```json\n[{"type":"氏名","text":"田中"},{"種別":"氏名","値":"田中"},{"type":"電話番号","text":"03-1"},{"type":"氏名","text":"鈴木"}]\n```'
    assert [(s["start_pos"], s["label"]) for s in compare.aligned_answer(answer, text)] == [(0, "NAME"), (5, "NAME"), (12, "PHONE")]
    assert compare.aligned_answer('broken "type": "氏名", "text": "田中" ]', text)[0]["end_pos"] == 2
    assert compare.aligned_answer(None, None) == []


def test_addresses(spark):
    text = "東京都 新宿区2-8-1へ"
    df = spark.createDataFrame([(text, [(4, 7, "City"), (0, 3, "Province"), (12, 13, "Person")])], "t string, e array<struct<start_pos int, end_pos int, label string>>")
    found = df.select(compare.joined_addresses(F.col("e"), F.col("t")).alias("x")).first()["x"]
    assert keys(found) == [(0, 12, "Address"), (12, 13, "Person")]
