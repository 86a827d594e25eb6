import re
import unicodedata

import pytest
from oracle import SF_DIR
from pyspark.sql import functions as F

from hakumei.functions import text as X
from hakumei.functions import vocab
from hakumei.operators import corpus, rules

FOUND = [
    ("お電話 03-1234-5678 まで", "PHONE", 4, 16), ("IP電話 050-1234-5678", "PHONE", 5, 18), ("TEL (03)1234-5678", "PHONE", 5, 17),
    ("ご住所 〒160-0023 東京都", "POSTAL_CODE", 5, 13), ("引落口座 0001-234-5678901 を登録", "BANK_ACCOUNT", 5, 21),
    ("普通 1234567 名義人", "BANK_ACCOUNT", 0, 10), ("カード番号 4111 1111 1111 1112", "CREDIT_CARD", 6, 25),
    ("個人番号 123456789013", "MYNUMBER", 5, 17), ("会員番号 EMP32301241 の照会", "MEMBER_ID", 5, 16),
    ("連絡先: a_b-c@example.test に送付。", "EMAIL", 5, 23),
]
NOTHING = [
    "型番 TX-2024-0355", "注文番号 0120-8834-221", "整理番号 0800-123-4567", "2024-01-15", "追跡番号 1234-5678-9012", "図面番号 123-4567",
    "+81 90-1234-5678", "+81 090-1234-5678", "森と林と大和", "", None,
]


def spans(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    return {r["id"]: r["rule_spans"] for r in rules.with_rule_spans(df, "text").collect()}


def test_cases(spark):
    got = spans(spark, [t for t, *_ in FOUND])
    for i, (_, *expected) in enumerate(FOUND):
        assert [[s["label"], s["start_pos"], s["end_pos"]] for s in got[i]] == [expected]
    assert got[0][0]["score"] == 0.8 + 0.15
    assert got[6][0]["checksum_valid"] is False and got[7][0]["checksum_valid"] is False


def test_own_rules_search_every_text(spark):
    own = [
        rules.Rule("member.word", "MEMBER_ID", r"会員[甲乙丙]{2,4}"),
        rules.Rule("email.handle", "EMAIL", r"[a-z]{3,9}(?:@[a-z]{2,9})?\.test"),
    ]
    texts = ["担当は会員甲乙です", "宛先 abc.test まで", "宛先 abc@de.test まで", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    expected = [[("MEMBER_ID", 3, 7)], [("EMAIL", 3, 11)], [("EMAIL", 3, 14)], [], []]
    for chosen in (own, [*own, *rules.DEFAULT_RULES]):
        got = {r["id"]: r["rule_spans"] for r in rules.with_rule_spans(df, "text", rules=chosen).collect()}
        assert [[(s["label"], s["start_pos"], s["end_pos"]) for s in got[i]] for i in range(5)] == expected


def test_nothing(spark):
    assert all(s == [] for s in spans(spark, NOTHING).values())


@pytest.mark.parametrize("number, ok", [
    ("03-1234-5678", True), ("090-1234-5678", True), ("0463-12-3456", True), ("0120-123-456", True), ("0800-123-4567", True),
    ("050-1234-5678", True), ("0312345678", True), ("03-1234", False), ("1234-5678", False), ("2024-01-15", False),
    ("090-1234-567", False), ("0120-8834-221", False), ("12345678901", False), ("0999-9999-9999", False), (None, False),
])
def test_phone(spark, number, ok):
    df = spark.createDataFrame([(number,)], "n string")
    assert df.select(X.jp_phone_ok(F.col("n"))).first()[0] is ok


def test_checksums(spark):
    cards = {"4111111111111111": True, "5500000000000004": True, "4111 1111 1111 1111": True, "4111111111111112": False, "0": False, "": False}
    df = spark.createDataFrame([(c,) for c in cards], "n string")
    assert {r[0]: r[1] for r in df.select("n", X.luhn_ok(F.col("n"))).collect()} == cards
    bodies = spark.range(10).select(F.concat(F.lit("12345678901"), F.col("id").cast("string")).alias("n"))
    assert sum(r[0] for r in bodies.select(X.mynumber_ok(F.col("n")).cast("int")).collect()) == 1


def test_all_candidates_against_plain_python(spark):
    """Every rule on every document, by Python's regular expressions: normalisation, offsets, context and scores."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").where("text is not null")
    rows = rules.with_candidates(docs.withColumn("text", X.normalize(F.col("text"))), "text").collect()
    raw = {r["doc_id"]: r["text"] for r in docs.collect()}
    for row in rows:
        text = corpus.normalize_python(raw[row["doc_id"]])
        assert row["text"] == text
        expected = set()
        for rule in rules.selected():
            for m in re.finditer(rule.pattern, text):
                s, e = m.span()
                digits = "".join(c for c in m[0] if c.isdigit())
                mobile = digits[:3] in ("070", "080", "090", "050") or digits[:4] == "0800"
                if rule.validator and (digits[:1] != "0" or len(digits) != (11 if mobile else 10)):
                    continue
                around = text[max(0, s - 12) : e + 12]
                word = next((w for w in rule.context if w in around), None)
                if any(w in text[max(0, s - 12) : s] for w in rule.negative_context) or (rule.require_context and word is None):
                    continue
                expected.add((rule.rule_id, s, e, m[0], min(0.99, rule.confidence + (0.15 if word else 0.0)), word))
        got = {(c["rule_id"], c["start_pos"], c["end_pos"], c["text"], c["score"], c["matched_context"]) for c in row["candidates"]}
        assert got == expected


def test_normalise(spark):
    texts = ["ＡＢ－１２", "ｶﾞｷﾞ", "a\r\nb\rc", "・ー", "①㈱", "é", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(X.normalize(F.col("t"))).collect()]
    assert got == [None if t is None else corpus.normalize_python(t) for t in texts]
    assert got[0] == "AB-12" and got[3] == "・ー" and unicodedata.is_normalized("NFKC", got[1])


def test_rules_survive_export():
    assert rules.import_rules(rules.export_rules()) == list(rules.DEFAULT_RULES)
    assert {r.label for r in rules.selected()} == set(vocab.RULE_DETERMINISTIC)


def test_greedy_keeps_what_a_blocked_span_would_block(spark):
    def kept(rows):
        schema = f"array<{rules.CANDIDATE}>"
        full = [(a, b, "X", "", 0.5, "rule", n, None, p, None, True) for n, a, b, p in rows]
        df = spark.createDataFrame([(full,)], f"c {schema.replace('array<', 'array<', 1)}")
        return [s["rule_id"] for s in df.select(rules.resolved(F.col("c")).alias("r")).first()["r"]]

    assert kept([("A", 0, 5, 10), ("B", 3, 8, 20), ("C", 8, 9, 1)]) == ["B", "C"]
    assert kept([("A", 0, 4, 30), ("B", 3, 7, 20), ("C", 6, 9, 10)]) == ["A", "C"]
