import math
import random

import pytest
from pyspark.sql import functions as F

from hakumei.functions import spans as S
from hakumei.operators import align, calibrate, compare, corpus, invent, match, negatives, synth

DOCS = f"doc_id string, text string, spans array<{S.SPAN}>, negative_kinds array<string>"
PRED = "run_name string, doc_id string, start_pos int, end_pos int, label string, text string, score double, source string"


def docs(spark, rows):
    return spark.createDataFrame([(i, "x" * n, [(a, b, label, "", 1.0, "gold") for a, b, label in s], []) for i, n, s in rows], DOCS)


def pred(spark, rows):
    return match.spans_by_document(spark.createDataFrame([("r", d, a, b, label, "", s, "model") for d, a, b, label, s in rows], PRED))


def test_one_gold_one_prediction(spark):
    gold = docs(spark, [("a", 10, [(0, 4, "NAME")])])
    both = pred(spark, [("a", 0, 5, "NAME", 0.5), ("a", 1, 4, "NAME", 0.9)])
    rates = {r["label"]: r for r in match.detection_rates(gold, both).collect()}
    assert (rates["NAME"]["tp"], rates["NAME"]["fp"], rates["NAME"]["fn"]) == (1, 1, 0)
    exact = {r["label"]: r for r in match.detection_rates(gold, both, "exact").collect()}
    assert (exact["micro"]["tp"], exact["micro"]["fp"], exact["micro"]["fn"]) == (0, 2, 1)


def test_matching_against_plain_python(spark):
    rng = random.Random(5)
    some = lambda: sorted({(a, a + rng.randrange(1, 7), rng.choice("AB")) for a in (rng.randrange(20) for _ in range(5))})
    gold = {str(i): some() for i in range(40)}
    found = {str(i): [(*s, rng.choice([0.1, 0.5, 0.9])) for s in some()] for i in range(40)}
    rows = match.outcomes(
        docs(spark, [(i, 40, s) for i, s in gold.items()]), pred(spark, [(i, *s) for i, spans in found.items() for s in spans])
    ).where("outcome = 'tp'").groupBy("doc_id").count()
    got = {r["doc_id"]: r["count"] for r in rows.collect()}
    for i in gold:
        pairs = []
        order = sorted(found[i])
        for gi, g in enumerate(sorted(gold[i], key=lambda s: s[:2])):
            for pi, p in enumerate(order):
                both = min(g[1], p[1]) - max(g[0], p[0])
                if g[2] == p[2] and both > 0:
                    pairs.append((-both / (g[1] - g[0] + p[1] - p[0] - both), -p[3], g[0], p[0], gi, pi))
        gs, ps = set(), set()
        for *_, gi, pi in sorted(pairs):
            if gi not in gs and pi not in ps:
                gs.add(gi)
                ps.add(pi)
        assert got.get(i, 0) == len(gs)


def test_three_rates(spark):
    neg = docs(spark, [(c, 100, []) for c in "abcd"])
    report = match.fp_report(neg, pred(spark, [("a", 0, 1, "NAME", 0.5), ("a", 2, 3, "NAME", 0.5), ("c", 0, 1, "NAME", 0.5)])).first()
    assert (report["fp_per_doc"], report["doc_level_fp_rate"], report["fp_per_1000_chars"]) == (0.75, 0.5, 7.5)


def test_fixed_rate(spark):
    pos = docs(spark, [("p", 20, [(0, 4, "NAME"), (6, 8, "NAME")])])
    neg = docs(spark, [(f"n{i}", 10, []) for i in range(5)])
    scored = pred(spark, [("p", 0, 4, "NAME", 0.95), ("p", 6, 8, "NAME", 0.30), *((f"n{i}", 0, 2, "NAME", 0.4) for i in range(5))])
    row = match.recall_at_fixed_fpr(scored, pos, neg, 0.0).first()
    assert row["recall"] == 0.5 and row["threshold"] > 0.4 and row["degenerate"] is None
    recalls = [match.recall_at_fixed_fpr(scored, pos, neg, t).first()["recall"] for t in (0.0, 0.5, 1.0)]
    assert recalls == sorted(recalls) and recalls[-1] == 1.0
    assert match.recall_at_fixed_fpr(scored, pos, neg.where("false")).first()["degenerate"] == "no_negatives"
    only = pred(spark, [("n0", 0, 2, "NAME", 0.9)])
    assert match.recall_at_fixed_fpr(only, pos, neg, 0.1).first()["degenerate"] == "only_empty_predictions_meet_target"


def test_calibration(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(3000):
        z = rng.gauss(0, 1.2)
        rows.append((1 / (1 + math.exp(-2.2 * z)), int(rng.random() < 1 / (1 + math.exp(-z))), "r"))
    pairs = spark.createDataFrame(rows, "score double, label int, r string").cache()
    before = calibrate.calibration_errors(pairs, ["r"]).first()
    for fitted in (calibrate.fit_temperature(pairs), calibrate.fit_isotonic(pairs)):
        again = calibrate.Calibrator.from_json(fitted.to_json())
        after = calibrate.calibration_errors(pairs.withColumn("score", again.column(F.col("score"))), ["r"]).first()
        assert after["ece"] < before["ece"] / 2 and after["nll"] < before["nll"]
    assert 1.8 < calibrate.fit_temperature(pairs).temperature < 2.6
    with pytest.raises(ValueError):
        calibrate.fit_temperature(pairs.where("false"))
    with pytest.raises(RuntimeError):
        calibrate.Calibrator().column(F.lit(0.5))
    s = spark.range(1).select(calibrate.tempered(F.lit(0.0), 2.0), calibrate.tempered(F.lit(1.0), 2.0), calibrate.interpolated(F.lit(0.3), [0.5], [0.7])).first()
    assert 0 <= s[0] < 0.01 and 0.99 < s[1] <= 1 and s[2] == 0.7


def test_reweight(spark):
    kinds = ("phone_like_id", "common_noun_surname", "place_as_person", "honorific_boundary", "number_like_id", "company_as_person", "address_like_facility", "date_like_nondob")
    weights = spark.createDataFrame([(k, 1 / 8) for k in kinds], "kind string, weight double")
    counts = spark.createDataFrame(list(zip(kinds, (40, 25, 10, 3, 2))), "kind string, n long")
    new = {r["kind"]: r["weight"] for r in negatives.reweighted(weights, counts, 2.0).collect()}
    assert new["phone_like_id"] > 1 / 8 > new["date_like_nondob"] and abs(sum(new.values()) - 1) < 1e-9
    assert all(0.25 / 8 <= w <= 4 / 8 for w in new.values())


def test_generated_documents(spark):
    rows = synth.documents(spark, 200, 2024).collect()
    labels = set()
    for r in rows:
        end = 0
        for s in r["spans"]:
            assert r["text"][s["start_pos"] : s["end_pos"]] == s["text"] and s["start_pos"] >= end
            end = s["end_pos"]
            labels.add(s["label"])
        assert corpus.normalize_python(r["text"]) == r["text"]
    assert labels == set(match.vocab.LABELS)
    assert rows == synth.documents(spark, 200, 2024).collect()
    mails = [s["text"] for r in rows for s in r["spans"] if s["label"] == "EMAIL"]
    assert all(m.split("@")[1] in invent.DOMAINS for m in mails)
    assert invent.romaji_text("キョウト") == "kyouto" and invent.romaji_text("ハットリ") == "hattori" and invent.romaji_text("コーノ") == "koono"


def test_generated_numbers_are_unusable(spark):
    spans = synth.documents(spark, 300, 9).select(F.explode("spans").alias("s"))
    from hakumei.functions import text as X

    bad = F.when(F.col("s.label") == "CREDIT_CARD", X.luhn_ok(F.col("s.text"))).when(F.col("s.label") == "MYNUMBER", X.mynumber_ok(F.col("s.text")))
    assert spans.where(bad).count() == 0


def test_check_digits():
    assert invent.luhn_digit("411111111111111") == 1 and invent.luhn_digit("550000000000000") == 4
    assert invent.mynumber_digit("12345678901") == 8


def test_wanted_numbers_of_values():
    for n in range(0, 12):
        for i in range(20):
            draft = invent.document(random.Random(f"{n}:{i}"), invent.GENRES[i % 4], None, n)
            assert len({t for *_, t in draft.spans}) <= n and (n or not draft.spans)
            assert all(draft.text[a:b] == t for a, b, _, t in draft.spans)
            if n >= 8:
                assert len(draft.spans) >= n


def test_base_texts_are_named_where_they_are_used(spark):
    sentence = "山の麓の村では毎年春になると古い祭りが行われ、多くの人が集まって夜まで歌い続けた。"
    items = spark.createDataFrame([(f"a:{i}:0", sentence * 3, "CC0", "祭りの記録") for i in range(5)] + [("a:9:0", None, "x", "y")], "item_id string, text string, license string, attribution string")
    rows = synth.documents(spark, 120, 3, bases=synth.base_texts(items)).collect()
    used = [r for r in rows if r["source_ref"]]
    assert 40 < len(used) < 110
    for r in rows:
        assert (sentence in r["text"]) == bool(r["source_ref"]) and r["source_license"] == ("CC0" if r["source_ref"] else synth.LICENSE)


def test_negatives_and_injection(spark):
    rows = synth.negative_documents(spark, 50, 3).collect()
    assert all(r["text"] and "{" not in r["text"] and not r["spans"] for r in rows) and any(r["negative_kinds"] for r in rows)
    kinds = synth.documents(spark, 30, 9).withColumn("kinds", F.array().cast("array<string>"))
    out = negatives.injected(kinds, "doc_id", "text", "spans", "kinds", 3).collect()
    for r in out:
        assert len(r["kinds"]) == 3
        assert all(r["text"][s["start_pos"] : s["end_pos"]] == s["text"] for s in r["spans"])


def rates_by_filtering(gold, found, threshold):
    """Micro true and false positives when only spans that reach the threshold are matched."""
    tp = fp = 0
    for i, spans in found.items():
        kept = sorted(s for s in spans if s[3] >= threshold)
        pairs = []
        for gi, g in enumerate(sorted(gold.get(i, []), key=lambda s: s[:2])):
            for pi, p in enumerate(kept):
                both = min(g[1], p[1]) - max(g[0], p[0])
                if g[2] == p[2] and both > 0:
                    pairs.append((-both / (g[1] - g[0] + p[1] - p[0] - both), -p[3], g[0], p[0], gi, pi))
        gs, ps = set(), set()
        for *_, gi, pi in sorted(pairs):
            if gi not in gs and pi not in ps:
                gs.add(gi)
                ps.add(pi)
        tp += len(ps)
        fp += len(kept) - len(ps)
    return tp, fp


def test_curve_against_matching_at_every_threshold(spark):
    rng = random.Random(15)
    some = lambda n: sorted({(a, a + rng.randrange(1, 9), rng.choice("AB")) for a in (rng.randrange(25) for _ in range(n))})
    score = lambda: rng.choice([0.1, 0.2, 0.35, 0.5, 0.5001, 0.9, 1.0])
    gold = {f"p{i}": some(5) for i in range(40)}
    found = {i: [(*s, score()) for s in some(8)] for i in [*gold, *(f"n{i}" for i in range(30))] if rng.random() < 0.9}
    pos = docs(spark, [(i, 40, s) for i, s in gold.items()])
    neg = docs(spark, [(f"n{i}", 40, []) for i in range(30)])
    scored = pred(spark, [(i, *s) for i, spans in found.items() for s in spans])
    n_gold = sum(map(len, gold.values()))
    positive, negative = ({i: s for i, s in found.items() if i.startswith(c)} for c in "pn")
    for metric, size in (("per_doc", 30), ("doc_level", 30), ("per_1000_chars", 1.2)):
        ev = match.evaluation(match.sides(pos, neg), scored)
        result = match.at_fixed_fpr(ev, 0.4, metric)
        curve = {r["threshold"]: r for r in result.curve.collect()}
        assert len(curve) == 8
        for t, r in curve.items():
            events = sum(any(s[3] >= t for s in x) for x in negative.values()) if metric == "doc_level" else rates_by_filtering({}, negative, t)[1]
            assert abs(r["fpr"] - events / size) < 1e-9 and abs(r["recall"] - rates_by_filtering(gold, positive, t)[0] / n_gold) < 1e-9
        best = min(t for t, r in curve.items() if r["fpr"] <= 0.4 + 1e-12)
        row = result.overall.first()
        assert row["threshold"] == best and curve[best]["chosen"] and sum(r["chosen"] for r in curve.values()) == 1
        tp, fp = rates_by_filtering(gold, positive, best)
        micro = result.by_type.where("label = 'micro'").first()
        assert (micro["tp"], micro["fp"], micro["fn"]) == (tp, fp, n_gold - tp) and row["recall"] == micro["recall"]
    few = match.at_fixed_fpr(ev, 0.4, points=3).curve
    assert 3 <= few.count() <= 4
    negative_target = match.at_fixed_fpr(ev, -1.0).overall.first()
    assert negative_target["degenerate"] == "target_unreachable" and not negative_target["achieved"]


def test_kinds_of_false_positives(spark):
    """Written out by hand: every surname that is a word, the patterns in their order, places, single kinds."""
    words = "森 林 泉 大和 青木 石田 原 谷 島 川 本田 東 西 南 北 上田 小島 松 藤 柳 岩 辻 堀 関 高 新井 花田".split()
    cases = [(f"これは{w}です", w, "common_noun_surname", []) for w in words]
    cases += [("これは長野です", "長野", "place_as_person", []), ("長野県の森", "森", "place_as_person", []), ("型番は森です", "森", "phone_like_id", [])]
    cases += [("これは田辺です", "田辺", "number_like_id", ["number_like_id", "number_like_id"]), ("これは田辺です", "田辺", "other", ["a", "b"]), ("これは田辺です", "田辺", "other", None)]
    rows = spark.createDataFrame([(t, t.index(w), t.index(w) + len(w), w, k, kinds) for t, w, k, kinds in cases], "text string, a int, b int, surface string, wanted string, kinds array<string>")
    kind = negatives.kind_of(F.col("surface"), F.col("text"), F.col("a"), F.col("b"), F.col("kinds"))
    assert [r["kind"] for r in rows.select(kind.alias("kind")).collect()] == [c[2] for c in cases]
    index = spark.createDataFrame([("森", "date_like_nondob")], "surface string, kind string")
    found = negatives.classified(rows, F.col("surface"), kind, index).where("surface = '森'").select("kind").distinct().collect()
    assert [r["kind"] for r in found] == ["date_like_nondob"]


def test_eras(spark):
    from hakumei.functions import text as X

    days = {"1868-10-22": None, "1868-10-23": "明治元年10月23日", "1912-07-29": "明治45年7月29日", "1912-07-30": "大正元年7月30日", "1926-12-25": "昭和元年12月25日", "2019-04-30": "平成31年4月30日", "2019-05-01": "令和元年5月1日"}
    rows = spark.createDataFrame([(d,) for d in days], "d string").select(X.wareki(F.to_date("d")).alias("w")).collect()
    assert [r["w"] for r in rows] == list(days.values())


def test_alignment(spark):
    gold = docs(spark, [("b", 5, []), ("", 5, []), ("a", 5, [])]).withColumn("n", F.monotonically_increasing_id())
    found = [[(0, 1, "NAME", "", 1.0, "model")], [], None]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(found)], f"n int, spans array<{S.SPAN}>")
    got = align.aligned_by_position(gold, rows, F.col("n"), F.col("n")).orderBy("position").collect()
    assert [len(r["predicted"]) for r in got] == [1, 0, 0] and [r["position"] for r in got] == [0, 1, 2]
    with pytest.raises(ValueError, match="3 documents, but 2 rows"):
        align.aligned_by_position(gold, rows.where("n < 2"), F.col("n"), F.col("n"))
    by_id = spark.createDataFrame([("#1", found[0]), ("a", found[0]), ("z", found[0])], f"doc_id string, spans array<{S.SPAN}>")
    got = {r["doc_id"]: len(r["predicted"]) for r in align.aligned_by_id(gold, by_id, F.col("n")).collect()}
    assert got == {"b": 0, "#1": 1, "a": 1}


def test_recognised_entities(spark):
    spans = [(0, 2, "NAME", "", 0.5, "model"), (2, 9, "PHONE", "", 0.5, "rule"), (1, 3, "MEMBER_ID", "", 0.7, "rule")]
    row = spark.createDataFrame([("abcdef", spans), (None, None)], f"t string, s array<{S.SPAN}>")
    all_, some = (row.select(compare.recognized(F.col("s"), F.col("t"), e).alias("r")).collect() for e in (None, ("PERSON",)))
    assert [(r["entity_type"], r["start"]) for r in all_[0]["r"]] == [("PERSON", 0), ("JP_MEMBER_ID", 1)] and all_[1]["r"] == []
    assert [r["entity_type"] for r in some[0]["r"]] == ["PERSON"]


def test_highlights(spark):
    ours, theirs = [(0, 2, "NAME", "", 0.5, "model"), (5, 9, "NAME", "", 0.5, "model")], [(1, 3, "NAME", "", 0.5, "model")]
    row = spark.createDataFrame([("ab<d&fgh", ours, theirs), ("x", None, []), (None, ours, None)], f"t string, a array<{S.SPAN}>, b array<{S.SPAN}>")
    got = [r["h"] for r in row.select(compare.highlighted(F.col("t"), F.col("a"), F.col("b")).alias("h")).collect()]
    assert got == ['<mark class="ours">a</mark><mark class="both">b</mark><mark class="theirs">&lt;</mark>d&amp;<mark class="ours">fgh</mark>', "x", None]


def test_softmax(spark):
    row = spark.createDataFrame([([1000.0, 1000.0, 0.0],), ([],), (None,)], "z array<double>").select(calibrate.softmax(F.col("z")).alias("p")).collect()
    assert row[0]["p"] == [0.5, 0.5, 0.0] and row[1]["p"] == [] and row[2]["p"] is None


def test_temperature_is_the_best(spark):
    rng = random.Random(4)
    pairs = [(1 / (1 + math.exp(-2.5 * z)), int(rng.random() < 1 / (1 + math.exp(-z)))) for z in (rng.gauss(0, 1.5) for _ in range(2000))]
    fitted = calibrate.fit_temperature(spark.createDataFrame(pairs, "score double, label int")).temperature

    def loss(t):
        p = [min(max(1 / (1 + math.exp(-math.log(min(max(s, 1e-6), 1 - 1e-6) / (1 - min(max(s, 1e-6), 1 - 1e-6))) / t)), 1e-12), 1 - 1e-12) for s, _ in pairs]
        return -sum(math.log(q) if y else math.log(1 - q) for q, (_, y) in zip(p, pairs))

    assert all(loss(fitted) <= loss(fitted * f) for f in (0.97, 0.99, 1.01, 1.03)) and 2 < fitted < 3.2


def test_deep_law_trees():
    tree = "字"
    for _ in range(5000):
        tree = {"tag": "Item", "children": [tree]}
    assert corpus.law_text(tree) == "字" + "\n" * 5000


def test_chunks():
    assert corpus.chunk("") == [] and corpus.chunk("短い") == []
    sentence = "山の麓の村では毎年春になると古い祭りが行われ、多くの人が集まって夜まで歌い続けた。"
    text = "\n\n".join([sentence * 4, "== 脚注 ==", sentence * 9])
    assert corpus.chunk(text) == [sentence * 4]
    long = corpus.chunk(sentence * 40)
    assert "".join(long) == sentence * 40 and all(120 <= len(c) <= 600 for c in long)
    assert corpus.chunk("\n\n".join(["| a | b |" + sentence] * 9)) == []
    law = {"tag": "Law", "children": [{"tag": "TOC", "children": ["目次"]}, {"tag": "Article", "attr": {"Num": "3"}, "children": [{"tag": "ArticleTitle", "children": ["第三条"]}, {"tag": "Paragraph", "children": ["本文"]}]}]}
    assert corpus.law_articles(law) == [("3", "第三条　本文")]
