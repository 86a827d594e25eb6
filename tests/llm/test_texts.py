import random
import unicodedata

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from hakumei.llm import cutting, leakage, lexicon, lookalike, tokens


@given(st.text(alphabet="あ漢a。、\n 」é👨‍👩\r", max_size=300), st.integers(2, 40), st.integers(0, 30))
@settings(max_examples=200, deadline=None)
def test_pieces_restore_the_text(text, most, overlap):
    overlap = min(overlap, most - 1)
    cuts = cutting.pieces(text, most, overlap)
    assert all(b - a <= most for a, b in cuts) and cuts[0][0] == 0 and cuts[-1][1] == len(text)
    assert all(y[0] == x[1] - overlap and y[1] > x[1] for x, y in zip(cuts, cuts[1:]))
    assert text[: cuts[0][1]] + "".join(text[x[1] : y[1]] for x, y in zip(cuts, cuts[1:])) == text


def test_cuts_are_natural():
    text = "一つ目の文です。二つ目の文です。三つ目の長い長い文がここにあります。\n次の段落です。"
    assert [text[b - 1] for _, b in cutting.pieces(text, 20, 0)][:2] == ["。", "\n"]  # the line's end is the strongest cut of the second window
    with pytest.raises(ValueError):
        cutting.pieces(text, 5, 5)


@given(st.lists(st.integers(-1, 4), min_size=1, max_size=60), st.integers(1, 60), st.data())
@settings(max_examples=100, deadline=None)
def test_range_maximum(values, longest, data):
    import numpy as np

    index = cutting.RangeMaximum(np.array(values, np.int8), longest)
    low = data.draw(st.integers(0, len(values) - 1))
    high = data.draw(st.integers(low, min(len(values), low + longest) - 1))
    best = max(range(low, high + 1), key=lambda i: (values[i], i))
    assert index.best(low, high) == best


def test_cut_items(spark):
    from pyspark.sql import functions as F

    data = [("a:1:0", "あ" * 25), ("a:1:0", "あ" * 25), ("a:1:1", "い" * 10), ("a:1:2", None), ("a:1:3", "")]
    df = spark.createDataFrame(data, "item_id string, text string").withColumn("most", F.lit("clash"))
    rows = cutting.cut_items(df, "item_id", "text", F.lit(10), F.lit(2)).orderBy("piece_no").collect()
    assert [(r["item_id"], r["piece_no"], r["n_pieces"], len(r["text"])) for r in rows] == [("a:1:0", k, 3, n) for k, n in ((1, 10), (2, 10), (3, 9))]
    assert cutting.cut_items(df.where("false"), "item_id", "text", F.lit(10), F.lit(2)).count() == 0


@given(st.sets(st.binary(min_size=1, max_size=6), max_size=60), st.lists(st.binary(max_size=7), max_size=30))
@settings(max_examples=100, deadline=None)
def test_lexicon(words, others):
    known = sorted(words)
    lex = lexicon.compile_lexicon(known, [[i, i] for i in range(len(known))])
    rank = {w: i for i, w in enumerate(known)}
    asked = known + others
    assert lex.ranks(asked).tolist() == [rank.get(w, -1) for w in asked]


def test_lexicon_shares_suffixes():
    words = sorted(f"{a}station".encode() for a in "abcdefgh")
    lex = lexicon.compile_lexicon(words, [[0]] * 8)
    assert len(lex.final) == 9


def test_ids(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    coder.encode_special_tokens = True
    rng = random.Random(3)
    texts = [None, "", " ", "日本語の文章です。", "it's <|endoftext|> 123", "a b\r\n\t c", "👍🏽 é", "あ" * 5000]
    texts += ["".join(rng.choice("ab 1。漢\né'") for _ in range(50)) for _ in range(100)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in tokens.encoded(df).collect()}
    assert got == {i: coder.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert tokens.encoded(df.where("false")).count() == 0


def test_wand_against_all_scores():
    """Every passage whose whole score reaches its threshold is retrieved and no other, with lists of many blocks."""
    rng = random.Random(31)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60)]
    texts = ["".join(rng.choice(words[:3] if rng.random() < 0.3 else words) for _ in range(rng.randrange(6, 14))) for _ in range(700)]
    index = leakage.build_index(list(range(700)), texts, 5, 20)
    assert np.diff(index.blocks).max() > 3 and index.blocks[-1] == len(index.block_last)
    for _ in range(200):
        query = "".join(rng.choice(words) for _ in range(rng.randrange(2, 30)))
        *_, hashes = leakage.shingles.grams(*leakage.shingles.code_points([query]), 5)
        rows = np.flatnonzero(np.isin(index.terms, hashes))
        score = np.zeros(700)
        for r in rows:
            a, b = index.starts[r], index.starts[r + 1]
            score[index.passage[a:b]] += index.impact[a:b]
        hit = [p for p in range(700) if score[p] >= index.least[p]]
        assert leakage.retrieve(index, rows) == hit
    for p in range(0, 700, 50):  # the threshold is the least weight of a window
        own = index.codes[index.offsets[p] : index.offsets[p + 1]]
        weights = []
        for a in range(len(own) - 19):
            *_, hashes = leakage.shingles.grams(own[a : a + 20], np.array([0, 20]), 5)
            lists = [(index.starts[r], index.starts[r + 1]) for r in np.flatnonzero(np.isin(index.terms, hashes))]
            weights.append(sum(float(index.impact[a:b][index.passage[a:b] == p][0]) for a, b in lists))
        assert abs(min(weights) - index.least[p]) < 1e-4 * min(weights)


def test_index_of_10000_passages_is_small():
    rng = random.Random(32)
    texts = ["".join(chr(rng.randrange(0x4E00, 0x5E00)) for _ in range(200)) for _ in range(10_000)]
    index = leakage.build_index(list(range(10_000)), texts, 15, 30)
    assert index.nbytes < 200_000_000


def test_leaks_against_brute_force(spark):
    rng = random.Random(8)
    letters = "あいうえおかきくけこアイウエオ漢字文章山川"
    passages = ["".join(rng.choice(letters) for _ in range(rng.choice((20, 29, 30, 31, 80)))) for _ in range(40)] + [None, "", "短い"]
    docs = []
    for i in range(200):
        text = "".join(rng.choice(letters) for _ in range(100))
        own = rng.choice(passages[:40])
        n = rng.choice((25, 29, 30, 31, 60))
        at = rng.randrange(max(1, len(own) - n))
        part = own[at : at + n]
        if i % 3 == 0:
            part = "、\n".join(part[k : k + 7] for k in range(0, len(part), 7))
        docs.append((i, text[:50] + part + text[50:]))
    docs += [(900, None), (901, ""), (902, "x"), (None, passages[4] * 3)]
    fold = lambda t: regex.sub(r"[^\p{L}\p{N}]+", "", unicodedata.normalize("NFKC", t or "").casefold())
    windows = {}
    for k, p in enumerate(passages):
        f = fold(p)
        for i in range(len(f) - 29):
            windows.setdefault(f[i : i + 30], set()).add(k)
    truth = {(i, k) for i, t in docs if i is not None for f in [fold(t)] for j in range(len(f) - 29) for k in windows.get(f[j : j + 30], ())}
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    tests = spark.createDataFrame(list(enumerate(passages)), "passage_id long, text string")
    assert {tuple(r) for r in leakage.leaked_passages(frame, tests).collect()} == truth and truth
    assert {tuple(r) for r in leakage.leaked_passages(frame, tests, index_chars=300).collect()} == truth  # in many parts
    assert leakage.leaked_passages(frame, tests.where("false")).count() == 0
    assert leakage.leaked_passages(frame.where("false"), tests).count() == 0


@pytest.mark.parametrize("a, b", [
    ("ＡＢＣ－１２３", "ABC-123"), ("ｶﾞｷﾞ", "ガギ"), ("が", "が"), ("Аpple", "Apple"), ("Τom", "Tom"), ("口ボット", "ロボット"),
    ("へや", "ヘや"), ("a　b", "a b"), ("a b", "a b"), ("x\r\ny", "x\ny"), ("x\ry", "x y"), ("a​b", "ab"), ("a­b", "ab"),
    ("1−2", "1-2"), ("⽇本", "日本"), ("金", "金"), ("❤️", "❤"),
])
def test_alike(a, b):
    assert lookalike.consistent_form(a) == lookalike.consistent_form(b)


@pytest.mark.parametrize("a, b", [("A", "a"), ("や", "ゃ"), ("か", "が"), ("ハ", "パ"), ("m²", "m2"), ("①", "1"), ("½", "1⁄2"), ("a b", "ab"), ("リ", "り")])
def test_not_alike(a, b):
    assert lookalike.consistent_form(a) != lookalike.consistent_form(b)


@given(st.text(max_size=40))
@settings(max_examples=200, deadline=None)
def test_form_is_stable(text):
    form = lookalike.consistent_form(text)
    assert lookalike.consistent_form(form) == form


def test_lookalike_pairs(spark):
    data = [(1, "ABC 1"), (2, "ＡＢＣ 1"), (3, "ABC 1"), (4, "abc 1"), (5, None), (6, ""), (7, " "), (8, "　"), (2, "ＡＢＣ 1")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert sorted(tuple(r) for r in lookalike.lookalike_pairs(df).collect()) == [(1, 2), (2, 3)]
    assert lookalike.lookalike_pairs(df.where("false")).count() == 0
    assert {r["doc_id"]: r["form"] for r in lookalike.normalised(df).collect()}[5] is None
