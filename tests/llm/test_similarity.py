import random
from collections import defaultdict
from functools import cache

import numpy as np
from pyspark.sql import functions as F

from hakumei.llm import shingles
from hakumei.llm.components import connected_components
from hakumei.llm.crosssplit import crossing_pairs, overlap_report, split_overlaps
from hakumei.llm.neardup import document_pairs, duplicate_groups, near_duplicates
from hakumei.llm.similarity import Similarity, _crossing, colliding_classes, heavy_keys, paired_by_key, prefix_pairs, sketched, text_classes, verified, within_radius

CHARS = "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめも"


@cache
def grams(text):
    t = shingles.squeeze(text)
    return {t[i : i + 5] for i in range(len(t) - 4)}


def similarity(a, b):
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x and y else 0.0


def family(rng, n, edits):
    base = "".join(rng.choice(CHARS) for _ in range(300))
    out = [base]
    for _ in range(n - 1):
        t = list(base)
        for _ in range(rng.randrange(edits + 1)):
            t[rng.randrange(len(t))] = rng.choice(CHARS)
        out.append("".join(t))
    return out


def rows():
    rng = random.Random(1)
    texts = [t for _ in range(25) for t in family(rng, 5, 9)]
    made = [(f"d{i:03}", t) for i, t in enumerate(texts)]
    made += [("copy1", texts[0]), ("copy2", " " + texts[0][:100] + "\n　" + texts[0][100:]), ("null", None), ("empty", ""), ("blank", " \n"), ("tiny", "あい"), (None, texts[0])]
    return made + made[:3]  # delivered again


def expected(data, cross=None):
    texts = {i: t for i, t in data if i and t}
    ids = sorted(texts)
    return {
        (a, b) for n, a in enumerate(ids) for b in ids[n + 1 :]
        if similarity(texts[a], texts[b]) >= 0.7 and (cross is None or (cross(a) != cross(b)))
    }


def test_pairs_against_brute_force(spark):
    data = rows()
    df = spark.createDataFrame(data, "doc_id string, text string").withColumns({c: F.lit(1) for c in ("hi", "lo", "fp", "keys", "side", "rep")})
    found = near_duplicates(df)
    got = [tuple(r) for r in document_pairs(found).collect()]
    assert len(got) == len(set(got)) and set(got) == expected(data)
    groups = {r["doc_id"]: r for r in duplicate_groups(found).collect()}
    assert set(groups) == {i for i, t in data if i and t and grams(t)}
    for a, b in got:
        assert groups[a]["group_id"] == groups[b]["group_id"]
    assert groups["copy1"]["class_id"] == groups["copy2"]["class_id"] == groups["d000"]["class_id"]


def test_no_banded_pair_is_dropped_by_its_fingerprint(spark):
    df = spark.createDataFrame([("a", "これは近い二つの文章の例であり一字だけ違うものです。甲"), ("b", "これは近い二つの文章の例であり一字だけ違うものです。乙")], "doc_id string, text string")
    pairs = document_pairs(near_duplicates(df, sim=Similarity(code_bits=8, radius=0))).collect()
    assert [tuple(r) for r in pairs] == [("a", "b")]


def test_hot_block_keys(spark):
    """270 texts that share most blocks: more than are paired inside one task."""
    rng = random.Random(4)
    base = [rng.choice(CHARS) for _ in range(850)]
    data = []
    for i in range(270):
        t = list(base)
        t[3 * i] = "漢"
        data.append((f"h{i:03}", "".join(t)))
    pairs = document_pairs(near_duplicates(spark.createDataFrame(data, "doc_id string, text string")))
    assert pairs.count() == 270 * 269 // 2


def boilerplate(rng, n, every, common=80, own=70):
    """Texts that share `common` characters and differ in `own`; one in `every` has a near copy."""
    head = "".join(rng.choice(CHARS) for _ in range(common))
    out = []
    for i in range(n):
        t = head + "".join(rng.choice(CHARS) for _ in range(own))
        out.append((f"b{i:06}", t))
        if i % every == 0:
            out.append((f"c{i:06}", t[:-1] + "漢"))
    return out


def test_hot_block_of_unlike_texts_against_brute_force(spark):
    data = boilerplate(random.Random(8), 1000, 10, 112, 28)
    df = spark.createDataFrame(data, "doc_id string, text string")
    sim = Similarity()
    classes = text_classes(sketched(df, "doc_id", "text", sim))
    assert paired_by_key(classes.select("lo", "side", F.explode("keys").alias("key")).withColumns({"size": F.lit(0), "rank": F.lit(0)}), _crossing).where("lo_b is null").count() > 256
    got = [tuple(r) for r in document_pairs(near_duplicates(df)).collect()]
    assert len(got) == len(set(got)) and set(got) == expected(data)
    # keys known to be heavy beforehand give the same pairs
    sketches = sketched(df, "doc_id", "text", sim)
    assert heavy_keys(sketches, 1).count() >= 1 and heavy_keys(sketches, 1 << 40) is None
    candidates = within_radius(colliding_classes(sketches, classes, df, "doc_id", "text", sim, 1), classes, None)
    assert {tuple(r) for r in verified(candidates, df, "doc_id", "text", sim).select("rep_a", "rep_b").collect()} == set(got)


def test_hot_block_of_50000_texts_has_few_candidates(spark):
    data = boilerplate(random.Random(9), 50_000, 25)
    df = spark.createDataFrame(data, "doc_id string, text string")
    members = text_classes(sketched(df, "doc_id", "text", Similarity())).select("lo", "rep", "side")
    candidates = prefix_pairs(members, df, "doc_id", "text", Similarity()).distinct().count()
    assert 2000 <= candidates < 100_000  # all pairs would be 1.3 billion


def test_cross_split(spark):
    data = rows()
    train = lambda i: hash_of(i) % 3 > 0
    spell = lambda i: (None, "ＴＲＡＩＮ", " train\n")[hash_of(i) % 3 % 3] if train(i) else ("test", "Validation ", "ｏｏｄ")[hash_of(i) % 7 % 3]
    df = spark.createDataFrame([(i, t, spell(i) if i else None) for i, t in data], "doc_id string, text string, subset string")
    got = {tuple(sorted((r["train_id"], r["eval_id"]))) for r in crossing_pairs(split_overlaps(df, F.col("subset"))).collect()}
    assert got == expected(data, train)
    name = {i: spell(i) for i, _ in data if i}
    subset = lambda i: {"test": "test", "Validation ": "validation", "ｏｏｄ": "ood"}[name[i]]
    sources = [(i, (None, "aozora")[hash_of(i) % 2]) for i in name]
    counts = defaultdict(lambda: [0, set(), set()])
    for a, b in got:
        t, e = (a, b) if train(a) else (b, a)
        c = counts[subset(e), dict(sources)[e]]
        c[0] += 1
        c[1].add(e)
        c[2].add(t)
    report = overlap_report(split_overlaps(df, F.col("subset")), spark.createDataFrame(sources, "doc_id string, source string")).collect()
    assert {(r["subset"], r["source"]): (r["n_pairs"], r["n_eval_docs"], r["n_train_docs"]) for r in report} == {k: (n, len(e), len(t)) for k, (n, e, t) in counts.items()}


def hash_of(i):
    return sum(map(ord, i))


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id string, text string, subset string")
    found = near_duplicates(df)
    assert document_pairs(found).count() == 0 and duplicate_groups(found).count() == 0
    assert crossing_pairs(split_overlaps(df, F.col("subset"))).count() == 0


def test_sketch_estimates_similarity_and_fills_all_bins():
    rng = random.Random(2)
    texts = family(rng, 6, 40) + ["あいうえお", "x" * 50]
    doc, _, hashes = shingles.grams(*shingles.code_points(texts), 5)
    sketch = shingles.fast_similarity_sketch(doc, hashes, len(texts), 400)
    assert (sketch != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    codes = [row.tobytes() for row in shingles.coordinate_codes(sketch, 8).astype(np.uint8)]
    for i in range(1, 6):
        true = similarity(texts[0], texts[i])
        assert abs((sketch[0] == sketch[i]).mean() - true) < 0.12
        assert abs(shingles.hamming([codes[0]], [codes[i]])[0] / 400 - 4 * (1 - true)) < 0.6
    again = shingles.fast_similarity_sketch(*[x[doc == 3] for x in (np.zeros_like(doc), hashes)], 1, 400)
    assert (again[0] == sketch[3]).all()


def test_components_against_union_find(spark):
    rng = random.Random(9)
    edges = [(f"n{rng.randrange(300):03}", f"n{rng.randrange(300):03}") for _ in range(220)]
    edges += [(f"p{i:02}", f"p{i + 1:02}") for i in range(60)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    groups = defaultdict(set)
    for x in parent:
        groups[find(x)].add(x)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {x: min(g) for g in groups.values() if len(g) > 1 for x in g}
