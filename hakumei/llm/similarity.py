"""Character-shingle similarity joins: sketch, block join, fingerprint radius, exact verification.

The stages are shared by near-duplicate detection (neardup) and cross-split
overlap (crosssplit):

1. `sketched` turns every record into one row: identity of its squeezed text
   (128-bit hash), block keys, bit code. Narrow.
2. `text_classes` keeps one row per distinct text, so that a text with any number
   of copies counts once from here on.
3. `colliding_classes` explodes the block keys, shuffles 16-byte rows by key and
   emits pairs of classes that share a key, in the task that holds them. Classes under a
   key with more than RUN of them (boilerplate) aren't paired by it: `prefix_pairs` finds their
   pairs exactly, by the rarest of their shingles.
4. across splits, `within_radius` drops pairs beyond the Hamming radius; `verified` fetches the texts of the
   remaining representatives only and computes the exact similarity.

Null ids, null and empty texts, and texts with fewer characters than a shingle, have no
shingles: they are in no class and in no result. Any other columns of the input
are ignored, whatever their names. Rows delivered again with the same id and text
count once; the result has no order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingles
from .base import materialise, release

#: Classes under one key that are paired inside one task.
RUN = 256

#: One class in SAMPLED is looked at to find keys that hold so many classes that no task should even see them all: those with HEAVY of the
#: classes looked at, the HEAVY_KEYS heaviest at most. This only decides which way their pairs are found.
SAMPLED, HEAVY, HEAVY_KEYS = 64, 32, 10_000

#: Candidate representatives up to this number are sent to all executors (about 40 bytes each);
#: beyond, their texts are fetched by a shuffled join.
BROADCAST_IDS = 200_000

_RUN_COLUMNS = ("key", "lo", "side", "size", "rank")
_RUN_SCHEMA = "lo_a long, lo_b long, key long, lo long, side int, size int, rank int"


@dataclass(frozen=True)
class Similarity:
    """Parameters of a join: least similarity, shingle length, blocks of the sketch.

    blocks x rows coordinates; a pair of similarity s has no common block with
    probability (1 - s ** rows) ** blocks, 6e-4 at 0.70 and 2e-5 at 0.75 with 40 x 5.
    code_bits: bits of each coordinate that are compared; radius: bits of the whole code that may differ,
    None for a join that verifies all pairs with a common block.
    """

    least: float = 0.70
    shingle: int = 5
    blocks: int = 40
    rows: int = 5
    code_bits: int = 64
    radius: int | None = None


def _digests(texts: list[str]) -> np.ndarray:
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(t) for t in texts), ">i8").reshape(-1, 2).astype(np.int64)


def sketched(
    df: DataFrame, doc_id: str, text: str, sim: Similarity, side: Column | None = None, subset: Column | None = None
) -> DataFrame:
    """One row (doc_id, side, subset, hi, lo, code, keys) for every record with shingles.

    side: int with bit 1 or 2 set; pairs are only looked for between a 1 and a 2. All rows are both by default.
    subset is passed on. code is null where no radius is asked for.
    """
    source = df.select(
        F.col(doc_id).cast("string").alias("doc_id"),
        F.col(text).alias("text"),
        (F.lit(3) if side is None else side).cast("int").alias("side"),
        (F.lit(None).cast("string") if subset is None else subset).alias("subset"),
    ).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (F.col("text") != ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in shingles.slices([len(t) for t in texts]):
                squeezed = [shingles.squeeze(t) for t in texts[a:b]]
                keep = [i for i, t in enumerate(squeezed) if len(t) >= sim.shingle]
                if not keep:
                    continue
                squeezed = [squeezed[i] for i in keep]
                doc, _, hashes = shingles.grams(*shingles.code_points(squeezed), sim.shingle)
                sketch = shingles.fast_similarity_sketch(doc, hashes, len(squeezed), sim.blocks * sim.rows)
                codes = shingles.coordinate_codes(sketch, sim.code_bits)
                keys = shingles.band_keys(codes, sim.rows)
                bits = [None] * len(keep) if sim.radius is None else [row.tobytes() for row in codes.astype(np.uint8)]
                digest = _digests(squeezed)
                pick = pa.array([a + i for i in keep])
                offsets = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(k).take(pick) for k in (0, 2, 3)),
                        pa.array(digest[:, 0]),
                        pa.array(digest[:, 1]),
                        pa.array(bits, pa.binary()),
                        pa.ListArray.from_arrays(offsets, pa.array(keys.ravel())),
                    ],
                    ["doc_id", "side", "subset", "hi", "lo", "code", "keys"],
                )

    if sim.radius is not None and sim.code_bits != 8:
        raise ValueError("a code with a radius has 8 bits for each coordinate")
    return source.mapInArrow(run, "doc_id string, side int, subset string, hi long, lo long, code binary, keys array<long>")


def text_classes(sketches: DataFrame) -> DataFrame:
    """One row per distinct text: rep (its smallest doc_id), the sides it occurs on, code and block keys."""
    return sketches.groupBy("hi", "lo").agg(
        F.min("doc_id").alias("rep"), F.bit_or("side").alias("side"), F.first("code").alias("code"), F.first("keys").alias("keys")
    )


Fit = Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray], np.ndarray]


def _crossing(rows: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    sa, sb = rows["side"][a], rows["side"][b]
    return (rows["lo"][a] != rows["lo"][b]) & (((sa & 1) & (sb >> 1)) | ((sa >> 1) & (sb & 1))).astype(bool)


def _pairs_of_runs(rows: dict[str, np.ndarray], fit: Fit) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (lo_a < lo_b) of rows with the same key that fit, and the rows of keys with more than RUN; all sorted by key."""
    key, lo = rows["key"], rows["lo"]
    n = len(key)
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, n])
    long = sizes > RUN
    size_of_row = np.repeat(np.where(long, 0, sizes), sizes)
    rank = np.arange(n) - np.repeat(starts, sizes)
    found = [np.empty((0, 2), np.int64)]
    for step in range(1, int(size_of_row.max(initial=1))):
        a = np.flatnonzero(rank + step < size_of_row)
        a = a[fit(rows, a, a + step)]
        if len(a):
            found.append(np.stack([np.minimum(lo[a], lo[a + step]), np.maximum(lo[a], lo[a + step])], 1))
    pairs = np.concatenate(found)
    return np.unique(pairs, axis=0) if len(pairs) else pairs, np.flatnonzero(np.repeat(long, sizes))


def paired_by_key(rows: DataFrame, fit: Fit) -> DataFrame:
    """From rows (key, lo, side, size, rank): pairs lo_a < lo_b under a common key, and as rows the classes of long keys.

    Every key with up to RUN classes is paired in the task that holds it; those of longer keys
    are passed on with their key and are never gathered.
    """
    rows = rows.select(*_RUN_COLUMNS).repartition("key").sortWithinPartitions("key")

    def batch_of(pairs: np.ndarray, rest: dict[str, np.ndarray]) -> pa.RecordBatch:
        n, m = len(pairs), len(rest["key"])
        filled = lambda x, kind: pa.concat_arrays([pa.nulls(n, kind), pa.array(x, kind)])
        pair = lambda x: pa.concat_arrays([pa.array(x, pa.int64()), pa.nulls(m, pa.int64())])
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays(
            [pair(pairs[:, 0]), pair(pairs[:, 1]), *(filled(rest[c], k) for c, k in zip(_RUN_COLUMNS, kinds))],
            ["lo_a", "lo_b", *_RUN_COLUMNS],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = lambda rows, low, high: {c: x[low:high] for c, x in rows.items()}
        none = np.empty((0, 2), np.int64)
        held: dict[str, np.ndarray] | None = None
        long_key: int | None = None
        for batch in batches:
            columns = {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(_RUN_COLUMNS)}
            if held is not None:
                columns = {c: np.concatenate([held[c], x]) for c, x in columns.items()}
            key = columns["key"]
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
            first = 0
            if last and long_key is not None and key[0] == long_key:
                first = int(np.searchsorted(key, long_key, side="right"))
                yield batch_of(none, part(columns, 0, first))
            if last > first:
                whole = part(columns, first, last)
                pairs, rest = _pairs_of_runs(whole, fit)
                yield batch_of(pairs, {c: x[rest] for c, x in whole.items()})
            tail = part(columns, last, len(key))
            if last:
                long_key = None
            if len(tail["key"]) > 2 * RUN or long_key == tail["key"][0]:  # a long key isn't gathered here
                long_key = int(tail["key"][0])
                yield batch_of(none, tail)
                held = part(tail, 0, 0)
            else:
                held = tail
        if held is not None and len(held["key"]):
            pairs, rest = _pairs_of_runs(held, fit)
            yield batch_of(pairs, {c: x[rest] for c, x in held.items()})

    return rows.mapInArrow(run, "lo_a long, lo_b long, key long, lo long, side int, size int, rank int")


def heavy_keys(sketches: DataFrame, sampled: int = SAMPLED) -> DataFrame | None:
    """(key): block keys of a large share of all classes, found among one class in `sampled`; None if there are none."""
    some = sketches.where(F.pmod("lo", F.lit(sampled)) == 0).groupBy("hi", "lo").agg(F.first("keys").alias("keys"))
    counts = some.select(F.explode("keys").alias("key")).groupBy("key").count().where(F.col("count") >= HEAVY)
    keys = counts.orderBy(F.desc("count"), "key").limit(HEAVY_KEYS).select("key").collect()  # bounded by HEAVY_KEYS
    return sketches.sparkSession.createDataFrame(keys, "key long") if keys else None


def colliding_classes(
    sketches: DataFrame, classes: DataFrame, df: DataFrame, doc_id: str, text: str, sim: Similarity, sampled: int = SAMPLED
) -> DataFrame:
    """Distinct pairs (lo_a < lo_b) of classes on both sides that share a block key, or, where their keys are long, could be similar enough."""
    zero = F.lit(0)
    rows = classes.select("lo", "side", F.explode("keys").alias("key")).withColumns({"size": zero, "rank": zero})
    heavy = heavy_keys(sketches, sampled)
    light = rows if heavy is None else rows.join(F.broadcast(heavy), "key", "left_anti")  # HEAVY_KEYS rows
    found = materialise(paired_by_key(light, _crossing), "collisions")
    pairs = found.where("lo_b is not null").select("lo_a", "lo_b")
    hot = found.where("lo_b is null").select("lo")
    if heavy is not None:
        hot = hot.unionByName(rows.join(F.broadcast(heavy), "key", "left_semi").select("lo"))
    hot = hot.distinct()
    if hot.isEmpty():
        return pairs.distinct()
    members = materialise(classes.join(hot, "lo", "left_semi").select("lo", "rep", "side"), "hot-classes")
    return pairs.unionByName(prefix_pairs(members, df, doc_id, text, sim)).distinct()


def prefix_pairs(members: DataFrame, df: DataFrame, doc_id: str, text: str, sim: Similarity) -> DataFrame:
    """Pairs (lo_a, lo_b) of the classes (lo, rep, side) that contain all with at least the similarity wanted; exact, whatever they share.

    Prefix filter: with the shingles of every text in one order, the rarest first, two sets of similarity s have one in common
    among their first (1 - s) x size + 1. So only these are joined, and pairs are left out whose sizes or places
    in the order forbid the similarity. What most of the texts share (boilerplate) comes last and joins nothing.
    """
    texts = texts_of(members.select("rep"), df, doc_id, text)
    source = members.join(texts, "rep").select("lo", "side", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column(2).to_pylist()
            lo = batch.column(0).to_numpy()
            for a, b in shingles.slices([len(t) for t in bodies]):
                squeezed = [shingles.squeeze(t) for t in bodies[a:b]]
                same = _digests(squeezed)[:, 1] == lo[a:b]  # an id with two texts is in two classes
                doc, _, hashes = shingles.grams(*shingles.code_points(squeezed), sim.shingle)
                order = np.lexsort((hashes, doc))
                doc, hashes = doc[order], hashes[order]
                new = np.r_[True, (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])] if len(doc) else np.empty(0, bool)
                doc, hashes = doc[new], hashes[new]
                size = np.bincount(doc, minlength=b - a)
                keep = same[doc]
                doc, hashes = doc[keep], hashes[keep]
                pick = pa.array(a + doc)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pick), batch.column(1).take(pick), pa.array(size[doc].astype(np.int32)), pa.array(hashes.view(np.int64))],
                    ["lo", "side", "size", "token"],
                )

    tokens = materialise(source.mapInArrow(run, "lo long, side int, size int, token long"), "tokens")
    often = tokens.groupBy("token").agg(F.count("*").alias("n"))
    lists = tokens.join(often, "token").groupBy("lo", "side", "size").agg(F.sort_array(F.collect_set(F.struct("n", "token"))).alias("order"))
    prefix = F.slice("order", F.lit(1), F.floor(F.col("size") * (1 - sim.least) + 1e-9).cast("int") + 1)
    rows = lists.select("lo", "side", "size", F.posexplode(prefix).alias("rank", "t"))
    rows = rows.select(F.col("t.token").alias("key"), "lo", "side", "size", "rank")
    share = sim.least / (1 + sim.least)

    def fit(rows: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = rows["size"][a], rows["size"][b]
        common = 1 + np.minimum(x - rows["rank"][a] - 1, y - rows["rank"][b] - 1)  # if this is the first shingle in common
        return _crossing(rows, a, b) & (np.minimum(x, y) >= sim.least * np.maximum(x, y) - 1e-9) & (common >= share * (x + y) - 1e-9)

    found = materialise(paired_by_key(rows, fit), "prefix-pairs")
    release(tokens)
    long = found.where("lo_b is null").select(*_RUN_COLUMNS)
    one, other = (long.select("key", *(F.col(c).alias(f"{c}_{x}") for c in ("lo", "side", "size", "rank"))) for x in "ab")
    crossing = (F.col("side_a").bitwiseAND(1) * F.shiftright("side_b", 1)) + (F.shiftright("side_a", 1) * F.col("side_b").bitwiseAND(1)) > 0
    fits = (
        (F.col("lo_a") < F.col("lo_b")) & crossing
        & (F.least("size_a", "size_b") >= F.lit(sim.least) * F.greatest("size_a", "size_b") - 1e-9)
        & (1 + F.least(F.col("size_a") - F.col("rank_a") - 1, F.col("size_b") - F.col("rank_b") - 1) >= F.lit(share) * (F.col("size_a") + F.col("size_b")) - 1e-9)
    )
    joined = one.join(other, "key").where(fits).select("lo_a", "lo_b")
    return found.where("lo_b is not null").select("lo_a", "lo_b").unionByName(joined)


def within_radius(pairs: DataFrame, classes: DataFrame, radius: int | None) -> DataFrame:
    """Pairs (rep_a, lo_a, rep_b, lo_b) of class representatives whose codes differ in `radius` bits at most; all for None."""
    fields = ("lo", "rep") if radius is None else ("lo", "rep", "code")
    a, b = (classes.select(*(F.col(c).alias(f"{c}_{x}") for c in fields)) for x in "ab")
    joined = pairs.join(a, "lo_a").join(b, "lo_b")
    out = ["rep_a", "lo_a", "rep_b", "lo_b"]
    if radius is None:
        return joined.select(*out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = shingles.hamming(batch.column(4).to_pylist(), batch.column(5).to_pylist()) <= radius
            yield batch.select([0, 1, 2, 3]).filter(pa.array(near))

    return joined.select(*out, "code_a", "code_b").mapInArrow(run, "rep_a string, lo_a long, rep_b string, lo_b long")


def texts_of(ids: DataFrame, df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(rep, text): the texts of the ids in the column rep; an id with several different texts has several rows."""
    ids = materialise(ids.distinct(), "ids")
    texts = df.select(F.col(doc_id).cast("string").alias("rep"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    small = ids.count() <= BROADCAST_IDS
    return texts.join(F.broadcast(ids) if small else ids, "rep", "left_semi").dropDuplicates(["rep", "text"])


def verified(pairs: DataFrame, df: DataFrame, doc_id: str, text: str, sim: Similarity) -> DataFrame:
    """Pairs whose exact similarity is `least` or more: (rep_a, rep_b, similarity), rep_a < rep_b.

    A text is only compared if its hash is that of the class it stands for.
    """
    swap = F.col("rep_a") > F.col("rep_b")
    ordered = pairs.select(
        *(F.when(swap, F.col(f"{c}_{y}")).otherwise(F.col(f"{c}_{x}")).alias(f"{c}_{x}") for x, y in ("ab", "ba") for c in ("rep", "lo"))
    )
    ordered = materialise(ordered.distinct(), "near-pairs")
    texts = texts_of(ordered.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")), df, doc_id, text)
    a, b = (texts.select(F.col("rep").alias(f"rep_{x}"), F.col("text").alias(f"text_{x}")) for x in "ab")
    joined = ordered.join(a, "rep_a").join(b, "rep_b").select("rep_a", "rep_b", "lo_a", "lo_b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            los = [batch.column(k).to_numpy() for k in (2, 3)]
            left, right = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            value = np.zeros(len(left))
            for i, j in shingles.slices([len(x) + len(y) for x, y in zip(left, right)]):
                distinct = list(dict.fromkeys(left[i:j] + right[i:j]))
                place = {t: k for k, t in enumerate(distinct)}
                squeezed = [shingles.squeeze(t) for t in distinct]
                digest = _digests(squeezed)[:, 1]
                doc, _, hashes = shingles.grams(*shingles.code_points(squeezed), sim.shingle)
                ends = np.searchsorted(doc, np.arange(len(distinct) + 1))
                sets = [np.unique(hashes[ends[k] : ends[k + 1]]) for k in range(len(distinct))]
                for k in range(i, j):
                    x, y = place[left[k]], place[right[k]]
                    if digest[x] == los[0][k] and digest[y] == los[1][k]:
                        union = len(np.union1d(sets[x], sets[y]))
                        value[k] = (len(sets[x]) + len(sets[y]) - union) / union if union else 0.0
            out = pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(value)], ["rep_a", "rep_b", "similarity"]
            )
            yield out.filter(pa.array(value >= sim.least))

    return joined.mapInArrow(run, "rep_a string, rep_b string, similarity double")
