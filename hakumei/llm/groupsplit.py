"""Splits that keep related records together.

Method: min-cost flow allocation. Components (works with all their records, or a
single record without a work) are bundled by identical size and label profile; the flow
from bundles to splits respects the quotas, deviations from them and records that
change their split cost; flows are rounded to whole components and these are
assigned inside a bundle by hash.
"""

from __future__ import annotations

import heapq
import math
import warnings
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.ranking import running_total
from .base import bounded_rows, canonical_subset, materialise

#: Bundles that take part in the flow, those with most records first. Components of any further bundle stay where most of
#: their records are; their records count in the quotas all the same.
MAX_BUNDLES = 200_000

#: Changes of the flow after the first whole solution; some seconds.
SEARCH = 50_000

SPLITS = ("train", "validation", "test")


def folded(col: Column) -> Column:
    """A reference without width forms, blanks and case, by the JVM's Unicode library; null stays null.

    Calls by reflection stand in a projection only, so each value is folded once.
    """
    plain = F.regexp_replace(X.nfkc(col), r"(?U)\s+", "")
    folds = F.call_function("reflect", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), F.coalesce(plain, F.lit("")), F.lit(True))
    return F.when(col.isNotNull(), folds)


def works(items: DataFrame) -> DataFrame:
    """(name, work_key, known): every folded name of a work: its key and the attributions of its items.

    A name that is the key of a work is that work's, whoever else is attributed by it; an attribution
    that several works share names the least of them.
    """
    parts = F.split("item_id", ":")
    key = F.concat_ws(":", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))
    keyed = items.where(F.col("item_id").isNotNull()).select(key.alias("work_key"), "attribution").distinct()
    names = keyed.select("work_key", F.posexplode(F.array("work_key", "attribution")).alias("rank", "raw")).where("raw is not null")
    named = names.distinct().select("work_key", "rank", folded(F.col("raw")).alias("name")).where("name != ''")
    best = named.groupBy("name").agg(F.min(F.struct("rank", "work_key")).alias("m"))
    return best.select("name", "m.work_key", F.lit(True).alias("known"))


def reference_name(ref: Column) -> Column:
    """`<source>:<doc>` of a folded item id, work or web address; other folded references as they are."""
    address = F.regexp_extract(ref, r"^[a-z][a-z0-9+.-]*://[^/]+/([^/?#]+/[^/?#]+)", 1)
    plain = F.when(address != "", F.translate(address, "/", ":")).otherwise(ref)
    code = F.regexp_extract(plain, r"^([a-z0-9_.-]+:[a-z0-9_.-]+)(:[a-z0-9_.-]+)?/?$", 1)
    return F.when(code != "", code).otherwise(plain)


def resolved(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, subset, work_key, known) of every document, once for each doc_id.

    work_key is null for a null or blank source_ref; a reference that no item explains keeps its
    folded name as key and isn't known, so that records with the same one stay together. Of rows with one id
    and different contents the largest (subset, source_ref) counts.
    """
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", canonical_subset(F.col("subset")).alias("subset"), "source_ref")
    once = rows.groupBy("doc_id").agg(F.max(F.struct("subset", "source_ref")).alias("r"))
    named = once.select("doc_id", "r.subset", folded(F.col("r.source_ref")).alias("ref"))
    named = named.select("doc_id", "subset", reference_name(F.col("ref")).alias("name"))
    named = named.withColumn("name", F.when(F.col("name") != "", F.col("name")))
    # a name with a large share of the records is split by adaptive execution
    joined = named.join(works(items), "name", "left")
    return joined.select("doc_id", "subset", F.coalesce("work_key", "name").alias("work_key"), F.coalesce("known", F.lit(False)).alias("known"))


@dataclass(frozen=True)
class Bundle:
    """n components of `size` records each, `stay` of them in each split now."""

    size: int
    n: int
    stay: tuple[float, ...]


def whole_quotas(quotas: list[float]) -> list[int]:
    """The quotas as whole records, each less than one record away; their sum is rounded once."""
    ends = [0, *(math.floor(sum(quotas[: i + 1]) + 0.5) for i in range(len(quotas)))]
    return [b - a for a, b in zip(ends, ends[1:])]


def allocation_cost(
    bundles: list[Bundle], quotas: list[float], flow: list[list[int]], deviation: float = 10.0, settled: tuple[int, ...] = ()
) -> float:
    """Records that change split + deviation x (records over or under the whole quotas); `settled` records are in each split anyway."""
    moved = sum(n * (b.size - s) for b, f in zip(bundles, flow) for n, s in zip(f, b.stay))
    there = settled or (0,) * len(quotas)
    loads = [there[t] + sum(b.size * f[t] for b, f in zip(bundles, flow)) for t in range(len(quotas))]
    return moved + deviation * sum(abs(x - q) for x, q in zip(loads, whole_quotas(quotas)))


class _Flow:
    """Records of every bundle in every split, those of fixed components apart; each change can be taken back."""

    def __init__(self, bundles: list[Bundle], quotas: list[float], deviation: float, settled: tuple[int, ...] = ()):
        self.k, self.bundles, self.deviation = len(quotas), bundles, deviation
        self.quotas = whole_quotas(quotas)
        self.unit = [[(b.size - s) / b.size for s in b.stay] for b in bundles]
        self.free = [[0] * self.k for _ in bundles]
        self.fixed = [[0] * self.k for _ in bundles]
        self.load = list(settled) or [0] * self.k
        self.moved = 0.0
        self.changes = 0
        self.log: list[tuple[int, int, int, int, int]] = []
        self.partial: set[int] = set()
        self.arcs: dict[tuple[int, int], list] = defaultdict(list)
        self.single_arcs: dict[tuple[int, int], list] = defaultdict(list)  # of bundles of single records, which are never divided
        for b, bundle in enumerate(bundles):
            s = min(range(self.k), key=lambda t: (self.unit[b][t], t))
            self.change(b, s, bundle.n * bundle.size, 0, bundle.n * bundle.size)

    def change(self, b: int, t: int, free: int, fixed: int, load: int) -> None:
        x, size = self.free[b], self.bundles[b].size
        if not x[t] and free > 0:
            for u in range(self.k):
                if u != t:
                    arc = (self.unit[b][u] - self.unit[b][t], b)
                    heapq.heappush(self.arcs[t, u], arc)
                    if size == 1:
                        heapq.heappush(self.single_arcs[t, u], arc)
        x[t] += free
        self.changes += 1
        self.fixed[b][t] += fixed
        self.load[t] += load
        self.moved += load * self.unit[b][t]
        (self.partial.add if any(v % size for v in x) else self.partial.discard)(b)
        self.log.append((b, t, free, fixed, load))

    def undo(self, mark: int) -> None:
        for b, t, free, fixed, load in reversed(self.log[mark:]):
            self.change(b, t, -free, -fixed, -load)
        del self.log[mark:]

    def cost(self) -> float:
        return self.moved + self.deviation * sum(abs(x - q) for x, q in zip(self.load, self.quotas))

    def shift(self, b: int, s: int, t: int, records: int) -> None:
        self.change(b, s, -records, 0, -records)
        self.change(b, t, records, 0, records)

    def fix(self, b: int, t: int) -> None:
        """One component of the free ones is put into t for good."""
        size = self.bundles[b].size
        for s in range(self.k):
            lack = size - self.free[b][t]
            if s != t and lack > 0 and self.free[b][s]:
                self.shift(b, s, t, min(lack, self.free[b][s]))
        self.change(b, t, -size, 1, 0)

    def _arc(self, s: int, t: int, singles: bool) -> tuple[float, int]:
        heap = (self.single_arcs if singles else self.arcs)[s, t]
        while heap and not self.free[heap[0][1]][s]:
            heapq.heappop(heap)
        return heap[0] if heap else (math.inf, -1)

    def balance(self, singles: bool = False) -> None:
        """The cheapest flow of free records, or of single ones only: records go along the cheapest chain of residual arcs until none lowers the cost."""
        k, quotas, load = self.k, self.quotas, self.load
        while True:
            arc = {(s, t): self._arc(s, t, singles) for s in range(k) for t in range(k) if s != t}
            far = {st: (c, [st]) for st, (c, _) in arc.items()}
            for via in range(k):
                for s in range(k):
                    for t in range(k):
                        if len({s, t, via}) == 3 and far[s, via][0] + far[via, t][0] < far[s, t][0] - 1e-12:
                            far[s, t] = (far[s, via][0] + far[via, t][0], far[s, via][1] + far[via, t][1])
            gain = lambda s, t: (-1 if load[s] > quotas[s] else 1) + (1 if load[t] >= quotas[t] else -1)
            best = min(((c + self.deviation * gain(*st), st) for st, (c, _) in far.items()), default=(0.0, None))
            if best[0] >= -1e-9:
                return
            s, t = best[1]
            chain = [(u, v, arc[u, v][1]) for u, v in far[s, t][1]]
            records = min(self.free[b][u] for u, _, b in chain)
            if load[s] > quotas[s]:
                records = min(records, load[s] - quotas[s])
            if load[t] < quotas[t]:
                records = min(records, quotas[t] - load[t])
            for u, v, b in chain:
                self.shift(b, u, v, records)

    def branches(self, limit: float) -> list[tuple[float, int, int]]:
        """(cost, component's bundle, split), dearest first, for the largest component that the flow divides: its splits whose flow costs less than limit."""
        b = max(self.partial, key=lambda b: (self.bundles[b].size, -b))
        found = []
        for t in range(self.k):
            mark = len(self.log)
            self.fix(b, t)
            self.balance()
            if self.cost() < limit - 1e-6:
                found.append((self.cost(), b, t))
            self.undo(mark)
        return sorted(found, reverse=True)

    def rounded(self) -> tuple[float, list[list[int]]]:
        """A whole solution near the flow: divided components go where that costs least, and single records make up for it."""
        mark = len(self.log)
        while self.partial:
            _, b, t = self.branches(math.inf)[-1]
            self.fix(b, t)
            self.balance(singles=True)
        found = self.cost(), self.whole()
        self.undo(mark)
        return found

    def whole(self) -> list[list[int]]:
        return [[x // b.size + n for x, n in zip(free, fixed)] for b, free, fixed in zip(self.bundles, self.free, self.fixed)]


def allocate(bundles: list[Bundle], quotas: list[float], deviation: float = 10.0, settled: tuple[int, ...] = ()) -> list[list[int]]:
    """Components of each bundle for each split; `settled` records are in each split already and stay.

    The flow of records minimises (records that change split) + deviation x (records over or under
    quota). All records start in their cheapest split and go along the cheapest chain of residual
    arcs between splits as long as that lowers the cost, which is exact for records. A first whole solution rounds it: the
    few components that the flow divides are put where that costs least, and single records make up for it. Then branch and
    bound: a divided component is fixed as a whole, the largest first, where the flow of the rest costs least; then the other splits
    are tried, the last one first, unless their flow can't lead below the best whole solution. Whole components are a
    packing problem: the result is the best one unless SEARCH changes of the flow don't suffice, then the best one seen, with a warning.
    """
    flow = _Flow(bundles, quotas, deviation, settled)
    flow.balance()
    if not flow.partial:
        return flow.whole()
    bound = flow.cost()
    cost, best = flow.rounded()
    # whole numbers of records differ in cost by one at least
    gap = 1 - 1e-5 if float(deviation).is_integer() and all(float(x).is_integer() for b in bundles for x in b.stay) else 1e-6
    levels: list[tuple[int, list]] = []
    limit = flow.changes + SEARCH
    while bound < cost - gap:
        if flow.partial:
            levels.append((len(flow.log), flow.branches(cost - gap + 1e-6)))
        elif flow.cost() < cost - gap:
            best, cost = flow.whole(), flow.cost()
        while levels and not (levels[-1][1] and levels[-1][1][-1][0] < cost - gap):
            levels.pop()
        if not levels:
            break
        if flow.changes > limit:
            warnings.warn(f"allocation: the least cost is between {bound:.0f} and the {cost:.0f} found", stacklevel=2)
            break
        mark, open_ = levels[-1]
        flow.undo(mark)
        _, b, t = open_.pop()
        flow.fix(b, t)
        flow.balance()
    return best


def _home() -> Column:
    """The split that holds most of a component's records, the first among equals."""
    most = F.greatest(*SPLITS)
    return F.when(F.col("train") == most, "train").when(F.col("validation") == most, "validation").otherwise("test")


def grouped_split(records: DataFrame, plan: DataFrame, seed: int = 42, most: int = MAX_BUNDLES) -> DataFrame:
    """(doc_id, work_key, old_subset, new_subset, broken) for every record of resolved().

    Records in train, validation and test get a new subset, the same for all
    records of a work; ood and negatives keep theirs and don't count. broken: the record's work
    has records in several of the three now. An empty table gives no rows; `plan` has a target_share for each
    of the three splits, null or missing is 0. `most` bundles take part in the flow, see MAX_BUNDLES.
    """
    spark = records.sparkSession
    shares = {r["subset"]: r["target_share"] or 0.0 for r in bounded_rows(plan, 100, "the split plan")}
    records = materialise(records.select("doc_id", "subset", "work_key"), "records")
    counted = records.where(F.col("subset").isin(*SPLITS))
    # works are counted, single records are components as they are
    now = [F.sum((F.col("subset") == s).cast("long")).alias(s) for s in SPLITS]
    of_works = counted.where("work_key is not null").groupBy("work_key").agg(*now)
    singles = counted.where("work_key is null").select("doc_id", *((F.col("subset") == s).cast("long").alias(s) for s in SPLITS))
    parts = materialise(of_works.unionByName(singles, allowMissingColumns=True), "components")
    size = F.col("train") + F.col("validation") + F.col("test")
    bundles = materialise(parts.groupBy(*SPLITS).agg(F.count("*").alias("n")).withColumn("total", F.col("n") * size), "bundles")
    rows = bundles.orderBy(F.desc("total"), *SPLITS).limit(most).collect()  # bounded by MAX_BUNDLES
    key = F.struct((-F.col("total")).alias("total"), *SPLITS)
    settled = bundles.where("false")
    if len(rows) == most:
        last = rows[-1]
        settled = bundles.where(key > F.struct(F.lit(-last["total"]).cast("long").alias("total"), *(F.lit(last[s]).cast("long").alias(s) for s in SPLITS)))
    home = {r["home"]: r["total"] for r in settled.groupBy(_home().alias("home")).agg(F.sum("total").alias("total")).collect()}
    total = sum(r["total"] for r in rows) + sum(home.values())
    flow = allocate(
        [Bundle(sum(r[s] for s in SPLITS), r["n"], tuple(float(r[s]) for s in SPLITS)) for r in rows],
        [shares.get(s, 0.0) * total for s in SPLITS], settled=tuple(home.get(s, 0) for s in SPLITS),
    )
    bounds = [(*(r[s] for s in SPLITS), f[0], f[0] + f[1], r["n"]) for r, f in zip(rows, flow)]
    bounds_frame = spark.createDataFrame(bounds, "train long, validation long, test long, to_train long, to_validation long, n long")
    placed = parts.join(F.broadcast(bounds_frame), list(SPLITS), "left")  # MAX_BUNDLES rows of six numbers
    whole = (
        F.when(F.col("n").isNull(), _home()).when(F.col("to_train") == F.col("n"), "train")
        .when((F.col("to_train") == 0) & (F.col("to_validation") == F.col("n")), "validation").when(F.col("to_validation") == 0, "test")
    )
    placed = placed.withColumn("whole", whole).withColumn("_h", F.xxhash64(F.lit(seed), F.coalesce("work_key", "doc_id")))
    # only components of bundles that the flow divides are ranked
    ranked = running_total(
        placed.where("whole is null"), list(SPLITS), [F.col("_h"), F.col("work_key"), F.col("doc_id")],
        F.shiftrightunsigned("_h", 52).cast("int"), F.lit(1), "rank",
    )
    split = F.when(F.col("rank") < F.col("to_train"), "train").when(F.col("rank") < F.col("to_validation"), "validation").otherwise("test")
    several = sum((F.col(s) > 0).cast("int") for s in SPLITS) > 1
    columns = ["work_key", "doc_id", several.alias("broken"), _home().alias("home")]
    new = ranked.select(*columns, split.alias("new_subset")).unionByName(placed.where("whole is not null").select(*columns, F.col("whole").alias("new_subset")))
    out = ["doc_id", "work_key", "old_subset", "new_subset", "broken"]
    single = new.where("work_key is null").withColumn("old_subset", F.col("home")).select(*out)
    members = counted.where("work_key is not null").withColumnRenamed("subset", "old_subset")
    of_work = members.join(new.where("work_key is not null").select("work_key", "new_subset", "broken"), "work_key").select(*out)
    kept = records.where(~F.col("subset").isin(*SPLITS)).select(
        "doc_id", "work_key", F.col("subset").alias("old_subset"), F.col("subset").alias("new_subset"), F.lit(False).alias("broken")
    )
    return single.unionByName(of_work).unionByName(kept)


def broken_works(split: DataFrame) -> DataFrame:
    """(work_key, doc_id) of the records of grouped_split whose work is in more than one of train, validation and test now."""
    return split.where("broken").select("work_key", "doc_id")
