"""Mixing sources to target weights.

Method: temperature mixing. The weight of a source is its token share raised to an
exponent, scaled to the size of the mix between two limits: it gets what is wanted of it at
least, unless its repetition limit, which it never exceeds, is lower. The exponent is
bisected so that the mix has the entropy of the wanted shares. Where every source can give
what is wanted, the limits meet the size of the mix and no exponent changes anything. The
weights are realised as blocks: whole passes over a source, then a budgeted prefix of a
hashed permutation.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import running_total
from .base import bounded_rows, materialise, true_source

#: Rows of a table of targets; it is written by hand.
MAX_TARGETS = 100_000

#: Largest exponent of the token shares on either side.
EXPONENT = 8.0


@dataclass
class Share:
    """One source of one mix: sizes in characters, and the share planned for it."""

    mix_id: int
    source: str
    target_share: float
    max_repeat: int
    size: int
    wanted: float
    budget: float


def entropy(weights: list[float]) -> float:
    total = sum(weights)
    return -sum(w / total * math.log(w / total) for w in weights if w > 0) if total else 0.0


def at_exponent(exponent: float, total: float, low: list[float], high: list[float], sizes: list[float]) -> list[float]:
    """Budgets in proportion to sizes ** exponent, each kept between its limits, with the sum `total`.

    The sum grows with the common factor of the weights in straight pieces, which end where a budget
    reaches a limit, so the factor is found exactly. low adds up to `total` at most, high to `total` at least.
    """
    open_ = [i for i, s in enumerate(sizes) if s > 0 and high[i] > low[i]]
    top = max((sizes[i] for i in open_), default=1.0)
    weight = {i: max((sizes[i] / top) ** exponent, 1e-250) for i in open_}
    factor, ends = 0.0, sorted({limit[i] / weight[i] for i in open_ for limit in (low, high)})
    clamped = lambda f: [min(max(f * weight[i], low[i]), high[i]) if i in weight else low[i] for i in range(len(sizes))]
    for end in ends:
        if sum(clamped(end)) >= total:
            free = [i for i in open_ if low[i] / weight[i] <= factor and high[i] / weight[i] >= end]
            fixed = sum(x for i, x in enumerate(clamped((factor + end) / 2)) if i not in free)
            factor = (total - fixed) / sum(weight[i] for i in free) if free else end
            break
        factor = end
    return clamped(factor)


def tempered(wanted: list[float], caps: list[float], sizes: list[float], steps: int = 60) -> list[float]:
    """Budgets of the sources of a mix: as wanted if no cap is below that, else those whose entropy is nearest to that of `wanted`.

    Among budgets within the limits an exponent of 0 gives the highest entropy (equal budgets as far as the limits allow),
    and it falls on both sides of 0: a larger exponent favours large sources, a smaller one small sources. If the
    wanted entropy isn't below the highest, 0 is the exponent; otherwise it is bisected between 0 and EXPONENT, or
    between 0 and -EXPONENT where only that side reaches it; where none does, the nearer end is taken.
    """
    low = [min(w, c) for w, c in zip(wanted, caps)]
    total = min(sum(wanted), sum(caps))
    budgets = lambda exponent: at_exponent(exponent, total, low, caps, sizes)
    reached = lambda exponent: entropy(budgets(exponent))
    goal = entropy(wanted)
    if sum(wanted) - sum(low) <= 1e-9:
        return low
    if reached(0.0) <= goal:
        return budgets(0.0)
    ends = sorted((EXPONENT, -EXPONENT), key=lambda e: (reached(e) > goal, reached(e) if reached(e) > goal else 0.0, -e))
    near, far = 0.0, ends[0]
    for _ in range(steps):
        middle = (near + far) / 2
        near, far = (middle, far) if reached(middle) > goal else (near, middle)
    return budgets(far)


def sized_items(items: DataFrame) -> DataFrame:
    """(item_id, source, n_chars), each item_id once; the true source is the first part of the id, null text has size 0."""
    once = items.where(F.col("item_id").isNotNull()).groupBy("item_id")
    sized = once.agg(F.max(F.coalesce(F.length("text"), F.lit(0))).cast("long").alias("n_chars"))
    return sized.select("item_id", true_source(F.col("item_id")).alias("source"), "n_chars")


def plan_mixes(sized: DataFrame, targets: DataFrame) -> list[Share]:
    """The budget of every row of `targets`. Rows with a null source or share are left out; a repeated row counts once."""
    sums = sized.groupBy("source").agg(F.sum("n_chars").alias("size"))
    whole = int(sums.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    wanted = targets.select("mix_id", "source", "target_share", "max_repeat", "size_ratio").na.drop().distinct()
    rows = bounded_rows(wanted.join(sums, "source", "left").orderBy("mix_id", "source"), MAX_TARGETS, "the table of targets")
    plan: list[Share] = []
    for mix in dict.fromkeys(r["mix_id"] for r in rows):
        own = [r for r in rows if r["mix_id"] == mix]
        sizes = [int(r["size"] or 0) for r in own]
        amount = [r["target_share"] * r["size_ratio"] * whole for r in own]
        caps = [float(s * r["max_repeat"]) for s, r in zip(sizes, own)]
        budgets = tempered(amount, caps, [float(s) for s in sizes])
        plan += [
            Share(mix, r["source"], r["target_share"], r["max_repeat"], s, a, b)
            for r, s, a, b in zip(own, sizes, amount, budgets)
        ]
    return plan


def plan_frame(items: DataFrame, plan: list[Share]) -> DataFrame:
    return items.sparkSession.createDataFrame(
        [tuple(vars(p).values()) for p in plan],
        "mix_id int, source string, target_share double, max_repeat int, size long, wanted double, budget double",
    )


def mixed(sized: DataFrame, plan: DataFrame, seed: int = 42) -> DataFrame:
    """(mix_id, source, item_id, n_chars, uses): every item that is used, with its number of uses, max_repeat at most.

    A source gets budget div size whole passes; the rest of its budget is the prefix of
    its items in hashed order, so that the characters reached differ from the budget by
    half an item at most. Items without characters aren't used. The hash is the first 60 bits of the MD5 of
    seed, mix and item, which other engines have too.
    """
    share = plan.where("size > 0 and budget > 0").select(
        "mix_id", "source", "max_repeat",
        F.least(F.floor(F.col("budget") / F.col("size")), F.col("max_repeat").cast("long")).alias("passes"),
        (F.col("budget") - F.floor(F.col("budget") / F.col("size")) * F.col("size")).alias("rest"),
    )
    rows = sized.where("n_chars > 0").join(F.broadcast(share), "source")  # bounded by MAX_TARGETS
    named = F.concat_ws(":", F.lit(str(seed)), F.col("mix_id").cast("string"), F.col("item_id"))
    rows = rows.withColumn("_h", F.conv(F.left(F.md5(named.cast("binary")), F.lit(15)), 16, 10).cast("long"))
    rows = running_total(
        rows, ["mix_id", "source"], [F.col("_h"), F.col("item_id")],
        F.shiftright("_h", 48).cast("int"), F.col("n_chars"), "before",
    )
    extra = ((F.col("before") + F.col("n_chars") / 2) <= F.col("rest")) & (F.col("passes") < F.col("max_repeat"))
    uses = (F.col("passes") + extra.cast("long")).cast("int")
    return rows.select("mix_id", "source", "item_id", "n_chars", uses.alias("uses")).where("uses > 0")


def mix_report(mix: DataFrame, plan: DataFrame) -> DataFrame:
    """Shares reached next to those wanted, one row for each row of the plan.

    exhausted: every item was used max_repeat times and the wanted characters weren't reached.
    """
    reached = mix.groupBy("mix_id", "source").agg(
        F.sum(F.col("n_chars") * F.col("uses")).alias("chars"), F.count("*").alias("n_items"), F.max("uses").alias("most_uses")
    )
    total = reached.groupBy("mix_id").agg(F.sum("chars").alias("total"))
    planned = plan.groupBy("mix_id").agg(F.sum("wanted").alias("mix_size"))
    joined = plan.join(reached, ["mix_id", "source"], "left").join(total, "mix_id", "left").join(planned, "mix_id")
    return joined.select(
        "mix_id", "source", "target_share",
        (F.coalesce("chars", F.lit(0)) >= F.col("size") * F.col("max_repeat")).alias("_all"), "wanted",
        F.coalesce("chars", F.lit(0)).cast("long").alias("reached_chars"),
        F.round(F.coalesce(F.col("chars") / F.col("total"), F.lit(0.0)), 6).alias("reached_share"),
        F.round(F.coalesce(F.col("total") / F.col("mix_size"), F.lit(0.0)), 6).alias("size_reached"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("most_uses", F.lit(0)).cast("int").alias("most_uses"),
    ).withColumn("exhausted", F.col("_all") & (F.col("reached_chars") < F.col("wanted"))).drop("_all", "wanted")


@dataclass
class Mixture:
    plan: DataFrame
    items: DataFrame
    report: DataFrame


def mix_sources(items: DataFrame, targets: DataFrame) -> Mixture:
    """The mixes of `targets` drawn from `items`: plan, items with their uses, and report.

    Empty tables give empty results; null texts count nothing. Other columns are ignored.
    """
    sized = materialise(sized_items(items), "sized")
    plan = plan_frame(items, plan_mixes(sized, targets))
    chosen = mixed(sized, plan)
    return Mixture(plan, chosen, mix_report(chosen, plan))
