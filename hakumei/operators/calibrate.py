"""Calibration of span scores: transforms as column expressions, fits, error measures."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialise, release

EPS, LOW, HIGH = 1e-6, 1e-2, 1e2


def sigmoid(z: Column) -> Column:
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits; the largest is taken off first, so none overflows. Null and empty stay as they are."""
    shifted = F.transform(logits, lambda z: F.exp(z.cast("double") - F.array_max(logits).cast("double")))
    total = F.aggregate(shifted, F.lit(0.0), lambda a, x: a + x)
    return F.transform(shifted, lambda x: x / total)


def clipped(score: Column) -> Column:
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))


def logit(score: Column, eps: float = EPS) -> Column:
    q = F.least(F.greatest(score, F.lit(eps)), F.lit(1 - eps))
    return F.ln(q / (1 - q))


def tempered(score: Column, temperature: float) -> Column:
    """Score after dividing its logit by the temperature; null stays null."""
    return clipped(sigmoid(logit(clipped(score)) / max(temperature, 1e-12)))


def interpolated(score: Column, xs: list[float], ys: list[float]) -> Column:
    """Piecewise linear through the knots, constant beyond them; a single knot is a constant."""
    s = clipped(score)
    if len(xs) == 1:
        return F.when(s.isNotNull(), F.lit(ys[0]))
    out = F.when(s >= xs[-1], F.lit(ys[-1])).when(s <= xs[0], F.lit(ys[0]))
    for x0, x1, y0, y1 in zip(xs, xs[1:], ys, ys[1:]):
        slope = (y1 - y0) / (x1 - x0) if x1 > x0 else 0.0
        out = out.when(s <= x1, F.lit(slope) * (s - x0) + y0)
    return clipped(out)


@dataclass
class Calibrator:
    """A fitted score transform; `method` is temperature or isotonic."""

    method: str = "temperature"
    temperature: float | None = None
    knots_x: list[float] = field(default_factory=list)
    knots_y: list[float] = field(default_factory=list)
    n_fit: int = 0
    eps: float = EPS
    bounds: tuple[float, float] = (LOW, HIGH)
    version: str = "1"

    @property
    def fitted(self) -> bool:
        return self.temperature is not None or bool(self.knots_x)

    def column(self, score: Column) -> Column:
        if not self.fitted:
            raise RuntimeError("the calibrator has not been fitted")
        if self.method == "temperature":
            return tempered(score, self.temperature)
        return interpolated(score, self.knots_x, self.knots_y)

    def spans(self, spans: Column) -> Column:
        """Scores of spans that don't come from rules, replaced."""
        return F.transform(spans, lambda s: s.withField("score", F.when(s["source"] == "rule", s["score"]).otherwise(self.column(s["score"]))))

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False)

    @classmethod
    def from_json(cls, data: str) -> Calibrator:
        raw = json.loads(data)
        raw["bounds"] = tuple(raw.get("bounds", (LOW, HIGH)))
        return cls(**{k: v for k, v in raw.items() if k in cls.__dataclass_fields__})


def fit_temperature(pairs: DataFrame, score: str = "score", label: str = "label", rounds: int = 40) -> Calibrator:
    """The temperature with the least negative log-likelihood, by Newton steps on its inverse.

    The likelihood is convex in the inverse, so a root of its slope is kept between bounds and a step that leaves them
    is a bisection instead. Pairs are first counted by score rounded to 6 places and label, so every evaluation, one job, reads
    at most two million rows however many pairs there are. Null scores or labels are left out; no pairs raise.
    """
    counted = pairs.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(
        F.round(clipped(F.col(score)), 6).alias("s"), F.col(label).cast("double").alias("y")
    ).agg(F.count("*").alias("n"))
    counted = materialise(counted, "scores")
    total = counted.agg(F.sum("n")).first()[0]
    if not total:
        release(counted)
        raise ValueError("cannot fit a calibrator without scores")
    z = logit(F.col("s"))

    def slopes(inverse: float) -> tuple[float, float]:
        """First and second derivative. The value is data of the job, not part of its code, which so is compiled once."""
        rows = counted.withColumn("b", F.explode(F.array(F.lit(inverse), F.lit(inverse)))).withColumn("p", sigmoid(z * F.col("b")))
        found = rows.agg(F.sum(F.col("n") * z * (F.col("p") - F.col("y"))), F.sum(F.col("n") * z * z * F.col("p") * (1 - F.col("p")))).first()
        return found[0] / 2, found[1] / 2

    low, high = 1 / HIGH, 1 / LOW
    at = 1.0
    for _ in range(rounds):
        slope, curve = slopes(at)
        low, high = (low, at) if slope > 0 else (at, high)
        step = at - slope / curve if curve > 0 else low
        after = step if low < step < high else math.sqrt(low * high)
        done = abs(after - at) < 1e-7 * at or high - low < 1e-9 * low
        at = after
        if done:
            break
    release(counted)
    return Calibrator("temperature", temperature=1 / at, n_fit=int(total))


def fit_isotonic(pairs: DataFrame, score: str = "score", label: str = "label", most: int = 512) -> Calibrator:
    """Monotone regression by Spark ML; its boundaries are the knots, thinned to `most`."""
    from pyspark.ml.regression import IsotonicRegression

    rows = pairs.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(clipped(F.col(score)).alias("s")).agg(
        F.avg(F.col(label).cast("double")).alias("y"), F.count("*").cast("double").alias("w")
    )
    n = rows.agg(F.sum("w")).first()[0]
    if not n:
        raise ValueError("cannot fit a calibrator without scores")
    model = IsotonicRegression(featuresCol="s", labelCol="y", weightCol="w").fit(rows)
    xs, ys = [float(x) for x in model.boundaries.toArray()], [float(y) for y in model.predictions.toArray()]
    keep = [i for i in range(len(xs)) if i in (0, len(xs) - 1) or ys[i] != ys[i - 1] or ys[i] != ys[i + 1]]
    if len(keep) > most:
        keep = sorted({keep[round(i * (len(keep) - 1) / (most - 1))] for i in range(most)})
    return Calibrator("isotonic", knots_x=[xs[i] for i in keep], knots_y=[min(max(ys[i], 0.0), 1.0) for i in keep], n_fit=int(n))


def bins(pairs: DataFrame, by: list[str], score: str = "score", label: str = "label", n: int = 15) -> DataFrame:
    """(*by, bin, n, confidence, accuracy) of equal-width bins that hold their lower edge; 1 is in the last."""
    s = clipped(F.col(score))
    bin_ = F.least(F.floor(s * n), F.lit(n - 1)).cast("int")
    rows = pairs.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    return rows.groupBy(*by, bin_.alias("bin")).agg(
        F.count("*").alias("n"), F.avg(s).alias("confidence"), F.avg(F.col(label).cast("double")).alias("accuracy")
    )


def calibration_errors(pairs: DataFrame, by: list[str], score: str = "score", label: str = "label", n: int = 15) -> DataFrame:
    """(*by, n, ece, mce, brier, nll) in one pass over the pairs, and one over their bins."""
    p = F.least(F.greatest(clipped(F.col(score)), F.lit(EPS)), F.lit(1 - EPS))
    y = F.col(label).cast("double")
    rows = pairs.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    s = clipped(F.col(score))
    bin_ = F.least(F.floor(s * n), F.lit(n - 1)).cast("int")
    per_bin = rows.groupBy(*by, bin_.alias("bin")).agg(
        F.count("*").alias("n"), F.sum(s).alias("s"), F.sum(y).alias("y"), F.sum((s - y) * (s - y)).alias("sq"),
        F.sum(-(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("nll"),
    )
    gap = F.abs(F.col("y") / F.col("n") - F.col("s") / F.col("n"))
    return per_bin.groupBy(*by).agg(
        F.sum("n").alias("n"), (F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"),
        (F.sum("sq") / F.sum("n")).alias("brier"), (F.sum("nll") / F.sum("n")).alias("nll"),
    )


def gated_error(pairs: DataFrame, by: list[str], score: str = "score", label: str = "label", n: int = 15) -> DataFrame:
    """(*by, ece, brier): the calibration error only where both labels and more than two scores, rounded to 4 places, occur, else null."""
    rows = pairs.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    gate = rows.groupBy(*by).agg(((F.count_distinct(label) > 1) & (F.count_distinct(F.round(score, 4)) > 2)).alias("fit"))
    errors = calibration_errors(pairs, by, score, label, n).join(gate, by)
    return errors.select(*by, F.when(F.col("fit"), F.col("ece")).alias("ece"), "brier")
