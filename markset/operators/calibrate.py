"""Score backgrounds, z-scores, isotonic and logistic calibration."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markset.operators.running import join_same, number_rows, percentiles, running
from markset.session import materialize


def _finite(score: Column) -> Column:
    return score.isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf"))


def background_stats(scores: DataFrame, by: list[str]) -> DataFrame:
    """Median, MAD, count and robust scale per group, finite scores only."""
    ok = scores.where(_finite(F.col("score")))
    med = percentiles(ok, by, "score", {"median": 0.5})
    off = ok.join(med.drop("n"), by).select(*by, F.abs(F.col("score") - F.col("median")).alias("off"))
    dev = percentiles(off, by, "off", {"mad": 0.5}).drop("n")
    return med.join(dev, by).withColumn("scale", F.greatest(F.lit(1.4826) * F.col("mad"), F.lit(1e-3)))


def candidate_background(scores: DataFrame, by: list[str], threshold: float, min_samples: int = 20) -> DataFrame:
    """Background from candidates below the operating threshold; null with too few."""
    stats = background_stats(scores.where(F.col("score") < threshold), by)
    keep = F.col("n") >= min_samples
    return stats.select(*by, "n", *[F.when(keep, F.col(c)).alias(c) for c in ("median", "mad", "scale")])


def score_zscore(scores: DataFrame, stats: DataFrame, by: list[str]) -> DataFrame:
    return scores.join(stats, by).withColumn("z", (F.col("score") - F.col("median")) / F.col("scale"))


def sample_background(scores: DataFrame, id_col: str, n: int = 4096, exclude_above: float | None = None,
                      top_share: float = 0.01, seed: int = 0) -> DataFrame:
    """Deterministic sample of ``n`` scores without the peaks: below the top share and
    below ``exclude_above``; all scores when nothing is below."""
    ok = scores.where(_finite(F.col("score")) & (F.col("score") >= -1.0))
    top = percentiles(ok, [], "score", {"cut": 1.0 - top_share}).select("cut") if top_share > 0 else ok.agg(F.lit(float("inf")).alias("cut"))
    limits = top.join(F.broadcast(ok.agg(F.min("score").alias("low"))))
    if exclude_above is not None:
        limits = limits.withColumn("cut", F.least("cut", F.lit(float(exclude_above))))
    below = ok.join(F.broadcast(limits)).where((F.col("score") < F.col("cut")) | (F.col("low") >= F.col("cut")))
    return below.drop("cut", "low").orderBy(F.xxhash64(id_col, F.lit(seed)), id_col).limit(n)


#: Corners of a group that are looked at together at first.
CORNERS = 8192


def _convex(x: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Which of some points, in order of ``x``, are corners of the largest convex curve under them."""
    corners = np.arange(len(x))
    while len(corners) > 2:
        slope = np.diff(s[corners]) / np.diff(x[corners])
        bent = slope[1:] > slope[:-1] + 1e-12
        if bent.all():
            break
        corners = corners[np.concatenate([[True], bent, [True]])]
    return corners


def isotonic_fit(pairs: DataFrame, by: list[str], together: int = CORNERS) -> DataFrame:
    """Monotone map from score to the share of positives, one row per distinct score: ``by``, score, fitted.

    The fit's values are the slopes of the largest convex curve under the running sums of labels over those of
    weights. A point that is no corner of that curve among some neighbours is none of the whole, so the points of a
    group are cut into stretches of ``together``, each keeps its corners only, and what is left is cut again, with
    the cuts shifted, until a group's corners are one stretch. Where little goes, stretches are made longer: of n
    pairs a curve has O(n ** (2/3)) corners, since its slopes are different fractions whose denominators add up to n.
    Scores that are null or not finite are left out; ties are pooled; an empty table gives an empty result.
    """
    pooled = pairs.where(_finite(F.col("score"))).groupBy(*by, "score").agg(F.sum("label").cast("double").alias("_p"), F.count(F.lit(1)).cast("double").alias("_q"))
    points = materialize(running(pooled, by, "score", {"_s": ("sum", "_p"), "_w": ("sum", "_q")}).select(*by, "score", "_w", "_s"), "points")
    types = "".join(f"{c} {pairs.schema[c].dataType.simpleString()}, " for c in by)

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_w", ignore_index=True)
        kept = pdf.iloc[_convex(pdf["_w"].to_numpy(), pdf["_s"].to_numpy())]
        return kept[[*by, "score", "_w", "_s"]].assign(_slope=kept["_s"].diff() / kept["_w"].diff())

    origin = points.select(*by).distinct() if by else points.limit(1).select()
    corners = points.unionByName(origin.select(*by, F.lit(None).cast("double").alias("score"), F.lit(0.0).alias("_w"), F.lit(0.0).alias("_s")))
    left, shift = corners.count(), 0
    while True:
        numbered = number_rows(corners, by, "_w", "_n").withColumn("_part", F.floor((F.col("_n") - 1 + shift) / together))
        longest = numbered.agg(F.max("_n")).first()[0] or 0
        if longest <= together:
            numbered = numbered.withColumn("_part", F.lit(0).cast("long"))
        cut = numbered.groupBy(*by, "_part").applyInPandas(reduce, f"{types}score double, _w double, _s double, _slope double")
        corners = materialize(cut, "corners")
        if longest <= together:
            break
        corners, before = corners.drop("_slope"), left
        left = corners.count()
        together, shift = together * (1 if 2 * left <= before else 4), together // 2 - shift
    steps = points.withColumn("_m", F.lit(None).cast("double")).select(*by, "score", "_m").unionByName(corners.where("score IS NOT NULL").select(*by, "score", (-F.col("_slope")).alias("_m")))
    steps = steps.groupBy(*by, "score").agg(F.max("_m").alias("_m"))
    # slopes rise, so the least one from a score on is that of the corner it leads to
    return running(steps, by, "score", {"_fit": ("max", "_m")}, descending=True).select(*by, "score", (-F.col("_fit")).alias("fitted"))


def calibration_steps(fit: DataFrame, by: list[str]) -> DataFrame:
    """The fit as steps: ``by``, fitted, and the least and the greatest score that has it."""
    return fit.groupBy(*by, "fitted").agg(F.min("score").alias("low"), F.max("score").alias("high"))


def calibrated(scores: DataFrame, fit: DataFrame, by: list[str]) -> DataFrame:
    """``scores`` with ``p``, piecewise linear through the fit of their group and constant outside it.

    Scores and fit are laid in one order, and each score looks at the fit's points before and after it by running
    maxima and minima: no map is gathered, however many points it has. Null where the group has no fit or the score
    is null or not finite.
    """
    wanted = scores.where(_finite(F.col("score"))).select(*by, "score").distinct().withColumn("fitted", F.lit(None).cast("double"))
    laid = wanted.unionByName(fit.select(*by, "score", "fitted")).groupBy(*by, "score").agg(F.max("fitted").alias("fitted"))
    laid = laid.withColumn("_k", F.when(F.col("fitted").isNotNull(), F.struct("score", "fitted")))
    laid = running(running(laid, by, "score", {"_lo": ("max", "_k")}), by, "score", {"_hi": ("min", "_k")}, descending=True)
    x0, y0, x1, y1 = F.col("_lo.score"), F.col("_lo.fitted"), F.col("_hi.score"), F.col("_hi.fitted")
    between = F.when(x1 > x0, y0 + (F.col("score") - x0) * (y1 - y0) / (x1 - x0)).otherwise(y0)
    p = laid.select(*by, "score", F.when(F.col("_lo").isNull(), y1).when(F.col("_hi").isNull(), y0).otherwise(between).alias("p"))
    return join_same(scores, p, [*by, "score"], "left")


def isotonic_fit_global(pairs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """One isotonic fit over all pairs with the distributed regression of pyspark.ml.

    Returns boundaries and values, which are as many as the pooled steps.
    """
    from pyspark.ml.regression import IsotonicRegression

    pooled = pairs.where(_finite(F.col("score"))).groupBy("score").agg(F.avg("label").alias("label"), F.count(F.lit(1)).cast("double").alias("w"))
    model = IsotonicRegression(featuresCol="score", labelCol="label", weightCol="w").fit(pooled)
    return model.boundaries.toArray(), model.predictions.toArray()


def interpolate(x: Column, xs: list[float], ys: list[float]) -> Column:
    """Piecewise linear through ``(xs, ys)``, constant outside."""
    ax, ay = F.array(*[F.lit(float(v)) for v in xs]), F.array(*[F.lit(float(v)) for v in ys])
    i = F.size(F.filter(ax, lambda v: v <= x))  # points at or left of x
    x0, y0, x1, y1 = F.element_at(ax, i), F.element_at(ay, i), F.element_at(ax, i + 1), F.element_at(ay, i + 1)
    inside = y0 + (x - x0) * (y1 - y0) / (x1 - x0)
    return F.when(i == 0, F.lit(float(ys[0]))).when(i == len(xs), F.lit(float(ys[-1]))).otherwise(inside)


def logistic(f: Column) -> Column:
    return 1.0 / (1.0 + F.exp(F.greatest(F.lit(-500.0), F.least(F.lit(500.0), f))))


def platt_fit(pairs: DataFrame, max_iter: int = 100, tol: float = 1e-10) -> tuple[float, float]:
    """``P = 1 / (1 + exp(a*s + b))`` with smoothed targets, by Newton steps.

    Each step is one aggregate of five sums over one row per distinct score and label.
    """
    steps = pairs.where(_finite(F.col("score"))).groupBy("score", "label").agg(F.count(F.lit(1)).alias("n")).persist()
    pos, neg = steps.agg(F.sum(F.when(F.col("label") == 1, F.col("n"))), F.sum(F.when(F.col("label") == 0, F.col("n")))).first()
    if not pos or not neg:
        raise ValueError("logistic calibration needs positive and negative labels")
    target = F.when(F.col("label") == 1, F.lit((pos + 1) / (pos + 2))).otherwise(F.lit(1 / (neg + 2)))
    a, b = 0.0, math.log((neg + 1) / (pos + 1))
    s, n = F.col("score"), F.col("n")
    for _ in range(max_iter):
        p = 1.0 / (1.0 + F.exp(F.lit(a) * s + F.lit(b)))
        g, d = (target - p) * n, p * (1 - p) * n
        g1, g0, h2, h1, h0 = steps.agg(F.sum(g * s), F.sum(g), F.sum(d * s * s), F.sum(d * s), F.sum(d)).first()
        da, db = np.linalg.solve(np.array([[h2, h1], [h1, h0]]) + 1e-12 * np.eye(2), np.array([g1, g0]))
        a, b = a - float(da), b - float(db)
        if max(abs(da), abs(db)) < tol:
            break
    steps.unpersist()
    return a, b
