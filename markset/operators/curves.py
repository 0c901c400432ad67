"""Precision/recall curves, operating points, thresholds and ranking metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markset.operators.matching import matching_gains
from markset.operators.running import running


def ratio(num: Column, den: Column) -> Column:
    """Quotient, or null (never 0 or 1) when the denominator is 0."""
    return F.when(den == 0, F.lit(None).cast("double")).otherwise(num.cast("double") / den)


def pr_curve(preds: DataFrame, refs: DataFrame, tolerance: float | None = None, by: list[str] | None = None) -> DataFrame:
    """One row per distinct confidence: detections at or above it, TP, FP, FN, P, R, F1.

    ``by`` names page attributes carried by both inputs (none gives the pooled
    curve). Groups with a missing confidence or without references have no curve.
    """
    by = by or []
    gains = matching_gains(preds, refs, tolerance)
    if by:
        gains = gains.join(preds.select("page_id", *by).distinct(), "page_id")
    counted = preds.groupBy(*by, "confidence").agg(F.count(F.lit(1)).alias("n"))
    tp = gains.groupBy(*by, "confidence").agg(F.sum("gain").alias("gain"))
    n_refs = refs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_refs"))
    bad = counted.where(F.col("confidence").isNull()).select(*by, F.lit(1).alias("_bad")).limit(1) if not by else \
        counted.where(F.col("confidence").isNull()).select(*by).distinct()
    steps = counted.join(tp, [*by, "confidence"], "left").fillna(0, ["gain"])
    if by:
        steps = steps.join(n_refs, by).join(bad, by, "left_anti")
    else:
        # one-row totals: refs count and whether any confidence is missing
        steps = steps.join(F.broadcast(n_refs)).join(F.broadcast(bad), F.lit(True), "left_anti")
    steps = steps.where(F.col("n_refs") > 0)
    run = running(steps, by, "confidence", {"detections": ("sum", "n"), "tp": ("sum", "gain")}, descending=True)
    return with_prf(run.withColumn("fp", F.col("detections") - F.col("tp"))
                    .withColumn("fn", F.col("n_refs") - F.col("tp"))
                    .withColumn("prev_recall", (F.col("tp") - F.col("gain")) / F.col("n_refs"))).drop("n", "gain")


def with_prf(df: DataFrame) -> DataFrame:
    """Precision, recall and F1 = 2TP/(2TP+FP+FN) from ``tp, fp, fn``."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return (df.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn))
              .withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn)))


def interpolated_ap(curve: DataFrame, by: list[str] | None = None) -> DataFrame:
    """All-point interpolated average precision: running maximum of precision from
    the right, area over recall from 0."""
    by = by or []
    env = running(curve, by, "confidence", {"envelope": ("max", "precision")})
    area = (F.col("recall") - F.col("prev_recall")) * F.col("envelope")
    return env.groupBy(*by).agg(F.sum(area).alias("ap"), F.count(F.lit(1)).alias("thresholds"))


def operating_points(curve: DataFrame, by: list[str] | None = None, target: float = 0.95) -> DataFrame:
    """Best F1, best precision at recall >= target and best recall at precision >=
    target; ties go to the higher threshold. Long form, one row per kind."""
    kinds = {"best_f1": ("f1", F.lit(True)), "precision_at_recall": ("precision", F.col("recall") >= target),
             "recall_at_precision": ("recall", F.col("precision") >= target)}
    row = F.struct("confidence", "tp", "detections", "precision", "recall", "f1")
    picks = [F.max_by(row, F.when(ok, F.struct(F.col(m), F.col("confidence")))).alias(k) for k, (m, ok) in kinds.items()]
    wide = curve.groupBy(*(by or [])).agg(*picks)
    long = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("at")) for k in kinds])).alias("p")
    return wide.select(*(by or []), long).where("p.at IS NOT NULL").select(*(by or []), "p.kind", "p.at.*")


def sample_curve(curve: DataFrame, n: int = 10) -> DataFrame:
    """At most ``n`` evenly spaced points of a pooled curve, always with the last.

    Position k of n is ``round(k * (len - 1) / (n - 1))``, halves to even.
    """
    ranked = running(curve.withColumn("_one", F.lit(1)), [], "confidence", {"pos": ("sum", "_one")}, descending=True).drop("_one")
    total = ranked.agg(F.count(F.lit(1)).alias("total"))
    k = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    wanted = (total.select("total", k.alias("k"))
              .select(F.when(F.col("total") <= n, F.col("k").cast("bigint")).otherwise(
                  F.bround(F.col("k") * ((F.col("total") - 1) / F.lit(float(n - 1)))).cast("bigint")).alias("at")).distinct())
    return ranked.withColumn("at", F.col("pos") - 1).join(F.broadcast(wanted), "at", "left_semi").drop("at")


def score_steps(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Reviewed pairs by distinct score with running positives and totals from the top."""
    by = by or []
    ok = pairs.where(F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf")))
    steps = ok.groupBy(*by, "score").agg(F.sum("label").cast("bigint").alias("pos"), F.count(F.lit(1)).alias("n"))
    return running(steps, by, "score", {"tp": ("sum", "pos"), "kept": ("sum", "n")}, descending=True)


def suggest_threshold(pairs: DataFrame, by: list[str] | None = None, target: float = 0.95, min_labels: int = 30,
                      variant: str = "calibration") -> DataFrame:
    """Lowest observed score whose precision meets the target, ties kept together.

    ``calibration`` reports the best precision when the target is out of reach;
    ``review`` reports none and has no slack.
    """
    if variant not in ("calibration", "review"):
        raise ValueError("variant must be calibration or review")
    slack = 1e-12 if variant == "calibration" else 0.0
    steps = score_steps(pairs, by).withColumn("precision", F.col("tp") / F.col("kept"))
    row = F.struct("score", "precision", "tp")
    meets = F.col("precision") >= target - slack
    agg = steps.groupBy(*(by or [])).agg(
        F.sum("n").alias("n"), F.sum("pos").alias("n_positive"), F.min_by(row, F.when(meets, F.col("score"))).alias("hit"),
        F.max_by(row, F.struct("precision", "score")).alias("best"))
    few, none, hit = F.col("n") < min_labels, F.col("n_positive") == 0, F.col("hit").isNotNull()
    unreachable = "target_unreachable" if variant == "calibration" else "target_not_reached"
    best_p = F.col("best.precision") if variant == "calibration" else F.lit(None).cast("double")
    best_r = F.col("best.tp") / F.col("n_positive") if variant == "calibration" else F.lit(None).cast("double")
    zero_p = F.lit(0.0) if variant == "calibration" else F.lit(None).cast("double")
    null = F.lit(None).cast("double")
    return agg.select(
        *(by or []), "n", "n_positive", (F.col("n") - F.col("n_positive")).alias("n_negative"),
        F.when(~few & ~none & hit, F.col("hit.score")).alias("value"),
        F.when(few, null).when(none, zero_p).when(hit, F.col("hit.precision")).otherwise(best_p).alias("precision"),
        F.when(few | none, null).when(hit, F.col("hit.tp") / F.col("n_positive")).otherwise(best_r).alias("recall_proxy"),
        F.when(few, "insufficient_labels").when(none, "no_positives").when(hit, "ok").otherwise(unreachable).alias("reason"))


def choose_threshold(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Observed score with the highest F1; ties go to the higher score."""
    by = by or []
    steps = score_steps(pairs, by)
    total = steps.groupBy(*by).agg(F.sum("pos").alias("total_pos"))
    joined = steps.join(total, by) if by else steps.join(F.broadcast(total))
    f1 = ratio(2 * F.col("tp"), F.col("kept") + F.col("total_pos"))
    best = F.max_by(F.struct("score", "f1", "tp", "kept"), F.struct("f1", "score"))
    return joined.withColumn("f1", f1).groupBy(*by).agg(best.alias("b")).select(*by, "b.*")


def grid_threshold(curve: DataFrame, low: float = 0.05, high: float = 0.95, step: float = 0.025) -> DataFrame:
    """Best pooled F1 over a fixed grid of thresholds, read off the exact curve.

    The true positives at a threshold are those of the lowest curve point not
    below it; zero denominators count as 0.
    """
    points = int(round((high - low) / step)) + 1
    grid = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("g")
    spec = curve.select("confidence", "tp", "detections", "n_refs", grid).withColumn(
        "threshold", F.round(low + F.col("g") * step, 4))
    at = F.min_by(F.struct("tp", "detections"), F.when(F.col("confidence") >= F.col("threshold"), F.col("confidence")))
    per = spec.groupBy("threshold").agg(at.alias("at"), F.max("n_refs").alias("n_refs"))
    tp, det = F.coalesce(F.col("at.tp"), F.lit(0)), F.coalesce(F.col("at.detections"), F.lit(0))
    f1 = F.coalesce(ratio(2 * tp, det + F.col("n_refs")), F.lit(0.0))
    best = F.max_by(F.struct("threshold", "f1", "tp", "detections"), F.struct("f1", "threshold"))
    return per.select("threshold", f1.alias("f1"), tp.alias("tp"), det.alias("detections")).agg(best.alias("b")).select("b.*")


def confusion(pairs: DataFrame, threshold: float, by: list[str] | None = None) -> DataFrame:
    """Counts and rates at a threshold (score >= threshold is positive)."""
    up, pos = F.col("score") >= threshold, F.col("label") == 1
    out = pairs.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(pos).alias("pos"), F.count_if(~pos).alias("neg"),
        F.count_if(up & pos).alias("tp"), F.count_if(up & ~pos).alias("fp"),
        F.count_if(~up & pos).alias("fn"), F.count_if(~up & ~pos).alias("tn"))
    return with_prf(out).withColumn("accuracy", ratio(F.col("tp") + F.col("tn"), F.col("n")))


def roc_auc(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mann-Whitney area with average ranks for ties, from one row per distinct score."""
    by = by or []
    steps = score_steps(pairs, by).withColumn("neg", F.col("n") - F.col("pos"))
    # negatives strictly below = all negatives - negatives at or above
    at_or_above = F.col("kept") - F.col("tp")
    total = steps.groupBy(*by).agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    joined = steps.join(total, by) if by else steps.join(F.broadcast(total))
    u = F.sum(F.col("pos") * ((F.col("q") - at_or_above) + F.col("neg") / 2))
    return joined.groupBy(*by).agg(u.alias("u"), F.max("p").alias("p"), F.max("q").alias("q")).select(
        *by, ratio(F.col("u"), F.col("p") * F.col("q")).alias("auc"))


def average_precision_ranked(pairs: DataFrame, by: list[str] | None = None, id_col: str = "pair_id") -> DataFrame:
    """Mean precision at each positive, ranked by score then ``id_col``.

    Ranks inside a run of equal scores come from a window over that run; the
    run's start comes from the running totals, so no window spans all rows.
    """
    by = by or []
    from pyspark.sql import Window

    steps = score_steps(pairs, by).select(*by, "score", (F.col("tp") - F.col("pos")).alias("tp0"),
                                          (F.col("kept") - F.col("n")).alias("n0"))
    w = Window.partitionBy(*by, "score").orderBy(id_col).rowsBetween(Window.unboundedPreceding, 0)
    ranked = (pairs.withColumn("i", F.row_number().over(Window.partitionBy(*by, "score").orderBy(id_col)))
              .withColumn("h", F.sum("label").over(w)).join(steps, [*by, "score"]))
    prec = (F.col("tp0") + F.col("h")) / (F.col("n0") + F.col("i"))
    return ranked.groupBy(*by).agg(
        ratio(F.sum(F.when(F.col("label") == 1, prec).otherwise(0.0)), F.sum("label")).alias("average_precision"))


def log_loss(pairs: DataFrame, by: list[str] | None = None, eps: float = 1e-7) -> DataFrame:
    p = F.least(F.greatest(F.col("score"), F.lit(eps)), F.lit(1 - eps))
    return pairs.groupBy(*(by or [])).agg(
        F.avg(-F.when(F.col("label") == 1, F.log(p)).otherwise(F.log(1 - p))).alias("log_loss"))
