"""Corpus roll-ups, regression and promotion gates, and run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markset.operators.curves import with_prf
from markset.operators.running import percentiles

GATED = ("ap", "recall", "f1")  # fixed values: the gated metrics


def page_counts(preds: DataFrame, refs: DataFrame, matches: DataFrame) -> DataFrame:
    """``(page_id, tp, fp, fn)`` for every page with a prediction or a reference."""
    one = F.lit(1)
    parts = (preds.groupBy("page_id").agg(F.count(one).alias("p"))
             .join(refs.groupBy("page_id").agg(F.count(one).alias("r")), "page_id", "full")
             .join(matches.groupBy("page_id").agg(F.count(one).alias("tp")), "page_id", "left").fillna(0))
    return parts.select("page_id", "tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("r") - F.col("tp")).alias("fn"))


def micro_scores(pages: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Pooled counts, divided once."""
    return with_prf(pages.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("pages"), *[F.sum(c).cast("bigint").alias(c) for c in ("tp", "fp", "fn")]))


def macro_scores(pages: DataFrame) -> DataFrame:
    """Unweighted mean of the page values where defined, with the excluded count."""
    scored = with_prf(pages)
    long = scored.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v"))
                                             for m in ("precision", "recall", "f1")])).alias("s"))
    return long.groupBy("s.metric").agg(F.avg("s.v").alias("value"), F.count("s.v").alias("pages_included"),
                                        F.count_if(F.col("s.v").isNull()).alias("pages_excluded"))


def worst_pages(pages: DataFrame, k: int, label: str = "page_id") -> DataFrame:
    """The k lowest F1, then most errors, then label."""
    scored = with_prf(pages).where(F.col("f1").isNotNull())
    return scored.orderBy("f1", (F.col("fp") + F.col("fn")).desc(), label).limit(k)


def localization(matches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Offset statistics over matched pairs; percentiles interpolate linearly."""
    by = by or []
    shares = percentiles(matches, by, "distance", {"median_distance": 0.5, "p95_distance": 0.95}).drop("n")
    means = matches.groupBy(*by).agg(
        F.count(F.lit(1)).alias("matched_pairs"), F.avg("distance").alias("mean_distance"),
        F.max("distance").alias("max_distance"), F.avg("dx").alias("mean_dx"), F.avg("dy").alias("mean_dy"))
    return means.join(shares, by) if by else means.join(F.broadcast(shares))


def runtime_summary(runs: DataFrame, seconds: str, by: list[str] | None = None) -> DataFrame:
    by = by or []
    shares = percentiles(runs, by, seconds, {"p50": 0.5, "p95": 0.95}).drop("n")
    sums = runs.groupBy(*by).agg(
        F.count(seconds).alias("with_runtime"), F.count_if(F.col(seconds).isNull()).alias("without_runtime"),
        F.avg(seconds).alias("mean"), F.sum(seconds).alias("total"))
    return sums.join(shares, by, "left") if by else sums.join(F.broadcast(shares), how="left")


def accuracy_status(pages: DataFrame, by: list[str] | None = None, status: str = "status") -> DataFrame:
    """Headline status from the set of verification statuses of the scored pages."""
    s = F.array_sort(F.collect_set(status))
    only = lambda *names: F.size(F.array_except("kinds", F.array(*[F.lit(n) for n in names]))) == 0
    out = pages.groupBy(*(by or [])).agg(s.alias("kinds"))
    scope = (F.when(F.size("kinds") == 0, "no_reference").when(only("verified"), "verified_reference")
             .when(only("verified", "detector_assisted"), "detector_assisted_reference")
             .when(only("synthetic"), "synthetic_fixture").when(only("unverified"), "unverified_reference")
             .otherwise("mixed_reference"))
    head = (F.when(F.col("scope") == "verified_reference", "measured")
            .when(F.col("scope") == "detector_assisted_reference", "measured_assisted").otherwise("not_measured"))
    return out.withColumn("scope", scope).withColumn("real_drawing_accuracy", head)


def baseline_compare(current: DataFrame, baseline: DataFrame, max_drop: float, keys: list[str] | None = None,
                     metrics: tuple[str, ...] = GATED, eps: float = 1e-12) -> DataFrame:
    """One check per metric: skipped when the baseline lacks it, failed when it can no
    longer be computed or dropped by more than ``max_drop``. Both inputs carry
    ``keys`` (such as the tolerance), which must agree for a comparison."""
    keys = keys or []

    def long(df, name):
        return df.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics])).alias("s")) \
                 .select(*keys, "s.metric", F.col("s.v").alias(name))

    both = long(baseline, "baseline").join(long(current, "current"), [*keys, "metric"], "left")
    drop = F.col("baseline") - F.col("current")
    result = (F.when(F.col("baseline").isNull(), "skipped").when(F.col("current").isNull(), "not_computable")
              .when(drop <= max_drop + eps, "pass").otherwise("fail"))
    return both.withColumn("result", result).withColumn("passed", F.col("result").isin("skipped", "pass"))


def _at_least(n1: Column, d1: Column, n2: Column, d2: Column, margin: int = 0) -> Column:
    """``n1/d1 >= n2/d2 + margin/100`` on whole numbers, without division."""
    big = lambda c: c.cast("decimal(12,0)")
    left = big(n1) * big(d2) * 100
    return left >= big(n2) * big(d1) * 100 + big(d1) * big(d2) * margin


def promotion_gate(modes: DataFrame, baseline: str, candidate: str, margin: int = 2, min_documents: int = 3,
                   min_points: int = 100) -> DataFrame:
    """Six conditions for replacing the baseline mode, decided on exact fractions.

    ``modes``: one row per mode with tp, fp, fn, documents, synthetic.
    """
    def side(name, prefix):
        cols = ["tp", "fp", "fn", "documents", "synthetic"]
        return modes.where(F.col("mode") == name).select(*[F.col(c).alias(prefix + c) for c in cols])

    # one row on each side, so the join is bounded
    j = side(baseline, "b_").join(F.broadcast(side(candidate, "c_")))
    c_tp, b_tp = F.col("c_tp"), F.col("b_tp")
    c_det, b_det, refs = c_tp + F.col("c_fp"), b_tp + F.col("b_fp"), b_tp + F.col("b_fn")
    c_refs = c_tp + F.col("c_fn")
    defined = (c_det > 0) & (b_det > 0) & (refs > 0) & (c_refs > 0)
    checks = {
        "recall_not_below_baseline": defined & _at_least(c_tp, c_refs, b_tp, refs),
        "precision_within_margin": defined & _at_least(c_tp, c_det, b_tp, b_det, -margin),
        "meaningful_improvement": defined & (_at_least(c_tp, c_refs, b_tp, refs, margin) | _at_least(c_tp, c_det, b_tp, b_det, margin)),
        "min_test_documents": F.col("c_documents") >= min_documents,
        "min_reference_points": refs >= min_points,
        "not_synthetic_only": ~F.col("c_synthetic")}
    rows = F.array(*[F.struct(F.lit(k).alias("condition"), v.alias("passed")) for k, v in checks.items()])
    return j.select(F.explode(rows).alias("s")).select("s.*")


def check_pairs(dets: DataFrame, refs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Detection and reference files that do not describe the same page, with the codes."""
    dets, refs = dets.withColumn("_side", F.lit(1)), refs.withColumn("_side", F.lit(1))
    j = dets.alias("d").join(refs.alias("r"), key, "full")
    code = [F.when(F.col("d._side").isNull(), "missing_detections"), F.when(F.col("r._side").isNull(), "missing_reference")]
    both = F.col("d._side").isNotNull() & F.col("r._side").isNotNull()
    code += [F.when(both & ~F.col(f"d.{f}").eqNullSafe(F.col(f"r.{f}")), f"{f}_differs") for f in fields]
    return j.select(key, F.array_compact(F.array(*code)).alias("problems")).where(F.size("problems") > 0)


def refuse_repeated_pages(pages: DataFrame) -> DataFrame:
    """Adds ``repeats``: the position of the first page of the corpus with the same document version and page, null where
    a page is the first of its kind or names no document. ``pages``: corpus_id, position, document_version, page_index."""
    key = ["corpus_id", "document_version", "page_index"]
    first = pages.where("document_version IS NOT NULL AND page_index IS NOT NULL").groupBy(*key).agg(F.min("position").alias("_first"))
    j = pages.join(first, key, "left")
    return j.withColumn("repeats", F.when(F.col("_first") < F.col("position"), F.col("_first"))).select(*pages.columns, "repeats")
