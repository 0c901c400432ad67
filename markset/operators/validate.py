"""Row checks that quarantine with a reason; nothing is dropped silently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ("verified", "unverified", "synthetic", "detector_assisted")  # fixed values: verification statuses


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))


def problems(checks: dict[str, Column]) -> Column:
    """Codes of the conditions that hold, in order; an unknown condition counts as holding."""
    return F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(True)), code) for code, cond in checks.items()]))


def split_good_bad(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    good = F.size("problems") == 0
    return df.where(good).drop("problems"), df.where(~good)


def validate_rows(df: DataFrame, file_cols: list[str], id_col: str, width: Column, height: Column, box: bool = False) -> DataFrame:
    """Add ``problems`` to point rows: finite numbers, closed page frame, non-empty and
    unique id per file, positive box."""
    x, y, key = F.col("x"), F.col("y"), F.col(id_col).cast("string")
    dup = df.groupBy(*file_cols, id_col).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    j = df.join(dup, [*file_cols, id_col], "left")
    checks = {"empty_id": F.coalesce(F.trim(key) == "", F.lit(True)), "not_finite": ~(finite(x) & finite(y)),
              "outside_frame": finite(x) & finite(y) & ~(x.between(0, width) & y.between(0, height)), "duplicate_id": F.col("_n").isNotNull()}
    if box:
        checks["empty_box"] = F.col("w").isNotNull() & ~((F.col("w") > 0) & (F.col("h") > 0))
    return j.withColumn("problems", problems(checks)).drop("_n")


def require_original_output(df: DataFrame) -> DataFrame:
    """Add ``problems`` where a row is not untouched detector output."""
    src = F.coalesce("source", F.lit("detector"))
    corrected = src.isin("manual", "corrected", "review")
    return df.withColumn("problems", problems({"corrected_pin": corrected, "unknown_source": ~corrected & (src != "detector"),
                                               "not_original": F.col("provenance") != "detector_output"}))


def check_frame(df: DataFrame) -> DataFrame:
    """Add ``problems`` where the coordinate frame is not the canonical 200 DPI raster."""
    dpi = F.col("dpi")
    return df.withColumn("problems", problems({
        "wrong_space": F.col("space") != "canonical_raster_px", "wrong_axes": (F.col("origin") != "top-left") | (F.col("y_axis") != "down"),
        "wrong_dpi": dpi.isNotNull() & (dpi != 200), "bad_size": ~((F.col("width") > 0) & (F.col("height") > 0))}))


def check_assisted_reference(df: DataFrame) -> DataFrame:
    """Add ``problems``: assisted labels need a miss check, a reviewer and the admission that
    they are not independent; all others must be independent of the detector."""
    assisted = F.col("status") == "detector_assisted"
    return df.withColumn("problems", problems({
        "unknown_status": ~F.col("status").isin(*STATUSES), "assisted_claims_independence": assisted & F.coalesce("independent_of_detector", F.lit(True)),
        "no_miss_check": assisted & ~F.coalesce("exhaustive_miss_check", F.lit(False)), "no_reviewer": assisted & (F.coalesce(F.trim("reviewed_by"), F.lit("")) == ""),
        "not_independent": ~assisted & ~F.coalesce("independent_of_detector", F.lit(False))}))


def refuse_scan(legends: DataFrame, pages: DataFrame) -> DataFrame:
    """Reasons not to scan a set with a legend, per legend.

    ``legends``: legend_id, legend_digest, document_digest, status, counted, has_drawing;
    ``pages``: legend_id, page_index, n_pages of the pages asked for.
    """
    e = legends.groupBy("legend_id").agg(
        F.max((F.col("legend_digest") != F.col("document_digest")).cast("int")).alias("mismatch"),
        F.max((F.col("counted") & F.col("has_drawing")).cast("int")).alias("countable"), F.count_if(F.col("status") == "check").alias("to_check"))
    p = pages.groupBy("legend_id").agg(F.count_if(~F.col("page_index").between(0, F.col("n_pages") - 1)).alias("out_of_range"))
    j = e.join(p, "legend_id", "left").fillna(0, ["out_of_range"])
    return j.select("legend_id", problems({"legend_mismatch": F.col("mismatch") == 1, "nothing_to_count": F.col("countable") == 0,
                                           "legend_needs_review": F.col("to_check") > 0, "page_index_out_of_range": F.col("out_of_range") > 0}).alias("problems"))


def classify_pages(stats: DataFrame) -> DataFrame:
    """vector, mixed or raster from image coverage and the number of path segments."""
    cov, seg = F.col("image_coverage"), F.col("segments")
    return stats.withColumn("kind", F.when((cov >= 0.5) & (seg < 200), "raster").when(cov >= 0.15, "mixed").otherwise("vector"))


def page_ink_stats(items: DataFrame, page_area: Column) -> DataFrame:
    """Segments, placements and image coverage (at most 1) per page.

    ``items``: page_id, item (segment, placement or image), area.
    """
    agg = items.groupBy("page_id").agg(F.count_if(F.col("item") == "segment").alias("segments"), F.count_if(F.col("item") == "placement").alias("placements"),
                                       F.coalesce(F.sum(F.when(F.col("item") == "image", F.col("area"))), F.lit(0.0)).alias("_area"))
    return agg.withColumn("image_coverage", F.least(F.col("_area") / page_area, F.lit(1.0))).drop("_area")
