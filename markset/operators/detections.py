"""Operators on candidate detections: caps, peaks, verifier split, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cap_candidates(df: DataFrame, by: list[str], order: list[Column], limit: int) -> DataFrame:
    """First ``limit`` rows of each group and whether the group had more (``truncated``).

    Asks for one row beyond the limit, so Spark keeps only ``limit + 1`` rows
    of a group per task before it shuffles.
    """
    over = Window.partitionBy(*by).orderBy(*order)
    some = df.withColumn("_rn", F.row_number().over(over)).where(F.col("_rn") <= limit + 1)
    more = some.groupBy(*by).agg((F.max("_rn") > limit).alias("truncated"))
    return some.where(F.col("_rn") <= limit).drop("_rn").join(more, by)


def local_maxima(cells: DataFrame, threshold: float, stride: int, width: float, height: float) -> DataFrame:
    """Cells that no neighbour in their 3x3 block exceeds and that reach ``threshold``,
    with the point they stand for. ``cells``: page_id, i, j, heat."""
    around = F.array(*[F.struct((F.col("i") + a).alias("i"), (F.col("j") + b).alias("j")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    # every cell tells its block how hot it is; the maximum is combined before the shuffle
    top = (cells.select("page_id", "heat", F.explode(around).alias("n"))
           .groupBy("page_id", F.col("n.i").alias("i"), F.col("n.j").alias("j")).agg(F.max("heat").alias("top")))
    hot = cells.where(F.col("heat") >= threshold).join(top, ["page_id", "i", "j"]).where(F.col("heat") == F.col("top"))
    half = stride / 2
    return hot.select("page_id", "i", "j", "heat", F.least(F.col("i") * stride + half, F.lit(float(width))).alias("x"),
                      F.least(F.col("j") * stride + half, F.lit(float(height))).alias("y"))


def verifier_filter(cands: DataFrame, scores: DataFrame, threshold: float, keys: list[str], by: list[str],
                    order: list[Column]) -> DataFrame:
    """Split candidates by verifier score into kept and suppressed, numbered per group.

    A kept candidate takes the verifier score and remembers the template score.
    """
    joined = cands.join(scores, keys)
    side = F.when(F.col("verifier_score") >= threshold, "det").otherwise("sup")
    df = joined.withColumn("template_score", F.col("score")).withColumn("score", F.col("verifier_score")).withColumn("side", side)
    n = F.row_number().over(Window.partitionBy(*by, "side").orderBy(*order))
    return df.withColumn("out_id", F.concat_ws("-", "side", n))


def rerank(cands: DataFrame, by: list[str]) -> DataFrame:
    """Position by probability, then score, then top-to-bottom and left-to-right."""
    over = Window.partitionBy(*by).orderBy(F.desc("p"), F.desc("score"), "y", "x", "det_id")
    return cands.withColumn("position", F.row_number().over(over))


def decide(df: DataFrame, method: Column, threshold: Column) -> DataFrame:
    """Value compared by the chosen method (score, verifier or calibrated) and the verdict."""
    value = F.when(method == "verifier", F.col("verifier_p")).when(method == "calibrated", F.col("calibrated_p")).otherwise(F.col("score"))
    return df.withColumn("value", value).withColumn("accepted", F.coalesce(value >= threshold, F.lit(False)))
