"""Distance and overlap joins as grid equi-joins.

A pair can only qualify if it shares a grid cell, so each join is an equi-join
on ``(page_id, cell)`` with the exact predicate as residual. A dense page is
spread over its cells; no page is ever gathered in one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markset.functions.geometry import box_cols, iou


def _cells(df: DataFrame, x_lo: Column, x_hi: Column, y_lo: Column, y_hi: Column, size: Column) -> DataFrame:
    """One row per grid cell that the given extent touches."""
    return (df.withColumn("_gx", F.explode(F.sequence(F.floor(x_lo / size), F.floor(x_hi / size))))
              .withColumn("_gy", F.explode(F.sequence(F.floor(y_lo / size), F.floor(y_hi / size)))))


def _level(side: Column, step: int = 2) -> Column:
    """Size class: exponent of the smallest power of two not below ``side`` (at least 1),
    rounded up to a multiple of ``step``. Coarser steps mean fewer classes to visit."""
    return (F.ceil(F.log2(F.greatest(side, F.lit(1.0))) / step) * step).cast("int")


def eligible_pairs(preds: DataFrame, refs: DataFrame, tolerance: float | None = None) -> DataFrame:
    """Predictions and references of a page no further apart than the prediction's radius.

    ``preds``: page_id, pred_id, x, y and ``tol`` unless ``tolerance`` is given;
    ``refs``: page_id, ref_id, x, y. Other columns are carried along. The limit
    is inclusive and a zero radius keeps exact hits.
    """
    refs = refs.withColumnsRenamed({"x": "rx", "y": "ry"})
    if tolerance is not None:
        size = F.lit(float(4 * tolerance) if tolerance > 0 else 1.0)
        tol, keys = F.lit(float(tolerance)), ["page_id", "_gx", "_gy"]
        left, right = preds, refs
    else:
        # Radii differ: each prediction uses the grid of its own size class and
        # references are placed on every size class present on their page.
        tol, keys = F.col("tol"), ["page_id", "_lv", "_gx", "_gy"]
        left = preds.withColumn("_lv", _level(4 * tol, step=1))
        right = refs.join(left.select("page_id", "_lv").distinct(), "page_id")
        size = F.pow(F.lit(2.0), F.col("_lv"))
    left = _cells(left, F.col("x") - tol, F.col("x") + tol, F.col("y") - tol, F.col("y") + tol, size)
    right = right.withColumn("_gx", F.floor(F.col("rx") / size)).withColumn("_gy", F.floor(F.col("ry") / size))
    dx, dy = F.col("x") - F.col("rx"), F.col("y") - F.col("ry")
    joined = left.join(right, keys).withColumn("distance", F.sqrt(dx * dx + dy * dy))
    return (joined.where(F.col("distance") <= tol)
            .withColumn("dx", dx).withColumn("dy", dy).drop("_gx", "_gy", "_lv"))


def present_levels(*frames: DataFrame) -> list[int]:
    """Size classes of the boxes, at most one entry per power of four."""
    found: set[int] = set()
    for df in frames:
        side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
        found |= {r[0] for r in df.select(_level(side).alias("lv")).distinct().collect()}
    return sorted(found)


def register_cells(df: DataFrame, levels: list[int], box: str = "") -> DataFrame:
    """Place boxes on the grid of their own size class and of every coarser one present.

    Adds ``_lv``, ``_gx``, ``_gy`` and ``_own`` (the box belongs to this class).
    Any two touching boxes share a cell in the class of the larger one.
    """
    x0, y0, x1, y1 = box_cols(box)
    ladder = F.array(*[F.lit(v) for v in levels])
    own = _level(F.greatest(x1 - x0, y1 - y0))
    out = df.withColumn("_lv", F.explode(F.filter(ladder, lambda v: v >= own))).withColumn("_own", F.col("_lv") == own)
    return _cells(out, x0, x1, y0, y1, F.pow(F.lit(2.0), F.col("_lv")))


#: Where two boxes meet, by ``meeting_cells``: page, class, cell, and which of them are at home there.
MEETING = ["page_id", "_lv", "_gx", "_gy", "_home"]
_BOTH, _LEFT, _RIGHT = 0, 1, 2


def meeting_cells(left: DataFrame, right: DataFrame, levels: list[int], right_levels: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides placed for a join on ``MEETING``: boxes meet in the class of the larger one only.

    Small boxes that visit a coarse cell meet the boxes at home there, never each other, so one
    sheet-sized box doesn't make pairs of all the others. ``levels`` are the classes of the boxes, of the left
    ones only where ``right_levels`` are given.
    """

    def placed(df: DataFrame, here: list[int], there: list[int], mine: int, theirs: int) -> DataFrame:
        # a box stands only where the other side can meet it: at home if that side has boxes of its class or
        # finer ones, in a coarser class if that side has boxes at home there
        own, lv = F.col("_own"), F.col("_lv")
        home = F.array_compact(F.array(F.when(own & lv.isin(there), _BOTH), F.when(own & (lv > min(there, default=math.inf)), mine), F.when(~own & lv.isin(there), theirs)))
        return register_cells(df, sorted({*here, *there}) or [0]).withColumn("_home", F.explode(home)).drop("_own")

    there = levels if right_levels is None else right_levels
    return placed(left, levels, there, _LEFT, _RIGHT), placed(right, there, levels, _RIGHT, _LEFT).withColumnsRenamed({"x0": "rx0", "y0": "ry0", "x1": "rx1", "y1": "ry1"})


def box_join(left: DataFrame, right: DataFrame, levels: list[int] | None = None) -> DataFrame:
    """Pairs of boxes of a page that touch or overlap, each once.

    Both sides carry page_id, x0, y0, x1, y1; their other columns must have
    distinct names. The right box comes back as rx0, ry0, rx1, ry1.

    A box becomes a row a cell, which the planner's sizes do not show, so the join is
    asked to sort and merge: a side read from small files must not be broadcast.
    """
    if levels is None:
        a, b = meeting_cells(left, right, present_levels(left), present_levels(right))
    else:
        a, b = meeting_cells(left, right, levels)
    size = F.pow(F.lit(2.0), F.col("_lv"))
    return (a.join(b.hint("merge"), MEETING)
            .where((F.col("x0") <= F.col("rx1")) & (F.col("x1") >= F.col("rx0"))
                   & (F.col("y0") <= F.col("ry1")) & (F.col("y1") >= F.col("ry0")))
            # the cell holding the corner where the overlap starts reports the pair
            .where((F.col("_gx") == F.floor(F.greatest("x0", "rx0") / size))
                   & (F.col("_gy") == F.floor(F.greatest("y0", "ry0") / size)))
            .drop("_lv", "_gx", "_gy", "_home"))


def conflict_test(iou_threshold: float | None, center_ratio: float) -> Callable[[list[Column], list[Column]], Column]:
    """Two boxes are duplicates if IoU is above the threshold or their centres are
    closer than ``center_ratio`` times the smaller short side."""

    def test(a: list[Column], b: list[Column]) -> Column:
        dx = (a[0] + a[2]) / 2 - (b[0] + b[2]) / 2
        dy = (a[1] + a[3]) / 2 - (b[1] + b[3]) / 2
        short = F.least(a[2] - a[0], a[3] - a[1], b[2] - b[0], b[3] - b[1])
        near = F.sqrt(dx * dx + dy * dy) < center_ratio * short
        return near if iou_threshold is None else (iou(a, b) > iou_threshold) | near

    return test


def box_conflicts(boxes: DataFrame, iou_threshold: float, center_ratio: float) -> DataFrame:
    """Conflicting box pairs ``(page_id, a_id, b_id, iou)`` with ``a_id < b_id``.

    For ratios up to 1 conflicting boxes always touch, which the grid relies on.
    """
    if center_ratio > 1:
        raise ValueError("center_ratio must not exceed 1")
    a = boxes.select("page_id", F.col("box_id").alias("a_id"), "x0", "y0", "x1", "y1")
    b = boxes.select("page_id", F.col("box_id").alias("b_id"), "x0", "y0", "x1", "y1")
    left, right = box_cols(), box_cols("r")
    return (box_join(a, b, present_levels(boxes)).where(F.col("a_id") < F.col("b_id"))
            .where(conflict_test(iou_threshold, center_ratio)(left, right))
            .select("page_id", "a_id", "b_id", iou(left, right).alias("iou")))


def range_join(rects: DataFrame, boxes: DataFrame, center_only: bool = False) -> DataFrame:
    """Boxes that intersect a rectangle, or whose centre lies in it. Edges count as inside."""
    out = box_join(rects, boxes)
    if center_only:
        cx, cy = (F.col("rx0") + F.col("rx1")) / 2, (F.col("ry0") + F.col("ry1")) / 2
        out = out.where(cx.between(F.col("x0"), F.col("x1")) & cy.between(F.col("y0"), F.col("y1")))
    return out
