"""Counting a legend's symbols over a whole set: other sizes, reused blocks, labels, learned judgement."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markset.operators.graph import greedy_keep
from markset.operators.primitives import CTRL, TOLERANCE, choose_scale, match_paths, placements_of_group, resolve_spots, symbol_counts
from markset.operators.spatial import box_join
from markset.session import materialize

#: Limits of a search over sizes, and the sizes at which a symbol found nowhere is tried.
MIN_SCALE, MAX_SCALE, MIN_STEP, MAX_STEP = 0.25, 4.0, 1.001, 2.0
SCALE_STEP = 1.04
SCALE_CANDIDATES = (0.5, 2 / 3, 0.75, 0.8, 1.25, 4 / 3, 1.5, 2.0)

PLACED = ("m11", "m12", "m21", "m22", "tx", "ty")


def scale_range(low: Column, high: Column, step: Column | float = SCALE_STEP) -> Column:
    """Sorted size factors from ``low`` to ``high``, no further apart than ``step``, with 1 among them where it lies between.

    Each side of 1 is cut into equal ratios; factors have four decimals. Null where a bound or the step is null, not
    finite or out of its limits, or ``low`` is above ``high``.
    """
    step = step if isinstance(step, Column) else F.lit(float(step))
    ok = low.between(MIN_SCALE, high) & (high <= MAX_SCALE) & step.between(MIN_STEP, MAX_STEP)

    def spaced(a: Column, b: Column) -> Column:
        n = F.greatest(F.lit(1), F.ceil(F.log(b / a) / F.log(step) - 1e-9).cast("int"))
        return F.transform(F.sequence(F.lit(0), n), lambda i: F.round(a * F.pow(b / a, i / n), 4))

    one = F.lit(1.0)
    points = F.when(low == high, F.array(F.round(low, 4))).when((high <= 1) | (low >= 1), spaced(low, high)).otherwise(F.concat(spaced(low, one), spaced(one, high)))
    return F.when(ok, F.array_sort(F.array_distinct(points)))


def sized_parts(parts: DataFrame, factors: Sequence[float] = SCALE_CANDIDATES) -> DataFrame:
    """The parts of each drawing at each of some sizes, about its own origin; ``exemplar_id`` becomes ``(id, size_no)``.

    As exemplars of their own they enter the index of chords beside each other, so one join proposes places and sizes.
    """
    sizes = F.explode(F.array(*[F.struct(F.lit(i).alias("size_no"), F.lit(float(f)).alias("factor")) for i, f in enumerate(factors)]))
    out = parts.withColumn("_s", sizes)
    return out.select(F.struct(F.col("exemplar_id").alias("id"), F.col("_s.size_no").alias("size_no")).alias("exemplar_id"), "part_no", "kind", *[(F.col(c) * F.col("_s.factor")).alias(c) for c in CTRL])


def search_sizes(primitives: DataFrame, parts: DataFrame, threshold: float = 0.9, tol: float = TOLERANCE,
                 factors: Sequence[float] = SCALE_CANDIDATES, sample_pages: int = 3) -> tuple[DataFrame, DataFrame]:
    """Matches of drawings at the size at which each is drawn on the sheets, and the chosen sizes.

    All sizes are searched at once; what is a drawing at one size is not searched for it at others. Matches are added up over sheets in order until a drawing has turned up on
    ``sample_pages`` of them; the size with most matches is its size on every sheet, ties go to the nearest to 1.
    """
    factor = F.element_at(F.array(*[F.lit(float(f)) for f in factors]), F.col("exemplar_id.size_no") + 1)
    found = match_paths(primitives, sized_parts(parts, factors), threshold, tol, "exemplar_id.id").withColumn("scale", factor).withColumn("exemplar_id", F.col("exemplar_id.id"))
    found = materialize(found, "sized")
    tally = found.groupBy(F.col("exemplar_id").alias("symbol"), F.col("page_id").alias("page_no"), F.col("scale").alias("factor")).agg(F.count(F.lit(1)).alias("n"))
    chosen = choose_scale(tally, sample_pages).select(F.col("symbol").alias("exemplar_id"), F.col("factor").alias("scale"))
    return found.join(chosen, ["exemplar_id", "scale"], "left_semi"), chosen


def place_blocks(placed: DataFrame, uses: DataFrame) -> DataFrame:
    """Every block drawn on a page, those that stand inside other blocks included.

    ``placed``: page_id, placement_id, group_key and the map m11 .. m22, tx, ty from the block's space to the page;
    ``uses``: group_key, use_no, child_key and the map of the child to its parent's space. Returns page_id,
    placement_id, path (the uses followed, empty for what stands on the page), group_key, depth and the map to the
    page. Each level of nesting is one join over all pages. A block that uses itself, at any depth, is an error.
    """
    u = uses.select(F.col("group_key").alias("_parent"), "use_no", "child_key", *[F.col(c).alias(f"u_{c}") for c in PLACED])
    level = placed.select("page_id", "placement_id", F.array().cast("array<bigint>").alias("path"), "group_key", F.lit(0).alias("depth"), *[F.col(c).cast("double").alias(c) for c in PLACED])
    level = materialize(level, "blocks")
    kinds, out = uses.select("group_key").distinct().count(), level
    m = lambda i, j: F.col(f"m{i}{j}")
    v = lambda i, j: F.col(f"u_m{i}{j}")
    for depth in range(1, kinds + 2):
        j = level.join(u, level["group_key"] == u["_parent"])
        level = materialize(j.select(
            "page_id", "placement_id", F.concat("path", F.array(F.col("use_no").cast("bigint"))).alias("path"), F.col("child_key").alias("group_key"), F.lit(depth).alias("depth"),
            *[(m(i, 1) * v(1, k) + m(i, 2) * v(2, k)).alias(f"m{i}{k}") for i in (1, 2) for k in (1, 2)],
            (m(1, 1) * F.col("u_tx") + m(1, 2) * F.col("u_ty") + F.col("tx")).alias("tx"), (m(2, 1) * F.col("u_tx") + m(2, 2) * F.col("u_ty") + F.col("ty")).alias("ty")), "blocks")
        if level.isEmpty():
            return out
        if depth > kinds:  # a chain longer than the blocks that use others meets one of them twice
            raise ValueError("a block uses itself")
        out = out.unionByName(level)
    return out


def block_boxes(blocks: DataFrame, extents: DataFrame) -> DataFrame:
    """Adds to placed blocks the page box of their own extent ``bx0 .. by1``, by group_key."""
    j = blocks.join(extents, "group_key")
    corners = [(F.col("m11") * F.col(x) + F.col("m12") * F.col(y) + F.col("tx"), F.col("m21") * F.col(x) + F.col("m22") * F.col(y) + F.col("ty")) for x in ("bx0", "bx1") for y in ("by0", "by1")]
    xs, ys = zip(*corners)
    return j.withColumns({"x0": F.least(*xs), "y0": F.least(*ys), "x1": F.greatest(*xs), "y1": F.greatest(*ys)}).drop("bx0", "by0", "bx1", "by1")


def _near(a: list[Column], b: list[Column], same_spot: float) -> Column:
    dx, dy = (a[0] + a[2] - b[0] - b[2]) / 2, (a[1] + a[3] - b[1] - b[3]) / 2
    return F.sqrt(dx * dx + dy * dy) < F.greatest(same_spot * F.least(a[2] - a[0], a[3] - a[1], b[2] - b[0], b[3] - b[1]), F.lit(1.0))


def _around(df: DataFrame, *more: str) -> DataFrame:
    """Boxes as wide and high as a spot reaches: half a pixel from the centre at least, so near spots touch."""
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    hw, hh = F.greatest((F.col("x1") - F.col("x0")) / 2, F.lit(0.5)), F.greatest((F.col("y1") - F.col("y0")) / 2, F.lit(0.5))
    return df.select("page_id", "box_id", *more, (cx - hw).alias("x0"), (cy - hh).alias("y0"), (cx + hw).alias("x1"), (cy + hh).alias("y1"))


def apply_learned(found: DataFrame, verdicts: DataFrame, variants: DataFrame | None = None, same_spot: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Matches with look-alikes thrown out and matches of learned variants added; and how many of each per page and tag.

    ``verdicts``: page_id, box_id, accept of the matches of learned symbols; matches without one stay. ``variants``:
    like ``found``, the accepted matches of a symbol's learned drawings; one is added, with source ``learned``, unless
    a match that stays or a better variant stands on its spot. Equal scores go by place, then by box_id.
    """
    judged = found.join(verdicts.select("page_id", "box_id", "accept").hint("merge"), ["page_id", "box_id"], "left").withColumn("_ok", F.coalesce("accept", F.lit(True)))
    stays = materialize(judged.where("_ok").drop("accept", "_ok"), "judged")
    stats = judged.where(~F.col("_ok")).groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("rejected")).withColumn("added", F.lit(0).cast("long"))
    if variants is None:
        return stays, stats
    new = variants.withColumn("source", F.lit("learned")).select(*stays.columns)
    near = box_join(_around(new), _around(stays).withColumnRenamed("box_id", "other")).where(_near([F.col(c) for c in ("x0", "y0", "x1", "y1")], [F.col(f"r{c}") for c in ("x0", "y0", "x1", "y1")], same_spot))
    free = materialize(new.join(near.select("page_id", "box_id").distinct().hint("merge"), ["page_id", "box_id"], "left_anti"), "variants")
    order = [(-F.col("score")).alias("o1"), F.col("oy").alias("o2"), F.col("ox").alias("o3")]
    ranked = _around(free.withColumns({"oy": F.col("y0"), "ox": F.col("x0")}), "score", "oy", "ox")
    kept = greedy_keep(ranked, order, lambda a, b: _near(a, b, same_spot)).where("kept").select("page_id", "box_id")
    added = materialize(free.join(kept.hint("merge"), ["page_id", "box_id"], "left_semi"), "added")
    more = added.groupBy("page_id", "tag").agg(F.lit(0).cast("long").alias("rejected"), F.count(F.lit(1)).alias("added"))
    both = stats.unionByName(more).groupBy("page_id", "tag").agg(F.sum("rejected").alias("rejected"), F.sum("added").alias("added"))
    return stays.unionByName(added), both


def scan_sheets(primitives: DataFrame, parts: DataFrame, legend: DataFrame, lines: DataFrame | None = None, blocks: DataFrame | None = None, block_refs: DataFrame | None = None,
                judge: Callable[[DataFrame], tuple[DataFrame, DataFrame | None]] | None = None, scale_search: bool = True,
                threshold: float = 0.9, tol: float = TOLERANCE, factors: Sequence[float] = SCALE_CANDIDATES) -> dict[str, DataFrame]:
    """Counts a legend's symbols on every sheet of a set.

    ``legend``: exemplar_id, tag, legend_order, needs_label, detail, and ``label`` for symbols told apart by text.
    ``blocks`` are placed blocks with boxes and ``block_refs`` the block of a symbol with its map in the legend: on a
    sheet that places a symbol's block, the placements are its matches, elsewhere its drawing is searched. Symbols
    found on no sheet are searched at other sizes. ``judge`` is given all matches and returns verdicts and learned
    variants for ``apply_learned``. Returns detections, dropped, learned, scales and counts.
    """
    from markset.operators.text import label_near

    paths = match_paths(primitives, parts, threshold, tol)
    columns = ["page_id", "exemplar_id", "rotation", "mirrored", "scale", "score", "x0", "y0", "x1", "y1"]
    paths = paths.select(*columns, F.lit("vector").alias("source"))
    if blocks is not None:
        placed = placements_of_group(blocks.drop("scale"), block_refs).withColumns({"score": F.lit(1.0), "source": F.lit("vector-xobject")})
        placed = materialize(placed.select(*columns, "source"), "blocks")
        own = placed.select("page_id", "exemplar_id").distinct()
        paths = paths.join(own.hint("merge"), ["page_id", "exemplar_id"], "left_anti").unionByName(placed)
    found = materialize(paths, "found")
    scales = parts.select("exemplar_id").distinct().withColumn("scale", F.lit(1.0))
    if scale_search:
        missing = materialize(parts.join(found.select("exemplar_id").distinct(), "exemplar_id", "left_anti"), "missing")
        if not missing.isEmpty():
            sized, chosen = search_sizes(primitives, missing, threshold, tol, factors)
            found = materialize(found.unionByName(sized.select(*columns, F.lit("vector").alias("source"))), "found")
            scales = scales.join(chosen.withColumnRenamed("scale", "_s"), "exemplar_id", "left").select("exemplar_id", F.coalesce("_s", "scale").alias("scale"))
    found = found.join(legend.drop("label"), "exemplar_id")
    found = found.withColumn("box_id", F.xxhash64("page_id", "exemplar_id", "source", "rotation", "mirrored", "x0", "y0", "x1", "y1"))
    learned = None
    if judge is not None:
        found = materialize(found, "found")
        found, learned = apply_learned(found, *judge(found))
    if lines is None:
        found = found.withColumn("label", F.lit(None).cast("string"))
    else:
        found = label_near(found.withColumn("label_set", F.col("exemplar_id")), lines, legend.where(F.col("label").isNotNull()).select(F.col("exemplar_id").alias("label_set"), "label"))
    kept, dropped = resolve_spots(materialize(found, "found"), lines)
    kept = materialize(kept, "kept")
    return {"detections": kept, "dropped": dropped, "learned": learned, "scales": scales, "counts": symbol_counts(kept, legend)}
