"""Connected components and exact greedy selection as rounds of DataFrame jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markset.functions.geometry import box_cols
from markset.operators.running import dense_ids
from markset.operators.spatial import MEETING, meeting_cells, present_levels, register_cells
from markset.session import materialize

#: Rounds of greedy selection over all that is undecided; what waits longer is walked.
GREEDY_ROUNDS = 8


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(src, dst)``; the component is its least node.

    Alternates large-star and small-star contraction, so the number of rounds
    grows with the logarithm of the component size, and a hub is summarised by
    a partial aggregate before it is joined back. Stored edges are small for their
    number, so these joins are asked to sort and merge.
    """
    e = (edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
         .where(F.col("u") != F.col("v")).distinct())
    e = materialize(e, "edges")  # a round reads its edges several times
    while True:  # every round but the last lowers a parent, so it ends
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where(F.col("v") > F.col("u")).join(low.hint("merge"), "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        e = materialize(small, "components")
        if _is_star_forest(e):
            return (e.select(F.col("u").alias("node"), F.col("v").alias("component"))
                    .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))


def _is_star_forest(e: DataFrame) -> bool:
    """True once every node hangs directly under one root. Contraction keeps
    components connected, so a star forest has one star per component."""
    ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")),
                                      F.struct(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("s"))
    per = ends.groupBy("s.n").agg(F.sum("s.up").alias("up"), F.sum("s.down").alias("down"))
    return per.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()


def greedy_keep(boxes: DataFrame, order: list[Column], conflict: Callable[[list[Column], list[Column]], Column],
                page: tuple[str, ...] = ("page_id",), leaders: bool | str = False) -> DataFrame:
    """Exact greedy selection: walk the boxes of a page in ``order`` and keep a box
    unless it conflicts with one already kept.

    ``boxes``: the page columns, box_id, x0, y0, x1, y1 and the columns used by
    ``order``; box_id breaks ties. ``conflict`` gets two ``[x0, y0, x1, y1]`` lists
    and may only hold for touching boxes; identical boxes must conflict. Returns
    the page columns, box_id and ``kept``; with ``leaders`` also ``leader_id``, the
    best-ordered kept box it conflicts with (itself when kept), or with "number" ``leader``, a
    number of that box.

    Copies of one box collapse to their best first. Each round then keeps every
    box that no undecided box sharing a cell can beat and drops what conflicts
    with it, so a crowd of near copies costs rounds, never all its pairs. Boxes that
    still wait after some rounds stand in long chains; their conflicts are walked.
    """
    page = list(page)
    edge = ["x0", "y0", "x1", "y1"]
    keys = [c.alias(f"_o{i}") for i, c in enumerate(order)]
    sheet = F.col(page[0]) if len(page) == 1 else F.struct(*page)
    plain = boxes.select(sheet.alias("page_id"), "box_id", *edge, *keys)
    # one number per box in the order asked for: cheap to compare, aggregate and join
    ranked = dense_ids(plain, [f"_o{i}" for i in range(len(order))] + ["box_id", "page_id"], "rank", ["page_id", "box_id", *edge])
    # a box with the first one of its place, its spot
    ranked = materialize(ranked.where("page_id IS NOT NULL").withColumn("spot", F.min("rank").over(Window.partitionBy("page_id", *edge))), "spots")
    spots = ranked.where("rank = spot").select("page_id", *edge, "rank")
    levels = present_levels(spots) or [0]
    cell = ["page_id", "_lv", "_gx", "_gy"]
    undecided, rounds = spots, []
    for _ in range(GREEDY_ROUNDS):
        # only hashes of cells and numbers of boxes travel; cells that share a hash let a box wait longer, never win
        # they travel once, for the best of a cell and for those that meet it
        placed = register_cells(undecided, levels).select("rank", "_own", F.xxhash64(*cell).alias("_cell"))
        here = Window.partitionBy("_cell")
        placed = placed.withColumns({"best_any": F.min("rank").over(here), "best_own": F.min(F.when(F.col("_own"), F.col("rank"))).over(here),
                                     "n_any": F.count(F.lit(1)).over(here), "n_own": F.count_if("_own").over(here)})
        # A box must beat everything in cells of its own class, but only the
        # larger boxes at home there in the coarser classes it visits.
        rival = F.when(F.col("_own"), F.col("best_any")).otherwise(F.col("best_own"))
        alone = F.when(F.col("_own"), F.col("n_any") == 1).otherwise(F.col("n_own") == 0)
        free = placed.groupBy("rank").agg(F.min(F.coalesce(F.col("rank") <= rival, F.lit(True))).alias("kept"), F.min(alone).alias("_alone"))
        wins = undecided.join(free.hint("merge"), "rank")
        wins = wins.persist()
        lost = _conflicting(wins.where("kept AND NOT _alone"), wins.where(~F.col("kept")), levels, conflict)
        leader = F.when(F.col("kept"), F.col("rank")).otherwise(F.col("leader"))
        done = materialize(wins.drop("_alone").join(lost.hint("merge"), "rank", "left").withColumn("leader", leader), "greedy")
        wins.unpersist()
        rounds.append(done.where(F.col("leader").isNotNull()))
        undecided = done.where(F.col("leader").isNull()).select("page_id", *edge, "rank")
        if undecided.isEmpty():
            break
    else:
        rounds.append(materialize(_walked(undecided, levels, conflict), "walked"))
    rounds = [r.select(*_SPOT, "kept", "leader") for r in rounds]
    if leaders and len(rounds) > 1:
        # a box may also conflict with a better-ordered box that was kept in a later round; with one kept in an earlier round it never does
        late, early = _united([r.where("kept") for r in rounds[1:]]), _united([r.where(~F.col("kept")) for r in rounds[:-1]])
        better = _conflicting(late, early, levels, conflict).withColumnRenamed("leader", "_better")
        early = early.join(better.hint("merge"), "rank", "left").withColumn("leader", F.least("leader", "_better"))
        rounds = [*[r.where("kept") for r in rounds[:-1]], rounds[-1], early.select(*_SPOT, "kept", "leader")]
    settled = _united(rounds)
    out = ranked.select("page_id", "box_id", "rank", "spot").join(settled.select(F.col("rank").alias("spot"), "leader").hint("merge"), "spot")
    names = ["page_id"] if len(page) == 1 else ["page_id.*"]
    out = out.withColumn("kept", F.col("rank") == F.col("leader"))
    named = leaders and leaders != "number"
    if named:
        out = out.join(ranked.select(F.col("rank").alias("leader"), F.col("box_id").alias("leader_id")).hint("merge"), "leader")
    return out.select(*names, "box_id", "kept", *(["leader_id"] if named else ["leader"] if leaders else [])).withColumnRenamed("page_id", page[0] if len(page) == 1 else "page_id")


_SPOT = ["page_id", "x0", "y0", "x1", "y1", "rank"]


def _united(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _conflicts(others: DataFrame, leaders: DataFrame, levels: list[int], conflict) -> DataFrame:
    """Each of ``others`` with the rank of every one of ``leaders`` that it conflicts with, once a shared cell."""
    a, b = meeting_cells(others.select(*_SPOT), leaders.select(*_SPOT).withColumnRenamed("rank", "leader"), levels)
    return a.join(b.hint("merge"), MEETING).where(conflict(box_cols(), box_cols("r")))


def _conflicting(kept: DataFrame, others: DataFrame, levels: list[int], conflict) -> DataFrame:
    """The ``rank`` of the other boxes that conflict with a kept one, with the best-ordered such ``leader``."""
    return _conflicts(others, kept, levels, conflict).groupBy("rank").agg(F.min("leader").alias("leader"))


def _walked(boxes: DataFrame, levels: list[int], conflict) -> DataFrame:
    """``boxes`` with ``kept`` and ``leader``: each component of conflicts is walked in order.

    The conflicts of a component are read as a stream sorted by rank; only the ranks kept so far are held.
    """
    pairs = _conflicts(boxes, boxes, levels, conflict).where(F.col("leader") < F.col("rank")).select("rank", "leader").distinct()
    pairs = materialize(pairs, "conflicts")
    part = connected_components(pairs.select(F.col("leader").alias("src"), F.col("rank").alias("dst")))
    own = boxes.select("rank", F.col("rank").alias("leader"))  # sorts behind a box's better ones
    rows = pairs.unionByName(own).join(part.select(F.col("node").alias("rank"), "component").hint("merge"), "rank", "left")
    rows = rows.withColumn("component", F.coalesce("component", "rank"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, kept, best = None, set(), None
        for f in frames:
            ranks, leaders = [], []
            for component, rank, other in zip(f["component"], f["rank"], f["leader"], strict=True):
                if component != at:
                    at, kept, best = component, set(), None
                if other == rank:
                    if best is None:
                        kept.add(rank)
                    ranks.append(rank)
                    leaders.append(rank if best is None else best)
                    best = None
                elif best is None and other in kept:
                    best = other
            yield pd.DataFrame({"rank": ranks, "leader": leaders}, dtype="int64")

    order = ["component", "rank", "leader"]
    done = rows.select(*order).repartition("component").sortWithinPartitions(*order).mapInPandas(run, "rank long, leader long")
    return boxes.select(*_SPOT).join(done.hint("merge"), "rank").withColumn("kept", F.col("rank") == F.col("leader"))
