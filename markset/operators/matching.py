"""Exact one-to-one matching of predictions to references, page by page."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from markset.functions.assign import gains_in_order, solve_component
from markset.operators.graph import connected_components
from markset.operators.running import spread_rank
from markset.operators.spatial import eligible_pairs
from markset.session import materialize

#: Edges of a page up to which one task takes the page whole.
PAGE_EDGES = 50_000


def _sites(points: DataFrame, id_col: str, count: str, extra: list[str]) -> DataFrame:
    """Points at one place are interchangeable: keep one row per place with its count."""
    return points.groupBy("page_id", "x", "y", *extra).agg(F.min(id_col).alias(id_col), F.count(F.lit(1)).alias(count))


def _split_components(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges standing alone, and the others labelled with their component ``comp``."""
    by_pred, by_ref = Window.partitionBy("page_id", "pred_id"), Window.partitionBy("page_id", "ref_id")
    one = F.lit(1)
    counted = materialize(edges.withColumn("_dp", F.count(one).over(by_pred)).withColumn("_dr", F.count(one).over(by_ref)), "edges")
    alone = (F.col("_dp") == 1) & (F.col("_dr") == 1)
    lone = counted.where(alone).drop("_dp", "_dr")
    rest = counted.where(~alone).drop("_dp", "_dr")
    src = F.struct("page_id", F.lit(0).alias("side"), F.col("pred_id").alias("id"))
    dst = F.struct("page_id", F.lit(1).alias("side"), F.col("ref_id").alias("id"))
    comps = connected_components(rest.select(src.alias("src"), dst.alias("dst")))
    mine = comps.where(F.col("node.side") == 0).select(
        F.col("node.page_id").alias("page_id"), F.col("node.id").alias("pred_id"), F.to_json("component").alias("comp"))
    return lone, rest.join(mine, ["page_id", "pred_id"])


def _component_slices(batches: Iterator[pd.DataFrame], key: str = "comp") -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Whole components (or pages) from key-sorted batches: a frame and the offsets of its components.

    Only the unfinished last component is carried from one batch to the next.
    """
    carry: list[pd.DataFrame] = []
    for pdf in batches:
        if pdf.empty:
            continue
        keys = pdf[key].to_numpy()
        change = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if carry and carry[-1][key].iloc[-1] != keys[0]:
            change = np.concatenate([[0], change])
        if not len(change):
            carry.append(pdf)
            continue
        whole = pd.concat([*carry, pdf.iloc[:change[-1]]], ignore_index=True)
        carry = [pdf.iloc[change[-1]:]]
        yield whole, _offsets(whole, key)
    if carry:
        whole = pd.concat(carry, ignore_index=True)
        yield whole, _offsets(whole, key)


def _components_of_pages(batches: Iterator[pd.DataFrame], lone: Callable[[pd.DataFrame], pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, pd.DataFrame, np.ndarray]]:
    """Of whole pages: what ``lone`` makes of edges that stand alone, and the others by component with offsets."""
    for pdf, _ in _component_slices(batches, "page_id"):
        p = pdf.groupby([c for c in ("page_id", "pred_id", "confidence") if c in pdf], sort=False, dropna=False).ngroup().to_numpy()
        r = pdf.groupby(["page_id", "ref_id"], sort=False).ngroup().to_numpy()
        alone = (np.bincount(p)[p] == 1) & (np.bincount(r)[r] == 1)
        rest = pdf[~alone]
        parent: dict = {}

        def root(x: int) -> int:
            while parent[x] != x:  # noqa: B023
                parent[x] = parent[parent[x]]  # noqa: B023
                x = parent[x]  # noqa: B023
            return x

        for a, b in zip(p[~alone].tolist(), (-1 - r[~alone]).tolist()):
            x, y = root(parent.setdefault(a, a)), root(parent.setdefault(b, b))
            if x != y:
                parent[x] = y
        comp = np.array([root(a) for a in p[~alone].tolist()], dtype="int64")
        order = np.argsort(comp, kind="stable")
        rest = rest.iloc[order].assign(comp=comp[order])
        yield lone(pdf[alone]), rest, _offsets(rest) if len(rest) else np.zeros(1, int)


def _offsets(pdf: pd.DataFrame, key: str = "comp") -> np.ndarray:
    keys = pdf[key].to_numpy()
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def _assigned(pdf: pd.DataFrame, cut: np.ndarray) -> pd.DataFrame:
    p, r, d = pdf["pred_id"].tolist(), pdf["ref_id"].tolist(), pdf["distance"].tolist()
    pn, rn = pdf["pn"].tolist(), pdf["rn"].tolist()
    flow: list[int] = []
    for a, b in zip(cut[:-1], cut[1:]):
        flow += solve_component(p[a:b], r[a:b], d[a:b], dict(zip(p[a:b], pn[a:b])), dict(zip(r[a:b], rn[a:b])))
    pdf = pdf.assign(flow=np.array(flow, dtype="int64"))
    return pdf[pdf["flow"] > 0].drop(columns=["comp"])


def _assign_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf, cut in _component_slices(batches):
        yield _assigned(pdf, cut)


def _assign_pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for lone, rest, cut in _components_of_pages(batches, lambda pdf: pdf.assign(flow=np.minimum(pdf["pn"], pdf["rn"]))):
        yield lone
        if len(rest):
            yield _assigned(rest, cut)


def _by_pages(edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Edges, stored, of pages that one task can take whole, and those of larger pages, if any."""
    edges = materialize(edges, "edges")
    large = edges.groupBy("page_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > PAGE_EDGES).select("page_id")
    large = materialize(large, "large-pages")
    if large.isEmpty():
        return edges, None
    return edges.join(large, "page_id", "left_anti"), edges.join(large, "page_id", "left_semi")


def _of_pages(edges: DataFrame, solver: Callable, schema: str) -> DataFrame:
    return edges.repartition("page_id").sortWithinPartitions("page_id", "pred_id", "ref_id").mapInPandas(solver, schema)


def match_points(preds: DataFrame, refs: DataFrame, tolerance: float | None = None) -> DataFrame:
    """Matched pairs ``(page_id, pred_id, ref_id, distance, dx, dy)``.

    As many pairs as possible, and among those the least total distance. Points
    at one place are matched as one place with a capacity. A task takes a page of up to
    ``PAGE_EDGES`` edges whole and finds its components itself; the components of larger
    pages are found by distributed rounds and streamed through the tasks one by one.
    """
    extra = [] if tolerance is not None else ["tol"]
    edges = eligible_pairs(_sites(preds, "pred_id", "pn", extra), _sites(refs, "ref_id", "rn", []), tolerance)
    edges = edges.select("page_id", "pred_id", "ref_id", "distance", "dx", "dy", "pn", "rn")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in edges.schema) + ", flow bigint"
    small, large = _by_pages(edges)
    flows = _of_pages(small, _assign_pages, schema)
    if large is not None:
        lone, rest = _split_components(large)
        ordered = (rest.select("comp", *edges.columns).repartition("comp")
                   .sortWithinPartitions("comp", "page_id", "pred_id", "ref_id"))
        flows = flows.unionByName(lone.withColumn("flow", F.least("pn", "rn"))).unionByName(ordered.mapInPandas(_assign_batches, schema))
    flows = materialize(flows, "flows")
    single = (F.col("pn") == 1) & (F.col("rn") == 1)
    cols = ["page_id", "pred_id", "ref_id", "distance", "dx", "dy"]
    crowded = flows.where(~single)
    pairs = flows.where(single).select(cols)
    if crowded.isEmpty():
        return pairs
    return pairs.unionByName(_name_units(crowded, preds, refs, extra).select(cols))


def _name_units(flows: DataFrame, preds: DataFrame, refs: DataFrame, extra: list[str]) -> DataFrame:
    """Turn units between crowded places into pairs of individual points."""
    flows = flows.withColumn("edge", F.struct("page_id", "pred_id", "ref_id"))

    def members(points, id_col, keys, side):
        sites = points.groupBy("page_id", *keys).agg(F.min(id_col).alias("site"))
        used = flows.select("page_id", F.col(id_col).alias("site")).distinct()
        named = points.join(sites.join(used, ["page_id", "site"], "left_semi"), ["page_id", *keys])
        ranked = spread_rank(named.select("page_id", "site", id_col), ["page_id", "site"], id_col)
        w = Window.partitionBy("page_id", id_col).orderBy("edge").rowsBetween(Window.unboundedPreceding, -1)
        spans = flows.select("page_id", F.col(id_col).alias("site"), "edge", "flow", "distance", "dx", "dy",
                             F.coalesce(F.sum("flow").over(w), F.lit(0)).alias("lo"))
        return (ranked.join(spans, ["page_id", "site"])
                .where((F.col("rank") > F.col("lo")) & (F.col("rank") <= F.col("lo") + F.col("flow")))
                .select("edge", (F.col("rank") - F.col("lo")).alias("unit"), F.col(id_col).alias(side), "distance", "dx", "dy"))

    left = members(preds, "pred_id", ["x", "y", *extra], "p")
    right = members(refs, "ref_id", ["x", "y"], "r").select("edge", "unit", "r")
    return left.join(right, ["edge", "unit"]).select(
        "edge.page_id", F.col("p").alias("pred_id"), F.col("r").alias("ref_id"), "distance", "dx", "dy")


def _gains(pdf: pd.DataFrame, cut: np.ndarray) -> pd.DataFrame:
    p, r = pdf["pred_id"].tolist(), pdf["ref_id"].tolist()
    pn, rn, conf = pdf["pn"].tolist(), pdf["rn"].tolist(), pdf["confidence"].tolist()
    page = pdf["page_id"].tolist()
    out = []
    for a, b in zip(cut[:-1], cut[1:]):
        nodes = [(q, c) for q, c in zip(p[a:b], conf[a:b])]
        adj: dict = {}
        for node, ref in zip(nodes, r[a:b]):
            adj.setdefault(node, []).append(ref)
        order = sorted(adj, key=lambda n: (-n[1], n[0]))
        got = gains_in_order(order, adj, dict(zip(nodes, pn[a:b])), dict(zip(r[a:b], rn[a:b])))
        out += [(page[a], n[1], g) for n, g in got.items() if g]
    return pd.DataFrame(out, columns=["page_id", "confidence", "gain"])


def _gain_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf, cut in _component_slices(batches):
        yield _gains(pdf, cut)


def _gain_pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for lone, rest, cut in _components_of_pages(batches, lambda pdf: pdf[["page_id", "confidence"]].assign(gain=np.minimum(pdf["pn"], pdf["rn"]))):
        yield lone
        if len(rest):
            yield _gains(rest, cut)


def matching_gains(preds: DataFrame, refs: DataFrame, tolerance: float | None = None) -> DataFrame:
    """``(page_id, confidence, gain)``: how much a maximum matching grows when the
    detections of a confidence join those above it. Sums of gains from the top
    equal a full re-match at each threshold."""
    extra = ["confidence"] if tolerance is not None else ["tol", "confidence"]
    nodes = _sites(preds, "pred_id", "pn", extra)
    # one place may hold several confidences: the least id would not tell them apart
    edges = eligible_pairs(nodes, _sites(refs, "ref_id", "rn", []), tolerance)
    edges = edges.select("page_id", "pred_id", "ref_id", "confidence", "pn", "rn")
    schema = f"page_id {edges.schema['page_id'].dataType.simpleString()}, confidence double, gain bigint"
    small, large = _by_pages(edges)
    gains = _of_pages(small, _gain_pages, schema)
    if large is None:
        return gains
    lone, rest = _split_components(large)
    solved = (rest.select("comp", *edges.columns).repartition("comp").sortWithinPartitions("comp", "pred_id", "ref_id")
              .mapInPandas(_gain_batches, schema))
    return gains.unionByName(lone.select("page_id", "confidence", F.least("pn", "rn").alias("gain"))).unionByName(solved)


def explain_errors(preds: DataFrame, refs: DataFrame, edges: DataFrame, matches: DataFrame) -> DataFrame:
    """Unmatched predictions and references with the reason and the nearest partners.

    ``near`` lists ``distance, id, matched_to`` of every partner within tolerance,
    nearest first.
    """
    p_of = matches.select("page_id", "ref_id", F.col("pred_id").alias("matched_to"))
    r_of = matches.select("page_id", "pred_id", F.col("ref_id").alias("matched_to"))

    def side(points, own, other, taken, kind, none, crowded):
        lost = points.select("page_id", own).join(matches.select("page_id", own), ["page_id", own], "left_anti")
        near = (edges.join(lost, ["page_id", own], "left_semi").join(taken, ["page_id", other], "left")
                .groupBy("page_id", own)
                .agg(F.array_sort(F.collect_list(F.struct("distance", F.col(other).alias("id"), "matched_to"))).alias("near")))
        return (lost.join(near, ["page_id", own], "left")
                .select("page_id", F.lit(kind).alias("kind"), F.col(own).alias("id"),
                        F.when(F.col("near").isNull(), none).otherwise(crowded).alias("reason"), "near"))

    return side(preds, "pred_id", "ref_id", p_of, "false_positive",
                "no_reference_within_tolerance", "duplicate_or_crowded").unionByName(
        side(refs, "ref_id", "pred_id", r_of, "false_negative", "no_prediction_within_tolerance", "crowded"))
