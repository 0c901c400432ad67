import itertools
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from markset.functions.assign import assign_component, gains_in_order
from markset.operators import curves
from markset.operators.graph import connected_components
from markset.operators.matching import _assign_batches, _gain_batches, match_points, matching_gains
from markset.operators.spatial import eligible_pairs


def brute(preds, refs, tol):
    """Largest matching and its least distance, by trying every assignment."""
    edges = {(p, r): math.hypot(px - rx, py - ry) for p, px, py in preds for r, rx, ry in refs if math.hypot(px - rx, py - ry) <= tol}

    def best(i, used):
        if i == len(preds):
            return 0, 0.0
        n, d = best(i + 1, used)
        for r, *_ in refs:
            if r not in used and (preds[i][0], r) in edges:
                m, e = best(i + 1, used | {r})
                if (m + 1, -(e + edges[preds[i][0], r])) > (n, -d):
                    n, d = m + 1, e + edges[preds[i][0], r]
        return n, d

    return best(0, frozenset())


def frames(spark, pages):
    p = [(g, i, float(x), float(y)) for g, (ps, _) in pages.items() for i, x, y in ps]
    r = [(g, i, float(x), float(y)) for g, (_, rs) in pages.items() for i, x, y in rs]
    return (spark.createDataFrame(p, "page_id long, pred_id long, x double, y double"), spark.createDataFrame(r, "page_id long, ref_id long, x double, y double"))


def random_pages(seed, pages=25, size=6, span=12):
    rnd = random.Random(seed)
    pt = lambda n: [(i, rnd.randint(0, span), rnd.randint(0, span)) for i in range(n)]
    return {g: (pt(rnd.randint(0, size)), pt(rnd.randint(0, size))) for g in range(pages)}


def test_matching_equals_brute_force(spark):
    pages = random_pages(1)
    got = match_points(*frames(spark, pages), 4.0).groupBy("page_id").agg(F.count("*").alias("n"), F.sum("distance").alias("d")).collect()
    got = {r["page_id"]: (r["n"], r["d"]) for r in got}
    for g, (p, r) in pages.items():
        n, d = brute(p, r, 4.0)
        assert got.get(g, (0, 0.0))[0] == n
        assert got.get(g, (0, 0.0))[1] == pytest.approx(d, abs=1e-6)


def test_matching_is_one_to_one_and_order_free(spark):
    preds, refs = frames(spark, random_pages(2, size=9))
    a = match_points(preds, refs, 5.0)
    b = match_points(preds.orderBy(F.rand(3)).repartition(7), refs.orderBy(F.rand(4)).repartition(3), 5.0)
    assert a.count() == a.select("page_id", "pred_id").distinct().count() == a.select("page_id", "ref_id").distinct().count()
    total = lambda df: df.agg(F.count("*"), F.round(F.sum("distance"), 6)).first()
    assert total(a) == total(b)


def test_copies_at_one_place(spark):
    """A crowd of identical points is matched as one place with a capacity."""
    preds = spark.range(3000).select(F.lit(1).cast("long").alias("page_id"), F.col("id").alias("pred_id"), F.lit(5.0).alias("x"), F.lit(5.0).alias("y"))
    refs = spark.range(2000).select(F.lit(1).cast("long").alias("page_id"), F.col("id").alias("ref_id"), F.when(F.col("id") < 1500, 6.0).otherwise(8.0).alias("x"), F.lit(5.0).alias("y"))
    m = match_points(preds, refs, 4.0)
    assert m.count() == 2000 == m.select("pred_id").distinct().count() == m.select("ref_id").distinct().count()
    assert m.agg(F.sum("distance")).first()[0] == pytest.approx(1500 * 1 + 500 * 3)


def test_nearest_first_is_not_enough(spark):
    """Taking the nearest pair first would leave one point alone."""
    m = match_points(*frames(spark, {0: ([(0, 0, 0), (1, 6, 0)], [(0, 4, 0), (1, 12, 0)])}), 6.0)
    assert m.count() == 2


def test_scored_curve(spark):
    """Six detections, four references: three matches and an AP of 13/24."""
    pts = [(0.9, 0), (0.8, 500), (0.7, 100), (0.6, 600), (0.5, 200), (0.4, 700)]
    preds = spark.createDataFrame([(0, i, float(x), 0.0, c) for i, (c, x) in enumerate(pts)], "page_id long, pred_id long, x double, y double, confidence double")
    refs = spark.createDataFrame([(0, i, float(x), 0.0) for i, x in enumerate((0, 100, 200, 300))], "page_id long, ref_id long, x double, y double")
    curve = curves.pr_curve(preds, refs, 10.0)
    last = curve.orderBy("confidence").first()
    assert (last["tp"], last["fp"], last["fn"]) == (3, 3, 1)
    want = (1.0 + 2 / 3 + 3 / 5) / 4
    assert curves.interpolated_ap(curve).first()["ap"] == pytest.approx(want)


def test_curve_equals_rematch_at_every_threshold(spark):
    pages = random_pages(5, pages=12, size=7)
    preds, refs = frames(spark, pages)
    preds = preds.withColumn("confidence", F.round((F.col("pred_id") * 37 + F.col("page_id") * 11) % 10 / 10, 1))
    conf = {(r["page_id"], r["pred_id"]): r["confidence"] for r in preds.collect()}
    got = {r["confidence"]: r["tp"] for r in curves.pr_curve(preds, refs, 4.0).collect()}
    for t, tp in got.items():
        assert tp == sum(brute([p for p in ps if conf[g, p[0]] >= t], rs, 4.0)[0] for g, (ps, rs) in pages.items())


def test_missing_confidence_has_no_curve(spark):
    preds = spark.createDataFrame([(0, 0, 0.0, 0.0, None), (0, 1, 1.0, 0.0, 0.5)], "page_id long, pred_id long, x double, y double, confidence double")
    refs = spark.createDataFrame([(0, 0, 0.0, 0.0)], "page_id long, ref_id long, x double, y double")
    assert curves.pr_curve(preds, refs, 3.0).count() == 0


def test_grid_join_equals_all_pairs(spark):
    preds, refs = frames(spark, random_pages(6, pages=6, size=30, span=200))
    preds = preds.withColumn("tol", (F.col("pred_id") % 5 * 7).cast("double"))
    got = {(r["page_id"], r["pred_id"], r["ref_id"]) for r in eligible_pairs(preds, refs).collect()}
    p, r = preds.collect(), refs.collect()
    assert got == {(a["page_id"], a["pred_id"], b["ref_id"]) for a, b in itertools.product(p, r)
                   if a["page_id"] == b["page_id"] and math.hypot(a["x"] - b["x"], a["y"] - b["y"]) <= a["tol"]}


def test_components_on_long_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1001 + i) for i in range(200)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain + star, "src long, dst long")).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[1000 + i] == 1000 for i in range(201))


def test_capacity_solver_against_unit_solver():
    rnd = random.Random(9)
    for _ in range(60):
        p, r = range(rnd.randint(1, 3)), range(rnd.randint(1, 3))
        edges = [(a, b, rnd.randint(1, 9)) for a in p for b in r if rnd.random() < 0.7]
        if not edges:
            continue
        cap_p, cap_r = {a: rnd.randint(1, 3) for a in p}, {b: rnd.randint(1, 3) for b in r}
        used_p, used_r = {e[0] for e in edges}, {e[1] for e in edges}
        flow = assign_component([e[0] for e in edges], [e[1] for e in edges], [float(e[2]) for e in edges], {k: cap_p[k] for k in used_p}, {k: cap_r[k] for k in used_r})
        unit = [((a, i), (b, j), float(d)) for a, b, d in edges for i in range(cap_p[a]) for j in range(cap_r[b])]
        one = assign_component([u[0] for u in unit], [u[1] for u in unit], [u[2] for u in unit], {u[0]: 1 for u in unit}, {u[1]: 1 for u in unit})
        assert sum(flow) == sum(one)
        assert sum(f * e[2] for f, e in zip(flow, edges)) == pytest.approx(sum(f * u[2] for f, u in zip(one, unit)))
        adj = {}
        for a, b, _d in edges:
            adj.setdefault(a, []).append(b)
        gains = gains_in_order(sorted(adj), adj, {k: cap_p[k] for k in adj}, {k: cap_r[k] for k in used_r})
        assert sum(gains.values()) == sum(flow)


def test_a_large_component_is_solved_and_stops_no_other():
    n = 200_001
    star = pd.DataFrame({"comp": "a", "page_id": 1, "pred_id": 1, "ref_id": range(n), "distance": [float(abs(i - 777)) for i in range(n)], "confidence": 0.5, "pn": 1, "rn": 1})
    other = star[:2].assign(comp="b", page_id=2)
    parts = [star[:90_000], star[90_000:], other]
    got = pd.concat(_assign_batches(iter(parts)))
    assert sorted(zip(got["page_id"], got["ref_id"], got["flow"])) == [(1, 777, 1), (2, 1, 1)]
    gains = pd.concat(_gain_batches(iter(parts)))
    assert sorted(zip(gains["page_id"], gains["gain"])) == [(1, 1), (2, 1)]


def test_gains_per_page_sum_to_matching(spark):
    preds, refs = frames(spark, random_pages(11, size=8))
    preds = preds.withColumn("confidence", F.col("pred_id") / 10)
    assert matching_gains(preds, refs, 4.0).agg(F.sum("gain")).first()[0] == match_points(preds, refs, 4.0).count()


@pytest.fixture
def small_tables(spark, tmp_path):
    n = F.col("id")
    line = spark.range(240).select((n % 4).alias("l_suppkey"), n.alias("l_orderkey"), (n % 5).alias("l_linenumber"), (n % 37).alias("l_partkey"),
                                   F.lit("A").alias("l_returnflag"), F.lit("F").alias("l_linestatus"))
    supplier = spark.range(4).select(n.alias("s_suppkey"), (n % 2).alias("s_nationkey"), n.cast("double").alias("s_acctbal"))
    tables = {"lineitem": line, "supplier": supplier, "nation": spark.range(2).select(n.alias("n_nationkey"), F.lit(0).cast("long").alias("n_regionkey")),
              "region": spark.range(1).select(n.alias("r_regionkey"), F.lit("R").alias("r_name"))}
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name", ["localization_by_document", "explain_errors", "mode_summary"])
def test_points_are_derived_once(spark, small_tables, name):
    from markset.fixtures import Tables
    from markset.plans import load_all
    from markset.plans.registry import QUERIES

    load_all()
    files = QUERIES[name](Tables(spark, small_tables)).inputFiles()
    assert not [f for f in files if "lineitem" in f]
