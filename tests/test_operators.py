import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from markset.functions import text as T
from markset.operators import calibrate, graph, legend, reviews, vectors
from markset.operators import running as running_of
from markset.operators.graph import greedy_keep
from markset.operators.primitives import resolve_spots
from markset.operators.running import dense_ids, percentiles, previous, running, spread_rank
from markset.operators.spatial import MEETING, box_conflicts, box_join, conflict_test, meeting_cells, present_levels


def boxes(seed, n=220, pages=3, span=260, copies=False):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        w, h = rnd.choice([(20, 20), (24, 18), (30, 40), (150, 120)]), None
        x, y = (rnd.choice([10, 40, 70]), 10) if copies else (rnd.randint(0, span), rnd.randint(0, span))
        out.append((rnd.randrange(pages), i, float(x), float(y), float(x + w[0]), float(y + w[1]), rnd.randint(0, 20) / 20))
    return out


def duplicate(a, b, iou_t, ratio):
    ix, iy = max(0, min(a[4], b[4]) - max(a[2], b[2])), max(0, min(a[5], b[5]) - max(a[3], b[3]))
    inter = ix * iy
    union = (a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - inter
    d = math.hypot((a[2] + a[4] - b[2] - b[4]) / 2, (a[3] + a[5] - b[3] - b[5]) / 2)
    return inter / union > iou_t or d < ratio * min(a[4] - a[2], a[5] - a[3], b[4] - b[2], b[5] - b[3])


def walk(rows, test):
    kept, leader = [], {}
    for a in sorted(rows, key=lambda r: (-r[6], r[3], r[2], r[1])):
        hit = next((k for k in kept if k[0] == a[0] and test(k, a)), None)
        if hit is None:
            kept.append(a)
        leader[a[1]] = (hit or a)[1]
    return {k[1] for k in kept}, leader


SCHEMA = "page_id long, box_id long, x0 double, y0 double, x1 double, y1 double, score double"
ORDER = lambda: [(-F.col("score")).alias("a"), F.col("y0").alias("b"), F.col("x0").alias("c")]


@pytest.mark.parametrize("seed,copies", [(1, False), (2, False), (3, True)])
def test_greedy_keep_equals_walk(spark, seed, copies):
    rows = boxes(seed, copies=copies)
    want, leader = walk(rows, lambda a, b: duplicate(a, b, 0.3, 0.5))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = greedy_keep(df, ORDER(), conflict_test(0.3, 0.5), leaders=True).collect()
    assert len(got) == len(rows)
    assert {r["box_id"] for r in got if r["kept"]} == want
    assert {r["box_id"]: r["leader_id"] for r in got} == leader


def test_greedy_keep_walks_what_rounds_leave(spark, monkeypatch):
    monkeypatch.setattr(graph, "GREEDY_ROUNDS", 1)
    rows = boxes(5) + [(7, 1000 + i, 10.0 * i, 0.0, 10.0 * i + 20, 20.0, 0.9) for i in range(300)]  # each box meets the next
    want, leader = walk(rows, lambda a, b: duplicate(a, b, 0.3, 0.5))
    got = greedy_keep(spark.createDataFrame(rows, SCHEMA), ORDER(), conflict_test(0.3, 0.5), leaders=True).collect()
    assert len(got) == len(rows)
    assert {r["box_id"] for r in got if r["kept"]} == want
    assert {r["box_id"]: r["leader_id"] for r in got} == leader


def test_a_sheet_sized_box_makes_no_pairs_of_others(spark):
    rows = [(0, i, 30.0 * (i % 50), 30.0 * (i // 50), 30.0 * (i % 50) + 10, 30.0 * (i // 50) + 10, 0.5) for i in range(2000)]
    df = spark.createDataFrame([*rows, (0, 9999, 0.0, 0.0, 1500.0, 1500.0, 0.5)], SCHEMA).select("page_id", "box_id", "x0", "y0", "x1", "y1")
    a, b = meeting_cells(df, df.withColumnRenamed("box_id", "other"), [4, 12])
    met = a.join(b, MEETING)
    assert 2000 * 2 < met.count() < 2000 * 20
    assert met.where("box_id = 9999 and other <> 9999").select("other").distinct().count() == 2000


def test_box_conflicts_equal_all_pairs(spark):
    rows = boxes(4)
    got = {(r["a_id"], r["b_id"]) for r in box_conflicts(spark.createDataFrame(rows, SCHEMA), 0.2, 0.5).collect()}
    assert got == {(a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and a[0] == b[0] and duplicate(a, b, 0.2, 0.5)}


def test_resolve_spots(spark):
    cols = "page_id long, box_id long, tag string, legend_order int, needs_label boolean, label string, detail double, source string, score double, x0 double, y0 double, x1 double, y1 double"
    c = spark.createDataFrame([
        (0, 1, "A", 0, False, None, 1.0, "vector", 0.95, 0.0, 0.0, 20.0, 20.0), (0, 2, "B", 1, True, "GFI", 1.0, "vector", 0.93, 2.0, 0.0, 22.0, 20.0),
        (0, 3, "B", 1, True, None, 1.0, "vector", 0.99, 200.0, 0.0, 220.0, 20.0), (0, 4, "A", 0, False, None, 1.0, "vector", 0.95, 300.0, 0.0, 320.0, 20.0),
        (0, 5, "C", 2, False, None, 2.0, "vector", 0.80, 301.0, 0.0, 321.0, 20.0)], cols)
    text = spark.createDataFrame([(0,)], "page_id long")
    kept, dropped = resolve_spots(c, text)
    assert {r["box_id"] for r in kept.collect()} == {2, 4}  # the label wins; too weak a rival loses
    assert {r["tag"]: r["dropped"] for r in dropped.collect()} == {"A": 1, "B": 1, "C": 1}
    kept, _ = resolve_spots(c)
    assert 3 in {r["box_id"] for r in kept.collect()}  # no text on the page, no label gate


@pytest.mark.parametrize("limit", [10_000, 5])
def test_running_is_the_same_in_one_window_and_in_ranges(spark, limit):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), (F.col("id") * 7 % 500).cast("double").alias("k"), F.col("id").alias("v"))
    got = running(df, ["g"], "k", {"s": ("sum", "v"), "m": ("max", "v")}, descending=True, plain_limit=limit).collect()
    rows = df.collect()
    for r in got:
        up = [x["v"] for x in rows if x["g"] == r["g"] and x["k"] >= r["k"]]
        assert (r["s"], r["m"]) == (sum(up), max(up))


def test_percentiles_equal_numpy(spark):
    vals = [(i % 4, float(v)) for i, v in enumerate(np.random.default_rng(3).normal(size=400).round(2))]
    got = percentiles(spark.createDataFrame(vals, "g long, v double"), ["g"], "v", {"a": 0.5, "b": 0.95}).collect()
    for r in got:
        mine = [v for g, v in vals if g == r["g"]]
        assert (r["a"], r["b"]) == (pytest.approx(np.percentile(mine, 50)), pytest.approx(np.percentile(mine, 95)))


def test_previous_and_ids(spark):
    df = spark.range(300).select((F.col("id") % 2).alias("g"), F.col("id").alias("seq"), (F.col("id") * 3).cast("string").alias("v")).repartition(6)
    got = {r["seq"]: r["p"] for r in previous(df, ["g"], "seq", "v", "p", slices=16).collect()}
    assert got == {i: (str((i - 2) * 3) if i >= 2 else None) for i in range(300)}
    ids = dense_ids(df, ["seq"], "n").orderBy("seq").collect()
    assert [r["n"] for r in ids] == list(range(1, 301))
    ranks = spread_rank(df, ["g"], "seq").collect()
    assert sorted(r["rank"] for r in ranks if r["g"] == 0) == list(range(1, 151))


def test_ids_are_numbered_as_they_are_dealt(spark, capsys):
    dense_ids(spark.range(300).repartition(6), ["id"], "n").explain()
    plan = capsys.readouterr().out
    assert "hashpartitioning(_p" not in plan.split("BroadcastExchange")[0]  # only the sizes of the ranges are gathered


def small_file(spark, tmp_path, name, prefix=""):
    """Boxes in a file far smaller than the rows of their cells."""
    x, y = (F.col("id") % 20 * 30).cast("double"), (F.col("id") / 20).cast("long").cast("double") * 25
    df = spark.range(400).select((F.col("id") % 2).alias("page_id"), F.col("id").alias(f"{prefix}no"), x.alias("x0"), y.alias("y0"), (x + 28).alias("x1"), (y + 28).alias("y1"))
    df.write.parquet(str(tmp_path / name))
    return spark.read.parquet(str(tmp_path / name))


def test_box_join_does_not_broadcast_a_small_file(spark, tmp_path, capsys):
    a, b = small_file(spark, tmp_path, "a", "a_"), small_file(spark, tmp_path, "b", "b_")
    got = box_join(a, b)
    got.explain()
    assert "BroadcastHashJoin" not in capsys.readouterr().out
    plain = a.join(b.withColumnsRenamed({k: "r" + k for k in ("x0", "y0", "x1", "y1")}), "page_id").where("x0 <= rx1 AND x1 >= rx0 AND y0 <= ry1 AND y1 >= ry0")
    rows = lambda df: sorted((r["a_no"], r["b_no"]) for r in df.collect())
    assert rows(got) == rows(plain)


def test_reading_legends_broadcasts_no_pages(spark, capsys, monkeypatch):
    """Rows per page grow with the input: a small file of them must not be gathered in the driver."""
    keep = legend.materialize
    monkeypatch.setattr(legend, "materialize", lambda df, name: (df.explain(), keep(df, name))[1])
    lines, ink = [], []
    for page in range(3):
        lines += [(page, -3, "ELECTRICAL LEGEND", 100.0, 10.0, 400.0, 30.0), (page, -2, "SYMBOL", 100.0, 40.0, 180.0, 60.0), (page, -1, "DESCRIPTION", 300.0, 40.0, 460.0, 60.0)]
        lines += [(page, i, f"duplex outlet {i}, wall", 300.0, 80.0 + 28 * i, 500.0, 100.0 + 28 * i) for i in range(4)]
        ink += [(page, i, 110.0, 88.0 + 28 * i, 150.0, 92.0 + 28 * i) for i in range(4) if i != 2]
    sides = "x0 double, y0 double, x1 double, y1 double"
    got = legend.read_legend_entries(spark.createDataFrame(lines, f"page_id long, line_no long, text string, {sides}"), spark.createDataFrame(ink, f"page_id long, prim_id long, {sides}"))
    got.explain()
    assert "BroadcastExchange" not in capsys.readouterr().out
    assert {(r["legend_id"], r["entry_no"]) for r in got.collect()} == {(p, i) for p in range(3) for i in (0, 1, 3)}


def plans(monkeypatch, module):
    """The plans of what a module writes between its steps."""
    seen, keep = [], module.materialize
    monkeypatch.setattr(module, "materialize", lambda df, name="step": (seen.append((name, df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")))), keep(df, name))[1])
    return seen


def test_boxes_stand_only_where_the_other_side_can_meet_them(spark, tmp_path):
    small = small_file(spark, tmp_path, "d", "a_")
    large = small_file(spark, tmp_path, "e", "b_").withColumns({"x1": F.col("x0") + 90, "y1": F.col("y0") + 70})
    a, b = meeting_cells(large, small, present_levels(large), present_levels(small))
    # large boxes wait for visitors only, small ones visit only: a row a cell
    assert a.count() == a.select("b_no", "_lv", "_gx", "_gy").distinct().count() and {r[0] for r in b.select("_lv").distinct().collect()} == set(present_levels(large))
    plain = small.join(large.withColumnsRenamed({k: "r" + k for k in ("x0", "y0", "x1", "y1")}), "page_id").where("x0 <= rx1 AND x1 >= rx0 AND y0 <= ry1 AND y1 >= ry0")
    rows = lambda df: sorted((r["a_no"], r["b_no"]) for r in df.collect())
    assert rows(box_join(large, small)) == rows(box_join(small, large)) == rows(plain)


def test_overlapping_words_are_derived_once(spark, monkeypatch):
    from markset.operators import text

    seen = plans(monkeypatch, text)
    df = spark.createDataFrame([(0, 1, 0, 0.0, 0.0, 30.0, 12.0, 2.0), (0, 2, 90, 2.0, 0.0, 32.0, 12.0, 1.0)], "page_id long, word_id long, rotation int, x0 double, y0 double, x1 double, y1 double, evidence double")
    assert [r["word_id"] for r in text.merge_rotations(df, 0.4).collect()] == [1]
    assert "ExistingRDD" not in next(p for n, p in seen if n == "overlaps")


def test_labels_near_boxes_are_placed_from_written_rows(spark, monkeypatch):
    from markset.operators import text

    seen = plans(monkeypatch, text)
    sides = "x0 double, y0 double, x1 double, y1 double"
    boxes = spark.createDataFrame([(0, 1, "s", 0.0, 0.0, 20.0, 20.0), (0, 2, "s", 500.0, 0.0, 520.0, 20.0)], f"page_id long, box_id long, label_set string, {sides}")
    lines = spark.createDataFrame([(0, 1, "A1", 25.0, 5.0, 40.0, 15.0)], f"page_id long, line_no long, text string, {sides}")
    out = text.label_near(boxes, lines, spark.createDataFrame([("s", "A1")], "label_set string, label string"))
    assert {(r["box_id"], r["label"]) for r in out.collect()} == {(1, "A1"), (2, None)}
    assert [n for n, _ in seen] == ["around", "spots"]


def test_lines_travel_as_runs_of_words(spark):
    from markset.operators.text import assemble_lines

    rnd = random.Random(3)
    rows = [(p, n, w, None if (n + w) % 7 == 0 else f"w{w}", float(w), float(n), w + 1.0, n + 10.0 + w % 3, None if w == 2 else float(w)) for p in range(3) for n in range(6) for w in range(1, 9)]
    schema = "page_id long, line_no long, word_no long, text string, x0 double, y0 double, x1 double, y1 double, confidence double"
    for rows_now in (rows, rnd.sample(rows, len(rows))):
        got = assemble_lines(spark.createDataFrame(rows_now, schema).repartition(3) if rows_now is not rows else spark.createDataFrame(rows_now, schema), ["page_id", "line_no"])
        for r in got.collect():
            mine = [x for x in rows if x[:2] == (r["page_id"], r["line_no"])]
            assert (r["text"], r["n_words"]) == (" ".join(x[3] for x in mine if x[3]), 8)
            assert (r["x0"], r["y0"], r["x1"], r["y1"]) == (min(x[4] for x in mine), mine[0][5], max(x[6] for x in mine), max(x[7] for x in mine))
            assert r["height"] == sorted(x[7] - x[5] for x in mine)[4] and r["confidence"] == sum(x[8] for x in mine if x[8] is not None) / 7
    got = assemble_lines(spark.createDataFrame(rows, schema), ["page_id", "line_no"])
    plan = got._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "MapInArrow" in plan.split("Exchange", 1)[1] and "Aggregate" not in plan.split("Exchange", 1)[1]  # no aggregate sorts a row per word before the shuffle


def test_boxes_of_the_finest_class_are_placed_once_a_cell(spark, tmp_path):
    a = small_file(spark, tmp_path, "c")
    left, right = meeting_cells(a, a, present_levels(a))
    for side in (left, right):
        assert side.count() == side.select("page_id", "no", "_gx", "_gy").distinct().count()


def unit_vectors(n, d=8, seed=0):
    v = np.random.default_rng(seed).normal(size=(n, d))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_k_medoids_settles_on_central_medoids(spark):
    rows = [(g, i + 100 * g, [float(x) for x in v]) for g in range(2) for i, v in enumerate(unit_vectors(40, seed=g))]
    df = spark.createDataFrame(rows, "grp long, id long, vec array<double>")
    key = lambda out: {(r["grp"], r["id"]): r["medoid_id"] for r in out.collect()}
    got = key(vectors.k_medoids(df, 3))
    assert got == key(vectors.k_medoids(df.repartition(5), 3)) and len(got) == 80
    vec = {(g, i): np.array(v) for g, i, v in rows}
    for g in range(2):
        medoids = {m for (h, _), m in got.items() if h == g}
        assert len(medoids) == 3
        for i in range(100 * g, 100 * g + 40):
            assert vec[g, i] @ vec[g, got[g, i]] >= max(vec[g, i] @ vec[g, m] for m in medoids) - 1e-9
        for m in medoids:
            mine = [i for (h, i), n in got.items() if h == g and n == m]
            gain = {i: sum(vec[g, i] @ vec[g, j] for j in mine) for i in mine}
            assert m in mine and gain[m] >= max(gain.values()) - 1e-9


def test_k_medoids_refuses_to_stop_early(spark):
    rows = [(0, i, [float(x) for x in v]) for i, v in enumerate(unit_vectors(40, seed=1))]
    with pytest.raises(RuntimeError, match="settle"):
        vectors.k_medoids(spark.createDataFrame(rows, "grp long, id long, vec array<double>"), 3, max_rounds=0)


def rising_fit(y, w):
    return [max(min(np.average(y[j:k + 1], weights=w[j:k + 1]) for k in range(i, len(y))) for j in range(i + 1)) for i in range(len(y))]


@pytest.mark.parametrize(("together", "limit"), [(3, 10), (7, 10), (8192, 400_000)])
def test_isotonic_fit_by_stretches_equals_the_best_rising_fit(spark, together, limit, monkeypatch):
    monkeypatch.setattr(running_of.running, "__defaults__", (False, limit))
    rng = np.random.default_rng(together)
    rows = [("hot", float(rng.integers(0, 60)) / 8, int(rng.random() < 0.5)) for _ in range(200)] + [("up", k / 4, int(k > 12)) for k in range(25)] + [("down", k / 4, int(k < 12)) for k in range(25)]
    rows += [("one", 2.0, 1), (None, 1.0, 1), (None, 2.0, 0), ("none", None, 1), ("none", float("nan"), 1)]
    got = {(r["g"], r["score"]): r["fitted"] for r in calibrate.isotonic_fit(spark.createDataFrame(rows, "g string, score double, label int").repartition(3), ["g"], together).collect()}
    want = {}
    for g in ("hot", "up", "down", "one", None):
        at = sorted({x for k, x, _ in rows if k == g})
        labels = [[v for k, x, v in rows if (k, x) == (g, a)] for a in at]
        want |= {(g, a): v for a, v in zip(at, rising_fit([np.mean(v) for v in labels], [len(v) for v in labels]))}
    assert got == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}


def test_calibration_of_a_hot_group(spark):
    n = 300_000
    pairs = spark.range(n).select(F.lit(1).alias("g"), (F.col("id") / n + 1e6).alias("score"), (F.rand(3) < F.col("id") / n).cast("int").alias("label"))
    fit = calibrate.isotonic_fit(pairs, ["g"]).toPandas().sort_values("score")
    assert len(fit) == n and (fit["fitted"].diff().dropna() >= 0).all() and abs(fit["fitted"] - np.arange(n) / n).mean() < 0.02


def test_scores_between_and_outside_of_a_fit(spark):
    fit = spark.createDataFrame([("a", 1.0, 0.2), ("a", 3.0, 0.6), ("a", 4.0, 0.6), ("b", 0.0, 0.5)], "g string, score double, fitted double")
    x = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("a", 1.0), ("a", 2.0), ("a", 3.5), ("a", 9.0), ("b", -1.0), ("b", 1.0), ("c", 1.0), ("a", None)], "g string, score double")
    got = sorted((r["g"], r["score"] is None, r["score"] or 0.0, None if r["p"] is None else round(r["p"], 9)) for r in calibrate.calibrated(x, fit, ["g"]).collect())
    assert got == [("a", False, 0.0, 0.2), ("a", False, 1.0, 0.2), ("a", False, 1.0, 0.2), ("a", False, 2.0, 0.4), ("a", False, 3.5, 0.6), ("a", False, 9.0, 0.6), ("a", True, 0.0, None),
                   ("b", False, -1.0, 0.5), ("b", False, 1.0, 0.5), ("c", False, 1.0, None)]
    assert {tuple(r) for r in calibrate.calibration_steps(fit, ["g"]).collect()} == {("a", 0.2, 1.0, 1.0), ("a", 0.6, 3.0, 4.0), ("b", 0.5, 0.0, 0.0)}


def test_template_bank_covers_every_member(spark):
    rows = [(0, i, [float(x) for x in v], i == 0) for i, v in enumerate(unit_vectors(12, d=3, seed=4))]
    bank = vectors.template_bank(spark.createDataFrame(rows, "grp long, id long, vec array<double>, is_original boolean"), min_similarity=0.5).orderBy("position").collect()
    assert bank[0]["is_original"] and bank[0]["template_id"] == 0
    assert sum(r["support"] for r in bank) == 12
    assert len(bank) == 8 or min(r["min_member_similarity"] for r in bank) >= 0.5 - 1e-9


def test_nearest_blocks_equal_one_product(spark):
    u = unit_vectors(90, seed=7)
    df = spark.createDataFrame([(i, [float(x) for x in v], i % 2) for i, v in enumerate(u)], "id long, vec array<double>, label int")
    got = {r["id"]: [t["id"] for t in r["top"]] for r in vectors.nearest(df.select("id", "vec"), df, 5, block_rows=16).collect()}
    sims = np.round(u @ u.T, 9)
    for i in range(90):
        assert got[i] == sorted(range(90), key=lambda j: (-sims[i, j], j))[:5]


def test_negative_bank_keeps_few_or_medoids(spark):
    rows = [(0, i, [float(x) for x in v]) for i, v in enumerate(unit_vectors(5))] + [(1, 50 + i, [float(x) for x in v]) for i, v in enumerate(unit_vectors(30, seed=2))]
    bank = vectors.negative_bank(spark.createDataFrame(rows, "grp long, id long, vec array<double>"), keep=6).groupBy("grp").count().collect()
    assert {r["grp"]: r["count"] for r in bank} == {0: 5, 1: 6}


def nearest_of(q, t, k, by_part):
    out = {}
    for qi, qg, qp, v in q:
        sims = sorted((-round(float(np.dot(v, u)), 9), i, y) for i, g, p, u, y in t if g == qg and not (by_part and p == qp))
        side = lambda want: max((-s for s, _, y in sims if y == want), default=-math.inf)  # noqa: E731, B023
        out[qi] = ([(i, y) for _, i, y in sims[:k]], round(side(1), 8), round(side(0), 8))
    return out


@pytest.mark.parametrize("clustered", [True, False])
def test_balls_find_the_same_neighbours(spark, clustered):
    rng = np.random.default_rng(8)
    heads = rng.normal(size=(12, 16))
    v = (heads[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 16)) * 0.05 if clustered else rng.normal(size=(1500, 16)))
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    v[5], v[6], v[7] = v[4], v[4], 0.0  # ties and a zero vector
    t = [(i, "ab"[i % 7 == 0], i % 5, x.tolist(), int(i % 11 == 0)) for i, x in enumerate(v)]
    train = spark.createDataFrame(t, "id long, g string, part int, vec array<double>, label int")
    queries = spark.createDataFrame([(10_000 + i, "ab"[i % 2], i % 5, v[(i * 7) % 1500].tolist()) for i in range(400)] + [(99_999, "none", 0, v[0].tolist())], "id long, g string, part int, vec array<double>")
    want = nearest_of([tuple(r) for r in queries.where("g <> 'none'").collect()], t, 5, True)
    met = []
    got = vectors.nearest(queries, train, 5, ["g"], exclude_part=True, block_rows=24, met=met).collect()
    assert {r["id"]: ([(x["id"], x["label"]) for x in r["top"]], round(r["best_pos"], 8), round(r["best_neg"], 8)) for r in got} == want
    assert sum(met[:2]) <= met[2]


def test_balls_of_clusters_seldom_meet(spark):
    rng = np.random.default_rng(8)
    heads = rng.normal(size=(12, 16))
    v = heads[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 16)) * 0.05
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    train = spark.createDataFrame([(i, x.tolist(), i % 3) for i, x in enumerate(v)], "id long, vec array<double>, label int")
    met = []
    vectors.nearest(train.where("id % 3 = 0").drop("label"), train, 5, block_rows=24, met=met).count()
    assert sum(met[:2]) < 0.3 * met[2]


def test_training_blocks_travel_once_a_lot(spark, monkeypatch):
    """A training block is sent to a lot of queries once, however many of its blocks meet it, and ids beyond 2^53 stay whole."""
    from markset.operators import balls

    v = unit_vectors(300, seed=11)
    rows = [(i, x.tolist(), i % 2) for i, x in enumerate(v)]
    block = lambda a, z: spark.createDataFrame([((1 << 60) + a + 1, [r[0] for r in rows[a:z]], [r[2] for r in rows[a:z]], [f for r in rows[a:z] for f in r[1]])],
                                               "block_id long, id array<long>, label array<int>, flat array<double>")
    q, t = block(0, 50).unionByName(block(50, 100)), block(100, 200).unionByName(block(200, 300))
    pairs = q.select(F.col("block_id").alias("q_block")).crossJoin(t.select(F.col("block_id").alias("t_block")))
    sent = []
    monkeypatch.setattr(balls.F, "collect_list", lambda c, f=F.collect_list: sent.append(c) or f(c))
    got = {r["id"]: [x["id"] for x in r["top"]] for r in balls.meet_in_lots(pairs, q, t, 3, [], 1).collect()}
    assert sent == ["q_block"]
    sims = np.round(v[:100] @ v[100:].T, 9)
    assert got == {i: [100 + j for j in sorted(range(200), key=lambda j: (-sims[i, j], j))[:3]] for i in range(100)}


def test_isotonic_known_answer(spark):
    pairs = spark.createDataFrame([(0, 0.1, 0), (0, 0.2, 1), (0, 0.2, 0), (0, 0.3, 0), (0, 0.4, 1)], "g long, score double, label int")
    got = {r["score"]: r["fitted"] for r in calibrate.isotonic_fit(pairs, ["g"]).collect()}
    assert got == {0.1: 0.0, 0.2: pytest.approx(1 / 3), 0.3: pytest.approx(1 / 3), 0.4: 1.0}
    xs, ys = calibrate.isotonic_fit_global(pairs)
    at = spark.range(1).select(calibrate.interpolate(F.lit(0.05), list(xs), list(ys)).alias("lo"), calibrate.interpolate(F.lit(0.35), list(xs), list(ys)).alias("mid"), calibrate.interpolate(F.lit(9.0), list(xs), list(ys)).alias("hi")).first()
    assert (at["lo"], at["hi"]) == (0.0, 1.0) and at["mid"] == pytest.approx(2 / 3)


def test_pair_with_library_serial_choice(spark):
    e = spark.createDataFrame([("L", 1, "X", "generated", "RED BOLT LARGE", ["ff"]), ("L", 2, "Y", "generated", "RED BOLT SMALL", ["ff"]), ("L", 3, "Q", "tag_column", "OTHER", ["ff"])],
                              "legend_id string, entry_no long, tag string, tag_source string, description string, signatures array<string>")
    s = spark.createDataFrame([("L", 1, "A", "RED BOLT", ["ff"]), ("L", 2, "B", "RED BOLT SMALL ROUND", ["ff"]), ("L", 3, "Q", "NOTHING ALIKE", ["ff"])],
                              "legend_id string, saved_no long, tag string, description string, signatures array<string>")
    got = {r["entry_no"]: (r["saved_no"], r["stage"]) for r in legend.pair_with_library(e, s).collect()}
    assert got == {3: (3, 1), 1: (1, 2), 2: (2, 2)}


def test_replay_merge_and_duplicate_flag(spark):
    e = spark.createDataFrame([("L", 1, "a", "A", "read", "g", False, False, []), ("L", 2, "b", "B", "read", "g", True, False, []), ("L", 3, "c", "C", "read", "g", True, True, ["wrapped"])],
                              "legend_id string, entry_no long, name string, tag string, tag_source string, grp string, counted boolean, confirmed boolean, flags array<string>")
    ed = spark.createDataFrame([(1, "L", 2, "merge", "1"), (2, "L", 3, "set_tag", "a"), (3, "L", 3, "rename", "see")], "seq long, legend_id string, entry_no long, op string, value string")
    got = {r["entry_no"]: r for r in legend.replay_edits(e, ed).collect()}
    assert set(got) == {1, 3} and got[1]["counted"]
    assert got[3]["tag"] == "A" and got[3]["name"] == "see" and not got[3]["confirmed"] and "duplicate_tag" in got[3]["flags"]


def test_assign_tags_family_with_digits(spark):
    e = spark.createDataFrame([("L", 1, "alpha", None, ""), ("L", 2, "alpha", None, ""), ("L", 3, "a 2", None, ""), ("L", 4, "own", "A3", "tag_column")],
                              "legend_id string, entry_no long, name string, tag string, tag_source string")
    got = {r["entry_no"]: r["tag"] for r in legend.assign_tags(e).collect()}
    assert got == {1: "A", 2: "A2", 3: "A22", 4: "A3"}


def test_split_entry(spark):
    e = spark.createDataFrame([("L", 1, "D1", "tag_column", "DUPLEX (LEFT) / QUAD (RIGHT)", [[50.0, 0.0, 60.0, 9.0], [10.0, 0.0, 20.0, 9.0]])],
                              "legend_id string, entry_no long, tag string, tag_source string, description string, symbol_boxes array<array<double>>")
    got = [(r["piece"], r["description"], r["name"], r["tag"]) for r in legend.split_entry(e).orderBy("piece").collect()]
    assert got == [(1, "DUPLEX", "Duplex", "D1"), (2, "QUAD", "Quad", None)]


def test_text_functions(spark):
    row = spark.range(1).select(
        T.nice_name(F.lit("GFCI RECEPTACLE 20A, WEATHERPROOF")).alias("a"), T.nice_name(F.lit("")).alias("b"), T.guess_group(F.lit("Smoke detector")).alias("c"),
        T.split_tag_prefix(F.lit("D1 - Duplex outlet"))[0].alias("d"), T.split_tag_prefix(F.lit("D1 - Duplex outlet"))[1].alias("e"), T.parse_page_ranges(F.lit("1-3, 7,2")).alias("f"),
        T.parse_page_ranges(F.lit("3-1")).alias("g"), T.csv_cell(F.lit("=1+1")).alias("h"), T.parse_page_ranges(F.lit("x")).alias("i"), T.uuid5("6ba7b8119dad11d180b400c04fd430c8", F.lit("req-1")).alias("u")).first()
    assert (row["a"], row["b"], row["c"], row["d"], row["e"]) == ("GFCI receptacle 20A", "Symbol", "Fire alarm", "D1", "Duplex outlet")
    assert row["f"] == [0, 1, 2, 6] and row["g"] is None and row["i"] is None and row["h"] == "'=1+1"
    import uuid

    assert row["u"] == str(uuid.uuid5(uuid.NAMESPACE_URL, "req-1"))


def test_signature_similarity(spark):
    a, b = "ff" * 32, "f0" * 32
    row = spark.range(1).select(legend.signature_similarity(F.lit(a), F.lit(b)).alias("half"), legend.signature_similarity(F.lit("00" * 32), F.lit("00" * 32)).alias("blank"),
                                legend.signature_similarity(F.lit(""), F.lit(a)).alias("missing"), legend.signature_similarity(F.lit("ff"), F.lit(a)).alias("length")).first()
    assert (row["half"], row["blank"], row["missing"], row["length"]) == (0.5, 1.0, 0.0, 0.0)


def test_check_split_moves(spark):
    a = spark.createDataFrame([(1, "d", "test"), (2, "d", "train"), (3, "d", "val"), (4, "e", "train"), (5, "e", "test")], "seq long, document_id string, split string")
    assert [(r["seq"], r["before"]) for r in reviews.check_split_moves(a).collect()] == [(2, "test")]


def test_merge_rotations_equals_walk(spark):
    from markset.operators.text import merge_rotations

    rnd = random.Random(8)
    rows = [(0, i, 90 * rnd.randrange(2), float(x := rnd.randint(0, 120)), float(y := rnd.randint(0, 60)), float(x + 30), float(y + 12), float(rnd.randint(1, 40))) for i in range(60)]

    def share(a, b):
        iw, ih = min(a[5], b[5]) - max(a[3], b[3]), min(a[6], b[6]) - max(a[4], b[4])
        return iw * ih / (30 * 12) if iw > 0 and ih > 0 else 0.0

    kept = []
    for w in sorted(rows, key=lambda r: (-r[7], r[2], r[1])):
        if all(k[2] == w[2] or share(k, w) <= 0.4 for k in kept):
            kept.append(w)
    df = spark.createDataFrame(rows, "page_id long, word_id long, rotation int, x0 double, y0 double, x1 double, y1 double, evidence double")
    assert {r["word_id"] for r in merge_rotations(df, 0.4).collect()} == {k[1] for k in kept}


def test_symbol_signature_of_a_diagonal(spark):
    from markset.operators.legend import cells_to_signature
    from markset.operators.primitives import ink_cells

    line = [(0, 1, 0, 0.0, 0.0, 5.0, 5.0, 11.0, 11.0, 15.9, 15.9, 0.0, 0.0, 15.9, 15.9)]
    prim = spark.createDataFrame(line, "page_id long, prim_id long, kind int, c0x double, c0y double, c1x double, c1y double, c2x double, c2y double, c3x double, c3y double, x0 double, y0 double, x1 double, y1 double")
    box = spark.createDataFrame([(0, 7, 0.0, 0.0, 16.0, 16.0)], "page_id long, box_id long, x0 double, y0 double, x1 double, y1 double")
    sig = cells_to_signature(ink_cells(prim, box), ["page_id", "box_id"]).first()["signature"]
    bits = bin(int(sig, 16))[2:].zfill(256)
    assert len(sig) == 64 and {(i // 16, i % 16) for i, b in enumerate(bits) if b == "1"} == {(k, k) for k in range(16)}


def test_training_vectors_travel_a_dozen_times_for_a_million_queries():
    from markset.operators import balls

    assert balls.lots_of(1_000) == balls.lots_of(1_000_000) == balls.LOTS
    assert balls.lots_of(10 * balls.LOT_ROWS * balls.LOTS) == 10 * balls.LOTS


def test_resolve_spots_sends_each_candidate_once_a_step(spark, monkeypatch):
    """Candidates are read once, and boxes that nobody shares a cell with do not travel to meet others."""
    from markset.operators import graph as Gr
    from markset.operators import primitives as P

    rows = [(1, i, "T", 0, False, None, 0.0, "vector", 1.0 - i / 1000, 500.0 * i, 0.0, 500.0 * i + 30, 30.0) for i in range(20)]
    rows += [(1, 100 + i, "T", 0, False, "L" if i == 2 else None, 0.0, "vector", 0.9 - i / 1000, 20_000.0 + 8 * i, 0.0, 20_030.0 + 8 * i, 30.0) for i in range(4)]
    cands = spark.createDataFrame(rows, "page_id long, box_id long, tag string, legend_order int, needs_label boolean, label string, detail double, source string, score double, x0 double, y0 double, x1 double, y1 double")
    met, find, written, write = [], Gr._conflicts, [], P.materialize
    monkeypatch.setattr(Gr, "_conflicts", lambda others, kept, *a: met.append(kept.count()) or find(others, kept, *a))
    monkeypatch.setattr(P, "materialize", lambda df, name="step": written.append(name) or write(df, name))
    kept, dropped = P.resolve_spots(cands)
    # 100 leads 101 and 102 leads 103
    assert {r["box_id"] for r in kept.collect()} == {*range(20), 100, 102} and [r["dropped"] for r in dropped.collect()] == [2]
    assert max(met) <= 4 and "candidates" in written
