"""Sizes, nested blocks and learned judgement of a whole set against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from markset.operators import primitives as P
from markset.operators import setscan as S

SHAPES = {"L": [((0, 0), (18, 0)), ((18, 0), (18, 12)), ((18, 12), (0, 0))], "T": [((-12, -8), (12, -8)), ((0, -8), (0, 14)), ((0, 14), (9, 2))]}


def line(a, b):
    pts = [(a[0] + (b[0] - a[0]) * k / 3, a[1] + (b[1] - a[1]) * k / 3) for k in range(4)]
    return [float(v) for p in pts for v in p]


def drawn(spark, symbols):
    """Primitives of ``(page, shape, x, y, size)``."""
    rows = []
    for page, shape, x, y, f in symbols:
        for a, b in SHAPES[shape]:
            c = line((x + f * a[0], y + f * a[1]), (x + f * b[0], y + f * b[1]))
            rows.append((page, len(rows), 0, *c, min(c[::2]), min(c[1::2]), max(c[::2]), max(c[1::2])))
    return spark.createDataFrame(rows, "page_id long, prim_id long, kind int, " + ", ".join(f"{c} double" for c in (*P.CTRL, "x0", "y0", "x1", "y1")))


@pytest.fixture(scope="module")
def parts(spark):
    rows = [(k, i, 0, *line(a, b)) for k, ps in SHAPES.items() for i, (a, b) in enumerate(ps)]
    return spark.createDataFrame(rows, "exemplar_id string, part_no int, kind int, " + ", ".join(f"{c} double" for c in P.CTRL))


@pytest.fixture(scope="module")
def legend(spark):
    return spark.createDataFrame([("L", "TL", 1, False, 1.0, None), ("T", "TT", 2, False, 1.0, None)], "exemplar_id string, tag string, legend_order int, needs_label boolean, detail double, label string")


def test_scale_range(spark):
    rng = random.Random(1)
    rows = [(round(rng.uniform(0.2, 3), 3), round(rng.uniform(0.2, 4.2), 3), rng.choice([1.0, 1.001, 1.04, 1.3, 2.0, 2.1])) for _ in range(300)] + [(1.0, 1.0, 1.04), (0.5, 1.0, 1.04), (0.25, 4.0, 1.04), (None, 1.0, 1.04), (1.0, float("nan"), 1.04)]
    got = spark.createDataFrame(rows, "low double, high double, step double").select("low", "high", "step", S.scale_range(F.col("low"), F.col("high"), F.col("step")).alias("r")).collect()
    for r in got:
        low, high, step = r["low"], r["high"], r["step"]
        if low is None or math.isnan(high) or not 0.25 <= low <= high <= 4 or not 1.001 <= step <= 2:
            assert r["r"] is None
            continue
        ends = [(low, high)] if high <= 1 or low >= 1 else [(low, 1.0), (1.0, high)]
        assert r["r"][0] == round(low, 4) and r["r"][-1] == round(high, 4) and r["r"] == sorted(set(r["r"]))
        assert not low <= 1 <= high or 1.0 in r["r"]
        assert all(b / a <= step * 1.001 for a, b in zip(r["r"], r["r"][1:]))
        assert len(r["r"]) == 1 + sum(max(1, math.ceil(math.log(b / a) / math.log(step) - 1e-9)) for a, b in ends if a < b)


def test_symbols_of_other_sizes_are_found_at_the_size_of_most_matches(spark, parts, legend):
    rng = random.Random(2)
    # sizes of such small drawings are told apart when they are not close to each other
    factors = (0.5, 4 / 3, 2.0)
    symbols = [(p, "L", 100 + 120 * i, 100 + 150 * p, 2.0) for p in range(4) for i in range(rng.randint(1, 4))]
    symbols += [(p, "L", 100 + 120 * i, 900, 4 / 3) for p in (4, 5) for i in range(9)]  # more of them, but later than three sheets
    symbols += [(p, "T", 150 + 90 * i, 1200, 4 / 3) for p in range(2, 5) for i in range(3)] + [(2, "T", 900, 1400, 2.0)]
    prim = drawn(spark, symbols)
    tally = []
    for f in factors:  # one pass a size, as a brute-force tally
        grown = parts.select("exemplar_id", "part_no", "kind", *[(F.col(c) * f).alias(c) for c in P.CTRL])
        tally += [(r["exemplar_id"], r["page_id"], f) for r in P.match_paths(prim, grown).collect()]
    want = {}
    for shape in SHAPES:
        pages = sorted({p for s, p, _ in tally if s == shape})[:3]
        n = {f: sum(1 for t in tally if t[0] == shape and t[1] <= pages[-1] and t[2] == f) for f in factors}
        want[shape] = max(n, key=lambda f: (n[f], -round(abs(math.log(f)), 12), f))
    assert want == {"L": 2.0, "T": 4 / 3}
    got = S.scan_sheets(prim, parts, legend, factors=factors)
    assert {r["exemplar_id"]: r["scale"] for r in got["scales"].collect()} == want
    count = {(r["sheet"], r["tag"]): r["n"] for r in got["counts"].collect()}
    assert count["all", "TL"] == sum(s[1] == "L" and s[4] == 2.0 for s in symbols) and count["all", "TT"] == sum(s[1] == "T" and s[4] == 4 / 3 for s in symbols)


def test_nested_blocks(spark, parts, legend):
    rng = random.Random(3)
    quarter = [(1, 0, 0, 1), (0, -1, 1, 0), (-1, 0, 0, -1), (-1, 0, 0, 1)]
    at = lambda: (*(float(rng.choice([0.5, 1, 2]) * v) for v in rng.choice(quarter)), float(rng.randint(-50, 50)), float(rng.randint(-50, 50)))
    uses = [("a", 0, "b", *at()), ("a", 1, "b", *at()), ("a", 2, "c", *at()), ("b", 0, "c", *at()), ("b", 1, "d", *at()), ("c", 0, "d", *at())]
    placed = [(i % 2, i, rng.choice("abcd"), *at()) for i in range(12)]
    cols = ", ".join(f"{c} double" for c in S.PLACED)
    u, p = spark.createDataFrame(uses, f"group_key string, use_no long, child_key string, {cols}"), spark.createDataFrame(placed, f"page_id long, placement_id long, group_key string, {cols}")

    def walk(page, no, path, key, m):
        yield page, no, path, key, len(path), m
        for parent, use_no, child, *v in uses:
            if parent == key:
                a, b, c, d, x, y = m
                e, f, g, h, s, t = v
                yield from walk(page, no, (*path, use_no), child, (a * e + b * g, a * f + b * h, c * e + d * g, c * f + d * h, a * s + b * t + x, c * s + d * t + y))

    want = {r[:5]: r[5] for q in placed for r in walk(*q[:2], (), q[2], q[3:])}
    blocks = S.place_blocks(p, u)
    got = {(r["page_id"], r["placement_id"], tuple(r["path"]), r["group_key"], r["depth"]): tuple(r[c] for c in S.PLACED) for r in blocks.collect()}
    assert got.keys() == want.keys() and all(max(abs(a - b) for a, b in zip(got[k], want[k])) < 1e-9 for k in got)
    with pytest.raises(ValueError):
        S.place_blocks(p, u.unionByName(spark.createDataFrame([("d", 0, "a", *at())], u.schema))).count()
    assert S.place_blocks(p.limit(0), u).count() == 0


def test_blocks_count_on_sheets_that_place_them(spark, parts, legend):
    cols = ", ".join(f"{c} double" for c in S.PLACED)
    uses = spark.createDataFrame([("outer", 0, "blk", 1.0, 0.0, 0.0, 1.0, 200.0, 0.0), ("outer", 1, "mid", 0.0, -1.0, 1.0, 0.0, 0.0, 200.0), ("mid", 0, "blk", 2.0, 0.0, 0.0, 2.0, 40.0, 40.0)], f"group_key string, use_no long, child_key string, {cols}")
    placed = spark.createDataFrame([(1, 1, "outer", 1.0, 0.0, 0.0, 1.0, 500.0, 500.0), (1, 2, "blk", 1.0, 0.0, 0.0, 1.0, 50.0, 50.0)], f"page_id long, placement_id long, group_key string, {cols}")
    blocks = S.block_boxes(S.place_blocks(placed, uses), spark.createDataFrame([("blk", 0.0, 0.0, 18.0, 12.0)], "group_key string, bx0 double, by0 double, bx1 double, by1 double"))
    refs = spark.createDataFrame([("L", "blk", 1.0, 0.0, 0.0, 1.0)], "exemplar_id string, group_key string, r11 double, r12 double, r21 double, r22 double")
    prim = drawn(spark, [(1, "L", 900, 900, 1.0), (2, "L", 100, 100, 1.0), (2, "T", 300, 300, 1.0)])
    got = S.scan_sheets(prim, parts, legend, blocks=blocks, block_refs=refs)
    assert {(r["sheet"], r["tag"]): r["n"] for r in got["counts"].collect()} == {("1", "TL"): 3, ("2", "TL"): 1, ("2", "TT"): 1, ("all", "TL"): 4, ("all", "TT"): 1}
    inner = [r for r in got["detections"].collect() if r["page_id"] == 1 and r["rotation"] == 90]
    assert len(inner) == 1 and abs(inner[0]["scale"] - 2) < 1e-9 and (inner[0]["x0"], inner[0]["y1"]) == (500 - 40 - 24, 500 + 200 + 40 + 36)


def test_learned_verdicts_and_variants(spark):
    box = "page_id long, box_id long, tag string, source string, score double, x0 double, y0 double, x1 double, y1 double"
    found = spark.createDataFrame([(1, 1, "A", "vector", 0.9, 0.0, 0.0, 20.0, 20.0), (1, 2, "A", "vector", 0.95, 100.0, 0.0, 120.0, 20.0), (1, 3, "B", "vector", 1.0, 200.0, 0.0, 220.0, 20.0)], box)
    verdicts = spark.createDataFrame([(1, 1, False), (1, 2, True), (1, 9, False)], "page_id long, box_id long, accept boolean")
    new = spark.createDataFrame([(1, 11, "A", "?", 0.8, 104.0, 0.0, 124.0, 20.0),  # on a match that stays
                                 (1, 12, "A", "?", 0.8, 2.0, 0.0, 22.0, 20.0), (1, 13, "A", "?", 0.7, 8.0, 0.0, 28.0, 20.0), (1, 14, "A", "?", 0.6, 16.0, 0.0, 36.0, 20.0),  # a chain: the middle one goes
                                 (2, 15, "A", "?", 0.5, 0.0, 0.0, 0.0, 0.0), (2, 16, "A", "?", 0.5, 0.5, 0.0, 0.5, 0.0)], box)
    out, stats = S.apply_learned(found, verdicts, new)
    assert {(r["box_id"], r["source"]) for r in out.collect()} == {(2, "vector"), (3, "vector"), (12, "learned"), (14, "learned"), (15, "learned")}
    assert {tuple(r) for r in stats.collect()} == {(1, "A", 1, 2), (2, "A", 0, 1)}
    out, stats = S.apply_learned(found, verdicts)
    assert {r["box_id"] for r in out.collect()} == {2, 3} and {tuple(r) for r in stats.collect()} == {(1, "A", 1, 0)}
