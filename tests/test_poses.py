import pytest
from pyspark.sql import functions as F

from markset.functions import geometry as G
from markset.operators import primitives as P

PARTS = [(0, 0, -15.0, -10.0, -5.0, -10.0, 5.0, -10.0, 15.0, -10.0), (1, 0, 15.0, -10.0, 15.0, -3.3, 15.0, 3.3, 15.0, 10.0), (2, 1, 15.0, 10.0, 9.0, 3.0, -5.0, -3.3, -15.0, -10.0)]


@pytest.fixture(scope="module")
def sheets(spark, tmp_path_factory):
    """A drawing on a sheet for each pose, in files far smaller than the cells of their ink; and its parts."""
    rows = []
    for i, (_, _, a, b, c, d) in enumerate(G.POSES):
        for no, kind, *v in PARTS:
            xy = [(100.0 + a * x + b * y, 200.0 + c * x + d * y) for x, y in zip(v[::2], v[1::2])]
            xs, ys = zip(*xy)
            rows.append((i, no, kind, *[k for p in xy for k in p], min(xs), min(ys), max(xs), max(ys)))
    at = str(tmp_path_factory.mktemp("sheets"))
    spark.createDataFrame(rows, "page_id long, prim_id long, kind int, " + ", ".join(f"{c} double" for c in (*P.CTRL, "x0", "y0", "x1", "y1"))).write.parquet(f"{at}/prim")
    spark.createDataFrame([("A", *p) for p in PARTS], "exemplar_id string, part_no int, kind int, " + ", ".join(f"{c} double" for c in P.CTRL)).write.parquet(f"{at}/parts")
    return spark.read.parquet(f"{at}/prim"), spark.read.parquet(f"{at}/parts")


def test_hypotheses_hold_every_pose_and_are_spread(sheets, capsys):
    got = P.pose_hypotheses(*sheets)
    found = {(r["page_id"], r["pose"]) for r in got.where((F.abs(F.col("tx") - 100) < 0.1) & (F.abs(F.col("ty") - 200) < 0.1)).collect()}
    assert {(i, i) for i in range(8)} <= found
    got.explain()
    assert "REPARTITION_BY_NUM" in capsys.readouterr().out


def test_ink_is_not_broadcast(sheets, capsys):
    prim, parts = sheets
    ex = P.exemplar_table(parts)
    poses = P.pose_hypotheses(prim, parts)
    kept = P.coarse_filter(poses.persist(), prim, ex)
    kept.explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin [page_id" in plan and "LeftSemi" in plan
    assert not [x for x in plan.splitlines() if "BroadcastHashJoin" in x and "LeftSemi" in x]
    assert {(r["page_id"], r["pose"]) for r in kept.collect()} >= {(i, i) for i in range(8)}


def test_scored_poses_do_not_repeat_the_drawing(sheets, monkeypatch):
    prim, parts = sheets
    written, write = {}, P.materialize
    monkeypatch.setattr(P, "materialize", lambda df, name="step": written.setdefault(name, df.columns) and write(df, name))
    ex = P.exemplar_table(parts)
    best = P.score_poses(P.coarse_filter(P.pose_hypotheses(prim, parts), prim, ex), prim, ex)
    assert {(r["page_id"], r["pose"]) for r in best.where("score > 0.999").collect()} == {(i, i) for i in range(8)}
    assert "pts" not in written["placed"] and "segs" not in written["placed"]


def lines_of(rows, at=(0.0, 0.0)):
    """Primitives ``(page_id, prim_id, kind, ...)`` with their boxes, moved to a place."""
    out = []
    for page, no, kind, *v in rows:
        xy = [(x + at[0], y + at[1]) for x, y in zip(v[::2], v[1::2])]
        xs, ys = zip(*xy)
        out.append((page, no, kind, *[k for p in xy for k in p], min(xs), min(ys), max(xs), max(ys)))
    return out


PRIMITIVE = "page_id long, prim_id long, kind int, " + ", ".join(f"{c} double" for c in (*P.CTRL, "x0", "y0", "x1", "y1"))
DRAWN = "exemplar_id string, part_no int, kind int, " + ", ".join(f"{c} double" for c in P.CTRL)


def test_a_drawing_that_is_part_of_another_is_found_in_it(spark):
    tail = (3, 0, 15.0, 10.0, 25.0, 20.0, 35.0, 30.0, 45.0, 40.0)
    parts = spark.createDataFrame([("A", *p) for p in PARTS] + [("B", *p) for p in (*PARTS, tail)], DRAWN)
    prim = spark.createDataFrame(lines_of([(1, *p) for p in (*PARTS, tail)], (100.0, 200.0)), PRIMITIVE)
    got = {(r["exemplar_id"], round(r["tx"]), round(r["ty"])) for r in P.match_paths(prim, parts).where("score > 0.999").collect()}
    assert got == {("A", 100, 200), ("B", 100, 200)}


def test_poses_and_ink_travel_once_a_tile(sheets, spark, monkeypatch):
    prim, parts = sheets
    ex, sent = P.exemplar_table(parts), []
    monkeypatch.setattr(P, "spread", lambda df, *cols: sent.append(df) or df.repartition(4, *cols))
    poses = P.pose_hypotheses(prim, parts).persist()
    sent.clear()
    assert P.coarse_filter(poses, prim, ex).count() >= 8
    zones, ink = sent
    assert zones.count() <= 4 * poses.count() and ink.count() <= 4 * prim.count()
    assert not {"pts", "segs"} & set(zones.columns)


def test_a_long_line_stands_in_the_tiles_along_it(sheets, spark, monkeypatch):
    _, parts = sheets
    side = 40 * P.TILE
    long_line = lines_of([(0, 0, 0, 0.0, 0.0, side / 3, side / 3, side * 2 / 3, side * 2 / 3, side, side)])
    drawn = lines_of([(0, 1 + i, *p[1:]) for i, p in enumerate(PARTS)], (2000.0, 2010.0))
    prim = spark.createDataFrame(long_line + drawn, PRIMITIVE)
    sent = []
    monkeypatch.setattr(P, "spread", lambda df, *cols: sent.append(df) or df.repartition(4, *cols))
    poses = spark.createDataFrame([(0, "A", 0, 1.0, 2000.0, 2010.0)], "page_id long, exemplar_id string, pose int, scale double, tx double, ty double")
    best = P.score_poses(poses, prim, P.exemplar_table(parts)).collect()
    assert len(best) == 1 and best[0]["score"] > 0.999
    assert sent[1].count() < 4 * 41 + 8


def test_scores_are_those_of_a_walk_over_all_points_and_lines(sheets, spark):
    """Coverage and unexplained ink by brute force, with points on a border of tiles and a stray line inside the box."""
    _, parts = sheets
    at = (P.TILE, P.TILE)
    stray = (0, 9, 0, P.TILE - 8, P.TILE - 6.0, P.TILE - 6, P.TILE - 6.0, P.TILE - 4, P.TILE - 5.0, P.TILE - 2, P.TILE - 5.0)
    prim = spark.createDataFrame(lines_of([(0, i, *p[1:]) for i, p in enumerate(PARTS[:1] + PARTS[2:])], at) + lines_of([stray]), PRIMITIVE)
    ex = P.exemplar_table(parts)
    poses = spark.createDataFrame([(0, "A", 0, 1.0, *at)], "page_id long, exemplar_id string, pose int, scale double, tx double, ty double")
    got = P.score_poses(poses, prim, ex, threshold=0.1).collect()[0]
    e = ex.collect()[0]

    def cubic(v, t):
        w = ((1 - t) ** 3, 3 * (1 - t) ** 2 * t, 3 * (1 - t) * t * t, t**3)
        return sum(a * b for a, b in zip(w, v[::2])), sum(a * b for a, b in zip(w, v[1::2]))

    def gap(p, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        t = max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / max(dx * dx + dy * dy, 1e-12)))
        return ((p[0] - a[0] - t * dx) ** 2 + (p[1] - a[1] - t * dy) ** 2) ** 0.5

    def pieces(v, kind):
        n = 12 if kind else 1
        ends = [cubic(v, i / n) for i in range(n + 1)]
        return list(zip(ends, ends[1:]))

    lines = [pieces([getattr(r, c) for c in P.CTRL], r.kind) for r in prim.collect()]
    on = [min(gap((p.x + at[0], p.y + at[1]), a, b) for line in lines for a, b in line) <= P.TOLERANCE for p in e.pts]
    assert got["coverage"] == pytest.approx(sum(on) / len(on)) and 0.3 < got["coverage"] < 0.95
    unexplained = sum(((b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2) ** 0.5 for a, b in lines[-1])
    assert got["score"] == pytest.approx(got["coverage"] * e.length / (e.length + unexplained))
