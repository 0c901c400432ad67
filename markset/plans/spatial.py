"""Spatial joins, components, greedy selection and box functions over the drawing pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from markset.fixtures import cte
from markset.functions import geometry as G
from markset.functions.geometry import tolerance_of
from markset.operators import spatial
from markset.operators.graph import connected_components, greedy_keep
from markset.plans.registry import query

TOL = 12.0

EDGES = """edges AS (SELECT d.page_id, d.det_id AS pred_id, r.ref_id, d.score AS confidence,
    sqrt((d.x-r.x)*(d.x-r.x)+(d.y-r.y)*(d.y-r.y)) AS distance, d.x-r.x AS dx, d.y-r.y AS dy
  FROM fx_detections d JOIN fx_references r ON d.page_id = r.page_id
   AND r.x BETWEEN d.x-12 AND d.x+12 AND r.y BETWEEN d.y-12 AND d.y+12
  WHERE sqrt((d.x-r.x)*(d.x-r.x)+(d.y-r.y)*(d.y-r.y)) <= 12)"""

BOX_IOU = """(CASE WHEN (a.x1-a.x0)*(a.y1-a.y0)+(b.x1-b.x0)*(b.y1-b.y0)
      - greatest(least(a.x1,b.x1)-greatest(a.x0,b.x0),0)*greatest(least(a.y1,b.y1)-greatest(a.y0,b.y0),0) > 0
    THEN greatest(least(a.x1,b.x1)-greatest(a.x0,b.x0),0)*greatest(least(a.y1,b.y1)-greatest(a.y0,b.y0),0)
      / ((a.x1-a.x0)*(a.y1-a.y0)+(b.x1-b.x0)*(b.y1-b.y0)
      - greatest(least(a.x1,b.x1)-greatest(a.x0,b.x0),0)*greatest(least(a.y1,b.y1)-greatest(a.y0,b.y0),0)) ELSE 0 END)"""

CONFLICT = f"""({BOX_IOU} > 0.3 OR
    sqrt(pow((a.x0+a.x1)/2-(b.x0+b.x1)/2,2)+pow((a.y0+a.y1)/2-(b.y0+b.y1)/2,2))
      < 0.5*least(a.x1-a.x0,a.y1-a.y0,b.x1-b.x0,b.y1-b.y0))"""
TOUCH = "a.x0<=b.x1 AND a.x1>=b.x0 AND a.y0<=b.y1 AND a.y1>=b.y0"


def preds_of(t):
    return t.fx_detections.select("page_id", F.col("det_id").alias("pred_id"), "x", "y", F.col("score").alias("confidence"))


def refs_of(t):
    return t.fx_references.select("page_id", "ref_id", "x", "y")


@query("eligible_pairs", "C1", cte("fx_detections", "fx_references") + f", {EDGES} SELECT page_id, pred_id, ref_id, round(distance,6) AS distance FROM edges")
def _(t):
    e = spatial.eligible_pairs(preds_of(t), refs_of(t), TOL)
    return e.select("page_id", "pred_id", "ref_id", F.round("distance", 6).alias("distance"))


@query("eligible_pairs_relative", "C1 H20", cte("fx_detections", "fx_references") + """
    SELECT d.page_id, d.det_id AS pred_id, r.ref_id, round(sqrt(pow(d.x-r.x,2)+pow(d.y-r.y,2)),6) AS distance
    FROM fx_detections d JOIN fx_references r ON d.page_id = r.page_id AND r.x BETWEEN d.x-40 AND d.x+40
    WHERE sqrt((d.x-r.x)*(d.x-r.x)+(d.y-r.y)*(d.y-r.y)) <= 0.5*least(d.w, d.h)""")
def _(t):
    p = t.fx_detections.select("page_id", F.col("det_id").alias("pred_id"), "x", "y", (0.5 * F.least("w", "h")).alias("tol"))
    e = spatial.eligible_pairs(p, refs_of(t))
    return e.select("page_id", "pred_id", "ref_id", F.round("distance", 6).alias("distance"))


@query("tolerance_of", "H20", cte("fx_detections") + """, b AS (SELECT det_id, CASE WHEN det_id % 7 <> 0 THEN w END AS w, CASE WHEN det_id % 11 <> 0 THEN h END AS h FROM fx_detections)
    SELECT det_id, round(CASE WHEN w IS NOT NULL AND h IS NOT NULL THEN 0.4::DOUBLE*least(w,h) ELSE 9.0 END, 6) AS with_fallback, round(CASE WHEN w IS NOT NULL AND h IS NOT NULL THEN 0.4::DOUBLE*least(w,h) END, 6) AS relative,
      CASE WHEN w IS NULL OR h IS NULL THEN 'no_box_for_relative' ELSE '' END AS problem FROM b""")
def _(t):
    w, h = F.when(F.col("det_id") % 7 != 0, F.col("w")), F.when(F.col("det_id") % 11 != 0, F.col("h"))
    (both, _), (rel, problem) = tolerance_of(w, h, 0.4, 9.0), tolerance_of(w, h, 0.4, None)
    return t.fx_detections.select("det_id", F.round(both, 6).alias("with_fallback"), F.round(rel, 6).alias("relative"), F.coalesce(problem, F.lit("")).alias("problem"))


@query("eligible_components", "C3", cte("fx_detections", "fx_references", recursive=True) + f""", {EDGES},
    links AS (SELECT page_id, pred_id AS a, -ref_id-1 AS b FROM edges UNION ALL SELECT page_id, -ref_id-1, pred_id FROM edges),
    reach AS (SELECT page_id, a, b FROM links UNION SELECT r.page_id, r.a, l.b FROM reach r JOIN links l ON l.page_id=r.page_id AND l.a=r.b)
    SELECT page_id, a AS node, min(b) AS component, count(*) AS size FROM reach GROUP BY page_id, a""")
def _(t):
    e = spatial.eligible_pairs(preds_of(t), refs_of(t), TOL)
    node = lambda v: F.struct("page_id", v.alias("id"))
    comps = connected_components(e.select(node(F.col("pred_id")).alias("src"), node(-F.col("ref_id") - 1).alias("dst")))
    sizes = comps.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return comps.join(sizes, "component").select("node.page_id", F.col("node.id").alias("node"), F.col("component.id").alias("component"), "size")


@query("box_conflicts", "C4 H1", cte("fx_boxes") + f"""
    SELECT a.page_id, a.box_id AS a_id, b.box_id AS b_id, round({BOX_IOU},6) AS iou
    FROM fx_boxes a JOIN fx_boxes b ON a.page_id=b.page_id AND a.box_id<b.box_id AND {TOUCH} WHERE {CONFLICT}""")
def _(t):
    c = spatial.box_conflicts(t.fx_boxes, 0.3, 0.5)
    return c.withColumn("iou", F.round("iou", 6))


RECTS = """rects AS (SELECT page_id, ref_id AS rect_id, x-60 AS x0, y-30 AS y0, x+60 AS x1, y+30 AS y1 FROM fx_references)"""


def _rects(t):
    return t.fx_references.select("page_id", F.col("ref_id").alias("rect_id"), (F.col("x") - 60).alias("x0"),
                                  (F.col("y") - 30).alias("y0"), (F.col("x") + 60).alias("x1"), (F.col("y") + 30).alias("y1"))


@query("box_range_join", "C5", cte("fx_boxes", "fx_references") + f""", {RECTS}
    SELECT a.page_id, a.rect_id, count(*) AS n, max(b.box_id) AS last_box FROM rects a JOIN fx_boxes b ON a.page_id=b.page_id AND {TOUCH}
    GROUP BY a.page_id, a.rect_id""")
def _(t):
    j = spatial.range_join(_rects(t), t.fx_boxes.select("page_id", "box_id", *G.box_cols()))
    return j.groupBy("page_id", "rect_id").agg(F.count(F.lit(1)).alias("n"), F.max("box_id").alias("last_box"))


@query("box_center_in_rect", "C5", cte("fx_boxes", "fx_references") + f""", {RECTS}
    SELECT a.page_id, a.rect_id, b.box_id FROM rects a JOIN fx_boxes b ON a.page_id=b.page_id AND {TOUCH}
    WHERE (b.x0+b.x1)/2 BETWEEN a.x0 AND a.x1 AND (b.y0+b.y1)/2 BETWEEN a.y0 AND a.y1""")
def _(t):
    j = spatial.range_join(_rects(t), t.fx_boxes.select("page_id", "box_id", *G.box_cols()), center_only=True)
    return j.select("page_id", "rect_id", "box_id")



def suppressed(t):
    """Duplicate suppression of all detections: best score, then top-to-bottom, left-to-right."""
    order = [(-F.col("score")).alias("o1"), F.col("y0").alias("o2"), F.col("x0").alias("o3")]
    return greedy_keep(t.fx_boxes, order, spatial.conflict_test(0.3, 0.5))


# The oracle walks each cluster of conflicting boxes in order, one box a step.
GREEDY_SQL = f""", pairs AS (SELECT a.page_id, a.box_id AS aid, b.box_id AS bid, a.score AS sa, b.score AS sb
      FROM fx_boxes a JOIN fx_boxes b ON a.page_id=b.page_id AND a.box_id<>b.box_id AND {TOUCH} WHERE {CONFLICT}),
    ord AS (SELECT page_id, box_id, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, y0, x0, box_id) AS rk FROM fx_boxes),
    better AS (SELECT p.page_id, p.aid AS box_id, p.bid AS other FROM pairs p JOIN ord x ON x.page_id=p.page_id AND x.box_id=p.aid
      JOIN ord y ON y.page_id=p.page_id AND y.box_id=p.bid WHERE y.rk < x.rk),
    chains AS (SELECT page_id, box_id, other, [box_id, other] AS path FROM better
      UNION ALL SELECT c.page_id, c.box_id, b.other, list_append(c.path, b.other) FROM chains c
      JOIN better b ON b.page_id=c.page_id AND b.box_id=c.other),
    depth AS (SELECT o.page_id, o.box_id, coalesce(max(len(c.path))-1, 0) AS d FROM ord o LEFT JOIN chains c USING (page_id, box_id) GROUP BY ALL),
    l0 AS (SELECT page_id, box_id, TRUE AS kept FROM depth WHERE d=0),"""
GREEDY_SQL += ",".join(f"""
    l{i} AS (SELECT * FROM l{i-1} UNION ALL SELECT d.page_id, d.box_id, NOT coalesce(bool_or(k.kept), FALSE) FROM depth d
      JOIN better b USING (page_id, box_id) JOIN l{i-1} k ON k.page_id=b.page_id AND k.box_id=b.other WHERE d.d={i} GROUP BY d.page_id, d.box_id)"""
                       for i in range(1, 9))


@query("suppress_duplicates", "E8 C4", cte("fx_boxes", recursive=True) + GREEDY_SQL + """
    SELECT page_id, box_id, kept FROM l8""")
def _(t):
    return suppressed(t).select("page_id", "box_id", "kept")


@query("suppressed_candidates_capped", "F3 G8", cte("fx_boxes", recursive=True) + GREEDY_SQL + """,
    n AS (SELECT l8.page_id, box_id, row_number() OVER (PARTITION BY l8.page_id ORDER BY score DESC, y0, x0, box_id) AS rn
          FROM l8 JOIN fx_boxes USING (page_id, box_id) WHERE kept)
    SELECT page_id, count(*) FILTER (WHERE rn <= 300) AS kept, bool_or(rn > 300) AS truncated FROM n GROUP BY page_id""")
def _(t):
    from markset.operators.detections import cap_candidates

    kept = suppressed(t).where("kept").join(t.fx_boxes, ["page_id", "box_id"])
    capped = cap_candidates(kept, ["page_id"], [F.desc("score"), F.asc("y0"), F.asc("x0"), F.asc("box_id")], 300)
    return capped.groupBy("page_id").agg(F.count(F.lit(1)).alias("kept"), F.max("truncated").alias("truncated"))


@query("heat_peaks", "E10", cte("fx_detections") + """,
    cells AS (SELECT page_id, CAST(floor(x/4) AS BIGINT) AS i, CAST(floor(y/4) AS BIGINT) AS j, max(score) AS heat FROM fx_detections GROUP BY ALL),
    m AS (SELECT a.page_id, a.i, a.j, a.heat, max(b.heat) AS top FROM cells a JOIN cells b
      ON a.page_id=b.page_id AND b.i BETWEEN a.i-1 AND a.i+1 AND b.j BETWEEN a.j-1 AND a.j+1 GROUP BY ALL)
    SELECT page_id, i, j, heat, least(CAST(i*4+2 AS DOUBLE), 3400.0::DOUBLE) AS x, least(CAST(j*4+2 AS DOUBLE), 2200.0::DOUBLE) AS y FROM m WHERE heat >= 0.6 AND heat = top""")
def _(t):
    from markset.operators.detections import local_maxima

    cells = t.fx_detections.groupBy("page_id", F.floor(F.col("x") / 4).alias("i"), F.floor(F.col("y") / 4).alias("j")).agg(F.max("score").alias("heat"))
    return local_maxima(cells, 0.6, stride=4, width=3400, height=2200)


@query("box_functions", "H1 H2 H3 H4 H27", cte("fx_boxes", "fx_detections") + """
    SELECT b.page_id, b.box_id, (b.x0+b.x1)/2 AS cx, (b.y0+b.y1)/2 AS cy,
      CAST(floor(b.x0+1e-6) AS BIGINT) AS ix, CAST(floor(b.y0+1e-6) AS BIGINT) AS iy,
      CAST(greatest(1, ceil(b.x1-1e-6)-floor(b.x0+1e-6)) AS BIGINT) AS iw, CAST(greatest(1, ceil(b.y1-1e-6)-floor(b.y0+1e-6)) AS BIGINT) AS ih,
      CAST(greatest(floor(b.x0)-24, 0) AS BIGINT) AS wx0, CAST(greatest(floor(b.y0)-24, 0) AS BIGINT) AS wy0,
      CAST(least(ceil(b.x1)+24, 3400) AS BIGINT) AS wx1, CAST(least(ceil(b.y1)+24, 2200) AS BIGINT) AS wy1,
      floor(b.x0)-24 < 0 OR floor(b.y0)-24 < 0 OR ceil(b.x1)+24 > 3400 OR ceil(b.y1)+24 > 2200 AS clipped,
      CAST(floor(d.x-64+0.5) AS BIGINT) AS mx0, CAST(floor(d.y-64+0.5) AS BIGINT) AS my0,
      CAST(greatest(0, floor(b.x0-3)) AS BIGINT) AS px0, CAST(least(2200, ceil(b.y1+3)) AS BIGINT) AS py1,
      round_even(d.x-20, 0) AS bx, round_even(d.y-20, 0) AS by
    FROM fx_boxes b JOIN fx_detections d ON b.page_id=d.page_id AND b.box_id=d.det_id""")
def _(t):
    d = t.fx_detections.withColumns(dict(x0=F.col("x") - F.col("w") / 2, y0=F.col("y") - F.col("h") / 2,
                                         x1=F.col("x") + F.col("w") / 2, y1=F.col("y") + F.col("h") / 2))
    box = G.box_cols()
    cx, cy = G.box_center(*box)
    ib = G.box_to_int(box)
    cut, clipped = G.clip_window(G.detection_window(box), F.lit(3400), F.lit(2200))
    man = G.centered_window(F.col("x"), F.col("y"))
    pad = G.box_pad_clip(box, 3, F.lit(3400), F.lit(2200))
    pb = G.point_box(F.col("x"), F.col("y"), whole=True)
    return d.select("page_id", F.col("det_id").alias("box_id"), cx.alias("cx"), cy.alias("cy"), ib[0].alias("ix"), ib[1].alias("iy"),
                    ib[2].cast("bigint").alias("iw"), ib[3].cast("bigint").alias("ih"),
                    *[c.cast("bigint").alias(n) for c, n in zip(cut, ("wx0", "wy0", "wx1", "wy1"))], clipped.alias("clipped"),
                    man[0].alias("mx0"), man[1].alias("my0"), pad[0].cast("bigint").alias("px0"), pad[3].cast("bigint").alias("py1"),
                    pb[0].alias("bx"), pb[1].alias("by"))


@query("frame_functions", "H6 H7 H8 H24", cte("fx_detections") + """,
    f AS (SELECT page_id, det_id, x, y, w, h, rotation, 90*(det_id % 4) AS turn FROM fx_detections)
    SELECT page_id, det_id,
      round((CASE turn WHEN 90 THEN 792-(792-y) WHEN 180 THEN 1224-(x-10) WHEN 270 THEN 792-y ELSE x-10 END)*(200/72.0::DOUBLE), 4) AS px,
      round((CASE turn WHEN 90 THEN x-10 WHEN 180 THEN 792-(792-y) WHEN 270 THEN 1224-(x-10) ELSE 792-y END)*(200/72.0::DOUBLE), 4) AS py,
      CASE turn WHEN 90 THEN 2200-(y+h) WHEN 180 THEN 3400-(x+w) WHEN 270 THEN y ELSE x END AS rx,
      CASE turn WHEN 90 THEN x WHEN 180 THEN 2200-(y+h) WHEN 270 THEN 3400-(x+w) ELSE y END AS ry,
      x AS ux, y AS uy,
      CAST(floor((3400+w)*0.65::DOUBLE) AS BIGINT) AS tx, CAST(round_even((2200+h)*1.0::DOUBLE, 0) AS BIGINT) - CAST(floor((2200+h)*0.55::DOUBLE) AS BIGINT) AS th,
      CAST(turn AS BIGINT) AS angle, det_id % 3 = 0 AS mirrored
    FROM f""")
def _(t):
    turn = (F.col("det_id") % 4 * 90).cast("int")
    f = t.fx_detections.withColumn("turn", turn)
    x, y, w, h = (F.col(c) for c in "xywh")
    px, py = G.user_to_px(x, y, [F.lit(10.0), F.lit(0.0), F.lit(1234.0), F.lit(792.0)], F.col("turn"))
    size = (F.lit(3400), F.lit(2200))
    rot = G.rotate_box([x, y, w, h], *size, F.col("turn"))
    back = G.unrotate_box([F.col("rx"), F.col("ry"), F.col("rw"), F.col("rh")], *size, F.col("turn"))
    f = f.select("*", px.alias("px"), py.alias("py"), *[c.alias(n) for c, n in zip(rot, ("rx", "ry", "rw", "rh"))])
    mir = F.col("det_id") % 3 == 0
    rad = F.radians(F.col("turn"))
    c, s, sg = F.cos(rad) * 2, F.sin(rad) * 2, F.when(mir, -1.0).otherwise(1.0)
    ang, mirrored, scale = G.decompose(c * sg, -s, s * sg, c)
    snapped, dev = G.snap_quarter(ang)
    tb = G.title_block_region(F.lit(3400) + w, F.lit(2200) + h)
    return f.where((dev < 1e-6) & (F.abs(scale - 2) < 1e-9)).select(
        "page_id", "det_id", F.round("px", 4).alias("px"), F.round("py", 4).alias("py"), "rx", "ry", back[0].alias("ux"), back[1].alias("uy"),
        tb[0].alias("tx"), tb[3].alias("th"), snapped.cast("bigint").alias("angle"), mirrored.alias("mirrored"))
