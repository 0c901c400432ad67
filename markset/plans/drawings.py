"""Line-work queries: blocks, signatures, poses, whole-set counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from markset.fixtures import cte
from markset.functions import geometry as G
from markset.operators import legend as L
from markset.operators import primitives as P
from markset.plans.registry import query

FXS = cte("fx_symbols", "fx_primitives", "fx_placements")
CUB = "((1-t)*(1-t)*(1-t)*c0{a} + 3*(1-t)*(1-t)*t*c1{a} + 3*(1-t)*t*t*c2{a} + t*t*t*c3{a})"


@query("curve_samples", "H9", FXS + f""", l AS (SELECT *, sqrt(pow(c1x-c0x,2)+pow(c1y-c0y,2))+sqrt(pow(c2x-c1x,2)+pow(c2y-c1y,2))+sqrt(pow(c3x-c2x,2)+pow(c3y-c2y,2)) AS len FROM fx_primitives),
    n AS (SELECT *, greatest(2, CAST(ceil(len/2) AS INT)+1) AS n FROM l), p AS (SELECT *, i/(n-1)::DOUBLE AS t FROM (SELECT *, unnest(range(n)) AS i FROM n)),
    q AS (SELECT prim_id, {CUB.format(a='x')} AS x, {CUB.format(a='y')} AS y FROM p)
    SELECT prim_id, count(*) AS n, round(sum(x),3) AS sx, round(sum(y),3) AS sy FROM q GROUP BY 1""")
def _(t):
    p = P.explode_samples(t.fx_primitives, 2.0)
    return p.groupBy("prim_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("px"), 3).alias("sx"), F.round(F.sum("py"), 3).alias("sy"))


@query("segment_distances", "H10", FXS + """, s AS (SELECT symbol_id, cx, cy, prim_id, c0x AS ax, c0y AS ay, c3x-c0x AS ex, c3y-c0y AS ey FROM fx_symbols s JOIN fx_primitives p ON s.page_id=p.page_id AND CAST(floor(p.prim_id/10) AS BIGINT)=s.symbol_id WHERE kind=0),
    k AS (SELECT *, greatest(0, least(1, ((cx-ax)*ex+(cy-ay)*ey)/greatest(ex*ex+ey*ey,1e-12))) AS t FROM s)
    SELECT prim_id, round(sqrt(pow(cx-ax-t*ex,2)+pow(cy-ay-t*ey,2)),6) AS d FROM k""")
def _(t):
    s = t.fx_primitives.where("kind = 0").join(t.fx_symbols.select("symbol_id", "cx", "cy"), F.floor(F.col("prim_id") / 10) == F.col("symbol_id"))
    d = G.segment_distance(F.col("cx"), F.col("cy"), *[F.col(c) for c in ("c0x", "c0y", "c3x", "c3y")])
    return s.select("prim_id", F.round(d, 6).alias("d"))


@query("exemplar_placement", "C16 H1", FXS + """, e AS (SELECT page_id, symbol_id AS exemplar_id, cx-14 AS x0, cy-16 AS y0, cx+15 AS x1, cy+13 AS y1 FROM fx_symbols),
    j AS (SELECT e.page_id, e.exemplar_id, p.placement_id, p.group_key, p.depth, round(greatest(least(e.x1,p.x1)-greatest(e.x0,p.x0),0)*greatest(least(e.y1,p.y1)-greatest(e.y0,p.y0),0)
       / ((e.x1-e.x0)*(e.y1-e.y0)+(p.x1-p.x0)*(p.y1-p.y0)-greatest(least(e.x1,p.x1)-greatest(e.x0,p.x0),0)*greatest(least(e.y1,p.y1)-greatest(e.y0,p.y0),0)),6) AS iou FROM e JOIN fx_placements p ON e.page_id=p.page_id AND e.x0<=p.x1 AND e.x1>=p.x0 AND e.y0<=p.y1 AND e.y1>=p.y0)
    SELECT page_id, exemplar_id, placement_id, group_key, iou FROM j WHERE iou>=0.5 QUALIFY row_number() OVER (PARTITION BY page_id, exemplar_id ORDER BY iou DESC, depth DESC, placement_id)=1""")
def _(t):
    e = t.fx_symbols.select("page_id", F.col("symbol_id").alias("exemplar_id"), (F.col("cx") - 14).alias("x0"), (F.col("cy") - 16).alias("y0"), (F.col("cx") + 15).alias("x1"), (F.col("cy") + 13).alias("y1"))
    return P.exemplar_placement(t.fx_placements, e)


@query("placements_of_group", "C17 H7", FXS + """ SELECT page_id, placement_id, shape AS exemplar_id, rotation, s.symbol_id % 5 = 0 AS mirrored, round(1.5::DOUBLE,6) AS scale FROM fx_placements p JOIN fx_symbols s USING (page_id) WHERE s.symbol_id=p.placement_id AND s.shape IN ('A','N')""")
def _(t):
    refs = t.fx_exemplars.where("exemplar_id IN ('A', 'N')").select("exemplar_id", F.concat(F.lit("block-"), "exemplar_id").alias("group_key"), F.lit(1.0).alias("r11"), F.lit(0.0).alias("r12"), F.lit(0.0).alias("r21"), F.lit(1.0).alias("r22")).distinct()
    return P.placements_of_group(t.fx_placements, refs).select("page_id", "placement_id", "exemplar_id", "rotation", "mirrored", F.round("scale", 6).alias("scale"))


@query("drawing_components", "C3", FXS + """ SELECT page_id, CASE WHEN symbol_id % 3 = 0 THEN 1 ELSE 0 END + CASE shape WHEN 'N' THEN 5 ELSE 3 END AS size, count(*) AS drawings FROM fx_symbols GROUP BY ALL""")
def _(t):
    c = P.drawing_components(t.fx_primitives).groupBy("page_id", "comp").agg(F.count(F.lit(1)).cast("int").alias("size"))
    return c.groupBy("page_id", "size").agg(F.count(F.lit(1)).alias("drawings"))


@query("signature_matches", "C18 C3", FXS + " SELECT page_id, shape AS exemplar_id, count(*) AS n FROM fx_symbols WHERE symbol_id % 3 <> 0 GROUP BY ALL")
def _(t):
    m = P.signature_matches(P.drawing_components(t.fx_primitives), P.exemplar_table(t.fx_exemplars))
    return m.groupBy("page_id", "exemplar_id").agg(F.count(F.lit(1)).alias("n"))


@query("pose_hypotheses", "C19")
def _(t):
    return P.pose_hypotheses(t.fx_primitives, t.fx_exemplars)


@query("match_paths", "C18 C19 C20 E8", FXS + " SELECT page_id, shape AS exemplar_id, count(*) AS n, count(*) AS perfect FROM fx_symbols GROUP BY ALL")
def _(t):
    m = P.match_paths(t.fx_primitives, t.fx_exemplars)
    return m.groupBy("page_id", "exemplar_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") > 0.999).alias("perfect"))


def legend_of(t):
    e = t.fx_exemplars.select("exemplar_id").distinct()
    return e.select("exemplar_id", F.concat(F.lit("T-"), "exemplar_id").alias("tag"), F.ascii("exemplar_id").alias("legend_order"), F.lit(False).alias("needs_label"),
                    F.lit(1.0).alias("detail"), F.lit(None).cast("string").alias("label"))


@query("scan_set", "K17 D1 E9 C6", FXS + """ SELECT CAST(page_id AS VARCHAR) AS sheet, 'T-' || shape AS tag, count(*) AS n FROM fx_symbols GROUP BY ALL UNION ALL SELECT 'all', 'T-' || shape, count(*) FROM fx_symbols GROUP BY shape""")
def _(t):
    return P.scan_set(t.fx_primitives, t.fx_exemplars, legend_of(t))["counts"]


@query("symbol_counts", "D1", cte("fx_detections") + """ SELECT CAST(page_id AS VARCHAR) AS sheet, class_label AS tag, count(*) AS n FROM fx_detections GROUP BY ALL UNION ALL SELECT 'all', class_label, count(*) FROM fx_detections GROUP BY 2
    UNION ALL SELECT 'all', 'ZZ', 0""")
def _(t):
    found = t.fx_detections.withColumn("tag", F.col("class_label"))
    tags = found.select("tag").distinct().unionByName(t.region.limit(1).select(F.lit("ZZ").alias("tag")))
    return P.symbol_counts(found, tags)


@query("symbol_signatures", "K13")
def _(t):
    boxes = t.fx_symbols.select("page_id", F.col("symbol_id").alias("box_id"), (F.col("cx") - 16).alias("x0"), (F.col("cy") - 16).alias("y0"), (F.col("cx") + 16).alias("x1"), (F.col("cy") + 16).alias("y1"))
    return L.cells_to_signature(P.ink_cells(t.fx_primitives, boxes), ["page_id", "box_id"])


@query("resolve_spots", "E9 E8")
def _(t):
    c = t.fx_boxes.select("page_id", "box_id", F.col("class_label").alias("tag"), F.ascii("class_label").alias("legend_order"), (F.col("box_id") % 4 == 0).alias("needs_label"),
                          F.when(F.col("box_id") % 3 == 0, F.col("class_label")).alias("label"), (F.col("box_id") % 9 / 9.0).alias("detail"), F.lit("vector").alias("source"), "score", "x0", "y0", "x1", "y1")
    kept, dropped = P.resolve_spots(c, t.fx_page_text)
    n = kept.groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("kept"))
    return n.join(dropped, ["page_id", "tag"], "full").fillna(0)


@query("label_gate", "E9 C6", cte("fx_boxes", "fx_page_text") + """ SELECT page_id, class_label AS tag, count(*) AS dropped FROM fx_boxes WHERE box_id % 4 = 0 AND box_id % 3 <> 0 AND page_id IN (SELECT page_id FROM fx_page_text) GROUP BY ALL""")
def _(t):
    # every box stands alone here, so only the label gate drops anything
    c = t.fx_boxes.select(F.col("box_id"), "page_id", F.col("class_label").alias("tag"), F.lit(0).alias("legend_order"), (F.col("box_id") % 4 == 0).alias("needs_label"),
                          F.when(F.col("box_id") % 3 == 0, F.col("class_label")).alias("label"), F.lit(1.0).alias("detail"), F.lit("vector").alias("source"), "score", *[(F.col(k) + F.col("box_id") * 5000.0).alias(k) for k in ("x0", "y0", "x1", "y1")])
    return P.resolve_spots(c, t.fx_page_text)[1]


TALLY = "tl AS (SELECT p_brand AS symbol, p_size % 20 AS page_no, CASE p_partkey % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 0.75 WHEN 2 THEN 1.25 ELSE 2.0 END::DOUBLE AS factor, CAST(sum(p_partkey % 3) AS BIGINT) AS n FROM part GROUP BY ALL)"


@query("choose_scale", "D27 H19", f"""WITH {TALLY}, h AS (SELECT symbol, page_no, row_number() OVER (PARTITION BY symbol ORDER BY page_no) AS r, count(*) OVER (PARTITION BY symbol) AS k FROM (SELECT symbol, page_no FROM tl GROUP BY ALL HAVING sum(n)>0)),
    l AS (SELECT symbol, max(page_no) AS last, max(k) AS k FROM h WHERE r<=3 GROUP BY 1), s AS (SELECT symbol, factor, CAST(sum(n) AS BIGINT) AS n FROM tl JOIN l USING (symbol) WHERE k<3 OR page_no<=last GROUP BY ALL)
    SELECT symbol, factor, n FROM s QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY n DESC, round(abs(ln(factor)),12), factor DESC)=1""")
def _(t):
    m = F.col("p_partkey") % 4
    tally = t.part.select(F.col("p_brand").alias("symbol"), (F.col("p_size") % 20).alias("page_no"), F.when(m == 0, 0.5).when(m == 1, 0.75).when(m == 2, 1.25).otherwise(2.0).alias("factor"), (F.col("p_partkey") % 3).alias("n"))
    return P.choose_scale(tally.groupBy("symbol", "page_no", "factor").agg(F.sum("n").alias("n")))


@query("learned_effect", "D31", cte("fx_detections") + """ SELECT class_label AS tag, count(*) FILTER (WHERE rotation<>90 AND score<0.7) AS rejected, count(*) FILTER (WHERE rotation=90 AND score>=0.7) AS added FROM fx_detections GROUP BY 1""")
def _(t):
    j = t.fx_detections.select(F.col("class_label").alias("tag"), F.when(F.col("rotation") == 90, "learned").otherwise("vector").alias("source"), (F.col("score") >= 0.7).alias("accept"))
    return P.learned_effect(j)
