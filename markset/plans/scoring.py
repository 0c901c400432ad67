"""Matching, curves, roll-ups and gates on the drawing pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from markset.fixtures import cte
from markset.operators import corpus, curves
from markset.operators.matching import explain_errors, match_points
from markset.operators.spatial import eligible_pairs
from markset.plans.registry import query
from markset.session import materialize
from markset.plans.spatial import EDGES, TOL, preds_of, refs_of

# Every matching of every component, one row each: the oracle's exhaustive answer.
ENUM = """
    links AS (SELECT page_id, pred_id AS a, -ref_id-1 AS b FROM edges UNION ALL SELECT page_id, -ref_id-1, pred_id FROM edges),
    reach AS (SELECT page_id, a, b FROM links UNION SELECT r.page_id, r.a, l.b FROM reach r JOIN links l ON l.page_id=r.page_id AND l.a=r.b),
    comp AS (SELECT page_id, a, min(b) AS c FROM reach GROUP BY page_id, a),
    ce AS (SELECT e.*, c.c, row_number() OVER (PARTITION BY e.page_id, c.c ORDER BY pred_id, ref_id) AS rn
           FROM edges e JOIN comp c ON c.page_id=e.page_id AND c.a=e.pred_id),
    tries AS (SELECT page_id, c, 0::BIGINT AS rn, []::BIGINT[] AS ps, []::BIGINT[] AS rs, 0::BIGINT AS card, 0::DOUBLE AS cost, 9::DOUBLE AS low,
                0::DOUBLE AS sdx, 0::DOUBLE AS sdy, []::DOUBLE[] AS ds
              FROM (SELECT DISTINCT page_id, c FROM ce)
       UNION ALL SELECT t.page_id, t.c, e.rn, list_append(t.ps, e.pred_id), list_append(t.rs, e.ref_id), t.card+1, t.cost+e.distance,
                least(t.low, e.confidence), t.sdx+e.dx, t.sdy+e.dy, list_append(t.ds, e.distance) FROM tries t JOIN ce e
            ON e.page_id=t.page_id AND e.c=t.c AND e.rn > t.rn WHERE NOT list_contains(t.ps, e.pred_id) AND NOT list_contains(t.rs, e.ref_id)),
    best AS (SELECT page_id, c, card, cost, sdx, sdy, ds, ps, rs FROM tries
             QUALIFY row_number() OVER (PARTITION BY page_id, c ORDER BY card DESC, round(cost,9), ps, rs) = 1)"""

FX = cte("fx_detections", "fx_references", "fx_pages", recursive=True) + f", {EDGES}, {ENUM}"

COUNTS = """, p AS (SELECT page_id, count(*) AS n FROM fx_detections GROUP BY 1), r AS (SELECT page_id, count(*) AS n FROM fx_references GROUP BY 1),
    m AS (SELECT page_id, CAST(sum(card) AS BIGINT) AS tp, sum(cost) AS dist FROM best GROUP BY 1),
    pages_c AS (SELECT page_id, coalesce(m.tp,0) AS tp, coalesce(p.n,0)-coalesce(m.tp,0) AS fp, coalesce(r.n,0)-coalesce(m.tp,0) AS fn
      FROM p FULL JOIN r USING (page_id) LEFT JOIN m USING (page_id))"""
PRF = """round(CASE WHEN tp+fp=0 THEN NULL ELSE tp/(tp+fp)::DOUBLE END,6) AS precision, round(CASE WHEN tp+fn=0 THEN NULL ELSE tp/(tp+fn)::DOUBLE END,6) AS recall,
    round(CASE WHEN 2*tp+fp+fn=0 THEN NULL ELSE 2*tp/(2*tp+fp+fn)::DOUBLE END,6) AS f1"""


def matches_of(t):
    return match_points(preds_of(t), refs_of(t), TOL)


def counts_of(t):
    return corpus.page_counts(preds_of(t), refs_of(t), matches_of(t))


def rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("match_scores_by_document", "C2 D7 D8 D9 J1", FX + COUNTS + f"""
    SELECT document_id, pages, tp, fp, fn, {PRF} FROM (SELECT document_id, count(*) AS pages, CAST(sum(tp) AS BIGINT) AS tp,
      CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM pages_c JOIN fx_pages USING (page_id) GROUP BY 1)""")
def _(t):
    pages = counts_of(t).join(t.fx_pages, "page_id")
    return rounded(corpus.micro_scores(pages, ["document_id"]), "precision", "recall", "f1")


@query("match_totals_by_page", "C2 J1", FX + ", m AS (SELECT page_id, CAST(sum(card) AS BIGINT) AS tp, sum(cost) AS dist FROM best GROUP BY 1) SELECT page_id, tp, round(dist, 4) AS total_distance FROM m")
def _(t):
    return matches_of(t).groupBy("page_id").agg(F.count(F.lit(1)).alias("tp"), F.round(F.sum("distance"), 4).alias("total_distance"))


@query("scores_by_tag", "D9 D7", FX + COUNTS + f"""
    SELECT tag, pages, tp, fp, fn, {PRF} FROM (SELECT tag, count(*) AS pages, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp,
      CAST(sum(fn) AS BIGINT) AS fn FROM pages_c JOIN (SELECT page_id, unnest(['region:' || tag, 'all', 'band' || CAST(region_id % 2 AS VARCHAR)]) AS tag FROM fx_pages) USING (page_id) GROUP BY 1)""")
def _(t):
    tags = t.fx_pages.select("page_id", F.explode(F.array(F.concat(F.lit("region:"), "tag"), F.lit("all"),
                                                         F.concat(F.lit("band"), (F.col("region_id") % 2).cast("string")))).alias("tag"))
    return rounded(corpus.micro_scores(counts_of(t).join(tags, "page_id"), ["tag"]), "precision", "recall", "f1")


@query("macro_scores", "D8", FX + COUNTS + f""", s AS (SELECT {PRF.replace('round(', '(').replace(',6)', ')')} FROM pages_c),
    l AS (SELECT 'precision' AS metric, precision AS v FROM s UNION ALL SELECT 'recall', recall FROM s UNION ALL SELECT 'f1', f1 FROM s)
    SELECT metric, round(avg(v), 6) AS value, count(v) AS pages_included, count(*) FILTER (WHERE v IS NULL) AS pages_excluded FROM l GROUP BY 1""")
def _(t):
    return rounded(corpus.macro_scores(counts_of(t)), "value")


@query("worst_pages", "F2", FX + COUNTS + f""" SELECT page_id, tp, fp, fn, {PRF} FROM pages_c
    ORDER BY 2*tp/(2*tp+fp+fn)::DOUBLE, fp+fn DESC, page_id LIMIT 10""")
def _(t):
    return rounded(corpus.worst_pages(counts_of(t), 10), "precision", "recall", "f1")


@query("localization_by_document", "D10 D12", FX + """, u AS (SELECT page_id, unnest(ds) AS d FROM best),
    s AS (SELECT page_id, sum(sdx) AS sdx, sum(sdy) AS sdy FROM best GROUP BY 1),
    a AS (SELECT document_id, count(*) AS matched_pairs, round(avg(d),4) AS mean_distance, round(quantile_cont(d,0.5),4) AS median_distance,
      round(quantile_cont(d,0.95),4) AS p95_distance, round(max(d),4) AS max_distance FROM u JOIN fx_pages USING (page_id) GROUP BY 1),
    b AS (SELECT document_id, sum(sdx) AS sdx, sum(sdy) AS sdy FROM s JOIN fx_pages USING (page_id) GROUP BY 1)
    SELECT a.*, round(sdx/matched_pairs,4) AS mean_dx, round(sdy/matched_pairs,4) AS mean_dy FROM a JOIN b USING (document_id)""")
def _(t):
    # read twice, for percentiles and means
    found = materialize(matches_of(t).join(t.fx_pages, "page_id").select("document_id", "distance", "dx", "dy"), "matches")
    out = corpus.localization(found, ["document_id"])
    return rounded(out, "mean_distance", "median_distance", "p95_distance", "max_distance", "mean_dx", "mean_dy", digits=4)


@query("explain_errors", "C23", FX + """,
    used AS (SELECT page_id, unnest(ps) AS pred_id, unnest(rs) AS ref_id FROM best),
    lp AS (SELECT d.page_id, d.det_id AS pred_id FROM fx_detections d WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.page_id=d.page_id AND u.pred_id=d.det_id)),
    lr AS (SELECT d.page_id, d.ref_id FROM fx_references d WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.page_id=d.page_id AND u.ref_id=d.ref_id)),
    o AS (SELECT page_id, 'false_positive' AS kind, CASE WHEN EXISTS (SELECT 1 FROM edges e WHERE e.page_id=lp.page_id AND e.pred_id=lp.pred_id)
            THEN 'duplicate_or_crowded' ELSE 'no_reference_within_tolerance' END AS reason FROM lp
      UNION ALL SELECT page_id, 'false_negative', CASE WHEN EXISTS (SELECT 1 FROM edges e WHERE e.page_id=lr.page_id AND e.ref_id=lr.ref_id)
            THEN 'crowded' ELSE 'no_prediction_within_tolerance' END FROM lr)
    SELECT page_id, kind, reason, count(*) AS n FROM o GROUP BY ALL""")
def _(t):
    p, r = materialize(preds_of(t), "predictions"), materialize(refs_of(t), "references")
    # both sides read the edges and the matches; solved anew, each reading would match all pages again
    edges = materialize(eligible_pairs(p, r, TOL), "edges")
    return explain_errors(p, r, edges, materialize(match_points(p, r, TOL), "matches")).groupBy("page_id", "kind", "reason").agg(F.count(F.lit(1)).alias("n"))


CURVE = """
    card AS (SELECT page_id, c, low, max(card) AS card FROM tries WHERE card > 0 GROUP BY ALL),
    steps AS (SELECT page_id, c, low, max(card) OVER (PARTITION BY page_id, c ORDER BY low DESC) AS card FROM card),
    gains AS (SELECT page_id, low AS confidence, card - coalesce(lag(card) OVER (PARTITION BY page_id, c ORDER BY low DESC), 0) AS gain FROM steps)"""


def curve_sql(by: str) -> str:
    key = f"{by}," if by else ""
    part = f"PARTITION BY {by}" if by else ""
    using = f"USING ({by}, confidence)" if by else "USING (confidence)"
    return FX + f""", {CURVE},
    n AS (SELECT {key} score AS confidence, count(*) AS n FROM fx_detections JOIN fx_pages USING (page_id) GROUP BY ALL),
    g AS (SELECT {key} confidence, sum(gain) AS gain FROM gains JOIN fx_pages USING (page_id) GROUP BY ALL),
    rr AS (SELECT {key} count(*) AS n_refs FROM fx_references JOIN fx_pages USING (page_id) GROUP BY ALL),
    z AS (SELECT {key} confidence, n, coalesce(gain,0) AS gain FROM n LEFT JOIN g {using}),
    cur0 AS (SELECT {key} confidence, CAST(sum(n) OVER ({part} ORDER BY confidence DESC) AS BIGINT) AS detections,
      CAST(sum(gain) OVER ({part} ORDER BY confidence DESC) AS BIGINT) AS tp, gain FROM z),
    cur AS (SELECT cur0.*, n_refs, detections-tp AS fp, n_refs-tp AS fn, tp/detections::DOUBLE AS precision, tp/n_refs::DOUBLE AS recall,
      2*tp/(detections+n_refs)::DOUBLE AS f1, (tp-gain)/n_refs::DOUBLE AS prev_recall FROM cur0 {'JOIN rr USING (' + by + ')' if by else ', rr'})"""


def with_groups(t):
    docs = t.fx_pages.select("page_id", "document_id")
    return preds_of(t).join(docs, "page_id"), refs_of(t).join(docs, "page_id")


def pooled_curve(t):
    return curves.pr_curve(preds_of(t), refs_of(t), TOL)


@query("pr_curve", "E3 J3", curve_sql("") + " SELECT confidence, detections, tp, fp, fn, round(precision,6) AS precision, round(recall,6) AS recall, round(f1,6) AS f1 FROM cur")
def _(t):
    c = rounded(pooled_curve(t), "precision", "recall", "f1")
    return c.select("confidence", "detections", "tp", "fp", "fn", "precision", "recall", "f1")


@query("ap_by_document", "E3 E4", curve_sql("document_id") + """,
    e AS (SELECT *, max(precision) OVER (PARTITION BY document_id ORDER BY confidence) AS env FROM cur)
    SELECT document_id, round(sum((recall-prev_recall)*env),6) AS ap, count(*) AS thresholds FROM e GROUP BY 1""")
def _(t):
    p, r = with_groups(t)
    curve = curves.pr_curve(p, r, TOL, ["document_id"])
    return rounded(curves.interpolated_ap(curve, ["document_id"]), "ap")


@query("operating_points", "E5", curve_sql("") + """,
    o AS (SELECT 'best_f1' AS kind, * FROM cur QUALIFY row_number() OVER (ORDER BY f1 DESC, confidence DESC)=1
      UNION ALL SELECT 'precision_at_recall', * FROM (SELECT * FROM cur WHERE recall >= 0.3 QUALIFY row_number() OVER (ORDER BY precision DESC, confidence DESC)=1)
      UNION ALL SELECT 'recall_at_precision', * FROM (SELECT * FROM cur WHERE precision >= 0.3 QUALIFY row_number() OVER (ORDER BY recall DESC, confidence DESC)=1))
    SELECT kind, confidence, tp, detections, round(precision,6) AS precision, round(recall,6) AS recall, round(f1,6) AS f1 FROM o""")
def _(t):
    return rounded(curves.operating_points(pooled_curve(t), target=0.3), "precision", "recall", "f1")


@query("sample_curve", "F5", curve_sql("") + """,
    q AS (SELECT *, row_number() OVER (ORDER BY confidence DESC)-1 AS pos, count(*) OVER () AS total FROM cur)
    SELECT confidence, tp, detections FROM q WHERE pos IN (SELECT CAST(round_even(k*((SELECT max(total) FROM q)-1)/9.0::DOUBLE,0) AS BIGINT) FROM range(10) g(k))""")
def _(t):
    return curves.sample_curve(pooled_curve(t), 10).select("confidence", "tp", "detections")


@query("grid_threshold", "E7", curve_sql("") + """,
    gr AS (SELECT round(0.05::DOUBLE + k*0.025::DOUBLE, 4) AS threshold FROM range(37) g(k)),
    att AS (SELECT threshold, coalesce(max(detections),0) AS detections, coalesce(max(tp),0) AS tp FROM gr LEFT JOIN cur ON confidence >= threshold GROUP BY 1),
    f AS (SELECT threshold, round(coalesce(2*tp/nullif(detections + (SELECT max(n_refs) FROM cur),0)::DOUBLE,0),6) AS f1, tp, detections FROM att)
    SELECT * FROM f ORDER BY f1 DESC, threshold DESC LIMIT 1""")
def _(t):
    return rounded(curves.grid_threshold(pooled_curve(t)), "f1")


MODES = FX + """, p0 AS (SELECT page_id, document_id, CAST(count(*) FILTER (WHERE score >= 0.5) AS BIGINT) AS n5, CAST(count(*) FILTER (WHERE score >= 0.7) AS BIGINT) AS n7
      FROM fx_detections JOIN fx_pages USING (page_id) GROUP BY ALL),
    r0 AS (SELECT page_id, count(*) AS n FROM fx_references GROUP BY 1),
    b7 AS (SELECT page_id, c, max(card) AS card FROM tries WHERE low >= 0.7 GROUP BY ALL),
    t7 AS (SELECT page_id, CAST(sum(card) AS BIGINT) AS tp FROM b7 GROUP BY 1), t5 AS (SELECT page_id, CAST(sum(card) AS BIGINT) AS tp FROM best GROUP BY 1),
    modes AS (SELECT 'baseline' AS mode, CAST(sum(coalesce(t5.tp,0)) AS BIGINT) AS tp, CAST(sum(n5-coalesce(t5.tp,0)) AS BIGINT) AS fp,
        CAST(sum(r0.n-coalesce(t5.tp,0)) AS BIGINT) AS fn, CAST(0 AS BIGINT) AS suppressed, count(DISTINCT document_id) AS documents FROM p0 JOIN r0 USING (page_id) LEFT JOIN t5 USING (page_id)
      UNION ALL SELECT 'candidate', CAST(sum(coalesce(t7.tp,0)) AS BIGINT), CAST(sum(n7-coalesce(t7.tp,0)) AS BIGINT), CAST(sum(r0.n-coalesce(t7.tp,0)) AS BIGINT),
        CAST(sum(n5-n7) AS BIGINT), count(DISTINCT document_id) FROM p0 JOIN r0 USING (page_id) LEFT JOIN t7 USING (page_id))"""


def mode_rows(t):
    docs = t.fx_pages.select("page_id", "document_id")
    # both modes read the points several times; derived anew, each reading would group the order lines again
    preds, refs = materialize(preds_of(t), "predictions"), materialize(refs_of(t), "references")
    parts = []
    for mode, low in (("baseline", 0.5), ("candidate", 0.7)):
        p = preds.where(F.col("confidence") >= low)
        pages = corpus.page_counts(p, refs, match_points(p, refs, TOL)).join(docs, "page_id")
        cut = preds.groupBy("page_id").agg(F.count_if(F.col("confidence") < low).alias("suppressed"))
        parts.append(pages.join(cut, "page_id").withColumn("mode", F.lit(mode)))
    return parts[0].unionByName(parts[1])


def mode_summary(t):
    return mode_rows(t).groupBy("mode").agg(
        *[F.sum(c).cast("bigint").alias(c) for c in ("tp", "fp", "fn", "suppressed")], F.count_distinct("document_id").alias("documents"))


@query("mode_summary", "D29", MODES + " SELECT * FROM modes")
def _(t):
    return mode_summary(t)


@query("promotion_gate", "D25", MODES + """,
    j AS (SELECT b.tp AS btp, b.fp AS bfp, b.fn AS bfn, c.tp AS ctp, c.fp AS cfp, c.fn AS cfn, c.documents FROM modes b, modes c WHERE b.mode='baseline' AND c.mode='candidate')
    SELECT 'recall_not_below_baseline' AS condition, ctp*(btp+bfn) >= btp*(ctp+cfn) AS passed FROM j
    UNION ALL SELECT 'precision_within_margin', 100*ctp*(btp+bfp) >= 100*btp*(ctp+cfp) - 2*(ctp+cfp)*(btp+bfp) FROM j
    UNION ALL SELECT 'meaningful_improvement', 100*ctp*(btp+bfn) >= 100*btp*(ctp+cfn) + 2*(ctp+cfn)*(btp+bfn) OR 100*ctp*(btp+bfp) >= 100*btp*(ctp+cfp) + 2*(ctp+cfp)*(btp+bfp) FROM j
    UNION ALL SELECT 'min_test_documents', documents >= 3 FROM j UNION ALL SELECT 'min_reference_points', btp+bfn >= 100 FROM j
    UNION ALL SELECT 'not_synthetic_only', TRUE FROM j""")
def _(t):
    return corpus.promotion_gate(mode_summary(t).withColumn("synthetic", F.lit(False)), "baseline", "candidate")


@query("baseline_compare", "C25 D26 A10", MODES + f""", s AS (SELECT mode, {PRF.replace('round(', '(').replace(',6)', ')')} FROM modes),
    l AS (SELECT mode, 'precision' AS metric, precision AS v FROM s UNION ALL SELECT mode, 'recall', recall FROM s UNION ALL SELECT mode, 'f1', f1 FROM s)
    SELECT b.metric, round(b.v,6) AS baseline, round(c.v,6) AS current, CASE WHEN b.v - c.v <= 0.01 + 1e-12 THEN 'pass' ELSE 'fail' END AS result,
      b.v - c.v <= 0.01 + 1e-12 AS passed FROM l b JOIN l c ON b.metric=c.metric AND b.mode='baseline' AND c.mode='candidate'""")
def _(t):
    s = curves.with_prf(mode_summary(t).withColumn("tolerance_px", F.lit(TOL)))
    out = corpus.baseline_compare(s.where("mode = 'candidate'"), s.where("mode = 'baseline'"), 0.01, ["tolerance_px"], ("precision", "recall", "f1"))
    return rounded(out, "baseline", "current").drop("tolerance_px")


@query("same_pages_check", "G6", cte("fx_detections") + """, a AS (SELECT DISTINCT page_id FROM fx_detections WHERE score >= 0.5),
    b AS (SELECT DISTINCT page_id FROM fx_detections WHERE score >= 0.998)
    SELECT 'baseline_only' AS side, count(*) AS pages FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)
    UNION ALL SELECT 'candidate_only', count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def _(t):
    a = t.fx_detections.where("score >= 0.5").select("page_id").distinct()
    b = t.fx_detections.where("score >= 0.998").select("page_id").distinct()
    side = lambda x, y, n: x.exceptAll(y).agg(F.count(F.lit(1)).alias("pages")).select(F.lit(n).alias("side"), "pages")
    return side(a, b, "baseline_only").unionByName(side(b, a, "candidate_only"))


@query("runtime_summary", "D11 D12", """SELECT l_returnflag AS grp, count(q) AS with_runtime, count(*) FILTER (WHERE q IS NULL) AS without_runtime,
    round(quantile_cont(q,0.5),6) AS p50, round(quantile_cont(q,0.95),6) AS p95, round(avg(q),6) AS mean, round(sum(q),4) AS total
    FROM (SELECT l_returnflag, CASE WHEN l_linenumber <> 7 THEN l_quantity END AS q FROM lineitem) GROUP BY 1""")
def _(t):
    runs = t.lineitem.select(F.col("l_returnflag").alias("grp"), F.when(F.col("l_linenumber") != 7, F.col("l_quantity")).alias("q"))
    return rounded(corpus.runtime_summary(runs, "q", ["grp"]), "p50", "p95", "mean").withColumn("total", F.round("total", 4))


@query("accuracy_status", "B5", cte("fx_pages") + """, s AS (SELECT document_id, CASE WHEN page_id % 9 < 6 THEN 'verified' WHEN page_id % 9 = 6 THEN 'detector_assisted'
      WHEN page_id % 9 = 7 THEN 'synthetic' ELSE 'unverified' END AS status FROM fx_pages),
    k AS (SELECT document_id, list_sort(list(DISTINCT status)) AS kinds FROM s GROUP BY 1),
    c AS (SELECT document_id, array_to_string(kinds, ',') AS kinds, CASE WHEN kinds = ['verified'] THEN 'verified_reference'
      WHEN list_has_all(['verified','detector_assisted'], kinds) THEN 'detector_assisted_reference' WHEN kinds=['synthetic'] THEN 'synthetic_fixture'
      WHEN kinds=['unverified'] THEN 'unverified_reference' ELSE 'mixed_reference' END AS scope FROM k)
    SELECT *, CASE scope WHEN 'verified_reference' THEN 'measured' WHEN 'detector_assisted_reference' THEN 'measured_assisted' ELSE 'not_measured' END AS real_drawing_accuracy FROM c""")
def _(t):
    m = F.col("page_id") % 9
    s = t.fx_pages.withColumn("status", F.when(m < 6, "verified").when(m == 6, "detector_assisted").when(m == 7, "synthetic").otherwise("unverified"))
    return corpus.accuracy_status(s, ["document_id"]).withColumn("kinds", F.concat_ws(",", "kinds"))
