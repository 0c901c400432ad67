"""Score statistics, calibration and vector learning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from markset.fixtures import cte
from markset.operators import calibrate as C
from markset.operators import curves
from markset.operators import detections as D
from markset.operators import vectors as V
from markset.plans.registry import query

FXP = cte("fx_pairs")
STEPS = """st AS (SELECT {k} score, CAST(sum(label) AS BIGINT) AS pos, count(*) AS n FROM fx_pairs GROUP BY ALL),
    cu AS (SELECT *, CAST(sum(pos) OVER ({p} ORDER BY score DESC) AS BIGINT) AS tp, CAST(sum(n) OVER ({p} ORDER BY score DESC) AS BIGINT) AS kept, sum(pos) OVER ({p}) AS tot, sum(n) OVER ({p}) AS cnt FROM st)"""
ALL = STEPS.format(k="", p="")
LANG = STEPS.format(k="group_id,", p="PARTITION BY group_id")


def r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def suggest_sql(steps: str, key: str, target: float, variant: str) -> str:
    cal = variant == "calibration"
    k = f"{key}," if key else ""
    part = f"PARTITION BY {key}" if key else ""
    return FXP + f""", {steps}, p AS (SELECT *, tp/kept::DOUBLE AS precision FROM cu),
    b AS (SELECT {k} score, precision, tp, tot, cnt FROM p QUALIFY row_number() OVER ({part} ORDER BY precision DESC, score DESC)=1),
    h AS (SELECT {k} score, precision, tp FROM p WHERE precision >= {target}{' - 1e-12' if cal else ''} QUALIFY row_number() OVER ({part} ORDER BY score)=1)
    SELECT {'b.' + key + ',' if key else ''} CAST(b.cnt AS BIGINT) AS n, CAST(b.tot AS BIGINT) AS n_positive, CAST(b.cnt-b.tot AS BIGINT) AS n_negative,
      CASE WHEN cnt>=30 AND tot>0 THEN h.score END AS value,
      round(CASE WHEN cnt<30 THEN NULL WHEN tot=0 THEN {'0.0' if cal else 'NULL'} WHEN h.score IS NOT NULL THEN h.precision ELSE {'b.precision' if cal else 'NULL'} END,6) AS precision,
      round(CASE WHEN cnt<30 OR tot=0 THEN NULL WHEN h.score IS NOT NULL THEN h.tp/tot::DOUBLE ELSE {'b.tp/tot::DOUBLE' if cal else 'NULL'} END,6) AS recall_proxy,
      CASE WHEN cnt<30 THEN 'insufficient_labels' WHEN tot=0 THEN 'no_positives' WHEN h.score IS NOT NULL THEN 'ok' ELSE '{'target_unreachable' if cal else 'target_not_reached'}' END AS reason
    FROM b LEFT JOIN h ON {f'b.{key}=h.{key}' if key else 'TRUE'}"""


@query("suggest_threshold", "E6", suggest_sql(LANG, "group_id", 0.9, "calibration"))
def _(t):
    return r6(curves.suggest_threshold(t.fx_pairs, ["group_id"], 0.9), "precision", "recall_proxy")


@query("suggest_threshold_review", "E6", suggest_sql(ALL, "", 0.995, "review"))
def _(t):
    return r6(curves.suggest_threshold(t.fx_pairs, target=0.995, variant="review"), "precision", "recall_proxy")


@query("choose_threshold", "E7", FXP + f""", {LANG}, f AS (SELECT *, 2*tp/(kept+tot)::DOUBLE AS f1 FROM cu)
    SELECT group_id, score, round(f1,6) AS f1, tp, kept FROM f QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY f1 DESC, score DESC)=1""")
def _(t):
    return r6(curves.choose_threshold(t.fx_pairs, ["group_id"]), "f1")


@query("confusion", "D18", FXP + """, c AS (SELECT group_id, count(*) AS n, count(*) FILTER (WHERE label=1) AS pos, count(*) FILTER (WHERE label=0) AS neg, count(*) FILTER (WHERE label=1 AND score>=0.5) AS tp,
      count(*) FILTER (WHERE label=0 AND score>=0.5) AS fp, count(*) FILTER (WHERE label=1 AND score<0.5) AS fn, count(*) FILTER (WHERE label=0 AND score<0.5) AS tn FROM fx_pairs GROUP BY 1)
    SELECT *, round(tp/nullif(tp+fp,0)::DOUBLE,6) AS precision, round(tp/nullif(tp+fn,0)::DOUBLE,6) AS recall, round(2*tp/nullif(2*tp+fp+fn,0)::DOUBLE,6) AS f1, round((tp+tn)/n::DOUBLE,6) AS accuracy FROM c""")
def _(t):
    return r6(curves.confusion(t.fx_pairs, 0.5, ["group_id"]), "precision", "recall", "f1", "accuracy")


@query("roc_auc", "D19", FXP + """, r AS (SELECT group_id, label, rank() OVER (PARTITION BY group_id ORDER BY score) + (count(*) OVER (PARTITION BY group_id, score) - 1)/2.0::DOUBLE AS rk FROM fx_pairs)
    SELECT group_id, round((sum(rk) FILTER (WHERE label=1) - sum(label)*(sum(label)+1)/2.0::DOUBLE)/nullif(sum(label)*(count(*)-sum(label)),0),6) AS auc FROM r GROUP BY 1""")
def _(t):
    return r6(curves.roc_auc(t.fx_pairs, ["group_id"]), "auc")


@query("average_precision_ranked", "D21", FXP + """, r AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY score DESC, pair_id) AS i, sum(label) OVER (PARTITION BY group_id ORDER BY score DESC, pair_id) AS h FROM fx_pairs)
    SELECT group_id, round(sum(CASE WHEN label=1 THEN h/i::DOUBLE ELSE 0 END)/nullif(sum(label),0),6) AS average_precision FROM r GROUP BY 1""")
def _(t):
    return r6(curves.average_precision_ranked(t.fx_pairs, ["group_id"]), "average_precision")


@query("log_loss", "D22", FXP + """ SELECT group_id, round(avg(-CASE WHEN label=1 THEN ln(least(greatest(score,1e-7),1-1e-7)) ELSE ln(1-least(greatest(score,1e-7),1-1e-7)) END),6) AS log_loss FROM fx_pairs GROUP BY 1""")
def _(t):
    return r6(curves.log_loss(t.fx_pairs, ["group_id"]), "log_loss")


BG = """, m AS (SELECT page_id, class_label, quantile_cont(score,0.5) AS median, count(*) AS n FROM fx_detections {w} GROUP BY ALL),
    d AS (SELECT page_id, class_label, quantile_cont(abs(score-median),0.5) AS mad FROM fx_detections JOIN m USING (page_id, class_label) {w} GROUP BY ALL),
    s AS (SELECT *, greatest(1.4826::DOUBLE*mad, 0.001::DOUBLE) AS scale FROM m JOIN d USING (page_id, class_label))"""


@query("background_stats", "D15 D12", cte("fx_detections") + BG.format(w="") + " SELECT page_id, class_label, n, round(median,6) AS median, round(mad,6) AS mad, round(scale,6) AS scale FROM s")
def _(t):
    return r6(C.background_stats(t.fx_detections, ["page_id", "class_label"]), "median", "mad", "scale")


@query("candidate_background", "D17", cte("fx_detections") + BG.format(w="WHERE score < 0.6") + """ SELECT page_id, class_label, n, round(CASE WHEN n>=20 THEN median END,6) AS median,
    round(CASE WHEN n>=20 THEN mad END,6) AS mad, round(CASE WHEN n>=20 THEN scale END,6) AS scale FROM s""")
def _(t):
    return r6(C.candidate_background(t.fx_detections, ["page_id", "class_label"], 0.6), "median", "mad", "scale")


@query("score_zscore", "E14", cte("fx_detections") + BG.format(w="") + " SELECT page_id, det_id, round((score-median)/scale,5) AS z FROM fx_detections JOIN s USING (page_id, class_label)")
def _(t):
    by = ["page_id", "class_label"]
    z = C.score_zscore(t.fx_detections, C.background_stats(t.fx_detections, by), by)
    return z.select("page_id", "det_id", F.round("z", 5).alias("z"))


@query("sample_background", "D16")
def _(t):
    return C.sample_background(t.fx_detections.withColumn("key", F.concat_ws(":", "page_id", "det_id")), "key", 4096, exclude_above=0.9).select("page_id", "det_id", "score")


ISO = """st AS (SELECT score, avg(label) AS y, count(*)::DOUBLE AS w FROM fx_pairs GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY score) AS i, sum(w*y) OVER (ORDER BY score) AS sy, sum(w) OVER (ORDER BY score) AS sw FROM st),
    ab AS (SELECT a.i AS a, b.i AS b, (b.sy - a.sy + a.w*a.y)/(b.sw - a.sw + a.w) AS m FROM o a JOIN o b ON b.i >= a.i),
    mi AS (SELECT a, b AS i, min(m) OVER (PARTITION BY a ORDER BY b DESC) AS m FROM ab),
    fit AS (SELECT i, max(m) AS fitted FROM mi GROUP BY 1)"""


@query("isotonic_fit", "E13 H23", FXP + f", {ISO} SELECT pair_id, round(fitted,6) AS p FROM fx_pairs JOIN o USING (score) JOIN fit USING (i)")
def _(t):
    return C.calibrated(t.fx_pairs, C.isotonic_fit(t.fx_pairs, []), []).select("pair_id", F.round("p", 6).alias("p"))


@query("isotonic_fit_by_group", "E13", FXP + """, st AS (SELECT group_id, score, avg(label) AS y, count(*)::DOUBLE AS w FROM fx_pairs GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY score) AS i, sum(w*y) OVER (PARTITION BY group_id ORDER BY score) AS sy, sum(w) OVER (PARTITION BY group_id ORDER BY score) AS sw FROM st),
    ab AS (SELECT a.group_id, a.i AS a, b.i AS b, (b.sy - a.sy + a.w*a.y)/(b.sw - a.sw + a.w) AS m FROM o a JOIN o b ON b.group_id=a.group_id AND b.i >= a.i),
    mi AS (SELECT group_id, a, b AS i, min(m) OVER (PARTITION BY group_id, a ORDER BY b DESC) AS m FROM ab), fit AS (SELECT group_id, i, max(m) AS fitted FROM mi GROUP BY ALL)
    SELECT group_id, score, round(fitted,6) AS fitted FROM o JOIN fit USING (group_id, i)""")
def _(t):
    return r6(C.isotonic_fit(t.fx_pairs, ["group_id"]), "fitted")


def platt_sql(steps: int = 25) -> str:
    """Newton steps written out one after the other."""
    sql = FXP + """, c AS (SELECT sum(label)::DOUBLE AS np, (count(*)-sum(label))::DOUBLE AS nn FROM fx_pairs),
    x AS MATERIALIZED (SELECT score AS s, CASE WHEN label=1 THEN (np+1)/(np+2) ELSE 1/(nn+2) END AS t FROM fx_pairs, c),
    n0 AS (SELECT 0::DOUBLE AS a, ln((nn+1)/(np+1)) AS b FROM c)"""
    for i in range(1, steps):
        sql += f""", g{i} AS MATERIALIZED (SELECT a, b, sum((t-p)*s) AS g1, sum(t-p) AS g0, sum(p*(1-p)*s*s)+1e-12 AS h2, sum(p*(1-p)*s) AS h1, sum(p*(1-p))+1e-12 AS h0
        FROM (SELECT s, t, a, b, 1/(1+exp(a*s+b)) AS p FROM x, n{i-1}) GROUP BY a, b), n{i} AS MATERIALIZED (SELECT a-(g1*h0-g0*h1)/(h2*h0-h1*h1) AS a, b-(g0*h2-g1*h1)/(h2*h0-h1*h1) AS b FROM g{i})"""
    return sql + f" SELECT pair_id, round(1/(1+exp(a*score+b)),5) AS p FROM fx_pairs, n{steps-1}"


@query("platt_fit", "K7 H23", platt_sql())
def _(t):
    a, b = C.platt_fit(t.fx_pairs)
    return t.fx_pairs.select("pair_id", F.round(C.logistic(F.lit(a) * F.col("score") + F.lit(b)), 5).alias("p"))


VSCORE = "round(CAST((page_id*17 + det_id*29) % 1000 AS DOUBLE)/1000.0, 3)"


@query("verifier_filter", "B15", cte("fx_detections") + f""", v AS (SELECT *, {VSCORE} AS vs FROM fx_detections), s AS (SELECT *, CASE WHEN vs >= 0.4 THEN 'det' ELSE 'sup' END AS side FROM v)
    SELECT page_id, det_id, side || '-' || CAST(row_number() OVER (PARTITION BY page_id, side ORDER BY vs DESC, det_id) AS VARCHAR) AS out_id, vs AS score, score AS template_score FROM s""")
def _(t):
    scores = t.fx_detections.select("page_id", "det_id", F.expr(VSCORE).alias("verifier_score"))
    out = D.verifier_filter(t.fx_detections, scores, 0.4, ["page_id", "det_id"], ["page_id"], [F.desc("verifier_score"), F.asc("det_id")])
    return out.select("page_id", "det_id", "out_id", "score", "template_score")


@query("rerank_and_decide", "F8 K8", cte("fx_detections") + f""", v AS (SELECT *, {VSCORE} AS p FROM fx_detections), m AS (SELECT *, CASE det_id % 3 WHEN 0 THEN score WHEN 1 THEN p ELSE 1/(1+exp(4-8*score)) END AS val FROM v)
    SELECT page_id, det_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY p DESC, score DESC, y, x, det_id) AS INT) AS position, val >= 0.55 AS accepted FROM m""")
def _(t):
    df = t.fx_detections.withColumn("p", F.expr(VSCORE)).withColumn("verifier_p", F.col("p")).withColumn("calibrated_p", C.logistic(4 - 8 * F.col("score")))
    m = F.col("det_id") % 3
    method = F.when(m == 0, "score").when(m == 1, "verifier").otherwise("calibrated")
    return D.rerank(D.decide(df, method, F.lit(0.55)), ["page_id"]).select("page_id", "det_id", "position", "accepted")


def vecs(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), V.unit(F.col("embedding")).alias("vec"), ((F.col("label") % 2) == 0).cast("int").alias("label"),
                               F.col("label").alias("grp"), (F.col("vec_id") % 3).alias("part"))


VEC = """WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label, CASE WHEN label%2=0 THEN 1 ELSE 0 END AS pos FROM embeddings),
    u AS (SELECT id, label, pos, list_transform(e, lambda x: x/sqrt(list_dot_product(e,e))) AS vec FROM v)"""
KNN = VEC + """, s AS (SELECT q.id AS qid, t.id AS tid, t.pos, round(list_dot_product(q.vec, t.vec),9) AS sim FROM u q JOIN u t ON q.id <> t.id),
    k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, tid) AS rn FROM s QUALIFY rn <= 7)"""


def leave_one_out(t):
    """Every vector is a query and every other one its training set."""
    v = vecs(t).withColumn("part", F.col("id"))
    return v.select("id", "part", "vec"), v.select("id", "part", "vec", "label")


@query("knn_topk", "F7 J2", KNN + " SELECT qid, tid, CAST(rn AS INT) AS rn, round(sim,6) AS sim FROM k")
def _(t):
    q, tr = leave_one_out(t)
    near = V.nearest(q, tr, 7, exclude_part=True)
    return near.select(F.col("id").alias("qid"), F.posexplode("top").alias("p", "n")).select("qid", F.col("n.id").alias("tid"), (F.col("p") + 1).alias("rn"), F.round("n.sim", 6).alias("sim"))


@query("knn_vote", "K1", KNN + """, w AS (SELECT qid, pos, exp((sim - max(sim) OVER (PARTITION BY qid))/0.01) AS w FROM k)
    SELECT qid, round((coalesce(sum(w) FILTER (WHERE pos=1),0)+0.1)/(sum(w)+0.2),6) AS p FROM w GROUP BY 1""")
def _(t):
    q, tr = leave_one_out(t)
    return V.knn_vote(q, tr, exclude_part=True).select(F.col("id").alias("qid"), F.round("p", 6).alias("p"))


@query("knn_vote_augmented", "K10 K1", VEC + """, tr AS (SELECT id*4+r AS id, id AS part, pos, list_concat(vec[16*r+1:64], vec[1:16*r]) AS vec FROM u, range(4) g(r)),
    s AS (SELECT q.id AS qid, t.id AS tid, t.pos, round(list_dot_product(q.vec, t.vec),9) AS sim FROM u q JOIN tr t ON q.id <> t.part),
    k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, tid) AS rn FROM s QUALIFY rn <= 7),
    w AS (SELECT qid, pos, exp((sim - max(sim) OVER (PARTITION BY qid))/0.01) AS w FROM k)
    SELECT qid, round((coalesce(sum(w) FILTER (WHERE pos=1),0)+0.1)/(sum(w)+0.2),6) AS p FROM w GROUP BY 1""")
def _(t):
    q, tr = leave_one_out(t)
    shift = lambda r: F.concat(F.slice("vec", 16 * r + 1, 64), F.slice("vec", 1, 16 * r)) if r else F.col("vec")
    turned = tr.select("id", "part", "label", *[shift(r).alias(f"v{r * 90}") for r in range(4)])
    aug = V.rotation_augment(turned, {90 * r: f"v{r * 90}" for r in range(4)})
    return V.knn_vote(q, aug.drop("turn"), exclude_part=True).select(F.col("id").alias("qid"), F.round("p", 6).alias("p"))


@query("similarity_profile", "K2 J2", VEC + " SELECT a.label AS grp, a.id, round(avg(list_dot_product(a.vec,b.vec)),6) AS mean_similarity FROM u a JOIN u b ON a.label=b.label GROUP BY ALL")
def _(t):
    return r6(V.similarity_profile(vecs(t), "grp"), "mean_similarity")


@query("k_medoids", "K3")
def _(t):
    return V.k_medoids(vecs(t).select("grp", "id", "vec"), 4)


@query("template_bank", "K4")
def _(t):
    v = vecs(t)
    first = v.groupBy("grp").agg(F.min("id").alias("f"))
    return V.template_bank(v.join(first, "grp").select("grp", "id", "vec", (F.col("id") == F.col("f")).alias("is_original")), min_similarity=0.3)


def banks(t):
    """Per tag (a tenth of the labels' range) positives and negatives, and their banks."""
    v = vecs(t).withColumn("tag", F.col("grp") % 5)
    pos, neg = v.where("label = 1"), v.where("label = 0")
    tpl = V.template_bank(pos.select("tag", "id", "vec", F.lit(False).alias("is_original")), "tag", min_similarity=0.3)
    tpl = tpl.select("tag", F.col("template_id").alias("id")).join(v.select("tag", "id", "vec"), ["tag", "id"])
    return v, tpl, V.negative_bank(neg.select("tag", "id", "vec"), "tag")


@query("negative_bank", "K5")
def _(t):
    _, _, neg = banks(t)
    return neg.select("tag", "id")


@query("veto", "K5 C26", VEC + """, c AS (SELECT a.id, max(round(list_dot_product(a.vec,b.vec),9)) FILTER (WHERE b.pos=1) AS p, max(round(list_dot_product(a.vec,b.vec),9)) FILTER (WHERE b.pos=0) AS n
      FROM u a JOIN u b ON a.label % 5 = b.label % 5 AND a.id <> b.id GROUP BY 1)
    SELECT id, round(p,6) AS best_pos, round(n,6) AS best_neg, n > p + 0.05::DOUBLE AS vetoed FROM c""")
def _(t):
    v = vecs(t).withColumn("tag", F.col("grp") % 5).withColumn("part", F.col("id"))
    near = V.nearest(v.select("tag", "part", "id", "vec"), v.select("tag", "part", "id", "vec", "label"), 1, ["tag"], exclude_part=True)
    out = V.judge(near.withColumn("p", F.lit(1.0)), 0.05, F.lit("score"), F.lit(0.0))
    return out.select("id", F.round("best_pos", 6).alias("best_pos"), F.round("best_neg", 6).alias("best_neg"), (~F.col("accept")).alias("vetoed"))


@query("judge", "K6 K5 C26")
def _(t):
    v, tpl, neg = banks(t)
    scored = V.max_similarity(V.max_similarity(v.select("tag", "id", "vec"), tpl, "tag", "best_pos"), neg, "tag", "best_neg")
    best = V.template_candidates(v.select("tag", "id", "vec"), tpl, "tag").select("id", "template_id")
    p = V.knn_vote(v.select("tag", "part", "id", "vec"), v.select("tag", "part", "id", "vec", "label"), by=["tag"], exclude_part=True).select("id", F.col("p"))
    return V.judge(scored.join(p, "id").join(best, "id"), 0.05, F.lit("verifier"), F.lit(0.5)).select("tag", "id", "template_id", "accept", "reason")


@query("cross_check", "D30 K6", VEC + """, s AS (SELECT a.label % 5 AS grp, a.id AS qid, a.pos AS qpos, b.id AS tid, b.pos, round(list_dot_product(a.vec,b.vec),9) AS sim FROM u a JOIN u b ON a.label % 5 = b.label % 5 AND a.id % 3 <> b.id % 3),
    bn AS (SELECT qid, max(sim) FILTER (WHERE pos=1) AS bp, max(sim) FILTER (WHERE pos=0) AS bn FROM s GROUP BY 1),
    k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY sim DESC, tid) <= 7),
    w AS (SELECT grp, qid, qpos, pos, exp((sim - max(sim) OVER (PARTITION BY qid))/0.01) AS w FROM k),
    p AS (SELECT grp, qid, qpos, (coalesce(sum(w) FILTER (WHERE pos=1),0)+0.1)/(sum(w)+0.2) AS p FROM w GROUP BY ALL),
    j AS (SELECT grp, qpos, NOT (bn.bn > bn.bp + 0.05::DOUBLE) AND p >= 0.5 AS ok FROM p JOIN bn USING (qid)),
    c AS (SELECT grp, count(*) FILTER (WHERE qpos=1 AND ok) AS approved_kept, count(*) FILTER (WHERE qpos=1 AND NOT ok) AS approved_lost, count(*) FILTER (WHERE qpos=0 AND NOT ok) AS rejected_caught,
      count(*) FILTER (WHERE qpos=0 AND ok) AS rejected_missed FROM j GROUP BY 1)
    SELECT *, approved_lost*100 <= (approved_kept+approved_lost)*5 AND rejected_caught>=1 AND rejected_caught>=approved_lost AS gate_ok FROM c""")
def _(t):
    return V.cross_check(vecs(t).withColumn("grp", F.col("grp") % 5), 0.5, 0.05)


@query("score_with", "J4", VEC + " SELECT id, round(0.5*vec[1] + 0.25*vec[2] - vec[64], 6) AS s FROM u")
def _(t):
    import numpy as np

    w = np.zeros(64)
    w[0], w[1], w[63] = 0.5, 0.25, -1.0
    return vecs(t).select("id", F.round(V.score_with(lambda m: m @ w)(F.col("vec")), 6).alias("s"))


@query("train_symbol_model", "K9 K4 K5")
def _(t):
    v, tpl, neg = banks(t)
    counts = v.groupBy("tag").agg(F.count_if(F.col("label") == 1).alias("positives"), F.count_if(F.col("label") == 0).alias("negatives"))
    n_tpl = tpl.groupBy("tag").agg(F.count(F.lit(1)).alias("templates"))
    n_neg = neg.groupBy("tag").agg(F.count(F.lit(1)).alias("negative_bank"))
    scored = V.max_similarity(v.select("tag", "id", "vec", "label"), tpl, "tag", "score")
    sug = curves.suggest_threshold(scored.select("tag", "score", "label"), ["tag"], 0.9).select("tag", F.col("value").alias("suggested"), "reason")
    iso = C.isotonic_fit(scored.select("tag", "score", "label"), ["tag"]).groupBy("tag").agg(F.count_distinct("fitted").alias("calibration_steps"))
    stats = counts.join(n_tpl, "tag", "left").join(n_neg, "tag", "left").join(sug, "tag", "left").join(iso, "tag", "left")
    return V.decision_rule(stats)


@query("common_size", "D23", """WITH n AS (SELECT p_brand, p_size AS h, CAST(length(p_name) AS INT) AS w, count(*) AS n FROM part GROUP BY ALL)
    SELECT p_brand, h, w, n FROM n QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, h*w DESC, h DESC, w DESC)=1""")
def _(t):
    return V.common_size(t.part.select("p_brand", F.col("p_size").alias("h"), F.length("p_name").alias("w")), ["p_brand"])
