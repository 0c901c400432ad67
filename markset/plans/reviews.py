"""Review-log queries: labels, audits, queues, roll-ups, activity."""

from __future__ import annotations

from pyspark.sql import functions as F

from markset.fixtures import cte
from markset.operators import reviews as R
from markset.plans.registry import query

LABELS = """lab AS (SELECT p.*, e.last_action, e.n_rev, e.last_seq, e.add_seq FROM fx_pins p LEFT JOIN (SELECT scan_id, pin_id,
      max_by(action, seq) FILTER (WHERE action IN ('approve','reject')) AS last_action, max(seq) FILTER (WHERE action IN ('approve','reject')) AS last_seq,
      count(*) FILTER (WHERE action IN ('approve','reject')) AS n_rev, min(seq) FILTER (WHERE action='add_manual') AS add_seq
      FROM fx_events GROUP BY 1,2) e USING (scan_id, pin_id)),
    labels_c AS (SELECT scan_id, pin_id, origin, state, class_label, x, y, detection_id, CASE WHEN origin='machine' THEN CASE last_action WHEN 'approve' THEN 'positive' WHEN 'reject' THEN 'negative' END
        WHEN state <> 'removed' THEN 'positive' END AS label,
      CASE WHEN origin='machine' THEN CASE WHEN coalesce(n_rev,0)=0 THEN 'unlabeled' WHEN n_rev=1 THEN 'reviewed' ELSE 're-reviewed' END
        WHEN state='removed' THEN 'manual_removed' ELSE 'manual_added' END AS label_status,
      coalesce(CASE WHEN origin='machine' THEN last_seq ELSE add_seq END, -1) AS label_event FROM lab)"""
FXR = cte("fx_scans", "fx_pins", "fx_pin_detections", "fx_splits", "fx_page_reviews", "fx_pin_events")
LATEST = """latest AS (SELECT * FROM fx_scans QUALIFY row_number() OVER (PARTITION BY canonical_page_id ORDER BY recorded_us DESC, record_seq DESC)=1)"""


def labels_of(t):
    return R.pin_labels(t.fx_pins, t.fx_events)


def crops_of(t):
    """Labelled pins with a crop key shared by the scans of a page."""
    j = labels_of(t).join(t.fx_scans.select("scan_id", "canonical_page_id", "document_id", "template_id"), "scan_id")
    return j.withColumn("crop_key", F.concat_ws("/", "canonical_page_id", F.col("pin_id").cast("string")))


CROPS = f"""{LABELS}, crops_c AS (SELECT l.*, s.canonical_page_id, s.document_id, s.template_id, s.canonical_page_id || '/' || CAST(l.pin_id AS VARCHAR) AS crop_key
    FROM labels_c l JOIN fx_scans s USING (scan_id))"""


@query("pin_labels", "E2", FXR + f", {LABELS} SELECT scan_id, pin_id, coalesce(label,'none') AS label, label_status, label_event FROM labels_c")
def _(t):
    return labels_of(t).select("scan_id", "pin_id", F.coalesce("label", F.lit("none")).alias("label"), "label_status",
                               F.coalesce("label_event", F.lit(-1)).alias("label_event"))


@query("latest_scan_per_page", "E1", FXR + f", {LATEST} SELECT canonical_page_id, scan_id, recorded_us FROM latest")
def _(t):
    return R.latest_scan_per_page(t.fx_scans).select("canonical_page_id", "scan_id", "recorded_us")


@query("latest_scan_pins", "C12", FXR + f", {LATEST} SELECT p.scan_id, p.pin_id, p.state FROM fx_pins p WHERE EXISTS (SELECT 1 FROM latest l WHERE l.scan_id=p.scan_id)")
def _(t):
    return t.fx_pins.join(R.latest_scan_per_page(t.fx_scans), "scan_id", "left_semi").select("scan_id", "pin_id", "state")


@query("pin_versions", "E17", FXR + """, m AS (SELECT *, lag(action) OVER (PARTITION BY scan_id, pin_id ORDER BY seq) AS b FROM fx_pin_events WHERE origin='machine' AND action IN ('approve','reject')),
    a AS (SELECT scan_id, pin_id, min(seq) AS s FROM fx_pin_events WHERE origin='manual' AND action='add_manual' GROUP BY 1,2)
    SELECT scan_id, pin_id, 1 + count(*) FILTER (WHERE b IS NULL OR b <> action) AS version, count(*) FILTER (WHERE b = action) AS noops FROM m GROUP BY 1,2
    UNION ALL SELECT a.scan_id, a.pin_id, 1 + CASE WHEN EXISTS (SELECT 1 FROM fx_pin_events e WHERE e.scan_id=a.scan_id AND e.pin_id=a.pin_id AND e.action='remove_manual' AND e.seq>a.s) THEN 1 ELSE 0 END, 0 FROM a""")
def _(t):
    return R.pin_versions(t.fx_pin_events)


@query("check_transitions", "B13", FXR + """, a AS (SELECT scan_id, pin_id, min(seq) AS s FROM fx_pin_events WHERE origin='manual' AND action='add_manual' GROUP BY 1,2),
    r AS (SELECT e.scan_id, e.pin_id, min(seq) AS q FROM fx_pin_events e JOIN a USING (scan_id, pin_id) WHERE action='remove_manual' AND seq > a.s GROUP BY 1,2),
    z AS (SELECT e.seq, e.action, CASE WHEN origin='machine' AND action='add_manual' THEN 'already_exists' WHEN origin='machine' AND action='remove_manual' THEN 'not_manual'
      WHEN origin='machine' THEN NULL WHEN a.s IS NULL OR e.seq < a.s THEN 'not_found' WHEN action IN ('approve','reject') THEN 'not_machine'
      WHEN action='add_manual' AND e.seq > a.s THEN 'already_exists' WHEN action='remove_manual' AND e.seq > r.q THEN 'already_removed' END AS reason
      FROM fx_pin_events e LEFT JOIN a USING (scan_id, pin_id) LEFT JOIN r USING (scan_id, pin_id)) SELECT * FROM z WHERE reason IS NOT NULL""")
def _(t):
    return R.check_transitions(t.fx_pin_events).select("seq", "action", "reason")


ASSIGN = "asg AS (SELECT o_orderkey AS seq, 'doc-' || CAST(o_custkey AS VARCHAR) AS document_id, CASE o_orderkey % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'val' WHEN 2 THEN 'test' ELSE 'eval' END AS split FROM orders)"


@query("check_split_moves", "B16", f"""WITH {ASSIGN}, l AS (SELECT *, lag(split) OVER (PARTITION BY document_id ORDER BY seq) AS before FROM asg)
    SELECT seq, document_id, before, split FROM l WHERE before IN ('test','eval') AND before <> split""")
def _(t):
    m = F.col("o_orderkey") % 4
    a = t.orders.select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("doc-"), F.col("o_custkey").cast("string")).alias("document_id"),
                        F.when(m == 0, "train").when(m == 1, "val").when(m == 2, "test").otherwise("eval").alias("split"))
    return R.check_split_moves(a).select("seq", "document_id", "before", "split")


@query("page_completeness", "B12 H22", FXR + f""", {LATEST}, o AS (SELECT scan_id, count(*) AS n FROM fx_pins WHERE origin='machine' AND state='unreviewed' GROUP BY 1)
    SELECT l.canonical_page_id, l.scan_id, coalesce(o.n,0) AS unreviewed, coalesce(r.status='complete', FALSE) AND coalesce(o.n,0)=0 AS complete,
      CAST(regexp_extract(l.canonical_page_id, '#p(\\d+)$', 1) AS INT) AS page_index
    FROM latest l LEFT JOIN o USING (scan_id) LEFT JOIN fx_page_reviews r USING (canonical_page_id)""")
def _(t):
    from markset.functions.text import page_index_of

    out = R.page_completeness(t.fx_scans, t.fx_pins, t.fx_page_reviews)
    return out.select("canonical_page_id", "scan_id", "unreviewed", "complete", page_index_of(F.col("canonical_page_id")).alias("page_index"))


@query("snapshot_counts", "C9 B6", FXR + """, s AS (SELECT s.*, sp.split FROM fx_scans s LEFT JOIN fx_splits sp USING (document_id) WHERE sp.split IS NULL OR sp.split NOT IN ('test','eval'))
    SELECT split, (SELECT count(*) FROM s x WHERE x.split=s.split) AS scans, count(p.pin_id) AS pins FROM s JOIN fx_pins p USING (scan_id) GROUP BY split""")
def _(t):
    picked = R.exclude_held_out(t.fx_scans, t.fx_splits)
    snap = R.snapshot(picked, t.fx_splits, {"pins": t.fx_pins})
    scans = snap["scans"].groupBy("split").agg(F.count(F.lit(1)).alias("scans"))
    pins = snap["pins"].join(snap["scans"].select("scan_id", "split"), "scan_id").groupBy("split").agg(F.count(F.lit(1)).alias("pins"))
    return scans.join(pins, "split")


@query("review_pairs", "C10 B6", FXR + """ SELECT p.scan_id, p.pin_id, d.score, CASE p.state WHEN 'approved' THEN 1 ELSE 0 END AS label
    FROM fx_pins p JOIN fx_pin_detections d ON d.scan_id=p.scan_id AND d.detection_id=p.detection_id JOIN fx_scans s ON s.scan_id=p.scan_id LEFT JOIN fx_splits sp ON sp.document_id=s.document_id
    WHERE p.origin='machine' AND p.state IN ('approved','rejected') AND (sp.split IS NULL OR sp.split NOT IN ('test','eval'))""")
def _(t):
    return R.review_pairs(t.fx_pins, t.fx_pin_detections, t.fx_scans, t.fx_splits).select("scan_id", "pin_id", "score", "label")


QUEUE = """q AS (SELECT p.scan_id, p.pin_id, d.score, d.det_seq, s.page_index, s.document_version, s.canonical_page_id,
      coalesce(TRY_CAST(json_extract_string(s.detector_settings,'$.threshold') AS DOUBLE), min(d.score) OVER (PARTITION BY p.scan_id)) AS threshold
    FROM fx_pins p JOIN fx_pin_detections d ON d.scan_id=p.scan_id AND d.detection_id=p.detection_id JOIN {scans} s ON s.scan_id=p.scan_id WHERE p.origin='machine' AND p.state='unreviewed')"""


@query("review_queue", "F1 H21", FXR + ", " + QUEUE.format(scans="fx_scans") + " SELECT scan_id, pin_id, score, round(abs(score-threshold),6) AS margin FROM q")
def _(t):
    q = R.review_queue(t.fx_pins, t.fx_pin_detections, t.fx_scans)
    return q.select("scan_id", "pin_id", "score", F.round("margin", 6).alias("margin"))


@query("review_queue_top", "F1 C12", FXR + f", {LATEST}, " + QUEUE.format(scans="latest") + """ SELECT scan_id, pin_id, score, round(abs(score-threshold),6) AS margin FROM q
    ORDER BY abs(score-threshold), document_version, page_index, det_seq LIMIT 50""")
def _(t):
    latest = R.latest_scan_per_page(t.fx_scans)
    q = R.review_queue(t.fx_pins, t.fx_pin_detections, latest, limit=50, position=["document_version", "page_index"])
    return q.select("scan_id", "pin_id", "score", F.round("margin", 6).alias("margin"))


@query("batch_review_queue", "C11 F1", cte("fx_batch_pages", "fx_scans", "fx_pins", "fx_pin_detections") + """
    SELECT b.batch_id, b.position, p.scan_id, p.pin_id, d.score FROM fx_batch_pages b JOIN fx_scans s USING (scan_id) JOIN fx_pins p ON p.scan_id=s.scan_id
    JOIN fx_pin_detections d ON d.scan_id=p.scan_id AND d.detection_id=p.detection_id WHERE b.status='done' AND p.origin='machine' AND p.state='unreviewed'""")
def _(t):
    done = t.fx_batch_pages.where("status = 'done'").select("batch_id", "position", "scan_id")
    q = R.review_queue(t.fx_pins, t.fx_pin_detections, t.fx_scans.join(done, "scan_id"), strategy="lowest_score", position=["batch_id", "position"])
    return q.select("batch_id", "position", "scan_id", "pin_id", "score")


@query("batch_rollup", "D6", cte("fx_batch_pages", "fx_pins", "fx_scans", "fx_page_reviews") + """,
    pc AS (SELECT scan_id, count(*) FILTER (WHERE state='approved') AS approved, count(*) FILTER (WHERE state='unreviewed') AS unreviewed, count(*) AS total FROM fx_pins GROUP BY 1),
    cs AS (SELECT scan_id FROM fx_scans JOIN fx_page_reviews r USING (canonical_page_id) WHERE r.status='complete'),
    g AS (SELECT batch_id, count(*) FILTER (WHERE status='pending') AS pages_pending, count(*) FILTER (WHERE status='running') AS pages_running, count(*) FILTER (WHERE status='done') AS pages_done,
      count(*) AS pages_total, CAST(coalesce(sum(approved),0) AS BIGINT) AS approved, CAST(coalesce(sum(unreviewed),0) AS BIGINT) AS unreviewed, CAST(coalesce(sum(total),0) AS BIGINT) AS total,
      count(*) FILTER (WHERE b.scan_id IN (SELECT scan_id FROM cs)) AS review_complete FROM fx_batch_pages b LEFT JOIN pc USING (scan_id) GROUP BY 1)
    SELECT *, CASE WHEN pages_running>0 OR (pages_pending>0 AND pages_total>pages_pending) THEN 'running' WHEN pages_pending>0 THEN 'queued' ELSE 'complete' END AS batch_status FROM g""")
def _(t):
    pc = t.fx_pins.groupBy("scan_id").agg(F.count_if(F.col("state") == "approved").alias("approved"), F.count_if(F.col("state") == "unreviewed").alias("unreviewed"), F.count(F.lit(1)).alias("total"))
    cs = t.fx_scans.join(t.fx_page_reviews.where("status = 'complete'"), "canonical_page_id", "left_semi")
    return R.batch_rollup(t.fx_batch_pages, pc, cs).drop("pages_failed", "pages_cancelled")


@query("pin_summary", "D3", FXR + " SELECT scan_id, origin, state, count(*) AS n FROM fx_pins GROUP BY ALL")
def _(t):
    return R.pin_summary(t.fx_pins)


@query("page_scan_history", "D35", FXR + """, c AS (SELECT scan_id, count(*) FILTER (WHERE state='unreviewed') AS unreviewed, count(*) FILTER (WHERE state='approved') AS approved,
      count(*) FILTER (WHERE state='rejected') AS rejected, count(*) FILTER (WHERE state='added') AS added, count(*) FILTER (WHERE state='removed') AS removed FROM fx_pins GROUP BY 1)
    SELECT canonical_page_id, scan_id, recorded_us, CAST(row_number() OVER (PARTITION BY canonical_page_id ORDER BY recorded_us, record_seq) AS INT) AS position, unreviewed, approved, rejected, added, removed FROM fx_scans JOIN c USING (scan_id)""")
def _(t):
    return R.page_scan_history(t.fx_scans, t.fx_pins)


@query("review_counts", "D2 A9 H18", FXR + """, j AS (SELECT p.*, d.found_label, s.page_index FROM fx_pins p LEFT JOIN fx_pin_detections d ON d.scan_id=p.scan_id AND d.detection_id=p.detection_id JOIN fx_scans s ON s.scan_id=p.scan_id),
    u AS (SELECT page_index, class_label AS tag, 0 AS found, CASE WHEN origin='machine' AND state='approved' THEN 1 ELSE 0 END AS approved, CASE WHEN origin='machine' AND state='rejected' THEN 1 ELSE 0 END AS rejected,
        CASE WHEN origin='manual' AND state='added' THEN 1 ELSE 0 END AS added, CASE WHEN origin='machine' AND state='unreviewed' THEN 1 ELSE 0 END AS unreviewed FROM j
      UNION ALL SELECT page_index, coalesce(found_label, class_label), 1,0,0,0,0 FROM j WHERE origin='machine'),
    v AS (SELECT CAST(page_index+1 AS VARCHAR) AS sheet, * EXCLUDE page_index FROM u UNION ALL SELECT 'All sheets', * EXCLUDE page_index FROM u)
    SELECT sheet, '''=' || tag AS tag, CAST(sum(found) AS BIGINT) AS found, CAST(sum(approved) AS BIGINT) AS approved, CAST(sum(rejected) AS BIGINT) AS rejected, CAST(sum(added) AS BIGINT) AS added,
      CAST(sum(unreviewed) AS BIGINT) AS unreviewed, CAST(sum(approved)+sum(added) AS BIGINT) AS confirmed FROM v GROUP BY sheet, tag""")
def _(t):
    from markset.functions.text import csv_cell

    out = R.review_counts(t.fx_pins, t.fx_pin_detections, t.fx_scans)
    return out.withColumn("tag", csv_cell(F.concat(F.lit("="), "tag")))


@query("activity_by_person", "D4", FXR + """ SELECT reviewer, count(*) FILTER (WHERE action='approve') AS approve, count(*) FILTER (WHERE action='reject') AS reject, count(*) FILTER (WHERE action='add_manual') AS add_manual,
    count(*) FILTER (WHERE action='remove_manual') AS remove_manual, count(DISTINCT (scan_id, pin_id)) AS pins, min(created_us) AS first_us, max(created_us) AS last_us FROM fx_events GROUP BY 1""")
def _(t):
    return R.activity_by_person(t.fx_events)


@query("hourly_activity", "D4", FXR + " SELECT reviewer, CAST(floor(created_us/3600000000) AS BIGINT) AS hour, count(*) AS actions FROM fx_events GROUP BY ALL")
def _(t):
    return R.hourly_activity(t.fx_events)


@query("daily_activity", "D32", FXR + """, h AS (SELECT CAST(floor((floor(created_us/3600000000) + 9)/24) AS BIGINT) AS day, count(*) AS actions FROM fx_events GROUP BY 1)
    SELECT d AS day, coalesce(actions,0) AS actions FROM range(19720, 19760) r(d) LEFT JOIN h ON h.day=d""")
def _(t):
    return R.daily_activity(R.hourly_activity(t.fx_events), 9, 19720, 19759)


@query("site_activity", "D5", FXR + " SELECT reviewer AS actor, action, count(*) AS n, max(created_us) AS last_us FROM fx_events GROUP BY ALL")
def _(t):
    return R.site_activity(t.fx_events.select(F.col("reviewer").alias("actor"), "action", F.col("created_us").alias("at_us")))


@query("team_progress", "C22 G7 D4 D5", FXR + """, mem AS (SELECT 'u' || CAST(n_nationkey AS VARCHAR) || '@x.org' AS person, CASE WHEN n_nationkey=0 THEN 'admin' ELSE 'member' END AS role FROM nation WHERE n_nationkey % 2 = 0),
    rev AS (SELECT reviewer AS person, count(*) AS actions FROM fx_events GROUP BY 1),
    pg AS (SELECT reviewer AS person, count(*) AS pages_complete FROM fx_page_reviews WHERE status='complete' GROUP BY 1),
    sc AS (SELECT nullif(requested_by,'u3@x.org') AS person, count(*) AS scans, count(DISTINCT canonical_page_id) AS pages FROM fx_scans GROUP BY 1),
    up AS (SELECT CASE o_custkey % 3 WHEN 0 THEN 'batch-job' ELSE 'u' || CAST(o_custkey % 23 AS VARCHAR) || '@x.org' END AS person, count(*) AS uploads FROM orders GROUP BY 1),
    keys AS (SELECT person FROM mem UNION SELECT person FROM rev UNION SELECT person FROM pg UNION SELECT person FROM sc UNION SELECT person FROM up)
    SELECT coalesce(k.person,'(nobody)') AS person, m.person IS NOT NULL AS member, coalesce(m.role,'-') AS role, coalesce(actions,0) AS actions, coalesce(pages_complete,0) AS pages_complete, coalesce(scans,0) AS scans, coalesce(pages,0) AS pages, coalesce(uploads,0) AS uploads,
      CASE WHEN m.person IS NOT NULL THEN 0 WHEN k.person IS NOT NULL THEN 1 ELSE 2 END AS sort_group
    FROM keys k LEFT JOIN mem m ON m.person IS NOT DISTINCT FROM k.person LEFT JOIN rev ON rev.person IS NOT DISTINCT FROM k.person LEFT JOIN pg ON pg.person IS NOT DISTINCT FROM k.person
      LEFT JOIN sc ON sc.person IS NOT DISTINCT FROM k.person LEFT JOIN up ON up.person IS NOT DISTINCT FROM k.person
    WHERE m.person IS NOT NULL OR k.person IS NULL OR contains(k.person,'@')""")
def _(t):
    person = lambda n: F.concat(F.lit("u"), n.cast("string"), F.lit("@x.org"))
    mem = t.nation.where("n_nationkey % 2 = 0").select(person(F.col("n_nationkey")).alias("person"), F.when(F.col("n_nationkey") == 0, "admin").otherwise("member").alias("role"))
    rev = t.fx_events.groupBy(F.col("reviewer").alias("person")).agg(F.count(F.lit(1)).alias("actions"))
    pg = t.fx_page_reviews.where("status = 'complete'").groupBy(F.col("reviewer").alias("person")).agg(F.count(F.lit(1)).alias("pages_complete"))
    sc = R.scan_activity(t.fx_scans.withColumn("requested_by", F.nullif("requested_by", F.lit("u3@x.org")))).select(F.col("requested_by").alias("person"), "scans", "pages")
    up = t.orders.groupBy(F.when(F.col("o_custkey") % 3 == 0, "batch-job").otherwise(person(F.col("o_custkey") % 23)).alias("person")).agg(F.count(F.lit(1)).alias("uploads"))
    out = R.team_progress(mem, rev, pg, sc, up)
    return out.withColumn("person", F.coalesce("person", F.lit("(nobody)"))).fillna("-", ["role"])


@query("readiness", "D14", FXR + f""", {LATEST}, ps AS (SELECT scan_id, count(*) FILTER (WHERE (origin='machine' AND state='approved') OR (origin='manual' AND state='added')) AS pos, count(*) FILTER (WHERE origin='machine' AND state='rejected') AS neg,
      count(*) FILTER (WHERE origin='machine' AND state='unreviewed') AS open FROM fx_pins GROUP BY 1),
    j AS (SELECT * FROM fx_scans JOIN ps USING (scan_id)),
    c AS (SELECT l.document_id, ps.pos FROM latest l JOIN ps USING (scan_id) JOIN fx_page_reviews r ON r.canonical_page_id=l.canonical_page_id WHERE r.status='complete' AND ps.open=0),
    k AS (SELECT 'verifier' AS model, 'positive labels' AS check_name, CAST(sum(pos) AS BIGINT) AS have, 100::BIGINT AS need FROM j UNION ALL SELECT 'verifier','negative labels',CAST(sum(neg) AS BIGINT),100 FROM j
      UNION ALL SELECT 'verifier','documents with labels',count(DISTINCT document_id) FILTER (WHERE pos+neg>0),10 FROM j UNION ALL SELECT 'detector','complete pages',count(*),30 FROM c
      UNION ALL SELECT 'detector','points on complete pages',CAST(coalesce(sum(pos),0) AS BIGINT),300 FROM c UNION ALL SELECT 'detector','documents with complete pages',count(DISTINCT document_id),10 FROM c)
    SELECT *, have >= need AS ok FROM k""")
def _(t):
    return R.readiness(t.fx_scans, t.fx_pins, t.fx_page_reviews)


@query("label_conflicts", "D20", FXR + f", {CROPS} SELECT crop_key, count(*) FILTER (WHERE label='positive') AS positives, count(*) FILTER (WHERE label='negative') AS negatives FROM crops_c GROUP BY 1 HAVING count(DISTINCT label) > 1")
def _(t):
    return R.label_conflicts(crops_of(t))


@query("training_crops", "G2 G1", FXR + f""", {CROPS}, ok AS (SELECT crop_key FROM crops_c WHERE label IS NOT NULL GROUP BY 1 HAVING count(DISTINCT label) = 1)
    SELECT crop_key, label, scan_id, pin_id FROM crops_c JOIN ok USING (crop_key) WHERE label IS NOT NULL QUALIFY row_number() OVER (PARTITION BY crop_key ORDER BY scan_id, pin_id)=1""")
def _(t):
    c = crops_of(t)
    pos, neg = R.training_crops(c, "positive"), R.training_crops(c, "negative")
    return pos.unionByName(neg).select("crop_key", "label", "scan_id", "pin_id")


@query("symbol_training_rows", "D28", FXR + f""", {CROPS}, ok AS (SELECT crop_key FROM crops_c WHERE label IS NOT NULL GROUP BY 1 HAVING count(DISTINCT label) = 1),
    f AS (SELECT * FROM crops_c JOIN ok USING (crop_key) WHERE label IS NOT NULL QUALIFY row_number() OVER (PARTITION BY crop_key ORDER BY scan_id, pin_id)=1)
    SELECT class_label, count(*) FILTER (WHERE label='positive' AND origin='machine') AS approved, count(*) FILTER (WHERE label='positive' AND origin='manual') AS added,
      count(*) FILTER (WHERE label='negative') AS rejected, count(DISTINCT (document_id, canonical_page_id)) AS sheets, count(DISTINCT document_id) AS documents FROM f GROUP BY 1""")
def _(t):
    return R.symbol_training_rows(R.training_crops(crops_of(t)))


@query("crop_status_counts", "D24", FXR + f", {CROPS} SELECT label_status AS status, class_label, count(*) AS n FROM crops_c GROUP BY ALL")
def _(t):
    return crops_of(t).groupBy(F.col("label_status").alias("status"), "class_label").agg(F.count(F.lit(1)).alias("n"))


HIST = "hist AS (SELECT event_id AS seq, CASE user_id % 2 WHEN 0 THEN 'verifier' ELSE 'detector' END || CAST(user_id % 5 AS VARCHAR) AS kind, CASE event_type WHEN 'purchase' THEN 'promote' WHEN 'error' THEN 'deactivate' ELSE 'register' END AS action, 'm' || CAST(event_id AS VARCHAR) AS model_id FROM events)"


@query("active_model", "E20", f"""WITH {HIST}, a AS (SELECT * FROM hist WHERE action <> 'register'), l AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY kind ORDER BY seq DESC)=1)
    SELECT l.kind, l.seq AS changed_seq, CASE WHEN l.action='promote' THEN l.model_id ELSE '-' END AS active_model,
      (SELECT max_by(model_id, seq) FROM a WHERE a.kind=l.kind AND a.action='promote' AND a.seq<l.seq) AS previous_model FROM l""")
def _(t):
    h = t.events.select(F.col("event_id").alias("seq"), F.concat(F.when(F.col("user_id") % 2 == 0, "verifier").otherwise("detector"), (F.col("user_id") % 5).cast("string")).alias("kind"),
                        F.when(F.col("event_type") == "purchase", "promote").when(F.col("event_type") == "error", "deactivate").otherwise("register").alias("action"),
                        F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("model_id"))
    return R.active_model(h).fillna("-", ["active_model"])


DEAD = "SELECT document_version FROM fx_scans GROUP BY 1 HAVING min(recorded_us) % 2 = 0"


def dead_of(t):
    return t.fx_scans.groupBy("document_version").agg(F.min("recorded_us").alias("m")).where("m % 2 = 0").select("document_version")


@query("dependents_of_document", "C24", FXR + f" SELECT scan_id, canonical_page_id FROM fx_scans WHERE document_version IN ({DEAD})")
def _(t):
    return R.dependents_of_document(t.fx_scans, dead_of(t)).select("scan_id", "canonical_page_id")


@query("alive_documents", "C15", FXR + f" SELECT scan_id, canonical_page_id, document_version FROM fx_scans WHERE document_version NOT IN ({DEAD})")
def _(t):
    kept = t.fx_scans.select("document_version").distinct().join(dead_of(t), "document_version", "left_anti")
    return R.alive_rows(t.fx_scans, kept, "canonical_page_id").select("scan_id", "canonical_page_id", "document_version")


@query("window_start", "H26", FXR + " SELECT seq, strftime(make_timestamp(created_us - created_us % 86400000000) - to_days(CAST(seq % 45 AS INT)), '%Y-%m-%dT00:00:00.000Z') AS since FROM fx_events")
def _(t):
    return t.fx_events.select("seq", R.window_start(F.col("created_us"), F.col("seq") % 45).alias("since"))


ZONE = "America/New_York"


@query("daily_activity_zone", "D32 H26", FXR + f""", h AS (SELECT CAST(timezone('{ZONE}', make_timestamptz(CAST(floor(created_us/3600000000) AS BIGINT) * 3600000000)) AS DATE) AS day, count(*) AS actions FROM fx_events GROUP BY 1),
    d AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM h)
    SELECT CAST(d.day AS VARCHAR) AS day, coalesce(actions, 0) AS actions FROM d LEFT JOIN h USING (day)""")
def _(t):
    return R.daily_activity_in(R.hourly_activity(t.fx_events), ZONE).select(F.col("day").cast("string").alias("day"), "actions")


@query("audit_tail", "F9", FXR + " SELECT seq, action, reviewer FROM fx_events WHERE action <> 'approve' ORDER BY seq DESC LIMIT 200")
def _(t):
    return t.fx_events.where("action <> 'approve'").orderBy(F.desc("seq")).limit(200).select("seq", "action", "reviewer")


@query("page_report", "A16", FXR + """ SELECT 'original' AS provenance, scan_id, detection_id AS item_id, 'machine' AS origin, score FROM fx_pin_detections
    UNION ALL SELECT 'corrected', p.scan_id, p.pin_id, p.origin, d.score FROM fx_pins p LEFT JOIN fx_pin_detections d ON d.scan_id=p.scan_id AND d.detection_id=p.detection_id
    WHERE (p.origin='machine' AND p.state='approved') OR (p.origin='manual' AND p.state='added')""")
def _(t):
    from markset.sources.exports import page_report

    return page_report(t.fx_pins, t.fx_pin_detections)
