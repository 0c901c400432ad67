"""Streaming queries over the event table; each equals its batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from markset.fixtures import cte
from markset.plans.datasets import scratch
from markset.plans.registry import query
from markset.streaming import operators as S

FXE = cte("fx_pin_events")


def event_stream(t):
    """The events as a file stream, in the shape of the review log."""
    raw = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    k = F.col("event_id")
    act = (F.when(F.col("event_type").isin("purchase", "click"), "approve").when(F.col("event_type") == "error", "reject")
           .when(F.col("event_type") == "signup", "add_manual").otherwise("remove_manual"))
    pin = k % 13
    return raw.select(k.alias("seq"), (k - F.when((k % 17 == 0) & (k > 0), 1).otherwise(0)).alias("request_id"), F.col("user_id").alias("scan_id"), pin.alias("pin_id"), act.alias("action"),
                      F.concat(F.lit("u"), (F.col("user_id") % 11).cast("string"), F.lit("@x.org")).alias("reviewer"), F.col("ts").cast("timestamp").alias("created_at"), F.col("event_type").alias("kind_raw"),
                      F.when(pin % 5 == 0, "manual").otherwise("machine").alias("origin"), act.alias("request_sha"))


def finished(t, df, name, mode="append"):
    path = scratch(t, name)
    S.run_to_end(df, path, mode)
    return t.spark.read.parquet(path)


@query("stream_dedupe_requests", "I1", FXE + " SELECT DISTINCT request_id FROM fx_pin_events")
def _(t):
    return finished(t, S.dedupe_requests(event_stream(t)).select("request_id"), "dedupe").select("request_id")


@query("stream_request_outcomes", "I1 I2", FXE + """, f AS (SELECT *, first_value(action) OVER (PARTITION BY request_id ORDER BY seq) AS fa, row_number() OVER (PARTITION BY request_id ORDER BY seq) AS rn FROM fx_pin_events)
    SELECT request_id, seq, CASE WHEN rn=1 THEN 'fresh' WHEN action=fa THEN 'replay' ELSE 'conflict' END AS outcome FROM f""")
def _(t):
    return finished(t, S.request_outcomes(event_stream(t).select("request_id", "seq", "request_sha")), "requests").select("request_id", "seq", "outcome")


@query("stream_pin_state", "I2 E17 E2", FXE + """, m AS (SELECT *, lag(action) OVER (PARTITION BY scan_id, pin_id ORDER BY seq) AS b FROM fx_pin_events WHERE origin='machine' AND action IN ('approve','reject')),
    mv AS (SELECT scan_id, pin_id, 1 + count(*) FILTER (WHERE b IS NULL OR b<>action) AS version, CASE max_by(action, seq) WHEN 'approve' THEN 'approved' ELSE 'rejected' END AS state FROM m GROUP BY 1,2),
    a AS (SELECT scan_id, pin_id, min(seq) AS s FROM fx_pin_events WHERE origin='manual' AND action='add_manual' GROUP BY 1,2),
    r AS (SELECT DISTINCT e.scan_id, e.pin_id FROM fx_pin_events e JOIN a USING (scan_id, pin_id) WHERE action='remove_manual' AND seq > s),
    k AS (SELECT DISTINCT scan_id, pin_id, origin FROM fx_pin_events)
    SELECT k.scan_id, k.pin_id, CASE WHEN origin='machine' THEN coalesce(mv.state,'unreviewed') WHEN a.s IS NULL THEN 'absent' WHEN r.scan_id IS NOT NULL THEN 'removed' ELSE 'added' END AS state,
      CASE WHEN origin='machine' THEN coalesce(mv.version,1) WHEN a.s IS NULL THEN 0 WHEN r.scan_id IS NOT NULL THEN 2 ELSE 1 END AS version
    FROM k LEFT JOIN mv USING (scan_id, pin_id) LEFT JOIN a USING (scan_id, pin_id) LEFT JOIN r USING (scan_id, pin_id)""")
def _(t):
    out = finished(t, S.pin_states(event_stream(t).select("scan_id", "pin_id", "origin", "seq", "action")), "pins")
    last = out.groupBy("scan_id", "pin_id").agg(F.max_by(F.struct("state", "version"), "seq").alias("l"))
    return last.select("scan_id", "pin_id", "l.state", "l.version")


@query("stream_pin_violations", "I2 B13", FXE + """, a AS (SELECT scan_id, pin_id, min(seq) AS s FROM fx_pin_events WHERE origin='manual' AND action='add_manual' GROUP BY 1,2),
    r AS (SELECT e.scan_id, e.pin_id, min(seq) AS q FROM fx_pin_events e JOIN a USING (scan_id, pin_id) WHERE action='remove_manual' AND seq > a.s GROUP BY 1,2),
    z AS (SELECT e.seq, CASE WHEN origin='machine' AND action='add_manual' THEN 'already_exists' WHEN origin='machine' AND action='remove_manual' THEN 'not_manual'
      WHEN origin='machine' THEN NULL WHEN a.s IS NULL OR e.seq < a.s THEN 'not_found' WHEN action IN ('approve','reject') THEN 'not_machine'
      WHEN action='add_manual' AND e.seq > a.s THEN 'already_exists' WHEN action='remove_manual' AND e.seq > r.q THEN 'already_removed' END AS issue
      FROM fx_pin_events e LEFT JOIN a USING (scan_id, pin_id) LEFT JOIN r USING (scan_id, pin_id)) SELECT * FROM z WHERE issue IS NOT NULL""")
def _(t):
    out = finished(t, S.pin_states(event_stream(t).select("scan_id", "pin_id", "origin", "seq", "action")), "issues")
    return out.where("issue NOT IN ('', 'noop')").select("seq", "issue")


@query("stream_hourly_activity", "I3 D4", FXE + " SELECT reviewer, CAST(floor(created_us/3600000000) AS BIGINT) AS hour, count(*) AS actions FROM fx_pin_events GROUP BY ALL")
def _(t):
    out = finished(t, S.hourly_activity(event_stream(t)), "hourly", "update")
    # an hour that grew over several micro-batches is written once per batch: the last one counts
    last = out.groupBy("reviewer", "hour_start").agg(F.max_by("actions", "batch_id").alias("actions"))
    return last.select("reviewer", F.floor(F.unix_seconds("hour_start") / 3600).alias("hour"), "actions")


@query("stream_record_scans", "I4 A1", cte("fx_scans", "fx_page_reviews") + """ SELECT scan_id, canonical_page_id, canonical_page_id IN (SELECT canonical_page_id FROM fx_page_reviews WHERE status='complete') AS reopens FROM fx_scans""")
def _(t):
    target = scratch(t, "recorded")
    ev = event_stream(t)
    page = F.floor(F.col("scan_id") / 3)
    cpid = F.concat(F.lit("sha256:d"), F.floor(F.col("scan_id") / 12).cast("string"), F.lit("#p"), (page % 4).cast("string"))
    scans = ev.select("scan_id", cpid.alias("canonical_page_id"), F.col("seq").alias("record_seq"))
    done = t.fx_page_reviews.where("status = 'complete'").select("canonical_page_id")
    q = (scans.writeStream.option("checkpointLocation", f"{target}-checkpoint").trigger(availableNow=True)
         .foreachBatch(S.record_scans(target, done)).start())
    q.awaitTermination()
    rec, reo = t.spark.read.parquet(f"{target}/scans"), t.spark.read.parquet(f"{target}/reopened").select("canonical_page_id").distinct()
    j = rec.join(reo.withColumn("reopens", F.lit(True)), "canonical_page_id", "left")
    return j.select("scan_id", "canonical_page_id", F.coalesce("reopens", F.lit(False)).alias("reopens"))


PAGE_SQL = """WITH e AS (SELECT CAST(floor(user_id/3) AS BIGINT) AS page_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'scan' WHEN 'view' THEN 'mark' WHEN 'error' THEN 'reopen' ELSE 'review' END AS kind, event_id % 3 AS open_pins FROM events),
    s AS (SELECT *, sum(CASE WHEN kind='scan' THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY seq) AS seg FROM e),
    l AS (SELECT *, greatest(max(CASE WHEN kind='scan' THEN open_pins END) OVER (PARTITION BY page_id, seg) - sum(CASE WHEN kind='review' THEN 1 ELSE 0 END) OVER (PARTITION BY page_id, seg ORDER BY seq), 0) AS open_now FROM s),
    c AS (SELECT *, CASE WHEN seg=0 THEN NULL WHEN kind='scan' THEN 's' WHEN kind='reopen' THEN 'in_progress' WHEN kind='mark' AND open_now=0 THEN 'complete' END AS ch FROM l),
    f AS (SELECT page_id, max_by(ch, seq) FILTER (WHERE ch IS NOT NULL) AS last_ch, bool_or(ch='complete' OR ch='in_progress') AS ever, max_by(open_now, seq) AS unreviewed, count(*) FILTER (WHERE seg>0 AND kind='mark' AND open_now>0) AS refused FROM c GROUP BY 1)
    SELECT page_id, CASE WHEN last_ch='complete' THEN 'complete' WHEN coalesce(ever,FALSE) THEN 'in_progress' ELSE 'none' END AS status, CAST(coalesce(unreviewed,0) AS BIGINT) AS unreviewed, refused FROM f"""


@query("stream_page_status", "I5", PAGE_SQL)
def _(t):
    ev = event_stream(t)
    kind = F.when(F.col("kind_raw") == "signup", "scan").when(F.col("kind_raw") == "view", "mark").when(F.col("kind_raw") == "error", "reopen").otherwise("review")
    pages = ev.select(F.floor(F.col("scan_id") / 3).alias("page_id"), "seq", kind.alias("kind"), (F.col("seq") % 3).alias("open_pins"))
    out = finished(t, S.page_states(pages), "pages")
    last = out.groupBy("page_id").agg(F.max_by(F.struct("status", "unreviewed"), "seq").alias("l"), F.count_if(F.col("issue") == "unreviewed_pins").alias("refused"))
    return last.select("page_id", "l.status", "l.unreviewed", "refused")


@query("stream_scan_tables", "I4 A1", cte("fx_scans", "fx_pin_detections", "fx_pins") + """ SELECT d.scan_id, d.detection_id AS pin_id, 'unreviewed' AS state, round(p.x, 3) AS x, round(p.y, 3) AS y, round(p.x - 20, 3) AS x0, round(p.y + 15, 3) AS y1, p.class_label
    FROM fx_pin_detections d JOIN fx_pins p ON p.scan_id = d.scan_id AND p.pin_id = d.detection_id JOIN fx_scans s ON s.scan_id = d.scan_id""")
def _(t):
    from markset.streaming import recording as R

    target = scratch(t, "scan-tables")
    num = lambda c: F.col(c).cast("double")
    at = t.fx_pins.select("scan_id", F.col("pin_id").alias("detection_id"), "x", "y", "class_label")
    d = F.struct("detection_id", num("x").alias("x"), num("y").alias("y"), (num("x") - 20).alias("x0"), (num("y") - 15).alias("y0"), (num("x") + 20).alias("x1"), (num("y") + 15).alias("y1"), num("score").alias("score"), F.lit(0).alias("rotation"), "class_label")
    # a scan holds thirteen detections at most
    per = t.fx_pin_detections.join(at, ["scan_id", "detection_id"]).groupBy("scan_id").agg(F.array_sort(F.collect_list(d)).alias("detections"))
    scans = t.fx_scans.join(per, "scan_id").select("scan_id", F.col("scan_id").alias("record_seq"), "canonical_page_id", "detections")
    scans.write.parquet(f"{target}-in/first")
    scans.withColumn("record_seq", F.col("record_seq") + 1_000_000_000).write.parquet(f"{target}-in/again")  # every scan comes twice
    stream = t.spark.readStream.schema(scans.schema).option("recursiveFileLookup", "true").parquet(f"{target}-in")
    R.record(stream, target, f"canonical_page_id string, detections array<{R.DETECTION}>").awaitTermination()
    return t.spark.read.parquet(f"{target}/pins").select("scan_id", "pin_id", "state", "x", "y", "x0", "y1", "class_label")
