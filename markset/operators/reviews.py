"""The append-only review log: labels, versions, audits, queues, roll-ups.

Nothing is updated in place. The current state of a pin, page or model is always
an aggregate over its events, so a busy pin is combined before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markset.operators.running import previous

HELD_OUT = ("test", "eval")  # fixed values: splits that never feed training
THRESHOLD_KEYS = ("threshold", "score_threshold", "min_score")  # fixed values: settings keys, in order
PIN_STATES = ("unreviewed", "approved", "rejected", "added", "removed")


def latest_scan_per_page(scans: DataFrame, page: str = "canonical_page_id") -> DataFrame:
    """The newest scan of every page by record time, then record order."""
    newest = scans.groupBy(page).agg(F.max_by("scan_id", F.struct("recorded_us", "record_seq")).alias("scan_id"))
    return scans.join(newest, [page, "scan_id"], "left_semi")


def pin_labels(pins: DataFrame, events: DataFrame) -> DataFrame:
    """Label, status and labelling event of every pin.

    Machine pins follow their latest approve or reject. A manual pin is positive
    until removed; a removal gives no label.
    """
    review = F.col("action").isin("approve", "reject")
    per = events.groupBy("scan_id", "pin_id").agg(
        F.max_by(F.struct("action", "seq", "reviewer"), F.when(review, F.col("seq"))).alias("last"),
        F.count_if(review).alias("reviews"),
        F.min(F.when(F.col("action") == "add_manual", F.col("seq"))).alias("add_seq"))
    j = pins.join(per, ["scan_id", "pin_id"], "left")
    machine, removed = F.col("origin") == "machine", F.col("state") == "removed"
    n = F.coalesce(F.col("reviews"), F.lit(0))
    label = (F.when(machine & (F.col("last.action") == "approve"), "positive").when(machine & (F.col("last.action") == "reject"), "negative")
             .when(~machine & ~removed, "positive"))
    status = (F.when(machine & (n == 0), "unlabeled").when(machine & (n == 1), "reviewed").when(machine, "re-reviewed")
              .when(removed, "manual_removed").otherwise("manual_added"))
    event = F.when(machine, F.col("last.seq")).otherwise(F.col("add_seq"))
    return j.withColumn("label", label).withColumn("label_status", status).withColumn("label_event", event).drop("last", "reviews", "add_seq")


def pin_versions(events: DataFrame) -> DataFrame:
    """Version of every pin: 1 plus its state changes. Repeating the present state
    of a machine pin is a no-op and does not count."""
    machine = events.where((F.col("origin") == "machine") & F.col("action").isin("approve", "reject"))
    steps = previous(machine, ["scan_id", "pin_id"], "seq", "action", "before")
    changed = steps.groupBy("scan_id", "pin_id").agg(
        F.count_if(~F.col("action").eqNullSafe(F.col("before"))).alias("changes"), F.count_if(F.col("action").eqNullSafe(F.col("before"))).alias("noops"))
    manual = _manual_spans(events).select("scan_id", "pin_id", F.col("removed_seq").isNotNull().cast("bigint").alias("changes"), F.lit(0).cast("bigint").alias("noops"))
    return changed.unionByName(manual).select("scan_id", "pin_id", (F.col("changes") + 1).alias("version"), "noops")


def _manual_spans(events: DataFrame) -> DataFrame:
    """First add and the first removal after it, per manual pin that was added."""
    manual = events.where(F.col("origin") == "manual")
    added = manual.where(F.col("action") == "add_manual").groupBy("scan_id", "pin_id").agg(F.min("seq").alias("added_seq"))
    removed = (manual.where(F.col("action") == "remove_manual").join(added, ["scan_id", "pin_id"])
               .where(F.col("seq") > F.col("added_seq")).groupBy("scan_id", "pin_id").agg(F.min("seq").alias("removed_seq")))
    return added.join(removed, ["scan_id", "pin_id"], "left")


def check_transitions(events: DataFrame) -> DataFrame:
    """Events the review rules would refuse, with the reason.

    Approve and reject need a machine pin, removal a manual pin that is there,
    and a pin can be added once. Since a removed pin never returns, a pin's whole
    history follows from its first add and first removal.
    """
    j = events.join(_manual_spans(events), ["scan_id", "pin_id"], "left")
    machine, act, seq = F.col("origin") == "machine", F.col("action"), F.col("seq")
    reason = (F.when(machine & (act == "add_manual"), "already_exists").when(machine & (act == "remove_manual"), "not_manual")
              .when(machine, F.lit(None)).when(F.col("added_seq").isNull() | (seq < F.col("added_seq")), "not_found")
              .when(act.isin("approve", "reject"), "not_machine")
              .when((act == "add_manual") & (seq > F.col("added_seq")), "already_exists")
              .when((act == "remove_manual") & (seq > F.col("removed_seq")), "already_removed"))
    return j.withColumn("reason", reason).where(F.col("reason").isNotNull()).drop("added_seq", "removed_seq")


def check_split_moves(assignments: DataFrame, forced: Column | None = None) -> DataFrame:
    """Documents moved out of a held-out split: a leak unless forced."""
    moves = previous(assignments, ["document_id"], "seq", "split", "before")
    leak = F.col("before").isin(*HELD_OUT) & (F.col("split") != F.col("before"))
    return moves.where(leak if forced is None else leak & ~forced)


def exclude_held_out(scans: DataFrame, splits: DataFrame) -> DataFrame:
    """Rows whose document is not in a held-out split (no split counts as allowed)."""
    return scans.join(splits.where(F.col("split").isin(*HELD_OUT)), "document_id", "left_anti")


def page_completeness(scans: DataFrame, pins: DataFrame, page_reviews: DataFrame) -> DataFrame:
    """Per page: latest scan, its unreviewed machine pins, and whether the page is
    complete (marked so, and nothing left to review on the latest scan)."""
    latest = latest_scan_per_page(scans)
    open_pins = (pins.where((F.col("origin") == "machine") & (F.col("state") == "unreviewed"))
                 .groupBy("scan_id").agg(F.count(F.lit(1)).alias("unreviewed")))
    marked = page_reviews.select("canonical_page_id", (F.col("status") == "complete").alias("marked"))
    out = (latest.select("canonical_page_id", "document_id", "scan_id").join(open_pins, "scan_id", "left")
           .join(marked, "canonical_page_id", "left").fillna(0, ["unreviewed"]).fillna(False, ["marked"]))
    return out.withColumn("complete", F.col("marked") & (F.col("unreviewed") == 0))


def snapshot(scans: DataFrame, splits: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Selected scans with their split, and every table cut down to those scans."""
    picked = scans.join(splits, "document_id", "left")
    ids = picked.select("scan_id")
    return {"scans": picked} | {name: df.join(ids, "scan_id", "left_semi") for name, df in tables.items()}


def review_pairs(pins: DataFrame, detections: DataFrame, scans: DataFrame, splits: DataFrame, include_heldout: bool = False,
                 **equal: object) -> DataFrame:
    """``(score, label)`` of reviewed machine pins from comparable scans.

    Keyword filters narrow the scans (``template_id="tpl-1"``, ...).
    """
    picked = scans
    for column, value in equal.items():
        picked = picked.where(F.col(column) == value)
    if not include_heldout:
        picked = exclude_held_out(picked, splits)
    done = pins.where((F.col("origin") == "machine") & F.col("state").isin("approved", "rejected"))
    return (done.join(picked.select("scan_id", "document_id", "template_id"), "scan_id")
            .join(detections.select("scan_id", "detection_id", "score"), ["scan_id", "detection_id"])
            .select("scan_id", "pin_id", "document_id", "template_id", "score", (F.col("state") == "approved").cast("int").alias("label")))


def settings_threshold(settings: Column) -> Column:
    """First numeric threshold among the known settings keys."""
    return F.coalesce(*[F.get_json_object(settings, f"$.{k}").try_cast("double") for k in THRESHOLD_KEYS])


def review_queue(pins: DataFrame, detections: DataFrame, scans: DataFrame, strategy: str = "margin", threshold: float | None = None,
                 limit: int | None = None, position: list[str] | None = None) -> DataFrame:
    """Unreviewed machine pins, most uncertain first.

    ``margin`` orders by distance from the threshold (the argument, else the
    scan's own setting, else its lowest open score), ``lowest_score`` by score.
    """
    if strategy not in ("margin", "lowest_score"):
        raise ValueError(f"unknown strategy {strategy}")
    open_pins = (pins.where((F.col("origin") == "machine") & (F.col("state") == "unreviewed"))
                 .join(detections.select("scan_id", "detection_id", "score", "det_seq"), ["scan_id", "detection_id"]).join(scans, "scan_id"))
    if strategy == "margin":
        low = open_pins.groupBy("scan_id").agg(F.min("score").alias("_low"))
        cut = F.lit(float(threshold)) if threshold is not None else F.coalesce(settings_threshold(F.col("detector_settings")), F.col("_low"))
        ranked = open_pins.join(low, "scan_id").withColumn("threshold", cut).withColumn("margin", F.abs(F.col("score") - F.col("threshold"))).drop("_low")
        order = ["margin", *(position or ["scan_id"]), "det_seq"]
    else:
        ranked, order = open_pins, ["score", *(position or ["scan_id"]), "det_seq"]
    ranked = ranked.orderBy(*order)
    return ranked if limit is None else ranked.limit(limit)


def pin_summary(pins: DataFrame) -> DataFrame:
    return pins.groupBy("scan_id", "origin", "state").agg(F.count(F.lit(1)).alias("n"))


def page_scan_history(scans: DataFrame, pins: DataFrame) -> DataFrame:
    """Every scan of a page with its age rank and pin counts by state."""
    counts = pins.groupBy("scan_id").agg(*[F.count_if(F.col("state") == s).alias(s) for s in PIN_STATES])
    w = Window.partitionBy("canonical_page_id").orderBy("recorded_us", "record_seq")
    return (scans.select("canonical_page_id", "scan_id", "recorded_us", F.row_number().over(w).alias("position"))
            .join(counts, "scan_id", "left").fillna(0, list(PIN_STATES)))


def review_counts(pins: DataFrame, detections: DataFrame, scans: DataFrame) -> DataFrame:
    """Found, approved, rejected, added, confirmed and unreviewed by sheet and tag, with
    ``All sheets`` rows. A machine pin counts as found under the tag the detector gave."""
    found_as = detections.select("scan_id", "detection_id", "found_label")
    j = pins.join(found_as, ["scan_id", "detection_id"], "left").join(scans.select("scan_id", "page_index"), "scan_id")
    machine = F.col("origin") == "machine"
    zero, one = F.lit(0), F.lit(1)

    def flag(cond):
        return F.when(cond, one).otherwise(zero)

    now = j.select("page_index", F.col("class_label").alias("tag"), zero.alias("found"), flag(machine & (F.col("state") == "approved")).alias("approved"),
                   flag(machine & (F.col("state") == "rejected")).alias("rejected"), flag(~machine & (F.col("state") == "added")).alias("added"),
                   flag(machine & (F.col("state") == "unreviewed")).alias("unreviewed"))
    orig = j.where(machine).select("page_index", F.coalesce("found_label", "class_label").alias("tag"), one.alias("found"),
                                   *[zero.alias(c) for c in ("approved", "rejected", "added", "unreviewed")])
    sums = [F.sum(c).alias(c) for c in ("found", "approved", "rejected", "added", "unreviewed")]
    sheet = now.unionByName(orig).rollup("tag", "page_index").agg(*sums, F.grouping("page_index").alias("_all")).where(F.col("tag").isNotNull())
    label = F.when(F.col("_all") == 1, "All sheets").otherwise((F.col("page_index") + 1).cast("string"))
    return sheet.withColumn("sheet", label).withColumn("confirmed", F.col("approved") + F.col("added")).drop("_all", "page_index")


def sheet_review_state(unreviewed: Column, complete: Column) -> Column:
    return F.when(complete, "reviewed").when(unreviewed > 0, "to_review").otherwise("ready_to_mark")


def activity_by_person(events: DataFrame) -> DataFrame:
    """Actions, distinct pins and first/last time per reviewer.

    The distinct pins are counted from one row per reviewer and pin, which is
    combined before the shuffle, so a busy reviewer does not become one task.
    """
    per_pin = events.groupBy("reviewer", "scan_id", "pin_id").agg(
        *[F.count_if(F.col("action") == a).alias(a) for a in ("approve", "reject", "add_manual", "remove_manual")],
        F.min("created_us").alias("first_us"), F.max("created_us").alias("last_us"))
    return per_pin.groupBy("reviewer").agg(
        *[F.sum(a).alias(a) for a in ("approve", "reject", "add_manual", "remove_manual")], F.count(F.lit(1)).alias("pins"),
        F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))


def scan_activity(scans: DataFrame) -> DataFrame:
    """Scans and distinct pages per requester."""
    per_page = scans.groupBy("requested_by", "canonical_page_id").agg(F.count(F.lit(1)).alias("n"), F.max("recorded_us").alias("last_us"))
    return per_page.groupBy("requested_by").agg(F.sum("n").alias("scans"), F.count(F.lit(1)).alias("pages"), F.max("last_us").alias("last_us"))


def hourly_activity(events: DataFrame, since_us: int | None = None) -> DataFrame:
    """Actions per reviewer and UTC hour (hours since the epoch)."""
    picked = events if since_us is None else events.where(F.col("created_us") >= since_us)
    return picked.groupBy("reviewer", F.floor(F.col("created_us") / 3_600_000_000).alias("hour")).agg(F.count(F.lit(1)).alias("actions"))


def daily_activity(hourly: DataFrame, offset_hours: int, first_day: int, last_day: int) -> DataFrame:
    """Hourly counts folded to the days of a zone, with a row for every day in range."""
    day = F.floor((F.col("hour") + offset_hours) / 24)
    found = hourly.groupBy(day.alias("day")).agg(F.sum("actions").alias("actions"))
    calendar = hourly.sparkSession.range(first_day, last_day + 1).withColumnRenamed("id", "day")
    return calendar.join(found, "day", "left").fillna(0, ["actions"])


def window_start(at_us: Column, days: Column | int) -> Column:
    """Start of an activity window as RFC 3339 UTC text with milliseconds: midnight, ``days`` whole UTC days before ``at_us``."""
    day = F.floor(at_us / 86_400_000_000).cast("int") - (F.lit(days) if isinstance(days, int) else days).cast("int")
    return F.concat(F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), day), "yyyy-MM-dd"), F.lit("T00:00:00.000Z"))


def daily_activity_in(hourly: DataFrame, zone: str) -> DataFrame:
    """Hourly counts folded to the dates of a time zone, its changes of clock included, with a row for every date from the
    first to the last of the data. Columns: day, actions. ``hourly``: hour since the epoch in UTC, actions."""
    utc = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("hour").cast("int"))
    found = hourly.select(F.convert_timezone(F.lit("UTC"), F.lit(zone), utc).cast("date").alias("day"), "actions").groupBy("day").agg(F.sum("actions").alias("actions"))
    ends = found.agg(F.min("day").alias("a"), F.max("day").alias("b")).where("a IS NOT NULL")
    return ends.select(F.explode(F.sequence("a", "b")).alias("day")).join(found, "day", "left").fillna(0, ["actions"])


def site_activity(audit: DataFrame, by: str = "actor") -> DataFrame:
    return audit.groupBy(by, "action").agg(F.count(F.lit(1)).alias("n"), F.max("at_us").alias("last_us"))


def team_progress(members: DataFrame, reviews: DataFrame, pages: DataFrame, scans: DataFrame, uploads: DataFrame) -> DataFrame:
    """One row per person: members first, then former members with work on record,
    last the work nobody is named for. Only names with an @ are people."""
    key = "person"
    out = members.select(key, F.lit(True).alias("member"), "role")
    for df in (reviews, pages, scans, uploads):
        cols = [c for c in df.columns if c != key]
        l, r = out.alias("l"), df.alias("r")
        out = l.join(r, F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}")), "full").select(
            F.coalesce(f"l.{key}", f"r.{key}").alias(key), *[F.col(f"l.{c}") for c in out.columns if c != key], *[F.col(f"r.{c}") for c in cols])
    numbers = [c for c in out.columns if c not in (key, "member", "role")]
    out = out.fillna(0, numbers).fillna(False, ["member"])
    out = out.where(F.col("member") | F.col(key).isNull() | F.col(key).contains("@"))
    return out.withColumn("sort_group", F.when(F.col("member"), 0).when(F.col(key).isNotNull(), 1).otherwise(2))


def batch_rollup(pages: DataFrame, pin_counts: DataFrame, complete_scans: DataFrame, cancelled: Column | None = None) -> DataFrame:
    """Page and pin counts and the state of every batch.

    ``pages``: batch_id, scan_id, status; ``pin_counts``: scan_id and counts.
    """
    names = [c for c in pin_counts.columns if c != "scan_id"]
    done = complete_scans.select("scan_id", F.lit(True).alias("_ok")).distinct()
    j = pages.join(pin_counts, "scan_id", "left").join(done, "scan_id", "left")
    states = ("pending", "running", "done", "failed", "cancelled")
    out = j.groupBy("batch_id").agg(
        *[F.count_if(F.col("status") == s).alias(f"pages_{s}") for s in states], F.count(F.lit(1)).alias("pages_total"),
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names], F.count_if(F.coalesce("_ok", F.lit(False))).alias("review_complete"))
    started = F.col("pages_total") > F.col("pages_pending")
    state = (F.when((F.col("pages_running") > 0) | ((F.col("pages_pending") > 0) & started), "running").when(F.col("pages_pending") > 0, "queued")
             .when(F.lit(False) if cancelled is None else cancelled, "cancelled").otherwise("complete"))
    return out.withColumn("batch_status", state)


def readiness(scans: DataFrame, pins: DataFrame, page_reviews: DataFrame) -> DataFrame:
    """Checks whether enough reviews exist to train, one row per check."""
    machine = F.col("origin") == "machine"
    per_scan = pins.groupBy("scan_id").agg(
        F.count_if((machine & (F.col("state") == "approved")) | (~machine & (F.col("state") == "added"))).alias("pos"),
        F.count_if(machine & (F.col("state") == "rejected")).alias("neg"), F.count_if(machine & (F.col("state") == "unreviewed")).alias("open"))
    j = scans.select("scan_id", "document_id").join(per_scan, "scan_id")
    docs = j.groupBy("document_id").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    labels = docs.agg(F.sum("pos").alias("positive"), F.sum("neg").alias("negative"), F.count_if(F.col("pos") + F.col("neg") > 0).alias("label_docs"))
    full = page_completeness(scans, pins, page_reviews).where("complete").join(per_scan, "scan_id", "left").fillna(0, ["pos"])
    per_doc = full.groupBy("document_id").agg(F.count(F.lit(1)).alias("pages"), F.sum("pos").alias("points"))
    pages = per_doc.agg(F.coalesce(F.sum("pages"), F.lit(0)).alias("complete_pages"), F.coalesce(F.sum("points"), F.lit(0)).alias("points"),
                        F.count(F.lit(1)).alias("page_docs"))
    # fixed values: what each check needs
    need = [("verifier", "positive labels", "positive", 100), ("verifier", "negative labels", "negative", 100),
            ("verifier", "documents with labels", "label_docs", 10), ("detector", "complete pages", "complete_pages", 30),
            ("detector", "points on complete pages", "points", 300), ("detector", "documents with complete pages", "page_docs", 10)]
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(n).alias("check_name"), F.col(c).cast("bigint").alias("have"),
                                        F.lit(k).cast("bigint").alias("need")) for m, n, c, k in need])).alias("s")
    # both sides are one row
    return labels.join(F.broadcast(pages)).select(rows).select("s.*", (F.col("s.have") >= F.col("s.need")).alias("ok"))


def label_conflicts(crops: DataFrame) -> DataFrame:
    """Crops labelled both ways."""
    return (crops.where(F.col("label").isNotNull()).groupBy("crop_key").agg(F.count_if(F.col("label") == "positive").alias("positives"),
                                                                             F.count_if(F.col("label") == "negative").alias("negatives"))
            .where((F.col("positives") > 0) & (F.col("negatives") > 0)))


def training_crops(crops: DataFrame, label: str | None = None, **equal: object) -> DataFrame:
    """One row per crop, without the crops labelled both ways. ``crops`` carries
    crop_key, label, scan_id, pin_id; keyword filters narrow the result."""
    labelled = crops.where(F.col("label").isNotNull())
    cols = [c for c in crops.columns if c != "crop_key"]
    first = labelled.groupBy("crop_key").agg(F.min_by(F.struct(*cols), F.struct("scan_id", "pin_id")).alias("c"),
                                             F.min("label").alias("_lo"), F.max("label").alias("_hi"))
    out = first.where(F.col("_lo") == F.col("_hi")).select("crop_key", "c.*")
    if label is not None:
        out = out.where(F.col("label") == label)
    for column, value in equal.items():
        out = out.where(F.col(column) == value)
    return out


def symbol_training_rows(crops: DataFrame) -> DataFrame:
    """Per tag: approved, added and rejected examples, distinct sheets and documents."""
    pos, manual = F.col("label") == "positive", F.col("origin") == "manual"
    per_page = crops.groupBy("class_label", "document_id", "canonical_page_id").agg(
        F.count_if(pos & ~manual).alias("approved"), F.count_if(pos & manual).alias("added"), F.count_if(~pos).alias("rejected"))
    per_doc = per_page.groupBy("class_label", "document_id").agg(*[F.sum(c).alias(c) for c in ("approved", "added", "rejected")], F.count(F.lit(1)).alias("sheets"))
    return per_doc.groupBy("class_label").agg(*[F.sum(c).alias(c) for c in ("approved", "added", "rejected", "sheets")], F.count(F.lit(1)).alias("documents"))


def active_model(history: DataFrame) -> DataFrame:
    """Latest promote or deactivate per kind, the active model and the one before it."""
    acts = history.where(F.col("action").isin("promote", "deactivate"))
    last = acts.groupBy("kind").agg(F.max_by(F.struct("action", "model_id", "seq"), "seq").alias("last"))
    active = last.select("kind", F.col("last.seq").alias("changed_seq"),
                         F.when(F.col("last.action") == "promote", F.col("last.model_id")).alias("active_model"))
    before = (acts.where("action = 'promote'").join(active, "kind").where(F.col("seq") < F.col("changed_seq"))
              .groupBy("kind").agg(F.max_by("model_id", "seq").alias("previous_model")))
    return active.join(before, "kind", "left")


def alive_rows(rows: DataFrame, documents: DataFrame, page: str | None = None) -> DataFrame:
    """``rows`` of documents that still exist: whose ``document_version`` is in ``documents``; with ``page`` the version is
    read from that page id. Rows without a version go; other columns pass."""
    if page is None:
        return rows.join(documents.select("document_version").distinct(), "document_version", "left_semi").select(*rows.columns)
    version = F.regexp_extract(page, r"^(.*)#p\d+$", 1)
    return rows.withColumn("_version", version).join(documents.select(F.col("document_version").alias("_version")).distinct(), "_version", "left_semi").select(*rows.columns)


def dependents_of_document(rows: DataFrame, deleted: DataFrame, page: str = "canonical_page_id") -> DataFrame:
    """Rows that still refer to a deleted document version."""
    version = F.regexp_extract(page, r"^(.*)#p\d+$", 1)
    return rows.withColumn("document_version", version).join(deleted, "document_version", "left_semi")
