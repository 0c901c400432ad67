"""Structured Streaming twins of the review-log operators.

State is small per key: an entry per pin, request or page. Pins and requests are many and have few
events each, so they are dealt to buckets by hash and a bucket is one row of state. Everything that is a
plain aggregate stays one, so that Spark combines a busy key before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

NO_TIMEOUT = GroupStateTimeout.NoTimeout
#: Buckets that keys are dealt to; a checkpoint is bound to the number it was written with.
BUCKETS = 4096


def _bucketed(events: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """Add ``_bucket``, by the hash of the keys, and ``_no_seq``; a null ``seq`` becomes 0.

    Keys that are null in the same places stand together, so in a bucket a key's column is null
    throughout or nowhere and its integers stay integers in pandas.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets))
    for i, k in enumerate(keys):
        bucket = bucket + F.when(F.col(k).isNull(), buckets << i).otherwise(0)
    return events.withColumns({"_bucket": bucket, "_no_seq": F.col("seq").isNull(), "seq": F.coalesce("seq", F.lit(0))})


def _in_order(batches: Iterator[pd.DataFrame], keys: list[str]) -> tuple[pd.DataFrame, list[np.ndarray]]:
    """A bucket's rows by key and seq, null seq last, and its keys, -1 throughout where they are null."""
    rows = pd.concat(list(batches), ignore_index=True)
    cols = [np.full(len(rows), -1) if rows[k].isna().all() else rows[k].to_numpy("int64") for k in keys]
    order = np.lexsort([rows["seq"].to_numpy("int64"), rows["_no_seq"].to_numpy(bool), *cols])
    return rows.iloc[order], [c[order] for c in cols]


def _or_null(values: pd.Series, null: pd.Series) -> pd.Series:
    return values.astype("Int64").mask(null.astype(bool)) if null.any() else values


def dedupe_requests(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """First event of every request id, remembered for the length of the watermark."""
    return events.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["request_id"])


def request_outcomes(events: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``fresh``, ``replay`` or ``conflict`` for every event, by its request id.

    A request id seen again with another digest is a conflict.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows, (ids,) = _in_order(batches, ["request_id"])
        known = dict(zip(*state.get)) if state.exists else {}
        starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        seen, sha = ids[starts].tolist(), rows["request_sha"].to_numpy(object)
        fresh = np.array([i not in known for i in seen])
        first = np.array([known.get(i, d) for i, d in zip(seen, sha[starts])], dtype=object)
        same = sha == np.repeat(first, np.diff(np.append(starts, len(ids))))
        outcome = np.where(same, "replay", "conflict").astype(object)
        outcome[starts[fresh]] = "fresh"
        if fresh.any():
            known |= {i: d for i, d, new in zip(seen, first.tolist(), fresh) if new}
            state.update((list(known), list(known.values())))
        yield pd.DataFrame({"request_id": rows["request_id"], "seq": _or_null(rows["seq"], rows["_no_seq"]), "outcome": outcome})

    dealt = _bucketed(events.select("request_id", "seq", "request_sha"), ["request_id"], buckets)
    return dealt.groupBy("_bucket").applyInPandasWithState(
        step, "request_id bigint, seq bigint, outcome string", "ids array<bigint>, shas array<string>", "append", NO_TIMEOUT)


TARGET = {"approve": "approved", "reject": "rejected"}


def _advance(origin: str, state: str, version: int, action: str) -> tuple[str, int, str]:
    """State and version after an event, and why it was refused or had no effect."""
    if origin == "machine":
        if action not in TARGET:
            return state, version, "already_exists" if action == "add_manual" else "not_manual"
        if state == TARGET[action]:
            return state, version, "noop"
        return TARGET[action], version + 1, ""
    if state == "absent":
        return ("added", 1, "") if action == "add_manual" else (state, version, "not_found")
    if action in TARGET:
        return state, version, "not_machine"
    if action == "add_manual":
        return state, version, "already_exists"
    return (state, version, "already_removed") if state == "removed" else ("removed", version + 1, "")


def pin_states(events: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """State, version and verdict of a pin after each of its events.

    ``events``: scan_id, pin_id, origin, seq, action. A refused event leaves the
    state as it was and carries the reason in ``issue``.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows, (scans, pins) = _in_order(batches, ["scan_id", "pin_id"])
        known = {(s, p): (now, v) for s, p, now, v in zip(*state.get)} if state.exists else {}
        out, pin = [], None
        for scan, no, start, action in zip(scans.tolist(), pins.tolist(), rows["origin"].tolist(), rows["action"].tolist()):
            if pin != (scan, no):
                pin, origin = (scan, no), start
                known.setdefault(pin, ("unreviewed", 1) if origin == "machine" else ("absent", 0))
            now, version, issue = _advance(origin, *known[pin], action)
            known[pin] = now, version
            out.append((now, version, issue))
        state.update(tuple(map(list, zip(*[(*k, *v) for k, v in known.items()]))))
        yield pd.DataFrame({"scan_id": rows["scan_id"].to_numpy(), "pin_id": rows["pin_id"].to_numpy(), "seq": _or_null(rows["seq"], rows["_no_seq"]).array}
                           | dict(zip(("state", "version", "issue"), map(list, zip(*out)))))

    dealt = _bucketed(events.select("scan_id", "pin_id", "origin", "seq", "action"), ["scan_id", "pin_id"], buckets)
    return dealt.groupBy("_bucket").applyInPandasWithState(
        step, "scan_id bigint, pin_id bigint, seq bigint, state string, version bigint, issue string",
        "scans array<bigint>, pins array<bigint>, states array<string>, versions array<bigint>", "append", NO_TIMEOUT)


def hourly_activity(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Actions per reviewer and UTC hour; events later than the watermark are dropped by Spark."""
    return (events.withWatermark("created_at", delay).groupBy(F.window("created_at", "1 hour").alias("w"), "reviewer")
            .agg(F.count(F.lit(1)).alias("actions")).select("reviewer", F.col("w.start").alias("hour_start"), "actions"))


def page_states(events: DataFrame) -> DataFrame:
    """Status of a page after each of its events.

    ``events``: page_id, seq, kind (scan, review, mark, reopen), open_pins. A new scan
    replaces the one before and reopens the page; a page can be marked complete
    only when its latest scan has no unreviewed pin.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("seq")
        left, scans, status = state.get if state.exists else (0, 0, "none")
        out = []
        for seq, kind, pins in zip(rows["seq"].tolist(), rows["kind"].tolist(), rows["open_pins"].tolist()):
            issue = ""
            if kind == "scan":
                left, scans = pins, scans + 1
                status = "in_progress" if status == "complete" else status
            elif scans == 0:
                issue = "no_scan"
            elif kind == "review":
                left = max(left - 1, 0)
            elif kind == "reopen":
                status = "in_progress"
            elif left > 0:
                issue = "unreviewed_pins"
            else:
                status = "complete"
            out.append((key[0], seq, status, left, issue))
        state.update((left, scans, status))
        yield pd.DataFrame(out, columns=["page_id", "seq", "status", "unreviewed", "issue"])

    return events.groupBy("page_id").applyInPandasWithState(
        step, "page_id bigint, seq bigint, status string, unreviewed bigint, issue string", "left bigint, scans bigint, status string", "append", NO_TIMEOUT)


def record_scans(target: str, completed: DataFrame | None = None):
    """``foreachBatch`` writer that records each scan once.

    Every micro-batch owns one folder, so a batch that is run again overwrites
    its own rows. A new scan of a completed page is listed under ``reopened``.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.groupBy("scan_id").agg(F.min_by(F.struct(*[c for c in batch.columns if c != "scan_id"]), "record_seq").alias("r")).select("scan_id", "r.*")
        known = _read_batches(spark, f"{target}/scans", batch_id)
        if known is not None:
            fresh = fresh.join(known.select("scan_id"), "scan_id", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{target}/scans/batch_id={batch_id}")
        if completed is not None:
            stored = spark.read.parquet(f"{target}/scans/batch_id={batch_id}")
            reopened = completed.join(stored, "canonical_page_id", "left_semi").select("canonical_page_id")
            reopened.write.mode("overwrite").parquet(f"{target}/reopened/batch_id={batch_id}")

    return write


def _read_batches(spark, path: str, before: int) -> DataFrame | None:
    """Rows of the micro-batches before this one; folders of later attempts do not count."""
    try:
        return spark.read.option("basePath", path).parquet(path).where(F.col("batch_id") < before)
    except AnalysisException as exc:
        if exc.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def run_to_end(df: DataFrame, path: str, mode: str = "append") -> None:
    """Process everything available and stop, writing each micro-batch under ``path``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    q = (df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True)
         .foreachBatch(write).start())
    q.awaitTermination()
