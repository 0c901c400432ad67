"""Recording scans from a stream once: one state per scan with a time to live, three tables out of one stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DAY_MS = 86_400_000

DETECTION = "struct<detection_id:bigint,x:double,y:double,x0:double,y0:double,x1:double,y1:double,score:double,rotation:int,class_label:string>"
_OUT = "scan_id bigint, record_seq bigint, outcome string, content string"


def _first_content(ttl_ms: int):
    """Lets the first content of a scan pass; the same again is ``repeated``, another is a ``conflict``."""
    names = ["scan_id", "record_seq", "outcome", "content"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = state.get[0] if state.exists else None
        fresh, first, others = known is None, None, []
        # of what arrives together the least sequence number is first; only that one's content is kept
        for rows in batches:
            for r in rows.itertuples(index=False):
                if fresh and (first is None or (r.record_seq, r.fingerprint) < (first.record_seq, first.fingerprint)):
                    first, r = r, first
                if r is not None:
                    others.append((r.record_seq, r.fingerprint))
        known = first.fingerprint if fresh else known
        state.update((known,))
        state.setTimeoutDuration(ttl_ms)
        out = [(key[0], first.record_seq, "recorded", first.content)] if fresh else []
        out += [(key[0], seq, "repeated" if f == known else "conflict", None) for seq, f in others]
        yield pd.DataFrame(out, columns=names)

    return step


def once(scans: DataFrame, ttl_ms: int = 30 * DAY_MS) -> DataFrame:
    """scan_id, record_seq, outcome and, where recorded, ``content``: the scan's other columns as JSON.

    ``scans``: a stream with scan_id, record_seq and the scan's content, ``detections`` included. Content is told by
    its SHA-256, which is all that the state holds; a scan of which nothing came for ``ttl_ms`` is forgotten and would
    be recorded anew. Repeats of a scan within a micro-batch are streamed, their content is not held.
    """
    content = F.to_json(F.struct(*[c for c in scans.columns if c not in ("scan_id", "record_seq")]), {"ignoreNullFields": "false"})
    rows = scans.where("scan_id IS NOT NULL").select("scan_id", "record_seq", content.alias("content")).withColumn("fingerprint", F.sha2("content", 256))
    return rows.groupBy("scan_id").applyInPandasWithState(_first_content(ttl_ms), _OUT, "fingerprint string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def tables(recorded: DataFrame, schema: str, detections: str = "detections") -> dict[str, DataFrame]:
    """Scans, detections and one unreviewed machine pin a detection, of what ``once`` recorded; and what it refused.

    ``schema`` is that of the content. Coordinates are kept to three decimals; a detection without a point of its own
    stands at its box's centre; of detections that share an id in a scan none is told from the other, so the scan is refused.
    """
    r = recorded.where("outcome = 'recorded'").select("scan_id", "record_seq", F.from_json("content", schema).alias("c")).select("scan_id", "record_seq", "c.*")
    ids = F.transform(F.coalesce(detections, F.array().cast(f"array<{DETECTION}>")), lambda d: d["detection_id"])
    twice = F.size(F.array_distinct(ids)) < F.size(ids)
    good = r.where(~twice)
    refused = recorded.where("outcome = 'conflict'").select("scan_id", "record_seq", F.lit("other_content").alias("problem")).unionByName(
        r.where(twice).select("scan_id", "record_seq", F.lit("duplicate_detection").alias("problem")))
    d = good.select("scan_id", F.explode(detections).alias("d")).select("scan_id", "d.*")
    near = lambda c, a, b: F.round(F.coalesce(F.col(c), (F.col(a) + F.col(b)) / 2), 3)
    d = d.withColumns({"x": near("x", "x0", "x1"), "y": near("y", "y0", "y1"), **{c: F.round(c, 3) for c in ("x0", "y0", "x1", "y1")}})
    pins = d.select("scan_id", F.col("detection_id").alias("pin_id"), F.lit("machine").alias("origin"), F.lit("unreviewed").alias("state"), "detection_id", "x", "y", "x0", "y0", "x1", "y1", F.lit(1).alias("version"), "class_label", "rotation")
    return {"scans": good.drop(detections), "detections": d.drop("class_label"), "pins": pins, "refused": refused}


def record(scans: DataFrame, target: str, schema: str, completed: DataFrame | None = None, ttl_ms: int = 30 * DAY_MS):
    """Start recording a stream under ``target``: tables scans, detections, pins, refused and, with ``completed``, the
    pages that a new scan reopens. A micro-batch owns a folder of each table, so one that runs again writes the same."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        out = tables(batch, schema)
        if completed is not None:
            out["reopened"] = completed.join(out["scans"], "canonical_page_id", "left_semi").select("canonical_page_id")
        for name, df in out.items():
            df.write.mode("overwrite").parquet(f"{target}/{name}/batch_id={batch_id}")
        batch.unpersist()

    # with a time to live Spark would go on with batches without data for as long as there is state
    conf, key = scans.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(key)
    conf.set(key, "false")
    try:
        return (once(scans, ttl_ms).writeStream.outputMode("append").option("checkpointLocation", f"{target}-checkpoint")
                .trigger(availableNow=True).foreachBatch(write).start())
    finally:
        conf.set(key, before)
