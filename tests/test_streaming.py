"""Streams fed in several micro-batches end where the batch operators do."""

import pytest
from pyspark.sql import functions as F

from markset.operators import reviews as R
from markset.streaming import operators as S


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("log"))
    ev = spark.range(600).select(
        F.col("id").alias("seq"), (F.col("id") - F.when(F.col("id") % 17 == 16, 1).otherwise(0)).alias("request_id"), (F.col("id") % 4).alias("scan_id"), (F.col("id") * 7 % 5).alias("pin_id"),
        F.element_at(F.array(*[F.lit(a) for a in ("approve", "reject", "add_manual", "remove_manual", "approve")]), (F.col("id") * 13 % 5 + 1).cast("int")).alias("action"))
    ev = ev.withColumns({"origin": F.when(F.col("pin_id") == 0, "manual").otherwise("machine"), "request_sha": F.col("action"), "reviewer": F.concat(F.lit("u"), F.col("scan_id").cast("string")),
                         "created_at": F.timestamp_seconds(1_700_000_000 + F.col("seq") * 60), "created_us": (1_700_000_000 + F.col("seq") * 60) * 1_000_000})
    for i in range(4):
        ev.where((F.col("seq") >= i * 150) & (F.col("seq") < (i + 1) * 150)).coalesce(1).write.mode("append").parquet(path)
    return ev, lambda: spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(path)


def finish(spark, df, path, mode="append"):
    S.run_to_end(df, str(path / "out"), mode)
    return spark.read.parquet(str(path / "out"))


def test_pin_states_equal_batch(spark, log, tmp_path):
    ev, stream = log
    out = finish(spark, S.pin_states(stream().select("scan_id", "pin_id", "origin", "seq", "action")), tmp_path)
    assert out.select("batch_id").distinct().count() == 4
    last = {(r["scan_id"], r["pin_id"]): r["l"]["version"] for r in out.groupBy("scan_id", "pin_id").agg(F.max_by(F.struct("state", "version"), "seq").alias("l")).collect()}
    for r in R.pin_versions(ev).collect():
        assert last[r["scan_id"], r["pin_id"]] == r["version"]
    issues = {(r["seq"], r["issue"]) for r in out.where("issue NOT IN ('', 'noop')").collect()}
    assert issues == {(r["seq"], r["reason"]) for r in R.check_transitions(ev).collect()}


def test_request_outcomes(spark, log, tmp_path):
    ev, stream = log
    out = {r["outcome"]: r["n"] for r in finish(spark, S.request_outcomes(stream().select("request_id", "seq", "request_sha")), tmp_path).groupBy("outcome").agg(F.count("*").alias("n")).collect()}
    assert out["fresh"] == ev.select("request_id").distinct().count()
    assert sum(out.values()) == 600


def test_hourly_equals_batch(spark, log, tmp_path):
    ev, stream = log
    out = finish(spark, S.hourly_activity(stream()), tmp_path, "update")
    got = {(r["reviewer"], r["h"]): r["n"] for r in out.groupBy("reviewer", F.floor(F.unix_seconds("hour_start") / 3600).alias("h")).agg(F.max_by("actions", "batch_id").alias("n")).collect()}
    assert got == {(r["reviewer"], r["hour"]): r["actions"] for r in R.hourly_activity(ev).collect()}


def test_scans_are_recorded_once(spark, log, tmp_path):
    ev, stream = log
    target = str(tmp_path / "t")
    done = spark.createDataFrame([("p1",)], "canonical_page_id string")
    scans = stream().select(F.col("pin_id").alias("scan_id"), F.concat(F.lit("p"), (F.col("pin_id") % 2).cast("string")).alias("canonical_page_id"), F.col("seq").alias("record_seq"))
    write = S.record_scans(target, done)

    def twice(df, i):
        write(df, i)
        write(df, i)  # a batch that is run again changes nothing

    q = scans.writeStream.option("checkpointLocation", target + "-c").trigger(availableNow=True).foreachBatch(twice).start()
    q.awaitTermination()
    rec = spark.read.parquet(target + "/scans")
    assert rec.count() == rec.select("scan_id").distinct().count() == 5
    assert {r["canonical_page_id"] for r in spark.read.parquet(target + "/reopened").collect()} == {"p1"}


def test_page_states(spark, tmp_path):
    ev = spark.createDataFrame([(0, 1, "scan", 1), (0, 2, "mark", 0), (0, 3, "review", 0), (0, 4, "mark", 0), (0, 5, "scan", 0), (0, 6, "mark", 0), (0, 7, "reopen", 0), (1, 8, "mark", 0)],
                               "page_id long, seq long, kind string, open_pins long")
    src = str(tmp_path / "src")
    for a, b in ((0, 4), (4, 9)):
        ev.where((F.col("seq") >= a) & (F.col("seq") < b)).coalesce(1).write.mode("append").parquet(src)
    out = finish(spark, S.page_states(spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(src)), tmp_path)
    got = {r["seq"]: (r["status"], r["issue"]) for r in out.collect()}
    assert got[2] == ("none", "unreviewed_pins") and got[4] == ("complete", "") and got[5] == ("in_progress", "") and got[7] == ("in_progress", "") and got[8] == ("none", "no_scan")


def outcomes_by_hand(rows):
    first, out = {}, []
    for request, seq, sha in rows:
        out.append((request, seq, "fresh" if request not in first else "replay" if first[request] == sha else "conflict"))
        first.setdefault(request, sha)
    return out


def test_keys_share_rows_of_state(spark, tmp_path):
    """Keys of a bucket, null and large ones among them, keep their own state over micro-batches; there are few rows of it."""
    big = 1 << 60
    rows = [(None if i % 7 == 3 else big + i % 40, i, None if i % 40 == 5 else "ab"[i % 3 == 0]) for i in range(300)]
    src, path = str(tmp_path / "src"), tmp_path / "out"
    for some in (rows[:100], rows[100:]):
        spark.createDataFrame(some, "request_id long, seq long, request_sha string").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("request_id long, seq long, request_sha string").option("maxFilesPerTrigger", 1).parquet(src)
    got = finish(spark, S.request_outcomes(stream, buckets=3), tmp_path)
    assert got.select("batch_id").distinct().count() == 2
    assert sorted(map(str, got.select("request_id", "seq", "outcome").toLocalIterator())) == sorted(
        str(spark_row) for spark_row in spark.createDataFrame(outcomes_by_hand(rows), "request_id long, seq long, outcome string").collect())
    state = spark.read.format("statestore").load(f"{path}-checkpoint")
    assert state.count() <= 4


def test_pins_share_rows_of_state(spark, tmp_path):
    actions = ("approve", "reject", "add_manual", "remove_manual")
    rows = [(None if i % 11 == 4 else i % 6, None if i % 13 == 5 else (1 << 60) + i % 5, i, actions[i * i % 23 % 4]) for i in range(400)]
    rows = [(s, p, "manual" if p is not None and p % 5 == 0 else "machine", i, a) for s, p, i, a in rows]
    types, src, path = "scan_id long, pin_id long, origin string, seq long, action string", str(tmp_path / "src"), tmp_path / "out"
    for some in (rows[:150], rows[150:]):
        spark.createDataFrame(some, types).coalesce(1).write.mode("append").parquet(src)
    got = finish(spark, S.pin_states(spark.readStream.schema(types).option("maxFilesPerTrigger", 1).parquet(src), buckets=2), tmp_path)
    now, want = {}, set()
    for s, p, origin, i, a in rows:
        state = now.get((s, p), ("unreviewed", 1) if origin == "machine" else ("absent", 0))
        *now[s, p], issue = S._advance(origin, *state, a)
        want.add((s, p, i, *now[s, p], issue))
    assert {tuple(r) for r in got.drop("batch_id").collect()} == want
    assert spark.read.format("statestore").load(f"{path}-checkpoint").count() <= 8
