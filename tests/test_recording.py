"""Scans recorded from a stream equal those of a batch, once each."""

from pyspark.sql import functions as F

from markset.streaming import recording as R

CONTENT = f"canonical_page_id string, detections array<{R.DETECTION}>"


def test_stream_equals_batch(spark, tmp_path):
    def scan(seq, i, page, dets):
        return (i, seq, page, [{"detection_id": k, "x": x, "y": None, "x0": 0.0, "y0": 1.0, "x1": 10.00049, "y1": 3.0, "score": 0.5, "rotation": 90, "class_label": "A"} for k, x in dets] if dets is not None else None)

    rows = [scan(1, 1, "p1", [(1, 4.0), (2, None)]), scan(2, 2, "p2", []), scan(3, 1, "p1", [(1, 4.0), (2, None)]), scan(4, 1, "p1", [(1, 5.0)]), scan(5, 3, "p3", [(7, 1.0), (7, 2.0)]),
            scan(6, 2, "p2", []), scan(7, 2, "p9", []), scan(8, 4, "p1", None), scan(9, 5, "p5", [(1, 1.0)])]
    df = spark.createDataFrame(rows, f"scan_id long, record_seq long, {CONTENT}")
    for part in ((1, 2, 3), (4, 5, 9), (6, 7, 8, 9)):  # scan 5 comes in two batches
        df.where(F.col("record_seq").isin(*part)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    done = spark.createDataFrame([("p1",), ("p7",)], "canonical_page_id string")
    R.record(stream, f"{tmp_path}/out", CONTENT, done).awaitTermination()
    got = {n: spark.read.parquet(f"{tmp_path}/out/{n}") for n in ("scans", "detections", "pins", "refused", "reopened")}
    assert sorted((r["scan_id"], r["record_seq"], r["canonical_page_id"]) for r in got["scans"].collect()) == [(1, 1, "p1"), (2, 2, "p2"), (4, 8, "p1"), (5, 9, "p5")]
    assert sorted((r["scan_id"], r["detection_id"], r["x"], r["y"], r["x1"]) for r in got["detections"].collect()) == [(1, 1, 4.0, 2.0, 10.0), (1, 2, 5.0, 2.0, 10.0), (5, 1, 1.0, 2.0, 10.0)]
    assert sorted((r["scan_id"], r["pin_id"], r["origin"], r["state"], r["version"]) for r in got["pins"].collect()) == [(s, p, "machine", "unreviewed", 1) for s, p in ((1, 1), (1, 2), (5, 1))]
    assert sorted((r["scan_id"], r["record_seq"], r["problem"]) for r in got["refused"].collect()) == [(1, 4, "other_content"), (2, 7, "other_content"), (3, 5, "duplicate_detection")]
    assert {r["canonical_page_id"] for r in got["reopened"].collect()} == {"p1"}
    before = {n: df.count() for n, df in got.items()}
    df.where("record_seq IN (1, 9)").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")  # the stream goes on: nothing new
    R.record(stream, f"{tmp_path}/out", CONTENT, done).awaitTermination()
    assert before == {n: spark.read.parquet(f"{tmp_path}/out/{n}").count() for n in before}
