import json

import pytest
from pyspark.sql import functions as F

from markset.operators import text as X
from markset.operators.corpus import promotion_gate
from markset.sources import exports, readers

FRAME = {"space": "canonical_raster_px", "dpi": 200, "width": 100, "height": 100, "origin": "top-left", "y_axis": "down"}
DOC = {"document_id": "d", "document_version": "sha256:a", "page_index": 0}


def write(path, obj):
    path.write_text(obj if isinstance(obj, str) else json.dumps(obj))


def test_read_detections_refuses_bad_points(spark, tmp_path):
    base = {"format": "f", "format_version": 1, "provenance": "detector_output", "scan_id": "s", "document": DOC, "coordinate_frame": FRAME, "runtime": {"elapsed_seconds": 2.5}}
    dets = [{"id": "a", "x": 1, "y": 1, "score": 0.5}, {"id": "b", "x": 200, "y": 1, "score": 0.5}, {"id": "c", "x": 1, "y": 100, "confidence": 0.9, "score": 0.1},
            {"id": "d", "x": 1, "y": 1, "score": 0.5, "source": "manual"}, {"id": "e", "x": 1, "y": 1}, {"id": "e", "x": 2, "y": 1}]
    write(tmp_path / "a.json", base | {"detections": dets})
    write(tmp_path / "b.json", "{broken")
    out = readers.read_detections(spark, str(tmp_path))
    assert {r["pred_id"]: r["confidence"] for r in out["points"].collect()} == {"a": 0.5, "c": 0.9}
    assert {(r["pred_id"], tuple(r["problems"])) for r in out["refused"].collect()} == {("b", ("outside_frame",)), ("d", ("corrected_pin",)), ("e", ("duplicate_id",))}
    assert out["files"].first()["runtime_seconds"] == 2.5 and out["quarantine"].count() == 1


def test_read_ground_truth_assisted(spark, tmp_path):
    ver = {"status": "detector_assisted", "independent_of_detector": False, "exhaustive_miss_check": False, "reviewed_by": "r"}
    write(tmp_path / "g.json", {"dataset": {"dataset_id": "x", "verification": ver}, "document": DOC, "coordinate_frame": FRAME, "receptacles": [{"id": "1", "x": 0, "y": 100}]})
    out = readers.read_ground_truth(spark, str(tmp_path))
    assert out["files"].first()["problems"] == ["no_miss_check"] and out["points"].count() == 1


def test_read_legends_and_libraries(spark, tmp_path):
    write(tmp_path / "l.json", {"pdf_sha256": "p", "page_index": 2, "entries": [{"id": "L1", "tag": "A", "name": "n", "count": True, "flags": ["wrapped"], "signatures": ["ff"]}]})
    row = readers.read_legends(spark, str(tmp_path / "l.json"))["entries"].first()
    assert (row["entry_id"], row["counted"], row["flags"]) == ("L1", True, ["wrapped"])
    write(tmp_path / "e.json", {"engineer": "bob", "entries": [{"tag": "A", "group": "Power", "count": False}]})
    row = readers.read_libraries(spark, str(tmp_path / "e.json"))["entries"].first()
    assert (row["engineer"], row["grp"], row["counted"]) == ("bob", "Power", False)


def test_read_training_dataset_names_collisions(spark, tmp_path):
    write(tmp_path / "m.json", {"dataset_id": "d", "verifier": [{"sample_id": "a", "split": "train", "label": 1}, {"sample_id": "a", "split": "val", "label": 0}], "detector": []})
    out = readers.read_training_dataset(spark, str(tmp_path), "train")
    assert out["samples"].count() == 1 and [r["key"] for r in out["collisions"].collect()] == ["a"]


def test_points_csv_conflicts(spark, tmp_path):
    (tmp_path / "p.csv").write_text("x,y,page,document,id,version,width,height\n1,2,0,d,,v1,10,10\n3,4,0,d,k,v2,10,10\n5,6,1,d,,v1,10,10\n")
    out = readers.read_points_csv(spark, str(tmp_path / "p.csv"), 2.0)
    assert [(r["id"], r["x"]) for r in out["points"].orderBy("x").collect()] == [("r0001", 2.0), ("k", 6.0), ("r0001", 10.0)]
    assert [r["page"] for r in out["conflicts"].collect()] == [0]


def test_binary_catalog(spark, tmp_path):
    for name in ("a.bin", "b.bin"):
        (tmp_path / name).write_bytes(b"same")
    row = readers.read_documents(spark, str(tmp_path)).first()
    assert row["copies"] == 2 and row["path"].endswith("a.bin")


def test_baseline_and_counts_round_trip(spark, tmp_path):
    one = spark.createDataFrame([(12.0, None, 0.8, 0.7, 0.6)], "tolerance_px double, tolerance_rel double, ap double, recall double, f1 double")
    exports.write_baseline(one, str(tmp_path / "b"))
    assert readers.read_baseline(spark, str(tmp_path / "b")).first()["ap"] == 0.8
    counts = spark.createDataFrame([("1", "=X", 1, 1, 0, 0, 1, 0)], "sheet string, tag string, found int, approved int, rejected int, added int, confirmed int, unreviewed int")
    exports.write_counts_csv(counts, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first()["tag"] == "'=X"


def test_dataset_id_ignores_row_order(spark):
    s = spark.range(50).select(F.col("id").cast("string").alias("sample_id"), (F.col("id") % 2).alias("label"), F.lit("train").alias("split"))
    p = spark.range(5).select(F.col("id").cast("string").alias("page_key"), F.col("id").alias("points"), F.lit("val").alias("split"))
    ids = {exports.dataset_id(df, p).first()["digest"] for df in (s, s.orderBy(F.rand()).repartition(7))}
    assert len(ids) == 1
    assert exports.dataset_id(s.where("sample_id <> '3'"), p).first()["digest"] not in ids


@pytest.mark.parametrize("tp,fp,ok", [(82, 18, True), (81, 18, False)])
def test_gate_boundary_is_exact(spark, tp, fp, ok):
    """Recall up by exactly 0.02 counts as an improvement, a shade less does not."""
    modes = spark.createDataFrame([("base", 80, 20, 20, 5, False), ("cand", tp, fp, 100 - tp, 5, False)], "mode string, tp long, fp long, fn long, documents long, synthetic boolean")
    got = {r["condition"]: r["passed"] for r in promotion_gate(modes, "base", "cand").collect()}
    assert got["meaningful_improvement"] is ok


def test_sheet_fields_known_page(spark):
    words = [("E", 0, 0, 300, 500), ("101", 0, 1, 320, 500), ("SHEET", 1, 0, 300, 460), ("NUMBER", 1, 1, 360, 460), ("TITLE:", 2, 0, 10, 400), ("LIGHTING", 3, 0, 10, 425), ("PLAN", 3, 1, 110, 425),
             ("REV", 4, 0, 600, 300), ("A", 5, 0, 602, 325), ("B", 6, 0, 602, 350)]
    df = spark.createDataFrame([(0, 0, ln, w, t, float(x), float(y), float(x + 10 * len(t)), float(y + 18), 90.0) for t, ln, w, x, y in words],
                               "page_id long, rotation int, line_no int, word_no int, text string, x0 double, y0 double, x1 double, y1 double, confidence double")
    got = {r["field"]: (r["value"], r["method"]) for r in X.sheet_fields(df).collect()}
    assert got == {"number": ("E101", "label"), "title": ("LIGHTING PLAN", "label"), "revision": ("B", "table")}


def test_ocr_tables_are_written_compressed(spark, tmp_path, monkeypatch):
    from types import SimpleNamespace

    from markset.plans import datasets
    from markset.plans.registry import QUERIES

    words = [(1, 2, i, w, 10.0 * i, 0.0, 10.0 * i + 8, 20.0, c) for i, (w, c) in enumerate([("word", 90.0), ("weak", 10.0), ("x\ty", 90.0), ('qu"ote', 40.0), ("#", 50.0)])]
    fx = spark.createDataFrame(words, "page_id long, line_no long, word_no long, text string, x0 double, y0 double, x1 double, y1 double, confidence double")
    monkeypatch.setattr(datasets, "scratch", lambda t, name: str(tmp_path / name))
    assert [tuple(r) for r in QUERIES["read_ocr_tsv"](SimpleNamespace(spark=spark, fx_words=fx)).collect()] == [(1, 2, 3)]
    parts = [p.name for p in (tmp_path / "ocr").glob("part-*")]
    assert parts and all(p.endswith(".gz") for p in parts)
