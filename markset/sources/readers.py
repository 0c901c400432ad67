"""Readers from nested JSON, CSV, TSV and binary files to flat tables.

Every reader declares its schema and returns unreadable records under
``quarantine``. ``multiline`` reads one document per file; off, one per line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markset import schemas as S
from markset.functions.text import canonical_page_id
from markset.operators import validate as V
from markset.operators.running import number_rows


def _json(spark: SparkSession, path: str, schema: str, multiline: bool) -> tuple[DataFrame, DataFrame]:
    """Parsed documents and, apart from them, the text of those that cannot be parsed."""
    raw = spark.read.text(path, wholetext=multiline).withColumn("_file", F.col("_metadata.file_path"))
    doc = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    df = raw.select("_file", "value", doc.alias("doc"))
    bad = F.col("doc").isNull() | F.col("doc._corrupt_record").isNotNull()
    return (df.where(~bad).select("_file", "doc.*").drop("_corrupt_record"),
            df.where(bad).select("_file", F.col("value").alias("_corrupt_record")))


def _csv_bad(df: DataFrame, column: str) -> DataFrame:
    """Unreadable rows. A parsed column is looked at as well: Spark refuses to read the
    corrupt-record column alone."""
    return df.where(F.col("_corrupt_record").isNotNull() & (F.length(F.coalesce(F.col(column).cast("string"), F.lit(""))) >= 0))


def _page(doc: str = "document") -> list:
    return [F.col(f"{doc}.{c}").alias(c) for c in ("document_id", "document_version", "page_index")]


def read_scan_results(spark: SparkSession, path: str, multiline: bool = True) -> dict[str, DataFrame]:
    """Scan results as scans, detections and one unreviewed machine pin per detection.

    The point of a detection defaults to the centre of its box; coordinates are
    kept to three decimals.
    """
    good, bad = _json(spark, path, S.SCAN_RESULT, multiline)
    scans = good.select("scan_id", *_page(), canonical_page_id(F.col("document.document_version"), F.col("document.page_index")).alias("canonical_page_id"),
                        F.col("coordinate_frame.width").alias("frame_width"), F.col("coordinate_frame.height").alias("frame_height"), F.col("detector.name").alias("detector_name"),
                        F.to_json("detector.settings").alias("detector_settings"), F.col("template.template_id").alias("template_id"),
                        F.col("metadata")["requested_by"].alias("requested_by"), "created_at")
    d = good.select("scan_id", F.posexplode("detections").alias("det_seq", "d"))
    b = F.col("d.box")
    r3 = lambda c: F.round(c, 3)
    dets = d.select("scan_id", F.col("d.id").alias("detection_id"), r3(b["x"]).alias("x0"), r3(b["y"]).alias("y0"), r3(b["x"] + b["width"]).alias("x1"), r3(b["y"] + b["height"]).alias("y1"),
                    r3(F.coalesce("d.x", b["x"] + b["width"] / 2)).alias("x"), r3(F.coalesce("d.y", b["y"] + b["height"] / 2)).alias("y"), F.col("d.score").alias("score"),
                    F.col("d.rotation").alias("rotation"), F.col("d.source").alias("source"), F.col("d.class_label").alias("class_label"), "det_seq")
    pins = dets.select("scan_id", F.col("detection_id").alias("pin_id"), F.lit("machine").alias("origin"), F.lit("unreviewed").alias("state"), "detection_id", "x", "y",
                       "x0", "y0", "x1", "y1", "class_label", "rotation", F.lit(1).alias("version"))
    return {"scans": scans, "detections": dets, "pins": pins, "quarantine": bad}


def read_detections(spark: SparkSession, path: str, multiline: bool = True) -> dict[str, DataFrame]:
    """Detection files for scoring: files and points; confidence falls back to score."""
    good, bad = _json(spark, path, S.DETECTIONS, multiline)
    seconds = F.coalesce("elapsed_seconds", "runtime.elapsed_seconds")
    files = good.select("scan_id", *_page(), "coordinate_frame.*", "provenance", seconds.alias("runtime_seconds"))
    p = good.select("scan_id", "provenance", *_page(), F.col("coordinate_frame.width").alias("frame_width"), F.col("coordinate_frame.height").alias("frame_height"), F.explode("detections").alias("d"))
    points = p.select("scan_id", "provenance", "document_version", "page_index", "frame_width", "frame_height", F.col("d.id").alias("pred_id"), "d.x", "d.y",
                      F.coalesce("d.confidence", "d.score").alias("confidence"), "d.source", F.col("d.box.width").alias("w"), F.col("d.box.height").alias("h"))
    points = V.validate_rows(points, ["scan_id"], "pred_id", F.col("frame_width"), F.col("frame_height"), box=True).withColumnRenamed("problems", "p1")
    points = V.require_original_output(points).withColumn("problems", F.concat("p1", "problems")).drop("p1")
    ok, refused = V.split_good_bad(points)
    return {"files": V.check_frame(files), "points": ok, "refused": refused, "quarantine": bad}


def read_ground_truth(spark: SparkSession, path: str, multiline: bool = True) -> dict[str, DataFrame]:
    """Reference files and their points."""
    good, bad = _json(spark, path, S.GROUND_TRUTH, multiline)
    v = "dataset.verification"
    files = good.select("dataset.dataset_id", *_page(), "coordinate_frame.*", *[F.col(f"{v}.{c}").alias(c) for c in ("status", "independent_of_detector", "exhaustive_miss_check", "reviewed_by", "source_scan_id")])
    pts = good.select("dataset.dataset_id", *_page(), F.col("coordinate_frame.width").alias("frame_width"), F.col("coordinate_frame.height").alias("frame_height"), F.explode("receptacles").alias("r"))
    pts = pts.select("dataset_id", "document_version", "page_index", "frame_width", "frame_height", F.col("r.id").alias("ref_id"), "r.x", "r.y")
    ok, refused = V.split_good_bad(V.validate_rows(pts, ["document_version", "page_index"], "ref_id", F.col("frame_width"), F.col("frame_height")))
    return {"files": V.check_assisted_reference(files), "points": ok, "refused": refused, "quarantine": bad}


def read_corpus_manifest(spark: SparkSession, path: str, multiline: bool = True) -> dict[str, DataFrame]:
    """Page pairs of a corpus in order, with tags; ``repeated`` pages are named, not merged."""
    good, bad = _json(spark, path, S.MANIFEST, multiline)
    pages = good.select("corpus_id", "tolerance_px", "tolerance_rel", F.posexplode("pages").alias("position", "p")).select("corpus_id", "tolerance_px", "tolerance_rel", "position", "p.*")
    n = pages.groupBy("corpus_id", "detections", "ground_truth").agg(F.count(F.lit(1)).alias("n"))
    pages = pages.join(n, ["corpus_id", "detections", "ground_truth"]).withColumn("repeated", F.col("n") > 1).drop("n")
    return {"pages": pages, "quarantine": bad}


def read_points_csv(spark: SparkSession, path: str, scale: float = 1.0) -> dict[str, DataFrame]:
    """Reference points from CSV, scaled; ids default to r0001, r0002, ... per page. Pages whose
    rows disagree on version or size are listed under ``conflicts``."""
    df = spark.read.schema(S.POINTS_CSV).option("header", True).option("columnNameOfCorruptRecord", "_corrupt_record").csv(path)
    df = df.withColumn("_line", F.monotonically_increasing_id())
    good = df.where("_corrupt_record IS NULL").drop("_corrupt_record")
    page = ["document", "page"]
    # ids count the rows of a page in file order
    nth = F.col("_nth").cast("string")
    made = F.concat(F.lit("r"), F.when(F.length(nth) < 4, F.lpad(nth, 4, "0")).otherwise(nth))
    pts = (number_rows(good, page, "_line", "_nth").withColumn("id", F.coalesce("id", made))
           .withColumns({"x": F.col("x") * scale, "y": F.col("y") * scale}).drop("_nth"))
    same = good.groupBy(*page).agg(*[(F.min(c).eqNullSafe(F.max(c)) & ((F.count(c) == 0) | (F.count(c) == F.count(F.lit(1))))).alias(c) for c in ("version", "width", "height")])
    return {"points": pts.drop("_line"), "conflicts": same.where(~(F.col("version") & F.col("width") & F.col("height"))).select(*page),
            "quarantine": _csv_bad(df, "x").select("_corrupt_record")}


def adapt_scans(scans: DataFrame, detections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scan detections as scoring input: the point is the box centre, which a given point must
    equal to 1e-6, and the score becomes the confidence. Returns rows and refused rows."""
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    j = detections.join(scans.select("scan_id", "document_version", "page_index"), "scan_id")
    off = (F.abs(F.col("x") - cx) > 1e-6) | (F.abs(F.col("y") - cy) > 1e-6)
    j = j.withColumn("problems", V.problems({"point_not_centre": F.coalesce(off, F.lit(False)), "empty_box": ~((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))}))
    out = j.select("scan_id", "document_version", "page_index", F.col("detection_id").alias("pred_id"), cx.alias("x"), cy.alias("y"), F.col("score").alias("confidence"), "problems")
    return V.split_good_bad(out)


def read_ocr_tsv(spark: SparkSession, path: str, min_conf: float = 0.0) -> dict[str, DataFrame]:
    """Words of an OCR table: level 5, text, positive size and enough confidence."""
    df = (spark.read.schema(S.OCR_TSV).option("header", True).option("sep", "\t").option("quote", "")
          .option("columnNameOfCorruptRecord", "_corrupt_record").csv(path).withColumn("_file", F.col("_metadata.file_path")))
    good = df.where("_corrupt_record IS NULL AND level = 5").where((F.trim("text") != "") & (F.col("width") > 0) & (F.col("height") > 0) & (F.col("conf") >= min_conf))
    words = good.select("_file", "page_num", "block_num", "par_num", "line_num", F.col("word_num").alias("word_no"), F.trim("text").alias("text"), F.col("left").alias("x0"), F.col("top").alias("y0"),
                        (F.col("left") + F.col("width")).alias("x1"), (F.col("top") + F.col("height")).alias("y1"), F.col("conf").alias("confidence"))
    return {"words": words, "quarantine": _csv_bad(df, "level").select("_file", "_corrupt_record")}


def read_legends(spark: SparkSession, path: str, multiline: bool = True) -> dict[str, DataFrame]:
    good, bad = _json(spark, path, S.LEGEND, multiline)
    e = good.select(F.col("pdf_sha256").alias("legend_id"), "page_index", "engineer", F.posexplode("entries").alias("entry_no", "e"))
    return {"entries": e.select("legend_id", "page_index", "engineer", "entry_no", *[F.col(f"e.{c}").alias(n) for c, n in (
        ("id", "entry_id"), ("tag", "tag"), ("tag_source", "tag_source"), ("name", "name"), ("description", "description"), ("group", "grp"), ("count", "counted"),
        ("labels", "labels"), ("flags", "flags"), ("source", "source"), ("confirmed", "confirmed"), ("signatures", "signatures"), ("symbol_boxes", "symbol_boxes"))]), "quarantine": bad}


def read_libraries(spark: SparkSession, path: str, multiline: bool = True) -> dict[str, DataFrame]:
    good, bad = _json(spark, path, S.LIBRARY, multiline)
    e = good.select("engineer", F.posexplode("entries").alias("saved_no", "e"))
    return {"entries": e.select("engineer", "saved_no", "e.tag", "e.name", "e.description", F.col("e.group").alias("grp"), F.col("e.count").alias("counted"), "e.signatures", "e.projects"), "quarantine": bad}


def catalog_documents(files: DataFrame) -> DataFrame:
    """One row per distinct content: ``document_version`` is its digest, ``path`` the first
    path it was seen under. ``files``: path, content."""
    d = files.select("path", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("document_version"), F.length("content").alias("size"))
    return d.groupBy("document_version").agg(F.min("path").alias("path"), F.max("size").alias("size"), F.count(F.lit(1)).alias("copies"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return catalog_documents(spark.read.format("binaryFile").load(path).select("path", "content"))


def read_training_dataset(spark: SparkSession, path: str, split: str, multiline: bool = True) -> dict[str, DataFrame]:
    """Samples and pages of one split; keys that occur twice are listed under ``collisions``."""
    good, bad = _json(spark, path, S.TRAINING_MANIFEST, multiline)
    samples = good.select("dataset_id", F.explode("verifier").alias("v")).select("dataset_id", "v.*")
    pages = good.select("dataset_id", F.explode("detector").alias("d")).select("dataset_id", "d.*")
    twice = lambda df, k: df.groupBy("dataset_id", k).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("dataset_id", F.col(k).alias("key"))
    return {"samples": samples.where(F.col("split") == split), "pages": pages.where(F.col("split") == split),
            "collisions": twice(samples, "sample_id").unionByName(twice(pages, "page_key")), "quarantine": bad}


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("tolerance_px double, tolerance_rel double, ap double, recall double, f1 double").json(path)
