"""Exports: page reports, label exports, COCO, counts and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markset.functions.hashing import canonical_json, table_digest
from markset.functions.text import csv_cell
from markset.operators.dataset import tile_annotations, tiles
from markset.operators.reviews import exclude_held_out, label_conflicts, snapshot
from markset.operators.running import dense_ids


def page_report(pins: DataFrame, detections: DataFrame) -> DataFrame:
    """Original detector output and corrected pins side by side, never mixed: every row
    says which it is. Corrected pins are approved machine and added manual ones."""
    original = detections.select(F.lit("original").alias("provenance"), "scan_id", F.col("detection_id").alias("item_id"),
                                 F.lit("machine").alias("origin"), "score")
    machine = F.col("origin") == "machine"
    final = pins.where((machine & (F.col("state") == "approved")) | (~machine & (F.col("state") == "added")))
    corrected = (final.join(detections.select("scan_id", "detection_id", "score"), ["scan_id", "detection_id"], "left")
                 .select(F.lit("corrected").alias("provenance"), "scan_id", F.col("pin_id").alias("item_id"), "origin", "score"))
    return original.unionByName(corrected)


def write_baseline(scores: DataFrame, path: str) -> None:
    """One row with the tolerance and the gated metrics."""
    scores.select("tolerance_px", "tolerance_rel", "ap", "recall", "f1").write.mode("overwrite").json(path)


def write_counts_csv(counts: DataFrame, path: str) -> None:
    """Counts per sheet and tag with formula-safe cells."""
    cols = ("sheet", "tag", "found", "approved", "rejected", "added", "confirmed", "unreviewed")
    counts.select(csv_cell(F.col("sheet")).alias("sheet"), csv_cell(F.col("tag")).alias("tag"), *cols[2:]).write.mode("overwrite").option("header", True).csv(path)


def export_labels(scans: DataFrame, labels: DataFrame, crops: DataFrame, events: DataFrame, page_reviews: DataFrame, splits: DataFrame,
                  templates: DataFrame, include_unlabeled: bool = True, include_heldout: bool = False) -> dict[str, DataFrame]:
    """Tables of a label export. Held-out documents stay out unless asked for; every other
    table is cut down to the scans that remain."""
    picked = scans if include_heldout else exclude_held_out(scans, splits)
    snap = snapshot(picked, splits, {"examples": labels, "events": events})
    examples = snap["examples"] if include_unlabeled else snap["examples"].where(F.col("label").isNotNull())
    used = crops.join(picked.select("scan_id"), "scan_id", "left_semi")
    return {"scans": snap["scans"], "examples": examples, "crops": used, "events": snap["events"], "label_conflicts": label_conflicts(used),
            "page_reviews": page_reviews.join(picked.select("canonical_page_id"), "canonical_page_id", "left_semi"),
            "splits": splits.join(picked.select("document_id"), "document_id", "left_semi"),
            "templates": templates.join(picked.select("template_id"), "template_id", "left_semi")}


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def coco_tables(pages: DataFrame, anns: DataFrame, tile: tuple[int, int] | None = None) -> dict[str, DataFrame]:
    """Images, annotations and categories with dense ids in page, window and box order.

    ``pages``: page_id, width, height, stem; ``anns``: page_id, box_id, class_label, x0..y1.
    """
    if tile is None:
        windows = pages.withColumns({"tx": F.lit(0).cast("bigint"), "ty": F.lit(0).cast("bigint"), "tx1": F.col("width"), "ty1": F.col("height")})
        placed = anns.select("page_id", F.lit(0).cast("bigint").alias("tx"), F.lit(0).cast("bigint").alias("ty"), "box_id", "class_label",
                             *[F.col(a).alias(b) for a, b in zip(("x0", "y0", "x1", "y1"), ("bx0", "by0", "bx1", "by1"))])
        name = F.concat("stem", F.lit(".png"))
    else:
        windows = tiles(pages, *tile)
        placed = tile_annotations(anns, windows)
        name = F.concat("stem", F.lit("_x"), F.col("tx").cast("string"), F.lit("_y"), F.col("ty").cast("string"), F.lit(".png"))
    images = dense_ids(windows, ["page_id", "ty", "tx"], "image_id").select(
        "image_id", "page_id", "tx", "ty", (F.col("tx1") - F.col("tx")).alias("width"), (F.col("ty1") - F.col("ty")).alias("height"), name.alias("file_name"))
    cats = dense_ids(anns.select(F.col("class_label").alias("name")).distinct(), ["name"], "category_id").select("category_id", "name")
    j = placed.join(images.select("image_id", "page_id", "tx", "ty"), ["page_id", "tx", "ty"]).join(cats, placed["class_label"] == cats["name"])
    w, h = F.col("bx1") - F.col("bx0"), F.col("by1") - F.col("by0")
    out = dense_ids(j, ["image_id", "box_id"], "annotation_id").select(
        "annotation_id", "image_id", "category_id", "box_id", *[F.round(c, 3).alias(n) for c, n in ((F.col("bx0"), "x"), (F.col("by0"), "y"), (w, "w"), (h, "h"), (w * h, "area"))])
    return {"images": images, "annotations": out, "categories": cats}


def write_training_dataset(samples: DataFrame, pages: DataFrame, path: str) -> DataFrame:
    """Write both tables and return the content-addressed id of the set."""
    digest = dataset_id(samples, pages)
    write_tables({"verifier": samples, "detector": pages, "meta": digest}, path)
    return digest


def dataset_id(samples: DataFrame, pages: DataFrame) -> DataFrame:
    """Digest of all rows of both tables, the same for any row order or partitioning."""
    s = canonical_json({"sample_id": F.col("sample_id"), "label": F.col("label"), "split": F.col("split")}, ("sample_id", "split"))
    p = canonical_json({"page_key": F.col("page_key"), "points": F.col("points"), "split": F.col("split")}, ("page_key", "split"))
    rows = samples.select(s.alias("r")).unionByName(pages.select(p.alias("r")))
    return table_digest(rows, F.col("r"))
