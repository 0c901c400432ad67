"""Training sets: samples, pages, annotations, tiles, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markset.functions import geometry as G
from markset.functions.hashing import short_id, split_for
from markset.operators.graph import greedy_keep
from markset.operators.reviews import page_completeness
from markset.operators.spatial import conflict_test


def verifier_samples(labels: DataFrame, scans: DataFrame, fractions: dict[str, float] | None = None, seed: int = 0) -> DataFrame:
    """Every labelled pin of every scan, split by its document's hash."""
    done = labels.where(F.col("label").isNotNull()).join(scans.select("scan_id", "canonical_page_id", "document_id"), "scan_id")
    example = F.concat_ws("/", F.col("scan_id").cast("string"), F.col("pin_id").cast("string"))
    return done.select(short_id(example).alias("sample_id"), example.alias("source_example_id"), (F.col("label") == "positive").cast("int").alias("label"),
                       "canonical_page_id", "document_id", "x", "y", split_for(F.col("document_id"), fractions, seed).alias("split"))


def detector_pages(labels: DataFrame, scans: DataFrame, pins: DataFrame, page_reviews: DataFrame, fractions: dict[str, float] | None = None,
                   seed: int = 0) -> DataFrame:
    """Complete pages with the number of positive points on their latest scan."""
    pages = page_completeness(scans, pins, page_reviews).where("complete")
    pts = labels.where(F.col("label") == "positive").groupBy("scan_id").agg(F.count(F.lit(1)).alias("points"))
    return pages.join(pts, "scan_id", "left").fillna(0, ["points"]).select(
        short_id(F.col("canonical_page_id")).alias("page_key"), "canonical_page_id", "document_id", "scan_id", "points",
        split_for(F.col("document_id"), fractions, seed).alias("split"))


def dataset_counts(samples: DataFrame, pages: DataFrame) -> DataFrame:
    """Labels, pages, points and documents per split."""
    v = samples.groupBy("split", "document_id").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")) \
        .groupBy("split").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.count(F.lit(1)).alias("documents"))
    d = pages.groupBy("split").agg(F.count(F.lit(1)).alias("pages"), F.sum("points").alias("points"))
    return v.join(d, "split", "full").fillna(0)


def verify_dataset(listed: DataFrame, present: DataFrame, key: str, digest: str) -> DataFrame:
    """Entries missing on disk, files nobody listed, digests that differ, keys listed twice."""
    twice = listed.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key, F.lit("listed_twice").alias("problem"))
    l, p = listed.select(key, F.col(digest).alias("want")).distinct(), present.select(key, F.col(digest).alias("have"))
    j = l.join(p, key, "full")
    problem = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "not_listed").when(F.col("want") != F.col("have"), "changed")
    return j.select(key, problem.alias("problem")).where("problem IS NOT NULL").unionByName(twice)


def listing_difference(listed: DataFrame, present: DataFrame) -> DataFrame:
    """Rows only in the manifest or only on disk."""
    return listed.exceptAll(present).withColumn("only_in", F.lit("manifest")).unionByName(present.exceptAll(listed).withColumn("only_in", F.lit("disk")))


def dataset_annotations(pins: DataFrame, width: float, height: float) -> DataFrame:
    """One box per reviewed symbol of a page, duplicates across scans removed in order.

    ``pins``: page_id, box_id, record_seq, pin_id, class_label, x, y, template_w,
    template_h and x0..y1 (null without a box of its own). Boxes are clipped to the page.
    """
    own = F.col("x0").isNotNull()
    half_w, half_h = F.col("template_w") / 2, F.col("template_h") / 2
    raw = [F.when(own, F.col("x0")).otherwise(F.col("x") - half_w), F.when(own, F.col("y0")).otherwise(F.col("y") - half_h),
           F.when(own, F.col("x1")).otherwise(F.col("x") + half_w), F.when(own, F.col("y1")).otherwise(F.col("y") + half_h)]
    cut = [F.greatest(raw[0], F.lit(0.0)), F.greatest(raw[1], F.lit(0.0)), F.least(raw[2], F.lit(float(width))), F.least(raw[3], F.lit(float(height)))]
    boxed = pins.withColumns(dict(zip(("x0", "y0", "x1", "y1"), cut))).where((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
    kept = greedy_keep(boxed, [F.col("record_seq").alias("o1"), F.col("pin_id").alias("o2")], conflict_test(0.5, 0.0)).where("kept")
    return boxed.join(kept.select("page_id", "box_id"), ["page_id", "box_id"])


def tiles(pages: DataFrame, size: int, overlap: int) -> DataFrame:
    """Tile windows of every page; the last row and column shift back inside."""
    w, h = F.col("width"), F.col("height")
    out = (pages.withColumn("tx", F.explode(G.tile_starts(w, size, overlap))).withColumn("ty", F.explode(G.tile_starts(h, size, overlap))))
    return out.withColumn("tx1", F.least(F.col("tx") + size, w)).withColumn("ty1", F.least(F.col("ty") + size, h))


def tile_annotations(anns: DataFrame, tiled: DataFrame, min_visible: float = 0.5) -> DataFrame:
    """Boxes in tile coordinates for every tile that shows at least half of them."""
    from markset.operators.spatial import box_join

    win = tiled.select("page_id", "tx", "ty", "tx1", "ty1", *[F.col(a).cast("double").alias(b) for a, b in zip(("tx", "ty", "tx1", "ty1"), ("x0", "y0", "x1", "y1"))])
    j = box_join(win, anns.select("page_id", "box_id", "class_label", "x0", "y0", "x1", "y1"))
    seen, local = G.clip_to_tile([F.col(c) for c in ("rx0", "ry0", "rx1", "ry1")], [F.col(c) for c in ("x0", "y0", "x1", "y1")], min_visible)
    return j.where(seen).select("page_id", "tx", "ty", "box_id", "class_label", *[c.alias(n) for c, n in zip(local, ("bx0", "by0", "bx1", "by1"))])


def first_point_box(points: DataFrame, size: Column, width: Column, height: Column) -> DataFrame:
    """Template box around the first point of every page, shifted inside the page."""
    first = points.groupBy("page_id").agg(F.min_by(F.struct("x", "y"), "point_no").alias("p"))
    x0 = F.greatest(F.lit(0.0), F.least(F.col("p.x") - size / 2, width - size))
    y0 = F.greatest(F.lit(0.0), F.least(F.col("p.y") - size / 2, height - size))
    return first.select("page_id", x0.alias("x0"), y0.alias("y0"), (x0 + size).alias("x1"), (y0 + size).alias("y1"))


def newest_template(files: DataFrame, key: str = "tag") -> DataFrame:
    return files.groupBy(key).agg(F.max_by("path", F.struct("mtime", "path")).alias("path"), F.max("mtime").alias("mtime"))


