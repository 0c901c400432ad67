"""Validation, source round trips, training sets and exports."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from markset.fixtures import cte
from markset.functions import hashing as H
from markset.operators import corpus
from markset.operators import dataset as D
from markset.operators import validate as V
from markset.plans.registry import query
from markset.plans.reviews import CROPS, FXR, LABELS, LATEST, crops_of, labels_of
from markset.session import checkpoint_root
from markset.sources import exports, readers


def scratch(t, name):
    return os.path.join(checkpoint_root(t.spark), f"{name}-{uuid.uuid4().hex}")


@query("validate_rows", "B1", cte("fx_detections") + """, d AS (SELECT page_id, CASE WHEN det_id % 50 = 0 THEN '' ELSE CAST(CASE WHEN det_id % 37 = 0 THEN 0 ELSE det_id END AS VARCHAR) END AS id, CASE WHEN det_id % 41 = 0 THEN 'nan'::DOUBLE ELSE x*1.02 END AS x, y, CASE WHEN det_id % 43 = 0 THEN 0 ELSE w END AS w, h FROM fx_detections),
    c AS (SELECT *, count(*) OVER (PARTITION BY page_id, id) > 1 AS dup FROM d),
    p AS (SELECT page_id, array_to_string(list_filter([CASE WHEN trim(id)='' THEN 'empty_id' END, CASE WHEN isnan(x) THEN 'not_finite' END, CASE WHEN NOT isnan(x) AND x > 3400 THEN 'outside_frame' END,
      CASE WHEN dup THEN 'duplicate_id' END, CASE WHEN NOT (w>0 AND h>0) THEN 'empty_box' END], lambda v: v IS NOT NULL), ',') AS problems FROM c) SELECT page_id, problems, count(*) AS n FROM p GROUP BY ALL""")
def _(t):
    k = F.col("det_id")
    d = t.fx_detections.select("page_id", F.when(k % 50 == 0, "").otherwise(F.when(k % 37 == 0, F.lit(0)).otherwise(k).cast("string")).alias("id"),
                               F.when(k % 41 == 0, float("nan")).otherwise(F.col("x") * 1.02).alias("x"), "y", F.when(k % 43 == 0, 0.0).otherwise(F.col("w")).alias("w"), "h")
    out = V.validate_rows(d, ["page_id"], "id", F.lit(3400), F.lit(2200), box=True)
    return out.groupBy("page_id", F.array_join("problems", ",").alias("problems")).agg(F.count(F.lit(1)).alias("n"))


@query("require_original_output", "B2", """SELECT l_orderkey, l_linenumber, array_to_string(list_filter([CASE WHEN l_returnflag='A' THEN 'corrected_pin' END, CASE WHEN l_returnflag='R' THEN 'unknown_source' END,
    CASE WHEN l_linestatus='O' THEN 'not_original' END], lambda v: v IS NOT NULL), ',') AS problems, count(*) AS n FROM lineitem GROUP BY ALL""")
def _(t):
    rf = F.col("l_returnflag")
    df = t.lineitem.select("l_orderkey", "l_linenumber", F.when(rf == "A", "manual").when(rf == "R", "robot").alias("source"), F.when(F.col("l_linestatus") == "O", "edited").otherwise("detector_output").alias("provenance"))
    out = V.require_original_output(df)
    return out.groupBy("l_orderkey", "l_linenumber", F.array_join("problems", ",").alias("problems")).agg(F.count(F.lit(1)).alias("n"))


@query("check_pairs", "B3", cte("fx_pages") + """, d AS (SELECT page_id, document_id, 3400 AS width, 2200 AS height FROM fx_pages WHERE acctbal > -500), r AS (SELECT page_id, CASE WHEN region_id=2 THEN 'other' ELSE document_id END AS document_id,
      CASE WHEN acctbal > 5000 THEN 3300 ELSE 3400 END AS width, 2200 AS height FROM fx_pages WHERE acctbal < 9000),
    p AS (SELECT page_id, array_to_string(list_filter([CASE WHEN d.page_id IS NULL THEN 'missing_detections' END, CASE WHEN r.page_id IS NULL THEN 'missing_reference' END, CASE WHEN d.document_id<>r.document_id THEN 'document_id_differs' END,
      CASE WHEN d.width<>r.width THEN 'width_differs' END, CASE WHEN d.height<>r.height THEN 'height_differs' END], lambda v: v IS NOT NULL), ',') AS problems FROM d FULL JOIN r USING (page_id)) SELECT * FROM p WHERE problems <> ''""")
def _(t):
    d = t.fx_pages.where("acctbal > -500").select("page_id", "document_id", F.lit(3400).alias("width"), F.lit(2200).alias("height"))
    r = t.fx_pages.where("acctbal < 9000").select("page_id", F.when(F.col("region_id") == 2, "other").otherwise(F.col("document_id")).alias("document_id"), F.when(F.col("acctbal") > 5000, 3300).otherwise(3400).alias("width"), F.lit(2200).alias("height"))
    return corpus.check_pairs(d, r, "page_id", ["document_id", "width", "height"]).withColumn("problems", F.array_join("problems", ","))


@query("check_assisted_reference", "B4", """SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderpriority='5-LOW' THEN 'unknown_status' END, CASE WHEN o_orderstatus='F' AND o_orderpriority<>'5-LOW' AND o_orderkey%3=0 THEN 'assisted_claims_independence' END,
    CASE WHEN o_orderstatus='F' AND o_orderpriority<>'5-LOW' AND o_custkey%2=0 THEN 'no_miss_check' END, CASE WHEN o_orderstatus='F' AND o_orderpriority<>'5-LOW' AND o_custkey%5=0 THEN 'no_reviewer' END,
    CASE WHEN NOT (o_orderstatus='F' AND o_orderpriority<>'5-LOW') AND o_orderkey%3<>0 THEN 'not_independent' END], lambda v: v IS NOT NULL), ',') AS problems FROM orders""")
def _(t):
    df = t.orders.select("o_orderkey", F.when(F.col("o_orderpriority") == "5-LOW", "guessed").when(F.col("o_orderstatus") == "F", "detector_assisted").otherwise("verified").alias("status"),
                         (F.col("o_orderkey") % 3 == 0).alias("independent_of_detector"), (F.col("o_custkey") % 2 != 0).alias("exhaustive_miss_check"), F.when(F.col("o_custkey") % 5 != 0, "r").alias("reviewed_by"))
    return V.check_assisted_reference(df).select("o_orderkey", F.array_join("problems", ",").alias("problems"))


@query("refuse_scan", "B11", cte("fx_legend") + """, e AS (SELECT legend_id, bool_or(entry_no % 97 = 0) AS mm, bool_or(counted AND entry_no % 2 = 0) AS cn, count(*) FILTER (WHERE entry_no % 31 = 0) AS ck, max(entry_no % 8) AS asked FROM fx_legend GROUP BY 1),
    p AS (SELECT legend_id, array_to_string(list_filter([CASE WHEN mm THEN 'legend_mismatch' END, CASE WHEN NOT cn THEN 'nothing_to_count' END, CASE WHEN ck>0 THEN 'legend_needs_review' END, CASE WHEN asked > 6 THEN 'page_index_out_of_range' END], lambda v: v IS NOT NULL), ',') AS problems FROM e) SELECT * FROM p""")
def _(t):
    k = F.col("entry_no")
    e = t.fx_legend.select("legend_id", F.lit("d").alias("legend_digest"), F.when(k % 97 == 0, "x").otherwise("d").alias("document_digest"), F.when(k % 31 == 0, "check").otherwise("ok").alias("status"), "counted", (k % 2 == 0).alias("has_drawing"))
    p = t.fx_legend.select("legend_id", (k % 8).alias("page_index"), F.lit(7).alias("n_pages"))
    return V.refuse_scan(e, p).withColumn("problems", F.array_join("problems", ","))


ITEMS = """items AS (SELECT l_suppkey AS page_id, CASE l_linenumber WHEN 1 THEN 'image' WHEN 2 THEN 'placement' ELSE 'segment' END AS item, l_quantity*l_quantity*({k}) AS area FROM lineitem)"""


@query("classify_pages", "B7 D33", "WITH " + ITEMS.format(k="l_suppkey % 7") + """, s AS (SELECT page_id, count(*) FILTER (WHERE item='segment') AS segments, count(*) FILTER (WHERE item='placement') AS placements, least(coalesce(sum(area) FILTER (WHERE item='image'),0)/400000.0::DOUBLE,1) AS c FROM items GROUP BY 1)
    SELECT page_id, segments, placements, round(c,6) AS image_coverage, CASE WHEN c>=0.5 AND segments<200 THEN 'raster' WHEN c>=0.15 THEN 'mixed' ELSE 'vector' END AS kind FROM s""")
def _(t):
    n = F.col("l_linenumber")
    items = t.lineitem.select(F.col("l_suppkey").alias("page_id"), F.when(n == 1, "image").when(n == 2, "placement").otherwise("segment").alias("item"), (F.col("l_quantity") * F.col("l_quantity") * (F.col("l_suppkey") % 7)).alias("area"))
    return V.classify_pages(V.page_ink_stats(items, F.lit(400000.0))).withColumn("image_coverage", F.round("image_coverage", 6))


SPLIT = "CASE WHEN ('0x' || substr(sha256({k}),1,16))::UBIGINT / 18446744073709551616.0::DOUBLE < 0.7 THEN 'train' WHEN ('0x' || substr(sha256({k}),1,16))::UBIGINT / 18446744073709551616.0::DOUBLE < 0.85 THEN 'val' ELSE 'test' END"


@query("split_by_hash", "H11", "SELECT doc_id, round(('0x' || substr(sha256(CAST(doc_id AS VARCHAR)),1,16))::UBIGINT / 18446744073709551616.0::DOUBLE, 9) AS u, " + SPLIT.format(k="CAST(doc_id AS VARCHAR)") + " AS split, "
       + SPLIT.format(k="'7:' || CAST(doc_id AS VARCHAR)") + " AS split7 FROM documents")
def _(t):
    k = F.col("doc_id").cast("string")
    return t.documents.select("doc_id", F.round(H.split_value(k), 9).alias("u"), H.split_for(k).alias("split"), H.split_for(k, seed=7).alias("split7"))


@query("crop_keys", "H5 H4", cte("fx_detections") + """ SELECT page_id, det_id, sha256('{"document_version":"sha256:d' || CAST(page_id AS VARCHAR) || '","margin":24,"page_index":' || CAST(page_id % 4 AS VARCHAR) || ',"x0":' || CAST(CAST(floor(x-w/2)-24 AS BIGINT) AS VARCHAR)
    || ',"x1":' || CAST(CAST(ceil(x+w/2)+24 AS BIGINT) AS VARCHAR) || ',"y0":' || CAST(CAST(floor(y-h/2)-24 AS BIGINT) AS VARCHAR) || ',"y1":' || CAST(CAST(ceil(y+h/2)+24 AS BIGINT) AS VARCHAR) || '}') AS crop_key FROM fx_detections""")
def _(t):
    from markset.functions.geometry import detection_window

    x, y, w, h = (F.col(c) for c in "xywh")
    win = detection_window([x - w / 2, y - h / 2, x + w / 2, y + h / 2])
    key = H.crop_key(F.concat(F.lit("sha256:d"), F.col("page_id").cast("string")), F.col("page_id") % 4, win, F.lit(24))
    return t.fx_detections.select("page_id", "det_id", key.alias("crop_key"))


TS = FXR + f""", {LABELS}, {LATEST}, smp AS (SELECT substr(sha256(CAST(l.scan_id AS VARCHAR) || '/' || CAST(l.pin_id AS VARCHAR)),1,24) AS sample_id, CASE label WHEN 'positive' THEN 1 ELSE 0 END AS label, s.document_id, {SPLIT.format(k='s.document_id')} AS split
      FROM labels_c l JOIN fx_scans s USING (scan_id) WHERE label IS NOT NULL),
    op AS (SELECT scan_id, count(*) AS n FROM fx_pins WHERE origin='machine' AND state='unreviewed' GROUP BY 1), pt AS (SELECT scan_id, count(*) AS points FROM labels_c WHERE label='positive' GROUP BY 1),
    pgs AS (SELECT substr(sha256(l.canonical_page_id),1,24) AS page_key, l.document_id, coalesce(pt.points,0) AS points, {SPLIT.format(k='l.document_id')} AS split FROM latest l JOIN fx_page_reviews r USING (canonical_page_id) LEFT JOIN op USING (scan_id) LEFT JOIN pt USING (scan_id)
      WHERE r.status='complete' AND coalesce(op.n,0)=0)"""


def training_set(t):
    lab = labels_of(t)
    return D.verifier_samples(lab, t.fx_scans), D.detector_pages(lab, t.fx_scans, t.fx_pins, t.fx_page_reviews)


@query("build_training_set", "K15 H11", TS + " SELECT sample_id, label, document_id, split FROM smp")
def _(t):
    return training_set(t)[0].select("sample_id", "label", "document_id", "split")


@query("training_pages", "K15 B12", TS + " SELECT page_key, document_id, points, split FROM pgs")
def _(t):
    return training_set(t)[1].select("page_key", "document_id", "points", "split")


@query("dataset_counts", "D13", TS + """, v AS (SELECT split, count(*) FILTER (WHERE label=1) AS pos, count(*) FILTER (WHERE label=0) AS neg, count(DISTINCT document_id) AS documents FROM smp GROUP BY 1),
    d AS (SELECT split, count(*) AS pages, CAST(sum(points) AS BIGINT) AS points FROM pgs GROUP BY 1)
    SELECT split, coalesce(pos,0) AS pos, coalesce(neg,0) AS neg, coalesce(documents,0) AS documents, coalesce(pages,0) AS pages, coalesce(points,0) AS points FROM v FULL JOIN d USING (split)""")
def _(t):
    return D.dataset_counts(*training_set(t))


@query("dataset_manifest_id", "A15", TS + """, rows_c AS (SELECT sha256('{"label":' || CAST(label AS VARCHAR) || ',"sample_id":"' || sample_id || '","split":"' || split || '"}') AS d FROM smp
      UNION ALL SELECT sha256('{"page_key":"' || page_key || '","points":' || CAST(points AS VARCHAR) || ',"split":"' || split || '"}') FROM pgs),
    g AS (SELECT substr(d,1,4) AS g, sha256(string_agg(d, chr(10) ORDER BY d)) AS h FROM rows_c GROUP BY 1) SELECT sha256(string_agg(g || ':' || h, chr(10) ORDER BY g || ':' || h)) AS digest FROM g""")
def _(t):
    return exports.dataset_id(*training_set(t))


@query("verify_dataset", "B14 G3", """WITH l AS (SELECT doc_id AS k, sha256(text) AS d FROM documents WHERE n_chars % 10 <> 0 UNION ALL SELECT doc_id, sha256(text) FROM documents WHERE n_chars % 10 = 5), p AS (SELECT doc_id AS k, CASE WHEN n_chars % 7 = 0 THEN 'x' ELSE sha256(text) END AS d FROM documents WHERE n_chars % 9 <> 0)
    SELECT k, CASE WHEN p.d IS NULL THEN 'missing' WHEN l.d IS NULL THEN 'not_listed' ELSE 'changed' END AS problem FROM (SELECT DISTINCT * FROM l) l FULL JOIN p USING (k) WHERE l.d IS DISTINCT FROM p.d
    UNION ALL SELECT k, 'listed_twice' FROM l GROUP BY k HAVING count(*) > 1""")
def _(t):
    d = t.documents.select(F.col("doc_id").alias("k"), F.sha2("text", 256).alias("d"), "n_chars")
    listed = d.where("n_chars % 10 <> 0").unionByName(d.where("n_chars % 10 = 5")).select("k", "d")
    present = d.where("n_chars % 9 <> 0").select("k", F.when(F.col("n_chars") % 7 == 0, "x").otherwise(F.col("d")).alias("d"))
    return D.verify_dataset(listed, present, "k", "d")


@query("listing_difference", "G3", """WITH l AS (SELECT doc_id, source FROM documents WHERE n_chars % 10 <> 0), p AS (SELECT doc_id, source FROM documents WHERE n_chars % 9 <> 0)
    SELECT *, 'manifest' AS only_in FROM (SELECT * FROM l EXCEPT ALL SELECT * FROM p) UNION ALL SELECT *, 'disk' FROM (SELECT * FROM p EXCEPT ALL SELECT * FROM l)""")
def _(t):
    d = t.documents.select("doc_id", "source", "n_chars")
    return D.listing_difference(d.where("n_chars % 10 <> 0").drop("n_chars"), d.where("n_chars % 9 <> 0").drop("n_chars"))


@query("catalog_documents", "A13", "SELECT 'sha256:' || sha256(text) AS document_version, min('doc/' || CAST(doc_id AS VARCHAR)) AS path, count(*) AS copies FROM documents GROUP BY 1")
def _(t):
    files = t.documents.select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    return readers.catalog_documents(files).drop("size")


@query("first_point_box", "E18", cte("fx_references") + """, f AS (SELECT page_id, min_by(x, ref_id) AS x, min_by(y, ref_id) AS y FROM fx_references GROUP BY 1)
    SELECT page_id, greatest(0.0::DOUBLE, least(x-32, 3336.0::DOUBLE)) AS x0, greatest(0.0::DOUBLE, least(y-32, 2136.0::DOUBLE)) AS y0, greatest(0.0::DOUBLE, least(x-32, 3336.0::DOUBLE))+64 AS x1, greatest(0.0::DOUBLE, least(y-32, 2136.0::DOUBLE))+64 AS y1 FROM f""")
def _(t):
    return D.first_point_box(t.fx_references.withColumn("point_no", F.col("ref_id")), F.lit(64.0), F.lit(3400.0), F.lit(2200.0))


@query("newest_template", "E19", "SELECT p_brand AS tag, max_by('tpl/' || CAST(p_partkey AS VARCHAR), p_size*1000000+p_partkey) AS path, max(p_size) AS mtime FROM part GROUP BY 1")
def _(t):
    # paths are zero padded in the key so that their text order is their number order
    f = t.part.select(F.col("p_brand").alias("tag"), F.concat(F.lit("tpl/"), F.lpad(F.col("p_partkey").cast("string"), 12, "0")).alias("path"), F.col("p_size").alias("mtime"))
    return D.newest_template(f).withColumn("path", F.regexp_replace("path", r"/0+(?=\d)", "/"))


def annotation_pins(t):
    p = labels_of(t).where("label = 'positive'").join(t.fx_scans.select("scan_id", "canonical_page_id", "record_seq"), "scan_id")
    p = p.join(t.fx_page_reviews.where("status = 'complete'").select("canonical_page_id"), "canonical_page_id", "left_semi")
    box = lambda c, d: F.when(F.col("origin") == "machine", F.col(c) + d)
    return p.select(F.col("canonical_page_id").alias("page_id"), (F.col("scan_id") * 100 + F.col("pin_id")).alias("box_id"), "record_seq", "pin_id", "class_label", "x", "y", F.lit(40.0).alias("template_w"), F.lit(30.0).alias("template_h"),
                    box("x", -60.0).alias("x0"), box("y", -40.0).alias("y0"), box("x", 60.0).alias("x1"), box("y", 40.0).alias("y1"))


ANN = FXR + f""", {LABELS}, raw AS (SELECT s.canonical_page_id AS page_id, l.scan_id*100+l.pin_id AS box_id, CASE WHEN origin='machine' THEN 60 ELSE 20 END AS hw, CASE WHEN origin='machine' THEN 40 ELSE 15 END AS hh, x, y, s.record_seq, l.pin_id, l.class_label
      FROM labels_c l JOIN fx_scans s USING (scan_id) JOIN fx_page_reviews r USING (canonical_page_id) WHERE label='positive' AND r.status='complete'),
    bx AS (SELECT *, greatest(x-hw,0)::DOUBLE AS x0, greatest(y-hh,0)::DOUBLE AS y0, least(x+hw,3400)::DOUBLE AS x1, least(y+hh,2200)::DOUBLE AS y1 FROM raw)"""


@query("dataset_annotations", "K16 E8")
def _(t):
    return D.dataset_annotations(annotation_pins(t), 3400, 2200).select("page_id", "box_id", "class_label", "x0", "y0", "x1", "y1")


@query("annotation_boxes", "K16 H2", ANN + " SELECT page_id, count(*) AS n, round(sum((x1-x0)*(y1-y0)),3) AS area FROM bx GROUP BY 1")
def _(t):
    p = annotation_pins(t)
    half = F.when(F.col("x0").isNotNull(), F.lit(60.0)).otherwise(F.lit(20.0)), F.when(F.col("x0").isNotNull(), F.lit(40.0)).otherwise(F.lit(15.0))
    w = F.least(F.col("x") + half[0], F.lit(3400.0)) - F.greatest(F.col("x") - half[0], F.lit(0.0))
    h = F.least(F.col("y") + half[1], F.lit(2200.0)) - F.greatest(F.col("y") - half[1], F.lit(0.0))
    return p.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(w * h), 3).alias("area"))


def coco_inputs(t):
    pages = t.fx_pages.select("page_id", F.lit(3400).cast("bigint").alias("width"), F.lit(2200).cast("bigint").alias("height"), F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("stem"))
    return pages, t.fx_boxes.select("page_id", "box_id", "class_label", "x0", "y0", "x1", "y1")


TILES = cte("fx_boxes", "fx_pages") + """, tl AS (SELECT page_id, tx, ty, least(tx+1024,3400) AS tx1, least(ty+1024,2200) AS ty1 FROM fx_pages, (SELECT unnest([0,896,1792,2376]) AS tx), (SELECT unnest([0,896,1176]) AS ty)),
    im AS (SELECT *, row_number() OVER (ORDER BY page_id, ty, tx) AS image_id FROM tl)"""


@query("tile_windows", "H12", TILES + " SELECT image_id, page_id, CAST(tx AS BIGINT) AS tx, CAST(ty AS BIGINT) AS ty, 'page-' || CAST(page_id AS VARCHAR) || '_x' || CAST(tx AS VARCHAR) || '_y' || CAST(ty AS VARCHAR) || '.png' AS file_name FROM im")
def _(t):
    pages, anns = coco_inputs(t)
    return exports.coco_tables(pages, anns, (1024, 128))["images"].select("image_id", "page_id", "tx", "ty", "file_name")


@query("export_coco", "A8 H12 D24", TILES + """, cat AS (SELECT class_label, row_number() OVER (ORDER BY class_label) AS category_id FROM (SELECT DISTINCT class_label FROM fx_boxes)),
    a AS (SELECT image_id, category_id, box_id, greatest(x0,tx)-tx AS bx, greatest(y0,ty)-ty AS byy, least(x1,tx1)-greatest(x0,tx) AS bw, least(y1,ty1)-greatest(y0,ty) AS bh, (x1-x0)*(y1-y0) AS full_area FROM im JOIN fx_boxes b USING (page_id) JOIN cat USING (class_label)),
    v AS (SELECT * FROM a WHERE bw>0 AND bh>0 AND bw*bh/full_area >= 0.5)
    SELECT row_number() OVER (ORDER BY image_id, box_id) AS annotation_id, image_id, category_id, box_id, round(bx,3) AS x, round(byy,3) AS y, round(bw,3) AS w, round(bh,3) AS h, round(bw*bh,3) AS area FROM v""")
def _(t):
    pages, anns = coco_inputs(t)
    return exports.coco_tables(pages, anns, (1024, 128))["annotations"]


@query("export_labels", "A7 C9 D20", FXR + f""", {CROPS}, s AS (SELECT * FROM fx_scans WHERE document_id NOT IN (SELECT document_id FROM fx_splits WHERE split IN ('test','eval')))
    SELECT 'scans' AS part, count(*) AS n FROM s UNION ALL SELECT 'examples', count(*) FROM labels_c JOIN s USING (scan_id) UNION ALL SELECT 'events', count(*) FROM fx_events JOIN s USING (scan_id) UNION ALL SELECT 'crops', count(*) FROM crops_c WHERE scan_id IN (SELECT scan_id FROM s)
    UNION ALL SELECT 'label_conflicts', count(*) FROM (SELECT crop_key FROM crops_c WHERE scan_id IN (SELECT scan_id FROM s) AND label IS NOT NULL GROUP BY 1 HAVING count(DISTINCT label)>1)
    UNION ALL SELECT 'page_reviews', count(DISTINCT canonical_page_id) FROM s UNION ALL SELECT 'splits', count(DISTINCT document_id) FROM s UNION ALL SELECT 'templates', count(DISTINCT template_id) FROM s""")
def _(t):
    templates = t.fx_scans.select("template_id").distinct()
    out = exports.export_labels(t.fx_scans, labels_of(t), crops_of(t), t.fx_events, t.fx_page_reviews, t.fx_splits, templates)
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n") for name, df in out.items()]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def scan_documents(t):
    """Scan results as JSON, one per scan: at most thirteen detections each."""
    d = t.fx_pin_detections.join(t.fx_pins.select("scan_id", F.col("pin_id").alias("detection_id"), "x", "y", "class_label"), ["scan_id", "detection_id"])
    num = lambda v: v.cast("double")
    det = F.struct(F.col("detection_id").cast("string").alias("id"), "score", F.lit(0).alias("rotation"), F.lit("detector").alias("source"), "class_label",
                   F.struct(num(F.col("x") - 20).alias("x"), num(F.col("y") - 15).alias("y"), F.lit(40.0).alias("width"), F.lit(30.0).alias("height")).alias("box"))
    per = d.groupBy("scan_id").agg(F.array_sort(F.collect_list(F.struct("detection_id", det.alias("d")))).alias("ds"))
    s = t.fx_scans.join(per, "scan_id")
    frame = F.struct(F.lit("canonical_raster_px").alias("space"), F.lit(200.0).alias("dpi"), F.lit(3400).alias("width"), F.lit(2200).alias("height"), F.lit("top-left").alias("origin"), F.lit("down").alias("y_axis"))
    doc = F.struct(F.col("scan_id").cast("string").alias("scan_id"), F.struct("document_id", "document_version", "page_index").alias("document"), frame.alias("coordinate_frame"),
                   F.lit("detector_output").alias("provenance"), F.create_map(F.lit("requested_by"), "requested_by").alias("metadata"), (F.col("scan_id") / 4).alias("elapsed_seconds"), F.col("ds.d").alias("detections"))
    return s.select(F.to_json(doc).alias("value"))


def written_scans(t):
    path = scratch(t, "scan-results")
    scan_documents(t).write.text(path)
    return path


RD = FXR + """, r AS (SELECT d.scan_id, d.detection_id, p.x, p.y, d.score, p.class_label FROM fx_pin_detections d JOIN fx_pins p ON p.scan_id=d.scan_id AND p.pin_id=d.detection_id)"""


@query("read_scan_results", "A1", RD + " SELECT CAST(scan_id AS VARCHAR) AS scan_id, CAST(detection_id AS VARCHAR) AS pin_id, 'unreviewed' AS state, x, y, x-20 AS x0, y+15 AS y1, class_label FROM r")
def _(t):
    return readers.read_scan_results(t.spark, written_scans(t), multiline=False)["pins"].select("scan_id", "pin_id", "state", "x", "y", "x0", "y1", "class_label")


@query("adapt_scans", "A6 B1", RD + " SELECT CAST(scan_id AS VARCHAR) AS scan_id, CAST(detection_id AS VARCHAR) AS pred_id, x, y, score AS confidence FROM r")
def _(t):
    r = readers.read_scan_results(t.spark, written_scans(t), multiline=False)
    return readers.adapt_scans(r["scans"], r["detections"])[0].select("scan_id", "pred_id", "x", "y", "confidence")


@query("read_corpus_manifest", "A4", cte("fx_pages") + " SELECT document_id AS document, 'd' || CAST(page_id AS VARCHAR) AS detections, tag FROM fx_pages UNION ALL SELECT document_id, 'd' || CAST(page_id AS VARCHAR), 'all' FROM fx_pages")
def _(t):
    page = F.struct(F.concat(F.lit("d"), F.col("page_id").cast("string")).alias("detections"), F.concat(F.lit("g"), F.col("page_id").cast("string")).alias("ground_truth"), F.col("document_id").alias("document"), F.array("tag", F.lit("all")).alias("tags"))
    # a manifest lists the pages of one corpus: here one corpus per page keeps each file small
    doc = t.fx_pages.select(F.to_json(F.struct(F.col("page_id").cast("string").alias("corpus_id"), F.lit(12.0).alias("tolerance_px"), F.array(page).alias("pages"))).alias("value"))
    path = scratch(t, "manifests")
    doc.write.text(path)
    out = readers.read_corpus_manifest(t.spark, path, multiline=False)["pages"]
    return out.where("NOT repeated").select("document", "detections", F.explode("tags").alias("tag"))


@query("read_points_csv", "A5", cte("fx_references") + """ SELECT CAST(page_id AS INT) AS page, count(*) AS n, round(sum(x*2),3) AS sx, 'r0001' AS first_id FROM fx_references GROUP BY 1""")
def _(t):
    path = scratch(t, "points")
    t.fx_references.select("x", "y", F.col("page_id").cast("int").alias("page"), F.lit("doc").alias("document"), F.lit(None).cast("string").alias("id"), F.lit("v1").alias("version"), F.lit(6800).alias("width"), F.lit(4400).alias("height")).write.option("header", True).csv(path)
    pts = readers.read_points_csv(t.spark, path, scale=2.0)["points"]
    return pts.groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 3).alias("sx"), F.min("id").alias("first_id"))


@query("read_ocr_tsv", "A11 D34", cte("fx_words") + " SELECT page_id AS page_num, line_no AS line_num, count(*) AS n FROM fx_words WHERE confidence >= 30 AND length(text) > 0 AND NOT contains(text, chr(9)) AND trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '' GROUP BY ALL")
def _(t):
    path = scratch(t, "ocr")
    clean = t.fx_words.where(~F.contains("text", F.lit("\t")))
    clean.select(F.lit(5).alias("level"), F.col("page_id").cast("int").alias("page_num"), F.lit(1).alias("block_num"), F.lit(1).alias("par_num"), F.col("line_no").cast("int").alias("line_num"), F.col("word_no").cast("int").alias("word_num"),
                 F.col("x0").alias("left"), F.col("y0").alias("top"), (F.col("x1") - F.col("x0")).alias("width"), (F.col("y1") - F.col("y0")).alias("height"), F.col("confidence").alias("conf"), "text"
                 ).write.option("header", True).option("sep", "\t").option("quote", "").option("escape", "").option("compression", "gzip").csv(path)
    w = readers.read_ocr_tsv(t.spark, path, 30.0)["words"]
    return w.groupBy(F.col("page_num").cast("bigint").alias("page_num"), F.col("line_num").cast("bigint").alias("line_num")).agg(F.count(F.lit(1)).alias("n"))


FRAME = {"space": "canonical_raster_px", "dpi": 200.0, "width": 3400, "height": 2200, "origin": "top-left", "y_axis": "down"}


def frame_column():
    return F.struct(*[F.lit(v).alias(k) for k, v in FRAME.items()])


def written(t, name, df):
    path = scratch(t, name)
    df.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    return path


def text_id(prefix, c):
    return F.concat(F.lit(prefix), (F.col(c) if isinstance(c, str) else c).cast("string"))


@query("repeated_pages", "A4", cte("fx_scans") + """, p AS (SELECT document_id AS corpus_id, scan_id AS position, CASE WHEN scan_id % 10 <> 0 THEN document_version END AS document_version, page_index FROM fx_scans)
    SELECT corpus_id, position, CASE WHEN document_version IS NOT NULL THEN nullif(min(position) OVER (PARTITION BY corpus_id, document_version, page_index), position) END AS repeats FROM p""")
def _(t):
    p = t.fx_scans.select(F.col("document_id").alias("corpus_id"), F.col("scan_id").alias("position"), F.when(F.col("scan_id") % 10 != 0, F.col("document_version")).alias("document_version"), "page_index")
    return corpus.refuse_repeated_pages(p).select("corpus_id", "position", "repeats")


@query("read_detections", "A2 B1 B2", cte("fx_detections") + """ SELECT CAST(page_id AS VARCHAR) AS scan_id, CAST(det_id AS VARCHAR) AS pred_id, x, y, score AS confidence, w, h, CASE WHEN det_id % 13 = 0 THEN 'corrected_pin' ELSE '' END AS problems FROM fx_detections""")
def _(t):
    d = F.struct(F.col("det_id").cast("string").alias("id"), "x", "y", F.when(F.col("det_id") % 2 == 0, F.col("score")).alias("confidence"), "score", F.when(F.col("det_id") % 13 == 0, "manual").otherwise("detector").alias("source"),
                 F.struct((F.col("x") - F.col("w") / 2).alias("x"), (F.col("y") - F.col("h") / 2).alias("y"), F.col("w").alias("width"), F.col("h").alias("height")).alias("box"))
    # a file holds the detections of a scan of a page: a few hundred
    per = t.fx_detections.groupBy("page_id", (F.col("det_id") % 16).alias("part")).agg(F.collect_list(d).alias("detections"))
    doc = per.select(F.lit("detector_output").alias("provenance"), F.col("page_id").cast("string").alias("scan_id"), F.struct(text_id("d", "page_id").alias("document_id"), F.lit("v").alias("document_version"), F.lit(0).alias("page_index")).alias("document"),
                     frame_column().alias("coordinate_frame"), F.lit(1.5).alias("elapsed_seconds"), "detections")
    got = readers.read_detections(t.spark, written(t, "detections", doc), multiline=False)
    cols = ["scan_id", "pred_id", "x", "y", "confidence", "w", "h"]
    return got["points"].select(*cols, F.lit("").alias("problems")).unionByName(got["refused"].select(*cols, F.array_join("problems", ",").alias("problems")))


@query("read_ground_truth", "A3 B1 B4", cte("fx_references") + """, f AS (SELECT DISTINCT page_id FROM fx_references)
    SELECT 'point' AS kind, 'g' || CAST(page_id AS VARCHAR) AS dataset_id, CAST(ref_id AS VARCHAR) AS id, x, y, '' AS problems FROM fx_references
    UNION ALL SELECT 'file', 'g' || CAST(page_id AS VARCHAR), NULL, NULL, NULL, CASE page_id % 3 WHEN 0 THEN 'assisted_claims_independence' ELSE '' END FROM f""")
def _(t):
    r = F.struct(F.col("ref_id").cast("string").alias("id"), "x", "y")
    per = t.fx_references.groupBy("page_id").agg(F.collect_list(r).alias("receptacles"))
    status = F.struct(F.when(F.col("page_id") % 3 < 2, "detector_assisted").otherwise("verified").alias("status"), (F.col("page_id") % 3 != 1).alias("independent_of_detector"), F.lit("by hand").alias("method"),
                      F.lit("u1@x.org").alias("reviewed_by"), F.lit(True).alias("exhaustive_miss_check"), F.lit("s1").alias("source_scan_id"))
    doc = per.select(F.struct(text_id("g", "page_id").alias("dataset_id"), status.alias("verification")).alias("dataset"),
                     F.struct(F.lit("d").alias("document_id"), text_id("v", "page_id").alias("document_version"), F.lit(0).alias("page_index")).alias("document"), frame_column().alias("coordinate_frame"), "receptacles")
    got = readers.read_ground_truth(t.spark, written(t, "references", doc), multiline=False)
    none = lambda kind, n: F.lit(None).cast(kind).alias(n)
    files = got["files"].select(F.lit("file").alias("kind"), "dataset_id", none("string", "id"), none("double", "x"), none("double", "y"), F.array_join("problems", ",").alias("problems"))
    pts = got["points"].withColumn("problems", F.lit("")).unionByName(got["refused"].withColumn("problems", F.array_join("problems", ",")))
    return pts.select(F.lit("point").alias("kind"), "dataset_id", F.col("ref_id").alias("id"), "x", "y", "problems").unionByName(files)


@query("read_legends", "A12", cte("fx_legend") + """ SELECT legend_id, 'E' || CAST(entry_no AS VARCHAR) AS entry_id, tag, tag_source, description, counted, CAST(length(name) AS BIGINT) AS box_x, 'wrapped' AS flags FROM fx_legend""")
def _(t):
    e = F.struct(text_id("E", "entry_no").alias("id"), "tag", "tag_source", "name", "description", F.lit("Other").alias("group"), F.col("counted").alias("count"), F.array(F.array(F.length("name").cast("double"), F.lit(0.0), F.lit(20.0), F.lit(20.0))).alias("symbol_boxes"),
                 F.array(F.lit("wrapped")).alias("flags"), F.lit("read").alias("source"), F.lit(False).alias("confirmed"))
    per = t.fx_legend.groupBy("legend_id").agg(F.array_sort(F.collect_list(F.struct("entry_no", e.alias("e")))).alias("es"))
    doc = per.select(F.col("legend_id").alias("pdf_sha256"), F.lit(0).alias("page_index"), F.lit("eng").alias("engineer"), F.col("es.e").alias("entries"))
    got = readers.read_legends(t.spark, written(t, "legends", doc), multiline=False)["entries"]
    return got.select("legend_id", "entry_id", "tag", "tag_source", "description", "counted", F.col("symbol_boxes")[0][0].cast("bigint").alias("box_x"), F.array_join("flags", ",").alias("flags"))


@query("read_training_dataset", "A14", """WITH v AS (SELECT 'ds' || CAST(CAST(floor(p_partkey / 100) AS BIGINT) AS VARCHAR) AS dataset_id, CASE WHEN p_partkey % 97 = 0 THEN 's0' ELSE 's' || CAST(p_partkey % 90 AS VARCHAR) END AS sample_id, CASE p_size % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split, p_partkey % 2 AS label FROM part)
    SELECT 'sample' AS kind, dataset_id, sample_id AS item_id, label FROM v WHERE split = 'train' UNION ALL SELECT 'collision', dataset_id, sample_id, NULL FROM v GROUP BY dataset_id, sample_id HAVING count(*) > 1""")
def _(t):
    k = F.col("p_partkey")
    v = F.struct(F.when(k % 97 == 0, "s0").otherwise(text_id("s", k % 90)).alias("sample_id"), F.when(F.col("p_size") % 3 == 0, "train").when(F.col("p_size") % 3 == 1, "val").otherwise("test").alias("split"), (k % 2).cast("int").alias("label"))
    doc = t.part.groupBy(text_id("ds", F.floor(k / 100)).alias("dataset_id")).agg(F.collect_list(v).alias("verifier"))
    got = readers.read_training_dataset(t.spark, written(t, "training-sets", doc), "train", multiline=False)
    return got["samples"].select(F.lit("sample").alias("kind"), "dataset_id", F.col("sample_id").alias("item_id"), F.col("label").cast("bigint").alias("label")).unionByName(
        got["collisions"].select(F.lit("collision").alias("kind"), "dataset_id", F.col("key").alias("item_id"), F.lit(None).cast("bigint").alias("label")))


@query("write_counts_csv", "A9 H18", """WITH c AS (SELECT CASE p_partkey % 5 WHEN 0 THEN '=' WHEN 1 THEN '-' WHEN 2 THEN '@' ELSE '' END || p_brand AS sheet, p_type AS tag, count(*) AS found, count(*) FILTER (WHERE p_size > 25) AS approved FROM part GROUP BY ALL)
    SELECT CASE WHEN left(sheet, 1) IN ('=', '-', '@') THEN chr(39) || sheet ELSE sheet END AS sheet, tag, found, approved FROM c""")
def _(t):
    k = F.col("p_partkey") % 5
    sheet = F.concat(F.when(k == 0, "=").when(k == 1, "-").when(k == 2, "@").otherwise(""), "p_brand")
    c = t.part.groupBy(sheet.alias("sheet"), F.col("p_type").alias("tag")).agg(F.count(F.lit(1)).alias("found"), F.count_if(F.col("p_size") > 25).alias("approved"))
    path = scratch(t, "counts")
    exports.write_counts_csv(c.withColumns({n: F.lit(0) for n in ("rejected", "added", "confirmed", "unreviewed")}), path)
    names = ("found", "approved", "rejected", "added", "confirmed", "unreviewed")
    return t.spark.read.option("header", True).schema("sheet string, tag string, " + ", ".join(f"{n} long" for n in names)).csv(path).select("sheet", "tag", "found", "approved")


@query("write_baseline", "A10", """SELECT CAST(12.0 AS DOUBLE) AS tolerance_px, CAST(NULL AS DOUBLE) AS tolerance_rel, round(avg(l_discount)::DOUBLE, 6) AS ap, round(avg(l_tax)::DOUBLE, 6) AS recall, round(max(l_tax)::DOUBLE, 6) AS f1 FROM lineitem""")
def _(t):
    s = t.lineitem.agg(*[F.round(f(c).cast("double"), 6).alias(n) for f, c, n in ((F.avg, "l_discount", "ap"), (F.avg, "l_tax", "recall"), (F.max, "l_tax", "f1"))])
    path = scratch(t, "baseline")
    exports.write_baseline(s.select(F.lit(12.0).alias("tolerance_px"), F.lit(None).cast("double").alias("tolerance_rel"), "ap", "recall", "f1"), path)
    return readers.read_baseline(t.spark, path)
