"""Operator inputs derived from the driver tables.

Every derivation is one SQL text that both Spark and DuckDB accept, so an
operator and its oracle start from the same rows; where the dialects part, a
pair holds the Spark and the DuckDB form. ``{name}`` refers to a
driver table or to another derivation.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
               "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

DERIVED: dict[str, str | tuple[str, str]] = {
    # -- drawing pages: one page per supplier, one symbol per order line
    "fx_base": """
        SELECT l_suppkey AS page_id, l_orderkey AS k, l_linenumber AS ln, min(l_partkey) AS pk,
               min(l_returnflag) AS rf, min(l_linestatus) AS ls
        FROM {lineitem} GROUP BY l_suppkey, l_orderkey, l_linenumber""",
    "fx_detections": """
        SELECT page_id, k*10+ln AS det_id,
               CAST((k*7919 + ln*104729) % 3400 AS DOUBLE) AS x,
               CAST((k*6151 + pk*31 + ln*15485) % 2200 AS DOUBLE) AS y,
               CAST(20 + pk%17 AS DOUBLE) AS w, CAST(20 + k%13 AS DOUBLE) AS h,
               round(0.5 + CAST((k*37 + ln*11) % 500 AS DOUBLE)/1000.0, 3) AS score,
               CAST(90*(ln%4) AS INT) AS rotation, rf || ls AS class_label
        FROM {fx_base} WHERE (k+ln)%4 <> 0""",
    "fx_references": """
        SELECT page_id, k*10+ln AS ref_id,
               CAST(least((k*7919 + ln*104729) % 3400 + pk%15, 3400) AS DOUBLE) AS x,
               CAST(least((k*6151 + pk*31 + ln*15485) % 2200 + k%13, 2200) AS DOUBLE) AS y
        FROM {fx_base} WHERE ln%3 <> 0""",
    "fx_boxes": """
        SELECT page_id, det_id AS box_id, x - w/2 AS x0, y - h/2 AS y0, x + w/2 AS x1, y + h/2 AS y1,
               score, rotation, class_label
        FROM {fx_detections}""",
    "fx_pages": """
        SELECT s_suppkey AS page_id, 'doc-' || CAST(s_nationkey AS VARCHAR(10)) AS document_id,
               n_regionkey AS region_id, r_name AS tag, s_acctbal AS acctbal
        FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    # -- the review log: one scan per user, thirteen pins a scan
    "fx_events": """
        SELECT event_id AS seq, event_id - CASE WHEN event_id % 17 = 0 AND event_id > 0 THEN 1 ELSE 0 END AS request_id,
               user_id AS scan_id, event_id % 13 AS pin_id,
               CASE event_type WHEN 'purchase' THEN 'approve' WHEN 'click' THEN 'approve' WHEN 'error' THEN 'reject'
                    WHEN 'signup' THEN 'add_manual' ELSE 'remove_manual' END AS action,
               'u' || CAST(user_id % 11 AS VARCHAR(10)) || '@x.org' AS reviewer,
               {MICROS:ts} AS created_us, value
        FROM {events}""",
    "fx_scans": """
        SELECT scan_id, CAST(floor(scan_id/3) AS BIGINT) AS page_no,
               'sha256:d' || CAST(CAST(floor(scan_id/12) AS BIGINT) AS VARCHAR(20)) AS document_version,
               'doc-' || CAST(CAST(floor(scan_id/12) AS BIGINT) AS VARCHAR(20)) AS document_id,
               CAST(CAST(floor(scan_id/3) AS BIGINT) % 4 AS INT) AS page_index,
               'sha256:d' || CAST(CAST(floor(scan_id/12) AS BIGINT) AS VARCHAR(20)) || '#p'
                   || CAST(CAST(floor(scan_id/3) AS BIGINT) % 4 AS VARCHAR(20)) AS canonical_page_id,
               'tpl-' || CAST(scan_id % 5 AS VARCHAR(10)) AS template_id,
               'u' || CAST(scan_id % 7 AS VARCHAR(10)) || '@x.org' AS requested_by,
               CASE WHEN scan_id % 2 = 0 THEN '{{"threshold":0.8}}' ELSE '{{}}' END AS detector_settings,
               min(created_us) AS recorded_us, scan_id AS record_seq
        FROM {fx_events} GROUP BY scan_id""",
    "fx_pin_events": """
        SELECT *, CASE WHEN pin_id % 5 = 0 THEN 'manual' ELSE 'machine' END AS origin FROM {fx_events}""",
    "fx_pins": """
        SELECT scan_id, pin_id, origin,
               CASE WHEN origin = 'machine' THEN
                      CASE max_by(CASE WHEN action IN ('approve','reject') THEN action END,
                                  CASE WHEN action IN ('approve','reject') THEN seq END)
                           WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' ELSE 'unreviewed' END
                    WHEN max_by(CASE WHEN action IN ('add_manual','remove_manual') THEN action END,
                                CASE WHEN action IN ('add_manual','remove_manual') THEN seq END) = 'remove_manual'
                      THEN 'removed'
                    ELSE 'added' END AS state,
               CASE WHEN origin = 'machine' THEN pin_id ELSE -1 END AS detection_id,
               CAST((scan_id*7919 + pin_id*613) % 3400 AS DOUBLE) AS x,
               CAST((scan_id*6151 + pin_id*409) % 2200 AS DOUBLE) AS y,
               'T' || CAST((scan_id + pin_id) % 6 AS VARCHAR(10)) AS class_label
        FROM {fx_pin_events} GROUP BY scan_id, pin_id, origin""",
    "fx_pin_detections": """
        SELECT scan_id, pin_id AS detection_id,
               round(0.5 + CAST((scan_id*131 + pin_id*37) % 500 AS DOUBLE)/1000.0, 3) AS score,
               'T' || CAST((scan_id + pin_id + CASE WHEN pin_id % 7 = 3 THEN 1 ELSE 0 END) % 6 AS VARCHAR(10)) AS found_label,
               pin_id AS det_seq
        FROM {fx_pins} WHERE origin = 'machine'""",
    "fx_splits": """
        SELECT DISTINCT document_id,
               CASE WHEN CAST(substr(document_id, 5, 20) AS BIGINT) % 5 = 4 THEN 'test'
                    WHEN CAST(substr(document_id, 5, 20) AS BIGINT) % 5 = 3 THEN 'val' ELSE 'train' END AS split
        FROM {fx_scans}""",
    "fx_page_reviews": """
        SELECT canonical_page_id, min(document_id) AS document_id,
               CASE WHEN min(page_no) % 3 = 0 THEN 'in_progress' ELSE 'complete' END AS status,
               max(recorded_us) AS completed_us, min(requested_by) AS reviewer
        FROM {fx_scans} GROUP BY canonical_page_id""",
    # -- scored review pairs and vectors
    "fx_pairs": """
        SELECT l.doc_id AS pair_id, d.lang AS group_id,
               round(CAST((d.n_chars*31 + l.doc_id*17) % 1000 AS DOUBLE)/1000.0*0.6 + l.quality*0.3, 3) AS score,
               l.quality AS label
        FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id""",
    # -- legends: one brand per legend, symbols are its parts
    "fx_legend": """
        SELECT p_partkey AS entry_no, p_brand || '/' || CAST(CAST(floor(p_partkey/200) AS BIGINT) AS VARCHAR(20)) AS legend_id,
               'B' || CAST(p_size AS VARCHAR(10)) AS tag,
               upper(p_name) || ', ' || p_type AS description, p_name AS name,
               CASE WHEN p_partkey % 3 = 0 THEN 'generated' ELSE 'tag_column' END AS tag_source,
               p_size % 4 <> 0 AS counted
        FROM {part}""",
    "fx_library": """
        SELECT p_partkey AS saved_no, p_brand || '/' || CAST(CAST(floor(p_partkey/200) AS BIGINT) AS VARCHAR(20)) AS legend_id,
               'B' || CAST((p_size + p_partkey % 2) AS VARCHAR(10)) AS tag,
               upper(p_name) || CASE WHEN p_partkey % 4 = 0 THEN ' NEW, ' ELSE ', ' END || p_type AS description,
               p_size % 5 <> 0 AS counted
        FROM {part}""",
    "fx_signed_legend": """
        SELECT *, {SHA:name || CAST(entry_no % 2 AS VARCHAR(10))} AS signature, CAST(entry_no % 6 AS DOUBLE) * 10 + 40 AS detail,
               entry_no % 7 = 0 AS has_label
        FROM {fx_legend}""",
    "fx_legend_lines": """
        SELECT legend_id AS page_id, -3 AS line_no, 'ELECTRICAL LEGEND' AS text, 100.0 AS x0, 10.0 AS y0, 400.0 AS x1, 30.0 AS y1
          FROM {fx_legend} GROUP BY legend_id
        UNION ALL SELECT legend_id, -2, 'SYMBOL', 100.0, 40.0, 180.0, 60.0 FROM {fx_legend} GROUP BY legend_id
        UNION ALL SELECT legend_id, -1, 'DESCRIPTION', 300.0, 40.0, 460.0, 60.0 FROM {fx_legend} GROUP BY legend_id
        UNION ALL SELECT legend_id, CAST(entry_no AS INT), CASE WHEN entry_no % 11 = 5 THEN upper(name) ELSE description END, 300.0 + entry_no % 3,
               80.0 + 28*(entry_no % 200), 320.0 + 9*length(description), 100.0 + 28*(entry_no % 200) FROM {fx_legend}""",
    "fx_legend_ink": """
        SELECT legend_id AS page_id, entry_no*2 AS prim_id, CAST(110 AS DOUBLE) AS x0, CAST(90 + 28*(entry_no % 200) AS DOUBLE) AS y0,
               CAST(150 AS DOUBLE) AS x1, CAST(94 + 28*(entry_no % 200) AS DOUBLE) AS y1 FROM {fx_legend} WHERE entry_no % 4 <> 0
        UNION ALL SELECT legend_id, entry_no*2+1, CAST(190 AS DOUBLE), CAST(88 + 28*(entry_no % 200) AS DOUBLE), CAST(220 AS DOUBLE),
               CAST(96 + 28*(entry_no % 200) AS DOUBLE) FROM {fx_legend} WHERE entry_no % 4 <> 0 AND entry_no % 5 = 0""",
    "fx_page_text": """
        SELECT page_id, k*10+ln AS line_no, rf || ls || ' ' || CAST(ln AS VARCHAR(10)) AS text,
               CAST((k*7919 + ln*104729) % 3400 + k%60 - 30 AS DOUBLE) AS x0, CAST((k*6151 + pk*31 + ln*15485) % 2200 + pk%40 - 30 AS DOUBLE) AS y0,
               CAST((k*7919 + ln*104729) % 3400 + k%60 + 10 AS DOUBLE) AS x1, CAST((k*6151 + pk*31 + ln*15485) % 2200 + pk%40 - 10 AS DOUBLE) AS y1
        FROM {fx_base}""",
    "fx_lines": (
        """SELECT doc_id AS page_id, CAST(n AS BIGINT) AS line_no, line AS text, CAST(100 + (doc_id*13 + n*7) % 400 AS DOUBLE) AS x0, CAST(n*30 AS DOUBLE) AS y0,
               CAST(100 + (doc_id*13 + n*7) % 400 + 8*length(line) AS DOUBLE) AS x1, CAST(n*30 + 20 AS DOUBLE) AS y1
           FROM (SELECT doc_id, posexplode(split(text, '\\n')) AS (n, line) FROM {documents}) WHERE trim(line) <> ''""",
        """SELECT doc_id AS page_id, n AS line_no, line AS text, CAST(100 + (doc_id*13 + n*7) % 400 AS DOUBLE) AS x0, CAST(n*30 AS DOUBLE) AS y0,
               CAST(100 + (doc_id*13 + n*7) % 400 + 8*length(line) AS DOUBLE) AS x1, CAST(n*30 + 20 AS DOUBLE) AS y1
           FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents) WHERE trim(line, ' ') <> ''"""),
    "fx_words": (
        """SELECT page_id, line_no, CAST(w AS BIGINT) AS word_no, word AS text, x0 + 60*w AS x0, y0 + w % 3 AS y0, x0 + 60*w + 8*length(word) AS x1, y0 + 20 + w % 2 AS y1,
               CAST((page_id*7 + line_no*3 + w*11) % 101 AS DOUBLE) AS confidence
           FROM (SELECT *, posexplode(split(text, ' ')) AS (w, word) FROM {fx_lines}) WHERE word <> ''""",
        """SELECT page_id, line_no, w AS word_no, word AS text, x0 + 60*w AS x0, y0 + w % 3 AS y0, x0 + 60*w + 8*length(word) AS x1, y0 + 20 + w % 2 AS y1,
               CAST((page_id*7 + line_no*3 + w*11) % 101 AS DOUBLE) AS confidence
           FROM (SELECT * EXCLUDE text, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS w FROM fx_lines) WHERE word <> ''"""),
    # -- line work: a hundred symbols a sheet, one per part, in three shapes and four turns;
    #    every third symbol is crossed by a stray line
    "fx_symbols": """
        SELECT CAST(floor(p_partkey/100) AS BIGINT) AS page_id, p_partkey AS symbol_id, CASE p_size % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS shape,
               CAST(90 * (p_partkey % 4) AS INT) AS rotation,
               CAST(60 + (p_partkey % 10)*330 + (p_partkey % 7)*10 AS DOUBLE) AS cx,
               CAST(60 + floor((p_partkey % 100)/10)*210 + (p_partkey % 5)*8 AS DOUBLE) AS cy
        FROM {part}""",
    "fx_shape_lines": """
        SELECT * FROM (VALUES
          ('A', 0, 0, -15.0, -10.0, -5.0, -10.0, 5.0, -10.0, 15.0, -10.0), ('A', 1, 0, 15.0, -10.0, 15.0, -3.3, 15.0, 3.3, 15.0, 10.0),
          ('A', 2, 0, 15.0, 10.0, 5.0, 3.3, -5.0, -3.3, -15.0, -10.0),
          ('N', 0, 0, -12.0, -12.0, -4.0, -12.0, 4.0, -12.0, 12.0, -12.0), ('N', 1, 0, 12.0, -12.0, 12.0, -4.0, 12.0, 4.0, 12.0, 12.0),
          ('N', 2, 0, 12.0, 12.0, 4.0, 12.0, -4.0, 12.0, -12.0, 12.0), ('N', 3, 0, -12.0, 12.0, -12.0, 4.0, -12.0, -4.0, -12.0, -12.0),
          ('N', 4, 0, -12.0, -12.0, -4.0, -4.0, 0.0, 0.0, 4.0, 4.0),
          ('R', 0, 0, -10.0, -15.0, -10.0, -5.0, -10.0, 5.0, -10.0, 15.0), ('R', 1, 0, -10.0, 15.0, -3.0, 15.0, 3.0, 15.0, 10.0, 15.0),
          ('R', 2, 1, 10.0, 15.0, 14.0, 5.0, 4.0, -5.0, 10.0, -15.0)) AS s(shape, part_no, kind, ax, ay, bx, by_, gx, gy, dx, dy)""",
    "fx_primitives": """
        WITH m AS (SELECT *, CASE rotation WHEN 0 THEN 1 WHEN 180 THEN -1 ELSE 0 END AS co, CASE rotation WHEN 90 THEN 1 WHEN 270 THEN -1 ELSE 0 END AS si FROM {fx_symbols}),
        p AS (SELECT page_id, symbol_id*10 + part_no AS prim_id, kind,
                cx + co*CAST(ax AS DOUBLE) - si*CAST(ay AS DOUBLE) AS c0x, cy + si*CAST(ax AS DOUBLE) + co*CAST(ay AS DOUBLE) AS c0y,
                cx + co*CAST(bx AS DOUBLE) - si*CAST(by_ AS DOUBLE) AS c1x, cy + si*CAST(bx AS DOUBLE) + co*CAST(by_ AS DOUBLE) AS c1y,
                cx + co*CAST(gx AS DOUBLE) - si*CAST(gy AS DOUBLE) AS c2x, cy + si*CAST(gx AS DOUBLE) + co*CAST(gy AS DOUBLE) AS c2y,
                cx + co*CAST(dx AS DOUBLE) - si*CAST(dy AS DOUBLE) AS c3x, cy + si*CAST(dx AS DOUBLE) + co*CAST(dy AS DOUBLE) AS c3y
              FROM m JOIN {fx_shape_lines} l ON m.shape = l.shape
              UNION ALL SELECT page_id, symbol_id*10 + 9, 0, cx-40, cy+1, cx-15, cy+2, cx+15, cy+3, cx+40, cy+4 FROM m WHERE symbol_id % 3 = 0)
        SELECT *, least(c0x,c1x,c2x,c3x) AS x0, least(c0y,c1y,c2y,c3y) AS y0, greatest(c0x,c1x,c2x,c3x) AS x1, greatest(c0y,c1y,c2y,c3y) AS y1 FROM p""",
    "fx_exemplars": """
        SELECT shape AS exemplar_id, part_no, kind, CAST(ax AS DOUBLE) AS c0x, CAST(ay AS DOUBLE) AS c0y, CAST(bx AS DOUBLE) AS c1x, CAST(by_ AS DOUBLE) AS c1y,
               CAST(gx AS DOUBLE) AS c2x, CAST(gy AS DOUBLE) AS c2y, CAST(dx AS DOUBLE) AS c3x, CAST(dy AS DOUBLE) AS c3y FROM {fx_shape_lines}""",
    "fx_placements": """
        SELECT page_id, symbol_id AS placement_id, 'block-' || shape AS group_key, CAST(symbol_id % 3 AS INT) AS depth,
               CASE rotation WHEN 0 THEN 1.5 WHEN 180 THEN -1.5 ELSE 0.0 END * CASE WHEN symbol_id % 5 = 0 THEN -1 ELSE 1 END AS m11,
               CASE rotation WHEN 90 THEN -1.5 WHEN 270 THEN 1.5 ELSE 0.0 END AS m12,
               CASE rotation WHEN 90 THEN 1.5 WHEN 270 THEN -1.5 ELSE 0.0 END * CASE WHEN symbol_id % 5 = 0 THEN -1 ELSE 1 END AS m21,
               CASE rotation WHEN 0 THEN 1.5 WHEN 180 THEN -1.5 ELSE 0.0 END AS m22,
               cx-15 AS x0, cy-15 AS y0, cx+15 AS x1, cy+15 AS y1
        FROM {fx_symbols}""",
    # -- the same symbols drawn at other sizes: A at half, N at four thirds, R at its own
    "fx_sized_primitives": """
        WITH m AS (SELECT *, CASE shape WHEN 'A' THEN 0.5 WHEN 'N' THEN CAST(4 AS DOUBLE)/3 ELSE 1.0 END AS f,
                CASE rotation WHEN 0 THEN 1 WHEN 180 THEN -1 ELSE 0 END AS co, CASE rotation WHEN 90 THEN 1 WHEN 270 THEN -1 ELSE 0 END AS si FROM {fx_symbols}),
        p AS (SELECT page_id, symbol_id*10 + part_no AS prim_id, kind,
                cx + f*(co*CAST(ax AS DOUBLE) - si*CAST(ay AS DOUBLE)) AS c0x, cy + f*(si*CAST(ax AS DOUBLE) + co*CAST(ay AS DOUBLE)) AS c0y,
                cx + f*(co*CAST(bx AS DOUBLE) - si*CAST(by_ AS DOUBLE)) AS c1x, cy + f*(si*CAST(bx AS DOUBLE) + co*CAST(by_ AS DOUBLE)) AS c1y,
                cx + f*(co*CAST(gx AS DOUBLE) - si*CAST(gy AS DOUBLE)) AS c2x, cy + f*(si*CAST(gx AS DOUBLE) + co*CAST(gy AS DOUBLE)) AS c2y,
                cx + f*(co*CAST(dx AS DOUBLE) - si*CAST(dy AS DOUBLE)) AS c3x, cy + f*(si*CAST(dx AS DOUBLE) + co*CAST(dy AS DOUBLE)) AS c3y
              FROM m JOIN {fx_shape_lines} l ON m.shape = l.shape)
        SELECT *, least(c0x,c1x,c2x,c3x) AS x0, least(c0y,c1y,c2y,c3y) AS y0, greatest(c0x,c1x,c2x,c3x) AS x1, greatest(c0y,c1y,c2y,c3y) AS y1 FROM p""",
    # -- blocks that stand in blocks: a frame holds two A and a corner, a corner holds an N
    "fx_block_uses": """
        SELECT * FROM (VALUES ('frame', 0, 'block-A', 0.5, 0.0, 0.0, 0.5, 60.0, 0.0), ('frame', 1, 'block-A', 0.0, -1.0, 1.0, 0.0, -60.0, 10.0),
          ('frame', 2, 'corner', -1.0, 0.0, 0.0, 1.0, 0.0, 40.0), ('corner', 0, 'block-N', 1.0, 0.0, 0.0, 1.0, 20.0, 10.0)) AS u(group_key, use_no, child_key, m11, m12, m21, m22, tx, ty)""",
    "fx_placed": """
        SELECT p.page_id, placement_id, CASE CAST(placement_id % 7 AS INT) WHEN 0 THEN 'frame' WHEN 1 THEN 'corner' ELSE group_key END AS group_key, m11, m12, m21, m22, cx AS tx, cy AS ty
        FROM {fx_placements} p JOIN {fx_symbols} s ON placement_id = symbol_id""",
    "fx_extents": """
        SELECT 'block-' || shape AS group_key, min(CAST(least(ax, bx, gx, dx) AS DOUBLE)) AS bx0, min(CAST(least(ay, by_, gy, dy) AS DOUBLE)) AS by0,
               max(CAST(greatest(ax, bx, gx, dx) AS DOUBLE)) AS bx1, max(CAST(greatest(ay, by_, gy, dy) AS DOUBLE)) AS by1 FROM {fx_shape_lines} GROUP BY shape""",
    # -- batches: one per customer, its orders are the pages
    "fx_batch_pages": """
        SELECT o_custkey AS batch_id, o_orderkey AS position,
               CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'running' END AS status,
               CAST(floor(o_orderkey/100) AS BIGINT) AS scan_id, o_totalprice AS price
        FROM {orders}""",
}

_SPARK_WORDS = {"VARCHAR(10)": "STRING", "VARCHAR(20)": "STRING"}


def _fields(sql: str) -> list[str]:
    return [name for _, name, _, _ in string.Formatter().parse(sql) if name and name not in ("MICROS", "SHA")]


class _Call:
    """Formats ``{NAME:expression}`` to an engine's own function call.

    MICROS is microseconds since the epoch, time-zone free; SHA is a hex SHA-256.
    """

    def __init__(self, template: str) -> None:
        self.template = template

    def __format__(self, spec: str) -> str:
        return self.template % spec


_SPARK_SHA, _DUCK_SHA = _Call("sha2(%s, 256)"), _Call("sha256(%s)")
_SPARK_MICROS = _Call("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(%s AS TIMESTAMP_NTZ))")
_DUCK_MICROS = _Call("epoch_us(%s)")


class Tables:
    """Driver tables of one scale factor and everything derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir, self._cache = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = self._load(name)
        return self._cache[name]

    def _load(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        sql = _text(name, 0)
        needs = {f: getattr(self, f) for f in _fields(sql)}
        views = {}
        for f, df in needs.items():
            views[f] = f"markset_{f}_{abs(hash(self.sf_dir)) % 10**8}"
            df.createOrReplaceTempView(views[f])
        for word, mine in _SPARK_WORDS.items():
            sql = sql.replace(word, mine)
        return self.spark.sql(sql.format(MICROS=_SPARK_MICROS, SHA=_SPARK_SHA, **views))


def _text(name: str, engine: int) -> str:
    """Derivation text: shared, or the Spark (0) or DuckDB (1) form where the dialects part."""
    sql = DERIVED[name]
    return sql if isinstance(sql, str) else sql[engine]


def _closure(names: tuple[str, ...]) -> list[str]:
    order: list[str] = []

    def visit(name: str) -> None:
        if name in DERIVED and name not in order:
            for f in _fields(_text(name, 0)):
                visit(f)
            order.append(name)

    for n in names:
        visit(n)
    return order


def cte(*names: str, recursive: bool = False) -> str:
    """``WITH`` clause defining the named derivations for DuckDB (no trailing comma)."""
    parts = [f"{n} AS ({_text(n, 1).format(MICROS=_DUCK_MICROS, SHA=_DUCK_SHA, **{f: f for f in _fields(_text(n, 1))})})"
             for n in _closure(names)]
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts)
