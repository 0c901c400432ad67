"""Legend, library and positioned-text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from markset.fixtures import cte
from markset.functions import text as T
from markset.operators import legend as L
from markset.operators import text as X
from markset.plans.registry import query

FXL = cte("fx_legend", "fx_library", "fx_signed_legend")
NORM = "trim(regexp_replace(upper({0}), '[^A-Z0-9]+', ' ', 'g'))"
SIM = """(list_sum(list_transform(range(64), lambda i: bit_count(CAST(('0x'||substr({a},i+1,1)) AS INT) & CAST(('0x'||substr({b},i+1,1)) AS INT))))
  / list_sum(list_transform(range(64), lambda i: bit_count(CAST(('0x'||substr({a},i+1,1)) AS INT) | CAST(('0x'||substr({b},i+1,1)) AS INT))))::DOUBLE)"""


def case_rules(text: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{p}') THEN '{g}'" for g, p in T.GROUP_RULES) + " ELSE 'Other' END"


ACR = "[" + ",".join(f"'{a}'" for a in T.ACRONYMS) + "]"


@query("text_functions", "H13 H14 H15 H16 H17 H22 H25", f"""WITH d AS (SELECT p_partkey AS id, upper(p_name) || CASE p_partkey % 4 WHEN 0 THEN ' GFCI' WHEN 1 THEN ' 20A Duplex' WHEN 2 THEN ' smoke' ELSE ' a.c.' END || ', ' || p_type AS t, p_brand, p_name FROM part),
    w AS (SELECT *, string_split(trim(regexp_split_to_array(t, ',|;')[1]), ' ') AS ws FROM d),
    n AS (SELECT *, array_to_string(list_transform(ws, lambda v: CASE WHEN list_contains({ACR}, upper(trim(v, '()"''.'))) THEN upper(v) WHEN regexp_matches(v, '[0-9]') THEN v
       WHEN regexp_matches(v,'[a-zA-Z]') AND (v=upper(v) OR v=lower(v)) THEN CASE WHEN length(trim(v,'()"''.'))<=3 AND trim(v,'()"''.')=upper(v) AND NOT regexp_matches(trim(v,'()"''.'),'^[A-Za-z]+$') THEN v ELSE lower(v) END ELSE v END), ' ') AS nm FROM w)
    SELECT id, upper(nm[1:1]) || nm[2:] AS nice, {case_rules('upper(t)')} AS grp, regexp_replace(upper(p_brand), '[^A-Z0-9]', '', 'g') AS label, {NORM.format('t')} AS norm,
      upper(p_name[1:1] || string_split(p_name,' ')[2][1:1]) AS letters, regexp_matches(upper(p_brand[1:7]), '^[A-Z0-9][A-Z0-9\\-./]*$') AS valid_tag,
      CAST(id % 101 * greatest(length(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')),1) AS BIGINT) AS evidence,
      'sha256:' || CAST(id AS VARCHAR) || '#p' || CAST(id % 9 AS VARCHAR) AS page, regexp_matches('E-' || CAST(id AS VARCHAR), '^[A-Z]{{1,3}}[-.]?\\d{{1,4}}(?:[.-]\\d{{1,3}})?[A-Z]?$') AS sheet_no
    FROM n""")
def _(t):
    m = F.col("p_partkey") % 4
    tail = F.when(m == 0, " GFCI").when(m == 1, " 20A Duplex").when(m == 2, " smoke").otherwise(" a.c.")
    d = t.part.withColumn("t", F.concat(F.upper("p_name"), tail, F.lit(", "), "p_type"))
    return d.select(F.col("p_partkey").alias("id"), T.nice_name(F.col("t")).alias("nice"), T.guess_group(F.col("t")).alias("grp"), T.norm_label(F.col("p_brand")).alias("label"),
                    T.norm_text(F.col("t")).alias("norm"), T.tag_letters(F.col("p_name")).alias("letters"), T.valid_tag(F.upper(F.substring("p_brand", 1, 7))).alias("valid_tag"),
                    T.alnum_evidence(F.col("p_brand"), F.col("p_partkey") % 101).alias("evidence"),
                    T.canonical_page_id(F.concat(F.lit("sha256:"), F.col("p_partkey").cast("string")), F.col("p_partkey") % 9).alias("page"),
                    F.concat(F.lit("E-"), F.col("p_partkey").cast("string")).rlike(T.SHEET_NUMBER).alias("sheet_no"))


@query("count_defaults", "B9", FXL + r""", e AS (SELECT entry_no, upper(description) || CASE entry_no % 5 WHEN 0 THEN ' CONDUIT' WHEN 1 THEN ' BY OTHERS' ELSE '' END AS d, 10.0::DOUBLE + entry_no % 90 AS w, 5.0::DOUBLE + entry_no % 20 AS h FROM fx_legend),
    r AS (SELECT entry_no, CASE WHEN regexp_matches(d, '\b(HOME ?RUN|CONDUIT|WIRING|RACEWAY|CABLE TRAY|CIRCUIT RUN|UNDERGROUND)\b') OR (w/h > 4 AND h < 12) THEN 'A wiring line, not a device.'
      WHEN regexp_matches(d, '\bBY\s+(OTHERS|MECH\w*|PLUMB\w*|OWNER|GC|G\.C\.|DIV\w*|HVAC|FIRE|TELECOM)\b') THEN 'Provided by another trade.' END AS reason FROM e)
    SELECT entry_no, reason IS NULL AS counted, coalesce(reason,'-') AS reason FROM r""")
def _(t):
    m = F.col("entry_no") % 5
    e = t.fx_legend.select("entry_no", F.concat("description", F.when(m == 0, " CONDUIT").when(m == 1, " BY OTHERS").otherwise("")).alias("d"),
                           (10.0 + F.col("entry_no") % 90).alias("w"), (5.0 + F.col("entry_no") % 20).alias("h"))
    ok, why = L.count_default(F.col("d"), F.col("w"), F.col("h"), F.lit(12.0))
    return e.select("entry_no", ok.alias("counted"), F.coalesce(why, F.lit("-")).alias("reason"))


@query("duplicate_tags", "E15 B8", FXL + """ SELECT legend_id, entry_no, tag, count(*) OVER (PARTITION BY legend_id, tag) > 1 AS duplicate_tag,
    CASE WHEN count(*) OVER (PARTITION BY legend_id, tag) > 1 THEN 'check' ELSE 'ok' END AS status FROM fx_legend""")
def _(t):
    d = L.duplicate_tags(t.fx_legend)
    flags = F.when(F.col("duplicate_tag"), F.array(F.lit("duplicate_tag"))).otherwise(F.array().cast("array<string>"))
    return d.select("legend_id", "entry_no", "tag", "duplicate_tag", L.entry_status(F.lit("read"), flags, F.lit(False)).alias("status"))


@query("assign_tags", "E16", FXL + """, g AS (SELECT legend_id, entry_no, upper(name[1:1] || string_split(name,' ')[2][1:1]) AS letters FROM fx_legend WHERE tag_source='generated'),
    own AS (SELECT DISTINCT legend_id, CASE WHEN entry_no % 3 = 1 THEN upper(name[1:1] || string_split(name,' ')[2][1:1]) ELSE tag END AS tag FROM fx_legend WHERE tag_source<>'generated'),
    n AS (SELECT *, row_number() OVER (PARTITION BY legend_id, letters ORDER BY entry_no) AS nth FROM g),
    cand AS (SELECT legend_id, letters, k, CASE WHEN k=1 THEN letters ELSE letters || CAST(k AS VARCHAR) END AS tag FROM (SELECT DISTINCT legend_id, letters FROM g), range(1,400) r(k)),
    free AS (SELECT legend_id, letters, tag, row_number() OVER (PARTITION BY legend_id, letters ORDER BY k) AS nth FROM cand c WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.legend_id=c.legend_id AND o.tag=c.tag))
    SELECT n.legend_id, n.entry_no, f.tag FROM n JOIN free f USING (legend_id, letters, nth)""")
def _(t):
    gen = F.col("tag_source") == "generated"
    own = F.when(F.col("entry_no") % 3 == 1, T.tag_letters(F.col("name"))).otherwise(F.col("tag"))
    e = t.fx_legend.withColumn("tag", F.when(~gen, own))
    return L.assign_tags(e).where("tag_source = 'generated'").select("legend_id", "entry_no", "tag")


def signed(t):
    e = t.fx_signed_legend.withColumn("signatures", F.array("signature"))
    s = t.fx_library.join(t.fx_signed_legend.select(F.col("entry_no").alias("saved_no"), "signature"), "saved_no").withColumn("signatures", F.array("signature"))
    return e, s


STAGE1 = f"""bt AS (SELECT legend_id, tag, min(saved_no) AS s FROM fx_library GROUP BY ALL), bd AS (SELECT legend_id, {NORM.format('description')} AS d, min(saved_no) AS s FROM fx_library GROUP BY ALL),
    lk AS (SELECT e.legend_id, e.entry_no, coalesce(CASE WHEN e.tag_source<>'generated' THEN bt.s END, bd.s) AS saved_no FROM fx_legend e LEFT JOIN bt ON bt.legend_id=e.legend_id AND bt.tag=e.tag
      LEFT JOIN bd ON bd.legend_id=e.legend_id AND bd.d={NORM.format('e.description')}),
    st1 AS (SELECT legend_id, saved_no, min(entry_no) AS entry_no FROM lk WHERE saved_no IS NOT NULL GROUP BY ALL)"""


@query("pair_by_wording", "C13", FXL + f", {STAGE1} SELECT * FROM st1")
def _(t):
    return L.pair_by_wording(t.fx_legend, t.fx_library)


@query("similar_candidates", "C13 G5 G4", FXL + f""", e AS (SELECT legend_id, entry_no, list_distinct(string_split({NORM.format('description')},' ')) AS w, signature FROM fx_signed_legend),
    s AS (SELECT l.legend_id, saved_no, list_distinct(string_split({NORM.format('l.description')},' ')) AS w, signature FROM fx_library l JOIN fx_signed_legend g ON g.entry_no=l.saved_no),
    p AS (SELECT e.legend_id, entry_no, saved_no, len(list_intersect(e.w,s.w))/len(list_distinct(list_concat(e.w,s.w)))::DOUBLE AS j, {SIM.format(a='e.signature', b='s.signature')} AS sim FROM e JOIN s ON e.legend_id=s.legend_id)
    SELECT legend_id, entry_no, saved_no, round(j,6) AS jaccard, round(sim,6) AS similarity, round(j+0.5*sim,6) AS score FROM p WHERE j >= 0.5 OR (j >= 0.3 AND sim >= 0.9)""")
def _(t):
    c = L.similar_candidates(*signed(t))
    return c.withColumns({k: F.round(k, 6) for k in ("jaccard", "similarity", "score")})


@query("compare_legend", "K14 C13 C14")
def _(t):
    e, s = signed(t)
    return L.compare_legend(e, s, L.pair_with_library(e, s))


@query("update_library", "K14")
def _(t):
    e, s = signed(t)
    s = s.withColumn("projects", F.array(F.lit("first")))
    return L.update_library(e, s, L.pair_with_library(e, s), "second").select("legend_id", "saved_no", "tag", "description", F.size("signatures").alias("n_signatures"), F.array_join("projects", ",").alias("projects"))


@query("missing_entries", "C14", FXL + f", {STAGE1} SELECT l.legend_id, l.saved_no, l.tag FROM fx_library l WHERE NOT EXISTS (SELECT 1 FROM st1 WHERE st1.legend_id=l.legend_id AND st1.saved_no=l.saved_no)")
def _(t):
    return L.missing_entries(t.fx_library, L.pair_by_wording(t.fx_legend, t.fx_library)).select("legend_id", "saved_no", "tag")


@query("lookalikes", "C21 G4", FXL + f""", c AS (SELECT legend_id, signature, detail, min(entry_no) AS no, count(*) AS size FROM fx_signed_legend WHERE NOT has_label GROUP BY ALL),
    p AS (SELECT a.legend_id, a.no AS a_no, b.no AS b_no, a.size AS a_size, b.size AS b_size, {SIM.format(a='a.signature', b='b.signature')} AS sim FROM c a JOIN c b ON a.legend_id=b.legend_id
      AND (a.no<b.no OR (a.no=b.no AND a.size>1)) AND abs(a.detail-b.detail) <= 0.02*greatest(a.detail,b.detail,1)) SELECT legend_id, a_no, b_no, a_size, b_size, round(sim,6) AS similarity FROM p WHERE sim >= 0.95""")
def _(t):
    return L.lookalikes(t.fx_signed_legend).withColumn("similarity", F.round("similarity", 6))


EDITS = """ed AS (SELECT event_id AS seq, user_id*13 + event_id % 13 AS entry_no, CASE event_type WHEN 'view' THEN 'rename' WHEN 'click' THEN 'set_tag' WHEN 'purchase' THEN 'set_count' WHEN 'signup' THEN 'confirm' ELSE CASE WHEN event_id % 4 = 0 THEN 'delete' ELSE 'set_group' END END AS op,
    CASE event_type WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END ELSE 'v' || CAST(event_id % 50 AS VARCHAR(10)) END AS value FROM {events})"""


@query("legend_edit_log", "K18 E15", FXL + ", " + EDITS.format(events="events") + """,
    l AS (SELECT entry_no, max_by(value,seq) FILTER (WHERE op='rename') AS rn, max_by(value,seq) FILTER (WHERE op='set_tag') AS tg, max_by(value,seq) FILTER (WHERE op='set_group') AS gr, max_by(value,seq) FILTER (WHERE op='set_count') AS ct,
      bool_or(op='confirm') AS cf, bool_or(op='delete') AS dl FROM ed GROUP BY 1),
    o AS (SELECT e.legend_id, e.entry_no, coalesce(rn, e.name) AS name, coalesce(upper(tg), e.tag) AS tag, coalesce(gr,'Other') AS grp, coalesce(ct='true', e.counted) AS counted, coalesce(cf,FALSE) AS confirmed FROM fx_legend e LEFT JOIN l USING (entry_no) WHERE NOT coalesce(dl,FALSE)),
    d AS (SELECT *, count(*) OVER (PARTITION BY legend_id, tag) > 1 AS dup FROM o)
    SELECT legend_id, entry_no, name, tag, grp, counted, confirmed AND NOT dup AS confirmed, CASE WHEN dup THEN 'duplicate_tag' ELSE '' END AS flags FROM d""")
def _(t):
    op = (F.when(F.col("event_type") == "view", "rename").when(F.col("event_type") == "click", "set_tag").when(F.col("event_type") == "purchase", "set_count")
          .when(F.col("event_type") == "signup", "confirm").when(F.col("event_id") % 4 == 0, "delete").otherwise("set_group"))
    val = F.when(F.col("event_type") == "purchase", F.when(F.col("event_id") % 2 == 0, "true").otherwise("false")).otherwise(F.concat(F.lit("v"), (F.col("event_id") % 50).cast("string")))
    ed = t.events.select(F.col("event_id").alias("seq"), (F.col("user_id") * 13 + F.col("event_id") % 13).alias("entry_no"), op.alias("op"), val.alias("value"))
    e = t.fx_legend.select("legend_id", "entry_no", "name", "tag", "tag_source", F.lit("Other").alias("grp"), "counted", F.lit(False).alias("confirmed"), F.array().cast("array<string>").alias("flags"))
    ed = ed.join(e.select("legend_id", "entry_no"), "entry_no")
    out = L.replay_edits(e, ed)
    return out.select("legend_id", "entry_no", "name", "tag", "grp", "counted", "confirmed", F.array_join("flags", ",").alias("flags"))


LINES = cte("fx_legend_lines")


@query("find_legends", "F4 H15", LINES + """ SELECT page_id, -3 AS head_no, 'ELECTRICAL LEGEND' AS heading, count(*) AS rows, count(*) + 20 AS score FROM fx_legend_lines
    WHERE y0 > 30 AND y0 < 30 + 40*20 GROUP BY 1 HAVING count(*) >= 2""")
def _(t):
    return L.find_legends(t.fx_legend_lines)


def _columns(t):
    body = t.fx_legend_lines.where("line_no >= 0")
    return body.withColumn("has_graphic", F.col("line_no") % 4 != 0).withColumn("rule_between", F.col("line_no") % 9 == 0)


@query("legend_rows", "E12 H15", LINES + """, b AS (SELECT *, line_no % 4 <> 0 AS g, line_no % 9 = 0 AS r, lag(y1) OVER w AS py FROM fx_legend_lines WHERE line_no >= 0 WINDOW w AS (PARTITION BY page_id ORDER BY y0, line_no)),
    f AS (SELECT *, py IS NOT NULL AND NOT g AND NOT r AND (y0-py <= 0.9*20 OR x0 > 300+8) AS j, NOT g AND NOT contains(text,',') AND text=upper(text) AND len(string_split(text,' '))<=3 AS h,
        py IS NOT NULL AND y0-py > 3.5*20 AND (y0-py > 240 OR NOT g) AS e FROM b),
    k AS (SELECT *, coalesce(bool_or(h AND NOT j) OVER (PARTITION BY page_id ORDER BY y0, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS ins, bool_or(e) OVER (PARTITION BY page_id ORDER BY y0, line_no) AS ov FROM f)
    SELECT page_id, line_no, CASE WHEN j AND NOT ins THEN 'wrap' WHEN h THEN 'section' ELSE 'row' END AS kind,
      last_value(CASE WHEN NOT (j AND NOT ins) THEN line_no END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY y0, line_no) AS row_no FROM k WHERE NOT ov""")
def _(t):
    return L.legend_rows(_columns(t), ["page_id"], F.lit(300.0), F.lit(20.0)).select("page_id", "line_no", "kind", "row_no")


@query("read_legend_entries", "K12 F4 E12 C5 E11 E16", cte("fx_legend_lines") + """, b AS (SELECT *, line_no % 4 <> 0 AS g, lag(y1) OVER w AS py FROM fx_legend_lines WHERE line_no >= 0 WINDOW w AS (PARTITION BY page_id ORDER BY y0, line_no)),
    f AS (SELECT *, py IS NOT NULL AND NOT g AND (y0-py <= 0.9*20 OR x0 > 300+8) AS j, NOT g AND NOT contains(text,',') AND text=upper(text) AND len(string_split(text,' '))<=3 AS h,
        py IS NOT NULL AND y0-py > 3.5*20 AND (y0-py > 240 OR NOT g) AS e FROM b),
    k AS (SELECT *, coalesce(bool_or(h AND NOT j) OVER (PARTITION BY page_id ORDER BY y0, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS ins, bool_or(e) OVER (PARTITION BY page_id ORDER BY y0, line_no) AS ov FROM f),
    r AS (SELECT *, CASE WHEN j AND NOT ins THEN 'wrap' WHEN h THEN 'section' ELSE 'row' END AS kind, last_value(CASE WHEN NOT (j AND NOT ins) THEN line_no END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY y0, line_no) AS row_no FROM k WHERE NOT ov)
    SELECT page_id AS legend_id, row_no AS entry_no, row_no % 5 = 0 AS combined, count(*) > 1 AS wrapped FROM r WHERE kind <> 'section' AND row_no % 4 <> 0 GROUP BY page_id, row_no""")
def _(t):
    e = L.read_legend_entries(t.fx_legend_lines.withColumns({c: F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")}), t.fx_legend_ink)
    return e.select("legend_id", "entry_no", F.array_contains("flags", "combined").alias("combined"), F.array_contains("flags", "wrapped").alias("wrapped"))


@query("gap_clusters", "E11", cte("fx_words") + """, o AS (SELECT *, max(x1) OVER (PARTITION BY page_id, line_no ORDER BY x0, x1, word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM fx_words)
    SELECT page_id, line_no, word_no, CAST(sum(CASE WHEN r IS NULL OR x0 > r + 14 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id, line_no ORDER BY x0, x1, word_no) AS BIGINT) AS cluster FROM o""")
def _(t):
    w = t.fx_words.withColumn("item_id", F.col("word_no"))
    return L.gap_clusters(w, ["page_id", "line_no"], F.lit(14.0)).select("page_id", "line_no", "word_no", "cluster")


@query("assemble_lines", "D34 H2", cte("fx_words") + """ SELECT page_id, line_no, string_agg(text, ' ' ORDER BY word_no) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, round(avg(confidence),6) AS confidence, count(*) AS n_words,
    list_sort(list(y1-y0))[CAST(floor(count(*)/2) AS BIGINT)+1] AS height FROM fx_words GROUP BY ALL""")
def _(t):
    return X.assemble_lines(t.fx_words, ["page_id", "line_no"]).withColumn("confidence", F.round("confidence", 6))


@query("label_near", "C6 H16", cte("fx_boxes", "fx_page_text") + """, tok AS (SELECT page_id, line_no, 0 AS tn, regexp_replace(upper(string_split(text,' ')[1]),'[^A-Z0-9]','','g') AS tk, x0, x1, (y0+y1)/2 AS cy FROM fx_page_text),
    h AS (SELECT b.page_id, b.box_id, t.line_no, t.tk FROM fx_boxes b JOIN tok t ON t.page_id=b.page_id AND t.tk=b.class_label AND abs(t.cy-(b.y0+b.y1)/2) <= 1.5*greatest(b.x1-b.x0,b.y1-b.y0)
      AND abs((t.x0+t.x1)/2-(b.x0+b.x1)/2) <= 1.5*greatest(b.x1-b.x0,b.y1-b.y0)+(t.x1-t.x0)/2)
    SELECT b.page_id, b.box_id, coalesce((SELECT min_by(tk, line_no) FROM h WHERE h.page_id=b.page_id AND h.box_id=b.box_id), '-') AS label FROM fx_boxes b""")
def _(t):
    boxes = t.fx_boxes.withColumn("label_set", F.col("class_label"))
    labels = t.fx_boxes.select(F.col("class_label").alias("label_set"), F.col("class_label").alias("label")).distinct()
    return X.label_near(boxes, t.fx_page_text, labels).select("page_id", "box_id", F.coalesce("label", F.lit("-")).alias("label"))


@query("row_at", "C8", cte("fx_legend_lines") + """ SELECT p.page_id, p.line_no AS point_id, min(r.line_no) AS row_no FROM fx_legend_lines p JOIN fx_legend_lines r ON p.page_id=r.page_id
    AND (p.y0+p.y1)/2+10 BETWEEN r.y0-1 AND r.y1+1 GROUP BY ALL""")
def _(t):
    p = t.fx_legend_lines.select("page_id", F.col("line_no").alias("point_id"), ((F.col("y0") + F.col("y1")) / 2 + 10).alias("y"))
    r = t.fx_legend_lines.select("page_id", F.col("line_no").alias("row_no"), "y0", "y1")
    return X.row_at(p, r)


# lines of a page meet in bands of 400: a line stands in the band of its top, a label looks into all that its reach touches
@query("text_neighbours", "C7", LINES + """, h AS (SELECT *, greatest(y1-y0,1) AS h FROM fx_legend_lines),
    l AS (SELECT *, unnest(generate_series(CAST(floor((y0-0.5*h)/400) AS BIGINT)-1, CAST(floor((y1+8*h)/400) AS BIGINT))) AS band FROM h),
    b AS (SELECT *, CAST(floor(y0/400) AS BIGINT) AS band FROM fx_legend_lines),
    j AS (SELECT l.page_id, l.line_no AS label_id, b.line_no, (b.y0+b.y1)/2 BETWEEN l.y0-0.5*h AND l.y1+0.5*h AND b.x0>=l.x1 AND b.x0-l.x1<=12*h AS rt,
      b.y0>=l.y1-0.3*h AND b.y0-l.y1<=8*h AND b.x0<l.x1+6*h AND b.x1>l.x0-6*h AS bl, (b.x0-l.x1)/h AS dr, (b.y0-l.y1)/h+abs(b.x0-l.x0)/(4*h) AS db FROM l JOIN b ON b.page_id=l.page_id AND b.band=l.band AND b.line_no<>l.line_no)
    SELECT page_id, label_id, line_no, CASE WHEN rt THEN 'right' ELSE 'below' END AS side, round(CAST(CASE WHEN rt THEN dr ELSE db END AS DOUBLE),6) AS dist FROM j WHERE rt OR bl""")
def _(t):
    lab = t.fx_legend_lines.select("page_id", F.col("line_no").alias("label_id"), "x0", "y0", "x1", "y1")
    n = X.text_neighbours(lab, t.fx_legend_lines.select("page_id", "line_no", "x0", "y0", "x1", "y1")).where(F.col("line_no") != F.col("label_id"))
    return n.select("page_id", "label_id", "line_no", "side", F.round(F.col("dist").cast("double"), 6).alias("dist"))


@query("best_field", "F6", """WITH c AS (SELECT l_orderkey AS page_id, l_partkey*10+l_linenumber AS cand_id, CASE l_linenumber % 3 WHEN 0 THEN 'label' WHEN 1 THEN 'table' ELSE 'pattern' END AS method, CAST(l_partkey % 4 AS DOUBLE) AS rank, l_quantity AS confidence, 'S' || CAST(l_partkey % 9 AS VARCHAR) AS value FROM lineitem),
    o AS (SELECT *, row_number() OVER (PARTITION BY page_id, value ORDER BY CASE method WHEN 'label' THEN 0 WHEN 'table' THEN 1 ELSE 2 END, rank, confidence DESC, cand_id) AS v FROM c QUALIFY v=1),
    z AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY CASE method WHEN 'label' THEN 0 WHEN 'table' THEN 1 ELSE 2 END, rank, confidence DESC, cand_id) AS rn FROM o)
    SELECT page_id, max(value) FILTER (WHERE rn=1) AS value, max(method) FILTER (WHERE rn=1) AS method, coalesce(string_agg(value, ',' ORDER BY rn) FILTER (WHERE rn>1),'') AS alternatives FROM z GROUP BY 1""")
def _(t):
    m = F.col("l_linenumber") % 3
    c = t.lineitem.select(F.col("l_orderkey").alias("page_id"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("cand_id"), F.when(m == 0, "label").when(m == 1, "table").otherwise("pattern").alias("method"),
                          (F.col("l_partkey") % 4).cast("double").alias("rank"), F.col("l_quantity").alias("confidence"), F.concat(F.lit("S"), (F.col("l_partkey") % 9).cast("string")).alias("value"))
    return X.best_field(c, ["page_id"]).select("page_id", "value", "method", F.array_join("alternatives", ",").alias("alternatives"))


def title_words(t):
    """A title block per order: number, title of two lines and a revision table of its lines."""
    o = t.orders.select(F.col("o_orderkey").alias("page_id"), "o_orderstatus")
    fixed = [(0, 0, "SHEET", 0, 0), (0, 1, "NO:", 60, 0), (1, 0, None, 0, 30), (2, 0, "SHEET", 0, 90), (2, 1, "TITLE", 60, 90), (3, 0, "POWER", 0, 115), (3, 1, "PLAN", 70, 115),
             (4, 0, "LEVEL", 0, 138), (5, 0, "REV", 400, 0), (5, 1, "DATE", 450, 0)]
    number = F.concat(F.lit("E-"), (F.col("page_id") % 900 + 100).cast("string"))
    rows = F.explode(F.array(*[F.struct(F.lit(ln).alias("line_no"), F.lit(w).alias("word_no"), (number if s is None else F.lit(s)).alias("text"), F.lit(float(x)).alias("x0"), F.lit(float(y)).alias("y0"))
                               for ln, w, s, x, y in fixed])).alias("s")
    head = o.select("page_id", rows).select("page_id", "s.*")
    tail = t.lineitem.select(F.col("l_orderkey").alias("page_id"), (F.col("l_linenumber") + 10).alias("line_no"), F.lit(0).alias("word_no"), F.col("l_linenumber").cast("string").alias("text"),
                             F.lit(405.0).alias("x0"), (F.col("l_linenumber") * 25.0).alias("y0")).distinct()
    w = head.unionByName(tail)
    return w.select("*", F.lit(0).alias("rotation"), (F.col("x0") + 10 * F.length("text")).alias("x1"), (F.col("y0") + 20).alias("y1"), (50.0 + F.col("page_id") % 40).alias("confidence"))


@query("sheet_fields", "K11 C7 F6 H17", """WITH r AS (SELECT l_orderkey AS page_id, max(l_linenumber) AS m FROM lineitem GROUP BY 1)
    SELECT o_orderkey AS page_id, 'number' AS field, 'E-' || CAST(o_orderkey % 900 + 100 AS VARCHAR) AS value, 'label' AS method FROM orders
    UNION ALL SELECT o_orderkey, 'title', 'POWER PLAN LEVEL', 'label' FROM orders
    UNION ALL SELECT page_id, 'revision', CAST(m AS VARCHAR), 'table' FROM r JOIN orders ON o_orderkey=page_id""")
def _(t):
    w = title_words(t)
    return X.sheet_fields(w.join(t.orders.select(F.col("o_orderkey").alias("page_id")).hint("merge"), "page_id", "left_semi")).select("page_id", "field", "value", "method")


@query("sheet_warnings", "K11", """SELECT CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey=o_orderkey) THEN '' ELSE 'no_revision' END AS warnings, count(*) AS pages FROM orders GROUP BY 1""")
def _(t):
    w = title_words(t).join(t.orders.select(F.col("o_orderkey").alias("page_id")).hint("merge"), "page_id", "left_semi")
    out = X.sheet_warnings(X.sheet_fields(w), t.orders.select(F.col("o_orderkey").alias("page_id")))
    return out.groupBy(F.array_join("warnings", ",").alias("warnings")).agg(F.count(F.lit(1)).alias("pages"))


@query("merge_rotations", "E8 H25 H1")
def _(t):
    w = t.fx_detections.select("page_id", F.col("det_id").alias("word_id"), "rotation", (F.col("x") - F.col("w")).alias("x0"), (F.col("y") - F.col("h")).alias("y0"),
                               (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("y1"), T.alnum_evidence(F.col("class_label"), F.col("score")).alias("evidence"))
    return X.merge_rotations(w, 0.5).select("page_id", "word_id")


@query("parse_page_ranges", "B10 J5", """WITH s AS (SELECT o_orderkey AS id, CAST(o_orderkey % 7 + 1 AS INT) AS a, CAST(o_orderkey % 7 + 1 + o_custkey % 5 AS INT) AS b, CAST(o_custkey % 9 + 1 AS INT) AS c FROM orders),
    u AS (SELECT id, p, i FROM (SELECT id, unnest(list_concat(range(a-1, b), [c-1])) AS p, generate_subscripts(list_concat(range(a-1,b),[c-1]),1) AS i FROM s))
    SELECT id, CAST(p AS INT) AS page_index FROM u GROUP BY id, p""")
def _(t):
    a = F.col("o_orderkey") % 7 + 1
    spec = F.concat(a.cast("string"), F.lit(" - "), (a + F.col("o_custkey") % 5).cast("string"), F.lit(", "), (F.col("o_custkey") % 9 + 1).cast("string"))
    return t.orders.select(F.col("o_orderkey").alias("id"), F.explode(T.parse_page_ranges(spec)).alias("page_index"))


@query("request_uuid", "H22")
def _(t):
    return t.events.select("event_id", T.uuid5("6ba7b8119dad11d180b400c04fd430c8", F.concat(F.lit("req-"), F.col("event_id").cast("string"))).alias("event_uuid"))


@query("legend_replay", "K18 E15")
def _(t):
    from markset.operators.legend_log import replay_log

    k = F.col("entry_no")
    box = lambda i: F.array(*[v.cast("double") for v in (k % 50 + 60 * i, F.lit(0), k % 50 + 60 * i + 40, F.lit(20))])
    boxes = F.when(k % 3 == 0, F.array(box(1), box(0))).otherwise(F.array(box(0)))
    entries = t.fx_legend.select("legend_id", k.alias("position"), F.concat(F.lit("L"), k.cast("string")).alias("entry_id"), "tag", "tag_source", "name", "description", F.lit("Other").alias("grp"), "counted", F.lit(False).alias("confirmed"),
                                 F.when(k % 7 == 0, F.array(F.lit("wrapped"))).otherwise(F.array().cast("array<string>")).alias("flags"), F.lit("read").alias("source"), boxes.alias("symbol_boxes"))
    n = F.col("event_id")
    op = F.element_at(F.array(*[F.lit(v) for v in ("rename", "set_tag", "set_group", "set_count", "confirm", "merge", "split", "add", "delete")]), (n % 9 + 1).cast("int"))
    near = t.events.select(n.alias("seq"), (F.col("user_id") * 13 + n % 13).alias("entry_no"), op.alias("op"))
    value = F.when(F.col("op") == "set_count", F.when(F.col("seq") % 2 == 0, "true").otherwise("false")).when(F.col("op") == "merge", F.concat(F.lit("L"), (k + 1).cast("string"))).otherwise(F.concat(F.lit("V"), (F.col("seq") % 50).cast("string")))
    edits = near.join(t.fx_legend.select("legend_id", "entry_no", "description").hint("merge"), "entry_no").select(
        "legend_id", "seq", "op", F.concat(F.lit("L"), k.cast("string")).alias("entry_id"), value.alias("value"), F.lit(None).cast("string").alias("tag"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("grp"), "description",
        F.when(F.col("op") == "add", F.array(box(2))).alias("symbol_boxes"))
    return replay_log(entries, edits)[0].select("legend_id", "position", "entry_id", "tag", "tag_source", "name", "grp", "counted", "confirmed", F.array_join("flags", ",").alias("flags"), F.size("symbol_boxes").alias("drawings"))
