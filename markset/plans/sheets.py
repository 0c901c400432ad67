"""Whole-set queries: sizes, nested blocks, counts over all sheets."""

from __future__ import annotations

from pyspark.sql import functions as F

from markset.fixtures import cte
from markset.operators import setscan as S
from markset.plans.drawings import legend_of
from markset.plans.registry import query

LIMITS = """WITH l AS (SELECT p_partkey, 0.25::DOUBLE + (p_partkey % 40) * 0.05::DOUBLE AS low, 0.3::DOUBLE + (p_partkey % 61) * 0.06::DOUBLE AS high, 1.02::DOUBLE + (p_partkey % 9) * 0.05::DOUBLE AS step FROM part),
    ok AS (SELECT * FROM l WHERE low <= high AND high <= 4.0)"""


@query("scale_range", "H19", LIMITS + """,
    s AS (SELECT p_partkey, step, low AS a, CASE WHEN low < 1 AND high > 1 THEN 1.0 ELSE high END AS b FROM ok UNION ALL SELECT p_partkey, step, 1.0, high FROM ok WHERE low < 1 AND high > 1),
    n AS (SELECT *, CASE WHEN a = b THEN 0 ELSE greatest(1, CAST(ceil(ln(b / a) / ln(step) - 1e-9) AS INT)) END AS n FROM s)
    SELECT DISTINCT p_partkey, CASE WHEN n = 0 THEN round(a, 4) ELSE round(a * pow(b / a, i / n::DOUBLE), 4) END AS factor FROM (SELECT *, unnest(range(n + 1)) AS i FROM n)""")
def _(t):
    k = F.col("p_partkey")
    at = lambda base, mod, by: F.lit(base) + (k % mod) * F.lit(by)
    return t.part.select("p_partkey", F.explode(S.scale_range(at(0.25, 40, 0.05), at(0.3, 61, 0.06), at(1.02, 9, 0.05))).alias("factor"))


@query("scan_sizes", "K17 H19 D27 C18 C19 C20", cte("fx_symbols") + """, n AS (SELECT page_id, shape, count(*) AS n FROM fx_symbols GROUP BY ALL)
    SELECT CAST(page_id AS VARCHAR) AS sheet, 'T-' || shape AS tag, CASE shape WHEN 'A' THEN 0.5 WHEN 'N' THEN 1.3333 ELSE 1.0 END::DOUBLE AS scale, n FROM n
    UNION ALL SELECT 'all', 'T-' || shape, CASE shape WHEN 'A' THEN 0.5 WHEN 'N' THEN 1.3333 ELSE 1.0 END::DOUBLE, CAST(sum(n) AS BIGINT) FROM n GROUP BY shape""")
def _(t):
    legend = legend_of(t)
    got = S.scan_sheets(t.fx_sized_primitives, t.fx_exemplars, legend)
    scales = got["scales"].join(legend.select("exemplar_id", "tag"), "exemplar_id").select("tag", F.round("scale", 4).alias("scale"))
    return got["counts"].join(scales, "tag").select("sheet", "tag", "scale", "n")


NESTED = """, b AS (SELECT page_id, placement_id, CAST([] AS BIGINT[]) AS path, group_key, 0 AS depth, m11::DOUBLE AS m11, m12::DOUBLE AS m12, m21::DOUBLE AS m21, m22::DOUBLE AS m22, tx::DOUBLE AS tx, ty::DOUBLE AS ty FROM fx_placed
    UNION ALL SELECT b.page_id, b.placement_id, list_append(b.path, CAST(u.use_no AS BIGINT)), u.child_key, b.depth + 1, b.m11*u.m11 + b.m12*u.m21, b.m11*u.m12 + b.m12*u.m22, b.m21*u.m11 + b.m22*u.m21, b.m21*u.m12 + b.m22*u.m22,
      b.m11*u.tx + b.m12*u.ty + b.tx, b.m21*u.tx + b.m22*u.ty + b.ty FROM b JOIN fx_block_uses u ON u.group_key = b.group_key)"""


@query("nested_blocks", "C17 K17", cte("fx_placed", "fx_block_uses", recursive=True) + NESTED + """
    SELECT page_id, placement_id, array_to_string(path, '.') AS path, group_key, depth, round(m11,6) + 0 AS m11, round(m12,6) + 0 AS m12, round(m21,6) + 0 AS m21, round(m22,6) + 0 AS m22, round(tx,6) + 0 AS tx, round(ty,6) + 0 AS ty FROM b""")
def _(t):
    b = S.place_blocks(t.fx_placed, t.fx_block_uses)
    return b.select("page_id", "placement_id", F.array_join("path", ".").alias("path"), "group_key", "depth", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in S.PLACED])


@query("scan_blocks", "K17 C17 D1 E9", cte("fx_placed", "fx_block_uses", recursive=True) + NESTED + """, n AS (SELECT page_id, replace(group_key, 'block-', 'T-') AS tag, count(*) AS n FROM b WHERE group_key LIKE 'block-%' GROUP BY ALL)
    SELECT CAST(page_id AS VARCHAR) AS sheet, tag, n FROM n UNION ALL SELECT 'all', tag, CAST(sum(n) AS BIGINT) FROM n GROUP BY tag""")
def _(t):
    blocks = S.block_boxes(S.place_blocks(t.fx_placed, t.fx_block_uses), t.fx_extents)
    refs = t.fx_exemplars.select("exemplar_id").distinct().select("exemplar_id", F.concat(F.lit("block-"), "exemplar_id").alias("group_key"), F.lit(1.0).alias("r11"), F.lit(0.0).alias("r12"), F.lit(0.0).alias("r21"), F.lit(1.0).alias("r22"))
    return S.scan_sheets(t.fx_primitives, t.fx_exemplars, legend_of(t), blocks=blocks, block_refs=refs, scale_search=False)["counts"]
