"""Deterministic ids, splits and digests as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPLITS = ("train", "val", "test")  # fixed values: split names in cumulative order


def split_value(key: Column, seed: int = 0) -> Column:
    """First eight digest bytes of the key as a fraction in [0, 1)."""
    text = key if seed == 0 else F.concat(F.lit(f"{seed}:"), key)
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / float(2**64)


def split_for(key: Column, fractions: dict[str, float] | None = None, seed: int = 0) -> Column:
    """Split of a whole document by its hash and cumulative fractions."""
    fractions = fractions or {"train": 0.7, "val": 0.15, "test": 0.15}
    u, total, out = split_value(key, seed), 0.0, None
    names = list(fractions)
    for name in names[:-1]:
        total += fractions[name]
        out = F.when(u < total, name) if out is None else out.when(u < total, name)
    return out.otherwise(names[-1])


def short_id(key: Column, length: int = 24) -> Column:
    return F.substring(F.sha2(key, 256), 1, length)


def canonical_json(fields: dict[str, Column], text: tuple[str, ...] = ()) -> Column:
    """JSON object text with sorted keys and no spaces. ``text`` fields are quoted, the
    others must already print as JSON (whole numbers, true, null)."""
    parts = []
    for i, name in enumerate(sorted(fields)):
        value = F.concat(F.lit('"'), fields[name], F.lit('"')) if name in text else fields[name].cast("string")
        parts += [F.lit(("," if i else "{") + f'"{name}":'), F.coalesce(value, F.lit("null"))]
    return F.concat(*parts, F.lit("}"))


def crop_key(version: Column, page_index: Column, box: list[Column], margin: Column) -> Column:
    """Digest of a crop's canonical description."""
    spec = canonical_json({"document_version": version, "page_index": page_index, "x0": box[0], "y0": box[1], "x1": box[2], "y1": box[3],
                           "margin": margin}, ("document_version",))
    return F.sha2(spec, 256)


def table_digest(df: DataFrame, row: Column, prefix: int = 4) -> DataFrame:
    """One digest of a whole table that no row order changes.

    Row digests are grouped by their first hex digits, each group is sorted and
    digested, and the group digests (at most 16**prefix) are digested again.
    """
    rows = df.select(F.sha2(row, 256).alias("d"))
    groups = rows.groupBy(F.substring("d", 1, prefix).alias("g")).agg(F.array_join(F.array_sort(F.collect_list("d")), "\n").alias("t"))
    hashed = groups.select("g", F.sha2("t", 256).alias("h"))
    return hashed.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("g", F.lit(":"), "h"))), "\n"), 256).alias("digest"))
