"""Quality rules, with lines that many documents of a host share.

Lines are normalised and hashed, and the distinct documents of a host that hold each line are counted,
each id with its text: rows that repeat both count once, copies under other ids count each. Lines in
``COMMON_DOCS`` or more are removed, and a document that this leaves with too few of its words is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markset.llm.common import WORD, table, whole_text

#: The base rules.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: A line is common on a host from so many documents on, however large the host is.
COMMON_DOCS = 10
#: A document that keeps less than this share of its words is depleted.
LEAST_LEFT = 0.3

_SPACE = " \t\n\r\x0b\x0c"
_SYMBOL = re.compile(r"[#*$%&|<>]")
_BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_IDS = ("doc_id", "source", "text_key")


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more, their first occurrence included."""
    n = len(words)
    if n < 4:
        return 0
    numbers: dict[bytes, int] = {}
    w = np.fromiter((numbers.setdefault(x, len(numbers)) for x in words), np.int64, n)
    if len(numbers) == n:
        return 0
    pair = np.unique(w[:-1] * len(numbers) + w[1:], return_inverse=True)[1]
    _, at, times = np.unique(pair[:-1] * len(numbers) + w[2:], return_inverse=True, return_counts=True)
    again = times[at] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k:n - 2 + k] |= again
    return int(covered.sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    words = text.encode().split()  # bytes split at exactly the six white-space characters that end a word
    seen, repeats = set(), 0
    for line in text.split("\n"):
        if line.strip(_SPACE):
            repeats += line in seen
            seen.add(line)
    return len(words), len(text) - sum(map(text.count, _SPACE)), len(_SYMBOL.findall(text)), repeats, repeated_words(words)


def base(docs: DataFrame) -> DataFrame:
    """doc_id, source, text_key and the base counts of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = np.array([base_counts(t) for t in b.column(3).to_pylist()], np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *(pa.array(c) for c in counts.T)],
                                             names=[*_IDS, *(c.split()[0] for c in _BASE.split(", "))])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.xxhash64("text").alias("text_key"), whole_text().alias("text"))
    return rows.mapInArrow(run, f"doc_id long, source string, text_key long, {_BASE}")


def normal(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")))


def lines(docs: DataFrame) -> DataFrame:
    """A row for each line with a word: its document, its hash and its words."""
    rows = docs.select(*(F.col(c) if c != "text_key" else F.xxhash64("text").alias(c) for c in _IDS), F.explode(F.split("text", "\n", -1)).alias("line"))
    rows = rows.select(*_IDS, F.xxhash64(normal(F.col("line"))).alias("line_key"), F.regexp_count("line", F.lit(WORD)).alias("words"))
    return rows.where("words > 0")


def common_lines(docs: DataFrame, least: int = COMMON_DOCS) -> DataFrame:
    """``(source, line_key)`` of the lines that ``least`` documents of a host hold. A null source is a host of its own."""
    held = lines(docs).groupBy("source", "line_key").agg(F.count_distinct(F.struct("doc_id", "text_key")).alias("docs"))
    return held.where(F.col("docs") >= least).select("source", "line_key")


def removed_words(docs: DataFrame, common: DataFrame) -> DataFrame:
    """Words of each document, by ``_IDS``, that stand in common lines."""
    c = common.select(F.col("source").alias("_host"), F.col("line_key").alias("_line"))
    hit = lines(docs).join(c, F.col("source").eqNullSafe(F.col("_host")) & (F.col("line_key") == F.col("_line")))
    return hit.groupBy(*_IDS).agg(F.sum("words").alias("removed"))


def judge_lines(docs: DataFrame, least: int = COMMON_DOCS, least_left: float = LEAST_LEFT) -> DataFrame:
    """doc_id, the base counts, base_failed, removed_words and kept, one row per row of ``docs``.

    Null text has no words and fails the base rules, as an empty one does; rows that repeat one doc_id,
    source and text have one verdict; an empty table gives an empty result; other columns are ignored.
    """
    counts = base(docs)
    gone = removed_words(docs, common_lines(docs, least))
    # a row that occurs several times had its lines counted as often
    per = counts.groupBy(*_IDS).agg(F.count(F.lit(1)).alias("_times"), *(F.first(c.split()[0]).alias(c.split()[0]) for c in _BASE.split(", ")))
    same = [per[c].eqNullSafe(gone[c]) for c in _IDS]
    out = per.join(gone, same[0] & same[1] & same[2], "left").select(
        per["doc_id"], *(c.split()[0] for c in _BASE.split(", ")), "_times", F.coalesce(F.col("removed") / F.col("_times"), F.lit(0)).cast("long").alias("removed_words"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("removed_words") >= least_left * F.col("n_words")))
    many = out.withColumn("_k", F.explode(F.expr("sequence(0L, (_times - 1) div 1000)")))
    return many.withColumn("_i", F.explode(F.expr("sequence(1, cast(least(1000, _times - _k * 1000) as int))"))).drop("_k", "_i", "_times")


def without_common_lines(docs: DataFrame, least: int = COMMON_DOCS) -> DataFrame:
    """``docs`` with the common lines of their hosts taken out of the text; n_chars follows where present."""
    common = common_lines(docs, least).groupBy("source").agg(F.collect_set("line_key").alias("_gone"))
    common = common.withColumnRenamed("source", "_host")
    out = docs.join(common, docs["source"].eqNullSafe(common["_host"]), "left").drop("_host")
    left = F.filter(F.split("text", "\n", -1), lambda x: ~F.array_contains(F.coalesce("_gone", F.array().cast("array<bigint>")), F.xxhash64(normal(x))))
    out = out.withColumn("text", F.when(F.col("text").isNotNull(), F.array_join(left, "\n"))).drop("_gone")
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge_lines(table(spark, sf_dir, "documents"))
