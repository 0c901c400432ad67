"""Benchmark decontamination with DataFrame functions only.

The windows of the benchmark's normalised words go to every task as a hash table of their keys. Each text is
read once: its words become 64-bit numbers, each run of as many numbers as a window has words becomes a key,
and where a key is in the table the words themselves are compared with the window's. What has been verified
are hits: they mark documents, or the spans of words that go.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markset.llm.common import stored, table, whole_text

#: Words of a window; an item of fewer words is one window.
WINDOW = 10
#: Windows that are sent to every task at a time, of about 150 bytes each. A larger benchmark goes in several parts.
SENT = 400_000
#: A word: digits, letters a to z after A to Z are lower-cased, and all that is not ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_CASED = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def benchmark_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """``(item, length, window)``: every window of every item, as words joined by a space."""
    w = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(whole_text()).alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(size))
    first = F.explode(F.sequence(F.lit(1), F.size("w") - length + 1))
    at = w.select("item", "w", length.alias("length"), first.alias("at"))
    return at.select("item", "length", F.array_join(F.slice("w", F.col("at"), F.col("length")), " ").alias("window")).distinct()


def _key(hashes: Column, at: Column, length: int) -> Column:
    return F.xxhash64(F.lit(length), *(F.get(hashes, at + i) for i in range(length)))


def _window_key(lengths: list[int]) -> Column:
    w = F.split("window", " ")
    hashes = F.transform(w, lambda x: F.xxhash64(x))
    return functools.reduce(lambda out, n: out.when(F.col("length") == n, _key(hashes, F.lit(0), n)), lengths[1:], F.when(F.col("length") == lengths[0], _key(hashes, F.lit(0), lengths[0])))


def hits(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Stored ``(doc_id, text_key, n_words, at, length, window)`` of every verified window in every text, and the windows.

    Each row of ``docs`` also stands there once with ``at`` = -1 and no window, so one reading of the texts gives both.
    """
    windows = stored(benchmark_windows(benchmark, size), "windows")
    lengths = sorted(r["length"] for r in windows.select("length").distinct().collect())  # at most ``size`` numbers
    known = windows.select("length", "window").distinct()
    text = docs.select("doc_id", F.xxhash64(whole_text()).alias("text_key"), words(whole_text()).alias("w"))
    read = text.select("doc_id", "text_key", F.size("w").cast("long").alias("n_words"), "w", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    own = read.select("doc_id", "text_key", "n_words", F.lit(-1).alias("at"), F.lit(0).alias("length"), F.lit("").alias("window"))
    if not lengths:
        return stored(own, "hits"), windows
    known = known.withColumn("key", _window_key(lengths))
    parts = -(-known.count() // SENT)
    out = []
    for part in range(parts):
        some = known.where(F.pmod("key", F.lit(parts)) == part) if parts > 1 else known
        if part == 0:  # stands for the text itself
            some = some.unionByName(known.sparkSession.range(1).select(F.lit(0).alias("length"), F.lit("").alias("window"), F.lit(0).cast("long").alias("key")))
        some = F.broadcast(some.select("key", "length", "window"))
        at = read.select("*", F.explode(F.sequence(F.lit(-1), F.greatest(F.size("h") - lengths[0], F.lit(-1)))).alias("at"))
        key = lambda n: F.when(F.col("at") + n <= F.size("h"), _key(F.col("h"), F.col("at"), n))
        first = F.when(F.col("at") < 0, F.lit(0).cast("long")).otherwise(key(lengths[0]))
        if len(lengths) == 1:
            at = at.withColumns({"n": F.lit(lengths[0]), "key": first})
        else:
            each = [F.struct(F.lit(n).alias("n"), (first if k == 0 else F.when(F.col("at") >= 0, key(n))).alias("key")) for k, n in enumerate(lengths)]
            at = at.select("*", F.inline(F.array(*each)))
        same = F.when(F.col("at") < 0, F.col("length") == 0).otherwise((F.col("length") == F.col("n")) & (F.array_join(F.slice("w", F.greatest("at", F.lit(0)) + 1, F.col("n")), " ") == F.col("window")))
        out.append(at.join(some, "key").where(same).select("doc_id", "text_key", "n_words", "at", "length", "window"))
    return stored(functools.reduce(DataFrame.unionByName, out), "hits"), windows


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, text_key, n_words, hit_words (sorted numbers of the hit words, from 0), items (sorted), a row each of ``docs``.

    Rows equal in id and text are found once and given out as often as they occur. Null text has no words, and
    neither has a text without letters or digits: nothing is hit. Texts of any length are read whole; a text's
    hits are added up by (id, 64-bit hash of the text). An item whose words equal another's is an item of its own;
    rows of the benchmark that share an item_id are one item, a null item_id is written as empty. Empty tables
    give empty or clean results; other columns are ignored.
    """
    found, windows = hits(docs, benchmark, size)
    rows = found.where("at < 0").groupBy("doc_id", "text_key", "n_words").agg(F.count(F.lit(1)).alias("_rows"))
    hit = found.where("at >= 0")
    hit_words = hit.select("doc_id", "text_key", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("length") - 1)).alias("_w"))
    hit_words = hit_words.distinct().groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list("_w")).alias("hit_words"))
    items = hit.select("doc_id", "text_key", "length", "window").distinct().join(windows, ["length", "window"])
    items = items.select("doc_id", "text_key", "item").distinct().groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    key = lambda df: df.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
    both = rows.join(key(hit_words), same, "left").drop("_id", "_key").join(key(items), same, "left").drop("_id", "_key")
    both = both.withColumns({"hit_words": F.coalesce("hit_words", F.array().cast("array<int>")), "items": F.coalesce("items", F.array().cast("array<string>"))})
    return both.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_rows").cast("int")))).drop("_n", "_rows")


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, spans: bool = True) -> DataFrame:
    """``docs`` without what they share with the benchmark: spans of hit words, or whole documents.

    All columns pass as they are; with ``spans``, ``text`` loses each stretch of hit words with what stands between
    them and up to the next word. Columns may have any name but ``_hit_id`` and ``_hit_key``, ``_hit_words``, which are refused.
    """
    taken = {"_hit_id", "_hit_key", "_hit_words"} & set(docs.columns)
    if taken:
        raise ValueError(f"columns {sorted(taken)} are the operator's own")
    found, _ = hits(docs, benchmark, size)
    at = found.where("at >= 0").select(F.col("doc_id").alias("_hit_id"), F.col("text_key").alias("_hit_key"), F.explode(F.sequence(F.col("at"), F.col("at") + F.col("length") - 1)).alias("_w"))
    at = at.distinct().groupBy("_hit_id", "_hit_key").agg(F.array_sort(F.collect_list("_w")).alias("_hit_words"))
    same = F.col("doc_id").eqNullSafe(F.col("_hit_id")) & (F.xxhash64(whole_text()) == F.col("_hit_key"))
    if not spans:
        return docs.join(at, same, "left_anti")
    both = docs.join(at, same, "left")
    return both.withColumn("text", F.when(F.col("_hit_words").isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col("_hit_words")))).select(*docs.columns)


def _without(text: Column, hit: Column) -> Column:
    """A text without some words: what stands before the first word, then the stretches that stay."""
    w = F.regexp_extract_all(text, F.lit(_CASED), F.lit(0))
    gaps = F.split(text, _CASED, -1)
    pairs = F.zip_with(w, F.slice(gaps, F.lit(2), F.size(w)), lambda a, b: F.concat(a, b))
    # a stretch of hit words begins where the word before is none and ends where the one after is none
    first = F.filter(hit, lambda x, i: (i == 0) | (F.get(hit, i - 1) != x - 1))
    after = F.transform(F.filter(hit, lambda x, i: (i == F.size(hit) - 1) | (F.get(hit, i + 1) != x + 1)), lambda x: x + 1)
    kept = F.arrays_zip(F.concat(F.array(F.lit(0)), after).alias("a"), F.concat(first, F.array(F.size(w))).alias("b"))
    return F.concat(gaps[0], F.array_join(F.transform(kept, lambda k: F.array_join(F.slice(pairs, k["a"] + 1, k["b"] - k["a"]), "")), ""))


def op11_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n = F.size("hit_words").cast("long")
    return found.select("doc_id", "n_words", n.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n > 0).alias("contaminated"))


#: The same by joining all windows, for DuckDB.
OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS window
      FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
g AS (SELECT row, k, i, array_to_string(w[i:i + k - 1], ' ') AS window
      FROM (SELECT row, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT k FROM v) ks WHERE len(w) >= k)),
h AS (SELECT g.row, g.i, g.k, v.item FROM g JOIN v ON g.k = v.k AND g.window = v.window),
x AS (SELECT row, count(DISTINCT place) AS n FROM (SELECT row, unnest(range(i, i + k)) AS place FROM h) GROUP BY row),
y AS (SELECT row, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item FROM h) GROUP BY row)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(x.n, 0) AS n_hit, coalesce(y.n, 0) AS n_items,
       sha256(coalesce(y.items, '')) AS items_sha256, x.n IS NOT NULL AS contaminated
FROM d LEFT JOIN x ON d.row = x.row LEFT JOIN y ON d.row = y.row
"""
