"""Mixing sources to target weights by cube-method balanced sampling.

A source's documents all get the inclusion rate ``target / size of the source``. Its
whole part is taken outright; the fraction is settled by the flight phase of the cube
method. Within a block the vector of fractional inclusion probabilities moves along
the null space of two constraints, the expected number of documents and the expected
number of words, until no more than two of them are neither 0 nor 1. What is left of
all blocks is dealt into new blocks and flown again, so a source of any size ends in
one landing problem of a dozen documents, solved by trying every choice.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markset.llm.common import WORD, shuffle_partitions, stored, table, whole_text
from markset.operators.running import dense_ids

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
#: Documents of a source that one task flies at a time.
BLOCK = 4096
#: Documents that a source's last block keeps back from the flight for the landing.
LANDING = 10

_UNIT = "source_no long, unit long, doc_id long, size long, p double"


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``(source, source_no, source_size, n_docs, target)`` from ``sizes(source, size)``.

    Sources by code point, null last, take ``weights`` in turn. They divide ``share`` of all
    sizes by weight; a target stops at ``most`` times its source's size and the excess goes to
    the others by weight until none is above. Each round is one aggregate over the sources.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    per = per.withColumn("_last", F.col("source").isNull())
    numbered = dense_ids(per, [F.col("_last"), F.col("source")], "source_no").drop("_last")
    numbered = numbered.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                                     ((F.col("source_no") - 1) % len(weights) + 1).cast("int")))
    numbered = stored(numbered, "sources")
    total = share * (numbered.agg(F.sum("source_size")).first()[0] or 0)
    cap = F.col("source_size") * most
    level, settled = 0.0, -1
    while True:
        free = F.col("w") * level < cap
        got = numbered.agg(F.sum(F.when(~free, cap).otherwise(0.0)), F.sum(F.when(free, F.col("w"))), F.sum(F.when(free, 0).otherwise(1))).first()
        if not got[1] or got[2] == settled:
            break
        level, settled = (total - got[0]) / got[1], got[2]
    return numbered.select("source", "source_no", "source_size", "n_docs", F.least(F.col("w") * level, cap).alias("target"))


def fly(size: list[float], p: list[float], seed: int) -> list[float]:
    """Flight phase under the two constraints; at most two entries stay strictly between 0 and 1.

    Three open units have columns (1, size); their null vector is the cross product of the two rows.
    """
    rng, tiny = random.Random(seed), 1e-9
    open_: list[int] = []
    waiting = iter(range(len(p)))
    while True:
        while len(open_) < 3 and (k := next(waiting, None)) is not None:
            if tiny < p[k] < 1 - tiny:
                open_.append(k)
            else:
                p[k] = round(p[k])
        if len(open_) < 3 and not (len(open_) == 2 and size[open_[0]] == size[open_[1]]):
            return p
        a, b = open_[0], open_[1]
        if len(open_) == 2:
            u = (1.0, -1.0)
        else:
            c = open_[2]
            u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
            if not any(u):
                u = (1.0, -1.0, 0.0)
        up = min((((1 - p[k]) if v > 0 else -p[k]) / v for k, v in zip(open_, u, strict=True) if v), default=0.0)
        down = min(((p[k] if v > 0 else p[k] - 1) / v for k, v in zip(open_, u, strict=True) if v), default=0.0)
        step = up if rng.random() * (up + down) < down else -down
        for k, v in zip(open_, u, strict=True):
            p[k] += step * v
        done = [k for k in open_ if not tiny < p[k] < 1 - tiny]
        for k in done:
            p[k] = float(round(p[k]))
        open_ = [k for k in open_ if k not in done]


def land(size: list[float], p: list[float]) -> list[float]:
    """The 0/1 choice of the last few units whose words, then number, come nearest their expectation."""
    left = [k for k, v in enumerate(p) if 0 < v < 1]
    words, count = sum(size[k] * p[k] for k in left), sum(p[k] for k in left)
    best = min(itertools.product((0.0, 1.0), repeat=len(left)),
               key=lambda s: (abs(sum(size[k] * x for k, x in zip(left, s, strict=True)) - words), abs(sum(s) - count), s))
    for k, x in zip(left, best, strict=True):
        p[k] = x
    return p


def _flights(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["unit", "doc_id", "size"], kind="stable")
    size, p = pdf["size"].astype(float).tolist(), pdf["p"].tolist()
    seed = hash((int(pdf["source_no"].iloc[0]), int(pdf["unit"].iloc[0]), len(p)))
    if pdf["lands"].iloc[0]:
        p = land(size, fly(size[:-LANDING], p[:-LANDING], seed) + p[-LANDING:])
    else:
        p = fly(size, p, seed)
    return pdf.assign(p=p)[["source_no", "unit", "doc_id", "size", "p"]]


def sample_units(units: DataFrame, block: int = BLOCK) -> DataFrame:
    """``units(source_no, unit, doc_id, size, p)`` with every ``p`` settled to 0 or 1.

    The number of open units falls by about ``block / 2`` a round. Units meet their source's count by
    source and salt, so that a hot source is spread and its blocks are flown in different tasks.
    """
    done, salts = [], shuffle_partitions(units.sparkSession)
    while True:
        blocks = units.groupBy("source_no").agg(F.count(F.lit(1)).alias("_n")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        # what fits one block is a source's last flight, and lands
        dealt = (units.withColumn("_salt", F.pmod(F.xxhash64("unit"), F.lit(salts)).cast("int")).join(blocks, ["source_no", "_salt"]).drop("_salt")
                 .withColumn("_block", F.pmod(F.xxhash64("unit", F.lit(len(done))), F.ceil(F.col("_n") / block)))
                 .withColumn("lands", F.col("_n") <= block))
        flown = stored(dealt.groupBy("source_no", "_block").applyInPandas(_flights, _UNIT), "flight")
        done.append(flown.where((F.col("p") == 0) | (F.col("p") == 1)))
        units = flown.where((F.col("p") > 0) & (F.col("p") < 1))
        if units.isEmpty():
            return _union(done)


def _union(frames: Iterable[DataFrame]) -> DataFrame:
    first, *rest = frames
    for f in rest:
        first = first.unionByName(f)
    return first


def mix_plan(rows: DataFrame, block: int = BLOCK, **targets) -> DataFrame:
    """``rows(doc_id, text_key, source, size)`` -> the distinct rows with ``source_size``, ``target`` and ``copies``.

    Rows equal in all four columns are one unit and taken alike. Sizes of 0 join the draw by number only.
    """
    goals = source_targets(rows.select("source", "size"), **targets).withColumnRenamed("source", "_source")
    units = rows.groupBy("doc_id", "text_key", "source", "size").agg(F.count(F.lit(1)).alias("times"))
    units = units.join(goals, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(MOST))).otherwise(F.lit(1.0))
    units = units.withColumn("rate", rate).withColumn("unit", F.xxhash64("doc_id", "text_key", "source", "size"))
    units = stored(units, "units")
    frac = F.col("rate") - F.floor("rate")
    drawn = sample_units(units.select("source_no", "unit", "doc_id", (F.col("size") * F.col("times")).alias("size"), frac.alias("p")), block)
    drawn = drawn.select("source_no", "unit", F.col("p").alias("_s"))
    out = units.join(drawn, ["source_no", "unit"])
    return out.select("doc_id", "text_key", "source", "size", "times", "source_size", "target",
                      (F.floor("rate") + F.col("_s")).cast("long").alias("copies"))


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "source", F.regexp_count(whole_text(), F.lit(WORD)).cast("long").alias("size"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mixed documents: each row of ``docs`` as often as the mix takes it, all columns kept.

    Null or empty text has size 0; a null source is a source of its own, the last one; an empty
    table gives an empty one; extra columns pass through.
    """
    keys = ["_doc", "_key", "_source"]
    plan = mix_plan(sized(docs)).select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), F.col("source").alias("_source"),
                                        F.col("copies").alias("_copies"))
    here = docs.withColumn("_text_key", F.xxhash64("text"))
    out = here.join(plan.where("_copies > 0"), here["doc_id"].eqNullSafe(plan["_doc"]) & (here["_text_key"] == plan["_key"]) & here["source"].eqNullSafe(plan["_source"]))
    repeats = F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int")))
    return out.withColumn("_repeat", repeats).drop("_repeat", "_copies", "_text_key", *keys)


def op9_mix_sources(spark, sf_dir: str) -> DataFrame:
    plan = mix_plan(sized(table(spark, sf_dir, "documents")))
    # a row for each repeat of a document again, a thousand at a time
    many = plan.withColumn("_k", F.explode(F.expr("sequence(0L, (times - 1) div 1000)")))
    each = many.withColumn("_i", F.explode(F.expr("sequence(1, cast(least(1000, times - _k * 1000) as int))")))
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
