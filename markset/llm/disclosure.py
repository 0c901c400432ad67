"""Personal data by information-theoretic sanitisation, with DataFrame functions only.

Base matches (e-mail, IP, card, phone) are the protected entities. A context is a line that holds one.
Over the distinct lines of the corpus, the pointwise mutual information of a term with an entity, as a
share of the entity's own information, says how much of the entity the term reveals: 1 where the term only
ever occurs with the entity, 0 where the two are independent. In texts that hold the entity, terms at or
above ``REMOVE`` are removed, those at or above ``GENERALISE`` are replaced by their kind, and base matches
are replaced by theirs.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markset.llm.common import stored, table, whole_text

#: Distinct contexts in which an entity and a term must meet before their information is trusted.
SUPPORT = 3
REMOVE, GENERALISE = 0.9, 0.6
#: Letters that a term must have.
TERM_LETTERS = 3

#: The base kinds in their order and their patterns. A run is entered at its first character
#: or where the match before ended, and groups are possessive, which finds the same matches in linear time.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = r"0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
_IP = rf"^{_PART}(?:\.{_PART}){{3}}$"
#: A term: a run of letters, marks and apostrophes inside words.
TERM = rf"(?<![\p{{L}}\p{{M}}'])\p{{L}}[\p{{L}}\p{{M}}']{{{TERM_LETTERS - 1},}}+"

_SPAN = "array<struct<start:bigint,finish:bigint,kind:string,value:string>>"


def _luhn(digits: Column) -> Column:
    """Whether a text of digits has a Luhn sum divisible by ten."""
    at = F.sequence(F.lit(1), F.length(digits))
    double = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    each = F.transform(at, lambda i: F.substring(F.reverse(digits), i, F.lit(1)).cast("int"))
    return F.aggregate(F.transform(each, lambda d, i: F.when(i % 2 == 1, double(d)).otherwise(d)), F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(_IP)
    digits = F.regexp_replace(value, "[^0-9]", "")
    low, high = (12, 19) if kind == "card" else (9, 15)
    within = F.length(digits).between(low, high)
    return within & F.when(within, _luhn(digits)).otherwise(False) if kind == "card" else within


def _located(text: Column, pattern: Column) -> Column:
    """All matches of a pattern with their place, in code points: what lies between them tells where they are."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,finish:bigint,value:string>>").alias("out"))

    def step(acc: Column, m: Column) -> Column:
        begin = acc["at"] + m["gap"]
        end = begin + F.length(m["value"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("finish"), m["value"].alias("value")))).alias("out"))

    pairs = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda v, g: F.struct(v.alias("value"), g.alias("gap")))
    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def _of_kind(found: Column, order: int, kind: str) -> Column:
    """The valid ones among the matches of one kind."""
    return F.transform(F.filter(found, lambda m: _valid(kind, m["value"])),
                       lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("order"), m["finish"].alias("finish"), F.lit(kind).alias("kind"), m["value"].alias("value")))


def _number(kind: str) -> Column:
    return F.size(F.filter("base", lambda m: m["kind"] == kind)).cast("long").alias(f"n_{kind}")


def base_spans(text: Column) -> Column:
    """Valid base matches of a text as spans, sorted by start, then by kind in the order of ``KINDS``."""
    none = F.array().cast("array<struct<start:bigint,finish:bigint,value:string>>")
    each = []
    for order, kind in enumerate(KINDS):
        mark = {"email": "@", "ip": ".", "phone": "+"}.get(kind)
        has = F.contains(text, F.lit(mark)) if mark else F.lit(True)
        got = F.when(has & F.regexp_like(text, F.lit(PATTERNS[kind])), _located(text, F.lit(PATTERNS[kind]))).otherwise(none)
        each.append(_of_kind(got, order, kind))
    merged = F.array_sort(functools.reduce(F.concat, each))
    return F.transform(merged, lambda m: F.struct(m["start"], m["finish"], m["kind"], m["value"])).cast(_SPAN)


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["finish"].cast("string"))), ",")


def _terms(line: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(line, F.lit(TERM), F.lit(0)), F.lower))


def disclosing_terms(held: DataFrame, docs: DataFrame, support: int = SUPPORT, least: float = GENERALISE) -> DataFrame:
    """``(entity, term, share)`` of the terms that reveal an entity to ``least`` or more of its information.

    ``held(text, base)`` are the texts with base matches, ``docs`` all of them. A context is a whole line, without
    the entity itself; lines are told apart by a 64-bit hash. Copies of a line count once in every number. Each
    task drops its own copies of a line and adds up its own terms before anything is shuffled.
    """
    lines = held.select(F.explode(F.split("text", "\n", -1)).alias("line")).select("line", base_spans(F.col("line")).alias("base"))
    lines = lines.where(F.size("base") > 0).groupBy(F.xxhash64("line").alias("line_key")).agg(F.first("line").alias("line"), F.first("base").alias("base"))
    contexts = stored(lines.select("line", F.transform("base", lambda m: m.withField("entity", _entity(m))).alias("base")), "contexts")
    each = contexts.select("line", "base", F.explode(F.array_distinct(F.col("base.entity"))).alias("entity"))
    often = each.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")).where(F.col("n_entity") >= support)
    others = _replaced(F.col("line"), F.filter("base", lambda m: m["entity"] == F.col("entity")), lambda m: F.lit(" "))
    met = each.join(often, "entity").select("entity", "n_entity", F.explode(_terms(others)).alias("term"))
    joint = stored(met.groupBy("entity", "n_entity", "term").agg(F.count(F.lit(1)).alias("n_joint")).where(F.col("n_joint") >= support), "joint")
    lines = docs.select(F.explode(F.split("text", "\n", -1)).alias("line")).groupBy(F.xxhash64("line").alias("line_key")).agg(F.first("line").alias("line"))
    # each line has the empty term once: its number is that of the lines
    counts = lines.select(F.explode(F.concat(F.array(F.lit("")), _terms(F.col("line")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    wanted = joint.select("term").distinct().unionByName(joint.sparkSession.range(1).select(F.lit("").alias("term")))
    counts = stored(counts.join(wanted, "term", "left_semi"), "counts")
    total = counts.where(F.col("term") == "").select(F.col("n_term").alias("n"))  # one row
    info = F.log(F.col("n") / F.col("n_entity"))
    mutual = F.log(F.col("n") * F.col("n_joint") / (F.col("n_entity") * F.greatest("n_term", "n_joint")))
    scored = joint.join(counts, "term").crossJoin(F.broadcast(total)).withColumn("share", F.when(info > 0, mutual / info).otherwise(0.0))
    return scored.where(F.col("share") >= least).select("entity", "term", "share")


def sanitise(docs: DataFrame, support: int = SUPPORT, remove: float = REMOVE, generalise: float = GENERALISE) -> DataFrame:
    """``docs`` with columns ``base``, ``spans`` and ``sanitised`` added.

    ``base`` are the base spans, ``spans`` those and the terms of kind ``term`` that disclose an entity of the
    text; ``sanitised`` is the text with base matches replaced by their kind in brackets, terms above ``remove``
    taken out and other terms replaced by ``[term]``; of spans that overlap, the later starts where the first ends. Null text is empty
    and stays null; repeated rows are treated alike; an empty table gives an empty result; other columns pass.
    """
    with_base = docs.withColumn("base", base_spans(whole_text()))
    held = stored(with_base.where(F.size("base") > 0).select("text", "base").distinct(), "entities")
    found = disclosing_terms(held, docs.where(F.col("text").isNotNull()), support, generalise)
    own = held.select("text", F.explode(F.array_distinct(F.transform("base", _entity))).alias("entity"))
    hits = own.join(found, "entity").groupBy("text", "term").agg(F.max("share").alias("share"))
    inside = r"(?<![\p{L}\p{M}'])(?iu:\Q%s\E)(?![\p{L}\p{M}'])"
    pattern = F.format_string(inside, F.col("term"))
    spans = F.transform(_located(F.col("text"), pattern), lambda m: F.struct(
        m["start"].alias("start"), m["finish"].alias("finish"), F.when(F.col("share") >= remove, F.lit("term-removed")).otherwise(F.lit("term")).alias("kind"), m["value"].alias("value")))
    terms = hits.select(F.col("text").alias("_text"), spans.alias("_s")).groupBy("_text").agg(F.flatten(F.collect_list("_s")).alias("_terms"))
    key = F.xxhash64("text")
    out = (with_base.where(F.size("base") > 0).withColumn("_k", key)
           .join(terms.withColumn("_h", F.xxhash64("_text")), (F.col("_k") == F.col("_h")) & (F.col("text") == F.col("_text")), "left").drop("_k", "_h", "_text"))
    plain = with_base.where(F.size("base") == 0).withColumn("_terms", F.array().cast(_SPAN))
    both = out.withColumn("_terms", F.coalesce("_terms", F.array().cast(_SPAN))).unionByName(plain)
    rank = lambda m: F.coalesce(F.array_position(F.array(*map(F.lit, KINDS)), m["kind"]), F.lit(0))
    tagged = F.transform(F.concat("base", "_terms"), lambda m: F.struct(m["start"], F.when(rank(m) == 0, 99).otherwise(rank(m)).alias("order"), m["finish"], m["kind"], m["value"]))
    both = both.withColumn("spans", F.transform(F.array_sort(tagged), lambda m: F.struct(m["start"], m["finish"], m["kind"], m["value"])).cast(_SPAN))
    return both.withColumn("sanitised", F.when(F.size("spans") == 0, F.col("text")).otherwise(_replaced(F.col("text"), F.col("spans"), _mark))).drop("_terms")


def _entity(m: Column) -> Column:
    return F.concat_ws(":", m["kind"], F.lower(m["value"]))


def _replaced(text: Column, spans: Column, mark: Callable[[Column], Column]) -> Column:
    """The text with its spans replaced by their marks, left to right; what an earlier span took is not replaced again."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))
    cut = lambda begin, end: F.substring(text, (begin + 1).cast("int"), F.greatest(end - begin, F.lit(0)).cast("int"))

    def step(acc: Column, m: Column) -> Column:
        new = F.concat(acc["parts"], F.array(cut(acc["at"], m["start"]), mark(m)))
        return F.struct(F.greatest(acc["at"], m["finish"]).alias("at"), F.when(m["finish"] > acc["at"], new).otherwise(acc["parts"]).alias("parts"))

    rest = lambda acc: F.concat(F.array_join(acc["parts"], ""), cut(acc["at"], F.length(text)))
    return F.aggregate(spans, start, step, rest)


def _mark(m: Column) -> Column:
    return F.when(m["kind"] == "term-removed", F.lit("")).otherwise(F.concat(F.lit("["), m["kind"], F.lit("]")))


def op1_pii(spark, sf_dir: str) -> DataFrame:
    out = sanitise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *map(_number, KINDS), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"),
                      F.sha2(F.coalesce("sanitised", F.lit("")), 256).alias("sanitised_sha256"))
