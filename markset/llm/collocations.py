"""Phrase collocations by Toivonen's sampling: propose on a sample, count exactly, expand where the border fails.

A phrase is a run of one to three words of a piece of text. A sample of the documents proposes the words and
pairs that it holds often enough. A full pass counts, exactly, every word, every pair of proposed words and
every triple of proposed pairs: the proposals and their negative border. A frequent phrase that was not
proposed is a failure of the border; it is added to the proposals and another full pass counts what that
opens, until none is left. Longer phrases are never more frequent than their parts, so nothing is missed.

Proposals go to the tasks as a table of bits of fixed size, whatever the corpus holds: a phrase is proposed
when the bit of its hash is set. A bit set by another phrase only has more counted than needed; counts are
kept by the phrase itself and are exact.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from markset.llm.common import stored, table, whole_text

#: Share of the documents in the sample, as one of so many.
ONE_OF = 8
#: Occurrences in the sample that propose a phrase, for each that is asked for in the whole: lowered, so few are missed.
LOWERED = 0.8
#: The table of proposals has so many bits a proposal, and two to this power bits at most.
BITS_EACH, BITS = 16, 27
#: Characters of one language handled at a time.
STEP_CHARS = 3_000_000

LONGEST = 3
_SCALE = 1_000_000
#: What parts pieces becomes a byte that no UTF-8 text has; tabs and spaces part words.
_MARK = b"\xff"
_PARTED = bytes(_MARK[0] if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
_COUNTS = "lang string, words int, phrase string, n long"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _seed(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))


def _pair_keys(first: np.ndarray, second: np.ndarray, seed: np.uint64) -> np.ndarray:
    return _mix(first * np.uint64(0xD6E8FEB86659FD93) + second + seed)


def _bit(table_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys >> np.uint64(65 - (64 * len(table_)).bit_length())
    return (table_[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _numbered(texts: list[str]) -> tuple[list[bytes], np.ndarray]:
    """The distinct words of some texts, and the texts as numbers of words; a zero parts pieces."""
    data = "\n".join(texts).encode().lower().translate(_PARTED).replace(_MARK, b" \xff ")
    tokens = [w for w in data.split(b" ") if w]
    number: dict[bytes, int] = defaultdict(count().__next__)
    number[_MARK]
    ids = np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens))
    return list(number), ids


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[str]]]:
    """Texts of one language at a time, of a bounded number of characters but for a single text."""
    for b in batches:
        held: dict[str, list[str]] = defaultdict(list)
        chars: dict[str, int] = defaultdict(int)
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            held[lang].append(text)
            chars[lang] += len(text)
            if chars[lang] > STEP_CHARS:
                yield lang, held.pop(lang)
                chars[lang] = 0
        yield from held.items()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), whole_text().alias("text"))


def _proposals(docs: DataFrame, least: int) -> np.ndarray:
    """The table of the words and pairs that occur ``least`` times or more in ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in _steps(batches):
            words, ids = _numbered(texts)
            h, seed = _hashes(words), _seed(lang)
            single = np.bincount(ids, minlength=len(words))
            single[0] = 0
            both = (ids[1:] > 0) & (ids[:-1] > 0)
            pairs, n = np.unique((ids[:-1] * len(words) + ids[1:])[both], return_counts=True)
            keys = [_mix(h + seed)[single > 0], _pair_keys(h[pairs // len(words)], h[pairs % len(words)], seed)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate([single[single > 0], n]))], names=["key", "n"])

    seen = docs.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    seen = stored(seen.select("key"), "proposals")
    return _as_table(seen, min(BITS, max(10, (BITS_EACH * seen.count()).bit_length())))


def _as_table(keys: DataFrame, bits: int) -> np.ndarray:
    """The keys' bits. At most 2 ** (BITS - 6) numbers come to the driver."""
    at = F.shiftrightunsigned("key", 64 - bits)
    bit = F.expr(f"bit_or(shiftleft(1L, CAST(shiftrightunsigned(key, {64 - bits}) & 63 AS INT)))")
    got, out = keys.groupBy(F.shiftright(at, 6).alias("at")).agg(bit.alias("bits")).toArrow(), np.zeros(1 << (bits - 6), np.uint64)
    out[got.column("at").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def _counted(docs: DataFrame, sent: Broadcast) -> DataFrame:
    """``(lang, words, phrase, n)`` of the proposals and their border, less what an earlier table had counted already.

    ``sent`` holds both tables. A task adds up the phrases of some texts before anything is shuffled. Without an
    earlier table, words are counted too, and the number of all words stands under zero words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, old = sent.value
        for lang, texts in _steps(batches):
            words, ids = _numbered(texts)
            v = len(words)
            h, seed = _hashes(words), _seed(lang)
            single = _mix(h + seed)
            names = pa.array(words, pa.binary())
            new = _bit(now, single)
            if old is None:
                n = np.bincount(ids, minlength=v)
                n[0] = 0
                some = np.flatnonzero(n)
                yield _rows(lang, 0, pa.array([b""], pa.binary()), np.array([n.sum()]))
                yield _rows(lang, 1, names.take(pa.array(some)), n[some])
            a, b = ids[:-1], ids[1:]
            both = (a > 0) & (b > 0)
            keys = _pair_keys(h[a], h[b], seed)
            counted, pair = both & new[a] & new[b], both & _bit(now, keys)
            triple = pair[:-1] & pair[1:]
            if old is not None:
                had, had_pair = _bit(old, single), _bit(old, keys)
                counted &= ~(had[a] & had[b])
                triple &= ~(had_pair[:-1] & had_pair[1:])
            code, n = np.unique((a * v + b)[counted], return_counts=True)
            yield _rows(lang, 2, pc.binary_join_element_wise(names.take(pa.array(code // v)), names.take(pa.array(code % v)), b" "), n)
            # with up to 2 ** 21 different words three numbers fit in one; more need the number of their first pair
            if v < 1 << 21:
                code, n = np.unique((ids[:-2] * (v * v) + ids[1:-1] * v + ids[2:])[triple], return_counts=True)
                first, second, third = code // (v * v), code // v % v, code % v
            else:
                two, of = np.unique((ids[:-2] * v + ids[1:-1])[triple], return_inverse=True)
                code, n = np.unique(of * v + ids[2:][triple], return_counts=True)
                first, second, third = two[code // v] // v, two[code // v] % v, code % v
            yield _rows(lang, 3, pc.binary_join_element_wise(*(names.take(pa.array(x)) for x in (first, second, third)), b" "), n)

    return docs.mapInArrow(run, _COUNTS).groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))


def _rows(lang: str, words: int, phrases: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    k = len(phrases)
    return pa.RecordBatch.from_arrays([pa.repeat(lang, k), pa.array(np.full(k, words, np.int32)), phrases.cast(pa.string()), pa.array(n.astype(np.int64))], names=["lang", "words", "phrase", "n"])


def _failures(frequent: DataFrame, sent: Broadcast) -> DataFrame:
    """Keys of frequent words and pairs that were not proposed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = []
            for lang, phrase in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h, seed = _hashes(phrase.encode().split(b" ")), _seed(lang)
                keys.append(_mix(h + seed) if len(h) == 1 else _pair_keys(h[:1], h[1:], seed))
            keys = np.concatenate([*keys, np.zeros(0, np.uint64)])
            yield pa.RecordBatch.from_arrays([pa.array(keys[~_bit(sent.value[0], keys)].view(np.int64))], names=["key"])

    return frequent.where("words in (1, 2)").select("lang", "phrase").mapInArrow(run, "key long")


def frequent_phrases(docs: DataFrame, least: int, one_of: int = ONE_OF) -> DataFrame:
    """``(lang, words, phrase, n)`` of every phrase of one to three words with ``least`` occurrences or more, and of the
    number of all words of a language under zero words. Exact: the sample decides what a pass costs, not what it finds.
    """
    docs = docs.select("lang", "text")
    some = docs.where(F.pmod(F.xxhash64("lang", "text"), F.lit(one_of)) == 0)
    proposed = _proposals(_texts(some), max(1, int(LOWERED * least / one_of)))
    found, before = [], None
    while True:
        sent = docs.sparkSession.sparkContext.broadcast((proposed, before))
        pass_ = stored(_counted(_texts(docs), sent).where((F.col("n") >= least) | (F.col("words") == 0)), "phrases")
        found.append(pass_)
        # the third pass can only open triples, which open nothing
        missed = stored(_failures(pass_, sent), "failures") if len(found) < LONGEST else None
        sent.unpersist()
        if missed is None or missed.isEmpty():
            break
        before, proposed = proposed, proposed | _as_table(missed, (64 * len(proposed)).bit_length() - 1)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, covered: int = 50) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the best ``top`` phrases of two or three words of each language.

    ``score`` is floor(10^6 a^2 / (l r)) at the cut where it is lowest; a pair goes when a frequent triple that
    holds it has ``covered`` per cent of its occurrences. Null text is empty, null ``lang`` is ``und``; repeated
    rows count as often as they occur; texts of any length are read whole, a task holding one at a time; ties
    in score go by occurrences, then by the phrase's bytes; an empty table gives an empty result; other columns
    are ignored. Products are decimals of 38 digits, exact up to 10^15 occurrences of a phrase.
    """
    f = frequent_phrases(docs, least)
    of = lambda words, name, n: f.where(F.col("words") == words).select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    part = F.split("phrase", " ")
    pairs = of(2, "phrase", "a").withColumns({"w1": part[0], "w2": part[1]})
    pairs = pairs.join(of(1, "w1", "l"), ["lang", "w1"]).join(of(1, "w2", "r"), ["lang", "w2"])
    pairs = pairs.select("lang", "phrase", "a", "l", "r", _score(F.col("l"), F.col("r")).alias("score"))
    triples = of(3, "phrase", "a").withColumns({"w1": part[0], "w3": part[2], "p1": F.concat_ws(" ", part[0], part[1]), "p2": F.concat_ws(" ", part[1], part[2])})
    covering = triples.select("lang", "a", F.explode(F.array("p1", "p2")).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    pairs = pairs.join(covering, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < covered * F.col("a"))).drop("most")
    for name, words in (("w1", 1), ("p2", 2), ("p1", 2), ("w3", 1)):
        triples = triples.join(of(words, name, f"n_{name}"), ["lang", name])
    s1, s2 = _score(F.col("n_w1"), F.col("n_p2")), _score(F.col("n_p1"), F.col("n_w3"))
    cut = lambda x, y: F.when(F.col("s1") <= F.col("s2"), F.col(x)).otherwise(F.col(y))
    triples = triples.withColumns({"s1": s1, "s2": s2}).select("lang", "phrase", "a", cut("n_w1", "n_p1").alias("l"), cut("n_p2", "n_w3").alias("r"), F.least("s1", "s2").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = pairs.unionByName(triples).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    total = f.where("words = 0").select("lang", "n")
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _score(left: F.Column, right: F.Column) -> F.Column:
    wide = lambda c: c.cast("decimal(19,0)")
    above = (wide(F.col("a")) * wide(F.col("a"))).cast("decimal(31,0)") * F.lit(_SCALE).cast("decimal(7,0)")
    below = (wide(left) * wide(right)).cast("decimal(38,0)")
    return ((above - above % below) / below).cast("long")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


#: The same phrases by counting all of them, for DuckDB.
OP12_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (
  SELECT lang, 1 AS k, unnest(w) AS phrase FROM w
  UNION ALL SELECT lang, 2, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) FROM w
  UNION ALL SELECT lang, 3, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) FROM w),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cuts AS (
  SELECT c.lang, c.k, c.phrase, c.a, cut, x.f AS l, y.f AS r, ((1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c
  JOIN f x ON x.lang = c.lang AND x.k = cut AND x.phrase = array_to_string(c.w[1:cut], ' ')
  JOIN f y ON y.lang = c.lang AND y.k = c.k - cut AND y.phrase = array_to_string(c.w[cut + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, k, phrase ORDER BY score, cut) = 1),
over AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM c WHERE k = 3),
most AS (SELECT lang, phrase, max(a) AS most FROM over GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN most m ON b.k = 2 AND m.lang = b.lang AND m.phrase = b.phrase WHERE m.most IS NULL OR 100 * m.most < 50 * b.a)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY k.score DESC, k.a DESC, k.phrase) AS rank, k.phrase, k.a, k.l, k.r, n.n, k.score
FROM kept k JOIN n ON n.lang = k.lang QUALIFY rank <= 2000
"""
