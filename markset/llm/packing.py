"""Best-fit packing of token sequences by exact-complement hashing.

Only lengths matter to the plan, and there are at most ``limit`` of them, so it is made on a
histogram of lengths. The lengths on hand are indexed by the sums of one, two and three of them;
each length from the longest down takes the combinations that fill its gap exactly, as often as
the counts allow. What remains is packed by best fit, again in bulk. Each step uses up a length or
a kind of open sequence, so the plan's size depends on ``limit`` and not on the number of documents.
The pieces of a length are then numbered and take the places that the plan has for that length.
"""

from __future__ import annotations

import itertools
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from markset.llm.common import stored, table, tokenizer_path
from markset.llm.tokens import encoder, ids_crc32, some_texts

LIMIT = 2048
END_ID = 0
#: Pieces of one length that one task numbers.
NUMBERED = 200_000

_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

#: A kind of sequence: how many there are, and the runs ``(length, times)`` in each, in order.
Pattern = tuple[int, tuple[tuple[int, int], ...]]


class _Stock:
    """Lengths on hand, indexed by sums."""

    def __init__(self, counts: Counter) -> None:
        self.left = Counter({n: c for n, c in counts.items() if c > 0})
        self.top = max(self.left, default=0)
        self.has = np.zeros(self.top + 1, bool)
        self.has[list(self.left)] = True

    def take(self, parts: tuple[int, ...]) -> int:
        """Use up ``parts`` as often as they are on hand; says how often."""
        need = Counter(parts)
        times = min(self.left[n] // k for n, k in need.items())
        for n, k in need.items():
            self.left[n] -= k * times
            if not self.left[n]:
                del self.left[n]
                self.has[n] = False
        return times

    def pairs(self, total: int) -> np.ndarray:
        """The larger lengths ``a`` of pairs on hand with ``a + b = total``, the largest first."""
        low = max((total + 1) // 2, 1)
        high = min(total - 1, self.top)
        if low > high or total - high < 1:
            return np.zeros(0, int)
        a = np.arange(high, low - 1, -1)
        return a[self.has[a] & self.has[total - a]]

    def exact(self, gap: int) -> Iterator[tuple[int, ...]]:
        """Combinations on hand that fill ``gap``: one length, then two, then three."""
        if 0 < gap <= self.top and self.has[gap]:
            yield (gap,)
        for a in self.pairs(gap):
            yield int(a), gap - int(a)
        for a in range(min(gap - 2, self.top), (gap + 2) // 3 - 1, -1):
            if self.has[a]:
                for b in self.pairs(gap - a):
                    if b <= a:
                        yield a, int(b), gap - a - int(b)


def plan(counts: Counter, limit: int = LIMIT) -> list[Pattern]:
    """Kinds of sequences that hold every length as often as it occurs."""
    stock, made = _Stock(counts), []
    for n in range(stock.top, 0, -1):
        if not stock.left[n]:
            continue
        if n == limit:
            made.append((stock.left.pop(n), ((n, 1),)))
            stock.has[n] = False
            continue
        for parts in stock.exact(limit - n):
            if not stock.left[n]:
                break
            if (times := stock.take((n, *parts))):
                made.append((times, tuple(Counter((n, *parts)).items())))
    return made + _best_fit(stock.left, limit)


def _best_fit(left: Counter, limit: int) -> list[Pattern]:
    """Best fit decreasing in bulk: open sequences with one gap and content move together."""
    open_: dict[int, list[list]] = defaultdict(list)  # gap -> [times, runs]
    for n in sorted(left, reverse=True):
        c = left[n]
        while c:
            gap = min((g for g in open_ if g >= n), default=None)
            if gap is None:
                times, runs, gap = -(-c // (limit // n)), [], limit
            else:
                times, runs = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap]
            each = gap // n
            full, rest = min(times, c // each), 0
            if full:
                open_[gap - each * n].append([full, [*runs, (n, each)]])
                c -= full * each
            if full < times and c:
                rest = 1
                open_[gap - c * n].append([1, [*runs, (n, c)]])
                c = 0
            if times - full - rest and runs:
                open_[gap].append([times - full - rest, runs])
    return [(times, tuple(runs)) for kinds in open_.values() for times, runs in kinds]


def cut_lengths(n: int, limit: int = LIMIT) -> list[tuple[int, int]]:
    """``(start, length)`` of a document's pieces; only the first may be shorter than ``limit``."""
    first = n % limit or limit
    return [(0, first), *((s, limit) for s in range(first, n, limit))]


def pieces(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    """Every document's token ids and the end id, cut into pieces of at most ``limit``: where each
    begins, how long it is and the checksum of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            ids_of = itertools.chain.from_iterable(map(enc.encode, some_texts(b.column(1))))
            rows = []
            for doc, ids in zip(b.column(0).to_pylist(), ids_of, strict=True):
                ids = np.append(ids, np.uint32(end_id))
                rows += [(doc, k, s, n, ids_crc32(ids[s:s + n])) for k, (s, n) in enumerate(cut_lengths(len(ids), limit))]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECES, strict=True)], schema=_PIECES)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def place(cut: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a stored table of pieces with their ``length``.

    The histogram has at most ``limit`` rows and comes to the driver, the plan made of it goes to the
    tasks. The pieces of one length are dealt to buckets by hash, numbered in each and shifted by the
    buckets before, so no length is gathered in one task.
    """
    counts = Counter({r["length"]: r["count"] for r in cut.groupBy("length").count().collect()})
    lengths, lows, highs, bases, offsets, each = _places(plan(counts, limit))
    buckets = F.greatest(F.lit(1), F.lit(-(-max(counts.values(), default=0) // NUMBERED)))
    dealt = cut.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), buckets))
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shifts = dealt.groupBy("length", "_b").count().select("length", "_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_shift"))
    order = Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = dealt.withColumn("_rank", F.row_number().over(order)).join(shifts, ["length", "_b"])
    ranked = ranked.withColumn("_rank", (F.col("_rank") + F.col("_shift") - 1).cast("long")).drop("_b", "_shift")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = np.rec.fromarrays([lengths, lows])
        for f in frames:
            n, rank = f["length"].to_numpy(np.int64), f.pop("_rank").to_numpy(np.int64)
            at = np.searchsorted(key, np.rec.fromarrays([n, rank], dtype=key.dtype), side="right") - 1
            within = rank - lows[at]
            yield f.assign(sequence_id=bases[at] + within // each[at], offset=offsets[at] + within % each[at] * n)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.drop("_rank").schema.fields]
    return ranked.mapInPandas(run, ", ".join([*fields, "sequence_id long", "offset long"]))


def _places(patterns: list[Pattern]) -> tuple[np.ndarray, ...]:
    """For each length the ranges of piece numbers that a run of a pattern takes, sorted."""
    used: Counter = Counter()
    rows, base = [], 0
    for times, runs in patterns:
        offset = 0
        for n, k in runs:
            rows.append((n, used[n], used[n] + times * k, base, offset, k))
            used[n] += times * k
            offset += n * k
        base += times
    return tuple(np.array(c, np.int64) for c in zip(*sorted(rows), strict=True)) if rows else (np.zeros(0, np.int64),) * 6


def pack(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text is empty and gives a piece of the end id alone; rows that repeat, a null doc_id and very
    long texts are packed like others; an empty table gives an empty result; other columns are ignored.
    """
    return place(stored(pieces(docs, tokenizer or tokenizer_path(), limit, end_id), "pieces"), limit)


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
