"""Runs of repeating words by longest common extensions over a difference cover.

A run is a maximal stretch with a smallest period that it holds several times over. For each period p the
texts are probed at multiples of 2p: a run of four periods or more holds a probe with p words equal to the
p words after them on its right, so every run is met, and probing all periods costs n ln n comparisons.

How far two places agree is a longest common extension. Residues modulo ``COVER`` with every difference
(a difference cover) choose the suffixes that are sorted, three in seven. Any two places reach such suffixes
at the same step within ``COVER`` words; what lies before is compared word by word, from there the least
common prefix between their ranks says the rest, by a sparse table of range minima. Backward extensions are
those of the reversed words. Only texts in which a probe agrees for as far as words are compared are sorted.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markset.llm.common import table, whole_text

#: A difference cover: every number modulo 7 is a difference of two of these.
COVER, RESIDUES = 7, (0, 1, 3)
#: A run has so many periods and so many words at least.
PERIODS, LEAST = 4, 6
#: Words handled together, but for a single longer text.
STEP_WORDS = 400_000


def _meeting() -> np.ndarray:
    """For residues of two places, the steps after which both are in the cover."""
    step = np.zeros((COVER, COVER), np.int64)
    for a in range(COVER):
        for b in range(COVER):
            step[a, b] = next(s for s in range(COVER) if (a + s) % COVER in RESIDUES and (b + s) % COVER in RESIDUES)
    return step


_STEP = _meeting()


class CommonExtension:
    """How many words agree from two places of one text on, for an array of words in which texts stand one after another.

    ``text`` numbers the text of each word, rising. Suffixes end with their text.
    """

    def __init__(self, words: np.ndarray, text: np.ndarray) -> None:
        n = len(words)
        self.n, self.words = n, np.concatenate([words, np.full(COVER, -1)])
        self.text = np.concatenate([text, np.full(COVER, -1)])
        self.ends = np.searchsorted(text, text, side="right")  # where each word's text ends
        place = np.concatenate([np.arange(r, n, COVER) for r in RESIDUES])
        place.sort()
        m = len(place)
        # the rank of a sampled suffix by its text and its first COVER words, then by doubling: COVER words on is sampled too
        at = np.full(n + 1, -1)
        at[place] = np.arange(m)
        rank = text[place].astype(np.int64)
        v = int(words.max(initial=0)) + 2
        for t in range(COVER):
            inside = place + t < self.ends[place]
            following = np.where(inside, self.words[place + t] + 1, 0)
            rank = np.unique(rank * v + following, return_inverse=True)[1]
        levels = [rank]  # the ranks by COVER words, twice that, and so on
        while m and rank.max() + 1 < m:
            later = place + (COVER << (len(levels) - 1))
            inside = later < self.ends[place]
            after = np.where(inside, rank[at[np.minimum(later, n)]] + 1, 0)
            rank = np.unique(rank * (m + 1) + after, return_inverse=True)[1]
            levels.append(rank)
        self.rank = np.full(n + COVER, -1)
        order = np.argsort(rank, kind="stable")
        self.rank[place[order]] = np.arange(m)
        self.table = [self._neighbours(place[order], at, levels)]
        while (2 << len(self.table)) <= 2 * m:
            half, last = 1 << (len(self.table) - 1), self.table[-1]
            self.table.append(np.minimum(last[:-half], last[half:]))

    def _neighbours(self, order: np.ndarray, at: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """How many words each suffix shares with the one before it in order, all pairs at once: equal ranks of the
        longest width that two have are so many equal words, and the rest is found likewise by shorter ones."""
        common = np.zeros(max(len(order), 1), np.int64)
        a, b = order[:-1].copy(), order[1:].copy()
        left = np.where(self.text[a] == self.text[b], np.minimum(self.ends[a] - a, self.ends[b] - b), 0)
        done = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            width = COVER << k
            fits = np.flatnonzero(done + width <= left)
            same = fits[levels[k][at[a[fits] + done[fits]]] == levels[k][at[b[fits] + done[fits]]]]
            done[same] += width
        going = np.ones(len(a), bool)
        for _ in range(COVER - 1):
            going &= done < left
            going[going] = self.words[a[going] + done[going]] == self.words[b[going] + done[going]]
            done += going
        common[1:] = done
        return common

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        step = _STEP[x % COVER, y % COVER]
        most = np.minimum(self.ends[x] - x, self.ends[y] - y)
        agreed = np.zeros(len(x), np.int64)
        going = np.ones(len(x), bool)
        for t in range(COVER - 1):
            going &= (t < step) & (t < most) & (self.words[x + t] == self.words[y + t])
            agreed += going
        on = (agreed == step) & (step < most)
        a, b = self.rank[x[on] + step[on]], self.rank[y[on] + step[on]]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = agreed
        beyond = np.zeros(len(a), np.int64)
        for k in np.unique(level):
            of = level == k
            row = self.table[k]
            beyond[of] = np.minimum(row[low[of]], row[high[of] - (1 << k)])
        out[on] += beyond
        return np.minimum(out, most)


def _probes(words: np.ndarray, text: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(place, period)`` of probes whose first words, COVER or a period of them, equal those a period on.

    Texts stand in order of falling ``lengths``, so the ones long enough for a period come first.
    """
    ends = np.cumsum(lengths)
    places, periods = [], []
    for p in range(1, int(lengths.max(initial=0)) // PERIODS + 1):
        n = int(ends[np.searchsorted(-lengths, -max(PERIODS * p, LEAST), side="right") - 1]) if lengths[0] >= max(PERIODS * p, LEAST) else 0
        if n <= p:
            break
        x = np.flatnonzero(words[:n - p:2 * p] == words[p:n:2 * p]) * (2 * p)
        for t in range(1, min(p, COVER)):
            if not len(x):
                break
            x = x[x + p + t < n]
            x = x[words[x + t] == words[x + p + t]]
        x = x[text[x] == text[x + p]]
        if len(x):
            places.append(x)
            periods.append(np.full(len(x), p))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *places]), np.concatenate([none, *periods])


def find_runs(texts: list[np.ndarray]) -> list[np.ndarray]:
    """The runs of each text of numbered words: rows of start, length, period by start, then period."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    lengths = np.array([len(texts[i]) for i in order], np.int64)
    none = np.zeros((0, 3), np.int64)
    out = [none] * len(texts)
    if not lengths.sum():
        return out
    words, text = np.concatenate([texts[i] for i in order]), np.repeat(np.arange(len(order)), lengths)
    x, p = _probes(words, text, lengths)
    if not len(x):
        return out
    some = np.unique(text[x])  # the others need no sorted suffixes
    took = np.isin(text, some)
    new = np.cumsum(took) - 1
    words, text, x = words[took], text[took], new[x]
    first = np.searchsorted(text, text)
    ahead = CommonExtension(words, text)
    forward = ahead(x, x + p)
    n = len(words)
    behind = CommonExtension(words[::-1], (text[-1] - text)[::-1])
    back = np.zeros(len(x), np.int64)
    inner = x > first[x]
    # the words before x and before x + p, from the right
    back[inner] = behind(n - x[inner], n - (x[inner] + p[inner]))
    start, length = x - back, back + p + forward
    long = length >= np.maximum(LEAST, PERIODS * p)
    start, length, p = start[long], length[long], p[long]
    # a stretch is met with its smallest period and multiples of it, and by several probes
    by = np.lexsort((p, length, start))
    start, length, p = start[by], length[by], p[by]
    if not len(p):
        return out
    once = np.append(True, (start[1:] != start[:-1]) | (length[1:] != length[:-1]))
    start, length, p = start[once], length[once], p[once]
    by = np.lexsort((p, start))
    start, length, p = start[by], length[by], p[by]
    of = text[start]
    rows = np.stack([start - first[start], length, p], axis=1)
    cuts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    for a, z in zip(cuts, [*cuts[1:], len(of)], strict=True):
        out[order[of[a]]] = rows[a:z]
    return out


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a document, with a periodic end in one of ten by its id's crc32; a null id has none."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a:a + p]
    return words[:a] + (unit * ((n - a) // p + 1))[:n - a]


def _numbered(lists: list[list[bytes]]) -> list[np.ndarray]:
    number: dict[bytes, int] = {}
    return [np.fromiter((number.setdefault(w, len(number)) for w in ws), np.int64, len(ws)) for ws in lists]


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words without those that a run repeats: all of a run behind its first period."""
    if not len(runs):
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """doc_id, ``runs`` (array of start, length, period, by start, then period) and ``collapsed``, a row each of ``docs``.

    Words are split at ASCII white space. Null and empty texts have no runs and an empty ``collapsed``; repeated
    rows stay rows of their own; a null id is kept; texts of any length are read whole, one at a time where they are
    long; an empty table gives an empty result; other columns are ignored. Runs of one start go by period, and two
    runs of a text never share start and period. With ``plant`` one document in ten is first given a periodic end.
    """

    def step(ids: list, lists: list[list[bytes]]) -> pa.RecordBatch:
        runs = find_runs(_numbered(lists))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        flat = np.concatenate([np.zeros((0, 3), np.int64), *runs])
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
        values = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)], names=["start", "length", "period"])
        texts = pa.array([b" ".join(collapsed(w, r)) for w, r in zip(lists, runs, strict=True)], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(offsets, values).cast(kind), texts], names=["doc_id", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lists, held = [], [], 0
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = text.as_buffer().to_pybytes().split()
                lists.append(planted(words, doc_id) if plant else words)
                ids.append(doc_id)
                held += len(words)
                if held > STEP_WORDS:
                    yield step(ids, lists)
                    ids, lists, held = [], [], 0
            if ids:
                yield step(ids, lists)

    read = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    return read.mapInArrow(run, "doc_id long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), plant=True)
    longest = F.reduce("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda a, r: F.when(a.isNull() | (r["length"] > a["length"]), r).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    out = found.withColumn("m", longest)
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("m.start").alias("start"), F.col("m.length").alias("length"), F.col("m.period").alias("period"),
                      F.expr("1000 * m.length div m.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
