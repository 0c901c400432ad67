"""N-gram Jaccard join by a size-aware heavy-light split.

A text is its set of word shingles. Two sets link when 100 * intersection >= 80 * union, that is when
they share at least ``overlap(n + m)`` of their n and m shingles. Small sets list all their subsets of
that fixed size, and linked ones share one. Large sets are entered in inverted lists: a set is cut in
more blocks, by ranges of hashes, than two linked sets can have differing shingles, so linked sets agree
in a whole block, and a list is keyed by a block's content; single shingles would give a passage that a
third of all documents share a list of that length. The boundary is where listing subsets costs more.

Every pair that meets in a list is either compared exactly or already joined by compared pairs: first
each set with one list's first member, then with the first members of its other lists where they are not
in its component yet, then members of different components with each other, in the list's own task, which
gives out the links that unite components only. Sketches of the sets rule most pairs that do not link out
beforehand. So what a list gives out grows with its members, never with their pairs.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from markset.llm.common import stored, table
from markset.operators.graph import connected_components

SHINGLE = 5
#: Scanning and checking a list entry costs about so many times as much as listing a subset.
SCAN_COST = 4
#: Sizes up to which subsets are considered at all.
MOST_LIGHT = 16
#: A sketch has two to this power bits at most.
MOST_BITS = 16
#: Members of a list that are compared with each other at a time, and shingles that they have on average at most.
TOGETHER, SHINGLES_EACH = 2048, 1000
#: Up to so many ids of documents with candidates go to every task; more are joined by a shuffle.
SENT = 2_000_000

_MULTIPLIERS = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(SHINGLE + 1)]


def _mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Spread 64-bit numbers evenly."""
    x = (x ^ np.uint64(salt & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles; all words are one shingle where there are fewer than ``size``."""
    words = (text or "").encode().lower().split()  # bytes: A-Z alone fold, six characters part words
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    k = min(size, n)
    total = sum(w[i:n - k + 1 + i] * _MULTIPLIERS[i + 1] for i in range(k))
    return np.unique(_mix(total, k))


def overlap(total: int) -> int:
    """Least intersection of two linked sets whose sizes add up to ``total``: 9 i >= 4 (n + m)."""
    return -(-4 * total // 9)


def partners(n: int) -> range:
    """Sizes that a set linked with one of ``n`` can have."""
    return range(-(-4 * n // 5), 5 * n // 4 + 1)


def _level(total: int) -> int:
    return max(0, math.ceil(math.log2(total / 20)))


def _levels(sizes: range, n: int) -> list[tuple[int, int, int]]:
    """``(level, blocks, most differing shingles)`` for a set of ``n`` against partners of these sizes.

    Levels are doubling ranges of n + m, so that both sides of a pair cut their hashes alike.
    """
    out: dict[int, int] = {}
    for m in (sizes[0], sizes[-1], *(s - n for lv in range(_level(n + sizes[0]), _level(n + sizes[-1])) if (s := 20 << lv) - n in sizes)):
        differ = n + m - 2 * overlap(n + m)
        out[_level(n + m)] = max(out.get(_level(n + m), 0), differ, (n + m) // 9)
    return [(lv, (20 << lv) * 11 // 90 + 2, d) for lv, d in sorted(out.items())]


@functools.lru_cache(maxsize=4096)
def _subsets(n: int, k: int) -> np.ndarray:
    return np.array(list(itertools.combinations(range(n), k)), np.int64).reshape(-1, k)


def light_sizes(n: int, boundary: int) -> list[int]:
    """Sizes of the subsets that a set of ``n`` lists."""
    return sorted({overlap(n + m) for m in partners(n) if m <= boundary}) if n <= boundary else []


def list_keys(s: np.ndarray, boundary: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all lists that a set stands in. Two sets of up to ``boundary`` shingles meet in a subset, others in a block.

    Beside each key stands a tag: which cut it is of, above the number of that cut's lists that the set can do
    without. Linked sets agree in more blocks than that, so they still meet when each leaves that many of its
    longest lists.
    """
    n = len(s)
    spread = _mix(s, 1)
    keys = [_mix(spread[_subsets(n, k)].sum(1, dtype=np.uint64), 2 + k) for k in light_sizes(n, boundary)]
    tags = [np.zeros(len(k), np.int32) for k in keys]
    large = [m for m in partners(n) if n > boundary or m > boundary]
    for level, blocks, differ in _levels(range(large[0], large[-1] + 1), n) if large else []:
        while True:
            block = ((s >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
            first = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            sums = np.add.reduceat(spread, first) + block[first] * _MULTIPLIERS[1]
            keys.append(_mix(sums, (level + 1) << 40 | blocks))
            # linked sets agree in a block that isn't empty if either has more of those than can differ
            spare = min(max(len(first) - differ - 1, 0), 0xFFFF)
            tags.append(np.full(len(first), (level + 1) << 16 | spare, np.int32))
            if len(first) > differ:
                break
            blocks *= 2
    return (np.concatenate(keys), np.concatenate(tags)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int32))


def choose_boundary(histogram: dict[int, int]) -> int:
    """The size up to which listing subsets is cheaper over all sets than scanning lists of blocks."""
    light = lambda n, x: sum(math.comb(n, k) for k in light_sizes(n, x))
    heavy = lambda n: SCAN_COST * sum(b for _, b, _ in _levels(partners(n), n))
    cost = lambda x: sum(c * (light(n, x) if n <= x else heavy(n)) for n, c in histogram.items() if n <= MOST_LIGHT)
    return min(range(MOST_LIGHT + 1), key=lambda x: (cost(x), x))


def _node(s: np.ndarray) -> int | None:
    """Number of a set: a hash of its content, null for the empty one."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None


def sketch(s: np.ndarray) -> bytes:
    """Which of some buckets of hashes a set has members in, a bit each: eight or more buckets a shingle, a power of two."""
    bits = min(max(8, math.ceil(math.log2(8 * max(len(s), 1)))), MOST_BITS)
    mask = np.zeros(1 << bits, bool)
    mask[s & np.uint64((1 << bits) - 1)] = True
    return np.packbits(mask).tobytes()


def _folded(words: np.ndarray, width: int) -> np.ndarray:
    """Sketches of fewer buckets, ``width`` words a row."""
    return np.bitwise_or.reduce(words.reshape(len(words), -1, width), axis=1)


def _words(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words, all folded to the coarsest among them."""
    least = min(map(len, sketches)) // 8
    return np.concatenate([_folded(np.frombuffer(b, np.uint64)[None, :], least) for b in sketches])


def may_link(n: int | np.ndarray, x: np.ndarray, m: np.ndarray, y: np.ndarray) -> np.ndarray:
    """False where sketches prove two sets apart: a bucket that only one of them is in has a shingle of its own."""
    own = np.bitwise_count(x & ~y).sum(-1).astype(np.int64)
    others = np.bitwise_count(y & ~x).sum(-1).astype(np.int64)
    return 9 * np.minimum(n - own, m - others) >= 4 * (n + m)


def set_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, the node of its set and the set's sketch for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = map(shingle_set, b.column(1).to_pylist())
            n, node, mask = zip(*((len(s), _node(s), sketch(s)) for s in sets), strict=True) if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(mask, pa.binary())],
                                             names=["doc_id", "n_shingles", "node", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, node long, sketch binary")


def _entries(docs: DataFrame, boundary: int) -> DataFrame:
    """``(key, node, tag)`` of every set and list. A task enters copies of a text once."""
    names = ["key", "node", "tag"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int | None] = {None}
        for b in batches:
            out, held = [], 0
            for t in b.column(0).to_pylist():
                s = shingle_set(t)
                node = _node(s)
                if node in seen:
                    continue
                seen.add(node)
                k, tags = list_keys(s, boundary)
                out.append((k.view(np.int64), np.full(len(k), node, np.int64), tags))
                held += len(k)
                if held > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=names)
                    out, held = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=names)

    return docs.select("text").mapInArrow(run, "key long, node long, tag int")


def _shared(entries: DataFrame) -> DataFrame:
    """The entries of lists with two sets or more, once each.

    A partition is sorted by key and node and read as a stream, so a list may be of any length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, other = None, False  # the last entry, not given out yet, and whether another of its list stands before
        for b in batches:
            rows = [c.to_numpy() for c in b.columns]
            if held is not None:
                rows = [np.append(h, c) for h, c in zip(held, rows, strict=True)]
            key, node, _ = rows
            if not len(key):
                continue
            once = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))  # tasks may have entered copies
            rows = [c[once] for c in rows]
            same = rows[0][1:] == rows[0][:-1]
            before = np.append(other, same)
            give = (before | np.append(same, False))[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(c[:-1][give]) for c in rows], names=["key", "node", "tag"])
            held, other = [c[-1:] for c in rows], bool(before[-1])
        if other:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], names=["key", "node", "tag"])

    return entries.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "key long, node long, tag int")


def _lists(entries: DataFrame) -> DataFrame:
    """``(key, node)`` of the lists that sets meet in: each set leaves its longest lists, as many as it can do without."""
    shared = stored(_shared(entries), "entries")
    length = shared.groupBy("key").agg(F.count(F.lit(1)).alias("length"))
    order = Window.partitionBy("node", "tag").orderBy(F.desc("length"), "key")
    kept = shared.join(length, "key").withColumn("_r", F.row_number().over(order)).where(F.col("_r") > F.col("tag").bitwiseAND(0xFFFF))
    return kept.select("key", "node").distinct()


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(node, content)`` of the nodes in ``wanted(node, doc_id)``, where doc_id names a document that has it."""
    ids = wanted.select(F.col("doc_id").alias("_id")).distinct()
    ids = F.broadcast(ids) if ids.count() <= SENT else ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [s for t in b.column(0).to_pylist() if len(s := shingle_set(t))]
            yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "content"])

    some = docs.join(ids, docs["doc_id"].eqNullSafe(ids["_id"]), "left_semi").select("text")
    return some.mapInArrow(run, "node long, content binary").join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _linked(pairs: DataFrame, live: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of ``pairs(src, dst)`` whose sets link, by exact comparison, stored."""
    pairs = stored(pairs, "pairs")
    ends = pairs.select(F.col("src").alias("node")).unionByName(pairs.select(F.col("dst").alias("node"))).distinct()
    sets = stored(_sets(docs, live.select("node", "doc_id").join(ends, "node", "left_semi")), "sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            src, dst, good = b.column(0), b.column(1), []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                good.append(100 * shared >= 80 * (len(both) - shared))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([src.filter(keep), dst.filter(keep)], names=["src", "dst"])

    a = sets.select(F.col("node").alias("src"), F.col("content").alias("_x"))
    b = sets.select(F.col("node").alias("dst"), F.col("content").alias("_y"))
    return stored(pairs.join(a, "src").join(b, "dst").select("src", "dst", "_x", "_y").mapInArrow(run, "src long, dst long"), "links")


def join_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id per row of ``docs(doc_id, text)``.

    Null and empty texts have no shingles and link with nothing; texts with equal sets link whatever their
    ids; repeated rows stay rows of their own; an id that is null counts only where no other is in the
    component; an empty table gives an empty result; other columns are ignored. Nodes are 64-bit hashes of
    sets, so of n distinct sets two are taken for one with probability n * n / 2 ** 65.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    sized = stored(set_sizes(docs), "sizes")
    histogram = {r["n_shingles"]: r["count"] for r in sized.where(F.col("n_shingles").between(1, MOST_LIGHT)).groupBy("n_shingles").count().collect()}
    lists = stored(_lists(_entries(docs, choose_boundary(histogram))), "lists")
    nodes = sized.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    live = (sized.join(lists.select("node").distinct(), "node", "left_semi").groupBy("node")
            .agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"), F.max("sketch").alias("sketch")))
    live = stored(live, "live")
    leaders = lists.groupBy("key").agg(F.min("node").alias("leader"))
    met = lists.join(leaders, "key").where("node <> leader").groupBy(F.col("leader").alias("src"), F.col("node").alias("dst")).agg(F.count(F.lit(1)).alias("times"))
    star = stored(_possible(met, live), "star")
    # first each set with the leader it meets in most lists; most families are one component after that
    best = star.groupBy("dst").agg(F.max(F.struct("times", "src")).alias("_m")).select(F.col("_m.src").alias("src"), "dst")
    part = connected_components(_linked(best, live, docs))
    rest = _apart(star.select("src", "dst").join(best, ["src", "dst"], "left_anti"), part)
    part = connected_components(_joined(part).unionByName(_linked(rest, live, docs)))
    whole = connected_components(_joined(part).unionByName(_across(lists, live, part, docs)))
    least = whole.join(nodes, "node").groupBy("component").agg(F.min("doc_id").alias("least"))
    named = nodes.join(whole, "node", "left").join(least, "component", "left").select("node", F.coalesce("least", "doc_id").alias("component_id"))
    return sized.join(named, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _joined(part: DataFrame) -> DataFrame:
    return part.select(F.col("node").alias("src"), F.col("component").alias("dst"))


def _possible(pairs: DataFrame, live: DataFrame) -> DataFrame:
    """Those of ``pairs(src, dst, times)`` that their sizes and sketches do not prove apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = b.column(3).to_numpy(), b.column(4).to_numpy()
            good = []
            for i, (x, y) in enumerate(zip(b.column(5).to_pylist(), b.column(6).to_pylist(), strict=True)):
                w = _words([x, y])
                good.append(bool(may_link(n[i], w[0], m[i], w[1])))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in b.columns[:3]], names=["src", "dst", "times"])

    a = live.select(F.col("node").alias("src"), F.col("n").alias("_n"), F.col("sketch").alias("_x"))
    b = live.select(F.col("node").alias("dst"), F.col("n").alias("_m"), F.col("sketch").alias("_y"))
    both = pairs.join(a, "src").join(b, "dst").where(5 * F.least("_n", "_m") >= 4 * F.greatest("_n", "_m"))
    return both.select("src", "dst", "times", "_n", "_m", "_x", "_y").mapInArrow(run, "src long, dst long, times long")


def _apart(pairs: DataFrame, part: DataFrame) -> DataFrame:
    """Those of ``pairs(src, dst)`` whose ends are in different components."""
    a = part.select(F.col("node").alias("src"), F.col("component").alias("_a"))
    b = part.select(F.col("node").alias("dst"), F.col("component").alias("_b"))
    both = pairs.join(a, "src", "left").join(b, "dst", "left")
    return both.where(F.coalesce("_a", "src") != F.coalesce("_b", "dst")).select("src", "dst")


def _across(lists: DataFrame, live: DataFrame, part: DataFrame, docs: DataFrame) -> DataFrame:
    """Links ``(src, dst)`` that join the different components met in a list, as few as join them.

    A task reads one list at a time; a long list is dealt into chunks by hash, and two chunks meet at a time. Sizes
    and sketches first say which members may link with another component at all: at most all members of the list
    go on. Those meet once more with their sets, are compared exactly where they are not united yet, and unite; a
    link is given out where it unites, so at most one a member, whatever the pairs.
    """
    member = live.join(part, "node", "left").select("node", "n", "sketch", F.coalesce("component", "node").alias("component"))
    within = lists.join(member.select("node", "n", "component"), "node")
    split = within.groupBy("key").agg(F.min("component").alias("_a"), F.max("component").alias("_b"), F.count(F.lit(1)).alias("length"), F.sum("n").alias("shingles")).where("_a <> _b")
    chunks = F.greatest(F.ceil(F.col("length") / TOGETHER), F.ceil(F.col("shingles") / (TOGETHER * SHINGLES_EACH)))
    open_ = lists.join(split.select("key", chunks.alias("chunks")), "key")
    open_ = open_.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    dealt = open_.withColumn("_o", other).select("key", "node", "chunk", F.least("chunk", "_o").alias("low"), F.greatest("chunk", "_o").alias("high"))
    columns = ["key", "low", "high", "node", "chunk", "n", "component", "sketch"]

    def partners_of(rows: dict[str, np.ndarray], sketches: list[bytes], root: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each member with the later ones of other roots that sizes and sketches do not prove apart. Roots may change meanwhile."""
        words, n, chunk = _words(sketches), rows["n"], rows["chunk"]
        coarse = _folded(words, max(words.shape[1] // 8, 1))
        two = rows["low"][0] != rows["high"][0]
        for i in range(len(n) - 1):
            later = slice(i + 1, None)
            ok = (root[later] != root[i]) & (5 * np.minimum(n[i], n[later]) >= 4 * np.maximum(n[i], n[later]))
            if two:  # pairs within a chunk meet where it stands alone
                ok &= chunk[later] != chunk[i]
            at = np.flatnonzero(ok) + i + 1
            for w in (coarse, words):
                at = at[may_link(n[i], w[i], n[at], w[at])]
            if len(at):
                yield i, at

    def near(group: pa.Table) -> pa.RecordBatch:
        rows = {c: group.column(c).to_numpy() for c in columns[:-1]}
        marked = np.zeros(group.num_rows, bool)
        for i, at in partners_of(rows, group.column("sketch").to_pylist(), rows["component"]):
            marked[i] = True
            marked[at] = True
        return pa.RecordBatch.from_arrays([pa.array(rows[c][marked]) for c in ("key", "low", "high", "node", "chunk")], names=["key", "low", "high", "node", "chunk"])

    def uniting(group: pa.Table) -> pa.RecordBatch:
        rows = {c: group.column(c).to_numpy() for c in columns[:-1]}
        sets = [np.frombuffer(b, np.uint64) for b in group.column("content").to_pylist()]
        root, node, src, dst = rows["component"].copy(), rows["node"], [], []
        for i, at in partners_of(rows, group.column("sketch").to_pylist(), root):
            for j in at[_links_with(sets[i], [sets[j] for j in at])]:
                if root[j] != root[i]:
                    src.append(node[i])
                    dst.append(node[j])
                    root[root == root[j]] = root[i]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (src, dst)], names=["src", "dst"])

    together = dealt.join(member, "node").select(*columns)
    near_ones = stored(_by_list(together, near, "key long, low long, high long, node long, chunk long"), "near")
    sets = stored(_sets(docs, live.select("node", "doc_id").join(near_ones.select("node").distinct(), "node", "left_semi")), "sets")
    again = near_ones.join(member, "node").select(*columns).join(sets, "node").select(*columns, "content")
    return stored(_by_list(again, uniting, "src long, dst long"), "uniting")


def _by_list(df: DataFrame, of_group: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """What ``of_group`` makes of the rows of each ``(key, low, high)``, one group in memory at a time."""
    groups = ["key", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([*held, b])
            keys = np.stack([t.column(c).to_numpy() for c in groups])
            starts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1)]
            for a, z in zip(starts, starts[1:], strict=False):
                if z - a > 1:
                    yield of_group(t.slice(a, z - a))
            held = t.slice(starts[-1]).to_batches()
        if held:
            yield of_group(pa.Table.from_batches(held))

    return df.repartition(*groups).sortWithinPartitions(*groups).mapInArrow(run, schema)


def _links_with(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which of some sets link with ``x``, exactly. Sets are sorted."""
    lens = np.fromiter(map(len, others), np.int64, len(others))
    all_ = np.concatenate(others)
    hit = x[np.minimum(np.searchsorted(x, all_), len(x) - 1)] == all_
    shared = np.add.reduceat(hit.astype(np.int64), np.cumsum(lens) - lens)
    return 100 * shared >= 80 * (len(x) + lens - shared)


def one_per_component(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents whose component has one of smaller id; all columns are kept.

    Rows that share an id are one document: it goes only if none of them leads its component, and where it stays
    one row of each text stays. Documents without shingles stay.
    """
    found = join_components(docs).where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max((F.col("component_id") == F.col("doc_id")).cast("int")).alias("leads"), F.count(F.lit(1)).alias("rows"))
    found = stored(found.where("leads = 0 or rows > 1"), "not-leading")
    gone = found.where("leads = 0").select(F.col("doc_id").alias("_id"))
    again = found.where("leads = 1 and rows > 1").select(F.col("doc_id").alias("_id"))
    gone, again = (F.broadcast(x) if x.count() <= SENT else x for x in (gone, again))
    kept = docs.join(gone, F.col("doc_id") == F.col("_id"), "left_anti")
    twice = kept.join(again, F.col("doc_id") == F.col("_id"), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, F.col("doc_id") == F.col("_id"), "left_anti").unionByName(twice)


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents"))


#: The same components by joining all shingles, for DuckDB.
OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id, doc_id AS other FROM s UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.other) AS component_id FROM s JOIN reach r ON s.doc_id = r.doc_id GROUP BY s.doc_id, len(s.s)
"""
