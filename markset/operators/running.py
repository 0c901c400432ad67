"""Running sums and maxima over a global order without a single-task window."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from markset.session import materialize

#: Up to this many (already aggregated) rows, one window per group is the cheaper plan.
PLAIN_LIMIT = 400_000

_OF_TWO = {"max": F.greatest, "min": F.least}


def ranged(df: DataFrame, by: list[str], order: str, descending: bool = False, parts: int | None = None) -> DataFrame:
    """``df``, written once, with ``_range``: which part of the order over ``by`` and ``order`` a row stands in.

    Parts are cut by a sample of the rows themselves, so they are about equally large whatever a group holds and
    however close its values lie; a long group has as many parts as its share of the rows, a short one is in one or
    two. Rows of one place are in one part. Parts are numbered along the order.
    """
    keys = [*[F.col(c) for c in by], F.col(order).desc() if descending else F.col(order).asc()]
    return materialize(df.repartitionByRange(*([parts] if parts else []), *keys).withColumn("_range", F.spark_partition_id()), "ranges")


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, null with null; the keys and other columns of ``left``, then the other columns of ``right``."""
    names = {k: f"_same_{k}" for k in keys}
    on = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    return left.join(right.withColumnsRenamed(names), on, how).drop(*names.values())


def running(df: DataFrame, by: list[str], order: str, aggs: dict[str, tuple[str, str]], descending: bool = False,
            plain_limit: int = PLAIN_LIMIT) -> DataFrame:
    """Add running aggregates ``{out: ("sum" | "max" | "min", column)}`` over ``order`` within ``by``.

    Rows must be aggregated to one per ``(by, order)``. Short groups use one window each. Where a group is long,
    all are cut into ranges: totals, a row a group and range that it stands in, give each range its starting value,
    and the windows run inside the ranges.
    """
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    # the longest group decides: a plain window holds one group per task
    n = (df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0) if by else df.count()
    direction = F.col(order).desc() if descending else F.col(order).asc()

    def apply(frame, window, names):
        for out, (how, column) in names.items():
            frame = frame.withColumn(out, getattr(F, how)(column).over(window))
        return frame

    if n <= plain_limit:
        keys = by or [F.lit(0)]
        return apply(df, Window.partitionBy(*keys).orderBy(direction).rowsBetween(Window.unboundedPreceding, 0), aggs)
    parts = ranged(df, by, order, descending)
    df.unpersist()
    totals = parts.groupBy(*by, "_range").agg(*[getattr(F, how)(col).alias(out) for out, (how, col) in aggs.items()])
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*by, "_range", *[getattr(F, how)(out).over(before).alias(f"_s_{out}")
                                            for out, (how, _) in aggs.items()])
    inside = Window.partitionBy(*by, "_range").orderBy(direction).rowsBetween(Window.unboundedPreceding, 0)
    out = join_same(apply(parts, inside, aggs), starts, [*by, "_range"])
    for name, (how, _) in aggs.items():
        start = F.col(f"_s_{name}")
        out = out.withColumn(name, F.when(start.isNull(), F.col(name)).otherwise(
            F.coalesce(F.col(name), F.lit(0)) + start if how == "sum" else _OF_TWO[how](F.col(name), start))).drop(f"_s_{name}")
    return out.drop("_range")


def spread_rank(df: DataFrame, keys: list[str], order: str, out: str = "rank", parts: int | None = None) -> DataFrame:
    """Number the rows of each key from 1 without gathering a hot key in one task.

    Rows of a key are dealt to ``parts`` slices by hash, twice as many as there are shuffle partitions but 64 at least;
    each slice is numbered on its own and shifted by the size of the slices before it. The numbering is
    deterministic for a number of slices, though it follows slice, then ``order``.
    """
    parts = parts or max(64, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sliced = df.withColumn("_slice", F.pmod(F.xxhash64(order), F.lit(parts)))
    sizes = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*keys, "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy(*keys, "_slice").orderBy(order)
    return (sliced.join(sizes, [*keys, "_slice"])
            .withColumn(out, F.row_number().over(inside) + F.col("_shift")).drop("_slice", "_shift"))


def previous(df: DataFrame, by: list[str], order: str, value: str, out: str, slices: int | None = None) -> DataFrame:
    """``value`` of the row before, by ``order`` within ``by``, as column ``out``.

    The order is cut into ranges so that a key holding much of the data is not
    one window, into ``slices`` if given: rows look back inside their range, and the first row of a range
    takes the last value of the range before it that its key stands in.
    """
    parts = ranged(df, by, order, parts=slices)
    w = Window.partitionBy(*by, "_range").orderBy(order)
    last = parts.groupBy(*by, "_range").agg(F.max_by(F.struct(value), order).alias("_last"))
    carried = last.select(*by, "_range", F.lag("_last").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("_range")).alias("_carry"))
    inside = F.lag(F.struct(value)).over(w)
    return (join_same(parts.withColumn("_before", inside), carried, [*by, "_range"])
            .withColumn(out, F.coalesce("_before", "_carry")[value]).drop("_range", "_before", "_carry"))


def percentiles(df: DataFrame, by: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """Exact percentiles with linear interpolation, ``{out: share}``, per ``by``.

    Works on one row per distinct value with running counts, so a group holding
    much of the data is never one aggregation buffer.
    """
    steps = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    run = running(steps, by, value, {"_cum": ("sum", "_n")})
    total = run.groupBy(*by).agg(F.max("_cum").alias("_total"))
    # without groups the totals are one row
    j = run.join(total.hint("merge"), by) if by else run.join(F.broadcast(total))
    aggs = []
    for out, q in wanted.items():
        at = (F.col("_total") - 1) * F.lit(float(q))
        low = F.floor(at)
        high = F.least(low + 1, F.col("_total") - 1)
        aggs += [F.min(F.when(F.col("_cum") > low, F.col(value))).alias(f"_l_{out}"), F.min(F.when(F.col("_cum") > high, F.col(value))).alias(f"_h_{out}"),
                 F.max(at - low).alias(f"_f_{out}")]
    cols = [(F.col(f"_l_{o}") + (F.col(f"_h_{o}") - F.col(f"_l_{o}")) * F.col(f"_f_{o}")).alias(o) for o in wanted]
    return j.groupBy(*by).agg(*aggs, F.max("_total").alias("n")).select(*by, "n", *cols)


def number_rows(df: DataFrame, by: list[str], order: str, out: str) -> DataFrame:
    """Position of every row, from 1, by the unique ``order`` within ``by``."""
    return running(df.withColumn("_one", F.lit(1)), by, order, {out: ("sum", "_one")}).drop("_one")


def dense_ids(df: DataFrame, order: list[str], out: str, keep: list[str] | None = None) -> DataFrame:
    """Ids 1, 2, 3, ... over the whole table in ``order``, without a global window; of the columns only ``keep`` where given.

    Rows are range-partitioned once and written in order with their range and their place in
    it; the places are shifted by the sizes of the ranges before.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the lower 33 bits count the rows of a partition
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = materialize(ranged.select(*(keep or ["*"]), F.spark_partition_id().alias("_p"), (place + 1).alias("_at")), "ranges")
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    # one row per range: at most as many as shuffle partitions
    before = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    return ranged.join(F.broadcast(shifts), "_p").withColumn(out, F.col("_at") + F.col("_shift")).drop("_p", "_at", "_shift")
