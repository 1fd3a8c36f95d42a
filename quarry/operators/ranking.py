"""Skew-safe ranking, ntile and exact quantiles.

A plain ``Window.partitionBy(g).orderBy(x)`` sends every row of a group to
one task: a global window (no PARTITION BY) or a group holding a third of
the data becomes a single straggler.  Here the data is range-partitioned
on ``(g, x)`` instead, so a hot group is split across many tasks; each
task ranks its slice locally and a small per-(partition, group) count
table supplies the offsets that turn local positions into global ones.

Equal ``(g, x)`` keys always land in one range partition, so ties never
straddle a boundary and rank / dense_rank stay exact.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quarry.operators.joins import broadcast_if_small
from quarry.session import scratch_path


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where NULL equals NULL, as groups of a SQL window do."""
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(right, cond, how).drop(*[f"_r_{k}" for k in keys])


def _num_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def sorted_rows(df: DataFrame, keys: Sequence[Column], n: int | None = None) -> DataFrame:
    """``df`` range-partitioned and sorted by ``keys``, written with each row's partition ``_pid`` and place in it ``_at``."""
    number = F.monotonically_increasing_id()  # partition in the high bits, place in the low ones
    return _written(df.repartitionByRange(n or _num_partitions(df), *keys).sortWithinPartitions(*keys).withColumn("_pid", F.shiftright(number, 33).cast("int"))
                    .withColumn("_at", number.bitwiseAND(F.lit((1 << 33) - 1))), "sorted-rows")


def ranked(df: DataFrame, order: Sequence[Column], partition_by: Sequence[str] = (),
           row_number: str | None = None, rank: str | None = None, dense_rank: str | None = None,
           ntile: tuple[str, int] | None = None, group_size: str | None = None,
           running: Sequence[tuple[str, str, str]] = (), num_partitions: int | None = None) -> DataFrame:
    """Add global (per ``partition_by`` group) row_number / rank / dense_rank /
    ntile columns without funnelling any group into one task.

    ``order`` must be a total order when ``row_number``, ``ntile`` or
    ``running`` is requested (append a unique key), exactly as with SQL
    windows.  ``running`` holds ``(fn, column, name)`` triples, fn one of
    sum / count / min / max: the ROWS UNBOUNDED PRECEDING .. CURRENT ROW
    aggregate, completed across range partitions by per-(partition, group)
    totals of the earlier partitions.
    """
    part = [F.col(c) for c in partition_by]
    n = num_partitions or _num_partitions(df)
    # The range bounds come from sampling, so two separately planned range
    # exchanges may cut at different keys.  The partition id is therefore
    # assigned once and written: the offsets table and the rows read the
    # same assignment.
    d = sorted_rows(df, [*part, *order], n)
    local = Window.partitionBy("_pid", *partition_by).orderBy(*order)
    if rank or dense_rank:
        d = d.withColumn("_lrk", F.rank().over(local)).withColumn("_ldr", F.dense_rank().over(local))
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fns = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
    carry = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
    for fn, col, name in running:
        d = d.withColumn(f"_lr_{name}", fns[fn](col).over(upto))
    # one row per (range partition, group): size <= #groups + #partitions
    s = d.groupBy("_pid", *partition_by).agg(F.count(F.lit(1)).alias("_cnt"), F.min("_at").alias("_first"),
                                            (F.max("_ldr") if rank or dense_rank else F.lit(0)).alias("_dcnt"),
                                            *[fns[fn](col).alias(f"_pt_{name}") for fn, col, name in running])
    before = Window.partitionBy(*partition_by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*partition_by)
    s = (s.withColumn("_rows_before", F.coalesce(F.sum("_cnt").over(before), F.lit(0)))
          .withColumn("_dist_before", F.coalesce(F.sum("_dcnt").over(before), F.lit(0)))
          .withColumn("_gsize", F.sum("_cnt").over(whole))
          .drop("_cnt", "_dcnt"))
    for fn, col, name in running:
        s = s.withColumn(f"_pb_{name}", carry[fn](f"_pt_{name}").over(before)).drop(f"_pt_{name}")
    d = null_safe_join(d, broadcast_if_small(s), ["_pid", *partition_by])
    # rows of a group are consecutive in a sorted partition, so places count them without a window
    rn = F.col("_rows_before") + F.col("_at") - F.col("_first") + 1
    out = d
    if row_number:
        out = out.withColumn(row_number, rn.cast("int"))
    if rank:
        out = out.withColumn(rank, (F.col("_rows_before") + F.col("_lrk")).cast("int"))
    if dense_rank:
        out = out.withColumn(dense_rank, (F.col("_dist_before") + F.col("_ldr")).cast("int"))
    if ntile:
        name, buckets = ntile
        N = F.col("_gsize")
        q = F.floor(N / buckets)
        rem = N - q * buckets
        big = rem * (q + 1)  # rows living in the first `rem` (larger) buckets
        b = F.when(rn <= big, F.floor((rn - 1) / (q + 1)) + 1).otherwise(rem + F.floor((rn - big - 1) / q) + 1)
        out = out.withColumn(name, b.cast("int"))
    if group_size:
        out = out.withColumn(group_size, F.col("_gsize"))
    for fn, col, name in running:
        loc, prev = F.col(f"_lr_{name}"), F.col(f"_pb_{name}")
        if fn in ("sum", "count"):
            val = F.when(prev.isNull(), loc).when(loc.isNull(), prev).otherwise(loc + prev)
        elif fn == "max":
            val = F.greatest(loc, prev)
        else:
            val = F.least(loc, prev)
        out = out.withColumn(name, val).drop(f"_lr_{name}", f"_pb_{name}")
    return out.drop("_pid", "_at", "_first", "_lrk", "_ldr", "_rows_before", "_dist_before", "_gsize")


def halo_windows(df: DataFrame, order: Sequence[Column], partition_by: Sequence[str], before: int, after: int,
                 columns: Callable[[WindowSpec], dict[str, Column]], block: int = 4096) -> DataFrame:
    """Window columns whose frames reach at most ``before`` rows back and
    ``after`` rows ahead, without a task per group.

    Rows are range-partitioned by (group, order) once and numbered through
    all partitions; every ``block`` consecutive rows are a block, and only the
    rows near its ends are also sent to the neighbouring block.  A plain
    window over (block, group) then sees every frame whole, and a group of
    any size is as many blocks as its rows need.  ``columns`` gives the window
    columns for a window specification; ``order`` must be a total order.
    """
    spark, names = df.sparkSession, df.columns
    block = max(block, 4 * (before + after))
    d = sorted_rows(df, [*[F.col(c) for c in partition_by], *order])
    sizes = sorted((r["_pid"], r["n"]) for r in d.groupBy("_pid").agg(F.count("*").alias("n")).collect())  # one row a partition
    offsets, total = [], 0
    for pid, n in sizes:
        offsets.append((pid, total))
        total += n
    d = d.join(F.broadcast(spark.createDataFrame(offsets, "_pid int, _first long")), "_pid").withColumn("_row", F.col("_first") + F.col("_at"))
    own, place = F.floor(F.col("_row") / block), F.pmod(F.col("_row"), F.lit(block))

    def to(by: int, when: Column) -> Column:
        return F.when(when, F.struct((own + by).alias("_block"), F.lit(by == 0).alias("_own")))

    targets = [to(0, F.lit(True))] + ([to(1, place >= block - before)] if before else []) + ([to(-1, place < after)] if after else [])
    sent = d.select(*names, "_row", F.inline(F.array_compact(F.array(*targets))))
    w = Window.partitionBy("_block", *partition_by).orderBy("_row")
    made = columns(w)
    return sent.select(*names, "_own", *[c.alias(n) for n, c in made.items()]).where("_own").drop("_own")


def shifted(df: DataFrame, order: Sequence[Column], partition_by: Sequence[str],
            shifts: Sequence[tuple[Sequence[str], int, str]]) -> DataFrame:
    """lag (offset > 0) / lead (offset < 0) of columns within each group, NULL
    at the edges: ``shifts`` are (columns, offset, prefix of the new names)."""
    return halo_windows(df, order, partition_by, max([0, *(k for _, k, _ in shifts)]), max([0, *(-k for _, k, _ in shifts)]),
                        lambda w: {f"{prefix}{c}": F.lag(c, k).over(w) for cols, k, prefix in shifts for c in cols})


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], group_by: Sequence[str] = (),
                    names: Sequence[str] | None = None, accuracy: int | None = 10_000) -> DataFrame:
    """Exact, linearly interpolated quantiles (the ``quantile``/``median``
    semantics) by selection in two map-side combined passes.

    The first pass sketches every group's order statistics; the sketch bounds
    each wanted position by two values, some ``4 / accuracy`` of the group's
    rows apart.  The second pass counts the rows below each pair of bounds and
    the distinct values between them, so only those values are sorted.  Should
    a position lie outside its bounds (or ``accuracy`` be None), all distinct
    values are counted instead.

    Returns one row per group (NULL is a group) with one column per probability.
    """
    names = list(names or [f"p{int(round(p * 100)):02d}" for p in probs])
    v = df.where(F.col(value).isNotNull()).select(*group_by, F.col(value).cast("double").alias("_v"))
    if accuracy:
        margin = 2.0 / accuracy
        marks = F.percentile_approx("_v", [x for p in probs for x in (max(0.0, p - margin), min(1.0, p + margin))], accuracy)
    else:
        marks = F.array(*[F.min("_v"), F.max("_v")] * len(probs))
    bounds = _written(v.groupBy(*group_by).agg(F.count(F.lit(1)).alias("_n"), marks.alias("_q")), "quantile-bounds")
    j = null_safe_join(v, broadcast_if_small(bounds), group_by)
    inside, below = F.lit(False), []
    for i in range(len(probs)):
        low, high = F.element_at("_q", 2 * i + 1), F.element_at("_q", 2 * i + 2)
        inside = inside | F.col("_v").between(low, high)
        below.append(F.sum(F.when(F.col("_v") < low, F.lit(1)).otherwise(F.lit(0))).alias(f"_b{i}"))
    counts = _written(j.groupBy(*group_by, F.when(inside, F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_c"), *below), "quantile-counts")
    sums = counts.groupBy(*group_by).agg(*[F.sum(f"_b{i}").alias(f"_b{i}") for i in range(len(probs))],
                                         *[F.sum(F.when(F.col("_v").isNotNull(), F.col(f"_b{i}")).otherwise(F.lit(0))).alias(f"_i{i}") for i in range(len(probs))])
    upto = ranked(counts.where(F.col("_v").isNotNull()).select(*group_by, "_v", "_c"), [F.col("_v")], group_by, running=[("sum", "_c", "_upto")])
    upto = null_safe_join(null_safe_join(upto, broadcast_if_small(sums), group_by), broadcast_if_small(bounds), group_by)

    def value_at(i: int, pos: Column) -> Column:
        # rank of a value between the bounds: all rows below them, and those counted from them on
        rank = F.col(f"_b{i}") + F.col("_upto") - F.col(f"_i{i}")
        return F.min(F.when((F.col("_v") >= F.element_at("_q", 2 * i + 1)) & (rank >= pos), F.col("_v")))

    sides, sound = [], F.lit(True)
    for i, p in enumerate(probs):
        h = F.lit(float(p)) * (F.col("_n") - 1)
        first, last = F.floor(h) + 1, F.ceil(h) + 1
        sides += [value_at(i, first).alias(f"_lo{i}"), value_at(i, last).alias(f"_hi{i}"), F.max(F.col(f"_b{i}") < first).alias(f"_ok{i}")]
        sound = sound & F.col(f"_ok{i}") & (F.col(f"_lo{i}") <= F.element_at("_q", 2 * i + 2)) & (F.col(f"_hi{i}") <= F.element_at("_q", 2 * i + 2))
    q = _written(upto.groupBy(*group_by).agg(*sides, F.max("_n").alias("_n"), F.first("_q").alias("_q")), "quantiles")
    if accuracy and not q.where(~F.coalesce(sound, F.lit(False))).isEmpty():
        return exact_quantiles(df, value, probs, group_by, names, None)
    frac = [F.lit(float(p)) * (F.col("_n") - 1) - F.floor(F.lit(float(p)) * (F.col("_n") - 1)) for p in probs]
    return q.select(*group_by, *[(F.col(f"_lo{i}") + frac[i] * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))).alias(nm) for i, nm in enumerate(names)])


def moving_frame(df: DataFrame, order: Sequence[Column], partition_by: Sequence[str], value: str,
                 lo: int, hi: int, keep: Sequence[str], out: str, fn: str = "avg") -> DataFrame:
    """``fn(value) OVER (PARTITION BY … ORDER BY … ROWS BETWEEN lo AND hi)``
    (lo <= hi <= 0); returns the group columns, ``value``, ``keep`` and ``out``."""
    agg = {"avg": F.avg, "sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[fn](value)
    # ``keep`` may lack columns that only ``order`` uses, so all columns go through the window
    r = halo_windows(df, order, partition_by, -lo, 0, lambda w: {out: agg.over(w.rowsBetween(lo, hi))})
    return r.select(*partition_by, value, *keep, out)
