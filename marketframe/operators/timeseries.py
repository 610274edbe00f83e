"""Time-series building blocks: as-of joins, frames, runs, episodes, thinning, ranks.

Every window is partitioned by the caller's keys; where a key may be hot, the
as-of joins split its time axis into buckets and carry the last value of earlier
buckets in, so that no task holds a whole key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketframe.operators.running import DAY, running
from marketframe.operators.saved import saved


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, values: Sequence[str], forward: bool = False, bucket: int | None = None) -> DataFrame:
    """For each row of ``left`` the ``values`` of the last row of ``right`` at or before it
    (forward: the first at or after it), by equal ``by`` keys; nulls where there is none.

    Rows of ``right`` with equal keys and time must agree on which comes last: they
    are ordered by their values.  With ``bucket`` (in the unit of ``on``) windows
    are cut into buckets of time; a bucket's neighbours hand over one row each.
    """
    by = list(by)
    value = F.struct(*[F.col(v) for v in values])
    kind = right.select(value.alias("v")).schema["v"].dataType
    r = right.select(*by, F.col(on).alias("asof_at"), F.lit(0).alias("asof_side"), value.alias("asof_value"), F.lit(None).cast(left.select(F.struct("*").alias("s")).schema["s"].dataType).alias("asof_row"))
    l_ = left.select(*by, F.col(on).alias("asof_at"), F.lit(1).alias("asof_side"), F.lit(None).cast(kind).alias("asof_value"), F.struct("*").alias("asof_row"))
    sign = -1 if forward else 1
    both = r.union(l_).withColumn("asof_order", F.col("asof_at") * sign)
    keys = [F.col(c) for c in by]
    if bucket:
        both = both.withColumn("asof_bucket", F.floor(F.col("asof_order") / bucket))
        ends = both.where("asof_side = 0").groupBy(*by, "asof_bucket").agg(F.max(F.struct("asof_order", "asof_value")).alias("last"))
        carry = Window.partitionBy(*by).orderBy("asof_bucket").rowsBetween(Window.unboundedPreceding, -1)
        starts = both.select(*by, "asof_bucket").distinct().join(ends, [*by, "asof_bucket"], "left").withColumn("carry", F.last("last.asof_value", ignorenulls=True).over(carry)).select(*by, "asof_bucket", "carry")
        keys.append(F.col("asof_bucket"))
    inside = Window.partitionBy(*keys).orderBy("asof_order", "asof_side", "asof_value").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("asof_found", F.last("asof_value", ignorenulls=True).over(inside)).where("asof_side = 1")
    if bucket:
        found = found.join(starts, [*by, "asof_bucket"], "left").withColumn("asof_found", F.coalesce("asof_found", "carry"))
    return found.select("asof_row.*", *[F.col(f"asof_found.{v}").alias(v) for v in values])


def trailing(value: Column, by: Sequence[str], index: str, width: int, how: str) -> Column:
    """sum, mean, std (population) or count over the last ``width`` steps of a dense index; nulls don't count.
    Sums read missing as 0 and are null before step width - 1; std is null before step width."""
    w = Window.partitionBy(*by).orderBy(index).rangeBetween(-(width - 1), 0)
    ready = F.col(index) >= (width if how == "std" else width - 1)
    made = {"sum": F.coalesce(F.sum(value).over(w), F.lit(0.0)), "mean": F.avg(value).over(w), "std": F.stddev_pop(value).over(w), "count": F.count(value).over(w), "max": F.max(value).over(w)}[how]
    return F.when(ready, made)


def strict_sum(value: Column, by: Sequence[str], index: str, width: int) -> Column:
    """A trailing sum that is null unless at least width - 1 values are there."""
    w = Window.partitionBy(*by).orderBy(index).rangeBetween(-(width - 1), 0)
    return F.when((F.col(index) >= width - 1) & (F.count(value).over(w) >= width - 1), F.sum(value).over(w))


def run_lengths(df: DataFrame, good: str, by: Sequence[str], index: str, name: str = "run") -> DataFrame:
    """``df`` with the column ``name``: the length of the run of consecutive good steps that ends here."""
    order = Window.partitionBy(*by).orderBy(index)
    gap = F.col(index) - F.lag(index).over(order) > 1
    marked = df.withColumn("_gap", F.coalesce(gap, F.lit(False)))
    island = F.sum(F.when(~F.col(good), 1).when(F.col("_gap"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    with_island = marked.withColumn("_island", island)
    counted = F.sum(F.col(good).cast("int")).over(Window.partitionBy(*by, "_island").orderBy(index).rowsBetween(Window.unboundedPreceding, 0))
    return with_island.withColumn(name, F.when(F.col(good), counted).otherwise(0)).drop("_gap", "_island")


def average_rank(value: Column, by: Sequence[str | Column]) -> Column:
    """Ranks from 1, ties sharing their mean."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2


def correlation(a: str, b: str) -> Column:
    """Pearson's, null for a constant side (the built-in fails on it in ANSI mode)."""
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.covar_pop(a, b) / F.when(spread > 0, spread)


def counted_rank(rows: DataFrame, value: str, by: Sequence[str], name: str) -> DataFrame:
    """``rows`` with ``average_rank`` of a value as ``name``, from counts of its distinct values that are range-partitioned: no task ranks all rows of a key."""
    counts = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_k"))
    placed = saved(prefix_total(counts, [*by, value], F.col("_k"), "_before"))
    first = placed.groupBy(*by).agg(F.min("_before").alias("_first"))  # one row a key
    ranks = placed.join(F.broadcast(first), list(by)).select(*by, value, (F.col("_before") - F.col("_first") + (F.col("_k") + 1) / 2).alias(name))
    return rows.join(ranks, [*by, value])


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str], wide: bool = False) -> DataFrame:
    """by..., n, pearson, spearman over rows where both are there; 0 for fewer than three rows or a constant side.
    ``wide``: few keys with very many rows each, whose ranks are counted and not ordered in a window."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    if wide:
        rows = saved(both.select(*by, F.col(x).alias("_x"), F.col(y).alias("_y")))
        ranked = counted_rank(saved(counted_rank(rows, "_x", by, "_rx")), "_y", by, "_ry")
    else:
        ranked = both.select(*by, F.col(x).alias("_x"), F.col(y).alias("_y"), average_rank(F.col(x), by).alias("_rx"), average_rank(F.col(y), by).alias("_ry"))

    def safe(a: str, b: str) -> Column:
        flat = (F.count(F.lit(1)) < 3) | (F.coalesce(F.max(a) - F.min(a), F.lit(0)) == 0) | (F.coalesce(F.max(b) - F.min(b), F.lit(0)) == 0)
        return F.when(flat, 0.0).otherwise(correlation(a, b))

    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), safe("_x", "_y").alias("pearson"), safe("_rx", "_ry").alias("spearman"))


def with_drawdown(df: DataFrame, value: str, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = df.withColumn("cumulative", F.sum(value).over(w))
    return summed.withColumn("drawdown", F.greatest(F.lit(0), F.max("cumulative").over(w)) - F.col("cumulative"))


def episodes(df: DataFrame, value: str, start: float, end: float, by: Sequence[str], order: Sequence[str], at: str) -> DataFrame:
    """Stretches that begin at value >= start and end below ``end``: by..., episode, started, ended, peak, rows.
    The machine has two states and its steps (on, off, as before) compose to the last that isn't "as before": a scan over buckets."""
    told = running(df, by, at, order, {"_on": ("last", F.when(F.col(value) >= start, 1).when(F.col(value) < end, 0))}).withColumn("_on", F.coalesce("_on", F.lit(0)))
    was = running(told, by, at, order, {"_was": ("last", F.col("_on"))}, before=True)
    new = ((F.col("_on") == 1) & (F.coalesce("_was", F.lit(0)) == 0)).cast("long")
    numbered = running(was.withColumn("_new", new), by, at, order, {"episode": ("sum", F.col("_new"))})
    return numbered.where("_on = 1").groupBy(*by, "episode").agg(F.min(at).alias("started"), F.max(at).alias("ended"), F.max(value).alias("peak"), F.count(F.lit(1)).alias("rows"))


def first_of(df: DataFrame, key: Sequence[str | Column], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key, with the number of rows it stands for."""
    w = Window.partitionBy(*key)
    ranked = df.withColumn("_nth", F.row_number().over(w.orderBy(*order))).withColumn("copies", F.count(F.lit(1)).over(w))
    return ranked.where("_nth = 1").drop("_nth")


def changed(df: DataFrame, value: str | Column, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows whose value differs from the one before them (consecutive repeats go); ``order`` begins with a time in milliseconds."""
    now = value if isinstance(value, Column) else F.col(value)
    seen = running(df.withColumn("_now", now), by, order[0], order, {"_before": ("last", F.struct("_now"))}, before=True)
    return seen.where(F.col("_before").isNull() | ~F.col("_now").eqNullSafe(F.col("_before._now"))).drop("_now", "_before")


#: Intervals of a bucket in which ``thin`` follows its rows in one task.
THINNED = 64


def thin(df: DataFrame, by: Sequence[str], at: str, order: Sequence[str], interval: int) -> DataFrame:
    """Greedy thinning: a row stays if it is ``interval`` or more after the last one that stayed;
    rows out of time order are dropped.

    The row that stays next is a pointer.  Time is cut into buckets of THINNED intervals; pointers are followed inside each
    bucket from its entries, the times at which a chain may come into it (those of its first interval, and the first
    time after that), to the entry of a later bucket.  These jumps, a few rows a bucket, are doubled until the entries that the first
    row leads to are known; then each bucket marks its rows from its own entry.  A row without a time or key goes."""
    by, order = list(by), list(order)
    width = interval * THINNED
    seen = running(df, by, at, order, {"_newest": ("max", F.col(at))}, before=True, bucket=max(DAY, width)).where(F.col("_newest").isNull() | (F.col(at) >= F.col("_newest"))).drop("_newest")
    rows = saved(seen.withColumn("_bucket", F.floor(F.col(at) / width)))
    times = rows.groupBy(*by, "_bucket").agg(F.sort_array(F.collect_set(at)).alias("_times"))  # of a bucket
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)

    def follow(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups:
            out = []
            for i, (b, ts) in enumerate(zip(g["_bucket"], g["_times"], strict=True)):
                ts = np.sort(np.asarray(ts, dtype=np.int64))
                after = np.searchsorted(ts, ts + interval)
                exits = ts.copy()
                for k in range(len(ts) - 1, -1, -1):
                    if after[k] < len(ts):
                        exits[k] = exits[after[k]]
                n = min(len(ts), int(np.searchsorted(ts, b * width + interval)) + 1)
                out += [(i, int(ts[k]), int(exits[k]) + interval) for k in range(n)]
            made = pd.DataFrame(out, columns=["_i", "_entry", "_free"])
            yield pd.concat([g[by].iloc[made["_i"]].reset_index(drop=True), made[["_entry", "_free"]]], axis=1)

    entries = saved(times.mapInPandas(follow, f"{kinds}, _entry long, _free long"))
    # an entry's jump: the first time at or after its chain is free again, which is an entry of a later bucket
    jumps = asof_join(entries.withColumn("_t", F.col("_free")), entries.select(*by, F.col("_entry").alias("_t"), F.col("_entry").alias("_next")), by, "_t", ["_next"], forward=True, bucket=width).where("_next is not null").select(*by, "_entry", "_next")
    jumps, reached = saved(jumps), saved(entries.groupBy(*by).agg(F.min("_entry").alias("_entry")))
    while not jumps.isEmpty():
        reached = saved(reached.union(reached.join(jumps, [*by, "_entry"]).select(*by, F.col("_next").alias("_entry"))))
        two = jumps.select(*by, "_entry", F.col("_next").alias("_mid")).join(jumps.select(*by, F.col("_entry").alias("_mid"), "_next"), [*by, "_mid"])
        jumps = saved(two.select(*by, "_entry", "_next"))
    own = reached.withColumn("_bucket", F.floor(F.col("_entry") / width)).groupBy(*by, "_bucket").agg(F.min("_entry").alias("_entry"))

    def mark(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups:
            out = []
            for i, (entry, ts) in enumerate(zip(g["_entry"], g["_times"], strict=True)):
                ts = np.sort(np.asarray(ts, dtype=np.int64))
                k = int(np.searchsorted(ts, entry))
                while k < len(ts):
                    out.append((i, int(ts[k])))
                    k = int(np.searchsorted(ts, ts[k] + interval))
            made = pd.DataFrame(out, columns=["_i", "_stays"])
            yield pd.concat([g[by].iloc[made["_i"]].reset_index(drop=True), made[["_stays"]]], axis=1)

    stays = times.join(own, [*by, "_bucket"]).mapInPandas(mark, f"{kinds}, _stays long")
    first = rows.drop("_bucket").withColumn("_nth", F.row_number().over(Window.partitionBy(*by, at).orderBy(*order))).where("_nth = 1").withColumn("_stays", F.col(at).cast("long")).drop("_nth")
    return first.join(stays, [*by, "_stays"], "left_semi").select(*df.columns)


def thin_by_bucket(df: DataFrame, by: Sequence[str], at: str, order: Sequence[str], interval: int) -> DataFrame:
    """The scalable neighbour of ``thin``: the first row of each bucket of time."""
    return first_of(df.withColumn("_bucket", F.floor(F.col(at) / interval)), [*by, "_bucket"], order).drop("_bucket", "copies")


def prefix_max(df: DataFrame, value: str, by: Sequence[str], at: str, order: Sequence[str], name: str, bucket: int = 86_400_000) -> DataFrame:
    """``name``: the largest ``value`` so far in each key's order, which begins with ``at``; by buckets of time that hand their maximum on, so no task holds a whole key."""
    cut = df.withColumn("_bucket", F.floor(F.col(at) / bucket))
    tops = cut.groupBy(*by, "_bucket").agg(F.max(value).alias("_top"))
    carried = tops.withColumn("_carry", F.max("_top").over(Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))).drop("_top")  # one row a bucket
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    made = cut.withColumn("_here", F.max(value).over(inside)).join(carried, [*by, "_bucket"])
    return made.withColumn(name, F.greatest("_here", "_carry")).drop("_bucket", "_here", "_carry")


def restamp(df: DataFrame, stamp: str, by: Sequence[str], at: str, order: Sequence[str], name: str = "clock", lag: int = 0) -> DataFrame:
    """``df`` with a venue clock: the freshest stamp so far, or the first one for rows before any."""
    first = df.groupBy(*by).agg(F.min_by(stamp, F.when(F.col(stamp).isNotNull(), F.struct(*order))).alias("_first"))
    made = prefix_max(df, stamp, by, at, order, name).join(first, list(by))
    return made.withColumn(name, F.coalesce(name, "_first") + lag).drop("_first")


def prefix_total(df: DataFrame, order: Sequence[str], value: Column, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over all rows before a row in a global order (of distinct keys).
    Rows are range-partitioned once and written; each part is summed by itself, and the parts' totals give what lies before."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = saved(df.withColumn("_v", value).repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part").agg(F.sum("_v").alias("_sum"))
    bases = totals.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))  # one row a part
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.withColumn("_in", F.coalesce(F.sum("_v").over(inside), F.lit(0))).join(F.broadcast(bases), "_part").withColumn(name, F.col("_base") + F.col("_in")).drop("_v", "_part", "_in", "_base")


def interval_join(points: DataFrame, spans: DataFrame, by: Sequence[str], at: str, start: str, end: str, bucket: int) -> DataFrame:
    """Pairs of a point and a span that holds it (start <= at < end), by equal keys.
    Spans are listed in the time buckets they touch, which turns the range into an equi-join."""
    p = points.withColumn("_bucket", F.floor(F.col(at) / bucket))
    s = spans.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor((F.greatest(F.col(end) - 1, F.col(start))) / bucket))))
    return p.join(s, [*by, "_bucket"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_bucket")
