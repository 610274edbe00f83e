"""Average cost of positions after every fill of a ledger, without a task that holds a whole market.

A fill turns the average cost a of what is held into c a + d, where c and d follow from
the position before and after it (a running sum) and the fill itself.  Such steps compose to steps of the
same kind, so buckets of time are composed first, carried over the buckets of a key, and
then each bucket is walked from its own start.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketframe.operators.running import DAY, running, walked
from marketframe.operators.saved import saved


def running_cost(fills: DataFrame, by: Sequence[str], bucket: int = 30 * DAY) -> DataFrame:
    """``fills`` (by..., ts_ms, n, side buy or sell, price, size, fee) with held and cost_before (the average cost of a unit held, 0 if none),
    held_after, cost_after, and gain: what the fill realises, less its fee.  Selling more than is held (or
    buying more than is owed) flips the position, at the fill's price.  Rows with a null key go."""
    by = list(by)
    q = F.when(F.col("side") == "buy", F.col("size")).otherwise(-F.col("size")).cast("double")
    held = running(fills.withColumn("_q", q), by, "ts_ms", ["ts_ms", "n"], {"held": ("sum", F.col("_q"))}, before=True).withColumn("held_after", F.col("held") + F.col("_q"))
    p, h, after, move = F.col("price").cast("double"), F.col("held"), F.col("held_after"), F.col("_q")
    adds = (h == 0) | (F.signum(h) == F.signum(move))
    size = F.greatest(F.abs(after), F.lit(1e-12))
    c = F.when(adds, F.abs(h) / size).when((after == 0) | (F.abs(move) > F.abs(h)), 0.0).otherwise(1.0)
    d = F.when(adds, p * F.abs(move) / size).when((after != 0) & (F.abs(move) > F.abs(h)), p).otherwise(0.0)
    steps = saved(held.withColumns({"_adds": adds, "_c": c, "_d": d, "_span": F.floor(F.col("ts_ms") / bucket)}))

    def compose() -> Callable[[float, float], tuple[float, float]]:
        c, d = 1.0, 0.0

        def step(x: float, y: float) -> tuple[float, float]:
            nonlocal c, d
            c, d = x * c, x * d + y
            return c, d

        return step

    def carry() -> Callable[[float, float], tuple[float]]:
        a = 0.0

        def step(x: float, y: float) -> tuple[float]:
            nonlocal a
            start, a = a, x * a + y
            return (start,)

        return step

    def walk() -> Callable[..., tuple[float, float]]:
        a = None

        def step(start: float, h: float, q: float, price: float, grows: bool, end: float) -> tuple[float, float]:
            nonlocal a
            before = start if a is None else a
            a = before
            if grows:
                a = (before * abs(h) + price * abs(q)) / max(abs(end), 1e-12)
            elif end == 0:
                a = 0.0
            elif abs(q) > abs(h):
                a = price
            return before, a

        return step

    order = ["ts_ms", "n"]
    composed = walked(steps.select(*by, "_span", *order, "_c", "_d"), [*by, "_span"], order, ["_c", "_d"], compose, {"_all_c": "double", "_all_d": "double"})
    spans = composed.groupBy(*by, "_span").agg(F.max_by(F.struct("_all_c", "_all_d"), F.struct(*order)).alias("s")).select(*by, "_span", "s.*")  # one row a bucket
    starts = walked(spans, by, ["_span"], ["_all_c", "_all_d"], carry, {"_start": "double"}).select(*by, "_span", "_start")
    rows = steps.join(starts, [*by, "_span"]).withColumn("_p", F.col("price").cast("double")).drop("_c", "_d")
    walked_ = walked(rows, [*by, "_span"], order, ["_start", "held", "_q", "_p", "_adds", "held_after"], walk, {"cost_before": "double", "cost_after": "double"}).drop("_span", "_start", "_p")
    closed = F.least(F.abs("held"), F.abs("_q"))
    gain = F.when(F.col("_adds"), 0.0).otherwise((F.col("price").cast("double") - F.col("cost_before")) * closed * F.signum("held")) - F.coalesce(F.col("fee").cast("double"), F.lit(0.0))
    return walked_.withColumn("gain", gain).drop("_q", "_adds")
