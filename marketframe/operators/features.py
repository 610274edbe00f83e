"""Microstructure features of touch updates and trades, by windows of time.

Touch updates: instrument, n, ts_ms, bid, ask, bid_size, ask_size.  Trades:
instrument, n, ts_ms, price, size, is_buy.  Windows count events with
``ts >= now - h``; an event never sees later ones, though they share its time.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketframe.functions.prices import imbalance, microprice, mid, spread_bps
from marketframe.operators.running import DAY, running
from marketframe.operators.saved import saved
from marketframe.operators.timeseries import asof_join

BPS = 10_000.0
BY = "instrument"


def usable_touch(touch: DataFrame) -> DataFrame:
    """Uncrossed updates with positive prices; the others change nothing."""
    return touch.where((F.col("bid") > 0) & (F.col("bid") < F.col("ask")))


def lagged(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """``df`` with a struct ``name`` of the ``columns`` of the row before it (null for an instrument's first).
    Time is cut into days; a day hands its last row to the next, so no task holds a whole instrument."""
    one = F.struct(*[F.col(c) for c in columns])
    cut = df.withColumn("_day", F.floor(F.col("ts_ms") / DAY))
    last = cut.groupBy(BY, "_day").agg(F.max_by(one, F.struct("ts_ms", "n")).alias("_last"))
    carry = last.withColumn("_carry", F.lag("_last").over(Window.partitionBy(BY).orderBy("_day"))).drop("_last")  # one row a day
    inside = F.lag(one).over(Window.partitionBy(BY, "_day").orderBy("ts_ms", "n"))
    return cut.withColumn(name, inside).join(carry, [BY, "_day"]).withColumn(name, F.coalesce(name, "_carry")).drop("_day", "_carry")


def order_flow(touch: DataFrame) -> DataFrame:
    """``ofi``: the flow that an update adds, against the touch before it; 0 for the first."""
    columns = ("bid", "ask", "bid_size", "ask_size")
    b, a, qb, qa = (F.col(c) for c in columns)
    pb, pa, pqb, pqa = (F.col(f"_p.{c}") for c in columns)
    bid = F.when(b > pb, qb).when(b == pb, qb - pqb).otherwise(-pqb)
    ask = F.when(a < pa, -qa).when(a == pa, -(qa - pqa)).otherwise(pqa)
    return lagged(touch, columns, "_p").withColumn("ofi", F.when(F.col("_p").isNull(), 0).otherwise(bid + ask).cast("double")).drop("_p")


def haloed(df: DataFrame, reach_ms: int, bucket_ms: int = 0) -> DataFrame:
    """``df`` cut into buckets of time (``_bucket``), each with the rows of the ``reach_ms`` before it, so that windows
    that look back so far need no other bucket.  ``_own`` marks the rows that belong to the bucket; the others are
    there to be looked back at."""
    width = max(bucket_ms or DAY, reach_ms)
    own = F.floor(F.col("ts_ms") / width)
    return df.withColumn("_bucket", F.explode(F.sequence(own, F.floor((F.col("ts_ms") + reach_ms) / width)))).withColumn("_own", F.col("_bucket") == own)


def window_sums(df: DataFrame, values: Sequence[str], horizons_ms: Sequence[int]) -> DataFrame:
    """``<value>_<h>``: the sum over the last h ms, this event included and later ones of the same time not: the running
    sum here less the running sum before the window (two running sums of a bucket, not a sum for each row)."""
    cut = haloed(df, max(horizons_ms) + 1)
    by = Window.partitionBy(BY, "_bucket")
    rows = by.orderBy("ts_ms", "n").rowsBetween(Window.unboundedPreceding, 0)
    made = []
    for h in horizons_ms:
        before = by.orderBy("ts_ms").rangeBetween(Window.unboundedPreceding, -h - 1)
        made += [(F.sum(v).over(rows) - F.coalesce(F.sum(v).over(before), F.lit(0))).alias(f"{v}_{h}") for v in values]
    return cut.select("*", *made).where("_own").drop("_bucket", "_own")


def trade_flow(trades: DataFrame, horizons_ms: Sequence[int]) -> DataFrame:
    """For each trade and horizon: tfi (buy less sell volume over both), volume, trades and vwap of the window that ends with it."""
    out = trades.withColumn("_buy", F.when(F.col("is_buy"), F.col("size")).otherwise(0)).withColumn("_paid", F.col("price") * F.col("size")).withColumn("volume", F.col("size")).withColumn("trades", F.lit(1))
    out = window_sums(out, ["_buy", "_paid", "volume", "trades"], horizons_ms).drop("_buy", "_paid", "volume", "trades")
    for h in horizons_ms:
        v = F.col(f"volume_{h}")
        out = out.withColumn(f"tfi_{h}", F.when(v > 0, (2 * F.col(f"_buy_{h}") - v) / v).otherwise(0.0)).withColumn(f"vwap_{h}", F.when(v > 0, F.col(f"_paid_{h}") / v)).drop(f"_buy_{h}", f"_paid_{h}")
    return out


def mids(touch: DataFrame) -> DataFrame:
    """instrument, ts_ms, mid: the last mid of each time."""
    good = usable_touch(touch)
    return good.groupBy(BY, "ts_ms").agg(F.max_by(mid(F.col("bid"), F.col("ask")), "n").alias("mid"))


def past_returns(events: DataFrame, touch: DataFrame, horizons_ms: Sequence[int]) -> DataFrame:
    """``ret_h``: log return in bps since the mid at or before ts - h; 0 where history doesn't reach.  ``events`` have mid."""
    out, series = events, mids(touch).withColumnRenamed("mid", "then")
    for h in horizons_ms:
        asked = out.withColumn("now_ms", F.col("ts_ms")).withColumn("ts_ms", F.col("ts_ms") - h)
        out = asof_join(asked, series, [BY], "ts_ms", ["then"], bucket=86_400_000).withColumn("ts_ms", F.col("now_ms"))
        out = out.withColumn(f"ret_{h}", F.coalesce(F.log(F.col("mid") / F.col("then")) * BPS, F.lit(0.0))).drop("then", "now_ms")
    return out


def realized_volatility(series: DataFrame, horizon_ms: int, name: str) -> DataFrame:
    """sqrt(sum of squared log returns from the window's second sample on, over its seconds); 0 with fewer than three samples.  ``series``: instrument, ts_ms, mid, one row a time."""
    w = Window.partitionBy(BY, "_bucket").orderBy("ts_ms")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    # the first row of a bucket has no row before it there: its return counts in no window, as it is the first of its own
    r2 = F.pow(F.log(F.col("mid") / F.lag("mid").over(w)), 2)
    s = haloed(series, horizon_ms).withColumn("_r2", F.coalesce(r2, F.lit(0.0)))
    s = s.withColumn("_at", F.struct("ts_ms", F.row_number().over(w).alias("i"), F.sum("_r2").over(upto).alias("sum")))
    # a window begins with the row after the last one before it: running values here less those there, so that no window is summed by itself
    s = s.withColumn("_next", F.lead("_at").over(w))
    s = s.withColumn("_first", F.coalesce(F.last("_next").over(w.rangeBetween(Window.unboundedPreceding, -horizon_ms - 1)), F.first("_at").over(upto)))
    total, seconds = F.col("_at.sum") - F.col("_first.sum"), (F.col("ts_ms") - F.col("_first.ts_ms")) / 1000
    made = s.withColumn(name, F.when(F.col("_at.i") - F.col("_first.i") < 2, 0.0).otherwise(F.sqrt(F.greatest(total, F.lit(0.0)) / seconds) * BPS))
    return made.where("_own").drop("_r2", "_at", "_next", "_first", "_bucket", "_own")


#: Samples that a task ranks at a time.
RANKED = 4096


def volatility_regime(df: DataFrame, rv: str, samples: int = 600, least: int = 60) -> DataFrame:
    """low, high, normal or unknown: the last positive samples' order statistics at a third and two thirds.

    A value is at or below an order statistic when few enough values of the window are below it, so a row needs two counts
    and no sorted window.  Samples are numbered over buckets of time and cut into blocks by number; a block has
    the ``samples`` - 1 rows before it as a halo, so that no task holds a whole instrument."""
    numbered = running(df.where(F.col(rv) > 0), [BY], "ts_ms", ["ts_ms"], {"_n": ("sum", F.lit(1).cast("long"))})
    size = max(RANKED, samples)
    own = F.floor((F.col("_n") - 1) / size)
    blocks = numbered.withColumn("_block", F.explode(F.sequence(own, F.floor((F.col("_n") + samples - 2) / size))))

    def rank(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_n")
        v, n = rows[rv].to_numpy(float), rows["_n"].to_numpy()
        before = int((n <= rows["_block"].iloc[0] * size).sum())  # the halo
        padded = np.concatenate([np.full(samples - 1, np.nan), v])  # nan is neither below nor above
        below, upto = np.zeros(len(v), int), np.zeros(len(v), int)
        for first in range(before, len(v), 512):
            last = min(first + 512, len(v))
            windows = np.lib.stride_tricks.sliding_window_view(padded[first : last + samples - 1], samples)
            below[first:last] = (windows < v[first:last, None]).sum(1)
            upto[first:last] = (windows <= v[first:last, None]).sum(1)
        held = np.minimum(n, samples)
        low, high = (np.floor(held * q).astype(int) for q in (0.33, 0.67))
        regime = np.select([held < least, below <= low, upto >= high + 1], ["unknown", "low", "high"], "normal")
        return rows.assign(regime=regime).iloc[before:].drop(columns=["_n", "_block"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", regime string"
    return blocks.groupBy(BY, "_block").applyInPandas(rank, schema)


def forward_labels(rows: DataFrame, touch: DataFrame, horizons_ms: Sequence[int], threshold_bps: float) -> DataFrame:
    """``fwd_h`` (bps to the first mid at or after ts + h) and ``label_h`` (1, 0, -1); rows whose horizons aren't all there go."""
    out, series = rows, mids(touch).withColumnRenamed("mid", "later")
    newest = series.groupBy(BY).agg(F.max("ts_ms").alias("newest"))
    for h in horizons_ms:
        asked = out.withColumn("now_ms", F.col("ts_ms")).withColumn("ts_ms", F.col("ts_ms") + h)
        out = asof_join(asked, series, [BY], "ts_ms", ["later"], forward=True, bucket=86_400_000).withColumn("ts_ms", F.col("now_ms"))
        fwd = F.round((F.col("later") / F.col("mid") - 1) * BPS, 4)
        out = out.withColumn(f"fwd_{h}", fwd).drop("later", "now_ms").where(F.col(f"fwd_{h}").isNotNull())
        out = out.withColumn(f"label_{h}", F.when(F.col(f"fwd_{h}") > threshold_bps, 1).when(F.col(f"fwd_{h}") < -threshold_bps, -1).otherwise(0))
    done = out.join(F.broadcast(newest), BY)  # one row an instrument
    return done.where(F.col("newest") - F.col("ts_ms") >= max(horizons_ms)).drop("newest")


def snapshot(touch: DataFrame) -> DataFrame:
    """Price columns of each usable update."""
    b, a, qb, qa = (F.col(c) for c in ("bid", "ask", "bid_size", "ask_size"))
    good = usable_touch(touch)
    micro = microprice(b, a, qb, qa)
    return good.withColumn("mid", mid(b, a)).withColumn("spread_bps", spread_bps(b, a)).withColumn("micro_bps", (micro - mid(b, a)) / mid(b, a) * BPS).withColumn("obi_1", imbalance(qb, qa))


def depth(levels: str, n: int) -> Column:
    """The size of the best n levels, of an array of (price, size) with the best first."""
    return F.aggregate(F.slice(levels, 1, n), F.lit(0.0), lambda s, x: s + x["size"])


def feature_snapshot(book: DataFrame, trades: DataFrame, funding: DataFrame, ofi_ms: Sequence[int] = (1000, 5000), tfi_ms: Sequence[int] = (1000, 5000, 30000), ret_ms: Sequence[int] = (1000, 5000, 30000), rv_ms: Sequence[int] = (10000, 60000), regime: tuple[int, int] = (600, 60)) -> DataFrame:
    """The whole feature vector at each book update and each trade, in order of (ts_ms, n).

    ``book``: instrument, n, ts_ms and the book after the update as bids and asks, arrays of (price, size) with the
    best first.  ``trades``: instrument, n, ts_ms, price, size, is_buy.  ``funding``: instrument, ts_ms, rate, settles_ms.
    Features of the book are those of its last update, those of the tape the last trade's, whose windows end with that
    trade.  ``is_valid`` holds where the book is two-sided and uncrossed; elsewhere all but the clocks are 0.
    A book's features come from its usable updates alone; an unusable one only makes rows invalid until the next."""
    top = book.withColumn("bid", F.get("bids", F.lit(0))["price"]).withColumn("ask", F.get("asks", F.lit(0))["price"]).withColumn("bid_size", F.get("bids", F.lit(0))["size"]).withColumn("ask_size", F.get("asks", F.lit(0))["size"])
    good = saved(usable_touch(top))  # read by all that follows
    sides = [depth(s, k).alias(f"_{s}_{k}") for k in (1, 5, 20) for s in ("bids", "asks")]
    rows = window_sums(order_flow(snapshot(good)).select("*", *sides), ["ofi"], ofi_ms)
    rows = saved(past_returns(saved(rows), good, ret_ms))
    series = mids(good)
    for h in rv_ms:
        series = realized_volatility(series, h, f"rv_{h}")
    slow, series = f"rv_{rv_ms[-1]}", saved(series)
    state = volatility_regime(series, slow, *regime).select(BY, "ts_ms", "regime")
    rows = rows.join(series.select(BY, "ts_ms", *[f"rv_{h}" for h in rv_ms]), [BY, "ts_ms"])
    rows = asof_join(rows, state, [BY], "ts_ms", ["regime"], bucket=DAY)  # the regime of the last time that had one
    started = good.groupBy(BY).agg(F.min("ts_ms").alias("_began"))
    rows = rows.join(F.broadcast(started), BY)  # one row an instrument
    micro = microprice(F.col("bid"), F.col("ask"), F.col("bid_size"), F.col("ask_size"))
    book_side = F.struct(
        F.col("ts_ms").alias("ts"), F.lit(True).alias("usable"), "mid", micro.alias("microprice"), F.col("micro_bps").alias("microprice_delta_bps"), (F.col("ask") - F.col("bid")).cast("double").alias("spread"), "spread_bps",
        *[imbalance(F.col(f"_bids_{k}"), F.col(f"_asks_{k}")).alias(f"obi_{k}") for k in (1, 5, 20)], *[f"ofi_{h}" for h in ofi_ms], *[f"ret_{h}" for h in ret_ms], *[f"rv_{h}" for h in rv_ms],
        F.col("_bids_20").alias("bid_depth_20"), F.col("_asks_20").alias("ask_depth_20"), F.coalesce("regime", F.lit("unknown")).alias("vol_regime"), ((F.col("ts_ms") - F.col("_began")) / 1000).alias("history_seconds"),
    )
    made = saved(rows.select(BY, "ts_ms", "n", book_side.alias("b")))
    kind = made.schema["b"].dataType
    bad = top.where(~F.coalesce((F.col("bid") > 0) & (F.col("bid") < F.col("ask")), F.lit(False))).select(BY, "ts_ms", "n", F.struct(*[F.lit(False if f.name == "usable" else None).cast(f.dataType).alias(f.name) for f in kind.fields]).alias("b"))
    bad = bad.withColumn("b", F.col("b").withField("ts", F.col("ts_ms")))
    tape = trade_flow(trades, tfi_ms)
    first = tfi_ms[0]
    tape_side = F.struct(F.col("ts_ms").alias("ts"), *[f"tfi_{h}" for h in tfi_ms], F.col(f"trades_{first}").alias("trade_count"), F.col(f"volume_{first}").alias("volume"), F.col(f"vwap_{first}").alias("vwap"), F.col("price").alias("last_price"))
    told = tape.select(BY, "ts_ms", "n", tape_side.alias("t"))
    events = made.union(bad).select(BY, "ts_ms", "n", F.lit(1).alias("turn"), "b", F.lit(None).cast(told.schema["t"].dataType).alias("t"))
    events = saved(events.union(told.select(BY, "ts_ms", "n", F.lit(0).alias("turn"), F.lit(None).cast(kind).alias("b"), "t")))  # a trade comes before a book update of the same time and number
    # both sides are carried on, within a day and from the days before it
    cut = events.withColumn("_day", F.floor(F.col("ts_ms") / DAY))
    at = F.struct("ts_ms", "n", "turn")
    ends = cut.groupBy(BY, "_day").agg(*[F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), at)).alias(f"_last_{c}") for c in "bt"])
    before = Window.partitionBy(BY).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)  # one row a day
    carried = ends.select(BY, "_day", *[F.last(f"_last_{c}", ignorenulls=True).over(before).alias(f"_carry_{c}") for c in "bt"])
    inside = Window.partitionBy(BY, "_day").orderBy("ts_ms", "n", "turn").rowsBetween(Window.unboundedPreceding, 0)
    now = cut.withColumn("b", F.last("b", ignorenulls=True).over(inside)).withColumn("t", F.last("t", ignorenulls=True).over(inside)).join(carried, [BY, "_day"]).withColumn("b", F.coalesce("b", "_carry_b")).withColumn("t", F.coalesce("t", "_carry_t")).drop("_day", "_carry_b", "_carry_t")
    now = asof_join(now, funding, [BY], "ts_ms", ["rate", "settles_ms"], bucket=DAY)
    valid = F.coalesce(F.col("b.usable"), F.lit(False))
    zero = lambda c: F.when(valid, F.coalesce(c, F.lit(0.0))).otherwise(0.0)
    names = [f.name for f in kind.fields if f.name not in ("ts", "usable", "vol_regime")]
    return now.select(
        BY, "n", F.coalesce("b.ts", "ts_ms").alias("ts"), F.col("ts_ms").alias("received_ts"), *[zero(F.col(f"b.{c}").cast("double")).alias(c) for c in names], F.when(valid, F.col("b.vol_regime")).otherwise("unknown").alias("vol_regime"),
        *[zero(F.col(f"t.tfi_{h}")).alias(f"tfi_{h}") for h in tfi_ms], F.when(valid, F.coalesce("t.trade_count", F.lit(0))).otherwise(0).cast("long").alias("trade_count"), zero(F.col("t.volume").cast("double")).alias("volume"), zero(F.col("t.vwap")).alias("vwap"), zero(F.col("t.last_price").cast("double")).alias("last_price"),
        zero(F.col("rate")).alias("funding_rate"), zero(F.greatest(F.lit(0.0), (F.col("settles_ms") - F.col("b.ts")) / 1000)).alias("funding_ttl_s"),
        F.greatest(F.lit(0), F.col("ts_ms") - F.col("b.ts")).alias("book_age_ms"), ((F.col("ts_ms") - F.col("t.ts")) / 1000).alias("tape_staleness_s"), valid.alias("is_valid"),
    )
