"""Funding carry: distributions, windows of holding a hedged pair, screens, monitoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketframe.functions.prices import leg_tag
from marketframe.operators.timeseries import interval_join, with_drawdown

PERIOD_MS = 8 * 3_600_000


def funding_stats(funding: DataFrame) -> DataFrame:
    """n, mean, median, share above 0, worst, deepest drawdown of the running sum, for each symbol."""
    d = with_drawdown(funding, "rate_bps", ["symbol"], ["ts_ms", "rate_bps"])
    return d.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.avg("rate_bps").alias("mean"), F.percentile("rate_bps", F.lit(0.5)).alias("median"), F.avg((F.col("rate_bps") > 0).cast("int")).alias("positive"),
        F.min("rate_bps").alias("worst"), F.max("drawdown").alias("drawdown"),
    )


def aligned(funding: DataFrame, spot: DataFrame, perp: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Funding, spot and perpetual closes of the same eight hours; the last candle of a bucket counts.  ``spot`` and ``perp``: symbol, ts_ms, price."""
    b = F.floor(F.col("ts_ms") / PERIOD_MS).alias("bucket")
    f = funding.groupBy(*by, b).agg(F.sum("rate_bps").alias("funding"))
    s = spot.groupBy(*by, b).agg(F.max_by("price", "ts_ms").alias("spot"))
    p = perp.groupBy(*by, b).agg(F.max_by("price", "ts_ms").alias("perp"))
    return f.join(s, [*by, "bucket"]).join(p, [*by, "bucket"]).where("spot > 0").withColumn("gap", (F.col("spot") - F.col("perp")) / F.col("spot") * 10_000)


def windows(rows: DataFrame, periods: int, round_trip: float) -> DataFrame:
    """Every entry's net over the next ``periods``: funding of those periods, change of the gap, less the round trip."""
    w = Window.partitionBy("symbol").orderBy("bucket")
    held = F.sum("funding").over(w.rowsBetween(1, periods))
    basis = F.lead("gap", periods).over(w) - F.col("gap")
    out = rows.withColumn("funding_held", held).withColumn("basis", basis).where("basis is not null")
    return out.withColumn("net", F.col("funding_held") + F.col("basis") - round_trip)


def window_report(nets: DataFrame, periods: int) -> DataFrame:
    """windows, effective n, median, p5 (the value at place 0.05 (n - 1), not interpolated), worst, best, share above 0."""
    g = nets.groupBy("symbol").agg(F.count(F.lit(1)).alias("windows"), F.percentile("net", F.lit(0.5)).alias("median"), F.min("net").alias("worst"), F.max("net").alias("best"), F.avg((F.col("net") > 0).cast("int")).alias("profitable"))
    ranked = nets.withColumn("_k", F.row_number().over(Window.partitionBy("symbol").orderBy("net", "bucket")) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("symbol")))
    p5 = ranked.where(F.col("_k") == F.floor((F.col("_n") - 1) * 0.05)).select("symbol", F.col("net").alias("p5"))
    return g.join(p5, "symbol").withColumn("effective", F.greatest(F.lit(1), F.floor(F.col("windows") / max(1, periods)).cast("int")))


def screen(stats: DataFrame, per_day: float, cost: Column, hold_days: float) -> DataFrame:
    """Carry a day, breakeven days and net over the hold; ranked by net."""
    day = F.abs(F.col("mean")) * per_day
    return stats.withColumn("a_day", day).withColumn("cost", cost).withColumn("breakeven_days", F.when(day > 0, F.col("cost") / day)).withColumn("net", day * hold_days - F.col("cost")).orderBy(F.desc("net"), "symbol")


def implied_funding(positions: DataFrame, settlements: DataFrame) -> DataFrame:
    """Funding that positions (position_id, symbol, side, notional, opened_ms, now_ms) should have been paid over opened < settlement <= now."""
    spans = positions.withColumn("_from", F.col("opened_ms") + 1).withColumn("_to", F.col("now_ms") + 1)
    inside = interval_join(settlements, spans, ["symbol"], "ts_ms", "_from", "_to", 30 * 86_400_000)
    sign = F.when(F.col("side") == "short", 1).otherwise(-1)
    return inside.groupBy("position_id").agg(F.sum(sign * F.col("rate_bps") * F.col("notional") / 10_000).alias("implied"), F.count(F.lit(1)).alias("settlements"))


def alerts(state: DataFrame) -> DataFrame:
    """``state`` (delta_share, distance, funding_gap, implied, realised, planned, breakeven, hold) with every alert that holds."""
    found = F.array_compact(F.array(
        F.when(F.col("delta_share") > 0.0005, "not neutral"), F.when(F.col("distance") < 0.08, "close to liquidation"), F.when(F.abs("funding_gap") > F.greatest(F.lit(0.05), 0.25 * F.abs("implied")), "funding differs"),
        F.when(F.col("realised") < 0.5 * F.col("planned"), "carry below plan"), F.when(F.col("breakeven") > F.col("hold"), "breakeven after the hold"),
    ))
    return state.withColumn("alerts", found)


def leg_totals(fills: DataFrame) -> DataFrame:
    """Fills (client_id, side, price, size, fee, ts_ms) of hedged pairs joined by their tag: tag, perp and spot (signed sizes), their average prices,
    fees, opened_ms, what isn't hedged as a share of the spot size, and the entry basis in bps; fills without a tag belong to no pair."""
    leg = F.regexp_extract("client_id", "^carry[0-9a-f]+([psu])", 1)
    rows = fills.withColumn("tag", leg_tag(F.col("client_id"))).where("tag is not null").withColumn("_leg", F.when(leg == "p", "perp").otherwise("spot"))
    signed = F.when(F.col("side") == "buy", F.col("size")).otherwise(-F.col("size")).cast("double")
    of = lambda kind, x: F.coalesce(F.sum(F.when(F.col("_leg") == kind, x)), F.lit(0.0))
    paid = F.col("price") * F.col("size").cast("double")
    per = rows.groupBy("tag").agg(
        of("perp", signed).alias("perp"), of("spot", signed).alias("spot"), (of("perp", paid) / F.nullif(of("perp", F.col("size").cast("double")), F.lit(0.0))).alias("perp_price"),
        (of("spot", paid) / F.nullif(of("spot", F.col("size").cast("double")), F.lit(0.0))).alias("spot_price"), F.sum("fee").alias("fees"), F.min("ts_ms").alias("opened_ms"),
    )
    return per.withColumn("delta_share", F.abs(F.col("perp") + F.col("spot")) / F.nullif(F.abs("spot"), F.lit(0.0))).withColumn("basis_bps", (F.col("spot_price") - F.col("perp_price")) / F.col("spot_price") * 10_000)
