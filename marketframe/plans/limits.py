"""Sizes, audits and breaches of perpetual positions, and plans of hedged pairs, as columns and reasons."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketframe.functions.prices import liquidation_distance, liquidation_price, round_down

Decision = Callable[[DataFrame], Column]
_decisions: dict[str, Decision] = {}


def register_decision(name: str, decide: Decision) -> None:
    """A strategy of the user's: ``decide(rows)`` gives a struct (outcome, price, size, role) or null for each row."""
    if name in _decisions:
        raise ValueError(f"decision {name} is taken")
    _decisions[name] = decide


def decided(rows: DataFrame, name: str) -> DataFrame:
    out = rows.withColumn("decision", _decisions[name](rows)).where("decision is not null")
    return out.select("*", "decision.*").drop("decision")


def position_size(equity: Column, volatility: Column, edge: Column, caps: dict[str, Column], target: float = 0.01, kelly: float = 0.25) -> Column:
    """struct(size, bound): the least of the volatility target, a fraction of Kelly and the caps, and which one it was."""
    kinds = {"volatility": equity * target / volatility, "kelly": F.greatest(F.lit(0.0), equity * kelly * edge / (volatility * volatility)), **caps}
    return F.array_min(F.array(*[F.struct(v.cast("double").alias("size"), F.lit(k).alias("bound")) for k, v in kinds.items()]))


def perp_order_audit(orders: DataFrame, limits: dict[str, float]) -> DataFrame:
    """``orders`` (side, price, size, held, held_entry, leverage, equity, margin, mark, reduce_only) with blended entry,
    liquidation price and the reasons against each; reduce-only orders only have to reduce."""
    signed = F.when(F.col("side") == "buy", F.col("size")).otherwise(-F.col("size"))
    after = F.col("held") + signed
    same = (F.col("held") == 0) | (F.signum("held") == F.signum(signed))
    entry = F.when(same, (F.abs("held") * F.col("held_entry") + F.col("size") * F.col("price")) / F.greatest(F.abs(after), F.lit(1e-12))).otherwise(F.col("held_entry"))
    liq = liquidation_price(F.when(after >= 0, "long").otherwise("short"), entry, F.greatest(F.abs(after), F.lit(1e-12)), F.col("leverage"), F.lit(limits["mmr"]), F.lit(0.0), F.lit(limits["fee_bps"]))
    out = orders.withColumn("position_after", after).withColumn("entry_after", entry).withColumn("liquidation_after", liq)
    distance = liquidation_distance(F.col("position_after"), F.col("mark"), F.col("liquidation_after"))
    reduces = ~same & (F.abs("position_after") < F.abs("held"))
    opening = F.array_compact(F.array(
        F.when(F.col("size") <= 0, "no size"), F.when(F.col("price") <= 0, "no price"), F.when(F.col("leverage") > limits["leverage"], "leverage"), F.when(F.col("size") * F.col("price") > limits["order"], "order too large"),
        F.when(F.abs("position_after") * F.col("mark") > limits["position"], "position too large"), F.when(F.col("size") * F.col("price") / F.col("leverage") > F.col("margin"), "margin"),
        F.when(F.abs(F.col("price") / F.col("mark") - 1) > limits["off_mark"], "far from the mark"), F.when(distance < limits["distance"], "close to liquidation"),
    ))
    reasons = F.when(F.col("reduce_only"), F.when(reduces, F.array().cast("array<string>")).otherwise(F.array(F.lit("does not reduce")))).otherwise(opening)
    return out.withColumn("reasons", reasons)


def breaches(positions: DataFrame, marks: DataFrame, least_distance: float, worst_pnl: float) -> DataFrame:
    """Open positions whose mark is close to liquidation or whose loss is too large, at every mark."""
    joined = positions.join(marks, "coin")
    pnl = (F.col("mark_px") - F.col("entry_px")) * F.col("size")
    marked = joined.withColumn("pnl", pnl).withColumn("distance", liquidation_distance(F.col("size"), F.col("mark_px"), F.col("liquidation_px")))
    return marked.where((F.col("distance") < least_distance) | (F.col("pnl") < worst_pnl))


def loss_streaks(trades: DataFrame, by: Sequence[str]) -> DataFrame:
    """The longest row of losing trades of each key, and the worst day."""
    w = Window.partitionBy(*by).orderBy("ts_ms", "n")
    t = trades.withColumn("_lost", F.col("pnl") < 0).withColumn("_i", F.sum((F.col("pnl") >= 0).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = t.groupBy(*by, "_i").agg(F.sum(F.col("_lost").cast("int")).alias("run"))
    days = trades.groupBy(*by, F.floor(F.col("ts_ms") / 86_400_000).alias("_d")).agg(F.sum("pnl").alias("day"))
    return runs.groupBy(*by).agg(F.max("run").alias("streak")).join(days.groupBy(*by).agg(F.min("day").alias("worst_day")), list(by))


def account_changes(states: DataFrame, by: str = "user") -> DataFrame:
    """States whose positions differ from the account's state before: by a fingerprint of the sorted positions."""
    mark = F.xxhash64(F.array_sort(F.transform("positions", lambda p: F.struct(p["coin"].alias("coin"), p["size"].alias("size")))))
    w = Window.partitionBy(by).orderBy("t")
    return states.withColumn("fingerprint", mark).withColumn("_b", F.lag("fingerprint").over(w)).where(~F.col("fingerprint").eqNullSafe(F.col("_b"))).drop("_b")


def carry_plan(markets: DataFrame, capital: Column, hold_days: float, per_day: float) -> DataFrame:
    """``markets`` (perp_lot, spot_fee, perp_fee, price, leverage, rate_bps, least) with sizes, capital and reasons against: perp lots first, spot grossed up for its fee."""
    lots = round_down(capital / (F.col("price") * (1 + 1 / F.col("leverage"))), F.col("perp_lot"))
    out = markets.withColumn("perp_size", lots).withColumn("spot_size", F.col("perp_size") / (1 - F.col("spot_fee")))
    out = out.withColumn("capital", F.col("spot_size") * F.col("price") + F.col("perp_size") * F.col("price") / F.col("leverage")).withColumn("income_bps", F.col("rate_bps") * per_day * hold_days).withColumn("cost_bps", 2 * (F.col("spot_fee") + F.col("perp_fee")) * 10_000)
    return out.withColumn("reasons", F.array_compact(F.array(F.when(F.col("perp_size") < F.col("least"), "too small"), F.when(F.col("rate_bps") <= 0, "no carry"), F.when(F.col("income_bps") <= F.col("cost_bps"), "does not pay its cost"))))


def scorecard(closed: DataFrame) -> DataFrame:
    """Closed pairs (planned_bps, funding, fees, price_pnl, notional, days): what was earned against the plan."""
    net = F.col("funding") + F.col("price_pnl") - F.col("fees")
    return closed.withColumn("net", net).withColumn("net_bps", net / F.col("notional") * 10_000).withColumn("bps_a_day", F.when(F.col("days") > 0, F.col("funding") / F.col("notional") * 10_000 / F.col("days"))).withColumn("against_plan", F.when(F.col("planned_bps") != 0, F.col("net_bps") / F.col("planned_bps")))


def stalest(accounts: DataFrame, now_ms: int, top: int) -> DataFrame:
    """The ``top`` accounts (user, last_polled_ms, notional) to be read next: by age times the root of the notional; never read ones come first, ties go by user."""
    age = F.when(F.col("last_polled_ms").isNull(), float("inf")).otherwise((now_ms - F.col("last_polled_ms")).cast("double"))
    return accounts.withColumn("score", age * F.sqrt("notional")).orderBy(F.desc("score"), "user").limit(top)
