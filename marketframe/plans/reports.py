"""Reports that end in a verdict: a factor's run, a carry screen, a map of liquidations, a signal's economics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketframe.functions.prices import liquidation_distance
from marketframe.plans import portfolio, signal


def run_report(runs: DataFrame, weighed: DataFrame, hold: int, spec: Sequence[str] = ()) -> DataFrame:
    """``portfolio.summary`` with gross, the price and funding legs, alpha_t and the mean IC of the run's dates.
    The residual's variance is that of the net less what the market explains of it, so one pass is enough."""
    spec = list(spec)
    n = F.count(F.lit(1))
    var, cov = F.var_samp("market"), F.covar_samp("net", "market")
    left = F.var_samp("net") - F.when(var > 0, cov * cov / var).otherwise(0.0)
    legs = [F.avg("gross").alias("gross"), F.avg("price").alias("price"), F.avg("funding").alias("funding"), F.sqrt(F.greatest(left, F.lit(0.0)) / F.nullif(n, F.lit(0))).alias("_error")]
    ic = portfolio.period_ic(weighed, spec)
    tables = [portfolio.summary(runs, hold, spec), runs.groupBy(*spec).agg(*legs), ic.groupBy(*spec).agg(F.avg("ic").alias("ic"))]
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, spec, "left") if spec else out.crossJoin(F.broadcast(t))  # one row each
    return out.withColumn("alpha_t", F.when(F.col("_error") > 0, F.col("alpha") / F.col("_error")).when(F.col("_error").isNotNull(), 0.0)).drop("_error")


def carry_screen(stats: DataFrame, quotes: DataFrame, spot_fee: float, perp_fee: float, hold_days: float, per_day: float = 3.0) -> DataFrame:
    """What a hedged pair (long spot, short perpetual) earns for each symbol, or why it can't be said.

    ``stats``: ``carry.funding_stats``; ``quotes``: symbol, spot_bid, spot_ask, perp_bid, perp_ask.  a_day is the median settlement times ``per_day``;
    a round trip pays both legs' fees twice and, crossing, both spreads.  The pair loses what the basis loses when it
    closes from below; that it may widen isn't counted.  Only funding that longs pay on median can be harvested."""
    mid = lambda leg: (F.col(f"{leg}_bid") + F.col(f"{leg}_ask")) / 2
    usable = lambda leg: F.coalesce((F.col(f"{leg}_bid") > 0) & (F.col(f"{leg}_bid") < F.col(f"{leg}_ask")), F.lit(False))
    why = F.when(~usable("spot"), "no usable spot quote").when(~usable("perp"), "no usable perp quote").when(F.coalesce("n", F.lit(0)) == 0, "no funding history")
    spread = lambda leg: (F.col(f"{leg}_ask") - F.col(f"{leg}_bid")) / mid(leg) * 10_000
    rows = quotes.join(stats, "symbol", "left").withColumn("unavailable", why)
    fine = F.col("unavailable").isNull()
    rows = rows.withColumns({"a_day": F.when(fine, F.col("median") * per_day), "basis": F.when(fine, (mid("perp") - mid("spot")) / mid("spot") * 10_000), "quoting": F.lit(2.0 * (spot_fee + perp_fee)), "crossing": F.when(fine, spread("spot") + spread("perp") + 2 * (spot_fee + perp_fee))})
    made = {"convergence": F.greatest(F.lit(0.0), -F.col("basis")), "harvestable": F.when(fine, F.col("median") > 0)}
    for how in ("crossing", "quoting"):
        made[f"breakeven_{how}"] = F.when(F.col("a_day") > 0, F.col(how) / F.col("a_day"))
        made[f"net_{how}"] = F.col("a_day") * hold_days - F.col(how)
    made["after_convergence"] = F.col("a_day") * hold_days - F.col("crossing") - F.greatest(F.lit(0.0), -F.col("basis"))
    thin = fine & ((F.col("positive") < 0.8) | (F.col("drawdown") > 20))
    return rows.withColumns(made).withColumn("risky", F.when(fine, thin))


def carry_verdict(screened: DataFrame) -> DataFrame:
    """One row: usable, unavailable, unharvestable, clear_crossing, clear_quoting, best (symbol and net of the kind that counts), risky (of those), verdict."""
    good = F.coalesce("harvestable", F.lit(False))
    crossing, quoting = good & (F.col("net_crossing") > 0), good & (F.col("net_quoting") > 0)
    best = lambda on, c: F.max_by("symbol", F.when(on, F.struct(F.col(c), "symbol")))
    g = screened.agg(
        F.count_if(F.col("unavailable").isNull()).alias("usable"), F.count("unavailable").alias("unavailable"), F.count_if(F.col("harvestable") == F.lit(False)).alias("unharvestable"), F.count_if(crossing).alias("clear_crossing"), F.count_if(quoting).alias("clear_quoting"),
        best(crossing, "net_crossing").alias("_cross"), best(quoting, "net_quoting").alias("_quote"), F.count_if(crossing & F.col("risky")).alias("_risky_cross"), F.count_if(quoting & F.col("risky")).alias("_risky_quote"),
    )
    by_cross = F.col("clear_crossing") > 0
    verdict = F.when(by_cross, "clears crossing").when(F.col("clear_quoting") > 0, "clears only if quoted").otherwise("nothing clears its cost")
    return g.select("usable", "unavailable", "unharvestable", "clear_crossing", "clear_quoting", F.when(by_cross, F.col("_cross")).otherwise(F.col("_quote")).alias("best"), F.when(by_cross, F.col("_risky_cross")).otherwise(F.col("_risky_quote")).alias("risky"), verdict.alias("verdict"))


def liquidation_sides(positions: DataFrame, open_interest: DataFrame, as_of_ms: Column, within: Sequence[float] = (0.01, 0.02, 0.05, 0.1), far: float = 0.25) -> DataFrame:
    """Each coin's long and short side: size, accounts, no_price, crossed and beyond (sizes), beyond_notional, within_k (notional, at the liquidation
    price, of positions that are closed out within k per cent), coverage (size over open interest), and the coin's accounts and
    weighted_age_s (age of what is known, weighted by value).

    ``positions``: user, coin, size (signed), liquidation_px, position_value, mark_px, observed_ms; ``open_interest``: coin, open_interest."""
    size = F.abs("size")
    rows = positions.where("size <> 0").withColumn("side", F.when(F.col("size") > 0, "long").otherwise("short")).withColumn("_d", liquidation_distance(F.col("size"), F.col("mark_px"), F.col("liquidation_px")))
    ahead, notional = F.col("_d") > 0, size * F.col("liquidation_px")
    of = lambda on, x: F.coalesce(F.sum(F.when(on, x)), F.lit(0.0))
    names = [f"within_{round(k * 100)}" for k in within]
    sides = rows.groupBy("coin", "side").agg(
        F.sum(size).alias("size"), F.countDistinct("user").alias("accounts"), of(F.col("_d").isNull(), size).alias("no_price"), of(F.col("_d") <= 0, size).alias("crossed"), of(F.col("_d") >= far, size).alias("beyond"),
        of(F.col("_d") >= far, notional).alias("beyond_notional"), *[of(ahead & (F.col("_d") <= k), notional).alias(n) for k, n in zip(within, names, strict=True)],
    )
    weight = F.when(F.coalesce("position_value", F.lit(0.0)) != 0, F.col("position_value")).otherwise(size * F.col("mark_px"))
    age = F.greatest(F.lit(0.0), (as_of_ms - F.col("observed_ms")) / 1000)
    coins = rows.groupBy("coin").agg(F.countDistinct("user").alias("coin_accounts"), (F.sum(age * weight) / F.nullif(F.sum(weight), F.lit(0.0))).alias("weighted_age_s"))
    joined = sides.join(coins, "coin").join(open_interest, "coin", "left")  # one row a coin
    return joined.withColumn("coverage", F.when(F.col("open_interest") > 0, F.col("size") / F.col("open_interest")))


def economic_verdict(scored: DataFrame, score: str, y: str, tie: Sequence[str], cost_bps: float) -> DataFrame:
    """One row: auc, drift, long, short (excess over the drift), long_raw, short_raw, monotonicity, tradeable, drift_carried (only the raw returns
    clear the cost) and verdict."""
    marked = scored.withColumn("_up", (F.col(y) > 0).cast("int"))
    both = signal.ladder(marked, score, y, tie).crossJoin(F.broadcast(signal.auc(marked, score, "_up").select("auc")))  # one row each
    out = both.withColumns({"long_raw": F.col("long") + F.col("drift"), "short_raw": F.col("short") - F.col("drift")})
    out = out.withColumn("tradeable", F.greatest("long", "short") > cost_bps).withColumn("drift_carried", (F.greatest("long_raw", "short_raw") > cost_bps) & ~F.col("tradeable"))
    verdict = F.when(F.col("auc") < 0.505, "no signal").when(~F.col("tradeable"), "signal, but no edge after costs").otherwise("edge after costs")
    return out.select("n", "auc", "drift", "long", "short", "long_raw", "short_raw", "monotonicity", "tradeable", "drift_carried", verdict.alias("verdict"))
