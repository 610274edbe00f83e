"""Panels of bars: assembly, factors, the tradeable universe, rank blends, clusters.

A panel has a row for each symbol and date, date_idx counting all dates that
occur; windows are ranges of date_idx, so a symbol's missing dates stay missing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketframe.operators.timeseries import correlation, run_lengths, strict_sum, trailing

BY = ["symbol"]
BPS = 10_000.0


def accrual_day(ts_ms: Column) -> Column:
    """The day a settlement belongs to: its stamp to the nearest minute (half to even), less a millisecond."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor((F.bround(ts_ms / 60000) * 60000 - 1) / 86_400_000).cast("int"))


def funding_by_day(funding: DataFrame, min_settlements: int = 0) -> DataFrame:
    """symbol, day, funding_bps, funding_periods; a stamp counts once (its largest rate), and a day of too few settlements has none."""
    once = funding.groupBy("symbol", "ts_ms").agg(F.max("rate_bps").alias("rate_bps"))
    days = once.groupBy("symbol", accrual_day(F.col("ts_ms")).alias("day")).agg(F.sum("rate_bps").alias("funding_bps"), F.count(F.lit(1)).alias("funding_periods"))
    full = F.col("funding_periods") >= min_settlements
    return days.withColumn("funding_bps", F.when(full, F.col("funding_bps"))).withColumn("funding_periods", F.when(full, F.col("funding_periods")).otherwise(0))


def assemble(bars: DataFrame, funding_days: DataFrame) -> DataFrame:
    """Bars with the funding of their day; the bars' own funding columns give way."""
    own = bars.drop("funding_bps", "funding_periods")
    days = funding_days.withColumnRenamed("day", "date")
    return own.join(days, ["symbol", "date"], "left").withColumn("funding_periods", F.coalesce("funding_periods", F.lit(0)))


def usable(panel: DataFrame, min_minutes: int = 1430) -> DataFrame:
    """The panel with ``complete`` and with funding missing where nothing was settled."""
    return panel.withColumn("complete", F.col("minutes") >= min_minutes).withColumn("funding_bps", F.when(F.col("funding_periods") > 0, F.col("funding_bps")))


def parkinson_bps(high: Column, low: Column) -> Column:
    return F.log(high / low) / (2 * F.sqrt(F.log(F.lit(2.0)))) * BPS


def at_lag(panel: DataFrame, value: str, steps: int, name: str) -> DataFrame:
    """``value`` of the same symbol ``steps`` dates before: by the dense index, never by rows of a series with gaps."""
    w = Window.partitionBy(*BY).orderBy("date_idx").rangeBetween(-steps, -steps)
    return panel.withColumn(name, F.max(value).over(w))


def log_return(panel: DataFrame, steps: int, name: str) -> DataFrame:
    return at_lag(panel, "close", steps, "_then").withColumn(name, F.log(F.col("close") / F.col("_then")) * BPS).drop("_then")


#: Factors by name: a function of a panel that has ret (one-step return, bps) and rv_bps.
CARRY, MOMENTUM, REVERSAL = (1, 3, 7, 14, 30, 60), (7, 14, 30, 90), (1, 3)
_registered: dict[str, Callable[[DataFrame], DataFrame]] = {}


def factors(panel: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """The panel with the built-in factors of ``names`` (all without), in a few passes over windows by symbol."""
    asked = lambda *own: names is None or any(n in names for n in own)
    p = log_return(panel, 1, "ret").withColumn("rv_bps", parkinson_bps(F.col("high"), F.col("low")))
    positive = F.when(F.col("quote_volume") > 0, F.col("quote_volume"))
    for w in (w for w in MOMENTUM if asked(f"mom_{w}")):
        p = log_return(p, w, f"mom_{w}")
    for w in (w for w in REVERSAL if asked(f"rev_{w}")):
        p = log_return(p, w, f"rev_{w}").withColumn(f"rev_{w}", -F.col(f"rev_{w}"))
    means = {
        "lowvol_30": lambda: -trailing(F.col("ret"), BY, "date_idx", 30, "std"), "lowrv_30": lambda: -trailing(F.col("rv_bps"), BY, "date_idx", 30, "mean"), "illiq_30": lambda: trailing(F.abs("ret") / positive, BY, "date_idx", 30, "mean"),
        "small_30": lambda: trailing(-F.log(positive), BY, "date_idx", 30, "mean"), "taker_7": lambda: trailing(F.col("taker_buy_frac"), BY, "date_idx", 7, "mean"),
        **{f"carry_{w}": (lambda w=w: -trailing(F.col("funding_bps"), BY, "date_idx", w, "sum") / w) for w in CARRY},
    }
    p = p.withColumns({name: made() for name, made in means.items() if asked(name)})
    if not asked("max_7", "skew_30", "beta_30"):
        return p
    market = p.groupBy("date_idx").agg(F.avg("ret").alias("market"))  # one row a date
    p = p.join(F.broadcast(market), "date_idx")
    w30 = Window.partitionBy(*BY).orderBy("date_idx").rangeBetween(-29, 0)
    w7 = Window.partitionBy(*BY).orderBy("date_idx").rangeBetween(-6, 0)
    r, m = F.col("ret"), F.when(F.col("ret").isNotNull(), F.col("market"))
    mean, mean2, mean3 = F.avg(r).over(w30), F.avg(r * r).over(w30), F.avg(r * r * r).over(w30)
    sd = F.stddev_pop(r).over(w30)
    late = F.col("date_idx") >= 30
    var = F.var_pop(m).over(w30)
    return p.withColumns({
        "max_7": F.when(late, -F.max(r).over(w7)), "skew_30": F.when(late & (sd > 0), -(mean3 - 3 * mean * mean2 + 2 * mean * mean * mean) / (sd * sd * sd)),
        "beta_30": F.when(late & (var > 0), -F.covar_pop(r, m).over(w30) / var),
    })


def relative_carry(panel: DataFrame, width: int) -> Column:
    """carry_rel: the strict trailing sum of funding over the reference's, negated, by step."""
    return -strict_sum(F.col("funding_bps") - F.col("ref_funding_bps"), BY, "date_idx", width) / width


def register_factor(name: str, fn: Callable[[DataFrame], DataFrame], built_in: tuple[str, ...] = ()) -> None:
    """A factor of the user's: ``fn(panel)`` gives (date_idx, symbol, value).  A name that is taken is refused."""
    if name in built_in or name in _registered:
        raise ValueError(f"factor {name} is taken")
    _registered[name] = fn


def external_factor(panel: DataFrame, name: str) -> DataFrame:
    return panel.join(_registered[name](panel).select("date_idx", "symbol", F.col("value").alias(name)), ["date_idx", "symbol"], "left")


def universe(panel: DataFrame, min_history: int, min_volume: float, warm: int = 30) -> DataFrame:
    """The panel with ``run`` (complete steps in a row), ``median_volume`` of the last 30 and ``eligible``."""
    w = Window.partitionBy(*BY).orderBy("date_idx").rangeBetween(-29, 0)
    p = run_lengths(panel, "complete", BY, "date_idx").withColumn("median_volume", F.percentile("quote_volume", F.lit(0.5)).over(w))
    return p.withColumn("eligible", (F.col("run") >= min_history) & (F.col("median_volume") >= min_volume) & (F.col("date_idx") >= warm))


def rank_blend(panel: DataFrame, weights: dict[str, float], name: str) -> DataFrame:
    """Weighted mean of the percentile ranks within a date, over rows that have all inputs; at least two names."""
    have = None
    for c in weights:
        have = F.col(c).isNotNull() if have is None else have & F.col(c).isNotNull()
    p = panel.withColumn("_have", have)
    group = Window.partitionBy("date_idx", "_have")
    total = sum(weights.values())
    ranks = sum((F.percent_rank().over(group.orderBy(c, "symbol")) * (w / total) for c, w in weights.items()), F.lit(0.0))
    return p.withColumn(name, F.when(F.col("_have") & (F.count(F.lit(1)).over(group) >= 2), ranks)).drop("_have")


def panel_report(panel: DataFrame) -> DataFrame:
    """Rows, symbols, dates, share of rows with funding, and breadth a date: least, median, most."""
    per_date = panel.groupBy("date_idx").agg(F.count(F.lit(1)).alias("breadth"))
    breadth = per_date.agg(F.min("breadth").alias("least"), F.percentile("breadth", F.lit(0.5)).alias("median"), F.max("breadth").alias("most"))
    whole = panel.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("symbol").alias("symbols"), F.countDistinct("date_idx").alias("dates"), F.avg((F.col("funding_periods") > 0).cast("int")).alias("funded"))
    return whole.join(F.broadcast(breadth))  # one row each


def attach_reference(panel: DataFrame, reference: DataFrame, canonical: Callable[[Column], Column]) -> DataFrame:
    """The panel with ``ref_funding_bps`` of the other venue by canonical name and date; a name that stands for several symbols of a side is dropped there."""

    def single(df: DataFrame) -> DataFrame:
        names = df.select("symbol", canonical(F.col("symbol")).alias("name")).distinct()
        once = names.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("name"))).where("_n = 1").drop("_n")
        return df.join(F.broadcast(once), "symbol", "left")  # one row a symbol

    ref = single(reference).where("name is not null").select("name", "date", F.col("funding_bps").alias("ref_funding_bps"))
    return single(panel).join(ref, ["name", "date"], "left")


def correlations(panel: DataFrame, value: str = "ret", least: int = 20, by: Sequence[str] = ()) -> DataFrame:
    """(by..., a, b, corr) of symbols a < b over dates that all usable symbols have, after taking out the date's mean; each group of ``by`` for itself."""
    by = list(by)
    w = Window.partitionBy(*by, "date_idx")
    x = panel.where(F.col(value).isNotNull()).withColumn("x", F.col(value) - F.avg(value).over(w)).select(*by, "symbol", "date_idx", "x")
    good = x.groupBy(*by, "symbol").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select(*by, "symbol")
    used = x.join(good, [*by, "symbol"], "left_semi")
    size = good.groupBy(*by).agg(F.count(F.lit(1)).alias("k"))
    n = used.groupBy(*by, "date_idx").agg(F.count(F.lit(1)).alias("n"))
    days = (n.join(F.broadcast(size), by) if by else n.crossJoin(F.broadcast(size))).where("n = k").select(*by, "date_idx")
    full = used.join(F.broadcast(days), [*by, "date_idx"])  # one row a date
    pairs = full.select(*by, "date_idx", F.col("symbol").alias("a"), F.col("x").alias("x_a")).join(full.select(*by, "date_idx", F.col("symbol").alias("b"), F.col("x").alias("x_b")), [*by, "date_idx"]).where("a < b")
    return pairs.groupBy(*by, "a", "b").agg(correlation("x_a", "x_b").alias("corr"), F.count(F.lit(1)).alias("days")).where(F.col("days") >= least)
