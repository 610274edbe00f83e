"""Portfolios of a panel: books, holding legs, turnover, controls, bootstrap, sweeps.

Everything that is tried, a factor, a seed or a parameter set, is a row of a
specification table and so a column ``spec`` of the data; nothing loops over runs.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketframe.operators.timeseries import spearman

BPS = 10_000.0


def score_rows(panel: DataFrame, factor: str | Sequence[str], hold: int, lag: int, start: int, risk: str | None = None) -> DataFrame:
    """Entry rows: every ``hold`` dates from ``start``, scored ``lag`` dates before; symbol, date_idx, score, eligible, price_leg, funding_leg, ret.
    Several factors come as rows, told by the column ``factor``.  With ``risk``, that column comes along as it is at the entry, and names need one above 0."""
    names = [factor] if isinstance(factor, str) else list(factor)
    last = panel.agg(F.max("date_idx").alias("last"))
    w = Window.partitionBy("symbol").orderBy("date_idx").rangeBetween(-lag, -lag)
    ahead = Window.partitionBy("symbol").orderBy("date_idx")
    legs = (
        panel.withColumns({f"_score_{k}": F.max(f).over(w) for k, f in enumerate(names)})
        .withColumn("exit_close", F.max("close").over(ahead.rangeBetween(hold, hold)))
        .withColumn("funding_leg", -F.coalesce(F.sum("funding_bps").over(ahead.rangeBetween(1, hold)), F.lit(0.0)))
    )
    entry = legs.where((F.col("date_idx") >= start) & ((F.col("date_idx") - start) % hold == 0)).join(F.broadcast(last)).where(F.col("date_idx") < F.col("last") + 1 - hold)
    price = F.log(F.col("exit_close") / F.col("close")) * BPS
    if risk is not None:
        entry = entry.withColumn("eligible", F.col("eligible") & F.coalesce(F.col(risk) > 0, F.lit(False)))
    if isinstance(factor, str):
        entry, told = entry.withColumn("score", F.col("_score_0")), []
    else:
        each = F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f"_score_{k}").alias("score")) for k, f in enumerate(names)]))
        entry, told = entry.withColumn("_each", each).withColumns({"factor": F.col("_each.factor"), "score": F.col("_each.score")}), ["factor"]
    return entry.select(*told, *([F.col(risk).alias("risk")] if risk is not None else []), "symbol", "date_idx", "score", "eligible", "quote_volume", "median_volume", price.alias("price_leg"), "funding_leg", (price + F.col("funding_leg")).alias("ret"))


def books(scored: DataFrame, frac: Column | float, spec: Sequence[str] = ()) -> DataFrame:
    """The long and short side of each date: round(n * frac) names, half to even, at least one and at most half; fewer than six names make no book.
    Ties go by symbol.  Adds n_names, n_side, side (1, -1) and raw weight 1."""
    group = Window.partitionBy(*spec, "date_idx")
    names = scored.where(F.col("eligible") & F.col("score").isNotNull())
    n = F.count(F.lit(1)).over(group)
    ranked = names.withColumn("n_names", n).withColumn("rank", F.row_number().over(group.orderBy("score", "symbol")))
    share = frac if isinstance(frac, Column) else F.lit(float(frac))
    size = F.least(F.greatest(F.lit(1), F.bround(F.col("n_names") * share).cast("int")), F.floor(F.col("n_names") / 2).cast("int"))
    sided = ranked.where("n_names >= 6").withColumn("n_side", size)
    return sided.withColumn("side", F.when(F.col("rank") > F.col("n_names") - F.col("n_side"), 1).when(F.col("rank") <= F.col("n_side"), -1).otherwise(0))


def banded(scored: DataFrame, frac: float, band: float) -> DataFrame:
    """As ``books``, but a held name stays while it ranks inside ``frac + band``.  Each date depends on the one before it, but for
    those after a date of fewer than six names, which holds nothing: the fold begins anew there, and stretches between such dates are folded apart."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        out, held = [], {1: set(), -1: set()}
        for _, day in rows.sort_values(["date_idx", "score", "symbol"]).groupby("date_idx", sort=True):
            names = day["symbol"].tolist()
            if len(names) < 6:
                held = {1: set(), -1: set()}
                continue
            k = min(max(1, round(len(names) * frac)), len(names) // 2)
            reach = min(max(1, round(len(names) * (frac + band))), len(names) // 2)
            for side, ranked in ((1, names[::-1]), (-1, names)):
                stay = [s for s in ranked[:reach] if s in held[side]][:k]
                held[side] = {*stay, *[s for s in ranked if s not in stay][: k - len(stay)]}
            out.append(day.assign(side=[1 if s in held[1] else -1 if s in held[-1] else 0 for s in names]))
        return pd.concat(out) if out else rows.assign(side=0).iloc[:0]

    names = scored.where(F.col("eligible") & F.col("score").isNotNull()).select("spec", "date_idx", "symbol", "score", "ret")
    dates = names.groupBy("spec", "date_idx").agg((F.count(F.lit(1)) < 6).cast("int").alias("_empty"))
    stretches = dates.withColumn("_stretch", F.sum("_empty").over(Window.partitionBy("spec").orderBy("date_idx"))).where("_empty = 0").drop("_empty")  # one row a date
    return names.join(F.broadcast(stretches), ["spec", "date_idx"]).groupBy("spec", "_stretch").applyInPandas(lambda rows: fold(rows.drop(columns="_stretch")), "spec string, date_idx long, symbol string, score double, ret double, side long")


def raw_weights(booked: DataFrame, risk: str | None = "risk", cluster: str | None = None, spec: Sequence[str] = ()) -> Column:
    """What ``weigh`` takes: one over a name's risk, shared with the names of its cluster that are on the same side of the same date and have a return."""
    raw = 1 / F.col(risk) if risk is not None else F.lit(1.0)
    if cluster is None:
        return raw
    mates = F.count(F.when(F.col("ret").isNotNull(), 1)).over(Window.partitionBy(*spec, "date_idx", "side", cluster))
    return raw / F.greatest(mates, F.lit(1))


def weigh(booked: DataFrame, raw: Column | None = None, spec: Sequence[str] = ()) -> DataFrame:
    """Weights of names with a return, each side summing to 1 and -1; a date with an empty side has none."""
    side = Window.partitionBy(*spec, "date_idx", "side")
    date = Window.partitionBy(*spec, "date_idx")
    live = booked.where(F.col("ret").isNotNull()).withColumn("_raw", raw if raw is not None else F.lit(1.0))
    both = (F.max(F.when(F.col("side") == 1, 1)).over(date) == 1) & (F.max(F.when(F.col("side") == -1, 1)).over(date) == 1)
    weight = F.when(F.col("side") != 0, F.col("side") * F.col("_raw") / F.sum("_raw").over(side)).otherwise(0.0)
    market = F.avg("ret").over(date)
    return live.withColumn("weight", F.when(both, weight)).withColumn("market", market).where(F.col("weight").isNotNull()).drop("_raw")


def periods(weighed: DataFrame, hold: Column | int, cost_bps: Column | float, spec: Sequence[str] = ()) -> DataFrame:
    """One row a rebalance: gross, price, funding, turnover, net, market, n.

    Turnover is the sum of |w - previous w|: each weight is entered as +w at its own
    date and as -w at the next one, and changes are summed by symbol."""
    cost = cost_bps if isinstance(cost_bps, Column) else F.lit(float(cost_bps))
    w = F.col("weight")
    sums = weighed.groupBy(*spec, "date_idx").agg(
        (F.sum(w * (F.col("ret") - F.col("market"))) / 2).alias("gross"), (F.sum(w * F.col("price_leg")) / 2).alias("price"), (F.sum(w * F.col("funding_leg")) / 2).alias("funding"),
        F.max("market").alias("market"), F.count(F.when(F.col("side") != 0, 1)).alias("n"),
    )
    held = weighed.where("side <> 0")
    moves = held.select(*spec, "symbol", "date_idx", w.alias("w")).union(held.select(*spec, "symbol", (F.col("date_idx") + hold).alias("date_idx"), (-w).alias("w")))
    turnover = moves.groupBy(*spec, "symbol", "date_idx").agg(F.sum("w").alias("w")).groupBy(*spec, "date_idx").agg(F.sum(F.abs("w")).alias("turnover"))
    joined = sums.join(turnover, [*spec, "date_idx"])
    return joined.withColumn("net", (2 * F.col("gross") - F.col("turnover") * cost) / 2)


def summary(runs: DataFrame, hold: Column | int, spec: Sequence[str] = ()) -> DataFrame:
    """n, mean, sd, t, low, high, sharpe, annual_pct, hit, turnover, beta, alpha of net returns a rebalance."""
    n, mean, sd = F.count(F.lit(1)), F.avg("net"), F.stddev_samp("net")
    se = sd / F.sqrt(n)
    var = F.var_samp("market")
    beta = F.when(var > 0, F.covar_samp("net", "market") / var).otherwise(0.0)
    made = [
        n.alias("n"), mean.alias("mean"), sd.alias("sd"), F.when(sd > 0, mean / se).alias("t"), (mean - 1.96 * se).alias("low"), (mean + 1.96 * se).alias("high"),
        F.when(sd > 0, mean / sd * (365 / hold) ** 0.5).alias("sharpe"), (mean * 365 / hold / 100).alias("annual_pct"), F.avg((F.col("net") > 0).cast("int")).alias("hit"),
        F.avg("turnover").alias("turnover"), beta.alias("beta"), (mean - beta * F.avg("market")).alias("alpha"),
    ]
    return runs.groupBy(*spec).agg(*made) if spec else runs.agg(*made)


def period_ic(weighed: DataFrame, spec: Sequence[str] = ()) -> DataFrame:
    """Spearman of score and excess return for each date of six names or more."""
    rows = weighed.withColumn("excess", F.col("ret") - F.col("market"))
    return spearman(rows, "score", "excess", [*spec, "date_idx"]).where("n >= 6").select(*spec, "date_idx", F.col("n").alias("names"), F.col("spearman").alias("ic"))


def draw(*parts: Column | str) -> Column:
    """A random order that any engine can repeat: the MD5 of the parts."""
    return F.md5(F.concat_ws("|", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]))


def shuffled(scored: DataFrame, seeds: int, fixed: bool = False, spec: Sequence[str] = ()) -> DataFrame:
    """Controls: for each seed the scores of a date dealt anew over its eligible names (``fixed``: one order of symbols for all dates).
    Scores and symbols are numbered within (spec, seed, date) and joined by number; all of ``spec`` are dealt alike."""
    names = scored.where(F.col("eligible") & F.col("score").isNotNull())
    seeded = names.withColumn("seed", F.explode(F.sequence(F.lit(1), F.lit(seeds))))
    group = Window.partitionBy(*spec, "seed", "date_idx")
    order = draw("seed", "symbol") if fixed else draw("seed", "date_idx", "symbol")
    to = seeded.withColumn("nth", F.row_number().over(group.orderBy(order, "symbol"))).drop("score")
    scores = seeded.select(*spec, "seed", "date_idx", "score", F.row_number().over(group.orderBy("symbol")).alias("nth"))
    return to.join(scores, [*spec, "seed", "date_idx", "nth"]).drop("nth")


def control_summary(real: DataFrame, controls: DataFrame) -> DataFrame:
    """mean (of the real run), control_mean, control_sd, beaten: the share of controls below it.  One row a seed comes in."""
    c = controls.agg(F.avg("mean").alias("control_mean"), F.stddev_samp("mean").alias("control_sd"), F.collect_list("mean").alias("all"))
    joined = real.select("mean").join(F.broadcast(c))
    return joined.select("mean", "control_mean", "control_sd", F.when(F.size("all") > 0, F.size(F.filter("all", lambda x: x < F.col("mean"))) / F.size("all")).alias("beaten"))


def share_beaten(real: DataFrame, controls: DataFrame, spec: Sequence[str]) -> DataFrame:
    """``real`` (one row a spec) with ``beaten``: the share of that spec's controls (a row for each seed) whose mean is below its own."""
    shares = controls.select(*spec, F.col("mean").alias("_control")).join(F.broadcast(real.select(*spec, "mean")), list(spec)).groupBy(*spec).agg(F.avg((F.col("_control") < F.col("mean")).cast("int")).alias("beaten"))
    return real.join(shares, list(spec), "left")


def block_bootstrap(values: DataFrame, value: str, order: str, block: int, draws: int) -> DataFrame:
    """low, high: the 95 % interval of the mean over resampled blocks of ``block`` consecutive values (one row a period, few)."""
    indexed = values.select(F.col(value).alias("v"), (F.row_number().over(Window.orderBy(order)) - 1).alias("i"))
    size = indexed.agg(F.count(F.lit(1)).alias("n"))
    picks = size.select("n", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).withColumn("b", F.explode(F.sequence(F.lit(1), F.ceil(F.col("n") / block).cast("int"))))
    starts = picks.withColumn("start", F.pmod(F.conv(F.substring(draw("draw", "b"), 1, 8), 16, 10).cast("long"), F.greatest(F.col("n") - block + 1, F.lit(1))))
    places = starts.select("draw", "n", "b", F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("o"), "start").where((F.col("b") - 1) * block + F.col("o") < F.col("n")).select("draw", (F.col("start") + F.col("o")).alias("i"))
    means = places.join(F.broadcast(indexed), "i").groupBy("draw").agg(F.avg("v").alias("mean"))
    return means.agg(F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high"))


def sweep(scored_by_hold: dict[int, DataFrame], fracs: Sequence[float], costs: Sequence[float], volumes: Sequence[float] = (0.0,)) -> DataFrame:
    """Summary for each (hold, frac, cost, volume), with the median number of names of a date that trade at least that volume: the
    grid is a table, and all of it is one run of books, weights and turnovers."""
    values = lambda xs: F.explode(F.array(*[F.lit(float(x)) for x in xs]))
    all_holds = None
    for hold, scored in scored_by_hold.items():
        one = scored.withColumn("hold", F.lit(hold))
        all_holds = one if all_holds is None else all_holds.unionByName(one)
    spec = ["hold", "frac", "volume"]
    grid = all_holds.withColumn("volume", values(volumes)).withColumn("eligible", F.col("eligible") & (F.col("median_volume") >= F.col("volume"))).withColumn("frac", values(fracs))
    booked = weigh(books(grid, F.col("frac"), spec), spec=spec)
    runs = periods(booked, F.col("hold"), 0.0, spec).withColumn("cost", values(costs))
    runs = runs.withColumn("net", (2 * F.col("gross") - F.col("turnover") * F.col("cost")) / 2)
    names = grid.groupBy(*spec, "date_idx").agg(F.count_if(F.col("eligible")).alias("_names")).groupBy(*spec).agg(F.percentile("_names", F.lit(0.5)).alias("names"))
    return summary(runs, F.col("hold"), [*spec, "cost"]).join(F.broadcast(names), spec)


def universe_halves(scored: DataFrame, seeds: int, hold: int, frac: float, cost: float) -> DataFrame:
    """For each seed, symbols fall into two halves by hash; summary of each half."""
    halves = scored.withColumn("seed", F.explode(F.sequence(F.lit(1), F.lit(seeds)))).withColumn("half", F.pmod(F.conv(F.substring(draw("seed", "symbol"), 1, 6), 16, 10).cast("long"), F.lit(2)))
    spec = ["seed", "half"]
    return summary(periods(weigh(books(halves, frac, spec), spec=spec), hold, cost, spec), hold, spec)


def capacity(weighed: DataFrame, participation: float) -> DataFrame:
    """The book's size at which its tightest name takes ``participation`` of its volume: least, p10, median over rebalances, and the last."""
    per = weighed.where("side <> 0").groupBy("date_idx").agg(F.min(F.lit(participation) * F.col("median_volume") / (F.abs("weight") / 2)).alias("size"))
    return per.agg(F.min("size").alias("least"), F.percentile("size", F.lit(0.1)).alias("p10"), F.percentile("size", F.lit(0.5)).alias("median"), F.max_by("size", "date_idx").alias("latest"))


def by_year(runs: DataFrame, year: Column) -> DataFrame:
    """n, net, price, funding of each year and of all (year null), by one rollup."""
    return runs.withColumn("year", year).rollup("year").agg(F.count(F.lit(1)).alias("n"), F.sum("net").alias("net"), F.sum("price").alias("price"), F.sum("funding").alias("funding"))


def verdict(summaries: DataFrame, least_beaten: float = 0.95) -> DataFrame:
    """Runs whose interval lies above zero and that beat the controls, best first."""
    return summaries.where((F.col("low") > 0) & (F.col("beaten") >= least_beaten)).orderBy(F.desc("low"))


def net_price_leg(summaries: DataFrame, cost_bps: float) -> DataFrame:
    """``summaries`` (price, turnover) with the price leg less its own cost: turnover isn't halved, the price leg is per unit of gross."""
    return summaries.withColumn("net_price", F.col("price") - F.col("turnover") * cost_bps / 2)
