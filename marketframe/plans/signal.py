"""Does a feature foretell a label: hygiene, information coefficients, leakage, a purged split, a logistic model, deciles."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketframe.functions.prices import binomial_tail
from marketframe.operators.saved import saved
from marketframe.operators.timeseries import correlation, prefix_total, spearman


def matrix(rows: DataFrame, features: Sequence[str], label: str, warm_s: float = 60) -> tuple[DataFrame, list[str]]:
    """Valid rows past the warm-up with finite values, and the features that aren't constant (one pass decides)."""
    inf = float("inf")
    fine = rows.where(F.col("is_valid") & (F.col("history_seconds") >= warm_s))
    for c in [*features, label]:
        fine = fine.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) < inf))
    spread = fine.agg(*[(F.max(c) - F.min(c)).alias(c) for c in features]).first()
    return fine, [c for c in features if spread[c] is not None and spread[c] != 0]


def geometry(rows: DataFrame, horizon_ms: int, by: Sequence[str] = ()) -> DataFrame:
    """interval, rows a time and effective N: distinct times over how many intervals a horizon spans."""
    n, u = F.count(F.lit(1)), F.countDistinct("ts_ms")
    g = rows.groupBy(*by).agg(n.alias("n"), u.alias("times"), (F.max("ts_ms") - F.min("ts_ms")).alias("span"))
    interval = F.when(F.col("times") > 1, F.col("span") / (F.col("times") - 1)).otherwise(1.0)
    return g.withColumn("interval", interval).withColumn("effective_n", F.greatest(F.lit(1), F.floor(F.col("times") / F.greatest(F.lit(1.0), F.lit(float(horizon_ms)) / F.col("interval"))).cast("long")))


def coefficients(rows: DataFrame, features: Sequence[str], label: str, horizon_ms: int, by: Sequence[str] = ()) -> DataFrame:
    """Pearson, Spearman and t of every feature with the label: features become rows, and one job serves them all."""
    long = rows.select(*by, "ts_ms", F.col(label).cast("double").alias("y"), *[F.col(c).cast("double").alias(c) for c in features]).unpivot([*by, "ts_ms", "y"], list(features), "feature", "x")
    ic = spearman(long, "x", "y", [*by, "feature"], wide=True)
    g = geometry(rows, horizon_ms, by)
    joined = ic.join(F.broadcast(g.select(*by, "effective_n")), list(by)) if by else ic.join(F.broadcast(g.select("effective_n")))
    r2 = F.least(F.pow("spearman", F.lit(2)), F.lit(0.999999))
    return joined.withColumn("t", F.when(F.col("effective_n") > 2, F.col("spearman") * F.sqrt((F.col("effective_n") - 2) / (1 - r2))).otherwise(0.0))


def leakage(ics: DataFrame, most: float = 0.20, least_n: int = 1000) -> DataFrame:
    """feature, warning: too good to be true, or too few independent rows."""
    why = F.array_compact(F.array(F.when(F.abs("spearman") > most, "suspiciously strong"), F.when(F.col("effective_n") < least_n, "few independent rows")))
    return ics.select("feature", F.explode(why).alias("warning"))


def purged_split(rows: DataFrame, order: Sequence[str], share: float, gap: int) -> DataFrame:
    """part (train, gap, test) of each row by its place in time.  Places are counted in two steps, by
    time bucket and within it, so that no task numbers all rows."""
    w = Window.partitionBy("_b").orderBy(*order)
    b = rows.withColumn("_b", F.floor(F.col("ts_ms") / 3_600_000))
    counts = b.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.withColumn("_start", F.coalesce(F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row an hour
    total = counts.agg(F.sum("_c").alias("_n"))
    placed = b.join(F.broadcast(before.select("_b", "_start")), "_b").join(F.broadcast(total)).withColumn("place", F.col("_start") + F.row_number().over(w) - 1)
    cut = F.floor(F.col("_n") * share)
    part = F.when(F.col("place") < cut, "train").when(F.col("place") < cut + gap, "gap").otherwise("test")
    return placed.withColumn("part", part).drop("_b", "_start", "_n")


def standardized(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features less the training rows' mean over their population deviation."""
    train = rows.where("part = 'train'").agg(*[F.avg(c).alias(f"_m_{c}") for c in features], *[F.stddev_pop(c).alias(f"_s_{c}") for c in features])
    out = rows.join(F.broadcast(train))
    for c in features:
        out = out.withColumn(c, (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0))
    return out.drop(*[f"_m_{c}" for c in features], *[f"_s_{c}" for c in features])


def logistic_scores(rows: DataFrame, features: Sequence[str], up: Column, l2: float = 1.0) -> DataFrame:
    """``rows`` with ``score``, from a ridge logistic model of the training rows (intercept not penalised)."""
    data = VectorAssembler(inputCols=list(features), outputCol="_x").transform(rows.withColumn("_y", up.cast("double")))
    train = data.where("part = 'train'")
    n = max(train.count(), 1)
    model = LogisticRegression(featuresCol="_x", labelCol="_y", probabilityCol="_p", rawPredictionCol="_r", predictionCol="_k", regParam=l2 / n, elasticNetParam=0.0, standardization=False).fit(train)
    return model.transform(data).withColumn("score", vector_to_array("_p")[1]).drop("_x", "_p", "_r", "_k")


def auc(scored: DataFrame, score: str, up: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the curve by average ranks; 0.5 with one class.  Rows are counted by distinct score first, and the
    counts are range-partitioned: no task ranks all rows."""
    values = scored.groupBy(*by, F.col(score).alias("_s")).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(up).cast("double")).alias("_up"))
    placed = prefix_total(values, [*by, "_s"], F.col("_n"), "_before")
    starts = F.min("_before")  # a key's scores lie together in the order, from here on
    sums = placed.groupBy(*by).agg(starts.alias("_start"), F.sum(F.col("_up") * (F.col("_before") + (F.col("_n") + 1) / 2)).alias("_ranks"), F.sum("_up").alias("_p"), F.sum("_n").alias("n"))
    p, n = F.col("_p"), F.col("n") - F.col("_p")
    made = F.when((p > 0) & (n > 0), (F.col("_ranks") - F.col("_start") * p - p * (p + 1) / 2) / (p * n)).otherwise(0.5)
    return sums.select(*by, made.alias("auc"), F.greatest(p / F.col("n"), 1 - p / F.col("n")).alias("majority"), "n")


def deciles(scored: DataFrame, score: str, y: str, tie: Sequence[str]) -> DataFrame:
    """Mean label of each tenth of the scores, and its excess over the drift.  Places are counted by range parts, so no task orders all rows."""
    placed = prefix_total(scored, [score, *tie], F.lit(1), "_place").crossJoin(F.broadcast(scored.agg(F.count(F.lit(1)).alias("_n"), F.avg(y).alias("drift"))))  # one row
    small, extra = F.floor(F.col("_n") / 10), F.col("_n") % 10
    wide = extra * (small + 1)  # the first tenths hold one row more
    tenth = F.when(F.col("_place") < wide, F.floor(F.col("_place") / (small + 1))).otherwise(extra + F.floor((F.col("_place") - wide) / F.greatest(small, F.lit(1))))
    per = placed.groupBy((tenth + 1).cast("int").alias("decile")).agg(F.avg(y).alias("mean"), F.count(F.lit(1)).alias("n"), F.max("drift").alias("drift"))
    return per.withColumn("excess", F.col("mean") - F.col("drift"))


def ladder(scored: DataFrame, score: str, y: str, tie: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """by..., n, drift, long, short, monotonicity: the mean label at or beyond the 90th and 10th percentile of a key's scores (between two
    rows' scores, linearly), less (more) the drift, and the correlation of the tenths' means with their number.
    Places are counted by range parts over all keys, less those before a key's first, so no task orders a whole key."""
    by = list(by)
    placed = saved(prefix_total(scored, [*by, score, *tie], F.lit(1).cast("long"), "_place"))
    keys = placed.groupBy(*by).agg(F.count(F.lit(1)).alias("_all"), F.avg(y).alias("_drift"), F.min("_place").alias("_first"))
    join = lambda a, b: a.join(F.broadcast(b), by) if by else a.crossJoin(F.broadcast(b))  # noqa: E731  one row a key
    rows = join(placed, keys).withColumn("_place", F.col("_place") - F.col("_first"))

    def at(q: float, name: str) -> list[Column]:
        """The scores around a percentile."""
        low = F.floor((F.col("_all") - 1) * q)
        return [F.max(F.when(F.col("_place") == F.least(low + k, F.col("_all") - 1), F.col(score))).alias(f"{name}{k}") for k in (0, 1)]

    ends = rows.groupBy(*by).agg(F.first("_all").alias("_n"), *at(0.9, "_h"), *at(0.1, "_l"))
    part = lambda q: (F.col("_n") - 1) * q - F.floor((F.col("_n") - 1) * q)
    cuts = ends.select(*by, (F.col("_h0") + (F.col("_h1") - F.col("_h0")) * part(0.9)).alias("_high"), (F.col("_l0") + (F.col("_l1") - F.col("_l0")) * part(0.1)).alias("_low"))
    marked = join(rows, cuts)
    small, extra = F.floor(F.col("_all") / 10), F.col("_all") % 10
    wide = extra * (small + 1)  # the first tenths hold one row more
    tenth = F.when(F.col("_place") < wide, F.floor(F.col("_place") / (small + 1))).otherwise(extra + F.floor((F.col("_place") - wide) / F.greatest(small, F.lit(1))))
    sums = marked.withColumn("_tenth", tenth).groupBy(*by, "_tenth").agg(F.first("_all").alias("_all"), F.first("_drift").alias("_drift"), F.avg(y).alias("_mean"), *[f(F.when(on, F.col(y))).alias(f"_{name}_{k}") for name, on in (("long", F.col(score) >= F.col("_high")), ("short", F.col(score) <= F.col("_low"))) for k, f in (("sum", F.sum), ("n", F.count))])
    mean = lambda side: F.sum(f"_{side}_sum") / F.sum(f"_{side}_n")
    made = sums.groupBy(*by).agg(F.first("_all").alias("n"), F.first("_drift").alias("drift"), mean("long").alias("_long"), mean("short").alias("_short"), correlation("_tenth", "_mean").alias("monotonicity"))
    return made.select(*by, "n", "drift", (F.col("_long") - F.col("drift")).alias("long"), (F.col("drift") - F.col("_short")).alias("short"), "monotonicity")


def economics(scored: DataFrame, score: str, y: str) -> DataFrame:
    """long and short: mean label at or beyond the 90th and 10th percentile of scores, less (more) the drift."""
    return ladder(scored, score, y, []).select("long", "short", "drift")


def sign_agreement(ics: DataFrame) -> DataFrame:
    """Per feature over instruments: how many signs agree, and the chance of that many by luck."""
    g = ics.where("spearman <> 0").groupBy("feature").agg(F.count(F.lit(1)).alias("instruments"), F.count_if(F.col("spearman") > 0).alias("up"))
    agree = F.greatest(F.col("up"), F.col("instruments") - F.col("up"))
    return g.withColumn("agree", agree).withColumn("p_value", binomial_tail(F.col("agree"), F.col("instruments")))


def describe(rows: DataFrame, y: str, horizon_ms: int, threshold_bps: float) -> DataFrame:
    """One row: n, span_h, interval_ms, effective_n, mean and std (population) of the label, and how many labels are up, down and flat."""
    g = geometry(rows, horizon_ms).select("n", (F.col("span") / 3_600_000).alias("span_h"), F.col("interval").alias("interval_ms"), "effective_n")
    up, down = F.count_if(F.col(y) >= threshold_bps), F.count_if(F.col(y) <= -threshold_bps)
    facts = rows.agg(F.avg(y).alias("mean"), F.stddev_pop(y).alias("std"), up.alias("up"), down.alias("down"), F.count(F.lit(1)).alias("_n"))
    return g.crossJoin(F.broadcast(facts)).withColumn("flat", F.col("_n") - F.col("up") - F.col("down")).drop("_n")  # one row each


def standardized_by(rows: DataFrame, features: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Features less the mean of their key's training rows over their population deviation (1 where that is 0)."""
    by = list(by)
    stats = rows.where("part = 'train'").groupBy(*by).agg(*[F.avg(c).alias(f"_m_{c}") for c in features], *[F.stddev_pop(c).alias(f"_s_{c}") for c in features])
    out = rows.join(F.broadcast(stats), by)  # one row a key
    return out.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0) for c in features}).drop(*[f"_{k}_{c}" for k in "ms" for c in features])


def grouped_models(rows: DataFrame, features: Sequence[str], up: Column, by: Sequence[str], l2: float = 1.0, least: int = 100, rounds: int = 25, tolerance: float = 1e-6) -> DataFrame:
    """A ridge logistic model for each key (intercept not penalised): by..., n_train, n_test, reason, weights (the intercept first).
    Keys that can't be fitted are listed with the reason and no weights.

    All keys take a step of Newton's method together: a round sums each key's gradient and Hessian over the
    training rows where they are, and solves one small system a key.  It ends when no weight moves by ``tolerance``."""
    by, d = list(by), len(features) + 1
    data = saved(rows.select(*by, (F.col("part") == "train").alias("_train"), F.when(F.col("part") == "test", 1).alias("_test"), up.cast("double").alias("_y"), F.array(F.lit(1.0), *[F.col(c).cast("double") for c in features]).alias("_x")))
    train = data.where("_train").select(*by, "_y", "_x")
    counts = data.groupBy(*by).agg(F.count_if("_train").alias("n_train"), F.count("_test").alias("n_test"), F.sum(F.when(F.col("_train"), F.col("_y"))).alias("_up"))
    why = F.when(F.col("n_train") < least, "few training rows").when(F.col("n_test") < least, "few test rows").when((F.col("_up") == 0) | (F.col("_up") == F.col("n_train")), "one class")
    counts = saved(counts.withColumn("reason", why).drop("_up"))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)
    weights = counts.where("reason is null").select(*by, F.array(*[F.lit(0.0)] * d).alias("weights"), F.lit(1.0).alias("step"))
    pairs = [(i, j) for i in range(d) for j in range(i, d)]

    def solve(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        penalty = np.eye(d) * l2
        penalty[0, 0] = 0.0
        for g in groups:
            out, steps = [], []
            for sums, w in zip(g["_sums"], g["weights"], strict=True):
                w, h = np.array(w), np.zeros((d, d))
                for (i, j), v in zip(pairs, sums[d:], strict=True):
                    h[i, j] = h[j, i] = v
                step = np.linalg.lstsq(h + penalty, np.array(sums[:d]) - penalty @ w, rcond=None)[0]
                out.append((w + step).tolist())
                steps.append(float(np.abs(step).max()))
            yield g[by].assign(weights=out, step=steps)

    for _ in range(rounds):
        weights = saved(weights)
        if weights.where(F.col("step") >= tolerance).isEmpty():
            break
        z = F.aggregate(F.zip_with("weights", "_x", lambda w, x: w * x), F.lit(0.0), lambda s, v: s + v)
        p = 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-35.0)), F.lit(35.0))))
        x = train.join(F.broadcast(weights), by).withColumn("_p", p)  # one row a key
        x = x.withColumn("_v", F.greatest(F.col("_p") * (1 - F.col("_p")), F.lit(1e-8)))
        terms = [F.sum((F.col("_y") - F.col("_p")) * F.col("_x")[i]) for i in range(d)] + [F.sum(F.col("_v") * F.col("_x")[i] * F.col("_x")[j]) for i, j in pairs]
        sums = x.groupBy(*by).agg(F.array(*terms).alias("_sums"), F.first("weights").alias("weights"))
        weights = sums.mapInPandas(solve, f"{kinds}, weights array<double>, step double")
    return counts.join(weights.select(*by, "weights"), by, "left")


def model_scores(rows: DataFrame, features: Sequence[str], models: DataFrame, by: Sequence[str]) -> DataFrame:
    """``rows`` of keys that have a model, with ``score``."""
    known = models.where("weights is not null").select(*by, "weights")
    z = F.col("weights")[0]
    for i, c in enumerate(features):
        z = z + F.col("weights")[i + 1] * F.col(c)
    return rows.join(F.broadcast(known), list(by)).withColumn("score", 1 / (1 + F.exp(-z))).drop("weights")  # one row a key


def across(scored: DataFrame, models: DataFrame, y: str, cost_bps: float, by: str, tie: Sequence[str]) -> DataFrame:
    """by, n_train, n_test, reason, auc, drift, long, short, monotonicity, tradeable: each key's model on its test rows; keys without one keep their row."""
    test = saved(scored.where("part = 'test'").withColumn("_up", (F.col(y) > 0).cast("int")))
    found = auc(test, "score", "_up", [by]).select(by, "auc").join(ladder(test, "score", y, tie, [by]).drop("n"), by)
    best = F.greatest("long", "short") > cost_bps
    return models.drop("weights").join(found.withColumn("tradeable", best), by, "left")


def across_verdict(table: DataFrame) -> DataFrame:
    """One row: instruments, skipped, agree (on the sign of the long side's excess), p_value of so many by luck, tradeable, verdict."""
    used = F.col("auc").isNotNull()
    up = F.count_if(used & (F.col("long") > 0))
    g = table.agg(F.count_if(used).alias("instruments"), F.count_if(~used).alias("skipped"), up.alias("_up"), F.count_if(F.coalesce("tradeable", F.lit(False))).alias("tradeable"))
    agree = F.greatest(F.col("_up"), F.col("instruments") - F.col("_up"))
    made = g.withColumn("agree", agree).withColumn("p_value", F.when(F.col("instruments") > 0, binomial_tail(F.col("agree"), F.col("instruments"))))
    verdict = F.when(F.col("instruments") == 0, "nothing to evaluate").when(F.col("p_value") > 0.05, "sign not consistent").when(F.col("tradeable") == 0, "consistent, no edge after costs").otherwise("consistent and tradeable")
    return made.select("instruments", "skipped", "agree", "p_value", "tradeable", verdict.alias("verdict"))
