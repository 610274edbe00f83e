"""How late received messages are: by hour, by day, by second."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketframe.operators.timeseries import restamp

#: What ``stats`` gives as quantiles.
QUANTILES = ("p50", "p90", "p99", "venue_p90", "after_p90")


def split(messages: DataFrame, by: Sequence[str], at: str, order: Sequence[str], stamp: str) -> DataFrame:
    """``messages`` with lag (received less stamp) and its two parts: venue, how far the stamp is behind the freshest one delivered so far on
    the same connection (``by``), and after, how old that freshest one is.  Messages without a stamp have none of the three."""
    s = restamp(messages, stamp, by, at, order, "_freshest")
    stamped = F.col(stamp).isNotNull()
    return s.withColumns({"lag": F.col(at) - F.col(stamp), "venue": F.when(stamped, F.col("_freshest") - F.col(stamp)), "after": F.when(stamped, F.col(at) - F.col("_freshest"))}).drop("_freshest")


def stats(messages: DataFrame, by: Sequence[str], late_ms: int) -> DataFrame:
    """by..., n, p50, p90, p99, most, least, late (the share above ``late_ms``), venue_p90, after_p90 of stamped messages.
    Quantiles are exact: what a task sends on for a group is its distinct lags with their counts."""
    cut = messages.where("lag is not null").groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.percentile("lag", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99))).alias("_p"), F.max("lag").alias("most"), F.min("lag").alias("least"),
        F.avg((F.col("lag") > late_ms).cast("int")).alias("late"), F.percentile("venue", F.lit(0.9)).alias("venue_p90"), F.percentile("after", F.lit(0.9)).alias("after_p90"),
    )
    return cut.select(*by, "n", *[F.col("_p")[i].alias(p) for i, p in enumerate(("p50", "p90", "p99"))], "most", "least", "late", "venue_p90", "after_p90")


def combined(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """``stats`` of larger groups from those of their parts: counts, extremes and the late share exactly; quantiles as means weighted by n, which
    are not the quantiles of the whole (``stats`` by the larger groups gives these)."""
    weighted = lambda c: (F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c)
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), F.max("most").alias("most"), F.min("least").alias("least"), weighted("late"), *[weighted(c) for c in QUANTILES])


def by_second(messages: DataFrame, by: Sequence[str], at: str) -> DataFrame:
    """by..., second, messages (stamped or not), most (the largest lag, null where none is stamped); seconds without a message have no row."""
    return messages.groupBy(*by, F.floor(F.col(at) / 1000).alias("second")).agg(F.count(F.lit(1)).alias("messages"), F.max("lag").alias("most"))
