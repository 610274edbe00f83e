"""Fees of event contracts and perpetuals, from small dated tables that are joined by broadcast."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Venue, tier, maker and taker coefficient of c * p * (1 - p), rounding up to the cent, same curve as.
CURVES = [
    ("alpha", "default", "0.0175", "0.07", True, None),
    ("alpha", "fast", "0.0000", "0.035", True, None),
    ("beta", "default", "0.0000", "0.00", False, None),
    ("beta", "fast", "0.0000", "0.0625", False, None),
]
CURVE_SCHEMA = "venue string, tier string, maker string, taker string, round_up boolean, same_as string"
#: Product, tier, maker and taker rate.
LADDER = [("perp", 0, "0.0002", "0.0006"), ("perp", 1, "0.00016", "0.0005"), ("perp", 2, "0.00014", "0.00045"), ("spot", 0, "0.0010", "0.0010"), ("spot", 1, "0.0008", "0.0009")]


def curves(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(CURVES, CURVE_SCHEMA)
    return rows.withColumn("maker", F.col("maker").cast("decimal(9,6)")).withColumn("taker", F.col("taker").cast("decimal(9,6)"))


def ladder(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(LADDER, "product string, tier int, maker string, taker string")
    return rows.withColumn("maker", F.col("maker").cast("decimal(9,6)")).withColumn("taker", F.col("taker").cast("decimal(9,6)"))


def curve_fee(coefficient: Column, price: Column, size: Column, round_up: Column) -> Column:
    """coefficient * p * (1 - p) * size, up to the whole cent for the order where the venue does so."""
    fee = (coefficient * price * (1 - price) * size).cast("decimal(28,8)")
    return F.when(round_up, F.ceil(fee, F.lit(2)).cast("decimal(28,8)")).otherwise(fee)


def with_fee(orders: DataFrame, table: DataFrame, price: str = "price", size: str = "size") -> DataFrame:
    """``orders`` (venue, tier, role, price, size) with their fee; an unknown tier fails the job."""
    joined = orders.join(F.broadcast(table.withColumn("_known", F.lit(True))), ["venue", "tier"], "left")
    known = F.when(F.col("_known"), F.when(F.col("role") == "maker", F.col("maker")).otherwise(F.col("taker")))
    coefficient = F.coalesce(known, F.raise_error(F.concat(F.lit("no fee tier "), F.col("venue"), F.lit("/"), F.col("tier"))).cast("decimal(9,6)"))
    return joined.withColumn("fee", curve_fee(coefficient, F.col(price), F.col(size), F.col("round_up"))).drop("_known", "maker", "taker", "round_up", "same_as")


def unknown_tiers(orders: DataFrame, table: DataFrame) -> DataFrame:
    return orders.join(F.broadcast(table), ["venue", "tier"], "left_anti").select("venue", "tier").distinct()


def builder_fee(notional: Column, bps: Column, role: Column, most_taker: float = 100.0, most_maker: float = 50.0) -> Column:
    """A front end's fee on notional, capped by role."""
    return notional * F.least(bps, F.when(role == "taker", most_taker).otherwise(most_maker)) / 10_000


def round_trip_bps(entry: Column, exit_: Column, spread: Column) -> Column:
    return (entry + exit_) * 10_000 + spread


def curve_violations(table: DataFrame, curve: Callable[[Column, Column, Column, Column], Column] = curve_fee) -> DataFrame:
    """What is wrong with a table of curves, over prices 0.00 to 1.00: venue, tier, problem.  ``curve`` gives the fee, as ``curve_fee`` does."""
    grid = table.withColumn("cent", F.explode(F.sequence(F.lit(0), F.lit(100)))).withColumn("p", F.col("cent").cast("decimal(9,6)") / 100)
    at = lambda c, p: curve(F.col(c), p, F.lit(1000), F.lit(False))  # of 1,000 contracts, before rounding to cents
    fee, other = at("taker", F.col("p")), 1 - F.col("p")
    uneven = (fee != at("taker", other)) | (at("maker", F.col("p")) != at("maker", other))
    facts = grid.groupBy("venue", "tier").agg(
        F.min((F.col("taker") >= F.col("maker")).cast("int")).alias("ordered"), F.max(F.when(F.col("p").isin(0, 1), fee)).alias("ends"),
        F.max_by("p", fee).alias("peak"), F.max("taker").alias("taker"), F.max("same_as").alias("same_as"), F.max(uneven.cast("int")).alias("uneven"),
        F.min(F.least("maker", "taker")).alias("least"),
    )
    facts = facts.withColumn("copies", F.count(F.lit(1)).over(Window.partitionBy("venue", "taker")))
    copies = F.col("copies")
    problems = F.array_compact(F.array(
        F.when(F.col("ordered") == 0, "maker above taker"), F.when(F.col("least") < 0, "negative"), F.when(F.col("uneven") == 1, "not symmetric"), F.when(F.col("ends") != 0, "fee at the ends"), F.when((F.col("taker") > 0) & (F.col("peak") != 0.5), "peak not at a half"),
        F.when((copies > 1) & F.col("same_as").isNull(), "duplicate curve"), F.when((copies == 1) & F.col("same_as").isNotNull(), "stale same_as"),
    ))
    return facts.withColumn("problem", F.explode(problems)).select("venue", "tier", "problem")


def ladder_violations(table: DataFrame) -> DataFrame:
    """Tiers that cost more than the tier below them, or whose maker pays more than the taker."""
    w = Window.partitionBy("product").orderBy("tier")
    marked = table.withColumn("worse", (F.col("taker") > F.lag("taker").over(w)) | (F.col("maker") > F.lag("maker").over(w))).withColumn("crossed", F.col("maker") > F.col("taker"))
    return marked.where("coalesce(worse, false) or crossed").select("product", "tier")


def tier_for(positions: DataFrame, tiers: DataFrame, by: str = "coin", size: str = "size") -> DataFrame:
    """Each position's margin tier: the one whose range holds its size, the last one above all, the first one below all.
    A coin has few tiers, so they travel as one sorted array a coin."""
    arrays = tiers.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("min_size", "max_size", "mmr"))).alias("tiers"))
    amount = F.abs(F.col(size))
    held = F.filter("tiers", lambda t: (amount >= t["min_size"]) & (amount <= t["max_size"]))
    chosen = F.coalesce(F.get(held, F.lit(0)), F.when(amount > F.element_at("tiers", -1)["max_size"], F.element_at("tiers", -1)), F.get("tiers", F.lit(0)))
    return positions.join(arrays, by, "left").withColumn("mmr", chosen["mmr"]).drop("tiers")
