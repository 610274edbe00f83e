"""Market-shaped views of the given tables, and the same views as SQL.

Money is summed in whole cents and quantities as whole numbers, so that sums
don't depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketframe.operators.running import running

MS_DAY = 86_400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.timestamp_diff("MILLISECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), ts)


def nearest_ms(ts: Column) -> Column:
    """``epoch_ms`` to the nearest millisecond, halves away from 1970, as DuckDB's epoch_ms has it."""
    us = F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), ts)
    return F.call_function("div", us + F.when(us < 0, -500).otherwise(500), F.lit(1000))


def cents(x: str) -> Column:
    return F.round(F.col(x) * 100).cast("long")


def daily_bars(spark: SparkSession, sf_dir: str, unit: str = "week") -> DataFrame:
    """One bar for each period and brand: open, high, low, close, quote_volume, trades,
    taker_buy_frac, minutes, funding_bps, funding_periods, date_idx."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    line = table(spark, sf_dir, "lineitem").select(
        "l_partkey", F.to_date(F.date_trunc(unit, "l_shipdate")).alias("date"), F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("at"),
        cents("l_extendedprice").alias("c"), F.col("l_quantity").cast("long").alias("q"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.round(F.col("l_discount") * 100).cast("long").alias("d"), (F.col("l_returnflag") == "A").cast("long").alias("buy"),
    )
    bars = line.join(part, line.l_partkey == part.p_partkey).groupBy("date", F.col("p_brand").alias("symbol")).agg(
        F.min_by("price", "at").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        (F.sum("c") / 100 / F.sum("q")).alias("close"), (F.sum("c") / 100).alias("quote_volume"), F.count(F.lit(1)).alias("trades"),
        (F.sum("buy") / F.count(F.lit(1))).alias("taker_buy_frac"), F.when(F.count(F.lit(1)) >= 3, 1440).otherwise(0).alias("minutes"),
        ((F.sum("d") / F.count(F.lit(1)) / 100 - 0.05) * 1000).alias("funding_bps"), F.count(F.lit(1)).cast("int").alias("funding_periods"),
    )
    return index_dates(bars)


def index_dates(bars: DataFrame) -> DataFrame:
    """date_idx: the place of a date among all dates that occur (there are few; bars are many)."""
    dates = bars.select("date").distinct().withColumn("date_idx", (F.dense_rank().over(Window.orderBy("date")) - 1).cast("long"))
    return bars.join(F.broadcast(dates), "date")


PANEL_SQL = """
line as (select p_brand symbol, date_trunc('week', l_shipdate)::date date, (l_shipdate, l_orderkey, l_linenumber) at_, round(l_extendedprice * 100)::bigint c, l_quantity::bigint q,
    l_extendedprice / l_quantity price, round(l_discount * 100)::bigint d, case when l_returnflag = 'A' then 1 else 0 end buy from lineitem join part on l_partkey = p_partkey),
bars as (select date, symbol, arg_min(price, at_) open, max(price) high, min(price) low, sum(c)::double / 100 / sum(q)::double as close, sum(c)::double / 100 quote_volume, count(*) trades,
    sum(buy)::double / count(*) taker_buy_frac, case when count(*) >= 3 then 1440 else 0 end as minutes, (sum(d)::double / count(*) / 100 - 0.05::double) * 1000 funding_bps, count(*)::int funding_periods from line group by 1, 2),
panel as (select *, dense_rank() over (order by date) - 1 date_idx from bars)"""


def funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settlements: symbol, ts_ms, rate_bps; a stamp lies a few ms off its hour."""
    line = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    ts = epoch_ms(F.col("l_shipdate")) + F.col("l_linenumber") * 4 * 3_600_000 + F.pmod("l_orderkey", F.lit(7))
    return line.join(part, line.l_partkey == part.p_partkey).select(F.col("p_brand").alias("symbol"), ts.cast("long").alias("ts_ms"), ((F.round(F.col("l_tax") * 100) - 4) * 10).alias("rate_bps"))


FUNDING_SQL = """
funding as (select p_brand symbol, epoch_ms(l_shipdate) + l_linenumber * 4 * 3600000 + l_orderkey % 7 ts_ms, (round(l_tax * 100) - 4) * 10 rate_bps from lineitem join part on l_partkey = p_partkey)"""


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("long")


def tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades: instrument, n, ts_ms, price (whole cents), size, is_buy."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("U"), F.pmod("user_id", F.lit(4)).cast("string")).alias("instrument"), F.col("event_id").alias("n"), epoch_ms(F.col("ts")).alias("ts_ms"),
        (10000 + F.round("value")).cast("long").alias("price"), (1 + _k()).alias("size"), F.col("event_type").isin("purchase", "click").alias("is_buy"),
    )


TAPE_SQL = """
tape as (select 'U' || (user_id % 4) instrument, event_id n, epoch_us(ts) // 1000 ts_ms, (10000 + round(value))::bigint price, 1 + (props->>'$.k')::bigint size, event_type in ('purchase', 'click') is_buy from events)"""


def book_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Touch updates: instrument, n, ts_ms, bid, ask (whole cents), bid_size, ask_size."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "signup")).withColumn("k", _k())
    inst = F.concat(F.lit("U"), F.pmod("user_id", F.lit(4)).cast("string"))
    price = (10000 + F.round("value")).cast("long")
    return e.select(
        inst.alias("instrument"), F.col("event_id").alias("n"), epoch_ms(F.col("ts")).alias("ts_ms"), (price - 1 - F.pmod("k", F.lit(5))).alias("bid"), (price + F.pmod("k", F.lit(7))).alias("ask"),
        (1 + F.pmod("k", F.lit(13))).alias("bid_size"), (1 + F.pmod("k", F.lit(11))).alias("ask_size"),
    )


def numbered_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``book_top`` with seq and prev_seq; after each 49 updates the feed skips a number, which is a gap."""
    numbered = running(book_top(spark, sf_dir), ["instrument"], "ts_ms", ["ts_ms", "n"], {"seq": ("sum", F.lit(1).cast("long"))})
    return numbered.withColumn("seq", F.col("seq") + F.floor((F.col("seq") - 1) / 49)).withColumn("prev_seq", F.col("seq") - 1)


BOOK_SQL = """
touch_all as (select 'U' || (user_id % 4) instrument, event_id n, epoch_us(ts) // 1000 ts_ms, (10000 + round(value))::bigint - 1 - (props->>'$.k')::bigint % 5 bid, (10000 + round(value))::bigint + (props->>'$.k')::bigint % 7 ask,
    1 + (props->>'$.k')::bigint % 13 bid_size, 1 + (props->>'$.k')::bigint % 11 ask_size from events where event_type in ('view', 'signup')),
touch as (select *, k_ + (k_ - 1) // 49 seq, k_ + (k_ - 1) // 49 - 1 prev_seq from (select *, row_number() over (partition by instrument order by ts_ms, n) k_ from touch_all))"""


def book_messages(events: DataFrame) -> DataFrame:
    """A feed of book messages made of events (a table or a stream): instrument, ts_ms, n, action, seq, prev_seq, bids, asks.  Signups are snapshots
    of three levels a side, views change two, and an event whose number 37 divides names the one before it, which
    is a gap unless that was the instrument's."""
    e = events.where(F.col("event_type").isin("view", "signup")).withColumn("k", _k())
    mid, n, snap = 100 + F.pmod("k", F.lit(4)), F.col("event_id").cast("long"), F.col("event_type") == "signup"

    def levels(sign: int) -> Column:
        level = lambda i, size: F.struct((mid + sign * i).cast("double").alias("price"), size.cast("double").alias("size"))
        return F.when(snap, F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: level(i, i + 1))).otherwise(F.transform(F.sequence(F.lit(1), F.lit(2)), lambda i: level(i, F.pmod(F.col("k") + i - 1, F.lit(5)))))

    return e.select(
        F.concat(F.lit("U"), F.pmod("user_id", F.lit(4)).cast("string")).alias("instrument"), nearest_ms(F.col("ts")).alias("ts_ms"), n.alias("n"), F.when(snap, "snapshot").otherwise("update").alias("action"),
        n.alias("seq"), F.when(F.pmod(n, F.lit(37)) == 0, n - 1).cast("long").alias("prev_seq"), levels(-1).alias("bids"), levels(1).alias("asks"),
    )


MESSAGE_SQL = """
msg_ as (select 'U' || (user_id % 4) instrument, epoch_ms(ts) ts_ms, event_id n, event_type = 'signup' snap, (props->>'$.k')::bigint k, 100 + (props->>'$.k')::bigint % 4 mid, case when event_id % 37 = 0 then event_id - 1 end prev from events where event_type in ('view', 'signup')),
msg_g as (select *, sum(snap::int) over w epoch, not snap and prev is not null and prev <> lag(n) over w gap from msg_ window w as (partition by instrument order by ts_ms, n)),
msg as (select *, epoch > 0 and not coalesce(bool_or(gap) over (partition by instrument, epoch order by ts_ms, n), false) used from msg_g)"""


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event contracts with a decision each: market_id, row_id, opens_ms, resolves_ms, resolved_yes, entry and bid (cents of a dollar), signal (cents), fee_tier, size."""
    o = table(spark, sf_dir, "orders")
    opens = epoch_ms(F.col("o_orderdate"))
    entry = (5 + F.pmod(F.round("o_totalprice").cast("long"), F.lit(90))).cast("long")
    return o.select(
        F.col("o_custkey").alias("market_id"), F.col("o_orderkey").alias("row_id"), opens.alias("opens_ms"), (opens + (1 + F.pmod("o_orderkey", F.lit(400))) * MS_DAY).alias("resolves_ms"),
        (F.col("o_orderstatus") == "F").alias("resolved_yes"), entry.alias("entry"), (entry - 2).alias("bid"),
        F.pmod(F.conv(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 6), 16, 10).cast("long"), F.lit(100)).alias("signal"),
        F.when(F.col("o_orderpriority").startswith("1"), "fast").otherwise("default").alias("fee_tier"), F.lit(10).alias("size"),
    )


CONTRACT_SQL = """
contracts as (select o_custkey market_id, o_orderkey row_id, epoch_ms(o_orderdate) opens_ms, epoch_ms(o_orderdate) + (1 + o_orderkey % 400) * 86400000 resolves_ms, o_orderstatus = 'F' resolved_yes,
    5 + round(o_totalprice)::bigint % 90 entry, 3 + round(o_totalprice)::bigint % 90 bid, ('0x' || substr(md5(o_orderkey::varchar), 1, 6))::bigint % 100 signal,
    case when o_orderpriority like '1%' then 'fast' else 'default' end fee_tier, 10 size from orders)"""


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open positions: user, coin, size (signed), entry_px, liquidation_px (missing for some), position_value, mark_px, observed_ms."""
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("coin"))
    bal = cents("c_acctbal")
    size = (bal / 100).alias("size")
    entry = (100 + F.pmod("c_custkey", F.lit(37))).cast("double")
    mark = F.lit(110.0) + F.col("c_nationkey")
    liq = F.when(F.pmod("c_custkey", F.lit(7)) == 0, None).when(bal >= 0, mark * (60 + F.pmod("c_custkey", F.lit(45))) / 100).otherwise(mark * (98 + F.pmod("c_custkey", F.lit(45))) / 100)
    return c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).where(bal != 0).select(
        F.col("c_custkey").alias("user"), "coin", size, entry.alias("entry_px"), liq.alias("liquidation_px"), (F.abs(bal) / 100 * mark).alias("position_value"), mark.alias("mark_px"), (F.col("c_custkey") * 1000).alias("observed_ms"),
    )


POSITION_SQL = """
positions as (select c_custkey "user", n_name coin, round(c_acctbal * 100) / 100 size, (100 + c_custkey % 37)::double entry_px,
    case when c_custkey % 7 = 0 then null when round(c_acctbal * 100) >= 0 then (110.0::double + c_nationkey) * (60 + c_custkey % 45) / 100 else (110.0::double + c_nationkey) * (98 + c_custkey % 45) / 100 end liquidation_px,
    abs(round(c_acctbal * 100)) / 100 * (110.0::double + c_nationkey) position_value, 110.0::double + c_nationkey mark_px, c_custkey * 1000 observed_ms
  from customer join nation on c_nationkey = n_nationkey where round(c_acctbal * 100) <> 0)"""


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills of a ledger: market_id, n, ts_ms, side, price (cents), size, fee (cents)."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        F.col("l_partkey").alias("market_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("n"), epoch_ms(F.col("l_shipdate")).alias("ts_ms"),
        F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"), (1 + F.pmod(F.round("l_extendedprice").cast("long"), F.lit(99))).alias("price"),
        F.col("l_quantity").cast("long").alias("size"), F.round(F.col("l_tax") * 100).cast("long").alias("fee"),
    )


FILL_SQL = """
fills as (select l_partkey market_id, l_orderkey * 10 + l_linenumber n, epoch_ms(l_shipdate) ts_ms, case when l_returnflag = 'R' then 'sell' else 'buy' end side,
    1 + round(l_extendedprice)::bigint % 99 price, l_quantity::bigint size, round(l_tax * 100)::bigint fee from lineitem)"""
