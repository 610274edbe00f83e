"""Queries over archives, files, costs, tags, pairs, accounts and scores, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.functions import fees, prices
from marketframe.operators.saved import shared_folder
from marketframe.plans import carry, limits, signal
from marketframe.plans.event_queries import _RAW, _raw
from marketframe.plans.study_queries import _ROWS, _rows
from marketframe.sources import archive, loaders, views

HOUR, DAY = 3_600_000, 86_400_000
DAY_ONE = 1_704_067_200_000


def _path(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def archive_records(spark: SparkSession, d: str) -> DataFrame:
    """Lines with the path of their file, each 31st cut short, decoded: records by instrument, day, channel, hour and restart."""
    r = _raw(spark, d)
    line = F.concat(F.lit('{"t": '), F.col("t"), F.lit(', "n": '), F.col("n"), F.lit(', "m": {"x": "'), F.regexp_replace("m", '"', "'"), F.lit('"}}'))
    line = F.when(F.col("n") % 31 == 0, F.substring(line, 1, 20)).otherwise(line)
    day = F.date_format(F.timestamp_millis("t"), "yyyy-MM-dd")
    path = F.concat(F.lit("/data/"), F.col("instrument"), F.lit("/raw/"), day, F.lit("/book-top-"), F.date_format(F.timestamp_millis("t"), "HH"), F.when(F.col("n") % 5 == 0, ".r002").otherwise(""), F.lit(".jsonl.gz"))
    good = archive.events(r.select(line.alias("line"), path.alias("path")))
    return good.groupBy("instrument", F.col("day").cast("string").alias("day"), "channel", "hour", "restart").agg(F.count(F.lit(1)).alias("records"), F.sum("t").alias("t_sum"), F.sum("n").alias("n_sum"), F.sum(F.octet_length("m")).alias("bytes"))


def archive_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Distinct messages by the bytes that were archived, by instrument."""
    r = _raw(spark, d)
    line = F.concat(F.lit('{"t": '), F.col("t"), F.lit(', "n": '), F.col("n"), F.lit(', "m": '), F.to_json(F.struct(F.col("m").alias("x"))), F.lit("}"))
    return r.select("instrument", F.md5(archive.message_bytes(line)).alias("frame")).groupBy("instrument").agg(F.countDistinct("frame").alias("frames"), F.count(F.lit(1)).alias("n"))


def archive_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Events, their times drawn together into two days, written as an archive by instrument, day, channel and hour, and read back from its folders."""
    folder = _path(spark, "archive")
    dense = F.lit(DAY_ONE) + F.floor((F.col("t") - DAY_ONE) / 15)
    archive.write_archive(_raw(spark, d).select("instrument", F.lit("raw").alias("channel"), dense.alias("t"), "n", "m"), folder)
    back = spark.read.schema("t long, n long, m string, instrument string, day date, channel string, hour int").json(folder)
    return back.groupBy("instrument", F.col("day").cast("string").alias("day"), "hour").agg(F.count(F.lit(1)).alias("records"), F.sum("t").alias("t_sum"))


def repeated_append(spark: SparkSession, d: str) -> DataFrame:
    """What an append of all contracts adds to a table that holds those of each 3rd day."""
    rows = views.contracts(spark, d)
    there = rows.where("opens_ms / 86400000 % 3 = 0")
    return archive.rejected_rows(rows, there, ["market_id", "row_id"]).groupBy("fee_tier").agg(F.count(F.lit(1)).alias("n"), F.sum("row_id").alias("ids"))


def panel_files(spark: SparkSession, d: str) -> DataFrame:
    """The weekly panel written as CSV in its one schema and read back; thin weeks aren't complete."""
    folder = _path(spark, "panel")
    bars = views.daily_bars(spark, d).withColumn("rv_bps", F.lit(None).cast("double")).withColumn("trades", F.col("trades").cast("double")).withColumn("minutes", F.col("minutes").cast("double"))
    loaders.write_panel(bars, folder, "csv")
    back = loaders.read_panel(spark, folder)
    return back.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count_if("complete").alias("complete"), F.round(F.sum("quote_volume"), 2).alias("volume"), F.count("rv_bps").alias("rv"), F.round(F.sum("funding_bps"), 6).alias("funding"))


def outside_factor(spark: SparkSession, d: str) -> DataFrame:
    """An outside factor under other names, placed on the panel: how many rows found a place, by symbol."""
    panel = views.daily_bars(spark, d)
    factor = panel.where("trades > 4").select("date", F.concat(F.lit("1000"), F.regexp_replace("symbol", "#", ""), F.lit("-USDT")).alias("symbol"), F.col("trades").cast("double").alias("value"))
    placed, _ = loaders.outside_factor(panel, factor, "crowd", lambda s: prices.canonical(F.regexp_replace(s, "#", "")))
    return placed.groupBy("symbol").agg(F.count("crowd").alias("placed"), F.count(F.lit(1)).alias("n"), F.sum("crowd").alias("total"))


def outside_factor_report(spark: SparkSession, d: str) -> DataFrame:
    panel = views.daily_bars(spark, d).where("trades > 2")
    factor = views.daily_bars(spark, d).select("date", F.concat("symbol", F.lit("USDT")).alias("symbol"), F.lit(1.0).alias("value"))
    return loaders.outside_factor(panel, factor, "crowd", prices.canonical)[1]


def symbol_costs(spark: SparkSession, d: str) -> DataFrame:
    """Taker fee and half the measured spread of each part; parts without a measured spread get the default."""
    part = views.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("symbol"))
    spreads = views.fills(spark, d).where("price > 10").groupBy(F.col("market_id").cast("string").alias("symbol")).agg((F.max("price") - F.min("price")).cast("double").alias("spread_bps"))
    return loaders.costs(part, spreads, 6.0, 16.0)[0]


def candle_days(spark: SparkSession, d: str) -> DataFrame:
    """Candles that are confirmed and in order, by symbol, and how many of them traded."""
    bars = views.daily_bars(spark, d)
    broken = F.col("date_idx") % 10 == 0
    c = bars.select("symbol", "close", F.when(broken, F.col("low") / 2).otherwise(F.col("high")).alias("high"), "low", F.when(F.col("date_idx") % 7 == 0, F.lit(0.0)).otherwise(F.col("quote_volume")).alias("quote_volume"), F.when(F.col("date_idx") % 7 == 0, F.lit(None).cast("long")).otherwise(F.col("trades")).alias("trades"), (F.col("date_idx") % 4 != 0).alias("confirmed"))
    return loaders.sound_candles(c).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("minutes") > 0).cast("int")).alias("traded"))


def scalar_quotes(spark: SparkSession, d: str) -> DataFrame:
    """De-vigged odds, a front end's fee, a round trip's cost, sizes in whole lots, and the chance of a row of hits by luck."""
    c = views.contracts(spark, d)
    odds = lambda x: (100 / F.col(x)).cast("double")
    return c.select(
        "row_id", F.round(prices.devig(odds("entry"), (100 / (102 - F.col("entry"))).cast("double")), 6).alias("fair"), F.round(fees.builder_fee(F.col("entry") * F.col("size").cast("double"), (F.col("row_id") % 200).cast("double"), F.when(F.col("row_id") % 2 == 0, "maker").otherwise("taker")), 6).alias("builder"),
        F.round(fees.round_trip_bps(F.lit(0.0006), F.lit(0.0002), (F.col("signal") / 10).cast("double")), 6).alias("round_trip"), F.round(prices.round_down(F.col("entry") / 7, F.lit(0.25)), 6).alias("lots"),
        F.round(prices.binomial_tail(F.col("signal") % 9, F.lit(8)), 8).alias("luck"), F.concat(F.lit("label_"), F.lit(prices.horizon_tag(0.5))).alias("column"),
    )


def window_tickers(spark: SparkSession, d: str) -> DataFrame:
    """Names of hourly windows from their close in New York, by hour of the tape (no clock change lies in the tape's month)."""
    t = views.tape(spark, d)
    close = prices.window_start((F.col("ts_ms") / 1000).cast("long"), 3600) + 3600
    return t.groupBy(prices.window_ticker("HOUR", F.timestamp_seconds(close.cast("long"))).alias("ticker")).agg(F.count(F.lit(1)).alias("n"))


def _pair_fills(spark: SparkSession, d: str) -> DataFrame:
    f = views.fills(spark, d)
    leg = F.when(F.col("n") % 3 == 0, "p").when(F.col("n") % 3 == 1, "s").otherwise("u")
    ident = F.when(F.col("n") % 11 == 0, F.concat(F.lit("manual"), F.col("n").cast("string"))).otherwise(F.concat(F.lit("carry"), F.lower(F.hex("market_id")), leg, F.col("n").cast("string")))
    return f.select(ident.alias("client_id"), F.when(F.col("n") % 3 == 0, "sell").otherwise("buy").alias("side"), F.col("price").cast("double").alias("price"), "size", "fee", "ts_ms")


def leg_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Perpetual and spot legs joined by their tag."""
    p = carry.leg_totals(_pair_fills(spark, d))
    return p.select("tag", "perp", "spot", F.round("perp_price", 6).alias("perp_price"), F.round("spot_price", 6).alias("spot_price"), "fees", "opened_ms", F.round("delta_share", 6).alias("delta_share"), F.round("basis_bps", 4).alias("basis_bps"))


def carry_plans(spark: SparkSession, d: str) -> DataFrame:
    part = views.table(spark, d, "part")
    k = F.col("p_partkey")
    m = part.select(k.alias("market_id"), F.lit(0.5).alias("perp_lot"), F.lit(0.001).alias("spot_fee"), F.lit(0.0006).alias("perp_fee"), F.col("p_retailprice").alias("price"), (2 + k % 4).cast("double").alias("leverage"), ((k % 21 - 5) / 10).alias("rate_bps"), (k % 3).cast("double").alias("least"))
    made = limits.carry_plan(m, F.lit(2500.0), 14.0, 3.0)
    return made.select("market_id", "perp_size", F.round("spot_size", 6).alias("spot_size"), F.round("capital", 4).alias("capital"), F.round("income_bps", 6).alias("income_bps"), F.round("cost_bps", 6).alias("cost_bps"), F.concat_ws("; ", "reasons").alias("reasons"))


def closed_scorecards(spark: SparkSession, d: str) -> DataFrame:
    o = views.contracts(spark, d)
    k = F.col("row_id")
    c = o.select("row_id", (k % 40).cast("double").alias("planned_bps"), (k % 90).cast("double").alias("funding"), (k % 7).cast("double").alias("fees"), (k % 31 - 15).cast("double").alias("price_pnl"), (1000 + F.col("entry") * 10).cast("double").alias("notional"), ((F.col("resolves_ms") - F.col("opens_ms")) / DAY).alias("days"))
    s = limits.scorecard(c)
    return s.select("row_id", "net", *[F.round(x, 5).alias(x) for x in ("net_bps", "bps_a_day", "against_plan")])


def position_breaches(spark: SparkSession, d: str) -> DataFrame:
    """Positions close to liquidation, or down by more than 50,000, at three marks of their coin."""
    p = views.positions(spark, d)
    marks = p.groupBy("coin").agg(F.max("mark_px").alias("m")).select("coin", F.explode(F.array(*[F.struct(F.lit(i).alias("step"), (F.col("m") * x).alias("mark_px")) for i, x in enumerate((0.97, 1.0, 1.03))])).alias("s")).select("coin", "s.*")
    b = limits.breaches(p.drop("mark_px"), marks, 0.05, -50_000.0)
    return b.select("user", "step", F.round("pnl", 2).alias("pnl"), F.round("distance", 6).alias("distance"))


def account_moves(spark: SparkSession, d: str) -> DataFrame:
    """States of accounts whose positions changed: customers' orders as states, two coins each."""
    o = views.contracts(spark, d)
    one = lambda coin, size: F.struct(F.lit(coin).alias("coin"), size.cast("double").alias("size"))
    a, b = one("A", F.col("signal") % 2), one("B", F.lit(1))
    states = o.select(F.col("market_id").alias("user"), F.struct("opens_ms", "row_id").alias("t"), F.when(F.col("row_id") % 2 == 0, F.array(a, b)).otherwise(F.array(b, a)).alias("positions"))
    return limits.account_changes(states).groupBy("user").agg(F.count(F.lit(1)).alias("changes"))


def stalest_accounts(spark: SparkSession, d: str) -> DataFrame:
    p = views.positions(spark, d)
    a = p.select("user", F.when(F.col("user") % 50 != 0, F.col("observed_ms")).alias("last_polled_ms"), F.col("position_value").alias("notional"))
    return limits.stalest(a, 200_000_000, 40).select("user", F.round("notional", 2).alias("notional"))


def label_description(spark: SparkSession, d: str) -> DataFrame:
    s = signal.describe(_rows(spark, d), "y", HOUR, 5.0)
    return s.select("n", "effective_n", F.round("span_h", 4).alias("span_h"), F.round("interval_ms", 4).alias("interval_ms"), F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "up", "down", "flat")


def usable_features(spark: SparkSession, d: str) -> DataFrame:
    """Valid, warm and finite feature rows, by instrument, and the features that vary."""
    rows = _rows(spark, d)
    began = rows.groupBy("instrument").agg(F.min("ts_ms").alias("_a"))
    marked = rows.join(F.broadcast(began), "instrument").withColumn("history_seconds", (F.col("ts_ms") - F.col("_a")) / 1000).withColumn("is_valid", F.col("n") % 17 != 0)
    marked = marked.withColumn("flat", F.lit(1.0)).withColumn("obi_1", F.when(F.col("n") % 19 == 0, F.lit(float("nan"))).otherwise(F.col("obi_1")))
    fine, names = signal.matrix(marked, ["spread_bps", "obi_1", "flat"], "y", 7200)
    return fine.groupBy("instrument").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("ids"), F.lit(",".join(names)).alias("features"))


_PF = f"""{views.FILL_SQL}, pf as (select lower(hex(market_id)) h, n % 3 = 0 perp, case when n % 3 = 0 then -size else size end::double s, size::double z, price * size::double paid, fee, ts_ms from fills where n % 11 <> 0)"""
ORACLES = {
    "archive_records": f"""with {_RAW} select instrument, strftime(make_timestamp(t * 1000), '%Y-%m-%d') as day, 'book-top' channel, (t // {HOUR} % 24)::int as hour, case when n % 5 = 0 then 2 else 0 end restart, count(*) records, sum(t)::bigint t_sum, sum(n)::bigint n_sum, sum(strlen(m) + 8)::bigint bytes from raw where n % 31 <> 0 group by 1, 2, 3, 4, 5""",
    "archive_bytes": f"with {_RAW} select instrument, count(distinct m) frames, count(*) n from raw group by 1",
    "archive_round_trip": f"with {_RAW}, dense as (select instrument, {DAY_ONE} + (t - {DAY_ONE}) // 15 t from raw) select instrument, strftime(make_timestamp(t * 1000), '%Y-%m-%d') as day, (t // {HOUR} % 24)::int as hour, count(*) records, sum(t)::bigint t_sum from dense group by 1, 2, 3",
    "repeated_append": f"with {views.CONTRACT_SQL} select fee_tier, count(*) n, sum(row_id)::bigint ids from contracts where opens_ms // 86400000 % 3 <> 0 group by 1",
    "panel_files": f"with {views.PANEL_SQL} select symbol, count(*) n, sum((minutes >= 1430)::int)::bigint complete, round(sum(quote_volume), 2) volume, 0::bigint rv, round(sum(funding_bps), 6) funding from panel group by 1",
    "outside_factor": f"with {views.PANEL_SQL} select symbol, sum((trades > 4)::int)::bigint placed, count(*) n, sum(case when trades > 4 then trades end)::double total from panel group by 1",
    "outside_factor_report": f"with {views.PANEL_SQL} select sum((trades > 2)::int)::bigint matched, sum((trades <= 2)::int)::bigint dropped from panel",
    "symbol_costs": f"with {views.FILL_SQL}, s as (select market_id, (max(price) - min(price))::double w from fills where price > 10 group by 1) select p_partkey::varchar symbol, coalesce(6.0::double + w / 2, 16.0::double) cost_bps from part left join s on market_id = p_partkey",
    "candle_days": f"with {views.PANEL_SQL} select symbol, count(*) n, sum((date_idx % 7 <> 0)::int)::bigint traded from panel where date_idx % 4 <> 0 and close > 0 and low > 0 and case when date_idx % 10 = 0 then low / 2 else high end >= low group by 1",
    "scalar_quotes": f"""with {views.CONTRACT_SQL}, bt(k, p) as (select k, sum(c) over (order by k desc) / 256.0::double from (values (0, 1), (1, 8), (2, 28), (3, 56), (4, 70), (5, 56), (6, 28), (7, 8), (8, 1)) v(k, c))
select row_id, round((entry / 100.0::double) / (entry / 100.0::double + (102 - entry) / 100.0::double), 6) fair, round(entry * 10 * least(row_id % 200, case when row_id % 2 = 0 then 50 else 100 end) / 10000.0::double, 6) builder, round(8 + signal / 10.0::double, 6) round_trip, round(floor(entry / 7.0::double / 0.25::double) * 0.25::double, 6) lots, round(p, 8) luck, 'label_0p5s' as column from contracts join bt on k = signal % 9""",
    "window_tickers": f"with {views.TAPE_SQL} select 'HOUR-' || upper(strftime(make_timestamp((ts_ms // {HOUR} + 1 - 5) * {HOUR} * 1000), '%y%b%d%H%M')) ticker, count(*) n from tape group by 1",
    "leg_pairs": f"""with {_PF}, g as (select 'carry' || h tag, sum(case when perp then s else 0 end) perp, sum(case when not perp then s else 0 end) spot, sum(case when perp then paid end) / nullif(sum(case when perp then z end), 0) perp_price, sum(case when not perp then paid end) / nullif(sum(case when not perp then z end), 0) spot_price, sum(fee)::bigint fees, min(ts_ms) opened_ms from pf group by h)
select tag, perp, spot, round(perp_price, 6) perp_price, round(spot_price, 6) spot_price, fees, opened_ms, round(abs(perp + spot) / nullif(abs(spot), 0), 6) delta_share, round((spot_price - perp_price) / spot_price * 10000, 4) basis_bps from g""",
    "carry_plans": """with m as (select p_partkey k, p_retailprice price, (2 + p_partkey % 4)::double lev, (p_partkey % 21 - 5) / 10.0::double rate, (p_partkey % 3)::double least_ from part), s as (select *, floor(2500.0::double / (price * (1 + 1 / lev)) / 0.5::double) * 0.5::double perp from m),
c as (select *, perp / (1 - 0.001::double) spot, rate * 3 * 14 income, 2 * (0.001::double + 0.0006::double) * 10000 cost from s)
select k market_id, perp perp_size, round(spot, 6) spot_size, round(spot * price + perp * price / lev, 4) capital, round(income, 6) income_bps, round(cost, 6) cost_bps, concat_ws('; ', case when perp < least_ then 'too small' end, case when rate <= 0 then 'no carry' end, case when income <= cost then 'does not pay its cost' end) reasons from c""",
    "closed_scorecards": f"""with {views.CONTRACT_SQL}, c as (select row_id, row_id % 40 planned, row_id % 90 funding, row_id % 7 fees, row_id % 31 - 15 pnl, (1000 + entry * 10)::double notional, (resolves_ms - opens_ms) / 86400000.0::double as days from contracts), s as (select *, (funding + pnl - fees)::double net from c)
select row_id, net, round(net / notional * 10000, 5) net_bps, round(funding / notional * 10000 / s.days, 5) bps_a_day, round(net / notional * 10000 / nullif(planned, 0), 5) against_plan from s""",
    "position_breaches": f"""with {views.POSITION_SQL}, m as (select coin, max(mark_px) m from positions group by 1), b as (select "user", step, size, entry_px, liquidation_px l, m * x mark from positions join m using (coin), (values (0, 0.97::double), (1, 1.0::double), (2, 1.03::double)) v(step, x)),
r as (select "user", step, (mark - entry_px) * size pnl, case when size >= 0 then mark - l else l - mark end / mark distance from b) select "user", step, round(pnl, 2) pnl, round(distance, 6) distance from r where distance < 0.05::double or pnl < -50000""",
    "account_moves": f"with {views.CONTRACT_SQL}, s as (select market_id, signal % 2 as k, lag(signal % 2) over (partition by market_id order by opens_ms, row_id) p from contracts) select market_id as \"user\", count(*) changes from s where p is null or p <> k group by 1",
    "stalest_accounts": f"""with {views.POSITION_SQL} select "user", round(position_value, 2) notional from positions order by case when "user" % 50 = 0 then 'infinity'::double else (200000000 - observed_ms)::double end * sqrt(position_value) desc, "user" limit 40""",
    "label_description": f"""with {_ROWS}, g as (select count(*) n, count(distinct ts_ms) u, (max(ts_ms) - min(ts_ms))::double span from rows_), i as (select *, span / (u - 1) iv from g)
select n, greatest(1, floor(u / greatest(1, {HOUR}.0::double / iv))::bigint) effective_n, round(span / {HOUR}, 4) span_h, round(iv, 4) interval_ms, round((select avg(y) from rows_), 4) mean, round((select stddev_pop(y) from rows_), 4) std, (select count(*) from rows_ where y >= 5) up, (select count(*) from rows_ where y <= -5) down, (select count(*) from rows_ where y > -5 and y < 5) flat from i""",
    "usable_features": f"with {_ROWS}, a as (select instrument, min(ts_ms) a from rows_ group by 1) select instrument, count(*) n, sum(n)::bigint ids, 'spread_bps,obi_1' features from rows_ join a using (instrument) where n % 17 <> 0 and n % 19 <> 0 and ts_ms - a >= 7200000 group by 1",
}
QUERIES = [
    archive_records, archive_bytes, archive_round_trip, repeated_append, panel_files, outside_factor, outside_factor_report, symbol_costs, candle_days, scalar_quotes, window_tickers, leg_pairs, carry_plans, closed_scorecards,
    position_breaches, account_moves, stalest_accounts, label_description, usable_features,
]
