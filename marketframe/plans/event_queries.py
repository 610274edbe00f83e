"""Queries over touch updates, trades and feeds, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.operators import book, features
from marketframe.operators import timeseries as T
from marketframe.plans import contracts as C
from marketframe.sources import views

HOUR = 3_600_000
BY = ["instrument"]


def trades_asof_touch(spark: SparkSession, d: str) -> DataFrame:
    touch = features.usable_touch(views.book_top(spark, d)).groupBy("instrument", "ts_ms").agg(F.max_by(F.struct("bid", "ask"), "n").alias("t")).select("instrument", "ts_ms", "t.*")
    return T.asof_join(views.tape(spark, d), touch, BY, "ts_ms", ["bid", "ask"], bucket=24 * HOUR).select("instrument", "n", "price", "bid", "ask")


def trades_asof_next_touch(spark: SparkSession, d: str) -> DataFrame:
    touch = features.usable_touch(views.book_top(spark, d)).groupBy("instrument", "ts_ms").agg(F.max_by(F.struct("bid", "ask"), "n").alias("t")).select("instrument", "ts_ms", "t.*")
    return T.asof_join(views.tape(spark, d), touch, BY, "ts_ms", ["bid", "ask"], forward=True, bucket=24 * HOUR).select("instrument", "n", "price", "bid", "ask")


def touch_features(spark: SparkSession, d: str) -> DataFrame:
    s = features.order_flow(features.snapshot(views.book_top(spark, d)))
    s = features.window_sums(s, ["ofi"], [HOUR, 6 * HOUR])
    return s.select("instrument", "n", "mid", F.round("spread_bps", 6).alias("spread_bps"), F.round("micro_bps", 6).alias("micro_bps"), F.round("obi_1", 6).alias("obi_1"), "ofi", F.col(f"ofi_{HOUR}").alias("ofi_1h"), F.col(f"ofi_{6 * HOUR}").alias("ofi_6h"))


def trade_flow(spark: SparkSession, d: str) -> DataFrame:
    t = features.trade_flow(views.tape(spark, d), [HOUR, 6 * HOUR])
    return t.select("instrument", "n", F.round(f"tfi_{HOUR}", 6).alias("tfi_1h"), F.col(f"volume_{HOUR}").alias("volume_1h"), F.col(f"trades_{HOUR}").alias("trades_1h"), F.round(f"tfi_{6 * HOUR}", 6).alias("tfi_6h"))


def _books(spark: SparkSession, d: str) -> DataFrame:
    """The book after each update, five levels a side; every 29th is crossed."""
    touch = views.book_top(spark, d)
    ask = F.when(F.col("n") % 29 == 0, F.col("bid") - 1).otherwise(F.col("ask"))
    levels = lambda price, size, sign: F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.struct((price + sign * i).cast("double").alias("price"), (size + i).cast("double").alias("size")))
    return touch.select("instrument", "n", "ts_ms", levels(F.col("bid"), F.col("bid_size"), -1).alias("bids"), levels(ask, F.col("ask_size"), 1).alias("asks"))


def feature_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The whole feature vector at each update and trade, with windows of hours, as the events are sparse."""
    tape = views.tape(spark, d)
    rates = tape.groupBy("instrument", (F.floor(F.col("ts_ms") / (8 * HOUR)) * 8 * HOUR).alias("ts_ms")).agg(F.count(F.lit(1)).alias("k"))
    rates = rates.select("instrument", "ts_ms", (F.col("k") / 10000).alias("rate"), (F.col("ts_ms") + 8 * HOUR).alias("settles_ms"))
    made = features.feature_snapshot(_books(spark, d), tape, rates, (HOUR, 6 * HOUR), (HOUR, 6 * HOUR, 12 * HOUR), (HOUR, 6 * HOUR, 12 * HOUR), (6 * HOUR, 12 * HOUR), (120, 60))
    names = [c for c in made.columns if c not in ("instrument", "n", "ts", "received_ts", "vol_regime", "is_valid", "trade_count", "book_age_ms")]
    short = {c: c for c in names}
    for h in (1, 6, 12):
        short |= {c: c.replace(str(h * HOUR), f"{h}h") for c in names if c.endswith(f"_{h * HOUR}")}
    return made.select("instrument", "n", "ts", "received_ts", *[F.round(c, 4).alias(short[c]) for c in names], "vol_regime", "trade_count", "book_age_ms", "is_valid")


def mid_returns(spark: SparkSession, d: str) -> DataFrame:
    touch = views.book_top(spark, d)
    rows = features.past_returns(features.snapshot(touch).select("instrument", "n", "ts_ms", "mid"), touch, [HOUR, 12 * HOUR])
    return rows.select("instrument", "n", F.round(f"ret_{HOUR}", 5).alias("ret_1h"), F.round(f"ret_{12 * HOUR}", 5).alias("ret_12h"))


def mid_volatility(spark: SparkSession, d: str) -> DataFrame:
    return features.realized_volatility(features.mids(views.book_top(spark, d)), 12 * HOUR, "rv").select("instrument", "ts_ms", F.round("rv", 4).alias("rv_12h"))


def mid_regime(spark: SparkSession, d: str) -> DataFrame:
    rv = features.realized_volatility(features.mids(views.book_top(spark, d)), 12 * HOUR, "rv").withColumn("rv", F.round("rv", 4))
    return features.volatility_regime(rv, "rv", 120, 60).groupBy("instrument", "regime").agg(F.count(F.lit(1)).alias("n"))


def forward_labels(spark: SparkSession, d: str) -> DataFrame:
    touch = views.book_top(spark, d)
    rows = features.forward_labels(features.snapshot(touch).select("instrument", "n", "ts_ms", "mid"), touch, [HOUR, 6 * HOUR], 5.0)
    return rows.select("instrument", "n", F.col(f"fwd_{HOUR}").alias("fwd_1h"), F.col(f"fwd_{6 * HOUR}").alias("fwd_6h"))


def sequence_gaps(spark: SparkSession, d: str) -> DataFrame:
    g = book.gap_islands(views.numbered_touch(spark, d), BY)
    return g.groupBy("instrument", "epoch").agg(F.count(F.lit(1)).alias("updates"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def crossed_resyncs(spark: SparkSession, d: str) -> DataFrame:
    touch = views.book_top(spark, d).withColumn("ask", F.when(F.col("n") % 3 == 0, F.col("bid")).otherwise(F.col("ask")))
    return book.crossed_resync(touch, BY, 2).select("instrument", "n", "in_row")


def _levels(spark: SparkSession, d: str) -> DataFrame:
    """Five levels a side from each update; size 0 removes a level."""
    return _levels_of(views.book_top(spark, d))


def _levels_of(t: DataFrame, *more: str) -> DataFrame:
    side = F.explode(F.array(F.lit("bid"), F.lit("ask")))
    rows = t.select("instrument", *more, "ts_ms", "n", "bid", "ask", "bid_size", side.alias("side")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(4))))
    price = F.when(F.col("side") == "bid", F.col("bid") - F.col("i")).otherwise(F.col("ask") + F.col("i"))
    return rows.select("instrument", *more, "ts_ms", "n", "side", price.alias("price"), F.when((F.col("bid_size") + F.col("i")) % 11 == 0, 0).otherwise(F.col("bid_size") + F.col("i")).alias("size"))


def level_intervals(spark: SparkSession, d: str) -> DataFrame:
    v = book.level_validity(_levels(spark, d), BY)
    return v.groupBy("instrument", "side", "price").agg(F.count(F.lit(1)).alias("spans"), F.sum(F.coalesce(F.col("valid_to") - F.col("valid_from"), F.lit(0))).alias("alive_ms"), F.sum("size").alias("size"))


def book_at_noon(spark: SparkSession, d: str) -> DataFrame:
    at = F.lit(1705320000000)  # 2024-01-15 12:00 UTC
    b = book.book_at(book.level_validity(_levels(spark, d), BY), BY, at, 3)
    return b.select("instrument", "side", F.concat_ws(" ", F.transform("levels", lambda x: F.concat(x["price"].cast("string"), F.lit("x"), x["size"].cast("string")))).alias("levels"))


def book_by_epoch(spark: SparkSession, d: str) -> DataFrame:
    """The book at noon of each day, where a gap in the sequence ends all levels that stood before it."""
    epochs = book.gap_islands(views.numbered_touch(spark, d), BY)
    levels = book.level_validity(_levels_of(epochs, "epoch"), BY, "epoch")
    days = F.explode(F.transform(F.sequence(F.lit(0), F.lit(29)), lambda i: F.lit(1704110400000) + i.cast("long") * (24 * HOUR)))
    live = levels.withColumn("noon", days)
    b = book.book_at(live, ["instrument", "noon"], F.col("noon"), 3)
    return b.select("instrument", "noon", "side", F.concat_ws(" ", F.transform("levels", lambda x: F.concat(x["price"].cast("string"), F.lit("x"), x["size"].cast("string")))).alias("levels"))


def level_deltas(spark: SparkSession, d: str) -> DataFrame:
    deltas = _levels(spark, d).withColumn("delta", F.when(F.col("n") % 2 == 0, F.col("size")).otherwise(-F.col("size")))
    s = book.level_sizes(deltas, BY)
    return s.groupBy("instrument", "side", "price").agg(F.max_by("size", F.struct("ts_ms", "n")).alias("size"), F.max("size").alias("most"))


def thinned_touch(spark: SparkSession, d: str) -> DataFrame:
    return T.thin(views.book_top(spark, d).select("instrument", "n", "ts_ms", "bid", "ask"), BY, "ts_ms", ["ts_ms", "n"], HOUR).select("instrument", "n", "ts_ms", "bid", "ask")


def thinned_touch_by_bucket(spark: SparkSession, d: str) -> DataFrame:
    return T.thin_by_bucket(views.book_top(spark, d), BY, "ts_ms", ["ts_ms", "n"], HOUR).select("instrument", "n", "ts_ms")


def _raw(spark: SparkSession, d: str) -> DataFrame:
    """Received messages: every 25th comes twice, five seconds apart; lag and stamps vary with the event."""
    e = views.table(spark, d, "events")
    base = e.select(F.concat(F.lit("U"), F.pmod("user_id", F.lit(4)).cast("string")).alias("instrument"), F.col("event_id").alias("n"), views.epoch_ms(F.col("ts")).alias("t"), F.concat(F.col("event_type"), F.lit(":"), F.col("props"), F.lit(":"), F.col("event_id").cast("string")).alias("m"), (F.round(F.col("value") * 40)).cast("long").alias("lag"))
    copies = base.where("n % 25 = 0").withColumn("t", F.col("t") + 5000)
    return base.union(copies).withColumn("stamp", F.col("t") - F.col("lag"))


def frame_copies(spark: SparkSession, d: str) -> DataFrame:
    kept = T.first_of(_raw(spark, d), ["instrument", F.sha2("m", 256)], ["t", "n"])
    return kept.groupBy("instrument").agg(F.count(F.lit(1)).alias("frames"), F.sum(F.col("copies") - 1).alias("dropped"), F.sum("t").alias("t_sum"))


def lag_by_hour(spark: SparkSession, d: str) -> DataFrame:
    """n, p50, p90, max and late share of the lag by instrument and hour of the day, with totals by rollup."""
    r = _raw(spark, d).withColumn("hour", F.floor(F.col("t") / HOUR) % 24)
    return r.rollup("instrument", "hour").agg(F.count(F.lit(1)).alias("n"), F.percentile("lag", F.lit(0.5)).alias("p50"), F.percentile("lag", F.lit(0.9)).alias("p90"), F.max("lag").alias("most"), F.round(F.avg((F.col("lag") > 5000).cast("int")), 6).alias("late"))


def lag_split(spark: SparkSession, d: str) -> DataFrame:
    r = T.restamp(_raw(spark, d), "stamp", BY, "t", ["t", "n"], "freshest")
    return r.select("instrument", "n", "t", (F.col("stamp") - F.col("freshest")).alias("venue"), (F.col("t") - F.col("freshest")).alias("after"))


def lag_episodes(spark: SparkSession, d: str) -> DataFrame:
    return T.episodes(_raw(spark, d), "lag", 5000, 1000, BY, ["t", "n"], "t").select("instrument", "episode", "started", "ended", "peak", "rows")


def late_together(spark: SparkSession, d: str) -> DataFrame:
    """How often instruments are late in the same hour: P(late), P(late given another late)."""
    cells = _raw(spark, d).groupBy("instrument", F.floor(F.col("t") / HOUR).alias("hour")).agg(F.max("lag").alias("lag"))
    hours = cells.groupBy("hour").agg(F.count(F.lit(1)).alias("active"), F.sum((F.col("lag") > 8000).cast("int")).alias("late")).where("active >= 2")
    both, one = F.sum(F.col("late") * (F.col("late") - 1)), F.sum(F.col("late") * (F.col("active") - 1))
    return hours.agg(F.count(F.lit(1)).alias("hours"), F.round(F.sum("late") / F.sum("active"), 6).alias("p_late"), F.round(both / one, 6).alias("p_given"), F.sum((F.col("late") > 0).cast("int")).alias("any_late"))


def poll_changes(spark: SparkSession, d: str) -> DataFrame:
    p = _raw(spark, d).withColumn("level", F.floor(F.col("lag") / 4000))
    return T.changed(p, "level", BY, ["t", "n"]).groupBy("instrument", "level").agg(F.count(F.lit(1)).alias("n"))


def archive_rate(spark: SparkSession, d: str) -> DataFrame:
    r = _raw(spark, d).groupBy("instrument").agg(F.count(F.lit(1)).alias("messages"), F.sum(F.octet_length("m")).alias("bytes"), (F.max("t") - F.min("t")).alias("span_ms"))
    return r.select("instrument", "messages", "bytes", F.round(F.col("messages") * 1000 / F.col("span_ms"), 6).alias("per_second"), F.round(F.col("bytes") * 86_400_000 / F.col("span_ms"), 2).alias("bytes_a_day"))


def fill_bracket(spark: SparkSession, d: str) -> DataFrame:
    """A resting bid at each touch, two hours each."""
    t = views.book_top(spark, d)
    orders = t.select("instrument", F.col("n").alias("order_id"), F.col("bid").alias("price"), (F.col("bid_size") * 5).alias("size"), F.col("ask_size").alias("queue"), F.col("ts_ms").alias("start_ms"), (F.col("ts_ms") + 2 * HOUR).alias("end_ms"))
    return C.fill_bracket(orders, views.tape(spark, d), t, BY, 4 * HOUR).select("order_id", "optimistic", "pessimistic", "cause")


def tumbling_flow(spark: SparkSession, d: str) -> DataFrame:
    e = views.table(spark, d, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.round(F.col("value") * 100).cast("long")) / 100, 2).alias("value")).select((views.epoch_ms(F.col("w.start")) / 1000).cast("long").alias("start"), "event_type", "n", "value")


def sliding_flow(spark: SparkSession, d: str) -> DataFrame:
    e = views.table(spark, d, "events")
    return e.groupBy(F.window("ts", "6 hours", "2 hours").alias("w")).agg(F.count(F.lit(1)).alias("n")).select((views.epoch_ms(F.col("w.start")) / 1000).cast("long").alias("start"), "n")


def session_gaps(spark: SparkSession, d: str) -> DataFrame:
    e = views.table(spark, d, "events").where("event_type = 'error'")
    s = e.groupBy("user_id", F.session_window("ts", "12 hours").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


_GOOD = views.BOOK_SQL + ", good as (select *, (bid + ask) / 2.0::double mid from touch where bid > 0 and bid < ask), mids as (select instrument, ts_ms, arg_max(mid, n) mid, arg_max(bid, n) bid, arg_max(ask, n) ask from good group by 1, 2)"
_LEVELS = views.BOOK_SQL + """, lv as (select instrument, ts_ms, n, side, case when side = 'bid' then bid - i else ask + i end price, case when (bid_size + i) % 11 = 0 then 0 else bid_size + i end size from touch, (values ('bid'), ('ask')) s(side), range(0, 5) r(i)),
val as (select instrument, side, price, size, ts_ms valid_from, lead(ts_ms) over (partition by instrument, side, price order by ts_ms, n) valid_to from lv), ok as (select * from val where size > 0 and (valid_to is null or valid_to > valid_from))"""
_RAW = """base as (select 'U' || (user_id % 4) instrument, event_id n, epoch_us(ts) // 1000 t, event_type || ':' || props || ':' || event_id m, round(value * 40)::bigint lag from events),
raw as (select *, t - lag stamp from (select * from base union all select instrument, n, t + 5000, m, lag from base where n % 25 = 0))"""


def _wsum(x: str, h: int) -> str:
    return f"sum({x}) over (partition by instrument order by ts_ms, n rows unbounded preceding) - coalesce(sum({x}) over (partition by instrument order by ts_ms range between unbounded preceding and {h + 1} preceding), 0)"


_OFI = _GOOD + """, of_ as (select *, lag(bid) over w pb, lag(ask) over w pa, lag(bid_size) over w pqb, lag(ask_size) over w pqa from good window w as (partition by instrument order by ts_ms, n)),
ofi as (select *, case when pb is null then 0 else case when bid > pb then bid_size when bid = pb then bid_size - pqb else -pqb end + case when ask < pa then -ask_size when ask = pa then -(ask_size - pqa) else pqa end end::double o from of_)"""

_SNAP = f"""{views.BOOK_SQL}, {views.TAPE_SQL},
bk as (select instrument, n, ts_ms, bid, case when n % 29 = 0 then bid - 1 else ask end ask, bid_size, ask_size from touch),
good as (select *, (bid + ask) / 2.0::double mid from bk where bid > 0 and bid < ask),
mids as (select instrument, ts_ms, arg_max(mid, n) mid from good group by 1, 2),
of_ as (select *, lag(bid) over w pb, lag(ask) over w pa, lag(bid_size) over w pqb, lag(ask_size) over w pqa from good window w as (partition by instrument order by ts_ms, n)),
ofi as (select *, case when pb is null then 0 else case when bid > pb then bid_size when bid = pb then bid_size - pqb else -pqb end + case when ask < pa then -ask_size when ask = pa then -(ask_size - pqa) else pqa end end::double o from of_),
ow as (select *, {_wsum('o', HOUR)} ofi_1h, {_wsum('o', 6 * HOUR)} ofi_6h, min(ts_ms) over (partition by instrument) began from ofi),
r2 as (select *, coalesce(pow(ln(mid / lag(mid) over (partition by instrument order by ts_ms)), 2), 0) q from mids),
rs as (select instrument, ts_ms, sum(q) over a - first(q) over a qa, (ts_ms - first(ts_ms) over a) / 1000.0::double sa, count(*) over a ca, sum(q) over b - first(q) over b qb, (ts_ms - first(ts_ms) over b) / 1000.0::double sb, count(*) over b cb from r2
  window a as (partition by instrument order by ts_ms range between {6 * HOUR} preceding and current row), b as (partition by instrument order by ts_ms range between {12 * HOUR} preceding and current row)),
rv as (select instrument, ts_ms, case when ca < 3 then 0 else sqrt(greatest(qa, 0) / sa) * 10000 end rv_6h, case when cb < 3 then 0 else sqrt(greatest(qb, 0) / sb) * 10000 end rv_12h from rs),
rl as (select instrument, ts_ms, rv_12h, list_sort(list(rv_12h) over (partition by instrument order by ts_ms rows between 119 preceding and current row)) l from rv where rv_12h > 0),
rg as (select instrument, ts_ms, case when len(l) < 60 then 'unknown' when rv_12h <= l[floor(len(l) * 0.33::double)::int + 1] then 'low' when rv_12h >= l[floor(len(l) * 0.67::double)::int + 1] then 'high' else 'normal' end regime from rl),
b1 as (select ow.*, rv_6h, rv_12h, ts_ms - {HOUR} k1, ts_ms - {6 * HOUR} k6, ts_ms - {12 * HOUR} k12 from ow join rv using (instrument, ts_ms)),
b2 as (select b1.*, m.mid m1 from b1 asof left join mids m on b1.instrument = m.instrument and b1.k1 >= m.ts_ms),
b3 as (select b2.*, m.mid m6 from b2 asof left join mids m on b2.instrument = m.instrument and b2.k6 >= m.ts_ms),
b4 as (select b3.*, m.mid m12 from b3 asof left join mids m on b3.instrument = m.instrument and b3.k12 >= m.ts_ms),
b5 as (select b4.*, coalesce(g.regime, 'unknown') vol_regime from b4 asof left join rg g on b4.instrument = g.instrument and b4.ts_ms >= g.ts_ms),
bb as (select bk.instrument, bk.n, bk.ts_ms bts, b5.n is not null usable, b5.mid, b5.bid, b5.ask, b5.bid_size, b5.ask_size, ofi_1h, ofi_6h, rv_6h, rv_12h, m1, m6, m12, b5.vol_regime, b5.ts_ms - began hist from bk left join b5 using (instrument, n)),
tw as (select instrument, n, ts_ms, price, size, case when is_buy then size else 0 end bs, price * size paid, 1 one from tape),
tt as (select instrument, n, ts_ms tts, price last_price, {_wsum('bs', HOUR)} c1, {_wsum('size', HOUR)} v1, {_wsum('one', HOUR)} t1, {_wsum('paid', HOUR)} p1, {_wsum('bs', 6 * HOUR)} c6, {_wsum('size', 6 * HOUR)} v6, {_wsum('bs', 12 * HOUR)} c12, {_wsum('size', 12 * HOUR)} v12 from tw),
ev as (select instrument, ts_ms, n, true is_book from bk union all select instrument, ts_ms, n, false from tape),
ix as (select *, max(case when is_book then (ts_ms, n) end) over w bk_, max(case when not is_book then (ts_ms, n) end) over w tp_ from ev window w as (partition by instrument order by ts_ms, n, is_book rows unbounded preceding)),
fu as (select instrument, ts_ms // {8 * HOUR} * {8 * HOUR} ts_ms, count(*) / 10000.0::double rate from tape group by 1, 2),
jo as (select ix.instrument, ix.ts_ms, ix.n, bb.* exclude (instrument, n), tt.* exclude (instrument, n) from ix left join bb on bb.instrument = ix.instrument and bb.bts = ix.bk_[1] and bb.n = ix.bk_[2] left join tt on tt.instrument = ix.instrument and tt.tts = ix.tp_[1] and tt.n = ix.tp_[2]),
fj as (select jo.*, fu.rate, fu.ts_ms + {8 * HOUR} settles from jo asof left join fu on jo.instrument = fu.instrument and jo.ts_ms >= fu.ts_ms)"""


def _z(x: str, places: int = 4) -> str:
    return f"round(case when usable then coalesce({x}, 0) else 0 end::double, {places})"


def _dep(side: str, n: int) -> str:
    return f"({n} * {side} + {n * (n - 1) // 2})::double"


ORACLES = {
    "feature_snapshot": f"""with {_SNAP} select instrument, n, coalesce(bts, ts_ms) ts, ts_ms received_ts, {_z('mid')} mid, {_z('(bid * ask_size + ask * bid_size) / (bid_size + ask_size)::double')} microprice,
{_z('((bid * ask_size + ask * bid_size) / (bid_size + ask_size)::double - mid) / mid * 10000')} microprice_delta_bps, {_z('ask - bid')} spread, {_z('(ask - bid) / mid * 10000')} spread_bps,
{_z('(bid_size - ask_size) / (bid_size + ask_size)::double')} obi_1, {_z(f"({_dep('bid_size', 5)} - {_dep('ask_size', 5)}) / ({_dep('bid_size', 5)} + {_dep('ask_size', 5)})")} obi_5, {_z(f"({_dep('bid_size', 5)} - {_dep('ask_size', 5)}) / ({_dep('bid_size', 5)} + {_dep('ask_size', 5)})")} obi_20,
{_z('ofi_1h')} ofi_1h, {_z('ofi_6h')} ofi_6h, {_z('ln(mid / m1) * 10000')} ret_1h, {_z('ln(mid / m6) * 10000')} ret_6h, {_z('ln(mid / m12) * 10000')} ret_12h, {_z('rv_6h')} rv_6h, {_z('rv_12h')} rv_12h, {_z(_dep('bid_size', 5))} bid_depth_20, {_z(_dep('ask_size', 5))} ask_depth_20,
case when usable then vol_regime else 'unknown' end vol_regime, {_z('hist / 1000.0::double')} history_seconds, {_z('(2 * c1 - v1) / v1::double')} tfi_1h, {_z('(2 * c6 - v6) / v6::double')} tfi_6h, {_z('(2 * c12 - v12) / v12::double')} tfi_12h,
case when usable then coalesce(t1, 0) else 0 end::bigint trade_count, {_z('v1')} volume, {_z('p1 / v1::double')} vwap, {_z('last_price')} last_price, {_z('rate')} funding_rate, {_z('greatest(0, (settles - bts) / 1000.0::double)')} funding_ttl_s,
greatest(0, ts_ms - bts) book_age_ms, round((ts_ms - tts) / 1000.0::double, 4) tape_staleness_s, coalesce(usable, false) is_valid from fj""",
    "mid_regime": f"""with {_GOOD}, r as (select *, coalesce(pow(ln(mid / lag(mid) over (partition by instrument order by ts_ms)), 2), 0) r2 from mids), s as (select instrument, ts_ms, sum(r2) over w - first(r2) over w q, (ts_ms - first(ts_ms) over w) / 1000.0::double sec, count(*) over w n from r window w as (partition by instrument order by ts_ms range between {12 * HOUR} preceding and current row)),
v as (select instrument, ts_ms, round(case when n < 3 then 0 else sqrt(greatest(q, 0) / sec) * 10000 end, 4) rv from s), l as (select *, list_sort(list(rv) over (partition by instrument order by ts_ms rows between 119 preceding and current row)) l from v where rv > 0)
select instrument, case when len(l) < 60 then 'unknown' when rv <= l[floor(len(l) * 0.33::double)::int + 1] then 'low' when rv >= l[floor(len(l) * 0.67::double)::int + 1] then 'high' else 'normal' end regime, count(*) n from l group by 1, 2""",
    "trades_asof_touch": f"with {_GOOD}, {views.TAPE_SQL} select t.instrument, t.n, t.price, m.bid, m.ask from tape t asof left join mids m on t.instrument = m.instrument and t.ts_ms >= m.ts_ms",
    "trades_asof_next_touch": f"with {_GOOD}, {views.TAPE_SQL} select t.instrument, t.n, t.price, m.bid, m.ask from tape t asof left join mids m on t.instrument = m.instrument and t.ts_ms <= m.ts_ms",
    "touch_features": f"with {_OFI} select instrument, n, mid, round((ask - bid) / mid * 10000, 6) spread_bps, round(((bid * ask_size + ask * bid_size) / (bid_size + ask_size)::double - mid) / mid * 10000, 6) micro_bps, round((bid_size - ask_size) / (bid_size + ask_size)::double, 6) obi_1, o ofi, {_wsum('o', HOUR)} ofi_1h, {_wsum('o', 6 * HOUR)} ofi_6h from ofi",
    "trade_flow": f"with {views.TAPE_SQL}, b as (select *, case when is_buy then size else 0 end bs, 1 one from tape), w as (select instrument, n, {_wsum('bs', HOUR)} b1, {_wsum('size', HOUR)} v1, {_wsum('one', HOUR)} t1, {_wsum('bs', 6 * HOUR)} b6, {_wsum('size', 6 * HOUR)} v6 from b) select instrument, n, round((2 * b1 - v1) / v1::double, 6) tfi_1h, v1::bigint volume_1h, t1::bigint trades_1h, round((2 * b6 - v6) / v6::double, 6) tfi_6h from w",
    "mid_returns": f"with {_GOOD}, a as (select g.instrument, g.n, g.mid, m.mid x from (select *, ts_ms - {HOUR} k from good) g asof left join mids m on g.instrument = m.instrument and g.k >= m.ts_ms), b as (select g.instrument, g.n, m.mid x from (select *, ts_ms - {12 * HOUR} k from good) g asof left join mids m on g.instrument = m.instrument and g.k >= m.ts_ms) select a.instrument, a.n, round(coalesce(ln(a.mid / a.x) * 10000, 0), 5) ret_1h, round(coalesce(ln(a.mid / b.x) * 10000, 0), 5) ret_12h from a join b on a.instrument = b.instrument and a.n = b.n",
    "mid_volatility": f"with {_GOOD}, r as (select *, coalesce(pow(ln(mid / lag(mid) over (partition by instrument order by ts_ms)), 2), 0) r2 from mids), s as (select instrument, ts_ms, sum(r2) over w - first(r2) over w q, (ts_ms - first(ts_ms) over w) / 1000.0::double sec, count(*) over w n from r window w as (partition by instrument order by ts_ms range between {12 * HOUR} preceding and current row)) select instrument, ts_ms, round(case when n < 3 then 0 else sqrt(greatest(q, 0) / sec) * 10000 end, 4) rv_12h from s",
    "forward_labels": f"with {_GOOD}, a as (select g.instrument, g.n, g.ts_ms, g.mid, m.mid x from (select *, ts_ms + {HOUR} k from good) g asof join mids m on g.instrument = m.instrument and g.k <= m.ts_ms), b as (select g.instrument, g.n, m.mid x from (select *, ts_ms + {6 * HOUR} k from good) g asof join mids m on g.instrument = m.instrument and g.k <= m.ts_ms), nw as (select instrument, max(ts_ms) newest from mids group by 1) select a.instrument, a.n, round((a.x / a.mid - 1) * 10000, 4) fwd_1h, round((b.x / a.mid - 1) * 10000, 4) fwd_6h from a join b on a.instrument = b.instrument and a.n = b.n join nw on a.instrument = nw.instrument where newest - a.ts_ms >= {6 * HOUR}",
    "sequence_gaps": f"with {views.BOOK_SQL}, g as (select *, max(seq) over (partition by instrument order by ts_ms, n rows between unbounded preceding and 1 preceding) l from touch), e as (select *, sum(case when prev_seq <> l and seq > l then 1 else 0 end) over (partition by instrument order by ts_ms, n)::bigint epoch from g) select instrument, epoch, count(*) updates, min(seq) first_seq, max(seq) last_seq from e group by 1, 2",
    "crossed_resyncs": f"with {views.BOOK_SQL}, c as (select instrument, ts_ms, n, n % 3 = 0 or bid >= ask crossed from touch), i as (select *, sum((not crossed)::int) over (partition by instrument order by ts_ms, n) i from c), k as (select *, case when crossed then sum(crossed::int) over (partition by instrument, i order by ts_ms, n) else 0 end::bigint in_row from i) select instrument, n, in_row from k where in_row > 0 and in_row % 2 = 0",
    "level_intervals": f"with {_LEVELS} select instrument, side, price, count(*) spans, sum(coalesce(valid_to - valid_from, 0))::bigint alive_ms, sum(size)::bigint size from ok group by 1, 2, 3",
    "book_at_noon": f"with {_LEVELS}, lv2 as (select *, row_number() over (partition by instrument, side order by case when side = 'bid' then -price else price end) k from ok where valid_from <= 1705320000000 and (valid_to is null or valid_to > 1705320000000)) select instrument, side, string_agg(price || 'x' || size, ' ' order by k) levels from lv2 where k <= 3 group by 1, 2",
    "book_by_epoch": f"""with {views.BOOK_SQL}, g as (select *, max(seq) over (partition by instrument order by ts_ms, n rows between unbounded preceding and 1 preceding) l from touch), e as (select *, sum(case when prev_seq <> l and seq > l then 1 else 0 end) over (partition by instrument order by ts_ms, n)::bigint epoch from g),
lv as (select instrument, epoch, ts_ms, n, side, case when side = 'bid' then bid - i else ask + i end price, case when (bid_size + i) % 11 = 0 then 0 else bid_size + i end size from e, (values ('bid'), ('ask')) s(side), range(0, 5) r(i)),
ep as (select instrument, epoch, lead(min(ts_ms)) over (partition by instrument order by epoch) ends from lv group by 1, 2),
va as (select lv.*, ep.ends, lead(ts_ms) over (partition by lv.instrument, lv.epoch, side, price order by ts_ms, n) nxt from lv join ep on lv.instrument = ep.instrument and lv.epoch = ep.epoch),
ok as (select instrument, side, price, size, ts_ms a, least(nxt, ends) z from va where size > 0 and (least(nxt, ends) is null or least(nxt, ends) > ts_ms)),
nn as (select 1704110400000 + i * {24 * HOUR} noon from range(0, 30) r(i)),
lk as (select *, row_number() over (partition by instrument, noon, side order by case when side = 'bid' then -price else price end) k from ok, nn where a <= noon and (z is null or z > noon))
select instrument, noon, side, string_agg(price || 'x' || size, ' ' order by k) levels from lk where k <= 3 group by 1, 2, 3""",
    "level_deltas": f"""with recursive {_LEVELS}, dl as (select instrument, side, price, case when n % 2 = 0 then size else -size end::double delta, row_number() over (partition by instrument, side, price order by ts_ms, n) k from lv),
w as (select instrument, side, price, k, greatest(0, delta) s from dl where k = 1 union all select d.instrument, d.side, d.price, d.k, greatest(0, w.s + d.delta) from w join dl d on d.instrument = w.instrument and d.side = w.side and d.price = w.price and d.k = w.k + 1)
select instrument, side, price, arg_max(s, k) size, max(s) most from w group by 1, 2, 3""",
    "thinned_touch_by_bucket": f"with {views.BOOK_SQL} select instrument, n, ts_ms from touch qualify row_number() over (partition by instrument, ts_ms // {HOUR} order by ts_ms, n) = 1",
    "thinned_touch": f"""with recursive {views.BOOK_SQL}, k as (select instrument, n, ts_ms, bid, ask from touch qualify row_number() over (partition by instrument order by ts_ms, n) = 1
union all select x.instrument, x.n, x.ts_ms, x.bid, x.ask from (select k.instrument, min((t.ts_ms, t.n, t.bid, t.ask)) b from k join touch t on t.instrument = k.instrument and t.ts_ms >= k.ts_ms + {HOUR} group by k.instrument) y, lateral (select y.instrument, y.b[1] ts_ms, y.b[2] n, y.b[3] bid, y.b[4] ask) x)
select instrument, n, ts_ms, bid, ask from k""",
    "frame_copies": f"with {_RAW}, k as (select *, row_number() over (partition by instrument, m order by t, n) nth, count(*) over (partition by instrument, m) c from raw) select instrument, count(*) frames, sum(c - 1)::bigint dropped, sum(t)::bigint t_sum from k where nth = 1 group by 1",
    "lag_by_hour": f"with {_RAW}, h as (select *, t // {HOUR} % 24 as hour from raw) select instrument, hour, count(*) n, quantile_cont(lag, 0.5)::double p50, quantile_cont(lag, 0.9)::double p90, max(lag) most, round(avg((lag > 5000)::int), 6) late from h group by rollup (instrument, hour)",
    "lag_split": f"with {_RAW}, f as (select *, max(stamp) over (partition by instrument order by t, n rows unbounded preceding) freshest from raw) select instrument, n, t, stamp - freshest venue, t - freshest as \"after\" from f",
    "lag_episodes": f"""with {_RAW}, a as (select *, coalesce(last_value(case when lag >= 5000 then 1 when lag < 1000 then 0 end ignore nulls) over (partition by instrument order by t, n rows unbounded preceding), 0) on_ from raw),
b as (select *, sum(case when on_ = 1 and coalesce(p, 0) = 0 then 1 else 0 end) over (partition by instrument order by t, n rows unbounded preceding)::bigint episode from (select *, lag(on_) over (partition by instrument order by t, n) p from a))
select instrument, episode, min(t) started, max(t) ended, max(lag) peak, count(*) as rows from b where on_ = 1 group by 1, 2""",
    "late_together": f"with {_RAW}, c as (select instrument, t // {HOUR} h, max(lag) lag from raw group by 1, 2), s as (select h, count(*) active, sum((lag > 8000)::int) late from c group by 1 having count(*) >= 2) select count(*) as hours, round(sum(late) / sum(active), 6) p_late, round(sum(late * (late - 1)) / sum(late * (active - 1)), 6) p_given, sum((late > 0)::int)::bigint any_late from s",
    "poll_changes": f"with {_RAW}, l as (select *, lag // 4000 as level from raw), k as (select *, lag(level) over (partition by instrument order by t, n) p from l) select instrument, level, count(*) n from k where level is distinct from p group by 1, 2",
    "archive_rate": f"with {_RAW}, r as (select instrument, count(*) messages, sum(strlen(m))::bigint bytes, max(t) - min(t) span_ms from raw group by 1) select instrument, messages, bytes, round(messages * 1000 / span_ms::double, 6) per_second, round(bytes * 86400000 / span_ms::double, 2) bytes_a_day from r",
    "fill_bracket": f"""with {views.BOOK_SQL}, {views.TAPE_SQL}, o as (select instrument, n order_id, bid price, bid_size * 5 size, ask_size queue, ts_ms a, ts_ms + {2 * HOUR} z from touch),
p as (select order_id, sum(t.size) v, sum(case when t.price = o.price then t.size else 0 end) l, max((t.price < o.price)::int) b from o join tape t on t.instrument = o.instrument and t.ts_ms >= a and t.ts_ms < z and not is_buy and t.price <= o.price group by 1),
c as (select distinct order_id from o join touch t on t.instrument = o.instrument and t.ts_ms >= a and t.ts_ms < z and t.ask <= o.price)
select o.order_id, case when c.order_id is not null then size else least(size, coalesce(v, 0)) end::bigint optimistic, case when c.order_id is not null or coalesce(b, 0) = 1 then size else least(size, greatest(0, coalesce(l, 0) - queue)) end::bigint pessimistic,
  case when c.order_id is not null then 'crossed' when coalesce(b, 0) = 1 then 'cleared' when v > 0 then 'print' end cause from o left join p using (order_id) left join c on c.order_id = o.order_id""",
    "tumbling_flow": "select (epoch_us(ts) // 3600000000 * 3600)::bigint start, event_type, count(*) n, round(sum(round(value * 100)::bigint)::double / 100, 2) as value from events group by 1, 2",
    "sliding_flow": "with w as (select (epoch_us(ts) // 7200000000 - k) * 7200 start from events, range(0, 3) r(k)) select start::bigint start, count(*) n from w group by 1",
    "session_gaps": "with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 12 hours then 0 else 1 end nw from events where event_type = 'error'), s as (select *, sum(nw) over (partition by user_id order by ts) s from e), g as (select user_id, s, count(*) n from s group by 1, 2) select user_id, count(*) sessions, max(n) longest from g group by 1",
}
QUERIES = [
    trades_asof_touch, trades_asof_next_touch, touch_features, feature_snapshot, trade_flow, mid_returns, mid_volatility, mid_regime, forward_labels, sequence_gaps, crossed_resyncs, level_intervals, book_at_noon, book_by_epoch, level_deltas,
    thinned_touch, thinned_touch_by_bucket, frame_copies, lag_by_hour, lag_split, lag_episodes, late_together, poll_changes, archive_rate, fill_bracket, tumbling_flow, sliding_flow, session_gaps,
]
