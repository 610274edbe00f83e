"""Queries over books rebuilt from messages and over fills one by one, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.operators import book
from marketframe.plans import contracts as C
from marketframe.sources import views

HOUR = 3_600_000
BY = ["instrument"]


def feed_epochs(spark: SparkSession, d: str) -> DataFrame:
    """What the feed's rule makes of each epoch's messages: how many came, how many count, and the last that does."""
    a = book.applied(views.book_messages(views.table(spark, d, "events")), BY)
    return a.groupBy("instrument", "epoch").agg(F.count(F.lit(1)).alias("messages"), F.count_if("applied").alias("used"), F.max(F.when(F.col("applied"), F.col("n"))).alias("last"))


def book_tops(spark: SparkSession, d: str) -> DataFrame:
    """Best prices, their sizes and the depth of two levels after every message that counts; epochs are cut by day."""
    a = book.applied(views.book_messages(views.table(spark, d, "events")), BY).where("applied")
    return book.top_of_book(a, BY, 2).select("instrument", "n", "bid", "ask", "bid_size", "ask_size", "bid_depth", "ask_depth")


def maker_fills(spark: SparkSession, d: str) -> DataFrame:
    """The fills of a resting bid and a resting offer at each touch, two hours each, one by one, within both bounds."""
    t, tape = views.book_top(spark, d), views.tape(spark, d)
    orders = lambda price, size, queue: t.select("instrument", F.col("n").alias("order_id"), F.col(price).alias("price"), (F.col(size) * 5).alias("size"), F.col(queue).alias("queue"), F.col("ts_ms").alias("start_ms"), (F.col("ts_ms") + 2 * HOUR).alias("end_ms"))
    bids = C.fill_rows(orders("bid", "bid_size", "ask_size"), tape, t, BY, 4 * HOUR)
    offers = C.fill_rows(*C.mirrored(orders("ask", "ask_size", "bid_size"), tape, t), BY, 4 * HOUR)
    return bids.withColumn("side", F.lit("buy")).union(offers.withColumn("side", F.lit("sell"))).select("side", "order_id", "bound", "ts_ms", "n", F.col("size").cast("long").alias("size"), "cause")


def _fills_sql(side: str, sign: int, price: str, size: str, queue: str, hit: str, other: str) -> str:
    """The fill loop of one side, by running sums; prices are signed, so that a sale is a bid."""
    return f"""
o{side} as (select instrument, n oid, {sign} * {price} price, {size} * 5 size, {queue} queue, ts_ms s, ts_ms + {2 * HOUR} e from touch),
h{side} as (select o.*, t.ts_ms, t.n, 0 turn, {sign} * t.price pp, t.size ps from o{side} o join tape t on o.instrument = t.instrument and t.ts_ms >= s and t.ts_ms < e and {hit} and {sign} * t.price <= o.price),
c{side} as (select o.*, min((t.ts_ms, t.n)) at_ from o{side} o join touch t on o.instrument = t.instrument and t.ts_ms >= s and t.ts_ms < e and {sign} * t.{other} <= o.price group by all),
e{side} as (select * from h{side} union all select * exclude (at_), at_[1], at_[2], 1, null, 0 from c{side}),
r{side} as (select *, case when max(turn) over w = 1 then size else least(size, sum(ps) over w) end best, case when max(turn) over w = 1 or coalesce(max((pp < price)::int) over w, 0) = 1 then size else least(size, greatest(0, sum(case when pp = price then ps else 0 end) over w - queue)) end worst from e{side} window w as (partition by oid order by ts_ms, n, turn rows unbounded preceding)),
b{side} as (select oid, ts_ms, n, turn, coalesce(pp < price, false) beyond, bound, so from r{side}, lateral (values ('optimistic', best), ('pessimistic', worst)) v(bound, so)),
f{side} as (select '{side}' side, oid order_id, bound, ts_ms, n, so - coalesce(lag(so) over (partition by oid, bound order by ts_ms, n, turn), 0) size, case when turn = 1 then 'crossed' when bound = 'pessimistic' and beyond then 'cleared' else 'print' end cause from b{side}),
x{side} as (select '{side}' side, oid order_id, bound, e ts_ms, null::bigint n, size - coalesce(m, 0) size, 'expired' cause from (select * from o{side}, (values ('optimistic'), ('pessimistic')) v(bound)) z left join (select oid, bound, max(so) m from b{side} group by all) q using (oid, bound))"""


ORACLES = {
    "feed_epochs": f"with {views.MESSAGE_SQL} select instrument, epoch, count(*) messages, sum(used::int)::bigint used, max(case when used then n end) as last from msg group by all",
    "book_tops": f"""with {views.MESSAGE_SQL}, a as (select * from msg where used),
lv as (select instrument, epoch, n, sign, mid + sign * (i + 1) price, case when snap then i + 2 else (k + i) % 5 end size from a, (values (-1), (1)) s(sign), range(0, 3) r(i) where snap or i < 2),
val as (select *, lead(n) over (partition by instrument, epoch, sign, price order by n) until from lv),
on_ as (select a.instrument, a.n, sign, price, v.size, row_number() over (partition by a.instrument, a.n, sign order by sign * price) k from a join val v on a.instrument = v.instrument and a.epoch = v.epoch and v.size > 0 and a.n >= v.n and (until is null or a.n < until)),
t as (select instrument, n, max(case when sign = -1 and k = 1 then price end) bid, max(case when sign = 1 and k = 1 then price end) ask, max(case when sign = -1 and k = 1 then size end) bid_size, max(case when sign = 1 and k = 1 then size end) ask_size, sum(case when sign = -1 and k <= 2 then size end) bid_depth, sum(case when sign = 1 and k <= 2 then size end) ask_depth from on_ group by all)
select instrument, n, bid::double bid, ask::double ask, bid_size::double bid_size, ask_size::double ask_size, bid_depth::double bid_depth, ask_depth::double ask_depth from t where bid is not null and ask is not null""",
    "maker_fills": f"with {views.BOOK_SQL}, {views.TAPE_SQL}, {_fills_sql('buy', 1, 'bid', 'bid_size', 'ask_size', 'not is_buy', 'ask')}, {_fills_sql('sell', -1, 'ask', 'ask_size', 'bid_size', 'is_buy', 'bid')} "
    + " union all ".join(f"select side, order_id, bound, ts_ms, n, size::bigint size, cause from {t} where size > 0" for t in ("fbuy", "xbuy", "fsell", "xsell")),
}
QUERIES = [feed_epochs, book_tops, maker_fills]
