"""Queries over venue messages, written as JSON from the given tables and read back by the parsers, and their SQL over the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.plans import contracts as C
from marketframe.sources import messages, venues, views

HOUR = 3_600_000


def _json(**fields: Column | str) -> Column:
    """A JSON object of texts; a null field is left out."""
    return F.to_json(F.struct(*[(F.lit(v) if isinstance(v, str) else v.cast("string")).alias(k) for k, v in fields.items()]))


def _nest(key: str, body: Column) -> Column:
    return F.concat(F.lit(f'{{"{key}":'), body, F.lit("}"))


def _iso(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _dollar_rows(rows: DataFrame) -> DataFrame:
    """Market rows of contracts; each 17th has no end, each 5th no title, each 3rd steps of its own."""
    steps = F.when(F.col("row_id") % 3 == 0, F.lit('[{"start":"0","end":"0.1","step":"0.001"}]'))
    m = _json(ticker=F.concat_ws("-", F.concat(F.lit("M"), F.col("market_id")), "row_id"), title=F.when(F.col("row_id") % 5 != 0, F.concat(F.lit("Will it? "), F.col("row_id"))), close_time=F.when(F.col("row_id") % 17 != 0, _iso(F.col("resolves_ms"))), price_ranges=steps)
    return rows.select("row_id", m.alias("m"))


def _token_rows(rows: DataFrame) -> DataFrame:
    yes_first = F.col("row_id") % 2 == 0
    m = _json(
        conditionId=F.concat(F.lit("0x"), F.col("row_id")), question=F.concat(F.lit("Will it? "), F.col("row_id")), endDate=F.when(F.col("row_id") % 17 != 0, _iso(F.col("resolves_ms"))),
        clobTokenIds=F.concat(F.lit('["a'), F.col("row_id"), F.lit('","b'), F.col("row_id"), F.lit('"]')), outcomes=F.when(yes_first, '["Yes","No"]').otherwise('["No","Yes"]'), feeType=F.when(F.col("fee_tier") == "fast", "fast"), resolutionSource=F.when(F.col("row_id") % 7 == 0, " oracle ").otherwise(""),
    )
    return rows.select("row_id", m.alias("m"))


def contract_dimension(spark: SparkSession, d: str) -> DataFrame:
    """Contracts of both venues from their market rows, without those that have no end."""
    rows = views.contracts(spark, d)
    both = venues.dollar_contracts(_dollar_rows(rows)).union(venues.token_contracts(_token_rows(rows)))
    return venues.usable_contracts(both).select(
        "row_id", "venue", "market_id", "question", F.unix_millis("resolves_at").alias("resolves_ms"), "resolution_source", "fee_tier", F.col("tick").cast("double").alias("tick"), F.col("min_size").cast("double").alias("min_size"), "yes_token", "no_token",
        F.coalesce(F.get("price_ranges", F.lit(0))["step"].cast("double"), F.lit(0.0)).alias("first_step"),
    )


def _results(rows: DataFrame) -> DataFrame:
    """Result messages of both venues for each contract: each 4th isn't final yet, each 9th has no result."""
    won = F.col("resolved_yes")
    status, result = F.when(F.col("row_id") % 4 == 0, "active").otherwise("finalized"), F.when(F.col("row_id") % 9 == 0, "void").when(won, "Yes").otherwise("no")
    yes_first = F.col("row_id") % 2 == 0
    prices = F.when(F.col("row_id") % 9 == 0, '["0.5","0.5"]').when(won == yes_first, '["1","0"]').otherwise('["0","1"]')
    token = F.concat(F.lit('{"closed":'), F.when(F.col("row_id") % 4 == 0, "false").otherwise("true"), F.lit(',"outcomes":"'), F.when(yes_first, '[\\"Yes\\",\\"No\\"]').otherwise('[\\"No\\",\\"Yes\\"]'), F.lit('","outcomePrices":'), prices, F.lit("}"))
    return rows.select("*", _nest("market", _json(status=status, result=result)).alias("dollar"), token.alias("token"))


def contract_results(spark: SparkSession, d: str) -> DataFrame:
    rows = _results(views.contracts(spark, d))
    said = lambda won: F.when(won, "yes").when(~won, "no").otherwise("open")
    return rows.select("row_id", said(venues.dollar_result("dollar")).alias("dollar"), said(venues.token_result("token")).alias("token"))


def signed_changes(spark: SparkSession, d: str) -> DataFrame:
    """Signed changes of both outcomes' bids, summed by side and price of YES."""
    f = views.fills(spark, d)
    body = _json(side=F.when(F.col("n") % 2 == 0, "yes").otherwise("no"), price=F.col("price"), delta=F.when(F.col("side") == "buy", F.col("size")).otherwise(-F.col("size")))
    rows = f.select("market_id", F.when(F.col("n") % 3 == 0, body).otherwise(_nest("msg", body)).alias("m"))
    return venues.signed_changes(rows).groupBy("side", "price").agg(F.count(F.lit(1)).alias("n"), F.sum("delta").alias("delta"))


def venue_books(spark: SparkSession, d: str) -> DataFrame:
    """The touch of YES from books in dollars, cents, nested messages, and of either token."""
    c = views.contracts(spark, d)
    pair = lambda p, q: F.concat(F.lit('[["'), p, F.lit('","'), q, F.lit('"]]'))
    cents = lambda x: F.format_string("%.2f", x / 100)
    no = 100 - F.col("entry")
    form = F.col("row_id") % 3
    dollars = lambda outer, yes, other: F.concat(F.lit(f'{{"{outer}":{{"{yes}":'), pair(cents(F.col("bid")), F.lit("10")), F.lit(f',"{other}":'), pair(cents(no), F.lit("7")), F.lit("}}"))
    plain = F.concat(F.lit('{"orderbook":{"yes":'), pair(F.col("bid").cast("string"), F.lit("10")), F.lit(',"no":'), pair(no.cast("string"), F.lit("7")), F.lit("}}"))
    first = messages.binary_book(c.select("row_id", F.when(form == 0, dollars("orderbook_fp", "yes_dollars", "no_dollars")).when(form == 1, dollars("msg", "yes_dollars_fp", "no_dollars_fp")).otherwise(plain).alias("m"))).withColumn("venue", F.lit("dollar"))
    level = lambda p, q: F.concat(F.lit('[{"price":"'), p, F.lit(f'","size":"{q}"}}]'))
    own = F.col("row_id") % 2 == 0
    bids = F.when(own, level(cents(F.col("bid")), 10)).otherwise(level(cents(no), 7))
    asks = F.when(own, level(cents(F.col("entry")), 7)).otherwise(level(cents(100 - F.col("bid")), 10))
    m = F.concat(F.lit('{"asset_id":"'), F.when(own, "y").otherwise("n"), F.lit('","timestamp":"'), F.col("opens_ms"), F.lit('","bids":'), bids, F.lit(',"asks":'), asks, F.lit("}"))
    second = venues.token_book(c.select("row_id", F.lit("y").alias("yes_token"), m.alias("m"))).withColumn("venue", F.lit("token"))
    names = ["venue", "row_id", *[F.round(F.get(s, F.lit(0))[k], 6).alias(f"{s[:-1]}_{k}") for s in ("bids", "asks") for k in ("price", "size")]]
    return first.select(*names).union(second.select(*names))


def venue_trades(spark: SparkSession, d: str) -> DataFrame:
    """Prints of both venues: dollars or cents, counts in two forms, seconds or ISO times, either token, noisy floats."""
    c = views.contracts(spark, d)
    half, taker = F.col("row_id") % 2 == 0, F.when(F.col("signal") % 2 == 0, "yes").otherwise("no")
    m = _json(
        yes_price_dollars=F.when(half, F.format_string("%.2f", F.col("entry") / 100)), yes_price=F.when(~half, F.col("entry")), count_fp=F.when(half, F.format_string("%.2f", F.col("size").cast("double"))), count=F.when(~half, F.col("size")),
        taker_side=taker, ts=F.when(half, F.col("opens_ms") / 1000).cast("long"), created_time=F.when(~half, _iso(F.col("opens_ms"))), trade_id=F.col("row_id"),
    )
    names = ["venue", "row_id", F.round("price", 4).alias("price"), "size", "is_buy", "stamp", "trade_id"]
    first = messages.binary_trades(c.select("row_id", m.alias("m"))).withColumn("venue", F.lit("dollar")).select(*names)
    token = F.when(half, "y").otherwise("n")
    noisy = F.format_string("%.10f", F.when(half, F.col("entry")).otherwise(100 - F.col("entry")) / 100 - 0.0000000031)
    m = F.concat(F.lit('{"asset":"'), token, F.lit('","price":'), noisy, F.lit(',"size":10,"side":"'), F.when(F.col("signal") % 2 == 0, "BUY").otherwise("SELL"), F.lit('","timestamp":'), (F.col("opens_ms") / 1000).cast("long"), F.lit(',"transactionHash":"0x'), F.col("row_id"), F.lit('"}'))
    second = venues.token_trades(c.select("row_id", F.lit("y").alias("yes_token"), m.alias("m"))).withColumn("venue", F.lit("token")).select(*names)
    return first.union(second)


def venue_fills(spark: SparkSession, d: str) -> DataFrame:
    """Own fills of both venues with their notional and the YES contracts they add."""
    c = views.contracts(spark, d)
    yes, buy, form = F.col("signal") % 2 == 0, F.col("row_id") % 4 < 2, F.col("row_id") % 3
    m = _json(
        ticker=F.concat(F.lit("M"), F.col("market_id")), order_id=F.col("row_id"), action=F.when(buy, "buy").otherwise("sell"), side=F.when(yes, "yes").otherwise("no"),
        yes_price_dollars=F.when(yes, F.format_string("%.2f", F.col("entry") / 100)), no_price=F.when(~yes, 100 - F.col("entry")), count=F.col("size"), fee_dollars=F.when(form == 0, "0.07"), fee_cents=F.when(form == 1, "3"), fee=F.when(form == 2, "0.01"),
        created_time=_iso(F.col("opens_ms")), trade_id=F.concat(F.lit("f"), F.col("row_id")),
    )
    first = venues.dollar_fills(c.select(m.alias("m"))).drop("m")
    m = _json(
        market=F.concat(F.lit("0x"), F.col("market_id")), taker_order_id=F.col("row_id"), side=F.when(buy, "BUY").otherwise("SELL"), outcome=F.when(yes, "Yes").otherwise("No"), price=F.format_string("%.2f", F.col("entry") / 100), size=F.col("size"),
        fee_rate_bps=F.when(form == 0, "200").otherwise("0"), match_time=(F.col("opens_ms") / 1000).cast("long"), id=F.concat(F.lit("g"), F.col("row_id")),
    )
    both = first.union(venues.token_fills(c.select(m.alias("m"))).drop("m"))
    num = lambda x: x.cast("double")
    return both.select("venue", "market_id", "order_id", "fill_id", "side", "outcome", num(F.col("price")).alias("price"), num(F.col("size")).alias("size"), F.round(num(F.col("fee")), 6).alias("fee"), "ts_ms", F.round(num(venues.notional()), 6).alias("notional"), num(venues.yes_delta()).alias("yes_delta"))


def perp_prints(spark: SparkSession, d: str) -> DataFrame:
    """Prints of trade messages; each message also carries one without a price, which goes."""
    t = views.tape(spark, d)
    m = F.concat(F.lit('{"data":[{"ts":"'), F.col("ts_ms"), F.lit('","price":"'), F.col("price"), F.lit('","size":"'), F.col("size"), F.lit('","side":"'), F.when(F.col("is_buy"), "buy").otherwise("sell"), F.lit('"},{"ts":"1","price":"","size":"1","side":"buy"}]}'))
    return messages.parser("perp", "trades")(t.select("instrument", "n", m.alias("m"))).drop("m")


def perp_book_levels(spark: SparkSession, d: str) -> DataFrame:
    """Level changes of book messages (objects and lists, numbers as text), by instrument, action and side."""
    t = views.numbered_touch(spark, d)
    body = F.concat(F.lit('{"bids":[["'), F.col("bid"), F.lit('","'), F.col("bid_size"), F.lit('"]],"asks":[["'), F.col("ask"), F.lit('","'), F.col("ask_size"), F.lit('"],["'), F.col("ask") + 1, F.lit('","0"]],"ts":"'), F.col("ts_ms"), F.lit('","seqId":"'), F.col("seq"), F.lit('","prevSeqId":"'), F.col("prev_seq"), F.lit('"}'))
    data = F.when(F.col("n") % 2 == 0, body).otherwise(F.concat(F.lit("["), body, F.lit("]")))
    m = F.concat(F.lit("{"), F.when(F.col("seq") % 97 == 1, "").otherwise('"action":"update",'), F.lit('"data":'), data, F.lit("}"))
    levels = messages.level_changes(messages.parser("perp", "books")(t.select("instrument", "n", m.alias("m"))))
    return levels.groupBy("instrument", "action", "side").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("price") * F.col("size")).alias("paid"), F.sum("seq").alias("seqs"), F.sum("prev_seq").alias("prev_seqs"), F.max("stamp").alias("last"))


def perp_rates(spark: SparkSession, d: str) -> DataFrame:
    """Funding messages as objects and lists, by symbol; each 11th rate can't be read and goes."""
    f = views.funding(spark, d)
    rate = F.when(F.col("ts_ms") % 11 == 0, F.lit("none")).otherwise(F.col("rate_bps").cast("int").cast("string"))
    body = _json(fundingRate=rate, fundingTime=F.col("ts_ms"))
    m = _nest("data", F.when(F.col("ts_ms") % 2 == 0, body).otherwise(F.concat(F.lit("["), body, F.lit("]"))))
    return messages.parser("perp", "funding")(f.select("symbol", m.alias("m"))).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("rate").alias("rate"), F.max("settles_ms").alias("last"))


def token_levels(spark: SparkSession, d: str) -> DataFrame:
    """Level changes of frames with entries of both tokens, in three shapes, by side and price of YES."""
    f = views.fills(spark, d)
    entry = lambda asset, price: _json(asset_id=asset, price=F.format_string("%.2f", price / 100), size=F.col("size"), side=F.when(F.col("side") == "buy", "BUY").otherwise("SELL"))
    two = F.concat(F.lit("["), entry("y", F.col("price")), F.lit(","), entry("n", F.col("price")), F.lit("]"))
    m = F.when(F.col("n") % 3 == 0, _nest("price_changes", two)).when(F.col("n") % 3 == 1, _nest("changes", two)).otherwise(entry("y", F.col("price")))
    rows = f.select(F.lit("y").alias("yes_token"), m.alias("m"))
    return messages.token_changes(rows).groupBy("side", "price").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))


def _states(spark: SparkSession, d: str) -> DataFrame:
    """Two states of each account, the second with a smaller position in the coin and one more, then an unchanged marker."""
    p = views.positions(spark, d)
    leg = lambda coin, size: F.concat(F.lit('{"position":'), F.concat(F.lit('{"coin":"'), coin, F.lit('","szi":"'), size.cast("string"), F.lit('","entryPx":"'), F.col("entry_px"), F.lit('","liquidationPx":'), F.coalesce(F.concat(F.lit('"'), F.col("liquidation_px").cast("string"), F.lit('"')), F.lit("null")), F.lit(',"positionValue":"1","leverage":{"type":"cross","value":5}}')), F.lit("}"))
    old = F.concat(F.lit('{"assetPositions":['), leg(F.col("coin"), F.round(F.col("size"))), F.lit("]}"))
    new = F.concat(F.lit('{"assetPositions":['), leg(F.col("coin"), F.col("user") % 5), F.lit(","), leg(F.lit("OTHER"), F.col("user") % 3 + 1), F.lit("]}"))
    t = F.col("observed_ms")
    state = lambda at, m: F.struct(at.alias("t"), m.alias("m"))
    return p.select("user", F.explode(F.array(state(t, old), state(t + 1000, F.when(F.col("user") % 2 == 0, new)), state(t + 2000, F.lit(None).cast("string")))).alias("s")).select("user", "s.t", "s.m")


def account_rows(spark: SparkSession, d: str) -> DataFrame:
    """Positions of each account's latest state."""
    p = messages.latest_positions(_states(spark, d))
    return p.select("user", "observed_ms", "coin", "size", "entry_px", F.round("liquidation_px", 6).alias("liquidation_px"), "leverage")


def liquidation_feed(spark: SparkSession, d: str) -> DataFrame:
    """Kinds and symbols of venue-wide liquidation messages."""
    f = views.fills(spark, d)
    sym = F.concat(F.lit("S"), F.col("market_id") % 20)
    m = F.when(F.col("n") % 4 == 0, F.concat(F.lit('{"e":"forceOrder","o":{"s":"'), sym, F.lit('"}}'))).when(F.col("n") % 4 == 1, F.concat(F.lit('{"topic":"allLiquidation.X","data":[{"s":"'), sym, F.lit('"},{"s":"Z"}]}'))).when(F.col("n") % 4 == 2, F.lit('{"op":"subscribe","success":true}')).otherwise(F.lit('{"x":1}'))
    return messages.liquidation_prints(f.select(m.alias("m"))).groupBy("kind", "symbol").agg(F.count(F.lit(1)).alias("n"))


def frame_types(spark: SparkSession, d: str) -> DataFrame:
    e = views.table(spark, d, "events")
    m = F.concat(F.lit('{"k":1, "event_type" : "'), F.col("event_type"), F.lit('"}'))
    return e.select(messages.event_type(m).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def accounts_seen(spark: SparkSession, d: str) -> DataFrame:
    o = views.contracts(spark, d).select(F.array("market_id", F.col("row_id") % 500).alias("users"), F.col("opens_ms").alias("stamp"))
    return messages.accounts_seen(o)


def maker_decisions(spark: SparkSession, d: str) -> DataFrame:
    c = views.contracts(spark, d)
    money = lambda x: (F.col(x) / 100).cast("decimal(9,6)")
    bid = ((F.col("entry") - 2 - F.col("row_id") % 3) / 100).cast("decimal(9,6)")
    return c.select("row_id", C.maker_decision(money("signal"), bid, money("entry"), "0.02").alias("x")).where("x is not null").select("row_id", "x.outcome", F.col("x.price").cast("double").alias("price"))


def _windows(spark: SparkSession, d: str) -> DataFrame:
    """Contracts over the tape: one for each instrument and six hours, whose result is the last print's parity."""
    t = views.tape(spark, d)
    w = t.groupBy("instrument", F.floor(F.col("ts_ms") / (6 * HOUR)).alias("w")).agg(F.max_by("price", F.struct("ts_ms", "n")).alias("close"))
    won = F.col("close") % 2 == 0
    m = _nest("market", _json(status=F.when(F.col("w") % 10 == 0, "active").otherwise("finalized"), result=F.when(won, "yes").otherwise("no")))
    return w.select("instrument", F.concat_ws(":", "instrument", F.col("w").cast("string")).alias("market_id"), (F.col("w") * 6 * HOUR).alias("opens_ms"), ((F.col("w") + 1) * 6 * HOUR).alias("resolves_ms"), F.when(F.col("w") % 13 == 0, "kraken").otherwise("oracle").alias("source"), m.alias("m"))


#: The end of 2024-01-25: contracts that resolve later are still open.
NOW_MS = 1_706_227_200_000


def label_rows(spark: SparkSession, d: str) -> DataFrame:
    """Labelled rows of resolved windows at two offsets; those of each 5th window at the first offset are there already."""
    w = _windows(spark, d)
    done = w.where("resolves_ms / 21600000 % 5 = 0").select("market_id", F.lit(HOUR).alias("offset_ms"))
    results = w.select("market_id", venues.dollar_result().alias("resolved_yes"), "source")
    return C.label_rows(w.drop("m"), results, views.book_top(spark, d), [HOUR, 3 * HOUR], ["instrument"], NOW_MS, done=done)


def _resting(spark: SparkSession, d: str) -> DataFrame:
    """An order of either side at, or a cent inside, each touch, for two hours."""
    t = views.book_top(spark, d)
    buy, inside = F.col("n") % 2 == 0, (F.col("n") % 3 == 0).cast("int")
    return t.select("instrument", F.col("n").alias("order_id"), F.when(buy, "buy").otherwise("sell").alias("side"), F.when(buy, F.col("bid") + inside).otherwise(F.col("ask") - inside).alias("price"), (F.col("bid_size") * 5).alias("size"), F.col("ask_size").alias("queue"), F.col("ts_ms").alias("start_ms"), (F.col("ts_ms") + 2 * HOUR).alias("end_ms"))


def improving_orders(spark: SparkSession, d: str) -> DataFrame:
    return C.improves_touch(_resting(spark, d), views.book_top(spark, d), ["instrument"]).select("order_id", "side", "improves")


def fill_brackets(spark: SparkSession, d: str) -> DataFrame:
    return C.fill_brackets(_resting(spark, d), views.tape(spark, d), views.book_top(spark, d), ["instrument"], 4 * HOUR)


_ISO = "strftime(make_timestamp({} * 1000), '%Y-%m-%dT%H:%M:%SZ')"
_RES = f"""{views.BOOK_SQL}, {views.TAPE_SQL}, rest as (select instrument, n order_id, case when n % 2 = 0 then 'buy' else 'sell' end side, case when n % 2 = 0 then bid + (n % 3 = 0)::int else ask - (n % 3 = 0)::int end price, bid_size * 5 size, ask_size queue, ts_ms a, ts_ms + {2 * HOUR} z from touch)"""
ORACLES = {
    "contract_dimension": f"""with {views.CONTRACT_SQL}
select row_id, 'dollar' venue, 'M' || market_id || '-' || row_id market_id, case when row_id % 5 <> 0 then 'Will it? ' || row_id else 'M' || market_id || '-' || row_id end question, resolves_ms, 'dollar:M' || market_id resolution_source, 'default' fee_tier, 0.01::double tick, 1.0::double min_size, null::varchar yes_token, null::varchar no_token, case when row_id % 3 = 0 then 0.001 else 0 end::double first_step from contracts where row_id % 17 <> 0
union all select row_id, 'token', '0x' || row_id, 'Will it? ' || row_id, resolves_ms, case when row_id % 7 = 0 then 'oracle' else 'token:uma:0x' || row_id end, case when fee_tier = 'fast' then 'fast' else 'unknown' end, 0.01::double, 5.0::double,
  case when row_id % 2 = 0 then 'a' else 'b' end || row_id, case when row_id % 2 = 0 then 'b' else 'a' end || row_id, 0::double from contracts where row_id % 17 <> 0""",
    "contract_results": f"with {views.CONTRACT_SQL} select row_id, case when row_id % 4 = 0 or row_id % 9 = 0 then 'open' when resolved_yes then 'yes' else 'no' end dollar, case when row_id % 4 = 0 or row_id % 9 = 0 then 'open' when resolved_yes then 'yes' else 'no' end token from contracts",
    "signed_changes": f"with {views.FILL_SQL} select case when n % 2 = 0 then 'bid' else 'ask' end side, round(case when n % 2 = 0 then price / 100.0::double else 1 - price / 100.0::double end, 4) price, count(*) n, sum(case when side = 'buy' then size else -size end)::double delta from fills group by 1, 2",
    "venue_books": f"with {views.CONTRACT_SQL} select v venue, row_id, round(bid / 100.0::double, 6) bid_price, 10.0::double bid_size, round(entry / 100.0::double, 6) ask_price, 7.0::double ask_size from contracts, (values ('dollar'), ('token')) k(v)",
    "venue_trades": f"""with {views.CONTRACT_SQL} select 'dollar' venue, row_id, round(entry / 100.0::double, 4) price, size::double size, signal % 2 = 0 is_buy, opens_ms stamp, row_id::varchar trade_id from contracts
union all select 'token', row_id, round(entry / 100.0::double, 4), 10.0::double, (signal % 2 = 0) = (row_id % 2 = 0), opens_ms, '0x' || row_id from contracts""",
    "venue_fills": f"""with {views.CONTRACT_SQL}, f as (select *, signal % 2 = 0 yes, row_id % 4 < 2 buy, row_id % 3 form from contracts),
b as (select 'dollar' venue, 'M' || market_id market_id, row_id::varchar order_id, 'f' || row_id fill_id, buy, yes, case when yes then entry else 100 - entry end / 100.0::double price, size::double size, case form when 0 then 0.07 when 1 then 0.03 else 0.01 end::double fee, opens_ms ts_ms from f
  union all select 'token', '0x' || market_id, row_id::varchar, 'g' || row_id, buy, yes, entry / 100.0::double, size::double, case when form = 0 then entry / 100.0::double * size * 200 / 10000 else 0 end, opens_ms from f)
select venue, market_id, order_id, fill_id, case when buy then 'buy' else 'sell' end side, case when yes then 'yes' else 'no' end outcome, round(price, 6) price, size, round(fee, 6) fee, ts_ms, round(price * size, 6) notional, case when buy = yes then size else -size end yes_delta from b""",
    "perp_prints": f"with {views.TAPE_SQL} select instrument, n, ts_ms stamp, price::double price, size::double size, is_buy from tape",
    "perp_book_levels": f"""with {views.BOOK_SQL}, l as (select instrument, seq, prev_seq, ts_ms, 'bid' side, bid price, bid_size size from touch union all select instrument, seq, prev_seq, ts_ms, 'ask', ask, ask_size from touch union all select instrument, seq, prev_seq, ts_ms, 'ask', ask + 1, 0 from touch)
select instrument, case when seq % 97 = 1 then 'snapshot' else 'update' end as action, side, count(*) n, sum(price * size)::double paid, sum(seq)::bigint seqs, sum(prev_seq)::bigint prev_seqs, max(ts_ms) as last from l group by 1, 2, 3""",
    "perp_rates": f"with {views.FUNDING_SQL} select symbol, count(*) n, sum(rate_bps)::double rate, max(ts_ms) as last from funding where ts_ms % 11 <> 0 group by 1",
    "token_levels": f"""with {views.FILL_SQL}, l as (select side = 'buy' buy, price, size from fills union all select side <> 'buy', 100 - price, size from fills where n % 3 <> 2) select case when buy then 'bid' else 'ask' end side, round(price / 100.0::double, 4) price, count(*) n, sum(size)::double size from l group by 1, 2""",
    "account_rows": f"""with {views.POSITION_SQL}, l as (select "user", observed_ms + case when "user" % 2 = 0 then 1000 else 0 end observed_ms, coin, case when "user" % 2 = 0 then "user" % 5 else round(size) end::double size, entry_px, liquidation_px from positions
  union all select "user", observed_ms + 1000, 'OTHER', ("user" % 3 + 1)::double, entry_px, liquidation_px from positions where "user" % 2 = 0)
select "user", observed_ms, coin, size, entry_px, round(liquidation_px, 6) liquidation_px, 5.0::double leverage from l where size <> 0""",
    "liquidation_feed": f"""with {views.FILL_SQL}, s as (select 'data' kind, 'S' || market_id % 20 symbol from fills where n % 4 in (0, 1) union all select 'data', 'Z' from fills where n % 4 = 1 union all select case when n % 4 = 2 then 'control' else 'unrouted' end, null from fills where n % 4 > 1) select kind, symbol, count(*) n from s group by 1, 2""",
    "frame_types": "select event_type tag, count(*) n from events group by 1",
    "accounts_seen": f"with {views.CONTRACT_SQL}, u as (select market_id u, opens_ms from contracts union all select row_id % 500, opens_ms from contracts) select u as \"user\", min(opens_ms) first_seen from u group by 1",
    "maker_decisions": f"""with {views.CONTRACT_SQL}, b as (select row_id, signal, entry, entry - 2 - row_id % 3 bid from contracts), k as (select row_id, case when entry - 1 > bid and signal - (entry - 1) >= 2 then 1 when bid + 1 < entry and bid + 1 - signal >= 2 then 2 end k, entry, bid from b)
select row_id, case k when 1 then 'YES' else 'NO' end outcome, case k when 1 then (entry - 1) / 100.0::double else 1 - (bid + 1) / 100.0::double end price from k where k is not null""",
    "label_rows": f"""with {views.BOOK_SQL}, {views.TAPE_SQL}, w as (select instrument, ts_ms // {6 * HOUR} w, arg_max(price, (ts_ms, n)) as close from tape group by 1, 2), m as (select instrument, ts_ms, arg_max(bid, n) bid, arg_max(ask, n) ask from touch where bid > 0 and bid < ask group by 1, 2),
q as (select instrument, instrument || ':' || w market_id, w, close, o offset_ms, (w + 1) * {6 * HOUR} - o at_ms from w, (values ({HOUR}), ({3 * HOUR})) f(o) where (w + 1) * {6 * HOUR} + 180000 <= {NOW_MS} and w % 10 <> 0 and w % 13 <> 0 and not (o = {HOUR} and (w + 1) % 5 = 0))
select q.market_id, q.offset_ms::int offset_ms, m.ts_ms touch_ms, m.ask entry_ask, m.bid entry_bid, close % 2 = 0 resolved_yes, {NOW_MS}::bigint labelled_ms from q asof join m on q.instrument = m.instrument and q.at_ms >= m.ts_ms""",
    "improving_orders": f"""with {_RES}, m as (select instrument, ts_ms, arg_max(bid, n) bid, arg_max(ask, n) ask from touch group by 1, 2) select order_id, side, price > bid and price < ask improves from rest asof join m on rest.instrument = m.instrument and rest.a >= m.ts_ms""",
    "fill_brackets": f"""with {_RES}, s as (select *, case when side = 'buy' then price else -price end p from rest),
p as (select order_id, sum(t.size) v, sum(case when t.price = s.price then t.size else 0 end) l, max((case when side = 'buy' then t.price else -t.price end < p)::int) b from s join tape t on t.instrument = s.instrument and t.ts_ms >= a and t.ts_ms < z and is_buy = (side = 'sell') and case when side = 'buy' then t.price else -t.price end <= p group by 1),
c as (select distinct order_id from s join touch t on t.instrument = s.instrument and t.ts_ms >= a and t.ts_ms < z and case when side = 'buy' then t.ask else -t.bid end <= p)
select s.order_id, case when c.order_id is not null then size else least(size, coalesce(v, 0)) end::bigint optimistic, case when c.order_id is not null or coalesce(b, 0) = 1 then size else least(size, greatest(0, coalesce(l, 0) - queue)) end::bigint pessimistic,
  case when c.order_id is not null then 'crossed' when coalesce(b, 0) = 1 then 'cleared' when v > 0 then 'print' end cause from s left join p using (order_id) left join c on c.order_id = s.order_id""",
}
QUERIES = [
    contract_dimension, contract_results, signed_changes, venue_books, venue_trades, venue_fills, perp_prints, perp_book_levels, perp_rates, token_levels, account_rows, liquidation_feed, frame_types, accounts_seen,
    maker_decisions, label_rows, improving_orders, fill_brackets,
]
