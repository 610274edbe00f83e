"""Venue messages (JSON text in ``m``) as flat rows of books, trades, funding, positions and prints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = "array<array<string>>"
_parsers: dict[tuple[str, str], Callable[[DataFrame], DataFrame]] = {}


def register_parser(venue: str, channel: str, parse: Callable[[DataFrame], DataFrame]) -> None:
    if (venue, channel) in _parsers:
        raise ValueError(f"{venue}/{channel} has a parser")
    _parsers[venue, channel] = parse


def parser(venue: str, channel: str) -> Callable[[DataFrame], DataFrame]:
    return _parsers[venue, channel]


def _one(m: Column, schema: str) -> Column:
    """A message that is an object, or an array with the object first."""
    as_list = F.get(F.from_json(m, f"array<{schema}>"), F.lit(0))
    return F.when(F.substring(F.ltrim(m), 1, 1) == "[", as_list).otherwise(F.from_json(m, schema))


def _levels(levels: Column) -> Column:
    return F.transform(F.coalesce(levels, F.array().cast(LEVELS)), lambda x: F.struct(F.get(x, F.lit(0)).try_cast("double").alias("price"), F.get(x, F.lit(1)).try_cast("double").alias("size")))


def perp_book(events: DataFrame) -> DataFrame:
    """action, seq, prev_seq, stamp, bids, asks (arrays of price, size) of book messages; a message without an action is a snapshot."""
    data = f"struct<bids:{LEVELS},asks:{LEVELS},ts:string,seqId:string,prevSeqId:string>"
    m = F.from_json("m", "struct<action:string,data:string>")
    body = _one(m["data"], data)
    out = events.withColumn("_m", m).withColumn("_d", body)
    return out.select(
        *events.columns, F.coalesce("_m.action", F.lit("snapshot")).alias("action"), F.col("_d.seqId").try_cast("long").alias("seq"), F.col("_d.prevSeqId").try_cast("long").alias("prev_seq"),
        F.col("_d.ts").try_cast("long").alias("stamp"), _levels(F.col("_d.bids")).alias("bids"), _levels(F.col("_d.asks")).alias("asks"),
    )


def level_changes(book: DataFrame) -> DataFrame:
    """A row for each level of a book message: side, price, size (0 removes it)."""
    both = F.concat(F.transform("bids", lambda x: F.struct(F.lit("bid").alias("side"), x["price"].alias("price"), x["size"].alias("size"))), F.transform("asks", lambda x: F.struct(F.lit("ask").alias("side"), x["price"].alias("price"), x["size"].alias("size"))))
    return book.withColumn("_l", F.explode(both)).select("*", "_l.side", "_l.price", "_l.size").drop("_l", "bids", "asks").where("price is not null and size is not null")


def perp_trades(events: DataFrame) -> DataFrame:
    """stamp, price, size, is_buy of each print; prints without a positive price and size or a time go."""
    rows = F.from_json(F.get_json_object("m", "$.data"), "array<struct<ts:string,price:string,size:string,side:string>>")
    out = events.withColumn("_t", F.explode(rows)).select(*events.columns, F.col("_t.ts").try_cast("long").alias("stamp"), F.col("_t.price").try_cast("double").alias("price"), F.col("_t.size").try_cast("double").alias("size"), (F.lower("_t.side") == "buy").alias("is_buy"))
    return out.where("price > 0 and size > 0 and stamp > 0")


def perp_funding(events: DataFrame) -> DataFrame:
    body = _one(F.get_json_object("m", "$.data"), "struct<fundingRate:string,fundingTime:string>")
    return events.withColumn("_f", body).select(*events.columns, F.col("_f.fundingRate").try_cast("double").alias("rate"), F.col("_f.fundingTime").try_cast("long").alias("settles_ms")).where("rate is not null")


def binary_book(events: DataFrame) -> DataFrame:
    """bids and asks of YES from books that list bids of both outcomes: dollars, a nested message, or cents.  A NO bid at q is a YES ask at 1 - q."""
    shape = lambda a, b: f"struct<{a}:{LEVELS},{b}:{LEVELS}>"
    dollars = F.from_json(F.get_json_object("m", "$.orderbook_fp"), shape("yes_dollars", "no_dollars"))
    nested = F.from_json(F.get_json_object("m", "$.msg"), shape("yes_dollars_fp", "no_dollars_fp"))
    cents = F.from_json(F.get_json_object("m", "$.orderbook"), shape("yes", "no"))
    scaled = lambda levels, by: F.transform(_levels(levels), lambda x: F.struct((x["price"] / by).alias("price"), x["size"].alias("size")))
    pick = lambda a, b, c: F.coalesce(F.when(a.isNotNull(), scaled(a, 1)), F.when(b.isNotNull(), scaled(b, 1)), F.when(c.isNotNull(), scaled(c, 100)))
    yes = pick(dollars["yes_dollars"], nested["yes_dollars_fp"], cents["yes"])
    no = pick(dollars["no_dollars"], nested["no_dollars_fp"], cents["no"])
    return events.withColumn("bids", yes).withColumn("asks", F.transform(no, lambda x: F.struct(F.round(1 - x["price"], 6).alias("price"), x["size"].alias("size"))))


def binary_trades(events: DataFrame) -> DataFrame:
    """price (of YES), size, is_buy, stamp: dollars or cents, count or count_fp, seconds or ISO time."""
    g = lambda k: F.get_json_object("m", f"$.{k}")
    price = F.coalesce(g("yes_price_dollars").try_cast("double"), g("yes_price").try_cast("double") / 100)
    size = F.coalesce(g("count_fp").try_cast("double"), g("count").try_cast("double"))
    stamp = F.coalesce(g("ts").try_cast("long") * 1000, F.unix_millis(F.try_to_timestamp(g("created_time"))))
    return events.select(*events.columns, price.alias("price"), size.alias("size"), (F.lower(g("taker_side")) == "yes").alias("is_buy"), stamp.alias("stamp"), g("trade_id").alias("trade_id")).where("price is not null and size > 0")


def token_changes(events: DataFrame, yes_token: str = "yes_token") -> DataFrame:
    """Level changes of frames that carry many, for both tokens: NO entries are mirrored to YES (price 1 - p, side flipped); an older key and single entries are read too."""
    entry = "array<struct<asset_id:string,price:string,size:string,side:string>>"
    many = F.coalesce(F.from_json(F.get_json_object("m", "$.price_changes"), entry), F.from_json(F.get_json_object("m", "$.changes"), entry), F.array(F.from_json("m", "struct<asset_id:string,price:string,size:string,side:string>")))
    out = events.withColumn("_c", F.explode(many))
    asset = F.coalesce(F.col("_c.asset_id"), F.get_json_object("m", "$.asset_id"))
    own = asset == F.col(yes_token)
    price, bid = F.col("_c.price").try_cast("double"), F.upper("_c.side") == "BUY"
    return out.select(*events.columns, F.when(own == bid, "bid").otherwise("ask").alias("side"), F.bround(F.when(own, price).otherwise(1 - price), 4).alias("price"), F.bround(F.col("_c.size").try_cast("double"), 6).alias("size")).where("price is not null and size is not null")


def account_positions(states: DataFrame, *more: str) -> DataFrame:
    """One row a position of account states (user, t, m): coin, size, entry_px, liquidation_px (null unless finite and above 0), position_value, leverage; empty positions go.
    ``more`` columns of the states come along."""
    leg = "struct<position:struct<coin:string,szi:string,entryPx:string,liquidationPx:string,positionValue:string,leverage:struct<type:string,value:double>>>"
    out = states.withColumn("_p", F.explode(F.from_json(F.get_json_object("m", "$.assetPositions"), f"array<{leg}>"))).withColumn("_p", F.col("_p.position"))
    liq = F.col("_p.liquidationPx").try_cast("double")
    return out.select(
        "user", F.col("t").alias("observed_ms"), "_p.coin", F.col("_p.szi").try_cast("double").alias("size"), F.col("_p.entryPx").try_cast("double").alias("entry_px"),
        F.when((liq > 0) & (liq < float("inf")), liq).alias("liquidation_px"), F.col("_p.positionValue").try_cast("double").alias("position_value"), F.col("_p.leverage.value").alias("leverage"), *more,
    ).where("size is not null and size <> 0")


def latest_positions(states: DataFrame) -> DataFrame:
    """Positions of each account's latest full state; ``unchanged`` markers (m null) carry the state before them on, and what a newer state lacks is closed."""
    newest = states.where("m is not null").groupBy("user").agg(F.max_by(F.struct("t", "m"), "t").alias("s")).select("user", "s.t", "s.m")
    return account_positions(newest)


def position_history(states: DataFrame) -> DataFrame:
    """Spans of positions: user, coin, size, opened_ms, confirmed_ms, closed_ms, states.

    A position holds from a full state of its account to the next one; states with the same size in a row are one span.  An ``unchanged``
    marker (m null) confirms the full state before it, and markers before any full state say nothing.  A coin that the next full state lacks is
    closed then, one of another size is closed and opened anew; closed_ms is null for what the latest state still holds."""
    order = Window.partitionBy("user").orderBy("t", F.col("m").isNull())
    numbered = states.select("user", "t", "m", F.count("m").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("_k")).where("_k > 0")
    full = numbered.groupBy("user", "_k").agg(F.min("t").alias("t"), F.max("m").alias("m"), F.max("t").alias("_seen"))
    known = full.withColumn("_next", F.lead("t").over(Window.partitionBy("user").orderBy("_k")))
    held = account_positions(known, "_k", "_next", "_seen").select("user", "coin", "size", "observed_ms", "_k", "_next", "_seen")
    coin = Window.partitionBy("user", "coin").orderBy("_k")
    goes_on = (F.lag("_k").over(coin) == F.col("_k") - 1) & (F.lag("size").over(coin) == F.col("size"))
    spans = held.withColumn("_new", (~F.coalesce(goes_on, F.lit(False))).cast("int")).withColumn("_span", F.sum("_new").over(coin.rowsBetween(Window.unboundedPreceding, 0)))
    return spans.groupBy("user", "coin", "_span").agg(
        F.max("size").alias("size"), F.min("observed_ms").alias("opened_ms"), F.max("_seen").alias("confirmed_ms"), F.max_by("_next", "_k").alias("closed_ms"), F.count(F.lit(1)).alias("states")
    ).drop("_span")


def liquidation_prints(events: DataFrame) -> DataFrame:
    """kind (data, control or unrouted) and symbol of venue-wide liquidation messages of two venues."""
    one, topic = F.get_json_object("m", "$.e"), F.get_json_object("m", "$.topic")
    symbols = F.when(one == "forceOrder", F.array(F.get_json_object("m", "$.o.s"))).when(topic.startswith("allLiquidation"), F.from_json(F.get_json_object("m", "$.data"), "array<struct<s:string>>")["s"])
    kind = F.when(symbols.isNotNull(), "data").when(F.get_json_object("m", "$.op").isNotNull() | F.get_json_object("m", "$.result").isNotNull() | F.get_json_object("m", "$.success").isNotNull(), "control").otherwise("unrouted")
    return events.withColumn("kind", kind).withColumn("symbol", F.explode_outer(symbols))


def event_type(frame: Column) -> Column:
    """The frame's tag, read without parsing it; "unknown" where there is none."""
    tag = F.regexp_extract(frame, r'"event_type"\s*:\s*"([A-Za-z0-9_]+)"', 1)
    return F.when(tag != "", tag).otherwise("unknown")


def single_frames(frames: DataFrame, frame: str = "m") -> DataFrame:
    """``frames`` with a row for each message of a batch (a JSON array), written anew without spaces; nth is its place in the batch.
    A frame that is one message, or an array that can't be read, stays as it came; an empty batch has no row."""
    batch = F.when(F.substring(F.ltrim(frame), 1, 1) == "[", F.from_json(F.col(frame), "array<string>"))
    others = [c for c in frames.columns if c != frame]
    return frames.select(*others, F.posexplode(F.coalesce(batch, F.array(F.col(frame)))).alias("nth", frame))


def accounts_seen(trades: DataFrame) -> DataFrame:
    """When each account was first party to a trade (users: both sides)."""
    return trades.select(F.explode("users").alias("user"), "stamp").groupBy("user").agg(F.min("stamp").alias("first_seen"))


register_parser("perp", "books", perp_book)
register_parser("perp", "trades", perp_trades)
register_parser("perp", "funding", perp_funding)
register_parser("binary", "book", binary_book)
register_parser("binary", "trade", binary_trades)
