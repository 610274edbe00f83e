"""Event-contract rows of two venues (JSON text in ``m``): contracts, results, trades, fills, books, signed changes.

Prices of the NO outcome are mirrored to YES (1 - p, side flipped) wherever rows are compared with YES books.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTRACT = ("venue", "market_id", "question", "resolves_at", "resolution_source", "fee_tier", "tick", "min_size", "yes_token", "no_token", "price_ranges")
#: The finest price and size of data feeds, as decimal places.
PRICE_PLACES, SIZE_PLACES = 4, 6
MONEY = "decimal(18,6)"


def _get(key: str, of: str = "m") -> Column:
    return F.get_json_object(of, f"$.{key}")


def _text(*keys: str) -> Column:
    """The first of the keys that is there and not empty."""
    return F.coalesce(*[F.when(_get(k) != "", _get(k)) for k in keys])


def _list(key: str) -> Column:
    """A list, or the JSON text of one."""
    return F.from_json(_get(key), "array<string>")


def _iso_ms(text: Column) -> Column:
    return F.unix_millis(F.try_to_timestamp(text))


def _yes_at(outcomes: Column) -> Column:
    """The place of YES in a list of outcomes; the first one where none is named so."""
    lower = F.transform(outcomes, F.lower)
    return F.when(F.array_contains(lower, "yes"), F.array_position(lower, "yes") - 1).otherwise(0).cast("int")


def dollar_contracts(rows: DataFrame) -> DataFrame:
    """Contracts of the venue that quotes in dollars and cents, from its market rows."""
    ticker = _get("ticker")
    series = F.coalesce(_text("series_ticker"), F.substring_index(ticker, "-", 1))
    steps = F.from_json(_get("price_ranges"), "array<struct<start:string,end:string,step:string>>")
    ranges = F.transform(F.coalesce(steps, F.array().cast("array<struct<start:string,end:string,step:string>>")), lambda r: F.struct(*[r[c].cast(MONEY).alias(c) for c in ("start", "end", "step")]))
    return rows.select(
        *rows.columns, F.lit("dollar").alias("venue"), ticker.alias("market_id"), F.coalesce(_text("title", "subtitle"), ticker).alias("question"), F.try_to_timestamp(_text("close_time", "expiration_time")).alias("resolves_at"),
        F.concat(F.lit("dollar:"), series).alias("resolution_source"), F.lit("default").alias("fee_tier"), F.lit("0.01").cast(MONEY).alias("tick"), F.lit("1").cast(MONEY).alias("min_size"),
        F.lit(None).cast("string").alias("yes_token"), F.lit(None).cast("string").alias("no_token"), ranges.alias("price_ranges"),
    )


def token_contracts(rows: DataFrame) -> DataFrame:
    """Contracts of the venue that settles in tokens, from its market rows; the YES token is the one at the place of the YES outcome."""
    tokens, outcomes = _list("clobTokenIds"), _list("outcomes")
    two = (F.size(tokens) == 2) & (F.size(outcomes) == 2)
    yes = _yes_at(outcomes)
    condition = _text("conditionId", "condition_id")
    source = F.trim(_get("resolutionSource"))
    return rows.select(
        *rows.columns, F.lit("token").alias("venue"), condition.alias("market_id"), F.coalesce(_get("question"), F.lit("")).alias("question"), F.try_to_timestamp(_text("endDate", "endDateIso", "end_date_iso")).alias("resolves_at"),
        F.coalesce(F.when(source != "", source), F.concat(F.lit("token:uma:"), condition)).alias("resolution_source"), F.coalesce(_text("feeType"), F.lit("unknown")).alias("fee_tier"),
        F.coalesce(_text("orderPriceMinTickSize"), F.lit("0.01")).cast(MONEY).alias("tick"), F.coalesce(_text("orderMinSize"), F.lit("5")).cast(MONEY).alias("min_size"),
        F.when(two, F.get(tokens, yes)).alias("yes_token"), F.when(two, F.get(tokens, 1 - yes)).alias("no_token"), F.array().cast(f"array<struct<start:{MONEY},end:{MONEY},step:{MONEY}>>").alias("price_ranges"),
    )


def quarantined(contracts: DataFrame) -> DataFrame:
    """Contracts that can't be used: without an end."""
    return contracts.where("resolves_at is null")


def usable_contracts(contracts: DataFrame) -> DataFrame:
    return contracts.where("resolves_at is not null")


def dollar_result(m: str = "m") -> Column:
    """Whether YES won, once the venue has finalised the market; null before, and where the result is neither."""
    result = F.lower(_get("market.result", m))
    return F.when((_get("market.status", m) == "finalized") & result.isin("yes", "no"), result == "yes")


def token_result(m: str = "m") -> Column:
    """Whether YES won, once the market is closed and its outcomes are priced 0 and 1; null before."""
    prices, outcomes = F.from_json(_get("outcomePrices", m), "array<string>"), F.from_json(_get("outcomes", m), "array<string>")
    settled = (_get("closed", m) == "true") & (F.array_sort(prices) == F.array(F.lit("0"), F.lit("1")))
    return F.when(settled, F.get(prices, _yes_at(outcomes)) == "1")


def signed_changes(rows: DataFrame) -> DataFrame:
    """side, price (of YES), delta: changes of a level's size, in cents, of either outcome's bids; a NO bid is a YES ask."""
    body = F.from_json(F.coalesce(_get("msg"), F.col("m")), "struct<side:string,price:string,delta:string>")
    price = F.col("_d.price").try_cast("double") / 100
    yes = F.lower(F.coalesce("_d.side", F.lit("yes"))) == "yes"
    out = rows.withColumn("_d", body)
    return out.select(*rows.columns, F.when(yes, "bid").otherwise("ask").alias("side"), F.round(F.when(yes, price).otherwise(1 - price), PRICE_PLACES).alias("price"), F.col("_d.delta").try_cast("double").alias("delta")).where("price is not null and delta is not null")


def token_book(rows: DataFrame, yes_token: str = "yes_token") -> DataFrame:
    """bids and asks (arrays of price, size) of YES from a book of either token."""
    levels = "array<struct<price:string,size:string>>"
    read = lambda k: F.transform(F.coalesce(F.from_json(_get(k), levels), F.array().cast(levels)), lambda x: F.struct(x["price"].try_cast("double").alias("price"), x["size"].try_cast("double").alias("size")))
    flip = lambda a: F.transform(a, lambda x: F.struct(F.round(1 - x["price"], PRICE_PLACES).alias("price"), x["size"].alias("size")))
    own = _get("asset_id") == F.col(yes_token)
    bids, asks = read("bids"), read("asks")
    return rows.select(*rows.columns, F.coalesce(_get("timestamp").try_cast("long"), F.lit(0)).alias("stamp"), F.when(own, bids).otherwise(flip(asks)).alias("bids"), F.when(own, asks).otherwise(flip(bids)).alias("asks"))


def token_trades(rows: DataFrame, yes_token: str = "yes_token") -> DataFrame:
    """price (of YES), size, is_buy, stamp, trade_id: prints of the data feed, rounded to its finest step, and of the live feed."""
    asset = F.coalesce(_get("asset"), _get("asset_id"))
    own = F.coalesce(asset == F.col(yes_token), F.lit(False)) | F.coalesce(F.lower(_get("outcome")) == "yes", F.lit(False))
    price, buy = F.bround(_get("price").try_cast("double"), PRICE_PLACES), F.upper(F.coalesce(_get("side"), F.lit("BUY"))) == "BUY"
    seconds = _get("asset").isNotNull()  # the data feed stamps seconds, the live one milliseconds
    stamp = _get("timestamp").try_cast("double") * F.when(seconds, 1000).otherwise(1)
    return rows.select(
        *rows.columns, F.round(F.when(own, price).otherwise(1 - price), PRICE_PLACES).alias("price"), F.bround(_get("size").try_cast("double"), SIZE_PLACES).alias("size"), F.when(own, buy).otherwise(~buy).alias("is_buy"),
        stamp.cast("long").alias("stamp"), F.coalesce(_text("transactionHash", "id"), F.lit("")).alias("trade_id"),
    ).where("price between 0 and 1 and size is not null")


FILL = ("venue", "market_id", "order_id", "side", "outcome", "price", "size", "fee", "ts_ms", "fill_id")


def dollar_fills(rows: DataFrame) -> DataFrame:
    """Own fills: the price is the outcome's own, in dollars or cents; the fee in dollars, cents, or plain."""
    outcome = F.lower(F.coalesce(_get("side"), F.lit("yes")))
    price = lambda o: F.coalesce(_get(f"{o}_price_dollars").try_cast(MONEY), (_get(f"{o}_price").try_cast(MONEY) / 100).cast(MONEY))
    fee = F.coalesce(_get("fee_dollars").try_cast(MONEY), (_get("fee_cents").try_cast(MONEY) / 100).cast(MONEY), _get("fee").try_cast(MONEY), F.lit(0).cast(MONEY))
    return rows.select(
        *rows.columns, F.lit("dollar").alias("venue"), _get("ticker").alias("market_id"), F.coalesce(_get("order_id"), F.lit("")).alias("order_id"), F.lower(F.coalesce(_get("action"), F.lit("buy"))).alias("side"), outcome.alias("outcome"),
        F.when(outcome == "yes", price("yes")).otherwise(price("no")).alias("price"), F.coalesce(_get("count_fp"), _get("count")).try_cast(MONEY).alias("size"), fee.alias("fee"),
        F.coalesce(_iso_ms(_get("created_time")), F.lit(0)).alias("ts_ms"), F.coalesce(_get("trade_id"), F.lit("")).alias("fill_id"),
    )


def token_fills(rows: DataFrame) -> DataFrame:
    """Own fills of the token venue: the fee is a rate on price times size."""
    price, size = _get("price").try_cast(MONEY), _get("size").try_cast(MONEY)
    rate = F.coalesce(_get("fee_rate_bps").try_cast(MONEY), F.lit(0))
    return rows.select(
        *rows.columns, F.lit("token").alias("venue"), F.coalesce(_get("market"), F.lit("")).alias("market_id"), F.coalesce(_text("taker_order_id", "order_id"), F.lit("")).alias("order_id"), F.lower(F.coalesce(_get("side"), F.lit("buy"))).alias("side"),
        F.lower(F.coalesce(_get("outcome"), F.lit("yes"))).alias("outcome"), price.alias("price"), size.alias("size"), (price.cast("double") * size.cast("double") * rate.cast("double") / 10_000).cast(MONEY).alias("fee"),
        (F.coalesce(_get("match_time").try_cast("double"), F.lit(0.0)) * 1000).cast("long").alias("ts_ms"), F.coalesce(_get("id"), F.lit("")).alias("fill_id"),
    )


def notional(price: str = "price", size: str = "size") -> Column:
    return F.col(price) * F.col(size)


def yes_delta(side: str = "side", outcome: str = "outcome", size: str = "size") -> Column:
    """The signed YES contracts that an order or fill adds: buying YES and selling NO add, the others take."""
    return F.when((F.col(side) == "buy") == (F.col(outcome) == "yes"), F.col(size)).otherwise(-F.col(size))


#: The fields of a live print that tell it from another.
PRINT_KEY = ("transaction_hash", "asset_id", "price", "size", "side", "timestamp")


def distinct_prints(rows: DataFrame, order: Sequence[str] = ("t", "n")) -> DataFrame:
    """Live prints (JSON in m) once each, with ``copies``: the earliest of those that agree in all fields of PRINT_KEY, whatever else they hold.
    Rows that lack a field agree in it.  An aggregate and no window, so a key with very many copies is merged before it is sent."""
    keyed = rows.groupBy(*[_get(k).alias(f"_{k}") for k in PRINT_KEY]).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_row"), F.count(F.lit(1)).alias("copies"))
    return keyed.select("_row.*", "copies")
