"""Scalar functions of prices, names, times and limits, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

BPS = 10_000.0
#: Quote suffixes and numeric multipliers, in the order they are tried.
QUOTES = ("-USDT", "USDT", "-USDC", "USDC", "-USD", "USD", "-PERP")
MULTIPLIERS = ("1000000", "100000", "10000", "1000", "100")


def canonical(symbol: Column) -> Column:
    """One name for a coin at all venues: the quote goes first, then a lower-case k before a capital, then one multiplier before a letter."""
    name = F.regexp_replace(symbol, f"(?:{'|'.join(QUOTES)})$", "")
    name = F.regexp_replace(name, "^k(?=[A-Z])", "")
    return F.upper(F.regexp_replace(name, f"^(?:{'|'.join(MULTIPLIERS)})(?=[A-Za-z])", ""))


def in_domain(price: Column) -> Column:
    """Prices of event contracts lie between 0 and 1."""
    return (price >= 0) & (price <= 1)


def mirrored(price: Column) -> Column:
    """The other outcome's price."""
    return 1 - price


def tick_at(price: Column, ranges: Column, default: Column) -> Column:
    """The step of the price range that holds ``price`` (start <= price < end), or the default tick."""
    return F.coalesce(F.get(F.filter(ranges, lambda r: (price >= r["start"]) & (price < r["end"])), F.lit(0))["step"], default)


def on_grid(price: Column, tick: Column) -> Column:
    """Whether a decimal price is a whole number of ticks."""
    return F.pmod(price, tick) == 0


def round_down(value: Column, step: Column) -> Column:
    """A decimal value to a whole number of steps below it."""
    return F.floor(value / step) * step


def mid(bid: Column, ask: Column) -> Column:
    return (bid + ask) / 2


def spread_bps(bid: Column, ask: Column) -> Column:
    return (ask - bid) / mid(bid, ask) * BPS


def microprice(bid: Column, ask: Column, bid_size: Column, ask_size: Column) -> Column:
    """The mid, pulled to the side with less size; the plain mid without size."""
    total = bid_size + ask_size
    return F.when(total > 0, (bid * ask_size + ask * bid_size) / total).otherwise(mid(bid, ask))


def imbalance(bid_depth: Column, ask_depth: Column) -> Column:
    total = bid_depth + ask_depth
    return F.when(total > 0, (bid_depth - ask_depth) / total).otherwise(0.0)


def devig(yes_odds: Column, no_odds: Column) -> Column:
    """The fair chance of YES from two-way decimal odds."""
    return (1 / yes_odds) / (1 / yes_odds + 1 / no_odds)


def horizon_tag(seconds: float) -> str:
    """A horizon as part of a column's name: 300s, 0p5s."""
    return f"{seconds:g}".replace(".", "p") + "s"


def binomial_tail(k: Column, n: Column, p: float = 0.5) -> Column:
    """P(at least k of n): terms by recurrence from the first, in one fold."""
    first = F.pow(F.lit(1 - p), n)
    step = p / (1 - p)
    start = F.struct(first.alias("term"), F.when(k <= 0, first).otherwise(0.0).alias("sum"))
    folded = F.aggregate(
        F.when(n >= 1, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>")), start,
        lambda s, i: F.struct((s["term"] * (n - i + 1) / i * step).alias("term"), (s["sum"] + F.when(i >= k, s["term"] * (n - i + 1) / i * step).otherwise(0.0)).alias("sum")),
    )
    return F.least(folded["sum"], F.lit(1.0))


def window_ticker(series: str, closes: Column, zone: str = "America/New_York") -> Column:
    """A rolling window's name from its close, in the exchange's time zone."""
    return F.concat(F.lit(series + "-"), F.upper(F.date_format(F.from_utc_timestamp(closes, zone), "yyMMMddHHmm")))


def window_start(ts_s: Column, width_s: int) -> Column:
    return F.floor(ts_s / width_s) * width_s


def leg_tag(client_id: Column) -> Column:
    """The shared tag of a carry's legs: carry and hexadecimal digits, before p, s or u."""
    tag = F.regexp_extract(client_id, "^(carry[0-9a-f]+)[psu]", 1)
    return F.when(tag != "", tag)


def liquidation_price(side: Column, entry: Column, size: Column, leverage: Column, mmr: Column, extra: Column, fee_bps: Column) -> Column:
    """Where a position is closed out, with a buffer for the fee, never beyond its entry; null where it can't be."""
    raw_long = (entry * (1 - 1 / leverage) - extra / size) / (1 - mmr)
    raw_short = (entry * (1 + 1 / leverage) + extra / size) / (1 + mmr)
    long = F.when(raw_long > 0, F.least(entry, raw_long * (1 + fee_bps / BPS)))
    return F.when(side == "long", long).otherwise(F.greatest(entry, raw_short * (1 - fee_bps / BPS)))


def liquidation_distance(size: Column, mark: Column, liq: Column) -> Column:
    """How far the mark is from the liquidation price, as a share of the mark; at or below 0 it is crossed."""
    return F.when(size >= 0, mark - liq).otherwise(liq - mark) / mark


def safe_leverage(side: Column, buffer: Column, mmr: Column) -> Column:
    """The largest leverage whose liquidation price (without extra margin and fees) is at least the share ``buffer`` away from the entry; 0 where none is."""
    room = F.when(side == "long", 1 - (1 - buffer) * (1 - mmr)).otherwise((1 + buffer) * (1 + mmr) - 1)
    return F.when((buffer > 0) & (buffer < 1) & (room > 0), 1 / F.nullif(room, F.lit(0))).otherwise(F.lit(0.0))


def against_reported(estimated: Column, reported: Column, tolerance: float = 0.01) -> Column:
    """struct(ok, error, reason): whether a model's price lies within a share of the one that the venue reports."""
    usable = estimated.isNotNull() & F.coalesce(reported > 0, F.lit(False))
    error = F.when(usable, F.abs(estimated - reported) / F.nullif(reported, F.lit(0)))
    ok = F.coalesce(error <= tolerance, F.lit(False))
    reason = F.when(~usable, "missing or invalid").when(~ok, "disagrees with the venue").otherwise("")
    return F.struct(ok.alias("ok"), error.alias("error"), reason.alias("reason"))


PARKINSON = 1 / (2 * math.sqrt(math.log(2))) * BPS
