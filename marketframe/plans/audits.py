"""Audits of proposed orders against the state of an account when each of them was placed, every reason given.

An order's state is what earlier fills have made of positions, costs and results, found by as-of joins with
running values; an order never sees a fill of its own time or later.  An order tagged
reduce_only takes a short path that checks the claim and little else.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketframe.functions.prices import liquidation_distance, liquidation_price
from marketframe.operators.costs import running_cost
from marketframe.operators.running import DAY, running, walked
from marketframe.operators.saved import saved
from marketframe.operators.timeseries import asof_join


def _reasons(*checks: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(why)) for bad, why in checks]))


def _before(orders: DataFrame, states: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Orders with the last values of fills before their time; 0 where there are none."""
    last = states.groupBy(*by, "ts_ms").agg(F.max_by(F.struct(*values), "n").alias("_s")).select(*by, "ts_ms", "_s.*")
    asked = orders.withColumn("_at", F.col("ts_ms")).withColumn("ts_ms", F.col("ts_ms") - 1)
    found = asof_join(asked, last, by, "ts_ms", values, bucket=30 * DAY).withColumn("ts_ms", F.col("_at")).drop("_at")
    return saved(found.withColumns({v: F.coalesce(v, F.lit(0.0)) for v in values}))  # read twice by the next join


def open_orders(orders: DataFrame, by: list[str], name: str = "open_orders") -> DataFrame:
    """``orders`` (ts_ms, done_ms: when filled, cancelled or expired, null while open) with the number of earlier ones of the key still open."""
    moves = orders.select(*by, "ts_ms", F.lit(1.0).alias("step")).union(orders.where("done_ms is not null").select(*by, F.col("done_ms").alias("ts_ms"), F.lit(-1.0)))
    sums = moves.groupBy(*by, "ts_ms").agg(F.sum("step").alias("step")).withColumn("n", F.lit(0))
    return _before(orders, running(sums, by, "ts_ms", ["ts_ms"], {name: ("sum", F.col("step"))}), by, [name])


#: Rows of a market from which its time is cut into buckets; one of fewer is walked in one go.
LONG = 1_000_000
#: Parts of the markets that are walked one after another, so that no more than a part's rows are moved at a time.
PARTS = 4
#: Rows of account states that may be sent to all tasks, and of an account's day among them; more of them meet the orders by as-of joins.
STATES, OF_A_DAY = 200_000, 64
KEY = ["account", "market_id"]


def _ledger() -> Callable[..., tuple]:
    """A market's machine: what it holds, its average cost and open orders.  An order (kind 0) sees what was before its time, a fill (2) all that came before it; 1 ends an order."""
    at, h, a, n, before = None, 0.0, 0.0, 0.0, (0.0, 0.0, 0.0)

    def step(ts: int, kind: int, q: float, price: float) -> tuple:
        nonlocal at, h, a, n, before
        if ts != at:
            at, before = ts, (h, a, n)
        if kind < 2:
            n += 1 if kind == 0 else -1
            return (*before, None, None)
        held, cost = h, a
        h = held + q
        if held == 0 or (held > 0) == (q > 0):
            a = (cost * abs(held) + price * abs(q)) / max(abs(h), 1e-12)
        elif h == 0:
            a = 0.0
        elif abs(q) > abs(held):
            a = price
        return held, cost, None, h, a

    return step


def _moves(payout: float | None) -> dict[str, Column]:
    """What a fill with held, cost, held_after and cost_after adds to what open positions have cost, and whether it closes."""
    paid = lambda h, c: F.abs(h) * (F.col(c) if payout is None else F.when(F.col(h) >= 0, F.col(c)).otherwise(payout - F.col(c)))
    closes = (F.signum("held") != 0) & (F.abs("held_after") < F.abs("held")) | (F.signum("held") * F.signum("held_after") < 0)
    return {"_risk": paid("held_after", "cost_after") - paid("held", "cost"), "_closes": closes}


def _walked(orders: DataFrame, fills: DataFrame, payout: float | None) -> DataFrame:
    """Orders (_kind 0) with held, cost and open_orders, and the account, ts_ms, _n, _gain, _risk and _closes of fills (2)."""
    own = [c for c in orders.columns if c not in (*KEY, "ts_ms")]
    none = [F.lit(None).cast(orders.schema[c].dataType).alias(c) for c in own]
    blank = [F.lit(None).cast(k).alias(c) for c, k in (("_n", "long"), ("_q", "double"), ("_p", "double"), ("_fee", "double"))]
    q = F.when(F.col("side") == "buy", F.col("size")).otherwise(-F.col("size")).cast("double")
    known = fills.where(" and ".join(f"{c} is not null" for c in (*KEY, "ts_ms")))
    events = orders.select(*KEY, "ts_ms", F.lit(0).alias("_kind"), *blank, *own)
    events = events.union(orders.where("done_ms is not null").select(*KEY, "done_ms", F.lit(1), *blank, *none))
    events = events.union(known.select(*KEY, "ts_ms", F.lit(2), F.col("n").cast("long"), q, F.col("price").cast("double"), F.coalesce(F.col("fee").cast("double"), F.lit(0.0)), *none))
    state = dict.fromkeys(("held", "cost", "open_orders", "held_after", "cost_after"), "double")
    made = walked(events, KEY, ["ts_ms", "_n"], ["ts_ms", "_kind", "_q", "_p"], _ledger, state).where("_kind <> 1")
    adds = (F.col("held") == 0) | (F.signum("held") == F.signum("_q"))
    gain = F.when(adds, 0.0).otherwise((F.col("_p") - F.col("cost")) * F.least(F.abs("held"), F.abs("_q")) * F.signum("held")) - F.col("_fee")
    fill = F.col("_kind") == 2
    made = made.withColumns({c: F.when(fill, x) for c, x in {"_gain": gain, **_moves(payout)}.items()})
    return made.withColumns({c: F.when(~fill, F.col(c)) for c in ("market_id", "held", "cost", "open_orders")}).drop("_q", "_p", "_fee", "held_after", "cost_after")


def _cut(orders: DataFrame, fills: DataFrame, payout: float | None) -> DataFrame:
    """``_walked`` for markets with very many rows, by scans over buckets of time."""
    made = saved(running_cost(fills, KEY).withColumn("cost", F.col("cost_before")).withColumns(_moves(payout)))
    seen = _before(orders, made.select(*KEY, "ts_ms", "n", F.col("held_after").alias("held"), F.col("cost_after").alias("cost")), KEY, ["held", "cost"])
    told = made.select("account", "ts_ms", F.lit(2).alias("_kind"), F.col("n").cast("long").alias("_n"), F.col("gain").alias("_gain"), "_risk", "_closes")
    return open_orders(seen, KEY).withColumn("_kind", F.lit(0)).unionByName(told, allowMissingColumns=True)


def order_state(orders: DataFrame, fills: DataFrame, payout: float | None = None, losses: bool = True, long: int = LONG, states: int = STATES) -> DataFrame:
    """``orders`` (account, market_id, order_id, ts_ms, done_ms: when filled, cancelled or expired, null while open...) with what was before each: held, cost (a
    unit's average) and open_orders of the market, and of the account at_risk (what open positions have cost), today (results of the order's UTC day) and losses:
    closing fills in a row that lost more than a billionth.  ``fills``: account, market_id, ts_ms, n, side, price, size, fee.  With a ``payout``, a unit sold short
    costs that less its price.

    Markets are walked in parts; an account's state is summed by time, a table of a row for each time that has fills."""
    rows = fills.select(*KEY).union(orders.select(*KEY)).groupBy(*KEY).agg(F.count(F.lit(1)).alias("_rows"))
    busy = saved(rows.where(F.col("_rows") > long).select(*KEY))
    part = F.pmod(F.xxhash64(*KEY), F.lit(PARTS))
    some = not busy.isEmpty()
    calm = lambda df: df.join(F.broadcast(busy), KEY, "left_anti") if some else df  # noqa: E731 - few, as each has many rows
    tables = [saved(_walked(calm(orders).where(part == i), calm(fills).where(part == i), payout)) for i in range(PARTS)]
    if some:
        tables.append(saved(_cut(orders.join(F.broadcast(busy), KEY, "left_semi"), fills.join(F.broadcast(busy), KEY, "left_semi"), payout)))
    made = functools.reduce(lambda a, b: a.unionByName(b), tables)
    asked, moves = made.where("_kind = 0").select(*orders.columns, "held", "cost", "open_orders"), made.where("_kind = 2")
    times = ["account", "ts_ms"]
    good = F.col("_closes") & (F.col("_gain") >= -1e-9)
    steps = moves.groupBy(*times).agg(F.sum("_risk").alias("_risk"), F.sum("_gain").alias("_gain"), F.count_if("_closes").alias("_closed"), F.max(F.when(good, F.col("_n"))).alias("_good"))
    if losses:  # closing fills after the last one of this time that didn't lose
        after = moves.where(F.col("_closes") & (F.col("_gain") < -1e-9)).join(steps.where("_good is not null").select(*times, "_good"), times).where("_n > _good")
        steps = steps.join(after.groupBy(*times).agg(F.count(F.lit(1)).alias("_after")), times, "left")
    steps = saved(steps.withColumn("_day", F.floor(F.col("ts_ms") / DAY)))
    total = running(steps, ["account"], "ts_ms", ["ts_ms"], {"at_risk": ("sum", F.col("_risk")), "_all": ("sum", F.col("_closed"))})
    total = running(total, ["account", "_day"], "ts_ms", ["ts_ms"], {"today": ("sum", F.col("_gain"))})
    if losses:
        total = running(total, ["account"], "ts_ms", ["ts_ms"], {"_base": ("max", F.when(F.col("_good").isNotNull(), F.col("_all") - F.coalesce("_after", F.lit(0))))})
        total = total.withColumn("losses", (F.col("_all") - F.coalesce("_base", F.lit(0))).cast("double"))
    names = ["at_risk", "today", *["losses"] * losses]
    total = saved(total.select(*times, "_day", *names))
    # a state holds until the account's next one, the last until the last order
    end = asked.agg(F.max("ts_ms").alias("t")).first()["t"]
    until = F.coalesce(F.lead("ts_ms").over(Window.partitionBy("account").orderBy("ts_ms")), F.greatest(F.lit(end), F.col("ts_ms")))
    size = total.groupBy("account", "_day").agg(F.count(F.lit(1)).alias("k"), F.min("ts_ms").alias("ts_ms")).agg(F.max("k").alias("most"), F.sum("k").alias("all"), F.countDistinct("account").alias("accounts"), F.max("ts_ms").alias("newest"), F.min("ts_ms").alias("oldest")).first()
    days = (max(size["newest"], end or 0) - size["oldest"]) // DAY + 1 if size["all"] else 0
    if size["all"] and (size["most"] > OF_A_DAY or size["all"] + size["accounts"] * days > states):
        plain = lambda *of: total.select("account", "_day", "ts_ms", F.lit(0).alias("n"), *of)
        out = _before(asked, plain(*[c for c in names if c != "today"]), ["account"], [c for c in names if c != "today"])
        return _before(out.withColumn("_day", F.floor(F.col("ts_ms") / DAY)), plain("today"), ["account", "_day"], ["today"]).drop("_day")
    spans = total.withColumnRenamed("ts_ms", "_from").withColumn("ts_ms", F.col("_from")).withColumn("_until", until)
    spans = spans.select(F.col("account").alias("_account"), "_from", "_until", F.explode(F.sequence("_day", F.floor(F.col("_until") / DAY))).alias("_on"), F.col("_day").alias("_of"), *[F.col(c).alias(f"_{c}") for c in names])
    day = F.floor(F.col("ts_ms") / DAY)
    met = asked.join(F.broadcast(spans), (F.col("account") == F.col("_account")) & (day == F.col("_on")) & (F.col("ts_ms") > F.col("_from")) & (F.col("ts_ms") <= F.col("_until")), "left")
    values = {c: F.coalesce(F.when(F.col("_of") == day, F.col("_today")) if c == "today" else F.col(f"_{c}"), F.lit(0.0)) for c in names}
    return met.select(*asked.columns, *[x.alias(c) for c, x in values.items()])


def contract_order_audit(orders: DataFrame, fills: DataFrame, limits: dict[str, float]) -> DataFrame:
    """``orders`` of event contracts (account, market_id, order_id, ts_ms, done_ms, side, price of 0 to 1, size, resolves_ms, reduce_only, halted) with
    the account's state and ``reasons``.

    ``limits``: window_s (no new risk so close to the resolution), daily_loss, contracts (a market), notional (open), orders (a market)."""
    state = order_state(orders, fills, 1.0, losses=False)
    signed = F.when(F.col("side") == "buy", F.col("size")).otherwise(-F.col("size"))
    held, price, size = F.col("held"), F.col("price"), F.col("size")
    reduces = (held != 0) & (F.signum(held) != F.signum(signed))
    shape = _reasons((size <= 0, "size not positive"), ((price < 0) | (price > 1), "price outside 0 to 1"))
    narrow = _reasons((~reduces, "does not reduce"), (reduces & (F.abs(signed) > F.abs(held)), "would flip the position"))
    broad = _reasons(
        (F.col("halted"), "halted"), ((F.col("resolves_ms") - F.col("ts_ms")) / 1000 <= limits["window_s"], "resolves soon"), (F.col("today") <= -limits["daily_loss"], "daily loss"),
        (F.abs(held + signed) > limits["contracts"], "too many contracts"), (F.col("at_risk") + price * size > limits["notional"], "open notional"), (F.col("open_orders") >= limits["orders"], "open orders"),
    )
    # of a malformed order only the first fault is told
    reasons = F.when(F.size(shape) > 0, F.slice(shape, 1, 1)).when(F.coalesce("reduce_only", F.lit(False)), narrow).otherwise(broad)
    return state.withColumn("reasons", reasons)


def perp_order_gates(orders: DataFrame, limits: dict[str, float]) -> DataFrame:
    """``orders`` of perpetuals (side buy or sell, price, size, leverage, spread_bps, edge_bps, book_age_ms, tape_stale_s, features_valid, connected, halted,
    reduce_only) with an account's state (held, cost, today, losses, open_orders), each with position_after, entry_after,
    liquidation, distance, allowance (the largest size that would fit) and ``reasons``.

    ``limits``: book_age_ms, tape_stale_s, spread_bps, leverage, order, orders, round_trip_bps, position, notional, daily_loss, open_loss,
    losses, distance, mmr, fee_bps."""
    price, size, held, lev = F.col("price"), F.col("size"), F.col("held").cast("double"), F.col("leverage")
    signed = F.when(F.col("side") == "buy", size).otherwise(-size)
    after = held + signed
    grows = F.signum(held) == F.signum(signed)
    entry = F.when((held == 0) | (F.col("cost") <= 0), price).when(~grows, F.col("cost")).otherwise((F.abs(held) * F.col("cost") + F.abs(signed) * price) / F.greatest(F.abs(held) + F.abs(signed), F.lit(1e-12)))
    sound = (after != 0) & (price > 0) & (lev > 0)
    liq = F.when(sound, liquidation_price(F.when(after > 0, "long").otherwise("short"), entry, F.greatest(F.abs(after), F.lit(1e-12)), F.greatest(lev, F.lit(1e-12)), F.lit(limits["mmr"]), F.lit(0.0), F.lit(limits["fee_bps"])))
    distance = F.when(sound, liquidation_distance(after, F.when(price > 0, price), liq))
    unrealised = F.when(held != 0, (price - F.col("cost")) * held).otherwise(0.0)
    no_price = price <= 0
    feed = [(F.col("halted"), "halted"), (~F.col("connected"), "not connected"), (~F.col("features_valid"), "features invalid"), (F.col("book_age_ms") > limits["book_age_ms"], "book too old"), (F.col("tape_stale_s") > limits["tape_stale_s"], "tape stale")]
    shape = [(no_price, "invalid price"), (size <= 0, "invalid size"), (lev <= 0, "invalid leverage")]
    rest = [
        (F.col("spread_bps") > limits["spread_bps"], "spread"), (lev > limits["leverage"], "leverage"), (size > limits["order"], "order size"), (F.col("open_orders") >= limits["orders"], "open orders"),
        (F.col("edge_bps") - limits["round_trip_bps"] <= 0, "edge below cost"), (F.abs(after) > limits["position"], "position"), (F.abs(after) * price > limits["notional"], "notional"),
        (F.col("today") + unrealised <= -limits["daily_loss"], "daily loss"), (unrealised <= -limits["open_loss"], "unrealised loss"), (F.col("losses") >= limits["losses"], "losses in a row"),
        (sound & distance.isNull(), "no liquidation price"), (distance < limits["distance"], "close to liquidation"),
    ]
    narrow = _reasons(
        (~F.col("connected"), "not connected"), (no_price, "invalid price"), (size <= 0, "invalid size"), (held == 0, "nothing to reduce"),
        ((held != 0) & (F.signum(held) * F.when(F.col("side") == "buy", 1).otherwise(-1) > 0), "wrong side"), ((held != 0) & ~grows & (size > F.abs(held)), "would flip the position"),
    )
    reasons = F.when(F.coalesce("reduce_only", F.lit(False)), narrow).when(no_price, _reasons(*feed, *shape)).otherwise(_reasons(*feed, *shape, *rest))
    fits = F.least(F.lit(float(limits["order"])), F.greatest(F.lit(0.0), limits["position"] - F.abs(held)))
    return orders.withColumns({"position_after": after, "entry_after": entry, "liquidation": liq, "distance": distance, "allowance": F.when(F.coalesce("reduce_only", F.lit(False)), F.abs(held)).otherwise(fits), "reasons": reasons})
