"""Queries of order audits with running state and of fills one by one, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.plans import audits as A
from marketframe.plans import contracts as C
from marketframe.sources import views

HOUR, DAY = 3_600_000, 86_400_000
CONTRACT_LIMITS = {"window_s": 600.0, "daily_loss": 3.217, "contracts": 60.5, "notional": 2600.123, "orders": 3.0}
PERP_LIMITS = {
    "book_age_ms": 900, "tape_stale_s": 40, "spread_bps": 17, "leverage": 8, "order": 45, "orders": 3, "round_trip_bps": 12, "position": 60.5, "notional": 3000.123, "daily_loss": 250.217,
    "open_loss": 400.217, "losses": 2, "distance": 0.15, "mmr": 0.01, "fee_bps": 6.0,
}


def _r(name: str) -> Column:
    """Four digits; a little is added, so that halves of the last digit don't hang on a sum's last bit."""
    return F.round(F.col(name) + 3e-7, 4).alias(name)


def _fills(spark: SparkSession, d: str, unit: float) -> DataFrame:
    f = views.fills(spark, d)
    return f.select(F.pmod("market_id", F.lit(7)).alias("account"), "market_id", "ts_ms", "n", "side", (F.col("price") / unit).alias("price"), "size", (F.col("fee") / unit).alias("fee"))


def _orders(fills: DataFrame) -> DataFrame:
    """An order proposed some hours after each fill of its market."""
    n = F.col("n")
    at = F.col("ts_ms") + HOUR * (1 + n % 5)
    side = F.when(n % 3 == 0, F.when(F.col("side") == "buy", "sell").otherwise("buy")).otherwise(F.col("side"))
    return fills.select("account", "market_id", n.alias("order_id"), at.alias("ts_ms"), F.when(n % 4 != 0, at + 3 * DAY * (n % 11)).alias("done_ms"), side.alias("side"), "price", F.col("size").cast("double").alias("size"), (n % 6 == 0).alias("reduce_only"), (n % 50 == 0).alias("halted"))


def contract_audit(spark: SparkSession, d: str) -> DataFrame:
    """Orders of event contracts against positions, money at risk and the day's result when each was placed."""
    fills = _fills(spark, d, 100.0)
    orders = _orders(fills).withColumn("resolves_ms", F.col("ts_ms") + F.col("order_id") % 40 * 60_000)
    made = A.contract_order_audit(orders, fills, CONTRACT_LIMITS)
    return made.select("order_id", "held", _r("at_risk"), _r("today"), F.col("open_orders").cast("long").alias("open_orders"), F.concat_ws("; ", "reasons").alias("reasons"))


def perp_gates(spark: SparkSession, d: str) -> DataFrame:
    """Orders of perpetuals against all gates, with the account's state when each was placed."""
    fills = _fills(spark, d, 1.0)
    state = A.order_state(_orders(fills), fills)
    n = F.col("order_id")
    asked = state.withColumns({
        "price": F.when(n % 97 == 0, 0.0).otherwise(F.col("price")), "size": F.when(n % 89 == 0, 0.0).otherwise(F.col("size")), "leverage": (n % 10).cast("double"), "spread_bps": (n % 20).cast("double"), "edge_bps": (n % 31).cast("double"),
        "book_age_ms": n % 1000, "tape_stale_s": (n % 43).cast("double"), "features_valid": n % 41 != 0, "connected": n % 53 != 0,
    })
    made = A.perp_order_gates(asked, PERP_LIMITS)
    return made.select("order_id", "position_after", *map(_r, ("entry_after", "liquidation", "distance")), "allowance", F.col("losses").cast("long").alias("losses"), F.concat_ws("; ", "reasons").alias("reasons"))


def _ledger(unit: str) -> str:
    return f"""with recursive {views.FILL_SQL}, o as (select market_id, market_id % 7 account, n, ts_ms, side, size, case when side = 'buy' then size else -size end::double q, price / {unit} p, fee / {unit} f, row_number() over (partition by market_id order by ts_ms, n) k from fills),
w as (select market_id, k, 0.0::double h, 0.0::double a0, q h1, p a1, -f gain from o where k = 1
  union all
  select o.market_id, o.k, w.h1, w.a1, w.h1 + q, case when w.h1 = 0 or sign(w.h1) = sign(q) then (w.a1 * abs(w.h1) + p * abs(q)) / abs(w.h1 + q) when w.h1 + q = 0 then 0 when abs(q) > abs(w.h1) then p else w.a1 end,
    case when w.h1 = 0 or sign(w.h1) = sign(q) then 0 else (p - w.a1) * least(abs(w.h1), abs(q)) * sign(w.h1) end - f from w join o on o.market_id = w.market_id and o.k = w.k + 1),
l as (select o.*, h, a0, h1, a1, gain, ts_ms // {DAY} dy, (abs(h1) < abs(h) or h * h1 < 0) closes from o join w using (market_id, k)),
lm as (select market_id, ts_ms, arg_max(h1, n) held, arg_max(a1, n) cost from l group by all),
od as (select account, market_id, n oid, ts_ms + {HOUR} * (1 + n % 5) ts, case when n % 4 <> 0 then ts_ms + {HOUR} * (1 + n % 5) + {3 * DAY} * (n % 11) end done, case when n % 3 = 0 then case when side = 'buy' then 'sell' else 'buy' end else side end side, p price, size::double size, n % 6 = 0 reduce_only, n % 50 = 0 halted from o),
mv as (select market_id, t, sum(step) step from (select market_id, ts t, 1 step from od union all select market_id, done, -1 from od where done is not null) group by all),
oo as (select market_id, t, sum(step) over (partition by market_id order by t) open_orders from mv),
dd as (select account, dy, ts_ms, arg_max(s, n) today from (select account, dy, ts_ms, n, sum(gain) over (partition by account, dy order by ts_ms, n) s from l) group by all),
s1 as (select od.*, coalesce(held, 0) held, coalesce(cost, 0) cost from od asof left join lm on od.market_id = lm.market_id and od.ts - 1 >= lm.ts_ms),
s2 as (select s1.*, coalesce(open_orders, 0)::bigint open_orders from s1 asof left join oo on s1.market_id = oo.market_id and s1.ts - 1 >= oo.t),
s3 as (select s2.*, coalesce(today, 0) today from (select *, ts // {DAY} dy from s2) s2 asof left join dd on s2.account = dd.account and s2.dy = dd.dy and s2.ts - 1 >= dd.ts_ms)"""


_PA, _SG = "held + sg", "case when side = 'buy' then size else -size end"
_P = PERP_LIMITS
_FEED = f"case when halted then 'halted' end, case when oid % 53 = 0 then 'not connected' end, case when oid % 41 = 0 then 'features invalid' end, case when oid % 1000 > {_P['book_age_ms']} then 'book too old' end, case when oid % 43 > {_P['tape_stale_s']} then 'tape stale' end, case when price <= 0 then 'invalid price' end, case when size <= 0 then 'invalid size' end, case when lev <= 0 then 'invalid leverage' end"
_UN = "case when held <> 0 then (price - cost) * held else 0 end"
ORACLES = {
    "contract_audit": f"""{_ledger('100.0::double')}, ar as (select account, ts_ms, arg_max(s, n) at_risk from (select account, ts_ms, n, sum(abs(h1) * case when h1 >= 0 then a1 else 1 - a1 end - abs(h) * case when h >= 0 then a0 else 1 - a0 end) over (partition by account order by ts_ms, n) s from l) group by all),
s4 as (select s3.*, coalesce(at_risk, 0) at_risk, {_SG} sg, (oid % 40 * 60000) / 1000.0::double sec from s3 asof left join ar on s3.account = ar.account and s3.ts - 1 >= ar.ts_ms),
r as (select *, held <> 0 and sign(held) <> sign(sg) reduces from s4)
select oid order_id, held, round(at_risk + 3e-7, 4) at_risk, round(today + 3e-7, 4) today, open_orders, case when size <= 0 then 'size not positive' when price < 0 or price > 1 then 'price outside 0 to 1' when reduce_only then concat_ws('; ', case when not reduces then 'does not reduce' end, case when reduces and abs(sg) > abs(held) then 'would flip the position' end)
  else concat_ws('; ', case when halted then 'halted' end, case when sec <= 600 then 'resolves soon' end, case when today <= -3.217::double then 'daily loss' end, case when abs(held + sg) > 60.5 then 'too many contracts' end, case when at_risk + price * size > 2600.123::double then 'open notional' end, case when open_orders >= 3 then 'open orders' end) end reasons from r""",
    "perp_gates": f"""{_ledger('1.0::double')}, cl as (select account, ts_ms, n, closes, gain, sum(closes::int) over (partition by account order by ts_ms, n) c from l),
lo as (select account, ts_ms, arg_max(c - coalesce(g, 0), n) losses from (select *, max(case when closes and gain >= -1e-9 then c end) over (partition by account order by ts_ms, n) g from cl) group by all),
s4 as (select s3.* exclude (price, size), case when oid % 97 = 0 then 0 else price end price, case when oid % 89 = 0 then 0 else size end size, coalesce(losses, 0)::bigint losses, (oid % 10)::double lev from s3 asof left join lo on s3.account = lo.account and s3.ts - 1 >= lo.ts_ms),
s5 as (select *, {_SG} sg from s4),
s6 as (select *, {_PA} pa, case when held = 0 or cost <= 0 then price when sign(held) <> sign(sg) then cost else (abs(held) * cost + abs(sg) * price) / (abs(held) + abs(sg)) end en, ({_PA}) <> 0 and price > 0 and lev > 0 sound from s5),
s7 as (select *, case when sound then case when pa > 0 then case when en * (1 - 1 / lev) / 0.99::double > 0 then least(en, en * (1 - 1 / lev) / 0.99::double * 1.0006::double) end else greatest(en, en * (1 + 1 / lev) / 1.01::double * 0.9994::double) end end liq from s6),
s8 as (select *, case when sound then (case when pa >= 0 then price - liq else liq - price end) / price end dist, {_UN} un from s7)
select oid order_id, pa position_after, round(en + 3e-7, 4) entry_after, round(liq + 3e-7, 4) liquidation, round(dist + 3e-7, 4) distance, case when reduce_only then abs(held) else least(45, greatest(0, 60.5 - abs(held))) end::double allowance, losses,
  case when reduce_only then concat_ws('; ', case when oid % 53 = 0 then 'not connected' end, case when price <= 0 then 'invalid price' end, case when size <= 0 then 'invalid size' end, case when held = 0 then 'nothing to reduce' end, case when held <> 0 and sign(held) * (case when side = 'buy' then 1 else -1 end) > 0 then 'wrong side' end, case when held <> 0 and sign(held) <> sign(sg) and size > abs(held) then 'would flip the position' end)
  when price <= 0 then concat_ws('; ', {_FEED})
  else concat_ws('; ', {_FEED}, case when oid % 20 > 17 then 'spread' end, case when lev > 8 then 'leverage' end, case when size > 45 then 'order size' end, case when open_orders >= 3 then 'open orders' end, case when oid % 31 - 12 <= 0 then 'edge below cost' end, case when abs(pa) > 60.5 then 'position' end, case when abs(pa) * price > 3000.123::double then 'notional' end,
    case when today + un <= -250.217::double then 'daily loss' end, case when un <= -400.217::double then 'unrealised loss' end, case when losses >= 2 then 'losses in a row' end, case when sound and dist is null then 'no liquidation price' end, case when dist < 0.15::double then 'close to liquidation' end) end reasons from s8""",
}
QUERIES = [contract_audit, perp_gates]
