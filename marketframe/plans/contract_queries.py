"""Queries over event contracts, fees, positions and fills, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketframe.functions import fees, prices
from marketframe.operators.saved import saved
from marketframe.plans import contracts as C
from marketframe.sources import views


def _trades(spark: SparkSession, d: str) -> DataFrame:
    """Decisions of the taker rule, without overlap, with their fee."""
    rows = views.contracts(spark, d)
    p = (F.col("entry") / 100).cast("decimal(9,6)")
    fee = fees.curve_fee(F.lit("0.07").cast("decimal(9,6)"), p, F.lit(1), F.lit(False)).cast("double")
    decided = rows.withColumn("decision", C.taker_decision(F.col("signal") / 100, F.col("bid") / 100, F.col("entry") / 100, fee, 0.03)).where("decision is not null")
    decided = decided.select("market_id", "row_id", "opens_ms", "resolves_ms", "resolved_yes", "decision", "size", "fee_tier")
    free = C.without_overlap(decided, ["market_id"], "opens_ms", "resolves_ms", "row_id")
    priced = free.select("market_id", "row_id", "opens_ms", "resolves_ms", "resolved_yes", "decision.outcome", F.bround("decision.price", 6).cast("decimal(9,6)").alias("price"), "size", F.lit("alpha").alias("venue"), F.col("fee_tier").alias("tier"), F.lit("taker").alias("role"))
    return fees.with_fee(priced, fees.curves(spark)).withColumn("fee", F.col("fee").cast("double")).withColumn("price", F.col("price").cast("double"))


def contract_trades(spark: SparkSession, d: str) -> DataFrame:
    return C.results(_trades(spark, d)).select("market_id", "row_id", "outcome", F.round("price", 6).alias("price"), F.round("fee", 6).alias("fee"), "won", F.round("net", 6).alias("net"))


def contract_totals(spark: SparkSession, d: str) -> DataFrame:
    t = C.results(_trades(spark, d))
    return t.agg(F.count(F.lit(1)).alias("trades"), F.sum(F.col("won").cast("int")).alias("wins"), F.round(F.sum("gross"), 4).alias("gross"), F.round(F.sum("fee"), 4).alias("fees"), F.round(F.sum("net"), 4).alias("net"), F.round(F.sum("net") / F.sum(F.col("price") * F.col("size")), 6).alias("per_dollar"))


def contract_controls(spark: SparkSession, d: str) -> DataFrame:
    t = saved(_trades(spark, d))
    real = C.results(t).agg(F.sum("net").alias("real"))
    c = C.label_controls(t, 200).agg(F.avg("net").alias("mean"), F.collect_list("net").alias("all"))
    return real.join(F.broadcast(c)).select(F.round("real", 4).alias("real"), F.round("mean", 4).alias("mean"), F.when(F.size("all") > 0, F.round(F.size(F.filter("all", lambda x: F.round(x, 6) < F.round("real", 6))) / F.size("all"), 4)).alias("percentile"))


def label_guard(spark: SparkSession, d: str) -> DataFrame:
    rows = views.contracts(spark, d)
    labelled = F.col("resolves_ms") + F.when(F.col("row_id") % 11 == 0, -1).otherwise(60_000)
    source = F.when(F.col("row_id") % 13 == 0, "Binance").otherwise("oracle")
    return rows.select("row_id", C.label_problems(F.col("opens_ms"), F.col("resolves_ms"), labelled, source, F.lit("oracle")).alias("r")).select("row_id", F.concat_ws("; ", "r").alias("reasons"))


def fee_table(spark: SparkSession, d: str) -> DataFrame:
    rows = views.contracts(spark, d).select("row_id", F.lit("alpha").alias("venue"), F.col("fee_tier").alias("tier"), F.when(F.col("row_id") % 2 == 0, "maker").otherwise("taker").alias("role"), (F.col("entry") / 100).cast("decimal(9,6)").alias("price"), "size")
    return fees.with_fee(rows, fees.curves(spark)).select("row_id", "role", F.col("fee").cast("double").alias("fee"))


def fee_checks(spark: SparkSession, d: str) -> DataFrame:
    """Problems of the fee tables, for the tiers that orders use."""
    used = views.contracts(spark, d).select(F.col("fee_tier").alias("tier")).distinct()
    return fees.curve_violations(fees.curves(spark)).join(used, "tier", "left_semi")


def price_grid(spark: SparkSession, d: str) -> DataFrame:
    price = (F.col("entry") / 100).cast("decimal(18,6)")
    step = F.struct(F.lit("0.000000").cast("decimal(18,6)").alias("start"), F.lit("0.100000").cast("decimal(18,6)").alias("end"), F.lit("0.010000").cast("decimal(18,6)").alias("step"))
    rows = views.contracts(spark, d).select("row_id", price.alias("p"))
    tick = prices.tick_at(F.col("p"), F.array(step), F.lit("0.020000").cast("decimal(18,6)"))
    return rows.select("row_id", prices.in_domain(F.col("p")).alias("valid"), tick.cast("double").alias("tick"), prices.on_grid(F.col("p"), tick).alias("on_grid"), prices.mirrored(F.col("p")).cast("double").alias("no_price"))


def liquidation_audit(spark: SparkSession, d: str) -> DataFrame:
    p = views.positions(spark, d)
    side = F.when(F.col("size") >= 0, "long").otherwise("short")
    liq = prices.liquidation_price(side, F.col("entry_px"), F.abs("size"), F.lit(5.0), F.lit(0.01), F.lit(0.0), F.lit(6.0))
    return p.select("user", side.alias("side"), F.round(liq, 6).alias("liq"), F.round(prices.liquidation_distance(F.col("size"), F.col("mark_px"), F.col("liquidation_px")), 6).alias("distance"))


def margin_tiers(spark: SparkSession, d: str) -> DataFrame:
    p = views.positions(spark, d)
    step = F.explode(F.sequence(F.lit(0), F.lit(4)))
    tiers = p.select("coin").distinct().select("coin", step.alias("k")).select("coin", (F.col("k") * 2000.0 + 100).alias("min_size"), ((F.col("k") + 1) * 2000.0 + 100).alias("max_size"), (F.col("k") * 0.01 + 0.005).alias("mmr"))
    return fees.tier_for(p, tiers).select("user", F.round("mmr", 6).alias("mmr"))


def liquidation_map(spark: SparkSession, d: str) -> DataFrame:
    """Per coin, side and band of distance: size, notional, positions, accounts; side and coin totals from the same pass."""
    p = views.positions(spark, d)
    dist = prices.liquidation_distance(F.col("size"), F.col("mark_px"), F.col("liquidation_px"))
    rows = p.withColumn("side", F.when(F.col("size") >= 0, "long").otherwise("short")).withColumn("distance", dist)
    kind = F.when(F.col("distance").isNull(), "no price").when(F.col("distance") <= 0, "crossed").when(F.col("distance") >= 0.25, "beyond").otherwise("band")
    banded = rows.withColumn("kind", kind).withColumn("band", F.when(F.col("kind") == "band", F.floor(F.col("distance") / 0.05)))
    sets = banded.groupingSets([["coin", "side", "kind", "band"], ["coin", "side"], ["coin"]], "coin", "side", "kind", "band")
    made = sets.agg(F.grouping_id().alias("level"), F.sum(F.round(F.abs("size") * 100).cast("long")).alias("size_cents"), F.count(F.lit(1)).alias("positions"), F.countDistinct("user").alias("accounts"), F.round(F.sum("position_value") / 1000, 3).alias("notional_k"))
    return made.withColumn("level", F.col("level").cast("int"))


def ledger_positions(spark: SparkSession, d: str) -> DataFrame:
    out = C.average_cost(views.fills(spark, d), ["market_id"])
    return out.select("market_id", F.round("position", 4).alias("position"), F.round("cost", 3).alias("cost"), F.round("realised", 3).alias("realised"))


def ledger_totals(spark: SparkSession, d: str) -> DataFrame:
    f = views.fills(spark, d)
    signed = F.when(F.col("side") == "buy", F.col("size")).otherwise(-F.col("size"))
    return f.groupBy("market_id").agg(F.sum(signed).alias("position"), F.sum("fee").alias("fees"), F.sum(signed * F.col("price")).alias("paid"), F.count(F.lit(1)).alias("fills"))


def ledger_reconcile(spark: SparkSession, d: str) -> DataFrame:
    f = views.fills(spark, d)
    return C.reconcile(f.where("n % 3 <> 0"), f.where("n % 5 <> 0"), ["market_id", "n"])


def order_limits(spark: SparkSession, d: str) -> DataFrame:

    f = views.fills(spark, d)
    signed = F.when(F.col("side") == "buy", F.col("size")).otherwise(-F.col("size"))
    w = Window.partitionBy("market_id").orderBy("ts_ms", "n").rowsBetween(Window.unboundedPreceding, 0)
    orders = f.select("market_id", "n", (F.col("size") * F.col("price")).alias("notional"), F.sum(signed).over(w).alias("position_after"), F.sum(F.col("size") * F.col("price")).over(w).alias("open_notional"), F.sum("fee").over(w).alias("loss"))
    return C.order_audit(orders, {"order": 4000, "position": 150, "open": 20000, "loss": 60}).select("market_id", "n", F.concat_ws("; ", "reasons").alias("reasons"))


_DECIDE = views.CONTRACT_SQL + """,
dec as (select *, cast(round(0.07::decimal(9,6) * (entry / 100.0::double)::decimal(9,6) * (1 - (entry / 100.0::double)::decimal(9,6)), 8) as double) f from contracts),
edg as (select *, signal / 100.0::double - entry / 100.0::double - f yes_, (1 - signal / 100.0::double) - (1 - bid / 100.0::double) - f no_ from dec),
chs as (select *, case when yes_ >= 0.03::double and yes_ >= no_ then 'YES' when no_ >= 0.03::double then 'NO' end outcome from edg),
pick as (select *, case when outcome = 'YES' then entry / 100.0::double else 1 - bid / 100.0::double end price, row_number() over (partition by market_id order by opens_ms, row_id) k from chs where outcome is not null),
walk as (
  with recursive w as (
    select market_id, k, row_id, resolves_ms busy, true took from pick where k = 1
    union all
    select p.market_id, p.k, p.row_id, case when p.opens_ms >= w.busy then p.resolves_ms else w.busy end, p.opens_ms >= w.busy from w join pick p on p.market_id = w.market_id and p.k = w.k + 1)
  select market_id, row_id from w where took),
trd as (select p.*, cast(ceil(round((case when fee_tier = 'fast' then 0.035::decimal(9,6) else 0.07::decimal(9,6) end) * price::decimal(9,6) * (1 - price::decimal(9,6)) * size, 8) * 100) / 100 as double) fee from pick p semi join walk using (market_id, row_id)),
res as (select *, (outcome = 'YES') = resolved_yes won, case when (outcome = 'YES') = resolved_yes then size else 0 end - price * size gross, case when (outcome = 'YES') = resolved_yes then size else 0 end - price * size - fee net from trd)"""
_SIDE = "case when size >= 0 then 'long' else 'short' end"
_DIST = "case when size >= 0 then mark_px - liquidation_px else liquidation_px - mark_px end / mark_px"

ORACLES = {
    "contract_trades": f"with {_DECIDE} select market_id, row_id, outcome, round(price, 6) price, round(fee, 6) fee, won, round(net, 6) net from res",
    "contract_totals": f"with {_DECIDE} select count(*) trades, sum(won::int)::bigint wins, round(sum(gross), 4) gross, round(sum(fee), 4) fees, round(sum(net), 4) net, round(sum(net) / sum(price * size), 6) per_dollar from res",
    "contract_controls": f"""with {_DECIDE}, sd as (select trd.*, seed from trd, range(1, 201) s(seed)), a as (select * exclude (resolved_yes), row_number() over (partition by seed order by row_id) nth from sd),
b as (select seed, resolved_yes, row_number() over (partition by seed order by md5(seed || '|' || row_id), row_id) nth from sd), c as (select seed, sum(case when (outcome = 'YES') = resolved_yes then size else 0 end - price * size - fee) net from a join b using (seed, nth) group by 1)
select round((select sum(net) from res), 4) "real", round(avg(net), 4) mean, round(avg((round(net, 6) < round((select sum(net) from res), 6))::int), 4) percentile from c""",
    "label_guard": f"with {views.CONTRACT_SQL} select row_id, concat_ws('; ', case when row_id % 11 = 0 then 'labelled before resolution' end, case when row_id % 13 = 0 then 'another source' end, case when row_id % 13 = 0 then 'spot source' end, case when opens_ms >= resolves_ms then 'entry after resolution' end) reasons from contracts",
    "fee_table": f"with {views.CONTRACT_SQL}, p as (select row_id, case when row_id % 2 = 0 then 'maker' else 'taker' end as role, fee_tier, (entry / 100.0::double)::decimal(9,6) p, size from contracts) select row_id, role, cast(ceil(round((case when role = 'maker' then case when fee_tier = 'fast' then 0 else 0.0175 end else case when fee_tier = 'fast' then 0.035 else 0.07 end end)::decimal(9,6) * p * (1 - p) * size, 8) * 100) / 100 as double) fee from p",
    "fee_checks": "select 'x' venue, 'y' tier, 'z' problem where false",
    "price_grid": f"with {views.CONTRACT_SQL} select row_id, entry between 0 and 100 valid, case when entry < 10 then 0.01::double else 0.02::double end tick, entry % (case when entry < 10 then 1 else 2 end) = 0 on_grid, ((100 - entry) / 100.0::double) no_price from contracts",
    "liquidation_audit": f"with {views.POSITION_SQL}, q as (select *, (entry_px * (1 - 1 / 5.0::double) - 0.0::double / abs(size)) / (1 - 0.01::double) lo, (entry_px * (1 + 1 / 5.0::double) + 0.0::double / abs(size)) / (1 + 0.01::double) hi from positions) select \"user\", {_SIDE} side, round(case when size >= 0 then case when lo > 0 then least(entry_px, lo * (1 + 6.0::double / 10000)) end else greatest(entry_px, hi * (1 - 6.0::double / 10000)) end, 6) liq, round({_DIST}, 6) distance from q",
    "margin_tiers": f"with {views.POSITION_SQL} select \"user\", round(least(4, greatest(0, ceil((abs(size) - 100) / 2000.0::double) - 1)) * 0.01::double + 0.005::double, 6) mmr from positions",
    "liquidation_map": f"""with {views.POSITION_SQL}, r as (select *, {_SIDE} side, {_DIST} distance from positions), k as (select *, case when distance is null then 'no price' when distance <= 0 then 'crossed' when distance >= 0.25::double then 'beyond' else 'band' end kind from r),
b as (select *, case when kind = 'band' then floor(distance / 0.05::double)::bigint end band from k)
select coin, side, kind, band, grouping(coin, side, kind, band)::int as level, sum(round(abs(size) * 100)::bigint)::bigint size_cents, count(*) positions, count(distinct "user") accounts, round(sum(position_value) / 1000, 3) notional_k from b group by grouping sets ((coin, side, kind, band), (coin, side), (coin))""",
    "ledger_positions": f"""with recursive {views.FILL_SQL}, o as (select market_id, case when side = 'buy' then size else -size end::double q, price::double p, fee::double f, row_number() over (partition by market_id order by ts_ms, n) k from fills),
w as (select market_id, k, q pos, p av, -f rl from o where k = 1
  union all
  select o.market_id, o.k, w.pos + q, case when w.pos = 0 or sign(w.pos) = sign(q) then (w.av * abs(w.pos) + p * abs(q)) / abs(w.pos + q) when w.pos + q = 0 then 0 when abs(q) > abs(w.pos) then p else w.av end,
    w.rl + case when w.pos = 0 or sign(w.pos) = sign(q) then 0 else (p - w.av) * least(abs(w.pos), abs(q)) * sign(w.pos) end - f from w join o on o.market_id = w.market_id and o.k = w.k + 1)
select market_id, round(pos, 4) as position, round(av * pos, 3) as cost, round(rl, 3) realised from (select *, row_number() over (partition by market_id order by k desc) z from w) where z = 1""",
    "ledger_totals": f"with {views.FILL_SQL} select market_id, sum(case when side = 'buy' then size else -size end)::bigint as position, sum(fee)::bigint fees, sum(case when side = 'buy' then size else -size end * price)::bigint paid, count(*) fills from fills group by 1",
    "ledger_reconcile": f"with {views.FILL_SQL}, a as (select distinct market_id, n, 1 own from fills where n % 3 <> 0), b as (select distinct market_id, n, 1 venue from fills where n % 5 <> 0) select case when own is null then 'foreign' when venue is null then 'missing' else 'matched' end kind, count(*) n from a full join b using (market_id, n) group by 1",
    "order_limits": f"with {views.FILL_SQL}, r as (select market_id, n, size * price notional, sum(case when side = 'buy' then size else -size end) over w p, sum(size * price) over w o, sum(fee) over w l from fills window w as (partition by market_id order by ts_ms, n rows unbounded preceding)) select market_id, n, concat_ws('; ', case when notional > 4000 then 'order too large' end, case when abs(p) > 150 then 'position too large' end, case when o > 20000 then 'too much open' end, case when l > 60 then 'loss limit' end) reasons from r",
}
QUERIES = [
    contract_trades, contract_totals, contract_controls, label_guard, fee_table, fee_checks, price_grid, liquidation_audit, margin_tiers, liquidation_map, ledger_positions, ledger_totals, ledger_reconcile, order_limits,
]
