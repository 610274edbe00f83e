"""Queries of reports with verdicts, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.operators.saved import saved
from marketframe.plans import carry, panel_queries, reports, study_queries
from marketframe.plans import portfolio as B
from marketframe.sources import views


def factor_report(spark: SparkSession, d: str) -> DataFrame:
    """The run of ``factor_summary`` with its legs, the t of alpha and the mean IC."""
    weighed = saved(B.weigh(B.books(panel_queries._scored(spark, d), panel_queries.FRAC)))
    out = reports.run_report(B.periods(weighed, panel_queries.HOLD, panel_queries.COST), weighed, panel_queries.HOLD)
    return out.select("n", *[F.round(F.col(c) + 3e-7, 4).alias(c) for c in ("gross", "mean", "t", "beta", "alpha", "alpha_t", "price", "funding", "ic")])


def _screened(spark: SparkSession, d: str) -> DataFrame:
    """Quotes made of each brand's parts; some can't be used."""
    k = F.length("symbol") + F.ascii(F.substring("symbol", -1, 1))
    mid = F.col("mid")
    q = views.table(spark, d, "part").groupBy(F.col("p_brand").alias("symbol")).agg(F.min("p_retailprice").alias("mid"))
    quotes = q.select("symbol", (mid * (1 - 0.0001 * (k % 5))).alias("spot_bid"), (mid * (1 + 0.0001 * (k % 4))).alias("spot_ask"), F.when(k % 7 != 0, mid * 0.999).alias("perp_bid"), (mid * (1 + 0.0002 * (k % 9))).alias("perp_ask"))
    paid = views.funding(spark, d).withColumn("rate_bps", F.col("rate_bps") + 5 * (k % 3 - 1))
    return reports.carry_screen(carry.funding_stats(paid), quotes, 2.0, 1.0, 30.0)


def carry_report(spark: SparkSession, d: str) -> DataFrame:
    s = _screened(spark, d)
    numbers = ["a_day", "basis", "crossing", "quoting", "convergence", "breakeven_crossing", "breakeven_quoting", "net_crossing", "net_quoting", "after_convergence"]
    return s.select("symbol", "unavailable", F.col("harvestable").cast("int").alias("harvestable"), F.col("risky").cast("int").alias("risky"), *[F.round(F.col(c) + 3e-7, 4).alias(c) for c in numbers])


def carry_decision(spark: SparkSession, d: str) -> DataFrame:
    return reports.carry_verdict(_screened(spark, d))


def liquidation_report(spark: SparkSession, d: str) -> DataFrame:
    """Both sides of each coin's map, with coverage of an open interest and the age of what is known."""
    p = views.positions(spark, d)
    interest = p.groupBy("coin").agg((F.max(F.abs("size")) * 40).alias("open_interest"))
    out = reports.liquidation_sides(p, interest, F.lit(20_000_000))
    numbers = [c for c in out.columns if c not in ("coin", "side", "accounts", "coin_accounts", "open_interest")]
    return out.select("coin", "side", "accounts", "coin_accounts", *[F.round(F.col(c) + 3e-7, 3).alias(c) for c in numbers])


def signal_decision(spark: SparkSession, d: str) -> DataFrame:
    """Whether what a feature foretells clears a cost of half a basis point."""
    out = reports.economic_verdict(study_queries._rows(spark, d), "micro_bps", "y", ["ts_ms", "n"], 0.5)
    return out.select("n", *[F.round(F.col(c) + 3e-7, 4).alias(c) for c in ("auc", "drift", "long", "short", "long_raw", "short_raw", "monotonicity")], "tradeable", "drift_carried", "verdict")


def _r(names: str, digits: int = 4) -> str:
    return ", ".join(f"round({n} + 3e-7, {digits}) {n}" for n in names.split())


_CARRY = f"""{views.FUNDING_SQL}, p_ as (select symbol, ts_ms, rate_bps + 5 * ((length(symbol) + ascii(right(symbol, 1))) % 3 - 1) rate_bps from funding), c_ as (select *, sum(rate_bps) over (partition by symbol order by ts_ms, rate_bps rows unbounded preceding) cum from p_),
d_ as (select *, greatest(0, max(cum) over (partition by symbol order by ts_ms, rate_bps rows unbounded preceding)) - cum dd from c_),
st as (select symbol, count(*) n, quantile_cont(rate_bps, 0.5) median, avg((rate_bps > 0)::int) positive, max(dd) drawdown from d_ group by 1),
q as (select p_brand symbol, min(p_retailprice) mid, length(p_brand) + ascii(right(p_brand, 1)) k from part group by p_brand),
qq as (select symbol, mid * (1 - 0.0001::double * (k % 5)) sb, mid * (1 + 0.0001::double * (k % 4)) sa, case when k % 7 <> 0 then mid * 0.999::double end pb, mid * (1 + 0.0002::double * (k % 9)) pa from q),
u as (select *, case when not coalesce(sb > 0 and sb < sa, false) then 'no usable spot quote' when not coalesce(pb > 0 and pb < pa, false) then 'no usable perp quote' when coalesce(n, 0) = 0 then 'no funding history' end unavailable from qq left join st using (symbol)),
v as (select *, unavailable is null fine, case when unavailable is null then median * 3 end a_day, case when unavailable is null then ((pb + pa) / 2 - (sb + sa) / 2) / ((sb + sa) / 2) * 10000 end basis, 6.0::double quoting, case when unavailable is null then (sa - sb) / ((sb + sa) / 2) * 10000 + (pa - pb) / ((pb + pa) / 2) * 10000 + 6 end crossing from u),
z as (select symbol, unavailable, case when fine then median > 0 end harvestable, case when fine then positive < 0.8 or drawdown > 20 end risky, a_day, basis, crossing, quoting, greatest(0, -basis) convergence, case when a_day > 0 then crossing / a_day end breakeven_crossing, case when a_day > 0 then quoting / a_day end breakeven_quoting,
  a_day * 30 - crossing net_crossing, a_day * 30 - quoting net_quoting, a_day * 30 - crossing - greatest(0, -basis) after_convergence from v)"""
_W = ", ".join(f"sum(case when dist > 0 and dist <= {k / 100}::double then abs(size) * liquidation_px else 0 end) within_{k}" for k in (1, 2, 5, 10))
ORACLES = {
    "factor_report": f"""with {panel_queries._RUNS}, e as (select *, ret - market ex from wg), k as (select *, rank() over (partition by date_idx order by score) + (count(*) over (partition by date_idx, score) - 1) / 2.0::double rx, rank() over (partition by date_idx order by ex) + (count(*) over (partition by date_idx, ex) - 1) / 2.0::double ry from e),
i as (select date_idx, case when max(score) = min(score) or max(ex) = min(ex) then 0 else corr(rx, ry) end ic from k group by 1 having count(*) >= 6),
b as (select case when var_samp(market) > 0 then covar_samp(net, market) / var_samp(market) else 0 end bt from run), x as (select count(*) n, avg(gross) gross, avg(net) mean, avg(net) / (stddev_samp(net) / sqrt(count(*))) t, (select bt from b) beta, avg(net) - any_value(bt) * avg(market) alpha, (avg(net) - any_value(bt) * avg(market)) / (stddev_samp(net - bt * market) / sqrt(count(*))) alpha_t, avg(price) price, avg(funding) funding, (select avg(ic) from i) ic from run, b)
select n, {_r('gross mean t beta alpha alpha_t price funding ic')} from x""",
    "carry_report": f"with {_CARRY} select symbol, unavailable, harvestable::int harvestable, risky::int risky, {_r('a_day basis crossing quoting convergence breakeven_crossing breakeven_quoting net_crossing net_quoting after_convergence')} from z",
    "carry_decision": f"""with {_CARRY}, g as (select count(*) filter (unavailable is null) usable, count(unavailable) unavailable, count(*) filter (harvestable = false) unharvestable, count(*) filter (harvestable and net_crossing > 0) clear_crossing, count(*) filter (harvestable and net_quoting > 0) clear_quoting,
arg_max(symbol, (net_crossing, symbol)) filter (harvestable and net_crossing > 0) cs, arg_max(symbol, (net_quoting, symbol)) filter (harvestable and net_quoting > 0) qs, count(*) filter (harvestable and net_crossing > 0 and risky) cr, count(*) filter (harvestable and net_quoting > 0 and risky) qr from z)
select usable, unavailable, unharvestable, clear_crossing, clear_quoting, case when clear_crossing > 0 then cs else qs end best, case when clear_crossing > 0 then cr else qr end risky, case when clear_crossing > 0 then 'clears crossing' when clear_quoting > 0 then 'clears only if quoted' else 'nothing clears its cost' end verdict from g""",
    "liquidation_report": f"""with {views.POSITION_SQL}, r as (select *, case when size > 0 then 'long' else 'short' end side, case when size >= 0 then mark_px - liquidation_px else liquidation_px - mark_px end / mark_px dist from positions),
s as (select coin, side, sum(abs(size)) size, count(distinct "user") accounts, sum(case when dist is null then abs(size) else 0 end) no_price, sum(case when dist <= 0 then abs(size) else 0 end) crossed, sum(case when dist >= 0.25::double then abs(size) else 0 end) beyond, sum(case when dist >= 0.25::double then abs(size) * liquidation_px else 0 end) beyond_notional, {_W} from r group by 1, 2),
c as (select coin, count(distinct "user") coin_accounts, sum(greatest(0, (20000000 - observed_ms) / 1000.0::double) * case when position_value <> 0 then position_value else abs(size) * mark_px end) / sum(case when position_value <> 0 then position_value else abs(size) * mark_px end) weighted_age_s, max(abs(size)) * 40 oi from r group by 1),
f as (select s.*, coin_accounts, weighted_age_s, size / oi coverage from s join c using (coin))
select coin, side, accounts, coin_accounts, {_r('size no_price crossed beyond beyond_notional within_1 within_2 within_5 within_10 weighted_age_s coverage', 3)} from f""",
    "signal_decision": f"""with {study_queries._ROWS}, r as (select (y > 0)::int u, rank() over (order by micro_bps) + (count(*) over (partition by micro_bps) - 1) / 2.0::double r from rows_),
a as (select (sum(r * u) - sum(u) * (sum(u) + 1) / 2) / (sum(u) * sum(1 - u))::double auc from r), q as (select quantile_cont(micro_bps, 0.9) h, quantile_cont(micro_bps, 0.1) l, avg(y) drift from rows_),
e as (select count(*) n, any_value(drift) drift, avg(case when micro_bps >= h then y end) long_raw, -avg(case when micro_bps <= l then y end) short_raw from rows_, q),
m as (select corr(t, m) monotonicity from (select t, avg(y) m from (select y, ntile(10) over (order by micro_bps, ts_ms, n) t from rows_) group by 1)),
z as (select *, long_raw - drift long, short_raw + drift short from e, a, m), k as (select *, greatest(long, short) > 0.5 tradeable from z)
select n, {_r('auc drift long short long_raw short_raw monotonicity')}, tradeable, greatest(long_raw, short_raw) > 0.5 and not tradeable drift_carried, case when auc < 0.505 then 'no signal' when not tradeable then 'signal, but no edge after costs' else 'edge after costs' end verdict from k""",
}
QUERIES = [factor_report, carry_report, carry_decision, liquidation_report, signal_decision]
