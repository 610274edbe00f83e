"""Queries over signals and carry, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.operators import features
from marketframe.plans import carry, signal
from marketframe.plans.event_queries import _OFI, _wsum
from marketframe.sources import views

HOUR = 3_600_000


def _rows(spark: SparkSession, d: str) -> DataFrame:
    """Feature rows with a forward label: spread, microprice, imbalance, flow."""
    touch = views.book_top(spark, d)
    s = features.window_sums(features.order_flow(features.snapshot(touch)), ["ofi"], [HOUR]).withColumnRenamed(f"ofi_{HOUR}", "ofi_1h")
    rows = s.select("instrument", "n", "ts_ms", "mid", F.round("spread_bps", 6).alias("spread_bps"), F.round("micro_bps", 6).alias("micro_bps"), F.round("obi_1", 6).alias("obi_1"), "ofi_1h")
    return features.forward_labels(rows, touch, [HOUR], 5.0).withColumn("y", F.col(f"fwd_{HOUR}"))


FEATURES = ["spread_bps", "micro_bps", "obi_1", "ofi_1h"]


def signal_coefficients(spark: SparkSession, d: str) -> DataFrame:
    ic = signal.coefficients(_rows(spark, d), FEATURES, "y", HOUR)
    return ic.select("feature", "n", F.round("pearson", 5).alias("pearson"), F.round("spearman", 5).alias("spearman"), "effective_n", F.round("t", 4).alias("t"))


def signal_leakage(spark: SparkSession, d: str) -> DataFrame:
    return signal.leakage(signal.coefficients(_rows(spark, d), FEATURES, "y", HOUR))


def signal_agreement(spark: SparkSession, d: str) -> DataFrame:
    ic = signal.coefficients(_rows(spark, d), FEATURES, "y", HOUR, ["instrument"])
    return signal.sign_agreement(ic).select("feature", "instruments", "agree", F.round("p_value", 6).alias("p_value"))


def signal_split(spark: SparkSession, d: str) -> DataFrame:
    parts = signal.purged_split(_rows(spark, d), ["ts_ms", "n"], 0.7, 50)
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))


def signal_deciles(spark: SparkSession, d: str) -> DataFrame:
    return signal.deciles(_rows(spark, d), "micro_bps", "y", ["ts_ms", "n"]).select("decile", "n", F.round("mean", 4).alias("mean"), F.round("excess", 4).alias("excess"))


def signal_auc(spark: SparkSession, d: str) -> DataFrame:
    up = _rows(spark, d).withColumn("up", (F.col("y") > 0).cast("int"))
    return signal.auc(up, "micro_bps", "up", ["instrument"]).select("instrument", "n", F.round("auc", 6).alias("auc"), F.round("majority", 6).alias("majority"))


def signal_economics(spark: SparkSession, d: str) -> DataFrame:
    e = signal.economics(_rows(spark, d), "micro_bps", "y")
    return e.select(*[F.round(c, 4).alias(c) for c in e.columns])


def signal_model(spark: SparkSession, d: str) -> DataFrame:
    """A logistic model of the rise, fitted on the earlier rows: area under the curve of the later ones."""
    rows = signal.standardized(signal.purged_split(_rows(spark, d), ["ts_ms", "n"], 0.7, 50), FEATURES)
    scored = signal.logistic_scores(rows, FEATURES, F.col("y") > 0).where("part = 'test'").withColumn("up", (F.col("y") > 0).cast("int"))
    return signal.auc(scored, "score", "up").select("n", F.round("auc", 3).alias("auc"))


def _instruments(spark: SparkSession, d: str) -> DataFrame:
    """A model of the rise for each instrument, from one feature, and what it earns on the later rows."""
    by, one = ["instrument"], ["micro_bps"]
    rows = signal.standardized_by(signal.purged_split(_rows(spark, d), ["ts_ms", "n"], 0.7, 50), one, by)
    models = signal.grouped_models(rows, one, F.col("y") > 0, by, least=10)
    table = signal.across(signal.model_scores(rows, one, models, by), models, "y", 2.0, "instrument", ["ts_ms", "n"])
    return table.join(models.select("instrument", "weights"), "instrument")


def signal_instruments(spark: SparkSession, d: str) -> DataFrame:
    out = _instruments(spark, d)
    rounded = [F.round(c, k).alias(c) for c, k in (("auc", 5), ("drift", 4), ("long", 4), ("short", 4), ("monotonicity", 4))]
    return out.select("instrument", "n_train", "n_test", "reason", F.round(F.col("weights")[0], 5).alias("intercept"), F.round(F.col("weights")[1], 5).alias("slope"), *rounded, F.col("tradeable").cast("int").alias("tradeable"))


def signal_verdict(spark: SparkSession, d: str) -> DataFrame:
    return signal.across_verdict(_instruments(spark, d)).withColumn("p_value", F.round("p_value", 6))


def carry_stats(spark: SparkSession, d: str) -> DataFrame:
    s = carry.screen(carry.funding_stats(views.funding(spark, d)), 3.0, F.lit(24.0), 14.0)
    return s.select("symbol", "n", *[F.round(c, 5).alias(c) for c in ("mean", "median", "positive", "worst", "drawdown", "a_day", "breakeven_days", "net")])


def _pair(spark: SparkSession, d: str) -> DataFrame:
    line = views.table(spark, d, "lineitem").join(views.table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("symbol")), F.col("l_partkey") == F.col("p_partkey"))
    ts = views.epoch_ms(F.col("l_shipdate")) + F.col("l_linenumber") * 4 * HOUR + F.pmod("l_orderkey", F.lit(7))
    prices = line.groupBy("symbol", ts.alias("ts_ms")).agg((F.sum(views.cents("l_extendedprice")) / 100 / F.sum(F.col("l_quantity").cast("long"))).alias("price"))
    perp = prices.withColumn("price", F.col("price") * (1 + (F.col("ts_ms") % 11 - 5) / 10_000))
    return carry.aligned(views.funding(spark, d), prices, perp)


def carry_windows(spark: SparkSession, d: str) -> DataFrame:
    r = carry.window_report(carry.windows(_pair(spark, d), 42, 24.0), 42)
    return r.select("symbol", "windows", "effective", *[F.round(c, 4).alias(c) for c in ("median", "p5", "worst", "best", "profitable")])


def carry_implied(spark: SparkSession, d: str) -> DataFrame:
    f = views.funding(spark, d)
    spans = f.groupBy("symbol").agg(F.min("ts_ms").alias("a"), F.max("ts_ms").alias("z"))
    pos = spans.select(F.col("symbol").alias("position_id"), "symbol", F.when(F.pmod(F.length("symbol"), F.lit(2)) == 0, "short").otherwise("long").alias("side"), F.lit(1000.0).alias("notional"), (F.col("a") + 90 * 24 * HOUR).alias("opened_ms"), (F.col("z") - 90 * 24 * HOUR).alias("now_ms"))
    return carry.implied_funding(pos, f).select("position_id", F.round("implied", 4).alias("implied"), "settlements")




_ROWS = _OFI + f""", ft as (select instrument, n, ts_ms, mid, round((ask - bid) / mid * 10000, 6) spread_bps, round(((bid * ask_size + ask * bid_size) / (bid_size + ask_size)::double - mid) / mid * 10000, 6) micro_bps,
  round((bid_size - ask_size) / (bid_size + ask_size)::double, 6) obi_1, {_wsum('o', HOUR)} ofi_1h from ofi),
fj as (select f.*, round((m.mid / f.mid - 1) * 10000, 4) y from (select *, ts_ms + {HOUR} k from ft) f asof join mids m on f.instrument = m.instrument and f.k <= m.ts_ms),
rows_ as (select fj.* from fj join (select instrument, max(ts_ms) newest from mids group by 1) using (instrument) where newest - ts_ms >= {HOUR})"""


def _ic_sql(by: str) -> str:
    p = f"{by}, " if by else ""
    return _ROWS + f""", lg as (select {p}ts_ms, y, 'spread_bps' feature, spread_bps x from rows_ union all select {p}ts_ms, y, 'micro_bps', micro_bps from rows_ union all select {p}ts_ms, y, 'obi_1', obi_1 from rows_ union all select {p}ts_ms, y, 'ofi_1h', ofi_1h from rows_),
rk as (select *, rank() over (partition by {p}feature order by x) + (count(*) over (partition by {p}feature, x) - 1) / 2.0::double rx, rank() over (partition by {p}feature order by y) + (count(*) over (partition by {p}feature, y) - 1) / 2.0::double ry from lg),
ic as (select {p}feature, count(*) n, case when max(x) = min(x) or max(y) = min(y) or count(*) < 3 then 0 else corr(x, y) end pearson, case when max(x) = min(x) or max(y) = min(y) or count(*) < 3 then 0 else corr(rx, ry) end spearman from rk group by {p}feature),
ge as (select count(distinct ts_ms) u, (max(ts_ms) - min(ts_ms)) / (count(distinct ts_ms) - 1)::double iv from rows_), en as (select greatest(1, floor(u / greatest(1, {HOUR}.0::double / iv))::bigint) effective_n from ge)"""


def _models_sql() -> str:
    """Newton's steps of a model with one feature, one after another; eight are more than they take."""
    steps = ["b0 as (select instrument, 0.0::double w0, 0.0::double w1 from ok_)"]
    for k in range(8):
        steps.append(f"""b{k + 1} as materialized (select instrument, w0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) w0, w1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) w1 from (
select instrument, any_value(w0) w0, any_value(w1) w1, sum(u - p) g0, sum((u - p) * x) - any_value(w1) g1, sum(v) h00, sum(v * x) h01, sum(v * x * x) + 1 h11 from (select *, greatest(p * (1 - p), 1e-8) v from (select t.instrument, x, u, w0, w1, 1 / (1 + exp(-(w0 + w1 * x))) p from tr t join b{k} using (instrument))) group by instrument))""")
    return _ROWS + """, pl as (select *, row_number() over (order by ts_ms, n) - 1 pl, count(*) over () c from rows_),
pt as (select *, case when pl < floor(c * 0.7) then 'train' when pl < floor(c * 0.7) + 50 then 'gap' else 'test' end part from pl),
st as (select instrument, avg(micro_bps) m, stddev_pop(micro_bps) s from pt where part = 'train' group by 1),
nz as (select pt.*, (micro_bps - m) / case when s > 0 then s else 1 end x, (y > 0)::int u from pt join st using (instrument)),
cn as (select instrument, count(*) filter (part = 'train') n_train, count(*) filter (part = 'test') n_test, sum(u) filter (part = 'train') up from nz group by 1),
cr as (select instrument, n_train, n_test, case when n_train < 10 then 'few training rows' when n_test < 10 then 'few test rows' when up = 0 or up = n_train then 'one class' end reason from cn),
ok_ as (select instrument from cr where reason is null), tr as materialized (select instrument, x, u from nz where part = 'train'), """ + ", ".join(steps) + """,
te as (select instrument, ts_ms, n, y, u, 1 / (1 + exp(-(w0 + w1 * x))) score from nz join b8 using (instrument) where part = 'test'),
ra as (select instrument, u, rank() over (partition by instrument order by score) + (count(*) over (partition by instrument, score) - 1) / 2.0::double r from te),
au as (select instrument, case when sum(u) > 0 and sum(1 - u) > 0 then (sum(r * u) - sum(u) * (sum(u) + 1) / 2) / (sum(u) * sum(1 - u))::double else 0.5 end auc from ra group by 1),
qu as (select instrument, quantile_cont(score, 0.9) h, quantile_cont(score, 0.1) l, avg(y) drift from te group by 1),
ec as (select instrument, any_value(drift) drift, avg(case when score >= h then y end) - any_value(drift) long, any_value(drift) - avg(case when score <= l then y end) short from te join qu using (instrument) group by 1),
de as (select instrument, t, avg(y) m from (select instrument, y, ntile(10) over (partition by instrument order by score, ts_ms, n) t from te) group by 1, 2),
mo as (select instrument, corr(t, m) monotonicity from de group by 1),
ta as (select cr.*, w0, w1, auc, drift, long, short, monotonicity, greatest(long, short) > 2 tradeable from cr left join b8 using (instrument) left join au using (instrument) left join ec using (instrument) left join mo using (instrument))"""


_PAIR = views.FUNDING_SQL + f""", pr as (select p_brand symbol, epoch_ms(l_shipdate) + l_linenumber * 4 * 3600000 + l_orderkey % 7 ts_ms, sum(round(l_extendedprice * 100)::bigint)::double / 100 / sum(l_quantity::bigint)::double price from lineitem join part on l_partkey = p_partkey group by 1, 2),
f3 as (select symbol, ts_ms // {8 * HOUR} bucket, sum(rate_bps) fd from funding group by 1, 2), s3 as (select symbol, ts_ms // {8 * HOUR} bucket, arg_max(price, ts_ms) spot, arg_max(price * (1 + (ts_ms % 11 - 5) / 10000.0::double), ts_ms) perp from pr group by 1, 2),
al as (select symbol, bucket, fd, (spot - perp) / spot * 10000 gap from f3 join s3 using (symbol, bucket) where spot > 0),
wn as (select symbol, bucket, sum(fd) over (partition by symbol order by bucket rows between 1 following and 42 following) + lead(gap, 42) over (partition by symbol order by bucket) - gap - 24 net from al qualify lead(gap, 42) over (partition by symbol order by bucket) is not null)"""

ORACLES = {
    "signal_instruments": f"with {_models_sql()} select instrument, n_train, n_test, reason, round(w0, 5) intercept, round(w1, 5) slope, round(auc, 5) auc, round(drift, 4) drift, round(long, 4) long, round(short, 4) short, round(monotonicity, 4) monotonicity, tradeable::int tradeable from ta",
    "signal_verdict": f"""with {_models_sql()}, g as (select count(auc) instruments, count(*) - count(auc) skipped, greatest(sum((long > 0)::int), count(auc) - sum((long > 0)::int))::bigint agree, sum(coalesce(tradeable, false)::int)::bigint tradeable from ta),
p as (select *, list_sum(list_transform(range(agree, instruments + 1), lambda i: factorial(instruments::int)::double / factorial(i::int)::double / factorial((instruments - i)::int)::double)) / pow(2, instruments) p_value from g)
select instruments, skipped, agree, round(p_value, 6) p_value, tradeable, case when instruments = 0 then 'nothing to evaluate' when p_value > 0.05 then 'sign not consistent' when tradeable = 0 then 'consistent, no edge after costs' else 'consistent and tradeable' end verdict from p""",
    "signal_agreement": f"""with {_ic_sql('instrument')}, g as (select feature, count(*) instruments, sum((spearman > 0)::int) up from ic where spearman <> 0 group by 1), a as (select feature, instruments, greatest(up, instruments - up)::bigint agree from g)
select feature, instruments, agree, round(list_sum(list_transform(range(agree, instruments + 1), lambda i: factorial(instruments::int)::double / factorial(i::int)::double / factorial((instruments - i)::int)::double)) / pow(2, instruments), 6) p_value from a""",
    "signal_coefficients": f"with {_ic_sql('')} select feature, n, round(pearson, 5) pearson, round(spearman, 5) spearman, effective_n, round(case when effective_n > 2 then spearman * sqrt((effective_n - 2) / (1 - least(pow(spearman, 2), 0.999999))) else 0 end, 4) t from ic, en",
    "signal_leakage": f"with {_ic_sql('')} select feature, 'suspiciously strong' warning from ic where abs(spearman) > 0.2 union all select feature, 'few independent rows' from ic, en where effective_n < 1000",
    "signal_split": f"with {_ROWS}, pl as (select *, row_number() over (order by ts_ms, n) - 1 pl, count(*) over () c from rows_) select case when pl < floor(c * 0.7) then 'train' when pl < floor(c * 0.7) + 50 then 'gap' else 'test' end part, count(*) n, min(ts_ms) first_ms, max(ts_ms) last_ms from pl group by 1",
    "signal_deciles": f"with {_ROWS}, d as (select *, ntile(10) over (order by micro_bps, ts_ms, n) decile from rows_) select decile::int decile, count(*) n, round(avg(y), 4) mean, round(avg(y) - (select avg(y) from rows_), 4) excess from d group by 1",
    "signal_auc": f"with {_ROWS}, r as (select instrument, (y > 0)::int u, rank() over (partition by instrument order by micro_bps) + (count(*) over (partition by instrument, micro_bps) - 1) / 2.0::double r from rows_) select instrument, count(*) n, round((sum(r * u) - sum(u) * (sum(u) + 1) / 2) / (sum(u) * sum(1 - u))::double, 6) auc, round(greatest(avg(u), 1 - avg(u)), 6) majority from r group by 1",
    "signal_economics": f"with {_ROWS}, q as (select quantile_cont(micro_bps, 0.9) h, quantile_cont(micro_bps, 0.1) l, avg(y) drift from rows_) select round(avg(case when micro_bps >= h then y end) - max(drift), 4) long, round(max(drift) - avg(case when micro_bps <= l then y end), 4) short, round(max(drift), 4) drift from rows_, q",
    "carry_stats": f"""with {views.FUNDING_SQL}, c as (select *, sum(rate_bps) over (partition by symbol order by ts_ms, rate_bps rows unbounded preceding) cum from funding), d as (select *, greatest(0, max(cum) over (partition by symbol order by ts_ms, rate_bps rows unbounded preceding)) - cum dd from c),
g as (select symbol, count(*) n, avg(rate_bps) mean, quantile_cont(rate_bps, 0.5) median, avg((rate_bps > 0)::int) positive, min(rate_bps) worst, max(dd) drawdown from d group by 1)
select symbol, n, round(mean, 5) mean, round(median, 5) median, round(positive, 5) positive, round(worst, 5) worst, round(drawdown, 5) drawdown, round(abs(mean) * 3, 5) a_day, round(24 / nullif(abs(mean) * 3, 0), 5) breakeven_days, round(abs(mean) * 3 * 14 - 24, 5) net from g""",
    "carry_windows": f"with {_PAIR}, k as (select *, row_number() over (partition by symbol order by net, bucket) - 1 k, count(*) over (partition by symbol) c from wn), p as (select symbol, net p5 from k where k = floor((c - 1) * 0.05::double)) select symbol, count(*) windows, greatest(1, count(*) // 42)::int effective, round(quantile_cont(net, 0.5), 4) median, round(max(p5), 4) p5, round(min(net), 4) worst, round(max(net), 4) best, round(avg((net > 0)::int), 4) profitable from wn join p using (symbol) group by 1",
    "carry_implied": f"with {views.FUNDING_SQL}, s as (select symbol, min(ts_ms) + {90 * 24 * HOUR} a, max(ts_ms) - {90 * 24 * HOUR} z from funding group by 1) select f.symbol position_id, round(sum(case when length(f.symbol) % 2 = 0 then 1 else -1 end * rate_bps * 1000.0::double / 10000), 4) implied, count(*) settlements from funding f join s on f.symbol = s.symbol and ts_ms > a and ts_ms <= z group by 1",
}
QUERIES = [signal_coefficients, signal_leakage, signal_agreement, signal_split, signal_deciles, signal_auc, signal_economics, signal_model, signal_instruments, signal_verdict, carry_stats, carry_windows, carry_implied]
