"""Queries over the panel view, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.functions.prices import canonical
from marketframe.operators.timeseries import first_of, with_drawdown
from marketframe.operators.saved import saved
from marketframe.plans import panel as P
from marketframe.plans import portfolio as B
from marketframe.sources import views

HOLD, FRAC, COST, START, HISTORY, VOLUME = 4, 0.2, 10.0, 31, 20, 1.0


def _r(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(c), digits).alias(c) if df.schema[c].dataType.typeName() == "double" else F.col(c) for c in columns or df.columns])


def _panel(spark: SparkSession, d: str) -> DataFrame:
    return P.usable(views.daily_bars(spark, d))


def panel_bars(spark: SparkSession, d: str) -> DataFrame:
    return _r(_panel(spark, d), "date_idx", "symbol", "open", "high", "low", "close", "quote_volume", "trades", "taker_buy_frac", "minutes", "funding_bps", "complete")


def panel_report(spark: SparkSession, d: str) -> DataFrame:
    return _r(P.panel_report(_panel(spark, d)))


def panel_factors(spark: SparkSession, d: str) -> DataFrame:
    return _r(P.factors(_panel(spark, d)), "date_idx", "symbol", "carry_1", "carry_7", "carry_30", "mom_7", "mom_30", "rev_3", "lowvol_30", "lowrv_30", "illiq_30", "small_30", "taker_7", digits=4)


def panel_shape_factors(spark: SparkSession, d: str) -> DataFrame:
    return _r(P.factors(_panel(spark, d)), "date_idx", "symbol", "max_7", "skew_30", "beta_30", digits=4)


def panel_universe(spark: SparkSession, d: str) -> DataFrame:
    return _r(P.universe(_panel(spark, d), HISTORY, VOLUME), "date_idx", "symbol", "run", "median_volume", "eligible")


def panel_rank_blend(spark: SparkSession, d: str) -> DataFrame:
    return _r(P.rank_blend(P.factors(_panel(spark, d)), {"carry_7": 0.5, "mom_14": 0.5}, "blend"), "date_idx", "symbol", "blend")


def panel_funding_days(spark: SparkSession, d: str) -> DataFrame:
    days = P.funding_by_day(views.funding(spark, d), 2)
    return days.select("symbol", F.col("day").cast("string").alias("day"), F.round("funding_bps", 6).alias("funding_bps"), "funding_periods")


def panel_reference_carry(spark: SparkSession, d: str) -> DataFrame:
    panel = _panel(spark, d)
    ref = panel.where(F.col("trades") % 2 == 0).select(F.concat(F.lit("1000"), F.regexp_replace("symbol", "#", ""), F.lit("USDT")).alias("symbol"), "date", (F.col("funding_bps") * 0.5).alias("funding_bps"))
    mine = panel.withColumn("plain", F.col("symbol")).withColumn("symbol", F.regexp_replace("symbol", "#", ""))
    both = P.attach_reference(mine, ref, canonical)
    return _r(both.withColumn("carry_rel_7", P.relative_carry(both, 7)), "date_idx", "plain", "ref_funding_bps", "carry_rel_7")


def panel_correlations(spark: SparkSession, d: str) -> DataFrame:
    return _r(P.correlations(P.log_return(_panel(spark, d), 1, "ret")), digits=5)


def _scored(spark: SparkSession, d: str, factor: str = "carry_7", hold: int = HOLD) -> DataFrame:
    """Scored rows of one factor, written once: real runs and controls read them again and again."""
    return saved(B.score_rows(P.universe(P.factors(_panel(spark, d), [factor]), HISTORY, VOLUME), factor, hold, 1, START))


def _runs(spark: SparkSession, d: str, scored: DataFrame | None = None) -> DataFrame:
    return B.periods(B.weigh(B.books(scored if scored is not None else _scored(spark, d), FRAC)), HOLD, COST)


def factor_weights(spark: SparkSession, d: str) -> DataFrame:
    return _r(B.weigh(B.books(_scored(spark, d), FRAC)), "date_idx", "symbol", "score", "side", "weight", "price_leg", "funding_leg", "ret", "market", digits=5)


def factor_periods(spark: SparkSession, d: str) -> DataFrame:
    return _r(_runs(spark, d), "date_idx", "gross", "price", "funding", "turnover", "net", "n", digits=5)


def factor_summary(spark: SparkSession, d: str) -> DataFrame:
    return _r(B.summary(_runs(spark, d), HOLD), digits=4)


def factor_ic(spark: SparkSession, d: str) -> DataFrame:
    return _r(B.period_ic(B.weigh(B.books(_scored(spark, d), FRAC))), digits=5)


def factor_years(spark: SparkSession, d: str) -> DataFrame:
    return _r(B.by_year(_runs(spark, d), F.floor(F.col("date_idx") / 52)), digits=4)


def factor_drawdown(spark: SparkSession, d: str) -> DataFrame:
    runs = _runs(spark, d).withColumn("one", F.lit(1))
    return _r(with_drawdown(runs, "net", ["one"], ["date_idx"]), "date_idx", "cumulative", "drawdown", digits=4)


def factor_worst(spark: SparkSession, d: str) -> DataFrame:
    return _r(_runs(spark, d).orderBy("net", "date_idx").limit(5), "date_idx", "net", digits=5)


def factor_controls(spark: SparkSession, d: str) -> DataFrame:
    scored = _scored(spark, d)
    spec = ["seed"]
    runs = B.periods(B.weigh(B.books(B.shuffled(scored, 200), FRAC, spec), spec=spec), HOLD, COST, spec)
    controls = B.summary(runs, HOLD, spec)
    return _r(B.control_summary(B.summary(_runs(spark, d, scored), HOLD), controls), digits=4)


def factor_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return _r(B.block_bootstrap(_runs(spark, d), "net", "date_idx", 4, 2000), digits=4)


def factor_sweep(spark: SparkSession, d: str) -> DataFrame:
    panel = saved(P.universe(P.factors(_panel(spark, d), ["carry_7"]), HISTORY, VOLUME))
    scored = {h: B.score_rows(panel, "carry_7", h, 0, START) for h in (3, 7)}
    return _r(B.sweep(scored, (0.1, 0.2, 0.3), (5.0, 20.0), (VOLUME, 60_000.0, 300_000.0)), "hold", "frac", "cost", "volume", "names", "n", "mean", "sd", "turnover", digits=4)


def factor_halves(spark: SparkSession, d: str) -> DataFrame:
    return _r(B.universe_halves(_scored(spark, d), 5, HOLD, FRAC, COST), "seed", "half", "n", "mean", digits=4)


def factor_capacity(spark: SparkSession, d: str) -> DataFrame:
    return _r(B.capacity(B.weigh(B.books(_scored(spark, d), FRAC)), 0.02), digits=3)


def factor_banded(spark: SparkSession, d: str) -> DataFrame:
    scored = _scored(spark, d).withColumn("spec", F.lit("carry_7"))
    return B.banded(scored, FRAC, 0.1).where("side <> 0").select("spec", "date_idx", "symbol", "side")


def panel_merge_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = views.funding(spark, d).withColumn("page", F.lit(1)).union(views.funding(spark, d).where(F.col("ts_ms") % 3 == 0).withColumn("page", F.lit(2)))
    kept = first_of(pages, ["symbol", "ts_ms"], [F.desc("page"), F.desc("rate_bps")])
    return kept.groupBy("symbol").agg(F.count(F.lit(1)).alias("stamps"), F.sum("copies").alias("seen"), F.round(F.sum("rate_bps"), 4).alias("rate"))


def _std(x: str, w: str) -> str:
    return f"stddev_pop({x}) over ({w})"


def _window(n: int) -> str:
    return f"partition by symbol order by date_idx range between {n - 1} preceding and current row"


def _lag(x: str, n: int) -> str:
    return f"max({x}) over (partition by symbol order by date_idx range between {n} preceding and {n} preceding)"


_USABLE = views.PANEL_SQL + """,
u as (select *, minutes >= 1430 complete, case when funding_periods > 0 then funding_bps end as f from panel)"""
_RET = _USABLE + f""",
r as (select *, ln(close / {_lag('close', 1)}) * 10000 ret, ln(high / low) / (2 * sqrt(ln(2.0::double))) * 10000 rv, case when quote_volume > 0 then quote_volume end pv from u),
m as (select *, avg(ret) over (partition by date_idx) mk from r)"""


def _carry(n: int) -> str:
    return f"case when date_idx >= {n - 1} then -coalesce(sum(f) over ({_window(n)}), 0) / {n} end"


def _mom(n: int) -> str:
    return f"ln(close / {_lag('close', n)}) * 10000"


def _mean(x: str, n: int) -> str:
    return f"case when date_idx >= {n - 1} then avg({x}) over ({_window(n)}) end"


_FACTORS = _RET + f""",
fac as (select *, {_carry(1)} carry_1, {_carry(7)} carry_7, {_carry(30)} carry_30, {_mom(7)} mom_7, {_mom(14)} mom_14, {_mom(30)} mom_30, -({_mom(3)}) rev_3,
  case when date_idx >= 30 then -{_std('ret', _window(30))} end lowvol_30, -{_mean('rv', 30)} lowrv_30, {_mean('abs(ret) / pv', 30)} illiq_30, {_mean('-ln(pv)', 30)} small_30, {_mean('taker_buy_frac', 7)} taker_7 from m)"""
_SHAPE = _RET + f""",
sh as (select *, case when ret is not null then mk end mm from m),
fac as (select date_idx, symbol, case when date_idx >= 30 then -max(ret) over ({_window(7)}) end max_7,
  case when date_idx >= 30 and {_std('ret', _window(30))} > 0 then -(avg(ret * ret * ret) over ({_window(30)}) - 3 * avg(ret) over ({_window(30)}) * avg(ret * ret) over ({_window(30)}) + 2 * pow(avg(ret) over ({_window(30)}), 3)) / pow({_std('ret', _window(30))}, 3) end skew_30,
  case when date_idx >= 30 and var_pop(mm) over ({_window(30)}) > 0 then -covar_pop(ret, mm) over ({_window(30)}) / var_pop(mm) over ({_window(30)}) end beta_30 from sh)"""
_RUN = """
g as (select *, coalesce(date_idx - lag(date_idx) over (partition by symbol order by date_idx) > 1, false) gap from {src}),
isl as (select *, sum(case when not complete then 1 when gap then 1 else 0 end) over (partition by symbol order by date_idx) island from g),
uni as (select *, (case when complete then sum(complete::int) over (partition by symbol, island order by date_idx) else 0 end)::bigint run, quantile_cont(quote_volume, 0.5) over (partition by symbol order by date_idx range between 29 preceding and current row) median_volume from isl),
el as (select *, run >= 20 and median_volume >= 1.0 and date_idx >= 30 eligible from uni)"""


def _scored_sql(hold: int, lag: int, tag: str = "") -> str:
    return f"""
leg{tag} as (select *, {_lag('carry_7', lag) if lag else 'carry_7'} score, max(close) over (partition by symbol order by date_idx range between {hold} following and {hold} following) exit_close,
  -coalesce(sum(f) over (partition by symbol order by date_idx range between 1 following and {hold} following), 0) funding_leg from el),
sc{tag} as (select symbol, date_idx, score, eligible, median_volume, ln(exit_close / close) * 10000 price_leg, funding_leg, ln(exit_close / close) * 10000 + funding_leg ret from leg{tag}
  where date_idx >= 31 and (date_idx - 31) % {hold} = 0 and date_idx < (select max(date_idx) from panel) + 1 - {hold})"""


def _book_sql(src: str, frac: str, spec: str, tag: str = "") -> str:
    p = f"{spec}, " if spec else ""
    return f"""
nm{tag} as (select *, count(*) over (partition by {p}date_idx) n_names, row_number() over (partition by {p}date_idx order by score, symbol) rk from {src} where eligible and score is not null),
bk{tag} as (select *, least(greatest(1, round_even(n_names * {frac}, 0)::int), n_names // 2) n_side from nm{tag} where n_names >= 6),
sd{tag} as (select *, case when rk > n_names - n_side then 1 when rk <= n_side then -1 else 0 end side from bk{tag}),
wt{tag} as (select *, case when side <> 0 then side::double / count(*) over (partition by {p}date_idx, side) else 0 end weight, avg(ret) over (partition by {p}date_idx) market,
  max(side) over (partition by {p}date_idx) = 1 and min(side) over (partition by {p}date_idx) = -1 both_ from sd{tag} where ret is not null),
wg{tag} as (select * from wt{tag} where both_)"""


def _period_sql(hold: int, spec: str, tag: str = "", cost: str = "10.0::double") -> str:
    p = f"{spec}, " if spec else ""
    return f"""
sm{tag} as (select {p}date_idx, sum(weight * (ret - market)) / 2 gross, sum(weight * price_leg) / 2 price, sum(weight * funding_leg) / 2 funding, max(market) market, count(*) filter (side <> 0) n from wg{tag} group by {p}date_idx),
mv{tag} as (select {p}symbol, date_idx, weight w from wg{tag} where side <> 0 union all select {p}symbol, date_idx + {hold}, -weight from wg{tag} where side <> 0),
tn{tag} as (select {p}date_idx, sum(abs(w)) turnover from (select {p}symbol, date_idx, sum(w) w from mv{tag} group by {p}symbol, date_idx) group by {p}date_idx),
run{tag} as (select *, (2 * gross - turnover * {cost}) / 2 net from sm{tag} join tn{tag} using ({p}date_idx))"""


_EL = _FACTORS + "," + _RUN.format(src="fac")
_BOOK = _EL + "," + _scored_sql(4, 1) + "," + _book_sql("sc", "0.2::double", "")
_RUNS = _BOOK + "," + _period_sql(4, "")
_SUMMARY = """count(*) n, avg(net) mean, stddev_samp(net) sd, avg(net) / (stddev_samp(net) / sqrt(count(*))) t, avg(net) - 1.96 * stddev_samp(net) / sqrt(count(*)) low, avg(net) + 1.96 * stddev_samp(net) / sqrt(count(*)) high,
  avg(net) / stddev_samp(net) * sqrt(365 / {hold}.0::double) sharpe, avg(net) * 365 / {hold} / 100 annual_pct, avg((net > 0)::int) hit, avg(turnover) turnover,
  case when var_samp(market) > 0 then covar_samp(net, market) / var_samp(market) else 0 end beta, avg(net) - case when var_samp(market) > 0 then covar_samp(net, market) / var_samp(market) else 0 end * avg(market) alpha"""


def _rounded(names: str, digits: int) -> str:
    return ", ".join(f"round({n}, {digits}) {n}" for n in names.split())


ORACLES = {
    "panel_bars": f"with {_USABLE} select date_idx, symbol, {_rounded('open high low close quote_volume', 6)}, trades, round(taker_buy_frac, 6) taker_buy_frac, minutes, round(f, 6) funding_bps, complete from u",
    "panel_report": f"with {_USABLE}, b as (select date_idx, count(*) n from u group by 1) select count(*) n_rows, count(distinct symbol) symbols, count(distinct date_idx) dates, round(avg((funding_periods > 0)::int), 6) funded, (select min(n) from b) least, round((select quantile_cont(n, 0.5) from b), 6) median, (select max(n) from b) most from u",
    "panel_factors": f"with {_FACTORS} select date_idx, symbol, {_rounded('carry_1 carry_7 carry_30 mom_7 mom_30 rev_3 lowvol_30 lowrv_30 illiq_30 small_30 taker_7', 4)} from fac",
    "panel_shape_factors": f"with {_SHAPE} select date_idx, symbol, {_rounded('max_7 skew_30 beta_30', 4)} from fac",
    "panel_universe": f"with {_USABLE},{_RUN.format(src='u')} select date_idx, symbol, run, round(median_volume, 6) median_volume, eligible from el",
    "panel_rank_blend": f"with {_FACTORS}, h as (select *, carry_7 is not null and mom_14 is not null have from fac) select date_idx, symbol, round(case when have and count(*) over (partition by date_idx, have) >= 2 then percent_rank() over (partition by date_idx, have order by carry_7, symbol) * 0.5 + percent_rank() over (partition by date_idx, have order by mom_14, symbol) * 0.5 end, 6) blend from h",
    "panel_funding_days": f"with {views.FUNDING_SQL}, o as (select symbol, ts_ms, max(rate_bps) rate_bps from funding group by 1, 2), g as (select symbol, make_timestamp(((round_even(ts_ms / 60000.0::double, 0) * 60000 - 1) * 1000)::bigint)::date as dy, sum(rate_bps) fb, count(*) n from o group by 1, 2) select symbol, dy::varchar as day, round(case when n >= 2 then fb end, 6) funding_bps, case when n >= 2 then n else 0 end funding_periods from g",
    "panel_reference_carry": f"with {_USABLE}, j as (select a.*, case when a.trades % 2 = 0 then a.f * 0.5 end rf from u a), w as (select *, case when date_idx >= 6 and count(f - rf) over ({_window(7)}) >= 6 then -sum(f - rf) over ({_window(7)}) / 7 end c from j) select date_idx, symbol plain, round(rf, 6) ref_funding_bps, round(c, 6) carry_rel_7 from w",
    "panel_correlations": f"with {_RET}, x as (select symbol, date_idx, ret - avg(ret) over (partition by date_idx) x from r where ret is not null), good as (select symbol from x group by 1 having count(*) >= 20), us as (select * from x semi join good using (symbol)), dd as (select date_idx from us group by 1 having count(*) = (select count(*) from good)), fl as (select * from us semi join dd using (date_idx)) select a.symbol a, b.symbol b, round(corr(a.x, b.x), 5) corr, count(*) as days from fl a join fl b on a.date_idx = b.date_idx and a.symbol < b.symbol group by 1, 2 having count(*) >= 20",
    "factor_weights": f"with {_BOOK} select date_idx, symbol, side, {_rounded('score weight price_leg funding_leg ret market', 5)} from wg",
    "factor_periods": f"with {_RUNS} select date_idx, n, {_rounded('gross price funding turnover net', 5)} from run",
    "factor_summary": f"with {_RUNS}, s as (select {_SUMMARY.format(hold=4)} from run) select n, {_rounded('mean sd t low high sharpe annual_pct hit turnover beta alpha', 4)} from s",
    "factor_ic": f"with {_BOOK}, e as (select *, ret - market ex from wg), k as (select *, rank() over (partition by date_idx order by score) + (count(*) over (partition by date_idx, score) - 1) / 2.0::double rx, rank() over (partition by date_idx order by ex) + (count(*) over (partition by date_idx, ex) - 1) / 2.0::double ry from e) select date_idx, count(*) names, round(case when max(score) = min(score) or max(ex) = min(ex) then 0 else corr(rx, ry) end, 5) ic from k group by 1 having count(*) >= 6",
    "factor_years": f"with {_RUNS} select date_idx // 52 as year, count(*) n, round(sum(net), 4) net, round(sum(price), 4) price, round(sum(funding), 4) funding from run group by rollup (date_idx // 52) having count(*) > 0",
    "factor_drawdown": f"with {_RUNS}, c as (select date_idx, sum(net) over (order by date_idx) cumulative from run) select date_idx, round(cumulative, 4) cumulative, round(greatest(0, max(cumulative) over (order by date_idx)) - cumulative, 4) drawdown from c",
    "factor_worst": f"with {_RUNS} select date_idx, round(net, 5) net from run order by run.net, date_idx limit 5",
    "factor_controls": f"""with {_RUNS}, sn as (select sc.*, seed from sc, range(1, 201) s(seed) where eligible and score is not null),
t0 as (select * exclude (score), row_number() over (partition by seed, date_idx order by md5(seed || '|' || date_idx || '|' || symbol), symbol) nth from sn),
s0 as (select seed, date_idx, score, row_number() over (partition by seed, date_idx order by symbol) nth from sn),
shf as (select t0.*, s0.score from t0 join s0 using (seed, date_idx, nth)),{_book_sql('shf', '0.2::double', 'seed', 'c')},{_period_sql(4, 'seed', 'c')},
cm as (select seed, avg(net) mean from runc group by 1)
select round((select avg(net) from run), 4) mean, round(avg(mean), 4) control_mean, round(stddev_samp(mean), 4) control_sd, round(avg((mean < (select avg(net) from run))::int), 4) beaten from cm""",
    "factor_bootstrap": f"""with {_RUNS}, ix as (select net v, row_number() over (order by date_idx) - 1 i from run), n as (select count(*) n from run),
pk as (select d, b, ('0x' || substr(md5(d || '|' || b), 1, 8))::bigint % greatest(n - 3, 1) s, n from n, range(1, 2001) r(d), lateral (select unnest(range(1, ceil(n / 4.0)::int + 1)) b)),
pl as (select d, s + o i from pk, range(0, 4) q(o) where (b - 1) * 4 + o < n), mn as (select d, avg(v) mean from pl join ix using (i) group by 1)
select round(quantile_cont(mean, 0.025), 4) low, round(quantile_cont(mean, 0.975), 4) high from mn""",
    "factor_sweep": "with " + _EL + "," + ",".join(
        f"""{_scored_sql(h, 0, str(h))},
sp{h} as (select sc{h}.* exclude (eligible), eligible and median_volume >= volume eligible, frac, volume from sc{h}, (values (0.1::double), (0.2::double), (0.3::double)) v(frac), (values (1.0::double), (60000.0::double), (300000.0::double)) u(volume)),
na{h} as (select frac, volume, quantile_cont(k, 0.5) as names from (select frac, volume, date_idx, count(*) filter (eligible) k from sp{h} group by 1, 2, 3) group by 1, 2),{_book_sql(f'sp{h}', 'frac', 'frac, volume', str(h))},{_period_sql(h, 'frac, volume', str(h))},
o{h} as (select {h} hold, frac, cost, volume, any_value(na{h}.names) as names, count(*) n, round(avg((2 * gross - turnover * cost) / 2), 4) mean, round(stddev_samp((2 * gross - turnover * cost) / 2), 4) sd, round(avg(turnover), 4) turnover
  from run{h} join na{h} using (frac, volume), (values (5.0::double), (20.0::double)) c(cost) group by frac, volume, cost)""" for h in (3, 7)
    ) + " select * from o3 union all select * from o7",
    "factor_halves": "with " + _EL + "," + _scored_sql(4, 1) + f""", hv as (select sc.*, seed, ('0x' || substr(md5(seed || '|' || symbol), 1, 6))::bigint % 2 half from sc, range(1, 6) s(seed)),{_book_sql('hv', '0.2::double', 'seed, half', 'h')},{_period_sql(4, 'seed, half', 'h')}
select seed::int seed, half, count(*) n, round(avg(net), 4) mean from runh group by 1, 2""",
    "factor_capacity": f"with {_BOOK}, z as (select date_idx, min(0.02::double * median_volume / (abs(weight) / 2)) s from wg where side <> 0 group by 1) select round(min(s), 3) least, round(quantile_cont(s, 0.1), 3) p10, round(quantile_cont(s, 0.5), 3) median, round(arg_max(s, date_idx), 3) latest from z",
    "factor_banded": f"""with recursive {_EL},{_scored_sql(4, 1)}, nm as (select date_idx, list(symbol order by score, symbol) ns, count(*) n from sc where eligible and score is not null group by 1),
dt as (select *, row_number() over (order by date_idx) i, least(greatest(1, round_even(n * 0.2::double, 0)::int), n // 2) k, least(greatest(1, round_even(n * (0.2::double + 0.1::double), 0)::int), n // 2) reach from nm),
fold(i, date_idx, up, down) as (
  select 0::bigint, null::bigint, []::varchar[], []::varchar[]
  union all
  select dt.i, dt.date_idx, case when n >= 6 then list_concat(su, list_filter(list_reverse(ns), lambda x: not list_contains(su, x))[1:k - len(su)]) else [] end, case when n >= 6 then list_concat(sd, list_filter(ns, lambda x: not list_contains(sd, x))[1:k - len(sd)]) else [] end
  from (select dt.*, list_filter(list_reverse(ns)[1:reach], lambda x: list_contains(up, x))[1:k] su, list_filter(ns[1:reach], lambda x: list_contains(down, x))[1:k] sd from fold join dt on dt.i = fold.i + 1) dt)
select 'carry_7' spec, date_idx, unnest(up) symbol, 1::bigint side from fold where i > 0 union all select 'carry_7', date_idx, x, -1 from (select date_idx, up, unnest(down) x from fold where i > 0) where not list_contains(up, x)""",
    "panel_merge_pages": f"with {views.FUNDING_SQL}, p as (select *, 1 page from funding union all select *, 2 from funding where ts_ms % 3 = 0), k as (select *, row_number() over (partition by symbol, ts_ms order by page desc, rate_bps desc) nth, count(*) over (partition by symbol, ts_ms) copies from p) select symbol, count(*) stamps, sum(copies)::bigint seen, round(sum(rate_bps), 4) rate from k where nth = 1 group by 1",
}
QUERIES = [
    panel_bars, panel_report, panel_factors, panel_shape_factors, panel_universe, panel_rank_blend, panel_funding_days, panel_reference_carry, panel_correlations, factor_weights, factor_periods, factor_summary,
    factor_ic, factor_years, factor_drawdown, factor_worst, factor_controls, factor_bootstrap, factor_sweep, factor_halves, factor_capacity, factor_banded, panel_merge_pages,
]

