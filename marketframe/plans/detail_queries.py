"""Queries of lags by hour, day and second, of weights by risk and cluster, of verdicts on factors, of spans of positions, of safe
leverage, of sampled books and of prints that came twice, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.functions import prices
from marketframe.operators import lags, timeseries
from marketframe.operators.saved import saved, shared_folder
from marketframe.plans import event_queries, limit_queries, limits, panel_queries
from marketframe.plans import panel as P
from marketframe.plans import portfolio as B
from marketframe.sources import archive, messages, venues, views

HOUR, DAY = 3_600_000, 86_400_000
LATE_MS = 5000
FACTORS, SEEDS = ("carry_7", "mom_7", "rev_3", "lowvol_30"), 50
KEY = ["instrument", "channel"]


def _r(df: DataFrame, digits: int) -> DataFrame:
    """Rounded off the halves, where engines differ."""
    return df.select(*[F.round(F.col(c) + 3e-7, digits).alias(c) if df.schema[c].dataType.typeName() == "double" else F.col(c) for c in df.columns])


def _lags(spark: SparkSession, d: str) -> DataFrame:
    """Messages of four connections; the event's type is the channel, and every 17th message has no stamp."""
    r = event_queries._raw(spark, d).withColumn("channel", F.substring_index("m", ":", 1)).withColumn("stamp", F.when(F.col("n") % 17 != 0, F.col("stamp")))
    return lags.split(r, ["instrument"], "t", ["t", "n"], "stamp")


def _hours(spark: SparkSession, d: str) -> DataFrame:
    r = _lags(spark, d).withColumn("day", F.floor(F.col("t") / DAY)).withColumn("hour", F.floor(F.col("t") / HOUR) % 24)
    return lags.stats(r, [*KEY, "day", "hour"], LATE_MS)


def lag_report(spark: SparkSession, d: str) -> DataFrame:
    """How late messages are, by connection, channel, day and hour."""
    return _r(_hours(spark, d), 4)


def lag_days(spark: SparkSession, d: str) -> DataFrame:
    """Days combined from their hours."""
    return _r(lags.combined(_hours(spark, d), [*KEY, "day"]), 4)


def lag_seconds(spark: SparkSession, d: str) -> DataFrame:
    return lags.by_second(_lags(spark, d), ["instrument"], "t")


def _risked(spark: SparkSession, d: str) -> DataFrame:
    """Books of a factor with each name's risk at the entry and its cluster of the year before; a name without one is its own."""
    panel = P.usable(views.daily_bars(spark, d))
    made = P.universe(P.factors(panel, ["carry_7", "lowvol_30"]), panel_queries.HISTORY, panel_queries.VOLUME).withColumn("vol", -F.col("lowvol_30"))
    booked = B.books(B.score_rows(made, "carry_7", panel_queries.HOLD, 1, panel_queries.START, "vol"), panel_queries.FRAC)
    before = limit_queries.symbol_clusters(spark, d).select((F.col("year") + 1).alias("year"), F.col("node").alias("symbol"), "cluster")
    return booked.withColumn("year", F.floor(F.col("date_idx") / 52).cast("int")).join(before, ["year", "symbol"], "left").withColumn("cluster", F.coalesce("cluster", "symbol"))


def factor_risk_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights of the sides by inverse risk, and so that a cluster gets one name's money."""
    booked = saved(_risked(spark, d))
    plain = B.weigh(booked, B.raw_weights(booked)).select("date_idx", "symbol", "side", "cluster", F.col("weight").alias("by_risk"))
    shared = B.weigh(booked, B.raw_weights(booked, "risk", "cluster")).select("date_idx", "symbol", F.col("weight").alias("by_cluster"))
    return _r(plain.where("side <> 0").join(shared, ["date_idx", "symbol"]), 5)


def factor_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Four factors against their shuffled controls: the interval, the price leg net of its own cost, and whether they clear."""
    panel = P.universe(P.factors(P.usable(views.daily_bars(spark, d)), FACTORS), panel_queries.HISTORY, panel_queries.VOLUME)
    scored = saved(B.score_rows(panel, FACTORS, panel_queries.HOLD, 1, panel_queries.START))
    run = lambda rows, spec: B.periods(B.weigh(B.books(rows, panel_queries.FRAC, spec), spec=spec), panel_queries.HOLD, panel_queries.COST, spec)
    runs = saved(run(scored, ["factor"]))
    real = B.summary(runs, panel_queries.HOLD, ["factor"]).join(runs.groupBy("factor").agg(F.avg("price").alias("price")), "factor")
    controls = B.summary(run(B.shuffled(scored, SEEDS, spec=["factor"]), ["factor", "seed"]), panel_queries.HOLD, ["factor", "seed"])
    judged = saved(B.net_price_leg(B.share_beaten(saved(real), controls, ["factor"]), panel_queries.COST))
    clear = B.verdict(judged).select("factor", F.lit(1).alias("_clears"))
    out = judged.join(clear, "factor", "left").withColumn("clears", F.coalesce("_clears", F.lit(0)))
    return _r(out.select("factor", "n", "mean", "low", "high", "net_price", "beaten", "clears"), 4)


def position_spans(spark: SparkSession, d: str) -> DataFrame:
    """Customers' orders as account states of two coins; some only say that nothing has changed."""
    o = views.contracts(spark, d)
    leg = lambda coin, size: F.concat(F.lit(f'{{"position":{{"coin":"{coin}","szi":"'), size.cast("string"), F.lit('"}}'))
    m = F.concat(F.lit('{"assetPositions":['), leg("A", F.floor(F.col("signal") / 20)), F.lit(","), leg("B", F.floor(F.col("signal") / 50) - 1), F.lit("]}"))
    states = o.select(F.col("market_id").alias("user"), (F.col("opens_ms") + F.pmod("row_id", F.lit(DAY))).alias("t"), F.when(F.col("row_id") % 3 != 0, m).alias("m"))
    return messages.position_history(states)


def leverage_limits(spark: SparkSession, d: str) -> DataFrame:
    """The leverage that keeps a distance from liquidation, and whether the modelled price agrees with the reported one."""
    p = views.positions(spark, d)
    side, mmr, buffer = F.when(F.col("size") >= 0, "long").otherwise("short"), F.lit(0.005) + (F.col("user") % 4) / 200, (F.col("user") % 14 - 1) / 12
    modelled = prices.liquidation_price(side, F.col("entry_px"), F.abs("size"), F.lit(5.0), mmr, F.lit(0.0), F.lit(6.0))
    near = F.col("liquidation_px") * (0.2 + (F.col("user") % 5) / 5)
    reported = F.when(F.col("user") % 3 == 0, modelled * (1 + (F.col("user") % 7 - 3) / 250)).otherwise(near)
    out = p.select("user", F.round(prices.safe_leverage(side, buffer, mmr), 5).alias("leverage"), prices.against_reported(modelled, reported).alias("c"))
    return out.select("user", "leverage", F.col("c.ok").cast("int").alias("ok"), F.round("c.error", 5).alias("error"), "c.reason")


def sampled_touch(spark: SparkSession, d: str) -> DataFrame:
    """The touch at most once an hour, and whether it was crossed."""
    t = views.book_top(spark, d).withColumn("ask", F.when(F.col("n") % 5 == 0, F.col("bid") - 1).otherwise(F.col("ask")))
    kept = timeseries.thin(t.select("instrument", "n", "ts_ms", "bid", "ask"), ["instrument"], "ts_ms", ["ts_ms", "n"], HOUR)
    return kept.withColumn("crossed", (F.col("bid") >= F.col("ask")).cast("int"))


def print_copies(spark: SparkSession, d: str) -> DataFrame:
    """Live prints, some archived twice with other bytes, some of them with another size and so prints of their own."""
    t = views.tape(spark, d)
    m = lambda size, more: F.concat(
        F.lit('{"transaction_hash":"h'), F.col("n"), F.lit('","asset_id":"'), F.col("instrument"), F.lit('","price":"'), F.col("price"), F.lit('","size":"'), size, F.lit('","side":"'),
        F.when(F.col("is_buy"), "BUY").otherwise("SELL"), F.lit(f'","timestamp":"'), F.col("ts_ms"), F.lit(f'"{more}}}'),
    )
    first = t.select("instrument", F.col("ts_ms").alias("t"), "n", "size", m(F.col("size"), "").alias("m"))
    again = t.where("n % 20 = 0").select("instrument", (F.col("ts_ms") + 5000).alias("t"), "n", F.when(F.col("n") % 40 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), m(F.when(F.col("n") % 40 == 0, F.col("size") + 1).otherwise(F.col("size")), ',"extra":1').alias("m"))
    kept = venues.distinct_prints(first.union(again))
    return kept.groupBy("instrument").agg(F.count(F.lit(1)).alias("prints"), F.sum(F.col("copies") - 1).alias("dropped"), F.sum("size").alias("size"), F.sum("t").alias("t_sum"))


ROW = "market_id long, row_id long, opens_ms long, entry long, resolved_yes boolean"


def appended_rows(spark: SparkSession, d: str) -> DataFrame:
    """Labelled rows kept as JSON lines: those of even signals are there when all, twice over, are appended; then that is done again."""
    folder = f"{shared_folder(spark)}/rows-{uuid.uuid4().hex}"
    rows = views.contracts(spark, d).select("market_id", "row_id", "opens_ms", "entry", "resolved_yes", "signal")
    for batch in (rows.where("signal % 2 = 0"), rows.union(rows), rows):
        archive.append_rows(batch, folder, ROW, ["market_id", "row_id"])
    back = archive.read_rows(spark, folder, ROW)
    return back.groupBy("market_id").agg(F.count(F.lit(1)).alias("n"), F.sum("row_id").alias("ids"), F.sum("entry").alias("entry"), F.count_if("resolved_yes").alias("yes"), F.max("opens_ms").alias("newest"))


def batched_frames(spark: SparkSession, d: str) -> DataFrame:
    """Frames of one or of three messages, some without a tag: messages and bytes of each tag and place."""
    e = views.table(spark, d, "events")
    one = lambda k: F.concat(F.lit('{"px":1.5,"k":'), (F.col("event_id") + k).cast("string"), F.when(F.col("event_id") % 9 != k, F.concat(F.lit(',"event_type":"'), F.col("event_type"), F.lit(f'_{k}"'))).otherwise(""), F.lit("}"))
    m = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit(" ["), F.concat_ws(", ", one(0), one(1), one(2)), F.lit("]"))).otherwise(one(0))
    f = messages.single_frames(e.select("user_id", m.alias("m")))
    return f.groupBy("nth", messages.event_type(F.col("m")).alias("tag")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("m")).alias("bytes"))


def _tilt(panel: DataFrame) -> DataFrame:
    """Funding paid for each of a symbol's trades."""
    return panel.select("date_idx", "symbol", (F.col("funding_bps") / F.col("trades")).alias("value"))


def _fade(rows: DataFrame) -> Column:
    """NO where YES is dear against the signal, at a cent below its price, resting when the signal is even."""
    dear = F.col("entry") - F.col("signal") >= 40
    return F.when(dear, F.struct(F.lit("no").alias("outcome"), (99 - F.col("entry")).alias("price"), F.col("size"), F.when(F.col("signal") % 2 == 0, "maker").otherwise("taker").alias("role")))


P.register_factor("tilt", _tilt)
limits.register_decision("fade", _fade)


def registered_factor(spark: SparkSession, d: str) -> DataFrame:
    """A user's factor through the same books and weights as the built-in ones."""
    panel = P.universe(P.external_factor(P.usable(views.daily_bars(spark, d)), "tilt"), panel_queries.HISTORY, panel_queries.VOLUME)
    runs = B.periods(B.weigh(B.books(B.score_rows(panel, "tilt", panel_queries.HOLD, 1, panel_queries.START), panel_queries.FRAC)), panel_queries.HOLD, panel_queries.COST)
    return _r(runs.select("date_idx", "n", "gross", "turnover", "net"), 4)


def registered_decision(spark: SparkSession, d: str) -> DataFrame:
    made = limits.decided(views.contracts(spark, d).select("row_id", "entry", "signal", F.col("size").alias("size")), "fade")
    return made.select("row_id", "outcome", "price", "role")


def _near(names: str, digits: int = 4) -> str:
    return ", ".join(f"round({c} + 3e-7, {digits}) {c}" for c in names.split())


_P = panel_queries
_LAGS = f"""{event_queries._RAW}, ls as (select instrument, split_part(m, ':', 1) channel, n, t, case when n % 17 <> 0 then stamp end stamp from raw),
lf as (select *, max(stamp) over (partition by instrument order by t, n rows unbounded preceding) freshest from ls),
la as (select *, t - stamp lag, case when stamp is not null then freshest - stamp end venue, case when stamp is not null then t - freshest end aft, t // {DAY} as day, t // {HOUR} % 24 as hour from lf)"""
_HOURS = f"""{_LAGS}, ho as (select instrument, channel, day, hour, count(*) n, quantile_cont(lag, 0.5) p50, quantile_cont(lag, 0.9) p90, quantile_cont(lag, 0.99) p99, max(lag) most, min(lag) least, avg((lag > {LATE_MS})::int) late,
  quantile_cont(venue, 0.9) venue_p90, quantile_cont(aft, 0.9) after_p90 from la where lag is not null group by 1, 2, 3, 4)"""
_QS = "p50 p90 p99 late venue_p90 after_p90"
_ALL = _P._FACTORS + "," + _P._RUN.format(src="fac")
_LEGS = f"max(close) over (partition by symbol order by date_idx range between 4 following and 4 following) exit_close, -coalesce(sum(f) over (partition by symbol order by date_idx range between 1 following and 4 following), 0) funding_leg"
_ENTRY = "date_idx >= 31 and (date_idx - 31) % 4 = 0 and date_idx < (select max(date_idx) from panel) + 1 - 4"
_VERDICT = f"""{_ALL}, lg as (select *, {', '.join(f"{_P._lag(f, 1)} s{k}" for k, f in enumerate(FACTORS))}, {_LEGS} from el),
sc as (select factor, symbol, date_idx, score, eligible, ln(exit_close / close) * 10000 price_leg, funding_leg, ln(exit_close / close) * 10000 + funding_leg ret from ({' union all '.join(f"select '{f}' factor, s{k} score, * from lg" for k, f in enumerate(FACTORS))}) where {_ENTRY}),{_P._book_sql('sc', '0.2::double', 'factor')},{_P._period_sql(4, 'factor')},
sn as (select sc.*, seed from sc, range(1, {SEEDS + 1}) s(seed) where eligible and score is not null),
t0 as (select * exclude (score), row_number() over (partition by factor, seed, date_idx order by md5(seed || '|' || date_idx || '|' || symbol), symbol) nth from sn),
s0 as (select factor, seed, date_idx, score, row_number() over (partition by factor, seed, date_idx order by symbol) nth from sn),
shf as (select t0.*, s0.score from t0 join s0 using (factor, seed, date_idx, nth)),{_P._book_sql('shf', '0.2::double', 'factor, seed', 'c')},{_P._period_sql(4, 'factor, seed', 'c')},
cm as (select factor, seed, avg(net) m from runc group by 1, 2), rl as (select factor, count(*) n, avg(net) mean, avg(net) - 1.96 * stddev_samp(net) / sqrt(count(*)) low, avg(net) + 1.96 * stddev_samp(net) / sqrt(count(*)) high, avg(price) - avg(turnover) * 10 / 2 net_price from run group by 1),
bt as (select factor, avg((m < mean)::int) beaten from cm join rl using (factor) group by 1)"""
ORACLES = {
    "lag_report": f"with {_HOURS} select instrument, channel, day, hour, n, most, least, {_near(_QS)} from ho",
    "lag_days": f"with {_HOURS}, co as (select instrument, channel, day, sum(n)::bigint n, max(most) most, min(least) least, {', '.join(f'sum({q} * n) / sum(n) {q}' for q in _QS.split())} from ho group by 1, 2, 3) select instrument, channel, day, n, most, least, {_near(_QS)} from co",
    "lag_seconds": f"with {_LAGS} select instrument, t // 1000 as second, count(*) messages, max(lag) most from la group by 1, 2",
    "factor_risk_weights": f"""with recursive {limit_queries.CLUSTER_SQL}, {_ALL.partition(_P._RET + ',')[2]}, lg as (select *, {_P._lag('carry_7', 1)} score, -lowvol_30 risk, {_LEGS} from el),
sc as (select symbol, date_idx, score, eligible and coalesce(risk > 0, false) eligible, risk, ln(exit_close / close) * 10000 + funding_leg ret from lg where {_ENTRY}),{_P._book_sql('sc', '0.2::double', '')},
w0 as (select wg.*, coalesce(c.cluster, symbol) cl from wg left join clusters_ c on c.node = wg.symbol and c.year + 1 = wg.date_idx // 52),
w1 as (select *, 1 / risk a, 1 / risk / count(*) over (partition by date_idx, side, cl) b from w0 where side <> 0)
select date_idx, symbol, side, cl as cluster, round(side * a / sum(a) over (partition by date_idx, side) + 3e-7, 5) by_risk, round(side * b / sum(b) over (partition by date_idx, side) + 3e-7, 5) by_cluster from w1""",
    "factor_verdicts": f"""with {_VERDICT} select factor, n, {_near('mean low high net_price beaten')}, (low > 0 and beaten >= 0.95)::int clears from rl join bt using (factor)""",
    "position_spans": f"""with {views.CONTRACT_SQL}, st as (select market_id "user", opens_ms + row_id % {DAY} t, row_id % 3 = 0 marker, signal // 20 a, signal // 50 - 1 b from contracts),
nu as (select *, count(*) filter (not marker) over (partition by "user" order by t rows unbounded preceding) k from st),
fu as (select "user", k, min(t) t, max(t) seen, max(case when not marker then a end) a, max(case when not marker then b end) b from nu where k > 0 group by 1, 2), nx as (select *, lead(t) over (partition by "user" order by k) nxt from fu),
he as (select "user", 'A' coin, a size, k, t, seen, nxt from nx where a <> 0 union all select "user", 'B', b, k, t, seen, nxt from nx where b <> 0),
ga as (select *, case when lag(k) over w = k - 1 and lag(size) over w = size then 0 else 1 end nw from he window w as (partition by "user", coin order by k)),
sp as (select *, sum(nw) over (partition by "user", coin order by k) s from ga)
select "user", coin, max(size)::double size, min(t) opened_ms, max(seen) confirmed_ms, case when max(k) = max(case when nxt is not null then k end) then max(nxt) end closed_ms, count(*) states from sp group by "user", coin, s""",
    "leverage_limits": f"""with {views.POSITION_SQL}, q as (select *, size >= 0 lng, 0.005::double + ("user" % 4) / 200.0::double mmr, ("user" % 14 - 1) / 12.0::double buf from positions),
m as (select *, case when lng then least(entry_px, entry_px * 0.8::double / (1 - mmr) * (1 + 6.0::double / 10000)) else greatest(entry_px, entry_px * 1.2::double / (1 + mmr) * (1 - 6.0::double / 10000)) end est, case when lng then 1 - (1 - buf) * (1 - mmr) else (1 + buf) * (1 + mmr) - 1 end room from q),
r as (select *, case when "user" % 3 = 0 then est * (1 + ("user" % 7 - 3) / 250.0::double) else liquidation_px * (0.2::double + ("user" % 5) / 5.0::double) end rep from m), e as (select *, case when est is not null and rep > 0 then abs(est - rep) / rep end err from r)
select "user", round(case when buf > 0 and buf < 1 and room > 0 then 1 / room else 0 end, 5) leverage, coalesce(err <= 0.01::double, false)::int ok, round(err, 5) error, case when err is null then 'missing or invalid' when err > 0.01::double then 'disagrees with the venue' else '' end reason from e""",
    "sampled_touch": f"""with recursive {views.BOOK_SQL}, tc as (select * replace (case when n % 5 = 0 then bid - 1 else ask end as ask) from touch), k as (select instrument, n, ts_ms, bid, ask from tc qualify row_number() over (partition by instrument order by ts_ms, n) = 1
union all select x.instrument, x.n, x.ts_ms, x.bid, x.ask from (select k.instrument, min((t.ts_ms, t.n, t.bid, t.ask)) b from k join tc t on t.instrument = k.instrument and t.ts_ms >= k.ts_ms + {HOUR} group by k.instrument) y, lateral (select y.instrument, y.b[1] ts_ms, y.b[2] n, y.b[3] bid, y.b[4] ask) x)
select instrument, n, ts_ms, bid, ask, (bid >= ask)::int crossed from k""",
    "print_copies": f"""with {views.TAPE_SQL}, pr as (select instrument, n, ts_ms t, size from tape union all select instrument, n, ts_ms + 5000, case when n % 40 = 0 then size + 1 else size end from tape where n % 20 = 0),
di as (select instrument, n, size, min(t) t, count(*) c from pr group by 1, 2, 3) select instrument, count(*) prints, sum(c - 1)::bigint dropped, sum(size)::bigint size, sum(t)::bigint t_sum from di group by 1""",
    "appended_rows": f"with {views.CONTRACT_SQL} select market_id, count(*) n, sum(row_id)::bigint ids, sum(entry)::bigint entry, count(*) filter (resolved_yes) yes, max(opens_ms) newest from contracts group by 1",
    "batched_frames": """with f as (select event_id + k id, event_id, k, event_type || '_' || k tag from events, range(0, 3) r(k) where k = 0 or event_id % 4 = 0),
g as (select k, case when event_id % 9 <> k then tag else 'unknown' end tag, '{"px":1.5,"k":' || id || case when event_id % 9 <> k then ',"event_type":"' || tag || '"' else '' end || '}' m from f)
select k::int nth, tag, count(*) n, sum(strlen(m))::bigint as bytes from g group by 1, 2""",
    "registered_factor": f"""with {_P._USABLE},{_P._RUN.format(src='u')}, lg as (select *, max(f / trades) over (partition by symbol order by date_idx range between 1 preceding and 1 preceding) score, {_LEGS} from el),
sc as (select symbol, date_idx, score, eligible, ln(exit_close / close) * 10000 price_leg, funding_leg, ln(exit_close / close) * 10000 + funding_leg ret from lg where {_ENTRY}),{_P._book_sql('sc', '0.2::double', '')},{_P._period_sql(4, '')} select date_idx, n, {_near('gross turnover net')} from run""",
    "registered_decision": f"with {views.CONTRACT_SQL} select row_id, 'no' outcome, 99 - entry price, case when signal % 2 = 0 then 'maker' else 'taker' end as role from contracts where entry - signal >= 40",
}
QUERIES = [lag_report, lag_days, lag_seconds, factor_risk_weights, factor_verdicts, position_spans, leverage_limits, sampled_touch, print_copies, appended_rows, batched_frames, registered_factor, registered_decision]
