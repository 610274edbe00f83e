"""Queries over sizes, audits, streaks, screens and clusters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.operators.clusters import clusters
from marketframe.plans import limits as L
from marketframe.plans import panel as P
from marketframe.plans import panel_queries
from marketframe.sources import loaders, views

LIMITS = {"mmr": 0.01, "fee_bps": 6.0, "leverage": 9.0, "order": 4000.0, "position": 9000.0, "off_mark": 0.05, "distance": 0.1}


def position_sizes(spark: SparkSession, d: str) -> DataFrame:
    p = views.positions(spark, d)
    vol = F.lit(0.02) + F.pmod("user", F.lit(9)) / 100
    s = L.position_size(F.col("position_value"), vol, F.pmod("user", F.lit(5)) / 1000, {"cap": F.lit(50000.0)})
    return p.select("user", s.alias("s")).select("user", F.round("s.size", 2).alias("size"), "s.bound")


def perp_audit(spark: SparkSession, d: str) -> DataFrame:
    f = views.fills(spark, d).where("size > 0")
    held = ((F.col("n") % 7) - 3) * 10
    o = f.select("market_id", "n", "side", F.col("price").cast("double").alias("price"), F.col("size").cast("double").alias("size"), held.cast("double").alias("held"), (F.col("price") + 1).cast("double").alias("held_entry"), (2 + F.col("n") % 9).cast("double").alias("leverage"), F.lit(900.0).alias("margin"), (F.col("price") * (1 + (F.col("n") % 13 - 6) / 100)).alias("mark"), (F.col("n") % 10 == 0).alias("reduce_only"))
    return L.perp_order_audit(o, LIMITS).groupBy(F.concat_ws("; ", "reasons").alias("reasons")).agg(F.count(F.lit(1)).alias("orders"))


def losing_streaks(spark: SparkSession, d: str) -> DataFrame:
    t = views.fills(spark, d).withColumn("pnl", F.col("size") * (F.col("price") - 50) - F.col("fee"))
    return L.loss_streaks(t, ["market_id"])


def instrument_screen(spark: SparkSession, d: str) -> DataFrame:
    part = views.table(spark, d, "part")
    i = part.select(F.concat(F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 3 == 0, "-USDC").otherwise("-USDT")).alias("name"), F.col("p_size").cast("double").alias("base_volume"), F.col("p_retailprice").alias("last"), F.col("p_retailprice").alias("bid"), (F.col("p_retailprice") + F.col("p_partkey") % 4 - 1).alias("ask"))
    return loaders.screened(i, "-USDT", 1000.0, 50).select("name", F.round("usd_volume", 4).alias("usd_volume"))


def symbol_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Symbols whose returns correlate at 0.1 or more, by year of the panel."""
    p = P.log_return(P.usable(views.daily_bars(spark, d)), 1, "ret").withColumn("year", F.floor(F.col("date_idx") / 52).cast("int"))
    pairs = P.correlations(p, by=["year"]).where("corr >= 0.1").select("year", "a", "b")
    return clusters(p.select("year", F.col("symbol").alias("node")), pairs, ["year"])


_R = """case when reduce_only then case when held <> 0 and sign(held) <> sign(sg) and abs(held + sg) < abs(held) then '' else 'does not reduce' end else concat_ws('; ', case when leverage > 9 then 'leverage' end, case when size * price > 4000 then 'order too large' end, case when abs(pa) * mark > 9000 then 'position too large' end,
  case when size * price / leverage > 900 then 'margin' end, case when abs(price / mark - 1) > 0.05::double then 'far from the mark' end, case when (case when pa >= 0 then mark - liq else liq - mark end) / mark < 0.1::double then 'close to liquidation' end) end"""
#: Clusters of each year: year, node, cluster (in a recursive WITH).
CLUSTER_SQL = f"""{panel_queries._RET}, cy as (select (date_idx // 52)::int as year, * from r),
cx as (select year, symbol, date_idx, ret - avg(ret) over (partition by year, date_idx) x from cy where ret is not null),
cg as (select year, symbol from cx group by 1, 2 having count(*) >= 20), cu as (select * from cx semi join cg using (year, symbol)),
cd as (select u.year, date_idx from cu u join (select year, count(*) k from cg group by 1) k on u.year = k.year group by 1, 2, k having count(*) = k), cf as (select cu.* from cu semi join cd using (year, date_idx)),
ce as (select a.year, a.symbol a, b.symbol b from cf a join cf b on a.year = b.year and a.date_idx = b.date_idx and a.symbol < b.symbol group by 1, 2, 3 having count(*) >= 20 and corr(a.x, b.x) >= 0.1::double and stddev_pop(a.x) * stddev_pop(b.x) > 0),
cb as (select year, a, b from ce union select year, b, a from ce),
reach as (select distinct year, symbol node, symbol other from cy union select reach.year, node, b from reach join cb on reach.year = cb.year and reach.other = cb.a),
clusters_ as (select year, node, min(other) as cluster from reach group by 1, 2)"""
ORACLES = {
    "position_sizes": f"""with {views.POSITION_SQL}, k as (select "user", position_value e, 0.02::double + ("user" % 9) / 100.0::double v, ("user" % 5) / 1000.0::double g from positions),
z as (select "user", e * 0.01::double / v a, greatest(0, e * 0.25::double * g / (v * v)) b from k) select "user", round(least(a, b, 50000), 2) size, case when b <= a and b <= 50000 and not (50000 = b) then 'kelly' when 50000 <= a and 50000 <= b then 'cap' when b = least(a, b) then 'kelly' else 'volatility' end bound from z""",
    "perp_audit": f"""with {views.FILL_SQL}, o as (select market_id, n, side, price::double price, size::double size, (((n % 7) - 3) * 10)::double held, (price + 1)::double he, (2 + n % 9)::double leverage, price * (1 + (n % 13 - 6) / 100.0::double) mark, n % 10 = 0 reduce_only, case when side = 'buy' then size else -size end::double sg from fills where size > 0),
a as (select *, held + sg pa, case when held = 0 or sign(held) = sign(sg) then (abs(held) * he + size * price) / greatest(abs(held + sg), 1e-12) else he end en from o),
l as (select *, case when pa >= 0 then case when (en * (1 - 1 / leverage)) / (1 - 0.01::double) > 0 then least(en, (en * (1 - 1 / leverage)) / (1 - 0.01::double) * (1 + 6.0::double / 10000)) end else greatest(en, (en * (1 + 1 / leverage)) / (1 + 0.01::double) * (1 - 6.0::double / 10000)) end liq from a)
select {_R} reasons, count(*) orders from l group by 1""",
    "losing_streaks": f"""with {views.FILL_SQL}, t as (select market_id, ts_ms, n, size * (price - 50) - fee pnl from fills), i as (select *, sum((pnl >= 0)::int) over (partition by market_id order by ts_ms, n rows unbounded preceding) i from t), r as (select market_id, i, sum((pnl < 0)::int) run from i group by 1, 2),
dy as (select market_id, ts_ms // 86400000 q, sum(pnl) p from t group by 1, 2) select a.market_id, a.streak, b.worst_day from (select market_id, max(run)::bigint streak from r group by 1) a join (select market_id, min(p)::bigint worst_day from dy group by 1) b using (market_id)""",
    "instrument_screen": "select p_partkey || '-USDT' as name, round(p_size * p_retailprice, 4) usd_volume from part where p_partkey % 3 <> 0 and p_partkey % 4 - 1 > 0 and p_size * p_retailprice >= 1000 order by p_size * p_retailprice desc, p_partkey || '-USDT' limit 50",
    "symbol_clusters": f"with recursive {CLUSTER_SQL} select year, node, cluster from clusters_",
}
QUERIES = [position_sizes, perp_audit, losing_streaks, instrument_screen, symbol_clusters]
