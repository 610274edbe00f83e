"""Operators on inputs small enough to work out by hand."""

import gzip
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketframe.functions import fees, prices
from marketframe.operators import book, features
from marketframe.operators import timeseries as T
from marketframe.plans import contracts as C
from marketframe.plans import panel as P
from marketframe.plans import portfolio as B
from marketframe.sources import archive, messages


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_event_contract_by_hand(spark):
    # 10 at 0.50 each: 0.07 * 0.25 * 10 = 0.175, up to 0.18; three wins of four: gross 3*10 - 4*5 = 10, fees 0.72, net 9.28
    t = spark.createDataFrame([(i, "YES", y) for i, y in enumerate([True, False, True, True])], "row_id int, outcome string, resolved_yes boolean")
    t = t.select("*", F.lit("alpha").alias("venue"), F.lit("default").alias("tier"), F.lit("taker").alias("role"), F.lit("0.50").cast("decimal(9,6)").alias("price"), F.lit(10).alias("size"))
    t = fees.with_fee(t, fees.curves(spark)).withColumn("fee", F.col("fee").cast("double")).withColumn("price", F.col("price").cast("double"))
    r = C.results(t).agg(F.sum("gross"), F.sum("fee"), F.sum("net"), F.sum(F.col("won").cast("int"))).first()
    assert [round(x, 6) for x in r] == [10.0, 0.72, 9.28, 3]


def test_unknown_tier_fails(spark):
    t = spark.sql("select 'alpha' venue, 'none' tier, 'taker' role, cast(0.5 as decimal(9,6)) price, 1 size")
    assert fees.unknown_tiers(t, fees.curves(spark)).count() == 1
    with pytest.raises(Exception, match="no fee tier"):
        fees.with_fee(t, fees.curves(spark)).collect()


def test_fee_table_problems(spark):
    bad = spark.createDataFrame([("x", "a", "0.08", "0.07", False, None), ("x", "b", "0.0", "0.07", False, None)], fees.CURVE_SCHEMA).withColumn("maker", F.col("maker").cast("decimal(9,6)")).withColumn("taker", F.col("taker").cast("decimal(9,6)"))
    found = rows(fees.curve_violations(bad))
    assert ("x", "a", "maker above taker") in found and ("x", "b", "duplicate curve") in found
    assert fees.ladder_violations(fees.ladder(spark)).count() == 0


def test_scalars(spark):
    one = spark.range(1)
    names = ["1000PEPEUSDT", "kPEPE", "PEPE-USDT", "BTC-USD", "1INCHUSDT"]
    assert one.select(*[prices.canonical(F.lit(x)) for x in names]).first()[:] == ("PEPE", "PEPE", "PEPE", "BTC", "1INCH")
    tail = one.select(prices.binomial_tail(F.lit(8), F.lit(10)), prices.binomial_tail(F.lit(0), F.lit(4)), prices.binomial_tail(F.lit(3), F.lit(3))).first()
    assert [round(x, 6) for x in tail] == [0.054688, 1.0, 0.125]
    liq = one.select(prices.liquidation_price(F.lit("long"), F.lit(100.0), F.lit(1.0), F.lit(5.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)), prices.liquidation_price(F.lit("short"), F.lit(100.0), F.lit(1.0), F.lit(5.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))).first()
    assert [round(x, 6) for x in liq] == [80.0, 120.0]
    assert one.select(prices.leg_tag(F.lit("carry0afp")), prices.leg_tag(F.lit("other"))).first()[:] == ("carry0af", None)
    assert prices.horizon_tag(0.5) == "0p5s" and prices.horizon_tag(300) == "300s"
    assert one.select(prices.devig(F.lit(2.0), F.lit(2.0))).first()[0] == 0.5


def test_funding_belongs_to_the_day_before_midnight(spark):
    day = 1704067200000
    f = spark.createDataFrame([("A", day + 8 * 3600000, 3.0), ("A", day + 16 * 3600000, 2.0), ("A", day + 24 * 3600000 + 2, 1.0)], "symbol string, ts_ms long, rate_bps double")
    got = P.funding_by_day(f).collect()
    assert [(str(r.day), r.funding_bps, r.funding_periods) for r in got] == [("2024-01-01", 6.0, 3)]


def test_asof_both_ways_and_buckets(spark):
    left = spark.createDataFrame([("a", 5), ("a", 10), ("a", 250), ("b", 7)], "k string, t long")
    right = spark.createDataFrame([("a", 6, 1.0), ("a", 10, 2.0), ("a", 300, 3.0)], "k string, t long, v double")
    for bucket in (None, 100, 7):
        assert rows(T.asof_join(left, right, ["k"], "t", ["v"], bucket=bucket)) == [("a", 5, None), ("a", 10, 2.0), ("a", 250, 2.0), ("b", 7, None)]
        assert rows(T.asof_join(left, right, ["k"], "t", ["v"], forward=True, bucket=bucket)) == [("a", 5, 1.0), ("a", 10, 2.0), ("a", 250, 3.0), ("b", 7, None)]


def test_runs_episodes_thinning(spark):
    p = spark.createDataFrame([("a", i, g) for i, g in [(0, True), (1, True), (2, False), (3, True), (5, True), (6, True)]], "symbol string, date_idx int, good boolean")
    assert [r.run for r in T.run_lengths(p, "good", ["symbol"], "date_idx").orderBy("date_idx").collect()] == [1, 2, 0, 1, 1, 2]
    e = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([0, 6, 3, 0, 7, 8])], "k string, t long, lag double")
    assert rows(T.episodes(e, "lag", 5, 1, ["k"], ["t"], "t")) == [("a", 1, 1, 2, 6.0, 2), ("a", 2, 4, 5, 8.0, 2)]
    t = spark.createDataFrame([("a", n, x) for n, x in enumerate([0, 3, 5, 4, 9, 10])], "k string, n long, t long")
    assert [r.t for r in T.thin(t, ["k"], "t", ["n"], 5).orderBy("n").collect()] == [0, 5, 10]


def test_ranks_and_spearman(spark):
    d = spark.createDataFrame([("a", float(x), float(x * x)) for x in range(1, 6)] + [("b", 1.0, 2.0)] * 4, "k string, x double, y double")
    got = {r.k: (r.n, round(r.spearman, 6)) for r in T.spearman(d, "x", "y", ["k"]).collect()}
    assert got == {"a": (5, 1.0), "b": (4, 0.0)}


def test_no_overlap_and_average_cost(spark):
    d = spark.createDataFrame([(1, 1, 0, 10), (1, 2, 5, 6), (1, 3, 10, 12), (2, 4, 0, 1)], "m int, id int, o long, r long")
    assert sorted(r.id for r in C.without_overlap(d, ["m"], "o", "r", "id").collect()) == [1, 3, 4]
    f = spark.createDataFrame([(1, 1, 1, "buy", 50, 10, 0), (1, 2, 2, "buy", 60, 10, 0), (1, 3, 3, "sell", 70, 25, 0)], "market_id int, n long, ts_ms long, side string, price long, size long, fee long")
    r = C.average_cost(f, ["market_id"]).first()
    assert (r.position, r.realised, r.cost) == (-5.0, 300.0, -350.0)  # 20 * (70 - 55); 5 sold short at 70


def test_books_are_neutral_and_banded(spark):
    s = spark.createDataFrame([("x", 0, chr(97 + i), float(i), True, 0.0) for i in range(10)] + [("x", 1, chr(97 + i), float(i if i != 7 else 8.5), True, 0.0) for i in range(10)], "spec string, date_idx long, symbol string, score double, eligible boolean, ret double")
    w = B.weigh(B.books(s, 0.2))
    assert [round(x, 9) for x in w.groupBy("date_idx").agg(F.sum("weight"), F.sum(F.abs("weight"))).orderBy("date_idx").first()[1:]] == [0.0, 2.0]
    held = B.banded(s, 0.2, 0.2).where("side = 1 and date_idx = 1").select("symbol").collect()
    assert sorted(r.symbol for r in held) == ["i", "j"]


def test_controls_keep_every_count(spark):
    s = spark.createDataFrame([(0, chr(97 + i), float(i), True) for i in range(8)], "date_idx int, symbol string, score double, eligible boolean")
    c = B.shuffled(s, 5)
    assert c.count() == 40
    assert c.groupBy("seed").agg(F.sum("score").alias("s")).select("s").distinct().count() == 1


FRAMES = [("snapshot", 5, -1), ("update", 6, 5), ("update", 6, 5), ("update", 8, 7), ("update", 9, 8), ("snapshot", 10, -1), ("update", 11, 10)]


def test_sequence_rule(spark):
    m = spark.createDataFrame([("a", i, i, *f) for i, f in enumerate(FRAMES)], "instrument string, ts_ms long, n long, action string, seq long, prev_seq long")
    got = book.applied(m, ["instrument"]).orderBy("n").collect()
    assert [r.applied for r in got] == [True, True, False, False, False, True, True]
    assert [r.epoch for r in got] == [1, 1, 1, 1, 1, 2, 2]


def level(*pairs):
    return [{"price": float(p), "size": float(s)} for p, s in pairs]


def test_book_fold_and_levels(spark):
    schema = "instrument string, epoch long, ts_ms long, n long, action string, bids array<struct<price:double,size:double>>, asks array<struct<price:double,size:double>>"
    m = spark.createDataFrame([("a", 1, 1, 1, "snapshot", level((10, 1), (9, 2)), level((11, 3))), ("a", 1, 2, 2, "update", level((10, 0)), level((12, 4)))], schema)
    assert rows(book.top_of_book(m, ["instrument"]).select("n", "bid", "ask", "bid_size", "ask_size", "bid_depth", "ask_depth")) == [(1, 10.0, 11.0, 1.0, 3.0, 3.0, 3.0), (2, 9.0, 11.0, 2.0, 3.0, 2.0, 7.0)]
    d = spark.createDataFrame([("a", "bid", 1.0, 1, 1, 5.0), ("a", "bid", 1.0, 2, 2, -9.0), ("a", "bid", 1.0, 3, 3, 2.0)], "instrument string, side string, price double, ts_ms long, n long, delta double")
    assert [r.size for r in book.level_sizes(d, ["instrument"]).orderBy("n").collect()] == [5.0, 0.0, 2.0]


def test_order_flow(spark):
    t = spark.createDataFrame([("a", 1, 1, 10, 12, 5, 5), ("a", 2, 2, 11, 12, 4, 3), ("a", 3, 3, 10, 13, 6, 6)], "instrument string, n long, ts_ms long, bid long, ask long, bid_size long, ask_size long")
    assert [r.ofi for r in features.order_flow(t).orderBy("n").collect()] == [0.0, 4 + 2.0, -4 + 3.0]


def member(text):
    return gzip.compress(text.encode())


def test_torn_archives(spark, tmp_path):
    line = lambda i: json.dumps({"t": i, "n": i, "m": "x"}) + "\n"
    folder = tmp_path / "BTC" / "raw" / "2024-01-01"
    folder.mkdir(parents=True)
    whole, second = member(line(1) + line(2)), member(line(3))
    (folder / "books-00.jsonl.gz").write_bytes(whole + second)
    (folder / "books-01.jsonl.gz").write_bytes(whole + second[:-6])
    (folder / "books-02.r001.jsonl.gz").write_bytes(member("".join(line(i) for i in range(300)))[:-30] + second)
    (folder / "book-poll-03.jsonl.gz").write_bytes(whole + b"\0\0junk" + second)
    torn = archive.read_torn(spark, str(tmp_path))
    a = {r.path.rsplit("/", 1)[1]: r for r in archive.audit(torn).collect()}
    assert [(a[k].verdict, a[k].records) for k in ("books-00.jsonl.gz", "books-01.jsonl.gz")] == [("clean", 3), ("tail only", 3)]
    assert a["book-poll-03.jsonl.gz"].junk == 1 and a["book-poll-03.jsonl.gz"].records == 3
    r = a["books-02.r001.jsonl.gz"]
    assert r.verdict == "damaged" and r.torn + r.corrupt == 1 and r.records > 1
    cols = archive.path_columns(F.col("path"))
    got = torn.select(*[c.alias(k) for k, c in cols.items()]).distinct()
    assert {(x.channel, x.hour, x.restart) for x in got.collect()} == {("books", 0, 0), ("books", 1, 0), ("books", 2, 1), ("book-poll", 3, 0)}
    clean = archive.read_lines(spark, str(tmp_path), channel="books-00".removesuffix("-00"), day="2024-01-01").where(F.col("path").contains("books-00"))
    assert archive.events(clean).count() == 3


def test_tolerant_decode(spark):
    d = spark.createDataFrame([('{"t": 1, "n": 2, "m": "x"}',), ("{broken",), ('{"t": 1}',), ("[]",), ('{"t":1,"n":2,"m":{"a": 1}}',)], "line string")
    got = archive.decode(d).collect()
    assert [r.good for r in got] == [True, False, False, False, True]
    assert spark.range(1).select(archive.message_bytes(F.lit('{"t":1,"n":2,"m":{"a": 1}}'))).first()[0] == '{"a": 1}'


def test_parsers(spark):
    def e(*ms):
        return spark.createDataFrame([(m,) for m in ms], "m string")

    b = messages.perp_book(e('{"action":"update","data":[{"bids":[["10","1"]],"asks":[[11,0]],"ts":"5","seqId":"7","prevSeqId":"6"}]}', '{"data":{"bids":[],"asks":[],"seqId":"1"}}')).collect()
    assert (b[0].action, b[0].seq, b[0].prev_seq, b[0].bids[0].price, b[0].asks[0].size) == ("update", 7, 6, 10.0, 0.0)
    assert b[1].action == "snapshot"
    t = messages.perp_trades(e('{"data":[{"ts":"1","price":"2","size":"3","side":"buy"},{"ts":"1","price":"0","size":"3","side":"sell"}]}')).collect()
    assert [(r.price, r.is_buy) for r in t] == [(2.0, True)]
    k = messages.binary_book(e('{"orderbook":{"yes":[[40,5]],"no":[[55,7]]}}', '{"orderbook_fp":{"yes_dollars":[["0.4","5"]],"no_dollars":[["0.55","7"]]}}')).collect()
    assert [(r.bids[0].price, r.asks[0].price, r.asks[0].size) for r in k] == [(0.4, 0.45, 7.0)] * 2
    c = spark.createDataFrame([('{"price_changes":[{"asset_id":"y","price":"0.4","size":"1","side":"BUY"},{"asset_id":"n","price":"0.3","size":"2","side":"BUY"}]}', "y")], "m string, yes_token string")
    assert [(r.side, r.price) for r in messages.token_changes(c).collect()] == [("bid", 0.4), ("ask", 0.7)]
    s = spark.createDataFrame([("u", 1, '{"assetPositions":[{"position":{"coin":"BTC","szi":"-2","liquidationPx":"inf","entryPx":"5"}},{"position":{"coin":"ETH","szi":"0"}}]}'), ("u", 2, None)], "user string, t long, m string")
    assert [(r.coin, r.size, r.liquidation_px) for r in messages.latest_positions(s).collect()] == [("BTC", -2.0, None)]
    q = messages.liquidation_prints(e('{"e":"forceOrder","o":{"s":"BTC"}}', '{"topic":"allLiquidation.X","data":[{"s":"A"},{"s":"B"}]}', '{"op":"ping"}', "{}")).collect()
    assert [(r.kind, r.symbol) for r in q] == [("data", "BTC"), ("data", "A"), ("data", "B"), ("control", None), ("unrouted", None)]
    assert isinstance(pd.DataFrame(q), pd.DataFrame)


def test_loaders_clusters_limits(spark, tmp_path):
    from marketframe.operators.clusters import clusters
    from marketframe.plans import limits
    from marketframe.sources import loaders

    (tmp_path / "p.csv").write_text("date,symbol,open,high,low,close,quote_volume,trades,taker_buy_frac,minutes,rv_bps,funding_bps,funding_periods\n2024-01-01,A,1,1,1,1,5,2,,1440,,3,0\n2024-01-02,A,1,x,1,1,5,2,,1440,,3,1\n")
    got = loaders.read_panel(spark, str(tmp_path / "p.csv")).orderBy("date").collect()
    assert [(r.complete, r.funding_bps) for r in got] == [(True, None), (False, 3.0)]
    nodes = spark.createDataFrame([(1, x) for x in "abcd"] + [(2, "a")], "g int, node string")
    edges = spark.createDataFrame([(1, "c", "b"), (1, "b", "a")], "g int, a string, b string")
    assert rows(clusters(nodes, edges, ["g"])) == [(1, "a", "a"), (1, "b", "a"), (1, "c", "a"), (1, "d", "d"), (2, "a", "a")]
    one = spark.range(1).select(limits.position_size(F.lit(1000.0), F.lit(0.1), F.lit(0.001), {"cap": F.lit(50.0)}).alias("s")).first().s
    assert (round(one.size, 6), one.bound) == (25.0, "kelly")
    t = spark.createDataFrame([(1, i, i, float(p)) for i, p in enumerate([-1, -1, 2, -1, -1, -1])], "k int, ts_ms long, n long, pnl double")
    assert limits.loss_streaks(t, ["k"]).first()[:] == (1, 3, -3.0)


def test_symbol_clusters_of_every_year(spark):
    from marketframe.plans.panel import correlations

    r = [((k * 37 + y * 11) % 101 - 50, (k * 53) % 97 - 48) for y in range(2) for k in range(30)]
    panel = [(y, s, y * 52 + k, float(v)) for y in range(2) for k in range(30) for s, v in zip("abc", (r[y * 30 + k][0], r[y * 30 + k][0] + 1, r[y * 30 + k][1]), strict=True)]
    df = spark.createDataFrame(panel, "year int, symbol string, date_idx long, ret double")
    got = {(x.year, x.a, x.b): x["corr"] for x in correlations(df, by=["year"]).collect()}
    for y in range(2):
        one = {(y, x.a, x.b): x["corr"] for x in correlations(df.where(f"year = {y}")).collect()}
        assert one and all(abs(got[k] - v) < 1e-9 for k, v in one.items())
    assert {k[0] for k in got} == {0, 1}


def test_clusters_of_a_long_chain(spark):
    from marketframe.operators.clusters import clusters

    nodes = spark.createDataFrame([(1, k) for k in range(40)], "g int, node int")
    edges = spark.createDataFrame([(1, k, k + 1) for k in range(39)], "g int, a int, b int")
    assert {x.cluster for x in clusters(nodes, edges, ["g"]).collect()} == {0}


def test_a_snapshot_ends_the_levels_before_it(spark):
    rows = [("A", 1, 100, 1, "bid", 10.0, 5.0), ("A", 1, 100, 1, "ask", 11.0, 5.0), ("A", 2, 200, 2, "bid", 9.0, 4.0), ("A", 2, 200, 2, "ask", 9.5, 4.0)]
    changes = spark.createDataFrame(rows, "instrument string, epoch long, ts_ms long, n long, side string, price double, size double")
    levels = book.level_validity(changes, ["instrument"], "epoch")
    at = lambda t: {(r.side, x.price) for r in book.book_at(levels, ["instrument"], F.lit(t), 5).collect() for x in r.levels}
    assert at(150) == {("bid", 10.0), ("ask", 11.0)} and at(250) == {("bid", 9.0), ("ask", 9.5)}


def test_many_members_are_read_about_once():
    import gzip

    from marketframe.sources import archive

    one = [gzip.compress(f"line {i}\n".encode()) for i in range(20_000)]
    rows = list(archive.recover(b"".join(one[:10_000]) + one[10_000][:-6] + b"".join(one[10_001:])))
    lines = [r[1] for r in rows if r[1] is not None]
    assert lines[:10_000] == [f"line {i}" for i in range(10_000)] and lines[-1] == "line 19999" and {r[2] for r in rows if r[2]} == {"torn"}
