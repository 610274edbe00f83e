"""Streams give what the same code gives on the whole table."""

import duckdb
import pytest
from pyspark.sql import functions as F

from marketframe import catalog
from marketframe.streaming import feeds, live


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def source(spark, tmp_path):
    base = spark.range(400).select(
        F.timestamp_millis(F.lit(1704067200000) + F.col("id") * 1500).alias("ts"), F.concat(F.lit("U"), F.col("id") % 2).alias("instrument"), F.concat(F.lit("m"), F.floor(F.col("id") / 4) * 4 + F.col("id") % 2).alias("m"),
        (F.col("id") % 17).alias("lag"), (F.col("id") % 3 == 0).alias("is_buy"), (1 + F.col("id") % 5).alias("size"),
    )
    base.repartition(3).write.parquet(str(tmp_path / "feed"))
    schema = "ts timestamp, instrument string, m string, lag long, is_buy boolean, size long"
    return base, feeds.read_feed(spark, str(tmp_path / "feed"), schema, 10)


def test_dedupe_and_windows(spark, tmp_path):
    base, stream = source(spark, tmp_path)
    assert drain(feeds.without_copies(stream, "1 hour"), "copies").count() == base.select("instrument", "m").distinct().count()
    got = drain(feeds.lag_windows(stream, "1 minute", "0 seconds"), "lags", "complete").orderBy("start", "instrument").collect()
    assert got == feeds.lag_windows(base, "1 minute", "0 seconds").orderBy("start", "instrument").collect()
    flow = drain(feeds.flow_windows(stream, "1 minute", "30 seconds", "0 seconds"), "flow", "complete")
    assert flow.count() == feeds.flow_windows(base, "1 minute", "30 seconds", "0 seconds").count()
    assert feeds.silence_sessions(base, "10 seconds", "0 seconds").count() == 2


def test_live_book(spark, tmp_path):
    level = "array<struct<price:double,size:double>>"
    rows = [("a", 1, 1, "snapshot", 5, -1, [(10.0, 1.0)], [(11.0, 2.0)]), ("a", 2, 2, "update", 6, 5, [(10.5, 1.0)], []), ("a", 3, 3, "update", 9, 8, [(10.9, 1.0)], []), ("a", 4, 4, "snapshot", 20, -1, [(9.0, 1.0)], [(9.5, 1.0)])]
    schema = f"instrument string, ts_ms long, n long, action string, seq long, prev_seq long, bids {level}, asks {level}"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "book"))
    got = drain(live.live_book(feeds.read_feed(spark, str(tmp_path / "book"), schema, 5)), "book", "append").orderBy("n").collect()
    assert [(r.n, r.bid, r.ask) for r in got] == [(1, 10.0, 11.0), (2, 10.5, 11.0), (4, 9.0, 9.5)]


def test_live_book_gives_up_a_crossed_book(spark, tmp_path):
    level = "array<struct<price:double,size:double>>"
    rows = [("a", 1, 1, "snapshot", 1, -1, [(10.0, 1.0)], [(11.0, 2.0)])]
    rows += [("a", k, k, "update", k, k - 1, [(12.0, float(k))], []) for k in range(2, 7)]
    rows += [("a", 7, 7, "snapshot", 20, -1, [(9.0, 1.0)], [(9.5, 1.0)])]
    schema = f"instrument string, ts_ms long, n long, action string, seq long, prev_seq long, bids {level}, asks {level}"
    for k, part in enumerate((rows[:3], rows[3:])):  # the count goes on from one batch to the next
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "book" / f"part{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "book"))
    got = drain(live.live_book(stream, patience=3), "crossed_book").orderBy("n").collect()
    assert [(r.n, r.crossed, r.ready) for r in got] == [(1, False, True), (2, True, True), (3, True, True), (4, True, False), (7, False, True)]


def test_live_features_are_those_of_the_whole_table(spark, tmp_path):
    from marketframe.operators import features

    mid = 100 + F.sin(F.col("id")) * 3
    touch = spark.range(900).select(F.concat(F.lit("U"), F.col("id") % 2).alias("instrument"), (F.lit(86_399_000) + F.col("id") * 400 + F.col("id") % 7 * 10).alias("ts_ms"), F.col("id").alias("n"), (mid - 0.5).alias("bid"), (mid + 0.5).alias("ask"), mid.alias("mid"))
    for k in range(3):
        touch.where(F.floor(F.col("n") / 300) == k).select("instrument", "ts_ms", "n", "mid").coalesce(1).write.parquet(str(tmp_path / "touch" / f"part{k}"))
    stream = spark.readStream.schema("instrument string, ts_ms long, n long, mid double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "touch"))
    got = {r.n: r for r in drain(feeds.live_features(stream, [5_000, 60_000], [10_000]), "live_features").collect()}
    sizes = touch.withColumn("bid_size", F.lit(1.0)).withColumn("ask_size", F.lit(1.0))
    returns = features.past_returns(touch.select("instrument", "ts_ms", "n", "mid"), sizes, [5_000, 60_000]).collect()
    volatility = features.realized_volatility(touch.select("instrument", "ts_ms", "mid", "n"), 10_000, "rv").collect()
    assert len(got) == 900
    assert all(abs(got[r.n].ret_5000 - r.ret_5000) < 1e-6 and abs(got[r.n].ret_60000 - r.ret_60000) < 1e-6 for r in returns)
    assert all(abs(got[r.n].rv_10000 - r.rv) < 1e-6 for r in volatility)


def test_live_map_keeps_positions_and_marks(spark, tmp_path):
    first = [("position", "u1", "C", 1_000, 2.0, 90.0), ("position", "u2", "C", 1_000, -1.0, 101.0), ("mark", None, "C", 1_000, None, 100.0), ("position", "u3", "D", 1_000, 1.0, 5.0)]
    then = [("position", "u2", "C", 2_000, 0.0, None), ("mark", None, "C", 2_000, None, 95.0)]
    late = [("position", "u4", "C", 200_000, 1.0, 10.0)]
    for k, part in enumerate((first, then, late)):
        spark.createDataFrame(part, feeds.MAP_FEED).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{k}"))
    stream = spark.readStream.schema(feeds.MAP_FEED).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    feeds.live_map(stream, str(tmp_path / "out"), str(tmp_path / "state"), 60_000).trigger(availableNow=True).start().awaitTermination(120)
    lines = {(r.draw, r.coin): r for r in spark.read.json(str(tmp_path / "out" / "map")).collect()}
    assert set(lines) == {(0, "C"), (0, "D"), (1, "C"), (1, "D"), (2, "C"), (2, "D")}
    assert (lines[0, "C"].accounts, lines[0, "C"].mark_px, [(b.side, b.size, b.positions) for b in lines[0, "C"].bands]) == (2, 100.0, [("long", 2.0, 1), ("short", 1.0, 1)])
    assert (lines[1, "C"].accounts, lines[1, "C"].mark_px, len(lines[1, "C"].bands)) == (1, 95.0, 1)
    assert lines[0, "D"].no_price == 1 and lines[2, "C"].no_price == 2  # no mark, and one that is too old


def test_counters(spark, tmp_path):
    base, stream = source(spark, tmp_path)
    got = drain(feeds.feed_counters(stream.withColumn("channel", F.lit("c")), "1 minute", "0 seconds", 10), "counters", "complete")
    want = feeds.feed_counters(base.withColumn("channel", F.lit("c")), "1 minute", "0 seconds", 10)
    assert got.orderBy("start", "instrument").collect() == want.orderBy("start", "instrument").collect()


def test_throughput_listener(spark, tmp_path):
    import time

    base, stream = source(spark, tmp_path)
    listener = feeds.Throughput()
    spark.streams.addListener(listener)
    try:
        drain(feeds.lag_windows(stream, "1 minute", "0 seconds"), "watched", "complete")
        for _ in range(100):  # progress comes after the batch
            if any(c["rows"] == base.count() for c in listener.counts.values()):
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert [c["rows"] for c in listener.counts.values()] == [400] and all(c["batches"] >= 1 and c["dropped"] == 0 for c in listener.counts.values())


@pytest.mark.parametrize("name", ["stream_book", "stream_features"])
def test_times_round_as_in_sql(spark, tmp_path, name):
    """Microseconds of 400, 500 and 600, before and after 1970, every column compared to the last digit."""
    stamps = [
        ("1969-12-31 23:00:00.000400", "signup"), ("1969-12-31 23:30:00.000500", "view"), ("1969-12-31 23:45:00.000600", "view"), ("1970-01-01 00:00:00.000600", "signup"),
        ("1970-01-01 05:00:00.000500", "view"), ("1970-01-01 06:00:00.000400", "view"), ("1970-01-01 11:00:00.000499", "view"), ("1970-01-01 17:00:00.000500", "view"),
    ]
    rows = ", ".join(f"({n}, timestamp '{at}', 4, '{kind}', {n}::double, '{{\"k\": {n}}}')" for n, (at, kind) in enumerate(stamps))
    duck = duckdb.connect()
    duck.execute(f"create table events as select * from (values {rows}) v(event_id, ts, user_id, event_type, value, props)")
    duck.execute(f"copy (select * replace (event_id::bigint as event_id, user_id::bigint as user_id) from events) to '{tmp_path}/events.parquet'")
    got = catalog.queries()[name](spark, str(tmp_path)).toPandas()
    want = duck.execute(catalog.oracle_sql()[name]).df()[list(got.columns)]
    assert len(got) == len(stamps) and sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want.values.tolist()))
