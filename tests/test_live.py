"""Scans over buckets, books, thinning, regimes and live processors against plain folds and against each other."""

import json
import random
import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketframe.operators import book, features, running
from marketframe.operators import timeseries as T
from marketframe.streaming import live

HOUR, DAY = 3_600_000, 86_400_000
MESSAGE = "instrument string, ts_ms long, n long, action string, seq long, prev_seq long, bids array<struct<price:double,size:double>>, asks array<struct<price:double,size:double>>"


def feed(seed, rows=400, odd=True):
    """Messages with snapshots, gaps, repeats, resets, missing numbers, over several days."""
    r = random.Random(seed)
    out = []
    for name in ("A", "B"):
        t, seq = 0, 0
        for n in range(rows):
            t += r.choice([0, 1000, 40_000, HOUR])
            levels = lambda sign: [(100 + sign * r.randint(-1, 6) * 0.5, float(r.randint(0, 4))) for _ in range(r.randint(0, 3))]
            prev, kind, now = seq, "update", seq + r.randint(1, 3)
            x = r.random()
            if n == 3 or x < 0.03:
                kind, now, prev = "snapshot", (r.randint(0, 50) if x < 0.01 else seq + 5), None
            elif x < 0.06:
                prev, now = seq - 2, seq - r.randint(0, 2)  # a repeat
            elif x < 0.08:
                prev, now = seq + 1, seq + 2  # a gap
            elif odd and x < 0.13:
                now = max(0, seq - r.randint(1, 40))  # a reset
            elif odd and x < 0.15:
                prev = None
            elif odd and x < 0.17:
                now = None
            elif x < 0.19:
                now = seq  # nothing new
            out.append((name, t, n, kind, now, prev, levels(-1), levels(1)))
            seq = now if now is not None and (x >= 0.06 or kind == "snapshot") and not 0.06 <= x < 0.08 else seq
    return out


def folded(rows):
    """(instrument, n) -> (applied, epoch) by the rule, one row after another."""
    out = {}
    for name in {r[0] for r in rows}:
        ready, last, epoch = False, None, 0
        for _, _, n, action, seq, prev, *_ in sorted((r for r in rows if r[0] == name), key=lambda r: (r[1], r[2])):
            ok = False
            if action == "snapshot":
                ready, last, epoch, ok = True, seq, epoch + 1, True
            elif ready and (prev is None or prev == last):
                ok, last = True, last if seq is None else seq
            elif ready and not (seq is not None and last is not None and seq <= last):
                ready = False
            out[name, n] = (ok, epoch)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_applied_is_the_fold(spark, seed):
    rows = feed(seed)
    got = book.applied(spark.createDataFrame(rows, MESSAGE).repartition(3), ["instrument"]).collect()
    assert {(r.instrument, r.n): (r.applied, r.epoch) for r in got} == folded(rows)
    assert any(r[4] is not None and r[5] is not None and r[4] < r[5] for r in rows)


def test_one_instrument_is_scanned_by_many_tasks(spark):
    rows = spark.range(200_000).select(F.lit("A").alias("instrument"), (F.col("id") * 10_000).alias("ts_ms"), F.col("id").alias("n"))
    out = running.running(rows, ["instrument"], "ts_ms", ["ts_ms", "n"], {"k": ("sum", F.lit(1).cast("long"))})
    sizes = out.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert out.where("k = n + 1").count() == 200_000 and len(sizes) > 1
    assert max(r["count"] for r in sizes) < 150_000


def test_running_values(spark):
    r = np.random.default_rng(0)
    table = pd.DataFrame({"k": r.choice(["a", "b"], 300), "t": np.sort(r.integers(0, 40, 300)), "n": range(300), "v": r.choice([None, 1, 2, 5, -3], 300)})
    df = spark.createDataFrame(table.astype(object).where(table.notna(), None), "k string, t long, n long, v long").repartition(4)
    for before in (False, True):
        got = running.running(df, ["k"], "t", ["t", "n"], {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.col("v"))}, before, 7).collect()
        by = {x.n: x for x in got}
        for _, g in table.groupby("k"):
            seen = []
            for n, v in zip(g["n"], g["v"], strict=True):
                seen += [] if before or v is None else [v]
                x = by[n]
                assert (x.s, x.m, x.l) == (sum(seen), max(seen, default=None), seen[-1] if seen else None)
                seen += [v] if before and v is not None else []


def tops(rows, depth):
    """The book after each message of an epoch, from all its levels."""
    out = {}
    for name in {r[0] for r in rows}:
        sides = {-1: {}, 1: {}}
        for _, _, n, action, _, _, bids, asks in sorted((r for r in rows if r[0] == name), key=lambda r: (r[1], r[2])):
            if action == "snapshot":
                sides = {-1: {}, 1: {}}
            for sign, changes in ((-1, bids), (1, asks)):
                for p, s in changes:
                    sides[sign].pop(p, None)
                    if s > 0:
                        sides[sign][p] = s
            if sides[-1] and sides[1]:
                b, a = sorted(sides[-1], reverse=True)[:depth], sorted(sides[1])[:depth]
                out[name, n] = (b[0], a[0], sides[-1][b[0]], sides[1][a[0]], sum(sides[-1][p] for p in b), sum(sides[1][p] for p in a))
    return out


@pytest.mark.parametrize("bucket", [DAY, 2 * HOUR])
def test_top_of_book_begins_anew_in_each_bucket(spark, bucket):
    rows = feed(7, 500)
    df = spark.createDataFrame(rows, MESSAGE).withColumn("epoch", F.lit(1).cast("long")).repartition(3)
    got = book.top_of_book(df, ["instrument"], 2, bucket).collect()
    assert {(r.instrument, r.n): tuple(r)[4:] for r in got} == tops(rows, 2)


def test_thinning_follows_its_own_rows(spark):
    r = random.Random(1)
    rows, t = [], 0
    for n in range(3000):
        t += r.choice([0, 0, 1, 3, 8, 400]) if n % 500 else 20_000
        rows.append((r.choice("ab"), t - (5 if r.random() < 0.05 else 0), n, None))
    df = spark.createDataFrame(rows, "k string, t long, n long, _times string").repartition(4)
    want = set()
    for key in "ab":
        last = newest = None
        for k, ts, n, _ in rows:  # in order of n; times go back now and then
            if k == key:
                if newest is None or ts >= newest:
                    newest = ts
                    if last is None or ts - last >= 10:
                        want.add((k, n))
                        last = ts
    # the order of arrival is n, so the time axis has to be n's: rows out of order are those below the largest time so far
    late = running.running(df, ["k"], "n", ["n"], {"m": ("max", F.col("t"))}, before=True, bucket=100).where("m is null or t >= m").drop("m")
    got = T.thin(late, ["k"], "t", ["t", "n"], 10).collect()
    assert {(x.k, x.n) for x in got} == want and len(got) == len(want)
    assert T.thin(df.limit(0), ["k"], "t", ["t", "n"], 10).count() == 0


def test_episodes_hysteresis_over_buckets(spark):
    r = random.Random(2)
    rows = [("x", i * HOUR, i, r.choice([0, 3, 3, 3, 6])) for i in range(400)]
    got = T.episodes(spark.createDataFrame(rows, "k string, t long, n long, v int"), "v", 5, 1, ["k"], ["t", "n"], "t").collect()
    want, on, number = {}, False, 0
    for _, t, _, v in rows:
        was, on = on, v >= 5 or (on and v >= 1)
        if on:
            number += not was
            want.setdefault(number, []).append((t, v))
    assert {x.episode: (x.started, x.ended, x.peak, x.rows) for x in got} == {k: (v[0][0], v[-1][0], max(p for _, p in v), len(v)) for k, v in want.items()}


@pytest.mark.parametrize("ranked", [50, 4096])
def test_regime_by_counts(spark, monkeypatch, ranked):
    monkeypatch.setattr(features, "RANKED", ranked)
    r = np.random.default_rng(3)
    v = [float(x) for x in np.round(r.exponential(1, 700), 1)]
    df = spark.createDataFrame([("A", i * 60_000, x) for i, x in enumerate(v)], "instrument string, ts_ms long, rv double").repartition(3)
    got = {x.ts_ms: x.regime for x in features.volatility_regime(df, "rv", 80, 30).collect()}
    window, want = [], {}
    for i, x in enumerate(v):
        if x > 0:
            window = [*window, x][-80:]
            s, n = sorted(window), len(window)
            want[i * 60_000] = "unknown" if n < 30 else "low" if x <= s[int(n * 0.33)] else "high" if x >= s[int(n * 0.67)] else "normal"
    assert got == want


def streamed(spark, tmp_path, rows, schema, made):
    """All that a stream gives out over files of the rows, one file a batch."""
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    name = f"out_{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    query = made(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(240)
    return spark.table(name).collect(), query


def test_live_book_over_batches(spark, tmp_path):
    rows = feed(11, 800)
    ordered = sorted(rows, key=lambda r: (r[1], r[2]))
    cuts = [ordered[:400], ordered[400:401], ordered[401:900], ordered[900:]]
    got, query = streamed(spark, tmp_path, cuts, MESSAGE, lambda s: live.live_book(s, 2))
    want = {}
    for name in "AB":
        ready, last, crossed, sides = False, None, 0, {-1: {}, 1: {}}
        for _, _, n, action, seq, prev, bids, asks in (r for r in ordered if r[0] == name):
            if action == "snapshot":
                ready, last, crossed, sides = True, seq, 0, {-1: {}, 1: {}}
            elif not ready:
                continue
            elif prev is not None and prev != last:
                ready = seq is not None and last is not None and seq <= last
                continue
            else:
                last = last if seq is None else seq
            for sign, changes in ((-1, bids), (1, asks)):
                for p, s in changes:
                    sides[sign].pop(p, None)
                    if s > 0:
                        sides[sign][p] = s
            if sides[-1] and sides[1]:
                bid, ask = max(sides[-1]), min(sides[1])
                crossed = crossed + 1 if bid >= ask else 0
                if crossed >= 2:
                    ready, crossed = False, 0
                want[name, n] = (bid, ask, bid >= ask, ready)
    assert {(r.instrument, r.n): (r.bid, r.ask, r.crossed, r.ready) for r in got} == want and len(want) > 50
    # a batch of one message writes the levels it has changed, and no others
    operators = [json.loads(p.json)["stateOperators"][0] for p in query.recentProgress]
    assert len(operators) == 4 and operators[1]["numRowsUpdated"] + operators[1].get("numRowsRemoved", 0) <= 8, operators[1]
    assert operators[0]["numRowsTotal"] > 12


def test_live_snapshot_is_the_batch_one(spark, tmp_path):
    r = random.Random(5)
    rows, t = [], 1_700_000_000_000
    for n in range(900):
        t += r.choice([40, 200, 900, 4000]) if n % 300 else 200_000  # times differ, so that batches cut none
        name = r.choice("AB")
        if r.random() < 0.7:
            b = 100.0 + r.randint(-3, 3)
            rows.append((name, t, n, "book", b, b + r.choice([0.5, 1.0, 1.0, 0.0]), float(r.randint(1, 9)), float(r.randint(1, 9)), None, None, None))
        else:
            rows.append((name, t, n, "trade", None, None, None, None, 100.0 + r.random(), float(r.randint(1, 5)), r.random() < 0.5))
    cuts = [rows[:400], rows[400:410], rows[410:700], rows[700:]]
    got, _ = streamed(spark, tmp_path, cuts, live.FEED, lambda s: live.live_snapshot(s, regime=(40, 20)))
    df = spark.createDataFrame(rows, live.FEED)
    side = lambda p, q: F.array(F.struct(F.col(p).alias("price"), F.col(q).alias("size")))
    books = df.where("kind = 'book'").select("instrument", "n", "ts_ms", side("bid", "bid_size").alias("bids"), side("ask", "ask_size").alias("asks"))
    trades = df.where("kind = 'trade'").select("instrument", "n", "ts_ms", "price", "size", "is_buy")
    want = features.feature_snapshot(books, trades, spark.createDataFrame([], "instrument string, ts_ms long, rate double, settles_ms long"), regime=(40, 20)).collect()
    by = {(x["instrument"], x["n"]): x for x in want}
    assert len(got) == len(want) == len(rows)
    assert {x["vol_regime"] for x in got} >= {"low", "high", "unknown"}
    for x in got:
        y = by[x["instrument"], x["n"]]
        for c in x.asDict():
            if c not in ("instrument", "n", "ts_ms"):
                assert x[c] == (pytest.approx(y[c], rel=1e-9, abs=1e-7) if isinstance(y[c], float) else y[c]), (c, x["n"])
