"""Lags, audits, spans of positions, safe leverage, prints, fee curves, weights and the sweep against plain loops and small cases."""

import gzip
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketframe.functions import fees, prices
from marketframe.operators import lags
from marketframe.plans import portfolio as B
from marketframe.sources import archive, messages, venues


def test_lag_stats_against_numpy(spark):
    rng = random.Random(3)
    rows, t = [], 0
    for n in range(400):
        t += rng.randint(0, 40)
        rows.append((rng.choice("ab"), t, n, None if rng.random() < 0.1 else t - rng.randint(0, 300)))
    df = spark.createDataFrame(rows, "conn string, t long, n long, stamp long")
    got = {r["conn"]: r for r in lags.stats(lags.split(df, ["conn"], "t", ["t", "n"], "stamp"), ["conn"], 150).collect()}
    for conn in "ab":
        lag, venue, after, fresh = [], [], [], None
        for _, at, _, stamp in (r for r in rows if r[0] == conn):
            if stamp is None:
                continue
            fresh = stamp if fresh is None else max(fresh, stamp)
            lag.append(at - stamp)
            venue.append(fresh - stamp)
            after.append(at - fresh)
        r = got[conn]
        assert (r.n, r.most, r.least) == (len(lag), max(lag), min(lag))
        assert np.allclose([r.p50, r.p90, r.p99], np.percentile(lag, [50, 90, 99])) and r.late == pytest.approx(np.mean(np.array(lag) > 150))
        assert np.allclose([r.venue_p90, r.after_p90], [np.percentile(venue, 90), np.percentile(after, 90)])


def test_lags_of_nothing_and_of_messages_without_stamps(spark):
    schema = "conn string, t long, n long, stamp long"
    empty = lags.split(spark.createDataFrame([], schema), ["conn"], "t", ["t", "n"], "stamp")
    assert lags.stats(empty, ["conn"], 1).collect() == [] and lags.combined(lags.stats(empty, ["conn"], 1), ["conn"]).collect() == []
    bare = lags.split(spark.createDataFrame([("a", 1500, 1, None), ("a", 1700, 2, None), ("a", 2100, 3, 2000)], schema), ["conn"], "t", ["t", "n"], "stamp")
    assert [(r.second, r.messages, r.most) for r in lags.by_second(bare, ["conn"], "t").orderBy("second").collect()] == [(1, 2, None), (2, 1, 100)]
    assert lags.stats(bare, ["conn"], 1).first().n == 1


def test_days_combine_counts_exactly_and_quantiles_by_weight(spark):
    parts = spark.createDataFrame([("a", 1, 10.0, 20.0, 30.0, 30, 1, 0.0, 5.0, 6.0), ("a", 3, 50.0, 60.0, 70.0, 90, 2, 1.0, 1.0, 2.0)], "conn string, n long, p50 double, p90 double, p99 double, most long, least long, late double, venue_p90 double, after_p90 double")
    r = lags.combined(parts, ["conn"]).first()
    assert (r.n, r.most, r.least, r.p50, r.p90, r.p99, r.late, r.venue_p90, r.after_p90) == (4, 90, 1, 40.0, 50.0, 60.0, 0.75, 2.0, 3.0)


def test_an_audit_counts_what_a_strict_reader_lacks(spark, tmp_path):
    folder = tmp_path / "BTC" / "raw" / "2024-01-01"
    folder.mkdir(parents=True)
    part = lambda a, b: gzip.compress("".join(json.dumps({"t": i, "n": i, "m": "x"}) + "\n" for i in range(a, b)).encode())
    (folder / "books-00.jsonl.gz").write_bytes(part(0, 5) + part(5, 9))
    (folder / "books-01.jsonl.gz").write_bytes(part(0, 5) + b"junk" + part(5, 9))
    (folder / "books-02.jsonl.gz").write_bytes(part(0, 5) + b"junk" + part(5, 9) + b"more" + part(9, 20)[:-4])
    a = archive.audit(archive.read_torn(spark, str(tmp_path)))
    got = {r.path[-11:-9]: (r.verdict, r.records, r.strict, r.recovered) for r in a.collect()}
    assert got == {"00": ("clean", 9, 9, 0), "01": ("damaged", 9, 5, 4), "02": ("damaged", 20, 5, 15)}
    assert {(r.verdict, r.files, r.records, r.recovered, r.short) for r in archive.audit_totals(a).collect()} == {("clean", 1, 9, 0, 0), ("damaged", 2, 29, 19, 2)}


def state(**sizes):
    return json.dumps({"assetPositions": [{"position": {"coin": c, "szi": str(s)}} for c, s in sizes.items()]})


def test_spans_of_positions(spark):
    rows = [("u", 0, None), ("u", 1, state(A=1, B=2)), ("u", 2, None), ("u", 3, state(A=1, B=3)), ("u", 4, state(B=3)), ("u", 5, state(A=1, B=3)), ("u", 6, None), ("v", 1, None), ("w", 1, state(A=2)), ("w", 2, state())]
    got = messages.position_history(spark.createDataFrame(rows, "user string, t long, m string")).collect()
    assert {(r.user, r.coin, r.size, r.opened_ms, r.confirmed_ms, r.closed_ms, r.states) for r in got} == {
        ("u", "A", 1.0, 1, 3, 4, 2), ("u", "A", 1.0, 5, 6, None, 1), ("u", "B", 2.0, 1, 2, 3, 1), ("u", "B", 3.0, 3, 6, None, 3), ("w", "A", 2.0, 1, 1, 2, 1),
    }
    assert messages.position_history(spark.createDataFrame([], "user string, t long, m string")).collect() == []


def test_safe_leverage_is_the_inverse_of_the_liquidation_price(spark):
    rows = [(side, b, m) for side in ("long", "short") for b in (0.01, 0.05, 0.3, 0.9) for m in (0.0, 0.005, 0.05)]
    df = spark.createDataFrame(rows, "side string, buffer double, mmr double").withColumn("l", prices.safe_leverage(F.col("side"), F.col("buffer"), F.col("mmr")))
    zero = F.lit(0.0)
    liq = prices.liquidation_price(F.col("side"), F.lit(100.0), F.lit(1.0), F.col("l"), F.col("mmr"), zero, zero)
    for r in df.where("l > 0").withColumn("liq", liq).collect():
        want = 100 * (1 - r.buffer) if r.side == "long" else 100 * (1 + r.buffer)
        assert r.liq is not None and abs(r.liq - want) < 1e-9
    odd = spark.createDataFrame([("long", 0.0), ("long", 1.0), ("short", -0.1), ("short", None)], "side string, buffer double")
    assert [r.l for r in odd.select(prices.safe_leverage(F.col("side"), F.col("buffer"), F.lit(0.005)).alias("l")).collect()] == [0.0] * 4


def test_a_model_against_the_reported_price(spark):
    rows = [(100.0, 100.9), (100.0, 102.0), (None, 100.0), (100.0, 0.0), (100.0, None)]
    got = spark.createDataFrame(rows, "e double, r double").select(prices.against_reported(F.col("e"), F.col("r")).alias("c")).select("c.*").collect()
    assert [(r.ok, r.reason) for r in got] == [(True, ""), (False, "disagrees with the venue"), *[(False, "missing or invalid")] * 3]


def test_prints_that_came_twice(spark):
    m = lambda **k: json.dumps({"transaction_hash": "h", "asset_id": "a", "price": "0.5", "size": "3", "side": "BUY", "timestamp": "9", **k})
    rows = [(5, 1, m(), "x"), (3, 2, m(extra=1), "y"), (4, 3, m(size="4"), "z"), (1, 4, "{}", "p"), (2, 5, None, "q")]
    got = venues.distinct_prints(spark.createDataFrame(rows, "t long, n long, m string, copies_of string")).collect()
    assert {(r.n, r.copies_of, r.copies) for r in got} == {(2, "y", 2), (3, "z", 1), (4, "p", 2)}


def test_curves_that_are_wrong(spark):
    table = spark.createDataFrame([("v", "neg", "-0.01", "0.02", False, None), ("v", "fine", "0.01", "0.03", False, None)], fees.CURVE_SCHEMA)
    table = table.withColumn("maker", F.col("maker").cast("decimal(9,6)")).withColumn("taker", F.col("taker").cast("decimal(9,6)"))
    assert [(r.tier, r.problem) for r in fees.curve_violations(table).collect()] == [("neg", "negative")]
    skewed = lambda c, p, size, up: (c * p * (1 - p) * (1 - p) * size).cast("decimal(28,8)")
    got = {r.problem for r in fees.curve_violations(table.where("tier = 'fine'"), skewed).collect()}
    assert got == {"not symmetric", "peak not at a half"}


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(8)
    rows = [(f"s{k}", date, rng.random(), rng.random() > 0.1, 0.0, 0.0, None if rng.random() < 0.1 else rng.gauss(0, 50), 1000.0 * (k + 1), rng.random() + 0.01, f"c{k % 3}") for date in (10, 14, 18) for k in range(12)]
    return rows, spark.createDataFrame(rows, "symbol string, date_idx long, score double, eligible boolean, price_leg double, funding_leg double, ret double, median_volume double, risk double, cluster string")


@pytest.mark.parametrize("cluster", [None, "cluster"])
def test_weights_by_risk_and_cluster(scored, cluster):
    rows, df = scored
    booked = B.books(df, 0.3)
    got = {(r.date_idx, r.symbol): r.weight for r in B.weigh(booked, B.raw_weights(booked, "risk", cluster)).collect()}
    for date in (10, 14, 18):
        names = sorted((r for r in rows if r[1] == date and r[3]), key=lambda r: (r[2], r[0]))
        k = min(max(1, round(len(names) * 0.3)), len(names) // 2)
        for sign, side in ((-1, names[:k]), (1, names[-k:])):
            live = [r for r in side if r[6] is not None]
            raw = {r[0]: 1 / r[8] / (sum(x[9] == r[9] for x in live) if cluster else 1) for r in live}
            for name, x in raw.items():
                assert got[date, name] == pytest.approx(sign * x / sum(raw.values()))


def test_the_sweep_gives_what_each_run_gives_alone(scored):
    df = scored[1]
    grid = {(r["hold"], r.frac, r.volume, r.cost): r for r in B.sweep({4: df}, (0.2, 0.3), (0.0, 10.0), (0.0, 4000.0)).collect()}
    for (hold, frac, volume, cost), r in grid.items():
        alone = B.summary(B.periods(B.weigh(B.books(df.where(F.col("median_volume") >= volume), frac)), hold, cost), hold).first()
        assert all(r[c] == pytest.approx(alone[c]) for c in ("n", "mean", "sd", "turnover", "sharpe", "annual_pct")), (frac, volume)
    assert len(grid) == 8


def test_controls_of_several_factors_are_those_of_each(spark, scored):
    df = scored[1].withColumn("factor", F.explode(F.array(F.lit("a"), F.lit("b")))).withColumn("score", F.when(F.col("factor") == "a", F.col("score")).otherwise(-F.col("score")))
    both = {(r.factor, r.seed, r.date_idx, r.symbol): r.score for r in B.shuffled(df, 3, spec=["factor"]).collect()}
    alone = {("a", r.seed, r.date_idx, r.symbol): r.score for r in B.shuffled(df.where("factor = 'a'").drop("factor"), 3).collect()}
    assert {k: v for k, v in both.items() if k[0] == "a"} == alone
    real = spark.createDataFrame([("a", 2.0), ("b", 0.0), ("c", 1.0)], "factor string, mean double")
    controls = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 3.0), ("b", 1, 1.0)], "factor string, seed int, mean double")
    assert {(r.factor, r.beaten) for r in B.share_beaten(real, controls, ["factor"]).collect()} == {("a", 0.5), ("b", 0.0), ("c", None)}


def test_appends_that_are_repeated(spark, tmp_path):
    schema, root = "market_id long, offset_s int, p double", str(tmp_path / "rows")
    assert archive.read_rows(spark, root, schema).collect() == []
    rows = spark.createDataFrame([(1, 5, 0.1, "x"), (1, 6, 0.2, "y"), (1, 6, 0.2, "y")], "market_id long, offset_s int, p double, extra string")
    for _ in range(2):
        archive.append_rows(rows, root, schema, ["market_id", "offset_s"])
    archive.append_rows(spark.createDataFrame([(1, 6, 9.0), (2, 6, None)], schema), root, schema, ["market_id", "offset_s"])
    assert {tuple(r) for r in archive.read_rows(spark, root, schema).collect()} == {(1, 5, 0.1), (1, 6, 0.2), (2, 6, None)}
    assert archive.read_rows(spark, root, schema).count() == 3


def test_messages_of_batches_come_one_by_one(spark):
    rows = [(1, '[{"a": 1.10,  "event_type":"book"},{"b":[1, 2]}]'), (2, '{"event_type" : "Trade2"}'), (3, "[]"), (4, "[broken"), (5, None)]
    got = messages.single_frames(spark.createDataFrame(rows, "t int, m string")).withColumn("tag", messages.event_type(F.col("m"))).collect()
    assert [(r.t, r.nth, r.m, r.tag) for r in sorted(got, key=lambda r: (r.t, r.nth))] == [
        (1, 0, '{"a":1.1,"event_type":"book"}', "book"), (1, 1, '{"b":[1,2]}', "unknown"), (2, 0, '{"event_type" : "Trade2"}', "Trade2"), (4, 0, "[broken", "unknown"), (5, 0, None, "unknown"),
    ]


def test_temporary_tables_go_with_their_block(spark):
    from pathlib import Path

    from marketframe.operators.saved import saved, shared_folder, temporary

    tables = lambda: {p.name for p in Path(shared_folder(spark).removeprefix("file:")).glob("table-*")}
    before = tables()
    with pytest.raises(ValueError), temporary(spark):
        saved(spark.range(3))
        with temporary(spark):
            assert saved(spark.range(5)).count() == 5 and len(tables() - before) == 2
        assert len(tables() - before) == 1
        raise ValueError
    assert tables() == before
