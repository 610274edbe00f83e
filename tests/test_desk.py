"""Fills one by one, costs, audits, models of instruments, files and closing labels against plain loops."""

import gzip
import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketframe.operators.costs import running_cost
from marketframe.operators.timeseries import spearman
from marketframe.plans import audits, signal
from marketframe.plans import contracts as C
from marketframe.sources import archive, loaders
from marketframe.streaming import feeds

DAY, HOUR = 86_400_000, 3_600_000


def test_fills_one_by_one_are_the_loop(spark):
    r = random.Random(1)
    orders = [(f"m{i % 3}", i, r.randint(95, 105), r.randint(1, 20), r.choice([0, 0, 3, 8]), (s := r.randint(0, 9000)), s + r.randint(1, 2500)) for i in range(1000)]
    prints = [(f"m{r.randint(0, 2)}", t, n, r.randint(94, 106), r.randint(1, 9), r.random() < 0.4) for n, t in enumerate(sorted(r.randint(0, 12_000) for _ in range(900)))]
    touch = [(f"m{r.randint(0, 2)}", t, 10_000 + n, r.randint(90, 100), r.choice([None, *range(101, 112)])) for n, t in enumerate(sorted(r.randint(0, 12_000) for _ in range(600)))]
    want = []
    for name, oid, price, size, queue, start, end in orders:
        events = sorted([(t, n, 0, p, q) for m, t, n, p, q, buy in prints if m == name and not buy and start <= t < end] + [(t, n, 1, ask, 0) for m, t, n, _, ask in touch if m == name and ask is not None and start <= t < end])
        for bound in ("optimistic", "pessimistic"):
            left, ahead = size, queue
            for t, n, turn, p, q in events:
                got, cause = 0, "print"
                if left == 0:
                    break
                if turn == 1:
                    got, cause = (left, "crossed") if p <= price else (0, "")
                elif p <= price:
                    if bound == "optimistic":
                        got = min(left, q)
                    elif p < price:
                        got, cause = left, "cleared"
                    else:
                        got = min(left, max(0, q - ahead))
                        ahead = max(0, ahead - q)
                if got:
                    want.append((oid, bound, t, n, float(got), cause))
                    left -= got
            if left:
                want.append((oid, bound, end, None, float(left), "expired"))
    got = C.fill_rows(
        spark.createDataFrame(orders, "instrument string, order_id long, price long, size long, queue long, start_ms long, end_ms long"), spark.createDataFrame(prints, "instrument string, ts_ms long, n long, price long, size long, is_buy boolean"),
        spark.createDataFrame(touch, "instrument string, ts_ms long, n long, bid long, ask long"), ["instrument"], 1000,
    ).collect()
    assert sorted(map(str, (tuple(x) for x in got))) == sorted(map(str, want))
    assert {x[5] for x in want} == {"print", "crossed", "cleared", "expired"}


def ledger(seed, rows=600):
    r = random.Random(seed)
    return [(r.choice("ab"), f"m{r.choice([0, 0, 0, 1])}", r.randint(0, 40) * DAY + r.randint(0, 5), n, r.choice(["buy", "sell"]), float(r.randint(1, 99)), float(r.randint(1, 20)), r.choice([0.0, 1.0])) for n in range(rows)]


LEDGER = "account string, market_id string, ts_ms long, n long, side string, price double, size double, fee double"


def walked(rows):
    """n -> (held, cost, held after, cost after, gain), market by market."""
    state, out = {}, {}
    for account, market, _, n, side, price, size, fee in sorted(rows, key=lambda x: (x[2], x[3])):
        h, a = state.get((account, market), (0.0, 0.0))
        q = size if side == "buy" else -size
        after, gain, cost = h + q, -fee, a
        if h == 0 or (h > 0) == (q > 0):
            cost = (a * abs(h) + price * abs(q)) / abs(after)
        else:
            gain += (price - a) * min(abs(h), abs(q)) * (1 if h > 0 else -1)
            cost = 0.0 if after == 0 else price if abs(q) > abs(h) else a
        out[n] = (h, a, after, cost, gain)
        state[account, market] = (after, cost)
    return out


@pytest.mark.parametrize("bucket", [2 * DAY, 400 * DAY])
def test_costs_of_one_market_over_many_buckets(spark, bucket):
    rows = ledger(3)
    got = running_cost(spark.createDataFrame(rows, LEDGER).repartition(3), ["account", "market_id"], bucket).collect()
    want = walked(rows)
    assert len(got) == len(rows)
    for x in got:
        assert (x.held, x.cost_before, x.held_after, x.cost_after, x.gain) == pytest.approx(want[x.n], rel=1e-9, abs=1e-9)


def test_account_state_and_reduce_only(spark):
    rows = ledger(5)
    r = random.Random(2)
    orders = [(r.choice("ab"), f"m{r.randint(0, 1)}", i, r.randint(0, 42) * DAY + 3, None if r.random() < 0.3 else r.randint(0, 45) * DAY, r.choice(["buy", "sell"]), r.choice([0.4, 0.7, 1.2]), float(r.choice([0, 1, 9, 40])), 50 * DAY, r.random() < 0.3, r.random() < 0.1) for i in range(200)]
    orders = [(*o[:4], None if o[4] is not None and o[4] < o[3] else o[4], *o[5:]) for o in orders]
    fills = [(a, m, t, n, s, p / 100, q, f / 100) for a, m, t, n, s, p, q, f in rows]
    limits = {"window_s": 60.0, "daily_loss": 5.0, "contracts": 50.0, "notional": 40.0, "orders": 20.0}
    schema = "account string, market_id string, order_id long, ts_ms long, done_ms long, side string, price double, size double, resolves_ms long, reduce_only boolean, halted boolean"
    got = {x.order_id: x for x in audits.contract_order_audit(spark.createDataFrame(orders, schema), spark.createDataFrame(fills, LEDGER), limits).collect()}
    made = walked(fills)
    at = {n: (a, m, t) for a, m, t, n, *_ in fills}
    assert len(got) == len(orders)
    for account, market, oid, ts, _, side, price, size, resolves, reduce_only, halted in orders:
        before = sorted((n for n in made if at[n][0] == account and at[n][2] < ts), key=lambda n: (at[n][2], n))
        last = {}
        for n in before:
            last[at[n][1]] = made[n]
        held = last.get(market, (0, 0, 0.0, 0.0, 0))[2]
        risk = sum(abs(h) * (c if h >= 0 else 1 - c) for *_, h, c, _ in last.values())
        today = sum(made[n][4] for n in before if at[n][2] // DAY == ts // DAY)
        open_ = sum(o[0] == account and o[1] == market and o[3] < ts and (o[4] is None or o[4] >= ts) for o in orders)
        x = got[oid]
        assert (x.held, x.at_risk, x.today, x.open_orders) == pytest.approx((held, risk, today, open_), abs=1e-6)
        signed = size if side == "buy" else -size
        if size <= 0:
            want = ["size not positive"]
        elif price > 1:
            want = ["price outside 0 to 1"]
        elif reduce_only:
            reduces = held != 0 and (held > 0) != (signed > 0)
            want = ["does not reduce"] if not reduces else ["would flip the position"] if size > abs(held) else []
        else:
            want = [w for w, bad in (("halted", halted), ("resolves soon", (resolves - ts) / 1000 <= 60), ("daily loss", today <= -5), ("too many contracts", abs(held + signed) > 50), ("open notional", risk + price * size > 40), ("open orders", open_ >= 20)) if bad]
        assert x.reasons == want


def test_perp_gates_each_fire(spark):
    limits = {"book_age_ms": 500, "tape_stale_s": 30, "spread_bps": 10, "leverage": 5, "order": 10, "orders": 3, "round_trip_bps": 12, "position": 20, "notional": 5000, "daily_loss": 100, "open_loss": 80, "losses": 4, "distance": 0.15, "mmr": 0.01, "fee_bps": 6.0}
    good = {"side": "buy", "price": 100.0, "size": 5.0, "leverage": 3.0, "spread_bps": 2.0, "edge_bps": 30.0, "book_age_ms": 10, "tape_stale_s": 1.0, "features_valid": True, "connected": True, "halted": False, "reduce_only": False, "held": 5.0, "cost": 100.0, "today": 0.0, "losses": 0, "open_orders": 0}
    cases = [
        ({}, []), ({"halted": True}, ["halted"]), ({"connected": False}, ["not connected"]), ({"features_valid": False}, ["features invalid"]), ({"book_age_ms": 501}, ["book too old"]), ({"tape_stale_s": 31.0}, ["tape stale"]),
        ({"price": 0.0}, ["invalid price"]), ({"size": 0.0}, ["invalid size"]), ({"leverage": 0.0}, ["invalid leverage"]), ({"spread_bps": 11.0}, ["spread"]), ({"leverage": 5.5}, ["leverage"]), ({"size": 11.0}, ["order size"]), ({"open_orders": 3}, ["open orders"]),
        ({"edge_bps": 12.0}, ["edge below cost"]), ({"held": 16.0}, ["position"]), ({"price": 600.0, "cost": 600.0}, ["notional"]), ({"today": -100.0}, ["daily loss"]), ({"cost": 120.0}, ["daily loss", "unrealised loss"]), ({"losses": 4}, ["losses in a row"]),
        ({"leverage": 5.0, "held": 0.0, "cost": 0.0, "price": 100.0, "size": 5.0}, []), ({"cost": 105.0, "leverage": 5.0, "size": 0.5}, []),
        ({"reduce_only": True}, ["wrong side"]), ({"reduce_only": True, "side": "sell"}, []), ({"reduce_only": True, "side": "sell", "size": 6.0}, ["would flip the position"]), ({"reduce_only": True, "held": 0.0}, ["nothing to reduce"]),
        ({"reduce_only": True, "side": "sell", "halted": True, "today": -900.0, "spread_bps": 99.0}, []), ({"reduce_only": True, "side": "sell", "connected": False, "price": 0.0, "size": 0.0}, ["not connected", "invalid price", "invalid size"]),
    ]
    table = spark.createDataFrame(pd.DataFrame([{**good, **c, "i": i} for i, (c, _) in enumerate(cases)]))
    got = {x.i: x for x in audits.perp_order_gates(table, limits).collect()}
    for i, (case, want) in enumerate(cases):
        assert got[i].reasons == want, case
    assert got[0].allowance == 10 and got[22].allowance == 5 and got[0].entry_after == 100


def test_models_of_instruments_are_newtons(spark):
    r = np.random.default_rng(4)
    rows = []
    for name, n in (("A", 400), ("B", 300), ("few", 40), ("flat", 300)):
        x = r.normal(size=(n, 2))
        up = r.random(n) < 1 / (1 + np.exp(-(0.4 + x @ [1.2, -0.7])))
        rows += [(name, i, "train" if i < n * 0.7 else "test", float(a), float(b), 1.0 if name == "flat" or u else -1.0) for i, ((a, b), u) in enumerate(zip(x, up, strict=True))]
    df = spark.createDataFrame(rows, "instrument string, n long, part string, a double, b double, y double").repartition(4)
    got = {m.instrument: m for m in signal.grouped_models(df, ["a", "b"], F.col("y") > 0, ["instrument"], least=50).collect()}
    assert got["few"].reason == "few training rows" and got["flat"].reason == "one class" and got["few"].weights is None
    table = pd.DataFrame(rows, columns=["i", "n", "part", "a", "b", "y"])
    for name in "AB":
        t = table[(table["i"] == name) & (table["part"] == "train")]
        x, u, w = np.column_stack([np.ones(len(t)), t["a"], t["b"]]), (t["y"] > 0).to_numpy(float), np.zeros(3)
        for _ in range(25):
            p = 1 / (1 + np.exp(-x @ w))
            w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag([0, 1, 1]), x.T @ (u - p) - np.array([0, 1, 1]) * w)
        assert got[name].weights == pytest.approx(w.tolist(), abs=1e-6)
    models = signal.grouped_models(df, ["a", "b"], F.col("y") > 0, ["instrument"], least=50)
    out = {x.instrument: x for x in signal.across(signal.model_scores(df, ["a", "b"], models, ["instrument"]), models, "y", 0.1, "instrument", ["n"]).collect()}
    assert set(out) == {"A", "B", "few", "flat"} and out["A"].auc > 0.6 and out["few"].auc is None
    verdict = signal.across_verdict(spark.createDataFrame(list(out.values()))).first()
    assert (verdict.instruments, verdict.skipped) == (2, 2) and verdict.verdict == "sign not consistent"


def test_ladder_by_key(spark):
    r = np.random.default_rng(6)
    rows = [(k, i, float(np.round(r.normal(), 1)), float(r.normal())) for k, n in (("a", 137), ("b", 20), ("c", 1)) for i in range(n)]
    got = {x.k: x for x in signal.ladder(spark.createDataFrame(rows, "k string, n long, s double, y double").repartition(3), "s", "y", ["n"], ["k"]).collect()}
    for k in "ab":
        part = sorted((x for x in rows if x[0] == k), key=lambda x: (x[2], x[1]))
        s, y = np.array([x[2] for x in part]), np.array([x[3] for x in part])
        tenths = [c.mean() for c in np.array_split(y, 10)]
        want = (len(y), y.mean(), y[s >= np.quantile(s, 0.9)].mean() - y.mean(), y.mean() - y[s <= np.quantile(s, 0.1)].mean(), np.corrcoef(range(10), tenths)[0, 1])
        assert (got[k].n, got[k].drift, got[k].long, got[k].short, got[k].monotonicity) == pytest.approx(want)
    assert got["c"].n == 1 and got["c"].monotonicity is None


def test_feature_files_are_grouped_by_header(spark, tmp_path):
    texts = {"a1": "instrument,ts,x,label_1s\nA,1,5,1\n", "a2": "instrument,ts,x,label_1s\nA,2,6,0\n", "b": "ts,instrument,label_1s,x,more\n3,B,1,7,9\n", "old": "instrument,ts,x,label_9s\nA,1,5,1\n", "none": "ts,x,label_1s\n1,2,3\n"}
    for name, text in texts.items():
        (tmp_path / f"{name}.csv").write_text(text)
    paths = [str(tmp_path / f"{n}.csv") for n in texts]
    got, skipped = loaders.feature_files(spark, paths, ["1s"])
    assert set(got.columns) == {"instrument", "ts", "x", "label_1s"}
    assert sorted((x.instrument, x.ts, x.x, x.label_1s) for x in got.collect()) == [("A", "1", "5", "1"), ("A", "2", "6", "0"), ("B", "3", "7", "1")]
    assert [p.rpartition("/")[2] for p in skipped] == ["none.csv", "old.csv"]
    with pytest.raises(ValueError, match="no file"):
        loaders.feature_files(spark, paths, ["5s"])


def test_recovery_as_a_table_function(spark):
    whole = gzip.compress("".join(f"line {i}\n" for i in range(25_000)).encode())
    files = spark.createDataFrame([("good", bytearray(whole)), ("tail", bytearray(whole[:-8])), ("empty", bytearray(b"")), ("none", None)], "name string, content binary")
    files.createOrReplaceTempView("some_files")
    archive.register_recovery(spark)
    got = spark.sql("select name, count(r.line) n, max(r.damage) damage from some_files, lateral recover_lines(content) r group by name").collect()
    assert {(x.name, x.n, x.damage) for x in got} == {("good", 25_000, None), ("tail", 25_000, "tail")}


def test_labels_close_with_the_watermark(spark, tmp_path):
    rows = [(0, "A", 1), (10, "A", 2), (10, "B", 3), (40, "A", 4)]
    mids = [(60, "A", 1.0), (70, "A", 2.0), (75, "A", 2.5), (300, "B", 9.0), (2000, "A", 3.0), (4000, "A", 3.0), (4001, "B", 3.0)]
    late = [(3000, "A", 5), (3001, "B", 6), (9000, "A", 7)]
    stamp = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    for i, part in enumerate((rows, late)):
        spark.createDataFrame([(stamp(t), k, n) for t, k, n in part], "ts timestamp, instrument string, n long").coalesce(1).write.parquet(f"{tmp_path}/rows/{i}")
    for i, part in enumerate((mids[:4], [*mids[4:], (9000, "A", 0.0)])):
        spark.createDataFrame([(stamp(t), k, m) for t, k, m in part], "ts timestamp, instrument string, mid double").coalesce(1).write.parquet(f"{tmp_path}/mids/{i}")
    read = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/{name}")
    made = feeds.closed_labels(read("rows", "ts timestamp, instrument string, n long"), read("mids", "ts timestamp, instrument string, mid double"), "60 seconds", "60 seconds", "10 seconds")
    query = made.writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(240)
    got = {x.n: x.later for x in spark.table("closed").collect()}
    # 60 s after 0 and 10 come the mids of 60 and 70; row 4 has none within its minute, 3 and 6 none at all; row 7 is open still
    assert got == {1: 1.0, 2: 2.0, 3: None, 4: None, 5: None, 6: None}


def test_counted_ranks_are_windows(spark):
    r = np.random.default_rng(9)
    rows = [(k, float(np.round(r.normal(), 1)), float(r.integers(0, 4))) for k, n in (("a", 300), ("b", 40), ("c", 2)) for _ in range(n)] + [("a", None, 1.0), ("d", 1.0, 2.0), ("d", 1.0, 3.0), ("d", 1.0, 4.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double").repartition(3)
    one, two = ({x.k: tuple(x)[1:] for x in spearman(df, "x", "y", ["k"], wide).collect()} for wide in (False, True))
    assert set(one) == set(two) == set("abcd")
    for k in one:
        assert two[k] == pytest.approx(one[k], abs=1e-12)
