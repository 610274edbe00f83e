"""What large tables need: shuffles that go, parts that agree, bounded pairs."""

import gzip
import itertools
import math
import random
import tracemalloc
from hashlib import md5
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketframe.operators import features
from marketframe.operators.saved import saved
from marketframe.plans import audits
from marketframe.plans import contracts as C
from marketframe.sources import archive
from marketframe.streaming import feeds, live

DAY = 86_400_000


def shuffles(spark) -> int:
    """Bytes of the shuffle files that this session has on disk."""
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return sum(p.stat().st_size for d in blocks.localDirsString() for p in Path(d).rglob("shuffle_*"))


def test_saved_leaves_no_shuffle_files(spark):
    before = shuffles(spark)
    made = saved(spark.range(20_000).repartition(5, "id").groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s")))
    assert shuffles(spark) <= before
    assert made.agg(F.sum("s")).first()[0] == sum(range(20_000))
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


@pytest.mark.parametrize("how", [{"long": 40}, {"states": 0}, {"long": 0, "states": 0}])
def test_order_state_however_markets_and_accounts_are_cut(spark, how):
    r = random.Random(11)
    market = lambda: ("ab"[r.random() < 0.3], "m0" if r.random() < 0.6 else f"m{r.randint(1, 9)}")
    fills = [(*market(), r.randint(0, 30) * DAY // 4, n, r.choice(["buy", "sell"]), r.randint(1, 99) / 100, r.randint(1, 9), 0.01) for n in range(300)]
    orders = [(*market(), n, r.randint(0, 33) * DAY // 4, r.choice([None, r.randint(33, 40) * DAY // 4])) for n in range(200)]
    f = spark.createDataFrame(fills, "account string, market_id string, ts_ms long, n long, side string, price double, size long, fee double")
    o = spark.createDataFrame(orders, "account string, market_id string, order_id long, ts_ms long, done_ms long")
    names = ["order_id", "held", "cost", "open_orders", "at_risk", "today", "losses"]
    a, b = ({x.order_id: x for x in audits.order_state(o, f, 1.0, **k).select(*names).collect()} for k in ({}, how))
    assert len(a) == len(orders) and a.keys() == b.keys()
    for n, x in a.items():
        assert list(x) == pytest.approx(list(b[n]), abs=1e-9)
    for account, m, n, ts, _ in orders:
        assert a[n].held == sum(q if s == "buy" else -q for x, y, t, _, s, _, q, _ in fills if (x, y) == (account, m) and t < ts)


@pytest.mark.parametrize("wide", [False, True])
def test_label_controls_in_turns_and_parts(spark, monkeypatch, wide):
    """Few draws a turn, many parts and blocks, and trades without a label: as all labels sorted at once."""
    monkeypatch.setattr(C, "DRAWS", 700)
    monkeypatch.setattr(C, "DRAWN", 64)
    monkeypatch.setattr(C, "PLACES", 32)
    r = random.Random(3)
    rows = [(i * 7, r.choice(["YES", "NO"]), 0.4 + i % 5 / 10, 10, r.choice([True, False, False, None]), 0.01 * (i % 7)) for i in range(300)]
    trades = spark.createDataFrame(rows, "row_id long, outcome string, price double, size int, resolved_yes boolean, fee double").repartition(3)
    got = {x.seed: x.net for x in C.label_controls(trades, 5, wide).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5]
    for seed, net in got.items():
        dealt = [x[4] for x in sorted(rows, key=lambda x: md5(f"{seed}|{x[0]}".encode()).hexdigest())]
        assert net == pytest.approx(sum((size if label is not None and (out == "YES") == label else 0) - price * size - fee for (_, out, price, size, _, fee), label in zip(rows, dealt, strict=True)), abs=1e-9)


def test_draws_that_share_their_first_bits_are_told_apart():
    """Digests whose first 64 bits are all the same: the rest decides, and a seed with such draws is dealt again by all of them."""
    class Half:
        def __init__(self, x):
            self.x = x

        def digest(self):
            return b"\0" * 8 + md5(self.x).digest()[8:]

    rows = [(i, i % 3 == 0, i % 3 != 0) for i in range(40)]
    made = list(C.drawn_pieces([str(i).encode() for i, _, _ in rows], C.np.array([int(y) for _, y, _ in rows], C.np.uint8), 4, 0, True, Half))
    narrow = list(C.drawn_pieces([str(i).encode() for i, _, _ in rows], C.np.array([int(y) for _, y, _ in rows], C.np.uint8), 4, 0, False, Half))
    tied = [C.sorted_labels(4, 0, *([p.column(c)[0].as_py()] for c in ("draws", "labels")), wide) for (p,), wide in ((narrow, False), (made, True))]
    assert [t["tied"] for t in tied] == [True, False]
    want = [int(y) for i, y, _ in sorted(rows, key=lambda x: md5(f"4|{x[0]}".encode()).digest()[8:])]
    assert C.np.unpackbits(C.np.frombuffer(tied[1]["yes"], C.np.uint8), count=40).tolist() == want


def test_without_overlap_by_markets_and_by_stretches(spark):
    r = random.Random(5)
    rows = [("m0" if i % 2 else f"m{r.randint(1, 6)}", i, t := r.randint(0, 40) * DAY // 3, t + r.randint(1, 9) * DAY) for i in range(300)]
    table = spark.createDataFrame(rows, "market_id string, row_id long, opens long, resolves long")
    want, busy = set(), {}
    for m, i, a, b in sorted(rows, key=lambda x: (x[2], x[1])):
        if a >= busy.get(m, a):
            want.add(i)
            busy[m] = b
    for long in (0, 100, 1000):
        assert {x.row_id for x in C.without_overlap(table, ["market_id"], "opens", "resolves", "row_id", long).collect()} == want


def test_volatility_sums_no_window_by_itself(spark):
    """Frames that slide are summed anew for each row; running values aren't.  Same values as sums of each window."""
    r = random.Random(9)
    rows = sorted({(("A", "B")[r.random() < 0.3], r.randint(0, 3 * DAY // 1000) * 1000): 0 for _ in range(400)})
    rows = [(k, t, 100 + r.random()) for k, t in rows]
    h = DAY // 4
    made = features.realized_volatility(spark.createDataFrame(rows, "instrument string, ts_ms long, mid double"), h, "rv")
    assert "specifiedwindowframe(RangeFrame, -" not in made._jdf.queryExecution().toString()
    got = {(x.instrument, x.ts_ms): x.rv for x in made.collect()}
    assert len(got) == len(rows)
    for k, t, _ in rows:
        window = [(u, m) for i, u, m in rows if i == k and t - h <= u <= t]
        squares = sum(math.log(b[1] / a[1]) ** 2 for a, b in itertools.pairwise(window))
        want = 0.0 if len(window) < 3 else math.sqrt(squares / ((t - window[0][0]) / 1000)) * 1e4
        assert got[k, t] == pytest.approx(want, abs=1e-6)


def test_fill_rows_make_no_pairs(spark):
    """Against brute force: prints without a size, orders that live for very different times, and no join of orders and events."""
    r = random.Random(4)
    n, h = 1500, 10_000
    prints = [("A", r.randint(0, h), i, r.randint(90, 110), r.choice([0, 1, 2, None]), False) for i in range(n)]
    touch = [("A", r.randint(0, h), n + i, r.randint(80, 95), r.randint(96, 115)) for i in range(n // 10)]
    orders = [("A", i, float(r.randint(86, 97)), r.randint(1, 30), r.randint(0, 9), t := r.randint(0, h), t + r.choice([1, 40, 900, 9000])) for i in range(60)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3)
    made = C.fill_rows(
        frame(orders, "instrument string, order_id long, price double, size long, queue long, start_ms long, end_ms long"),
        frame(prints, "instrument string, ts_ms long, n long, price long, size long, is_buy boolean"), frame(touch, "instrument string, ts_ms long, n long, bid long, ask long"), ["instrument"], 100,
    )
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
    want = set()
    for _, oid, price, size, queue, start, end in orders:
        seen = sorted([(t, k, 0, p, q) for _, t, k, p, q, _ in prints if start <= t < end and p <= price] + [(t, k, 1, a, 0) for _, t, k, _, a in touch if start <= t < end and a <= price])
        for bound in ("optimistic", "pessimistic"):
            last = best = level = 0
            volume, done = None, False
            for t, k, turn, p, q in seen:
                volume = volume if turn or q is None else (volume or 0) + q
                level += q or 0 if not turn and p == price else 0
                done |= turn == 1 or bound == "pessimistic" and p < price
                now = size if done or bound == "optimistic" and volume is None else min(size, volume if bound == "optimistic" else max(0, level - queue))
                if now > last:
                    want.add((oid, bound, t, k, float(now - last), "crossed" if turn else "cleared" if bound == "pessimistic" and p < price else "print"))
                last, best = now, max(best, now)
            if size > best:
                want.add((oid, bound, end, None, float(size - best), "expired"))
    got = [tuple(x) for x in made.collect()]
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("damage", ["none", "tail", "torn", "corrupt"])
def test_recovery_holds_pieces_and_not_all_lines(damage):
    lines = [f"{i}:" + "x" * (i % 90) for i in range(400_000)]
    one = gzip.compress("\n".join(lines).encode() + b"\n")
    content = {"none": one, "tail": one[:-8], "torn": one[:-8] + one, "corrupt": one[: len(one) // 2] + bytes(5000) + one[len(one) // 2 :]}[damage]
    tracemalloc.start()
    n, found, good = 0, [], True
    for number, line, kind, _ in archive.recover(content):
        if kind:
            found.append(kind)
        else:
            good &= line == lines[number % len(lines)] or damage == "corrupt" and number > len(lines) * 0.4  # spoilt data may be read for a while
            n += 1
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert good and found == ([] if damage == "none" else [damage])
    assert n == 2 * len(lines) if damage == "torn" else n == len(lines) if damage != "corrupt" else n > len(lines) * 0.4
    assert peak < 6e6


def test_closed_labels_join_nothing(spark, tmp_path):
    """A row meets its label among sorted mids; a join met it with every mid of its instrument."""
    for name in ("rows", "mids"):
        (tmp_path / name).mkdir()
    read = lambda name, last: spark.readStream.schema(f"ts timestamp, instrument string, {last}").parquet(f"{tmp_path}/{name}")
    made = feeds.closed_labels(read("rows", "n long"), read("mids", "mid double"), "1 hour", "6 hours", "1 hour")
    assert "Join" not in made._jdf.queryExecution().logical().toString()
    assert made.columns == ["ts", "instrument", "n", "label_ts", "later"]


def test_rows_of_a_batch_come_in_order_by_runs(monkeypatch):
    monkeypatch.setattr(live, "RUN", 70)
    monkeypatch.setattr(live, "READ", 9)
    r = random.Random(8)
    rows = [(r.randint(0, 50), r.randint(0, 20), i, [{"price": float(i)}]) for i in range(1000)]
    frames = (pd.DataFrame(rows[i : i + 30], columns=["ts_ms", "n", "i", "bids"]) for i in range(0, 1000, 30))
    assert list(live.in_order(frames, ["ts_ms", "n", "i", "bids"])) == sorted(rows, key=lambda x: x[:2])
