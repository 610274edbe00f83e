"""Event contracts: label guard, decisions, non-overlapping holds, results, controls, fill bracket, ledger."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator, Sequence
from hashlib import md5
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketframe.operators.costs import running_cost
from marketframe.operators.running import running, walked
from marketframe.operators.saved import saved
from marketframe.operators.timeseries import asof_join, interval_join, prefix_total

#: Sources that show a spot price and so can't settle a contract.
SPOT_SOURCES = ("binance", "coinbase", "kraken", "spot")


def label_problems(opens: Column, resolves: Column, labelled: Column, source: Column, contract_source: Column) -> Column:
    """Why a label can't be taken, as an array; empty when it can."""
    return F.array_compact(F.array(
        F.when(labelled < resolves, "labelled before resolution"), F.when(~source.eqNullSafe(contract_source), "another source"),
        F.when(F.lower(source).isin(*SPOT_SOURCES), "spot source"), F.when(opens >= resolves, "entry after resolution"),
    ))


def taker_decision(fair: Column, bid: Column, ask: Column, fee: Column, least: float) -> Column:
    """The better side whose edge after fee is ``least`` or more; YES wins ties: struct(outcome, price, edge) or null."""
    yes, no = fair - ask - fee, (1 - fair) - (1 - bid) - fee
    return F.when((yes >= least) & (yes >= no), F.struct(F.lit("YES").alias("outcome"), ask.alias("price"), yes.alias("edge"))).when(
        no >= least, F.struct(F.lit("NO").alias("outcome"), (1 - bid).alias("price"), no.alias("edge"))
    )


def maker_decision(fair: Column, bid: Column, ask: Column, least: float | str, tick: float | str = "0.01") -> Column:
    """A resting order one tick inside the touch whose edge is ``least`` or more; YES comes first: struct(outcome, price) or null."""
    kind = "decimal(9,6)"
    step, edge = F.lit(str(tick)).cast(kind), F.lit(str(least)).cast(kind)
    buy, sell = ask - step, bid + step
    return F.when((buy > bid) & (fair - buy >= edge), F.struct(F.lit("YES").alias("outcome"), buy.cast(kind).alias("price"))).when(
        (sell < ask) & (sell - fair >= edge), F.struct(F.lit("NO").alias("outcome"), (1 - sell).cast(kind).alias("price"))
    )


#: Rows of a market from which its stretches are found by scans over buckets of time; one of fewer is walked in one go.
LONG = 1_000_000


def without_overlap(decisions: DataFrame, by: Sequence[str], opens: str, resolves: str, tie: str, long: int = LONG) -> DataFrame:
    """Greedy choice of a market's decisions: one is skipped while an earlier one runs.
    A decision that opens when all earlier ones have resolved is taken whatever went before, so a market with very many falls into
    stretches between such decisions (found by scans over buckets of time); each stretch, or market, is walked by itself."""
    by, order = list(by), [opens, tie]
    known = decisions.where(" and ".join(f"{c} is not null" for c in (*by, opens)))
    busy = saved(known.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > long).select(*by))

    def walk() -> Callable[[float, float], tuple[bool]]:
        busy = None

        def step(start: float, end: float) -> tuple[bool]:
            nonlocal busy
            free = busy is None or start >= busy
            busy = end if free else busy
            return (free,)

        return step

    taken = lambda df, keys: walked(df, keys, order, [opens, resolves], walk, {"_taken": "boolean"}).where("_taken").select(*decisions.columns)
    if busy.isEmpty():
        return taken(known, by)
    crowded = known.join(F.broadcast(busy), by, "left_semi")  # few keys, as each has many rows
    ended = running(crowded, by, opens, order, {"_ended": ("max", F.col(resolves))}, before=True)
    new = F.coalesce(F.col(opens) >= F.col("_ended"), F.lit(True)).cast("long")
    cut = running(ended.withColumn("_new", new), by, opens, order, {"_stretch": ("sum", F.col("_new"))}).drop("_ended", "_new")
    return taken(known.join(F.broadcast(busy), by, "left_anti"), by).union(taken(cut, [*by, "_stretch"]))


def results(trades: DataFrame) -> DataFrame:
    """payout, gross, net of trades (outcome, price, size, resolved_yes, fee)."""
    won = (F.col("outcome") == "YES") == F.col("resolved_yes")
    gross = F.when(won, F.col("size")).otherwise(0) - F.col("price") * F.col("size")
    return trades.withColumn("won", won).withColumn("gross", gross).withColumn("net", gross - F.col("fee"))


#: Draws that are sorted at a time, rows that a task draws for at a time, and places that are joined at a time.
DRAWS, DRAWN, PLACES = 1 << 25, 1 << 16, 1 << 16
DEALT = "seed long, part long, n long, yes binary, known binary, tied boolean"


def drawn_pieces(ids: list[bytes], labels: np.ndarray, seed: int, bits: int, wide: bool, digest: Callable[[bytes], Any] = md5) -> Iterator[pa.RecordBatch]:
    """The draws (64 bits of them, or all 128) and labels of rows under a seed, a row for each part, which a draw's first ``bits`` name."""
    head = f"{seed}|".encode()
    drawn = np.frombuffer(b"".join([digest(head + x).digest() for x in ids]), ">u8").reshape(-1, 2)[:, : 2 if wide else 1].astype(np.uint64)
    part = (drawn[:, 0] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(ids), np.int64)
    order = np.argsort(part, kind="stable")
    found, first = np.unique(part[order], return_index=True)
    cuts = [order[i:j] for i, j in itertools.pairwise([*first, len(order)])]
    yield pa.RecordBatch.from_pydict({"seed": pa.array([seed] * len(found), pa.int64()), "part": pa.array(found), "draws": pa.array([drawn[c].tobytes() for c in cuts], pa.binary()), "labels": pa.array([labels[c].tobytes() for c in cuts], pa.binary())})


def sorted_labels(seed: int, part: int, draws: list[bytes], labels: list[bytes], wide: bool) -> dict[str, Any]:
    """A row of DEALT: the labels of a part's pieces in order of their draws."""
    drawn = np.frombuffer(b"".join(draws), np.uint64).reshape(-1, 2 if wide else 1)
    order = np.lexsort(drawn.T[::-1])
    drawn, label = drawn[order], np.frombuffer(b"".join(labels), np.uint8)[order]
    tied = bool(((drawn[1:] == drawn[:-1]).all(1) & (label[1:] != label[:-1])).any())
    known = None if (label < 2).all() else np.packbits(label < 2).tobytes()
    return {"seed": seed, "part": part, "n": len(label), "yes": np.packbits(label == 1).tobytes(), "known": known, "tied": tied}


def _dealt(trades: DataFrame, seeds: Sequence[int], bits: int, wide: bool) -> DataFrame:
    """The labels of ``trades`` (row_id, label: 1, 0 or 2 for none) in the order of each seed's draws, by parts of the draw's first ``bits``, packed into bits.
    Only a draw's first 64 bits are moved; ``tied`` tells of different labels with the same, which ``wide`` (all 128) tells apart."""
    def draws(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels = [], []
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                ids += [str(x).encode() for x in batch.column("row_id").to_pylist()]
                labels.append(batch.column("label").to_numpy(zero_copy_only=False).astype(np.uint8))
            if ids and (batch is None or len(ids) >= DRAWN):
                for seed in seeds:
                    yield from drawn_pieces(ids, np.concatenate(labels), seed, bits, wide)
                ids, labels = [], []

    def sort(key: tuple, table: pa.Table) -> pa.Table:
        row = sorted_labels(key[0].as_py(), key[1].as_py(), table.column("draws").to_pylist(), table.column("labels").to_pylist(), wide)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.bool_())
        return pa.table({c: pa.array([x], k) for (c, x), k in zip(row.items(), kinds, strict=True)})

    drawn = trades.select("row_id", "label").mapInArrow(draws, "seed long, part long, draws binary, labels binary")
    return drawn.groupBy("seed", "part").applyInArrow(sort, DEALT)


def label_controls(trades: DataFrame, seeds: int, wide: bool = False) -> DataFrame:
    """seed, net: the result when labels are dealt anew over all trades.  Labels are put in one random order a seed and trades in
    another: trades by range parts, once, and labels by the first digits of their draw.  Seeds take turns, so that only some draws are on disk
    at a time; what is kept of a seed is a bit for each trade."""
    rows = trades.withColumn("label", F.when(F.col("resolved_yes"), 1).when(~F.col("resolved_yes"), 0).otherwise(2))
    for name, label in (("_yes", True), ("_no", False), ("_none", None)):  # a trade's net under each label
        rows = results(rows.withColumn("resolved_yes", F.lit(label).cast("boolean"))).withColumnRenamed("net", name)
    placed = saved(prefix_total(rows.select("row_id", "label", "_yes", "_no", "_none"), ["row_id"], F.lit(1).cast("long"), "nth"))
    total = placed.count()
    if not total:
        return trades.sparkSession.createDataFrame([], "seed int, net double")
    bits, each = (total // PLACES).bit_length(), max(1, DRAWS // total)
    turns = [range(first, min(first + each, seeds + 1)) for first in range(1, seeds + 1, each)]
    dealt = functools.reduce(DataFrame.union, [saved(_dealt(placed, turn, bits, wide)) for turn in turns])
    tied = [] if wide else [r.seed for r in dealt.where("tied").select("seed").distinct().collect()]
    if tied:
        dealt = dealt.where(~F.col("seed").isin(tied)).union(saved(_dealt(placed, tied, bits, True)))
    start = F.coalesce(F.sum("n").over(Window.partitionBy("seed").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a part
    spans = F.explode(F.sequence(F.floor(F.col("start") / PLACES), F.floor((F.col("start") + F.col("n") - 1) / PLACES)))
    pieces = dealt.withColumn("start", start).select("seed", "start", "n", "yes", "known", spans.alias("block"))

    def meet(key: tuple, rows: pa.Table, pieces: pa.Table) -> pa.Table:
        base = key[0].as_py() * PLACES
        yes, no, none = (np.zeros(PLACES) for _ in range(3))
        for name, net in (("_yes", yes), ("_no", no), ("_none", none)):
            net[rows.column("nth").to_numpy() - base] = rows.column(name).to_numpy()
        seeds, nets = [], []
        for p in pieces.to_pylist():
            first, last = max(p["start"], base), min(p["start"] + p["n"], base + PLACES)
            here, there = slice(first - base, last - base), slice(first - p["start"], last - p["start"])
            bit = lambda of: np.unpackbits(np.frombuffer(of, np.uint8), count=p["n"])[there] == 1  # noqa: E731, B023
            net = np.where(bit(p["yes"]), yes[here], no[here])
            seeds.append(p["seed"])
            nets.append(float((net if p["known"] is None else np.where(bit(p["known"]), net, none[here])).sum()))
        return pa.table({"seed": pa.array(seeds, pa.int32()), "net": pa.array(nets, pa.float64())})

    blocks = placed.select(F.floor(F.col("nth") / PLACES).alias("block"), "nth", "_yes", "_no", "_none").groupBy("block")
    return saved(blocks.cogroup(pieces.groupBy("block")).applyInArrow(meet, "seed int, net double").groupBy("seed").agg(F.sum("net").alias("net")))


def touch_at_offsets(touch: DataFrame, contracts: DataFrame, offsets_ms: Sequence[int], by: Sequence[str]) -> DataFrame:
    """The last uncrossed two-sided touch at or before each offset before a contract's resolution."""
    asked = contracts.withColumn("offset_ms", F.explode(F.array(*[F.lit(int(o)) for o in offsets_ms]))).withColumn("ts_ms", F.col("resolves_ms") - F.col("offset_ms"))
    good = touch.where((F.col("bid") > 0) & (F.col("bid") < F.col("ask"))).groupBy(*by, "ts_ms").agg(F.max_by(F.struct("bid", "ask"), "n").alias("t")).select(*by, "ts_ms", "t.bid", "t.ask", F.col("ts_ms").alias("touch_ms"))
    return asof_join(asked, good, by, "ts_ms", ["touch_ms", "bid", "ask"], bucket=86_400_000)


def label_rows(contracts: DataFrame, results: DataFrame, touch: DataFrame, offsets_ms: Sequence[int], by: Sequence[str], now_ms: int, grace_ms: int = 180_000, done: DataFrame | None = None) -> DataFrame:
    """Labelled rows: market_id, offset_ms, touch_ms, entry_ask, entry_bid, resolved_yes, labelled_ms of every contract that has
    resolved ``grace_ms`` ago or more and has a result, at each offset that had a usable touch; rows that the label guard
    refuses, and those of ``done`` (market_id, offset_ms), aren't made.

    ``contracts``: by..., market_id, opens_ms, resolves_ms, source; ``results``: market_id, resolved_yes (null: open), source."""
    due = contracts.where(F.col("resolves_ms") + grace_ms <= now_ms).alias("c").join(results.where("resolved_yes is not null").alias("r"), "market_id").select("c.*", "r.resolved_yes", F.col("r.source").alias("result_source"))
    rows = touch_at_offsets(touch, due, offsets_ms, by).where("touch_ms is not null").withColumn("labelled_ms", F.lit(now_ms).cast("long"))
    refused = label_problems(F.coalesce("opens_ms", F.col("touch_ms")), F.col("resolves_ms"), F.col("labelled_ms"), F.col("result_source"), F.col("source"))
    out = rows.where(F.size(refused) == 0).select("market_id", "offset_ms", "touch_ms", F.col("ask").alias("entry_ask"), F.col("bid").alias("entry_bid"), "resolved_yes", "labelled_ms")
    return out.join(done.select("market_id", "offset_ms"), ["market_id", "offset_ms"], "left_anti") if done is not None else out


def improves_touch(orders: DataFrame, touch: DataFrame, by: Sequence[str]) -> DataFrame:
    """``orders`` (by..., order_id, side, price, start_ms) with ``improves``: alone at its level, better than its own side's best and inside the spread, when it is placed."""
    at = touch.groupBy(*by, "ts_ms").agg(F.max_by(F.struct("bid", "ask"), "n").alias("t")).select(*by, "ts_ms", F.col("t.bid").alias("best_bid"), F.col("t.ask").alias("best_ask"))
    seen = asof_join(orders.withColumn("ts_ms", F.col("start_ms")), at, by, "ts_ms", ["best_bid", "best_ask"], bucket=86_400_000)
    inside = F.coalesce(F.col("price") > F.col("best_bid"), F.lit(True)) & F.coalesce(F.col("price") < F.col("best_ask"), F.lit(True))
    return seen.withColumn("improves", inside).drop("ts_ms")


def fill_bracket(orders: DataFrame, prints: DataFrame, touch: DataFrame, by: Sequence[str], bucket: int) -> DataFrame:
    """For resting bids (order_id, price, size, queue, start_ms, end_ms): the least and the most that may have been filled.

    ``optimistic``: alone at its level, so prints at or below the price fill it.
    ``pessimistic``: behind ``queue``, so only volume at its price beyond the queue does;
    a print below the price, or an ask at or below it, clears the whole order."""
    by = list(by)
    near = interval_join(prints.where(~F.col("is_buy")).select(*by, "ts_ms", F.col("price").alias("print_price"), F.col("size").alias("print_size")), orders, by, "ts_ms", "start_ms", "end_ms", bucket)
    hit = near.where(F.col("print_price") <= F.col("price")).groupBy("order_id").agg(
        F.sum("print_size").alias("volume"), F.sum(F.when(F.col("print_price") == F.col("price"), F.col("print_size")).otherwise(0)).alias("at_level"), F.max((F.col("print_price") < F.col("price")).cast("int")).alias("beyond")
    )
    asks = interval_join(touch.select(*by, "ts_ms", "ask"), orders, by, "ts_ms", "start_ms", "end_ms", bucket)
    crossed = asks.where(F.col("ask") <= F.col("price")).groupBy("order_id").agg(F.lit(1).alias("crossed"))
    all_ = orders.join(hit, "order_id", "left").join(crossed, "order_id", "left")
    whole = F.coalesce("crossed", F.lit(0)) == 1
    best = F.when(whole, F.col("size")).otherwise(F.least(F.col("size"), F.coalesce("volume", F.lit(0))))
    worst = F.when(whole | (F.coalesce("beyond", F.lit(0)) == 1), F.col("size")).otherwise(F.least(F.col("size"), F.greatest(F.lit(0), F.coalesce("at_level", F.lit(0)) - F.col("queue"))))
    cause = F.when(whole, "crossed").when(F.coalesce("beyond", F.lit(0)) == 1, "cleared").when(F.col("volume") > 0, "print")
    return all_.select("order_id", best.alias("optimistic"), worst.alias("pessimistic"), cause.alias("cause"))


def first_at_most(values: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A search for the first place from a start on whose value is a bound or less (the number of values if there is none), by minima of blocks of 2, 4, 8..."""
    tree = [np.append(values, np.inf)]
    while len(tree[-1]) > 1:
        low = tree[-1] if len(tree[-1]) % 2 == 0 else np.append(tree[-1], np.inf)
        tree.append(np.minimum(low[::2], low[1::2]))

    def find(start: np.ndarray, bound: np.ndarray) -> np.ndarray:
        at, level = np.array(start, np.int64), np.full(len(start), -1)
        for k, block in enumerate(tree):  # up: past whole blocks that have none
            open_ = np.flatnonzero((level < 0) & (at < len(values)) & ((at >> k) % 2 == 1 if k + 1 < len(tree) else True))
            hit = block[at[open_] >> k] <= bound[open_]
            level[open_[hit]] = k
            at[open_[~hit]] += 1 << k
        for k in range(len(tree) - 1, 0, -1):  # down: to the first half that has one
            here = np.flatnonzero(level == k)
            right = tree[k - 1][at[here] >> (k - 1)] > bound[here]
            at[here[right]] += 1 << (k - 1)
            level[here] = k - 1
        return np.where(level >= 0, at, len(values))

    return find


FILL = pa.schema([("bound", pa.string()), ("ts_ms", pa.int64()), ("n", pa.int64()), ("size", pa.float64()), ("cause", pa.string())])


def _fills_of(table: pa.Table) -> pa.Table:
    """``fill_rows`` of a bucket's orders (kind 2), prints (0) and touches (1)."""
    kind = table.column("kind").to_numpy()
    of = lambda k, *names: [table.column(c).take(pa.array(np.flatnonzero(kind == k))).to_numpy().astype(np.int64 if c in ("ts_ms", "n", "end_ms") else float) for c in names]
    (pt, pn, pp, ps), (tt, tn, ask) = of(0, "ts_ms", "n", "price", "size"), of(1, "ts_ms", "n", "price")
    ids = table.column("order_id").take(pa.array(np.flatnonzero(kind == 2)))
    start, end, price, size, queue = of(2, "ts_ms", "end_ms", "price", "size", "queue")
    price = np.where(np.isnan(price), -np.inf, price)
    order = np.lexsort((np.repeat([0, 1], [len(pt), len(tt)]), np.append(pn, tn), np.append(pt, tt)))  # by time and number, a print first
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    p, t = np.argsort(rank[: len(pt)]), np.argsort(rank[len(pt) :])
    prank, trank = rank[: len(pt)][p], rank[len(pt) :][t]
    pt, pn, pp, ps, tt, tn, ask = pt[p], pn[p], pp[p], ps[p], tt[t], tn[t], ask[t]
    cross = first_at_most(np.where(np.isnan(ask), np.inf, ask))(np.searchsorted(tt, start), price)
    crossed = np.append(tt, np.iinfo(np.int64).max)[cross] < end
    limit = np.searchsorted(pt, end)  # prints before the end, and up to the first cross
    limit[crossed] = np.minimum(limit[crossed], np.searchsorted(prank, trank[cross[crossed]]))
    plain = bool((ps >= 0).all())  # volumes only grow, so what is full stays so
    find, out = first_at_most(np.where(np.isnan(pp), np.inf, pp)), []
    told, most = {b: np.zeros(len(start)) for b in ("optimistic", "pessimistic")}, {b: np.zeros(len(start)) for b in ("optimistic", "pessimistic")}
    volume, level, seen, beyond = np.zeros(len(start)), np.zeros(len(start)), np.zeros(len(start), bool), np.zeros(len(start), bool)

    def tell(bound: str, o: np.ndarray, now: np.ndarray, ts: np.ndarray, n: np.ndarray | None, cause: np.ndarray) -> None:
        more = now - told[bound][o]
        told[bound][o], most[bound][o] = now, np.maximum(most[bound][o], now)
        k = np.flatnonzero(more > 0)
        out.append((o[k], [bound] * len(k), ts[k], n[k] if n is not None else None, more[k], cause[k]))

    o, at = np.arange(len(start)), np.searchsorted(pt, start)
    while len(o):
        at = find(at, price[o])
        going = at < limit[o]
        o, at = o[going], at[going]
        amount, known = np.nan_to_num(ps[at]), ~np.isnan(ps[at])
        volume[o] += amount
        seen[o] |= known
        level[o] += np.where(pp[at] == price[o], amount, 0.0)
        below = pp[at] < price[o]
        beyond[o] |= below
        tell("optimistic", o, np.where(seen[o], np.minimum(size[o], volume[o]), size[o]), pt[at], pn[at], np.full(len(o), "print"))
        tell("pessimistic", o, np.where(beyond[o], size[o], np.minimum(size[o], np.maximum(0.0, level[o] - queue[o]))), pt[at], pn[at], np.where(below, "cleared", "print"))
        going = ~(plain & (told["optimistic"][o] >= size[o]) & (told["pessimistic"][o] >= size[o]))
        o, at = o[going], at[going] + 1
    o = np.flatnonzero(crossed)
    for bound in told:
        tell(bound, o, size[o], tt[cross[o]], tn[cross[o]], np.full(len(o), "crossed"))
    for bound in told:
        o = np.flatnonzero(size - most[bound] > 0)
        out.append((o, [bound] * len(o), end[o], None, (size - most[bound])[o], np.full(len(o), "expired")))
    made = [pa.Table.from_arrays([ids.take(pa.array(o)), pa.array(bound, pa.string()), pa.array(ts, pa.int64()), pa.nulls(len(o), pa.int64()) if n is None else pa.array(n, pa.int64()), pa.array(more, pa.float64()), pa.array(cause.tolist(), pa.string())], ["order_id", *FILL.names]) for o, bound, ts, n, more, cause in out]
    return pa.concat_tables(made)


def fill_rows(orders: DataFrame, prints: DataFrame, touch: DataFrame, by: Sequence[str], bucket: int) -> DataFrame:
    """The fills of resting bids (by..., order_id, price, size, queue, start_ms, end_ms) one by one: order_id, bound, ts_ms, n, size, cause.

    Bounds are those of ``fill_bracket``.  Causes: print, cleared (a print below the price; the pessimistic bound's), crossed (an ask at or
    below it), and a row ``expired`` at end_ms with what was left.  Events come in order of (ts_ms, n), a print before a touch.
    What an order has got so far is a running sum, capped by its size, and all of it from the first cross on.

    Orders lie in buckets of time by their start, with the events that they may see; those that live longer than ``bucket`` in wider ones.  Each
    goes from one print that can fill it to the next and ends with its first cross or when it is full, so no pairs are made."""
    by = list(by)
    span = F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(1))
    step = F.greatest(F.lit(0), F.ceil(F.log2(span / F.lit(bucket)))).cast("int")
    timed = orders.where("size is not null and start_ms is not null and end_ms is not null").withColumn("_step", step)
    steps = sorted(r["_step"] for r in timed.select("_step").distinct().collect())  # one for each doubling of the longest life
    reach = F.lit(bucket) * F.pow(F.lit(2), F.col("_step")).cast("long")
    at = lambda t: F.floor(t / (8 * reach))
    names = ["price", "size", "queue", "end_ms", "order_id"]
    asked = timed.select(*by, "_step", at(F.col("start_ms")).alias("_bucket"), F.lit(2).alias("kind"), F.col("start_ms").alias("ts_ms"), F.lit(None).cast("long").alias("n"), *[F.col(c).cast("double") for c in names[:3]], *names[3:])

    def events(df: DataFrame, kind: int, price: str, size: Column) -> DataFrame:
        met = df.where(" and ".join(f"{c} is not null" for c in (*by, "ts_ms"))).withColumn("_step", F.explode(F.array(*[F.lit(k) for k in steps])))
        met = met.withColumn("_bucket", F.explode(F.array_distinct(F.array(at(F.col("ts_ms") - reach), at(F.col("ts_ms"))))))
        blank = [F.lit(None).cast(orders.schema[c].dataType).alias(c) for c in names[3:]]
        return met.select(*by, "_step", "_bucket", F.lit(kind).alias("kind"), "ts_ms", F.col("n").cast("long"), F.col(price).cast("double").alias("price"), size.cast("double").alias("size"), F.lit(None).cast("double").alias("queue"), *blank)

    id_kind = orders.schema["order_id"].dataType.simpleString()
    untimed = orders.where("size > 0 and (start_ms is null or end_ms is null)").select("order_id", F.explode(F.array(F.lit("optimistic"), F.lit("pessimistic"))).alias("bound"), F.col("end_ms").alias("ts_ms"), F.lit(None).cast("long").alias("n"), F.col("size").cast("double").alias("size"), F.lit("expired").alias("cause"))
    if not steps:
        return untimed
    all_ = asked.union(events(prints.where(~F.col("is_buy")), 0, "price", F.col("size"))).union(events(touch.where("ask is not null"), 1, "ask", F.lit(0.0)))
    rows = all_.groupBy(*by, "_step", "_bucket").applyInArrow(_fills_of, f"order_id {id_kind}, bound string, ts_ms long, n long, size double, cause string")
    return rows.union(untimed)


def mirrored(orders: DataFrame, prints: DataFrame, touch: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sell orders, prints and touches as bids of the mirrored market: prices change their sign, and sides swap."""
    turned = touch.withColumn("_b", -F.col("ask")).withColumn("ask", -F.col("bid")).withColumn("bid", F.col("_b")).drop("_b")
    return orders.withColumn("price", -F.col("price")), prints.withColumn("price", -F.col("price")).withColumn("is_buy", ~F.col("is_buy")), turned


def fill_brackets(orders: DataFrame, prints: DataFrame, touch: DataFrame, by: Sequence[str], bucket: int) -> DataFrame:
    """``fill_bracket`` for orders of both sides (``side``: buy or sell): a sell order is a bid of the mirrored market."""
    bids = fill_bracket(orders.where("side = 'buy'").drop("side"), prints, touch, by, bucket)
    back = lambda df, *names: df.select(*[(-F.col(c)).alias(c) if c in names else F.col(c) for c in df.columns])
    turned = touch.withColumn("_b", -F.col("ask")).withColumn("ask", -F.col("bid")).withColumn("bid", F.col("_b")).drop("_b")
    asks = fill_bracket(back(orders.where("side = 'sell'").drop("side"), "price"), back(prints, "price").withColumn("is_buy", ~F.col("is_buy")), turned, by, bucket)
    return bids.union(asks)


def average_cost(fills: DataFrame, by: Sequence[str]) -> DataFrame:
    """position, cost (of the open position), realised of an ordered fill log; selling more than is held flips the position."""
    made = running_cost(fills, by)
    last = F.max_by(F.struct("held_after", "cost_after"), F.struct("ts_ms", "n"))
    end = made.groupBy(*by).agg(last.alias("s"), F.sum("gain").alias("realised"))
    return end.select(*by, F.col("s.held_after").alias("position"), (F.col("s.cost_after") * F.col("s.held_after")).alias("cost"), "realised")


def order_audit(orders: DataFrame, limits: dict[str, float]) -> DataFrame:
    """``orders`` (notional, position_after, open_notional, loss) with every limit each of them breaks."""
    reasons = F.array_compact(F.array(
        F.when(F.col("notional") > limits["order"], "order too large"), F.when(F.abs("position_after") > limits["position"], "position too large"),
        F.when(F.col("open_notional") > limits["open"], "too much open"), F.when(F.col("loss") > limits["loss"], "loss limit"),
    ))
    return orders.withColumn("reasons", reasons)


def reconcile(own: DataFrame, venue: DataFrame, key: Sequence[str]) -> DataFrame:
    """Counts of keys on both sides, missing at the venue, and foreign."""
    a, b = own.select(*key).distinct().withColumn("own", F.lit(1)), venue.select(*key).distinct().withColumn("venue", F.lit(1))
    both = a.join(b, list(key), "full_outer")
    kind = F.when(F.col("own").isNull(), "foreign").when(F.col("venue").isNull(), "missing").otherwise("matched")
    return both.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
