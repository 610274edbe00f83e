"""Live book and live features: stateful processors whose state is read and written piece by piece.

A book's levels are entries of a map, so a batch writes the levels that changed and no
others.  A feed's history is a ring of slots of time: a batch writes the slots
that it adds to and drops those that no window reaches any more.  Both processors give
the rows of an instrument in the order of (ts_ms, n), with what had come before.
"""

from __future__ import annotations

import heapq
import pickle
import tempfile
import zlib
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from marketframe.operators.book import Side

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_map_state(spark: SparkSession) -> SparkSession:
    """Processors need the state store that keeps maps, unless the user has named one."""
    if spark.conf.get(PROVIDER, "").rpartition(".")[2] in ("", "HDFSBackedStateStoreProvider"):
        spark.conf.set(PROVIDER, ROCKS)
    return spark


#: Rows that are sorted at a time, rows of a sorted run that are read at a time, and rows that are given out at a time.
RUN, READ, GIVEN = 50_000, 500, 50_000


def in_order(frames: Iterator[pd.DataFrame], columns: Sequence[str]) -> Iterator[tuple]:
    """The rows of ``frames`` as tuples of ``columns``, which begin with ts_ms and n, in their order.  More than RUN rows are sorted in runs, which lie packed in a
    temporary file and are merged, so that a task holds a run and some rows of each, however many a batch has."""
    with tempfile.TemporaryFile() as file:
        held, count, runs = [], 0, []

        def rows() -> list[tuple]:
            table = pd.concat(held)[list(columns)].sort_values(["ts_ms", "n"], kind="stable")
            return list(zip(*(table[c] for c in columns), strict=True))

        def read(blocks: list[tuple[int, int]]) -> Iterator[tuple]:
            for at, size in blocks:
                file.seek(at)
                yield from pickle.loads(zlib.decompress(file.read(size)))

        for frame in frames:
            held.append(frame)
            count += len(frame)
            if count >= RUN:
                run, blocks = rows(), []
                for i in range(0, len(run), READ):
                    blocks.append((file.tell(), file.write(zlib.compress(pickle.dumps(run[i : i + READ]), 1))))
                runs.append(blocks)
                held, count = [], 0
        last = rows() if held else []
        yield from heapq.merge(*map(read, runs), last, key=lambda row: row[:2]) if runs else last


BOOK_OUT = "instrument string, ts_ms long, n long, bid double, ask double, crossed boolean, ready boolean"


class LiveBook(StatefulProcessor):
    """State of an instrument: a map of levels, and seq, crossed touches in a row, ready."""

    def __init__(self, patience: int):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.levels = handle.getMapState("levels", "sign int, price double", "size double")
        self.feed = handle.getValueState("feed", "seq long, crossed int, ready boolean")

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        sides = {-1: Side(-1), 1: Side(1)}
        for (sign, price), (size,) in self.levels.iterator():
            sides[sign].set(price, size)
        seq, crossed, ready = self.feed.get() if self.feed.exists() else (None, 0, False)
        changed, cleared, out = set(), False, []
        columns = ["ts_ms", "n", "action", "seq", "prev_seq", "bids", "asks"]
        names = ["instrument", "ts_ms", "n", "bid", "ask", "crossed", "ready"]
        for ts, n, action, number, before, bids, asks in in_order(rows, columns):
            if len(out) >= GIVEN:
                yield pd.DataFrame(out, columns=names)
                out = []
            number, before = (None if pd.isna(x) else int(x) for x in (number, before))
            if action == "snapshot":
                for side in sides.values():
                    side.clear()
                changed, cleared, ready, crossed, seq = set(), True, True, 0, number
            elif not ready:
                continue
            elif before is not None and before != seq:
                if number is None or seq is None or number > seq:
                    ready = False
                continue  # a gap, or a repeat
            else:
                seq = seq if number is None else number
            for sign, changes in ((-1, bids), (1, asks)):
                for level in changes if changes is not None else ():
                    price = float(level["price"])
                    sides[sign].set(price, float(level["size"]))
                    changed.add((sign, price))
            if not (sides[-1].order and sides[1].order):
                continue
            bid, ask = -sides[-1].order[0], sides[1].order[0]
            crossed = crossed + 1 if bid >= ask else 0
            if crossed >= self.patience:
                ready, crossed = False, 0
            out.append((key[0], int(ts), int(n), bid, ask, bid >= ask, ready))
        if cleared:
            self.levels.clear()
        for sign, price in changed:
            size = sides[sign].sizes.get(price)
            if size is not None:
                self.levels.updateValue((sign, price), (size,))
            elif not cleared and self.levels.containsKey((sign, price)):
                self.levels.removeKey((sign, price))
        self.feed.update((seq, crossed, ready))
        yield pd.DataFrame(out, columns=names)

    def close(self) -> None:
        pass


def live_book(messages: DataFrame, patience: int = 3) -> DataFrame:
    """The touch after every message of a feed that counts (see ``book.applied``).  A gap, or the ``patience``-th crossed touch in a
    row, makes the book unready until the next snapshot.

    ``messages``: instrument, ts_ms, n, action, seq, prev_seq, bids, asks (arrays of (price, size))."""
    with_map_state(messages.sparkSession)
    return messages.groupBy("instrument").transformWithStateInPandas(LiveBook(patience), BOOK_OUT, "append", "none")


#: What a slot of the ring keeps of a book update and of a trade.
BOOK_RING, TAPE_RING = ("ts", "mid", "ofi"), ("ts", "buy", "size", "paid")


class LiveFeatures(StatefulProcessor):
    """State of an instrument: two rings, the last usable touch, the last positive volatilities, and the last features."""

    def __init__(self, ofi: Sequence[int], tfi: Sequence[int], ret: Sequence[int], rv: Sequence[int], regime: tuple[int, int], slot_ms: int):
        self.ofi, self.tfi, self.ret, self.rv, self.regime, self.slot = tuple(ofi), tuple(tfi), tuple(ret), tuple(rv), regime, slot_ms
        self.book_names = ["mid", *[f"ofi_{h}" for h in ofi], *[f"ret_{h}" for h in ret], *[f"rv_{h}" for h in rv]]
        self.tape_names = [*[f"tfi_{h}" for h in tfi], "trade_count", "volume", "vwap", "last_price"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        kind = lambda names: ", ".join(f"{c} array<{'long' if c == 'ts' else 'double'}>" for c in names)
        self.books = handle.getMapState("books", "slot long", kind(BOOK_RING))
        self.trades = handle.getMapState("trades", "slot long", kind(TAPE_RING))
        self.touch = handle.getValueState("touch", "bid double, ask double, bid_size double, ask_size double")
        self.positive = handle.getValueState("positive", "rv array<double>, ts long, value double, regime string")
        self.last = handle.getValueState("last", "newest long, book array<double>, regime string, tape array<double>, usable boolean")

    def _read(self, ring: Any, names: Sequence[str], since: int) -> dict[str, np.ndarray]:
        slots = sorted(((slot, values) for (slot,), values in ring.iterator()), key=lambda s: s[0])
        # of the slots that end before ``since`` the newest stays: after a silence it has the last value there was
        old = sum((slot + 1) * self.slot <= since for slot, _ in slots)
        for slot, _ in slots[: max(0, old - 1)]:
            ring.removeKey((slot,))
        slots = slots[max(0, old - 1) :]
        return {c: np.concatenate([np.asarray(v[i], np.int64 if c == "ts" else float) for _, v in slots]) if slots else np.zeros(0, np.int64 if c == "ts" else float) for i, c in enumerate(names)}

    def _write(self, ring: Any, names: Sequence[str], kept: dict[str, np.ndarray], first: int) -> None:
        """Slots from the one that holds ``first`` on."""
        slots = kept["ts"] // self.slot
        for slot in np.unique(slots[slots >= first // self.slot]):
            inside = slots == slot
            ring.updateValue((int(slot),), tuple(kept[c][inside].tolist() for c in names))

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        table = pd.concat(list(rows))
        newest, book, regime, tape, usable = self.last.get() if self.last.exists() else (None, None, "unknown", None, False)
        if newest is not None:  # late rows go
            table = table[table["ts_ms"] >= newest]
        if not len(table):
            return
        turn = (table["kind"] == "book").astype(int)  # a trade comes first of equal times and numbers
        table = table.assign(turn=turn).sort_values(["ts_ms", "n", "turn"], kind="stable").reset_index(drop=True)
        good = table["kind"].eq("book") & (table["bid"] > 0) & (table["bid"] < table["ask"])
        first = int(table["ts_ms"].iloc[0])
        books = self._books(table[good], first)
        trades = self._trades(table[table["kind"] == "trade"], first)
        out = pd.DataFrame({"instrument": key[0], "ts_ms": table["ts_ms"], "n": table["n"]})
        # what is known of the book and of the tape is carried on from row to row
        state = pd.Series(np.where(table["kind"] == "book", good.astype(float), np.nan)).ffill().fillna(float(bool(usable)))
        valid = state == 1.0
        for names, made, known in ((self.book_names, books, book), (self.tape_names, trades, tape)):
            filled = made[names].reindex(table.index).ffill() if len(made) else pd.DataFrame(np.nan, table.index, names)
            if known is not None:
                filled = filled.fillna(dict(zip(names, [np.nan if x is None else x for x in known], strict=True)))
            known_now = [None if pd.isna(x) else float(x) for x in filled.iloc[-1]]
            book, tape = (known_now, tape) if names is self.book_names else (book, known_now)
            out[names] = filled.fillna(0.0).where(valid, 0.0)
        kept = books["regime"].reindex(table.index).ffill().fillna(regime) if len(books) else pd.Series(regime, table.index)
        out["vol_regime"], out["is_valid"] = kept.where(valid, "unknown"), valid
        self.last.update((int(table["ts_ms"].iloc[-1]), book, str(kept.iloc[-1]), tape, bool(valid.iloc[-1])))
        yield out[["instrument", "ts_ms", "n", *self.book_names, *self.tape_names, "vol_regime", "is_valid"]]

    def _books(self, rows: pd.DataFrame, first: int) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=[*self.book_names, "regime"])
        reach = max([*self.ofi, *self.ret, *self.rv])
        ring = self._read(self.books, BOOK_RING, int(rows["ts_ms"].iloc[0]) - reach - self.slot)
        names = ["bid", "ask", "bid_size", "ask_size"]
        b, a, qb, qa = (rows[c].to_numpy(float) for c in names)
        was = self.touch.get() if self.touch.exists() else None
        pb, pa, pqb, pqa = (np.concatenate([[was[i] if was else np.nan], x[:-1]]) for i, x in enumerate((b, a, qb, qa)))
        bid = np.select([b > pb, b == pb], [qb, qb - pqb], -pqb)
        ask = np.select([a < pa, a == pa], [-qa, -(qa - pqa)], pqa)
        ofi = np.where(np.isnan(pb), 0.0, bid + ask)
        self.touch.update(tuple(float(x[-1]) for x in (b, a, qb, qa)))
        now, mid = rows["ts_ms"].to_numpy(np.int64), (b + a) / 2
        kept = {"ts": np.concatenate([ring["ts"], now]), "mid": np.concatenate([ring["mid"], mid]), "ofi": np.concatenate([ring["ofi"], ofi])}
        here = len(ring["ts"]) + np.arange(len(now))
        out = {"mid": mid}
        flows = np.concatenate([[0.0], np.cumsum(kept["ofi"])])
        for h in self.ofi:
            out[f"ofi_{h}"] = flows[here + 1] - flows[np.searchsorted(kept["ts"], now - h)]
        for h in self.ret:
            at = np.searchsorted(kept["ts"], now - h, "right") - 1
            out[f"ret_{h}"] = np.where(at >= 0, np.log(mid / kept["mid"][np.maximum(at, 0)]) * 1e4, 0.0)
        last = np.append(np.diff(kept["ts"]) > 0, True)  # the last mid of each time
        t, m = kept["ts"][last], kept["mid"][last]
        squares = np.cumsum(np.concatenate([[0.0], np.log(m[1:] / m[:-1]) ** 2]))
        times = np.unique(now)
        at = np.searchsorted(t, times)
        rvs = {}
        for h in self.rv:
            since = np.searchsorted(t, times - h)
            enough = at - since >= 2
            seconds = np.where(enough, (times - t[since]) / 1000, 1.0)
            rvs[h] = np.where(enough, np.sqrt(np.maximum(squares[at] - squares[since], 0) / seconds) * 1e4, 0.0)
            out[f"rv_{h}"] = rvs[h][np.searchsorted(times, now)]
        out["regime"] = self._regimes(times, rvs[self.rv[-1]])[np.searchsorted(times, now)]
        self._write(self.books, BOOK_RING, kept, first)
        return pd.DataFrame(out, index=rows.index)

    def _regimes(self, times: np.ndarray, rv: np.ndarray) -> np.ndarray:
        """The regime of each time; a time that has gone on from an earlier batch counts once, with its newest value."""
        samples, least = self.regime
        window, newest, value, regime = self.positive.get() if self.positive.exists() else ([], None, 0.0, "unknown")
        window, out = list(window), []
        for ts, x in zip(times.tolist(), rv.tolist(), strict=True):
            if newest is not None and newest == ts and value > 0:
                window.pop()
            newest, value = ts, x
            if x > 0:
                window = [*window, x][-samples:]
                ranked, n = np.sort(window), len(window)
                low, high = (ranked[int(np.floor(n * q))] for q in (0.33, 0.67))
                regime = "unknown" if n < least else "low" if x <= low else "high" if x >= high else "normal"
            out.append(regime)
        self.positive.update((window, newest, value, regime))
        return np.array(out, object)

    def _trades(self, rows: pd.DataFrame, first: int) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=self.tape_names)
        ring = self._read(self.trades, TAPE_RING, int(rows["ts_ms"].iloc[0]) - max(self.tfi))
        now, size, price = rows["ts_ms"].to_numpy(np.int64), rows["size"].to_numpy(float), rows["price"].to_numpy(float)
        new = {"ts": now, "buy": np.where(rows["is_buy"].astype(bool), size, 0.0), "size": size, "paid": price * size}
        kept = {c: np.concatenate([ring[c], new[c]]) for c in TAPE_RING}
        here = len(ring["ts"]) + np.arange(len(now))
        sums = {c: np.concatenate([[0.0], np.cumsum(kept[c])]) for c in ("buy", "size", "paid")}
        out = {"last_price": price}
        for h in self.tfi:
            since = np.searchsorted(kept["ts"], now - h)
            buy, volume = (sums[c][here + 1] - sums[c][since] for c in ("buy", "size"))
            out[f"tfi_{h}"] = np.where(volume > 0, (2 * buy - volume) / np.where(volume > 0, volume, 1), 0.0)
        since = np.searchsorted(kept["ts"], now - self.tfi[0])
        out["trade_count"], out["volume"] = (here + 1 - since).astype(float), sums["size"][here + 1] - sums["size"][since]
        out["vwap"] = (sums["paid"][here + 1] - sums["paid"][since]) / np.where(out["volume"] > 0, out["volume"], np.nan)
        self._write(self.trades, TAPE_RING, kept, first)
        return pd.DataFrame(out, index=rows.index)

    def close(self) -> None:
        pass


FEED = "instrument string, ts_ms long, n long, kind string, bid double, ask double, bid_size double, ask_size double, price double, size double, is_buy boolean"


def live_snapshot(feed: DataFrame, ofi_ms: Sequence[int] = (1000, 5000), tfi_ms: Sequence[int] = (1000, 5000, 30000), ret_ms: Sequence[int] = (1000, 5000, 30000), rv_ms: Sequence[int] = (10000, 60000), regime: tuple[int, int] = (600, 60), slot_ms: int = 10_000) -> DataFrame:
    """Order flow, trade flow, returns, volatility and its regime at every book update and trade of a feed (FEED; kind: book or
    trade), as ``features.feature_snapshot`` defines them: instrument, ts_ms, n, mid, ofi_h, ret_h, rv_h, tfi_h, trade_count, volume,
    vwap, last_price, vol_regime, is_valid.  Rows older than the newest of an earlier batch are late and dropped; a
    time that goes on in the next batch is seen as far as it has come.  ``slot_ms`` is the width of the rings' slots."""
    with_map_state(feed.sparkSession)
    processor = LiveFeatures(ofi_ms, tfi_ms, ret_ms, rv_ms, regime, slot_ms)
    numbers = ", ".join(f"{c} double" for c in [*processor.book_names, *processor.tape_names])
    schema = f"instrument string, ts_ms long, n long, {numbers}, vol_regime string, is_valid boolean"
    return feed.groupBy("instrument").transformWithStateInPandas(processor, schema, "append", "none")
