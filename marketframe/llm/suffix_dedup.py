"""Removal of repeated byte strings by suffix buckets over a cover of the corpus.

Suffixes that agree in ``LENGTH`` bytes are found without sorting, or moving, all
suffixes.  As in blockwise suffix sorting with a difference cover, a sparse set
of positions, the *cover*, is ranked first; every suffix meets a cover position
soon, and suffixes are compared by the bytes before it and the rank at it; and
buckets of suffixes are resolved apart from each other.  Two things differ, since
copies lie in many texts and tasks at any distance.  The cover is chosen by
content (the local minima of a rolling hash), so that any two copies have the
same cover positions, where a difference cover has one in common; and ranks are
names (fingerprints of two independent halves of 64 bits), as equality is asked for and not order.

1. Coarse cover: any string of LENGTH bytes holds the COARSE bytes of one of its
   positions.  They are counted over all distinct texts; a string without one
   that comes twice can't repeat, which leaves the stretches that may.
2. Fine cover, in those stretches: a suffix belongs to the first fine position
   ``EDGE`` bytes or more on, whose next ``RANKED`` bytes name its bucket.  The
   neighbouring suffixes of one position form a run.  A run whose bytes as a whole
   come twice is settled: all its suffixes repeat.
3. Buckets with a run that isn't settled: its suffixes, and those of one run of
   each settled kind in the bucket, are named one by one by their LENGTH bytes;
   names that come twice are repeats.
4. The repeats return to their texts, and the bytes they cover are taken out.

A text that occurs more than once is a repeat as a whole and is named once.

Defined cases: null and empty texts have no bytes; texts shorter than LENGTH keep
all; repeated rows are copies of each other; spans may cut characters, so what is
kept is binary; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketframe.llm.arrays import SECOND, U64, mix, pieces, powers, prefix_sums
from marketframe.llm.bitmap import array_of, has, passes
from marketframe.llm.distinct_texts import distinct_texts
from marketframe.llm.store import saved

LENGTH = 400
COARSE, FINE, STEP = 200, 16, 64
#: A fine position at least this far into a string is the same in all copies of the string.
EDGE = STEP + FINE - 1
RANKED = LENGTH - EDGE - STEP - 1
ANCHOR_BITS, TEXT_BITS = 26, 24
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def sliding(values: np.ndarray, width: int, least: np.ufunc, neutral: np.uint64) -> np.ndarray:
    """The minimum or maximum of every ``width`` consecutive values."""
    n = len(values)
    padded = np.full(-(-n // width) * width, neutral, np.uint64)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    ahead = least.accumulate(rows, axis=1).reshape(-1)
    back = least.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return least(back[: n - width + 1], ahead[width - 1 : n])


def cover(h: np.ndarray, width: int) -> np.ndarray:
    """Positions that are a minimum of some ``width`` consecutive values: every such stretch has one."""
    if len(h) < width:
        return np.zeros(0, np.int64)
    low = np.zeros(len(h) + width - 1, np.uint64)
    low[width - 1 : len(h)] = sliding(h, width, np.minimum, NONE)
    return np.flatnonzero((sliding(low, width, np.maximum, U64(0)) == h) & (h != NONE))


def grams(sums: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes at each position; NONE where they'd leave the text."""
    n = len(sums) - 1
    out = np.full(n, NONE, np.uint64)
    if n >= size:
        out[: n - size + 1] = (sums[size:] - sums[: n - size + 1]) * powers(n)[1][: n - size + 1] * U64(0x9FB21C651E98DF25)
        out ^= out >> U64(29)
        for k in range(1, min(size, n + 1)):
            ends = offsets[1:] - k
            out[ends[(ends >= offsets[:-1])]] = NONE
    return out


def _named(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts] + (ends - starts).astype(U64))


def _second(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The other half of a name, from other values of the bytes."""
    return mix(_named(prefix_sums(SECOND[data]), starts, ends))


def _coarse(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix sums, coarse cover positions of texts long enough, and their names."""
    sums = prefix_sums(data)
    at = cover(grams(sums, offsets, length // 2), length // 2)
    doc = np.searchsorted(offsets, at, "right") - 1
    at = at[offsets[doc + 1] - offsets[doc] >= length]
    return sums, at, _named(sums, at, at + length // 2)


def _anchors(texts: DataFrame, length: int) -> DataFrame:
    def of(batches):
        for batch in batches:
            for _, data, offsets in pieces(batch.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(_coarse(data, offsets, length)[2].view(np.int64))], ["anchor"])

    return texts.select("text").mapInArrow(of, "anchor long")


def _runs(texts: DataFrame, length: int, bitmap) -> DataFrame:
    """(uid, at, n, bucket, whole, second): runs of n suffixes from byte ``at`` that may repeat, their bucket, and the name of all bytes of their strings, in two independent halves."""
    ranked = length - EDGE - STEP - 1

    def of(batches):
        bits = bitmap.value
        for batch in batches:
            uid = batch.column("uid").to_numpy()
            for row, data, offsets in pieces(batch.column("text")):
                sums, at, name = _coarse(data, offsets, length)
                at = at[has(bits, name)]
                if not len(at):
                    continue
                doc = np.searchsorted(offsets, at, "right") - 1
                edge = np.zeros(len(data) + 1, np.int64)
                np.add.at(edge, np.maximum(at - length + length // 2, offsets[doc]), 1)
                np.add.at(edge, np.minimum(at, offsets[doc + 1] - length) + 1, -1)
                starts = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
                doc = np.searchsorted(offsets, starts, "right") - 1
                inside = starts + length <= offsets[doc + 1]
                starts, doc = starts[inside], doc[inside]
                if not len(starts):
                    continue
                # the fine cover, in the texts that have such stretches
                fine = cover(grams(sums, offsets, FINE), STEP)
                of_start = fine[np.searchsorted(fine, starts + EDGE)]
                new = np.ones(len(starts), bool)
                new[1:] = (np.diff(starts) != 1) | (np.diff(of_start) != 0)
                head = np.flatnonzero(new)
                n = np.diff(np.append(head, len(starts)))
                first, meets, d = starts[head], of_start[head], doc[head]
                bucket = _named(sums, meets, meets + ranked)
                whole = _named(sums, first, first + n - 1 + length)
                second = _second(data, first, first + n - 1 + length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uid[row + d]), pa.array((first - offsets[d]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(bucket.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(second.view(np.int64))],
                    ["uid", "at", "n", "bucket", "whole", "second"],
                )

    return texts.select("uid", "text").mapInArrow(of, "uid long, at int, n int, bucket long, whole long, second long")


def _suffixes(texts: DataFrame, length: int) -> DataFrame:
    """(mark, second, uid, at): the names, in two independent halves, of the suffixes of the runs in the column ``runs``."""

    def of(batches):
        for batch in batches:
            uid, runs = batch.column("uid").to_numpy(), batch.column("runs")
            for row, data, offsets in pieces(batch.column("text")):
                sums = prefix_sums(data)
                starts, owner = [], []
                for i in range(len(offsets) - 1):
                    mine = runs[row + i].values
                    at, n = mine.field("at").to_numpy(), mine.field("n").to_numpy()
                    all_ = np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    starts.append(all_ + offsets[i])
                    owner.append(np.full(len(all_), i))
                s, o = np.concatenate(starts), np.concatenate(owner)
                mark, second = _named(sums, s, s + length), _second(data, s, s + length)
                yield pa.RecordBatch.from_arrays([pa.array(mark.view(np.int64)), pa.array(second.view(np.int64)), pa.array(uid[row + o]), pa.array((s - offsets[o]).astype(np.int32))], ["mark", "second", "uid", "at"])

    return texts.select("uid", "text", "runs").mapInArrow(of, "mark long, second long, uid long, at int")


def repeated_runs(texts: DataFrame, length: int) -> DataFrame:
    """(uid, runs): stretches of starts (at, n) of repeated strings in each distinct text that has some."""
    context = texts.sparkSession.sparkContext
    shared = _anchors(texts, length).groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    runs = saved(_runs(texts, length, context.broadcast(array_of(shared, "anchor", ANCHOR_BITS))))
    # grouped tables are written before they are joined, so that the joins may split a name that very many places share
    kinds = saved(runs.groupBy("whole", "second").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("uid", "at")).alias("one")).where("k > 1").select("whole", "second", "one"))
    known = saved(runs.join(kinds, ["whole", "second"], "left").select("uid", "at", "n", "bucket", F.col("one").isNotNull().alias("settled"), F.coalesce(F.struct("uid", "at") == F.col("one"), F.lit(False)).alias("stands")))
    open_ = saved(known.groupBy("bucket").agg(F.count(F.lit(1)).alias("k"), F.min("settled").alias("all_settled")).where("k > 1 and not all_settled").select("bucket"))
    asked = saved(known.where("not settled or stands").join(open_, "bucket").groupBy("uid").agg(F.collect_list(F.struct("at", "n")).alias("runs")))
    some = texts.where(passes(array_of(asked, "uid", TEXT_BITS), F.col("uid"))).join(asked, "uid")
    marks = saved(_suffixes(some, length))
    twice = saved(marks.groupBy("mark", "second").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("mark", "second"))
    single = marks.join(twice, ["mark", "second"]).select("uid", "at", F.lit(1).alias("n"))
    return saved(known.where("settled").select("uid", "at", "n").union(single).groupBy("uid").agg(F.collect_list(F.struct("at", "n")).alias("runs")))


def _cut(texts: DataFrame, length: int) -> DataFrame:
    def of(batches):
        for batch in batches:
            out = []
            for uid, text, copies, runs in zip(*(batch.column(c) for c in ("uid", "text", "copies", "runs")), strict=True):
                body = text.as_py()
                kept, spans = body, 0
                if copies.as_py() > 1 and len(body) >= length:
                    kept, spans = b"", 1
                elif runs.is_valid:
                    edge = np.zeros(len(body) + 1, np.int32)
                    at, n = runs.values.field("at").to_numpy(), runs.values.field("n").to_numpy()
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + n - 1 + length, -1)
                    covered = np.cumsum(edge[:-1]) > 0
                    kept = np.frombuffer(body, np.uint8)[~covered].tobytes()
                    spans = int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum())
                out.append((uid.as_py(), len(body), len(body) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
                if len(out) >= 256:
                    yield _batch(out)
                    out = []
            yield _batch(out)

    return texts.select("uid", "text", "copies", "runs").mapInArrow(of, "uid long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["uid", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def deduplicate(docs: DataFrame, length: int = LENGTH, keep_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``keep_text`` the kept bytes."""
    if length < 4 * EDGE:
        raise ValueError(f"length must be {4 * EDGE} or more")
    texts, uid = distinct_texts(docs)
    runs = repeated_runs(texts, length)
    touched = passes(array_of(runs, "uid", TEXT_BITS), F.col("uid"))
    rest = texts.where(~touched | (F.col("copies") > 1)).withColumn("runs", F.lit(None).cast("array<struct<at:int,n:int>>"))
    cut = texts.where(touched & (F.col("copies") == 1)).join(runs, "uid", "left")
    columns = ["uid", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_text
    done = _cut(rest, length).select(*columns).union(_cut(cut, length).select(*columns))
    return docs.select("doc_id", uid(F.col("text")).alias("uid")).join(done, "uid").drop("uid")
