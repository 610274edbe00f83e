"""Removal of repeated windows of words by recompression.

Texts are compressed in rounds that name what they see the same way everywhere:
a run of equal symbols or a pair of neighbours becomes one symbol, whose name is
a hash of the names it joins, so no round needs a dictionary.  A pair (a, b) is
joined when a's bit of the round says left and b's says right; only symbols of
at most ``cap`` words take part.  What happens to a symbol so depends on itself
and its neighbours alone, and each round leaves at most one symbol of ``cap``
words on either side of a window unsure.  The caps sum to less than half a
window: the symbol over a window's middle word is the same in all its copies.

That symbol with the words after it, as far as the window surely reaches, is the
window's *anchor*.  Rounds of Spark then
1. count the anchors of all distinct texts: one that occurs once rules out all
   windows it stands for; a bitmap of the others, of fixed size, goes to tasks;
2. fingerprint the windows of shared anchors and keep the fingerprints that come
   twice, which verifies the repeats;
3. send their starts back to the texts and take the covered words out.

A text that occurs more than once is named once; all its windows are repeats.

Fingerprints have 128 bits, of two independent hashes.  Defined cases: null, empty and word-less texts have
no windows and keep nothing; texts shorter than a window keep all words;
repeated rows are copies of each other; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketframe.llm.arrays import SECOND, U64, mix, pieces, powers, prefix_sums, spans_hash, word_spans
from marketframe.llm.bitmap import array_of, has, passes
from marketframe.llm.distinct_texts import distinct_texts
from marketframe.llm.store import saved

WINDOW = 35
#: The rounds, each with the most words of a symbol that takes part, for a window of 35.
ROUNDS = (("run", 2), ("pair", 1), ("pair", 1), ("pair", 2), ("pair", 3), ("pair", 4), ("pair", 4))
#: Bits of the bitmaps of anchors (16 MB) and of texts with repeats (2 MB), as powers of 2.
ANCHOR_BITS, TEXT_BITS = 27, 24


def rounds_for(window: int) -> tuple[tuple[str, int], ...]:
    """Rounds whose caps sum to at most (window - 1) // 2."""
    out, left = [], (window - 1) // 2
    for kind, cap in ROUNDS:
        if cap <= left:
            out.append((kind, cap))
            left -= cap
    while window > WINDOW and left >= out[-1][1]:
        out.append(("pair", out[-1][1]))
        left -= out[-1][1]
    return tuple(out)


def compress(h: np.ndarray, doc: np.ndarray, rounds: tuple[tuple[str, int], ...]) -> tuple[np.ndarray, np.ndarray]:
    """Start and length, in words, of the last round's symbols over the words ``h`` of documents ``doc``."""
    size = np.ones(len(h), np.int64)
    for r, (kind, cap) in enumerate(rounds):
        if len(h) < 2:
            break
        if kind == "run":
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            head = np.flatnonzero(new)
            times = np.diff(np.append(head, len(h)))
            joined = (times > 1) & (times * size[head] <= cap)
            inner = np.repeat(joined, times) & ~new
            at = head[joined]
            h = h.copy()
            h[at] = mix(h[at] * U64(0xD6E8FEB86659FD93) + times[joined].astype(U64))
            size[at] *= times[joined]
        else:
            right = (mix(h + U64(r + 1)) >> U64(63)).astype(bool)
            small = size <= cap
            first = ~right[:-1] & right[1:] & small[:-1] & small[1:] & (doc[:-1] == doc[1:])
            at = np.flatnonzero(first)
            inner = np.zeros(len(h), bool)
            inner[at + 1] = True
            h = h.copy()
            h[at] = mix(h[at] * U64(0xA0761D6478BD642F) + mix(h[at + 1] + U64(0xE7037ED1A0B428DB)))
            size[at] += size[at + 1]
        h, doc, size = h[~inner], doc[~inner], size[~inner]
    return np.cumsum(size) - size, size


def _symbols(data: np.ndarray, offsets: np.ndarray, window: int):
    """Words' spans and prefix sums, documents' first words, and the symbols that some window's middle lies in: start, length, anchor."""
    ws, we, first = word_spans(data, offsets)
    h = spans_hash(prefix_sums(data), ws, we)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    sums = prefix_sums(h)
    start, size = compress(h, doc, rounds_for(window))
    half = (window - 1) // 2
    gram = window - half
    d = doc[start] if len(start) else np.zeros(0, np.int64)
    use = (start + size > first[:-1][d] + half) & (start + gram <= first[1:][d]) & (np.diff(first)[d] >= window)
    start, size = start[use], size[use]
    anchor = mix(((sums[start + gram] - sums[start]) * powers(len(sums))[1][start]) + size.astype(U64))
    return (ws, we), sums, doc, first, start, size, anchor


def _mark(sums: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    return mix((sums[at + window] - sums[at]) * powers(len(sums))[1][at])


def _second(data: np.ndarray, spans: tuple[np.ndarray, np.ndarray], at: np.ndarray, window: int) -> np.ndarray:
    """The other half of a fingerprint, from other values of the bytes."""
    return mix(_mark(prefix_sums(spans_hash(prefix_sums(SECOND[data]), *spans)), at, window))


def _windows(texts: DataFrame, window: int, bitmap) -> DataFrame:
    """(mark, second, uid, at): fingerprints, of two independent halves, of the windows whose anchors are in the bitmap."""

    def of(batches):
        bits = bitmap.value
        half = (window - 1) // 2
        for batch in batches:
            uid = batch.column("uid").to_numpy()
            for row, data, offsets in pieces(batch.column("text")):
                spans, sums, doc, first, start, size, anchor = _symbols(data, offsets, window)
                good = has(bits, anchor)
                start, size = start[good], size[good]
                middle = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
                at = middle - half
                d = doc[middle] if len(middle) else middle
                inside = (at >= first[:-1][d]) & (at + window <= first[1:][d])
                at, d = at[inside], d[inside]
                if not len(at):
                    continue
                mark = _mark(sums, at, window)
                second = _second(data, spans, at, window)
                yield pa.RecordBatch.from_arrays([pa.array(mark.view(np.int64)), pa.array(second.view(np.int64)), pa.array(uid[row + d]), pa.array((at - first[:-1][d]).astype(np.int32))], ["mark", "second", "uid", "at"])

    return texts.select("uid", "text").mapInArrow(of, "mark long, second long, uid long, at int")


def _anchors(texts: DataFrame, window: int) -> DataFrame:
    def of(batches):
        for batch in batches:
            for _, data, offsets in pieces(batch.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(_symbols(data, offsets, window)[-1].view(np.int64))], ["anchor"])

    return texts.select("text").mapInArrow(of, "anchor long")


def _cut(texts: DataFrame, window: int) -> DataFrame:
    """(uid, n_words, n_removed, kept_sha256, kept) of (uid, text, copies, starts); starts may be null."""

    def of(batches):
        for batch in batches:
            out = []
            for uid, text, copies, starts in zip(*(batch.column(c) for c in ("uid", "text", "copies", "starts")), strict=True):
                words = text.as_py().split()  # of bytes: by ASCII white space alone
                n = len(words)
                if copies.as_py() > 1 and n >= window:
                    kept = []
                elif starts.is_valid:
                    edge = np.zeros(n + 1, np.int32)
                    at = starts.values.to_numpy()
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    kept = [w for w, covered in zip(words, np.cumsum(edge[:-1]), strict=True) if not covered]
                else:
                    kept = words
                left = b" ".join(kept)
                out.append((uid.as_py(), n, n - len(kept), hashlib.sha256(left).hexdigest(), left))
                if len(out) >= 256:
                    yield _batch(out)
                    out = []
            yield _batch(out)

    return texts.select("uid", "text", "copies", "starts").mapInArrow(of, "uid long, n_words long, n_removed long, kept_sha256 string, kept binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["uid", "n_words", "n_removed", "kept_sha256", "kept"])


def repeated_starts(texts: DataFrame, window: int) -> DataFrame:
    """(uid, starts): where repeated windows start in each distinct text that has some."""
    shared = _anchors(texts, window).groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    bitmap = texts.sparkSession.sparkContext.broadcast(array_of(shared, "anchor", ANCHOR_BITS))
    marks = saved(_windows(texts, window, bitmap))
    # a table of its own, so that the join may split a mark that very many places share
    twice = saved(marks.groupBy("mark", "second").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("mark", "second"))
    return saved(marks.join(twice, ["mark", "second"]).groupBy("uid").agg(F.collect_list("at").alias("starts")))


def deduplicate(docs: DataFrame, window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, and with ``keep_text`` the kept text."""
    texts, uid = distinct_texts(docs)
    starts = repeated_starts(texts, window)
    touched = passes(array_of(starts, "uid", TEXT_BITS), F.col("uid"))
    rest = texts.where(~touched | (F.col("copies") > 1)).withColumn("starts", F.lit(None).cast("array<int>"))
    cut = texts.where(touched & (F.col("copies") == 1)).join(starts, "uid", "left")
    columns = ["uid", "n_words", "n_removed", "kept_sha256"] + ["kept"] * keep_text
    done = _cut(rest, window).select(*columns).union(_cut(cut, window).select(*columns))
    keyed = docs.select("doc_id", uid(F.col("text")).alias("uid"))
    out = keyed.join(done, "uid").drop("uid")
    return out.withColumn("kept", F.col("kept").cast("string")) if keep_text else out
