"""Collocations by the stripes pattern.

A stripe belongs to a prefix (the first words of a phrase) and is a counter of the
words that come next.  Tasks count stripes over chunks of text; stripes of one
prefix are merged elementwise in Spark.  One structure serves for everything: its
words are the extensions of the prefix, an entry's count is the total of the next
level's prefix, and the largest counts say which phrases a longer one subsumes.

Levels go by words: the empty prefix first (all words), then prefixes of one word
and so on.  A phrase can only be frequent if the phrases without its first and
without its last word are, so a level counts where both pass a bitmap of the
frequent ones of the level before (a bitmap of fixed size: when it fills up more
is counted, and no result changes).  Phrases are always counted by their words.

Prefixes with more than 1/HOT of all occurrences (fewer than HOT of them) have their
stripes split into parts by the next word, so no task gets a whole hot stripe.

Defined cases: null texts are empty; a null lang is "und"; texts of any length are
read whole and are cut between pieces in memory (what is held at once is CHUNK
bytes, or one piece if that is longer); repeated rows count again; an empty table
gives an empty result; other columns are ignored.  Counts may have up to 15 digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketframe.llm.arrays import LOWER, PIECE, U64, mix, pieces, prefix_sums, spans_hash
from marketframe.llm.bitmap import array_of, has
from marketframe.llm.store import saved

#: What ends a piece, and what else lies between words.
ENDS = np.zeros(256, bool)
ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
GAPS = ENDS.copy()
GAPS[[0x20, 0x09]] = True

#: Bytes of text that a task counts at a time.
CHUNK = 1 << 23
#: Bits of the bitmap of frequent phrases, as a power of 2: 16 MB.
BITS = 27
HOT, PARTS = 512, 4096
STRIPES = "lang string, prefix string, part int, words array<string>, counts array<long>"


def _cut(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text's bytes, cut where pieces end."""
    first = 0
    while len(data) - first > 2 * PIECE:
        ends = np.flatnonzero(ENDS[data[first + PIECE : first + 2 * PIECE]])
        step = PIECE
        while not len(ends) and first + step < len(data):  # a very long piece
            step += PIECE
            ends = np.flatnonzero(ENDS[data[first + step : first + step + PIECE]])
        last = first + step + int(ends[0]) + 1 if len(ends) else len(data)
        yield data[first:last]
        first = last
    if first < len(data):
        yield data[first:]


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words (lower case), each one's row, and a number of its piece."""
    data = LOWER[data]
    gap = np.ones(len(data) + 1, bool)
    gap[:-1] = GAPS[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.ones(len(data), bool)
    before[1:] = gap[:-2]
    starts = np.flatnonzero(~gap[:-1] & (before | edge[:-1]))
    ends = np.flatnonzero(~gap[:-1] & (gap[1:] | edge[1:])) + 1
    at = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=at[1:])
    words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(data[~gap[:-1]].tobytes())])
    new = np.cumsum(edge[:-1] | ENDS[data])
    return words, np.searchsorted(offsets, starts, "right") - 1, new[starts]


class Chunk:
    """Words of some texts: ids into their distinct words, codes of their langs, numbers of their pieces."""

    def __init__(self, words: list[pa.Array], langs: list[np.ndarray], runs: list[np.ndarray], names: list[str]):
        coded = pa.concat_arrays(words).dictionary_encode()
        self.distinct, self.names = coded.dictionary, names
        self.ids, self.langs = coded.indices.to_numpy(), np.concatenate(langs)
        steps = np.cumsum([0, *(int(r[-1]) + 1 if len(r) else 0 for r in runs[:-1])])
        self.runs = np.concatenate([(r + s).astype(np.int32) for r, s in zip(runs, steps, strict=True)])


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """Chunks of about CHUNK bytes of columns lang and text."""
    codes: dict[str, int] = {}
    words, langs, runs, size = [], [], [], 0
    for batch in batches:
        mine = np.array([codes.setdefault(x, len(codes)) for x in batch.column("lang").to_pylist()], np.int32)
        for first, data, offsets in pieces(batch.column("text")):
            one = len(offsets) == 2
            for part in _cut(data) if one else [data]:
                w, rows, run = _words(part, np.array([0, len(part)]) if one else offsets)
                words, langs, runs, size = [*words, w], [*langs, mine[first + rows]], [*runs, run], size + len(part)
                if size >= CHUNK:
                    yield Chunk(words, langs, runs, list(codes))
                    words, langs, runs, size = [], [], [], 0
    if any(len(w) for w in words):
        yield Chunk(words, langs, runs, list(codes))


def _hashes(words: pa.Array) -> np.ndarray:
    """64 bits of each string."""
    words = words.cast(pa.large_binary())
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(words) else np.zeros(0, np.uint8)
    return spans_hash(prefix_sums(data), at[:-1] - at[0], at[1:] - at[0])


def _join(one: np.ndarray, next_: np.ndarray) -> np.ndarray:
    """The hash of a phrase and one more word."""
    return mix(one * U64(0x9E3779B97F4A7C15) + next_)


def _grams(chunk: Chunk, length: int, bitmap: np.ndarray | None) -> np.ndarray:
    """Places where a phrase of `length` words begins whose two shorter ones may be frequent."""
    n = len(chunk.ids) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    fits = chunk.runs[:n] == chunk.runs[length - 1 :]
    if bitmap is not None:
        words = _hashes(chunk.distinct)
        key = _hashes(pa.array(chunk.names))[chunk.langs[: n + 1]]
        for i in range(length - 1):
            key = _join(key, words[chunk.ids[i : i + n + 1]])
        passed = has(bitmap, key)
        fits &= passed[:-1] & passed[1:]
    return np.flatnonzero(fits)


def _stripes(chunk: Chunk, length: int, bitmap: np.ndarray, hot: dict[tuple[str, str], int]) -> pa.RecordBatch:
    """The chunk's stripes of prefixes of length - 1 words."""
    at = _grams(chunk, length, bitmap)
    prefix, size = chunk.langs[at].astype(np.int64), len(chunk.distinct)
    for i in range(length - 1):  # prefixes are numbered word by word, so that numbers stay small
        keys, prefix = np.unique(prefix * size + chunk.ids[at + i], return_inverse=True)
    pair, counts = np.unique(prefix * size + chunk.ids[at + length - 1], return_counts=True)
    prefix_of, next_ = pair // size, pair % size
    sample = np.zeros(len(keys), np.int64)
    sample[prefix] = at  # a place where each prefix stands
    del at, prefix
    texts = chunk.distinct.take(pa.array(chunk.ids[sample]))
    for i in range(1, length - 1):
        texts = pc.binary_join_element_wise(texts, chunk.distinct.take(pa.array(chunk.ids[sample + i])), " ")
    lang = chunk.langs[sample]
    parts = np.ones(len(keys), np.int64)
    if hot:
        names = pc.binary_join_element_wise(pa.array(chunk.names).take(pa.array(lang)), texts, "\t")  # no word holds a tab
        found = pc.index_in(names, pa.array([f"{a}\t{b}" for a, b in hot])).fill_null(-1).to_numpy()
        parts = np.where(found >= 0, np.array([*hot.values(), 1])[found], 1)
    part = (_hashes(chunk.distinct)[next_] >> U64(20)).astype(np.int64) % parts[prefix_of]
    order = np.lexsort((part, prefix_of))
    prefix_of, next_, counts, part = prefix_of[order], next_[order], counts[order], part[order]
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(prefix_of) != 0) | (np.diff(part) != 0)
    first = np.flatnonzero(new)
    offsets = pa.array(np.append(first, len(order)), pa.int32())
    of = prefix_of[first]
    return pa.RecordBatch.from_arrays(
        [pa.array(chunk.names).take(pa.array(lang[of])), texts.take(pa.array(of)), pa.array(part[first], pa.int32()), pa.ListArray.from_arrays(offsets, chunk.distinct.take(pa.array(next_))), pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64()))],
        ["lang", "prefix", "part", "words", "counts"],
    )


def _sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(batch), 20_000):
        yield batch.slice(i, 20_000)


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, phrase, f) of all words: the stripe of the empty prefix, its parts dealt out by word."""

    def count(batches):
        for c in chunks(batches):
            size = len(c.distinct)
            found, counts = np.unique(c.langs.astype(np.int64) * size + c.ids, return_counts=True)
            rows = pa.RecordBatch.from_arrays([pa.array(c.names).take(pa.array(found // size)), c.distinct.take(pa.array(found % size)), pa.array(counts, pa.int64())], ["lang", "phrase", "n"])
            yield from _sliced(rows)

    return texts.mapInArrow(count, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))


def extended(texts: DataFrame, length: int, shorter: DataFrame, total: int, least: int) -> DataFrame:
    """(lang, prefix, next, f) of the phrases of `length` words with f >= least, from their shorter ones (lang, phrase, f)."""
    share = F.ceil(F.col("f") * PARTS / total).cast("int")
    hot = {(r["lang"], r["phrase"]): r["parts"] for r in shorter.where(F.col("f") * HOT > total).select("lang", "phrase", share.alias("parts")).collect()}

    def keys(batches):
        for b in batches:
            if not len(b):
                continue
            words = pc.split_pattern(b.column("phrase"), " ").flatten()
            key, words = _hashes(b.column("lang")), _hashes(words).reshape(len(b), length - 1)
            for i in range(length - 1):
                key = _join(key, words[:, i])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], ["key"])

    bitmap = array_of(shorter.select("lang", "phrase").mapInArrow(keys, "key long"), "key", BITS)
    shared = SparkSession.active().sparkContext.broadcast((bitmap, hot))

    def count(batches):
        for c in chunks(batches):
            yield from _sliced(_stripes(c, length, *shared.value))

    # stripes are dealt out whole (or by parts) and merged elementwise where they arrive
    dealt = texts.mapInArrow(count, STRIPES).repartition("lang", "prefix", "part")
    entries = dealt.select("lang", "prefix", "part", F.explode(F.arrays_zip("words", "counts")).alias("e"))
    return entries.groupBy("lang", "prefix", "part", F.col("e.words").alias("next")).agg(F.sum("e.counts").alias("f")).where(F.col("f") >= least).drop("part")


def _part(words: Column, first: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def _score(a: Column, l: Column, r: Column) -> Column:
    """floor(1000000 a a / (l r)), exactly."""
    a, l, r = (x.cast("decimal(15,0)") for x in (a, l, r))
    top, bottom = F.lit(1_000_000).cast("decimal(7,0)") * (a * a), l * r
    return F.call_function("div", top, bottom)


def phrases(docs: DataFrame, max_words: int = 3, least: int = 10, subsumed_percent: int = 50, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of 2 to max_words words of each lang."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).cast("string").alias("lang"), "text")
    words = saved(word_counts(texts))
    n = words.groupBy("lang").agg(F.sum("f").alias("n"))  # a row for each lang
    total = words.agg(F.sum("f")).first()[0] or 1
    levels = [words.where(F.col("f") >= least)]
    for length in range(2, max_words + 1):
        found = saved(extended(texts, length, levels[-1], total, least))
        levels.append(found.select("lang", F.concat_ws(" ", "prefix", "next").alias("phrase"), "f", "prefix"))

    totals, longer = levels[0].select("lang", "phrase", "f"), None
    for level in levels[1:]:
        totals = totals.union(level.select("lang", "phrase", "f"))
    for level in levels[2:]:
        # a phrase's largest count with one more word: after it, its stripe's largest entry; before it, by suffix
        suffix = F.expr("substring(phrase, instr(phrase, ' ') + 1)")
        more = level.select("lang", F.col("prefix").alias("phrase"), "f").union(level.select("lang", suffix.alias("phrase"), "f"))
        longer = more if longer is None else longer.union(more)
    candidates = levels[1]
    for level in levels[2:]:
        candidates = candidates.union(level)
    kept = candidates.select("lang", "phrase", F.col("f").alias("a"))
    if longer is not None:
        longest = longer.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
        kept = kept.join(longest, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < subsumed_percent * F.col("a"))).drop("most")

    each = F.split("phrase", " ")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.size(each) - 1)))
    cuts = cuts.withColumns({"left": _part(each, F.lit(1), F.col("k")), "right": _part(each, F.col("k") + 1, F.size(each) - F.col("k"))})
    cuts = cuts.join(totals.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = saved(cuts.join(totals.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"]).select("lang", "phrase", "a", "k", "l", "r"))
    lowest = F.min(F.struct(_score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")).alias("cut")
    scored = saved(cuts.groupBy("lang", "phrase", "a").agg(lowest).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))

    # the first of parts of each lang, then the first of these
    parts = max(1, round((scored.count() / max(1, top)) ** 0.5))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(parts))
    few = scored.withColumn("nth", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("nth") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
