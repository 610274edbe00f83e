"""Benchmark decontamination as a prefix-filtered set join.

A window is ``length`` consecutive words of a benchmark item (a shorter item is
one window).  A document contains a window only if it contains all its words, so
at a containment of 1 the necessary prefix of a window, its words in order of
rarity over the documents, is its first word alone: the *anchor*.  Documents'
words are joined with anchors.  A candidate then has to pass the positional and
length bounds (the window must fit around the anchor into both texts), and the
words around it are compared exactly, over windows of the item's size.

The windows of an item that share an anchor are verified together: from the
anchor, words agree up to ``left`` places back and ``right`` on, and windows lie
in that stretch if it is as long as one.

Defined cases: null texts have no words and are never contaminated; an item
without words has no window; repeated items count once by id; a null item_id
marks words but isn't listed; repeated documents get a row each; empty
benchmarks leave all documents clean; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketframe.llm.bitmap import longs
from marketframe.llm.store import saved
from marketframe.llm.text import NON_WORD, ascii_lower, words

#: Bits of the bitmap of anchors, as a power of 2: 64 KB, however many items there are.
BITS = 19


def item_words(text: Column) -> Column:
    return words(ascii_lower(text), NON_WORD)


def passes(word: Column, bitmap: Column) -> Column:
    """Whether the bitmap has the word's bit; ``bitmap`` is an array of longs."""
    bit = F.xxhash64(word).bitwiseAND(F.lit(2**BITS - 1).cast("long"))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63).cast("long")).cast("int"))
    return F.get(bitmap, F.shiftright(bit, 6).cast("int")).bitwiseAND(mask) != 0


def bitmap_of(tokens: DataFrame) -> Column:
    """The bitmap of the column ``word`` as a constant array."""
    found = longs(tokens.select(F.xxhash64("word").alias("key")), "key", BITS)
    return F.split(F.lit(",".join(str(found.get(i, 0)) for i in range(2 ** (BITS - 6)))), ",").cast("array<bigint>")


def anchors(benchmark: DataFrame, doc_words: DataFrame, length: int) -> DataFrame:
    """One row for each place in an item that is the rarest word of some window:
    word, item_id, before and after (the item's words on either side), need (the
    window's size)."""
    items = benchmark.select("item_id", item_words(F.col("text")).alias("ws")).distinct().where(F.size("ws") > 0)
    vocabulary = items.select(F.explode("ws").alias("word")).distinct()
    bits = bitmap_of(vocabulary)
    counts = doc_words.select(F.explode("ws").alias("word")).where(passes(F.col("word"), bits)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    places = items.select("item_id", "ws", F.posexplode("ws").alias("at", "word"))
    ranked = places.join(counts, "word", "left").groupBy("item_id", "ws").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("n", F.lit(0)).alias("n")))).alias("places"))
    need = F.least(F.size("ws"), F.lit(length))
    starts = ranked.withColumn("need", need).withColumn("start", F.explode(F.sequence(F.lit(0), F.size("ws") - F.col("need"))))
    inside = F.slice("places", F.col("start") + 1, F.col("need"))
    rarest = F.array_min(F.transform(inside, lambda p: F.struct(p["n"].alias("n"), F.get(F.col("ws"), p["at"]).alias("word"), p["at"].alias("at"))))["at"]
    return (
        starts.select("item_id", "ws", "need", rarest.alias("at")).distinct()
        .select(
            F.get("ws", F.col("at")).alias("word"), "item_id", "need",
            F.reverse(F.slice("ws", F.greatest(F.col("at") - length + 2, F.lit(1)), F.least(F.col("at"), F.lit(length - 1)))).alias("before"),
            F.slice("ws", F.col("at") + 2, F.lit(length - 1)).alias("after"),
        )
    )


def agreeing(a: Column, b: Column) -> Column:
    """How many leading elements of two arrays are equal."""
    same = F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: F.coalesce(x["a"] == x["b"], F.lit(False)))
    first = F.array_position(same, F.lit(False))
    return F.when(first > 0, first - 1).otherwise(F.size(same).cast("long")).cast("int")


def contamination(docs: DataFrame, benchmark: DataFrame, length: int = 13, share: int = 20) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated, text_key (a hash of the text, for joins)."""
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.hash("text").alias("check"), item_words(F.col("text")).alias("ws"))
    found = saved(anchors(benchmark, texts, length))
    bits = bitmap_of(found)
    around = F.transform(
        F.filter(F.sequence(F.lit(0), F.size("ws") - 1), lambda i: passes(F.get("ws", i), bits)),
        lambda i: F.struct(
            i.alias("at"), F.get("ws", i).alias("word"),
            F.reverse(F.slice("ws", F.greatest(i - length + 2, F.lit(1)), F.least(i, F.lit(length - 1)))).alias("before"),
            F.slice("ws", i + 2, F.lit(length - 1)).alias("after"),
        ),
    )
    kind = "array<struct<at:int,word:string,before:array<string>,after:array<string>>>"
    # each row sends one head, which keeps and counts it, and its candidates; heads have keys of their own, that no word can have
    head = F.array(F.struct(F.lit(None).alias("at"), F.concat(F.lit("\x00"), F.col("text_key").cast("string")).alias("word"), F.lit(None).alias("before"), F.lit(None).alias("after"))).cast(kind)
    cands = F.when(F.size("ws") > 0, around.cast(kind)).otherwise(F.array().cast(kind))
    sent = texts.select("doc_id", "text_key", "check", F.size("ws").cast("long").alias("n_words"), F.explode(F.concat(head, cands)).alias("c"))
    joined = sent.select("doc_id", "text_key", "check", "n_words", "c.*").alias("d").join(found.alias("w"), F.col("d.word") == F.col("w.word"), "left")
    left = agreeing(F.col("d.before"), F.col("w.before"))
    right = agreeing(F.col("d.after"), F.col("w.after"))
    hit = joined.select("doc_id", "text_key", "check", "n_words", "at", "item_id", F.col("w.need").alias("need"), left.alias("left"), right.alias("right"))
    good = F.col("left") + F.col("right") + 1 >= F.col("need")
    span = F.when(good, F.struct((F.col("at") - F.col("left")).alias("a"), (F.col("at") + F.col("right") + 1).alias("z")))
    marked = hit.select("doc_id", "text_key", "check", "n_words", F.col("at").isNull().alias("head"), span.alias("span"), F.when(good, F.col("item_id").cast("string")).alias("item"))
    by_doc = marked.groupBy("doc_id", "text_key", "check").agg(
        F.max("n_words").alias("n_words"), F.sum(F.col("head").cast("long")).alias("heads"), F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.collect_set("item")).alias("items")
    )
    start = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("spans", start, lambda s, x: F.struct(F.greatest(s["upto"], x["z"]).alias("upto"), (s["n"] + F.greatest(F.lit(0), x["z"] - F.greatest(s["upto"], x["a"]))).cast("long").alias("n")))["n"]
    out = by_doc.select(
        "doc_id", "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "text_key", "heads",
    )
    out = out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words")))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("heads").cast("int")))).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "text_key")
