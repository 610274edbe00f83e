"""Distinct texts of a corpus, without moving the texts that occur once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketframe.llm.bitmap import array_of, passes
from marketframe.llm.store import saved

#: Bits of the bitmaps of texts that occur again and of hashes that several texts share, as a power of 2: 2 MB.
BITS = 24


def first_hash(text: Column) -> Column:
    return F.xxhash64(text)


def second_hash(text: Column) -> Column:
    return F.xxhash64(F.lit(1), text)


def distinct_texts(docs: DataFrame) -> tuple[DataFrame, Callable[[Column], Column]]:
    """(uid, text as binary, copies) of each distinct text, and the function that makes a text's uid.

    Two hashes of 64 bits tell texts apart.  The uid is the first of them, but the
    second where several texts share a first one.  First hashes are counted; a
    bitmap of those that come again, of fixed size, lets the other texts pass where
    they are; only texts in the bitmap are sent to be grouped, combined on the map side.
    """
    text = F.coalesce("text", F.lit(""))
    hashed = docs.select(first_hash(text).alias("key"), second_hash(text).alias("check"))
    again = hashed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("check").alias("low"), F.max("check").alias("high")).where("n > 1")
    again = saved(again.select("key", (F.col("low") != F.col("high")).alias("several")))
    clashes = array_of(again.where("several"), "key", BITS)

    def uid(of: Column) -> Column:
        of = F.coalesce(of, F.lit(""))
        return F.when(passes(clashes, first_hash(of)), second_hash(of)).otherwise(first_hash(of)) if clashes.any() else first_hash(of)

    maybe = passes(array_of(again, "key", BITS), F.col("key"))
    keyed = docs.select(first_hash(text).alias("key"), uid(F.col("text")).alias("uid"), text.cast("binary").alias("text"))
    once = keyed.where(~maybe).select("uid", "text", F.lit(1).cast("long").alias("copies"))
    more = saved(keyed.where(maybe).groupBy("uid").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies")))
    return once.union(more), uid
