"""Rendezvous hashing of record keys over weighted shards.

Each shard draws a number for each key from a hash of the key and the shard; the
shard with the best draw takes the record.  A further shard changes no draw of
the others, so records move only to it, about a share of its weight.

Defined cases: a null key counts as the text ``null``; null texts have size 1
and the CRC of no bytes; repeated rows land in one shard and get slots of their
own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hexadecimal digits of the MD5 that make a draw: 52 bits, exact in a double.
DRAW_DIGITS = 13


def draw(key: Column, shard: Column, weight: Column) -> Column:
    """A shard's draw for a key: ``-ln(u) / weight``, by whose least a shard wins with a probability proportional to its weight."""
    text = F.coalesce(key.cast("string"), F.lit("null"))
    digits = F.substring(F.md5(F.concat(text, F.lit(":"), shard.cast("string"))), 1, DRAW_DIGITS)
    u = (F.conv(digits, 16, 10).cast("double") + F.lit(1.0)) / F.lit(float(16**DRAW_DIGITS + 1))
    return F.struct((-F.log(u) / weight).alias("draw"), shard.alias("shard"))


def best_draw(key: Column, weights: Sequence[float]) -> Column:
    """The winning draw and its shard, over shards from 0."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    shards = F.array(*[F.struct(F.lit(i).alias("shard"), F.lit(float(w)).alias("weight")) for i, w in enumerate(weights)])
    return F.array_min(F.transform(shards, lambda s: draw(key, s["shard"], s["weight"])))


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard (from 0) that takes ``key``."""
    return best_draw(key, weights)["shard"]


def shard(docs: DataFrame, weights: Sequence[float], key: str = "doc_id", grown_weight: float | None = None, part_digits: int = 3) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Slots number the records of a shard without gaps.  A shard isn't numbered in
    one task: its keys fall into 16**part_digits parts by hash, each is numbered
    by itself, and the parts' counts (shards x parts rows) give what to add.
    """
    part = F.substring(F.md5(F.concat(F.lit("part:"), F.coalesce(F.col(key).cast("string"), F.lit("null")))), 1, part_digits).alias("part")
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.lit("key").alias("law"),
        best_draw(F.col(key), weights).alias("best"),
        draw(F.col(key), F.lit(len(weights)), F.lit(float(grown_weight or weights[-1]))).alias("next"),
        part,
    )
    grown = F.when(F.col("next") < F.col("best"), F.col("next.shard")).otherwise(F.col("best.shard"))
    rows = rows.select("doc_id", "size", "text_crc32", "law", F.col("best.shard").alias("shard"), grown.alias("grown_shard"), "part")
    counts = docs.select(shard_of(F.col(key), weights).alias("shard"), part).groupBy("shard", "part").count()
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("row", F.row_number().over(inside))
    return numbered.join(starts, ["shard", "part"]).select("doc_id", "size", "text_crc32", "law", "shard", (F.col("start") + F.col("row") - 1).cast("long").alias("slot"), "grown_shard")
