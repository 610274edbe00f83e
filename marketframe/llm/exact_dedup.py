"""Exact deduplication by content-defined chunk recipes.

A text is cut where its own characters say so (at least ``MIN_CHUNK``, at most
``MAX_CHUNK`` characters apart), so equal stretches of long texts are cut alike.
Chunks are stored once: rows of (digest, chunk) are grouped by their content, on
the map side first.  A digest that one content alone has is verified and becomes
its identifier; where several contents share a digest, they are numbered, and the
number belongs to the identifier.  Documents are then equal when their ordered
identifier lists are; only these short lists move, never the texts again.

Defined cases: null texts are empty texts and equal to them; equal rows with
equal doc_id are one group as others, and of those with the largest doc_id one
alone is kept; a null doc_id is kept only where its group has no other; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketframe.llm.store import saved
from marketframe.llm.text import ascii_lower

MIN_CHUNK, MAX_CHUNK = 1024, 8192
#: A cut falls after ten characters of this pattern of classes, about once in 2,000 characters.
CUT = r"[aeiou ][^aeiou ][^aeiou ][aeiou ][a-m ][^a-h][^o-z][aeiou ]"
CHUNKS = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK - 8}}}?{CUT}|.{{1,{MAX_CHUNK}}}"


def chunks(text: Column) -> Column:
    """Content-defined chunks whose concatenation is the text."""
    return F.regexp_extract_all(text, F.lit(CHUNKS), F.lit(0))


def digest(chunk: Column) -> Column:
    """A chunk's name before it is verified: 64 bits by one hash, 32 by another, and its length."""
    return F.struct(F.xxhash64(chunk).alias("a"), F.crc32(chunk).alias("b"), F.length(chunk).alias("n"))


def numbered(cut: DataFrame, clashes: DataFrame) -> DataFrame:
    """(text_sha256, fixes): for each text with chunks of a digest that several contents share, the places of these chunks
    and the numbers of their contents.  Only such chunks are sent."""
    asked = cut.select(F.sha2("norm", 256).alias("text_sha256"), F.posexplode("parts").alias("pos", "chunk")).withColumn("digest", digest(F.col("chunk"))).join(clashes, "digest").distinct()
    asked = saved(asked)
    nth = F.row_number().over(Window.partitionBy("digest").orderBy("chunk"))
    contents = asked.select("digest", "chunk").distinct().withColumn("nth", nth)
    return asked.join(contents, ["digest", "chunk"]).groupBy("text_sha256").agg(F.array_sort(F.collect_list(F.struct("pos", "nth"))).alias("fixes"))


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    text = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    cut = docs.select("doc_id", text.alias("norm")).withColumn("parts", chunks(F.col("norm")))

    # the chunk store: one row for each content; a digest of one content is its identifier
    store = cut.select(F.explode("parts").alias("chunk")).select(digest(F.col("chunk")).alias("digest"), "chunk").distinct()
    clashes = saved(store.groupBy("digest").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1").select("digest"))

    # each document's ordered list of identifiers
    recipes = cut.select("doc_id", F.sha2("norm", 256).alias("text_sha256"), F.transform("parts", digest).alias("recipe"))
    rows = recipes.groupBy("doc_id", "recipe", "text_sha256").agg(F.count(F.lit(1)).alias("times"))
    if clashes.isEmpty():
        rows = rows.withColumn("fixes", F.lit(None).cast("array<struct<pos:int,nth:int>>"))
    else:
        rows = rows.join(saved(numbered(cut, clashes)), "text_sha256", "left")
    rows = saved(rows.withColumn("ids", F.struct("recipe", "fixes")).select("doc_id", "ids", "text_sha256", "times"))
    # a table of its own, so that the join may split a list that very many documents share
    groups = saved(rows.groupBy("ids").agg(F.sum("times").alias("group_size"), F.max("doc_id").alias("keep_id")))

    found = rows.join(groups, "ids").withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)
    return found.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), kept.alias("kept"), "text_sha256")
