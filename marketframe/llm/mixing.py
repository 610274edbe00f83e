"""Mixing sources to target weights by weighted fair queueing.

The documents of a source stand in a shuffled order and are sent over and over.
A copy's virtual finish time is the number of words its source has sent with it,
divided by the source's target; all copies are sorted by finish time over all
sources, and what lies beyond the total budget is cut off.  A copy that is being
sent at virtual time 1, when every source has its target, goes as two packets:
its words up to then, and the rest, which finishes later.  So a source misses
its target by less than a word for each source, however long its documents are.

Defined cases: null texts have no words and are never taken; the null source is
a source of its own, last in order; repeated rows are taken as rows of their own,
next to each other in the order; an empty table gives an empty result; where no
document has words all targets are 0; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from marketframe.llm.store import saved
from marketframe.llm.text import words

#: What packets are sorted by: finish time, then source (null last) and place in it.
QUEUE = ("finish", "nameless", "name", "start")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """source, source_size, target, from one row (source, source_size) for each source.

    A target is the smaller of ``most`` times the source's size and ``level`` times
    its weight.  In order of the level at which sources stop, each prefix of
    stopped sources leaves a level for the rest; the first level at which no
    further source stops is the one.  One row a source: their number, not the
    corpus, bounds these windows.
    """
    one = F.lit(0)
    by_name = Window.partitionBy(one).orderBy(F.col("source").isNull(), "source")
    kind = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), kind + 1)).withColumn("most", F.col("source_size") * F.lit(float(most)))
    all_rows = Window.partitionBy(one)
    stops = Window.partitionBy(one).orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(all_rows) * F.lit(float(share)) - F.coalesce(F.sum("most").over(stops), F.lit(0.0))
    level = left / (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(stops), F.lit(0.0)))
    levels = weighed.withColumn("level", level)
    fits = F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), "level"))).over(all_rows)["level"]
    return levels.select("source", "source_size", F.coalesce(F.least("most", fits * F.col("weight")), "most").alias("target"))


def _packets(copy: int) -> list[Column]:
    """The two packets of a document's copy: its words before virtual time 1, and the rest of a copy that starts before it."""
    first = F.col("before") + copy * F.col("source_size")
    early = F.greatest(F.lit(0), F.least(F.col("size"), F.floor(F.col("target")) - first)).cast("long")
    late = F.when(first < F.col("target"), F.col("size") - early).otherwise(F.lit(0)).cast("long")

    def packet(start: Column, words_: Column) -> Column:
        finish = F.try_divide((start + words_).cast("double"), F.col("target"))
        return F.struct(finish.alias("finish"), F.col("source").isNull().alias("nameless"), F.coalesce("source", F.lit("")).alias("name"), start.alias("start"), words_.alias("words"))

    return [packet(first, early), packet(first + early, late)]


def _last(sent: DataFrame, budget: int) -> Row | None:
    """The packet in which the budget ends, with the words ``left`` of it that are sent; None where all are."""
    ranges = int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    queue = saved(sent.repartitionByRange(ranges, *QUEUE).withColumn("range", F.spark_partition_id()))
    through = F.sum("words").over(Window.orderBy("range"))  # one row a range
    at = queue.groupBy("range").agg(F.sum("words").alias("words")).withColumn("through", through).where(F.col("through") >= budget).orderBy("range").first()
    if at is None:
        return None
    need = budget - (at["through"] - at["words"])
    inside = queue.where(F.col("range") == at["range"]).withColumn("through", F.sum("words").over(Window.partitionBy("range").orderBy(*QUEUE)))
    return inside.where(F.col("through") >= need).withColumn("left", F.col("words") - F.col("through") + need).orderBy(*QUEUE).first()


def _sent(packet: Column, last: Row | None) -> Column:
    """How many words of a packet lie within the budget."""
    if last is None:
        return packet["words"]
    own = F.struct(*[packet[c].alias(c) for c in QUEUE])
    end = F.struct(*[F.lit(last[c]).cast(kind).alias(c) for c, kind in zip(QUEUE, ("double", "boolean", "string", "long"), strict=True)])
    return F.when(packet["words"] == 0, F.lit(0)).when(own < end, packet["words"]).when(own == end, F.lit(last["left"])).otherwise(F.lit(0)).cast("long")


def mix(docs: DataFrame, weights: Sequence[float] = (3.0, 1.0, 2.0), share: float = 1.5, most: int = 2, seed: str = "mix", parts: int = 1024) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, virtual_start
    (of its first copy), source, and text_key (a hash of the text, for joins).

    A source's running sums aren't made in one task: its shuffled order is cut into
    ``parts`` ranges, each summed by itself, and the ranges' totals (sources x parts
    rows) give what lies before.  The packets of all sources are then range-sorted
    by finish time and summed in the same way, which gives the packet in which the
    budget ends: the one row that comes to the driver.
    """
    order = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), order.alias("place"), F.xxhash64("text").alias("text_key"))
    rows = saved(rows.withColumn("part", F.floor(F.conv(F.substring("place", 1, 6), 16, 10).cast("long") * parts / 16**6).cast("int")))
    totals = rows.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    aim = targets(totals.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights, share, most)
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("base", F.coalesce(F.sum("part_size").over(earlier), F.lit(0))).drop("part_size")
    known = starts.alias("s").join(aim.alias("a"), F.col("s.source").eqNullSafe(F.col("a.source"))).select(F.col("s.source").alias("source"), "part", "base", "source_size", "target")
    inside = Window.partitionBy("source", "part").orderBy("place", "doc_id", "size", "text_key").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("up_to", F.sum("size").over(inside))
    joined = summed.alias("r").join(known.alias("k"), F.col("r.source").eqNullSafe(F.col("k.source")) & (F.col("r.part") == F.col("k.part")))
    before = F.col("base") + F.col("up_to") - F.col("size")
    placed = saved(joined.select("doc_id", "size", "source_size", "target", before.alias("before"), F.col("r.source").alias("source"), "text_key"))

    packets = [p for copy in range(most) for p in _packets(copy)]
    sent = placed.select(F.explode(F.filter(F.array(*packets), lambda p: p["words"] > 0)).alias("p")).select("p.*")
    last = _last(sent, math.floor(share * (rows.agg(F.sum("size")).first()[0] or 0)))
    taken = sum((_sent(p, last) for p in packets), F.lit(0).cast("long"))
    start = F.try_divide(F.col("before").cast("double"), F.col("target"))
    return placed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), start.alias("virtual_start"), "source", "text_key")


def emit(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The documents as the mix sends them, with the columns of ``docs``, range-sorted by
    virtual finish time: a document comes once for each copy; the words of a cut copy
    are joined by one space."""
    # repeated rows (same id, same text) take equal parts of what they take together
    plan = mixed.where("taken > 0").groupBy("doc_id", "text_key").agg(
        F.min("size").alias("size"), F.floor(F.avg("taken")).alias("taken"), F.min("virtual_start").alias("start"), F.first(F.col("source_size") / F.col("target")).alias("turn"), F.first(F.col("size") / F.col("target")).alias("own")
    )
    joined = docs.alias("d").join(plan.alias("p"), F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.xxhash64(F.col("d.text")) == F.col("p.text_key")))
    whole = F.floor(F.col("p.taken") / F.col("p.size")).cast("int")
    rest = (F.col("p.taken") - whole * F.col("p.size")).cast("int")
    sent = F.concat(F.array_repeat(F.lit(0), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    out = joined.select(F.struct("d.*").alias("doc"), "p.start", "p.turn", "p.own", F.posexplode(sent).alias("copy", "cut"))
    text = F.when(F.col("cut") == 0, F.col("doc.text")).otherwise(F.array_join(F.slice(words(F.col("doc.text")), F.lit(1), F.col("cut")), " "))
    finish = F.col("start") + F.col("copy") * F.col("turn") + F.col("own")
    queue = out.select(*[text.alias(c) if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns], finish.alias("mix_finish_")).orderBy("mix_finish_")
    return queue.select(*docs.columns)
