"""Order books from messages: epochs, gaps, level validity, snapshots at a time, top of the book."""

from __future__ import annotations

import bisect
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketframe.operators.running import DAY, running, walked
from marketframe.operators.saved import saved


def gap_islands(updates: DataFrame, by: Sequence[str], seq: str = "seq", prev: str = "prev_seq") -> DataFrame:
    """``updates`` with ``repeat`` (a sequence number not above the last), ``gap`` (its previous number isn't the last) and
    ``epoch`` (gaps so far).  Without snapshots in the feed every gap starts an epoch."""
    order, last = ["ts_ms", "n"], F.col("_last")
    seen = running(updates, by, "ts_ms", order, {"_last": ("max", F.col(seq))}, before=True)
    marked = seen.withColumn("repeat", F.coalesce(F.col(seq) <= last, F.lit(False))).withColumn("gap", F.coalesce((F.col(prev) != last) & (F.col(seq) > last), F.lit(False))).drop("_last")
    return running(marked, by, "ts_ms", order, {"epoch": ("sum", F.col("gap").cast("int"))})


def applied(messages: DataFrame, by: Sequence[str]) -> DataFrame:
    """The feed's rule in full: updates count from a snapshot on, until a gap; a repeat counts for nothing.

    ``messages``: by..., ts_ms, n, action, seq, prev_seq.  Adds applied and epoch (snapshots so far).  An update without
    prev_seq follows whatever came; one without seq leaves the number as it is.

    While a book is ready its number only rises, but at a snapshot, at an update without prev_seq, and at a reset (an
    update whose seq is below its prev_seq).  Between these the number is the largest seq so far, so the machine is
    a scan of maxima and of "was there a gap", over buckets of time.  Whether a reset counts depends on the number it meets: the
    first of each epoch that does starts a stretch of its own, and the scan is run again while there are such resets
    (venues send a few a month; a feed without them is scanned once)."""
    by, order = list(by), ["ts_ms", "n"]
    snap, seq, prev = F.col("action") == "snapshot", F.col("seq"), F.col("prev_seq")
    rows = running(messages, by, "ts_ms", order, {"epoch": ("sum", snap.cast("long"))})
    follows = ~snap & prev.isNull()
    rows = rows.withColumn("_begins", snap | (follows & seq.isNotNull())).withColumn("_reset", F.coalesce(~snap & (seq < prev), F.lit(False)))
    rows = saved(rows)
    columns = rows.columns
    resets = not rows.where("_reset").isEmpty()
    while True:
        parts = running(rows, by, "ts_ms", order, {"_part": ("sum", F.col("_begins").cast("long"))})
        counts = F.when(~F.col("_reset") | F.col("_begins"), seq)
        seen = running(parts, [*by, "_part"], "ts_ms", order, {"_last": ("max", counts)}, before=True)
        # a stretch that begins with a number of its own needs none from before
        met = seen.withColumn("_fits", F.col("_begins") | follows | F.coalesce(prev == F.col("_last"), F.lit(False)))
        gap = ~F.col("_fits") & ~F.coalesce(seq <= F.col("_last"), F.lit(False))
        made = running(met.withColumn("_gap", gap.cast("int")), [*by, "epoch"], "ts_ms", order, {"_broken": ("max", F.col("_gap"))})
        alive = (F.col("epoch") > 0) & (F.col("_broken") == 0)
        if not resets:
            break
        # "_last" of a reset's own row is still the number before it
        first = made.where(F.col("_reset") & ~F.col("_begins") & alive & (prev == F.col("_last"))).groupBy(*by, "epoch").agg(F.min(F.struct(*order)).alias("_first"))
        first = saved(first)
        if first.isEmpty():
            break
        rows = saved(rows.join(first, [*by, "epoch"], "left").withColumn("_begins", F.col("_begins") | F.coalesce(F.struct(*order) == F.col("_first"), F.lit(False))).select(*columns))
    return made.withColumn("applied", alive & F.col("_fits")).drop("_begins", "_reset", "_part", "_last", "_fits", "_gap", "_broken")


def crossed_resync(touch: DataFrame, by: Sequence[str], patience: int = 3) -> DataFrame:
    """Updates at which a book has been crossed ``patience`` times in a row and has to be asked for anew."""
    order = ["ts_ms", "n"]
    marked = touch.withColumn("crossed", F.col("bid") >= F.col("ask"))
    counted = running(marked, by, "ts_ms", order, {"_all": ("sum", F.col("crossed").cast("int"))})
    # crossed updates so far, less those up to the last one that wasn't
    based = running(counted, by, "ts_ms", order, {"_base": ("max", F.when(~F.col("crossed"), F.col("_all")))})
    in_row = F.when(F.col("crossed"), F.col("_all") - F.coalesce("_base", F.lit(0))).otherwise(0)
    return based.withColumn("in_row", in_row).where((F.col("in_row") > 0) & (F.col("in_row") % patience == 0)).drop("_all", "_base")


def level_validity(changes: DataFrame, by: Sequence[str], epoch: str | None = None) -> DataFrame:
    """Absolute level changes (by..., side, price, size, ts_ms, n) as intervals [valid_from, valid_to): a level holds until its next change; size 0 ends it.
    With an ``epoch`` column, whose numbers grow (a snapshot starts one), all levels of an epoch end where the next one begins."""
    keys = [*by, epoch] if epoch else list(by)
    w = Window.partitionBy(*keys, "side", "price").orderBy("ts_ms", "n")
    spans = changes.withColumn("valid_from", F.col("ts_ms")).withColumn("valid_to", F.lead("ts_ms").over(w))
    if epoch:
        began = changes.groupBy(*keys).agg(F.min("ts_ms").alias("_began"))
        ends = began.withColumn("_ends", F.lead("_began").over(Window.partitionBy(*by).orderBy(epoch))).drop("_began")  # one row an epoch
        spans = spans.join(ends, keys).withColumn("valid_to", F.least("valid_to", "_ends")).drop("_ends")
    return spans.where((F.col("size") > 0) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("valid_from")))).drop("ts_ms", "n")


def level_sizes(deltas: DataFrame, by: Sequence[str]) -> DataFrame:
    """Signed changes of size as sizes: a level never goes below zero, and the next change starts from there.
    In closed form, the running sum less the least running sum so far (0 at most)."""
    w = Window.partitionBy(*by, "side", "price").orderBy("ts_ms", "n").rowsBetween(Window.unboundedPreceding, 0)
    summed = deltas.withColumn("_sum", F.sum(F.col("delta").cast("double")).over(w))
    return summed.select(*by, "side", "price", "ts_ms", "n", (F.col("_sum") - F.least(F.lit(0.0), F.min("_sum").over(w))).alias("size"))


def book_at(levels: DataFrame, by: Sequence[str], at: Column, depth: int) -> DataFrame:
    """The best ``depth`` levels of each side at a time, as arrays of (price, size)."""
    live = levels.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (at < F.col("valid_to"))))
    side = F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price"))
    ranked = live.withColumn("_k", F.row_number().over(Window.partitionBy(*by, "side").orderBy(side))).where(F.col("_k") <= depth)
    return ranked.groupBy(*by, "side").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "price", "size"))), lambda x: F.struct(x["price"].alias("price"), x["size"].alias("size"))).alias("levels"))


TOP = ["bid", "ask", "bid_size", "ask_size", "bid_depth", "ask_depth"]


class Side:
    """One side of a book: sizes by price, and the prices in order (the best first, bids by their negative)."""

    def __init__(self, sign: int):
        self.sign, self.sizes, self.order = sign, {}, []

    def set(self, price: float, size: float) -> None:
        key = self.sign * price
        if size > 0:
            if price not in self.sizes:
                bisect.insort(self.order, key)
            self.sizes[price] = size
        elif self.sizes.pop(price, None) is not None:
            del self.order[bisect.bisect_left(self.order, key)]

    def clear(self) -> None:
        self.sizes.clear()
        self.order.clear()

    def best(self, depth: int) -> tuple[float, float, float]:
        """The best price, its size, and the size of the best levels."""
        price = self.sign * self.order[0]
        return price, self.sizes[price], sum(self.sizes[self.sign * k] for k in self.order[:depth])


def top_of_book(messages: DataFrame, by: Sequence[str], depth: int = 20, bucket: int = DAY) -> DataFrame:
    """After every applied message: best bid and ask, their sizes, depth sums.

    ``messages``: by..., epoch, ts_ms, n, action, bids, asks (arrays of (price, size)).  Epochs are independent, and an epoch is
    cut into buckets of time, each of which begins with the levels that stand when it does: a level's last
    change of an earlier bucket, carried on while its size isn't 0.  A bucket is folded in order, with prices kept sorted."""
    by = list(by)
    keys = [*by, "epoch"]
    cut = messages.withColumn("_bucket", F.floor(F.col("ts_ms") / bucket)).withColumn("_snap", (F.col("action") == "snapshot"))
    cut = cut.select(*keys, "_bucket", "ts_ms", "n", "_snap", *[F.transform(F.coalesce(s, F.array().cast("array<struct<price:double,size:double>>")), lambda x: F.struct(x["price"].cast("double").alias("price"), x["size"].cast("double").alias("size"))).alias(s) for s in ("bids", "asks")])
    # a snapshot inside an epoch sweeps what stood before it
    swept = running(cut, keys, "ts_ms", ["ts_ms", "n"], {"_sweep": ("sum", F.col("_snap").cast("int"))}, bucket=bucket)
    each = swept.select(*keys, "_sweep", "_bucket", "ts_ms", "n", F.explode(F.concat(*[F.transform(s, lambda x: F.struct(F.lit(sign).alias("sign"), x["price"].alias("price"), x["size"].alias("size"))) for s, sign in (("bids", -1), ("asks", 1))])).alias("l"))
    # buckets are numbered; each begins in the sweep in which the one before it has ended
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("_bucket"))  # one row a bucket
    begins = F.coalesce(F.lag("_ends").over(Window.partitionBy(*keys).orderBy("_bucket")), F.lit(0))
    buckets = saved(swept.groupBy(*keys, "_bucket").agg(F.max("_sweep").alias("_ends")).withColumn("_nth", nth).withColumn("_sweep", begins).drop("_ends"))
    level = [*keys, "_sweep", F.col("l.sign").alias("sign"), F.col("l.price").alias("price")]
    lasts = each.groupBy(*level, "_bucket").agg(F.max_by("l.size", F.struct("ts_ms", "n")).alias("size")).join(buckets.select(*keys, "_bucket", "_nth"), [*keys, "_bucket"])
    # a level stands at the beginning of each bucket after its own, up to the one that changes it or the sweep's last
    until = F.lead("_nth").over(Window.partitionBy(*keys, "_sweep", "sign", "price").orderBy("_nth"))
    lasts = lasts.withColumn("_until", until).where("size > 0").join(buckets.groupBy(*keys, "_sweep").agg(F.max("_nth").alias("_last")), [*keys, "_sweep"])
    stands = lasts.withColumn("_until", F.coalesce("_until", "_last")).where("_nth < _until").select(*keys, "_sweep", F.explode(F.sequence(F.col("_nth") + 1, "_until")).alias("_nth"), "sign", "price", "size")
    seeds = stands.join(buckets, [*keys, "_sweep", "_nth"]).groupBy(*keys, "_bucket").agg(F.collect_list(F.struct("sign", "price", "size")).alias("seed"))  # a book

    def fold() -> Callable[..., tuple]:
        sides = {-1: Side(-1), 1: Side(1)}

        def step(snap: bool, bids: list, asks: list, seed: list | None) -> tuple:
            for level in seed or ():
                sides[level["sign"]].set(level["price"], level["size"])
            for side, changes in ((sides[-1], bids), (sides[1], asks)):
                if snap:
                    side.clear()
                for level in changes:
                    side.set(level["price"], level["size"])
            if not (sides[-1].order and sides[1].order):
                return (None,) * 6
            (b, bs, bd), (a, as_, ad) = sides[-1].best(depth), sides[1].best(depth)
            return b, a, bs, as_, bd, ad

        return step

    first = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy("ts_ms", "n")) == 1
    rows = cut.join(seeds, [*keys, "_bucket"], "left").withColumn("seed", F.when(first, F.col("seed")))
    tops = walked(rows, [*keys, "_bucket"], ["ts_ms", "n"], ["_snap", "bids", "asks", "seed"], fold, dict.fromkeys(TOP, "double"))
    return tops.where("bid is not null").select(*keys, "ts_ms", "n", *TOP)
