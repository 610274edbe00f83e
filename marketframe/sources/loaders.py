"""Loaders that decide which files and rows count: candles, screens, costs, outside factors, feature files."""

from __future__ import annotations

import csv
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PANEL = "date date, symbol string, open double, high double, low double, close double, quote_volume double, trades double, taker_buy_frac double, minutes double, rv_bps double, funding_bps double, funding_periods int"


def read_panel(spark: SparkSession, path: str, min_minutes: float = 1430) -> DataFrame:
    """A panel from CSV: a row with a field that can't be read stays, but isn't complete."""
    names = [c.split()[0] for c in PANEL.split(", ")]
    text = spark.read.option("header", True).csv(path)
    kinds = dict(c.split() for c in PANEL.split(", "))
    read = text.select(*[F.col(c).try_cast(kinds[c]).alias(c) for c in names], *[(F.col(c).isNotNull() & F.col(c).try_cast(kinds[c]).isNull()).alias(f"_bad_{c}") for c in names])
    bad = F.lit(False)
    for c in names:
        bad = bad | F.col(f"_bad_{c}")
    out = read.withColumn("complete", ~bad & F.coalesce(F.col("minutes") >= min_minutes, F.lit(False))).withColumn("funding_bps", F.when(F.col("funding_periods") > 0, F.col("funding_bps")))
    return out.drop(*[f"_bad_{c}" for c in names])


def write_panel(panel: DataFrame, path: str, form: str = "parquet") -> None:
    """A panel in the one schema, by venue if it has that column; blanks where values are missing."""
    names = [c.split()[0] for c in PANEL.split(", ")]
    extra = ["venue"] if "venue" in panel.columns else []
    writer = panel.select(*extra, *names).write.format(form).option("header", True).option("emptyValue", "")
    (writer.partitionBy(*extra) if extra else writer).save(path)


def sound_candles(candles: DataFrame) -> DataFrame:
    """Confirmed candles with a positive close and ordered extremes; minutes is 0 on days before a listing."""
    traded = (F.coalesce("quote_volume", F.lit(0)) > 0) | (F.coalesce("trades", F.lit(0)) > 0)
    fine = candles.where("confirmed and close > 0 and high >= low and low > 0")
    return fine.withColumn("minutes", F.when(traded, 1440).otherwise(0))


def screened(instruments: DataFrame, quote: str, least_usd: float, top: int) -> DataFrame:
    """The ``top`` instruments of a quote by volume in USD, with a two-sided uncrossed market; ties by name."""
    usd = F.col("base_volume") * F.col("last")
    good = instruments.where(F.col("name").endswith(quote) & (F.col("bid") > 0) & (F.col("ask") > F.col("bid")))
    return good.withColumn("usd_volume", usd).where(F.col("usd_volume") >= least_usd).orderBy(F.desc("usd_volume"), "name").limit(top)


def costs(symbols: DataFrame, spreads: DataFrame, taker_bps: float, default_bps: float) -> tuple[DataFrame, DataFrame]:
    """Each symbol's cost, the taker fee and half its measured spread, and the symbols that weren't measured."""
    one = spreads.groupBy("symbol").agg(F.max("spread_bps").alias("spread_bps"))
    joined = symbols.select("symbol").distinct().join(one, "symbol", "left")
    return joined.select("symbol", F.coalesce(taker_bps + F.col("spread_bps") / 2, F.lit(default_bps)).alias("cost_bps")), joined.where("spread_bps is null").select("symbol")


def outside_factor(panel: DataFrame, factor: DataFrame, name: str, canonical: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """The panel with an outside factor (date, symbol, value) by canonical name, and how many of its rows found a place.  The first symbol of a name counts."""
    if name in panel.columns:
        raise ValueError(f"factor {name} is taken")
    keyed = factor.withColumn("_name", canonical(F.col("symbol")))
    first = keyed.withColumn("_k", F.row_number().over(Window.partitionBy("date", "_name").orderBy("symbol"))).where("_k = 1").select("date", "_name", F.col("value").alias(name))
    known = panel.withColumn("_name", canonical(F.col("symbol")))
    placed = known.join(first, ["date", "_name"], "left").drop("_name")
    matched = first.join(known.select("date", "_name").distinct(), ["date", "_name"], "left_semi").agg(F.count(F.lit(1)).alias("matched"))
    return placed, matched.join(F.broadcast(first.agg(F.count(F.lit(1)).alias("total")))).select("matched", (F.col("total") - F.col("matched")).alias("dropped"))


def headers(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """path, header: the first line of each file, read by a Spark job (a task gives the line that begins a file's first block)."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            here = batch.column("path").to_pylist()
            new = [i for i, p in enumerate(here) if p != (here[i - 1] if i else last)]
            last = here[-1] if here else last
            rows = [i for i in new if batch.column("at")[i].as_py() == 0]
            yield pa.RecordBatch.from_arrays([batch.column("path").take(pa.array(rows, pa.int64())), batch.column("value").take(pa.array(rows, pa.int64()))], ["path", "header"])

    lines = spark.read.text(list(paths)).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"))
    return lines.mapInArrow(first, "path string, header string")


def feature_files(spark: SparkSession, paths: Sequence[str], horizons: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Feature files of one generation of horizons, as the columns they share, and the files that were left out.
    A file is admitted by its own header; the instrument stays a column, so instruments never mix unseen.
    Files are grouped by header, and each group is one scan: there are as many as generations, however many files."""
    groups = headers(spark, paths).groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("paths")).orderBy("header").collect()  # a row for each generation
    kept, skipped = [], []
    for g in groups:
        names = next(csv.reader([g["header"]]))
        labels = {c.removeprefix("label_") for c in names if c.startswith("label_")}
        if labels == set(horizons) and "instrument" in names:
            kept.append((names, g["paths"]))
        else:
            skipped += g["paths"]
    if not kept:
        raise ValueError("no file has these horizons")
    shared = [c for c in kept[0][0] if all(c in names for names, _ in kept)]
    out = None
    for names, files in kept:
        schema = ", ".join(f"`{c}` string" for c in names)
        part = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(files).select(shared)
        out = part if out is None else out.unionByName(part)
    return out, sorted(skipped)
