"""Queries over files that are made of the tables: damaged archives and feature files of several generations, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.operators.saved import shared_folder
from marketframe.sources import archive, loaders, views


def _events(spark: SparkSession, d: str) -> DataFrame:
    e = views.table(spark, d, "events")
    return e.select(F.concat(F.lit("U"), F.pmod("user_id", F.lit(4)).cast("string")).alias("instrument"), views.epoch_ms(F.col("ts")).alias("t"), F.col("event_id").alias("n"), F.concat_ws(":", "event_type", "props").alias("m"), "value")


def torn_archive(spark: SparkSession, d: str) -> DataFrame:
    """What is saved of archives that are clean (U0), lack their end (U1), come twice without the last end (U2) or end in junk (U3)."""
    folder = f"{shared_folder(spark)}/torn-{uuid.uuid4().hex}"
    lines = _events(spark, d).select("instrument", F.to_json(F.struct("t", "n", "m")).alias("value"))
    lines.repartition("instrument").write.partitionBy("instrument").option("compression", "gzip").text(folder)
    files = spark.read.format("binaryFile").load(folder).select("instrument", "content")
    less = F.expr("substring(content, 1, length(content) - 8)")  # the last eight bytes are a member's check and size
    torn = F.when(F.col("instrument") == "U1", less).when(F.col("instrument") == "U2", F.concat("content", less)).when(F.col("instrument") == "U3", F.concat("content", F.lit(b"junk"))).otherwise(F.col("content"))
    saved = archive.recovered(files.select("instrument", torn.alias("content")))
    read = archive.decode(saved.where("line is not null")).groupBy("instrument").agg(F.count_if("good").alias("lines"), F.sum("n").alias("n_sum"))
    return read.join(saved.groupBy("instrument").agg(F.concat_ws(",", F.sort_array(F.collect_list("damage"))).alias("damages")), "instrument")


def feature_generations(spark: SparkSession, d: str) -> DataFrame:
    """Rows of feature files with the labels 60s and 300s: files of one generation have a column more, others another order, and those of a third other labels."""
    folder = f"{shared_folder(spark)}/features-{uuid.uuid4().hex}"
    e = _events(spark, d).select("instrument", F.col("t").alias("ts"), F.col("value").alias("mid"), (F.col("n") % 3 - 1).alias("label_60s"), (F.col("n") % 2).alias("label_300s"))
    made = {"a": e.where("instrument in ('U0', 'U1')").withColumn("extra", F.lit(1)), "b": e.where("instrument = 'U2'").drop("label_300s"), "c": e.where("instrument = 'U3'").select("label_300s", "instrument", "mid", "label_60s", "ts")}
    for name, rows in made.items():
        rows.write.option("header", True).csv(f"{folder}/{name}")
    paths = [r.path for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where("length > 0").select("path").collect()]
    out, _ = loaders.feature_files(spark, paths, ["60s", "300s"])
    sums = [F.sum(F.col(c).cast("long")).alias(c) for c in ("label_60s", "label_300s")]
    return out.groupBy("instrument").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("mid").cast("double")), 4).alias("mid"), *sums)


ORACLES = {
    "torn_archive": "select 'U' || (user_id % 4) instrument, count(*) * case when user_id % 4 = 2 then 2 else 1 end as lines, (sum(event_id) * case when user_id % 4 = 2 then 2 else 1 end)::bigint n_sum, case user_id % 4 when 0 then '' when 3 then 'junk' else 'tail' end damages from events group by user_id % 4",
    "feature_generations": "select 'U' || (user_id % 4) instrument, count(*) n, round(sum(value), 4) mid, sum(event_id % 3 - 1)::bigint label_60s, sum(event_id % 2)::bigint label_300s from events where user_id % 4 <> 2 group by 1",
}
QUERIES = [torn_archive, feature_generations]
