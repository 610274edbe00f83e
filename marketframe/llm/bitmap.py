"""Bitmaps of hashes, of a size that is a parameter and not the data's.

They only spare work: a row whose bit is off can't match and needn't be sent; a
row whose bit is on is compared exactly later.  When the data outgrow the bitmap
more rows pass, and no result changes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bits of a block, as a power of 2: a task makes whole blocks of 8 KB.
BLOCK = 16


def bit_of(key: Column, bits: int) -> Column:
    """The bit, from 0 to 2**bits - 1, of a long key: its low bits."""
    return key.bitwiseAND(F.lit(2**bits - 1).cast("long"))


def longs(keys: DataFrame, column: str, bits: int) -> dict[int, int]:
    """The set words of a small bitmap of a long column: at most 2**(bits - 6) pairs come to the driver."""
    bit = bit_of(F.col(column), bits)
    pairs = keys.select(F.shiftright(bit, 6).alias("at"), bit.bitwiseAND(F.lit(63).cast("long")).cast("int").alias("b"))
    one = F.expr("shiftleft(1L, b)")
    return {r["at"]: r["bits"] for r in pairs.withColumn("one", one).groupBy("at").agg(F.bit_or("one").alias("bits")).collect()}


def array_of(keys: DataFrame, column: str, bits: int) -> np.ndarray:
    """The bitmap of a long column as an array of 2**(bits - 6) unsigned longs, for tasks.  Tasks make its blocks; 2**(bits - 3) bytes come to the driver at most."""
    size = 1 << min(BLOCK, bits)

    def blocks(batches):
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            bit = batch.column("bit").to_numpy()
            for b in np.unique(bit // size):
                mine = made.setdefault(int(b), np.zeros(size, bool))
                mine[bit[bit // size == b] % size] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.int64()), pa.array([np.packbits(m, bitorder="little").tobytes() for m in made.values()], pa.binary())], ["block", "bits"])

    bit = keys.select(bit_of(F.col(column), bits).alias("bit"))
    count = keys.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = bit.distinct().repartition(int(count), F.floor(F.col("bit") / size))
    out = np.zeros(2 ** (bits - 6), np.uint64)
    step = size // 64
    for r in dealt.mapInArrow(blocks, "block long, bits binary").collect():
        out[r["block"] * step : (r["block"] + 1) * step] = np.frombuffer(r["bits"], np.uint64)
    return out


def has(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys' bits are on."""
    bit = keys & np.uint64(len(bitmap) * 64 - 1)
    return ((bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1)).astype(bool)


def passes(bitmap: np.ndarray, key: Column) -> Column:
    """The same, of a long column."""
    shared = SparkSession.active().sparkContext.broadcast(bitmap)
    return F.arrow_udf(lambda column: pa.array(has(shared.value, column.to_numpy().view(np.uint64))), "boolean")(key)
