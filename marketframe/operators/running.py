"""Running values of a key's rows in time order, without a task that holds a whole key.

A state machine whose steps compose (sums, maxima, the last value there was) is a
scan: time is cut into buckets, each bucket is scanned by itself, and what a bucket
does as a whole, one row, is scanned over the buckets and handed on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400_000


def running(df: DataFrame, by: Sequence[str], at: str, order: Sequence[str], values: dict[str, tuple[str, Column]], before: bool = False, bucket: int = DAY) -> DataFrame:
    """``df`` with a column for each of ``values`` (name: how, value): the sum (0 at first), maximum or last value of a key's rows up
    to this one, or before it.  Nulls don't count; a last value that may be null has to be in a struct.

    ``order`` begins with ``at``, which is cut into buckets.  Keys are equal as in a join: rows with a null key go."""
    by, order = list(by), list(order)
    cut = df.withColumn("_span", F.floor(F.col(at) / bucket)).withColumns({f"_v_{n}": v for n, (_, v) in values.items()})
    place = F.struct(*[F.col(c) for c in order])
    whole, carry, inside = [], [], {}
    over = Window.partitionBy(*by).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    rows = Window.partitionBy(*by, "_span").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    for n, (how, _) in values.items():
        v, top = F.col(f"_v_{n}"), F.col(f"_t_{n}")
        whole.append({"sum": F.sum(v), "max": F.max(v), "last": F.max_by(v, F.when(v.isNotNull(), place))}[how].alias(f"_t_{n}"))
        carry.append({"sum": F.sum(top).over(over), "max": F.max(top).over(over), "last": F.last(top, ignorenulls=True).over(over)}[how].alias(f"_c_{n}"))
        inside[f"_i_{n}"] = {"sum": F.sum(v).over(rows), "max": F.max(v).over(rows), "last": F.last(v, ignorenulls=True).over(rows)}[how]
    carried = cut.groupBy(*by, "_span").agg(*whole).select(*by, "_span", *carry)
    made = cut.withColumns(inside).join(carried, [*by, "_span"])
    out = {}
    for n, (how, _) in values.items():
        here, past = F.col(f"_i_{n}"), F.col(f"_c_{n}")
        out[n] = {"sum": F.coalesce(here, F.lit(0)) + F.coalesce(past, F.lit(0)), "max": F.greatest(here, past), "last": F.coalesce(here, past)}[how]
    return made.withColumns(out).drop("_span", *[f"_{k}_{n}" for n in values for k in "vic"])


#: Arrow's types of what a walk gives.
KINDS = {"double": pa.float64(), "long": pa.int64(), "boolean": pa.bool_()}


def walked(df: DataFrame, keys: Sequence[str], order: Sequence[str], inputs: Sequence[str], make: Callable[[], Callable[..., tuple]], outputs: dict[str, str]) -> DataFrame:
    """``df`` with the columns ``outputs`` (name: kind) of a machine that can't be composed: ``make()`` gives a step for each key, which is called
    with the ``inputs`` of one row after another.  Rows come sorted, as a stream: a task holds a batch, however many rows a key has;
    keys are what is dealt to tasks, so they should be short stretches."""
    kept = [c for c in df.columns if c not in outputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, step = None, None
        for batch in batches:
            made = []
            rows = zip(*(batch.column(c).to_pylist() for c in inputs), strict=True)
            for key, row in zip(zip(*(batch.column(c).to_pylist() for c in keys), strict=True), rows, strict=True):
                if step is None or key != last:
                    last, step = key, make()
                made.append(step(*row))
            new = [pa.array([m[i] for m in made], KINDS[k]) for i, k in enumerate(outputs.values())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *new], [*kept, *outputs])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in kept), *(f"`{c}` {k}" for c, k in outputs.items())])
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
