"""Whitening of embeddings by the covariance of their distinct vectors.

Vectors become whole numbers first, x = floor(scale * c).  Rows are grouped by x,
so that each distinct vector is fitted, whitened and measured once whatever the
number of its rows; its weight in the fit is one, or its count.  Sums are exact; the
covariance is a centred product of matrices of each task, added up in Spark; only
one matrix of dimension x dimension comes to the driver.  Whitened vectors are
joined back to their rows, on the vector itself.

Defined cases: rows without a vector, or with null or non-finite entries, are
dropped; of the others, those whose length isn't the commonest (of equal counts: the
longest) are dropped too, since they have no covariance with the rest; values of x
beyond 64 bits stop at its limits.  A component without variance (of less than 1e-12 of the first)
has null for whitened and doesn't count for identity_error.  A deviation that
passes 64 bits is null.  Repeated rows come again; an empty table, or one whose rows
are all dropped, gives an empty result; columns but the id and the vector are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.llm.store import saved

SCALE = 256
#: Least eigenvalue, as a share of the largest, that counts as variance.
LEAST = 1e-12
#: Rows of vectors that a task turns into a matrix at a time.
ROWS = 4096


def whole(vector: Column, scale: int = SCALE) -> Column:
    """x of a vector, null unless all entries are finite."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return F.when(finite, F.transform(vector, lambda c: F.floor(c.cast("double") * scale)))


def vectors(rows: DataFrame, vector: str, scale: int = SCALE) -> DataFrame:
    """The rows that remain, with x."""
    made = rows.withColumn("x", whole(F.col(vector), scale)).where("x is not null")
    sizes = made.groupBy(F.size("x").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    most = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    return made.where(F.size("x") == (most["size"] if most else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


class Fit:
    """n, the sums, and the components of a fit (components by falling variance)."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, axes: np.ndarray):
        self.n, self.sums, self.values, self.axes = n, sums, values, axes
        self.trace = float(values.sum())

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def sound(self) -> np.ndarray:
        """Components that have variance."""
        return self.values > max(LEAST * float(self.values[:1].sum()), 0.0)


def _sums(distinct: DataFrame) -> tuple[int, list[int]]:
    """The sum of the weights, and of the weighted vectors, exactly."""
    term = F.col("w").cast("decimal(19,0)") * F.col("c").cast("decimal(19,0)")
    each = distinct.select("w", F.posexplode("x").alias("i", "c")).groupBy("i").agg(F.sum(term).alias("s"), F.sum("w").alias("n")).orderBy("i").collect()  # a row for each dimension
    return (int(each[0]["n"]), [int(r["s"]) for r in each]) if each else (0, [])


def _products(distinct: DataFrame, mean: np.ndarray) -> np.ndarray:
    """Sum of w (x - mean) (x - mean)'."""

    def product(batches):
        total = np.zeros((len(mean), len(mean)))
        for b in batches:
            for first in range(0, len(b), ROWS):
                part = b.slice(first, ROWS)
                c = _matrix(part.column("x")) - mean
                total += (c * part.column("w").to_numpy()[:, None]).T @ c
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["m"])

    entries = distinct.select("x", "w").mapInArrow(product, "m array<double>").select(F.posexplode("m").alias("at", "v"))
    out = np.zeros(len(mean) ** 2)
    for r in entries.groupBy("at").agg(F.sum("v").alias("v")).collect():  # dimension x dimension entries
        out[r["at"]] = r["v"]
    return out.reshape(len(mean), len(mean))


def fit(distinct: DataFrame) -> Fit | None:
    """The fit of distinct vectors (x, w); none if there are no rows."""
    n, sums = _sums(distinct)
    if not n:
        return None
    cov = _products(distinct, np.array([s / n for s in sums])) / n
    values, axes = np.linalg.eigh((cov + cov.T) / 2)
    return Fit(n, sums, np.maximum(values[::-1], 0), axes[:, ::-1])


def _whitened(distinct: DataFrame, model: Fit, components: int) -> DataFrame:
    """x, w, deviation and z (the components) of each distinct vector."""
    shared = SparkSession.active().sparkContext.broadcast(model)

    def work(batches):
        m = shared.value
        mean, sound = m.mean, m.sound[:components]
        axes = m.axes[:, :components] / np.sqrt(np.where(sound, m.values[:components], 1))
        large = max(map(abs, m.sums), default=0)
        for b in batches:
            if not len(b):
                continue
            x = _matrix(b.column("x"))
            top = m.n * int(np.abs(x.astype(float)).max()) + large
            if top * top * len(m.sums) < 2**62:
                deviation = ((m.n * x - np.array(m.sums)) ** 2).sum(1).tolist()
            else:  # whole numbers of any size
                deviation = ((x.astype(object) * m.n - np.array(m.sums, object)) ** 2).sum(1).tolist()
            z = (x - mean) @ axes
            rows = [[v if s else None for v, s in zip(r, sound, strict=True)] for r in z.tolist()]
            arrays = [b.column("x"), b.column("w"), pa.array([d if d < 2**63 else None for d in deviation], pa.int64()), pa.array(rows, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["x", "w", "deviation", "z"])

    return distinct.select("x", "w").mapInArrow(work, "x array<long>, w long, deviation long, z array<double>")


def identity_error(whitened: DataFrame, sound: list[int]) -> float:
    """The largest absolute entry of the covariance of the sound components minus the identity."""
    if not sound:
        return 0.0
    n = F.sum("w")
    means = whitened.agg(*[(F.sum(F.col("w") * F.col("z")[i]) / n).alias(f"m{i}") for i in sound]).first()
    centred = {i: F.col("z")[i] - means[f"m{i}"] for i in sound}
    pairs = [(i, j) for i in sound for j in sound if i <= j]
    found = whitened.agg(*[(F.sum(F.col("w") * centred[i] * centred[j]) / n).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whiten(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding", components: int = 4, weights: str = "one", scale: int = SCALE) -> DataFrame:
    """The id, component, n, deviation, whitened, explained and identity_error of each row and component; weights: one or count."""
    kept = vectors(rows.select(F.col(id_column), F.col(vector)), vector, scale).select(id_column, "x")
    weight = F.lit(1).cast("long") if weights == "one" else F.count(F.lit(1))
    distinct = saved(kept.groupBy("x").agg(weight.alias("w")))
    model = fit(distinct)
    kind = rows.schema[id_column].dataType.simpleString()
    if model is None:
        return rows.sparkSession.createDataFrame([], f"`{id_column}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    done = saved(_whitened(distinct, model, components))
    top = min(components, len(model.sums))
    error = identity_error(done, [i for i in range(top) if model.sound[i]])
    shares = [float(v / model.trace) if model.trace else 0.0 for v in model.values[:top]]
    # both sides are tables, so that the join may split a vector that very many rows share
    joined = saved(kept).join(done, "x").select(id_column, "deviation", F.posexplode(F.arrays_zip("z", F.array(*map(F.lit, shares)).alias("share"))).alias("at", "one"))
    return joined.select(id_column, (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", F.col("one.z").alias("whitened"), F.col("one.share").alias("explained"), F.lit(error).alias("identity_error"))
