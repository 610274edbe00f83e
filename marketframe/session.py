"""Makes the package importable in Python workers, wherever they run."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Hands the package to the executors, once an application, by Spark's own file server; sets smaller Arrow batches unless the user has set a size."""
    if spark.conf.get(BATCH) == "10000":  # Spark's own default: too many where a row is a whole text
        spark.conf.set(BATCH, "1000")
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).parent
        target = Path(tempfile.mkdtemp()) / "marketframe.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, Path(root.name) / p.relative_to(root))
        context.addPyFile(str(target))
        _shipped.add(context.applicationId)
    return spark
