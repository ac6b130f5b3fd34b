"""Makes this package importable in Python workers that do not have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()

#: Session setting that, set to ``false``, leaves the settings below as they are.
BOUND = "sedgeline.boundBatches"
#: Session settings that bound a batch sent to a Python worker: Spark's default, and ours where it is still the default.
BATCHES = {
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4194304b"),
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"),
}


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once per application, and bound the batches they get unless ``BOUND`` forbids it."""
    for name, (default, ours) in BATCHES.items():
        if spark.conf.get(BOUND, "true") != "false" and spark.conf.get(name, default) == default:
            spark.conf.set(name, ours)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="sedgeline-src-"), "sedgeline_src.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    spark.sparkContext.addPyFile(path)
