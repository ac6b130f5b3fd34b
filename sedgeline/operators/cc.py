"""Components of an edge list for the engine's own operators, and tables written once for several readers."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame

from .documents import components


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the session's checkpoint folder, in plain local mode to a temporary one where none is set."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and sc.master.startswith("local[") and sc.getCheckpointDir() is None:
        folder = tempfile.mkdtemp(prefix="sedgeline-cc-")
        atexit.register(shutil.rmtree, folder, True)
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def labels(pairs: DataFrame) -> DataFrame:
    """(node, label): the least node that can be reached."""
    return components(kept(pairs))
