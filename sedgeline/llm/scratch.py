"""Intermediate tables and checked broadcasts shared by the corpus operators.

Lineage is cut by writing Parquet into the shared folder named by
``spark.checkpoint.dir``, so a lost executor never takes the only copy of an
intermediate result with it.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes up to which a side is broadcast; beyond either the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32 << 20

_local_dirs: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared scratch folder of this session.

    ``spark.checkpoint.dir`` wins. Where it is unset a temporary folder is used,
    but only in plain local mode, where driver and executors share one machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    sc = spark.sparkContext
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = sc.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="sedgeline-")
        atexit.register(shutil.rmtree, _local_dirs[app], True)
    return _local_dirs[app]


def clear(spark: SparkSession) -> None:
    """Deletes all intermediate tables of the corpus operators; call it when no DataFrame of theirs is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/sedgeline")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables of one operator call; ``put`` writes and rereads, ``drop`` and ``keep`` delete what is no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_dir(spark)}/sedgeline/{name}-{uuid.uuid4().hex}"
        self.n = 0
        self.paths: set[str] = set()

    def put(self, df: DataFrame, files: int | None = None) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}"
        (df if files is None else df.coalesce(files)).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self.paths.add(path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        self._delete({t._scratch_path for t in tables})

    def keep(self, *tables: DataFrame) -> None:
        """Deletes all tables of this call but these, which its result reads."""
        self._delete(self.paths - {t._scratch_path for t in tables})

    def _delete(self, paths: set[str]) -> None:
        for p in paths:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.paths -= paths


def _bytes(c: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return 16 + F.coalesce(F.octet_length(c), F.lit(0))
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        if isinstance(inner, T.StringType | T.BinaryType | T.ArrayType | T.StructType):
            each = F.aggregate(F.transform(c, lambda x: _bytes(x, inner).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
        else:
            each = 8 * F.size(c)
        return 16 + F.coalesce(F.when(c.isNotNull(), each), F.lit(0))
    if isinstance(kind, T.StructType):
        return 8 + sum((_bytes(c[f.name], f.dataType) for f in kind.fields), F.lit(0))
    return F.lit(8)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a count of its rows and bytes shows that ``df`` can be broadcast; it stops at the first row too many."""
    size = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(0)).cast("long")
    n, total = df.select(size.alias("b")).limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum("b"), F.lit(0))).first()
    return n <= rows and total <= BROADCAST_BYTES


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if ``is_small``, else as it is (the join then shuffles)."""
    return F.broadcast(df) if is_small(df, rows) else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
