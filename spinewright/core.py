"""Session helpers shared by all operators: shared-folder materialisation and size-checked joins."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast. The callers' rows are a few longs wide, so this is tens of MB at most.
BROADCAST_ROWS = 500_000
_local_root: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. Where none is set, a temporary folder on a local master (tests, one machine);
    on a cluster that would be each executor's own disk, so it is refused."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not re.match(r"local(\[|$)", master):
        raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors share: the master is {master}")
    if not _local_root:
        _local_root.append(tempfile.mkdtemp(prefix="spinewright-"))
        atexit.register(shutil.rmtree, _local_root[0], ignore_errors=True)
    return f"file://{_local_root[0]}"


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/spinewright/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, kind: str = "table") -> str:
    """A new path in the application's part of the shared folder."""
    return f"{_own_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def cleanup(spark: SparkSession) -> bool:
    """Delete what this application has written to the shared folder, once no result of it is read any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage and survives lost executors. The table stays
    until :func:`cleanup`."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized_join(big: DataFrame, small: DataFrame, on: list[str] | str | Column, how: str = "inner", limit: int = BROADCAST_ROWS, rows: int | None = None) -> DataFrame:
    """Join with ``small`` broadcast only when its counted rows are within ``limit``; otherwise a shuffle join,
    whose skewed keys adaptive execution splits. ``small`` should be materialised, as it is counted first, unless
    the caller has counted: its ``rows``, or where rows differ in width its bytes, against a ``limit`` in bytes."""
    n = small.count() if rows is None else rows
    return big.join(F.broadcast(small) if n <= limit else small.hint("merge"), on, how)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
