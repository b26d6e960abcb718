"""Written tables in the folder that driver and executors share.

Iterative jobs cut their lineage by writing a Parquet table and reading it back, so a lost
executor costs a re-read and never a re-run of earlier rounds.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
#: Spark's own setting that ends a query's shuffle files with the query.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one on a local master where none is set."""
    sc = spark.sparkContext
    named = sc.getConf().get(SETTING) or sc.getCheckpointDir()
    if not named:
        if sc.master.partition("[")[0] != "local":
            raise ValueError(f"set {SETTING} to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tokentide-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Queries made and run within let go of their shuffle files as they end, not when the driver collects its garbage."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def write_table(df: DataFrame, path: str) -> None:
    """Write ``df`` as Parquet and let go of its shuffle files: who reads the table needs them no more."""
    with released(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of what was written."""
    path = new_path(df.sparkSession, name)
    write_table(df, path)
    scan = df.sparkSession.read.schema(df.schema).parquet(path)
    scan.scratch_path = path
    return scan


def discard(table: DataFrame) -> None:
    """Remove the files of a table from ``written`` that no later plan reads."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
