"""Session helpers: the shared scratch folder, written intermediates and size checks."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

SMALL_SIDE_ROWS = 200_000
_open = threading.local()


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``). Only a local-mode session may fall back to a temporary one."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder that every executor can reach.")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="telltale-"))
    return sc.getCheckpointDir().rstrip("/")


def materialise(df: DataFrame, name: str, schema: StructType | None = None, compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage, survives executor loss, and, unlike ``checkpoint()``, keeps column pruning and size statistics. With a ``schema``
    the table is read as that, so that a user-defined type is read as its fields or the other way round. ``compression`` is Parquet's; by default the session's.
    """
    spark = df.sparkSession
    base = getattr(_open, "scope", None) or f"{scratch_dir(spark)}/telltale"
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(schema or df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete a table that ``materialise`` wrote and that nothing reads any more."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        delete_folder(df.sparkSession, path)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[str]:
    """What this thread materialises inside goes to one folder, which is deleted at the end.

    For a run that writes its own result: nothing may be read from a table of the scope afterwards.
    """
    outer = getattr(_open, "scope", None)
    path = _open.scope = f"{outer or scratch_dir(spark) + '/telltale'}/scope-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        _open.scope = outer
        delete_folder(spark, path)


def delete_folder(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def write_whole(df: DataFrame, path: str) -> None:
    """Write ``df`` as Parquet beside ``path`` under a name that readers skip, then put it in place of what is there: nobody sees a part of it."""
    spark = df.sparkSession
    folder, _, name = path.rstrip("/").rpartition("/")
    jvm = spark.sparkContext._jvm
    source, target = (jvm.org.apache.hadoop.fs.Path(p) for p in (f"{folder}/_{name}-{uuid.uuid4().hex}", path))
    df.write.parquet(source.toString())
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.delete(target, True)
    if not files.rename(source, target):
        raise OSError(f"Could not move the written table to {path}.")


def is_small(df: DataFrame, max_rows: int = SMALL_SIDE_ROWS) -> bool:
    """True if ``df`` has at most ``max_rows`` rows; reads no more than that many plus one."""
    return df.limit(max_rows + 1).count() <= max_rows


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for costly per-row work on a source that is read in fewer pieces than that; otherwise leave it alone."""
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df
