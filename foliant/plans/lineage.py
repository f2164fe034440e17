"""Shared working folder and lineage cuts that survive the loss of executors."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; where it is unset (tests, a laptop), one in the warehouse.

    The warehouse is the other place every executor has to reach, so neither
    choice depends on a machine's own temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged"


_STAGED: dict[str, list[str]] = {}  # folders made by each application


def _made(spark: SparkSession) -> list[str]:
    return _STAGED.setdefault(spark.sparkContext.applicationId, [])


def new_dir(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _made(spark).append(path)
    return path


@contextmanager
def staged(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what was staged within it (a micro-batch, say)."""
    before = len(_made(spark))
    try:
        yield
    finally:
        _delete(spark, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder (loops would otherwise grow their plan)."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def materialize(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared working folder (in folders of the column ``by``) and read it back.

    Used where several consumers need the same expensive columns: they then scan
    a pruned Parquet table instead of repeating the work.
    """
    path = new_dir(df.sparkSession, label)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_in = path
    return out


def materialize_parts(parts: Iterable[DataFrame], label: str) -> DataFrame:
    """Like ``materialize``, for a table made part by part: the shuffle of one part is gone before the next one starts."""
    path = None
    for df in parts:
        spark, schema = df.sparkSession, df.schema
        path = path or new_dir(spark, label)
        df.write.mode("append").parquet(path)
        del df
        release_shuffles(spark)
    out = spark.read.schema(schema).parquet(path)
    out._staged_in = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the folders of tables made by ``materialize`` that nothing reads any more (others are left alone)."""
    for t in tables:
        path = getattr(t, "_staged_in", None)
        if path is not None and path in _made(t.sparkSession):
            _made(t.sparkSession).remove(path)
            _remove(t.sparkSession, path)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs whose frames nothing holds any more.

    Its cleaner follows the driver's garbage collector, which by itself may not run before a job has filled the disk.
    """
    gc.collect()
    spark._jvm.System.gc()


def clear_staged(spark: SparkSession) -> None:
    """Delete what this application wrote with ``new_dir``; call it when the results are no longer read."""
    _delete(spark, 0)


def _delete(spark: SparkSession, keep: int) -> None:
    made = _made(spark)
    while len(made) > keep:
        _remove(spark, made.pop())


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
