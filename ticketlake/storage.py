"""Shared folder for tables that cut lineage between the passes of a job."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


# the folder of local sessions that name none
_local: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a session that names none, such as a test's, gets a local folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="ticketlake-"))
        folder = _local[0]
    return folder.rstrip("/")


# folders handed out and not cleared yet: by the run at hand, or outside any run
_handed_out: ContextVar[list[str]] = ContextVar("handed_out", default=[])


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other job uses."""
    path = f"{shared_folder(spark)}/ticketlake/{name}-{uuid.uuid4().hex}"
    _handed_out.get().append(path)
    return path


def clear(spark: SparkSession) -> None:
    """Delete what was staged in this run, or outside any; call it when no result is needed any more."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    folders = _handed_out.get()
    while folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folders.pop())
        path.getFileSystem(hadoop).delete(path, True)


@contextmanager
def staged_run(spark: SparkSession) -> Iterator[None]:
    """What is staged inside belongs to this run and is deleted at its end, nothing else."""
    token = _handed_out.set([])
    try:
        yield
    finally:
        clear(spark)
        _handed_out.reset(token)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The stored table keeps column pruning for the passes that follow and
    outlives lost executors.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
