"""Tables on the way: written to the folder that driver and executors share, and removed when they have served."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: The folder of the innermost open scratch().
_SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)
#: The folder that stands in for an absent setting on one machine.
_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir, which the driver and all executors see.

    Where the setting is absent and all runs on one machine (tests), a temporary folder is made once; a cluster
    must name one.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="vox-shared-"))
        base = _LOCAL[0]
    return f"{base.rstrip('/')}/vox-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """`df` written to `path` and read back; zstd, since disk is dearer here than the little CPU it takes."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back: later steps neither recompute it nor depend
    on an executor's local blocks. Inside scratch() it goes when that ends."""
    top = _SCRATCH.get()
    return stored(df, f"{top}/{uuid.uuid4().hex}" if top else shared_dir(df.sparkSession))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, by whatever file system Spark has for it."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What is materialized inside is removed at the end. Yields the function that stores what is to stay."""
    outer, own = _SCRATCH.get(), shared_dir(spark)
    token = _SCRATCH.set(own)
    try:
        yield lambda df: stored(df, f"{outer}/{uuid.uuid4().hex}" if outer else shared_dir(spark))
    finally:
        _SCRATCH.reset(token)
        remove(spark, own)


@contextmanager
def within(path: str) -> Iterator[None]:
    """What is materialized inside is stored below `path`, which the caller removes."""
    token = _SCRATCH.set(path)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
