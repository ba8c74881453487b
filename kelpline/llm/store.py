"""Intermediate tables and sessions shared by the training-data operators.

Every lineage cut is a Parquet table below the folder the cluster names in
``spark.checkpoint.dir``; it survives a lost executor because all executors
see it.  Only where that setting is absent and the master is local (unit
tests, laptops) is a private temporary folder chosen; on a cluster its absence
is an error.  Tables of a :func:`scratch` are dropped at its end; others stay,
for whoever cleans the folder.
"""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from the session; a fallback where driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (found or _fallback()).rstrip("/")


@lru_cache(maxsize=1)
def _fallback() -> str:
    return tempfile.mkdtemp(prefix="kelpline-")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/kelpline/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and returns a scan of it."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if _open:
        _open[-1].append(path)
        out._scratch_path = path
    return out


_open: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Drops, at its end, the tables materialised within it but for those its function was called with: those that the
    result still reads, which then belong to the scratch around it."""
    own: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        own.remove(df._scratch_path)
        if len(_open) > 1:
            _open[-2].append(df._scratch_path)
        return df

    _open.append(own)
    try:
        yield keep
    finally:
        _open.remove(own)
        make = spark._jvm.org.apache.hadoop.fs.Path
        for path in own:
            make(path).getFileSystem(spark._jsc.hadoopConfiguration()).delete(make(path), True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
