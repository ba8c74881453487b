"""Intermediate tables: a lineage ends in a table below the folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _own() -> str:
    return tempfile.mkdtemp(prefix="kelpline-")


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one; below a temporary one where none is set and driver and executors are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _own()
    return f"{base.rstrip('/')}/kelpline/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def stages(spark: SparkSession, name: str) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function that writes a table and reads it again; at the end all of them go."""
    base, count = folder(spark, name), iter(range(1 << 30))
    try:
        yield lambda df: written(df, f"{base}/{next(count)}")
    finally:
        make = spark._jvm.org.apache.hadoop.fs.Path
        make(base).getFileSystem(spark._jsc.hadoopConfiguration()).delete(make(base), True)
