"""Sources for Spark's reader and table functions for SQL: listings of clip trees, frames of stored stacks."""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.functions import udtf

_DATE = {
    EqualTo: lambda d, v: d == v,
    GreaterThan: lambda d, v: d > v,
    GreaterThanOrEqual: lambda d, v: d >= v,
    LessThan: lambda d, v: d < v,
    LessThanOrEqual: lambda d, v: d <= v,
    In: lambda d, v: d in v,
}


def _store(path: str):
    """File system and path of a URI; a path without a scheme is a local one."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    return fs.FileSystem.from_uri(path)


def _label(name: str) -> str:
    """A folder's value: what follows ``=`` in ``date=2024-01-01``, else the name."""
    return name.partition("=")[2] or name


@dataclass
class Dates(InputPartition):
    folders: list[str]


class ListingReader(DataSourceReader):
    """A task lists some date folders; folders whose date a filter excludes aren't touched."""

    def __init__(self, path: str, dates: int):
        self.path, self.dates, self.tests = path, dates, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _DATE and f.attribute == ("date",):
                self.tests.append((_DATE[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[Dates]:
        from pyarrow import fs

        store, root = _store(self.path)
        folders = sorted(i.path for i in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if i.type == fs.FileType.Directory and i.base_name[0] not in "._")
        folders = [p for p in folders if all(test(_label(p.rpartition("/")[2]), v) for test, v in self.tests)]
        return [Dates(folders[k : k + self.dates]) for k in range(0, len(folders), self.dates)] or [Dates([])]

    def read(self, partition: Dates) -> Iterator[tuple]:
        from pyarrow import fs

        store, _ = _store(self.path)
        for folder in partition.folders:
            for i in store.get_file_info(fs.FileSelector(folder, recursive=True)):
                inner = i.path[len(folder) + 1 :].split("/")
                if i.type == fs.FileType.File and not any(part[0] in "._" for part in inner):
                    yield _label(folder.rpartition("/")[2]), _label(inner[0]) if len(inner) > 1 else None, i.path, i.base_name, i.size


class ListingSource(DataSource):
    """``format("clip_listing")``: files of a tree ``root/date/camera/...``, hidden ones left out. Option ``dates``: date folders a task (16)."""

    @classmethod
    def name(cls) -> str:
        return "clip_listing"

    def schema(self) -> str:
        return "date string, camera string, path string, name string, bytes bigint"

    def reader(self, schema) -> ListingReader:
        return ListingReader(self.options["path"], int(self.options.get("dates", "16")))


def clip_listing(spark: SparkSession, path: str, dates: int = 16) -> DataFrame:
    """The listing as rows; conditions on ``date`` decide which folders are read at all."""
    spark.dataSource.register(ListingSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("clip_listing").option("dates", dates).load(path)


@udtf(returnType="frame int, t double, shape array<int>, pixels array<float>")
class Frames:
    """``frames(content, rate, fps)``: the frames of an ``.npy`` stack of ``rate`` frames a second, sampled at ``fps``: of each instant
    k / fps the frame shown then. A rate of ``fps`` or less gives every frame once. Null content gives no rows."""

    def eval(self, content: bytes, rate: float, fps: float):
        import numpy as np

        if content is None:
            return
        if not rate or not fps or rate <= 0 or fps <= 0:
            raise ValueError("rates are positive")
        stack = np.load(io.BytesIO(content), allow_pickle=False)
        step = max(rate / fps, 1.0)
        k = 0
        while (at := int(k * step + 1e-9)) < len(stack):
            yield at, at / rate, list(stack.shape[1:]), stack[at].astype(np.float32).ravel().tolist()
            k += 1


def register(spark: SparkSession) -> None:
    """Makes ``frames`` known to SQL, for lateral joins with files or tables of stacks."""
    spark.udtf.register("frames", Frames)


def stacks(rows: DataFrame, clip: str, order: str, vector: str) -> DataFrame:
    """clip, content: the vectors of each clip in order as one ``.npy`` stack. A clip is one recording and one row."""
    import numpy as np
    import pandas as pd

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        np.save(out, np.stack([np.asarray(v, np.float32) for v in pdf.sort_values(order)[vector]]))
        return pd.DataFrame({clip: pdf[clip].iloc[:1], "content": [out.getvalue()]})

    return rows.select(clip, order, vector).groupBy(clip).applyInPandas(pack, f"{clip} {rows.schema[clip].dataType.simpleString()}, content binary")
