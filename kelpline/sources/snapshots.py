"""Tables with versions: readers hold a version, writers commit the next one or learn that another did.

A version is a small manifest that names the folders of its rows; folders are
never changed once written.  A commit publishes the manifest of the version
after the one it read, by a rename (on a local path, a link) that fails where
that version exists; the loser reads the winner's version and does its change
again.  So a reader sees one whole version at any time, also between two
commits, and a writer that dies leaves folders that no manifest names.

With a key the rows lie in buckets by its hash, and an upsert rewrites only
the buckets its rows fall into.  Marks in the manifest tell which batch of a
stream a version holds: a batch that is replayed changes nothing.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_BUCKET = "__bucket"


class Conflict(RuntimeError):
    """Another writer committed the version."""


class Table:
    """A versioned table below ``path``; ``key`` columns and ``buckets`` hold for its life."""

    def __init__(self, spark: SparkSession, path: str, key: list[str] | None = None, buckets: int = 16):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key or [], buckets if key else 1
        self._make = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._make(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        log = self._make(f"{self.path}/log")
        if not self._fs.exists(log):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(log)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))

    def version(self) -> int:
        """The latest version, 0 before the first."""
        return max(self.versions(), default=0)

    def manifest(self, version: int) -> dict:
        if version == 0:
            return {"version": 0, "schema": None, "parts": {}, "marks": {}}
        stream = self._fs.open(self._make(f"{self.path}/log/{version:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """Rows of a version, the latest unless given."""
        held = self.manifest(self.version() if version is None else version)
        if held["schema"] is None:
            raise ValueError(f"{self.path} has no version yet")
        parts = [f"{self.path}/{p}" for b, p in sorted(held["parts"].items()) if buckets is None or int(b) in buckets]
        schema = StructType.fromJson(held["schema"])
        return self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(_BUCKET, F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int") if self.key else F.lit(0))

    def _store(self, rows: DataFrame) -> dict[str, str]:
        """Writes a new folder; the buckets it holds."""
        folder = f"data/{uuid.uuid4().hex}"
        self._bucketed(rows).write.partitionBy(_BUCKET).parquet(f"{self.path}/{folder}")
        names = [s.getPath().getName() for s in self._fs.listStatus(self._make(f"{self.path}/{folder}"))]
        return {n.partition("=")[2]: f"{folder}/{n}" for n in names if n.startswith(f"{_BUCKET}=")}

    def _publish(self, manifest: dict) -> None:
        log = f"{self.path}/log"
        target, staged = self._make(f"{log}/{manifest['version']:012d}.json"), self._make(f"{log}/.{uuid.uuid4().hex}")
        self._fs.mkdirs(self._make(log))
        out = self._fs.create(staged, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        try:
            if self._fs.getUri().getScheme() == "file":
                os.link(staged.toUri().getPath(), target.toUri().getPath())
            else:
                jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
                kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
                options = gateway.new_array(kind, 1)
                options[0] = getattr(kind, "NONE")
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(staged, target, options)
        except FileExistsError as e:
            raise Conflict(str(target)) from e
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            raise Conflict(str(target)) from e
        finally:
            self._fs.delete(staged, False)

    def _commit(self, base: dict, schema: StructType, fresh: dict[str, str], touched: set[str] | None, marks: dict) -> int:
        kept = {} if touched is None else {b: p for b, p in base["parts"].items() if b not in touched}
        nxt = {"version": base["version"] + 1, "schema": json.loads(schema.json()), "parts": {**kept, **fresh}, "marks": {**base["marks"], **marks}}
        try:
            self._publish(nxt)
        except Conflict:
            for folder in {p.rpartition("/")[0] for p in fresh.values()}:
                self._fs.delete(self._make(f"{self.path}/{folder}"), True)
            raise
        return nxt["version"]

    def write(self, rows: DataFrame, base: int | None = None, marks: dict | None = None) -> int:
        """``rows`` as the version after ``base`` (the latest): :class:`Conflict` where another writer was first."""
        held = self.manifest(self.version() if base is None else base)
        return self._commit(held, rows.schema, self._store(rows), None, marks or {})

    def update(self, change: Callable[[DataFrame], DataFrame], attempts: int = 5) -> int:
        """Commits ``change`` of the latest rows, done again on a newer version where another writer was first."""
        return self._retried(lambda base: self.write(change(self.read(base)), base), attempts)

    def upsert(self, rows: DataFrame, at: list[str], mark: tuple[str, int] | None = None, attempts: int = 5) -> int:
        """Last wins: of each key the row with the greatest ``at``, of the table's and the new ones; null times rank lowest, the
        table's row wins ties. With a mark (stream, batch) a batch is taken once. The version that holds the rows.

        Keys are unique in the table, new rows are reduced to one a key before they meet it, map side first.
        """
        if not self.key:
            raise ValueError("an upsert needs a table with a key")

        def once(base: int) -> int:
            held = self.manifest(base)
            if mark and held["marks"].get(mark[0], -1) >= mark[1]:
                return base
            own = self._bucketed(rows)
            touched = [r[0] for r in own.select(_BUCKET).distinct().collect()]  # at most as many as buckets
            if not touched:
                return base
            new = self._last(rows.withColumn("__old", F.lit(0)), at)
            both = new if held["schema"] is None else new.unionByName(self.read(base, touched).withColumn("__old", F.lit(1)))
            merged = self._last(both, at).drop("__old")
            return self._commit(held, rows.schema, self._store(merged.select(*rows.columns)), {str(b) for b in touched}, dict([mark] if mark else []))

        return self._retried(once, attempts)

    def _last(self, rows: DataFrame, at: list[str]) -> DataFrame:
        rest = [c for c in rows.columns if c not in self.key]
        order = F.struct(*[F.struct(F.col(c).isNotNull(), F.col(c)) for c in at], F.col("__old"))
        return rows.groupBy(*self.key).agg(F.max_by(F.struct(*rest), order).alias("__row")).select(*self.key, "__row.*")

    def _retried(self, once: Callable[[int], int], attempts: int) -> int:
        for k in range(attempts):
            try:
                return once(self.version())
            except Conflict:
                if k + 1 == attempts:
                    raise
        raise ValueError("attempts must be positive")

    def expire(self, keep: int = 1) -> None:
        """Drops all but the last ``keep`` versions, and the folders that only those named."""
        every = self.versions()
        old, kept = every[:-keep], every[-keep:]
        folders = lambda vs: {p for v in vs for p in self.manifest(v)["parts"].values()}
        gone = folders(old) - folders(kept)
        for v in old:
            self._fs.delete(self._make(f"{self.path}/log/{v:012d}.json"), False)
        for p in gone:
            self._fs.delete(self._make(f"{self.path}/{p}"), True)


def upsert_stream(stream: DataFrame, into: Table, at: list[str], checkpoint: str, *, name: str, late: str | None = None) -> None:
    """Runs a stream to its end into ``into``, batch by batch, last wins. A batch that is run again, after a failure between its
    commit and the checkpoint's, changes nothing. With ``late`` copies of a key and time that come within that time of each
    other are dropped before they reach the merge, and rows later than that with them."""
    rows = stream if late is None else stream.withWatermark(at[0], late).dropDuplicatesWithinWatermark([*into.key, at[0]])

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            into.upsert(batch, at, (name, number))
        finally:
            batch.unpersist()

    rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
