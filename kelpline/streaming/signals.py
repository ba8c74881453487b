"""Structured Streaming: windows, sessions, work rounds, commits. Scans that keep state are in :mod:`kelpline.streaming.scans`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def event_stream(spark: SparkSession, folder: str, schema: StructType, time: str = "ts", files_per_trigger: int = 1) -> DataFrame:
    """Files of a folder as a stream; a time without zone becomes an instant of the session's zone, as watermarks need."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet").parquet(folder)
    return raw.withColumn(time, F.col(time).cast("timestamp"))


def tumbling(events: DataFrame, time: str, by: str, value: str, *, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums by window; a window is emitted when the watermark passes it."""
    w = F.window(time, width)
    return events.withWatermark(time, late).groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, time: str, by: str, *, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    s = F.session_window(time, gap)
    return events.withWatermark(time, late).groupBy(s.alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs an append stream over what there is and returns what it wrote; a later run goes on from the checkpoint."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def work_rounds(todo, work, save, *, most: int | None = None) -> int:
    """Repeats work on what is open until nothing is, or a round gets nowhere, or ``most`` rounds are done; returns rounds.
    ``todo()`` is an anti join of candidates and done."""
    before, k = None, 0
    while most is None or k < most:
        open_ = todo()
        n = open_.count()
        if n == 0 or n == before:
            break
        save(work(open_))
        before, k = n, k + 1
    return k


def attempts_open(cells: DataFrame, done: DataFrame, attempts: DataFrame, keys: list[str], most: int = 3) -> DataFrame:
    """Cells neither done nor tried ``most`` times."""
    tried = attempts.groupBy(*keys).agg(F.count("*").alias("__n"))
    return cells.join(done.select(*keys).distinct(), keys, "left_anti").join(tried, keys, "left").where(F.coalesce("__n", F.lit(0)) < most).drop("__n")


def sliding(events: DataFrame, time: str, by: str, value: str, *, width: str = "1 day", slide: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Counts and sums by overlapping windows."""
    w = F.window(time, width, slide)
    return events.withWatermark(time, late).groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


class OutOfCredit(RuntimeError):
    """The remote service takes no more calls: the run ends, what was saved stays."""


def work_until_refused(todo, work, save, refused, *, most: int | None = None) -> int:
    """:func:`work_rounds`, but a round whose results hold a refusal (``refused`` is a condition on them) is saved and ends the run."""

    def checked(rows: DataFrame) -> None:
        rows = rows.persist()
        try:
            stop = not rows.where(refused).isEmpty()
            save(rows.where(~refused))
        finally:
            rows.unpersist()
        if stop:
            raise OutOfCredit("the service refused further calls")

    return work_rounds(todo, work, checked, most=most)


def on_progress(spark: SparkSession, call):
    """Calls ``call(name, batch, rows)`` after each micro-batch of any stream, until the returned listener is removed."""
    from pyspark.sql.streaming.listener import StreamingQueryListener

    class Listener(StreamingQueryListener):
        def onQueryStarted(self, event):
            pass

        def onQueryProgress(self, event):
            call(event.progress.name, event.progress.batchId, event.progress.numInputRows)

        def onQueryIdle(self, event):
            pass

        def onQueryTerminated(self, event):
            pass

    listener = Listener()
    spark.streams.addListener(listener)
    return listener


def saved_batches(stream: DataFrame, save, commit, checkpoint: str) -> None:
    """Each micro-batch is saved, then ``commit(batch_id)`` is called: after a failure between them the batch is saved again."""

    def each(rows: DataFrame, batch: int) -> None:
        save(rows, batch)
        commit(batch)

    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
