"""Keyed joins between records, indexes, labels and files. Lookups keep the left side's rows; nothing is broadcast by hint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.functions.scalars import clock_hour, path_tail
from kelpline.operators.merging import latest


def with_clock(records: DataFrame, index: DataFrame, key: str, order: str, segment: str, start: str) -> DataFrame:
    """Records with the hour of their clip by the index; of several index rows the last counts, a miss has a null hour."""
    once = latest(index.select(key, order, F.col(segment).alias("__segment"), F.col(start).alias("__start")), key, order).drop(order)
    return records.join(once, key, "left").withColumn("hour", clock_hour(F.col("__segment"), F.col("__start"))).drop("__segment", "__start")


def on_disk(index: DataFrame, files: DataFrame, path: str, file_path: str) -> DataFrame:
    """Index rows whose last three path parts are those of a file."""
    have = files.select(path_tail(F.col(file_path)).alias("__tail")).distinct()
    return index.withColumn("__tail", path_tail(F.col(path))).join(have, "__tail", "left_semi").drop("__tail")


def looked_up(rows: DataFrame, table: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with some columns of a table that has each key once; null where it lacks the key."""
    return rows.join(table.select(key, *columns), key, "left")


def seed_frames(frames: DataFrame, manifests: list[tuple[DataFrame, str]], image: str, seed: str) -> DataFrame:
    """Frames with the seed frame that the label manifests give their image; null where none does, or the row that counts has none.

    A manifest is rows and the column that orders them; of an image's rows the last of the last manifest counts. Rows are reduced
    to one an image, map side first, before they meet the frames.
    """
    from functools import reduce

    named = [rows.select(image, F.struct(F.lit(k).alias("k"), F.col(order).cast("long").alias("o")).alias("__at"), F.struct(seed).alias("__row")) for k, (rows, order) in enumerate(manifests)]
    last = reduce(DataFrame.unionByName, named).where(F.col(image).isNotNull()).groupBy(image).agg(F.max_by("__row", "__at").alias("__row"))
    return frames.drop(seed).join(last, image, "left").withColumn(seed, F.col(f"__row.{seed}")).drop("__row")


def labelled(human: DataFrame, sample: DataFrame, key: str) -> DataFrame:
    """Labels that weren't skipped, of the frozen sample's rows, with the sample's columns."""
    return human.where(~F.coalesce(F.col("skipped"), F.lit(False))).join(sample, key)


def by_population(human: DataFrame, manifest: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Labels on the manifest's rows; those the model was trained on form a population of their own."""
    population = F.when(F.col(split) == "train", "train_CONTAMINATED").otherwise(F.col(split))
    return human.join(manifest, key).withColumn("population", population)


def secondary(manifest: DataFrame, human: DataFrame, key: str, label: str, split: str = "split") -> DataFrame:
    """Manifest rows that humans labelled, as a split of their own, with the human's label."""
    return manifest.drop(split, label).join(human.select(key, label), key).withColumn(split, F.lit("human_secondary"))


def paired_versions(first: DataFrame, second: DataFrame, key: str, text: str, exists: DataFrame) -> DataFrame:
    """key, v1, v2 of what both versions describe and still exists."""
    a, b = first.select(key, F.col(text).alias("v1")), second.select(key, F.col(text).alias("v2"))
    return a.join(b, key).join(exists.select(key).distinct(), key, "left_semi")


def updated(records: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """Records whose ``column`` is the update's where there is one, and stays otherwise."""
    new = updates.select(key, F.col(column).alias("__new"))
    old = F.col(column) if column in records.columns else F.lit(None)
    return records.join(new, key, "left").withColumn(column, F.coalesce("__new", old)).drop("__new")


def in_all_arms(arms: list[DataFrame], key: str) -> list[DataFrame]:
    """Each arm without the keys that any arm lacks: a row missing from one is excluded from all."""
    from functools import reduce

    common = reduce(lambda a, b: a.join(b, key, "left_semi"), [arm.select(key).distinct() for arm in arms])
    return [arm.join(common, key, "left_semi") for arm in arms]


def outside_sessions(rows: DataFrame, train: DataFrame, date: str, segment: str) -> DataFrame:
    """Rows of no training session; a session is a date and the hour and minute its segment begins with."""
    minute = F.substring(F.regexp_replace(F.col(segment), "[^0-9]", ""), 1, 4)
    session = lambda df: df.withColumns({"__d": F.col(date).cast("string"), "__m": minute})
    return session(rows).join(session(train).select("__d", "__m").distinct(), ["__d", "__m"], "left_anti").drop("__d", "__m")


def three_raters(truth: DataFrame, teacher: DataFrame, student: DataFrame, key: str, label: str) -> DataFrame:
    """key, truth, teacher, student of what all three labelled."""
    named = [df.select(key, F.col(label).alias(n)) for df, n in ((truth, "truth"), (teacher, "teacher"), (student, "student"))]
    return named[0].join(named[1], key).join(named[2], key)


def forced_sides(clips: DataFrame, anchors: DataFrame, video: str, side: str) -> DataFrame:
    """One side a video over two corpora; a video of both keeps the clips' side."""
    a, b = clips.select(video, F.col(side).alias("__a")).distinct(), anchors.select(video, F.col(side).alias("__b")).distinct()
    return a.join(b, video, "full").select(video, F.coalesce("__a", "__b").alias(side))


# --- predicates ------------------------------------------------------------------


def between_dates(date: Column, first: str | None, last: str | None) -> Column:
    """Inclusive on both ends, over ISO dates; a missing bound admits all."""
    text = date.cast("string")
    return (text >= first if first else F.lit(True)) & (text <= last if last else F.lit(True))


def from_source(source: Column, wanted: str, image: Column, default: str = "human") -> Column:
    """Manifest rows of one source that have an image; a missing source is the default."""
    return (F.coalesce(source, F.lit(default)) == wanted) & image.isNotNull()


def not_skipped(skipped: Column) -> Column:
    return ~F.coalesce(skipped, F.lit(False))


def whole_clips(rows: DataFrame, frames: str, least: int = 37) -> DataFrame:
    """Rows of clips that aren't cut short, old rows too: a view, not a step at ingest."""
    return rows.where(F.col(frames) >= least)


def camera_of(name: Column, cameras: list[str]) -> Column:
    """The first listed camera that a name contains; null for none."""
    return F.coalesce(*[F.when(F.contains(name, F.lit(c)), F.lit(c)) for c in cameras])


def well_voted(n_passes: Column, voted: Column, passes: int = 5) -> Column:
    return F.coalesce((n_passes == passes) & voted, F.lit(False))
