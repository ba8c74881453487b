"""Views and saves behind the review applications: queues that hide answers, decisions by key, counts, manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.functions.scalars import md5_modulus
from kelpline.operators.behaviour import visible
from kelpline.operators.merging import latest
from kelpline.operators.sampling import even_sample


def blind_queue(sample: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Sample rows not yet labelled, without held-back columns."""
    return visible(sample).join(labels.select(key).distinct(), key, "left_anti")


def hints(sample: DataFrame, key: str, suggestion: str, chosen: Column) -> DataFrame:
    """key, hint: the model's suggestion, for the rows that may show it."""
    return sample.where(chosen).select(key, F.col(suggestion).alias("hint"))


def saved(labels: DataFrame, new: DataFrame, key: str, at: str) -> DataFrame:
    """Labels after a save: the latest row of each key."""
    return latest(labels.unionByName(new, allowMissingColumns=True), key, at)


def blind_pairs(pairs: DataFrame, key: str) -> DataFrame:
    """key, a, b of two versions (v1, v2) in an order that the key's MD5 parity decides, and who ``a`` is, held back."""
    first = md5_modulus(F.col(key).cast("string"), 2) == 0
    return pairs.select(key, F.when(first, F.col("v1")).otherwise(F.col("v2")).alias("a"), F.when(first, F.col("v2")).otherwise(F.col("v1")).alias("b"), F.when(first, "v1").otherwise("v2").alias("_a_is"))


def decided_source(decisions: DataFrame, pairs: DataFrame, key: str, text: str) -> DataFrame:
    """Where a decided caption comes from: v1 or v2 by equal texts, otherwise a human."""
    t = F.trim(F.col(text))
    source = F.when(t == F.trim("v1"), "v1").when(t == F.trim("v2"), "v2").otherwise("human")
    return decisions.join(pairs.select(key, "v1", "v2"), key).withColumn("source", source).drop("v1", "v2")


def decision_counts(decisions: DataFrame, key: str, at: str, decision: str) -> DataFrame:
    """n of each decision that stands: a later one replaces, "clear" removes."""
    standing = latest(decisions.select(key, at, decision), key, at, F.col(decision) == "clear")
    return standing.groupBy(decision).agg(F.count("*").alias("n"))


def decided_items(decisions: DataFrame, items: DataFrame, key: str, at: str, decision: str) -> DataFrame:
    """Standing decisions with their items' columns; an unknown item's are null."""
    return latest(decisions, key, at, F.col(decision) == "clear").join(items, key, "left")


def labeller_state(masks: DataFrame, source: str, video: str, corrupt: Column) -> DataFrame:
    """By source: masks, distinct videos, corrupt ones."""
    return masks.groupBy(F.coalesce(source, F.lit("human")).alias("source")).agg(F.count("*").alias("n"), F.count_distinct(video).alias("videos"), F.count_if(corrupt).alias("corrupt"))


def negatives(positives: DataFrame, frames: DataFrame, video: str, t: str, per_video: int) -> DataFrame:
    """Even frames of videos, without those that are positives, as rows of label 0 beside label 1."""
    few = even_sample(frames, video, t, per_video).drop("place")
    none = few.join(positives.select(video, t), [video, t], "left_anti").select(video, t).withColumn("label", F.lit(0))
    return positives.select(video, t).withColumn("label", F.lit(1)).unionByName(none)


def release_plan(wanted: DataFrame, files: DataFrame, name: str, length: str, free_bytes: int, headroom: float = 1.15) -> tuple[DataFrame, DataFrame]:
    """(one row: files, missing, bytes, whether they fit with headroom; the missing names)."""
    both = wanted.select(name).distinct().join(files.select(name, length), name, "left")
    sums = both.agg(F.count(length).alias("files"), F.count_if(F.col(length).isNull()).alias("missing"), F.coalesce(F.sum(length), F.lit(0)).alias("bytes"))
    return sums.withColumn("fits", F.col("bytes") * headroom <= free_bytes), both.where(F.col(length).isNull()).select(name)


def model_manifest(files: DataFrame, model: str, path: str, content: str, metrics: DataFrame) -> DataFrame:
    """By model: files, bytes, a digest over its files in order of path (16 digits), and its metrics."""
    rows = files.select(model, path, F.length(content).alias("n"), F.sha2(content, 256).alias("sha"))
    parts = F.array_sort(F.collect_list(F.struct(path, "sha")))  # the files of one model
    own = rows.groupBy(model).agg(F.count("*").alias("files"), F.sum("n").alias("bytes"), F.substring(F.sha2(F.array_join(parts.getField("sha"), ""), 256), 1, 16).alias("digest"))
    return own.join(metrics, model, "left")


def concatenated(parts: list[DataFrame]) -> DataFrame:
    """All rows of several datasets; a column that one lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def contained(part: DataFrame, whole: DataFrame) -> DataFrame:
    """Rows of ``part`` (with their multiplicity) that ``whole`` lacks: empty where it is contained."""
    return part.exceptAll(whole.select(*part.columns))
