"""Splits, quotas and draws. Randomness is a hash of the key, so a draw is the same on every run and cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kelpline.functions.scalars import md5_modulus


def hash_split(rows: DataFrame, key: Column, held_share: float) -> DataFrame:
    """Whole groups to ``val`` where the key's MD5 modulo 1000 is below the share."""
    return rows.withColumn("split", F.when(md5_modulus(key, 1000) < int(held_share * 1000), "val").otherwise("train"))


def shuffled(key: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), key.cast("string")))


def before_in_order(groups: DataFrame, key: str, amount: Column, seed: str) -> DataFrame:
    """``groups`` with ``__before``, the sum of ``amount`` over what precedes a group in hashed order, and ``__all``, over all.

    Hashes spread evenly over 4,096 ranges by their first digits: sums by range, running sums over those rows and within
    each range, so no task orders all groups.
    """
    h = shuffled(F.col(key), seed)
    rows = groups.withColumns({"__h": h, "__range": F.substring(h, 1, 3), "__a": amount})
    upto = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("__range").agg(F.sum("__a").alias("__s")).select("__range", F.coalesce(F.sum("__s").over(upto), F.lit(0)).alias("__lower"), F.sum("__s").over(Window.partitionBy()).alias("__all"))
    own = Window.partitionBy("__range").orderBy("__h", key).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(F.broadcast(ranges), "__range").withColumn("__before", F.col("__lower") + F.coalesce(F.sum("__a").over(own), F.lit(0)))


def quota_split(groups: DataFrame, key: str, amount: str, quota: int, seed: str) -> DataFrame:
    """Whole groups, in hashed order, to train until what went before reaches the quota. Groups are aggregated first: one row each."""
    placed = before_in_order(groups, key, F.col(amount), seed)
    return placed.select(key, amount, F.when(F.col("__before") < quota, "train").otherwise("test").alias("split"))


def fraction_split(groups: DataFrame, key: str, share: float, seed: str, forced: list) -> DataFrame:
    """The first ``share`` of hashed groups, and the forced ones, are test."""
    placed = before_in_order(groups, key, F.lit(1), seed)
    first = F.col("__before") + 1 <= F.floor(F.col("__all") * share)
    return placed.select(key, F.when(first | F.col(key).isin(forced), "test").otherwise("train").alias("split"))


def round_robin(rows: DataFrame, group: str, key: str, *, most: int, limit: int, seed: str) -> DataFrame:
    """First one row of each group, then a second, up to ``most``; ``limit`` rows in all."""
    w = Window.partitionBy(group).orderBy("__h", key)
    rows = rows.withColumn("__h", shuffled(F.col(key), seed)).withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= most)
    return rows.orderBy("turn", shuffled(F.col(group), seed), group).limit(limit).drop("__h")


def even_places(n: Column, k: int, rounding: str = "floor") -> Column:
    """k even places among n, ends included; ``floor`` cuts, ``round`` rounds half to even."""
    if k == 1:
        return F.array(F.lit(0))
    f = F.floor if rounding == "floor" else (lambda x: F.bround(x, 0))
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: f(i * (n - 1) / (k - 1)).cast("int"))


def even_sample(rows: DataFrame, group: str, order: str, k: int) -> DataFrame:
    """k rows of each group at even places (all of smaller groups)."""
    n = F.count("*").over(Window.partitionBy(group))
    place = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    kept = rows.withColumns({"__n": n, "place": place})
    even = F.when(F.col("__n") <= k, F.lit(True)).otherwise(F.array_contains(even_places(F.col("__n"), k), F.col("place")))
    return kept.where(even).drop("__n")


def best_in_order(rows: DataFrame, group: str, score: str, order: str, k: int) -> DataFrame:
    """The k best rows of each group (ties: the earlier), numbered in the group's own order."""
    best = rows.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), order))).where(F.col("__r") <= k)
    return best.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(order))).drop("__r")


def shard(rows: DataFrame, order: str, shards: int) -> DataFrame:
    """Shard number by the key's MD5; balanced, and without a global order."""
    return rows.withColumn("shard", md5_modulus(F.col(order).cast("string"), shards).cast("int"))


def upsampled(rows: DataFrame, label: str, key: str, *, power: float = 0.5, cap: float = 4.0, seed: str = "up") -> DataFrame:
    """Rows repeated towards a tempered class balance: times = (largest/n)**power, at most ``cap``; the broken part by hash."""
    counts = rows.groupBy(label).agg(F.count("*").alias("__n"))
    top = counts.agg(F.max("__n").alias("__top"))
    times = counts.crossJoin(top).select(label, F.least(F.pow(F.col("__top") / F.col("__n"), F.lit(power)), F.lit(cap)).alias("times"))  # one row and one row a class
    joined = rows.join(times, label)
    extra = (md5_modulus(F.concat(F.lit(seed), F.col(key).cast("string")), 1000) < (F.col("times") - F.floor("times")) * 1000).cast("int")
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.floor("times").cast("int") + extra))).drop("times")


def class_weights(rows: DataFrame, label: str, power: float = 0.5) -> DataFrame:
    """Tempered inverse frequencies, normalised to the number of classes."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    raw = counts.withColumn("__w", F.pow(1 / F.col("n"), F.lit(power)))
    every = Window.partitionBy()
    return raw.select(label, "n", (F.col("__w") * F.count("*").over(every) / F.sum("__w").over(every)).alias("weight"))


def next_version(names: DataFrame, column: str) -> DataFrame:
    return names.agg((F.coalesce(F.max(F.substring(F.col(column), 2, 9).try_cast("int")), F.lit(0)) + 1).alias("version"))


def resume_position(rows: DataFrame, index: str, done: Column) -> DataFrame:
    """The first open row after the last done one; without any, the first open row."""
    last = rows.agg(F.coalesce(F.max(F.when(done, F.col(index))), F.lit(-1)).alias("last"))
    both = rows.where(~done).crossJoin(F.broadcast(last))  # one row
    return both.agg(F.coalesce(F.min(F.when(F.col(index) > F.col("last"), F.col(index))), F.min(index)).alias("position"))


def next_open(rows: DataFrame, queue: str, index: str, open_: Column, *, width: int = 10_000) -> DataFrame:
    """For every position of a queue the next one that is open, from the queue's start again after its end: queue, index, next,
    all_done. Where nothing is open, next is the following position, or the last.

    Positions are numbered from 0. Stretches of ``width`` positions have their first open one; what lies ahead of a position is
    the rest of its stretch, then the first of the stretches after it, then the first of all, so no task orders a queue.
    """
    own = rows.select(queue, index, open_.alias("__open")).withColumn("__stretch", F.floor(F.col(index) / width))
    first = F.min(F.when(F.col("__open"), F.col(index)))
    stretches = own.groupBy(queue, "__stretch").agg(first.alias("__first"), F.max(index).alias("__last"))
    after = Window.partitionBy(queue).orderBy("__stretch").rowsBetween(1, Window.unboundedFollowing)
    every = Window.partitionBy(queue)
    stretches = stretches.select(queue, "__stretch", F.min("__first").over(after).alias("__later"), F.min("__first").over(every).alias("__any"), F.max("__last").over(every).alias("__end"))
    ahead = Window.partitionBy(queue, "__stretch").orderBy(index).rowsBetween(1, Window.unboundedFollowing)
    placed = own.withColumn("__next", F.min(F.when(F.col("__open"), F.col(index))).over(ahead)).join(stretches, [queue, "__stretch"])
    following = F.least(F.col(index) + 1, F.col("__end"))
    return placed.select(queue, index, F.coalesce("__next", "__later", "__any", following).alias("next"), F.col("__any").isNull().alias("all_done"))


def water_filled(rows: DataFrame, label: str, key: str, budget: int, seed: str = "w") -> DataFrame:
    """At most ``budget`` rows, classes as even as their sizes allow: all of a small class, a common level for the others.

    The level is found over one row a class; rows are ranked within classes by a hash of the key.
    """
    counts = rows.groupBy(label).agg(F.count("*").alias("__n"))
    order = Window.orderBy("__n", label)
    smaller = F.coalesce(F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.count("*").over(Window.partitionBy()) - F.row_number().over(order) + 1
    level = F.floor((budget - smaller) / left)  # what each of the classes from here on may have, if the smaller ones are whole
    open_ = counts.withColumns({"__level": level, "__whole": F.col("__n") <= level})
    top = open_.agg(F.max(F.when(~F.col("__whole"), F.col("__level"))).alias("__top"))  # one row
    quota = open_.crossJoin(top).select(label, F.least(F.col("__n"), F.coalesce("__top", F.col("__n"))).alias("__quota"))
    placed = rows.join(quota, label).withColumn("__r", F.row_number().over(Window.partitionBy(label).orderBy(shuffled(F.col(key), seed), key)))
    return placed.where(F.col("__r") <= F.col("__quota")).drop("__r", "__quota")


def random_rows(rows: DataFrame, key: str, k: int, seed: str = "s") -> DataFrame:
    """k rows, by a hash of the key: each task keeps its k least."""
    return rows.orderBy(shuffled(F.col(key), seed), key).limit(k)


def held_out(rows: DataFrame, video: str, holdout: DataFrame) -> DataFrame:
    """``held``: whether a row's video is in a frozen set."""
    frozen = holdout.select(video).distinct().withColumn("held", F.lit(True))
    return rows.join(frozen, video, "left").withColumn("held", F.coalesce("held", F.lit(False)))


def of_split(rows: DataFrame, split: str, wanted: str) -> DataFrame:
    return rows.where(F.col(split) == wanted)
