"""Fusing several passes of categorical labels: tallies, majorities, margins, soft targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def majority(passes: DataFrame, key: str, label: str, order: str, abstain: str = "uncertain") -> DataFrame:
    """One row per key: n_passes, n_abstain, n_votes, label, top, margin (3 places), tied, unanimous.

    Ties go to the first pass's label if it is among them, otherwise to the
    lexically first. A key of abstentions alone has a null label. Two
    aggregations on the same key; the second reuses the first's partitioning.
    """
    voted = F.lower(F.trim(F.col(label))) != abstain
    counted = passes.groupBy(key, F.when(voted, F.col(label)).alias("label")).agg(F.count("*").alias("n"), F.min(F.struct(order, label)).alias("first"))
    tally = counted.groupBy(key).agg(
        F.sum("n").alias("n_passes"),
        F.coalesce(F.sum(F.when(F.col("label").isNull(), F.col("n"))), F.lit(0)).alias("n_abstain"),
        F.coalesce(F.sum(F.when(F.col("label").isNotNull(), F.col("n"))), F.lit(0)).alias("n_votes"),
        F.array_sort(F.collect_list(F.when(F.col("label").isNotNull(), F.struct((-F.col("n")).alias("rank"), "label")))).alias("ballots"),  # one for each label
        F.min("first").getField(label).alias("first_label"),
    )
    top = -F.get("ballots", 0)["rank"]
    tied = F.filter("ballots", lambda b: -b["rank"] == top)
    winner = F.when(F.exists(tied, lambda b: b["label"] == F.col("first_label")), F.col("first_label")).otherwise(F.get(tied, 0)["label"])
    return tally.select(
        key,
        "n_passes",
        "n_abstain",
        "n_votes",
        winner.alias("label"),
        F.coalesce(top, F.lit(0)).alias("top"),
        F.round(top / F.col("n_votes"), 3).alias("margin"),
        (F.size(tied) > 1).alias("tied"),
        F.coalesce(top == F.col("n_votes"), F.lit(False)).alias("unanimous"),
    )


def votes_by_label(passes: DataFrame, key: str, label: str) -> DataFrame:
    """key, ``votes``: label:count of each label by name, comma-joined."""
    counted = passes.groupBy(key, label).agg(F.count("*").alias("n"))
    pairs = F.array_sort(F.collect_list(F.concat(F.col(label), F.lit(":"), F.col("n").cast("string"))))
    return counted.groupBy(key).agg(F.array_join(pairs, ",").alias("votes"))


def flip_rates(voted: DataFrame, first_label: Column, label: Column, unanimous: Column) -> DataFrame:
    """Shares of keys whose majority differs from the first pass, and of unanimous and split ones."""
    n = F.count("*")
    return voted.agg(n.alias("n"), (F.count_if(label != first_label) / n).alias("flip_rate"), (F.count_if(unanimous) / n).alias("unanimous_rate"), (F.count_if(~unanimous) / n).alias("split_rate"))


def soft_target(counts: DataFrame, key: str, label: str, n: str, classes: list[str]) -> DataFrame:
    """Shares over the classes; keys without a vote for any class go."""
    kept = counts.where(F.col(label).isin(*classes))
    sums = [F.coalesce(F.sum(F.when(F.col(label) == c, F.col(n))), F.lit(0)).alias(c) for c in classes]
    shares = kept.groupBy(key).agg(*sums, F.sum(n).alias("__all"))
    return shares.select(key, *[(F.col(c) / F.col("__all")).alias(c) for c in classes])


def soft_target_absent(counts: DataFrame, key: str, label: str, n: str, absent: str, classes: list[str], absent_votes: str, passes: str) -> DataFrame:
    """For absent keys: the absent share on ``absent``, the rest spread as the behaviour votes lie; what can't be spread
    is lost and the shares are normalised again."""
    behaviours = [c for c in classes if c != absent]
    sums = [F.coalesce(F.sum(F.when(F.col(label) == c, F.col(n))), F.lit(0)).alias(f"__{i}") for i, c in enumerate(behaviours)]
    rows = counts.groupBy(key, absent_votes, passes).agg(*sums)
    share = F.col(absent_votes) / F.col(passes)
    spread = sum((F.col(f"__{i}") for i in range(len(behaviours))), F.lit(0))
    raw = [F.when(spread > 0, (1 - share) * F.col(f"__{i}") / F.nullif(spread, F.lit(0))).otherwise(0.0) for i in range(len(behaviours))]
    whole = share + F.when(spread > 0, 1 - share).otherwise(0.0)
    return rows.where(whole > 0).select(key, (share / whole).alias(absent), *[(r / whole).alias(c) for r, c in zip(raw, behaviours, strict=True)])


def pass_flags(passes: DataFrame, key: str, deterministic: Column, varies: Column) -> DataFrame:
    """Any pass deterministic; sampling varies in all (unknown counts as varying)."""
    return passes.groupBy(key).agg(F.bool_or(F.coalesce(deterministic, F.lit(False))).alias("deterministic"), F.bool_and(F.coalesce(varies, F.lit(True))).alias("sampling_varies"))


def margin_bands(voted: DataFrame, margin: Column, agree: Column) -> DataFrame:
    """n and agreement by band of the rounded margin; empty bands don't appear."""
    band = F.when(margin >= 1.0, "margin_1.0").when(margin >= 0.8, "margin_0.8").when(margin > 0.6, "margin_0.6_0.8").otherwise("margin_le_0.6")
    return voted.where(margin.isNotNull()).groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.avg(agree.cast("int")).alias("agreement"))


def soft_vote(scores: DataFrame, key: str, cls: str, p: str) -> DataFrame:
    """Mean probability over members, then the greatest (ties: first class)."""
    mean = scores.groupBy(key, cls).agg(F.avg(p).alias("p"))
    return mean.groupBy(key).agg(F.min(F.struct((-F.col("p")).alias("r"), F.col(cls).alias("c"))).alias("b")).select(key, F.col("b.c").alias("winner"), (-F.col("b.r")).alias("p"))


def hard_vote(scores: DataFrame, key: str, member: str, cls: str, p: str) -> DataFrame:
    """Each member's greatest class; most votes win, ties by summed probability, then class. With the share of agreeing members."""
    best = Window.partitionBy(key, member).orderBy(F.desc(p), cls)
    marked = scores.withColumn("__vote", (F.row_number().over(best) == 1).cast("int"))
    sums = marked.groupBy(key, cls).agg(F.sum("__vote").alias("v"), F.sum(p).alias("s"))
    won = sums.groupBy(key).agg(F.min(F.struct((-F.col("v")).alias("v"), (-F.col("s")).alias("s"), F.col(cls).alias("c"))).alias("b"), F.sum("v").alias("members"))
    return won.select(key, F.col("b.c").alias("winner"), (-F.col("b.v")).alias("votes"), (-F.col("b.v") == F.col("members")).alias("unanimous"))
