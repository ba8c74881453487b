"""Relational side of skeleton graphs: pixel edges, arc lengths, scores and gates, candidates, signatures, identities over frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kelpline.functions.scalars import angle_gap, circular_mean
from kelpline.operators.tracking import assignment


def pixel_edges(pixels: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """group, ax, ay, bx, by, length of neighbouring pixels (8 directions), each pair once: a pixel meets four places ahead of it."""
    ahead = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (-1, 1), (0, 1), (1, 1))]))
    own = pixels.select(group, F.col(x).alias("ax"), F.col(y).alias("ay"), ahead.alias("d"))
    own = own.select(group, "ax", "ay", (F.col("ax") + F.col("d.dx")).alias("bx"), (F.col("ay") + F.col("d.dy")).alias("by"), F.sqrt((F.abs("d.dx") + F.abs("d.dy")).cast("double")).alias("length"))
    return own.join(pixels.select(group, F.col(x).alias("bx"), F.col(y).alias("by")), [group, "bx", "by"]).select(group, "ax", "ay", "bx", "by", "length")


def along_curve(points: DataFrame, curve: list[str], order: str, x: str, y: str) -> DataFrame:
    """Points with ``arc``, the length of the curve so far, and ``curvature`` by central differences (null at the ends and at a standstill)."""
    w = Window.partitionBy(*curve).orderBy(order)
    step = F.coalesce(F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)), F.lit(0.0))
    first = lambda c: (F.lead(c).over(w) - F.lag(c).over(w)) / 2.0
    second = lambda c: F.lead(c).over(w) - 2.0 * F.col(c) + F.lag(c).over(w)
    rows = points.withColumns({"__step": step, "__dx": first(x), "__dy": first(y), "__ddx": second(x), "__ddy": second(y)})
    speed = F.pow(F.col("__dx") * F.col("__dx") + F.col("__dy") * F.col("__dy"), F.lit(1.5))
    bend = F.abs(F.col("__dx") * F.col("__ddy") - F.col("__dy") * F.col("__ddx")) / F.nullif(speed, F.lit(0.0))
    arc = F.sum("__step").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumns({"arc": arc, "curvature": bend}).drop("__step", "__dx", "__dy", "__ddx", "__ddy")


def node_key(arm: Column, part: Column) -> Column:
    """Name of a node: MantleCenter, Head, or the arm's number and the part without spaces."""
    return F.when(part == "mantle", "MantleCenter").when(part == "head", "Head").otherwise(F.concat(F.lit("Arm"), arm.cast("string"), F.lit("_"), F.replace(F.initcap(part), F.lit(" "), F.lit(""))))


def graded(metrics: DataFrame, *, arms: str = "arms", most_arms: int = 8) -> DataFrame:
    """Graph metrics with ``score`` (0 to 1: arms found, wholeness, freedom from cycles, symmetry, in quarters) and ``faults``."""
    one = F.col("components") == 1
    free = F.col("cycles") == 0
    share = F.least(F.col(arms) / float(most_arms), F.lit(1.0))
    score = (share + one.cast("double") + free.cast("double") + F.col("symmetry")) / 4.0
    faults = F.array_compact(F.array(F.when(~one, "disconnected"), F.when(~free, "cyclic"), F.when(F.col(arms) == 0, "no_arms"), F.when(F.col(arms) > most_arms, "too_many_arms")))
    return metrics.withColumns({"score": score, "faults": faults})


def best_candidate(candidates: DataFrame, key: str, setting: str, score: Column, valid: Column) -> DataFrame:
    """By key the valid candidate of the best score (ties: the first setting); without a valid one the best of all, ``relaxed``."""
    order = F.struct(F.when(valid, 0).otherwise(1).alias("relaxed"), (-score).alias("r"), F.col(setting).alias("setting"))
    best = candidates.groupBy(key).agg(F.min(order).alias("b"))
    return best.select(key, F.col("b.setting").alias(setting), (-F.col("b.r")).alias("score"), (F.col("b.relaxed") == 1).alias("relaxed"))


def signatures(nodes: DataFrame, frame: list[str], arm: str, x: str, y: str, cx: str, cy: str) -> DataFrame:
    """By arm of a frame: circular mean direction from the centre, mean and greatest distance."""
    dx, dy = F.col(x) - F.col(cx), F.col(y) - F.col(cy)
    rows = nodes.withColumns({"__a": F.atan2(dy, dx), "__d": F.hypot(dx, dy)})
    return rows.groupBy(*frame, arm).agg(circular_mean(F.col("__a")).alias("direction"), F.avg("__d").alias("mean_distance"), F.max("__d").alias("reach"))


def pair_costs(before: DataFrame, after: DataFrame, clip: str, arm: str, *, angle_weight: float = 1.0, reach_weight: float = 0.5) -> DataFrame:
    """clip, a, b, cost of every arm of one frame and every arm of the next (a frame has a handful): turn and relative change of reach."""
    left = before.select(clip, F.col(arm).alias("a"), F.col("direction").alias("da"), F.col("reach").alias("ra"))
    right = after.select(clip, F.col(arm).alias("b"), F.col("direction").alias("db"), F.col("reach").alias("rb"))
    change = F.abs(F.col("ra") - F.col("rb")) / F.greatest(F.col("ra"), F.col("rb"), F.lit(1e-9))
    return left.join(right, clip).select(clip, "a", "b", (angle_gap(F.col("da"), F.col("db")) * angle_weight + change * reach_weight).alias("cost"))


def tracked(arms: DataFrame, clip: str, t: str, arm: str, x: str, y: str, *, radius: float) -> DataFrame:
    """clip, t, arm, track: arms of a frame matched to the latest place of each track at least total distance, within the radius;
    others begin tracks. A clip's frames are one group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        last: dict[int, tuple[float, float]] = {}
        out = []
        for when, own in pdf.sort_values([t, arm]).groupby(t):
            at = own[[x, y]].to_numpy(float)
            names = sorted(last)
            found = {}
            if names and len(at):
                cost = np.hypot(*np.moveaxis(at[:, None] - np.array([last[k] for k in names])[None], -1, 0))
                found = {i: names[j] for i, j in assignment(cost) if cost[i, j] <= radius}
            for i, a in enumerate(own[arm]):
                if i not in found:
                    found[i] = max(last, default=-1) + 1
                last[found[i]] = tuple(at[i])
                out.append((pdf[clip].iloc[0], when, a, found[i]))
        return pd.DataFrame(out, columns=[clip, t, arm, "track"])

    kind = {c: arms.schema[c].dataType.simpleString() for c in (clip, t, arm)}
    return arms.select(clip, t, arm, x, y).groupBy(clip).applyInPandas(run, ", ".join(f"{c} {k}" for c, k in kind.items()) + ", track long")


def relabelled(nodes: DataFrame, mapping: DataFrame, keys: list[str], arm: str) -> DataFrame:
    """Nodes with their arm's new name; arms without one keep theirs."""
    return nodes.join(mapping.select(*keys, arm, F.col("track").alias("__new")), [*keys, arm], "left").withColumn(arm, F.coalesce("__new", F.col(arm))).drop("__new")


def chain_edges(nodes: DataFrame, keys: list[str], arm: str, order: str, node: str) -> DataFrame:
    """Edges rebuilt from nodes: neighbours along each arm."""
    w = Window.partitionBy(*keys, arm).orderBy(order)
    return nodes.withColumn("b", F.lead(node).over(w)).where("b IS NOT NULL").select(*keys, arm, F.col(node).alias("a"), "b")


def fused(single: Column, others: Column) -> tuple[Column, Column, Column]:
    """(probabilities, ok, reason): the mean of a frame's probabilities and its aligned neighbours'; the frame's own where one
    has another length or there is none."""
    fit = F.size(others) > 0
    alike = F.forall(others, lambda a: F.size(a) == F.size(single))
    total = F.aggregate(others, F.transform(single, lambda x: x.cast("double")), lambda s, a: F.zip_with(s, a, lambda x, y: x + y))
    mean = F.transform(total, lambda x: x / (F.size(others) + 1))
    ok = fit & alike
    return F.when(ok, mean).otherwise(single), ok, F.when(~fit, "no neighbours").when(~alike, "another shape")


def count_diagnostic(truth: DataFrame, found: DataFrame, frame: list[str]) -> DataFrame:
    """difference, frames: how many more arms the model finds than there are, by frame of either side."""
    a, b = truth.groupBy(*frame).agg(F.count("*").alias("t")), found.groupBy(*frame).agg(F.count("*").alias("f"))
    both = a.join(b, frame, "full").select((F.coalesce("f", F.lit(0)) - F.coalesce("t", F.lit(0))).cast("int").alias("difference"))
    return both.groupBy("difference").agg(F.count("*").alias("frames"))
