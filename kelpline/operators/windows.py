"""Ordered operators over signals and tracks, per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def greedy_windows(signal: DataFrame, group: str, t: str, visible: str, motion: str, *, length: int = 20, step: int = 20, threshold: float = 0.5, least_share: float = 0.5, least_motion: float | None = None, most: int | None = None) -> DataFrame:
    """Non-overlapping windows of ``length`` rows, chosen from the left: group, start, visible_frac, mean_motion.

    A window qualifies with a visible share strictly above ``least_share`` and,
    where asked for, a mean motion of at least ``least_motion``; after one the
    search goes on ``step`` rows later. Starts count rows from 0.
    """
    ahead = Window.partitionBy(group).orderBy(t).rowsBetween(0, length - 1)
    rows = signal.select(group, (F.row_number().over(Window.partitionBy(group).orderBy(t)) - 1).alias("start"), F.avg((F.col(visible) >= threshold).cast("double")).over(ahead).alias("visible_frac"), F.avg(motion).over(ahead).alias("mean_motion"), F.count("*").over(ahead).alias("__n"))
    ok = (F.col("__n") == length) & (F.col("visible_frac") > least_share)
    if least_motion is not None:
        ok = ok & (F.col("mean_motion") >= least_motion)
    starts = rows.where(ok).groupBy(group).agg(F.array_sort(F.collect_list(F.struct("start", "visible_frac", "mean_motion"))).alias("all"))  # of one video
    empty = F.slice("all", 1, 0)
    chosen = F.aggregate("all", empty, lambda out, x: F.when((F.size(out) == 0) | (x["start"] >= F.element_at(out, -1)["start"] + step), F.concat(out, F.array(x))).otherwise(out))
    if most is not None:
        chosen = F.slice(chosen, 1, most)
    return starts.select(group, F.explode(F.when(F.size("all") == 1, F.col("all")).otherwise(chosen)).alias("w")).select(group, "w.*")


def previous(value: str, group: str, t: str) -> Column:
    return F.lag(value).over(Window.partitionBy(group).orderBy(t))


def frame_difference(signal: DataFrame, group: str, t: str, value: str) -> DataFrame:
    """Absolute change from the row before; 0 for a group's first."""
    return signal.withColumn("difference", F.coalesce(F.abs(F.col(value) - previous(value, group, t)), F.lit(0.0)))


def sampled_difference(signal: DataFrame, group: str, t: str, value: str, every: int) -> DataFrame:
    """Of every ``every``-th row: change from the row before it, and from the sampled row before."""
    w = Window.partitionBy(group).orderBy(t)
    rows = signal.withColumns({"i": F.row_number().over(w) - 1, "__p": F.lag(value).over(w)}).where(F.col("i") % every == 0)
    return rows.select(group, "i", F.coalesce(F.abs(F.col(value) - F.col("__p")), F.lit(0.0)).alias("inst"), F.coalesce(F.abs(F.col(value) - F.lag(value).over(Window.partitionBy(group).orderBy("i"))), F.lit(0.0)).alias("disp"))


def normalised(signal: DataFrame, group: str, value: str) -> DataFrame:
    """Value over its group's greatest; 0 where that isn't positive."""
    top = F.max(value).over(Window.partitionBy(group))
    return signal.withColumn("normalised", F.when(top > 0, F.col(value) / top).otherwise(0.0))


def smoothed(signal: DataFrame, group: str, t: str, value: str, taps: int = 5) -> DataFrame:
    """Centred mean with zeros beyond the ends; groups of fewer than ``taps`` rows stay as they are."""
    half = taps // 2
    w = Window.partitionBy(group).orderBy(t).rowsBetween(-half, half)
    n = F.count("*").over(Window.partitionBy(group))
    return signal.withColumn("smoothed", F.when(n >= taps, F.sum(value).over(w) / taps).otherwise(F.col(value)))


def moving_median(signal: DataFrame, group: str, t: str, value: str, half: int = 2) -> DataFrame:
    """Centred median; fewer neighbours at the ends."""
    w = Window.partitionBy(group).orderBy(t).rowsBetween(-half, half)
    return signal.withColumn("median", F.percentile(value, 0.5).over(w))


def median_gaussian(signal: DataFrame, group: str, t: str, value: str, sigma: float = 1.0, radius: int = 4) -> DataFrame:
    """Three-tap median, then a Gaussian of ``radius`` taps a side, both with repeated ends; groups of fewer than three rows stay."""
    import math

    w = Window.partitionBy(group).orderBy(t)
    x = F.col(value)
    before, after = F.coalesce(F.lag(value).over(w), x), F.coalesce(F.lead(value).over(w), x)
    rows = signal.withColumn("__m", F.greatest(F.least(before, x), F.least(F.greatest(before, x), after)))
    kernel = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    whole = Window.partitionBy(group).orderBy(t).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first("__m").over(whole), F.last("__m").over(whole)
    at = lambda k: F.coalesce(F.lag("__m", -k).over(w), first if k < 0 else last) if k else F.col("__m")
    out = sum((at(k) * (g / sum(kernel)) for k, g in zip(range(-radius, radius + 1), kernel, strict=True)), F.lit(0.0))
    return rows.withColumn("filtered", F.when(F.count("*").over(Window.partitionBy(group)) >= 3, out).otherwise(x)).drop("__m")


def ema_series(signal: DataFrame, group: str, t: str, value: str, alpha: float = 0.45) -> DataFrame:
    """group, last value of the exponential moving average over the ordered series, and its length."""
    from kelpline.functions.scalars import ema

    series = F.transform(F.array_sort(F.collect_list(F.struct(t, value))), lambda x: x[value])  # of one video
    return signal.groupBy(group).agg(series.alias("s")).select(group, ema(F.col("s"), alpha).alias("ema"), F.size("s").cast("long").alias("n"))


def largest_gap(signal: DataFrame, group: str, t: str) -> DataFrame:
    w = Window.partitionBy(group).orderBy(t)
    return signal.select(group, (F.lead(t).over(w) - F.col(t)).alias("gap")).groupBy(group).agg(F.max("gap").alias("largest_gap"))


def as_of_previous(frames: DataFrame, group: str, index: str, value: str, stride: int) -> DataFrame:
    """For each frame the latest one at least ``stride`` earlier (backward as-of), by one ordered pass over marks and frames."""
    marks = frames.select(group, F.col(index).alias("__at"), F.lit(1).alias("__ask"), F.col(index), F.lit(None).cast("long").alias("__i"), F.lit(None).cast("double").alias("__v")).withColumn("__at", F.col("__at") - stride)
    kept = frames.select(group, F.col(index).alias("__at"), F.lit(0).alias("__ask"), F.lit(None).cast("long").alias(index), F.col(index).alias("__i"), F.col(value).cast("double").alias("__v"))
    w = Window.partitionBy(group).orderBy("__at", "__ask").rowsBetween(Window.unboundedPreceding, 0)
    both = kept.unionByName(marks).withColumns({"prev_index": F.last("__i", ignorenulls=True).over(w), "prev_value": F.last("__v", ignorenulls=True).over(w)})
    return both.where("__ask = 1").select(group, index, "prev_index", "prev_value")


def islands(rows: DataFrame, group: str, member: str, rank: str) -> DataFrame:
    """Runs of consecutive ranks: group, member, runs."""
    w = Window.partitionBy(group, member).orderBy(rank)
    return rows.select(group, member, (F.col(rank) - F.row_number().over(w)).alias("island")).groupBy(group, member).agg(F.count_distinct("island").alias("runs"))


def kinematics(points: DataFrame, group: str, t: str, x: str, y: str) -> DataFrame:
    """Distance, speed and acceleration from the row before, with the time between as divisor. t in seconds."""
    w = Window.partitionBy(group).orderBy(t)
    dt = F.nullif(F.col(t) - F.lag(t).over(w), F.lit(0.0))
    rows = points.withColumns({"__dt": dt, "distance": F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w))})
    rows = rows.where(F.col("distance").isNotNull() & F.col("__dt").isNotNull()).withColumn("speed", F.col("distance") / F.col("__dt"))
    return rows.withColumn("acceleration", (F.col("speed") - F.lag("speed").over(w)) / F.col("__dt")).drop("__dt")


def gated_kinematics(nodes: DataFrame, clip: str, node: str, index: str, x: str, y: str, state: str, *, stride: int, fps: float, gate: tuple[str, ...] | None = ("detected", "fitted")) -> DataFrame:
    """Motion of each node from the clip's latest frame at least ``stride`` earlier: clip, node, index, prev_index, distance, speed,
    acceleration.

    A row needs the node in both frames with a state of ``gate`` (null: any), so a node that is held without evidence makes no
    motion. The acceleration is the change of velocity since the node's last row that was made, over the time between the two;
    null for its first. One node a frame; frames are those of any node.
    """
    frames = nodes.select(clip, index).distinct()
    ago = Window.partitionBy(clip).orderBy(index).rangeBetween(Window.unboundedPreceding, -stride)
    pairs = frames.withColumn("prev_index", F.max(index).over(ago)).where("prev_index IS NOT NULL")
    shown = nodes if gate is None else nodes.where(F.col(state).isin(*gate))
    here = shown.select(clip, node, index, F.col(x).alias("__x"), F.col(y).alias("__y"))
    there = shown.select(clip, node, F.col(index).alias("prev_index"), F.col(x).alias("__px"), F.col(y).alias("__py"))
    moved = here.join(pairs, [clip, index]).join(there, [clip, node, "prev_index"])
    dt = (F.col(index) - F.col("prev_index")) / fps
    moved = moved.withColumns({"distance": F.hypot(F.col("__x") - F.col("__px"), F.col("__y") - F.col("__py")), "__vx": (F.col("__x") - F.col("__px")) / dt, "__vy": (F.col("__y") - F.col("__py")) / dt})
    w = Window.partitionBy(clip, node).orderBy(index)
    since = (F.col(index) - F.lag(index).over(w)) / fps
    change = F.hypot(F.col("__vx") - F.lag("__vx").over(w), F.col("__vy") - F.lag("__vy").over(w)) / since
    return moved.select(clip, node, index, "prev_index", "distance", (F.col("distance") / dt).alias("speed"), change.alias("acceleration"))


def patience_stops(rows: DataFrame, run: str, step: str, metric: str, patience: int) -> DataFrame:
    """Where each run ends that stops once ``patience`` steps in a row bring no new best: run, best, best_step, stop_step, stopped.

    A step is a new best if its metric exceeds all before it (nulls and NaN never do); what follows a best is its island, and
    the first island long enough ends the run. ``stopped`` is false where a run came to its own end.
    """
    w = Window.partitionBy(run).orderBy(step)
    number = F.col(metric).isNotNull() & ~F.isnan(metric)
    before = F.max(F.when(number, F.col(metric))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    better = number & (before.isNull() | (F.col(metric) > before))
    marked = rows.select(run, step, metric, better.alias("__better")).withColumn("__island", F.sum(F.col("__better").cast("int")).over(w))
    marked = marked.withColumn("__bad", F.row_number().over(Window.partitionBy(run, "__island").orderBy(step)) - F.when(F.col("__island") > 0, 1).otherwise(0))
    ends = marked.withColumn("__stop", F.min(F.when(F.col("__bad") >= patience, F.col(step))).over(Window.partitionBy(run)))
    ran = ends.where(F.col("__stop").isNull() | (F.col(step) <= F.col("__stop")))
    best = F.max_by(F.struct(F.col(metric).alias("best"), F.col(step).alias("best_step")), F.when(F.col("__better"), F.col(step)))
    return ran.groupBy(run).agg(best.alias("b"), F.max(step).alias("stop_step"), F.max("__stop").isNotNull().alias("stopped")).select(run, "b.best", "b.best_step", "stop_step", "stopped")


def teleports(points: DataFrame, group: str, t: str, value: str, *, factor: float = 4.0, floor: float = 6.0, least_points: int = 4) -> DataFrame:
    """Steps above max(factor times the group's median step, floor): group, steps, jumps; short series left out."""
    w = Window.partitionBy(group).orderBy(t)
    steps = points.select(group, F.abs(F.col(value) - F.lag(value).over(w)).alias("d"), F.count("*").over(Window.partitionBy(group)).alias("__n")).where((F.col("__n") >= least_points) & F.col("d").isNotNull())
    limit = F.greatest(F.percentile("d", 0.5).over(Window.partitionBy(group)) * factor, F.lit(floor))
    return steps.withColumn("__limit", limit).groupBy(group).agg(F.count("*").alias("steps"), F.count_if(F.col("d") > F.col("__limit")).alias("jumps"))


def summary(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Mean, median, 90th percentile (linear) and greatest value by group."""
    return rows.groupBy(group).agg(F.avg(value).alias("mean"), F.percentile(value, 0.5).alias("median"), F.percentile(value, 0.9).alias("p90"), F.max(value).alias("max"))


def second_grid(points: DataFrame, group: str, t: Column, score: str, order: str) -> DataFrame:
    """Scores on whole seconds (banker's rounding; the later sample wins), 0 where there is none."""
    at = points.select(group, F.bround(t, 0).cast("int").alias("second"), score, order)
    kept = at.groupBy(group, "second").agg(F.max_by(score, order).alias("score"))
    spans = kept.groupBy(group).agg(F.max("second").alias("last")).select(group, F.explode(F.sequence(F.lit(0), F.col("last"))).alias("second"))
    return spans.join(kept, [group, "second"], "left").select(group, "second", F.coalesce("score", F.lit(0.0)).alias("score"))
