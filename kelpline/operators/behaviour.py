"""Behaviour analytics over records of present subjects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def budget(records: DataFrame, *by: str) -> DataFrame:
    return records.groupBy(*by).agg(F.count("*").alias("n"))


def distributions(records: DataFrame, fields: list[str]) -> DataFrame:
    """Counts of each value of several fields in one pass: grouping sets instead of as many scans."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    return records.select(each.alias("x")).groupBy("x.field", "x.value").agg(F.count("*").alias("n"))


def circadian(index: DataFrame, hour: Column, present: Column, arousal: Column, least: int = 5, exposure: Column | None = None) -> DataFrame:
    """By hour with at least so many rows: all, present, their share, mean arousal of the present. Every row of the index is
    exposure, days never analysed too; ``exposure`` limits it (to matched days)."""
    index = index if exposure is None else index.where(exposure)
    out = index.groupBy(hour.alias("hour")).agg(F.count("*").alias("all"), F.count_if(present).alias("present"), F.avg(F.when(present, arousal)).alias("mean_arousal"))
    return out.where((F.col("all") >= least) & F.col("hour").isNotNull()).select("hour", "all", "present", (F.col("present") / F.col("all")).alias("present_rate"), "mean_arousal")


def stimulus_response(records: DataFrame, context: str, motion: str, arousal: Column, label: str, top: int = 3) -> DataFrame:
    """By context: n, mean motion, mean arousal, and the commonest labels with counts."""
    main = records.groupBy(context).agg(F.count("*").alias("n"), F.avg(motion).alias("mean_motion"), F.avg(arousal).alias("mean_arousal"))
    counted = records.groupBy(context, label).agg(F.count("*").alias("c"))
    ranked = counted.withColumn("r", F.row_number().over(Window.partitionBy(context).orderBy(F.desc("c"), label))).where(F.col("r") <= top)
    tops = ranked.groupBy(context).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", label, "c"))), lambda x: F.concat(x[label], F.lit(":"), x["c"].cast("string"))), ",").alias("top_labels"))
    return main.join(tops, context)


def crosstab(records: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    return records.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])


def dashboard(counts: DataFrame, group: str, value: str, n: str) -> DataFrame:
    """Bars against the greatest count and stacked shares within a group."""
    return counts.select(group, value, n, (F.col(n) / F.max(n).over(Window.partitionBy())).alias("bar"), (F.col(n) / F.sum(n).over(Window.partitionBy(group))).alias("share"))


def directional_rules(rows: DataFrame, camera: Column, present: Column, bad_label: Column, weak: str, unreliable: str) -> DataFrame:
    """Rows with ``drop_reason`` (null: kept) and ``weight``: one camera's presence isn't believed, another's absence counts half."""
    reason = F.when(bad_label, "dropped_label").when((camera == unreliable) & present, "unreliable_present")
    return rows.withColumns({"drop_reason": reason, "weight": F.when((camera == weak) & ~present, 0.5).otherwise(1.0)})


def drop_accounting(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


def median_filter(rows: DataFrame, group: str, area: str, low: float, high: float, factor: float) -> DataFrame:
    """Areas within a range and not above ``factor`` medians of their group's positive areas."""
    m = F.percentile(F.when(F.col(area) > 0, F.col(area)), 0.5).over(Window.partitionBy(group))
    return rows.withColumn("__m", m).where(F.col(area).between(low, high) & (F.col(area) <= F.col("__m") * factor)).drop("__m")


def status(n_clips: Column, scanned: Column, probed: Column, error: Column) -> Column:
    return F.when(error, "failed").when(n_clips > 0, "clips").when(scanned, "scanned_empty").when(probed, "probed_empty").otherwise("failed")


def visible(rows: DataFrame) -> DataFrame:
    """Columns a labeller may see: those that don't begin with an underscore."""
    return rows.select(*[c for c in rows.columns if not c.startswith("_")])
