"""Every registered query with its equivalent SQL.

The synthetic ``events`` stand in for observations: user_id is the clip,
event_id the order of its records, event_type the label, value the score, and
the number in props picks context and posture.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

CONTEXTS = ("none", "human_present", "enrichment_object", "feeding")
POSTURES = ("contracted", "neutral", "arms_extended", "flattened_spread", "climbing", "uncertain", "unseen_pose")
LABELS = ("click", "purchase", "signup", "view")


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    pick = lambda names: F.get(F.array(*[F.lit(x) for x in names]), F.col("k") % len(names))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("clip"), F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("label"), "value", k.alias("k"))
    activity = F.when(F.col("value") < 10, "still").when(F.col("value") < 40, "low").when(F.col("value") < 90, "moderate").otherwise("high")
    return rows.withColumns({"context": pick(CONTEXTS), "posture": pick(POSTURES), "activity": activity, "present": F.col("value") >= 20, "camera": F.concat(F.lit("cam"), F.col("clip") % 4)})


def _case(names: tuple, on: str) -> str:
    return f"CASE {on} % {len(names)} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"


#: The same rows in SQL.
OBS = f"""o AS (SELECT clip, seq, ts, label, value, k, {_case(CONTEXTS, 'k')} AS context, {_case(POSTURES, 'k')} AS posture,
 CASE WHEN value < 10 THEN 'still' WHEN value < 40 THEN 'low' WHEN value < 90 THEN 'moderate' ELSE 'high' END AS activity,
 value >= 20 AS present, 'cam' || (clip % 4) AS camera
 FROM (SELECT user_id AS clip, event_id AS seq, ts, event_type AS label, value, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events))"""
AROUSAL = """round((CASE activity WHEN 'still' THEN 0.0::DOUBLE WHEN 'low' THEN 0.33::DOUBLE WHEN 'moderate' THEN 0.66::DOUBLE WHEN 'high' THEN 1.0::DOUBLE ELSE 0.33::DOUBLE END) * 0.6::DOUBLE
 + (CASE posture WHEN 'contracted' THEN 0.0::DOUBLE WHEN 'neutral' THEN 0.3::DOUBLE WHEN 'arms_extended' THEN 0.6::DOUBLE WHEN 'climbing' THEN 0.8::DOUBLE WHEN 'flattened_spread' THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END) * 0.4::DOUBLE, 3)"""


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


for _part in ("q_behaviour", "q_selection", "q_signals", "q_statistics", "q_text", "q_joins", "q_more", "q_streams", "q_rounds"):
    importlib.import_module(f"kelpline.plans.{_part}")
