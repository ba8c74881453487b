"""Span columns shared by the scanners: an array of (kind, start, end) in code points, end exclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPE = "array<struct<kind: string, start: int, end: int>>"


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined in the array's order."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def of_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def redacted(text: Column, spans: Column, label: str) -> Column:
    """``text`` with each merged region of ``spans`` (sorted by start) replaced by ``label``."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(s, x):
        fresh = x["start"] >= s["at"]
        kept = F.substring(text, s["at"] + 1, F.greatest(x["start"] - s["at"], F.lit(0)))
        out = F.when(fresh, F.concat(s["out"], kept, F.lit(label))).otherwise(s["out"])
        return F.struct(out.alias("out"), F.greatest(s["at"], x["end"]).alias("at"))

    done = F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
