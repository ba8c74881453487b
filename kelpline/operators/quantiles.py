"""Exact quantiles of a column over all rows, by narrowing ranges of counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exact_quantiles(rows: DataFrame, value: Column, shares: list[float], *, cuts: int = 255, few: int = 50_000) -> list[float | None]:
    """Quantiles with linear interpolation, as ``percentile`` gives them, without a task that holds all distinct values.

    A round takes cut points inside the ranges that hold the wanted ranks from a quantile sketch of their rows, and counts the
    rows at and between the cuts: an aggregation each, whose result has a row a cut. A rank that falls on a cut is found; a
    range with at most ``few`` rows is read out; otherwise the range narrows some ``cuts`` times. Nulls count nowhere, NaN as the
    greatest; without rows every quantile is null.
    """
    if any(not 0 <= s <= 1 for s in shares):
        raise ValueError("shares lie between 0 and 1")
    own = rows.select(value.cast("double").alias("x")).where("x IS NOT NULL")
    n = own.count()
    if not n:
        return [None] * len(shares)
    places = [s * (n - 1) for s in shares]
    wanted = {math.floor(p) for p in places} | {math.ceil(p) for p in places}
    found: dict[int, float] = {}
    ranges = [(None, None, 0, n)]  # open at both ends, rows below, rows within
    x = F.col("x")

    def within(low, high) -> Column:
        return (F.lit(True) if low is None else x > low) & (F.lit(True) if high is None else x < high)

    while open_ := [r for r in ranges if any(r[2] <= k < r[2] + r[3] and k not in found for k in wanted)]:
        small = [r for r in open_ if r[3] <= few]
        if small:
            any_of = F.lit(False)
            for low, high, _, _ in small:
                any_of = any_of | within(low, high)
            counted = sorted((r["x"], r["c"]) for r in own.where(any_of).groupBy("x").agg(F.count("*").alias("c")).collect())  # at most ``few`` a range, of which there are two a share
            for low, high, below, _ in small:
                for v, c in _sorted_nan(counted):
                    if (low is None or _less(low, v)) and (high is None or _less(v, high)):
                        found |= {k: v for k in wanted if below <= k < below + c}
                        below += c
        ranges = []
        for low, high, below, size in (r for r in open_ if r[3] > few):
            part = own.where(within(low, high))
            points = part.agg(F.percentile_approx("x", [i / (cuts + 1) for i in range(1, cuts + 1)], 10_000).alias("p")).first()["p"]
            points = [v for i, v in enumerate(points) if i == 0 or v != points[i - 1]]
            marks = F.array(*[F.lit(v) for v in points])
            bins = part.select((2 * F.size(F.filter(marks, lambda c: c < x)) + F.array_contains(marks, x).cast("int")).alias("bin"))
            counts = {r["bin"]: r["c"] for r in bins.groupBy("bin").agg(F.count("*").alias("c")).collect()}  # two a cut
            ends = [low, *points, high]
            for b in sorted(counts):
                k = b // 2
                if b % 2:
                    found |= {r: points[k] for r in wanted if below <= r < below + counts[b]}
                else:
                    ranges.append((ends[k], ends[k + 1], below, counts[b]))
                below += counts[b]
    out = []
    for p in places:
        low, high = found[math.floor(p)], found[math.ceil(p)]
        out.append(low if low == high or p == math.floor(p) else low + (high - low) * (p - math.floor(p)))
    return out


def _less(a: float, b: float) -> bool:
    return a < b or (a == a and b != b)


def _sorted_nan(counted: list[tuple[float, int]]) -> list[tuple[float, int]]:
    return sorted(counted, key=lambda vc: (vc[0] != vc[0], vc[0]))
