"""Quantiles, successors, patience, gated motion and bootstraps against plain loops."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpline.operators import bootstrap, quantiles, sampling, windows


@pytest.mark.parametrize("few", [20, 10_000])
def test_quantiles_equal_percentile(spark, few):
    rng = np.random.default_rng(1)
    tied = np.round(rng.exponential(3, 3000), 1)
    values = [float(x) for x in tied] + [7.0] * 900 + [None] * 50 + [float(x) for x in rng.normal(0, 1e6, 500)] + [0.0, -0.0, 1e300, -1e300]
    df = spark.createDataFrame([(x,) for x in values], "x double").repartition(5)
    shares = [0.0, 0.013, 0.25, 0.5, 0.731, 0.999, 1.0]
    want = df.agg(F.percentile("x", shares).alias("p")).first()["p"]
    assert quantiles.exact_quantiles(df, F.col("x"), shares, few=few, cuts=16) == pytest.approx(want, rel=1e-12)


def test_quantiles_at_the_edges(spark):
    df = spark.createDataFrame([(None,), (2.0,), (float("nan"),), (1.0,)], "x double")
    got = quantiles.exact_quantiles(df, F.col("x"), [0.0, 0.5, 1.0])
    assert got[:2] == [1.0, 2.0] and math.isnan(got[2])
    assert quantiles.exact_quantiles(df.where("x > 5 AND NOT isnan(x)"), F.col("x"), [0.5]) == [None]
    with pytest.raises(ValueError, match="shares"):
        quantiles.exact_quantiles(df, F.col("x"), [1.5])


def test_next_open_equals_a_loop(spark):
    rng = np.random.default_rng(2)
    queues = {"none": [False] * 23, "all": [True] * 9, "one": [False] * 11 + [True] + [False] * 5, "mixed": (rng.random(200) < 0.1).tolist(), "single": [False]}
    df = spark.createDataFrame([(q, i, bool(o)) for q, own in queues.items() for i, o in enumerate(own)], "q string, i long, o boolean").repartition(4)
    for width in (7, 10_000):
        got = {(r["q"], r["i"]): (r["next"], r["all_done"]) for r in sampling.next_open(df, "q", "i", F.col("o"), width=width).collect()}
        for q, own in queues.items():
            n = len(own)
            for i in range(n):
                ahead = [j for j in [*range(i + 1, n), *range(n)] if own[j]]
                assert got[q, i] == (ahead[0] if ahead else min(i + 1, n - 1), not any(own))


def test_patience_equals_a_loop(spark):
    rng = np.random.default_rng(3)
    runs = {k: [float(x) for x in np.round(rng.random(rng.integers(1, 40)), 1)] for k in range(40)}
    runs[50], runs[51], runs[52] = [None, None, None, 0.5], [float("nan"), 0.2, 0.2, 0.2], [0.1]
    df = spark.createDataFrame([(k, i, x) for k, own in runs.items() for i, x in enumerate(own)], "run int, step int, m double").repartition(3)
    for patience in (1, 3):
        got = {r["run"]: tuple(r)[1:] for r in windows.patience_stops(df, "run", "step", "m", patience).collect()}
        for k, own in runs.items():
            best, at, bad, stop = None, None, 0, None
            for i, x in enumerate(own):
                if x is not None and x == x and (best is None or x > best):
                    best, at, bad = x, i, 0
                else:
                    bad += 1
                    if bad >= patience:
                        stop = i
                        break
            assert got[k] == (best, at, stop if stop is not None else len(own) - 1, stop is not None)


def test_gated_kinematics_equals_a_loop(spark):
    rng = np.random.default_rng(4)
    frames = {c: sorted(rng.choice(60, 30, replace=False).tolist()) for c in "ab"}
    nodes = [(c, f"n{k}", i, float(rng.normal(0, 9)), float(rng.normal(0, 9)), str(rng.choice(["detected", "fitted", "occluded"]))) for c, own in frames.items() for i in own for k in range(3) if rng.random() < 0.8]
    df = spark.createDataFrame(nodes, "c string, n string, i long, x double, y double, s string").repartition(3)
    at = {(c, i): {} for c, _, i, *_ in nodes}
    for c, n, i, x, y, s in nodes:
        at[c, i][n] = (np.array([x, y]), s)
    for gate in (("detected", "fitted"), None):
        want, last = {}, {}
        for c, i in sorted(at):
            before = [j for d, j in at if d == c and j <= i - 4]
            if not before:
                continue
            prev = max(before)
            for n, (xy, s) in at[c, i].items():
                if n not in at[c, prev] or (gate and (s not in gate or at[c, prev][n][1] not in gate)):
                    continue
                dt = (i - prev) / 25
                v = (xy - at[c, prev][n][0]) / dt
                a = None
                if (c, n) in last:
                    j, u = last[c, n]
                    a = pytest.approx(float(np.linalg.norm(v - u)) / ((i - j) / 25))
                last[c, n] = (i, v)
                want[c, n, i] = (prev, pytest.approx(float(np.linalg.norm(v)) * dt), pytest.approx(float(np.linalg.norm(v))), a)
        got = {(r["c"], r["n"], r["i"]): tuple(r)[3:] for r in windows.gated_kinematics(df, "c", "n", "i", "x", "y", "s", stride=4, fps=25.0, gate=gate).collect()}
        assert got == want


def picks(seed, n, iterations):
    u = lambda b, k: int(hashlib.md5(f"{seed}:{b}:{k}".encode()).hexdigest()[:12], 16) / 2**48
    return [Counter(math.floor(u(b, k) * n) for k in range(1, n + 1)) for b in range(1, iterations + 1)]


def plain_auc(pos, neg):
    pos, neg = np.array(pos)[:, None], np.array(neg)
    return ((pos > neg).sum() + (pos == neg).sum() / 2) / (len(pos) * len(neg))


@pytest.mark.parametrize("joint", [True, False])
def test_bootstrap_of_auc_equals_resampling_of_rows(spark, monkeypatch, joint):
    monkeypatch.setattr(bootstrap, "BLOCK", 4)
    monkeypatch.setattr(bootstrap, "CHUNK", 7)
    rng = np.random.default_rng(5)
    rows = [(f"v{int(rng.integers(11))}", float(np.round(rng.normal(), 1)), float(np.round(rng.normal(), 1)), bool(rng.random() < 0.3)) for _ in range(160)]
    rows += [("only", 0.5, 0.1, True), ("v1", None, 0.3, True), ("v2", 0.3, 0.3, None)]
    df = spark.createDataFrame(rows, "c string, a double, b double, p boolean").repartition(4)
    kept = [r for r in rows if None not in r]
    order = lambda names, seed: sorted(names, key=lambda c: (hashlib.md5(f"{seed}:{c}".encode()).hexdigest(), c))
    sides = [order({r[0] for r in kept if joint or r[3] == kind}, "s" if joint else "s" + sign) for kind, sign in ((True, "+"), (False, "-"))]
    drawn = [picks("s" if joint else "s" + sign, len(own), 30) for own, sign in zip(sides, "+-", strict=True)]
    for scores in (["a"], ["a", "b"]) if joint else (["a"],):
        if len(scores) == 2:
            kept = [r for r in rows if None not in r]
        want = {}
        for it in range(30):
            times = [{own[i]: m for i, m in d[it].items()} for own, d in zip(sides, drawn, strict=True)]
            part = lambda k, kind: [r[k] for r in kept if r[3] == kind for _ in range(times[0 if kind else 1].get(r[0], 0))]  # noqa: E731, B023
            if part(1, True) and part(1, False):
                want[it + 1] = plain_auc(part(1, True), part(1, False)) - (plain_auc(part(2, True), part(2, False)) if len(scores) == 2 else 0)
        got = {r["iteration"]: r["x"] for r in bootstrap.auc_draws(df, "c", scores, F.col("p"), 30, "s", joint=joint).collect()}
        assert got == pytest.approx(want)
    assert bootstrap.auc_draws(df.where("NOT p"), "c", ["a"], F.col("p"), 5, "s", joint=joint).count() == 0


def test_seed_frames_take_the_last_row_of_the_last_manifest(spark):
    from kelpline.operators import joins

    frames = spark.createDataFrame([("a", 9), ("b", 9), ("c", 9), (None, 9)], "image string, seed_frame int")
    human = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 3, 1), ("x", 4, 1), (None, 5, 1)], "image string, seed_frame int, line int")
    negative = spark.createDataFrame([("b", None, 7)], "image string, seed_frame int, line int")
    got = {r["image"]: r["seed_frame"] for r in joins.seed_frames(frames, [(human, "line"), (negative, "line")], "image", "seed_frame").collect()}
    assert got == {"a": 2, "b": None, "c": None, None: None}


def test_half_tails_equal_sums():
    from kelpline.operators.statistics import half_tail

    for n in (1, 2, 7, 40, 301):
        for k in range(n + 1):
            assert half_tail(k, n) == pytest.approx(sum(math.comb(n, i) for i in range(k + 1)) / 2**n, rel=1e-9)
    assert half_tail(499_000_000, 1_000_000_000) < 1e-300 or half_tail(499_000_000, 1_000_000_000) >= 0
    assert half_tail(500_000_000, 1_000_000_001) == pytest.approx(0.5, rel=1e-4)
