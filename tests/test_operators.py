"""Hand-built edges: ties, abstentions, zero denominators, malformed input, sequential operators against brute force."""

import itertools
import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from kelpline.functions import scalars as C
from kelpline.operators import behaviour as B
from kelpline.operators import merging as M
from kelpline.operators import sampling as S
from kelpline.operators import statistics as X
from kelpline.operators import tracking as T
from kelpline.operators import voting as V
from kelpline.operators import windows as W
from kelpline.sources import files, seams
from kelpline.streaming import signals


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def votes(spark, *labels):
    return spark.createDataFrame([("k", i, v) for i, v in enumerate(labels, 1)], "key string, pass int, label string")


@pytest.mark.parametrize(
    ("labels", "winner", "tied", "top", "n"),
    [
        (["b", "a", "a", "b"], "b", True, 2, 4),  # the first pass is among the tied
        (["c", "b", "b", "a", "a"], "a", True, 2, 5),  # it isn't: lexical
        (["uncertain", "b", "a"], "a", True, 1, 2),
        (["a"] * 5, "a", False, 5, 5),
        ([" Uncertain "] * 3, None, False, 0, 0),
    ],
)
def test_majority(spark, labels, winner, tied, top, n):
    r = V.majority(votes(spark, *labels), "key", "label", "pass").first()
    assert (r["label"], r["tied"], r["top"], r["n_votes"]) == (winner, tied, top, n)


def test_soft_targets_sum_to_one_and_absent_residual(spark):
    rows = spark.createDataFrame([("a", "x", 3, 1, 4), ("b", "absent", 3, 3, 5)], "key string, label string, n int, ab int, passes int")
    out = {r["key"]: r for r in V.soft_target_absent(rows, "key", "label", "n", "absent", ["absent", "x", "y"], "ab", "passes").collect()}
    assert out["a"]["absent"] == pytest.approx(0.25) and out["a"]["x"] == pytest.approx(0.75)
    assert out["b"]["absent"] == 1.0 and out["b"]["x"] == 0.0  # the residual can't be spread


@given(st.lists(st.tuples(st.floats(0, 100), st.booleans()), min_size=1, max_size=60), st.integers(1, 5), st.integers(1, 6))
@settings(max_examples=8, deadline=None)
def test_greedy_windows_equal_a_scan(spark, rows, length, step):
    step = max(step, length)
    values = [100.0 * on for _, on in rows]
    df = spark.createDataFrame([("v", i, x) for i, x in enumerate(values)], "v string, t int, x double")
    want, s = [], 0
    while s + length <= len(values):
        if sum(x >= 50 for x in values[s : s + length]) / length > 0.5:
            want.append(s)
            s += step
        else:
            s += 1
    got = W.greedy_windows(df, "v", "t", "x", "x", length=length, step=step, threshold=50).collect()
    assert sorted(r["start"] for r in got) == want


def test_window_edges(spark):
    df = spark.createDataFrame([("half", i, 1.0 if i < 10 else 0.0) for i in range(20)] + [("short", i, 1.0) for i in range(19)], "v string, t int, x double")
    assert W.greedy_windows(df, "v", "t", "x", "x").count() == 0  # exactly half isn't enough; a tail is no window
    calm = df.where("v = 'half'").withColumn("x", F.lit(1.0))
    assert W.greedy_windows(calm, "v", "t", "x", "x", least_motion=1.0).count() == 1  # exactly the least motion is


@pytest.mark.parametrize(("segment", "hour"), [("235959", 0), ("120000", 12), ("abc", None), ("2359", None)])
def test_clock_hour(spark, segment, hour):
    assert one(spark, C.clock_hour(F.lit(segment), F.lit(1))) == hour


@pytest.mark.parametrize(("value", "want"), [("low", "low"), (" LOW ", "low"), ("very low indeed", "low"), ("", "d"), (None, "d"), ("zzz", "d"), ("mod", "moderate")])
def test_snap(spark, value, want):
    assert one(spark, C.snap(F.lit(value).cast("string"), ["still", "low", "moderate", "uncertain"], "d")) == want


@pytest.mark.parametrize(("text", "want"), [("CAPTION: x", "x"), ("animal not present", None), ("uncertain", None), ("", None), (None, None), ("no animal visible", None), ("an animal rests", "an animal rests")])
def test_usable_caption(spark, text, want):
    assert one(spark, C.usable_caption(F.lit(text).cast("string"), "animal")) == want


def test_md5_modulus_is_pythons(spark):
    import hashlib

    for t in ("", "a", "2026-01-01/seg/cam"):
        assert one(spark, C.md5_modulus(F.lit(t), 1000)) == int(hashlib.md5(t.encode()).hexdigest(), 16) % 1000


def test_ledger_keeps_better_and_is_idempotent(spark):
    schema = "url string, status string, n_clips int, scanned_sec int"
    old = spark.createDataFrame([("a", "failed", 0, None), ("b", "clips", 2, 10), ("c", "clips", 1, 5), ("d", "odd", 9, 9)], schema)
    new = spark.createDataFrame([("a", "clips", 1, 3), ("b", "clips", 3, 1), ("c", "clips", 1, 5), ("d", "failed", 0, 0), ("e", "failed", 0, None)], schema)
    out = M.keep_better(old, new, "url", M.status_rank(F.col("status")), ["n_clips", "scanned_sec"])
    assert {r["url"]: r["outcome"] for r in out.collect()} == {"a": "updated", "b": "updated", "c": "unchanged", "d": "updated", "e": "added"}
    again = M.keep_better(out.drop("outcome"), new, "url", M.status_rank(F.col("status")), ["n_clips", "scanned_sec"])
    assert {r["outcome"] for r in again.collect()} == {"unchanged"}


def test_statistics_edges(spark):
    rows = spark.createDataFrame([(1.0, True), (1.0, False), (2.0, True), (0.5, False)], "s double, p boolean")
    assert X.auc(rows, "s", F.col("p")).first()["auc"] == pytest.approx(0.875)
    assert X.auc(rows.where("p"), "s", F.col("p")).first()["auc"] is None
    low, high = X.wilson(F.lit(0), F.lit(0))
    assert (one(spark, low), one(spark, high)) == (0.0, 0.0)
    same = spark.createDataFrame([(3, 0, 0, 0)], "tt int, tf int, ft int, ff int")
    assert X.kappa(same).first()["kappa"] is None
    assert one(spark, C.iou(F.lit(0), F.lit(0))) == 1.0


def test_presence_is_three_valued(spark):
    rows = spark.createDataFrame([(True,), (False,), (None,)], "p boolean")
    assert rows.where(F.col("p").eqNullSafe(False)).count() == 1
    assert rows.where(~F.coalesce("p", F.lit(False))).count() == 2


def test_assignment_is_least_cost():
    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (3, 5), (5, 3), (5, 5)):
        c = rng.random((n, m))
        best = min(sum(c[i, j] for i, j in (zip(range(n), p, strict=True) if n <= m else zip(p, range(m), strict=True))) for p in itertools.permutations(range(max(n, m)), min(n, m)))
        pairs = T.assignment(c)
        assert len(pairs) == min(n, m) and sum(c[i, j] for i, j in pairs) == pytest.approx(best)


def test_greedy_keep_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(60, 4))
    df = spark.createDataFrame([(i % 3, i, [float(x) for x in v[i]]) for i in range(60)], "g int, k int, v array<double>")
    want = set()
    for g in range(3):
        kept = []
        for i in range(g, 60, 3):
            u = v[i] / np.linalg.norm(v[i])
            if all(u @ w < 0.5 for w in kept):
                kept.append(u)
                want.add(i)
    assert {r["k"] for r in M.greedy_keep(df, "g", "k", "v", 0.5).collect()} == want


def test_tracklets_link_over_gaps(spark):
    t = spark.createDataFrame([("a", 1, 0, 5, 0.0, 0.0, 1.0, 1.0), ("a", 2, 8, 9, 1.5, 1.0, 2.0, 2.0), ("a", 3, 30, 31, 2.0, 2.0, 2.0, 2.0)], "clip string, track long, first long, last long, x0 double, y0 double, x1 double, y1 double")
    assert {r["track"]: r["chain"] for r in T.link_tracklets(t, "clip", "track", radius=1.0).collect()} == {1: 1, 2: 1, 3: 3}


def test_mask_stats(spark):
    m = np.zeros((10, 20), np.uint8)
    m[2:4, 5:9] = 1
    df = spark.createDataFrame([("a", bytearray(m.tobytes()), 10, 20), ("b", bytearray(200), 10, 20)], "k string, m binary, h int, w int")
    got = {r["k"]: r for r in T.mask_stats(df, "k", "m", "h", "w").collect()}
    assert got["a"]["area_frac"] == pytest.approx(0.04) and got["a"]["bbox_w"] == pytest.approx(0.2) and got["b"]["valid"] == 0.0


def test_drop_accounting_counts_all(spark):
    rows = spark.createDataFrame([("u", True, False), ("w", False, False), ("x", True, True)], "cam string, p boolean, bad boolean")
    ruled = B.directional_rules(rows, F.col("cam"), F.col("p"), F.col("bad"), "w", "u")
    assert {r["reason"]: (r["n"], r["weight"]) for r in B.drop_accounting(ruled).collect()} == {"unreliable_present": (1, 1.0), "kept": (1, 0.5), "dropped_label": (1, 1.0)}
    assert B.visible(rows.withColumn("_held", F.lit(1))).columns == ["cam", "p", "bad"]


def test_round_robin_and_resume(spark):
    rows = spark.createDataFrame([(g, i) for g in "abc" for i in range(g != "c" and 5 or 1)], "g string, i int")
    out = S.round_robin(rows, "g", "i", most=2, limit=4, seed="s").collect()
    assert len(out) == 4 and sum(r["turn"] == 1 for r in out) == 3
    assert S.resume_position(spark.createDataFrame([(0,), (1,), (2,)], "i int"), "i", F.col("i") == 2).first()["position"] == 0


def test_sources(spark, tmp_path):
    (tmp_path / "o.json").write_text(json.dumps({"a": {"n": 1}, "b": {"n": 2}}))
    rows, rejects = files.json_object(spark, str(tmp_path / "o.json"), "struct<n:int>")
    assert {(r["key"], r["value"]["n"]) for r in rows.collect()} == {("a", 1), ("b", 2)} and rejects.count() == 0
    (tmp_path / "o2.json").write_text('{"a": {"n": 1}, "b": "loose", "c": null, "d": {"n": 4}}')
    rows, rejects = files.json_object(spark, str(tmp_path / "o2.json"), "struct<n:int>")
    assert {(r["key"], r["value"]["n"]) for r in rows.collect()} == {("a", 1), ("d", 4)} and {r["key"] for r in rejects.collect()} == {"b", "c"}
    (tmp_path / "o3.json").write_text("no object")
    assert [x.count() for x in files.json_object(spark, str(tmp_path / "o3.json"), "struct<n:int>")] == [0, 1]
    (tmp_path / "o4.json").write_text(json.dumps({"a": 'say "x"\n', "b": "1"}))
    assert {r["value"] for r in files.json_object(spark, str(tmp_path / "o4.json"), "string")[0].collect()} == {'say "x"\n', "1"}
    for name, text in (("l.json", [{"n": 1}, "x"]), ("e.json", {"clips": [{"n": 1}, 7]})):
        (tmp_path / name).write_text(json.dumps(text))
        rows, rejects = files.json_envelope(spark, str(tmp_path / name), "clips", "struct<n:int>")
        assert [r["n"] for r in rows.collect()] == [1] and [r["value"] for r in rejects.collect()] in (["x"], ["7"])
    (tmp_path / "w.json").write_text('{"other": []}')
    assert [x.count() for x in files.json_envelope(spark, str(tmp_path / "w.json"), "clips", "struct<n:int>")] == [0, 1]
    (tmp_path / "p").mkdir()
    (tmp_path / "p/pass1.jsonl").write_text('{"key":"a","seq":1,"v":"x"}\n\n{"key":"a","seq":2,"v":"y"}\n{"seq":3}\n{"key":"b","se')
    schema = StructType([StructField("key", StringType()), StructField("seq", LongType()), StructField("v", StringType())])
    rows, rejects = files.jsonl(spark, str(tmp_path / "p/pass1.jsonl"), schema, "key", "seq")
    assert [tuple(r) for r in rows.collect()] == [("a", 2, "y")] and rejects.count() == 2
    (tmp_path / "p/passes.jsonl").write_text('{"key":"z","seq":1,"v":"x"}\n')
    rows, rejects = files.passes(spark, str(tmp_path / "p"), schema)
    assert sorted((r["pass"], r["seq"]) for r in rows.collect()) == [(1, 1), (1, 2), (1, 3)]
    assert sorted((r["file"], r["value"][:8]) for r in rejects.collect()) == [("pass1.jsonl", '{"key":"'), ("passes.jsonl", '{"key":"')]
    (tmp_path / "c.csv").write_text("a,b\n1,x\nbad,y\n")
    good, bad = files.csv(spark, str(tmp_path / "c.csv"), StructType([StructField("a", IntegerType()), StructField("b", StringType())]))
    assert good.count() == 1 and bad.count() == 1
    np.save(tmp_path / "m.npy", np.arange(6, dtype=np.float32).reshape(2, 3))
    assert files.arrays(spark, str(tmp_path)).first()["shape"] == [2, 3]
    for root, size in (("r1", 5), ("r2", 9)):
        (tmp_path / root / "d/s").mkdir(parents=True)
        (tmp_path / root / "d/s/f.bin").write_bytes(b"x" * size)
    assert files.listing(spark, [str(tmp_path / "r1"), str(tmp_path / "r2")], "*.bin").first()["length"] == 5


def test_sinks(spark, tmp_path):
    df = spark.range(3).withColumn("tag", F.lit("t"))
    at = str(tmp_path / "t")
    files.replace_table(df, at)
    files.replace_table(df.limit(2), at)
    assert spark.read.parquet(at).count() == 2
    files.append(df, at)
    assert spark.read.parquet(at).count() == 5
    files.replace_tag(df, str(tmp_path / "g"))
    files.replace_tag(df.limit(1).withColumn("tag", F.lit("u")), str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g")).count() == 4
    assert json.loads(files.envelope(df, "d", "rows").first()[0])["n_rows"] == 3
    files.write_csv(df.withColumn("a", F.array("id")), str(tmp_path / "csv"))
    assert "tabular" in files.latex(df, "c")


def test_seams(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "k string, p string")

    def connect():
        seen = []

        def call(p):
            seen.append(p)
            if p == "y" or len(seen) < 2:
                raise OSError("busy")
            return p * 2

        return call

    got = {r["k"]: r for r in seams.calls(rows.coalesce(1), connect, "k", "p", tries=3, sleep=lambda _: None).collect()}
    assert got["a"]["reply"] == "xx" and got["a"]["attempts"] == 2 and got["b"]["error"] == "busy"
    assert seams.scores(rows, lambda: lambda v: [1.0] * len(v), "k", "p").count() == 2
    cheap, dear = seams.cascade(rows, lambda r: r.select("k", F.when(F.col("k") == "a", 0.9).otherwise(0.1).alias("s")), "s > 0.5", lambda r: r, "k")
    assert cheap.count() == 2 and dear.count() == 1


def test_work_rounds_stop(spark):
    done = []
    assert signals.work_rounds(lambda: spark.range(3).where(~F.col("id").isin(done or [-1])), lambda df: [r["id"] for r in df.limit(1).collect()], done.extend) == 3


def test_crossings_in_blocks_equal_all_pairs(spark):
    """Long segments share many cells; blocks of eight cut every cell; a key that comes twice gives its pairs once."""
    rng = random.Random(12)
    rows = [(f, k, *[rng.uniform(0, 50) for _ in range(4)]) for f in range(2) for k in range(60)] + [(0, 3, 0.0, 0.0, 50.0, 50.0)]
    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    apart = lambda s, t: side(s[2:4], s[4:], t[2:4]) * side(s[2:4], s[4:], t[4:]) < 0
    want = {(s[0], s[1], t[1]) for s in rows for t in rows if s[0] == t[0] and s[1] < t[1] and apart(s, t) and apart(t, s)}
    df = spark.createDataFrame(rows, "f int, k long, x0 double, y0 double, x1 double, y1 double").repartition(3)
    got = [tuple(r) for r in T.crossings(df, "f", "k", 4.0, block=8).collect()]
    assert len(got) == len(want) and set(got) == want


def test_crossings_move_each_segment_once(spark):
    """Rows that go to tasks are the segments, not their copies for cells and blocks; short and long segments, some without place
    or without end, in frames above and below a part's size."""
    rng = random.Random(13)
    rows = []
    for f, n in ((0, 700), (1, 40), (2, 1)):
        for k in range(n):
            x, y, reach = rng.uniform(0, 90), rng.uniform(0, 90), rng.choice([0.5, 4.0, 60.0])
            rows.append((f, f"k{k}", x, y, x + rng.uniform(-reach, reach), y + rng.uniform(-reach, reach)))
    rows += [(0, "n1", None, 0.0, 50.0, 50.0), (0, "n2", float("nan"), 0.0, 50.0, 50.0), (1, "n3", 0.0, 45.0, float("inf"), 45.0), (None, "n4", 0.0, 0.0, 90.0, 90.0), (None, "n5", 90.0, 0.0, 0.0, 90.0), (0, None, 0.0, 0.0, 90.0, 90.0)]
    whole = [r for r in rows if None not in r and r[2] == r[2]]
    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    sides = lambda s, t: (side(s[2:4], s[4:], t[2:4]), side(s[2:4], s[4:], t[4:]))
    apart = lambda s, t: min(sides(s, t)) < 0 < max(sides(s, t))
    want = {(s[0], s[1], t[1]) for s in whole for t in whole if s[0] == t[0] and s[1] < t[1] and apart(s, t) and apart(t, s)}
    df = spark.createDataFrame(rows, "f int, k string, x0 double, y0 double, x1 double, y1 double").repartition(3)
    for block in (100_000, 150):
        got = [tuple(r) for r in T.crossings(df, "f", "k", 4.0, block=block).collect()]
        assert len(got) == len(want) > 1000 and set(got) == want
    moved, pieces = [], T.whole_groups
    T.whole_groups = lambda at, *a, **b: moved.append(at.count()) or pieces(at, *a, **b)
    try:
        T.crossings(df, "f", "k", 4.0)
    finally:
        T.whole_groups = pieces
    assert moved == [len(whole)]


def test_crossings_of_keys_that_come_often(spark):
    """Of one key many segments: its pairs come once each, whatever runs cut its rows."""
    rng = random.Random(14)
    rows = [(0, k, *[rng.uniform(0, 9) for _ in range(4)]) for k in range(30) for _ in range(600 if k == 7 else 1 + k % 3)]
    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    apart = lambda s, t: side(s[2:4], s[4:], t[2:4]) * side(s[2:4], s[4:], t[4:]) < 0
    want = {(0, s[1], t[1]) for s in rows for t in rows if s[1] < t[1] and apart(s, t) and apart(t, s)}
    df = spark.createDataFrame(rows, "f int, k long, x0 double, y0 double, x1 double, y1 double")
    for block in (100_000, 60):
        got = [tuple(r) for r in T.crossings(df, "f", "k", 4.0, block=block).collect()]
        assert len(got) == len(want) and set(got) == want


def test_links_tie_where_sql_ties(spark):
    """Two ends as far from one beginning by the root of the sum of squares, of which ``hypot`` puts the second nearer."""
    near = [(8.13 - 0.98, 19.0), (27.77 - 20.62, 19.0)]
    assert np.hypot(*near[0]) > np.hypot(*near[1])
    rows = [("c", k + 1, 0, 1, 0.0, 0.0, -dx, -dy) for k, (dx, dy) in enumerate(near)] + [("c", 3, 2, 3, 0.0, 0.0, 0.0, 0.0)]
    t = spark.createDataFrame(rows, "clip string, track long, first int, last int, x0 double, y0 double, x1 double, y1 double")
    assert {r["track"]: r["chain"] for r in T.link_tracklets(t, "clip", "track", radius=30.0).collect()} == {1: 1, 2: 2, 3: 1}
