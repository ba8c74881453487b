"""Tests of ranks, resampling, learning, files, streams and what the queries without SQL give."""

import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from kelpline.operators import learning as L
from kelpline.operators import merging as M
from kelpline.operators import sampling as S
from kelpline.operators import statistics as X
from kelpline.plans.catalogue import QUERIES
from kelpline.sources import files, seams
from kelpline.streaming import signals


def test_chi_square_tail():
    for x, df, p in ((3.841459, 1, 0.05), (5.991465, 2, 0.05), (7.814728, 3, 0.05), (18.30704, 10, 0.05), (24.99579, 15, 0.05), (0, 4, 1.0)):
        assert X.chi_square_tail(x, df) == pytest.approx(p, abs=1e-6)


def test_tests_of_ranks(spark):
    rows = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4)] + [("b", float(v)) for v in (5, 6, 7, 8)], "g string, v double")
    out = X.kruskal(rows, "g", "v").first()
    assert out["h"] == pytest.approx(16 / 3) and out["p"] == pytest.approx(0.0209213, abs=1e-6)
    same = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "g string, v double")
    assert X.kruskal(same, "g", "v").first()["h"] == 0
    signs = X.sign_test(spark.createDataFrame([(1.0,)] * 9 + [(-1.0,), (0.0,)], "d double"), F.col("d")).first()
    assert signs["n"] == 10 and signs["p"] == pytest.approx(2 * 11 / 1024)
    holm = {r["t"]: r["p_holm"] for r in X.holm(spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "t string, p double"), "p", "t").collect()}
    assert holm == pytest.approx({"a": 0.03, "c": 0.06, "b": 0.06})


def test_ranges_rank_like_one_order(spark):
    rng = np.random.default_rng(0)
    v = rng.integers(0, 300, 2000).astype(float)
    got = {r["v"]: r["rank"] for r in X.ranked_by_range(spark.createDataFrame([(x,) for x in v.tolist()], "v double"), "v", parts=7).collect()}
    s = np.sort(v)
    assert got == {x: (np.searchsorted(s, x) + np.searchsorted(s, x, "right") + 1) / 2 for x in set(v.tolist())}


def test_fleiss_by_hand(spark):
    table = [(0, 0, 0, 0, 14), (0, 2, 6, 4, 2), (0, 0, 3, 5, 6), (0, 3, 9, 2, 0), (2, 2, 8, 1, 1), (7, 7, 0, 0, 0), (3, 2, 6, 3, 0), (2, 5, 3, 2, 2), (6, 5, 2, 1, 0), (0, 2, 2, 3, 7)]
    rows = [(i, k) for i, own in enumerate(table) for k, n in enumerate(own) for _ in range(n)]
    out = X.fleiss_kappa(spark.createDataFrame(rows, "item int, label int"), "item", "label").first()
    assert out["kappa"] == pytest.approx(0.20993, abs=1e-4) and out["raters"] == 14


def test_tip_scores_conventions(spark):
    frames = spark.createDataFrame([(0, 0, 0), (0, 0, 3), (0, 2, 0), (2, 4, 2)], "hits int, predicted int, truth int")
    out = X.tip_scores(frames, "hits", "predicted", "truth").first()
    assert out["precision"] == pytest.approx((1 + 0 + 0 + 0.5) / 4) and out["recall"] == pytest.approx((1 + 0 + 1 + 1) / 4)


def test_resamples_have_as_many_clusters(spark):
    clusters = spark.createDataFrame([(f"c{i}",) for i in range(12)], "c string")
    per = X.drawn_clusters(clusters, "c", 300, "x").groupBy("iteration").agg(F.sum("m").alias("m"), F.count("*").alias("n"))
    assert per.where("m <> 12").count() == 0 and per.count() == 300 and 6.5 < per.agg(F.avg("n")).first()[0] < 9


@pytest.mark.parametrize("sizes,budget,want", [((5, 50, 50), 45, (5, 20, 20)), ((2, 3, 4), 100, (2, 3, 4)), ((10, 10), 7, (3, 3)), ((1, 100), 0, (0, 0))])
def test_water_filling(spark, sizes, budget, want):
    rows = spark.createDataFrame([(f"k{i}", 1000 * i + j) for i, n in enumerate(sizes) for j in range(n)], "label string, id int")
    got = {r["label"]: r["count"] for r in S.water_filled(rows, "label", "id", budget).groupBy("label").count().collect()}
    assert tuple(got.get(f"k{i}", 0) for i in range(len(sizes))) == want


def test_greedy_overall_equals_a_loop(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(12, 8))
    v = np.concatenate([base, base + 0.2 * rng.normal(size=(12, 8)), base + 0.3 * rng.normal(size=(12, 8))])
    rows = [(i % 4, i, x.tolist()) for i, x in enumerate(v)]
    unit = v / np.linalg.norm(v, axis=1)[:, None]

    def greedy(ids, t):
        kept = []
        for i in ids:
            if all(unit[i] @ unit[j] < t for j in kept):
                kept.append(i)
        return kept

    within = sorted(itertools.chain.from_iterable(greedy([i for i in range(36) if i % 4 == g], 0.93) for g in range(4)))
    want = greedy(within, 0.95)[:10]
    df = spark.createDataFrame(rows, "video int, id int, vec array<double>")
    assert sorted(r["id"] for r in M.greedy_keep_overall(df, "video", "id", "vec", 0.93, 0.95, 10).collect()) == want


def test_matches_equal_an_exhaustive_search(spark, sf_dir):
    """Each frame's least total distance over all one-to-one matchings, of which the pairs within the radius stay."""
    from kelpline.plans.catalogue import observations

    best = QUERIES["hungarian_match"](spark, sf_dir).toPandas()
    points = observations(spark, sf_dir).selectExpr("seq div 12 AS frame", "seq", "value", "double(k) AS y").toPandas()
    got = {f: g for f, g in best.groupby("frame")}
    for f, own in points.groupby("frame"):
        a, b = own[own["seq"] % 2 == 0], own[own["seq"] % 2 == 1]
        if len(a) > len(b):
            a, b = b, a
        d = np.hypot(a["value"].to_numpy()[:, None] - b["value"].to_numpy(), a["y"].to_numpy()[:, None] - b["y"].to_numpy())
        orders = np.array(list(itertools.permutations(range(len(b)), len(a))))
        totals = d[np.arange(len(a)), orders].sum(axis=1)
        want = d[np.arange(len(a)), orders[totals.argmin()]]
        found = got[f]["distance"].to_numpy() if f in got else np.empty(0)
        assert sorted(found) == pytest.approx(sorted(want[want <= 60.0]))


def test_tracklets_equal_a_loop(spark):
    from kelpline.operators import tracking as T

    rng = np.random.default_rng(6)
    rows = []
    for clip in range(6):
        for track in range(25):
            first = int(rng.integers(0, 60))
            rows.append((clip, track, first, first + int(rng.integers(0, 6)), *[float(x) for x in rng.uniform(0, 12, 4)]))
    df = spark.createDataFrame(rows, "clip int, track long, first int, last int, x0 double, y0 double, x1 double, y1 double")
    got = {(r["clip"], r["track"]): r["chain"] for r in T.link_tracklets(df, "clip", "track", radius=2.0).collect()}
    for clip in range(6):
        own = {r[1]: r for r in rows if r[0] == clip}
        after: dict = {}
        while True:  # the cheapest link left, again and again
            open_ = [(math.hypot(own[b][4] - own[a][6], own[b][5] - own[a][7]), a, b) for a in own for b in own if a != b and a not in after and b not in after.values() and 1 <= own[b][2] - own[a][3] <= 8]
            open_ = [x for x in open_ if x[0] <= 2.0 * (own[x[2]][2] - own[x[1]][3])]
            if not open_:
                break
            _, a, b = min(open_)
            after[a] = b
        before = {b: a for a, b in after.items()}
        for track in own:
            head = track
            while head in before:
                head = before[head]
            assert got[clip, track] == head


def test_graph_metrics_and_states_by_hand(spark):
    from kelpline.operators import tracking as T

    edges = spark.createDataFrame([("g", 1, 2, 1.0), ("g", 2, 3, 1.0), ("g", 3, 1, 1.0), ("g", 7, 8, 3.0)], "g string, a int, b int, n double")
    out = T.graph_metrics(edges, "g", "a", "b", "n").first()
    assert (out["nodes"], out["edges"], out["components"], out["cycles"], out["total_length"]) == (5, 4, 2, 1, 6.0)
    assert out["symmetry"] == pytest.approx(1 - np.std([1, 1, 1, 3]) / 1.5)
    series = spark.createDataFrame([("c", "n", t, v) for t, v in enumerate((1.0, 1.5, None, 9.0, 5.5))], "clip string, node string, t int, v double")
    got = [(r["state"], r["fitted"]) for r in T.arm_states(series, "clip", "node", "t", "v", jump=2.0).orderBy("t").collect()]
    assert got == [("detected", 1.0), ("detected", 1.5), ("occluded", 1.5), ("fitted", 5.25), ("detected", 5.5)]


def test_linear_head_fits_its_rows(spark, sf_dir):
    out = QUERIES["linear_head"](spark, sf_dir).toPandas()
    own = out[out.vec_id % 4 != 0]
    assert len(out) == out.vec_id.nunique() and (own.label == own.prediction).mean() > 1.5 * own.label.value_counts(normalize=True).max()


def test_learning_from_soft_targets(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4))
    p = 1 / (1 + np.exp(-3 * x[:, 0]))
    rows = spark.createDataFrame([(i, v.tolist(), [float(1 - q), float(q)], 1.0) for i, (v, q) in enumerate(zip(x, p, strict=True))], "id int, f array<double>, t array<double>, w double")
    soft = L.soft_rows(rows, "t", "w")
    assert soft.agg(F.sum("w")).first()[0] == pytest.approx(300)
    model = L.linear(soft, "f", "class", "w")
    out = L.predicted(model, rows, "f").toPandas()
    assert np.corrcoef([q[1] for q in out.probability], p)[0, 1] > 0.97
    L.keep_model(model, str(tmp_path / "m"), {"f1": 0.5})
    assert spark.read.parquet(str(tmp_path / "m" / "metrics")).first()["value"] == 0.5
    hard = rows.withColumn("y", (F.get("t", 1) > 0.5).cast("double"))
    net = L.predicted(L.perceptron(hard, "f", "y", [4, 5, 2]), hard, "f")
    assert net.where("prediction = y").count() > 280
    mixed = L.mixed(rows, "id", "f", "t", "s").toPandas()
    assert len(mixed) == 300 and np.allclose([sum(t) for t in mixed.t], 1)
    noisy = L.jittered(rows, "id", "f", 3, 0.1, 0.25).orderBy("id").toPandas()
    zero = np.mean([[v == 0 for v in f] for f in noisy.f])
    assert 0.18 < zero < 0.32 and np.allclose(L.jittered(rows, "id", "f", 3, 0.1, 0.25).orderBy("id").toPandas().f.tolist(), noisy.f.tolist())
    grid = L.swept(spark, {"reg": [0.1, 0.01], "k": [1]}, [0, 1], lambda seed, reg, k: {"val": reg + seed, "test": k})
    assert grid.count() == 4 and X.seed_report(grid, "config", "val").count() == 2


def test_swaps_survive_a_death_in_between(spark, tmp_path):
    path = str(tmp_path / "t")
    files.replace_table(spark.range(3), path)
    files.replace_table(spark.range(5), path)
    assert files.read_table(spark, path).count() == 5
    (tmp_path / "t").rename(tmp_path / "t.old")  # died between the two renames
    assert files.read_table(spark, path).count() == 5
    files.replace_table(files.read_table(spark, path).union(spark.range(1)), path) if (tmp_path / "t").exists() else files.replace_table(spark.range(6), path)
    assert files.read_table(spark, path).count() == 6 and not (tmp_path / "t.old").exists()


def test_loose_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name\n1,"two\nlines"\nid,name\n3,c\n')
    schema = StructType([StructField("id", StringType()), StructField("name", StringType())])
    rows, rejects = files.csv(spark, str(tmp_path / "a.csv"), schema)
    assert sorted(tuple(r) for r in rows.collect()) == [("1", "two\nlines"), ("3", "c"), ("id", "name")] and rejects.count() == 0
    (tmp_path / "n.jsonl").write_text('{"k": 1, "s": 1}\n{"k": 1, "s": 2}\nbroken\n{"s": 3}\n')
    own = StructType([StructField("k", IntegerType()), StructField("s", IntegerType())])
    rows, rejects = files.jsonl(spark, str(tmp_path / "n.jsonl"), own, "k", "s")
    assert [tuple(r) for r in rows.collect()] == [(1, 2)] and rejects.count() == 2
    np.savez(tmp_path / "f.npz", a=np.arange(4.0).reshape(2, 2), b=np.ones(3))
    np.save(tmp_path / "g.npy", np.zeros((1, 2)))
    got = {(r["path"][-5:], r["name"]): (r["shape"], r["values"]) for r in files.arrays(spark, str(tmp_path)).collect()}
    assert got["f.npz", "a"] == ([2, 2], [0, 1, 2, 3]) and got["f.npz", "b"] == ([3], [1, 1, 1]) and got["g.npy", ""] == ([1, 2], [0, 0])
    packed = files.packed(spark.createDataFrame([(1, [0.5, 2.0])], "id int, v array<double>"), "id", "v")
    assert len(packed.first()["data"]) == 4 and files.unpacked(packed, "id").first()["values"] == [0.5, 2.0]


def test_exports_refuse_what_is_too_large(spark):
    for call in (lambda: files.envelope(spark.range(5), "d", "rows", most=4), lambda: files.latex(spark.range(5), "c", most=4), lambda: files.html(spark.range(5), "t", most=4)):
        with pytest.raises(ValueError):
            call()
    assert json.loads(files.envelope(spark.range(4), "d", "rows", most=4).first()["json"])["n_rows"] == 4
    assert "width:50.0%" in files.html(spark.createDataFrame([("a<b", 0.5)], "name string, bar double"), "t", bar="bar")


def test_a_crawl_goes_down_level_by_level(spark):
    site = {"http://h/": '<a href="?C=N">x</a><a href="../">up</a><a href="a/">a</a><a href="f.txt">f</a>', "http://h/a/": '<a href="b.mp4">b</a>'}
    out = files.crawled(spark.createDataFrame([("http://h/",)], "u string"), lambda u, site=site: site.get(u, ""), "u", 2)
    assert sorted((r["url"], r["level"]) for r in out.collect()) == [("http://h/", 0), ("http://h/a/", 1), ("http://h/a/b.mp4", 2), ("http://h/f.txt", 1)]


def test_points_in_videos(spark):
    rows = spark.createDataFrame([(1, "u", 0.5), (2, "v", 9.0)], "id int, url string, t double")
    got = seams.frames_at(rows, lambda u, t: u.encode() if t < 5 else None, "id", "url", "t").orderBy("id").collect()
    assert bytes(got[0]["frame"]) == b"u" and got[1]["frame"] is None
    assert spark.range(1).select(seams.even_times(F.lit(2.0), 2.0).alias("t")).first()["t"] == [0, 0.5, 1.0, 1.5]


def test_a_file_is_left_once_enough_is_found(spark, tmp_path):
    read = []

    def decode(raw):
        for t, b in enumerate(bytes(raw)):
            read.append(t)
            yield t, b / 255

    on, off = bytes([255]), bytes([0])
    rows = spark.createDataFrame([(1, bytearray(off * 10 + on * 60 + off * 300)), (2, bytearray(off * 200))], "id int, raw binary")
    got = [tuple(r) for r in seams.windows_until(rows, decode, "id", "raw").collect()]
    assert got == [(1, 1, 0.55, 64), (1, 21, 1.0, 64)]
    calls = []
    make = lambda: calls.append(1) or spark.range(3)
    assert [files.cached(spark, str(tmp_path / "p"), "ema", make).count() for _ in range(2)] == [3, 3] and calls == [1]


def test_stream_forms(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(int(g), i, float(v)) for i, (g, v) in enumerate(zip(rng.integers(0, 3, 60), rng.normal(size=60), strict=True))]
    source = tmp_path / "in"
    for k in range(3):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], "g int, i int, v double").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("g int, i int, v double").option("maxFilesPerTrigger", 100).parquet(str(source))
    times = spark.readStream.schema("g int, i int, v double").parquet(str(source)).withColumn("ts", F.timestamp_seconds(F.col("i") * 3600))
    done = signals.run_to_end(signals.sliding(times, "ts", "g", "v", width="6 hours", slide="3 hours", late="0 hours"), str(tmp_path / "o2"), str(tmp_path / "c2"))
    assert done.where("n > 0").count() > 0 and done.agg(F.max("n")).first()[0] <= 6
    seen, saved = [], []
    signals.saved_batches(stream, lambda df, k: saved.append(df.count()), seen.append, str(tmp_path / "c3"))
    assert sum(saved) == 60 and seen == list(range(len(seen)))


def test_a_refusal_ends_the_run_and_saves_the_rest(spark):
    kept = []
    todo = lambda: spark.range(4)
    with pytest.raises(signals.OutOfCredit):
        signals.work_until_refused(todo, lambda df: df.withColumn("error", F.when(F.col("id") == 3, "credit")), lambda df: kept.append(df.count()), F.coalesce(F.col("error") == "credit", F.lit(False)))
    assert kept == [3] and math.isfinite(1.0)
