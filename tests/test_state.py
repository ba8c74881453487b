"""Scans with state over out-of-order files, versioned tables, upserts of streams."""

import os
import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from kelpline.operators import windows as W
from kelpline.sources.snapshots import Conflict, Table, upsert_stream
from kelpline.streaming import scans, signals

DAY = datetime(2024, 1, 1)
SCHEMA = "g string, ts timestamp, i long, v double"


def put(spark, folder, k, rows, schema=SCHEMA):
    """One file, the k-th in the order a stream takes them."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/b{k}")
    for name in os.listdir(f"{folder}/b{k}"):
        os.utime(f"{folder}/b{k}/{name}", (1_700_000_000 + 10 * k,) * 2)


def out_of_order(rng, late_s=600):
    """Rows of three groups a minute apart with a pause of three hours, in files by a time that is off by up to the lateness."""
    rows = []
    for g in "abc":
        t = DAY + timedelta(seconds=rng.randrange(60))
        for i in range(70):
            t += timedelta(seconds=rng.randrange(1, 90)) if i != 30 else timedelta(hours=3)
            rows.append((g, t, i, float(rng.randrange(100))))
    rows.append(("d", DAY + timedelta(hours=12), 0, 1.0))  # moves the watermark past all others
    return sorted(rows, key=lambda r: r[1] + timedelta(seconds=rng.randrange(late_s)))


def streamed(spark, tmp_path, rows, fold, inputs, files=7):
    size = -(-len(rows) // files)
    for k in range(files):
        put(spark, tmp_path / "in", k, rows[k * size : (k + 1) * size])
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    with scans.state_store(spark):
        out = signals.run_to_end(scans.scan(stream, fold, "g", "ts", "i", inputs, gap="1 hour", late="15 minutes"), str(tmp_path / "out"), str(tmp_path / "state"))
    return [r.asDict() for r in out.collect()]


def sessions(rows):
    """(group, session's first time): its rows in order."""
    out, last = {}, {}
    for g, t, i, v in sorted(rows):
        if g == "d":
            continue
        if g not in last or t - last[g][1] > timedelta(hours=1):
            last[g] = (t, t)
        last[g] = (last[g][0], t)
        out.setdefault((g, last[g][0]), []).append((i, v))
    return out


def test_differences_over_out_of_order_files(spark, tmp_path):
    rows = out_of_order(random.Random(1))
    got = {(r["g"], r["session"], r["row"]): r["difference"] for r in streamed(spark, tmp_path, rows, scans.Differences(), ["v"])}
    want = {(*k, i): (abs(v - own[n - 1][1]) if n else 0.0) for k, own in sessions(rows).items() for n, (i, v) in enumerate(own)}
    assert got == want and len(sessions(rows)) == 6


def test_averages_and_the_end_of_state(spark, tmp_path):
    rows = out_of_order(random.Random(2))
    got = {(r["g"], r["session"]): (r["ema"], r["n"]) for r in streamed(spark, tmp_path, rows, scans.Average(), ["v"])}
    want = {}
    for k, own in sessions(rows).items():
        e = own[0][1]
        for _, v in own[1:]:
            e = 0.45 * v + 0.55 * e
        want[k] = (pytest.approx(e), len(own))
    assert got == want
    held = lambda name: {r["key"]["g"] for r in spark.read.format("statestore").option("path", str(tmp_path / "state")).option("stateVarName", name).load().select("key").collect()}
    assert held("open") == set() and held("pending") == {"d"}  # of all groups only the last row waits


def test_windows_equal_their_batch_form(spark, tmp_path):
    rows = out_of_order(random.Random(3))
    got = {(r["g"], r["session"], r["start"]): (r["visible_frac"], r["mean_motion"]) for r in streamed(spark, tmp_path, rows, scans.Windows(length=6, step=4, threshold=30, least_motion=40), ["v", "v"])}
    batch = spark.createDataFrame([(f"{g}{t.timestamp()}", i, v) for (g, t), own in sessions(rows).items() for i, v in own], "s string, i long, v double")
    want = W.greedy_windows(batch, "s", "i", "v", "v", length=6, step=4, threshold=30, least_motion=40).collect()
    assert {(f"{g}{t.timestamp()}", s): x for (g, t, s), x in got.items()} == {(r["s"], r["start"]): (pytest.approx(r["visible_frac"]), pytest.approx(r["mean_motion"])) for r in want}
    assert len(want) > 10


def test_windows_stop_at_most():
    fold = scans.Windows(length=2, step=2, threshold=1, most=1)
    state, out = fold.step(fold.fresh(), [(0, 1.0, 1.0)] * 5)
    assert [x[0] for x in out] == [0] and fold.step(state, [(0, 1.0, 1.0)] * 9)[1] == []
    with pytest.raises(ValueError, match="step"):
        scans.Windows(length=2, step=3)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_of_two_writers_one_retries(spark, tmp_path):
    at = str(tmp_path / "t")
    one, other = Table(spark, at), Table(spark, at)
    one.write(spark.createDataFrame([(1, "a")], "k long, v string"))
    pinned = other.read(1)
    calls = []

    def change(df):
        calls.append(df.count())
        if len(calls) == 1:  # another writer commits in between
            other.update(lambda x: x.unionByName(spark.createDataFrame([(2, "b")], x.schema)))
        return df.withColumn("v", F.upper("v"))

    assert one.update(change) == 3 and calls == [1, 2]
    assert rows_of(one.read()) == [(1, "A"), (2, "B")]
    assert rows_of(pinned) == [(1, "a")] and rows_of(one.read(2)) == [(1, "a"), (2, "b")]
    with pytest.raises(Conflict):
        one.write(one.read(), base=2)
    named = {p.rpartition("/")[0] for v in one.versions() for p in one.manifest(v)["parts"].values()}
    assert {f"data/{d}" for d in os.listdir(f"{at}/data")} == named  # losers leave nothing
    one.expire(keep=1)
    assert one.versions() == [3] and rows_of(one.read()) == [(1, "A"), (2, "B")] and len(os.listdir(f"{at}/data")) == 1 + 2


def test_upserts_take_the_last_row_and_each_batch_once(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"), ["k"], buckets=4)
    make = lambda *rows: spark.createDataFrame(list(rows), "k long, at int, v string")
    t.upsert(make((1, 5, "a"), (1, 7, "b"), (2, 1, "c"), (3, None, "n")), ["at"], ("s", 0))
    t.upsert(make((1, 6, "old"), (2, 1, "tie"), (3, 0, "m"), (None, 1, "z")), ["at"], ("s", 1))
    want = [(1, 7, "b"), (2, 1, "c"), (3, 0, "m")]
    assert sorted(tuple(r) for r in t.read().where("k IS NOT NULL").collect()) == want and t.read().count() == 4
    version = t.version()
    assert t.upsert(make((1, 99, "replayed")), ["at"], ("s", 1)) == version and t.version() == version
    before = t.manifest(version)["parts"]
    t.upsert(make((1, 8, "new")), ["at"], ("s", 2))
    after = t.manifest(t.version())["parts"]
    assert sum(before[b] != after[b] for b in after) == 1 and rows_of(t.read().where("k = 1")) == [(1, 8, "new")]
    assert t.upsert(make().limit(0), ["at"], ("s", 3)) == t.version()


def test_upsert_stream_survives_a_replay(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice("abcdef"), DAY + timedelta(minutes=rng.randrange(600)), i, float(i)) for i in range(120)]
    for k in range(4):
        put(spark, tmp_path / "in", k, rows[30 * k : 30 * k + 30])
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    t = Table(spark, str(tmp_path / "t"), ["g"], buckets=3)
    upsert_stream(stream, t, ["ts", "i"], str(tmp_path / "state"), name="s")
    want = sorted(max((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])) for g in {r[0] for r in rows})
    assert rows_of(t.read()) == want and t.manifest(t.version())["marks"] == {"s": 3}
    version = t.version()
    upsert_stream(stream, t, ["ts", "i"], str(tmp_path / "lost"), name="s")  # all batches again
    assert t.version() == version and rows_of(t.read()) == want


def test_upsert_stream_drops_copies_within_the_lateness(spark, tmp_path):
    rows = [("a", DAY, 1, 1.0), ("a", DAY, 1, 1.0), ("a", DAY + timedelta(minutes=1), 2, 2.0), ("b", DAY, 1, 3.0)]
    put(spark, tmp_path / "in", 0, rows)
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    t = Table(spark, str(tmp_path / "t"), ["g"], buckets=2)
    upsert_stream(stream, t, ["ts", "i"], str(tmp_path / "state"), name="s", late="1 hour")
    assert rows_of(t.read().select("g", "v")) == [("a", 2.0), ("b", 3.0)]


def test_streamed_tracklets_equal_the_batch(spark, tmp_path):
    """Over files by beginning, off by up to the lateness; all that is closed has left the state."""
    from kelpline.operators import tracking as T

    rng = random.Random(8)
    schema = "clip string, ts timestamp, track long, first long, last long, x0 double, y0 double, x1 double, y1 double"
    start = int(DAY.timestamp())
    rows = []
    for clip in "pqr":
        for track in range(90):
            first = start + rng.randrange(400)
            rows.append((clip, datetime.fromtimestamp(first), track, first, first + rng.randrange(12), *[rng.uniform(0, 14) for _ in range(4)]))
    ahead = start + 5000
    order = sorted(rows, key=lambda r: r[3] + rng.randrange(40)) + [("z", datetime.fromtimestamp(ahead), 0, ahead, ahead, 0.0, 0.0, 0.0, 0.0)]
    for k in range(0, len(order), 40):
        put(spark, tmp_path / "in", k // 40, order[k : k + 40], schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    with scans.state_store(spark):
        links = signals.run_to_end(scans.track_links(stream, "clip", "ts", radius=1.5, late="60 seconds"), str(tmp_path / "out"), str(tmp_path / "state")).collect()
    before = {(r["clip"], r["next"]): r["track"] for r in links}
    assert len(before) == len(links) == len({(r["clip"], r["track"]) for r in links}) > 60
    want = T.link_tracklets(spark.createDataFrame(rows, schema), "clip", "track", radius=1.5).collect()
    for r in want:
        head = r["track"]
        while (r["clip"], head) in before:
            head = before[r["clip"], head]
        assert head == r["chain"]
    state = spark.read.format("statestore").option("path", str(tmp_path / "state")).option("stateVarName", "open").load().select("key").collect()
    assert {r["key"]["clip"] for r in state} == {"z"}


def test_a_clip_sets_one_timer():
    """However many tracks wait: the timer for what is closed next sets that of the rest."""
    timers: list = []
    rows = [(k, 10 * k, 10 * k + 3, 0.0, 0.0, 0.0, 0.0) for k in range(1, 30)]
    pdf = pd.DataFrame(rows, columns=["track", "first", "last", "x0", "y0", "x1", "y1"])

    class Open:
        held: list = []

        def appendList(self, new):
            self.held = self.held + new

        def get(self):
            return iter(self.held)

        def put(self, new):
            self.held = new

        def clear(self):
            self.held = []

    class Handle:
        registerTimer = staticmethod(timers.append)

        def getListState(self, *_):
            return Open()

    class Mark:
        def getCurrentWatermarkInMs(self):
            return 150_000

    work = scans.TrackLinks("clip", 8, 50.0, 1000)
    work.init(Handle())
    list(work.handleInputRows(("c",), iter([pdf]), None))
    assert timers == [21_000 - 1]
    found = pd.concat(work.handleExpiredTimer(("c",), Mark(), None))
    assert found["next"].tolist() == list(range(2, 15)) and timers[1:] == [151_000 - 1]
