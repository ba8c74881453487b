"""Ordered scans whose state is keyed by buckets of groups."""

import random

import pandas as pd
import pytest

from kelpline.plans import catalogue, streams
from kelpline.streaming import scans, signals
from tests import oracle
from tests.test_state import SCHEMA, out_of_order, put, sessions


class States:
    """A handle whose lists are in memory and whose calls are counted."""

    def __init__(self):
        self.lists, self.calls, self.timers = {}, [], []

    def registerTimer(self, ms):
        self.timers.append(ms)

    def getListState(self, name, schema):
        states, held = self, self.lists.setdefault(name, [])

        class List:
            def get(self):
                states.calls.append((name, "get"))
                return iter(list(held))

            def appendValue(self, value):
                states.calls.append((name, "append"))
                held.append(value)

            def put(self, values):
                states.calls.append((name, "put"))
                held[:] = values

            def clear(self):
                states.calls.append((name, "clear"))
                held.clear()

        return List()


class Mark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_calls_are_a_few_a_bucket_however_many_groups():
    big = 2**60  # neighbours that are one number as doubles
    rows = [(big + g, 1_000_000 * k + g, 10 * g + k, float(g * k)) for g in range(300) for k in range(1, 5)]
    random.Random(5).shuffle(rows)
    states, work = States(), scans.OrderedScan(scans.Differences(), "g", "long", ["of", "t", "row", "x0"], 1_500_000)
    work.init(states)
    frames = [pd.DataFrame(rows[k : k + 700], columns=work.columns) for k in (0, 700)]
    assert list(work.handleInputRows((7,), iter(frames), None)) == []
    assert states.calls == [("pending", "append")] * 2 and states.timers == [999]
    states.calls.clear()
    (out,) = work.handleExpiredTimer((7,), Mark(3_500), None)  # all but each group's last row
    assert states.calls == [("open", "get"), ("pending", "get"), ("pending", "put"), ("open", "put")] and states.timers[1:] == [3_999]
    assert {tuple(r) for r in out.itertuples(index=False)} == {(big + g, 1_000_000 + g, 10 * g + k, float(g) if k > 1 else 0.0) for g in range(300) for k in range(1, 4)}
    assert len(out) == 900 and len(states.lists["open"]) == 300
    (out,) = work.handleExpiredTimer((7,), Mark(9_000), None)
    assert sorted(out["g"]) == [big + g for g in range(300)] and out["difference"].tolist() == [float(g) for g in range(300)]
    assert states.lists == {"pending": [], "open": []} and len(states.timers) == 2


@pytest.mark.parametrize("fold", [scans.Differences(), scans.Average()])
def test_buckets_over_out_of_order_files(spark, tmp_path, fold):
    rows = out_of_order(random.Random(6))
    for k in range(7):
        put(spark, tmp_path / "in", k, rows[k * 31 : k * 31 + 31])
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    with scans.state_store(spark):
        found = scans.scan(stream, fold, "g", "ts", "i", ["v"], gap="1 hour", late="15 minutes", buckets=2)
        got = {tuple(r) for r in signals.run_to_end(found, str(tmp_path / "out"), str(tmp_path / "state")).collect()}
    want = set()
    for k, own in sessions(rows).items():
        state, out = fold.step(fold.fresh(), own)
        want |= {(*k, *x) for x in [*out, *fold.finish(state)]}
    assert len(rows) <= 7 * 31 and got == want
    held = lambda name: {r["key"]["bucket"] for r in spark.read.format("statestore").option("path", str(tmp_path / "state")).option("stateVarName", name).load().select("key").collect()}
    assert held("open") == set() and len(held("pending")) == 1  # only the last row waits


def test_the_query_keeps_its_users_in_buckets(spark, sf_dir, tmp_path, monkeypatch):
    assert streams.buckets(spark, sf_dir) == 512
    monkeypatch.setattr(streams, "buckets", lambda *_: 3)
    monkeypatch.setattr(streams, "scratch", lambda *_: str(tmp_path))
    con = oracle.connect(sf_dir)
    oracle.check(spark, con, sf_dir, catalogue.QUERIES["stream_differences"], catalogue.ORACLES["stream_differences"])
    keys = {r["key"]["bucket"] for r in spark.read.format("statestore").option("path", f"{tmp_path}/state").option("stateVarName", "open").load().select("key").collect()}
    assert len(keys) <= 3 < con.execute("SELECT count(DISTINCT user_id) FROM events").fetchone()[0]
