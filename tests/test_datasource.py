"""The listing source with its pushed filter, and the frames table function."""

import io

import numpy as np
import pytest
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

from kelpline.sources import datasource


@pytest.fixture
def tree(tmp_path):
    for day in range(1, 9):
        for cam in ("date=a", "b"):
            at = tmp_path / "root" / f"2024-01-{day:02d}" / cam / "deep"
            at.mkdir(parents=True)
            (at / "x.mp4").write_bytes(b"1" * day)
            (at / "_hidden").write_bytes(b"")
        (tmp_path / "root" / f"2024-01-{day:02d}" / "top.mp4").write_bytes(b"22")
    (tmp_path / "root" / "_log").mkdir()
    (tmp_path / "root" / "_log" / "x").write_bytes(b"")
    (tmp_path / "root" / "file").write_bytes(b"")
    return str(tmp_path / "root")


def test_listing_equals_a_walk(spark, tree):
    rows = datasource.clip_listing(spark, tree, dates=3)
    got = sorted((r["date"], r["camera"] or "", r["name"], r["bytes"]) for r in rows.collect())
    want = sorted((f"2024-01-{d:02d}", c, n, b) for d in range(1, 9) for c, n, b in (("a", "x.mp4", d), ("b", "x.mp4", d), ("", "top.mp4", 2)))
    assert got == want and rows.rdd.getNumPartitions() == 3
    assert rows.first()["path"].startswith(tree)


def test_only_folders_of_the_dates_asked_for_are_read(spark, tree):
    rows = datasource.clip_listing(spark, "file:" + tree, dates=1).where("date >= '2024-01-03' AND date < '2024-01-06' AND camera = 'b'")
    assert sorted(r["date"] for r in rows.collect()) == ["2024-01-03", "2024-01-04", "2024-01-05"]
    assert rows.rdd.getNumPartitions() == 3
    reader = datasource.ListingReader(tree, 16)
    kept = [GreaterThanOrEqual(("date",), "2024-01-07"), In(("date",), ("2024-01-01", "2024-01-08"))]
    left = [EqualTo(("camera",), "b"), LessThan(("bytes",), 5)]
    assert list(reader.pushFilters([*kept, *left])) == left
    assert [p.folders for p in reader.partitions()] == [[f"{tree}/2024-01-08"]]


def test_listing_of_nothing(spark, tmp_path):
    assert datasource.clip_listing(spark, str(tmp_path / "absent")).count() == 0


def saved(a):
    out = io.BytesIO()
    np.save(out, a)
    return out.getvalue()


def test_frames_by_a_lateral_join(spark):
    datasource.register(spark)
    stack = np.arange(7 * 2 * 3).reshape(7, 2, 3)
    clips = spark.createDataFrame([("a", saved(stack)), ("b", None), ("c", saved(np.zeros((0, 2, 2)))), ("d", saved(np.ones(3)))], "clip string, content binary")
    got = spark.sql("SELECT clip, f.* FROM {clips}, LATERAL frames(content, 30.0D, 12.0D) f", clips=clips).collect()
    assert [(r["clip"], r["frame"]) for r in got] == [("a", 0), ("a", 2), ("a", 5), ("d", 0), ("d", 2)]
    for r in got:
        if r["clip"] == "a":
            assert r["shape"] == [2, 3] and r["pixels"] == stack[r["frame"]].ravel().tolist() and r["t"] == pytest.approx(r["frame"] / 30)
    every = spark.sql("SELECT count(*) AS n FROM {clips}, LATERAL frames(content, 5.0D, 60.0D) f WHERE clip = 'a'", clips=clips)
    assert every.first()["n"] == 7


def test_stacks_hold_vectors_in_order(spark):
    rows = spark.createDataFrame([(1, k, [float(k), 0.5]) for k in (3, 1, 2)], "clip int, k int, v array<double>")
    row = datasource.stacks(rows, "clip", "k", "v").first()
    assert np.load(io.BytesIO(row["content"])).tolist() == [[1.0, 0.5], [2.0, 0.5], [3.0, 0.5]]
