"""Masks, skeletons and frames as arrays, on shapes whose answer is known."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpline.operators import images as I
from kelpline.operators import skeletons as K


def disc(h, w, cy, cx, r):
    y, x = np.indices((h, w))
    return np.hypot(y - cy, x - cx) <= r


def cross(size=41, wide=2):
    m = np.zeros((size, size), bool)
    c = size // 2
    m[c - wide : c + wide + 1, 3:-3] = True
    m[3:-3, c - wide : c + wide + 1] = True
    return m | disc(size, size, c, c, 6)


def test_components_and_holes():
    m = np.zeros((12, 12), bool)
    m[1:4, 1:4] = m[6:11, 6:11] = True
    m[8, 8] = False
    m[4, 4] = True  # touches the first by a corner
    label = I.components(m)
    assert label.max() == 2 and (I.largest_component(m) == (label == 2)).all()
    assert I.filled(I.largest_component(m)).sum() == 25 and not I.largest_component(np.zeros((3, 3))).any()
    snake = np.zeros((9, 9), bool)
    snake[::2] = True
    snake[1::4, -1] = snake[3::4, 0] = True
    assert I.components(snake).max() == 1


def test_distance_is_euclidean():
    m = disc(21, 25, 9, 11, 7)
    m[9, 11] = False
    outside = np.argwhere(~np.pad(m, 1)) - 1
    want = np.array([[np.hypot(*(outside - [y, x]).T).min() if m[y, x] else 0 for x in range(25)] for y in range(21)])
    assert I.distance(m) == pytest.approx(want)


def test_thinning_keeps_the_shape():
    thin = I.thinned(cross())
    assert I.components(thin).max() == 1 and 20 < thin.sum() < 100 and (I.degree(thin) == 1).sum() == 4
    spur = thin.copy()
    y, x = np.argwhere(I.degree(thin) == 2)[0]
    assert I.without_spurs(spur, 3).sum() <= thin.sum() and thin[y, x]


def test_skeleton_graph_of_a_cross():
    nodes, edges = I.skeleton_graph(cross(), points=4)
    tips = nodes[nodes.is_tip]
    assert len(tips) == 4 and len(edges) == len(nodes) - 1 and nodes.is_center.sum() == 1
    far = tips[["x", "y"]].to_numpy() - 20
    assert (np.abs(far).max(axis=1) > 12).all() and (np.abs(far).min(axis=1) < 3).all()
    assert sorted(np.sign(np.where(np.abs(far) > 12, far, 0)).astype(int).tolist()) == [[-1, 0], [0, -1], [0, 1], [1, 0]]
    empty, none = I.skeleton_graph(np.zeros((9, 9), bool))
    assert empty.empty and none.empty


def test_body_parts_need_a_neck():
    m = disc(40, 60, 20, 18, 12) | disc(40, 60, 20, 44, 7)
    m[18:23, 18:44] = True
    assert I.body_parts(m)["mantle"] == (20, 18) and abs(I.body_parts(m)["head"][1] - 44) <= 1
    assert I.body_parts(np.zeros((5, 5), bool)) == {"mantle": None, "head": None}


def test_curves():
    assert I.length(np.array([[0.0, 0], [3, 4], [3, 10]])) == 11
    line = I.resampled_curve(np.array([[0, 0], [0, 4], [0, 10]]), 6)
    assert line == pytest.approx(np.stack([np.zeros(6), np.arange(0, 12, 2)], axis=1))


def test_flow_follows_a_move():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 255, (48, 48)).astype(np.uint8)
    b = I.shifted(a, -2, -1)  # everything moves by (2, 1)
    flow, ok = I.consistent_flow(a, b)
    assert (flow[1:-1, 1:-1] == [2, 1]).all() and ok[1:-1, 1:-1].all()
    moved = I.warped(a, flow)
    assert (moved[16:32, 16:32] == b[16:32, 16:32]).all()
    assert (I.warped_median([a, b], [a.astype(float), b.astype(float)], 1)[16:32, 16:32] == b[16:32, 16:32]).all()


def test_frames_and_masks():
    a, b = np.zeros((100, 100), np.uint8), np.zeros((100, 100), np.uint8)
    b[:10] = 200
    b[90:, 70:] = 200  # the clock
    assert I.changed_fraction(a, b) == pytest.approx(0.1)
    grey = np.repeat(np.arange(100, dtype=np.uint8).reshape(10, 10, 1), 3, axis=2)
    assert I.is_grey(grey) and not I.is_grey(grey + np.array([0, 30, 60], np.uint8))
    m = np.zeros((10, 10), bool)
    m[2:6, 2:6] = True
    assert I.solidity(m) == pytest.approx(1.0) and I.solidity(~m) == pytest.approx(0.84)
    assert I.mask_agreement(m, m) == (1.0, 0.0) and I.mask_agreement(~m & m, ~m & m) == (1.0, 0.0)
    assert I.mask_agreement(I.resized(m, 20, 20), m) == (1.0, 0.0)
    assert I.segmented(np.where(m, 0.9, 0.1), 0.5, 20, 20).sum() == 64


def test_frames_as_rows(spark):
    a, b = np.zeros((20, 20), np.uint8), np.full((20, 20), 255, np.uint8)
    rows = spark.createDataFrame([(1, 0, bytearray(a.tobytes())), (1, 1, bytearray(b.tobytes())), (2, 0, bytearray(b.tobytes()))], "clip int, t int, frame binary")
    got = {(r["clip"], r["t"]): r["changed"] for r in I.frame_changes(rows, "clip", "t", "frame", (20, 20)).collect()}
    assert got[1, 0] == got[2, 0] == 0 and got[1, 1] > 0.9
    m = cross().astype(np.uint8)
    masks = spark.createDataFrame([(1, t, bytearray(m.tobytes() if t != 2 else bytes(m.size))) for t in range(4)], "clip int, t int, mask binary")
    held = I.averaged_masks(masks, "clip", "t", "mask", m.shape).orderBy("t").collect()
    assert sum(held[2]["mask"]) == sum(held[1]["mask"]) > 0  # one lost frame is bridged
    nodes = I.graphs(masks.where("t <> 2"), ["clip", "t"], "mask", m.shape)
    assert nodes.where("is_tip").groupBy("t").count().where("count = 4").count() == 3


def test_identities_over_frames(spark):
    rows = [(1, t, (t + k) % 3, 10.0 * k + t, 0.0) for t in range(6) for k in range(3)]  # names turn round, places don't
    arms = spark.createDataFrame(rows, "clip int, t int, arm int, x double, y double")
    found = K.tracked(arms, "clip", "t", "arm", "x", "y", radius=4)
    places = found.join(arms, ["clip", "t", "arm"]).withColumn("k", F.floor(F.col("x") / 10))
    assert places.groupBy("track").agg(F.count_distinct("k").alias("n")).where("n <> 1").count() == 0 and found.select("track").distinct().count() == 3
    named = K.relabelled(arms, found, ["clip", "t"], "arm")
    assert named.where("t = 5").orderBy("x").select("arm").collect() == found.where("t = 5").join(arms, ["clip", "t", "arm"]).orderBy("x").select(F.col("track").alias("arm")).collect()
