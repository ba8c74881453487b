"""The soft-target network against a dense version, and over two layouts."""

import numpy as np
import pytest

from kelpline.operators import network


def data(rng, n=240):
    y = rng.integers(0, 3, n)
    x = np.eye(3)[y] @ rng.normal(size=(3, 5)) * 2 + rng.normal(size=(n, 5))
    soft = 0.8 * np.eye(3)[y] + 0.2 * rng.dirichlet(np.ones(3), n)
    return x, soft, rng.uniform(0.2, 2, n), y


def dense(x, y, w, sizes, epochs, rate=2e-3, decay=1e-2, seed=0):
    layers = network.initial(sizes, seed)
    m = [np.zeros_like(a) for a in layers]
    v = [np.zeros_like(a) for a in layers]
    losses = []
    for t in range(1, epochs + 1):
        loss, g = network.gradients(layers, x, y, w)
        losses.append(loss / len(x))
        for k in range(len(layers)):
            d = g[k] / len(x)
            m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d * d
            layers[k] = layers[k] * (1 - rate * decay) - rate * m[k] / (1 - 0.9**t) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return layers, losses


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    x, y, w, _ = data(rng, 20)
    layers = network.initial([5, 4, 3], 2)
    _, g = network.gradients(layers, x, y, w)
    for k, a in enumerate(layers):
        for at in [(0,) * a.ndim, tuple(n - 1 for n in a.shape)]:
            up, down = ([b.copy() for b in layers] for _ in range(2))
            up[k][at] += 1e-6
            down[k][at] -= 1e-6
            slope = (network.gradients(up, x, y, w)[0] - network.gradients(down, x, y, w)[0]) / 2e-6
            assert g[k][at] == pytest.approx(slope, rel=1e-4, abs=1e-6)


def test_training_equals_a_dense_version_in_any_layout(spark):
    rng = np.random.default_rng(3)
    x, y, w, label = data(rng)
    rows = [(i, a.tolist(), b.tolist(), float(c)) for i, (a, b, c) in enumerate(zip(x, y, w, strict=True))] + [(900, None, [1.0, 0.0, 0.0], 1.0)]
    df = spark.createDataFrame(rows, "k long, x array<double>, y array<double>, w double")
    layers, losses = dense(x, y, w, [5, 8, 3], 8, rate=0.05)
    for parts in (1, 7):
        model = network.fit(df.repartition(parts), "k", "x", "y", "w", hidden=[8], epochs=8, rate=0.05)
        assert model.losses == pytest.approx(losses) and losses[-1] < 0.7 * losses[0]
        for a, b in zip(model.layers, layers, strict=True):
            np.testing.assert_allclose(a, b, atol=1e-8)
    scored = model.scored(df.where("x IS NOT NULL"), "k", "x").collect()
    assert np.mean([r["predicted"] == label[r["k"]] for r in scored]) > 0.8 and all(sum(r["shares"]) == pytest.approx(1) for r in scored)


def test_batches_and_noise_do_not_depend_on_the_layout(spark):
    x, y, w, _ = data(np.random.default_rng(4), 60)
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y, strict=True))], "k long, x array<double>, y array<double>")
    one, other = (network.fit(df.repartition(p), "k", "x", "y", hidden=[4], epochs=2, batches=2, noise=0.1, rate=0.05) for p in (1, 3))
    for a, b in zip(one.layers, other.layers, strict=True):
        np.testing.assert_allclose(a, b, atol=1e-8)
    with pytest.raises(ValueError, match="no rows"):
        network.fit(df.limit(0), "k", "x", "y")
