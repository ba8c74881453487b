"""A small network on soft targets, trained by sums of gradients.

The loss is the weighted Kullback-Leibler divergence from a row's target
distribution to the network's.  A step ships the weights to the tasks; each adds
up the gradients of its rows, groups of tasks are added up again, and the
driver steps (Adam with decoupled decay) on one vector of the model's size.  So
rows stay where they are, and a step's result does not depend on how they are
dealt, but for the order of additions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def initial(sizes: list[int], seed: int) -> list[np.ndarray]:
    """Weights and biases of each layer, He's scale."""
    rng, out = np.random.default_rng(seed), []
    for a, b in zip(sizes, sizes[1:], strict=False):
        out += [rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b)]
    return out


def log_probabilities(layers: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Log of the class shares, and every layer's input."""
    inputs = []
    for k in range(0, len(layers), 2):
        inputs.append(x)
        x = x @ layers[k] + layers[k + 1]
        if k + 2 < len(layers):
            x = np.maximum(x, 0)
    top = x.max(axis=1, keepdims=True)
    return x - top - np.log(np.exp(x - top).sum(axis=1, keepdims=True)), inputs


def gradients(layers: list[np.ndarray], x: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Sum of the rows' losses and its gradient by layer."""
    logp, inputs = log_probabilities(layers, x)
    loss = float(((target * (np.log(np.maximum(target, 1e-8)) - logp)).sum(axis=1) * weight).sum())
    delta = (np.exp(logp) * target.sum(axis=1, keepdims=True) - target) * weight[:, None]
    out: list[np.ndarray] = []
    for k in range(len(layers) - 2, -1, -2):
        out = [inputs[k // 2].T @ delta, delta.sum(axis=0), *out]
        if k:
            delta = (delta @ layers[k].T) * (inputs[k // 2] > 0)
    return loss, out


@dataclass
class Network:
    layers: list[np.ndarray]
    losses: list[float] = field(default_factory=list)

    def scored(self, rows: DataFrame, key: str, features: str) -> DataFrame:
        """key, the class shares, and the class of the greatest (of equals the first)."""
        shipped = rows.sparkSession.sparkContext.broadcast(self.layers)

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    p = np.exp(log_probabilities(shipped.value, np.stack([np.asarray(v, float) for v in pdf[features]]))[0])
                    yield pdf[[key]].assign(shares=list(p), predicted=p.argmax(axis=1).astype(np.int32))

        return rows.select(key, features).mapInPandas(score, f"{key} {rows.schema[key].dataType.simpleString()}, shares array<double>, predicted int")


def fit(rows: DataFrame, key: str, features: str, target: str, weight: str | None = None, *, hidden: list[int] | None = None, epochs: int = 60, batches: int = 1, rate: float = 2e-3, decay: float = 1e-2, noise: float = 0.0, seed: int = 0) -> Network:
    """Trains on vectors of features and target shares; rows with a null in either count nowhere, without a weight every row counts 1.

    An epoch deals the rows to ``batches`` by a hash of key and epoch and steps once a batch; ``noise`` is the deviation of what
    is added to the features, drawn by key and epoch.
    """
    spark = rows.sparkSession
    own = rows.where(F.col(features).isNotNull() & F.col(target).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(features).alias("x"), F.col(target).alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")).persist()
    try:
        first = own.select(F.size("x"), F.size("y")).first()
        if first is None:
            raise ValueError("no rows to train on")
        layers = initial([first[0], *(hidden or [32]), first[1]], seed)
        shapes = [a.shape for a in layers]
        size = sum(a.size for a in layers)
        mean, square, model = np.zeros(size), np.zeros(size), Network(layers)
        for epoch in range(epochs):
            total = rows_seen = 0.0
            for batch in range(batches):
                shipped = spark.sparkContext.broadcast(model.layers)

                def add(frames: Iterator[pd.DataFrame], shipped=shipped, epoch=epoch) -> Iterator[pd.DataFrame]:
                    loss, n, sums = 0.0, 0, np.zeros(size)
                    for pdf in frames:
                        if not len(pdf):
                            continue
                        x = np.stack([np.asarray(v, float) for v in pdf["x"]])
                        if noise:
                            x = x + np.stack([np.random.default_rng(int(h) & 0xFFFFFFFF).normal(0, noise, x.shape[1]) for h in pdf["h"]])
                        one, parts = gradients(shipped.value, x, np.stack([np.asarray(v, float) for v in pdf["y"]]), pdf["w"].to_numpy())
                        loss, n, sums = loss + one, n + len(pdf), sums + np.concatenate([p.ravel() for p in parts])
                    if n:
                        yield pd.DataFrame({"g": [0], "loss": [loss], "n": [n], "sums": pd.Series([sums], dtype=object)})

                def merge(pdf: pd.DataFrame) -> pd.DataFrame:
                    return pd.DataFrame({"g": [0], "loss": [pdf["loss"].sum()], "n": [pdf["n"].sum()], "sums": pd.Series([np.sum(np.stack(list(pdf["sums"])), axis=0)], dtype=object)})

                kind = "g int, loss double, n long, sums array<double>"
                part = own.withColumn("h", F.xxhash64("k", F.lit(epoch), F.lit(seed))).where(F.pmod("h", F.lit(batches)) == batch)
                tasks = part.select("x", "y", "w", "h").mapInPandas(add, kind).withColumn("g", F.spark_partition_id() % 32)
                found = tasks.groupBy("g").applyInPandas(merge, kind).collect()  # at most 32 vectors of the model's size
                if not found:
                    continue
                n = sum(r["n"] for r in found)
                gradient = np.sum([r["sums"] for r in found], axis=0) / n
                step = epoch * batches + batch + 1
                mean, square = 0.9 * mean + 0.1 * gradient, 0.999 * square + 0.001 * gradient**2
                flat = np.concatenate([a.ravel() for a in model.layers])
                flat = flat * (1 - rate * decay) - rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
                at = np.cumsum([0, *[int(np.prod(s)) for s in shapes]])
                model.layers = [flat[a:b].reshape(s) for a, b, s in zip(at, at[1:], shapes, strict=False)]
                total, rows_seen = total + sum(r["loss"] for r in found), rows_seen + n
            model.losses.append(total / max(rows_seen, 1))
        return model
    finally:
        own.unpersist()
