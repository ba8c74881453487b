"""Heads on frozen features: soft targets, augmentation, seeds, grids, kept models. Training runs in Spark ML over all rows."""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.functions.scalars import md5_modulus


def soft_rows(rows: DataFrame, target: str, weight: str) -> DataFrame:
    """One row a class of each row's soft target, weighted by it: the cross-entropy of these rows is the divergence from the
    target up to a constant, so any weighted classifier learns it."""
    each = rows.select("*", F.posexplode(target).alias("__c", "__p")).where("__p > 0")
    return each.withColumns({"class": F.col("__c").cast("double"), weight: F.col(weight) * F.col("__p")}).drop("__c", "__p")


def mixed(rows: DataFrame, key: str, features: str, target: str, seed: str, alpha: float = 0.2) -> DataFrame:
    """Each row blended with the row before it in a hashed order of its bucket (a bucket has about 1,000 rows): features and
    targets by a share in [0, alpha]."""
    from pyspark.sql.window import Window

    h = F.md5(F.concat(F.lit(seed + ":"), F.col(key).cast("string")))
    n = F.lit(max(rows.count() // 1000, 1))
    placed = rows.withColumns({"__h": h, "__b": F.pmod(F.xxhash64(key, F.lit(seed)), n)})
    w = Window.partitionBy("__b").orderBy("__h", key)
    share = md5_modulus(F.concat(F.lit(seed + "m"), F.col(key).cast("string")), 1000) / 1000.0 * alpha
    other = lambda c: F.coalesce(F.lag(c).over(w), F.col(c))
    placed = placed.withColumns({"__f": other(features), "__t": other(target), "__s": share})
    blend = lambda a, b: F.zip_with(a, b, lambda x, y: x * (1 - F.col("__s")) + y * F.col("__s"))
    return placed.withColumns({features: blend(features, "__f"), target: blend(target, "__t")}).drop("__h", "__b", "__f", "__t", "__s")


def jittered(rows: DataFrame, key: str, features: str, seed: int, std: float, drop: float) -> DataFrame:
    """Features with normal noise, and each dropped (0) with probability ``drop``; the same for a key on every run: noise comes
    from hashes."""
    u = lambda i, salt: (F.pmod(F.xxhash64(F.col(key), i, F.lit(seed + salt)), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
    noise = lambda i: F.sqrt(-2 * F.log(u(i, 0))) * F.cos(2 * 3.141592653589793 * u(i, 1)) * std
    return rows.withColumn(features, F.transform(features, lambda x, i: F.when(u(i, 2) < drop, 0.0).otherwise(x + noise(i))))


def _vectors(rows: DataFrame, features: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return rows.withColumn("__v", array_to_vector(F.transform(features, lambda x: x.cast("double"))))


def linear(rows: DataFrame, features: str, label: str, weight: str, *, reg: float = 0.01, iterations: int = 30):
    from pyspark.ml.classification import LogisticRegression

    return LogisticRegression(featuresCol="__v", labelCol=label, weightCol=weight, maxIter=iterations, regParam=reg).fit(_vectors(rows, features))


def perceptron(rows: DataFrame, features: str, label: str, layers: list[int], *, seed: int = 0, iterations: int = 60):
    """A small network with hidden layers; it takes hard labels without weights."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    return MultilayerPerceptronClassifier(featuresCol="__v", labelCol=label, layers=layers, seed=seed, maxIter=iterations).fit(_vectors(rows, features))


def predicted(model, rows: DataFrame, features: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    out = model.transform(_vectors(rows, features))
    return out.withColumns({"prediction": F.col("prediction").cast("int"), "probability": vector_to_array("probability")}).drop("__v", "rawPrediction")


def swept(spark, grid: dict[str, list], seeds: list[int], run: Callable[..., dict[str, float]]) -> DataFrame:
    """A row for each combination of the grid and seed: its settings as JSON and the metrics of ``run(seed=..., **settings)``.
    The grid is the caller's; each run is a Spark job of its own."""
    names, out = list(grid), []
    for values in itertools.product(*grid.values()):
        settings = dict(zip(names, values, strict=True))
        for seed in seeds:
            metrics = run(seed=seed, **settings)
            out.append((json.dumps(settings, sort_keys=True), seed, *[float(metrics[m]) for m in ("val", "test")]))
    return spark.createDataFrame(out, "config string, seed int, val double, test double")


def keep_model(model, path: str, metrics: dict[str, float]) -> None:
    """The model and its metrics below a path, metrics last: a path with metrics holds a whole model."""
    model.write().overwrite().save(f"{path}/model")
    spark = model._java_obj and __import__("pyspark").sql.SparkSession.getActiveSession()
    spark.createDataFrame([(k, float(v)) for k, v in sorted(metrics.items())], "name string, value double").coalesce(1).write.mode("overwrite").parquet(f"{path}/metrics")
