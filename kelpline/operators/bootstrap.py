"""Bootstraps of the rank AUC by clusters, with whole resamples.

The AUC of a resample is a bilinear form: with m(i) the times cluster i was
drawn and W(i, j) how often a positive of i outranks a negative of j (ties count
half), it is the sum of m(i) W(i, j) m(j) over the positives and negatives
drawn.  So the rows are read once, for W, whatever the number of resamples.

W comes from ranges of scores: a task has a range's positives, a block of the
negatives' clusters, and how many of their negatives lie in lower ranges.  The
form is added up over blocks of clusters and chunks of resamples; a task has
one block of W and the chunk's draws of its clusters.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.operators.sampling import before_in_order
from kelpline.sources import stage

BLOCK = 1024
CHUNK = 500


def numbered(clusters: DataFrame, cluster: str, seed: str) -> DataFrame:
    """cluster and its number ``i``, from 0 in hashed order."""
    return before_in_order(clusters.select(cluster).distinct(), cluster, F.lit(1), seed).select(cluster, F.col("__before").cast("long").alias("i"))


def resamples(spark, n: int, iterations: int, seed: str) -> DataFrame:
    """iteration (from 1), number ``i`` and times ``m``: n draws with replacement from n, each by a hash of its place."""
    k = F.col("id")
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.floor(k / n) + 1, k % n + 1)), 1, 12), 16, 10).cast("double") / 2.0**48
    return spark.range(iterations * n).select((F.floor(k / n) + 1).alias("iteration"), F.floor(u * n).cast("long").alias("i")).groupBy("iteration", "i").agg(F.count("*").alias("m"))


def wins(counts: DataFrame, n: int, parts: int = 64) -> DataFrame:
    """i, block and w: for each positives' cluster i its wins over the negatives' clusters of a block, in their order.

    ``counts``: i (number among the positives' clusters), j (among the negatives'), score, p and n, rows of each kind."""
    bounds = counts.agg(F.percentile_approx("score", [k / parts for k in range(1, parts)], 10_000).alias("bounds"))  # one row
    placed = counts.crossJoin(F.broadcast(bounds)).withColumn("range", F.size(F.filter("bounds", lambda b: b < F.col("score")))).drop("bounds")
    blocks = -(-n // BLOCK)
    positive = placed.where("p > 0").select("range", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit("p").alias("kind"), F.col("i").alias("c"), "score", F.col("p").cast("double").alias("w"))
    block = F.floor(F.col("j") / BLOCK).cast("int").alias("block")
    negative = placed.where("n > 0").select("range", block, F.lit("n").alias("kind"), F.col("j").alias("c"), "score", F.col("n").cast("double").alias("w"))
    sums = placed.where("n > 0").groupBy("j", "range").agg(F.sum("n").cast("double").alias("w")).groupBy("j").agg(F.collect_list(F.struct("range", "w")).alias("all"))  # at most ``parts``
    upto = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda r: F.aggregate(F.filter("all", lambda x: x["range"] < r), F.lit(0.0), lambda s, x: s + x["w"]))
    lower = sums.select(block, F.col("j").alias("c"), F.posexplode(upto).alias("range", "w")).where("w > 0").select("range", "block", F.lit("b").alias("kind"), "c", F.lit(None).cast(counts.schema["score"].dataType).alias("score"), "w")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        b = int(pdf["block"].iloc[0])
        width = min(BLOCK, n - b * BLOCK)
        pos, neg, low = (pdf[pdf["kind"] == k] for k in "pnb")
        own, row = np.unique(pos["c"].to_numpy(), return_inverse=True)
        weight, score = pos["w"].to_numpy(), pos["score"].to_numpy(float)
        out = np.zeros((len(own), width))
        if len(own):
            out[:, low["c"].to_numpy() - b * BLOCK] += np.outer(np.bincount(row, weight), low["w"].to_numpy())
            for j, group in neg.groupby("c"):
                group = group.sort_values("score")
                s, total = group["score"].to_numpy(float), np.append(0.0, np.cumsum(group["w"].to_numpy()))
                below = (total[np.searchsorted(s, score, "left")] + total[np.searchsorted(s, score, "right")]) / 2
                out[:, int(j) - b * BLOCK] += np.bincount(row, weight * below)
        return pd.DataFrame({"i": own, "block": b, "w": pd.Series(list(out), dtype=object)})

    parts_of = positive.unionByName(negative).unionByName(lower).groupBy("range", "block").applyInPandas(compare, "i long, block int, w array<double>")
    return _added(parts_of)


def _added(rows: DataFrame) -> DataFrame:
    """Sums of the vectors of each (i, block), of which there is one a range and score."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": pdf["i"].iloc[:1], "block": pdf["block"].iloc[:1], "w": [np.sum(np.stack(list(pdf["w"])), axis=0)]})

    return rows.groupBy("i", "block").applyInPandas(add, "i long, block int, w array<double>")


def _formed(w: DataFrame, drawn: tuple[DataFrame, DataFrame], totals: tuple[DataFrame, DataFrame], sizes: tuple[int, int], iterations: int) -> DataFrame:
    """iteration, won, p and n: the form and the rows drawn, added up over blocks."""
    blocks = [range(-(-s // BLOCK)) for s in sizes]
    every = lambda xs: F.explode(F.array(*[F.lit(x) for x in xs]))
    chunks = range(-(-iterations // CHUNK))
    own = lambda c: F.floor(F.col(c) / BLOCK).cast("int")
    chunk = F.floor((F.col("iteration") - 1) / CHUNK).cast("int").alias("chunk")
    none, zero = F.lit(None).cast("array<double>").alias("w"), F.lit(0).cast("long").alias("iteration")
    cells = [
        w.select(own("i").alias("row"), F.col("block").alias("col"), every(chunks).alias("chunk"), F.lit("w").alias("kind"), zero, "i", F.lit(0.0).alias("m"), "w"),
        drawn[0].select(own("i").alias("row"), every(blocks[1]).alias("col"), chunk, F.lit("i").alias("kind"), "iteration", "i", F.col("m").cast("double").alias("m"), none),
        drawn[1].select(every(blocks[0]).alias("row"), own("i").alias("col"), chunk, F.lit("j").alias("kind"), "iteration", "i", F.col("m").cast("double").alias("m"), none),
        totals[0].select(own("i").alias("row"), F.lit(0).alias("col"), every(chunks).alias("chunk"), F.lit("p").alias("kind"), zero, "i", F.col("p").cast("double").alias("m"), none),
        totals[1].select(F.lit(0).alias("row"), own("j").alias("col"), every(chunks).alias("chunk"), F.lit("n").alias("kind"), zero, F.col("j").alias("i"), F.col("n").cast("double").alias("m"), none),
    ]
    union = cells[0]
    for c in cells[1:]:
        union = union.unionByName(c)

    def form(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, cols, at = int(pdf["row"].iloc[0]), int(pdf["col"].iloc[0]), int(pdf["chunk"].iloc[0])
        height, width = min(BLOCK, sizes[0] - rows * BLOCK), min(BLOCK, sizes[1] - cols * BLOCK)
        part = {k: pdf[pdf["kind"] == k] for k in "wijpn"}
        matrix = np.zeros((height, width))
        if len(part["w"]):
            matrix[part["w"]["i"].to_numpy() - rows * BLOCK] = np.stack(list(part["w"]["w"]))
        m = []
        for k, size, first in (("i", height, rows), ("j", width, cols)):
            counts = np.zeros((CHUNK, size))
            counts[part[k]["iteration"].to_numpy() - 1 - at * CHUNK, part[k]["i"].to_numpy() - first * BLOCK] = part[k]["m"].to_numpy()
            m.append(counts)
        p, n = np.zeros(height), np.zeros(width)
        p[part["p"]["i"].to_numpy() - rows * BLOCK] = part["p"]["m"].to_numpy()
        n[part["n"]["i"].to_numpy() - cols * BLOCK] = part["n"]["m"].to_numpy()
        last = min(CHUNK, iterations - at * CHUNK)
        out = pd.DataFrame({"iteration": np.arange(CHUNK) + 1 + at * CHUNK, "won": ((m[0] @ matrix) * m[1]).sum(axis=1), "p": m[0] @ p, "n": m[1] @ n})
        return out.iloc[:last]

    parts = union.groupBy("row", "col", "chunk").applyInPandas(form, "iteration long, won double, p double, n double")
    return parts.groupBy("iteration").agg(F.sum("won").alias("won"), F.sum("p").alias("p"), F.sum("n").alias("n"))


def auc_draws(rows: DataFrame, cluster: str, scores: list[str], positive: Column, iterations: int, seed: str, *, joint: bool = True) -> DataFrame:
    """iteration and ``x``: the AUC of the first score, less that of the second if there is one, in each resample; resamples without
    both kinds are left out.

    ``joint`` draws from all clusters at once; otherwise the clusters with positives and those with negatives are drawn by
    themselves. Rows without a kind or a score count nowhere.
    """
    spark = rows.sparkSession
    with stage.stages(spark, "bootstrap") as keep:
        kinds = rows.where(positive.isNotNull()).select(F.col(cluster).alias("cluster"), positive.alias("pos"), *[F.col(s).cast("double").alias(f"s{k}") for k, s in enumerate(scores)]).dropna(subset=[f"s{k}" for k in range(len(scores))])
        kinds = keep(kinds)
        if joint:
            one = keep(numbered(kinds, "cluster", seed))
            index, names = (one, one), (seed, seed)
        else:
            names = (f"{seed}+", f"{seed}-")
            index = tuple(keep(numbered(kinds.where(on), "cluster", name)) for on, name in zip(("pos", "NOT pos"), names, strict=True))
        sizes = tuple(x.count() for x in index)
        if not all(sizes):
            return spark.createDataFrame([], "iteration long, x double")
        drawn = [keep(resamples(spark, n, iterations, name)) for n, name in zip(sizes, names, strict=True)] if not joint else [keep(resamples(spark, sizes[0], iterations, seed))] * 2
        number = index[0].join(index[1].withColumnRenamed("i", "j"), "cluster", "full")
        parts, totals = [], None
        for k in range(len(scores)):
            counts = kinds.groupBy("cluster", F.col(f"s{k}").alias("score")).agg(F.count_if("pos").alias("p"), F.count_if(~F.col("pos")).alias("n"))
            counts = keep(counts.join(number, "cluster").drop("cluster"))
            w = wins(counts, sizes[1])
            parts.append(w if k == 0 else w.withColumn("w", F.transform("w", lambda x: -x)))
            totals = totals or (counts.where("p > 0").groupBy("i").agg(F.sum("p").alias("p")), counts.where("n > 0").groupBy("j").agg(F.sum("n").alias("n")))
        w = keep(parts[0] if len(parts) == 1 else _added(parts[0].unionByName(parts[1])))
        each = _formed(w, tuple(drawn), totals, sizes, iterations).where("p * n > 0")
        return stage.written(each.select("iteration", (F.col("won") / (F.col("p") * F.col("n"))).alias("x")), stage.folder(spark, "draws"))


def interval(draws: DataFrame, name: str) -> DataFrame:
    return draws.agg(F.count("*").alias("iterations"), F.avg("x").alias(name), F.percentile("x", 0.025).alias("low"), F.percentile("x", 0.975).alias("high"))


def bootstrap_auc(rows: DataFrame, cluster: str, score: str, positive: Column, iterations: int = 5000, seed: str = "a", *, joint: bool = True) -> DataFrame:
    """iterations, estimate (mean of the draws), low and high (95 %) of the rank AUC."""
    return interval(auc_draws(rows, cluster, [score], positive, iterations, seed, joint=joint), "estimate")


def bootstrap_auc_delta(rows: DataFrame, cluster: str, a: str, b: str, positive: Column, iterations: int = 5000, seed: str = "d") -> DataFrame:
    """The same of the difference of two scores' AUC over the same resamples, and whether its interval includes zero."""
    out = interval(auc_draws(rows, cluster, [a, b], positive, iterations, seed), "delta")
    return out.withColumn("includes_zero", (F.col("low") <= 0) & (F.col("high") >= 0))
