"""Evaluation statistics: ranks, agreement, intervals, bootstraps, sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def auc(rows: DataFrame, score: str, positive: Column, groups: list[str] | None = None) -> DataFrame:
    """Rank AUC with mid-ranks, null without both kinds.

    Scores are counted first, so ties cost nothing and what is ranked is one
    row a distinct score. With ``groups`` running sums go over a group's
    scores; without, over ranges of scores (:func:`ranked_by_range`), so no
    task orders them all.
    """
    counts = rows.groupBy(*(groups or []), score).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n"))
    if groups:
        before = Window.partitionBy(*groups).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
        below = counts.withColumn("below", F.coalesce(F.sum("n").over(before), F.lit(0)))
        won = F.sum(F.col("p") * (F.col("below") + F.col("n") / 2))
        sums = below.groupBy(*groups).agg(won.alias("won"), F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"))
    else:
        ranked = ranked_counts(counts.withColumn("c", F.col("p") + F.col("n")).where("c > 0"), score)
        n1 = F.sum("p").cast("double")
        sums = ranked.agg((F.sum(F.col("p") * F.col("rank")) - n1 * (n1 + 1) / 2).alias("won"), F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"))
    return sums.select(*(groups or []), "n_pos", "n_neg", (F.col("won") / F.nullif(F.col("n_pos") * F.col("n_neg"), F.lit(0))).alias("auc"))


def fp_at_recall(rows: DataFrame, score: str, positive: Column, recall: float) -> DataFrame:
    """The cut that reaches the recall (linear quantile of positives, exact) and the share of negatives at or above it."""
    from kelpline.operators.quantiles import exact_quantiles

    cut = F.lit(exact_quantiles(rows.where(positive), F.col(score), [1 - recall])[0]).cast("double")
    return rows.agg(F.avg(F.when(~positive, (F.col(score) >= cut).cast("double"))).alias("fp_rate")).select(cut.alias("cut"), "fp_rate")


def gate_rates(rows: DataFrame, gate: Column, positive: Column) -> DataFrame:
    """Recall, false-positive rate and precision of a gate; empty denominators count as one."""
    tp, fp = F.count_if(gate & positive), F.count_if(gate & ~positive)
    one = lambda x: F.greatest(x, F.lit(1))
    return rows.agg((tp / one(F.count_if(positive))).alias("recall"), (fp / one(F.count_if(~positive))).alias("fpr"), (tp / one(tp + fp)).alias("precision"))


def contingency(rows: DataFrame, a: Column, b: Column, groups: list[str] | None = None) -> DataFrame:
    """Counts of both true, only a, only b, neither."""
    return rows.groupBy(*(groups or [])).agg(F.count_if(a & b).alias("tt"), F.count_if(a & ~b).alias("tf"), F.count_if(~a & b).alias("ft"), F.count_if(~a & ~b).alias("ff"))


def kappa(table: DataFrame) -> DataFrame:
    """Cohen's kappa of contingency counts; null where chance agreement is 1 or there are no rows."""
    tt, tf, ft, ff = (F.col(c).cast("double") for c in ("tt", "tf", "ft", "ff"))
    n = F.nullif(tt + tf + ft + ff, F.lit(0.0))
    po, pe = (tt + ff) / n, ((tt + tf) * (tt + ft) + (ft + ff) * (tf + ff)) / (n * n)
    return table.withColumns({"po": po, "kappa": F.when(pe < 1, (po - pe) / (1 - pe))})


def multi_kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa over any number of classes."""
    pairs = rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    left, right = pairs.groupBy("a").agg(F.sum("n").alias("na")), pairs.groupBy("b").agg(F.sum("n").alias("nb"))
    chance = left.join(right, left["a"] == right["b"]).agg(F.coalesce(F.sum(F.col("na").cast("double") * F.col("nb")), F.lit(0.0)).alias("c"))
    same = pairs.agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))), F.lit(0)).alias("s"))
    n = F.col("n").cast("double")
    pe = F.col("c") / (n * n)
    return same.crossJoin(F.broadcast(chance)).select("n", (F.col("s") / n).alias("po"), F.when(pe < 1, (F.col("s") / n - pe) / (1 - pe)).alias("kappa"))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval; (0, 0) for n = 0."""
    m = F.nullif(n, F.lit(0)).cast("double")
    p = k / m
    d = F.lit(1.0) + z * z / m
    c, h = (p + z * z / (2 * m)) / d, z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / d
    return F.coalesce(c - h, F.lit(0.0)), F.coalesce(c + h, F.lit(0.0))


def f1_by_class(rows: DataFrame, truth: str, predicted: str, classes: DataFrame, cls: str) -> DataFrame:
    """Precision, recall and F1 of every class, with rows or without."""
    t = rows.groupBy(F.col(truth).alias(cls)).agg(F.count("*").alias("support"), F.count_if(F.col(truth) == F.col(predicted)).alias("hit"))
    p = rows.groupBy(F.col(predicted).alias(cls)).agg(F.count("*").alias("told"))
    j = classes.join(t, cls, "left").join(p, cls, "left").na.fill(0, ["support", "hit", "told"])
    safe = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    j = j.withColumns({"precision": safe(F.col("hit"), F.col("told")), "recall": safe(F.col("hit"), F.col("support"))})
    return j.withColumn("f1", safe(2 * F.col("precision") * F.col("recall"), F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)))).select(cls, "support", "precision", "recall", "f1")


def threshold_sweep(rows: DataFrame, score: str, positive: Column, thresholds: list[float]) -> DataFrame:
    """tp, fp, fn and F1 at each threshold: a row meets each of the few thresholds once, map-side."""
    each = rows.select(F.col(score).alias("s"), positive.alias("p"), F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    on = F.col("s") >= F.col("threshold")
    out = each.groupBy("threshold").agg(F.count_if(on & F.col("p")).alias("tp"), F.count_if(on & ~F.col("p")).alias("fp"), F.count_if(~on & F.col("p")).alias("fn"))
    return out.withColumn("f1", 2.0 * F.col("tp") / F.greatest(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(1)))


def best_row(rows: DataFrame, metric: str, order: str) -> DataFrame:
    """The row of the greatest metric; the first in order among equals."""
    return rows.orderBy(F.desc(metric), order).limit(1)


def upper_median(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Element n div 2 (from 0) of the sorted positive values: by counted values, not by collecting rows."""
    counts = rows.where(F.col(value) > 0).groupBy(group, value).agg(F.count("*").alias("c"))
    upto = Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    runs = counts.withColumns({"upto": F.sum("c").over(upto), "n": F.sum("c").over(Window.partitionBy(group))})
    return runs.where(F.col("upto") > F.floor(F.col("n") / 2)).groupBy(group).agg(F.min(value).alias("upper_median"))


def multiplicities(clusters: DataFrame, cluster: str, iterations: int, seed: str) -> DataFrame:
    """How often each cluster is drawn in each resample: Poisson(1) by a hash, so clusters need not meet."""
    import math

    cdf, p = [], math.exp(-1)
    for k in range(8):
        cdf.append(p / math.factorial(k) + (cdf[-1] if cdf else 0))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("iteration"), F.col(cluster))), 1, 8), 16, 10).cast("double") / 2.0**32
    drawn = clusters.select(cluster, F.explode(F.sequence(F.lit(1), F.lit(iterations))).alias("iteration"))
    return drawn.withColumn("m", sum((u >= c).cast("int") for c in cdf)).where("m > 0")


def bootstrap_mean(rows: DataFrame, cluster: str, value: str, iterations: int, seed: str) -> DataFrame:
    """Cluster bootstrap of a mean: estimate and 95 % interval. Rows are reduced to sums by cluster first."""
    sums = rows.groupBy(cluster).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    drawn = sums.join(multiplicities(sums.select(cluster), cluster, iterations, seed), cluster)
    each = drawn.groupBy("iteration").agg((F.sum(F.col("m") * F.col("s")) / F.sum(F.col("m") * F.col("n"))).alias("x"))
    return each.agg(F.count("*").alias("iterations"), F.avg("x").alias("estimate"), F.percentile("x", 0.025).alias("low"), F.percentile("x", 0.975).alias("high"))


def kruskal_h(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Kruskal-Wallis H (without tie correction) and its epsilon squared."""
    ranks = ranked_by_range(rows, value)
    sums = rows.groupBy(group, value).agg(F.count("*").alias("__g")).join(ranks.select(value, "rank"), value).groupBy(group).agg(F.sum(F.col("__g") * F.col("rank")).alias("r"), F.sum("__g").alias("n"))
    total = sums.agg(F.sum("n").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"), F.count("*").alias("k"))
    n = F.col("n").cast("double")
    h = 12.0 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)
    return total.select(F.col("n"), F.col("k"), h.alias("h"), (h / (n - 1)).alias("epsilon_squared"))


def box(rows: DataFrame, group: str, x: str, y: str, pad: float) -> DataFrame:
    """Union bounding box with padding, by group."""
    return rows.groupBy(group).agg((F.min(x) - pad).alias("x0"), (F.min(y) - pad).alias("y0"), (F.max(x) + pad).alias("x1"), (F.max(y) + pad).alias("y1"))


def pooled(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """Mean, population deviation and greatest of each dimension over a group's vectors."""
    long = vectors.select(group, F.posexplode(vector).alias("d", "x"))
    return long.groupBy(group, "d").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.max("x").alias("max"))


def standardised(rows: DataFrame, fit: Column, columns: list[str], least: float = 1e-6) -> DataFrame:
    """z-scores by mean and population deviation of the rows to fit on."""
    stats = rows.where(fit).agg(*[F.avg(c).alias(f"__m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"__s_{c}") for c in columns])
    out = rows.crossJoin(F.broadcast(stats))  # one row
    return out.withColumns({f"z_{c}": (F.col(c) - F.col(f"__m_{c}")) / (F.col(f"__s_{c}") + least) for c in columns}).drop(*[f"__{k}_{c}" for c in columns for k in "ms"])


def by_subset(rows: DataFrame, subsets: dict[str, Column], value: str) -> DataFrame:
    """n and mean of a value by subset; a row counts in every subset it belongs to."""
    member = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in subsets.items()]))
    return rows.select(F.col(value), F.explode(member).alias("subset")).groupBy("subset").agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


# --- agreement of many raters, tests, verdicts ---------------------------------------


def fleiss_kappa(ratings: DataFrame, item: str, label: str) -> DataFrame:
    """Fleiss' kappa over items with the same number of raters (two or more): the commonest number counts, ``left_out`` says how
    many items have another one. Null where chance agreement is 1."""
    counts = ratings.groupBy(item, label).agg(F.count("*").alias("c"))
    items = counts.groupBy(item).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("squares"))
    sizes = items.where("n > 1").groupBy("n").agg(F.count("*").alias("items"), F.sum((F.col("squares") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("agreed"))
    chosen = sizes.agg(F.max_by(F.struct("n", "items", "agreed"), F.struct("items", "n")).alias("x"), F.sum("items").alias("every")).select("x.*", "every")
    kept = counts.join(items.select(item, "n"), item).join(chosen.select("n"), "n")  # one row: the number of raters
    shares = kept.groupBy(label).agg(F.sum("c").alias("c")).agg(F.sum(F.col("c") * F.col("c").cast("double")).alias("s"), F.sum("c").alias("t"))
    both = chosen.crossJoin(shares)  # one row each
    pe, po = F.col("s") / (F.col("t") * F.col("t").cast("double")), F.col("agreed") / F.col("items")
    return both.select(F.col("n").alias("raters"), "items", (F.col("every") - F.col("items")).alias("left_out"), po.alias("po"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))


def bootstrap_difference(rows: DataFrame, arm: Column, cluster: str, value: str, iterations: int, seed: str) -> DataFrame:
    """Difference of two arms' means (arm true less arm false), each arm's clusters drawn by themselves; draws without an arm are skipped."""
    sums = rows.groupBy(arm.alias("arm"), cluster).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    named = sums.withColumn("__c", F.concat_ws("/", F.col("arm").cast("string"), F.col(cluster).cast("string")))
    drawn = named.join(multiplicities(named.select("__c"), "__c", iterations, seed), "__c")
    mean = lambda on: F.sum(F.when(on, F.col("m") * F.col("s"))) / F.nullif(F.sum(F.when(on, F.col("m") * F.col("n"))), F.lit(0))
    each = drawn.groupBy("iteration").agg((mean(F.col("arm")) - mean(~F.col("arm"))).alias("d")).where("d IS NOT NULL")
    out = each.agg(F.count("*").alias("iterations"), F.avg("d").alias("delta"), F.percentile("d", 0.025).alias("low"), F.percentile("d", 0.975).alias("high"))
    return out.withColumn("includes_zero", (F.col("low") <= 0) & (F.col("high") >= 0))


def drawn_clusters(clusters: DataFrame, cluster: str, iterations: int, seed: str) -> DataFrame:
    """(iteration, cluster, m): as many draws with replacement as there are clusters, each draw by a hash of its number.

    Clusters are numbered once (one row each); a draw picks a number, so the n draws of an iteration are spread like any rows.
    """
    from kelpline.operators.sampling import before_in_order

    numbered = before_in_order(clusters.select(cluster).distinct(), cluster, F.lit(1), seed).select(cluster, F.col("__before").cast("int").alias("__i"))
    n = numbered.agg(F.count("*").alias("__n"))  # one row
    draws = n.select("__n", F.explode(F.sequence(F.lit(1), F.lit(iterations))).alias("iteration")).where("__n > 0")
    draws = draws.select("iteration", "__n", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int"))).alias("__k"))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "iteration", "__k")), 1, 12), 16, 10).cast("double") / 2.0**48
    picked = draws.select("iteration", F.floor(u * F.col("__n")).cast("int").alias("__i")).groupBy("iteration", "__i").agg(F.count("*").alias("m"))
    return picked.join(numbered, "__i").select("iteration", cluster, "m")


def resampled_mean(rows: DataFrame, cluster: str, value: str, iterations: int = 5000, seed: str = "r") -> DataFrame:
    """Cluster bootstrap of a mean with whole resamples of the clusters."""
    sums = rows.groupBy(cluster).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    drawn = drawn_clusters(sums, cluster, iterations, seed).join(sums, cluster)
    each = drawn.groupBy("iteration").agg((F.sum(F.col("m") * F.col("s")) / F.nullif(F.sum(F.col("m") * F.col("n")), F.lit(0))).alias("x")).where("x IS NOT NULL")
    return each.agg(F.count("*").alias("iterations"), F.avg("x").alias("estimate"), F.percentile("x", 0.025).alias("low"), F.percentile("x", 0.975).alias("high"))


def tip_scores(frames: DataFrame, hits: str, predicted: str, truth: str) -> DataFrame:
    """Mean precision, recall and F1 over frames. Nothing predicted: precision 1 where there is nothing to find, else 0;
    nothing to find: recall 1."""
    share = lambda of, none: F.when(F.col(of) > 0, F.col(hits) / F.col(of)).otherwise(none)
    p = share(predicted, F.when(F.col(truth) == 0, 1.0).otherwise(0.0))
    r = share(truth, F.lit(1.0))
    f1 = F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0))
    return frames.agg(F.count("*").alias("frames"), F.avg(p).alias("precision"), F.avg(r).alias("recall"), F.avg(f1).alias("f1"))


def seed_report(runs: DataFrame, config: str, metric: str) -> DataFrame:
    """By configuration: seeds, mean and population deviation over them."""
    return runs.groupBy(config).agg(F.count("*").alias("seeds"), F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"))


def seed_verdict(runs: DataFrame, config: str, baseline: str, val: str, test: str) -> DataFrame:
    """The configuration of the best mean on validation, its gain over the baseline on test, and whether that exceeds the
    baseline's deviation over seeds."""
    by = runs.groupBy(config).agg(F.avg(val).alias("val"), F.avg(test).alias("test"), F.stddev_pop(test).alias("std"))
    best = by.agg(F.min(F.struct((-F.col("val")).alias("r"), F.col(config).alias("winner"), "test")).alias("b")).select("b.winner", F.col("b.test").alias("winner_test"))
    base = by.where(F.col(config) == baseline).select(F.col("test").alias("baseline_test"), F.col("std").alias("seed_std"))
    gain = F.col("winner_test") - F.col("baseline_test")
    return best.crossJoin(base).select("winner", gain.alias("gain"), "seed_std", (gain > F.col("seed_std")).alias("beyond_seeds"))  # one row each


def chi_square_tail(x: float, df: int) -> float:
    """P(chi-square with df degrees > x), from the closed sums for half and whole degrees."""
    import math

    if x <= 0:
        return 1.0
    if df % 2:
        total, term = math.erfc(math.sqrt(x / 2)), math.exp(-x / 2) * math.sqrt(2 * x / math.pi)
        for k in range(3, df + 1, 2):
            total, term = total + term, term * x / k
        return min(total, 1.0)
    total = term = math.exp(-x / 2)
    for k in range(2, df, 2):
        term *= x / k
        total += term
    return min(total, 1.0)


def ranked_by_range(values: DataFrame, value: str, parts: int = 1024) -> DataFrame:
    """Mid-rank of each distinct value over all rows, without one task that orders them all."""
    return ranked_counts(values.groupBy(value).agg(F.count("*").alias("c")), value, parts)


def ranked_counts(counts: DataFrame, value: str, parts: int = 1024, step: int = 32) -> DataFrame:
    """``counts`` (a row a value, ``c`` of each) with the mid-rank: sums by range of values (bounds from a quantile sketch, searched in
    two steps), running sums over the few ranges, and within each."""
    bounds = counts.agg(F.coalesce(F.percentile_approx(value, [i / parts for i in range(1, parts)], 4 * parts), F.array().cast(f"array<{counts.schema[value].dataType.simpleString()}>")).alias("__b"))
    bounds = bounds.withColumn("__heads", F.transform(F.sequence(F.lit(0), F.floor(F.size("__b") / step).cast("int")), lambda i: F.get("__b", i * step)))  # one row
    below = lambda of: F.size(F.filter(of, lambda b: b < F.col(value)))
    head = F.greatest(below("__heads") - 1, F.lit(0)) * step
    placed = counts.crossJoin(F.broadcast(bounds)).withColumn("__p", head + below(F.slice("__b", head + 1, F.lit(step)))).drop("__b", "__heads")
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy("__p").agg(F.sum("c").alias("n")).select("__p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))  # ``parts`` rows
    own = Window.partitionBy("__p").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    below_it = placed.join(F.broadcast(ranges), "__p").withColumn("below", F.col("__before") + F.coalesce(F.sum("c").over(own), F.lit(0)))
    return below_it.select(*counts.columns, (F.col("below") + (F.col("c") + 1) / 2.0).alias("rank"))


def kruskal(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Kruskal-Wallis with tie correction: n, k, h, p and epsilon squared."""
    ranks = ranked_by_range(rows, value)
    counted = rows.groupBy(group, value).agg(F.count("*").alias("__g"))
    sums = counted.join(ranks.select(value, "rank"), value).groupBy(group).agg(F.sum(F.col("__g") * F.col("rank")).alias("r"), F.sum("__g").alias("n"))
    total = sums.agg(F.sum("n").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"), F.count("*").alias("k"))
    ties = ranks.agg(F.sum(F.pow(F.col("c").cast("double"), F.lit(3)) - F.col("c")).alias("t"))
    n = F.col("n").cast("double")
    raw = 12.0 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)
    h = F.coalesce(raw / F.nullif(1 - F.col("t") / (n * n * n - n), F.lit(0.0)), F.lit(0.0))
    out = total.crossJoin(ties).select("n", "k", h.alias("h"), (h / (n - 1)).alias("epsilon_squared"))  # one row each
    tail = F.udf(lambda x, k: chi_square_tail(x, k - 1) if x is not None and k > 1 else None, "double")
    return out.withColumn("p", tail("h", "k"))


def holm(tests: DataFrame, p: str, name: str) -> DataFrame:
    """Holm's adjusted p-values; a row is a test, of which there are few."""
    order = Window.orderBy(p, name)
    m = F.count("*").over(Window.partitionBy())
    scaled = F.least(F.lit(1.0), (m - F.row_number().over(order) + 1) * F.col(p))
    return tests.withColumn("__s", scaled).withColumn("p_holm", F.max("__s").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__s")


def half_tail(k: int, n: int) -> float:
    """P(X <= k) of n fair tosses: the regularised incomplete beta function at a half, by its continued fraction (some sqrt(n) steps)."""
    import math

    if k < 0 or n <= 0:
        return 0.0 if k < 0 else 1.0
    if k >= n:
        return 1.0
    if 2 * k > n:  # the fraction converges below the mean
        return 1.0 - half_tail(n - k - 1, n)
    a, b, x, tiny = n - k, k + 1.0, 0.5, 1e-300
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + (a + b) * math.log(0.5)) / a
    c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1) or tiny)
    out = d
    for m in range(1, 10_000_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1.0 + step * d or tiny)
            c = 1.0 + step / c or tiny
            out *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return min(1.0, front * out)


def sign_test(rows: DataFrame, delta: Column, groups: list[str] | None = None) -> DataFrame:
    """Two-sided sign test: n without zeros, positives, p (exact)."""
    out = rows.groupBy(*(groups or [])).agg(F.count_if(delta != 0).alias("n"), F.count_if(delta > 0).alias("positives"))
    two_sided = F.udf(lambda k, n: min(1.0, 2 * half_tail(min(k, n - k), n)), "double")  # of a row a group
    return out.withColumn("p", two_sided("positives", "n"))


def day_interval(rows: DataFrame, day: str, value: str, iterations: int, seed: str) -> DataFrame:
    """Interval of a mean with days as clusters."""
    return bootstrap_mean(rows, day, value, iterations, seed)


def costs(calls: DataFrame, group: str, cost: str, seconds: str) -> DataFrame:
    """By group: calls, sum of costs (null as 0), cost a call and calls a minute."""
    out = calls.groupBy(group).agg(F.count("*").alias("calls"), F.sum(F.coalesce(cost, F.lit(0.0))).alias("cost"), F.sum(F.coalesce(seconds, F.lit(0.0))).alias("seconds"))
    return out.select(group, "calls", "cost", (F.col("cost") / F.col("calls")).alias("per_call"), F.try_divide(F.col("calls") * 60.0, F.col("seconds")).alias("per_minute"))


def adequacy_table(cells: DataFrame, row: str, column: str, columns: list[str]) -> DataFrame:
    """Rows by columns of "clips/videos" cells, "0/0" where there is nothing."""
    text = F.concat_ws("/", F.col("clips").cast("string"), F.col("videos").cast("string"))
    return cells.groupBy(row).agg(*[F.coalesce(F.max(F.when(F.col(column) == c, text)), F.lit("0/0")).alias(c) for c in columns])


def means(rows: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Mean of several metrics over clips."""
    return rows.groupBy(*key).agg(*[F.avg(c).alias(c) for c in columns])
