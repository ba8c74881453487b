"""Queries: evaluation statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelpline.functions import scalars as C
from kelpline.operators import statistics as X
from kelpline.plans.catalogue import LABELS, OBS, observations, query, rounded, table



def toxic():
    return F.col("toxic") == 1

SCORED = "s AS (SELECT doc_id, source, lang, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id))"


def _scored(spark, d):
    return table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars").join(table(spark, d, "labels"), "doc_id")


MID = """m AS (SELECT *, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0::DOUBLE AS r FROM s)"""


@query(f"""WITH {SCORED}, {MID}, c AS (SELECT count(*) FILTER (toxic = 1) AS n1, count(*) FILTER (toxic <> 1) AS n0, sum(r) FILTER (toxic = 1) AS s FROM m)
SELECT n1 AS n_pos, n0 AS n_neg, round((s - n1 * (n1 + 1) / 2.0::DOUBLE) / nullif(n1 * n0, 0), 6) AS auc FROM c""")
def auc_rank(spark, d):
    return rounded(X.auc(_scored(spark, d), "n_chars", toxic()), "auc")


@query(f"""WITH {SCORED}, m AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0::DOUBLE AS r FROM s),
c AS (SELECT lang, count(*) FILTER (toxic = 1) AS n1, count(*) FILTER (toxic <> 1) AS n0, coalesce(sum(r) FILTER (toxic = 1), 0) AS s FROM m GROUP BY lang)
SELECT lang, n1 AS n_pos, n0 AS n_neg, round((s - n1 * (n1 + 1) / 2.0::DOUBLE) / nullif(n1 * n0, 0), 6) AS auc FROM c""")
def auc_by_language(spark, d):
    return rounded(X.auc(_scored(spark, d), "n_chars", toxic(), ["lang"]), "auc")


@query(f"""WITH {SCORED}, c AS (SELECT quantile_cont(n_chars, 0.2) FILTER (toxic = 1) AS cut FROM s)
SELECT round(any_value(cut), 6) AS cut, round(avg(CASE WHEN n_chars >= cut THEN 1.0::DOUBLE ELSE 0 END) FILTER (toxic <> 1), 6) AS fp_rate FROM s, c""")
def fp_at_recall(spark, d):
    return rounded(X.fp_at_recall(_scored(spark, d), "n_chars", toxic(), 0.8), "cut", "fp_rate")


@query(f"""WITH {SCORED} SELECT round(count(*) FILTER (toxic = 1 AND n_chars > 1500) / greatest(1, count(*) FILTER (toxic = 1))::DOUBLE, 6) AS recall,
round(count(*) FILTER (toxic <> 1 AND n_chars > 1500) / greatest(1, count(*) FILTER (toxic <> 1))::DOUBLE, 6) AS fpr, round(count(*) FILTER (toxic = 1 AND n_chars > 1500) / greatest(1, count(*) FILTER (n_chars > 1500))::DOUBLE, 6) AS precision FROM s""")
def gate_rates(spark, d):
    return rounded(X.gate_rates(_scored(spark, d), F.col("n_chars") > 1500, toxic()), "recall", "fpr", "precision")


TABLE22 = f"""{SCORED}, t AS (SELECT lang, count(*) FILTER (quality = 1 AND toxic = 1) AS tt, count(*) FILTER (quality = 1 AND toxic <> 1) AS tf, count(*) FILTER (quality <> 1 AND toxic = 1) AS ft, count(*) FILTER (quality <> 1 AND toxic <> 1) AS ff FROM s GROUP BY lang)"""


def _table(spark, d):
    return X.contingency(_scored(spark, d), F.col("quality") == 1, toxic(), ["lang"])


@query(f"WITH {TABLE22} SELECT * FROM t")
def contingency(spark, d):
    return _table(spark, d)


@query(f"""WITH {TABLE22}, p AS (SELECT *, (tt + tf + ft + ff)::DOUBLE AS n FROM t), q AS (SELECT *, (tt + ff) / n AS po, ((tt + tf) * (tt + ft) + (ft + ff) * (tf + ff)) / (n * n) AS pe FROM p)
SELECT lang, tt, tf, ft, ff, round(po, 6) AS po, round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END, 6) AS kappa FROM q""")
def kappa(spark, d):
    return rounded(X.kappa(_table(spark, d)), "po", "kappa")


@query(f"""WITH {OBS}, r AS (SELECT context AS a, CASE WHEN k % 3 = 0 THEN context ELSE 'none' END AS b FROM o), n AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (a = b) AS s FROM r),
e AS (SELECT sum(x.n * y.n)::DOUBLE AS c FROM (SELECT a, count(*) AS n FROM r GROUP BY a) x JOIN (SELECT b, count(*) AS n FROM r GROUP BY b) y ON a = b)
SELECT CAST(n AS BIGINT) AS n, round(s / n, 6) AS po, round((s / n - c / (n * n)) / (1 - c / (n * n)), 6) AS kappa FROM n, e""")
def multi_kappa(spark, d):
    rows = observations(spark, d).select(F.col("context").alias("a"), F.when(F.col("k") % 3 == 0, F.col("context")).otherwise("none").alias("b"))
    return rounded(X.multi_kappa(rows, "a", "b"), "po", "kappa")


@query(f"""WITH {SCORED}, c AS (SELECT source, count(*) FILTER (toxic = 1) AS k, count(*) AS n FROM s GROUP BY source), w AS (SELECT *, k / n::DOUBLE AS p, 1.96::DOUBLE AS z FROM c)
SELECT source, k, n, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4.0::DOUBLE * n * n))) / (1 + z * z / n), 6) AS low, round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4.0::DOUBLE * n * n))) / (1 + z * z / n), 6) AS high FROM w""")
def wilson(spark, d):
    counts = _scored(spark, d).groupBy("source").agg(F.count_if(toxic()).alias("k"), F.count("*").alias("n"))
    low, high = X.wilson(F.col("k"), F.col("n"))
    return rounded(counts.withColumns({"low": low, "high": high}), "low", "high")


@query(f"WITH {OBS} SELECT context AS human, CASE WHEN k % 3 = 0 THEN context ELSE 'none' END AS model, count(*) AS n FROM o WHERE context <> CASE WHEN k % 3 = 0 THEN context ELSE 'none' END GROUP BY ALL ORDER BY n DESC, human, model LIMIT 12")
def confusion_pairs(spark, d):
    """The twelve commonest disagreements: a top-k report."""
    model = F.when(F.col("k") % 3 == 0, F.col("context")).otherwise("none")
    rows = observations(spark, d).select(F.col("context").alias("human"), model.alias("model")).where("human <> model")
    return rows.groupBy("human", "model").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "human", "model").limit(12)


F1 = f"""{OBS}, r AS (SELECT label AS t, CASE WHEN k % 4 = 0 THEN 'view' ELSE label END AS p FROM o), cl AS (SELECT unnest(['click', 'purchase', 'signup', 'view', 'never']) AS label),
x AS (SELECT cl.label, (SELECT count(*) FROM r WHERE t = cl.label) AS support, (SELECT count(*) FROM r WHERE p = cl.label) AS told, (SELECT count(*) FROM r WHERE t = cl.label AND p = cl.label) AS hit FROM cl),
y AS (SELECT *, coalesce(hit / nullif(told, 0)::DOUBLE, 0) AS pr, coalesce(hit / nullif(support, 0)::DOUBLE, 0) AS re FROM x), f AS (SELECT label, support, pr, re, coalesce(2 * pr * re / nullif(pr + re, 0), 0) AS f1 FROM y)"""


def _f1(spark, d):
    rows = observations(spark, d).select(F.col("label").alias("t"), F.when(F.col("k") % 4 == 0, "view").otherwise(F.col("label")).alias("p"))
    classes = spark.createDataFrame([(x,) for x in (*LABELS, "never")], "label string")
    return X.f1_by_class(rows, "t", "p", classes, "label")


@query(f"WITH {F1} SELECT label, support, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1 FROM f")
def f1_by_class(spark, d):
    return rounded(_f1(spark, d), "precision", "recall", "f1")


@query(f"WITH {F1} SELECT round(avg(f1), 6) AS macro_f1 FROM f")
def macro_f1(spark, d):
    return _f1(spark, d).agg(F.round(F.avg("f1"), 6).alias("macro_f1"))


SWEEP = f"""{SCORED}, t AS (SELECT unnest([500.0::DOUBLE, 1000.0, 2000.0, 4000.0, 8000.0]) AS threshold),
w AS (SELECT threshold, count(*) FILTER (n_chars >= threshold AND toxic = 1) AS tp, count(*) FILTER (n_chars >= threshold AND toxic <> 1) AS fp, count(*) FILTER (n_chars < threshold AND toxic = 1) AS fn FROM s, t GROUP BY threshold),
f AS (SELECT *, round(2.0::DOUBLE * tp / greatest(2 * tp + fp + fn, 1), 6) AS f1 FROM w)"""


def _sweep(spark, d):
    return rounded(X.threshold_sweep(_scored(spark, d), "n_chars", toxic(), [500, 1000, 2000, 4000, 8000]), "f1")


@query(f"WITH {SWEEP} SELECT * FROM f")
def threshold_sweep(spark, d):
    return _sweep(spark, d)


@query(f"WITH {SWEEP} SELECT * FROM f ORDER BY f1 DESC, threshold LIMIT 1")
def best_threshold(spark, d):
    return X.best_row(_sweep(spark, d), "f1", "threshold")


@query(f"WITH {OBS}, l AS (SELECT clip, list(value ORDER BY value) AS v FROM o WHERE value > 0 GROUP BY clip) SELECT clip, v[len(v) // 2 + 1] AS upper_median FROM l")
def upper_median(spark, d):
    return X.upper_median(observations(spark, d), "clip", "value")


@query(f"WITH {OBS} SELECT label, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS q2, round(quantile_cont(value, 0.75), 6) AS q3, round(stddev_pop(value), 6) AS std FROM o GROUP BY label")
def iqr_by_class(spark, d):
    out = observations(spark, d).groupBy("label").agg(*[F.percentile("value", q).alias(n) for n, q in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))], F.stddev_pop("value").alias("std"))
    return rounded(out, "q1", "q2", "q3", "std")


@query(f"WITH {OBS} SELECT camera, count(*) FILTER (present) AS n, round(count(*) FILTER (present AND label = 'error') / nullif(count(*) FILTER (present AND k > 98), 0)::DOUBLE, 6) AS rate FROM o GROUP BY camera")
def camera_fp_rate(spark, d):
    out = observations(spark, d).groupBy("camera").agg(F.count_if("present").alias("n"), F.try_divide(F.count_if(F.col("present") & (F.col("label") == "error")), F.count_if(F.col("present") & (F.col("k") > 98))).alias("rate"))
    return rounded(out, "rate")


@query(f"""WITH {SCORED}, v AS (SELECT source, lang, count(*) AS n FROM s GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS r FROM v) SELECT source, lang AS dominant, n FROM r WHERE r = 1""")
def dominant_label(spark, d):
    counts = _scored(spark, d).groupBy("source", "lang").agg(F.count("*").alias("n"))
    best = counts.groupBy("source").agg(F.min(F.struct((-F.col("n")).alias("r"), "lang")).alias("b"))
    return best.select("source", F.col("b.lang").alias("dominant"), (-F.col("b.r")).alias("n"))


@query(f"WITH {SCORED}, c AS (SELECT lang, count(*) AS n FROM s GROUP BY lang) SELECT round(max(n) / sum(n)::DOUBLE, 6) AS majority_share FROM c")
def majority_share(spark, d):
    return _scored(spark, d).groupBy("lang").agg(F.count("*").alias("n")).agg(F.round(F.max("n") / F.sum("n"), 6).alias("majority_share"))


@query(f"""WITH {OBS}, r AS (SELECT label AS h, CASE WHEN k % 4 = 0 THEN 'view' ELSE label END AS t, CASE WHEN k % 5 = 0 THEN 'click' ELSE label END AS p FROM o)
SELECT round(avg(CAST(h = t AS INTEGER)), 6) AS teacher, round(avg(CAST(h = p AS INTEGER)), 6) AS student, count(*) FILTER (t <> p AND h = t) AS with_teacher, count(*) FILTER (t <> p AND h = p) AS with_student, count(*) FILTER (t <> p AND h <> t AND h <> p) AS with_neither FROM r""")
def rater_agreement(spark, d):
    r = observations(spark, d).select(F.col("label").alias("h"), F.when(F.col("k") % 4 == 0, "view").otherwise(F.col("label")).alias("t"), F.when(F.col("k") % 5 == 0, "click").otherwise(F.col("label")).alias("p"))
    h, t, p = F.col("h"), F.col("t"), F.col("p")
    share = lambda x: F.round(F.avg(x.cast("int")), 6)
    return r.agg(share(h == t).alias("teacher"), share(h == p).alias("student"), F.count_if((t != p) & (h == t)).alias("with_teacher"), F.count_if((t != p) & (h == p)).alias("with_student"), F.count_if((t != p) & (h != t) & (h != p)).alias("with_neither"))


_CDF = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253]
DRAWN = """i AS (SELECT source, unnest(range(1, 201)) AS iteration FROM c), u AS (SELECT source, iteration, ('0x' || substr(md5('{seed}:' || iteration || ':' || source), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM i),
m AS (SELECT source, iteration, """ + " + ".join(f"CAST(u >= {x!r}::DOUBLE AS INTEGER)" for x in _CDF) + " AS m FROM u)"


@query(f"""WITH {SCORED}, c AS (SELECT source, sum(n_chars) AS s, count(*) AS n FROM s GROUP BY source), {DRAWN.format(seed='b')},
x AS (SELECT iteration, sum(m * s) / sum(m * n)::DOUBLE AS x FROM c JOIN m USING (source) WHERE m > 0 GROUP BY iteration)
SELECT count(*) AS iterations, round(avg(x), 4) AS estimate, round(quantile_cont(x, 0.025), 4) AS low, round(quantile_cont(x, 0.975), 4) AS high FROM x""")
def bootstrap_mean(spark, d):
    return rounded(X.bootstrap_mean(_scored(spark, d), "source", "n_chars", 200, "b"), "estimate", "low", "high", places=4)


@query(f"""WITH {OBS}, r AS (SELECT label, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0::DOUBLE AS r FROM o), s AS (SELECT label, sum(r) AS r, count(*) AS n FROM r GROUP BY label),
t AS (SELECT sum(n)::DOUBLE AS n, sum(r * r / n) AS s, count(*) AS k FROM s), h AS (SELECT n, k, 12.0::DOUBLE / (n * (n + 1)) * s - 3 * (n + 1) AS h FROM t) SELECT CAST(n AS BIGINT) AS n, k, round(h, 5) AS h, round(h / (n - 1), 8) AS epsilon_squared FROM h""")
def kruskal_wallis(spark, d):
    out = X.kruskal_h(observations(spark, d).select("label", "value"), "label", "value")
    return out.select("n", "k", F.round("h", 5).alias("h"), F.round("epsilon_squared", 8).alias("epsilon_squared"))


@query("""WITH l AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings) SELECT label, CAST(d AS INTEGER) AS d, round(avg(x::DOUBLE), 5) AS mean, round(stddev_pop(x::DOUBLE), 5) AS std, round(max(x)::DOUBLE, 5) AS max FROM l GROUP BY ALL""")
def pooled_features(spark, d):
    rows = table(spark, d, "embeddings").select("label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return rounded(X.pooled(rows, "label", "v").withColumnRenamed("d", "d"), "mean", "std", "max", places=5)


_DIMS = range(64)


@query("WITH s AS (SELECT " + ", ".join(f"avg(embedding[{i + 1}]::DOUBLE) AS m{i}, stddev_pop(embedding[{i + 1}]::DOUBLE) AS s{i}" for i in _DIMS) + " FROM embeddings WHERE label <> 0) SELECT vec_id, "
       + ", ".join(f"round((embedding[{i + 1}]::DOUBLE - m{i}) / (s{i} + 1e-6::DOUBLE), 5) AS z_d{i}" for i in _DIMS) + " FROM embeddings, s")
def standardised(spark, d):
    """Every dimension, by the statistics of all labels but one."""
    names = [f"d{i}" for i in _DIMS]
    rows = table(spark, d, "embeddings").select("vec_id", "label", *[F.get("embedding", i).cast("double").alias(n) for i, n in zip(_DIMS, names, strict=True)])
    zs = [f"z_{n}" for n in names]
    return rounded(X.standardised(rows, F.col("label") != 0, names).select("vec_id", *zs), *zs, places=5)


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: exp(x::DOUBLE)) AS e, list_position(embedding, list_max(embedding)) - 1 AS top FROM embeddings)
SELECT vec_id, CAST(top AS INTEGER) AS top, round(e[1] / list_sum(e), 6) AS p0 FROM e""")
def softmax_top(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", C.first_maximum(F.col("embedding")).alias("top"), F.get(C.softmax(F.transform("embedding", lambda x: x.cast("double"))), 0).alias("p0"))
    return rounded(rows, "p0")


@query("""WITH f AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], v), 5) AS cosine FROM embeddings, f""")
def cosine_to_first(spark, d):
    rows = table(spark, d, "embeddings")
    probe = rows.where("vec_id = 0").select(F.col("embedding").alias("v"))  # one row
    return rounded(rows.crossJoin(F.broadcast(probe)).select("vec_id", C.cosine(F.col("embedding"), F.col("v")).alias("cosine")), "cosine", places=5)


@query()
def linear_head(spark, d):
    """A weighted linear classifier on frozen features. The labels of ``embeddings`` follow none of them: tests hold the head to its own rows, and to features that tell."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("double").alias("label"), array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    n = rows.groupBy("label").agg(F.count("*").alias("n"))
    rows = rows.join(n, "label").withColumn("w", 1.0 / F.sqrt("n"))
    model = LogisticRegression(weightCol="w", maxIter=30, regParam=0.01).fit(rows.where(F.col("vec_id") % 4 != 0))
    return model.transform(rows).select("vec_id", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"))


@query(f"""WITH {SCORED} SELECT 'seen' AS subset, count(*) AS n, round(avg(n_chars), 6) AS mean FROM s WHERE quality = 1 UNION ALL SELECT 'toxic', count(*), round(avg(n_chars), 6) FROM s WHERE toxic = 1 UNION ALL SELECT 'all', count(*), round(avg(n_chars), 6) FROM s""")
def subset_means(spark, d):
    subsets = {"seen": F.col("quality") == 1, "toxic": toxic(), "all": F.lit(True)}
    return rounded(X.by_subset(_scored(spark, d), subsets, "n_chars"), "mean")
