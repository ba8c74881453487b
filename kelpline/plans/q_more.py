"""Queries: agreement of many raters, tests, samplers, replies, skeleton relations and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelpline.functions import scalars as C
from kelpline.operators import behaviour as B
from kelpline.operators import merging as M
from kelpline.operators import sampling as S
from kelpline.operators import skeletons as K
from kelpline.operators import statistics as X
from kelpline.plans.catalogue import AROUSAL, CONTEXTS, LABELS, OBS, observations, query, rounded, table

_LINES = "li AS (SELECT l_orderkey AS item, l_returnflag AS label FROM lineitem)"


@query(f"""WITH {_LINES}, c AS (SELECT item, label, count(*) AS c FROM li GROUP BY ALL), i AS (SELECT item, sum(c) AS n, sum(c * c) AS sq FROM c GROUP BY item HAVING sum(c) > 1), s AS (SELECT n, count(*) AS items, sum((sq - n) / (n * (n - 1))::DOUBLE) AS ag FROM i GROUP BY n),
w AS (SELECT * FROM s ORDER BY items DESC, n DESC LIMIT 1), k AS (SELECT label, sum(c)::DOUBLE AS c FROM c JOIN i USING (item) WHERE i.n = (SELECT n FROM w) GROUP BY label), p AS (SELECT sum(c * c) / pow(sum(c), 2) AS pe FROM k)
SELECT CAST(n AS BIGINT) AS raters, items, CAST((SELECT sum(items) FROM s) - items AS BIGINT) AS left_out, round(ag / items, 6) AS po, round(CASE WHEN pe < 1 THEN (ag / items - pe) / (1 - pe) END, 6) AS kappa FROM w, p""")
def fleiss_kappa(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_returnflag").alias("label"))
    return rounded(X.fleiss_kappa(rows, "item", "label"), "po", "kappa")


_CDF = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253]
_SCORED = "s AS (SELECT source, n_chars, toxic FROM documents JOIN labels USING (doc_id))"


def _scored(spark, d):
    return table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars").join(table(spark, d, "labels"), "doc_id")


@query(f"""WITH {_SCORED}, a AS (SELECT toxic = 1 AS arm, source, CAST(toxic = 1 AS VARCHAR) || '/' || source AS c, sum(n_chars) AS s, count(*) AS n FROM s GROUP BY ALL), i AS (SELECT *, unnest(range(1, 201)) AS iteration FROM a),
u AS (SELECT *, ('0x' || substr(md5('i:' || iteration || ':' || c), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM i), m AS (SELECT *, """ + " + ".join(f"CAST(u >= {x!r}::DOUBLE AS INTEGER)" for x in _CDF) + """ AS m FROM u),
e AS (SELECT iteration, sum(m * s) FILTER (arm) / nullif(sum(m * n) FILTER (arm), 0)::DOUBLE - sum(m * s) FILTER (NOT arm) / nullif(sum(m * n) FILTER (NOT arm), 0)::DOUBLE AS d FROM m WHERE m > 0 GROUP BY iteration),
r AS (SELECT count(d) AS iterations, avg(d) AS delta, quantile_cont(d, 0.025) AS low, quantile_cont(d, 0.975) AS high FROM e)
SELECT iterations, round(delta, 4) AS delta, round(low, 4) AS low, round(high, 4) AS high, low <= 0 AND high >= 0 AS includes_zero FROM r""")
def bootstrap_difference(spark, d):
    return rounded(X.bootstrap_difference(_scored(spark, d), F.col("toxic") == 1, "source", "n_chars", 200, "i"), "delta", "low", "high", places=4)


@query(f"""WITH {_SCORED}, c AS (SELECT source, sum(n_chars) AS s, count(*) AS n FROM s GROUP BY source), o AS (SELECT *, row_number() OVER (ORDER BY md5('r:' || source), source) - 1 AS i, count(*) OVER () AS k FROM c),
dr AS (SELECT iteration, unnest(range(1, k + 1)) AS j, k FROM (SELECT DISTINCT k FROM o), (SELECT unnest(range(1, 5001)) AS iteration)),
p AS (SELECT iteration, CAST(floor(('0x' || substr(md5('r:' || iteration || ':' || j), 1, 12))::BIGINT / 281474976710656.0::DOUBLE * k) AS BIGINT) AS i FROM dr),
x AS (SELECT iteration, sum(s) / sum(n)::DOUBLE AS x FROM p JOIN o USING (i) GROUP BY iteration) SELECT count(*) AS iterations, round(avg(x), 4) AS estimate, round(quantile_cont(x, 0.025), 4) AS low, round(quantile_cont(x, 0.975), 4) AS high FROM x""")
def resampled_mean(spark, d):
    """5,000 whole resamples of the clusters."""
    return rounded(X.resampled_mean(_scored(spark, d), "source", "n_chars"), "estimate", "low", "high", places=4)


_FRAMES = "fr AS (SELECT l_orderkey, count(*) FILTER (l_returnflag <> 'N') AS predicted, count(*) FILTER (l_linestatus = 'F') AS truth, count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'F') AS hits FROM lineitem GROUP BY 1)"


@query(f"""WITH {_FRAMES}, p AS (SELECT CASE WHEN predicted > 0 THEN hits / predicted::DOUBLE WHEN truth = 0 THEN 1.0::DOUBLE ELSE 0 END AS p, CASE WHEN truth > 0 THEN hits / truth::DOUBLE ELSE 1.0::DOUBLE END AS r FROM fr)
SELECT count(*) AS frames, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(coalesce(2 * p * r / nullif(p + r, 0), 0)), 6) AS f1 FROM p""")
def tip_scores(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count_if(F.col("l_returnflag") != "N").alias("predicted"), F.count_if(F.col("l_linestatus") == "F").alias("truth"), F.count_if((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")).alias("hits")
    )
    return rounded(X.tip_scores(rows, "hits", "predicted", "truth"), "precision", "recall", "f1")


_RUNS = "ru AS (SELECT event_type AS config, user_id % 5 AS seed, avg(value) AS val, avg(value * (user_id % 7)) AS test FROM events GROUP BY ALL)"


def _runs(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.col("event_type").alias("config"), (F.col("user_id") % 5).alias("seed")).agg(F.avg("value").alias("val"), F.avg(F.col("value") * (F.col("user_id") % 7)).alias("test"))


@query(f"WITH {_RUNS} SELECT config, count(*) AS seeds, round(avg(test), 6) AS mean, round(stddev_pop(test), 6) AS std FROM ru GROUP BY config")
def seed_report(spark, d):
    return rounded(X.seed_report(_runs(spark, d), "config", "test"), "mean", "std")


@query(f"""WITH {_RUNS}, b AS (SELECT config, avg(val) AS val, avg(test) AS test, stddev_pop(test) AS std FROM ru GROUP BY config), w AS (SELECT * FROM b ORDER BY val DESC, config LIMIT 1), z AS (SELECT * FROM b WHERE config = 'click')
SELECT w.config AS winner, round(w.test - z.test, 6) AS gain, round(z.std, 6) AS seed_std, w.test - z.test > z.std AS beyond_seeds FROM w, z""")
def seed_verdict(spark, d):
    return rounded(X.seed_verdict(_runs(spark, d), "config", "click", "val", "test"), "gain", "seed_std")


@query(f"""WITH {OBS}, v AS (SELECT label, round(value / 10) AS v FROM o), r AS (SELECT label, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0::DOUBLE AS r FROM v), s AS (SELECT label, sum(r) AS r, count(*) AS n FROM r GROUP BY label),
t AS (SELECT sum(n)::DOUBLE AS n, sum(r * r / n) AS s, count(*) AS k FROM s), c AS (SELECT sum(pow(c::DOUBLE, 3) - c) AS t FROM (SELECT count(*) AS c FROM v GROUP BY v)),
h AS (SELECT n, k, (12.0::DOUBLE / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - t / (n * n * n - n)) AS h FROM t, c) SELECT CAST(n AS BIGINT) AS n, k, round(h, 5) AS h, round(h / (n - 1), 8) AS epsilon_squared, round(CASE k WHEN 5 THEN exp(-h / 2) * (1 + h / 2) WHEN 3 THEN exp(-h / 2) END, 7) AS p FROM h""")
def kruskal_ties(spark, d):
    rows = observations(spark, d).select("label", F.round(F.col("value") / 10).alias("v"))
    return X.kruskal(rows, "label", "v").select("n", "k", F.round("h", 5).alias("h"), F.round("epsilon_squared", 8).alias("epsilon_squared"), F.round("p", 7).alias("p"))


@query(f"""WITH {OBS}, t AS (SELECT label, 1 / (1.0::DOUBLE + sum(k)) AS p FROM o GROUP BY label), s AS (SELECT label, p, least(1.0::DOUBLE, (count(*) OVER () - row_number() OVER (ORDER BY p, label) + 1) * p) AS s FROM t)
SELECT label, round(p, 9) AS p, round(max(s) OVER (ORDER BY p, label ROWS UNBOUNDED PRECEDING), 9) AS p_holm FROM s""")
def holm_adjusted(spark, d):
    tests = observations(spark, d).groupBy("label").agg((1 / (1.0 + F.sum("k"))).alias("p"))
    return rounded(X.holm(tests, "p", "label"), "p", "p_holm", places=9)


@query(f"""WITH {OBS}, c AS (SELECT camera, count(*) FILTER (k <> 50) AS n, count(*) FILTER (k > 50) AS positives FROM o GROUP BY camera), i AS (SELECT *, unnest(range(least(positives, n - positives) + 1)) AS i FROM c)
SELECT camera, n, positives, round(least(1.0::DOUBLE, 2 * sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2.0::DOUBLE)))), 6) AS p FROM i GROUP BY ALL""")
def sign_counts(spark, d):
    return rounded(X.sign_test(observations(spark, d).select("camera", "k"), F.col("k") - 50, ["camera"]), "p")


@query("SELECT l_shipmode AS mode, count(*) AS calls, round(sum(coalesce(CASE WHEN l_returnflag <> 'A' THEN CAST(l_tax AS DOUBLE) END, 0)), 4) AS cost, round(sum(coalesce(CASE WHEN l_returnflag <> 'A' THEN CAST(l_tax AS DOUBLE) END, 0)) / count(*), 6) AS per_call, round(count(*) * 60.0::DOUBLE / sum(CAST(l_quantity AS DOUBLE)), 6) AS per_minute FROM (SELECT l_returnflag AS l_shipmode, * EXCLUDE (l_shipmode) FROM (SELECT *, 1 AS l_shipmode FROM lineitem)) GROUP BY 1")
def call_costs(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("mode"), F.when(F.col("l_returnflag") != "A", F.col("l_tax").cast("double")).alias("cost"), F.col("l_quantity").cast("double").alias("seconds"))
    out = X.costs(rows, "mode", "cost", "seconds")
    return out.select("mode", "calls", F.round("cost", 4).alias("cost"), F.round("per_call", 6).alias("per_call"), F.round("per_minute", 6).alias("per_minute"))


_SPLITS = "sp AS (SELECT lang, source, CASE WHEN n_chars > 2000 THEN 'test' ELSE 'train' END AS split FROM documents)"


@query(f"WITH {_SPLITS}, c AS (SELECT split, lang, count(*) || '/' || count(DISTINCT source) AS t FROM sp GROUP BY ALL) SELECT split, " + ", ".join(f"coalesce(max(t) FILTER (lang = '{x}'), '0/0') AS {x}" for x in ("en", "de", "fr", "es", "xx")) + " FROM c GROUP BY split")
def adequacy_table(spark, d):
    rows = table(spark, d, "documents").select("lang", "source", F.when(F.col("n_chars") > 2000, "test").otherwise("train").alias("split"))
    return X.adequacy_table(M.adequacy(rows, "split", "lang", "source"), "split", "lang", ["en", "de", "fr", "es", "xx"])


@query(f"WITH {OBS} SELECT camera, round(avg(value), 6) AS value, round(avg(k), 6) AS k FROM o GROUP BY camera")
def metric_means(spark, d):
    return rounded(X.means(observations(spark, d), ["camera"], ["value", "k"]), "value", "k")


@query("""WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), a AS (SELECT *, coalesce(sum(n) OVER (ORDER BY n, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, count(*) OVER () - row_number() OVER (ORDER BY n, lang) + 1 AS l FROM c),
f AS (SELECT *, CAST(floor((300 - b) / l::DOUBLE) AS BIGINT) AS v FROM a), t AS (SELECT max(v) FILTER (n > v) AS v FROM f), q AS (SELECT lang, least(n, coalesce(t.v, n)) AS q FROM f, t),
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('w:' || doc_id), doc_id) AS r FROM documents) SELECT doc_id, lang FROM r JOIN q USING (lang) WHERE r <= q""")
def water_filled(spark, d):
    """300 rows, classes as even as they can be: a sampling operator."""
    return S.water_filled(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 300)


@query("SELECT doc_id FROM documents ORDER BY md5('s:' || doc_id), doc_id LIMIT 40")
def random_rows(spark, d):
    """40 rows: a sampling operator."""
    return S.random_rows(table(spark, d, "documents").select("doc_id"), "doc_id", 40)


@query("SELECT doc_id, source IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 AND quality = 1) AS held FROM documents")
def held_out(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    frozen = docs.join(table(spark, d, "labels").where("toxic = 1 AND quality = 1"), "doc_id").select("source")
    return S.held_out(docs, "source", frozen).select("doc_id", "held")


@query(f"""WITH {OBS}, r AS (SELECT clip, seq, row_number() OVER (PARTITION BY clip ORDER BY seq) - 1 AS place, count(*) OVER (PARTITION BY clip) AS n FROM o)
SELECT DISTINCT clip, seq FROM r, (SELECT unnest(range(4)) AS i) WHERE n > 4 AND place = CAST(round_even(i * (n - 1) / 3.0::DOUBLE, 0) AS BIGINT)""")
def rounded_even_places(spark, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("clip")
    rows = observations(spark, d).select("clip", "seq", (F.row_number().over(w.orderBy("seq")) - 1).alias("place"), F.count("*").over(w).alias("n")).where("n > 4")
    return rows.where(F.array_contains(S.even_places(F.col("n"), 4, "round"), F.col("place"))).select("clip", "seq")


_REPLY = """re AS (SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'CAPTION: a ' || role || chr(10) || 'ethogram: resting' WHEN 1 THEN ' ''just ' || role || ''' ' WHEN 2 THEN 'caption: gone' || chr(10) || 'Ethogram: it is not present' WHEN 3 THEN 'Caption: is not present' || chr(10) || 'ETHOGRAM: Crawling' ELSE 'CAPTION: x' || chr(10) || 'CAPTION: "y ' || role || '"' || chr(10) || 'ETHOGRAM: ''Dancing''' END AS reply FROM conversations)"""
_NAMES = ["Resting / stationary", "Crawling", "animal not present"]


@query(f"""WITH {_REPLY} SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'a ' || role WHEN 1 THEN 'just ' || role WHEN 2 THEN 'gone' WHEN 3 THEN 'animal not present' ELSE 'y ' || role END AS caption,
CASE turn % 5 WHEN 0 THEN 'Resting / stationary' WHEN 1 THEN 'uncertain' WHEN 2 THEN 'animal not present' WHEN 3 THEN 'animal not present' ELSE 'Dancing' END AS label FROM re JOIN conversations USING (conv_id, turn)""")
def parsed_replies(spark, d):
    role, kind = F.col("role"), F.col("turn") % 5
    reply = (
        F.when(kind == 0, F.concat(F.lit("CAPTION: a "), role, F.lit("\nethogram: resting")))
        .when(kind == 1, F.concat(F.lit(" 'just "), role, F.lit("' ")))
        .when(kind == 2, "caption: gone\nEthogram: it is not present")
        .when(kind == 3, "Caption: is not present\nETHOGRAM: Crawling")
        .otherwise(F.concat(F.lit('CAPTION: x\nCAPTION: "y '), role, F.lit("\"\nETHOGRAM: 'Dancing'")))
    )
    caption, label = C.parsed_reply(reply, _NAMES)
    return table(spark, d, "conversations").select("conv_id", "turn", caption.alias("caption"), label.alias("label"))


@query(f"""WITH {OBS} SELECT clip, seq, k % 2 = 1 AS present, CASE WHEN label IN ('click', 'view') THEN label ELSE 'uncertain' END AS behavior, context, CASE WHEN k % 3 = 0 THEN 0.0::DOUBLE ELSE round(k / 100.0::DOUBLE, 4) END AS confidence FROM o""")
def validated_replies(spark, d):
    o = observations(spark, d)
    number = F.when(F.col("k") % 3 == 0, '"none"').otherwise(F.format_number(F.col("k") / 100.0, 4))
    reply = F.concat(F.lit('```json {"present": '), (F.col("k") % 2 == 1).cast("string"), F.lit(', "behavior": " '), F.upper("label"), F.lit('", "context": "'), F.col("context"), F.lit('", "confidence": '), number, F.lit("} ```"))
    r = C.validated(reply, {"behavior": (["click", "view", "uncertain"], "uncertain"), "context": (list(CONTEXTS), "none")})
    return o.select("clip", "seq", r.alias("r")).select("clip", "seq", "r.present", "r.behavior", "r.context", F.round("r.confidence", 4).alias("confidence"))


@query(f"WITH {OBS} SELECT clip, seq, CASE WHEN k % 4 = 0 THEN '0/0' ELSE CAST(k % 5 AS VARCHAR) || '/5' END AS votes, CASE WHEN k % 4 = 0 THEN 0 ELSE CAST(k % 5 AS INTEGER) END AS top, CASE WHEN k % 4 = 0 THEN 0 ELSE 5 END AS n FROM o")
def vote_fractions(spark, d):
    ok = F.col("k") % 4 != 0
    text = C.votes_text(F.when(ok, F.col("k") % 5), F.when(ok, F.lit(5)))
    top, n = C.votes_of(F.col("votes"))
    return observations(spark, d).withColumn("votes", text).select("clip", "seq", "votes", top.alias("top"), n.alias("n"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE round((doc_id % 100) / 100.0::DOUBLE, 2) END AS score, source || '_' || lang || '_' || doc_id AS clip, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) ELSE 'x--y' END AS segment,
coalesce(nullif(CASE WHEN doc_id % 2 = 0 THEN '' ELSE lang END, ''), nullif(source, ''), '') AS caption, greatest(1, CAST(round_even(n_chars * 0.01::DOUBLE, 0) AS INTEGER)) AS side FROM documents""")
def name_parts(spark, d):
    key = F.col("doc_id")
    name = F.concat(F.lit("hardneg"), F.when(key % 3 != 0, F.concat(F.lit("_p"), F.format_string("%.2f", (key % 100) / 100.0), F.lit("_x"))).otherwise(""))
    path = F.concat(F.lit("/root/clips/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), key.cast("string"), F.lit(".mp4"))
    segment = F.when(key % 2 == 0, F.concat(F.lit("s"), key.cast("string"), F.lit("--cam1"))).otherwise("x--y")
    return table(spark, d, "documents").select(
        "doc_id",
        F.round(C.suffix_score(name), 2).alias("score"),
        C.flat_id(path, "/clips/", ".mp4").alias("clip"),
        C.digits_before(segment, "--").alias("segment"),
        C.first_filled(F.when(key % 2 == 0, "").otherwise(F.col("lang")), F.col("source")).alias("caption"),
        C.scaled(F.col("n_chars"), F.lit(0.01)).alias("side"),
    )


@query("WITH e AS (SELECT vec_id, list_avg(embedding[1:8]::DOUBLE[]) AS a, list_avg(embedding[9:]::DOUBLE[]) AS b FROM embeddings) SELECT vec_id, round(1 / (1 + exp((b - a) * 3)), 6) AS p FROM e")
def group_softmax(spark, d):
    return rounded(table(spark, d, "embeddings").select("vec_id", C.group_softmax(F.transform("embedding", lambda x: x.cast("double")), 8, 3.0).alias("p")), "p")


@query("SELECT vec_id, len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: isfinite(x))) AS fit FROM embeddings")
def shape_guard(spark, d):
    return table(spark, d, "embeddings").select("vec_id", C.well_shaped(F.array(F.transform("embedding", lambda x: x.cast("double"))), 1, 64).alias("fit"))


@query("SELECT l_orderkey, round(abs(sum(l_quantity) - sum(l_linenumber)) / greatest(sum(l_linenumber), 1)::DOUBLE, 6) AS error FROM lineitem GROUP BY 1")
def area_errors(spark, d):
    sums = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("double").alias("p"), F.sum("l_linenumber").cast("double").alias("t"))
    return rounded(sums.select("l_orderkey", C.area_error(F.col("p"), F.col("t")).alias("error")), "error")


@query(f"""WITH {OBS}, t AS (SELECT 'not ' AS f, count(*) FILTER (present IS NOT TRUE) AS n, count(*) FILTER (present IS FALSE) AS n_false FROM (SELECT CASE WHEN k % 5 = 0 THEN NULL ELSE present END AS present FROM o)) SELECT n, n_false FROM t""")
def absent_or_unknown(spark, d):
    """Not known to be present, and known not to be: two predicates over three truth values."""
    p = F.when(F.col("k") % 5 != 0, F.col("present"))
    return observations(spark, d).agg(F.count_if(~F.coalesce(p, F.lit(False))).alias("n"), F.count_if(F.coalesce(~p, F.lit(False))).alias("n_false"))


@query(f"""WITH {OBS}, x AS (SELECT * FROM o WHERE CAST(ts AS DATE) IN (SELECT CAST(ts AS DATE) FROM o WHERE value > 300)) SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS "all", count(*) FILTER (present) AS present,
round(count(*) FILTER (present) / count(*)::DOUBLE, 6) AS present_rate, round(avg({AROUSAL}) FILTER (present), 6) AS mean_arousal FROM x GROUP BY 1 HAVING count(*) >= 5""")
def circadian_matched(spark, d):
    o = observations(spark, d).withColumn("day", F.col("ts").cast("date"))
    days = o.where("value > 300").select("day").distinct().withColumn("matched", F.lit(True))
    rows = o.join(days, "day", "left")
    out = B.circadian(rows, F.hour("ts"), F.col("present"), C.arousal(F.col("activity"), F.col("posture")), exposure=F.coalesce("matched", F.lit(False)))
    return rounded(out, "present_rate", "mean_arousal")


@query(f"WITH {OBS} SELECT clip, seq, CAST(least(CAST(ceil(k / 64.0::DOUBLE) AS BIGINT) * 64, 80) AS BIGINT) AS scanned, coalesce(CASE WHEN k % 3 = 0 THEN NULL ELSE value END >= 50, false) OR (k % 3 = 0 AND k % 4 = 0) AS whole FROM o")
def scan_decisions(spark, d):
    third = F.col("k") % 3 == 0
    whole = C.full_scan(F.when(~third, F.lit(2)), F.when(F.col("k") % 4 != 0, F.lit(60)), F.when(~third, F.col("value")), 50)
    return observations(spark, d).select("clip", "seq", C.scanned_seconds(F.col("k"), F.lit(80)).cast("long").alias("scanned"), whole.alias("whole"))


_PIXELS = "px AS (SELECT user_id % 11 AS g, event_id % 37 AS x, CAST(floor(value) AS BIGINT) % 23 AS y FROM events GROUP BY ALL)"


@query(f"WITH {_PIXELS} SELECT a.g AS g, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by, round(sqrt(abs(a.x - b.x) + abs(a.y - b.y)), 6) AS length FROM px a JOIN px b ON a.g = b.g AND ((b.y = a.y AND b.x = a.x + 1) OR (b.y = a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1))")
def pixel_edges(spark, d):
    px = table(spark, d, "events").select((F.col("user_id") % 11).alias("g"), (F.col("event_id") % 37).alias("x"), (F.floor("value") % 23).alias("y")).distinct()
    return rounded(K.pixel_edges(px, "g", "x", "y"), "length")


_NODES = "nd AS (SELECT clip, k % 3 AS arm, seq, value AS x, CAST(k AS DOUBLE) AS y FROM o)"


def _nodes(spark, d):
    return observations(spark, d).select("clip", (F.col("k") % 3).alias("arm"), "seq", F.col("value").alias("x"), F.col("k").cast("double").alias("y"))


@query(f"""WITH {OBS}, {_NODES}, w AS (SELECT *, lag(x) OVER v AS px, lag(y) OVER v AS py, lead(x) OVER v AS nx, lead(y) OVER v AS ny FROM nd WINDOW v AS (PARTITION BY clip, arm ORDER BY seq)),
c AS (SELECT clip, arm, seq, sum(coalesce(sqrt((x - px) * (x - px) + (y - py) * (y - py)), 0)) OVER (PARTITION BY clip, arm ORDER BY seq) AS arc, (nx - px) / 2 AS dx, (ny - py) / 2 AS dy, nx - 2 * x + px AS ddx, ny - 2 * y + py AS ddy FROM w)
SELECT clip, arm, seq, round(arc, 5) AS arc, round(abs(dx * ddy - dy * ddx) / nullif(pow(dx * dx + dy * dy, 1.5), 0), 5) AS curvature FROM c""")
def curve_geometry(spark, d):
    return rounded(K.along_curve(_nodes(spark, d), ["clip", "arm"], "seq", "x", "y").select("clip", "arm", "seq", "arc", "curvature"), "arc", "curvature", places=5)


@query(f"WITH {OBS}, {_NODES} SELECT clip, arm, seq AS a, lead(seq) OVER (PARTITION BY clip, arm ORDER BY seq) AS b FROM nd QUALIFY b IS NOT NULL")
def chain_edges(spark, d):
    return K.chain_edges(_nodes(spark, d), ["clip"], "arm", "seq", "seq")


_SIGN = "sg AS (SELECT clip, arm, atan2(avg(sin(atan2(y - 50, x - 100))), avg(cos(atan2(y - 50, x - 100)))) AS direction, avg(sqrt((x - 100) * (x - 100) + (y - 50) * (y - 50))) AS mean_distance, max(sqrt((x - 100) * (x - 100) + (y - 50) * (y - 50))) AS reach FROM nd GROUP BY ALL)"


def _signs(spark, d):
    return K.signatures(_nodes(spark, d).withColumns({"cx": F.lit(100.0), "cy": F.lit(50.0)}), ["clip"], "arm", "x", "y", "cx", "cy")


@query(f"WITH {OBS}, {_NODES}, {_SIGN} SELECT clip, arm, round(direction, 5) AS direction, round(mean_distance, 5) AS mean_distance, round(reach, 5) AS reach FROM sg")
def arm_signatures(spark, d):
    return rounded(_signs(spark, d), "direction", "mean_distance", "reach", places=5)


@query(f"""WITH {OBS}, {_NODES}, {_SIGN}, c AS (SELECT a.clip, a.arm AS a, b.arm AS b, abs(a.direction - b.direction) AS g, abs(a.reach - b.reach) / greatest(a.reach, b.reach, 1e-9) AS r FROM sg a JOIN sg b ON b.clip = a.clip + 1)
SELECT clip, a, b, round(least(g % (2 * pi()), 2 * pi() - g % (2 * pi())) + 0.5::DOUBLE * r, 5) AS cost FROM c""")
def arm_pair_costs(spark, d):
    s = _signs(spark, d)
    return rounded(K.pair_costs(s, s.withColumn("clip", F.col("clip") - 1), "clip", "arm"), "cost", places=5)


@query(f"""WITH {OBS}, m AS (SELECT clip, count(DISTINCT k) % 10 AS arms, max(k) % 3 AS components, min(k) % 2 AS cycles, avg(k) / 100 AS symmetry FROM o GROUP BY clip)
SELECT clip, round((least(arms / 8.0::DOUBLE, 1) + CAST(components = 1 AS INTEGER) + CAST(cycles = 0 AS INTEGER) + symmetry) / 4, 6) AS score,
array_to_string(list_filter([CASE WHEN components <> 1 THEN 'disconnected' END, CASE WHEN cycles <> 0 THEN 'cyclic' END, CASE WHEN arms = 0 THEN 'no_arms' END, CASE WHEN arms > 8 THEN 'too_many_arms' END], lambda x: x IS NOT NULL), ',') AS faults FROM m""")
def graded_graphs(spark, d):
    m = observations(spark, d).groupBy("clip").agg((F.count_distinct("k") % 10).alias("arms"), (F.max("k") % 3).alias("components"), (F.min("k") % 2).alias("cycles"), (F.avg("k") / 100).alias("symmetry"))
    return rounded(K.graded(m).select("clip", "score", F.array_join("faults", ",").alias("faults")), "score")


@query(f"WITH {OBS}, c AS (SELECT clip, k % 4 AS setting, max(value) AS score, bool_or(label = 'purchase') AS valid FROM o GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY valid DESC, score DESC, setting) AS r FROM c) SELECT clip, setting, score, NOT valid AS relaxed FROM r WHERE r = 1")
def best_candidates(spark, d):
    c = observations(spark, d).groupBy("clip", (F.col("k") % 4).alias("setting")).agg(F.max("value").alias("score"), F.bool_or(F.col("label") == "purchase").alias("valid"))
    return K.best_candidate(c, "clip", "setting", F.col("score"), F.col("valid"))


@query(f"""WITH {OBS}, a AS (SELECT clip, k, count(*) AS t FROM o WHERE label = 'click' GROUP BY ALL), b AS (SELECT clip, k, count(*) AS f FROM o WHERE label = 'view' GROUP BY ALL)
SELECT CAST(coalesce(f, 0) - coalesce(t, 0) AS INTEGER) AS difference, count(*) AS frames FROM a FULL JOIN b USING (clip, k) GROUP BY 1""")
def arm_count_diagnostic(spark, d):
    o = observations(spark, d)
    return K.count_diagnostic(o.where("label = 'click'"), o.where("label = 'view'"), ["clip", "k"])


@query("""SELECT vec_id, label % 3 <> 0 AND label % 3 <> 1 AS ok, CASE label % 3 WHEN 0 THEN 'no neighbours' WHEN 1 THEN 'another shape' END AS reason, round(CASE WHEN label % 3 = 2 THEN (embedding[1]::DOUBLE + 2 * embedding[2]::DOUBLE) / 3 ELSE embedding[1]::DOUBLE END, 5) AS p0 FROM embeddings""")
def fused_probabilities(spark, d):
    two = lambda i: F.transform(F.slice("embedding", i, 2), lambda x: x.cast("double"))
    kind = F.col("label") % 3
    others = F.when(kind == 0, F.slice(F.array(two(1)), 1, 0)).when(kind == 1, F.array(two(2), F.slice(two(2), 1, 1))).otherwise(F.array(two(2), two(2)))
    p, ok, reason = K.fused(two(1), others)
    return rounded(table(spark, d, "embeddings").select("vec_id", ok.alias("ok"), reason.alias("reason"), F.get(p, 0).alias("p0")), "p0", places=5)


@query(f"WITH {OBS}, n AS (SELECT DISTINCT k % 9 AS arm, label FROM o) SELECT arm, label, CASE label WHEN 'view' THEN 'MantleCenter' WHEN 'click' THEN 'Head' ELSE 'Arm' || arm || '_' || upper(label[1]) || label[2:] END AS node FROM n")
def node_names(spark, d):
    part = F.when(F.col("label") == "view", "mantle").when(F.col("label") == "click", "head").otherwise(F.col("label"))
    return observations(spark, d).select((F.col("k") % 9).alias("arm"), "label").distinct().select("arm", "label", K.node_key(F.col("arm"), part).alias("node"))


@query(f"WITH {OBS} SELECT clip, seq, CASE WHEN value > 100 THEN '{{\"k\":' || k || '}}' ELSE '{{\"v\":1,\"k\":' || k || '}}' END AS j FROM o")
def plain_json(spark, d):
    """A number that isn't finite is left out of the object."""
    v = F.when(F.col("value") > 100, F.lit(float("nan"))).otherwise(1.0).alias("v")
    rows = observations(spark, d).select("clip", "seq", "k", v)
    return rows.select("clip", "seq", F.replace(C.plain_json(("v", True), ("k", False)), F.lit("1.0"), F.lit("1")).alias("j"))


@query(f"WITH {OBS}, m AS (SELECT label FROM o) SELECT label, count(*) AS n FROM m WHERE label = 'view' GROUP BY label")
def rows_of_split(spark, d):
    """One split is the feature."""
    return S.of_split(observations(spark, d), "label", LABELS[3]).groupBy("label").agg(F.count("*").alias("n"))
