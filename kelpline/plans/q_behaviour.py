"""Queries: behaviour profiles and label fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelpline.functions.scalars import arousal, clock_hour
from kelpline.operators import behaviour as B
from kelpline.operators import voting as V
from kelpline.plans.catalogue import AROUSAL, LABELS, OBS, observations, query, rounded, table


@query(f"WITH {OBS} SELECT label, count(*) AS n FROM o WHERE present GROUP BY label")
def activity_budget(spark, d):
    return B.budget(observations(spark, d).where("present"), "label")


@query(f"""WITH {OBS}, p AS (SELECT * FROM o WHERE present)
SELECT 'posture' AS field, posture AS value, count(*) AS n FROM p GROUP BY posture UNION ALL SELECT 'activity', activity, count(*) FROM p GROUP BY activity
UNION ALL SELECT 'context', context, count(*) FROM p GROUP BY context""")
def field_distributions(spark, d):
    return B.distributions(observations(spark, d).where("present"), ["posture", "activity", "context"])


@query(f"""WITH {OBS} SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS "all", count(*) FILTER (present) AS present,
round(count(*) FILTER (present) / count(*)::DOUBLE, 6) AS present_rate, round(avg({AROUSAL}) FILTER (present), 6) AS mean_arousal FROM o GROUP BY 1 HAVING count(*) >= 5""")
def circadian_profile(spark, d):
    out = B.circadian(observations(spark, d), F.hour("ts"), F.col("present"), arousal(F.col("activity"), F.col("posture")))
    return rounded(out, "present_rate", "mean_arousal")


@query(f"""WITH {OBS}, p AS (SELECT *, {AROUSAL} AS a FROM o WHERE present),
c AS (SELECT context, label, count(*) AS c FROM p GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY context ORDER BY c DESC, label) AS r FROM c),
t AS (SELECT context, string_agg(label || ':' || c, ',' ORDER BY r) AS top_labels FROM r WHERE r <= 3 GROUP BY context)
SELECT context, count(*) AS n, round(avg(value), 6) AS mean_motion, round(avg(a), 6) AS mean_arousal, any_value(top_labels) AS top_labels FROM p JOIN t USING (context) GROUP BY context""")
def stimulus_response(spark, d):
    out = B.stimulus_response(observations(spark, d).where("present"), "context", "value", arousal(F.col("activity"), F.col("posture")), "label")
    return rounded(out, "mean_motion", "mean_arousal")


@query(f"WITH {OBS} SELECT context, " + ", ".join(f"count(*) FILTER (label = '{x}') AS {x}" for x in LABELS) + " FROM o WHERE present GROUP BY context")
def colour_by_context(spark, d):
    return B.crosstab(observations(spark, d).where("present"), "context", "label", list(LABELS))


@query(f"WITH {OBS} SELECT camera, label, count(*) AS n FROM o WHERE present GROUP BY ALL")
def camera_budget(spark, d):
    return B.budget(observations(spark, d).where("present"), "camera", "label")


@query(f"""WITH {OBS}, c AS (SELECT context, label, count(*) AS n FROM o GROUP BY ALL)
SELECT context, label, n, round(n / max(n) OVER ()::DOUBLE, 6) AS bar, round(n / (sum(n) OVER (PARTITION BY context))::DOUBLE, 6) AS share FROM c""")
def dashboard_bars(spark, d):
    counts = B.budget(observations(spark, d), "context", "label")
    return rounded(B.dashboard(counts, "context", "label", "n"), "bar", "share")


@query("""SELECT o_orderkey, CASE WHEN h IS NULL THEN NULL ELSE CAST(h AS INTEGER) END AS hour FROM (SELECT o_orderkey,
((try_cast(substring(s, 1, 2) AS INTEGER) * 3600 + try_cast(substring(s, 3, 2) AS INTEGER) * 60 + try_cast(substring(s, 5, 2) AS INTEGER) + o_orderkey % 9000) // 3600) % 24 AS h
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'bad' ELSE lpad(CAST(o_orderkey % 240000 AS VARCHAR), 6, '0') END AS s FROM orders))""")
def absolute_hour(spark, d):
    segment = F.when(F.col("o_orderkey") % 7 == 0, "bad").otherwise(F.lpad((F.col("o_orderkey") % 240000).cast("string"), 6, "0"))
    return table(spark, d, "orders").select("o_orderkey", clock_hour(segment, F.col("o_orderkey") % 9000).alias("hour"))


VOTES = f"""{OBS}, p AS (SELECT clip, seq, label FROM o), v AS (SELECT * FROM p WHERE label <> 'error'),
n AS (SELECT clip, count(*) AS n_passes, count(*) FILTER (label = 'error') AS n_abstain, count(*) FILTER (label <> 'error') AS n_votes, arg_min(label, seq) AS first_label FROM p GROUP BY clip),
c AS (SELECT clip, label, count(*) AS c FROM v GROUP BY ALL),
r AS (SELECT c.*, row_number() OVER (PARTITION BY clip ORDER BY c DESC, (label = first_label) DESC, label) AS r, max(c) OVER (PARTITION BY clip) AS m FROM c JOIN n USING (clip)),
w AS (SELECT clip, max(label) FILTER (r = 1) AS label, max(c) AS top, count(*) FILTER (c = m) > 1 AS tied FROM r GROUP BY clip),
voted AS (SELECT clip, n_passes, n_abstain, n_votes, w.label, coalesce(top, 0) AS top, round(top / n_votes::DOUBLE, 3) AS margin, coalesce(tied, false) AS tied, coalesce(top = n_votes, false) AS unanimous, first_label FROM n LEFT JOIN w USING (clip))"""


def _voted(spark, d):
    return V.majority(observations(spark, d).select("clip", "seq", "label"), "clip", "label", "seq", "error")


@query(f"WITH {VOTES} SELECT * EXCLUDE (first_label) FROM voted")
def vote_by_key(spark, d):
    return _voted(spark, d)


@query(f"WITH {OBS}, c AS (SELECT clip, label, count(*) AS c FROM o GROUP BY ALL) SELECT clip, string_agg(label || ':' || c, ',' ORDER BY label) AS votes FROM c GROUP BY clip")
def votes_by_label(spark, d):
    return V.votes_by_label(observations(spark, d), "clip", "label")


@query(f"""WITH {VOTES} SELECT count(*) AS n, round(count(*) FILTER (label <> first_label) / count(*)::DOUBLE, 6) AS flip_rate,
round(count(*) FILTER (unanimous) / count(*)::DOUBLE, 6) AS unanimous_rate, round(count(*) FILTER (NOT unanimous) / count(*)::DOUBLE, 6) AS split_rate FROM voted""")
def flip_rate(spark, d):
    first = observations(spark, d).groupBy("clip").agg(F.min_by("label", "seq").alias("first_label"))
    out = V.flip_rates(_voted(spark, d).join(first, "clip"), F.col("first_label"), F.col("label"), F.col("unanimous"))
    return rounded(out, "flip_rate", "unanimous_rate", "split_rate")


@query(f"""WITH {OBS}, c AS (SELECT clip, label, count(*) AS n FROM o WHERE label <> 'error' GROUP BY ALL)
SELECT clip, """ + ", ".join(f"round(coalesce(sum(n) FILTER (label = '{x}'), 0) / sum(n)::DOUBLE, 6) AS {x}" for x in LABELS) + " FROM c GROUP BY clip")
def soft_targets(spark, d):
    counts = observations(spark, d).groupBy("clip", "label").agg(F.count("*").alias("n"))
    return rounded(V.soft_target(counts, "clip", "label", "n", list(LABELS)), *LABELS)


@query(f"""WITH {OBS}, a AS (SELECT clip, count(*) AS passes, count(*) FILTER (label = 'error') AS ab FROM o GROUP BY clip),
c AS (SELECT clip, ab, passes, count(*) FILTER (label = 'click') AS click, count(*) FILTER (label = 'view') AS "view" FROM o JOIN a USING (clip) GROUP BY ALL),
s AS (SELECT *, ab / passes::DOUBLE AS sh, click + "view" AS sp FROM c), w AS (SELECT *, sh + CASE WHEN sp > 0 THEN 1 - sh ELSE 0 END AS whole FROM s)
SELECT clip, round(sh / whole, 6) AS error, round(CASE WHEN sp > 0 THEN (1 - sh) * click / sp ELSE 0 END / whole, 6) AS click, round(CASE WHEN sp > 0 THEN (1 - sh) * "view" / sp ELSE 0 END / whole, 6) AS "view" FROM w WHERE whole > 0""")
def soft_targets_absent(spark, d):
    rows = observations(spark, d)
    totals = rows.groupBy("clip").agg(F.count("*").alias("passes"), F.count_if(F.col("label") == "error").alias("absent"))
    counts = rows.groupBy("clip", "label").agg(F.count("*").alias("n")).join(totals, "clip")
    out = V.soft_target_absent(counts, "clip", "label", "n", "error", ["error", "click", "view"], "absent", "passes")
    return rounded(out, "error", "click", "view")


@query(f"""WITH {VOTES} SELECT CASE WHEN margin >= 1.0 THEN 'margin_1.0' WHEN margin >= 0.8 THEN 'margin_0.8' WHEN margin > 0.6 THEN 'margin_0.6_0.8' ELSE 'margin_le_0.6' END AS band,
count(*) AS n, round(avg(CAST(label = first_label AS INTEGER)), 6) AS agreement FROM voted WHERE margin IS NOT NULL GROUP BY 1""")
def margin_bands(spark, d):
    first = observations(spark, d).groupBy("clip").agg(F.min_by("label", "seq").alias("first_label"))
    return rounded(V.margin_bands(_voted(spark, d).join(first, "clip"), F.col("margin"), F.col("label") == F.col("first_label")), "agreement")


@query(f"WITH {OBS} SELECT clip, bool_or(k = 7) AS deterministic, bool_and(CASE WHEN k = 5 THEN true ELSE k < 95 END) AS sampling_varies FROM o GROUP BY clip")
def pass_flags(spark, d):
    return V.pass_flags(observations(spark, d), "clip", F.when(F.col("k") != 3, F.col("k") == 7), F.when(F.col("k") != 5, F.col("k") < 95))


SCORES = """s AS (SELECT vec_id, m, c, abs(embedding[1 + m * 8 + c])::DOUBLE AS p FROM embeddings, (SELECT unnest(range(4)) AS m), (SELECT unnest(range(5)) AS c))"""


def _member_scores(spark, d):
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.struct((i % 4).alias("m"), F.floor(i / 4).cast("int").alias("c"))))
    rows = table(spark, d, "embeddings").select("vec_id", "embedding", grid.alias("g"))
    return rows.select("vec_id", F.col("g.m").alias("m"), F.col("g.c").alias("c"), F.abs(F.get("embedding", F.col("g.m") * 8 + F.col("g.c"))).cast("double").alias("p"))


@query(f"""WITH {SCORES}, a AS (SELECT vec_id, c, avg(p) AS p FROM s GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, c) AS r FROM a)
SELECT vec_id, CAST(c AS INTEGER) AS winner, round(p, 6) AS p FROM r WHERE r = 1""")
def ensemble_soft_vote(spark, d):
    return rounded(V.soft_vote(_member_scores(spark, d), "vec_id", "c", "p"), "p")


@query(f"""WITH {SCORES}, b AS (SELECT *, row_number() OVER (PARTITION BY vec_id, m ORDER BY p DESC, c) = 1 AS won FROM s),
t AS (SELECT vec_id, c, count(*) FILTER (won) AS v, sum(p) AS sp FROM b GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, sp DESC, c) AS r, sum(v) OVER (PARTITION BY vec_id) AS members FROM t)
SELECT vec_id, CAST(c AS INTEGER) AS winner, v AS votes, v = members AS unanimous FROM r WHERE r = 1""")
def ensemble_hard_vote(spark, d):
    return V.hard_vote(_member_scores(spark, d), "vec_id", "m", "c", "p")


RULED = """r AS (SELECT doc_id, CASE WHEN quality = 0 AND n_chars > 4000 THEN 'dropped_label' WHEN lang = 'de' AND toxic = 1 THEN 'unreliable_present' END AS drop_reason,
CASE WHEN lang = 'fr' AND toxic = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM documents JOIN labels USING (doc_id))"""


def _ruled(spark, d):
    rows = table(spark, d, "documents").drop("text").join(table(spark, d, "labels"), "doc_id")
    return B.directional_rules(rows, F.col("lang"), F.col("toxic") == 1, (F.col("quality") == 0) & (F.col("n_chars") > 4000), "fr", "de").select("doc_id", "drop_reason", "weight")


@query(f"WITH {RULED} SELECT * FROM r")
def directional_filter(spark, d):
    return _ruled(spark, d)


@query(f"WITH {RULED} SELECT coalesce(drop_reason, 'kept') AS reason, count(*) AS n, sum(weight) AS weight FROM r GROUP BY 1")
def drop_accounting(spark, d):
    return B.drop_accounting(_ruled(spark, d))


@query(f"""WITH {OBS}, m AS (SELECT *, quantile_cont(CASE WHEN value > 0 THEN value END, 0.5) OVER (PARTITION BY clip) AS m FROM o)
SELECT clip, seq, value FROM m WHERE value BETWEEN 3 AND 200 AND value <= m * 3""")
def area_median_filter(spark, d):
    return B.median_filter(observations(spark, d).select("clip", "seq", "value"), "clip", "value", 3, 200, 3)


@query(f"""WITH {OBS} SELECT clip, seq, CASE WHEN label = 'error' THEN 'failed' WHEN k > 60 THEN 'clips' WHEN value > 50 THEN 'scanned_empty' WHEN value > 5 THEN 'probed_empty' ELSE 'failed' END AS status FROM o""")
def ledger_status(spark, d):
    return observations(spark, d).select("clip", "seq", B.status(F.when(F.col("k") > 60, 1).otherwise(0), F.col("value") > 50, F.col("value") > 5, F.col("label") == "error").alias("status"))


