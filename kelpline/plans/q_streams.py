"""Queries: scans that keep state over streams, upserts of streams, versioned tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelpline.operators import merging as M
from kelpline.plans import streams
from kelpline.plans.catalogue import OBS, observations, query, rounded, table
from kelpline.plans.q_selection import LEDGER, ledger_sides
from kelpline.streaming import scans

#: Rows the watermark (an hour behind the last, in whole milliseconds) has passed, in sessions two days apart.
PASSED = """m AS (SELECT (max(epoch_us(ts)) // 1000 - 3600000) * 1000 AS mark, 172800000000 AS gap FROM events),
r AS (SELECT user_id AS clip, event_id AS seq, epoch_us(ts) AS t, value, mark, gap FROM events, m WHERE epoch_us(ts) <= mark),
f AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY clip ORDER BY t, seq) <= gap THEN 0 ELSE 1 END AS fresh FROM r),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY clip ORDER BY t, seq) AS session FROM f),
o AS (SELECT *, min(t) OVER (PARTITION BY clip, session) AS began, row_number() OVER (PARTITION BY clip, session ORDER BY t, seq) - 1 AS start FROM s)"""


@query(f"""WITH {PASSED} SELECT clip, began, seq, round(coalesce(abs(value - lag(value) OVER (PARTITION BY clip, session ORDER BY t, seq)), 0), 6) AS difference FROM o""")
def stream_differences(spark, d):
    out = streams.scanned(spark, d, scans.Differences(), ["value"])
    return rounded(out.select(F.col("user_id").alias("clip"), F.unix_micros("session").alias("began"), F.col("row").alias("seq"), "difference"), "difference")


@query(f"""WITH {PASSED} SELECT clip, began, round(list_reduce(list(value ORDER BY t, seq), lambda e, x: 0.45::DOUBLE * x + 0.55::DOUBLE * e), 6) AS ema, count(*) AS n FROM o GROUP BY clip, began HAVING max(t) + max(gap) <= max(mark)""")
def stream_ema(spark, d):
    """Sessions that are closed."""
    out = streams.scanned(spark, d, scans.Average(), ["value"])
    return rounded(out.select(F.col("user_id").alias("clip"), F.unix_micros("session").alias("began"), "ema", "n"), "ema")


@query(f"""WITH RECURSIVE {PASSED}, w AS (SELECT clip, began, start, avg(CASE WHEN value >= 20 THEN 1.0::DOUBLE ELSE 0 END) OVER f AS visible_frac, avg(value) OVER f AS mean_motion, count(*) OVER f AS n
FROM o WINDOW f AS (PARTITION BY clip, began ORDER BY start ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)),
q AS (SELECT * FROM w WHERE n = 10 AND visible_frac > 0.5 AND mean_motion >= 20),
g AS (SELECT clip, began, min(start) AS start FROM q GROUP BY ALL UNION ALL SELECT clip, began, x FROM (SELECT g.clip, g.began, (SELECT min(q.start) FROM q WHERE q.clip = g.clip AND q.began = g.began AND q.start >= g.start + 10) AS x FROM g) WHERE x IS NOT NULL)
SELECT clip, began, start, round(visible_frac, 6) AS visible_frac, round(mean_motion, 6) AS mean_motion FROM g JOIN q USING (clip, began, start)""")
def stream_windows(spark, d):
    out = streams.scanned(spark, d, scans.Windows(length=10, step=10, threshold=20, least_motion=20), ["value", "value"])
    return rounded(out.select(F.col("user_id").alias("clip"), F.unix_micros("session").alias("began"), "start", "visible_frac", "mean_motion"), "visible_frac", "mean_motion")


@query("""SELECT user_id, event_type, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def stream_upsert(spark, d):
    """The last event of each user and type, from six files taken one by one into a versioned table."""
    from kelpline.sources.snapshots import Table, upsert_stream
    from kelpline.streaming.signals import event_stream

    at = streams.scratch(spark)
    events = table(spark, d, "events").select("user_id", "event_type", "event_id", "ts", "value")
    events.repartition(6, "event_id").write.parquet(f"{at}/in")
    into = Table(spark, f"{at}/table", ["user_id", "event_type"], buckets=4)
    upsert_stream(event_stream(spark, f"{at}/in", events.schema), into, ["ts", "event_id"], f"{at}/state", name="events")
    return into.read()


@query(f"WITH {LEDGER} SELECT url, status, n_clips, scanned_sec FROM merged")
def ledger_versions(spark, d):
    """The ledger merge as a change of a versioned table."""
    from kelpline.sources.snapshots import Table

    old, new = ledger_sides(spark, d)
    ledger = Table(spark, f"{streams.scratch(spark)}/ledger")
    ledger.write(old)
    ledger.update(lambda rows: M.keep_better(rows, new, "url", M.status_rank(F.col("status")), ["n_clips", "scanned_sec"]).drop("outcome"))
    return ledger.read()


@query("""SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, 'cam' || (user_id % 4) AS camera, 1 AS files, true AS filled FROM events WHERE CAST(ts AS DATE) BETWEEN '2024-01-05' AND '2024-01-20' GROUP BY ALL""")
def listed_clips(spark, d):
    """Files of a tree by date and camera, listed in parallel within a range of dates."""
    from kelpline.sources.datasource import clip_listing

    root = streams.scratch(spark)
    rows = table(spark, d, "events").select(F.to_date("ts").cast("string").alias("date"), F.concat(F.lit("cam"), F.col("user_id") % 4).alias("camera"), "event_id", "value")
    rows.repartition("date", "camera").write.partitionBy("date", "camera").parquet(root)
    files = clip_listing(spark, root, dates=4).where("date >= '2024-01-05' AND date <= '2024-01-20'")
    return files.groupBy("date", "camera").agg(F.count("*").cast("int").alias("files"), (F.min("bytes") > 0).alias("filled"))


@query("""WITH e AS (SELECT vec_id // 20 AS video, row_number() OVER (PARTITION BY vec_id // 20 ORDER BY vec_id) - 1 AS frame, embedding FROM embeddings)
SELECT CAST(video AS BIGINT) AS video, CAST(frame AS INTEGER) AS frame, round(frame / 10.0::DOUBLE, 6) AS t, len(embedding)::INTEGER AS dims, round(list_avg(embedding::DOUBLE[]), 5) AS mean FROM e WHERE frame % 2 = 0""")
def sampled_frames(spark, d):
    """Stacks of ten frames a second, sampled at five by a lateral join with the table function."""
    from kelpline.sources import datasource

    datasource.register(spark)
    clips = datasource.stacks(table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 20).alias("video"), "vec_id", "embedding"), "video", "vec_id", "embedding")
    found = spark.sql("SELECT video, f.frame, f.t, f.shape, f.pixels FROM {clips}, LATERAL frames(content, 10.0D, 5.0D) f", clips=clips)
    mean = F.aggregate("pixels", F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size("pixels")
    return found.select("video", "frame", F.round("t", 6).alias("t"), F.col("shape")[0].alias("dims"), F.round(mean, 5).alias("mean"))


@query(f"""WITH RECURSIVE {OBS}, t AS (SELECT clip, seq // 50 AS track, min(seq) // 25 AS first, max(seq) // 25 AS last, arg_min(value, seq) AS x0, arg_min(k, seq)::DOUBLE AS y0, arg_max(value, seq) AS x1, arg_max(k, seq)::DOUBLE AS y1 FROM o GROUP BY clip, seq // 50),
p AS (SELECT a.clip, a.track AS a, b.track AS b, sqrt((b.x0 - a.x1) * (b.x0 - a.x1) + (b.y0 - a.y1) * (b.y0 - a.y1)) AS d, b.first - a.last AS gap FROM t a JOIN t b ON a.clip = b.clip AND a.track <> b.track AND b.first - a.last BETWEEN 1 AND 8),
r AS (SELECT DISTINCT clip, []::BIGINT[] AS ua, []::BIGINT[] AS ub, NULL::STRUCT(d DOUBLE, a BIGINT, b BIGINT) AS m FROM p
UNION ALL SELECT clip, list_append(ua, m.a), list_append(ub, m.b), m FROM (SELECT r.clip, r.ua, r.ub, min({{'d': p.d, 'a': p.a::BIGINT, 'b': p.b::BIGINT}}) AS m FROM r JOIN p ON p.clip = r.clip WHERE d <= 6 * gap AND NOT list_contains(ua, p.a) AND NOT list_contains(ub, p.b) GROUP BY r.clip, r.ua, r.ub))
SELECT clip, m.a AS track, m.b AS next, round(m.d, 5) AS cost FROM r WHERE m IS NOT NULL""")
def stream_tracklets(spark, d):
    """Links of tracklets that come as a stream; a row far ahead closes the last gaps."""
    from kelpline.streaming.signals import event_stream

    at = streams.scratch(spark)
    rows = observations(spark, d).groupBy("clip", F.floor(F.col("seq") / 50).alias("track")).agg(
        (F.floor(F.min("seq") / 25) + 1).alias("first"), (F.floor(F.max("seq") / 25) + 1).alias("last"),
        F.min_by("value", "seq").alias("x0"), F.min_by(F.col("k").cast("double"), "seq").alias("y0"), F.max_by("value", "seq").alias("x1"), F.max_by(F.col("k").cast("double"), "seq").alias("y1"),
    )
    ahead = rows.agg((F.max("last") + 1000).alias("first")).select(F.lit(-1).cast("long").alias("clip"), F.lit(-1).cast("long").alias("track"), "first", F.col("first").alias("last"), *[F.lit(0.0).alias(c) for c in ("x0", "y0", "x1", "y1")])
    rows = rows.unionByName(ahead).withColumn("ts", F.timestamp_seconds("first"))
    rows.write.parquet(f"{at}/in")
    with scans.state_store(spark):
        links = scans.track_links(event_stream(spark, f"{at}/in", rows.schema, files_per_trigger=1000), "clip", "ts", radius=6.0, late="30 seconds")
        out = streams.signals.run_to_end(links, f"{at}/out", f"{at}/state")
    return rounded(out, "cost", places=5)
