"""Queries: keyed joins, predicates and the views behind the review applications."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelpline.functions import scalars as C
from kelpline.operators import joins as J
from kelpline.operators import review as R
from kelpline.plans.catalogue import OBS, observations, query, table

# Orders stand for the clip index: a customer is the clip, the order's key the time it was written.
_INDEX = """ix AS (SELECT o_custkey AS clip, arg_max(CASE WHEN o_orderkey % 7 = 0 THEN 'bad' ELSE lpad(CAST(o_orderkey % 240000 AS VARCHAR), 6, '0') END, o_orderkey) AS seg, arg_max(o_orderkey % 9000, o_orderkey) AS start FROM orders GROUP BY o_custkey)"""


@query(f"""WITH {OBS}, {_INDEX} SELECT o.clip, seq, CAST(((try_cast(substring(seg, 1, 2) AS INTEGER) * 3600 + try_cast(substring(seg, 3, 2) AS INTEGER) * 60 + try_cast(substring(seg, 5, 2) AS INTEGER) + start) // 3600) % 24 AS INTEGER) AS hour FROM o LEFT JOIN ix USING (clip)""")
def record_hours(spark, d):
    key = F.col("o_orderkey")
    index = table(spark, d, "orders").select(F.col("o_custkey").alias("clip"), key.alias("at"), F.when(key % 7 == 0, "bad").otherwise(F.lpad((key % 240000).cast("string"), 6, "0")).alias("segment"), (key % 9000).alias("start"))
    return J.with_clock(observations(spark, d).select("clip", "seq"), index, "clip", "at", "segment", "start").select("clip", "seq", "hour")


@query("""WITH f AS (SELECT DISTINCT regexp_replace(url, '^https?://', '') AS u FROM pages WHERE page_id IN (SELECT doc_id FROM labels)), t AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS u FROM pages)
SELECT page_id FROM t WHERE array_to_string(list_slice(string_split(trim(u, '/'), '/'), -3, -1), '/') IN (SELECT array_to_string(list_slice(string_split(trim(u, '/'), '/'), -3, -1), '/') FROM f)""")
def index_on_disk(spark, d):
    """Files are the urls of labelled pages."""
    pages = table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("u"))
    files = pages.join(table(spark, d, "labels").select(F.col("doc_id").alias("page_id")), "page_id", "left_semi").select(F.col("u").alias("path"))
    return J.on_disk(pages, files, "u", "path").select("page_id")


@query("SELECT l_orderkey, l_linenumber, p_retailprice AS mean_motion FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_retailprice > 1000")
def motion_lookup(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("key"))
    motion = table(spark, d, "part").where("p_retailprice > 1000").select(F.col("p_partkey").alias("key"), F.col("p_retailprice").alias("mean_motion"))
    return J.looked_up(rows, motion, "key", ["mean_motion"]).select("l_orderkey", "l_linenumber", "mean_motion")


_HUMAN = "hu AS (SELECT doc_id AS clip, quality = 0 AS skipped, toxic AS human FROM labels)"


def _human(spark, d):
    return table(spark, d, "labels").select(F.col("doc_id").alias("clip"), (F.col("quality") == 0).alias("skipped"), F.col("toxic").alias("human"))


@query(f"WITH {_HUMAN} SELECT clip, human, source FROM hu JOIN documents ON clip = doc_id WHERE NOT coalesce(skipped, false)")
def labelled_sample(spark, d):
    sample = table(spark, d, "documents").select(F.col("doc_id").alias("clip"), "source")
    return J.labelled(_human(spark, d), sample, "clip").select("clip", "human", "source")


_MANIFEST = "ma AS (SELECT doc_id AS clip, lang, CASE lang WHEN 'en' THEN 'train' WHEN 'de' THEN 'val' ELSE 'test' END AS split FROM documents)"


def _manifest(spark, d):
    split = F.when(F.col("lang") == "en", "train").when(F.col("lang") == "de", "val").otherwise("test")
    return table(spark, d, "documents").select(F.col("doc_id").alias("clip"), "lang", split.alias("split"))


@query(f"WITH {_HUMAN}, {_MANIFEST} SELECT CASE WHEN split = 'train' THEN 'train_CONTAMINATED' ELSE split END AS population, count(*) AS n, round(avg(human), 6) AS rate FROM hu JOIN ma USING (clip) GROUP BY 1")
def human_by_population(spark, d):
    rows = J.by_population(_human(spark, d), _manifest(spark, d), "clip")
    return rows.groupBy("population").agg(F.count("*").alias("n"), F.round(F.avg("human"), 6).alias("rate"))


@query(f"WITH {_HUMAN}, {_MANIFEST} SELECT clip, lang, human AS label, 'human_secondary' AS split FROM ma JOIN hu USING (clip)")
def human_secondary(spark, d):
    manifest = _manifest(spark, d).withColumn("label", F.lit(-1))
    return J.secondary(manifest, _human(spark, d).select("clip", F.col("human").alias("label")), "clip", "label")


_VERSIONS = """v1 AS (SELECT conv_id AS clip, arg_min(text, turn) AS v1 FROM conversations GROUP BY conv_id), v2 AS (SELECT conv_id AS clip, arg_max(text, turn) AS v2 FROM conversations GROUP BY conv_id HAVING count(*) > 2),
pr AS (SELECT clip, v1, v2 FROM v1 JOIN v2 USING (clip) WHERE clip IN (SELECT page_id FROM pages))"""


def _pairs(spark, d):
    turns = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("clip")).agg(F.min_by("text", "turn").alias("a"), F.max_by("text", "turn").alias("b"), F.count("*").alias("n"))
    first, second = turns.select("clip", F.col("a").alias("caption")), turns.where("n > 2").select("clip", F.col("b").alias("caption"))
    return J.paired_versions(first, second, "clip", "caption", table(spark, d, "pages").select(F.col("page_id").alias("clip")))


@query(f"WITH {_VERSIONS} SELECT * FROM pr")
def caption_versions(spark, d):
    return _pairs(spark, d)


_PARITY = "('0x' || substr(md5(CAST(clip AS VARCHAR)), 25, 8))::BIGINT % 2 = 0"


@query(f"WITH {_VERSIONS} SELECT clip, CASE WHEN {_PARITY} THEN v1 ELSE v2 END AS a, CASE WHEN {_PARITY} THEN v2 ELSE v1 END AS b, CASE WHEN {_PARITY} THEN 'v1' ELSE 'v2' END AS _a_is FROM pr")
def blind_pairs(spark, d):
    return R.blind_pairs(_pairs(spark, d), "clip")


@query(f"WITH {_VERSIONS}, de AS (SELECT conv_id AS clip, turn, ' ' || text || ' ' AS caption FROM conversations) SELECT clip, turn, CASE WHEN trim(caption) = trim(v1) THEN 'v1' WHEN trim(caption) = trim(v2) THEN 'v2' ELSE 'human' END AS source FROM de JOIN pr USING (clip)")
def decided_sources(spark, d):
    decisions = table(spark, d, "conversations").select(F.col("conv_id").alias("clip"), "turn", F.concat(F.lit(" "), "text", F.lit(" ")).alias("caption"))
    return R.decided_source(decisions, _pairs(spark, d), "clip", "caption").select("clip", "turn", "source")


@query("SELECT o_orderkey, coalesce(x, CAST(o_totalprice AS DOUBLE)) AS kinematics FROM orders LEFT JOIN (SELECT l_orderkey, CAST(sum(l_quantity) AS DOUBLE) AS x FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey")
def merged_kinematics(spark, d):
    records = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("kinematics"))
    new = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").cast("double").alias("kinematics"))
    return J.updated(records, new, "o_orderkey", "kinematics")


@query("""WITH a AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
SELECT 'a' AS arm, k, n FROM a WHERE k IN (SELECT k FROM b) UNION ALL SELECT 'b', k, n FROM b WHERE k IN (SELECT k FROM a)""")
def both_arms(spark, d):
    arms = [table(spark, d, "lineitem").where(F.col("l_returnflag") == x).groupBy(F.col("l_partkey").alias("k")).agg(F.count("*").alias("n")) for x in "RA"]
    a, b = J.in_all_arms(arms, "k")
    return a.select(F.lit("a").alias("arm"), "k", "n").unionByName(b.select(F.lit("b").alias("arm"), "k", "n"))


@query("""WITH s AS (SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS d, strftime(ts, '%H%M') AS m, event_type FROM events) SELECT event_id FROM s WHERE (d, m) NOT IN (SELECT d, m FROM s WHERE event_type = 'purchase')""")
def outside_train_sessions(spark, d):
    rows = table(spark, d, "events").select("event_id", F.col("ts").cast("date").alias("d"), F.date_format("ts", "HH:mm:ss").alias("segment"), "event_type")
    return J.outside_sessions(rows, rows.where("event_type = 'purchase'"), "d", "segment").select("event_id")


@query(f"""WITH {OBS}, l AS (SELECT clip, label, count(*) AS n, min(seq) AS f FROM o GROUP BY ALL), t AS (SELECT clip, arg_max(label, seq) AS truth FROM o GROUP BY clip), te AS (SELECT clip, arg_min(label, seq) AS teacher FROM o GROUP BY clip),
st AS (SELECT clip, arg_max(label, seq) AS student FROM o WHERE present GROUP BY clip) SELECT clip, truth, teacher, student FROM t JOIN te USING (clip) JOIN st USING (clip)""")
def three_raters(spark, d):
    o = observations(spark, d)
    last = lambda df: df.groupBy("clip").agg(F.max_by("label", "seq").alias("label"))
    return J.three_raters(last(o), o.groupBy("clip").agg(F.min_by("label", "seq").alias("label")), last(o.where("present")), "clip", "label")


@query("""WITH a AS (SELECT DISTINCT source, CASE WHEN toxic = 1 THEN 'test' END AS s FROM documents JOIN labels USING (doc_id) WHERE toxic = 1), b AS (SELECT DISTINCT source, 'train' AS s FROM documents) SELECT source, coalesce(a.s, b.s) AS side FROM a FULL JOIN b USING (source)""")
def two_corpus_sides(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    clips = docs.join(table(spark, d, "labels").where("toxic = 1"), "doc_id").select("source", F.lit("test").alias("side"))
    return J.forced_sides(clips, docs.select("source", F.lit("train").alias("side")), "source", "side")


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS d, count(*) AS n FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY 1")
def date_range(spark, d):
    """A range of days is the feature: inclusive at both ends."""
    day = F.col("ts").cast("date")
    return table(spark, d, "events").where(J.between_dates(day, "2024-01-05", "2024-01-20")).groupBy(day.cast("string").alias("d")).agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT doc_id, CASE lang WHEN 'en' THEN NULL WHEN 'de' THEN 'auto' ELSE 'human' END AS src, CASE WHEN n_chars > 500 THEN doc_id END AS image FROM documents) SELECT doc_id FROM m WHERE coalesce(src, 'human') = 'human' AND image IS NOT NULL""")
def manifest_rows(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("lang") == "de", "auto").when(F.col("lang") != "en", "human").alias("src"), F.when(F.col("n_chars") > 500, F.col("doc_id")).alias("image"))
    return rows.where(J.from_source(F.col("src"), "human", F.col("image"))).select("doc_id")


@query(f"WITH {_HUMAN} SELECT clip FROM hu WHERE NOT coalesce(CASE WHEN human = 1 THEN NULL ELSE skipped END, false)")
def not_skipped(spark, d):
    rows = _human(spark, d).withColumn("skipped", F.when(F.col("human") == 1, F.lit(None)).otherwise(F.col("skipped")))
    return rows.where(J.not_skipped(F.col("skipped"))).select("clip")


@query(f"WITH {OBS} SELECT clip, count(*) AS frames FROM o GROUP BY clip HAVING count(*) >= 37")
def whole_clips(spark, d):
    return J.whole_clips(observations(spark, d).groupBy("clip").agg(F.count("*").alias("frames")), "frames")


@query("SELECT page_id, CASE WHEN contains(url, 'example.com') THEN 'example.com' WHEN contains(url, 'example') THEN 'example' WHEN contains(url, 'http') THEN 'http' END AS camera FROM pages")
def camera_names(spark, d):
    return table(spark, d, "pages").select("page_id", J.camera_of(F.col("url"), ["example.com", "example", "http"]).alias("camera"))


@query(f"WITH {OBS}, c AS (SELECT clip, count(DISTINCT label) AS n, bool_or(k > 90) AS voted FROM o GROUP BY clip) SELECT clip FROM c WHERE n = 5 AND voted")
def well_voted(spark, d):
    rows = observations(spark, d).groupBy("clip").agg(F.count_distinct("label").alias("n"), F.bool_or(F.col("k") > 90).alias("voted"))
    return rows.where(J.well_voted(F.col("n"), F.col("voted"))).select("clip")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def label_queue(spark, d):
    sample = table(spark, d, "documents").select("doc_id", "lang", F.col("source").alias("_source"))
    return R.blind_queue(sample, table(spark, d, "labels"), "doc_id")


@query(f"WITH {OBS}, l AS (SELECT clip, k, arg_max(label, seq) AS label FROM o GROUP BY ALL) SELECT label AS decision, count(*) AS n FROM l WHERE label <> 'error' GROUP BY 1")
def review_counts(spark, d):
    decision = F.when(F.col("label") == "error", "clear").otherwise(F.col("label"))
    rows = observations(spark, d).select(F.struct("clip", "k").alias("key"), "seq", decision.alias("decision"))
    return R.decision_counts(rows, "key", "seq", "decision")


@query(f"WITH {OBS}, l AS (SELECT clip, arg_max(label, seq) AS label FROM o GROUP BY clip) SELECT clip, label, c_mktsegment FROM l LEFT JOIN customer ON c_custkey = clip WHERE label <> 'error'")
def decided_items(spark, d):
    rows = observations(spark, d).select("clip", "seq", F.when(F.col("label") == "error", "clear").otherwise(F.col("label")).alias("label"))
    items = table(spark, d, "customer").select(F.col("c_custkey").alias("clip"), "c_mktsegment")
    return R.decided_items(rows, items, "clip", "seq", "label").select("clip", "label", "c_mktsegment")


@query("SELECT coalesce(CASE WHEN lang <> 'fr' THEN lang END, 'human') AS source, count(*) AS n, count(DISTINCT source) AS videos, count(*) FILTER (n_chars < 40) AS corrupt FROM documents GROUP BY 1")
def labeller_state(spark, d):
    rows = table(spark, d, "documents").select(F.when(F.col("lang") != "fr", F.col("lang")).alias("lang"), F.col("source").alias("video"), "n_chars")
    return R.labeller_state(rows, "lang", "video", F.col("n_chars") < 40)


@query(f"""WITH {OBS}, r AS (SELECT clip, seq, present, row_number() OVER (PARTITION BY clip ORDER BY seq) - 1 AS place, count(*) OVER (PARTITION BY clip) AS n FROM o)
SELECT clip, seq, 1 AS label FROM r WHERE k IS NULL OR present UNION ALL SELECT clip, seq, 0 FROM r WHERE NOT present AND (n <= 5 OR place IN (0, floor((n - 1) / 4.0::DOUBLE), floor(2 * (n - 1) / 4.0::DOUBLE), floor(3 * (n - 1) / 4.0::DOUBLE), n - 1))""".replace("k IS NULL OR ", ""))
def negative_frames(spark, d):
    o = observations(spark, d).select("clip", "seq", "present")
    return R.negatives(o.where("present"), o.select("clip", "seq"), "clip", "seq", 5)


_WANTED = "w AS (SELECT doc_id AS name FROM documents), fi AS (SELECT page_id AS name, octet_length(encode(html)) AS bytes FROM pages)"


def _plan(spark, d):
    wanted = table(spark, d, "documents").select(F.col("doc_id").alias("name"))
    return R.release_plan(wanted, table(spark, d, "pages").select(F.col("page_id").alias("name"), F.octet_length("html").cast("long").alias("bytes")), "name", "bytes", 10**12)


@query(f"WITH {_WANTED} SELECT count(bytes) AS files, count(*) FILTER (bytes IS NULL) AS missing, coalesce(sum(bytes), 0) AS bytes, coalesce(sum(bytes), 0) * 1.15::DOUBLE <= 1e12 AS fits FROM w LEFT JOIN fi USING (name)")
def release_plan(spark, d):
    return _plan(spark, d)[0]


@query(f"WITH {_WANTED} SELECT name FROM w WHERE name NOT IN (SELECT name FROM fi)")
def release_missing(spark, d):
    return _plan(spark, d)[1]


@query("""WITH f AS (SELECT lang AS model, doc_id AS path, octet_length(encode(text)) AS n, sha256(text) AS sha FROM documents), m AS (SELECT lang AS model, round(avg(toxic), 6) AS score FROM documents JOIN labels USING (doc_id) GROUP BY 1)
SELECT model, count(*) AS files, CAST(sum(n) AS BIGINT) AS bytes, substr(sha256(string_agg(sha, '' ORDER BY path)), 1, 16) AS digest, any_value(score) AS score FROM f LEFT JOIN m USING (model) GROUP BY model""")
def model_cards(spark, d):
    docs = table(spark, d, "documents")
    metrics = docs.join(table(spark, d, "labels"), "doc_id").groupBy(F.col("lang").alias("model")).agg(F.round(F.avg("toxic"), 6).alias("score"))
    return R.model_manifest(docs.select(F.col("lang").alias("model"), F.col("doc_id").alias("path"), F.col("text").cast("binary").alias("content")), "model", "path", "content", metrics)


@query("SELECT source, CAST(NULL AS BIGINT) AS page_id, count(*) AS n FROM documents GROUP BY source UNION ALL SELECT NULL, page_id, 1 FROM pages")
def concatenated(spark, d):
    docs = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return R.concatenated([docs, table(spark, d, "pages").select(F.col("page_id").cast("long").alias("page_id"), F.lit(1).cast("long").alias("n"))])


@query("SELECT (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT ALL SELECT doc_id FROM documents)) AS labels_beyond, (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels)) AS documents_beyond")
def containment(spark, d):
    a, b = table(spark, d, "labels").select("doc_id"), table(spark, d, "documents").select("doc_id")
    return R.contained(a, b).agg(F.count("*").alias("labels_beyond")).crossJoin(R.contained(b, a).agg(F.count("*").alias("documents_beyond")))  # one row each


@query("SELECT DISTINCT k FROM (SELECT o_custkey AS k FROM orders UNION ALL SELECT user_id FROM events UNION ALL SELECT conv_id FROM conversations)")
def keys_of_passes(spark, d):
    from kelpline.operators.merging import union_keys

    parts = [table(spark, d, t).select(F.col(c).alias("k")) for t, c in (("orders", "o_custkey"), ("events", "user_id"), ("conversations", "conv_id"))]
    return union_keys(parts, "k")


@query("""SELECT page_id, length(u) - length(replace(u, '%', '')) > 0 AS coded, d FROM (SELECT page_id, replace(url, '/', '%2F') AS u, url_decode(replace(url, '/', '%2F')) AS d FROM pages)""")
def decoded_urls(spark, d):
    coded = F.replace(F.col("url"), F.lit("/"), F.lit("%2F"))
    return table(spark, d, "pages").select("page_id", F.contains(coded, F.lit("%")).alias("coded"), C.decoded(coded).alias("d"))


@query("""WITH m AS (SELECT o_custkey AS image, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 97 END AS seed_frame, CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END AS k, o_orderkey AS o FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY k DESC, o DESC) AS r FROM m) WHERE r = 1) SELECT c_custkey AS image, CAST(seed_frame AS BIGINT) AS seed_frame FROM customer LEFT JOIN l ON image = c_custkey""")
def seed_frames(spark, d):
    """Frames and their images' last rows of two manifests: urgent orders, then those of low priority."""
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("image"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderkey") % 97).alias("seed_frame"), "o_orderkey", "o_orderpriority")
    manifests = [(rows.where(F.col("o_orderpriority") == p), "o_orderkey") for p in ("1-URGENT", "5-LOW")]
    return J.seed_frames(table(spark, d, "customer").select(F.col("c_custkey").alias("image")), manifests, "image", "seed_frame")
