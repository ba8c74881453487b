"""Queries: captions, names, links and other texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelpline.functions import scalars as C
from kelpline.plans.catalogue import OBS, observations, query, table
from kelpline.sources.files import candidates, links

_REJECT = C.reject_pattern("the").replace("'", "''")


@query("""SELECT page_id, len(h) AS n_links, array_to_string(list_slice(h, 1, 3), ' ') AS first_links FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"?][^"]*)"', 1) AS h FROM pages)""")
def href_links(spark, d):
    found = table(spark, d, "pages").select("page_id", links(F.col("html")).alias("h"))
    return found.select("page_id", F.size("h").cast("long").alias("n_links"), F.array_join(F.slice("h", 1, 3), " ").alias("first_links"))


_URL = r"^https?://([^/]+)/([a-z]{2})/([0-9]+)"


@query(f"""SELECT page_id, CASE WHEN regexp_matches(url, '{_URL}') THEN regexp_extract(url, '{_URL}', 1) END AS host, CASE WHEN regexp_matches(url, '{_URL}') THEN regexp_extract(url, '{_URL}', 2) END AS lang,
try_cast(CASE WHEN regexp_matches(url, '{_URL}') THEN regexp_extract(url, '{_URL}', 3) END AS INTEGER) AS number FROM pages""")
def parse_names(spark, d):
    part = lambda i: C.capture(F.col("url"), _URL, i)
    return table(spark, d, "pages").select("page_id", part(1).alias("host"), part(2).alias("lang"), part(3).try_cast("int").alias("number"))


@query("""SELECT page_id, array_to_string(list_slice(string_split(regexp_replace(url, '^/+|/+$', '', 'g'), '/'), greatest(len(string_split(regexp_replace(url, '^/+|/+$', '', 'g'), '/')) - 2, 1), len(string_split(regexp_replace(url, '^/+|/+$', '', 'g'), '/'))), '/') AS tail,
array_to_string(list_slice(string_split(url, '/'), 1, 2), '/') AS source,
CASE WHEN len(string_split(regexp_replace(url, '^/+|/+$', '', 'g'), '/')) >= 3 THEN string_split(regexp_replace(url, '^/+|/+$', '', 'g'), '/')[-3] || '/' || string_split(regexp_replace(url, '^/+|/+$', '', 'g'), '/')[-2] END AS folder FROM pages""")
def path_keys(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", C.path_tail(url).alias("tail"), C.source_of_key(url).alias("source"), C.source_of_path(url).alias("folder"))


@query(f"""WITH {OBS} SELECT clip, seq, lpad(CAST(seq // 60 % 100 AS VARCHAR), 2, '0') || ':' || lpad(CAST(seq % 60 AS VARCHAR), 2, '0') || '-' || lpad(CAST((seq % 6000 + 20) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST((seq % 6000 + 20) % 60 AS VARCHAR), 2, '0') AS timeline FROM o""")
def clip_timeline(spark, d):
    start = F.col("seq") % 6000
    return observations(spark, d).select("clip", "seq", C.timeline(start, start + 20).alias("timeline"))


@query("SELECT conv_id, turn, CASE WHEN length(trim(text)) > 0 THEN substr(sha256(text), 1, 16) END AS digest FROM conversations")
def short_digests(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.when(F.length(F.trim("text")) > 0, C.short_digest(F.col("text"))).alias("digest"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'seen ' || role WHEN turn % 3 = 1 THEN 'uncertain' ELSE role END AS caption, r AS picked FROM (SELECT *, coalesce(
CASE WHEN lower(a) NOT IN ('uncertain', 'unknown', '') AND NOT contains(lower(a), 'not present') THEN a END, CASE WHEN NOT contains(lower(b), 'not present') AND b <> '' THEN b END) AS r FROM (SELECT *,
trim(CASE WHEN turn % 3 = 0 THEN 'seen ' || role WHEN turn % 3 = 1 THEN 'uncertain' ELSE role END) AS a, CASE WHEN turn % 2 = 0 THEN 'fallback ' || conv_id ELSE 'animal not present' END AS b FROM conversations))""")
def caption_pick(spark, d):
    a = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("seen "), "role")).when(F.col("turn") % 3 == 1, "uncertain").otherwise(F.col("role"))
    b = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Caption: fallback "), F.col("conv_id").cast("string"))).otherwise("animal not present")
    picked = F.coalesce(C.usable_caption(a, "animal"), C.usable_caption(b, "animal"))
    return table(spark, d, "conversations").select("conv_id", "turn", a.alias("caption"), picked.alias("picked"))


@query(f"SELECT doc_id, regexp_matches(text, '{_REJECT}') AS rejected, NOT (contains(lower(text), 'not present') OR contains(lower(text), 'not visible')) AND text <> '' AS present FROM documents")
def reject_filter(spark, d):
    return table(spark, d, "documents").select("doc_id", F.col("text").rlike(C.reject_pattern("the")).alias("rejected"), C.present_by_text(F.col("text")).alias("present"))


@query("""SELECT conv_id, turn, 'said by ' || role AS caption, CASE WHEN turn % 2 = 0 THEN 'view' ELSE 'click' END AS label FROM conversations""")
def parse_reply(spark, d):
    """Replies made of lines, quoted and repeated; the last line of a label counts."""
    reply = F.concat(F.lit("noise\nCAPTION: first\n ethogram: '"), F.when(F.col("turn") % 2 == 0, "view").otherwise("click"), F.lit("'\ncaption:  \"said by "), F.col("role"), F.lit('"\n'))
    return table(spark, d, "conversations").select("conv_id", "turn", C.labelled_line(reply, "CAPTION").alias("caption"), C.labelled_line(reply, "ETHOGRAM").alias("label"))


@query("""SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN 'economy' WHEN lower(trim(p_type)) IN ('economy', 'promo', 'standard') THEN lower(trim(p_type)) ELSE 'uncertain' END AS kind FROM part""")
def snap_labels(spark, d):
    return table(spark, d, "part").select("p_partkey", C.snap(F.col("p_type"), ["economy", "promo", "standard", "uncertain"], "uncertain").alias("kind"))


@query(f"WITH {OBS} SELECT clip, seq, k, k * 2 AS twice FROM o")
def json_reply(spark, d):
    rows = observations(spark, d)
    text = F.concat(F.lit("```json\n{\"k\": "), F.col("k").cast("string"), F.lit(", \"twice\": "), (F.col("k") * 2).cast("string"), F.lit("}\n``` ok"))
    return rows.select("clip", "seq", F.from_json(C.json_body(text), "k int, twice int").alias("r")).select("clip", "seq", "r.k", "r.twice")


@query("""WITH m AS (SELECT * FROM (VALUES ('Stationary in open', 'Resting'), ('Crawling', 'Moving'), ('Arm walking', 'Moving')) t(old, new)), e AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Crawling' WHEN 1 THEN 'Arm walking' WHEN 2 THEN 'Stationary in open' ELSE 'Other' END AS old FROM documents)
SELECT doc_id, coalesce(new, old) AS label FROM e LEFT JOIN m USING (old)""")
def class_remap(spark, d):
    sheet = spark.createDataFrame([("Resting", ["Stationary in open"]), ("Moving", ["Crawling", "Arm walking"])], "new string, maps_from array<string>").select("new", F.explode("maps_from").alias("old"))
    names = F.array(*[F.lit(x) for x in ("Crawling", "Arm walking", "Stationary in open", "Other")])
    rows = table(spark, d, "documents").select("doc_id", F.get(names, (F.col("doc_id") % 4).cast("int")).alias("old"))
    return rows.join(sheet, "old", "left").select("doc_id", F.coalesce("new", "old").alias("label"))


@query("""SELECT d, n_nationkey AS camera FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events), nation""")
def candidate_listing(spark, d):
    dates = table(spark, d, "events").select(F.col("ts").cast("date").alias("d")).distinct()
    return candidates(dates, table(spark, d, "nation").select(F.col("n_nationkey").alias("camera")))


@query("SELECT count(*) AS files, sum(length(html)) AS chars, sum(length(html)) * 1.15::DOUBLE <= 1e12 AS fits FROM pages")
def release_inventory(spark, d):
    return table(spark, d, "pages").agg(F.count("*").alias("files"), F.sum(F.length("html")).alias("chars"), (F.sum(F.length("html")) * 1.15 <= 1e12).alias("fits"))


@query("SELECT source, count(*) AS n, count(*) FILTER (hit) AS found FROM (SELECT source, EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id) AS hit FROM documents) GROUP BY source")
def seen_unseen(spark, d):
    seen = table(spark, d, "labels").select("doc_id").distinct().withColumn("hit", F.lit(True))
    rows = table(spark, d, "documents").select("doc_id", "source").join(seen, "doc_id", "left")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count("hit").alias("found"))
