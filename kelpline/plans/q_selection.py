"""Queries: merges, deduplication, splits, draws and governance."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelpline.operators import merging as M
from kelpline.operators import sampling as S
from kelpline.plans.catalogue import OBS, observations, query, rounded, table

LEDGER = """src AS (SELECT o_orderkey, o_custkey AS url, CASE o_orderpriority WHEN '1-URGENT' THEN 'clips' WHEN '2-HIGH' THEN 'scanned_empty' WHEN '3-MEDIUM' THEN 'probed_empty' WHEN '5-LOW' THEN 'failed' ELSE 'odd' END AS status,
CAST(o_orderkey % 5 AS INTEGER) AS n_clips, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 900 AS INTEGER) END AS scanned_sec FROM orders),
pick AS (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS old FROM src),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url, old ORDER BY o_orderkey) AS r FROM pick) WHERE r = 1),
ranked AS (SELECT *, CASE status WHEN 'clips' THEN 3 WHEN 'scanned_empty' THEN 2 WHEN 'probed_empty' THEN 1 WHEN 'failed' THEN 0 ELSE -1 END AS rk FROM one),
best AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY rk DESC, coalesce(n_clips, 0) DESC, coalesce(scanned_sec, 0) DESC, old DESC) AS b, max(old) OVER (PARTITION BY url) AS had FROM ranked),
merged AS (SELECT url, status, n_clips, scanned_sec, CASE WHEN had = 0 THEN 'added' WHEN old = 0 THEN 'updated' ELSE 'unchanged' END AS outcome FROM best WHERE b = 1)"""


def ledger_sides(spark, d):
    """The ledger's rows and those that come in, one a url each."""
    key = F.col("o_orderkey")
    names = {"1-URGENT": "clips", "2-HIGH": "scanned_empty", "3-MEDIUM": "probed_empty", "5-LOW": "failed"}
    status = F.lit("odd")
    for k, v in names.items():
        status = F.when(F.col("o_orderpriority") == k, v).otherwise(status)
    rows = table(spark, d, "orders")
    rows = rows.select(key, F.col("o_custkey").alias("url"), status.alias("status"), (key % 5).cast("int").alias("n_clips"), F.when(key % 3 != 0, (key % 900).cast("int")).alias("scanned_sec"), (key % 2 == 0).alias("old"))
    one = M.first_seen(rows, ["url", "old"], ["o_orderkey"]).drop("o_orderkey")
    return one.where("old").drop("old"), one.where("NOT old").drop("old")


def _merged(spark, d):
    old, new = ledger_sides(spark, d)
    return M.keep_better(old, new, "url", M.status_rank(F.col("status")), ["n_clips", "scanned_sec"])


@query(f"WITH {LEDGER} SELECT * FROM merged")
def ledger_merge(spark, d):
    return _merged(spark, d)


@query(f"WITH {LEDGER} SELECT outcome, count(*) AS n FROM merged GROUP BY outcome")
def merge_counts(spark, d):
    return _merged(spark, d).groupBy("outcome").agg(F.count("*").alias("n"))


@query("""SELECT l_partkey, l_suppkey, l_returnflag, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey, l_returnflag ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS r FROM lineitem) WHERE r = 1""")
def dedup_first_seen(spark, d):
    rows = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice")
    return M.first_seen(rows, ["l_partkey", "l_suppkey", "l_returnflag"], ["l_orderkey", "l_linenumber", "l_extendedprice"]).drop("l_extendedprice")


@query("""WITH a AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag <> 'N'), b AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
SELECT *, 'rebuilt' AS origin FROM a UNION ALL SELECT *, 'orphan' FROM b WHERE (l_partkey, l_suppkey) NOT IN (SELECT l_partkey, l_suppkey FROM a)""")
def rebuild_with_orphans(spark, d):
    lines = table(spark, d, "lineitem")
    keys = ["l_partkey", "l_suppkey"]
    a = lines.where("l_returnflag <> 'N'").select(*keys).distinct().withColumn("origin", F.lit("rebuilt"))
    b = lines.select(*keys).distinct().withColumn("origin", F.lit("orphan"))
    return M.with_orphans(a, b, keys)


@query(f"WITH {OBS}, l AS (SELECT *, row_number() OVER (PARTITION BY clip, k ORDER BY seq DESC) AS r FROM o) SELECT clip, k, seq, label, value FROM l WHERE r = 1 AND label <> 'error'")
def latest_by_key(spark, d):
    rows = observations(spark, d).select(F.struct("clip", "k").alias("key"), "seq", "label", "value")
    return M.latest(rows, "key", "seq", F.col("label") == "error").select("key.clip", "key.k", "seq", "label", "value")


@query(f"WITH {OBS} SELECT clip, k, count(DISTINCT label) AS parts FROM o GROUP BY ALL HAVING count(DISTINCT label) = 2")
def complete_in_all(spark, d):
    rows = observations(spark, d).select(F.struct("clip", "k").alias("key"), "label")
    return M.complete(rows, "key", "label", 2).select("key.clip", "key.k", "parts")


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def staleness(spark, d):
    orders = table(spark, d, "orders").select("o_custkey", "o_orderpriority")
    return M.missing(orders, orders.where("o_orderpriority = '1-URGENT'"), "o_custkey")


HASHED = """h AS (SELECT doc_id, source, lang, n_chars, md5(source || '/' || lang) AS m FROM documents),
sp AS (SELECT *, CASE WHEN ((((('0x' || substr(m, 1, 8))::BIGINT % 1000) * 296 + ('0x' || substr(m, 9, 8))::BIGINT) % 1000 * 296 + ('0x' || substr(m, 17, 8))::BIGINT) % 1000 * 296 + ('0x' || substr(m, 25, 8))::BIGINT) % 1000 < 200 THEN 'val' ELSE 'train' END AS split FROM h)"""


def _split(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
    return S.hash_split(rows, F.concat_ws("/", "source", "lang"), 0.2)


@query(f"WITH {HASHED} SELECT doc_id, split FROM sp")
def split_by_hash(spark, d):
    return _split(spark, d).select("doc_id", "split")


@query(f"WITH {HASHED} SELECT source, count(DISTINCT split) AS splits FROM sp GROUP BY source HAVING count(DISTINCT split) > 1")
def leak_check(spark, d):
    return M.leaks(_split(spark, d), "source", "split")


@query(f"WITH {HASHED} SELECT split, lang, count(*) AS clips, count(DISTINCT source) AS videos FROM sp GROUP BY ALL")
def adequacy_matrix(spark, d):
    return M.adequacy(_split(spark, d), "split", "lang", "source")


@query("""WITH g AS (SELECT source, count(*) AS n FROM documents GROUP BY source) SELECT source, n,
CASE WHEN coalesce(sum(n) OVER (ORDER BY md5('q:' || source), source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 400 THEN 'train' ELSE 'test' END AS split FROM g""")
def split_by_quota(spark, d):
    groups = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return S.quota_split(groups, "source", "n", 400, "q")


@query("""WITH g AS (SELECT DISTINCT source FROM documents), r AS (SELECT source, row_number() OVER (ORDER BY md5('f:' || source), source) AS p, count(*) OVER () AS n FROM g)
SELECT source, CASE WHEN p <= floor(n * 0.3::DOUBLE) OR source IN ('src1', 'src2') THEN 'test' ELSE 'train' END AS split FROM r""")
def split_by_fraction(spark, d):
    return S.fraction_split(table(spark, d, "documents").select("source").distinct(), "source", 0.3, "f", ["src1", "src2"])


@query("""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('rr:' || doc_id), doc_id) AS turn FROM documents)
SELECT doc_id, source, CAST(turn AS INTEGER) AS turn FROM r WHERE turn <= 3 ORDER BY turn, md5('rr:' || source), source LIMIT 50""")
def round_robin_sample(spark, d):
    return S.round_robin(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", most=3, limit=50, seed="rr")


@query(f"""WITH {OBS}, r AS (SELECT clip, seq, row_number() OVER (PARTITION BY clip ORDER BY seq) - 1 AS place, count(*) OVER (PARTITION BY clip) AS n FROM o)
SELECT clip, seq, CAST(place AS INTEGER) AS place FROM r WHERE n <= 5 OR place IN (0, floor((n - 1) / 4.0::DOUBLE), floor(2 * (n - 1) / 4.0::DOUBLE), floor(3 * (n - 1) / 4.0::DOUBLE), n - 1)""")
def even_sample(spark, d):
    return S.even_sample(observations(spark, d).select("clip", "seq"), "clip", "seq", 5)


@query(f"""WITH {OBS}, r AS (SELECT clip, seq, value, row_number() OVER (PARTITION BY clip ORDER BY value DESC, seq) AS r FROM o)
SELECT clip, seq, value, CAST(row_number() OVER (PARTITION BY clip ORDER BY seq) AS INTEGER) AS place FROM r WHERE r <= 6""")
def top_frames_in_order(spark, d):
    return S.best_in_order(observations(spark, d).select("clip", "seq", "value"), "clip", "value", "seq", 6)


@query("""WITH c AS (SELECT user_id AS clip, count(*) AS n FROM events GROUP BY 1), g AS (SELECT clip, n, p FROM c, (SELECT unnest(range(1, 6)) AS p)),
i AS (SELECT clip, n, p, least(n - 1, CAST(round_even((p - 1) * (n / 10.0::DOUBLE) / 5.0::DOUBLE + i * (n / 10.0::DOUBLE), 0) AS INTEGER)) AS x FROM g, (SELECT unnest(range(10)) AS i))
SELECT clip, CAST(n AS INTEGER) AS n, CAST(p AS INTEGER) AS p, CASE WHEN n <= 10 THEN array_to_string(range(n), ',') ELSE string_agg(DISTINCT CAST(x AS VARCHAR), ',' ORDER BY lpad(CAST(x AS VARCHAR), 3, '0')) END AS frames FROM (SELECT DISTINCT clip, n, p, x FROM i) GROUP BY clip, n, p""".replace("string_agg(DISTINCT CAST(x AS VARCHAR), ',' ORDER BY lpad(CAST(x AS VARCHAR), 3, '0'))", "string_agg(CAST(x AS VARCHAR), ',' ORDER BY x)"))
def frame_draw(spark, d):
    from kelpline.functions.scalars import interleaved

    clips = observations(spark, d).groupBy("clip").agg(F.count("*").cast("int").alias("n"))
    grid = clips.select("clip", "n", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("p"))
    frames = F.array_join(F.transform(interleaved(F.col("n"), 10, F.col("p"), 5), lambda x: x.cast("string")), ",")
    return grid.select("clip", "n", "p", frames.alias("frames"))


@query("""WITH h AS (SELECT md5(CAST(doc_id AS VARCHAR)) AS m FROM documents)
SELECT CAST(('0x' || substr(m, 25, 8))::BIGINT % 4 AS INTEGER) AS shard, count(*) AS n FROM h GROUP BY 1""")
def shard_assignment(spark, d):
    return S.shard(table(spark, d, "documents").select("doc_id"), "doc_id", 4).groupBy("shard").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), w AS (SELECT lang, n, pow(1 / n::DOUBLE, 0.5) AS w FROM c)
SELECT lang, n, round(w * count(*) OVER () / sum(w) OVER (), 6) AS weight FROM w""")
def class_weights(spark, d):
    return rounded(S.class_weights(table(spark, d, "documents"), "lang"), "weight")


@query("""WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), t AS (SELECT lang, least(pow((SELECT max(n) FROM c) / n::DOUBLE, 0.5), 4.0) AS t FROM c),
h AS (SELECT doc_id, lang, md5('up' || doc_id) AS m FROM documents), x AS (SELECT lang, t, (((('0x' || substr(m, 1, 8))::BIGINT % 1000 * 296 + ('0x' || substr(m, 9, 8))::BIGINT) % 1000 * 296 + ('0x' || substr(m, 17, 8))::BIGINT) % 1000 * 296 + ('0x' || substr(m, 25, 8))::BIGINT) % 1000 AS u FROM h JOIN t USING (lang))
SELECT lang, CAST(sum(floor(t) + CASE WHEN u < (t - floor(t)) * 1000 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM x GROUP BY lang""")
def upsample_quota(spark, d):
    return S.upsampled(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id").groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT CAST(coalesce(max(try_cast(substr('v' || CASE WHEN n_nationkey % 5 = 0 THEN 'x' ELSE CAST(n_nationkey AS VARCHAR) END, 2) AS INTEGER)), 0) + 1 AS INTEGER) AS version FROM nation")
def next_version(spark, d):
    key = F.col("n_nationkey")
    return S.next_version(table(spark, d, "nation").select(F.concat(F.lit("v"), F.when(key % 5 == 0, "x").otherwise(key.cast("string"))).alias("name")), "name")


@query("""WITH r AS (SELECT doc_id, EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id AND quality = 1) AS done FROM documents), l AS (SELECT coalesce(max(doc_id) FILTER (done), -1) AS last FROM r)
SELECT coalesce(min(doc_id) FILTER (doc_id > last), min(doc_id)) AS position FROM r, l WHERE NOT done""")
def resume_position(spark, d):
    done = table(spark, d, "labels").where("quality = 1").select("doc_id").distinct().withColumn("done", F.lit(True))
    rows = table(spark, d, "documents").select("doc_id").join(done, "doc_id", "left")
    return S.resume_position(rows, "doc_id", F.coalesce("done", F.lit(False)))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey IS NOT NULL)")
def open_work(spark, d):
    """Candidates without a finished row: urgent orders stand for what is done."""
    done = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    return table(spark, d, "customer").select("c_custkey").join(done, F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("""WITH cells AS (SELECT n_nationkey AS k, p FROM nation, (SELECT unnest(range(1, 6)) AS p)), tries AS (SELECT s_nationkey AS k, s_suppkey % 5 + 1 AS p, count(*) AS n FROM supplier GROUP BY ALL)
SELECT CAST(cells.k AS INTEGER) AS k, CAST(cells.p AS INTEGER) AS p FROM cells LEFT JOIN tries ON tries.k = cells.k AND tries.p = cells.p WHERE (cells.k + cells.p) % 3 <> 0 AND coalesce(n, 0) < 3""")
def work_cells(spark, d):
    from kelpline.streaming.signals import attempts_open

    cells = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("p"))
    tries = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), (F.col("s_suppkey") % 5 + 1).cast("int").alias("p"))
    return attempts_open(cells, cells.where((F.col("k") + F.col("p")) % 3 == 0), tries, ["k", "p"])


@query("""SELECT p_partkey FROM part WHERE (SELECT count(DISTINCT l_returnflag) FROM lineitem WHERE l_partkey = p_partkey) = 3""")
def common_to_all(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_returnflag")
    return M.complete(rows, "p_partkey", "l_returnflag", 3).select("p_partkey")


@query("""WITH c AS (SELECT source, min(CASE WHEN toxic = 1 THEN 'test' ELSE 'train' END) AS side FROM documents JOIN labels USING (doc_id) GROUP BY source), b AS (SELECT DISTINCT source FROM documents)
SELECT source, coalesce(c.side, 'train') AS side FROM b LEFT JOIN c USING (source)""")
def forced_split(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    forced = docs.join(table(spark, d, "labels"), "doc_id").groupBy("source").agg(F.min(F.when(F.col("toxic") == 1, "test").otherwise("train")).alias("side"))
    return docs.select("source").distinct().join(forced, "source", "left").select("source", F.coalesce("side", F.lit("train")).alias("side"))


@query("""WITH e AS (SELECT vec_id // 20 AS video, embedding::DOUBLE[] AS v FROM embeddings), x AS (SELECT video, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e), m AS (SELECT video, i, avg(x) AS m FROM x GROUP BY ALL)
SELECT CAST(video AS BIGINT) AS video, any_value(n) AS n, round(sqrt(sum(m * m)), 5) AS centre FROM m JOIN (SELECT video, count(*) AS n FROM e GROUP BY video) USING (video) GROUP BY video""")
def vectors_by_video(spark, d):
    """Vectors of each video and the length of their mean, which is small where they point everywhere."""
    rows = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 20).alias("video"), F.posexplode("embedding").alias("i", "x"))
    means = rows.groupBy("video", "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    return means.groupBy("video").agg(F.max("n").alias("n"), F.round(F.sqrt(F.sum(F.col("m") * F.col("m"))), 5).alias("centre"))


@query("""WITH e AS (SELECT vec_id // 20 AS video, vec_id, embedding FROM embeddings)
SELECT a.video AS video, a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM e a JOIN e b ON a.video = b.video AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3""")
def near_duplicate_pairs(spark, d):
    rows = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 20).alias("video"), "vec_id", "embedding")
    return rounded(M.similar_pairs(rows, "video", "vec_id", "embedding", 0.3), "cosine")
