"""Document fingerprints from closed syncmers, in DataFrame functions only.

A k-mer is ``K`` consecutive code points; its inner substrings have ``S``.  A
k-mer is an anchor (a closed syncmer) where the least of its inner substrings'
hashes is the first or the last of them; that depends on the k-mer alone, so
equal passages have equal anchors wherever they stand.  Texts are taken with a
margin of ``K - 1`` marks (U+FFFF) on either side: even a text of one code
point has an anchor, and every text is compared by the same kind of anchor.

An anchor is one long: its place (of the k-mer's first code point, the margin
counts) in the upper and its 32-bit hash in the lower half.  The fingerprint
is all anchors' hashes, 8 hexadecimal digits each, in order of place; the
likeness of two is the Jaccard similarity of their sets of hashes.  A text
that is put together from two others has the anchors that lie within their
parts, shifted, and those across the seams (:func:`joined_anchors`): only the
seams are hashed anew.

Null text is empty: no anchors, the fingerprint "", alike (1) only to another
empty one. Long texts are hashed in overlapping chunks of ``CHUNK`` k-mers,
which gives the same anchors. Extra columns don't matter. Rows of equal id
follow each other in order of their texts' digests; all of one id go to one
task. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import Window

from kelpline.llm.store import table

K, S, CHUNK = 20, 5, 4096
_INNER = K - S + 1
_MARGIN = "￿" * (K - 1)
_LOW = (1 << 32) - 1
#: Bytes of the table's files a range of ids takes, about.
RANGE_BYTES = 32 << 20


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def _every(conditions: list[Column]) -> Column:
    return reduce(lambda rest, c: c & rest, reversed(conditions))  # the first that fails ends it


def _closed(g: Column, i: Column) -> Column:
    first, last = F.get(g, i), F.get(g, i + (_INNER - 1))
    return _every([first <= F.get(g, i + j) for j in range(1, _INNER)]) | _every([last <= F.get(g, i + j) for j in range(_INNER - 2, -1, -1)])


def packed_anchors(text: Column) -> Column:
    """Anchors of ``text``, a column that has its margins (or needs none), in order of place."""

    def chunk(coded: Column, c: Column) -> Column:
        begin = c * CHUNK
        own = F.substring(coded, begin * 4 + 1, F.lit(4 * (CHUNK + K - 1)))
        inner = lambda b: F.transform(F.sequence(F.lit(1), F.octet_length(b) - (4 * S - 1), F.lit(4)), lambda p: F.xxhash64(F.substring(b, p, F.lit(4 * S))))
        put = lambda i: F.shiftleft((i + begin).cast("long"), 32)
        pack = lambda b, i: put(i).bitwiseOR(F.xxhash64(F.substring(b, i * 4 + 1, F.lit(4 * K))).bitwiseAND(F.lit(_LOW)))
        places = lambda g: F.filter(F.sequence(F.lit(0), F.size(g) - _INNER), lambda i: _closed(g, i))
        return _let(own, lambda b: F.transform(_let(inner(b), places), lambda i: pack(b, i)))

    coded = F.encode(text, "UTF-32")  # four bytes a code point: places are offsets
    kmers = F.length(text) - (K - 1)
    chunks = F.sequence(F.lit(0), F.floor((kmers - 1) / CHUNK).cast("int"))
    return F.when(kmers > 0, _let(coded, lambda b: F.flatten(F.transform(chunks, lambda c: chunk(b, c))))).otherwise(F.array().cast("array<bigint>"))


def text_anchors(text: Column) -> Column:
    """Anchors of a whole text; none for an empty one."""
    return F.when(F.length(text) > 0, packed_anchors(F.concat(F.lit(_MARGIN), text, F.lit(_MARGIN)))).otherwise(F.array().cast("array<bigint>"))


def joined_anchors(head: Column, own: Column, tail: Column, following: Column) -> Column:
    """Anchors of ``head`` + ``tail``, where ``own`` are the anchors of a text that begins with ``head`` and ``following``
    those of one that begins with ``tail``."""
    m, margin = K - 1, F.lit(_MARGIN)
    p, h = F.length(head), F.length(tail)
    edge = lambda n: F.shiftleft(n.cast("long"), 32)
    moved = lambda xs, by: _let(edge(by), lambda e: F.transform(xs, lambda x: x + e))
    before = _let(edge(p), lambda e: F.filter(own, lambda x: x < e))
    seam = packed_anchors(F.concat(F.right(F.concat(margin, head), F.lit(m)), F.left(F.concat(tail, margin), F.lit(m))))
    inside = _let(edge(h), lambda e: F.filter(following, lambda x: (x >= F.lit(m << 32)) & (x < e)))
    end = packed_anchors(F.concat(F.right(tail, F.lit(m)), margin))
    parts = F.concat(before, moved(seam, p), moved(inside, p), moved(end, p + m + F.greatest(h - m, F.lit(0))))
    return F.when(p + h > 0, parts).otherwise(F.array().cast("array<bigint>"))


def anchors(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, place, hash) of every anchor; place is the k-mer's first code point, from 0 (below 0 in the margin)."""
    rows = df.select(F.col(id_col), F.explode(text_anchors(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).alias("x"))
    return rows.select(id_col, (F.shiftright("x", 32) - (K - 1)).cast("int").alias("place"), F.col("x").bitwiseAND(F.lit(_LOW)).alias("hash"))


def hashes(anchors: Column) -> Column:
    return F.array_distinct(F.transform(anchors, lambda x: x.bitwiseAND(F.lit(_LOW))))


def printed(anchors: Column) -> Column:
    return F.array_join(F.transform(anchors, lambda x: F.substring(F.hex(x.bitwiseOR(F.lit(-(1 << 63)))), 9, 8)), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays without repeats; 1 for two empty ones."""
    common = F.size(F.array_intersect(a, b))
    return F.coalesce(common / F.nullif(F.size(a) + F.size(b) - common, F.lit(0)), F.lit(1.0))


def _range_key(df: DataFrame, id_col: str) -> Column:
    """What ranges of ids are cut by: a number's floor, or the text itself; of null ids the least."""
    if isinstance(df.schema[id_col].dataType, NumericType):
        return F.coalesce(F.floor(F.col(id_col)).cast("long"), F.lit(-(2**63)))
    return F.coalesce(F.col(id_col).cast("string"), F.lit(""))


def _bounds(df: DataFrame, key: Column, id_col: str, buckets: int) -> list:
    """Sorted keys that part the rows into about ``buckets`` ranges of like size: by a sketch of numbers, by a sample of texts of
    some twenty a range."""
    if isinstance(df.schema[id_col].dataType, NumericType):
        found = df.select(F.percentile_approx(key, [i / buckets for i in range(1, buckets)], max(20_000, 10 * buckets))).first()[0] or []
        return sorted(set(found))
    share = min(1.0, 20 * buckets / max(df.count(), 1))
    some = sorted(r["key"] for r in df.select(key.alias("key")).sample(share, 7).collect())
    return sorted(set(some[:: max(1, len(some) // buckets)][1:]))


def _bucket(key: Column, bounds: list) -> Column:
    """How many of the sorted bounds are at most ``key``, by a search of two steps."""
    if not bounds:
        return F.lit(0)
    width = int(len(bounds) ** 0.5) + 1
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    upto = lambda xs: F.size(F.filter(xs, lambda b: b <= key))
    group = upto(F.lit([g[0] for g in groups]))
    held = F.array(*[F.lit(g) for g in groups])
    return F.when(group == 0, 0).otherwise((group - 1) * width + upto(F.get(held, group - 1)))


def with_next(df: DataFrame, columns: list[str], *, id_col: str, tie: Column, enrich: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``enrich(df)`` with ``next``: the struct of ``columns`` of the row that follows by ``id_col`` (after the last, the first).

    Rows are dealt once, by ranges of the id of about ``RANGE_BYTES``; each range is ordered by itself and its last row
    takes the first row of the next range that has any. Null ids come first, equal ids are ordered by ``tie``.
    """
    spark = df.sparkSession
    key = _range_key(df, id_col)
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    size = size if size < 1 << 60 else 0  # unknown
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), min(size // RANGE_BYTES, 50_000))
    bucket = _bucket(key, _bounds(df, key, id_col, buckets))
    keyed = df.withColumns({"__key": key, "__bucket": bucket, "__tie": tie})
    heads = df.select(bucket.alias("__bucket"), key.alias("__key")).groupBy("__bucket").agg(F.min("__key").alias("__key")).collect()  # one row a range
    filled = sorted(r["__bucket"] for r in heads)
    before = {b: filled[i - 1] for i, b in enumerate(filled)}
    own = F.struct(*columns)
    if not filled:
        return enrich(df).withColumn("next", own)
    starts = spark.createDataFrame([(r["__key"], before[r["__bucket"]]) for r in heads], f"__key {'long' if isinstance(df.schema[id_col].dataType, NumericType) else 'string'}, __before int")
    at = F.struct(id_col, "__tie")
    first = keyed.join(F.broadcast(starts), "__key").groupBy("__before").agg(F.min_by(F.struct(*df.columns), at).alias("__row"))  # one row a range
    first = enrich(first.select("__before", "__row.*")).select("__before", own.alias("__first"))
    order = Window.partitionBy("__bucket").orderBy(F.col(id_col).asc_nulls_first(), "__tie")
    led = enrich(keyed.repartition(buckets, "__bucket")).withColumn("__next", F.lead(own).over(order))
    led = led.join(first, F.col("__bucket") == F.col("__before"), "left")
    return led.withColumn("next", F.coalesce("__next", "__first")).drop("__key", "__bucket", "__tie", "__before", "__next", "__first")


def op5_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Contract view: fingerprints of every document and of its edited text. ``kept_places`` is the share of the
    document's anchors that the edited text has at the same place."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    enrich = lambda df: df.withColumn("own", text_anchors(F.col("text")))
    rows = with_next(docs, ["text", "own"], id_col="doc_id", tie=F.md5("text"), enrich=enrich)
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    head, tail = F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next.text"), F.lit(1), cut)
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), head.alias("head"), tail.alias("tail"), "own", F.col("next.own").alias("following"))
    rows = rows.withColumn("changed", joined_anchors(F.col("head"), F.col("own"), F.col("tail"), F.col("following")))
    rows = rows.withColumns({f"h_{c}": hashes(F.col(c)) for c in ("own", "changed", "following")})
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.concat("head", "tail"), 256).alias("edited_sha256"),
        printed(F.col("own")).alias("fingerprint"),
        printed(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("h_own"), F.col("h_changed")).alias("near_edited"),
        likeness(F.col("h_own"), F.col("h_following")).alias("near_next"),
        F.coalesce(F.size(F.array_intersect("own", "changed")) / F.nullif(F.size("own"), F.lit(0)), F.lit(1.0)).alias("kept_places"),
    )
