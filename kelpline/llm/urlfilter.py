"""URL filters: allow and block entries of host and path, the longest that fits decides.

An entry fits its host and all subdomains, where the URL's path starts with the
entry's.  Entries make a trie: host labels from the last to the first, then
whole path segments; a node ends entries, each with the part of a segment that
is left.  A URL walks its host's labels and, from every node on the way, its
path's segments.  The longest entry is that of the most characters, host and
path together, of equals the one with the longer host; an entry both allowed
and blocked blocks.  What no entry fits has the default verdict.

The trie is broadcast where the entries are within ``broadcast_rows`` and
``broadcast_bytes``, which are counted first.  Beyond, the distinct (host, path)
pairs are joined with the entries by every host suffix and every path prefix of
a length that entries have, over salted keys, with the same result.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased; path: from there up to ``?``, ``#`` or the end.  A null URL or one
without ``://`` has both empty.  Entries: a null path counts as empty, rows with
a null host or verdict are left out.  Repeated rows keep a row each, columns
named ``host``, ``path``, ``rule`` or ``verdict`` are replaced, others kept;
empty tables give the default or no rows; long URLs are taken whole.
"""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.llm.store import table

NEW = ("host", "path", "rule", "verdict")
SALTS = 16


def lowered(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return lowered(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


class Node:
    __slots__ = ("labels", "segments", "ends")

    def __init__(self):
        self.labels: dict[str, Node] = {}
        self.segments: dict[str, Node] = {}
        self.ends: dict[str, str] = {}  # rest of a segment: verdict


class Trie:
    """Entries by reversed host labels, then path segments."""

    def __init__(self, entries: Iterable[tuple[str, str, str]] = ()):
        self.root = Node()
        for host, path, verdict in entries:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.labels.setdefault(label, Node())
            *whole, rest = path.split("/")
            for segment in whole:
                node = node.segments.setdefault(segment, Node())
            if node.ends.get(rest) != "block":
                node.ends[rest] = verdict

    def _on_path(self, node: Node, segments: list[str]) -> Iterator[tuple[str, str]]:
        """(path, verdict) of the entries below a host's node that fit, from short to long."""
        done = ""
        for k, segment in enumerate(segments):
            if node.ends:
                for n in range(len(segment) + 1):
                    if (verdict := node.ends.get(segment[:n])) is not None:
                        yield done + segment[:n], verdict
            node = node.segments.get(segment)
            if node is None or k + 1 == len(segments):
                return
            done += segment + "/"

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        """(entry, verdict) of the longest fit, or nothing."""
        node, suffix, segments, best = self.root, "", path.split("/"), (-1, None, None)
        for k, label in enumerate(reversed(host.split("."))):
            node = node.labels.get(label)
            if node is None:
                break
            suffix = f"{label}.{suffix}" if k else label
            for prefix, verdict in self._on_path(node, segments):
                if len(suffix) + len(prefix) >= best[0]:  # of equals the longer host, which comes later
                    best = (len(suffix) + len(prefix), suffix + prefix, verdict)
        return best[1], best[2]


def normalised(rules: DataFrame) -> DataFrame:
    """host, path, verdict, one row an entry."""
    rows = rules.where("host IS NOT NULL AND verdict IS NOT NULL").select(lowered(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    return rows.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block over allow


def judge(urls: DataFrame, rules: DataFrame, *, url_col: str = "url", default: str = "allow", broadcast_rows: int = 200_000, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """``urls`` with host, path, rule (host and path of the entry, or null) and verdict; ``rules``: host, path, verdict (allow or block)."""
    host, path = parts(F.col(url_col))
    kept = [c for c in urls.columns if c.lower() not in NEW]
    rows = urls.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    entries = normalised(rules)
    size = entries.agg(F.count("*").alias("n"), F.sum(F.octet_length("host") + F.octet_length("path")).alias("bytes")).first()
    if size["n"] <= broadcast_rows and (size["bytes"] or 0) <= broadcast_bytes:
        found = _walked(rows, Trie(tuple(r) for r in entries.collect()))  # within the bounds counted above
    else:
        found = _joined(rows, entries)
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def _walked(rows: DataFrame, trie: Trie) -> DataFrame:
    shipped = rows.sparkSession.sparkContext.broadcast(trie)

    @F.pandas_udf("rule string, verdict string")
    def walk(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shipped.value.find(h, p) for h, p in zip(host, path, strict=True)], columns=["rule", "verdict"])

    return rows.withColumn("found", walk("host", "path")).select("*", "found.*")


def _joined(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """The same by joins. A pair of host and path meets an entry once, copies of a pair are joined once."""
    lengths = [r[0] for r in entries.select(F.length("path")).distinct().collect()]  # at most as many as the longest path has characters
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    fitting = F.filter(F.array(*[F.lit(x) for x in lengths]).cast("array<int>"), lambda n: n <= F.length("path"))
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    pairs = rows.select("host", "path").distinct().withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int"))
    asked = pairs.select("host", "path", "salt", F.explode(suffixes).alias("h")).select("*", F.explode(fitting).alias("n")).withColumn("p", F.substring("path", F.lit(1), F.col("n")))
    offered = entries.select(F.col("host").alias("h"), F.col("path").alias("p"), "verdict", salt.alias("salt"))
    order = F.struct(F.length("h") + F.length("p"), F.length("h"))
    best = asked.join(offered, ["h", "p", "salt"]).groupBy("host", "path").agg(F.max_by(F.struct(F.concat("h", "p").alias("rule"), "verdict"), order).alias("best"))
    best = best.select("host", "path", "best.rule", "best.verdict", salt.alias("salt"))
    return rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(best, ["host", "path", "salt"], "left")


#: Entries of the query: host, path, verdict.  Fixed values.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def fixed_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RULES), "host string, path string, verdict string")


def op13_url_filter(spark, sf_dir: str) -> DataFrame:
    """Contract view: host, path, the deciding entry and the verdict of every page."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), fixed_rules(spark)).drop("url")


def oracle() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return rf"""WITH p AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
e(h, p, v) AS (VALUES {rules}),
m AS (SELECT q.*, h || p AS rule, v, row_number() OVER (PARTITION BY r ORDER BY length(h || p) DESC, length(h) DESC) AS k FROM q LEFT JOIN e ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1"""
