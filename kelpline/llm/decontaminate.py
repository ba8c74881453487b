"""Benchmark decontamination with an FM-index per training shard.

A shard is a bounded slice of the texts a task reads.  Its words become
symbols: the number of the word among the benchmark's words, or a separator
for any other word.  Runs of benchmark words that are shorter than the
shortest searched phrase can't hold one and are left out; every other run is
indexed.  All phrases (windows of ten consecutive words of an item, or the
whole item where it has fewer) are searched backward at once through
wavelet-tree ranks, occurrences are located by sampled suffix positions, and
overlapping occurrences merge into removal spans.

What is shipped to the tasks is a part of the benchmark's windows, of items of
about ``part_bytes``.  A benchmark of several parts is searched for one part
after the other, over the table the step before has written; hits and items of
all parts are united.

Words are equal by 64-bit hashes. Null and empty texts have no words; long
texts are a shard of their own. Repeated item ids count once per document; a
null item id counts as "". Repeated rows keep a row each; columns named as the
results are replaced, others kept; an empty table gives an empty one, an empty
benchmark no hits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.llm import words as W
from kelpline.llm.fm_index import FMIndex
from kelpline.llm.store import materialise, table

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(0x41, 0x5B)})
SHARD_BYTES = 1 << 20


class Phrases:
    """The benchmark's windows as rows of word numbers, by length, numbered through, with the items each belongs to."""

    def __init__(self, items: list[tuple], window: int):
        raw = [(text or "").encode() for _, text in items]
        words = W.split_words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]).astype(np.int64))
        self.items: list[str] = sorted({"" if i is None else str(i) for i, _ in items})
        place = {x: k for k, x in enumerate(self.items)}
        own = np.array([place["" if i is None else str(i)] for i, _ in items], np.int64)
        self.hashes, which = np.unique(words.hash, return_inverse=True)
        numbers = (which + 1).astype(np.int32)
        self.alphabet = len(self.hashes) + 1
        count = np.diff(words.first)
        size = np.minimum(count, window)
        windows = np.where(count > 0, count - size + 1, 0)  # of each item
        item = np.repeat(np.arange(len(items)), windows)
        start = words.first[:-1][item] + np.arange(len(item)) - np.repeat(np.cumsum(windows) - windows, windows)
        self.by_length: dict[int, tuple[np.ndarray, int]] = {}  # length: (its windows, the first one's number)
        owners, total = [], 0
        for n in np.unique(size[item]).tolist():
            at = np.flatnonzero(size[item] == n)
            rows, same = np.unique(numbers[start[at][:, None] + np.arange(n)], axis=0, return_inverse=True)
            self.by_length[n] = rows, total
            owners.append(np.stack([same.ravel() + total, own[item[at]]], axis=1))
            total += len(rows)
        pairs = np.unique(np.concatenate(owners), axis=0) if owners else np.empty((0, 2), np.int64)
        self.owner, self.owners = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(total + 1))
        self.shortest = min(self.by_length, default=0)

    def number(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int32)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at + 1, 0).astype(np.int32)

    def items_of(self, row: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, item) of occurrences of windows in rows, sorted."""
        total = max(len(self.owners) - 1, 1)
        key = np.unique(row * total + which)
        row, which = key // total, key % total
        n = self.owners[which + 1] - self.owners[which]
        item = self.owner[np.repeat(self.owners[which] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
        key = np.unique(np.repeat(row, n) * max(len(self.items), 1) + item)
        return key // max(len(self.items), 1), key % max(len(self.items), 1)


def occurrences(phrases: Phrases, words: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the first word, window's number, window's length) of each occurrence in a shard."""
    none = (np.empty(0, np.int64),) * 3
    symbols = phrases.number(words.hash)
    known = symbols > 0
    if not phrases.shortest or not known.any():
        return none
    fresh = np.zeros(len(known), bool)
    fresh[words.first[:-1][words.first[:-1] < len(known)]] = True
    begin = known & (fresh | ~np.concatenate([[False], known[:-1]]))
    run_start = np.flatnonzero(begin)
    finish = known & np.concatenate([~known[1:] | fresh[1:], [True]])
    run_end = np.flatnonzero(finish) + 1
    long_enough = run_end - run_start >= phrases.shortest
    run_start, run_end = run_start[long_enough], run_end[long_enough]
    if not len(run_start):
        return none
    size = run_end - run_start + 1
    place = np.concatenate([[0], np.cumsum(size)])
    source = np.arange(place[-1]) - np.repeat(place[:-1] - run_start, size)  # of each symbol; of a separator the word after the run
    text = symbols[np.minimum(source, len(symbols) - 1)]
    text[place[1:] - 1] = 0
    index = FMIndex(text, phrases.alphabet)
    starts, numbers, lengths = [], [], []
    for n, (rows, first) in phrases.by_length.items():
        lo, hi = index.search(rows)
        hits = hi - lo
        which = np.repeat(np.arange(len(rows)), hits)
        row = np.arange(len(which)) - np.repeat(np.cumsum(hits) - hits, hits) + lo[which]
        starts.append(source[index.locate(row)])
        numbers.append(which + first)
        lengths.append(np.full(len(which), n))
    return tuple(np.concatenate(x).astype(np.int64) for x in (starts, numbers, lengths))


NAMES = ["n_words", "n_hit", "items", "spans"]
_HITS = "__hits"
SCHEMA = f"n_words long, n_hit long, items array<string>, spans array<struct<start: int, end: int>>, {_HITS} array<struct<first: int, last: int>>"


def _parts(benchmark: DataFrame, window: int, part_bytes: int) -> Iterator[Phrases]:
    """Windows of the items, some at a time; of an empty benchmark one part without any."""
    held, size, made = [], 0, 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        held.append(tuple(r))
        size += len(r[1] or "")
        if size >= part_bytes:
            yield Phrases(held, window)
            held, size, made = [], 0, made + 1
    if held or not made:
        yield Phrases(held, window)


def scan(df: DataFrame, benchmark: DataFrame, *, text_col: str = "text", window: int = 10, part_bytes: int = 4 << 20) -> DataFrame:
    """``df`` with n_words, n_hit, the items found and removal spans (code points, end exclusive)."""
    out = df.drop(*[n for n in (*NAMES, _HITS) if n in df.columns])
    for k, phrases in enumerate(_parts(benchmark, window, part_bytes)):
        out = _scan_part(materialise(out, "decontaminated") if k else out, phrases, text_col)
    return out.drop(_HITS)


def _scan_part(df: DataFrame, phrases: Phrases, text_col: str) -> DataFrame:
    """The columns of SCHEMA, united with those that earlier parts have found."""
    shipped = df.sparkSession.sparkContext.broadcast(phrases)
    at = df.columns.index(text_col)
    later = _HITS in df.columns
    fields = [f for f in df.schema.fields if not later or f.name not in (*NAMES, _HITS)]
    kept = [df.columns.index(f.name) for f in fields]
    before = (df.columns.index(_HITS), df.columns.index("items")) if later else None
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    words_ = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shipped.value
        for batch in batches:
            for a, b, data, offsets in W.text_slices(batch.column(at), SHARD_BYTES):
                words = W.split_words(data, offsets)
                start, which, length = occurrences(phrases, words)
                row = W.row_of(words.first)
                cover = np.zeros(len(words.hash) + 1, np.int64)
                np.add.at(cover, start, 1)
                np.add.at(cover, start + length, -1)
                items_of: list[list[str]] = [[] for _ in range(b - a)]
                for r, k in zip(*(x.tolist() for x in phrases.items_of(row[start], which)), strict=True):
                    items_of[r].append(phrases.items[k])
                if before:
                    for i in range(b - a):
                        for x in batch.column(before[0])[a + i].as_py():
                            cover[words.first[i] + x["first"]] += 1
                            cover[words.first[i] + x["last"]] -= 1
                        items_of[i] = sorted({*items_of[i], *batch.column(before[1])[a + i].as_py()})
                hit = np.cumsum(cover)[:-1] > 0
                n_hit = np.bincount(row[hit], minlength=b - a) if len(row) else np.zeros(b - a, int)
                spans, hits = _spans(words, hit, row)
                new = [
                    pa.array(np.diff(words.first), pa.int64()),
                    pa.array(n_hit, pa.int64()),
                    pa.array(items_of, pa.list_(pa.string())),
                    pa.array([spans.get(i, []) for i in range(b - a)], span),
                    pa.array([hits.get(i, []) for i in range(b - a)], words_),
                ]
                own = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(own.column(k) for k in kept), *new], names=[*(f.name for f in fields), *NAMES, _HITS])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return df.mapInArrow(W.tidied(run), f"{schema}, {SCHEMA}" if fields else SCHEMA)


def _spans(words: W.Words, hit: np.ndarray, row: np.ndarray) -> tuple[dict[int, list[dict]], dict[int, list[dict]]]:
    """Merged spans of covered words by text, in code points and in words. Occurrences that only touch merge as well."""
    out: dict[int, list[dict]] = {}
    counted: dict[int, list[dict]] = {}
    if not hit.any():
        return out, counted
    chars = W.char_starts(words.data)
    new_text = np.concatenate([[True], row[1:] != row[:-1]])
    first = np.flatnonzero(hit & (new_text | ~np.concatenate([[False], hit[:-1]])))
    last = np.flatnonzero(hit & np.concatenate([new_text[1:] | ~hit[1:], [True]]))
    for i, j in zip(first, last, strict=True):
        base = chars[words.offsets[row[i]]]
        out.setdefault(int(row[i]), []).append({"start": int(chars[words.start[i]] - base), "end": int(chars[words.end[j]] - base)})
        counted.setdefault(int(row[i]), []).append({"first": int(i - words.first[row[i]]), "last": int(j + 1 - words.first[row[i]])})
    return out, counted


def without_spans(text: F.Column, spans: F.Column) -> F.Column:
    """``text`` less its removal spans."""
    kept = F.aggregate(
        spans,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda s, x: F.struct(F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"])).alias("out"), x["end"].alias("at")),
        lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, kept).otherwise(text)


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Contract view: one row per document."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def oracle(window: int = 10) -> str:
    """The contract view in SQL: windows of every length that an item needs, joined as texts."""
    upper = "".join(chr(c) for c in range(0x41, 0x5B))
    words = lambda x: f"regexp_extract_all(translate(coalesce({x}, ''), '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    ahead = lambda n: " || ' ' || ".join(["word", *(f"lead(word, {k}) OVER v" for k in range(1, n))])
    runs = " UNION ALL ".join(f"SELECT r, k, {n} AS n, {ahead(n)} AS win FROM dw WHERE {n} IN (SELECT n FROM it) WINDOW v AS (PARTITION BY r ORDER BY k)" for n in range(1, window + 1))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words('text')} AS ws FROM documents),
it AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, ws, least({window}, len(ws)) AS n FROM (SELECT item_id, {words('text')} AS ws FROM benchmark) WHERE len(ws) > 0),
iw AS (SELECT DISTINCT item, n, array_to_string(ws[i : i + n - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS i FROM it)),
dw AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS k FROM d),
runs AS ({runs}),
hit AS (SELECT r, k, runs.n, item FROM runs JOIN iw ON runs.n = iw.n AND runs.win = iw.win),
cov AS (SELECT DISTINCT r, unnest(range(k, k + n)) AS k FROM (SELECT DISTINCT r, k, n FROM hit)),
isl AS (SELECT r, count(*) AS n_hit, count(*) FILTER (gap) AS n_spans FROM (SELECT r, coalesce(k - lag(k) OVER (PARTITION BY r ORDER BY k) > 1, true) AS gap FROM cov) GROUP BY r),
own AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_spans, 0) AS n_spans
FROM d LEFT JOIN isl USING (r) LEFT JOIN own USING (r)"""
