"""Periodic runs of words: maximal repetitions by the method of Kolpakov and Kucherov.

A run is a stretch of consecutive words with smallest period q, at least
``exponent`` times q long and at least ``least`` words, that no neighbouring word
extends keeping the period.  A suffix automaton gives the Lempel-Ziv
factorisation of the words; at each factor's start Main's algorithm extends
every period to both sides by prefix functions and finds the runs that touch
it; runs strictly inside a factor are copied from the factor's earlier
occurrence.

In a run every word stands ``exponent`` times at least.  So words that are rarer
within their stretch of the text belong to none, and part it into shorter ones;
what is left goes through the method.  This loses no run and changes none.

All work on a text is one row's, no rows meet: nothing is shuffled. Memory is
some 500 bytes a word of the longest stretch of frequent words.

Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. Null and empty texts have no
words and no runs; long texts are taken whole; repeated rows keep a row each;
columns named ``runs`` or ``collapsed`` are replaced, others kept. An empty
table gives an empty one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import compress

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.llm import words as W
from kelpline.llm.store import table

WORD = r"[^\x20\x09-\x0D]+"
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
NEW = ("runs", "collapsed")
_PASSES = 3  # of parting stretches at rare words; more would only save time


def automaton(s: list[int]) -> tuple[list[dict[int, int]], list[int]]:
    """Transitions of the suffix automaton of ``s``, and where each state's strings first end."""
    step: list[dict[int, int]] = [{}]
    link, length, ends = [-1], [0], [-1]
    last = 0
    for i, c in enumerate(s):
        new = len(step)
        step.append({})
        length.append(i + 1)
        ends.append(i)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                ends.append(ends[q])
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step, ends


def factors(s: list[int]) -> list[tuple[int, int, int]]:
    """(start, end, start of an earlier occurrence or -1): each factor is the longest that began before, or a new word."""
    step, ends = automaton(s)
    out, i, n = [], 0, len(s)
    while i < n:
        state, j = 0, i
        while j < n:
            to = step[state].get(s[j])
            if to is None or ends[to] >= j:
                break
            state, j = to, j + 1
        out.append((i, j, ends[state] - (j - i) + 1) if j > i else (i, i + 1, -1))
        i = max(j, i + 1)
    return out


def prefixes(s: list[int]) -> list[int]:
    """For each place the length of the longest common prefix of ``s`` and what begins there; 0 at the first."""
    n = len(s)
    z, left, right = [0] * n, 0, 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def touching(s: list[int], low: int, b: int, high: int, exponent: int, least: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of repetitions within ``low:high`` that touch ``b``, from periods on either side of it."""
    t, v = s[low:b], s[b:high]
    m, k = len(t), len(v)
    back = prefixes([*t[::-1], -1, *v[::-1], *t[::-1]])
    ahead = prefixes([*v, -1, *t, *v])
    for p in range(1, min(k, (m + k) // exponent) + 1):
        # the period's first copy begins at b
        suffix, prefix = back[m + 1 + k - p], ahead[p] if p < k else 0
        if suffix + prefix + p >= max(exponent * p, least):
            yield b - suffix, b + p + prefix, p
    for p in range(1, min(m, (m + k) // exponent) + 1):
        # the period's last copy ends at b
        suffix, prefix = back[p] if p < m else 0, ahead[k + 1 + m - p] if k else 0
        if suffix + prefix + p >= max(exponent * p, least):
            yield b - p - suffix, b + prefix, p


def maximal_runs(s: list[int], exponent: int = 2, least: int = 2) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of ``s`` by start, then period."""
    n, parts, found = len(s), factors(s), {}
    before = 0
    for b, f in [(b, f) for b, f, _ in parts[1:]] + [(n, n)]:
        low = max(0, b - 2 * (b - before) - (f - b))
        if f - low >= least:
            for start, end, p in touching(s, low, b, f, exponent, least):
                if (start == 0 or s[start - 1] != s[start - 1 + p]) and (end == n or s[end] != s[end - p]):
                    found[start, end] = min(p, found.get((start, end), p))
        before = b
    if not found:
        return []
    by_start: dict[int, list[tuple[int, int]]] = {}
    for (start, end), p in found.items():
        by_start.setdefault(start, []).append((end, p))
    for b, f, source in parts:
        if source < 0:
            continue
        for i in range(b + 1, f - 1):
            known = by_start.get(i - b + source)
            if known:
                copied = [(end + b - source, p) for end, p in known if end + b - source < f]
                if copied:
                    by_start.setdefault(i, []).extend(copied)
    return sorted((start, end - start, p) for start, own in by_start.items() for end, p in own)


def stretches(s: list[int], exponent: int, least: int) -> list[tuple[int, int]]:
    """(start, end) of what is left of ``s`` between words of fewer than ``exponent`` places in their stretch."""
    todo = [(0, len(s))]
    for _ in range(_PASSES):
        fresh = []
        for lo, hi in todo:
            part = s[lo:hi]
            rare = {c for c, n in Counter(part).items() if n < exponent}
            if not rare:
                fresh.append((lo, hi))
                continue
            start = 0
            for i, c in enumerate(part):
                if c in rare:
                    if i - start >= least:
                        fresh.append((lo + start, lo + i))
                    start = i + 1
            if len(part) - start >= least:
                fresh.append((lo + start, hi))
        todo = fresh
    return todo


def runs_of(words: list, exponent: int, least: int) -> list[tuple[int, int, int]]:
    number: dict = {}
    s = [number.setdefault(w, len(number)) for w in words]
    if len(s) < least or len(s) - len(number) < exponent - 1:
        return []
    return [(lo + start, length, p) for lo, hi in stretches(s, exponent, max(least, exponent)) for start, length, p in maximal_runs(s[lo:hi], exponent, least)]


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """``words`` without those a run holds after its first period."""
    if not runs:
        return words
    keep = bytearray(b"\x01") * len(words)
    for start, length, p in runs:
        keep[start + p : start + length] = bytes(length - p)
    return list(compress(words, keep))


def scan(docs: DataFrame, *, text_col: str = "text", exponent: int = 4, least: int = 6) -> DataFrame:
    """``docs`` with ``runs`` (start, length, period; by start, then period) and ``collapsed``, the kept words joined by a space."""
    if exponent < 2:
        raise ValueError("a run holds its period twice at least")
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in NEW])
    at = docs.columns.index(text_col)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                words = [t.encode().split() for t in pc.fill_null(some.column(at), "").to_pylist()]  # bytes part at these six characters
                found = [runs_of(own, exponent, least) for own in words]
                texts = [b" ".join(collapsed(own, runs)) for own, runs in zip(words, found, strict=True)]
                cols = [pa.array([[{"start": a, "length": n, "period": p} for a, n, p in runs] for runs in found], kind), pa.array(texts, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*some.columns, *cols], names=[*batch.schema.names, *NEW])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(W.tidied(run), f"{schema}, runs {RUNS}, collapsed string")


def planted(text: Column, h: Column) -> Column:
    """The contract's texts: where h % 10 = 0 the words from a on repeat the first p of them."""
    g = F.floor(h / 10)

    def tail_repeated(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        cycles = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(cycles, F.lit(1), n - a)), " ")).otherwise("")

    words = F.array(F.regexp_extract_all(text, F.lit(WORD), 0))  # a row of one, so that the words are taken once
    return F.when(h % 10 == 0, F.get(F.transform(words, tail_repeated), 0)).otherwise(text)


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Contract view: the greatest run and digests of all runs and of the collapsed text of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs.select("doc_id", planted(F.col("text"), F.crc32(F.col("doc_id").cast("string"))).alias("text")))
    greatest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("minus"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("g", greatest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("g.start").alias("start"), (-F.col("g.minus")).alias("length"), F.col("g.period").alias("period"),
        F.floor(-1000 * F.col("g.minus") / F.col("g.period")).cast("long").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
