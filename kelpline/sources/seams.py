"""Opaque work behind a seam: decoding, model inference and calls are functions the caller supplies.

Each runs inside ``mapInPandas``: one client or model a task, whole batches, no
lock. Keys make the output idempotent when a task is retried.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def frames(files: DataFrame, decode: Callable[[bytes], Iterator[tuple[int, bytes]]], key: str, content: str) -> DataFrame:
    """key, t, frame of each decoded file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, raw in zip(pdf[key], pdf[content], strict=True):
                got = list(decode(raw))
                yield pd.DataFrame({key: [k] * len(got), "t": [t for t, _ in got], "frame": [f for _, f in got]})

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, content).mapInPandas(run, f"{key} {kind}, t int, frame binary")


def frames_at(rows: DataFrame, grab: Callable[[str, float], bytes | None], key: str, url: str, t: str) -> DataFrame:
    """key, t, frame (null where none could be read) of single points in videos."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[[key, t]].assign(frame=[grab(u, x) for u, x in zip(pdf[url], pdf[t], strict=True)])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in (key, t)}
    return rows.select(key, t, url).mapInPandas(run, f"{key} {kinds[key]}, {t} {kinds[t]}, frame binary")


def windows_until(files: DataFrame, decode: Callable[[bytes], Iterator[tuple[int, float]]], key: str, content: str, *, batch: int = 64, length: int = 20, step: int = 20, threshold: float = 0.5, least_share: float = 0.5, most: int = 2) -> DataFrame:
    """key, start, visible_frac, scanned: greedy windows of a file's scores (one a second, decoded and scored by ``decode`` as it
    goes). A file is read in batches and left as soon as ``most`` windows lie in what was read; ``scanned`` says how far that was."""
    import itertools

    def found(scores: list[float]) -> list[tuple[int, float]]:
        out, at = [], 0
        while at + length <= len(scores) and len(out) < most:
            share = sum(s >= threshold for s in scores[at : at + length]) / length
            if share > least_share:
                out.append((at, share))
            at += step if share > least_share else 1
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, raw in zip(pdf[key], pdf[content], strict=True):
                scores, own, source = [], [], decode(raw)
                while len(own) < most and (more := list(itertools.islice(source, batch))):
                    scores += [s for _, s in more]
                    own = found(scores)
                rows += [(k, start, share, len(scores)) for start, share in own]
            yield pd.DataFrame(rows, columns=[key, "start", "visible_frac", "scanned"])

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, content).mapInPandas(run, f"{key} {kind}, start long, visible_frac double, scanned long")


def even_times(seconds, fps: float):
    """Times of frames drawn at ``fps``, from 0, as an array column: what an extraction to files covers."""
    from pyspark.sql import functions as F

    n = F.greatest(F.ceil(seconds * fps), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: i / fps)


def scores(rows: DataFrame, load: Callable[[], Callable[[list], list[float]]], key: str, value: str) -> DataFrame:
    """key, score: a model loaded once a task, applied to whole batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "score": model(list(pdf[value]))})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, value).mapInPandas(run, f"{key} {kind}, score double")


def calls(rows: DataFrame, connect: Callable[[], Callable[[str], str]], key: str, prompt: str, *, tries: int = 4, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """key, reply, attempts, error of a remote call with doubling waits; a failed call is a row, not a failed task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = connect()
        for pdf in batches:
            out = []
            for k, p in zip(pdf[key], pdf[prompt], strict=True):
                reply, error, n = None, None, 0
                while reply is None and n < tries:
                    if n:
                        sleep(wait * 2 ** (n - 1))
                    n += 1
                    try:
                        reply, error = client(p), None
                    except OSError as e:
                        error = str(e)
                out.append((k, reply, n, error))
            yield pd.DataFrame(out, columns=[key, "reply", "attempts", "error"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, prompt).mapInPandas(run, f"{key} {kind}, reply string, attempts int, error string")


def cascade(rows: DataFrame, cheap: Callable[[DataFrame], DataFrame], gate: str, dear: Callable[[DataFrame], DataFrame], key: str) -> tuple[DataFrame, DataFrame]:
    """The cheap score for all rows, the dear one for those that pass its gate: (all cheap scores, dear scores)."""
    first = cheap(rows)
    return first, dear(rows.join(first.where(gate).select(key), key, "left_semi"))
