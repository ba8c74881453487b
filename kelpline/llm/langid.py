"""Language identification by interpolated Kneser-Ney character models.

One model of order five per language, learned from a bounded sample of
labelled texts (``per_language``, whole texts, chosen by a hash of the id).
All languages share sorted arrays of n-gram hashes, one per order; beside each
hash stand the languages' interpolated log-probabilities, so scoring looks an
n-gram up once for all languages and falls back to shorter ones by stored
back-off weights.  The language of least cross-entropy per symbol wins.

Calibration on a held-back fifth of the sample: a logistic curve turns the
margin to the runner-up into ``score``.  A text is ``rejected`` where its
cross-entropy lies too many standard deviations above its language's mean, for
its length.  How many is calibrated: what all but a twentieth of foreign texts reach
(held-back texts without their own language's model, and with their letters
shuffled), but at least half as much again as any held-back text reaches, so
that texts of a known language stay.

Symbols are code points, all of them: n-grams are hashes, no alphabet is cut.
Null texts and texts without a letter are ``und`` with score 0, and rejected.
Languages are those of non-null labels; without any, every text is ``und``.
Ties go to the first language by name. Columns named as the results are
replaced, others kept; repeated rows keep a row each; an empty table gives an
empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.llm import words as W
from kelpline.llm.store import table

ORDER = 5
_FACTORS = W.mix(np.arange(1, ORDER + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
_fold: np.ndarray | None = None


def _folded(points: np.ndarray) -> np.ndarray:
    """Code points to lower-case letters, 0 for what isn't a letter."""
    global _fold
    if _fold is None:
        _fold = np.zeros(0x10000, np.int32)
        for c in range(0x10000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                _fold[c] = ord(low) if len(low) == 1 and ord(low) < 0x10000 else c
    out = _fold[np.minimum(points, 0xFFFF)]
    high = np.flatnonzero(points > 0xFFFF)
    if len(high):
        for c in np.unique(points[high]):
            low = chr(c).lower() if chr(c).isalpha() else ""
            out[high[points[high] == c]] = ord(low) if len(low) == 1 else 0
    return out


def streams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, text number of each or -1, letters per text): each text after ORDER-1 blanks, runs of other than letters as one blank."""
    points = np.frombuffer(bytes(data).decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    starts = W.char_starts(data)[offsets] if len(points) == int(((data & 0xC0) != 0x80).sum()) else offsets
    symbol = _folded(points)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(starts))
    first = np.zeros(len(symbol), bool)
    first[starts[:-1][starts[:-1] < len(symbol)]] = True
    blank_before = np.concatenate([[True], symbol[:-1] == 0]) | first
    keep = (symbol != 0) | ~blank_before
    symbol, row = symbol[keep], row[keep]
    letters = np.bincount(row[symbol != 0], minlength=len(offsets) - 1)
    count = np.bincount(row, minlength=len(offsets) - 1)
    pad = ORDER - 1
    out = np.zeros(len(symbol) + pad * len(count), np.int32)
    own = np.full(len(out), -1, np.int64)
    place = np.arange(len(symbol)) + pad * (row + 1)
    out[place], own[place] = symbol, row
    return out, own, letters


class HashArray:
    """Sorted 64-bit hashes with a directory on their leading bits."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes  # sorted, each once
        bits = max(int(len(hashes)).bit_length() + 1, 1)
        self.shift = np.uint64(64 - bits)
        self.start = np.searchsorted(hashes >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Position of each hash, or -1."""
        bucket = (h >> self.shift).astype(np.int64)
        at, end = self.start[bucket], self.start[bucket + 1]
        out = np.full(len(h), -1, np.int32)
        open_ = np.flatnonzero(at < end)
        at, end, h = at[open_], end[open_], h[open_]
        while len(open_):
            hit = self.hashes[at] == h
            out[open_[hit]] = at[hit]
            at = at + 1
            go = ~hit & (at < end)
            open_, at, end, h = open_[go], at[go], end[go], h[go]
        return out


def gram_hashes(stream: np.ndarray) -> list[np.ndarray]:
    """For m from 0 to ORDER the hashes of the last m symbols at each place of a stream; any code point is a symbol."""
    v = W.mix(stream.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    out = [np.zeros(len(v), np.uint64)]
    for m in range(1, ORDER + 1):
        h = out[-1].copy()
        if len(v) >= m:
            h[m - 1 :] += v[: len(v) - m + 1] * _FACTORS[m - 1]
        out.append(h)
    return out


class Models:
    """All languages' models; learned from ``texts`` by language."""

    def __init__(self, texts: dict[str, list[str]]):
        self.languages = sorted(texts)
        held = {lang: [t for i, t in enumerate(own) if i % 5 == 4] for lang, own in texts.items()}
        used = {lang: [t for i, t in enumerate(own) if i % 5 != 4] for lang, own in texts.items()}
        self._learn({lang: streams(*_joined(own))[:2] for lang, own in used.items()})
        self._calibrate(held if all(held.values()) else used)

    def _learn(self, raw: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        """Types of every order with their counts: occurrences for the longest, distinct left neighbours for others."""
        types: dict[str, list] = {}
        for lang, (stream, own) in raw.items():
            h, place = gram_hashes(stream), np.flatnonzero(own >= 0)
            kept: list = [None] * (ORDER + 1)
            for m in range(ORDER, 0, -1):
                code, first, count = np.unique(h[m][place], return_index=True, return_counts=True)
                place = place[first]
                kept[m] = (code, count, h[m - 1][place - 1], h[m - 1][place])  # and of its context and its suffix
            types[lang] = kept
        n = len(self.languages)
        self.table: list = [None] * (ORDER + 1)
        self.context: list = [None] * (ORDER + 1)
        lower, lower_codes = np.empty((0, n)), np.empty(0, np.uint64)
        for m in range(1, ORDER + 1):
            code, _, context, suffix = (np.concatenate([types[x][m][k] for x in self.languages]) for k in range(4))
            union, first = np.unique(code, return_index=True)
            context, suffix = context[first], suffix[first]
            contexts = np.unique(context)
            if m == 1:
                lower, lower_codes = np.full((1, n), 1.0 / (len(union) + 1)), np.zeros(1, np.uint64)  # uniform over what was seen and one more
            seen, backoff = np.zeros((len(union), n)), np.ones((len(contexts), n))
            for k, lang in enumerate(self.languages):
                own, count, own_context, _ = types[lang][m]
                if not len(own):
                    continue
                ones, twos = int((count == 1).sum()), int((count == 2).sum())
                discount = ones / (ones + 2 * twos) if ones and twos else 0.75
                place = np.searchsorted(contexts, own_context)
                total = np.bincount(place, count, len(contexts))
                kinds = np.bincount(place, minlength=len(contexts))
                got = total > 0
                backoff[got, k] = np.maximum(discount * kinds[got] / total[got], 1e-6)
                seen[np.searchsorted(union, own), k] = np.maximum(count - discount, 0) / total[place]
            p = seen + backoff[np.searchsorted(contexts, context)] * lower[np.searchsorted(lower_codes, suffix)]
            if m == 1:
                whole = backoff[0] if len(contexts) else np.ones(n)
                self.unknown = np.log(whole / (len(union) + 1)).astype(np.float32)
            self.table[m] = HashArray(union), np.log(p).astype(np.float32)
            self.context[m] = HashArray(contexts), np.log(backoff).astype(np.float32)
            lower, lower_codes = p, union

    def log_probabilities(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log-probability of each symbol by language, its text, letters of each text)."""
        stream, own, letters = streams(data, offsets)
        h, place = gram_hashes(stream), np.flatnonzero(own >= 0)
        log_p = np.zeros((len(place), len(self.languages)), np.float32)
        open_ = np.arange(len(place))
        for m in range(ORDER, 0, -1):
            hashes, values = self.table[m]
            at = hashes.find(h[m][place[open_]])
            hit = at >= 0
            log_p[open_[hit]] += values[at[hit]]
            open_ = open_[~hit]
            if m == 1:
                log_p[open_] += self.unknown
                break
            hashes, values = self.context[m]
            at = hashes.find(h[m - 1][place[open_] - 1])
            hit = at >= 0
            log_p[open_[hit]] += values[at[hit]]
        return log_p, own[place], letters

    def cross_entropies(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nats per symbol by text and language, symbols, letters)."""
        log_p, row, letters = self.log_probabilities(data, offsets)
        texts = len(offsets) - 1
        symbols = np.bincount(row, minlength=texts)
        sums = np.stack([np.bincount(row, log_p[:, k], texts) for k in range(len(self.languages))], axis=1)
        return -sums / np.maximum(symbols, 1)[:, None], symbols, letters

    def _calibrate(self, held: dict[str, list[str]]) -> None:
        n = len(self.languages)
        self.mean, self.between, self.within = np.zeros(n), np.full(n, 1e-3), np.ones(n)
        margins, right, scored = [np.zeros(0)], [np.zeros(0)], []
        for k, lang in enumerate(self.languages):
            data, offsets = _joined(held[lang])
            log_p, row, letters = self.log_probabilities(data, offsets)
            ce, symbols, _ = self.cross_entropies(data, offsets)
            ce, symbols = ce[letters > 0], symbols[letters > 0]
            if not len(ce):
                continue
            margins.append(_margin(ce))
            right.append(ce.argmin(axis=1) == k)
            self.mean[k], self.within[k] = ce[:, k].mean(), max(float(log_p[:, k].var()), 1e-3)
            self.between[k] = max(float((ce[:, k] - self.mean[k]).var() - (self.within[k] / symbols).mean()), 1e-3)
            scored.append((k, ce, symbols))
        inside = [float(self._excess(ce, symbols)[np.arange(len(ce)), ce.argmin(axis=1)].max(initial=0.0)) for _, ce, symbols in scored]
        outside = [np.zeros(0)]
        for k, ce, symbols in scored:  # texts of a language that is taken away, and the held-back texts' letters in any order
            if n > 1:
                others = np.delete(np.arange(n), k)
                best = others[ce[:, others].argmin(axis=1)]
                outside.append(self._excess(ce, symbols)[np.arange(len(ce)), best][symbols >= 40])
            mixed = _shuffled(held[self.languages[k]])
            ce, symbols, letters = self.cross_entropies(*_joined(mixed))
            outside.append(self._excess(ce, symbols)[np.arange(len(ce)), ce.argmin(axis=1)][(letters > 0) & (symbols >= 40)])
        most, others = max(inside, default=0.0), np.concatenate(outside)
        least = float(np.quantile(others, 0.05)) if len(others) else np.inf
        self.ceiling = max(1.5 * most, least if np.isfinite(least) else 3 * most)
        x, y = np.concatenate(margins), np.concatenate(right).astype(float)
        y = (y * len(y) + 0.5) / (len(y) + 1)  # never quite certain
        a = 1.0
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(a * x, -30, 30)))
            a -= 0.5 * (((p - y) * x).sum() + 1e-3 * (a - 1)) / ((np.maximum(p * (1 - p), 1e-4) * x * x).sum() + 1e-3)
        self.slope = max(float(a), 0.1)

    def _excess(self, ce: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """How many standard deviations a text of so many symbols lies above each language's held-back mean."""
        return (ce - self.mean) / np.sqrt(self.between + self.within / np.maximum(symbols, 1)[:, None])

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, cross-entropy, rejected) of each text."""
        ce, symbols, letters = self.cross_entropies(data, offsets)
        best = ce.argmin(axis=1)
        at = np.arange(len(ce)), best
        score = 1 / (1 + np.exp(-np.clip(self.slope * _margin(ce), -30, 30)))
        none = letters == 0
        rejected = none | (self._excess(ce, symbols)[at] > self.ceiling)
        return ["und" if n else self.languages[k] for n, k in zip(none, best, strict=True)], np.where(none, 0.0, score), np.where(none, np.nan, ce[at]), rejected


def _shuffled(texts: list[str]) -> list[str]:
    """Each text's characters in an order drawn from a fixed seed."""
    rng = np.random.default_rng(17)
    return ["".join(rng.permutation(list(t)).tolist()) if t else "" for t in texts]


def _margin(ce: np.ndarray) -> np.ndarray:
    if ce.shape[1] < 2:
        return np.ones(len(ce))
    two = np.partition(ce, 1, axis=1)
    return two[:, 1] - two[:, 0]


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]).astype(np.int64)


def learn(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 400) -> Models | None:
    """Models from about ``per_language`` rows a language, chosen by a hash of the id; None without labels."""
    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().toLocalIterator()}
    if not counts:
        return None
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(11)), F.lit(1 << 40))
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(int(min(1.0, per_language / n) * (1 << 40))))])
    sample = rows.where(draw < F.try_element_at(share, F.col(lang_col))).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), draw.alias("draw"))
    texts: dict[str, list[str]] = {}
    for r in sorted(sample.collect(), key=lambda r: (r["lang"], r["draw"], r["text"])):
        texts.setdefault(r["lang"], []).append(r["text"])
    return Models(texts) if texts else None


def identify(df: DataFrame, models: Models | None, *, text_col: str = "text") -> DataFrame:
    """``df`` with lang_pred, score, cross_entropy and rejected."""
    names = ["lang_pred", "score", "cross_entropy", "rejected"]
    if clash := [n for n in names if n in df.columns]:
        df = df.drop(*clash)
    if models is None:
        return df.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "cross_entropy": F.lit(None).cast("double"), "rejected": F.lit(True)})
    shipped = df.sparkSession.sparkContext.broadcast(models)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in W.text_slices(batch.column(at), 256 << 10):
                lang, score, ce, rejected = shipped.value.predict(data, offsets)
                own = batch.slice(a, b - a)
                new = [pa.array(lang), pa.array(score), pa.array(ce, from_pandas=True), pa.array(rejected)]
                yield pa.RecordBatch.from_arrays([*own.columns, *new], names=[*batch.schema.names, *names])

    return df.mapInArrow(W.tidied(run), f"{_ddl(df)}, lang_pred string, score double, cross_entropy double, rejected boolean")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def remainder(id_col: str, modulus: int):
    """crc32 of the id as text modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    """Contract view: learns where crc32(doc_id) mod 3 is not 1, predicts every document."""
    docs = table(spark, sf_dir, "documents")
    models = learn(docs.where(remainder("doc_id", 3) != 1))
    held = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return identify(docs.select("doc_id", "text", held), models).drop("text")
