"""Toxicity by labelled neighbours: exact TF-IDF cosine over a block-max inverted index.

A bounded sample of labelled texts (``per_class`` of each label, chosen by a
hash of the id) are the examples.  Terms are all words that two of them or more
hold; a term's weight is its inverse document frequency, counted over all
documents, times how well it tells the labels apart: its chi-square over
``telling``, within ``floor`` and 1.  So every example has a vector, words that
tell decide where there are any, and other words elsewhere.  Every text's
vector is compared with the examples exactly, many texts at once: postings are
kept by term and block of examples, with each block's greatest weight.  Those
of words that few examples hold are added up whole and bound the blocks
together with the greatest weights of the frequent ones; the blocks of the
highest bounds are scored first, then all whose bound reaches the k-th best
cosine, a block's frequent words in one product for all texts that need it.
What comes near the k-th best is then summed again by itself in double
precision, so a text's result doesn't depend on the texts beside it.  Examples
that tie with the k-th all vote.  Votes weigh by closeness and by
their label's share among all labelled rows; a logistic curve fitted on
leave-one-out votes calibrates the score.

Texts without any of the terms (null and empty ones too) get the calibrated
share of toxic examples among the examples without any, and long texts are
taken whole. Without labels of both kinds every score is the only label's
value, or 0. Of several labels of an id the graver counts; repeated rows keep a
row each, and equal texts equal scores; ids in several rows are examples once a
text. Columns named ``score`` or ``evidence`` are replaced, others kept; an empty
table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.llm import words as W
from kelpline.llm.langid import remainder
from kelpline.llm.store import table

BLOCK = 64


def term_counts(data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, count) of the terms (sorted hashes) in some texts, sorted."""
    words = W.split_words(data, offsets)
    if not len(hashes) or not len(words.hash):
        return (np.empty(0, np.int64),) * 3
    at = np.minimum(np.searchsorted(hashes, words.hash), len(hashes) - 1)
    hit = hashes[at] == words.hash
    key, count = np.unique(W.row_of(words.first)[hit] * len(hashes) + at[hit], return_counts=True)
    return key // len(hashes), key % len(hashes), count


class Neighbours:
    """Examples' unit vectors in an inverted index with block maxima.

    ``pair_*`` are the (term, block) pairs in order: block, greatest weight, and where the pair's postings begin;
    ``first`` says where a term's pairs begin.  ``often`` has each example's weights of the frequent terms, ``top`` their
    greatest in each block, and ``frequent`` a term's place in both, or -1.
    """

    ROUND = 4  # blocks in the first round
    SHARE, DENSE = 1 / 16, 1024  # frequent terms are in such a share of examples; at most so many
    CELLS, WEIGHTS = 1 << 19, 1 << 24  # sums, and postings of rare terms, at once (or one text's); weights of frequent terms
    MARGIN = 2e-4  # more than twice what the products of at most DENSE single-precision terms may err, and 1e-6

    def __init__(self, rows: np.ndarray, terms: np.ndarray, counts: np.ndarray, n: int, idf: np.ndarray, labels: np.ndarray, ids: list, weight: tuple[float, float], k: int):
        self.idf, self.k, self.n = idf, k, n
        value = ((1 + np.log(counts)) * idf[terms]).astype(np.float32)
        norm = np.sqrt(np.bincount(rows, value.astype(float) ** 2, n))
        value /= np.maximum(norm, 1e-12)[rows].astype(np.float32)
        strongest = np.full(n, len(idf))  # like examples share blocks
        order = np.lexsort((value, rows))
        last = np.flatnonzero(np.append(rows[order][1:] != rows[order][:-1], True)) if len(rows) else np.empty(0, np.int64)
        strongest[rows[order][last]] = terms[order][last]
        place = np.empty(n, np.int64)
        placed = np.lexsort((np.arange(n), strongest, norm == 0))
        place[placed] = np.arange(n)
        example = place[rows]
        order = np.lexsort((example, terms))
        self.example, self.value, term = example[order].astype(np.int32), value[order], terms[order]
        block = self.example // BLOCK
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        begin = np.flatnonzero(new)
        self.pair_block, self.pair_at = block[begin], np.append(begin, len(term))
        self.pair_top = np.maximum.reduceat(self.value, begin) if len(begin) else np.empty(0, np.float32)
        self.first = np.searchsorted(term[begin], np.arange(len(idf) + 1))
        self.blocks = -(-n // BLOCK)
        held = np.diff(self.pair_at[self.first])
        most = np.lexsort((np.arange(len(idf)), -held))[: min(self.DENSE, self.WEIGHTS // max(n, 1))]
        most = np.sort(most[held[most] >= max(n * self.SHARE, 1)])
        self.frequent = np.full(len(idf), -1)
        self.frequent[most] = np.arange(len(most))
        self.top = np.zeros((len(most), self.blocks), np.float32)
        self.often = np.zeros((self.blocks * BLOCK, len(most)), np.float32)
        for t in most:
            pairs = slice(self.first[t], self.first[t + 1])
            self.top[self.frequent[t], self.pair_block[pairs]] = self.pair_top[pairs]
            own = slice(self.pair_at[pairs.start], self.pair_at[pairs.stop])
            self.often[self.example[own], self.frequent[t]] = self.value[own]
        self.labels, self.ids, self.norm = labels[placed], [ids[i] for i in placed], norm[placed]
        self.vote = np.where(self.labels == 1, weight[1], weight[0])
        none = self.norm == 0
        own = self.vote * none
        self.nothing = float(((own * self.labels).sum() + self.share()) / (own.sum() + 1))
        self.slope, self.offset = 1.0, 0.0
        self._calibrate()

    @staticmethod
    def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return np.arange(int(size.sum())) + np.repeat(start - np.cumsum(size) + size, size)

    def share(self) -> float:
        return float((self.vote * self.labels).sum() / self.vote.sum())

    def search(self, terms: np.ndarray, weights: np.ndarray, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """All examples whose cosine is at least the k-th best, with it; zero cosines only where there are no others."""
        return next(self.search_all(np.array([0, len(terms)]), terms, weights, np.array([without])))

    def search_all(self, cut: np.ndarray, terms: np.ndarray, weights: np.ndarray, without: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """:meth:`search` of several texts in order; text i has the terms ``cut[i]:cut[i + 1]``."""
        without = np.full(len(cut) - 1, -1) if without is None else without
        rare = np.where(self.frequent[terms] < 0, self.pair_at[self.first[terms + 1]] - self.pair_at[self.first[terms]], 0)
        total = np.append(0, np.cumsum(rare))[cut]
        i = 0
        while i < len(cut) - 1:
            upto = int(np.searchsorted(total, total[i] + self.CELLS, "right")) - 1
            upto = min(max(min(upto, i + self.CELLS // (self.blocks * BLOCK)), i + 1), len(cut) - 1)
            own = slice(cut[i], cut[upto])
            yield from self._some(cut[i : upto + 1] - cut[i], terms[own], weights[own], rare[own], without[i:upto])
            i = upto

    def _some(self, cut: np.ndarray, terms: np.ndarray, weights: np.ndarray, rare: np.ndarray, without: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """:meth:`search_all` of as many texts as go at once; ``rare`` counts the postings of terms that aren't frequent."""
        m, width = len(cut) - 1, self.blocks * BLOCK
        row = W.row_of(cut)
        posting = self._ranges(self.pair_at[self.first[terms]], rare)
        s = np.bincount(np.repeat(row * width, rare) + self.example[posting], np.repeat(weights, rare) * self.value[posting], m * width).reshape(m, width)
        left = np.flatnonzero(without >= 0)
        s[left, without[left]] = -2
        about = s.astype(np.float32)
        at = self.frequent[terms]
        texts = np.zeros((m, len(self.top)), np.float32)
        texts[row[at >= 0], at[at >= 0]] = weights[at >= 0]
        bounds = about.reshape(m, self.blocks, BLOCK).max(axis=2) + texts @ self.top
        chosen = np.ones((m, self.blocks), bool)
        if self.blocks > self.ROUND:
            chosen[:] = False
            np.put_along_axis(chosen, np.argpartition(-bounds, self.ROUND, axis=1)[:, : self.ROUND], True, axis=1)
        least = np.zeros(m)
        for blocks in (chosen, ~chosen):
            blocks &= (bounds > 0) & (bounds > least[:, None] - self.MARGIN)
            for block in np.flatnonzero(blocks.any(axis=0)):
                own = slice(block * BLOCK, (block + 1) * BLOCK)
                some = np.flatnonzero(blocks[:, block])
                if 2 * len(some) > m:  # without copies of rows
                    some = slice(None)
                about[some, own] = s[some, own] + texts[some] @ self.often[own].T
            if width >= self.k:  # what isn't scored counts with less than its cosine
                least = np.maximum(np.partition(about, width - self.k, axis=1)[:, width - self.k], 0)
        row, at = np.nonzero((about > 0) & (about >= least[:, None] - self.MARGIN))
        for i, at in enumerate(np.split(at, np.searchsorted(row, np.arange(1, m)))):
            sims = s[i, at] + (self.often[at] * texts[i]).astype(float).sum(axis=1)
            last = float(np.partition(sims, len(sims) - self.k)[len(sims) - self.k]) if len(sims) >= self.k else 0.0
            keep = sims >= last - 1e-6
            order = np.lexsort((at[keep], -sims[keep].round(6)))
            yield at[keep][order], sims[keep][order]

    def raw(self, at: np.ndarray, sims: np.ndarray) -> float:
        if not len(at):
            return self.nothing
        w = self.vote[at] / (1.05 - np.minimum(sims, 1))
        prior = 0.5 * float(np.mean(self.vote)) / 1.05
        return float(((w * self.labels[at]).sum() + prior * self.share()) / (w.sum() + prior))

    def calibrated(self, raw: float) -> float:
        raw = min(max(raw, 1e-4), 1 - 1e-4)
        return float(1 / (1 + np.exp(-(self.slope * np.log(raw / (1 - raw)) + self.offset))))

    def _calibrate(self) -> None:
        x = np.full(self.n, self.nothing)
        order = np.argsort(self.example, kind="stable")
        term = np.repeat(np.repeat(np.arange(len(self.idf)), np.diff(self.first)), np.diff(self.pair_at))
        some = np.flatnonzero(self.norm > 0)
        cut = np.searchsorted(self.example[order], np.append(some, self.n))
        for i, near in zip(some, self.search_all(cut, term[order], self.value[order], some), strict=True):
            x[i] = self.raw(*near)
        x = np.clip(x, 1e-4, 1 - 1e-4)
        x, w, y = np.log(x / (1 - x)), self.vote / self.vote.mean(), self.labels
        a, b = 1.0, 0.0
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
            v = np.maximum(w * p * (1 - p), 1e-6)
            g = np.array([(w * (p - y) * x).sum() + (a - 1), (w * (p - y)).sum() + 0.1 * b])
            h = np.array([[(v * x * x).sum() + 1, (v * x).sum()], [(v * x).sum(), v.sum() + 0.1]])
            step = np.linalg.solve(h, g)
            a, b = a - 0.7 * step[0], b - 0.7 * step[1]
        self.slope, self.offset = max(float(a), 0.05), float(b)


def learn(labelled: DataFrame, documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 1500, telling: float = 30.0, floor: float = 0.2, k: int = 25) -> tuple[np.ndarray, Neighbours] | float:
    """(sorted hashes of the terms, index), or the constant score where labels don't tell."""
    spark = documents.sparkSession
    known = labelled.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    known = known.groupBy("id").agg(F.max("y").alias("y"))  # of several labels the graver
    totals = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    if len(totals) < 2:
        return float(next(iter(totals), 0))
    draw = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 40))
    limit = F.when(F.col("y") == 1, F.lit(int(min(1, per_class / totals[1]) * (1 << 40)))).otherwise(F.lit(int(min(1, per_class / totals[0]) * (1 << 40))))
    chosen = known.where(draw < limit)
    texts = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(chosen), "id").distinct().collect()  # about 2 * per_class ids, whole texts
    sample = sorted({(r["id"], r["text"], r["y"]) for r in sample})
    y = np.array([r[2] for r in sample])
    if len(set(y)) < 2:
        return float(y[0]) if len(y) else 0.0
    raw = [r[1].encode() for r in sample]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]).astype(np.int64)
    words = W.split_words(data, offsets)
    hashes, which = np.unique(words.hash, return_inverse=True)
    which, row = np.divmod(np.unique(which * len(y) + W.row_of(words.first)), len(y))
    toxic = np.bincount(which, y[row], len(hashes))
    both = np.bincount(which, minlength=len(hashes))
    n1, n = y.sum(), len(y)
    a, b, c, d = toxic, both - toxic, n1 - toxic, (n - n1) - (both - toxic)
    chi = n * (a * d - b * c) ** 2 / np.maximum((a + b) * (c + d) * (a + c) * (b + d), 1e-9)
    usable = np.flatnonzero(both >= 2)
    if not len(usable):
        usable = np.arange(len(hashes))
    picked, tells = hashes[usable], np.clip(chi[usable] / telling, floor, 1.0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(len(picked), np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for _, _, data, offsets in W.text_slices(batch.column(0)):
                df += np.bincount(term_counts(data, offsets, picked)[1], minlength=len(picked))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int32()), pa.array([rows, *df[at].tolist()], pa.int64())], names=["term", "n"])

    counted = {r[0]: r[1] for r in texts.select("text").mapInArrow(W.tidied(count), "term int, n long").groupBy("term").agg(F.sum("n")).collect()}
    df = np.array([counted.get(i, 0) for i in range(len(picked))])
    idf = (np.log((1 + counted.get(-1, 0)) / (1 + df)) + 1) * tells
    index = Neighbours(*term_counts(data, offsets, picked), n, idf, y, [r[0] for r in sample], (totals[0] / max((y == 0).sum(), 1), totals[1] / max(n1, 1)), k)
    return picked, index


def score(df: DataFrame, model, *, text_col: str = "text") -> DataFrame:
    """``df`` with score and evidence (nearest examples' ids and cosines)."""
    names = ["score", "evidence"]
    df = df.drop(*[n for n in names if n in df.columns])
    if isinstance(model, float):
        return df.withColumns({"score": F.lit(model), "evidence": F.array().cast("array<struct<id:string,cosine:double>>")})
    shipped = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_col)
    kind = pa.list_(pa.struct([("id", pa.string()), ("cosine", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, index = shipped.value
        nothing = index.calibrated(index.nothing)
        seen: dict[bytes, tuple] = {}
        for batch in batches:
            for a, b, data, offsets in W.text_slices(batch.column(at)):
                row, term, count = term_counts(data, offsets, hashes)
                weight = ((1 + np.log(count)) * index.idf[term]).astype(np.float32)
                cut = np.searchsorted(row, np.arange(b - a + 1))
                scores, evidence = np.full(b - a, nothing), [[] for _ in range(b - a)]
                if len(seen) >= 10_000:
                    seen.clear()
                keys, new = {}, {}
                for i in np.flatnonzero(np.diff(cut)):
                    own = slice(cut[i], cut[i + 1])
                    keys[i] = key = term[own].tobytes() + count[own].tobytes()
                    if key not in seen and key not in new:
                        new[key] = np.arange(cut[i], cut[i + 1])
                        weight[own] /= np.sqrt((weight[own] ** 2).sum())
                if new:
                    own = np.concatenate(list(new.values()))
                    near = index.search_all(np.cumsum([0, *map(len, new.values())]), term[own], weight[own])
                    for key, (at_, sims) in zip(new, near, strict=True):
                        seen[key] = index.calibrated(index.raw(at_, sims)), [{"id": str(index.ids[j]), "cosine": float(min(s, 1))} for j, s in zip(at_[:3], sims[:3], strict=True)]
                for i, key in keys.items():
                    scores[i], evidence[i] = seen[key]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(scores), pa.array(evidence, kind)], names=[*batch.schema.names, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(W.tidied(run), f"{schema}, score double, evidence array<struct<id: string, cosine: double>>")


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """Contract view: learns labels where crc32(doc_id) mod 5 is not 0, scores every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = learn(labels.where(remainder("doc_id", 5) != 0), docs)
    held = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    scored = score(docs.select("doc_id", "text", held), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.col("evidence"))
