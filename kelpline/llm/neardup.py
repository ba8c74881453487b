"""Near-duplicate documents: consistent weighted sampling over TF-IDF shingles.

1. Document frequencies of five-word shingles, over all documents, go into a
   count-mean-min sketch of fixed size; an inverse document frequency is taken
   at a documented floor (``floor`` of all documents), so the sketch's error,
   relative to the corpus, is the same at every size.
2. Improved consistent weighted sampling draws ``bands * rows`` samples from
   each text's weighted shingles; ``rows`` samples make a band. As many bands
   of plain minima find pairs whose shingles weigh little because their own
   group holds many of the documents.
3. Texts that share a band meet at one hub of that band,
   the one that shares most bands with others; each pair is verified by the
   exact weighted or plain Jaccard similarity (either is enough). In bands whose members still lie in
   several classes every pair of nodes of different classes is compared, in
   blocks of members; what is in one class is done.
4. Classes are the connected components of verified links. Exact copies share
   a class by their digest and take part once.

Texts of one to four words have one shingle; null, empty and word-less texts
only equal their exact copies (null counts as empty). Repeated ids keep one
row each. Other columns are kept, whatever their names; an empty table gives an
empty one. Ties for a class's head go to the least id, null last.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.llm import words as W
from kelpline.llm.components import components
from kelpline.llm.store import materialise, scratch, table

WIDTH, DEPTH = 1 << 17, 2
TABLE_ROWS = 1 << 15
_LIMIT = 256 << 10
_FEATURES = 2048


def weighted_shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle, count in the text), sorted, each shingle of a text once."""
    row, value = W.shingles(W.split_words(data, offsets), size)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return row[at], value[at], np.diff(np.append(at, len(row)))


def _slots(value: np.ndarray) -> list[np.ndarray]:
    return [((value >> np.uint64(20 * k)) % np.uint64(WIDTH)).astype(np.int64) for k in range(DEPTH)]


class Sketch:
    """Shares of all documents that hold a shingle, from the sketch's counters."""

    def __init__(self, counters: np.ndarray, documents: int, floor: float):
        self.counters, self.documents, self.floor = counters.reshape(DEPTH, WIDTH), max(documents, 1), floor
        self.total = self.counters.sum(axis=1)

    def idf(self, value: np.ndarray) -> np.ndarray:
        share = np.full(len(value), np.inf)
        for k, slot in enumerate(_slots(value)):
            c = self.counters[k][slot].astype(float)
            share = np.minimum(share, c - (self.total[k] - c) / (WIDTH - 1))  # less what other shingles add on average
        return np.maximum(-np.log(np.clip(share / self.documents, self.floor, 1.0)), 0.1)


def sketch(df: DataFrame, text_col: str, size: int, floor: float) -> Sketch:
    """Counts over every row of ``df``; tasks send counters of fixed size, in blocks that are summed as they stream."""
    blocks = 16
    each = DEPTH * WIDTH // blocks

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, documents = np.zeros((DEPTH, WIDTH), np.int64), 0
        for batch in batches:
            documents += batch.num_rows
            for _, _, data, offsets in W.text_slices(batch.column(0)):
                _, value, _ = weighted_shingles(data, offsets, size)
                for k, slot in enumerate(_slots(value)):
                    counters[k] += np.bincount(slot, minlength=WIDTH)
        if documents:
            flat = [zlib.compress(x.tobytes(), 1) for x in counters.reshape(blocks, each)]  # mostly small numbers
            yield pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), pa.array(flat, pa.binary()), pa.array([documents] * blocks, pa.int64())], names=["block", "counts", "documents"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                block, counts, documents = (c[i].as_py() for c in batch.columns)
                own = sums.setdefault(block, [np.zeros(each, np.int64), 0])
                own[0] += np.frombuffer(zlib.decompress(counts), np.int64)
                own[1] += documents
        for block, (counts, documents) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary()), pa.array([documents], pa.int64())], names=["block", "counts", "documents"])

    schema = "block int, counts binary, documents long"
    parts = df.select(F.col(text_col).cast("string").alias("text")).mapInArrow(W.tidied(count), schema)
    rows = parts.repartition(blocks, "block").mapInArrow(W.tidied(add), schema).collect()  # blocks rows, of fixed size
    counters = np.zeros((blocks, each), np.int64)
    for r in rows:
        counters[r.block] = np.frombuffer(zlib.decompress(r.counts), np.int64)
    return Sketch(counters.ravel(), rows[0].documents if rows else 0, floor)


class Sampler:
    """Improved consistent weighted sampling: per sample (r, log c, beta) by shingle, from seeded tables."""

    def __init__(self, samples: int, seed: int):
        rng = np.random.default_rng(seed)
        shape = (TABLE_ROWS, samples)
        self.r = rng.gamma(2.0, 1.0, shape).astype(np.float32)
        self.log_c = np.log(rng.gamma(2.0, 1.0, shape)).astype(np.float32)
        self.beta = rng.random(shape, np.float32)
        self.samples = samples

    def draw(self, row: np.ndarray, value: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(texts that have shingles, samples of each as uint32): the sampled shingle together with its level t."""
        log_w = np.log(weight).astype(np.float32)
        best = None
        at = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.empty(0, np.int64)
        best = np.full((len(at), self.samples), np.uint64(0xFFFFFFFFFFFFFFFF))
        which = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(row))))
        for i in range(0, len(row), 4096):
            j = min(i + 4096, len(row))
            place = (value[i:j] % np.uint64(TABLE_ROWS)).astype(np.int64)
            r, beta = self.r[place], self.beta[place]
            t = np.floor(log_w[i:j, None] / r + beta)
            log_a = self.log_c[place] - r * (t - beta) - r
            bits = log_a.view(np.uint32)
            order = np.where(bits >> 31, ~bits, bits | np.uint32(0x80000000))  # floats' order as integers
            tag = (value[i:j] >> np.uint64(32)).astype(np.uint32)[:, None] ^ (t.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1))
            key = (order.astype(np.uint64) << np.uint64(32)) | tag
            cuts = np.flatnonzero(np.concatenate([[True], which[i + 1 : j] != which[i : j - 1]]))
            least = np.minimum.reduceat(key, cuts, axis=0)
            own = which[i + cuts]
            best[own] = np.minimum(best[own], least)
        return row[at], (best & np.uint64(0xFFFFFFFF)).astype(np.uint64)


def plain_samples(row: np.ndarray, value: np.ndarray, samples: int, seed: int) -> np.ndarray:
    """Minima of ``samples`` random permutations over each text's shingles, whatever their weights; ``row`` is sorted."""
    rng = np.random.default_rng(seed)
    factor, shift = (rng.integers(0, 1 << 64, samples, np.uint64, endpoint=False) for _ in range(2))
    factor |= np.uint64(1)
    at = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.empty(0, np.int64)
    best = np.full((len(at), samples), np.uint64(0xFFFFFFFFFFFFFFFF))
    which = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(row))))
    for i in range(0, len(row), 4096):
        j = min(i + 4096, len(row))
        cuts = np.flatnonzero(np.concatenate([[True], which[i + 1 : j] != which[i : j - 1]]))
        least = np.minimum.reduceat(value[i:j, None] * factor + shift, cuts, axis=0)
        own = which[i + cuts]
        best[own] = np.minimum(best[own], least)
    return best


def sampler(samples: int, seed: int) -> Sampler:
    """This process's tables."""
    return W.resident(__name__, (samples, seed), lambda: Sampler(samples, seed))


def band_keys(samples: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` samples; the band's number is part of it."""
    n, total = samples.shape
    parts = samples.reshape(n, total // rows, rows)
    key = np.broadcast_to(np.arange(1, total // rows + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(rows):
        key = W.mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key.view(np.int64)


def signatures(df: DataFrame, sk: Sketch, *, id_col: str, text_col: str, size: int, bands: int, rows: int, seed: int) -> DataFrame:
    """(rid, id, key, bands): a row number, the text's MD5 digest, and its band keys, weighted and plain (none without words)."""
    shipped = df.sparkSession.sparkContext.broadcast(sk)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = sampler(bands * rows, seed).draw
        for batch in batches:
            for a, b, data, offsets in W.text_slices(batch.column(2), _LIMIT):
                row, value, count = weighted_shingles(data, offsets, size)
                which, samples = draw(row, value, count * shipped.value.idf(value))
                keys = np.zeros((0, 2 * bands), np.int64)
                if len(which):
                    plain = band_keys(plain_samples(row, value, bands * rows, seed), rows)
                    keys = np.concatenate([band_keys(samples, rows), ~plain], axis=1)
                has = np.zeros(b - a, np.int64)
                has[which] = 2 * bands
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has)]), pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), lists], names=["id", "key", "bands"])

    kind = df.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = df.select(F.col(id_col).alias("id"), F.unhex(F.md5(text)).alias("key"), text.alias("text")).mapInArrow(W.tidied(run), f"id {kind}, key binary, bands array<long>")
    return materialise(found.select(F.monotonically_increasing_id().alias("rid"), "id", "key", "bands"), "signatures")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two (sorted shingles, weights)."""
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    same = b[0][at] == a[0] if len(b[0]) else np.zeros(len(a[0]), bool)
    both = np.minimum(a[1][same], b[1][at[same]]).sum() if same.any() else 0.0
    total = a[1].sum() + b[1].sum() - both
    return float(both / total) if total > 0 else 0.0


def verified(pairs: DataFrame, texts: DataFrame, sk: Sketch, size: int, threshold: float) -> DataFrame:
    """Of ``pairs`` (u, v) those whose texts' weighted or plain Jaccard similarity reaches ``threshold``, with the greater."""
    shipped = pairs.sparkSession.sparkContext.broadcast(sk)
    left = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("a")), "u")
    full = left.join(texts.select(F.col("node").alias("v"), F.col("text").alias("b")), "v").select("u", "v", "a", "b")

    def weighed(text: str) -> tuple[np.ndarray, np.ndarray]:
        raw = text.encode()
        _, value, count = weighted_shingles(np.frombuffer(raw, np.uint8), np.array([0, len(raw)], np.int64), size)
        return value, count * shipped.value.idf(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hubs: dict[int, tuple] = {}  # the latest second sides: a hub stands in many pairs
        for batch in batches:
            n = batch.num_rows
            keep, sims = [], []
            for i in range(n):
                v = batch.column(1)[i].as_py()
                if v not in hubs:
                    if len(hubs) >= 32:
                        hubs.pop(next(iter(hubs)))
                    hubs[v] = weighed(batch.column(3)[i].as_py() or "")
                sides = [weighed(batch.column(2)[i].as_py() or ""), hubs[v]]
                s = max(similarity(*sides), similarity(*((value, np.ones(len(value))) for value, _ in sides)))
                if s >= threshold:
                    keep.append(i)
                    sims.append(s)
            rows = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(sims, pa.float64())], names=["u", "v", "similarity"])

    return full.mapInArrow(W.tidied(run), "u long, v long, similarity double")


def block_links(texts: list[str], comp: np.ndarray, left: np.ndarray, right: np.ndarray, sk: Sketch, size: int, threshold: float) -> list[tuple[int, int]]:
    """Links that join the classes of all pairs (``left`` x ``right``, of different ``comp``) whose weighted or plain Jaccard
    similarity reaches ``threshold``: every pair is compared, links within a class that others make are left out.

    The sum of lesser weights is a product of matrices over (shingle, k-th time in the text); first times alone make
    the plain intersection.
    """
    flat = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in flat])]).astype(np.int64)
    row, value, count = weighted_shingles(np.frombuffer(b"".join(flat), np.uint8), offsets, size)
    weight = sk.idf(value)
    total, distinct = np.bincount(row, count * weight, len(texts)), np.bincount(row, minlength=len(texts))
    time = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    row, value, weight = (np.repeat(x, count) for x in (row, value, weight))
    value = W.mix(value + time.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, which, n = np.unique(value, return_inverse=True, return_counts=True)
    met = np.flatnonzero(n[which] > 1)
    number = np.cumsum(n > 1) - 1
    row, which, weight, first = row[met], number[which[met]], weight[met], time[met] == 0
    order = np.argsort(which, kind="stable")
    row, which, weight, first = row[order], which[order], weight[order], first[order]
    both, shared = np.zeros((len(left), len(right))), np.zeros((len(left), len(right)))
    cuts = np.searchsorted(which, np.arange(0, which[-1] + 1 + _FEATURES, _FEATURES)) if len(which) else []
    for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        have = np.zeros((len(texts), _FEATURES))
        have[row[i:j], which[i:j] - k * _FEATURES] = 1.0
        each, one = np.zeros(_FEATURES), np.zeros(_FEATURES)
        each[which[i:j] - k * _FEATURES] = weight[i:j]
        one[which[i:j] - k * _FEATURES] = first[i:j]
        a, b = have[left], have[right].T
        both += (a * each) @ b
        shared += (a * one) @ b
    near = np.zeros(both.shape, bool)
    for common, of in ((both, total), (shared, distinct)):
        union = of[left][:, None] + of[right][None, :] - common
        near |= (common >= (threshold - 1e-9) * union) & (union > 0)
    near &= comp[left][:, None] != comp[right][None, :]
    head = {c: c for c in comp.tolist()}
    out = []
    for u, v in np.argwhere(near).tolist():
        a, b = int(left[u]), int(right[v])
        ends = []
        for c in (comp[a], comp[b]):
            c = int(c)
            while head[c] != c:
                head[c] = c = head[head[c]]
            ends.append(c)
        if ends[0] != ends[1]:
            head[ends[0]] = ends[1]
            out.append((a, b))
    return out


def cross_class_links(placed: DataFrame, texts: DataFrame, sk: Sketch, size: int, threshold: float, block: int = 256, block_bytes: int = 1 << 20) -> DataFrame:
    """(u, v) of links that join all classes with a similar pair in a band: each pair of a band's nodes that lie in
    different classes is compared.

    A band's largest class and its other nodes are dealt into blocks of about ``block`` nodes or ``block_bytes`` of text;
    others meet all blocks, the largest class doesn't meet itself. Bands of the same nodes are taken once.
    """
    shipped = placed.sparkSession.sparkContext.broadcast(sk)
    sized = placed.join(texts.select("node", "length"), "node")
    by_class = sized.groupBy("band", "comp").agg(
        F.count("*").alias("n"), F.sum("length").alias("bytes"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("sum"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("xor")
    )
    wide = by_class.groupBy("band").agg(
        F.count("*").alias("classes"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max_by(F.struct("comp", "n", "bytes"), F.struct("n", "comp")).alias("lead"), F.sum("sum").alias("sum"), F.bit_xor("xor").alias("xor")
    )
    wide = wide.where("classes > 1").groupBy("n", "sum", "xor").agg(F.min_by(F.struct("band", "bytes", "lead"), "band").alias("x")).select("n", "x.*")
    blocks = lambda n, size: F.ceil(F.greatest(n / float(block), size / float(block_bytes), F.lit(1.0))).cast("int")
    one = (F.col("n") <= block) & (F.col("bytes") <= block_bytes)
    plan = wide.select(
        "band", F.when(~one, F.col("lead.comp")).alias("lead"), F.when(one, 1).otherwise(blocks(F.col("n") - F.col("lead.n"), F.col("bytes") - F.col("lead.bytes"))).alias("others"),
        F.when(one, 0).otherwise(blocks(F.col("lead.n"), F.col("lead.bytes"))).alias("leads"),
    )
    dealt = placed.join(plan, "band")
    own = F.when(F.coalesce(F.col("comp") == F.col("lead"), F.lit(False)), F.col("others") + F.pmod(F.xxhash64("node"), F.col("leads"))).otherwise(F.pmod(F.xxhash64("node"), F.col("others")))
    dealt = dealt.select("band", "node", "comp", own.cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.when(F.coalesce(F.col("comp") == F.col("lead"), F.lit(False)), F.col("others")).otherwise(F.col("others") + F.col("leads")) - 1)).alias("other"))
    cells = dealt.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "comp")
    # what holds one class only needs no texts
    mixed = cells.groupBy("band", "i", "j").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("band", "i", "j")
    full = materialise(cells.join(mixed, ["band", "i", "j"]), "cells").join(texts.select("node", "text"), "node")

    def compare(rows: list[dict]) -> list[tuple[int, int]]:
        own, comp = (np.array([r[x] for r in rows]) for x in ("own", "comp"))
        left, right = np.flatnonzero(own == rows[0]["i"]), np.flatnonzero(own == rows[0]["j"])
        if not len(left) or not len(right):
            return []
        return [(rows[u]["node"], rows[v]["node"]) for u, v in block_links([r["text"] or "" for r in rows], comp, left, right, shipped.value, size, threshold)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for rows in itertools.chain((b.slice(i, 64).to_pylist() for b in batches for i in range(0, b.num_rows, 64)), [[None]]):
            found = []
            for r in rows:
                if held and (r is None or any(r[x] != held[0][x] for x in ("band", "i", "j"))):
                    found += compare(held)
                    held = []
                if r is not None:
                    held.append(r)
            u, v = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    order = full.select("band", "i", "j", "own", "node", "comp", "text").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    return order.mapInArrow(W.tidied(run), "u long, v long")


def _classes(df: DataFrame, *, id_col: str, text_col: str, size: int, threshold: float, bands: int, rows: int, floor: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """(id and key of each row; by key: comp, its least id, copies)."""
    with scratch(df.sparkSession) as keep:
        sk = sketch(df, text_col, size, floor)
        sig = signatures(df, sk, id_col=id_col, text_col=text_col, size=size, bands=bands, rows=rows, seed=seed)
        texts_of = sig.groupBy("key").agg(F.min("rid").alias("node"), F.min("id").alias("least"), F.count("*").alias("copies"))
        distinct = materialise(texts_of, "texts")
        once = sig.join(distinct.select(F.col("node").alias("rid")), "rid").select(F.col("rid").alias("node"), F.explode("bands").alias("band"))
        once = materialise(once, "bands")
        shared = once.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
        members = materialise(once.join(shared, "band"), "members")  # band, node, n
        # who shares most bands is most like the others: the text that the rest were copied from
        liked = members.groupBy("node").agg((F.sum("n") + F.pmod(F.xxhash64("node"), F.lit(1 << 20)) / float(1 << 20)).alias("liked"))
        hubs = members.join(liked, "node").groupBy("band").agg(F.max_by("node", "liked").alias("hub"))
        needed = members.select("node").distinct()
        ids = sig.join(needed, F.col("rid") == F.col("node")).select(F.col("id").alias("wanted"), "key", "node")
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        own = df.select(F.col(id_col).alias("wanted"), text.alias("text"), F.unhex(F.md5(text)).alias("key"))
        spread = [own["wanted"].eqNullSafe(ids["wanted"]), own["key"] == ids["key"]]
        texts = own.join(ids, spread).select("node", "text", F.octet_length("text").alias("length")).dropDuplicates(["node"])
        texts = materialise(texts, "candidates")

        met = members.join(hubs, "band").where("node <> hub")
        pairs = met.select(F.greatest("node", "hub").alias("u"), F.least("node", "hub").alias("v")).distinct()
        links = materialise(verified(pairs, texts, sk, size, threshold).select("u", "v"), "links")
        classes = components(links)  # node, comp of the linked nodes
        placed = materialise(members.where("n > 2").join(classes, "node", "left").select("band", "node", F.coalesce("comp", "node").alias("comp")), "members")  # two have met
        rest = cross_class_links(placed, texts, sk, size, threshold)
        links = materialise(links.union(rest), "links")
        classes = None if links.isEmpty() else components(links)
        if classes is None:
            placed = distinct.select("key", F.col("node").alias("comp"), "least", "copies")
        else:
            placed = distinct.join(classes, "node", "left").select("key", F.coalesce("comp", "node").alias("comp"), "least", "copies")
        return keep(sig).select("id", "key"), keep(materialise(placed, "placed"))


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8, bands: int = 14, rows: int = 4, floor: float = 0.01, seed: int = 7) -> DataFrame:
    """One row per row of ``df``: its id, ``class_id`` (the least id of its class) and ``class_size`` (rows);
    see the module's text for the method."""
    every, placed = _classes(df, id_col=id_col, text_col=text_col, size=size, threshold=threshold, bands=bands, rows=rows, floor=floor, seed=seed)
    heads = placed.groupBy("comp").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size"))
    named = placed.join(heads, "comp").select("key", "class_id", "class_size")
    return every.join(named, "key").select(F.col("id").alias(id_col), "class_id", "class_size")


def deduplicated(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8, bands: int = 14, rows: int = 4, floor: float = 0.01, seed: int = 7) -> DataFrame:
    """``df`` with one row of each class: that of the least id (null ids last)."""
    _, placed = _classes(df, id_col=id_col, text_col=text_col, size=size, threshold=threshold, bands=bands, rows=rows, floor=floor, seed=seed)
    order = F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("id"), F.col("key"))
    heads = placed.groupBy("comp").agg(F.min(order).alias("head")).select(F.col("head.id").alias("kept"), F.col("head.key").alias("key"))
    own = df.toDF(*[f"c{i}" for i in range(len(df.columns))])  # names that clash with none
    ident, text = (own.columns[df.columns.index(c)] for c in (id_col, text_col))
    keyed = own.withColumn("own_key", F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))))
    kept = keyed.join(heads, (keyed["own_key"] == heads["key"]) & keyed[ident].eqNullSafe(heads["kept"]), "left_semi")
    return kept.dropDuplicates([ident, "own_key"]).drop("own_key").toDF(*df.columns)


def op2_minhash_neardup(spark, sf_dir: str) -> DataFrame:
    """Contract view: one row per document with its class."""
    return near_duplicates(table(spark, sf_dir, "documents"))
