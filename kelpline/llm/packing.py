"""Best-two-fit packing of tokenised documents into sequences of fixed capacity.

Bin packing only depends on lengths, and a length is one of ``capacity``
values.  So the bins are planned over the histogram of lengths: a bin is
filled greedily with the longest pieces that fit; then its smallest piece is
replaced by the two unplaced pieces that fill its expanded gap most tightly,
if they fill it more.  The same bin repeats while its lengths last, which is
what filling bin after bin would do.  The plan has a row for each (length, run
of ranks); a piece finds its place by its rank among pieces of its length.
Ranks are counted within tasks and shifted by sums over tasks, so equal
lengths never meet in one task.

Null text is empty: one piece of the closing id alone. Longer documents are
cut into full pieces and a rest. Repeated rows keep their pieces each; pieces of
equal length are placed in order of tasks. Other columns are ignored, an empty
table gives an empty one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kelpline.llm import words as W
from kelpline.llm.store import materialise, table


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of texts, kept per run of other than white space; equal to encoding the whole text.

    The vocabulary's splitting never joins across white space and drops it, so
    a text's ids are those of its runs in order.  Texts with one of the special
    strings, or separators the two notions of white space disagree on, are
    encoded whole.  A new run of Latin letters is split into lower-case pieces
    as the vocabulary does, and new pieces go to the merge model directly.
    That is only done for a vocabulary on which both ways agree for a probe.
    """

    KEPT, LONGEST = 400_000, 48
    PROBE = "It's A caf\u00e9, (WE'LL)  12.5 \u00c9t\u00e9!! x_y@z.org \u0152uvre 'tis ''re"

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printed)]
        self.bytes = str.maketrans({b: chr(b) for b in printed} | {b: chr(256 + k) for k, b in enumerate(others)})
        self.clear()
        self.plain = False
        self.plain = list(self._runs(self.PROBE.split())) != list(self._whole(self.PROBE))
        self.clear()

    def shrink(self) -> None:
        """Keeps the half of the runs that were looked up most."""
        keep = np.sort(np.argpartition(-self.uses, self.KEPT // 2)[: self.KEPT // 2])
        runs, sizes = list(self.known), self.lengths[keep]
        place = np.cumsum(sizes) - sizes
        self.pool = self.pool[np.arange(int(sizes.sum())) + np.repeat(self.starts[keep] - place, sizes)]
        self.starts, self.lengths, self.uses = place, sizes, self.uses[keep] // 2
        self.known = {runs[k]: i for i, k in enumerate(keep.tolist())}
        self.pieces = {}

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.pieces: dict[str, list[int]] = {}
        self.starts, self.lengths, self.pool = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)
        self.uses = np.empty(0, np.int64)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _add(self, runs: list[str]) -> None:
        pieces, split, tokens = self.pieces, self.split, self.tokenizer.model.tokenize
        ids_of: list[list[int]] = []
        for run in runs:
            if self.plain or not (run.isascii() or max(run) < "\u0250" and "\u0130" not in run):
                ids_of.append(self._whole(run).tolist())
                continue
            low, body = run.lower(), run[:-1]
            # most runs are a word, or a word and a mark: no need for the pattern
            parts = (low,) if run.isalpha() else (low[:-1], low[-1]) if body.isalpha() and run[-1] in ".,;:!?)|" else split(low)
            for p in parts:
                if p not in pieces:
                    pieces[p] = [t.id for t in tokens(p.encode().decode("latin-1").translate(self.bytes))]
            ids_of.append(pieces[parts[0]] if len(parts) == 1 else [i for p in parts for i in pieces[p]])
        sizes = np.fromiter(map(len, ids_of), np.int64, len(runs))
        self.starts = np.concatenate([self.starts, np.cumsum(sizes) - sizes + len(self.pool)])
        self.lengths = np.concatenate([self.lengths, sizes])
        self.uses = np.concatenate([self.uses, np.zeros(len(runs), np.int64)])
        self.pool = np.concatenate([self.pool, np.fromiter(chain.from_iterable(ids_of), np.uint32, int(sizes.sum()))])
        self.known.update(zip(runs, range(len(self.known), len(self.known) + len(runs)), strict=True))

    def encode(self, text: str) -> np.ndarray:
        if any(s in text for s in self.specials) or any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self._whole(text)
        runs = text.split()
        if not runs:
            return np.empty(0, np.uint32)
        if max(map(len, runs)) > self.LONGEST:
            parts, begin = [], 0
            for i, run in enumerate(runs):
                if len(run) > self.LONGEST:
                    parts += [self._runs(runs[begin:i]), self._whole(run)]
                    begin = i + 1
            return np.concatenate([*parts, self._runs(runs[begin:])])
        return self._runs(runs)

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; all their runs are looked up, and new ones encoded, together."""
        if len(self.known) > self.KEPT:
            self.shrink()
        apart = {i: self._whole(t) for i, t in enumerate(texts) if any(s in t for s in self.specials) or any(c in t for c in "\x1c\x1d\x1e\x1f")}
        split = [[] if i in apart else t.split() for i, t in enumerate(texts)]
        flat = list(chain.from_iterable(split))
        at = np.fromiter(map(self.known.get, flat, repeat(-1)), np.int64, len(flat))
        if len(new := np.flatnonzero(at < 0).tolist()):
            if fresh := {r for i in new if len(r := flat[i]) <= self.LONGEST}:
                self._add(list(fresh))
            at[new] = [self.known.get(flat[i], -1) for i in new]
            if (at < 0).any():  # runs too long to keep
                apart |= {i: self.encode(texts[i]) for i, own in enumerate(split) if any(len(r) > self.LONGEST for r in own)}
                at = np.maximum(at, 0)
        if not self.known:
            return [apart.get(i, np.empty(0, np.uint32)) for i in range(len(texts))]
        self.uses += np.bincount(at, minlength=len(self.uses))
        ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))
        size = self.lengths[at]
        place = np.cumsum(size) - size
        ids = self.pool[np.arange(int(size.sum())) + np.repeat(self.starts[at] - place, size)]
        cuts = np.concatenate([[0], np.append(place, len(ids))[ends]])
        return [apart[i] if i in apart else ids[cuts[i] : cuts[i + 1]] for i in range(len(texts))]

    def _runs(self, runs: list[str]) -> np.ndarray:
        if not runs:
            return np.empty(0, np.uint32)
        get = self.known.get
        at = list(map(get, runs))
        if None in at:
            self._add(list(dict.fromkeys(r for r, k in zip(runs, at, strict=True) if k is None)))
            at = list(map(get, runs))
        at = np.array(at, np.int64)
        size = self.lengths[at]
        place = np.cumsum(size) - size
        return self.pool[np.arange(int(size.sum())) + np.repeat(self.starts[at] - place, size)]


def encoder(path: str) -> Encoder:
    """This process's encoder; it and what it has learned outlive a task."""
    return W.resident(__name__, (path,), lambda: Encoder(path))


def plan(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, first sequence, offset), sorted, and the number of sequences; counts by length."""
    left = counts.astype(np.int64).copy()
    taken = np.zeros(capacity + 1, np.int64)
    rows, sequences = [], 0
    while left.any():
        spare = left.copy()
        gap, bin_ = capacity, []
        top = np.flatnonzero(spare)
        while gap:
            k = int(np.searchsorted(top, gap, "right"))
            while k and not spare[top[k - 1]]:
                k -= 1
            if not k:
                break
            size = int(top[k - 1])
            n = min(int(spare[size]), gap // size)
            bin_ += [size] * n
            spare[size] -= n
            gap -= n * size
        last = bin_[-1]
        if gap:
            room = gap + last
            nearest = np.maximum.accumulate(np.where(spare > 0, np.arange(capacity + 1), 0))  # longest spare of at most so much
            x = np.flatnonzero(spare[: room + 1] > 0)
            if len(x):
                y = nearest[room - x]
                alone = (y == x) & (spare[x] < 2)
                y[alone] = nearest[np.maximum(np.minimum(room - x, x) - 1, 0)][alone]
                best = int(np.argmax(np.where(y > 0, x + y, 0)))
                if y[best] > 0 and x[best] + y[best] > last:
                    bin_ = [*bin_[:-1], *sorted((int(x[best]), int(y[best])), reverse=True)]
        sizes, uses = np.unique(bin_, return_counts=True)
        times = int((left[sizes] // uses).min())
        offset = 0
        for size in bin_:
            rows.append((size, int(taken[size]), sequences, offset))
            taken[size] += times
            offset += size
        left[sizes] -= times * uses
        sequences += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4), sequences


def tokenised_pieces(df: DataFrame, *, id_col: str, text_col: str, capacity: int, tokenizer: str, end_id: int, keep_ids: bool) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids], part, place): ``place`` counts a task's pieces of equal length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_encoder, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for lo in range(0, batch.num_rows, 512):  # rows, not bytes: a text is in memory as a whole anyway
                rows = {k: [] for k in ("at", "piece", "start", "length", "crc", "ids", "place")}
                some = texts.slice(lo, 512).to_pylist()
                for i, ids in enumerate(own_encoder.encode_many(some), lo):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        own = ids[start : start + capacity]
                        for name, x in (("at", i), ("piece", k), ("start", start), ("length", len(own)), ("crc", zlib.crc32(own.tobytes())), ("place", seen[len(own)])):
                            rows[name].append(x)
                        if keep_ids:
                            rows["ids"].append(own.astype(np.int32))
                        seen[len(own)] += 1
                cols = [batch.column(0).take(pa.array(rows["at"], pa.int64())), pa.array(rows["piece"], pa.int32()), *(pa.array(rows[k], pa.int64()) for k in ("start", "length", "crc"))]
                cols += [pa.array(rows["ids"], pa.list_(pa.int32()))] * keep_ids + [pa.array([part] * len(rows["at"]), pa.int32()), pa.array(rows["place"], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids, "part", "place"])

    kind = df.schema[id_col].dataType.simpleString()
    ids = "ids array<int>, " if keep_ids else ""
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(W.tidied(run), f"id {kind}, piece int, start long, length long, ids_crc32 long, {ids}part int, place long")


def pack(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, tokenizer: str | None = None, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, (ids,) sequence_id and offset."""
    pieces = tokenised_pieces(df, id_col=id_col, text_col=text_col, capacity=capacity, tokenizer=tokenizer or default_tokenizer(), end_id=end_id, keep_ids=keep_ids)
    pieces = materialise(pieces, "pieces")
    by_task = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = materialise(by_task.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "shifts")
    counts = np.zeros(capacity + 1, np.int64)
    for r in shifts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        counts[r["length"]] = r["n"]
    rows, _ = plan(counts, capacity)
    shipped = df.sparkSession.sparkContext.broadcast(rows)
    ranked = pieces.join(shifts.select("length", "part", "before").hint("merge"), ["length", "part"])  # grows with tasks: not to be broadcast
    keep = ["id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]
    ranked = ranked.select(*keep, (F.col("before") + F.col("place")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = shipped.value
        key = (table_[:, 0] << 48) + table_[:, 1]
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in (3, len(keep)))
            at = np.searchsorted(key, (length << 48) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(table_[at, 2] + rank - table_[at, 1]), pa.array(table_[at, 3])], names=[*keep, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields[:-1])
    return ranked.mapInArrow(W.tidied(run), f"{schema}, sequence_id long, offset long").withColumnRenamed("id", id_col)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves, from ``pack(..., keep_ids=True)``: sequence_id, ids."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Contract view: one row per piece of every document."""
    return pack(table(spark, sf_dir, "documents"))
