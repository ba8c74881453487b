"""Secret scans: base patterns, and formats learned by grammar inference.

Three base patterns find assignments, access keys and hexadecimal runs.  The
labelled credentials they yield in a bounded sample of the corpus, with
examples of published token formats, train one probabilistic automaton of
characters a format (:mod:`kelpline.llm.automata`); ordinary long tokens of the
same sample train the background: an automaton of character classes, and which
character follows which within them; numbers (addresses, dates, times,
versions, decimals) train a second one.  Every token of the base alphabet with 12
or more characters that is more than numbers and separators, in every text, is
scored by the log-likelihood ratio of the best format over the background.

Ratios of all tokens of all texts make a histogram; how many of them are
credentials is the share that explains it best (expectation maximisation over
the two kinds), and a token whose odds, with that share, are 99 to 1 or better
becomes a span of kind ``format``, where it also gains ``PER_CHARACTER`` nats a
character. Spans within a base span aren't added.

Null and empty texts have no spans; long texts and tokens are scored whole.
Equal ratios get equal verdicts; repeated rows keep a row each. Columns named
``base`` or ``spans`` are replaced, others kept. An empty table gives an empty
one; without ordinary tokens or examples only base spans are found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.llm import automata as A
from kelpline.llm import spans as S
from kelpline.llm import words as W
from kelpline.llm.store import table

ASSIGN = re.compile(r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "format")
#: A token: 12 or more characters, not all of them numbers and separators (those are addresses, dates, versions, sums).
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_.=-])(?=[0-9+/_.=-]*[A-Za-z])[A-Za-z0-9+/_.=-]{12,}")

RUN = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Published token formats: prefix, alphabet of the rest, its length.  Fixed values.
FORMATS = (
    ("AKIA", _UPPER + "234567", 16),
    ("ghp_", _DIGITS + _LOWER + _UPPER, 36),
    ("glpat-", _DIGITS + _LOWER + _UPPER + "_-", 20),
    ("sk_live_", _DIGITS + _LOWER + _UPPER, 24),
    ("xoxb-", _DIGITS + _LOWER + _UPPER + "-", 50),
    ("AIza", _DIGITS + _LOWER + _UPPER + "_-", 35),
    ("eyJ", _DIGITS + _LOWER + _UPPER + "_-", 60),
    ("", _DIGITS + "abcdef", 40),
    ("", _DIGITS + _LOWER + _UPPER + "+/", 40),
)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by start, then kind as listed."""
    found = []
    if ":" in text or "=" in text:
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


class Formats:
    """The learned automata, the background and the threshold."""

    PER_CHARACTER = 1.0  # nats that a credential gains on ordinary text, at least
    LEAST, ODDS = 10.0, 99.0
    LOW, HIGH = -400, 400  # of the histogram, a nat a bin

    def __init__(self, examples: dict[str, list[str]], ordinary: list[str]):
        """Each half of the ordinary tokens is scored by what the other half teaches; those that look like a format
        are set aside, as unlabelled credentials, and the rest is the background."""
        self.formats = [A.Automaton(own, of=A.CHARACTER_OF) for own in examples.values() if own]
        self.threshold, kept = self.LEAST, []
        for own, other in ((ordinary[::2], ordinary[1::2]), (ordinary[1::2], ordinary[::2])):
            self._learn(other or own)
            kept += [t for t, ratio in zip(own, self.scores(own), strict=True) if ratio <= self.PER_CHARACTER * len(t)]
        self._learn(kept or ordinary)

    def calibrate(self, histogram: np.ndarray) -> None:
        """The threshold from counts of all tokens' ratios, a bin a nat from LOW to HIGH."""
        total = histogram.sum()
        if not total:
            return
        odds = np.exp(np.clip(np.arange(self.LOW, self.HIGH + 1), -50, 50))
        share = 0.01
        for _ in range(200):
            share = float((histogram * (share * odds / (share * odds + 1 - share))).sum() / total)
            share = min(max(share, 1 / (total + 1)), 0.5)
        self.threshold = max(float(np.log((1 - share) / share * self.ODDS)), self.LEAST)

    def _learn(self, ordinary: list[str]) -> None:
        ordinary = sorted({*ordinary, *(w.upper() for w in ordinary), *(w.lower() for w in ordinary), *(w.capitalize() for w in ordinary)})  # words shout and whisper, and begin sentences
        figures = numbers(40, 7)
        self.background = [A.Automaton(ordinary, restart=True), A.Automaton(figures)]
        pairs = np.full((256, 256), 0.02)
        for w in [*ordinary, *figures]:
            c = self._folded(w)
            np.add.at(pairs, (c[:-1], c[1:]), 1)
        self.pair = np.log(pairs / pairs.sum(axis=1, keepdims=True))
        share = pairs.sum(axis=1)  # of characters by class, to take the class's part out of a pair's
        self.in_class = np.zeros(256)
        for chars in A.CLASSES:
            at = [ord(c.lower()) for c in chars]
            self.in_class[[ord(c) for c in chars]] = np.log(share[at].sum() / share.sum())

    def scores(self, tokens: list[str]) -> np.ndarray:
        """Log-likelihood ratio of each token."""
        out = np.empty(len(tokens))
        if not tokens:
            return out
        order, codes, lengths = A.padded(tokens, A.CHARACTER_OF)
        ratio = A.log_likelihoods(self.formats, codes, lengths) - A.log_likelihoods(self.background, _CLASS_OF_CHARACTER[codes], lengths)
        out[order] = ratio
        usual = np.empty(len(tokens))
        for i, t in enumerate(tokens):
            c = self._folded(t)
            usual[i] = self.pair[c[:-1], c[1:]].sum() - self.in_class[np.frombuffer(t.encode(), np.uint8)[1:]].sum()
        return out - usual

    def is_credential(self, tokens: list[str]) -> np.ndarray:
        return self.verdicts(tokens, self.scores(tokens))

    def verdicts(self, tokens: list[str], scores: np.ndarray) -> np.ndarray:
        return scores > np.maximum(self.threshold, [self.PER_CHARACTER * len(t) for t in tokens])

    @staticmethod
    def _folded(token: str) -> np.ndarray:
        return np.frombuffer(token.lower().encode(), np.uint8)


_CLASS_OF_CHARACTER = A.CLASS_OF[np.frombuffer(A.CHARACTERS.encode(), np.uint8)]


class Scored:
    """Scores of tokens, each computed once while they are held."""

    KEPT = 300_000

    def __init__(self, formats: Formats):
        self.formats, self.known = formats, {}

    def add(self, tokens: set[str]) -> None:
        fresh = [t for t in tokens if t not in self.known]
        if len(self.known) + len(fresh) > self.KEPT:
            self.known.clear()
            fresh = list(tokens)
        fresh.sort(key=len)
        for k in range(0, len(fresh), 2000):  # of like length
            part = fresh[k : k + 2000]
            self.known.update(zip(part, self.formats.scores(part).tolist(), strict=True))


def numbers(per_kind: int, seed: int) -> list[str]:
    """Tokens of figures that are no credentials, alone and beside a word."""
    rng = np.random.default_rng(seed)
    n = lambda low, high: int(rng.integers(low, high))
    kinds = (
        lambda: ".".join(str(n(0, 256)) for _ in range(4)),
        lambda: f"{n(1970, 2070)}-{n(1, 13):02d}-{n(1, 29):02d}",
        lambda: f"{n(1, 29):02d}.{n(1, 13):02d}.{n(1970, 2070)}",
        lambda: f"{n(1970, 2070)}/{n(1, 13):02d}/{n(1, 29):02d}",
        lambda: f"{n(1970, 2070)}{n(1, 13):02d}{n(1, 29):02d}T{n(0, 24):02d}{n(0, 60):02d}{n(0, 60):02d}Z",
        lambda: f"v{n(0, 30)}.{n(0, 60)}.{n(0, 20)}",
        lambda: f"{n(0, 30)}.{n(0, 60)}.{n(0, 20)}-{rng.choice(['rc', 'beta', 'alpha', 'ubuntu', 'dev', 'final', 'release'])}.{n(0, 99)}",
        lambda: f"{n(0, 10**6)}.{n(0, 10**6)}",
        lambda: f"+{n(1, 99)}-{n(100, 999)}-{n(100, 999)}-{n(1000, 9999)}",
    )
    words = ("ip", "host", "date", "build", "log", "tar", "gz", "version", "page", "id", "node", "copy", "txt")
    beside = lambda x: rng.choice([f"{rng.choice(words)}{rng.choice(list('=-_./'))}{x}", f"{x}{rng.choice(list('-_./'))}{rng.choice(words)}"])
    return [w for make in kinds for _ in range(per_kind) for x in [make()] for w in (x, str(beside(x)))]


def published(per_format: int, seed: int) -> dict[str, list[str]]:
    rng = np.random.default_rng(seed)
    return {f"{prefix}{n}": [prefix + "".join(rng.choice(list(alphabet), n)) for _ in range(per_format)] for prefix, alphabet, n in FORMATS}


def learn(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 4000, per_kind: int = 150, seed: int = 3) -> Formats | None:
    """Formats from about ``sample_rows`` texts, chosen by a hash; ``per_kind`` examples a kind and ordinary tokens tenfold."""
    total = df.count()
    if not total:
        return None
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 40)) < int(min(1.0, sample_rows / total) * (1 << 40))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, values = [], []
            for text in batch.column(0).to_pylist():
                spans = base_spans(text)
                for kind, a, b in spans:
                    own = RUN.findall(text[a:b])
                    if own:
                        kinds.append(kind)
                        values.append(own[-1])
                ordinary = {m.group() for m in TOKEN.finditer(text) if not any(a < m.end() and m.start() < b for _, a, b in spans)}
                kinds += ["ordinary"] * len(ordinary)
                values += sorted(ordinary)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string())], names=["kind", "value"])

    texts = df.where(draw & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"))
    found = texts.mapInArrow(W.tidied(run), "kind string, value string").distinct()
    limit = F.when(F.col("kind") == "ordinary", 10 * per_kind).otherwise(per_kind)
    ranked = found.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct(F.xxhash64("value").alias("h"), "value"))).alias("all"))  # of the bounded sample
    rows = ranked.select("kind", F.slice("all", 1, limit).alias("some")).collect()
    examples = {r["kind"]: [x["value"] for x in r["some"]] for r in rows}
    ordinary = examples.pop("ordinary", [])
    if not ordinary:
        return None
    formats = Formats({**published(per_kind, seed), **examples}, ordinary)
    formats.calibrate(ratios(df.select(F.col(text_col).alias("text")), formats))
    return formats


def ratios(texts: DataFrame, formats: Formats) -> np.ndarray:
    """Counts of the ratios of every token outside base spans, over all texts; a task sends a histogram of fixed size."""
    shipped = texts.sparkSession.sparkContext.broadcast(formats)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, scored = shipped.value, Scored(shipped.value)
        counts = np.zeros(model.HIGH - model.LOW + 1, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                own: list[str] = []
                for text in pc.fill_null(batch.column(0).slice(lo, 256), "").to_pylist():
                    tokens = list(TOKEN.finditer(text))
                    spans = base_spans(text) if tokens else []
                    own += [m.group() for m in tokens if not any(a <= m.start() and m.end() <= b for _, a, b in spans)]
                scored.add(set(own))
                values = np.array([scored.known[t] for t in own])
                counts += np.bincount(np.clip(np.round(values), model.LOW, model.HIGH).astype(np.int64) - model.LOW, minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at])], names=["bin", "n"])

    out = np.zeros(formats.HIGH - formats.LOW + 1, np.int64)
    for r in texts.mapInArrow(W.tidied(run), "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():  # at most as many rows as bins
        out[r["bin"]] = r["n"]
    return out


def scan(df: DataFrame, formats: Formats | None, *, text_col: str = "text") -> DataFrame:
    """``df`` with ``base`` and ``spans`` (base and learned ones), both sorted by start, then kind."""
    df = df.drop(*[n for n in ("base", "spans") if n in df.columns])
    shipped = df.sparkSession.sparkContext.broadcast(formats)
    at = df.columns.index(text_col)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        scored = None if model is None else Scored(model)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                texts = pc.fill_null(some.column(at), "").to_pylist()
                base = [base_spans(t) for t in texts]
                every = [list(x) for x in base]
                if model is not None:
                    tokens = [[(m.group(), m.start(), m.end()) for m in TOKEN.finditer(t)] for t in texts]
                    words = sorted({w for own in tokens for w, _, _ in own})
                    scored.add(set(words))
                    secret = {w for w, yes in zip(words, model.verdicts(words, np.array([scored.known[w] for w in words])), strict=True) if yes}
                    for own, mine, b in zip(tokens, every, base, strict=True):
                        mine += [("format", i, j) for w, i, j in own if w in secret and not any(x <= i and j <= y for _, x, y in b)]
                        mine.sort(key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
                cols = [pa.array([[{"kind": k, "start": i, "end": j} for k, i, j in own] for own in which], kind) for which in (base, every)]
                yield pa.RecordBatch.from_arrays([*some.columns, *cols], names=[*batch.schema.names, "base", "spans"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(W.tidied(run), f"{schema}, base {S.TYPE}, spans {S.TYPE}")


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    """Contract view: counts and digests of the spans of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, learn(docs))
    counts = [S.of_kind(F.col("base"), k).alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(S.joined(F.col("base")), 256).alias("base_sha256"), S.joined(F.col("spans")).alias("spans"))
