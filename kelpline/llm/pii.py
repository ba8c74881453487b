"""Personal data: base patterns, and terms that give a protected entity away.

Four base patterns find e-mail addresses, IP addresses, card numbers and phone
numbers.  Each distinct value is a protected entity.  A term within ``window``
words of an entity discloses it as far as knowing the term makes the entity
expected.  With document frequencies over all documents, p(entity) = df_entity /
N, and p(entity | term) = (co + p(entity)) / (df_term + 1), where co documents
hold the term beside the entity: one document more, of the corpus's own shares,
smooths every count alike, so a term that was seen once says less than one
that was seen with the entity again and again, and one that mostly stands
elsewhere says little.  Disclosure is the log of their ratio, relative to the entity's whole
information -log p(entity).  Terms with a ratio of ``theta`` or more are spans of kind ``term``
wherever they stand, in documents without the entity too; :func:`sanitised`
generalises them to ``[TERM]`` and removes the entities.

Null text counts as empty; long texts are scanned whole. Repeated rows count as
documents of their own. Spans are ordered by kind, then start; a term span that
ties with a base span's place isn't added. Other columns are ignored, an empty
table gives an empty one.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.llm import spans as S
from kelpline.llm import words as W
from kelpline.llm.decontaminate import WORD
from kelpline.llm.store import materialise, table

KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(0x41, 0x5B)})


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from their @ in linear time:
    the part before it is the run of its characters that ends there, as @ is none of them."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            out.append((begin, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by kind as listed, then start."""
    found = [("email", a, b) for a, b in emails(text)]
    found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(q := p.lstrip("0")) <= 3 and int(q or 0) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
    return found


def _entity(kind: str, value: str) -> str:
    return kind + ":" + (value.lower() if kind in ("email", "ip") else "".join(c for c in value if c in "+0123456789"))


def neighbours(text: str, spans: list[tuple[str, int, int]], window: int) -> list[tuple[str, str, int, int]]:
    """(entity, term, start, end) of the words beside each base span that no base span covers."""
    out = []
    for kind, a, b in spans:
        entity = _entity(kind, text[a:b])
        left, reach = [], 64
        while True:  # as far back as ``window`` whole words, or the text's beginning
            low = max(a - reach, 0)
            left = [(m.start() + low, m.end() + low) for m in WORD.finditer(text[low:a].translate(_LOWER))]
            if low == 0 or len(left) > window:
                break
            reach *= 2
        right = []
        for m in WORD.finditer(text, b):
            right.append((m.start(), m.end()))
            if len(right) == window:
                break
        for i, j in left[-window:] + right:
            if not any(x < j and i < y for _, x, y in spans):
                out.append((entity, text[i:j].translate(_LOWER), i, j))
    return out


def scan(df: DataFrame, *, id_col: str, text_col: str, window: int) -> DataFrame:
    """(rid, id, key, base, near): key is the text's MD5 digest; near holds entity and term hashes, and whether the pair is the text's first."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    near_ = pa.list_(pa.struct([("entity", pa.int64()), ("term", pa.int64()), ("first", pa.int32()), ("head", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                some = batch.slice(lo, 512)
                base, near = [], []
                for text in pc.fill_null(some.column(2), "").to_pylist():
                    spans = base_spans(text)
                    base.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
                    rows = []
                    if spans:
                        around = neighbours(text, spans, window)
                        heads = sorted({_entity(k, text[a:b]) for k, a, b in spans})
                        # one row without a term for each entity counts its documents
                        rows = [{"entity": e, "term": 0, "first": 0, "head": 1} for e in _hashes(heads)]
                        seen = set()
                        for e, t in zip(_hashes([x[0] for x in around]), W.hash_words([x[1].encode() for x in around]).view(np.int64).tolist() if around else [], strict=True):
                            rows.append({"entity": e, "term": t, "first": int((e, t) not in seen), "head": 0})
                            seen.add((e, t))
                    near.append(rows)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(base, span), pa.array(near, near_)], names=["id", "key", "base", "near"])

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, key binary, base {S.TYPE}, near array<struct<entity: long, term: long, first: int, head: int>>"
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = df.select(F.col(id_col).alias("id"), F.unhex(F.md5(text)).alias("key"), text.alias("text")).mapInArrow(W.tidied(run), schema)
    return materialise(found.select(F.monotonically_increasing_id().alias("rid"), "*"), "personal")


def _hashes(values: list[str]) -> list[int]:
    import xxhash

    return [xxhash.xxh3_64_intdigest(v) - (1 << 63) for v in values]


def _slots(term: np.ndarray, bits: int) -> list[np.ndarray]:
    """Three places of each term (int64 hashes) in a filter of 2 ** ``bits`` bits."""
    return [(W.mix(term.view(np.uint64) + np.uint64(k)) >> np.uint64(64 - bits)).astype(np.int64) for k in range(3)]


class Filter:
    """A Bloom filter of terms (distinct), of about sixteen bits each and 8 MB at most: it spares other words the shuffle."""

    def __init__(self, terms: DataFrame):
        bits = self.bits = int(np.clip(np.ceil(np.log2(16 * terms.count() + 1)), 16, 26))

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            have = np.zeros(1 << bits, bool)
            for batch in batches:
                for slot in _slots(batch.column(0).to_numpy(), bits):
                    have[slot] = True
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.packbits(have).tobytes(), 1)], pa.binary())], names=["have"])

        self.have = np.zeros(1 << (bits - 3), np.uint8)
        for r in terms.select("term").coalesce(4).mapInArrow(W.tidied(fill), "have binary").toLocalIterator():  # filters of fixed size
            self.have |= np.frombuffer(zlib.decompress(r.have), np.uint8)

    def of(self, term: np.ndarray) -> np.ndarray:
        """Places of the terms that may be in it."""
        at = np.arange(len(term))
        for slot in _slots(term, self.bits):
            at = at[(self.have[slot[at] >> 3] >> (7 - (slot[at] & 7)).astype(np.uint8)) & 1 > 0]
        return at


def term_frequencies(df: DataFrame, text_col: str, terms: DataFrame) -> DataFrame:
    """(term, df) of ``terms`` (distinct) over all texts; tasks send each term once with their own count."""
    shipped = df.sparkSession.sparkContext.broadcast(Filter(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            if not held:
                return np.empty(0, np.uint64), np.empty(0, np.int64)
            values, which = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
            return values, np.bincount(which, np.concatenate([c for _, c in held]), len(values)).astype(np.int64)

        def rows(values: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts)], names=["term", "n"])

        for batch in batches:
            for _, _, data, offsets in W.text_slices(batch.column(0)):
                words = W.split_words(data, offsets)
                at = shipped.value.of(words.hash.view(np.int64))
                h, r = words.hash[at], W.row_of(words.first)[at]
                order = np.lexsort((h, r))
                h, r = h[order], r[order]
                once = np.ones(len(h), bool)
                once[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
                held.append(np.unique(h[once], return_counts=True))
                size += len(held[-1][0])
                if size > 2_000_000:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > 1_000_000:
                        yield rows(*held[0])
                        held, size = [], 0
        yield rows(*merged())

    counts = df.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).mapInArrow(W.tidied(run), "term long, n long")
    return counts.groupBy("term").agg(F.sum("n").alias("df")).join(terms, "term")


def term_places(df: DataFrame, text_col: str, terms: DataFrame) -> DataFrame:
    """(key, start, end) of every place of ``terms`` (distinct) in the texts, by their digests."""
    shipped = df.sparkSession.sparkContext.broadcast(Filter(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in W.text_slices(batch.column(1)):
                words = W.split_words(data, offsets)
                term = words.hash.view(np.int64)
                at = shipped.value.of(term)
                row, chars = W.row_of(words.first)[at], W.char_starts(data)
                ends = [pa.array((chars[x[at]] - chars[offsets[row]]).astype(np.int32)) for x in (words.start, words.end)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(row)), pa.array(term[at]), *ends], names=["key", "term", "start", "end"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    hits = df.select(F.unhex(F.md5(text)).alias("key"), text.alias("text")).mapInArrow(W.tidied(run), "key binary, term long, start int, end int")
    return hits.join(terms, "term").select("key", "start", "end")


def find(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 8, theta: float = 0.9) -> DataFrame:
    """Per row: id, ``base`` spans and all ``spans``, by kind as listed, then start."""
    found = scan(df, id_col=id_col, text_col=text_col, window=window)
    total = found.count()
    near = found.select("rid", F.explode("near").alias("x")).select("rid", "x.*")
    pairs = near.groupBy("entity", "term").agg(F.sum("first").alias("co"), F.sum("head").alias("heads"))
    pairs = materialise(pairs, "pairs")
    entities = pairs.where("heads > 0").select("entity", F.col("heads").alias("df_entity"))
    likely = pairs.where((F.col("co") > 0) & (F.col("heads") == 0)).select("entity", "term", "co")
    terms = term_frequencies(df, text_col, materialise(likely.select("term").distinct(), "terms"))
    known = likely.join(entities, "entity").join(terms, "term")
    share = F.col("df_entity") / F.lit(float(max(total, 2)))
    given = (F.col("co") + share) / (F.col("df") + 1)
    disclosed = F.log(given / share) / -F.log(share)
    telling = materialise(known.where((share < 1) & (disclosed >= theta)).select("term").distinct(), "telling")
    places = term_places(df, text_col, telling).groupBy("key").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("places"))
    # a text of many exact copies is dealt over sixteen keys
    places = places.select("key", "places", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt"))
    both = found.select("id", "key", F.pmod("rid", F.lit(16)).cast("int").alias("salt"), "base").join(places, ["key", "salt"], "left")
    free = F.filter("places", lambda p: ~F.exists("base", lambda x: (x["start"] < p["end"]) & (p["start"] < x["end"])))
    both = both.withColumn("places", free)
    added = F.transform(F.coalesce("places", F.array().cast("array<struct<start: int, end: int>>")), lambda x: F.struct(F.lit("term").alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return both.select(F.col("id").alias(id_col), "base", F.concat("base", added).cast(S.TYPE).alias("spans"))


def sanitised(text, spans):
    """``text`` with personal data removed and telling terms generalised."""
    by_place = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    label = lambda x: F.when(x["kind"] == "term", F.lit("[TERM]")).otherwise(F.lit("[PRIVATE]"))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(s, x):
        kept = F.substring(text, s["at"] + 1, F.greatest(x["start"] - s["at"], F.lit(0)))
        out = F.when(x["start"] >= s["at"], F.concat(s["out"], kept, label(x))).otherwise(s["out"])
        return F.struct(out.alias("out"), F.greatest(s["at"], x["end"]).alias("at"))

    return F.aggregate(by_place, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))


def op6_pii(spark, sf_dir: str) -> DataFrame:
    """Contract view: counts and digests of the spans of every document."""
    found = find(table(spark, sf_dir, "documents"))
    counts = [S.of_kind(F.col("base"), k).alias(f"n_{k}") for k in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(S.joined(F.col("base")), 256).alias("base_sha256"), S.joined(F.col("spans")).alias("spans"))
