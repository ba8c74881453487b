"""WARC archives compressed by Zstandard with a shared dictionary, written and read back.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the
dictionary; then each record is a frame of its own.  Payloads that repeat are
``revisit`` records that refer to the response of the smallest id.  The reader
finds frames by their block headers, loads the dictionary from the leading
frame and validates the version line, required headers, lengths, digests and
the closing of every record; faults end the read with the archive's name.

Archives are files below the shared folder, one an archive, written by the
executors through Spark's text writer: an archive's bytes are one line, and the
line's end is the payload of a last skippable frame, so every file is a valid
archive. The reader takes them as Spark's ``binaryFile`` rows, or any frame with
a binary column.
Null html is an empty payload; long ones are whole records. Rows equal in id
and payload to the smallest are responses as well. A null id counts as the
largest; ids that are no whole numbers are text and ordered as such. Repeated rows keep a record each, other columns are ignored, an empty
table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from kelpline.llm import words as W
from kelpline.llm.store import fresh_path, table

DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
END = b"\r\n\r\n"
#: Head of a skippable frame of one byte: the end of the line that follows an archive.
LAST_FRAME = (0x184D2A50).to_bytes(4, "little") + (1).to_bytes(4, "little")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")


class ArchiveError(ValueError):
    """A record or frame breaks the format."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, ident: str, date: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{ident}>", f"WARC-Date: {date}"]
    lines += [f"{k}: {v}" for k, v in headers] + [f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block + END


def page_uri(page_id) -> str:
    """A page's record id; a page without one has the bare name."""
    return "urn:page" if page_id is None else f"urn:page:{quote(str(page_id), safe='')}"


def page_record(page_id, url: str | None, payload: bytes, refers_to, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}".encode() + END
    headers = [("WARC-Target-URI", quote(url or "about:blank", safe=":/?#[]@!$&'()*+,;=%~")), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("Content-Type", "application/http;msgtype=response")]
    if refers_to is None:
        return record("response", page_uri(page_id), date, headers, http + payload)
    return record("revisit", page_uri(page_id), date, [*headers, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{page_uri(refers_to)}>")], http)


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary of at most ``size`` bytes; empty without samples."""
    samples = [s for s in samples if len(s) >= 8]
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too little to train on: the samples themselves
        return b"".join(samples)[-size:]


class Writer:
    """Builds one archive after the other, each of about ``limit`` compressed bytes."""

    def __init__(self, dictionary: bytes, level: int, limit: int):
        self.head = DICTIONARY_MAGIC.to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary
        own = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=own, write_checksum=True, write_content_size=True)
        self.limit, self.parts, self.size = limit, [], 0

    def add(self, raw: bytes) -> bool:
        """True once the archive is full."""
        frame = self.compressor.compress(raw)
        self.parts.append(frame)
        self.size += len(frame)
        return self.size >= self.limit

    def close(self) -> bytes:
        out, self.parts, self.size = b"".join([self.head, *self.parts]), [], 0
        return out


def frames(content: bytes) -> Iterator[tuple[int, int, int]]:
    """(magic, start, end) of each frame, from frame and block headers."""
    at = 0
    while at < len(content):
        if at + 8 > len(content):
            raise ArchiveError("cut off in a frame's header")
        magic = int.from_bytes(content[at : at + 4], "little")
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            end = at + 8 + int.from_bytes(content[at + 4 : at + 8], "little")
        elif magic == FRAME_MAGIC:
            head = content[at : at + 18]
            end = at + zstandard.frame_header_size(head)
            while True:
                if end + 3 > len(content):
                    raise ArchiveError("cut off in a block's header")
                block = int.from_bytes(content[end : end + 3], "little")
                end += 3 + (1 if (block >> 1) & 3 == 1 else block >> 3)
                if block & 1:
                    break
            end += 4 * bool(zstandard.get_frame_parameters(head).has_checksum)
        else:
            raise ArchiveError(f"no frame starts with {magic:#x}")
        if end > len(content):
            raise ArchiveError("cut off in a frame")
        yield magic, at, end
        at = end


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record, validated."""
    head, found, rest = raw.partition(END)
    lines = head.decode("utf-8").split("\r\n")
    if not found or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise ArchiveError("no version line")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ArchiveError(f"no header: {line[:80]!r}")
        headers[name.strip().lower()] = value.strip()
    if missing := [n for n in REQUIRED if n not in headers]:
        raise ArchiveError(f"headers missing: {missing}")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + len(END) or not rest.endswith(END):
        raise ArchiveError("the block's length isn't Content-Length")
    return headers, rest[: -len(END)]


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of an archive; a frame that isn't exactly one record is a fault."""
    decompressor = zstandard.ZstdDecompressor()
    for i, (magic, start, end) in enumerate(frames(content)):
        if magic == DICTIONARY_MAGIC and i == 0:
            own = content[start + 8 : end]
            if own[:4] == FRAME_MAGIC.to_bytes(4, "little"):  # a dictionary may be compressed itself
                own = zstandard.ZstdDecompressor().decompress(own)
            decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(own)) if own else decompressor
        elif magic == FRAME_MAGIC:
            size = zstandard.frame_content_size(content[start : start + 18])
            raw = decompressor.decompress(content[start:end], max_output_size=max(size, 0) or (1 << 30))
            if size >= 0 and len(raw) != size:
                raise ArchiveError("a frame's length isn't its header's")
            yield parse(raw)


def _number(ident: str | None) -> int | None:
    """A whole number's text as the number, any other as nothing."""
    return int(ident) if ident is not None and re.fullmatch(r"-?[0-9]{1,18}", ident) else None


def page_of(headers: dict[str, str], block: bytes) -> tuple:
    """:func:`page_with_text` with ids as numbers."""
    ident, length, told, kind, refers = page_with_text(headers, block)
    return _number(ident), length, told, kind, _number(refers)


def page_with_text(headers: dict[str, str], block: bytes) -> tuple:
    """(page_id, payload bytes, digest, type, refers_to) of a response or revisit, validated; ids as the text they are."""
    http, found, payload = block.partition(END)
    size = re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)
    if not found or not size or not http.startswith(b"HTTP/"):
        raise ArchiveError("no HTTP response")
    told = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    kind, length = headers["warc-type"], int(size[1])
    if kind == "response" and (len(payload) != length or digest(payload) != told):
        raise ArchiveError("the payload's length or digest isn't the record's")
    if kind == "revisit" and (payload or headers.get("warc-profile") != PROFILE):
        raise ArchiveError("a revisit with a payload, or of another profile")

    def ident(name: str) -> str | None:
        m = re.fullmatch(r"<urn:page(?::([^<>\s]*))?>", headers.get(name, ""))
        return None if m is None or m[1] is None else unquote(m[1])

    return ident("warc-record-id"), length, told, kind, ident("warc-refers-to") if kind == "revisit" else None


def write_archives(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, sample_rows: int = 300, dictionary_bytes: int = 32 << 10, level: int = 3, limit: int = 8 << 20, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Archive files below the shared folder, as rows (archive string, content binary).

    The dictionary is trained on about ``sample_rows`` pages, chosen by a hash.
    Payloads shorter than ``least_bytes`` are never revisits.
    """
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    ident = F.col(id_col) if isinstance(pages.schema[id_col].dataType, IntegralType) else F.col(id_col).cast("string")
    rows = pages.select(ident.alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    total = rows.count()
    draw = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1 << 40)) < int(min(1.0, sample_rows / max(total, 1)) * (1 << 40))
    sample = [bytes(r[0]) for r in rows.where(draw).select("payload").collect()]
    dictionary = train_dictionary([page_record(0, "http://", p, None, date) for p in sample], dictionary_bytes)
    keyed = rows.withColumn("sha", F.unhex(F.sha1("payload")))
    ids = keyed.where(F.octet_length("payload") >= least_bytes).select("id", "sha")
    first = ids.groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    # equal payloads are dealt over sixteen keys, and only their ids and digests; payloads move once, by id
    first = first.select("sha", "first", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt"))
    salted = ids.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(16)).cast("int")).join(first, ["sha", "salt"])
    repeats = salted.where(~F.col("id").eqNullSafe(F.col("first"))).select(F.col("id").alias("own"), F.col("sha").alias("own_sha"), "first").distinct()
    same = F.col("id").eqNullSafe(F.col("own")) & (F.col("sha") == F.col("own_sha"))
    placed = keyed.join(repeats, same, "left").select("id", "url", "payload", F.col("first").alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, part, number, held = Writer(dictionary, level, limit), TaskContext.get().partitionId(), 0, 0

        def done() -> pa.RecordBatch:
            name = f"part-{part:06d}-{number:04d}.warc.zst"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([held], pa.int32()), pa.array([writer.close()], pa.binary())], names=["archive", "records", "content"])

        for batch in batches:
            for i in range(batch.num_rows):
                ident, url, payload, refers = (c[i].as_py() for c in batch.columns)
                if not held:
                    writer.add(record("warcinfo", f"urn:archive:{part}:{number}", date, [("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                held += 1
                if writer.add(page_record(ident, url, payload, refers, date)):
                    yield done()
                    number, held = number + 1, 0
        if held:
            yield done()

    made = placed.mapInArrow(W.tidied(run), "archive string, records int, content binary")
    path = fresh_path(pages.sparkSession, "archives")
    made.select(F.concat("content", F.lit(LAST_FRAME)).cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return archive_files(pages.sparkSession, path)


def archive_files(spark, path: str) -> DataFrame:
    """(archive, content) of the archive files below a path."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), "content")


def read_archives(archives: DataFrame, *, name_col: str = "archive", content_col: str = "content", text_ids: bool = False) -> DataFrame:
    """(archive, page_id, payload_bytes, payload_digest, record_type, refers_to) of every page record. Ids are numbers (null where
    they aren't whole ones), or text with ``text_ids``."""
    page, kind = (page_with_text, "string") if text_ids else (page_of, "long")
    of_id = pa.string() if text_ids else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name = batch.column(0)[i].as_py()
                try:
                    found = [page(h, b) for h, b in records(batch.column(1)[i].as_py()) if h["warc-type"] in ("response", "revisit")]
                except (ArchiveError, zstandard.ZstdError, UnicodeDecodeError) as e:
                    raise ArchiveError(f"{name}: {e}") from e
                cols = list(zip(*found, strict=True)) or [(), (), (), (), ()]
                kinds = [of_id, pa.int64(), pa.string(), pa.string(), of_id]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["archive", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    schema = f"archive string, page_id {kind}, payload_bytes long, payload_digest string, record_type string, refers_to {kind}"
    return archives.select(F.col(name_col), F.col(content_col)).mapInArrow(W.tidied(run), schema)


def op10_warc(spark, sf_dir: str) -> DataFrame:
    """Contract view: one row per page, from the archives as read back."""
    return read_archives(write_archives(table(spark, sf_dir, "pages"))).drop("archive")


def oracle() -> str:
    """The contract view in SQL."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    five = "CAST((('0x' || substr(h, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31 AS INTEGER)"
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages), f AS (SELECT h, min(page_id) AS head FROM p GROUP BY h)
SELECT page_id, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('{letters}', 1 + {five}, 1)), '') AS payload_digest,
CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> head THEN head END AS refers_to FROM p JOIN f USING (h)"""
