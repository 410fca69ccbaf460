"""Dictionary-compressed WARC archives: a Zstandard dictionary in a leading skippable frame, then one frame for each record.

A dictionary is built from a bounded sample of the records. An archive holds it first (in a skippable frame of its own
magic number, itself compressed), so it can be read without anything else; each record is a frame that can be read
by its offset. Records are WARC/1.1: `response` with HTTP headers and payload, or `revisit` where a record with
the same payload is kept elsewhere.

Archives are bounded in size and are stored as rows (archive, data) through Spark's own writer, so that a task that is
repeated leaves no half archive and any store that Spark writes will do; `export` puts them out as files.

Of records with equal payloads of at least `least` bytes, the one with the largest page_id is the response, and the
others refer to it; several rows with that page_id are all responses. A null html is an empty payload; a null url has no
Target-URI; rows with null page_id are responses of their own. An empty table gives an empty result; other columns are
not read. A record is held whole, in memory, a few times over; an archive ends with the record that fills it.
"""

from __future__ import annotations

import base64
import hashlib
import io
import os
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import dealt, fresh_path, slices

#: Fixed by the format: the magic number of the frame that holds a dictionary, and of a plain frame.
DICTIONARY_FRAME, ZSTD_FRAME = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records of the sample, the most bytes of one, and bytes of the dictionary.
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 1 << 16, 1 << 15
#: Where an archive ends: bytes of it, and bytes of the records in it, which a reader holds.
ARCHIVE_BYTES, RECORD_BYTES = 1 << 20, 1 << 25
LEVEL = 3
URN = "urn:graphloom:page:"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record; with `refers_to` a revisit, whose HTTP headers still give the payload's length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{URN}{page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{URN}{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def build_dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary, or where there are too few records to train on, their end as it is."""
    try:
        return zstandard.train_dictionary(size, records).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records)[-size:]


def compression_dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if len(raw) >= 8 else None


class Writer:
    """One archive in memory."""

    def __init__(self, dictionary: bytes):
        shared = compression_dictionary(dictionary)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_checksum=True) if shared else zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        packed = zstandard.ZstdCompressor(level=12).compress(dictionary)
        self.lead = struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed if shared else b""
        self.take()

    def add(self, raw: bytes) -> None:
        self.parts.append(self.compressor.compress(raw))
        self.size += len(self.parts[-1])
        self.raw += len(raw)

    @property
    def full(self) -> bool:
        return self.size >= ARCHIVE_BYTES or self.raw >= RECORD_BYTES

    def take(self) -> bytes:
        """The archive so far; the next record begins another."""
        out = b"".join(getattr(self, "parts", []))
        self.parts, self.size, self.raw = [self.lead], len(self.lead), 0
        return out


def read_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """WARC headers and block of every record of an archive."""
    shared, at = None, 0
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_FRAME:
        size = struct.unpack_from("<I", data, 4)[0]
        at, raw = 8 + size, data[8 : 8 + size]
        shared = compression_dictionary(zstandard.ZstdDecompressor().decompress(raw) if raw[:4] == ZSTD_FRAME else raw)
    reader = zstandard.ZstdDecompressor(dict_data=shared) if shared else zstandard.ZstdDecompressor()
    with reader.stream_reader(io.BytesIO(data[at:]), read_across_frames=True) as stream:
        text, at = stream.readall(), 0
    while at < len(text):
        end = text.index(b"\r\n\r\n", at)
        lines = text[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        size = int(headers["Content-Length"])
        yield headers, text[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def with_references(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html and refers_to (the response's page_id where the row is a revisit)."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html")).withColumn("_digest", F.sha1("html")).withColumn("_size", F.octet_length("html"))
    kept = rows.where(F.col("_size") >= least).groupBy("_digest").agg(F.max("page_id").alias("_response"), F.count("*").alias("_n")).where("_n > 1").select("_digest", "_response")
    # A page that repeats often is one key with all of its rows; each key is one row on the other side.
    joined = rows.join(kept.withColumnRenamed("_digest", "_same"), dealt("_digest") == dealt("_same"), "left")
    return joined.select("page_id", "url", "html", F.when((F.col("page_id") != F.col("_response")) & (F.col("_size") >= least), F.col("_response")).alias("refers_to"))


def write(pages: DataFrame, path: str, least: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes the rows of `pages` (page_id, url, html) as archives to a table at `path`."""
    small = pages.where(F.octet_length("html").between(1, SAMPLE_BYTES)).select("page_id", "url", "html")
    # About twice SAMPLE rows by a hash, so that what reaches the driver does not grow with the partitions.
    share = min(1.0, 2 * SAMPLE / max(small.count(), 1))
    rank = F.xxhash64("page_id", "html")
    picked = small.withColumn("rank", rank).where(F.col("rank") <= min(int((2 * share - 1) * (1 << 63)), (1 << 63) - 1)).limit(8 * SAMPLE).collect()
    sample = sorted(picked, key=lambda r: (r["rank"], r["page_id"] or 0))[:SAMPLE]
    dictionary = build_dictionary([record(r.page_id, r.url, r.html.encode("utf-8", "surrogatepass"), None, date) for r in sample]) if sample else b""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out, n = Writer(dictionary), 0

        def done() -> pa.RecordBatch:
            nonlocal n
            n += 1
            return pa.RecordBatch.from_arrays([pa.array([f"pages-{TaskContext.get().partitionId():05d}-{n:05d}.warc.zst"]), pa.array([out.take()], pa.binary())], ["archive", "data"])

        for batch in batches:
            for part in slices(batch, "html", 4 << 20):
                for page_id, url, html, refers_to in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                    out.add(record(page_id, url, html.encode("utf-8", "surrogatepass"), refers_to, date))
                    if out.full:
                        yield done()
        if out.size > len(out.lead):
            yield done()

    with_references(pages, least).mapInArrow(written, "archive string, data binary").write.parquet(path)


def read(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every record of `archives` (data)."""

    def number(urn: str | None) -> int | None:
        text = urn[len(URN) + 1 : -1] if urn else "None"
        return None if text == "None" else int(text)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data"):
                out = []
                for headers, block in read_archive(data.as_py()):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    size = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
                    stated = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if headers["WARC-Type"] == "response" and (len(payload), digest(payload)) != (size, stated):
                        raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
                    out.append((number(headers["WARC-Record-ID"]), size, stated, headers["WARC-Type"], number(headers.get("WARC-Refers-To"))))
                if out:
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return archives.select("data").mapInArrow(parsed, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def export(archives: DataFrame, folder: str) -> int:
    """Puts the archives out as files of a folder that all executors see; their number. Each file is written aside and then named, so a task that is repeated does no harm."""
    os.makedirs(folder, exist_ok=True)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("archive").to_pylist(), batch.column("data").to_pylist(), strict=True):
                aside = os.path.join(folder, f".{name}.{uuid.uuid4().hex}")
                with open(aside, "wb") as f:
                    f.write(data)
                os.replace(aside, os.path.join(folder, name))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return archives.select("archive", "data").mapInArrow(put, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes `pages` to archives in the shared folder and reads them back."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write(pages, path)
    return read(spark.read.schema("archive string, data binary").parquet(path))


_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_GROUPS = " || ".join(f"substr('{_B32}', ((('0x' || substr(h, {5 * g + 1}, 5))::INT >> {s}) & 31) + 1, 1)" for g in range(8) for s in (15, 10, 5, 0))
ORACLE_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
r AS (SELECT h, max(page_id) AS top FROM p GROUP BY h)
SELECT page_id, payload_bytes, {_GROUPS} AS payload_digest,
  CASE WHEN page_id <> top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM p JOIN r USING (h)
"""
