"""WARC writing and sequential reading.

An archive is a run of gzip members, one for each record. Writing is map-side: payloads that repeat are
found by hash alone and, while they are few, told to every task; beyond that bound payloads are shuffled
by hash, but for those of very many pages. Archives of bounded size are rows of a written table in shared
storage, so a lost executor costs a task, not an archive. The reader goes through an archive once:
it inflates member by member with zlib, frames the record by Content-Length, splits header from
payload and checks block and payload digests. ``.warc.gz`` files from elsewhere are read by the
same code through Spark's binaryFile source.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import BROADCAST_ROWS, join_counted, map_arrow, materialize

#: An archive is closed at this size; a single larger record has its own.
ARCHIVE_BYTES = 4 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"


class WarcError(ValueError):
    """A member that is no whole, true record."""


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_uri(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _clean(value: str) -> str:
    """A header value: line breaks and blanks around it can't be written there."""
    return "".join(c if c >= " " and c != "\x7f" else "%%%02X" % ord(c) for c in value).strip()


def write_record(page_id, url: str | None, payload: bytes, refers_to=None, is_revisit: bool = False) -> bytes:
    """One gzip member: a response, or a revisit whose block is the HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % len(payload) + END
    block = http if is_revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {record_uri(page_id)}", f"WARC-Target-URI: {_clean(url or '')}", "WARC-Date: 1970-01-01T00:00:00Z"]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", f"X-Page-Id: {'' if page_id is None else page_id}"]
    if is_revisit:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_uri(refers_to)}", f"X-Refers-To-Page: {'' if refers_to is None else refers_to}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + END + block + END) + packer.flush()


def members(data: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The inflated gzip members of an archive, one after the other."""
    at, n = 0, len(data)
    view = memoryview(data)
    while at < n:
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if at >= n:
                raise WarcError("the archive ends inside a member")
            piece = view[at : at + step]
            try:
                parts.append(inflate.decompress(piece))
            except zlib.error as e:
                raise WarcError(f"a member can't be inflated: {e}") from e
            at += len(piece) - len(inflate.unused_data)
        yield b"".join(parts)


def _text(raw: bytes) -> str:
    """Header text: UTF-8, else Latin-1."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def _check(named: str, data: bytes, what: str) -> None:
    """A digest as headers give it, algorithm first, in base32 or hexadecimal; algorithms that hashlib lacks aren't checked."""
    name, _, value = named.rpartition(":")
    name = (name or "sha1").lower().replace("-", "")
    if name not in hashlib.algorithms_guaranteed or name.startswith("shake"):
        return
    found = hashlib.new(name, data).digest()
    if value.rstrip("=").upper() not in (base64.b32encode(found).decode().rstrip("="), found.hex().upper()):
        raise WarcError(f"wrong {what} digest")


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers (names in lower case), HTTP header and payload of one record; raises where a length or digest is wrong."""
    head, gap, rest = raw.partition(END)
    lines = re.sub(r"\r\n[ \t]+", " ", _text(head)).split("\r\n")  # a folded line goes on
    if not gap or not lines[0].startswith("WARC/"):
        raise WarcError("no WARC header")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    try:
        length = int(headers["content-length"])
    except (KeyError, ValueError) as e:
        raise WarcError("no content length") from e
    block = rest[:length]
    if len(block) != length or rest[length:] != END:
        raise WarcError("the block is not as long as its header says")
    if "warc-block-digest" in headers:
        _check(headers["warc-block-digest"], block, "block")
    http, _, payload = block.partition(END) if headers.get("content-type", "").startswith("application/http") else (b"", b"", block)
    if headers.get("warc-type") != "revisit" and "warc-payload-digest" in headers:
        _check(headers["warc-payload-digest"], payload, "payload")
    return headers, http, payload


def write_archives(pages: DataFrame, min_revisit_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written table archive(data binary): every row of pages as one record in one of the archives.

    Of records with equal payloads of at least min_revisit_bytes the smallest id is the response
    (nulls below none: a null id is a response only where all are null); rows that repeat this id
    are responses too. A null html is an empty payload.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("key", F.unhex(F.sha2("payload", 256)))
    firsts = rows.groupBy(F.col("key").alias("first_key")).agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    firsts = materialize(firsts, "repeated-payloads")
    same = F.col("key") == F.col("first_key")
    joined = rows.join(F.broadcast(firsts), same, "left") if firsts.count() <= most else join_counted(rows, firsts, [("key", "first_key")], "n", "left")
    revisit = F.col("first_key").isNotNull() & (F.length("payload") >= min_revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    marked = joined.select("page_id", "url", F.when(revisit, F.col("first_id")).alias("refers"), revisit.alias("revisit"), "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                for page_id, url, refers, is_revisit, data in zip(*(c.to_pylist() for c in batch.slice(i, 64).columns), strict=True):
                    parts.append(write_record(page_id, url, data, refers, is_revisit))
                    size += len(parts[-1])
                    if size >= archive_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["data"])
                        parts, size = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["data"])

    return materialize(map_arrow(marked, run, "data binary"), "warc")


RECORDS = "page_id {id}, url string, record_type string, refers_to {id}, payload_bytes long, payload_digest string, payload binary"


def read_archives(archives: DataFrame, id_type: str = "bigint", with_payload: bool = True) -> DataFrame:
    """The records of archives (a column data): page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload.

    A revisit has no payload of its own: its digest is the header's, its length that of the HTTP
    header, and payload is null. A truncated or altered archive raises WarcError.
    """
    cast = (lambda x: int(x) if x else None) if id_type in ("bigint", "int", "long") else (lambda x: x or None)
    arrow = pa.int64() if id_type in ("bigint", "long") else pa.int32() if id_type == "int" else pa.string()

    def rows(data: bytes):
        for raw in members(data):
            headers, http, payload = parse_record(raw)
            kind = headers.get("warc-type", "")
            length, found = len(payload), headers.get("warc-payload-digest", "").removeprefix("sha1:") or digest(payload)
            if kind == "revisit":
                for line in http.decode("latin-1").split("\r\n"):
                    if line.lower().startswith("content-length:"):
                        length = int(line.partition(":")[2])
            yield cast(headers.get("x-page-id", "")), headers.get("warc-target-uri"), kind, cast(headers.get("x-refers-to-page", "")), length, found, None if kind == "revisit" or not with_payload else payload

    types = [arrow, pa.string(), pa.string(), arrow, pa.int64(), pa.string(), pa.binary()]
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                out: list[tuple] = []
                for row in rows(value.as_py() or b""):
                    out.append(row)
                    if len(out) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return map_arrow(archives.select("data"), run, RECORDS.format(id=id_type))


def read_files(spark: SparkSession, path: str, id_type: str = "string") -> DataFrame:
    """The records of .warc.gz files under path (a file, folder or glob); a file is one task's input and must be under 2 GB."""
    return read_archives(spark.read.format("binaryFile").load(path).select(F.col("content").alias("data")), id_type)
