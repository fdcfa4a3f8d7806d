"""Legacy ARC archives to WARC: parse, decide on revisits, convert, read back.

An ARC file starts with a ``filedesc`` record whose body names the version and the
fields of every record line; records follow, each with a declared length. The converter
walks a file by those lengths and synthesises the WARC side: record ids from archive
name and record number, ISO timestamps, record types and digests.

Files are written by Spark's text sink from raw bytes (binary cast to string keeps
them), gzip-compressed, and read as ``binaryFile`` rows that are inflated piece by piece,
so any number of executors share the work and a file is never unpacked whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firespark.llm.common import frame, release, stored
from firespark.session import shared_dir

# Field names of the record lines, as the two ARC versions define them.
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: (
        "URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset",
        "Filename", "Archive-length",
    ),
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = b"\r\n"
ROWS = 500
CHUNK = 1 << 16


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def http_block(page: str, payload: bytes) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\nX-Page-Id: {page}\r\n\r\n"
    return head.encode() + payload


def header_value(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode("utf-8", "replace").strip() if found else None


def arc_line(version: int, url: str, date: str, mime: str, length: int, name: str, digest: str) -> bytes:
    tail = f" {length}" if version == 1 else f" 200 {digest} - 0 {name} {length}"
    return f"{url} 0.0.0.0 {date} {mime}{tail}\n".encode()


def arc_head(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 firespark\n{' '.join(FIELDS[version])}\n".encode()
    return arc_line(version, f"filedesc://{name}", date, "text/plain", len(body), name, "-") + body


def write_arc(pages: DataFrame, path: str, id_col: str, url_col: str, html_col: str, date: str) -> None:
    """One ARC file per partition; odd partitions are version 2, even ones version 1."""

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId()
        version, name = 1 + number % 2, f"pages-{number:06d}.arc"
        begun = False
        for part in parts:
            out = [] if begun else [arc_head(version, name, date)]
            begun = True
            for page, url, html in zip(part["page"], part["url"], part["html"]):
                payload = b"" if html is None else html.encode("utf-8", "surrogatepass")
                place = "urn:none" if url is None else quote(url, safe="%/:?#[]@!$&'()*+,;=~-._") or "urn:none"
                block = http_block("" if page is None else page, payload)
                out.append(arc_line(version, place, date, "text/html", len(block), name, payload_digest(payload)) + block)
                if len(out) >= ROWS:
                    yield pd.DataFrame({"record": out})
                    out = []
            yield pd.DataFrame({"record": out})

    shaped = pages.select(
        F.col(id_col).cast("string").alias("page"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")
    )
    records = shaped.mapInPandas(rows, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", "\n").option("compression", "gzip").text(path)


class Inflated:
    """Reads of a plain or gzip file, several members included, unpacked as they are asked for."""

    def __init__(self, data: bytes):
        self.data, self.at, self.buffer = memoryview(data), 0, bytearray()
        self.packed = data[:2] == b"\x1f\x8b"
        self.unzip = zlib.decompressobj(31) if self.packed else None

    def _more(self) -> bool:
        if self.at >= len(self.data):
            return False
        piece = bytes(self.data[self.at : self.at + CHUNK])
        self.at += len(piece)
        while piece:
            if not self.packed:
                self.buffer += piece
                break
            if self.unzip.eof:
                self.unzip = zlib.decompressobj(31)
            self.buffer += self.unzip.decompress(piece)
            piece = self.unzip.unused_data
        return True

    def take(self, length: int) -> bytes:
        while len(self.buffer) < length and self._more():
            pass
        if len(self.buffer) < length:
            raise ValueError(f"archive ends within a record: {length} bytes declared, {len(self.buffer)} left")
        out = bytes(self.buffer[:length])
        del self.buffer[:length]
        return out

    def until(self, mark: bytes) -> bytes | None:
        """Up to and with the mark; None at the end of the file."""
        start = 0
        while (end := self.buffer.find(mark, start)) < 0:
            start = max(0, len(self.buffer) - len(mark) + 1)
            if not self._more():
                return None
        return self.take(end + len(mark))

    def skip(self, blanks: bytes) -> None:
        while True:
            at = 0
            while at < len(self.buffer) and self.buffer[at] in blanks:
                at += 1
            del self.buffer[:at]
            if self.buffer or not self._more():
                return


def arc_records(data: bytes) -> Iterator[tuple[str, int, dict[str, str], bytes]]:
    """(archive name, record number, fields, block) of every record after the file's own."""
    reader = Inflated(data)
    first = reader.until(b"\n")
    if first is None:
        return
    parts = first.split()
    if not parts[0].startswith(b"filedesc://"):
        raise ValueError("no ARC file: it doesn't start with filedesc://")
    name = parts[0][len(b"filedesc://") :].decode()
    lines = reader.take(int(parts[-1])).split(b"\n")
    fields = [f.decode() for f in lines[1].split()]
    if tuple(fields) not in FIELDS.values():
        raise ValueError(f"unknown ARC record line: {fields}")
    number = 0
    while True:
        reader.skip(b"\r\n")
        line = reader.until(b"\n")
        if line is None:
            return
        values = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        # Only the address may hold spaces in old crawls; the other fields are counted from the end.
        spare = len(values) - len(fields)
        if spare < 0:
            raise ValueError(f"ARC record line with {len(values)} of {len(fields)} fields")
        known = dict(zip(fields, ["%20".join(values[: spare + 1]), *values[spare + 1 :]]))
        yield name, number, known, reader.take(int(known["Archive-length"]))
        number += 1


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP head with its blank line, and the payload; a block without one is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    end = block.find(CRLF * 2)
    return (block, b"") if end < 0 else (block[: end + 4], block[end + 4 :])


def record_id(name: str, number: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{number}')}>"


def iso(date: str) -> str:
    """14 digits to a WARC date; shorter old dates are filled up with their first moment."""
    d = date[:14] + "00000101000000"[len(date[:14]) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def index_arc(files: DataFrame) -> DataFrame:
    """(path, number, record_id, page, digest, bytes) of every record, without payloads."""

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"]):
                out = []
                for name, number, _, block in arc_records(content):
                    head, payload = split_http(block)
                    page = header_value(head, "X-Page-Id") or None
                    out.append((path, number, record_id(name, number), page, payload_digest(payload), len(payload)))
                yield frame(out, ["path", "number", "record_id", "page", "digest", "bytes"])

    return files.mapInPandas(rows, "path string, number int, record_id string, page string, digest string, bytes long")


def choose_revisits(index: DataFrame, least_bytes: int, page_type: str) -> DataFrame:
    """(path, number, original): records whose payload another record of larger page id holds.

    Among equal page ids the smallest record id stays; null page ids come before all others.
    Each payload's best record is one pre-aggregated maximum, joined back: no payload is a group in a task.
    """
    order = F.struct(F.col("page").cast(page_type).alias("page"), F.col("record_id"))
    large = index.where(F.col("bytes") >= least_bytes)
    best = large.groupBy("digest", "bytes").agg(F.max(order)["record_id"].alias("original"), F.count("*").alias("n"))
    return large.join(best.where("n > 1"), ["digest", "bytes"]).where("record_id <> original").select("path", "number", "original")


def warc_record(name: str, number: int, known: dict[str, str], block: bytes, original: str | None) -> bytes:
    """One WARC/1.1 record: response, revisit (HTTP head only), or resource without an HTTP head."""
    head, payload = split_http(block)
    body = head if original else block
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if original else 'response' if head else 'resource'}",
        f"WARC-Record-ID: {record_id(name, number)}",
        f"WARC-Date: {iso(known['Archive-date'])}",
        f"WARC-Target-URI: {known['URL']}",
        f"WARC-IP-Address: {known['IP-address']}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        f"WARC-Block-Digest: sha1:{payload_digest(body)}",
        f"Content-Type: {'application/http; msgtype=response' if head else known['Content-type']}",
        f"Content-Length: {len(body)}",
    ]
    if original:
        lines += [f"WARC-Refers-To: {original}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(lines).encode() + CRLF * 2 + body


def write_warc(files: DataFrame, revisits: DataFrame, path: str) -> None:
    """One WARC file per group of ARC files; records keep their order."""
    listed = revisits.groupBy("path").agg(
        F.collect_list("number").alias("numbers"), F.collect_list("original").alias("originals")
    )

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for content, numbers, originals in zip(part["content"], part["numbers"], part["originals"]):
                known = {} if numbers is None else dict(zip(list(numbers), list(originals)))
                out = []
                for name, number, fields, block in arc_records(content):
                    out.append(warc_record(name, number, fields, block, known.get(number)))
                    if len(out) >= ROWS:
                        yield pd.DataFrame({"record": out})
                        out = []
                yield pd.DataFrame({"record": out})

    joined = files.join(listed, "path", "left").select("content", "numbers", "originals")
    records = joined.mapInPandas(rows, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def warc_records(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(head, block) of every record of a WARC file."""
    reader = Inflated(data)
    while True:
        reader.skip(CRLF)
        head = reader.until(CRLF * 2)
        if head is None:
            return
        yield head, reader.take(int(header_value(head, "Content-Length")))


def read_warc(files: DataFrame, page_type: str) -> DataFrame:
    """(page_id, url, date, record_id, record_type, original, payload_bytes, payload_digest) per record.

    Digests and sizes of responses are worked out from the payload read; a revisit gives
    those that its record declares.
    """

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for content in part["content"]:
                out = []
                for head, block in warc_records(content):
                    kind = header_value(head, "WARC-Type")
                    http, payload = split_http(block)
                    if kind == "revisit":
                        size, digest = int(header_value(http, "Content-Length")), header_value(head, "WARC-Payload-Digest")[5:]
                    else:
                        size, digest = len(payload), payload_digest(payload)
                    out.append(
                        (
                            header_value(http, "X-Page-Id") or None, header_value(head, "WARC-Target-URI"), header_value(head, "WARC-Date"),
                            header_value(head, "WARC-Record-ID"), kind, header_value(head, "WARC-Refers-To"), size, digest,
                        )
                    )
                yield frame(out, ["page", "url", "date", "record_id", "record_type", "original", "payload_bytes", "payload_digest"])

    schema = "page string, url string, date string, record_id string, record_type string, original string, payload_bytes long, payload_digest string"
    return files.mapInPandas(rows, schema).withColumn("page", F.col("page").cast(page_type)).withColumnRenamed("page", "page_id")


def resolve(records: DataFrame) -> DataFrame:
    """``records`` with ``refers_to``: the page id of the response that a revisit refers to.

    Only responses that some revisit names are joined; a much-named one is a skewed key of
    a plain equi-join, which adaptive execution splits.
    """
    named = records.where("original is not null").select(F.col("original").alias("record_id")).distinct()
    answers = records.where("record_type <> 'revisit'").join(named, "record_id", "left_semi")
    return records.join(answers.select(F.col("record_id").alias("original"), F.col("page_id").alias("refers_to")), "original", "left")


def convert_pages(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0,
    date: str = "20240101000000",
) -> DataFrame:
    """Write pages as ARC, convert the ARC files to WARC, and read the WARC files back.

    Records with equal payloads of at least ``least_bytes`` bytes: the one of the largest
    page id is a response, the others are revisits of it. Null payloads are empty; null
    or empty addresses become ``urn:none``; null page ids come before all others and may
    be repeated. An empty table gives no rows. Column names may clash with any of ours.
    """
    spark = pages.sparkSession
    page_type = dict(pages.dtypes)[id_col]
    root = f"{shared_dir(spark)}/llm/warc-{uuid.uuid4().hex}"
    write_arc(pages, f"{root}/arc", id_col, url_col, html_col, date)
    arc = read_files(spark, f"{root}/arc")
    index = stored(index_arc(arc), "arc-index")
    write_warc(arc, choose_revisits(index, least_bytes, page_type), f"{root}/warc")
    release(spark)
    records = stored(read_warc(read_files(spark, f"{root}/warc"), page_type), "warc-records")
    return resolve(records)
