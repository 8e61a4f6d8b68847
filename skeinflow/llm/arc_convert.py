"""Converter from legacy ARC archives to WARC.

An ARC file starts with a version block whose second line names the version;
that fixes how many fields the one-line header of every record has (five in
version 1, ten in version 2; a URL may hold spaces, so fields count from the
right).  The last field declares the length of what follows.  Each record
becomes a WARC record: the version block a ``warcinfo``, an HTTP reply a
``response``, anything else a ``resource``, with a name-based identifier, an ISO
timestamp and SHA-1 digests of block and payload.

Archives are rows (name, content), which is what Spark's ``binaryFile`` source
gives for files; content may be gzipped.  WARC files are written by Spark's text
sink, whose line separator is the end of a WARC record, and read back with
``binaryFile``; so both work on any file system that Spark reaches.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.llm._io import Scratch, ship
from skeinflow.llm._skew import lookup

FIELDS = {
    b"1": ("url", "ip", "date", "type", "length"),
    b"2": ("url", "ip", "date", "type", "result", "checksum", "location", "offset", "filename", "length"),
}
#: Bytes after which ``arc_archives`` starts another archive; records of a WARC file and bytes of its records at most.
ARCHIVE, PER_FILE, FILE = 4 << 20, 20_000, 128 << 20
END = b"\r\n\r\n"
RECORDS = (
    "record_id string, warc_type string, uri string, ip string, date string, content_type string, "
    "payload_digest string, payload_bytes long, block_digest string, head_digest string, head binary, body binary, truncated boolean"
)
_NAMES = [x.split()[0] for x in RECORDS.split(", ")]
_TYPES = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
_ARROW = pa.schema([(x.split()[0], _TYPES[x.split()[1]]) for x in RECORDS.split(", ")])


def sha1_32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def iso_date(digits: str) -> str:
    """ARC dates have 14 digits, early ones 12 or fewer; what is missing is the start of the period."""
    d = (re.sub(r"\D", "", digits) + "00000101000000"[len(re.sub(r"\D", "", digits)) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def parse_arc(content: bytes) -> Iterator[tuple[dict, bytes, bool]]:
    """(header fields, block, truncated) of each record, the version block first.

    A line that is no header of the file's version is passed over; a block
    shorter than declared is given as far as it goes.
    """
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    at, fields = 0, FIELDS[b"1"]
    while at < len(content):
        end = content.find(b"\n", at)
        line = content[at : end if end >= 0 else len(content)].rstrip(b"\r")
        start = end + 1 if end >= 0 else len(content)
        if line.startswith(b"filedesc:") and not content.startswith(b"HTTP/", start):
            second = content[start : content.find(b"\n", start) + 1 or len(content)]
            fields = FIELDS.get(second.split(b" ")[0].strip(), fields)
            parts = line.rsplit(b" ", 4) if len(line.split(b" ")) == 5 else line.rsplit(b" ", len(fields) - 1)
            names = fields if len(parts) == len(fields) else FIELDS[b"1"]
        else:
            parts, names = line.rsplit(b" ", len(fields) - 1), fields
        if len(parts) != len(names) or not parts[-1].isdigit():
            at = start
            continue
        length = int(parts[-1])
        block = content[start : start + length]
        yield {n: p.decode("utf-8", "replace") for n, p in zip(names, parts, strict=True)}, block, len(block) < length
        at = start + length


def split_http(block: bytes) -> tuple[bytes, bytes] | None:
    if not block.startswith(b"HTTP/"):
        return None
    cut = block.find(END)
    return (block, b"") if cut < 0 else (block[: cut + 4], block[cut + 4 :])


def as_warc(head: dict, block: bytes, truncated: bool, payloads: bool = True) -> tuple:
    """The fields of ``RECORDS`` for one ARC record; a page may have a URL like a version block's, but is an HTTP reply."""
    parts = split_http(block)
    if head["url"].startswith("filedesc:") and not parts:
        kind, content, first, body = "warcinfo", "application/warc-fields", b"", block
    elif parts:
        kind, content, (first, body) = "response", "application/http; msgtype=response", parts
    else:
        kind, content, first, body = "resource", head["type"] or "application/octet-stream", b"", block
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{head['url']} {head['date']} {(digest := sha1_32(body))} {sha1_32(first)}")
    return (
        f"<urn:uuid:{name}>", kind, head["url"], head["ip"], iso_date(head["date"]), content, digest, len(body),
        (sha1_32(block) if first else digest) if payloads else None, sha1_32(first) if payloads else None,
        first, body if payloads else None, truncated,
    )


def _batches(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def _convert(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for head, block, truncated in parse_arc(content.as_py() or b""):
                    rows.append(as_warc(head, block, truncated, payloads))
                    held += len(block)
                    if held > ARCHIVE:
                        yield _batches(rows)
                        rows, held = [], 0
                if rows:
                    yield _batches(rows)

    return run


def convert(archives: DataFrame, content_col: str = "content", payloads: bool = True) -> DataFrame:
    """WARC records, one row each, of ARC archives given as rows.

    Null or empty content gives no rows.  Equal records (same URL, date and
    bytes) have equal identifiers.  Without ``payloads``, the body and the block
    digests are null.  Only ``content_col`` is read.
    """
    ship(archives.sparkSession)
    return archives.select(F.col(content_col).cast("binary")).mapInArrow(_convert(payloads), RECORDS)


def arc_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", version: int = 1, date: str = "20240101000000") -> DataFrame:
    """ARC archives (name, content) that hold an HTTP reply for every row, its id in the reply's ``X-Page-Id``.

    Null html is an empty payload, a null URL is empty, white space in URLs is
    escaped, a null id is an empty ``X-Page-Id``.
    """
    ship(pages.sparkSession)
    fields = FIELDS[str(version).encode()]
    legend = {"url": "URL", "ip": "IP-address", "date": "Archive-date", "type": "Content-type", "result": "Result-code", "checksum": "Checksum", "location": "Location", "offset": "Offset", "filename": "Filename", "length": "Archive-length"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, held = 0, [], 0
        part = TaskContext.get().partitionId()

        def line(name: str, url: str, kind: str, size: int, offset: int) -> bytes:
            x = {"url": url, "ip": "0.0.0.0", "date": date, "type": kind, "result": "200", "checksum": "-", "location": "-", "offset": str(offset), "filename": name, "length": str(size)}
            return " ".join(x[f] for f in fields).encode() + b"\n"

        def flush():
            return pa.record_batch([pa.array([name]), pa.array([b"".join(parts)], pa.binary())], names=["name", "content"])

        for batch in batches:
            for page, url, html in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if not parts:
                    name = f"pages-{part:05d}-{number:05d}.arc"
                    about = f"{version} 0 skeinflow\n{' '.join(legend[f] for f in fields)}\n".encode()
                    parts = [line(name, f"filedesc://{name}", "text/plain", len(about), 0), about, b"\n"]
                    held = sum(map(len, parts))
                body = (html or "").encode()
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\nX-Page-Id: {'' if page is None else page}\r\n\r\n".encode() + body
                parts += [line(name, re.sub(r"\s", lambda m: f"%{ord(m[0]):02X}", url or ""), "text/html", len(block), held), block, b"\n"]
                held += len(parts[-3]) + len(block) + 1
                if held > ARCHIVE:
                    yield flush()
                    number, parts, held = number + 1, [], 0
        if parts:
            yield flush()

    chosen = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    return chosen.mapInArrow(run, "name string, content binary")


def write_warc(records: DataFrame, path: str, largest: int) -> None:
    """Write rows of ``convert`` as gzipped WARC files; rows with ``refers_id`` are written as revisits without payload.

    ``refers_id`` is the identifier of the record that has the same payload.
    ``largest`` is the size of the largest payload: no file holds more records
    than ``FILE`` bytes have room for if all are that large, but one at least.
    """
    revisit = F.col("refers_id").isNotNull()

    def field(name: str, value) -> F.Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))).otherwise("")

    head, body = F.coalesce("head", F.lit(b"")), F.coalesce("body", F.lit(b""))
    lines = F.concat(
        F.lit("WARC/1.1\r\n"),
        field("WARC-Type", F.when(revisit, "revisit").otherwise(F.col("warc_type"))),
        field("WARC-Record-ID", F.col("record_id")),
        field("WARC-Date", F.col("date")),
        field("WARC-Target-URI", F.when(F.col("warc_type") != "warcinfo", F.col("uri"))),
        field("WARC-Filename", F.when(F.col("warc_type") == "warcinfo", F.regexp_replace("uri", "^filedesc:/*", ""))),
        field("WARC-IP-Address", F.when(~F.col("ip").isin("0.0.0.0", "", "-") & (F.col("warc_type") != "warcinfo"), F.col("ip"))),
        field("WARC-Truncated", F.when(F.col("truncated"), F.lit("length"))),
        field("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        field("WARC-Refers-To", F.col("refers_id")),
        field("WARC-Payload-Digest", F.when(F.col("warc_type") != "warcinfo", F.concat(F.lit("sha1:"), "payload_digest"))),
        field("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.when(revisit, F.col("head_digest")).otherwise(F.col("block_digest")))),
        field("Content-Type", F.col("content_type")),
        field("Content-Length", F.octet_length(head) + F.when(revisit, 0).otherwise(F.octet_length(body))),
        F.lit("\r\n"),
    )
    record = F.concat(lines.cast("binary"), head, F.when(revisit, F.lit(b"")).otherwise(body)).cast("string")
    records.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", max(1, min(PER_FILE, FILE // (largest + 2048)))).text(path)


READ = (
    "record_id string, warc_type string, refers_id string, uri string, date string, http_id long, "
    "payload_bytes long, payload_digest string, intact boolean"
)
_READ = pa.schema([(x.split()[0], _TYPES[x.split()[1]]) for x in READ.split(", ")])


def parse_warc(content: bytes) -> Iterator[tuple[dict, bytes]]:
    """(named fields in lower case, block) of each record, by declared lengths."""
    if content[:2] == b"\x1f\x8b":
        parts, rest = [], content
        while rest[:2] == b"\x1f\x8b":  # one member a record, or one for all
            unzip = zlib.decompressobj(31)
            parts.append(unzip.decompress(rest))
            rest = unzip.unused_data
        content = b"".join(parts)
    at = 0
    while at < len(content):
        cut = content.find(END, at)
        if cut < 0:
            return
        lines = content[at:cut].decode("utf-8", "replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = int(fields.get("content-length", "0"))
        yield fields, content[cut + 4 : cut + 4 + length]
        at = cut + 4 + length + len(END)


def _http_value(head: bytes, name: bytes) -> int | None:
    m = re.search(rb"(?im)^" + name + rb":\s*(-?\d+)\s*$", head)
    return int(m[1]) if m else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            rows = []
            for f, block in parse_warc(content.as_py()):
                head, body = split_http(block) or (b"", block)
                declared = f.get("warc-payload-digest", "").removeprefix("sha1:")
                kind = f.get("warc-type")
                if kind == "revisit":  # the payload's length is in the reply's own header
                    size, intact = _http_value(head, b"content-length"), f.get("warc-block-digest") == f"sha1:{sha1_32(block)}"
                else:
                    size, intact = len(body), declared == sha1_32(body)
                rows.append((f.get("warc-record-id"), kind, f.get("warc-refers-to"), f.get("warc-target-uri"), f.get("warc-date"), _http_value(head, b"x-page-id"), size, declared, intact))
            if rows:
                yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _READ, strict=True)], schema=_READ)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row a record of the WARC files (gzipped or not) in a folder."""
    ship(spark)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_read, READ)


def pages_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", version: int = 2) -> DataFrame:
    """Archive pages as ARC, convert to WARC with revisits for repeated payloads, write, and read the WARC files back.

    One row per page: id, ``payload_bytes``, ``payload_digest``, ``record_type``
    and ``refers_to``.  Among equal payloads (empty ones too) the row with the
    largest id is the response and others revisit it; rows that repeat that id
    with that payload are responses as well, and so are rows without an id.  An
    empty table gives an empty table; other columns are not read.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "archives")
    page = F.regexp_extract(F.decode("head", "UTF-8"), r"X-Page-Id: (-?\d+)", 1)
    page = F.when(page != "", page.cast("long"))
    archives = arc_archives(pages, id_col, url_col, html_col, version)
    http = F.col("warc_type") == "response"
    index = scratch.put(convert(archives, payloads=False).where(http).select(page.alias("page"), "record_id", "payload_digest", "payload_bytes"), "index")
    held = index.where("page is not null").groupBy("payload_digest").agg(
        F.count("*").alias("n"), F.max("page").alias("last"), F.max_by("record_id", "page").alias("refers_id")
    ).where("n > 1")
    repeated = scratch.put(held, "repeated")
    flags = lookup(index.drop("payload_bytes").where("page is not null"), repeated, ["payload_digest"]).where("page <> last")
    flags = scratch.put(flags.select("record_id", "refers_id").distinct(), "flags")
    where = scratch.path("warc")
    write_warc(convert(archives).join(flags, "record_id", "left"), where, index.agg(F.max("payload_bytes")).first()[0] or 0)
    back = scratch.put(read_warc(spark, where).where("warc_type in ('response', 'revisit')"), "back")
    named = back.where("warc_type = 'response'").join(
        repeated.select(F.col("refers_id").alias("record_id")), "record_id", "left_semi"
    ).groupBy(F.col("record_id").alias("refers_id")).agg(F.max("http_id").alias("refers_to"))
    return lookup(back, named, ["refers_id"]).select(
        F.col("http_id").alias(id_col), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), "refers_to", "intact"
    )
