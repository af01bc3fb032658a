"""Legacy ARC archives converted to WARC.

An ARC file opens with a version block whose first line names the version; it
says which fields the header line of each record has (five in version 1, ten in
version 2).  A record's last field is the declared length of what follows, so
records are found by lengths and never by looking for a header in the content.

The converter synthesises what WARC wants and ARC lacks: an identifier (a UUID
of archive and offset), a timestamp, a record type and digests.  Of records
with equal payloads one is a response and the others are revisits of it.

Archives are tables of (path, content), as Spark's ``binaryFile`` source gives
them, each of bounded size; they are written through Spark's text sink, one row
being one file, so any store Spark reaches will do.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, quoted, shared_folder

# ---- fixed values of the formats ---------------------------------------------
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
WARC_VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# ------------------------------------------------------------------------------

#: Content of one archive file before compression; a larger record is alone.
ARCHIVE_BYTES = 16 << 20
#: A table of revisits up to this length is broadcast.
BROADCAST_REVISITS = 100_000
PARSED = "archive string, offset bigint, version int, url string, ip string, date string, mime string, page string, head binary, payload binary, payload_bytes bigint, payload_digest string, record_id string"
READ = "record_type string, record_id string, refers_to string, page string, url string, date string, payload_bytes bigint, payload_digest string"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def unpacked(content: bytes) -> bytes:
    """The content of a file, gzip members unpacked one after another."""
    if content[:2] != b"\x1f\x8b":
        return content
    parts = []
    while content[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(zlib.MAX_WBITS | 16)
        parts.append(member.decompress(content) + member.flush())
        content = member.unused_data
    return b"".join(parts)


def split_head(block: bytes) -> tuple[bytes, bytes]:
    """The HTTP head of a block, with its blank line, and the payload."""
    if block[:5] == b"HTTP/":
        for blank in (b"\r\n\r\n", b"\n\n"):
            if (at := block.find(blank)) >= 0:
                return block[: at + len(blank)], block[at + len(blank) :]
    return b"", block


def header_field(head: bytes, name: bytes) -> str | None:
    for line in head.splitlines()[1:]:
        key, _, value = line.partition(b":")
        if key.strip().lower() == name:
            return value.strip().decode("utf-8", "replace")
    return None


def timestamp(date: str) -> str:
    """ARC's 14 digits (fewer are filled up) as ISO 8601."""
    digits = (date + "00000101000000"[len(date) :])[:14] if date.isdigit() else "19700101000000"
    return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:]}Z"


def arc_records(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, version, header fields, block) of the records of an ARC file,
    without its version block.  Raises ValueError where lengths do not fit."""
    at, version = 0, 0
    while at < len(content):
        if content[at : at + 1] in (b"\n", b"\r"):  # blank lines between records
            at += 1
            continue
        end = content.find(b"\n", at)
        if end < 0:
            raise ValueError(f"no header line at {at}")
        line = content[at:end].rstrip(b"\r").decode("utf-8", "replace")
        # The version block's own line has the five fields of version 1.
        names = FIELDS[version or 1]
        values = line.rsplit(" ", len(names) - 1)
        if len(values) != len(names) or not values[-1].isdigit():
            raise ValueError(f"no header of version {version or 1} at {at}: {line[:80]!r}")
        fields = dict(zip(names, values))
        size = int(fields["Archive-length"])
        block = content[end + 1 : end + 1 + size]
        if len(block) != size:
            raise ValueError(f"{size} bytes declared at {at}, {len(block)} found")
        if not version:
            if not fields["URL"].startswith("filedesc:"):
                raise ValueError("an ARC file opens with a filedesc line")
            version = int(block.split(b" ", 1)[0])
            if version not in FIELDS:
                raise ValueError(f"ARC version {version}")
        else:
            yield at, version, fields, block
        at = end + 1 + size


def parse_arcs(arcs: DataFrame, blocks: bool = True) -> DataFrame:
    """One row per record of the ARC files (path, content); ``page`` is the
    X-Page-Id of a record's HTTP head, if it has one.  Without ``blocks`` the
    head and payload columns are null."""

    def rows(path: str, content: bytes) -> Iterator[tuple]:
        archive = path.rsplit("/", 1)[-1]
        for at, version, fields, block in arc_records(unpacked(content)):
            head, payload = split_head(block)
            page = header_field(head, b"x-page-id")
            record = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{at}')}"
            yield (archive, at, version, fields["URL"], fields["IP-address"], fields["Archive-date"], fields["Content-type"], None if page is None else unquote(page),
                   head if blocks else None, payload if blocks else None, len(payload), payload_digest(payload), record)

    return from_archives(arcs, rows, PARSED)


def from_archives(archives: DataFrame, rows, schema: str) -> DataFrame:
    """The rows of each (path, content), in batches of bounded bytes."""
    names = [c.split(" ")[0] for c in schema.split(", ")]
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    arrow = pa.schema([(c.split(" ")[0], kinds[c.split(" ")[1]]) for c in schema.split(", ")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                held, size = [], 0
                for row in rows(batch.column(0)[i].as_py(), batch.column(1)[i].as_py()):
                    held.append(row)
                    size += 200 + sum(len(v) for v in row if isinstance(v, bytes))
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), arrow)], names=names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), arrow)], names=names)

    return archives.select("path", "content").mapInArrow(run, schema)


def write_archives(rows: DataFrame, record, opening: bytes, folder: str, size: int = ARCHIVE_BYTES) -> None:
    """Write archives of at most ``size`` bytes (a larger record is alone): each
    opens with ``opening`` and holds ``record(row)`` of consecutive rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, length = [opening], len(opening)
        done = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], names=["value"])
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                for row in batch.slice(start, 64).to_pylist():
                    made = record(row)
                    if len(held) > 1 and length + len(made) > size:
                        yield done()
                        held, length = [opening], len(opening)
                    held.append(made)
                    length += len(made)
        if len(held) > 1:
            yield done()

    # Each row becomes a file; the sink's line end is an archive's last byte.
    blobs = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    blobs.write.option("maxRecordsPerFile", 1).option("lineSep", "\n").option("compression", "gzip").text(folder)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of the files of a folder; an empty one has no rows."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")


def write_arcs(pages: DataFrame, folder: str, page_id: str, url: str, html: str, version: int = 1) -> None:
    """ARC files of the pages, an HTTP head before each payload."""
    about = f"{version} 0 tablewright\n{' '.join(FIELDS[version])}\n\n".encode()
    opening = b"filedesc://pages.arc 0.0.0.0 20000101000000 text/plain %d\n%s\n" % (len(about), about)

    def record(row: dict) -> bytes:
        payload = (row["html"] or "").encode("utf-8", "surrogatepass")
        page = b"" if row["page"] is None else b"X-Page-Id: %s\r\n" % quote(row["page"], safe="").encode()
        head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n%sContent-Length: %d\r\n\r\n" % (page, len(payload))
        target = (row["url"] or "-").replace("\r", "%0D").replace("\n", "%0A").encode("utf-8", "surrogatepass")
        size = len(head) + len(payload)
        middle = b"200 - - 0 pages.arc " if version == 2 else b""
        return b"%s 0.0.0.0 20000101000000 text/html %s%d\n%s%s\n" % (target, middle, size, head, payload)

    slim = pages.select(F.col(quoted(page_id)).cast("string").alias("page"), F.col(quoted(url)).alias("url"), F.col(quoted(html)).alias("html"))
    write_archives(slim, record, opening, folder)


def revisits(parsed: DataFrame, order: list[Column], least: int) -> DataFrame:
    """(record_id, first_id, first_url, first_date) of the records whose payload
    an earlier one in ``order`` has; shorter payloads than ``least`` are left."""
    slim = durable(parsed.filter(F.col("payload_bytes") >= least).select("record_id", "payload_digest", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col("record_id").alias("id"), "url", "date").alias("place")))
    firsts = durable(slim.groupBy("payload_digest").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    # Both sides are plain tables: a payload of very many records is split.
    found = slim.join(firsts, "payload_digest").filter("record_id <> first.id")
    return durable(found.select("record_id", F.col("first.id").alias("first_id"), F.col("first.url").alias("first_url"), F.col("first.date").alias("first_date")))


def convert(arcs: DataFrame, folder: str, order: list[Column] | None = None, least: int = 0) -> None:
    """Write the records of ARC files (path, content) as WARC files.

    Of records with equal payloads of at least ``least`` bytes the first in
    ``order`` (archive date, then archive and offset, unless given) is a
    response, the others are revisits, whose block is their HTTP head.
    """
    order = order or [F.col("date"), F.col("archive"), F.col("offset")]
    again = revisits(parse_arcs(arcs, blocks=False), order, least)
    few = again.limit(BROADCAST_REVISITS + 1).count() <= BROADCAST_REVISITS
    records = parse_arcs(arcs).join(F.broadcast(again) if few else again, "record_id", "left")
    about = b"software: tablewright\r\nformat: WARC File Format 1.1\r\n"
    opening = warc_record({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'tablewright-warcinfo')}>", "WARC-Date": "2000-01-01T00:00:00Z", "Content-Type": "application/warc-fields"}, about)

    def record(row: dict) -> bytes:
        digest = f"sha1:{row['payload_digest']}"
        fields = {"WARC-Type": "revisit" if row["first_id"] else "response", "WARC-Record-ID": f"<{row['record_id']}>", "WARC-Date": timestamp(row["date"]),
                  "WARC-Target-URI": row["url"], "WARC-IP-Address": row["ip"], "WARC-Payload-Digest": digest,
                  "Content-Type": "application/http; msgtype=response" if row["head"] else row["mime"] or "application/octet-stream"}
        if row["first_id"]:
            fields |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": f"<{row['first_id']}>", "WARC-Refers-To-Target-URI": row["first_url"],
                       "WARC-Refers-To-Date": timestamp(row["first_date"]), "WARC-Truncated": "length"}
            # Without a head the payload's length would be lost.
            return warc_record(fields, row["head"] or b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % row["payload_bytes"])
        return warc_record(fields | {"WARC-Block-Digest": f"sha1:{payload_digest(row['head'] + row['payload'])}"}, row["head"] + row["payload"])

    write_archives(records, record, opening, folder)


def warc_record(fields: dict[str, str], block: bytes) -> bytes:
    lines = [WARC_VERSION, *(f"{k}: {v}" for k, v in fields.items()), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def warc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of the records of a WARC file, found by their lengths."""
    at = 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        if end < 0 or content[at : at + 5] != b"WARC/":
            raise ValueError(f"no record at {at}")
        lines = content[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        start, size = end + 4, int(fields["content-length"])
        block = content[start : start + size]
        if len(block) != size or content[start + size : start + size + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} does not have its declared length")
        yield fields, block
        at = start + size + 4


def read_warcs(warcs: DataFrame) -> DataFrame:
    """One row per response and revisit of WARC files (path, content).  A
    response whose payload does not have the declared digest raises."""

    def rows(path: str, content: bytes) -> Iterator[tuple]:
        for fields, block in warc_records(unpacked(content)):
            kind = fields["warc-type"]
            if kind not in ("response", "revisit"):
                continue
            head, payload = split_head(block)
            digest = fields["warc-payload-digest"].removeprefix("sha1:")
            size = len(payload) if kind == "response" else int(header_field(head, b"content-length") or 0)
            if kind == "response" and payload_digest(payload) != digest:
                raise ValueError(f"digest of {fields['warc-record-id']} in {path}")
            page = header_field(head, b"x-page-id")
            yield (kind, fields["warc-record-id"].strip("<>"), fields.get("warc-refers-to", "").strip("<>") or None, None if page is None else unquote(page),
                   fields.get("warc-target-uri"), fields.get("warc-date"), size, digest)

    return from_archives(warcs, rows, READ)


def archived_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", version: int = 1, least: int = 0) -> DataFrame:
    """The pages sent through ARC files and the converter, read back from the
    WARC files: page id, ``payload_bytes``, ``payload_digest`` (base32 SHA-1),
    ``record_type`` and ``refers_to``, the page id of a revisit's response.

    A null html is an empty payload; a page without an id comes last in the
    order of ids; repeated rows are records of their own; no pages give no rows.
    Ids of any type travel as text and come back as they were.
    """
    spark = pages.sparkSession
    page = F.col("page").cast(pages.schema[page_id].dataType)
    old, new = shared_folder(spark, "arc"), shared_folder(spark, "warc")
    write_arcs(pages, old, page_id, url, html, version)
    convert(read_archives(spark, old), new, [page.isNull(), page], least)
    found = durable(read_warcs(read_archives(spark, new)).withColumn("page", page))
    responses = found.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("page").alias("first_page"))
    joined = found.filter("record_type = 'revisit'").join(responses, "refers_to", "left")
    columns = [F.col("page").alias(page_id), "payload_bytes", "payload_digest", "record_type"]
    return found.filter("record_type = 'response'").select(*columns, F.lit(None).cast(pages.schema[page_id].dataType).alias("refers_to")).unionByName(joined.select(*columns, F.col("first_page").alias("refers_to")))
