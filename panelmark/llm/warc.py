"""WARC archives of pages, written and read back in splits.

Each record is a gzip member of its own, so a reader can start at any member.  A task gets a byte range, looks for gzip
magic in it, and takes a place as a member only if its bytes inflate to a record: a version line, the four mandatory
headers, a Content-Length that fits the inflated size, and behind the member another magic or the file's end.  A range
that starts inside a record may find members that this record only stores, so the first place has to be followed by
``CONFIRM`` more records (or the file's end) before it counts.  A task owns the records that start in its range and reads
past the range's end for the last one.  Within a member it never searches: it goes on behind it.

Any record type is read (warcinfo, request, response, revisit, resource, metadata, conversion, ...), with any headers
besides the mandatory ones; only archives whose records are gzip members can be split this way.

Equal payloads of ``least`` bytes or more are stored once, as the response of the largest page_id; the others become
revisits that name it and keep the HTTP header (with the payload's length) but not the payload.

Archives go to the shared folder through pyarrow's file systems; names are unique for each attempt and only those of
finished attempts are listed, so a task that runs twice leaves a file that nobody reads.

Defined results: a null html is an empty payload; rows that repeat the largest page_id of a payload are responses each;
a null page_id is smaller than every other, and where a payload has no other the rows are responses; an empty table
gives no archive and an empty result.
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

from panelmark.llm.common import stored, table
from panelmark.sources.shared import shared_path

MAGIC = b"\x1f\x8b\x08"
#: Bytes of a split and of an archive; records that have to follow the first one found in a split.
SPLIT, ARCHIVE, CONFIRM = 32 << 20, 256 << 20, 8


def file_system(uri: str):
    """(file system, path in it) of a folder that all executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member; ``refers_to`` makes it a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = (url or "about:blank").replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return member("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def warcinfo(name: str) -> bytes:
    """The record that an archive begins with."""
    block = b"software: panelmark\r\nformat: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:archive:{name}>", "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return member("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def member(content: bytes) -> bytes:
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(content) + deflate.flush()


def _written(folder: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        system.create_dir(root, recursive=True)
        out, name, size, done = None, "", 0, []
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                    head = warcinfo(name)
                    out.write(head)
                    size = len(head)
                written = record(page_id, url, (html or "").encode(), refers_to)
                out.write(written)
                size += len(written)
                if size >= archive_bytes:
                    out.close()
                    done.append((name, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, size))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["name", "size"])

    return run


def with_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """Add refers_to: the page that holds the payload, null for that page itself and for small payloads."""
    html = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.withColumn("html", html).withColumn("warc_digest", F.unhex(F.sha1(html)))
    heads = stored(keyed.groupBy("warc_digest").agg(F.max("page_id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "warc-heads")
    big = F.octet_length("html") >= least
    refers = F.when(big & F.col("head").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("head")), F.col("head"))
    return keyed.join(heads, "warc_digest", "left").withColumn("refers_to", refers).drop("warc_digest", "head")


def write_archives(pages: DataFrame, folder: str, least: int = 0, archive_bytes: int = ARCHIVE) -> DataFrame:
    """Write pages (page_id, url, html) and return the archives: name, size."""
    rows = with_revisits(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), least)
    return stored(rows.select("page_id", "url", "html", "refers_to").mapInArrow(_written(folder, archive_bytes), "name string, size long"), "warc-archives")


_VERSION = re.compile(rb"WARC/\d+\.\d+\r?\n")
_NEEDED = {"warc-type", "warc-record-id", "warc-date", "content-length"}


def headers_of(content: bytes) -> tuple[dict[str, str], int] | None:
    """(headers by lower-case name, where the block starts) of a WARC record; None if it is not a whole one."""
    if not _VERSION.match(content):
        return None
    end = content.find(b"\r\n\r\n")
    if end < 0:
        return None
    found = fields_of(content[:end])
    length = found.get("content-length", "")
    if not _NEEDED <= found.keys() or not length.isdigit():
        return None
    rest = len(content) - (end + 4) - int(length)
    return (found, end + 4) if 0 <= rest <= 4 and not content[len(content) - rest :].strip(b"\r\n") else None


def fields_of(head: bytes) -> dict[str, str]:
    """Headers behind the first line; folded lines belong to the one before, the first of several of a name counts."""
    out: dict[str, str] = {}
    for line in re.sub(rb"\r?\n[ \t]+", b" ", head).splitlines()[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            out.setdefault(name.strip().lower().decode("latin-1"), value.strip().decode(errors="replace"))
    return out


def member_at(source, at: int, size: int, step: int = 1 << 18) -> tuple[bytes, int] | None:  # noqa: ANN001
    """(content, length) of the gzip member at this place if it holds a WARC record with a member or nothing behind it,
    else None."""
    inflate, parts, read = zlib.decompressobj(31), [], at
    try:
        while not inflate.eof:
            if read >= size:
                return None
            piece = source.read_at(min(step, size - read), read)
            read += len(piece)
            parts.append(inflate.decompress(piece))
            if len(parts) == 1 and len(parts[0]) >= 5 and not parts[0].startswith(b"WARC/"):
                return None
    except zlib.error:
        return None
    content, end = b"".join(parts), read - len(inflate.unused_data)
    behind = inflate.unused_data[: len(MAGIC)]
    if len(behind) < len(MAGIC):
        behind = source.read_at(min(len(MAGIC), size - end), end)
    return (content, end - at) if headers_of(content) and (end == size or behind == MAGIC) else None


def confirmed(source, at: int, size: int) -> bool:  # noqa: ANN001
    """Whether ``CONFIRM`` records follow the one at this place, or as many as the file has."""
    for _ in range(CONFIRM + 1):
        if at == size:
            return True
        found = member_at(source, at, size)
        if found is None:
            return False
        at += found[1]
    return True


def records_in(source, size: int, start: int, end: int, step: int = 1 << 20) -> Iterator[bytes]:  # noqa: ANN001
    """Contents of the records that start in [start, end)."""
    at, sure = start, start == 0
    while at < min(end, size):
        window = source.read_at(min(step, size - at), at)
        found = window.find(MAGIC)
        if found < 0:
            if at + len(window) >= size:
                return
            at, sure = at + max(1, len(window) - len(MAGIC) + 1), False
            continue
        sure = sure and found == 0
        at += found
        if at >= end:
            return
        held = member_at(source, at, size)
        if held is None or not (sure or confirmed(source, at, size)):
            at, sure = at + 1, False
            continue
        yield held[0]
        at, sure = at + held[1], True


def number_of(name: str | None) -> int | None:
    """The page_id of a record that this module wrote; null for any other."""
    digits = (name or "").strip("<>").removeprefix("urn:page:")
    return int(digits) if digits.lstrip("-").isdigit() else None


def parsed(content: bytes) -> dict:
    """Fields of a record.  Of an HTTP block the payload is what stands behind its header, else the block; a revisit has
    none, but the length that its HTTP header names.  ``digest_ok`` is null where there is no SHA-1 to compare."""
    headers, start = headers_of(content)
    block = content[start : start + int(headers["content-length"])]
    kind, http = headers["warc-type"].lower(), headers.get("content-type", "").lower().startswith("application/http")
    head, _, payload = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
    named = fields_of(head).get("content-length", "") if http else ""
    revisit = kind == "revisit"
    algorithm, _, digest = headers.get("warc-payload-digest", "").partition(":")
    sha1 = digest if algorithm.lower() == "sha1" else None
    own = None if revisit else base32_sha1(payload)
    return {
        "page_id": number_of(headers["warc-record-id"]),
        "record_id": headers["warc-record-id"].strip("<>"),
        "record_date": headers["warc-date"],
        "url": headers.get("warc-target-uri", "").strip("<>") or None,
        "payload": None if revisit else payload,
        "payload_bytes": (int(named) if named.isdigit() else None) if revisit else len(payload),
        "payload_digest": sha1 or own,
        "digest_ok": None if revisit or sha1 is None else sha1.upper() == own,
        "record_type": kind,
        "refers_to": number_of(headers.get("warc-refers-to")) if revisit else None,
        "refers_to_id": headers.get("warc-refers-to", "").strip("<>") or None,
    }


KINDS = {"page_id": pa.int64(), "record_id": pa.string(), "record_date": pa.string(), "url": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "digest_ok": pa.bool_(), "record_type": pa.string(), "refers_to": pa.int64(), "refers_to_id": pa.string()}


def _read(folder: str, fields: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        for batch in batches:
            for split in batch.to_pylist():
                with system.open_input_file(f"{root}/{split['name']}") as source:
                    rows, held = [], 0
                    for content in records_in(source, split["size"], split["start"], split["end"]):
                        row = parsed(content)
                        rows.append([row[c] for c in fields])
                        held += len(content) if "payload" in fields else 200
                        if held > 8 << 20:
                            yield _batch(rows, fields)
                            rows, held = [], 0
                    yield _batch(rows, fields)

    return run


def _batch(rows: list[list], fields: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, KINDS[f]) for c, f in zip(columns, fields, strict=True)], fields)


def read_archives(archives: DataFrame, folder: str, fields: list[str] | None = None, split_bytes: int = SPLIT) -> DataFrame:
    """Records of the archives (name, size), read by byte ranges of ``split_bytes``."""
    spark = archives.sparkSession
    fields = fields or list(KINDS)
    names = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary", pa.bool_(): "boolean"}
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))
    splits = archives.where("size > 0").select("name", "size", F.explode(starts).alias("start")).withColumn("end", F.col("start") + split_bytes)
    many = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return splits.repartition(many, "name", "start").mapInArrow(_read(folder, fields), ", ".join(f"{f} {names[KINDS[f]]}" for f in fields))


def op7_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back in splits."""
    folder = shared_path(spark, "warc")
    archives = write_archives(table(spark, sf_dir, "pages"), folder)
    fields = ["page_id", "payload_bytes", "payload_digest", "digest_ok", "record_type", "refers_to"]
    read = read_archives(archives, folder, fields, split_bytes=4 << 20).where("record_type <> 'warcinfo'")
    sound = F.when(F.coalesce("digest_ok", F.lit(True)), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a payload does not fit its digest")))
    return read.withColumn("payload_digest", sound).drop("digest_ok")


OP7_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS head FROM p),
d AS (SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(h, 1 + 5 * i::INT, 5))::BIGINT) AS parts FROM m)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes,
       array_to_string(list_transform(parts, lambda x: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(x >> 15) + 1] || 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((x >> 10) & 31) + 1]
         || 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((x >> 5) & 31) + 1] || 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(x & 31) + 1]), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM head THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM head THEN NULL ELSE head END AS refers_to
FROM d
"""
