"""WARC archives: records with an index, and coalesced range reads.

Writing gives archives of gzip members, one for each record, and an index row (archive,
offset, length, URL, digest) per record, stored as a table before anything is read. Reading selects
index rows, sorts them by place and joins neighbouring byte ranges into one read.

Archives are opened through Arrow's file systems by their URI, in the shared folder, so any
executor reads what another one wrote. A repeated task writes an archive of a new
name; the index has the rows of finished tasks only, so half-written archives are never read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelwise.llm.common import slices, stored, text_of
from levelwise.sources.scratch import scratch_path

#: Equal payloads below this many bytes are all written out.
REVISIT_BYTES = 1000
#: An archive is closed when it holds so many bytes.
ARCHIVE_BYTES = 256 << 20
#: Ranges with a gap of at most so many bytes are read at once, up to so many bytes.
GAP_BYTES, READ_BYTES = 64 << 10, 8 << 20
#: A task reads about so many bytes of archives; of few bytes each core gets a share.
TASK_BYTES, LEAST_BYTES = 64 << 20, 256 << 10

_INDEX = "page_id long, url string, digest string, record_type string, archive string, offset long, length long"
_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system and path for a Hadoop-style URI or a plain path."""
    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parts.path)
    return fs.FileSystem.from_uri(uri)


def _clean(value: str) -> str:
    """A header value: control characters, which would end the line, percent-coded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def _number(page_id: int | None) -> str:
    return "none" if page_id is None else str(page_id)


def record(
    page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None
) -> bytes:
    """One record, gzip member of its own. A revisit keeps headers and leaves the payload out."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if revisit else payload)
    sha1 = base64.b32encode(bytes.fromhex(digest)).decode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:x-page:{_number(page_id)}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Payload-Digest: sha1:{sha1}",
    ]
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:x-page:{refers_to}>",
        ]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    data = ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def parse(member: bytes) -> dict:
    """Headers and payload of one record; raises if digest or lengths do not hold."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"record {fields['WARC-Record-ID']} has a wrong length")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(
        int(line.split(b":", 1)[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")
    )
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    number = lambda f: None if "none" in f else int(f.rsplit(":", 1)[1].rstrip(">"))
    return {
        "page_id": number(fields["WARC-Record-ID"]),
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": number(fields["WARC-Refers-To"]) if revisit else None,
        "url": fields["WARC-Target-URI"],
        "payload": None if revisit else payload,
    }


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_folder(folder)
        out, name, offset = None, "", 0
        for whole in batches:
            for batch in slices(whole):
                rows = []
                for r in batch.to_pylist():
                    if out is None or offset >= ARCHIVE_BYTES:
                        if out:
                            out.close()
                        name, offset = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                        system.create_dir(base, recursive=True)
                        out = system.open_output_stream(f"{base}/{name}", compression=None)
                    data = record(r["page_id"], r["url"], r["payload"], r["digest"], r["refers_to"])
                    out.write(data)
                    kind = "response" if r["refers_to"] is None else "revisit"
                    rows.append((r["page_id"], r["url"], r["digest"], kind, name, offset, len(data)))
                    offset += len(data)
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(_INDEX_NAMES, row)) for row in rows], schema=_INDEX_ARROW
                )
        if out:
            out.close()

    return run


_INDEX_NAMES = ["page_id", "url", "digest", "record_type", "archive", "offset", "length"]
_TEXT, _LONG = pa.string(), pa.int64()
_INDEX_ARROW = pa.schema(
    list(zip(_INDEX_NAMES, [_LONG, _TEXT, _TEXT, _TEXT, _TEXT, _LONG, _LONG]))
)
_READ_ARROW = pa.schema(
    [
        ("page_id", _LONG), ("payload_bytes", _LONG), ("payload_digest", _TEXT), ("record_type", _TEXT),
        ("refers_to", _LONG), ("url", _TEXT), ("payload", pa.binary()),
    ]
)


def coalesced(places: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Reads (start, end, members) that cover sorted (offset, length) places of one archive."""
    group: list[tuple[int, int]] = []
    for offset, length in places:
        if group:
            start, end = group[0][0], sum(group[-1])
            if offset - end > GAP_BYTES or offset + length - start > READ_BYTES:
                yield start, end, group
                group = []
        group.append((offset, length))
    if group:
        yield group[0][0], sum(group[-1]), group


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_folder(folder)
        for whole in batches:
            for batch in slices(whole, 1024):
                archives = batch.column(0).to_pylist()
                places = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
                for archive in dict.fromkeys(archives):
                    own = [p for a, p in zip(archives, places) if a == archive]
                    with system.open_input_file(f"{base}/{archive}") as file:
                        for start, end, members in coalesced(own):
                            data = file.read_at(end - start, start)
                            rows = [parse(data[o - start : o - start + n]) for o, n in members]
                            yield pa.RecordBatch.from_pylist(rows, schema=_READ_ARROW)

    return run


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) under ``folder``; returns the stored index.

    Of equal payloads of at least ``REVISIT_BYTES`` bytes the one with the largest page_id
    is written out and the others refer to it. A null page_id is less than any and
    refers like others; rows that repeat the largest page_id with the same payload
    are all written out. Null html is an empty payload, a null URL an empty one.
    """
    payload = F.encode(text_of("html"), "UTF-8")
    rows = pages.select(
        "page_id",
        text_of("url").alias("url"),
        payload.alias("payload"),
        F.sha1(payload).alias("digest"),
    )
    # Only digests that come twice; the sum of equal ones is formed map-side.
    large = rows.where(F.octet_length("payload") >= REVISIT_BYTES)
    twice = large.groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("keeper"))
    twice = stored(twice.where("n > 1 and keeper is not null").select(F.col("digest").alias("d"), "keeper"), "repeated-payloads")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper"))
    marked = rows.join(twice, (F.col("digest") == F.col("d")) & (F.octet_length("payload") >= REVISIT_BYTES), "left")
    marked = marked.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))
    return stored(marked.mapInArrow(_writer(folder), _INDEX), "warc-index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records that ``index`` names, from archives under ``folder``.

    Archives are cut into stretches of at most ``READ_BYTES``, which are dealt to as many tasks as their bytes
    call for, so a large archive is shared by many tasks; each sorts its stretches by place and reads on.
    """
    placed = index.select("archive", "offset", "length")
    # The index is stored, so its sum costs little; rows are narrow and work follows the bytes they point at.
    total = placed.agg(F.sum("length")).first()[0] or 0
    cores = index.sparkSession.sparkContext.defaultParallelism
    tasks = max(-(-total // TASK_BYTES), min(cores, -(-total // LEAST_BYTES)), 1)
    stretch = max(LEAST_BYTES, min(READ_BYTES, total // (4 * tasks)))
    dealt = placed.repartition(tasks, "archive", F.floor(F.col("offset") / stretch))
    ordered = dealt.sortWithinPartitions("archive", "offset")
    return ordered.mapInArrow(_reader(folder), _READ)


def archived_pages(pages: DataFrame) -> DataFrame:
    """All pages written to archives and read back, payloads left out."""
    folder = scratch_path(pages.sparkSession, "warc")
    index = write_archives(pages, folder)
    return read_records(index, folder).drop("payload", "url")
