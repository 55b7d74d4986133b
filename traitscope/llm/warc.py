"""WARC archives with an index first.

Writing records (gzip members, one per record) returns an index row per record: archive, offset,
length, URL and digest. Reading takes rows of the index, sorts them by place, coalesces neighbouring
byte ranges into few reads, and parses the records.

Payloads are told apart by SHA-256. Of pages with equal payloads of at least ``least`` bytes the one
with the smallest page_id is a response, the others are revisit records without the payload, which
refer to it.

Defined cases: a null html is the empty payload; a null url leaves the field out; a null page_id is
never referred to (it revisits the smallest id, and is a response where all ids of a payload are
null); rows that share the smallest page_id and the payload are all responses; other rows are
written one by one. An empty table gives an empty index. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitscope.llm.common import salted_join, trimmed
from traitscope.session import materialise, shared_folder

LEAST, ARCHIVE_BYTES, GAP, RANGE = 100, 256 << 20, 1 << 16, 16 << 20
#: Archive bytes that a task reads; a small archive is spread over the cores, in spans of at least SMALLEST.
TASK_BYTES, SMALLEST = 128 << 20, 1 << 20
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def _clean(value: str) -> str:
    """A header value on one line: controls and blanks are percent-encoded."""
    return "".join(c if 32 < ord(c) != 127 else f"%{ord(c):02X}" for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, name: str) -> bytes:
    """One WARC record; a record that refers to another is a revisit without payload."""
    revisit = refers_to is not None
    head = HTTP % len(payload)
    block = head if revisit else head + payload
    identity = f"urn:page:{page_id}" if page_id is not None else uuid.uuid5(uuid.NAMESPACE_URL, name).urn
    fields = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{identity}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        *([f"WARC-Target-URI: {_clean(url)}"] if url is not None else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>"] if revisit else []),
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Fields and payload of a record; the HTTP head gives the length of the full payload."""
    head, rest = data.split(b"\r\n\r\n", 1)
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n" or len(block) != int(fields["content-length"]):
        raise ValueError("record is cut short")
    http, payload = block.split(b"\r\n\r\n", 1)
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    if fields["warc-type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("payload does not match its digest")

    def page(field: str) -> int | None:
        value = fields.get(field, "")
        return int(value[10:-1]) if value.startswith("<urn:page:") else None

    return {
        "page_id": page("warc-record-id"),
        "url": fields.get("warc-target-uri"),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": fields["warc-type"],
        "refers_to": page("warc-refers-to"),
        "payload": payload if fields["warc-type"] == "response" else None,
    }


def filesystem(path: str):
    """File system and path of a shared folder: local, HDFS or an object store."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


INDEX = "archive string, offset long, length long, page_id long, url string, digest string, record_type string"
INDEX_ARROW = pa.schema(
    [("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string())]
)


def _write(folder: str, archive_bytes: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        name, out, at = "", None, 0
        try:
            for batch in source:
                rows = []
                columns = [batch.column(i) for i in range(5)]
                ids, urls, digests, refers = (c.to_pylist() for c in (columns[0], columns[1], columns[3], columns[4]))
                for i, html in enumerate(columns[2]):
                    if out is None or at >= archive_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(os.path.join(root, name), compression=None)
                    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                    whole = record(ids[i], urls[i], html.as_py(), digests[i], refers[i], f"{name}:{at}")
                    data = pack.compress(whole) + pack.flush()
                    out.write(data)
                    kind = "response" if refers[i] is None else "revisit"
                    rows.append((name, at, len(data), ids[i], urls[i], digests[i], kind))
                    at += len(data)
                if rows:
                    arrays = [pa.array(c, f.type) for c, f in zip(zip(*rows), INDEX_ARROW)]
                    yield pa.RecordBatch.from_arrays(arrays, schema=INDEX_ARROW)
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(pages: DataFrame, folder: str, least: int = LEAST, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) and return the written index.

    Every task writes archives of its own under unique names; what a lost task left behind is in no
    index. Only digests are grouped; payloads are shuffled once, to the join with the first pages.
    """
    store, root = filesystem(folder)
    store.create_dir(root, recursive=True)
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"))
    marked = pages.select("*", F.sha2("html", 256).alias("digest"))
    first = marked.where(F.octet_length("html") >= least).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    first = materialise(first.where("n > 1").select("digest", "first_id"), "warc-first")
    joined = salted_join(marked, first, ["digest"], F.coalesce("page_id", F.lit(-1).cast("long")), how="left", written=True)
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    rows = joined.select("page_id", "url", "html", "digest", refers.alias("refers_to"))
    return materialise(rows.mapInArrow(trimmed(_write(folder, archive_bytes)), INDEX), "warc-index")


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
RECORD_ARROW = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
)


def ranges(places: list[tuple[int, int]], gap: int = GAP, most: int = RANGE) -> list[tuple[int, int, int]]:
    """Byte ranges (first place, last place + 1, end byte) that cover sorted (offset, length) places."""
    out: list[tuple[int, int, int]] = []
    first = 0
    for i, (offset, length) in enumerate(places):
        end = places[i - 1][0] + places[i - 1][1] if i else 0
        if i and (offset - end > gap or offset + length - places[first][0] > most):
            out.append((first, i, end))
            first = i
    if places:
        out.append((first, len(places), places[-1][0] + places[-1][1]))
    return out


def _read(folder: str, payloads: bool):
    schema = RECORD_ARROW if payloads else RECORD_ARROW.remove(6)

    def records(file, places: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        for a, b, end in ranges(places):
            begin = places[a][0]
            data = file.read_at(end - begin, begin)
            rows = [parse(zlib.decompress(data[o - begin : o - begin + n], 31)) for o, n in places[a:b]]
            yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        name, file = None, None
        for batch in source:
            places: list[tuple[int, int]] = []
            for archive, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if archive != name:
                    if places:
                        yield from records(file, places)
                    name, file, places = archive, store.open_input_file(os.path.join(root, archive)), []
                places.append((offset, length))
            if places:
                yield from records(file, places)

    return run


def read_archives(index: DataFrame, folder: str, payloads: bool = False, span: int = RANGE, smallest: int = SMALLEST) -> DataFrame:
    """The records that rows of an index select, each parsed and checked against its digest.

    Tasks get whole spans of an archive, sorted by offset. Their number comes from the bytes to read:
    the index is so small that Spark would judge by it that one task is enough.
    """
    total, cores = index.agg(F.sum("length")).first()[0] or 0, index.sparkSession.sparkContext.defaultParallelism
    span = max(min(span, -(-total // (4 * cores))), smallest)
    tasks = max(-(-total // TASK_BYTES), min(cores, -(-total // span)), 1)
    places = index.select("archive", "offset", "length").repartition(tasks, "archive", F.floor(F.col("offset") / span))
    return places.sortWithinPartitions("archive", "offset").mapInArrow(
        trimmed(_read(folder, payloads)), RECORD + (", payload binary" if payloads else "")
    )


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write archives of ``pages`` under the shared folder and read every record back."""
    folder = os.path.join(shared_folder(pages.sparkSession), "traitscope", f"warc-{uuid.uuid4().hex}")
    return read_archives(write_archives(pages, folder), folder)
