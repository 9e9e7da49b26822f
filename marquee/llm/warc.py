"""WARC archives: a writer of monolithic gzip files, a normaliser and an indexed reader.

The writer puts many records in one gzip stream a file. The normaliser inflates such a stream once, start to end, writes
every record as a gzip member of its own and leaves a sidecar index (JSON lines: offset, length and main headers of each
record), so that the reader fetches any record by one ranged read. All three stream: no step holds more than a chunk of a
record, a file's compressed bytes (writer) or its index.

Of records with equal payloads of at least `min_bytes` bytes, that with the smallest page_id is a response and the others are
revisits of it; repeated rows of that page are responses too. A null html is an empty payload, a null url becomes
`urn:page:<page_id>`. A null page_id is larger than any other. An empty table gives no file. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, n_parts, saved, shared_dir, write_file

CHUNK = 1 << 20
DATE = "2000-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def record_id(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def record(headers: dict[str, str], block: bytes) -> bytes:
    lines = "".join(f"{k}: {' '.join(str(v).split())}\r\n" for k, v in headers.items())
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def page_record(page: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    head = {"WARC-Type": "response" if first is None else "revisit", "WARC-Record-ID": record_id(page), "WARC-Date": DATE, "WARC-Target-URI": url or f"urn:page:{page}", "WARC-Payload-Digest": f"sha1:{digest}"}
    if page is not None:
        head["X-Page-Id"] = str(page)
    http = HTTP % len(payload)
    if first is None:
        return record(head | {"Content-Type": "application/http; msgtype=response"}, http + payload)
    head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(first), "X-Refers-To-Page": str(first), "X-Payload-Length": str(len(payload))}
    return record(head | {"Content-Type": "application/http; msgtype=response"}, http)


def first_copies(pages: DataFrame, min_bytes: int) -> DataFrame:
    """(digest, first) of payloads that several rows have: grouped minima combine before the shuffle."""
    sizes = pages.filter(F.octet_length("html") >= min_bytes)
    return saved(sizes.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first"), "warc-first")


def write_monolithic(pages: DataFrame, min_bytes: int = 0, file_bytes: int = 64 << 20) -> DataFrame:
    """Write the archives, each one gzip stream of at most about `file_bytes` before compression; returns the saved
    table of files (folder, name, records)."""
    folder = shared_dir(pages.sparkSession, "warc-raw")

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, k, n, held, out, gz = TaskContext.get().partitionId(), 0, 0, 0, [], None

        def close():
            nonlocal k, n, held, out, gz
            name = f"pages-{pid:06d}-{k:06d}.warc.gz"
            write_file(folder, name, [*out, gz.flush()])
            row = {"folder": folder, "name": name, "records": n}
            k, n, held, out, gz = k + 1, 0, 0, [], None
            return pa.RecordBatch.from_pylist([row], FILES)

        for batch in batches:
            for page, url, html, digest, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "first")), strict=True):
                if gz is None:
                    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
                    out.append(gz.compress(record({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'file:{pid}-{k}')}>", "WARC-Date": DATE, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")))
                raw = page_record(page, url, html.encode(), base32(digest), None if first == page else first)
                out.append(gz.compress(raw))
                n, held = n + 1, held + len(raw)
                if held >= file_bytes:
                    yield close()
        if gz is not None:
            yield close()

    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    return saved(rows.join(first_copies(rows, min_bytes), "digest", "left").select("page_id", "url", "html", "digest", "first").mapInArrow(archives, "folder string, name string, records long"), "warc-files")


FILES = pa.schema([("folder", pa.string()), ("name", pa.string()), ("records", pa.int64())])


def inflate(stream) -> Iterator[bytes]:
    """The bytes of a gzip file of any number of members, at most `CHUNK` at a time, however well they are compressed."""
    gz = None
    while data := stream.read(CHUNK):
        while data:
            gz = gz or zlib.decompressobj(31)
            yield gz.decompress(data, CHUNK)
            data = gz.unconsumed_tail
            if gz.eof:
                data, gz = gz.unused_data, None
        while gz is not None and not gz.eof and (more := gz.decompress(b"", CHUNK)):  # what it still holds back
            yield more
        if gz is not None and gz.eof:
            gz = None
    if gz is not None:
        raise ValueError("the gzip stream ends early")


def headers_of(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    return dict(line.split(": ", 1) for line in lines[1:] if line)


def rewrite(chunks: Iterator[bytes], index: list[dict]) -> Iterator[bytes]:
    """Records of an inflated stream, each as a member of its own; `index` gets an entry for each."""
    held, offset = bytearray(), 0
    while True:
        while b"\r\n\r\n" not in held:
            more = next(chunks, None)
            if more is None:
                if held:
                    raise ValueError("the archive ends inside a record")
                return
            held += more
        cut = held.index(b"\r\n\r\n") + 4
        head = headers_of(bytes(held[: cut - 4]))
        left, gz, length = cut + int(head["Content-Length"]) + 4, zlib.compressobj(6, zlib.DEFLATED, 31), 0
        while left:
            if not held:
                more = next(chunks, None)
                if more is None:
                    raise ValueError("the archive ends inside a record")
                held += more
            piece = bytes(held[:left])
            del held[: len(piece)]
            left -= len(piece)
            packed = gz.compress(piece)
            length += len(packed)
            yield packed
        packed = gz.flush()
        length += len(packed)
        yield packed
        index.append({"offset": offset, "length": length, "type": head.get("WARC-Type"), "id": head.get("WARC-Record-ID"), "uri": head.get("WARC-Target-URI"), "digest": head.get("WARC-Payload-Digest")})
        offset += length


def normalise(files: DataFrame) -> DataFrame:
    """Rewrite each archive of `files` (folder, name) with a member for each record and a sidecar index `<name>.idx`;
    returns the saved table of the new files (folder, name, records)."""
    folder = shared_dir(files.sparkSession, "warc")

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, name in zip(batch.column("folder").to_pylist(), batch.column("name").to_pylist(), strict=True):
                where, path = filesystem(source)
                index: list[dict] = []
                with where.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    write_file(folder, name, rewrite(inflate(stream), index))
                write_file(folder, f"{name}.idx", (json.dumps(x).encode() + b"\n" for x in index))
                yield pa.RecordBatch.from_pylist([{"folder": folder, "name": name, "records": len(index)}], FILES)

    spread = files.select("folder", "name").repartition(n_parts(files.sparkSession))
    return saved(spread.mapInArrow(archives, "folder string, name string, records long"), "warc-members")


def page_row(chunks: Iterator[bytes]) -> dict:
    """What the bytes of a page's record tell, payload digest checked; the payload isn't held."""
    held = bytearray()
    while held.count(b"\r\n\r\n") < 2:
        held += next(chunks)
    cut = held.index(b"\r\n\r\n") + 4
    begin = held.index(b"\r\n\r\n", cut) + 4
    head = headers_of(bytes(held[: cut - 4]))
    page = int(head["X-Page-Id"]) if "X-Page-Id" in head else None
    if head["WARC-Type"] == "revisit":
        size, digest, to = int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Refers-To-Page"])
    else:
        size, sha, to = cut + int(head["Content-Length"]) - begin, hashlib.sha1(), None
        left, part = size, bytes(held[begin : begin + size])
        while left:
            sha.update(part)
            left -= len(part)
            part = next(chunks)[:left] if left else b""
        digest = base64.b32encode(sha.digest()).decode()
        if f"sha1:{digest}" != head["WARC-Payload-Digest"]:
            raise ValueError(f"payload of page {page} differs from its digest")
    return {"page_id": page, "payload_bytes": size, "payload_digest": digest, "record_type": head["WARC-Type"], "refers_to": to}


class Member:
    """The compressed bytes of one record in an archive, read in parts."""

    def __init__(self, file, offset: int, length: int):
        self.file, self.at, self.end = file, offset, offset + length

    def read(self, n: int) -> bytes:
        self.file.seek(self.at)
        data = self.file.read(min(n, self.end - self.at))
        self.at += len(data)
        return data


def read(files: DataFrame) -> DataFrame:
    """Fetch each response and revisit by its index entry: (page_id, payload_bytes, payload_digest, record_type, refers_to)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, name in zip(batch.column("folder").to_pylist(), batch.column("name").to_pylist(), strict=True):
                where, path = filesystem(folder)
                with where.open_input_stream(f"{path}/{name}.idx", compression=None) as f:
                    index = [json.loads(line) for line in f.read().splitlines()]
                out: list[dict] = []
                with where.open_input_file(f"{path}/{name}") as f:
                    for x in index:
                        if x["type"] in ("response", "revisit"):
                            out.append(page_row(inflate(Member(f, x["offset"], x["length"]))))
                        if len(out) >= 4096:
                            yield pa.RecordBatch.from_pylist(out, PAGES)
                            out = []
                if out:
                    yield pa.RecordBatch.from_pylist(out, PAGES)

    spread = files.select("folder", "name").repartition(n_parts(files.sparkSession))
    return spread.mapInArrow(rows, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


PAGES = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
