import base64
import gzip
import hashlib
import io
import random
import zlib

import pytest

from marquee.llm import warc
from marquee.llm.common import filesystem

ROWS = [(5, "u5", "same", "x"), (2, None, "same", "x"), (9, "u9", "other", "x"), (7, "u7", None, "x"), (8, "u8", "", "x"), (None, "u", "same", "x"), (2, None, "same", "x"), (11, "a b\nc", "é\r\n\r\nWARC/1.1\r\n" * 99999, "x")]


def brute(rows, least=0):
    out = []
    for page, _, html, _ in rows:
        payload = (html or "").encode()
        same = [r[0] for r in rows if (r[2] or "") == (html or "") and r[0] is not None]
        first = min(same, default=None)
        revisit = len(payload) >= least and first is not None and page != first
        out.append((page, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize(("least", "size"), [(0, 1 << 26), (4, 100), (10**9, 1)])
def test_pages_are_read_back(spark, least, size):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string, name string").repartition(3)
    files = warc.write_monolithic(pages, least, size)
    new = warc.normalise(files)
    assert sorted(map(tuple, warc.read(new).collect()), key=str) == brute(ROWS, least)
    for row in files.collect():  # one member before, a member for each record after
        where, path = filesystem(row.folder)
        raw = where.open_input_stream(f"{path}/{row.name}", compression=None).read()
        one = zlib.decompressobj(31)
        one.decompress(raw)
        assert one.eof and not one.unused_data
    for row in new.collect():
        where, path = filesystem(row.folder)
        raw, n = where.open_input_stream(f"{path}/{row.name}", compression=None).read(), 0
        while raw:
            one = zlib.decompressobj(31)
            assert one.decompress(raw).startswith(b"WARC/1.1\r\n")
            raw, n = one.unused_data, n + 1
        assert n == row.records


def test_no_pages(spark):
    assert warc.read(warc.normalise(warc.write_monolithic(spark.createDataFrame([], "page_id long, url string, html string")))).count() == 0


def test_broken_streams_are_refused():
    raw = gzip.compress(warc.page_record(1, "u", b"abc", "D", None))
    with pytest.raises(ValueError, match="ends"):
        list(warc.rewrite(warc.inflate(io.BytesIO(raw[:-9])), []))
    with pytest.raises(ValueError, match="inside"):
        list(warc.rewrite(iter([warc.page_record(1, "u", b"abc", "D", None)[:-2]]), []))
    with pytest.raises(ValueError, match="no WARC"):
        list(warc.rewrite(iter([b"HTTP/1.1 200\r\n\r\n"]), []))


def test_inflation_is_bounded():
    for parts in ([b"a" * 20_000_000], [b"x", b"", b"y" * 5_000_000], [random.Random(1).randbytes(3_000_000), b"z" * 1_500_000], [b"a" * warc.CHUNK], [b""]):
        chunks = list(warc.inflate(io.BytesIO(b"".join(map(gzip.compress, parts)))))
        assert b"".join(chunks) == b"".join(parts) and max(map(len, chunks)) <= warc.CHUNK


def test_a_long_page(spark):
    pages = spark.createDataFrame([(1, "u", "a" * 5_000_000 + "\r\n\r\n"), (2, "u", "\r\n\r\n" * 3)], "page_id long, url string, html string")
    got = warc.read(warc.normalise(warc.write_monolithic(pages))).orderBy("page_id").collect()
    want = [("a" * 5_000_000 + "\r\n\r\n").encode(), b"\r\n\r\n" * 3]
    assert [(r.payload_bytes, r.payload_digest) for r in got] == [(len(w), base64.b32encode(hashlib.sha1(w).digest()).decode()) for w in want]
