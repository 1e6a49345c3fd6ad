import gzip
import hashlib
import io

import pytest

from dbgauge.llm.warc import chunk_table, op9_warc, plan_records, read_chunks, read_records, read_summary, write_archives

SCHEMA = "page_id bigint, url string, html string, payload string, chunk_no int"


def plain(rows):
    best = {}
    for page_id, html in rows:
        data = (html or "").encode()
        if len(data) >= 1000 and page_id is not None:
            best[data] = max(best.get(data, page_id), page_id)
    out = []
    for page_id, html in rows:
        data = (html or "").encode()
        keeper = best.get(data)
        revisit = keeper is not None and keeper != page_id
        out.append((page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", keeper if revisit else None))
    return sorted(out, key=str)


def test_edges(spark, tmp_path):
    big = "é\r\n\r\nWARC/1.1\r\n" * 100_000
    rows = [(1, None), (2, ""), (3, "x" * 1000), (4, "x" * 1000), (9, "x" * 1000), (9, "x" * 1000), (None, "x" * 1000), (5, "y" * 999), (6, "y" * 999), (7, big), (8, "\r\n\r\n"), (10, None), (-4, big)]
    frame = spark.createDataFrame([(i, None if i == 1 else f"http://x/{i} \n", h, "p", 1) for i, h in rows], SCHEMA)
    for n, (chunk, file) in enumerate([(1 << 18, 1 << 29), (1000, 500)]):
        files = write_archives(chunk_table(plan_records(frame), chunk), f"file://{tmp_path}/w{n}", file)
        got = read_summary(files).collect()
        pick = lambda r: (r.page_id, r.declared_bytes, r.declared_digest, r.record_type, r.refers_to)
        assert sorted(map(pick, got), key=str) == plain(rows)
        parts = {}
        for r in read_chunks(files).orderBy("record_id", "chunk_no").collect():
            parts.setdefault((r.record_id, r.page_id), []).append(r)
        for (_, page_id), pieces in parts.items():
            data = b"".join(bytes(p.chunk) for p in pieces)
            if pieces[0].record_type == "response":
                assert data == (dict(rows)[page_id] or "").encode() and pieces[-1].is_last
            assert max(len(p.chunk) for p in pieces) <= 1 << 18
            at = 0
            for p in pieces:
                at += len(p.chunk)
                assert p.running_digest == hashlib.sha1(data[:at]).hexdigest()
    assert files.count() >= 2
    none = write_archives(chunk_table(plan_records(frame.limit(0))), f"file://{tmp_path}/none")
    assert read_summary(none).count() == 0


def test_archives_are_gzip_members(spark, tmp_path):
    frame = spark.createDataFrame([(1, "http://a", "abc", "", 1)], SCHEMA)
    path = write_archives(chunk_table(plan_records(frame)), f"file://{tmp_path}/g").first().path
    data = gzip.open(path.removeprefix("file://")).read()
    assert data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\nabc\r\n\r\n")
    with pytest.raises(ValueError):
        list(read_records(io.BytesIO(gzip.compress(b"nonsense\r\n"))))
    with pytest.raises(ValueError):
        for _, pieces in read_records(io.BytesIO(gzip.compress(data[:-6]))):
            list(pieces)


def test_query_against_plain(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sorted(map(tuple, op9_warc(spark, sf).collect()), key=str) == plain(rows)
