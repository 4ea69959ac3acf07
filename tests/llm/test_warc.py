"""Archives read back what was written; a whole-file stream becomes a member per record with an index."""

from __future__ import annotations

import gzip
import hashlib
import random
import zlib

import pytest

from keyloom.llm import warc as W


def stored(spark, tmp_path, rows: list[tuple]):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    raw, target = f"file://{tmp_path}/raw", f"file://{tmp_path}/warc"
    W.write_monolithic(pages, raw)
    archives = W.normalise(spark, raw, target).cache()
    return archives, target


def test_round_trip(spark, tmp_path, texts):
    rng = random.Random(1)
    big = "<p>é" + "".join(rng.choice("abc数 \r\n") for _ in range(5000))
    rows = [(i, f"http://h{i % 3}/a b\r\n?{i}", t) for i, t in enumerate(texts) if i != 16] + [(100, None, big), (103, "u", big), (101, "v", big), (None, "w", "WARC/1.1\r\n\r\n" * 3)]
    archives, target = stored(spark, tmp_path, rows)
    assert sum(r.n_records for r in archives.collect()) == len(rows)
    got = {r.page_id: r for r in W.read_archives(archives, target).collect()}
    assert len(got) == len(rows)
    for page_id, _, html in rows:
        raw = (html or "").encode()
        r = got[page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        if r.record_type == "response":
            assert r.payload == (html or "") and r.refers_to is None
        else:
            assert r.payload is None and got[r.refers_to].payload_digest == r.payload_digest and got[r.refers_to].record_type == "response"
    assert [got[i].refers_to for i in (100, 101, 103)] == [103, 103, None]


def test_members_and_index(spark, tmp_path):
    rows = [(i, f"http://x/{i}", f"page {i} " * (i * 50)) for i in range(20)]
    archives, target = stored(spark, tmp_path, rows)
    assert sum(r.n_records for r in archives.collect()) == len(rows)
    seen = 0
    for path in (tmp_path / "warc").glob("*.warc.gz"):
        data = path.read_bytes()
        whole = gzip.decompress(data)
        parts = []
        for line in (path.parent / f"{path.name}.idx").read_text().splitlines():
            at, size, _, _ = line.split("\t")
            part = zlib.decompress(data[int(at) : int(at) + int(size)], 31)
            assert part.startswith(b"WARC/1.1\r\n")
            parts.append(part)
        assert b"".join(parts) == whole
        seen += len(parts)
    assert seen == len(rows)


def test_streams_of_any_members_and_chunks():
    record = b"WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    for data in (gzip.compress(record * 50), gzip.compress(record * 20) + gzip.compress(record * 30), b"".join(gzip.compress(record) for _ in range(50))):
        for size in (1, 7, 1 << 20):
            chunks = (data[i : i + size] for i in range(0, len(data), size))
            assert list(W.records(W.inflated(chunks))) == [record] * 50


def test_empty_table(spark, tmp_path):
    archives, target = stored(spark, tmp_path, [(1, "u", "x")])
    assert archives.count() == 1
    none, target = stored(spark, tmp_path / "none", [])
    assert W.read_archives(none, target).count() == 0


def test_cut_archives_are_errors():
    """A stream cut anywhere, in its trailer or between records of a longer one, is no shorter archive."""
    record = b"WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    engine = zlib.compressobj(6, zlib.DEFLATED, 31)
    first = engine.compress(record) + engine.flush(zlib.Z_SYNC_FLUSH)
    whole = first + engine.compress(record * 3) + engine.flush()
    assert list(W.records(W.inflated([whole]))) == [record] * 4
    for data in (first, whole[:-1], whole[:-8], whole[: len(whole) // 2], b""):
        with pytest.raises(ValueError, match="ends"):
            list(W.records(W.inflated([data])))
    with pytest.raises(zlib.error):
        list(W.records(W.inflated([whole[:-8] + bytes(8)])))


def test_clashing_columns_and_repeated_rows(spark, tmp_path):
    """Extra columns are left out; rows that repeat the response's page_id are responses like it."""
    big = "x" * 2000
    rows = [(1, "u", big, "a"), (2, "u", big, "b"), (2, "u", big, "b"), (None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload_digest string")
    raw, target = f"file://{tmp_path}/raw", f"file://{tmp_path}/warc"
    W.write_monolithic(pages, raw)
    got = W.read_archives(W.normalise(spark, raw, target).cache(), target).collect()
    assert sorted(((r.page_id, r.record_type, r.refers_to) for r in got), key=str) == sorted([(1, "revisit", 2), (2, "response", None), (2, "response", None), (None, "response", None)], key=str)
