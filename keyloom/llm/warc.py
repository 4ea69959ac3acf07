"""WARC: pages to archives, and archives inflated once and rewritten a gzip member per record.

Spark's text writer makes monolithic archives: one gzip stream over all records of a file. The normaliser
reads and inflates such a stream once, in bounded chunks, writes every record as its own member and beside the
archive a sidecar index (.idx: offset, length, type and page of each record), so that a reader can seek. It holds
one record at a time, however long the archive is; a stream that ends early or fails its checksum is an error.

Equal payloads of REVISIT_BYTES or more are stored once: the page with the largest id is the response, the
others are revisits that name it.

Defined results: a null html is an empty payload; a null url an empty one; a null page_id reads back as
null. Repeated rows of one page_id are records of their own; of equal large ones all are responses' twins,
so a row that repeats the response's page_id is a response too. Files are committed by rename and have the
same bytes each time, so a task that runs again does no harm. Payloads of any length are one record; an empty
table gives archives without records and no rows; other columns of the input are left out.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.llm.shared import BROADCAST_BYTES, new_path, written

REVISIT_BYTES = 1000
#: Records of one monolithic file at most.
RECORDS_PER_FILE = 2000
CHUNK = 1 << 20
LEVEL = 6
CRLF = "\r\n"


def described(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with payload, payload_bytes, payload_digest, record_type, refers_to."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    digests = rows.withColumn("payload_digest", F.sha1("payload"))
    large = digests.where(F.col("payload_bytes") >= REVISIT_BYTES)
    shared = large.groupBy("payload_digest").agg(F.max("page_id").alias("__response"), F.count("*").alias("__n")).where("__n > 1").select("payload_digest", "__response")
    shared = written(shared, "warc-shared")
    small = shared.count() * 80 <= BROADCAST_BYTES
    joined = digests.join(F.broadcast(shared) if small else shared, "payload_digest", "left")
    again = F.col("__response").isNotNull() & (F.col("payload_bytes") >= REVISIT_BYTES) & ~F.col("__response").eqNullSafe(F.col("page_id"))
    return joined.select(
        "page_id",
        "url",
        "payload",
        "payload_bytes",
        "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("__response")).alias("refers_to"),
    )


def record_text() -> Column:
    """The record of a described row, without the blank lines that end it."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), text("payload_bytes"), F.lit(CRLF * 2))
    revisit = F.col("record_type") == "revisit"
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    uri = F.regexp_replace(text("url"), "[\\x00-\\x20]", "%20")
    fields = [
        ("WARC-Type", F.col("record_type")),
        ("WARC-Record-ID", F.concat(F.lit("<urn:page:"), text("page_id"), F.lit(">"))),
        ("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        ("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<urn:page:"), text("refers_to"), F.lit(">")))),
        ("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", F.octet_length(block).cast("string")),
    ]
    head = F.concat(F.lit(f"WARC/1.1{CRLF}"), *[F.coalesce(F.concat(F.lit(f"{k}: "), v, F.lit(CRLF)), F.lit("")) for k, v in fields])
    return F.concat(head, F.lit(CRLF), block)


def write_monolithic(pages: DataFrame, path: str) -> None:
    """Write pages as gzipped WARC files, each one stream over all its records."""
    described(pages).select(record_text().alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def inflated(content: Iterable[bytes]) -> Iterator[bytes]:
    """The bytes of a gzip file, whatever its members, in chunks; an error if its last member does not end."""
    engine = zlib.decompressobj(31)
    for chunk in content:
        while chunk:
            if engine.eof:
                engine = zlib.decompressobj(31)
            out = engine.decompress(chunk, CHUNK)
            if out:
                yield out
            chunk = engine.unused_data if engine.eof else engine.unconsumed_tail
    while not engine.eof and (out := engine.decompress(b"", CHUNK)):
        yield out
    if not engine.eof:
        raise ValueError("the archive's gzip stream ends early")


def chunks(fs: pafs.FileSystem, path: str) -> Iterator[bytes]:
    with fs.open_input_stream(path, compression=None) as f:
        while chunk := f.read(CHUNK):
            yield chunk


def records(stream: Iterable[bytes]) -> Iterator[bytes]:
    """Single WARC records (with their ending blank lines) of an inflated stream; at most one is held."""
    held = bytearray()
    need = -1
    for chunk in stream:
        held += chunk
        while True:
            if need < 0:
                at = held.find(b"\r\n\r\n")
                if at < 0:
                    break
                need = at + 4 + int(header(bytes(held[:at]))["content-length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = -1
    if held.strip():
        raise ValueError("the archive ends inside a record")


def header(head: bytes) -> dict[str, str]:
    lines = head.decode().split(CRLF)
    return {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}


def parsed(record: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of a record."""
    at = record.index(b"\r\n\r\n")
    warc = header(record[:at])
    block = record[at + 4 : at + 4 + int(warc["content-length"])]
    end = block.index(b"\r\n\r\n")
    return warc, header(block[:end]), block[end + 4 :]


def page_of(field: str | None) -> int | None:
    number = (field or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


INDEX = T.StructType([T.StructField("archive", T.StringType()), T.StructField("n_records", T.LongType()), T.StructField("bytes", T.LongType())])


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Rewrite every *.gz under source to target, a member per record with a sidecar index.

    Returns (archive, n_records, bytes). source and target are URIs that pyarrow can open on every executor.
    """
    pafs.FileSystem.from_uri(target)[0].create_dir(pafs.FileSystem.from_uri(target)[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(target)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                path = re.sub("^file:/(?!/)", "file:///", path)
                name = path.rsplit("/", 1)[1].split(".")[0]
                token = hashlib.sha1(path.encode()).hexdigest()[:12]
                final = f"{root}/{name}-{token}.warc.gz"
                lines, at = [], 0
                draft = f"{final}.{uuid.uuid4().hex}"
                with fs.open_output_stream(draft) as out:
                    for record in records(inflated(chunks(*pafs.FileSystem.from_uri(path)))):
                        engine = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = engine.compress(record) + engine.flush()
                        fields = header(record[: record.index(b"\r\n\r\n")])
                        lines.append(f"{at}\t{len(member)}\t{fields['warc-type']}\t{fields['warc-record-id']}")
                        out.write(member)
                        at += len(member)
                with fs.open_output_stream(f"{draft}.idx") as out:
                    out.write("".join(f"{x}\n" for x in lines).encode())
                fs.move(f"{draft}.idx", f"{final}.idx")
                fs.move(draft, final)
                yield pa.RecordBatch.from_arrays([pa.array([final.rsplit("/", 1)[1]]), pa.array([len(lines)], pa.int64()), pa.array([at], pa.int64())], names=INDEX.names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path")  # content stays unread
    return files.mapInArrow(run, INDEX)


PAGES = T.StructType([T.StructField(n, k()) for n, k in (("page_id", T.LongType), ("url", T.StringType), ("payload", T.StringType), ("payload_bytes", T.LongType), ("payload_digest", T.StringType), ("record_type", T.StringType), ("refers_to", T.LongType))])


def read_archives(archives: DataFrame, target: str, payloads: bool = True) -> DataFrame:
    """Records of the normalised archives, found by their sidecar indexes; a payload that fails its digest is an error.

    A revisit has no payload of its own (null); its bytes and digest are those it declares for the full one.
    """
    wanted = PAGES if payloads else T.StructType([f for f in PAGES if f.name != "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(target)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{root}/{name}.idx") as f:
                    entries = f.read().decode().splitlines()
                rows: list[tuple] = []
                held = 0
                with fs.open_input_file(f"{root}/{name}") as f:
                    for entry in entries:
                        at, size, kind, _ = entry.split("\t")
                        warc, http, payload = parsed(zlib.decompress(f.read_at(int(size), int(at)), 31))
                        digest = warc["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(http["content-length"])):
                            raise ValueError(f"a payload of {name} fails its digest")
                        body = payload.decode() if kind == "response" and payloads else None
                        rows.append((page_of(warc["warc-record-id"]), warc["warc-target-uri"], body, int(http["content-length"]), digest, kind, page_of(warc.get("warc-refers-to"))))
                        held += len(body or "")
                        if held > 8 * CHUNK:
                            yield _batch(rows, wanted)
                            rows, held = [], 0
                yield _batch(rows, wanted)

    def _batch(rows: list[tuple], kind: T.StructType) -> pa.RecordBatch:
        types = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64()}
        at = [PAGES.names.index(n) for n in kind.names]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], types.get(n, pa.string())) for k, n in zip(at, kind.names, strict=True)], names=kind.names)

    return archives.select("archive").mapInArrow(run, wanted)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, target = new_path(spark, "warc-raw"), new_path(spark, "warc")
    write_monolithic(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), raw)
    archives = written(normalise(spark, raw, target), "warc-archives")
    archives = archives.repartition(max(1, spark.sparkContext.defaultParallelism))
    return read_archives(archives, target, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS d, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
r AS (SELECT d, max(page_id) AS response FROM p WHERE n >= {REVISIT_BYTES} GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
 CASE WHEN response <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN response <> page_id THEN response END AS refers_to
FROM p LEFT JOIN r ON p.d = r.d AND p.n >= {REVISIT_BYTES}"""
