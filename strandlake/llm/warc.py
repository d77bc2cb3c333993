"""WARC archives, index first.

Writing: each task appends WARC/1.1 records to archives of its own and puts one row per record into an index:
file, offset, length, URL and digest. Only archives that the index names are ever read, so what a
failed or repeated task left behind does no harm. Reading: the wanted index rows are sorted by file and
offset, neighbouring ranges are merged into one read as long as the gap and the merged length are small, and
records are cut from it. No reader scans an archive. Each record is a gzip member of its own.

Archives may lie in any store that pyarrow's file systems reach (file, s3, gs, hdfs, ...); the folder
must be one that all executors share.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.scratch import Scratch

INDEX = "key bigint, url string, record_type string, file string, offset bigint, length bigint, digest string"
_FILE = 256 << 20
_READ, _GAP = 8 << 20, 64 << 10
_FEW = 300_000
_STAMP = datetime(2024, 1, 1, tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1 of the payload."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(*parts: object) -> str:
    """Of a response its key and digest, by which its revisits name it; of a revisit its place too."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, '-'.join(map(str, ('record', *parts))))}>"


def _one_line(text: str | None) -> str:
    return " ".join((text or "").split())


def record(key: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, place: str = "") -> bytes:
    """One record, to be written at ``place``; a revisit keeps the HTTP header with the payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    sha = digest(payload)
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(key, sha, place) if revisit else _record_id(key, sha)}", f"WARC-Date: {_STAMP}",
        f"WARC-Target-URI: {_one_line(url)}", f"WARC-Payload-Digest: sha1:{sha}",
    ]
    if key is not None:
        head.append(f"X-Page-Id: {key}")
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, sha)}"]
        if refers_to is not None:
            head.append(f"X-Refers-To-Page-Id: {refers_to}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The WARC headers (lower-cased names), HTTP headers and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = _fields(head)
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    return {"warc": fields, "http": {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode().split("\r\n")[1:])}, "payload": payload}


def plain(raw: bytes) -> bytes:
    """A record without its gzip, if it has one."""
    return gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw


def plan_records(pages: DataFrame, scratch: Scratch, *, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """(key, url, html, refers_to, revisit) for every row: of equal payloads of ``least`` bytes or more, that of the smallest key is the response.

    Null payloads are empty. Keys that are null are larger than all others; rows that repeat the smallest key of
    a group are responses too. Payloads count as equal if SHA-1 and length are. Digests alone are shuffled, payloads only where
    the groups with copies are too many for a broadcast (_FEW, of a hundred bytes each).
    """
    rows = pages.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{url}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html"))
    first = rows.select("sha", "size", "key").groupBy("sha", "size").agg(F.count("*").alias("c"), F.min("key").alias("first")).where((F.col("c") > 1) & (F.col("size") >= least))
    first = scratch.table(first.select("sha", "size", "first", F.lit(True).alias("many")), "first")
    rows = rows.join(F.broadcast(first) if first.count() <= _FEW else first, ["sha", "size"], "left")
    revisit = F.coalesce("many", F.lit(False)) & F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))
    return rows.select("key", "url", "html", F.when(revisit, F.col("first")).alias("refers_to"), F.coalesce(revisit, F.lit(False)).alias("revisit"))


def write(planned: DataFrame, folder: str, scratch: Scratch) -> DataFrame:
    """Write the archives into ``folder``; returns the index, itself a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        stream, at, name, n = None, 0, "", 0
        who = f"{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:12]}"
        for batch in batches:
            out = []
            for key, url, html, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if stream is None or at >= _FILE:
                    if stream is not None:
                        stream.close()
                    name, at, n = f"part-{who}-{n:04d}.warc.gz", 0, n + 1
                    stream = fs.open_output_stream(f"{base}/{name}", compression=None)
                payload = html.encode()
                raw = gzip.compress(record(key, url, payload, refers_to, revisit, f"{name}:{at}"), mtime=0)
                stream.write(raw)
                out.append({"key": key, "url": url, "record_type": "revisit" if revisit else "response", "file": name, "offset": at, "length": len(raw), "digest": digest(payload)})
                at += len(raw)
            yield pa.RecordBatch.from_pylist(out, _SCHEMA)
        if stream is not None:
            stream.close()

    return scratch.table(planned.mapInArrow(run, INDEX), "index")


_SCHEMA = pa.schema([("key", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("digest", pa.string())])


def merged_ranges(rows: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[int]]]:
    """(file, start, end, numbers of the rows inside) for rows (file, offset, length) sorted by file and offset."""
    run: list[int] = []
    for i, (file, at, length) in enumerate(rows):
        if run and (file != rows[run[0]][0] or at - end > _GAP or max(end, at + length) - start > _READ):  # noqa: F821
            yield rows[run[0]][0], start, end, run  # noqa: F821
            run = []
        if not run:
            start, end = at, at
        run.append(i)
        end = max(end, at + length)
    if run:
        yield rows[run[0]][0], start, end, run


def read(index: DataFrame, folder: str, keep_payload: bool = True) -> DataFrame:
    """(key, url, record_type, refers_to, payload_bytes, payload_digest, payload) of the records that the index rows name.

    Digests of responses are computed from the bytes read and must equal the record's; a revisit has the length
    and digest of the payload that it stands for, and a null payload.
    """
    schema = pa.schema([("key", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        name, source = "", None
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            for file, start, end, inside in merged_ranges(rows):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, fs.open_input_file(f"{base}/{file}")
                raw = source.read_at(end - start, start)
                out = []
                for i in inside:
                    x = parse(plain(raw[rows[i][1] - start : rows[i][1] - start + rows[i][2]]))
                    w = x["warc"]
                    kind, stated = w["warc-type"], w["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and (digest(x["payload"]) != stated or len(x["payload"]) != int(x["http"]["content-length"])):
                        raise ValueError(f"{file} at {rows[i][1]}: the payload does not have the stated digest or length")
                    number = lambda k: int(w[k]) if k in w else None  # noqa: B023, E731
                    out.append({"key": number("x-page-id"), "url": w["warc-target-uri"], "record_type": kind, "refers_to": number("x-refers-to-page-id"), "payload_bytes": int(x["http"]["content-length"]), "payload_digest": stated, "payload": x["payload"] if keep_payload and kind == "response" else None})
                yield pa.RecordBatch.from_pylist(out, schema)
        if source is not None:
            source.close()

    wanted = index.select("file", "offset", "length").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return wanted.mapInArrow(run, "key bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary")


def _walk(f: pa.NativeFile) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, header) of each record of an archive, plain or with a gzip member a record."""
    size, at = f.size(), 0
    zipped = f.read_at(2, 0) == b"\x1f\x8b"
    while at < size:
        raw, end = b"", at
        unzip = zlib.decompressobj(31)
        while b"\r\n\r\n" not in raw or zipped and not unzip.eof:
            more = f.read_at(64 << 10 if zipped else 4096, end)
            if not more:
                raise ValueError(f"cut off at {at}")
            end += len(more)
            more = unzip.decompress(more) if zipped else more
            raw = raw if b"\r\n\r\n" in raw else raw + more
        head = raw[: raw.index(b"\r\n\r\n")]
        length = end - len(unzip.unused_data) - at if zipped else len(head) + int(_fields(head)["content-length"]) + 8
        yield at, length, head
        at += length


def _fields(head: bytes) -> dict[str, str]:
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}


def index_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The index of archives that came without one: one task walks one archive and keeps the headers only."""
    fs, base = pafs.FileSystem.from_uri(folder)
    names = [i.base_name for i in fs.get_file_info(pafs.FileSelector(base)) if i.base_name.endswith((".warc", ".warc.gz"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_file(f"{base}/{name}") as f:
                    out = []
                    for at, length, head in _walk(f):
                        w = _fields(head)
                        out.append({"key": int(w["x-page-id"]) if "x-page-id" in w else None, "url": w.get("warc-target-uri"), "record_type": w["warc-type"], "file": name, "offset": at, "length": length, "digest": w.get("warc-payload-digest", "").removeprefix("sha1:")})
                yield pa.RecordBatch.from_pylist(out, _SCHEMA)

    files = spark.createDataFrame([(n,) for n in names], "file string")
    return files.repartition(max(1, min(len(names), 1000))).mapInArrow(run, INDEX)


def archive(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """Write all pages, read all records back: (key, payload_bytes, payload_digest, record_type, refers_to) and the url.

    Null html is an empty payload, a null url an empty one. Repeated rows each get a record. Empty tables give no
    rows; other columns, of any name, are ignored.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    folder = scratch.folder("archives")
    index = write(plan_records(pages, scratch, key=key, url=url, html=html, least=least), folder, scratch)
    return read(index, folder, keep_payload=False).drop("payload")
