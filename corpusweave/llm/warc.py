"""WARC archives: write captures as request, response or revisit, and metadata records; read them
back and put each capture together again.

Method: records of one capture name the response record in WARC-Concurrent-To. Reading joins
the three record kinds through that identifier and returns one nested row per capture."""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import land, scratch_path
from .common import input_columns, lookup, shared_file, text_slices

VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
MANIFEST = "path string, records bigint, bytes bigint"
READ_BYTES = 1 << 20


def _record_id(kind: str, page_id, digest: str, ordinal: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}|{page_id}|{digest}|{ordinal}')}>"


def _record(kind: str, record_id: str, uri: str, content_type: str, block: bytes, **headers) -> bytes:
    """One record as a gzip member of its own, so that readers can start at any record."""
    fields = {"WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Date": DATE, "WARC-Target-URI": uri, **headers}
    fields |= {"Content-Type": content_type, "Content-Length": str(len(block))}
    head = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush()


def _capture(page_id, url: str, payload: bytes, digest: str, ordinal: int, refers_to) -> bytes:
    """The three records of one page."""
    uri = quote(url or "about:blank", safe="%/:=&?~#+!$,;'@()*[]")
    main = _record_id("response", page_id, digest, ordinal)
    stored = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    http = "application/http; msgtype="
    if refers_to is None:
        response = _record("response", main, uri, http + "response", head + payload, **{"WARC-Payload-Digest": stored})
    else:
        extra = {"WARC-Payload-Digest": stored, "WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": refers_to}
        response = _record("revisit", main, uri, http + "response", head, **extra)
    try:
        parts = urlsplit(uri)
        asked = f"GET {parts.path or '/'}{'?' + parts.query if parts.query else ''} HTTP/1.1\r\nHost: {parts.netloc}\r\n\r\n"
    except ValueError:
        asked = "GET / HTTP/1.1\r\n\r\n"
    concurrent = {"WARC-Concurrent-To": main}
    request = _record("request", _record_id("request", page_id, digest, ordinal), uri, http + "request", asked.encode(), **concurrent)
    known = b"" if page_id is None else f"page-id: {page_id}\r\n".encode()
    metadata = _record("metadata", _record_id("metadata", page_id, digest, ordinal), uri, "application/warc-fields", known, **concurrent)
    return request + response + metadata


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """One archive per task under a name of its own; the row with the name is the commit, so a
    file left by a lost task is never read."""
    system, root = shared_file(folder)
    path = f"{root}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
    records = size = 0
    sink = None
    for batch in text_slices(batches, "html"):
        columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "ordinal", "original", "revisit")]
        for page_id, url, html, digest, ordinal, original, revisit in zip(*columns, strict=True):
            if sink is None:
                system.create_dir(root, recursive=True)
                sink = system.open_output_stream(path)
            target = _record_id("response", original, digest, 0) if revisit else None
            data = _capture(page_id, url, (html or "").encode(), digest, ordinal, target)
            sink.write(data)
            records, size = records + 3, size + len(data)
    if sink is not None:
        sink.close()
        yield pa.RecordBatch.from_pydict({"path": [path], "records": [records], "bytes": [size]})


def write_archives(pages: DataFrame, min_payload: int = 0, folder: str | None = None) -> DataFrame:
    """Write every row (page_id, url, html) and return the manifest: path, records, bytes.

    Of rows whose payloads of at least `min_payload` bytes are equal, the one with the smallest
    id is the response and the others are revisits of it; of repeated ids, the first row.
    Null html is an empty payload, a null url becomes about:blank, a null id is larger than any
    other and is left out of the metadata. Only digests are grouped; payloads do not move, unless
    there are more revisited payloads than a measured broadcast may hold."""
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    rows = input_columns(pages, page_id="page_id", url="url", html="html")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = rows.withColumn("digest", F.sha1(payload)).withColumn("length", F.octet_length(payload).cast("long"))
    per_id = land(rows.groupBy("digest", "length", "page_id").agg(F.count(F.lit(1)).alias("n")), "warc-digests")
    shared = per_id.groupBy("digest", "length").agg(F.sum("n").alias("copies"), F.min("page_id").alias("original"), F.max("n").alias("same_id"))
    shared = land(shared.filter((F.col("copies") > 1) & (F.col("length") >= min_payload)), "warc-shared")
    repeated = per_id.filter("n > 1").select("digest", "page_id").withColumn("again", F.lit(True))
    if repeated.isEmpty():
        rows = rows.withColumn("ordinal", F.lit(0))
    else:  # repeated rows: number them, so that each has identifiers of its own
        order = Window.partitionBy("digest", "page_id").orderBy("url")
        rows = lookup(rows, land(repeated, "warc-repeated"), ["digest", "page_id"])
        again = rows.filter("again").withColumn("ordinal", F.row_number().over(order) - 1)
        rows = rows.filter("again is null").withColumn("ordinal", F.lit(0)).unionByName(again)
    rows = lookup(rows, shared.select("digest", "length", "original", F.lit(True).alias("is_shared")), ["digest", "length"])
    first = F.col("page_id").eqNullSafe(F.col("original")) & (F.col("ordinal") == 0)
    revisit = F.coalesce(F.col("is_shared"), F.lit(False)) & ~first
    rows = rows.select("page_id", "url", "html", "digest", "ordinal", "original", revisit.alias("revisit"))
    return land(rows.mapInArrow(lambda it: _write(it, folder), MANIFEST), "warc-manifest").withColumn("folder", F.lit(folder))


class _Records:
    """Records of one archive, read as a stream of gzip members."""

    def __init__(self, stream: io.RawIOBase):
        self.stream, self.pending = stream, b""

    def member(self) -> bytes | None:
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            data = self.pending or self.stream.read(READ_BYTES)
            if not data:
                if parts:
                    raise ValueError("archive ends inside a record")
                return None
            parts.append(unpacker.decompress(data))
            self.pending = unpacker.unused_data
        return b"".join(parts)

    def __iter__(self):
        while (data := self.member()) is not None:
            head, _, rest = data.partition(b"\r\n\r\n")
            first, *lines = head.split(b"\r\n")
            if not first.startswith(b"WARC/"):
                raise ValueError("not a WARC record")
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.decode().partition(":") for x in lines)}
            yield fields, rest[: int(fields["content-length"])]


def _fields(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, sep, v in (x.partition(":") for x in lines) if sep}


RECORD = {
    "record_id": pa.string(),
    "record_type": pa.string(),
    "target_uri": pa.string(),
    "concurrent_to": pa.string(),
    "refers_to": pa.string(),
    "payload_digest": pa.string(),
    "payload_bytes": pa.int64(),
    "page_id": pa.string(),
    "block": pa.binary(),
}
RECORD_DDL = "record_id string, record_type string, target_uri string, concurrent_to string, refers_to string, payload_digest string, payload_bytes bigint, page_id string, block binary"


def _read(batches: Iterator[pa.RecordBatch], kinds: tuple[str, ...], blocks: bool) -> Iterator[pa.RecordBatch]:
    """Records of the wanted kinds. A response's digest is taken again from its payload."""
    schema = pa.schema(list(RECORD.items()))
    for batch in batches:
        for folder, path in zip(batch.column("folder").to_pylist(), batch.column("path").to_pylist(), strict=True):
            rows, held = [], 0
            with shared_file(folder)[0].open_input_stream(path) as stream:
                for fields, block in _Records(stream):
                    kind = fields["warc-type"]
                    if kind not in kinds:
                        continue
                    row = dict.fromkeys(RECORD)
                    row |= {"record_id": fields["warc-record-id"], "record_type": kind, "target_uri": fields.get("warc-target-uri")}
                    row |= {"concurrent_to": fields.get("warc-concurrent-to"), "refers_to": fields.get("warc-refers-to")}
                    if kind in ("response", "revisit"):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response":
                            found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                            if found != digest:
                                raise ValueError(f"{path}: payload of {row['record_id']} does not match its digest")
                        row |= {"payload_digest": digest, "payload_bytes": int(_fields(head)["content-length"])}
                        block = payload
                    elif kind == "metadata":
                        row["page_id"] = _fields(block).get("page-id")
                    if blocks:
                        row["block"] = block
                        held += len(block)
                    rows.append(row)
                    held += 500
                    if held > READ_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


def read_records(spark: SparkSession, manifest: DataFrame, *kinds: str, blocks: bool = True) -> DataFrame:
    """One row per record of the given kinds; archives are dealt out to tasks by path."""
    files = manifest.select("folder", "path").repartition(max(1, spark.sparkContext.defaultParallelism), "path")
    return files.mapInArrow(lambda it: _read(it, kinds, blocks), RECORD_DDL)


def read_captures(spark: SparkSession, manifest: DataFrame, page_id_type: str = "bigint", payloads: bool = True) -> DataFrame:
    """One nested row per capture: record_id, target_uri, page_id, request, response, metadata.

    A capture without a request or metadata record has null there. `response.refers_to` is the
    page of the capture that a revisit stands for. Without `payloads` the payload is not read."""
    responses = read_records(spark, manifest, "response", "revisit", blocks=payloads)
    requests = read_records(spark, manifest, "request").select(F.col("concurrent_to").alias("record_id"), F.struct(F.col("record_id"), F.col("block").cast("string").alias("head")).alias("request"))
    metadata = read_records(spark, manifest, "metadata", blocks=False).select(F.col("concurrent_to").alias("record_id"), F.col("page_id").cast(page_id_type).alias("page_id"), F.struct("record_id", "page_id").alias("metadata"))
    pages = metadata.select(F.col("record_id").alias("original_id"), F.col("page_id").alias("original_page"))
    found = (
        responses.withColumnRenamed("page_id", "_")
        .join(requests, "record_id", "left")
        .join(metadata, "record_id", "left")
        .join(pages, F.col("refers_to") == F.col("original_id"), "left")
    )
    response = F.struct("record_type", "payload_digest", "payload_bytes", F.col("block").cast("string").alias("payload"), F.col("original_page").alias("refers_to"))
    return found.select("record_id", "target_uri", "page_id", "request", response.alias("response"), "metadata")
