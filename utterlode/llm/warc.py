"""WARC records as a chunked record table.

An archive is a table of rows ``(record_id, copy, chunk_no, data, digest_so_far)``: the chunks of a record in order are its
bytes in WARC/1.1, headers and payload. Payloads are cut by the scan, ``CHUNK`` bytes a row, before they reach a Python
worker or a shuffle, so neither writing nor reading holds a record there. Each row carries the SHA-1 of the payload so far,
taken incrementally, so a reader finds a damaged or missing chunk at its place.

Of records with equal payloads of at least ``min_bytes`` bytes, the one with the largest page id is the ``response`` and
the others are ``revisit`` records without payload that refer to it by its record id, target and date. Payloads meet by
their SHA-1 and size, with one pre-aggregated row for each digest that several records have. Up to ``FEW`` of these are
broadcast, and records are written from the scan; beyond, chunks meet them by digest, hot digests still by broadcast.

Record ids are UUIDs made from page id, url and payload digest, so they are known before anything is written. Reading
follows the references: what a revisit refers to is looked up among the responses.

Edge cases: a null payload is empty; a null url leaves the header out, control characters in one are percent-encoded; a
row with a null page id is a response that nothing refers to; rows with one page id and equal payloads are all responses;
rows that are equal throughout have one record id, and ``copy`` tells them apart; other columns are not archived.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.spread import spread_join
from ..plans.durable import saved
from . import wordstream as ws

CHUNK = 1 << 20
#: Digests of several records that are broadcast, at most (some 150 bytes each).
FEW = 100_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_TABLE = pa.schema([("record_id", pa.string()), ("copy", pa.int64()), ("chunk_no", pa.int32()), ("data", pa.binary()), ("digest_so_far", pa.string())])
_TABLE_TYPE = "record_id string, copy long, chunk_no int, data binary, digest_so_far string"
_READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers", pa.string()), ("url", pa.string())])


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(*parts: Column) -> Column:
    """A UUID from the parts' values; null is a value of its own."""
    named = F.md5(F.to_json(F.struct(*[p.cast("string").alias(f"p{i}") for i, p in enumerate(parts)])))
    piece = lambda start, n: F.substring(named, start, n)
    return F.concat(piece(1, 8), F.lit("-"), piece(9, 4), F.lit("-3"), piece(14, 3), F.lit("-8"), piece(18, 3), F.lit("-"), piece(21, 12))


def _uri(url: str) -> str:
    return quote(url, safe=":/?#[]@!$&()*+,;=%~-._" + chr(39))


def _heads(row: dict, date: str) -> bytes:
    """The WARC header, and the head of the HTTP message that is the record's block."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['size']}\r\n\r\n".encode()
    revisit = row["keeper"] is not None
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{row['record_id']}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{_base32(bytes.fromhex(row['digest']))}", "Content-Type: application/http;msgtype=response"]
    if row["page_id"] is not None:
        lines.append(f"Page-ID: {row['page_id']}")
    if row["url"] is not None:
        lines.append(f"WARC-Target-URI: {_uri(row['url'])}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{row['keeper']}>", f"WARC-Refers-To-Date: {date}"]
        if row["keeper_url"] is not None:
            lines.append(f"WARC-Refers-To-Target-URI: {_uri(row['keeper_url'])}")
    lines.append(f"Content-Length: {len(http) + (0 if revisit else row['size'])}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def _write(date: str):
    """Chunks of payloads, those of a record in order, become chunks of records."""
    told = ("record_id", "copy", "chunk_no", "last", "page_id", "url", "size", "digest", "keeper", "keeper_url")

    def table(held: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _TABLE, strict=True)], schema=_TABLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, sha, due = [], 0, hashlib.sha1(), (None, None, 0)
        for batch in batches:
            for row, data in zip(batch.select(told).to_pylist(), batch.column("data"), strict=True):
                key, number = (row["record_id"], row["copy"]), row["chunk_no"]
                if number == 0:
                    sha = hashlib.sha1()
                elif (*key, number) != due:
                    raise ValueError(f"chunk {number} of {key} follows {due}")
                due = (*key, number + 1)
                payload = data.as_buffer()
                sha.update(payload)
                whole = (_heads(row, date) if number == 0 else b"") + payload.to_pybytes() + (b"\r\n\r\n" if row["last"] else b"")
                held.append((*key, number, whole, sha.hexdigest() if row["keeper"] is None else ""))
                size += len(whole)
                if size >= 4 * CHUNK or len(held) >= 4096:
                    yield table(held)
                    held, size = [], 0
        if held:
            yield table(held)

    return run


class RecordReader:
    """Takes a record's chunks one by one; holds its headers and running digest, never its payload."""

    def __init__(self) -> None:
        self.head, self.fields, self.left, self.http, self.size, self.sha, self.number = b"", None, 0, b"", 0, hashlib.sha1(), 0

    def feed(self, data: bytes, number: int, so_far: str) -> None:
        if number != self.number:
            raise ValueError(f"chunk {number} of a record where {self.number} was due")
        self.number += 1
        view = memoryview(data)
        if self.fields is None:
            self.head += data
            end = self.head.find(b"\r\n\r\n")
            if end < 0:
                return
            lines = self.head[:end].decode().split("\r\n")
            self.fields = dict(x.split(": ", 1) for x in lines[1:])
            self.left = int(self.fields["Content-Length"])
            view, self.head = memoryview(self.head)[end + 4 :], b""
        view = view[: self.left]
        self.left -= len(view)
        if self.http is not None:
            self.http += bytes(view[:4096])
            end = self.http.find(b"\r\n\r\n")
            if end < 0:
                return
            self.declared = int(dict(x.split(": ", 1) for x in self.http[:end].decode().split("\r\n")[1:])["Content-Length"])
            view, self.http = view[end + 4 :], None
        self.size += len(view)
        self.sha.update(view)
        if so_far and so_far != self.sha.hexdigest():
            raise ValueError(f"chunk {number} of {self.fields['WARC-Record-ID']} does not match its digest")

    def row(self) -> tuple:
        if self.fields is None or self.left or self.http is not None:
            raise ValueError("a record ends before its length")
        bare = lambda name: self.fields[name].removeprefix("<urn:uuid:").removesuffix(">") if name in self.fields else None
        kind, digest = self.fields["WARC-Type"], self.fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if kind == "response" and (digest != _base32(self.sha.digest()) or self.size != self.declared):
            raise ValueError(f"{self.fields['WARC-Record-ID']} does not match its payload digest")
        page = self.fields.get("Page-ID")
        return None if page is None else int(page), self.declared, digest, kind, bare("WARC-Record-ID"), bare("WARC-Refers-To"), self.fields.get("WARC-Target-URI")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, reader, out = None, None, []

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _READ, strict=True)], schema=_READ)

    for batch in batches:
        for record, copy, number, data, so_far in zip(batch.column("record_id").to_pylist(), batch.column("copy").to_pylist(), batch.column("chunk_no").to_pylist(), batch.column("data"), batch.column("digest_so_far").to_pylist(), strict=True):
            if (record, copy) != now:
                if reader:
                    out.append(reader.row())
                now, reader = (record, copy), RecordReader()
            reader.feed(data.as_buffer().to_pybytes(), number, so_far)
        if out:
            yield flush()
            out.clear()
    if reader:
        out.append(reader.row())
        yield flush()


def write_records(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, chunk: int = CHUNK, date: str = "1970-01-01T00:00:00Z", few: int = FEW) -> None:
    """Write ``pages`` as an archive table at ``path`` (any folder that Spark writes to)."""
    spark = pages.sparkSession
    ws.tune(spark)
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("size"))
    rows = rows.withColumn("record_id", record_id(F.col("page_id"), F.col("url"), F.col("digest")))
    keepers = (
        rows.where(F.col("page_id").isNotNull() & (F.col("size") >= min_bytes)).groupBy("digest")
        .agg(F.max(F.struct("page_id", "url", "record_id")).alias("_last"), F.count("*").alias("_n")).where("_n > 1")
    )
    keepers = saved(keepers, "keepers")
    how_many = keepers.agg(F.count("*").alias("digests"), F.sum("_n").alias("records")).first()

    def chunked(rows: DataFrame) -> DataFrame:
        """A row for each chunk of a payload; the scan holds the payload, what follows a chunk."""
        last = F.greatest(F.ceil(F.col("size") / chunk).cast("int") - 1, F.lit(0))
        cut = rows.withColumn("copy", F.monotonically_increasing_id()).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), last)))
        return cut.withColumn("data", F.substring("payload", F.col("chunk_no") * chunk + 1, F.lit(chunk))).withColumn("last", F.col("chunk_no") == last).drop("payload")

    def referring(rows: DataFrame) -> DataFrame:
        revisit = F.col("page_id") != F.col("_last.page_id")
        return rows.withColumn("keeper", F.when(revisit, F.col("_last.record_id"))).withColumn("keeper_url", F.when(revisit, F.col("_last.url"))).drop("_last", "_n")

    if how_many["digests"] <= few:
        typed = referring(rows.join(F.broadcast(keepers), "digest", "left"))
        spared = typed.withColumn("payload", F.when(F.col("keeper").isNull(), F.col("payload")).otherwise(F.lit(b"")))
        size = F.when(F.col("keeper").isNull(), F.col("size")).otherwise(F.lit(0).cast("long"))
        ready = chunked(spared.withColumn("_size", F.col("size")).withColumn("size", size)).withColumn("size", F.col("_size")).drop("_size")
    else:
        typed = referring(spread_join(chunked(rows), keepers, "digest", "_n", how_many["records"], ws.shuffle_width(spark)))
        spared = typed.where("keeper is null or chunk_no = 0")
        spared = spared.withColumn("last", F.col("last") | F.col("keeper").isNotNull()).withColumn("data", F.when(F.col("keeper").isNull(), F.col("data")).otherwise(F.lit(b"")))
        ready = spared.repartition(ws.shuffle_width(spark), "record_id").sortWithinPartitions("record_id", "copy", "chunk_no")
    ready.select("record_id", "copy", "chunk_no", "last", "page_id", "url", "size", "digest", "keeper", "keeper_url", "data").mapInArrow(_write(date), _TABLE_TYPE).write.parquet(path)


def read_records(archive: DataFrame) -> DataFrame:
    """One row per record of an archive table, every digest checked and every reference followed: page id, payload size and
    digest, type, the page id of the response referred to, url."""
    spark = archive.sparkSession
    ws.tune(spark)
    ordered = archive.repartition(ws.shuffle_width(spark), "record_id").sortWithinPartitions("record_id", "copy", "chunk_no")
    found = saved(ordered.mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, record_id string, refers string, url string"), "records")
    sizes = found.where("refers is not null").groupBy("refers").agg(F.count("*").alias("_n"))
    named = found.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers")).agg(F.max("page_id").alias("refers_to"))
    kept = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
    referred = saved(sizes.join(named, "refers", "left"), "referred")
    revisits = found.where("refers is not null")
    followed = spread_join(revisits, referred, "refers", "_n", revisits.count(), ws.shuffle_width(spark))
    return found.where("refers is null").withColumn("refers_to", F.lit(None).cast("long")).select(*kept).unionByName(followed.select(*kept))
