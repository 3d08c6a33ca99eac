"""WARC archives written from a table of pages and read back as a chunked record table.

Writing is a plain Spark text sink into gzip archives: each line is one record (its header, a blank line, its block), and
the line separator completes the record, so any Hadoop file system will do and tasks are retried like those of any other
table. A payload above ``SEGMENT`` bytes is written as a WARC record and its continuation records, one row each.

Reading streams: gzip archives are read in order, one task each, line by line. A state machine turns them into rows
``(record, chunk_no, chunk, ...)`` of at most ``CHUNK`` payload bytes each, carrying the running SHA-1 and length. No
record is ever held whole: a reader's memory is one chunk, one line of an archive and one Arrow batch.

Records with equal payloads of at least ``REVISIT_BYTES`` are written once: the one of the largest id is the response,
the others are revisits that refer to it. Equal payloads are found by a map-side combined aggregation of (digest,
length). The revisits' keys are sent to the tasks that read the payloads while they are measured to be few; beyond that
Spark deals the pages, payloads included, by id once.

An archive is one gzip member, which readers stream; it isn't made for seeking by record. A line of a foreign archive
(a payload without line feeds) is held whole by Spark's reader.

Edge cases: null payloads are empty; repeated rows of one id are all responses if that id is the largest; a null id is
the smallest (its record's id is ``null``, read back as null); control characters in urls are percent-encoded in the header; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, materialise, scratch, sized, trimmed

# Fixed values of the contract and of the format.
REVISIT_BYTES = 1000
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SEGMENT = 1 << 20
CHUNK = 64 << 10
#: Fixed, so that archives are the same in every run.
DATE = "2024-01-01T00:00:00Z"

CHUNKS = T.StructType(
    [
        T.StructField("record_id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("uri", T.StringType()), T.StructField("refers_to", T.StringType()),
        T.StructField("header_digest", T.StringType()), T.StructField("header_bytes", T.LongType()), T.StructField("chunk_no", T.IntegerType()), T.StructField("chunk", T.BinaryType()),
        T.StructField("bytes_so_far", T.LongType()), T.StructField("digest_so_far", T.StringType()), T.StructField("last", T.BooleanType()),
    ]
)


def plan_records(pages: DataFrame, id_col: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """``__id, __url, __payload, __digest, __bytes, record_type, refers_to``: who is a response, who revisits whom."""
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("__id"), F.col(url).alias("__url"), body.alias("__payload"), F.sha1(body).alias("__digest"), F.octet_length(body).cast("long").alias("__bytes"))
    keys = rows.where(F.col("__bytes") >= REVISIT_BYTES).select("__id", "__digest", "__bytes")
    shared = materialise(keys.groupBy("__digest", "__bytes").agg(F.max("__id").alias("__first"), F.count("*").alias("__n")).where("__n > 1").select("__digest", "__bytes", "__first"), "warc-shared")
    # only rows below the largest id need to know
    revisits = materialise(keys.join(sized(shared, 60), ["__digest", "__bytes"]).where(~F.col("__id").eqNullSafe(F.col("__first"))).select("__id", "__digest", "__first").distinct(), "warc-revisits")
    first = revisits.select(F.col("__id").alias("__i"), F.col("__digest").alias("__d"), "__first")
    out = rows.join(sized(first, 60), rows["__id"].eqNullSafe(first["__i"]) & (rows["__digest"] == first["__d"]), "left")
    again = F.col("__d").isNotNull()
    return out.select("__id", "__url", F.when(~again, F.col("__payload")).alias("__payload"), "__digest", "__bytes", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("__first")).alias("refers_to"))


def record_uri(key: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(key.cast("string"), F.lit("null")), F.lit(">"))


def write_archives(records: DataFrame, path: str, segment: int = SEGMENT) -> None:
    """``records`` as of ``plan_records``; one gzip archive per partition."""
    eol = "\r\n"
    uri = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce("__url", F.lit("")), "\r", "%0D"), "\n", "%0A"), "[\\x00-\\x1F]", "%00")
    body = F.coalesce("__payload", F.lit("").cast("binary"))
    size = F.octet_length(body)
    parts = F.greatest(F.lit(1), F.ceil(size / F.lit(segment)).cast("int"))
    # segments are exploded, never the body beside them, so that a payload is copied once whatever its parts
    cut = F.transform(F.sequence(F.lit(1), parts), lambda k: F.struct(k.alias("k"), body.substr((k - 1) * segment + 1, F.lit(segment)).alias("block")))
    kept = records.select("__id", "__digest", "__bytes", "record_type", "refers_to", uri.alias("__uri"), parts.alias("__parts"), F.explode(cut).alias("__s"))
    rows = kept.select("*", F.col("__s.k").alias("__k"), F.col("__s.block").alias("__block"))
    block = F.col("__block")
    first, many = F.col("__k") == 1, F.col("__parts") > 1
    field = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit(eol))
    nothing = F.lit("")
    segment_id = F.when(first, record_uri(F.col("__id"))).otherwise(F.concat(F.lit("<urn:page:"), F.coalesce(F.col("__id").cast("string"), F.lit("null")), F.lit(":"), F.col("__k").cast("string"), F.lit(">")))
    header = F.concat(
        F.lit(VERSION + eol),
        field("WARC-Type", F.when(first, F.col("record_type")).otherwise(F.lit("continuation"))),
        field("WARC-Record-ID", segment_id),
        field("WARC-Date", F.lit(DATE)),
        F.when(first, field("WARC-Target-URI", F.col("__uri"))).otherwise(nothing),
        F.when(first, field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "__digest"))).otherwise(nothing),
        F.when(first, field("X-Payload-Length", F.col("__bytes").cast("string"))).otherwise(nothing),
        F.when(many, field("WARC-Segment-Number", F.col("__k").cast("string"))).otherwise(nothing),
        F.when(~first, field("WARC-Segment-Origin-ID", record_uri(F.col("__id")))).otherwise(nothing),
        F.when(many & (F.col("__k") == F.col("__parts")), field("WARC-Segment-Total-Length", F.col("__bytes").cast("string"))).otherwise(nothing),
        F.when(F.col("record_type") == "revisit", F.concat(field("WARC-Profile", F.lit(PROFILE)), field("WARC-Refers-To", record_uri(F.col("refers_to"))))).otherwise(nothing),
        field("Content-Type", F.lit("text/html")),
        field("Content-Length", F.octet_length(block).cast("string")),
        F.lit(eol),
    )
    line = F.concat(header.cast("binary"), block, F.lit(eol).cast("binary")).cast("string")  # bytes pass as they are
    rows.select(line.alias("value")).write.option("lineSep", eol).option("compression", "gzip").text(path)


class ChunkReader:
    """Lines of archives in, chunk rows out; between lines it holds at most one chunk."""

    def __init__(self, chunk: int = CHUNK):
        self.chunk, self.state, self.head, self.rec = chunk, "start", {}, None
        self.buffer, self.left = bytearray(), 0

    def lines(self, lines):
        for line in lines:
            yield from self.line(line)
        yield from self.close()

    def line(self, line: bytes):
        """``line`` is without its line feed."""
        if self.state == "block":
            data = line + b"\n"
            take = data[: self.left]
            self.left -= len(take)
            yield from self._take(take)
            if not self.left:
                self.state = "start"
            return
        text = line.rstrip(b"\r")
        if self.state == "start":
            if text.startswith(b"WARC/"):
                self.state, self.head = "head", {}
            elif text:
                raise ValueError(f"no WARC record begins with {text[:40]!r}")
            return
        if text:
            name, _, value = text.partition(b":")
            self.head[name.strip().lower()] = value.strip()
            return
        left = int(self.head.get(b"content-length", b"0"))
        if self.head.get(b"warc-type") == b"continuation":
            if self.rec is None or self.rec["uri_id"] != self.head.get(b"warc-segment-origin-id"):
                raise ValueError("a continuation record doesn't follow its origin")
        else:
            yield from self.close()
            h = self.head
            text_of = lambda k: h[k].decode("utf-8", "replace") if k in h else None
            size = h.get(b"x-payload-length")
            self.rec = {"uri_id": h.get(b"warc-record-id"), "no": 0, "bytes": 0, "sha": hashlib.sha1(), "fields": (text_of(b"warc-record-id"), text_of(b"warc-type"), text_of(b"warc-target-uri"), text_of(b"warc-refers-to"), (text_of(b"warc-payload-digest") or "").removeprefix("sha1:") or None, int(size) if size else None)}
        self.left = left
        self.state = "block" if left else "start"

    def _take(self, data: bytes):
        rec = self.rec
        rec["sha"].update(data)
        rec["bytes"] += len(data)
        self.buffer += data
        while len(self.buffer) > self.chunk:
            yield self._row(bytes(self.buffer[: self.chunk]), rec["bytes"] - len(self.buffer) + self.chunk, None, False)
            del self.buffer[: self.chunk]

    def _row(self, chunk: bytes, upto: int, digest: str | None, last: bool):
        rec = self.rec
        rec["no"] += 1
        return (*rec["fields"], rec["no"], chunk, upto, digest, last)

    def close(self):
        """The record's last chunk, with the digest of the whole; an empty record has one empty chunk."""
        if self.rec is not None:
            if self.left:
                raise ValueError("an archive ends within a record")
            yield self._row(bytes(self.buffer), self.rec["bytes"], self.rec["sha"].hexdigest(), True)
            self.buffer.clear()
            self.rec = None


def read_chunks(spark, path: str, payload: bool = True, chunk: int = CHUNK) -> DataFrame:
    """The chunked record table of all archives under ``path``; ``payload`` False leaves out the bytes."""
    bounded_batches(spark)
    # a gzip file is one split, so its lines reach one task in order; the file's path parts archives
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary").alias("value"), F.xxhash64(F.input_file_name()).alias("file"))

    def rows_of(batches):
        reader, file = ChunkReader(chunk), None
        for b in batches:
            for line, at in zip(b.column("value"), b.column("file").to_pylist(), strict=True):
                if at != file:
                    yield from reader.close()
                    reader, file = ChunkReader(chunk), at
                yield from reader.line(line.as_py())
        yield from reader.close()

    def table(batches):
        held, size = [], 0
        schema = pa.schema([(f.name, {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}[f.dataType.simpleString()]) for f in CHUNKS.fields])
        for r in rows_of(batches):
            held.append(r if payload else (*r[:7], None, *r[8:]))
            size += 200 + (len(r[7]) if payload else 0)
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    return lines.mapInArrow(lambda b: trimmed(table(b)), CHUNKS)


def round_trip(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Writes the pages, reads the archives back: ``page_id, payload_bytes, payload_digest, record_type, refers_to, chunks``.

    Everything is as read: a response's length and digest come from its chunks and must equal its header's.
    """
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    write_archives(plan_records(pages, id_col, url, payload), path)
    last = read_chunks(spark, path, payload=False).where("last")
    key = lambda c: F.regexp_extract(c, r"^<urn:page:(.*)>$", 1).try_cast("long")
    own = F.col("type") == "revisit"
    ok = own | ((F.col("digest_so_far") == F.col("header_digest")) & (F.col("bytes_so_far") == F.col("header_bytes")))
    digest = F.when(own, F.col("header_digest")).when(ok, F.col("digest_so_far")).otherwise(F.raise_error(F.lit("a payload differs from its digest")))
    return last.select(key(F.col("record_id")).alias("page_id"), F.when(own, F.col("header_bytes")).otherwise(F.col("bytes_so_far")).alias("payload_bytes"), digest.alias("payload_digest"), F.col("type").alias("record_type"), key(F.col("refers_to")).alias("refers_to"), F.col("chunk_no").alias("chunks"))
