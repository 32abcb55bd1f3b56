"""WARC archives of pages: records written and read back as tables of numbered chunks.

A payload travels as rows (record, chunk number, bytes of at most a chunk), so no step but the source row itself holds
a record whole. SHA-1 states are carried from one chunk to the next inside the task that reads them in order.

Writing takes two passes. The first digests all payloads. Of records with equal payloads the one with the smallest
key is a response, the others revisit it; this is decided on thin rows (key, digest, length). The second pass meets
the pages with these decisions and writes header rows, chunk rows and end rows as text. Responses use HTTP's chunked
transfer coding, one HTTP chunk for each row, so each row ends with a line break, as the text writer wants it. A file is
one gzip stream, which Spark never splits, so reading goes through each file once, line by line; a line is at most a
chunk long, also where a payload has no line breaks.

Defined results: a null payload is empty. Keys are whole numbers; a null key comes last in the order, so it is a
response only if all keys of that payload are null. Records that tie for the smallest key (repeated rows) are all
responses. Null targets leave out the field; line breaks in targets are percent-encoded. Extra columns are ignored,
whatever their names. An empty table gives an archive without records.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bytes of a chunk.
CHUNK = 1 << 18
LEAST = 0

# Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def chunked(df: DataFrame, payload: str, size: int = CHUNK) -> DataFrame:
    """Rows (the other columns, chunk, last, data) in order within each record; an empty payload is one empty chunk."""
    keys = [c for c in df.columns if c != payload]
    whole = df.select(*keys, F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("__whole"))
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("__whole") / size)).cast("int")
    at = whole.withColumn("__count", count).select("*", F.explode(F.sequence(F.lit(0), F.col("__count") - 1)).alias("chunk"))
    data = F.substring(F.col("__whole"), F.col("chunk") * size + 1, F.lit(size))
    return at.select(*keys, "chunk", (F.col("chunk") == F.col("__count") - 1).alias("last"), data.alias("data"))


def digests(chunks: DataFrame) -> DataFrame:
    """(the other columns, payload_bytes, payload_digest) of each record of chunks that lie in order within partitions."""
    common.small_batches(chunks.sparkSession)
    keys = [c for c in chunks.columns if c not in ("chunk", "last", "data")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, count = hashlib.sha1(), 0
        for batch in batches:
            found: list[tuple[int, str]] = []
            for chunk, last, data in zip(*(common.values(batch.column(c)) for c in ("chunk", "last", "data")), strict=True):
                if chunk == 0:
                    state, count = hashlib.sha1(), 0
                state.update(data)
                count += len(data)
                if last:
                    found.append((count, base32(state.digest())))
            kept = batch.filter(batch.column("last"))
            made = [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in keys), *made], [*keys, "payload_bytes", "payload_digest"])

    kinds = {f.name: f.dataType.simpleString() for f in chunks.schema}
    return chunks.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), "payload_bytes long, payload_digest string"]))


def decide(records: DataFrame, key: str, target: str, least: int = LEAST) -> DataFrame:
    """Adds record_type, refers_to and refers_to_target; records: a written table with payload_bytes and payload_digest."""
    first = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("refers_to"), F.col(target).alias("refers_to_target"))
    payload = ["payload_digest", "payload_bytes"]
    groups = records.where(F.col("payload_bytes") >= least).groupBy(*payload).agg(F.min(first).alias("first"), F.count("*").alias("copies"))
    found = common.Written(groups.where("copies > 1").select(*payload, F.struct("first.refers_to", "first.refers_to_target").alias("first"), "copies"))
    met = common.meet(records, found.df, payload, "copies", records.count(), "left")
    again = F.col("first").isNotNull() & ~F.col(key).eqNullSafe(F.col("first.refers_to"))
    kind = F.when(again, "revisit").otherwise("response").alias("record_type")
    return met.select(*records.columns, kind, *[F.when(again, F.col(f"first.{c}")).alias(c) for c in ("refers_to", "refers_to_target")])


def _uri(target: Column) -> Column:
    return F.replace(F.replace(target, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _record_id(key: Column, target: Column, digest: Column) -> Column:
    """A name-based identifier: the same for a page and for what refers to it."""
    name = F.md5(F.concat_ws("\n", F.coalesce(key.cast("string"), F.lit("-")), F.coalesce(target, F.lit("-")), digest).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(name, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _field(name: str, value: Column | str) -> Column:
    """A header line; nothing where the value is null."""
    value = F.lit(value) if isinstance(value, str) else value
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(END)), F.lit(""))


def write(pages: DataFrame, path: str, key: str = "page_id", target: str = "url", payload: str = "html", least: int = LEAST, size: int = CHUNK, date: str = "2000-01-01T00:00:00Z") -> None:
    """Writes an archive of gzip files at the path, one record for each page.

    Pages meet the decisions on what tells their rows apart: key, target, length and a 64-bit print of the payload.
    Rows are shuffled once, and not sorted.
    """
    same = ["page", "target", "print", "length"]
    thin = pages.select(
        F.col(key).cast("long").alias("page"), F.col(target).cast("string").alias("target"),
        F.xxhash64(F.coalesce(F.col(payload), F.lit(""))).alias("print"), F.octet_length(F.coalesce(F.col(payload), F.lit(""))).alias("length"), F.col(payload).alias("payload"),
    )
    records = common.Written(digests(chunked(thin, "payload", size)))
    decided = decide(records.df, "page", "target", least).dropDuplicates(same)
    told = decided.select(*[F.col(c).alias(f"d_{c}") for c in same], *[c for c in decided.columns if c not in same])
    match = [thin[c].eqNullSafe(told[f"d_{c}"]) for c in same]
    met = thin.join(told.hint("shuffle_hash"), match).drop(*[f"d_{c}" for c in same])

    response = F.col("record_type") == "response"
    whole, step = F.coalesce(F.col("payload").cast("binary"), F.lit(b"")), F.lit(size)
    met = met.withColumn("whole", whole).drop("payload").withColumn("count", F.when(response, F.ceil(F.col("length") / size)).otherwise(0).cast("int"))
    held = lambda n: F.least(step, F.col("length") - n * size)
    framed = lambda n: F.length(F.lower(F.hex(n))) + 4 + n
    rest = F.when(F.col("count") > 0, framed(held(F.col("count") - 1)) + (F.col("count") - 1) * framed(step)).otherwise(0)
    http = F.when(response, HTTP + "Transfer-Encoding: chunked" + END + END).otherwise(F.concat(F.lit(HTTP), _field("Content-Length", F.col("length")), F.lit(END)))
    head = F.concat(
        F.lit(VERSION + END), _field("WARC-Type", F.col("record_type")), _field("WARC-Record-ID", _record_id(F.col("page"), F.col("target"), F.col("payload_digest"))), _field("WARC-Date", date),
        _field("WARC-Target-URI", _uri(F.col("target"))), _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(response, "").otherwise(
            F.concat(
                _field("WARC-Profile", PROFILE), _field("WARC-Refers-To", _record_id(F.col("refers_to"), F.col("refers_to_target"), F.col("payload_digest"))),
                _field("WARC-Refers-To-Target-URI", _uri(F.col("refers_to_target"))), _field("X-Refers-To-Page", F.col("refers_to")),
            )
        ),
        _field("X-Page", F.col("page")), _field("Content-Type", "application/http;msgtype=response"),
        _field("Content-Length", F.length(http) + rest + F.when(response, 5).otherwise(0)), F.lit(END), http,
    )
    part = F.col("part")
    data = F.substring(F.col("whole"), (part - 1) * size + 1, step)
    lines = (
        F.when(part == 0, F.substring(head, F.lit(1), F.length(head) - 1))
        .when(part <= F.col("count"), F.concat(F.lower(F.hex(F.octet_length(data))), F.lit(END), data.cast("string"), F.lit("\r")))
        .otherwise(F.concat(F.when(response, "0" + END + END).otherwise(""), F.lit(END + "\r")))
    )
    rows = met.select("*", F.explode(F.sequence(F.lit(0), F.col("count") + 1)).alias("part")).select(lines.alias("value"))
    rows.write.option("lineSep", "\n").option("compression", "gzip").text(path)
    records.drop()


class Parser:
    """Takes the lines of one file and gives rows of chunks: (fields, chunk, last, data, bytes so far, digest so far)."""

    def __init__(self) -> None:
        self.step, self.fields, self.http = "version", {}, {}
        self.left = self.chunk = self.bytes = 0
        self.pieces: list[bytes] = []
        self.state = hashlib.sha1()

    def take(self, line: bytes) -> Iterator[tuple[dict, int, bool, bytes | None, int, str]]:
        if self.step == "data":
            if len(line) > self.left:
                raise ValueError("a chunk is longer than it says")
            full = len(line) == self.left
            self.pieces.append(line if full else line + b"\r\n")
            self.left -= len(self.pieces[-1])
            if full:
                self.step = "size"
        elif self.step == "version":
            if line:
                if line.decode() != VERSION:
                    raise ValueError(f"no record begins with {line[:40]!r}")
                self.step, self.fields, self.http, self.chunk, self.bytes, self.state = "fields", {}, {}, 0, 0, hashlib.sha1()
        elif self.step in ("fields", "http"):
            if line:
                name, found, value = line.decode().partition(": ")
                if found:
                    (self.fields if self.step == "fields" else self.http)[name] = value
            elif self.step == "fields":
                self.step = "http"
            elif self.fields["WARC-Type"] == "revisit":
                yield self.fields, 0, True, None, int(self.http["Content-Length"]), self.fields["WARC-Payload-Digest"].removeprefix("sha1:")
                self.step = "version"
            else:
                self.step = "size"
        elif self.step == "size":
            before = b"".join(self.pieces)  # the chunk before is known to be the last one only now
            self.pieces = []
            self.left = int(line, 16)
            self.state.update(before)
            self.bytes += len(before)
            if self.bytes or not self.left:
                yield self.fields, self.chunk, not self.left, before, self.bytes, base32(self.state.digest())
                self.chunk += 1
            self.step = "data" if self.left else "version"


SCHEMA = "page_id long, url string, record_id string, record_type string, refers_to long, declared_digest string, chunk int, last boolean, data binary, payload_bytes long, payload_digest string"


def read(spark: SparkSession, path: str, data: bool = True) -> DataFrame:
    """Chunks of the archive's records, in order; bytes and digest are those up to the chunk's end. A revisit is one row without data."""
    common.small_batches(spark)
    lines = spark.read.option("lineSep", END).text(path).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"))
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.binary(), pa.int64(), pa.string()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, parser, rows = None, Parser(), []
        number = lambda x: None if x is None else int(x)
        for batch in batches:
            for part in common.slices(batch):
                for line, name in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if name != file:
                        file, parser = name, Parser()
                    for f, chunk, last, piece, size, digest in parser.take(line):
                        of = f.get
                        rows.append((number(of("X-Page")), of("WARC-Target-URI"), of("WARC-Record-ID"), of("WARC-Type"), number(of("X-Refers-To-Page")), f["WARC-Payload-Digest"].removeprefix("sha1:"), chunk, last, piece if data else None, size, digest))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows = []

    return lines.mapInArrow(run, SCHEMA)


def records(chunks: DataFrame) -> DataFrame:
    """The records of read(): the last chunk of each knows bytes and digest of the whole; intact tells whether the digest is the declared one."""
    return chunks.where("last").withColumn("intact", F.col("payload_digest") == F.col("declared_digest")).drop("chunk", "last", "data")


def op12_warc(spark, sf_dir: str) -> DataFrame:
    path = common.place(spark)
    write(common.table(spark, sf_dir, "pages"), path)
    return records(read(spark, path, data=False)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
OP12_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, sha1(payload) AS hex FROM p),
b AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda k: substr('{_ALPHABET}',
    1 + CAST((CAST('0x' || substr(hex, 1 + 5 * CAST(k // 4 AS INT), 5) AS BIGINT) >> (15 - 5 * CAST(k % 4 AS INT))) & 31 AS INT), 1)), '') AS payload_digest FROM d),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to FROM m
"""
