"""Aligned reads from BAM files, by contig.

A Python data source. With an index beside the file (.bai) it plans partitions from the index: the stretches of the file that
hold the wanted contigs, in parts of at most a few blocks' worth of bytes. A filter on contig is taken down to that plan
where the session allows filters for Python sources (spark.sql.python.filterPushdown.enabled); contigs may also be named.
Without an index the file is one partition. Rows are those of the SAM text source; reads without coordinates are not
visited by an index, as they have no contig.

Files are opened by pyarrow's file systems, so they have to lie where executors reach them by such a path or address.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = "qname string, flag int, contig string, pos int, cigar array<struct<len:int,op:string>>, mate_contig string, mate_pos int, isize int, seq string, qual array<int>, tags map<string,string>"
KINDS = pa.schema(
    [
        ("qname", pa.string()), ("flag", pa.int32()), ("contig", pa.string()), ("pos", pa.int32()), ("cigar", pa.list_(pa.struct([("len", pa.int32()), ("op", pa.string())]))),
        ("mate_contig", pa.string()), ("mate_pos", pa.int32()), ("isize", pa.int32()), ("seq", pa.string()), ("qual", pa.list_(pa.int32())), ("tags", pa.map_(pa.string(), pa.string())),
    ]
)
#: Compressed bytes of a partition, and rows of a batch.
PART, ROWS = 32 << 20, 2000

# Fixed values of the format: symbols by number, and the layout of a tag's value by its letter.
OPS, BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
DUPLICATE = 1024


class Blocks:
    """Bytes of a blocked gzip file from a virtual offset on: the block's place in the file, and the place within it."""

    def __init__(self, file, at: int = 0):
        self.file, self.start, self.next, self.data, self.at = file, at >> 16, at >> 16, b"", 0
        self._fill()
        self.at = at & 0xFFFF

    def _fill(self) -> bool:
        self.start = self.next
        self.file.seek(self.start)
        head = self.file.read(12)
        if len(head) < 12:
            self.data, self.at = b"", 0
            return False
        extra = self.file.read(struct.unpack("<H", head[10:12])[0])
        size, i = 0, 0
        while i < len(extra):
            a, b, n = struct.unpack("<BBH", extra[i : i + 4])
            if (a, b) == (66, 67):
                size = struct.unpack("<H", extra[i + 4 : i + 6])[0] + 1
            i += 4 + n
        if not size:
            raise ValueError("not a blocked gzip file")
        self.data, self.at = zlib.decompress(self.file.read(size - 12 - len(extra)), -15), 0
        self.next = self.start + size
        return True

    def tell(self) -> int:
        return self.start << 16 | self.at

    def read(self, n: int) -> bytes:
        """n bytes; fewer at the end."""
        out = b""
        while len(out) < n:
            if self.at == len(self.data) and not self._fill():
                break
            part = self.data[self.at : self.at + n - len(out)]
            self.at += len(part)
            out += part
        while self.at == len(self.data) and self._fill() and not self.data:  # so that tell() names the next byte's block
            pass
        return out


def opened(path: str):
    place, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return place.open_input_file(name)


def contigs_of(blocks: Blocks) -> list[str]:
    """Names of the contigs, by number; leaves the blocks at the first record."""
    if blocks.read(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    number = lambda: struct.unpack("<i", blocks.read(4))[0]
    blocks.read(number())
    names = []
    for _ in range(number()):
        names.append(blocks.read(number())[:-1].decode())
        blocks.read(4)
    return names


def stretches(index: bytes) -> list[list[tuple[int, int]]]:
    """For each contig the virtual offsets, from and to, between which its records lie; ordered and apart."""
    at, out = 8, []
    for _ in range(struct.unpack_from("<i", index, 4)[0]):
        found = []
        bins = struct.unpack_from("<i", index, at)[0]
        at += 4
        for _ in range(bins):
            name, chunks = struct.unpack_from("<Ii", index, at)
            at += 8
            for _ in range(chunks):
                if name != 37450:  # that one holds counts
                    found.append(struct.unpack_from("<QQ", index, at))
                at += 16
        at += 4 + 8 * struct.unpack_from("<i", index, at)[0]
        merged: list[tuple[int, int]] = []
        for a, b in sorted(found):
            if merged and a < merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        out.append(merged)
    return out


def _tags(data: bytes) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(data):
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            end = data.index(b"\0", at)
            value, at = data[at:end].decode(), end + 1
        elif kind == "A":
            value, at = chr(data[at]), at + 1
        elif kind == "B":
            of, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            form = f"<{n}{NUMBERS[of]}"
            value, at = ",".join([of, *(f"{x:g}" if of == "f" else str(x) for x in struct.unpack_from(form, data, at + 5))]), at + 5 + struct.calcsize(form)
        else:
            x = struct.unpack_from("<" + NUMBERS[kind], data, at)[0]
            value, at = f"{x:g}" if kind == "f" else str(x), at + struct.calcsize(NUMBERS[kind])
        out.append((name, value))
    return out


def record(data: bytes, names: list[str]) -> tuple:
    """One record as a row of SCHEMA."""
    contig, pos, name_size, _, _, ops, flag, size, mate, mate_pos, isize = struct.unpack_from("<iiBBHHHiiii", data)
    at = 32 + name_size
    qname = data[32 : at - 1].decode()
    cigar = [{"len": x >> 4, "op": OPS[x & 15]} for x in struct.unpack_from(f"<{ops}I", data, at)]
    at += 4 * ops
    packed = data[at : at + (size + 1) // 2]
    at += len(packed)
    seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:size]
    qual = None if data[at : at + 1] == b"\xff" or not size else list(data[at : at + size])
    of = lambda i: names[i] if i >= 0 else "*"
    return qname, flag, of(contig), pos, cigar, of(mate), mate_pos, isize, seq, qual, _tags(data[at + size :])


class Stretch(InputPartition):
    def __init__(self, first: int, last: int | None, contig: str | None):
        super().__init__((first, last, contig))


class Reader(DataSourceReader):
    def __init__(self, path: str, wanted: list[str] | None, duplicates: bool):
        self.path, self.wanted, self.duplicates = path, wanted, duplicates

    def partitions(self) -> list[InputPartition]:
        with opened(self.path) as file:
            blocks = Blocks(file)
            names, first = contigs_of(blocks), blocks.tell()
        try:
            with opened(self.path + ".bai") as file:
                found = stretches(file.read())
        except FileNotFoundError:
            return [Stretch(first, None, None)]
        out: list[InputPartition] = []
        for name, parts in zip(names, found, strict=True):
            if self.wanted is not None and name not in self.wanted:
                continue
            begun = None
            for a, b in parts:
                if begun and (b >> 16) - (begun[0] >> 16) <= PART:
                    begun = (begun[0], b)
                    continue
                out += [Stretch(*begun, name)] if begun else []
                begun = (a, b)
            out += [Stretch(*begun, name)] if begun else []
        return out or [Stretch(0, 0, None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        first, last, contig = partition.value
        if last == 0:
            return
        with opened(self.path) as file:
            names = contigs_of(Blocks(file))
            blocks, rows = Blocks(file, first), []
            while (last is None or blocks.tell() < last) and len(size := blocks.read(4)) == 4:
                row = record(blocks.read(struct.unpack("<i", size)[0]), names)
                if (row[2] == contig if contig else self.wanted is None or row[2] in self.wanted) and (self.duplicates or not row[1] & DUPLICATE):
                    rows.append(row)
                if len(rows) == ROWS:
                    yield self._batch(rows)
                    rows = []
            if rows:
                yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)], schema=KINDS)


class PushingReader(Reader):
    """Takes filters on contig down; for sessions that allow it, as Spark refuses such readers in others."""

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("contig",):
                names = [f.value] if isinstance(f, EqualTo) else list(f.value)
                self.wanted = [n for n in names if self.wanted is None or n in self.wanted]
            else:
                yield f


class Bam(DataSource):
    """Format splicewell_bam; options path, contigs (comma-joined), duplicates (true keeps reads marked as such), pushdown (as the session has it)."""

    @classmethod
    def name(cls) -> str:
        return "splicewell_bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        named = self.options.get("contigs")
        kind = PushingReader if self.options.get("pushdown") == "true" else Reader
        return kind(self.options["path"], named.split(",") if named else None, self.options.get("duplicates", "true") == "true")


def bam(spark: SparkSession, path: str, contigs: list[str] | None = None, duplicates: bool = True) -> DataFrame:
    """Reads of a BAM file, all or those on some contigs; without duplicates those marked so are left out."""
    spark.dataSource.register(Bam)
    source = spark.read.format("splicewell_bam").option("path", path).option("duplicates", str(duplicates).lower())
    source = source.option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    return (source.option("contigs", ",".join(contigs)) if contigs else source).load()
