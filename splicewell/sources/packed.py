"""Alignments packed to 16 bytes, with dictionaries of reads and CIGARs beside them.

A folder holds reads (text: id, name, sequence), cigars (text: id, CIGAR) and alignments (binary files). Ids are dense and given
out in parallel. The binary sink is a Python data source: each task writes a file of its own under a name that readers don't
look at, and the commit renames those of the tasks that count, so a task that runs twice leaves no rows twice.

Offsets and scores have 16 bits, regions and reads 32, CIGARs 31; what doesn't fit is an error. Repeated alignments stay.
Reads and CIGARs without alignments don't occur. Names hold no white space.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..functions import cigar as C
from ..operators import evidence as E
from ..operators import tables
from . import files

SCHEMA = "region_id long, read_id long, rc boolean, cigar_id long, offset_start long, score long"
#: Fixed value of the format: 16 bytes, little-endian; the top bit of cigar is the orientation.
RECORD = np.dtype([("region_id", "<u4"), ("read_id", "<u4"), ("cigar", "<u4"), ("offset_start", "<u2"), ("score", "<u2")])
#: Groups in which ids are given out.
BUCKETS = 4096


def _place(path: str):
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Part(WriterCommitMessage):
    name: str | None


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        place, folder = _place(self.path)
        place.create_dir(folder)
        name = f"{uuid.uuid4().hex}.bin"
        rows = 0
        with place.open_output_stream(f"{folder}/.{name}") as out:
            for batch in iterator:
                packed = np.empty(len(batch), dtype=RECORD)
                values = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("region_id", "read_id", "rc", "cigar_id", "offset_start", "score")}
                for c, bits in (("region_id", 32), ("read_id", 32), ("cigar_id", 31), ("offset_start", 16), ("score", 16)):
                    if len(batch) and (values[c].min() < 0 or values[c].max() >> bits):
                        raise ValueError(f"{c} doesn't fit into {bits} bits")
                packed["cigar"] = values["cigar_id"] | values["rc"] << 31
                for c in ("region_id", "read_id", "offset_start", "score"):
                    packed[c] = values[c]
                out.write(packed.tobytes())
                rows += len(batch)
        if not rows:
            place.delete_file(f"{folder}/.{name}")
        return Part(name if rows else None)

    def commit(self, messages: list[Part | None]) -> None:
        place, folder = _place(self.path)
        for m in messages:
            if m and m.name:
                place.move(f"{folder}/.{m.name}", f"{folder}/{m.name}")

    def abort(self, messages: list[Part | None]) -> None:
        place, folder = _place(self.path)
        for m in messages:
            if m and m.name:
                place.delete_file(f"{folder}/.{m.name}")


class Packed(DataSource):
    """Format splicewell_packed, to write only; option path."""

    @classmethod
    def name(cls) -> str:
        return "splicewell_packed"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"])


def _numbered(values: DataFrame, into: str) -> DataFrame:
    """The distinct rows with dense ids from 0 up."""
    names = values.columns
    dealt = values.distinct().withColumn("bucket", F.pmod(F.xxhash64(*names), F.lit(BUCKETS)))
    return tables.written(E.dense_ids(dealt, "bucket", names, into).select(into, *names))


def write(alignments: DataFrame, path: str) -> None:
    """Writes alignments (region_id, qname, seq, rc, cigar, offset_start, score) into the folder."""
    spark = alignments.sparkSession
    spark.dataSource.register(Packed)
    reads, cigars = _numbered(alignments.select("qname", "seq"), "read_id"), _numbered(alignments.select("cigar"), "cigar_id")
    reads.select(F.concat_ws(" ", "read_id", "qname", "seq")).write.text(f"{path}/reads")
    cigars.select(F.concat_ws(" ", "cigar_id", "cigar")).write.text(f"{path}/cigars")
    met = alignments.join(reads, ["qname", "seq"]).join(cigars, "cigar")
    packed = met.select(*[F.col(c).cast("boolean" if c == "rc" else "long").alias(c) for c in ("region_id", "read_id", "rc", "cigar_id", "offset_start", "score")])
    packed.write.format("splicewell_packed").option("path", f"{path}/alignments").mode("append").save()


def read(spark: SparkSession, path: str) -> DataFrame:
    """What write() was given, with read_id and the end on the region that the CIGAR tells."""
    part = lambda i: F.split("value", " ")[i]
    reads = spark.read.text(f"{path}/reads").select(part(0).cast("long").alias("read_id"), part(1).alias("qname"), part(2).alias("seq"))
    cigars = spark.read.text(f"{path}/cigars").select(part(0).cast("long").alias("cigar_id"), part(1).alias("cigar"))
    length = C.reference_length(C.parse(F.col("cigar")))
    met = files.packed_alignments(spark, f"{path}/alignments").join(reads, "read_id").join(cigars, "cigar_id")
    return met.select("region_id", "read_id", "qname", "seq", "rc", "cigar", "offset_start", (F.col("offset_start") + length).cast("long").alias("offset_end"), "score")
