"""Readers and writers of sequence files, intervals, settings and calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cigar as C

_LOCAL = (1 << 33) - 1


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq): the name ends at the first white space; lines of a sequence are joined."""
    records = spark.read.text(path, lineSep=">").where(F.length(F.trim("value")) > 0)
    lines = F.split("value", "\r?\n")
    return records.select(F.split(lines[0], r"\s")[0].alias("name"), F.array_join(F.slice(lines, 2, F.size(lines)), "").alias("seq"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): lines numbered from 0; partitions are counted, and each adds the counts of those before it."""
    rows = spark.read.text(path).withColumn("id", F.monotonically_increasing_id())
    rows = rows.withColumn("part", F.shiftright("id", 33)).withColumn("local", F.col("id").bitwiseAND(_LOCAL))
    counts = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one row for each partition
    before, at = [], 0
    for part in sorted(counts):
        before += [F.lit(part), F.lit(at)]
        at += counts[part]
    first = F.element_at(F.create_map(*before), F.col("part")) if before else F.lit(0)
    return rows.select((first + F.col("local")).cast("long").alias("line"), "value")


def fastq(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, qname, seq, qual) of a FASTQ file, also gzipped; a mate suffix /1 or /2 is dropped."""
    lines = numbered_lines(spark, path).withColumn("ordinal", F.floor(F.col("line") / 4)).withColumn("field", F.col("line") % 4)
    field = lambda i: F.max(F.when(F.col("field") == i, F.col("value")))
    records = lines.groupBy("ordinal").agg(field(0).alias("head"), field(1).alias("seq"), field(3).alias("qual"))
    name = F.regexp_replace(F.split(F.substring("head", 2, 1 << 20), r"\s")[0], "/[12]$", "")
    return records.select("ordinal", name.alias("qname"), "seq", "qual")


def fastq_pairs(spark: SparkSession, path1: str, path2: str) -> DataFrame:
    """(ordinal, qname, seq1, qual1, seq2, qual2): records of both files in step."""
    one, two = (fastq(spark, p) for p in (path1, path2))
    a = one.select("ordinal", "qname", F.col("seq").alias("seq1"), F.col("qual").alias("qual1"))
    return a.join(two.select("ordinal", F.col("seq").alias("seq2"), F.col("qual").alias("qual2")), "ordinal")


def bed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="contig string, start int, end int")


def sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignment records of SAM text, positions from 0; tags as a map."""
    part = F.split("value", "\t")
    tags = F.transform(F.slice(part, F.lit(12), F.greatest(F.size(part) - 11, F.lit(0))), lambda t: F.struct(F.substring(t, 1, 2).alias("k"), F.substring(t, F.lit(6), F.length(t)).alias("v")))
    quals = F.transform(F.filter(F.split(part[10], ""), lambda c: c != ""), lambda c: (F.ascii(c) - 33).cast("tinyint"))
    return (
        spark.read.text(path)
        .where(~F.col("value").startswith("@"))
        .select(
            part[0].alias("qname"), part[1].cast("int").alias("flag"), part[2].alias("contig"), (part[3].cast("int") - 1).alias("pos"), C.parse(part[5]).alias("cigar"),
            F.when(part[6] == "=", part[2]).otherwise(part[6]).alias("mate_contig"), (part[7].cast("int") - 1).alias("mate_pos"), part[8].cast("int").alias("isize"),
            part[9].alias("seq"), quals.alias("qual"), F.map_from_entries(tags).alias("tags"),
        )
    )


def settings(spark: SparkSession, path: str) -> dict[str, str]:
    """Key-value text, a small file."""
    return {r["k"]: r["v"] for r in spark.read.text(path).where("value <> ''").select(F.split("value", r"\s+", 2)[0].alias("k"), F.split("value", r"\s+", 2)[1].alias("v")).collect()}


def packed_alignments(spark: SparkSession, path: str) -> DataFrame:
    """Records of 16 bytes: region and read number, orientation with CIGAR number, offset and score; little-endian."""
    rows = spark.read.format("binaryFile").load(path).select(F.explode(F.sequence(F.lit(0), F.floor(F.length("content") / 16) - 1)).alias("n"), "content")
    byte = lambda at: F.conv(F.hex(F.substring("content", (F.col("n") * 16 + at + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    word = lambda at, size: sum((byte(at + k) * 256**k for k in range(1, size)), byte(at))
    packed = rows.where("length(content) >= 16").select(word(0, 4).alias("region_id"), word(4, 4).alias("read_id"), word(8, 4).alias("c"), word(12, 2).alias("offset_start"), word(14, 2).alias("score"))
    return packed.select("region_id", "read_id", (F.col("c") >= 1 << 31).alias("rc"), (F.col("c") % (1 << 31)).alias("cigar_id"), "offset_start", "score")


def sampled_places(spark: SparkSession, regions: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n positions, uniform over the regions (contig, start, end): a draw falls into a region by its share of all lengths."""
    from pyspark.sql import window as W

    w = W.Window.partitionBy("contig").orderBy("start", "end")
    sizes = regions.withColumn("size", F.col("end") - F.col("start")).withColumn("upto", F.sum("size").over(w))
    contigs = sizes.groupBy("contig").agg(F.sum("size").alias("all"))
    ends = contigs.withColumn("last", F.sum("all").over(W.Window.orderBy("contig")))  # one row for each contig
    total = contigs.agg(F.sum("all")).first()[0] or 0
    draws = spark.range(n).withColumn("at", F.floor(F.rand(seed) * total))
    met = draws.join(F.broadcast(ends), (F.col("at") < F.col("last")) & (F.col("at") >= F.col("last") - F.col("all")))
    met = met.withColumn("within", F.col("at") - F.col("last") + F.col("all"))
    inside = met.join(sizes.withColumnRenamed("contig", "c"), (F.col("contig") == F.col("c")) & (F.col("within") < F.col("upto")) & (F.col("within") >= F.col("upto") - F.col("size")))
    return inside.select("id", "contig", (F.col("start") + F.col("within") - F.col("upto") + F.col("size")).cast("long").alias("pos"))


def write_fastq(reads: DataFrame, path: str) -> None:
    reads.select(F.concat_ws("\n", F.concat(F.lit("@"), F.col("qname")), "seq", F.lit("+"), "qual")).write.text(path)


def write_fasta(sequences: DataFrame, path: str) -> None:
    sequences.select(F.concat(F.lit(">"), F.col("name"), F.lit("\n"), F.col("seq"))).write.text(path)


def write_by_call(reads: DataFrame, path: str) -> None:
    reads.write.partitionBy("call_id").parquet(path)
