"""Reads to candidate regions: shared k-mers, alignment, near-best filter, strand lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import packed
from ..functions import sequence as S
from ..functions.alignment import accepted, local_alignment
from ..params import DEFAULT, Params
from . import tables
from .sizes import small, spread


def shared_kmers(reads: DataFrame, regions: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(read_id, region_id, rc) with two shared k-mers that don't overlap in the read.

    Both orientations of the reads are looked up; region k-mers of nearly one base don't count. A map of the regions' k-mers
    rules most of the reads' out where they stand; only the others become rows and are joined.
    """
    index = regions.select("region_id", F.explode(S.kmers(F.col("seq"), p.assoc_k)).alias("kmer")).distinct().where(S.valid_kmer(F.col("kmer")))
    index = tables.written(index)
    map_ = packed.index_map(index.select("kmer"), p.assoc_k)
    dealt = spread(reads.select("read_id", "seq"), "read_id")
    at = dealt.select("read_id", F.inline(packed.candidates(dealt, "seq", p.assoc_k, map_, ways=packed.BOTH_WAYS)))
    met = at.join(small(index), "kmer").groupBy("read_id", "region_id", "rc").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    return met.where(F.col("last") - F.col("first") >= p.assoc_gap).select("read_id", "region_id", "rc")


def near_best(found: DataFrame, by: list[str], score: str, share: float = 0.75) -> DataFrame:
    """Rows with at least so much of the best score of their group."""
    best = F.max(score).over(W.Window.partitionBy(*by))
    return found.withColumn("best", best).where(F.col(score) >= share * F.col("best")).drop("best")


def realign(reads: DataFrame, regions: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Accepted near-best alignments of reads to regions; distinct pairs of sequences are aligned once."""
    pairs = shared_kmers(reads, regions, p).join(reads.select("read_id", "seq"), "read_id").join(small(regions.select("region_id", F.col("seq").alias("target"))), "region_id")
    pairs = pairs.withColumn("query", F.when(F.col("rc"), S.reverse_complement(F.col("seq"))).otherwise(F.col("seq")))
    # dealt before distinct(), which then takes the number of partitions as it is: few bytes to read are much work
    once = spread(pairs.select("query", "target"), "query", "target").distinct().withColumn("found", local_alignment(F.col("query"), F.col("target"), p, p.min_score))
    ok = once.where(accepted(F.col("found"), F.col("query"), p))
    met = pairs.join(ok, ["query", "target"]).select("read_id", "region_id", "rc", F.length("query").alias("read_len"), "found.*")
    return near_best(met, ["read_id"], "score", p.near_best)


def strand_lists(found: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Rows with the strand list (rev) they belong to: clipped secondary reads by the side of their clip, others by orientation."""
    lists = F.when(~F.col("secondary"), F.array(F.col("rc"))).otherwise(
        F.array_compact(F.array(F.when(F.col("lclip") >= p.min_clip, F.lit(True)), F.when(F.col("rclip") >= p.min_clip, F.lit(False))))
    )
    return found.withColumn("rev", F.explode(lists))


def lookup(realignments: DataFrame, reads: DataFrame, qname=None) -> DataFrame:
    """Realignments of a read name, or all."""
    found = realignments.join(reads.select("read_id", "qname"), "read_id")
    return found if qname is None else found.where(F.col("qname") == qname)
