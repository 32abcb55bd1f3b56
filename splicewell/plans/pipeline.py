"""Junctions from mapped pairs, end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import associate as A
from ..operators import evidence as E
from ..operators import intervals as I
from ..operators import rounds as R
from ..operators import tables
from ..operators.sizes import only_counted, small
from ..params import DEFAULT, Params


def host_regions(pairs: DataFrame, host: DataFrame, max_is: int) -> DataFrame:
    """(region_id, contig, start, end, seq) around the host ends of the pairs."""
    ends = pairs.select(F.xxhash64("qname").alias("id"), F.col("host_contig").alias("contig"), F.col("host_strand").alias("strand"), F.col("host_pos").cast("long").alias("start"), (F.col("host_pos") + F.length("host_seq")).cast("long").alias("end"))
    regions = I.clusters(ends, max_is, host.select(F.col("name").alias("contig"), F.length("seq").alias("length")))
    numbered = E.dense_ids(regions, "contig", ["start", "end"])
    cut = F.substring(F.col("s"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    return numbered.join(host.select(F.col("name").alias("contig"), F.col("seq").alias("s")), "contig").select("region_id", "contig", "start", "end", cut.alias("seq"))


def junctions(pairs: DataFrame, host: DataFrame, virus: DataFrame, max_is: int, p: Params = DEFAULT) -> DataFrame:
    """Calls from pairs (qname, host_contig, host_strand, host_pos, host_seq, virus_seq) against contigs (name, seq).

    Host reads are aligned to regions around them, virus reads to the virus contigs to learn where they lie; then junctions
    are assigned best first, with their virus side looked at again each time (operators/rounds.py).
    (call_id, host_chr, host_rev, host_pos, virus_chr, virus_rev, virus_pos, reads, pairs, good_pairs, split_reads, score, pbs, coverage)
    """
    with only_counted(pairs.sparkSession):
        regions = tables.written(host_regions(pairs, host, max_is))
        names = tables.written(pairs.select(F.xxhash64("qname").alias("read_id"), "qname", "host_seq", "virus_seq"))
        h = A.realign(names.select("read_id", F.col("host_seq").alias("seq")), regions.select("region_id", "seq"), p)
        seq = F.when(F.col("rc"), S.reverse_complement(F.col("host_seq"))).otherwise(F.col("host_seq"))
        good = F.lit(p.clip_quality)  # there are no qualities
        hits = h.join(names, "read_id").select(
            "region_id", F.col("rc").alias("rev"), "read_id", "qname", F.lit(False).alias("secondary"), F.col("ref_begin").alias("offset_start"), (F.col("ref_end") + 1).alias("offset_end"),
            F.col("query_begin").alias("lclip"), (F.col("read_len") - 1 - F.col("query_end")).alias("rclip"), good.alias("lclip_quality"), good.alias("rclip_quality"), "score", seq.alias("seq"), "cigar",
        )
        contigs = tables.written(virus.select(F.xxhash64("name").alias("region_id"), "name", "seq"))
        v = A.realign(names.select("read_id", F.col("virus_seq").alias("seq")), contigs.select("region_id", "seq"), p)
        v = v.join(names.select("read_id", "qname"), "read_id").join(small(contigs.select("region_id", "name")), "region_id")
        places = v.select("qname", F.col("name").alias("contig"), F.when(F.col("rc"), "R").otherwise("F").alias("strand"), F.col("ref_begin").cast("long").alias("start"), (F.col("ref_end") + 1).cast("long").alias("end"))
        mates = names.select("qname", F.col("virus_seq").alias("seq"), F.lit(None).cast("array<int>").alias("quals"))
        sized = regions.select("region_id", "contig", "start", F.length("seq").cast("long").alias("length"))
        contigs = contigs.select("name", "seq")
        support = R.assign(hits, mates, places, sized, contigs, max_is, p)
        calls = R.junction_calls(support, sized, contigs, max_is, p)
        return calls.select(F.col("id").alias("call_id"), "host_chr", "host_rev", "host_pos", "virus_chr", "virus_rev", "virus_pos", "reads", "pairs", "good_pairs", "split_reads", "score", "pbs", "coverage")
