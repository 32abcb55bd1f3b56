"""Spaced-seed screen of reads against a set of target sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import packed
from ..functions import sequence as S
from ..params import DEFAULT, Params
from . import tables
from .sizes import is_small, spread

#: Bits of the map of seeds: 32 MB.
MAP_BITS = 28


def seed_index(targets: DataFrame, seq: str, p: Params = DEFAULT) -> DataFrame:
    """Distinct (j, seed) of both orientations, without k-mers of nearly one base."""
    both = targets.select(F.explode(F.array(F.col(seq), S.reverse_complement(F.col(seq)))).alias("s"))
    k = both.select(F.explode(S.kmers(F.col("s"), p.seed_k)).alias("kmer")).distinct()
    seeds = k.select(F.inline(S.spaced_seeds(F.col("kmer"), p.seed_segments)))
    return seeds.where(S.valid_kmer(F.col("seed"))).distinct()


def matched_positions(reads: DataFrame, seeds: DataFrame, key: str, seq: str, p: Params = DEFAULT) -> DataFrame:
    """(key, pos) of the k-mers with at least one masked seed in the index.

    A map of the seeds rules most k-mers out where they stand; only the others become rows and meet the index.
    Few seeds are broadcast, and k-mers pass by them without a shuffle. Otherwise each k-mer is looked up once,
    however often it occurs: distinct k-mers meet the seeds, and what matches goes back to the positions.
    """
    seeds = tables.written(seeds)
    map_ = packed.index_map(seeds.select("j", "seed"), p.seed_k - 3, MAP_BITS)
    dealt = spread(reads.select(key, seq), key)
    at = dealt.select(key, F.inline(packed.candidates(dealt, seq, p.seed_k, map_, MAP_BITS, p.seed_segments))).drop("rc")
    if is_small(seeds):
        each = at.select(key, "pos", F.inline(S.spaced_seeds(F.col("kmer"), p.seed_segments)))
        return each.join(F.broadcast(seeds), ["j", "seed"], "left_semi").select(key, "pos").distinct()
    found = at.select("kmer").distinct().select("kmer", F.inline(S.spaced_seeds(F.col("kmer"), p.seed_segments)))
    hit = found.join(seeds, ["j", "seed"], "left_semi").select("kmer").distinct()
    return at.join(hit, "kmer", "left_semi").select(key, "pos")


def screen(reads: DataFrame, targets: DataFrame, key: str = "read_id", seq: str = "seq", p: Params = DEFAULT) -> DataFrame:
    """(key, hits) of the reads with enough matching positions."""
    at = matched_positions(reads, seed_index(targets, seq, p), key, seq, p)
    return at.groupBy(key).agg(F.count("*").alias("hits")).where(F.col("hits") >= p.seed_min_hits)


def screen_pairs(pairs: DataFrame, targets: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Read pairs (qname, seq1, seq2) of which either mate passes."""
    mates = pairs.select("qname", F.explode(F.array("seq1", "seq2")).alias("seq")).withColumn("read_id", F.struct("qname", "seq"))
    kept = screen(mates.select("read_id", "seq").distinct(), targets, p=p).select(F.col("read_id.qname").alias("qname")).distinct()
    return pairs.join(kept, "qname", "left_semi")
