"""Mates: assembly, routing of anchors and clips, merging of samples, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import sequence as S
from ..params import DEFAULT, Params


def assemble(reads: DataFrame, key: str, mate: str, payload: list[str], order: list[str]) -> DataFrame:
    """One row for each key with both mates (1 and 2): payload columns with suffix 1 and 2. Of several records the last in order counts."""
    last = lambda m: F.max(F.when(F.col(mate) == m, F.struct(*order, *[F.col(c).alias(f"p_{c}") for c in payload])))
    both = reads.groupBy(key).agg(last(1).alias("m1"), last(2).alias("m2")).where("m1 is not null and m2 is not null")
    return both.select(key, *[F.col(f"m{m}.p_{c}").alias(f"{c}{m}") for m in (1, 2) for c in payload])


def clips(reads: DataFrame, seq: str, left: str, right: str, p: Params = DEFAULT) -> DataFrame:
    """Adds side and clip_seq of the clipped reads; a long left clip wins. In compat mode a right clip starts and ends one base early."""
    is_left, is_right = F.col(left) >= p.min_clip, F.col(right) >= p.min_clip
    shift = 0 if p.compat else 1
    cut = F.substring(F.col(seq), F.length(seq) - F.col(right) + shift, F.col(right))
    return reads.withColumn("side", F.when(is_left, "L").when(is_right, "R")).where("side is not null").withColumn("clip_seq", F.when(is_left, F.substring(F.col(seq), F.lit(1), F.col(left))).otherwise(cut))


def route(anchors: DataFrame, host_side: DataFrame, virus_side: DataFrame, key: str) -> DataFrame:
    """Adds mate_in: which side's mates have the anchor's key (host wins), else none."""
    h, v = host_side.select(key).distinct().withColumn("h", F.lit(True)), virus_side.select(key).distinct().withColumn("v", F.lit(True))
    met = anchors.join(h, key, "left").join(v, key, "left")
    return met.withColumn("mate_in", F.when(F.col("h"), "host").when(F.col("v"), "virus").otherwise("none")).drop("h", "v")


def reconcile(anchors: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Keys with exactly two anchors: what the host and the virus list gain.

    anchors has is_virus and towards (whether the read points to the breakpoint). Rows: (key, gains, source
    is_virus, at_clip, secondary, flipped).
    """
    rank = F.row_number().over(W.Window.partitionBy(key).orderBy("is_virus", *order))
    n = F.count("*").over(W.Window.partitionBy(key))
    two = anchors.withColumn("n", n).where("n = 2").withColumn("i", rank)
    side = lambda i, c: F.max(F.when(F.col("i") == i, F.col(c)))
    wide = two.groupBy(key).agg(*[side(i, c).alias(f"{c}{i}") for i in (1, 2) for c in ("is_virus", "towards")])
    v1, v2, t1, t2 = (F.col(c) for c in ("is_virus1", "is_virus2", "towards1", "towards2"))

    def gain(to: str, who: Column, at_clip: bool, secondary: bool, flipped: Column) -> Column:
        return F.struct(F.lit(to).alias("gains"), who.cast("int").alias("anchor"), F.lit(at_clip).alias("at_clip"), F.lit(secondary).alias("secondary"), flipped.alias("flipped"))

    no, yes = F.lit(False), F.lit(True)
    mixed = F.array(gain("host", F.lit(1), False, False, no), gain("host", F.lit(2), False, True, t2), gain("virus", F.lit(2), False, False, no))
    front = F.when(t1, 1).otherwise(2)
    hosts = F.array(gain("host", front, False, False, no), gain("host", 3 - front, False, True, yes), gain("virus", 3 - front, True, False, no))
    away = F.when(~t1, 1).otherwise(2)
    viruses = F.array(gain("host", away, True, False, no), gain("host", 3 - away, False, True, yes), gain("virus", 3 - away, False, False, no))
    found = F.when(v1 != v2, mixed).when(~v1, hosts).otherwise(viruses)
    return wide.select(key, F.inline(found))


def exactly_two(reads: DataFrame, key: str, primary: Column) -> DataFrame:
    """Rows of the keys with exactly two primary records, over all samples together."""
    kept = reads.where(primary).groupBy(key).agg(F.count("*").alias("n")).where("n = 2").select(key)
    return reads.join(kept, key, "left_semi")


def duplicates_by_sequence(pairs: DataFrame, order: list[Column]) -> DataFrame:
    """Adds dup_seq: not the first, in order, of the pairs with the same two sequences in either order.

    Pairs are dealt by a digest of both sequences in full, so sequences that the caller doesn't select don't travel.
    """
    key = F.sha2(F.concat_ws("-", F.least("seq1", "seq2"), F.greatest("seq1", "seq2")), 256)
    n = F.row_number().over(W.Window.partitionBy("joint").orderBy(*order))
    return pairs.withColumn("joint", key).withColumn("dup_seq", n > 1).drop("joint")


def duplicates_by_position(pairs: DataFrame, place: list[str], quality: str, tie: list[str], p: Params = DEFAULT) -> DataFrame:
    """Adds dup_pos: not the head of its place. The head has the lowest quality in compat mode, else the highest."""
    order = F.col(quality).asc() if p.compat else F.col(quality).desc()
    return pairs.withColumn("dup_pos", F.row_number().over(W.Window.partitionBy(*place).orderBy(order, *tie)) > 1)


def insert_size(pairs: DataFrame, size: str, sigma: int = 5) -> DataFrame:
    """(n, mean, upper_sd, max_is): integer mean, spread of what lies above it, and mean + sigma x spread."""
    mean = pairs.agg(F.floor(F.avg(size)).alias("mean"), F.count(size).alias("n"))
    far = pairs.crossJoin(F.broadcast(mean)).where(F.col(size) > F.col("mean"))  # one row
    spread = far.agg(F.floor(F.sqrt(F.avg((F.col(size) - F.col("mean")) * (F.col(size) - F.col("mean"))))).alias("upper_sd"))
    out = mean.crossJoin(F.broadcast(spread)).select("n", "mean", F.coalesce("upper_sd", F.lit(0)).alias("upper_sd"))
    return out.withColumn("max_is", F.col("mean") + sigma * F.col("upper_sd"))


def sampled_positions(pairs: DataFrame, contig: str, start: str, mate: str, most: int = 101) -> DataFrame:
    """At most so many distinct (start, mate start) of each start."""
    n = F.row_number().over(W.Window.partitionBy(contig, start).orderBy(mate))
    return pairs.select(contig, start, mate).distinct().withColumn("n", n).where(F.col("n") <= most).drop("n")


def both_primary(flag: str = "flag") -> Column:
    return S.primary(F.col(flag))


def relevant(reads: DataFrame, is_virus: Column, p: Params = DEFAULT) -> DataFrame:
    """Reads without duplicates (flag 1024) and without host reads that are aligned from end to end, as one stretch (cigar)."""
    whole = F.col("cigar").rlike("^[0-9]+M$")
    return reads.where(~S.has_flag(F.col("flag"), 1024) & ~(whole & ~is_virus))


def inter_organism(reads: DataFrame, is_virus: Column, mate_is_virus: Column, seq: str = "seq") -> DataFrame:
    """Discordant reads, not nearly of one base, of which one mate is on the host and the other on a virus."""
    apart = S.discordant(F.col("flag"), F.col("contig"), F.col("mate_contig"), F.col("isize"))
    return reads.where(apart & ~S.is_poly(F.col(seq)) & (is_virus != mate_is_virus))


def good_clips(reads: DataFrame, clipped: DataFrame, key: list[str], is_virus: Column) -> DataFrame:
    """Reads met with the mapped clip of their own key, the last in order of (pos, contig), that lies on the other organism.

    clipped: key, pos, contig and clip_is_virus of the clips' alignments. Adds clip_pos and clip_contig.
    """
    last = clipped.groupBy(*key).agg(F.max(F.struct("pos", "contig", "clip_is_virus")).alias("at"))
    met = reads.join(last, key).where(F.col("at.clip_is_virus") != is_virus)
    return met.select(*reads.columns, F.col("at.pos").alias("clip_pos"), F.col("at.contig").alias("clip_contig"))


def at_clips(gained: DataFrame, clipped: DataFrame, key: list[str]) -> DataFrame:
    """Rows of reconcile() that lie where the anchor's clip is mapped, with the clip's place; the others with their own."""
    places = clipped.groupBy(*key).agg(F.max(F.struct("pos", "contig")).alias("at"))
    met = gained.join(places, key, "left")
    here = lambda c: F.when(F.col("at_clip"), F.col(f"at.{c}")).otherwise(F.col(c)).alias(c)
    return met.where(~F.col("at_clip") | F.col("at").isNotNull()).select(*[here(c) if c in ("pos", "contig") else F.col(c) for c in gained.columns])


def longest_read(reads: DataFrame, seq: str = "seq", by: list[str] = ()) -> DataFrame:
    """(by, read_len): length of the longest read."""
    return reads.groupBy(*by).agg(F.max(F.length(seq)).cast("long").alias("read_len"))


def widest_insert(samples: DataFrame, sample: str, size: str, sigma: int = 5) -> DataFrame:
    """(max_is): the largest of the samples' insert bounds."""
    mean = samples.groupBy(sample).agg(F.floor(F.avg(size)).alias("mean"))
    above = samples.join(F.broadcast(mean), sample).where(F.col(size) > F.col("mean"))  # one row for each sample
    spread = above.groupBy(sample, "mean").agg(F.floor(F.sqrt(F.avg((F.col(size) - F.col("mean")) ** 2))).alias("sd"))
    return spread.agg(F.max(F.col("mean") + sigma * F.col("sd")).cast("long").alias("max_is"))


def in_place_order(reads: DataFrame, contig: str = "contig", pos: str = "pos", tie: list[str] = ()) -> DataFrame:
    """Reads in order of contig and position, over all partitions."""
    return reads.orderBy(contig, pos, *tie)


def own_organism(reads: DataFrame, regions: DataFrame, contig: str = "contig") -> DataFrame:
    """Reads or regions on a contig of the wanted organism's (a table of contig)."""
    return reads.join(regions.select(contig).distinct(), contig, "left_semi")
