"""Evidence of a region: scores, distances, windows, breakpoints, support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import sequence as S
from ..params import DEFAULT, Params


def region_scores(hits: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """(region_id, rev, score, reads) of the hits whose qname isn't used yet."""
    left = hits if used is None else hits.join(used.select("qname").distinct(), "qname", "left_anti")
    return left.groupBy("region_id", "rev").agg(F.sum("score").cast("long").alias("score"), F.count("*").alias("reads"))


def best_regions(scores: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first of each group in a total order."""
    return scores.withColumn("rank", F.row_number().over(W.Window.partitionBy(*by).orderBy(*order))).where("rank = 1").drop("rank")


def distances(hits: DataFrame, length: Column) -> DataFrame:
    """(region_id, rev, qname, distance): the furthest end from the breakpoint, clips included; it lies at 0 if rev, else at length."""
    d = F.when(F.col("rev"), F.col("offset_end") + F.col("rclip")).otherwise(length - F.col("offset_start") + F.col("lclip"))
    return hits.groupBy("region_id", "rev", "qname").agg(F.max(d).cast("long").alias("distance"))


def dedup_by_distance(pairs: DataFrame, by: list[str], tie: str) -> DataFrame:
    """Of each pair of distances the best score."""
    n = F.row_number().over(W.Window.partitionBy(*by, "h_dist", "v_dist").orderBy(F.desc("score"), tie))
    return pairs.withColumn("n", n).where("n = 1").drop("n")


def clip_mode(hits: DataFrame) -> DataFrame:
    """(region_id, rev, position, clips): the most frequent clipped position; the first if rev, else the last of equal ones."""
    at = hits.where(F.when(F.col("rev"), F.col("lclip")).otherwise(F.col("rclip")) > 0)
    at = at.withColumn("position", F.when(F.col("rev"), F.col("offset_start")).otherwise(F.col("offset_end")))
    counts = at.groupBy("region_id", "rev", "position").agg(F.count("*").alias("clips"))
    side = F.when(F.col("rev"), F.col("position")).otherwise(-F.col("position"))
    return best_regions(counts, ["region_id", "rev"], [F.desc("clips"), side])


def sliding_scores(hits: DataFrame, reach: int) -> DataFrame:
    """(region_id, rev, position, total): at each end, the scores of the ends within reach on the side of the reads."""
    end = F.when(F.col("rev"), F.col("offset_start")).otherwise(F.col("offset_end"))
    points = hits.withColumn("position", end).groupBy("region_id", "rev", "position").agg(F.sum("score").cast("long").alias("score"))
    w = W.Window.partitionBy("region_id", "rev").orderBy("position")
    behind, ahead = F.sum("score").over(w.rangeBetween(-(reach - 1), 0)), F.sum("score").over(w.rangeBetween(0, reach - 1))
    return points.withColumn("total", F.when(F.col("rev"), ahead).otherwise(behind).cast("long")).drop("score")


def accept_windows(hits: DataFrame, reach: int) -> DataFrame:
    """(region_id, rev, low, high): where reads may lie.

    The breakpoint is the most frequent clipped position if it has two clips or more, or is where the reads begin
    (rev) or end; else the place of the best sliding score. Without any clip, reads that begin at 0 count as clipped there.
    """
    extent = hits.groupBy("region_id", "rev").agg(F.min("offset_start").alias("first"), F.max("offset_end").alias("last"))
    mode = extent.join(clip_mode(hits), ["region_id", "rev"], "left")
    place = F.coalesce("position", F.when(F.col("rev"), F.lit(0).cast("long")))
    sure = (F.col("clips") >= 2) | (place == F.when(F.col("rev"), F.col("first")).otherwise(F.col("last")))
    mode = mode.where(sure).select("region_id", "rev", place.alias("clip_at"))
    side = F.when(F.col("rev"), -F.col("position")).otherwise(F.col("position"))
    best = best_regions(sliding_scores(hits, reach), ["region_id", "rev"], [F.desc("total"), side]).select("region_id", "rev", F.col("position").alias("score_at"))
    bp = best.join(mode, ["region_id", "rev"], "left").withColumn("bp", F.coalesce("clip_at", "score_at"))
    return bp.select("region_id", "rev", F.when(F.col("rev"), F.col("bp")).otherwise(F.col("bp") - reach).alias("low"), F.when(F.col("rev"), F.col("bp") + reach).otherwise(F.col("bp")).alias("high"))


def misfits(hits: DataFrame, windows: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(region_id, rev, qname) of the names with a hit outside the window, or with a clip of good quality far from the window's edge.

    hits: also lclip_quality and rclip_quality, the average qualities of the clips.
    """
    met = hits.join(windows, ["region_id", "rev"])
    outside = (F.col("offset_start") < F.col("low")) | (F.col("offset_end") > F.col("high"))
    left, right = _far_clips(p)
    good = lambda c: F.col(c) >= p.clip_quality
    return met.where(outside | (left & good("lclip_quality")) | (right & good("rclip_quality"))).select("region_id", "rev", "qname").distinct()


def conforming(hits: DataFrame, windows: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Hits of the qnames that are no misfits. Where there are two sides, take the misfits of both."""
    return hits.join(misfits(hits, windows, p), ["region_id", "rev", "qname"], "left_anti")


def _far_clips(p: Params) -> tuple[Column, Column]:
    """Whether a long left and right clip lies far from the window's edge on its side."""
    far = lambda clip, at, edge: (F.col(clip) > p.max_clip_distance) & (F.abs(F.col(at) - F.col(edge)) > p.max_clip_distance)
    return far("lclip", "offset_start", "low"), far("rclip", "offset_end", "high")


def suspicious(hits: DataFrame, windows: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Adds suspicious: the aligned part of the read (seq), or what it lies on (target, where there is one), is of low complexity, or a clip lies far from the edge."""
    aligned = F.substring(F.col("seq"), (F.col("lclip") + 1).cast("int"), (F.length("seq") - F.col("lclip") - F.col("rclip")).cast("int"))
    low = S.low_complexity(aligned)
    if "target" in hits.columns:
        low = low | F.coalesce(S.low_complexity(F.col("target")), F.lit(False))
    left, right = _far_clips(p)
    return hits.join(windows, ["region_id", "rev"]).withColumn("suspicious", low | left | right).drop("low", "high")


def with_suspects(host: DataFrame, virus: DataFrame) -> DataFrame:
    """Host hits, suspicious also where a virus hit of the name is."""
    names = virus.where("suspicious").select("qname").distinct().withColumn("by_virus", F.lit(True))
    return host.join(names, "qname", "left").withColumn("suspicious", F.col("suspicious") | F.coalesce("by_virus", F.lit(False))).drop("by_virus")


def breakpoints(hits: DataFrame) -> DataFrame:
    """(region_id, rev, start, end, bp): extent of the hits; the breakpoint is the start if rev, else the end."""
    ext = hits.groupBy("region_id", "rev").agg(F.min("offset_start").alias("start"), F.max("offset_end").alias("end"))
    return ext.withColumn("bp", F.when(F.col("rev"), F.col("start")).otherwise(F.col("end")))


def support(hits: DataFrame) -> DataFrame:
    """(region_id, rev, reads, good_pairs, score_ratio): rows, distinct unsuspicious qnames, mean score for each base spanned."""
    good = F.count_distinct(F.when(~F.col("suspicious") & ~F.col("too_long"), F.col("qname")))
    ratio = F.avg(F.col("score") / (F.col("offset_end") - F.col("offset_start") + 1))
    return hits.groupBy("region_id", "rev").agg(F.count("*").alias("reads"), good.alias("good_pairs"), F.round(ratio, 6).alias("score_ratio"))


def split_reads(hits: DataFrame, bps: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(region_id, rev, split_reads): hits clipped at the breakpoint's side within the clip distance of it."""
    met = hits.join(bps.select("region_id", "rev", "bp"), ["region_id", "rev"])
    clip, at = F.when(F.col("rev"), F.col("lclip")).otherwise(F.col("rclip")), F.when(F.col("rev"), F.col("offset_start")).otherwise(F.col("offset_end"))
    near = (clip >= p.min_clip_len) & (F.abs(at - F.col("bp")) <= p.max_clip_distance)
    return met.groupBy("region_id", "rev").agg(F.count_if(near).alias("split_reads"))


def too_long(pairs: DataFrame, max_is: int) -> DataFrame:
    """Adds too_long: the two distances to the breakpoint are more than an insert."""
    return pairs.withColumn("too_long", F.col("h_dist") + F.col("v_dist") > max_is)


def pileup(bases: DataFrame, by: list[str], place: str, base: str) -> DataFrame:
    """(by, place, depth, consensus): the only most frequent base with two votes or more, else N."""
    counts = bases.groupBy(*by, place, base).agg(F.count("*").alias("votes"))
    w = W.Window.partitionBy(*by, place).orderBy(F.desc("votes"), base)
    top = counts.withColumn("n", F.row_number().over(w)).withColumn("next", F.lead("votes").over(w)).withColumn("depth", F.sum("votes").over(W.Window.partitionBy(*by, place)))
    win = (F.col("votes") >= 2) & (F.col("next").isNull() | (F.col("votes") > F.col("next")))
    return top.where("n = 1").select(*by, place, F.col("depth").cast("long").alias("depth"), F.when(win, F.col(base)).otherwise("N").alias("consensus"))


def dense_ids(regions: DataFrame, by: str, order: list[str], into: str = "region_id") -> DataFrame:
    """Ids from 0 up in order of (by, order), made in parallel: numbers within each group, and the sums of the groups before.

    Only the table of group sizes, one row for each contig, is ordered as a whole.
    """
    n = F.row_number().over(W.Window.partitionBy(by).orderBy(*order)) - 1
    sizes = regions.groupBy(by).agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(W.Window.orderBy(by).rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    first = sizes.select(by, before.alias("first"))
    return regions.withColumn("n", n).join(first, by).withColumn(into, F.col("first") + F.col("n")).drop("n", "first")
