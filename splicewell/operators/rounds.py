"""Junctions from host hits and virus mates: the best region first, looked at again before it is kept.

A host region and strand (a key) is worth the host scores of its unused names. Before a key becomes a junction its names'
virus reads are aligned anew to the virus regions that its mates lie in, both sides are held against windows,
repeated pairs, the pileup and low complexity, and its worth changes at each checkpoint; if it no longer leads then, it
goes back with the new worth. One by one, that is a queue. Keys meet only through names that they share, so a key that
leads all keys it shares a name with is next whatever the others do, and what a trial finds holds until a name of its
key is taken. So all keys are tried at once, those that lead are kept or put back, and what has lost names is tried
again. The result is that of the queue.

Tables:
  hits    region_id, rev, read_id, qname, secondary, offset_start, offset_end, lclip, rclip, lclip_quality, rclip_quality,
          score, seq, cigar (of the read as aligned; offsets are within the region)
  mates   qname, seq and quals (an array, or null) in the direction that the read was sequenced; one row for each name
  places  qname, contig, strand, start, end: where mates are mapped, their alternatives included
  regions region_id, length
  virus   name, seq

Defined results: a key whose worth has fallen to the least worth or below is not looked at again; a key without a virus
region is given up; equal worths go by the larger region, then the reverse strand; equal virus scores by the first
region, then the forward strand; equal scores of repeated pairs by name. Names without a mate support a junction by
their clipped reads alone, and don't count in distances. Hits without a name, region or score are left out.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..functions.alignment import accepted, local_alignment
from ..params import DEFAULT, Params
from . import evidence as E
from . import intervals as I
from . import tables
from .mismatch import mismatching
from .sizes import small, spread

KEY = ["region_id", "rev"]
#: A key with one virus region and strand.
PLACE = ["v_contig", "v_start", "v_end", "v_rev"]
TRIAL = KEY + PLACE
#: Rows of keys and names that one task may decide; while there are more, they are decided in rounds.
LAST = 50_000


def _as_key(df: DataFrame, side: str) -> DataFrame:
    """A side's hits with the trial they belong to in place of a region, as the operators of evidence want it."""
    trial = F.struct(*TRIAL).alias("region_id")
    names = ["read_id", "qname", "secondary", "offset_start", "offset_end", "lclip", "rclip", "lclip_quality", "rclip_quality", "score", "seq"]
    if side == "host":
        return df.select(trial, "rev", *names)
    return df.select(trial, F.col("v_rev").alias("rev"), *[F.col(f"v_{c}").alias(c) for c in names if c != "qname"], "qname")


class Alignments:
    """Alignments of virus reads to virus regions, each made once; those that fail are kept as well.

    Keyed by region, strand and sequence. What is asked for and not there yet is aligned and added.
    """

    def __init__(self, virus: DataFrame, p: Params):
        self.virus, self.p, self.path, self.known = virus, p, tables.place(virus.sparkSession), None

    def of(self, wanted: DataFrame) -> DataFrame:
        """Adds found (null where the alignment isn't accepted); wanted has PLACE and query."""
        key = [*PLACE, "query"]
        new = wanted.select(*key).distinct()
        if self.known is not None:
            new = new.join(self.known, key, "left_anti")
        target = F.substring(F.col("whole"), (F.col("v_start") + 1).cast("int"), (F.col("v_end") - F.col("v_start")).cast("int"))
        met = new.join(small(self.virus.select(F.col("name").alias("v_contig"), F.col("seq").alias("whole"))), "v_contig")
        met = spread(met.select(*key, target.alias("target")), "query")
        made = met.withColumn("found", local_alignment(F.col("query"), F.col("target"), self.p, self.p.min_score))
        made = made.withColumn("found", F.when(accepted(F.col("found"), F.col("query"), self.p), F.col("found"))).select(*key, "found")
        self.known = tables.written(made, self.path)
        return wanted.join(self.known, key)


def _entries(hits: DataFrame, mates: DataFrame) -> DataFrame:
    """Host hits of trial keys with the virus read that stands across from each: its mate, or one made of a clipped hit.

    A clipped read, turned to the far side of the junction, holds the virus part itself.
    """
    paired = hits.where(~F.col("secondary")).join(mates.select("qname", F.col("seq").alias("mate"), F.col("quals").alias("mate_quals")), "qname").withColumn("made", F.lit(False))
    clip = F.when(F.col("rev"), F.col("lclip")).otherwise(F.col("rclip"))
    turned = F.when(F.col("rev"), F.col("seq")).otherwise(S.reverse_complement(F.col("seq")))
    own = hits.where(clip > 0).select("*", turned.alias("mate"), F.lit(None).cast(mates.schema["quals"].dataType).alias("mate_quals"), F.lit(True).alias("made"))
    return paired.select(*own.columns).unionByName(own)


def virus_regions(hits: DataFrame, places: DataFrame, virus: DataFrame, reach: int, p: Params = DEFAULT) -> DataFrame:
    """(KEY, PLACE) of the regions, on both strands, where the mates of each key's hits cluster, snapped outwards."""
    at = hits.where(~F.col("secondary")).select(*KEY, "qname").distinct().join(places, "qname")
    lengths = virus.select(F.col("name").alias("contig"), F.length("seq").cast("long").alias("length"))
    at = at.join(small(lengths.select("contig")), "contig", "left_semi")
    found = I.clusters(at.select(*KEY, "contig", "strand", "start", "end"), reach, lengths, by=KEY).join(small(lengths), "contig")
    low, high = S.region_snap(F.col("start"), F.col("end"), F.col("length"), p.region_snap)
    snapped = found.select(*KEY, F.col("contig").alias("v_contig"), low.cast("long").alias("v_start"), high.cast("long").alias("v_end")).distinct()
    return snapped.withColumn("v_rev", F.explode(F.array(F.lit(False), F.lit(True))))


def _across(entries: DataFrame, regions: DataFrame, alignments: Alignments, p: Params) -> DataFrame:
    """Entries with the accepted alignment of their virus read to each of their key's virus regions, as v_ columns."""
    query = F.when(F.col("v_rev"), S.reverse_complement(F.col("mate"))).otherwise(F.col("mate"))
    met = tables.written(entries.join(regions, KEY).withColumn("query", query))
    found = alignments.of(met).where("found is not null")
    quals = F.when(F.col("v_rev"), F.reverse("mate_quals")).otherwise(F.col("mate_quals"))
    left, right = F.col("found.query_begin"), F.length("query") - 1 - F.col("found.query_end")
    quality = lambda part: F.coalesce(S.average_quality(part), F.lit(p.clip_quality)).cast("int")
    return found.withColumns(
        {
            "v_read_id": F.xxhash64("qname", "made", "mate"), "v_secondary": F.col("made"), "v_seq": F.col("query"), "v_score": F.col("found.score").cast("long"),
            "v_offset_start": F.col("found.ref_begin").cast("long"), "v_offset_end": F.col("found.ref_end").cast("long"), "v_lclip": left.cast("long"), "v_rclip": right.cast("long"),
            "v_lclip_quality": quality(F.slice(quals, F.lit(1), left)), "v_rclip_quality": quality(F.slice(quals, F.length("query") - right + 1, right)),
        }
    ).drop("found", "query", "mate", "mate_quals")


def _first_of_pairs(host: DataFrame, virus: DataFrame, lengths: DataFrame) -> DataFrame:
    """(region_id, qname) left of names that lie at equal distances on both sides: the one of the best virus score."""
    sized = lambda df, c: df.where("not secondary").join(lengths.select("region_id", c), "region_id")
    h = E.distances(sized(host, "h_length"), F.col("h_length")).select("region_id", "qname", F.col("distance").alias("h_dist"))
    v = E.distances(sized(virus, "v_length"), F.col("v_length")).select("region_id", "qname", F.col("distance").alias("v_dist"))
    best = virus.groupBy("region_id", "qname").agg(F.max("score").alias("score"))
    met = best.join(h, ["region_id", "qname"]).join(v, ["region_id", "qname"], "left").withColumn("v_dist", F.coalesce("v_dist", F.lit(0)))
    return E.dedup_by_distance(met, ["region_id"], "qname").select("region_id", "qname")


def virus_scores(across: DataFrame, lengths: DataFrame, reach: int, p: Params = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Scores of each trial, and its rows that conform.

    across: a written table of _across(); lengths: region_id (the trial as a struct), h_length, v_length. Windows come from the
    names left after repeated pairs are taken out; a name that misses the window of either side counts on neither.
    Scores: TRIAL, h, v, h_low, h_high, v_low, v_high.
    """
    sides = {s: _as_key(across, s) for s in ("host", "virus")}
    first = tables.written(_first_of_pairs(sides["host"], sides["virus"], lengths))
    windows = {s: tables.written(E.accept_windows(df.join(first, ["region_id", "qname"], "left_semi"), reach)) for s, df in sides.items()}
    misfits = [E.misfits(df, windows[s], p).select("region_id", "qname") for s, df in sides.items()]
    bad = misfits[0].union(misfits[1]).distinct()
    keyed = across.withColumn("trial", F.struct(*TRIAL))
    kept = tables.written(keyed.join(bad.withColumnRenamed("region_id", "trial"), ["trial", "qname"], "left_anti"))
    counted = kept.join(first.withColumnRenamed("region_id", "trial"), ["trial", "qname"], "left_semi")
    sums = counted.groupBy("trial").agg(F.sum("score").alias("h"), F.sum("v_score").alias("v"))
    of = lambda s: windows[s].select(F.col("region_id").alias("trial"), *[F.col(c).alias(f"{s[0]}_{c}") for c in ("low", "high")])
    scores = sums.join(of("host"), "trial").join(of("virus"), "trial")
    return scores.select("trial.*", "h", "v", "h_low", "h_high", "v_low", "v_high"), kept.drop("trial")


def best_virus_region(scores: DataFrame) -> DataFrame:
    """The best trial of each key, by host score, then virus score, the first region and the forward strand."""
    return E.best_regions(scores, KEY, [F.desc("h"), F.desc("v"), F.asc("v_contig"), F.asc("v_start"), F.asc("v_end"), F.asc("v_rev")])


class Trials:
    """What the rounds hold: hits, mates, places and the alignments made so far."""

    def __init__(self, hits: DataFrame, mates: DataFrame, places: DataFrame, regions: DataFrame, virus: DataFrame, reach: int, p: Params = DEFAULT):
        whole = F.col("qname").isNotNull() & F.col("region_id").isNotNull() & F.col("rev").isNotNull() & F.col("score").isNotNull()
        numbers = {c: F.col(c).cast("long") for c in ("offset_start", "offset_end", "lclip", "rclip", "score")} | {c: F.col(c).cast("int") for c in ("lclip_quality", "rclip_quality")}
        self.hits = tables.written(hits.where(whole).withColumns(numbers))
        self.mates, self.places, self.regions, self.virus, self.reach, self.p = tables.written(mates), tables.written(places), regions, tables.written(virus), reach, p
        self.alignments = Alignments(self.virus, p)

    def run(self, keys: DataFrame, used: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """Worth of the keys at the two checkpoints that differ, and the support that each would have as a junction.

        Worth: KEY, first, second (a key without a virus region isn't there). Support: one row for each hit, side and key.
        """
        hits = self.hits.join(keys.select(*KEY), KEY, "left_semi")
        if used is not None:
            hits = hits.join(used.select("qname"), "qname", "left_anti")
        hits = tables.written(hits)
        regions = tables.written(virus_regions(hits, self.places, self.virus, self.reach, self.p))
        across = tables.written(_across(_entries(hits, self.mates), regions, self.alignments, self.p))
        h_length = self.regions.select("region_id", F.col("length").cast("long").alias("h_length"))
        lengths = tables.written(regions.join(h_length, "region_id").select(F.struct(*TRIAL).alias("region_id"), "h_length", (F.col("v_end") - F.col("v_start")).alias("v_length")))
        scores, kept = virus_scores(across, lengths, self.reach, self.p)
        # a region none of whose names conforms is a region still, worth nothing
        every = regions.join(scores, TRIAL, "left").na.fill(0, ["h", "v"])
        best = tables.written(best_virus_region(every))
        bare = best.select(*TRIAL)
        virus = tables.written(_as_key(kept.join(bare, TRIAL), "virus"))
        host = tables.written(hits.join(bare, KEY).withColumn("trial", F.struct(*TRIAL)))
        first = tables.written(_first_of_pairs(_as_key(host, "host"), virus, lengths))
        named = lambda df, key: df.join(first.withColumnRenamed("region_id", key), [key, "qname"], "left_semi")
        host, virus = tables.written(named(host, "trial")), tables.written(named(virus, "region_id"))
        wrong = mismatching(host, self.p).select(*KEY, "qname")
        right = tables.written(host.join(wrong, [*KEY, "qname"], "left_anti"))
        other = virus.withColumn("trial", F.col("region_id")).join(right.select("trial", "qname").distinct(), ["trial", "qname"], "left_semi").drop("trial")
        edges = lambda s: best.select(F.struct(*TRIAL).alias("region_id"), F.col("rev" if s == "h" else "v_rev").alias("rev"), F.col(f"{s}_low").alias("low"), F.col(f"{s}_high").alias("high"))
        v = E.suspicious(other, edges("v"), self.p)
        h = E.suspicious(_as_key(right, "host"), edges("h"), self.p)
        flagged = v.where("suspicious").select("region_id", "qname").distinct().withColumn("by_virus", F.lit(True))
        h = h.join(flagged, ["region_id", "qname"], "left").withColumn("suspicious", F.col("suspicious") | F.coalesce("by_virus", F.lit(False))).drop("by_virus")
        support = tables.written(h.withColumn("side", F.lit("host")).unionByName(v.withColumn("side", F.lit("virus"))))
        one = host.groupBy(*KEY).agg(F.sum("score").alias("first"))
        two = support.where("side = 'host' and not suspicious").groupBy("region_id").agg(F.sum("score").alias("second")).select("region_id.region_id", "region_id.rev", "second")
        worth = bare.join(one, KEY, "left").join(two, KEY, "left").select(*KEY, F.coalesce("first", F.lit(0)).alias("first"), F.coalesce("second", F.lit(0)).alias("second"))
        return tables.written(worth), support


def decide(rows: pd.DataFrame, least: int) -> pd.DataFrame:
    """The queue over keys whose trials are known, as far as it goes; rows: KEY, worth, first, second, valid, qname, takes.

    A key that loses names has to be tried again. Until then neither it nor a key that comes after it and shares a name
    with it, or with one that waits, can be told; all others go on. Gives KEY, worth (as it stands), kept, kept_worth.
    """
    worth, known, holds, takes, sharing = {}, {}, {}, {}, {}
    for region, rev, w, one, two, valid, name, own in rows[[*KEY, "worth", "first", "second", "valid", "qname", "takes"]].itertuples(index=False, name=None):
        key = (region, rev)
        worth[key], known[key] = w, (one, two) if valid else None
        holds.setdefault(key, set()).add(name)
        sharing.setdefault(name, set()).add(key)
        if own:
            takes.setdefault(key, set()).add(name)
    heap = [(-w, -k[0], not k[1], k) for k, w in worth.items()]
    heapq.heapify(heap)
    waits, kept = set(), {}  # names that keys which wait hold

    def leads(value, key):
        return all((value, *key) > (worth[other], *other) for name in holds[key] for other in sharing[name] if other != key and worth[other] > least)

    while heap:
        key = heapq.heappop(heap)[3]
        if worth[key] <= least:
            continue
        if known[key] is None or holds[key] & waits:
            waits |= holds[key]
            continue
        one, two = known[key]
        if not leads(one, key):
            worth[key] = one
        else:
            worth[key] = two
            if two > least and leads(two, key):
                kept[key] = two
                for name in takes.get(key, ()):
                    for other in sharing.pop(name):
                        holds[other].discard(name)
                        known[other] = None
        heapq.heappush(heap, (-worth[key], -key[0], not key[1], key))
    return pd.DataFrame([(*k, w, k in kept, kept.get(k, 0)) for k, w in worth.items()], columns=[*KEY, "worth", "kept", "kept_worth"])


def _one_step(rows: DataFrame, least: int) -> DataFrame:
    """As decide(), but one step of all keys at once that lead every key they share a name with, and whose trial is known."""
    rank = F.struct("worth", *KEY)
    ranked = tables.written(rows.select(*KEY, "qname", rank.alias("rank")))
    leads = tables.written(ranked.groupBy("qname").agg(F.max("rank").alias("lead"), F.count("*").alias("keys")))
    led = leads.groupBy("lead").agg(F.count("*").alias("led"))
    held = ranked.groupBy("rank").agg(F.count("*").alias("held"))
    state = rows.select(*KEY, "worth", "first", "second", "valid").distinct()
    tops = led.join(held, led["lead"] == held["rank"]).where("led = held").select("lead.region_id", "lead.rev")
    tops = tables.written(state.where("valid").join(tops, KEY, "left_semi"))
    # the best of the others that share a name with each of them
    shared = leads.where("keys > 1").select("qname", "lead").join(tops.select(rank.alias("lead")), "lead", "left_semi")
    near = ranked.join(shared, "qname").where(F.col("rank") != F.col("lead")).groupBy("lead").agg(F.max("rank").alias("next")).select("lead.region_id", "lead.rev", "next")
    leading = lambda c: F.col("next").isNull() | (F.struct(F.col(c).alias("worth"), *KEY) > F.col("next"))
    met = tops.join(near, KEY, "left").select(
        *KEY, F.when(leading("first"), F.col("second")).otherwise(F.col("first")).alias("now"),
        (leading("first") & leading("second") & (F.col("second") > least)).alias("kept"), F.col("second").alias("kept_worth"),
    )
    after = state.join(met, KEY, "left")
    return after.select(*KEY, F.coalesce("now", "worth").alias("worth"), F.coalesce("kept", F.lit(False)).alias("kept"), F.coalesce("kept_worth", F.lit(0)).alias("kept_worth"))


OUTCOME = "region_id long, rev boolean, worth long, kept boolean, kept_worth long"


def assign(hits: DataFrame, mates: DataFrame, places: DataFrame, regions: DataFrame, virus: DataFrame, reach: int, p: Params = DEFAULT) -> DataFrame:
    """Support of the junctions: one row for each of their hits (side host or virus), with the junction's worth.

    (region_id, rev, PLACE, worth, side, qname, read_id, secondary, offset_start, offset_end, lclip, rclip, score, seq, suspicious)
    reach is the longest insert. Names that a junction has taken don't count for others, but its key may make another one.
    All keys are tried at once, and again only when they have lost names; in between, keys are kept or put back by
    rounds of joins, or in one task once there are at most LAST rows of keys and names.
    """
    least, spark = p.min_call_score, hits.sparkSession
    trials = Trials(hits, mates, places, regions, virus, reach, p)
    paths = {x: tables.place(spark) for x in ("support", "done", "used")}
    support = done = used = None
    names = tables.written(trials.hits.select(*KEY, "qname").distinct())
    unknown = {"first": F.lit(None).cast("long"), "second": F.lit(None).cast("long"), "valid": F.lit(False), "trial": F.lit(-1)}
    state = tables.written(E.region_scores(trials.hits).where(F.col("score") > least).select(F.col("region_id").cast("long").alias("region_id"), "rev", F.col("score").alias("worth")).withColumns(unknown))
    trial = 0
    while not state.isEmpty():
        found, new = trials.run(state.where("not valid"), used)
        support = tables.written(_with_key(new).withColumn("trial", F.lit(trial)), paths["support"])
        again = state.where("not valid").select(*KEY, "worth").join(found, KEY).withColumns({"valid": F.lit(True), "trial": F.lit(trial)})
        state = tables.written(state.where("valid").unionByName(again))
        trial += 1
        while True:
            takes = support.where("side = 'host'").select(*KEY, "trial", "qname").distinct().withColumn("takes", F.lit(True))
            rows = tables.written(names.join(state, KEY).join(takes, [*KEY, "trial", "qname"], "left").withColumn("takes", F.coalesce("takes", F.lit(False))))
            small_enough = rows.limit(LAST + 1).count() <= LAST
            if small_enough:
                outcome = rows.drop("trial").groupBy().applyInPandas(lambda g: decide(g, least), OUTCOME)
            else:
                outcome = _one_step(rows, least)
            outcome = tables.written(outcome)
            kept = tables.written(outcome.where("kept").join(state.select(*KEY, "trial"), KEY).select(*KEY, "trial", F.col("kept_worth").alias("worth")))
            moved = outcome.join(state.select(*KEY, F.col("worth").alias("old")), KEY).where("kept or worth <> old")
            stands = not small_enough and moved.isEmpty()
            left = outcome.select(*KEY, "worth").where(F.col("worth") > least).join(state.drop("worth"), KEY)
            if not kept.isEmpty():
                mine = support.join(kept, [*KEY, "trial"]).drop("trial")
                done = tables.written(mine, paths["done"])
                used = tables.written(mine.where("side = 'host'").select("qname").distinct(), paths["used"])
                touched = names.join(used, "qname", "left_semi").select(*KEY).distinct().withColumn("lost", F.lit(True))
                left = left.join(touched, KEY, "left").withColumn("valid", F.col("valid") & F.col("lost").isNull()).drop("lost")
                # a key is worth no more than the scores that are left to it, so a trial of one below the least would only drop it
                able = E.region_scores(trials.hits, used).where(F.col("score") > least)
                left = left.join(able.select(*KEY), KEY, "left_semi")
                left = tables.written(left)
                old, names = names, tables.written(names.join(used, "qname", "left_anti"))
                tables.drop(old)
            else:
                left = tables.written(left)
            state = left
            tables.drop(rows)
            if small_enough or stands or state.isEmpty():
                break
    return done if done is not None else spark.createDataFrame([], _schema(trials.hits))


def _with_key(support: DataFrame) -> DataFrame:
    """Rows of trials with the key and place in columns again."""
    rows = support.withColumnRenamed("region_id", "at").drop("rev", "lclip_quality", "rclip_quality")
    return rows.select(*[F.col(f"at.{c}").alias(c) for c in TRIAL], *[c for c in rows.columns if c != "at"])


def _schema(hits: DataFrame) -> str:
    region, read = (hits.schema[c].dataType.simpleString() for c in ("region_id", "read_id"))
    place = "v_contig string, v_start long, v_end long, v_rev boolean"
    return f"region_id {region}, rev boolean, {place}, qname string, read_id {read}, secondary boolean, offset_start long, offset_end long, lclip long, rclip long, score long, seq string, suspicious boolean, side string, worth long"


def junction_calls(support: DataFrame, regions: DataFrame, virus: DataFrame, reach: int, p: Params = DEFAULT) -> DataFrame:
    """One call for each junction of assign(), numbered by falling worth.

    regions: region_id, contig, start, length. (id, host_chr, host_rev, host_pos, virus_chr, virus_rev, virus_pos, reads, pairs,
    good_pairs, split_reads, score, pbs, coverage, region_id, rev, worth). Ends count from the starts of contigs; places on
    a virus are those of its first turn round where virus has original_length.
    """
    junction = [*KEY, *PLACE, "worth"]
    first = regions.select("region_id", F.col("contig").alias("host_chr"), F.col("start").cast("long").alias("host_start"))
    at = support.join(small(first), "region_id").withColumns(
        {
            "begin": F.when(F.col("side") == "host", F.col("host_start")).otherwise(F.col("v_start")),
            "back": F.when(F.col("side") == "host", F.col("rev")).otherwise(F.col("v_rev")),
            "last": F.when(F.col("side") == "host", F.col("offset_end")).otherwise(F.col("offset_end") + 1),
        }
    )
    ends = at.groupBy(*junction, "side").agg(F.min("offset_start").alias("low"), F.max("last").alias("high"))
    at = tables.written(at.join(ends, [*junction, "side"]))
    bp = F.when(F.col("back"), F.col("low")).otherwise(F.col("high"))
    reached = F.when(F.col("back"), F.col("offset_end") + F.col("rclip")).otherwise(F.col("offset_start") - F.col("lclip"))
    far = at.where("not secondary").groupBy(*junction, "qname", "side").agg(F.max(F.abs(reached - bp)).alias("far"))
    long_ = far.groupBy(*junction, "qname").agg((F.sum("far") > reach).alias("too_long"))
    at = at.join(long_, [*junction, "qname"], "left").withColumn("good", ~F.col("suspicious") & ~F.coalesce("too_long", F.lit(False)))
    at = tables.written(at)
    host = F.col("side") == "host"
    clip = F.when(F.col("rev"), F.col("lclip")).otherwise(F.col("rclip"))
    near = F.abs(F.when(F.col("rev"), F.col("offset_start")).otherwise(F.col("offset_end")) - bp) < p.max_clip_distance
    pos = lambda s: F.max(F.when(F.col("side") == s, F.col("begin") + bp))
    sums = at.groupBy(*junction, "host_chr").agg(
        pos("host").alias("host_pos"), pos("virus").alias("virus_pos"), F.count_if(host).alias("reads"), F.count_distinct(F.when(host, F.col("qname"))).alias("pairs"), F.count_distinct(F.when(host & F.col("good"), F.col("qname"))).alias("good_pairs"),
        F.count_if(host & (clip >= p.min_clip) & near).alias("split_reads"), F.coalesce(F.sum(F.when(host & F.col("good"), F.col("score"))), F.lit(0)).alias("score"),
        F.avg(F.when(host, F.col("score") / (F.col("offset_end") - F.col("offset_start") + 1))).alias("pbs"),
    )
    union = I.covered(at.where("good").withColumn("junction", F.struct(*junction, "side")), ["junction"], "offset_start", "offset_end", p.compat)
    share = union.groupBy(*[F.col(f"junction.{c}").alias(c) for c in junction]).agg((F.sum("covered") / (2.0 * reach)).alias("coverage"))
    met = sums.join(share, junction, "left").withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))
    if "original_length" in virus.columns:
        circle = virus.select(F.col("name").alias("v_contig"), "original_length")
        met = met.join(small(circle), "v_contig").withColumn("virus_pos", F.pmod("virus_pos", "original_length"))
    order = [F.desc("region_id"), F.desc("rev"), "v_contig", "v_start", "v_end", "v_rev"]
    numbered = E.dense_ids(met.withColumn("place", -F.col("worth")), "place", order, "id")
    return numbered.select(
        "id", "host_chr", F.col("rev").alias("host_rev"), "host_pos", F.col("v_contig").alias("virus_chr"), F.col("v_rev").alias("virus_rev"), "virus_pos",
        "reads", "pairs", "good_pairs", "split_reads", "score", "pbs", "coverage", "region_id", "worth",
    )
