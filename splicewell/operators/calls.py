"""Calls: acceptance, pairing, redundancy, text."""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..functions.alignment import local_alignment
from ..params import DEFAULT, Params
from . import tables
from .intervals import marked


def verdict(read_len: int, p: Params = DEFAULT, accept_all_clipped: bool = False) -> Column:
    """Whether a call stands; the rules apply in this order and later ones override."""
    pairs, splits = F.col("good_pairs"), F.col("split_reads")
    pbs = F.col("pbs") if p.compat else F.coalesce("pbs", F.lit(0.0))
    ok = F.coalesce(pbs >= p.min_pbs, F.lit(p.compat))
    ok = ok & ~((pairs < p.min_pairs - 1) | ((pairs == p.min_pairs - 1) & (splits == 0)))
    ok = ok & (F.col("host_len") >= read_len // 2) & (F.col("virus_len") >= read_len // 2)
    ok = ok | ((F.col("coverage") >= p.min_coverage) & (pairs > 2))
    if accept_all_clipped:
        ok = ok | (splits > 0)
    masked = (F.col("host_masked") > p.max_masked * F.col("host_len")) | (F.col("virus_masked") > p.max_masked * F.col("virus_len"))
    return ok & ~masked


def masked_length(masks: DataFrame, order: str) -> DataFrame:
    """(call_id, side, masked): length of the last interval of each sequence, end included."""
    return masks.groupBy("call_id", "side").agg(F.max_by(F.col("end") - F.col("start") + 1, order).cast("long").alias("masked"))


def with_masks(calls: DataFrame, masks: DataFrame, order: str) -> DataFrame:
    """Adds host_masked and virus_masked, 0 where there is no mask."""
    wide = masked_length(masks, order).groupBy("call_id").pivot("side", ["host", "virus"]).agg(F.first("masked"))
    met = calls.join(wide.select(F.col("call_id").alias("id"), F.col("host").alias("hm"), F.col("virus").alias("vm")), "id", "left")
    return met.withColumn("host_masked", F.coalesce("hm", F.lit(0))).withColumn("virus_masked", F.coalesce("vm", F.lit(0))).drop("hm", "vm")


def mate_candidates(calls: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(i, j, distance), i before j, of the calls that may be two ends of one insertion.

    Calls meet only within bins of the allowed distance on the same host contig.
    """
    width = p.mate_to - p.mate_from + 1
    fields = ["id", "host_chr", "host_rev", "host_pos", "virus_rev"]
    a = calls.select(F.struct(*fields).alias("a"), "host_chr", F.explode(F.array(*[F.floor(F.col("host_pos") / width) + d for d in (-1, 0, 1)])).alias("bin"))
    b = calls.select(F.struct(*fields).alias("b"), "host_chr", F.floor(F.col("host_pos") / width).alias("bin"))
    met = a.join(b, ["host_chr", "bin"]).where(F.col("a.id") < F.col("b.id"))
    d = S.pair_distance(F.col("a"), F.col("b"), p.mate_from, p.mate_to)
    return met.select(F.col("a.id").alias("i"), F.col("b.id").alias("j"), d.cast("long").alias("distance")).where("distance is not null")


def _in_turn(rows: pd.DataFrame, p: Params, later: bool, take: bool, once: bool) -> list[tuple[int, int, int]]:
    """(i, j, distance): in order of id, each seeking row (not offered) gets the nearest row on offer, the smallest id of equal ones.

    later: only ids behind its own; take: what one got is gone for the others; once: who was taken gets none.
    What is on offer lies in queues by position, each in order of id; what is at the head and no longer to be had is
    dropped, and empty positions are skipped by links to the next ones that aren't. So no pairs are listed.
    """
    names, number = np.unique(rows["id"].to_numpy(dtype=np.int64), return_inverse=True)
    pos, way = rows["host_pos"].to_numpy(dtype=np.int64), (2 * rows["host_rev"] + rows["virus_rev"]).to_numpy(dtype=np.int64)
    offered, gone = rows["offered"].to_numpy(dtype=bool), bytearray(len(names))
    pools = {}
    for w in range(4):
        mine = np.flatnonzero(offered & (way == w))
        mine = mine[np.lexsort((number[mine], pos[mine]))]
        places, first = np.unique(pos[mine], return_index=True)
        ends = np.append(first[1:], len(mine)).tolist()
        pools[w] = (places.tolist(), number[mine].tolist(), first.tolist(), ends, list(range(len(places) + 1)), list(range(len(places) + 1)))

    def near(at: int, i: int, pool: tuple, links: list[int], step: int) -> int:
        """The first place from at on that has something for i; links are shortened on the way. Places count from 1 in links to the left."""
        _, queue, head, ends, _, _ = pool
        passed = []
        while 0 <= at - (step < 0) < len(head):
            if links[at] != at:
                passed.append(at)
                at = links[at]
                continue
            k = at - (step < 0)
            while head[k] < ends[k] and (gone[queue[head[k]]] or (later and queue[head[k]] <= i)):
                head[k] += 1
            if head[k] < ends[k]:
                break
            links[at] = at + step
        for x in passed:
            links[x] = at
        return at - (step < 0)

    out: list[tuple[int, int, int]] = []
    seek = np.flatnonzero(~offered)
    seek = seek[np.argsort(number[seek], kind="stable")]
    last, best = None, None

    def settle() -> None:
        if best:
            out.append((last, best[1], best[2]))
            if take:
                gone[best[1]] = 1

    for i, x, w in zip(number[seek].tolist(), pos[seek].tolist(), way[seek].tolist(), strict=True):
        if i != last:
            settle()
            last, best = i, None
        if once and gone[i]:
            continue
        sign = -1 if w >= 2 else 1
        low, high = sorted((x + sign * p.mate_from, x + sign * p.mate_to))
        pool = pools[3 - w]
        places, queue, head = pool[:3]
        k = near(bisect.bisect_left(places, max(x, low)), i, pool, pool[4], 1)
        if k < len(places) and places[k] <= high:
            found = (abs(places[k] - x), queue[head[k]], sign * (places[k] - x))
            best = min(best, found) if best else found
        k = near(bisect.bisect_right(places, min(x - 1, high)), i, pool, pool[5], -1)
        if k >= 0 and places[k] >= low:
            found = (abs(places[k] - x), queue[head[k]], sign * (places[k] - x))
            best = min(best, found) if best else found
    settle()
    return [(int(names[i]), int(names[j]), d) for i, j, d in out]


FIELDS = ["id", "host_chr", "host_rev", "host_pos", "virus_rev"]


def _met(seeking: DataFrame, offered: DataFrame, by: list[str], p: Params, later: bool, take: bool, once: bool = False) -> DataFrame:
    """(i, j, distance) of _in_turn(), apart for each host contig, value of by and direction. Rows with a null field never meet."""

    def side(df: DataFrame, offer: bool) -> DataFrame:
        r, v = (F.col(c).cast("int") for c in ("host_rev", "virus_rev"))
        # who takes and who is taken are told apart, unless one can be both
        way = F.when(F.col("host_rev") == F.col("virus_rev"), 0).otherwise(1) if once else (3 - 2 * r - v if offer else 2 * r + v)
        whole = df.dropna(subset=FIELDS)
        return whole.select("host_chr", *by, way.alias("way"), F.col("id").cast("long").alias("id"), F.col("host_pos").cast("long").alias("host_pos"), "host_rev", "virus_rev", F.lit(offer).alias("offered"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_in_turn(pdf, p, later, take, once), columns=["i", "j", "distance"])

    return side(seeking, False).unionByName(side(offered, True)).groupBy("host_chr", *by, "way").applyInPandas(one, "i long, j long, distance long")


def nearest_mate(calls: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(i, j, distance): of each call the nearest later one, the first of equal ones.

    Calls on offer go to their bin and its neighbours; nothing is paired but what is nearest.
    """
    width = p.mate_to - p.mate_from + 1
    here = F.floor(F.col("host_pos") / width)
    offered = calls.select(*FIELDS, F.explode(F.array(*[here + d for d in (-1, 0, 1)])).alias("bin"))
    found = _met(calls.select(*FIELDS, here.alias("bin")), offered, ["bin"], p, later=True, take=False)
    best = found.groupBy("i").agg(F.min(F.struct(F.abs("distance").alias("far"), "j", "distance")).alias("best"))
    return best.select("i", "best.j", "best.distance")


def _by_chain(seeking: DataFrame, offered: DataFrame, p: Params, later: bool, once: bool) -> DataFrame:
    """(i, j): in order of id, each seeking call takes its nearest free one on offer.

    Calls further apart than mates may be never meet, so chains of calls between such gaps are dealt to tasks, by direction.
    """
    reach = max(abs(p.mate_from), abs(p.mate_to))
    ends = seeking.select("host_chr", "host_pos").unionByName(offered.select("host_chr", "host_pos")).dropna()
    marks = tables.written(marked(ends, ["host_chr"], "host_pos", "host_pos", reach).select("host_chr", F.col("start").alias("host_pos"), "island"))
    at = [df.select(*FIELDS).join(marks, ["host_chr", "host_pos"]) for df in (seeking, offered)]
    return _met(*at, ["island"], p, later, True, once).select("i", "j")


def pair_up(calls: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(id, paired_with): calls in order of id take the nearest later one that is free, the first of equal ones.

    In compat mode a call that was taken by an earlier one still takes a later one, and then names that as its mate; so
    pairs need not be mutual. Else each call is in one pair.
    """
    calls = tables.written(calls.select(*FIELDS))
    found = tables.written(_by_chain(calls, calls, p, later=True, once=not p.compat))
    ends = F.inline(F.array(F.struct(F.col("i").alias("id"), F.col("j").alias("paired_with"), F.lit(1).alias("own")), F.struct(F.col("j").alias("id"), F.col("i").alias("paired_with"), F.lit(0).alias("own"))))
    return found.select(ends).groupBy("id").agg(F.max_by("paired_with", "own").alias("paired_with"))


def pair_rejected(accepted: DataFrame, rejected: DataFrame, paired: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(id, paired_with) of the rejected calls that mate accepted ones left without a mate.

    Accepted calls take, in order of id, the nearest free rejected call, the first of equal ones.
    """
    lone = tables.written(accepted.join(paired.select("id"), "id", "left_anti").select(*FIELDS))
    found = _by_chain(lone, tables.written(rejected.select(*FIELDS)), p, later=False, once=False)
    return found.select(F.col("j").alias("id"), F.col("i").alias("paired_with"))


def redundant(consensus: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Ids of the calls whose both consensus sequences are covered by those of an earlier call.

    consensus: id, host_seq, virus_seq, host_rev, virus_rev. Candidates share k-mers on both sides; the
    shorter sequence of a pair is aligned to the longer one, turned round where the strands differ.
    """
    k = p.assoc_k
    both = F.explode(F.array(F.lit("host"), F.lit("virus"))).alias("side")
    long_ = consensus.select("id", both, "host_seq", "virus_seq").withColumn("seq", F.when(F.col("side") == "host", F.col("host_seq")).otherwise(F.col("virus_seq")))
    canonical = F.explode(F.array_distinct(F.transform(S.kmers(F.col("seq"), k), lambda x: F.least(x, S.reverse_complement(x)))))
    index = long_.select("id", "side", canonical.alias("kmer"))
    met = index.alias("a").join(index.alias("b"), ["side", "kmer"]).where("a.id < b.id").select("side", F.col("a.id").alias("i"), F.col("b.id").alias("j")).distinct()
    pairs = met.groupBy("i", "j").agg(F.count("*").alias("sides")).where("sides = 2").select("i", "j")
    a = consensus.select(*[F.col(c).alias(f"{c}_i") for c in ("id", "host_seq", "virus_seq", "host_rev", "virus_rev")])
    b = consensus.select(*[F.col(c).alias(f"{c}_j") for c in ("id", "host_seq", "virus_seq", "host_rev", "virus_rev")])
    pairs = pairs.join(a, F.col("i") == F.col("id_i")).join(b, F.col("j") == F.col("id_j"))
    for side in ("host", "virus"):
        turned = F.when(F.col(f"{side}_rev_i") == F.col(f"{side}_rev_j"), F.col(f"{side}_seq_j")).otherwise(S.reverse_complement(F.col(f"{side}_seq_j")))
        one, two = F.col(f"{side}_seq_i"), turned
        short = F.when(F.length(one) <= F.length(two), one).otherwise(two)
        long = F.when(F.length(one) <= F.length(two), two).otherwise(one)
        pairs = pairs.withColumn(f"{side}_short", short).withColumn(f"{side}_long", long)
    for side in ("host", "virus"):
        found = local_alignment(F.col(f"{side}_short"), F.col(f"{side}_long"), p)
        pairs = pairs.withColumn(f"{side}_found", found)
        pairs = pairs.where((F.col(f"{side}_found.score") > 0) & (F.col(f"{side}_found.query_end") - F.col(f"{side}_found.query_begin") >= p.redundancy * F.length(f"{side}_short")))
    return pairs.select(F.col("j").alias("id")).distinct()


def machine_text() -> Column:
    """The call as a line of 13 fields."""
    fields = ["id", "host_bp", "virus_bp", "reads", "good_pairs", "split_reads", "score", "host_pbs", "virus_pbs", "reads_w_dups", "unique_reads_w_dups", "host_cov", "virus_cov"]
    kinds = {"host_pbs": "%f", "virus_pbs": "%f", "host_cov": "%f", "virus_cov": "%f", "host_bp": "%s", "virus_bp": "%s"}
    return F.format_string(" ".join(kinds.get(f, "%d") for f in fields), *[F.col(f) for f in fields])


def parse_machine_text(line: Column) -> Column:
    part = F.split(line, " ")
    ints = {"id": 0, "reads": 3, "good_pairs": 4, "split_reads": 5, "score": 6, "reads_w_dups": 9, "unique_reads_w_dups": 10}
    doubles = {"host_pbs": 7, "virus_pbs": 8, "host_cov": 11, "virus_cov": 12}
    return F.struct(
        S.breakpoint_parse(part[1]).alias("host_bp"),
        S.breakpoint_parse(part[2]).alias("virus_bp"),
        *[part[i].cast("int").alias(k) for k, i in ints.items()],
        *[part[i].cast("double").alias(k) for k, i in doubles.items()],
    )


def human_text() -> Column:
    """The call for readers."""
    coverage = (F.col("host_cov") + F.col("virus_cov")) / 2
    mate = F.when(F.col("paired_with").isNotNull(), F.format_string(" PAIRED WITH ID=%d", F.col("paired_with"))).otherwise("")
    line = F.format_string("ID=%d %s %s SUPPORTING_PAIRS=%d SPLIT_READS=%d HOST_PBS=%f COVERAGE=%f", "id", "host", "virus", "good_pairs", "split_reads", "host_pbs", coverage)
    return F.concat(line, mate)


def alternative_loci(records: DataFrame) -> DataFrame:
    """One line for each place of the records (id, dir, reverse, contig, start, end, query_len, alternatives) that have others."""
    minus = (F.col("reverse") & (F.col("dir") == "R")) | (~F.col("reverse") & (F.col("dir") == "L"))
    own = F.struct(F.col("contig").alias("contig"), F.when(minus, "-").otherwise("+").alias("strand"), F.when(minus, F.col("start")).otherwise(F.col("end")).cast("long").alias("pos"))
    other = F.transform("alternatives", lambda x: F.struct(x["contig"].alias("contig"), x["strand"].alias("strand"), (x["pos"] + F.when(x["strand"] == "+", F.col("query_len")).otherwise(0)).cast("long").alias("pos")))
    at = records.where(F.size("alternatives") > 0).select("id", F.explode(F.concat(F.array(own), other)).alias("at"))
    return at.select("id", F.concat(F.lit("ID="), F.col("id").cast("string"), F.lit(" "), F.col("at.contig"), F.lit(":"), F.col("at.strand"), F.col("at.pos").cast("string")).alias("line"))
