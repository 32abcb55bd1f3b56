"""Queries of joins, routing and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import associate as A
from ..operators import calls as K
from ..operators import evidence as E
from ..operators import intervals as I
from ..operators import pairs as P
from ..operators import screen as SC
from pyspark.sql import window as W

from . import fixtures as X


def spaced_seed_screen(spark, sf):
    return SC.screen(X.reads(spark, sf), X.targets(spark, sf))


def shared_kmer_candidates(spark, sf):
    return A.shared_kmers(X.reads(spark, sf), X.targets(spark, sf))


def qname_semi_join(spark, sf):
    kept = X.hits(spark, sf).where("score > 65").select("qname").distinct()
    return X.hits(spark, sf).join(kept, "qname", "left_semi").groupBy("qname").agg(F.count("*").alias("reads"))


def mate_assembly(spark, sf):
    h = X.hits(spark, sf).where(S.primary(F.col("flag")))
    return P.assemble(h, "qname", "mate", ["pos", "quality"], ["pos", "quality", "offset_start"])


def inter_organism_pairs(spark, sf):
    h = X.hits(spark, sf).withColumn("is_virus", F.col("contig") == 4).withColumn("mate_is_virus", F.col("mate_contig") == 4)
    h = P.inter_organism(h.withColumn("seq", F.expr(X.SEQ)), F.col("is_virus"), F.col("mate_is_virus"))
    return h.groupBy("is_virus", "contig").agg(F.count("*").alias("reads"), F.count_distinct("qname").alias("names"))


def good_clip_join(spark, sf):
    h = X.hits(spark, sf)
    clips = h.where("secondary and lclip > 10").withColumn("clip_is_virus", F.col("contig") == 4)
    met = P.good_clips(h, clips, ["qname", "mate"], F.col("contig") == 4)
    return met.groupBy("qname", "mate").agg(F.count("*").alias("anchors"), F.max("clip_pos").alias("clip_pos"))


def clip_places(spark, sf):
    h = X.hits(spark, sf)
    gained = h.select("qname", "mate", "read_id", "pos", "contig", (F.col("lclip") > 8).alias("at_clip"))
    return P.at_clips(gained, h.where("rclip > 6"), ["qname", "mate"])


def relevant_reads(spark, sf):
    """Duplicates and host reads without any clip left out."""
    h = X.hits(spark, sf)
    clip = lambda c: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit("S"))).otherwise("")
    h = h.withColumn("cigar", F.concat(clip("lclip"), F.col("quality").cast("string"), F.lit("M"), clip("rclip")))
    return P.relevant(h, F.col("contig") >= 3).groupBy("contig").agg(F.count("*").alias("reads"), F.sum("pos").alias("places"))


def own_organism_regions(spark, sf):
    h = X.hits(spark, sf)
    return P.own_organism(h, h.where("contig < 3").select("contig")).groupBy("contig", "rev").agg(F.count("*").alias("reads"))


def place_order(spark, sf):
    """Reads in coordinate order, each with the place of the one before it in its contig."""
    h = X.hits(spark, sf).select("contig", "pos", "read_id", "score").distinct()
    w = W.Window.partitionBy("contig").orderBy("pos", "read_id", "score")
    return P.in_place_order(h.withColumn("before", F.coalesce(F.lag("pos").over(w), F.lit(-1))), tie=["read_id", "score"])


def rejected_pairing(spark, sf):
    """Accepted calls without a mate take rejected ones."""
    c = X.calls(spark, sf)
    accepted = c.where(K.verdict(60))
    return K.pair_rejected(accepted, c.where(~K.verdict(60)), K.pair_up(accepted))


def mate_branch(spark, sf):
    h = X.hits(spark, sf)
    found = P.route(h, h.where("contig = 1 and score > 40"), h.where("contig = 2 and score > 50"), "qname")
    return found.groupBy("mate_in", "contig").agg(F.count("*").alias("reads"))


def both_clipped(spark, sf):
    h = X.hits(spark, sf).where("lclip > 8 or rclip > 8").select("qname", (F.col("contig") >= 3).alias("is_virus"), (((F.col("mate") == 1) & (F.col("lclip") > 8)) | ((F.col("mate") == 2) & (F.col("rclip") > 8))).alias("towards"), "pos", "offset_start", "read_id")
    return P.reconcile(h, "qname", ["pos", "offset_start", "read_id"]).select("qname", "gains", F.col("anchor").cast("long").alias("anchor"), "at_clip", "secondary", "flipped")


def host_virus_mates(spark, sf):
    h = X.hits(spark, sf).where("not secondary")
    host = h.where("contig < 3").groupBy("qname").agg(F.max("pos").alias("host_pos"), F.max("score").alias("host_score"))
    virus = h.where("contig >= 3").groupBy("qname").agg(F.max("pos").alias("virus_pos"), F.max("score").alias("virus_score"))
    return host.join(virus, "qname")


def used_read_anti_join(spark, sf):
    h = X.hits(spark, sf)
    return E.region_scores(h, h.where("score > 68"))


def interval_overlap_join(spark, sf):
    a = X.anchors(spark, sf)
    reach = a.withColumn("end", F.col("start") + F.pmod("id", F.lit(40)))
    clicks, others = reach.where("strand = 'F'"), reach.where("strand = 'R'")
    return I.overlap_join(clicks, others, ["contig"], 128)


def near_anchor_join(spark, sf):
    a = X.anchors(spark, sf).withColumn("end", F.col("start") + F.pmod("id", F.lit(30)))
    found = I.near_anchor_join(a, 9, 128)
    return found.groupBy("contig", "strand").agg(F.count("*").alias("pairs"), F.sum("a_id").alias("sum_a"), F.sum("b_id").alias("sum_b"))


def call_nearest_mate(spark, sf):
    return K.nearest_mate(X.calls(spark, sf))


def mask_lookup(spark, sf):
    h = X.hits(spark, sf)
    masks = h.where("score > 30").select((F.col("qname") % 500).alias("call_id"), F.when(F.col("rev"), "host").otherwise("virus").alias("side"), F.col("offset_start").alias("start"), F.col("offset_end").alias("end"), F.struct("read_id", "offset_start", "offset_end").alias("place"))
    c = X.calls(spark, sf).select("id", "good_pairs")
    return K.with_masks(c, masks, "place").select("id", "good_pairs", "host_masked", "virus_masked")


def realignment_dump(spark, sf):
    """The realignments of all names."""
    h = X.hits(spark, sf).select("region_id", "read_id", "rev", "offset_start", "score")
    return A.lookup(h, X.hits(spark, sf).select("read_id", "qname").distinct()).select("region_id", "qname", "read_id", "rev", "offset_start", "score")


def realignment_lookup(spark, sf):
    h = X.hits(spark, sf).select("region_id", "read_id", "rev", "offset_start", "score")
    names = X.hits(spark, sf).select("read_id", "qname").distinct()
    return A.lookup(h, names, 7).select("region_id", "qname", "read_id", "rev", "offset_start", "score")


def union_samples(spark, sf):
    h = X.hits(spark, sf)
    parts = [h.where(F.col("sample") == i).select("qname", F.lit(i).cast("long").alias("bf")) for i in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("bf").agg(F.count("*").alias("reads"), F.count_distinct("qname").alias("names"))


def set_operations(spark, sf):
    h = X.hits(spark, sf)
    a, b = h.where("score > 50").select("qname"), h.where("lclip > 10").select("qname")
    both, only = a.intersect(b).withColumn("kind", F.lit("both")), a.subtract(b).withColumn("kind", F.lit("only"))
    return both.unionByName(only).groupBy("kind").agg(F.count("*").alias("n"), F.sum("qname").alias("total"))


QUERIES = {f.__name__: f for f in (spaced_seed_screen, shared_kmer_candidates, qname_semi_join, mate_assembly, inter_organism_pairs, good_clip_join, clip_places, relevant_reads, own_organism_regions, place_order, rejected_pairing, realignment_dump, mate_branch, both_clipped, host_virus_mates, used_read_anti_join, interval_overlap_join, near_anchor_join, call_nearest_mate, mask_lookup, realignment_lookup, union_samples, set_operations)}

_RC = "reverse(translate(seq, 'ACGT', 'TGCA'))"
_AT = lambda k: f"unnest(generate_series(1, length(seq) - {k - 1})) AS t(i)"
_SEED = "substr(kmer, 1, CAST(15 - 3 * j AS INTEGER)) || substr(kmer, CAST(19 - 3 * j AS INTEGER), CAST(3 * j AS INTEGER))"
_MOST = lambda x: "greatest({0})".format(", ".join(f"length({x}) - length(replace({x}, '{b}', ''))" for b in "ACGT"))
_TOWARDS = "((mate = 1 AND lclip > 8) OR (mate = 2 AND rclip > 8))"

ORACLES = {
    "spaced_seed_screen": f"""WITH {X.READS}, {X.TARGETS}, both_ways AS (SELECT seq FROM targets UNION ALL SELECT {_RC} FROM targets),
        tk AS (SELECT DISTINCT substr(seq, CAST(i AS INTEGER), 18) AS kmer FROM both_ways, {_AT(18)}),
        seeds AS (SELECT DISTINCT j, seed FROM (SELECT j, {_SEED} AS seed FROM tk, unnest(generate_series(0, 5)) AS u(j)) WHERE {_MOST('seed')} < 13),
        rk AS (SELECT read_id, i AS pos, substr(seq, CAST(i AS INTEGER), 18) AS kmer FROM reads, {_AT(18)}),
        dk AS (SELECT DISTINCT kmer FROM rk),
        hit AS (SELECT DISTINCT kmer FROM (SELECT kmer, j, {_SEED} AS seed FROM dk, unnest(generate_series(0, 5)) AS u(j)) JOIN seeds USING (j, seed))
        SELECT read_id, count(*) AS hits FROM rk JOIN hit USING (kmer) GROUP BY read_id HAVING count(*) >= 2""",
    "shared_kmer_candidates": f"""WITH {X.READS}, {X.TARGETS}, both_ways AS (SELECT read_id, false AS rc, seq FROM reads UNION ALL SELECT read_id, true, {_RC} FROM reads),
        rk AS (SELECT read_id, rc, i AS pos, substr(seq, CAST(i AS INTEGER), 13) AS kmer FROM both_ways, {_AT(13)}),
        tk AS (SELECT DISTINCT region_id, substr(seq, CAST(i AS INTEGER), 13) AS kmer FROM targets, {_AT(13)})
        SELECT read_id, region_id, rc FROM rk JOIN (SELECT * FROM tk WHERE {_MOST('kmer')} < 11) USING (kmer) GROUP BY ALL HAVING max(pos) - min(pos) >= 13""",
    "qname_semi_join": f"WITH {X.HITS} SELECT qname, count(*) AS reads FROM hits WHERE qname IN (SELECT qname FROM hits WHERE score > 65) GROUP BY qname",
    "mate_assembly": f"""WITH {X.HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY qname, mate ORDER BY pos DESC, quality DESC, offset_start DESC) AS n FROM hits WHERE flag & 2304 = 0)
        SELECT a.qname, a.pos AS pos1, a.quality AS quality1, b.pos AS pos2, b.quality AS quality2 FROM r a JOIN r b ON a.qname = b.qname AND a.mate = 1 AND b.mate = 2 AND a.n = 1 AND b.n = 1""",
    "inter_organism_pairs": f"""WITH {X.HITS} SELECT contig = 4 AS is_virus, contig, count(*) AS reads, count(DISTINCT qname) AS names FROM hits
        WHERE flag & 12 = 0 AND (contig <> mate_contig OR abs(isize) > 100000) AND (contig = 4) <> (mate_contig = 4)
        AND NOT {_MOST(X.SEQ)} >= 0.8 * length({X.SEQ}) GROUP BY ALL""",
    "clip_places": f"""WITH {X.HITS}, c AS (SELECT *, row_number() OVER (PARTITION BY qname, mate ORDER BY pos DESC, contig DESC) AS n FROM hits WHERE rclip > 6)
        SELECT h.qname, h.mate, h.read_id, CASE WHEN h.lclip > 8 THEN c.pos ELSE h.pos END AS pos, CASE WHEN h.lclip > 8 THEN c.contig ELSE h.contig END AS contig, h.lclip > 8 AS at_clip
        FROM hits h LEFT JOIN c ON c.n = 1 AND c.qname = h.qname AND c.mate = h.mate WHERE NOT h.lclip > 8 OR c.n = 1""",
    "relevant_reads": f"WITH {X.HITS} SELECT contig, count(*) AS reads, CAST(sum(pos) AS BIGINT) AS places FROM hits WHERE flag & 1024 = 0 AND (contig >= 3 OR lclip > 0 OR rclip > 0) GROUP BY contig",
    "own_organism_regions": f"WITH {X.HITS} SELECT contig, rev, count(*) AS reads FROM hits WHERE contig < 3 GROUP BY contig, rev",
    "place_order": f"WITH {X.HITS}, d AS (SELECT DISTINCT contig, pos, read_id, score FROM hits) SELECT *, coalesce(lag(pos) OVER (PARTITION BY contig ORDER BY pos, read_id, score), -1) AS before FROM d",
    "realignment_dump": f"WITH {X.HITS}, names AS (SELECT DISTINCT read_id, qname FROM hits) SELECT region_id, n.qname, read_id, rev, offset_start, score FROM hits h JOIN names n USING (read_id)",
    "good_clip_join": f"""WITH {X.HITS}, c AS (SELECT *, row_number() OVER (PARTITION BY qname, mate ORDER BY pos DESC, contig DESC) AS n FROM hits WHERE secondary AND lclip > 10)
        SELECT h.qname, h.mate, count(*) AS anchors, max(c.pos) AS clip_pos FROM hits h JOIN c ON c.n = 1 AND c.qname = h.qname AND c.mate = h.mate WHERE (c.contig = 4) <> (h.contig = 4) GROUP BY ALL""",
    "mate_branch": f"""WITH {X.HITS} SELECT CASE WHEN qname IN (SELECT qname FROM hits WHERE contig = 1 AND score > 40) THEN 'host' WHEN qname IN (SELECT qname FROM hits WHERE contig = 2 AND score > 50) THEN 'virus' ELSE 'none' END AS mate_in,
        contig, count(*) AS reads FROM hits GROUP BY ALL""",
    "both_clipped": f"""WITH {X.HITS}, a AS (SELECT qname, contig >= 3 AS v, {_TOWARDS} AS t, row_number() OVER (PARTITION BY qname ORDER BY contig >= 3, pos, offset_start, read_id) AS i, count(*) OVER (PARTITION BY qname) AS n FROM hits WHERE lclip > 8 OR rclip > 8),
        w AS (SELECT x.qname, x.v AS v1, y.v AS v2, x.t AS t1, y.t AS t2 FROM a x JOIN a y ON x.qname = y.qname AND x.n = 2 AND x.i = 1 AND y.i = 2)
        SELECT qname, 'host' AS gains, 1 AS anchor, false AS at_clip, false AS secondary, false AS flipped FROM w WHERE v1 <> v2
        UNION ALL SELECT qname, 'host', 2, false, true, t2 FROM w WHERE v1 <> v2 UNION ALL SELECT qname, 'virus', 2, false, false, false FROM w WHERE v1 <> v2
        UNION ALL SELECT qname, 'host', CASE WHEN t1 THEN 1 ELSE 2 END, false, false, false FROM w WHERE NOT v1 AND NOT v2
        UNION ALL SELECT qname, 'host', CASE WHEN t1 THEN 2 ELSE 1 END, false, true, true FROM w WHERE NOT v1 AND NOT v2
        UNION ALL SELECT qname, 'virus', CASE WHEN t1 THEN 2 ELSE 1 END, true, false, false FROM w WHERE NOT v1 AND NOT v2
        UNION ALL SELECT qname, 'host', CASE WHEN t1 THEN 2 ELSE 1 END, true, false, false FROM w WHERE v1 AND v2
        UNION ALL SELECT qname, 'host', CASE WHEN t1 THEN 1 ELSE 2 END, false, true, true FROM w WHERE v1 AND v2
        UNION ALL SELECT qname, 'virus', CASE WHEN t1 THEN 1 ELSE 2 END, false, false, false FROM w WHERE v1 AND v2""",
    "host_virus_mates": f"""WITH {X.HITS}, p AS (SELECT * FROM hits WHERE NOT secondary)
        SELECT qname, max(CASE WHEN contig < 3 THEN pos END) AS host_pos, max(CASE WHEN contig < 3 THEN score END) AS host_score, max(CASE WHEN contig >= 3 THEN pos END) AS virus_pos, max(CASE WHEN contig >= 3 THEN score END) AS virus_score
        FROM p GROUP BY qname HAVING count(CASE WHEN contig < 3 THEN 1 END) > 0 AND count(CASE WHEN contig >= 3 THEN 1 END) > 0""",
    "used_read_anti_join": f"WITH {X.HITS} SELECT region_id, rev, CAST(sum(score) AS BIGINT) AS score, count(*) AS reads FROM hits WHERE qname NOT IN (SELECT qname FROM hits WHERE score > 68) GROUP BY ALL",
    "interval_overlap_join": f"""WITH {X.ANCHORS}, r AS (SELECT id, contig, strand, start, start + id % 40 AS e FROM anchors)
        SELECT a.contig, a.id AS a_id, b.id AS b_id FROM r a JOIN r b ON a.contig = b.contig AND a.strand = 'F' AND b.strand = 'R' AND a.start <= b.e AND b.start <= a.e""",
    "near_anchor_join": f"""WITH {X.ANCHORS}, r AS (SELECT id, contig, strand, start, start + id % 30 AS e FROM anchors)
        SELECT a.contig, a.strand, count(*) AS pairs, CAST(sum(a.id) AS BIGINT) AS sum_a, CAST(sum(b.id) AS BIGINT) AS sum_b FROM r a JOIN r b ON a.contig = b.contig AND a.strand = b.strand AND a.id <> b.id AND b.start BETWEEN a.start AND a.e + 9 GROUP BY ALL""",
    "call_nearest_mate": f"""WITH {X.CALLS}, m AS (SELECT a.id AS i, b.id AS j, CASE WHEN a.host_rev THEN a.host_pos - b.host_pos ELSE b.host_pos - a.host_pos END AS distance
        FROM calls a JOIN calls b ON a.id < b.id AND a.host_chr = b.host_chr AND a.host_rev <> b.host_rev AND a.virus_rev <> b.virus_rev),
        n AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY abs(distance), j) AS n FROM m WHERE distance BETWEEN -50 AND 1000) SELECT i, j, distance FROM n WHERE n = 1""",
    "mask_lookup": f"""WITH {X.HITS}, {X.CALLS}, m AS (SELECT qname % 500 AS call_id, rev, offset_end - offset_start + 1 AS masked, row_number() OVER (PARTITION BY qname % 500, rev ORDER BY read_id DESC, offset_start DESC, offset_end DESC) AS n FROM hits WHERE score > 30)
        SELECT id, good_pairs, coalesce(h.masked, 0) AS host_masked, coalesce(v.masked, 0) AS virus_masked FROM calls LEFT JOIN m h ON h.call_id = id AND h.rev AND h.n = 1 LEFT JOIN m v ON v.call_id = id AND NOT v.rev AND v.n = 1""",
    "realignment_lookup": f"WITH {X.HITS}, names AS (SELECT DISTINCT read_id, qname FROM hits) SELECT region_id, n.qname, read_id, rev, offset_start, score FROM hits h JOIN names n USING (read_id) WHERE n.qname = 7",
    "union_samples": f"WITH {X.HITS} SELECT sample AS bf, count(*) AS reads, count(DISTINCT qname) AS names FROM hits GROUP BY sample",
    "set_operations": f"""WITH {X.HITS}, a AS (SELECT DISTINCT qname FROM hits WHERE score > 50), b AS (SELECT DISTINCT qname FROM hits WHERE lclip > 10)
        SELECT CASE WHEN qname IN (SELECT qname FROM b) THEN 'both' ELSE 'only' END AS kind, count(*) AS n, CAST(sum(qname) AS BIGINT) AS total FROM a GROUP BY kind""",
}
