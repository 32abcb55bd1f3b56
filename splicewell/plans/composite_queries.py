"""Queries that plain SQL doesn't express: alignment, clustering, pairing, redundancy, assignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.alignment import local_alignment
from ..operators import associate as A
from ..operators import calls as K
from ..operators import consensus as N
from ..operators import intervals as I
from ..operators.assign import assign
from ..operators.mismatch import mismatching
from . import fixtures as X


def interval_clusters(spark, sf):
    a = X.anchors(spark, sf).withColumn("end", F.col("start") + F.pmod("id", F.lit(60)))
    return I.clusters(a, 400)


def _passages(spark, sf):
    """Every benchmark text as passages of 150 symbols, and those as reads."""
    t = X.targets(spark, sf).select("region_id", F.explode(F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / 100))).alias("n"), "seq")
    return t.select((F.col("region_id") * 100_000 + F.col("n")).alias("read_id"), F.substring(F.col("seq"), (F.col("n") * 100 + 1).cast("int"), F.lit(150)).alias("seq"))


def read_region_association(spark, sf):
    return A.realign(_passages(spark, sf), X.targets(spark, sf))


def local_alignment_scores(spark, sf):
    p = _passages(spark, sf)
    pairs = p.alias("a").join(p.alias("b"), F.col("b.read_id") == F.col("a.read_id") + 1).select("a.read_id", F.col("a.seq").alias("query"), F.col("b.seq").alias("ref"))
    return pairs.withColumn("found", local_alignment(F.col("query"), F.col("ref"))).select("read_id", "found.*")


def call_pairing(spark, sf):
    return K.pair_up(X.calls(spark, sf))


def redundant_calls(spark, sf):
    """Passages as calls, and every third of them once more, turned round and with some bases changed."""
    p = _passages(spark, sf)
    again = p.where("read_id % 3 = 0").select((F.col("read_id") + 1_000_000_000).alias("read_id"), F.regexp_replace("seq", "ACGTA", "ACCTA").alias("seq"))
    p = p.unionByName(again)
    c = p.select(F.col("read_id").alias("id"), F.col("seq").alias("host_seq"), F.reverse("seq").alias("virus_seq"), (F.col("read_id") % 2 == 0).alias("host_rev"), F.lit(False).alias("virus_rev"))
    return K.redundant(c)


def greedy_assignment(spark, sf):
    """Read names to junctions: hits of host regions met with those of virus regions."""
    h = X.hits(spark, sf)
    host = h.where("contig < 3 and score > 25").groupBy(F.col("region_id").cast("long").alias("region_id"), "rev", F.col("qname").cast("string").alias("qname")).agg(F.max("score").alias("h_score"))
    virus = h.where("contig >= 3 and score > 25").groupBy(F.col("region_id").cast("long").alias("virus_region"), F.col("rev").alias("virus_rev"), F.col("qname").cast("string").alias("qname")).agg(F.max("score").alias("v_score"))
    return assign(host.join(virus, "qname").select("region_id", "rev", "virus_region", "virus_rev", "qname", "h_score", "v_score"))


def call_consensus(spark, sf):
    """Each benchmark text rebuilt from its own passages."""
    t = X.targets(spark, sf)
    support = _passages(spark, sf).select(F.floor(F.col("read_id") / 100_000).cast("long").alias("call_id"), F.lit("host").alias("side"), (F.col("read_id") % 100_000 * 100).alias("pos"), "seq", F.concat(F.length("seq").cast("string"), F.lit("M")).alias("cigar"))
    windows = t.select(F.col("region_id").alias("call_id"), F.lit("host").alias("side"), F.lit(0).alias("start"), F.length("seq").alias("end"), F.col("seq").alias("reference"))
    return N.call_consensus(support, windows)


def low_complexity_masks(spark, sf):
    return N.low_complexity_masks(X.reads(spark, sf), "read_id", "seq", threshold=6.0)


def joint_rescore(spark, sf):
    """Passages re-aligned to the joined halves of their texts."""
    t = X.targets(spark, sf).withColumn("cut", F.floor(F.length("seq") / 2).cast("int"))
    half = lambda side, part: t.select(F.col("region_id").alias("call_id"), F.lit(side).alias("side"), part.alias("seq"))
    consensus = half("host", F.substring(F.col("seq"), F.lit(1), F.col("cut"))).union(half("virus", F.substring(F.col("seq"), F.col("cut") + 1, F.length("seq"))))
    calls = t.select(F.col("region_id").alias("id"), F.lit(False).alias("host_rev"), F.lit(True).alias("virus_rev"))
    reads = _passages(spark, sf).withColumn("call_id", F.floor(F.col("read_id") / 100_000).cast("long"))
    reads = reads.select("call_id", F.concat(F.lit("q"), F.floor(F.col("read_id") / 2).cast("string")).alias("qname"), F.when(F.col("read_id") % 2 == 0, "host").otherwise("virus").alias("side"), "seq")
    return N.rescore(reads, consensus, calls, 700)


def mismatch_filter(spark, sf):
    """Passages laid on their texts, every seventh of them turned round: those disagree with the others."""
    p = _passages(spark, sf)
    odd = F.when(F.col("read_id") % 7 == 6, F.reverse("seq")).otherwise(F.col("seq"))
    hits = p.select(F.floor(F.col("read_id") / 100_000).cast("long").alias("region_id"), F.lit(False).alias("rev"), F.col("read_id").cast("string").alias("qname"), (F.col("read_id") % 100_000 * 100).alias("offset_start"), (F.col("read_id") % 100_000 * 100 + F.length("seq")).alias("offset_end"), odd.alias("seq"), F.concat(F.length("seq").cast("string"), F.lit("M")).alias("cigar"))
    return mismatching(hits.unionByName(hits.withColumn("qname", F.concat("qname", F.lit("b"))).where("cast(qname as string) not like '%6b'")))


QUERIES = {f.__name__: f for f in (mismatch_filter, interval_clusters, read_region_association, local_alignment_scores, call_pairing, redundant_calls, greedy_assignment, call_consensus, low_complexity_masks, joint_rescore)}


def _candidates(one: str, two: str, more: str = "true") -> str:
    """(i, far, j) of calls that may be two ends of one insertion."""
    gap = "CASE WHEN a.host_rev THEN a.host_pos - b.host_pos ELSE b.host_pos - a.host_pos END"
    return f"SELECT a.id AS i, abs({gap}) AS far, b.id AS j FROM {one} a JOIN {two} b ON a.host_chr = b.host_chr AND a.host_rev <> b.host_rev AND a.virus_rev <> b.virus_rev AND {more} WHERE {gap} BETWEEN -50 AND 1000"


def _in_order(name: str, candidates: str) -> str:
    """CTEs that give name(i, j): each i, in order, takes its nearest j that none has taken."""
    return f"""{name}_m AS ({candidates}), {name}_n AS (SELECT i, row_number() OVER (ORDER BY i) AS n FROM (SELECT DISTINCT i FROM {name}_m)),
        {name}_c AS (SELECT n, far, j FROM {name}_m JOIN {name}_n USING (i)),
        {name}_w AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS taken, CAST(NULL AS BIGINT) AS j
            UNION ALL SELECT n, CASE WHEN j IS NULL THEN taken ELSE list_append(taken, j) END, j
            FROM (SELECT w.n + 1 AS n, w.taken, arg_min(c.j, c.far * 1000000000 + c.j) AS j FROM {name}_w w LEFT JOIN {name}_c c ON c.n = w.n + 1 AND NOT list_contains(w.taken, c.j)
                WHERE w.n < (SELECT max(n) FROM {name}_n) GROUP BY w.n, w.taken)),
        {name} AS (SELECT i, j FROM {name}_w JOIN {name}_n USING (n) WHERE j IS NOT NULL)"""


_MATES = "SELECT id, CAST(arg_max(mate, own) AS BIGINT) AS paired_with FROM (SELECT i AS id, j AS mate, 1 AS own FROM t UNION ALL SELECT j, i, 0 FROM t) GROUP BY id"
_OK = "((pbs >= 0.8 AND NOT (good_pairs < 3 OR (good_pairs = 3 AND split_reads = 0)) AND host_len >= 30 AND virus_len >= 30) OR (coverage >= 0.5 AND good_pairs > 2)) AND NOT (host_masked > 0.8 * host_len OR virus_masked > 0.8 * virus_len)"
ORACLES: dict = {
    "call_pairing": f"WITH RECURSIVE {X.CALLS}, {_in_order('t', _candidates('calls', 'calls', 'a.id < b.id'))} {_MATES}",
    "rejected_pairing": f"""WITH RECURSIVE {X.CALLS}, good AS (SELECT * FROM calls WHERE {_OK}), bad AS (SELECT * FROM calls WHERE NOT ({_OK})), {_in_order('t', _candidates('good', 'good', 'a.id < b.id'))},
        lone AS (SELECT * FROM good WHERE id NOT IN (SELECT i FROM t UNION SELECT j FROM t)), {_in_order('r', _candidates('lone', 'bad'))} SELECT j AS id, i AS paired_with FROM r""",
}
