"""Junctions end to end, on pairs planted in sequences that Spark derives from the driver's tables.

Each supplier has a host contig and each nation a virus, of bases by digest. A supplier's contig joins its
nation's virus at one place; each customer gives a pair of reads across the junction of one supplier. The truth is
then plain SQL: where the reads reach furthest, and how many pairs lie apart.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as S
from . import fixtures as X
from .pipeline import junctions as find_junctions

HEX = "0123456789abcdef"
HOST_BLOCKS, VIRUS_BLOCKS, READ, REACH = 24, 12, 100, 500


def _contig(kind: str, key: str, blocks: int):
    parts = [F.sha2(F.concat_ws("-", F.lit(kind), F.col(key).cast("string"), F.lit(str(i))).cast("binary"), 256) for i in range(blocks)]
    return F.translate(F.concat(*parts), HEX, "ACGT" * 4)


def planted(spark, sf):
    """(pairs, host contigs, viruses)."""
    suppliers = X.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("s"), F.col("s_nationkey").alias("n"))
    host = suppliers.select(F.format_string("host-%d", "s").alias("name"), _contig("host", "s", HOST_BLOCKS).alias("seq"))
    virus = X.table(spark, sf, "nation").select(F.format_string("virus-%d", "n_nationkey").alias("name"), _contig("virus", "n_nationkey", VIRUS_BLOCKS).alias("seq"))
    count = suppliers.count()
    c = X.table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("c")).withColumn("s", F.col("c") % count + 1)
    at = c.join(suppliers, "s").withColumns({"h": 600 + F.col("s") * 13 % 100 - F.col("c") * 37 % 120, "v": 200 + F.col("s") * 7 % 100 + F.col("c") * 53 % 130})
    contig, other = F.format_string("host-%d", "s"), F.format_string("virus-%d", "n")
    read = lambda name, start: F.substring(F.col(name), (F.col(start) + 1).cast("int"), F.lit(READ))
    met = at.withColumns({"host_contig": contig, "virus_contig": other}).join(host.toDF("host_contig", "hs"), "host_contig").join(virus.toDF("virus_contig", "vs"), "virus_contig")
    pairs = met.select(F.format_string("c%d", "c").alias("qname"), "host_contig", F.lit("F").alias("host_strand"), F.col("h").alias("host_pos"), read("hs", "h").alias("host_seq"), S.reverse_complement(read("vs", "v")).alias("virus_seq"))
    return pairs, host, virus


def junctions(spark, sf):
    found = find_junctions(*planted(spark, sf), REACH)
    return found.select("host_chr", "host_rev", "host_pos", "virus_chr", "virus_rev", "virus_pos", "reads", "pairs", "good_pairs", "split_reads", "score", F.round("pbs", 6).alias("pbs"))


QUERIES = {"junctions": junctions}
ORACLES = {
    "junctions": f"""WITH c AS (SELECT CAST(c_custkey AS BIGINT) AS c, CAST(c_custkey AS BIGINT) % (SELECT count(*) FROM supplier) + 1 AS s FROM customer),
        p AS (SELECT DISTINCT s, s_nationkey AS n, 600 + s * 13 % 100 - c * 37 % 120 AS h, 200 + s * 7 % 100 + c * 53 % 130 AS v FROM c JOIN supplier ON s_suppkey = s)
        SELECT 'host-' || s AS host_chr, false AS host_rev, max(h) + {READ} AS host_pos, 'virus-' || n AS virus_chr, true AS virus_rev, min(v) AS virus_pos,
            count(*) AS reads, count(*) AS pairs, count(*) AS good_pairs, CAST(0 AS BIGINT) AS split_reads, CAST({READ} * count(*) AS BIGINT) AS score, round({READ} / {READ + 1}.0, 6) AS pbs
        FROM p GROUP BY s, n HAVING count(*) > 1""",
}
