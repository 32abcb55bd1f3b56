"""The driver's tables seen as the engine's: each view in Spark, and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS = "abcdefghijklmnopqrstuvwxyz"
AS_BASES = ("ACGT" * 7)[:26]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _bases(text: str):
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z]", ""), LETTERS, AS_BASES)


def _sql_bases(text: str) -> str:
    return f"translate(regexp_replace(lower({text}), '[^a-z]', '', 'g'), '{LETTERS}', '{AS_BASES}')"


def reads(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("read_id"), _bases("text").alias("seq"))


READS = f"reads AS (SELECT doc_id AS read_id, {_sql_bases('text')} AS seq FROM documents)"


def targets(spark, sf) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("region_id"), _bases("text").alias("seq"))


TARGETS = f"targets AS (SELECT item_id AS region_id, {_sql_bases('text')} AS seq FROM benchmark)"


def anchors(spark, sf) -> DataFrame:
    minute = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 60)
    strand = F.when(F.col("event_type").isin("click", "view"), "F").otherwise("R")
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("contig"), strand.alias("strand"), minute.cast("long").alias("start"), (minute + F.floor("value")).cast("long").alias("end"))


ANCHORS = """anchors AS (SELECT event_id AS id, user_id AS contig, CASE WHEN event_type IN ('click', 'view') THEN 'F' ELSE 'R' END AS strand,
    CAST(floor(floor(epoch(ts)) / 60) AS BIGINT) AS start, CAST(floor(floor(epoch(ts)) / 60) + floor(value) AS BIGINT) AS "end" FROM events)"""

_HITS = {
    "region_id": "l_partkey % 97",
    "rev": "l_returnflag = 'R'",
    "read_id": "l_orderkey * 10 + l_linenumber",
    "qname": "l_orderkey",
    "offset_start": "(l_suppkey * 13 + l_partkey) % 1000",
    "offset_end": "(l_suppkey * 13 + l_partkey) % 1000 + CAST(l_quantity AS BIGINT) + 20",
    "score": "CAST(l_quantity AS BIGINT) + l_linenumber * 3",
    "lclip": "l_partkey % 7 * (l_linenumber % 4)",
    "rclip": "l_suppkey % 9 * (l_linenumber % 3)",
    "suspicious": "l_partkey % 11 = 0",
    "too_long": "l_suppkey % 13 = 0",
    "sample": "l_orderkey % 3",
    "secondary": "l_linestatus = 'F'",
    "flag": "(l_orderkey * 37 + l_partkey * 11 + l_linenumber) % 4096",
    "contig": "l_suppkey % 5",
    "mate_contig": "l_partkey % 5",
    "isize": "l_partkey * 101 - l_orderkey * 7",
    "mate": "l_linenumber % 2 + 1",
    "pos": "l_partkey",
    "quality": "CAST(l_quantity AS BIGINT)",
}
_SELECT = ", ".join(f"{v} AS {k}" for k, v in _HITS.items())
HITS = f"hits AS (SELECT {_SELECT} FROM lineitem)"


def hits(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(*[f"{v} AS {k}" for k, v in _HITS.items()])


_CALLS = {
    "id": "l_partkey",
    "host_chr": "l_partkey % 5",
    "host_rev": "l_partkey % 2 = 0",
    "host_pos": "l_partkey * 37 % 20011",
    "virus_rev": "l_partkey % 4 < 2",
    "virus_pos": "l_partkey * 53 % 7919",
    "good_pairs": "count(*) % 8",
    "split_reads": "count(CASE WHEN l_returnflag = 'R' THEN 1 END)",
    "pbs": "sum(CAST(round(l_discount * 100) AS BIGINT)) / (count(*) * 6.0)",
    "coverage": "sum(CAST(round(l_tax * 100) AS BIGINT)) / (count(*) * 10.0)",
    "host_len": "sum(CAST(l_quantity AS BIGINT)) % 200",
    "virus_len": "sum(l_linenumber * 7) % 180",
    "host_masked": "sum(l_suppkey) % 120",
    "virus_masked": "sum(l_orderkey) % 90",
}
CALLS = "calls AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in _CALLS.items()) + " FROM lineitem GROUP BY l_partkey)"


def calls(spark, sf) -> DataFrame:
    made = {k: F.expr(v).alias(k) for k, v in _CALLS.items()}
    plain = ["id", "host_chr", "host_rev", "host_pos", "virus_rev", "virus_pos"]
    grouped = table(spark, sf, "lineitem").groupBy("l_partkey").agg(*[made[k] for k in _CALLS if k not in plain])
    return grouped.select(*[made[k] if k in plain else F.col(k) for k in _CALLS])


#: Sequences for hits: a run of one base, pairs, and a fixed tail, of lengths that vary.
SEQ = "concat(repeat(substr('ACGT', CAST(1 + pos % 4 AS INT), 1), CAST(quality AS INT)), repeat('GT', CAST(read_id % 9 AS INT)), substr('ACGTTGCATCAGGCTA', 1, CAST(4 + read_id % 12 AS INT)))"
