"""URL filters by temporal list join, in DataFrame functions only.

A list is a history of dated entries: (list, pattern, action, at), where action
is ``add`` or ``remove``. Histories become validity intervals: an ``add`` holds
from its time until the next entry of the same list and pattern. A pattern is a
domain (which covers its subdomains) or a host with the first directory of a
path. Every capture is evaluated as of its own time: its candidate patterns are
joined by equality with the intervals that hold then.

Lists of at most BROADCAST_ROWS intervals are broadcast; longer ones are joined
by shuffle, with captures salted and intervals repeated for each salt, so that
no host gathers in one task.

Defined results: captures with a null or malformed URL, or a null time, match
nothing; repeated captures get a row each; entries with a null field are
ignored; of entries with the same time for one list and pattern a removal wins;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from . import common

BROADCAST_ROWS = 100_000
SALTS = 16
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([A-Za-z0-9.-]+)"
FOLDER = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)"


def intervals(entries: DataFrame) -> DataFrame:
    """(list, pattern, since, until); until is null for entries that still hold."""
    known = entries.select("list", F.lower("pattern").alias("pattern"), F.col("action").alias("action"), F.col("at").cast("timestamp").alias("since")).dropna()
    one = known.groupBy("list", "pattern", "since").agg(F.max("action").alias("action"))  # 'remove' sorts last
    following = F.lead("since").over(W.Window.partitionBy("list", "pattern").orderBy("since"))
    return one.withColumn("until", following).where("action = 'add'").drop("action")


def host_of(url: Column) -> Column:
    """Lower-case host without a final dot; empty if there is none."""
    return F.coalesce(F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.$", ""), F.lit(""))


def candidates(url: Column, host: Column) -> Column:
    """Patterns that can match a URL: its host, every parent of two labels or more, and host/directory."""
    labels = F.split(host, r"\.")
    domains = F.when(F.size(labels) < 2, F.array(host)).otherwise(F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    folder = F.lower(F.regexp_extract(url, FOLDER, 1))
    found = F.when(folder == "", domains).otherwise(F.concat(domains, F.array(F.concat(host, F.lit("/"), folder))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(found)


def evaluate(captures: DataFrame, entries: DataFrame, key: str = "page_id", url: str = "url", at: str = "fetched") -> DataFrame:
    """(key, url, at, host, blocked, lists, n_entries, since) for each capture."""
    held = common.Written(intervals(entries)).df
    one = captures.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(at).cast("timestamp").alias("at")).groupBy("key", "url", "at").agg(F.count("*").alias("copies"))
    one = one.withColumn("host", host_of(F.col("url")))
    spread = one.withColumn("pattern", F.explode_outer(candidates(F.col("url"), F.col("host"))))
    active = (F.col("at") >= F.col("since")) & (F.col("until").isNull() | (F.col("at") < F.col("until")))
    if held.count() <= BROADCAST_ROWS:
        met = spread.join(F.broadcast(held.withColumnRenamed("pattern", "p")), (F.col("pattern") == F.col("p")) & active, "left")
    else:
        salted = held.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("pattern", "p")
        spread = spread.withColumn("salt", F.pmod(F.xxhash64("key", "url"), F.lit(SALTS)).cast("int"))
        met = spread.join(salted, (F.col("pattern") == F.col("p")) & (F.col("salt") == F.col("s")) & active, "left")
    judged = met.groupBy("key", "url", "at", "host", "copies").agg(
        F.count("list").alias("n_entries"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"), F.min("since").alias("since")
    )
    rows = judged.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.select(F.col("key").alias(key), F.col("url").alias(url), F.col("at").alias(at), "host", (F.col("n_entries") > 0).alias("blocked"), "lists", "n_entries", "since")


# A history of list entries.
HISTORY = [
    ("gambling", "casino-win.example.org", "add", "2024-01-15"),
    ("gambling", "casino-win.example.org", "remove", "2024-05-01"),
    ("gambling", "casino-win.example.org", "add", "2024-08-20"),
    ("gambling", "free-bets.example.com", "add", "2023-11-01"),
    ("gambling", "free-bets.example.com", "remove", "2024-09-09"),
    ("pharmacy", "cheap-pills.example.com", "add", "2024-03-03"),
    ("adult", "adult-x.example.net", "add", "2024-02-10"),
    ("adult", "adult-x.example.net", "remove", "2024-07-01"),
    ("adult", "adult-x.example.net", "add", "2024-07-02"),
    ("mirrors", "example.org", "add", "2024-06-01"),
    ("mirrors", "example.org", "remove", "2024-06-15"),
    ("mirrors", "tionsh.example.net", "add", "2024-04-01"),
    ("mirrors", "tionsh.example.net", "remove", "2024-10-01"),
    ("folders", "blog.ththan.example.net/fr", "add", "2024-01-02"),
    ("folders", "www.ththhe.example.com/en", "add", "2024-12-01"),
    ("folders", "m.adult-x.example.net/fr", "add", "2023-01-01"),
]


def op8_urls(spark, sf_dir: str) -> DataFrame:
    """Every page against the list entries that held when it was fetched: page_id modulo 366 days into 2024."""
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.coalesce(F.pmod("page_id", F.lit(366)), F.lit(0)).cast("int"))
    entries = spark.createDataFrame(HISTORY, "list string, pattern string, action string, at string")
    found = evaluate(pages.withColumn("fetched", day), entries)
    return found.select("page_id", "url", F.date_format("fetched", "yyyy-MM-dd").alias("fetched"), "host", "blocked", "lists", "n_entries", F.date_format("since", "yyyy-MM-dd").alias("since"))


_VALUES = ",\n    ".join(str(x) for x in HISTORY)
OP8_SQL = f"""
WITH history(list, pattern, action, listed) AS (VALUES
    {_VALUES}),
held AS (
    SELECT list, pattern, CAST(listed AS DATE) AS since, action,
           lead(CAST(listed AS DATE)) OVER (PARTITION BY list, pattern ORDER BY CAST(listed AS DATE)) AS until
    FROM history),
captures AS (
    SELECT row_number() OVER () AS n, page_id, url,
           CAST('2024-01-01' AS DATE) + CAST(coalesce(((page_id % 366) + 366) % 366, 0) AS INTEGER) AS fetched,
           lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([A-Za-z0-9.-]+)', 1)) AS host,
           lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)', 1)) AS folder
    FROM pages),
met AS (
    SELECT c.n, h.list, h.since
    FROM captures c JOIN held h
      ON (c.host = h.pattern OR ends_with(c.host, '.' || h.pattern) OR (c.folder <> '' AND c.host || '/' || c.folder = h.pattern))
     AND h.action = 'add' AND c.fetched >= h.since AND (h.until IS NULL OR c.fetched < h.until)),
judged AS (
    SELECT n, count(*) AS n_entries, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, min(since) AS since FROM met GROUP BY n)
SELECT c.page_id, c.url, strftime(c.fetched, '%Y-%m-%d') AS fetched, c.host, j.n IS NOT NULL AS blocked,
       coalesce(j.lists, '') AS lists, coalesce(j.n_entries, 0) AS n_entries, strftime(j.since, '%Y-%m-%d') AS since
FROM captures c LEFT JOIN judged j ON c.n = j.n
"""
