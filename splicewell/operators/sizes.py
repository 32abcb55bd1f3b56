"""Broadcasting behind a check of the size."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that may be broadcast; a table of more is joined by shuffle.
BROADCAST_ROWS = 500_000
#: Bytes that small() broadcasts, as the driver holds them; it needs some times that to build them.
BROADCAST_BYTES = 32 << 20
#: Bytes, as Spark takes them from files, that it may broadcast by itself within only_counted().
UNCOUNTED_BYTES = 256 << 10


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    return df.limit(rows + 1).count() <= rows


def spread(df: DataFrame, *key: str) -> DataFrame:
    """Deals rows out evenly before something makes many of each; the number is explicit, so they stay apart."""
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *key)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int | None = None) -> DataFrame:
    """The table with a broadcast hint if it has at most so many rows and bytes, else to be joined by shuffle; counting stops beyond the rows.

    Without the second hint Spark may broadcast what the table is joined with, as it takes that for as small as the files it
    comes from, even where rows have been made of it since.
    """
    texts = [F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c, kind in df.dtypes if kind in ("string", "binary")]
    width = sum(texts, F.lit(64 + 8 * len(df.columns)).cast("long"))
    n, wide = df.select(width.alias("width")).limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum("width"), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and wide <= (BROADCAST_BYTES if size is None else size) else df.hint("merge")


@contextlib.contextmanager
def only_counted(spark: SparkSession) -> Iterator[None]:
    """What is planned within is broadcast after counting, or if it is tiny: a plan of many joins else builds many tables on the driver at once."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before, most = spark.conf.get(key), spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    spark.conf.set(key, str(min(most, UNCOUNTED_BYTES)))
    try:
        yield
    finally:
        spark.conf.set(key, before)
