"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one where that is unset and all runs in this process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


class Written:
    """A table written in the shared folder; cuts lineage and survives lost executors.

    Tables lie in one folder for each application. Those that no later plan reads are dropped at once, the rest,
    which results may still read, when Python ends.
    """

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = place(self.spark)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """For tables that no later plan reads."""
        _remove(self.spark, self.path)


def place(spark: SparkSession) -> str:
    """A new path in this application's part of the shared folder; what lies there goes when Python ends."""
    top = f"{shared_dir(spark).rstrip('/')}/splicewell-{spark.sparkContext.applicationId}"
    if top not in _FOLDERS:
        _FOLDERS.add(top)
        atexit.register(_remove, spark, top)
    return f"{top}/{uuid.uuid4().hex}"


#: Least number of rows of one key that count as hot, and the most keys that can be hot.
HOT_ROWS, HOT_KEYS = 1000, 10_000


def meet(df: DataFrame, groups: DataFrame, keys: list[str], rows: str, total: int, how: str = "inner") -> DataFrame:
    """Rows of df with those of groups, which hold each key once and the number of df's rows with it.

    Keys with many rows are broadcast, so their rows stay where they are; as each of them holds over a
    10,000th of all rows, there are fewer than that many. The others are joined by shuffle. Neither table may change
    from one read to the next: give written ones. A left join also keeps rows whose key isn't among the groups.
    """
    most = max(HOT_ROWS, total // HOT_KEYS)
    hot, rest = groups.where(F.col(rows) > most).drop(rows), groups.where(F.col(rows) <= most).drop(rows)
    if hot.isEmpty():
        return df.join(rest, keys, how)
    bound = F.broadcast(hot)
    cold = df.join(bound.select(*keys), keys, "left_anti")
    return df.join(bound, keys).unionByName(cold.join(rest, keys, how))


_FOLDERS: set[str] = set()


def _remove(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):  # at the end of Python the JVM may be gone
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free(df: DataFrame, name: str) -> str:
    """A column name like this one that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches that tasks and Python workers hold, where the session leaves their size at Spark's default.

    The setting is read when a plan is made, which for a lazy result is after the operator has returned; so it stays
    in the session. A size that the user has set is left alone.
    """
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "500"), ("spark.sql.execution.arrow.maxBytesPerBatch", "8m")):
        if spark.conf.isModifiable(key) and spark.conf.get(key) in DEFAULTS[key]:
            spark.conf.set(key, value)


# Spark's defaults, as they may be shown.
DEFAULTS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": {"10000"},
    "spark.sql.execution.arrow.maxBytesPerBatch": {"67108864b", "67108864", "64MB", "64m", "2147483647b", "2147483647", "-1"},
}

#: What a Python worker turns into objects at a time, of an Arrow batch of whatever size.
ROWS, BYTES = 500, 8 << 20


def slices(batch: pa.Array | pa.RecordBatch, rows: int = ROWS, size: int = BYTES) -> Iterator[pa.Array | pa.RecordBatch]:
    """Parts of an Arrow batch, in order: of so many rows at most, fewer where rows are long on average."""
    step = max(1, min(rows, size * len(batch) // max(1, batch.nbytes))) if len(batch) else 1
    for at in range(0, len(batch), step):
        yield batch.slice(at, step)


def mapped(batch: pa.Array, made, kind: pa.DataType) -> pa.Array:
    """made(values) of each slice, as one Arrow array; so only one slice's results are Python objects at a time."""
    return pa.concat_arrays([pa.array([], kind), *(made(part.to_pylist()) for part in slices(batch))])


def lists(found: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """Arrow lists of numpy arrays."""
    ends = np.cumsum([0, *map(len, found)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found) if found else [], kind))


def values(batch: pa.Array) -> Iterator:
    """An Arrow array's values, without making objects of all of them at once."""
    for part in slices(batch):
        yield from part.to_pylist()


def fold_of(id_column: str) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out. A null id counts as fold 0, so nothing is learned from it."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % FOLDS, F.lit(0))


def held_out(id_column: str) -> Column:
    return fold_of(id_column) == 0
