"""Tables in the folder that all executors share: they cut lineage between rounds."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: set[str] = set()


def _remove(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):  # at the end of Python the JVM may be gone
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def place(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir, or under a temporary folder where that is unset and all runs in this process (tests).

    Lazy results may read what lies there, so it goes when Python ends.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    top = f"{found.rstrip('/')}/splicewell-tables-{spark.sparkContext.applicationId}"
    if top not in _FOLDERS:
        _FOLDERS.add(top)
        atexit.register(_remove, spark, top)
    return f"{top}/{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """The table, written (added to what is at the path, if one is given) and read again."""
    path = path or place(df.sparkSession)
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Deletes the files of a written table that no later plan reads."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _remove(df.sparkSession, folder)
