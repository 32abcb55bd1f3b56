"""Connected components of a link table, by spreading the smallest label, in DataFrame joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label) for every node with a link; label is the smallest node that can be reached.

    Each round a node takes the smallest label among its own and its neighbours',
    then the label of that label, so labels travel ever further. Rounds go on until
    none changes. Labels are written in the shared folder after each round. Links
    with a null end are not links; empty links give an empty table.
    """
    both = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.col(a).alias("u"), F.col(b).alias("v"))
    edges = common.Written(both.union(both.select("v", "u")).distinct())
    labels = common.Written(edges.df.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("label")))
    while True:
        near = edges.df.join(labels.df, F.col("v") == F.col("node")).select(F.col("u").alias("node"), "label")
        best = labels.df.select("node", "label", F.col("label").alias("old")).unionByName(
            near.withColumn("old", F.lit(None).cast(labels.df.schema["label"].dataType))
        )
        best = common.Written(best.groupBy("node").agg(F.min("label").alias("label"), F.min("old").alias("old")))
        root = best.df.select(F.col("node").alias("at"), F.col("label").alias("further"))
        jumped = common.Written(
            best.df.join(root, F.col("label") == F.col("at"), "left").select("node", F.least("label", "further").alias("label"), "old")
        )
        changed = jumped.df.where(F.col("label") != F.col("old")).limit(1).count()
        labels.drop()
        best.drop()
        labels = jumped
        labels.df = labels.df.select("node", "label")
        if not changed:
            edges.drop()
            return labels.df
