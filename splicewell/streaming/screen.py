"""The seed screen on a stream of reads: it is stateless, so each batch is screened as a table is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import sequence as S
from ..operators.screen import seed_index
from ..params import DEFAULT, Params


def hits(reads: DataFrame, seeds: DataFrame, key: str = "read_id", seq: str = "seq", p: Params = DEFAULT) -> DataFrame:
    """(key, pos) of matching k-mers, for a streaming or plain table of reads and a table of seeds: a stream-static semi join."""
    at = reads.select(key, F.posexplode(S.kmers(F.col(seq), p.seed_k)).alias("pos", "kmer"))
    each = at.select(key, "pos", F.inline(S.spaced_seeds(F.col("kmer"), p.seed_segments)))
    return each.join(seeds, ["j", "seed"], "left_semi").select(key, "pos")


def screen_stream(reads: DataFrame, targets: DataFrame, path: str, checkpoint: str, p: Params = DEFAULT, **options) -> StreamingQuery:
    """Writes the reads that pass to Parquet, a folder for each batch, so that a batch that is replayed replaces itself."""
    seeds = seed_index(targets, "seq", p)

    def one(batch: DataFrame, number: int) -> None:
        found = hits(batch, seeds, p=p).distinct().groupBy("read_id").agg(F.count("*").alias("hits"))
        batch.join(found.where(F.col("hits") >= p.seed_min_hits), "read_id").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return reads.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(options or {"availableNow": True})).start()
