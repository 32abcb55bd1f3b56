"""Approximate nearest neighbours: a navigable small-world hierarchy for each shard.

Equal vectors form one class, which stands in the index once with its smallest
ids (a query needs no more of them). Classes are dealt to shards of bounded
size. In each shard, points are inserted in order; a point links to diverse near
ones among those before it, on every level up to its own, and lists that
overflow are thinned in the same way. The graph is stored as flat neighbour
arrays, one row for each shard. Blocks of queries meet every shard; its best
are merged for each query.

Distances are Euclidean, in double precision on the original vectors.

Defined results: rows with a null id, and vectors that are null, empty, zero or
hold a null or non-finite component, take no part; a query's candidates are the
vectors of its own length; repeated rows count once; of several vectors with one
id that sorting first stands for it; ties go to the smaller id; extra columns
are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from . import common

TOP = 10
#: Classes in a shard and queries in a block, on average.
SHARD_ROWS, BLOCK_ROWS = 4000, 500
#: Links of a point on upper levels, on the lowest one, and candidates looked at for them.
LINKS, LOW_LINKS, CANDIDATES = 12, 24, 64
#: Width of the search on the lowest level.
WIDTH = 96
LEVELS = 8


def _levels(n: int) -> np.ndarray:
    """Level of each point: geometric, by a fixed sequence."""
    u = (np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(11)).astype(np.float64) / 2**53
    return np.minimum((-np.log(np.maximum(u, 1e-12)) / np.log(LINKS)).astype(int), LEVELS - 1)


def _diverse(x: np.ndarray, near: np.ndarray, gaps: np.ndarray, most: int) -> list[int]:
    """Of points in order of distance, those that are nearer to the centre than to any chosen before; then the nearest others."""
    chosen, rest = [], []
    between = ((x[near][:, None, :] - x[near][None, :, :]) ** 2).sum(axis=2)
    for i in range(len(near)):
        if len(chosen) == most:
            break
        if not chosen or (between[i, chosen] > gaps[i]).all():
            chosen.append(i)
        else:
            rest.append(i)
    chosen += rest[: most - len(chosen)]
    return near[chosen].tolist()


def build(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels from the lowest up: (starts, neighbours) as flat arrays over all points."""
    n, level = len(x), _levels(len(x))
    squares = (x * x).sum(axis=1)
    out = []
    for at in range(int(level.max(initial=0)) + 1):
        points = np.flatnonzero(level >= at)
        most = LOW_LINKS if at == 0 else LINKS
        links: dict[int, list[int]] = {int(p): [] for p in points}
        for a in range(0, len(points), 256):
            block = points[a : a + 256]
            before = points[: a + len(block)]
            d = squares[block][:, None] + squares[before][None, :] - 2 * x[block] @ x[before].T
            for i, p in enumerate(block.tolist()):
                row = d[i, : a + i]
                if not len(row):
                    continue
                k = np.argpartition(row, CANDIDATES)[:CANDIDATES] if len(row) > CANDIDATES else np.arange(len(row))
                k = k[np.argsort(row[k], kind="stable")]
                near = before[k]
                for q in _diverse(x, near, ((x[near] - x[p]) ** 2).sum(axis=1), most // 2):
                    links[p].append(q)
                    links[q].append(p)
                    if len(links[q]) > most:
                        other = np.array(links[q])
                        gaps = ((x[other] - x[q]) ** 2).sum(axis=1)
                        order = np.argsort(gaps, kind="stable")
                        links[q] = _diverse(x, other[order], gaps[order], most)
        sizes = np.zeros(n + 1, dtype=np.int32)
        for p, v in links.items():
            sizes[p + 1] = len(v)
        flat = np.array([q for p in sorted(links) for q in links[p]], dtype=np.int32)
        out.append((np.cumsum(sizes, dtype=np.int32), flat))
    return out


def search(x: np.ndarray, graph: list[tuple[np.ndarray, np.ndarray]], query: np.ndarray, width: int) -> list[tuple[float, int]]:
    """The nearest points found: (squared distance, point), ascending."""
    at = int(np.argmax(_levels(len(x)))) if len(graph) > 1 else 0
    gap = float(((x[at] - query) ** 2).sum())
    for starts, flat in reversed(graph[1:]):
        while True:
            near = flat[starts[at] : starts[at + 1]]
            if not len(near):
                break
            d = ((x[near] - query) ** 2).sum(axis=1)
            k = int(d.argmin())
            if d[k] >= gap:
                break
            at, gap = int(near[k]), float(d[k])
    starts, flat = graph[0]
    seen = np.zeros(len(x), dtype=bool)
    seen[at] = True
    open_, best = [(gap, at)], [(-gap, at)]
    while open_:
        gap, p = heapq.heappop(open_)
        if len(best) >= width and gap > -best[0][0]:
            break
        near = flat[starts[p] : starts[p + 1]]
        near = near[~seen[near]]
        if not len(near):
            continue
        seen[near] = True
        for d, q in zip(((x[near] - query) ** 2).sum(axis=1).tolist(), near.tolist(), strict=True):
            if len(best) < width:
                heapq.heappush(best, (-d, q))
                heapq.heappush(open_, (d, q))
            elif d < -best[0][0]:
                heapq.heapreplace(best, (-d, q))
                heapq.heappush(open_, (d, q))
    return sorted((-d, p) for d, p in best)


def usable(df: DataFrame, vector: str, key: str) -> DataFrame:
    """(vec_id, v) of the rows that take part, one for each id."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    rows = df.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda c: c != 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


INDEX = "dim int, shard int, vectors binary, members array<array<long>>, starts array<binary>, links array<binary>"


def index(rows: DataFrame, top: int = TOP) -> tuple[DataFrame, int]:
    """One row for each shard: class vectors, the smallest ids of each class, and the graph's flat arrays."""
    rank = F.dense_rank().over(W.Window.partitionBy("v").orderBy("vec_id"))  # Spark limits each group before the shuffle
    classes = rows.withColumn("rank", rank).where(F.col("rank") <= top + 1).groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("members"))
    classes = common.Written(classes).df
    shards = max(1, -(-classes.count() // SHARD_ROWS))
    dealt = classes.withColumn("dim", F.size("v")).withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(first=[m[0] for m in pdf["members"]]).sort_values("first", kind="stable")
        x = np.stack(pdf["v"].to_list()).astype(np.float64)
        graph = build(x)
        members = [[int(i) for i in m] for m in pdf["members"]]
        row = (int(pdf["dim"].iloc[0]), int(pdf["shard"].iloc[0]), x.tobytes(), members, [s.tobytes() for s, _ in graph], [f.tobytes() for _, f in graph])
        return pd.DataFrame([row], columns=[c.split()[0] for c in INDEX.split(", ")])

    return dealt.groupBy("dim", "shard").applyInPandas(one, INDEX), shards


def nearest(rows: DataFrame, queries: DataFrame, top: int = TOP, width: int = WIDTH) -> DataFrame:
    """(query_id, rank, vec_id, score) for queries (vec_id, v) against rows (vec_id, v); a query's own id is no candidate."""
    made, shards = index(rows, top)
    made = common.Written(made).df
    queries = queries.select("vec_id", "v").distinct()
    blocks = max(1, -(-queries.count() // BLOCK_ROWS))
    block = queries.groupBy(F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("vec_id", "v")).alias("queries"))
    sent = block.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    met = made.join(sent.hint("shuffle_hash"), ["dim", "shard"]).select("vectors", "members", "starts", "links", "dim", "queries")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                x = np.frombuffer(row.vectors, dtype=np.float64).reshape(-1, row.dim)
                graph = [(np.frombuffer(s, dtype=np.int32), np.frombuffer(f, dtype=np.int32)) for s, f in zip(row.starts, row.links, strict=True)]
                out = []
                for q in row.queries:
                    v = np.asarray(q["v"], dtype=np.float64)
                    found, ids = [], 0
                    for d, p in search(x, graph, v, width):
                        if ids >= top and d > found[-1][0]:
                            break
                        own = [int(i) for i in row.members[p] if i != q["vec_id"]][:top]
                        ids += len(own)
                        found += [(d, i) for i in own]
                    out += [(q["vec_id"], i, float(np.sqrt(d))) for d, i in sorted(found)[:top]]
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    # a task for each shard and block, as far as there are tasks
    found = met.repartition(max(1, shards * blocks)).mapInPandas(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.distinct().withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op5_hnsw(spark, sf_dir: str) -> DataFrame:
    """The ten nearest of every row whose id is divisible by 100, among all rows."""
    rows = usable(common.table(spark, sf_dir, "embeddings"), "embedding", "vec_id")
    return nearest(rows, rows.where(F.col("vec_id") % 100 == 0))
