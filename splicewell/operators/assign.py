"""Greedy assignment of read pairs to junctions.

The order in which junctions are taken needs their sums only, so one task works that out: it holds a few numbers for each
junction, and reads names of the junction that it takes from files of its own, each name once. Names are gathered
before and assigned afterwards in all tasks: a name goes to the first junction taken that it supports.
"""

from __future__ import annotations

import heapq
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..params import DEFAULT, Params
from . import evidence as E
from . import tables
from .sizes import small

RESULT = "region_id long, rev boolean, virus_region long, virus_rev boolean, qname string, h_score long, v_score long, call_score long"
PAIR = ["region_id", "rev", "virus_region", "virus_rev"]
#: Rows that one task may assign as objects; of more, it only decides the order of junctions.
LAST = 400_000
#: Rows that the task which decides the order looks at together.
BATCH = 400_000


def greedy(rows: pd.DataFrame, least: int) -> pd.DataFrame:
    """Junctions of these rows, best first."""
    table = list(rows[["region_id", "rev", "virus_region", "virus_rev", "qname", "h_score", "v_score"]].itertuples(index=False, name=None))
    out, scores = _greedy(table, least)
    return rows.iloc[out].assign(call_score=scores)


def _greedy(table: list[tuple], least: int) -> tuple[list[int], list[int]]:
    """Rows in the order in which junctions take them, and the scores of those.

    Each host region and strand is worth the host scores of its best virus region over its unused names. Sums are kept
    current as names are used; they only fall, so a value on the heap is looked up anew when it comes up, and stands if
    it still leads.
    """
    sums: dict = {}  # host key -> virus key -> [host sum, virus sum]
    holds: dict = {}  # name -> rows
    members: dict = {}  # (host key, virus key) -> rows
    for n, (region, rev, v_region, v_rev, name, h, v) in enumerate(table):
        key, other = (region, rev), (v_region, v_rev)
        total = sums.setdefault(key, {}).setdefault(other, [0, 0])
        total[0] += h
        total[1] += v
        holds.setdefault(name, []).append(n)
        members.setdefault((key, other), []).append(n)

    def best(key):
        return max(((h, v, -other[0], not other[1], other) for other, (h, v) in sums[key].items()), default=(0, 0, 0, False, None))

    used: set = set()
    heap = [(-best(key)[0], -key[0], not key[1], key) for key in sums]
    heapq.heapify(heap)
    out, scores = [], []
    while heap:
        top = heapq.heappop(heap)
        score, _, _, _, other = best(top[3])
        if score <= least:
            continue
        entry = (-score, *top[1:])
        if heap and entry > heap[0]:
            heapq.heappush(heap, entry)
            continue
        fresh = [n for n in members[top[3], other] if table[n][4] not in used]
        out += fresh
        scores += [score] * len(fresh)
        for name in {table[n][4] for n in fresh}:
            used.add(name)
            for n in holds[name]:
                region, rev, v_region, v_rev, _, h, v = table[n]
                total = sums[region, rev][v_region, v_rev]
                total[0] -= h
                total[1] -= v
        heapq.heappush(heap, entry)  # other names may make another junction
    return out, scores


class Names:
    """Names that support several junctions, in files: rows (junction, h, v) by name, and by junction the names that it has."""

    def __init__(self, folder: str, batch: int):
        self.folder, self.batch, self.rows, self.names = folder, batch, 0, 0
        self._out = {x: open(f"{folder}/{x}", "wb") for x in ("rows", "sizes")}  # noqa: SIM115

    def add(self, pair: pa.ListArray, h: pa.ListArray, v: pa.ListArray) -> None:
        """Lists of the same lengths, one of each for a name."""
        rows = np.column_stack([x.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for x in (pair, h, v)])
        rows.tofile(self._out["rows"])
        pc.list_value_length(pair).to_numpy(zero_copy_only=False).astype(np.int64).tofile(self._out["sizes"])
        self.rows, self.names = self.rows + len(rows), self.names + len(pair)

    def _file(self, name: str, kind: type, shape: tuple, mode: str = "w+") -> np.ndarray:
        return np.memmap(f"{self.folder}/{name}", kind, mode, shape=shape) if shape[0] else np.zeros(shape, kind)

    def gathered(self, pairs: int) -> None:
        """Deals the names to their junctions, when all are there."""
        for x in self._out.values():
            x.close()
        self.row, size = self._file("rows", np.int64, (self.rows, 3), "r"), self._file("sizes", np.int64, (self.names,), "r")
        self.first = self._file("first", np.int64, (self.names + 1,))
        np.cumsum(size, out=self.first[1:])
        self.used = self._file("used", bool, (self.names,))
        count = np.zeros(pairs, dtype=np.int64)
        for a in range(0, self.rows, self.batch):
            count += np.bincount(self.row[a : a + self.batch, 0], minlength=pairs)
        self.start = np.concatenate(([0], np.cumsum(count)))
        self.of, filled, i = self._file("of", np.int64, (self.rows,)), self.start[:-1].copy(), 0
        while i < self.names:
            j = max(i + 1, int(np.searchsorted(self.first, self.first[i] + self.batch, "right")) - 1)
            pair = self.row[self.first[i] : self.first[j], 0]
            order = np.argsort(pair, kind="stable")
            found, at, n = np.unique(pair[order], return_index=True, return_counts=True)
            self.of[np.repeat(filled[found] - at, n) + np.arange(len(order))] = np.repeat(np.arange(i, j), size[i:j])[order]
            filled[found] += n
            i = j

    def take(self, pair: int) -> Iterator[np.ndarray]:
        """Rows of the names of a junction that none has taken, which are taken then."""
        for a in range(self.start[pair], self.start[pair + 1], self.batch):
            who = self.of[a : min(a + self.batch, self.start[pair + 1])]
            who = who[~self.used[who]]
            self.used[who] = True
            first, n = self.first[who], self.first[who + 1] - self.first[who]
            yield self.row[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())]


def order(h: np.ndarray, v: np.ndarray, host: np.ndarray, names: Names, least: int) -> tuple[list[int], list[int]]:
    """Junctions in the order in which they are taken, and their scores; h and v, their sums, fall.

    Junctions stand in order of host region, host strand, virus region and strand, those first that go first among equal ones;
    host: the first one of the same host region and strand.
    """
    begin = np.flatnonzero(host == np.arange(len(host)))
    end = [*begin[1:].tolist(), len(host)]
    heap = [(-best, i) for i, best in enumerate(np.maximum.reduceat(h, begin).tolist())] if len(h) else []
    heapq.heapify(heap)
    out, scores = [], []
    while heap:
        before, i = heap[0]
        own = slice(begin[i], end[i])
        best = int(h[own].max())
        if best <= least:
            heapq.heappop(heap)
            continue
        if best != -before:
            heapq.heapreplace(heap, (-best, i))
            continue
        equal = np.flatnonzero(h[own] == best) + begin[i]
        pair = int(equal[np.argmax(v[equal])])
        for rows in names.take(pair):
            np.subtract.at(h, rows[:, 0], rows[:, 1])
            np.subtract.at(v, rows[:, 0], rows[:, 2])
        h[pair] = least  # names that it had for itself are used too
        out.append(pair)
        scores.append(best)
    return out, scores


def _ordered(least: int, batch: int) -> Callable:
    """Order of junctions from rows (host, pair, h, v): lists of a name without a host, a junction's own numbers with one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as folder:
            names, own = Names(folder, batch), []
            for b in batches:
                whole = pc.is_valid(b["host"])
                names.add(*[b.filter(pc.invert(whole))[c] for c in ("pair", "h", "v")])
                found = b.filter(whole)
                own.append(np.column_stack([found["host"].to_numpy(), *[found[c].flatten().to_numpy() for c in ("pair", "h", "v")]]))
            host, pair, h, v = np.concatenate(own or [np.zeros((0, 4), np.int64)]).T
            names.gathered(len(pair))
            at = np.argsort(pair)
            taken, scores = order(h[at], v[at], host[at], names, least)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (taken, range(len(taken)), scores)], ["pair", "place", "call_score"])

    return run


def _few(pairs: DataFrame, sums: DataFrame, least: int) -> DataFrame:
    """assign() in one task."""
    names = [x.split()[0] for x in RESULT.split(", ")]
    rest = pairs.join(sums.select(*PAIR), PAIR, "left_semi").groupBy(*PAIR, "qname").agg(F.sum("h_score").alias("h_score"), F.sum("v_score").alias("v_score"))
    chosen = rest.groupBy().applyInPandas(lambda g: greedy(g, least)[names], RESULT).select(*PAIR, "qname", "call_score")
    match = [pairs[c].eqNullSafe(chosen[c]) for c in [*PAIR, "qname"]]
    return pairs.join(chosen, match).select(*[pairs[c] for c in names[:-1]], chosen["call_score"])


def assign(pairs: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Rows of the pairs (region_id, rev, virus_region, virus_rev, qname, h_score, v_score) that support a junction, with its score.

    Best first means by host sum, host region, host strand, virus sum, virus region, virus strand. Scores aren't negative, so sums
    only fall. Junctions worth too little at the beginning are left out, and names that support a single one count in its sums
    alone; the others' lists go to the task that decides the order.
    """
    least, names = p.min_call_score, [x.split()[0] for x in RESULT.split(", ")]
    pairs = tables.written(pairs.select(names[:-1]))
    worth = [F.coalesce(F.sum(f"{s}_score"), F.lit(0)).alias(s) for s in "hv"]
    sums = tables.written(pairs.dropna(subset=PAIR).groupBy(*PAIR).agg(*worth, F.count("*").alias("n")).where(F.col("h") > least))
    if (sums.agg(F.sum("n")).first()[0] or 0) <= LAST:
        return _few(pairs, sums, least)
    hosts = sums.withColumn("host", F.struct(-F.col("region_id"), ~F.col("rev")))
    ids = E.dense_ids(hosts, "host", ["virus_region", "virus_rev"], "pair")
    ids = tables.written(ids.withColumn("host", F.min("pair").over(W.Window.partitionBy("host"))))
    # dealt by name once, for both groupings
    met = pairs.join(small(ids.select(*PAIR, "pair")), PAIR).select("qname", "pair", "h_score", "v_score").repartition("qname")
    lists = met.groupBy("qname", "pair").agg(*worth).groupBy("qname").agg(*[F.collect_list(c).alias(c) for c in ("pair", "h", "v")]).where(F.size("pair") > 1)
    both = tables.written(lists.select(F.lit(None).cast("long").alias("host"), "pair", "h", "v"))
    both = both.unionByName(ids.select("host", *[F.array(c).alias(c) for c in ("pair", "h", "v")]))
    place = tables.written(both.coalesce(1).mapInArrow(_ordered(least, BATCH), "pair long, place long, call_score long"))
    taken = tables.written(ids.join(place, "pair").select(*PAIR, "place", "call_score"))
    first = F.min("place").over(W.Window.partitionBy("qname"))
    return pairs.join(small(taken), PAIR).withColumn("first", first).where("place = first").select(*names)
