"""Consensus sequences of calls, masking, and scoring on the joined consensus."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..functions.alignment import local_alignment
from ..params import DEFAULT, Params

STEP = re.compile(r"(\d+)([MIDNSHP=X])")


def rebase(seq: str, cigar: str) -> str:
    """A read on the reference: matches as they are, deletions as D, insertions in lower case, clips dropped."""
    out, at = [], 0
    for n, op in STEP.findall(cigar):
        n = int(n)
        if op in "M=X":
            out.append(seq[at : at + n])
        elif op == "I":
            out.append(seq[at : at + n].lower())
        elif op in "DN":
            out.append("D" * n)
        if op in "M=XIS":
            at += n
    return "".join(out)


def consensus(reference: str, reads: list[tuple[int, str]], start: int, end: int) -> str:
    """Consensus over [start, end) of rebased reads (position, text).

    At each place the reads that cover it vote; the only most frequent symbol with two votes or more wins, else
    the reference. An inserted (lower-case) winner goes out without moving on; reads wait while others insert.
    Without reads the answer is A.
    """
    if not reads:
        return "A"
    waiting = sorted(reads, reverse=True)
    active: list[list] = []  # [text, index]
    out, at = [], start
    while waiting and waiting[-1][0] < start:
        pos, text = waiting.pop()
        skipped = i = 0
        while i < len(text) and skipped < start - pos:
            skipped += not text[i].islower()
            i += 1
        active.append([text, i])
    while at < end:
        while waiting and waiting[-1][0] == at:
            active.append([waiting.pop()[1], 0])
        active = [r for r in active if r[1] < len(r[0])]
        votes = Counter(r[0][r[1]] for r in active)
        ranked = votes.most_common(2)
        sure = ranked and ranked[0][1] >= 2 and (len(ranked) == 1 or ranked[0][1] > ranked[1][1]) and ranked[0][0] != "N"
        symbol = ranked[0][0] if sure else reference[at].upper()
        if symbol != "D":
            out.append(symbol)
        for r in active:
            if r[0][r[1]].islower() == symbol.islower():
                r[1] += 1
        if not symbol.islower():
            at += 1
    return "".join(out)


def call_consensus(support: DataFrame, windows: DataFrame) -> DataFrame:
    """(call_id, side, seq): support has call_id, side, pos, seq, cigar; windows has call_id, side, start, end and the contig's reference."""

    def one(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        made = []
        reads = [(int(p), rebase(s, c)) for p, s, c in zip(left["pos"], left["seq"], left["cigar"], strict=True)]
        for w in right.itertuples(index=False):
            made.append((key[0], key[1], consensus(w.reference, reads, int(w.start), min(int(w.end), len(w.reference)))))
        return pd.DataFrame(made, columns=["call_id", "side", "seq"])

    by = ["call_id", "side"]
    return support.groupBy(*by).cogroup(windows.groupBy(*by)).applyInPandas(one, "call_id long, side string, seq string")


def repeats(text: str, window: int, threshold: float) -> list[tuple[int, int]]:
    """(start, end) of the stretches of low_complexity_masks()."""
    at = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    n = len(at) - 2
    size = min(window - 2, n)
    if size < 2:
        return []
    code = np.unique(at[:-2] << 42 | at[1:-1] << 21 | at[2:], return_inverse=True)[1]
    # sorted by triplet and place, equal ones within a window of a place stand next to it
    key = code * (n + size) + np.arange(n)
    order = np.sort(key)
    here = np.searchsorted(order, key)
    behind = np.searchsorted(order, key + size - 1, side="right") - 1 - here
    before = here - np.searchsorted(order, key - size + 1)
    pairs = before[:size].sum() + np.concatenate(([0], np.cumsum(before[size:] - behind[: n - size])))
    hits = np.flatnonzero(pairs / (size - 1) > threshold)
    if not len(hits):
        return []
    new = np.flatnonzero(np.diff(hits) > size + 2) + 1
    return list(zip(hits[np.append(0, new)].tolist(), (hits[np.append(new, len(hits)) - 1] + size + 2).tolist(), strict=True))


def low_complexity_masks(sequences: DataFrame, key: str, seq: str, window: int = 64, threshold: float = 2.0) -> DataFrame:
    """(key, start, end) of the stretches whose triplets repeat: in a window the score is the number of equal pairs of
    triplets over the number of triplets less one; windows above the threshold are joined."""

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def run(texts: pa.Array) -> pa.Array:
        out = [[{"start": a, "end": b} for a, b in repeats(t, window, threshold)] if t else [] for t in texts.to_pylist()]
        return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))

    return sequences.select(key, F.inline(run(F.col(seq))))


def rescore(support: DataFrame, consensus: DataFrame, calls: DataFrame, max_is: int, p: Params = DEFAULT) -> DataFrame:
    """(id, good_pairs, split_reads, pbs): support re-aligned to each call's host and virus consensus joined at the junction.

    Reads of low complexity (without their clips, where lclip and rclip are given) don't count. A pair's width spans all
    its other host reads and, if one of those is aligned well, its virus reads.
    """
    side = lambda s: consensus.where(F.col("side") == s).select(F.col("call_id").alias("id"), F.col("seq").alias(f"{s}_seq"))
    joint = calls.select("id", "host_rev", "virus_rev").join(side("host"), "id").join(side("virus"), "id")
    host = F.when(F.col("host_rev"), S.reverse_complement(F.upper("host_seq"))).otherwise(F.upper("host_seq"))
    virus = F.when(F.col("virus_rev"), F.upper("virus_seq")).otherwise(S.reverse_complement(F.upper("virus_seq")))
    joint = joint.select("id", "host_rev", "virus_rev", F.concat(host, virus).alias("target"), F.length(host).alias("junction"))
    own = F.col("seq")
    if "lclip" in support.columns:
        own = F.substring(own, (F.col("lclip") + 1).cast("int"), (F.length("seq") - F.col("lclip") - F.col("rclip")).cast("int"))
    reads = support.where(~S.low_complexity(own)).join(joint, F.col("call_id") == F.col("id"))
    turn = F.when(F.col("side") == "host", F.col("host_rev")).otherwise(~F.col("virus_rev"))
    reads = reads.withColumn("query", F.when(turn, S.reverse_complement(F.col("seq"))).otherwise(F.col("seq")))
    reads = reads.withColumn("a", local_alignment(F.col("query"), F.col("target"), p))
    span = F.greatest(F.col("a.ref_end") - F.col("a.ref_begin"), F.col("a.query_end") - F.col("a.query_begin"))
    reads = reads.withColumn("good", F.col("a.query_end") - F.col("a.query_begin") >= p.good_fraction * F.length("query")).withColumn("bases", span)
    reads = reads.withColumn("spans", (F.col("a.ref_begin") + p.split_flank <= F.col("junction")) & (F.col("a.ref_end") >= F.col("junction") + p.split_flank))
    of = lambda s, c: F.max(F.when((F.col("side") == s) & F.col("good"), c))
    pairs = reads.groupBy("id", "qname").agg(
        of("host", F.lit(1)).alias("h"), of("virus", F.lit(1)).alias("v"),
        (F.max("a.ref_end") - F.min("a.ref_begin")).alias("width"),
        F.sum(F.when(F.col("good"), F.col("a.score"))).alias("score"), F.sum(F.when(F.col("good"), F.col("bases"))).alias("bases"), F.count_if(F.col("good") & F.col("spans")).alias("splits"),
    )
    kept = pairs.where("h = 1")
    good = (F.col("v") == 1) & (F.col("width") <= max_is)
    return kept.groupBy("id").agg(F.count_if(good).alias("good_pairs"), F.sum("splits").cast("long").alias("split_reads"), (F.sum("score") / F.sum("bases")).alias("pbs"))
