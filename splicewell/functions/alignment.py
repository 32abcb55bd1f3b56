"""Local alignment with affine gaps, many pairs at once by anti-diagonals; an Arrow UDF over distinct pairs.

A gap of n costs open + (n - 1) * extend. Of equal best cells the first in the
reference wins, then the smallest query end; the traceback prefers the diagonal.
Anything that isn't equal to a base of the other side counts as a mismatch,
N included.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import DEFAULT, Params

LOW = -(10**6)


class Alignment(NamedTuple):
    score: int
    ref_begin: int
    ref_end: int
    query_begin: int
    query_end: int
    mismatches: int
    cigar: str


NONE = Alignment(0, -1, -1, -1, -1, 0, "")


#: Cells of all pairs of a sweep on one anti-diagonal, and those of the matrices kept for the way back.
SWEEP, KEPT = 1 << 15, 1 << 22


def _sweep(queries: list[str], refs: list[str], p: Params, keep: bool) -> tuple:
    """Scores of the pairs, with the end of each best alignment; with keep also the three matrices, by anti-diagonal.

    On diagonal d, index i stands for the cell (i, d - i). Shorter sequences are filled up with symbols that match
    nothing, so no best cell lies there.
    """
    count, n, m = len(queries), max(map(len, queries)), max(map(len, refs))
    q, r = np.zeros((count, n + 1), dtype=np.uint8), np.ones((count, m + 1), dtype=np.uint8)
    for k, (a, b) in enumerate(zip(queries, refs, strict=True)):
        q[k, 1 : len(a) + 1] = np.frombuffer(a.encode("ascii", "replace"), dtype=np.uint8)
        r[k, 1 : len(b) + 1] = np.frombuffer(b.encode("ascii", "replace"), dtype=np.uint8)
    q[q == ord("N")] = 0
    turned = np.ascontiguousarray(r[:, ::-1])
    costs = (p.match, p.mismatch, p.gap_open, p.gap_extend)
    kind = np.int16 if (n + 1) * max(map(abs, costs)) < 10_000 else np.int32
    match, mismatch, gap_open, gap_extend = map(kind, costs)
    low = kind(LOW if kind is np.int32 else -20_000)
    best, end_i, end_j = np.zeros(count, dtype=kind), np.zeros(count, dtype=np.int64), np.full(count, m + 1)
    blank = lambda fill: np.full((count, n + 2), fill, dtype=kind)
    h1, h2, e1, f1 = blank(0), blank(0), blank(low), blank(low)
    held: list[tuple] = [(h2, e1, f1), (h1, e1, f1)]
    for d in range(2, n + m + 1):
        lo, hi = max(1, d - m), min(n, d - 1)
        here, above = slice(lo, hi + 1), slice(lo - 1, hi)
        h, e, f = blank(0), blank(low), blank(low)
        np.maximum(h1[:, here] - gap_open, e1[:, here] - gap_extend, out=e[:, here])
        np.maximum(h1[:, above] - gap_open, f1[:, above] - gap_extend, out=f[:, here])
        same = q[:, here] == turned[:, m - d + lo : m - d + hi + 1]
        step = h2[:, above] + np.where(same, match, -mismatch)
        np.maximum(np.maximum(step, kind(0)), np.maximum(e[:, here], f[:, here]), out=h[:, here])
        top = h[:, here].max(axis=1)
        if (live := np.flatnonzero((top >= best) & (top > 0))).size:
            i = hi - np.argmax(h[live, here][:, ::-1] == top[live, None], axis=1)
            j = d - i
            better = (top[live] > best[live]) | (j < end_j[live]) | ((j == end_j[live]) & (i < end_i[live]))
            at = live[better]
            best[at], end_i[at], end_j[at] = top[at], i[better], j[better]
        if keep:
            held.append((h, e, f))
        h2, h1, e1, f1 = h1, h, e, f
    return best, end_i, end_j, held


def _way_back(query: str, ref: str, end_i: int, end_j: int, score: int, k: int, held: list[tuple], shift: int, p: Params) -> Alignment:
    """The alignment that ends in a cell, by the pair's matrices, which begin shift symbols into the reference."""
    i, j, ops, wrong, state = end_i, end_j, [], 0, "H"
    cell = lambda which, a, b: held[a + b][which][k, a]
    while not (state == "H" and cell(0, i, j) == 0):
        if state == "H":
            same = query[i - 1] == ref[j - 1] != "N"
            if cell(0, i, j) == cell(0, i - 1, j - 1) + (p.match if same else -p.mismatch):
                ops.append("=" if same else "X")
                wrong += not same
                i, j = i - 1, j - 1
            else:
                state = "E" if cell(0, i, j) == cell(1, i, j) else "F"
        elif state == "E":
            ops.append("D")
            wrong += 1
            state = "H" if cell(1, i, j) == cell(0, i, j - 1) - p.gap_open else "E"
            j -= 1
        else:
            ops.append("I")
            wrong += 1
            state = "H" if cell(2, i, j) == cell(0, i - 1, j) - p.gap_open else "F"
            i -= 1
    runs: list[list] = []
    for op in reversed(ops):
        if runs and runs[-1][1] == op:
            runs[-1][0] += 1
        else:
            runs.append([1, op])
    cigar = "".join(f"{n}{op}" for n, op in ([[i, "S"]] if i else []) + runs + ([[len(query) - end_i, "S"]] if len(query) > end_i else []))
    return Alignment(score, shift + j, shift + end_j - 1, i, end_i - 1, wrong, cigar)


def _whole(query: str, ref: str, p: Params) -> Alignment | None:
    """The best alignment of a query that lies whole in the reference: no other scores as much, and none ends before the first such place."""
    if p.match <= 0 or p.mismatch < 0 or p.gap_open <= 0 or p.gap_extend < 0 or "N" in query or not (query.isascii() and ref.isascii()):
        return None
    at, n = ref.find(query), len(query)
    return Alignment(n * p.match, at, at + n - 1, 0, n - 1, 0, f"{n}=") if at >= 0 else None


def align_many(pairs: list[tuple[str | None, str | None]], p: Params = DEFAULT, least: int = 1) -> list[Alignment]:
    """Best local alignments of (query, reference) pairs; positions are inclusive. Below the least score only the score is told.

    Pairs of like lengths are swept together: once for scores and ends, and again, over the stretch of the reference
    that the best alignment can reach, for the way back. An alignment of positive score deletes fewer symbols of the
    reference than it matches, so that stretch is twice as long as the query at most. A query that lies whole in the
    reference needs no sweep.
    """
    found: list[Alignment | None] = [_whole(q, r, p) if q and r else NONE for q, r in pairs]
    found = [NONE._replace(score=x.score) if x and x.score < least else x for x in found]
    order = sorted((i for i, x in enumerate(found) if x is None), key=lambda i: (len(pairs[i][0]), len(pairs[i][1])))

    def blocks(items: list, width, most: int):
        at = 0
        while at < len(items):
            size, stop = width(items[at]), at + 1
            while stop < len(items) and (stop - at + 1) * max(size, width(items[stop])) <= most:
                size, stop = max(size, width(items[stop])), stop + 1
            yield items[at:stop]
            at = stop

    ends = []
    for block in blocks(order, lambda i: len(pairs[i][0]), SWEEP):
        best, end_i, end_j, _ = _sweep([pairs[i][0] for i in block], [pairs[i][1] for i in block], p, False)
        for i, score, a, b in zip(block, best.tolist(), end_i.tolist(), end_j.tolist(), strict=True):
            if score >= max(1, least):
                ends.append((i, score, a, b))
            else:
                found[i] = NONE._replace(score=score)
    ends.sort(key=lambda x: x[2])
    for block in blocks(ends, lambda x: 3 * x[2] * (x[2] + 2), KEPT):
        queries = [pairs[i][0][:a] for i, _, a, _ in block]
        shifts = [max(0, b - 2 * a) for _, _, a, b in block]
        refs = [pairs[i][1][s:b] for (i, _, _, b), s in zip(block, shifts, strict=True)]
        held = _sweep(queries, refs, p, True)[3]
        for k, ((i, score, a, b), s) in enumerate(zip(block, shifts, strict=True)):
            found[i] = _way_back(pairs[i][0], refs[k], a, b - s, score, k, held, s, p)
    return found


def align(query: str | None, ref: str | None, p: Params = DEFAULT) -> Alignment:
    """Best local alignment of one pair; score 0 if nothing matches."""
    return align_many([(query, ref)], p)[0]


SCHEMA = "struct<score:int,ref_begin:int,ref_end:int,query_begin:int,query_end:int,mismatches:int,cigar:string>"


def local_alignment(query: Column, ref: Column, p: Params = DEFAULT, least: int = 1) -> Column:
    """The alignment struct of two sequence columns; below the least score only the score is told."""

    @F.arrow_udf(SCHEMA)
    def run(queries: pa.Array, refs: pa.Array) -> pa.Array:
        rows = align_many(list(zip(queries.to_pylist(), refs.to_pylist(), strict=True)), p, least)
        kinds = {k: pa.string() if k == "cigar" else pa.int32() for k in Alignment._fields}
        return pa.StructArray.from_arrays([pa.array([getattr(x, k) for x in rows], t) for k, t in kinds.items()], list(kinds))

    return run(query, ref)


def accepted(found: Column, query: Column, p: Params = DEFAULT) -> Column:
    """Span and score are long enough, and not clipped long on both sides."""
    left, right = found["query_begin"], F.length(query) - 1 - found["query_end"]
    return (found["ref_end"] - found["ref_begin"] + 1 >= p.min_span) & (found["score"] >= p.min_score) & ~((left >= p.min_clip) & (right >= p.min_clip))
