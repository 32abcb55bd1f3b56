"""I-Match document fingerprints with randomised lexicons.

The lexicon holds the terms within a band of inverse document frequency: in
at most MOST of the documents, and in at least LEAST of them. As a document
counts once for each of its distinct terms, there are at most (distinct terms in
a document, on average) / LEAST terms in the band, whatever the size of the
corpus. A document's distinct lexicon terms, and the FEW terms of all its own
with the smallest hashes, are sorted; several random subsets of the lexicon, of
sampling rates 1/2, 1/4, ... each keep some of them, and each subset's sorted
terms are hashed.

The fingerprint is the list of these hashes, four hex digits each, ``0000``
where a subset keeps nothing of the document. Likeness of two fingerprints is
the share of equal hashes, over subsets that keep something of either, at the
rates where at most OPEN of the subsets do so; equal fingerprints have
likeness 1.

Defined results: a null text counts as empty; an empty text's fingerprint is
all zeros; rows in order of doc_id take null ids first and equal ids in the
order of their texts' hashes; the last document's next is the first, also where
it is the only one.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

LEAST, MOST = 1 / 1000, 1 / 4
FEW = 8
SCALES, REPEATS = 10, 14
OPEN = 0.75
#: Documents in a range of ids that is dealt out as one; beyond so many ranges, ranges get larger.
RANGE_ROWS, RANGES = 1500, 50_000
WORD = re.compile(r"[^\W_]+").findall

#: A term is in a subset if its hash times the subset's odd salt, in 32 bits, is under the subset's limit.
_SALTS = np.array([xxhash.xxh32_intdigest(f"lexicon {k}", 7) | 1 for k in range(SCALES * REPEATS)], dtype=np.uint32)[:, None]
_LIMITS = np.array([1 << (31 - k // REPEATS) for k in range(SCALES * REPEATS)], dtype=np.uint32)[:, None]


def terms(text: str) -> list[int]:
    """Hashes of the distinct words of a text."""
    h = xxhash.xxh64_intdigest
    return [h(w.encode("utf-8", "surrogatepass"), 42) for w in set(WORD(text.lower()))]


def lexicon(df: DataFrame, text: str) -> tuple[int, ...]:
    """Term hashes within the band, counted over all documents; the driver gets the band, whose size doesn't grow with the corpus."""

    common.small_batches(df.sparkSession)
    @F.arrow_udf("array<long>")
    def run(texts: pa.Array) -> pa.Array:
        made = lambda part: common.lists([np.array(terms(t or ""), dtype=np.uint64).view(np.int64) for t in part], pa.int64())
        return common.mapped(texts, made, pa.list_(pa.int64()))

    n = df.count()
    counted = df.select(F.explode(run(F.col(text))).alias("term")).groupBy("term").count()
    band = counted.where(F.col("count").between(max(2, n * LEAST), max(2, n * MOST)))
    return tuple(sorted(r["term"] for r in band.select("term").collect()))


class Prints:
    """Fingerprints by one lexicon."""

    def __init__(self, lexicon: tuple[int, ...]):
        self.lexicon = frozenset(t % (1 << 64) for t in lexicon)

    def of(self, text: str) -> np.ndarray:
        """The 16-bit hashes of a text's subsets."""
        all_terms = terms(text)
        kept = self.lexicon.intersection(all_terms).union(heapq.nsmallest(FEW, all_terms))
        out = np.zeros(len(_SALTS), dtype=np.uint16)
        if not kept:
            return out
        ordered = np.sort(np.fromiter(kept, dtype=np.uint64, count=len(kept)))
        inside = ordered.astype(np.uint32)[None, :] * _SALTS < _LIMITS
        rows, columns = np.nonzero(inside)
        blob, h = ordered[columns].tobytes(), xxhash.xxh64_intdigest
        ends = (8 * np.cumsum(np.bincount(rows, minlength=len(out)))).tolist()
        start = 0
        for k, end in enumerate(ends):
            if end > start:
                out[k] = 1 + h(blob[start:end], k) % 65535
            start = end
        return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if (a == b).all():
        return 1.0
    either = ((a != 0) | (b != 0)).reshape(SCALES, REPEATS)
    equal = ((a == b) & (a != 0)).reshape(SCALES, REPEATS)
    use = either.mean(axis=1) <= OPEN
    if not either[use].any():
        use = np.ones(SCALES, dtype=bool)
    return float(equal[use].sum() / either[use].sum())


def written(a: np.ndarray) -> str:
    return a.astype(">u2").tobytes().hex()


def _bounds(keys: DataFrame, n: int) -> list[tuple[int, int]]:
    """Where n ranges of about equal size begin, in order of (key, hash): about n pairs.

    Places between different keys come from the keys' quantiles; a key with more rows than a range is cut by hash.
    """
    if n < 2:
        return []
    found = keys.agg(F.percentile_approx("__key", [i / n for i in range(1, n)], max(10_000, 5 * n)).alias("b")).first()["b"]
    hits: dict[int, int] = {}
    for b in found:
        hits[b] = hits.get(b, 0) + 1
    out = []
    for b, times in hits.items():
        out.append((b, -(2**63)))
        if times > 1:  # about so many ranges lie within one key
            out += [(b, -(2**63) + k * (2**64 // times)) for k in range(1, times)]
            out.append((b + 1, -(2**63)))
    return sorted(set(out))


def in_order(df: DataFrame, key: str, text: str) -> DataFrame:
    """Deals rows out by ranges of (key, hash of the text), in order within, each range with a copy of the next range's first row.

    Adds __range, __key, __hash and __copy (whether the row is such a copy). The last range gets a copy of the first row of
    all. What comes to the driver and is sent to the tasks are the ranges' bounds and first rows, two longs each. Rows
    that are equal in key and text stay in one range.
    """
    session = df.sparkSession
    df = df.withColumn("__key", F.coalesce(F.col(key).cast("long"), F.lit(-(2**63)))).withColumn("__hash", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    keys = df.select("__key", "__hash")
    n = max(1, min(RANGES, keys.count() // RANGE_ROWS))
    bounds = session.sparkContext.broadcast(_bounds(keys, n))

    @F.arrow_udf("int")
    def position(key: pa.Array, hash_: pa.Array) -> pa.Array:
        return pa.array([bisect_right(bounds.value, x) for x in zip(key.to_pylist(), hash_.to_pylist(), strict=True)], pa.int32())

    first = keys.groupBy(position("__key", "__hash").alias("range")).agg(F.min(F.struct("__key", "__hash")).alias("first")).collect()
    first = sorted((r["range"], tuple(r["first"])) for r in first)
    # the first row of a range goes to the range before it, that of the first one to the last
    copies = session.sparkContext.broadcast({x: first[i - 1][0] for i, (_, x) in enumerate(first)})

    @F.arrow_udf("array<int>")
    def places(key: pa.Array, hash_: pa.Array) -> pa.Array:
        out = []
        for x in zip(key.to_pylist(), hash_.to_pylist(), strict=True):
            to = copies.value.get(x)
            out.append([bisect_right(bounds.value, x)] + ([] if to is None else [to]))
        return pa.array(out, pa.list_(pa.int32()))

    dealt = df.select("*", F.posexplode(places("__key", "__hash")).alias("__copy", "__range")).withColumn("__copy", F.col("__copy") > 0)
    return dealt.repartition(max(1, len(first)), "__range")


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint(df: DataFrame, known: tuple[int, ...], text: str = "text", into: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint of each row's whole text, for a lexicon made by lexicon(), under the name common.free() gives."""
    shared = df.sparkSession.sparkContext.broadcast(known)

    common.small_batches(df.sparkSession)
    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        prints = Prints(shared.value)
        for texts in batches:
            yield pa.array([written(prints.of(t or "")) for t in common.values(texts)], pa.string())

    return df.withColumn(common.free(df, into), run(F.col(text)))


def with_edits(df: DataFrame, known: tuple[int, ...], text: str = "text", key: str = "doc_id") -> DataFrame:
    """Fingerprints of every document and of its edited text: its last half gives way to the front of the next document."""
    common.small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(known)
    names = [x.split()[0] for x in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Prints(shared.value)
        last = None  # (range, id, text, fingerprint) of the row that waits for its next one
        for batch in batches:
            rows = []
            for at, copy, key_, text_ in (row for part in common.slices(batch) for row in zip(*[c.to_pylist() for c in part.columns], strict=True)):
                text_ = text_ or ""
                mine = prints.of(text_)
                if last and last[0] == at:
                    n = len(last[2])
                    edited = last[2][: n - n // 2] + text_[: n // 2]
                    other = prints.of(edited)
                    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    rows.append((last[1], n, digest, written(last[3]), written(other), likeness(last[3], other), likeness(last[3], mine)))
                last = None if copy else (at, key_, text_, mine)
            columns = list(zip(*rows, strict=True)) or [[] for _ in names]
            kinds = {"doc_id": pa.int64(), "n_chars": pa.int64(), "near_edited": pa.float64(), "near_next": pa.float64()}
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds.get(k, pa.string())) for k, c in zip(names, columns, strict=True)], names=names)

    dealt = in_order(df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), "doc_id", "text")
    # copies sort behind all rows of their range; in the last range their keys are smaller
    dealt = dealt.sortWithinPartitions("__range", "__copy", "__key", "__hash")
    return dealt.select("__range", "__copy", "doc_id", "text").mapInArrow(run, RESULT)


def op6_imatch(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_edits(docs, lexicon(docs, "text"))
