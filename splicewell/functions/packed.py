"""k-mers as numbers: counts of a sequence's k-mers, and a bounded map that tells most k-mers which aren't in an index.

Two bits a symbol, and above them a bit for each symbol that isn't upper-case ACGT.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the map: 8 MB, whatever the index.
MAP_BITS = 26
#: Symbols of the sequences that become objects at a time.
STEP = 1 << 22

CODES = np.full(256, 4, dtype=np.uint8)
CODES[np.frombuffer(b"ACGT", dtype=np.uint8)] = range(4)


def symbols(seq: str, turned: bool = False) -> np.ndarray:
    """0 to 3 for ACGT and 4 for all else, one for each character; turned: of the reverse complement."""
    found = CODES[np.frombuffer(seq.encode("ascii", "replace"), dtype=np.uint8)]
    return np.where(found < 4, 3 - found, 4)[::-1] if turned else found


def _rolled(values: np.ndarray, k: int, bits: int) -> np.ndarray:
    """Each k neighbours as one number, from spans of doubled width."""
    out, width, span, taken = None, 1, values, 0
    while True:
        if k & width:
            n = len(values) - k + 1
            part = span[taken : taken + n]
            out = part if out is None else (out << (bits * width)) | part
            taken += width
        width *= 2
        if width > k:
            return out
        half = width // 2
        span = (span[:-half] << (bits * half)) | span[half:]


def packed(found: np.ndarray, k: int) -> np.ndarray:
    """The k-mers of symbols() in order, as numbers; k is 21 at most."""
    if len(found) < k:
        return np.zeros(0, dtype=np.int64)
    other = found > 3
    out = _rolled(np.where(other, 0, found).astype(np.int64), k, 2)
    return out | (_rolled(other.astype(np.int64), k, 1) << (2 * k)) if other.any() else out


def most_frequent(found: np.ndarray, k: int) -> np.ndarray:
    """How often the most frequent base occurs in each k-mer."""
    sums = [np.concatenate(([0], np.cumsum(found == b, dtype=np.int32))) for b in range(4)]
    return np.maximum.reduce([s[k:] - s[:-k] for s in sums])


def _values(texts: pa.Array) -> Iterator:
    step = max(1, STEP * len(texts) // max(1, texts.nbytes))
    for at in range(0, len(texts), step):
        yield from texts[at : at + step].to_pylist()


def kmer_summary(seqs: Column, k: int) -> Column:
    """(n, n_distinct, n_valid, most) of the k-mers of an array of sequences; null where there are none.

    n_valid: those that aren't nearly one base, as in sequence.valid_kmer(); most: the most frequent base's count in any.
    Symbols other than ACGT are told apart from those, but not from each other.
    """
    fields = ("n", "n_distinct", "n_valid", "most")

    @F.arrow_udf(", ".join(f"{c} long" for c in fields))
    def run(rows: pa.Array) -> pa.Array:
        out = []
        for row in _values(rows):
            found = [symbols(x) for x in row or [] if x is not None and len(x) >= k]
            if not found:
                out.append(None)
                continue
            kmers, most = np.sort(np.concatenate([packed(x, k) for x in found])), np.concatenate([most_frequent(x, k) for x in found])
            out.append(dict(zip(fields, (len(kmers), 1 + int(np.count_nonzero(kmers[1:] != kmers[:-1])), int((most < k - 2).sum()), int(most.max())), strict=True)))
        return pa.array(out, pa.struct([(c, pa.int64()) for c in fields]))

    return run(seqs)


def packed_strings(kmers: list[str], k: int) -> np.ndarray:
    """packed() of strings of k symbols each."""
    found = CODES[np.frombuffer("".join(kmers).encode("ascii", "replace"), dtype=np.uint8)].reshape(-1, k)
    out, other = np.zeros(len(found), dtype=np.int64), np.zeros(len(found), dtype=np.int64)
    for column in found.T:
        out, other = (out << 2) | np.where(column > 3, 0, column), (other << 1) | (column > 3)
    return out | (other << (2 * k))


def seeds(kmers: np.ndarray, j: int, k: int = 18) -> np.ndarray:
    """packed() of what sequence.spaced_seed() leaves of packed k-mers."""
    two, other = kmers & ((1 << (2 * k)) - 1), kmers >> (2 * k)
    cut = lambda x, bits: ((x >> (bits * (3 * j + 3))) << (bits * 3 * j)) | (x & ((1 << (bits * 3 * j)) - 1))
    return cut(two, 2) | (cut(other, 1) << (2 * (k - 3)))


def places(codes: np.ndarray, bits: int, salt: int = 0) -> np.ndarray:
    """Where numbers lie in a map."""
    return (codes ^ (codes >> bits) ^ (salt * 0x9E3779B1)) & ((1 << bits) - 1)


def index_map(kmers: DataFrame, k: int, bits: int = MAP_BITS) -> np.ndarray:
    """The map of a column of strings of k symbols, or of two columns (salt, string), as bytes.

    Tasks give words of it, which are put together by a grouping; what is collected is no more than the map.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            salt = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64) if b.num_columns > 1 else 0
            at = np.unique(places(packed_strings(b.column(b.num_columns - 1).to_pylist(), k), bits, salt))
            word, first = np.unique(at >> 6, return_index=True)
            found = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first) if len(at) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.int64()), pa.array(found.view(np.int64), pa.int64())], ["word", "bits"])

    rows = kmers.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return out.view(np.uint8)


def _in_map(at: np.ndarray, map_: np.ndarray) -> np.ndarray:
    return (map_[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


BOTH_WAYS = (False, True)


def candidates(df: DataFrame, seq: str, k: int, map_: np.ndarray, bits: int = MAP_BITS, segments: int = 0, ways: tuple = (False,)) -> Column:
    """Structs (rc, pos, kmer) of a sequence's k-mers that a map doesn't rule out; the index itself has to tell about the rest.

    segments: the map holds spaced seeds (salted by j), of which one is enough. ways: as it is, or also turned.
    """
    shared = df.sparkSession.sparkContext.broadcast(map_)
    kind = pa.list_(pa.struct([("rc", pa.bool_()), ("pos", pa.int32()), ("kmer", pa.string())]))

    @F.arrow_udf("array<struct<rc:boolean,pos:int,kmer:string>>")
    def run(texts: pa.Array) -> pa.Array:
        rows = []
        for t in _values(texts):
            out = []
            for rc in ways if t is not None and len(t) >= k else ():
                found = symbols(t, rc)
                codes = packed(found, k)
                if segments:
                    hit = np.zeros(len(codes), dtype=bool)
                    for j in range(segments):
                        hit |= _in_map(places(seeds(codes, j, k), bits, j), shared.value)
                else:
                    hit = _in_map(places(codes, bits), shared.value)
                at = np.flatnonzero(hit).tolist()
                if at:
                    whole = np.frombuffer(b"ACGTN", dtype=np.uint8)[found].tobytes().decode() if rc else t
                    out += [{"rc": rc, "pos": i, "kmer": whole[i : i + k]} for i in at]
            rows.append(out)
        return pa.array(rows, kind)

    return run(F.col(seq))
