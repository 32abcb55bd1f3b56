"""Packing of tokenised documents into fixed windows: bounded-space online best fit.

Each partition keeps a fixed number of open windows. What is left of a document
after its full windows goes to the open window that it fits best. Where it fits
none and all windows are open, the fullest is emitted: the document's head fills
it up first unless only a few tokens of room are left. Leftover windows of all
partitions are merged finally: their pieces are dealt to groups of bounded size
and packed again by best fit, longest first, without further cuts.

A window whose length is a power of two needs no padding; all others count as
padded to the full size.

Defined results: a null text counts as empty and has the end id alone; rows
with a null or repeated id are packed like others; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .bytelevel import Memory, spelled

SIZE = 4096
OPEN = 64
#: Room of the fullest window below which it is emitted with padding instead of cutting a document.
LEAST_CUT = 16
#: Tokens that one task merges finally, at most about.
GROUP_TOKENS = 2_000_000
#: Chunks and pre-tokens whose ids a worker remembers, twice.
REMEMBERED = 120_000
END = 2

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, closed boolean"
FINAL = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit words.

    The tokenizer drops white space and no token spans it, so a text's ids are those of its
    chunks between ASCII white space, which are remembered. Chunks of Latin letters and ASCII
    signs are split into pre-tokens here, which are remembered beside them (a pre-token is a chunk
    that splits into itself); all others, and those that may hold a special token, go to the
    library as they are.
    """

    #: Capital I with a dot grows when lowered, and is left to the library.
    latin = re.compile("[!-~\u00c0-\u012f\u0131-\u024f]+").fullmatch
    split = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+").findall
    #: The same over lowered ASCII; finds less than the whole where there are control characters or others.
    split_ascii = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[!-/:-@\[-`{-~]+").findall

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.chunks = Memory(self._chunk, REMEMBERED)

    def _word(self, word: str) -> bytes:
        return array("I", [t.id for t in self.tokenize(word)]).tobytes()

    def _chunk(self, chunk: bytes) -> bytes:
        low = chunk.lower()
        if low.isalpha():
            return self._word(low.decode()) if low == chunk else self.chunks[low]
        if b"<|" not in chunk:
            parts = self.split_ascii(low)
            if sum(map(len, parts)) == len(low):
                return b"".join(map(self.chunks.__getitem__, parts)) if len(parts) > 1 else self._word(low.decode())
            text = chunk.decode()
            if self.latin(text):
                words = self.split(text.lower())
                return b"".join([self.chunks[w.encode()] for w in words]) if len(words) > 1 else self._word(spelled(words[0]))
        return array("I", self.tokenizer.encode(chunk.decode(), add_special_tokens=False).ids).tobytes()

    def ids(self, text: bytes) -> bytes:
        return b"".join(map(self.chunks.__getitem__, text.split()))


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Windows:
    """Open windows of one partition."""

    def __init__(self, base: int, size: int = SIZE, limit: int = OPEN):
        self.base, self.size, self.limit, self.made = base, size, limit, 0
        self.rooms: list[tuple[int, int]] = []  # (room, window), ascending
        self.rows: dict[int, list] = {}

    def _new(self) -> int:
        self.made += 1
        return self.base + self.made

    def add(self, key, ids: bytes) -> Iterator[tuple]:
        """Places a document; yields the pieces of windows that are emitted."""
        total, at = len(ids) // 4, 0

        def piece(window: int, start: int, length: int, offset: int) -> tuple:
            return (key, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), total, window, offset)

        while total - at >= self.size:
            yield (*piece(self._new(), at, self.size, 0), True)
            at += self.size
        while at < total:
            rest = total - at
            k = bisect_left(self.rooms, (rest, -1))
            if k < len(self.rooms):
                room, window = self.rooms.pop(k)
            elif len(self.rooms) < self.limit:
                room, window = self.size, self._new()
            else:
                room, window = self.rooms.pop(0)
                if room < LEAST_CUT:
                    yield from ((*p, True) for p in self.rows.pop(window))
                    continue
                rest = room
            self.rows.setdefault(window, []).append(piece(window, at, rest, self.size - room))
            at += rest
            if room > rest:
                insort(self.rooms, (room - rest, window))
            else:
                yield from ((*p, True) for p in self.rows.pop(window))

    def leftovers(self) -> Iterator[tuple]:
        for rows in self.rows.values():
            yield from ((*p, False) for p in rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in PIECE.split(", ")]
    kinds = [pa.bool_() if n == "closed" else pa.int64() for n in names]
    columns = list(zip(*rows, strict=True)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def _fill(pieces: pa.Table, size: int) -> pa.Table:
    """Best fit, longest first, of one group's pieces; equal ones in order of their documents, null ids last."""
    order = pc.sort_indices(pieces, sort_keys=[("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
    pieces = pieces.take(order)
    rooms: list[tuple[int, int]] = []
    windows, offsets = [], []
    first, made = pieces["group"][0].as_py(), 0
    for n in pieces["length"].to_pylist():
        k = bisect_left(rooms, (n, -1))
        room, window = rooms.pop(k) if k < len(rooms) else (size, made)
        made += window == made
        windows.append(-1 - ((first << 33) + window))
        offsets.append(size - room)
        if room > n:
            insort(rooms, (room - n, window))
    made_here = {"sequence_id": pa.array(windows, pa.int64()), "offset": pa.array(offsets, pa.int64())}
    return pa.table({c: made_here.get(c, pieces[c]) for c in FINAL})


def pack(df: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", end: int = END, size: int = SIZE) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for each piece.

    Sequences of the first pass have ids from the partition's number up; those of the final merge are negative.
    """
    common.small_batches(df.sparkSession)
    tail = np.array([end], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        windows = Windows(TaskContext.get().partitionId() << 33, size)
        for batch in batches:
            rows: list[tuple] = []
            for part in common.slices(batch):
                for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    rows.extend(windows.add(k, encode.ids(t or b"") + tail))
            yield _batch(rows)
        yield _batch(list(windows.leftovers()))

    made = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(run, PIECE)
    pieces = common.Written(made).df
    left = pieces.where(~F.col("closed"))
    tokens = left.agg(F.sum("length")).first()[0] or 0
    n = max(1, -(-tokens // GROUP_TOKENS))
    dealt = left.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "sequence_id"), F.lit(n)))
    merged = dealt.groupBy("group").applyInArrow(lambda g: _fill(g, size), ", ".join(x for x in PIECE.split(", ") if not x.startswith("closed")))
    return pieces.where("closed").select(FINAL).unionByName(merged.select(FINAL))


def op3_packing(spark, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 4096 tokens."""
    import public_tokenizers

    return pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
