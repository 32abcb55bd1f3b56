"""Token counts with a whole-token shortcut.

Beforehand, every string of the vocabulary is encoded once: those that come out
as one token, their own, are proven to encode alone. Texts are cut into
segments (a space and what follows up to the next one), which are always ends
of pre-tokens. A segment that is a proven string counts one; other segments are
split into pre-tokens by the tokenizer's pattern, proven ones count one each,
and only the rest is merged by the library. Counts of segments are remembered.

Texts where a space stands between two other white-space characters are counted
by the library as a whole, as pre-tokens of white space may span segments there.

Defined results: a null text counts as empty, with no tokens; repeated rows and
rows without id get their result each; extra columns stay, and where one has the
name asked for, the result gets that name after underscores.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .bytelevel import Memory, spelled

LIMIT = 512
#: Segments and pre-tokens whose counts a worker remembers, twice.
REMEMBERED = 120_000
BETWEEN = re.compile(r"\s \s")


class Counter:
    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split = regex.compile(pattern).findall
        self.alone = self.proven()
        self.pieces = Memory(self._piece, REMEMBERED)
        self.segments = Memory(self.segment, REMEMBERED)

    def proven(self) -> frozenset[str]:
        """Strings of the vocabulary that encode to their own token alone."""
        vocabulary = self.tokenizer.get_vocab()
        decoded = {i: self.tokenizer.decode([i], skip_special_tokens=False) for i in vocabulary.values()}
        strings = [(i, s) for i, s in decoded.items() if s and "�" not in s and s not in self.special]
        found = self.tokenizer.encode_batch([s for _, s in strings], add_special_tokens=False)
        return frozenset(s for (i, s), e in zip(strings, found, strict=True) if e.ids == [i])

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _piece(self, pretoken: str) -> int:
        """Tokens of a pre-token: one if it is proven, else what the merges leave."""
        return 1 if pretoken in self.alone else len(self.tokenizer.model.tokenize(spelled(pretoken)))

    def segment(self, segment: str) -> int:
        if segment in self.alone:
            return 1
        if any(s in segment for s in self.special):
            return self.whole(segment)
        return sum(map(self.pieces.__getitem__, self.split(segment)))

    def count(self, text: str) -> int:
        if not text:
            return 0
        if BETWEEN.search(text):
            return self.whole(text)
        first, *rest = text.replace(" ", "\0 ").split("\0") if "\0" not in text else re.split("(?= )", text)
        return self.segment(first) * bool(first) + sum(map(self.segments.__getitem__, rest))


@lru_cache(maxsize=4)
def counter(path: str, pattern: str) -> Counter:
    return Counter(path, pattern)


def count_tokens(df: DataFrame, tokenizer: str, pattern: str, text: str = "text", into: str = "n_tokens") -> DataFrame:
    """Adds the number of tokens of each row's whole text, under the name common.free() gives."""

    common.small_batches(df.sparkSession)
    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        count = counter(tokenizer, pattern).count
        return pa.array([count(t or "") for t in common.values(texts)], pa.int64())

    return df.withColumn(common.free(df, into), run(F.col(text)))


def op10_tokens(spark, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return counted.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > LIMIT).alias("over_limit"),
    )
