"""Toxicity by a weighted lexicon, matched with Aho-Corasick.

Texts are folded first: lower case, homoglyphs of other scripts to Latin,
digits and signs inside words to the letters they stand for, everything else
to single spaces. The lexicon holds whole words and word stems whose presence
marks toxic documents; its weights are smoothed log-odds learned from a bounded
sample of labelled documents. Phrases of two words that hold an entry but are
no more frequent in toxic documents are exceptions: they cancel the hit. The
sum of weights is normalised by length, and a logistic curve fitted on the
other part of the sample turns it into a score.

Defined results: null and empty texts score like texts without any hit;
repeated rows get the same result each; labels that are null are not used, and
of several labels for one document the larger counts; extra columns stay, and where
one has the name asked for, the score gets that name after underscores; with
no labelled rows, or none of one kind, every document scores 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bound of the labelled sample, in documents. It bounds the lexicon and the exceptions too, which hold all that qualifies.
MAX_TRAIN = 20_000
#: An entry is in so many toxic documents of the sample at least, and has such log-odds at least.
MIN_TOXIC = 3
MIN_WEIGHT = 1.5
#: Lengths of stems, in letters.
STEMS = range(4, 10)
#: Words that a length is increased by before the square root is taken of it.
LENGTH_OFFSET = 30

# Letters of other scripts that look like Latin ones, and digits and signs used for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ɑ": "a",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}


@lru_cache(maxsize=1)
def _tables() -> tuple[dict, re.Pattern, re.Pattern]:
    fold = {ord(k): v for k, v in HOMOGLYPHS.items()}
    fold |= {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}  # soft hyphen and zero-width signs
    fold |= {0xFF01 + i: chr(0x21 + i) for i in range(94)}  # full-width forms
    letter = r"[^\W\d_]"
    inside = re.compile(rf"(?<={letter})[0134578@$!]+(?={letter})|(?<![^\W_])[134578](?={letter})|(?<={letter})[01345]+(?![^\W_])")
    return fold, inside, re.compile(r"[\W\d_]+")


def folded(text: str | None) -> str:
    """The words of a text after folding, with a space on either side of each."""
    if not text:
        return " "
    fold, inside, gaps = _tables()
    text = text.lower().translate(fold)
    if any(c in text for c in "01345789@$!"):
        text = inside.sub(lambda m: "".join(SUBSTITUTES[c] for c in m[0]), text)
    return " " + gaps.sub(" ", text).strip() + " "


def entries_of(word: str) -> list[str]:
    """What may stand in the lexicon for a word: the word, and its stems. A whole word ends with a space."""
    return [f" {word} ", *(f" {word[:k]}" for k in STEMS if k < len(word))]


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    slope: float = 0.0
    offset: float = -50.0

    def automaton(self) -> ahocorasick.Automaton | None:
        if not self.weights:
            return None
        built = ahocorasick.Automaton()
        for entry, w in self.weights.items():
            built.add_word(entry, (len(entry), w))
        for phrase in self.exceptions:
            built.add_word(phrase, (len(phrase), None))
        built.make_automaton()
        return built


def hits(text: str, automaton: ahocorasick.Automaton) -> dict[int, tuple[int, float]]:
    """Of each word start: the longest entry that matches there, unless an exception covers it."""
    found: dict[int, tuple[int, float]] = {}
    free: list[tuple[int, int]] = []
    for end, (size, w) in automaton.iter(text):
        start = end - size + 1
        if w is None:
            free.append((start, end))
        elif start not in found or found[start][0] < size:
            found[start] = (size, w)
    if free:
        covered, free = 0, sorted(free)
        reach = -1  # the furthest end of the exceptions that start so far
        for start in sorted(found):
            while covered < len(free) and free[covered][0] <= start:
                reach = max(reach, free[covered][1])
                covered += 1
            if start < reach:
                del found[start]
    return found


def intensity(text: str, automaton: ahocorasick.Automaton | None) -> float:
    """Weight of the hits over the square root of the length; more of one entry count as a logarithm."""
    if automaton is None:
        return 0.0
    times: Counter = Counter()
    for start, (size, w) in hits(text, automaton).items():
        times[text[start : start + size], w] += 1
    if not times:
        return 0.0
    total = sum(w * (1 + math.log(n)) for (_, w), n in times.items())
    return total / math.sqrt(text.count(" ") + LENGTH_OFFSET)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve with a weak ridge, by Newton's steps."""
    a, b = 0.0, math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        w = p * (1 - p)
        g = np.array([((p - y) * x).sum() + 0.02 * a, (p - y).sum()])
        h = np.array([[(w * x * x).sum() + 0.02, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - float(step[0]), b - float(step[1])
        if abs(step).max() < 1e-8:
            break
    return a, b


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int) -> DataFrame:
    """At most about ``bound`` labelled documents outside the held-out fold: (text, toxic, part).

    The chosen ids are broadcast (bounded), so that documents aren't shuffled. part is 0 for the lexicon, 1 for the curve.
    """
    known = (
        labels.where(F.col("toxic").isNotNull() & ~common.held_out("doc_id"))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .withColumn("h", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_003)) / 1_000_003)
    )
    n = known.count()
    rate = min(1.0, bound / max(1, n))
    chosen = known.where(F.col("h") < rate).withColumn("part", (F.col("h") / rate * 10 >= 6.5).cast("int"))
    return docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", "toxic", "part")), "doc_id").select("text", "toxic", "part")


def fit(docs: DataFrame, labels: DataFrame, bound: int = MAX_TRAIN) -> Model:
    """Lexicon, exceptions and curve. Counts are made on the executors; what comes to the driver is bounded by the sample."""
    common.small_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, bound).persist()
    try:
        n = {(r["part"], r["toxic"]): r["n"] for r in sample.groupBy("part", F.col("toxic").cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
        n0, n1 = n.get((0, 0), 0), n.get((0, 1), 0)
        if not n0 or not n1:
            return Model()

        @F.arrow_udf("array<string>")
        def words(texts: pa.Array) -> pa.Array:
            made = lambda part: pa.array([sorted({e for w in set(folded(t).split()) for e in entries_of(w)}) for t in part], pa.list_(pa.string()))
            return common.mapped(texts, made, pa.list_(pa.string()))

        smooth = 0.5
        weight = F.log((F.col("n1") + smooth) / (n1 + 2 * smooth)) - F.log((F.col("n0") + smooth) / (n0 + 2 * smooth))
        counts = (
            sample.where("part = 0")
            .select(F.explode(words("text")).alias("entry"), F.col("toxic").cast("int").alias("toxic"))
            .groupBy("entry")
            .agg(F.sum("toxic").alias("n1"), F.sum(1 - F.col("toxic")).alias("n0"))
            .where(F.col("n1") >= MIN_TOXIC)
            .withColumn("w", weight)
            .where(F.col("w") >= MIN_WEIGHT)
        )
        weights = {r["entry"]: r["w"] for r in counts.collect()}
        if not weights:
            return Model()
        model = Model(weights)
        model.exceptions = _exceptions(sample, model, n0, n1)
        model.slope, model.offset = _curve(sample, model)
        return model
    finally:
        sample.unpersist()


def _around(text: str, automaton: ahocorasick.Automaton) -> list[str]:
    """The phrases of two words that hold a hit."""
    got = set()
    for start in hits(text, automaton):
        end = text.index(" ", start + 1)
        before, after = text.rfind(" ", 0, start), text.find(" ", end + 1)
        if start > 0 and before >= 0:
            got.add(text[before : end + 1])
        if after > 0:
            got.add(text[start : after + 1])
    return sorted(got)


def _exceptions(sample: DataFrame, model: Model, n0: int, n1: int) -> list[str]:
    """Two-word phrases with an entry that are in documents of either kind alike."""
    shared = sample.sparkSession.sparkContext.broadcast(model.weights)

    @F.arrow_udf("array<string>")
    def phrases(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = Model(shared.value).automaton()
        for texts in batches:
            yield pa.array([_around(folded(t), automaton) for t in common.values(texts)], pa.list_(pa.string()))

    rows = (
        sample.where("part = 0")
        .select(F.explode(phrases("text")).alias("phrase"), F.col("toxic").cast("int").alias("toxic"))
        .groupBy("phrase")
        .agg(F.sum("toxic").alias("n1"), F.sum(1 - F.col("toxic")).alias("n0"))
        .where((F.col("n0") >= MIN_TOXIC) & (F.col("n1") * n0 <= F.col("n0") * n1))
    )
    return [r["phrase"] for r in rows.collect()]


def _intensity_udf(df: DataFrame, model: Model):
    common.small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = shared.value.automaton()
        for texts in batches:
            yield pa.array([intensity(folded(t), automaton) for t in common.values(texts)], pa.float64())

    return run


def _curve(sample: DataFrame, model: Model) -> tuple[float, float]:
    rows = sample.where("part = 1").select(_intensity_udf(sample, model)("text").alias("x"), F.col("toxic").cast("int").alias("y")).collect()
    x, y = (np.array([r[k] for r in rows], dtype=float) for k in ("x", "y"))
    if len(set(y)) < 2:
        return 4.0, -4.0
    return _logistic(x, y)


def score(df: DataFrame, model: Model, text: str = "text", into: str = "toxicity") -> DataFrame:
    """Adds the score of each row's whole text, 0 to 1; higher is likelier toxic. It gets the name common.free() gives."""
    into = common.free(df, into)
    if not model.weights:
        return df.withColumn(into, F.lit(0.0))
    x = _intensity_udf(df, model)(F.col(text))
    return df.withColumn(into, 1 / (1 + F.exp(-(x * model.slope + model.offset))))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document; learned from labels outside the held-out fold."""
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs, common.table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), model, into="score").select(
        "doc_id", common.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
