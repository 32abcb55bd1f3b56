"""Language identification by cross-parsing entropy.

A suffix automaton is built from a bounded sample of labelled text for each
language. A document is parsed greedily against each automaton: a phrase is the
longest match, and the next phrase starts where it ended. The language that
needs the fewest phrases for each character wins. Where even that one needs
nearly as many as for random letters, the text isn't known as that language.

Automata are complete transition tables (state x letter class), so that many
text segments step through all languages at once as numpy vectors.

Defined results: null text, or text without a letter, gives ``und`` with score
0; equal phrase counts go to the language that sorts first; repeated rows get
the same result each; extra columns stay as they are; with no labelled row at
all every document is ``und``. A language is never held against a text where
the sample has no passages left to tell what it may look like.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

UNDETERMINED = "und"
#: Bound of the training sample: characters for each language, and for all of them together.
CHARS_PER_LANGUAGE = 24_000
CHARS_IN_ALL = 400_000
#: Length of a sampled passage, and of the segments that documents are parsed in.
PASSAGE = 300
SEGMENT = 2048
#: Letter classes: 0 stands for a run of anything but letters, the last ones are shared by rarer letters.
MAX_CLASSES = 128
RARE = 8
#: Characters that step together.
BLOCK_CHARS = 1_500_000
FAIL = 1
#: Phrases that any text may have beyond its language's limit; so short texts are hardly ever foreign.
SLACK = 12
#: Share of the phrases of random letters that no text of a language needs; texts in several languages stay under it too.
NOISE = 0.9


@dataclass
class Model:
    languages: list[str]
    letters: str
    width: int
    tables: list[np.ndarray]
    #: Phrases for each code beyond which a text isn't taken for that language.
    limits: list[float]


def suffix_automaton(codes: list[int], width: int) -> np.ndarray:
    """Complete table of the suffix automaton of a code sequence.

    Entry [state * width + class] is the next state's offset times two, plus FAIL where the match ends
    and a new phrase begins with that class. The last state stands before a phrase: parses start there, and
    classes that the sequence doesn't hold lead there.
    """
    link, length, nxt = [-1], [0], [{}]
    last = 0
    for c in codes:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    full = np.full((len(nxt) + 1, width), len(nxt), dtype=np.int32)
    for c, s in nxt[0].items():
        full[:, c] = s
    full *= 2 * width
    full += FAIL
    for s, row in enumerate(nxt):
        for c, to in row.items():
            full[s, c] = 2 * width * to
    return full.ravel()


@lru_cache(maxsize=8)
def _classes(letters: str) -> np.ndarray:
    """Class of every code point."""
    points = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    found = np.zeros(0x110000, dtype=np.uint8)
    rare = np.flatnonzero(points)
    found[rare] = 1 + len(letters) + rare % RARE
    for i, c in enumerate(letters):
        found[ord(c)] = 1 + i
    return found


def _codes(text: str, classes: np.ndarray) -> np.ndarray:
    """Classes of a text; a run without letters is one code."""
    got = classes[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    if len(got) > 1:
        keep = got != 0
        keep[1:] |= got[:-1] != 0
        keep[0] = True
        got = got[keep]
    return got


def _phrases(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Phrases of each text and language.

    Texts are cut into segments that step together. Each is parsed as if a phrase began at its cut, and again
    from the state that the segment before it ended in, until both parses are in one state; where a segment's
    last state changes by that, the one behind it is parsed again. So counts are those of the whole text's parse.
    """
    owner, parts = [], []
    for i, t in enumerate(texts):
        for a in range(0, len(t), SEGMENT):
            owner.append(i)
            parts.append(t[a : a + SEGMENT])
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    order = np.argsort(-sizes, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    grid = np.zeros((SEGMENT, len(parts)), dtype=np.uint8)
    for k, i in enumerate(order):
        grid[: sizes[i], k] = parts[i]
    active = len(parts) - np.searchsorted(np.sort(sizes), np.arange(SEGMENT), side="right")
    out = np.zeros((len(texts), len(model.languages)))
    owner = np.asarray(owner, dtype=np.int64)
    inner = np.flatnonzero(owner[1:] == owner[:-1]) + 1  # segments with one before them
    before = np.full(len(parts), -1, dtype=np.int64)
    before[place[inner]] = place[inner - 1]
    behind = np.full(len(parts), -1, dtype=np.int64)
    behind[place[inner - 1]] = place[inner]
    owner, sizes = owner[order], sizes[order]
    last = np.maximum(sizes - 1, 0)
    steps = int(sizes.max(initial=0))
    found = np.zeros((SEGMENT, len(parts)), dtype=np.int32) if len(inner) else None  # the entry taken at each step
    for lang, moves in enumerate(model.tables):
        state = np.full(len(parts), len(moves) - model.width, dtype=np.int32)
        count = np.zeros(len(parts), dtype=np.int64)
        for step in range(steps):
            n = active[step]
            s = state[:n]
            s += grid[step, :n]
            got = moves.take(s)
            count[:n] += got & 1
            if found is not None:
                found[step, :n] = got
            np.right_shift(got, 1, out=s)
        again = place[inner]
        while len(again):
            old = found[last[again], again].copy()
            who, s = again, found[last[before[again]], before[again]] >> 1
            for step in range(steps):
                going = step < sizes[who]
                who, s = who[going], s[going]
                if not len(who):
                    break
                got, was = moves.take(s + grid[step, who]), found[step, who]
                count[who] += (got & 1) - (was & 1)
                found[step, who] = got
                apart = (got >> 1) != (was >> 1)
                who, s = who[apart], (got >> 1)[apart]
            changed = again[(found[last[again], again] >> 1) != (old >> 1)]
            again = behind[changed]
            again = again[again >= 0]
        out[:, lang] = np.bincount(owner, weights=count, minlength=len(texts))
    return out


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
    """Language and score of each text, and whether it parses as that language at all."""
    classes = _classes(model.letters)
    languages, scores, known = [UNDETERMINED] * len(texts), [0.0] * len(texts), [False] * len(texts)
    block: list[tuple[int, np.ndarray]] = []
    chars = 0

    def flush() -> None:
        counts = _phrases(model, [t for _, t in block])
        for (i, t), row in zip(block, counts, strict=True):
            best = int(row.argmin())
            languages[i] = model.languages[best]
            scores[i] = float(1 / np.exp(np.clip(row[best] - row, -50, 0)).sum())
            known[i] = bool(row[best] <= model.limits[best] * len(t) + SLACK)

    for i, text in enumerate(texts):
        if not text or not model.languages:
            continue
        codes = _codes(text, classes)
        if not codes.any():
            continue
        block.append((i, codes))
        chars += len(codes)
        if chars >= BLOCK_CHARS:
            flush()
            block, chars = [], 0
    if block:
        flush()
    return languages, scores, known


def fit(train: DataFrame, text: str, lang: str, key: str) -> Model:
    """Automata from a bounded sample: whole-table counts give each language's sampling rate, sampled passages come to the driver.

    The sample holds about CHARS_PER_LANGUAGE characters for each language, fewer where CHARS_IN_ALL binds.
    """
    train = train.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(key), F.lit(7)).alias("h")
    )
    counts = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model([], "", 2, [], [])
    size = min(CHARS_PER_LANGUAGE, CHARS_IN_ALL // len(counts))
    wanted = 2 * size / PASSAGE + 20
    rates = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, wanted / n))])
    share = F.pmod(F.col("h"), F.lit(1_000_003)) / 1_000_003
    start = F.pmod(F.shiftright("h", 20), F.greatest(F.lit(1), F.length("text") - PASSAGE)) + 1
    rows = (
        train.where(share < F.element_at(rates, F.col("lang")))
        .select("lang", "h", F.substring("text", start.cast("int"), F.lit(PASSAGE)).alias("passage"))
        .collect()
    )
    passages: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["h"], r["passage"])):
        passages.setdefault(r["lang"], []).append(r["passage"].lower())
    passages = {k: v for k, v in passages.items() if any(c.isalpha() for t in v for c in t)}
    seen: dict[str, int] = {}
    for v in passages.values():
        for c in "".join(v):
            if c.isalpha():
                seen[c] = seen.get(c, 0) + 1
    letters = "".join(sorted(sorted(seen, key=lambda c: (-seen[c], c))[: MAX_CLASSES - 1 - RARE]))
    width = 1 + len(letters) + RARE
    classes = _classes(letters)
    languages = sorted(passages)
    tables = []
    rest: dict[str, list[np.ndarray]] = {}
    for k in languages:
        codes: list[int] = []
        rest_of = []
        for t in passages[k]:
            if len(codes) >= size:
                rest_of.append(_codes(t, classes))
            else:
                codes += [0, *_codes(t, classes).tolist()]
        tables.append(suffix_automaton(codes[:size], width))
        rest[k] = rest_of
    model = Model(languages, letters, width, tables, [float("inf")] * len(languages))
    model.limits = _limits(model, [rest[k] for k in languages])
    return model


def _limits(model: Model, passages: list[list[np.ndarray]]) -> list[float]:
    """NOISE of the phrases that passages which the automata don't hold need with their letters in random order."""
    rng, out = np.random.default_rng(11), []
    for lang, found in enumerate(passages):
        size = sum(map(len, found))
        if size < PASSAGE:
            out.append(float("inf"))
            continue
        mixed = [rng.permutation(t) for t in found]
        out.append(float(NOISE * _phrases(model, mixed)[:, lang].sum() / size))
    return out


def identify(df: DataFrame, model: Model, text: str = "text", into: str = "language") -> DataFrame:
    """Adds a struct (lang, score, known) for each row's whole text, under the name common.free() gives.

    known: whether the text has no more phrases than text of that language may have; lang is the best in any case.
    """
    common.small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by CHARS_IN_ALL x two states x MAX_CLASSES

    @F.arrow_udf("struct<lang:string,score:double,known:boolean>")
    def parse(texts: pa.Array) -> pa.Array:
        found = [predict(shared.value, part.to_pylist()) for part in common.slices(texts)] or [([], [], [])]
        columns = [[x for f in found for x in f[i]] for i in range(3)]
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.bool_()), strict=True)], ["lang", "score", "known"])

    # so that a filter on the result isn't pushed below it, which would parse every text twice
    return df.withColumn(common.free(df, into), parse.asNondeterministic()(F.col(text)))


def train_rows(docs: DataFrame) -> DataFrame:
    return docs.where(~common.held_out("doc_id"))


def op7_language(spark, sf_dir: str) -> DataFrame:
    """Predicted language of every document; learned from the folds that are not held out."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(train_rows(docs), "text", "lang", "doc_id")
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id",
        common.held_out("doc_id").alias("held_out"),
        F.col("language.lang").alias("lang_pred"),
        F.col("language.score").alias("score"),
    )
