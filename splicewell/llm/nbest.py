"""N-best segmentation into the pieces of a public vocabulary, and decoding.

The lattice of a text has an arc for every piece that matches; where no piece
holds a character alone, its bytes are an arc. Forward Viterbi scores of all
prefixes are exact heuristics for an A-star search from the end backward, whose
hypotheses leave the agenda in order of their full score.

No piece has a space mark behind another character, so the lattice narrows to
one node in front of each run of spaces that follows something, and likewise
between any two characters that no piece holds together. The search runs
between these nodes, is remembered for short stretches, and the n best of a
whole text are the best sums of the n best of its stretches: only the n - 1
stretches whose second choice costs least can differ from the first choice.
How much a second choice costs follows from one pass forward and one backward,
so the search itself runs for these few stretches only.

The vocabulary gives ranks, not probabilities; a piece's score is the logarithm
of Zipf's law at its rank. A byte costs as much as a rank beyond the last, and
ten more.

Defined results: a null or empty text has one segmentation, without pieces,
of score 0; of equally good segmentations the best has the smaller id where they
last differ, and others come in the order they are met; repeated rows get the same result;
extra columns stay. decode() gives back every text that is valid UTF-8.
"""

from __future__ import annotations

import heapq
import math
import re
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .bytelevel import Memory

N = 4
#: Stretches whose results a worker remembers (twice), and their longest.
REMEMBERED, SHORT = 220_000, 48
#: Scores of at most this are marks, not ranks; of pieces that have them, only single characters are used.
UNUSED = -1e8
MARK = "▁"


#: Parts of up to this length are searched together, what is new in so many characters at a time.
TOGETHER, TOGETHER_CHARS = 24, 1_500_000
UNITS = 1_000_000
PRIME = np.uint64(0x9E3779B97F4A7C15)


def _key(piece: str) -> int:
    """A 64-bit key of a string, as vectors() makes it character by character."""
    key = 0
    for c in piece:
        key = (key * int(PRIME) + ord(c) + 1) % (1 << 64)
    return key


def _fixed(score: float) -> float:
    """A score in whole millionths, so that sums are exact and ties are ties in any order of adding."""
    return float(round(score * UNITS))


class Pieces:
    def __init__(self, path: str, n: int = N):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        ranks = {i: -model.get_score(i) for i in plain if model.get_score(i) > UNUSED}
        ranks |= {i: float(size) for i in plain if i not in ranks and len(model.id_to_piece(i)) == 1}
        total = math.log(sum(1 / (r + 1) for r in ranks.values()))
        self.arcs = {model.id_to_piece(i).replace(MARK, " "): ((i,), _fixed(-math.log(r + 1) - total)) for i, r in ranks.items()}
        self.longest = max(map(len, self.arcs))
        self.byte = {int(model.id_to_piece(i)[3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.byte_score = _fixed(-math.log(size + 1) - total - 10)
        self.texts = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else model.id_to_piece(i).replace(MARK, " ").encode() for i in range(size)]
        self.n = n
        self.characters = frozenset(p for p in self.arcs if len(p) == 1)
        #: Pairs of characters that stand together in a piece.
        self.joined = {p[i : i + 2] for p in self.arcs for i in range(len(p) - 1)}
        keyed = sorted((_key(p), i[0], s) for p, (i, s) in self.arcs.items())
        self.keys, self.key_ids, self.key_scores = (np.array(x, dtype=t) for x, t in zip(zip(*keyed, strict=True), (np.uint64, np.int64, np.float64), strict=True))
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have the same key")
        self.stretches = self._cutter()
        self.known = Memory(self.first, REMEMBERED, SHORT)
        self.parts = Memory(self.viterbi, REMEMBERED // 8, SHORT)
        self.searched = Memory(self.search, REMEMBERED // 8, SHORT)

    def _cutter(self):
        """A function that cuts texts where no piece joins: in front of spaces, round control characters, and in front of
        the ASCII signs that pieces hold behind none but such signs.

        Few characters outside ASCII stand before such signs in pieces; texts with one of them are cut at spaces only.
        """
        before: dict[str, set[str]] = {}
        for x, y in self.joined:
            before.setdefault(y, set()).add(x)
        signs = {c for p in self.arcs for c in p if c.isascii() and not c.isalnum() and c != " "}
        while worse := {c for c in signs if any(x.isascii() for x in before.get(c, set()) - signs - {" "})}:
            signs -= worse
        odd = sorted({x for c in signs for x in before.get(c, ()) if not x.isascii()})
        s = "".join(map(re.escape, sorted(signs)))
        c = "".join(re.escape(chr(i)) for i in range(32) if chr(i) not in self.characters and not any(chr(i) in j for j in self.joined))
        plain = re.compile(" *[^ ]+| +").findall
        fine = re.compile(f" *[^ {s}{c}]+|[{c}]| *[{s}]+[^ {s}{c}]*| +").findall if s and c else plain
        return lambda text: plain(text) if any(x in text for x in odd) else fine(text)

    def lattice(self, part: str) -> list[list[tuple[int, tuple[int, ...], float]]]:
        """For each end: (start, ids, score) of the arcs into it."""
        into: list[list] = [[] for _ in range(len(part) + 1)]
        size, get = len(part), self.arcs.get
        for a in range(size):
            if part[a] not in self.arcs:
                ids = tuple([self.byte[x] for x in part[a].encode("utf-8", "surrogatepass")])
                into[a + 1].append((a, ids, len(ids) * self.byte_score))
            for b in range(a + 1, min(size, a + self.longest) + 1):
                arc = get(part[a:b])
                if arc:
                    into[b].append((a, arc[0], arc[1]))
        return into

    def parted(self, stretch: str) -> list[str]:
        """The parts of a stretch that no piece joins."""
        cuts = [i for i in range(1, len(stretch)) if stretch[i - 1 : i + 1] not in self.joined]
        return [stretch[a:b] for a, b in zip([0, *cuts], [*cuts, len(stretch)], strict=True)] if cuts else [stretch]

    def first(self, stretch: str) -> tuple[float, bytes, float]:
        """Score and ids of the best segmentation, and by how much the second best is worse."""
        return self.joint(self.parted(stretch))

    def joint(self, parts: list[str]) -> tuple[float, bytes, float]:
        score, ids, gap = 0.0, b"", math.inf
        for part in parts:
            s, i, g = self.parts[part]
            score, ids, gap = score + s, ids + i, g if g < gap else gap
        return score, ids, gap

    def learn(self, stretches: set[str]) -> None:
        """Remembers new stretches; those without a cut, and of one length, are searched together."""
        new: dict[int, list[str]] = {}
        known, older = self.known, self.known.older
        for s in stretches:
            if s not in known and len(s) <= TOGETHER and self.plain(s):
                if s in older:
                    known.keep(s, older[s])
                else:
                    new.setdefault(len(s), []).append(s)
        for same in new.values():
            for a in range(0, len(same), 20_000):
                some = same[a : a + 20_000]
                for s, found in zip(some, self.vectors(some), strict=True):
                    known.keep(s, found)

    def plain(self, part: str) -> bool:
        """Whether each character is a piece."""
        return self.characters.issuperset(part)

    def vectors(self, parts: list[str]) -> list[tuple[float, bytes, float]]:
        """viterbi() of parts of one length, whose characters are all pieces, as numpy columns."""
        n, size = len(parts), len(parts[0])
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(n, size).astype(np.uint64) + np.uint64(1)
        score, number = {}, {}
        for a in range(size):
            key = np.zeros(n, dtype=np.uint64)
            for b in range(a + 1, min(size, a + self.longest) + 1):
                key = key * PRIME + codes[:, b - 1]
                k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[k] == key
                if hit.any():
                    score[a, b] = np.where(hit, self.key_scores[k], -np.inf)
                    number[a, b] = self.key_ids[k]
        forward, onward = np.full((size + 1, n), -np.inf), np.full((size + 1, n), -np.inf)
        came, taken = np.full((size + 1, n), -1), np.zeros((size + 1, n), dtype=np.int64)
        forward[0] = onward[size] = 0
        for b in range(1, size + 1):
            for a in range(b):
                if (a, b) in score:
                    s = forward[a] + score[a, b]
                    better = (s > forward[b]) | ((s == forward[b]) & (number[a, b] < taken[b]))
                    forward[b] = np.where(better, s, forward[b])
                    came[b] = np.where(better, a, came[b])
                    taken[b] = np.where(better, number[a, b], taken[b])
        on = np.zeros((size + 1, n), dtype=bool)
        on[size] = True
        second = np.full(n, -np.inf)
        for b in range(size, 0, -1):
            for a in range(b):
                if (a, b) in score:
                    s = onward[b] + score[a, b]
                    np.maximum(onward[a], s, out=onward[a])
                    best = on[b] & (came[b] == a)
                    on[a] |= best
                    np.maximum(second, np.where(best, -np.inf, forward[a] + s), out=second)
        ids = taken[1:].T[on[1:].T].astype("<u4").tobytes()
        ends = (4 * np.cumsum(on[1:].sum(axis=0))).tolist()
        gaps = np.maximum(0.0, forward[size] - second).tolist()
        return [(s, ids[x:y], g) for s, x, y, g in zip(forward[size].tolist(), [0, *ends], ends, gaps, strict=False)]

    def viterbi(self, part: str) -> tuple[float, bytes, float]:
        """first() of one part: the best path forward, and the best path through any other arc."""
        into = self.lattice(part)
        forward, came = [0.0], [None]
        for arcs in into[1:]:
            score, _, arc = min((-(forward[a] + s), ids, (a, ids, s)) for a, ids, s in arcs)
            forward.append(-score)
            came.append(arc)
        best, b = {}, len(part)
        while b:
            best[b] = came[b]
            b = came[b][0]
        onward = [-math.inf] * len(part) + [0.0]
        second = -math.inf
        for b in range(len(part), 0, -1):
            rest = onward[b]
            if rest == -math.inf:
                continue
            for arc in into[b]:
                a, _, s = arc
                s += rest
                if s > onward[a]:
                    onward[a] = s
                if best.get(b) != arc and forward[a] + s > second:
                    second = forward[a] + s
        ids = [i for b in sorted(best) for i in best[b][1]]
        return forward[-1], np.array(ids, dtype="<u4").tobytes(), max(0.0, forward[-1] - second)

    def search(self, stretch: str) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations of a stretch: (score, ids), best first."""
        best: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
        for part in self.parted(stretch):
            both = [(-(x + y), i + j) for x, i in best for y, j in self.backward(part)]
            best = [(-x, i) for x, i in heapq.nsmallest(self.n, both)]
        return best

    def backward(self, part: str) -> list[tuple[float, tuple[int, ...]]]:
        """A-star from the end. Hypotheses on the agenda stand for different segmentations with exact scores, so only as many as are still wanted stay."""
        into = self.lattice(part)
        forward = [0.0]
        for arcs in into[1:]:
            forward.append(max(forward[a] + s for a, _, s in arcs))
        found: list = []
        agenda: list[tuple] = [(-forward[-1], 0, (), len(part), 0.0)]
        made = 0
        while agenda and len(found) < self.n:
            _, _, suffix, b, score = agenda.pop(0)
            if b == 0:
                found.append((score, _unlinked(suffix)))
                continue
            for a, ids, s in into[b]:
                made += 1
                agenda.append((-(forward[a] + s + score), made, (ids, suffix), a, s + score))
            agenda.sort()
            del agenda[self.n - len(found) :]
        return found

    def encode_all(self, texts: list[str | None]) -> list:
        """encode() of each text; what is new in about TOGETHER_CHARS characters is searched together."""
        out, block, chars = [], [], 0
        for i, text in enumerate(texts):
            block.append(text)
            chars += len(text or "")
            if chars >= TOGETHER_CHARS or i + 1 == len(texts):
                cut = [self.stretches(" " + t) if t else [] for t in block]
                self.learn(set().union(*cut))
                out += map(self.choose, cut)
                block, chars = [], 0
        return out

    def encode(self, text: str | None) -> tuple[bytes, list[tuple[float, list[tuple[int, int, tuple[int, ...]]]]]]:
        """Ids of the best (little-endian words), and for each of the n best (score in millionths, edits): an edit is (place in the best ids, ids that go, ids that come)."""
        return self.choose(self.stretches(" " + text) if text else [])

    def choose(self, stretches: list[str]) -> tuple[bytes, list]:
        """encode() of a text's stretches."""
        if not stretches:
            return b"", [(0.0, [])]
        firsts = list(map(self.known.__getitem__, stretches))
        scores, own_ids, gaps = map(list, zip(*firsts, strict=True))
        ids, total = b"".join(own_ids), sum(scores)
        free = []
        for _ in range(self.n - 1):
            least = min(gaps)
            if least == math.inf:
                break
            free.append(gaps.index(least))
            gaps[free[-1]] = math.inf
        free.sort()
        choices, at, place, passed = [], [], 0, 0
        for i in free:
            place += sum(map(len, own_ids[passed:i])) // 4
            passed = i
            at.append(place)
            own = np.frombuffer(firsts[i][1], dtype="<u4")
            others = [c for c in self.searched[stretches[i]] if c[1] != tuple(own.tolist())]
            choices.append([(0.0, len(own), ()), *[(max(0.0, firsts[i][0] - s), len(own), x) for s, x in others]])
        ways = []
        for picks in product(*[range(len(c)) for c in choices]):
            ways.append((sum([c[k][0] for c, k in zip(choices, picks, strict=True)]), picks))
        best = [(total - cost, [(a, c[k][1], c[k][2]) for a, c, k in zip(at, choices, picks, strict=True) if k]) for cost, picks in heapq.nsmallest(self.n, ways)]
        return ids, best

    def decode(self, ids) -> str:
        text = b"".join(map(self.texts.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def _unlinked(suffix: tuple) -> tuple[int, ...]:
    out: list[int] = []
    while suffix:
        out += suffix[0]
        suffix = suffix[1]
    return tuple(out)


@lru_cache(maxsize=4)
def pieces(path: str, n: int = N) -> Pieces:
    return Pieces(path, n)


EDIT = pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("ids", pa.list_(pa.int32()))])
BEST = pa.list_(pa.struct([("score", pa.float64()), ("edits", pa.list_(EDIT))]))


def encode_nbest(df: DataFrame, model: str, text: str = "text", n: int = N, into: str = "segmented") -> DataFrame:
    """Adds a struct: ids, the best segmentation as little-endian 32-bit words, and best, the n best as scores and edits of it.

    It gets the name common.free() gives, as the input's columns stay.
    """

    common.small_batches(df.sparkSession)
    @F.arrow_udf("struct<ids:binary,best:array<struct<score:double,edits:array<struct<at:int,drop:int,ids:array<int>>>>>>")
    def run(texts: pa.Array) -> pa.Array:
        def made(part: list) -> pa.Array:
            ids, best = [], []
            for found, ways in pieces(model, n).encode_all(part):
                ids.append(found)
                best.append([{"score": s / UNITS, "edits": [{"at": a, "drop": d, "ids": list(x)} for a, d, x in e]} for s, e in ways])
            return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(best, BEST)], ["ids", "best"])

        return common.mapped(texts, made, pa.struct([("ids", pa.binary()), ("best", BEST)]))

    return df.withColumn(common.free(df, into), run(F.col(text)))


def edited(ids: list[int], edits) -> list[int]:
    """The ids of one of the n best."""
    out, at = [], 0
    for place, drop, new in edits:
        out += [*ids[at:place], *new]
        at = place + drop
    return out + ids[at:]


def decode(df: DataFrame, model: str, ids: str, into: str = "decoded") -> DataFrame:
    """Adds the text of little-endian 32-bit ids."""

    common.small_batches(df.sparkSession)
    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        back = pieces(model).decode
        return pa.array([None if v is None else back(np.frombuffer(v, dtype="<u4").tolist()) for v in common.values(values)], pa.string())

    return df.withColumn(common.free(df, into), run(F.col(ids)))


def op9_nbest(spark, sf_dir: str) -> DataFrame:
    """The four best segmentations of every document, digested, and whether the best decodes to the text."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = encode_nbest(docs, path).select("doc_id", "text", F.col("segmented.ids").alias("ids"), F.col("segmented.best").alias("best"))
    return decode(found, path, "ids").select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_pieces"),
        F.crc32("ids").alias("ids_crc32"),
        F.size("best").cast("long").alias("n_best"),
        F.transform("best", lambda b: F.round(b["score"], 6)).alias("scores"),
        F.transform("best", lambda b: F.aggregate(b["edits"], F.octet_length("ids") / 4, lambda n, e: n - e["drop"] + F.size(e["ids"])).cast("long")).alias("pieces"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )
