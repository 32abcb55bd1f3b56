"""Alignments of many pairs against plain dynamic programming."""

import random

from splicewell.functions.alignment import Alignment, align_many
from splicewell.params import DEFAULT as P


def plain(q, r):
    """One cell at a time; the first end in the reference, then in the query; the way back prefers the diagonal."""
    low = -(10**6)
    h, e, f = ([[v] * (len(r) + 1) for _ in range(len(q) + 1)] for v in (0, low, low))
    for i in range(1, len(q) + 1):
        for j in range(1, len(r) + 1):
            e[i][j] = max(h[i][j - 1] - P.gap_open, e[i][j - 1] - P.gap_extend)
            f[i][j] = max(h[i - 1][j] - P.gap_open, f[i - 1][j] - P.gap_extend)
            h[i][j] = max(0, h[i - 1][j - 1] + (P.match if q[i - 1] == r[j - 1] != "N" else -P.mismatch), e[i][j], f[i][j])
    score = max(map(max, h))
    if not score:
        return Alignment(0, -1, -1, -1, -1, 0, "")
    j, i = min((j, i) for i in range(len(q) + 1) for j in range(len(r) + 1) if h[i][j] == score)
    last, path, state = (i, j), "", "H"
    while state != "H" or h[i][j]:
        if state == "H":
            same = q[i - 1] == r[j - 1] != "N"
            if h[i][j] == h[i - 1][j - 1] + (P.match if same else -P.mismatch):
                path, i, j = ("=" if same else "X") + path, i - 1, j - 1
            else:
                state = "E" if h[i][j] == e[i][j] else "F"
        elif state == "E":
            state = "H" if e[i][j] == h[i][j - 1] - P.gap_open else "E"
            path, j = "D" + path, j - 1
        else:
            state = "H" if f[i][j] == h[i - 1][j] - P.gap_open else "F"
            path, i = "I" + path, i - 1
    cigar, whole = "", "S" * i + path + "S" * (len(q) - last[0])
    while whole:
        n = len(whole) - len(whole.lstrip(whole[0]))
        cigar, whole = f"{cigar}{n}{whole[0]}", whole[n:]
    return Alignment(score, j, last[1] - 1, i, last[0] - 1, sum(c in "XDI" for c in path), cigar)


def test_many_pairs_at_once():
    rng = random.Random(1)
    rand = lambda n, of="ACGT": "".join(rng.choice(of) for _ in range(n))
    pairs = [("ACGT", "ACGT"), ("N", "N"), ("A", "C")]
    for k in range(400):
        if k % 2:
            pairs.append((rand(rng.randint(1, 40), "ACN"), rand(rng.randint(1, 60), "ACN")))
            continue
        ref = rand(rng.randint(40, 160))
        query = list(ref[rng.randint(0, 30) :][: rng.randint(10, 90)])
        for _ in range(rng.randint(0, 5)):
            at, kind = rng.randrange(len(query)), rng.random()
            if kind < 0.4:
                query[at] = rng.choice("ACGT")
            elif kind < 0.7:
                query[at:at] = rand(rng.randint(1, 4))
            elif len(query) > 12:
                del query[at : at + rng.randint(1, 8)]
        pairs.append((rand(rng.randint(0, 12)) + "".join(query), ref))
    assert align_many(pairs) == [plain(q, r) for q, r in pairs]
    none = Alignment(0, -1, -1, -1, -1, 0, "")
    assert align_many([("", "A"), (None, "A"), ("A", None)]) == [none] * 3 and align_many([]) == []
    least = align_many(pairs, least=30)
    assert all(a == (b if b.score >= 30 else none._replace(score=b.score)) for a, b in zip(least, align_many(pairs), strict=True))
