"""Reads that disagree with the pileup of their region."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame

from ..params import DEFAULT, Params
from .consensus import STEP
from .sizes import spread


def stretched(seq: str, cigar: str) -> str:
    """A read on the reference, with D for deleted and I for inserted symbols; clips dropped."""
    out, at = [], 0
    for n, op in STEP.findall(cigar):
        n = int(n)
        out.append(seq[at : at + n] if op in "M=X" else "D" * n if op in "DN" else "I" * n if op == "I" else "")
        at += n * (op in "M=XIS")
    return "".join(out)


def homopolymer(text: str, p: Params = DEFAULT) -> tuple[int, int]:
    """[start, end) of the stretch where one base most outweighs the others, if it is long and dense enough; else (0, 0)."""
    best = (0, 0, 0)
    for base in "ACGT":
        total = start = 0
        for i, c in enumerate(text):
            if total <= 0:
                total, start = 0, i
            total += (c == base) - (c in "ACGT" and c != base)
            if total > best[0] or (total == best[0] and total and i + 1 - start < best[2] - best[1]):
                best = (total, start, i + 1)
    score, a, b = best
    top = max((text[a:b].count(c) for c in "ACGT"), default=0)
    return (a, b) if score >= p.homopolymer_score and top >= p.homopolymer_density * (b - a) else (0, 0)


def errors(reads: list[tuple[int, str]], p: Params = DEFAULT) -> list[int]:
    """Errors of each read (start, stretched text) against the plurality of the symbols that are due at each step.

    Outside its homopolymer a read has an error where it differs, and one more where the plurality is a D or I that
    begins there. A plurality of I doesn't move the place where reads enter.
    """
    order = sorted(range(len(reads)), key=lambda i: (reads[i][0], reads[i][0] + len(reads[i][1]), i), reverse=True)
    exempt = [homopolymer(t, p) for _, t in reads]
    found, index = [0] * len(reads), [0] * len(reads)
    active: list[int] = []
    place, before = (reads[order[-1]][0] if order else 0), ""
    while order or active:
        if not active and order and reads[order[-1]][0] > place:
            place = reads[order[-1]][0]
        while order and reads[order[-1]][0] <= place:
            active.append(order.pop())
        due = [(i, reads[i][1][index[i]]) for i in active if index[i] < len(reads[i][1])]
        active = [i for i, _ in due]
        if not due:
            continue
        ranked = Counter(c for _, c in due if c in "ACGTDI").most_common(2)
        symbol = ranked[0][0] if ranked and (len(ranked) == 1 or ranked[0][1] > ranked[1][1]) else "N"
        for i, c in due:
            a, b = exempt[i]
            if c != symbol and not a <= index[i] < b:
                found[i] += 1 + (symbol in "DI" and symbol != before)
            index[i] += 1
        place += symbol != "I"
        before = symbol
    return found


def mismatching(hits: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(region_id, rev, qname) of the names with a read that has errors at more than the rate; hits have seq and cigar."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        reads = [(int(s), stretched(q, c)) for s, q, c in zip(pdf["offset_start"], pdf["seq"], pdf["cigar"], strict=True)]
        span = pdf["offset_end"] - pdf["offset_start"] + 1
        bad = pdf[pd.Series(errors(reads, p), index=pdf.index) > p.mismatch_rate * span]
        return bad[["region_id", "rev", "qname"]].drop_duplicates()

    kinds = {f.name: f.dataType.simpleString() for f in hits.schema}
    return spread(hits, "region_id", "rev").groupBy("region_id", "rev").applyInPandas(one, ", ".join(f"{c} {kinds[c]}" for c in ("region_id", "rev", "qname")))
