"""Hand goldens and properties of the scalar functions, alignment and CIGAR."""

import random

import pytest
from pyspark.sql import functions as F
from splicewell.functions import alignment, sequence
from splicewell.functions import cigar as C
from splicewell.operators import calls
from splicewell.params import DEFAULT

REF = "ACGTTGCAAGCTTACGGATCCATGCAATTGCCGGATACGTTAACG"


def one(spark, **columns):
    return spark.range(1).select(*[v.alias(k) for k, v in columns.items()]).first()


def test_spaced_seeds_and_packing(spark):
    kmer = F.lit("ACGTACGGTTCAGATCCA")
    row = one(spark, **{f"s{j}": sequence.spaced_seed(kmer, j) for j in range(6)}, **{f"p{j}": sequence.two_bit(sequence.spaced_seed(kmer, j), 15) for j in range(6)})
    assert [row[f"s{j}"] for j in range(6)] == ["ACGTACGGTTCAGAT", "ACGTACGGTTCACCA", "ACGTACGGTGATCCA", "ACGTACTCAGATCCA", "ACGGGTTCAGATCCA", "TACGGTTCAGATCCA"]
    assert [row[f"p{j}"] for j in range(6)] == [113687843, 113687828, 113686740, 113723604, 112150740, 833571028]


def test_reverse_complement(spark):
    row = one(spark, a=sequence.reverse_complement(F.lit("ACGTN")), b=sequence.reverse_complement(F.lit("acGT")))
    assert (row.a, row.b) == ("NACGT", "ACNN")


@pytest.mark.parametrize("kmer,ok", [("A" * 13 + "CG", False), ("A" * 12 + "CGT", True), ("A" * 11 + "CG", False), ("A" * 10 + "CGT", True)])
def test_valid_kmer(spark, kmer, ok):
    assert one(spark, v=sequence.valid_kmer(F.lit(kmer))).v == ok


def test_anchor_distance(spark):
    d = lambda *x: sequence.anchor_distance(*map(F.lit, x))
    row = one(spark, a=d(100, 200, 150, 250), b=d(100, 200, 230, 300))
    assert (row.a, row.b) == (-49, 30)


def test_kmers_across_tiles(spark):
    rng = random.Random(1)
    for n in (0, 12, 13, 211, 212, 213, 1000):
        s = "".join(rng.choice("ACGT") for _ in range(n))
        assert one(spark, k=sequence.kmers(F.lit(s), 13)).k == [s[i : i + 13] for i in range(n - 12)]


def test_region_snap_and_circle(spark):
    low, high = sequence.region_snap(F.lit(1234), F.lit(2100), F.lit(8000))
    low2, high2 = sequence.region_snap(F.lit(7600), F.lit(7900), F.lit(7950))
    row = one(spark, a=low, b=high, c=low2, d=high2, e=F.length(sequence.circular(F.lit("ACGTACG"))), f=sequence.original_length(F.lit(10)), g=sequence.original_length(F.lit(12)), h=sequence.original_length(F.lit(7)))
    assert tuple(row) == (1000, 2500, 7500, 7950, 10, 7, 8, 5)


def test_alignment_goldens():
    found = [alignment.align(q, REF) for q in (REF[5:40], REF[5:20] + REF[22:40], REF[5:20] + "N" + REF[21:40])]
    assert [(a.score, a.ref_end, a.query_end) for a in found] == [(35, 39, 34), (26, 39, 32), (30, 39, 34)]
    assert alignment.align("", REF).score == 0 and alignment.align("NNN", REF).score == 0


def textbook(q, r, p=DEFAULT):
    """Gotoh's recurrences, cell by cell."""
    n, m, best = len(q), len(r), 0
    h = [[0] * (m + 1) for _ in range(n + 1)]
    e = [[-(10**6)] * (m + 1) for _ in range(n + 1)]
    f = [[-(10**6)] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            e[i][j] = max(h[i][j - 1] - p.gap_open, e[i][j - 1] - p.gap_extend)
            f[i][j] = max(h[i - 1][j] - p.gap_open, f[i - 1][j] - p.gap_extend)
            h[i][j] = max(0, h[i - 1][j - 1] + (p.match if q[i - 1] == r[j - 1] != "N" else -p.mismatch), e[i][j], f[i][j])
            best = max(best, h[i][j])
    return best


def test_alignment_equals_textbook():
    rng = random.Random(5)
    for _ in range(60):
        r = "".join(rng.choice("ACGTN") for _ in range(rng.randint(1, 60)))
        q = "".join(c if rng.random() > 0.1 else rng.choice(["", "A", "GG"]) for c in r[rng.randint(0, 5) :]) or "A"
        a = alignment.align(q, r)
        assert a.score == textbook(q, r)
        if a.score:
            steps = [(int(n), op) for n, op in __import__("re").findall(r"(\d+)([=XIDS])", a.cigar)]
            assert sum(n for n, op in steps if op in "=XIS") == len(q)
            assert sum(n for n, op in steps if op in "=XD") == a.ref_end - a.ref_begin + 1
            cost = sum({"=": n, "X": -4 * n, "I": -6 - (n - 1), "D": -6 - (n - 1), "S": 0}[op] for n, op in steps)
            assert cost == a.score


def test_cigar(spark):
    text = F.lit("5S10=2X3I4D7M1S")
    ops = C.parse(text)
    row = one(spark, q=C.query_length(ops), r=C.reference_length(ops), left=C.clip(ops, "L"), right=C.clip(ops, "R"), n=C.text(C.normalise(ops)), t=C.text(ops), none=C.query_length(C.parse(F.lit("*"))))
    assert tuple(row) == (28, 23, 5, 1, "5S12M3I4D7M1S", "5S10=2X3I4D7M1S", 0)


def test_acceptance_table(spark):
    rows = [
        (0.93, 4, 0, 200, 200, 0.3, 0, 0, True), (0.93, 3, 0, 200, 200, 0.3, 0, 0, False), (0.93, 3, 1, 200, 200, 0.3, 0, 0, True), (0.70, 10, 5, 200, 200, 0.3, 0, 0, False),
        (0.70, 3, 0, 200, 200, 0.5, 0, 0, True), (0.70, 2, 9, 200, 200, 0.9, 0, 0, False), (0.93, 10, 5, 40, 200, 0.3, 0, 0, False), (0.93, 10, 5, 200, 200, 0.6, 170, 0, False), (0.93, 10, 5, 200, 200, 0.6, 160, 0, True),
    ]
    df = spark.createDataFrame(rows, "pbs double, good_pairs int, split_reads int, host_len int, virus_len int, coverage double, host_masked int, virus_masked int, expected boolean")
    assert df.withColumn("ok", calls.verdict(100)).where("ok <> expected").count() == 0


def test_call_text(spark):
    row = dict(id=0, host="chr13:-73788865", virus="type16:-3383", good_pairs=700, split_reads=725, host_pbs=0.927897, host_cov=0.684993, virus_cov=0.684993, paired_with=None)
    df = spark.createDataFrame([tuple(row.values())], "id int, host string, virus string, good_pairs int, split_reads int, host_pbs double, host_cov double, virus_cov double, paired_with int")
    assert df.select(calls.human_text().alias("t")).first().t == "ID=0 chr13:-73788865 type16:-3383 SUPPORTING_PAIRS=700 SPLIT_READS=725 HOST_PBS=0.927897 COVERAGE=0.684993"
