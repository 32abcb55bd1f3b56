"""Packed k-mers and the map that rules most of them out, against brute force."""

import random

import pytest
from pyspark.sql import functions as F
from splicewell.functions import packed, sequence
from splicewell.operators import associate, screen

K = 13


def rand(rng, n, letters="ACGT"):
    return "".join(rng.choice(letters) for _ in range(n))


def rc(s):
    return "".join(c if c in "ACGT" else "N" for c in s)[::-1].translate(str.maketrans("ACGT", "TGCA"))


@pytest.mark.parametrize("bits", [9, 26])
def test_candidates_leave_no_shared_kmer_out(spark, bits):
    """F8: a full map lets more through, never less; characters of several bytes count as one."""
    rng = random.Random(41)
    target = rand(rng, 200, "ACGTN")
    reads = [rand(rng, 30) + target[50:90] + "é" + rand(rng, 30), rc(target[20:60]), rand(rng, 400), "ACG", "", None]
    index = {target[i : i + K] for i in range(len(target) - K + 1)}
    map_ = packed.index_map(spark.createDataFrame([(x,) for x in index], "kmer string"), K, bits)
    df = spark.createDataFrame(list(enumerate(reads)), "read_id int, seq string")
    rows = df.select("read_id", F.inline(packed.candidates(df, "seq", K, map_, bits, ways=packed.BOTH_WAYS))).collect()
    every = [(i, way, at, s[at : at + K]) for i, r in enumerate(reads) if r for way, s in ((False, r), (True, rc(r))) for at in range(len(s) - K + 1)]
    got = {tuple(r) for r in rows}
    assert {x for x in every if x[3] in index} <= got <= set(every)
    assert bits < 26 or len(got) < len(every) / 2


def test_the_screen_turns_few_kmers_into_rows(spark, monkeypatch):
    """k-mers that no seed can match don't become rows."""
    rng = random.Random(42)
    target = rand(rng, 300)
    reads = [(0, rand(rng, 3000)), (1, rand(rng, 500) + target[100:140] + rand(rng, 500)), (2, rand(rng, 50) + "N" * 20)]
    whole, seen = packed.candidates, []

    def counted(df, *args, **kinds):
        seen.append(df.select(F.sum(F.size(whole(df, *args, **kinds)))).first()[0])
        return whole(df, *args, **kinds)

    monkeypatch.setattr(packed, "candidates", counted)
    df, t = spark.createDataFrame(reads, "read_id long, seq string"), spark.createDataFrame([(1, target)], "region_id long, seq string")
    assert [r.read_id for r in screen.screen(df, t).collect()] == [1]
    assert associate.shared_kmers(df, t).select("read_id", "rc").collect() == [(1, False)]
    assert len(seen) == 2 and max(seen) < 200


def test_seeds_are_those_of_the_sequence(spark):
    kmer = "ACGTTGCANGGTACCATG"
    made = spark.createDataFrame([(kmer,)], "kmer string").select(F.inline(sequence.spaced_seeds(F.col("kmer")))).collect()
    for r in made:
        assert packed.seeds(packed.packed_strings([kmer], 18), r.j)[0] == packed.packed_strings([r.seed], 15)[0] == packed.packed(packed.symbols(r.seed), 15)[0]


def _summary(spark, seqs):
    df = spark.createDataFrame([(seqs,)], "seqs array<string>")
    return df.select(packed.kmer_summary(F.col("seqs"), K).alias("s")).first().s


def test_kmers_are_counted_without_rows(spark):
    """counts over all sequences of one id."""
    seqs = ["ACGT" * 20, None, "ACG", "TTTTACGTACGTACGTN"]
    every = [s[i : i + K] for s in seqs if s for i in range(len(s) - K + 1)]
    found = _summary(spark, seqs)
    assert (found.n, found.n_distinct) == (len(every), len(set(every)))
    assert _summary(spark, ["ACG"]) is None and _summary(spark, []) is None


def test_valid_kmers_are_counted_without_rows(spark):
    """k-mers of nearly one base, and the most frequent base."""
    seqs = ["A" * 11 + "CG" + "ACGTTGCA" * 3, "G" * 13]
    most = [max(s[i : i + K].count(b) for b in "ACGT") for s in seqs for i in range(len(s) - K + 1)]
    found = _summary(spark, seqs)
    assert (found.n_valid, found.most) == (sum(m < 11 for m in most), 13)
