"""Expressions that are worked out once, and masks as arrays."""

import random
from collections import Counter

from pyspark.sql import functions as F
from splicewell.functions import sequence
from splicewell.operators import consensus
from splicewell.plans import scalar_queries

SMALL = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def slowly(t, window, threshold):
    """Masks window by window."""
    spans = []
    triplets = [t[i : i + 3] for i in range(len(t) - 2)]
    size = min(window - 2, len(triplets))
    for i in range(len(triplets) - size + 1):
        pairs = sum(n * (n - 1) // 2 for n in Counter(triplets[i : i + size]).values())
        if size > 1 and pairs / (size - 1) > threshold:
            if spans and spans[-1][1] >= i:
                spans[-1][1] = i + size + 2
            else:
                spans.append([i, i + size + 2])
    return [tuple(x) for x in spans]


def test_masks_as_arrays():
    """F16"""
    rng = random.Random(61)
    for n in (0, 1, 2, 3, 4, 5, 30, 64, 65, 66, 300, 300, 300):
        t = "".join(rng.choice("ACGTé") for _ in range(n // 3)) + "AC" * (n // 6) + "".join(rng.choice("ACGT") for _ in range(n - n // 3 - n // 6 * 2))
        for window, threshold in ((64, 2.0), (20, 1.0), (64, 0.5), (10, 0.3)):
            assert consensus.repeats(t, window, threshold) == slowly(t, window, threshold), (n, window)


def test_cigars_are_parsed_once(spark):
    """F13"""
    assert optimized(scalar_queries.cigar_lengths(spark, SMALL)).count("regexp_extract_all") == 1


def test_qualities_are_made_once_for_each_clip(spark):
    """F15"""
    # a slice for either side, each of a bound array
    assert optimized(scalar_queries.clip_qualities(spark, SMALL)).count("slice(") == 2
    df = spark.createDataFrame([([1, 2, 30, 40], 0, False, 2), ([1, 2, 30, 40], 16, False, 2), ([], 0, False, 0), (None, 0, True, 0)], "q array<int>, flag int, rc boolean, clip int")
    rows = df.select(*[sequence.clip_quality(F.col("q"), F.col("flag"), F.col("rc"), F.col("clip"), s).alias(s) for s in "LR"]).collect()
    assert [tuple(r) for r in rows] == [(1, 35), (35, 1), (0, 0), (0, 0)]


def test_pairs_are_counted_once(spark):
    """F17"""
    assert optimized(scalar_queries.low_complexity_reads(spark, SMALL)).count("regexp_count") <= 4


def test_turned_reads_turn_their_qualities(spark):
    """the first quality of a turned read is the last one in the file."""
    found = scalar_queries.turned_reads(spark, SMALL).where("(flag & 16) > 0").collect()
    assert found and all(r.q0 == (r.pos + 7 * len(r.fwd)) % 40 for r in found)
