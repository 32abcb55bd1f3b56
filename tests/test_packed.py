"""Packed alignments: written, read, and equal."""

import random

import pytest
from splicewell.sources import files, packed


def test_round_trip(spark, tmp_path):
    rng = random.Random(1)
    rows = []
    for i in range(500):
        m, d = rng.randint(1, 99), rng.choice([0, 0, 3])
        cigar = rng.choice(["", "5S"]) + f"{m}M" + (f"{d}D2I7M" if d else "")
        rows.append((rng.randint(0, 40), f"q{rng.randint(0, 90)}", "ACGT"[: rng.randint(1, 4)], rng.random() < 0.5, cigar, rng.randint(0, 65535), rng.randint(0, 999), m + (d + 7 if d else 0)))
    schema = "region_id int, qname string, seq string, rc boolean, cigar string, offset_start int, score int, span int"
    packed.write(spark.createDataFrame(rows, schema).drop("span").repartition(4), str(tmp_path / "p"))
    found = packed.read(spark, str(tmp_path / "p")).cache()
    got = sorted((r.region_id, r.qname, r.seq, r.rc, r.cigar, r.offset_start, r.score, r.offset_end - r.offset_start) for r in found.collect())
    assert got == sorted(rows)
    ids = {(r.qname, r.seq): r.read_id for r in found.collect()}
    assert sorted(ids.values()) == list(range(len(ids)))
    assert files.packed_alignments(spark, str(tmp_path / "p/alignments")).count() == 500


def test_what_does_not_fit_is_an_error(spark, tmp_path):
    df = spark.createDataFrame([(1, "q", "A", False, "9M", 70000, 5)], "region_id int, qname string, seq string, rc boolean, cigar string, offset_start int, score int")
    with pytest.raises(Exception, match="offset_start doesn't fit into 16 bits"):
        packed.write(df, str(tmp_path / "p"))
