"""Operators of the junction engine: goldens, brute force and planted truth."""

import random

import pytest
from pyspark.sql import functions as F
from splicewell.operators import assign, associate, calls, consensus, evidence, intervals, mismatch, pairs, screen
from splicewell.params import Params
from splicewell.plans import pipeline, registry
from splicewell.sources import files
from splicewell.streaming import screen as stream


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def rand(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def test_insert_size(spark):
    df = spark.createDataFrame([(x,) for x in (300, 310, 320, 400, 450)], "size int")
    row = pairs.insert_size(df, "size").first()
    assert (row.n, row["mean"], row.upper_sd, row.max_is) == (5, 356, 73, 721)


def test_coverage(spark):
    rows = [("a", 10, 19), ("a", 15, 29), ("a", 40, 49), ("b", 0, 9), ("b", 5, 19)]
    df = spark.createDataFrame(rows, "k string, s int, e int")
    got = {r.k: r.covered for r in intervals.covered(df, ["k"], "s", "e").collect()}
    exact = {r.k: r.covered for r in intervals.covered(df, ["k"], "s", "e", compat=False).collect()}
    assert got == {"a": 31, "b": 20} and exact == {"a": 30, "b": 20}


def test_overlap_join_by_force(spark):
    rng = random.Random(2)
    make = lambda n: [(i, rng.randint(0, 3), a, a + rng.randint(0, 300)) for i in range(n) for a in [rng.randint(0, 3000)]]
    a, b = make(150), make(170)
    schema = "id int, contig int, start int, end int"
    got = {(r.a_id, r.b_id) for r in intervals.overlap_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["contig"], 64).collect()}
    assert got == {(x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3]}


def test_clusters_stay_short():
    rng = random.Random(3)
    spans = [(a, a + rng.randint(20, 90)) for a in (rng.randint(0, 4000) for _ in range(200))]
    merged = intervals.agglomerate(spans, 300)
    assert all(b - a + 1 <= 300 for a, b in merged)
    assert all(any(m[0] <= s[0] and s[1] <= m[1] for m in merged) for s in spans)
    assert intervals.agglomerate([(0, 50), (20, 70), (500, 560)], 300) == [(0, 70), (500, 560)]


def test_dense_ids(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 5), rng.randint(0, 10**6)) for _ in range(300)]
    df = spark.createDataFrame(rows, "contig int, start int").distinct()
    got = sorted((r.region_id, r.contig, r.start) for r in evidence.dense_ids(df, "contig", ["start"]).collect())
    assert got == [(i, *x) for i, x in enumerate(sorted(set(rows)))]


def test_screen_finds_planted_reads(spark):
    rng = random.Random(5)
    target = rand(rng, 500)
    noisy = target[100:160][:30] + "A" + target[131:160]
    reads = [(0, rand(rng, 100)), (1, target[50:150]), (2, rc(target[200:290])), (3, noisy), (4, "A" * 100), (5, "ACG"), (6, None)]
    df, t = spark.createDataFrame(reads, "read_id long, seq string"), spark.createDataFrame([(1, target), (2, "A" * 50)], "region_id long, seq string")
    assert {r.read_id for r in screen.screen(df, t).collect()} == {1, 2, 3}


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(6)
    target = rand(rng, 400)
    df = spark.createDataFrame([(i, target[10 * i : 10 * i + 60] if i % 3 else rand(rng, 60)) for i in range(30)], "read_id long, seq string")
    t = spark.createDataFrame([(1, target)], "region_id long, seq string")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.screen_stream(source, t, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {r.read_id for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r.read_id for r in screen.screen(df, t).collect()} and len(got) >= 19


def test_reconciliation(spark):
    rows = [("m", False, True, 1), ("m", True, True, 2), ("h", False, False, 1), ("h", False, True, 2), ("v", True, True, 1), ("v", True, False, 2), ("x", True, True, 1)]
    got = pairs.reconcile(spark.createDataFrame(rows, "qname string, is_virus boolean, towards boolean, pos int"), "qname", ["pos"]).collect()
    of = lambda q: sorted((r.gains, r.anchor, r.at_clip, r.secondary, r.flipped) for r in got if r.qname == q)
    assert of("m") == [("host", 1, False, False, False), ("host", 2, False, True, True), ("virus", 2, False, False, False)]
    assert of("h") == [("host", 1, False, True, True), ("host", 2, False, False, False), ("virus", 1, True, False, False)]
    assert of("v") == [("host", 1, False, True, True), ("host", 2, True, False, False), ("virus", 1, False, False, False)]
    assert of("x") == []


def test_right_clip_quirk(spark):
    df = spark.createDataFrame([("A" * 50 + "C" * 25, 0, 25)], "seq string, l int, r int")
    assert pairs.clips(df, "seq", "l", "r").first().clip_seq == "A" + "C" * 24
    assert pairs.clips(df, "seq", "l", "r", Params(compat=False)).first().clip_seq == "C" * 25


def test_consensus():
    assert consensus.consensus("ACGTACGTAC", [], 0, 10) == "A"
    assert consensus.consensus("ACGTACGT", [(2, "GTAC"), (2, "GTAC")], 0, 8) == "ACGTACGT"
    assert consensus.consensus("ACGTACGT", [(0, "ACCTACGT")] * 2 + [(0, "ACGTACGT")], 0, 8) == "ACCTACGT"
    assert consensus.consensus("ACGTACGT", [(0, "ACDTACGT")] * 2, 0, 8) == "ACTACGT"
    assert consensus.consensus("ACGTACGT", [(0, "ACGaTACGT")] * 2 + [(0, "ACGTACGT")], 0, 8) == "ACGaTACGT"
    assert consensus.consensus("ACGTACGT", [(0, "TTTTTTTT")], 2, 6) == "GTAC"
    assert consensus.rebase("AACCGG", "1S2M1I1D2M") == "ACcDGG"


def test_masks(spark):
    rng = random.Random(7)
    df = spark.createDataFrame([(1, rand(rng, 300)), (2, rand(rng, 150) + "AC" * 60 + rand(rng, 150)), (3, "ACG"), (4, None)], "id int, seq string")
    got = consensus.low_complexity_masks(df, "id", "seq", threshold=4.0).collect()
    assert {r.id for r in got} == {2}
    assert min(r.start for r in got) >= 90 and max(r.end for r in got) <= 330


def test_mismatches(spark):
    assert mismatch.stretched("AACCGG", "1S2M1I1D2M") == "ACIDGG"[:3] + "D" + "GG"
    good, bad = "ACGTACGTACGTACGTACGT", "TTGTACCTACGTACGTACGA"
    assert mismatch.errors([(0, good), (0, good), (0, bad)]) == [0, 0, 4]
    assert mismatch.errors([(0, "ACGT"), (0, "ACGT"), (2, "GTAC")]) == [0, 0, 0]
    assert mismatch.errors([(0, "ACDDGT")] * 2 + [(0, "ACCCGT")]) == [0, 0, 3]
    assert mismatch.homopolymer("ACGT" + "A" * 14 + "CGT") == (4, 18) and mismatch.homopolymer("ACGT" * 10) == (0, 0)
    rows = [(1, False, f"q{i}", 0, 20, bad if i == 3 else good, "20M") for i in range(5)]
    df = spark.createDataFrame(rows, "region_id int, rev boolean, qname string, offset_start int, offset_end int, seq string, cigar string")
    assert [r.qname for r in mismatch.mismatching(df).collect()] == ["q3"]


def greedy_by_force(rows, least):
    used, out = set(), []
    while True:
        best = None
        for key in {r[:2] for r in rows}:
            sums = {}
            for r in rows:
                if r[:2] == key and r[4] not in used:
                    s = sums.setdefault(r[2:4], [0, 0])
                    s[0] += r[5]
                    s[1] += r[6]
            for o, (h, v) in sums.items():
                entry = (h, key[0], not key[1] * -1, v)
                rank = ((h, key[0], key[1]), (h, v, -o[0], not o[1]), key, o)
                del entry
                best = max(best, rank) if best else rank
        if not best or best[0][0] <= least:
            return out
        names = {r[4] for r in rows if r[:2] == best[2] and r[2:4] == best[3] and r[4] not in used}
        out.append((best[0][0], best[2], frozenset(names)))
        used |= names


def test_greedy_by_force():
    import pandas as pd

    rng = random.Random(8)
    for _ in range(15):
        rows = list({(rng.randint(0, 3), False, rng.randint(0, 2), bool(rng.randint(0, 1)), f"q{rng.randint(0, 12)}"): (rng.randint(20, 60), rng.randint(20, 60)) for _ in range(50)}.items())
        flat = [(*k, *v) for k, v in rows]
        df = pd.DataFrame(flat, columns=["region_id", "rev", "virus_region", "virus_rev", "qname", "h_score", "v_score"])
        got = assign.greedy(df, 100)
        made = [(s, k, frozenset(g["qname"])) for (s, *k), g in got.groupby(["call_score", "region_id", "rev"])]
        expected = [(s, list(k), n) for s, k, n in greedy_by_force(flat, 100)]
        assert sorted((s, n) for s, _, n in made) == sorted((s, n) for s, _, n in expected)


def test_components_equal_one_group(spark):
    import pandas as pd

    rng = random.Random(9)
    rows = [(5 * c + rng.randint(0, 4), False, rng.randint(0, 2), False, f"q{c}_{rng.randint(0, 15)}", 40 + rng.randint(0, 9), 50) for c in range(6) for _ in range(40)]
    rows = [(*k, *v) for k, v in {r[:5]: r[5:] for r in rows}.items()]
    df = spark.createDataFrame(rows, "region_id long, rev boolean, virus_region long, virus_rev boolean, qname string, h_score long, v_score long")
    apart = {(r.region_id, r.virus_region, r.qname, r.call_score) for r in assign.assign(df).collect()}
    whole = assign.greedy(pd.DataFrame(rows, columns=df.columns), 100)
    assert apart == set(whole[["region_id", "virus_region", "qname", "call_score"]].itertuples(index=False, name=None))


@pytest.mark.parametrize("parts", [1, 5])
def test_planted_junctions(spark, parts):
    rng = random.Random(4)
    host, virus = {"chr1": rand(rng, 12000), "chr2": rand(rng, 9000)}, {"v1": rand(rng, 3000), "v2": rand(rng, 2500)}
    truth = [("chr1", 4000, "v1", 700), ("chr1", 9000, "v2", 1200), ("chr2", 5000, "v1", 2100)]
    rows = []
    for t, (c, hp, v, vp) in enumerate(truth):
        for i in range(30):
            at = hp - 100 - rng.randint(0, 150)
            rows.append((f"q{t}_{i}", c, "F", at, host[c][at : at + 100], rc(virus[v][vp + rng.randint(0, 120) :][:100])))
    rows += [(f"d{i}", "chr2", "F", at, host["chr2"][at : at + 100], rand(rng, 100)) for i in range(8) for at in [rng.randint(0, 8000)]]
    rng.shuffle(rows)
    table = lambda d: spark.createDataFrame(list(d.items()), "name string, seq string")
    df = spark.createDataFrame(rows, "qname string, host_contig string, host_strand string, host_pos int, host_seq string, virus_seq string").repartition(parts)
    got = pipeline.junctions(df, table(host), table(virus), 400).orderBy("host_chr", "host_pos").collect()
    assert [(r.host_chr, r.virus_chr) for r in got] == [(c, v) for c, _, v, _ in truth]
    assert all(abs(r.host_pos - hp) <= 40 and abs(r.virus_pos - vp) <= 10 and r.pairs >= 28 for r, (_, hp, _, vp) in zip(got, truth, strict=True))


def test_redundant_calls(spark):
    rng = random.Random(10)
    h, v = rand(rng, 200), rand(rng, 200)
    rows = [(1, h, v, False, False), (2, h[10:190], v[:180], False, False), (3, rc(h), v, True, False), (4, h, rand(rng, 200), False, False), (5, rand(rng, 200), rand(rng, 200), False, False)]
    df = spark.createDataFrame(rows, "id long, host_seq string, virus_seq string, host_rev boolean, virus_rev boolean")
    assert {r.id for r in calls.redundant(df).collect()} == {2, 3}


def test_pairing_uses_each_call_once(spark):
    rows = [(1, 1, False, 100, False), (2, 1, True, 300, True), (3, 1, True, 150, True), (4, 1, False, 120, False), (5, 2, True, 110, True)]
    df = spark.createDataFrame(rows, "id long, host_chr int, host_rev boolean, host_pos int, virus_rev boolean")
    got = {r.id: r.paired_with for r in calls.pair_up(df, Params(compat=False)).collect()}
    assert all(got[got[i]] == i for i in got) and 5 not in got and len(got) == 4


def test_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first\nACGT\nAC\n>two\nGG\n")
    assert {(r.name, r.seq) for r in files.fasta(spark, str(tmp_path / "a.fa")).collect()} == {("one", "ACGTAC"), ("two", "GG")}
    for m in (1, 2):
        (tmp_path / f"r{m}.fq").write_text("".join(f"@q{i}/{m}\n{'ACGT'[i % 4] * 5}\n+\n@IIII\n" for i in range(40)))
    got = files.fastq_pairs(spark, str(tmp_path / "r1.fq"), str(tmp_path / "r2.fq")).orderBy("ordinal").collect()
    assert [(r.qname, r.seq1, r.qual2) for r in got] == [(f"q{i}", "ACGT"[i % 4] * 5, "@IIII") for i in range(40)]
    (tmp_path / "x.sam").write_text("@HD\tVN:1\nq\t16\tc\t11\t9\t3S4M\t=\t21\t30\tACGTACG\tIIIIIII\tXA:Z:d,-5,7M,0;\tNM:i:1\n")
    r = files.sam(spark, str(tmp_path / "x.sam")).first()
    assert (r.pos, r.mate_contig, r.mate_pos, r.qual[0], r.tags["XA"], [tuple(c) for c in r.cigar]) == (10, "c", 20, 40, "d,-5,7M,0;", [(3, "S"), (4, "M")])
    import struct

    (tmp_path / "p.bin").write_bytes(struct.pack("<IIIHH", 7, 9, (1 << 31) + 4, 300, 77) + struct.pack("<IIIHH", 1, 2, 3, 4, 5))
    assert sorted(map(tuple, files.packed_alignments(spark, str(tmp_path / "p.bin")).collect())) == [(1, 2, False, 3, 4, 5), (7, 9, True, 4, 300, 77)]
    (tmp_path / "c.txt").write_text("threads 4\nmax_is  700\n")
    assert files.settings(spark, str(tmp_path / "c.txt")) == {"threads": "4", "max_is": "700"}
    files.write_fastq(files.fastq(spark, str(tmp_path / "r1.fq")), str(tmp_path / "out"))
    assert files.fastq(spark, str(tmp_path / "out")).count() == 40
    regions = spark.createDataFrame([("a", 0, 10), ("a", 100, 190), ("b", 5, 6)], "contig string, start int, end int")
    places = files.sampled_places(spark, regions, 500, 3).collect()
    assert len(places) == 500 and all(any(r.contig == c and s <= r.pos < e for c, s, e in [("a", 0, 10), ("a", 100, 190), ("b", 5, 6)]) for r in places)


def test_realign_keeps_near_best(spark):
    rng = random.Random(11)
    region = rand(rng, 300)
    reads = spark.createDataFrame([(1, region[20:120]), (2, rc(region[100:200])), (3, rand(rng, 100)), (4, "A" * 60)], "read_id long, seq string")
    got = associate.realign(reads, spark.createDataFrame([(9, region)], "region_id long, seq string")).collect()
    assert {(r.read_id, r.rc, r.score, r.ref_begin) for r in got} == {(1, False, 100, 20), (2, True, 100, 100)}


def test_oracles_cover_plain_queries():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert len(registry.QUERIES) - len(registry.ORACLES) <= 9


def test_low_complexity_by_force(spark):
    """The bound counts one symbol more than there are; pairs with other symbols don't count."""
    from splicewell.functions import sequence

    rng = random.Random(21)
    texts = ["", "A", "AAAA", "ACACACAC", "ACGT", "NNNN", "AANAA"] + ["".join(rng.choice("AACN") for _ in range(rng.randint(2, 14))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, seq string")
    got = {r.id: r.low for r in df.select("id", sequence.low_complexity(F.col("seq")).alias("low")).collect()}
    for i, t in enumerate(texts):
        counts = sorted((sum(t[k : k + 2] == a + b for k in range(len(t) - 1)) for a in "ACGT" for b in "ACGT"), reverse=True)
        assert got[i] == (counts[0] + counts[1] >= 0.75 * (len(t) + 1)), t


def test_windows_at_the_extremity(spark):
    """A single clip counts where the reads begin or end; else the sliding scores tell."""
    rows = [(1, True, "a", 5, 50, 30, 9, 0), (1, True, "b", 20, 60, 30, 0, 0), (2, True, "a", 5, 50, 30, 0, 0), (2, True, "b", 20, 60, 30, 9, 0), (3, False, "a", 5, 50, 30, 0, 9), (3, False, "b", 0, 90, 30, 0, 0), (4, True, "a", 0, 40, 30, 0, 0), (4, True, "b", 70, 90, 80, 0, 0)]
    df = spark.createDataFrame(rows, "region_id int, rev boolean, qname string, offset_start long, offset_end long, score long, lclip int, rclip int")
    got = {r.region_id: (r.low, r.high) for r in evidence.accept_windows(df, 40).collect()}
    assert got == {1: (5, 45), 2: (5, 45), 3: (10, 50), 4: (0, 40)}


def test_conformance_by_rule(spark):
    """Either clip, on either strand, on either side of the edge, but only with good qualities."""
    rows = [("in", 100, 150, 0, 0, 0, 0), ("left", 140, 180, 11, 0, 10, 0), ("poor", 140, 180, 11, 0, 9, 0), ("right", 120, 150, 0, 11, 0, 10), ("out", 90, 120, 0, 0, 0, 0), ("near", 110, 195, 11, 11, 30, 30)]
    df = spark.createDataFrame([(1, rev, *r) for r in rows for rev in (False, True)], "region_id int, rev boolean, qname string, offset_start int, offset_end int, lclip int, rclip int, lclip_quality int, rclip_quality int")
    windows = spark.createDataFrame([(1, False, 100, 200), (1, True, 100, 200)], "region_id int, rev boolean, low int, high int")
    assert sorted((r.qname, r.rev) for r in evidence.conforming(df, windows).collect()) == sorted((q, v) for q in ("in", "poor", "near") for v in (False, True))


def test_rejected_mates_by_force(spark):
    rng = random.Random(31)
    make = lambda ids: [(i, rng.randint(0, 1), rng.random() < 0.5, rng.randint(0, 4000), rng.random() < 0.5) for i in ids]
    good, bad, paired = make(range(60)), make(range(100, 190)), {3, 8, 20}
    schema = "id long, host_chr int, host_rev boolean, host_pos long, virus_rev boolean"
    got = calls.pair_rejected(spark.createDataFrame(good, schema), spark.createDataFrame(bad, schema), spark.createDataFrame([(i,) for i in paired], "id long"))
    free, wanted = {b[0]: b for b in bad}, {}
    for a in good:
        best = None
        for b in free.values():
            gap = a[3] - b[3] if a[2] else b[3] - a[3]
            if a[0] not in paired and a[1] == b[1] and a[2] != b[2] and a[4] != b[4] and -50 <= gap <= 1000 and (best is None or (abs(gap), b[0]) < best):
                best = (abs(gap), b[0])
        if best:
            wanted[best[1]] = a[0]
            del free[best[1]]
    assert {r.id: r.paired_with for r in got.collect()} == wanted and len(wanted) > 15


def test_bed_fasta_and_reads_by_call(spark, tmp_path):
    (tmp_path / "x.bed").write_text("chr1\t5\t9\nchr2\t0\t3\textra\n")
    rows = files.bed(spark, str(tmp_path / "x.bed")).collect()
    assert sorted((r[0], r[1], r[2]) for r in rows) == [("chr1", 5, 9), ("chr2", 0, 3)]
