"""Assignment and pairing without one task for a connected whole."""

import random

import pandas as pd
import pytest
from splicewell.operators import assign, calls
from splicewell.params import Params


@pytest.mark.parametrize("last", [0, 150])
def test_one_large_component_is_assigned_in_rounds(spark, monkeypatch, last):
    rng = random.Random(12)
    spots = {(rng.randint(0, 5), bool(rng.randint(0, 1)), rng.randint(0, 3), bool(rng.randint(0, 1)), f"q{rng.randint(0, 60)}"): (rng.randint(20, 24), rng.randint(20, 22)) for _ in range(500)}
    rows = [(*k, *v) for k, v in spots.items()]
    sizes = spark.sparkContext.accumulator(0)
    force = assign.greedy

    def counted(g, least):
        sizes.add(len(g))
        return force(g, least)

    monkeypatch.setattr(assign, "greedy", counted)
    monkeypatch.setattr(assign, "LAST", last, raising=False)
    df = spark.createDataFrame(rows, "region_id long, rev boolean, virus_region long, virus_rev boolean, qname string, h_score long, v_score long")
    got = [tuple(r) for r in assign.assign(df).collect()]
    expected = list(force(pd.DataFrame(rows, columns=df.columns), 100).itertuples(index=False, name=None))
    assert sorted(got) == sorted(expected) and len(got) > 30
    assert sizes.value <= last < len(rows)


def force_pairs(edges, once):
    """In order of i, the nearest free later call; what each call names as its mate in the end."""
    near, named, taken = {}, {}, set()
    for i, j, d in edges:
        near.setdefault(i, []).append((abs(d), j))
    for i in sorted(near):
        free = [x for x in near[i] if x[1] not in taken]
        if free and not (once and i in taken):
            j = min(free)[1]
            named[i], named[j] = j, i
            taken |= {j, i} if once else {j}
    return named


@pytest.mark.parametrize("compat", [True, False])
def test_linked_calls_are_paired_in_order(spark, compat):
    rng = random.Random(13)
    rows = [(i, rng.randint(0, 1), bool(rng.randint(0, 1)), rng.randint(0, 9000), bool(rng.randint(0, 1))) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, host_chr int, host_rev boolean, host_pos int, virus_rev boolean")
    edges = [tuple(r) for r in calls.mate_candidates(df).collect()]
    expected = force_pairs(edges, not compat)
    assert {r.id: r.paired_with for r in calls.pair_up(df, Params(compat=compat)).collect()} == expected and len(expected) > 100


def test_a_taken_call_takes_another(spark):
    """1 takes 2, 2 takes 3, which name each other; 1 still names 2."""
    df = spark.createDataFrame([(1, 0, False, 0, False), (2, 0, True, 100, True), (3, 0, False, 90, False)], "id long, host_chr int, host_rev boolean, host_pos int, virus_rev boolean")
    assert {r.id: r.paired_with for r in calls.pair_up(df).collect()} == {1: 2, 2: 3, 3: 2}


def test_one_long_chain(spark):
    """A call each 10 bases of one contig."""
    df = spark.range(20_000).selectExpr("id", "0 AS host_chr", "id % 2 = 1 AS host_rev", "id * 10 AS host_pos", "id % 2 = 1 AS virus_rev")
    found = {r.id: r.paired_with for r in calls.pair_up(df, Params(compat=False)).collect()}
    assert len(found) == 20_000 and all(found[found[i]] == i and abs(found[i] - i) == 1 for i in found)


def random_calls(seed, n=400, width=3000):
    rng = random.Random(seed)
    return [(i, rng.randint(0, 1), bool(rng.randint(0, 1)), rng.randint(0, width), bool(rng.randint(0, 1))) for i in range(n)]


CALL = "id long, host_chr int, host_rev boolean, host_pos int, virus_rev boolean"


def gap(a, b):
    """Distance of b from a, if they may be mates."""
    d = a[3] - b[3] if a[2] else b[3] - a[3]
    return d if a[1] == b[1] and a[2] != b[2] and a[4] != b[4] and -50 <= d <= 1000 else None


def no_pairs(monkeypatch):
    def listed(*args):
        raise AssertionError("pairs are listed")

    monkeypatch.setattr(calls.S, "pair_distance", listed)


@pytest.mark.parametrize("compat", [True, False])
def test_pairing_lists_no_pairs(spark, monkeypatch, compat):
    """crowded calls are paired without their candidates being joined; a null field meets nothing."""
    no_pairs(monkeypatch)
    rows = random_calls(31)
    edges = [(a[0], b[0], gap(a, b)) for a in rows for b in rows if a[0] < b[0] and gap(a, b) is not None]
    df = spark.createDataFrame([*rows, (500, None, True, 5, True), (501, 0, True, None, True)], CALL)
    assert {r.id: r.paired_with for r in calls.pair_up(df, Params(compat=compat)).collect()} == force_pairs(edges, not compat)


def test_nearest_mate_lists_no_pairs(spark, monkeypatch):
    """the nearest later call across bins, the first of equal ones."""
    no_pairs(monkeypatch)
    rows = random_calls(32, width=5000)
    near = {}
    for a in rows:
        found = [(abs(gap(a, b)), b[0], gap(a, b)) for b in rows if a[0] < b[0] and gap(a, b) is not None]
        if found:
            near[a[0]] = min(found)[1:]
    assert {r.i: (r.j, r.distance) for r in calls.nearest_mate(spark.createDataFrame(rows, CALL)).collect()} == near and len(near) > 200


def test_rejected_pairing_lists_no_pairs(spark, monkeypatch):
    """lone accepted calls take rejected ones of any id, in order."""
    no_pairs(monkeypatch)
    rows = random_calls(33)
    good, bad, paired = rows[::2], rows[1::2], {r[0] for r in rows[:100:4]}
    taken = {}
    for a in good:
        free = [(abs(gap(a, b)), b[0]) for b in bad if gap(a, b) is not None and b[0] not in taken]
        if a[0] not in paired and free:
            taken[min(free)[1]] = a[0]
    frames = [spark.createDataFrame(x, CALL) for x in (good, bad)]
    got = calls.pair_rejected(*frames, spark.createDataFrame([(x,) for x in paired], "id long")).collect()
    assert {r.id: r.paired_with for r in got} == taken and len(taken) > 100


@pytest.mark.parametrize("batch", [7, 40, 10_000])
def test_leading_junctions_are_assigned_in_batches(spark, monkeypatch, batch):
    """few rounds, each with no more rows in a task than the batch; junctions of more rows are taken as they are."""
    rng = random.Random(34)
    spots = {(rng.randint(0, 5), bool(rng.randint(0, 1)), rng.randint(0, 3), bool(rng.randint(0, 1)), f"q{rng.randint(0, 90)}"): (rng.randint(20, 24), rng.randint(20, 22)) for _ in range(900)}
    rows = [(*k, *v) for k, v in spots.items()]
    rounds, core = spark.sparkContext.accumulator(0), assign._greedy

    def counted(g, least, bound):
        rounds.add(1)
        assert len(g) <= batch
        return core(g, least, bound)

    df = spark.createDataFrame(rows, "region_id long, rev boolean, virus_region long, virus_rev boolean, qname string, h_score long, v_score long")
    expected = assign.greedy(pd.DataFrame(rows, columns=df.columns), 100).itertuples(index=False, name=None)
    monkeypatch.setattr(assign, "_greedy", counted)
    monkeypatch.setattr(assign, "LAST", 0)
    monkeypatch.setattr(assign, "BATCH", batch)
    assert sorted(tuple(r) for r in assign.assign(df).collect()) == sorted(expected)
    assert batch < 10_000 or rounds.value <= 2


def test_junctions_are_ordered_without_rounds_over_the_rows(spark, monkeypatch):
    """F2: as many written tables for any number of rows; a null name is a name, rows without a region or score count nowhere."""
    rng = random.Random(35)
    spots = {(rng.randint(0, 5), bool(rng.randint(0, 1)), rng.randint(0, 3), bool(rng.randint(0, 1)), f"q{rng.randint(0, 90)}" if rng.random() < 0.98 else None): (rng.choice([0, 20, 20, 21]), rng.randint(20, 21)) for _ in range(900)}
    rows = [(*k, *v) for k, v in spots.items()]
    df = spark.createDataFrame([*rows, (None, True, 1, True, "q1", 900, 20), (1, True, None, True, "q2", 900, 20)], "region_id long, rev boolean, virus_region long, virus_rev boolean, qname string, h_score long, v_score long")
    expected = assign.greedy(pd.DataFrame(rows, columns=df.columns), 100).itertuples(index=False, name=None)
    written, write = [], assign.tables.written
    monkeypatch.setattr(assign.tables, "written", lambda *args: written.append(1) or write(*args))
    monkeypatch.setattr(assign, "LAST", 0)
    monkeypatch.setattr(assign, "BATCH", 30)
    got = [tuple(r) for r in assign.assign(df).collect()]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(got, key=key) == sorted(expected, key=key) and len(got) > 50
    assert any(r[4] is None for r in got) and len(written) <= 6
    assert assign.assign(df.where("h_score < 0")).count() == 0
