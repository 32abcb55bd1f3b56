"""The near-duplicate stage against brute force on planted near copies."""

import random

import corpus_pipeline
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F
from splicewell.llm import common, nearcopies, simhash


def test_stage_by_force(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    common_line = [word() for _ in range(12)]
    texts = ["", "one", "one two", "One  TWO", None]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(8, 140))] + common_line
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both * 10 >= 8 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()}
    assert kept == set(root)
    assert 20 < len(kept) < len(texts) - 20
    assert nearcopies.shingle_set("a b c d e f").size == 2


def test_repeated_keys_and_verification(spark):
    words = [f"w{i}" for i in range(60)]
    near = " ".join([*words[:59], "other"])
    far = " ".join([*words[:30], *(f"v{i}" for i in range(30))])
    rows = [(1, " ".join(words)), (1, " ".join(words)), (2, near), (3, far), (3, far), (3, far.upper()), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, df, "").collect()
    assert sorted(r.doc_id for r in kept) == [1, 3, 4]
    assert {r.doc_id: r.text and r.text.lower() for r in kept} == {1: rows[0][1], 3: far, 4: None}


def _copies(rng, n, words, most):
    """Texts of so many words with up to so many of them changed, each at its own places."""
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, most)):
            copy[rng.randrange(len(copy))] = word()
        out.append(" ".join(copy))
    return out


def _labels(texts):
    """The number of the first text that each one is connected to, by force."""
    sets = [set(nearcopies.shingle_set(t).tolist()) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both * 9 >= 4 * (len(sets[i]) + len(sets[j])):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def test_large_group_in_blocks(spark, monkeypatch):
    """A large group of copies of which many are not similar is compared block by block, and no link is lost."""
    monkeypatch.setattr(nearcopies, "HOT_CELL", 8)
    monkeypatch.setattr(nearcopies, "HOT_BLOCK", 30)
    ran = []
    monkeypatch.setattr(nearcopies, "_in_blocks", lambda *a, f=nearcopies._in_blocks: ran.append(1) or f(*a))
    texts = _copies(random.Random(5), 160, 100, 9)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()}
    assert ran and kept == set(_labels(texts)) and 1 < len(kept) < 160


def test_links_of_a_large_group_grow_with_its_classes(spark, monkeypatch):
    """Blocks and later cells give what connects, not every link between what is connected already."""
    monkeypatch.setattr(nearcopies, "HOT_CELL", 8)
    monkeypatch.setattr(nearcopies, "HOT_BLOCK", 30)
    texts = _copies(random.Random(5), 160, 100, 9)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks = common.Written(nearcopies.marked(df, "text", "doc_id")).df
    found = nearcopies.links(df, "text", marks).collect()
    assert 0 < len(found) <= 160
    of = {r.doc_id: bytes(r.fp) for r in marks.collect()}
    root = {fp: fp for fp in of.values()}
    for r in found:
        a, b = sorted((root[bytes(r.a)], root[bytes(r.b)]))
        root = {k: a if v == b else v for k, v in root.items()}
    wanted = _labels(texts)
    assert all((root[of[i]] == root[of[j]]) == (wanted[i] == wanted[j]) for i in of for j in range(i))


def test_a_block_links_what_is_connected_already_once(spark):
    """Twenty similar classes of which ten each are connected need one link."""
    packed = [zstandard.compress(t.encode()) for t in _copies(random.Random(6), 20, 400, 1)]
    fps = [bytes([i]) * 16 for i in range(20)]
    cells = spark.createDataFrame([(1, i, fps[i // 10 * 10], 20) for i in range(20)], "at long, id long, label binary, n long")
    classes = spark.createDataFrame([(i, fps[i], fps[i]) for i in range(20)], "id long, fp binary, own binary")
    found = spark.createDataFrame(list(zip(fps, packed)), "own binary, packed binary")
    made = nearcopies._in_blocks(cells, classes, found).collect()
    assert [{bytes(r.a), bytes(r.b)} for r in made] == [{fps[0], fps[10]}]


@pytest.mark.parametrize("columns", [7, 4096])
def test_connected_by_force(monkeypatch, columns):
    monkeypatch.setattr(nearcopies, "COLUMNS", columns)
    rng = random.Random(8)
    texts = [*_copies(rng, 40, 60, 5), *_copies(rng, 20, 30, 2), "one"]
    found = nearcopies.connected([zstandard.compress(t.encode()) for t in texts])
    assert found.tolist() == _labels(texts)


def test_simhash_step_of_the_stage(spark):
    """the stage's SimHashes are those of the five-word sets, and those within two bits give candidates."""
    texts = [*_copies(random.Random(3), 30, 400, 1), "a b c d e f g"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks = common.Written(nearcopies.marked(df, "text", "doc_id")).df
    sims = {r.doc_id: r.sim for r in marks.collect()}
    for i, t in enumerate(texts):
        h = [int(x) & (1 << 64) - 1 for x in nearcopies.shingle_set(t)]
        assert sims[i] & (1 << 64) - 1 == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    classes = marks.withColumn("id", F.xxhash64("fp")).select("id", "sim").distinct()
    of = {r.id: r.sim for r in classes.collect()}
    pairs = nearcopies.near_by_bits(classes).collect()
    assert pairs and all(((of[p.a] ^ of[p.b]) & (1 << 64) - 1).bit_count() <= simhash.MAX_BITS for p in pairs)
    least = {s: min(i for i in of if of[i] == s) for s in of.values()}
    wanted = {tuple(sorted((least[a], least[b]))) for a in least for b in least if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= simhash.MAX_BITS}
    wanted |= {(least[s], i) for i, s in of.items() if i != least[s]}
    assert {(p.a, p.b) for p in pairs} == wanted


def test_map_rules_out_no_value(spark):
    values = spark.range(0, 3000, 3).toDF("v")
    found = spark.range(3000).where(nearcopies.may_be_among(F.col("id"), values)).toPandas()["id"].to_numpy()
    assert np.isin(np.arange(0, 3000, 3), found).all() and len(found) < 1100
