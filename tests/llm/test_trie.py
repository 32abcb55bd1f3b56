"""Prefix tries against force and SQL, long and hot conversations, odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from splicewell.llm import common, trie

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, row string"


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    """Tables here have few rows and many stages."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def force(rows):
    """The query's rows, from (conv_id, turn, role, text)."""
    digest = lambda role, text: hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, role, digest(role, text), text))
    convs = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in convs.items()}
    made = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, seq in sorted(made.items()):
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children = defaultdict(list)
    for seq in members:
        if seq:
            children[seq[:-1]].append(seq)
    total = {}
    for seq in sorted(members, key=len, reverse=True):
        below = [total[x] for x in children[seq]]
        saved = (len(members[seq]) - 1) * len(seq[-1][1].encode()) if seq else 0
        total[seq] = (sum(b[0] for b in below) or 1, saved + sum(b[1] for b in below))
    out = []
    for seq, m in members.items():
        ends = ",".join(str(c) for c in m if len(made[c]) == len(seq))
        out.append((m[0], len(seq), members[seq[:-1]][0] if seq else None, len(m), len(children[seq]), *total[seq], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def query(spark, rows, tmp_path, name="conversations"):
    spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).write.parquet(f"{tmp_path}/{name}.parquet")
    return sorted(tuple(r) for r in trie.op13_trie(spark, str(tmp_path)).collect())


def test_op13_against_force_and_sql(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted(tuple(r) for r in trie.op13_trie(spark, SF).collect())
    assert got == force(rows)
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    assert sorted(duckdb.sql(trie.OP13_SQL).fetchall()) == got


def test_random_and_odd_conversations(spark, tmp_path, monkeypatch):
    """Few texts, so much is shared; a long conversation; null, tied and repeated turns; hot keys by broadcast; pieces of ends."""
    monkeypatch.setattr(common, "HOT_ROWS", 7)
    monkeypatch.setattr(trie, "PIECE", 3)
    rng = random.Random(5)
    rows = [(c, t, "user", rng.choice("ab")) for c in range(60) for t in range(rng.choice([1, 2, 3, 9, 17]))]
    rows += [(70, t, None, "a") for t in range(150)] + [(71, t, None, "a") for t in range(150)] + [(75, t, "u", "ab"[t % 2]) for t in range(100)]
    rows += [(80, None, "user", "late"), (80, None, "user", None), (80, 1, None, "x"), (80, 1, "b", "x"), (80, 1, "b", "x"), (80, 1, "b", "y"), (None, 1, "u", "x")]
    rows += [(91, 0, "u", "ä€"), (92, 5, "u", "ä€"), (1003, -3, "u", ""), (2_000_000_007, 0, "ab", "c"), (2_000_000_008, 0, "a", "bc")]
    assert query(spark, rows, tmp_path) == force(rows)


def test_turnless_and_none(spark, tmp_path):
    """A conversation of fewer turns than it gives up, without the one it shares, is rebuilt without turns."""
    short = [c for c in range(1, 60) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2][:3]
    assert query(spark, [(c, 0, "u", "x") for c in short], tmp_path) == force([(c, 0, "u", "x") for c in short])
    empty = tmp_path / "none"
    empty.mkdir()
    assert query(spark, [], empty) == []


def test_pieces_of_ends(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 4)
    rows = [(n, d, c * 7 % 1009) for n, d in ((1, 0), (1, 1), (5, 1)) for c in range(3 if n == 5 else 90)]
    got = {(r["node"], r["depth"]): r["sha"] for r in trie.digests_of_ends(spark.createDataFrame(rows, "node long, depth long, conv long").repartition(5)).collect()}
    for key in {r[:2] for r in rows}:
        ids = sorted(r[2] for r in rows if r[:2] == key)
        assert got[key] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
