"""WARC archives: round trips, revisits by force, odd payloads, hot groups."""

import base64
import gzip
import hashlib
import random
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F
from splicewell.llm import common, warc

SF = "/root/testdata/sf0.001"


def force(pages, least=0):
    """(page_id, bytes, digest, type, refers_to) of (page_id, html) rows, sorted as text."""
    out = []
    payloads = [(p, (h or "").encode()) for p, h in pages]
    for p, b in payloads:
        same = [q for q, c in payloads if c == b]
        first = min((q for q in same if q is not None), default=None)
        again = p != first and len(b) >= least
        out.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


ODD = [
    (1, "http://a/", "<p>one</p>", "x"), (2, "http://b/", "<p>one</p>", "x"), (3, None, None, None), (4, "http://d/\r\nX-Page: 9", "", "x"), (2, "http://b/", "<p>one</p>", "x"),
    (None, "http://e/", "<p>one</p>", "x"), (None, "http://f/", "null key", "x"), (None, "http://f/", "null key", "x"), (7, "http://g/", "ends in a break\r\n", "x"),
    (8, "http://h/", "\r\n\r\nWARC/1.1\r\nWARC-Type: revisit\r\n\r\n0\r\n\r\n", "x"), (9, "http://i/", "\r", "x"), (10, "http://j/", "\r\r\n\n\r\r", "x"), (11, "http://k/", "äöü€😀" * 50, "x"),
    (12, "http://l/", "no break at all " * 4000, "x"), (5, "http://m/", "no break at all " * 4000, "x"), (13, "http://n/", "ab", "x"),
]
SCHEMA = "page_id long, url string, html string, data string"


@pytest.mark.parametrize("size", [1, 2, 7, warc.CHUNK])
def test_round_trip_of_odd_payloads(spark, tmp_path, size):
    rows = ODD if size > 2 else [r for r in ODD if len(r[2] or "") < 500]
    path = str(tmp_path / "out")
    warc.write(spark.createDataFrame(rows, SCHEMA).repartition(3), path, size=size)
    chunks = warc.read(spark, path).cache()
    got = [tuple(r) for r in warc.records(chunks).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=str) == force([(r[0], r[2]) for r in rows])
    assert warc.records(chunks).where("not intact").count() == 0
    texts = chunks.where("data is not null").groupBy("record_id", "page_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "data"))).alias("parts")).collect()
    wanted = {(p, (h or "").encode()) for p, _, h, _ in rows}
    for r in texts:
        parts, at = [x["data"] for x in r["parts"]], [x["chunk"] for x in r["parts"]]
        if len(set(at)) == len(at):  # repeated rows share an id
            assert (r["page_id"], b"".join(parts)) in wanted and all(len(x) <= size for x in parts)


def test_files_are_plain_warc(spark, tmp_path):
    """Lengths in the files say where each record ends; record ids are met by what refers to them."""
    warc.write(spark.createDataFrame(ODD, SCHEMA).coalesce(1), str(tmp_path / "out"), size=100)
    found, refers = [], []
    for f in Path(tmp_path / "out").glob("*.gz"):
        raw = gzip.decompress(f.read_bytes())
        while raw:
            head, _, raw = raw.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            assert lines[0] == "WARC/1.1"
            fields = dict(x.split(": ", 1) for x in lines[1:])
            n = int(fields["Content-Length"])
            block, end, raw = raw[:n], raw[n : n + 4], raw[n + 4 :]
            assert end == b"\r\n\r\n" and block.startswith(b"HTTP/1.1 200 OK\r\n")
            found.append(fields["WARC-Record-ID"])
            refers += [fields["WARC-Refers-To"]] if fields["WARC-Type"] == "revisit" else []
    assert len(found) == len(ODD) and len(refers) == 5 and set(refers) <= set(found)


def test_small_payloads_stay_responses(spark, tmp_path):
    path = str(tmp_path / "out")
    warc.write(spark.createDataFrame(ODD, SCHEMA), path, least=11)
    got = warc.records(warc.read(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == force([(r[0], r[2]) for r in ODD], 11)


def test_hot_payload_is_met_by_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    rng = random.Random(1)
    rows = [(i, f"http://x/{i}", rng.choice(["same", "same", f"own {i}", f"pair {i // 2}"])) for i in range(400)]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "out"))
    got = warc.records(warc.read(spark, str(tmp_path / "out"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == force([(r[0], r[2]) for r in rows])


def test_op12_against_force_and_sql(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()
    got = sorted((tuple(r) for r in warc.op12_warc(spark, SF).collect()), key=str)
    assert got == force([tuple(p) for p in pages])
    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    assert sorted(duckdb.sql(warc.OP12_SQL).fetchall(), key=str) == got


def test_empty_table(spark, tmp_path):
    warc.write(spark.createDataFrame([], SCHEMA), str(tmp_path / "out"))
    assert warc.records(warc.read(spark, str(tmp_path / "out"))).collect() == []
