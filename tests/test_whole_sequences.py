"""Duplicates are told by whole sequences."""

import duckdb
from splicewell.plans import registry


def test_same_ends_are_no_duplicates(spark, tmp_path):
    ends = ("ACGTACGTACGT", "GGATT")
    texts = [ends[0] + "AAACC" + ends[1], ends[0] + "CCCTT" + ends[1], ends[0] + "AAACC" + ends[1]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    found = registry.QUERIES["duplicates_by_whole_sequence"](spark, str(tmp_path)).collect()
    assert {r.read_id: r.dup_seq for r in found} == {0: False, 1: False, 2: True}


def test_oracle_agrees(spark):
    for name in ("duplicates_by_whole_sequence", "duplicates_by_sequence"):
        con = duckdb.connect()
        con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
        want = con.execute(registry.ORACLES[name]).fetchall()
        assert sorted(map(tuple, registry.QUERIES[name](spark, "/root/testdata/sf0.01").collect())) == sorted(want)
