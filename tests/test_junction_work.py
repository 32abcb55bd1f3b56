"""what junctions costs: whole matches, dealing of alignments, trials of keys that have lost their names."""

import pytest
from pyspark.sql import functions as F
from splicewell.functions import alignment
from splicewell.operators import associate, mismatch, rounds, sizes
from splicewell.params import DEFAULT, Params
from splicewell.plans import junction_queries


def test_a_query_that_lies_whole_in_the_reference_needs_no_sweep(monkeypatch):
    pairs = [("ACGTAC", "TTACGTACGTACGG"), ("GG", "TTACGGTGG"), ("ACNT", "GACNTG"), ("AAAT", "AAGAACAAAT")]
    costs = [DEFAULT, Params(match=2, mismatch=1, gap_open=2, gap_extend=1)]
    swept = []
    monkeypatch.setattr(alignment, "_sweep", lambda q, *a, f=alignment._sweep: swept.extend(q) or f(q, *a))
    found = [alignment.align_many(pairs, p) for p in costs]
    assert set(swept) == {"ACNT", "AC"}  # N matches nothing
    monkeypatch.setattr(alignment, "_whole", lambda *a: None)
    assert found == [alignment.align_many(pairs, p) for p in costs]
    assert found[0][0] == (6, 2, 7, 0, 5, 0, "6=")


def _dealt(df, *columns):
    """Whether the plan deals rows by these columns into a fixed number of partitions."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return any(all(f"{c}#" in line for c in columns) and "REPARTITION_BY_NUM" in line for line in plan.splitlines())


def test_alignments_and_pileups_are_dealt_over_all_tasks(spark):
    reads = spark.createDataFrame([(1, "ACGTTGCAAC" * 10)], "read_id long, seq string")
    regions = spark.createDataFrame([(7, "ACGTTGCAAC" * 20)], "region_id long, seq string")
    assert _dealt(associate.realign(reads, regions), "query", "target")
    hits = "region_id long, rev boolean, qname string, offset_start long, offset_end long, seq string, cigar string"
    assert _dealt(mismatch.mismatching(spark.createDataFrame([], hits)), "region_id", "rev")


def test_keys_without_names_are_not_tried_again(spark, monkeypatch):
    ran = []
    monkeypatch.setattr(rounds.Trials, "run", lambda self, *a, f=rounds.Trials.run: ran.append(1) or f(self, *a))
    found = junction_queries.junctions(spark, "/root/testdata/sf0.001")
    assert found.where(F.col("host_pos").isNotNull()).count() > 5 and len(ran) == 1


def _joins(df):
    """Names of the joins of the plan that ran."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return {word for word in ("BroadcastHashJoin", "SortMergeJoin") if word in plan}


def test_candidates_are_not_broadcast_for_their_small_files(spark, monkeypatch, tmp_path):
    """reads become many rows of k-mers; these went to the driver where the table of the regions' k-mers didn't."""
    monkeypatch.setattr(associate, "small", lambda df: sizes.small(df, 10))
    reads = spark.createDataFrame([(i, "ACGTTGCAAC" * 3 + "GATTACAGCATTAG") for i in range(50)], "read_id long, seq string")
    reads.write.parquet(f"{tmp_path}/reads")
    regions = spark.createDataFrame([(7, "ACGTTGCAAC" * 3 + "GATTACAGCATTAG")], "region_id long, seq string")
    found = associate.shared_kmers(spark.read.parquet(f"{tmp_path}/reads"), regions)
    assert _joins(found) == {"SortMergeJoin"} and found.where("not rc").count() == 50


def test_few_long_rows_are_not_broadcast(spark):
    rows = spark.range(20).selectExpr("id", "repeat('A', 1000) AS seq")
    many = spark.range(2000).where("id % 3 < 3")
    assert _joins(many.join(sizes.small(rows, size=30_000), "id")) == {"BroadcastHashJoin"}
    assert _joins(many.join(sizes.small(rows, size=10_000), "id")) == {"SortMergeJoin"}
    assert _joins(many.join(sizes.small(rows.select("id"), size=10_000), "id")) == {"BroadcastHashJoin"}


def test_junctions_leave_broadcasts_to_counted_tables(spark, monkeypatch):
    """tables of 5 to 25 MB, up to six in a plan, were built on the driver, as Spark's own bound is 10 MB of compressed files."""
    bounds, key = [], "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)

    class Ended(Exception):
        pass

    def run(self, *args):
        bounds.append(int(spark.conf.get(key)))
        raise Ended

    monkeypatch.setattr(rounds.Trials, "run", run)
    with pytest.raises(Ended):
        junction_queries.junctions(spark, "/root/testdata/sf0.001")
    assert bounds == [sizes.UNCOUNTED_BYTES] and spark.conf.get(key) == before
