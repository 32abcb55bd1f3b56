"""Queries of aggregations, windows, top-k and the call rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import associate as A
from ..operators import calls as K
from ..operators import evidence as E
from ..operators import intervals as I
from ..operators import pairs as P
from ..operators.sizes import spread
from . import fixtures as X


def insert_size_stats(spark, sf):
    return P.insert_size(X.hits(spark, sf).withColumn("size", F.col("offset_end") + F.col("score")), "size")


def sampled_positions(spark, sf):
    found = P.sampled_positions(X.hits(spark, sf), "contig", "pos", "isize", 3)
    return found.groupBy("contig", "pos").agg(F.count("*").alias("n"), F.sum("isize").alias("total"))


def primary_count_two(spark, sf):
    return P.exactly_two(X.hits(spark, sf), "qname", P.both_primary()).select("qname", "read_id", "flag", "pos", "score")


def duplicates_by_position(spark, sf):
    found = P.duplicates_by_position(X.hits(spark, sf), ["region_id", "rev", "contig"], "quality", ["qname", "read_id", "offset_start", "score"])
    return found.select("region_id", "rev", "contig", "quality", "qname", "read_id", "dup_pos")


def duplicates_by_sequence(spark, sf):
    d = X.table(spark, sf, "documents").select("doc_id", F.substring("text", 1, 12).alias("seq1"), F.right("text", F.lit(5)).alias("seq2"))
    return P.duplicates_by_sequence(d, [F.col("doc_id")]).select("doc_id", "dup_seq")


def duplicates_by_whole_sequence(spark, sf):
    """Whole sequences and their reverse complements: equal texts, and texts that are each other's complement."""
    d = X.reads(spark, sf).select("read_id", F.col("seq").alias("seq1"), S.reverse_complement(F.col("seq")).alias("seq2"))
    return P.duplicates_by_sequence(d, [F.col("read_id")]).select("read_id", "dup_seq")


def interval_islands(spark, sf):
    return I.islands(X.anchors(spark, sf), ["contig"], "start", "end", 10)


def sampling_regions(spark, sf):
    return I.sampling_regions(X.anchors(spark, sf).where("strand = 'F'"), "contig", "start", "end", 2)


def coverage_union_length(spark, sf):
    return I.covered(X.hits(spark, sf), ["region_id", "rev"], "offset_start", "offset_end")


def adjacent_collapse(spark, sf):
    return I.collapse_neighbours(X.anchors(spark, sf), ["contig", "strand"])


def region_scores(spark, sf):
    return E.region_scores(X.hits(spark, sf))


def best_region(spark, sf):
    s = E.region_scores(X.hits(spark, sf)).withColumn("group", F.col("region_id") % 7)
    return E.best_regions(s, ["group"], [F.desc("score"), F.desc("reads"), F.asc("region_id"), F.asc("rev")])


def top_regions(spark, sf):
    return E.region_scores(X.hits(spark, sf)).orderBy(F.desc("score"), F.desc("region_id"), "rev").limit(10)


def dense_region_ids(spark, sf):
    r = I.islands(X.anchors(spark, sf), ["contig"], "start", "end", 10)
    return E.dense_ids(r, "contig", ["start", "end"]).select("region_id", "contig", "start", "end")


def near_best_filter(spark, sf):
    return A.near_best(X.hits(spark, sf), ["qname"], "score", 0.75).groupBy("qname").agg(F.count("*").alias("kept"), F.min("score").alias("least"))


def qname_distances(spark, sf):
    return E.distances(X.hits(spark, sf).where("not secondary"), F.lit(1100))


def _pairs(spark, sf):
    h = X.hits(spark, sf)
    return h.groupBy("qname").agg((F.max("offset_end") % 50).alias("h_dist"), (F.min("offset_start") % 40).alias("v_dist"), F.sum("score").alias("score"), (F.min("region_id") % 10).alias("region_id"))


def distance_dedup(spark, sf):
    return E.dedup_by_distance(_pairs(spark, sf), ["region_id"], "qname")


def too_long_flag(spark, sf):
    return E.too_long(_pairs(spark, sf), 70).select("qname", "too_long")


def clip_mode_window(spark, sf):
    return E.clip_mode(X.hits(spark, sf))


def sliding_score_window(spark, sf):
    return E.sliding_scores(X.hits(spark, sf), 80)


def window_conformance(spark, sf):
    h = X.hits(spark, sf).withColumn("lclip_quality", F.col("quality")).withColumn("rclip_quality", F.pmod(F.col("quality") + F.col("pos"), F.lit(20)))
    return E.conforming(h, E.accept_windows(h, 700)).groupBy("region_id", "rev").agg(F.count("*").alias("reads"), F.count_distinct("qname").alias("names"))


def suspicious_hits(spark, sf):
    """Hits of low complexity or clipped in the wrong place, on their own or by a virus hit of their name."""
    h = X.hits(spark, sf).drop("suspicious").withColumn("seq", F.expr(X.SEQ))
    found = E.suspicious(h, E.accept_windows(h, 700))
    return E.with_suspects(found.where("contig < 3"), found.where("contig >= 3")).groupBy("region_id", "rev").agg(F.count_if("suspicious").alias("suspects"), F.count("*").alias("reads"))


def longest_reads(spark, sf):
    return P.longest_read(X.reads(spark, sf).withColumn("part", F.col("read_id") % 11), by=["part"])


def widest_insert(spark, sf):
    return P.widest_insert(X.hits(spark, sf).withColumn("size", F.col("offset_end") + F.col("score")), "sample", "size")


def breakpoint_extent(spark, sf):
    return E.breakpoints(X.hits(spark, sf).where("score > 30"))


def call_support(spark, sf):
    return E.support(X.hits(spark, sf))


def split_read_count(spark, sf):
    h = X.hits(spark, sf)
    return E.split_reads(h, E.clip_mode(h).select("region_id", "rev", F.col("position").alias("bp")))


def pileup_consensus(spark, sf):
    r = spread(X.reads(spark, sf), "read_id").select((F.col("read_id") % 20).alias("region_id"), F.posexplode(F.split("seq", "")).alias("place", "base"))
    return E.pileup(r.where("base <> ''").withColumn("place", F.col("place").cast("long")), ["region_id"], "place", "base")


def strand_list_routing(spark, sf):
    h = X.hits(spark, sf).withColumn("rc", F.col("rev")).drop("rev")
    return A.strand_lists(h.withColumn("lclip", F.col("lclip") * 3).withColumn("rclip", F.col("rclip") * 3)).groupBy("rev", "region_id").agg(F.count("*").alias("reads"))


def masked_length(spark, sf):
    h = X.hits(spark, sf)
    m = h.select((F.col("qname") % 500).alias("call_id"), F.when(F.col("rev"), "host").otherwise("virus").alias("side"), F.col("offset_start").alias("start"), F.col("offset_end").alias("end"), F.struct("read_id", "offset_start", "offset_end").alias("place"))
    return K.masked_length(m, "place")


def call_accept_rules(spark, sf):
    return X.calls(spark, sf).select("id", K.verdict(60).alias("accepted"), K.verdict(60, accept_all_clipped=True).alias("accepted_clipped"))


def call_text(spark, sf):
    c = X.calls(spark, sf).select(
        "id", F.concat_ws(":", F.lit("chr1"), F.lit("-"), F.col("host_pos").cast("string"), (F.col("host_pos") + 9).cast("string")).alias("host_bp"), F.concat_ws(":", F.lit("v"), F.lit("+"), F.col("virus_pos").cast("string"), (F.col("virus_pos") + 9).cast("string")).alias("virus_bp"),
        F.col("good_pairs").alias("reads"), "good_pairs", "split_reads", F.lit(0).alias("score"), F.lit(0.5).alias("host_pbs"), F.lit(0.25).alias("virus_pbs"), F.lit(0).alias("reads_w_dups"), F.lit(0).alias("unique_reads_w_dups"), F.lit(0.75).alias("host_cov"), F.lit(0.5).alias("virus_cov"),
        F.concat(F.lit("chr1:-"), F.col("host_pos").cast("string")).alias("host"), F.concat(F.lit("v:+"), F.col("virus_pos").cast("string")).alias("virus"), F.when(F.col("id") % 3 == 0, F.col("id") + 1).alias("paired_with"),
    )
    c = c.withColumn("line", K.machine_text()).withColumn("human", K.human_text())
    back = K.parse_machine_text(F.col("line"))
    return c.select("id", "line", "human", back["host_bp"]["end"].cast("long").alias("host_end"), back["split_reads"].cast("long").alias("splits"), back["host_cov"].alias("host_cov"))


def alternative_loci(spark, sf):
    o = X.table(spark, sf, "orders")
    alt = lambda c, s, p: F.struct(F.lit(c).alias("contig"), F.lit(s).alias("strand"), p.cast("int").alias("pos"))
    r = o.select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, "L").otherwise("R").alias("dir"), (F.col("o_custkey") % 3 == 0).alias("reverse"), F.lit("chr9").alias("contig"), F.col("o_custkey").alias("start"), (F.col("o_custkey") + 30).alias("end"), F.lit(31).alias("query_len"),
        F.when(F.col("o_orderkey") % 5 == 0, F.array().cast("array<struct<contig:string,strand:string,pos:int>>")).otherwise(F.array(alt("chr2", "+", F.col("o_orderkey")), alt("chr3", "-", F.col("o_custkey") + 7))).alias("alternatives"),
    )
    return K.alternative_loci(r)


QUERIES = {f.__name__: f for f in (insert_size_stats, sampled_positions, primary_count_two, duplicates_by_position, duplicates_by_sequence, duplicates_by_whole_sequence, interval_islands, sampling_regions, coverage_union_length, adjacent_collapse, region_scores, best_region, top_regions, dense_region_ids, near_best_filter, qname_distances, distance_dedup, too_long_flag, clip_mode_window, sliding_score_window, window_conformance, suspicious_hits, longest_reads, widest_insert, breakpoint_extent, call_support, split_read_count, pileup_consensus, strand_list_routing, masked_length, call_accept_rules, call_text, alternative_loci)}

_ISLANDS = """edges AS (SELECT contig, start, "end" AS e, id, max("end") OVER (PARTITION BY contig ORDER BY start, "end", id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM anchors),
    runs AS (SELECT *, sum(CASE WHEN b IS NULL OR start > b + 10 THEN 1 ELSE 0 END) OVER (PARTITION BY contig ORDER BY start, e, id ROWS UNBOUNDED PRECEDING) AS run FROM edges),
    islands AS (SELECT contig, min(start) AS start, max(e) AS e, count(*) AS n FROM runs GROUP BY contig, run)"""
_SCORES = "scores AS (SELECT region_id, rev, CAST(sum(score) AS BIGINT) AS score, count(*) AS reads FROM hits GROUP BY ALL)"
_PAIRS = "pairs AS (SELECT qname, max(offset_end) % 50 AS h_dist, min(offset_start) % 40 AS v_dist, CAST(sum(score) AS BIGINT) AS score, min(region_id) % 10 AS region_id FROM hits GROUP BY qname)"
_MODE = """modes AS (SELECT region_id, rev, position, clips, row_number() OVER (PARTITION BY region_id, rev ORDER BY clips DESC, CASE WHEN rev THEN position ELSE -position END) AS n FROM
    (SELECT region_id, rev, CASE WHEN rev THEN offset_start ELSE offset_end END AS position, count(*) AS clips FROM hits WHERE CASE WHEN rev THEN lclip ELSE rclip END > 0 GROUP BY ALL))"""
_SLIDE = lambda d: f"""points AS (SELECT region_id, rev, CASE WHEN rev THEN offset_start ELSE offset_end END AS position, sum(score) AS s FROM hits GROUP BY ALL),
    slide AS (SELECT region_id, rev, position, CAST(CASE WHEN rev THEN sum(s) OVER (PARTITION BY region_id, rev ORDER BY position RANGE BETWEEN CURRENT ROW AND {d - 1} FOLLOWING)
        ELSE sum(s) OVER (PARTITION BY region_id, rev ORDER BY position RANGE BETWEEN {d - 1} PRECEDING AND CURRENT ROW) END AS BIGINT) AS total FROM points)"""  # noqa: E731

_LIMITS = """ext AS (SELECT region_id, rev, min(offset_start) AS first, max(offset_end) AS last FROM hits GROUP BY region_id, rev),
        sure AS (SELECT e.region_id, e.rev, coalesce(m.position, CASE WHEN e.rev THEN 0 END) AS at FROM ext e LEFT JOIN modes m ON m.region_id = e.region_id AND m.rev = e.rev AND m.n = 1
            WHERE m.clips >= 2 OR coalesce(m.position, CASE WHEN e.rev THEN 0 END) = CASE WHEN e.rev THEN first ELSE last END),
        win AS (SELECT b.region_id, b.rev, coalesce(s.at, b.position) AS bp FROM best b LEFT JOIN sure s ON s.region_id = b.region_id AND s.rev = b.rev WHERE b.n = 1),
        lim AS (SELECT region_id, rev, CASE WHEN rev THEN bp ELSE bp - 700 END AS low, CASE WHEN rev THEN bp + 700 ELSE bp END AS high FROM win)"""

ORACLES = {
    "insert_size_stats": f"""WITH {X.HITS}, s AS (SELECT offset_end + score AS x FROM hits), m AS (SELECT count(x) AS n, CAST(floor(avg(x)) AS BIGINT) AS mean FROM s)
        SELECT n, mean, CAST(floor(sqrt((SELECT avg((x - mean) * (x - mean)) FROM s, m WHERE x > mean))) AS BIGINT) AS upper_sd, mean + 5 * CAST(floor(sqrt((SELECT avg((x - mean) * (x - mean)) FROM s, m WHERE x > mean))) AS BIGINT) AS max_is FROM m""",
    "sampled_positions": f"""WITH {X.HITS}, d AS (SELECT DISTINCT contig, pos, isize FROM hits), r AS (SELECT *, row_number() OVER (PARTITION BY contig, pos ORDER BY isize) AS n FROM d)
        SELECT contig, pos, count(*) AS n, CAST(sum(isize) AS BIGINT) AS total FROM r WHERE n <= 3 GROUP BY contig, pos""",
    "primary_count_two": f"WITH {X.HITS} SELECT qname, read_id, flag, pos, score FROM hits WHERE qname IN (SELECT qname FROM hits WHERE flag & 2304 = 0 GROUP BY qname HAVING count(*) = 2)",
    "duplicates_by_position": f"""WITH {X.HITS} SELECT region_id, rev, contig, quality, qname, read_id, row_number() OVER (PARTITION BY region_id, rev, contig ORDER BY quality, qname, read_id, offset_start, score) > 1 AS dup_pos FROM hits""",
    "duplicates_by_sequence": """WITH d AS (SELECT doc_id, substr(text, 1, 12) AS a, right(text, 5) AS b FROM documents)
        SELECT doc_id, row_number() OVER (PARTITION BY least(a, b) || '-' || greatest(a, b) ORDER BY doc_id) > 1 AS dup_seq FROM d""",
    "duplicates_by_whole_sequence": f"""WITH {X.READS}, d AS (SELECT read_id, seq AS a, reverse(translate(seq, 'ACGT', 'TGCA')) AS b FROM reads)
        SELECT read_id, row_number() OVER (PARTITION BY least(a, b) || '-' || greatest(a, b) ORDER BY read_id) > 1 AS dup_seq FROM d""",
    "interval_islands": f'WITH {X.ANCHORS}, {_ISLANDS} SELECT contig, start, e AS "end", n FROM islands',
    "sampling_regions": f"""WITH {X.ANCHORS}, f AS (SELECT contig, start, "end" AS e, max("end") OVER (PARTITION BY contig ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM anchors WHERE strand = 'F'),
        r AS (SELECT *, sum(CASE WHEN b IS NULL OR start > b THEN 1 ELSE 0 END) OVER (PARTITION BY contig ORDER BY start, e ROWS UNBOUNDED PRECEDING) AS run FROM f)
        SELECT contig, min(start) AS start, max(e) AS "end", count(*) AS n FROM r GROUP BY contig, run HAVING count(*) >= 2""",
    "coverage_union_length": f"""WITH {X.HITS}, edges AS (SELECT region_id, rev, offset_start AS s, offset_end AS e, max(offset_end) OVER (PARTITION BY region_id, rev ORDER BY offset_start, offset_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM hits),
        runs AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b THEN 1 ELSE 0 END) OVER (PARTITION BY region_id, rev ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM edges),
        isl AS (SELECT region_id, rev, min(s) AS s, max(e) AS e FROM runs GROUP BY region_id, rev, run)
        SELECT region_id, rev, CAST(sum(e - s + 1) + CASE WHEN min(s) = 0 THEN 0 ELSE 1 END AS BIGINT) AS covered FROM isl GROUP BY region_id, rev""",
    "adjacent_collapse": f"""WITH RECURSIVE {X.ANCHORS}, p AS (
            SELECT contig, strand, start, "end" AS e, CAST(1 AS BIGINT) AS n, row_number() OVER (PARTITION BY contig, strand ORDER BY start, "end", id) AS i, 0 AS pass FROM anchors
            UNION ALL
            SELECT contig, strand, start, CASE WHEN one THEN greatest(e, ne) ELSE e END, CASE WHEN one THEN n + nn ELSE n END, row_number() OVER (PARTITION BY contig, strand ORDER BY i), pass + 1
            FROM (SELECT *, coalesce(lag(one) OVER (PARTITION BY contig, strand ORDER BY i), false) AS gone, bool_or(one) OVER () AS live
                FROM (SELECT *, close AND (i - coalesce(max(CASE WHEN NOT close THEN i END) OVER (PARTITION BY contig, strand ORDER BY i), 0)) % 2 = 1 AS one
                    FROM (SELECT *, coalesce(ns - start <= 10 AND abs(ne - e) <= 10, false) AS close
                        FROM (SELECT *, lead(start) OVER w AS ns, lead(e) OVER w AS ne, lead(n) OVER w AS nn FROM p WINDOW w AS (PARTITION BY contig, strand ORDER BY i)))))
            WHERE live AND NOT gone)
        SELECT contig, strand, start, e AS "end", n FROM p WHERE pass = (SELECT max(pass) FROM p)""",
    "region_scores": f"WITH {X.HITS}, {_SCORES} SELECT * FROM scores",
    "best_region": f"""WITH {X.HITS}, {_SCORES}, r AS (SELECT *, region_id % 7 AS "group", row_number() OVER (PARTITION BY region_id % 7 ORDER BY score DESC, reads DESC, region_id, rev) AS n FROM scores)
        SELECT region_id, rev, score, reads, "group" FROM r WHERE n = 1""",
    "top_regions": f"WITH {X.HITS}, {_SCORES} SELECT * FROM scores ORDER BY score DESC, region_id DESC, rev LIMIT 10",
    "dense_region_ids": f'WITH {X.ANCHORS}, {_ISLANDS} SELECT CAST(row_number() OVER (ORDER BY contig, start, e) - 1 AS BIGINT) AS region_id, contig, start, e AS "end" FROM islands',
    "near_best_filter": f"WITH {X.HITS}, b AS (SELECT *, max(score) OVER (PARTITION BY qname) AS best FROM hits) SELECT qname, count(*) AS kept, min(score) AS least FROM b WHERE score >= 0.75 * best GROUP BY qname",
    "qname_distances": f"WITH {X.HITS} SELECT region_id, rev, qname, max(CASE WHEN rev THEN offset_end + rclip ELSE 1100 - offset_start + lclip END) AS distance FROM hits WHERE NOT secondary GROUP BY ALL",
    "distance_dedup": f"WITH {X.HITS}, {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY region_id, h_dist, v_dist ORDER BY score DESC, qname) AS n FROM pairs) SELECT qname, h_dist, v_dist, score, region_id FROM r WHERE n = 1",
    "too_long_flag": f"WITH {X.HITS}, {_PAIRS} SELECT qname, h_dist + v_dist > 70 AS too_long FROM pairs",
    "clip_mode_window": f"WITH {X.HITS}, {_MODE} SELECT region_id, rev, position, clips FROM modes WHERE n = 1",
    "sliding_score_window": f"WITH {X.HITS}, {_SLIDE(80)} SELECT * FROM slide",
    "window_conformance": f"""WITH {X.HITS}, {_MODE}, {_SLIDE(700)}, best AS (SELECT *, row_number() OVER (PARTITION BY region_id, rev ORDER BY total DESC, CASE WHEN rev THEN -position ELSE position END) AS n FROM slide),
        {_LIMITS},
        bad AS (SELECT DISTINCT h.region_id, h.rev, qname FROM hits h JOIN lim USING (region_id, rev) WHERE offset_start < low OR offset_end > high
            OR (lclip > 10 AND quality >= 10 AND abs(offset_start - low) > 10) OR (rclip > 10 AND (quality + pos) % 20 >= 10 AND abs(offset_end - high) > 10))
        SELECT region_id, rev, count(*) AS reads, count(DISTINCT qname) AS names FROM hits h WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.region_id = h.region_id AND b.rev = h.rev AND b.qname = h.qname) GROUP BY region_id, rev""",
    "suspicious_hits": f"""WITH {X.HITS}, {_MODE}, {_SLIDE(700)}, best AS (SELECT *, row_number() OVER (PARTITION BY region_id, rev ORDER BY total DESC, CASE WHEN rev THEN -position ELSE position END) AS n FROM slide),
        {_LIMITS},
        s AS (SELECT h.*, lim.low, lim.high, substr({X.SEQ}, CAST(lclip + 1 AS INTEGER), CAST(greatest(0, length({X.SEQ}) - lclip - rclip) AS INTEGER)) AS own FROM hits h JOIN lim USING (region_id, rev)),
        c AS (SELECT *, list_reverse_sort([{", ".join(f"len(list_filter(generate_series(1, length(own) - 1), lambda i : substr(own, CAST(i AS INTEGER), 2) = '{a}{b}'))" for a in "ACGT" for b in "ACGT")}]) AS n FROM s),
        f AS (SELECT *, n[1] + n[2] >= 0.75 * (length(own) + 1) OR (lclip > 10 AND abs(offset_start - low) > 10) OR (rclip > 10 AND abs(offset_end - high) > 10) AS bad FROM c)
        SELECT region_id, rev, count(CASE WHEN bad OR qname IN (SELECT qname FROM f WHERE bad AND contig >= 3) THEN 1 END) AS suspects, count(*) AS reads FROM f WHERE contig < 3 GROUP BY region_id, rev""",
    "longest_reads": f"WITH {X.READS} SELECT read_id % 11 AS part, max(length(seq)) AS read_len FROM reads GROUP BY 1",
    "widest_insert": f"""WITH {X.HITS}, s AS (SELECT sample, offset_end + score AS x FROM hits), m AS (SELECT sample, CAST(floor(avg(x)) AS BIGINT) AS mean FROM s GROUP BY sample),
        d AS (SELECT sample, mean, CAST(floor(sqrt(avg((x - mean) * (x - mean)))) AS BIGINT) AS sd FROM s JOIN m USING (sample) WHERE x > mean GROUP BY sample, mean) SELECT max(mean + 5 * sd) AS max_is FROM d""",
    "breakpoint_extent": f'WITH {X.HITS} SELECT region_id, rev, min(offset_start) AS start, max(offset_end) AS "end", CASE WHEN rev THEN min(offset_start) ELSE max(offset_end) END AS bp FROM hits WHERE score > 30 GROUP BY region_id, rev',
    "call_support": f"""WITH {X.HITS} SELECT region_id, rev, count(*) AS reads, count(DISTINCT CASE WHEN NOT suspicious AND NOT too_long THEN qname END) AS good_pairs, round(avg(score / (offset_end - offset_start + 1)), 6) AS score_ratio FROM hits GROUP BY region_id, rev""",
    "split_read_count": f"""WITH {X.HITS}, {_MODE} SELECT h.region_id, h.rev, count(CASE WHEN CASE WHEN h.rev THEN lclip ELSE rclip END >= 5 AND abs(CASE WHEN h.rev THEN offset_start ELSE offset_end END - position) <= 10 THEN 1 END) AS split_reads
        FROM hits h JOIN modes m ON m.region_id = h.region_id AND m.rev = h.rev AND m.n = 1 GROUP BY ALL""",
    "pileup_consensus": f"""WITH {X.READS}, b AS (SELECT read_id % 20 AS region_id, i AS place, substr(seq, CAST(i AS INTEGER) + 1, 1) AS base FROM reads, unnest(generate_series(0, length(seq) - 1)) AS t(i)),
        c AS (SELECT region_id, place, base, count(*) AS v FROM b GROUP BY ALL),
        r AS (SELECT *, row_number() OVER w AS n, lead(v) OVER w AS nx, sum(v) OVER (PARTITION BY region_id, place) AS depth FROM c WINDOW w AS (PARTITION BY region_id, place ORDER BY v DESC, base))
        SELECT region_id, place, CAST(depth AS BIGINT) AS depth, CASE WHEN v >= 2 AND (nx IS NULL OR v > nx) THEN base ELSE 'N' END AS consensus FROM r WHERE n = 1""",
    "strand_list_routing": f"""WITH {X.HITS}, r AS (SELECT region_id, rev FROM hits WHERE NOT secondary UNION ALL SELECT region_id, true FROM hits WHERE secondary AND lclip * 3 >= 20 UNION ALL SELECT region_id, false FROM hits WHERE secondary AND rclip * 3 >= 20)
        SELECT rev, region_id, count(*) AS reads FROM r GROUP BY ALL""",
    "masked_length": f"""WITH {X.HITS}, m AS (SELECT qname % 500 AS call_id, CASE WHEN rev THEN 'host' ELSE 'virus' END AS side, offset_end - offset_start + 1 AS masked, row_number() OVER (PARTITION BY qname % 500, rev ORDER BY read_id DESC, offset_start DESC, offset_end DESC) AS n FROM hits)
        SELECT call_id, side, masked FROM m WHERE n = 1""",
    "call_accept_rules": f"""WITH {X.CALLS}, b AS (SELECT *, (pbs >= 0.8 AND NOT (good_pairs < 3 OR (good_pairs = 3 AND split_reads = 0)) AND host_len >= 30 AND virus_len >= 30) OR (coverage >= 0.5 AND good_pairs > 2) AS ok,
        host_masked > 0.8 * host_len OR virus_masked > 0.8 * virus_len AS masked FROM calls)
        SELECT id, ok AND NOT masked AS accepted, (ok OR split_reads > 0) AND NOT masked AS accepted_clipped FROM b""",
    "call_text": f"""WITH {X.CALLS} SELECT id, id || ' chr1:-:' || host_pos || ':' || (host_pos + 9) || ' v:+:' || virus_pos || ':' || (virus_pos + 9) || ' ' || good_pairs || ' ' || good_pairs || ' ' || split_reads || ' 0 0.500000 0.250000 0 0 0.750000 0.500000' AS line,
        'ID=' || id || ' chr1:-' || host_pos || ' v:+' || virus_pos || ' SUPPORTING_PAIRS=' || good_pairs || ' SPLIT_READS=' || split_reads || ' HOST_PBS=0.500000 COVERAGE=0.625000' || CASE WHEN id % 3 = 0 THEN ' PAIRED WITH ID=' || (id + 1) ELSE '' END AS human,
        host_pos + 9 AS host_end, split_reads AS splits, CAST(0.75 AS DOUBLE) AS host_cov FROM calls""",
    "alternative_loci": """WITH r AS (SELECT o_orderkey AS id, o_orderkey % 2 = 0 AS l, o_custkey % 3 = 0 AS rev, o_custkey AS c FROM orders WHERE o_orderkey % 5 <> 0)
        SELECT id, 'ID=' || id || ' chr9:' || CASE WHEN rev <> l THEN '-' || c ELSE '+' || (c + 30) END AS line FROM r
        UNION ALL SELECT id, 'ID=' || id || ' chr2:+' || (id + 31) FROM r UNION ALL SELECT id, 'ID=' || id || ' chr3:-' || (c + 7) FROM r""",
}
