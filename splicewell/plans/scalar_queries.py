"""Queries of projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import cigar as C
from ..functions import packed
from ..functions import sequence as S
from ..operators import pairs as P
from ..operators.sizes import spread
from . import fixtures as X


def rc_projection(spark, sf):
    text = X.table(spark, sf, "documents")
    rc = S.reverse_complement(F.translate("text", "acgt", "ACGT"))
    return text.select("doc_id", F.length(rc).cast("long").alias("n"), F.md5(rc).alias("rc_md5"))


def _kmer_summary(spark, sf):
    """Of each read_id, over all its sequences."""
    seqs = spread(X.reads(spark, sf), "read_id").groupBy("read_id").agg(F.collect_list("seq").alias("seqs"))
    return seqs.select("read_id", packed.kmer_summary(F.col("seqs"), 13).alias("found")).where("found is not null").select("read_id", "found.*")


def kmer_counts(spark, sf):
    return _kmer_summary(spark, sf).select("read_id", "n", "n_distinct")


def valid_kmer_filter(spark, sf):
    return _kmer_summary(spark, sf).select("read_id", "n_valid", "most")


def two_bit_encode(spark, sf):
    k = X.targets(spark, sf).select("region_id", F.posexplode(S.kmers(F.col("seq"), 18)).alias("pos", "kmer"))
    return k.select("region_id", F.col("pos").cast("long").alias("pos"), S.two_bit(F.col("kmer"), 18).alias("packed"))


def spaced_seed_projection(spark, sf):
    k = X.targets(spark, sf).select("region_id", F.posexplode(S.kmers(F.col("seq"), 18)).alias("pos", "kmer"))
    return k.select("region_id", F.col("pos").cast("long").alias("pos"), *[S.spaced_seed(F.col("kmer"), j).alias(f"seed{j}") for j in range(6)])


def poly_base_flag(spark, sf):
    r = X.reads(spark, sf)
    return r.select("read_id", S.most_frequent_base(F.col("seq")).cast("long").alias("most"), S.is_poly(F.col("seq"), 0.4).alias("poly"))


def low_complexity_flag(spark, sf):
    two = spread(X.reads(spark, sf), "read_id").select("read_id", F.explode(S.kmers(F.col("seq"), 2)).alias("pair"))
    counts = two.groupBy("read_id", "pair").agg(F.count("*").alias("c"))
    n = F.row_number().over(W.Window.partitionBy("read_id").orderBy(F.desc("c"), "pair"))
    top = counts.withColumn("r", n).groupBy("read_id").agg(F.sum(F.when(F.col("r") <= 2, F.col("c"))).alias("top2"), (F.sum("c") + 2).alias("n"))
    return top.select("read_id", "top2", (F.col("top2") >= 0.75 * F.col("n")).alias("low_complexity"))


def low_complexity_reads(spark, sf):
    h = X.hits(spark, sf).select("read_id", "pos", "quality").distinct().withColumn("seq", F.expr(X.SEQ))
    found = h.select("read_id", "pos", "quality", S.top_pairs(F.col("seq")).cast("long").alias("top2"), F.length("seq").alias("length"))
    return found.select("read_id", "pos", "quality", "top2", S.is_low(F.col("top2"), F.col("length")).alias("low"))


def turned_reads(spark, sf):
    h = X.hits(spark, sf).select("read_id", "pos", "quality", "flag").distinct().withColumn("seq", F.expr(X.SEQ))
    quals = F.transform(F.sequence(F.lit(1), F.length("seq")), lambda i: F.pmod(F.col("pos") + i * 7, F.lit(40)))
    one = S.forward(F.col("seq"), quals, F.col("flag"), compat=False)
    return h.select("read_id", "pos", "quality", "flag", one["seq"].alias("fwd"), one["quals"][0].cast("long").alias("q0"), one["flag"].cast("long").alias("fwd_flag"))


def clip_qualities(spark, sf):
    h = X.hits(spark, sf).select("read_id", "pos", "flag", "lclip", "rclip", "rev").distinct()
    quals = F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.pmod(F.col("pos") + i * 7, F.lit(40)))
    made = {s: S.clip_quality(quals, F.col("flag"), F.col("rev"), F.col(c).cast("int"), s).cast("long") for s, c in (("L", "lclip"), ("R", "rclip"))}
    return h.select("read_id", "pos", "flag", "lclip", "rclip", "rev", made["L"].alias("left_quality"), made["R"].alias("right_quality"))


def circular_places(spark, sf):
    return X.anchors(spark, sf).select("id", S.on_circle(F.col("start"), F.col("contig") * 30 + 45).cast("long").alias("place"))


def flag_predicates(spark, sf):
    h = X.hits(spark, sf)
    flag = F.col("flag")
    names = {"unmapped": 4, "mate_unmapped": 8, "reverse": 16, "secondary_flag": 256, "duplicate": 1024}
    return h.groupBy("flag").agg(
        *[F.count_if(S.has_flag(flag, b)).alias(k) for k, b in names.items()],
        F.count_if(S.primary(flag)).alias("primary_reads"),
        F.count_if(S.discordant(flag, F.col("contig"), F.col("mate_contig"), F.col("isize"))).alias("discordant"),
    )


def cigar_lengths(spark, sf):
    h = X.hits(spark, sf).select("read_id", "lclip", "rclip", "quality", "pos").distinct()
    text = F.concat(F.when(F.col("lclip") > 0, F.concat(F.col("lclip").cast("string"), F.lit("S"))).otherwise(""), F.col("quality").cast("string"), F.lit("M2D"), (F.col("quality") + 3).cast("string"), F.lit("=1X4I5M"), F.when(F.col("rclip") > 0, F.concat(F.col("rclip").cast("string"), F.lit("S"))).otherwise(""))
    made = h.withColumn("cigar", text).withColumn("ops", C.parse(F.col("cigar")))  # a column, so that it is parsed once
    ops = F.col("ops")
    return made.select(
        "read_id", "pos", "cigar",
        C.query_length(ops).cast("long").alias("qlen"), C.reference_length(ops).cast("long").alias("rlen"), C.end_position(F.col("pos"), ops).cast("long").alias("endpos"),
        C.clip(ops, "L").cast("long").alias("left_clip"), C.clip(ops, "R").cast("long").alias("right_clip"), C.text(C.normalise(ops)).alias("normal"), (C.text(ops) == F.col("cigar")).alias("round_trip"),
    )


def average_quality(spark, sf):
    q = X.hits(spark, sf).groupBy("qname").agg(F.sort_array(F.collect_list(F.col("quality").cast("int"))).alias("quals"), F.max("flag").alias("flag"))
    return q.select("qname", S.average_quality(F.col("quals")).cast("long").alias("avg_quality"), S.original_qualities(F.col("quals"), F.col("flag")).alias("qual_text"))


def clip_extract(spark, sf):
    r = X.reads(spark, sf).withColumn("lclip", (F.col("read_id") % 50).cast("int")).withColumn("rclip", (F.col("read_id") * 7 % 60).cast("int")).where(F.length("seq") > 130)
    return P.clips(r, "seq", "lclip", "rclip").select("read_id", "side", "clip_seq")


def anchor_distance(spark, sf):
    w = W.Window.partitionBy("contig", "strand").orderBy("start", "end", "id")
    a = X.anchors(spark, sf).withColumn("s2", F.lead("start").over(w)).withColumn("e2", F.lead("end").over(w)).where("s2 is not null")
    return a.select("id", S.anchor_distance(F.col("start"), F.col("end"), F.col("s2"), F.col("e2")).alias("distance"), F.least("start", "s2").alias("start"), F.greatest("end", "e2").alias("end"), S.overlap(F.col("start"), F.col("end"), F.col("s2"), F.col("e2")).alias("overlap"))


def region_snap(spark, sf):
    low, high = S.region_snap(F.col("start"), F.col("end"), F.col("end") + 111)
    return X.anchors(spark, sf).select("id", low.cast("long").alias("low"), high.cast("long").alias("high"))


def breakpoint_round_trip(spark, sf):
    c = X.calls(spark, sf).withColumn("end", F.col("host_pos") + 40)
    text = S.breakpoint_text(F.col("host_chr").cast("string"), F.col("host_rev"), F.col("host_pos"), F.col("end"))
    back = S.breakpoint_parse(F.col("text"))
    c = c.withColumn("text", text)
    return c.select("id", "text", S.breakpoint_human(F.col("host_chr").cast("string"), F.col("host_rev"), F.col("host_pos"), F.col("end")).alias("human"), (back["start"] + back["end"]).cast("long").alias("ends"), back["rev"].alias("rev"))


def circular_sequence(spark, sf):
    t = X.targets(spark, sf)
    return t.select("region_id", F.md5(S.circular(F.col("seq"))).alias("circular_md5"), F.length(S.circular(F.col("seq"))).cast("long").alias("eff_len"), S.original_length(F.length(S.circular(F.col("seq")))).cast("long").alias("orig_len"))


def xa_explode(spark, sf):
    o = X.table(spark, sf, "orders")
    xa = F.concat(F.lit("chr"), (F.col("o_custkey") % 7).cast("string"), F.lit(",-"), (F.col("o_orderkey") + 5).cast("string"), F.lit(",40M,1;chr"), (F.col("o_orderkey") % 9).cast("string"), F.lit(",+"), F.col("o_custkey").cast("string"), F.lit(",38M2S,0;"))
    x = o.select("o_orderkey", F.posexplode(C.alternatives(xa)).alias("n", "a"))
    return x.select("o_orderkey", F.col("n").cast("long").alias("n"), "a.contig", "a.strand", F.col("a.pos").cast("long").alias("pos"), "a.cigar", C.query_length(C.parse(F.col("a.cigar"))).cast("long").alias("qlen"))


QUERIES = {f.__name__: f for f in (rc_projection, kmer_counts, valid_kmer_filter, two_bit_encode, spaced_seed_projection, poly_base_flag, low_complexity_flag, low_complexity_reads, turned_reads, clip_qualities, circular_places, flag_predicates, cigar_lengths, average_quality, clip_extract, anchor_distance, region_snap, breakpoint_round_trip, circular_sequence, xa_explode)}

_KMERS = lambda source, key, k: f"kmers AS (SELECT {key}, i AS pos, substr(seq, CAST(i AS INTEGER) + 1, {k}) AS kmer FROM {source}, unnest(generate_series(0, length(seq) - {k})) AS t(i))"
_MOST = "greatest({0})".format(", ".join(f"length(kmer) - length(replace(kmer, '{b}', ''))" for b in "ACGT"))

ORACLES = {
    "rc_projection": """SELECT doc_id, length(text) AS n, md5(reverse(translate(regexp_replace(translate(text, 'acgt', 'ACGT'), '[^ACGT]', 'N', 'g'), 'ACGT', 'TGCA'))) AS rc_md5 FROM documents""",
    "kmer_counts": f"WITH {X.READS}, {_KMERS('reads', 'read_id', 13)} SELECT read_id, count(*) AS n, count(DISTINCT kmer) AS n_distinct FROM kmers GROUP BY read_id",
    "valid_kmer_filter": f"WITH {X.READS}, {_KMERS('reads', 'read_id', 13)} SELECT read_id, count(CASE WHEN {_MOST} < 11 THEN 1 END) AS n_valid, max({_MOST}) AS most FROM kmers GROUP BY read_id",
    "two_bit_encode": f"WITH {X.TARGETS}, {_KMERS('targets', 'region_id', 18)} SELECT region_id, pos, CAST("
    + " + ".join(f"(strpos('ACGT', substr(kmer, {i + 1}, 1)) - 1) * {4 ** (17 - i)}" for i in range(18))
    + " AS BIGINT) AS packed FROM kmers",
    "spaced_seed_projection": f"WITH {X.TARGETS}, {_KMERS('targets', 'region_id', 18)} SELECT region_id, pos, " + ", ".join(f"substr(kmer, 1, {15 - 3 * j}) || substr(kmer, {19 - 3 * j}, {3 * j}) AS seed{j}" for j in range(6)) + " FROM kmers",
    "poly_base_flag": f"WITH {X.READS} SELECT read_id, {_MOST.replace('kmer', 'seq')} AS most, {_MOST.replace('kmer', 'seq')} >= 0.4 * length(seq) AS poly FROM reads",
    "low_complexity_flag": f"""WITH {X.READS}, {_KMERS('reads', 'read_id', 2)}, counts AS (SELECT read_id, kmer, count(*) AS c FROM kmers GROUP BY 1, 2),
        top AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY c DESC, kmer) AS r FROM counts)
        SELECT t.read_id, CAST(sum(c) AS BIGINT) AS top2, sum(c) >= 0.75 * (max(length(seq)) + 1) AS low_complexity FROM top t JOIN reads USING (read_id) WHERE r <= 2 GROUP BY t.read_id""",
    "low_complexity_reads": f"""WITH {X.HITS}, d AS (SELECT DISTINCT read_id, pos, quality FROM hits), s AS (SELECT *, {X.SEQ} AS seq FROM d),
        c AS (SELECT *, list_reverse_sort([{", ".join(f"len(list_filter(generate_series(1, length(seq) - 1), lambda i : substr(seq, CAST(i AS INTEGER), 2) = '{a}{b}'))" for a in "ACGT" for b in "ACGT")}]) AS n FROM s)
        SELECT read_id, pos, quality, n[1] + n[2] AS top2, n[1] + n[2] >= 0.75 * (length(seq) + 1) AS low FROM c""",
    "turned_reads": f"""WITH {X.HITS}, d AS (SELECT DISTINCT read_id, pos, quality, flag FROM hits), s AS (SELECT *, {X.SEQ} AS seq FROM d)
        SELECT read_id, pos, quality, flag, CASE WHEN flag & 16 > 0 THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END AS fwd,
        CASE WHEN flag & 16 > 0 THEN (pos + 7 * length(seq)) % 40 ELSE (pos + 7) % 40 END AS q0, CASE WHEN flag & 16 > 0 THEN flag - 16 ELSE flag END AS fwd_flag FROM s""",
    "clip_qualities": f"""WITH {X.HITS}, d AS (SELECT DISTINCT read_id, pos, flag, lclip, rclip, rev FROM hits), q AS (SELECT *, list_transform(generate_series(1, 30), lambda i : (pos + i * 7) % 40) AS q, (flag & 16 > 0) <> rev AS turned FROM d)
        SELECT read_id, pos, flag, lclip, rclip, rev,
        coalesce(CAST(floor(list_avg(CASE WHEN turned THEN q[31 - lclip:30] ELSE q[1:lclip] END)) AS BIGINT), 0) AS left_quality,
        coalesce(CAST(floor(list_avg(CASE WHEN turned THEN q[1:rclip] ELSE q[31 - rclip:30] END)) AS BIGINT), 0) AS right_quality FROM q""",
    "circular_places": f"WITH {X.ANCHORS} SELECT id, start % (contig * 30 + 45 - (contig * 30 + 45) // 3) AS place FROM anchors",
    "flag_predicates": f"""WITH {X.HITS} SELECT flag, count(CASE WHEN flag & 4 > 0 THEN 1 END) AS unmapped, count(CASE WHEN flag & 8 > 0 THEN 1 END) AS mate_unmapped,
        count(CASE WHEN flag & 16 > 0 THEN 1 END) AS reverse, count(CASE WHEN flag & 256 > 0 THEN 1 END) AS secondary_flag, count(CASE WHEN flag & 1024 > 0 THEN 1 END) AS duplicate,
        count(CASE WHEN flag & 2304 = 0 THEN 1 END) AS primary_reads, count(CASE WHEN flag & 12 = 0 AND (contig <> mate_contig OR abs(isize) > 100000) THEN 1 END) AS discordant FROM hits GROUP BY flag""",
    "cigar_lengths": f"""WITH {X.HITS}, d AS (SELECT DISTINCT read_id, lclip, rclip, quality AS q, pos FROM hits),
        c AS (SELECT *, CASE WHEN lclip > 0 THEN lclip || 'S' ELSE '' END AS l, CASE WHEN rclip > 0 THEN rclip || 'S' ELSE '' END AS r FROM d)
        SELECT read_id, pos, l || q || 'M2D' || (q + 3) || '=1X4I5M' || r AS cigar, lclip + q + q + 3 + 1 + 4 + 5 + rclip AS qlen, q + 2 + q + 3 + 1 + 5 AS rlen, pos + q + 2 + q + 3 + 1 + 5 AS endpos,
        lclip AS left_clip, rclip AS right_clip, l || q || 'M2D' || (q + 4) || 'M4I5M' || r AS normal, true AS round_trip FROM c""",
    "average_quality": f"""WITH {X.HITS}, q AS (SELECT qname, sum(quality) AS s, count(*) AS n, max(flag) AS flag, string_agg(chr(CAST(quality + 33 AS INTEGER)), '' ORDER BY quality) AS t FROM hits GROUP BY qname)
        SELECT qname, CAST(s // n AS BIGINT) AS avg_quality, CASE WHEN flag & 16 > 0 THEN reverse(t) ELSE t END AS qual_text FROM q""",
    "clip_extract": f"""WITH {X.READS}, c AS (SELECT read_id, seq, read_id % 50 AS l, read_id * 7 % 60 AS r FROM reads WHERE length(seq) > 130)
        SELECT read_id, CASE WHEN l >= 20 THEN 'L' ELSE 'R' END AS side, CASE WHEN l >= 20 THEN substr(seq, 1, l) ELSE substr(seq, length(seq) - r, r) END AS clip_seq FROM c WHERE l >= 20 OR r >= 20""",
    "anchor_distance": f"""WITH {X.ANCHORS}, n AS (SELECT id, start AS s1, "end" AS e1, lead(start) OVER w AS s2, lead("end") OVER w AS e2 FROM anchors WINDOW w AS (PARTITION BY contig, strand ORDER BY start, "end", id)),
        o AS (SELECT *, least(e1, e2) - greatest(s1, s2) AS o FROM n WHERE s2 IS NOT NULL)
        SELECT id, CASE WHEN o > 0 THEN -(100 * o // least(e1 - s1 + 1, e2 - s2 + 1)) ELSE least(abs(s1 - e2), abs(s2 - e1), abs(s1 - s2), abs(e1 - e2)) END AS distance,
        least(s1, s2) AS start, greatest(e1, e2) AS "end", greatest(0, o + 1) AS overlap FROM o""",
    "region_snap": f"""WITH {X.ANCHORS} SELECT id, start // 500 * 500 AS low, least("end" // 500 * 500 + 500, "end" + 111) AS high FROM anchors""",
    "breakpoint_round_trip": f"""WITH {X.CALLS} SELECT id, host_chr || ':' || CASE WHEN host_rev THEN '-' ELSE '+' END || ':' || host_pos || ':' || (host_pos + 40) AS text,
        host_chr || ':' || CASE WHEN host_rev THEN '-' || host_pos ELSE '+' || (host_pos + 40) END AS human, 2 * host_pos + 40 AS ends, host_rev AS rev FROM calls""",
    "circular_sequence": f"""WITH {X.TARGETS} SELECT region_id, md5(seq || substr(seq, 1, length(seq) // 2)) AS circular_md5, length(seq) + length(seq) // 2 AS eff_len,
        length(seq) + length(seq) // 2 - (length(seq) + length(seq) // 2) // 3 AS orig_len FROM targets""",
    "xa_explode": """SELECT o_orderkey, 0 AS n, 'chr' || (o_custkey % 7) AS contig, '-' AS strand, o_orderkey + 5 AS pos, '40M' AS cigar, 40 AS qlen FROM orders
        UNION ALL SELECT o_orderkey, 1, 'chr' || (o_orderkey % 9), '+', o_custkey, '38M2S', 40 FROM orders""",
}
