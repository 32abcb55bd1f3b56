"""Prefix trie of conversations, by prefix doubling.

Turns get dense names, then blocks of 2, 4, 8 ... turns, each from the names of its two halves, in one join a power of
two. A prefix of d turns falls into blocks by the binary digits of d, so prefixes are named in as many rounds again:
those whose lowest digit is 2^k from a shorter prefix, named before, and one block. A prefix's name is the
smallest conversation that begins with it, which with the depth is the trie's node. What is summed over subtrees also
takes a round for each power of two: what lies 2^k deeper adds its own sums of less than 2^k levels.

Positions come from a sort over ranges and the sizes of the ranges, so a conversation of any length is dealt over
many tasks, and rows of common keys meet their group by broadcast (see common.meet). Texts don't travel, their digests
do. Only the longest length, the smallest id and sizes by partition reach the driver.

Defined results: turns without a conversation are left out; null roles and texts are empty; a null turn comes first;
equal turn numbers are ordered by role, then by the SHA-256 of role and text; repeated rows are turns of their own. A
table without conversations has no node, not even the root. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Ids that one row carries towards the digest of a node's ends.
PIECE = 4096
#: Low bits of Spark's increasing ids: the row within its partition.
ROW_BITS = 33


def _dense(table: common.Written, raw: str, into: str) -> tuple[DataFrame, int]:
    """Increasing ids of a written table, made dense by the sizes of the partitions before; and their number."""
    part = F.shiftright(F.col(raw), ROW_BITS)
    starts, total = [], 0
    for row in table.df.groupBy(part.alias("part")).count().orderBy("part").collect():  # one row for each partition
        starts.append((row["part"], total))
        total += row["count"]
    before = F.broadcast(table.spark.createDataFrame(starts, "part long, before long"))
    at = F.col(raw) - F.shiftleft(part, ROW_BITS) + F.col("before")
    return table.df.withColumn("part", part).join(before, "part").withColumn(into, at).drop("part", "before", raw), total


def _named(df: DataFrame, keys: list[str], into: str) -> DataFrame:
    """Adds the dense name of a written table's keys, from 0 up."""
    groups = common.Written(df.groupBy(*keys).agg(F.count("*").alias("__rows")).withColumn("__raw", F.monotonically_increasing_id()))
    found, _ = _dense(groups, "__raw", into)
    total = groups.df.agg(F.sum("__rows")).first()[0] or 0
    return common.meet(df, found, keys, "__rows", total)


def numbered(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Turns (conv, at, key, size): place from 0, digest of role and text, the text's bytes; and conversations (conv, length)."""
    who, what = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, what).cast("binary"), 256))
    rows = df.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), who.alias("role"), key.alias("key"), F.octet_length(what).cast("long").alias("size"))
    order = ["conv", F.asc_nulls_first("turn"), "role", "key"]
    table = common.Written(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "key", "size", F.monotonically_increasing_id().alias("raw")))
    places, total = _dense(table, "raw", "row")
    convs = common.Written(places.groupBy("conv").agg(F.min("row").alias("first"), F.count("*").alias("length")))
    met = common.meet(places, convs.df.withColumn("rows", F.col("length")), ["conv"], "rows", total)
    return met.select("conv", (F.col("row") - F.col("first")).alias("at"), "key", "size"), convs.df.select("conv", "length")


def prefixes(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, int]:
    """(conv, depth, node) for all prefixes of each conversation, the empty one included; and the largest depth.

    turns: a written table (conv, at, key); convs: a written one (conv, length).
    """
    spark = turns.sparkSession
    longest, root = convs.agg(F.max("length"), F.min("conv")).first()
    blocks = [common.Written(_named(turns.select("conv", "at", "key"), ["key"], "name").select("conv", "at", "name"))]
    while 2 ** len(blocks) <= longest:
        half = lambda odd: F.max(F.when(F.col("at").bitwiseAND(1) == odd, F.col("name")))
        pairs = blocks[-1].df.groupBy("conv", F.shiftright("at", 1).alias("next")).agg(half(0).alias("one"), half(1).alias("two"))
        whole = common.Written(pairs.where("one is not null and two is not null").withColumnRenamed("next", "at"))
        blocks.append(common.Written(_named(whole.df, ["one", "two"], "name").select("conv", "at", "name")))
        whole.drop()
    done = [common.Written(convs.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(root).cast("long").alias("node")))]
    for k in reversed(range(len(blocks))):
        so_far = spark.read.schema(done[0].df.schema).parquet(*[d.path for d in done])
        even = blocks[k].df.where(F.col("at").bitwiseAND(1) == 0).select("conv", F.shiftleft("at", k).alias("depth"), "name")
        step = common.Written(even.join(so_far.withColumnRenamed("node", "up"), ["conv", "depth"]))
        groups = common.Written(step.df.groupBy("up", "depth", "name").agg(F.min("conv").alias("node"), F.count("*").alias("rows")))
        total = groups.df.agg(F.sum("rows")).first()[0] or 0
        met = common.meet(step.df, groups.df, ["up", "depth", "name"], "rows", total)
        done.append(common.Written(met.select("conv", (F.col("depth") + 2**k).alias("depth"), "node")))
        for table in (step, groups, blocks[k]):
            table.drop()
    return spark.read.schema(done[0].df.schema).parquet(*[d.path for d in done]), longest


def digests_of_ends(ends: DataFrame) -> DataFrame:
    """(node, depth, sha): SHA-256 of the conv ids of each (node, depth), ascending, comma-joined.

    Ids are sorted over ranges and joined to pieces there; only pieces meet in a node's task, which hashes them one
    by one.
    """
    where = ["node", "depth"]
    common.small_batches(ends.sparkSession)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []
        for batch in batches:
            out: list[tuple[int, int, int, str]] = []
            for node, depth, conv in zip(*(common.values(batch.column(c)) for c in ("node", "depth", "conv")), strict=True):
                if (node, depth) != key or len(ids) == PIECE:
                    out += [(*key, ids[0], ",".join(map(str, ids)))] if ids else []
                    key, ids = (node, depth), []
                ids.append(conv)
            yield rows(out)
        yield rows([(*key, ids[0], ",".join(map(str, ids)))] if ids else [])

    def rows(out: list[tuple[int, int, int, str]]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["node", "depth", "first", "ids"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, hashlib.sha256()
        for batch in batches:
            out = []
            for node, depth, ids in zip(*(common.values(batch.column(c)) for c in ("node", "depth", "ids")), strict=True):
                if (node, depth) == key:
                    state.update(b",")
                else:
                    out += [(*key, state.hexdigest())] if key else []
                    key, state = (node, depth), hashlib.sha256()
                state.update(ids.encode())
            yield sums(out)
        yield sums([(*key, state.hexdigest())] if key else [])

    def sums(out: list[tuple[int, int, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string()))], ["node", "depth", "sha"])

    order = [*where, "conv"]
    joined = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pieces, "node long, depth long, first long, ids string")
    return joined.repartition(*where).sortWithinPartitions(*where, "first").mapInArrow(hashes, "node long, depth long, sha string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each node: (node, depth, parent, n_convs, n_children, n_leaves, saved, ends).

    turns: a written table (conv, at, key, size) with places from 0 up; convs: a written one (conv, length), one row for
    each conversation, turnless ones included. node is the smallest conversation of the node's members, parent that of its
    parent's; saved and n_leaves are summed over the subtree, ends is the digest of the members that end here.
    """
    named, longest = prefixes(turns, convs)
    above = named.select(F.col("conv").alias("node"), (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    last = turns.select(F.col("conv").alias("node"), (F.col("at") + 1).alias("depth"), "size")
    members = named.groupBy("node", "depth").agg(F.count("*").alias("n_convs"))
    base = common.Written(members.join(last, ["node", "depth"], "left").join(above, ["node", "depth"], "left"))
    children = base.df.where("depth > 0").groupBy(F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    own = base.df.join(children, ["node", "depth"], "left").na.fill(0, ["n_children", "size"])
    own = own.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("size"))
    sums, reach = common.Written(own.select("node", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved")), 1
    while reach <= longest:
        upper = named.select(F.col("conv").alias("node"), (F.col("depth") + reach).alias("depth"), F.col("node").alias("top"))
        deep = sums.df.where(F.col("depth") >= reach).join(upper, ["node", "depth"])
        deep = deep.groupBy(F.col("top").alias("node"), (F.col("depth") - reach).alias("depth")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        met = sums.df.join(deep, ["node", "depth"], "left").na.fill(0, ["more_leaves", "more_saved"])
        grown = met.withColumns({"n_leaves": F.col("n_leaves") + F.col("more_leaves"), "saved": F.col("saved") + F.col("more_saved")}).drop("more_leaves", "more_saved")
        before, sums = sums, common.Written(grown)
        before.drop()
        reach *= 2
    ends = named.join(convs.select("conv", F.col("length").alias("depth")), ["conv", "depth"])
    return sums.df.join(digests_of_ends(ends), ["node", "depth"], "left").withColumn("ends", F.coalesce("sha", F.sha2(F.lit(b""), 256))).drop("sha")


def _share(conv: Column) -> Column:
    """How many first turns a conversation takes over."""
    return F.crc32(conv.cast("string").cast("binary")) % 9


def rebuilt(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first turns of the one five of them share, as turns and lengths."""
    convs = convs.withColumns({"share": _share(F.col("conv")), "base": F.col("conv") - F.col("conv") % 5})
    other = convs.select(F.col("conv").alias("base"), F.col("length").alias("there"))
    plan = common.Written(convs.join(other, "base", "left").withColumn("taken", F.least("share", F.coalesce("there", F.lit(0)))))
    total = turns.count()
    own = common.meet(turns, plan.df.select("conv", "share", "taken", "length"), ["conv"], "length", total).where(F.col("at") >= F.col("share"))
    own = own.select("conv", (F.col("taken") + F.col("at") - F.col("share")).alias("at"), "key", "size")
    heads = turns.where((F.col("at") < 8) & (F.col("conv") % 5 == 0)).withColumnRenamed("conv", "base")
    heads = heads.join(plan.df.select("conv", "base", "share"), "base").where(F.col("at") < F.col("share")).select("conv", "at", "key", "size")
    lengths = plan.df.select("conv", (F.col("taken") + F.greatest(F.col("length") - F.col("share"), F.lit(0))).alias("length"))
    return own.unionByName(heads), lengths


def op13_trie(spark, sf_dir: str) -> DataFrame:
    turns, convs = numbered(common.table(spark, sf_dir, "conversations"))
    turns, convs = (common.Written(x).df for x in rebuilt(common.Written(turns).df, convs))
    if convs.isEmpty():
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    return prefix_trie(turns, convs).select(
        F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256")
    )


_BIT = "CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END"
_BYTES = "list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))"
_CRC = f"xor(list_reduce({_BYTES}, lambda c, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: {_BIT}, xor(c, b)), 4294967295::BIGINT), 4294967295)"
OP13_SQL = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS key,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS i
    FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS b, {_CRC} % 9 AS h, n FROM (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id)),
r AS (SELECT c.conv_id, t.i, t.key, octet_length(encode(t.text)) AS size FROM c JOIN t ON t.conv_id = c.b WHERE t.i < c.h
    UNION ALL SELECT c.conv_id, least(c.h, coalesce(o.n, 0)) + t.i - c.h, t.key, octet_length(encode(t.text)) FROM c JOIN t ON t.conv_id = c.conv_id LEFT JOIN c AS o ON o.conv_id = c.b WHERE t.i >= c.h),
p AS (SELECT conv_id, i + 1 AS depth, size, sha256(string_agg(key, ',') OVER (PARTITION BY conv_id ORDER BY i)) AS prefix FROM r
    UNION ALL SELECT conv_id, 0, 0, '' FROM c),
w AS (SELECT *, lag(prefix) OVER (PARTITION BY conv_id ORDER BY depth) AS above, max(depth) OVER (PARTITION BY conv_id) AS length FROM p),
n AS (SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, min(above) AS above, (count(*) - 1) * min(size) AS saved,
    string_agg(CASE WHEN depth = length THEN conv_id END, ',' ORDER BY conv_id) AS ends FROM w GROUP BY depth, prefix),
k AS (SELECT depth - 1 AS depth, above AS prefix, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY depth, above),
v AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k ON k.depth = n.depth AND k.prefix = n.prefix),
s AS (SELECT p.depth, p.prefix, count(*) FILTER (WHERE v.n_children = 0) AS n_leaves, sum(v.saved) AS saved_tokens
    FROM v JOIN p ON p.conv_id = v.conv_id AND p.depth <= v.depth GROUP BY p.depth, p.prefix)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, v.n_convs, CAST(v.n_children AS BIGINT) AS n_children, s.n_leaves,
    CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
FROM v JOIN s ON s.depth = v.depth AND s.prefix = v.prefix LEFT JOIN n AS u ON u.depth = v.depth - 1 AND u.prefix = v.above
"""
