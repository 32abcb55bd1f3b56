"""Links between texts whose sets of five-word shingles have a Jaccard similarity of 0.8 at least.

Exact: of two such sets, ordered by any one order of all shingles, the first n - ceil(0.8 n) + 1 of each meet
(prefix filter), and where they meet first, enough of both is left after it (position filter). The order is by how often
shingles occur, counted in hashed counters, so that common ones come last. Texts with equal sets are one class. Classes
that meet in a shingle are first compared to one of them; what is then connected needs no more comparing, the rest is
compared pair by pair, or in cells of many block by block in tasks, which give only what connects. SimHash fingerprints within
reach through the pivots' distance tables (simhash.links) are compared as well. Before texts are fetched to verify a pair, a
map of parities tells most that aren't similar: two sets differ in as many shingles at least as their maps do in bits. Of a
class one text is fetched, compressed, which is smaller than its shingles. In cells a class goes by 64 bits of its digest;
classes that share these are compared as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import components

SHINGLE = 5
#: Counters for the order of shingles, and those in one row while they are added up.
COUNTERS, BLOCK = 1 << 22, 1 << 16
#: Words of 64 bits in a set's map of parities.
PARITY = 8
#: Bits of the map of wanted texts: texts outside it aren't wanted.
MAP_BITS = 24
#: Classes in a cell beyond which it is compared in blocks of so many.
HOT_CELL, HOT_BLOCK = 48, 250
#: Shingles that the table of members and shingles of two blocks holds at a time.
COLUMNS = 8192


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct hashes of the shingles, sorted; words as in simhash.shingle_hashes."""
    from .simhash import shingle_hashes

    return np.unique(np.array(shingle_hashes(text, SHINGLE), dtype=np.uint64)).view(np.int64)


def class_of(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def digest(text: str | None) -> bytes:
    return xxhash.xxh3_128_digest((text or "").encode())


def parities(found: np.ndarray) -> np.ndarray:
    """Whether an odd number of a set's shingles falls on each bit."""
    odd = np.bincount(found.view(np.uint64) % np.uint64(64 * PARITY), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def class_column(text: Column) -> Column:
    @F.arrow_udf(T.BinaryType())
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([class_of(shingle_set(t)) for t in common.values(texts)], pa.binary())

    return run(text)


def counters(df: DataFrame, text: str) -> np.ndarray:
    """How often shingles fall on each counter, over all texts, as a byte on a logarithmic scale.

    Any order of shingles is right as long as it is one; so a task's counters may stop at 255.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, dtype=np.uint32)
        for b in batches:
            for part in common.slices(b):
                found = np.concatenate([shingle_set(t) for t in part.column(0).to_pylist()])
                at, n = np.unique(found & (COUNTERS - 1), return_counts=True)
                total[at] += n.astype(np.uint32)
        if total.any():
            small = np.minimum(total, 255).astype(np.uint8).reshape(-1, BLOCK)
            yield pa.RecordBatch.from_pydict({"block": pa.array(range(len(small)), pa.int32()), "n": pa.array([x.tobytes() for x in small], pa.binary())})

    def add(g: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, dtype=np.uint8).astype(np.int64) for x in g["n"].to_pylist())
        scaled = np.minimum(255, np.round(10 * np.log2(1.0 + total))).astype(np.uint8)
        return pa.table({"block": g["block"][:1], "n": pa.array([scaled.tobytes()], pa.binary())})

    rows = df.select(text).mapInArrow(count, "block int, n binary").groupBy("block").applyInArrow(add, "block int, n binary").collect()
    out = np.zeros((COUNTERS // BLOCK, BLOCK), dtype=np.uint8)
    for r in rows:
        out[r.block] = np.frombuffer(r.n, dtype=np.uint8)
    return out.reshape(-1)


def marked(df: DataFrame, text: str, key: str) -> DataFrame:
    """(key, fp, size, prefix, bits, own, sim): class of each row, number of its shingles, the first of them, map of parities, digest of the text, SimHash."""
    from .simhash import of_hashes

    common.small_batches(df.sparkSession)
    order = df.sparkSession.sparkContext.broadcast(counters(df, text))

    kind = pa.struct([("fp", pa.binary()), ("size", pa.int32()), ("prefix", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64())), ("own", pa.binary()), ("sim", pa.int64())])

    @F.arrow_udf("fp binary, size int, prefix array<long>, bits array<long>, own binary, sim long")
    def run(texts: pa.Array) -> pa.Array:
        def made(part: list) -> pa.Array:
            found = [shingle_set(t) for t in part]
            first = [s[np.lexsort((s, order.value[s & (COUNTERS - 1)]))][: len(s) - (4 * len(s) + 4) // 5 + 1] for s in found]
            columns = [pa.array([class_of(s) for s in found], pa.binary()), pa.array([len(s) for s in found], pa.int32()), common.lists(first, pa.int64())]
            columns += [common.lists([parities(s) for s in found], pa.int64()), pa.array([digest(t) for t in part], pa.binary()), pa.array([of_hashes(s) for s in found], pa.int64())]
            return pa.StructArray.from_arrays(columns, fields=list(kind))

        return common.mapped(texts, made, kind)

    return df.select(key, run(F.col(text)).alias("m")).select(key, "m.*")


def _place(value: Column) -> Column:
    """The place of a value in a map."""
    return F.shiftrightunsigned(F.xxhash64(value), 64 - MAP_BITS)


def _map(values: DataFrame) -> np.ndarray:
    """A map of bounded size of the values of a table's only column; nulls have none."""
    value = F.col(values.columns[0])
    words = values.where(value.isNotNull()).select(_place(value).alias("at")).groupBy(F.shiftright("at", 6).alias("word"))
    out = np.zeros(1 << (MAP_BITS - 6), dtype=np.int64)
    for r in words.agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).collect():
        out[r.word] = r.bits
    return out.view(np.uint64)


def may_be_among(value: Column, values: DataFrame) -> Column:
    """Whether a value (not null) may be among those of a table's only column; what is there always may."""
    shared = values.sparkSession.sparkContext.broadcast(_map(values))

    @F.arrow_udf(T.BooleanType())
    def run(places: pa.Array) -> pa.Array:
        at = places.to_numpy(zero_copy_only=False)
        return pa.array((shared.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool))

    return run(_place(value))


def texts_of(df: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """(own, packed) of the texts whose digests are wanted, compressed.

    A map of bounded size tells most texts that aren't wanted before they are passed on.
    """
    shared = df.sparkSession.sparkContext.broadcast(_map(wanted))

    kind = pa.struct([("own", pa.binary()), ("packed", pa.binary())])

    @F.arrow_udf("own binary, packed binary")
    def run(texts: pa.Array) -> pa.Array:
        def made(part: list) -> pa.Array:
            owns, packed = [], []
            for t in part:
                own = digest(t)
                at = xxhash.xxh64_intdigest(own, 42) >> (64 - MAP_BITS)
                may = int(shared.value[at >> 6]) >> (at & 63) & 1
                owns.append(own if may else None)
                packed.append(zstandard.compress((t or "").encode()) if may else None)
            return pa.StructArray.from_arrays([pa.array(owns, pa.binary()), pa.array(packed, pa.binary())], fields=list(kind))

        return common.mapped(texts, made, kind)

    some = df.select(run.asNondeterministic()(F.col(text)).alias("m")).where("m.own is not null").select("m.*")
    return some.join(wanted, "own", "left_semi").groupBy("own").agg(F.first("packed").alias("packed"))


@F.arrow_udf(T.BooleanType())
def _alike(xs: pa.Array, ys: pa.Array) -> pa.Array:
    """Whether 9 x common >= 4 x both sizes, which is a similarity of 0.8, for pairs of compressed texts."""
    unpacked = lambda z: shingle_set(zstandard.decompress(z).decode())
    out, last = [], None
    for x, y in zip(common.values(xs), common.values(ys)):
        if x != last:
            last, one = x, unpacked(x)
        two = unpacked(y)
        both = len(np.intersect1d(one, two, assume_unique=True))
        out.append(9 * both >= 4 * (len(one) + len(two)))
    return pa.array(out, pa.bool_())


def similar(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that are similar enough, by the texts own_a and own_b."""
    x, y = (found.select(F.col("own").alias(f"own_{s}"), F.col("packed").alias(f"packed_{s}")) for s in "ab")
    return pairs.join(x, "own_a").join(y, "own_b").where(_alike("packed_a", "packed_b")).select("a", "b")


def maybe_similar(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b, own_a, own_b) of the pairs of ids (a, b) that the maps of parities allow to be similar: 1/9 of both sizes may differ."""
    a, b = (classes.select(F.col("id").alias(s), F.col("fp").alias(f"fp_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("size", "bits", "own")]) for s in "ab")
    differ = sum(F.bit_count(F.col("bits_a")[i].bitwiseXOR(F.col("bits_b")[i])) for i in range(PARITY))
    near = pairs.join(a, "a").join(b, "b").where("fp_a <> fp_b").where(9 * differ <= F.col("size_a") + F.col("size_b"))
    return near.select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"), "own_a", "own_b")


def connected(texts: list[bytes]) -> np.ndarray:
    """For each of some compressed texts the number of the first text that similar ones connect it to."""
    sets = [shingle_set(zstandard.decompress(t).decode()) for t in texts]
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], (np.cumsum(times > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(sets), len(sets)), dtype=np.int32)
    for first in range(0, int((times > 1).sum()), COLUMNS):
        a, b = np.searchsorted(column, [first, first + COLUMNS])
        table = np.zeros((len(sets), COLUMNS), dtype=bool)
        table[owner[a:b], column[a:b] - first] = True
        bits = np.packbits(table, axis=1)
        for i, row in enumerate(bits):
            both[i] += np.bitwise_count(bits & row).sum(axis=1, dtype=np.int32)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    alike = 9 * both.astype(np.int64) >= 4 * (sizes[:, None] + sizes[None])
    np.fill_diagonal(alike, True)
    label = np.arange(len(sets))
    while True:
        new = np.where(alike, label, len(sets)).min(axis=1)
        if (new == label).all():
            return label
        label = new


def _in_blocks(cells: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """(a, b) that connect what is similar in cells of many classes (at, id, label, n); each pair of a cell's blocks is one group.

    A class stands for all that it is already connected to, so a group gives fewer links than it has labels.
    """

    def links_of(g: pa.Table) -> pa.Table:
        names = g["label"].to_pylist()
        label = connected(g["packed"].to_pylist()) if len(set(names)) > 1 else np.arange(len(names))
        moved = np.flatnonzero(label != np.arange(len(names)))
        made = sorted({(names[label[i]], names[i]) for i in moved if names[label[i]] != names[i]})
        return pa.table({"a": pa.array([a for a, _ in made], pa.binary()), "b": pa.array([b for _, b in made], pa.binary())})

    rows = cells.join(classes.select("id", "fp", "own"), "id").join(found, "own")
    rows = rows.withColumn("label", F.when(F.octet_length("label") > 8, F.col("label")).otherwise(F.col("fp")))  # not connected yet: its id
    blocks = F.ceil(F.col("n") / HOT_BLOCK)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("fp"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    rows = rows.select("at", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "fp", "label", "packed")
    return rows.groupBy("at", "low", "high").applyInArrow(links_of, "a binary, b binary")


def verified(pairs: DataFrame, df: DataFrame, text: str, classes: DataFrame, hot: DataFrame | None = None) -> common.Written:
    """Links (a, b): the pairs (a, b) of ids that are similar enough, and what connects the similar ones in hot cells."""
    some = common.Written(maybe_similar(pairs.distinct(), classes))
    owns = some.df.select("own_a").union(some.df.select("own_b"))
    if hot is not None:
        owns = owns.union(classes.join(hot.select("id").distinct(), "id", "left_semi").select("own"))
    wanted = common.Written(owns.distinct().toDF("own"))
    found = common.Written(texts_of(df, text, wanted.df))
    made = similar(some.df, found.df)
    out = common.Written(made if hot is None else made.unionByName(_in_blocks(hot, classes, found.df).distinct()))
    for table in (some, wanted, found):
        table.drop()
    return out


def near_by_bits(classes: DataFrame) -> DataFrame:
    """(a, b): ids of classes with one SimHash, or with SimHashes within reach, the one of smallest id for each SimHash."""
    from .simhash import links as within_reach

    prints = common.Written(classes.groupBy("sim").agg(F.min("id").alias("first"), F.count("*").alias("n")))
    reached = within_reach(prints.df.select(F.col("sim").alias("fp")))
    a, b = (prints.df.select(F.col("sim").alias(f"sim_{s}"), F.col("first").alias(s)) for s in "ab")
    across = reached.toDF("sim_a", "sim_b").join(a, "sim_a").join(b, "sim_b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    within = classes.select("sim", "id").join(prints.df.where("n > 1").select("sim", "first"), "sim").where("id <> first")
    return across.unionByName(within.select(F.col("first").alias("a"), F.col("id").alias("b")))


def links(df: DataFrame, text: str, marks: DataFrame) -> DataFrame:
    """(a, b) over the classes: enough similar pairs to connect whatever is linked."""
    some = marks.where("size > 0")
    found = some.groupBy("fp").agg(*[F.first(c).alias(c) for c in ("size", "bits", "own", "sim")], F.count("*").alias("n"))
    classes = common.Written(found.withColumn("id", F.xxhash64("fp")))
    # a row that is alone in its class stays where it is
    thin = some.select("fp", "size", "prefix")
    again = may_be_among(F.col("fp"), classes.df.where("n > 1").select("fp"))
    firsts = thin.where(~again).unionByName(thin.where(again).groupBy("fp").agg(F.first("size").alias("size"), F.first("prefix").alias("prefix")))
    # dealt by shingle once, for the heads and for what meets them
    dealt = firsts.select(F.xxhash64("fp").alias("id"), "size", F.posexplode("prefix").alias("place", "at"))
    # a class at a shingle: its size, and how many of its shingles come at this place or later
    dealt = dealt.select("at", "id", F.expr("shiftleft(cast(size as bigint), 32) + size - place").alias("has")).repartition("at")
    heads = dealt.groupBy("at").agg(F.min(F.struct("id", "has")).alias("head"), F.count("*").alias("n")).where("n > 1")
    cells = common.Written(dealt.join(heads.hint("merge"), "at").select("at", "id", "has", "head", "n"))
    near = lambda x, y: _may_meet(F.col(x), F.col(y))
    pairs = cells.df.where("id <> head.id").where(near("has", "head.has")).select(F.col("head.id").alias("a"), F.col("id").alias("b"))
    same = classes.df.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("a"), F.col("id").alias("b"))
    stars = verified(pairs.unionByName(near_by_bits(classes.df)).unionByName(same), df, text, classes.df)
    joined = components(stars.df, "a", "b")
    label = joined.select(F.xxhash64("node").alias("id"), "label")
    # a cell of two is compared; one whose members are all connected needs no more comparing
    parts = cells.df.where("n > 2").join(label, "id", "left").select("at", "id", "has", F.coalesce("label", F.unhex(F.hex("id"))).alias("label"))
    mixed = parts.groupBy("at").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).where("low <> high").select("at", "n")
    mixed = common.Written(parts.join(mixed, "at"))
    few, hot = mixed.df.where(F.col("n") <= HOT_CELL), mixed.df.where(F.col("n") > HOT_CELL)
    one, two = (few.select("at", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "has", "label")]) for s in "ab")
    rest = one.join(two, "at").where("id_a < id_b and label_a <> label_b").where(near("has_a", "has_b"))
    rest = verified(rest.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")), df, text, classes.df, None if hot.isEmpty() else hot)
    # what the first step has connected is one node for the second, so there are about as many links as classes
    between = rest.df
    for end in ("a", "b"):
        between = between.join(joined.select(F.col("node").alias(end), F.col("label").alias(f"label_{end}")), end, "left").withColumn(end, F.coalesce(f"label_{end}", end))
    out = common.Written(between.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    for table in (cells, classes, mixed, stars, rest):
        table.drop()
    return joined.where("node <> label").select(F.col("label").alias("a"), F.col("node").alias("b")).unionByName(out.df)


def _may_meet(x: Column, y: Column) -> Column:
    """Whether two classes can be similar if this shingle is the first that both have.

    They are then alike in as many shingles as the one with fewer from here on has at most, and have to be in 4/9 of both sizes.
    """
    both = F.shiftright(x, 32) + F.shiftright(y, 32)
    left = F.least(x.bitwiseAND(F.lit(0xFFFFFFFF)), y.bitwiseAND(F.lit(0xFFFFFFFF)))
    return 9 * left >= 4 * both
