"""SimHash near-duplicates, found through pivot distance tables.

Fingerprints are 64-bit SimHashes of three-word shingles. For candidate search,
the Hamming distances of every distinct fingerprint to many reference
fingerprints (pivots) are tabled. Two fingerprints with at most two differing
bits agree on at least two of four 16-bit blocks, and so in all their distances
to pivots that are measured on these two blocks; those distances, packed, are
the join key of each of the six pairs of blocks. Joined pairs are discarded
where any distance to the full-width pivots differs by more than the threshold
(triangle inequality), and the survivors are verified bit by bit.

A key with very many fingerprints is not joined with itself: there, two
fingerprints are within two bits exactly if the balls of radius one around them
meet, so each sends its ball's points and all that meet in a point are linked to
the smallest of them. That is exact, and linear in the rows.

Defined results: null and empty texts have fingerprint zero and are linked like
others; component_id is the smallest doc_id reachable, null only where all of
them are null; repeated rows appear each; extra columns stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from . import common, nearcopies
from .components import components

SEED = 42
SHINGLE = 3
#: Most differing bits of a link. The search is laid out for this value: two of four blocks agree.
MAX_BITS = 2
BLOCKS = [0xFFFF << (16 * i) for i in range(4)]
PAIRS = [(i, j) for i in range(4) for j in range(i)]
#: Pivots for each pair of blocks (six bits each in the key), and of full width for the discarding.
KEY_PIVOTS = 10
FULL_PIVOTS = 24
#: A key with more fingerprints than this is linked through balls.
HOT_KEY = 48


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivots(n: int, salt: int) -> list[int]:
    """Reference fingerprints: fixed pseudo-random words."""
    return [xxhash.xxh64_intdigest(f"{salt}:{i}", SEED) for i in range(n)]


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> list[int]:
    """XXH64 of every shingle of a text, repeats included; ASCII capitals lowered, words split at ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return []
    h, joined = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= shingle:
        return [h(joined, SEED)]
    starts = np.cumsum([0, *map(len, words)]) + np.arange(len(words) + 1)
    ends = (starts[shingle:] - 1).tolist()
    return [h(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends, strict=False)]


def simhash(text: str | None) -> int:
    return of_hashes(np.array(shingle_hashes(text), dtype="<u8")) & ((1 << 64) - 1)


def of_hashes(whole: np.ndarray) -> int:
    """The (signed) fingerprint of 64-bit hashes, zero if there are none."""
    if not len(whole):
        return 0
    total = np.zeros(64, dtype=np.int64)
    for a in range(0, len(whole), 8192):
        bits = np.unpackbits(whole[a : a + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    set_bits = np.packbits(2 * total > len(whole), bitorder="little")
    return int(set_bits.view("<i8")[0])


def fingerprints(df: DataFrame, text: str = "text", into: str = "fp") -> DataFrame:
    """Adds the fingerprint as a (signed) long, under the name common.free() gives."""

    common.small_batches(df.sparkSession)
    @F.arrow_udf(T.LongType())
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([_signed(simhash(t)) for t in common.values(texts)], pa.int64())

    return df.withColumn(common.free(df, into), run(F.col(text)))


def _distance(a: Column, pivot: int, mask: int) -> Column:
    return F.bit_count((a.bitwiseXOR(F.lit(_signed(pivot)))).bitwiseAND(F.lit(_signed(mask))))


def block_key(fp: Column, pair: int) -> Column:
    """Distances to the pivots of a pair of blocks, packed."""
    i, j = PAIRS[pair]
    mask = BLOCKS[i] | BLOCKS[j]
    packed = F.lit(0).cast("long")
    for p in pivots(KEY_PIVOTS, pair):
        packed = packed * 64 + _distance(fp, p, mask)
    return packed


def coordinates(fp: Column) -> Column:
    """The row of the pivot table of a fingerprint: distances to the full-width pivots."""
    return F.array(*[_distance(fp, p, (1 << 64) - 1).cast("byte") for p in pivots(FULL_PIVOTS, 99)])


def near(a: str, b: str) -> Column:
    """Whether no coordinate of two rows of the pivot table differs by more than MAX_BITS."""
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("int") - y.cast("int")))) <= MAX_BITS


def ball(fp: Column) -> Column:
    """The fingerprint and those that differ in one bit."""
    return F.array(fp, *[fp.bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)])


def links(fps: DataFrame) -> DataFrame:
    """(a, b) over a table of distinct fingerprints (column fp): enough links within MAX_BITS to connect whatever is linked.

    Pairs of ordinary keys are complete; in hot keys all within reach of a meeting point are linked to its smallest.
    """
    cells = (
        fps.select("fp", F.posexplode(F.array(*[block_key(F.col("fp"), k) for k in range(len(PAIRS))])).alias("pair", "key"))
        .withColumn("n", F.count("*").over(W.Window.partitionBy("pair", "key")))
        .where("n > 1")
    )
    cells = common.Written(cells)
    some = cells.df.where(F.col("n") <= HOT_KEY).withColumn("at", coordinates(F.col("fp")))
    a, b = some.select("pair", "key", F.col("fp").alias("a"), F.col("at").alias("at_a")), some.select("pair", "key", F.col("fp").alias("b"), F.col("at").alias("at_b"))
    pairs = (
        a.join(b, ["pair", "key"])
        .where("a < b")
        .where(near("at_a", "at_b"))
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)
        .select("a", "b")
    )
    hot = cells.df.where(F.col("n") > HOT_KEY).select("fp").distinct()
    met = hot.select("fp", F.explode(ball(F.col("fp"))).alias("point")).groupBy("point").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all"))
    stars = met.where(F.size("all") > 1).select("a", F.explode("all").alias("b")).where("a <> b")  # at most 65 in a point
    return pairs.union(stars).distinct()


def groups(marked: DataFrame, key: str = "doc_id", linked: DataFrame | None = None) -> DataFrame:
    """(fp, component_id) for every fingerprint of a written table with columns fp and the document's key.

    Links (a, b) are those within MAX_BITS unless given.
    """
    classes = common.Written(marked.groupBy("fp").agg(F.min(key).alias("least")))
    linked = components(links(classes.df.select("fp")) if linked is None else linked, "a", "b")
    labelled = classes.df.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    best = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    return labelled.select("fp", "label").join(best, "label").select("fp", "label", "component_id")


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", bits: bool = False) -> DataFrame:
    """(key, fp, component_id) for each row, by five-word shingles and similarity 0.8, or by the bits of SimHash."""
    if bits:
        marked = common.Written(fingerprints(df.select(key, text), text).select(key, "fp")).df
        return marked.join(groups(marked, key).drop("label"), "fp")
    marked = common.Written(nearcopies.marked(df, text, key)).df
    return marked.select(key, "fp").join(groups(marked, key, nearcopies.links(df, text, marked)).drop("label"), "fp")


def keep_one(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each group by five-word shingles: a row with the group's smallest key; where all keys of a group are null, any one of its rows."""
    marked = common.Written(nearcopies.marked(df, text, key)).df
    found = common.Written(groups(marked, key, nearcopies.links(df, text, marked))).df
    own, of, group, n = (common.free(df, x) for x in ("__key", "__of", "__group", "__n"))
    ids = marked.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(own)).agg(F.count("*").alias(n))
    stay = common.Written(ids.join(found.select(F.col("component_id").alias(own)).distinct(), own, "left_semi")).df
    # only rows whose key is repeated or goes have to meet; the rest is taken where it lies
    other = common.Written(ids.join(stay.where(F.col(n) == 1), own, "left_anti").select(own)).df
    named = df.where(df[key].isNotNull())
    meets = nearcopies.may_be_among(df[key], other)
    first = F.row_number().over(W.Window.partitionBy(own).orderBy(F.xxhash64(text)))
    met = named.where(meets).join(stay.drop(n), df[key] == F.col(own)).withColumn(n, first).where(F.col(n) == 1)
    known = named.where(~meets).unionByName(met.select(df.columns))
    lone = found.where(F.col("component_id").isNull()).select(F.col("fp").alias(of), F.col("label").alias(group))
    print_ = common.free(df, "__fp")
    nameless = df.where(df[key].isNull()).withColumn(print_, nearcopies.class_column(F.col(text))).join(lone, F.col(print_) == F.col(of))
    first = F.row_number().over(W.Window.partitionBy(group).orderBy(print_, F.xxhash64(text)))
    nameless = nameless.withColumn(n, first).where(F.col(n) == 1)
    return known.unionByName(nameless.select(df.columns))


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(common.table(spark, sf_dir, "documents"), bits=True)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
