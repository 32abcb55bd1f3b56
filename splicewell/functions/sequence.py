"""Scalar functions on sequences, k-mers, flags and anchors, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"


def reverse_complement(seq: Column) -> Column:
    """Anything but upper-case ACGT becomes N."""
    return F.reverse(F.translate(F.regexp_replace(seq, "[^ACGT]", "N"), "ACGT", "TGCA"))


def original_sequence(seq: Column, flag: Column) -> Column:
    return F.when(has_flag(flag, 16), reverse_complement(seq)).otherwise(seq)


def original_qualities(quals: Column, flag: Column) -> Column:
    """Phred+33 text in the read's own direction."""
    text = F.array_join(F.transform(quals, lambda q: F.char(q.cast("long") + 33)), "")
    return F.when(has_flag(flag, 16), F.reverse(text)).otherwise(text)


def once(value: Column, made) -> Column:
    """made(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def average_quality(quals: Column) -> Column:
    """Integer mean; 0 for none."""

    def mean(q: Column) -> Column:
        total = F.aggregate(q, F.lit(0).cast("long"), lambda a, x: a + x)
        return F.when(F.size(q) > 0, F.floor(total / F.size(q))).otherwise(0).cast("int")

    return once(quals, mean)


#: Symbols of a tile. Finding a place in a string takes time in proportion to it, so long sequences are cut into tiles first.
TILE = 200


def kmers(seq: Column, k: int) -> Column:
    """All k-mers in order; position i is at index i (from 0)."""
    tiles = F.transform(F.sequence(F.lit(0), F.floor((F.length(seq) - k) / TILE).cast("int")), lambda t: F.substring(seq, t * TILE + 1, F.lit(TILE + k - 1)))
    found = F.transform(tiles, lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - (k - 1)), lambda i: F.substring(t, i, F.lit(k))))
    return F.when(F.length(seq) >= k, F.flatten(found)).otherwise(F.array().cast("array<string>"))


def spaced_seed(kmer: Column, j: int) -> Column:
    """An 18-mer without its j-th segment of three, counted from the end."""
    head = F.substring(kmer, 1, 15 - 3 * j)
    return F.concat(head, F.substring(kmer, 19 - 3 * j, 3 * j)) if j else head


def spaced_seeds(kmer: Column, segments: int = 6) -> Column:
    """Structs (j, seed) of a k-mer."""
    return F.array(*[F.struct(F.lit(j).alias("j"), spaced_seed(kmer, j).alias("seed")) for j in range(segments)])


def base_count(seq: Column, base: str) -> Column:
    return F.length(seq) - F.length(F.replace(seq, F.lit(base)))


def most_frequent_base(seq: Column) -> Column:
    return F.greatest(*[base_count(seq, b) for b in BASES])


def valid_kmer(kmer: Column) -> Column:
    """False where all bases but at most two are one base."""
    return most_frequent_base(kmer) < F.length(kmer) - 2


def is_poly(seq: Column, share: float = 0.8) -> Column:
    return most_frequent_base(seq) >= share * F.length(seq)


def pair_counts(seq: Column) -> Column:
    """How often each of the 16 pairs of neighbouring bases occurs; other symbols make no pair."""
    same = lambda s, a: F.regexp_count(s, F.lit(f"{a}(?={a})"))
    other = lambda s, x: ((F.length(s) - F.length(F.replace(s, F.lit(x)))) / 2).cast("int")
    counts = lambda s: F.array(*[same(s, a) if a == b else other(s, a + b) for a in BASES for b in BASES])
    return F.flatten(F.transform(F.array(seq), counts))  # so that the sequence is worked out once


def low_complexity(seq: Column, share: float = 0.75) -> Column:
    """Whether the two most frequent pairs of neighbouring bases make up so much of the length, which counts one too many."""
    return is_low(top_pairs(seq), F.length(seq), share)


def is_low(top: Column, length: Column, share: float = 0.75) -> Column:
    return top >= share * (length + 1)


def top_pairs(seq: Column) -> Column:
    """How often the two most frequent pairs of neighbouring bases occur."""
    return once(F.sort_array(pair_counts(seq), False), lambda n: n[0] + n[1])


def turned(seq: Column, quals: Column, flag: Column, compat: bool = True) -> Column:
    """A read the other way round: sequence and the flag's strand; in compat mode qualities stay as in the file, as clip_quality() takes them, else they turn as well."""
    return F.struct(reverse_complement(seq).alias("seq"), (quals if compat else F.reverse(quals)).alias("quals"), flag.bitwiseXOR(F.lit(16)).alias("flag"))


def forward(seq: Column, quals: Column, flag: Column, compat: bool = True) -> Column:
    """A read on the forward strand."""
    as_it_is = F.struct(seq.alias("seq"), quals.alias("quals"), flag.alias("flag"))
    return F.when(has_flag(flag, 16), turned(seq, quals, flag, compat)).otherwise(as_it_is)


def clip_quality(quals: Column, flag: Column, rc: Column, clip: Column, side: str) -> Column:
    """Average quality of a realigned read's clip; the qualities lie as in the file, turned round where strand and orientation differ."""
    at_end = (side == "R") != (has_flag(flag, 16) != rc)
    part = lambda q: F.slice(q, F.when(at_end, F.size(q) - clip + 1).otherwise(1), clip)
    return F.when(clip > 0, once(quals, lambda q: average_quality(part(q)))).otherwise(0)


def on_circle(pos: Column, effective: Column) -> Column:
    """A place on a circular sequence that was written with its first half again, counted on the circle."""
    return F.pmod(pos, original_length(effective))


def two_bit(seq: Column, k: int) -> Column:
    """ACGT as 0..3, other symbols as 0, packed."""
    packed = F.lit(0).cast("long")
    for i in range(1, k + 1):
        symbol = F.substring(seq, i, 1)
        packed = packed * 4 + F.when(symbol == "C", 1).when(symbol == "G", 2).when(symbol == "T", 3).otherwise(0)
    return packed


def has_flag(flag: Column, bits: int) -> Column:
    return flag.bitwiseAND(bits) == bits


def primary(flag: Column) -> Column:
    return flag.bitwiseAND(0x900) == 0


def discordant(flag: Column, contig: Column, mate_contig: Column, isize: Column) -> Column:
    """Both mapped, and on different contigs or far apart."""
    return (flag.bitwiseAND(12) == 0) & ((contig != mate_contig) | (F.abs(isize) > 100_000))


def anchor_merge(a: Column, b: Column) -> Column:
    return F.struct(F.least(a["start"], b["start"]).alias("start"), F.greatest(a["end"], b["end"]).alias("end"))


def anchor_distance(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Negative percentage of the shorter anchor where they overlap, else the gap between the nearest ends."""
    overlap = F.least(a_end, b_end) - F.greatest(a_start, b_start)
    shorter = F.least(a_end - a_start + 1, b_end - b_start + 1)
    gaps = F.least(F.abs(a_start - b_end), F.abs(b_start - a_end), F.abs(a_start - b_start), F.abs(a_end - b_end))
    return F.when(overlap > 0, -F.floor(100 * overlap / shorter)).otherwise(gaps).cast("long")


def pair_distance(a: Column, b: Column, low: int = -50, high: int = 1000) -> Column:
    """Distance of two calls that may be the two ends of one insertion; null if they can't be."""
    facing = (a["host_chr"] == b["host_chr"]) & (a["host_rev"] != b["host_rev"]) & (a["virus_rev"] != b["virus_rev"])
    gap = F.when(a["host_rev"], a["host_pos"] - b["host_pos"]).otherwise(b["host_pos"] - a["host_pos"])
    return F.when(facing & gap.between(low, high), gap)


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Inclusive length, 0 if apart."""
    return F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start) + 1)


def region_snap(start: Column, end: Column, length: Column, step: int = 500) -> tuple[Column, Column]:
    low = F.floor(start / step) * step
    return low, F.least(F.floor(end / step) * step + step, length)


def circular(seq: Column) -> Column:
    """A circular sequence with its first half again."""
    return F.concat(seq, F.substring(seq, F.lit(1), F.floor(F.length(seq) / 2).cast("int")))


def original_length(effective: Column) -> Column:
    return effective - F.floor(effective / 3)


def breakpoint_text(chrom: Column, rev: Column, start: Column, end: Column) -> Column:
    return F.concat_ws(":", chrom, F.when(rev, "-").otherwise("+"), start.cast("string"), end.cast("string"))


def breakpoint_parse(text: Column) -> Column:
    part = F.split(text, ":")
    return F.struct(part[0].alias("chr"), (part[1] == "-").alias("rev"), part[2].cast("int").alias("start"), part[3].cast("int").alias("end"))


def breakpoint_human(chrom: Column, rev: Column, start: Column, end: Column) -> Column:
    return F.concat(chrom, F.lit(":"), F.when(rev, F.concat(F.lit("-"), start.cast("string"))).otherwise(F.concat(F.lit("+"), end.cast("string"))))
