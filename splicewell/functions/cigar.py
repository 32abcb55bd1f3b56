"""CIGAR text and arrays of (len, op), as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERY_OPS, REFERENCE_OPS = "MIS=X", "MDN=X"


def parse(text: Column) -> Column:
    """Array of structs (len, op)."""
    found = F.regexp_extract_all(text, F.lit("[0-9]+[MIDNSHP=X]"), 0)
    return F.transform(found, lambda x: F.struct(F.regexp_extract(x, "[0-9]+", 0).cast("int").alias("len"), F.right(x, F.lit(1)).alias("op")))


def text(ops: Column) -> Column:
    return F.array_join(F.transform(ops, lambda x: F.concat(x["len"].cast("string"), x["op"])), "")


def _span(ops: Column, kinds: str) -> Column:
    return F.aggregate(F.filter(ops, lambda x: F.instr(F.lit(kinds), x["op"]) > 0), F.lit(0), lambda a, x: a + x["len"])


def query_length(ops: Column) -> Column:
    return _span(ops, QUERY_OPS)


def reference_length(ops: Column) -> Column:
    return _span(ops, REFERENCE_OPS)


def end_position(pos: Column, ops: Column) -> Column:
    return pos + reference_length(ops)


def clip(ops: Column, side: str, hard: bool = False) -> Column:
    """Clipped length at the left or right end."""
    end = F.try_element_at(ops, F.lit(1 if side == "L" else -1))
    return F.when(end["op"].isin("S", "H") if hard else end["op"] == "S", end["len"]).otherwise(0)


def normalise(ops: Column) -> Column:
    """= and X become M, and equal neighbours one."""
    plain = F.transform(ops, lambda x: F.struct(x["len"].alias("len"), F.when(x["op"].isin("=", "X"), "M").otherwise(x["op"]).alias("op")))
    empty = F.array().cast("array<struct<len:int,op:string>>")

    def add(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct((last["len"] + x["len"]).alias("len"), x["op"].alias("op"))))
        return F.when((F.size(acc) > 0) & (last["op"] == x["op"]), joined).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(plain, empty, add)


def alternatives(xa: Column) -> Column:
    """Structs (contig, strand, pos, cigar) of an XA text: contig,±pos,cigar,nm;..."""
    entries = F.filter(F.split(xa, ";"), lambda x: x != "")

    def one(x: Column) -> Column:
        part = F.split(x, ",")
        return F.struct(part[0].alias("contig"), F.substring(part[1], 1, 1).alias("strand"), F.abs(part[1].cast("int")).alias("pos"), part[2].alias("cigar"))

    return F.transform(entries, one)
