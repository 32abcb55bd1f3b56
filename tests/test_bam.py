"""BAM files made by hand, block by block, read as their SAM text is."""

import random
import struct
import zlib

import pytest
from splicewell.sources import bam, files

OPS, BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"


def block(data):
    packed = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packed.compress(data) + packed.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def packed(read, names):
    qname, flag, contig, pos, cigar, mate, mate_pos, isize, seq, qual, tags = read
    number = lambda c: names.index(c) if c in names else -1
    nibbles = [BASES.index(c) for c in seq] + [0] * (len(seq) % 2)
    body = struct.pack("<iiBBHHHiiii", number(contig), pos, len(qname) + 1, 9, 0, len(cigar), flag, len(seq), number(mate), mate_pos, isize) + qname.encode() + b"\0"
    body += b"".join(struct.pack("<I", n << 4 | OPS.index(op)) for n, op in cigar) + bytes(a << 4 | b for a, b in zip(nibbles[::2], nibbles[1::2], strict=True)) + bytes(qual) + tags
    return struct.pack("<i", len(body)) + body


def write(folder, names, reads, size):
    """x.bam in blocks of so many bytes, so records go over block ends; its index; and x.sam."""
    head = b"BAM\1" + struct.pack("<i", 4) + b"@HD\n" + struct.pack("<i", len(names)) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", 9000) for n in names)
    data, starts = head, []
    for r in reads:
        starts.append(len(data))
        data += packed(r, names)
    starts.append(len(data))
    out, places = b"", []
    for at in range(0, len(data), size):
        places.append(len(out))
        out += block(data[at : at + size])
    places.append(len(out))
    (folder / "x.bam").write_bytes(out + block(b""))
    virtual = lambda at: places[at // size] << 16 | at % size
    index = b"BAI\1" + struct.pack("<i", len(names))
    for name in names:
        own = [i for i, r in enumerate(reads) if r[2] == name]
        bins = [own[i : i + 7] for i in range(0, len(own), 7)]
        index += struct.pack("<i", len(bins) + bool(bins))
        for n, b in enumerate(bins):
            index += struct.pack("<IiQQ", 4681 + n, 1, virtual(starts[b[0]]), virtual(starts[b[-1] + 1]))
        index += struct.pack("<IiQQQQ", 37450, 2, 1, 2, 3, 4) * bool(bins) + struct.pack("<iQ", 1, 0)
    (folder / "x.bam.bai").write_bytes(index)
    lines = ["@HD\tVN:1"]
    for q, flag, c, pos, cigar, m, mp, isize, seq, qual, _ in reads:
        lines.append("\t".join([q, str(flag), c, str(pos + 1), "9", "".join(f"{n}{o}" for n, o in cigar) or "*", "=" if m == c and c != "*" else m, str(mp + 1), str(isize), seq, "".join(chr(x + 33) for x in qual), "XA:Z:d,-5,7M,0;", "NM:i:-3", "XF:f:1.5", "XB:B:s,1,-2", "XC:A:q"]))
    (folder / "x.sam").write_text("\n".join(lines) + "\n")


@pytest.fixture(scope="module")
def made(tmp_path_factory):
    folder, rng = tmp_path_factory.mktemp("bam"), random.Random(1)
    tags = b"XAZd,-5,7M,0;\0" + b"NMi" + struct.pack("<i", -3) + b"XFf" + struct.pack("<f", 1.5) + b"XBBs" + struct.pack("<ihh", 2, 1, -2) + b"XCAq"
    names, reads = ["chr1", "chr2", "empty", "virus"], []
    for contig, n in (("chr1", 60), ("chr2", 25), ("virus", 31), ("*", 4)):
        for pos in sorted(rng.randint(0, 5000) for _ in range(n)):
            size = rng.randint(1, 90)
            reads.append((f"q{len(reads)}", rng.choice([0, 16, 1024, 99]), contig, pos if contig != "*" else -1, [(3, "S"), (size, "M")] if contig != "*" else [(1, "M")], rng.choice([contig, "chr2", "*"]), rng.randint(0, 99), rng.randint(-500, 500), "".join(rng.choice("ACGTN") for _ in range(size)), [rng.randint(0, 40) for _ in range(size)], tags))
    write(folder, names, reads, 700)
    return folder


def rows(df):
    return sorted((r.qname, r.flag, r.contig, r.pos, [tuple(c) for c in r.cigar], r.mate_contig, r.mate_pos, r.isize, r.seq, r.qual, sorted(r.tags.items())) for r in df.collect())


def test_equals_sam_text(spark, made):
    sam = rows(files.sam(spark, str(made / "x.sam")))
    indexed = bam.bam(spark, str(made / "x.bam"))
    assert rows(indexed) == [r for r in sam if r[2] != "*"] and len(sam) == 120
    assert rows(bam.bam(spark, str(made / "x.bam"), ["virus"], duplicates=False)) == [r for r in sam if r[2] == "virus" and not r[1] & 1024]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    indexed = bam.bam(spark, str(made / "x.bam"))
    assert rows(indexed.where("contig = 'chr2'")) == [r for r in sam if r[2] == "chr2"]
    assert rows(indexed.where("contig IN ('chr1', 'empty') AND flag = 16")) == [r for r in sam if r[2] == "chr1" and r[1] == 16]
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    (made / "y.bam").write_bytes((made / "x.bam").read_bytes())
    assert rows(bam.bam(spark, str(made / "y.bam"))) == sam  # no index: all reads


def test_partitions_come_from_the_index(made, monkeypatch):
    monkeypatch.setattr(bam, "PART", 500)
    reader = bam.PushingReader(str(made / "x.bam"), None, True)
    whole = reader.partitions()
    assert list(reader.pushFilters([bam.EqualTo(("contig",), "chr2"), bam.EqualTo(("flag",), 4)])) == [bam.EqualTo(("flag",), 4)]
    some = reader.partitions()
    assert len(whole) > 6 and {p.value[2] for p in some} == {"chr2"} and len(some) < len(whole) / 2
    got = [r["qname"] for p in some for batch in reader.read(p) for r in batch.to_pylist()]
    assert got == [f"q{i}" for i in range(60, 85)]
    assert [p.value for p in bam.Reader(str(made / "x.bam"), ["empty"], True).partitions()] == [(0, 0, None)]
