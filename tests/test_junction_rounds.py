"""Junction assignment with re-validation against a queue, one key at a time."""

import heapq
import random
from collections import Counter

import pytest
from splicewell.functions.alignment import align_many
from splicewell.operators import intervals, rounds
from splicewell.operators.mismatch import errors, stretched
from splicewell.params import DEFAULT as P

REACH = 300
HIT = "region_id long, rev boolean, read_id long, qname string, secondary boolean, offset_start long, offset_end long, lclip long, rclip long, lclip_quality int, rclip_quality int, score long, seq string, cigar string"


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def rand(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    """Tables here have few rows and many stages."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


class Hit:
    def __init__(self, name, secondary, start, end, lclip, rclip, lq, rq, score, seq, cigar=""):
        self.name, self.secondary, self.start, self.end, self.lclip, self.rclip, self.lq, self.rq, self.score, self.seq, self.cigar = name, secondary, start, end, lclip, rclip, lq, rq, score, seq, cigar


def distances(hits, rev, length):
    out = {}
    for h in hits:
        if not h.secondary:
            d = h.end + h.rclip if rev else length - h.start + h.lclip
            out[h.name] = max(out.get(h.name, d), d)
    return out


def dedup(host, virus, rev, length, v_rev, v_length):
    hd, vd = distances(host, rev, length), distances(virus, v_rev, v_length)
    best = {}
    for v in virus:
        if v.name in hd:
            best[v.name] = max(best.get(v.name, 0), v.score)
    seen, kept = set(), set()
    for name in sorted(best, key=lambda n: (-best[n], n)):
        at = (hd[name], vd.get(name, 0))
        if at not in seen:
            kept.add(name)
        seen.add(at)
    return kept


def window(hits, rev):
    clips = Counter(h.start if rev else h.end for h in hits if (h.lclip if rev else h.rclip))
    first, last = min(h.start for h in hits), max(h.end for h in hits)
    bp = None
    if clips:
        at = max(clips, key=lambda k: (clips[k], -k if rev else k))
        if clips[at] >= 2 or at == (first if rev else last):
            bp = at
    elif rev and first == 0:
        bp = 0
    if bp is None:
        ends = [(h.start if rev else h.end, h.score) for h in hits]
        total = {e: sum(s for x, s in ends if (e <= x < e + REACH if rev else e - REACH < x <= e)) for e, _ in ends}
        bp = max(total, key=lambda k: (total[k], k if rev else -k))
    return (bp, bp + REACH) if rev else (bp - REACH, bp)


def far(h, w):
    c = P.max_clip_distance
    return (h.lclip > c and abs(h.start - w[0]) > c, h.rclip > c and abs(h.end - w[1]) > c)


def misfit(h, w):
    left, right = far(h, w)
    return h.start < w[0] or h.end > w[1] or (left and h.lq >= P.clip_quality) or (right and h.rq >= P.clip_quality)


def low(seq):
    counts = sorted((sum(seq[k : k + 2] == a + b for k in range(len(seq) - 1)) for a in "ACGT" for b in "ACGT"), reverse=True)
    return counts[0] + counts[1] >= 0.75 * (len(seq) + 1)


def suspect(h, w):
    return low(h.seq[h.lclip : len(h.seq) - h.rclip]) or any(far(h, w))


class Queue:
    """One connected whole, by a queue."""

    def __init__(self, hits, mates, places, lengths, virus):
        self.hits, self.mates, self.places, self.lengths, self.virus = hits, mates, places, lengths, virus
        self.used, self.cache = set(), {}

    def across(self, wanted):
        """Accepted alignments of (place, sequence), each made once."""
        new = [x for x in dict.fromkeys(wanted) if x not in self.cache]
        turned = [(rc(seq) if place[3] else seq, self.virus[place[0]][place[1] : place[2]]) for place, seq in new]
        for x, (q, _), a in zip(new, turned, align_many(turned), strict=True):
            left, right = a.query_begin, len(q) - 1 - a.query_end
            ok = a.ref_end - a.ref_begin + 1 >= P.min_span and a.score >= P.min_score and not (left >= P.min_clip and right >= P.min_clip)
            self.cache[x] = (a, q, left, right) if ok else None
        return [self.cache[x] for x in wanted]

    def trial(self, key):
        """(first, second, support) or None without a virus region."""
        region, rev = key
        live = [h for h in self.hits[key] if h.name not in self.used]
        length = self.lengths[region]
        anchors = {}
        for name in {h.name for h in live if not h.secondary}:
            for contig, strand, a, b in self.places.get(name, []):
                anchors.setdefault((contig, strand), []).append((a, b))
        found = {}
        for (contig, _), spans in anchors.items():
            import numpy as np

            spans.sort()
            s, e, _ = intervals.collapse(np.array([x[0] for x in spans]), np.array([x[1] for x in spans]))
            found.setdefault(contig, []).extend(intervals.agglomerate(list(zip(s.tolist(), e.tolist(), strict=True)), REACH))
        regions = set()
        for contig, spans in found.items():
            merged = []
            for a, b in sorted(spans):
                if merged and a <= merged[-1][1] + 9:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            for a, b in merged:
                room, size = max(0, REACH - (b - a + 1)), len(self.virus[contig])
                a, b = max(0, a - room), min(b + room, size)
                regions.add((contig, a // 500 * 500, min(b // 500 * 500 + 500, size)))
        if not regions:
            return None
        entries = [(h, self.mates[h.name], False) for h in live if not h.secondary and h.name in self.mates]
        entries += [(h, h.seq if rev else rc(h.seq), True) for h in live if (h.lclip if rev else h.rclip)]
        best = None
        for contig, a, b in sorted(regions):
            for v_rev in (False, True):
                rows = []
                found = self.across([((contig, a, b, v_rev), seq) for _, seq, _ in entries])
                for (h, _, made), got in zip(entries, found, strict=True):
                    if got:
                        al, q, left, right = got
                        rows.append((h, Hit(h.name, made, al.ref_begin, al.ref_end, left, right, P.clip_quality, P.clip_quality, al.score, q)))
                score, kept, w, vw = (0, 0), [], None, None
                first = dedup([h for h, _ in rows], [v for _, v in rows], rev, length, v_rev, b - a)
                if first:
                    w = window([h for h, _ in rows if h.name in first], rev)
                    vw = window([v for _, v in rows if v.name in first], v_rev)
                    bad = {h.name for h, _ in rows if misfit(h, w)} | {v.name for _, v in rows if misfit(v, vw)}
                    kept = [r for r in rows if r[0].name not in bad]
                    counted = [r for r in kept if r[0].name in first]
                    score = (sum(h.score for h, _ in counted), sum(v.score for _, v in counted))
                    if not counted:
                        kept = []
                if best is None or score > best[0]:
                    best = (score, (contig, a, b, v_rev), kept, w, vw)
        _, place, kept, w, vw = best
        virus = [v for _, v in kept]
        names = dedup(live, virus, rev, length, place[3], place[2] - place[1])
        host = [h for h in live if h.name in names]
        first = sum(h.score for h in host)
        wrong = {h.name for h, e in zip(host, errors([(h.start, stretched(h.seq, h.cigar)) for h in host]), strict=True) if e > P.mismatch_rate * (h.end - h.start + 1)}
        host, virus = [h for h in host if h.name not in wrong], [v for v in virus if v.name in names - wrong]
        odd = {v.name for v in virus if suspect(v, vw)}
        good = [h for h in host if not suspect(h, w) and h.name not in odd]
        return first, sum(h.score for h in good), (place, host)

    def run(self):
        heap = [(-s, tuple(-int(x) for x in k), k) for k in self.hits if (s := sum(h.score for h in self.hits[k])) > P.min_call_score]
        heapq.heapify(heap)
        out = []
        push = lambda s, k: heapq.heappush(heap, (-s, tuple(-int(x) for x in k), k))
        while heap:
            _, _, key = heapq.heappop(heap)
            got = self.trial(key)
            if not got:
                continue
            leads = lambda s, key=key: not heap or (-s, tuple(-int(x) for x in key)) < heap[0][:2]
            if not leads(got[0]):
                if got[0] > P.min_call_score:
                    push(got[0], key)
                continue
            if got[1] > P.min_call_score:
                if leads(got[1]):
                    place, host = got[2]
                    out.append((*key, *place, got[1], frozenset(h.name for h in host)))
                    self.used |= {h.name for h in host}
                push(got[1], key)
        return sorted(out, key=str)


def planted(rng, case, rows):
    """A case of regions that share names, near repeats, clips, wrong bases and wrong mates; ids and contigs of its own."""
    virus = {f"v{case}_{k}": rand(rng, rng.choice([420, 700])) for k in range(rng.choice([1, 1, 2]))}
    host = rand(rng, 500)
    regions = {case * 10 + k: (host if k < 2 else rand(rng, 500)) for k in range(rng.randint(1, 4))}
    lengths = {r: len(s) for r, s in regions.items()}
    mates, places, hits = {}, {}, {}
    for n in range(rng.randint(8, 24)):
        name = f"c{case}_q{n}"
        contig = rng.choice(list(virus))
        v = virus[contig]
        at = rng.choice([100, 150, 150, 150, 150, 300]) + rng.randint(0, 40)
        seq = v[at : at + 60]
        if rng.random() < 0.1:
            seq = rand(rng, 60)
        turn = rng.random() < 0.8
        mates[name] = rc(seq) if turn else seq
        if rng.random() < 0.93:
            places[name] = [(contig, "R" if turn else "F", at, at + 60)]
        if rng.random() < 0.07:
            del mates[name]
        shared = rng.sample(sorted(regions), rng.randint(1, min(3, len(regions))))
        start = rng.choice([180, 200, 220]) + rng.randint(0, 60)
        for region in shared:
            for _ in range(1 + (rng.random() < 0.15)):
                rev = rng.random() < 0.15
                lclip, rclip = rng.choice([(0, 0)] * 6 + [(0, 25), (0, 12), (15, 0), (22, 0)])
                aligned = list(regions[region][start : start + 60])
                for _ in range(rng.choice([0, 0, 0, 0, 0, 1, 6])):
                    aligned[rng.randrange(60)] = rng.choice("ACGT")
                aligned = rng.choice(["AC" * 30, "".join(aligned)]) if rng.random() < 0.06 else "".join(aligned)
                text = (rand(rng, lclip) if rng.random() < 0.5 else v[150 - lclip : 150]) + aligned + (v[150 : 150 + rclip] if rng.random() < 0.7 else rand(rng, rclip))
                cigar = (f"{lclip}S" if lclip else "") + "60M" + (f"{rclip}S" if rclip else "")
                secondary = (lclip >= 20 or rclip >= 20) and rng.random() < 0.5
                h = Hit(name, secondary, start, start + 60, lclip, rclip, rng.choice([5, 30]), rng.choice([5, 30]), rng.choice([40, 50, 60]), text, cigar)
                hits.setdefault((region, rev), []).append(h)
    for (region, rev), hs in hits.items():
        for h in hs:
            rows.append((region, rev, len(rows), h.name, h.secondary, h.start, h.end, h.lclip, h.rclip, h.lq, h.rq, h.score, h.seq, h.cigar))
    return Queue(hits, mates, places, lengths, virus)


def tables_of(spark, cases, rows):
    mates = [(n, s, None) for q in cases for n, s in q.mates.items()]
    places = [(n, *p) for q in cases for n, ps in q.places.items() for p in ps]
    regions = [(r, "chr1", r * 1000, n) for q in cases for r, n in q.lengths.items()]
    virus = [(c, s) for q in cases for c, s in q.virus.items()]
    make = spark.createDataFrame
    return (
        make(rows, HIT), make(mates, "qname string, seq string, quals array<int>"), make(places, "qname string, contig string, strand string, start long, end long"),
        make(regions, "region_id long, contig string, start long, length long"), make(virus, "name string, seq string"),
    )


@pytest.fixture(scope="module")
def fifty(spark):
    rng, rows = random.Random(7), []
    cases = [planted(rng, c, rows) for c in range(50)]
    hits, mates, places, regions, virus = tables_of(spark, cases, rows)
    return cases, rounds.assign(hits, mates, places, regions, virus, REACH).cache(), regions, virus


def test_rounds_equal_the_queue_on_planted_cases(fifty):
    cases, support, _, _ = fifty
    names = {}
    for r in support.where("side = 'host'").collect():
        names.setdefault((r.region_id, r.rev, r.v_contig, r.v_start, r.v_end, r.v_rev, r.worth), set()).add(r.qname)
    got = sorted(((*k, frozenset(v)) for k, v in names.items()), key=str)
    wanted = sorted((x for q in cases for x in q.run()), key=str)
    assert got == wanted and len(wanted) > 40


def test_steps_of_joins_equal_the_queue(spark):
    """Keys are kept and put back alike in one task and by steps of joins, until all that is left waits for a trial."""
    import pandas as pd

    rng, columns = random.Random(11), [*rounds.KEY, "worth", "first", "second", "valid", "qname", "takes"]
    rows = []
    for region in range(30):
        worth = rng.choice([150, 200, 250, 300])
        first = worth - rng.choice([0, 0, 30])
        state = (worth, first, first - rng.choice([0, 0, 40, 120]), rng.random() < 0.9)
        names = rng.sample(range(region // 6 * 10, region // 6 * 10 + 10), rng.randint(1, 3))
        rows += [(region, region % 3 == 0, *state, f"q{n}", k == 0 or rng.random() < 0.7) for k, n in enumerate(names)]
    wanted = rounds.decide(pd.DataFrame(rows, columns=columns), 100)
    kept, left = set(), rows
    while True:
        df = spark.createDataFrame(left, "region_id long, rev boolean, worth long, first long, second long, valid boolean, qname string, takes boolean")
        found = {(r.region_id, r.rev): r for r in rounds._one_step(df, 100).collect()}
        if not any(r.kept or r.worth != row[2] for row in left for r in [found[row[:2]]]):
            break
        new = {k for k, r in found.items() if r.kept}
        kept |= new
        used = {row[6] for row in left if row[:2] in new and row[7]}
        lost = {row[:2] for row in left if row[6] in used}
        left = [(*row[:2], found[row[:2]].worth, *row[3:5], row[5] and row[:2] not in lost, *row[6:]) for row in left if row[6] not in used]
    assert kept == {(r.region_id, r.rev) for r in wanted.itertuples() if r.kept} and len(kept) > 5
    stands = {(r.region_id, r.rev): r.worth for r in wanted.itertuples()}
    assert all(stands[row[:2]] == row[2] for row in left)


def test_no_hits_give_no_junctions(spark, fifty):
    _, support, regions, virus = fifty
    none = [spark.createDataFrame([], x) for x in (HIT, "qname string, seq string, quals array<int>", "qname string, contig string, strand string, start long, end long")]
    found = rounds.assign(*none, regions, virus, REACH)
    assert found.collect() == [] and found.columns == support.columns
    assert rounds.junction_calls(found, regions, virus, REACH).collect() == []
