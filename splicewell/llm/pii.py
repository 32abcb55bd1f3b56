"""Personal data by candidate gradient boosting, in DataFrame functions only.

Base patterns with their checks give spans that always stay. Besides, one
high-recall generator for each kind proposes looser, overlapping candidates; a
fifth kind, secret (passwords, access tokens), has generators only. Each
candidate has a few coded features of its format and of the signs beside it.

Boosted trees are taught with weak labels that the features don't show: of
email, ip, card and phone, whether the candidate's canonical form ("(at)" as @,
00 as +, other separators dropped) passes the kind's full check, checksum
included; of secrets, whether a second generator agrees, which looks at the word
that the value is assigned to or at published prefixes of access keys.
Candidates that aren't base matches are added where the estimate reaches a
threshold calibrated on the other half of them, over such loose candidates alone.

Training needs only counts for each combination of features (a bounded number,
whatever the size of the corpus); they are aggregated over all documents. Trees
become nested CASE expressions, so scoring stays in the JVM. Work is linear in
the length of a text: positions are running sums, signs beside a candidate come
from the pieces between candidates, and texts are cut through blocks.

All lists of spans live in arrays beside the text: no shuffle, and rows without
an id or repeated rows need no care. Defined results: a null text counts as
empty and has no spans; extra columns stay, and the result's columns get names
that are free; candidates that overlap a base span are not added, and of added
ones that overlap, the likelier stays, then that of the kind listed first, then
the one that starts first; without SUPPORT loose candidates in the calibration
half, or where too few of them are labelled, a kind adds nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ["email", "ip", "card", "phone"]
SECRET = "secret"
ALL_KINDS = [*KINDS, SECRET]

# Base patterns. Beside what they match, they are written so that matching is linear: a match starts at the
# front of its run of characters or where the last match ended, and loops give nothing back.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Words that secrets are assigned to, and published prefixes of access keys: what the second generator of secrets looks at.
_ASSIGNED = r"(?i:password|passwd|pwd|token|secret|api[_-]?key)[\x20\x22']{0,2}[=:][\x20\x22']{0,2}"
_PREFIXES = r"AKIA|ASIA|ghp_|gho_|xox[abp]-|sk_live_|glpat-"
# Generators of candidates; repetitions are bounded.
GENERATORS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]{1,63}+){0,8}",
    "ip": r"(?<![0-9.])[0-9]{1,4}(?:\x20?[.,:]\x20?[0-9]{1,4}){3}(?![0-9.])",
    "card": r"(?<![0-9])[0-9](?:[\x20./_-]{0,2}+[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+|00)?\(?[0-9](?:[\x20()./-]{0,2}+[0-9]){6,14}(?![0-9A-Za-z])",
    # a long run of letters and digits with a digit or a capital behind its first character (long plain words are none),
    # or what stands behind a colon or an equals sign
    SECRET: r"(?<![A-Za-z0-9_-])(?:(?=[A-Za-z0-9_-]{12})(?=[A-Za-z0-9_-][a-z_-]{0,126}+[A-Z0-9])[A-Za-z0-9_-]{12,128}+(?![A-Za-z0-9_-])|(?<=[=:][\x20\x22']{0,2})[^\s\x22'=:]{4,128}+)",
}


def _may(kind: str, text: Column, base: bool = False) -> Column:
    """A cheap test that a text has to pass before the patterns of a kind are tried."""
    if kind == "email":
        return text.contains("@") if base else text.contains("@") | text.contains("(at)") | text.contains("[at]")
    if kind == SECRET:
        return F.lit(True)  # nearly all texts would pass
    return text.contains("+") if base and kind == "phone" else text.rlike("[0-9]")


_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Words that speak for a kind when they stand shortly before a candidate.
CONTEXT = {"email": "mail|contact|write", "ip": "ip|host|server|address", "card": "card|visa|credit|account|payment", "phone": "tel|phone|call|mobile|fax", SECRET: "key|login|auth"}
CONTEXT_CHARS = 24
ROUNDS = 24
RATE = 0.4
#: Most that one tree adds to a candidate's log-odds.
STEP = 2.0
#: Share of loose candidates above a threshold that are labelled, in the calibration half; and how many there must be.
PRECISION = 0.98
SUPPORT = 20
BLOCK = 256
#: Code points in the blocks that a text is cut through.
TEXT_BLOCK = 8192
#: Candidates on either side that one may overlap: they are bounded in length, and those of one kind don't overlap.
REACH = 400


def _digits(token: Column) -> Column:
    return F.regexp_replace(token, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Luhn's check of up to 20 digits."""
    padded = F.lpad(digits, 20, "0")
    plain = [F.substring(padded, i, 1).cast("int") for i in range(2, 21, 2)]
    double = F.translate(padded, "0123456789", "0246813579")
    doubled = [F.substring(double, i, 1).cast("int") for i in range(1, 21, 2)]
    return sum(plain[1:] + doubled, plain[0]) % 10 == 0


def passes(kind: str, token: Column) -> Column:
    """The check of a base match."""
    if kind == "ip":
        return token.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.length(_digits(token)).between(13, 19) & _luhn(_digits(token))
    if kind == "phone":
        return F.length(_digits(token)).between(9, 15)
    return F.lit(True)


def strict(kind: str, token: Column) -> Column:
    """Whether a candidate is what the base pattern and its check take."""
    return token.rlike(f"^(?:{BASE[kind]})$") & passes(kind, token)


def canonical(kind: str, token: Column) -> Column:
    """A candidate as the base pattern would have it."""
    if kind == "email":
        plain = F.regexp_replace(F.regexp_replace(token, r"\x20", ""), r"\(at\)|\[at\]", "@")
        return F.regexp_replace(plain, r"\(dot\)|\[dot\]", ".")
    if kind == "ip":
        return F.regexp_replace(F.regexp_replace(token, r"\x20", ""), "[,:]", ".")
    if kind == "card":
        return _digits(token)
    return F.regexp_replace(F.regexp_replace(token, "^00", "+"), "/", "-")


def labelled(kind: str, token: Column, before: Column) -> Column:
    """The weak label of a candidate."""
    if kind == SECRET:
        return before.rlike(f"{_ASSIGNED}$") | token.rlike(rf"^(?:{_PREFIXES})")
    return strict(kind, canonical(kind, token))


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once however often body uses it (also inside lambdas)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, zero: Column, step) -> Column:
    """What step(acc, x) gives up to and with each element of an array, after zero; in blocks so that long arrays stay cheap."""

    def runs(part: Column, first: Column) -> Column:
        return F.aggregate(part, F.array(first), lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), x))))

    def joined(parts: Column) -> Column:
        bases = runs(F.transform(parts, lambda b: F.aggregate(b, zero, step)), zero)  # one more than there are blocks
        return F.flatten(F.transform(F.arrays_zip(parts.alias("b"), F.slice(bases, 1, F.size(parts)).alias("first")), lambda x: F.slice(runs(x["b"], x["first"]), 2, F.size(x["b"]))))

    blocks = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: F.slice(v, b * BLOCK + 1, BLOCK))
    return _let(values, lambda v: _let(blocks(v), joined))


def _matches(df: DataFrame, text: str, pattern: str, may: Column, into: str, sides: bool = False) -> DataFrame:
    """Adds an array of structs (token, start, end) of the pattern's matches; code points, end exclusive.

    sides: also before and after, the text beside, back to the match before and on to the next one.
    """
    kind = f"array<struct<token:string,start:int,end:int{',before:string,after:string' if sides else ''}>>"
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1)

    def spans(x: Column) -> Column:
        m, g = x["m"], x["g"]
        # a match's end: lengths of all pieces and matches up to it
        ends = _running(F.zip_with(m, F.slice(g, 1, F.size(m)), lambda a, b: F.length(a) + F.length(b)), F.lit(0), lambda a, x: a + x)
        rows = F.arrays_zip(m.alias("m"), ends.alias("e"), F.slice(g, 1, F.size(m)).alias("left"), F.slice(g, 2, F.size(m)).alias("right"))
        beside = lambda r: [F.right(r["left"], F.lit(CONTEXT_CHARS)).alias("before"), F.substring(r["right"], 1, 1).alias("after")] if sides else []
        return F.transform(rows, lambda r: F.struct(r["m"].alias("token"), (r["e"] - F.length(r["m"])).alias("start"), r["e"].alias("end"), *beside(r)))

    some = _let(found, lambda m: F.when(F.size(m) > 0, _let(F.struct(m.alias("m"), pieces.alias("g")), spans)))
    return df.withColumn(into, F.coalesce(F.when(may, some), F.array().cast(kind)))


def _checked(spans: str, kind: str) -> Column:
    return F.filter(spans, lambda s: passes(kind, s["token"]))


def base_spans(df: DataFrame, text: str) -> DataFrame:
    """Adds __base_<kind> for each kind: base matches that pass their check."""
    for kind in KINDS:
        df = _matches(df, text, BASE[kind], _may(kind, F.col(text), base=True), f"__base_{kind}")
        df = df.withColumn(f"__base_{kind}", _checked(f"__base_{kind}", kind))
    return df


def _features(kind: str, span: Column) -> dict[str, Column]:
    """Small ints that code format and context."""
    token, before, after = span["token"], span["before"], span["after"]
    digits, zero = F.length(_digits(token)), F.lit(0)

    def has(pattern: str) -> Column:
        return F.when(token.rlike(pattern), 1).otherwise(0)

    def side(char: Column) -> Column:
        return F.when(char == "", 0).when(char.rlike(r"\s"), 1).when(char.rlike("[\"'=:#(<]"), 2).otherwise(3)

    shared = {"left": side(F.right(before, F.lit(1))), "right": side(after), "context": F.when(F.lower(before).rlike(CONTEXT[kind]), 1).otherwise(0), "hyphens": has("-")}
    if kind == SECRET:
        own = {
            "digits": F.floor(digits * 8 / F.length(token)).cast("int"),
            "length": F.least(F.floor(F.length(token) / 4).cast("int"), F.lit(16)),
            "upper": has("[A-Z]"), "lower": has("[a-z]"), "hex": has("^[0-9a-f]+$"), "others": has("[^A-Za-z0-9-]"),
        }
    else:
        own = {
            "digits": F.least(digits, F.lit(20)),
            "first": F.coalesce(F.substring(_digits(token), 1, 1).try_cast("int"), F.lit(10)),
            "spaces": has(r"\x20"), "dots": has(r"\."), "others": has(r"[/_,:\[\]]"), "brackets": has(r"[()]"),
        }
    return {f: (shared | own).get(f, zero) for f in FEATURES}


def _coded(spans: str, kind: str) -> Column:
    def one(s: Column) -> Column:
        features = [c.alias(n) for n, c in _features(kind, s).items()]
        is_strict = F.lit(False) if kind == SECRET else strict(kind, s["token"])
        return F.struct(s["token"].alias("token"), s["start"].alias("start"), s["end"].alias("end"), is_strict.alias("strict"), labelled(kind, s["token"], s["before"]).alias("label"), *features)

    return F.transform(spans, one)


def candidate_spans(df: DataFrame, text: str, kinds: list[str] = ALL_KINDS) -> DataFrame:
    """Adds __cand_<kind>: structs of token, start, end, strict, label and the features."""
    for kind in kinds:
        df = _matches(df, text, GENERATORS[kind], _may(kind, F.col(text)), f"__cand_{kind}", sides=True)
        df = df.withColumn(f"__cand_{kind}", _coded(f"__cand_{kind}", kind))
    return df


FEATURES = ["digits", "first", "spaces", "hyphens", "dots", "others", "brackets", "left", "right", "context", "length", "upper", "lower", "hex"]


@dataclass
class Boosted:
    """Trees of depth two for one kind, and the threshold of their probability (above 1: nothing is added)."""

    offset: float = -5.0
    trees: list = field(default_factory=list)
    threshold: float = 2.0

    def value(self, x: dict) -> float:
        """Log-odds of a row of features."""
        total = self.offset
        for on, at, low, high in self.flat(x):
            total += low if on is None or x[on] <= at else high
        return total

    def flat(self, x: dict) -> list:
        """The inner node that a row reaches in each tree."""
        return [t["right" if x[t["on"]] > t["at"] else "left"] for t in self.trees]

    def expression(self, span: Column) -> Column:
        """Probability of a candidate struct."""
        total = F.lit(self.offset)
        for t in self.trees:
            sides = []
            for leaf in (t["left"], t["right"]):
                on, at, low, high = leaf
                sides.append(F.lit(low) if on is None else F.when(span[on] > at, high).otherwise(low))
            total = total + F.when(span[t["on"]] > t["at"], sides[1]).otherwise(sides[0])
        return 1 / (1 + F.exp(-total))


def _best_split(rows: list[dict], grad: list[float], hess: list[float], idx: list[int]) -> tuple | None:
    """(gain, feature, value) of the best split of some rows by feature > value."""
    g, h = sum(grad[i] for i in idx), sum(hess[i] for i in idx)
    best = None
    for f in FEATURES:
        by: dict[int, list[float]] = {}
        for i in idx:
            x = by.setdefault(rows[i][f], [0.0, 0.0])
            x[0] += grad[i]
            x[1] += hess[i]
        gl = hl = 0.0
        for v in sorted(by)[:-1]:
            gl, hl = gl + by[v][0], hl + by[v][1]
            gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
            if best is None or gain > best[0] + 1e-12:
                best = (gain, f, v)
    return best if best and best[0] > 1e-6 else None


def boost(rows: list[dict]) -> Boosted:
    """Fits the trees of one kind to counted feature rows (n, pos, loose, loose_pos); even and odd folds train and calibrate."""
    train, rest = [r for r in rows if r["fold"] == 0], [r for r in rows if r["fold"] == 1]
    n, pos = sum(r["n"] for r in train), sum(r["pos"] for r in train)
    if not pos or pos == n:
        model = Boosted() if not pos else Boosted(offset=3.0)
        model.threshold = _calibrated(model, rest)
        return model
    model = Boosted(offset=math.log(pos / (n - pos)))
    score = [model.offset] * len(train)
    step = lambda idx, g, h: RATE * sum(g[i] for i in idx) / (sum(h[i] for i in idx) + 1)
    leaf = lambda idx, g, h: -max(-STEP, min(STEP, step(idx, g, h)))
    for _ in range(ROUNDS):
        p = [1 / (1 + math.exp(-s)) for s in score]
        g = [r["n"] * q - r["pos"] for r, q in zip(train, p, strict=True)]
        h = [r["n"] * q * (1 - q) for r, q in zip(train, p, strict=True)]
        top = _best_split(train, g, h, list(range(len(train))))
        if not top:
            break
        tree = {"on": top[1], "at": top[2]}
        for name, right in (("left", False), ("right", True)):
            idx = [i for i, r in enumerate(train) if (r[top[1]] > top[2]) == right]
            below = _best_split(train, g, h, idx)
            if below:
                low = leaf([i for i in idx if train[i][below[1]] <= below[2]], g, h)
                high = leaf([i for i in idx if train[i][below[1]] > below[2]], g, h)
                tree[name] = (below[1], below[2], low, high)
            else:
                tree[name] = (None, 0, leaf(idx, g, h), 0.0)
        model.trees.append(tree)
        one = Boosted(0.0, [tree])
        score = [s + one.value(r) for s, r in zip(score, train, strict=True)]
    model.threshold = _calibrated(model, rest)
    return model


def _calibrated(model: Boosted, rows: list[dict]) -> float:
    """The smallest probability above which PRECISION of SUPPORT loose candidates or more are labelled."""
    scored = sorted(((1 / (1 + math.exp(-model.value(r))), r["loose"], r["loose_pos"]) for r in rows if r["loose"]), reverse=True)
    n = pos = 0
    found = 2.0
    for k, (p, a, b) in enumerate(scored):
        n, pos = n + a, pos + b
        if (k + 1 == len(scored) or scored[k + 1][0] < p) and n >= SUPPORT and pos >= PRECISION * n:
            found = p - 1e-9
    return found


def _counted(kind: str) -> Column:
    """What the trees learn from: fold, label and features of each candidate of a kind."""
    fold = lambda s: F.pmod(F.xxhash64(s["token"]), F.lit(2)).cast("int")
    flags = lambda s: [s["strict"].cast("int").alias("strict"), (s["strict"] | s["label"]).cast("int").alias("label")]
    return F.transform(f"__cand_{kind}", lambda s: F.struct(F.lit(kind).alias("kind"), fold(s).alias("fold"), *flags(s), *[s[f].alias(f) for f in FEATURES]))


def _ranked(spans: str, rank: int) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(rank).alias("rank"), s["start"].alias("start"), s["end"].alias("end")))


def _selected(kind: str, rank: int, model: Boosted) -> Column:
    """Candidates that reach the threshold; those that are base spans go later, as they overlap them."""
    scored = F.transform(f"__cand_{kind}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), model.expression(s).alias("p"), F.lit(rank).alias("rank")))
    return F.filter(scored, lambda s: s["p"] >= model.threshold)


LEAST = -(2**31) + 1


def _apart(base: Column, new: Column) -> Column:
    """Of new spans those that overlap none of the base, in order of start.

    A span's neighbours tell: the furthest end of the base spans that start before it, and the next start of one.
    """
    mixed = lambda a, is_new: F.transform(a, lambda s: F.struct(s["start"].alias("start"), F.lit(is_new).alias("new"), s["end"].alias("end"), (s["p"] if is_new else F.lit(0.0)).alias("p"), s["rank"].alias("rank")))
    most = lambda a, x: F.greatest(a, x)

    def free(both: Column) -> Column:
        ends = _running(F.transform(both, lambda s: F.when(s["new"] == 0, s["end"]).otherwise(-1)), F.lit(-1), most)
        starts = F.reverse(_running(F.transform(F.reverse(both), lambda s: F.when(s["new"] == 0, -s["start"]).otherwise(LEAST)), F.lit(LEAST), most))
        rows = F.arrays_zip(both.alias("s"), ends.alias("end"), starts.alias("next"))
        return F.transform(F.filter(rows, lambda r: (r["s"]["new"] == 1) & (r["end"] <= r["s"]["start"]) & (-r["next"] >= r["s"]["end"])), lambda r: r["s"])

    return _let(F.array_sort(F.concat(mixed(base, 0), mixed(new, 1))), free)


def _unbeaten(new: Column) -> Column:
    """Of candidates in order of start, those that no overlapping one beats."""

    def beats(d: Column, c: Column) -> Column:
        first = (d["rank"] < c["rank"]) | ((d["rank"] == c["rank"]) & (d["start"] < c["start"]))
        return (d["start"] < c["end"]) & (c["start"] < d["end"]) & ((d["p"] > c["p"]) | ((d["p"] == c["p"]) & first))

    def kept(all_: Column) -> Column:
        around = lambda i: F.slice(all_, F.greatest(i - REACH + 1, F.lit(1)), F.lit(2 * REACH + 1))
        return F.filter(all_, lambda c, i: ~F.exists(around(i), lambda d: beats(d, c)))

    return F.transform(_let(new, kept), lambda c: F.struct(c["rank"].alias("rank"), c["start"].alias("start"), c["end"].alias("end")))


def fit(df: DataFrame, text: str = "text") -> dict[str, Boosted]:
    """Boosted trees for each kind; counts over all documents, one row for each combination of features comes to the driver.

    There are at most about 250,000 combinations of the numeric kinds and 10,000 of secrets, some hundreds in practice.
    """
    seen = candidate_spans(df.select(F.coalesce(F.col(text), F.lit("")).alias("text")), "text")
    rows = (
        seen.select(F.explode(F.concat(*[_counted(k) for k in ALL_KINDS])).alias("c"))
        .select("c.*")
        .groupBy("kind", "fold", *FEATURES)
        .agg(F.count("*").alias("n"), F.sum("label").alias("pos"), F.sum(1 - F.col("strict")).alias("loose"), F.sum((1 - F.col("strict")) * F.col("label")).alias("loose_pos"))
        .collect()
    )
    rows = sorted((r.asDict() for r in rows), key=lambda r: tuple(r[c] for c in ("kind", "fold", *FEATURES)))
    return {k: boost([r for r in rows if r["kind"] == k]) for k in ALL_KINDS}


def columns(df: DataFrame) -> tuple[str, str]:
    """The names that find() gives its columns beside those of a table: pii_base and pii_spans, unless they are taken."""
    return common.free(df, "pii_base"), common.free(df, "pii_spans")


def find(df: DataFrame, models: dict[str, Boosted], text: str = "text") -> DataFrame:
    """Adds pii_base and pii_spans (or as columns() says): arrays of structs (kind, start, end) in order of kind, then start."""
    names, spans = df.columns, columns(df)
    inner = {c: f"in_{i}" for i, c in enumerate(names)}  # no clash with the columns made here
    df = df.select([F.col(f"`{c}`").alias(n) for c, n in inner.items()])
    df = df.withColumn("__text", F.coalesce(F.col(inner[text]), F.lit("")))
    active = [k for k in ALL_KINDS if k in models and models[k].threshold <= 1]
    df = candidate_spans(base_spans(df, "__text"), "__text", active)
    df = df.withColumn("__base", F.concat(*[_ranked(f"__base_{k}", i) for i, k in enumerate(KINDS)]))
    none = F.array().cast("array<struct<rank:int,start:int,end:int>>")
    kept = none
    if active:
        new = F.concat(*[_selected(k, ALL_KINDS.index(k), models[k]) for k in active])
        kept = _let(new, lambda n: F.when(F.size(n) > 0, _unbeaten(_apart(F.col("__base"), n))).otherwise(none))
    kinds = F.array(*[F.lit(k) for k in ALL_KINDS])
    named = lambda a: F.transform(a, lambda s: F.struct(F.element_at(kinds, s["rank"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    out = df.withColumn(spans[0], named(F.col("__base"))).withColumn(spans[1], named(F.array_sort(F.concat("__base", kept))))
    return out.select(*[F.col(n).alias(c) for c, n in inner.items()], *spans)


def redact(df: DataFrame, text: str = "text", spans: str = "pii_spans") -> DataFrame:
    """Replaces every span by its kind in brackets; overlapping spans become one, with the kind of the first.

    The text is cut into blocks first, so that no piece is looked for from the front of a long text.
    """
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.upper(s["kind"]).alias("kind"))))

    def merged(s: Column) -> Column:
        """(start, kind, end, before) of runs of overlapping spans; before is the end of the run before."""
        ends = _running(F.transform(s, lambda x: x["end"]), F.lit(0), lambda a, x: F.greatest(a, x))
        rows = _let(ends, lambda e: F.arrays_zip(s.alias("s"), e.alias("end"), F.concat(F.array(F.lit(0)), F.slice(e, 1, F.size(e) - 1)).alias("before")))
        heads = lambda r: F.filter(r, lambda x: x["s"]["start"] >= x["before"])
        # a run ends where the next one's "before" says, the last one at the end of all
        return _let(rows, lambda r: _let(heads(r), lambda h: F.zip_with(h, F.concat(F.slice(F.transform(h, lambda x: x["before"]), 2, F.size(h)), F.array(F.element_at(r, -1)["end"])), lambda x, end: F.struct(x["s"]["start"].alias("start"), x["s"]["kind"].alias("kind"), end.alias("end"), x["before"].alias("before")))))

    def piece(parts: Column, low: Column, high: Column) -> Column:
        """Code points low to high of a text in blocks."""
        first = F.floor(low / TEXT_BLOCK).cast("int")
        last = F.floor(F.greatest(high - 1, low) / TEXT_BLOCK).cast("int")
        return F.substring(F.array_join(F.slice(parts, first + 1, last - first + 1), ""), low - first * TEXT_BLOCK + 1, high - low)

    def cut(x: Column) -> Column:
        parts, runs = x["parts"], x["runs"]
        front = F.transform(runs, lambda r: F.concat(piece(parts, r["before"], r["start"]), F.lit("["), r["kind"], F.lit("]")))
        return F.concat(F.array_join(front, ""), piece(parts, F.element_at(runs, -1)["end"], F.length(text)))

    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{TEXT_BLOCK}}}"), 0)
    changed = _let(F.struct(parts.alias("parts"), _let(ordered, merged).alias("runs")), cut)
    return df.withColumn(text, F.when(F.size(spans) > 0, changed).otherwise(F.col(text)))


def op1_pii(spark, sf_dir: str) -> DataFrame:
    """Spans of personal data of every document; those of secrets stand behind the other kinds."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, fit(docs))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("pii_base", lambda s: s["kind"] == kind)).cast("long")
    counts = [of(k).alias(f"n_{k}") for k in KINDS]
    added = (F.size("pii_spans") - F.size("pii_base")).cast("long").alias("n_added")
    return found.select("doc_id", *counts, F.sha2(joined("pii_base"), 256).alias("base_sha256"), joined("pii_spans").alias("spans"), added)
