"""Personal data by candidate gradient boosting. DataFrame functions only.

Base kinds are email, ip, card and phone, by fixed patterns and checks. Two generators of high recall propose more, and what
they propose overlaps freely: anything that looks like an address (its at-sign or dots perhaps written out or bracketed), and
every stretch of neighbouring digit groups with 7 to 19 digits (or of four groups), ASCII or full-width, so a list of numbers proposes all its
parts. Boosted trees score a candidate from its format (groups, separators, lead, checks) and its context (cue words,
what touches it, whether further groups join it).

The trees must know more than the base, so they learn from what the base can't see. A candidate that is a base span vouches for
its place: the text before it, with the span written in another way (VARIANTS: at-signs and dots written out, other separators, no plus, no
country code, full-width digits), is a positive example. Negative ones are the same digits written as what only looks alike
(ALIKE: versions, book numbers, sums, dates, serial numbers), after the same text and after words that go with them. A candidate
that touches no base span has no label: it may be just what is looked for, so where it stands free and its format is that of some positive example it is
left out, however many of its kind there are, and the others are negative examples. Documents are halved by a hash of their id: one half trains, the other calibrates. A kind's
threshold is the lowest score, likelier positive than not, from which on PRECISION of the calibration examples are positive, SUPPORT of them at least.
Candidates at or above it that touch no base span are added as spans of their kind. Of added ones that overlap the highest score
stays, then the longest, then the first; an address goes before numbers in it.

All features have few values, so all examples fold into one table of feature vectors with their counts, at most the
product of the features' values, whatever the input (there are a few thousand in practice). Each round fits a tree of depth DEPTH
to the gradients of the logistic loss on that table; the trees become one CASE expression.

Defined cases: a null or empty text has no spans, and the digest of the empty list. With no base spans to learn from nothing is
added. Rows that repeat stay rows. An empty table gives an empty result. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachlake.llm.common import whole, written
from reachlake.llm.spans import CONTEXT, contains, listed, matches, meets, placed

KINDS = ("email", "ip", "card", "phone")
START = r"(?:\G|(?<![%s]))"
EMAIL = START % "A-Za-z0-9._%+-" + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = START % "0-9" + r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
#: Candidates: an address however its at-sign and dots are written, and groups of digits that separators join.
AT = r"(?:\x20?@\x20?|\x20?[(\[{](?i:at)[)\]}]\x20?|\x20(?i:at)\x20)"
DOT = r"(?:\.|\x20?[(\[{](?:\.|(?i:dot))[)\]}]\x20?|\x20(?i:dot)\x20)"
ADDRESS = START % "A-Za-z0-9._%+-" + rf"[A-Za-z0-9._%+-]++{AT}[A-Za-z0-9-]++(?:{DOT}[A-Za-z0-9-]++)++"
WIDE, NARROW = "０１２３４５６７８９．＋－", "0123456789.+-"
GROUP = "[0-9０-９]++"
JOIN = r"^(?:[\x20().,/_．－-]{1,2}|[(\[{]\.[)\]}])$"
#: How further groups may join an example on its left and right.
SIDES = ((0, 0), (1, 0), (0, 1), (2, 0), (0, 2))
LAST_GROUP = r"[^0-9０-９]{1,3}[0-9０-９]+$"
LEAST_DIGITS, MOST_DIGITS = 7, 19
CUES = r"(?i)(?:mail|tel|phone|fon|mobil|call|fax|card|karte|tarjeta|carte|visa|\bip|host|addr|contact|write)[^0-9]{0,12}$"
OTHER_CUES = r"(?i)(?:\bv|vers(?:ion)?|isbn|\bno\.?|n[r°º]\.?|#|[$€£]|eur|usd|total|sum|price|order|serial|id|date|since|=)[^0-9A-Za-z]{0,6}$"
ROUNDS, DEPTH, RATE, SMOOTH = 30, 4, 0.4, 1.0
PRECISION, SUPPORT = 0.98, 20


def narrow(m: Column) -> Column:
    return F.translate(m, WIDE, NARROW)


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    n = F.char_length(number)
    places = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.substr(number, i, F.lit(1)).cast("int").alias("v"), ((n - i) % 2 == 1).alias("twice")))
    value = lambda x: F.when(x["twice"], F.when(x["v"] > 4, 2 * x["v"] - 9).otherwise(2 * x["v"])).otherwise(x["v"])
    return F.when(n > 0, F.aggregate(places, F.lit(0), lambda s, x: s + value(x)) % 10 == 0).otherwise(F.lit(False))


def passes(kind: str, m: Column) -> Column:
    count = F.char_length(digits(m))
    if kind == "ip":
        return F.regexp_like(m, F.lit(rf"^{BYTE}(?:\.{BYTE}){{3}}$"))
    if kind == "card":
        return F.when(count.between(13, 19), luhn(digits(m))).otherwise(F.lit(False))
    return count.between(9, 15) if kind == "phone" else F.lit(True)


#: Features and the number of their values; all are whole numbers from 0.
FEATURES = {"at": 4, "name": 2, "digits": 6, "groups": 5, "last": 4, "joins": 6, "lead": 4, "luhn": 2, "bytes": 2, "cents": 2, "before": 3, "left": 3, "right": 3, "cue": 4}

#: Features of what stands around a candidate; the others are its format.
AROUND = ("before", "left", "right", "cue")


def feature_values(m: Column, before: Column, left: Column, right: Column, address: Column) -> list[Column]:
    """One column per feature of a candidate m after the text before; left and right say how a further group joins it (0: none does)."""
    plain = F.regexp_replace(narrow(m), r"[(\[{]\.[)\]}]", ".")
    d = digits(plain)
    n = F.char_length(d)
    like = lambda x, p: F.regexp_like(x, F.lit(p))
    joins = F.regexp_replace(plain, r"[0-9+]", "")
    number = lambda x: F.when(address, F.lit(0)).otherwise(x)
    tail = F.char_length(F.regexp_extract(plain, "([0-9]+)[^0-9]*$", 1))
    # How many digits an address of four bytes has says nothing.
    four = passes("ip", plain)
    values = {
        "at": F.when(~address, 0).when(like(m, r"@"), 1).when(like(m, r"(?i)[(\[{]at[)\]}]"), 2).otherwise(3),
        "name": F.when(address & like(m, "[A-Za-z]{2}$"), 1).otherwise(0),
        "digits": number(F.when(four, 5).when(n < 9, 0).when(n < 11, 1).when(n < 13, 2).when(n < 15, 3).when(n < 17, 4).otherwise(5)),
        "groups": number(F.least(F.lit(4), F.size(F.split(F.regexp_replace(plain, "^[^0-9]+", ""), "[^0-9]+")) - 1)),
        "last": number(F.when(four | (tail < 3), 0).when(tail < 4, 1).when(tail < 5, 2).otherwise(3)),
        "joins": number(F.when(joins == "", 0).when(like(joins, r"^\x20+$"), 1).when(like(joins, "^-+$"), 2).when(like(joins, r"^\.+$"), 3).when(like(joins, "[,_/]"), 4).otherwise(5)),
        "lead": number(F.when(like(plain, r"^\+"), 1).when(like(plain, r"^00[\x20-]?[1-9]"), 2).when(like(plain, r"^\(?0?[1-9][0-9]*\)"), 3).otherwise(0)),
        "luhn": number(F.when(n.between(13, 19), luhn(d)).otherwise(F.lit(False)).cast("int")),
        "bytes": number(four.cast("int")),
        "cents": number((like(plain, r"[.,][0-9]{2}$") & ~four).cast("int")),
        "before": F.when(like(before, r"[A-Za-zÀ-ÿ]$"), 1).when(like(before, r"[^\x20\t\n\r(|]$"), 2).otherwise(0),
        "left": left,
        "right": right,
        "cue": F.when(like(before, CUES), F.when(like(before, OTHER_CUES), 3).otherwise(1)).when(like(before, OTHER_CUES), 2).otherwise(0),
    }
    return [values[k].cast("int").alias(k) for k in FEATURES]


def suggested(x: Column) -> Column:
    """The kind that a feature vector suggests."""
    return F.when(x["at"] > 0, "email").when(x["bytes"] == 1, "ip").when((x["digits"] >= 3) & (x["lead"] == 0), "card").otherwise("phone")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's base spans by kind, its addresses, and its stretches of digit groups; both with the text before them."""
    patterns = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "address": ADDRESS, "group": GROUP}
    rows = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    rows = rows.select("id", *[matches("text", p).alias(k) for k, p in patterns.items()])
    always = lambda m: F.lit(True)
    tail = lambda gap: F.right(gap, F.lit(CONTEXT)).alias("before")
    join = lambda gap: F.when(F.regexp_like(gap, F.lit(JOIN)), gap).alias("join")
    rows = rows.select(
        "id", *[placed(k, lambda m, k=k: passes(k, m)).alias(k) for k in KINDS],
        placed("address", always, lambda m, gap: [m.alias("m"), tail(gap), F.lit(0).alias("left"), F.lit(0).alias("right"), F.lit(True).alias("address")]).alias("address"),
        placed("group", always, lambda m, gap: [m.alias("m"), tail(gap), join(gap)]).alias("group"),
    )
    return rows.select("id", *KINDS, "address", F.flatten(F.transform("group", stretches)).alias("number"))


def joined(join: Column) -> Column:
    """How a group is joined to the next: not at all, by a blank among other things, or more closely."""
    return F.when(join.isNull(), 0).when(F.contains(join, F.lit(" ")), 1).otherwise(2)


def stretches(first: Column, i: Column) -> Column:
    """The stretches of joined groups from the i-th on that have LEAST_DIGITS to MOST_DIGITS digits, or four groups. A plus or a bracket before the first group belongs to them."""
    lead = F.regexp_extract(first["before"], r"[+＋]?\(?$", 0)
    start = first["start"] - F.char_length(lead)
    entry = lambda end, m, right: F.struct(
        start.alias("start"), end.alias("end"), m.alias("m"), F.left(first["before"], F.char_length(first["before"]) - F.char_length(lead)).alias("before"), F.when(lead == "", joined(first["join"])).otherwise(0).alias("left"), right.alias("right"), F.lit(False).alias("address"),
    )
    nothing = F.filter(F.array(entry(F.lit(0), F.lit(""), F.lit(0))), lambda x: F.lit(False))
    begin = F.struct(F.lit(0).alias("n"), F.lit("").alias("m"), F.lit(True).alias("open"), F.lit(0).alias("k"), nothing.alias("out"))

    def step(s: Column, x: Column) -> Column:
        n = s["n"] + F.char_length(x["m"])
        whole_m = F.when(s["k"] == 0, F.concat(lead, x["m"])).otherwise(F.concat(s["m"], F.coalesce(x["join"], F.lit("")), x["m"]))
        still = s["open"] & ((s["k"] == 0) | x["join"].isNotNull()) & (n <= MOST_DIGITS)
        further = joined(F.get(F.col("group"), i + s["k"] + 1)["join"])
        out = F.when(still & ((n >= LEAST_DIGITS) | (s["k"] == 3)), F.concat(s["out"], F.array(entry(x["end"], whole_m, further)))).otherwise(s["out"])
        return F.struct(n.alias("n"), whole_m.alias("m"), still.alias("open"), (s["k"] + 1).alias("k"), out.alias("out"))

    alone = (F.char_length(first["m"]) < LEAST_DIGITS) & F.get(F.col("group"), i + 1)["join"].isNull()
    return F.when(alone | (F.char_length(first["m"]) > MOST_DIGITS), nothing).otherwise(F.aggregate(F.slice("group", i + 1, MOST_DIGITS), begin, step, lambda s: s["out"]))


def with_features(x: Column) -> Column:
    return F.struct(*[x[c].alias(c) for c in ("start", "end", "address")], *feature_values(x["m"], x["before"], x["left"], x["right"], x["address"]))


def variants(m: Column, kind: Column) -> Column:
    """Other ways to write a confirmed span."""
    d = digits(m)
    fours = lambda by: F.regexp_replace(d, r"([0-9]{4})(?=[0-9])", f"$1{by}")
    national = F.regexp_replace(m, r"^\+[0-9]{1,3}[\x20.-]*", "")
    groups = F.regexp_replace(F.regexp_replace(m, r"^\+", ""), r"[^0-9]+", " ")
    local = F.regexp_replace(groups, "^[0-9]{1,3} ", "")
    at, dot = lambda by: F.replace(m, F.lit("@"), F.lit(by)), lambda x, by: F.replace(x, F.lit("."), F.lit(by))
    ways = {
        "email": [at(" @ "), at("[at]"), at("(at)"), at(" [at] "), dot(at(" at "), " dot "), dot(at(" (at) "), " (dot) "), dot(at("[at]"), "[.]")],
        "ip": [dot(m, "[.]"), dot(m, "(.)"), F.translate(m, NARROW, WIDE)],
        "card": [fours("."), fours("/"), fours("_"), fours("  "), F.translate(fours(" "), NARROW, WIDE), F.translate(d, NARROW, WIDE)],
        "phone": [national, F.replace(national, F.lit("-"), F.lit(" ")), F.concat(F.lit("00"), groups), groups, local, F.replace(local, F.lit(" "), F.lit("-")), F.replace(local, F.lit(" "), F.lit("")), F.replace(groups, F.lit(" "), F.lit("/")), F.replace(groups, F.lit(" "), F.lit(".")), F.translate(m, NARROW, WIDE)],
    }
    nothing = F.array().cast("array<string>")
    return reduce(lambda rest, k: F.when(kind == k, F.array(*ways[k])).otherwise(rest), KINDS, nothing)


def alike(m: Column, before: Column) -> Column:
    """(m, before, address) of what only looks alike, from the digits of a confirmed span."""
    d = F.concat(digits(m), F.lit("2718281828459"))
    cut = lambda a, n: F.substring(d, a, n)
    join = lambda by, *parts: F.concat_ws(by, *parts)
    number = F.lit(False)
    said = lambda words: F.concat(F.right(before, F.lit(8)), F.lit(" " + words))
    year = F.concat(F.lit("20"), cut(1, 2))
    # A last digit that spoils Luhn's check.
    serial = F.concat(cut(1, 15), F.when(luhn(F.concat(cut(1, 15), F.lit("0"))), "5").otherwise("0"))
    pairs = [
        (join(".", cut(1, 1), cut(2, 2), cut(4, 4)), "version "), (join(".", cut(1, 2), cut(3, 1), cut(4, 2), cut(6, 2)), "v"), (join(".", cut(1, 2), cut(3, 1), cut(4, 2), cut(6, 2)), "version "), (join(".", cut(1, 1), cut(2, 6)), ""),
        (join("-", F.lit("978"), cut(1, 1), cut(2, 3), cut(5, 5), cut(10, 1)), "ISBN "), (join(",", cut(1, 2), cut(3, 3), F.concat(cut(6, 3), F.lit("."), cut(9, 2))), "$"), (join(".", cut(1, 2), cut(3, 3), F.concat(cut(6, 3), F.lit(","), cut(9, 2))), "total "), (join(",", cut(1, 2), cut(3, 3), F.concat(cut(6, 3), F.lit("."), cut(9, 2))), ""),
        (join("-", year, F.lit("07"), cut(3, 2)), ""), (join(".", cut(3, 2), F.lit("07"), year), "since "), (join("/", cut(3, 2), F.lit("07"), year), ""), (join("-", F.lit("1999"), year), ""), (join(",", cut(1, 3), cut(4, 3), cut(7, 3)), ""),
        (serial, ""), (serial, "No. "), (cut(1, 9), "order "), (cut(1, 8), ""), (cut(1, 12), "#"), (join("_", cut(1, 4), cut(5, 4), cut(9, 4)), "id="),
    ]
    made = [F.struct(x.alias("m"), (said(w) if w else before).alias("before"), number.alias("address")) for x, w in pairs]
    made += [F.struct(F.concat(F.lit(w), cut(1, 2), F.lit("."), cut(3, 2)).alias("m"), before.alias("before"), F.lit(True).alias("address")) for w in ("look at ", "open @ ", "noon (at) ")]
    return F.array(*made)


def examples(rows: DataFrame) -> DataFrame:
    """(part, y, sided, unlabelled, f): confirmed spans in other ways of writing, against what looks alike and what touches no base span, which is unlabelled. Part 0 trains, 1 calibrates; sided ones stand for all SIDES."""
    each = rows.select(*KINDS, F.pmod(F.xxhash64("id"), F.lit(2)).alias("part"), F.explode(F.concat("address", "number")).alias("x"))
    at = lambda test, k: test(k, F.col("x.start"), F.col("x.end"))
    confirmed = reduce(lambda rest, k: F.when(at(contains, k), k).otherwise(rest), reversed(KINDS), F.lit(None).cast("string"))
    touching = reduce(lambda a, b: a | b, [at(meets, k) for k in KINDS])
    each = each.select("part", "x", confirmed.alias("kind"), touching.alias("touching"))
    entry = lambda m, before, left, right, address, y, sided: F.struct(m.alias("m"), before.alias("before"), left.alias("left"), right.alias("right"), address.alias("address"), F.lit(y).alias("y"), F.lit(sided).alias("sided"))
    x, zero = F.col("x"), F.lit(0)
    email = F.col("kind") == "email"
    own = F.array(entry(x["m"], x["before"], x["left"], x["right"], x["address"], 0, False))
    ways = variants(x["m"], F.col("kind"))
    yes = F.transform(ways, lambda m: entry(m, x["before"], zero, zero, email, 1, True))
    no = F.transform(alike(x["m"], x["before"]), lambda a: entry(a["m"], a["before"], zero, zero, a["address"], 0, True))
    # A number without its last group is no number.
    last = lambda m: F.when(F.regexp_like(m, F.lit(r"\x20[0-9０-９]+$")), 1).otherwise(2)
    cut_off = F.transform(ways, lambda m: entry(F.regexp_replace(m, LAST_GROUP, ""), x["before"], zero, last(m), email, 0, False))
    cut_off = F.filter(cut_off, lambda e: ~e["address"] & (F.char_length(digits(narrow(e["m"]))) >= LEAST_DIGITS))
    made = F.when(F.col("kind").isNotNull(), F.concat(yes, no, cut_off)).when(~F.col("touching"), own)
    each = each.select("part", F.col("kind").isNull().alias("unlabelled"), F.explode(made).alias("e"))
    return each.select("part", "e.y", (F.col("e.sided") & ~F.col("e.address")).alias("sided"), F.col("unlabelled"), F.struct(*feature_values(F.col("e.m"), F.col("e.before"), F.col("e.left"), F.col("e.right"), F.col("e.address"))).alias("f"))


@dataclass
class Tree:
    """A test 'feature <= value' with the tree for yes and for no, or a leaf's value."""

    feature: str = ""
    at: int = 0
    yes: Tree | None = None
    no: Tree | None = None
    leaf: float = 0.0

    def of(self, table: dict[str, np.ndarray]) -> np.ndarray | float:
        if self.yes is None or self.no is None:
            return self.leaf
        return np.where(table[self.feature] <= self.at, self.yes.of(table), self.no.of(table))

    def column(self, x: Column) -> Column:
        if self.yes is None or self.no is None:
            return F.lit(self.leaf)
        return F.when(x[self.feature] <= self.at, self.yes.column(x)).otherwise(self.no.column(x))


def grow(table: dict[str, np.ndarray], g: np.ndarray, h: np.ndarray, depth: int) -> Tree:
    """The tree of the largest gain in g * g / (h + SMOOTH); a row of the table is a feature vector with its summed g and h."""
    total_g, total_h = float(g.sum()), float(h.sum())
    best, score = None, total_g * total_g / (total_h + SMOOTH) + 1e-6
    for name, values in FEATURES.items() if depth else ():
        left_g, left_h = (np.cumsum(np.bincount(table[name], weights=x, minlength=values))[:-1] for x in (g, h))
        some = np.cumsum(np.bincount(table[name], minlength=values))[:-1]
        gain = left_g**2 / (left_h + SMOOTH) + (total_g - left_g) ** 2 / (total_h - left_h + SMOOTH)
        gain[(some == 0) | (some == len(g))] = -1
        if len(gain) and gain.max() > score:
            best, score = (name, int(gain.argmax())), float(gain.max())
    if best is None:
        return Tree(leaf=-RATE * total_g / (total_h + SMOOTH))
    name, at = best
    yes = table[name] <= at
    return Tree(name, at, *(grow({k: v[side] for k, v in table.items()}, g[side], h[side], depth - 1) for side in (yes, ~yes)))


@dataclass
class Booster:
    bias: float
    trees: list[Tree]
    thresholds: dict[str, float]
    #: (precision, recall) of each kind's threshold on the calibration half.
    measured: dict[str, tuple[float, float]]

    def column(self, x: Column) -> Column:
        return reduce(lambda total, tree: total + tree.column(x), self.trees, F.lit(self.bias))


def boost(table: list[dict]) -> Booster:
    """Trees and thresholds for rows of feature vectors with part, kind, n examples and pos positive ones."""
    columns = {f: np.array([r[f] for r in table], np.int64) for f in FEATURES}
    part, n, y = (np.array([r[k] for r in table], float) for k in ("part", "n", "pos"))
    kind, own = np.array([r["kind"] for r in table], object), part == 0
    if not len(table) or not y[own].sum():
        return Booster(-20.0, [], {}, {})
    rate = (y[own].sum() + 0.5) / (n[own].sum() + 1)
    bias, trees = math.log(rate / (1 - rate)), []
    scores = np.full(len(table), bias)
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(scores, -30, 30)))
        tree = grow({k: v[own] for k, v in columns.items()}, (p * n - y)[own], (p * (1 - p) * n)[own], DEPTH)
        trees.append(tree)
        scores = scores + tree.of(columns)
    scores, thresholds, measured = np.round(scores, 9), {}, {}
    for k in KINDS:
        rows = sorted(((s, a, b) for s, a, b, w, o in zip(scores, n, y, kind, own, strict=True) if w == k and not o), reverse=True)
        seen = right = 0.0
        for i, (score, count, good) in enumerate(rows):
            seen, right = seen + count, right + good
            if score >= 0 and right >= SUPPORT and right >= PRECISION * seen and (i + 1 == len(rows) or rows[i + 1][0] < score):
                thresholds[k] = float(score) - 1e-6
                measured[k] = (float(right / seen), float(right / sum(b for _, _, b in rows)))
    return Booster(bias, trees, thresholds, measured)


def train(rows: DataFrame) -> Booster:
    """From the examples of all rows, folded into counts by feature vector."""
    table = examples(rows).withColumn("kind", suggested(F.col("f"))).groupBy("part", "f", "kind", "y", "sided", "unlabelled").agg(F.count("*").alias("n"))
    table = table.collect()  # as many rows as there are feature vectors
    format_of = lambda f: tuple(v for k, v in f.asDict().items() if k not in AROUND)
    sought = {format_of(r.f) for r in table if r.y}
    found: dict[tuple, list[int]] = {}
    for r in table:
        # What letters or further groups touch is a part of something else.
        if r.unlabelled and r.f.before != 1 and max(r.f.left, r.f.right) < 2 and format_of(r.f) in sought:
            continue
        # A number stands alone or in a list, joined by blanks; what a group joins closely, or a letter, is a part of something else.
        places = [(left, right, r.f.before) for left, right in SIDES] + [(0, 0, 1)] if r.sided else [(r.f.left, r.f.right, r.f.before)]
        for left, right, before in places:
            key = (r.part, r.kind, *{**r.f.asDict(), "left": left, "right": right, "before": before}.values())
            n = found.setdefault(key, [0, 0])
            n[0] += r.n
            n[1] += r.n if r.y and max(left, right) < 2 and not (r.sided and before == 1) else 0
    return boost([{"part": part, "kind": kind, **dict(zip(FEATURES, f, strict=True)), "n": n, "pos": pos} for (part, kind, *f), (n, pos) in sorted(found.items())])


def added_spans(rows: DataFrame, model: Booster) -> DataFrame:
    """rows with new: the candidates beyond their kind's threshold that touch no base span, without those that a better one overlaps."""
    entry = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), suggested(x).alias("kind"), F.round(model.column(x), 9).alias("score"))
    bound = lambda x: reduce(lambda rest, k: F.when(x["kind"] == k, F.lit(model.thresholds[k])).otherwise(rest), model.thresholds, F.lit(None).cast("double"))
    free = lambda x, kinds: ~reduce(lambda a, b: a | b, [meets(k, x["start"], x["end"]) for k in kinds])
    for name in ("address", "number"):
        rows = rows.withColumn(name, F.filter(F.transform(F.transform(F.filter(name, lambda x: free(x, KINDS)), with_features), entry), lambda x: F.coalesce(x["score"] >= bound(x), F.lit(False))))
    # Numbers in a chosen address go; what may overlap a number is near it, because a stretch has at most MOST_DIGITS groups.
    rows = rows.withColumn("number", F.filter("number", lambda x: free(x, ["address"])))
    reach = MOST_DIGITS * (MOST_DIGITS - LEAST_DIGITS + 2)
    better = lambda x, y: F.struct(y["score"], y["end"] - y["start"], -y["start"]) > F.struct(x["score"], x["end"] - x["start"], -x["start"])
    near = lambda i: F.slice("number", F.greatest(F.lit(1), i - reach), F.lit(2 * reach + 1))
    kept = F.filter("number", lambda x, i: ~F.exists(near(i), lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]) & better(x, y)))
    return rows.withColumn("new", F.concat("address", kept))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_email, n_ip, n_card, n_phone, base_sha256 and spans."""
    rows = written(candidates(docs, id_col, text_col), "candidates")
    model = train(rows)
    entry = lambda x, kind: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), kind).cast("int").alias("place"), x["start"].alias("start"), x["end"].alias("end"), kind.alias("kind"))
    own = lambda k: F.transform(k, lambda x: entry(x, F.lit(k)))
    base = F.sort_array(F.concat(*map(own, KINDS)))
    rows = rows.withColumn("base", base)
    more = F.transform("new", lambda x: entry(x, x["kind"])) if model.thresholds else F.slice("base", 1, 0)
    rows = added_spans(rows, model) if model.thresholds else rows
    return rows.select(
        F.col("id").alias(id_col), *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        listed(F.sort_array(F.concat("base", more))).alias("spans"),
    )
