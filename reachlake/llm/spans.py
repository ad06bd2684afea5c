"""Places of regular-expression matches as DataFrame expressions: code points, end exclusive, leftmost and non-overlapping.

Patterns here are written so that the JVM's matcher needs neither deep recursion nor quadratic time on very long
runs: quantified groups are possessive where nothing follows that could take back, and a run that a match may start in is
entered at its beginning or where the last match ended.

Lists of matches are folded in blocks of BLOCK, because a fold that appends copies what it has: a text with a hundred
thousand matches costs a few hundred short folds and not one of quadratic length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How much of the text before a match is kept as its context.
CONTEXT = 24
#: Matches folded together.
BLOCK = 256
#: Steps of a search among the spans of one list, from the largest that an array can hold.
STEPS = [1 << i for i in range(30, -1, -1)]


def matches(text: str, pattern: str) -> Column:
    """Each match m with the text between it and the one before, and a last gap without a match; null if there is none."""
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    return F.when(F.regexp_like(F.col(text), F.lit(pattern)), F.arrays_zip(found.alias("m"), F.split(F.col(text), pattern, -1).alias("gap")))


def placed(found: str, passes: Callable[[Column], Column], extra: Callable[[Column, Column], list[Column]] = lambda m, gap: []) -> Column:
    """array<struct<start, end, ...extra>> of those matches(...) that pass, in order."""
    zero = F.lit(0).cast("int")
    entry = lambda start, end, x: F.struct(start.alias("start"), end.alias("end"), *extra(x["m"], x["gap"]))
    sample = entry(zero, zero, F.struct(F.lit("").alias("m"), F.lit("").alias("gap")))
    nothing = F.filter(F.array(sample), lambda x: F.lit(False))
    length = lambda x: F.char_length(x["gap"]) + F.coalesce(F.char_length(x["m"]), F.lit(0))

    # Blocks with their lengths, then where each block begins.
    starts = F.sequence(F.lit(1), F.size(found), F.lit(BLOCK))
    lengths = F.transform(starts, lambda i: F.aggregate(F.slice(found, i, BLOCK), zero, lambda s, x: s + length(x)))
    begin = F.struct(zero.alias("at"), F.array().cast("array<int>").alias("out"))
    begins = F.aggregate(lengths, begin, lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.char_length(x["gap"])
        end = start + F.char_length(x["m"])
        # One more gap than matches: the last entry has no match.
        keep = x["m"].isNotNull() & F.coalesce(passes(x["m"]), F.lit(False))
        return F.struct((state["at"] + length(x)).alias("at"), F.when(keep, F.concat(state["out"], F.array(entry(start, end, x)))).otherwise(state["out"]).alias("out"))

    block = lambda i, at: F.aggregate(F.slice(found, i, BLOCK), F.struct(at.alias("at"), nothing.alias("out")), step, lambda s: s["out"])
    return F.when(F.col(found).isNull(), nothing).otherwise(F.flatten(F.zip_with(starts, begins, block)))


def listed(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat(x["kind"], F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))), ",")


def last_before(spans: str, end: Column) -> Column:
    """Of a column of spans that are in order and don't overlap each other, the last that starts before end, or null: a search by halves."""
    own = F.col(spans)
    before = F.aggregate(F.array(*map(F.lit, STEPS)), F.lit(0), lambda n, step: F.when((n + step <= F.size(own)) & (F.get(own, n + step - 1)["start"] < end), n + step).otherwise(n))
    return F.when(F.size(own) > 0, F.get(own, before - 1))


def meets(spans: str, start: Column, end: Column) -> Column:
    """Whether [start, end) overlaps one of the spans; that is the last that starts before end, because it reaches furthest."""
    return F.coalesce(last_before(spans, end)["end"] > start, F.lit(False))


def contains(spans: str, start: Column, end: Column) -> Column:
    """Whether [start, end) is one of the spans."""
    return F.coalesce(F.exists(F.array(last_before(spans, end)), lambda x: (x["start"] == start) & (x["end"] == end)), F.lit(False))
