"""Secret scans: fixed patterns, and strings of high entropy. DataFrame functions only.

Base kinds are assign (a password-like name, a sign and 12 or more characters), access (an access key id) and hex (16 or more
hexadecimal digits). The method adds kind entropy: candidates are runs of 20 or more characters of the base-64 alphabet with a letter
and a digit. A window of WINDOW characters slides over a candidate; its Shannon entropy comes from the counts of its
characters, changed by the one that enters and the one that leaves, so a candidate costs time in proportion to its length. A candidate whose highest window reaches the
bound of its character class (hex, alphanumeric, base 64) is a span, unless it overlaps a base span or the allow-list
knows it. The allow-list never takes a base span away.

Defined cases: a null or empty text has no spans, and the digest of the empty list. Rows that repeat stay rows. An empty table
gives an empty result. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachlake.llm.common import whole
from reachlake.llm.spans import listed, matches, meets, placed

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The part before group 2, to measure it by.
ASSIGN_HEAD = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"[0-9a-f]{16,}+"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}+"
WINDOW = 20
#: Windows handled at a time, which bounds the memory that a very long candidate takes.
PIECE = 4096
#: Bits of a packed count (it is WINDOW at most), and numbers that hold the counts of the whole alphabet.
BITS, WORDS = 5, 6
#: Sums are whole multiples of 1 / UNIT, so taking away what was added leaves no rounding error.
UNIT = 1 << 40
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Bits per character from which a window of each character class is suspicious; 20 characters have 4.32 at most.
BOUNDS = {"hex": 3.0, "alphanumeric": 3.6, "base64": 3.8}
#: Candidates that are known to be no secrets: UUIDs, runs of the alphabet or of the digits, paths and dashed words, and marked examples.
ALLOW = (
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"(?i)abcdefghij|0123456789|1234567890|qwertyuiop",
    r"^[A-Za-z]*+(?:[/_=-][A-Za-z]*+|[/_=-][0-9]{1,4}+(?![A-Za-z0-9]))++$",
    r"(?i)example|placeholder|changeme|dummy",
)


def pieces(candidate: Column) -> Column:
    """The candidate (binary) in pieces of PIECE windows; every window lies in one."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.octet_length(candidate) - WINDOW), F.lit(PIECE))
    return F.transform(starts, lambda i: F.substring(candidate, i + 1, F.lit(PIECE + WINDOW - 1)).cast("string"))


def least_sum(piece: Column) -> Column:
    """The smallest sum of count * log2(count) of any window of the piece, as a multiple of 1 / UNIT; that window has the highest entropy.

    The counts of the window's characters are BITS wide and packed in WORDS numbers. Each step adds one to the count of the character
    that enters, takes one from that of the character that leaves, and changes the sum by what these two entries change.
    """
    places = F.transform(F.split(piece, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    zipped = F.arrays_zip(places.alias("enters"), F.concat(F.array_repeat(F.lit(-1), WINDOW), places).alias("leaves"))
    per = 60 // BITS
    one = lambda p: F.when(p >= 0, F.call_function("shiftleft", F.lit(1).cast("long"), (p % per * BITS).cast("int"))).otherwise(F.lit(0).cast("long"))
    # What a character does is worked out once: its word (none: -1), its shift, and a one in its place.
    part = lambda p: F.struct(F.when(p >= 0, F.floor(p / per).cast("int")).otherwise(-1).alias("word"), (p % per * BITS).cast("int").alias("shift"), one(p).alias("one"))
    steps = F.transform(F.filter(zipped, lambda x: x["enters"].isNotNull()), lambda x, i: F.struct(part(x["enters"]).alias("enters"), part(x["leaves"]).alias("leaves"), (x["enters"] == x["leaves"]).alias("same"), (i >= WINDOW).alias("full")))
    table = lambda f: F.array(*[F.lit(round(f(c) * UNIT)).cast("long") for c in range(WINDOW + 1)])
    c_log_c = lambda c: c * math.log2(c) if c > 1 else 0.0
    value = {c: round(c_log_c(c) * UNIT) / UNIT for c in range(WINDOW + 2)}
    gains, losses = table(lambda c: value[c + 1] - value[c]), table(lambda c: value[c - 1] - value[c] if c else 0.0)

    def count(s: Column, x: Column) -> Column:
        word = F.lit(0).cast("long")
        for k in range(WORDS):
            word = F.when(x["word"] == k, s[f"w{k}"]).otherwise(word)
        return F.call_function("shiftright", word, x["shift"]).bitwiseAND(F.lit((1 << BITS) - 1).cast("long")).cast("int")

    def step(s: Column, x: Column) -> Column:
        enters, leaves = x["enters"], x["leaves"]
        change = F.when(x["same"], F.lit(0).cast("long")).otherwise(F.get(gains, count(s, enters)) + F.get(losses, count(s, leaves)))
        words = [(s[f"w{k}"] + F.when(enters["word"] == k, enters["one"]).otherwise(0) - F.when(leaves["word"] == k, leaves["one"]).otherwise(0)).alias(f"w{k}") for k in range(WORDS)]
        # The sum of the window before this step, if that was a whole one.
        return F.struct(*words, (s["sum"] + change).alias("sum"), F.when(x["full"], F.least(s["least"], s["sum"])).otherwise(s["least"]).alias("least"))

    zero = F.lit(0).cast("long")
    start = F.struct(*[zero.alias(f"w{k}") for k in range(WORDS)], zero.alias("sum"), F.lit(1 << 62).cast("long").alias("least"))
    return F.aggregate(steps, start, step, lambda s: F.least(s["least"], s["sum"]))


def highest_entropy(candidate: Column) -> Column:
    """The highest Shannon entropy, in bits per character, of any window of the candidate (binary, WINDOW characters or more)."""
    least = F.array_min(F.transform(pieces(candidate), least_sum))
    return F.lit(math.log2(WINDOW)) - least / F.lit(float(UNIT * WINDOW))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_assign, n_access, n_hex, base_sha256 and spans."""
    rows = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    rows = rows.select("id", *[matches("text", p).alias(k) for k, p in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("entropy", CANDIDATE))])
    long_enough = lambda m: F.char_length(F.regexp_replace(m, ASSIGN_HEAD, "")) >= 12
    suspect = lambda m: F.regexp_like(m, F.lit("[0-9]")) & F.regexp_like(m, F.lit("[A-Za-z]")) & ~F.regexp_like(m, F.lit("|".join(f"(?:{x})" for x in ALLOW)))
    always = lambda m: F.lit(True)
    rows = rows.select("id", placed("assign", long_enough).alias("assign"), placed("access", always).alias("access"), placed("hex", always).alias("hex"), placed("entropy", suspect, lambda m, gap: [m.cast("binary").alias("m"), m.alias("text")]).alias("entropy"))
    kind = lambda name: F.transform(name, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(name)).alias("place"), x["end"].alias("end"), F.lit(name).alias("kind")))
    rows = rows.withColumn("base", F.sort_array(F.concat(kind("assign"), kind("access"), kind("hex"))))
    free = lambda x: reduce(lambda a, b: a & b, [~meets(k, x["start"], x["end"]) for k in KINDS[:3]])
    rows = rows.withColumn("entropy", F.filter("entropy", free))
    bound = lambda m: F.when(F.regexp_like(m, F.lit("^[0-9A-Fa-f]+$")), BOUNDS["hex"]).when(F.regexp_like(m, F.lit("^[A-Za-z0-9]+$")), BOUNDS["alphanumeric"]).otherwise(BOUNDS["base64"])
    rows = rows.withColumn("entropy", F.filter("entropy", lambda x: highest_entropy(x["m"]) >= bound(x["text"])))
    return rows.select(
        F.col("id").alias(id_col), *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]], F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        listed(F.sort_array(F.concat(F.col("base"), kind("entropy")))).alias("spans"),
    )
