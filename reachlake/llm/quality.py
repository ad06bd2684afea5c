"""Quality rules whose cutoffs carry a guarantee: risk-controlled thresholds. DataFrame functions only.

Rules reject a document if a feature lies above a cutoff. Labelled documents of good quality are the holdout: nothing else is
learnt from them. For each stratum (language) and rule the good documents that a cutoff would reject are
counted, and the cutoff is certified if the exact binomial probability of so few false rejections among
so many good documents would be at most DELTA / (strata x rules) at a true rate of RISK / rules. The lowest
certified cutoff of the grid is taken. Cutoffs of one rule are nested, so they are tested from the highest down until the first
failure and need no further correction; rules and strata are corrected by Bonferroni. So with
probability 1 - DELTA no stratum loses more than RISK of its good documents to the rules. A stratum with too few good
documents certifies nothing and keeps all that the base keeps.

Features come from one pass over the whole texts and are written, because both the thresholds and the verdict read them;
thresholds are strata x rules rows and are joined by stratum. The grid has fixed values, so the counts that the search needs
are strata x rules x cutoffs rows, whatever the input.

Defined cases: a null text has no words, and base_failed holds for it. A null language is a stratum of its own. Labels that are
null are no holdout; a document with repeated labels counts as good if its lowest is. With no labels the verdict is the base's. Rows
that repeat an id stay rows. An empty table gives an empty result. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachlake.llm.common import SPACE, whole, words, written

SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Bits for a word's place in its text beside its window's hash.
PLACE_BITS = 24
RISK, DELTA = 0.02, 0.05
#: Cutoffs, as shares of the rule's whole.
GRID = [i / 50 for i in range(1, 51)]
#: The rules' features: symbols to word characters, repeated lines to lines, words in repeated windows to words, and the mean word length above 5, to 20.
RULES = ("symbols", "dup_lines", "repeats", "long_words")


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The base figures of each row, over its whole text."""
    text = whole(text_col)
    stratum = F.coalesce(F.col(stratum_col), F.lit("")) if stratum_col in docs.columns else F.lit("")
    rows = docs.select(
        F.col(id_col).alias("id"), stratum.alias("stratum"), words(text).alias("w"), F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\u000b\f\r")) != "").alias("lines"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"), F.char_length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
    )
    n = F.size("w")
    # A window's hash above its place, so that one sort of plain numbers makes windows that may be equal neighbours. Texts
    # beyond PLACES words have no room for the place and take all their windows as candidates.
    hashed = F.transform("w", lambda x, i: F.shiftleft(F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)), PLACE_BITS).bitwiseOR(i.cast("long")))
    none = F.array().cast("array<bigint>")
    rows = rows.select(
        "id", "stratum", "w", n.cast("long").alias("n_words"), "word_chars", "n_symbols", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(n < 3, none).when(n > 1 << PLACE_BITS, F.sequence(F.lit(0).cast("long"), n.cast("long") - 3)).otherwise(F.sort_array(F.slice(hashed, F.lit(1), n - 2))).alias("h"),
    )
    near = F.filter("h", lambda x, i: ((i > 0) & (F.shiftright(F.get("h", i - 1), PLACE_BITS) == F.shiftright(x, PLACE_BITS))) | F.coalesce(F.shiftright(F.get("h", i + 1), PLACE_BITS) == F.shiftright(x, PLACE_BITS), F.lit(False)))
    rows = rows.withColumn("h", F.when(F.col("n_words") > 1 << PLACE_BITS, F.col("h")).otherwise(F.transform(near, lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1).cast("long")))))
    # The words decide: candidates sorted by their three words, which hold no line feed, and place.
    window = lambda i: F.concat_ws("\n", F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))
    placed = F.sort_array(F.transform("h", lambda x: F.struct(window(x.cast("int")).alias("v"), x.cast("int").alias("i"))))
    rows = rows.withColumn("h", F.when(F.size("h") > 0, placed)).drop("w")
    twice = F.filter("h", lambda x, i: ((i > 0) & (F.get("h", i - 1)["v"] == x["v"])) | F.coalesce(F.get("h", i + 1)["v"] == x["v"], F.lit(False)))
    covered = F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    rows = rows.withColumn("n_repeat_words", F.when(F.col("h").isNull(), 0).otherwise(covered).cast("long")).drop("h")
    return rows.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def rule_values() -> Column:
    """(rule, value) of each rule, values from 0 to 1."""
    share = lambda a, b: F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0)))
    length = F.coalesce(F.try_divide(F.col("word_chars").cast("double"), F.col("n_words").cast("double")), F.lit(0.0))
    values = [share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (length - 5) / 20))]
    return F.array(*[F.struct(F.lit(r).alias("rule"), v.alias("value")) for r, v in zip(RULES, values, strict=True)])


def allowed(n: Column, rate: float, level: Column) -> Column:
    """The most false rejections k among n for which P(Binomial(n, rate) <= k) <= level, or -1: exact terms, summed from 0 up by
    their ratios and kept as logarithms, because the first underflows."""
    # Beyond the mean the probability exceeds any level of use here, so the sum ends there.
    start = F.struct(F.lit(0).cast("long").alias("k"), (n * F.log1p(F.lit(-rate))).alias("term"), F.lit(None).cast("double").alias("total"), F.lit(-1).cast("long").alias("found"))

    def step(s: Column, k: Column) -> Column:
        term = F.when(k == 0, s["term"]).otherwise(s["term"] + F.log((n - k + 1).cast("double") / k) + F.log(F.lit(rate / (1 - rate))))
        total = F.when(s["total"].isNull(), term).otherwise(F.greatest(s["total"], term) + F.log1p(F.exp(-F.abs(s["total"] - term))))
        return F.struct(k.alias("k"), term.alias("term"), total.alias("total"), F.when((total <= F.log(level)) & (s["found"] == k - 1), k).otherwise(s["found"]).alias("found"))

    return F.aggregate(F.sequence(F.lit(0).cast("long"), F.ceil(n * rate).cast("long")), start, step, lambda s: s["found"])


def certified(rows: DataFrame, marks: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff): the lowest certified cutoff of each stratum and rule; rows are features()."""
    good = marks.filter("quality is not null").groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("quality")).filter("quality = 1")
    held = rows.filter("not base_failed").join(good.select("id"), "id", "left_semi").select("stratum", F.explode(rule_values()).alias("x"))
    bins = F.array(*[F.lit(x) for x in GRID])
    # How many cutoffs a value exceeds: it is rejected by those.
    counts = held.groupBy("stratum", "x.rule", F.size(F.filter(bins, lambda c: F.col("x.value") > c)).alias("above")).agg(F.count("*").alias("n"))
    by_rule = counts.groupBy("stratum", "rule").agg(F.sum("n").alias("n"), F.collect_list(F.struct("above", "n")).alias("bins"))
    strata = by_rule.agg(F.count_distinct("stratum").alias("strata"))
    by_rule = by_rule.crossJoin(F.broadcast(strata))  # one row
    by_rule = by_rule.withColumn("most", allowed(F.col("n"), risk / len(RULES), delta / (F.col("strata") * len(RULES))))
    rejected = lambda i: F.aggregate(F.filter("bins", lambda b: b["above"] > i), F.lit(0).cast("long"), lambda s, b: s + b["n"])
    passing = F.filter(F.sequence(F.lit(0), F.lit(len(GRID) - 1)), lambda i: rejected(i) <= F.col("most"))
    return by_rule.select("stratum", "rule", F.get(bins, F.array_min(passing)).alias("cutoff")).filter("cutoff is not null")


def quality_verdicts(docs: DataFrame, marks: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """One row per row of docs: id, the base figures, base_failed, kept and the rules that reject it."""
    rows = written(features(docs, id_col, text_col, stratum_col), "features")
    cutoffs = certified(rows, marks).groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))
    rows = rows.join(cutoffs, "stratum", "left")
    broken = F.filter(rule_values(), lambda x: F.coalesce(x["value"] > F.element_at(F.col("cutoffs"), x["rule"]), F.lit(False)))
    rows = rows.withColumn("rejected_by", F.coalesce(F.array_join(F.transform(broken, lambda x: x["rule"]), ","), F.lit("")))
    return rows.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("rejected_by") == "")).alias("kept"), "rejected_by")
