"""Mixing sources to target weights by iterative proportional fitting. DataFrame functions only.

Documents fold into cells (source, language, topic) with their token counts. The cells' weights are raked: for
each dimension in turn they are scaled so that the weighted tokens of every value meet its target share, until all three
marginals hold within TOLERANCE, or until rounds no longer bring them nearer, which means that no weights meet the targets; the columns
gap (the largest deviation of a marginal from its target, as a share of it) and met say which. Targets are given as shares by value, or are the observed shares to the power
TEMPERATURE, which lowers the large and raises the small. A document's probability is calibrated from its cell's weight: one
factor, found exactly, makes the expected tokens SHARE of all while no probability exceeds 1. A document is
selected if a number from its id's hash lies below its probability, so the sample is the same in every run.

The raking reads cells only. Up to FEW_CELLS of them stand in one partition, where no step needs a shuffle, and are broadcast to
the documents; more are shuffled and joined by key.

Defined cases: null source or language is a value of its own, 'none'. A text without words has no tokens; a cell without any
keeps weight 1 before calibration. A null text is an empty one. Rows that repeat an id are selected together. Values that have a
given target but no tokens are left out and the others' targets scaled up; values without a given target get
none, so their documents are not selected. An empty table gives an empty result. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reachlake.llm.common import whole, words, written

DIMENSIONS = ("source", "lang", "topic")
TEMPERATURE = {"source": 0.5, "lang": 0.5, "topic": 0.7}
SHARE = 0.5
TOLERANCE, AT_ONCE = 1e-3, 4
#: Targets count as out of reach when AT_ONCE rounds bring the gap down by less than this share of it.
LEAST_GAIN = 1e-4
FEW_CELLS = 200_000


def topic_of(text: Column, n: Column) -> Column:
    """The form of a text, where a table has no topic of its own."""
    chars = F.greatest(F.lit(1), F.char_length(text))
    bars = F.char_length(text) - F.char_length(F.translate(text, "|", ""))
    digits = F.char_length(text) - F.char_length(F.translate(text, "0123456789", ""))
    return F.when(20 * bars > n, "table").when(50 * digits > chars, "numbers").when(n < 100, "note").when(n < 1000, "article").otherwise("book")


def with_cells(docs: DataFrame, columns: list[str], text_col: str = "text") -> DataFrame:
    """These columns of docs as a struct doc, with their cell and tokens. It is written, so texts are cut into words once."""
    n = F.size(words(whole(text_col))).cast("long")
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none")) if c in docs.columns else F.lit("none")
    topic = value("topic") if "topic" in docs.columns else topic_of(whole(text_col), F.col("n_tokens"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc"), n.alias("n_tokens"), value("source").alias("source"), value("lang").alias("lang"), whole(text_col).alias("text"), *([F.col("topic")] if "topic" in docs.columns else []))
    return written(rows.select("doc", "n_tokens", "source", "lang", topic.alias("topic")), "celled")


def targets(cells: DataFrame, given: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """cells with t_<dimension>, the target share of each cell's value; they sum to 1 over the values that have tokens."""
    for d in DIMENSIONS:
        own = Window.partitionBy(d)
        tokens = F.sum("tokens").over(own).cast("double")
        shares = (given or {}).get(d)
        if shares is None:
            raw = F.pow(tokens, F.lit(TEMPERATURE[d]))
        else:
            raw = F.lit(0.0)
            for name, share in sorted(shares.items()):
                raw = F.when(F.col(d) == name, float(share)).otherwise(raw)
        cells = cells.withColumn("raw", F.when(tokens > 0, raw).otherwise(0.0)).withColumn("nth", F.row_number().over(own.orderBy(*DIMENSIONS)))
        whole_sum = cells.filter("nth = 1").agg(F.sum("raw")).first()[0] or 1.0
        cells = cells.withColumn(f"t_{d}", F.col("raw") / F.lit(float(whole_sum))).drop("raw", "nth")
    return cells


def rake(cells: DataFrame) -> tuple[DataFrame, float]:
    """cells with weight, the factors of iterative proportional fitting to the targets t_<dimension>, and the largest deviation that is left."""
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    cells, gap = cells.withColumn("weight", F.lit(1.0)), float("inf")
    while True:
        for _ in range(AT_ONCE):
            for d in DIMENSIONS:
                now = F.sum(F.col("tokens") * F.col("weight")).over(Window.partitionBy(d))
                cells = cells.withColumn("now", now).withColumn("weight", F.when(F.col("now") > 0, F.col("weight") * F.col(f"t_{d}") * total / F.col("now")).otherwise(F.col("weight"))).drop("now")
        cells, before = written(cells, "cells"), gap
        sums = cells
        for d in DIMENSIONS:
            sums = sums.withColumn(f"m_{d}", F.sum(F.col("tokens") * F.col("weight")).over(Window.partitionBy(d)))
        # A value whose target is nothing is met as soon as it has been scaled.
        off = [F.max(F.when(F.col(f"t_{d}") > 0, F.abs(F.col(f"m_{d}") / (F.col(f"t_{d}") * total) - 1)).otherwise(0.0)) for d in DIMENSIONS]
        gap = sums.filter("tokens > 0").agg(F.greatest(*off)).first()[0] or 0.0
        if gap <= TOLERANCE or gap > before * (1 - LEAST_GAIN):
            return cells, gap


def calibrate(cells: DataFrame, share: float) -> DataFrame:
    """cells with probability = min(1, factor * weight), whose expected tokens are share of all (or all that have weight)."""
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    factor, capped = 0.0, -1
    while True:
        full = F.col("weight") * factor >= 1
        count, fixed, loose = cells.filter("tokens > 0").agg(F.count_if(full), F.sum(F.when(full, F.col("tokens")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("tokens") * F.col("weight")))).first()
        if count == capped:
            break
        capped = count
        factor = max(0.0, share * total - (fixed or 0)) / loose if loose else factor
    return cells.withColumn("probability", F.least(F.lit(1.0), F.col("weight") * factor))


def mix(docs: DataFrame, columns: list[str], given: dict[str, dict[str, float]] | None = None, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs, with these columns as a struct doc, and cell, n_tokens, weight, probability, selected, gap and met."""
    rows = with_cells(docs, columns, text_col)
    cells = written(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents")), "cells")
    few = cells.count() <= FEW_CELLS
    raked, gap = rake(targets(cells.coalesce(1) if few else cells, given))
    cells = calibrate(raked, share).select(*DIMENSIONS, "weight", "probability")
    rows = rows.join(F.broadcast(cells) if few else cells, list(DIMENSIONS))
    # 53 bits of the hash, as a number from 0 to 1.
    draw = F.shiftrightunsigned(F.xxhash64(F.col(f"doc.`{id_col}`"), F.lit("mix")), 11).cast("double") / float(1 << 53)
    return rows.withColumn("selected", draw < F.col("probability")).withColumn("gap", F.lit(float(gap))).withColumn("met", F.lit(gap <= TOLERANCE))


def mixed_weights(docs: DataFrame, given: dict[str, dict[str, float]] | None = None, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, source, lang, topic, n_tokens, weight, probability, selected, gap and met."""
    return mix(docs, [id_col], given, share, id_col, text_col).select(F.col(f"doc.`{id_col}`").alias(id_col), *DIMENSIONS, "n_tokens", "weight", "probability", "selected", "gap", "met")


def sample_mixture(docs: DataFrame, given: dict[str, dict[str, float]] | None = None, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The selected rows of docs."""
    return mix(docs, docs.columns, given, share, id_col, text_col).filter("selected").select("doc.*")
