"""Symbols of many fact batches merged by key, and set operations over fact tables.

The merge is one aggregation, so its result doesn't depend on the batches' order. Where two batches may differ the preferred one is
the defined one, then that of the wider scope, then that of the first place in the source; flags are united, scopes take the
widest. Where they may not differ the merge finds conflicts, and a run that has any fails.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from reachlake.schema import SCOPES
from reachlake.storage import merged, written

#: Fields that must agree, and those that must agree where they aren't empty.
STRICT, TOLERANT = ("kind", "internal_linkage"), ("qualified_name", "name", "class_name")
STRICT_IDENTITY, TOLERANT_IDENTITY = ("configuration_id", "linkage_name", "translation_unit"), ("usr",)


def scope_rank(scope: Column) -> Column:
    """Reportable is widest."""
    return F.lit(len(SCOPES)) - F.array_position(F.array(*map(F.lit, SCOPES)), scope).cast("int")


def disagree(c: Column) -> Column:
    return F.count_distinct(c) > 1


def merge_conflicts(batches: DataFrame) -> DataFrame:
    """(key, field) of every incompatible field."""
    present = set(batches.columns)
    checks = [(c, F.coalesce(F.col(c).cast("string"), F.lit("\0"))) for c in STRICT if c in present] + [(c, F.nullif(F.col(c), F.lit(""))) for c in TOLERANT if c in present]
    if "identity" in present:
        checks += [(c, F.coalesce(F.col(f"identity.{c}"), F.lit("\0"))) for c in STRICT_IDENTITY] + [(c, F.nullif(F.col(f"identity.{c}"), F.lit(""))) for c in TOLERANT_IDENTITY]
    # A field has conflicts if its smallest and largest values differ; nothing is collected.
    flags = [F.struct(F.lit(name).alias("field"), (F.min(value) != F.max(value)).alias("bad")) for name, value in checks]
    return batches.groupBy("key").agg(F.array(*flags).alias("flags")).select("key", F.inline(F.filter("flags", lambda x: F.coalesce(x["bad"], F.lit(False))))).select("key", "field")


def merge_symbols(batches: DataFrame, place: list[Column]) -> DataFrame:
    """One row per key; place is a symbol's position in the source, as sortable columns, and no file sorts last."""
    rank = scope_rank(F.col("scope"))
    preferred = F.struct(F.when(F.col("defined"), 0).otherwise(1).alias("a"), (-rank).alias("b"), *[c.alias(f"p{i}") for i, c in enumerate(place)])
    fixed = {"key", "defined", "is_virtual", "scope", "identity", *TOLERANT, *STRICT}
    others = [c for c in batches.columns if c not in fixed]
    present = set(batches.columns)
    aggs = [F.bool_or("defined").alias("defined"), F.bool_or("is_virtual").alias("is_virtual"), F.max_by("scope", rank).alias("scope")]
    aggs += [F.min(c).alias(c) for c in STRICT if c in present]
    aggs += [F.coalesce(F.max(F.nullif(F.col(c), F.lit(""))), F.lit("")).alias(c) for c in TOLERANT if c in present]
    if "identity" in present:
        least = lambda c: F.coalesce(F.min(F.nullif(F.col(f"identity.{c}"), F.lit(""))), F.lit("")).alias(c)
        quality = F.when(F.bool_or(F.col("identity.quality") == "stable"), "stable").otherwise("fallback").alias("quality")
        aggs.append(F.struct(quality, *[least(c) for c in (*STRICT_IDENTITY, *TOLERANT_IDENTITY, "fallback_anchor")]).alias("identity"))
    if others:
        aggs.append(F.min_by(F.struct(*others), preferred).alias("chosen"))
    merged = batches.groupBy("key").agg(*aggs)
    return merged.select(*[F.col(f"chosen.{c}").alias(c) if c in others else F.col(c) for c in batches.columns])


def dangling(edges: DataFrame, symbols: DataFrame, ends: tuple[str, ...] = ("src", "dst")) -> DataFrame:
    """Rows of which an end is no symbol; a null end is none."""
    keys = symbols.select("key")
    bad = [edges.filter(F.col(c).isNotNull()).join(merged(keys.withColumnRenamed("key", c)), c, "left_anti").select(*edges.columns) for c in ends]
    out = bad[0]
    for df in bad[1:]:
        out = out.union(df)
    return out.distinct()


def dense_ids(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with name, 0, 1, 2... in the order of columns that identify a row. Ranges of the order are sorted apart; only the ranges' counts, one row per
    partition, come together."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id())
    ranged = written(ranged, "ranges")
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_range", "_first", F.coalesce(before, F.lit(0)).alias("_start"))
    return ranged.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_place") - F.col("_first")).drop("_range", "_place", "_n", "_first", "_start")


def distinct_facts(table: DataFrame) -> DataFrame:
    """Facts are equal if all their columns are, evidence included."""
    return table.dropDuplicates()


def require_empty(violations: DataFrame, message: str) -> None:
    """Fails the run if there are violations, and names the first few."""
    found = violations.limit(5).collect()
    if found:
        raise ValueError(f"{message}: " + "; ".join(", ".join(f"{k}={v}" for k, v in row.asDict().items()) for row in found))
