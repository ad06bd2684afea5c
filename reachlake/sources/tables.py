"""Fact tables derived from the driver's star-schema tables: the standing input of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachlake.schema import Facts
from reachlake.storage import merged


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_, size = F.col("p_partkey"), F.col("p_size")
    kinds = F.element_at(F.array(*map(F.lit, ("function", "method", "constructor", "destructor", "function"))), (id_ % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        id_.alias("key"), F.concat(F.lit("sym:"), id_.cast("string")).alias("linkage_name"), F.col("p_name").alias("name"), F.concat("p_brand", F.lit("::"), id_.cast("string")).alias("qualified_name"),
        F.when((id_ % 5).isin(1, 2, 3), F.col("p_type")).otherwise("").alias("class_name"), F.concat(F.lit("void ("), size.cast("string"), F.lit(")")).alias("signature"), kinds.alias("kind"),
        F.when(id_ % 10 == 9, "external_opaque").when(id_ % 10 == 8, "indexed").otherwise("reportable").alias("scope"), ((id_ % 10 != 9) & (id_ % 13 != 0)).alias("defined"), (id_ % 7 == 3).alias("internal_linkage"),
        ((id_ % 5 == 1) & (id_ % 3 == 0)).alias("is_virtual"), F.when(id_ % 17 != 0, F.concat("p_brand", F.lit("/"), F.expr("p_size div 10").cast("string"), F.lit(".cpp"))).alias("file"),
        (1 + id_ * 7 % 900).alias("begin_line"), (1 + id_ * 7 % 900 + size).alias("end_line"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    a = lines.filter("l_quantity >= 49").select("l_orderkey", F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("f"), F.col("l_quantity").alias("q"))
    b = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("ln"), F.col("l_partkey").alias("t"))
    pairs = a.join(merged(b), ["l_orderkey", "ln"]).filter("f <> t").select("f", "t", "q", "ln")
    both = pairs.select("f", "t", "ln").union(pairs.filter("q = 50").select("t", "f", "ln"))
    kind = F.when(F.col("ln") <= 2, "direct_call").when(F.col("ln") == 3, "constructs").when(F.col("ln") == 4, "virtual_dispatch").when(F.col("ln") == 5, "callback_registration").otherwise("provider")
    return both.select(F.col("f").alias("src"), F.col("t").alias("dst"), kind.alias("kind")).distinct()


def roots(own: DataFrame) -> DataFrame:
    kind = F.when(F.col("key") % 194 == 0, "application_entry_point").when(F.col("key") % 194 == 97, "provider").otherwise("public_api")
    return own.filter("key % 97 = 0 or (key % 101 = 5 and scope = 'reportable')").select(F.col("key").alias("symbol"), kind.alias("kind"))


def escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").filter("l_quantity = 1 and l_linenumber = 1 and l_partkey % 4 = 0").select(F.col("l_partkey").alias("symbol")).distinct().withColumn("kind", F.lit("address_taken"))


def facts(spark: SparkSession, sf_dir: str) -> Facts:
    own = symbols(spark, sf_dir)
    return Facts(own, edges(spark, sf_dir), roots(own), escapes(spark, sf_dir), own.filter("key % 19 = 4").select(F.col("key").alias("symbol")))


def diff_pair(spark: SparkSession, sf_dir: str) -> tuple[Facts, Facts]:
    """A baseline and a current run: each loses some symbols and some edges."""
    whole = facts(spark, sf_dir)

    def side(symbol_mod: int, edge_mod: int) -> Facts:
        own = whole.symbols.filter(f"key % {symbol_mod} <> 0")
        alive = f"src % {symbol_mod} <> 0 and dst % {symbol_mod} <> 0"
        return whole.with_(symbols=own, edges=whole.edges.filter(f"(src + dst) % {edge_mod} <> 0 and {alive}"), roots=whole.roots.filter(f"symbol % {symbol_mod} <> 0"))

    return side(29, 7), side(31, 5)


def symbol_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each symbol once per supplier that sells the part, with flags, scopes and places that differ by batch."""
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_suppkey").alias("batch")).distinct()
    rows = symbols(spark, sf_dir).join(pairs, "key")
    n = F.col("key") + F.col("batch")
    return rows.select(
        "key", "batch", F.when(n % 4 == 0, "").otherwise(F.col("name")).alias("name"), F.when(n % 3 == 0, "").otherwise(F.col("qualified_name")).alias("qualified_name"), "kind", "internal_linkage",
        F.when(n % 3 == 0, "reportable").when(n % 3 == 1, "indexed").otherwise("external_opaque").alias("scope"), (n % 2 == 0).alias("defined"), (F.col("is_virtual") & (n % 5 == 0)).alias("is_virtual"),
        F.concat(F.lit("f"), (F.col("batch") % 10).cast("string")).alias("file"), (1 + F.col("batch") % 7).alias("line"),
    )
