"""Reachability from roots, as a frontier loop over DataFrames.

Full reachability follows every edge whose source has an indexed body; structural reachability leaves out what providers
and registrations add. Both run in one loop: a row's `structural` says which kind of path reached it, and
a symbol comes back to the frontier only when it is new or has become structural. A job takes HOPS hops, so
long chains need few jobs; what a job finds is written beside the earlier finds, which are the visited set and become one table now and then.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachlake.schema import EDGE_KINDS, INDEXED_BODIES, PROVIDED, Facts
from reachlake.storage import merged, new_path, written

HOPS = 4
#: Tables of the visited set from which they are made one, so a turn doesn't read all earlier ones.
MOST_PARTS = 8


def adjacency(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, structural) of the edges that can be followed."""
    bodies = symbols.filter(F.col("scope").isin(*INDEXED_BODIES)).select(F.col("key").alias("src"))
    usable = edges.filter(F.col("kind").isin(*EDGE_KINDS)).select("src", "dst", (~F.col("kind").isin(*PROVIDED)).alias("structural"))
    return usable.join(merged(bodies), "src", "left_semi").groupBy("src", "dst").agg(F.max("structural").alias("structural"))


def best(found: DataFrame) -> DataFrame:
    return found.groupBy("key").agg(F.max("structural").alias("structural"))


def reach(facts: Facts) -> DataFrame:
    """(key, structural) of every reachable symbol; a root is reachable whatever its scope."""
    spark = facts.symbols.sparkSession
    edges = written(adjacency(facts.symbols, facts.edges), "adjacency")
    base = new_path(spark, "reach")
    frontier = best(facts.roots.select(F.col("symbol").alias("key"), (~F.col("kind").isin(*PROVIDED)).alias("structural")))
    schema, turn = frontier.schema, 0
    frontier.write.parquet(f"{base}/turn={turn}")
    parts = [f"{base}/turn={turn}"]
    while True:
        frontier = spark.read.schema(schema).parquet(f"{base}/turn={turn}")
        steps = [frontier]
        for _ in range(HOPS):
            last = steps[-1]
            steps.append(best(edges.join(merged(last.withColumnsRenamed({"key": "src", "structural": "so_far"})), "src").select(F.col("dst").alias("key"), (F.col("structural") & F.col("so_far")).alias("structural"))))
        visited = best(spark.read.schema(schema).parquet(*parts)).withColumnRenamed("structural", "known")
        found = best(reduce(DataFrame.unionAll, steps[1:])).join(merged(visited), "key", "left").filter("known is null or (structural and not known)").select("key", "structural")
        turn += 1
        found.write.parquet(f"{base}/turn={turn}")
        if spark.read.schema(schema).parquet(f"{base}/turn={turn}").isEmpty():
            return best(spark.read.schema(schema).parquet(*parts))
        parts.append(f"{base}/turn={turn}")
        if len(parts) > MOST_PARTS:
            best(spark.read.schema(schema).parquet(*parts)).write.parquet(f"{base}/visited={turn}")
            parts = [f"{base}/visited={turn}"]


def with_reach(facts: Facts, found: DataFrame | None = None) -> DataFrame:
    """The symbols with reachable, structurally_reachable and provider_reachable; found is what reach gave for them, if that is known."""
    got = reach(facts) if found is None else found
    joined = facts.symbols.join(merged(got), "key", "left")
    return joined.withColumn("reachable", F.col("structural").isNotNull()).withColumn("structurally_reachable", F.coalesce("structural", F.lit(False))).withColumn("provider_reachable", F.coalesce(~F.col("structural"), F.lit(False))).drop("structural")


def eligible(symbols: DataFrame) -> DataFrame:
    """Definitions of the project itself that reports and comparisons are about."""
    return symbols.filter("defined and scope = 'reportable' and kind <> 'synthetic'")


def unreachable(reached: DataFrame) -> DataFrame:
    """The candidates for a finding."""
    return eligible(reached).filter("not reachable")
