"""The units of a run: which dumps it needs, which are there, and their nodes, walked anew only where the fact store has none from the same bytes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reachlake.sources import ast
from reachlake.sources.ast import ast_nodes
from reachlake.sources.strict import whole_files
from reachlake.storage import written
from reachlake.streaming.store import FactStore, tool_fingerprint

#: A dependency of every unit: the code that walks dumps.
TOOL = "tool:ast"


@dataclass
class Units:
    """nodes of all units; table has file and status of each; the counts say how many were walked and how many came from the store."""

    nodes: DataFrame
    table: DataFrame
    walked: int
    reused: int
    input_bytes: int


def unit_of(path: str, root: str) -> Column:
    """A dump's unit: its path without .json, below the folder of dumps if one is given."""
    plain = F.regexp_replace(F.regexp_replace(F.col(path), "^file:/+", "/"), r"\.json$", "")
    bare = root.removeprefix("file:").rstrip("/")
    return F.when(F.startswith(plain, F.lit(bare + "/")), F.substr(plain, F.lit(len(bare) + 1))).otherwise(plain) if root else plain


def found_dumps(spark: SparkSession, paths: list[str], root: str = "") -> DataFrame:
    """(unit, path, size, digest) of the dumps at paths, or of all below the folder of dumps."""
    files = spark.read.format("binaryFile")
    files = files.load(sorted(set(paths))) if paths else files.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(root)
    return written(files.select(unit_of("path", root).alias("unit"), "path", F.col("length").alias("size"), F.sha2("content", 256).alias("digest")), "dumps")


def read_units(spark: SparkSession, paths: list[str], root: str = "", wanted: DataFrame | None = None, directory: str = "/", cache: str = "") -> Units:
    """The units of the dumps; wanted (file) names those of a selection, and one without a dump is not indexed. cache is the folder of a fact store."""
    dumps = found_dumps(spark, paths, root)
    table = dumps.select(F.col("unit").alias("file"), F.lit("indexed").alias("status"))
    if wanted is not None:
        asked = wanted.select("file").distinct()
        dumps = written(dumps.join(asked.withColumnRenamed("file", "unit"), "unit", "left_semi"), "dumps")
        table = asked.join(dumps.select(F.col("unit").alias("file"), F.lit("indexed").alias("status")), "file", "left").select("file", F.coalesce("status", F.lit("failed")).alias("status"))
    total, size = dumps.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()

    def walk(rows: DataFrame) -> DataFrame:
        files = [r.path for r in rows.select("path").toLocalIterator()]
        texts = whole_files(spark, *files).select(unit_of("path", root).alias("unit"), "text") if files else spark.createDataFrame([], "unit string, text string")
        return ast_nodes(texts, directory)

    if not cache:
        return Units(walk(dumps), table, total, 0, size)
    store, tool = FactStore(spark, cache), tool_fingerprint(ast)
    current = dumps.select("path", "digest").union(spark.createDataFrame([(TOOL, tool)], "path string, digest string"))
    valid = store.valid_units(current)
    stale = dumps if valid is None else written(dumps.join(valid, "unit", "left_anti"), "stale")
    walked = stale.count()
    if walked:
        own = stale.select("unit", "path", "digest", F.lit(True).alias("is_primary"))
        tools = stale.select("unit", F.lit(TOOL).alias("path"), F.lit(tool).alias("digest"), F.lit(False).alias("is_primary"))
        store.publish({"nodes": walk(stale)}, own.union(tools))
    return Units(store.table("nodes").drop("run").join(dumps.select("unit"), "unit", "left_semi"), table, walked, total - walked, size)
