"""Build targets: link closure, selection, and which command compiles which source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachlake.storage import written

LIBRARIES = ("static_library", "interface_library")


def target_closure(dependencies: DataFrame, start: DataFrame) -> DataFrame:
    """(target) reachable from start (target) along dependencies (target, dependency), start included."""
    known = written(start.select("target").distinct(), "targets")
    frontier = known
    while True:
        step = dependencies.join(frontier, "target").select(F.col("dependency").alias("target")).distinct().join(known, "target", "left_anti")
        frontier = written(step, "targets")
        if frontier.isEmpty():
            return known
        known = written(known.union(frontier), "targets")


def select_configuration(targets: DataFrame, name: str = "") -> str:
    """The named configuration, or the only one."""
    if name:
        if targets.filter(F.col("configuration") == name).isEmpty():
            raise ValueError(f"unknown configuration {name!r}")
        return name
    names = targets.select("configuration").distinct()
    first = names.limit(2).collect()
    if len(first) != 1:
        raise ValueError(f"{names.count()} configurations; one must be named")
    return first[0][0]


def select_target(targets: DataFrame, configuration: str, name: str = "") -> str:
    """The id of the named target, or of the only executable."""
    rows = targets.filter(F.col("configuration") == configuration)
    found = rows.filter(F.col("name") == name) if name else rows.filter("kind = 'executable'")
    ids = [r[0] for r in found.select("id").distinct().limit(2).collect()]
    if not ids:
        raise ValueError(f"unknown target {name!r}" if name else "no executable target")
    if len(ids) > 1:
        raise ValueError(f"ambiguous target name {name!r}" if name else "multiple executable targets; one must be named")
    return ids[0]


def command_preference(output: Column, target: Column, configuration: Column) -> Column:
    """0: the object lies under the target's and configuration's folder, 1: under the target's, 2: elsewhere."""
    marker = F.concat(F.lit("/CMakeFiles/"), target, F.lit(".dir/"))
    path = F.concat(F.lit("/"), F.coalesce(output, F.lit("")))
    owned = F.contains(path, marker)
    return F.when(owned & F.contains(path, F.concat(marker, configuration, F.lit("/"))), 0).when(owned, 1).otherwise(2)


def link_dependencies(dependencies: DataFrame) -> DataFrame:
    """Without those that only an ordering command declared; unknown ones link."""
    return dependencies.filter("coalesce(command, '') <> 'add_dependencies'").select("target", "dependency")
