"""What a run is about: the commands of one target's closure, the API policy of libraries, manual roots, and the checks that a run must pass."""

from __future__ import annotations

import threading
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachlake.functions.keys import directory_key, path_contains
from reachlake.operators.merge import require_empty
from reachlake.operators.resolve import manual_roots, preferred_commands
from reachlake.operators.targets import command_preference, link_dependencies, select_configuration, select_target, target_closure
from reachlake.plans.analysis import IncompleteRun
from reachlake.schema import Facts
from reachlake.sinks.documents import Context
from reachlake.sources.builds import Build
from reachlake.storage import written

#: Target kinds whose sources need no command, and those that other programs link.
WITHOUT_COMMANDS = ("utility", "interface_library")
LIBRARIES = ("static_library", "shared_library", "module_library", "interface_library")
EXPORTING = ("shared_library", "module_library")
NEED_API = ("static_library", "interface_library")


@dataclass
class Selection:
    commands: DataFrame
    context: Context
    headers: list[str]
    infer_exports: bool
    diagnostics: list[str]


def commands_below(commands: DataFrame, folder: str) -> DataFrame:
    """The commands whose file lies below a folder; none is an error."""
    kept = commands.filter(path_contains(F.lit(folder), F.col("file")))
    if kept.isEmpty():
        raise IncompleteRun(f"no compilation command below {folder}")
    return kept


def select_commands(build: Build, commands: DataFrame, configuration: str = "", target: str = "", explicit_api: bool = False) -> Selection:
    """The commands of a target and all that it links, one per source: that of the target's own object folder and configuration first."""
    name = select_configuration(build.targets, configuration)
    of = lambda table: table.filter(F.col("configuration") == name)
    chosen = select_target(build.targets, name, target)
    rows = of(build.targets)
    start = rows.filter(F.col("id") == chosen).select(F.col("id").alias("target"))
    closure = target_closure(link_dependencies(of(build.dependencies)), start)
    known = written(rows.join(closure.withColumnRenamed("target", "id"), "id", "left_semi"), "closure")
    members = known.orderBy("name", "id").select("id", "name", "kind").collect()  # the targets of one build
    missing = [r.target for r in closure.join(known.select(F.col("id").alias("target")), "target", "left_anti").orderBy("target").toLocalIterator()]
    own = next(r for r in members if r.id == chosen)
    notes = [f"dependency {m} is no target of the build" for m in missing] + [f"static library {r.name} is linked whole" for r in members if r.kind == "static_library" and r.id != chosen]

    if explicit_api and own.kind not in LIBRARIES:
        raise ValueError("public API roots require a selected library")
    headers = [r.path for r in of(build.headers).filter(F.col("id") == chosen).select("path").distinct().orderBy(directory_key(F.col("path"))).collect()]
    if own.kind in NEED_API and not headers and not explicit_api:
        raise IncompleteRun("the selected library requires public headers or explicit public API roots")

    compiled = known.filter(~F.col("kind").isin(*WITHOUT_COMMANDS)).select("id", F.col("name").alias("target"))
    sources = of(build.sources).join(compiled, "id").select(F.concat_ws("#", "id", "path").alias("source"), "path", "target")
    ranked = sources.join(commands.withColumnRenamed("file", "path"), "path").withColumn("preference", command_preference(F.col("output"), F.col("target"), F.lit(name))).withColumn("_same", F.to_json(F.struct("directory", "path", "arguments")))
    picked = written(preferred_commands(sources, ranked.drop("target"), ["_same"]), "picked")
    require_empty(picked.filter("index is null").select("source"), "no compilation command for target source")
    require_empty(picked.filter("ambiguous").select("source"), "ambiguous compilation commands for target source")
    selected = commands.join(picked.select("index").distinct(), "index", "left_semi")
    if selected.isEmpty():
        raise IncompleteRun("the selection has no compilation context")
    context = Context(configuration_id=name or "default", configuration=name, target_id=own.id, target_name=own.name, target_kind=own.kind, closure_targets=sorted(r.name for r in members))
    return Selection(selected, context, headers, own.kind in EXPORTING, notes)


def with_manual_roots(facts: Facts, requests: list[str]) -> tuple[Facts, list[str]]:
    """Facts with a manual root for each symbol that a request names by qualified name, linkage name or key, and a note per request that names none."""
    if not requests:
        return facts, []
    symbols = facts.symbols if "linkage_name" in facts.symbols.columns else facts.symbols.withColumn("linkage_name", F.col("identity.linkage_name"))
    asked = facts.symbols.sparkSession.createDataFrame([(r,) for r in requests], "request string")
    found = written(manual_roots(asked, symbols), "manual")
    why = F.struct(F.lit("manual").alias("provider"), F.concat(F.lit("requested as "), F.col("request")).alias("reason")).alias("evidence")
    roots = found.filter("key is not null").select(F.col("key").alias("symbol"), F.lit("manual").alias("kind"), why)
    notes = [f"root {r.request} matched no symbol" for r in found.filter("key is null").orderBy("request").collect()]
    return facts.with_(roots=facts.roots.unionByName(roots).distinct()), notes


def require_observed(headers: list[str], declared: DataFrame) -> None:
    """Every public header must have shown a declaration; declared has file."""
    if headers:
        asked = declared.sparkSession.createDataFrame([(h,) for h in headers], "file string")
        try:
            require_empty(asked.join(declared.select("file").distinct(), "file", "left_anti"), "public header was not observed")
        except ValueError as error:
            raise IncompleteRun(str(error)) from error


def fallback_notes(symbols: DataFrame) -> list[str]:
    """A note for each symbol without a stable identity, in key order."""
    rows = symbols.filter("identity.quality = 'fallback'").select("qualified_name").orderBy("key").toLocalIterator()
    return [f"fallback identity for {r.qualified_name}" for r in rows]


class cancellable:  # noqa: N801
    """Cancels what runs under a tag after some seconds (0: never); leaving the block ends the watch."""

    def __init__(self, spark: SparkSession, tag: str, seconds: float) -> None:
        self.context, self.tag, self.expired = spark.sparkContext, tag, False
        self.timer = threading.Timer(seconds, self.cancel) if seconds else None

    def cancel(self) -> None:
        self.expired = True
        self.context.cancelJobsWithTag(self.tag)

    def __enter__(self) -> cancellable:
        self.context.addJobTag(self.tag)
        if self.timer:
            self.timer.start()
        return self

    def __exit__(self, *error: object) -> None:
        if self.timer:
            self.timer.cancel()
        self.context.removeJobTag(self.tag)
