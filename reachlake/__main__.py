"""python -m reachlake [AST_DUMP...] [options]: analyses dumps, writes documents, and gates against a baseline.

Dumps are named, or found below --dump-root, where the dump of /p/a.cpp is p/a.cpp.json. With a compilation database a run takes the dumps of
its commands; with a build description besides, those of one target and of all that it links.

Exit status: 0, 1 for a run that failed or is incomplete, 2 for findings or changes that the options don't allow.
"""

from __future__ import annotations

import argparse
import resource
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachlake.functions.keys import stable_key
from reachlake.functions.text import callee_and_index
from reachlake.operators.classify import actionable
from reachlake.operators.extract import Project, extract, unknown_factories
from reachlake.plans.analysis import IncompleteRun, analyze, failed, gate, report, require_indexed
from reachlake.plans.selection import LIBRARIES, Selection, cancellable, commands_below, fallback_notes, require_observed, select_commands, with_manual_roots
from reachlake.plans.units import read_units
from reachlake.schema import FRONTENDS
from reachlake.sinks.artifact import read_artifact, write_artifact, write_artifact_parts
from reachlake.sinks.documents import Context
from reachlake.sources.builds import Build, normalized_commands, read_cmake_replies, read_compile_commands, read_target_manifest
from reachlake.sources.policies import apply_provider_policies, callback_rules, read_diff_policy, read_provider_policies

VERSION = "0.2"


def options(arguments: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser("reachlake")
    p.add_argument("dumps", nargs="*")
    p.add_argument("--version", action="version", version=VERSION)
    for name in ("report-path", "exclude-path", "root", "callback-registration", "provider-config"):
        p.add_argument(f"--{name}", action="append", default=[])
    for name in ("project-root", "dump-root", "compile-commands", "cmake-build-dir", "target-manifest", "configuration", "target", "tu-root", "configuration-id", "ast-filter", "cache-dir"):
        p.add_argument(f"--{name}", default="")
    p.add_argument("--mode", choices=("application",), default="application")
    p.add_argument("--frontend", choices=FRONTENDS, default=FRONTENDS[0])
    p.add_argument("--format", choices=("human", "json", "sarif"), default="human")
    for name in ("output", "graph-output", "baseline-graph", "diff-policy"):
        p.add_argument(f"--{name}")
    p.add_argument("--index-timeout", type=float, default=0)
    for name in ("fail-on-unreachable", "fail-on-diff", "no-cache", "verbose"):
        p.add_argument(f"--{name}", action="store_true")
    found = p.parse_args(arguments)
    if bool(found.baseline_graph) != bool(found.diff_policy):
        p.error("a baseline and a comparison policy belong together")
    if (found.format == "sarif" or found.fail_on_diff) and not found.baseline_graph:
        p.error("SARIF and --fail-on-diff need a baseline and a policy")
    if bool(found.dumps) == bool(found.dump_root):
        p.error("name dumps, or the folder where they lie")
    if found.cmake_build_dir and found.target_manifest:
        p.error("a run has one build description")
    described = found.cmake_build_dir or found.target_manifest
    if (found.target or found.configuration) and not described:
        p.error("--target and --configuration need a build description")
    if (described or found.tu_root) and not found.compile_commands:
        p.error("a build description and --tu-root need --compile-commands")
    if found.compile_commands and not found.dump_root:
        p.error("--compile-commands needs --dump-root")
    if not found.project_root and not described:
        p.error("--project-root is needed where no build description has one")
    if found.no_cache and found.cache_dir:
        p.error("--no-cache and --cache-dir exclude each other")
    if found.index_timeout < 0:
        p.error("--index-timeout must be positive")
    return found


def selected(spark: SparkSession, found: argparse.Namespace, explicit_api: bool) -> tuple[DataFrame | None, Selection | None, Build | None]:
    """The commands that a run takes, and what selected them."""
    if not found.compile_commands:
        return None, None, None
    commands, chosen, build = read_compile_commands(spark, found.compile_commands), None, None
    if found.cmake_build_dir or found.target_manifest:
        build = read_cmake_replies(spark, f"{found.cmake_build_dir}/.cmake/api/v1/reply") if found.cmake_build_dir else read_target_manifest(spark, found.target_manifest)
        chosen = select_commands(build, commands, found.configuration, found.target, explicit_api)
        commands = chosen.commands
    if found.tu_root:
        commands = commands_below(commands, found.tu_root)
    return commands, chosen, build


def describe(context: Context, found: argparse.Namespace, chosen: Selection | None, build: Build | None) -> None:
    """What the selection says of a run that options don't."""
    if chosen is not None:
        own, context.mode = chosen.context, "target"
        for name in ("configuration", "target_id", "target_name", "target_kind", "closure_targets"):
            setattr(context, name, getattr(own, name))
        context.configuration_id = found.configuration_id or own.configuration_id
        found.project_root = found.project_root or build.root


def project_of(found: argparse.Namespace, context: Context, commands: DataFrame | None, chosen: Selection | None, build: Build | None) -> Project:
    project = Project(found.project_root, found.report_path, found.exclude_path, context.configuration_id, name_filter=found.ast_filter)
    if chosen is not None:
        project.public_headers = chosen.headers
        if chosen.infer_exports:
            own = build.sources.filter((F.col("configuration") == context.configuration) & (F.col("id") == context.target_id)).select(F.col("path").alias("file"))
            rows = normalized_commands(commands.join(own, "file", "left_semi")).groupBy(F.col("file").alias("unit"))
            project.exports = rows.agg(F.min_by("arguments", "index").alias("arguments"))
    return project


def run(spark: SparkSession, found: argparse.Namespace) -> int:
    began = time.time()
    context = Context(found.configuration_id or "default", frontend=found.frontend)
    out = open(found.output, "w", encoding="utf-8") if found.output else sys.stdout
    watch = cancellable(spark, "reachlake-run", found.index_timeout)
    try:
        with watch:
            return analysed(spark, found, context, out, began)
    except (IncompleteRun, ValueError) as error:
        return failed(context, error, found.format, out if found.output else None)
    except Exception:
        if not watch.expired:
            raise
        return failed(context, IncompleteRun(f"cancelled after {found.index_timeout} s"), found.format, out if found.output else None)
    finally:
        if found.output:
            out.close()


def analysed(spark: SparkSession, found: argparse.Namespace, context: Context, out, began: float) -> int:
    if found.frontend != FRONTENDS[0]:
        context.state = "unsupported"
        raise IncompleteRun(f"the front end {found.frontend} is not part of this engine")
    policies = read_provider_policies(spark, *found.provider_config) if found.provider_config else None
    explicit_api = policies is not None and not policies.filter("fact = 'public_api_roots'").isEmpty()
    commands, chosen, build = selected(spark, found, explicit_api)
    if explicit_api and (chosen is None or chosen.context.target_kind not in LIBRARIES):
        raise ValueError("public API roots require a selected library")
    describe(context, found, chosen, build)
    rules = [(r, *callee_and_index(r)) for r in found.callback_registration]
    table = spark.createDataFrame(rules, "rule string, callee string, argument_index long") if rules else None
    if policies is not None:
        own = callback_rules(policies).select("rule", "callee", "argument_index")
        table = own if table is None else table.union(own)

    units = read_units(spark, found.dumps, found.dump_root, commands, found.project_root, "" if found.no_cache else found.cache_dir)
    require_indexed(units.table)
    context.translation_units = units.walked + units.reused
    facts = extract(units.nodes, project_of(found, context, commands, chosen, build), table)
    indexed = time.time()
    facts, notes = with_manual_roots(facts, found.root)
    notes += chosen.diagnostics if chosen is not None else []
    if found.ast_filter:
        notes.append(f"only declarations whose name holds {found.ast_filter!r} were indexed")
    if policies is not None:
        facts = apply_provider_policies(facts.with_(symbols=facts.symbols.withColumn("linkage_name", F.col("identity.linkage_name"))), policies)
        facts = facts.with_(symbols=facts.symbols.drop("linkage_name"))
    if chosen is not None and not explicit_api:
        api = facts.roots.filter("kind = 'public_api'").select(F.col("symbol").alias("key"))
        require_observed(chosen.headers, facts.symbols.join(api, "key", "left_semi").select(F.col("source.spelling.location.file").alias("file")))
    analysis = analyze(facts)
    factories = unknown_factories(units.nodes).orderBy("helper", "built").collect()  # a name for each kind of factory in the code
    notes += [f"unsupported owning-pointer factory {r.helper}: {r.built} is taken to be constructed and destroyed" for r in factories]
    notes += fallback_notes(facts.symbols)
    reporting = time.time()
    if found.graph_output:
        if found.graph_output.endswith("/"):
            write_artifact_parts(found.graph_output, facts, context, notes)
        else:
            with open(found.graph_output, "w", encoding="utf-8") as file:
                write_artifact(file, facts, context, notes)
    status = 0
    if found.baseline_graph:
        status = gate(out, read_artifact(spark, found.baseline_graph, stable_key), (facts, context), read_diff_policy(spark, found.diff_policy), found.format, found.project_root)
        status = status if found.fail_on_diff else 0
    else:
        report(out, analysis, context, found.format, tuple(notes))
    if found.verbose:
        now = time.time()
        metrics = {
            "frontend": found.frontend, "translation_units": context.translation_units, "indexed_units": units.walked, "reused_units": units.reused, "ast_bytes": units.input_bytes, "indexing_ms": 1000 * (indexed - began), **analysis.metrics,
            "reporting_ms": 1000 * (now - reporting), "wall_ms": 1000 * (now - began), "peak_rss_kib": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, "symbols": facts.symbols.count(), "edges": facts.edges.count(),
        }
        sys.stderr.write("reachlake-metrics " + " ".join(f"{k}={round(v) if isinstance(v, float) else v}" for k, v in metrics.items()) + "\n")
    return 2 if found.fail_on_unreachable and not actionable(analysis.findings).isEmpty() else status


def main(arguments: list[str] | None = None) -> int:
    return run(SparkSession.builder.appName("reachlake").getOrCreate(), options(arguments))


if __name__ == "__main__":
    sys.exit(main())
