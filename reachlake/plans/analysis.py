"""Whole analyses: from facts to findings, components and documents, and the gate against a baseline."""

from __future__ import annotations

import sys
import time
from dataclasses import dataclass
from typing import TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachlake.operators import aggregate, classify, components, diff
from reachlake.operators.merge import require_empty
from reachlake.operators.reach import unreachable, with_reach
from reachlake.schema import Facts
from reachlake.sinks import documents, reports
from reachlake.sinks.artifact import check_references
from reachlake.sinks.documents import Context
from reachlake.storage import written


class IncompleteRun(Exception):
    """A run that may not report: no roots, failed units, or inputs that can't be trusted."""


@dataclass
class Analysis:
    """members has a row per finding: key, component, scc (numbers in order of place), disposition, class_name and place. component_table has a row per weak
    component, condensation its edges (component, from_scc, to_scc), ownership a row per component, level and label. A component may hold any share of all
    symbols, so its members and edges are rows and never a list in one."""

    facts: Facts
    reached: DataFrame
    findings: DataFrame
    strong: DataFrame
    members: DataFrame
    condensation: DataFrame
    component_table: DataFrame
    ownership: DataFrame
    metrics: dict[str, float]

    @property
    def summary(self) -> DataFrame:
        return classify.summary(self.facts, self.reached)


def places(rows: DataFrame) -> DataFrame:
    """rows with file, begin_line and end_line of the primary extent; a range that ends in another file is unmeasured."""
    if "source" not in rows.columns:
        return rows
    place = F.coalesce(F.col("source.expansion"), F.col("source.spelling"))
    same = place["begin"]["file"] == place["end"]["file"]
    return rows.withColumn("file", place["location"]["file"]).withColumn("begin_line", F.when(same, place["begin"]["line"]).otherwise(0)).withColumn("end_line", F.when(same, place["end"]["line"]).otherwise(0))


def require_indexed(units: DataFrame) -> None:
    """Fails if a unit (file, status) was not indexed."""
    try:
        require_empty(units.filter("status <> 'indexed'").select("file", "status"), "translation units that were not indexed")
    except ValueError as error:
        raise IncompleteRun(str(error)) from error


def analyze(facts: Facts, units: DataFrame | None = None) -> Analysis:
    """Everything a report needs. Fails before anything is written if units failed, facts refer to unknown symbols, or there is no root."""
    if units is not None:
        require_indexed(units)
    check_references(facts)
    if facts.roots.isEmpty():
        raise IncompleteRun("no application root was found")
    began = time.time()
    reached = written(with_reach(facts), "reached")
    traversed = time.time()
    found = written(places(classify.findings(facts, reached)), "findings")
    candidates = unreachable(reached).select("key")
    inner = written(components.induced(candidates, facts.edges), "induced")
    strong = written(components.strong_components(candidates, inner), "strong")
    place = F.coalesce("source.expansion", "source.spelling")["location"]["column"] if "source" in found.columns else F.lit(0)
    own = found.select("key", F.coalesce("file", F.lit("")).alias("file"), F.coalesce("begin_line", F.lit(0)).alias("line"), F.coalesce(place, F.lit(0)).alias("column"), "qualified_name", "signature")
    ids = written(components.component_order(strong, own), "component_ids")
    numbers = strong.select("key", "scc").join(ids, "scc").select("key", F.col("weak_id").alias("component"), F.col("scc_id").alias("scc"))
    disposition = F.when(F.size("suppressions") > 0, "suppressed").otherwise("actionable").alias("disposition")
    members = written(found.select("key", "class_name", "file", "begin_line", "end_line", disposition).join(numbers, "key"), "members")
    # A strong component is counted where its first member is, so no set of them is held.
    heads = members.groupBy("component", "scc").agg(F.count_if(F.col("disposition") == "actionable").alias("a"), F.count("*").alias("n"))
    table = heads.groupBy("component").agg(F.count("*").alias("sccs"), F.sum("a").alias("actionable"), F.sum(F.col("n") - F.col("a")).alias("suppressed"))
    table = table.join(aggregate.line_counts(members, ["component"]).select("component", "lines", "unmeasured"), "component")
    ends = ids.select(F.col("scc").alias("src"), F.col("scc_id").alias("from_scc"), F.col("weak_id").alias("component"))
    between = components.condensation(strong, inner).join(ends, "src").join(ids.select(F.col("scc").alias("dst"), F.col("scc_id").alias("to_scc")), "dst").select("component", "from_scc", "to_scc")
    metrics = {"traversal_ms": 1000 * (traversed - began), "scc_ms": 1000 * (time.time() - traversed)}
    return Analysis(facts, reached, found, strong, members, between, table, aggregate.ownership(members), metrics)


def report(out: TextIO, analysis: Analysis, context: Context, form: str = "json", diagnostics: tuple[str, ...] = ()) -> None:
    write = reports.write_human_report if form == "human" else reports.write_report
    write(out, analysis, context, diagnostics)


def gate(out: TextIO, baseline: tuple[Facts, Context], current: tuple[Facts, Context], policy: diff.Policy, form: str = "json", project_root: str = "") -> int:
    """Writes the comparison and returns the exit status: 2 if the policy matches a change, else 0."""
    contexts = [diff.RunContext(c.configuration_id, c.frontend, c.target_id) for _, c in (baseline, current)]
    diff.require_compatible(*contexts, policy)
    changed = written(diff.changes(baseline[0], current[0], policy, current[1].target_id), "changes")
    counters = diff.counters(changed)
    if form == "sarif":
        documents.write_sarif(out, changed, current[0].symbols, project_root, target=current[1].target_name or None)
    elif form == "human":
        documents.write_human_diff(out, changed, counters)
    else:
        documents.write_diff_report(out, changed, counters, baseline[1], current[1])
    return 2 if counters.first()["policy_matches"] else 0


def failed(context: Context, error: Exception, form: str = "json", out: TextIO | None = None) -> int:
    """Says why a run failed, on the stream that the form asks for, and returns the exit status 1. SARIF gets no such document."""
    context.state = "incomplete" if context.state == "complete" else context.state
    if form == "json":
        documents.write_run_diagnostic(out or sys.stdout, context, str(error))
    else:
        documents.write_human_diagnostic(sys.stderr if out is None or form == "sarif" else out, context, str(error))
    return 1
