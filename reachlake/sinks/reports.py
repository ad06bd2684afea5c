"""Reports of one analysis, as a JSON document and as text.

Every section is a table that Spark joins, orders and turns into lines; the driver only streams them. What belongs to a component (members,
edges between its strong components, ownership) is an array of its own that names the component, because a component may hold any share of
all symbols and must not become one object.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from typing import TYPE_CHECKING, Any, TextIO

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachlake.functions.keys import display_location, display_symbol
from reachlake.operators.aggregate import directory
from reachlake.operators.classify import provider_provenance, public_api
from reachlake.schema import ROOT_KINDS, ordinal, primary_extent
from reachlake.sinks.documents import REPORT_VERSION, Context, finding_order, json_rows, located, source_json, text, write_document
from reachlake.storage import written

if TYPE_CHECKING:
    from reachlake.plans.analysis import Analysis

ORDER = ("_file", "_line", "_column", "qualified_name", "signature", "key")


def described(rows: DataFrame, symbols: DataFrame, column: str, prefix: str = "") -> DataFrame:
    """rows with the names, scope and source of the symbol that a column holds; null where there is none."""
    source = source_json() if "source" in symbols.columns else F.lit(None).cast("string")
    names = symbols.select(F.col("key").alias(column), F.col("qualified_name").alias(f"{prefix}symbol_name"), F.col("signature").alias(f"{prefix}signature"), F.col("scope").alias(f"{prefix}scope"), source.alias(f"{prefix}source"))
    return rows.join(names, column, "left")


def with_origins(findings: DataFrame, symbols: DataFrame) -> DataFrame:
    """findings whose evidence names the symbol that an escape comes from."""
    each = findings.select("key", F.posexplode("evidence").alias("at", "e"))
    names = symbols.select(F.col("key").cast("string").alias("from"), F.col("qualified_name").alias("from_symbol"), F.col("signature").alias("from_signature"))
    each = each.withColumn("from", F.col("e.from")).join(names, "from", "left")
    item = F.struct("e.kind", "e.provider", "e.reason", "e.escape_kind", "from", "from_symbol", "from_signature")
    told = each.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", item.alias("item")))).alias("told")).select("key", F.transform("told", lambda x: x["item"]).alias("evidence"))
    return findings.drop("evidence").join(told, "key")


def why(rows: DataFrame) -> Column:
    return F.col("evidence") if "evidence" in rows.columns else F.lit(None).cast("struct<provider:string,reason:string>").alias("evidence")


def sections(analysis: Analysis) -> dict[str, DataFrame]:
    """The tables of a report, before they are ordered; findings have their component and strong component."""
    facts = analysis.facts
    numbers = analysis.members.select("key", "component", "scc", "disposition")
    provided, api = provider_provenance(facts, analysis.reached), public_api(facts)
    return {
        "roots": described(facts.roots.select("symbol", "kind", why(facts.roots)), facts.symbols, "symbol"),
        "public_api": described(api.select("symbol", why(api)), facts.symbols, "symbol"),
        "provider_reachable": described(described(provided.select("symbol", "from", why(provided)), facts.symbols, "symbol"), facts.symbols, "from", "from_"),
        "findings": written(located(with_origins(analysis.findings, facts.symbols)).join(numbers, "key"), "reported"),
    }


def write_report(out: TextIO, analysis: Analysis, context: Context, diagnostics: Iterable[str] = ()) -> None:
    parts = sections(analysis)
    rows = parts["findings"]
    source = source_json() if "source" in rows.columns else F.lit(None).cast("string")
    place = [F.col("_file").alias("file"), F.col("_line").alias("line"), source.alias("source")]
    found = rows.select("key", "qualified_name", "signature", "kind", "scope", *place, "classification", "component", "scc", "evidence", "suppressions", "_file", "_line", "_column")
    members = analysis.members.select("component", "scc", "key", "disposition", F.col("class_name").alias("type"), "file", directory(F.coalesce("file", F.lit(""))).alias("directory"))
    head: dict[str, Any] = {"schema_version": REPORT_VERSION, "mode": context.mode, "run": context.run(), "analysis_context": {"configuration_id": context.configuration_id, **context.analysis()}, "summary": analysis.summary.first().asDict()}
    named = ["symbol", "symbol_name", "signature"]
    evidence = [F.col("evidence.provider"), F.col("evidence.reason")]
    write_document(out, head, {
        "roots": json_rows(parts["roots"].select(*named, "kind", "scope", "source", "evidence"), [F.col("symbol"), ordinal(F.col("kind"), ROOT_KINDS), *evidence]),
        "public_api": json_rows(parts["public_api"].select(*named, F.lit("externally_reachable").alias("classification"), "evidence"), [F.col("symbol"), *evidence]),
        "provider_reachable": json_rows(parts["provider_reachable"].select(*named, "from", "from_symbol_name", "from_signature", "evidence"), [F.col("symbol"), F.col("from").asc_nulls_first(), *evidence]),
        "unreachable_components": json_rows(analysis.component_table, [F.col("component")]),
        "component_members": json_rows(members, [F.col("component"), F.col("scc"), F.col("key")]),
        "component_edges": json_rows(analysis.condensation, [F.col("component"), F.col("from_scc"), F.col("to_scc")]),
        "ownership": json_rows(analysis.ownership, [F.col("component"), F.col("level"), F.col("label")]),
        "findings": json_rows(found.filter(F.size("suppressions") == 0).drop("suppressions"), [*finding_order(), F.col("key")]),
        "suppressed": json_rows(found.filter(F.size("suppressions") > 0), [*finding_order(), F.col("key")]),
        "diagnostics": map(text, sorted(set(diagnostics))),
    })


def lines(*columns: Column | str) -> Column:
    """The lines that aren't null, as one text."""
    return F.concat_ws("\n", *columns)


def shown(rows: DataFrame, indent: str) -> Column:
    """A finding with its place and range (and where a macro spelled it, if one was expanded), kind, class and evidence."""
    pad = F.lit(indent + "  ")
    name = F.concat(F.lit(indent), display_symbol(F.col("qualified_name"), F.col("signature"), F.col("key").cast("string")))
    at = F.concat(pad, F.lit("at "), display_location(F.col("_file"), F.col("_line"), F.col("_column")))
    spread = spelled = F.lit(None).cast("string")
    if "source" in rows.columns:
        point = lambda p: display_location(p["file"], p["line"], p["column"])
        extent = primary_extent()
        spread = F.concat(pad, F.lit("from "), point(extent["begin"]), F.lit(" to "), point(extent["end"]))
        spelled = F.when(F.col("source.expansion").isNotNull(), F.concat(pad, F.lit("spelled at "), point(F.col("source.spelling.location")), F.lit(", expanded at "), point(F.col("source.expansion.location"))))
    origin = lambda x: F.coalesce(F.concat(F.lit(" from "), x["from_symbol"], F.lit(" "), x["from_signature"]), F.concat(F.lit(" from "), x["from"]), F.lit(""))
    told = F.transform("evidence", lambda x: F.concat(pad, F.lit("- "), x["kind"], F.coalesce(F.concat(F.lit(" ("), x["escape_kind"], F.lit(")")), F.lit("")), F.lit(": "), x["provider"], F.lit(": "), x["reason"], origin(x)))
    hidden = F.transform("suppressions", lambda x: F.concat(pad, F.lit("suppressed by "), x["provider"], F.lit(": "), x["reason"]))
    return lines(name, at, spread, spelled, F.concat(pad, F.col("kind"), F.lit(", "), F.col("classification")), F.concat_ws("\n", told), F.when(F.size("suppressions") > 0, F.concat_ws("\n", hidden)))


def listed(rows: DataFrame, more: Column, key: str = "symbol") -> DataFrame:
    """(text, order) of a section whose rows name a symbol and carry evidence."""
    name = F.concat(F.lit("  "), display_symbol(F.col("symbol_name"), F.col("signature"), F.col(key).cast("string")), more)
    reason = F.concat(F.lit("    "), F.col("evidence.provider"), F.lit(": "), F.col("evidence.reason"))
    return rows.select(lines(name, reason).alias("text"), F.col(key).alias("order")).orderBy("order", "text")


def write_human_report(out: TextIO, analysis: Analysis, context: Context, diagnostics: Iterable[str] = ()) -> None:
    """Sections of text; a component without actionable members is left out."""
    parts = sections(analysis)

    def section(title: str, rows: DataFrame) -> None:
        for i, r in enumerate(rows.toLocalIterator()):
            out.write((f"\n{title}\n" if i == 0 else "") + r.text + "\n")

    out.write(f"RUN {context.state}: {context.translation_units} translation units by {context.frontend}\n")
    if context.target_name:
        out.write(f"TARGET {context.target_name} ({context.target_kind}) in {context.configuration or 'the only configuration'}, with {', '.join(context.closure_targets)}\n")
    out.write("\nSUMMARY\n" + "".join(f"  {k.replace('_', ' ')}: {v}\n" for k, v in analysis.summary.first().asDict().items()))
    section("ROOTS", listed(parts["roots"], F.concat(F.lit(" ["), F.col("kind"), F.lit(", "), F.coalesce("scope", F.lit("unknown")), F.lit("]"))))
    section("PUBLIC API", listed(parts["public_api"], F.lit(" [externally_reachable]")))
    origin = F.coalesce(F.concat(F.lit(" from "), display_symbol(F.col("from_symbol_name"), F.col("from_signature"), F.col("from").cast("string"))), F.lit(""))
    section("PROVIDER-REACHABLE", listed(parts["provider_reachable"], origin))

    table = analysis.component_table.filter("actionable > 0")
    unmeasured = F.when(F.col("unmeasured") > 0, F.concat(F.lit(", "), F.col("unmeasured"), F.lit(" unmeasured"))).otherwise("")
    head = F.concat(F.lit("\nCOMPONENT "), F.col("component"), F.lit(": "), F.col("actionable"), F.lit(" actionable and "), F.col("suppressed"), F.lit(" suppressed members in "), F.col("sccs"), F.lit(" strong components, about "), F.col("lines"), F.lit(" lines"), unmeasured)
    owner = F.concat(F.lit("  "), F.col("level"), F.lit(" "), F.col("label"), F.lit(": "), F.col("members"), F.lit(" symbols, about "), F.col("lines"), F.lit(" lines"), unmeasured)
    rank = F.array_position(F.array(*map(F.lit, ("type", "file", "directory"))), F.col("level"))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in zip(ORDER, ("string", "long", "long", "string", "string", "string"), strict=True)]
    place = [F.col(c).cast(t).alias(c) for c, t in zip(ORDER, ("string", "long", "long", "string", "string", "string"), strict=True)]
    rows = parts["findings"]
    items = [
        table.select("component", F.lit(0).alias("part"), F.lit("").alias("label"), *nothing, head.alias("text")),
        analysis.ownership.join(table.select("component"), "component", "left_semi").select("component", rank.alias("part"), "label", *nothing, owner.alias("text")),
        rows.filter(F.size("suppressions") == 0).select("component", F.lit(4).alias("part"), F.lit("").alias("label"), *place, F.concat(F.lit("\n"), shown(rows, "  ")).alias("text")),
    ]
    for r in reduce(DataFrame.union, items).orderBy("component", "part", "label", *ORDER).select("text").toLocalIterator():
        out.write(r.text + "\n")
    section("SUPPRESSED", rows.filter(F.size("suppressions") > 0).select(shown(rows, "  ").alias("text"), *place).orderBy(*ORDER))
    notes = sorted(set(diagnostics))
    if notes:
        out.write("\nDIAGNOSTICS\n" + "".join(f"  {x}\n" for x in notes))
