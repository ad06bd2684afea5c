"""Provider policies and comparison policies (YAML), and their application to facts."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachlake.operators.diff import Policy
from reachlake.operators.resolve import SELECTOR_FIELDS, resolve_unique
from reachlake.schema import CLASSIFICATIONS, Facts
from reachlake.sources.strict import integer, mapping, one_of, parse_yaml, read_one, sequence, string

GATEABLE = ("new_symbol", "newly_unreachable")
#: The lists of a provider policy and the selectors that their entries have.
FACT_LISTS = {"roots": ("symbol",), "public_api_roots": ("symbol",), "edges": ("from", "to"), "escapes": ("symbol", "from"), "suppressions": ("symbol",), "callback_registrations": ("callee",)}
COLUMNS = "provider string, fact string, entry int, role string, id string, linkage_name string, qualified_name string, signature string, argument_index int, reason string"


def selector(value: Any, what: str) -> dict[str, str]:
    """Exactly one of id, linkage_name and qualified_name; a signature only with the last."""
    found = {k: string(v, f"{what}.{k}") for k, v in mapping(value, what, (), SELECTOR_FIELDS).items()}
    if len(set(found) - {"signature"}) != 1:
        raise ValueError(f"{what} must have exactly one of id, linkage_name and qualified_name")
    if "signature" in found and "qualified_name" not in found:
        raise ValueError(f"{what} has a signature without a qualified_name")
    return found


def provider_rows(text: str) -> list[tuple]:
    """One row per selector of a provider policy."""
    top = mapping(parse_yaml(text), "provider policy", ("schema_version", "provider"), tuple(FACT_LISTS))
    version = integer(top["schema_version"], "schema_version")
    if version not in (1, 2):
        raise ValueError(f"unsupported schema_version {version}")
    if "public_api_roots" in top and version < 2:
        raise ValueError("public_api_roots requires schema_version 2")
    provider, rows = string(top["provider"], "provider"), []
    for fact, roles in FACT_LISTS.items():
        for i, entry in enumerate(sequence(top.get(fact, []), fact)):
            what = f"{fact}[{i}]"
            optional = ("from",) if fact == "escapes" else ()
            index = ("argument_index",) if fact == "callback_registrations" else ()
            item = mapping(entry, what, (*(r for r in roles if r not in optional), *index, "reason"), optional)
            for role in roles:
                if role in item:
                    chosen = selector(item[role], f"{what}.{role}")
                    rows.append((provider, fact, i, role, *(chosen.get(f, "") for f in SELECTOR_FIELDS), integer(item["argument_index"], what) if index else None, string(item["reason"], f"{what}.reason")))
    return rows


def read_provider_policies(spark: SparkSession, *paths: str) -> DataFrame:
    """All policies' selectors; the files' order doesn't matter."""
    return spark.createDataFrame([row for path in paths for row in provider_rows(read_one(spark, path))], COLUMNS)


def apply_provider_policies(facts: Facts, policies: DataFrame) -> Facts:
    """Facts with what the policies add; every selector must name exactly one symbol. Registrations are for the extraction and add nothing here."""
    tagged = policies.filter("fact <> 'callback_registrations'").withColumn("selector", F.concat_ws("/", "provider", "fact", F.col("entry").cast("string"), "role"))
    keys = resolve_unique(tagged, facts.symbols)
    rows = tagged.join(keys, "selector").select("provider", "fact", "entry", "role", "key", F.struct("provider", "reason").alias("evidence"))
    entries = rows.groupBy("provider", "fact", "entry", "evidence").pivot("role", ["symbol", "from", "to"]).agg(F.first("key"))
    of = lambda fact: entries.filter(F.col("fact") == fact)
    add = lambda table, new: table.unionByName(new, allowMissingColumns=True).distinct()
    kind = F.lit("provider").alias("kind")
    roots = of("roots").select("symbol", kind, "evidence").union(of("public_api_roots").select("symbol", F.lit("public_api").alias("kind"), "evidence"))
    return facts.with_(
        roots=add(facts.roots, roots), edges=add(facts.edges, of("edges").select(F.col("from").alias("src"), F.col("to").alias("dst"), kind, "evidence")),
        escapes=add(facts.escapes, of("escapes").select("symbol", "from", kind, "evidence")), suppressions=add(facts.suppressions, of("suppressions").select("symbol", "evidence")),
    )


def callback_rules(policies: DataFrame) -> DataFrame:
    """(rule, callee, argument_index, reason) of the registrations, each once."""
    callee = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in SELECTOR_FIELDS[:3]])
    rows = policies.filter("fact = 'callback_registrations'").select("provider", callee.alias("callee"), "signature", "argument_index", "reason").distinct()
    return rows.select(F.concat_ws("/", "provider", "callee", F.col("argument_index").cast("string")).alias("rule"), "callee", "argument_index", "reason")


def names(value: Any, what: str, allowed: tuple[str, ...] | None) -> tuple[str, ...]:
    found = [string(v, f"{what}[{i}]") for i, v in enumerate(sequence(value, what))]
    if not found:
        raise ValueError(f"{what} must not be empty")
    if len(set(found)) < len(found):
        raise ValueError(f"duplicate entry in {what}")
    return tuple(one_of(v, what, allowed) if allowed else v for v in found)


def diff_policy(text: str) -> Policy:
    top = mapping(parse_yaml(text), "comparison policy", ("schema_version",), ("changes", "classifications", "targets"))
    if integer(top["schema_version"], "schema_version") != 2:
        raise ValueError("unsupported schema_version")
    given = {k: names(top[k], k, allowed) for k, allowed in (("changes", GATEABLE), ("classifications", CLASSIFICATIONS), ("targets", None)) if k in top}
    return Policy(**given)


def read_diff_policy(spark: SparkSession, path: str) -> Policy:
    return diff_policy(read_one(spark, path))
