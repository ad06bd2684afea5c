"""Findings: classification of unreachable definitions with ordered evidence, suppression, provenance and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachlake.operators.reach import eligible, unreachable
from reachlake.schema import PROVIDED, Facts
from reachlake.storage import merged


def classification(escaped: Column) -> Column:
    """What an unreachable definition is: escapes come before virtual dispatch, that before internal linkage."""
    return F.when(escaped, "dynamically_referenced").when(F.col("is_virtual"), "possibly_dead").when(F.col("internal_linkage"), "dead").otherwise("likely_dead")


def evidence(kind: str, provider: str, reason: str) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(provider).alias("provider"), F.lit(reason).alias("reason"), F.lit(None).cast("string").alias("escape_kind"), F.lit(None).cast("string").alias("from"))


def findings(facts: Facts, reached: DataFrame) -> DataFrame:
    """The unreachable definitions with classification, evidence (the missing path first, then escapes in canonical order or the one
    reason of the class) and suppressions (empty: actionable)."""
    candidates = unreachable(reached)
    named = set(facts.escapes.columns)
    column = lambda c: F.col(c).cast("string") if c in named else F.lit(None).cast("string")
    item = F.struct(column("from").alias("from"), column("kind").alias("kind"), *(F.col(f"evidence.{c}").alias(c) if "evidence" in named else F.lit("").alias(c) for c in ("provider", "reason")))
    escapes = facts.escapes.select("symbol", item.alias("item")).distinct().groupBy("symbol").agg(F.sort_array(F.collect_list("item")).alias("escapes"))
    why = F.col("evidence") if "evidence" in facts.suppressions.columns else F.struct(F.lit("").alias("provider"), F.lit("").alias("reason"))
    suppressions = facts.suppressions.select("symbol", why.alias("why")).distinct().groupBy("symbol").agg(F.sort_array(F.collect_list("why")).alias("suppressions"))
    rows = candidates.join(merged(escapes.withColumnRenamed("symbol", "key")), "key", "left").join(merged(suppressions.withColumnRenamed("symbol", "key")), "key", "left")
    rows = rows.withColumn("classification", classification(F.col("escapes").isNotNull()))
    # The reasons that findings carry.
    first = evidence("no_reachable_path", "reachability_analysis", "no path from an application root")
    escaped = F.transform("escapes", lambda x: F.struct(F.lit("escape").alias("kind"), x["provider"].alias("provider"), x["reason"].alias("reason"), x["kind"].alias("escape_kind"), x["from"].alias("from")))
    more = (
        F.when(F.col("classification") == "dynamically_referenced", escaped)
        .when(F.col("classification") == "possibly_dead", F.array(evidence("virtual_dispatch_uncertainty", "classification_policy", "virtual dispatch requires conservative review")))
        .when(F.col("classification") == "dead", F.array(evidence("internal_linkage", "classification_policy", "symbol has internal linkage")))
        .otherwise(F.array().cast("array<struct<kind:string,provider:string,reason:string,escape_kind:string,from:string>>"))
    )
    return rows.withColumn("evidence", F.concat(F.array(first), more)).withColumn("suppressions", F.coalesce("suppressions", F.array().cast("array<struct<provider:string,reason:string>>"))).drop("escapes")


def actionable(found: DataFrame) -> DataFrame:
    return found.filter(F.size("suppressions") == 0)


def suppressed(found: DataFrame) -> DataFrame:
    return found.filter(F.size("suppressions") > 0)


def summary(facts: Facts, reached: DataFrame) -> DataFrame:
    """One row of counters over the project's own definitions, and the scopes of all symbols."""
    hidden = facts.suppressions.select(F.col("symbol").alias("key")).distinct().withColumn("hidden", F.lit(True))
    public = facts.roots.filter("kind = 'public_api'").select(F.col("symbol").alias("key")).distinct().withColumn("public", F.lit(True))
    rows = reached.join(merged(hidden), "key", "left").join(merged(public), "key", "left").withColumn("own", F.expr("defined and scope = 'reportable' and kind <> 'synthetic'"))
    own, live, api = F.col("own"), F.col("reachable"), F.coalesce("public", F.lit(False))
    count = lambda c, name: F.count_if(c).alias(name)
    return rows.agg(
        *[count(F.col("scope") == s, f"{s}_symbols") for s in ("reportable", "indexed", "external_opaque")], count(own, "defined"), count(own & live, "reachable"), count(own & F.col("structurally_reachable"), "structural"),
        count(own & F.col("provider_reachable"), "provider"), count(own & ~live, "unreachable"), count(own & ~live & F.col("hidden").isNull(), "actionable"), count(own & ~live & F.col("hidden").isNotNull(), "suppressed"),
        count(own & api, "public_api"), count(own & live & ~api, "internal_live"), count(own & ~live, "internal_unreachable"),
    )


def provider_provenance(facts: Facts, reached: DataFrame) -> DataFrame:
    """(symbol, from, evidence...): what keeps a definition alive only through providers: the edges from live symbols, and the roots, where from is null."""
    state = reached.select("key", "reachable", "provider_reachable", (F.col("defined") & (F.col("scope") == "reportable")).alias("own"))
    target = state.filter("provider_reachable and own").select(F.col("key").alias("symbol"))
    live = state.filter("reachable").select(F.col("key").alias("from"))
    extra = [c for c in ("evidence",) if c in facts.edges.columns and c in facts.roots.columns]
    edges = facts.edges.filter(F.col("kind").isin(*PROVIDED)).select(F.col("dst").alias("symbol"), F.col("src").alias("from"), *extra).join(merged(live), "from", "left_semi")
    roots = facts.roots.filter(F.col("kind").isin(*PROVIDED)).select("symbol", F.lit(None).cast(facts.edges.schema["src"].dataType).alias("from"), *extra)
    return edges.select("symbol", "from", *extra).unionByName(roots).join(merged(target), "symbol", "left_semi").distinct()


def public_api(facts: Facts) -> DataFrame:
    """Reportable symbols that public-API roots name, with the roots' evidence."""
    names = facts.symbols.filter("scope = 'reportable'").select(F.col("key").alias("symbol"))
    return facts.roots.filter("kind = 'public_api'").drop("kind").join(merged(names), "symbol", "left_semi").distinct()


def candidates(reached: DataFrame) -> DataFrame:
    return unreachable(reached)


__all__ = ["actionable", "candidates", "classification", "eligible", "findings", "provider_provenance", "public_api", "summary", "suppressed"]
