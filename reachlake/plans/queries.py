"""Registered queries over the derived fact tables, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachlake.functions.keys import stable_key
from reachlake.operators import aggregate, classify, components, diff, merge, resolve, targets
from reachlake.operators.reach import adjacency, reach, unreachable, with_reach
from reachlake.sources import tables
from reachlake.storage import exists, folder_state, merged, new_path

Query = Callable[[SparkSession, str], DataFrame]


def named(df: DataFrame, *columns: str, **renamed: str) -> DataFrame:
    return df.select(*columns, *[F.col(old).alias(new) for new, old in renamed.items()])


#: Paths of what several queries of one application need of the same tables, by application, folder, state of the folder and name.
SHARED: dict[tuple[str, str, str, str], str] = {}


def shared(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table that make gives, written once per application while the folder's files stay as they are and the table is there."""
    key = (spark.sparkContext.applicationId, sf_dir, folder_state(spark, sf_dir), name)
    if key not in SHARED or not exists(spark, SHARED[key]):
        SHARED[key] = new_path(spark, name)
        make().write.parquet(SHARED[key])
    return spark.read.parquet(SHARED[key])


def forget_shared() -> None:
    """Makes the next queries work everything out anew."""
    SHARED.clear()


def reach_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(spark, sf_dir, "reach", lambda: reach(tables.facts(spark, sf_dir)))


def reached(spark: SparkSession, sf_dir: str) -> tuple[tables.Facts, DataFrame]:
    facts = tables.facts(spark, sf_dir)
    return facts, with_reach(facts, reach_of(spark, sf_dir))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.findings(*reached(spark, sf_dir))


def topology(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The unreachable definitions with their components, and the edges between them."""
    candidates = lambda: shared(spark, sf_dir, "candidates", lambda: unreachable(reached(spark, sf_dir)[1]))
    inner = shared(spark, sf_dir, "induced", lambda: components.induced(candidates(), tables.edges(spark, sf_dir)))
    return shared(spark, sf_dir, "strong", lambda: components.strong_components(candidates(), inner)), inner


def weak(spark: SparkSession, sf_dir: str) -> DataFrame:
    strong, _ = topology(spark, sf_dir)
    return unreachable(reached(spark, sf_dir)[1]).join(merged(strong.select("key", "component")), "key")


def scope_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.symbols(spark, sf_dir).groupBy("scope").agg(F.count("*").alias("n"))


def traversable_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = tables.facts(spark, sf_dir)
    return adjacency(facts.symbols, facts.edges)


def reachable_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reach_of(spark, sf_dir).select(F.col("key").alias("id"))


def reachable_structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reach_of(spark, sf_dir).filter("structural").select(F.col("key").alias("id"))


def provider_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reach_of(spark, sf_dir).filter("not structural").select(F.col("key").alias("id"))


def unreachable_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(unreachable(reached(spark, sf_dir)[1]), "kind", "qualified_name", id="key")


def classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir).groupBy("classification").agg(F.count("*").alias("n"))


def summary_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.summary(*reached(spark, sf_dir))


def provider_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(classify.provider_provenance(*reached(spark, sf_dir)), symbol="symbol", from_symbol="from")


def public_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(classify.public_api(tables.facts(spark, sf_dir)), "symbol")


def actionable_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(classify.actionable(found(spark, sf_dir)), "classification", id="key")


def suppressed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(classify.suppressed(found(spark, sf_dir)), "classification", id="key")


def escape_evidence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(F.filter("evidence", lambda x: x["kind"] == "escape")).cast("long")
    return found(spark, sf_dir).select(F.col("key").alias("id"), n.alias("escapes"), F.size("evidence").cast("long").alias("evidence"))


def scc_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(topology(spark, sf_dir)[0], "scc", id="key")


def scc_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology(spark, sf_dir)[0].groupBy("scc").agg(F.count("*").alias("members")).groupBy("members").agg(F.count("*").alias("n"))


def condensation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, inner = topology(spark, sf_dir)
    return components.condensation(found, inner)


def component_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = topology(spark, sf_dir)
    own = tables.symbols(spark, sf_dir).select("key", F.coalesce("file", F.lit("")).alias("file"), F.col("begin_line").alias("line"), F.lit(0).alias("column"), "qualified_name", "signature")
    return components.component_order(rows, own).select("scc", F.col("scc_id").cast("long").alias("scc_id"), F.col("weak_id").cast("long").alias("weak_id"))


def weak_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(weak(spark, sf_dir), "component", id="key")


def loc_by_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.line_counts(weak(spark, sf_dir), ["component"])


def loc_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.line_counts(unreachable(reached(spark, sf_dir)[1]).filter("file is not null"), ["file"])


def owned(level: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return aggregate.ownership(weak(spark, sf_dir)).filter(F.col("level") == level).drop("level")

    return query


def component_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = found(spark, sf_dir).select("key", "suppressions").join(merged(weak(spark, sf_dir).select("key", "component")), "key")
    return aggregate.component_members(rows).select("component", F.size("members").cast("long").alias("members"), "actionable", "suppressed")


def symbol_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = merge.merge_symbols(tables.symbol_batches(spark, sf_dir).drop("batch"), [F.col("file"), F.col("line")])
    return merged.withColumnRenamed("key", "id")


def merge_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("key") + F.col("batch")
    batches = tables.symbol_batches(spark, sf_dir).withColumn("kind", F.when(n % 50 == 0, "synthetic").otherwise(F.col("kind"))).withColumn("name", F.when(n % 40 == 1, "other").otherwise(F.col("name")))
    return named(merge.merge_conflicts(batches), "field", id="key")


def selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By key, by linkage name, by name with and without signature; some name none, some many."""
    part = tables.table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    empty, turn = F.lit(""), key % 4
    qualified = F.concat("p_brand", F.lit("::"), key.cast("string"))
    return part.select(
        key.alias("selector"), F.when(turn == 0, (key * 2).cast("string")).otherwise(empty).alias("id"), F.when(turn == 1, F.concat(F.lit("sym:"), key.cast("string"))).otherwise(empty).alias("linkage_name"),
        F.when(turn >= 2, qualified).otherwise(empty).alias("qualified_name"), F.when(turn == 3, F.concat(F.lit("void ("), (F.col("p_size") + key % 2).cast("string"), F.lit(")"))).otherwise(empty).alias("signature"),
    )


def selector_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(resolve.selector_matches(selectors(spark, sf_dir), tables.symbols(spark, sf_dir)), "selector", "matches", id="key")


def manual_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = tables.table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    request = F.when(key % 3 == 0, key.cast("string")).when(key % 3 == 1, F.concat(F.lit("sym:"), key.cast("string"))).otherwise(F.concat("p_brand", F.lit("::"), (key + key % 2).cast("string")))
    return named(resolve.manual_roots(part.select(request.alias("request")), tables.symbols(spark, sf_dir)), "request", id="key")


def dangling_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = tables.facts(spark, sf_dir)
    return merge.dangling(facts.edges, facts.symbols.filter("key % 37 <> 0"))


def duplicate_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = tables.edges(spark, sf_dir)
    return merge.distinct_facts(edges.union(edges.filter("src % 2 = 0")).union(edges.filter("dst % 3 = 0"))).groupBy("kind").agg(F.count("*").alias("n"))


def dense_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.dense_ids(tables.symbols(spark, sf_dir).select(F.col("linkage_name").alias("key")), ["key"], "dense_id")


def stable_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.symbols(spark, sf_dir)
    linkage, usr = F.when(F.col("key") % 3 == 0, F.col("linkage_name")).otherwise(""), F.when(F.col("key") % 3 == 1, F.concat(F.lit("usr-é:"), F.col("name"))).otherwise("")
    key = stable_key(F.lit("debug"), linkage, usr, F.concat("qualified_name", F.lit("|"), "signature"), F.coalesce("file", F.lit("")))
    return rows.select(F.col("key").alias("id"), key.alias("stable_key"))


def class_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "part").filter("p_partkey > 0").select(F.col("p_partkey").alias("node"), F.expr("p_partkey div 2").alias("parent"))


def class_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.closure(class_tree(spark, sf_dir))


def virtual_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    methods = tables.symbols(spark, sf_dir).select("key", F.col("key").alias("class_name"), (F.col("key") % 5).alias("name"), (F.col("key") % 2).alias("signature"), (F.col("key") % 3 == 0).alias("is_virtual"))
    return resolve.virtual_dispatch(methods, class_tree(spark, sf_dir).select(F.col("node").alias("class_name"), F.col("parent").alias("base")))


def construct_suffix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expressions name a type by its last components; constructors belong to classes of three components."""
    own = tables.symbols(spark, sf_dir)
    classes = own.filter("kind in ('constructor', 'destructor')").select(F.col("key").alias("dst"), F.concat(F.lit("lib::m"), (F.col("key") % 7).cast("string"), F.lit("::C"), (F.col("key") % 50).cast("string")).alias("class_name"))
    used = own.select(
        F.col("key").alias("src"), F.when(F.col("key") % 2 == 0, F.concat(F.lit("m"), (F.col("key") % 7).cast("string"), F.lit("::C"), (F.col("key") % 50).cast("string"))).otherwise(F.concat(F.lit("C"), (F.col("key") % 50).cast("string"))).alias("type")
    )
    return resolve.suffix_pairs(classes, "class_name", "dst", used, "type", "src").select("src", "dst")


def target_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier, nation = tables.table(spark, sf_dir, "supplier"), tables.table(spark, sf_dir, "nation")
    first = supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("target"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("dependency"))
    second = nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("target"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("dependency"))
    return targets.target_closure(first.union(second), supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("target")))


def command_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = tables.table(spark, sf_dir, "orders")
    rank = F.substring("o_orderpriority", 1, 1).cast("int")
    commands = orders.select(F.col("o_custkey").alias("source"), F.when(rank.isNull(), 9).otherwise(rank).alias("preference"), F.col("o_orderkey").alias("index"), F.col("o_orderstatus").alias("arguments"))
    picked = resolve.preferred_commands(orders.select(F.col("o_custkey").alias("source")), commands, ["arguments"])
    return picked.select("source", F.col("index").alias("command"), F.col("preference").cast("long").alias("preference"), "ambiguous")


def diff_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = diff.changes(*tables.diff_pair(spark, sf_dir))
    return changed.select(F.col("key").alias("id"), "change", "baseline_classification", "current_classification", "current_suppressed")


def diff_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.counters(diff.changes(*tables.diff_pair(spark, sf_dir)))


def policy_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = diff.Policy(changes=("newly_unreachable", "new_symbol"), classifications=("dead", "likely_dead"))
    return diff.changes(*tables.diff_pair(spark, sf_dir), policy).filter("policy_match").select(F.col("key").alias("id"), "change")


def offset_to_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line item asks for one byte of one document."""
    docs = tables.table(spark, sf_dir, "documents").filter("text is not null")
    count = docs.count()
    lines = tables.table(spark, sf_dir, "lineitem").select(F.pmod("l_orderkey", F.lit(count)).alias("doc_id"), (F.col("l_partkey") * 31 + F.col("l_linenumber")).alias("at"))
    sizes = docs.select("doc_id", F.octet_length("text").cast("long").alias("size"))
    asked = lines.join(sizes, "doc_id").select(F.col("doc_id").alias("file"), F.pmod("at", F.col("size") + 1).alias("offset")).distinct()
    return resolve.lines_of_offsets(docs.select(F.col("doc_id").alias("file"), "text"), asked).select("file", "offset", F.col("line").cast("long").alias("line"))


def fact_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = tables.facts(spark, sf_dir)
    size = lambda *c: sum((F.coalesce(F.octet_length(x), F.lit(0)) for x in c), F.lit(0)).cast("long")
    parts = [
        facts.symbols.agg(F.lit("symbols").alias("fact"), F.count("*").alias("n"), F.sum(size("linkage_name", "name", "qualified_name", "class_name", "signature", "file") + 4 + 8).alias("bytes")),
        facts.edges.agg(F.lit("edges").alias("fact"), F.count("*").alias("n"), F.sum(F.lit(20).cast("long")).alias("bytes")), facts.roots.agg(F.lit("roots").alias("fact"), F.count("*").alias("n"), F.sum(F.lit(12).cast("long")).alias("bytes")),
        facts.escapes.agg(F.lit("escapes").alias("fact"), F.count("*").alias("n"), F.sum(F.lit(20).cast("long")).alias("bytes")), facts.suppressions.agg(F.lit("suppressions").alias("fact"), F.count("*").alias("n"), F.sum(F.lit(8).cast("long")).alias("bytes")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def dependency_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = tables.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    digest = lambda n: F.sha2(n.cast("string").cast("binary"), 256)
    manifest = lines.select(F.col("l_orderkey").alias("unit"), F.col("l_partkey").alias("path"), digest(F.col("l_partkey")).alias("digest"), ((F.col("l_orderkey") + F.col("l_partkey")) % 2 == 0).alias("is_primary"))
    current = tables.table(spark, sf_dir, "part").filter("p_partkey % 41 <> 0").select(F.col("p_partkey").alias("path"), digest(F.when(F.col("p_partkey") % 15 == 7, F.lit(-1).cast("long")).otherwise(F.col("p_partkey"))).alias("digest"))
    return resolve.stale_units(manifest, current).groupBy("valid").agg(F.count("*").alias("units"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        scope_counts, traversable_edges, reachable_full, reachable_structural, provider_only, unreachable_candidates, classification, summary_counters, provider_provenance, public_api, actionable_findings, suppressed_findings,
        escape_evidence_counts, scc_membership, scc_sizes, condensation_edges, component_ids, weak_components, loc_by_component, loc_by_file, component_members, symbol_merge, merge_conflicts, selector_resolution, manual_roots,
        dangling_edges, duplicate_facts, dense_ids, class_closure, virtual_dispatch, construct_suffix_join, target_closure, command_preference, diff_transitions, diff_counters, policy_matches, offset_to_line, fact_bytes,
        dependency_staleness,
    )
} | {"stable_key": stable_keys, "ownership_type": owned("type"), "ownership_file": owned("file"), "ownership_directory": owned("directory")}
