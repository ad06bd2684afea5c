"""Weak and strong components, condensation, transitive closure.

Weak components come from alternating large-star and small-star rounds, whose number grows with the logarithm of the graph.
Strong components are searched inside weak ones: those of at most SMALL nodes are dealt to groups of about GROUP nodes, each of which a task
takes with an iterative Tarjan over numbered nodes; larger ones are coloured by the whole cluster: the smallest node that reaches a node is its
colour, and what reaches that node within its colour is its component.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachlake.operators.merge import dense_ids
from reachlake.storage import merged, written

SMALL = 50_000
#: Nodes of small weak components that share a group, on average.
GROUP = 20_000


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, component) for nodes (key) and edges (src, dst) between them; component is the smallest member."""
    stars, before = written(edges.filter("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct(), "stars"), None
    while True:
        both = stars.union(stars.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(merged(least), "a").filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(merged(low), "a").filter("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).union(low)
        stars = written(small.distinct(), "stars")
        now = tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return nodes.select("key").join(merged(stars.withColumnRenamed("a", "key")), "key", "left").select("key", F.coalesce("b", "key").alias("component"))
        before = now


def tarjan(count: int, pairs: list[tuple[int, int]]) -> list[int]:
    """The component of each node 0..count-1, named by its smallest node."""
    after: list[list[int]] = [[] for _ in range(count)]
    for a, b in pairs:
        after[a].append(b)
    index, low, found = [-1] * count, [0] * count, [-1] * count
    stack: list[int] = []
    clock = 0
    for start in range(count):
        if index[start] >= 0:
            continue
        work = [(start, 0)]
        while work:
            node, at = work.pop()
            if at == 0:
                index[node] = low[node] = clock
                clock += 1
                stack.append(node)
            elif found[after[node][at - 1]] < 0:
                low[node] = min(low[node], low[after[node][at - 1]])
            if at < len(after[node]):
                work.append((node, at + 1))
                if index[after[node][at]] < 0:
                    work.append((after[node][at], 0))
                elif found[after[node][at]] < 0:
                    low[node] = min(low[node], index[after[node][at]])
            elif low[node] == index[node]:
                members = []
                while not members or members[-1] != node:
                    members.append(stack.pop())
                name = min(members)
                for x in members:
                    found[x] = name
    return found


def group_components(group: pd.DataFrame) -> pd.DataFrame:
    """Of whole weak components' rows: their nodes (dst is null) and edges."""
    keys = sorted(group.loc[group["dst"].isna(), "src"])
    place = {k: i for i, k in enumerate(keys)}
    inner = group.loc[~group["dst"].isna()]
    names = tarjan(len(keys), [(place[a], place[b]) for a, b in zip(inner["src"], inner["dst"], strict=True)])
    return pd.DataFrame({"key": keys, "scc": [keys[x] for x in names]})


def strong_components(nodes: DataFrame, edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(key, scc, component): every node with its strong component, named by its smallest member, and its weak one."""
    weak = written(weak_components(nodes, edges), "weak")
    sizes = weak.groupBy("component").agg(F.count("*").alias("size"))
    lone = weak.join(merged(sizes.filter("size = 1")), "component", "left_semi").select("key", F.col("key").alias("scc"))
    key_type = weak.schema["key"].dataType.simpleString()
    some = weak.join(merged(sizes.filter(f"size between 2 and {small}").select("component")), "component")
    inner = edges.select("src", "dst").distinct().join(merged(some.withColumnRenamed("key", "src")), "src").select("component", "src", "dst")
    rows = some.select("component", F.col("key").alias("src"), F.lit(None).cast(key_type).alias("dst")).union(inner)
    # A group takes many weak components, most of which are tiny; as many nodes as there are groups' worth.
    groups = 1 + sizes.filter(f"size between 2 and {small}").agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] // GROUP
    grouped = rows.groupBy(F.pmod(F.xxhash64("component"), F.lit(groups))).applyInPandas(group_components, f"key {key_type}, scc {key_type}")
    large = written(weak.join(merged(sizes.filter(f"size > {small}").select("component")), "component", "left_semi").select("key"), "large")
    found = lone.union(grouped)
    if not large.isEmpty():
        found = found.union(coloured(large, edges))
    return found.join(merged(weak), "key")


def propagate(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, label) with each label lowered to the smallest that reaches the node along edges (src, dst)."""
    while True:
        step = edges.join(merged(labels.withColumnRenamed("key", "src")), "src").groupBy(F.col("dst").alias("key")).agg(F.min("label").alias("lower"))
        step = written(labels.join(merged(step), "key", "left").select("key", F.least("label", "lower").alias("label"), F.coalesce(F.col("lower") < F.col("label"), F.lit(False)).alias("changed")), "labels")
        labels = step.select("key", "label")
        if step.filter("changed").isEmpty():
            return labels


def coloured(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, scc) by rounds of colouring; each round settles the component of every colour's smallest node."""
    settled: DataFrame | None = None
    while True:
        ends = nodes.select("key")
        edges = written(edges.select("src", "dst").distinct().join(merged(ends.withColumnRenamed("key", "src")), "src", "left_semi").join(merged(ends.withColumnRenamed("key", "dst")), "dst", "left_semi").select("src", "dst"), "inner")
        colours = propagate(ends.withColumn("label", F.col("key")), edges)
        own = edges.join(merged(colours.select(F.col("key").alias("src"), F.col("label").alias("a"))), "src").join(merged(colours.select(F.col("key").alias("dst"), F.col("label").alias("b"))), "dst").filter("a = b").select("src", "dst")
        # Backwards from each colour's own node, inside the colour: a node that it reaches and that reaches it.
        back = own.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        high = colours.select("key", F.when(F.col("key") == F.col("label"), F.lit(0)).otherwise(F.lit(1)).alias("label"))
        inside = propagate(high, back).filter("label = 0").select("key")
        found = written(colours.join(merged(inside), "key", "left_semi").withColumnRenamed("label", "scc"), "coloured")
        settled = found if settled is None else settled.union(found)
        nodes = written(nodes.join(merged(found), "key", "left_anti").select("key"), "left")
        if nodes.isEmpty():
            return settled


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The distinct edges (src, dst) with both ends among nodes (key)."""
    keys = nodes.select("key")
    return edges.select("src", "dst").distinct().join(merged(keys.withColumnRenamed("key", "src")), "src", "left_semi").join(merged(keys.withColumnRenamed("key", "dst")), "dst", "left_semi").select("src", "dst")


def condensation(components: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct edges (src, dst) between different strong components (key, scc)."""
    a = components.select(F.col("key").alias("src"), F.col("scc").alias("a"))
    b = components.select(F.col("key").alias("dst"), F.col("scc").alias("b"))
    return edges.join(merged(a), "src").join(merged(b), "dst").filter("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def closure(pairs: DataFrame) -> DataFrame:
    """(node, ancestor) for pairs (node, parent): transitive, without a node itself unless a cycle gives it. Paths double each round."""
    known = written(pairs.select("node", F.col("parent").alias("ancestor")).distinct(), "closure")
    size = known.count()
    while True:
        longer = known.select("node", F.col("ancestor").alias("mid")).join(merged(known.select(F.col("node").alias("mid"), "ancestor")), "mid").select("node", "ancestor")
        known = written(known.union(longer).distinct(), "closure")
        if (now := known.count()) == size:
            return known
        size = now


def component_order(components: DataFrame, symbols: DataFrame) -> DataFrame:
    """(scc, scc_id, weak_id): dense ids in the order of each component's first member by file, line, column and key; a weak component
    is numbered by its first strong one. symbols has key, file, line, column, qualified_name and signature."""
    rows = components.join(merged(symbols), "key")
    first = rows.groupBy("scc", "component").agg(F.min(F.struct("qualified_name", "signature", "file", "line", "column", "key")).alias("f"))
    ranked = dense_ids(first.select("scc", "component", "f.file", "f.line", "f.column", "f.key"), ["file", "line", "column", "key"], "scc_id")
    weak = dense_ids(ranked.groupBy("component").agg(F.min("scc_id").alias("low")), ["low"], "weak_id").select("component", "weak_id")
    return ranked.join(merged(weak), "component").select("scc", "scc_id", "weak_id")
