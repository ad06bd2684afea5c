"""Joins that resolve names: selectors, manual roots, suffixes of qualified names, virtual dispatch, registrations, commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reachlake.operators.components import closure
from reachlake.operators.merge import require_empty
from reachlake.storage import merged, written

SELECTOR_FIELDS = ("id", "linkage_name", "qualified_name", "signature")


def selector_matches(selectors: DataFrame, symbols: DataFrame) -> DataFrame:
    """selectors (selector, and the four fields, empty where not asked for) with matches, the number of symbols all asked fields agree with, and
    the one key if there is one. Each kind of identity field is an equi-join of its own; the signature is what remains to test."""
    parts = []
    for field in SELECTOR_FIELDS[:3]:
        asked = selectors.filter(F.coalesce(F.col(field), F.lit("")) != "").filter(" and ".join(f"coalesce({other}, '') = ''" for other in SELECTOR_FIELDS[: SELECTOR_FIELDS.index(field)]) or "true")
        column = "key" if field == "id" else field
        rows = symbols.select(F.col(column).cast("string").alias(field), F.col("key"), F.col("signature").alias("own_signature"))
        hit = asked.join(rows, field).filter("coalesce(signature, '') = '' or signature = own_signature")
        parts.append(hit.select("selector", "key"))
    hits = parts[0].union(parts[1]).union(parts[2]).distinct().groupBy("selector").agg(F.count("*").alias("matches"), F.min("key").alias("key"))
    return selectors.select("selector").join(hits, "selector", "left").select("selector", F.coalesce("matches", F.lit(0)).alias("matches"), F.when(F.col("matches") == 1, F.col("key")).alias("key"))


def resolve_unique(selectors: DataFrame, symbols: DataFrame) -> DataFrame:
    """(selector, key); fails unless every selector names exactly one symbol."""
    found = selector_matches(selectors, symbols)
    for row in found.filter("matches <> 1").join(selectors, "selector").orderBy("selector").limit(1).collect():
        raise ValueError(f"{described(row)} of {row.selector} matched {row.matches} symbols")
    return found.select("selector", "key")


def described(selector: Row) -> str:
    """What a selector asks for: the first identity that it gives, and the signature that goes with a name."""
    field = next(f for f in SELECTOR_FIELDS if selector[f])
    return f"{field} '{selector[field]}'" + (f" with signature '{selector.signature}'" if field == "qualified_name" and selector.signature else "")


def manual_roots(requests: DataFrame, symbols: DataFrame) -> DataFrame:
    """(request, key) for requests by qualified name, linkage name or key; one may name many symbols. key is null for a request that names none."""
    names = symbols.select("key", F.explode(F.array_distinct(F.array("qualified_name", "linkage_name", F.col("key").cast("string")))).alias("request")).filter("request <> ''")
    return requests.select("request").distinct().join(names.distinct(), "request", "left")


def last_component(name: Column) -> Column:
    return F.element_at(F.split(name, "::"), -1)


def suffixes(name: Column) -> Column:
    """The name and what follows each of its colons, as far as the last component stays the same."""
    pieces = F.split(name, ":")
    ends = F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda i: F.array_join(F.slice(pieces, i, F.size(pieces)), ":"))
    return F.filter(ends, lambda x: last_component(x) == last_component(name))


def suffix_join(left: DataFrame, name: str, right: DataFrame, other: str) -> DataFrame:
    """Rows whose names are equal or of which left's ends in '::' and right's. Equal last components are the join's key; the suffix is the residue."""
    joined = left.withColumn("_last", last_component(F.col(name))).join(right.withColumn("_last", last_component(F.col(other))), "_last")
    return joined.filter((F.col(name) == F.col(other)) | F.endswith(F.col(name), F.concat(F.lit(":"), F.col(other)))).drop("_last")


#: Keys in a block of left's and of right's rows (about: a hash deals them), and pairs of a task (about).
LEFT_BLOCK, RIGHT_BLOCK, TASK_PAIRS = 4096, 1024, 1 << 23


def blocks(rows: DataFrame, key: str, total: str, size: int) -> DataFrame:
    """(_suffix, column key): the keys of each suffix in arrays of about size, for as many rows as total says. They are sorted, so a lost task's rows come back the same."""
    return rows.groupBy("_suffix", F.pmod(F.xxhash64(key), F.ceil(F.col(total) / size)).alias("_block")).agg(F.sort_array(F.collect_list(key)).alias(key)).drop("_block")


def suffix_pairs(left: DataFrame, name: str, key: str, right: DataFrame, other: str, other_key: str) -> DataFrame:
    """(key, other_key) of the rows that suffix_join gives, where few names make many times more pairs than rows; rows without a key have none. Names are matched first, each
    once, which tells the number of pairs. What is dealt are pairs of blocks of keys, over tasks in proportion to the pairs, so no task gets a frequent name."""
    asked = right.groupBy(F.col(other).alias("_suffix")).agg(F.count("*").alias("_right"))
    given = left.groupBy(F.col(name).alias("_name")).agg(F.count("*").alias("_rows")).withColumn("_suffix", F.explode(suffixes(F.col("_name"))))
    links = written(given.join(asked, "_suffix"), "links")
    sizes = links.groupBy("_suffix").agg(F.sum("_rows").alias("_left"), F.max("_right").alias("_right"))
    tasks = -(-(sizes.agg(F.sum(F.col("_left") * F.col("_right"))).first()[0] or 1) // TASK_PAIRS)
    held = left.select(F.col(name).alias("_name"), key).join(links.select("_name", "_suffix"), "_name").join(sizes, "_suffix")
    asks = right.select(F.col(other).alias("_suffix"), other_key).join(sizes, "_suffix")
    units = merged(blocks(asks, other_key, "_right", RIGHT_BLOCK)).join(blocks(held, key, "_left", LEFT_BLOCK), "_suffix").select(key, other_key).repartition(tasks)
    # This coalesce moves nothing: it keeps both explodes out of one generated loop, which would hold all pairs of two blocks before it gives the first.
    return units.withColumn(other_key, F.explode(other_key)).coalesce(tasks).withColumn(key, F.explode(key))


def virtual_dispatch(methods: DataFrame, bases: DataFrame) -> DataFrame:
    """(src, dst): from each virtual method of an ancestor to the method of the same name and signature in a descendant.
    methods has key, class_name, name, signature, is_virtual; bases has class_name and base."""
    above = closure(bases.select(F.col("class_name").alias("node"), F.col("base").alias("parent"))).filter("node <> ancestor")
    base = methods.filter("is_virtual").select(F.col("key").alias("src"), F.col("class_name").alias("ancestor"), "name", "signature")
    derived = methods.select(F.col("key").alias("dst"), F.col("class_name").alias("node"), "name", "signature")
    return above.join(base, "ancestor").join(derived, ["node", "name", "signature"]).select("src", "dst").distinct()


def resolve_bases(bases: DataFrame, classes: DataFrame) -> DataFrame:
    """bases (class_name, base) with base resolved to a class: by its exact name, else in the scope of the derived class, else by suffix, of which the smallest is taken."""
    known = classes.select(F.col("class_name").alias("found")).distinct()
    scope = F.regexp_extract("class_name", r"^(.*)::[^:]*$", 1)
    rows = bases.distinct().withColumn("_sibling", F.when(scope == "", F.col("base")).otherwise(F.concat(scope, F.lit("::"), F.col("base"))))
    rows = rows.join(known.withColumnsRenamed({"found": "exact"}), F.col("base") == F.col("exact"), "left").join(known.withColumnsRenamed({"found": "near"}), F.col("_sibling") == F.col("near"), "left")
    far = suffix_join(known, "found", bases.select("base").distinct(), "base").groupBy("base").agg(F.min("found").alias("far"))
    return rows.join(far, "base", "left").select("class_name", F.coalesce("exact", "near", "far", "base").alias("base"))


def registrations(calls: DataFrame, rules: DataFrame, arguments: DataFrame) -> DataFrame:
    """(src, dst, rule): callables passed where a rule says so. calls has call, src, callee; rules has rule, callee, argument_index; arguments has call, position, dst.
    Fails if a rule matches no call, or an argument is missing or no callable."""
    matched = calls.join(F.broadcast(rules), "callee")
    require_empty(rules.join(matched.select("rule").distinct(), "rule", "left_anti").select("rule"), "callback rule did not match a registrar call")
    passed = matched.join(arguments.withColumnRenamed("position", "argument_index"), ["call", "argument_index"], "left")
    require_empty(passed.filter("dst is null").select("rule", "call"), "callback argument is not a callable")
    return passed.select("src", "dst", "rule").distinct()


def preferred_commands(sources: DataFrame, commands: DataFrame, same: list[str]) -> DataFrame:
    """The command of each source: of those for its file the best preference (0 is best), then the first by index. ambiguous tells if the best ones differ in
    the columns of `same`. sources has source; commands has source, preference, index."""
    equal = F.to_json(F.struct(*same))
    best = Window.partitionBy("source")
    rows = sources.select("source").distinct().join(commands, "source", "left").withColumn("_least", F.min("preference").over(best)).filter("preference is null or preference = _least")
    return rows.groupBy("source").agg(F.min_by(F.struct(*[c for c in commands.columns if c != "source"]), "index").alias("c"), (F.min(equal) != F.max(equal)).alias("ambiguous")).select("source", "c.*", F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))


def lines_of_offsets(files: DataFrame, offsets: DataFrame) -> DataFrame:
    """(file, offset, line): line numbers from 1. files has file and text. Line starts and offsets are merged and ordered once per file (as-of), so there is no range join."""
    parts = F.split("text", "\n")
    starts = files.select("file", F.posexplode(parts)).select("file", (F.col("pos") + 1).alias("line"), F.sum(F.octet_length("col") + 1).over(Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)).alias("offset"))
    starts = starts.select("file", F.coalesce("offset", F.lit(0)).cast("long").alias("offset"), "line", F.lit(0).alias("asks"))
    asked = offsets.select("file", F.col("offset").cast("long").alias("offset"), F.lit(None).cast("int").alias("line"), F.lit(1).alias("asks"))
    order = Window.partitionBy("file").orderBy("offset", "asks").rowsBetween(Window.unboundedPreceding, 0)
    return starts.union(asked).withColumn("line", F.last("line", ignorenulls=True).over(order)).filter("asks = 1").select("file", "offset", "line")


def stale_units(manifest: DataFrame, current: DataFrame) -> DataFrame:
    """(unit, valid): a unit's facts are valid if every dependency has its stored digest and its primary source is among them.
    manifest has unit, path, digest, is_primary; current has path and digest."""
    now = current.select("path", F.col("digest").alias("now"))
    same = F.coalesce(F.col("digest") == F.col("now"), F.lit(False))
    return manifest.join(now, "path", "left").groupBy("unit").agg((F.bool_and(same) & F.bool_or("is_primary")).alias("valid"))
