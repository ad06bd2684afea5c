"""Registered queries over inputs and outputs of a run: AST dumps, build descriptions, paths and identities, policies, the store and the documents.

Their inputs are made from the driver's tables: a supplier is a translation unit whose functions are the parts it sells, and a nation
is a build target whose sources are its suppliers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reachlake.functions import keys
from reachlake.functions.text import owned_class, shell_words, uri_encoded
from reachlake.operators import diff
from reachlake.operators.extract import Project, extract, unknown_factories, used_nodes
from reachlake.plans.selection import select_commands
from reachlake.schema import Facts
from reachlake.sinks.artifact import read_artifact, write_artifact_parts
from reachlake.sinks.documents import Context, write_sarif_parts
from reachlake.sources import policies, tables
from reachlake.sources.ast import ast_nodes
from reachlake.sources.builds import dependencies_of, normalized_commands, read_compile_commands, read_target_manifest
from reachlake.storage import new_path, written
from reachlake.streaming.store import FactStore, ingest_stream, unit_key

Query = Callable[[SparkSession, str], DataFrame]


def text(form: str, *columns: Column) -> Column:
    """The form with each {} replaced by a column."""
    pieces = form.split("{}")
    out = [F.lit(pieces[0])]
    for column, piece in zip(columns, pieces[1:], strict=True):
        out += [column.cast("string"), F.lit(piece)]
    return F.concat(*out)


def sold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s, parts): suppliers and the parts they sell, in order, dealt by supplier to as many tasks as a shuffle has; the dumps made of them weigh far more than these rows, by which adaptive execution would make few tasks."""
    pairs = tables.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p"))
    pairs = pairs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "s").distinct()
    return pairs.groupBy("s").agg(F.sort_array(F.collect_list("p")).alias("parts"))


def node_texts(node: Callable[[Column, Column], Column]) -> Column:
    """The nodes of a supplier's parts, each from its part and the next one. Only keys are grouped and sorted, and texts made of them afterwards."""
    return F.array_join(F.transform("parts", lambda p, i: node(p, F.get("parts", i + 1))), ",")


def dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unit, text): a dump per supplier. A function uses the next part of its supplier in one of six ways, by its number; some stand in
    system headers or outside the reported folder. Each unit has a namespace-scope variable that calls its first function."""
    ref = lambda x: text('{"kind":"DeclRefExpr","referencedDecl":{"id":"0x{}","kind":"FunctionDecl","name":"f{}"}}', x, x)
    call = lambda *x: text('{"kind":"CallExpr","inner":[{}]}', F.concat_ws(",", *x))

    def node(p: Column, q: Column) -> Column:
        local = text('{"kind":"DeclStmt","inner":[{"kind":"VarDecl","id":"0xv{}","name":"v","inner":[{}]}]},', p, ref(q))
        through = text('{"kind":"CallExpr","inner":[{"kind":"DeclRefExpr","referencedDecl":{"id":"0xv{}","kind":"VarDecl","name":"v"}}]}', p)
        stored = text('{"kind":"CXXConstructExpr","type":{"qualType":"std::function<void ()>"},"inner":[{}]}', ref(q))
        use = F.when(q.isNull(), "").when(p % 6 == 0, call(ref(q))).when(p % 6 == 1, ref(q)).when(p % 6 == 2, call(ref(q), ref(q))).when(p % 6 == 3, stored).otherwise(F.concat(local, through))
        body = F.when(p % 6 == 5, "").otherwise(text('{"kind":"CompoundStmt","inner":[{}]}', use))
        file = F.when(p % 10 == 9, "/usr/include/x.h").when(p % 10 == 8, "/p/lib/x.cpp").otherwise("/p/src/f.cpp")
        form = '{"id":"0x{}","kind":"FunctionDecl","name":"f{}","mangledName":"_Zf{}","type":{"qualType":"void ()"},"loc":{"file":"{}","line":{},"col":1,"offset":{}},"range":{"end":{"line":{}}},"inner":[{}]}'
        return text(form, p, p, p, file, p + 1, p, p + 2, body)

    unit = text("/p/src/s{}.cpp", F.col("s"))
    variable = text('{"kind":"VarDecl","id":"0xg","name":"g","loc":{"file":"{}","line":1},"inner":[{}]}', F.when(F.col("s") % 2 == 1, unit).otherwise("/usr/include/g.h"), call(ref(F.get("parts", F.lit(0)))))
    return sold(spark, sf_dir).select(unit.alias("unit"), text('{"kind":"TranslationUnitDecl","id":"0x","inner":[{},{}]}', node_texts(node), variable).alias("text"))


def extracted(spark: SparkSession, sf_dir: str) -> Facts:
    return extract(ast_nodes(dumps(spark, sf_dir)), Project("/p", ["/p/src"]))


def number(facts: Facts, rows: DataFrame, **ends: str) -> DataFrame:
    """rows with the part numbers of the symbols that these columns name."""
    own = facts.symbols.select("key", F.substring("identity.linkage_name", 4, 20).cast("long").alias("n"))
    for old, new in ends.items():
        rows = rows.join(own.withColumnsRenamed({"key": old, "n": new}), old, "left").drop(old)
    return rows


def extracted_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = extracted(spark, sf_dir)
    return number(facts, facts.symbols.select(F.col("key").alias("symbol"), "scope", "defined", F.col("source.spelling.location.line").alias("line")), symbol="id")


def extracted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = extracted(spark, sf_dir)
    return number(facts, facts.edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "kind"), a="src", b="dst").distinct()


def extracted_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = extracted(spark, sf_dir)
    return number(facts, facts.roots.select("symbol", "kind"), symbol="id").distinct()


def extracted_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = extracted(spark, sf_dir)
    return number(facts, facts.escapes.select("symbol", F.col("from").alias("by"), "kind"), symbol="id", by="from_id").distinct()


def exported_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The public definitions of a shared library whose units are three in four suppliers, each compiled with visibility flags of its own."""
    key = F.col("s_suppkey")
    flags = F.when(key % 3 == 0, F.array(F.lit("-fvisibility=hidden"))).when(key % 3 == 1, F.array(F.lit("-fvisibility=hidden"), F.lit("-fvisibility=default"))).otherwise(F.array(F.lit("-O2")))
    exports = tables.table(spark, sf_dir, "supplier").filter(key % 4 != 3).select(text("/p/src/s{}.cpp", key).alias("unit"), flags.alias("arguments"))
    facts = extract(ast_nodes(dumps(spark, sf_dir)), Project("/p", ["/p/src"], exports=exports))
    return number(facts, facts.roots.filter("kind = 'public_api'").select("symbol", "kind"), symbol="id").distinct()


def removed_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a comparison shows of symbols that are gone: as the baseline had them."""
    changed = diff.changes(*tables.diff_pair(spark, sf_dir)).filter("change = 'removed'")
    return changed.select(F.col("key").alias("id"), *[F.col(f"symbol.{c}").alias(c) for c in ("qualified_name", "signature", "linkage_name", "kind", "scope", "file", "line")])


def factory_dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unit, text): a dump per supplier, with a function f<supplier>_<part> that gets an owning pointer of class C<part modulo 20> from the standard factory, from one of its own, or from an expression without a name,
    and with the even ones of these classes."""
    s = F.col("s")
    unit = text("/p/src/s{}.cpp", s)

    def node(p: Column, _: Column) -> Column:
        helper = F.when(p % 3 == 0, "make_unique").otherwise(text("create{}", p % 7))
        callee = F.when(p % 3 == 2, '{"kind":"ParenExpr","inner":[]}').otherwise(text('{"kind":"ImplicitCastExpr","inner":[{"kind":"DeclRefExpr","referencedDecl":{"id":"0xh","kind":"FunctionDecl","name":"{}"}}]}', helper))
        call = text('{"kind":"CallExpr","valueCategory":"prvalue","type":{"qualType":"std::unique_ptr<C{}>"},"inner":[{}]}', p % 20, callee)
        return text('{"id":"0x{}","kind":"FunctionDecl","name":"f","mangledName":"_Zf{}_{}","type":{"qualType":"void ()"},"loc":{"file":"{}","line":{},"col":1},"inner":[{"kind":"CompoundStmt","inner":[{}]}]}', p, s, p, unit, p, call)

    owned = F.concat_ws(",", *[F.lit(f'{{"id":"0xC{i}","kind":"CXXRecordDecl","name":"C{i}","inner":[{{"id":"0xd{i}","kind":"CXXDestructorDecl","name":"~C{i}","mangledName":"_Zd{i}","type":{{"qualType":"void ()"}},"loc":{{"file":"/p/src/c.h","line":{i + 1},"col":1}},"inner":[{{"kind":"CompoundStmt"}}]}}]}}') for i in range(0, 20, 2)])
    return sold(spark, sf_dir).select(unit.alias("unit"), text('{"kind":"TranslationUnitDecl","id":"0x","inner":[{},{}]}', owned, node_texts(node)).alias("text"))


def owning_factories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which classes are constructed and destroyed through owning pointers, by what kind of factory and from how many functions; and the factories that aren't known."""
    nodes = used_nodes(ast_nodes(factory_dumps(spark, sf_dir)))
    edges = extract(nodes, Project("/p", ["/p/src"])).edges.filter("kind = 'constructs'")
    made = edges.groupBy(F.when(F.contains("evidence.reason", F.lit("taken to be")), "taken").otherwise("made").alias("how")).agg(F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("classes"))
    unknown = unknown_factories(nodes)
    return made.union(unknown.groupBy(F.col("helper").alias("how")).agg(F.lit(None).cast("long").alias("sources"), F.countDistinct("built").alias("classes")))


def place_dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unit, text): a dump per supplier, whose function f<supplier>_<part> stands, by its part's number: 0 in the unit; 1 in a macro, spelled in a header and expanded in the unit; 2 in
    the unit, by a place that leaves out the file and has no end; 3 in a header; 4 in a header whose name is left out. A variable that stands in the unit comes before each, and calls it."""
    s = F.col("s")
    unit = text("/p/src/s{}.cpp", s)

    def node(p: Column, _: Column) -> Column:
        spelled = lambda offset, line, size: text('"spellingLoc":{"offset":{},"file":"/p/include/m.h","line":{},"col":3,"tokLen":{}}', *map(F.lit, (offset, line, size)))
        expanded = text('"expansionLoc":{"offset":{},"file":"{}","line":{},"col":1,"tokLen":6}', p, unit, p + 1)
        macro = lambda *x: F.concat(F.lit("{"), spelled(*x), F.lit(","), expanded, F.lit("}"))
        end = text('{"offset":{},"line":{},"col":1,"tokLen":1}', p + 50, p + 3)
        begin = text('{"offset":{},"col":1,"tokLen":4}', p)
        place = F.when(p % 5 == 0, text('"loc":{"offset":{},"file":"{}","line":{},"col":6,"tokLen":2},"range":{"begin":{},"end":{}}', p, unit, p + 1, begin, end))
        place = place.when(p % 5 == 1, text('"loc":{},"range":{"begin":{},"end":{}}', *(macro(*x) for x in ((100, 7, 3), (90, 6, 4), (140, 8, 1)))))
        place = place.when(p % 5 == 2, text('"loc":{"offset":{},"line":{},"col":6,"tokLen":2},"range":{"begin":{}}', p, p + 1, begin))
        place = place.when(p % 5 == 3, text('"loc":{"offset":{},"file":"/p/include/h.h","line":{},"col":6,"tokLen":2,"includedFrom":{"file":"{}"}},"range":{"end":{}}', p, p + 1, unit, end))
        place = place.otherwise(text('"loc":{"offset":{},"line":{},"col":6,"tokLen":2,"includedFrom":{"file":"/p/include/h.h"}},"range":{"begin":{"offset":{},"col":1,"tokLen":4,"includedFrom":{"file":"/p/include/h.h"}}}', p, p + 1, p))
        variable = text('{"kind":"VarDecl","id":"0xv{}","name":"v{}","loc":{"offset":0,"file":"{}","line":{},"col":1},"inner":[{"kind":"CallExpr","inner":[{"kind":"DeclRefExpr","referencedDecl":{"id":"0x{}","kind":"FunctionDecl"}}]}]}', p, p, unit, p, p)
        return text('{},{"id":"0x{}","kind":"FunctionDecl","name":"f","mangledName":"_Zf{}_{}","type":{"qualType":"void ()"},{},"inner":[{"kind":"CompoundStmt"}]}', variable, p, s, p, place)

    return sold(spark, sf_dir).select(unit.alias("unit"), text('{"kind":"TranslationUnitDecl","id":"0x","loc":{},"range":{"begin":{},"end":{}},"inner":[{}]}', *[F.lit("{}")] * 3, node_texts(node)).alias("text"))


def extracted_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where functions are spelled and expanded."""
    facts = extract(ast_nodes(place_dumps(spark, sf_dir)), Project("/p", ["/p/src"]))
    ids = F.split("identity.linkage_name", "[f_]")
    shown = lambda track, point: F.concat_ws(":", *[F.col(f"source.{track}.{point}.{c}") for c in ("file", "line", "column", "offset", "token_length")]).alias(f"{track}_{point}")
    places = [F.when(F.col(f"source.{t}").isNotNull(), shown(t, p)).alias(f"{t}_{p}") for t in ("spelling", "expansion") for p in ("location", "begin", "end")]
    return facts.symbols.select(F.element_at(ids, -2).cast("long").alias("s"), F.element_at(ids, -1).cast("long").alias("p"), "scope", "defined", *places)


def artifact_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extracted facts, written as a graph artifact by the executors and read again, by its lines, with all its checks."""
    path = new_path(spark, "artifact")
    write_artifact_parts(path, extracted(spark, sf_dir), Context("default"), ["a note"])
    facts, _ = read_artifact(spark, path, keys.stable_key)
    return number(facts, facts.edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "kind"), a="src", b="dst").distinct()


def type_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, brand = F.col("p_partkey"), F.regexp_replace("p_brand", "#", "")
    spelled = F.when(key % 4 == 0, text("const struct {} &", brand)).when(key % 4 == 1, text("volatile {} *const ", brand)).when(key % 4 == 2, text("class {}**", brand)).otherwise(brand)
    pointer = F.when(key % 3 == 0, "unique_ptr").when(key % 3 == 1, "__1::shared_ptr").otherwise("weak_ptr")
    owner = text("const std::{}<{}{}, D> &", pointer, spelled, F.when(key % 5 == 0, "[]").otherwise(""))
    return tables.table(spark, sf_dir, "part").select(key.alias("id"), keys.normalized_type(spelled).alias("plain"), owned_class(owner).alias("owned"))


def command_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    line = text("""cc -DA='{} x' "-DB=\\"{}\\""\t-DC=a\\ b\\\\\n {}""", F.col("o_orderpriority"), F.col("o_orderstatus"), key)
    return tables.table(spark, sf_dir, "orders").select(key.alias("id"), F.array_join(shell_words(line), "|").alias("words"))


def analysis_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    start = F.when(key % 3 == 0, F.array(F.lit("/usr/bin/ccache"), F.lit("arm-linux-g++-13.2"))).otherwise(F.array(F.lit("clang++")))
    more = F.when(key % 2 == 0, F.array(*map(F.lit, ("-o", "x.o", "-MD", "-MFx.d", "-Wp,-MD,x.d", "-Xclang", "-dependency-file", "-Xclang", "x.d")))).otherwise(F.array(F.lit("--output=y.o"), F.lit("-c"), F.lit("-include-pch"), F.lit("../pch.h")))
    arguments = F.concat(start, F.array(text("-DN={}", key), text("./f{}.cpp", key)), more)
    orders = tables.table(spark, sf_dir, "orders")
    commands = orders.select(F.lit("/p/build").alias("directory"), text("f{}.cpp", key).alias("file"), F.lit("").alias("output"), arguments.alias("arguments"), key.alias("index"))
    return normalized_commands(commands).select(F.col("index").alias("id"), F.array_join("arguments", "|").alias("arguments"), F.array_join("command_inputs", "|").alias("inputs"))


def compile_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commands of a compilation database with two entries per supplier, one of them under a foreign target's folder."""
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    output = lambda target: text("CMakeFiles/{}.dir/s{}.o", target, key)
    entry = lambda target, words: F.struct(F.lit("/p/build").alias("directory"), text("../src/s{}.cpp", key).alias("file"), output(target).alias("output"), *words(target))
    shell = lambda target: [text("g++ -c '../src/s{}.cpp' -o {} -DX={}", key, output(target), target).alias("command")]
    words = lambda target: [F.array(F.lit("g++"), F.lit("-c"), F.lit("-o"), output(target), text("-DX={}", target), text("../src/s{}.cpp", key)).alias("arguments")]
    own = text("t{}", nation)
    pair = F.when(key % 2 == 0, F.concat(F.to_json(entry(F.lit("other"), shell)), F.lit(","), F.to_json(entry(own, shell)))).otherwise(F.concat(F.to_json(entry(F.lit("other"), words)), F.lit(","), F.to_json(entry(own, words))))
    # A line for each supplier, between the brackets; Spark writes the document in parts.
    lines = tables.table(spark, sf_dir, "supplier").select(key.alias("nth"), pair.alias("value"))
    last = lines.agg(F.max("nth")).first()[0]
    body = lines.select("nth", F.when(F.col("nth") < last, F.concat("value", F.lit(","))).otherwise(F.col("value")).alias("value"))
    ends = spark.range(2).select(F.when(F.col("id") == 0, -1).otherwise(last + 1).alias("nth"), F.when(F.col("id") == 0, "[").otherwise("]").alias("value"))
    path = new_path(spark, "database")
    body.unionByName(ends).orderBy("nth").select("value").write.text(path)
    return read_compile_commands(spark, path)


def compile_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compile_database(spark, sf_dir).select("index", "directory", "file", "output", F.array_join("arguments", "|").alias("arguments"))


def manifest(spark: SparkSession, sf_dir: str):
    """A target per nation, whose sources are its suppliers; nation n links nation 2n + 1. Nation 0 is the program."""
    nation, supplier = tables.table(spark, sf_dir, "nation"), tables.table(spark, sf_dir, "supplier")
    n = F.col("n_nationkey")
    sources = supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.sort_array(F.collect_list(text("src/s{}.cpp", F.col("s_suppkey")))).alias("sources"))
    count = nation.count()
    below = F.when(2 * n + 1 < count, F.array(text("n{}", 2 * n + 1))).otherwise(F.array().cast("array<string>"))
    target = F.struct(text("n{}", n).alias("id"), text("t{}", n).alias("name"), F.when(n == 0, "executable").otherwise("static_library").alias("type"), F.coalesce("sources", F.array().cast("array<string>")).alias("sources"), below.alias("dependencies"), F.array(text("include/t{}.h", n)).alias("public_headers"), F.array(text("t{}.a", n)).alias("artifacts"))
    rows = nation.join(sources, "n_nationkey", "left").agg(F.to_json(F.sort_array(F.collect_list(target))).alias("targets"))
    path = new_path(spark, "manifest")
    rows.select(text('{"schema_version":2,"source_root":"/p","build_root":"/p/build","configurations":[{"name":"debug","targets":{}}]}', F.col("targets")).alias("value")).coalesce(1).write.text(path)
    return read_target_manifest(spark, path)


def manifest_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    build = manifest(spark, sf_dir)
    return build.sources.join(build.targets, ["configuration", "id"]).join(build.headers.withColumnRenamed("path", "header"), ["configuration", "id"]).join(build.artifacts.withColumnRenamed("path", "artifact"), ["configuration", "id"])


def target_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One command per source of the program and of what it links: that of the target's own object folder."""
    chosen = select_commands(manifest(spark, sf_dir), compile_database(spark, sf_dir), "debug", "t0")
    return chosen.commands.select("index", "file")


def depfile_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    rule = text("s{}.o: /p/src/s{}.cpp \\\n  /p/include/a\\ b{}.h \\\r\n c\\\\d.h", key, key, F.col("s_nationkey"))
    return dependencies_of(tables.table(spark, sf_dir, "supplier").select(key.cast("string").alias("path"), rule.alias("text")))


def file_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    path = F.when(key % 5 == 0, text("/p/src/{}.cpp", key)).when(key % 5 == 1, text("/p/src/gen/{}.cpp", key)).when(key % 5 == 2, text("/p/lib/{}.cpp", key)).when(key % 5 == 3, text("/p2/src/{}.cpp", key)).otherwise("")
    listed = lambda *x: F.array(*map(F.lit, x))
    scope = keys.scope_of(path, F.lit("/p/"), listed("/p/src", "/p/tools"), listed("/p/src/gen"))
    return tables.table(spark, sf_dir, "part").select(key.alias("id"), scope.alias("scope"), keys.relative_to(F.lit("/p"), path).alias("shown"))


def display_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.symbols(spark, sf_dir)
    name = F.when(F.col("key") % 11 == 0, "").otherwise(F.col("qualified_name"))
    line = F.when(F.col("key") % 4 == 0, 0).otherwise(F.col("begin_line"))
    return rows.select(F.col("key").alias("id"), keys.display_symbol(name, F.col("signature"), F.col("linkage_name")).alias("shown"), keys.display_location(F.col("file"), line, F.col("key") % 3).alias("place"), keys.rule_id(F.col("kind"), F.col("scope")).alias("rule"))


def fallback_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.symbols(spark, sf_dir)
    linkage, usr = F.when(F.col("key") % 3 == 0, F.col("linkage_name")), F.when(F.col("key") % 3 == 1, F.lit("u"))
    return rows.select(
        F.col("key").alias("id"), keys.fallback_anchor(keys.qualified_name(F.col("class_name"), F.col("name")), F.col("signature"), F.coalesce("file", F.lit("")), F.col("begin_line")).alias("anchor"), keys.identity_quality(linkage, usr).alias("quality"),
        keys.internal_linkage(F.col("key") % 2 == 0, F.when(F.col("key") % 5 == 0, "_ZLx").otherwise(F.col("linkage_name")), F.when(F.col("key") % 7 == 0, "(anonymous namespace)::x").otherwise(F.col("qualified_name"))).alias("internal"),
    )


def export_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    attribute = F.when(key % 4 == 0, "default").when(key % 4 == 1, "hidden").when(key % 4 == 2, "protected").otherwise("")
    arguments = F.when(key % 3 == 0, F.array(F.lit("-fvisibility=hidden"), F.lit("-O2"))).when(key % 3 == 1, F.array(F.lit("-fvisibility=hidden"), F.lit("-fvisibility=default"))).otherwise(F.array().cast("array<string>"))
    return tables.table(spark, sf_dir, "part").select(key.alias("id"), keys.export_visibility(attribute, arguments).alias("exported"))


def provider_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with what a policy adds: roots by linkage name, public roots by qualified name, suppressions by key."""
    facts = tables.facts(spark, sf_dir)
    own, blank = facts.symbols, F.lit("")
    entry = lambda rows, fact, **by: rows.select(F.lit("team").alias("provider"), F.lit(fact).alias("fact"), F.col("key").cast("int").alias("entry"), F.lit("symbol").alias("role"), *[by.get(c, blank).cast("string").alias(c) for c in ("id", "linkage_name", "qualified_name")], blank.alias("signature"), F.lit(None).cast("int").alias("argument_index"), F.lit("wanted").alias("reason"))
    policy = entry(own.filter("key % 50 = 3"), "roots", linkage_name=F.col("linkage_name")).union(entry(own.filter("key % 60 = 4"), "public_api_roots", qualified_name=F.col("qualified_name"))).union(entry(own.filter("key % 70 = 5"), "suppressions", id=F.col("key")))
    more = policies.apply_provider_policies(facts, written(policy, "policy"))
    return more.roots.groupBy("kind").agg(F.count("*").alias("n")).union(more.suppressions.agg(F.lit("suppression"), F.count("*")))


def uri_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), uri_encoded(text("src/{}/é {}.cpp", F.col("p_brand"), F.col("p_name"))).alias("uri"))


def unit_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "supplier")
    return rows.select(F.col("s_suppkey").alias("id"), unit_key({"file": text("/p/src/s{}.cpp", F.col("s_suppkey")), "arguments": F.col("s_name"), "configuration": F.lit("debug")}).alias("unit_key"))


def store_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over a fact store: units whose dependency has changed are published anew, the others are reused."""
    supplier, nation = tables.table(spark, sf_dir, "supplier"), tables.table(spark, sf_dir, "nation")
    digest = lambda x: F.sha2(x.cast("string").cast("binary"), 256)
    key, path = F.col("s_suppkey").cast("string").alias("unit"), F.col("s_nationkey").cast("string").alias("path")
    now = digest(F.when(F.col("n_nationkey") % 5 == 0, -1 - F.col("n_nationkey")).otherwise(F.col("n_nationkey")))
    store = FactStore(spark, new_path(spark, "store"))
    rows = lambda value, of: of.select("unit", F.lit(value).alias("made"))
    units = supplier.select(key, path, F.col("s_nationkey"))
    store.publish({"facts": rows("first", units)}, units.select("unit", "path", digest(F.col("s_nationkey")).alias("digest"), F.lit(True).alias("is_primary")))
    current = nation.select(F.col("n_nationkey").cast("string").alias("path"), now.alias("digest"))
    again = units.join(store.valid_units(current), "unit", "left_anti")
    store.publish({"facts": rows("second", again)}, again.join(current, "path").select("unit", "path", "digest", F.lit(True).alias("is_primary")))
    return store.table("facts").select("unit", "made")


def store_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store that a batch run has filled with every brand, into which two streams of files bring brands by micro-batches: one those that end in 1 or 2 and the other those
    that end in 3 or 4. Both count their batches from 0. The first is then read again from a new checkpoint, and once more from its old one, where nothing is new."""
    parts = tables.table(spark, sf_dir, "part")
    maker = F.expr("right(p_brand, 1)").cast("int")
    rows = parts.select(F.col("p_brand").alias("unit"), F.col("p_partkey").alias("key"), maker.alias("maker"))
    store = FactStore(spark, new_path(spark, "store"))

    def split(made: str, batch: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
        return {"symbols": batch.withColumn("made", F.lit(made))}, batch.select("unit", F.col("unit").alias("path"), F.sha2("unit", 256).alias("digest"), F.lit(True).alias("is_primary")).distinct()

    def ingest(made: str, source: str, checkpoint: str) -> None:
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
        ingest_stream(stream, store, lambda batch: split(made, batch), checkpoint).awaitTermination()

    store.publish(*split("batch run", rows))
    sources, checkpoints = [new_path(spark, "arrivals") for _ in range(2)], [new_path(spark, "progress") for _ in range(3)]
    for source, makers in zip(sources, ("maker in (1, 2)", "maker in (3, 4)"), strict=True):
        rows.filter(makers).repartition(3, "unit").write.parquet(source)
    ingest("first stream", sources[0], checkpoints[0])
    ingest("second stream", sources[1], checkpoints[1])
    ingest("first stream again", sources[0], checkpoints[2])
    ingest("not read", sources[0], checkpoints[0])
    return store.table("symbols").groupBy("unit", "made").agg(F.count("*").alias("n"), F.countDistinct("key").alias("n_keys"))


def sarif_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results of the SARIF document of a comparison."""
    policy = diff.Policy(changes=("newly_unreachable", "new_symbol"), classifications=("dead", "likely_dead"))
    baseline, current = tables.diff_pair(spark, sf_dir)
    path = new_path(spark, "sarif")
    write_sarif_parts(path, written(diff.changes(baseline, current, policy), "changes"), current.symbols)
    schema = "ruleId string, partialFingerprints struct<`reachlakeSymbolKey/v1`: string>, locations array<struct<physicalLocation: struct<artifactLocation: struct<uri: string>>>>"
    results = spark.read.text(path).filter(F.startswith("value", F.lit("      {"))).select(F.from_json(F.regexp_replace("value", ",$", ""), schema, {"mode": "FAILFAST"}).alias("r"))
    return results.select(F.col("r.partialFingerprints")["reachlakeSymbolKey/v1"].cast("long").alias("id"), F.col("r.ruleId").alias("rule"), F.get("r.locations", F.lit(0))["physicalLocation"]["artifactLocation"]["uri"].alias("uri"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        extracted_symbols, extracted_edges, extracted_roots, extracted_escapes, extracted_places, exported_roots, removed_symbols, owning_factories, artifact_round_trip, type_spellings, command_words, analysis_commands, compile_commands, manifest_sources, target_commands, depfile_dependencies, file_scopes,
        display_texts, fallback_identities, export_visibility, provider_facts, uri_paths, unit_keys, store_reuse, store_stream, sarif_results,
    )
}
