"""Readers, policies, small text functions and the fact store."""

import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from reachlake.functions import keys
from reachlake.functions.text import callee_and_index, expand_responses, is_compiler, is_launcher, normalize_command, owned_element, split_shell, uri
from reachlake.operators.scan import running_sums
from reachlake.sources import builds, policies, strict
from reachlake.sources.members import checked, lone_surrogate, object_members, parsed, pieces_of
from reachlake.streaming.store import FactStore, file_digests, ingest_stream, unit_key
from tests.test_graphs import make_facts, symbol


@pytest.mark.parametrize("text", ['{"a":1,"a":2}', "[1,]", "{} x", '"\t"', "NaN", "1e999", '{"a":{"b":1,"b":1}}'])
def test_json_is_strict(text):
    with pytest.raises(ValueError):
        strict.parse_json(text)


def test_documents_in_a_row(spark):
    assert list(strict.documents_of(' {"a":"}{"}\n[1] {}')) == ['{"a":"}{"}', "[1]", "{}"]
    for bad in ("{} x {}", '{"a":'):
        with pytest.raises(ValueError):
            list(strict.documents_of(bad))
    rows = spark.createDataFrame([("f", "{} {}")], "path string, text string")
    assert strict.split_documents(rows).count() == 2


def test_shell_words():
    assert split_shell(r"""g++ -D'a b' "c\d\"e" f\ g '' x""") == ["g++", "-Da b", 'cd"e', "f g", "", "x"]
    for bad in ("'a", '"a', "a\\"):
        with pytest.raises(ValueError):
            split_shell(bad)


def test_compilers():
    assert all(map(is_compiler, ("/usr/bin/clang++", "g++-13", "x86_64-linux-gnu-gcc-12.1", "cc"))) and not any(map(is_compiler, ("clang-tidy", "rustc", "g++x")))
    assert is_launcher("/x/ccache") and not is_launcher("make")


def test_commands():
    arguments = "ccache g++ -c -o x.o -ox.o -MD -MF d -MFd -Wp,-MD,x -Xclang -dependency-file -Xclang y -DX a.cpp ./a.cpp -O2".split()
    assert normalize_command("/p/q/..", "a.cpp", arguments, None) == (["g++", "-DX", "-O2", "/p/a.cpp"], [])
    assert normalize_command("/p", "a.cpp", ["g++", "-fmodule-file=m=x.pcm", "-include-pch", "y.pch", "a.cpp"], None)[1] == ["/p/x.pcm", "/p/y.pch"]
    for bad in (["make"], ["g++", "-o"], ["ccache"]):
        with pytest.raises(ValueError):
            normalize_command("/p", "a.cpp", bad, None)


def test_response_files():
    files = {"/p/a": "-DA @b", "/p/b": "'-D B'", "/p/c": "@c"}
    assert expand_responses(["x", "@a"], "/p", files.__getitem__) == (["x", "-DA", "-D B"], ["/p/a", "/p/b"])
    with pytest.raises(ValueError, match="cycle"):
        expand_responses(["@c"], "/p", files.__getitem__)


def test_owned_elements():
    assert owned_element("const std::unique_ptr<const ns::Foo, D> &") == "ns::Foo" and owned_element("std::shared_ptr<V<A, B>>") == "V<A, B>"
    assert [owned_element(x) for x in ("std::unique_ptr<Foo[]>", "std::vector<std::unique_ptr<Foo>>", "Foo *", "my::unique_ptr<Foo>")] == [None] * 4
    assert uri("a b/ü~") == "a%20b/%C3%BC~" and callee_and_index("a::b:2") == ("a::b", 2)


def test_scopes_and_paths(spark):
    rows = spark.createDataFrame([("/p/src/a",), ("/p/gen/a",), ("/p/third/a",), ("/q/a",), ("/p/src-b/a",), ("",)], "f string")
    scope = keys.scope_of(F.col("f"), F.lit("/p"), F.array(F.lit("/p/src")), F.array(F.lit("/p/third")))
    assert [r[0] for r in rows.select(scope).collect()] == ["reportable", "indexed", "excluded", "external_opaque", "indexed", "external_opaque"]
    assert rows.limit(1).select(keys.relative_to(F.lit("/p"), F.col("f"))).first()[0] == "src/a"
    types = spark.createDataFrame([("const struct Foo &",), ("  class volatile Bar * ",)], "t string")
    assert [r[0] for r in types.select(keys.normalized_type(F.col("t"))).collect()] == ["Foo", "Bar"]


PROVIDER = """
schema_version: 2
provider: qt
roots: [{symbol: {qualified_name: "ns::a"}, reason: slot}]
public_api_roots: [{symbol: {linkage_name: b}, reason: header}]
edges: [{from: {id: a}, to: {qualified_name: "ns::c", signature: "void ()"}, reason: signal}]
escapes: [{symbol: {id: c}, reason: stored}]
suppressions: [{symbol: {id: d}, reason: known}]
callback_registrations: [{callee: {qualified_name: reg}, argument_index: 1, reason: cb}]
"""


def with_linkage(facts):
    return facts.with_(symbols=facts.symbols.withColumn("linkage_name", F.col("identity.linkage_name")))


def test_provider_policies(spark, tmp_path):
    (tmp_path / "p.yaml").write_text(PROVIDER)
    rows = policies.read_provider_policies(spark, str(tmp_path / "p.yaml"))
    facts = policies.apply_provider_policies(with_linkage(make_facts(spark, [symbol(x) for x in "abcd"])), rows)
    assert {(r.symbol, r.kind) for r in facts.roots.collect()} == {("a", "provider"), ("b", "public_api")}
    assert [(r.src, r.dst, r.kind, r.evidence.provider) for r in facts.edges.collect()] == [("a", "c", "provider", "qt")]
    assert facts.escapes.first()["from"] is None and facts.suppressions.first().symbol == "d"
    assert policies.callback_rules(rows).first().callee == "reg"


@pytest.mark.parametrize(
    ("text", "message"),
    [
        ("schema_version: 1\nprovider: x\nother: []", "unknown key"), ("schema_version: 1\nprovider: x\nroots: [{symbol: {id: a, linkage_name: b}, reason: r}]", "exactly one"),
        ("schema_version: 1\nprovider: x\nprovider: y", "duplicate key"), ("schema_version: 1\nprovider: x\npublic_api_roots: []", "requires schema_version 2"), ("schema_version: 3\nprovider: x", "unsupported"),
        ("schema_version: 1\nprovider: x\nroots: [{symbol: {id: a, signature: s}, reason: r}]", "signature"), ("schema_version: 1\nprovider: ''", "non-empty"),
    ],
)
def test_bad_provider_policies(text, message):
    with pytest.raises(ValueError, match=message):
        policies.provider_rows(text)


@pytest.mark.parametrize(("names", "count"), [(("x", "x"), 2), (("x",), 0)])
def test_selectors_must_name_one(spark, names, count):
    symbols = [("k%d" % i, ("stable", "default", "", "l%d" % i, "", ""), n, f"ns::{n}", "", "", "function", "reportable", True, False, False, None) for i, n in enumerate(names)]
    facts = with_linkage(make_facts(spark, symbols))
    rows = spark.createDataFrame(policies.provider_rows("schema_version: 1\nprovider: p\nroots: [{symbol: {qualified_name: '%s'}, reason: r}]" % ("ns::x" if count else "ns::y")), policies.COLUMNS)
    with pytest.raises(ValueError, match=f"qualified_name 'ns::.' of p/roots/0/symbol matched {count} symbols"):
        policies.apply_provider_policies(facts, rows)


def test_comparison_policies():
    assert policies.diff_policy("schema_version: 2").changes == ("new_symbol", "newly_unreachable")
    assert policies.diff_policy("schema_version: 2\nclassifications: [dead]").classifications == ("dead",)
    for bad in ("schema_version: 1", "schema_version: 2\nchanges: []", "schema_version: 2\nchanges: [removed]", "schema_version: 2\ntargets: [a, a]", "schema_version: 2\nx: 1"):
        with pytest.raises(ValueError):
            policies.diff_policy(bad)


def test_compilation_database(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"directory": "b", "file": "../a.cpp", "command": "g++ -c 'a b.cpp'", "output": "a.o"}, {"directory": "/x", "file": "y.cpp", "arguments": ["cc", "y.cpp"], "command": "no"}]))
    rows = builds.read_compile_commands(spark, str(tmp_path / "c.json")).orderBy("index").collect()
    assert (rows[0].file, rows[0].arguments, rows[0].output) == (f"{tmp_path}/a.cpp", ["g++", "-c", "a b.cpp"], f"{tmp_path}/b/a.o") and rows[1].arguments == ["cc", "y.cpp"]
    done = builds.normalized_commands(builds.read_compile_commands(spark, str(tmp_path / "c.json"))).orderBy("index").collect()
    assert done[1].arguments == ["cc", "/x/y.cpp"]


GOOD = '{"directory": "/", "file": "a", "command": "g++"}'


@pytest.mark.parametrize(
    ("text", "message"),
    [
        (f"[{GOOD},]", "no list"), (f"[{GOOD} {GOOD}]", "no JSON"), (f"[{GOOD}]]", "no list"), ('[{"directory": "/", "directory": "/", "file": "a", "command": "g++"}]', "repeats a key"), ("", "no list"),
        ('[{"directory": "/", "file": "a\\ud800", "command": "g++"}]', "half a character"), ('[{"directory": "/", "file": "a\n", "command": "g++"}]', "isn't closed"),
        # Entries that break one rule each, together.
        ('[1, {"directory": "/", "file": "a"}, {"file": "a", "command": "g++"}, {"directory": "/", "file": ["a"], "command": "g++"}, {"directory": "/", "file": "a", "arguments": ["x", 1]}]', "(?s)(?=.*entry 0 must be an object)(?=.*entry 1.command)"),
        ('[{"directory": "/", "file": "a", "command": " "}]', "empty command"),
    ],
)
def test_bad_compilation_databases(spark, tmp_path, text, message):
    (tmp_path / "c.json").write_text(text)
    with pytest.raises(ValueError, match=message):
        builds.read_compile_commands(spark, str(tmp_path / "c.json"))


def test_compilation_databases_of_any_layout(spark, tmp_path):
    """The same commands, whatever the lines that a document is laid out in, in one file or in several."""
    entries = [{"directory": f"/d{i}", "file": f"f,[{i}]{{\"\\.cpp", "arguments": ["g++", "-DX=\U0001f600[", f"é{i}\\"], "output": ""} for i in range(40)]
    want = [(f"/d{i}", f"/d{i}/f,[{i}]{{\"\\.cpp", "", ["g++", "-DX=\U0001f600[", f"é{i}\\"], i) for i in range(40)]
    layouts = [json.dumps(entries), json.dumps(entries, indent=2, ensure_ascii=False), json.dumps(entries, indent=0).replace(",\n", "\n,\r\n"), "\n\n [" + ",".join(json.dumps(e, indent=1) for e in entries) + "\n]\n\n"]
    for i, text in enumerate(layouts):
        (tmp_path / f"{i}.json").write_text(text, newline="")
        assert builds.read_compile_commands(spark, str(tmp_path / f"{i}.json")).orderBy("index").collect() == [Row(**dict(zip(("directory", "file", "output", "arguments", "index"), w, strict=True))) for w in want]
    spark.conf.set("spark.sql.files.maxPartitionBytes", 500)
    try:
        (tmp_path / "parts").mkdir()
        lines = layouts[1].split("\n")
        for k in range(0, len(lines), 50):
            (tmp_path / "parts" / f"part-{k:05}").write_text("\n".join(lines[k : k + 50]) + "\n")
        rows = builds.read_compile_commands(spark, str(tmp_path / "parts"))
        assert [tuple(r) for r in rows.orderBy("index").collect()] == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "none.json").write_text(" [\n ] ")
    assert builds.read_compile_commands(spark, str(tmp_path / "none.json")).isEmpty()


@pytest.mark.parametrize(
    ("line", "depth", "level", "shapes"),
    [
        ("[1, 2]", 0, 1, ["[v", "v]"]), ("{}", 0, 1, ["{}"]), ("[1]] x", 0, 1, ["[v]!v"]), ("x [1]", 0, 1, ["![v]"]), (",[1]", 0, 1, ["", "![v]"]), ('"a": {"b": [1, 2]}, "c": 3', 1, 2, [":{v}", ":v"]), ("1, 2], ", 2, 2, ["v", "v]", ""]),
        ('{"a": [ ]}', 0, 2, ["{:[]}"]), ('"a": 5 []', 1, 2, [":v[]"]), ('"a": [1] 2', 1, 2, [":[v]v"]), ('"a":: 1', 1, 2, ["::v"]), ('"[{,:\\"": 1', 1, 2, [":v"]), ("{[1, 2], 3}, 4", 1, 1, ["v", "v"]),
    ],
)
def test_shapes_of_pieces(line, depth, level, shapes):
    assert [shape for *_, shape, _ in pieces_of(line, depth, level)] == shapes


def test_members_of_an_object(spark, tmp_path):
    (tmp_path / "o.json").write_text('{"a": 1, "b": [1, [2, 3],\n {"x": [4, 5]}],"\\u0063": {"y": {"z": 1}, "w": "}]"}, "d": [], "e": {}, "f": null}')
    members, elements = object_members(spark, str(tmp_path / "o.json"))
    assert {(r.key, r.container) for r in members.collect()} == {("a", ""), ("b", "["), ("c", "{"), ("d", "["), ("e", "{"), ("f", "")}
    assert sorted((r.key, r["index"], r.text.strip()) for r in elements.collect()) == [("a", 0, "1"), ("b", 0, "1"), ("b", 1, "[2, 3]"), ("b", 2, '{"x": [4, 5]}'), ("c", 0, '"y": {"z": 1}'), ("c", 1, '"w": "}]"'), ("f", 0, "null")]
    (tmp_path / "n.json").write_text("{ }")
    assert [x.count() for x in object_members(spark, str(tmp_path / "n.json"))] == [0, 0]
    for bad in ('{"a"}', '{"a": 1, "a": 2}', '{"a": 1 "b": 2}', '{a: 1}', '{"a": [1,,2]}'):
        (tmp_path / "b.json").write_text(bad)
        with pytest.raises(ValueError):
            # What an element itself must be is told where it is parsed.
            members, elements = object_members(spark, str(tmp_path / "b.json"))
            checked(elements, "element", (parsed(F.col("text")).isNotNull(), F.col("text")))


@pytest.mark.parametrize(("text", "good"), [(r'"\ud83d\ude00"', True), (r'"\\ud800"', True), (r'"\uDBFF"', False), (r'"\ud800\u0041"', False), (r'"\udc00\ud800"', False), (r'"\\\ud800"', False)])
def test_half_characters(spark, text, good):
    """The strict decoder and the column agree."""
    assert spark.range(1).select(lone_surrogate(F.lit(text))).first()[0] is not good
    if good:
        strict.parse_json(text)
    else:
        with pytest.raises(ValueError, match="half a character"):
            strict.parse_json(text)


def test_running_sums(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("at"), (F.col("id") * 7919 % 1000 % 7 - 3).alias("v"))
    got = {r.at: r.upto for r in running_sums(rows, ["at"], upto=F.col("v")).collect()}
    total = 0
    for i in range(1000):
        assert got[i] == total
        total += i % 7 - 3


def test_target_manifest(spark, tmp_path):
    target = {"id": "app", "name": "app", "type": "executable", "sources": ["a.cpp"], "dependencies": ["core"], "public_headers": ["a.h"], "artifacts": ["app"]}
    manifest = {"schema_version": 2, "source_root": "src", "build_root": "out", "configurations": [{"name": "Debug", "targets": [target]}], "unknown": 1}
    (tmp_path / "m.json").write_text(json.dumps(manifest))
    build = builds.read_target_manifest(spark, str(tmp_path / "m.json"))
    assert build.sources.first().path == f"{tmp_path}/src/a.cpp" and build.artifacts.first().path == f"{tmp_path}/out/app" and build.headers.count() == 1
    assert [tuple(r) for r in build.targets.collect()] == [("Debug", "app", "app", "executable")] and build.dependencies.first().dependency == "core"
    first = manifest | {"schema_version": 1}
    (tmp_path / "m.json").write_text(json.dumps(first))
    assert builds.read_target_manifest(spark, str(tmp_path / "m.json")).headers.isEmpty()
    of = lambda **change: manifest | {"configurations": [{"name": "Debug", "targets": [target | change]}]}
    for bad in (manifest | {"schema_version": True, "source_root": ""}, of(id="", type="program"), of(sources="a.cpp"), of(artifacts=[1]), [manifest]):
        (tmp_path / "m.json").write_text(json.dumps(bad))
        with pytest.raises(ValueError, match="target manifest"):
            builds.read_target_manifest(spark, str(tmp_path / "m.json"))
    for bad in (json.dumps(manifest) + "x", json.dumps(manifest).replace("Debug", "\\udc00")):
        (tmp_path / "m.json").write_text(bad)
        with pytest.raises(ValueError, match="target manifest"):
            builds.read_target_manifest(spark, str(tmp_path / "m.json"))


def test_cmake_replies(spark, tmp_path):
    def write(name, value):
        (tmp_path / name).write_text(json.dumps(value))

    write("index-1.json", {"objects": []})
    write("index-2.json", {"objects": [{"kind": "codemodel", "version": {"major": 2, "minor": 7}, "jsonFile": "codemodel.json"}]})
    write("codemodel.json", {"paths": {"source": "/s", "build": "/b"}, "configurations": [{"name": "Debug", "targets": [{"id": "t1", "name": "app", "jsonFile": "t1.json"}]}]})
    reply = {"id": "t1", "name": "app", "type": "EXECUTABLE", "sources": [{"path": "a.cpp"}, {"path": "a.h", "fileSetIndex": 0}], "compileGroups": [{"language": "CXX", "sourceIndexes": [0]}, {"language": "C", "sourceIndexes": [1]}]}
    reply |= {"fileSets": [{"type": "HEADERS", "visibility": "PUBLIC"}], "dependencies": [{"id": "t2", "backtrace": 0}, {"id": "t3"}], "backtraceGraph": {"commands": ["add_dependencies"], "nodes": [{"command": 0}]}, "artifacts": [{"path": "app"}]}
    write("t1.json", reply)
    build = builds.read_cmake_replies(spark, str(tmp_path))
    assert [r.path for r in build.sources.collect()] == ["/s/a.cpp"] and [r.path for r in build.headers.collect()] == ["/s/a.h"]
    from reachlake.operators.targets import link_dependencies

    assert [r.dependency for r in link_dependencies(build.dependencies).collect()] == ["t3"]
    write("t1.json", reply | {"name": "other"})
    with pytest.raises(ValueError, match="is not of target app"):
        builds.read_cmake_replies(spark, str(tmp_path))
    names = {"/etc/x": False, "../x": False, "a/../../x": False, "": False, "x": True, "a/../x": True}
    assert {r[0]: r[1] for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", builds.is_reply_name(F.col("n"))).collect()} == names
    write("t1.json", reply)
    write("codemodel.json", {"paths": {"source": "/s", "build": "/b"}, "configurations": [{"name": "Debug", "targets": [{"id": "t1", "name": "app", "jsonFile": "../t1.json"}]}]})
    with pytest.raises(ValueError, match="stay in the reply folder"):
        builds.read_cmake_replies(spark, str(tmp_path))


def test_depfiles(spark, tmp_path):
    (tmp_path / "d").write_text("a.o: a.cpp \\\n  b\\ c.h d\\\\e\n")
    assert sorted(r.dependency for r in builds.read_depfiles(spark, str(tmp_path / "d")).collect()) == ["a.cpp", "b c.h", "d\\e"]
    with pytest.raises(ValueError):
        builds.depfile_inputs("a.o:\n")


def test_fact_store(spark, tmp_path):
    for name in "ab":
        (tmp_path / name).write_text(name)
    store, files = FactStore(spark, str(tmp_path / "store")), [str(tmp_path / "a"), str(tmp_path / "b")]
    assert store.manifest() is None
    digests = file_digests(spark, *files, files[0])
    deps = digests.select(F.lit("u").alias("unit"), "path", "digest", F.endswith("path", F.lit("/a")).alias("is_primary"))
    table = lambda n: spark.createDataFrame([("u", n)], "unit string, n int")
    first = store.publish({"symbols": table(1)}, deps)
    assert [r.unit for r in store.valid_units(file_digests(spark, *files)).collect()] == ["u"]
    (tmp_path / "b").write_text("changed")
    assert store.valid_units(file_digests(spark, *files)).isEmpty()
    second = store.publish({"symbols": table(2)}, deps)
    assert second > first
    table(3).write.parquet(f"{store.root}/symbols/run={second + 1}")  # unpublished
    assert [(r.n, r.run) for r in store.table("symbols").collect()] == [(2, second)]
    assert store.sweep() == [second + 1] and store.sweep() == [] and store.table("symbols").count() == 1
    key = lambda a, b: spark.range(1).select(unit_key({"a": F.lit(a), "b": F.lit(b)})).first()[0]
    assert key("x", "yz") != key("xy", "z") and key("x", "y") == key("x", "y")


def test_stream_into_the_store(spark, tmp_path):
    source = tmp_path / "in"
    schema = "unit string, n int"
    spark.createDataFrame([("u", 1), ("v", 2)], schema).coalesce(1).write.parquet(str(source))
    store = FactStore(spark, str(tmp_path / "store"))

    def split(batch):
        return {"symbols": batch}, batch.select("unit", F.col("unit").alias("path"), F.lit("d").alias("digest"), F.lit(True).alias("is_primary"))

    for turn in range(2):
        ingest_stream(spark.readStream.schema(schema).parquet(str(source)), store, split, str(tmp_path / "checkpoint")).awaitTermination(60)
        spark.createDataFrame([("u", 10)], schema).coalesce(1).write.mode("append").parquet(str(source))
    ingest_stream(spark.readStream.schema(schema).parquet(str(source)), store, split, str(tmp_path / "checkpoint")).awaitTermination(60)
    assert {(r.unit, r.n) for r in store.table("symbols").collect()} == {("u", 10), ("v", 2)}


def stored(store):
    return sorted((r.unit, r.n) for r in store.table("symbols").collect())


def by_unit(batch):
    return {"symbols": batch}, batch.select("unit", F.col("unit").alias("path"), F.lit("d").alias("digest"), F.lit(True).alias("is_primary")).distinct()


def arrivals(spark, folder, *batches):
    """A stream of files, one micro-batch each."""
    for rows in batches:
        spark.createDataFrame(rows, "unit string, n int").coalesce(1).write.mode("append").parquet(str(folder))
    return lambda: spark.readStream.schema("unit string, n int").option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_streams_share_a_store_with_batch_runs(spark, tmp_path):
    """Batch numbers of different writers are the same and lose nothing."""
    store = FactStore(spark, str(tmp_path / "store"))
    store.publish(*by_unit(spark.createDataFrame([("u0", 0), ("u1", 0), ("w", 0)], "unit string, n int")))
    one, two = arrivals(spark, tmp_path / "one", [("u1", 1)], [("u2", 2)]), arrivals(spark, tmp_path / "two", [("v1", 3)], [("v2", 4), ("v2", 4)])
    for source, name in ((one, "c1"), (two, "c2")):
        ingest_stream(source(), store, by_unit, str(tmp_path / name)).awaitTermination(90)
    everything = [("u0", 0), ("u1", 1), ("u2", 2), ("v1", 3), ("v2", 4), ("v2", 4), ("w", 0)]
    assert stored(store) == everything
    writers = [(r.writer, r.batch) for r in store.transactions().collect()]
    assert len({*writers}) == 5 and sorted(b for w, b in writers if w.startswith("stream")) == [0, 0, 1, 1] and len({r.run for r in store.transactions().collect()}) == 5
    # From a new checkpoint all of it is read and published again, as a new writer; from an old one nothing.
    ingest_stream(one(), store, by_unit, str(tmp_path / "c3")).awaitTermination(90)
    ingest_stream(two(), store, by_unit, str(tmp_path / "c2")).awaitTermination(90)
    assert stored(store) == everything and store.transactions().count() == 7


def test_a_failed_batch_is_published_once(spark, tmp_path):
    """A batch fails after its facts were written and before its record; it is repeated, and one whose record was made isn't."""
    store = FactStore(spark, str(tmp_path / "store"))
    source = arrivals(spark, tmp_path / "in", [("u", 1)], [("v", 2)])
    calls = []

    def fails(batch):
        calls.append(batch.sparkSession)
        facts, dependencies = by_unit(batch)
        return facts, dependencies if len(calls) != 2 else dependencies.withColumn("unit", F.raise_error(F.lit("lost")).cast("string"))

    with pytest.raises(Exception, match="lost"):
        ingest_stream(source(), store, fails, str(tmp_path / "c")).awaitTermination(90)
    assert stored(store) == [("u", 1)]
    ingest_stream(source(), store, fails, str(tmp_path / "c")).awaitTermination(90)
    assert stored(store) == [("u", 1), ("v", 2)] and len(calls) == 3
    assert len(store.sweep()) == 1 and stored(store) == [("u", 1), ("v", 2)]


def test_one_of_two_attempts_publishes(spark, tmp_path, monkeypatch):
    store, rows = FactStore(spark, str(tmp_path / "store")), spark.createDataFrame([("u", 1)], "unit string, n int")
    assert store.publish(*by_unit(rows), ("stream s", 4)) and store.publish(*by_unit(rows), ("stream s", 4)) is None
    # Both attempts found no record; the slower one finds it when it renames its own, and takes back what it wrote.
    monkeypatch.setattr(store, "published", lambda *_: False)
    assert store.publish(*by_unit(rows), ("stream s", 4)) is None
    assert stored(store) == [("u", 1)] and store.transactions().count() == 1 and store.sweep() == []
    with ThreadPoolExecutor(4) as pool:
        runs = list(pool.map(lambda i: store.publish(*by_unit(rows.withColumn("unit", F.lit(f"w{i}")))), range(4)))
    assert len({*runs}) == 4 and len(stored(store)) == 5


def test_written_tables(spark, tmp_path):
    from reachlake.storage import new_path, written

    df = written(spark.range(3), "three")
    assert [r.id for r in df.orderBy("id").collect()] == [0, 1, 2] and new_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_lines_of_one_element_are_cut_without_tokens(monkeypatch):
    """A line that holds one element gives the pieces that its tokens give, without going over these; others are cut by tokens."""
    import re

    from reachlake.sources import members

    whole = ['    {"a":"}],{","b":[1,{"c":"\\\\\\""}]},', '  [{}, []]', '{"k": "\\\\"} , ', "\t[1,2],"]
    other = ['{"a":1},{"b":2},', '{"a":1}]', '{"a":1', '[1],x', '{"a":"],', "[]][", '"a",', "", "],"]
    cases = [(line, depth, level) for line in whole + other for level in (1, 2) for depth in range(4)]
    found = [members.pieces_of(*case) for case in cases]
    monkeypatch.setattr(members, "ELEMENT", re.compile("(?!)"))
    assert found == [members.pieces_of(*case) for case in cases]
    monkeypatch.undo()
    monkeypatch.setattr(members, "TOKEN", None)
    for line in whole[:2] + whole[3:]:
        assert members.pieces_of(line, 2, 2)[0][:4] == (0, 0, "", "v")
