"""Facts from hand-written AST dumps."""

import json

import pytest

from reachlake.operators.extract import Project, extract
from reachlake.operators.reach import with_reach
from reachlake.sources.ast import ast_nodes, nodes_of, points_in, read_ast_dumps, source_of


class Dump:
    """Builds a small dump; declarations are numbered by name."""

    def __init__(self, unit):
        self.unit, self.line, self.top = unit, 0, []

    def decl(self, kind, name, inner=(), file=None, type="void ()", body=True, **more):
        self.line += 10
        node = {"id": f"0x{name}", "kind": kind, "name": name, "mangledName": f"_Z{name}", "type": {"qualType": type}, "loc": {"file": file or self.unit, "line": self.line, "col": 1, "offset": self.line}, "range": {"end": {"line": self.line + 2}}}
        node["inner"] = [*([{"kind": "CompoundStmt", "inner": list(inner)}] if body else inner)]
        return node | more

    def add(self, *nodes):
        self.top += nodes

    def text(self):
        return json.dumps({"kind": "TranslationUnitDecl", "id": "0x0", "inner": self.top})


def ref(name, kind="FunctionDecl"):
    return {"kind": "DeclRefExpr", "referencedDecl": {"id": f"0x{name}", "kind": kind, "name": name}}


def call(name, *args, **more):
    return {"kind": "CallExpr", "inner": [{"kind": "ImplicitCastExpr", "inner": [ref(name)]}, *args], **more}


@pytest.fixture(scope="module")
def facts(spark):
    d = Dump("/p/src/main.cpp")
    d.add(d.decl("FunctionDecl", "puts", body=False, file="/usr/include/stdio.h"), d.decl("FunctionDecl", "unused", body=False, file="/usr/include/stdio.h"))
    d.add(d.decl("FunctionDecl", "live"), d.decl("FunctionDecl", "dead", [call("alsodead")]), d.decl("FunctionDecl", "alsodead", [call("dead")]), d.decl("FunctionDecl", "taken"), d.decl("FunctionDecl", "handler"), d.decl("FunctionDecl", "reg"), d.decl("FunctionDecl", "init"), d.decl("FunctionDecl", "bound"), d.decl("FunctionDecl", "rebound"))
    box = [d.decl("CXXConstructorDecl", "Box", type="void ()"), d.decl("CXXConstructorDecl", "Box2", type="void (int)"), d.decl("CXXDestructorDecl", "~Box", type="void ()")]
    base = [d.decl("CXXMethodDecl", "run", virtual=True)]
    derived = [d.decl("CXXMethodDecl", "run", mangledName="_Zrun2", id="0xrun2")]
    record = lambda name, inner, **more: {"id": f"0x{name}", "kind": "CXXRecordDecl", "name": name, "inner": inner, "loc": {"file": d.unit, "line": 1}, **more}
    d.add(record("Box", box), record("Base", base), record("Derived", derived, bases=[{"type": {"qualType": "Base"}}]))
    d.add({"kind": "VarDecl", "id": "0xg", "name": "g", "loc": {"file": d.unit, "line": 3}, "inner": [call("init")]})
    made = {"kind": "CXXConstructExpr", "type": {"qualType": "const Box"}, "ctorType": {"qualType": "void (int)"}}
    variable = lambda name, target: {"kind": "VarDecl", "id": f"0x{name}", "name": name, "inner": [ref(target)]}
    assign = {"kind": "BinaryOperator", "opcode": "=", "inner": [ref("q", "VarDecl"), {"kind": "IntegerLiteral"}]}
    through = lambda name: {"kind": "CallExpr", "inner": [ref(name, "VarDecl")]}
    d.add(d.decl("FunctionDecl", "main", [call("live"), call("puts"), ref("taken"), call("reg", {"kind": "IntegerLiteral"}, ref("handler")), made, variable("p", "bound"), through("p"), variable("q", "rebound"), assign, through("q"), call("run")]))
    rules = spark.createDataFrame([("r", "reg", 1)], "rule string, callee string, argument_index long")
    units = spark.createDataFrame([(d.unit, d.text())], "unit string, text string")
    return extract(ast_nodes(units), Project("/p", ["/p/src"]), rules)


def names(facts):
    return {r.key: r.identity.linkage_name[2:] for r in facts.symbols.collect()}


def test_symbols(facts):
    found = {r.identity.linkage_name[2:]: r for r in facts.symbols.collect()}
    assert "unused" not in found and found["puts"].scope == "external_opaque" and found["live"].scope == "reportable"
    assert found["Box2"].class_name == "Box" and found["run2"].kind == "method" and found["live"].source.spelling.location.line == 30


def test_edges(facts):
    n = names(facts)
    edges = {(n[r.src], n[r.dst], r.kind) for r in facts.edges.collect()}
    assert edges == {
        ("main", "live", "direct_call"), ("main", "puts", "direct_call"), ("main", "reg", "direct_call"), ("main", "run", "direct_call"), ("main", "bound", "direct_call"), ("dead", "alsodead", "direct_call"), ("alsodead", "dead", "direct_call"),
        ("main", "Box2", "constructs"), ("main", "~Box", "constructs"), ("main", "handler", "callback_registration"), ("run", "run2", "virtual_dispatch"),
    }


def test_roots_and_escapes(facts):
    n = names(facts)
    assert {(n[r.symbol], r.kind) for r in facts.roots.collect()} == {("main", "application_entry_point"), ("init", "global_initializer")}
    escapes = {(n[r.symbol], r.kind) for r in facts.escapes.collect()}
    assert {("taken", "address_taken"), ("handler", "address_taken"), ("handler", "callable_object")} <= escapes and ("live", "address_taken") not in escapes


def test_reachability_of_extracted_facts(facts):
    n = names(facts)
    live = {n[r.key] for r in with_reach(facts).filter("reachable").collect()}
    assert {"main", "live", "init", "run2", "handler", "bound"} <= live and not live & {"dead", "alsodead", "rebound", "Box"}


@pytest.fixture(scope="module")
def corners(spark):
    """Templates' patterns, variables of system headers, std::function, namespace-scope registrations, functors, out-of-line definitions, exports."""
    d = Dump("/p/src/a.cpp")
    function = "std::function<void ()>"
    d.add(d.decl("FunctionDecl", "pattern", mangledName=""), d.decl("FunctionDecl", "implicit", isImplicit=True))
    d.add(*(d.decl("FunctionDecl", x) for x in ("kept", "registered", "reg", "fromheader", "fromhere", "given", "stored")))
    d.add(d.decl("FunctionDecl", "hidden", inner=[{"kind": "CompoundStmt"}, {"kind": "VisibilityAttr", "visibility": "hidden"}], body=False), d.decl("FunctionDecl", "secret", storageClass="static"))
    functor = [d.decl("CXXMethodDecl", "operator()", id="0xop", mangledName="_Zop")]
    d.add({"id": "0xFun", "kind": "CXXRecordDecl", "name": "Fun", "inner": functor, "loc": {"file": d.unit, "line": 1}})
    d.add({"id": "0xns", "kind": "NamespaceDecl", "name": "ns", "inner": [{"id": "0xC", "kind": "CXXRecordDecl", "name": "C", "inner": []}]})
    d.add(d.decl("CXXMethodDecl", "outofline", parentDeclContextId="0xC"))
    variable = lambda name, file, *inner: {"kind": "VarDecl", "id": f"0x{name}", "name": name, "loc": {"file": file, "line": 3}, "inner": list(inner)}
    d.add(variable("g1", "/usr/include/h.h", call("fromheader")), variable("g2", d.unit, call("fromhere")), variable("g3", d.unit, call("reg", {"kind": "IntegerLiteral"}, ref("registered"))))
    build = {"kind": "CXXConstructExpr", "type": {"qualType": function}, "inner": [{"kind": "ImplicitCastExpr", "inner": [ref("stored")]}]}
    object_ = {"kind": "DeclRefExpr", "type": {"qualType": "const Fun"}, "referencedDecl": {"id": "0xf", "kind": "VarDecl", "name": "f"}}
    through = lambda name: {"kind": "CallExpr", "inner": [ref(name, "VarDecl")]}
    lambda_ = {"kind": "LambdaExpr", "inner": [{"kind": "CXXRecordDecl", "inner": [d.decl("CXXMethodDecl", "operator()", [call("kept")], id="0xl", mangledName="_Zl")]}]}
    local = {"kind": "VarDecl", "id": "0xlv", "name": "lv", "inner": [lambda_]}
    notbound = {"kind": "VarDecl", "id": "0xnb", "name": "nb", "inner": [call("kept", ref("given"))]}
    d.add(d.decl("FunctionDecl", "main", [build, call("kept", object_), local, through("lv"), notbound, through("nb")]))
    rules = spark.createDataFrame([("r", "reg", 1)], "rule string, callee string, argument_index long")
    units = spark.createDataFrame([(d.unit, d.text())], "unit string, text string")
    return extract(ast_nodes(units), Project("/p", ["/p/src"], exports=spark.createDataFrame([(d.unit, ["-O2"])], "unit string, arguments array<string>")), rules)


def test_patterns_and_implicit_functions_are_not_defined(corners):
    found = {r.name: r for r in corners.symbols.collect()}
    assert not found["pattern"].defined and "implicit" not in found and found["kept"].defined
    assert found["outofline"].qualified_name == "ns::C::outofline" and found["outofline"].class_name == "ns::C"


def test_corner_roots(corners):
    n = names(corners)
    roots = {(n[r.symbol], r.kind) for r in corners.roots.collect()}
    assert ("fromhere", "global_initializer") in roots and ("reg", "global_initializer") in roots and ("registered", "callback_registration") in roots
    assert ("fromheader", "global_initializer") not in roots
    public = {name for name, kind in roots if kind == "public_api"}
    assert {"kept", "main"} <= public and not public & {"hidden", "secret"}


def test_corner_escapes_and_calls(corners):
    n = names(corners)
    escapes = {(n[r.symbol], r.kind, r.evidence.reason) for r in corners.escapes.collect()}
    assert ("stored", "callable_object", "kept in a std::function") in escapes and ("op", "callable_object", "passed as a callable argument") in escapes
    edges = {(n[r.src], n[r.dst]) for r in corners.edges.collect()}
    # A variable that holds a call's result isn't bound to the call's arguments; one that holds a lambda calls it.
    assert ("main", "l") in edges and ("main", "given") not in edges and ("l", "kept") in edges


def test_dump_files(spark, tmp_path):
    d = Dump("/p/a.cpp")
    d.add(d.decl("FunctionDecl", "main"))
    (tmp_path / "a.cpp.json").write_text(d.text())
    nodes = read_ast_dumps(spark, str(tmp_path / "a.cpp.json")).orderBy("node").collect()
    assert [r.kind for r in nodes] == ["TranslationUnitDecl", "FunctionDecl", "CompoundStmt"] and nodes[0].last == 2 and nodes[2].owner == 1
    with pytest.raises(Exception, match="duplicate key"):
        ast_nodes(spark.createDataFrame([("u", '{"kind": "x", "kind": "y"}')], "unit string, text string")).collect()


def places(*nodes, unit="/p/src/a.cpp"):
    """The file and source of each function of a dump."""
    found = nodes_of(unit, json.dumps({"kind": "TranslationUnitDecl", "loc": {}, "inner": list(nodes)}), "/p/build")
    return {n["name"]: (n["file"], n["source"]) for n in found if n["source"]}


def function(name, loc, inner=(), **bounds):
    return {"kind": "FunctionDecl", "name": name, "loc": loc, "range": bounds, "inner": list(inner)}


def test_places_leave_out_what_was_printed_before():
    found = places(
        function("a", {"offset": 3, "file": "../src/a.cpp", "line": 4, "col": 5, "tokLen": 1}, begin={"offset": 1, "col": 3, "tokLen": 2}, end={"offset": 9, "line": 6, "col": 1, "tokLen": 1}),
        function("b", {"offset": 12, "col": 2}, begin={}, end={"offset": 20, "line": 8, "col": 1}),
    )
    file, source = found["a"]
    assert file == "/p/src/a.cpp" and source["expansion"] is None
    assert [source["spelling"][x]["line"] for x in ("location", "begin", "end")] == [4, 4, 6] and source["spelling"]["begin"]["file"] == file
    # b has no line of its own: it is that of the end of a.
    assert found["b"][0] == file and [found["b"][1]["spelling"][x]["line"] for x in ("location", "begin", "end")] == [6, 6, 8]


def test_places_in_macros():
    spelled = {"spellingLoc": {"offset": 7, "file": "/p/include/m.h", "line": 2, "col": 9, "tokLen": 4}, "expansionLoc": {"offset": 30, "file": "/p/src/a.cpp", "line": 11, "col": 1, "tokLen": 5, "isMacroArgExpansion": True}}
    found = places(function("m", spelled, begin=spelled, end={"offset": 40, "line": 12, "col": 3, "tokLen": 1}), function("n", {"offset": 50, "line": 13, "col": 1}))
    file, source = found["m"]
    assert file == "/p/src/a.cpp" and source["spelling"]["location"] == {"file": "/p/include/m.h", "line": 2, "column": 9, "offset": 7, "token_length": 4}
    assert source["expansion"]["location"]["line"] == source["expansion"]["begin"]["line"] == 11
    # The end stands outside the macro, so its expansion is where the begin's is.
    assert source["spelling"]["end"]["line"] == 12 and source["expansion"]["end"] == source["expansion"]["begin"]
    assert found["n"][0] == "/p/src/a.cpp"
    pasted = {"spellingLoc": {"offset": 1, "file": "<scratch space>", "line": 1, "col": 1}, "expansionLoc": {"offset": 60, "file": "/p/src/a.cpp", "line": 20, "col": 1}}
    file, source = places(function("p", pasted))["p"]
    assert file == "/p/src/a.cpp" and source["spelling"]["location"]["file"] == "" and source["expansion"]["location"]["line"] == 20


def test_places_of_headers():
    first, second = {"offset": 1, "file": "/usr/include/t.h", "line": 3, "col": 1, "includedFrom": {"file": "/p/src/a.cpp"}}, {"offset": 9, "line": 5, "col": 1, "includedFrom": {"file": "/p/src/a.cpp"}}
    found = places(function("one", first), function("two", second), function("own", {"offset": 2, "file": "/p/src/a.cpp", "line": 1, "col": 1}), function("lost", second), function("inner", {}, begin={"offset": 4, "line": 2, "col": 1}))
    assert {n: f for n, (f, _) in found.items()} == {"one": "/usr/include/t.h", "two": "/usr/include/t.h", "own": "/p/src/a.cpp", "lost": "", "inner": "/p/src/a.cpp"}
    assert found["inner"][1]["spelling"]["location"] == found["inner"][1]["spelling"]["begin"]
    # A node without a place stands where the one around it does.
    nested = places({"kind": "NamespaceDecl", "name": "n", "loc": dict(first), "inner": [function("below", {"offset": 8, "file": "/p/src/a.cpp", "line": 9, "col": 1}), function("bare", {})]})
    assert nested["bare"][0] == "/usr/include/t.h"


def test_table_of_nodes_holds_what_matters(spark):
    """Statements that facts aren't inferred from make no rows, and the places they take still count."""
    d = Dump("/p/src/a.cpp")
    call_at = {**call("f"), "loc": {"line": 7, "col": 2}}
    d.add(d.decl("FunctionDecl", "f", [{"kind": "IfStmt", "loc": {"file": "/p/src/h.h", "line": 3}, "inner": [call_at]}]), {"id": "0xg", "kind": "FunctionDecl", "name": "g", "mangledName": "_Zg", "loc": {"line": 5, "col": 1}})
    rows = ast_nodes(spark.createDataFrame([(d.unit, d.text())] * 1, "unit string, text string")).orderBy("node").collect()
    assert [(r.kind, r.name) for r in rows] == [("FunctionDecl", "f"), ("CallExpr", ""), ("DeclRefExpr", ""), ("FunctionDecl", "g")]
    assert rows[3].source.spelling.location.file == "/p/src/h.h" and rows[2].callee and rows[2].call == rows[1].node and rows[1].source is None
    every = list(nodes_of(d.unit, d.text(), "/"))
    assert all(r.parent == every[r.node]["parent"] and r.last == every[r.node]["last"] and r.file == every[r.node]["file"] for r in rows)


def test_dumps_are_dealt_to_all_tasks(spark):
    """The pairs a dump is made of are small and the dump isn't: suppliers go to as many tasks as a shuffle has."""
    from reachlake.plans.input_queries import sold

    assert sold(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_sources_go_over_as_points(spark):
    """A node's row has the same source whether it comes as a list of points or by name, with an expansion and without one."""
    spelled = {"spellingLoc": {"offset": 7, "file": "/p/include/m.h", "line": 2, "col": 9, "tokLen": 4}, "expansionLoc": {"offset": 30, "file": "/p/src/a.cpp", "line": 11, "col": 1, "tokLen": 5}}
    nodes = [function("m", spelled, begin=spelled), function("n", {"offset": 50, "line": 13, "col": 1}, [call("m")]), function("bare", {})]
    text = json.dumps({"kind": "TranslationUnitDecl", "inner": nodes})
    rows = ast_nodes(spark.createDataFrame([("/p/src/a.cpp", text)], "unit string, text string"))
    want = {n["name"]: n["source"] for n in nodes_of("/p/src/a.cpp", text, "/") if n["source"]}
    got = {r.name: r.source.asDict(recursive=True) for r in rows.filter("source is not null").collect()}
    assert got == want and got["m"]["expansion"] and got["n"]["expansion"] is None
    again = rows.filter("source is not null").select("name", source_of(points_in(rows["source"])).alias("source")).collect()
    assert {r.name: r.source.asDict(recursive=True) for r in again} == want


def test_a_walk_makes_rows_of_what_matters_only(monkeypatch):
    """Nodes that make no row cost neither a row nor a source, and paths are normalised once for each file."""
    from reachlake.sources import ast

    d = Dump("/p/src/a.cpp")
    d.add(*(d.decl("FunctionDecl", f"f{i}", [{"kind": "IfStmt", "loc": {"line": i}, "inner": [{"kind": "IntegerLiteral"}] * 5}]) for i in range(20)))
    asked = []
    monkeypatch.setattr(ast, "normal_path", lambda path, directory="/": asked.append(path) or path)
    rows = ast.walked(d.unit, d.text(), "/", every=False)
    assert len(rows) == 20 and len(asked) <= 2 and all(len(r) == len(ast.COLUMNS) for r in rows)


def test_equal_declarations_of_many_units_are_one_row(spark):
    """What is merged into symbols is one row for a header's function, however many units declare it; internal ones stay apart."""
    from reachlake.operators import extract as own

    header = lambda d: d.add({**d.decl("FunctionDecl", "shared", file="/p/src/h.h"), "loc": {"file": "/p/src/h.h", "line": 4}, "range": {}}, d.decl("FunctionDecl", "local", mangledName="_ZLlocal", storageClass="static"))
    dumps = [Dump(f"/p/src/u{i}.cpp") for i in range(5)]
    for d in dumps:
        header(d)
    nodes = ast_nodes(spark.createDataFrame([(d.unit, d.text()) for d in dumps], "unit string, text string"))
    merged_rows, merge = [], own.merge_symbols
    own.merge_symbols = lambda rows, place: merged_rows.append(rows.count()) or merge(rows, place)
    try:
        found = own.extract(nodes, Project("/p", ["/p/src"]))
    finally:
        own.merge_symbols = merge
    assert merged_rows == [6] and sorted(r.name for r in found.symbols.collect()) == ["local"] * 5 + ["shared"]
