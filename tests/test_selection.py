"""Targets' commands, manual roots, checks of a run, and the program."""

import json

import pytest
from pyspark.sql import functions as F

from reachlake.__main__ import options, run
from reachlake.plans import selection
from reachlake.plans.analysis import IncompleteRun
from reachlake.sources.builds import Build
from tests.test_extract import Dump, call
from tests.test_graphs import make_facts, symbol


def build_of(spark, root, rows):
    own = "configuration string, id string, "
    kinds = {"targets": own + "name string, kind string", "sources": own + "path string", "dependencies": "configuration string, target string, dependency string, command string", "headers": own + "path string", "artifacts": own + "path string"}
    return Build(root, **{name: spark.createDataFrame(rows[name], kind) for name, kind in kinds.items()})


@pytest.fixture(scope="module")
def build(spark):
    names = [("app", "executable"), ("core", "static_library"), ("objects", "object_library"), ("iface", "interface_library"), ("test", "executable"), ("plug", "module_library")]
    deps = [("app", "core", "target_link_libraries"), ("core", "objects", None), ("app", "test", "add_dependencies"), ("app", "iface", None), ("app", "gone", None)]
    return build_of(spark, "/s", {
        "targets": [("Debug", f"id-{n}", n, k) for n, k in names], "sources": [("Debug", f"id-{n}", f"/s/{n}.cpp") for n, _ in names if n != "iface"] + [("Debug", "id-app", "/s/shared.cpp")],
        "dependencies": [("Debug", f"id-{a}", f"id-{b}", c) for a, b, c in deps], "headers": [("Debug", "id-iface", "/s/iface.h")], "artifacts": [],
    })


@pytest.fixture(scope="module")
def commands(spark):
    rows = [("/b", f"/s/{n}.cpp", f"/b/CMakeFiles/{n}.dir/{n}.o", ["g++", n], i) for i, n in enumerate(("app", "core", "objects", "test", "plug"))]
    rows += [("/b", "/s/shared.cpp", "/b/CMakeFiles/test.dir/shared.o", ["g++", "test"], 10), ("/b", "/s/shared.cpp", "/b/CMakeFiles/app.dir/shared.o", ["g++", "app"], 11)]
    return spark.createDataFrame(rows, "directory string, file string, output string, arguments array<string>, index long")


def test_closure_and_commands(build, commands):
    found = selection.select_commands(build, commands, target="app")
    assert found.context.closure_targets == ["app", "core", "iface", "objects"] and not found.infer_exports
    assert {r["index"] for r in found.commands.collect()} == {0, 1, 2, 11}
    assert "dependency id-gone is no target of the build" in found.diagnostics and "static library core is linked whole" in found.diagnostics
    assert selection.select_commands(build, commands, target="plug").infer_exports


def test_selection_errors(build, commands):
    for target, error, message in (("", ValueError, "multiple executable"), ("core", IncompleteRun, "public headers"), ("iface", IncompleteRun, "compilation context")):
        with pytest.raises(error, match=message):
            selection.select_commands(build, commands, target=target)
    with pytest.raises(ValueError, match="no compilation command"):
        selection.select_commands(build, commands.filter("index <> 1"), target="app")
    more = commands.union(commands.filter("index = 0").withColumn("arguments", F.array(F.lit("x"))).withColumn("index", F.lit(20).cast("long")))
    with pytest.raises(ValueError, match="ambiguous"):
        selection.select_commands(build, more, target="app")
    with pytest.raises(ValueError, match="require a selected library"):
        selection.select_commands(build, commands, target="app", explicit_api=True)
    assert selection.select_commands(build, commands, target="core", explicit_api=True).commands.count() == 2
    with pytest.raises(IncompleteRun):
        selection.commands_below(commands, "/elsewhere")


def test_manual_roots_and_headers(spark):
    facts, notes = selection.with_manual_roots(make_facts(spark, [symbol("a"), symbol("b")]), ["ns::a", "b", "none"])
    assert {(r.symbol, r.kind) for r in facts.roots.collect()} == {("a", "manual"), ("b", "manual")} and notes == ["root none matched no symbol"]
    declared = spark.createDataFrame([("/s/a.h",)], "file string")
    selection.require_observed(["/s/a.h"], declared)
    with pytest.raises(IncompleteRun, match="not observed"):
        selection.require_observed(["/s/a.h", "/s/b.h"], declared)


def test_program(spark, tmp_path):
    d = Dump("/p/a.cpp")
    d.add(d.decl("FunctionDecl", "live"), d.decl("FunctionDecl", "dead"), d.decl("FunctionDecl", "main", [call("live")]))
    (tmp_path / "a.cpp.json").write_text(d.text())
    base = [str(tmp_path / "a.cpp.json"), "--project-root", "/p", "--format", "json", "--output", str(tmp_path / "out.json"), "--graph-output", str(tmp_path / "graph.json")]
    assert run(spark, options([*base, "--fail-on-unreachable"])) == 2
    out = json.loads((tmp_path / "out.json").read_text())
    assert [f["qualified_name"] for f in out["findings"]] == ["dead"] and out["summary"]["reachable"] == 2
    assert run(spark, options([*base, "--root", "dead", "--fail-on-unreachable"])) == 0
    run(spark, options(base))
    (tmp_path / "policy.yaml").write_text("schema_version: 2")
    first = (tmp_path / "graph.json").read_text()
    (tmp_path / "old.json").write_text(first)
    d.add(d.decl("FunctionDecl", "worse"))
    (tmp_path / "a.cpp.json").write_text(d.text())
    more = ["--baseline-graph", str(tmp_path / "old.json"), "--diff-policy", str(tmp_path / "policy.yaml"), "--fail-on-diff"]
    assert run(spark, options([*base, *more])) == 2
    assert json.loads((tmp_path / "out.json").read_text())["summary"]["new_symbol"] == 1
    assert run(spark, options([base[0], "--project-root", "/elsewhere", "--format", "json", "--output", str(tmp_path / "bad.json"), "--callback-registration", "none:0"])) == 1
    assert "findings" not in json.loads((tmp_path / "bad.json").read_text())
    with pytest.raises(SystemExit):
        options([*base, "--format", "sarif"])


def test_program_of_a_target(spark, tmp_path, capsys):
    for name, inner in (("app", [call("used")]), ("used", []), ("other", [])):
        d = Dump(f"/p/{name}.cpp")
        d.add(d.decl("FunctionDecl", "used", body=name == "used", file="/p/used.cpp"), d.decl("FunctionDecl", f"idle_{name}"), *([d.decl("FunctionDecl", "main", inner)] if name == "app" else []))
        (tmp_path / "dumps/p").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"dumps/p/{name}.cpp.json").write_text(d.text())
    names = ("app", "used", "other")
    (tmp_path / "commands.json").write_text(json.dumps([{"directory": "/p", "file": f"{n}.cpp", "command": f"g++ -c {n}.cpp"} for n in names]))
    targets = [{"id": n, "name": n, "type": "executable" if n != "used" else "object_library", "sources": [f"{n}.cpp"], "dependencies": ["used"] if n == "app" else []} for n in names]
    (tmp_path / "targets.json").write_text(json.dumps({"schema_version": 1, "source_root": "/p", "build_root": "/b", "configurations": [{"name": "Debug", "targets": targets}]}))
    base = ["--dump-root", str(tmp_path / "dumps"), "--compile-commands", str(tmp_path / "commands.json"), "--format", "json", "--output", str(tmp_path / "out.json"), "--verbose"]
    one = [*base, "--target-manifest", str(tmp_path / "targets.json"), "--target", "app", "--cache-dir", str(tmp_path / "cache")]
    expected = ["idle_app", "idle_used"]
    for reused in (0, 2):
        assert run(spark, options(one)) == 0
        out = json.loads((tmp_path / "out.json").read_text())
        assert sorted(f["qualified_name"] for f in out["findings"]) == expected and out["mode"] == "target"
        assert out["analysis_context"]["closure_targets"] == ["app", "used"] and out["analysis_context"]["configuration_id"] == "Debug"
        assert f"translation_units=2 indexed_units={2 - reused} reused_units={reused} " in capsys.readouterr().err
    every = [*base, "--project-root", "/p"]
    assert run(spark, options([*every, "--ast-filter", "idle", "--root", "idle_app"])) == 0
    out = json.loads((tmp_path / "out.json").read_text())
    assert sorted(f["qualified_name"] for f in out["findings"]) == ["idle_other", "idle_used"] and "idle" in out["diagnostics"][0]
    assert run(spark, options([*every, "--tu-root", "/elsewhere"])) == 1
    assert run(spark, options([*every, "--frontend", "libtooling"])) == 1
    assert json.loads((tmp_path / "out.json").read_text())["run"]["state"] == "unsupported"
    (tmp_path / "dumps/p/used.cpp.json").unlink()
    assert run(spark, options(one[:-2])) == 1
    assert "used.cpp" in json.loads((tmp_path / "out.json").read_text())["run"]["cause"]
    for wrong in (["--target", "app"], ["--tu-root", "/p"], ["--no-cache", "--cache-dir", "x"]):
        with pytest.raises(SystemExit):
            options(["a.json", "--project-root", "/p", *wrong])


def test_cancellation(spark):
    with selection.cancellable(spark, "slow", 1) as watch, pytest.raises(Exception, match="(?i)cancel"):
        spark.range(10**13).selectExpr("sum(hash(id))").collect()
    assert watch.expired


def test_diagnostics_and_configurations_have_no_limit(spark):
    from pyspark.sql import functions as F

    from reachlake.operators.targets import select_configuration
    from reachlake.plans.selection import fallback_notes

    symbols = spark.range(1200).select(F.format_string("%05d", "id").alias("key"), F.concat(F.lit("f"), "id").alias("qualified_name"), F.struct(F.lit("fallback").alias("quality")).alias("identity"))
    assert fallback_notes(symbols) == [f"fallback identity for f{i}" for i in range(1200)]
    targets = spark.range(150).select(F.concat(F.lit("c"), "id").alias("configuration"))
    assert [select_configuration(targets, f"c{i}") for i in range(0, 150, 10)] == [f"c{i}" for i in range(0, 150, 10)]
