"""Hand-built graphs with known answers."""

import io
import json
import random

import pytest
from pyspark.sql import functions as F

from reachlake.functions.keys import stable_key
from reachlake.operators import aggregate, classify, components, diff, merge, resolve, targets
from reachlake import storage
from reachlake.operators import reach as reach_loop
from reachlake.operators.reach import reach, unreachable, with_reach
from reachlake.plans import analysis, queries
from reachlake.schema import EDGE, ESCAPE, ROOT, SUPPRESSION, SYMBOL, Facts
from reachlake.sinks import artifact, documents
from reachlake.sinks.documents import Context


def test_no_join_of_a_loop_broadcasts(spark, monkeypatch):
    """Whatever is broadcast goes through the driver, so what grows with the input is joined by merging, also where it is small."""
    plans = []
    for module in (reach_loop, components, documents, merge):
        kept = module.written
        monkeypatch.setattr(module, "written", lambda df, name, kept=kept: (plans.append(df._jdf.queryExecution().executedPlan().toString()), kept(df, name))[1])
    edges = [("r", "a", "direct_call"), ("b", "c", "direct_call"), ("c", "b", "direct_call"), ("c", "d", "direct_call")]
    facts = make_facts(spark, [symbol(x, file="f.cpp", lines=(1, 2)) for x in "rabcd"], edges, [("r", "manual")], [("b", "a")])
    reached = with_reach(facts)
    found = classify.findings(facts, reached)
    nodes = unreachable(reached).select("key")
    strong = components.strong_components(nodes, components.induced(nodes, facts.edges))
    owned = aggregate.ownership(strong.join(storage.merged(facts.symbols.withColumns({"file": F.lit("f"), "begin_line": F.lit(1), "end_line": F.lit(2)})), "key"))
    changed = diff.changes(facts, facts.with_(roots=facts.roots.limit(0)))
    order = components.component_order(strong, nodes.select("key", *[F.lit("x").alias(c) for c in ("file", "line", "column", "qualified_name", "signature")]))
    last = (found, strong, owned, changed, classify.summary(facts, reached), classify.provider_provenance(facts, reached), components.condensation(strong, facts.edges))
    plans += [df._jdf.queryExecution().executedPlan().toString() for df in last]
    assert order.count() == 2 and sorted(r.scc for r in strong.collect()) == ["b", "b", "d"]
    assert len(plans) > 12 and not [p for p in plans if "BroadcastHashJoin" in p and "_range" not in p]


def test_small_components_share_a_group(spark, monkeypatch):
    monkeypatch.setattr(components, "GROUP", 4)
    nodes = spark.createDataFrame([(i,) for i in range(40)], "key long")
    edges = spark.createDataFrame([(i, i ^ 1) for i in range(40)] + [(1, 2)], "src long, dst long")
    rows = components.strong_components(nodes, edges).collect()
    assert sorted((r.key, r.scc, r.component) for r in rows) == [(i, i & ~1, 0 if i < 4 else i & ~1) for i in range(40)]


def test_sarif_in_parts_is_the_same_document(spark, tmp_path):
    facts = make_facts(spark, [symbol(x, file="f.cpp", lines=(1, 2)) for x in "abc"], (), [("a", "manual")])
    changed = diff.changes(facts.with_(symbols=facts.symbols.filter("key = 'a'")), facts)
    out = io.StringIO()
    documents.write_sarif(out, changed, facts.symbols)
    documents.write_sarif_parts(str(tmp_path / "parts"), changed, facts.symbols)
    assert out.getvalue() == "".join(p.read_text() for p in sorted((tmp_path / "parts").glob("part-*")))
    assert len(json.loads(out.getvalue())["runs"][0]["results"]) == 2
    documents.write_sarif_parts(str(tmp_path / "none"), changed.limit(0), facts.symbols)
    assert json.loads("".join(p.read_text() for p in sorted((tmp_path / "none").glob("part-*"))))["runs"][0]["results"] == []


def point(file="", line=0, column=0):
    return (file, line, column, 0, 1)


def symbol(name, scope="reportable", defined=True, cls="", file="", lines=(0, 0), internal=False, virtual=False, kind="function"):
    extent = (point(file, lines[0], 1), point(file, lines[0], 1), point(file, lines[1], 2))
    return (name, ("stable", "default", "", name, "", ""), name, f"ns::{name}", cls, "void ()", kind, scope, defined, internal, virtual, (extent, None))


def make_facts(spark, symbols, edges=(), roots=(), escapes=(), suppressions=()):
    why = ("test", "because")
    return Facts(
        spark.createDataFrame(symbols, SYMBOL), spark.createDataFrame([(a, b, k, why) for a, b, k in edges], EDGE), spark.createDataFrame([(s, k, why) for s, k in roots], ROOT),
        spark.createDataFrame([(s, f, "address_taken", why) for s, f in escapes], ESCAPE), spark.createDataFrame([(s, why) for s in suppressions], SUPPRESSION),
    )


@pytest.fixture(scope="module")
def reaching(spark):
    names = ["root", "a", "b", "escaped", "provider", "both", "behind_opaque"]
    symbols = [symbol(n) for n in names] + [symbol("live", "indexed"), symbol("opaque", "external_opaque", defined=False)]
    edges = [("root", "live", "direct_call"), ("root", "live", "direct_call"), ("a", "b", "direct_call"), ("b", "a", "direct_call"), ("root", "provider", "callback_registration"), ("a", "provider", "callback_registration")]
    edges += [("root", "both", "callback_registration"), ("root", "both", "direct_call"), ("root", "opaque", "direct_call"), ("opaque", "behind_opaque", "direct_call")]
    return make_facts(spark, symbols, edges, [("root", "manual"), ("root", "manual")], [("escaped", "root"), ("escaped", "root")])


def keys(df, column="key"):
    return {r[0] for r in df.select(column).collect()}


def test_reachability(spark, reaching):
    assert merge.distinct_facts(reaching.edges).count() == 9
    found = {r.key: r.structural for r in reach(reaching).collect()}
    assert set(found) == {"root", "live", "provider", "both", "opaque"}
    assert [k for k, s in found.items() if not s] == ["provider"]


def test_findings_of_the_reaching_graph(spark, reaching):
    reached = with_reach(reaching)
    found = {r.key: r for r in classify.findings(reaching, reached).collect()}
    assert set(found) == {"a", "b", "escaped", "behind_opaque"}
    assert found["escaped"].classification == "dynamically_referenced"
    assert [e.kind for e in found["escaped"].evidence] == ["no_reachable_path", "escape"]
    assert found["escaped"].evidence[1]["from"] == "root"
    assert found["a"].classification == "likely_dead"
    assert [(r.symbol, r["from"]) for r in classify.provider_provenance(reaching, reached).collect()] == [("provider", "root")]


@pytest.fixture(scope="module")
def aggregating(spark):
    widget = "src/feature/widget.cpp"
    symbols = [
        symbol("feature-a", cls="Widget", file=widget, lines=(10, 20)), symbol("feature-b", cls="Widget", file=widget, lines=(18, 25)), symbol("feature-c", file=widget, lines=(30, 35)),
        symbol("feature-d", file="src/feature/helper.cpp", lines=(1, 4)), symbol("disconnected", file="src/other.cpp", lines=(100, 100)), symbol("unmeasured"), symbol("indexed-bridge", "indexed"),
    ]
    edges = [("feature-a", "feature-b", "direct_call"), ("feature-b", "feature-a", "direct_call"), ("feature-b", "feature-c", "direct_call"), ("feature-b", "feature-c", "provider")]
    edges += [("feature-d", "indexed-bridge", "direct_call"), ("indexed-bridge", "disconnected", "direct_call"), ("feature-c", "feature-d", "constructs")]
    return make_facts(spark, symbols, edges, [], [("unmeasured", "feature-a")], ["feature-c"])


@pytest.mark.parametrize("small", [components.SMALL, 1])
def test_components_and_lines(spark, aggregating, small):
    reached = with_reach(aggregating)
    found = analysis.places(classify.findings(aggregating, reached))
    inner = components.induced(found, aggregating.edges)
    strong = components.strong_components(found, inner, small)
    members = {r.key: (r.scc, r.component) for r in strong.collect()}
    assert members["feature-a"] == members["feature-b"] == ("feature-a", "feature-a")
    assert len({c for _, c in members.values()}) == 3 and len({s for s, c in members.values() if c == "feature-a"}) == 3
    assert components.condensation(strong, inner).count() == 2
    rows = found.join(strong.select("key", "component"), "key")
    lines = {r.component: r for r in aggregate.line_counts(rows, ["component"]).collect()}
    assert (lines["feature-a"].lines, lines["feature-a"].members) == (26, 4)
    assert (lines["unmeasured"].lines, lines["unmeasured"].unmeasured) == (0, 1)
    owned = {(r.level, r.label): (r.lines, r.members) for r in aggregate.ownership(rows).collect()}
    assert owned["type", "Widget"] == (16, 2) and owned["directory", "src/feature"] == (26, 4)
    assert keys(classify.suppressed(found)) == {"feature-c"}


def test_strong_components_on_random_graphs(spark):
    rng = random.Random(5)
    for turn in range(3):
        n = 24
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(30 + 8 * turn)]
        reaches = {(a, a) for a in range(n)} | set(edges)
        for k in range(n):
            reaches |= {(a, b) for a in range(n) if (a, k) in reaches for b in range(n) if (k, b) in reaches}
        want = {a: min(b for b in range(n) if (a, b) in reaches and (b, a) in reaches) for a in range(n)}
        nodes, table = spark.createDataFrame([(i,) for i in range(n)], "key long"), spark.createDataFrame(edges, "src long, dst long")
        for small in (1000, 2):
            assert {r.key: r.scc for r in components.strong_components(nodes, table, small).collect()} == want


def test_interval_union_touching_ranges(spark):
    rows = spark.createDataFrame([(1, "f", 1, 3), (1, "f", 4, 6), (1, "f", 8, 8), (1, "f", 2, 5), (1, None, 1, 9), (1, "f", 0, 4), (1, "f", 5, 2), (2, "f", 1, 1)], "g int, file string, begin_line int, end_line int")
    assert sorted(tuple(r) for r in aggregate.line_counts(rows, ["g"]).collect()) == [(1, 7, 7, 3), (2, 1, 1, 0)]


def sides(spark):
    def own(*names):
        return [symbol(n, internal=True) for n in names]

    old = make_facts(spark, own("root", "regression", "removed", "recovered"), [("root", "regression", "direct_call")], [("root", "manual")])
    new = make_facts(spark, own("root", "regression", "recovered", "new_dead", "new_live", "suppressed"), [("root", "recovered", "direct_call"), ("root", "new_live", "direct_call")], [("root", "manual")], [], ["suppressed"])
    return old, new


def test_comparison_matrix(spark):
    old, new = sides(spark)
    changed = diff.changes(old, new)
    assert diff.counters(changed).first().asDict() == {"new_symbol": 3, "newly_unreachable": 1, "removed": 1, "became_reachable": 1, "policy_matches": 2}
    assert keys(changed.filter("policy_match")) == {"new_dead", "regression"}
    out = io.StringIO()
    assert analysis.gate(out, (old, Context()), (new, Context()), diff.Policy()) == 2
    assert json.loads(out.getvalue())["summary"]["policy_matches"] == 2
    out = io.StringIO()
    assert analysis.gate(out, (old, Context()), (old, Context()), diff.Policy(), "human") == 0
    out = io.StringIO()
    analysis.gate(out, (old, Context()), (new, Context()), diff.Policy(), "sarif")
    results = json.loads(out.getvalue())["runs"][0]["results"]
    assert [r["ruleId"] for r in results] == ["reachlake.new_symbol.dead", "reachlake.newly_unreachable.dead"]


def test_incompatible_runs(spark):
    with pytest.raises(ValueError, match="configuration_id"):
        diff.require_compatible(diff.RunContext("a"), diff.RunContext("b"), diff.Policy())
    with pytest.raises(ValueError, match="doesn't apply"):
        diff.require_compatible(diff.RunContext(), diff.RunContext(), diff.Policy(targets=("app",)))


def test_artifact_round_trip_is_stable(spark, reaching, aggregating, tmp_path):
    """In one file or in parts, an artifact of the same facts has the same bytes, and gives the same facts."""
    for i, facts in enumerate((reaching.with_(edges=reaching.edges.distinct(), roots=reaching.roots.distinct(), escapes=reaching.escapes.distinct()), aggregating)):
        first, second = io.StringIO(), io.StringIO()
        artifact.write_artifact(first, facts, Context(), ["b", "a", "b"])
        (tmp_path / f"{i}.json").write_text(first.getvalue())
        read, context = artifact.read_artifact(spark, str(tmp_path / f"{i}.json"))
        shuffled = read.with_(symbols=read.symbols.orderBy(F.rand(3)), edges=read.edges.orderBy(F.rand(4)))
        artifact.write_artifact(second, shuffled, context, ["a", "b"])
        assert first.getvalue() == second.getvalue()
        json.loads(first.getvalue())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        artifact.write_artifact_parts(str(tmp_path / "parts"), shuffled, context, ["a", "b"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted((tmp_path / "parts").glob("part-*"))
    assert len(parts) > 1 and "".join(p.read_text() for p in parts) == first.getvalue()
    again, _ = artifact.read_artifact(spark, str(tmp_path / "parts"))
    assert again.symbols.exceptAll(read.symbols).isEmpty() and again.edges.count() == read.edges.count()


def test_artifact_reader_is_strict(spark, aggregating, tmp_path):
    out = io.StringIO()
    artifact.write_artifact(out, aggregating, Context())

    def edge(**change):
        return {"from": "x", "to": "y", "kind": "direct_call", "evidence": {"provider": "", "reason": ""}} | change

    changes = [
        (lambda d: d.update(extra=1), "unknown key"), (lambda d: d.update(artifact_schema_version=6), "version"), (lambda d: d["edges"].append(edge()), "unknown symbols"), (lambda d: d["symbols"].append(d["symbols"][0]), "duplicate symbol"),
        (lambda d: d["symbols"][0].update(kind="thing"), "symbols of the artifact.*kind"), (lambda d: d.update(roots={}), "wrong type"),
    ]
    for change, message in changes:
        document = json.loads(out.getvalue())
        change(document)
        (tmp_path / "a.json").write_text(json.dumps(document))
        with pytest.raises(ValueError, match=message):
            artifact.read_artifact(spark, str(tmp_path / "a.json"))


def test_analysis_documents(spark, reaching):
    found = analysis.analyze(reaching)
    out = io.StringIO()
    analysis.report(out, found, Context(), diagnostics=("note",))
    document = json.loads(out.getvalue())
    assert document["summary"]["unreachable"] == 4 and [f["key"] for f in document["findings"]] == ["a", "b", "behind_opaque", "escaped"]
    s = document["summary"]
    assert s["defined"] == s["reachable"] + s["unreachable"] and s["reachable"] == s["structural"] + s["provider"] and s["unreachable"] == s["actionable"] + s["suppressed"]
    members = {m["key"]: m for m in document["component_members"]}
    assert members["a"]["component"] == members["b"]["component"] and len({m["component"] for m in members.values()}) == len(document["unreachable_components"]) == 3
    assert sum(c["sccs"] for c in document["unreachable_components"]) == len({m["scc"] for m in members.values()})
    assert {f["key"]: (f["component"], f["scc"]) for f in document["findings"]} == {k: (m["component"], m["scc"]) for k, m in members.items()}
    ends = {(e["from_scc"], e["to_scc"]) for e in document["component_edges"]}
    assert ends <= {(x["scc"], y["scc"]) for x in members.values() for y in members.values() if x["component"] == y["component"]}
    assert {r["symbol"] for r in document["roots"]} == {r.symbol for r in reaching.roots.collect()} and all(r["symbol_name"] for r in document["roots"])
    out = io.StringIO()
    analysis.report(out, found, Context(), "human")
    text = out.getvalue()
    assert [x for x in text.split() if x in ("RUN", "SUMMARY", "ROOTS")] == ["RUN", "SUMMARY", "ROOTS"] and text.count("\nCOMPONENT ") == 3 and ": 2 actionable and 0 suppressed members" in text


def test_report_sections(spark):
    symbols = [symbol(n, cls="C" if n in ("f", "g") else "", file="/p/a.cpp", lines=(i * 10 + 1, i * 10 + 5)) for i, n in enumerate(("main", "api", "f", "g", "kept", "hidden"))]
    evidence = ("t", "why")
    facts = make_facts(spark, symbols, [("f", "g", "direct_call"), ("main", "kept", "provider")], [("main", "application_entry_point"), ("api", "public_api")], [("f", "main")])
    hidden = spark.createDataFrame([("hidden", evidence)], facts.suppressions.schema)
    found = analysis.analyze(facts.with_(suppressions=hidden))
    out = io.StringIO()
    analysis.report(out, found, Context(target_name="app", target_kind="executable", closure_targets=["app"]))
    document = json.loads(out.getvalue())
    assert [(o["level"], o["label"], o["members"], o["lines"]) for o in document["ownership"] if o["component"] == next(f["component"] for f in document["findings"] if f["key"] == "f")] == [("directory", "/p", 2, 10), ("file", "/p/a.cpp", 2, 10), ("type", "C", 2, 10)]
    assert [f["evidence"][1]["from_symbol"] for f in document["findings"] if f["key"] == "f"] == ["ns::main"]
    assert [p["symbol"] for p in document["public_api"]] == ["api"] and [(p["symbol"], p["from"]) for p in document["provider_reachable"]] == [("kept", "main")]
    assert [s["key"] for s in document["suppressed"]] == ["hidden"] and len(document["component_edges"]) == 1
    out = io.StringIO()
    analysis.report(out, found, Context(target_name="app", target_kind="executable", closure_targets=["app"]), "human")
    text = out.getvalue()
    places = [text.index(x) for x in ("TARGET app", "SUMMARY", "ROOTS", "PUBLIC API", "PROVIDER-REACHABLE", "COMPONENT", "SUPPRESSED")]
    assert places == sorted(places) and text.count("\nCOMPONENT") == 1 and "  type C: 2 symbols, about 10 lines" in text and "suppressed by t: why" in text and "from ns::main" in text


def test_incomplete_runs(spark, aggregating, reaching):
    with pytest.raises(analysis.IncompleteRun, match="root"):
        analysis.analyze(aggregating)
    units = spark.createDataFrame([("a.cpp", "indexed"), ("b.cpp", "failed"), ("c.cpp", "skipped")], "file string, status string")
    with pytest.raises(analysis.IncompleteRun) as error:
        analysis.analyze(reaching, units)
    out = io.StringIO()
    assert analysis.failed(Context(), error.value, out=out) == 1
    assert "findings" not in json.loads(out.getvalue())


def test_dangling_references(spark, reaching):
    with pytest.raises(ValueError, match="unknown symbols"):
        artifact.check_references(reaching.with_(symbols=reaching.symbols.filter("key <> 'opaque'")))


def test_merge_does_not_depend_on_order(spark):
    rows = [symbol("x", "external_opaque", False, file="z.h", lines=(9, 9)), symbol("x", "indexed", True, file="b.cpp", lines=(7, 8)), symbol("x", "reportable", False, file="a.h", lines=(1, 1)), symbol("y")]
    want = None
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        place = [F.col("source.spelling.location.file"), F.col("source.spelling.location.line")]
        merged = sorted(map(str, merge.merge_symbols(spark.createDataFrame(rows, SYMBOL), place).collect()))
        assert want in (None, merged)
        want = merged
    first = merge.merge_symbols(spark.createDataFrame(rows, SYMBOL), place).filter("key = 'x'").first()
    assert (first.scope, first.defined, first.source.spelling.location.line) == ("reportable", True, 7)


def test_merge_conflicts(spark):
    rows = spark.createDataFrame([symbol("x"), symbol("x", kind="method"), symbol("y", internal=True), symbol("y"), symbol("z")], SYMBOL)
    assert {tuple(r) for r in merge.merge_conflicts(rows).collect()} == {("x", "kind"), ("y", "internal_linkage")}
    with pytest.raises(ValueError, match="conflict"):
        merge.require_empty(merge.merge_conflicts(rows), "conflict")


def test_stable_key(spark):
    lit = F.lit
    row = spark.range(1).select(stable_key(lit("c"), lit(""), lit("é"), lit("f"), lit("u")).alias("k")).first()
    assert row.k == "reachlake-symbol-v1|configuration=1:c|anchor=3:usr|value=2:é|translation_unit=1:u"
    with pytest.raises(Exception, match="anchor"):
        spark.range(1).select(stable_key(lit("c"), lit(""), lit(""), lit(""), lit("u")).alias("k")).collect()


def test_closures(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "x"), ("c", "d")], "node string, parent string")
    assert {tuple(r) for r in components.closure(pairs).collect()} == {("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d"), ("x", "x")}
    deps = spark.createDataFrame([("app", "core"), ("core", "objects"), ("app", "shared"), ("core", "app"), ("test", "core")], "target string, dependency string")
    start = spark.createDataFrame([("app",)], "target string")
    assert keys(targets.target_closure(deps, start), "target") == {"app", "core", "objects", "shared"}


def test_target_selection(spark):
    rows = spark.createDataFrame([("Debug", "1", "app", "executable"), ("Debug", "2", "test", "executable"), ("Debug", "3", "core", "static_library")], "configuration string, id string, name string, kind string")
    assert targets.select_configuration(rows) == "Debug" and targets.select_target(rows, "Debug", "core") == "3"
    for name, message in (("", "multiple executable targets"), ("none", "unknown target")):
        with pytest.raises(ValueError, match=message):
            targets.select_target(rows, "Debug", name)


def test_command_preference(spark):
    rows = spark.createDataFrame([("b/CMakeFiles/app.dir/Debug/x.o",), ("CMakeFiles/app.dir/x.o",), ("x.o",), (None,)], "output string")
    assert [r[0] for r in rows.select(targets.command_preference(F.col("output"), F.lit("app"), F.lit("Debug"))).collect()] == [0, 1, 2, 2]
    commands = spark.createDataFrame([("a", 1, 5, "x"), ("a", 1, 3, "y"), ("a", 2, 1, "z"), ("b", 0, 2, "q")], "source string, preference int, index int, arguments string")
    sources = spark.createDataFrame([("a",), ("b",), ("c",)], "source string")
    found = {r.source: (r["index"], r.ambiguous) for r in resolve.preferred_commands(sources, commands, ["arguments"]).collect()}
    assert found == {"a": (3, True), "b": (2, False), "c": (None, False)}


def test_registrations(spark):
    calls = spark.createDataFrame([(1, "f", "reg"), (2, "g", "reg")], "call int, src string, callee string")
    rules = spark.createDataFrame([("r", "reg", 1)], "rule string, callee string, argument_index int")
    args = spark.createDataFrame([(1, 0, "x"), (1, 1, "h"), (2, 1, "k")], "call int, position int, dst string")
    assert {tuple(r) for r in resolve.registrations(calls, rules, args).collect()} == {("f", "h", "r"), ("g", "k", "r")}
    with pytest.raises(ValueError, match="did not match a registrar call"):
        resolve.registrations(calls, spark.createDataFrame([("q", "other", 0)], rules.schema), args)
    with pytest.raises(ValueError, match="not a callable"):
        resolve.registrations(calls, rules, args.filter("call = 1"))


def test_base_resolution(spark):
    bases = spark.createDataFrame([("n::D", "B"), ("D2", "m::B"), ("E", "B"), ("G", "Missing")], "class_name string, base string")
    classes = spark.createDataFrame([("n::B",), ("m::B",), ("n::D",)], "class_name string")
    assert {tuple(r) for r in resolve.resolve_bases(bases, classes).collect()} == {("n::D", "n::B"), ("D2", "m::B"), ("E", "m::B"), ("G", "Missing")}


def test_pairs_of_suffixes(spark, monkeypatch):
    """The same pairs as the join over last components, with repeated rows, and nothing for rows without a name or key."""
    for name, value in (("LEFT_BLOCK", 3), ("RIGHT_BLOCK", 2), ("TASK_PAIRS", 50)):
        monkeypatch.setattr(resolve, name, value)
    rng = random.Random(3)
    names = ["C", "m::C", "lib::m::C", "n::C", "lib::n::C", "xC", "m::xC", "m", "", "a:C", None]
    left = spark.createDataFrame([(i % 70, rng.choice(names)) for i in range(80)] + [(None, "C")], "dst long, class_name string")
    right = spark.createDataFrame([(i % 90, rng.choice(names)) for i in range(100)] + [(None, "C")], "src long, type string")
    got = resolve.suffix_pairs(left, "class_name", "dst", right, "type", "src")
    want = resolve.suffix_join(left.filter("dst is not null"), "class_name", right.filter("src is not null"), "type")
    assert sorted(map(tuple, got.select("src", "dst").collect())) == sorted(map(tuple, want.select("src", "dst").collect())) and want.count() > 500
    assert resolve.suffix_pairs(left.limit(0), "class_name", "dst", right, "type", "src").count() == 0


def test_pairs_of_one_frequent_name_are_dealt_over_tasks(spark, tmp_path, monkeypatch):
    """600 constructors and uses of one name make 360,000 pairs, of which no task may get many."""
    for name, value in (("LEFT_BLOCK", 50), ("RIGHT_BLOCK", 50), ("TASK_PAIRS", 20_000)):
        monkeypatch.setattr(resolve, name, value, raising=False)
    part = spark.range(600).select((F.col("id") * 350 + 3).alias("p_partkey"), *[F.lit("x").alias(c) for c in ("p_name", "p_brand", "p_type")], F.lit(1).alias("p_size"))
    part.write.parquet(str(tmp_path / "part.parquet"))
    pairs = queries.construct_suffix_join(spark, str(tmp_path))
    by_task = [r.n for r in pairs.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(by_task) == pairs.distinct().count() == 360_000 and max(by_task) < 60_000


def test_offsets_to_lines(spark):
    files = spark.createDataFrame([("f", "ab\né\n\nx")], "file string, text string")
    asked = spark.createDataFrame([("f", i) for i in range(8)], "file string, offset int")
    assert {r.offset: r.line for r in resolve.lines_of_offsets(files, asked).collect()} == {0: 1, 1: 1, 2: 1, 3: 2, 4: 2, 5: 2, 6: 3, 7: 4}


def test_unreachable_ignores_synthetic(spark):
    facts = make_facts(spark, [symbol("s", kind="synthetic"), symbol("d"), symbol("e", defined=False)], (), [("s", "manual")])
    assert keys(unreachable(with_reach(facts))) == {"d"}
