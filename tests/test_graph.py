import numpy as np
import pytest

from ripplegraph import cli, registry
from ripplegraph.operators import graph as ops
from ripplegraph.plans import queries as plans
from ripplegraph.sources.model import Graph, ModelError, UnknownElement, from_document

# The golden graph of FIXTURES.md, section 1.1; id: supports, owns, consumes, depends on, runs on
APPS = {
    "A01": ("C01 C03", "D04", "D01 D02", "A05", "T01"), "A02": ("C02", "D01", "", "", "T01"), "A03": ("C02", "D02", "", "", "T01"), "A04": ("C01", "D03", "", "", "T01"),
    "A05": ("C04", "D05", "D01 D02 D03", "", "T03 T02"), "A06": ("C05", "D06", "", "A05", "T02"), "A07": ("C03", "", "D04 D05", "A01 A05", "T01"),
}


def document(apps=APPS):
    types = ("SUPPORTS", "OWNS", "CONSUMES", "DEPENDS_ON", "RUNS_ON")
    of = lambda letter, n: [{"id": f"{letter}{i:02}", "name": f"{letter} number {i}"} for i in range(1, n + 1)]
    edges = [{"from": a, "type": t, "to": x} for a, row in apps.items() for t, ids in zip(types, row) for x in ids.split()]
    return {"capabilities": of("C", 5), "applications": [a | {"lifecycle": "tolerated" if a["id"] in ("A02", "A06") else "strategic"} for a in of("A", 7)], "data_objects": of("D", 6), "technologies": of("T", 4), "relationships": edges}


@pytest.fixture(scope="module")
def g(spark):
    return from_document(spark, document())


def ids(rows):
    return " ".join(r.id for r in rows.orderBy("id").collect())


def at(rows, root):
    return ids(rows.where(f"root = '{root}'"))


def test_questions(g):
    assert at(ops.inbound(g, "SUPPORTS"), "C01") == "A01 A04"
    assert at(ops.inbound(g, "DEPENDS_ON"), "A05") == "A01 A06 A07"
    assert at(ops.only_source(g, "OWNS"), "A05") == "D05"
    assert at(ops.only_source(g, "SUPPORTS"), "A05") == "C04"
    assert at(ops.indirect_dependents(g), "A05") == "A07"
    assert at(ops.only_source(g, "RUNS_ON"), "A05") == "T03"
    assert at(ops.consumers_without_ownership(g), "D01") == "A01 A05"
    assert ids(ops.unaffected(g, "A05")) == "C02"
    assert at(ops.outbound(g, "CONSUMES"), "A05") == "D01 D02 D03"


def test_degraded_and_paths(g):
    found = {}
    for r in ops.degraded(g).orderBy("root", "id").collect():
        found.setdefault(r.root, []).append(f"{r.id}({r.via})")
    assert found == {"A01": ["C01(A01)", "C03(A01)"], "A02": ["C02(A02)"], "A03": ["C02(A03)"], "A04": ["C01(A04)"], "A05": ["C01(A01)", "C03(A01)", "C05(A06)"], "A07": ["C03(A07)"]}
    row = ops.shown(ops.indirect_dependents(g)).where("root = 'A05'").first()
    assert row.path == "A07 -DEPENDS_ON-> A01 ; A01 -DEPENDS_ON-> A05" and row.via == "A01"


def test_a06_loses_its_only_capability(g):
    assert at(ops.only_source(g, "SUPPORTS"), "A06") == "C05"
    assert at(ops.degraded(g), "A06") == ""


def test_sections_split_the_capabilities(g):
    for row in ops.impact_summary(g).collect():
        assert row.n_lost + row.n_degraded + row.n_unaffected == 5
        assert row.n_transitive <= row.n_direct + row.n_indirect


def test_cycles_and_ties(spark):
    edges = lambda *pairs: {"applications": [{"id": x, "name": x} for x in "ABCD"], "relationships": [{"from": a, "type": "DEPENDS_ON", "to": b} for a, b in pairs]}
    cyclic = from_document(spark, edges("BA", "CB", "AC"))
    assert [(r.id, r.depth) for r in ops.transitive_dependents(cyclic).where("root = 'A'").orderBy("id").collect()] == [("B", 1), ("C", 2)]
    tied = from_document(spark, edges("BA", "CA", "DC", "DB"))
    assert ops.shown(ops.transitive_dependents(tied, "A")).where("id = 'D'").first().path == "D -DEPENDS_ON-> B ; B -DEPENDS_ON-> A"


@pytest.mark.parametrize(
    ("change", "errors"),
    [
        ([("A01", "OWNS", "D99")], 1), ([("A01", "RUNS_ON", "D01")], 1), ([("A01", "USES", "D01")], 1), ([("A01", "OWNS", "D98"), ("A01", "OWNS", "D99")], 2),
        ([("A01", "CONSUMES", "D01")], 1), ([("A01", "OWNS", "D01")], 1), ([("A01", "DEPENDS_ON", "A01")] * 2, 2),
    ],
)
def test_every_problem_is_reported(spark, change, errors):
    base = {"applications": [{"id": "A01", "name": "a"}], "data_objects": [{"id": "D01", "name": "d"}]}
    edges = [("A01", "OWNS", "D01"), *change]
    with pytest.raises(ModelError) as raised:
        from_document(spark, base | {"relationships": [dict(zip(("from", "type", "to"), e)) for e in edges]})
    assert len(raised.value.errors) == errors


def test_shapes_and_strictness(spark):
    for broken in ({"applications": 5}, {"relationships": {}}, {"applications": [{"id": "A"}]}, {"applications": [{"id": "X", "name": "x"}], "technologies": [{"id": "X", "name": "x"}]}):
        with pytest.raises(ModelError):
            from_document(spark, broken)
    assert from_document(spark, {}).elements.count() == 0
    pair = [{"from": "A01", "type": t, "to": "D01"} for t in ("OWNS", "CONSUMES")]
    lax = from_document(spark, {"applications": [{"id": "A01", "name": "a"}], "data_objects": [{"id": "D01", "name": "d"}], "relationships": pair}, strict=False)
    assert len(lax.warnings) == 1 and at(ops.only_source(lax, "OWNS"), "A01") == "D01"


def test_tools(g):
    known = registry.tools(g)
    assert len(known) == 15
    rows, error = registry.execute(known, "direct_dependents", {"id": "A05"})
    assert error is None and [r["id"] for r in rows] == ["A01", "A06", "A07"]
    for name, given in (("direct_dependents", {"id": "C01"}), ("direct_dependents", {"id": "A99"}), ("nothing", {}), ("direct_dependents", {"x": 1}), ("list_elements", {"kind": "x"})):
        rows, error = registry.execute(known, name, given)
        assert rows is None and error
    assert ids(ops.find(g, " NUMBER 4 ")) == "A04 C04 D04 T04" and ids(ops.find(g, "a04", "application")) == "A04" and ids(ops.find(g, "%")) == ""
    with pytest.raises(UnknownElement):
        g.require("A05", "capability")


def test_command_line(spark, tmp_path, capsys):
    import json

    path = tmp_path / "model.json"
    path.write_text(json.dumps(document()))
    run = lambda *a: (cli.main(["--model", str(path), *a], spark), capsys.readouterr().out)
    code, out = run("--list")
    assert code == 0 and "  T04 T number 4: isolated" in out and "  A05 A number 5 -OWNS-> D05 D number 5" in out and "application (7)" in out and "C05 C number 5: 1 relationship\n" in out
    code, out = run("--list", "--json")
    dump = json.loads(out)
    assert dump["elements"][5] == {"id": "A01", "kind": "application", "name": "A number 1", "lifecycle": "strategic"} and dump["relationships"][0] == {"from": "A01", "type": "SUPPORTS", "to": "C01"} and len(dump["relationships"]) == 33
    code, out = run("--impact", "A05")
    assert code == 0 and "A07 A number 7: direct and indirect\n    A07 -DEPENDS_ON-> A05\n    A07 -DEPENDS_ON-> A01 ; A01 -DEPENDS_ON-> A05" in out and "D01 D number 1: A05 consumes D01, which stays" in out
    rows = json.loads(run("--impact", "A05", "--json")[1])
    assert {r["section"] for r in rows} == set(ops.SECTIONS) and all("depth" not in r for r in rows if r["section"] == "orphaned data")
    code, out = run("--show", "A05")
    assert code == 0 and "lifecycle: strategic" in out and out.index("outgoing") < out.index("A05 A number 5 -RUNS_ON-> T02") < out.index("incoming") < out.index("A06 A number 6 -DEPENDS_ON-> A05")
    assert run("--impact", "A99")[0] == 1 and run()[0] == 2 and run("what now?")[0] == 2
    assert cli.main(["--model", str(tmp_path / "none.json"), "--list"], spark) == 1
    path.write_text("{ broken")
    assert run("--list")[0] == 1


# FIXTURES.md, section 1.3; retired: direct, indirect, transitive, orphaned, consumed, lost, degraded, unaffected, technologies.
IMPACT = {
    "A01": ("A07", "", "A07", "D04", "D01 D02", "", "C01 C03", "C02 C04 C05", ""),
    "A05": ("A01 A06 A07", "A07", "A01 A06 A07", "D05", "D01 D02 D03", "C04", "C01 C03 C05", "C02", "T03"),
    "A06": ("", "", "", "D06", "", "C05", "", "C01 C02 C03 C04", ""),
}


@pytest.mark.parametrize("root", IMPACT)
def test_impact_has_nine_sections(g, root):
    rows = ops.impact(g, root).collect()
    assert tuple(" ".join(sorted(r.id for r in rows if r.section == s)) for s in ops.SECTIONS) == IMPACT[root]
    assert all(r.name and r.explanation and r.kind for r in rows)


def test_lookups(g):
    ends = lambda rows: " ".join(f"{r.type}:{r.dst}" for r in rows.collect())
    assert g.has("A05") and not g.has("A99") and g.name("A05") == "A number 5"
    assert ids(g.ids_of_kind("technology")) == "T01 T02 T03 T04"
    assert ends(g.outgoing("A05")) == "SUPPORTS:C04 OWNS:D05 CONSUMES:D01 CONSUMES:D02 CONSUMES:D03 RUNS_ON:T03 RUNS_ON:T02"
    assert ends(g.outgoing("A05", "RUNS_ON")) == "RUNS_ON:T03 RUNS_ON:T02" and ids(g.targets("A05", "RUNS_ON")) == "T02 T03"
    assert [r.src for r in g.incoming("A05").collect()] == ["A01", "A06", "A07"] and ids(g.sources("T02", "RUNS_ON")) == "A05 A06"
    assert g.counts() == {"capability": 5, "application": 7, "data_object": 6, "technology": 4, "relationships": 33}
    for unknown in (lambda: g.name("X"), lambda: g.outgoing("X"), lambda: g.sources("X", "OWNS")):
        with pytest.raises(UnknownElement):
            unknown()


def test_findings_as_text_and_json(g):
    import json

    rows = ops.named(g, ops.only_source(g, "OWNS")).where("root = 'A05'")
    assert ops.rendered(rows).first().line == "D05 (D number 5): only A05 owns D05 [A05 -OWNS-> D05]"
    assert json.loads(ops.as_json(rows).first().json) == {"id": "D05", "name": "D number 5", "kind": "data_object", "explanation": "only A05 owns D05", "path": [{"from": "A05", "type": "OWNS", "to": "D05"}]}


def simple_paths(edges, root):
    """Every simple path to root, breadth first, in the order of edges."""
    queue, found = [[root]], []
    for path in queue:
        for a, b in edges:
            if b == path[-1] and a not in path:
                queue.append([*path, a])
                found.append([*path[1:], a])
    return found


def test_paths_are_the_first_of_all_simple_paths(spark):
    import random

    draw = random.Random(4)
    names = "ABCDEFG"
    edges = draw.sample([(a, b) for a in names for b in names if a != b], 16)
    made = from_document(spark, {"applications": [{"id": x, "name": x} for x in names], "relationships": [{"from": a, "type": "DEPENDS_ON", "to": b} for a, b in edges]})
    want = {}
    for root in names:
        for path in simple_paths(edges, root):
            want.setdefault((root, path[-1], False), path)
            if len(path) > 1:
                want.setdefault((root, path[-1], True), path)
    for most_edges in (1000, 0):
        assert {(r.root, r.id, r.longer): r.nodes for r in ops.reached(made, most_edges=most_edges).collect()} == want
    assert {(r.root, r.id, r.longer): r.nodes for r in ops.reached(made, "C", most_edges=0).collect()} == {k: v for k, v in want.items() if k[0] == "C"}


def test_dense_graphs_end(spark):
    names = [f"N{i:02}" for i in range(30)]
    dense = from_document(spark, {"applications": [{"id": x, "name": x} for x in names], "relationships": [{"from": a, "type": "DEPENDS_ON", "to": b} for a in names for b in names if a != b]})
    assert [(r.n_direct, r.n_indirect, r.n_transitive) for r in ops.impact_summary(dense).collect()] == [(29, 29, 29)] * 30


def test_ids_that_are_not_text(spark):
    numbers = from_document(spark, {"applications": [{"id": 1, "name": 2}, {"id": "b", "name": "b"}], "relationships": [{"from": 1, "type": "DEPENDS_ON", "to": "b"}]})
    assert at(ops.inbound(numbers, "DEPENDS_ON"), "b") == "1"
    with pytest.raises(ModelError) as raised:
        from_document(spark, {"applications": [{"id": None, "name": "x"}, {"id": "a", "name": ["x"]}], "relationships": [{"from": {}, "type": "OWNS", "to": 3}]})
    assert len(raised.value.errors) == 3


def test_all_paths_are_walked_in_the_tasks(spark):
    import itertools
    import random

    pick = random.Random(5)
    pairs = pick.sample([(a, b) for a, b in itertools.product("ABCDEFG", repeat=2) if a != b], 20)
    made = from_document(spark, {"applications": [{"id": x, "name": x} for x in "ABCDEFG"], "relationships": [{"from": a, "type": "DEPENDS_ON", "to": b} for a, b in pairs]})
    want = sorted((root, path[-1], len(path), ",".join(path)) for root in "ABCDEFG" for path in simple_paths(pairs, root))
    walked, joined = ops.dependency_paths(made), ops.dependency_paths(made, most_edges=0)
    for plan in (walked, ops.dependency_paths(made, text=True)):
        assert "UnionLoop" not in (text := plan._jdf.queryExecution().executedPlan().toString()) and "Exchange" not in text
    assert sorted(tuple(r) for r in ops.dependency_paths(made, text=True).collect()) == sorted(tuple(r) for r in ops.dependency_paths(made, most_edges=0, text=True).collect()) == want
    assert sorted(walked.collect()) == sorted(joined.collect())
    up = ops.upward(ops.steps(made), 1000)
    few = [row.tolist() for nodes, _ in ops.walks(up, np.arange(len(up.ids)), most_cells=4) for row in nodes]
    assert len(few) == len(want) and sorted(",".join(up.ids[i].as_py() for i in row[-2::-1]) for row in few) == sorted(w[3] for w in want)
    alone = from_document(spark, {"applications": [{"id": "A", "name": "A"}]})
    assert ops.dependency_paths(alone, text=True).count() == 0


def test_degraded_of_all_roots_shuffles_no_pairs(spark):
    import random

    draw = random.Random(6)
    apps, capabilities = [f"A{i}" for i in range(12)], [f"C{i}" for i in range(20)]
    pairs = draw.sample([(a, b) for a in apps for b in apps if a != b], 30)
    support = [(draw.choice([*apps, "A99"]), c) for c in capabilities for _ in range(draw.randint(0, 3))]  # some repeated, one of no application
    edges = [(a, "DEPENDS_ON", b, i) for i, (a, b) in enumerate(pairs)] + [(a, "SUPPORTS", c, 100 + i) for i, (a, c) in enumerate(support)]
    elements = from_document(spark, {"applications": [{"id": x, "name": x} for x in apps], "capabilities": [{"id": x, "name": x} for x in capabilities]}).elements
    made = Graph(elements, spark.createDataFrame(edges, "src string, type string, dst string, ord long"))
    found, joined = ops.degraded(made), ops.degraded(made, most_edges=0)
    rows = lambda df: sorted(tuple(r) for r in ops.shown(df).collect())
    assert rows(found) == rows(joined) and found.count() > 100 and {r.via for r in found.collect()} - set(apps) == set()
    assert rows(found.where("root = 'A3'")) == rows(ops.degraded(made, "A3"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("MapInArrow")] and "SortMergeJoin [root" not in plan


def test_cyclic_paths_are_kept_nowhere(spark):
    edges = [("B", "A"), ("A", "B"), ("C", "B"), ("A", "C"), ("D", "D"), ("D", "C")]
    made = Graph(None, spark.createDataFrame([(a, "DEPENDS_ON", b, i) for i, (a, b) in enumerate(edges)], "src string, type string, dst string, ord long"))
    found = ops.dependency_paths(made, text=True)
    assert "UnionLoop" not in found._jdf.queryExecution().executedPlan().toString()
    want = [(root, path[-1], len(path), ",".join(path)) for root in "ABCD" for path in simple_paths([e for e in edges if e[0] != e[1]], root)]
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)


def test_the_cyclic_query_shuffles_nothing(spark):
    sf_dir = "/root/testdata/sf0.001"
    found = plans.queries()["dependency_paths_cyclic"](spark, sf_dir)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "UnionLoop" not in plan and "Exchange" not in plan
    keys = [r.s_suppkey for r in spark.read.parquet(f"{sf_dir}/supplier.parquet").collect() if r.s_suppkey >= 1]
    edges = [("A0", "A1")] + [(f"A{k}", f"A{j}") for k in keys for j in {k // 2, k // 3}]
    want = [(root, path[-1], len(path), ",".join(path)) for root in {b for _, b in edges} for path in simple_paths(edges, root)]
    assert any("A0" in row[3].split(",") for row in want) and sorted(tuple(r) for r in found.collect()) == sorted(want)
