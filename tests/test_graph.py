"""Graph operators against plain Python, on fixed and random graphs."""

import random

import pytest
from pyspark.sql import functions as F

from reviewlake import queries
from reviewlake.operators import graph, impact, resolve, store
from reviewlake.functions.schemas import DATA, EDGES, NODES
from reviewlake.sources import corpus, parsers

EDGE = "from_id bigint, to_id bigint, kind string, edge_idx int"


def frame(spark, pairs, kind="Calls"):
    return spark.createDataFrame([(a, b, kind, k) for k, (a, b) in enumerate(pairs)], EDGE)


def reach(pairs, start, depth=None, reverse=True):
    after = {}
    for a, b in pairs:
        after.setdefault(b if reverse else a, set()).add(a if reverse else b)
    seen, front, d = {start: 0}, {start}, 0
    while front and (depth is None or d < depth):
        d += 1
        front = {y for x in front for y in after.get(x, ())} - seen.keys()
        seen |= dict.fromkeys(front, d)
    return {k: v for k, v in seen.items() if k != start}


CASES = {"chain": [(0, 1), (1, 2)], "cycle": [(0, 1), (1, 2), (2, 0)], "self": [(0, 0), (0, 1)], "diamond": [(0, 1), (0, 2), (1, 3), (2, 3)], "parallel": [(0, 1), (0, 1), (1, 2)]}


@pytest.mark.parametrize("name", [*CASES, "random"])
def test_closure(spark, name):
    rnd = random.Random(5)
    pairs = CASES.get(name) or [(rnd.randrange(25), rnd.randrange(25)) for _ in range(40)]
    edges = frame(spark, pairs)
    for depth in (1, None):
        got = {r["id"]: r["depth"] for r in graph.transitive_dependents(edges, 2, depth).collect()}
        assert got == reach(pairs, 2, depth)
    assert {r["id"] for r in graph.transitive_dependencies(edges, 0).collect()} == set(reach(pairs, 0, reverse=False))


def test_paths(spark):
    edges = frame(spark, [(0, 1), (0, 1), (1, 2), (0, 2), (2, 0)])
    paths = lambda a, b, n: sorted(tuple(r[0]) for r in graph.simple_paths(edges, a, b, n).collect())
    assert paths(0, 2, 3) == [(0, 1, 2), (0, 1, 2), (0, 2)]
    assert paths(0, 2, 2) == [(0, 2)]
    assert paths(1, 1, 3) == [(1,)]


def test_cycles(spark):
    pairs = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6)]
    nodes = spark.createDataFrame([(k, "File") for k in range(1, 8)], "id bigint, kind string")
    cycles = sorted(tuple(r[0]) for r in graph.import_cycles(nodes, frame(spark, pairs, "Imports")).collect())
    assert cycles == [(1, 2, 3), (4, 5), (6,)]
    assert {r["id"]: r["scc"] for r in graph.mutual_reach(frame(spark, pairs)).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}


def components_of(pairs):
    """id -> smallest member of its strongly connected component, for those of two nodes or more."""
    ids = {x for p in pairs for x in p}
    after = {x: set(reach(pairs, x, reverse=False)) for x in ids}
    both = {x: {y for y in after[x] if x in after[y]} for x in ids}
    return {x: min(x, *both[x]) for x in ids if both[x]}


def test_mutual_reach(spark):
    rnd = random.Random(8)
    chain = [p for k in range(5) for p in ((3 * k, 3 * k + 1), (3 * k + 1, 3 * k + 2), (3 * k + 2, 3 * k), (3 * k, 3 * k + 3))]
    for pairs in (chain, [(rnd.randrange(40), rnd.randrange(40)) for _ in range(55)]):
        got = [tuple(r) for r in graph.mutual_reach(frame(spark, pairs)).select("id", "scc").collect()]
        assert sorted(got) == sorted(components_of(pairs).items())


def test_whole_part_graph(spark):
    """The queries on all parts, not on their 50 sizes."""
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in queries.part_edges(spark, folder).select("from_id", "to_id", "kind").collect()]
    pairs = [r[:2] for r in rows]
    assert len({a for a, _ in pairs}) == queries.table(spark, folder, "part").count() > 56
    assert {r["id"]: r["scc"] for r in queries.import_cycles_scc_parts(spark, folder).collect()} == components_of(pairs)
    after, paths, want = {}, [[1]], []
    for a, b in pairs:
        after.setdefault(a, []).append(b)
    while paths:
        path = paths.pop()
        if path[-1] == 12:
            want.append(">".join(map(str, path)))
        elif len(path) < 7:
            paths += [[*path, x] for x in after[path[-1]] if x not in path]
    assert want and sorted(r["path"] for r in queries.simple_paths_parts(spark, folder).collect()) == sorted(want)
    step = {a: b for a, b, kind in rows if kind == "References"}
    rings = set()
    for k in step:
        seen = []
        while k not in seen:
            seen.append(k)
            k = step[k]
        ring = seen[seen.index(k) :]
        least = ring.index(min(ring))
        rings.add(">".join(map(str, ring[least:] + ring[:least])))
    assert sorted(r["cycle"] for r in queries.import_cycles(spark, folder).collect()) == sorted(rings)


def test_components(spark):
    rnd = random.Random(2)
    pairs = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(35)]
    both = [*pairs, *((b, a) for a, b in pairs)]
    want = {x: min([x, *reach(both, x)]) for p in pairs if p[0] != p[1] for x in p}
    assert {r["id"]: r["component"] for r in graph.components(frame(spark, pairs)).collect()} == want


def few_tables(monkeypatch, most):
    """No more than so many tables are written from now on, each a round or less."""
    count = iter(range(most))
    own = graph.written

    def counted(df, label):
        assert next(count, None) is not None, "more rounds than a ring may need"
        return own(df, label)

    monkeypatch.setattr(graph, "written", counted)


def ring(n, start=0):
    ids = random.Random(n).sample(range(start, start + n), n)
    return list(zip(ids, ids[1:] + ids[:1], strict=True))


@pytest.mark.parametrize("most", [3, 25, 1_000_000])
def test_components_by_merging(spark, monkeypatch, most):
    """By one task and by rounds, on paths in the order of ids, rings, stars and chance."""
    monkeypatch.setattr(graph, "ONE_TASK", most)
    rnd = random.Random(3)
    path, star = [(k, k + 1) for k in range(100, 160)], [(200, k) for k in range(201, 240)]
    pairs = [*path, *star, *ring(40, 300), *((rnd.randrange(60), rnd.randrange(60)) for _ in range(35)), (400, 400)]
    both = [*pairs, *((b, a) for a, b in pairs)]
    want = {x: min([x, *reach(both, x)]) for p in pairs if p[0] != p[1] for x in p}
    got = [tuple(r) for r in graph.components(frame(spark, pairs)).collect()]
    assert sorted(got) == sorted(want.items())
    assert graph.components(frame(spark, [(1, 1)])).count() == 0


def test_components_of_a_long_path(spark, monkeypatch):
    monkeypatch.setattr(graph, "ONE_TASK", 100)
    few_tables(monkeypatch, 40)
    got = {r["id"]: r["component"] for r in graph.components(frame(spark, [(k, k + 1) for k in range(3000)])).collect()}
    assert got == dict.fromkeys(range(3001), 0)


@pytest.mark.parametrize("most", [0, 12, 60, 1_000_000])
def test_mutual_reach_by_tasks(spark, monkeypatch, most):
    """By one task, by several, and by turns for the weak components that are too large."""
    monkeypatch.setattr(graph, "ONE_TASK", most or 1)
    rnd = random.Random(9)
    pairs = [*((rnd.randrange(40), rnd.randrange(40)) for _ in range(55)), *ring(9, 100), *((k, k + 1) for k in range(108, 120)), *ring(5, 200), (300, 300)]
    got = [tuple(r) for r in graph.mutual_reach(frame(spark, pairs)).select("id", "scc").collect()]
    assert sorted(got) == sorted(components_of(pairs).items())


def test_cycles_of_a_long_ring(spark, monkeypatch):
    few_tables(monkeypatch, 20)
    pairs = [*ring(2000), (5000, 5001), (5001, 5000), (0, 5000)]
    nodes = spark.range(6000).withColumn("kind", F.lit("File"))
    found = sorted(list(r[0]) for r in graph.import_cycles(nodes, frame(spark, pairs, "Imports")).collect())
    after = dict(ring(2000))
    want = [0]
    while (x := after[want[-1]]) != 0:
        want.append(x)
    assert found == [want, [5000, 5001]]


def node(k, kind="Function", name="f", path="a/x.py", line=1, snapshot="new", types=(), **data):
    row = dict.fromkeys(parsers.FIELDS) | data
    return (snapshot, k, kind, name, path, line, line + 5, True, row, [], list(types))


def parameter(name, kind=None, default=None):
    return {"name": name, "param_type": kind, "default_value": default}


SIGNATURES = [
    ([parameter("a")], [parameter("a")], "Safe"), ([parameter("a")], [parameter("b")], "Breaking"), ([parameter("a")], [parameter("a", None, "1")], "PotentiallyBreaking"),
    ([], [parameter("a", None, "1")], "PotentiallyBreaking"), ([], [parameter("a")], "Breaking"), ([parameter("a")], [], "Breaking"),
    ([parameter("a"), parameter("b")], [parameter("a", None, "0"), parameter("c")], "PotentiallyBreaking"),
]


def test_classification(spark):
    old = [node(k, name=f"f{k}", line=1, parameters=a) for k, (a, _, _) in enumerate(SIGNATURES)]
    new = [node(100 + k, name=f"f{k}", line=2, parameters=b) for k, (_, b, _) in enumerate(SIGNATURES)]
    old += [node(50, "Class", "C", base_classes=["B"], methods=["m", "n"], fields=[]), node(51, "Type", "T"), node(52, "Variable", "V", is_constant=True), node(53, name="same"), node(54, name="gone")]
    new += [node(150, "Class", "C", base_classes=["B"], methods=["m"], fields=[]), node(151, "Type", "T", line=3), node(152, "Variable", "V", line=3, is_constant=True), node(153, name="same"), node(155, name="added")]
    o, n = spark.createDataFrame(old, NODES), spark.createDataFrame(new, NODES)
    got = {r.new_id: (r.old_id, r.classification) for r in impact.classify(impact.changed_nodes(o, n, True), o, n).collect()}
    assert got == {100 + k: (k, c) for k, (_, _, c) in enumerate(SIGNATURES)} | {150: (50, "Breaking"), 151: (51, "Breaking"), 152: (52, "Breaking"), 155: (None, "Safe")}


def test_store(spark, tmp_path):
    own = store.SnapshotStore(spark, str(tmp_path / "s"))
    assert own.nodes("v1").count() == 0
    nodes = spark.createDataFrame([node(1), node(2, name="g")], NODES)
    edges = spark.createDataFrame([("new", 1, 2, 0, "Calls", None), ("new", 1, 2, 1, "References", None)], EDGES)
    for snapshot in ("v1", "v2", "v1"):
        own.flush(nodes, edges, snapshot)
    assert sorted(tuple(r) for r in own.snapshots().collect()) == [("v1", 2, 2), ("v2", 2, 2)]
    assert [r["id"] for r in own.transitive_dependents(2, "v1").collect()] == [1]
    assert own.find_by_edge_kind(1, "References", "v1").count() == 1
    own.delete_snapshot("v2")
    assert [r[0] for r in own.snapshots().collect()] == ["v1"]
    assert own.find_changed_nodes("none", "v1").filter("old_id IS NULL").count() == 2


SOURCES = {
    "app/main.py": "from util.text import clean\nimport os\ndef main(a: int, b=2):\n    return clean(a)\ndef helper():\n    return main(1, 2)\n",
    "util/text.py": "def clean(x):\n    return x\ndef unused():\n    pass\n",
    "web/a.ts": "import { go } from './b';\nexport function start(x: number): void { go(x); }\n",
    "web/b.ts": "export function go(x: number) { return x; }\n",
    "bad.py": "def (:\n",
}


def test_parse_and_resolve(spark):
    files = spark.createDataFrame(list(SOURCES.items()), corpus.FILES)
    parsed = parsers.parse(parsers.numbered(files)).persist()
    nodes, edges, calls = parsers.graph_of(parsed)
    found = resolve.resolve(nodes, edges, calls).collect()
    names = {r.id: (r.file_path, r.name) for r in nodes.collect()}
    told = {(r.kind, names[r.from_id], names[r.to_id]) for r in found}
    assert ("Calls", ("app/main.py", "main"), ("util/text.py", "clean")) in told
    assert ("Imports", ("app/main.py", "main.py"), ("util/text.py", "text.py")) in told
    assert ("Calls", ("web/a.ts", "start"), ("web/b.ts", "go")) in told
    assert ("References", ("web/a.ts", "./b"), ("web/b.ts", "go")) in told
    assert [r.message[:24] for r in parsers.parse_findings(parsed).collect()] == ["Failed to parse bad.py: "]
    assert nodes.schema["data"].dataType.simpleString() == spark.createDataFrame([], f"d {DATA}").schema["d"].dataType.simpleString()


@pytest.mark.parametrize(
    ("path", "text", "names"),
    [
        ("a.rs", "use a::{B, C};\npub struct S { x: i32 }\nimpl S {\n  fn run(&self, a: i32) -> bool { go(a) }\n}\nfn go(a: i32) -> bool { true }\n", {"a", "S", "S.run", "go"}),
        ("a.go", "package m\nimport \"net/http\"\ntype S struct { A int }\nfunc (s *S) Run(a int) error { return go(a) }\n", {"net/http", "S", "S.Run"}),
        ("A.java", "import a.b.*;\npublic class A extends B {\n  public int run(int a) { return go(a); }\n}\n", {"a.b", "A", "A.run"}),
        ("a.rb", "require 'x/y'\nclass A < B\n  def run(a)\n    go(a)\n  end\nend\n", {"x/y", "A", "A.run"}),
        ("a.kt", "import a.b.C\nclass K {\n  fun run(a: Int): Int { return go(a) }\n}\n", {"a.b.C", "K", "K.run"}),
        ("a.swift", "import UIKit\nstruct S {\n  func run(a: Int) -> Int { return go(a) }\n}\n", {"UIKit", "S", "S.run"}),
        ("a.php", "<?php\nuse A\\B;\nclass K {\n  public function run($a) { go($a); }\n}\n", {"A\\B", "K", "K.run"}),
        ("a.cs", "using System;\npublic class K {\n  public int Run(int a) { return Go(a); }\n}\n", {"System", "K", "K.Run"}),
        ("a.c", "#include <stdio.h>\n#define N 3\nint add(int a, int b) {\n  return mul(a);\n}\n", {"stdio.h", "N", "add"}),
    ],
)
def test_scanners(path, text, names):
    g = parsers.parse_source(path, text, 3)
    assert {n["name"] for n in g.nodes if n["kind"] != "File"} == names
    assert all(n["id"] >> parsers.SHIFT == 3 for n in g.nodes)
