import random

import pytest

from strandloom.operators import forest
from strandloom.operators.components import connected_components


def kruskal(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    kept = []
    best = {}
    for u, v, s in edges:
        if u != v and s >= 0:
            key = (min(u, v), max(u, v))
            best[key] = max(best.get(key, s), s)
    for (u, v), s in sorted(best.items(), key=lambda e: (-e[1], e[0])):
        a, b = root(u), root(v)
        if a != b:
            parent[a] = b
            kept.append((u, v, s))
    return sorted(kept)


@pytest.fixture(params=["coalesced", "spread"])
def spark(spark, request):
    """With small partitions joined, and with each kept, so that contraction takes several rounds."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(request.param == "coalesced").lower())
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def run(spark, edges, parts=3):
    frame = spark.createDataFrame(edges, "query_seq long, target_seq long, score int").repartition(parts)
    return forest.maximum_spanning_forest(frame)


@pytest.mark.parametrize(
    ("edges", "want"),
    [
        ([(0, 1, 500), (1, 2, 400), (0, 3, 450), (3, 4, 350), (2, 3, 300), (1, 4, 250)], [(0, 1, 500), (0, 3, 450), (1, 2, 400), (3, 4, 350)]),
        ([(0, 1, 50), (1, 2, 50), (2, 3, 50), (2, 0, 100), (4, 5, 80), (3, 4, 10), (0, 5, 90)], None),
        ([(1, 1, 9), (1, 2, -1), (2, 3, 0), (3, 2, 7)], [(2, 3, 7)]),
    ],
)
def test_crafted_graphs(spark, edges, want):
    got = sorted(tuple(r) for r in run(spark, edges).collect())
    assert got == kruskal(edges)
    if want is not None:
        assert got == want
    if len(edges) == 7:
        assert sorted(s for _, _, s in got) == [10, 50, 50, 80, 90, 100][-len(got):] or len(got) == 5


def test_random_graphs_and_merging(spark):
    rng = random.Random(4)
    for ties in (5, 10_000):
        edges = [(rng.randrange(60), rng.randrange(60), rng.randrange(ties)) for _ in range(300)]
        whole = sorted(tuple(r) for r in run(spark, edges).collect())
        assert whole == kruskal(edges)
    first = [tuple(r) for r in run(spark, edges[:150]).collect()]
    assert sorted(tuple(r) for r in run(spark, first + edges[150:]).collect()) == whole


def test_tree(spark):
    edges = [(0, 1, 500), (1, 2, 400), (0, 3, 450), (3, 4, 350), (7, 9, 5)]
    found = spark.createDataFrame(edges, forest.EDGES)
    tree = forest.rooted(found).cache()
    rows = {r["node"]: r for r in tree.collect()}
    assert {n: r["parent"] for n, r in rows.items()} == {0: None, 1: 0, 2: 1, 3: 0, 4: 3, 7: None, 9: 7}
    assert {n: r["size"] for n, r in rows.items()} == {0: 5, 1: 2, 2: 1, 3: 2, 4: 1, 7: 2, 9: 1} and rows[9]["root"] == 7
    assert {r["line_key"][-1]: r["line_key"] for r in forest.report(tree).collect()}[4] == [0, 3, 4]
    assert [(r["parent"], r["node"]) for r in forest.children(tree).filter("parent = 0").orderBy("place").collect()] == [(0, 1), (0, 3)]
    assert {r["node"]: r["descendants"] for r in forest.descendants(tree).collect()} == {0: 4, 1: 1, 2: 0, 3: 1, 4: 0, 7: 1, 9: 0}
    assert forest.largest_root(tree).first()["node"] == 0
    lines = [r["line"] for r in forest.report(tree).orderBy("line_key").collect()]
    assert lines == ["0", "+- 1 [500]", "   +- 2 [400]", "+- 3 [450]", "   +- 4 [350]", "7", "+- 9 [5]"]
    nodes = spark.range(10).withColumnRenamed("id", "node")
    assert sorted(r["node"] for r in forest.isolated(nodes, found).collect()) == [5, 6, 8]


def hung(edges):
    """(parent, root, size) of each node, by walking from the least node of each tree."""
    near = {}
    for u, v, _ in edges:
        near.setdefault(u, []).append(v)
        near.setdefault(v, []).append(u)
    found = {}
    for root in sorted(near):
        if root in found:
            continue
        walk = [(root, None)]
        for node, parent in walk:
            found[node] = [parent, root, 1]
            walk += [(x, node) for x in near[node] if x != parent]
        for node, parent in reversed(walk[1:]):
            found[parent][2] += found[node][2]
    return {n: tuple(x) for n, x in found.items()}


@pytest.mark.parametrize("shape", ["path", "star", "trees"])
def test_hanging_trees(spark, monkeypatch, shape):
    """Deep, wide and random trees; rounds go with the logarithm of the nodes."""
    rng = random.Random(2)
    n = 20_000 if shape == "path" else 300
    edges = [(i, i + 1 if shape == "path" else 0 if shape == "star" else rng.choice([x for x in (i + 1, i + 2, i // 2, i // 3) if x != i]), i % 7) for i in range(1, n)]
    if shape == "trees":
        edges = kruskal(edges) + [(100_000 + i, 100_001 + i, 1) for i in range(0, 40, 2)]
    elif shape == "star":
        edges = [(v, u, s) for u, v, s in edges]
    rounds, keep = [], forest.Workspace.keep
    monkeypatch.setattr(forest.Workspace, "keep", lambda self, df: rounds.append(self) or keep(self, df))
    rows = forest.rooted(spark.createDataFrame(edges, forest.EDGES).repartition(3)).collect()
    assert {r["node"]: (r["parent"], r["root"], r["size"]) for r in rows} == hung(edges) and len(rounds) < 40


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(200)] + [(1000 + rng.randrange(50), 1000) for _ in range(100)] + [(5000, 5000), (None, 3), (7000, 6999)]
    rows = connected_components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()
    got = {r["node"]: r["component"] for r in rows}
    assert len(rows) == len(got)
    assert all(got[i] == 0 for i in range(201)) and got[7000] == got[6999] == 6999 and 5000 not in got
    assert {got[n] for n in got if 1000 <= n < 2000} == {1000}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_empty_forest(spark):
    assert run(spark, []).count() == 0
