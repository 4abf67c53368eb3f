import itertools
import random
from collections import defaultdict

import pytest

from tacitra.operators import graph as G


def frame(spark, edges):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in edges], "src string, dst string, weight double")


def n_components(nodes, edges):
    near = defaultdict(set)
    for a, b, _ in edges:
        near[a].add(b)
        near[b].add(a)
    seen, n = set(), 0
    for v in nodes:
        if v not in seen:
            n += 1
            stack = [v]
            while stack:
                u = stack.pop()
                if u not in seen:
                    seen.add(u)
                    stack += [w for w in near[u] if w in nodes]
    return n


def some_graph(seed, n=14, p=0.16):
    rnd = random.Random(seed)
    names = [f"n{i:02}" for i in range(n)]
    return [(a, b, rnd.randrange(1, 6)) for a, b in itertools.combinations(names, 2) if rnd.random() < p]


@pytest.mark.parametrize("seed", range(4))
def test_component_delta_is_remove_and_recount(spark, seed):
    edges = some_graph(seed)
    nodes = {v for a, b, _ in edges for v in (a, b)}
    whole = n_components(nodes, edges)
    expected = {v: n_components(nodes - {v}, [e for e in edges if v not in e[:2]]) - whole for v in nodes}
    got = {r.person: r.component_delta for r in G.component_delta(frame(spark, edges)).collect()}
    assert got == expected
    labels = {r.person: r.component for r in G.components(frame(spark, edges)).collect()}
    assert len(set(labels.values())) == whole and all(labels[a] == labels[b] for a, b, _ in edges)


def test_long_path_is_one_component(spark):
    edges = [(f"v{i:04}", f"v{i + 1:04}", 1) for i in range(300)]
    assert {r.component for r in G.components(frame(spark, edges)).collect()} == {"v0000"}


def test_betweenness_against_all_shortest_paths(spark):
    edges = some_graph(7, n=9, p=0.4)
    nodes = sorted({v for a, b, _ in edges for v in (a, b)})
    dist = {(a, b): w for a, b, w in edges} | {(b, a): w for a, b, w in edges}

    def paths(s, t):
        best, found = float("inf"), []
        stack = [(0, [s])]
        while stack:
            d, path = stack.pop()
            if d > best:
                continue
            if path[-1] == t:
                if d < best:
                    best, found = d, []
                found.append(path)
                continue
            stack += [(d + dist[path[-1], v], [*path, v]) for v in nodes if (path[-1], v) in dist and v not in path]
        return [p for p in found if sum(dist[x] for x in zip(p, p[1:])) == best]

    expected = dict.fromkeys(nodes, 0.0)
    for s, t in itertools.permutations(nodes, 2):
        ps = paths(s, t)
        for p in ps:
            for v in p[1:-1]:
                expected[v] += 1 / len(ps)
    n = len(nodes)
    got = {r.person: r.betweenness for r in G.betweenness(frame(spark, edges)).collect()}
    for v in nodes:
        assert got[v] == pytest.approx(expected[v] / ((n - 1) * (n - 2)))
    beyond = {r.person: r.betweenness for r in G.betweenness(frame(spark, edges), max_edges=1).collect()}
    assert beyond == pytest.approx(got)  # larger graphs are no longer refused


def test_edges_and_tiers(spark):
    raw = spark.createDataFrame([("b", "a", 2.0), ("a", "b", 3.0), ("a", "a", 9.0), ("b", "c", None), ("c", "d", 3.0), ("b", "d", 3.0)], "src string, dst string, weight double")
    e = {(r.src, r.dst): r.weight for r in G.fold_edges(raw).collect()}
    assert e == {("a", "b"): 5.0, ("b", "c"): 1.0, ("c", "d"): 3.0, ("b", "d"): 3.0}
    tiers = {(r.person, r.neighbour): r.tier for r in G.neighbour_tiers(G.fold_edges(raw)).collect()}
    assert tiers == {("a", "b"): 1, ("b", "a"): 1, ("a", "d"): 2}
    d = {r.person: (r.degree, r.weighted_degree, r.degree_centrality) for r in G.degrees(G.fold_edges(raw)).collect()}
    assert d["b"] == (3, 9.0, 1.0)
    mails = spark.createDataFrame([(" A@x ", ["b@x", "", "a@x", "B@X"]), (None, ["c@x"]), ("c@x", None)], "f string, t array<string>")
    from pyspark.sql import functions as F

    assert [tuple(r) for r in G.directed_edges(mails, F.col("f"), F.col("t")).collect()] == [("a@x", "b@x", 2)]
    empty = frame(spark, [])
    assert G.degrees(empty).count() == 0 and G.components(empty).count() == 0
