"""The distributed ways of blocks and betweenness against brute force, on many small graphs side by side."""

import random
from collections import defaultdict

from tacitra.operators import graph as G


def random_graphs(n, seed, weights):
    rnd = random.Random(seed)
    edges = []
    for g in range(n):
        size = rnd.randrange(2, 8)
        pairs = [(a, b) for a in range(size) for b in range(a + 1, size)]
        for a, b in rnd.sample(pairs, rnd.randrange(1, len(pairs) + 1)):
            edges.append((f"g{g:03}.{a}", f"g{g:03}.{b}", float(rnd.choice(weights))))
    return edges


def parts(vertices, near):
    left, n = set(vertices), 0
    while left:
        n += 1
        todo = [left.pop()]
        while todo:
            for w in near[todo.pop()]:
                if w in left:
                    left.remove(w)
                    todo.append(w)
    return n


def recount(edges):
    near = defaultdict(set)
    for a, b, _ in edges:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for v in near:
        here = [w for w in near if w.split(".")[0] == v.split(".")[0]]
        out[v] = parts([w for w in here if w != v], near) - parts(here, near)
    return out


def dependencies(edges):
    """Sum over sources of the share of shortest paths through each vertex, by enumeration of all simple shortest paths."""
    near = defaultdict(list)
    for a, b, w in edges:
        near[a].append((b, w))
        near[b].append((a, w))
    total = defaultdict(float)
    for s in near:
        paths = defaultdict(list)

        def walk(path, d, seen):
            paths[path[-1]].append((d, tuple(path)))
            for u, w in near[path[-1]]:
                if u not in seen:
                    walk([*path, u], d + w, seen | {u})

        walk([s], 0.0, {s})
        for t, known in paths.items():
            if t == s:
                continue
            best = min(d for d, _ in known)
            short = [p for d, p in known if d == best]
            for p in short:
                for v in p[1:-1]:
                    total[v] += 1 / len(short)
    return total


def test_blocks_of_two_hundred_graphs(spark):
    edges = random_graphs(200, 1, [1])
    expected = recount(edges)
    df = spark.createDataFrame(edges, "src string, dst string, weight double")
    for most in (0, 10**9):
        assert {r.person: r.component_delta for r in G.component_delta(df, max_edges=most).collect()} == expected


def test_blocks_below_a_hub(spark):
    edges = [("hub", f"v{i:03}", 1.0) for i in range(300)] + [(f"v{i:03}", f"v{i + 1:03}", 1.0) for i in range(0, 100, 2)]
    df = spark.createDataFrame(edges, "src string, dst string, weight double")
    got = {r.person: r.component_delta for r in G.component_delta(df, max_edges=0).collect()}
    assert got.pop("hub") == 249 and set(got.values()) == {0} and len(got) == 300


def test_betweenness_of_two_hundred_graphs(spark):
    edges = random_graphs(200, 2, [1, 2, 3])
    expected, n = dependencies(edges), len({p for e in edges for p in e[:2]})
    df = spark.createDataFrame(edges, "src string, dst string, weight double")
    for most in (0, 10**9):
        got = {r.person: r.betweenness * (n - 1) * (n - 2) for r in G.betweenness(df, pivots=n, max_edges=most).collect()}
        assert len(got) == n and all(abs(got[p] - expected[p]) < 1e-6 for p in got)


def test_tiers_of_a_hub(spark):
    edges = [("hub", f"v{i:02}", 6.0) for i in range(40)] + [("v00", "x", 3.0)]
    df = spark.createDataFrame(edges, "src string, dst string, weight double")
    one, two = (sorted(map(tuple, G.neighbour_tiers(df, salt_above=n).collect())) for n in (7, 10_000))
    assert one == two and len(one) == 2 * 40 + 40 * 39 + 1
