"""The communication graph as relations: edges (src, dst, weight) with src < dst, each pair once.

Components are computed by label passing. Blocks and betweenness have a way in memory for graphs of a checked size and a
distributed one beyond it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tacitra.operators.expertise import top_k
from tacitra.session import checkpointed, written


def directed_edges(mails: DataFrame, sender: Column, recipients: Column) -> DataFrame:
    """(src, dst, weight) counted from senders and lists of recipients; empty places and self-addressed mail left out."""
    rows = mails.select(F.lower(F.trim(sender)).alias("src"), F.explode(recipients).alias("dst")).withColumn("dst", F.lower(F.trim("dst")))
    return rows.where((F.length("dst") > 0) & (F.length("src") > 0) & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def fold_edges(directed: DataFrame) -> DataFrame:
    """Both directions of a pair summed; a missing weight counts 1; self-loops left out."""
    pair = directed.where(F.col("src") != F.col("dst")).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.coalesce(F.col("weight").cast("double"), F.lit(1.0)).alias("weight"))
    return pair.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def symmetric(edges: DataFrame) -> DataFrame:
    """(person, partner, weight) in both directions."""
    return edges.select(F.col("src").alias("person"), F.col("dst").alias("partner"), "weight").unionByName(edges.select(F.col("dst").alias("person"), F.col("src").alias("partner"), "weight"))


def degrees(edges: DataFrame) -> DataFrame:
    """Degree, weighted degree and degree centrality (degree over nodes minus one)."""
    per = symmetric(edges).groupBy("person").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("weighted_degree"))
    n = per.agg(F.count(F.lit(1)).alias("n"))
    return per.crossJoin(F.broadcast(n)).select("person", "degree", "weighted_degree", F.try_divide(F.col("degree"), F.col("n") - 1).alias("degree_centrality"))


def top_partners(edges: DataFrame, k: int) -> DataFrame:
    return top_k(symmetric(edges), ["person"], [F.desc("weight"), F.asc("partner")], k)


def neighbour_tiers(edges: DataFrame, near: float = 5, far: float = 3, salt_above: int = 10_000) -> DataFrame:
    """(person, neighbour, tier): tier 1 at weight ``near`` or more, tier 2 one step of weight ``far`` or more beyond.

    The partners of a person with more than ``salt_above`` of them are met by several tasks.
    """
    both = symmetric(edges)
    first = both.where(F.col("weight") >= near).select("person", F.col("partner").alias("neighbour"))
    step = both.where(F.col("weight") >= far).select(F.col("person").alias("neighbour"), F.col("partner").alias("second"))
    hubs = step.groupBy("neighbour").agg(F.ceil(F.count(F.lit(1)) / salt_above).cast("int").alias("salts")).where("salts > 1")
    n = F.coalesce("salts", F.lit(1))
    step = step.join(hubs, "neighbour", "left").select("neighbour", "second", F.pmod(F.xxhash64("second"), n).cast("int").alias("salt"))
    spread = first.join(hubs, "neighbour", "left").select("person", "neighbour", F.explode(F.sequence(F.lit(0), n - 1)).alias("salt"))
    second = spread.join(step, ["neighbour", "salt"]).select("person", F.col("second").alias("neighbour")).where("person != neighbour").distinct().join(first, ["person", "neighbour"], "left_anti")
    return first.withColumn("tier", F.lit(1)).unionByName(second.withColumn("tier", F.lit(2)))


def components(edges: DataFrame) -> DataFrame:
    """(person, component): the smallest person of each connected component.

    Labels pass to neighbours and then jump to the label of their label, so the rounds grow with the logarithm of the
    longest path. Each round is checkpointed in the shared folder; a round that moves nothing ends it.
    """
    both = checkpointed(symmetric(edges).select("person", "partner").distinct())
    labels = both.groupBy("person").agg(F.least(F.min("partner"), F.min("person")).alias("component"))
    while True:
        seen = both.join(labels.withColumnRenamed("person", "partner"), "partner").groupBy("person").agg(F.min("component").alias("other"))
        moved = labels.join(seen, "person", "left").select("person", F.least("component", F.coalesce("other", "component")).alias("next"), F.col("component").alias("was"))
        jump = labels.select(F.col("person").alias("next"), F.col("component").alias("far"))
        new = checkpointed(moved.join(jump, "next", "left").select("person", F.least("next", F.coalesce("far", "next")).alias("component"), "was"))
        labels = new.select("person", "component")
        if not new.where("component != was").limit(1).count():
            return labels


def _blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    """Biconnected blocks through each vertex of one component, by an iterative depth-first search."""
    near = defaultdict(list)
    for a, b in zip(pdf.src, pdf.dst):
        near[a].append(b)
        near[b].append(a)
    depth, low, blocks = {}, {}, defaultdict(int)
    for root in near:
        if root in depth:
            continue
        depth[root] = low[root] = 0
        stack = [(root, None, iter(near[root]))]
        while stack:
            v, parent, rest = stack[-1]
            for w in rest:
                if w == parent:
                    continue
                if w in depth:
                    low[v] = min(low[v], depth[w])
                else:
                    depth[w] = low[w] = depth[v] + 1
                    stack.append((w, v, iter(near[w])))
                    break
            else:
                stack.pop()
                if stack:
                    u = stack[-1][0]
                    low[u] = min(low[u], low[v])
                    if low[v] >= depth[u]:  # a block hangs below u through v
                        blocks[u] += 1
        blocks[root] -= 1  # the root has no block above it
    return pd.DataFrame({"person": list(near), "component_delta": [int(blocks[p]) for p in near]})


def _until_still(state: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``step`` applied until no row of its result has ``moved``; each round is written to the shared folder."""
    now = written(state)
    while True:
        now = written(step(now))
        if not now.where("moved").limit(1).count():
            return now.drop("moved")


def component_delta(edges: DataFrame, max_edges: int = 2_000_000) -> DataFrame:
    """How many more components there are once a person is gone: the blocks through it minus one.

    A component of up to ``max_edges`` edges is searched depth first by one task; larger ones stay distributed
    (``_block_counts``). Both give the same counts.
    """
    labelled = checkpointed(edges.join(components(edges).withColumnRenamed("person", "src"), "src"))
    large = labelled.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_edges).select("component")
    out = labelled.join(large, "component", "left_anti").groupBy("component").applyInPandas(_blocks, "person string, component_delta int")
    if not large.limit(1).count():
        return out
    return out.unionByName(_block_counts(labelled.join(large, "component", "left_semi")))


def _block_counts(edges: DataFrame) -> DataFrame:
    """(person, component_delta) of edges (src, dst, component) by relations alone, after Tarjan and Vishkin.

    A breadth-first tree hangs below the smallest person of each component. Sizes of subtrees and numbers in preorder
    tell ancestors; the lowest and highest number that a subtree reaches by an edge outside the tree tell which tree
    edges lie in one block: those edges are nodes of a second graph whose components are the blocks. Rounds grow with
    the depth of the tree.
    """
    both = written(symmetric(edges.withColumn("weight", F.lit(1.0))).select(F.col("person").alias("v"), F.col("partner").alias("u")))
    roots = edges.select(F.col("component").alias("v"), F.lit(None).cast("string").alias("parent"), F.lit(True).alias("moved")).distinct()

    def grow(tree: DataFrame) -> DataFrame:
        reached = tree.where("moved").join(both, "v").groupBy(F.col("u").alias("v")).agg(F.min("v").alias("parent")).join(tree.select("v"), "v", "left_anti")
        return tree.select("v", "parent", F.lit(False).alias("moved")).unionByName(reached.withColumn("moved", F.lit(True)))

    tree = _until_still(roots, grow)

    def below(state: DataFrame, agg) -> DataFrame:
        """An aggregate over the children of each vertex."""
        return tree.join(state, "v").where("parent IS NOT NULL").groupBy(F.col("parent").alias("v")).agg(agg)

    def sized(state: DataFrame) -> DataFrame:
        new = state.join(below(state, F.sum("n").alias("s")), "v", "left").withColumn("t", 1 + F.coalesce("s", F.lit(0)))
        return new.select("v", F.col("t").alias("n"), (F.col("t") != F.col("n")).alias("moved"))

    sizes = _until_still(tree.select("v", F.lit(1).cast("bigint").alias("n")), sized)
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("parent").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offset = written(tree.join(sizes, "v").select("v", "parent", "n", F.when(F.col("parent").isNull(), 0).otherwise(1 + earlier).cast("bigint").alias("step")))

    def numbered(state: DataFrame) -> DataFrame:
        above = state.select(F.col("v").alias("parent"), F.col("pre").alias("base"))
        new = offset.join(above, "parent", "left").select("v", F.when(F.col("parent").isNull(), F.lit(0)).otherwise(F.col("base") + F.col("step")).cast("bigint").alias("p"))
        return new.join(state, "v").select("v", F.col("p").alias("pre"), (~F.col("p").eqNullSafe(F.col("pre"))).alias("moved"))

    start = offset.select("v", F.when(F.col("parent").isNull(), F.lit(0)).cast("bigint").alias("pre"))
    nodes = written(offset.join(_until_still(start, numbered), "v").select("v", "parent", "n", "pre"))
    place = nodes.select(F.col("v").alias("u"), F.col("pre").alias("upre"), F.col("parent").alias("uparent"))
    cross = written(both.join(nodes, "v").join(place, "u").where("NOT (u <=> parent) AND NOT (v <=> uparent)").select("v", "u", "pre", "upre"))
    reach = cross.groupBy("v").agg(F.min("upre").alias("lo"), F.max("upre").alias("hi"))
    own = written(nodes.join(reach, "v", "left").select("v", F.least("pre", "lo").alias("low"), F.greatest("pre", "hi").alias("high")))

    def reaching(state: DataFrame) -> DataFrame:
        down = tree.join(state, "v").where("parent IS NOT NULL").groupBy(F.col("parent").alias("v")).agg(F.min("low").alias("l"), F.max("high").alias("h"))
        new = state.join(down, "v", "left").select("v", "low", "high", F.least("low", "l").alias("l2"), F.greatest("high", "h").alias("h2"))
        return new.select("v", F.col("l2").alias("low"), F.col("h2").alias("high"), ((F.col("l2") != F.col("low")) | (F.col("h2") != F.col("high"))).alias("moved"))

    span = _until_still(own, reaching)
    above = nodes.select(F.col("v").alias("parent"), F.col("n").alias("pn"), F.col("pre").alias("ppre"), F.col("parent").alias("grand"))
    leaving = nodes.join(span, "v").join(above, "parent").where("grand IS NOT NULL AND (low < ppre OR high >= ppre + pn)")
    one = F.lit(1.0).alias("weight")
    links = cross.where("pre < upre").select(F.col("v").alias("src"), F.col("u").alias("dst"), one).unionByName(leaving.select(F.col("v").alias("src"), F.col("parent").alias("dst"), one))
    links = written(links)
    edge = nodes.where("parent IS NOT NULL").select("v", "parent").join(components(links).toDF("v", "label"), "v", "left").select("v", "parent", F.coalesce("label", "v").alias("label"))
    through = edge.select(F.col("v").alias("person"), "label").unionByName(edge.select(F.col("parent").alias("person"), "label")).distinct()
    return through.groupBy("person").agg((F.count(F.lit(1)) - 1).cast("int").alias("component_delta"))


def betweenness(edges: DataFrame, pivots: int = 500, max_edges: int = 5_000_000) -> DataFrame:
    """(person, betweenness) by Brandes' accumulation from ``pivots`` sources, edge weights taken as distances.

    Sources are the persons with the smallest hashes. Every source needs the whole graph: up to ``max_edges`` edges it is
    broadcast and each source is one search in memory; beyond, all searches go on together as relations
    (``_dependencies``). Both give the same values but for the order of sums. Edges of weight 0 or less are on no path.
    """
    import heapq

    spark = edges.sparkSession
    persons = symmetric(edges).select("person").distinct()
    edges = edges.where("weight > 0")
    if edges.count() > max_edges:
        persons = checkpointed(persons)
        n = persons.count()
        k = min(pivots, n)
        sources = persons.orderBy(F.xxhash64("person"), "person").limit(k)
        scale = n / k / ((n - 1) * (n - 2)) if n > 2 else 0.0
        parts = _dependencies(edges, sources).groupBy(F.col("v").alias("person")).agg(F.sum("x").alias("part"))
        return persons.join(parts, "person", "left").select("person", (F.coalesce("part", F.lit(0.0)) * scale).alias("betweenness"))
    ids = persons.orderBy("person").toPandas().person.tolist()  # persons without a positive edge come on top of twice max_edges
    number = {p: i for i, p in enumerate(ids)}
    table = edges.select("src", "dst", "weight").toPandas()
    a = np.concatenate([table.src.map(number).to_numpy(), table.dst.map(number).to_numpy()])
    b = np.concatenate([table.dst.map(number).to_numpy(), table.src.map(number).to_numpy()])
    w = np.concatenate([table.weight.to_numpy(float)] * 2)
    order = np.argsort(a, kind="stable")
    graph = spark.sparkContext.broadcast((np.searchsorted(a[order], np.arange(len(ids) + 1)), b[order], w[order]))
    n = len(ids)
    k = min(pivots, n)
    sources = spark.createDataFrame([(i, p) for i, p in enumerate(ids)], "id int, person string").orderBy(F.xxhash64("person"), "person").limit(k)

    def run(batches):
        at, to, dist = graph.value
        for pdf in batches:
            total = np.zeros(n)
            for s in pdf.id:
                sigma, delta = np.zeros(n), np.zeros(n)
                length = np.full(n, np.inf)
                before: list[list[int]] = [[] for _ in range(n)]
                sigma[s], length[s] = 1.0, 0.0
                done, heap, seen = [], [(0.0, s)], np.zeros(n, bool)
                while heap:
                    d, v = heapq.heappop(heap)
                    if seen[v]:
                        continue
                    seen[v] = True
                    done.append(v)
                    for e in range(at[v], at[v + 1]):
                        u, far = to[e], d + dist[e]
                        if far < length[u]:
                            length[u], sigma[u], before[u] = far, sigma[v], [v]
                            heapq.heappush(heap, (far, u))
                        elif far == length[u] and not seen[u]:
                            sigma[u] += sigma[v]
                            before[u].append(v)
                for u in reversed(done):
                    for v in before[u]:
                        delta[v] += sigma[v] / sigma[u] * (1 + delta[u])
                    if u != s:
                        total[u] += delta[u]
            hit = np.flatnonzero(total)
            yield pd.DataFrame({"id": hit.astype("int32"), "part": total[hit]})

    scale = n / k / ((n - 1) * (n - 2)) if n > 2 else 0.0
    parts = sources.select("id").repartition(min(k, 64)).mapInPandas(run, "id int, part double").groupBy("id").agg(F.sum("part").alias("part"))
    names = spark.createDataFrame([(i, p) for i, p in enumerate(ids)], "id int, person string")
    return names.join(parts, "id", "left").select("person", (F.coalesce("part", F.lit(0.0)) * scale).alias("betweenness"))


def _dependencies(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(s, v, x): what the shortest paths from each source s depend on v, all sources together.

    Distances, numbers of paths and dependencies are three fixpoints over the edges; each takes as many rounds as the
    longest shortest path has edges.
    """
    both = checkpointed(symmetric(edges).select(F.col("person").alias("v"), F.col("partner").alias("u"), F.col("weight").alias("w")))
    start = sources.select(F.col("person").alias("s"), F.col("person").alias("v"), F.lit(0.0).alias("d"), F.lit(True).alias("moved"))

    def relax(state: DataFrame) -> DataFrame:
        tried = state.where("moved").join(both, "v").groupBy("s", F.col("u").alias("v")).agg(F.min(F.col("d") + F.col("w")).alias("c"))
        new = state.join(tried, ["s", "v"], "full")
        return new.select("s", "v", F.least("d", "c").alias("d"), (F.col("c").isNotNull() & (F.col("d").isNull() | (F.col("c") < F.col("d")))).alias("moved"))

    far = _until_still(start, relax)
    dag = checkpointed(far.join(both, "v").join(far.select("s", F.col("v").alias("u"), F.col("d").alias("du")), ["s", "u"]).where("d + w = du").select("s", "v", "u"))

    def count(state: DataFrame) -> DataFrame:
        into = dag.join(state.select("s", "v", "x"), ["s", "v"]).groupBy("s", F.col("u").alias("v")).agg(F.sum("x").alias("y"))
        new = state.join(into, ["s", "v"], "left").select("s", "v", "x", F.when(F.col("v") == F.col("s"), 1.0).otherwise(F.coalesce("y", F.lit(0.0))).alias("z"))
        return new.select("s", "v", F.col("z").alias("x"), (F.col("x") != F.col("z")).alias("moved"))

    paths = _until_still(far.select("s", "v", F.when(F.col("v") == F.col("s"), 1.0).otherwise(0.0).alias("x")), count)
    shares = dag.join(paths.select("s", "v", F.col("x").alias("pv")), ["s", "v"]).join(paths.select("s", F.col("v").alias("u"), F.col("x").alias("pu")), ["s", "u"])
    shares = checkpointed(shares.select("s", "v", "u", (F.col("pv") / F.col("pu")).alias("r")))

    def depend(state: DataFrame) -> DataFrame:
        back = shares.join(state.select("s", F.col("v").alias("u"), "x"), ["s", "u"]).groupBy("s", "v").agg(F.sum(F.col("r") * (1 + F.col("x"))).alias("y"))
        new = state.join(back, ["s", "v"], "left").select("s", "v", "x", F.coalesce("y", F.lit(0.0)).alias("z"))
        # sums of doubles depend on their order: what moves by rounding alone stands still
        return new.select("s", "v", F.col("z").alias("x"), (F.abs(F.col("x") - F.col("z")) > 1e-9 * (1 + F.abs("z"))).alias("moved"))

    return _until_still(far.select("s", "v", F.lit(0.0).alias("x")), depend).where("v != s")


def subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with both ends among ``nodes`` (person)."""
    kept = nodes.select("person").distinct()
    return edges.join(kept.withColumnRenamed("person", "src"), "src", "left_semi").join(kept.withColumnRenamed("person", "dst"), "dst", "left_semi")


def shown_nodes(edges: DataFrame, risk: DataFrame, least_degree: int = 3, k: int = 20) -> DataFrame:
    """Persons of degree ``least_degree`` or more within the graph, or among the ``k`` of highest risk."""
    inside = degrees(edges).where(F.col("degree") >= least_degree).select("person")
    top = risk.orderBy(F.desc("risk_score"), F.asc("person")).limit(k).select("person")
    return inside.union(top).distinct()
