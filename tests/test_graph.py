import itertools
import random

from pyspark.sql import functions as F

from citeloom.operators import graph as G


def edges(spark, pairs, w=2):
    return spark.createDataFrame([(min(p), max(p), w, 1.0) for p in pairs], "a long, b long, w long, wn double")


def test_pairs_and_newman(spark):
    m = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (1, 12), (2, 10), (2, 11)], "item int, member int")
    got = {(r["a"], r["b"]): (r["w"], r["wn"]) for r in G.pair_weights(m).collect()}
    assert got == {(10, 11): (2, 1.5), (10, 12): (1, 0.5), (11, 12): (1, 0.5)}


def test_components_on_random_graphs(spark):
    random.seed(3)
    pairs = {tuple(sorted(random.sample(range(120), 2))) for _ in range(90)} | {(i, i + 1) for i in range(200, 260)}
    parent = {n: n for p in pairs for n in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r["node"]: r["component"] for r in G.connected_components(edges(spark, pairs)).collect()}
    assert got == {n: find(n) for n in parent}


def test_rank_sums_to_one(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 1), (3, 4)])
    assert abs(G.pagerank(e, iterations=12).agg(F.sum("rank")).first()[0] - 1) < 1e-9


def test_distances(spark):
    d = {(r["x"], r["y"]): r["d"] for r in G.distances(edges(spark, [(1, 2), (2, 3), (3, 4), (4, 5)]), limit=3).collect()}
    assert d[(1, 4)] == 3 and (1, 5) not in d and d[(5, 3)] == 2
    for x, y, z in itertools.product(range(1, 6), repeat=3):
        if (x, y) in d and (y, z) in d and (x, z) in d:
            assert d[(x, z)] <= d[(x, y)] + d[(y, z)]


def test_communities_beat_one_label(spark):
    clique = lambda ns: list(itertools.combinations(ns, 2))
    e = edges(spark, clique(range(5)) + clique(range(10, 15)) + [(0, 10)])
    found = {r["node"]: r["label"] for r in G.communities(e).collect()}
    assert len({found[i] for i in range(5)}) == 1 and found[0] != found[10]
    q = G.modularity(e, G.communities(e)).first()[0]
    one = G.modularity(e, e.select(F.col("a").alias("node")).union(e.select("b")).distinct().withColumn("label", F.lit(0))).first()[0]
    assert q > 0.4 > one


def test_betweenness_of_a_path(spark):
    got = {r["node"]: round(r["betweenness"], 6) for r in G.betweenness(edges(spark, [(1, 2), (2, 3), (3, 4), (4, 5)]), 5).collect()}
    assert got == {1: 0.0, 2: 0.5, 3: round(8 / 12, 6), 4: 0.5, 5: 0.0}


def test_islands_and_collapse(spark):
    e = edges(spark, [(1, 2), (2, 3), (10, 11), (11, 12), (20, 21)])
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "node long, label long")
    got = {r["node"]: r["label"] for r in G.islands(e, labels, least=3).collect()}
    assert got[1] == 0 and got[10] == got[12] == 11 and got[20] == -1


def test_path_lengths_go_to_the_end(spark, tmp_path):
    from citeloom.plans.catalog import QUERIES

    edges = [(i, i + 1) for i in range(1, 7)] + [(1, 20), (1, 21)]  # only 1 has three neighbours
    rows = [(2 * k + twice, p) for k, e in enumerate(edges) for twice in range(2) for p in e]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r["d"]: r["n"] for r in QUERIES["path_lengths_all"](spark, str(tmp_path)).collect()}
    assert got == {1: 3, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1}


def all_pairs(nodes, length):
    """Distances and numbers of shortest paths, by relaxing until nothing changes; edges have positive lengths."""
    inf = float("inf")
    d = {(s, t): 0.0 if s == t else inf for s in nodes for t in nodes}
    for _ in nodes:
        for (a, b), w in length.items():
            for s in nodes:
                for u, v in ((a, b), (b, a)):
                    d[s, v] = min(d[s, v], d[s, u] + w)
    count = {}
    for s in nodes:
        for t in sorted(nodes, key=lambda t: d[s, t]):
            if d[s, t] < inf:
                before = [(a if b == t else b) for (a, b), w in length.items() if t in (a, b) and abs(d[s, (a if b == t else b)] + w - d[s, t]) < 1e-9]
                count[s, t] = 1 if s == t else sum(count[s, u] for u in before)
    return d, count


def test_betweenness_of_nodes_and_edges_against_all_pairs(spark):
    random.seed(8)
    pairs = sorted({tuple(sorted(random.sample(range(12), 2))) for _ in range(24)})
    e = spark.createDataFrame([(a, b, 1 + (a * b) % 3, 1.0) for a, b in pairs], "a long, b long, w long, wn double")
    nodes = sorted({x for p in pairs for x in p})
    n = len(nodes)
    for weight in (None, "w"):
        length = {(a, b): 1.0 if weight is None else 1 / (1 + (a * b) % 3) for a, b in pairs}
        d, count = all_pairs(nodes, length)
        node = {v: sum(count[s, v] * count[v, t] / count[s, t] for s in nodes for t in nodes if len({s, t, v}) == 3 and (s, t) in count and abs(d[s, v] + d[v, t] - d[s, t]) < 1e-9) / ((n - 1) * (n - 2)) for v in nodes}
        got = {r["node"]: r["betweenness"] for r in G.betweenness(e, n, weight=weight).collect()}
        assert all(abs(got[v] - node[v]) < 1e-9 for v in nodes)
        edge = {(a, b): sum(count[s, u] * count[v, t] / count[s, t] for s in nodes for t in nodes for u, v in ((a, b), (b, a)) if s != t and (s, t) in count and abs(d[s, u] + w + d[v, t] - d[s, t]) < 1e-9) / (n * (n - 1)) for (a, b), w in length.items()}
        found = {(r["a"], r["b"]): r["betweenness"] for r in G.betweenness(e, n, weight=weight, of="edge").collect()}
        assert set(found) == set(edge) and all(abs(found[k] - edge[k]) < 1e-9 for k in edge)


def test_communities_hold_together(spark):
    random.seed(5)
    pairs = {tuple(sorted(random.sample(range(60), 2))) for _ in range(90)}
    found = {r["node"]: r["label"] for r in G.communities(edges(spark, pairs)).collect()}
    for label in set(found.values()):
        inside = {n for n, x in found.items() if x == label}
        start = next(iter(inside))
        reach, todo = {start}, [start]
        while todo:
            v = todo.pop()
            for a, b in pairs:
                for u, w in ((a, b), (b, a)):
                    if u == v and w in inside and w not in reach:
                        reach.add(w)
                        todo.append(w)
        assert reach == inside


def test_rank_until_it_settles(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 1), (3, 4)])
    far = {r["node"]: r["rank"] for r in G.pagerank(e, iterations=200).collect()}
    got = {r["node"]: r["rank"] for r in G.pagerank(e, iterations=200, tolerance=1e-9).collect()}
    assert all(abs(far[k] - got[k]) < 1e-6 for k in far)


def test_paths_of_the_largest_component(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 4), (10, 11), (11, 12)])
    got = G.path_distribution(e, 10).collect()
    assert {r["d"]: r["n"] for r in got} == {1: 6, 2: 4, 3: 2} and abs(got[0]["mean"] - (6 + 8 + 6) / 12) < 1e-9


def test_alignment_is_greedy(spark):
    from citeloom.operators.profiles import greedy_alignment

    rows = [("r1", "c1", 9), ("r1", "c2", 8), ("r2", "c1", 7), ("r2", "c2", 1), ("r3", "c3", 1)]
    assert greedy_alignment(spark.createDataFrame(rows, "r string, c string, n int"), "r", "c", "n") == [("r1", "c1"), ("r2", "c2"), ("r3", "c3")]
