"""Co-occurrence graphs as edge tables (a < b, w) and iterative algorithms over them. Rounds are written to the shared folder."""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import bucketed, materialize, shuffle_parts


def pair_weights(members: DataFrame, item: str = "item", member: str = "member", year: str | None = None) -> DataFrame:
    """a, b, w (shared items), wn (each item counts 1 / (team - 1)) and, with year, the sorted years of the shared items. members may repeat.

    Items and pairs are put in as many tasks as the input is large, so that a task holds no more of them when it grows.
    """
    n = shuffle_parts(members)
    rows = members.where(F.col(item).isNotNull()).repartition(n, item)
    team = rows.groupBy(item).agg(F.sort_array(F.collect_set(F.struct(F.col(member).alias("m"), *([F.col(year).alias("y")] if year else [])))).alias("_t"))
    one = team.where(F.size("_t") > 1).select("_t", F.posexplode("_t").alias("_i", "_a"))
    after = F.slice("_t", F.col("_i") + 2, F.size("_t") - F.col("_i") - 1)  # sorted by member, so each pair is met once
    two = one.where(F.col("_i") < F.size("_t") - 1).select(F.col("_a.m").alias("a"), *([F.col("_a.y").alias("_y")] if year else []), F.size("_t").alias("_n"), F.explode(F.transform(after, lambda e: e["m"])).alias("b"))
    out = two.where("a < b").repartition(4 * n, "a", "b").groupBy("a", "b")
    more = [F.array_sort(F.collect_list("_y")).alias("years")] if year else []
    return out.agg(F.count("*").alias("w"), F.sum(F.lit(1.0) / (F.col("_n") - 1)).alias("wn"), *more)


def both_ways(edges: DataFrame, *values: str) -> DataFrame:
    """x, y and values of each edge in both directions."""
    return edges.select(F.col("a").alias("x"), F.col("b").alias("y"), *values).unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y"), *values))


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree, strength and Newman strength."""
    return both_ways(edges, "w", "wn").groupBy(F.col("x").alias("node")).agg(F.count("*").alias("degree"), F.sum("w").alias("strength"), F.sum("wn").alias("newman"))


def adjacency(edges: DataFrame, k: int = 200) -> DataFrame:
    """node and its k neighbours of largest weight (ties: smaller) as (y, w) in that order."""
    rank = F.row_number().over(Window.partitionBy("x").orderBy(F.desc("w"), "y"))
    top = both_ways(edges, "w").withColumn("r", rank).where(F.col("r") <= k)
    return top.groupBy(F.col("x").alias("node")).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "y", "w"))), lambda e: F.struct(e["y"], e["w"])).alias("near"))


def connected_components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node), by least labels and pointer jumping. The links lie in buckets of the far end, so a round moves labels only; what a node gets from its many links is summed in each task before it moves."""
    both = bucketed(both_ways(edges).distinct(), "edges", "y")
    label = materialize(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("c")).withColumnRenamed("x", "node"), "labels")
    while True:
        near = both.join(label.select(F.col("node").alias("y"), F.col("c")), "y").groupBy("x").agg(F.min("c").alias("near"))
        low = label.join(near, label["node"] == near["x"]).select("node", F.col("c").alias("was"), F.least("c", "near").alias("low"))
        up = label.select(F.col("node").alias("low"), F.col("c").alias("above"))
        step = materialize(low.join(up, "low", "left").select("node", "was", F.least("low", F.coalesce("above", "low")).alias("c")), "labels")
        label = step.select("node", "c")
        if step.where("c <> was").isEmpty():
            return label.withColumnRenamed("c", "component")


def giant_fraction(edges: DataFrame, first_year: Column, cutoffs: Sequence[int]) -> DataFrame:
    """For each cutoff the share of linked nodes in the largest component of the edges that exist by then."""
    dated = materialize(edges.select("a", "b", first_year.alias("y0")), "dated-edges")
    out = None
    for year in cutoffs:
        c = connected_components(dated.where(F.col("y0") <= year)).groupBy("component").agg(F.count("*").alias("n"))
        one = c.agg(F.lit(year).alias("cutoff"), F.coalesce(F.sum("n"), F.lit(0)).alias("nodes"), F.coalesce(F.max("n"), F.lit(0)).alias("giant"))
        out = one if out is None else out.unionByName(one)
    return out


def pagerank(edges: DataFrame, weight: Column | None = None, iterations: int = 10, damping: float = 0.85, tolerance: float | None = None) -> DataFrame:
    """node and rank after a fixed number of steps from the uniform one, or, with tolerance, as soon as a step changes the ranks by less than tolerance a node in sum. Ranks sum to 1. Every node has an edge. The links lie in buckets of their start, so a step moves ranks only."""
    w = weight if weight is not None else F.lit(1.0)
    both = both_ways(edges.withColumn("_w", w.cast("double")), "_w")
    total = materialize(both.groupBy("x").agg(F.sum("_w").alias("_all")), "totals")
    links = bucketed(both.join(total, "x").select("x", "y", (F.col("_w") / F.col("_all")).alias("p")), "links", "x")
    n = total.count()
    rank = total.select(F.col("x").alias("node"), F.lit(1.0 / max(n, 1)).alias("rank"))
    for i in range(iterations):
        flow = links.join(rank, F.col("x") == F.col("node")).groupBy("y").agg(F.sum(F.col("rank") * F.col("p")).alias("s"))
        new = flow.select(F.col("y").alias("node"), (F.lit((1 - damping) / max(n, 1)) + F.lit(damping) * F.col("s")).alias("rank"))
        if tolerance is not None:
            new = materialize(new, "rank")
            change = new.join(rank.withColumnRenamed("rank", "was"), "node").agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0] or 0.0
            rank = new
            if change < n * tolerance:
                break
        else:
            rank = materialize(new, "rank") if i % 5 == 4 else new
    return rank


def distances(edges: DataFrame, sources: DataFrame | None = None, limit: int | None = 3) -> DataFrame:
    """x, y, d for pairs within limit steps (None: until nothing new is reached); of all nodes, or from sources (x)."""
    both = materialize(both_ways(edges).distinct(), "edges")
    reach = both if sources is None else both.join(sources.select("x").distinct(), "x")
    found = materialize(reach.withColumn("d", F.lit(1)), "reach")
    front = found
    step = both.select(F.col("x").alias("y"), F.col("y").alias("z"))
    for d in itertools.count(2) if limit is None else range(2, limit + 1):
        new = front.join(step, "y").select("x", F.col("z").alias("y")).where("x <> y").distinct().join(found.select("x", "y"), ["x", "y"], "left_anti")
        front = materialize(new.withColumn("d", F.lit(d)), "reach")
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found


def path_lengths(edges: DataFrame, sources: DataFrame, limit: int | None = None) -> DataFrame:
    """d and the number of (source, node) pairs at that distance, until nothing new is reached."""
    return distances(edges, sources, limit).groupBy("d").agg(F.count("*").alias("n"))


def largest_component(edges: DataFrame) -> DataFrame:
    """The edges of the component with most nodes (ties: smallest node)."""
    label = materialize(connected_components(edges), "components")
    best = label.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1).select("component")
    return edges.join(label.join(F.broadcast(best), "component").select(F.col("node").alias("a")), "a", "left_semi")  # one row


def path_distribution(edges: DataFrame, sources: int = 2000, seed: int = 0) -> DataFrame:
    """d, n and the mean distance in the largest component, from sources of its nodes (those of lowest hash)."""
    inner = materialize(largest_component(edges), "giant")
    start = both_ways(inner).select("x").distinct().orderBy(F.xxhash64("x", F.lit(seed)), "x").limit(sources)
    n = materialize(path_lengths(inner, start), "path-lengths")
    mean = n.agg((F.sum(F.col("d") * F.col("n")) / F.sum("n")).alias("mean"))
    return n.join(F.broadcast(mean)).select("d", "n", "mean")  # one row


def propagate_labels(edges: DataFrame, seeds: DataFrame, rounds: int = 20) -> DataFrame:
    """node and label: unlabelled nodes take the label of the largest weight among labelled neighbours (ties: smaller label), in synchronous rounds until nothing changes. Seeds keep theirs."""
    both = materialize(both_ways(edges, "w"), "edges")
    have = materialize(seeds.select("node", "label"), "labels")
    for _ in range(rounds):
        votes = both.join(have.select(F.col("node").alias("y"), "label"), "y").join(have.select(F.col("node").alias("x")), "x", "left_anti")
        votes = votes.groupBy("x", "label").agg(F.sum("w").alias("v"))
        new = votes.groupBy(F.col("x").alias("node")).agg(F.max_by("label", F.struct(F.col("v"), -F.col("label"))).alias("label"))
        new = materialize(new, "new-labels")
        if new.isEmpty():
            break
        have = have.unionByName(new)
    return have


def islands(edges: DataFrame, labels: DataFrame, least: int = 10, misc: int = -1) -> DataFrame:
    """labels for all nodes of edges: components of unlabelled nodes become communities of their own (numbered by their smallest node, above all labels) if they have least members, else misc."""
    nodes = both_ways(edges).select(F.col("x").alias("node")).distinct()
    rest = nodes.join(labels, "node", "left_anti")
    inner = edges.join(rest.select(F.col("node").alias("a")), "a", "left_semi").join(rest.select(F.col("node").alias("b")), "b", "left_semi")
    comp = rest.join(connected_components(inner), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    size = comp.groupBy("component").agg(F.count("*").alias("n"))
    top = labels.agg(F.coalesce(F.max("label"), F.lit(0)).alias("top"))
    named = comp.join(size, "component").join(F.broadcast(top))  # one row
    return labels.select("node", "label").unionByName(named.select("node", F.when(F.col("n") >= least, F.col("top") + 1 + F.col("component")).otherwise(F.lit(misc)).alias("label")))


def collapse_small(labels: DataFrame, least: int = 10, misc: int = -1) -> DataFrame:
    """Labels with fewer than least members become misc."""
    n = labels.groupBy("label").agg(F.count("*").alias("_n"))
    return labels.join(n, "label").select("node", F.when(F.col("_n") >= least, F.col("label")).otherwise(F.lit(misc)).alias("label"))


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Weighted modularity of a partition."""
    j = edges.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
    inner = j.agg(F.sum("w").cast("double").alias("m"), F.sum(F.when(F.col("la") == F.col("lb"), F.col("w")).otherwise(0)).cast("double").alias("inside"))
    deg = both_ways(edges, "w").groupBy(F.col("x").alias("node")).agg(F.sum("w").alias("k")).join(labels, "node").groupBy("label").agg(F.sum("k").cast("double").alias("k"))
    return deg.agg(F.sum(F.col("k") * F.col("k")).alias("kk")).join(F.broadcast(inner)).select((F.col("inside") / F.col("m") - F.lit(resolution) * F.col("kk") / (4 * F.col("m") * F.col("m"))).alias("modularity"))  # one row each


def _moved(near: list[dict[int, float]], k: list[float], com: list[int], resolution: float, total: float, rng) -> bool:
    """Move nodes to the neighbouring community of best gain until none moves; com changes. Whether any moved."""
    weight: dict[int, float] = {}
    for i, c in enumerate(com):
        weight[c] = weight.get(c, 0.0) + k[i]
    moved = False
    for _ in range(50):
        changed = False
        for i in rng.permutation(len(near)).tolist():
            links: dict[int, float] = {}
            for j, w in near[i].items():
                links[com[j]] = links.get(com[j], 0.0) + w
            own = com[i]
            weight[own] -= k[i]
            best, gain = own, links.get(own, 0.0) - resolution * k[i] * weight[own] / total
            for c in sorted(links):
                g = links[c] - resolution * k[i] * weight[c] / total
                if g > gain + 1e-12:
                    best, gain = c, g
            weight[best] += k[i]
            if best != own:
                com[i], changed, moved = best, True, True
        if not changed:
            return moved
    return moved


def _refined(near: list[dict[int, float]], k: list[float], com: list[int], resolution: float, total: float, rng) -> list[int]:
    """Parts of communities that hold together: single nodes join a part of their own community that they are linked to, if both are well linked to the rest of the community."""
    inside: dict[int, float] = {}
    for i, c in enumerate(com):
        inside[c] = inside.get(c, 0.0) + k[i]
    part, weight = list(range(len(near))), k.copy()
    out = [sum(w for j, w in near[i].items() if com[j] == com[i]) for i in range(len(near))]  # links of a part to the rest of its community
    alone = [True] * len(near)
    for i in rng.permutation(len(near)).tolist():
        if not alone[i] or out[i] < resolution * k[i] * (inside[com[i]] - k[i]) / total - 1e-12:
            continue
        links: dict[int, float] = {}
        for j, w in near[i].items():
            if com[j] == com[i]:
                links[part[j]] = links.get(part[j], 0.0) + w
        best, gain = i, 0.0
        for p in sorted(links):
            if p != i and out[p] >= resolution * weight[p] * (inside[com[i]] - weight[p]) / total - 1e-12:
                g = links[p] - resolution * k[i] * weight[p] / total
                if g > gain + 1e-12:
                    best, gain = p, g
        if best != i:
            part[i], alone[i], alone[best] = best, False, False
            out[best] += out[i] - 2 * links[best]
            weight[best] += k[i]
    return part


def _leiden(rows: pd.DataFrame, resolution: float, seed: int) -> dict:
    """Nodes move, communities are refined into parts that hold together, parts become nodes that start in their community; until every part is one node."""
    index = {n: i for i, n in enumerate(sorted(pd.unique(pd.concat([rows["a"], rows["b"]])).tolist()))}
    near: list[dict[int, float]] = [{} for _ in index]
    for a, b, w in zip(rows["a"], rows["b"], rows["w"], strict=True):
        i, j = index[a], index[b]
        near[i][j] = near[i].get(j, 0.0) + float(w)
        near[j][i] = near[j].get(i, 0.0) + float(w)
    loops = [0.0] * len(near)
    total = sum(sum(x.values()) for x in near)
    rng = np.random.default_rng(seed)
    member, com = list(range(len(near))), list(range(len(near)))
    while True:
        k = [sum(x.values()) + loops[i] for i, x in enumerate(near)]
        _moved(near, k, com, resolution, total, rng)
        part = _refined(near, k, com, resolution, total, rng)
        number = {p: i for i, p in enumerate(sorted(set(part)))}
        if len(number) == len(near):
            break
        member = [number[part[m]] for m in member]
        joined: list[dict[int, float]] = [{} for _ in number]
        inner, start = [0.0] * len(number), [0] * len(number)
        for i, x in enumerate(near):
            a = number[part[i]]
            start[a] = com[i]
            inner[a] += loops[i]
            for j, w in x.items():
                b = number[part[j]]
                if a == b:
                    inner[a] += w
                else:
                    joined[a][b] = joined[a].get(b, 0.0) + w
        near, loops, com = joined, inner, start
    order = {c: i for i, c in enumerate(sorted(set(com)))}
    return {node: order[com[member[i]]] for node, i in index.items()}


def communities(edges: DataFrame, least_weight: float = 1, resolution: float = 1.0, seed: int = 42, max_edges: int = 5_000_000) -> DataFrame:
    """node and label by local moving with refinement (communities hold together) on the edges of least_weight or more, in one task; the thinned graph must have max_edges edges at most, or an error is raised."""
    strong = edges.where(F.col("w") >= least_weight).select("a", "b", F.col("w").cast("double").alias("w"))
    if strong.limit(max_edges + 1).count() > max_edges:
        raise ValueError(f"more than {max_edges} edges after thinning; raise least_weight")
    kind = edges.schema["a"].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = _leiden(rows.sort_values(["a", "b"]), resolution, seed)
        return pd.DataFrame({"node": list(found), "label": list(found.values())})

    return strong.withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(run, f"node {kind}, label long")


def _paths(graph: list[dict[int, float]], i: int, weighted: bool) -> tuple[list[int], dict[int, float], dict[int, list[int]]]:
    """From i: the nodes by distance, how many shortest paths lead to each, and what stands before it on them."""
    if not weighted:
        dist, paths, before, queue = {i: 0}, {i: 1.0}, {i: []}, [i]
        for v in queue:
            for u in graph[v]:
                if u not in dist:
                    dist[u], paths[u], before[u] = dist[v] + 1, 0.0, []
                    queue.append(u)
                if dist[u] == dist[v] + 1:
                    paths[u] += paths[v]
                    before[u].append(v)
        return queue, paths, before
    order, done, best, paths, before = [], set(), {i: 0.0}, {i: 1.0}, {i: []}
    heap = [(0.0, i)]
    while heap:
        d, v = heapq.heappop(heap)
        if v in done:
            continue
        done.add(v)
        order.append(v)
        for u, length in graph[v].items():
            to = d + length
            if u in done:
                continue
            if u not in best or to < best[u] - 1e-12:
                best[u], paths[u], before[u] = to, paths[v], [v]
                heapq.heappush(heap, (to, u))
            elif abs(to - best[u]) <= 1e-12:
                paths[u] += paths[v]
                before[u].append(v)
    return order, paths, before


def betweenness(edges: DataFrame, pivots: int, seed: int = 0, max_edges: int = 5_000_000, weight: str | None = None, of: str = "node") -> DataFrame:
    """node and betweenness (of="edge": a, b and betweenness) from pivots sources (those of lowest hash), normalised and scaled to all sources.

    With weight an edge is 1 / weight long. One pass per source against the broadcast graph of max_edges edges at most, or an
    error is raised.
    """
    spark = edges.sparkSession
    if edges.limit(max_edges + 1).count() > max_edges:
        raise ValueError(f"more than {max_edges} edges; thin the graph")
    rows = edges.select("a", "b", (F.lit(1.0) if weight is None else 1 / F.col(weight).cast("double")).alias("length")).toPandas()  # max_edges rows at most
    nodes = sorted(set(rows["a"]) | set(rows["b"]))
    index = {n: i for i, n in enumerate(nodes)}
    near: list[dict[int, float]] = [{} for _ in nodes]
    for a, b, length in zip(rows["a"], rows["b"], rows["length"], strict=True):
        near[index[a]][index[b]] = near[index[b]][index[a]] = float(length)
    sent = spark.sparkContext.broadcast((nodes, near))
    both = both_ways(edges)
    starts = both.select(F.col("x").alias("node")).distinct().orderBy(F.xxhash64("node", F.lit(seed)), "node").limit(pivots).repartition(max(1, min(pivots, 64)), "node")
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches):
        names, graph = sent.value
        at = {n: i for i, n in enumerate(names)}
        score: dict = {}
        for batch in batches:
            for s in batch["node"]:
                i = at[s]
                order, paths, before = _paths(graph, i, weight is not None)
                back = dict.fromkeys(order, 0.0)
                for u in reversed(order):
                    for v in before[u]:
                        flow = paths[v] / paths[u] * (1 + back[u])
                        back[v] += flow
                        if of == "edge":
                            e = (min(u, v), max(u, v))
                            score[e] = score.get(e, 0.0) + flow
                    if of == "node" and u != i:
                        score[u] = score.get(u, 0.0) + back[u]
        if of == "edge":
            yield pd.DataFrame({"a": [names[a] for a, _ in score], "b": [names[b] for _, b in score], "part": list(score.values())})
        else:
            yield pd.DataFrame({"node": [names[i] for i in score], "part": list(score.values())})

    n = len(nodes)
    share = n / max(1, min(pivots, n))
    if of == "edge":
        sums = starts.mapInPandas(run, f"a {kind}, b {kind}, part double").groupBy("a", "b").agg((F.sum("part") * (share / max(1, n * (n - 1)))).alias("betweenness"))
        return edges.select("a", "b").join(sums, ["a", "b"], "left").select("a", "b", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))
    sums = starts.mapInPandas(run, f"node {kind}, part double").groupBy("node").agg((F.sum("part") * (share / max(1, (n - 1) * (n - 2)))).alias("betweenness"))
    return both.select(F.col("x").alias("node")).distinct().join(sums, "node", "left").select("node", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))


def homophily(near: DataFrame, labels: DataFrame, least: int = 3) -> DataFrame:
    """node, scored neighbours, those of its own label, their share and its lift over the label concentration. near (x, y); nodes with fewer than least neighbours, labelled or not, are left out."""
    base = labels.groupBy("label").agg(F.count("*").alias("n")).agg((F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("base"))
    j = near.join(labels.select(F.col("node").alias("x"), F.col("label").alias("lx")), "x").join(labels.select(F.col("node").alias("y"), F.col("label").alias("ly")), "y")
    g = j.groupBy(F.col("x").alias("node")).agg(F.count("*").alias("scored"), F.count_if(F.col("lx") == F.col("ly")).alias("same")).where(F.col("scored") >= least)
    return g.join(F.broadcast(base)).select("node", "scored", "same", (F.col("same") / F.col("scored")).alias("homophily"), (F.col("same") / F.col("scored") / F.col("base")).alias("lift"))  # base is one row


def type_matrix(edges: DataFrame, types: DataFrame) -> DataFrame:
    """ta, tb, n (edge ends), share of ta's ends, lift over tb's share of the nodes. types (node, type)."""
    j = both_ways(edges).join(types.select(F.col("node").alias("x"), F.col("type").alias("ta")), "x").join(types.select(F.col("node").alias("y"), F.col("type").alias("tb")), "y")
    n = j.groupBy("ta", "tb").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("ta")))
    total = types.agg(F.count("*").alias("all"))
    pop = types.groupBy(F.col("type").alias("tb")).agg(F.count("*").alias("pop")).join(F.broadcast(total))  # one row
    return n.join(pop, "tb").select("ta", "tb", "n", "share", (F.col("share") / (F.col("pop") / F.col("all"))).alias("lift"))


def bridges(edges: DataFrame, labels: DataFrame, k: int = 100, by: str = "w") -> DataFrame:
    """Label pairs (low, high) and how many of the k edges between different labels that are first by by (a weight, or edge betweenness) join them."""
    j = edges.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b").where("la <> lb")
    return j.orderBy(F.desc(by), "a", "b").limit(k).groupBy(F.least("la", "lb").alias("low"), F.greatest("la", "lb").alias("high")).agg(F.count("*").alias("n"))


def multiplex(edges: DataFrame, near: DataFrame, floor: float = 0.6, share: float = 0.5) -> DataFrame:
    """Layers summed: share * ln(1 + w) of the edges, and (1 - share) * (s - floor) / (1 - floor) of each direction of mutual neighbours (x, y, s) with s >= floor."""
    mutual = near.alias("p").join(near.alias("q"), (F.col("p.x") == F.col("q.y")) & (F.col("p.y") == F.col("q.x"))).where(F.col("p.s") >= floor)
    mutual = mutual.select(F.least("p.x", "p.y").alias("a"), F.greatest("p.x", "p.y").alias("b"), (F.lit(1 - share) * (F.col("p.s") - floor) / (1 - floor)).alias("w"))
    return edges.select("a", "b", (F.lit(share) * F.log1p(F.col("w"))).alias("w")).unionByName(mutual).groupBy("a", "b").agg(F.sum("w").alias("w"))


def conflicts(edges: DataFrame, near: DataFrame) -> DataFrame:
    """node and its sorted distinct neighbours over edges (both ways) and an adjacency (x, y)."""
    return both_ways(edges).union(near.select("x", "y")).groupBy(F.col("x").alias("node")).agg(F.array_sort(F.collect_set("y")).alias("conflicts"))


def rescale(rows: DataFrame, columns: Sequence[str], bound: float = 900.0) -> DataFrame:
    """Columns moved to [-bound, bound] by their least and largest values."""
    ends = rows.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    out = rows.join(F.broadcast(ends))  # one row
    for c in columns:
        out = out.withColumn(c, F.coalesce((F.col(c) - F.col(f"_lo_{c}")) / F.nullif(F.col(f"_hi_{c}") - F.col(f"_lo_{c}"), F.lit(0)) * (2 * bound) - bound, F.lit(0.0)))
    return out.select(*rows.columns)
