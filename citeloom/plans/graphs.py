"""Queries of the graph operators, over parts that occur in the same orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..sources.tables import materialize, shuffle_parts
from .base import EDGES, PAIRS, PARTS, items, query, table


def _parts(spark, d):
    """(item, member) of order lines; may repeat, which the pairs allow."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_partkey").alias("member"))


def _dated_parts(spark, d):
    """_parts with the order's year, lying by item in as many partitions as the pairs are made from."""
    li, o = _parts(spark, d), items(spark, d).select("item", "year")
    return li.repartition(shuffle_parts(li.join(o, "item")), "item").join(o, "item")


def _pairs(spark, d):
    return G.pair_weights(_parts(spark, d))


def _edges(spark, d):
    return materialize(_pairs(spark, d).where("w >= 2"), "pairs")  # read several times by every operator


@query("pair_newman", f"WITH {PAIRS} SELECT a, b, w, round(wn, 9) AS wn FROM pairs")
def pair_newman(spark, d):
    return _pairs(spark, d).select("a", "b", "w", F.round("wn", 9).alias("wn"))


@query("pair_years", f"WITH {PARTS}, y AS (SELECT item, member, CAST(year(o_orderdate) AS INTEGER) AS year FROM parts JOIN orders ON item = o_orderkey) SELECT x.member AS a, z.member AS b, count(*) AS w, array_to_string(list(x.year ORDER BY x.year), ',') AS years FROM y x JOIN y z ON x.item = z.item AND x.member < z.member GROUP BY 1, 2 HAVING count(*) >= 2")
def pair_years(spark, d):
    return G.pair_weights(_dated_parts(spark, d), year="year").where("w >= 2").select("a", "b", "w", F.concat_ws(",", F.transform("years", lambda y: y.cast("string"))).alias("years"))


@query("degree_strength", f"WITH {EDGES} SELECT x AS node, count(*) AS degree, CAST(sum(w) AS BIGINT) AS strength FROM both_ways GROUP BY x")
def degree_strength(spark, d):
    return G.degrees(_edges(spark, d)).select("node", "degree", "strength")


@query("adjacency_top200", f"WITH {PAIRS}, bw AS (SELECT a AS x, b AS y, w FROM pairs UNION ALL SELECT b, a, w FROM pairs), r AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY w DESC, y) AS r FROM bw) SELECT x AS node, md5(string_agg(y || ':' || w, ',' ORDER BY r)) AS near_md5, count(*) AS n FROM r WHERE r <= 200 GROUP BY x")
def adjacency_top200(spark, d):
    near = F.concat_ws(",", F.transform("near", lambda e: F.concat_ws(":", e["y"].cast("string"), e["w"].cast("string"))))
    return G.adjacency(_pairs(spark, d)).select("node", F.md5(near.cast("binary")).alias("near_md5"), F.size("near").cast("long").alias("n"))


_REACH = "reach AS (SELECT DISTINCT x, x AS y FROM both_ways UNION SELECT r.x, e.y FROM reach r JOIN both_ways e ON r.y = e.x)"


@query("components", f"WITH RECURSIVE {EDGES}, {_REACH} SELECT x AS node, min(y) AS component FROM reach GROUP BY x")
def components(spark, d):
    return G.connected_components(_edges(spark, d))


_LABELS = "labels AS (SELECT p_partkey AS node, CAST(p_size % 7 AS BIGINT) AS label FROM part)"


def _labels(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("node"), (F.col("p_size") % 7).cast("long").alias("label"))


def _ranks(weight: str, n: int) -> str:
    sql = f"WITH {EDGES}, t AS (SELECT x, sum({weight}) AS s FROM both_ways GROUP BY x), l AS (SELECT e.x, e.y, CAST(e.{weight} AS DOUBLE) / t.s AS p FROM both_ways e JOIN t ON e.x = t.x), r0 AS (SELECT x AS node, 1.0 / (SELECT count(*) FROM t) AS rank FROM t)".replace("e.1", "1").replace("sum(1)", "count(*)")
    for i in range(n):
        sql += f", r{i + 1} AS (SELECT l.y AS node, 0.15 / (SELECT count(*) FROM t) + 0.85 * sum(r.rank * l.p) AS rank FROM l JOIN r{i} r ON l.x = r.node GROUP BY l.y)"
    return sql + f" SELECT node, round(rank * 1000, 8) AS rank FROM r{n}"


@query("pagerank", _ranks("1", 10))
def pagerank(spark, d):
    return G.pagerank(_edges(spark, d)).select("node", F.round(F.col("rank") * 1000, 8).alias("rank"))


@query("pagerank_weighted", _ranks("w", 10))
def pagerank_weighted(spark, d):
    return G.pagerank(_edges(spark, d), F.col("w")).select("node", F.round(F.col("rank") * 1000, 8).alias("rank"))


_STEPS = "d1 AS (SELECT DISTINCT x, y FROM both_ways), d2 AS (SELECT DISTINCT p.x, q.y FROM d1 p JOIN d1 q ON p.y = q.x WHERE p.x <> q.y), d3 AS (SELECT DISTINCT p.x, q.y FROM d2 p JOIN d1 q ON p.y = q.x WHERE p.x <> q.y), near AS (SELECT x, y, CAST(min(d) AS INTEGER) AS d FROM (SELECT x, y, 1 AS d FROM d1 UNION ALL SELECT x, y, 2 FROM d2 UNION ALL SELECT x, y, 3 FROM d3) GROUP BY x, y)"


@query("bfs3", f"WITH {EDGES}, {_STEPS} SELECT x, y, d FROM near")
def bfs3(spark, d):
    return G.distances(_edges(spark, d), limit=3)


@query("path_lengths", f"WITH {EDGES}, {_STEPS} SELECT d, count(*) AS n FROM near WHERE x IN (SELECT x FROM both_ways GROUP BY x HAVING count(*) >= 3) GROUP BY d")
def path_lengths(spark, d):
    e = _edges(spark, d)
    sources = G.both_ways(e).groupBy("x").count().where("count >= 3").select("x")
    return G.path_lengths(e, sources, 3)


@query("path_lengths_all")
def path_lengths_all(spark, d):
    """path_lengths without its limit of 3 steps: until nothing new is reached."""
    e = _edges(spark, d)
    sources = G.both_ways(e).groupBy("x").count().where("count >= 3").select("x")
    return G.path_lengths(e, sources)


@query("giant_fraction", " UNION ALL ".join(f"""SELECT * FROM (WITH RECURSIVE {PARTS}, y AS (SELECT item, member, CAST(year(o_orderdate) AS INTEGER) AS year FROM parts JOIN orders ON item = o_orderkey),
e AS (SELECT p.member AS a, z.member AS b FROM y p JOIN y z ON p.item = z.item AND p.member < z.member GROUP BY 1, 2 HAVING count(*) >= 2 AND min(p.year) <= {c}), both_ways AS (SELECT a AS x, b AS y FROM e UNION ALL SELECT b, a FROM e), {_REACH},
c AS (SELECT x, min(y) AS k FROM reach GROUP BY x), s AS (SELECT k, count(*) AS n FROM c GROUP BY k) SELECT CAST({c} AS INTEGER) AS cutoff, CAST(coalesce(sum(n), 0) AS BIGINT) AS nodes, coalesce(max(n), 0) AS giant FROM s)""" for c in (1996, 1998, 2001)))
def giant_fraction(spark, d):
    return G.giant_fraction(G.pair_weights(_dated_parts(spark, d), year="year").where("w >= 2"), F.array_min("years"), (1996, 1998, 2001))


_SEEDS = "seeds AS (SELECT x AS node, CAST(x % 5 AS BIGINT) AS label FROM both_ways GROUP BY x HAVING count(*) >= 5)"


def _seeds(spark, d, e):
    return G.both_ways(e).groupBy(F.col("x").alias("node")).count().where("count >= 5").select("node", (F.col("node") % 5).cast("long").alias("label"))


def _spread(n: int) -> str:
    sql = f"{EDGES}, {_SEEDS}, h0 AS (SELECT node, label FROM seeds)"
    for i in range(n):
        sql += f", v{i} AS (SELECT e.x, h.label, sum(e.w) AS v FROM both_ways e JOIN h{i} h ON e.y = h.node WHERE e.x NOT IN (SELECT node FROM h{i}) GROUP BY 1, 2), n{i} AS (SELECT x AS node, label, row_number() OVER (PARTITION BY x ORDER BY v DESC, label) AS r FROM v{i}), h{i + 1} AS (SELECT node, label FROM h{i} UNION ALL SELECT node, label FROM n{i} WHERE r = 1)"
    return sql


@query("label_propagation", f"WITH {_spread(4)} SELECT node, label FROM h4")
def label_propagation(spark, d):
    e = _edges(spark, d)
    return G.propagate_labels(e, _seeds(spark, d, e), 4)


@query("islands", f"WITH RECURSIVE {_spread(1)}, u AS (SELECT DISTINCT x AS node FROM both_ways WHERE x NOT IN (SELECT node FROM h1)), ue AS (SELECT x, y FROM both_ways WHERE x IN (SELECT node FROM u) AND y IN (SELECT node FROM u)), reach AS (SELECT node AS x, node AS y FROM u UNION SELECT r.x, e.y FROM reach r JOIN ue e ON r.y = e.x), c AS (SELECT x AS node, min(y) AS k FROM reach GROUP BY x), z AS (SELECT k, count(*) AS n FROM c GROUP BY k) SELECT node, label FROM h1 UNION ALL SELECT c.node, CASE WHEN n >= 3 THEN (SELECT coalesce(max(label), 0) FROM h1) + 1 + c.k ELSE -1 END FROM c JOIN z ON c.k = z.k")
def islands(spark, d):
    e = _edges(spark, d)
    return G.islands(e, G.propagate_labels(e, _seeds(spark, d, e), 1), least=3)


@query("collapse_small", "WITH l AS (SELECT p_partkey AS node, CAST(p_size AS BIGINT) AS label FROM part), n AS (SELECT label, count(*) AS n FROM l GROUP BY label) SELECT node, CASE WHEN n >= 35 THEN l.label ELSE -1 END AS label FROM l JOIN n ON l.label = n.label")
def collapse_small(spark, d):
    return G.collapse_small(table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_size").cast("long").alias("label")), 35)


@query("modularity", f"WITH {EDGES}, {_LABELS}, j AS (SELECT e.w, p.label AS la, q.label AS lb FROM edges e JOIN labels p ON e.a = p.node JOIN labels q ON e.b = q.node), k AS (SELECT label, sum(w) AS k FROM both_ways JOIN labels ON x = node GROUP BY label), i AS (SELECT CAST(sum(w) AS DOUBLE) AS m, CAST(sum(CASE WHEN la = lb THEN w ELSE 0 END) AS DOUBLE) AS inside FROM j) SELECT round(any_value(inside / m) - sum(CAST(k AS DOUBLE) * k) / (4 * any_value(m * m)), 9) AS modularity FROM k, i")
def modularity(spark, d):
    return G.modularity(_edges(spark, d), _labels(spark, d)).select(F.round("modularity", 9).alias("modularity"))


@query("homophily", f"WITH {EDGES}, {_LABELS}, n AS (SELECT label, count(*) AS n FROM labels GROUP BY label), b AS (SELECT CAST(sum(n * n) AS DOUBLE) / CAST(sum(n) * sum(n) AS DOUBLE) AS base FROM n), g AS (SELECT e.x AS node, count(*) AS scored, count(*) FILTER (WHERE p.label = q.label) AS same FROM both_ways e JOIN labels p ON e.x = p.node JOIN labels q ON e.y = q.node GROUP BY e.x HAVING count(*) >= 3) SELECT node, scored, same, round(same / scored, 9) AS homophily, round(same / scored / base, 9) AS lift FROM g, b")
def homophily(spark, d):
    h = G.homophily(G.both_ways(_edges(spark, d)), _labels(spark, d))
    return h.select("node", "scored", "same", F.round("homophily", 9).alias("homophily"), F.round("lift", 9).alias("lift"))


@query("collab_matrix_lift", f"WITH {EDGES}, {_LABELS}, n AS (SELECT p.label AS ta, q.label AS tb, count(*) AS n FROM both_ways e JOIN labels p ON e.x = p.node JOIN labels q ON e.y = q.node GROUP BY 1, 2), s AS (SELECT *, n / sum(n) OVER (PARTITION BY ta) AS share FROM n), pop AS (SELECT label, count(*) / (SELECT count(*) FROM labels) AS part FROM labels GROUP BY label) SELECT ta, tb, n, round(share, 9) AS share, round(share / part, 9) AS lift FROM s JOIN pop ON tb = label")
def collab_matrix_lift(spark, d):
    m = G.type_matrix(_edges(spark, d), _labels(spark, d).withColumnRenamed("label", "type"))
    return m.select("ta", "tb", "n", F.round("share", 9).alias("share"), F.round("lift", 9).alias("lift"))


@query("bridges", f"WITH {EDGES}, {_LABELS}, j AS (SELECT e.*, p.label AS la, q.label AS lb FROM edges e JOIN labels p ON e.a = p.node JOIN labels q ON e.b = q.node WHERE p.label <> q.label ORDER BY w DESC, a, b LIMIT 100) SELECT least(la, lb) AS low, greatest(la, lb) AS high, count(*) AS n FROM j GROUP BY 1, 2")
def bridges(spark, d):
    return G.bridges(_edges(spark, d), _labels(spark, d), 100)


@query("conflict_lists", f"WITH {EDGES}, {PARTS.replace('parts AS', 'p2 AS')}, s AS (SELECT DISTINCT l_partkey AS x, l_suppkey AS y FROM lineitem), u AS (SELECT x, y FROM both_ways UNION SELECT x, y FROM s) SELECT x AS node, md5(array_to_string(list_sort(list(y)), ',')) AS list_md5, count(*) AS n FROM u GROUP BY x")
def conflict_lists(spark, d):
    near = table(spark, d, "lineitem").select(F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y")).distinct()
    c = G.conflicts(_edges(spark, d), near)
    return c.select("node", F.md5(F.concat_ws(",", F.transform("conflicts", lambda y: y.cast("string"))).cast("binary")).alias("list_md5"), F.size("conflicts").cast("long").alias("n"))


@query("layout_rescale", "SELECT s_suppkey, round((s_acctbal - (SELECT min(s_acctbal) FROM supplier)) / ((SELECT max(s_acctbal) FROM supplier) - (SELECT min(s_acctbal) FROM supplier)) * 1800 - 900, 6) AS x FROM supplier")
def layout_rescale(spark, d):
    return G.rescale(table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("x")), ["x"]).withColumn("x", F.round("x", 6))


@query("communities_quality")
def communities_quality(spark, d):
    """The modularity that local moving with refinement reaches."""
    e = _edges(spark, d)
    return G.modularity(e, G.communities(e)).select(F.round("modularity", 6).alias("modularity"))


@query("betweenness_pivots")
def betweenness_pivots(spark, d):
    return G.betweenness(_edges(spark, d), 64).select("node", F.round("betweenness", 9).alias("betweenness"))


@query("edge_betweenness_pivots")
def edge_betweenness_pivots(spark, d):
    """Edges between different labels by how many shortest paths cross them, and what labels the first hundred join."""
    e = _edges(spark, d)
    scored = e.join(G.betweenness(e, 32, of="edge"), ["a", "b"])
    return G.bridges(scored.withColumn("betweenness", F.round("betweenness", 9)), _labels(spark, d), 100, "betweenness")


@query("betweenness_weighted")
def betweenness_weighted(spark, d):
    return G.betweenness(_edges(spark, d), 32, weight="w").select("node", F.round("betweenness", 9).alias("betweenness"))


@query("pagerank_converged")
def pagerank_converged(spark, d):
    """Steps until the ranks change by less than 1e-6 a node in sum."""
    return G.pagerank(_edges(spark, d), iterations=100, tolerance=1e-6).withColumn("rank", F.round("rank", 9))


@query(
    "graph_payload",
    f"""WITH {EDGES}, {_LABELS}, d AS (SELECT x AS node, count(*) AS degree, CAST(sum(w) AS BIGINT) AS strength FROM both_ways GROUP BY x) SELECT d.node, p_name AS label, CAST(l.label AS BIGINT) AS community, degree, strength, round(degree * 1e4 / (SELECT count(*) - 1 FROM d), 2) AS centrality FROM d JOIN part ON p_partkey = d.node JOIN labels l ON l.node = d.node""",
)
def graph_payload(spark, d):
    """Nodes as they are exported: name, community, degree, strength and scaled degree centrality."""
    from ..functions.text import scaled

    deg = G.degrees(_edges(spark, d))
    n = deg.agg((F.count("*") - 1).alias("n"))
    out = deg.join(table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_name").alias("label")), "node").join(_labels(spark, d).select("node", F.col("label").cast("long").alias("community")), "node").join(F.broadcast(n))  # one row
    return out.select("node", "label", "community", "degree", "strength", scaled(F.col("degree") / F.col("n")).alias("centrality"))


@query("top_hubs", f"WITH {EDGES}, d AS (SELECT x AS node, CAST(sum(w) AS BIGINT) AS strength FROM both_ways GROUP BY x) SELECT node, strength FROM d ORDER BY strength DESC, node LIMIT 100")
def top_hubs(spark, d):
    return G.degrees(_edges(spark, d)).orderBy(F.desc("strength"), "node").limit(100).select("node", "strength")


@query("community_heads", f"WITH {EDGES}, {_LABELS}, d AS (SELECT x AS node, CAST(sum(w) AS BIGINT) AS strength FROM both_ways GROUP BY x), r AS (SELECT l.label, d.node, strength, row_number() OVER (PARTITION BY l.label ORDER BY strength DESC, d.node) AS rank FROM d JOIN labels l ON l.node = d.node) SELECT CAST(label AS BIGINT) AS label, node, strength, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def community_heads(spark, d):
    from ..operators.relational import top_per_group

    j = G.degrees(_edges(spark, d)).join(_labels(spark, d), "node").select(F.col("label").cast("long").alias("label"), "node", "strength")
    return top_per_group(j, ["label"], [F.desc("strength"), F.col("node")], 5)


@query("giant_paths")
def giant_paths(spark, d):
    """Distances in the largest component from up to 50 of its nodes, to the end."""
    return G.path_distribution(_edges(spark, d), 50).select("d", "n", F.round("mean", 6).alias("mean"))
