"""Queries of the vector, text, metric and evaluation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import evaluation as E
from ..operators import graph as G
from ..operators import semantic as S
from ..operators import text_models as M
from ..operators.ordering import group_quantiles
from ..sources.tables import materialize
from .base import ITEMS, items, members, query, table


def _emb(spark, d):
    return table(spark, d, "embeddings")


_UNIT = "u AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE))))) AS v FROM embeddings)"
_KNN = _UNIT + ", s AS (SELECT p.vec_id AS x, q.vec_id AS y, round(list_sum(list_transform(range(1, len(p.v) + 1), lambda i: p.v[i] * q.v[i])), 12) AS s FROM u p JOIN u q ON p.vec_id <> q.vec_id), knn AS (SELECT * FROM (SELECT x, y, s, row_number() OVER (PARTITION BY x ORDER BY s DESC, y) AS rank FROM s) WHERE rank <= 5)"


@query("knn_cosine", f"WITH {_KNN} SELECT x, y, round(s, 6) AS s, CAST(rank AS INTEGER) AS rank FROM knn")
def knn_cosine(spark, d):
    return S.neighbours(_emb(spark, d), "vec_id", "embedding", 5).withColumn("s", F.round("s", 6))


@query("mutual_knn", f"WITH {_KNN} SELECT k.x, k.y, round(k.s, 6) AS s FROM knn k JOIN knn r ON k.x = r.y AND k.y = r.x WHERE k.s >= 0.2")
def mutual_knn(spark, d):
    return S.mutual(S.neighbours(_emb(spark, d), "vec_id", "embedding", 5), 0.2).select("x", "y", F.round("s", 6).alias("s"))


_CHAIN = "edges AS (SELECT p.vec_id AS a, q.vec_id AS b, 2 AS w FROM embeddings p JOIN embeddings q ON q.vec_id = p.vec_id + 1), bw AS (SELECT a AS x, b AS y FROM edges UNION SELECT b, a FROM edges), d1 AS (SELECT * FROM bw), d2 AS (SELECT DISTINCT p.x, q.y FROM d1 p JOIN d1 q ON p.y = q.x WHERE p.x <> q.y), dist AS (SELECT x, y, CAST(min(d) AS INTEGER) AS d FROM (SELECT x, y, 1 AS d FROM d1 UNION ALL SELECT x, y, 2 FROM d2) GROUP BY x, y)"


def _chain(spark, d):
    e = _emb(spark, d)
    return e.select(F.col("vec_id").alias("a")).join(e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b")), "a").withColumn("w", F.lit(2))


@query("phantom_flags", f"WITH {_KNN}, {_CHAIN} SELECT k.x, k.y, t.d, t.d IS NULL OR t.d >= 2 AS unmet FROM knn k LEFT JOIN dist t ON k.x = t.x AND k.y = t.y")
def phantom_flags(spark, d):
    near = S.neighbours(_emb(spark, d), "vec_id", "embedding", 5)
    return S.unmet(near, G.distances(_chain(spark, d), limit=2)).select("x", "y", "d", "unmet")


@query("multiplex_edges", f"WITH {_KNN}, {_CHAIN}, m AS (SELECT least(k.x, k.y) AS a, greatest(k.x, k.y) AS b, 0.5 * (k.s - 0.2) / 0.8 AS w FROM knn k JOIN knn r ON k.x = r.y AND k.y = r.x WHERE k.s >= 0.2) SELECT a, b, round(sum(w), 6) AS w FROM (SELECT a, b, 0.5 * ln(1 + w) AS w FROM edges UNION ALL SELECT a, b, w FROM m) GROUP BY a, b")
def multiplex_edges(spark, d):
    near = S.neighbours(_emb(spark, d), "vec_id", "embedding", 5)
    return G.multiplex(_chain(spark, d), near, 0.2).select("a", "b", F.round("w", 6).alias("w"))


@query("centroid_weighted", "WITH e AS (SELECT label, 1.0 + ln(1 + vec_id) AS w, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS i FROM embeddings), c AS (SELECT label, i, round(sum(w * CAST(x AS DOUBLE)) / sum(w), 8) AS m FROM e GROUP BY label, i) SELECT label, i, m FROM c")
def centroid_weighted(spark, d):
    from ..functions.text import damped_weight

    c = S.centroids(_emb(spark, d), ["label"], "embedding", damped_weight(F.col("vec_id")))
    return c.select("label", F.posexplode("centroid").alias("i", "m")).select("label", F.col("i").cast("long").alias("i"), F.round("m", 8).alias("m"))


@query("quantize_int8", "WITH e AS (SELECT vec_id, embedding, greatest(1e-8, list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))))) AS s FROM embeddings) SELECT vec_id, round(s, 9) AS scale, array_to_string(list_transform(embedding, lambda x: CAST(round_even(CAST(x AS DOUBLE) / s * 127, 0) AS INTEGER)), ',') AS q FROM e")
def quantize_int8(spark, d):
    v = F.col("embedding")
    return _emb(spark, d).select("vec_id", F.round(V.scale(v), 9).alias("scale"), F.concat_ws(",", F.transform(V.to_int8(v), lambda x: x.cast("string"))).alias("q"))


@query("hybrid_blend", "WITH l AS (SELECT vec_id, label, CAST(x AS DOUBLE) * sqrt(0.65) AS x, i FROM (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS i FROM embeddings)) SELECT vec_id, round(sum(x * x) + 0.35 * max(label) * max(label), 6) AS square FROM l GROUP BY vec_id")
def hybrid_blend(spark, d):
    both = V.blend([(0.65, F.col("embedding")), (0.35, F.array(F.col("label").cast("double")))])
    return _emb(spark, d).select("vec_id", F.round(V.dot(both, both), 6).alias("square"))


@query("whiten")
def whiten(spark, d):
    """Whitened vectors, a row a component."""
    e = _emb(spark, d)
    w = S.fit_whitening(e, "embedding")
    return S.apply_matrix(e, "embedding", w, "white").select("vec_id", F.posexplode("white").alias("i", "x")).withColumn("x", F.round("x", 6))


@query("project_2d")
def project_2d(spark, d):
    p = S.project(_emb(spark, d), "embedding")
    return p.select("vec_id", F.round(F.get("point", F.lit(0)), 3).alias("x"), F.round(F.get("point", F.lit(1)), 3).alias("y"))


@query("discriminant_axes")
def discriminant_axes(spark, d):
    e = _emb(spark, d)
    axes = S.discriminants(e, "embedding", "label", 2)
    return S.apply_matrix(e, "embedding", lambda m: m @ axes, "at").select("vec_id", F.round(F.abs(F.get("at", F.lit(0))), 6).alias("x"), F.round(F.abs(F.get("at", F.lit(1))), 6).alias("y"))


@query("reviewer_rank", "WITH q AS (SELECT list_transform(range(1, 65), lambda i: CASE WHEN i = 1 THEN 1.0 / (1.0 + 1e-8) ELSE 0.0 END) AS q) SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) / (1.0 + 1e-8), 6) AS score FROM embeddings ORDER BY CAST(embedding[1] AS DOUBLE) DESC, vec_id LIMIT 10")
def reviewer_rank(spark, d):
    return S.rank_reviewers(_emb(spark, d), "vec_id", "embedding", [1.0] + [0.0] * 63, None).select("vec_id", F.round("score", 6).alias("score"))


_DOT = "list_sum(list_transform(range(1, 65), lambda i: {0}[i] * {1}[i]))"


@query(
    "reviewer_rank_references",
    f"""WITH r AS (SELECT list(m ORDER BY i) AS m FROM (SELECT i, avg(CAST(x AS DOUBLE)) AS m FROM (SELECT unnest(embedding) AS x, unnest(range(0, 64)) AS i FROM embeddings WHERE vec_id IN (3, 11, 12)) GROUP BY i)),
ru AS (SELECT list_transform(m, lambda x: x / (sqrt({_DOT.format("m", "m")}) + 1e-8)) AS r FROM r), b AS (SELECT list_transform(range(1, 65), lambda i: 0.7 * (CASE WHEN i = 1 THEN 1.0 / (1.0 + 1e-8) ELSE 0.0 END) + 0.3 * r[i]) AS b FROM ru),
q AS (SELECT list_transform(b, lambda x: x / (sqrt({_DOT.format("b", "b")}) + 1e-8)) AS q FROM b), v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE vec_id NOT IN (3, 11, 12, 20))
SELECT vec_id, round({_DOT.format("v", "q")}, 6) AS score FROM v, q ORDER BY {_DOT.format("v", "q")} DESC, vec_id LIMIT 10""",
)
def reviewer_rank_references(spark, d):
    """A query blended with reference works; their authors and a conflict are left out."""
    e = _emb(spark, d)
    refs = e.where(F.col("vec_id").isin(3, 11, 12))
    free = e.where(~F.col("vec_id").isin(3, 11, 12, 20))
    return S.rank_reviewers(free, "vec_id", "embedding", [1.0] + [0.0] * 63, refs).select("vec_id", F.round("score", 6).alias("score"))


@query("group_centres", "WITH d AS (SELECT s_suppkey, s_nationkey, s_acctbal AS x, s_acctbal * 2 - s_suppkey AS y, greatest(1, count(l_orderkey)) AS w FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_quantity >= 50 GROUP BY ALL) SELECT s_nationkey, round(sum(x * w) / sum(w), 6) AS x, round(sum(y * w) / sum(w), 6) AS y, count(*) AS n FROM d GROUP BY s_nationkey")
def group_centres(spark, d):
    """Places of groups on a map: their members' places, weighted by degree, 1 at least."""
    w = table(spark, d, "lineitem").where("l_quantity >= 50").groupBy("l_suppkey").agg(F.count("*").alias("w"))
    s = table(spark, d, "supplier").join(w, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    at = s.select("s_nationkey", F.array(F.col("s_acctbal"), F.col("s_acctbal") * 2 - F.col("s_suppkey")).alias("at"), "w")
    c = S.centroids(at, ["s_nationkey"], "at", F.greatest(F.lit(1), F.coalesce("w", F.lit(1))))
    return c.select("s_nationkey", F.round(F.get("centroid", F.lit(0)), 6).alias("x"), F.round(F.get("centroid", F.lit(1)), 6).alias("y"), "n")


_BINS = "p AS (SELECT user_id, CAST(floor((day(ts) - 1) / 5) AS INTEGER) AS period, avg(value) AS x, count(*) AS y FROM events GROUP BY 1, 2)"


@query("trajectory_taxonomy", f"WITH {_BINS}, s AS (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS seg FROM p WINDOW w AS (PARTITION BY user_id ORDER BY period)), g AS (SELECT user_id, count(*) AS bins, sum(seg) AS path, sqrt(pow(arg_max(x, period) - arg_min(x, period), 2) + pow(arg_max(y, period) - arg_min(y, period), 2)) AS net FROM s GROUP BY user_id HAVING count(*) >= 3) SELECT user_id, bins, round(path, 6) AS path, round(net, 6) AS net, CASE WHEN path < 15 THEN 'stayer' WHEN net / path >= 0.6 THEN 'drifter' WHEN net < 15 THEN 'returner' ELSE 'switcher' END AS class FROM g")
def trajectory_taxonomy(spark, d):
    p = table(spark, d, "events").groupBy("user_id", F.floor((F.dayofmonth("ts") - 1) / 5).cast("int").alias("period")).agg(F.avg("value").alias("x"), F.count("*").alias("y"))
    return S.trajectories(p, "user_id", "period", "x", "y").select("user_id", "bins", F.round("path", 6).alias("path"), F.round("net", 6).alias("net"), "class")


@query("personality", "WITH e AS (SELECT user_id, count(*) AS n, avg(value) AS v, count(*) FILTER (WHERE event_type = 'purchase') AS b FROM events GROUP BY user_id), m AS (SELECT quantile_disc(n, 0.5) AS n, quantile_disc(v, 0.5) AS v, quantile_disc(b, 0.5) AS b FROM e), t AS (SELECT user_id, CASE WHEN e.n >= m.n THEN 'M' ELSE 'S' END || CASE WHEN e.v >= m.v THEN 'H' ELSE 'L' END || CASE WHEN e.b >= m.b THEN 'B' ELSE 'N' END AS type FROM e, m), a AS (SELECT x.t || y.t || z.t AS type FROM (VALUES ('M'), ('S')) x(t), (VALUES ('H'), ('L')) y(t), (VALUES ('B'), ('N')) z(t)) SELECT a.type, count(t.user_id) AS n FROM a LEFT JOIN t ON a.type = t.type GROUP BY a.type")
def personality(spark, d):
    """Users by three axes split at their lower medians; every cell has a row."""
    e = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.avg("value").alias("v"), F.count_if(F.col("event_type") == "purchase").alias("b"))
    med = None
    for c in "nvb":
        one = group_quantiles(e.withColumn("one", F.lit(1)), ["one"], c, {f"m{c}": 0.5}, lower=(f"m{c}",)).drop("one")
        med = one if med is None else med.join(F.broadcast(one))  # one row each
    axis = lambda c, a, b: F.when(F.col(c) >= F.col(f"m{c}"), a).otherwise(b)
    t = e.join(F.broadcast(med)).select("user_id", F.concat(axis("n", "M", "S"), axis("v", "H", "L"), axis("b", "B", "N")).alias("type"))  # one row
    cells = spark.createDataFrame([(a + b + c,) for a in "MS" for b in "HL" for c in "BN"], "type string")
    return cells.join(t, "type", "left").groupBy("type").agg(F.count("user_id").alias("n"))


@query("nmi_ari_vi", "WITH c AS (SELECT quality AS a, toxic AS b, CAST(count(*) AS DOUBLE) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1, 2), a AS (SELECT a, sum(n) AS n FROM c GROUP BY a), b AS (SELECT b, sum(n) AS n FROM c GROUP BY b), t AS (SELECT sum(n) AS n FROM c), h AS (SELECT (SELECT n FROM t) AS n, (SELECT ln(any_value(t.n)) - sum(a.n * ln(a.n)) / any_value(t.n) FROM a, t) AS ha, (SELECT ln(any_value(t.n)) - sum(b.n * ln(b.n)) / any_value(t.n) FROM b, t) AS hb, (SELECT ln(any_value(t.n)) - sum(c.n * ln(c.n)) / any_value(t.n) FROM c, t) AS hc, (SELECT sum(n * (n - 1) / 2) FROM a) AS pa, (SELECT sum(n * (n - 1) / 2) FROM b) AS pb, (SELECT sum(n * (n - 1) / 2) FROM c) AS pc) SELECT round(2 * (ha + hb - hc) / (ha + hb), 8) AS nmi, round((pc - pa * pb / (n * (n - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (n * (n - 1) / 2)), 8) AS ari, round((2 * hc - ha - hb) / ln(2), 8) AS vi FROM h")
def nmi_ari_vi(spark, d):
    return E.partition_metrics(table(spark, d, "labels"), "quality", "toxic").select(*[F.round(c, 8).alias(c) for c in ("nmi", "ari", "vi")])


@query("contingency", "SELECT quality AS a, toxic AS b, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1, 2")
def contingency(spark, d):
    return E.contingency(table(spark, d, "labels"), "quality", "toxic")


@query("kendall_tau", "WITH s AS (SELECT s_suppkey AS k, s_nationkey AS x, s_acctbal AS y FROM supplier), p AS (SELECT sign(a.x - b.x) AS dx, sign(a.y - b.y) AS dy FROM s a JOIN s b ON a.k < b.k) SELECT 's_nationkey' AS a, 's_acctbal' AS b, round(sum(dx * dy) / sqrt(CAST(count(*) FILTER (WHERE dx <> 0) AS DOUBLE) * count(*) FILTER (WHERE dy <> 0)), 8) AS tau FROM p")
def kendall_tau(spark, d):
    return E.kendall_matrix(table(spark, d, "supplier"), ["s_nationkey", "s_acctbal"], "s_suppkey").withColumn("tau", F.round("tau", 8))


@query("calibration10", "WITH r AS (SELECT o_orderkey, o_totalprice AS s, o_orderstatus = 'F' AS hit, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rn, count(*) OVER () AS n FROM orders) SELECT CAST(ceil(10.0 * rn / n) - 1 AS INTEGER) AS bin, count(*) AS n, round(min(s), 4) AS low, round(quantile_cont(s, 0.5), 4) AS median, round(max(s), 4) AS high, round(avg(CAST(hit AS INTEGER)), 8) AS rate FROM r GROUP BY 1")
def calibration10(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("s"), (F.col("o_orderstatus") == "F").alias("hit"))
    c = E.calibration(o, "s", "hit", ["o_orderkey"])
    return c.select("bin", "n", *[F.round(x, 4).alias(x) for x in ("low", "median", "high")], F.round("rate", 8).alias("rate"))


_PRED = f"WITH {ITEMS}, g AS (SELECT cust AS x, grp AS y, count(*) AS n FROM items WHERE year <= 1998 GROUP BY 1, 2), p AS (SELECT x, y, row_number() OVER (PARTITION BY x ORDER BY n DESC, y) AS rank FROM g), t AS (SELECT DISTINCT cust AS x, grp AS y FROM items WHERE year > 1998)"


@query("precision_at_k", _PRED + ", top AS (SELECT p.x, CASE WHEN t.x IS NULL THEN 0 ELSE 1 END AS hit FROM p LEFT JOIN t ON p.x = t.x AND p.y = t.y WHERE rank <= 2), per AS (SELECT x, sum(hit) AS h, count(*) AS n FROM top GROUP BY x), a AS (SELECT count(*) AS n FROM t WHERE x IN (SELECT x FROM per)) SELECT CAST(2 AS INTEGER) AS k, CAST(sum(h) AS BIGINT) AS hits, CAST(sum(per.n) AS BIGINT) AS predictions, round(sum(h) / sum(per.n), 8) AS micro, round(avg(h / per.n), 8) AS macro, round(sum(h) / any_value(a.n), 8) AS recall FROM per, a")
def precision_at_k(spark, d):
    from ..operators.relational import top_per_group

    i = items(spark, d)
    g = i.where("year <= 1998").groupBy(F.col("cust").alias("x"), F.col("grp").alias("y")).agg(F.count("*").alias("n"))
    p = top_per_group(g, ["x"], [F.desc("n"), F.col("y")], 2).select("x", "y", "rank")
    t = i.where("year > 1998").select(F.col("cust").alias("x"), F.col("grp").alias("y")).distinct()
    return E.precision(p, t, 2).select("k", "hits", "predictions", *[F.round(c, 8).alias(c) for c in ("micro", "macro", "recall")])


def _partners(spark, d):
    """Pairs (x, y), both ways, of vectors' parts that share an order up to 1998, and those that share one later only; both written, as they are read many times."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.year("o_orderdate") > 1998).alias("late")).where(F.year("o_orderdate").between(1900, 2100))
    known = _emb(spark, d).select(F.col("vec_id").alias("l_partkey"))
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(known, "l_partkey").distinct().join(o, "l_orderkey")
    li = materialize(li, "dated-parts")
    both = li.select("l_orderkey", "late", F.col("l_partkey").alias("x")).join(li.select("l_orderkey", F.col("l_partkey").alias("y")), "l_orderkey").where("x <> y")
    pairs = materialize(both.groupBy("x", "y").agg(F.bool_and("late").alias("late")), "partners")
    return pairs.where("NOT late").select("x", "y"), pairs.where("late").select("x", "y")


@query("phantom_eval")
def phantom_eval(spark, d):
    """Similar parts that share no order up to 1998, against those that share one later; drawn baselines beside them."""
    e = _emb(spark, d)
    near = S.neighbours(e, "vec_id", "embedding", 20)
    met, later = _partners(spark, d)
    weight = met.groupBy(F.col("x").alias("node")).agg(F.count("*").alias("weight"))
    out = E.phantom_evaluation(near, met, later, (5, 10), weight, e.select(F.col("vec_id").alias("node"), F.col("label").alias("group")))
    return out.select("method", "k", "hits", "predictions", F.round("micro", 6).alias("micro"), F.round("macro", 6).alias("macro"), F.round("lift", 6).alias("lift"))


_TOK = "t AS (SELECT lang, list_filter(regexp_extract_all(lower(text), '([A-Za-z][A-Za-z\\-]{2,})', 1), lambda w: w NOT IN (" + ", ".join(f"'{w}'" for w in M.STOP) + ")) AS w FROM documents WHERE lang IS NOT NULL), terms AS (SELECT lang, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM t), c AS (SELECT lang, term, count(*) AS tf FROM terms GROUP BY lang, term)"


def _counts(spark, d):
    docs = table(spark, d, "documents").where(F.col("lang").isNotNull())
    return M.one_and_two_counts(docs, "lang", M.tokens(F.col("text")))


@query("tfidf_terms", f"WITH {_TOK}, df AS (SELECT term, count(*) AS df FROM c GROUP BY term HAVING count(*) >= 2 AND count(*) <= 3), r AS (SELECT c.lang, c.term, tf * (ln(5.0 / (df + 1)) + 1) AS w FROM c JOIN df ON c.term = df.term), l AS (SELECT lang, sqrt(sum(w * w)) AS l FROM r GROUP BY lang), k AS (SELECT r.lang, term, w / l AS weight, row_number() OVER (PARTITION BY r.lang ORDER BY round(w / l, 9) DESC, term) AS rank FROM r JOIN l ON r.lang = l.lang) SELECT lang, term, round(weight, 8) AS weight FROM k WHERE rank <= 24")
def tfidf_terms(spark, d):
    from ..operators.relational import top_per_group

    w = M.tfidf(_counts(spark, d), 4, "lang", 2, 0.75)
    return top_per_group(w, ["lang"], [F.desc(F.round("weight", 9)), F.col("term")], 24).select("lang", "term", F.round("weight", 8).alias("weight"))


@query("tfidf_labels")
def tfidf_labels(spark, d):
    w = M.tfidf(_counts(spark, d), 4, "lang", 2, 0.75)
    return M.group_labels(w.withColumn("weight", F.round("weight", 9)), "lang").select("lang", F.concat_ws(",", "labels").alias("labels"))


_CONCEPT = "c AS (SELECT l_suppkey AS doc, p_name AS term, count(*) AS tf FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), n AS (SELECT count(DISTINCT doc) AS n FROM c)"


@query("concept_idf", f"WITH {_CONCEPT} SELECT term, count(*) AS df, round(ln((1.0 + any_value(n)) / (1 + count(*))) + 1, 8) AS idf FROM c, n GROUP BY term")
def concept_idf(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", F.col("p_name").alias("term"))
    n = rows.select("l_suppkey").distinct().count()
    return M.idf(rows, "l_suppkey", "term", n).select("term", "df", F.round("idf", 8).alias("idf"))


@query("tfidf_sublinear", f"WITH {_CONCEPT}, df AS (SELECT term, count(*) AS df FROM c, n GROUP BY term HAVING count(*) >= 2 AND count(*) <= any_value(n) * 0.95), r AS (SELECT doc, c.term, (1 + ln(tf)) * (ln((1.0 + n) / (df + 1)) + 1) AS w FROM c JOIN df ON c.term = df.term, n), l AS (SELECT doc, sqrt(sum(w * w)) AS l FROM r GROUP BY doc) SELECT r.doc, term, round(w / l, 8) AS weight FROM r JOIN l ON r.doc = l.doc")
def tfidf_sublinear(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    c = M.term_counts(rows.withColumnRenamed("l_suppkey", "doc"), "doc", F.array("p_name"))
    n = c.select("doc").distinct().count()
    return M.tfidf(c, n, "doc", 2, 0.95, sublinear=True).select("doc", "term", F.round("weight", 8).alias("weight"))


@query("svd_documents")
def svd_documents(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    c = M.term_counts(rows.withColumnRenamed("l_suppkey", "doc"), "doc", F.array("p_name"))
    w = M.tfidf(c, c.select("doc").distinct().count(), "doc", 1, 1.0)
    return M.truncated_svd(w, "doc", 4).select("doc", F.posexplode("coordinates").alias("i", "x")).withColumn("x", F.round("x", 6))


@query("same_group_pool", "WITH g AS (SELECT s_suppkey AS node, s_nationkey AS grp FROM supplier), near AS (SELECT DISTINCT a.l_suppkey AS x, b.l_suppkey AS y FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey) SELECT DISTINCT a.node AS x, b.node AS y FROM g a JOIN g b ON a.grp = b.grp AND a.node <> b.node WHERE (a.node, b.node) NOT IN (SELECT (x, y) FROM near)")
def same_group_pool(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("group"))
    li = table(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey")).distinct()
    near = li.select("l_orderkey", F.col("l_suppkey").alias("x")).join(li.select("l_orderkey", F.col("l_suppkey").alias("y")), "l_orderkey").where("x <> y").select("x", "y").distinct()
    return E.shared_group_pool(s, near)


@query("cosine_by_label", f"WITH {_UNIT}, x AS (SELECT label, unnest(v) AS x, unnest(range(0, len(v))) AS i FROM u), s AS (SELECT label, i, sum(x) AS s FROM x GROUP BY label, i), n AS (SELECT label, count(*) AS n FROM u GROUP BY label), q AS (SELECT s.label, any_value(n) AS n, (sum(s * s) - any_value(n)) / (any_value(n) * (any_value(n) - 1)) AS inside FROM s JOIN n ON s.label = n.label GROUP BY s.label HAVING any_value(n) > 1), t AS (SELECT i, sum(s) AS t FROM s GROUP BY i), a AS (SELECT (SELECT sum(n) FROM n) AS n, (SELECT sum(t * t) FROM t) AS tt) SELECT q.label, q.n, round(inside, 6) AS inside, round((SELECT (sum(s.s * (t.t - s.s))) FROM s JOIN t ON s.i = t.i WHERE s.label = q.label) / (q.n * ((SELECT n FROM a) - q.n)), 6) AS outside FROM q")
def cosine_by_label(spark, d):
    """The mean cosine of vectors to others of their label and to those of other labels, from sums of unit vectors: no pairs are made."""
    return S.mean_cosines(_emb(spark, d), "label", "embedding").select("label", "n", F.round("inside", 6).alias("inside"), F.round("outside", 6).alias("outside"))


@query("pair_drilldown", f"WITH {_KNN}, {_CHAIN} SELECT p.vec_id AS x, q.vec_id AS y, round(list_sum(list_transform(range(1, len(p.v) + 1), lambda i: p.v[i] * q.v[i])), 6) AS cosine, (SELECT d FROM dist WHERE x = 7 AND y = 9) AS d, (SELECT CAST(count(*) + 1 AS BIGINT) FROM s WHERE x = 7 AND (s.s > (SELECT s FROM s WHERE x = 7 AND y = 9) OR (s.s = (SELECT s FROM s WHERE x = 7 AND y = 9) AND s.y < 9))) AS rank FROM u p, u q WHERE p.vec_id = 7 AND q.vec_id = 9")
def pair_drilldown(spark, d):
    """Two members: their cosine, their distance on the graph, and the place of one among the other's neighbours."""
    return S.drilldown(_emb(spark, d), "vec_id", "embedding", 7, 9, _chain(spark, d), 2).select("x", "y", F.round("cosine", 6).alias("cosine"), "d", "rank")


@query("reviewer_centroids", "WITH w AS (SELECT v.vec_id, v.label, (1.0 + ln(1 + vec_id)) * pow(0.5, greatest(0, 2000 - (1990 + vec_id % 12)) / 6.0) / (1 + vec_id % 4) AS w, embedding FROM embeddings v), e AS (SELECT label, w, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS i FROM w) SELECT label, i, round(sum(w * CAST(x AS DOUBLE)) / sum(w), 8) AS m FROM e GROUP BY label, i")
def reviewer_centroids(spark, d):
    """Centroids weighted by damped count, recency and the share of each of the kept authors."""
    from ..functions.text import damped_weight, recency_weight

    k = F.col("vec_id")
    weight = damped_weight(k) * recency_weight((F.lit(1990) + k % 12).cast("int"), 2000) / (1 + k % 4)
    c = S.centroids(_emb(spark, d), ["label"], "embedding", weight)
    return c.select("label", F.posexplode("centroid").alias("i", "m")).select("label", F.col("i").cast("long").alias("i"), F.round("m", 8).alias("m"))


@query("period_centroids", "WITH p AS (SELECT label, CAST(floor((1985 + vec_id % 30) / 5.0) * 5 AS INTEGER) AS period, vec_id, embedding FROM embeddings), b AS (SELECT label, period FROM p WHERE period <= 2005 GROUP BY 1, 2 HAVING count(*) >= 2), k AS (SELECT label FROM b GROUP BY label HAVING count(*) >= 2), e AS (SELECT p.label, p.period, 1.0 + ln(1 + vec_id) AS w, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS i FROM p JOIN b ON p.label = b.label AND p.period = b.period WHERE p.label IN (SELECT label FROM k)) SELECT label, period, i, round(sum(w * CAST(x AS DOUBLE)) / sum(w), 8) AS m FROM e GROUP BY label, period, i")
def period_centroids(spark, d):
    """Centroids of five-year bins up to 2005 with two rows or more, of labels with two such bins or more."""
    from ..functions.text import damped_weight, year_bin

    rows = _emb(spark, d).withColumn("period", year_bin((F.lit(1985) + F.col("vec_id") % 30).cast("int")))
    c = S.period_centroids(rows, "label", "period", "embedding", damped_weight(F.col("vec_id")), 2005)
    return c.select("label", "period", F.posexplode("centroid").alias("i", "m")).select("label", "period", F.col("i").cast("long").alias("i"), F.round("m", 8).alias("m"))


@query("positional_join", "WITH p AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem GROUP BY l_partkey) SELECT count(vec_id) AS found, count(*) - count(vec_id) AS missing, CAST(sum(CASE WHEN vec_id IS NOT NULL THEN n END) AS BIGINT) AS rows FROM p LEFT JOIN embeddings ON vec_id = k")
def positional_join(spark, d):
    """Keys to vectors; those without one are left out and counted."""
    p = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.count("*").alias("n"))
    j = p.join(_emb(spark, d).select(F.col("vec_id").alias("k"), F.lit(True).alias("has")), "k", "left")
    return j.agg(F.count("has").alias("found"), F.count_if(F.col("has").isNull()).alias("missing"), F.sum(F.when(F.col("has"), F.col("n"))).alias("rows"))


@query("cosine_histograms")
def cosine_histograms(spark, d):
    """Cosines of hash-drawn pairs before and after whitening: counts in 20 bins, and the medians."""
    e = _emb(spark, d)
    white = S.apply_matrix(e, "embedding", S.fit_whitening(e, "embedding"), "white")
    both = S.cosine_histogram(e, "vec_id", "embedding", 20_000).withColumn("stage", F.lit("before")).unionByName(S.cosine_histogram(white, "vec_id", "white", 20_000).withColumn("stage", F.lit("after")))
    return both.select("stage", "bin", "n", F.round("median", 6).alias("median"))


@query("feature_ablation")
def feature_ablation(spark, d):
    """Whole vectors, whitened ones and their first half against one set of draws."""
    e = _emb(spark, d)
    white = S.apply_matrix(e, "embedding", S.fit_whitening(e, "embedding"), "white")
    near = lambda df, v: S.neighbours(df, "vec_id", v, 10)
    configs = {"whole": near(e, "embedding"), "white": near(white, "white"), "half": near(e.withColumn("half", F.slice("embedding", 1, 32)), "half")}
    met, later = _partners(spark, d)
    return E.ablation(configs, met, later, (5,)).select("method", "k", "hits", "predictions", F.round("micro", 6).alias("micro"), F.round("lift", 6).alias("lift"))


@query("stays_until", f"WITH p AS (SELECT user_id, CAST(floor((day(ts) - 1) / 5) AS INTEGER) AS period FROM events), d AS (SELECT DISTINCT user_id, period FROM p WHERE period <= 3) SELECT user_id, count(*) AS bins, count(*) >= 3 AS rich FROM d GROUP BY user_id HAVING count(*) >= 2")
def stays_until(spark, d):
    """Periods up to a last one: members with two or more, and whether three are there for a shape."""
    p = table(spark, d, "events").select("user_id", F.floor((F.dayofmonth("ts") - 1) / 5).cast("int").alias("period")).where("period <= 3").distinct()
    return p.groupBy("user_id").agg(F.count("*").alias("bins")).where("bins >= 2").withColumn("rich", F.col("bins") >= 3)


@query(
    "typology",
    f"""WITH {_BINS}, s AS (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS seg FROM p WINDOW w AS (PARTITION BY user_id ORDER BY period)), g AS (SELECT user_id, count(*) AS bins, coalesce(sum(seg), 0) AS path FROM s GROUP BY user_id),
m AS (SELECT user_id, bins, path, CASE WHEN bins >= 3 THEN CASE WHEN path < 15 THEN 'Stayer' ELSE 'Mover' END END AS one, CASE WHEN bins = 2 THEN CASE WHEN path < 5 THEN 'Stayer' ELSE 'Mover' END END AS two FROM g)
SELECT user_id, coalesce(one, two, 'Stayer') AS mover, CASE WHEN one IS NOT NULL THEN 'shape' WHEN two IS NOT NULL THEN 'bins' ELSE 'none' END AS mover_source FROM m""",
)
def typology(spark, d):
    """Mover or stayer: by the whole path, else by two bins, else a stayer; with where it came from."""
    p = table(spark, d, "events").groupBy("user_id", F.floor((F.dayofmonth("ts") - 1) / 5).cast("int").alias("period")).agg(F.avg("value").alias("x"), F.count("*").alias("y"))
    return S.movers(p, "user_id", "period", "x", "y").select("user_id", "mover", "mover_source")


@query(
    "community_terms",
    "WITH t AS (SELECT DISTINCT s_nationkey AS community, p_partkey, lower(p_name) AS title FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey), w AS (SELECT community, unnest(regexp_extract_all(title, '([A-Za-z][A-Za-z\\-]{2,})', 1)) AS term FROM t) SELECT community, term, count(*) AS tf FROM w WHERE term NOT IN (" + ", ".join(f"'{w}'" for w in M.STOP) + ") GROUP BY community, term",
)
def community_terms(spark, d):
    """Terms of communities, where a title enters once a paper and community."""
    j = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    once = j.select(F.col("s_nationkey").alias("community"), "p_partkey", "p_name").distinct()
    return M.term_counts(once, "community", M.tokens(F.col("p_name")))
