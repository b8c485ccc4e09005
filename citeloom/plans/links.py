"""Queries of the linkage operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import linkage as L
from .base import PARTS, members, query, table


@query("alias_shared_id", "WITH k AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'a' ELSE 'n' END || c_custkey AS key, c_custkey % 400 AS ext, count(o_orderkey) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey), b AS (SELECT ext, arg_max(key, (n, CAST(starts_with(key, 'a') AS INTEGER), key)) AS canonical FROM k GROUP BY ext HAVING count(*) > 1) SELECT key, canonical FROM k JOIN b ON k.ext = b.ext WHERE key <> canonical")
def alias_shared_id(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select(F.concat(F.when(F.col("c_custkey") % 2 == 0, "a").otherwise("n"), F.col("c_custkey").cast("string")).alias("key"), (F.col("c_custkey") % 400).alias("orcid"))
    return L.shared_id_aliases(rows)


_LINKS = "links AS (SELECT DISTINCT l_partkey AS key, l_suppkey AS other FROM lineitem), names AS (SELECT p_partkey AS key, p_name AS name, p_brand AS brand FROM part), size AS (SELECT key, count(*) AS n FROM links GROUP BY key), shared AS (SELECT x.key AS a, y.key AS b, count(*) AS shared FROM links x JOIN names nx ON x.key = nx.key JOIN names ny ON nx.name = ny.name JOIN links y ON y.key = ny.key AND y.other = x.other WHERE x.key < y.key AND x.other <> x.key AND x.other <> y.key GROUP BY 1, 2 HAVING count(*) >= 3), pairs AS (SELECT a, b, shared, shared / (least(p.n, q.n) - CASE WHEN EXISTS (SELECT 1 FROM links l WHERE l.key = a AND l.other = b) THEN 1 ELSE 0 END) AS overlap FROM shared JOIN size p ON p.key = a JOIN size q ON q.key = b)"


def _overlaps(spark, d):
    links = table(spark, d, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_suppkey").alias("other")).distinct()
    names = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"))
    return L.overlap_pairs(links, names, 3, 0.2)


@query("alias_overlap", f"WITH {_LINKS} SELECT a, b, shared, round(overlap, 9) AS overlap FROM pairs WHERE overlap >= 0.2")
def alias_overlap(spark, d):
    return _overlaps(spark, d).withColumn("overlap", F.round("overlap", 9))


@query("alias_candidates", f"WITH {_LINKS}, e AS (SELECT p_partkey AS key, CASE WHEN p_size % 3 = 0 THEN p_size END AS ext FROM part), j AS (SELECT a, b, shared, overlap FROM pairs JOIN e p ON p.key = a JOIN e q ON q.key = b WHERE p.ext IS NULL OR q.ext IS NULL OR p.ext = q.ext) SELECT a, b, shared, round(overlap, 9) AS overlap FROM j ORDER BY shared DESC, a, b LIMIT 200")
def alias_candidates(spark, d):
    links = table(spark, d, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_suppkey").alias("other")).distinct()
    names = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("surname"), F.substring("p_name", 1, 1).alias("initial"), F.when(F.col("p_size") % 3 == 0, F.col("p_size")).alias("external"))
    return L.alias_candidates(links, names, 3, 200).withColumn("overlap", F.round("overlap", 9))


@query("alias_chain", "WITH RECURSIVE m AS (SELECT c_custkey AS key, CAST(c_custkey // 3 AS BIGINT) AS canonical FROM customer), r AS (SELECT key, canonical FROM m WHERE key <> canonical UNION ALL SELECT r.key, m.canonical FROM r JOIN m ON r.canonical = m.key WHERE m.key <> m.canonical) SELECT key, canonical FROM r WHERE canonical NOT IN (SELECT key FROM m WHERE key <> canonical)")
def alias_chain(spark, d):
    c = table(spark, d, "customer")
    return L.resolve_chains(c.select(F.col("c_custkey").alias("key"), F.floor(F.col("c_custkey") / 3).alias("canonical")))


@query("fuzzy_title_pairs", "WITH t AS (SELECT p_partkey AS key, p_size AS block, p_name || ' ' || p_brand AS title FROM part) SELECT x.key AS a, y.key AS b, CAST(levenshtein(x.title, y.title) AS INTEGER) AS distance FROM t x JOIN t y ON x.block = y.block AND x.key < y.key WHERE levenshtein(x.title, y.title) <= 2")
def fuzzy_title_pairs(spark, d):
    t = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").alias("block"), F.concat("p_name", F.lit(" "), "p_brand").alias("title"))
    return L.similar_titles(t, ["block"], "key", "title", 2)


@query("fuzzy_clusters")
def fuzzy_clusters(spark, d):
    """Greedy clusters of part titles within size and type."""
    t = table(spark, d, "part").select(F.col("p_partkey").alias("key"), "p_size", "p_type", T.norm_title(F.concat("p_name", F.lit(" "), "p_brand")).alias("title"), F.array("p_type").alias("names"))
    return L.greedy_clusters(t, ["p_size", "p_type"], "key", "title", "names", "key", 90.0)


@query("key_audit", f"WITH {PARTS}, n AS (SELECT member AS key, count(*) AS n FROM parts GROUP BY member), k AS (SELECT n.key, p_brand AS surname, list_filter(string_split(p_name, ' '), lambda x: length(x) >= 2) AS given, n.n, p_size FROM n JOIN part ON n.key = p_partkey WHERE n.n >= 3) SELECT DISTINCT a.key AS name_key, b.key AS id_key FROM k a JOIN k b ON a.surname = b.surname AND list_has_any(a.given, b.given) WHERE a.p_size % 10 < 5 AND b.p_size % 10 >= 5")
def key_audit(spark, d):
    n = members(spark, d, "l_partkey").groupBy(F.col("member").alias("key")).agg(F.count("*").alias("n"))
    k = n.join(table(spark, d, "part"), F.col("key") == F.col("p_partkey")).select("key", F.col("p_brand").alias("surname"), F.split("p_name", " ").alias("given"), "n", "p_size")
    return L.split_suspects(k.where("p_size % 10 < 5"), k.where("p_size % 10 >= 5"))


@query("doi_split", "SELECT c_custkey % 3 <> 0 AS has_doi, count(*) AS n FROM customer GROUP BY 1")
def doi_split(spark, d):
    """Records with and without an identifier."""
    doi = T.norm_doi(F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("https://doi.org/10.7/"), F.col("c_custkey").cast("string"))).otherwise("nan"))
    return table(spark, d, "customer").groupBy(doi.isNotNull().alias("has_doi")).agg(F.count("*").alias("n"))


@query(
    "records_by_doi",
    """WITH r AS (SELECT o_orderkey AS seq, 'doi:10.1/x' || o_custkey AS paper_id, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(floor(o_totalprice / 1000) AS BIGINT) END AS c, o_orderkey % 2 AS src FROM orders)
SELECT paper_id, arg_min(c, src * 10000000000 + seq) FILTER (WHERE c IS NOT NULL) AS cited_by_count, count(*) AS records FROM r GROUP BY paper_id""",
)
def records_by_doi(spark, d):
    """Raw records to papers: one a DOI, counts filled from later records, and how many records each has."""
    o = table(spark, d, "orders")
    k = F.col("o_custkey").cast("string")
    author = F.struct(F.concat(F.lit("A"), k).alias("id"), F.concat(F.lit("Writer Number"), F.translate(k, "0123456789", "abcdefghij")).alias("name"), F.lit(None).cast("string").alias("orcid"), F.lit(None).cast("string").alias("position"), F.array().cast("array<string>").alias("institutions"))
    raw = o.select(
        F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderkey") % 2 == 0, "one").otherwise("two").alias("_source"),
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("10.1/X"), k)).otherwise(F.concat(F.lit("10.1/x"), k)).alias("doi"),
        F.concat(F.lit("A study of customer "), k).alias("title"),
        F.year("o_orderdate").alias("year"),
        F.col("o_orderpriority").alias("venue_slug"),
        F.when(F.col("o_orderkey") % 4 != 0, F.floor(F.col("o_totalprice") / 1000)).alias("cited_by_count"),
        F.lit(None).cast("string").alias("abstract"),
        F.array(author).alias("authors"),
        F.array().cast("array<string>").alias("concepts"),
    )
    papers = L.dedupe_records(raw, F.when(F.col("_source") == "one", 0).otherwise(1))["papers"]
    n = raw.groupBy(F.concat(F.lit("doi:"), F.lower("doi")).alias("id")).agg(F.count("*").alias("records"))
    return papers.select(F.lower("paper_id").alias("paper_id"), "cited_by_count").join(n, F.col("paper_id") == F.col("id")).drop("id")
