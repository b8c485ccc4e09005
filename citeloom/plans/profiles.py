"""Queries of member profiles, reports, pages and record shaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records as C
from ..functions import text as T
from ..operators import profiles as P
from ..operators import relational as R
from ..sources.tables import shuffle_parts
from .base import ITEMS, MEMBERS, items, members, query, table


@query("longest_name", "SELECT c_nationkey, arg_max(c_name || repeat('x', CAST(c_custkey % 4 AS INTEGER)), length(c_name || repeat('x', CAST(c_custkey % 4 AS INTEGER))) * 100000000 - c_custkey) AS name FROM customer GROUP BY c_nationkey")
def longest_name(spark, d):
    c = table(spark, d, "customer").select("c_nationkey", "c_custkey", F.concat("c_name", F.repeat(F.lit("x"), (F.col("c_custkey") % 4).cast("int"))).alias("name"))
    return P.longest_name(c, "c_nationkey", "name", "c_custkey")


_ENTRIES = ITEMS + ", entries AS (SELECT l_orderkey AS item, l_suppkey AS member, i.year, i.cites FROM lineitem JOIN items i ON l_orderkey = i.item)"


def _entries(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_suppkey").alias("member"))
    o = items(spark, d).select("item", "year", "cites")
    return li.repartition(shuffle_parts(li.join(o, "item")), "item").join(o, "item")  # lies by item, as the counters want it


@query(
    "member_counters",
    f"""WITH {_ENTRIES}, o AS (SELECT DISTINCT item, member, cites FROM entries), t AS (SELECT item, count(*) AS team FROM o GROUP BY item),
e AS (SELECT member, count(*) AS entries, max(year) AS last_year, CAST(sum(cites) AS BIGINT) AS count_all FROM entries GROUP BY member),
s AS (SELECT member, CAST(sum(CASE WHEN team > 1 THEN cites ELSE 0 END) AS BIGINT) AS count_shared, count(*) FILTER (WHERE team = 1) AS alone FROM o JOIN t ON o.item = t.item GROUP BY member)
SELECT e.member, entries, last_year, count_all, count_shared, alone FROM e JOIN s ON e.member = s.member""",
)
def member_counters(spark, d):
    return P.member_counters(_entries(spark, d), "item", "member", "year", "cites")


@query(
    "team_sizes",
    f"""WITH {MEMBERS}, t AS (SELECT l_orderkey AS item, count(*) AS n FROM lineitem GROUP BY l_orderkey)
SELECT member, count(*) AS items, round(avg(greatest(1, n)), 9) AS mean_team FROM members JOIN t ON members.item = t.item GROUP BY member""",
)
def team_sizes(spark, d):
    entries = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("item"))
    return P.team_sizes(members(spark, d), entries, "item", "member").withColumn("mean_team", F.round("mean_team", 9))


@query("value_summary", "SELECT count(*) AS n, round(avg(s_acctbal), 6) AS mean, round(quantile_cont(s_acctbal, 0.5), 6) AS median, round(count(*) FILTER (WHERE s_acctbal > 4500) / count(*), 9) AS above FROM supplier")
def value_summary(spark, d):
    out = P.summary(table(spark, d, "supplier"), "s_acctbal", 4500)
    return out.select("n", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), F.round("above", 9).alias("above"))


_PRIORITIES = ["5-LOW", "1-URGENT", "3-MEDIUM", "none of these", "2-HIGH", "4-NOT SPECIFIED"]


@query(
    "class_medians",
    f"""WITH c AS (SELECT unnest(range(0, 6)) AS place, unnest({_PRIORITIES!r}) AS o_orderpriority), m AS (SELECT o_orderpriority, count(*) AS n, quantile_cont(o_totalprice, 0.5) AS mp, quantile_cont(CAST(o_custkey AS DOUBLE), 0.5) AS mc FROM orders GROUP BY o_orderpriority)
SELECT CAST(place AS INTEGER) AS place, c.o_orderpriority, coalesce(n, 0) AS n, round(mp, 4) AS median_o_totalprice, round(mc, 4) AS median_o_custkey FROM c LEFT JOIN m ON c.o_orderpriority = m.o_orderpriority""",
)
def class_medians(spark, d):
    out = P.class_medians(table(spark, d, "orders"), "o_orderpriority", ["o_totalprice", "o_custkey"], _PRIORITIES)
    return out.select("place", "o_orderpriority", "n", *[F.round(c, 4).alias(c) for c in ("median_o_totalprice", "median_o_custkey")])


@query("yearless_training", "SELECT event_id FROM events WHERE (value IS NULL OR event_id % 9 = 0 OR CAST(floor(value) AS BIGINT) <= 40) AND event_id % 11 <> 0")
def yearless_training(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 9 != 0, F.floor("value")).alias("year"), F.when(F.col("event_id") % 11 != 0, F.col("event_type")).otherwise(F.lit("  ")).alias("text"))
    return P.training_rows(e, "year", "text", 40).select("event_id")


_NEWEST = f"WITH {ITEMS}, r AS (SELECT item, year, cites, row_number() OVER (ORDER BY year DESC NULLS LAST, cites DESC NULLS LAST, item) AS position FROM (SELECT item, CASE WHEN item % 13 <> 0 THEN year END AS year, CASE WHEN item % 7 <> 0 THEN cites END AS cites FROM items))"


def _some_missing(spark, d):
    return items(spark, d).select("item", F.when(F.col("item") % 13 != 0, F.col("year")).alias("year"), F.when(F.col("item") % 7 != 0, F.col("cites")).alias("cites"))


@query("newest_first", _NEWEST + " SELECT item, year, cites, position FROM r")
def newest_first(spark, d):
    from ..operators.ordering import global_row_number

    return global_row_number(_some_missing(spark, d), [F.desc_nulls_last("year"), F.desc_nulls_last("cites"), F.col("item")], "position")


@query("explorer_page", _NEWEST + " SELECT item, year, cites, position FROM r WHERE position BETWEEN 101 AND 150")
def explorer_page(spark, d):
    """The third page of 50."""
    return P.page(_some_missing(spark, d), [F.desc_nulls_last("year"), F.desc_nulls_last("cites"), F.col("item")], 3, 50)


@query("people_order", "SELECT c_custkey, c_name, CAST(row_number() OVER (ORDER BY floor(c_acctbal / 100) DESC, c_name) AS BIGINT) AS position FROM customer")
def people_order(spark, d):
    from ..operators.ordering import global_row_number

    c = table(spark, d, "customer").select("c_custkey", "c_name", F.floor(F.col("c_acctbal") / 100).alias("cites"))
    return global_row_number(c, [F.desc("cites"), F.col("c_name")], "position").drop("cites")


@query(
    "reindex_kept",
    """WITH k AS (SELECT l_partkey AS member, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_orderkey) >= 30), i AS (SELECT member, row_number() OVER (ORDER BY member) - 1 AS idx FROM k),
r AS (SELECT DISTINCT l_suppkey AS owner, l_partkey AS member FROM lineitem) SELECT r.owner, count(*) AS kept, md5(string_agg(CAST(idx AS VARCHAR), ',' ORDER BY idx)) AS indexes_md5 FROM r JOIN i ON r.member = i.member GROUP BY r.owner""",
)
def reindex_kept(spark, d):
    m = members(spark, d, "l_partkey")
    kept = m.groupBy("member").agg(F.count("*").alias("n")).where("n >= 30").select("member")
    refs = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("owner"), F.col("l_partkey").alias("ref"))
    found = P.reindex(kept, "member", refs, "owner", "ref")[1]
    return found.select("owner", F.size("indexes").cast("long").alias("kept"), F.md5(F.concat_ws(",", F.transform("indexes", lambda x: x.cast("string"))).cast("binary")).alias("indexes_md5"))


@query(
    "weighted_concepts",
    f"""WITH {ITEMS}, n AS (SELECT count(*) AS n FROM part), df AS (SELECT p_brand, count(*) AS df FROM part GROUP BY p_brand), x AS (SELECT l_suppkey AS owner, p.p_brand AS concept, (1.0 + ln(1 + i.cites)) * pow(0.5, greatest(0, 2001 - i.year) / 6.0) * (p_size / 50.0) * (ln((1.0 + n.n) / (1 + df)) + 1) AS v
FROM lineitem JOIN part p ON l_partkey = p_partkey JOIN items i ON l_orderkey = i.item JOIN df ON df.p_brand = p.p_brand, n), t AS (SELECT owner, concept, round(sum(v), 6) AS v FROM x GROUP BY owner, concept), r AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY v DESC, concept) AS rank FROM t)
SELECT owner, concept, round(v / sqrt(sum(v * v) OVER (PARTITION BY owner)), 6) AS share, CAST(rank AS INTEGER) AS rank FROM (SELECT * FROM r WHERE rank <= 12)""",
)
def weighted_concepts(spark, d):
    """Reviewer concepts: damped count, recency and idf as weights."""
    p = table(spark, d, "part")
    idf = p.groupBy("p_brand").agg(F.count("*").alias("df")).join(p.agg(F.count("*").alias("n"))).select("p_brand", (F.log((F.lit(1.0) + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))  # one row of counts
    rows = table(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).join(items(spark, d), F.col("l_orderkey") == F.col("item")).join(idf, "p_brand")
    value = T.damped_weight(F.col("cites")) * T.recency_weight(F.col("year"), 2001) * (F.col("p_size") / 50.0) * F.col("idf")
    rows = rows.select(F.col("l_suppkey").alias("owner"), F.col("p_brand").alias("concept"), value.alias("v"))
    total = rows.groupBy("owner", "concept").agg(F.round(F.sum("v"), 6).alias("v"))
    return P.weighted_concepts(total, "owner", "concept", F.col("v")).withColumn("share", F.round("share", 6))


@query(
    "realised_pairs",
    "WITH p AS (SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, l_extendedprice AS s, l_orderkey AS o, l_linenumber AS l FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY s DESC, o, l) AS k FROM p) SELECT a, b, s, o FROM r WHERE k = 1 ORDER BY s DESC, o, l LIMIT 20",
)
def realised_pairs(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_extendedprice").alias("s"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"))
    return P.top_pairs(rows, "a", "b", [F.desc("s"), F.col("o"), F.col("l")], 20).drop("l")


@query(
    "exemplars",
    """WITH r AS (SELECT c_mktsegment, c_custkey, c_acctbal, c_nationkey, c_custkey IN (17, 19, 23) AS named, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey DESC, c_custkey) AS k FROM customer),
f AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY named DESC, CASE WHEN named THEN k END, c_acctbal DESC, c_custkey) AS f FROM r WHERE k <= 20 OR named) SELECT c_mktsegment, c_custkey, named FROM f WHERE f = 1""",
)
def exemplars(spark, d):
    c = table(spark, d, "customer")
    return P.exemplars(c, "c_mktsegment", "c_custkey", [17, 19, 23], [F.desc("c_nationkey"), F.col("c_custkey")], [F.desc("c_acctbal"), F.col("c_custkey")]).select("c_mktsegment", "c_custkey", "named")


_AXES = {"mover": ["Stayer", "Mover"], "topical": ["Narrow", "Wide"], "bridge": ["Local", "Bridge"], "solo": ["Team", "Solo"]}


@query(
    "typology_cells",
    """WITH t AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN 'Mover' ELSE 'Stayer' END AS mover, CASE WHEN c_acctbal > 5000 THEN 'Wide' ELSE 'Narrow' END AS topical, CASE WHEN c_nationkey < 5 AND c_acctbal > 0 THEN 'Bridge' ELSE 'Local' END AS bridge, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'Solo' ELSE 'Team' END AS solo FROM customer),
f AS (SELECT * FROM (SELECT unnest(['Stayer', 'Mover']) AS mover, unnest([0, 8]) AS p1), (SELECT unnest(['Narrow', 'Wide']) AS topical, unnest([0, 4]) AS p2), (SELECT unnest(['Local', 'Bridge']) AS bridge, unnest([0, 2]) AS p3), (SELECT unnest(['Team', 'Solo']) AS solo, unnest([0, 1]) AS p4))
SELECT CAST(p1 + p2 + p3 + p4 AS INTEGER) AS place, f.mover, f.topical, f.bridge, f.solo, count(t.mover) AS n FROM f LEFT JOIN t ON f.mover = t.mover AND f.topical = t.topical AND f.bridge = t.bridge AND f.solo = t.solo GROUP BY ALL""",
)
def typology_cells(spark, d):
    """All 16 cells of four axes, empty ones with 0."""
    k = F.col("c_custkey")
    t = table(spark, d, "customer").select(
        F.when(k % 3 == 0, "Mover").otherwise("Stayer").alias("mover"),
        F.when(F.col("c_acctbal") > 5000, "Wide").otherwise("Narrow").alias("topical"),
        F.when((F.col("c_nationkey") < 5) & (F.col("c_acctbal") > 0), "Bridge").otherwise("Local").alias("bridge"),
        F.when((k % 3 == 0) & (k % 2 == 0), "Solo").otherwise("Team").alias("solo"),
    )
    return P.cells(t, _AXES)


@query("input_coverage", "SELECT what, n FROM (SELECT count(*) AS a, count(*) FILTER (WHERE value IS NULL) AS b, count(*) FILTER (WHERE event_type = 'click') AS c, count(*) FILTER (WHERE props IS NULL OR props = '') AS e FROM events), LATERAL (VALUES ('all', a), ('no_value', b), ('clicks', c), ('no_props', e)) v(what, n)")
def input_coverage(spark, d):
    return P.coverage(table(spark, d, "events"), {"no_value": F.col("value").isNull(), "clicks": F.col("event_type") == "click", "no_props": T.missing_text(F.col("props"))})


@query(
    "duplicates_by_group",
    """WITH r AS (SELECT event_type AS grp, count(*) AS raw FROM events GROUP BY event_type), k AS (SELECT grp, count(*) AS kept FROM (SELECT user_id, min(event_type) AS grp FROM events GROUP BY user_id) GROUP BY grp), b AS (SELECT r.grp, raw, coalesce(kept, 0) AS kept FROM r LEFT JOIN k ON r.grp = k.grp),
a AS (SELECT * FROM b UNION ALL SELECT 'TOTAL', CAST(sum(raw) AS BIGINT), CAST(sum(kept) AS BIGINT) FROM b) SELECT grp, raw, kept, round(100 * (1 - kept / raw), 2) AS dup_pct FROM a""",
)
def duplicates_by_group(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_type").alias("grp"))
    return P.duplicate_report(e, e.groupBy("user_id").agg(F.min("grp").alias("grp")), "grp")


@query("false_merges", "SELECT l_partkey AS key, count(DISTINCT l_orderkey) AS items, count(DISTINCT l_shipdate) AS spellings FROM lineitem WHERE l_partkey % 3 <> 0 GROUP BY l_partkey HAVING count(DISTINCT l_orderkey) >= 3 ORDER BY items DESC, key LIMIT 50")
def false_merges(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_shipdate").alias("name"), F.col("l_orderkey").alias("item"), F.when(F.col("l_partkey") % 3 != 0, "name").otherwise("id").alias("kind"))
    return P.merge_suspects(rows, "key", F.col("kind"), "name", "item", 3)


@query(
    "alias_evidence",
    """WITH x AS (SELECT s_suppkey AS a, s_suppkey + 1 AS b FROM supplier WHERE s_suppkey + 1 IN (SELECT s_suppkey FROM supplier)), v AS (SELECT DISTINCT l_suppkey AS key, l_orderkey AS v FROM lineitem), f AS (SELECT key, array_to_string(list(v ORDER BY v)[1:3], ',') AS l FROM v GROUP BY key),
l AS (SELECT DISTINCT l_suppkey AS key, l_partkey AS other FROM lineitem), w AS (SELECT a, b, array_to_string(list(p.other ORDER BY p.other)[1:5], ',') AS l FROM x JOIN l p ON p.key = a JOIN l q ON q.key = b AND q.other = p.other GROUP BY a, b)
SELECT x.a, x.b, fa.l AS a_items, fb.l AS b_items, coalesce(w.l, '') AS shared_with FROM x LEFT JOIN f fa ON fa.key = x.a LEFT JOIN f fb ON fb.key = x.b LEFT JOIN w ON w.a = x.a AND w.b = x.b""",
)
def alias_evidence(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("a"))
    pairs = s.join(s.select((F.col("a") - 1).alias("a"), F.col("a").alias("b")), "a")
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_orderkey").alias("item"), F.col("l_partkey").alias("other"))
    out = P.evidence(pairs, {"items": (li, "item", 3)}, li)
    text = lambda c: F.concat_ws(",", F.transform(c, lambda x: x.cast("string")))
    return out.select("a", "b", text("a_items").alias("a_items"), text("b_items").alias("b_items"), text("shared_with").alias("shared_with"))


@query("first_hits", "WITH h AS (SELECT c_nationkey AS owner, c_custkey AS place, CASE WHEN c_custkey % 6 = 0 THEN 'S' || c_custkey END AS v FROM customer) SELECT owner, arg_min(v, place) AS source, min(place) AS place FROM h WHERE v IS NOT NULL GROUP BY owner")
def first_hits(spark, d):
    """The source that the first of a venue's numbers with a hit leads to."""
    h = table(spark, d, "customer").select(F.col("c_nationkey").alias("owner"), F.col("c_custkey").alias("place"), F.when(F.col("c_custkey") % 6 == 0, F.concat(F.lit("S"), F.col("c_custkey").cast("string"))).alias("source"))
    return P.first_hits(h, "owner", "place", "source")


@query(
    "compact_records",
    """WITH l AS (SELECT o.o_orderkey, o.o_custkey, year(o.o_orderdate) AS y, o.o_orderpriority, o.o_totalprice, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS parts FROM orders o LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT 'W' || o_orderkey AS id, CASE WHEN o_custkey % 2 = 0 THEN '10.5/x' || o_custkey END AS doi, 'title ' || o_orderkey AS title, CAST(y AS INTEGER) AS year, o_orderpriority AS venue, CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE CAST(floor(o_totalprice) AS BIGINT) END AS cited_by_count,
'A' || o_custkey || ':Name ' || o_custkey AS people, CASE WHEN parts[1] IS NULL THEN '' ELSE array_to_string(list_transform(parts[1:8], lambda p: 'C' || p), ' ') END AS concepts FROM l""",
)
def compact_records(spark, d):
    """Nested source documents to flat records: names changed, defaults filled, concepts cut to eight."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    by_order = li.repartition(shuffle_parts(o.join(li, F.col("o_orderkey") == F.col("l_orderkey"))), "l_orderkey")
    lists = by_order.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: F.struct(F.concat(F.lit("C"), x["l_partkey"].cast("string")).alias("display_name"), F.lit(2).alias("level"), F.lit(0.5).alias("score"))).alias("concepts"))
    j = o.join(lists, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    k = F.col("o_custkey").cast("string")
    doc = F.to_json(
        F.struct(
            F.concat(F.lit("https://works.example/W"), F.col("o_orderkey").cast("string")).alias("id"),
            F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("https://doi.org/10.5/X"), k)).alias("doi"),
            F.concat(F.lit("title "), F.col("o_orderkey").cast("string")).alias("title"),
            F.year("o_orderdate").alias("publication_year"),
            F.when(F.col("o_custkey") % 3 != 0, F.floor("o_totalprice")).alias("cited_by_count"),
            F.array(F.struct(F.struct(F.concat(F.lit("https://people.example/A"), k).alias("id"), F.concat(F.lit("Name "), k).alias("display_name"), F.lit(None).cast("string").alias("orcid")).alias("author"), F.lit("first").alias("author_position"), F.array(F.struct(F.lit("Lab").alias("display_name"))).alias("institutions"))).alias("authorships"),
            "concepts",
        )
    )
    r = j.select(C.compact_record(doc, F.col("o_orderpriority")).alias("r")).select("r.*")
    return r.select("id", "doi", "title", "year", "venue", "cited_by_count", F.concat_ws(" ", F.transform("authors", lambda a: F.concat(a["id"], F.lit(":"), a["name"]))).alias("people"), F.concat_ws(" ", "concepts.name").alias("concepts"))


@query("shared_view", "SELECT o_orderkey FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998 AND floor(o_totalprice / 1000) >= 150 AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def shared_view(spark, d):
    """A filter state written as a link, read back and applied."""
    state = C.filter_of_link(C.link_of_filter({"years": (1996, 1998), "least": 150, "groups": ["1-URGENT", "2-HIGH"]}))
    return R.explore(items(spark, d), year=F.col("year"), count=F.col("cites"), group=F.col("grp"), **state).select(F.col("item").alias("o_orderkey"))


@query("names_that_start", "SELECT c_custkey, starts_with(lower(c_name), 'customer#00000000') AS starts FROM customer WHERE contains(lower(c_name), '9')")
def names_that_start(spark, d):
    low = F.lower("c_name")
    return table(spark, d, "customer").where(low.contains("9")).select("c_custkey", low.startswith("customer#00000000").alias("starts"))


@query("alias_ids", "WITH m AS (SELECT n_nationkey AS key, n_nationkey - n_nationkey % 5 AS canonical FROM nation WHERE n_nationkey % 5 <> 0) SELECT CAST(key AS INTEGER) AS id FROM m UNION SELECT CAST(canonical AS INTEGER) FROM m")
def alias_ids(spark, d):
    m = table(spark, d, "nation").where("n_nationkey % 5 <> 0").select(F.col("n_nationkey").alias("key"), (F.col("n_nationkey") - F.col("n_nationkey") % 5).alias("canonical"))
    return m.select(F.col("key").alias("id")).union(m.select("canonical")).distinct()


@query("metric_rankings", "WITH m AS (SELECT l_partkey AS node, count(*) AS papers, CAST(sum(l_quantity) AS BIGINT) AS strength, count(DISTINCT l_suppkey) AS degree FROM lineitem GROUP BY l_partkey), u AS (UNPIVOT m ON papers, strength, degree INTO NAME metric VALUE value), r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC, node) AS rank FROM u) SELECT metric, node, value, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 30")
def metric_rankings(spark, d):
    """The 30 best nodes by each metric, ties in order of node."""
    m = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("node")).agg(F.count("*").alias("papers"), F.sum("l_quantity").cast("long").alias("strength"), F.countDistinct("l_suppkey").alias("degree"))
    long = m.unpivot("node", ["papers", "strength", "degree"], "metric", "value")
    return R.top_per_group(long, ["metric"], [F.desc("value"), F.col("node")], 30)


@query("stored_tops", f"WITH {ITEMS}, t AS (SELECT grp, list(item ORDER BY cites DESC, item) AS top FROM (SELECT grp, item, cites, row_number() OVER (PARTITION BY grp ORDER BY cites DESC, item) AS r FROM items) WHERE r <= 10 GROUP BY grp) SELECT grp, array_to_string(top[1:5], ',') AS five, array_to_string(top[1:3], ',') AS three FROM t")
def stored_tops(spark, d):
    best = R.top_per_group(items(spark, d).select("grp", "item", "cites"), ["grp"], [F.desc("cites"), F.col("item")], 10)
    top = best.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda x: x["item"].cast("string")).alias("top"))  # ten a group
    return top.select("grp", F.concat_ws(",", F.slice("top", 1, 5)).alias("five"), F.concat_ws(",", F.slice("top", 1, 3)).alias("three"))


@query("shown_groups", "WITH g AS (SELECT c_nationkey AS g, count(*) AS n FROM customer GROUP BY 1), r AS (SELECT g, row_number() OVER (ORDER BY n DESC, g) AS r FROM g WHERE g <> 0) SELECT c.c_custkey, CASE WHEN r <= 12 THEN CAST(c.c_nationkey AS VARCHAR) ELSE 'grey' END AS colour FROM customer c LEFT JOIN r ON c.c_nationkey = r.g")
def shown_groups(spark, d):
    """The twelve largest groups keep their name, the misc group (0) and the rest are grey."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    best = c.where("c_nationkey <> 0").groupBy("c_nationkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "c_nationkey").limit(12).select("c_nationkey", F.col("c_nationkey").cast("string").alias("colour"))
    return c.join(F.broadcast(best), "c_nationkey", "left").select("c_custkey", F.coalesce("colour", F.lit("grey")).alias("colour"))  # 12 rows


@query("cited_after_filter", f"WITH {ITEMS} SELECT item, cites FROM items WHERE year >= 1997 ORDER BY cites DESC, item LIMIT 200")
def cited_after_filter(spark, d):
    return items(spark, d).where("year >= 1997").orderBy(F.desc("cites"), "item").limit(200).select("item", "cites")


@query("venue_dimensions", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (1, 3, 7) OR (s_suppkey % 2 = 0 AND s_acctbal IS NOT NULL AND s_acctbal > 0)")
def venue_dimensions(spark, d):
    s = table(spark, d, "supplier")
    return s.where(F.col("s_nationkey").isin(1, 3, 7) | ((F.col("s_suppkey") % 2 == 0) & F.col("s_acctbal").isNotNull() & (F.col("s_acctbal") > 0))).select("s_suppkey")
