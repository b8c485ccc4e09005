"""Queries of filters, joins, rollups, windows, rankings and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import relational as R
from ..operators.ordering import group_quantiles
from .base import ITEMS, MEMBERS, items, members, query, table


@query(
    "venue_stats",
    f"""WITH {ITEMS}, {MEMBERS}, teams AS (SELECT item, count(*) AS team FROM members GROUP BY item),
r AS (SELECT i.*, coalesce(team, 0) AS team FROM items i LEFT JOIN teams t ON i.item = t.item),
p AS (SELECT grp, count(DISTINCT member) AS members FROM members JOIN items ON members.item = items.item GROUP BY grp)
SELECT r.grp, count(*) AS items, count(*) FILTER (WHERE team = 1) AS single, round(100.0 * count(*) FILTER (WHERE team = 1) / count(*), 2) AS single_pct,
 any_value(p.members) AS members, round(avg(team) FILTER (WHERE team > 0), 3) AS mean_team, max(team) AS max_team, CAST(sum(team * (team - 1) // 2) AS BIGINT) AS pairs,
 round(count(*) / any_value(p.members), 4) AS items_per_member, round(avg(cites), 3) AS mean_count
FROM r LEFT JOIN p ON r.grp = p.grp GROUP BY r.grp""",
)
def venue_stats(spark, d):
    return R.group_stats(items(spark, d), members(spark, d), "item", "member", "grp", "cites")


_EXPLORE = """WITH e AS (SELECT o_orderkey, year(o_orderdate) AS year, floor(o_totalprice / 1000) AS cites, o_orderpriority, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey),
f AS (SELECT * FROM e WHERE year BETWEEN 1996 AND 1999 AND cites >= 100 AND o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AND (contains(lower(c_mktsegment), 'build') OR contains(lower(c_mktsegment), 'house')) AND contains(lower(c_name), '7'))"""


def _explored(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select("o_orderkey", F.year("o_orderdate").alias("year"), F.floor(F.col("o_totalprice") / 1000).alias("cites"), "o_orderpriority", "c_name", "c_mktsegment")
    return R.explore(rows, year=F.col("year"), years=(1996, 1999), count=F.col("cites"), least=100, group=F.col("o_orderpriority"), groups=("1-URGENT", "2-HIGH", "3-MEDIUM"), text=F.col("c_mktsegment"), words=("build", "house"), any_word=True, members=F.col("c_name"), member_words=("7",))


@query("explore", _EXPLORE + " SELECT o_orderkey, CAST(year AS INTEGER) AS year, CAST(cites AS BIGINT) AS cites, c_name FROM f")
def explore(spark, d):
    return _explored(spark, d).select("o_orderkey", "year", "cites", "c_name")


@query("explore_stats", _EXPLORE + " SELECT count(*) AS n, count(DISTINCT c_name) AS members, round(avg(cites), 4) AS mean_cites, CAST(max(cites) AS BIGINT) AS max_cites, CAST(min(year) AS INTEGER) AS first_year, CAST(max(year) AS INTEGER) AS last_year FROM f")
def explore_stats(spark, d):
    return _explored(spark, d).agg(F.count("*").alias("n"), F.countDistinct("c_name").alias("members"), F.round(F.avg("cites"), 4).alias("mean_cites"), F.max("cites").alias("max_cites"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


@query("by_year_counts", f"WITH {ITEMS} SELECT year, grp, count(*) AS n FROM items WHERE year BETWEEN 1990 AND 2026 GROUP BY year, grp")
def by_year_counts(spark, d):
    return items(spark, d).where(F.col("year").between(1990, 2026)).groupBy("year", "grp").agg(F.count("*").alias("n"))


@query("by_year_pivot", f"WITH {ITEMS} SELECT grp, " + ", ".join(f"count(*) FILTER (WHERE year = {y}) AS y{y}" for y in range(1995, 2002)) + " FROM items GROUP BY grp")
def by_year_pivot(spark, d):
    return R.pivot_counts(items(spark, d), "grp", "year")


@query("decade_pivot_totals", f"WITH {ITEMS}, p AS (SELECT grp, count(*) FILTER (WHERE year < 2000) AS d1990, count(*) FILTER (WHERE year >= 2000) AS d2000 FROM items GROUP BY grp) SELECT * FROM p UNION ALL SELECT 'TOTAL', CAST(sum(d1990) AS BIGINT), CAST(sum(d2000) AS BIGINT) FROM p")
def decade_pivot_totals(spark, d):
    from ..functions.text import year_bin

    return R.with_totals(R.pivot_counts(items(spark, d).withColumn("ten", year_bin(F.col("year"), 10)), "grp", "ten", (1990, 2000), "d"), "grp")


@query("dense_years", f"WITH {ITEMS}, f AS (SELECT DISTINCT grp, unnest(range(1990, 2005)) AS year FROM items), c AS (SELECT grp, year, count(*) AS n FROM items GROUP BY grp, year) SELECT f.grp, CAST(f.year AS INTEGER) AS year, coalesce(n, 0) AS n FROM f LEFT JOIN c ON f.grp = c.grp AND f.year = c.year")
def dense_years(spark, d):
    return R.dense_counts(items(spark, d), "grp", "year", 1990, 2004)


@query("top_contributors", f"WITH {ITEMS}, {MEMBERS}, c AS (SELECT grp, member, count(*) AS items, CAST(sum(cites) AS BIGINT) AS cites FROM members JOIN items ON members.item = items.item GROUP BY grp, member), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY items DESC, member) AS rank FROM c) SELECT grp, member, items, cites, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 15")
def top_contributors(spark, d):
    c = members(spark, d).join(items(spark, d), "item").groupBy("grp", "member").agg(F.count("*").alias("items"), F.sum("cites").alias("cites"))
    return R.top_per_group(c, ["grp"], [F.desc("items"), F.col("member")], 15)


@query("top_papers", f"WITH {ITEMS}, r AS (SELECT grp, item, cites, row_number() OVER (PARTITION BY grp ORDER BY cites DESC, item) AS rank FROM items) SELECT grp, item, cites, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
def top_papers(spark, d):
    return R.top_per_group(items(spark, d).select("grp", "item", "cites"), ["grp"], [F.desc("cites"), F.col("item")], 10)


@query("top_per_member", f"WITH {ITEMS}, {MEMBERS}, r AS (SELECT member, members.item, cites, row_number() OVER (PARTITION BY member ORDER BY cites DESC, members.item) AS rank FROM members JOIN items ON members.item = items.item) SELECT member, item, cites, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3")
def top_per_member(spark, d):
    return R.top_per_group(members(spark, d).join(items(spark, d).select("item", "cites"), "item").select("member", "item", "cites"), ["member"], [F.desc("cites"), F.col("item")], 3)


@query("corpus_summary", f"WITH {ITEMS} SELECT count(*) AS n, count(DISTINCT grp) AS groups, min(year) AS first_year, max(year) AS last_year, CAST(sum(cites) AS BIGINT) AS cites, round(100.0 * count(*) FILTER (WHERE cites >= 250) / count(*), 4) AS share FROM items")
def corpus_summary(spark, d):
    return items(spark, d).agg(F.count("*").alias("n"), F.countDistinct("grp").alias("groups"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.sum("cites").alias("cites"), F.round(100 * F.count_if(F.col("cites") >= 250) / F.count("*"), 4).alias("share"))


@query(
    "author_rollup_mode",
    f"""WITH {ITEMS}, x AS (SELECT DISTINCT l_suppkey AS member, l_orderkey AS item, l_returnflag AS name FROM lineitem), j AS (SELECT x.*, i.year, i.grp, CASE WHEN x.item % 7 = 0 THEN x.item END AS external FROM x JOIN items i ON x.item = i.item),
m AS (SELECT member, name, row_number() OVER (PARTITION BY member ORDER BY count(*) DESC, name) AS r FROM j GROUP BY member, name)
SELECT j.member, any_value(m.name) AS name, count(DISTINCT j.item) AS items, max(j.year) AS last_year, arg_min(external, j.item) FILTER (WHERE external IS NOT NULL) AS external, md5(array_to_string(list_sort(list_distinct(list(j.item))), ',')) AS item_md5, array_to_string(list_sort(list_distinct(list(j.grp))), ',') AS groups
FROM j JOIN m ON j.member = m.member AND m.r = 1 GROUP BY j.member""",
)
def author_rollup_mode(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("member"), F.col("l_orderkey").alias("item"), F.col("l_returnflag").alias("name")).distinct()
    j = x.join(items(spark, d).select("item", "year", "grp"), "item").withColumn("external", F.when(F.col("item") % 7 == 0, F.col("item")))
    out = R.rollup_members(j, "member", "item", "name", "year", "external", "item", "grp")
    return out.select("member", "name", "items", "last_year", "external", F.md5(F.concat_ws(",", F.transform("item_ids", lambda i: i.cast("string"))).cast("binary")).alias("item_md5"), F.concat_ws(",", "groups").alias("groups"))


_UPDATES = "u AS (SELECT c_custkey AS cust, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 5 = 1 THEN -1 ELSE CAST(floor(c_acctbal) AS BIGINT) END AS fresh FROM customer WHERE c_custkey % 4 <> 0)"


def _updates(spark, d):
    k = F.col("c_custkey") % 5
    return table(spark, d, "customer").where(F.col("c_custkey") % 4 != 0).select(F.col("c_custkey").alias("cust"), F.when(k == 0, None).when(k == 1, F.lit(-1)).otherwise(F.floor("c_acctbal")).cast("long").alias("fresh"))


@query("citation_override", f"WITH {ITEMS}, {_UPDATES} SELECT item, CASE WHEN fresh >= 0 THEN fresh ELSE cites END AS cites, CASE WHEN fresh >= 0 THEN 'update' ELSE 'base' END AS source FROM items LEFT JOIN u ON items.cust = u.cust")
def citation_override(spark, d):
    return R.override(items(spark, d).select("item", "cust", "cites"), "cust", "cites", _updates(spark, d), "fresh").select("item", "cites", "source")


@query("citation_larger", f"WITH {ITEMS}, {_UPDATES} SELECT item, CASE WHEN fresh >= 0 AND fresh > cites THEN fresh ELSE cites END AS cites, CASE WHEN fresh >= 0 AND fresh > cites THEN 'update' ELSE 'base' END AS source FROM items LEFT JOIN u ON items.cust = u.cust")
def citation_larger(spark, d):
    return R.override(items(spark, d).select("item", "cust", "cites"), "cust", "cites", _updates(spark, d), "fresh", larger=True).select("item", "cites", "source")


@query("delta_report", f"WITH {ITEMS}, {_UPDATES}, j AS (SELECT fresh - cites AS delta FROM items JOIN u ON items.cust = u.cust WHERE fresh >= 0), a AS (SELECT count(*) AS n FROM items) SELECT count(*) AS hits, round(100.0 * count(*) / any_value(a.n), 4) AS hit_pct, round(avg(delta), 4) AS mean_delta, round(quantile_cont(delta, 0.5), 4) AS median_delta, max(delta) AS max_delta FROM j, a")
def delta_report(spark, d):
    i = items(spark, d)
    j = i.join(_updates(spark, d).where("fresh >= 0"), "cust").select((F.col("fresh") - F.col("cites")).alias("delta"))
    n = i.agg(F.count("*").alias("n"))
    middle = group_quantiles(j.withColumn("one", F.lit(1)), ["one"], "delta", {"m": 0.5}).select(F.round("m", 4).alias("median_delta"))
    a = j.agg(F.count("*").alias("hits"), F.round(F.avg("delta"), 4).alias("mean_delta"), F.max("delta").alias("max_delta")).join(F.broadcast(middle), how="left")  # one row
    return a.join(F.broadcast(n)).select("hits", F.round(100 * F.col("hits") / F.col("n"), 4).alias("hit_pct"), "mean_delta", "median_delta", "max_delta")  # one row each


@query("left_anti_todo", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')")
def left_anti_todo(spark, d):
    done = table(spark, d, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"))
    return R.todo(table(spark, d, "orders").select("o_orderkey"), done, "o_orderkey")


@query("left_semi_active", f"WITH {MEMBERS}, a AS (SELECT member FROM members GROUP BY member HAVING count(*) >= 500), b AS (SELECT item, member FROM members WHERE member IN (SELECT member FROM a)) SELECT member, count(*) AS items FROM b GROUP BY member")
def left_semi_active(spark, d):
    m = members(spark, d)
    active = m.groupBy("member").count().where("count >= 500").select("member")
    return m.join(active, "member", "left_semi").groupBy("member").agg(F.count("*").alias("items"))


@query("keep_last", "WITH r AS (SELECT user_id, event_type, event_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) SELECT user_id, event_type, event_id, value FROM r WHERE r = 1")
def keep_last(spark, d):
    return R.keep_first(table(spark, d, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("record_merge", "WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS v, CASE WHEN event_id % 2 = 0 THEN NULL ELSE event_type END AS t FROM events) SELECT user_id, arg_min(v, event_id) FILTER (WHERE v IS NOT NULL) AS v, arg_min(t, event_id) FILTER (WHERE t IS NOT NULL) AS t FROM e GROUP BY user_id")
def record_merge(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("v"), F.when(F.col("event_id") % 2 != 0, F.col("event_type")).alias("t"))
    return R.merge_records(e, "user_id", [F.col("event_id")], ["v", "t"])


@query("rolling_mean_3", f"WITH {ITEMS}, {MEMBERS}, t AS (SELECT item, count(*) AS n FROM members GROUP BY item), y AS (SELECT grp, year, avg(n) AS team FROM items JOIN t ON items.item = t.item GROUP BY grp, year) SELECT grp, year, round(team, 6) AS team, round(avg(team) OVER (PARTITION BY grp ORDER BY year ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS rolling FROM y")
def rolling_mean_3(spark, d):
    t = members(spark, d).groupBy("item").agg(F.count("*").alias("n"))
    y = items(spark, d).join(t, "item").groupBy("grp", "year").agg(F.avg("n").alias("team"))
    return R.rolling_mean(y, ["grp"], "year", "team").select("grp", "year", F.round("team", 6).alias("team"), F.round("rolling", 6).alias("rolling"))


@query("mean_sem", f"WITH {ITEMS}, {MEMBERS}, t AS (SELECT item, count(*) AS n FROM members GROUP BY item) SELECT grp, count(*) AS n, round(avg(t.n), 6) AS mean, round(coalesce(stddev_samp(t.n) / sqrt(count(*)), 0), 8) AS sem FROM items JOIN t ON items.item = t.item GROUP BY grp")
def mean_sem(spark, d):
    t = members(spark, d).groupBy("item").agg(F.count("*").alias("team"))
    out = R.mean_and_error(items(spark, d).join(t, "item"), "grp", "team")
    return out.select("grp", "n", F.round("mean", 6).alias("mean"), F.round("sem", 8).alias("sem"))


@query("frequency", f"WITH {MEMBERS}, k AS (SELECT member, count(*) AS k FROM members GROUP BY member) SELECT k, count(*) AS n FROM k GROUP BY k")
def frequency(spark, d):
    return R.frequency_of_frequency(members(spark, d), "member", "item")


@query("lotka_ols", "WITH p AS (SELECT DISTINCT l_orderkey AS item, l_partkey AS member FROM lineitem), k AS (SELECT member, count(*) AS k FROM p GROUP BY member), f AS (SELECT k, count(*) AS n FROM k GROUP BY k) SELECT round(regr_slope(ln(n), ln(k)), 8) AS slope, round(regr_intercept(ln(n), ln(k)), 8) AS intercept, round(-regr_slope(ln(n), ln(k)), 8) AS alpha FROM f")
def lotka_ols(spark, d):
    fit = R.log_log_fit(R.frequency_of_frequency(members(spark, d, "l_partkey"), "member", "item"))
    return fit.select(*[F.round(c, 8).alias(c) for c in ("slope", "intercept", "alpha")])


@query("simpson", "WITH n AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey) SELECT round(CAST(sum(n * n) AS DOUBLE) / CAST(sum(n) * sum(n) AS DOUBLE), 12) AS concentration FROM n")
def simpson(spark, d):
    return R.concentration(table(spark, d, "lineitem"), "l_suppkey").select(F.round("concentration", 12).alias("concentration"))


@query("avg_rank_top30", "WITH m AS (SELECT l_partkey, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS q, count(DISTINCT l_suppkey) AS s FROM lineitem GROUP BY l_partkey), r AS (SELECT l_partkey, n, q, s, round((rank() OVER (ORDER BY n DESC) + rank() OVER (ORDER BY q DESC) + rank() OVER (ORDER BY s DESC)) / 3.0, 6) AS mean_rank FROM m) SELECT l_partkey, n, q, s, mean_rank FROM r ORDER BY mean_rank, l_partkey LIMIT 30")
def avg_rank_top30(spark, d):
    m = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("q"), F.countDistinct("l_suppkey").alias("s"))
    return R.average_rank(m, ["n", "q", "s"], "l_partkey", 30).select("l_partkey", "n", "q", "s", F.round("mean_rank", 6).alias("mean_rank"))


@query("top9_other", "WITH b AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey ORDER BY n DESC, CAST(c_nationkey AS VARCHAR) LIMIT 9) SELECT coalesce(CAST(b.c_nationkey AS VARCHAR), 'Other') AS nation, count(*) AS n FROM customer c LEFT JOIN b ON c.c_nationkey = b.c_nationkey GROUP BY 1")
def top9_other(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("nation"))
    return R.top_or_other(c, "nation", 9).groupBy("nation").agg(F.count("*").alias("n"))


@query("histogram20", "SELECT CAST(least(19, floor(l_discount * 20)) AS INTEGER) AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def histogram20(spark, d):
    return R.histogram(table(spark, d, "lineitem"), "l_discount")


@query("row_shares", f"WITH {ITEMS}, c AS (SELECT grp, year, count(*) AS n FROM items GROUP BY grp, year) SELECT grp, year, n, round(n / sum(n) OVER (PARTITION BY grp), 9) AS share FROM c")
def row_shares(spark, d):
    c = items(spark, d).groupBy("grp", "year").agg(F.count("*").alias("n"))
    return R.shares(c, "grp", "n").withColumn("share", F.round("share", 9))


@query("peak_year", f"WITH {ITEMS}, c AS (SELECT grp, year, count(*) AS n FROM items GROUP BY grp, year) SELECT grp, CAST(sum(n) AS BIGINT) AS total, min(year) AS first_year, arg_max(year, n * 10000 - year) AS peak_year FROM c GROUP BY grp")
def peak_year(spark, d):
    c = items(spark, d).groupBy("grp", "year").agg(F.count("*").alias("n"))
    return c.groupBy("grp").agg(F.sum("n").alias("total"), F.min("year").alias("first_year"), F.max_by("year", F.struct(F.col("n"), -F.col("year"))).alias("peak_year"))


@query("key_kinds", "WITH k AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN 'id' WHEN c_custkey % 3 = 1 THEN 'orcid' ELSE 'name' END AS kind, c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2) SELECT kind, count(*) AS keys, CAST(sum(n) AS BIGINT) AS items, max(n) AS most FROM k GROUP BY kind")
def key_kinds(spark, d):
    k = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))
    kind = F.when(F.col("c_custkey") % 3 == 0, "id").when(F.col("c_custkey") % 3 == 1, "orcid").otherwise("name")
    return k.groupBy(kind.alias("kind")).agg(F.count("*").alias("keys"), F.sum("n").alias("items"), F.max("n").alias("most"))


@query("alias_resolve", "SELECT coalesce(CASE WHEN n_nationkey % 5 <> 0 THEN CAST(n_nationkey - n_nationkey % 5 AS INTEGER) END, n_nationkey) AS key, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def alias_resolve(spark, d):
    aliases = table(spark, d, "nation").where("n_nationkey % 5 <> 0").select(F.col("n_nationkey").alias("key"), (F.col("n_nationkey") - F.col("n_nationkey") % 5).alias("canonical"))
    return R.resolve(table(spark, d, "customer").select(F.col("c_nationkey").alias("key")), "key", aliases).groupBy("key").agg(F.count("*").alias("n"))


@query("set_operations", "WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R') SELECT 'union' AS op, count(*) AS n FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)")
def set_operations(spark, d):
    li = table(spark, d, "lineitem")
    a, b = (li.where(F.col("l_returnflag") == x).select(F.col("l_partkey").alias("k")) for x in "AR")
    rows = [("union", a.union(b).distinct()), ("intersect", a.intersect(b)), ("except", a.subtract(b))]
    out = None
    for op, df in rows:
        one = df.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n")
        out = one if out is None else out.union(one)
    return out


@query("map_precedence", "WITH m AS (SELECT c_custkey AS key, 0 AS p, c_custkey * 10 AS v FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 1, c_custkey * 100 FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 2, c_custkey * 1000 FROM customer) SELECT key, arg_min(v, p) AS v FROM m GROUP BY key")
def map_precedence(spark, d):
    c = table(spark, d, "customer")
    maps = [c.where(w).select(F.col("c_custkey").alias("key"), F.lit(p).alias("p"), (F.col("c_custkey") * f).alias("v")) for p, (w, f) in enumerate([("c_custkey % 2 = 0", 10), ("c_custkey % 3 = 0", 100), ("true", 1000)])]
    every = maps[0].union(maps[1]).union(maps[2])
    return R.keep_first(every, ["key"], [F.col("p")]).select("key", "v")


@query("cumulative_weights", f"WITH {MEMBERS}, n AS (SELECT member, count(*) AS n FROM members GROUP BY member) SELECT member, n, round(sum(n) OVER (ORDER BY member ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(n) OVER (), 9) AS cdf FROM n")
def cumulative_weights(spark, d):
    from ..operators.ordering import running_share

    n = members(spark, d).groupBy("member").agg(F.count("*").alias("n"))
    return running_share(n, [F.col("member")], "n", "cdf").withColumn("cdf", F.round("cdf", 9))


@query("dense_ids", "SELECT c_name, CAST(row_number() OVER (ORDER BY c_name) - 1 AS BIGINT) AS id FROM customer")
def dense_ids(spark, d):
    from ..operators.ordering import global_row_number

    return global_row_number(table(spark, d, "customer").select("c_name"), [F.col("c_name")], "id", 0)


@query("size_rank", "WITH g AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey) SELECT c_nationkey, n, CAST(row_number() OVER (ORDER BY CASE WHEN c_nationkey = 0 THEN 1 ELSE 0 END, n DESC, c_nationkey) - 1 AS BIGINT) AS dense FROM g")
def size_rank(spark, d):
    from ..operators.ordering import global_row_number

    g = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return global_row_number(g, [F.when(F.col("c_nationkey") == 0, 1).otherwise(0), F.desc("n"), F.col("c_nationkey")], "dense", 0)


@query("fallback_match", "WITH s AS (SELECT s_suppkey, s_nationkey FROM supplier), c AS (SELECT c_custkey, c_nationkey FROM customer), f AS (SELECT c_nationkey, min(c_custkey) AS first FROM c GROUP BY c_nationkey) SELECT s.s_suppkey, coalesce(CASE WHEN s.s_suppkey % 2 = 0 THEN c.c_custkey END, f.first) AS match FROM s LEFT JOIN c ON s.s_suppkey = c.c_custkey LEFT JOIN f ON s.s_nationkey = f.c_nationkey")
def fallback_match(spark, d):
    s, c = table(spark, d, "supplier"), table(spark, d, "customer")
    by_key = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_custkey").alias("k"))
    by_group = c.groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.min("c_custkey").alias("first"))
    return s.join(by_key, "s_suppkey", "left").join(by_group, "s_nationkey", "left").select("s_suppkey", F.coalesce("k", "first").alias("match"))


@query("declared_order", "SELECT o_orderpriority, count(*) AS n, CAST(CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '1-URGENT' THEN 1 ELSE 999 END AS INTEGER) AS place FROM orders GROUP BY o_orderpriority")
def declared_order(spark, d):
    order = {"5-LOW": 0, "1-URGENT": 1}
    place = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("o_orderpriority")), F.lit(999))
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")).withColumn("place", place).orderBy("place", "o_orderpriority")


@query("group_and_overall_top", f"WITH {ITEMS}, r AS (SELECT item, grp, cites, row_number() OVER (PARTITION BY grp ORDER BY cites DESC, item) AS g, row_number() OVER (ORDER BY cites DESC, item) AS a FROM items) SELECT item, grp, cites FROM r WHERE g <= 2 OR a <= 4")
def group_and_overall_top(spark, d):
    i = items(spark, d).select("item", "grp", "cites")
    best = R.top_per_group(i, ["grp"], [F.desc("cites"), F.col("item")], 4, "g")
    overall = F.row_number().over(Window.orderBy(F.desc("cites"), "item"))  # four rows a group at most
    return best.withColumn("a", overall).where("g <= 2 OR a <= 4").select("item", "grp", "cites")


@query("percentiles", "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.02), 4) AS p02, round(quantile_cont(o_totalprice, 0.98), 4) AS p98, round(quantile_disc(o_totalprice, 0.5), 4) AS lower_median FROM orders GROUP BY o_orderpriority")
def percentiles(spark, d):
    q = group_quantiles(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", {"p02": 0.02, "p98": 0.98, "lower_median": 0.5}, lower=("lower_median",))
    return q.select("o_orderpriority", *[F.round(c, 4).alias(c) for c in ("p02", "p98", "lower_median")])


@query("inverted_lookup", "SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS place, max(c_custkey) OVER (PARTITION BY c_mktsegment) AS last FROM customer")
def inverted_lookup(spark, d):
    """Names to their ids: a row an id with its place in the name's list, and the last id, which a single lookup gives."""
    from ..operators.ordering import group_row_number

    c = table(spark, d, "customer").select("c_mktsegment", "c_custkey")
    last = c.groupBy("c_mktsegment").agg(F.max("c_custkey").alias("last"))
    return group_row_number(c, ["c_mktsegment"], [F.col("c_custkey")], "place", 0).join(last, "c_mktsegment")


@query("trained_before", "SELECT o_orderkey, CASE WHEN year(o_orderdate) <= 1998 THEN 'train' WHEN year(o_orderdate) BETWEEN 1999 AND 2001 THEN 'test' END AS part FROM orders WHERE year(o_orderdate) <= 2001")
def trained_before(spark, d):
    y = F.year("o_orderdate")
    return table(spark, d, "orders").where(y <= 2001).select("o_orderkey", F.when(y <= 1998, "train").when(y.between(1999, 2001), "test").alias("part"))
