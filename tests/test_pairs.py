"""Pairs through classes: equal to plain loops, and no task makes the pairs of a large class alone."""

import random

from pyspark.sql import functions as F

from citeloom.operators import evaluation as E
from citeloom.operators import linkage as L


def spread(df):
    """Rows, and the share of them in the fullest partition."""
    n = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return sum(n), max(n) / sum(n)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_titles_equal_a_plain_loop(spark):
    random.seed(5)
    rows = [(i, random.choice([1, 2, None]), random.choice(["", "ab", "abc", "abd", "xbd", "lorem", "lorems", None])) for i in range(90)] + [(3, 1, "abc"), (3, 1, "abx")]
    df = spark.createDataFrame(rows, "key int, block int, title string")
    want = sorted((a, b, distance(s, t)) for a, x, s in rows for b, y, t in rows if a < b and x is not None and x == y and s is not None and t is not None and distance(s, t) <= 2)
    assert sorted(map(tuple, L.similar_titles(df, ["block"], "key", "title", 2).collect())) == want


def test_one_title_is_spread(spark):
    df = spark.range(1500).select("id", F.lit(1).alias("block"), F.lit("a title").alias("title"))
    n, most = spread(L.similar_titles(df, ["block"], "id", "title", 2))
    assert n == 1500 * 1499 // 2 and most < 0.6


def test_audit_spreads_and_gives_each_pair_once(spark):
    k = spark.range(800).select((F.col("id") % 400).alias("key"), F.lit("s").alias("surname"), F.when(F.col("id") < 400, F.array(F.lit("ada"), F.lit("eve"), F.lit("x"))).otherwise(F.array(F.lit("eve"), F.lit("ona"), F.lit("x"))).alias("given"), F.lit(3).alias("n"))
    out = L.split_suspects(k, k.where("id >= 400"))
    n, most = spread(out)
    assert n == out.distinct().count() == 400 * 400 and most < 0.6
    assert "name_key" not in " ".join(x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Aggregate" in x)


def test_pool_of_a_large_group_is_spread_and_leaves_out_what_is_near(spark):
    random.seed(6)
    groups = [(n, 1) for n in range(900)] + [(n, 2) for n in range(0, 900, 300)] + [(2000, 3), (2001, 3), (2002, None)]
    near = [(random.randrange(900), random.randrange(900)) for _ in range(3000)] * 2 + [(2001, 2000), (5, 2000)]
    out = E.shared_group_pool(spark.createDataFrame(groups, "node long, group long"), spark.createDataFrame(near, "x long, y long").repartition(8))
    want = {(a, b) for a in range(900) for b in range(900) if a != b} | {(2000, 2001), (2001, 2000)}
    got = out.collect()
    assert len(got) == len(set(got)) and set(map(tuple, got)) == want - set(near)
    assert spread(out)[1] < 0.6
