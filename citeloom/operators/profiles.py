"""Profiles of members and reports: counters, team sizes, medians, cells of a typology, pages, and the numbers kept with results."""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import shuffle_parts
from .ordering import global_row_number, group_quantiles


def longest_name(rows: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """key and its longest name; of equally long ones the first in order."""
    return rows.where(F.col(name).isNotNull()).groupBy(key).agg(F.max_by(name, F.struct(F.length(name), -F.col(order))).alias(name))


def member_counters(rows: DataFrame, item: str, member: str, year: str, count: str) -> DataFrame:
    """For each member: entries (repeated rows of an item included), last year, sum of counts over entries; over distinct items the sum of counts of items with several members, and the number of items with one."""
    n, c, known = F.col("_entries"), F.coalesce(F.col(count), F.lit(0)), F.col(item).isNotNull()
    rows = rows.repartition(shuffle_parts(rows), item)  # one exchange for all, in as many tasks as the input is large
    once = rows.groupBy(item, member, count).agg(F.count("*").alias("_entries"), F.max(year).alias("_year"))
    team = Window.partitionBy(item)
    lone = F.min(member).over(team).eqNullSafe(F.max(member).over(team)) & (F.count(member).over(team).isin(0, F.count("*").over(team)))  # one member, or none that is named
    once = once.withColumn("_lone", lone)
    out = once.groupBy(member).agg(
        F.sum("_entries").alias("entries"), F.max("_year").alias("last_year"), F.sum(n * c).alias("count_all"),
        F.sum(F.when(known & ~F.col("_lone"), c).otherwise(0)).alias("count_shared"), F.count_if(known & F.col("_lone")).alias("alone"), F.count_if(known).alias("_items"),
    )
    return out.where(F.col(member).isNotNull() & (F.col("_items") > 0)).drop("_items")


def team_sizes(members: DataFrame, entries: DataFrame, item: str, member: str) -> DataFrame:
    """For each member the mean number of entries of its items (an item without any counts 1). members (item, member) and entries (item) may repeat; an item counts once a member."""
    size = entries.groupBy(item).agg(F.count("*").alias("_n"))
    return members.select(item, member).distinct().join(size, item, "left").groupBy(member).agg(F.count("*").alias("items"), F.avg(F.greatest(F.lit(1), F.coalesce("_n", F.lit(1)))).alias("mean_team"))


def summary(rows: DataFrame, value: str, baseline: float) -> DataFrame:
    """n, mean, median and the share of values above baseline; nulls do not count."""
    kept = rows.where(F.col(value).isNotNull()).select(value).withColumn("_one", F.lit(1))
    middle = group_quantiles(kept, ["_one"], value, {"median": 0.5})
    main = kept.groupBy("_one").agg(F.count("*").alias("n"), F.avg(value).alias("mean"), (F.count_if(F.col(value) > baseline) / F.count("*")).alias("above"))
    return main.join(middle, "_one").select("n", "mean", "median", "above")


def class_medians(rows: DataFrame, label: str, measures: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """A row for each of labels, in that order (place): the number of its rows and the medians of the measures; null where there are none."""
    out = rows.sparkSession.createDataFrame([(i, x) for i, x in enumerate(labels)], f"place int, {label} string")
    out = out.join(rows.groupBy(label).agg(F.count("*").alias("n")), label, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    for m in measures:
        out = out.join(group_quantiles(rows.where(F.col(m).isNotNull()), [label], m, {f"median_{m}": 0.5}), label, "left")
    return out


def cells(rows: DataFrame, axes: Mapping[str, Sequence[str]]) -> DataFrame:
    """A row for each combination of the axes' values, in the order given (place), with its number of rows, 0 included."""
    every = [(i, *values) for i, values in enumerate(itertools.product(*axes.values()))]  # the values of the axes, a handful each
    frame = rows.sparkSession.createDataFrame(every, ", ".join(["place int", *[f"{axis} string" for axis in axes]]))
    counts = rows.groupBy(*axes).agg(F.count("*").alias("n"))
    return frame.join(counts, list(axes), "left").withColumn("n", F.coalesce("n", F.lit(0)))


def page(rows: DataFrame, order: Sequence[Column], number: int, size: int = 25) -> DataFrame:
    """Page number (from 1) of size rows in order, which should end in a unique column, with each row's position; size is held between 25 and 500."""
    size = min(500, max(25, size))
    at = global_row_number(rows, order, "position")
    return at.where(F.col("position").between((number - 1) * size + 1, number * size))


def top_pairs(rows: DataFrame, a: str, b: str, order: Sequence[Column], k: int) -> DataFrame:
    """The first k unordered pairs; of the rows of one pair the first in order stays. a is the smaller of both."""
    pair = rows.withColumns({a: F.least(a, b), b: F.greatest(a, b)})
    first = F.row_number().over(Window.partitionBy(a, b).orderBy(*order))
    return pair.withColumn("_first", first).where("_first = 1").drop("_first").orderBy(*order).limit(k)


def exemplars(rows: DataFrame, label: str, key: str, named: Sequence, by: Sequence[Column], then: Sequence[Column], k: int = 20) -> DataFrame:
    """One row a label: one of named if it has any (the first by by), else of its first k by by the first by then."""
    short = rows.withColumn("_k", F.row_number().over(Window.partitionBy(label).orderBy(*by))).withColumn("_named", F.col(key).isin(*named) if named else F.lit(False))
    pool = short.where((F.col("_k") <= k) | F.col("_named"))
    first = F.row_number().over(Window.partitionBy(label).orderBy(F.desc("_named"), F.when(F.col("_named"), F.col("_k")), *then))
    return pool.withColumn("_r", first).where("_r = 1").drop("_r", "_k").withColumnRenamed("_named", "named")


def reindex(kept: DataFrame, key: str, refs: DataFrame, owner: str, ref: str) -> tuple[DataFrame, DataFrame]:
    """kept with index, its dense number from 0 in ascending order of key; and for each owner the sorted indexes of the refs that are kept."""
    numbered = global_row_number(kept, [F.col(key)], "index", 0)
    found = refs.join(numbered.select(F.col(key).alias(ref), "index"), ref).groupBy(owner).agg(F.array_sort(F.collect_set("index")).alias("indexes"))  # one owner's own references
    return numbered, found


def weighted_concepts(rows: DataFrame, owner: str, concept: str, value: Column, k: int = 12) -> DataFrame:
    """The k concepts of largest summed value of each owner, over the length of those k: owner, concept, share, rank."""
    total = rows.groupBy(owner, concept).agg(F.sum(value).alias("_v"))
    best = total.withColumn("rank", F.row_number().over(Window.partitionBy(owner).orderBy(F.desc("_v"), concept))).where(F.col("rank") <= k)
    length = F.sqrt(F.sum(F.col("_v") * F.col("_v")).over(Window.partitionBy(owner)))
    return best.withColumn("share", F.when(length > 0, F.col("_v") / length).otherwise(F.lit(0.0))).select(owner, concept, "share", "rank")


def coverage(rows: DataFrame, tests: Mapping[str, Column]) -> DataFrame:
    """A row for each test with the number of rows that meet it, and one for all rows."""
    counted = rows.agg(F.count("*").alias("all"), *[F.count_if(t).alias(name) for name, t in tests.items()])
    names = ["all", *tests]
    return counted.select(F.explode(F.array(*[F.struct(F.lit(n).alias("what"), F.col(f"`{n}`").alias("n")) for n in names])).alias("r")).select("r.what", "r.n")


def duplicate_report(raw: DataFrame, kept: DataFrame, group: str) -> DataFrame:
    """For each group and in all (group TOTAL): raw rows, rows kept, and the share that went, in percent to two places."""
    one = lambda df, name: df.groupBy(group).agg(F.count("*").alias(name))
    by = one(raw, "raw").join(one(kept, "kept"), group, "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    every = by.unionByName(by.agg(F.sum("raw").alias("raw"), F.sum("kept").alias("kept")).withColumn(group, F.lit("TOTAL")))
    return every.withColumn("dup_pct", F.round(100 * (1 - F.col("kept") / F.col("raw")), 2))


def merge_suspects(rows: DataFrame, key: str, kind: Column, name: str, item: str, least: int, k: int = 50) -> DataFrame:
    """The k name-only keys with most items (least or more): the most likely to hold several people. key, items, and how many spellings they go by."""
    n = rows.where(kind == "name").groupBy(key).agg(F.countDistinct(item).alias("items"), F.countDistinct(name).alias("spellings"))
    return n.where(F.col("items") >= least).orderBy(F.desc("items"), key).limit(k)


def evidence(pairs: DataFrame, facts: Mapping[str, tuple[DataFrame, str, int]], shared: DataFrame | None = None, most_shared: int = 5) -> DataFrame:
    """pairs (a, b) with, for each fact, the first values of both keys: columns a_<fact> and b_<fact>. facts: name -> (rows of key and value, the value's column, how many). shared (key, other): the first others of both, as column shared_with."""
    for name, (rows, column, most) in facts.items():
        ranked = rows.select("key", F.col(column).alias("_v")).distinct().withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy("_v"))).where(F.col("_r") <= most)
        lists = ranked.groupBy("key").agg(F.array_sort(F.collect_list("_v")).alias("_l"))  # most values a key
        for side in "ab":
            pairs = pairs.join(lists.select(F.col("key").alias(side), F.col("_l").alias(f"{side}_{name}")), side, "left")
    if shared is not None:
        links = shared.select("key", "other").distinct()
        both = pairs.select("a", "b").join(links.withColumnRenamed("key", "a"), "a").join(links.withColumnRenamed("key", "b"), ["b", "other"])
        ranked = both.withColumn("_r", F.row_number().over(Window.partitionBy("a", "b").orderBy("other"))).where(F.col("_r") <= most_shared)
        pairs = pairs.join(ranked.groupBy("a", "b").agg(F.array_sort(F.collect_list("other")).alias("shared_with")), ["a", "b"], "left")  # most_shared values a pair
    return pairs


def first_hits(hits: DataFrame, owner: str, place: str, value: str) -> DataFrame:
    """For each owner the value of its first place that has one."""
    return hits.where(F.col(value).isNotNull()).groupBy(owner).agg(F.min_by(value, place).alias(value), F.min(place).alias(place))


def training_rows(rows: DataFrame, year: str, text: str, last: int) -> DataFrame:
    """Rows up to the year last that have a text; those without a year stay."""
    return rows.where((F.coalesce(F.col(year), F.lit(-(2**31))) <= last) & (F.trim(F.coalesce(F.col(text), F.lit(""))) != ""))


def greedy_alignment(counts: DataFrame, row: str, column: str, value: str, most: int = 1000) -> list[tuple]:
    """(row, column) pairs: rows in order of their largest value take their best free column. At most most rows and columns, else ValueError."""
    cells_ = counts.orderBy(F.desc(value), row, column).limit(most * most + 1).collect()  # most * most + 1 cells at most
    if len({r[row] for r in cells_}) > most or len({r[column] for r in cells_}) > most:
        raise ValueError(f"more than {most} rows or columns")
    out, used_r, used_c = [], set(), set()
    for r in cells_:
        if r[row] not in used_r and r[column] not in used_c:
            used_r.add(r[row])
            used_c.add(r[column])
            out.append((r[row], r[column]))
    return out
