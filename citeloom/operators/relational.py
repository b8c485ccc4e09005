"""Filters, rollups, rankings, pivots and set operations over tables of items, members and groups. Columns are parameters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import tie_rank


def explore(items: DataFrame, *, year: Column | None = None, years: tuple[int, int] | None = None, count: Column | None = None, least: float | None = None, group: Column | None = None, groups: Sequence[str] = (), text: Column | None = None, words: Sequence[str] = (), any_word: bool = False, members: Column | None = None, member_words: Sequence[str] = ()) -> DataFrame:
    """The rows that meet every given condition: years inclusive, least count, one of groups, words in the text (all, or any), all member words. Words ignore case."""
    test = F.lit(True)
    if years is not None:
        test = test & year.between(*years)
    if least is not None:
        test = test & (F.coalesce(count, F.lit(0)) >= least)
    if groups:
        test = test & group.isin(*groups)
    if words:
        hits = [F.contains(F.lower(text), F.lit(w.lower())) for w in words]
        one = hits[0]
        for h in hits[1:]:
            one = (one | h) if any_word else (one & h)
        test = test & one
    for w in member_words:
        test = test & F.contains(F.lower(members), F.lit(w.lower()))
    return items.where(test)


def group_stats(items: DataFrame, members: DataFrame, item: str, member: str, group: str, count: str) -> DataFrame:
    """For each group: items, single-member items and their share, distinct members, mean and largest team, member pairs, items per member, mean count. items has one row an item; members (item, member) may repeat. Items without members count as items."""
    teams = members.select(item, member).distinct().groupBy(item).agg(F.count("*").alias("team"))
    rows = items.join(teams, item, "left").withColumn("team", F.coalesce("team", F.lit(0)))
    main = rows.groupBy(group).agg(
        F.count("*").alias("items"),
        F.count_if(F.col("team") == 1).alias("single"),
        F.avg(F.when(F.col("team") > 0, F.col("team"))).alias("mean_team"),
        F.max("team").alias("max_team"),
        F.sum(F.col("team") * (F.col("team") - 1) / 2).cast("long").alias("pairs"),
        F.avg(F.coalesce(F.col(count), F.lit(0))).alias("mean_count"),
    )
    people = members.select(item, member).join(items.select(item, group), item).groupBy(group).agg(F.countDistinct(member).alias("members"))
    out = main.join(people, group, "left").withColumn("members", F.coalesce("members", F.lit(0)))
    return out.select(
        group, "items", "single", F.round(100 * F.col("single") / F.col("items"), 2).alias("single_pct"), "members", F.round("mean_team", 3).alias("mean_team"),
        "max_team", "pairs", F.round(F.col("items") / F.nullif(F.col("members"), F.lit(0)), 4).alias("items_per_member"), F.round("mean_count", 3).alias("mean_count"),
    )


def top_per_group(rows: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank", method: str = "row_number") -> DataFrame:
    """The first k rows of each group; order should end in a unique column."""
    w = Window.partitionBy(*groups).orderBy(*order)
    return rows.withColumn(rank, getattr(F, method)().over(w)).where(F.col(rank) <= k)


def keep_first(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row a key: the first in order."""
    return top_per_group(rows, keys, order, 1, "_first").drop("_first")


def dense_counts(rows: DataFrame, group: str, year: str, lo: int, hi: int) -> DataFrame:
    """group, year, n for every year from lo to hi; 0 where there is none."""
    counts = rows.groupBy(group, year).agg(F.count("*").alias("n"))
    frame = rows.select(group).distinct().withColumn(year, F.explode(F.sequence(F.lit(lo), F.lit(hi))))
    return frame.join(counts, [group, year], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def pivot_counts(rows: DataFrame, group: str, across: str, values: Sequence | None = None, name: str = "y", most: int = 1000) -> DataFrame:
    """A row a group, a zero-filled count a value; without values, those found, in order (more than most raise an error)."""
    if values is None:
        found = rows.where(F.col(across).isNotNull()).select(across).distinct().limit(most + 1).collect()  # most + 1 values at most
        if len(found) > most:
            raise ValueError(f"more than {most} values of {across}")
        values = sorted(r[0] for r in found)
    return rows.groupBy(group).agg(*[F.count_if(F.col(across) == v).alias(f"{name}{v}") for v in values])


def with_totals(table: DataFrame, group: str, label: str = "TOTAL") -> DataFrame:
    """table and a row of its column sums."""
    numbers = [c for c in table.columns if c != group]
    return table.unionByName(table.agg(*[F.sum(c).alias(c) for c in numbers]).withColumn(group, F.lit(label)))


def top_or_other(rows: DataFrame, group: str, k: int, other: str = "Other") -> DataFrame:
    """rows with group replaced by other outside the k most frequent groups (ties: smaller name)."""
    best = rows.groupBy(group).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), group).limit(k).select(F.col(group).alias("_best"))
    return rows.join(F.broadcast(best), F.col(group) == F.col("_best"), "left").withColumn(group, F.coalesce("_best", F.lit(other))).drop("_best")  # k rows


def rollup_members(rows: DataFrame, member: str, item: str, name: str, year: str, external: str, order: str, group: str) -> DataFrame:
    """One row a member: most frequent name (ties: smallest), items, last year, first external id in order, sorted items and groups."""
    return rows.groupBy(member).agg(
        F.mode(name, True).alias("name"),
        F.countDistinct(item).alias("items"),
        F.max(year).alias("last_year"),
        F.min_by(external, F.when(F.col(external).isNotNull(), F.col(order))).alias("external"),
        F.array_sort(F.collect_set(item)).alias("item_ids"),
        F.array_sort(F.collect_set(group)).alias("groups"),
    )


def merge_records(rows: DataFrame, key: str, priority: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """One row a key: for each column the first value by priority that is not null."""
    w = Window.partitionBy(key).orderBy(*priority).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = [F.first(c, ignorenulls=True).over(w).alias(c) for c in columns]
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*priority))
    return rows.select(key, *first, rank.alias("_r")).where("_r = 1").drop("_r")


def override(rows: DataFrame, key: str, old: str, updates: DataFrame, new: str, source: str = "source", larger: bool = False) -> DataFrame:
    """rows with old replaced where updates (one row a key) has a value of 0 or more; or by the larger of both. source tells which."""
    j = rows.join(updates.select(key, F.col(new).alias("_new")), key, "left")
    good = F.col("_new").isNotNull() & (F.col("_new") >= 0)
    if larger:
        good = good & (F.col("_new") > F.coalesce(F.col(old), F.lit(-1)))
    return j.withColumn(source, F.when(good, "update").otherwise("base")).withColumn(old, F.when(good, F.col("_new")).otherwise(F.col(old))).drop("_new")


def rolling_mean(rows: DataFrame, groups: Sequence[str], order: str, value: str, before: int = 1, after: int = 1, name: str = "rolling") -> DataFrame:
    """The mean over neighbouring rows; fewer at the ends."""
    return rows.withColumn(name, F.avg(value).over(Window.partitionBy(*groups).orderBy(order).rowsBetween(-before, after)))


def mean_and_error(rows: DataFrame, group: str, value: str) -> DataFrame:
    """n, mean and standard error (0 for one row)."""
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value) / F.sqrt(F.count("*")), F.lit(0.0)).alias("sem"))


def frequency_of_frequency(rows: DataFrame, member: str, item: str) -> DataFrame:
    """k and how many members have k items."""
    return rows.groupBy(member).agg(F.countDistinct(item).alias("k")).groupBy("k").agg(F.count("*").alias("n"))


def log_log_fit(freq: DataFrame, x: str = "k", y: str = "n") -> DataFrame:
    """Least squares of ln y on ln x: slope, intercept, alpha = -slope."""
    lx, ly = F.log(F.col(x)), F.log(F.col(y))
    return freq.where((F.col(x) > 0) & (F.col(y) > 0)).agg(F.regr_slope(ly, lx).alias("slope"), F.regr_intercept(ly, lx).alias("intercept")).withColumn("alpha", -F.col("slope"))


def concentration(rows: DataFrame, group: str) -> DataFrame:
    """Sum of squared shares of the groups."""
    return rows.groupBy(group).agg(F.count("*").alias("n")).agg((F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("concentration"))


def average_rank(rows: DataFrame, measures: Sequence[str], key: str, k: int) -> DataFrame:
    """The k rows of best mean rank over the measures (descending, ties share the smallest rank)."""
    ranked = rows
    for m in measures:
        ranked = tie_rank(ranked, m, f"rank_{m}")
    mean = sum((F.col(f"rank_{m}") for m in measures[1:]), F.col(f"rank_{measures[0]}")) / len(measures)
    return ranked.withColumn("mean_rank", mean).orderBy("mean_rank", key).limit(k)


def histogram(rows: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """Counts in equal bins of [0, 1]; the last is closed."""
    return rows.where(F.col(value).isNotNull()).groupBy(F.least(F.lit(bins - 1), F.floor(F.col(value) * bins)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def shares(rows: DataFrame, row: str, value: str, name: str = "share") -> DataFrame:
    """Each value over the sum of its row."""
    return rows.withColumn(name, F.col(value) / F.sum(value).over(Window.partitionBy(row)))


def todo(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not done."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def resolve(rows: DataFrame, key: str, aliases: DataFrame, bound_rows: int = 1_000_000) -> DataFrame:
    """key replaced by its canonical one, if it has one. aliases (key, canonical) is broadcast up to bound_rows rows."""
    side = aliases.select(F.col("key").alias("_k"), F.col("canonical").alias("_c"))
    if side.limit(bound_rows + 1).count() <= bound_rows:
        side = F.broadcast(side)
    return rows.join(side, F.col(key) == F.col("_k"), "left").withColumn(key, F.coalesce("_c", key)).drop("_k", "_c")
