"""Positions in a global order without one task for all rows.

Rows are split by range, numbered inside their range and shifted by the sizes of the ranges before. Only one count (or sum)
a partition passes the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialize


def _ranged(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    return materialize(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")


def _shift(rows: DataFrame, what: Column) -> tuple[DataFrame, float]:
    at, out = 0, []
    for r in rows.groupBy("_part").agg(what.alias("s")).orderBy("_part").collect():
        out.append((r["_part"], at))
        at += r["s"]
    return rows.sparkSession.createDataFrame(out or [(0, 0)], "_part int, _shift long"), at


def global_row_number(rows: DataFrame, order: Sequence[Column], name: str = "row", first: int = 1) -> DataFrame:
    """rows with their position in order, which should end in a unique column."""
    parts = _ranged(rows, order)
    shift, _ = _shift(parts, F.count("*"))
    n = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn(name, n).join(F.broadcast(shift), "_part").withColumn(name, (F.col(name) + F.col("_shift") + (first - 1)).cast("long")).drop("_part", "_shift")


def running_sum(rows: DataFrame, order: Sequence[Column], weight: str, name: str = "sum") -> tuple[DataFrame, float]:
    """rows with the sum of weight up to and with them, and the total. weight is a whole number."""
    parts = _ranged(rows, order)
    shift, total = _shift(parts, F.sum(weight))
    s = F.sum(weight).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return parts.withColumn(name, s).join(F.broadcast(shift), "_part").withColumn(name, F.col(name) + F.col("_shift")).drop("_part", "_shift"), total  # a row for each range


def running_share(rows: DataFrame, order: Sequence[Column], weight: str, name: str = "share") -> DataFrame:
    """rows with the sum of weight up to and with them, over its total. weight is a whole number."""
    out, total = running_sum(rows, order, weight, name)
    return out.withColumn(name, F.col(name) / F.lit(float(total or 1)))


def tie_rank(rows: DataFrame, value: str, name: str) -> DataFrame:
    """rows with their rank by value, descending; ties share the smallest. Only the distinct values are put in order."""
    counts = rows.groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    placed = running_sum(counts, [F.desc("_v")], "_n", "_upto")[0].select("_v", (F.col("_upto") - F.col("_n") + 1).alias(name))
    return rows.join(placed, F.col(value).eqNullSafe(F.col("_v"))).drop("_v")


def group_quantiles(rows: DataFrame, groups: Sequence[str], value: str, wanted: dict[str, float], lower: Sequence[str] = ()) -> DataFrame:
    """groups and, for each name of wanted, the value at that share of the group's order, between neighbours by straight line; for names in lower the neighbour below. Nulls do not count.

    No task holds a group: rows are split by range over (groups, value), numbered inside their range and group, and shifted
    by the group's rows in the ranges before. Only the one or two rows at each wanted position are gathered.
    """
    kept = rows.where(F.col(value).isNotNull()).select(*groups, F.col(value).cast("double").alias(value), F.rand(7).alias("_tie"))
    parts = _ranged(kept, [F.col(c) for c in [*groups, value, "_tie"]])  # equal values may fall to several ranges
    size = parts.groupBy(*groups, "_part").agg(F.count("*").alias("_n"))
    by = Window.partitionBy(*groups).orderBy("_part")  # a row for each range that a group reaches
    size = size.withColumn("_before", F.coalesce(F.sum("_n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", F.sum("_n").over(Window.partitionBy(*groups)))
    at = parts.withColumn("_at", F.row_number().over(Window.partitionBy("_part", *groups).orderBy(value)))
    same = F.lit(True)
    renamed = size
    for i, c in enumerate([*groups, "_part"]):
        renamed = renamed.withColumnRenamed(c, f"_k{i}")
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    at = at.join(renamed, same).withColumn("_at", F.col("_at") + F.col("_before") - 1)
    spot = {name: F.lit(q) * (F.col("_all") - 1) for name, q in wanted.items()}
    near = F.lit(False)
    for x in spot.values():
        near = near | F.col("_at").isin(F.floor(x), F.ceil(x))
    picked = at.where(near)
    out = []
    for name, x in spot.items():
        low, high = F.max(F.when(F.col("_at") == F.floor(x), F.col(value))), F.max(F.when(F.col("_at") == F.ceil(x), F.col(value)))
        part = F.max(x - F.floor(x))
        out.append((low if name in lower else low + (high - low) * part).alias(name))
    return picked.groupBy(*groups).agg(*out)


def group_row_number(rows: DataFrame, groups: Sequence[str], order: Sequence[Column], name: str = "row", first: int = 1) -> DataFrame:
    """rows with their position inside their group in order, which should end in a unique column. No task holds a group: positions are counted inside ranges and shifted."""
    parts = _ranged(rows, [*[F.col(c) for c in groups], *order])
    size = parts.groupBy(*groups, "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range that a group reaches
    size = size.withColumn("_before", before).drop("_n")
    same = F.lit(True)
    for i, c in enumerate([*groups, "_part"]):
        size = size.withColumnRenamed(c, f"_k{i}")
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    at = parts.withColumn(name, F.row_number().over(Window.partitionBy("_part", *groups).orderBy(*order)))
    return at.join(size, same).withColumn(name, (F.col(name) + F.col("_before") + (first - 1)).cast("long")).drop("_part", "_before", *[f"_k{i}" for i in range(len(groups) + 1)])
