"""Pairs of members through pairs of their classes: what all members of a class have in common is decided once, and members are put together only where the rows are given out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import shuffle_parts

#: Members of one list. A list against a list makes the square of this many rows at most, by two or three times: lists are dealt by hash.
LIST = 256


def chunked(rows: DataFrame, classes: Sequence[str], key: str, size: int = LIST) -> DataFrame:
    """classes, _chunk and _keys: the keys of each class in lists of about size by hash, so that no row or task holds a large class. Rows with a null class are left out."""
    n = rows.groupBy(*classes).agg(F.ceil(F.count("*") / size).alias("_lists"))
    return rows.join(n, list(classes)).groupBy(*classes, F.pmod(F.xxhash64(key), F.col("_lists")).alias("_chunk")).agg(F.collect_list(key).alias("_keys"))


def expanded(lists: DataFrame, left: str, right: str, x: str, y: str) -> DataFrame:
    """A row for each x of the list in column left with each y of that in right, beside the other columns. Rows of lists are dealt out evenly before they grow."""
    rest = [c for c in lists.columns if c not in (left, right)]
    dealt = lists.repartition(shuffle_parts(lists))
    return dealt.select(*rest, F.explode(left).alias(x), right).select(*rest, x, F.explode(right).alias(y))


def token_sets(rows: DataFrame, key: str, token: str, name: str) -> DataFrame:
    """key and its sorted set of tokens as name, a row a key: its class."""
    return rows.where(F.col(token).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_set(token)).alias(name))


def sharing_classes(left: DataFrame, right: DataFrame, x: str, y: str) -> DataFrame:
    """Pairs (x, y) of token sets that share a token, each once: it is met at the least token of both."""
    a = left.select(x).distinct().select(x, F.explode(x).alias("_token"))
    b = right.select(y).distinct().select(y, F.explode(y).alias("_token"))
    return a.join(b, "_token").where(F.col("_token") == F.array_min(F.array_intersect(x, y))).select(x, y)


def sharing(left: DataFrame, right: DataFrame, key: str, token: str, x: str, y: str) -> DataFrame:
    """Distinct pairs (x, y) of keys of left and of right that share a token. Both tables: key, token. A key has one class, so no pair comes twice and none is moved."""
    a, b = token_sets(left, key, token, "_a"), token_sets(right, key, token, "_b")
    both = sharing_classes(a, b, "_a", "_b")
    lists = both.join(chunked(a, ["_a"], key).select("_a", F.col("_keys").alias("_left")), "_a").join(chunked(b, ["_b"], key).select("_b", F.col("_keys").alias("_right")), "_b")
    return expanded(lists.select("_left", "_right"), "_left", "_right", x, y)


def sharing_without(rows: DataFrame, near: DataFrame, key: str, token: str, x: str = "x", y: str = "y") -> DataFrame:
    """Distinct pairs (x, y) of different keys that share a token, without those of near (x, y). What a key has in near is taken from each list of its candidates before the list grows."""
    sets = token_sets(rows, key, token, "_b")
    lists = chunked(sets, ["_b"], key)
    both = sharing_classes(sets.withColumnRenamed("_b", "_a"), sets, "_a", "_b")
    wide = both.join(lists.select("_b", "_chunk"), "_b")
    cand = sets.select(F.col(key).alias(x), F.col("_b").alias("_a")).join(wide, "_a").select(x, "_b", "_chunk")
    own = sets.join(sets.groupBy("_b").agg(F.ceil(F.count("*") / LIST).alias("_lists")), "_b").select(F.col(key).alias(y), "_b", F.pmod(F.xxhash64(key), F.col("_lists")).alias("_chunk"))
    held = near.select(x, y).join(own, y).join(sets.select(F.col(key).alias(x), F.col("_b").alias("_a")), x).where(F.arrays_overlap("_a", "_b"))
    held = held.groupBy(x, "_b", "_chunk").agg(F.collect_list(y).alias("_met"))
    n = shuffle_parts(rows.select(key).join(near.select(F.col(x).alias(key)), key))
    # a number of its own for each exchange: rows are small before they grow, and would be put in few tasks
    open_ = cand.repartition(n, x, "_b", "_chunk").join(held, [x, "_b", "_chunk"], "left").repartition(n, "_b", "_chunk").join(lists, ["_b", "_chunk"])
    left = F.when(F.col("_met").isNull(), F.col("_keys")).otherwise(F.array_except("_keys", "_met"))
    return open_.select(x, left.alias("_left")).select(x, F.explode("_left").alias(y)).where(F.col(x) != F.col(y))
