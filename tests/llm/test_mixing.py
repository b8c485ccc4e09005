import random
import re

import numpy as np
from pyspark.sql import functions as F

from citeloom.llm import mixing


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_targets_fill_up():
    t = mixing.targets({"a": 100, "b": 10, "c": 100, None: 0})
    assert t[None] == 0 and t["b"] == 30 and abs(sum(t.values()) - 210) < 1e-9 and abs(t["a"] / t["c"] - 5) < 1e-9
    assert mixing.targets({"a": 0}) == {"a": 0.0} and mixing.targets({}) == {}


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(0)
    for sizes in (rng.integers(1, 900, 200), np.full(50, 7), np.array([3]), np.array([3, 3]), np.array([0, 0, 5, 9])):
        pi = rng.uniform(0, 1, len(sizes))
        out = mixing.flight(sizes, pi, lambda held: rng.uniform())
        assert abs((out * sizes).sum() - (pi * sizes).sum()) < 1e-4 and abs(out.sum() - pi.sum()) < 1e-5
        assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 2
        done = mixing.land(sizes, out)
        assert set(np.unique(done)) <= {0.0, 1.0}


def frame(spark, n=900):
    random.seed(2)
    rows = [(i, "w " * random.randint(1, 60), random.choice(["a", "a", "a", "b", "c", None])) for i in range(n)]
    rows += [(7, None, "a"), (8, "", "b"), (None, "x y", "c"), (None, "x y", "c"), (9, "only", "tiny")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_mix_is_near_its_targets_and_repeats(spark):
    rows, df = frame(spark)
    got = mixing.mix(df, block_rows=100).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    want = mixing.targets(sizes)
    for s in sizes:
        mine = [r for r in got if r["source"] == s]
        assert all(abs(r["target"] - want[s]) < 1e-6 and r["source_size"] == sizes[s] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - want[s]) <= 60
    assert all(r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"] for r in got)
    key = lambda rs: sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in rs)
    assert key(got) == key(mixing.mix(df.repartition(7), block_rows=100).collect())


def test_rows_are_repeated(spark):
    rows, df = frame(spark, 120)
    df = df.withColumn("tag", F.lit(1)).withColumn("copies", F.lit("x"))
    out = mixing.mix_rows(df, block_rows=50)
    assert out.columns == df.columns
    total = sum(words(t) for _, t, _ in rows)
    assert abs(sum(words(r["text"]) for r in out.collect()) - total) < 200


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(df).count() == 0 and mixing.mix_rows(df).count() == 0
