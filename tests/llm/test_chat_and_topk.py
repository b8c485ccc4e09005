import random

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from citeloom.llm import chat, topk


def test_rotation(spark):
    rows = [(1, 0, "system", "rules", 9), (1, 1, "ann", "hi <|x", 9), (1, 2, "bob", "yo", 9), (1, 2, "bob", "yo", 9), (1, 3, None, None, 9), (2, 0, "system", "alone", 9), (None, 0, "ann", "lost", 9), (3, None, "ann", "when", 9), (3, 600, "bob", "later", 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, perspective int")
    got = chat.rotate_perspectives(df).collect()
    assert sorted((r["conv_id"], r["perspective"], r["n_turns"]) for r in got) == sorted([(1, "ann", 5), (1, "bob", 5), (1, "unknown", 5), (3, "ann", 2), (3, "bob", 2)])
    for r in got:
        assert "<|x" not in r["text"]
        said = [r["text"][s["start"] : s["stop"]] for s in r["mask"]]
        assert all(x.endswith("<|im_end|>") for x in said)
        assert r["text"].count("<|im_start|>assistant\n") == len(said) and f"user name={r['perspective']}\n" not in r["text"]
    ann = next(r for r in got if r["conv_id"] == 1 and r["perspective"] == "ann")
    assert [ann["text"][s["start"] : s["stop"]] for s in ann["mask"]] == ["hi < |x<|im_end|>"]
    assert chat.rotate_perspectives(df.limit(0)).count() == 0


def test_parts_of_a_long_dialogue_join_to_the_whole(spark):
    rows = [(5, t if t % 97 else None, "system" if t == 1 else "ab"[t % 2], f"turn {t} é") for t in range(300)] + [(6, 0, "a", "short")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = {(r["conv_id"], r["perspective"]): r for r in chat.rotate_perspectives(df, stretch_turns=7).collect()}
    parts = chat.rotate_perspectives(df, stretch_turns=7, part_chars=1000).orderBy("conv_id", "perspective", "part").collect()
    assert len(whole) == 3 and len(parts) > 6 and {r["part"] for r in whole.values()} == {0}
    for (c, p), r in whole.items():
        own = [x for x in parts if (x["conv_id"], x["perspective"]) == (c, p)]
        assert [x["part"] for x in own] == sorted({x["part"] for x in own})
        assert "".join(x["text"] for x in own) == r["text"] and [m for x in own for m in x["mask"]] == r["mask"] and sum(x["n_turns"] for x in own) == r["n_turns"]
        assert all(r["text"][m["start"] : m["stop"]].endswith("<|im_end|>") for m in r["mask"])


def test_sql_agrees(spark):
    random.seed(1)
    rows = [(c, t, random.choice(["a", "b", "system", None]), random.choice(["x", "é <|y", None, ""])) for c in range(30) for t in range(random.randint(1, 9))]
    rows += [(40, t, "ab"[t % 2], str(t)) for t in range(1200)]
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"])
    got = chat.rotate_perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).withColumn("mask", F.concat_ws(",", F.transform("mask", lambda s: F.concat_ws(":", s["start"].cast("string"), s["stop"].cast("string")))))
    con = duckdb.connect()
    con.register("conversations", conversations)
    want = con.execute(chat.OP9_SQL).fetchall()
    cols = [x[0] for x in con.description]
    assert sorted(map(str, want)) == sorted(str(tuple(r[c] for c in cols)) for r in got.collect())


def brute(rows, k, every):
    def ok(v):
        return v is not None and all(x is not None and np.isfinite(x) for x in v)

    v = [(i, [int(np.floor(256 * float(x))) for x in e]) for i, e in rows if i is not None and ok(e)]
    asked = {}
    for i, e in v:
        if i % every == 0:
            asked[i] = min(asked.get(i, e), e)
    out = []
    for q, e in asked.items():
        s = sorted(((-sum(a * b for a, b in zip(e, f, strict=True)), i) for i, f in v if i != q and len(f) == len(e)))[:k]
        out += [(q, r + 1, i, -p) for r, (p, i) in enumerate(s)]
    return sorted(out)


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    for scale in (0.0, 1.0):
        rows = [(i, [float(x) for x in rng.normal(size=8) * np.exp(scale * rng.normal())]) for i in range(400)]
        rows += [(500 + i, rows[10][1]) for i in range(40)] + [(10, rows[10][1]), (20, rows[3][1]), (600, [1e12] * 8), (610, [-1e12] * 8)]
        rows += [(700, None), (701, [None] * 8), (702, [float("nan")] * 8), (None, rows[0][1]), (710, [1.0, 2.0]), (720, [0.5, 0.5]), (730, []), (740, [0.0] * 8)]
        df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
        for cut in (0.3, 0.9, 5.0):
            got = topk.top_products(df, F.col("vec_id") % 10 == 0, seed_rows=64, block_queries=20, bucket_rows=37, coordinate_cut=cut).collect()
            assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == brute(rows, 5, 10), (scale, cut)


def test_topk_with_files_in_shuffled_order(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6) * np.exp(rng.normal())]) for i in range(900)] + [(1000 + i, [9.0, 8.0, 7.0, 6.0, 5.0, 4.0]) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    real = topk.materialize
    # many small files, each sorted as before, that follow one another in an order of their own
    monkeypatch.setattr(topk, "materialize", lambda d, name: real(d.repartition(60, F.xxhash64("id") % 60).sortWithinPartitions(F.desc("norm")) if "length" in name else d, name))
    for cut in (0.3, 0.9, 5.0):
        got = topk.top_products(df, F.col("vec_id") % 10 == 0, seed_rows=16, bucket_rows=64, coordinate_cut=cut).collect()
        assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == brute(rows, 5, 10), cut


def test_topk_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_products(df, F.col("vec_id") % 50 == 0).count() == 0
