import random

import numpy as np
from pyspark.sql import functions as F

from citeloom.llm import langid, quality


def labelled(n=300):
    random.seed(1)
    good = ["river", "stone", "light", "paper", "garden", "window", "letter", "music"]
    rows = []
    for i in range(n):
        y = i % 2
        t = " ".join(random.choice(good) for _ in range(30)) if y else " ".join(random.choice(good).upper() + "!!" for _ in range(30))
        rows.append((i, t, y))
    return rows


def test_descent_meets_the_optimality_conditions():
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(40, 6, replace=False)).astype(np.int32) for _ in range(60)]
    y = (rng.uniform(size=60) < 0.5).astype(int)
    w, b = quality.hinge_descent(rows, np.ones(40, np.float32), y, sweeps=3000, tolerance=1e-7)
    loss = lambda w, b: 0.5 * (w @ w + b * b) + sum(max(0, 1 - (1 if t else -1) * (w[x].sum() / np.sqrt(6) + b)) for x, t in zip(rows, y, strict=True))
    at = loss(w, b)
    for _ in range(200):
        assert loss(w + rng.normal(size=40) * 0.02, b + rng.normal() * 0.02) >= at - 1e-4


def test_quality_learns(spark):
    rows = labelled()
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:220]] + [(None, 1), (3, None), (0, 0)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = {r["doc_id"]: r for r in quality.score_quality(docs, model).collect()}
    assert all(got[i]["predicted"] == y and 0 <= got[i]["score"] <= 1 for i, _, y in rows[220:])


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (2, ""), (3, "w " * 60000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality.score_quality(docs, quality.fit(docs, none)).collect()
    assert len(rows) == 5 and all(abs(r["score"] - 0.5) < 1e-6 for r in rows)
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert all(r["score"] > 0.9 for r in quality.score_quality(docs, quality.fit(docs, one)).collect())
    assert quality.score_quality(docs.limit(0), quality.fit(docs, none)).count() == 0


def test_language(spark):
    random.seed(4)
    base = {"en": ["the", "house", "with", "thing", "other"], "de": ["das", "haus", "nicht", "schön", "über"], "fr": ["le", "maison", "avec", "être", "voilà"]}
    rows = [(i, " ".join(random.choice(base[g]) for _ in range(20)), g) for i, g in enumerate(list(base) * 60)]
    rows += [(900, None, "en"), (901, "123 !!", "en"), (902, "", None), (903, "Häuschen schöner übrigens", None), (904, "маленький", None), (905, "thing " * 50000, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("old"))
    model = langid.fit(df)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(df, model).collect()}
    assert all(got[i][0] == g for i, _, g in rows[:180])
    assert got[900] == got[901] == got[902] == ("und", 0.0) and got[903][0] == "de" and got[904][0] in base
    assert all(0 <= s <= 1 for _, s in got.values())
    empty = langid.fit(df.where("lang = 'xx'"))
    assert {r["lang_pred"] for r in langid.identify(df, empty).collect()} == {"und"}


def test_language_beyond_the_broadcast_scores_as_the_whole_model(spark):
    random.seed(6)
    rare = [f"{a}{b}{c}" for a in ("zor", "mik", "tal") for b in ("ven", "dul", "pas") for c in ("ix", "om", "ea")]
    rows = [(i, " ".join(random.choice(["the", "house", "with", "other"]) for _ in range(30)), "en") for i in range(200)]
    rows += [(300 + i, " ".join(random.choice(rare) for _ in range(8)), "xx") for i in range(12)] + [(400, "zorvenix talom", None), (401, None, None), (401, "the zorzor", "en"), (402, "123", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    said = lambda m: sorted((r["doc_id"], r["text"] or "", r["lang_pred"], round(r["score"], 4)) for r in langid.identify(df, m).collect())
    whole = said(langid.fit(df))
    assert all(x[2] == "xx" for x in whole if 300 <= x[0] < 401)
    for words, grams in ((6, 20), (6, 100_000), (100_000, 20)):
        assert said(langid.fit(df, max_words=words, max_grams=grams)) == whole


def test_backoff_uses_shorter_grams():
    m = langid.Model(["a", "b"], {"known": np.array([1.0, -1.0], np.float32)}, {"xyz": np.array([-2.0, 2.0], np.float32), "q": np.array([0.5, -0.5], np.float32)}, 0)
    assert m.vector("known").tolist() == [1.0, -1.0] and m.vector("qxyz").tolist() == [-1.5, 1.5] and m.vector("zzz").tolist() == [0.0, 0.0]
