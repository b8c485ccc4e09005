"""What must not grow with the input or the cores: tasks, repeated work."""

import random

from pyspark.sql import functions as F

from citeloom.operators import profiles as P


def test_cells_are_not_a_product_of_partitions(spark):
    rows = spark.range(40).select(*[F.when(F.col("id") % n == 0, "a").otherwise("b").alias(c) for c, n in zip("uvwx", (2, 3, 5, 7), strict=True)])
    out = P.cells(rows, {c: ["b", "a"] for c in "uvwx"})
    assert "CartesianProduct" not in out._jdf.queryExecution().executedPlan().toString()
    got = {tuple(r[c] for c in "uvwx"): (r["place"], r["n"]) for r in out.collect()}
    assert len(got) == 16 and got[("a", "a", "a", "a")] == (15, 1) and got[("b", "b", "b", "a")][0] == 1 and sum(n for _, n in got.values()) == 40


def test_edges_are_counted_once(spark):
    from citeloom.plans import graphs

    plan = graphs._edges(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_evaluations_count_who_met_once(spark, monkeypatch):
    from citeloom.operators import evaluation as E

    pairs = spark.range(400).select((F.col("id") % 20).alias("x"), F.floor(F.col("id") / 20).alias("y")).where("x <> y")
    shared = lambda n: pairs.where(F.col("y") % 3 == n).groupBy("x", "y").agg(F.count("*").alias("n")).where("n > 0").select("x", "y")
    near = pairs.withColumn("s", F.rand(1)).withColumn("rank", F.lit(1))
    seen = []
    draws = E.draws
    monkeypatch.setattr(E, "draws", lambda anchors, draw, met, k, *a, **kw: (seen.append(met), draws(anchors, draw, met, k, *a, **kw))[1])
    out = E.phantom_evaluation(near, shared(0), shared(1), (1, 2))
    plans = [t._jdf.queryExecution().optimizedPlan().toString() for t in [*seen, out]]
    assert seen and all("Range (0, 400" not in p for p in plans)


def test_ablation_counts_who_met_once(spark):
    from citeloom.operators import evaluation as E

    pairs = spark.range(400).select((F.col("id") % 20).alias("x"), F.floor(F.col("id") / 20).alias("y")).where("x <> y")
    near = spark.createDataFrame([(x, (x + 3) % 20, 0.5) for x in range(20)], "x long, y long, s double")
    shared = lambda n: pairs.where(F.col("y") % 3 == n).groupBy("x", "y").agg(F.count("*").alias("n")).select("x", "y")
    out = E.ablation({"a": near, "b": near}, shared(0), shared(1), (1,))
    assert "Range (0, 400" not in out._jdf.queryExecution().optimizedPlan().toString()
    rows = {r["method"]: (r["hits"], r["predictions"]) for r in out.collect()}
    unmet = [y for y in ((x + 3) % 20 for x in range(20)) if y % 3]
    assert set(rows) == {"a", "b", "uniform"} and rows["a"] == rows["b"] == (sum(y % 3 == 1 for y in unmet), len(unmet))


def test_search_reads_its_rows_once_and_looks_into_few_tiles(spark, monkeypatch):
    import numpy as np
    from pyspark.sql.classic.dataframe import DataFrame

    from citeloom.operators import semantic as S

    rng = np.random.default_rng(6)
    v = rng.normal(size=(700, 8))
    v[40:45] = v[3]  # copies, and one of them without a key
    v[60:64] = -v[3] * [[1], [2], [4], [8]]
    names = rng.permutation(700).tolist()
    names[3] = None
    rows = spark.createDataFrame(list(zip(names, v.tolist(), strict=True)), "id long, v array<double>")
    monkeypatch.setattr(DataFrame, "toPandas", lambda self: 1 / 0)
    got = {}
    for r in S.neighbours(rows, "id", "v", 2, block=100).collect():
        got.setdefault(r["x"], []).append((r["rank"], r["y"], round(r["s"], 9)))
    unit = v / np.sqrt((v * v).sum(1))[:, None]
    s = np.round(unit @ unit.T, 12)
    known = [i for i in range(700) if names[i] is not None]
    want = {names[i]: [(r + 1, y, round(-c, 9)) for r, (c, y) in enumerate(sorted((-s[i, j], names[j]) for j in known if i != j)[:2])] for i in known}
    assert {x: sorted(r) for x, r in got.items()} == want

    looked = []
    real = S.np.nonzero
    monkeypatch.setattr(S.np, "nonzero", lambda a: (looked.append(np.size(a)), real(a))[1])
    blocks = [type("Block", (), {"value": (np.arange(a, a + 100), unit[a : a + 100])}) for a in range(0, 700, 100)]
    i, y, c = S._nearest(np.arange(50), unit[:50], blocks, 2, tile=50, piece=16)
    assert 0 < sum(looked) < 0.8 * 50 * 700
    assert [y[i == r].tolist() for r in range(50)] == [[j for _, j in sorted((-s[r, j], j) for j in range(700) if j != r)[:2]] for r in range(50)]


def test_pairs_lie_in_as_many_tasks_as_the_input_is_large(spark, monkeypatch):
    from citeloom.operators import graph as G

    monkeypatch.setattr(G, "shuffle_parts", lambda df: 7, raising=False)
    random.seed(2)
    rows = [(random.choice([None, *range(30)]), random.choice([None, *range(12)]), random.choice([None, 1990, 1991])) for _ in range(300)]
    m = spark.createDataFrame(rows, "item long, member long, year int")
    out = G.pair_weights(m, year="year")
    assert out.rdd.getNumPartitions() == 28
    sets, w = {}, {}
    for item, member, year in set(rows):
        if item is not None:
            sets.setdefault(item, []).append((member, year))
    for team in sets.values():
        for a, year in team:
            for b, _ in team:
                if a is not None and b is not None and a < b:
                    one = w.setdefault((a, b), [0, 0.0, []])
                    one[0], one[1] = one[0] + 1, one[1] + 1 / (len(team) - 1)
                    one[2] += [] if year is None else [year]
    got = {(r["a"], r["b"]): (r["w"], round(r["wn"], 9), r["years"]) for r in out.collect()}
    assert got == {k: (n, round(x, 9), sorted(years)) for k, (n, x, years) in w.items()}


def test_counters_move_entries_once(spark, monkeypatch):
    monkeypatch.setattr(P, "shuffle_parts", lambda df: 7, raising=False)
    random.seed(3)
    rows = [(random.choice([None, *range(25)]), random.choice([None, *range(6)]), random.choice([None, 1990, 1991]), random.choice([None, 2, 3])) for _ in range(120)]
    rows += [(90, 77, 1990, 5), (91, None, 1990, 5), (92, 78, 1991, 4), (92, None, 1991, 4), (None, 79, 1992, 1)]
    out = P.member_counters(spark.createDataFrame(rows, "item long, member long, year int, count long"), "item", "member", "year", "count")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 2
    want = {}
    for m in {r[1] for r in rows} - {None}:
        mine = [r for r in rows if r[1] == m]
        once = {(i, c) for i, _, _, c in mine if i is not None}
        if once:
            team = {i: len({r[1] for r in rows if r[0] == i}) for i, _ in once}
            years = [r[2] for r in mine if r[2] is not None]
            want[m] = (len(mine), max(years, default=None), sum(r[3] or 0 for r in mine), sum(c or 0 for i, c in once if team[i] > 1), sum(team[i] == 1 for i, c in once))
    assert {r["member"]: tuple(r)[1:] for r in out.collect()} == want and 77 in want and 79 not in want


def test_documents_are_parsed_once(spark):
    from citeloom.functions import records

    docs = spark.createDataFrame([('{"id": "https://w/W1", "display_name": "t", "authorships": [{"author": {"display_name": "n"}}], "concepts": [{"display_name": "c"}]}',), ("{broken",), (None,)], "doc string")
    out = docs.select(records.compact_record(F.col("doc"), F.lit("v")).alias("r")).select("r.*")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
    got = [r for r in out.select("id", "title", "venue", "cited_by_count", F.col("authors.name").alias("names"), F.col("concepts.name").alias("concepts")).collect()]
    assert tuple(got[0]) == ("W1", "t", "v", 0, ["n"], ["c"]) and [tuple(r) for r in got[1:]] == [(None, "", "v", 0, [], [])] * 2


def test_terms_are_counted_before_they_are_strings(spark):
    from citeloom.operators import text_models as M
    from citeloom.plans import semantics

    random.seed(5)
    rows = [(random.choice([None, "a", "b"]), random.choice([None, "", *[" ".join(random.choices(["one", "two", "x", "the", "sea-side", "été"], k=n)) for n in (1, 2, 9, 40)]])) for _ in range(60)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    words = M.tokens(F.col("text"))
    want = sorted(map(tuple, M.term_counts(docs.withColumn("_w", words), "lang", M.one_and_two(F.col("_w"))).collect()), key=str)
    for at_once in (1, 7, 1 << 20):
        assert sorted(map(tuple, M.one_and_two_counts(docs, "lang", words, at_once).collect()), key=str) == want and want
    assert "Generate" not in semantics._counts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
