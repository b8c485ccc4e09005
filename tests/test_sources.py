import json

from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from citeloom.operators.ordering import global_row_number, running_share
from citeloom.sources import readers as R
from citeloom.sources import writers as W
from citeloom.streaming.latest import keep_last


def test_tolerant_lines(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"title": "a", "year": 2000}\nbroken {\n{"title": "b"}\n')
    rows = R.json_lines(spark, [str(p), str(tmp_path / "none.jsonl")], source="one")
    assert sorted((r["title"], r["year"], r["_source"]) for r in rows.collect()) == [("a", 2000, "one"), ("b", None, "one")]
    assert R.json_lines(spark, [str(tmp_path / "none")]).count() == 0


def test_documents_and_config(spark, tmp_path):
    p = tmp_path / "g.json"
    p.write_text(json.dumps({"nodes": [{"id": 1}, {"id": 2}]}))
    assert [r["id"] for r in R.document_rows(spark, str(p), "nodes", "nodes array<struct<id:int>>").collect()] == [1, 2]
    assert [r["slug"] for r in R.config_rows(spark, [{"slug": "a"}, {"slug": "b", "enabled": False}], "slug string").collect()] == ["a"]


def test_article_markup(spark):
    x = "<a><ce:section><ce:section-title>Intro</ce:section-title><ce:para>One <b>two</b></ce:para></ce:section><ce:keyword>k1</ce:keyword></a>"
    r = spark.createDataFrame([(x,), ("<a><para>only</para></a>",)], "x string").select(R.full_text(F.col("x")).alias("t")).collect()
    assert r[0]["t"]["sections"][0]["heading"] == "Intro" and r[0]["t"]["plaintext"] == "One two" and r[0]["t"]["keywords"] == ["k1"]
    assert r[1]["t"]["plaintext"] == "only"


def test_paged_source(spark):
    schema = StructType([StructField("q", StringType()), StructField("n", IntegerType())])

    def fetch(query, page):
        return [(query["q"], page)] if page < query["pages"] else []

    spark.dataSource.register(R.paged_source("fake_pages", schema, fetch, [{"q": "a", "pages": 2}, {"q": "b", "pages": 1}], rate=1000.0))
    assert sorted(map(tuple, spark.read.format("fake_pages").load().collect())) == [("a", 0), ("a", 1), ("b", 0)]


def test_retries_and_pace():
    calls, pauses = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise R.Busy(5.0 if len(calls) == 1 else None)
        return "ok"

    assert R.with_retries(call, sleep=pauses.append) == "ok" and pauses == [5.0, 4.0]
    now, slept = [0.0], []
    pace = R.Pace(2.0, clock=lambda: now[0], sleep=slept.append)
    pace.wait()
    pace.wait()
    assert slept == [0.5]


def test_versions_and_upsert(spark, tmp_path):
    t = W.Versions(spark, str(tmp_path / "t"))
    a = spark.createDataFrame([(1, 1, "x"), (2, 1, "y")], "k int, at int, v string")
    W.upsert(t, a, ["k"], [F.desc("at")])
    W.upsert(t, spark.createDataFrame([(1, 2, "z")], "k int, at int, v string"), ["k"], [F.desc("at")])
    assert sorted(map(tuple, t.read().collect())) == [(1, 2, "z"), (2, 1, "y")]
    assert [r["k"] for r in W.remaining(spark.createDataFrame([(2,), (3,)], "k int"), t, "k").collect()] == [3]


def test_stream_equals_batch(spark, tmp_path):
    for i, rows in enumerate([[(1, 1), (2, 5)], [(1, 3), (2, 4)]]):
        spark.createDataFrame(rows, "k int, at int").coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    stream = spark.readStream.schema("k int, at int").option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    t = W.Versions(spark, str(tmp_path / "out"))
    keep_last(stream, t, ["k"], [F.desc("at")], str(tmp_path / "cp")).awaitTermination()
    assert sorted(map(tuple, t.read().collect())) == [(1, 3), (2, 5)]


def test_global_order(spark):
    df = spark.range(100).withColumn("w", F.col("id") % 7).repartition(5)
    assert all(r["n"] == r["id"] for r in global_row_number(df, [F.col("id")], "n", 0).collect())
    last = running_share(df, [F.col("id")], "w").orderBy(F.desc("id")).first()
    assert abs(last["share"] - 1) < 1e-12


def test_cursor_and_offset_sources(spark):
    schema = StructType([StructField("q", StringType()), StructField("n", IntegerType())])

    def by_cursor(query, cursor, columns):
        at = 0 if cursor == "*" else int(cursor)
        assert columns == ["q", "n"]
        rows = [(query["q"], n) for n in range(at, min(at + 3, query["n"]))]
        return rows, str(at + 3) if at + 3 < query["n"] else None

    spark.dataSource.register(R.cursor_source("fake_cursor", schema, by_cursor, [{"q": "a", "n": 7}, {"q": "b", "n": 0}], rate=5000.0))
    assert sorted(map(tuple, spark.read.format("fake_cursor").load().collect())) == [("a", n) for n in range(7)]

    def by_offset(query, offset, size):
        return [(query["q"], n) for n in range(offset, min(offset + size, query["n"]))], query.get("total")

    queries = [{"q": "capped", "n": 50, "total": 50}, {"q": "short", "n": 4}, {"q": "total", "n": 30, "total": 8}]
    spark.dataSource.register(R.offset_source("fake_offset", schema, by_offset, queries, rate=5000.0, size=4, cap=10))
    got = sorted(map(tuple, spark.read.format("fake_offset").load().collect()))
    assert got == [("capped", n) for n in range(10)] + [("short", n) for n in range(4)] + [("total", n) for n in range(8)]


def test_lookups_keep_what_was_refused(spark, tmp_path):
    def fetch(k):
        if k == "none":
            raise R.Missing
        if k == "closed":
            raise R.Denied
        if k == "down":
            raise ValueError if k == "x" else R.Busy(0.0)
        return len(k)

    keys = spark.createDataFrame([(k,) for k in ("none", "closed", "down", "abc", "de")], "k string")
    got = R.looked_up(keys, "k", fetch, "long", rate=10_000.0)
    table = W.Versions(spark, str(tmp_path / "answers"))
    table.write(got)
    said = {r["k"]: (r["value"], r["status"]) for r in table.read().collect()}
    assert said == {"none": (None, "missing"), "closed": (None, "denied"), "down": (None, "failed"), "abc": (3, "ok"), "de": (2, "ok")}
    assert [r["k"] for r in W.unsettled(keys, table, "k").collect()] == ["down"]


def test_steps_are_done_once(spark, tmp_path):
    table, calls = W.Versions(spark, str(tmp_path / "step")), []

    def rows():
        calls.append(1)
        return spark.range(len(calls))

    assert W.write_once(table, rows).count() == 1 and W.write_once(table, rows).count() == 1 and len(calls) == 1
    assert W.write_once(table, rows, force=True).count() == 2


def test_first_answer_and_paces():
    import asyncio
    import time

    def fetch(n):
        if n == "1":
            raise R.Missing
        return None if n == "2" else f"S{n}"

    assert R.first_answer(["1", "2", "3", "4"], fetch, R.Pace(10_000.0)) == "S3" and R.first_answer(["1"], fetch, R.Pace(10_000.0)) is None

    async def three():
        pace = R.AsyncPace(50.0)
        begin = time.monotonic()
        await asyncio.gather(*[pace.wait() for _ in range(3)])
        return time.monotonic() - begin

    assert asyncio.run(three()) >= 0.04


def test_quantiles_of_groups_against_sorting(spark):
    import random

    from citeloom.operators.ordering import group_quantiles, tie_rank

    r = random.Random(2)
    rows = [(r.choice("aab") if r.random() < 0.9 else None, float(r.randint(0, 9)) if r.random() < 0.95 else None) for _ in range(500)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {x["g"]: (x["m"], x["q"], x["low"]) for x in group_quantiles(df, ["g"], "v", {"m": 0.5, "q": 0.9, "low": 0.5}, lower=("low",)).collect()}
    for g in ("a", "b", None):
        v = sorted(x for k, x in rows if k == g and x is not None)

        def at(q, v=v):
            i = q * (len(v) - 1)
            return v[int(i)] + (v[min(int(i) + 1, len(v) - 1)] - v[int(i)]) * (i - int(i))

        assert all(abs(a - b) < 1e-9 for a, b in zip(got[g], (at(0.5), at(0.9), v[(len(v) - 1) // 2]), strict=True))
    for x in tie_rank(df, "v", "k").collect():
        if x["v"] is not None:
            assert x["k"] == 1 + sum(y is not None and y > x["v"] for _, y in rows)
