import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as P
from citeloom.llm import bpe, neardup, quality, secret_scan
from citeloom.llm._common import fold

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")


def test_registered():
    q = entry.queries()
    assert "pipeline" in q and {n.split("_")[0] for n in q if n.startswith("op")} == {f"op{i}" for i in range(1, 11)}
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "secrets", "mixing", "bpe"]


def test_stages_against_plain_steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(fold("doc_id", 5) != 0)
    one = P.drop_low_quality(spark, docs, SF).cache()
    model, f = quality.fit(docs, labels), quality.Features()
    good = {r["doc_id"] for r in docs.collect() if model.score(f(r["text"])) >= 0.3}
    assert {r["doc_id"] for r in one.collect()} == good and one.columns == docs.columns
    two = P.drop_near_duplicates(spark, one, SF).cache()
    rows = [(r["doc_id"], r["text"]) for r in one.collect()]
    from test_neardup import brute

    assert {r["doc_id"] for r in two.collect()} == {c if n else d for d, n, c in brute(rows, 5)}
    three = P.mask_secrets(spark, two, SF).cache()
    assert three.count() == two.count() and all(not secret_scan.all_spans(r["text"])[1] for r in three.collect())
    four = P.mix_sources(spark, three, SF).cache()
    assert four.columns == docs.columns and {r["doc_id"] for r in four.collect()} <= {r["doc_id"] for r in three.collect()}
    five = P.encode_tokens(spark, four, SF)
    assert five.count() == four.count() and neardup.SKETCH and five.where(F.size("token_ids") != F.col("n_tokens")).count() == 0
    assert bpe.decode(five).where(F.sha2("decoded", 256) != F.col("decoded_sha256")).count() == 0


def awkward(spark):
    long = "plain words of a very long text " * 20_000
    rows = [(1, None, "en", "a", None), (2, "", "en", None, 0), (3, long, "en", "a", len(long)), (3, long, "en", "a", len(long)), (4, "key: password=Abcdefgh12 and more words here", None, "b", 45), (None, "some words without any id at all", "en", "b", 31), (5, " \t ", "de", "b", 3)]
    rows += [(10 + i, f"document {i} has its own words and number {i * 7} of {i * 31}", "en", "ab"[i % 2], 50) for i in range(20)]
    names = ["_before", "_score", "_predicted", "score", "predicted", "_set_key", "_mix_tag", "tag", "row", "key", "mark", "old_length", "copies"]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.concat(F.lit(f"{n}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(n) for n in names]), names


def test_stages_with_awkward_rows_and_clashing_names(spark, tmp_path):
    df, names = awkward(spark)
    spark.createDataFrame([(10 + i, 1) for i in range(20)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/none/labels.parquet")

    def held(out):
        assert out.columns == df.columns
        rows = out.collect()
        assert all(r[n] == f"{n}:{'-' if r['doc_id'] is None else r['doc_id']}" for r in rows for n in names)
        return sorted((r["doc_id"] or 0, r["text"] or "") for r in rows)

    every = held(df)
    assert held(P.drop_low_quality(spark, df, f"{tmp_path}/none")) == every  # nothing to learn from
    assert held(P.drop_low_quality(spark, df, str(tmp_path))) == every  # one class
    once = held(P.drop_near_duplicates(spark, df, str(tmp_path)))
    assert once == [x for i, x in enumerate(every) if i == 0 or x[0] != 3 or every[i - 1][0] != 3]
    masked = P.mask_secrets(spark, df, str(tmp_path))
    held(masked)
    for r in masked.collect():
        if r["doc_id"] == 4:
            assert r["text"] == "key: [secret] and more words here" and r["n_chars"] == 45 + len(r["text"]) - len("key: password=Abcdefgh12 and more words here")
    assert {r["n_chars"] for r in masked.where("doc_id = 1").collect()} == {None}
    mixed = held(P.mix_sources(spark, df, str(tmp_path)))
    assert mixed and not {1, 2, 5} & {d for d, _ in mixed}
    assert P.encode_tokens(spark, df, str(tmp_path)).count() == df.count()


def test_stages_of_an_empty_table(spark, tmp_path):
    df, _ = awkward(spark)
    df.where("doc_id < 0").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
