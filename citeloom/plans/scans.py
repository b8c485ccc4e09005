"""Queries of readers and writers over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources import readers, writers
from ..sources.tables import shared_folder
from .base import query, table


@query("scan_parquet", "SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice >= 400000")
def scan_parquet(spark, d):
    return table(spark, d, "orders").where("o_totalprice >= 400000").select("o_orderkey", "o_custkey")


@query("scan_json_lines", "SELECT c_custkey, c_name, c_mktsegment, 'customer' AS _source FROM customer")
def scan_json_lines(spark, d):
    """customer written as JSON lines and read again."""
    at = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    writers.write_records(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), at)
    return readers.json_lines(spark, [at], "c_custkey long, c_name string, c_mktsegment string", "customer")


@query("scan_union_sources", "SELECT s_suppkey AS key, s_name AS name, 'supplier' AS _source FROM supplier WHERE s_suppkey % 10 <> 0 UNION ALL SELECT c_custkey, c_name, 'customer' FROM customer WHERE c_custkey % 10 <> 0")
def scan_union_sources(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.lit("supplier").alias("_source"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.lit("customer").alias("_source"))
    return readers.union_sources([s, c], F.col("key") % 10 == 0)


@query("scan_keys_since", "SELECT DISTINCT o_custkey FROM orders WHERE coalesce(year(o_orderdate), 0) >= 2000")
def scan_keys_since(spark, d):
    o = table(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    return readers.keys_since(o, "o_custkey", "year", 2000)


@query("scan_points", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (1, 5, 77, 100)")
def scan_points(spark, d):
    return readers.point_rows(table(spark, d, "part"), "p_partkey", [1, 5, 77, 100]).select("p_partkey", "p_name")


@query("scan_documents", "SELECT n_nationkey AS id, n_name AS name FROM nation")
def scan_documents(spark, d):
    """nation as one nested JSON document, and its rows again."""
    at = f"{shared_folder(spark)}/document-{uuid.uuid4().hex}"
    rows = table(spark, d, "nation").select(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")).alias("n"))
    rows.agg(F.array_sort(F.collect_list("n")).alias("nodes")).write.json(at)  # one document
    return readers.document_rows(spark, at, "nodes", "nodes array<struct<id:int,name:string>>")


@query("full_text_sections", r"""WITH p AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '(?s)<p(?:\s[^>]*)?>(.*?)</p>', 1), lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '') AS t FROM pages)
SELECT page_id, len(t) AS paragraphs, md5(array_to_string(t, chr(10))) AS text_md5 FROM p""")
def full_text_sections(spark, d):
    t = readers.full_text(F.col("html"), section="no-such-section", paragraph="p")["plaintext"]
    out = table(spark, d, "pages").select("page_id", t.alias("t"))
    return out.select("page_id", F.when(F.col("t") == "", 0).otherwise(F.size(F.split("t", "\n"))).cast("long").alias("paragraphs"), F.md5(F.col("t").cast("binary")).alias("text_md5"))


@query("strict_records", "SELECT event_id, value FROM events")
def strict_records(spark, d):
    """events through the strict writer and back."""
    at = f"{shared_folder(spark)}/strict-{uuid.uuid4().hex}"
    writers.write_strict(table(spark, d, "events").select("event_id", "value"), at)
    return spark.read.schema("event_id long, value double").json(at)


@query("versioned_update", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal + 1 ELSE s_acctbal END AS s_acctbal FROM supplier")
def versioned_update(spark, d):
    """A table, then an upsert of half its rows as a new version."""
    t = writers.Versions(spark, f"{shared_folder(spark)}/versions-{uuid.uuid4().hex}")
    s = table(spark, d, "supplier").select("s_suppkey", "s_acctbal", F.lit(0).alias("at"))
    t.write(s)
    return writers.upsert(t, s.where("s_suppkey % 2 = 0").select("s_suppkey", (F.col("s_acctbal") + 1).alias("s_acctbal"), F.lit(1).alias("at")), ["s_suppkey"], [F.desc("at")]).select("s_suppkey", "s_acctbal")


@query("quantised_table", "WITH e AS (SELECT vec_id, embedding, greatest(1e-8, list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))))) AS s FROM embeddings) SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: abs(s * round_even(CAST(x AS DOUBLE) / s * 127, 0) / 127 - CAST(x AS DOUBLE)))), 6) AS error FROM e")
def quantised_table(spark, d):
    """The absolute error of the quantised vectors."""
    e = table(spark, d, "embeddings")
    s = V.scale(F.col("embedding"))
    back = V.from_int8(V.to_int8(F.col("embedding")), s)
    return e.select("vec_id", F.round(F.aggregate(F.zip_with(back, "embedding", lambda a, b: F.abs(a - b.cast("double"))), F.lit(0.0), lambda t, x: t + x), 6).alias("error"))


@query("written_and_read", "SELECT n_nationkey, n_name, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey END AS region FROM nation")
def written_and_read(spark, d):
    """A column list as Parquet, then as JSON records with their nulls, and back."""
    at = f"{shared_folder(spark)}/written-{uuid.uuid4().hex}"
    n = table(spark, d, "nation").select("n_nationkey", "n_name", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey")).alias("region"), F.lit("x").alias("left_out"))
    writers.write_columns(n, f"{at}/columns", ["n_name", "region", "n_nationkey", "not_there"])
    writers.write_records(spark.read.parquet(f"{at}/columns"), f"{at}/records")
    return spark.read.schema("n_nationkey int, n_name string, region int").json(f"{at}/records")


@query("enabled_entries", "SELECT 's' || n_nationkey AS slug, n_name AS name FROM nation WHERE n_nationkey % 4 <> 1")
def enabled_entries(spark, d):
    """Entries of a configuration, without those that are switched off."""
    rows = table(spark, d, "nation").select("n_nationkey", "n_name").limit(1000).collect()  # a configuration, 1000 entries at most
    entries = [{"slug": f"s{r['n_nationkey']}", "name": r["n_name"], **({"enabled": r["n_nationkey"] % 4 != 1} if r["n_nationkey"] % 2 else {})} for r in rows]
    return readers.config_rows(spark, entries, "slug string, name string")
