"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from .base import query, table


@query("norm_title", """SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))) AS title_md5 FROM documents""")
def norm_title(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.norm_title(F.col("text")).cast("binary")).alias("title_md5"))


@query("record_id", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'doi:10.1/' || doc_id ELSE 'h:' || sha1(trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) || '|' || coalesce(CAST(n_chars AS VARCHAR), 'None'))[1:16] END AS record_id FROM documents""")
def record_id(spark, d):
    doi = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("10.1/"), F.col("doc_id").cast("string")))
    return table(spark, d, "documents").select("doc_id", T.record_id(doi, F.col("text"), F.col("n_chars")).alias("record_id"))


_PLAIN_SQL = "lower(text)"
for _a, _b in T.PLAIN_LETTERS.items():
    _PLAIN_SQL = f"replace({_PLAIN_SQL}, '{_a}', '{_b}')"
_NAME_SQL = f"trim(regexp_replace(regexp_replace(strip_accents({_PLAIN_SQL}), '[^a-z\\s,.\\-]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("norm_name", f"SELECT doc_id, md5({_NAME_SQL}) AS name_md5 FROM documents")
def norm_name(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.norm_name(F.col("text")).cast("binary")).alias("name_md5"))


_PART_NAME = "replace(p_name || ' ' || p_brand || CASE WHEN p_size % 4 = 0 THEN ', ' || p_type ELSE ' ' || p_type END, '#', '')"


@query(
    "name_keys",
    f"""WITH n AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(lower({_PART_NAME}), '[^a-z\\s,.\\-]', ' ', 'g'), '\\s+', ' ', 'g')) AS n FROM part),
l AS (SELECT p_partkey, CASE WHEN contains(n, ',') OR NOT contains(n, ' ') THEN n
  ELSE regexp_extract(n, '([^ ]+)$', 1) || ', ' || regexp_replace(n, ' [^ ]+$', '') END AS last_first FROM n)
SELECT p_partkey, last_first, trim(split_part(last_first, ',', 1)) AS surname,
  trim(split_part(last_first, ',', 1)) AS block_surname, trim(regexp_replace(last_first, '^[^,]*,?', ''))[1:1] AS block_initial,
  array_to_string(list_filter(string_split_regex(CASE WHEN contains(last_first, ',') THEN regexp_replace(last_first, '^[^,]*,', '') ELSE '' END, '[\\s.]+'), lambda x: x <> ''), ' ') AS given
FROM l""",
)
def name_keys(spark, d):
    name = F.replace(F.concat("p_name", F.lit(" "), "p_brand", F.when(F.col("p_size") % 4 == 0, F.lit(", ")).otherwise(F.lit(" ")), "p_type"), F.lit("#"), F.lit(""))
    key = T.last_first(F.col("n"))
    block = T.name_block(F.col("n"))
    return table(spark, d, "part").select("p_partkey", name.alias("n")).select("p_partkey", key.alias("last_first"), T.surname(F.col("n")).alias("surname"), block["surname"].alias("block_surname"), block["initial"].alias("block_initial"), F.concat_ws(" ", T.given_names(key)).alias("given"))


@query(
    "entity_keys",
    r"""WITH k AS (SELECT c_custkey,
  CASE WHEN c_custkey % 3 = 0 THEN 'A' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') END AS id,
  CASE WHEN c_custkey % 3 = 1 THEN 'https://orcid.org/0000-000' || c_custkey % 10 || '-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || '-123x' END AS orc,
  lower(c_mktsegment) AS seg FROM customer),
e AS (SELECT c_custkey, coalesce(lower(id), lower(nullif(upper(regexp_extract(orc, '(\d{4}-\d{4}-\d{4}-\d{3}[\dxX])', 1)), '')), CASE WHEN length(regexp_replace(seg, '[^a-z]', '', 'g')) >= 5 THEN seg END, '') AS entity,
  nullif(upper(regexp_extract(orc, '(\d{4}-\d{4}-\d{4}-\d{3}[\dxX])', 1)), '') AS orcid FROM k)
SELECT c_custkey, entity, orcid, CASE WHEN entity = '' THEN 'empty' WHEN regexp_full_match(entity, 'a\d{8,}') THEN 'id' WHEN regexp_full_match(entity, '\d{4}-\d{4}-\d{4}-\d{3}[\dxX]') THEN 'orcid' ELSE 'name' END AS kind,
  coalesce(orcid, CASE WHEN length(entity) = 19 AND entity[5:5] = '-' THEN entity END) AS orcid_of_key FROM e""",
)
def entity_keys(spark, d):
    c = table(spark, d, "customer")
    ident = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("A"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")))
    orc = F.when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("https://orcid.org/0000-000"), (F.col("c_custkey") % 10).cast("string"), F.lit("-"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"), F.lit("-123x")))
    out = c.select("c_custkey", T.entity_key(ident, orc, F.col("c_mktsegment")).alias("entity"), T.orcid(orc).alias("orcid"))
    return out.withColumn("kind", T.key_kind(F.col("entity"))).withColumn("orcid_of_key", T.orcid_of_key(F.col("entity"), F.col("orcid")))


_FRONT_SQL_T = "lower(regexp_replace(trim(t), '\\.+$', ''))"


@query(
    "front_matter",
    f"""WITH t AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Editorial: ' || p_name WHEN 1 THEN p_name WHEN 2 THEN 'Table of Contents.' WHEN 3 THEN 'IEEE Transactions on ' || p_name ELSE 'A ' || p_name || ' index' END AS t FROM part)
SELECT p_partkey, {_FRONT_SQL_T} = '' OR {_FRONT_SQL_T} IN ({", ".join("'" + x.replace("'", "''") + "'" for x in T.FRONT_MATTER_TITLES)})
  OR regexp_matches({_FRONT_SQL_T}, '{T.FRONT_MATTER_START.replace("'", "''")}') OR (regexp_matches({_FRONT_SQL_T}, '{T.PERIODICAL_NAME}') AND length({_FRONT_SQL_T}) < 80) AS front FROM t""",
)
def front_matter(spark, d):
    k = F.col("p_partkey") % 5
    t = F.when(k == 0, F.concat(F.lit("Editorial: "), "p_name")).when(k == 1, F.col("p_name")).when(k == 2, "Table of Contents.").when(k == 3, F.concat(F.lit("IEEE Transactions on "), "p_name")).otherwise(F.concat(F.lit("A "), "p_name", F.lit(" index")))
    return table(spark, d, "part").select("p_partkey", T.is_front_matter(t).alias("front"))


@query("url_parts", r"""SELECT page_id, list_extract(string_split(url, '/'), -1) AS tail, sha1(lower(url))[1:16] AS url_hash FROM pages""")
def url_parts(spark, d):
    return table(spark, d, "pages").select("page_id", T.tail(F.col("url")).alias("tail"), T.short_hash(F.col("url")).alias("url_hash"))


@query(
    "doi_functions",
    r"""WITH t AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN ' https://doi.org/10.1234/AB.' || c_custkey WHEN 1 THEN 'doi:10.1234/x' || c_custkey WHEN 2 THEN 'NaN' WHEN 3 THEN '' ELSE '10.99999/Q(' || c_custkey || ')' END AS doi FROM customer),
n AS (SELECT c_custkey, doi, regexp_replace(lower(trim(doi)), '^(https?://(dx\.)?doi\.org/|doi:)', '') AS x FROM t)
SELECT c_custkey, CASE WHEN x NOT IN ('', 'nan', 'none', 'null') THEN x END AS doi, array_to_string(regexp_extract_all('see ' || doi || ' and 10.5555/abc, end', '\b(10\.\d{4,9}/[-._;()/:A-Za-z0-9]+)\b', 1), ' ') AS found FROM n""",
)
def doi_functions(spark, d):
    k = F.col("c_custkey") % 5
    key = F.col("c_custkey").cast("string")
    doi = F.when(k == 0, F.concat(F.lit(" https://doi.org/10.1234/AB."), key)).when(k == 1, F.concat(F.lit("doi:10.1234/x"), key)).when(k == 2, "NaN").when(k == 3, "").otherwise(F.concat(F.lit("10.99999/Q("), key, F.lit(")")))
    return table(spark, d, "customer").select("c_custkey", T.norm_doi(doi).alias("doi"), F.concat_ws(" ", T.dois_in(F.concat(F.lit("see "), doi, F.lit(" and 10.5555/abc, end")))).alias("found"))


@query(
    "name_lists",
    """WITH m AS (SELECT l_orderkey, list(p_name || ' ' || p_partkey ORDER BY l_linenumber, p_partkey, l_suppkey, l_quantity) AS names FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN len(names) <= 4 THEN array_to_string(names, '; ') ELSE array_to_string(names[1:3], '; ') || '; … ; ' || names[-1] || ' (+' || (len(names) - 4) || ')' END AS short_names, lower(array_to_string(names, '; ')) AS full_names FROM m""",
)
def name_lists(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    one = F.struct("l_linenumber", "p_partkey", "l_suppkey", "l_quantity", F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("name"))
    m = li.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["name"]).alias("names"))
    return m.select("l_orderkey", T.short_list(F.col("names")).alias("short_names"), T.full_list(F.col("names")).alias("full_names"))


@query("inverted_text", "SELECT conv_id, turn, array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''), ' ') AS rebuilt FROM conversations")
def inverted_text(spark, d):
    """Each turn's words as a map word -> positions, and back."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.filter(F.split("text", r"\s+"), lambda x: x != "").alias("w"))
    inverted = F.map_from_entries(F.transform(F.array_distinct("w"), lambda x: F.struct(x, F.filter(F.transform("w", lambda y, i: F.when(y == x, i)), lambda p: p.isNotNull()))))
    return c.select("conv_id", "turn", T.text_of_positions(inverted).alias("rebuilt"))


@query(
    "number_functions",
    """SELECT o_orderkey, 1.0 + ln(1 + CAST(floor(o_totalprice / 1000) AS BIGINT)) AS damped, round(pow(0.5, greatest(0, 2001 - year(o_orderdate)) / 6.0), 9) AS recency,
 CAST(floor(year(o_orderdate) / 5.0) * 5 AS INTEGER) AS five, CAST(floor(year(o_orderdate) / 10.0) * 10 AS INTEGER) AS ten, round(greatest(-3.0, least(3.0, log2(o_totalprice / 100000))), 9) AS clamped,
 round(o_totalprice / 1e9 * 1e4, 2) AS scaled FROM orders""",
)
def number_functions(spark, d):
    year = F.year("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", T.damped_weight(F.floor(F.col("o_totalprice") / 1000)).alias("damped"), F.round(T.recency_weight(year, 2001), 9).alias("recency"), T.year_bin(year).alias("five"), T.year_bin(year, 10).alias("ten"), F.round(T.clamped_log2(F.col("o_totalprice") / 100000), 9).alias("clamped"), T.scaled(F.col("o_totalprice") / 1e9).alias("scaled"))


@query("golden_hue", "SELECT n_nationkey, printf('hsl(%.1f, %d%%, %d%%)', (n_nationkey * 137.508) % 360, CASE WHEN n_nationkey % 2 = 0 THEN 70 ELSE 55 END, CASE WHEN n_nationkey % 3 = 0 THEN 58 ELSE 50 END) AS colour, upper(n_name[1:1]) || lower(n_name[2:]) AS label FROM nation")
def golden_hue(spark, d):
    return table(spark, d, "nation").select("n_nationkey", T.golden_hue(F.col("n_nationkey")).alias("colour"), T.title_case(F.col("n_name")).alias("label"))


@query("json_props", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query(
    "html_sections",
    r"""SELECT page_id, trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) AS title, CAST(len(regexp_extract_all(html, '(?s)<p[ >].*?</p>')) AS INTEGER) AS paragraphs, CAST(len(regexp_extract_all(html, '<h[1-6][ >]')) AS INTEGER) AS headings FROM pages""",
)
def html_sections(spark, d):
    return table(spark, d, "pages").select("page_id", F.trim(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)).alias("title"), F.size(F.regexp_extract_all("html", F.lit(r"(?s)(<p[ >].*?</p>)"), 1)).alias("paragraphs"), F.regexp_count("html", F.lit("<h[1-6][ >]")).alias("headings"))


@query(
    "concept_tokens",
    """WITH c AS (SELECT p_partkey, p_name AS name, p_size % 5 AS level, (p_partkey % 11) / 10.0 AS score FROM part),
r AS (SELECT p_partkey, regexp_replace(lower(name), '[ -]', '_', 'g') AS token, CASE WHEN level >= 2 THEN greatest(1, CAST(round_even(score * 5, 0) AS INTEGER)) ELSE 0 END AS times FROM c)
SELECT p_partkey, CAST(times AS INTEGER) AS tokens, array_to_string(list_transform(range(0, times), lambda i: token), ' ') AS text FROM r""",
)
def concept_tokens(spark, d):
    concept = F.array(F.struct(F.col("p_name").alias("name"), (F.col("p_size") % 5).alias("level"), ((F.col("p_partkey") % 11) / 10.0).alias("score")))
    tokens = T.concept_tokens(concept)
    return table(spark, d, "part").select("p_partkey", F.size(tokens).alias("tokens"), F.concat_ws(" ", tokens).alias("text"))


@query("missing_values", "SELECT event_id, value IS NULL OR isnan(value) AS no_value, coalesce(event_type, '') = '' AS no_type, CAST(floor(coalesce(value, 0)) AS BIGINT) AS whole, event_type[1:3] AS cut, coalesce(event_type, '') || CASE WHEN coalesce(props, '') <> '' THEN ' [SEP] ' || props ELSE '' END AS joined FROM events")
def missing_values(spark, d):
    return table(spark, d, "events").select("event_id", T.missing_number(F.col("value")).alias("no_value"), T.missing_text(F.col("event_type")).alias("no_type"), T.count_or_zero(F.floor("value")).alias("whole"), T.cut_title(F.col("event_type"), 3).alias("cut"), T.joined_text(F.col("event_type"), F.col("props")).alias("joined"))


@query("alias_table", """WITH g AS (SELECT n_regionkey, list(n_name ORDER BY n_nationkey) AS ids FROM nation GROUP BY n_regionkey), u AS (SELECT n_regionkey, lower(ids[1]) AS canonical, unnest(ids[2:]) AS k, len(ids) AS n FROM g)
SELECT lower(k) AS key, canonical FROM u WHERE n >= 2""")
def alias_table(spark, d):
    ids = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"])
    return table(spark, d, "nation").groupBy("n_regionkey").agg(ids.alias("ids")).select(F.explode(T.alias_table(F.col("ids"))).alias("a")).select("a.key", "a.canonical")
