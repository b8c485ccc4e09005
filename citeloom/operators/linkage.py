"""Record clustering, alias resolution and their audits."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import materialize
from .graph import connected_components
from .pairs import chunked, expanded, sharing


def common_length(a: str, b: str) -> int:
    """Longest common subsequence, by bit vectors."""
    if len(a) > len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & places.get(c, 0)
        v = (v + u | v - u) & full
    return len(a) - bin(v).count("1")


def indel_ratio(a: str, b: str) -> float:
    """100 * 2 * common / (|a| + |b|)."""
    return 100.0 if not a and not b else 200.0 * common_length(a, b) / (len(a) + len(b))


def greedy_clusters(rows: DataFrame, block: Sequence[str], key: str, title: str, names: str, order: str, threshold: float = 95.0) -> DataFrame:
    """key and cluster (the key of its seed). Within a block, in order, the first free row is a seed; a later free row joins it if their titles' ratio reaches threshold and they share a name. Not transitive. Rows with a null block, or an empty title, stay alone. Rows of one title and one set of names are compared once."""
    kind = rows.schema[key].dataType.simpleString()
    alone = F.lit(False)
    for c in block:
        alone = alone | F.col(c).isNull()
    # a row without any name shares none, so it can't join a seed nor be joined
    alone = alone | (F.coalesce(F.col(title), F.lit("")) == "") | (F.size(F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda x: x != "")) == 0)
    single = rows.where(alone).select(key, F.col(key).alias("cluster"))
    free = rows.where(~alone).withColumn("_names", F.concat_ws("\x1f", F.array_sort(F.array_distinct(F.filter(names, lambda x: x != "")))))
    same = free.groupBy(*block, title, "_names").agg(F.min(F.struct(F.col(order).alias("_o"), F.col(key).alias("_k"))).alias("_lead"))
    same = same.select(*block, F.col(title).alias("_t"), "_names", "_lead._o", "_lead._k")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_o", "_k"], kind="stable")
        t, k, n = group["_t"].tolist(), group["_k"].tolist(), [set(x.split("\x1f")) - {""} for x in group["_names"]]
        seed = [-1] * len(t)
        for i in range(len(t)):
            if seed[i] >= 0:
                continue
            seed[i] = i
            for j in range(i + 1, len(t)):
                if seed[j] < 0 and n[i] & n[j] and min(len(t[i]), len(t[j])) * 200 >= threshold * (len(t[i]) + len(t[j])) and indel_ratio(t[i], t[j]) >= threshold:
                    seed[j] = i
        return pd.DataFrame({"_k": k, "cluster": [k[s] for s in seed]})

    found = same.groupBy(*block).applyInPandas(run, f"_k {kind}, cluster {kind}")
    leads = same.join(found, "_k").withColumnRenamed("_t", title)
    members = free.join(leads, [*block, title, "_names"]).select(key, "cluster")
    return single.unionByName(members)


def similar_titles(rows: DataFrame, block: Sequence[str], key: str, title: str, distance: int) -> DataFrame:
    """Pairs within a block whose edit distance is at most distance: the lossless filter before the ratio. Titles of a block are compared once, however many rows have them."""
    t = rows.select(*block, F.col(title).alias("_t"), key)
    titles = chunked(t.select(*block, "_t").distinct(), block, "_t")
    a, b = titles.select(*block, F.col("_chunk").alias("_i"), F.col("_keys").alias("_left")), titles.select(*block, F.col("_chunk").alias("_j"), F.col("_keys").alias("_right"))
    kinds = expanded(a.join(b, list(block)).where("_i <= _j").select(*block, "_i", "_j", "_left", "_right"), "_left", "_right", "ta", "tb").where("_i < _j OR ta <= tb")
    kinds = kinds.where(F.abs(F.length("ta") - F.length("tb")) <= distance).withColumn("distance", F.levenshtein("ta", "tb", distance)).where("distance >= 0")
    kinds = materialize(kinds.select(*block, "ta", "tb", "distance"), "near-titles")
    keys = chunked(t, [*block, "_t"], key)
    lists = kinds.join(keys.select(*block, F.col("_t").alias("ta"), F.col("_keys").alias("_left")), [*block, "ta"]).join(keys.select(*block, F.col("_t").alias("tb"), F.col("_keys").alias("_right")), [*block, "tb"])
    out = expanded(lists.select("distance", (F.col("ta") == F.col("tb")).alias("_same"), "_left", "_right"), "_left", "_right", "_p", "_q")
    # a title's rows meet one another in both orders, the rows of two titles in one
    return out.where("_p <> _q AND (NOT _same OR _p < _q)").select(F.least("_p", "_q").alias("a"), F.greatest("_p", "_q").alias("b"), "distance")


def authorship(papers: DataFrame, paper: str = "paper_id", authors: str = "authors") -> DataFrame:
    """paper, pos, key, name, orcid of each author with a key."""
    one = papers.select(paper, F.posexplode(authors).alias("pos", "a"))
    return one.select(paper, "pos", T.entity_key(F.col("a.id"), F.col("a.orcid"), F.col("a.name")).alias("key"), F.col("a.name").alias("name"), T.orcid(F.col("a.orcid")).alias("orcid")).where(F.col("key") != "")


def shared_id_aliases(keys: DataFrame, key: str = "key", external: str = "orcid") -> DataFrame:
    """(key, canonical): keys that share an external id; canonical has most rows, then starts with a, then is largest. A key of several ids takes its smallest canonical."""
    n = keys.groupBy(key).agg(F.count("*").alias("_n"))
    pairs = keys.where(F.col(external).isNotNull()).select(key, external).distinct().join(n, key)
    best = pairs.groupBy(external).agg(F.count("*").alias("_k"), F.max_by(key, F.struct(F.col("_n"), F.col(key).startswith("a").cast("int").alias("_a"), F.col(key))).alias("canonical")).where("_k > 1")
    return pairs.join(best, external).where(F.col(key) != F.col("canonical")).groupBy(F.col(key).alias("key")).agg(F.min("canonical").alias("canonical"))


def resolve_chains(aliases: DataFrame) -> DataFrame:
    """(key, canonical) with canonical followed to its end by pointer jumping. Keys of a cycle all go to its smallest key, which stays itself."""
    now = materialize(aliases.where("key <> canonical").dropDuplicates(["key"]), "aliases")
    n = now.count()
    for _ in range(max(1, n.bit_length()) + 1):
        up = now.select(F.col("key").alias("canonical"), F.col("canonical").alias("_next"))
        step = materialize(now.join(up, "canonical", "left").select("key", F.coalesce("_next", "canonical").alias("canonical"), F.col("_next").isNotNull().alias("_moved")), "aliases")
        now = step.select("key", "canonical")
        if step.where("_moved").isEmpty():
            return now
    turning = now.join(now.select(F.col("key").alias("canonical")).distinct(), "canonical", "left_semi")
    rest = now.join(turning.select("key"), "key", "left_anti")
    ring = aliases.join(turning.select("key"), "key", "left_semi").select(F.col("key").alias("a"), F.col("canonical").alias("b"))
    comp = connected_components(ring)
    return rest.unionByName(comp.where("node <> component").select(F.col("node").alias("key"), F.col("component").alias("canonical")))


def overlap_pairs(links: DataFrame, names: DataFrame, least: int = 2, share: float = 0.3, key: str = "key", other: str = "other", block: Sequence[str] = ("name",)) -> DataFrame:
    """a, b, shared, overlap: keys of one block that share least others or more, and share of the smaller set. links (key, other) is distinct; a and b themselves do not count. Pairs are found through their shared others, so a block of many keys makes no pairs without one."""
    side = links.join(names.select(key, *block), key)
    a = side.select(*block, F.col(key).alias("a"), F.col(other).alias("_o"))
    b = side.select(*block, F.col(key).alias("b"), F.col(other).alias("_o"))
    both = a.join(b, [*block, "_o"]).where("a < b AND _o <> a AND _o <> b").groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
    size = links.groupBy(key).agg(F.count("*").alias("n"))
    mutual = links.select(F.col(key).alias("a"), F.col(other).alias("b"), F.lit(1).alias("_m"))
    out = both.join(mutual, ["a", "b"], "left")
    out = out.join(size.select(F.col(key).alias("a"), F.col("n").alias("_na")), "a").join(size.select(F.col(key).alias("b"), F.col("n").alias("_nb")), "b")
    out = out.withColumn("overlap", F.col("shared") / (F.least("_na", "_nb") - F.coalesce("_m", F.lit(0))))
    return out.where(F.col("overlap") >= share).select("a", "b", "shared", "overlap")


def canonical_of_components(pairs: DataFrame, weight: DataFrame) -> DataFrame:
    """(key, canonical) of linked keys: canonical has the largest weight (key, n), then starts with a, then is largest."""
    comp = connected_components(pairs.select("a", "b"))
    j = comp.join(weight.select(F.col("key").alias("node"), "n"), "node", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    best = j.groupBy("component").agg(F.max_by("node", F.struct(F.col("n"), F.col("node").startswith("a").cast("int").alias("a"), F.col("node"))).alias("canonical"))
    return j.join(best, "component").where("node <> canonical").select(F.col("node").alias("key"), "canonical")


def coauthor_aliases(papers: DataFrame, existing: DataFrame | None = None, share: float = 0.3, least: int = 2, paper: str = "paper_id") -> DataFrame:
    """(key, canonical) of keys of one name that share enough co-authors, transitively. existing aliases are applied first and not given again."""
    from .relational import resolve

    a = authorship(papers, paper)
    if existing is not None:
        a = resolve(a, "key", existing)
    a = materialize(a.select(paper, "key", "pos", T.last_first(F.col("name")).alias("name")), "authorship")
    one = a.select(paper, "key").distinct()
    links = one.join(one.select(paper, F.col("key").alias("other")), paper).where("key <> other").select("key", "other").distinct()
    names = a.groupBy("key").agg(F.min_by("name", F.struct(paper, "pos")).alias("name")).where("name <> ''")
    pairs = overlap_pairs(links, names, least, share)
    return canonical_of_components(pairs, one.groupBy("key").agg(F.count("*").alias("n")))


def alias_candidates(links: DataFrame, names: DataFrame, least: int = 2, k: int = 200) -> DataFrame:
    """The k pairs of one (surname, initial) block with most shared others and no two different external ids. names (key, surname, initial, external)."""
    pairs = overlap_pairs(links, names, least, 0.0, block=("surname", "initial"))
    ext = names.select("key", "external")
    j = pairs.join(ext.select(F.col("key").alias("a"), F.col("external").alias("ea")), "a").join(ext.select(F.col("key").alias("b"), F.col("external").alias("eb")), "b")
    return j.where(F.col("ea").isNull() | F.col("eb").isNull() | (F.col("ea") == F.col("eb"))).orderBy(F.desc("shared"), "a", "b").limit(k).select("a", "b", "shared", F.col("overlap"))


def split_suspects(name_only: DataFrame, identified: DataFrame, least: int = 3) -> DataFrame:
    """Pairs (name key, id key) of one surname, both with least items or more, that share a given name of two letters or more. Tables: key, surname, given (array), n."""
    token = F.explode(F.transform(F.filter("given", lambda g: F.length(g) >= 2), lambda g: F.struct(F.col("surname").alias("s"), g.alias("g"))))
    a, b = (t.where((F.col("n") >= least) & F.col("surname").isNotNull()).select("key", token.alias("token")) for t in (name_only, identified))
    return sharing(a, b, "key", "token", "name_key", "id_key")


def dedupe_records(raw: DataFrame, priority: Column, order: str = "seq", threshold: float = 95.0, manual: DataFrame | None = None) -> dict[str, DataFrame]:
    """Papers, authors, aliases and report of raw records (title, year, doi, authors, abstract, cited_by_count, concepts, venue_slug and others).

    Front matter goes. Records of one DOI (any case) are one; those without are clustered by title within year and first
    surname. A cluster's record is its first by priority, then order; empty abstract, count and concepts are filled from
    later ones, and authors with unseen keys are appended.
    """
    from .relational import resolve

    rows = raw.where(~T.is_front_matter(F.col("title"))).withColumn("_p", priority)
    with_doi = rows.where(F.col("doi").isNotNull()).withColumn("_c", F.concat(F.lit("doi:"), F.lower("doi")))
    rest = rows.where(F.col("doi").isNull())
    surnames = F.transform(F.coalesce("authors", F.array().cast(raw.schema["authors"].dataType)), lambda a: T.surname(a["name"]))
    shaped = rest.select(order, "year", T.norm_title(F.col("title")).alias("_t"), surnames.alias("_s")).withColumn("_f", F.coalesce(F.get("_s", F.lit(0)), F.lit("")))
    groups = greedy_clusters(shaped, ["year", "_f"], order, "_t", "_s", order, threshold)
    rest = rest.join(groups, order).withColumn("_c", F.concat(F.lit("fz:"), F.col("cluster").cast("string"))).drop("cluster")
    every = materialize(with_doi.unionByName(rest), "clustered")
    w = Window.partitionBy("_c").orderBy("_p", order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fill = {c: F.first(F.when(~T.missing_text(F.col(c)) if c == "abstract" else (~T.missing_array(F.col(c)) if c == "concepts" else F.col(c).isNotNull()), F.col(c)), ignorenulls=True).over(w) for c in ("abstract", "cited_by_count", "concepts") if c in raw.columns}
    lists = every.where(F.size("authors") > 0).select("_c", F.struct("_p", order, "authors").alias("l")).groupBy("_c").agg(F.array_sort(F.collect_list("l")).alias("_l"))
    entries = F.flatten(F.transform("_l", lambda l, i: F.transform(l["authors"], lambda a, j: F.struct(i.alias("i"), T.entity_key(a["id"], a["orcid"], a["name"]).alias("key"), a.alias("a")))))
    merged = lists.select("_c", entries.alias("_e"))
    # the first record keeps all its authors; later ones add keys that are new
    fresh = F.filter("_e", lambda e, n: (e["i"] == 0) | (F.size(F.filter(F.slice(F.col("_e"), F.lit(1), n), lambda b: b["key"] == e["key"])) == 0))
    merged = merged.select("_c", F.transform(fresh, lambda e: e["a"]).alias("_authors"))
    base = every.withColumns(fill).withColumn("_r", F.row_number().over(Window.partitionBy("_c").orderBy("_p", order))).where("_r = 1")
    papers = base.join(merged, "_c", "left").withColumn("authors", F.coalesce("_authors", "authors")).withColumn("paper_id", T.record_id(F.col("doi"), F.col("title"), F.col("year")))
    papers = papers.withColumn("_r", F.row_number().over(Window.partitionBy("paper_id").orderBy(order))).where("_r = 1").drop("_r", "_p", "_c", "_authors")
    papers = materialize(papers, "papers")
    by_id = shared_id_aliases(authorship(papers))
    by_team = coauthor_aliases(papers, by_id)
    tagged = [(0, manual), (1, by_id), (2, by_team)]
    union = None
    for p, m in tagged:
        if m is not None:
            one = m.select("key", "canonical", F.lit(p).alias("_p"))
            union = one if union is None else union.unionByName(one)
    first = F.row_number().over(Window.partitionBy("key").orderBy("_p"))
    aliases = resolve_chains(union.withColumn("_r", first).where("_r = 1").select("key", "canonical"))
    long = resolve(authorship(papers).join(papers.select("paper_id", "year", "venue_slug"), "paper_id"), "key", aliases)
    from .relational import rollup_members

    place = F.struct("paper_id", "pos")
    authors = rollup_members(long.withColumn("name", T.last_first(F.col("name"))).withColumn("_at", place), "key", "paper_id", "name", "year", "orcid", "_at", "venue_slug")
    report = every.agg(F.count("*").alias("raw")).join(papers.agg(F.count("*").alias("papers"))).join(authors.agg(F.count("*").alias("authors")))
    report = report.withColumn("dup_pct", F.round(100 * (1 - F.col("papers") / F.col("raw")), 2))
    return {"papers": papers, "authors": authors, "aliases": aliases, "report": report}
