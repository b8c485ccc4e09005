from pyspark.sql import functions as F

from citeloom.operators import linkage as L
from citeloom.sources.readers import AUTHOR


def papers(spark, rows):
    data = [(p, [(i, n, None, None, []) for i, n in people]) for p, people in rows]
    return spark.createDataFrame(data, f"paper_id string, authors array<{AUTHOR}>")


def aliases(df):
    return {r["key"]: r["canonical"] for r in df.collect()}


def test_indel_ratio():
    assert L.common_length("abcde", "ace") == 3 and L.indel_ratio("abc", "abc") == 100.0
    import difflib
    import random

    random.seed(1)
    for _ in range(200):
        a, b = ("".join(random.choice("abc") for _ in range(random.randint(0, 9))) for _ in "xy")
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert L.common_length(a, b) == table[-1][-1], (a, b, difflib)


def merged_plainly(rows, existing, share, least):
    """What coauthor_aliases should give, by sets: rows are (paper, [(id, last, first)])."""
    key = lambda i: existing.get(i.lower(), i.lower())
    name, near, papers = {}, {}, {}
    for paper, people in sorted(rows):
        keys = [key(i) for i, _, _ in people]
        for k, (_, last, first) in zip(keys, people, strict=True):
            name.setdefault(k, (last, first))
            near.setdefault(k, set()).update(x for x in keys if x != k)
            papers.setdefault(k, set()).add(paper)
    up = {k: k for k in name}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for x in name:
        for y in name:
            both = near[x] & near[y] - {x, y}
            if x < y and name[x] == name[y] and len(both) >= least and len(both) / (min(len(near[x]), len(near[y])) - (y in near[x])) >= share:
                up[root(x)] = root(y)
    groups = {}
    for k in name:
        groups.setdefault(root(k), []).append(k)
    best = {r: max(ks, key=lambda k: (len(papers[k]), k.startswith("a"), k)) for r, ks in groups.items()}
    return {k: best[root(k)] for k in name if best[root(k)] != k}


def invented(seed):
    import random

    r = random.Random(seed)
    people = [(f"A{r.choice('XY')}{n:03}", f"lorvin{'abcde'[n % 5]}", "tessa" if n % 2 else "odo") for n in range(26)]
    groups = [r.sample(people, 7) for _ in range(4)]
    rows = [(f"w{n:02}", r.sample(r.choice(groups), r.randint(2, 5))) for n in range(30)]
    return rows, {people[0][0].lower(): people[5][0].lower(), people[11][0].lower(): people[1][0].lower()}


def test_coauthor_aliases_equal_a_plain_merge(spark):
    merges = 0
    for seed, share, least in ((1, 0.3, 2), (2, 0.3, 2), (3, 0.6, 1), (4, 0.3, 3)):
        rows, known = invented(seed)
        df = papers(spark, [(p, [(i, f"{first.title()} {last.title()}") for i, last, first in people]) for p, people in rows])
        for existing in ({}, known):
            given = spark.createDataFrame(list(existing.items()), "key string, canonical string") if existing else None
            want = merged_plainly(rows, existing, share, least)
            assert aliases(L.coauthor_aliases(df, given, share=share, least=least)) == want
            merges += len(want)
    assert merges > 10


def test_chains_and_cycles(spark):
    m = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x")], "key string, canonical string")
    got = aliases(L.resolve_chains(m))
    assert {k: got[k] for k in "abc"} == dict.fromkeys("abc", "d") and got.get("y") == "x" and "x" not in got


def test_greedy_is_not_transitive(spark):
    rows = [(1, 2000, "aaaaaaaaaaaaaaaaaaaa", ["k"]), (2, 2000, "aaaaaaaaaaaaaaaaaaab", ["k"]), (3, 2000, "aaaaaaaaaaaaaaaaaabb", ["k"]), (4, None, "aaaaaaaaaaaaaaaaaaaa", ["k"]), (5, 2000, "aaaaaaaaaaaaaaaaaaaa", ["other"])]
    df = spark.createDataFrame(rows, "id int, year int, t string, n array<string>")
    got = {r["id"]: r["cluster"] for r in L.greedy_clusters(df, ["year"], "id", "t", "n", "id", 95.0).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_records_end_to_end(spark):
    def rec(seq, src, doi, title, year, people, cites=None, abstract=None):
        return (seq, src, doi, title, year, "v", cites, abstract, [(i, n, None, None, []) for i, n in people], [])

    tilda, nuno, wren = ("A1", "Tilda Örjansdóttir"), ("A2", "Nuno Brasov"), ("A3", "Wren Okoth")
    raw = spark.createDataFrame(
        [
            rec(1, "one", "10.1/a", "First study", 2020, [tilda, nuno, wren]), rec(2, "one", "10.1/A", "First study", 2020, [tilda, nuno, wren], 7, "text"),
            rec(3, "one", "10.1/b", "Second study", 2021, [tilda, nuno, wren]), rec(4, "two", "10.1/b", "Second study", 2021, [("9", "Okoth, Wren"), ("8", "Brasov, Nuno"), ("7", "Örjansdóttir, Tilda")], 3),
            rec(5, "one", None, "Third study of things", 2021, [tilda]), rec(6, "one", None, "Third study of things.", 2021, [tilda]), rec(7, "one", None, "Third study of things", 2022, [tilda]),
            rec(8, "one", "10.1/c", "Table of Contents", 2021, []),
        ],
        f"seq int, _source string, doi string, title string, year int, venue_slug string, cited_by_count long, abstract string, authors array<{AUTHOR}>, concepts array<string>",
    )
    out = L.dedupe_records(raw, F.when(F.col("_source") == "one", 0).otherwise(1))
    got = {r["paper_id"]: r for r in out["papers"].collect()}
    assert len(got) == 4
    assert got["doi:10.1/a"]["cited_by_count"] == 7 and got["doi:10.1/a"]["abstract"] == "text"
    assert len(got["doi:10.1/b"]["authors"]) == 6 and got["doi:10.1/b"]["cited_by_count"] == 3
    report = out["report"].first()
    assert (report["raw"], report["papers"], report["dup_pct"]) == (7, 4, 42.86)
    assert {r["key"] for r in out["authors"].collect()} == {"a1", "a2", "a3"}
