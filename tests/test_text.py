from pyspark.sql import functions as F

from citeloom.functions import text as T
from citeloom.functions import vectors as V


def one(spark, value, kind, f):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_names(spark):
    rows = [("Søren Ågård", "agard, soren", "agard"), ("Ågård, Søren", "agard, soren", "agard"), ("Ines  de  la  Peña", "pena, ines de la", "pena"), ("Zenobia", "zenobia", "zenobia"), (None, "", ""), ("  ", "", ""), ("Łukasz Großmann 3rd", "rd, lukasz grossmann", "rd")]
    got = spark.createDataFrame([(r[0],) for r in rows], "n string").select(T.last_first(F.col("n")).alias("k"), T.surname(F.col("n")).alias("s")).collect()
    assert [(r["k"], r["s"]) for r in got] == [r[1:] for r in rows]
    assert one(spark, "Çağla-Ünal O'Dwyer", "string", T.norm_name) == "cagla-unal o dwyer"


def test_names_in_other_alphabets(spark):
    rows = [("Пётр Щукин", "shchukin, piotr"), ("Анна Васильева", "eva, anna vasil"), ("Θάλεια Ψυχάρη", "psukhare, thaleia"), ("Юлія Їжак", "yizhak, iuliia")]
    got = spark.createDataFrame([(n,) for n, _ in rows], "n string").select(T.last_first(F.col("n")).alias("k")).collect()
    assert [r["k"] for r in got] == [k for _, k in rows]


def test_identifiers(spark):
    assert one(spark, "https://orcid.org/0000-0001-2345-678x", "string", T.orcid) == "0000-0001-2345-678X"
    assert one(spark, "not-an-orcid", "string", T.orcid) is None
    assert one(spark, " https://doi.org/10.1/AB ", "string", T.norm_doi) == "10.1/ab"
    assert one(spark, "NaN", "string", T.norm_doi) is None
    keys = spark.createDataFrame([("A123", None, "x y"), (None, "0000-0001-2345-678X", "x y"), ("77", None, "Ek, B"), ("77", None, "Ekdahl, B")], "i string, o string, n string")
    assert [r[0] for r in keys.select(T.entity_key(F.col("i"), F.col("o"), F.col("n"))).collect()] == ["a123", "0000-0001-2345-678x", "", "ekdahl, b"]


def test_front_matter(spark):
    front = [*T.FRONT_MATTER_TITLES[:12], *[f"  {t.upper()}... " for t in T.FRONT_MATTER_TITLES[:3]], None, "", "..."]
    real = ["On the colour of rain", "Editorials and their readers", "The index of a vector field", "A table of contents for machines: how readers skip", "Covers of graphs"]
    got = spark.createDataFrame([(t,) for t in front + real], "t string").select(T.is_front_matter(F.col("t")).alias("f")).collect()
    assert [r["f"] for r in got] == [True] * len(front) + [False] * len(real)


def test_a_long_map_of_positions_comes_back(spark):
    words = [f"w{i * 7919 % 613}" for i in range(4000)]
    places = {}
    for i, w in enumerate(words):
        places.setdefault(w, []).append(i)
    assert one(spark, places, "map<string,array<int>>", T.text_of_positions) == " ".join(words)


def test_vectors_of_some_width(spark):
    import math

    v = [math.sin(i) for i in range(768)]
    length, top = math.sqrt(sum(x * x for x in v)), max(map(abs, v))
    row = spark.createDataFrame([(v,), (None,)], "v array<double>").select(V.unit(F.col("v")).alias("u"), V.to_int8(F.col("v")).alias("q"), V.from_int8(V.to_int8(F.col("v")), V.scale(F.col("v"))).alias("b")).collect()
    assert all(abs(a - b / (length + 1e-8)) < 1e-12 for a, b in zip(row[0]["u"], v, strict=True)) and row[1]["u"] is None and row[1]["q"] is None
    assert [int(q) for q in row[0]["q"]] == [round(x / top * 127) for x in v] and all(abs(a - b) <= top / 254 + 1e-9 for a, b in zip(row[0]["b"], v, strict=True))


def test_lists_and_tokens(spark):
    assert one(spark, ["a", "b", "c", "d", "e", "f"], "array<string>", T.short_list) == "a; b; c; … ; f (+2)"
    assert one(spark, ["a", "b", "c", "d"], "array<string>", T.short_list) == "a; b; c; d"
    assert one(spark, {"b": [1], "a": [0, 2], "c": [2]}, "map<string,array<int>>", T.text_of_positions) == "a b c"
    assert one(spark, [("Deep Net-Work", 2, 0.5), ("top", 1, 1.0), ("x", 3, None)], "array<struct<name:string,level:int,score:double>>", T.concept_tokens) == ["deep_net_work", "deep_net_work", "x"]


def test_quantise(spark):
    row = spark.createDataFrame([([1.0, -0.5, 0.25, 0.0],)], "v array<double>").select(V.to_int8(F.col("v")).alias("q"), V.scale(F.col("v")).alias("s")).first()
    assert list(row["q"]) == [127, -64, 32, 0] and row["s"] == 1.0
