"""TF-IDF, labels of groups by their terms, truncated SVD."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..sources.tables import materialize

TOKEN = r"([A-Za-z][A-Za-z\-]{2,})"
#: A short list of function words; callers give their own field's words.
STOP = ("the", "and", "for", "with", "from", "this", "that", "are", "was", "were", "has", "have", "not", "its", "our", "their", "into", "between", "using", "based")


def tokens(text: Column, stop: Sequence[str] = STOP) -> Column:
    """Lower-case words of three letters or more that are no stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 1)
    return F.filter(words, lambda w: ~w.isin(*stop)) if stop else words


def one_and_two(words: Column) -> Column:
    """Words, and neighbouring pairs joined by a space."""
    pairs = F.when(F.size(words) >= 2, F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    return F.concat(words, pairs)


def term_counts(rows: DataFrame, doc: str, terms: Column) -> DataFrame:
    """doc, term, tf over all rows of a document."""
    return rows.select(doc, F.explode(terms).alias("term")).groupBy(doc, "term").agg(F.count("*").alias("tf"))


def one_and_two_counts(rows: DataFrame, doc: str, words: Column, at_once: int = 1 << 22) -> DataFrame:
    """term_counts of one_and_two(words), which holds no nulls. Words are numbered and counted at_once by at_once (a longer row whole) before they are moved, pairs by their two numbers, so that only distinct terms are made and hashed as strings."""
    given = rows.select(doc, words.alias("_w"))  # no filter of empty ones: it would find the words twice
    kinds = StructType([given.schema[doc], StructField("term", StringType()), StructField("_n", LongType())])
    arrow = to_arrow_schema(kinds)

    def counted(docs: pa.Array, lists: pa.Array) -> Iterator[pa.RecordBatch]:
        named, flat = docs.dictionary_encode(null_encoding="encode"), lists.flatten().dictionary_encode()
        row = np.repeat(np.arange(len(docs)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        d, w, n = named.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row], flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(flat.dictionary)
        inside = row[1:] == row[:-1]  # the next word is of the same row
        for of_two in (False, True):
            key = ((d[:-1] * n + w[:-1]) * n + w[1:])[inside] if of_two else d * n + w
            found, times = np.unique(key, return_counts=True)
            term = flat.dictionary.take(pa.array(found % n))
            if of_two:
                found = found // n
                term = pc.binary_join_element_wise(flat.dictionary.take(pa.array(found % n)), term, " ")
            columns = named.dictionary.take(pa.array(found // n)), term, pa.array(times)
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            upto = np.cumsum(pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(b):
                end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + at_once, "right")))
                yield from counted(b.column(0).slice(at, end - at), b.column(1).slice(at, end - at))
                at = end

    return given.mapInArrow(run, kinds).groupBy(doc, "term").agg(F.sum("_n").alias("tf"))


def tfidf(counts: DataFrame, docs: int, doc: str, least: int = 3, share: float = 0.5, sublinear: bool = False) -> DataFrame:
    """doc, term, weight: tf (or 1 + ln tf) times ln((1 + n) / (1 + df)) + 1, of unit length per document. Terms in fewer than least documents or more than share of them go."""
    counts = materialize(counts, "term-counts")
    df = counts.groupBy("term").agg(F.count("*").alias("df")).where((F.col("df") >= least) & (F.col("df") <= share * docs))
    tf = F.lit(1.0) + F.log(F.col("tf").cast("double")) if sublinear else F.col("tf").cast("double")
    raw = materialize(counts.join(df, "term").withColumn("_w", tf * (F.log(F.lit(1.0 + docs) / (F.col("df") + 1)) + 1)), "term-weights")
    length = raw.groupBy(doc).agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_l"))
    return raw.join(length, doc).select(doc, "term", (F.col("_w") / F.col("_l")).alias("weight"))


def idf(items: DataFrame, item: str, term: str, docs: int) -> DataFrame:
    """term, df, idf = ln((1 + n) / (1 + df)) + 1."""
    df = items.select(item, term).distinct().groupBy(term).agg(F.count("*").alias("df"))
    return df.withColumn("idf", F.log(F.lit(1.0 + docs) / (F.col("df") + 1)) + 1)


def group_labels(weights: DataFrame, doc: str, pool: int = 24, k: int = 8) -> DataFrame:
    """doc and labels: the k best terms among the pool best, leaving out a single word that already begins a chosen term."""
    rank = F.row_number().over(Window.partitionBy(doc).orderBy(F.desc("weight"), "term"))
    best = weights.where("weight > 0").withColumn("r", rank).where(F.col("r") <= pool)
    listed = best.groupBy(doc).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda e: e["term"]).alias("_t"))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.array().cast("array<string>").alias("roots"))

    def step(s, t):
        root = F.substring_index(t, " ", 1)
        take = (F.size(s["kept"]) < k) & (F.contains(t, F.lit(" ")) | ~F.array_contains(s["roots"], root))
        return F.struct(F.when(take, F.array_append(s["kept"], t)).otherwise(s["kept"]).alias("kept"), F.when(take, F.array_append(s["roots"], root)).otherwise(s["roots"]).alias("roots"))

    return listed.select(doc, F.aggregate("_t", start, step, lambda s: s["kept"]).alias("labels"))


def truncated_svd(weights: DataFrame, doc: str, k: int, terms_bound: int = 4000) -> DataFrame:
    """doc and its k coordinates in the leading right-singular space, of unit length. The term Gram matrix (terms_bound terms at most, by document frequency) passes the driver."""
    best = weights.groupBy("term").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "term").limit(terms_bound)
    index = {r["term"]: i for i, r in enumerate(best.collect())}
    spark = weights.sparkSession
    numbered = spark.createDataFrame(list(index.items()), "term string, j int")
    w = weights.join(F.broadcast(numbered), "term").select(doc, "j", "weight")  # terms_bound rows
    rows = w.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("j", "weight"))).alias("e"))
    d = len(index)

    def gram(batches):
        import pandas as pd

        g = np.zeros((d, d))
        for b in batches:
            for e in b["e"]:
                j, x = np.array([t["j"] for t in e]), np.array([t["weight"] for t in e])
                g[np.ix_(j, j)] += np.outer(x, x)
        i, j = np.nonzero(np.triu(g))
        yield pd.DataFrame({"i": i, "j": j, "g": g[i, j]})

    g = np.zeros((d, d))
    for r in rows.mapInPandas(gram, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).collect():
        g[r["i"], r["j"]] = g[r["j"], r["i"]] = r["g"]
    values, axes = np.linalg.eigh(g)
    top = axes[:, ::-1][:, :k]
    top = top * np.sign(top[np.abs(top).argmax(0), range(top.shape[1])])  # the largest loading of an axis is positive

    def place(batches):
        import pandas as pd

        for b in batches:
            out = []
            for e in b["e"]:
                v = np.array([t["weight"] for t in e]) @ top[[t["j"] for t in e]]
                out.append(v / (np.linalg.norm(v) + 1e-8))
            yield pd.DataFrame({doc: b[doc], "coordinates": out})

    kind = rows.schema[doc].dataType.simpleString()
    return rows.mapInPandas(place, f"{doc} {kind}, coordinates array<double>")
