"""Language identification by word-first backoff.

A known word scores with its log frequency in each language. An unseen word is covered from left to right by the longest
known character n-gram at each position, 5 characters down to 1, and scores with the n-grams' log frequencies. A text's score
is the softmax share of the best language, its log scores divided by the square root of the number of words.

Training counts words over all training rows (a Counter per task, summed by Spark); the n-gram counts come from the summed
word table. Words that occur once are left to the n-grams. The max_words and max_grams most frequent entries at most are
broadcast; the rest of both tables stays in Parquet, and the words of the texts that are not broadcast are looked up there
by joins, so a text scores as with the whole model.

Rows: every row gives one row. A null text or one without any letter gives 'und' with score 0; a text whose letters the
model has never seen gives the most frequent language with score 1 / number of languages. Rows with a null language or text
teach nothing; a null id counts as the empty text in the fold. Ties go to the language first in code point order. An empty
table, or one without languages, gives 'und' with score 0. Columns pass through unless they have an output's name.
"""

from __future__ import annotations

import math
from collections import ChainMap, Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import arrow_map, arrow_stream, fold, materialize, pieces_of, table
from .vocabulary import Memo

ORDERS = (5, 4, 3, 2, 1)


def words_of(text: str) -> list[str]:
    """The runs of letters, lower-cased."""
    import regex

    global _LETTERS
    if _LETTERS is None:
        _LETTERS = regex.compile(r"\p{L}+")
    return _LETTERS.findall(text.lower())


_LETTERS = None


def grams_of(word: str) -> list[str]:
    """The character n-grams of a word between marks."""
    w = f"^{word}$"
    return [w[i : i + n] for n in ORDERS for i in range(len(w) - n + 1) if n > 1 or w[i] not in "^$"]


class Model:
    """Log frequencies of words and n-grams in each language."""

    def __init__(self, langs: list[str], words: dict[str, np.ndarray], grams: dict[str, np.ndarray], prior: int):
        self.langs, self.words, self.grams, self.prior = langs, words, grams, prior
        self.tail: tuple[DataFrame | None, DataFrame | None] = (None, None)  # (word, v) and (gram, v) beyond words and grams
        self.rows: list[np.ndarray] = []
        self.memo = Memo(self._row, most=1 << 62)

    def vector(self, word: str) -> np.ndarray:
        known = self.words.get(word)
        if known is not None:
            return known
        w, at, out = f"^{word}$", 0, np.zeros(len(self.langs), np.float32)
        while at < len(w):
            for n in ORDERS:
                g = self.grams.get(w[at : at + n]) if at + n <= len(w) else None
                if g is not None:
                    out = out + g
                    break
            else:
                n = 1
            at += n
        return out

    def _row(self, word: str) -> int:
        self.rows.append(self.vector(word))
        return len(self.rows) - 1

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text) if text else []
        if not words or not self.langs:
            return "und", 0.0
        if len(self.rows) > 300_000:
            self.rows.clear()
            self.memo.clear()
            self._table = None
        rows = [self.memo[w] for w in words]
        table = self._stack()
        return self.decide(table[rows].sum(0), len(words))

    def decide(self, total: np.ndarray, n: int) -> tuple[str, float]:
        """The language and its share, of the summed log scores of n words."""
        if not np.any(total):
            return self.langs[self.prior], 1.0 / len(self.langs)
        best = int(np.argmax(total))
        share = np.exp((total - total[best]) / math.sqrt(n))
        return self.langs[best], float(1.0 / share.sum())

    _table = None

    def _stack(self) -> np.ndarray:
        have = 0 if self._table is None else len(self._table)
        if have < len(self.rows):  # long words aren't remembered, but their rows are until the next clearing
            new = np.array(self.rows[have:])
            self._table = new if self._table is None else np.concatenate([self._table, new])
        return self._table


def _centred(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Smoothed log frequencies, less their mean over the languages."""
    logs = np.log((counts + 0.1) / (totals + 1.0))
    return (logs - logs.mean(1, keepdims=True)).astype(np.float32)


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = 100_000, max_grams: int = 100_000) -> Model:
    """Learn from all rows of train that have a text and a language."""
    spark = train.sparkSession
    rows = train.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))

    def count(batches):
        tally: dict[str, Counter] = {}

        def emit():
            for lang, c in tally.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c)), pa.array(list(c)), pa.array(list(c.values()), pa.int64())], names=["lang", "word", "n"])
            tally.clear()

        for b in pieces_of(batches):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                tally.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, tally.values())) > 500_000:
                yield from emit()
        yield from emit()

    words = materialize(arrow_stream(rows, count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "lang-words")

    def split(batches):
        tally: dict[str, Counter] = {}
        for b in batches:
            for lang, word, n in zip(*[c.to_pylist() for c in b.columns], strict=True):
                c = tally.setdefault(lang, Counter())
                for g in grams_of(word):
                    c[g] += n
            if sum(map(len, tally.values())) > 500_000:
                for lang, c in tally.items():
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c)), pa.array(list(c)), pa.array(list(c.values()), pa.int64())], names=["lang", "gram", "n"])
                tally.clear()
        for lang, c in tally.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c)), pa.array(list(c)), pa.array(list(c.values()), pa.int64())], names=["lang", "gram", "n"])

    grams = arrow_stream(words, split, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n")).orderBy("lang").collect()
    langs = [r["lang"] for r in totals]
    if not langs:
        return Model([], {}, {}, 0)
    size = np.array([r["n"] for r in totals], float)

    def top(counts: DataFrame, key: str, least: int, most: int) -> tuple[dict[str, np.ndarray], DataFrame | None]:
        wide = counts.groupBy(key).agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
        kept = materialize(wide.where(F.col("total") >= least).withColumn("bin", F.floor(F.log2("total") * 16)), f"lang-{key}")
        cut, seen = 0, 0
        for r in kept.groupBy("bin").count().orderBy(F.desc("bin")).collect():  # a row for each sixteenth of an octave
            seen += r["count"]
            if seen > most:
                cut = r["bin"] + 1
                break
        best = kept.where(F.col("bin") >= cut)  # most rows at most: the bin that would pass it goes to the rest whole
        over = size if key == "word" else size * 8
        logs = F.array(*[F.log((F.coalesce(F.col("by")[g], F.lit(0)) + 0.1) / float(over[i] + 1.0)) for i, g in enumerate(langs)])
        mean = F.aggregate("logs", F.lit(0.0), lambda a, x: a + x) / len(langs)
        rest = kept.where(F.col("bin") < cut).select(key, logs.alias("logs")).select(key, F.transform("logs", lambda x: x - mean).alias("v")) if cut else None
        got = best.select(key, *[F.coalesce(F.col("by")[g], F.lit(0)).alias(f"c{i}") for i, g in enumerate(langs)]).toPandas()
        if got.empty:
            return {}, rest
        n = got.iloc[:, 1:].to_numpy(float)
        return dict(zip(got[key], _centred(n, over), strict=True)), rest

    (w, more_words), (g, more_grams) = top(words, "word", 2, max_words), top(grams, "gram", 2, max_grams)
    model = Model(langs, w, g, int(np.argmax(size)))
    model.tail = more_words, more_grams
    return model


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with lang_pred and score."""
    spark = docs.sparkSession
    parts = (model.langs, list(model.words), np.array(list(model.words.values())), list(model.grams), np.array(list(model.grams.values())), model.prior)
    sent = spark.sparkContext.broadcast(parts)  # max_words and max_grams entries at most

    def received() -> Model:
        langs, w, wv, g, gv, prior = sent.value
        return Model(langs, dict(zip(w, wv, strict=True)), dict(zip(g, gv, strict=True)), prior)

    def make():
        m = received()

        def work(texts):
            out = [m.predict(t) for t in texts]
            return [x[0] for x in out], [x[1] for x in out]

        return work

    if model.langs and any(t is not None for t in model.tail):
        return _with_tail(docs, model, received, text_col, keep)
    return arrow_map(docs, [text_col], "lang_pred string, score double", make, keep)


def _with_tail(docs: DataFrame, model: Model, received, text_col: str, keep: list[str] | None) -> DataFrame:
    """identify where a part of the model is not broadcast: words outside the broadcast get their vectors by joins."""
    langs, prior, (more_words, more_grams) = model.langs, model.prior, model.tail

    def first():
        m = received()
        index = {w: i for i, w in enumerate(m.words)}
        known = np.array(list(m.words.values()), float).reshape(len(index), len(langs))

        def work(texts):
            n, sums, sizes, rest, times = [], np.zeros((len(texts), len(langs))), [0], [], []
            for at, t in enumerate(texts):
                tally = Counter(words_of(t) if t else ())
                counts = np.fromiter(tally.values(), np.int64, len(tally))
                rows = np.fromiter((index.get(w, -1) for w in tally), np.int64, len(tally))
                n.append(int(counts.sum()))
                have = rows >= 0
                sums[at] = counts[have] @ known[rows[have]]
                lack = np.flatnonzero(~have)
                if len(lack):
                    own = list(tally)
                    rest += [own[i] for i in lack]
                    times.append(counts[lack])
                sizes.append(len(rest))
            pairs = pa.StructArray.from_arrays([pa.array(rest, pa.string()), pa.array(np.concatenate(times) if times else np.empty(0, np.int64))], ["word", "k"])
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * len(langs), pa.int32()), pa.array(sums.ravel()))
            return n, vectors, pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pairs)

        return work

    def ask():
        m = received()
        return lambda words: [[[g for g in dict.fromkeys(grams_of(w)) if g not in m.grams] for w in words]]

    def cover():
        m = received()

        def work(words, found):
            out = []
            for w, more in zip(words, found, strict=True):
                own = {e["gram"]: np.array(e["v"], np.float32) for e in more or []}
                grams = ChainMap(own, m.grams) if own else m.grams
                out.append(Model(langs, {}, grams, prior).vector(w).astype(float).tolist())
            return [out]

        return work

    def last():
        m = Model(langs, {}, {}, prior)

        def work(n, sums, more):
            out = [m.decide(np.array(s) + np.array(x or 0.0), k) if k else ("und", 0.0) for k, s, x in zip(n, sums, more, strict=True)]
            return [x[0] for x in out], [x[1] for x in out]

        return work

    scored = arrow_map(docs, [text_col], "_lang_n long, _lang_sum array<double>, _lang_rest array<struct<word:string,k:long>>", first, keep)
    rows = materialize(scored.withColumn("_lang_row", F.monotonically_increasing_id()), "lang-rows")  # the number is fixed by being written
    parts = rows.select("_lang_row", F.explode("_lang_rest").alias("e")).select("_lang_row", "e.word", "e.k")
    need = parts.select("word").distinct()
    need = need.withColumn("v", F.lit(None).cast("array<double>")) if more_words is None else need.join(more_words, "word", "left")
    need = materialize(need, "lang-need")
    unknown = need.where(F.col("v").isNull()).select("word")
    if more_grams is None:
        unknown = unknown.withColumn("found", F.lit(None).cast("array<struct<gram:string,v:array<double>>>"))
    else:
        asked = arrow_map(unknown, ["word"], "gram array<string>", ask).select("word", F.explode("gram").alias("gram"))
        got = asked.join(more_grams, "gram").groupBy("word").agg(F.collect_list(F.struct("gram", "v")).alias("found"))  # a word's own n-grams
        unknown = unknown.join(got, "word", "left")
    vectors = need.where(F.col("v").isNotNull()).unionByName(arrow_map(unknown, ["word", "found"], "v array<double>", cover, ["word"]))
    more = parts.join(vectors, "word").groupBy("_lang_row").agg(F.array(*[F.sum(F.col("v")[i] * F.col("k")) for i in range(len(langs))]).alias("_lang_more"))
    kept = [c for c in scored.columns if not c.startswith("_lang_")]
    return arrow_map(rows.drop("_lang_rest").join(more, "_lang_row", "left"), ["_lang_n", "_lang_sum", "_lang_more"], "lang_pred string, score double", last, kept)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(fold("doc_id", 4) != 2))
    return identify(docs.select("doc_id", "text", (fold("doc_id", 4) == 2).alias("held_out")), model, keep=["doc_id", "held_out"])
