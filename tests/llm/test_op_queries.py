"""The queries of the contracts over whole tables, against plain recomputation."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.llm import langid, mixing, queries, secret_scan

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")
WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def docs(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]


def found(spark, name, folder=SF):
    return queries.QUERIES[name](spark, folder).collect()


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_op1(spark, docs):
    size = {d: len(WORD.findall(t or "")) for d, t, _, _ in docs}
    by = defaultdict(int)
    for d, _, _, s in docs:
        by[s] += size[d]
    want = mixing.targets(dict(by))
    rows = found(spark, "op1_mix_sources")
    assert sorted(r["doc_id"] for r in rows) == sorted(size) and rows == found(spark, "op1_mix_sources")
    taken = Counter()
    for r in rows:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == by[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert r["taken"] <= 3 * r["size"] and r["taken"] % max(1, r["size"]) == 0
        taken[r["source"]] += r["taken"]
    for s in by:  # within one per cent, or half of the source's smallest document
        least = min(n for d, n in size.items() if n and next(x for x in docs if x[0] == d)[3] == s)
        assert abs(taken[s] - want[s]) <= max(0.03 * want[s], least)


def test_op1_lands_within_one_per_cent(spark):
    folder = SF.replace("0.001", "0.01")
    if not os.path.exists(folder):
        pytest.skip("no test tables")
    out = queries.QUERIES["op1_mix_sources"](spark, folder).groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("k")).collect()
    assert out and all(abs(r["k"] - r["t"]) <= 0.01 * r["t"] for r in out)


def test_op2_and_op6(spark, docs):
    tokenizers = pytest.importorskip("tokenizers")
    from citeloom.llm.vocabulary import default_path

    library = tokenizers.Tokenizer.from_file(default_path())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    two, six = ({r["doc_id"]: r for r in found(spark, n)} for n in ("op2_bpe", "op6_token_counts"))
    assert len(two) == len(six) == len(docs)
    for d, t, _, _ in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert (two[d]["n_tokens"], two[d]["ids_sha256"], two[d]["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
        assert (six[d]["n_tokens"], six[d]["n_bytes"], six[d]["over_limit"]) == (len(ids), len((t or "").encode()), len(ids) > 2048)


def changed(spark, folder, table, change):
    """A folder with the tables, one of them changed."""
    for t in ("documents", "labels"):
        df = spark.read.parquet(f"{SF}/{t}.parquet")
        (change(df) if t == table else df).write.parquet(f"{folder}/{t}.parquet")
    return str(folder)


def test_op3_learns_only_from_labels_outside_the_fold(spark, docs, tmp_path):
    rows = {r["doc_id"]: r for r in found(spark, "op3_quality")}
    assert len(rows) == len(docs)
    for d, r in rows.items():
        assert r["held_out"] == (fold(d, 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    other = changed(spark, tmp_path / "a", "labels", lambda df: df.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality"))))
    again = {r["doc_id"]: r["score"] for r in found(spark, "op3_quality", other)}
    assert all(abs(again[d] - r["score"]) < 1e-9 for d, r in rows.items())
    tagged = changed(spark, tmp_path / "b", "documents", lambda df: df.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("q")))
    assert all(abs(r["score"] - rows[r["doc_id"]]["score"]) < 1e-9 for r in found(spark, "op3_quality", tagged))


def test_op5_base_spans(spark, docs):
    from test_secrets import slow

    rows = {r["doc_id"]: r for r in found(spark, "op5_secrets")}
    for d, t, _, _ in docs:
        base = slow(t or "")
        r = rows[d]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == kind for _, k, _ in base) for kind in range(3))
        assert r["base_sha256"] == hashlib.sha256(secret_scan.spelled(base).encode()).hexdigest()
        assert set(secret_scan.spelled(base).split(",")) - {""} <= set(r["spans"].split(","))


@pytest.mark.parametrize("scale", ["0.001", "0.01"])
def test_op7_against_all_pairs(spark, scale):
    from test_neardup import sets_of

    folder = f"/root/testdata/sf{scale}"
    if not os.path.exists(folder):
        pytest.skip("no test tables")
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    sets = sets_of(rows, 4)
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in holders[x] if j > i)
        for j, both in common.items():
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    want = {d: (len(sets[i]), least[root(i)], d == least[root(i)]) for i, (d, _) in enumerate(rows)}
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in found(spark, "op7_near_duplicates", folder)} == want


def plain_language(docs):
    """Word-first backoff by dictionaries, learnt from rows outside the fold."""
    words, total = defaultdict(Counter), Counter()
    for d, t, lang, _ in docs:
        if t is not None and lang is not None and fold(d, 4) != 2:
            for w in langid.words_of(t):
                words[w][lang] += 1
                total[lang] += 1
    langs = sorted(total)
    grams = defaultdict(Counter)
    for w, c in words.items():
        for g in langid.grams_of(w):
            for lang, n in c.items():
                grams[g][lang] += n

    def logs(c, times):
        v = [math.log((c[x] + 0.1) / (total[x] * times + 1)) for x in langs]
        return np.array(v) - sum(v) / len(v)

    known = {w: logs(c, 1) for w, c in words.items() if sum(c.values()) >= 2}
    parts = {g: logs(c, 8) for g, c in grams.items() if sum(c.values()) >= 2}

    def of_word(w):
        if w in known:
            return known[w]
        w, at, out = f"^{w}$", 0, np.zeros(len(langs))
        while at < len(w):
            n = next((n for n in (5, 4, 3, 2, 1) if at + n <= len(w) and w[at : at + n] in parts), None)
            if n:
                out = out + parts[w[at : at + n]]
            at += n or 1
        return out

    def predict(t):
        ws = langid.words_of(t or "")
        if not ws:
            return "und", 0.0
        v = sum(of_word(w) for w in ws)
        if not np.any(v):
            return max(langs, key=lambda x: total[x]), 1 / len(langs)
        return langs[int(np.argmax(v))], float(1 / np.exp((v - v.max()) / math.sqrt(len(ws))).sum())

    return predict


def test_op8_equals_a_plain_predictor(spark, docs):
    predict = plain_language(docs)
    rows = {r["doc_id"]: r for r in found(spark, "op8_language")}
    assert len(rows) == len(docs)
    for d, t, lang, _ in docs:
        name, score = predict(t)
        assert (rows[d]["lang_pred"], rows[d]["held_out"]) == (name, fold(d, 4) == 2) and abs(rows[d]["score"] - score) < 1e-3
    held = [(rows[d]["lang_pred"], lang) for d, t, lang, _ in docs if fold(d, 4) == 2 and lang is not None and (t or "").strip()]
    assert sum(a == b for a, b in held) / len(held) > 0.95
