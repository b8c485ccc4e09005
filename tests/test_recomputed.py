"""Queries that SQL can't express, recomputed from the same tables in plain Python and numpy."""

import math
import os
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from citeloom.operators import text_models as M
from citeloom.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")


def rows_of(sql):
    return duckdb.connect().execute(re.sub(r"@(\w+)", rf"read_parquet('{SF}/\1.parquet')", sql)).fetchall()


@pytest.fixture(scope="module")
def vectors():
    rows = rows_of("SELECT vec_id, label, embedding FROM @embeddings ORDER BY vec_id")
    return [r[0] for r in rows], np.array([r[1] for r in rows]), np.array([r[2] for r in rows], float)


def got(spark, name):
    assert name not in ORACLE_SQL
    return QUERIES[name](spark, SF).collect()


def whitened(m):
    c = m - m.mean(0)
    axis = np.linalg.svd(c, full_matrices=False)[2][0]
    c = c - np.outer(c @ axis, axis)
    return c / c.std(0, ddof=1)


def test_whiten(spark, vectors):
    ids, _, m = vectors
    want = whitened(m)
    at = {v: i for i, v in enumerate(ids)}
    rows = got(spark, "whiten")
    assert len(rows) == m.size and max(abs(r["x"] - want[at[r["vec_id"]], r["i"]]) for r in rows) < 1e-4


def test_project_2d(spark, vectors):
    ids, _, m = vectors
    c = m - m.mean(0)
    axes = np.linalg.svd(c, full_matrices=False)[2][:2].T
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), range(2)])
    p = c @ axes
    p = p / np.abs(p).max() * 100
    for r in got(spark, "project_2d"):
        assert np.allclose([r["x"], r["y"]], p[ids.index(r["vec_id"])], atol=2e-3)


def test_discriminant_axes(spark, vectors):
    ids, labels, m = vectors
    mean, n = m.mean(0), len(m)
    between = sum((labels == x).sum() * np.outer(m[labels == x].mean(0) - mean, m[labels == x].mean(0) - mean) for x in set(labels.tolist())) / n
    within = sum(((m[labels == x] - m[labels == x].mean(0)).T @ (m[labels == x] - m[labels == x].mean(0))) for x in set(labels.tolist())) / n + 1e-3 * np.eye(m.shape[1])
    half = np.linalg.inv(np.linalg.cholesky(within))
    values, q = np.linalg.eigh(half @ between @ half.T)
    axes = (half.T @ q)[:, ::-1][:, :2]
    axes = axes / np.linalg.norm(axes, axis=0)
    want = np.abs(m @ axes)
    for r in got(spark, "discriminant_axes"):
        assert np.allclose([r["x"], r["y"]], want[ids.index(r["vec_id"])], atol=1e-4)


def test_svd_documents(spark):
    counts = defaultdict(Counter)
    for doc, term in rows_of("SELECT l_suppkey, p_name FROM @lineitem JOIN @part ON l_partkey = p_partkey"):
        counts[doc][term] += 1
    docs, terms = sorted(counts), sorted({t for c in counts.values() for t in c})
    df = Counter(t for c in counts.values() for t in c)
    a = np.array([[counts[x][t] * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t in terms] for x in docs])
    a = a / np.linalg.norm(a, axis=1, keepdims=True)
    axes = np.linalg.svd(a, full_matrices=False)[2][:4].T
    want = np.abs(a @ axes)
    want = want / (np.linalg.norm(want, axis=1, keepdims=True) + 1e-8)
    rows = got(spark, "svd_documents")
    assert len(rows) == 4 * len(docs) and max(abs(abs(r["x"]) - want[docs.index(r["doc"]), r["i"]]) for r in rows) < 1e-3


def test_fuzzy_clusters(spark):
    def ratio(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        return 200 * table[-1][-1] / (len(a) + len(b))

    parts = rows_of("SELECT p_partkey, p_size, p_type, p_name || ' ' || p_brand FROM @part ORDER BY p_partkey")
    titles = {k: " ".join(re.sub("[^a-z0-9 ]+", " ", t.lower()).split()) for k, _, _, t in parts}
    blocks = defaultdict(list)
    for k, size, kind, _ in parts:
        blocks[size, kind].append(k)
    want = {}
    for keys in blocks.values():
        for i, k in enumerate(keys):
            if k in want:
                continue
            want[k] = k
            for j in keys[i + 1 :]:
                if j not in want and ratio(titles[k], titles[j]) >= 90:
                    want[j] = k
    assert {r["key"]: r["cluster"] for r in got(spark, "fuzzy_clusters")} == want


def test_tfidf_labels(spark):
    tf = defaultdict(Counter)
    for lang, text in rows_of("SELECT lang, text FROM @documents WHERE lang IS NOT NULL"):
        words = [w for w in re.findall(r"[A-Za-z][A-Za-z\-]{2,}", (text or "").lower()) if w not in M.STOP]
        tf[lang].update(words)
        tf[lang].update(map(" ".join, zip(words, words[1:], strict=False)))
    df = Counter(t for c in tf.values() for t in c)
    want = {}
    for lang, c in tf.items():
        w = {t: n * (math.log(5 / (df[t] + 1)) + 1) for t, n in c.items() if 2 <= df[t] <= 3}
        length = math.sqrt(sum(x * x for x in w.values()))
        kept, roots = [], set()
        for t in sorted(w, key=lambda t: (-round(w[t] / length, 9), t))[:24]:
            if len(kept) < 8 and (" " in t or t not in roots):
                kept.append(t)
                roots.add(t.split(" ")[0])
        want[lang] = ",".join(kept)
    assert {r["lang"]: r["labels"] for r in got(spark, "tfidf_labels")} == want


def test_cosine_histograms(spark, vectors):
    m = vectors[2]

    def median(x):
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        return float(np.median((u @ u.T)[np.triu_indices(len(u), 1)]))

    rows = got(spark, "cosine_histograms")
    for stage, x in (("before", m), ("after", whitened(m))):
        mine = [r for r in rows if r["stage"] == stage]
        assert abs(mine[0]["median"] - median(x)) < 0.03 and 10_000 < sum(r["n"] for r in mine) <= 21_000


def test_converged_rank(spark):
    by = defaultdict(set)
    for order, part in rows_of("SELECT DISTINCT l_orderkey, l_partkey FROM @lineitem"):
        by[order].add(part)
    w = Counter((a, b) for ps in by.values() for a in ps for b in ps if a < b)
    links = [p for p, n in w.items() if n >= 2]
    nodes = sorted({x for p in links for x in p})
    at = {x: i for i, x in enumerate(nodes)}
    a = np.zeros((len(nodes), len(nodes)))
    for x, y in links:
        a[at[x], at[y]] = a[at[y], at[x]] = 1
    a = a / a.sum(1, keepdims=True)
    rank = np.full(len(nodes), 1 / len(nodes))
    for _ in range(200):
        rank = 0.15 / len(nodes) + 0.85 * rank @ a
    found = {r["node"]: r["rank"] for r in got(spark, "pagerank_converged")}
    assert set(found) == set(nodes) and max(abs(found[x] - rank[at[x]]) for x in nodes) < 1e-3
