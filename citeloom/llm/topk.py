"""Exact top-k inner products by norm buckets.

All vectors are range-partitioned and sorted by length, longest first; a task meets them in buckets, mostly of like length.
Spark may read the files in another order and a bucket may run over the end of one, so each bucket is sorted again. For a
query and a bucket the local cosine threshold is the query's k-th best score so far over (its length times the bucket's
longest). Above 1 the bucket is passed over. From coordinate_cut on the bucket is pruned by coordinates: a vector that
reaches the threshold must lie in a known interval of each coordinate, so the query's few largest coordinates select
candidates from sorted lists. Below it, it is pruned by length: only vectors with length >= score / query length, a front
part of the bucket. What is left is verified by its full integer product. First bounds come from the seed_rows longest
vectors.

Queries are a stated set; they go through in blocks of block_queries, each broadcast (a bounded size) against all rows. The
cost is one pass over the rows a block, and k rows a query and partition of the rows: made for few queries against many rows.

Vectors are floor(scale * x) in integers; products are exact (Python integers where 2^53 could be passed). Ties go to the
smaller id. Rows with a null id, a null vector, or a null or non-finite component take no part. Only vectors of a query's
own dimension are its candidates. Rows that bear the query's id are not candidates for it; if an id repeats among queries,
its smallest vector asks; candidate rows that repeat count one by one. Fewer candidates than k give fewer rows, and an empty
table none. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import materialize, ship, table

_SLACK = 1e-9


def integer_vectors(frame: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, v (array of long) and norm of the rows that take part."""
    x = F.transform(F.col(vector_col), lambda e: e.cast("double"))
    whole = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    out = frame.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), x.alias("x")).where(whole)
    out = out.select("id", F.transform("x", lambda e: F.floor(e * F.lit(float(scale))).cast("long")).alias("v"))
    return out.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e)))


def _matrix(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows of each dimension: (row numbers, matrix)."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    return {int(d): (at := np.flatnonzero(sizes == d), flat[(begins[at][:, None] + np.arange(d)).ravel()].reshape(len(at), d)) for d in np.unique(sizes)}


class Best:
    """The k best of each of some queries of one dimension: scores and ids, and a lower bound of the k-th score."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, bounds: np.ndarray, k: int, coordinate_cut: float, focus: int = 3):
        self.ids, self.k, self.cut, self.focus = ids, k, coordinate_cut, focus
        self.vectors, self.peak = vectors, float(np.abs(vectors).max(initial=0))
        self.real = vectors.astype(float)
        self.norms = np.sqrt((self.real**2).sum(1))
        self.bound = bounds.astype(float)  # -inf: none yet
        self.rows: dict[int, list[tuple[int, int]]] = {}
        self.strongest = np.argsort(-np.abs(self.real), axis=1)[:, :focus]

    def take(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Merge scored pairs."""
        if not len(q):
            return
        order = np.lexsort((ids, -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        edges = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else []
        for a, b in zip(edges, [*edges[1:], len(q)], strict=True):
            one = int(q[a])
            b = min(b, a + self.k)
            new = [(-int(s), int(i)) for s, i in zip(scores[a:b], ids[a:b], strict=True)]
            kept = self.rows[one] = sorted(self.rows.get(one, []) + new)[: self.k]
            if len(kept) == self.k:
                self.bound[one] = max(self.bound[one], -kept[-1][0])

    def bucket(self, ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray, block: int = 1024) -> None:
        """Vectors of like length, in any order: files are read back in another order than they were written."""
        if not len(ids):
            return
        if np.any(norms[1:] > norms[:-1]):
            order = np.argsort(-norms, kind="stable")
            ids, vectors, norms = ids[order], vectors[order], norms[order]
        longest = float(norms[0])
        if self.peak * float(np.abs(vectors).max(initial=0)) * max(1, vectors.shape[1]) >= 2.0**53:
            self._exact(ids, vectors)
            return
        real, lists = vectors.astype(float), {}
        reach = self.norms * longest * (1 + _SLACK)
        alive = np.flatnonzero(reach >= self.bound)
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(reach > 0, self.bound / reach, -np.inf)
        narrow = alive[local[alive] >= self.cut]
        for q in narrow:
            self._by_coordinates(int(q), float(local[q]), ids, real, norms, lists)
        wide = alive[local[alive] < self.cut]
        for at in range(0, len(wide), block):
            q = wide[at : at + block]
            with np.errstate(divide="ignore", invalid="ignore"):
                least = np.where(self.norms[q] > 0, self.bound[q] / self.norms[q], -np.inf).min()
            front = len(norms) if least <= 0 else int(np.searchsorted(-norms, -least * (1 - _SLACK), side="right"))
            scores = self.real[q] @ real[:front].T
            i, j = np.nonzero((scores >= self.bound[q][:, None]) & (ids[:front][None, :] != self.ids[q][:, None]))
            if len(i) > 4 * self.k * len(q):  # no bound yet: keep what can be among the k best of each
                i, j = self._front(scores, ids[:front], self.ids[q])
            self.take(q[i], ids[j], scores[i, j])

    def _front(self, scores: np.ndarray, ids: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = min(self.k, scores.shape[1])
        scores = np.where(ids[None, :] == own[:, None], -np.inf, scores)
        least = np.maximum(np.partition(scores, scores.shape[1] - k, axis=1)[:, -k], -1e300)
        i, j = np.nonzero(scores >= least[:, None])
        return i, j

    def _by_coordinates(self, q: int, cosine: float, ids: np.ndarray, real: np.ndarray, norms: np.ndarray, lists: dict) -> None:
        """Candidates inside the interval of every focus coordinate: for unit vectors with product >= c, p_f is within q_f c +- sqrt((1 - c^2)(1 - q_f^2))."""
        found = None
        c = min(1.0, cosine * (1 - _SLACK))
        for f in self.strongest[q]:
            if f not in lists:
                with np.errstate(divide="ignore", invalid="ignore"):
                    unit = np.where(norms > 0, real[:, f] / norms, 0.0)
                order = np.argsort(unit, kind="stable")
                lists[f] = order, unit[order]
            order, unit = lists[f]
            x = self.real[q, f] / self.norms[q]
            wide = np.sqrt(max(0.0, (1 - c * c) * (1 - x * x))) + 1e-7
            a, b = np.searchsorted(unit, x * c - wide), np.searchsorted(unit, max(x, x * c) + wide, side="right")
            if x >= c:
                b = len(unit)
            if x <= -c:
                a = 0
            found = order[a:b] if found is None else np.intersect1d(found, order[a:b], assume_unique=True)
        scores = real[found] @ self.real[q]
        good = (scores >= self.bound[q]) & (ids[found] != self.ids[q])
        self.take(np.full(int(good.sum()), q), ids[found[good]], scores[good])

    def _exact(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        for q in range(len(self.ids)):
            scores = vectors.astype(object) @ self.vectors[q].astype(object)
            pairs = sorted((-int(s), int(i)) for s, i in zip(scores, ids, strict=True) if i != self.ids[q])
            self.rows[q] = sorted(self.rows.get(q, []) + pairs[: self.k])[: self.k]
            if len(self.rows[q]) == self.k:
                last = float(-self.rows[q][-1][0])
                self.bound[q] = max(self.bound[q], last - abs(last) * _SLACK - 1)


def top_products(vectors: DataFrame, query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, seed_rows: int = 2048, block_queries: int = 32768, bucket_rows: int = 2048, coordinate_cut: float = 0.9) -> DataFrame:
    """query_id, rank (from 1), the candidate's id under id_col, score. query: the condition on a row that makes it a query."""
    spark = vectors.sparkSession
    ship(spark)
    every = materialize(integer_vectors(vectors, id_col, vector_col, scale).transform(lambda d: d.repartitionByRange(F.desc("norm"), "id").sortWithinPartitions(F.desc("norm"), "id")), "topk-by-length")
    asked = integer_vectors(vectors.where(query), id_col, vector_col, scale).groupBy("id").agg(F.min("v").alias("v"))
    octave = F.floor(F.log2(F.greatest("norm", F.lit(1e-9))) * 8)
    cut, seen = None, 0
    for r in every.groupBy(octave.alias("bin")).count().orderBy(F.desc("bin")).collect():  # a row for each eighth of an octave
        cut, seen = r["bin"], seen + r["count"]
        if seen >= seed_rows:
            break
    full = 1 << 30
    longest = every.where((octave >= F.lit(cut if cut is not None else 0)) & (F.pmod(F.xxhash64("id"), F.lit(full)) < min(full, seed_rows * full // max(1, seen))))
    seeds = sorted(longest.limit(2 * seed_rows).collect(), key=lambda r: (-r["norm"], r["id"]))  # any rows give valid bounds; 2 * seed_rows at most
    lead = spark.sparkContext.broadcast((np.array([r["id"] for r in seeds], np.int64), [list(r["v"]) for r in seeds], np.array([r["norm"] for r in seeds])))

    def first_bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, norms = lead.value
        for b in batches:
            own = b.column(0).to_numpy()
            bound = np.full(len(own), -np.inf)
            for d, (at, m) in _matrix(b.column(1)).items():
                same = [i for i, r in enumerate(rows) if len(r) == d]
                best = Best(own[at], m, bound[at], k, 2.0)
                best.bucket(ids[same], np.array([rows[i] for i in same], np.int64).reshape(len(same), d), norms[same])
                bound[at] = best.bound
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bound)], names=["id", "v", "bound"])

    bounded = materialize(asked.mapInArrow(first_bounds, T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.ArrayType(T.LongType())), T.StructField("bound", T.DoubleType())])), "topk-queries")
    blocks = max(1, -(-bounded.count() // block_queries))
    found = None
    for block in range(blocks):
        rows = bounded.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).toArrow()  # about block_queries rows
        part = _against_all(every, spark.sparkContext.broadcast(_by_dimension(rows)), k, bucket_rows, coordinate_cut)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def _by_dimension(rows: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    rows = rows.combine_chunks()
    if not rows.num_rows:
        return {}
    ids, bound = rows.column("id").to_numpy(), rows.column("bound").to_numpy()
    column = rows.column("v").chunk(0) if isinstance(rows.column("v"), pa.ChunkedArray) else rows.column("v")
    return {d: (ids[at], m, bound[at]) for d, (at, m) in _matrix(column).items()}


def _against_all(every: DataFrame, queries, k: int, bucket_rows: int, coordinate_cut: float) -> DataFrame:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {d: Best(ids, m, bound, k, coordinate_cut) for d, (ids, m, bound) in queries.value.items()}
        for b in batches:
            ids, norms = b.column(0).to_numpy(), b.column(2).to_numpy()
            for d, (at, m) in _matrix(b.column(1)).items():
                if d in best:
                    for i in range(0, len(at), bucket_rows):
                        part = slice(i, i + bucket_rows)
                        best[d].bucket(ids[at[part]], m[part], norms[at[part]])
        rows = [(int(x.ids[q]), i, -s) for x in best.values() for q, kept in x.rows.items() for s, i in kept]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["query_id", "id", "score"])

    return every.mapInArrow(score, "query_id long, id long, score long")


def op10_topk_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
