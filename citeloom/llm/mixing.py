"""Mixing sources to target weights by balanced (cube) sampling.

Every source gets a target number of words; ratio = target / words of the source. Each of its documents is taken
floor(ratio) times for certain and once more with the fractional rest as inclusion probability. The cube method settles
who gets that extra copy: probabilities move through the null space of the balancing totals (words and documents of the
source), three documents at a time, until each is 0 or 1 and the totals still hold. At most two documents of a source stay
undecided in a block; these meet again in blocks of blocks, level by level, and the last two of a source are landed on the
choice nearest its targets. What that landing leaves of a source's words is settled by turning over a few documents: of each
power of two of sizes, four that got the extra copy and four that did not are at choice, and the one that brings the total
nearest is turned as long as that helps.

Blocks hold about block_rows documents and are formed by a hash of the row, whatever its source, so a hot source is spread
over all of them. The draw of each move is a hash of the seed and the ids: reruns agree.

Size: number of [^\\x20\\x09-\\x0D]+ in the text. Null or empty texts have size 0 and are taken 0 words. A null source is a
source of its own, last in order. Repeated rows (equal id and text) are drawn each on its own, and turned over together. A source without words has target 0. An empty
table gives an empty result. mix() carries no other columns; mix_rows() carries all.
The table of sources goes through the driver; it may hold max_sources at most, and more raise an error.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import WORD, enter, materialize, ship, table

WEIGHTS = (5.0, 2.0, 1.0)
_LEVEL = "id string, source string, size long, pi double, block long, tag long"


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> dict[str | None, float]:
    """The target of each source: weights in code point order (null last), shares of all words, none above most times its words."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total = float(sum(sizes.values()))
    out: dict[str | None, float] = {}
    free = [s for s in order]
    rest = total
    while free:
        share = rest / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * share > most * sizes[s]]
        if not over:
            out |= {s: weight[s] * share for s in free}
            break
        for s in over:
            out[s] = most * sizes[s]
            rest -= out[s]
        free = [s for s in free if s not in out]
    return out


def _tag(id_col: str, text_col: str, seed: int) -> Column:
    own = F.col(id_col).cast("string")
    return F.xxhash64(F.lit(seed), own.isNull(), own, F.col(text_col).isNull(), F.col(text_col))


def _draw(seed: int, *what) -> float:
    return int.from_bytes(hashlib.blake2b(repr((seed, *what)).encode(), digest_size=7).digest(), "big") / 2.0**56


def flight(sizes: np.ndarray, pi: np.ndarray, uniform) -> np.ndarray:
    """Move pi in the null space of (words, documents) until at most two entries are neither 0 nor 1.

    Three open entries span a null space of (s2-s3, s3-s1, s1-s2), or (1, -1, 0) where their sizes are equal; a step goes
    as far as it can one way or the other, each with the probability that keeps the expectation.
    """
    pi = pi.astype(float).copy()
    eps = 1e-9
    held: list[int] = []
    coming = iter(range(len(pi)))
    while True:
        while len(held) < 3:
            k = next(coming, None)
            if k is None:
                break
            if eps < pi[k] < 1 - eps:
                held.append(k)
            else:
                pi[k] = round(pi[k])
        if len(held) < 3 and not (len(held) == 2 and sizes[held[0]] == sizes[held[1]]):
            return pi
        if len(held) == 2:
            move = (1.0, -1.0)
        else:
            s = [float(sizes[k]) for k in held]
            move = (s[1] - s[2], s[2] - s[0], s[0] - s[1])
            if not any(move):
                move = (1.0, -1.0, 0.0)
        up = min((1 - pi[k]) / m if m > 0 else pi[k] / -m for k, m in zip(held, move, strict=True) if m)
        down = min(pi[k] / m if m > 0 else (1 - pi[k]) / -m for k, m in zip(held, move, strict=True) if m)
        step = up if uniform(held) < down / (up + down) else -down
        for k, m in zip(held, move, strict=True):
            pi[k] += step * m
        settled = [k for k in held if not eps < pi[k] < 1 - eps]
        for k in settled:
            pi[k] = round(pi[k])
        held = [k for k in held if k not in settled]


def land(sizes: np.ndarray, pi: np.ndarray) -> np.ndarray:
    """Settle what the flight left open (two at most): the choice nearest the totals of words, then of documents."""
    left = [k for k in range(len(pi)) if 1e-9 < pi[k] < 1 - 1e-9]
    want = sum(pi[k] * sizes[k] for k in left), sum(pi[k] for k in left)
    best = min(range(1 << len(left)), key=lambda c: (abs(sum(sizes[k] for i, k in enumerate(left) if c >> i & 1) - want[0]), abs(bin(c).count("1") - want[1]), c))
    out = pi.round()
    for i, k in enumerate(left):
        out[k] = best >> i & 1
    return out


def turned(missing: float, weights: np.ndarray, copies: np.ndarray, steps: int = 64) -> np.ndarray:
    """Which units (weights in words; copies 1: has the extra copy, 0: not) to turn over, so that the words come nearest to missing more than now."""
    change = np.where(copies > 0, -weights, weights).astype(float)
    turn = np.zeros(len(change), bool)
    for _ in range(steps):
        left = np.where(turn, np.inf, np.abs(missing - change))
        k = int(np.argmin(left)) if len(left) else 0
        if not len(left) or left[k] >= abs(missing) - 1e-9:
            break
        turn[k] = True
        missing -= change[k]
    return turn


def _turn(group: pa.Table) -> pa.Table:
    enter(__name__)
    group = group.sort_by([(c, "ascending") for c in ("weight", "extra", "id", "tag")])
    chosen = turned(float(group.column("missing")[0].as_py()), group.column("weight").to_numpy().astype(float), group.column("extra").to_numpy())
    return group.filter(pa.array(chosen)).select(["id", "tag", "extra"])


def _settle(seed: int, level: int, last: bool):
    def run(group: pa.Table) -> pa.Table:
        enter(__name__)
        group = group.sort_by([("source", "ascending"), ("size", "descending"), ("id", "ascending"), ("tag", "ascending")])
        sizes, pi = group.column("size").to_numpy(), group.column("pi").to_numpy().copy()
        ids = group.column("id").to_pylist()
        code = group.column("source").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        for c in range(code.max() + 1 if len(code) else 0):
            where = np.flatnonzero(code == c)
            own, s = pi[where], sizes[where]
            own = flight(s, own, lambda held, w=where: _draw(seed, level, *[str(ids[w[k]]) for k in held]))
            pi[where] = land(s, own) if last else own
        return group.select(["id", "source", "size", "block", "tag"]).add_column(3, "pi", pa.array(pi))

    return run


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, seed: int = 0, block_rows: int = 2000, max_sources: int = 100_000) -> DataFrame:
    """One row per document: id_col, source, size, tag (of id and text), source_size, target, copies and taken (words)."""
    spark = docs.sparkSession
    ship(spark)
    sized = materialize(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).cast("string").alias("source"),
            F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            _tag(id_col, text_col, seed).alias("tag"),
        ),
        "mix-sizes",
    )
    totals = sized.groupBy("source").agg(F.sum("size").alias("s"), F.count("*").alias("n"))
    rows = totals.limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} sources; raise max_sources or merge them first")
    sizes = {r["source"]: r["s"] for r in rows}
    want = targets(sizes, weights, most)
    plan = spark.createDataFrame([(s, sizes[s], float(want[s])) for s in sizes], "source string, source_size long, target double")
    n = sum(r["n"] for r in rows)
    blocks = max(1, -(-n // block_rows))
    on = sized["source"].eqNullSafe(plan["source"])
    joined = sized.join(F.broadcast(plan), on).select(sized["*"], "source_size", "target")  # max_sources rows at most
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    open_ = joined.select(
        F.to_json(F.struct("id")).alias("id"),
        "source",
        "size",
        (ratio - F.floor(ratio)).alias("pi"),
        F.pmod("tag", F.lit(blocks)).alias("block"),
        "tag",
    )
    done, level = [], 0
    while True:
        last = blocks == 1
        if level == 0 and not last:
            grouped = open_.groupBy("block")  # all sources of a block together: even, whatever their shares
        else:
            grouped = open_.groupBy("source", "block")
        moved = materialize(grouped.applyInArrow(_settle(seed, level, last), _LEVEL), f"mix-level{level}")
        if last:
            done.append(moved)
            break
        settled = (F.col("pi") <= 0) | (F.col("pi") >= 1)
        done.append(moved.where(settled))
        blocks = -(-blocks // 1000)
        open_ = moved.where(~settled).withColumn("block", F.pmod(F.xxhash64("block", F.lit(level)), F.lit(blocks)))
        level += 1
    chosen = done[0]
    for d in done[1:]:
        chosen = chosen.unionByName(d)
    on = chosen["source"].eqNullSafe(plan["source"])
    chosen = chosen.join(F.broadcast(plan), on).select(chosen["*"], "source_size", "target")
    copies = F.when(F.col("size") > 0, F.floor(ratio) + F.col("extra")).otherwise(F.lit(0)).cast("long")
    chosen = materialize(chosen.withColumn("extra", F.round("pi").cast("long")).drop("pi"), "mix-chosen")
    # the landing: a few units of each power of two of sizes, by source
    taken = chosen.groupBy("source").agg((F.first("target") - F.sum(copies * F.col("size"))).alias("missing"))
    spare = F.when(F.col("extra") > 0, F.lit(True)).otherwise(F.floor(ratio) + 1 <= most)
    units = chosen.where((F.col("size") > 0) & spare).groupBy("source", "extra", "id", "tag").agg(F.sum("size").alias("weight"))
    octave = Window.partitionBy("source", "extra", F.floor(F.log2("weight"))).orderBy("tag", "id")
    units = units.withColumn("rank", F.row_number().over(octave)).where("rank <= 4").drop("rank")
    offered = units.join(F.broadcast(taken.withColumnRenamed("source", "of")), F.col("source").eqNullSafe(F.col("of"))).drop("of")  # max_sources rows at most
    turns = materialize(offered.groupBy("source").applyInArrow(_turn, "id string, tag long, extra long"), "mix-turns")
    turns = turns.withColumn("turn", F.lit(True))
    kind = sized.schema["id"].dataType.simpleString()
    out = chosen.join(turns, ["id", "tag", "extra"], "left").withColumn("extra", F.when(F.col("turn"), 1 - F.col("extra")).otherwise(F.col("extra")))
    out = out.select(F.from_json("id", f"id {kind}")["id"].alias(id_col), "source", "size", "tag", "source_size", "target", copies.alias("copies"))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def mix_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0, **how) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with all their columns. Of equal rows (id and text) one stands for the copies that do not divide."""
    taken = mix(docs, id_col, text_col, source_col, seed=seed, **how)
    plan = materialize(taken.groupBy("tag").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")), "mix-plan")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # names of docs can't clash with those used here
    tagged = docs.select(_tag(id_col, text_col, seed).alias("tag"), whole).join(plan.where("copies > 0"), "tag")
    again = lambda n: F.explode(F.sequence(F.lit(1), n))
    each = F.floor(F.col("copies") / F.col("rows")).cast("int")
    out = tagged.where(each > 0).select("row", again(each).alias("i"))
    if not plan.where("rows > 1").isEmpty():
        rest = F.pmod("copies", "rows").cast("int")
        one = tagged.where((F.col("rows") > 1) & (rest > 0)).groupBy("tag").agg(F.first("row").alias("row"), F.first(rest).alias("rest"))
        out = out.unionByName(one.select("row", again(F.col("rest")).alias("i")))
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
