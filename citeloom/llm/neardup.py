"""Near-duplicate detection by bottom-k sketches of one hash function.

1. A document is the set of its distinct word shingles, hashed by one function. Equal sets form a class, known by a 64-bit
   number: half of the set's 128-bit hash, and the other half for sets whose numbers would clash. From here on a class
   stands for all its copies.
2. Its sketch is the k smallest hashes. Sketch values go into inverted lists. Classes of similarity s share at least t of
   their sketch values (exactly s * n for sets that fit the sketch; for larger ones all but six standard deviations of the
   binomial), so it is enough to list the first (size - t + 1) of them in an order common to all: values that more than
   hot_list documents hold among their first ones come last, so a passage that many documents share makes no long list; only
   classes made almost wholly of such values are listed under them. Classes with few such values list their first 16 or 32
   others, where the chance that no common value is among them stays below 1e-9 at similarity 0.8. Of classes with a fifth
   of common values among their first ones, all values are counted, as all may be listed. (Sketches are a
   probabilistic method; against all pairs, tests and the README's figures show no link lost.)
3. In each list a hub (the smallest set) is compared with the other members. Lists whose members are not of one component
   then go on without it: those of small_list members or fewer compare what is left across components; longer ones, families
   of edited copies, compare what is outside their largest component with all, in blocks of bounded size by exact counts. No
   list is cut.
4. A pair whose union sketch (of the 64 smallest values) puts its similarity 0.25 or more below the threshold, five standard
   deviations, is dropped; the others are verified on their full sets, and only these link.

Null and empty texts, and texts of white space, have an empty set: 0 shingles, linked with nothing, kept. Rows with a null
id take part in no group: component_id null, kept. Repeated rows are copies of one another; rows of one id share what the
id's class gives. A component's id is the smallest id of its rows. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ._common import arrow_map, arrow_stream, enter, materialize, pieces_of, ship, table
from .vocabulary import Memo

SKETCH = 96
#: Values of the estimate, and those of a sketch that are counted to find common ones.
HEAD, COUNTED = 64, 32
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


class Shingler:
    """Whole texts to sorted distinct 64-bit shingle hashes."""

    def __init__(self, words: int):
        self.words = words
        self.memo = Memo(lambda w: int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little"))

    def __call__(self, text: str | None) -> np.ndarray:
        """A-Z are lowered; words are separated by space and bytes 9 to 13; a text of fewer words is one shingle."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(self.memo.__getitem__, words), np.uint64, len(words))
        n = min(self.words, len(h))
        total = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            total = total * _MIX[0] + h[i : len(h) - n + 1 + i]
        total ^= total >> np.uint64(30)
        total *= _MIX[1]
        total ^= total >> np.uint64(27)
        total *= _MIX[2]
        total ^= total >> np.uint64(31)
        return np.unique(total)


def set_key(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, text_col: str, words: int, k: int = SKETCH, keep: list[str] | None = None) -> DataFrame:
    """docs with n_shingles, set_key (equal for equal sets) and sketch (k smallest hashes, 8 bytes each)."""

    def make():
        shingle = Shingler(words)

        def work(texts):
            rows = [(len(s), set_key(s), s[:k].tobytes()) for s in map(shingle, texts)]
            return list(zip(*rows, strict=True))

        return work

    return arrow_map(docs, [text_col], "n_shingles long, set_key binary, sketch binary", make, keep)


def _half(at: int) -> Column:
    """Eight bytes of set_key as a number."""
    return F.conv(F.hex(F.substring("set_key", at, 8)), 16, -10).cast("long")


def _number(clash: list[int]) -> Column:
    """The number of a class: half of its set_key; where that is among clash, the other half."""
    return F.when(_half(1).isin(clash), _half(9)).otherwise(_half(1)) if clash else _half(1)


def number_of(key: bytes, clash: set[int]) -> int:
    number = int.from_bytes(key[:8], "big", signed=True)
    return int.from_bytes(key[8:], "big", signed=True) if number in clash else number


def least_shared(n: int, k: int, percent: int) -> int:
    """How many sketch values a class of n shingles shares with any partner of the similarity asked for."""
    s = percent / 100
    if n <= s * k:
        return -(-n * percent // 100)
    return max(1, math.floor(s * k - 6 * math.sqrt(s * (1 - s) * k)))


def listed(sketch: np.ndarray, n: int, hot: np.ndarray, k: int, percent: int) -> np.ndarray:
    """The sketch values under which a class is listed."""
    prefix = len(sketch) - least_shared(n, k, percent) + 1
    rare = sketch[~_among(sketch, hot)]
    share = 1 - len(rare) / len(sketch)
    if percent >= 80 and share <= 0.5:
        return rare[: min(prefix, 16 if share <= 0.2 else 32)]
    if len(rare) >= prefix:
        return rare[:prefix]
    return np.union1d(rare, sketch[: max(16, prefix if percent < 80 else 0)])


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def components(edges: DataFrame, a: str = "a", b: str = "b", spread: int = 1000) -> DataFrame:
    """key and root (its component's smallest key) of all keys of the edges, by least labels and pointer jumping until nothing changes; each round is written to the shared folder.

    The label of a key with more than spread edges goes to one copy of it for each spread edges, so that no task gets all of them.
    """
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).union(edges.select(F.col(b), F.col(a))).distinct()
    both = materialize(both, "edges")
    hot = _hot(both, "y", spread)
    both, way = _dealt(both, hot, "y", "x")
    label = materialize(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("root")).select(F.col("x").alias("key"), "root"), "labels")
    while True:
        near = both.join(_copied(label.withColumnRenamed("key", "y"), hot, "y"), way).groupBy("x").agg(F.min("root").alias("near"))
        hooked = label.join(near, label["key"] == near["x"]).select("key", "root", F.least("root", "near").alias("low"))
        up = label.select(F.col("key").alias("low"), F.col("root").alias("above"))
        step = materialize(hooked.join(up, "low", "left").select("key", F.least("low", F.coalesce("above", "low")).alias("new"), "root"), "labels")
        moved = step.where(F.col("new") != F.col("root")).limit(1).count()
        label = step.select("key", F.col("new").alias("root"))
        if not moved:
            return label


def _hot(rows: DataFrame, key: str, spread: int) -> DataFrame | None:
    """key and ways of the keys with more than spread rows; None if there is none."""
    hot = materialize(rows.groupBy(key).agg(F.ceil(F.count("*") / F.lit(spread)).cast("int").alias("ways")).where("ways > 1"), "hot-keys")
    many = hot.count()
    return None if not many else F.broadcast(hot) if many <= 100_000 else hot  # at most a row for each spread rows; sent if 100,000 or fewer


def _dealt(rows: DataFrame, hot: DataFrame | None, key: str, other: str) -> tuple[DataFrame, list[str]]:
    """rows with the way that each takes to its key, by other; the columns to join on."""
    if hot is None:
        return rows, [key]
    return rows.join(hot, key, "left").withColumn("way", F.pmod(F.xxhash64(other), F.coalesce("ways", F.lit(1))).cast("int")).drop("ways"), [key, "way"]


def _copied(values: DataFrame, hot: DataFrame | None, key: str) -> DataFrame:
    """values with a row for each way to its key."""
    if hot is None:
        return values
    return values.join(hot, key, "left").withColumn("way", F.explode(F.sequence(F.lit(0), F.coalesce("ways", F.lit(1)) - 1))).drop("ways")


class KeyBits:
    """A bit table over 64-bit hashes: tells those that may be among the ones it was made from. Two bits a hash, 8 bits of room."""

    def __init__(self, bits: int, hashes: DataFrame):
        mask = F.lit((1 << bits) - 1).cast("long")
        both = hashes.select(F.explode(F.array(F.col("h").bitwiseAND(mask), F.shiftrightunsigned("h", 32).bitwiseAND(mask))).alias("bit"))
        rows = both.groupBy(F.shiftright("bit", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 31 as int))")).alias("set")).toArrow()
        self.mask = np.uint64((1 << bits) - 1)
        self.words = np.zeros(1 << bits - 5, np.uint32)
        self.words[rows.column("word").to_numpy()] = rows.column("set").to_numpy().astype(np.uint32)

    @staticmethod
    def of(hashes: DataFrame, most: int = 1 << 24) -> KeyBits | None:
        """From column h. None above most hashes: a table of 8 bits each would be more than 16 MB, and joins do without."""
        count = hashes.count()
        return KeyBits(max(20, (8 * count).bit_length()), hashes) if count <= most else None

    def among(self, hashes: np.ndarray) -> np.ndarray:
        h = hashes.view(np.uint64)
        one, two = h & self.mask, h >> np.uint64(32) & self.mask
        bit = lambda at: self.words[at >> np.uint64(5)] >> (at & np.uint64(31)).astype(np.uint32) & np.uint32(1)
        return (bit(one) & bit(two)).astype(bool)


def may_be(rows: DataFrame, hash_col: str, hashes: DataFrame, among: bool = True, bits: KeyBits | None = None) -> DataFrame:
    """The rows whose hash_col (64-bit hash) may be among hashes (column h), so that a join moves hardly any other; or, with among=False, the rest. All rows if a bit table would be too large. bits: their table, if it is made already."""
    bits = KeyBits.of(hashes) if bits is None else bits
    if bits is None:
        return rows if among else rows.limit(0)
    sent = rows.sparkSession.sparkContext.broadcast(bits)  # 16 MB at most

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            at = batch.schema.get_field_index(hash_col) if at is None else at
            yield batch.filter(pa.array(sent.value.among(batch.column(at).to_numpy()) == among, pa.bool_()))

    return arrow_stream(rows, keep, rows.schema)


def only(sets: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of sets (key) that have one of keys (key), or, where those are many, may have one: so that a join moves hardly any other."""
    if keys.count() <= 1 << 20:
        return sets.join(F.broadcast(keys.distinct()), "key", "left_semi")  # 2^20 numbers at most
    return may_be(sets, "key", keys.select(F.col("key").alias("h")).distinct())


def _id_hash(id_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("string"))


def full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words: int, clash: list[int]) -> DataFrame:
    """key and set (sorted hashes) of the classes of wanted (key, least), read from the documents of the least ids.

    A bit table over both goes to the readers of the texts, so that hardly any other set is written; what it lets through
    besides finds no partner in the joins. No shuffle. Where there are too many classes for the table, the texts of the
    least ids come by a join.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), _id_hash(id_col).alias("h"), F.col(text_col).alias("text"))
    bits = KeyBits.of(wanted.select(F.col("key").bitwiseXOR(_id_hash("least")).alias("h")))
    if bits is None:
        rows = rows.join(wanted.select(F.col("least").alias("id")).distinct(), "id", "left_semi")
    sent = spark.sparkContext.broadcast(bits)  # 16 MB at most
    bad = set(clash)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, listed, seen = Shingler(words), sent.value, set()

        def out(keys, sets):
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.binary())], names=["key", "set"])

        for batch in pieces_of(batches):
            keys, sets, size = [], [], 0
            for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = shingle(t)
                if not len(s):
                    continue
                key = number_of(set_key(s), bad)
                if key not in seen and (listed is None or listed.among(np.array([key ^ h], np.int64))[0]):
                    seen.add(key)
                    keys.append(key)
                    sets.append(s.tobytes())
                    size += len(sets[-1])
                if size > 1 << 22:
                    yield out(keys, sets)
                    keys, sets, size = [], [], 0
            if keys:
                yield out(keys, sets)

    return materialize(arrow_stream(rows.select("h", "text"), read, "key long, set binary"), "sets", "uncompressed")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Exactly, on full sets."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def estimate(x: np.ndarray, y: np.ndarray, k: int) -> float:
    """The share of the union's sketch that both sketches hold."""
    union = np.union1d(x, y)[:k]
    return np.isin(np.intersect1d(x, y, assume_unique=True), union).sum() / len(union)


def paired(pairs: DataFrame, values: DataFrame, spread: int = 1000) -> DataFrame:
    """a, b, x and y: the pairs with what values (key, set) has of both. What belongs to a, a hub of maybe many pairs, goes to the place of b; a hub's pairs are dealt out, spread to a task."""
    hot = _hot(pairs, "a", spread)
    dealt, way = _dealt(pairs, hot, "a", "b")
    mine = _copied(only(values, pairs.select(F.col("a").alias("key"))).toDF("a", "x"), hot, "a")
    yours = only(values, pairs.select(F.col("b").alias("key"))).toDF("b", "y")
    return dealt.join(mine, way).select("a", "b", "x").join(yours, "b").select("a", "b", "x", "y")


def chosen(rows: DataFrame, good) -> DataFrame:
    """The pairs of rows (a, b, x, y) for which good(x, y), two arrays of hashes, holds."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            held = [good(np.frombuffer(x[i].as_py(), np.uint64), np.frombuffer(y[i].as_py(), np.uint64)) for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(held, pa.bool_()))

    return arrow_stream(rows, check, "a long, b long").distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar: estimated by the heads of the sets, then counted on the full sets of those left."""
    heads = sets.select("key", F.substring("set", 1, 8 * HEAD).alias("set"))
    likely = materialize(chosen(paired(pairs, heads), lambda x, y: estimate(x, y, HEAD) > percent / 100 - 0.25), "likely")
    return materialize(chosen(paired(likely, sets), lambda x, y: similar(x, y, percent)), "links")


def inverted_lists(signed: DataFrame, percent: int, k: int, hot_list: int, max_hot: int) -> DataFrame:
    """v (a sketch value), key, n, hub and hub_n (the smallest member) of the lists; members without another of like size are left out. signed: key, n, sketch; copies are met once a task."""
    spark = signed.sparkSession

    def counted(known: np.ndarray | None) -> DataFrame:
        """v of the values that more than hot_list documents hold: of the first values of all, or, given those, of the further values of classes that hold many of them."""
        sent = spark.sparkContext.broadcast(known)  # max_hot values at most

        def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for b in batches:
                out = [np.empty(0, np.uint64)]
                for key, sketch in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                    if key in seen:
                        continue
                    seen.add(key)
                    v = np.frombuffer(sketch, np.uint64)
                    if sent.value is None:
                        out.append(v[:COUNTED])
                    elif 5 * _among(v[:COUNTED], sent.value).sum() >= min(len(v), COUNTED):
                        out.append(v[COUNTED:])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64))], names=["v"])

        counts = arrow_stream(signed, values, "v long").groupBy("v").count().where(F.col("count") > hot_list)
        return materialize(counts, "hot-values")

    def most_common(counts: DataFrame) -> np.ndarray:
        if counts.count() > max_hot:
            counts = counts.orderBy(F.desc("count"), "v").limit(max_hot)
        return np.sort(counts.select("v").toArrow().column("v").to_numpy().view(np.uint64))

    first = counted(None)
    common = most_common(first)
    if len(common):
        common = most_common(first.unionByName(counted(common)).groupBy("v").agg(F.sum("count").alias("count")))
    hot = spark.sparkContext.broadcast(common)  # max_hot values at most

    def index(wide: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for b in batches:
                out, keys, sizes = [], [], []
                for key, n, sketch in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                    if key in seen:
                        continue
                    seen.add(key)
                    v = listed(np.frombuffer(sketch, np.uint64), n, hot.value, k, percent)
                    v = v[_among(v, hot.value) == wide]
                    out.append(v)
                    keys.append(np.full(len(v), key, np.int64))
                    sizes.append(np.full(len(v), n, np.int64))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.concatenate(keys)), pa.array(np.concatenate(sizes))], names=["v", "key", "n"])

        return arrow_stream(signed, run, "v long, key long, n long")

    once = index(wide=False).repartition("v").groupBy("v", "key").agg(F.min("n").alias("n"))
    by_size = Window.partitionBy("v").orderBy("n", "key")
    near = (F.lag("n").over(by_size) * 100 >= F.col("n") * percent) | (F.col("n") * 100 >= F.lead("n").over(by_size) * percent)
    # a member is of use only where the next smaller or larger set is near enough in size
    near_ones = once.withColumn("near", F.coalesce(near, F.lit(False))).where("near").select("v", "key", "n")
    narrow = near_ones.withColumn("hub", F.first("key").over(by_size)).withColumn("hub_n", F.first("n").over(by_size))
    common = materialize(index(wide=True).groupBy("v", "key").agg(F.min("n").alias("n")), "wide-lists")
    hubs = common.groupBy("v").agg(F.min(F.struct("n", "key")).alias("hub")).select("v", F.col("hub.key").alias("hub"), F.col("hub.n").alias("hub_n"))
    broad = common.join(F.broadcast(hubs), "v").select("v", "key", "n", "hub", "hub_n")  # a row for each of max_hot values at most
    return materialize(narrow.unionByName(broad), "lists")


def unsettled(lists: DataFrame, label: DataFrame | None) -> DataFrame:
    """v, key, n, root, size and weight (of the list) of the lists that hold several components beside their hub."""
    rest = lists.where("key <> hub").select("v", "key", "n")
    rest = rest.withColumn("root", F.col("key")) if label is None else rest.join(label, "key", "left").withColumn("root", F.coalesce("root", "key"))
    rest = materialize(rest, "rest")
    state = {"size": F.count("*"), "weight": F.sum("n"), "low": F.min("root"), "high": F.max("root")}
    mixed = rest.groupBy("v").agg(*[x.alias(name) for name, x in state.items()]).where("low <> high").select("v", "size", "weight")
    mixed = materialize(mixed, "mixed")  # apart, so that a long list can be split in the join
    return materialize(rest.join(mixed, "v").select("v", "key", "n", "root", "size", "weight"), "lists")


def linked_classes(docs: DataFrame, signed: DataFrame, classes: DataFrame, clash: list[int], id_col: str, text_col: str, words: int, percent: int, k: int, hot_list: int, small_list: int, max_hot: int) -> DataFrame | None:
    """key and root of the classes that have a link to another one; None if none has."""
    lists = inverted_lists(signed, percent, k, hot_list, max_hot)
    wanted = materialize(classes.join(lists.select("key").distinct(), "key").select("key", "least"), "wanted")
    if wanted.isEmpty():
        return None
    sets = full_sets(docs, wanted, id_col, text_col, words, clash)
    pairs = lists.where("key <> hub").where(F.col("hub_n") * 100 >= F.col("n") * percent).select(F.col("hub").alias("a"), F.col("key").alias("b")).distinct()
    pairs = materialize(pairs, "pairs")
    links = verified(pairs, sets, percent)
    label = components(links) if not links.isEmpty() else None
    rest = unsettled(lists, label)
    if rest.isEmpty():
        return label
    small = rest.where(F.col("size") <= small_list)
    left, right = (small.select("v", F.col("key").alias(c), F.col("n").alias(f"n{c}"), F.col("root").alias(f"r{c}")) for c in "ab")
    across = left.join(right, "v").where((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent))  # small_list members at most
    done = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = materialize(across.select("a", "b").distinct().join(done, ["a", "b"], "left_anti"), "pairs")
    found = links if more.isEmpty() else links.unionByName(verified(more, sets, percent))
    large = rest.where(F.col("size") > small_list)
    if not large.isEmpty():
        found = found.unionByName(materialize(linked_in_blocks(large, sets, percent), "links"))
    return components(found) if not found.isEmpty() else None


def linked_in_blocks(lists: DataFrame, sets: DataFrame, percent: int, block_rows: int = 4096, block_hashes: int = 1_000_000) -> DataFrame:
    """Links that join what is similar within long lists: (a, b) of each member and its component's first.

    In each list the members outside its largest component are compared with all: both are cut into blocks of bounded rows
    and hashes, and every pair of blocks is one group, which counts the common hashes of its pairs exactly by products of
    matrices and gives one link a member, not the pairs. The work grows with those outside times all.
    """
    parts = lists.groupBy("v", "root").agg(F.count("*").alias("members"), F.sum("n").alias("hashes"))
    most = parts.groupBy("v").agg(F.max(F.struct("members", "root", "hashes")).alias("m"), F.sum("members").alias("all_members"), F.sum("hashes").alias("all_hashes"))
    count = lambda rows, hashes: F.greatest(F.ceil(rows / F.lit(block_rows)), F.ceil(hashes / F.lit(block_hashes)), F.lit(1)).cast("int")
    grid = most.select(
        "v",
        F.col("m.root").alias("main"),
        count(F.col("all_members"), F.col("all_hashes")).alias("blocks"),
        count(F.col("all_members") - F.col("m.members"), F.col("all_hashes") - F.col("m.hashes")).alias("outer_blocks"),
    )
    cut = lists.join(grid, "v")
    spot = lambda blocks: F.pmod(F.xxhash64("key"), F.col(blocks)).cast("int")
    each = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    everyone = cut.select("v", "key", each("outer_blocks").alias("i"), spot("blocks").alias("j"), F.lit(False).alias("outer"))
    outside = cut.where("root <> main").select("v", "key", spot("outer_blocks").alias("i"), each("blocks").alias("j"), F.lit(True).alias("outer"))
    rows = everyone.unionByName(outside).groupBy("v", "i", "j", "key").agg(F.max("outer").alias("outer")).join(only(sets, lists.select("key")), "key")

    def link(group: pa.Table) -> pa.Table:
        enter(__name__)
        group = group.sort_by([("outer", "descending"), ("key", "ascending")])
        keys = group.column("key").to_numpy()
        fresh = np.concatenate([[True], keys[1:] != keys[:-1]])  # a set may have been read twice
        keys, outer = keys[fresh], group.column("outer").to_numpy(zero_copy_only=False)[fresh]
        roots = similar_components([np.frombuffer(s.as_py(), np.uint64) for s in group.column("set").filter(pa.array(fresh))], percent, first=int(outer.sum()))
        at = np.flatnonzero(roots != np.arange(len(roots)))
        return pa.table({"a": pa.array(keys[roots[at]]), "b": pa.array(keys[at])})

    return rows.select("v", "i", "j", "key", "outer", "set").groupBy("v", "i", "j").applyInArrow(link, "a long, b long").distinct()


def similar_components(sets: list[np.ndarray], percent: int, step: int = 512, first: int | None = None) -> np.ndarray:
    """For each set the smallest index of its component under similarity of percent or more; with first, only pairs that hold one of the first sets count."""
    count = len(sets)
    first = count if first is None else first
    sizes = np.array([len(s) for s in sets], np.int64)
    rows = np.repeat(np.arange(count), sizes)
    _, column, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    wide = df > max(4, count // 4)
    place = np.cumsum(wide) - 1
    dense = np.zeros((count, int(wide.sum())), np.float32)
    dense[rows[wide[column]], place[column[wide[column]]]] = 1
    thin = ~wide[column] & (df[column] > 1)
    order = np.argsort(column[thin], kind="stable")
    owners = rows[thin][order]  # members of each rarer hash, one after the other
    begin = np.concatenate([[0], np.cumsum(np.where(~wide & (df > 1), df, 0))])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    label = np.arange(count)
    for at in range(0, first, step):
        common = dense[at : min(at + step, first)] @ dense.T
        for r in range(len(common)):
            i = at + r
            c = column[starts[i] : starts[i + 1]]
            c = c[~wide[c] & (df[c] > 1)]
            both = common[r].astype(np.int64)
            if len(c):
                both += np.bincount(np.concatenate([owners[begin[x] : begin[x + 1]] for x in c]), minlength=count)
            near = np.unique(label[100 * both >= percent * (sizes + sizes[i] - both)])
            if len(near) > 1:
                label[np.isin(label, near)] = near[0]
    return label


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, k: int = SKETCH, hot_list: int = 64, small_list: int = 64, max_hot: int = 1_000_000) -> DataFrame:
    """One row per row of docs: id_col, n_shingles, set_key, component_id (smallest id of the component) and kept (id = component_id)."""
    ship(docs.sparkSession)
    signed = materialize(signatures(docs.select(id_col, text_col), text_col, words, k, [id_col]), "signatures")
    real = signed.where((F.col("n_shingles") > 0) & F.col(id_col).isNotNull())

    def classes_of(clash: list[int]) -> DataFrame:
        grouped = real.groupBy(_number(clash).alias("key"))
        return materialize(grouped.agg(F.min(id_col).alias("least"), F.min(_half(9)).alias("low"), F.max(_half(9)).alias("high")), "classes")

    classes = classes_of([])
    clash = [r["key"] for r in classes.where("low <> high").select("key").collect()]  # of n classes, about n * n / 2^65
    if clash:
        classes = classes_of(clash)
    numbered = real.select(_number(clash).alias("key"), F.col("n_shingles").alias("n"), "sketch")
    label = linked_classes(docs.where(F.col(id_col).isNotNull()), numbered, classes, clash, id_col, text_col, words, percent, k, hot_list, small_list, max_hot)
    least = classes.select("key", "least")
    if label is not None:
        linked = least.join(label, "key")
        top = linked.groupBy("root").agg(F.min("least").alias("top"))
        least = least.join(linked.join(top, "root").select("key", "top"), "key", "left").select("key", F.coalesce("top", "least").alias("least"))
    own = (F.col("n_shingles") > 0) & F.col(id_col).isNotNull()
    rows = signed.select(id_col, "n_shingles", "set_key", F.when(own, _number(clash)).otherwise(_id_hash(id_col)).alias("key"), own.alias("own"))  # rows without a class are spread by their ids
    out = rows.join(least, "key", "left")
    component = F.when(F.col("own"), F.col("least")).otherwise(F.col(id_col))
    return out.select(id_col, "n_shingles", "set_key", component.alias("component_id"), F.coalesce(component == F.col(id_col), F.lit(True)).alias("kept"))


def free_name(taken: list[str], name: str) -> str:
    """name, with as many underscores before it as no column has."""
    while name.lower() in {c.lower() for c in taken}:
        name = "_" + name
    return name


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, **how) -> DataFrame:
    """The rows of docs without near duplicates: one of each component stays, that of its smallest id; of its repeated rows, one. All columns stay. Rows with a null id or an empty set stay.

    Rows of ids that have one row to keep don't move: a bit table over the ids where something goes lets them pass. Only of the others are sets made again and joined with the decisions.
    """
    found = materialize(near_duplicates(docs, id_col, text_col, words, **how).where(F.col(id_col).isNotNull() & (F.col("n_shingles") > 0)), "decisions")
    touched = materialize(found.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("n"), F.min("kept").alias("all_kept")).where("n > 1 or not all_kept").select("id"), "touched")
    if touched.isEmpty():
        return docs
    mark, key, rank = (free_name(docs.columns, c) for c in ("mark", "key", "rank"))
    hashes = touched.select(_id_hash("id").alias("h")).distinct()
    marked = docs.withColumn(mark, F.coalesce(_id_hash(id_col), F.lit(0)))
    whole = [F.col(f"`{c}`") for c in docs.columns]
    bits = KeyBits.of(hashes)
    sent = docs.sparkSession.sparkContext.broadcast(bits)  # 16 MB at most
    stay = may_be(marked, mark, hashes, among=False, bits=bits).select(*whole)

    def keyed_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, places = Shingler(words), None
        for batch in pieces_of(batches):
            if sent.value is not None:
                batch = batch.filter(pa.array(sent.value.among(batch.column(mark).to_numpy()), pa.bool_()))
            places = places or [i for i, c in enumerate(batch.schema.names) if c != mark]
            keys = pa.array([set_key(shingle(t)) for t in batch.column(text_col).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in places], keys], names=[*[batch.schema.names[i] for i in places], key])

    keyed = arrow_stream(marked, keyed_ones, StructType([*docs.schema.fields, StructField(key, BinaryType())]))
    gone = found.where(~F.col("kept")).select(F.col(id_col).alias("gone_id"), F.col("set_key").alias("gone_key")).distinct()
    d = keyed.alias("d")
    rest = d.join(gone, (F.col(f"d.`{id_col}`") == F.col("gone_id")) & (F.col(f"d.`{key}`") == F.col("gone_key")), "left_anti")
    again = found.where("kept").groupBy(F.col(id_col).alias("again_id")).count().where(F.col("count") > 1).select("again_id")
    if not again.isEmpty():
        same = F.col(f"d.`{id_col}`") == F.col("again_id")
        bare = F.col(f"d.`{key}`") == F.lit(set_key(np.empty(0, np.uint64)))
        one = Window.partitionBy(id_col).orderBy(key, text_col)
        repeated = rest.join(again, same, "left_semi").where(~bare).withColumn(rank, F.row_number().over(one)).where(F.col(rank) == 1).drop(rank)
        rest = rest.join(again, same & ~bare, "left_anti").select(*keyed.columns).unionByName(repeated.select(*keyed.columns))
    return stay.unionByName(rest.select(*whole))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4).select("doc_id", "n_shingles", "component_id", "kept")
