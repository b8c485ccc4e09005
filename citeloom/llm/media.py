"""Media columns: content-defined chunks, stored once, put together again and verified.

A text's UTF-8 bytes, padded with 255 to a positive multiple of 576, become the 8-bit samples of a grey image of that width
(binary PGM): the medium. A gear hash rolls over the medium's bytes (each byte shifts the hash and adds its table value);
a chunk ends where the hash's upper bits are zero, between least and most bytes. A medium is stored as the ordered list of
its chunks' digests; a chunk's bytes are stored once, whoever has them, compressed with a dictionary made from a bounded
sample. Joins on the digests leave out chunks that an earlier store holds already and bring the bytes back in order, from
both stores; the medium is verified against its hash, parsed, and its samples are read. A chunk that is in neither store
raises an error, no row is lost.

The chunk table is bucketed by digest, so reading back moves only references to the chunks and chunks to their media. A
chunk that more than hot_refs media share is joined by broadcast while all such chunks fit hot_bytes, else by salted keys.

Null texts count as empty: one row of 576 padding bytes. Equal texts give one medium and equal values. Rows pass one to
one, repeated and null ids included; columns other than the id are not carried. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ._common import arrow_map, arrow_stream, materialize, pieces_of, shared_dir, table

WIDTH = 576
#: One 32-bit value for each byte, by rule.
GEAR = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=4, person=b"gear").digest(), "big") for b in range(256)], np.uint32)


def as_medium(text: str | None) -> tuple[int, bytes]:
    """Number of bytes before padding, and the image file."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    rows = max(1, -(-len(raw) // WIDTH))
    return len(raw), b"P5\n%d %d\n255\n" % (WIDTH, rows) + raw + b"\xff" * (rows * WIDTH - len(raw))


def samples(medium: bytes) -> np.ndarray:
    """The image's samples, rows by WIDTH."""
    magic, size, depth, data = medium.split(b"\n", 3)
    width, rows = map(int, size.split())
    if magic != b"P5" or depth != b"255" or len(data) != width * rows:
        raise ValueError("not a whole 8-bit image")
    return np.frombuffer(data, np.uint8).reshape(rows, width)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: sum of table values shifted by their distance, modulo 2^32, by doubling the window."""
    h = GEAR[data]
    for s in (1, 2, 4, 8, 16):
        if len(h) <= s:
            break
        h = np.concatenate([h[:s], h[s:] + (h[:-s] << np.uint32(s))])
    return h


def chunk_ends(data: bytes, least: int = 1024, bits: int = 12, most: int = 32768) -> list[int]:
    """Where chunks end. least is above the hash's reach of 32 bytes, so the hash needs no restart at a cut."""
    n = len(data)
    if n <= least:
        return [n]
    cuts = (np.flatnonzero(gear_hashes(np.frombuffer(data, np.uint8)) >> np.uint32(32 - bits) == 0) + 1).tolist()
    ends, at = [], 0
    while n - at > least:
        k = bisect.bisect_left(cuts, at + least)
        at = min(cuts[k] if k < len(cuts) else n, at + most, n)
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def chunks_of(medium: bytes) -> list[tuple[bytes, bytes]]:
    """(digest, bytes) in order."""
    out, at = [], 0
    for end in chunk_ends(medium):
        part = medium[at:end]
        out.append((hashlib.blake2b(part, digest_size=16).digest(), part))
        at = end
    return out


def feature(grey: np.ndarray) -> str:
    """Rows, mean sample, and which of 64 equal stretches are above the mean."""
    flat = grey.ravel()
    mean = float(flat.mean())
    bits = "".join("1" if float(part.mean()) > mean else "0" for part in np.array_split(flat, 64))
    return f"{grey.shape[0]}:{mean:.4f}:{int(bits, 2):016x}"


def _dictionary(docs: DataFrame, text_col: str, count: int, rows: int = 1600, width: int = 8192) -> bytes:
    """A compression dictionary from the first characters of about rows texts, chosen by hash. It shapes stored bytes only, no result."""
    import zstandard

    full = 1 << 30
    share = min(full, 2 * rows * full // max(1, count))
    chosen = docs.where((F.length(text_col) > 0) & (F.pmod(F.xxhash64(text_col), F.lit(full)) < share)).limit(4 * rows)
    got = chosen.select(F.substring(text_col, 1, width).alias("t")).collect()  # 4 * rows * width characters at most
    got = sorted(got, key=lambda r: hashlib.blake2b(r["t"].encode("utf-8", "surrogatepass"), digest_size=8).digest())[:rows]
    parts = [p for r in got for p in [r["t"].encode("utf-8", "surrogatepass")[i : i + 2048] for i in range(0, len(r["t"]), 2048)]]
    if sum(map(len, parts)) < 1 << 20:
        return b""
    return zstandard.train_dictionary(1 << 18, parts).as_bytes()


class Store:
    """manifests: id, n_bytes, media_bytes, media_sha256, digests; chunks: name of the bucketed table (digest, data); known: an earlier store that has what is left out here."""

    def __init__(self, manifests: DataFrame, chunks: str, dictionary, buckets: int, id_col: str, known: Store | None = None):
        self.manifests, self.chunks, self.dictionary, self.buckets, self.id_col, self.known = manifests, chunks, dictionary, buckets, id_col, known

    def generations(self) -> list[Store]:
        """This store and those before it."""
        return [self, *(self.known.generations() if self.known is not None else [])]

    def every_chunk(self) -> DataFrame:
        """digest, data and of (which generation's dictionary reads it)."""
        spark, out = self.manifests.sparkSession, None
        for i, store in enumerate(self.generations()):
            part = spark.table(store.chunks).withColumn("of", F.lit(i))
            out = part if out is None else out.unionByName(part)
        return out

    def forget(self) -> None:
        """Take the chunk table out of the catalogue; its files stay in the application's folder."""
        self.manifests.sparkSession.sql(f"DROP TABLE IF EXISTS {self.chunks}")


def _coder(dictionary: bytes, read: bool):
    import zstandard

    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdDecompressor(dict_data=d) if read else zstandard.ZstdCompressor(level=12, dict_data=d, write_dict_id=False, write_checksum=False)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: Store | None = None) -> Store:
    """Store the media of all texts. known: an earlier store; the chunks that it holds are left out here."""
    spark = docs.sparkSession
    docs = docs.select(id_col, text_col)

    def manifest():
        def work(texts):
            rows = []
            for t in texts:
                n, medium = as_medium(t)
                rows.append((n, len(medium), hashlib.sha256(medium).digest(), [d for d, _ in chunks_of(medium)]))
            return list(zip(*rows, strict=True))

        return work

    manifests = materialize(arrow_map(docs, [text_col], "n_bytes long, media_bytes long, media_sha256 binary, digests array<binary>", manifest, [id_col]), "media-manifests")
    dictionary = spark.sparkContext.broadcast(_dictionary(docs, text_col, manifests.count()))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, seen = _coder(dictionary.value, read=False), set()
        for b in pieces_of(batches):
            keys, data, size = [], [], 0
            for t in b.column(0).to_pylist():
                for digest, part in chunks_of(as_medium(t)[1]):
                    if digest not in seen:
                        seen.add(digest)
                        keys.append(digest)
                        data.append(coder.compress(part))
                        size += len(data[-1])
                if size > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(data, pa.binary())], names=["digest", "data"])
                    keys, data, size = [], [], 0
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(data, pa.binary())], names=["digest", "data"])

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            pick = []
            for i, d in enumerate(b.column(0).to_pylist()):
                if d not in seen:
                    seen.add(d)
                    pick.append(i)
            if pick:
                yield b.take(pa.array(pick))

    chunks = arrow_stream(docs.select(text_col), cut, "digest binary, data binary")
    if known is not None:
        chunks = chunks.join(known.every_chunk().select("digest"), "digest", "left_anti")
    name = f"media_chunks_{uuid.uuid4().hex}"
    unique = arrow_stream(chunks.repartition(buckets, "digest"), once, "digest binary, data binary")
    unique.write.bucketBy(buckets, "digest").option("path", f"{shared_dir(spark)}/{name}").option("compression", "uncompressed").saveAsTable(name)
    return Store(manifests, name, dictionary, buckets, id_col, known)


def restore(kept: Store, made: str, read, hot_refs: int = 2000, hot_bytes: int = 1 << 26) -> DataFrame:
    """One row per distinct medium: media (the first 16 bytes of its hash) and the columns made, which read(medium) gives; each medium is verified first."""
    spark = kept.manifests.sparkSession
    chunks, dictionaries = kept.every_chunk(), [g.dictionary for g in kept.generations()]
    media = kept.manifests.groupBy(F.substring("media_sha256", 1, 16).alias("media")).agg(F.first("digests").alias("digests"))
    refs = media.select("media", F.posexplode("digests").alias("pos", "digest"))
    hot = refs.groupBy("digest").count().where(F.col("count") > hot_refs).select("digest")
    hot = materialize(hot.join(chunks, "digest", "left"), "media-hot")
    much = hot.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("data")), F.lit(0)).alias("b")).first()
    if not much["n"]:
        found = refs.join(chunks.hint("merge"), "digest", "left")
    elif much["b"] <= hot_bytes:
        found = refs.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(chunks.hint("merge"), "digest", "left").unionByName(refs.join(F.broadcast(hot), "digest"))  # hot_bytes at most
    else:
        salts = 64
        found = refs.join(hot.select("digest"), "digest", "left_anti").join(chunks, "digest", "left").unionByName(
            refs.withColumn("salt", F.pmod(F.xxhash64("media"), F.lit(salts))).join(hot.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["digest", "salt"]).drop("salt")
        )
    schema = _parse_datatype_string(f"media binary, {made}")
    arrow = to_arrow_schema(schema)
    names = arrow.names

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = [_coder(d.value, read=True) for d in dictionaries]
        key, parts, rows = None, [], []

        def flush():
            medium = b"".join(parts)
            if hashlib.sha256(medium).digest()[:16] != key:
                raise ValueError("a medium differs from what was stored")
            rows.append((key, *read(medium)))

        def out():
            frame = pa.Table.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=arrow)
            rows.clear()
            return frame.to_batches()

        for b in batches:
            for k, data, of in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                if data is None:
                    raise ValueError("a chunk of a medium is in no store")
                if k != key:
                    if key is not None:
                        flush()
                    key, parts = k, []
                parts.append(coders[of].decompress(data))
            if len(rows) >= 1000:
                yield from out()
        if key is not None:
            flush()
        yield from out()

    in_order = found.select("media", "data", "pos", "of").repartition(kept.buckets, "media").sortWithinPartitions("media", "pos").select("media", "data", "of")
    return arrow_stream(in_order, assemble, schema)


def op4_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = store(table(spark, sf_dir, "documents"))

    def read(medium: bytes):
        grey = samples(medium)
        payload = grey.tobytes()
        return hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), feature(grey), len(payload)

    back = materialize(restore(kept, "payload_sha256 string, tail_crc32 long, feature string, payload_bytes long", read), "media-read")
    kept.forget()
    out = kept.manifests.select("doc_id", "n_bytes", "media_bytes", "media_sha256", F.substring("media_sha256", 1, 16).alias("media")).join(back, "media", "left")
    payload = F.coalesce("payload_sha256", F.raise_error(F.lit("a medium was not read back"))).alias("payload_sha256")
    return out.select("doc_id", "n_bytes", "payload_bytes", payload, "tail_crc32", "media_bytes", F.lower(F.hex("media_sha256")).alias("media_sha256"), "feature")
