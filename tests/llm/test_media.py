import hashlib
import random
import zlib

import numpy as np
import pytest

from citeloom.llm import media


def slow_hash(data):
    out, h = [], 0
    for b in data:
        h = ((h << 1) + int(media.GEAR[b])) & 0xFFFFFFFF
        out.append(h)
    return out


def test_gear_hash_is_the_rolling_one():
    data = bytes(random.Random(1).randrange(256) for _ in range(500))
    assert media.gear_hashes(np.frombuffer(data, np.uint8)).tolist() == slow_hash(data)


def test_chunks_cover_and_follow_content():
    r = random.Random(2)
    data = bytes(r.randrange(256) for _ in range(200_000))
    ends = media.chunk_ends(data)
    assert ends[-1] == len(data) and all(b - a <= 32768 for a, b in zip([0, *ends], ends, strict=False))
    moved = media.chunk_ends(b"some new start" + data)
    assert len({e + 14 for e in ends} & set(moved)) > 0.8 * len(ends)
    assert media.chunk_ends(b"") == [0] and media.chunk_ends(b"x" * 10) == [10]


def test_round_trip(spark):
    r = random.Random(3)
    long = "".join(r.choice("abcdefgh ") for _ in range(90_000))
    texts = [None, "", "x", "é" * 288, "a" * 576, "a" * 577, long, long + "!", long, "😀" * 1000]
    df = spark.createDataFrame([(i % 8 if i != 1 else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, media_sha256 int")
    kept = media.store(df)

    def read(medium):
        payload = media.samples(medium).tobytes()
        return hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])

    back = {bytes(x["media"]): x for x in media.restore(kept, "sha string, crc long", read, hot_refs=1).collect()}
    assert kept.manifests.count() == len(texts)
    want = {}
    for t in texts:
        raw = (t or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        want[hashlib.sha256(media.as_medium(t)[1]).digest()[:16]] = (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert {k: (v["sha"], v["crc"]) for k, v in back.items()} == want
    chunks = spark.table(kept.chunks)
    assert chunks.count() == chunks.select("digest").distinct().count()
    again = media.store(df.unionByName(spark.createDataFrame([(70, long + "?", 1)], df.schema)), known=kept)
    assert 0 < spark.table(again.chunks).count() < 5 and not spark.table(again.chunks).join(chunks, "digest").count()
    later = {bytes(x["media"]): x["sha"] for x in media.restore(again, "sha string, crc long", read, hot_refs=1, hot_bytes=1).collect()}
    assert len(later) == len(want) + 1 and all(later[k] == v[0] for k, v in want.items())


def test_a_missing_chunk_raises(spark):
    df = spark.createDataFrame([(1, "one text"), (2, "another text")], "doc_id long, text string")
    kept = media.store(df)
    name = f"{kept.chunks}_broken"
    spark.table(kept.chunks).limit(1).write.saveAsTable(name)
    kept.chunks = name
    for hot in (0, 2000):
        with pytest.raises(Exception, match="in no store"):
            media.restore(kept, "n long", lambda m: (len(m),), hot_refs=hot).collect()
    kept.forget()


def test_query_equals_plain_steps(spark, tmp_path):
    texts = [None, "", "x", "é" * 288, "a" * 577, "same", "same", "Z" * 5000]
    df = spark.createDataFrame([(i if i != 2 else None, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, feature string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = media.op4_media_chunks(spark, str(tmp_path)).collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[2 if r["doc_id"] is None else r["doc_id"]]
        raw = (t or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        medium = b"P5\n576 %d\n255\n" % (len(payload) // 576) + payload
        grey = np.frombuffer(payload, np.uint8)
        bits = [float(p.mean()) > float(grey.mean()) for p in np.array_split(grey, 64)]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(medium), hashlib.sha256(medium).hexdigest())
        assert r["feature"] == f"{len(payload) // 576}:{float(grey.mean()):.4f}:{sum(1 << (63 - i) for i, b in enumerate(bits) if b):016x}"


def test_empty(spark):
    kept = media.store(spark.createDataFrame([], "doc_id long, text string"))
    assert kept.manifests.count() == 0 and media.restore(kept, "n long", lambda m: (len(m),)).count() == 0
