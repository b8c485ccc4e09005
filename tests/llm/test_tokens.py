import hashlib
import random

import pytest
from pyspark.sql import functions as F

from citeloom.llm import bpe, token_counts
from citeloom.llm.vocabulary import default_path, loaded

tokenizers = pytest.importorskip("tokenizers")

TEXTS = [
    "Hello, World!  it's 42 degrees", "", " \n\t", "naïve CAFÉ ÅNGSTRÖM İstanbul ΑΣ ΟΔΟΣ", "<|endoftext|>mid<|startoftext|> end", "日本語 テキスト 한국어", "😀👍🏽 the🏳️‍🌈!!!", "a" * 5000,
    "!?" * 700, "x\x00y​z\x85w", "we'll I'M 'tis ''s 'S", "0123456789" * 30,
]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(default_path())


def texts():
    random.seed(5)
    pool = [chr(c) for c in [*range(0, 0x250), *range(0x370, 0x400), *range(0x2000, 0x2070), *range(0xAC00, 0xAC20)]]
    return TEXTS + ["".join(random.choice(pool) for _ in range(120)) for _ in range(60)]


def test_ids_counts_and_decoding_equal_the_library(library):
    with open(default_path(), encoding="utf-8") as f:
        spec = f.read()
    e, count = bpe.encoder(spec), token_counts.Counter(loaded(spec))
    digest = bpe.Digester(e)
    for t in texts():
        ids = library.encode(t, add_special_tokens=False).ids
        assert e.encode(t) == ids and count(t) == len(ids), repr(t)
        assert e.decode(ids) == library.decode(ids, skip_special_tokens=False)
        assert digest(t) == (len(ids), " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))


def test_every_code_point_alone_in_a_word_and_side_by_side(library):
    with open(default_path(), encoding="utf-8") as f:
        spec = f.read()
    e, count = bpe.encoder(spec), token_counts.Counter(loaded(spec))
    for first in range(0, 0x110000, 512):
        points = [chr(c) for c in range(first, first + 512) if not 0xD800 <= c < 0xE000]
        batch = [" ".join(f"Ab{c}c1" for c in points), " ".join(points), "".join(points)]
        for t, want in zip(batch, library.encode_batch(batch, add_special_tokens=False), strict=True):
            assert e.encode(t) == want.ids and count(t) == len(want.ids), hex(first)
            assert e.decode(want.ids) == library.decode(want.ids, skip_special_tokens=False)


def test_pairs_fit_as_merging_says():
    with open(default_path(), encoding="utf-8") as f:
        e = bpe.encoder(f.read())
    random.seed(9)
    ids = [i for i in random.sample(sorted(e.names), 6000) if e.stands(i)]
    short = [i for i in e.names if len(e.names[i]) <= 3 and e.stands(i)]
    seen = set()
    for _ in range(60_000):
        a, b = random.choice(random.choice([ids, short])), random.choice(random.choice([ids, short]))
        good = bpe.merged(list(e.names[a] + e.names[b]), e.v.ranks) == [e.names[a], e.names[b]]
        assert e.fits(a, b) == good, (e.names[a], e.names[b])
        seen.add(good)
    assert seen == {True, False}


def test_frames(spark, library):
    df = spark.createDataFrame([(1, t, "z") for t in texts()] + [(None, None, "z"), (1, "twice", "z"), (1, "twice", "z")], "doc_id long, text string, n_tokens string")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = bpe.encode_digests(df).collect()
    assert len(rows) == df.count()
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == sha(" ".join(map(str, ids))) and r["decoded_sha256"] == sha(library.decode(ids, skip_special_tokens=False))
    for r in token_counts.token_counts(df, limit=50).collect():
        n = len(library.encode(r["text"] or "", add_special_tokens=False).ids)
        assert (r["n_tokens"], r["over_limit"], r["n_bytes"]) == (n, n > 50, len((r["text"] or "").encode()))
    back = bpe.decode(bpe.encode(df.withColumn("decoded", F.lit("old")))).collect()
    assert all(r["decoded"] == library.decode(r["token_ids"], skip_special_tokens=False) for r in back)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_digests(df).count() == 0 and token_counts.token_counts(df).count() == 0
