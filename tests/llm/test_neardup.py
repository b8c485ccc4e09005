import random

import numpy as np

from citeloom.llm import neardup


def sets_of(rows, words):
    out = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        out.append(frozenset(tuple(w[j : j + words]) for j in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else []))
    return out


def brute(rows, words, percent=80):
    s = sets_of(rows, words)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and rows[i][0] is not None and rows[j][0] is not None:
                both = len(s[i] & s[j])
                if 100 * both >= percent * (len(s[i]) + len(s[j]) - both):
                    a, b = sorted((find(i), find(j)))
                    parent[b] = a
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(s[i]), least.get(find(i)) if d is not None else None) for i, (d, _) in enumerate(rows)]


def corpus(seed, family=90):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijk") for _ in range(5))
    rows, passage = [], [word() for _ in range(60)]
    base = [word() for _ in range(100)]
    for i in range(family):  # edited copies, from hardly to strongly
        w = list(base)
        for _ in range(r.randrange(12)):
            w[r.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    for i in range(family, family + 90):  # a common passage with more or less around it
        rows.append((i, " ".join([word() for _ in range(r.randrange(40))] + passage + [word() for _ in range(r.randrange(40))])))
    for i in range(60):
        w = [word() for _ in range(r.choice([1, 2, 3, 4, 5, 30, 300]))]
        rows += [(1000 + 3 * i, " ".join(w)), (1001 + 3 * i, " ".join(w).upper()), (1002 + 3 * i, " ".join(w[: len(w) * 9 // 10]))]
    return rows + [(None, "lost text of five words"), (None, "lost text of five words"), (5000, None), (5001, ""), (5002, " \t"), (0, rows[0][1])]


def test_components_equal_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_shingles int")
        got = neardup.near_duplicates(df, words=4, hot_list=20, small_list=10).collect()
        key = lambda x: (str(x[0]), x[1], str(x[2]))
        assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=key) == sorted(brute(rows, 4), key=key)
        assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)


def test_other_thresholds(spark):
    rows = corpus(5, 60)
    df = spark.createDataFrame([(d, t) for d, t in rows], "doc_id long, text string")
    key = lambda x: (str(x[0]), x[1], str(x[2]))
    for words, percent in ((3, 60), (5, 95)):
        got = neardup.near_duplicates(df, words=words, percent=percent, hot_list=20, small_list=10).collect()
        assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=key) == sorted(brute(rows, words, percent), key=key)


def test_clashing_class_numbers_take_the_other_half(spark, monkeypatch):
    rows = corpus(6, 20)
    df = spark.createDataFrame([(d, t) for d, t in rows], "doc_id long, text string")
    whole = neardup.set_key
    monkeypatch.setattr(neardup, "set_key", lambda h: b"\x00" * 7 + bytes([whole(h)[0] % 8]) + whole(h)[8:])  # eight numbers for all
    signed = [(i, len(s), neardup.set_key(s), s[: neardup.SKETCH].tobytes()) for i, s in ((d, neardup.Shingler(4)(t)) for d, t in rows)]
    frame = spark.createDataFrame([(d, n, bytearray(k), bytearray(x)) for d, n, k, x in signed], "doc_id long, n_shingles long, set_key binary, sketch binary")
    monkeypatch.setattr(neardup, "signatures", lambda *a, **k: frame)
    clash = neardup.number_of(signed[0][2], set())
    assert neardup.number_of(signed[0][2], {clash}) == int.from_bytes(signed[0][2][8:], "big", signed=True)
    got = {r["k"] for r in frame.select(neardup._number([clash]).alias("k")).collect()}
    assert got == {neardup.number_of(k, {clash}) for _, _, k, _ in signed}


def test_hubs_of_many_pairs_are_dealt_out(spark):
    star = spark.createDataFrame([(1, n) for n in range(2, 60)] + [(100, 101), (101, 102)], "a long, b long")
    got = {r["key"]: r["root"] for r in neardup.components(star, spread=7).collect()}
    assert got == {n: 1 for n in range(1, 60)} | {100: 100, 101: 100, 102: 100}
    sets = spark.createDataFrame([(n, bytearray(np.arange(n, n + 3, dtype=np.uint64).tobytes())) for n in [*range(1, 60), 100, 101, 102]], "key long, set binary")
    pairs = neardup.paired(star, sets, spread=7).collect()
    assert sorted((r["a"], r["b"]) for r in pairs) == sorted((r["a"], r["b"]) for r in star.collect())
    assert all(np.frombuffer(r["x"], np.uint64)[0] == r["a"] and np.frombuffer(r["y"], np.uint64)[0] == r["b"] for r in pairs)


def test_without_bit_tables_all_pass(spark):
    rows = spark.range(50).selectExpr("id", "xxhash64(id) AS h")
    half = rows.where("id < 25").select("h")
    few = neardup.KeyBits.of(half)
    assert few is not None and neardup.KeyBits.of(half, most=10) is None
    kept = {r["id"] for r in neardup.may_be(rows, "h", half).collect()}
    rest = {r["id"] for r in neardup.may_be(rows, "h", half, among=False).collect()}
    assert set(range(25)) <= kept and kept | rest == set(range(50)) and not kept & rest


def test_one_of_each_group_stays(spark):
    rows = corpus(3, 30)
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, kept string")
    out = neardup.drop_near_duplicates(df)
    assert out.columns == df.columns
    want = brute(rows, 5)
    heads = {c if n else d for d, n, c in want if d is not None}
    left = [r["doc_id"] for r in out.collect()]
    assert sorted(d for d in left if d is not None) == sorted(heads) and left.count(None) == 2


def test_block_counts_are_exact():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 120).astype(np.uint64)
    sets = []
    for _ in range(90):
        s = base.copy()
        at = rng.choice(120, int(rng.integers(0, 40)), replace=False)
        s[at] = rng.integers(0, 2**63, len(at)).astype(np.uint64)
        sets.append(np.unique(s))
    parent = list(range(90))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(90):
        for j in range(i):
            if neardup.similar(sets[i], sets[j], 80):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    assert neardup.similar_components(sets, 80, step=32).tolist() == [find(i) for i in range(90)]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(df).count() == 0 and neardup.drop_near_duplicates(df).count() == 0
