import base64
import bz2
import gzip
import random
import re
import urllib.parse
import zlib

from citeloom.llm import secret_scan as S

PLAIN = 'password = "hunter2hunter2"'


def slow(t):
    key = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
    out = [(m.start(), 0, m.end()) for m in re.finditer(rf"""(?:{key})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[1]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32])


def test_base_equals_plain_search():
    random.seed(1)
    bits = ["password", "Token", "api_key", "apikey", "secret", "=", ":", " ", '"', "abc", "AKIA", "ABCDEFGH12345678", "deadbeef" * 4, "é", "token=token=abcdefgh12", "x" * 9, "ſecret", "toKen"]
    for _ in range(3000):
        t = "".join(random.choice(bits) for _ in range(random.randint(0, 14)))
        assert S.base_spans(t) == slow(t), t


def test_layers_map_to_the_original():
    wraps = [
        urllib.parse.quote(PLAIN), urllib.parse.quote(urllib.parse.quote(PLAIN)), base64.b64encode(PLAIN.encode()).decode(), base64.b64encode(gzip.compress(PLAIN.encode())).decode(),
        base64.b64encode(zlib.compress(PLAIN.encode())).decode(), base64.b64encode(base64.b64encode(PLAIN.encode())).decode(), "".join(f"\\u{ord(c):04x}" for c in PLAIN), "".join(f"&#{ord(c)};" for c in PLAIN),
        urllib.parse.quote(base64.b64encode(zlib.compress(urllib.parse.quote(PLAIN).encode())).decode(), safe=""),
    ]
    for w in wraps:
        text = "é before " + w + " after"
        base, every, _ = S.all_spans(text)
        assert base == [] and every and all(k == 0 and 9 <= i < j <= 9 + len(w) for i, k, j in every), w


def test_percent_places_are_exact():
    text = "see pass%77ord%3Dabcdefgh%69j end"
    assert S.spelled(S.all_spans(text)[1]) == f"assign:4:{len(text) - 4}"


def test_cycles_bombs_and_edges():
    assert S.all_spans(None) == S.all_spans("") == ([], [], 0)
    bomb = base64.b64encode(gzip.compress(b"a" * 200_000)).decode()
    assert S.all_spans(bomb, max_unpacked=1000)[2] == 1
    assert S.all_spans("%41" * 20000)[1] == [] and S.all_spans("A" * 300_000)[0] == []


def test_layers_that_are_not_clean():
    packs = [gzip.compress(PLAIN.encode()), zlib.compress(PLAIN.encode()), bz2.compress(PLAIN.encode())]
    b64 = lambda d: base64.b64encode(d).decode()
    wraps = [urllib.parse.quote(p, safe="") for p in packs] + [urllib.parse.quote_plus(p, safe="") for p in packs] + ["".join(f"%{c:02x}" for c in p) for p in packs]
    wraps += ["".join(f"\\x{c:02x}" for c in p) for p in packs] + [repr(p) for p in packs] + ["".join(f"\\u{c:04x}" for c in p) for p in packs] + ["".join(f"&#{c};" for c in p) for p in packs]
    wraps += [b64(gzip.compress(b"nothing here") + gzip.compress(PLAIN.encode())), b64(bz2.compress(b"nothing here") + bz2.compress(PLAIN.encode()))]
    wraps += [p + b64(d) for p in ("/cb/", "key-", "a/", "ab_", "abc+") for d in (PLAIN.encode(), *packs)]
    wraps += [b64(b"\x00\x01 " + PLAIN.encode()), b64(PLAIN.encode() + b"\xff\xfe"), "\\ud800" + "".join(f"\\u{ord(c):04x}" for c in PLAIN)]
    for w in wraps:
        _, every, _ = S.all_spans("é before " + w + " after")
        assert every and all(9 <= i < j <= 9 + len(w) for i, k, j in every), w


def test_long_streams_are_searched_whole():
    filler = b"\n".join(b"line %d of a log" % i for i in range(60_000))
    inner = base64.b64encode(gzip.compress(PLAIN.encode())) + b"\n"
    for pack in (gzip.compress, zlib.compress, bz2.compress, lambda d: gzip.compress(bz2.compress(d))):
        for data in (PLAIN.encode() + b"\n" + filler, filler + b"\n" + PLAIN.encode(), filler + b"\n" + inner + filler):
            run = base64.b64encode(pack(data)).decode()
            _, every, long = S.all_spans("see " + run + " end", max_unpacked=200_000)
            assert (4, 0, 4 + len(run)) in every and long == 1
    text = base64.b64encode(gzip.compress(b"a log line\n" * 1_700_000 + PLAIN.encode())).decode()
    assert (0, 0, len(text)) in S.all_spans(text)[1]
    deep = PLAIN.encode()
    for _ in range(70):
        deep = zlib.compress(deep)
    assert S.all_spans(base64.b64encode(deep).decode())[1]


def test_wrapped_lines_and_bare_deflate():
    def bare(d):
        work = zlib.compressobj(9, zlib.DEFLATED, -15)
        return work.compress(d) + work.flush()

    filler = b" and more words of this kind to fill some lines, so that there are several of them, none of which is secret"
    lines = lambda d, sep: sep.join(re.findall(".{1,64}", base64.b64encode(d).decode()))
    packs = [lambda d: d, gzip.compress, zlib.compress, bare]
    wraps = [lines(p(filler + PLAIN.encode() + filler), sep) for p in packs for sep in ("\n", "\r\n", "\n    ", "\\n")]
    wraps += [base64.b64encode(bare(PLAIN.encode() * 3)).decode(), urllib.parse.quote(base64.b64encode(bare(filler + PLAIN.encode())).decode(), safe="")]
    for w in wraps:
        _, every, _ = S.all_spans("é before " + w + " after")
        assert every and all(9 <= i < j <= 9 + len(w) for i, k, j in every), w
    log = base64.b64encode(bare(b"a log line\n" * 40_000 + PLAIN.encode())).decode()
    assert (2, 0, 2 + len(log)) in S.all_spans("x " + log, max_unpacked=100_000)[1]


def test_packed_layers_take_no_memory_a_character():
    import tracemalloc

    run = base64.b64encode(gzip.compress(b"a log line of some length\n" * 500_000 + PLAIN.encode())).decode()
    tracemalloc.start()
    assert (0, 0, len(run)) in S.all_spans(run)[1]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 160e6  # 13 MB unpacked: some copies, but no table of places (16 bytes a character)


def test_frames(spark):
    rows = [(1, f"x {PLAIN} y", "c"), (None, None, "c"), (2, "", "c"), (1, f"x {PLAIN} y", "c"), (3, base64.b64encode(PLAIN.encode()).decode(), "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = S.scan(df).collect()
    assert len(got) == 5 and sum(len(r["spans"]) for r in got) == 3 and sum(len(r["base_spans"]) for r in got) == 2
    clean = sorted(r["text"] or "" for r in S.redact(df).collect())
    assert all("hunter2" not in t for t in clean) and S.redact(df).columns == df.columns
    assert all(not S.all_spans(t)[1] for t in clean)
    assert S.scan(df.limit(0)).count() == 0
