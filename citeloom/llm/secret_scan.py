"""Secret scans with a recursive decoding worklist.

Three kinds are searched in the text and in every layer under it:
assign (a keyword, = or :, and a value of 8 or more characters), access (AKIA and capitals or digits, 16 or more in all) and
hex (32 or more lower-case hex digits). In each kind matches are leftmost and do not overlap; those that are too short are
dropped after matching.

The worklist starts with the text. From each layer it unwraps percent escapes, \\uXXXX / \\xXX / &#...; escapes, base64
runs (standard or URL alphabet, also broken over lines, from each of the four places where a group may begin) and the gzip,
zlib, bzip2 (all members) or bare deflate streams that base64 or escapes give, and adds what is new. Bytes that are no UTF-8 count as a character each. A layer that
was seen before for this text (by digest of its characters and their places) is not visited again, so chains end even where a stream
unpacks to itself. Every character of a layer keeps the range of the original text that it comes from: escapes map to
their own characters, base64 to its groups, compressed data to its whole run. Found spans are given in the original text;
base spans stay, equal spans count once.

A stream that unpacks to more than max_unpacked bytes is unpacked and searched in pieces, which end at characters that no
pattern and no escape holds; it gives a span over its whole run for each kind it holds, and counts in n_oversize.
A null or empty text has no spans. Rows pass one to one, repeated ids included; columns pass through unless they have an
output's name. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ._common import arrow_map, table

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # runs are maximal, so shorter ones need no matching
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)+")
_ONE_ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});")
_BREAK = re.compile(rb"[^A-Za-z0-9+/_.=\x20\"':%\\&#;-]+")
_PIECE = 1 << 20
_STRETCH = re.compile(rb"[\x20-\x7e]{14}")  # the shortest match and every escape of it are printable
_MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|x[\x01\x5e\x9c\xda]")
#: Where escapes may write the first bytes of a stream.
_HINT = re.compile(r"(?:%|\\x|\\u00|&#x)1f;?(?:(?:%|\\x|\\u00|&#x)8b|\x8b)|&#31;(?:&#139;|\x8b)|(?:B|(?:%|\\x|\\u00|&#x)42;?|&#66;)(?:Z|(?:%|\\x|\\u00|&#x)5a;?|&#90;)(?:h|(?:%|\\x|\\u00|&#x)68|&#104;)|(?:x|(?:%|\\x|\\u00|&#x)78;?|&#120;)(?:(?:%|\\x|\\u00|&#x)(?:0?1|5e|9c|da)|&#(?:1|94|156|218);|[\^\x9c\xda])", re.IGNORECASE)
_PERCENT_BYTE = re.compile(r"%(?P<hex>[0-9A-Fa-f]{2})|(?P<dec>(?!))|(?P<short>(?!))|[!-~]")
_ESCAPE_BYTE = re.compile(r"(?:\\x|\\u00|\\U000000|&#[xX](?=[0-9A-Fa-f]{1,2};))(?P<hex>[0-9A-Fa-f]{1,2});?|&#(?P<dec>[0-9]{1,3});|\\(?P<short>[abfnrtv0'\"\\/])|[ -~\x80-\xff]")
_VISIBLE, _LINE = re.compile(r"[!-~]+"), re.compile(r"[ -~\x80-\xff]+")
_SHORT = {"a": 7, "b": 8, "f": 12, "n": 10, "r": 13, "t": 9, "v": 11, "0": 0}
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: The same over several lines: all but the last are of 16 characters or more; the breaks may be written as \n.
_WRAPPED = re.compile(r"(?:[A-Za-z0-9+/_-]{16,}(?:\r?\n|(?:\\r)?\\n)[\x20\t]*)+[A-Za-z0-9+/_-]+={0,2}")
_WRAP = re.compile(r"(?:\r?\n|(?:\\r)?\\n)[\x20\t]*")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the plain patterns, in that order."""
    found = []
    low = text if text.islower() else text.lower()
    if any(k in low for k in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


class Layer:
    """A text whose character i comes from [start[i], stop[i]) of the original; None: it is the original; numbers: all of it comes from [start, stop)."""

    def __init__(self, text: str, start: np.ndarray | int | None = None, stop: np.ndarray | int | None = None):
        self.text, self.start, self.stop = text, start, stop

    def place(self, i: int, j: int) -> tuple[int, int]:
        """Where [i, j) comes from."""
        if self.start is None:
            return i, j
        if isinstance(self.start, int):
            return self.start, self.stop
        return int(self.start[i:j].min()), int(self.stop[i:j].max())

    def places(self, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        if self.start is None:
            at = np.arange(i, j)
            return at, at + 1
        if isinstance(self.start, int):
            return np.full(j - i, self.start), np.full(j - i, self.stop)
        return self.start[i:j], self.stop[i:j]

    def digest(self) -> bytes:
        h = hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16)
        if isinstance(self.start, int):
            h.update(b"%d:%d" % (self.start, self.stop))
        elif self.start is not None:
            h.update(self.start.tobytes())
            h.update(self.stop.tobytes())
        return h.digest()


def _characters(data: bytes) -> tuple[str, list[int]] | None:
    """The text of bytes, as UTF-8 or else a character a byte, and the number of bytes of each; None if nothing in it is long enough to match."""
    if not _STRETCH.search(data):
        return None
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        text = data.decode("latin-1")
        return text, [1] * len(text)
    return text, [1] * len(text) if text.isascii() else [len(c.encode("utf-8")) for c in text]


def _replaced(layer: Layer, pattern: re.Pattern, unwrap) -> Layer | None:
    """The whole layer with each run of escapes unwrapped. unwrap gives (text, [(from, to) in the run]) or None to leave it."""
    if isinstance(layer.start, int):
        new = pattern.sub(lambda m: m[0] if (got := unwrap(m[0])) is None else got[0], layer.text)
        return Layer(new, layer.start, layer.stop) if new != layer.text else None
    parts, starts, stops, at, changed = [], [], [], 0, False
    for m in pattern.finditer(layer.text):
        got = unwrap(m[0])
        if got is None:
            continue
        changed = True
        a, b = layer.places(at, m.start())
        parts.append(layer.text[at : m.start()])
        starts.append(a)
        stops.append(b)
        a, b = layer.places(m.start(), m.end())
        parts.append(got[0])
        starts.append(np.array([a[i] for i, _ in got[1]], dtype=np.int64))
        stops.append(np.array([b[j - 1] for _, j in got[1]], dtype=np.int64))
        at = m.end()
    if not changed:
        return None
    a, b = layer.places(at, len(layer.text))
    return Layer("".join([*parts, layer.text[at:]]), np.concatenate([*starts, a]), np.concatenate([*stops, b]))


def _percent(run: str):
    data = bytes(int(run[i + 1 : i + 3], 16) for i in range(0, len(run), 3))
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        text = data.decode("latin-1")
    out, at = [], 0
    wide = len(text) != len(data)
    for c in text:
        n = len(c.encode("utf-8")) if wide else 1
        out.append((3 * at, 3 * (at + n)))
        at += n
    return text, out


def _escapes(run: str):
    units = []
    for m in _ONE_ESCAPE.finditer(run):
        code = int(m[4]) if m[4] else int(next(x for x in m.groups() if x), 16)
        if units and 0xDC00 <= code < 0xE000 and 0xD800 <= units[-1][0] < 0xDC00:
            units[-1] = (0x10000 + ((units[-1][0] - 0xD800) << 10) + code - 0xDC00, units[-1][1], m.end())
        else:
            units.append((code, m.start(), m.end()))
    known = lambda c: c <= 0x10FFFF and not 0xD800 <= c < 0xE000
    return "".join(chr(c) if known(c) else "\ufffd" for c, _, _ in units), [(i, j) for _, i, j in units]


def _packed(head: bytes) -> bool:
    """Whether bytes begin as a gzip, zlib or bzip2 stream."""
    return head[:2] == b"\x1f\x8b" or head[:3] == b"BZh" or (len(head) > 2 and head[0] & 0x0F == 8 and (head[0] << 8 | head[1]) % 31 == 0)


def _inflate(chunks: Iterator[bytes], left: list | None = None) -> Iterator[bytes]:
    """What all members of a stream unpack to, in pieces of _PIECE bytes at most; ends where the stream breaks off. left takes the number of bytes after it."""
    work = None
    for data in chunks:
        while data:
            if work is None:
                if not _packed(data):
                    if left is not None:
                        left.append(len(data))
                    return
                work = bz2.BZ2Decompressor() if data[:3] == b"BZh" else zlib.decompressobj(47)
            try:
                out = work.decompress(data, _PIECE)
                if out:
                    yield out
                if not work.eof and isinstance(work, bz2.BZ2Decompressor):
                    while not work.eof and not work.needs_input:
                        if out := work.decompress(b"", _PIECE):
                            yield out
            except (zlib.error, OSError, ValueError, EOFError):
                return
            if work.eof:
                data, work = work.unused_data.lstrip(b"\0"), None
            else:
                data = b"" if isinstance(work, bz2.BZ2Decompressor) else work.unconsumed_tail


def _stream_kinds(chunks: Iterator[bytes], most: int) -> set[int]:
    """The kinds in a long stream and all layers under it, in pieces that end where no pattern can go on."""
    head = next(chunks, b"")
    while len(head) < 3 and (more := next(chunks, b"")):
        head += more
    found = set()
    if _packed(head):
        whole = itertools.chain([head], chunks)
        inner = _inflate(whole)
        first = next(inner, None)
        if first is not None:
            return _stream_kinds(itertools.chain([first], inner), most)
    tail = b""
    for data in itertools.chain([head], chunks):
        ends = [m.end() for m in _BREAK.finditer(data)][-1:]  # nothing that is searched for holds one
        if not ends:
            tail += data
            continue
        found |= {k for _, k, _ in all_spans((tail + data[: ends[0]]).decode("latin-1"), most)[1]}
        tail = data[ends[0] :]
    return found | {k for _, k, _ in all_spans(tail.decode("latin-1"), most)[1]}


def _streams(data: bytes, most: int) -> tuple[list[bytes], set[int], int, int]:
    """What a stream, and the streams it unpacks to, hold: the layers up to most bytes; of longer ones the kinds found, and their number; the bytes after the outermost."""
    out, kinds, long, seen, left = [], set(), 0, set(), []
    while _packed(data) and (key := hashlib.blake2b(data, digest_size=16).digest()) not in seen:
        seen.add(key)
        chunks, parts, size = _inflate(iter([data]), None if out else left), [], 0
        for part in chunks:
            parts.append(part)
            size += len(part)
            if size > most:
                kinds, long = _stream_kinds(itertools.chain(parts, chunks), most), 1
                return out, kinds, long, sum(left)
        if not parts:
            break
        data = b"".join(parts)
        out.append(data)
    return out, kinds, long, sum(left)


def _byte_layers(data: bytes, starts: np.ndarray, stops: np.ndarray, last: int, most: int, oversize: list, every: set, done: set, head: bool = True) -> list[Layer]:
    """The text of bytes that come from [starts[i], stops[i]), and of the streams that begin in them and end by last."""
    out, at = [], {0} if head and _packed(data) else set()
    for i in sorted(at | {m.start() for m in _MAGIC.finditer(data) if head or m.start()}):
        key = hashlib.blake2b(memoryview(data)[i:], digest_size=16).digest(), int(starts[i]), last
        if key in done:
            continue
        done.add(key)
        inner, kinds, long, left = _streams(data[i:] if i else data, most)
        if not inner and not long:
            continue
        first, end = int(starts[i:].min()), int(stops[i : len(data) - left].max()) if left else last
        every |= {(first, k, end) for k in kinds}
        oversize += [(first, end)] * long
        for got in map(_characters, inner):
            if got is not None:
                out.append(Layer(got[0], first, end))
        for x in inner:  # a stream further on in what a stream holds
            if any(m.start() for m in _MAGIC.finditer(x)):
                out += _byte_layers(x, np.full(len(x), first), np.full(len(x), end), end, most, oversize, every, done, head=False)
    if head and not out and len(data) > 8 and not data.isascii():
        text, kinds, long = _bare(data, most)
        first = int(starts.min())
        if text is not None:
            out.append(Layer(text, first, last))
        every |= {(first, k, last) for k in kinds}
        oversize += [(first, last)] * long
    got = _characters(data)
    if got is not None:
        ends = np.cumsum(got[1])
        out.append(Layer(got[0], starts[ends - got[1]], stops[ends - 1]))
    return out


def _bare(data: bytes, most: int) -> tuple[str | None, set[int], int]:
    """The text of a deflate stream without a header, if data is a whole one that holds text; beyond most bytes the kinds found in it, and 1."""
    work = zlib.decompressobj(-15)

    def pieces() -> Iterator[bytes]:
        rest = data
        while rest and not work.eof:
            try:
                out = work.decompress(rest, _PIECE)
            except zlib.error:
                return
            if not out:
                return
            yield out
            rest = work.unconsumed_tail

    parts, size, chunks = [], 0, pieces()
    for part in chunks:
        parts.append(part)
        size += len(part)
        if size > most:
            return None, _stream_kinds(itertools.chain(parts, chunks), most), 1
    if not work.eof or len(work.unused_data) > 4:
        return None, set(), 0
    got = _characters(b"".join(parts))
    return (None if got is None else got[0]), set(), 0


def _base64_layers(layer: Layer, most: int, oversize: list, every: set, done: set) -> list[Layer]:
    """What the base64 runs hold, in one line or several, read from each of the four places where a group of characters may begin."""
    out = []
    for m in _BASE64.finditer(layer.text):
        a, b = layer.places(m.start(), m.end())
        out += _decoded(m[0], a, b, most, oversize, every, done)
    for m in _WRAPPED.finditer(layer.text) if "\n" in layer.text or "\\n" in layer.text else ():
        keep = np.ones(len(m[0]), bool)
        for x in _WRAP.finditer(m[0]):
            keep[x.start() : x.end()] = False
        a, b = layer.places(m.start(), m.end())
        out += _decoded(_WRAP.sub("", m[0]), a[keep], b[keep], most, oversize, every, done)
    return out


def _decoded(run: str, a: np.ndarray, b: np.ndarray, most: int, oversize: list, every: set, done: set) -> list[Layer]:
    out = []
    run = run.rstrip("=").translate({45: 43, 95: 47})
    for skip in range(4):
        body = run[skip:]
        body = body[: len(body) // 4 * 4] if len(body) % 4 == 1 else body
        data = base64.b64decode(body + "=" * (-len(body) % 4))
        if data.isascii() and not (_packed(data) or _MAGIC.search(data) or _STRETCH.search(data)):
            continue
        at, top = np.arange(len(data)), skip + len(body) - 1
        out += _byte_layers(data, a[np.minimum(skip + at * 4 // 3, top)], b[np.minimum(skip + (at * 4 + 6) // 3 - 1, top)], int(b.max()), most, oversize, every, done)
    return out


def _escaped_streams(layer: Layer, stretches: re.Pattern, byte: re.Pattern, escape: re.Pattern, most: int, oversize: list, every: set, done: set) -> list[Layer]:
    """What the compressed streams hold whose bytes are written as escapes among plain characters."""
    out = []
    for m in stretches.finditer(layer.text) if _HINT.search(layer.text) else ():
        if not (_HINT.search(m[0]) and escape.search(m[0])):
            continue
        units = list(byte.finditer(m[0]))
        whole = bytes(_unit(u) for u in units)
        for data in {whole, bytes(32 if u[0] == "+" else c for u, c in zip(units, whole, strict=True))}:
            if not (_packed(data) or _MAGIC.search(data)):
                continue
            a, b = layer.places(m.start(), m.end())
            starts, stops = a[[u.start() for u in units]], b[[u.end() - 1 for u in units]]
            out += _byte_layers(data, starts, stops, int(b.max()), most, oversize, every, done)
    return out


def _unit(u: re.Match) -> int:
    """The byte that an escape or a plain character stands for."""
    if u["hex"]:
        return int(u["hex"], 16)
    if u["dec"]:
        return int(u["dec"]) & 255
    return _SHORT.get(u["short"], ord(u["short"])) if u["short"] else ord(u[0])


def all_spans(text: str | None, max_unpacked: int = 1 << 24) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int]:
    """Base spans, all spans, and the number of oversize streams."""
    if not text:
        return [], [], 0
    base = base_spans(text)
    every = set(base)
    work, seen, done, oversize = [Layer(text)], set(), set(), []
    while work:
        layer = work.pop()
        if layer.start is not None:
            key = layer.digest()
            if key in seen:
                continue
            seen.add(key)
            for i, kind, j in base_spans(layer.text):
                first, last = layer.place(i, j)
                every.add((first, kind, last))
        if "%" in layer.text and (new := _replaced(layer, _PERCENT, _percent)):
            work.append(new)
        if "%" in layer.text:
            work += _escaped_streams(layer, _VISIBLE, _PERCENT_BYTE, _PERCENT, max_unpacked, oversize, every, done)
        if ("\\" in layer.text or "&#" in layer.text) and (new := _replaced(layer, _ESCAPE, _escapes)):
            work.append(new)
        if "\\" in layer.text or "&#" in layer.text:
            work += _escaped_streams(layer, _LINE, _ESCAPE_BYTE, _ESCAPE, max_unpacked, oversize, every, done)
        work += _base64_layers(layer, max_unpacked, oversize, every, done)
    return base, sorted(every), len(set(oversize))


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{i}:{j}" for i, k, j in spans)


_SPAN = "array<struct<kind:string,start:long,stop:long>>"


def scan(docs: DataFrame, text_col: str = "text", max_unpacked: int = 1 << 24, keep: list[str] | None = None) -> DataFrame:
    """docs with base_spans and spans (kind, start, stop in code points, end exclusive) and n_oversize."""

    def make():
        as_rows = lambda spans: [{"kind": KINDS[k], "start": i, "stop": j} for i, k, j in spans]

        def work(texts):
            found = [all_spans(t, max_unpacked) for t in texts]
            return [as_rows(x[0]) for x in found], [as_rows(x[1]) for x in found], [x[2] for x in found]

        return work

    return arrow_map(docs, [text_col], f"base_spans {_SPAN}, spans {_SPAN}, n_oversize long", make, keep)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]", keep: list[str] | None = None) -> DataFrame:
    """docs with every found span of the text replaced by mark; overlapping spans become one."""

    def clean(text):
        spans = all_spans(text)[1]
        if not spans:
            return text
        out, at = [], 0
        for i, _, j in spans:
            if i >= at:
                out += [text[at:i], mark]
            at = max(at, j)
        return "".join([*out, text[at:]])

    out = arrow_map(docs, [text_col], f"`{text_col}` string", lambda: lambda texts: [[clean(t) for t in texts]], keep)
    return out.select(*[f"`{c}`" for c in docs.columns if c in out.columns])


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")

    def make():
        def work(texts):
            rows = []
            for t in texts:
                base, every, _ = all_spans(t)
                n = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                rows.append((*n, hashlib.sha256(spelled(base).encode()).hexdigest(), spelled(every)))
            return list(zip(*rows, strict=True))

        return work

    return arrow_map(docs, ["text"], "n_assign long, n_access long, n_hex long, base_sha256 string, spans string", make, ["doc_id"])
