"""A word-level BPE vocabulary file (JSON of the tokenizers library): its normalisation, its split and its merges.

Each piece of text becomes a string with one character per symbol: bytes stand as the file's visible characters and the
last symbol of a word is moved to a private range, so that tokens and pieces are ordinary strings.

Texts beyond ASCII go through the library's own normalisers and splitter where they are not composed, or hold a character
that the library's tables treat unlike Python's (each character that is met is put to both once).
"""

from __future__ import annotations

import json
import re
import unicodedata

import regex

from ._common import held

#: Symbols that end a word are moved up by this much.
END = 0xE000


def visible_bytes() -> list[str]:
    """The character that stands for each byte: itself if printable Latin-1, else the next free one from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


def _splitter(pattern: str):
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(pattern), "removed", invert=True)


def shared(spark, path: str | None):
    """A broadcast of the file's text."""
    with open(path or default_path(), encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())  # one file of fixed size


class Vocabulary:
    """Parsed from the file's text, which the driver reads once and broadcasts."""

    def __init__(self, text: str):
        from tokenizers import Regex, normalizers

        spec = json.loads(text)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or model["end_of_word_suffix"] != "</w>" or split["behavior"] != "Removed":
            raise ValueError("this reads vocabularies of lower-case words with a word-end mark")
        pattern = split["pattern"]["Regex"]
        self.split, self.other_split = regex.compile(pattern), _splitter(pattern)
        self.ascii_split = re.compile(pattern.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9"))
        self.alike: set[str] = set()  # characters met that both treat alike, and the others
        self.odd: set[str] = set()
        blank = spec["normalizer"]["normalizers"][1]
        self.normal = normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex(blank["pattern"]["Regex"]), blank["content"]), normalizers.Lowercase()])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.visible = visible_bytes()
        self.names = {i: self._inner(t) for t, i in model["vocab"].items()}
        self.shown = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.ranks = {(self._inner(a, whole=False), self._inner(b)): r for r, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"])}

    @staticmethod
    def _inner(token: str, whole: bool = True) -> str:
        if whole and token.endswith("</w>") and len(token) > 4:
            return token[:-5] + chr(END + ord(token[-5]))
        return token

    def segments(self, text: str) -> list[tuple[str, bool]]:
        """The text cut at special tokens: (part, is special)."""
        if self.cut is None or not any(s in text for s in self.special):
            return [(text, False)]
        return [(part, part in self.special) for part in self.cut.split(text) if part]

    def pieces(self, text: str) -> list[str]:
        """The words, digits and signs of a text without special tokens."""
        if text.isascii():
            return self.ascii_split.findall(text.lower())
        met = set(text) - self.alike
        if (not met or all([self._is_alike(c) for c in met])) and unicodedata.is_normalized("NFC", text):
            return self.split.findall(text.replace("Σ", "σ").lower())  # the library lowers letter by letter, so a final sigma stays plain
        return [piece for piece, _ in self.other_split.pre_tokenize_str(self.normal.normalize_str(text))]

    def _is_alike(self, c: str) -> bool:
        if c not in self.odd:
            low = f"A{c}b".replace("Σ", "σ").lower()
            probe = f"a{low[1:-1]}{low[1:-1]}a"  # a letter makes one piece of it, a digit four, a sign three, a blank two
            own = unicodedata.category(c) != "Cn" and (c.isspace() or self.normal.normalize_str(f"A{c}b") == unicodedata.normalize("NFC", low))
            own = own and [m.span() for m in self.split.finditer(probe)] == [at for _, at in self.other_split.pre_tokenize_str(probe)]
            (self.alike if own else self.odd).add(c)
        return c in self.alike

    def symbols(self, piece: str) -> str:
        if piece.isascii() and "\x20" < min(piece) and max(piece) < "\x7f":
            s = piece
        else:
            s = "".join([self.visible[b] for b in piece.encode("utf-8", "surrogatepass")])
        return s[:-1] + chr(END + ord(s[-1]))


def loaded(text: str) -> Vocabulary:
    """One per worker process, for as long as its tasks are those of one operator."""
    return held(("vocabulary", hash(text)), lambda: Vocabulary(text))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Memo(dict):
    """key -> value; computed when missing and kept while the key is short.

    At most entries the older generation goes and this one takes its place; what is asked for again comes back, so that
    frequent keys stay and memory stays bounded by twice most entries.
    """

    def __init__(self, compute, most: int = 60_000, longest: int = 64):
        super().__init__()
        self.compute, self.most, self.longest = compute, most, longest
        self.old: dict = {}

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.compute(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value
