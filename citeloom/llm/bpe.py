"""BPE encoding by per-prefix dynamic programming, and decoding.

For every prefix of a piece the last token of its encoding is unique. A suffix automaton over the vocabulary (goto and
suffix links) lists the tokens that end at each position; the one that is compatible with the last token of the prefix
before it is stored, and back-pointers from the end of the piece give the exact ids. Two tokens are compatible if merging
their joint symbols gives just these two tokens; tests are remembered.

Rows: every row of the input gives one row, repeated ids included. A null text counts as empty: no ids, and the hashes are
those of the empty string. An empty table gives an empty result. Other columns pass through in encode(); those with an
output's name give way to it. Special tokens inside a text are encoded as such, as the library does by default.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._common import arrow_map, held, table
from .vocabulary import Memo, Vocabulary, loaded, shared


class Encoder:
    """Encodes pieces and whole texts."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.names = vocabulary.names
        self.matches = ahocorasick.Automaton()
        for i, token in self.names.items():
            self.matches.add_word(token, (len(token), i))
        self.matches.make_automaton()
        #: What each token was merged from, and the rank of that merge; a lone symbol has none.
        self.made = {a + b: (a, b, r) for (a, b), r in sorted(vocabulary.ranks.items(), key=lambda x: -x[1])}
        rank = lambda t: self.made[t][2] if t in self.made else -1
        if any(r <= max(rank(a), rank(b)) for a, b, r in self.made.values()):
            raise ValueError("a merge stands before those that make its parts")
        self.alone: dict[int, bool] = {}  # by token: its symbols merge into itself
        self.pairs: dict[int, bool] = {}  # by last << 32 | token
        self.memo = Memo(self.encode_piece)

    def stands(self, token: int) -> bool:
        """Do the symbols of this token merge into itself?"""
        known = self.alone.get(token)
        if known is None:
            known = self.alone[token] = merged(list(self.names[token]), self.v.ranks) == [self.names[token]]
        return known

    def fits(self, last: int, token: int) -> bool:
        """Do the symbols of both, side by side, merge into just these two tokens? Each stands by itself.

        Only a merge across the border could upset them: of what ends the first at some time and what starts the second
        then, if its rank comes before the merges that take these two in (of equal ranks the leftmost goes first). Walked
        back in time, from the whole tokens to the two symbols at the border.
        """
        key = last << 32 | token
        known = self.pairs.get(key)
        if known is not None:
            return known
        x, y, made, ranks = self.names[last], self.names[token], self.made, self.v.ranks
        taken_x = taken_y = 1 << 62
        left, right = made.get(x), made.get(y)
        good = True
        while True:
            r = ranks.get((x, y))
            if r is not None and r < taken_x and r <= taken_y:
                good = False
                break
            if left is None and right is None:
                break
            if right is None or (left is not None and left[2] > right[2]):
                x, taken_x = left[1], left[2]
                left = made.get(x)
            else:
                y, taken_y = right[0], right[2]
                right = made.get(y)
        if len(self.pairs) > 100_000:
            self.pairs.clear()
        self.pairs[key] = good
        return good

    def encode_piece(self, piece: str) -> list[int]:
        symbols = self.v.symbols(piece)
        size = len(symbols)
        last = [-1] * (size + 1)  # the last token of each prefix
        back = [0] * (size + 1)  # where that token starts
        stands, fits, alone, pairs = self.stands, self.fits, self.alone, self.pairs
        for end, (length, token) in self.matches.iter(symbols):  # in order of their ends, longest first
            end += 1
            if last[end] >= 0:
                continue
            start = end - length
            if start:
                before = last[start]
                if before < 0:
                    continue
                good = pairs.get(before << 32 | token)
                if not (fits(before, token) if good is None else good):
                    continue
            good = alone.get(token)
            if stands(token) if good is None else good:
                last[end], back[end] = token, start
        ids, at = [], size
        while at > 0:
            ids.append(last[at])
            at = back[at]
        return ids[::-1]

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        for part, special in self.v.segments(text or ""):
            if special:
                ids.append(self.v.special[part])
            else:
                for piece in self.v.pieces(part):
                    ids += self.memo[piece]
        return ids

    def decode(self, ids: list[int] | None) -> str:
        """The file names no decoder: tokens as they stand in the file, joined by spaces."""
        return " ".join([self.v.shown[i] for i in ids or [] if i in self.v.shown])


def merged(parts: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """The symbols after all merges, one by one."""
    while len(parts) > 1:
        best = min(((r, i) for i in range(len(parts) - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None), default=None)
        if best is None:
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return parts


class Digester:
    """Encodes a text and gives ids and decoded text as strings, put together from those of its distinct pieces."""

    def __init__(self, encoder: Encoder, remembered: int = 120_000):
        self.encoder = encoder
        self.pieces = Memo(self._piece, most=remembered)

    def _piece(self, piece: str) -> tuple[str, str]:
        ids = self.encoder.encode_piece(piece)
        return " ".join(map(str, ids)), self.encoder.decode(ids)

    def __call__(self, text: str | None) -> tuple[int, str, str]:
        found: list[tuple[str, str]] = []
        for part, special in self.encoder.v.segments(text or ""):
            if special:
                i = self.encoder.v.special[part]
                found.append((str(i), self.encoder.decode([i])))
            else:
                found += map(self.pieces.__getitem__, self.encoder.v.pieces(part))
        ids = " ".join([x[0] for x in found])
        return ids.count(" ") + 1 if found else 0, ids, " ".join([x[1] for x in found])


def digester(spec: str, remembered: int = 120_000) -> Digester:
    """One per worker process, for as long as its tasks are those of this operator. remembered: pieces of a generation of its memo, some 300 bytes each."""
    return held(("digester", hash(spec), remembered), lambda: Digester(encoder(spec), remembered))


def encoder(spec: str) -> Encoder:
    """One per worker process, for as long as its tasks are those of this operator."""
    return held(("encoder", hash(spec)), lambda: Encoder(loaded(spec)))


def encode(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """docs with token_ids (array of int) and n_tokens."""
    spec = shared(docs.sparkSession, vocabulary)

    def make():
        e = encoder(spec.value)

        def work(texts):
            ids = [np.array(e.encode(t), np.int32) for t in texts]
            return id_lists(ids), [len(x) for x in ids]

        return work

    return arrow_map(docs, [text_col], "token_ids array<int>, n_tokens long", make, keep)


def id_lists(ids: list[np.ndarray]) -> pa.Array:
    """One Arrow list a text; no Python number an id."""
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32()))


def encode_with_digests(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None, keep: list[str] | None = None, remembered: int = 120_000) -> DataFrame:
    """docs with token_ids, n_tokens, ids_sha256 and decoded_sha256, in one pass."""
    spec = shared(docs.sparkSession, vocabulary)

    def make():
        digest = digester(spec.value, remembered)

        def work(texts):
            ids, rows = [], []
            for n, joined, words in map(digest, texts):
                ids.append(np.array(joined.split(" "), np.int32) if n else np.empty(0, np.int32))
                rows.append((n, _sha(joined), _sha(words)))
            return id_lists(ids), *zip(*rows, strict=True)

        return work

    return arrow_map(docs, [text_col], "token_ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string", make, keep)


def _sha(s: str) -> str:
    return hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()


def decode(frame: DataFrame, ids_col: str = "token_ids", vocabulary: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """frame with decoded, the text of its ids. Ids that the vocabulary lacks are left out, as the library does; null ids give an empty text."""
    spec = shared(frame.sparkSession, vocabulary)

    def make():
        e = encoder(spec.value)
        return lambda ids: [[e.decode(x) for x in ids]]

    return arrow_map(frame, [ids_col], "decoded string", make, keep)


def encode_digests(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """docs with n_tokens, ids_sha256 (of decimal ids joined by a space) and decoded_sha256 (of the decoded text)."""
    spec = shared(docs.sparkSession, vocabulary)

    def make():
        digest = digester(spec.value)

        def work(texts):
            rows = [(n, _sha(ids), _sha(words)) for n, ids, words in map(digest, texts)]
            return [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]

        return work

    return arrow_map(docs, [text_col], "n_tokens long, ids_sha256 string, decoded_sha256 string", make, keep)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), keep=["doc_id"])
