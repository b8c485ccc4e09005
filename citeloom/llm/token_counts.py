"""Token counts by heap-and-linked-list pair merging: symbols minus merges, without ids.

The symbols of a piece form a doubly linked list; a heap holds the ranks of adjacent pairs. The lowest pair (leftmost on
ties) is popped, merged and its two new neighbours are pushed; stale entries are skipped. No token id is looked up.

Rows: every row of the input gives one row, repeated ids included. A null or empty text has 0 bytes and 0 tokens. An empty
table gives an empty result. Other columns of the input pass through in token_counts(); those called n_bytes, n_tokens or
over_limit give way to the results.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession

from ._common import arrow_map, held, table
from .vocabulary import Memo, Vocabulary, loaded, shared


def count_merges(symbols: str, ranks: dict[tuple[str, str], int]) -> int:
    """How many merges the symbols undergo."""
    n = len(symbols)
    if n < 2:
        return 0
    text: list[str | None] = list(symbols)
    after = [*range(1, n), -1]
    before = [-1, *range(n - 1)]
    heap = [(r, i, text[i], text[i + 1]) for i in range(n - 1) if (r := ranks.get((text[i], text[i + 1]))) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if text[i] != left or j < 0 or text[j] != right:
            continue
        text[i], text[j] = left + right, None
        after[i] = k = after[j]
        merges += 1
        if k >= 0:
            before[k] = i
            if (r := ranks.get((text[i], text[k]))) is not None:
                heapq.heappush(heap, (r, i, text[i], text[k]))
        if (h := before[i]) >= 0 and (r := ranks.get((text[h], text[i]))) is not None:
            heapq.heappush(heap, (r, h, text[h], text[i]))
    return merges


class Counter:
    """Counts whole texts; distinct pieces are merged once per worker."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.memo = Memo(lambda p: len(s := vocabulary.symbols(p)) - count_merges(s, vocabulary.ranks), most=120_000)

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        get = self.memo.__getitem__
        return sum(1 if special else sum(map(get, self.v.pieces(part))) for part, special in self.v.segments(text))


def token_counts(docs: DataFrame, text_col: str = "text", limit: int = 2048, vocabulary: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit). vocabulary: path of the file, default word_bpe_49k.json."""
    spec = shared(docs.sparkSession, vocabulary)

    def make():
        count = held(("counter", hash(spec.value)), lambda: Counter(loaded(spec.value)))

        def work(texts):
            tokens = [count(t) for t in texts]
            return [len((t or "").encode("utf-8", "surrogatepass")) for t in texts], tokens, [n > limit for n in tokens]

        return work

    return arrow_map(docs, [text_col], "n_bytes long, n_tokens long, over_limit boolean", make, keep)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), keep=["doc_id"])
