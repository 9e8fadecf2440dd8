"""Token counts without identifiers: byte-pair merging with a heap over a linked list of symbols.

A word starts as one symbol a byte, the last one marked as the word's end. The heap holds adjacent pairs by (rank,
position); popping the lowest merges it and pushes the two pairs that arise. Stale entries are recognised when popped.
The count is the number of initial symbols minus the number of merges. Cost is O(n log n) in the length of a word, so
one unbroken word of megabytes is no special case. Counts of short words are kept in a bounded table per worker.

Defined cases: null and empty text count 0 tokens; text of white space only counts 0; the vocabulary's special strings
inside a text count 1 each, as the library does by default; equal rows give equal counts; other columns do not matter.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, tokenizer_path
from .wordsplit import Splitter

#: Words of at most this many characters are kept, and at most so many of them.
KEPT_LENGTH, KEPT_WORDS = 64, 1_200_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies (printable bytes stand for themselves)."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256, 512))
    own = set(shown)
    return [chr(b) if b in own else chr(next(hidden)) for b in range(256)]


class MergeCounter(dict):
    """word -> number of tokens; a missing word is merged and, if short, kept."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.end = model["end_of_word_suffix"]
        self.ranks = {tuple(pair): i for i, pair in enumerate(model["merges"])}
        self.symbols = byte_symbols()

    def __missing__(self, word: str) -> int:
        n = self.merged(word)
        if len(word) <= KEPT_LENGTH:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = n
        return n

    def merged(self, word: str) -> int:
        """Initial symbols minus merges."""
        parts = [self.symbols[b] for b in word.encode("utf-8")]
        if not parts:
            return 0
        parts[-1] += self.end
        ranks, n = self.ranks, len(parts)
        after, before, merges = list(range(1, n + 1)), list(range(-1, n - 1)), 0
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue  # one of the two has been merged since
            parts[i], parts[j], merges = a + b, None, merges + 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get((parts[i], parts[k]))) is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[k]))
            h = before[i]
            if h >= 0 and (r := ranks.get((parts[h], parts[i]))) is not None:
                heapq.heappush(heap, (r, h, parts[h], parts[i]))
        return n - merges


@lru_cache(maxsize=4)
def _tools(path: str) -> tuple[Splitter, MergeCounter]:
    return Splitter(path), MergeCounter(path)


def count_tokens(text: str | None, path: str) -> int:
    """Tokens of one whole text."""
    split, counts = _tools(path)
    return sum(1 if special else sum(map(counts.__getitem__, split.words(piece))) for special, piece in split.segments(text or ""))


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit of each row; a narrow step with no shuffle."""
    path = path or tokenizer_path()

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([count_tokens(t, path) for t in batch], dtype="int64")

    text = text_or_empty(docs, text_col)
    out = docs.select(docs[id_col].alias(id_col), F.octet_length(text).cast("long").alias("n_bytes"), tokens(text).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
