"""Benchmark decontamination with a generalised suffix automaton over words.

Items are normalised (A-Z lower-cased, words as below) and equal items are merged. The automaton accepts every run of
consecutive words of any item; no run crosses items. A document's words are streamed through it once: the state and the
length of the longest match that ends at each word are tracked. A match of `window` words or more marks its last `window`
words; an item of fewer words is one window itself and is marked when its state is the present one or an ancestor.
Spans of marked words are cut out, and a document whose marked share exceeds a coverage limit is dropped.

Items are grouped into blocks of a bounded number of words; each block has an automaton of its own, built in the workers from
flat arrays (about 100 bytes a word), so memory is bounded however many items there are. Each block is one narrow pass over the
rows, which carry the spans marked so far; with several blocks each pass ends in a table of the shared folder, so that only one
automaton is held at a time. Nothing is shuffled. What is cut, and whether a document is dropped, is decided on the spans of all
blocks together, so neither the size of blocks nor the items' order matters.

Defined cases: null has no words, no hits and stays null; an item without words, or with a null id, is never found; repeated
items count each; empty tables give no hits; a text of any length is streamed whole; ids keep their type and value, repeated
and null ones too; other columns do not matter.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, fresh, materialise

#: Words of the contract, and its window.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Words of items in one automaton.
BLOCK_WORDS = 2_000_000
#: Documents of which more than this share is marked are dropped as a whole.
MAX_COVERAGE = 0.5

_WORD = re.compile(WORD)
_LOWER = {ord("A") + i: ord("a") + i for i in range(26)}
SPANS = "array<struct<start:long,end:long>>"


def lower_ascii(text: str) -> str:
    """A-Z lower-cased, nothing else; keeps every position."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(lower_ascii(text)) if text else []


class Automaton:
    """Suffix automaton of several word sequences. items: [(item ids, words)], words distinct and not empty.

    Words are numbered. A state has its length, its link and its first transition in flat arrays; the few states with more
    transitions have the others in a dictionary of their own. A first transition leads to state 0 where there is none."""

    def __init__(self, items: list[tuple[list[str], list[str]]], window: int = WINDOW):
        self.window = window
        self.number: dict[str, int] = {}
        self.link, self.len, self.word, self.to = array("i", [-1]), array("i", [0]), array("i", [-1]), array("i", [0])
        self.more: dict[int, dict[int, int]] = {}
        coded = [(ids, [self.number.setdefault(w, len(self.number)) for w in words]) for ids, words in items]
        for _, words in coded:
            last = 0
            for w in words:
                last = self._extend(last, w)
        order = sorted(range(len(self.len)), key=self.len.__getitem__)
        self.short: dict[int, tuple[int, list[str]]] = {}  # state of a whole short item -> (its length, ids)
        self.long: dict[int, list[list[str]]] = {}  # state of a window -> ids of each item that has it
        for ids, words in coded:
            v = n = 0
            for w in words:
                v, n = self.step(v, n, w)
                if n >= window:
                    at = self.long.setdefault(self.at_length(v, window), [])
                    if not at or at[-1] is not ids:
                        at.append(ids)
            if len(words) < window:
                self.short[v] = (len(words), ids)
        self.above = array("i", [-1]) * len(self.len)  # nearest state at or above that is a whole short item
        for v in order[1:]:
            self.above[v] = v if v in self.short else self.above[self.link[v]]

    def get(self, v: int, w: int) -> int:
        """Where word w leads from state v; 0 if nowhere."""
        if self.word[v] == w:
            return self.to[v]
        more = self.more.get(v)
        return more.get(w, 0) if more else 0

    def put(self, v: int, w: int, to: int) -> None:
        if self.word[v] in (-1, w):
            self.word[v], self.to[v] = w, to
        else:
            self.more.setdefault(v, {})[w] = to

    def _state(self, length: int, link: int) -> int:
        self.len.append(length)
        self.link.append(link)
        self.word.append(-1)
        self.to.append(0)
        return len(self.len) - 1

    def _extend(self, last: int, w: int) -> int:
        q = self.get(last, w)
        if q:
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, q, w)
        cur, p = self._state(self.len[last] + 1, 0), last
        while p != -1 and not self.get(p, w):
            self.put(p, w, cur)
            p = self.link[p]
        if p != -1:
            q = self.get(p, w)
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._clone(p, q, w)
        return cur

    def _clone(self, p: int, q: int, w: int) -> int:
        clone = self._state(self.len[p] + 1, self.link[q])
        self.word[clone], self.to[clone] = self.word[q], self.to[q]
        if q in self.more:
            self.more[clone] = dict(self.more[q])
        self.link[q] = clone
        while p != -1 and self.get(p, w) == q:
            self.put(p, w, clone)
            p = self.link[p]
        return clone

    def step(self, v: int, n: int, w: int) -> tuple[int, int]:
        """State and length of the longest match after one more word."""
        while (to := self.get(v, w)) == 0 and v:
            v = self.link[v]
            n = self.len[v]
        return (to, n + 1) if to else (0, 0)

    def at_length(self, v: int, n: int) -> int:
        """The state whose matches include the suffix of n words of v's."""
        while v and self.len[self.link[v]] >= n:
            v = self.link[v]
        return v

    def scan(self, words: list[str]) -> tuple[list[tuple[int, int]], set[str]]:
        """(marked spans of word positions, merged and sorted; ids of the items found)."""
        link, length, window, above, short = self.link, self.len, self.window, self.above, self.short
        word, goes, more, number = self.word, self.to, self.more, self.number.get
        marks, found, v, n = [], set(), 0, 0
        for i, name in enumerate(words):
            w = number(name)
            if w is None:
                v = n = 0
                continue
            while True:
                to = goes[v] if word[v] == w else more[v].get(w, 0) if v in more else 0
                if to or not v:
                    break
                v = link[v]
                n = length[v]
            if not to:
                continue
            v, n = to, n + 1
            if n >= window:
                marks.append((i + 1 - window, i + 1))
                u = v
                while length[link[u]] >= window:
                    u = link[u]
                for ids in self.long.get(u, ()):
                    found.update(ids)
            a = above[v]
            if a > 0 and short[a][0] > n:  # the whole item is longer than what has matched
                a = above[link[a]]
            while a > 0:
                size, ids = short[a]
                marks.append((i + 1 - size, i + 1))
                found.update(ids)
                a = above[link[a]]
        return merge_spans(marks), found


def merge_spans(marks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(marks):
        if out and s <= out[-1][1]:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


#: The automaton that a worker holds, by the key of its block.
_HELD: dict[str, Automaton] = {}


def automaton(key: str, shared: Broadcast, window: int) -> Automaton:
    """The automaton of a block of items; a worker holds one at a time, and not the items."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Automaton([(list(ids), words.split(" ")) for words, ids in shared.value], window)
        shared.__dict__.pop("_value", None)  # the items as such are not needed any more
    return _HELD[key]


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> Iterator[tuple]:
    """Blocks of ((words joined, (ids...)), ...), read from Spark as a stream; only one block is held at a time."""

    @F.pandas_udf("string")
    def normal(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: " ".join(words_of(t)))

    items = benchmark.select(benchmark[id_col].cast("string").alias("item"), F.coalesce(benchmark[text_col], F.lit("")).alias("text")).select("item", normal("text").alias("words"))
    items = items.where("words <> '' AND item IS NOT NULL").groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("ids"))
    block, n = [], 0
    for row in items.toLocalIterator():
        block.append((row["words"], tuple(row["ids"])))
        n += row["words"].count(" ") + 1
        if n >= block_words:
            yield tuple(block)
            block, n = [], 0
    if block:
        yield tuple(block)


def mark(docs: DataFrame, blocks: Iterator[tuple], window: int, text_col: str, words_col: str, spans_col: str, items_col: str) -> DataFrame:
    """docs with the number of words, the marked spans of word positions (merged, sorted) and the ids of the items found, over all blocks."""
    spark, row, carried = docs.sparkSession, fresh(docs, "__row"), False
    source = [F.col(text_col).alias("text")]

    def pass_over(df: DataFrame, block: tuple) -> DataFrame:
        key, shared = uuid.uuid4().hex, spark.sparkContext.broadcast(block)

        def make():
            machine = automaton(key, shared, window)

            def scan(x: dict) -> tuple:
                words = words_of(x["text"])
                more, found = machine.scan(words)
                spans = merge_spans([(s["start"], s["end"]) for s in x.get("spans") or ()] + more)
                return len(words), [{"start": s, "end": e} for s, e in spans], sorted(found.union(x.get("items") or ()))

            return scan

        past = [F.col(spans_col).alias("spans"), F.col(items_col).alias("items")] if carried else []
        packed = df.select(*docs.columns, F.struct(*source, *past).alias(row))
        return add_columns(packed, row, make, f"{words_col} long, {spans_col} {SPANS}, {items_col} array<string>", drop=(row,))

    out = docs
    for block in blocks:
        if carried:
            out = materialise(out, "marked")
        out, carried = pass_over(out, block), True
    return out if carried else pass_over(out, ())


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """id, n_words, spans of marked words [start, end), ids of the items found: one row per row of docs."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return mark(rows, item_blocks(benchmark, block_words=block_words), window, "text", "n_words", "spans", "items").drop("text")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """The digest columns of the contract."""
    hits = find_hits(docs, benchmark, id_col=id_col, text_col=text_col, **more)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return hits.select(
        F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans of word positions."""
    at = [m.span() for m in _WORD.finditer(lower_ascii(text))]
    parts, last = [], 0
    for s, e in spans:
        parts.append(text[last : at[s][0]])
        last = at[e - 1][1]
    return "".join(parts) + text[last:]


def cut_all(text: str, machine: Automaton, max_coverage: float = MAX_COVERAGE) -> str | None:
    """The text without marked spans, None if too much of it is marked. What closing a gap brings together is cut too."""
    first = True
    while True:
        words = words_of(text)
        spans, _ = machine.scan(words)
        if not spans:
            return text
        if first and sum(e - s for s, e in spans) > max_coverage * len(words):
            return None
        first, text = False, cut(text, spans)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE, text_col: str = "text", block_words: int = BLOCK_WORDS, id_col: str = "item_id") -> DataFrame:
    """docs with marked spans cut out of the text; documents over the coverage limit are dropped. Same columns.

    One block is one pass. Several are marked one after another; then their spans are cut together, and what has been cut is
    marked again until nothing is found in it."""
    spark, columns = docs.sparkSession, docs.columns
    blocks = item_blocks(benchmark, id_col, block_words=block_words)
    first = next(blocks, None)
    if first is None:
        return docs
    second = next(blocks, None)
    done, new, spans, items, n_words = (fresh(docs, x) for x in ("__dropped", "__text", "__spans", "__items", "__words"))
    if second is None:
        key, shared = uuid.uuid4().hex, spark.sparkContext.broadcast(first)

        def make():
            machine = automaton(key, shared, window)

            def clean(text: str | None) -> tuple:
                out = None if text is None else cut_all(text, machine, max_coverage)
                return out, text is not None and out is None

            return clean

        out = add_columns(docs, text_col, make, f"{new} string, {done} boolean")
        return out.where(~F.col(done)).select(*[F.col(new).alias(c) if c == text_col else F.col(c) for c in columns])

    @F.pandas_udf("string")
    def without(texts: pd.Series, marks: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or not len(m) else cut(t, [(x["start"], x["end"]) for x in m]) for t, m in zip(texts, marks)], dtype=object)

    def again() -> Iterator[tuple]:
        yield from item_blocks(benchmark, id_col, block_words=block_words)

    found = lambda df: materialise(mark(df, again(), window, text_col, n_words, spans, items), "marked")
    covered = F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    todo = found(docs)
    clean = todo.where(F.size(spans) == 0).select(*columns)
    todo = todo.where((F.size(spans) > 0) & (covered <= max_coverage * F.col(n_words)))
    while not todo.isEmpty():
        todo = found(materialise(todo.withColumn(text_col, without(F.col(text_col), F.col(spans))).select(*columns), "cut"))
        clean = clean.unionByName(todo.where(F.size(spans) == 0).select(*columns))
        todo = todo.where(F.size(spans) > 0)
    return clean


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, w, least(len(w), 10) AS k FROM b WHERE len(w) > 0),
bi AS (SELECT item_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM bw),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM bi),
ks AS (SELECT DISTINCT k FROM win),
di AS (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k),
dg AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM di),
occ AS (SELECT dg.doc_id, dg.k, dg.i, win.item_id FROM dg JOIN win ON win.k = dg.k AND win.g = dg.g),
pos AS (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, k, i FROM occ)),
nh AS (SELECT doc_id, count(DISTINCT p) AS n FROM pos GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(nh.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n, 0) AS BIGINT) AS n_items, sha256(coalesce(it.s, '')) AS items_sha256, coalesce(nh.n, 0) > 0 AS contaminated
FROM d LEFT JOIN nh ON nh.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id
"""
