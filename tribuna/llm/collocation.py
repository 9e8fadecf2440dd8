"""Phrase collocation mining: n-grams as rows, hash-aggregated per language, scored by their weakest cut.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends and pieces into words; all contiguous runs of 1 to
`longest` words become rows (lang, phrase, occurrences) and are summed per language. Candidates are phrases of two words and more
with at least `least` occurrences. Counts of the parts before and after each cut are joined to them, the score of a cut is an exact
decimal quotient, and the weakest cut counts. An anti-join with the one-word extensions drops what a longer candidate holds at the
same count: a phrase is at least as frequent as any that holds it, so a longer candidate at that count implies such an extension.
The best of each language are ranked by a window.

A run can only be frequent if all runs within it are. So texts are cut into words once, in slices of a language's texts that are
written as numbered words, and the slices are read in passes. The first counts words. The second and third count pairs and triples
that may be frequent as 64-bit hashes: two runs of one hash look more frequent than they are, never less. The last makes rows of
the runs of two words and more all of whose pairs and triples may be frequent, and counts these as texts. What may be frequent is a
bit set of hashes with a bounded number of bits; a chance hit makes a row more, never one less, so counts are exact whatever the
corpus's size. Runs are counted within a slice before they become rows, so a run as common as a function word is a row a slice.

Defined cases: a null text is empty; a null lang is `und`, together with rows of that lang; texts of any length are read in
stretches cut between words that no run crosses; repeated rows count each; ties go as the order of the report says; an empty
table, or one without frequent phrases, gives no rows; columns other than text and lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_ROWS, join_lookup, materialise, scratch_path

LONGEST, LEAST, SUBSUMED, TOP = 5, 100, 100, 2000
#: Bits of the set of runs that may be frequent, at most (2^28 bits are 32 MB), and bits for each run in it.
MOST_BITS, BITS_A_RUN = 28, 64
#: Runs of up to so many words are counted as hashes before they become rows.
HASHED = 3
#: Words that a task counts together.
SLICE_WORDS = 1_000_000
#: Phrases, and hashes, that a task adds up before they become rows.
TASK_PHRASES, TASK_HASHES = 300_000, 3_000_000
#: Bytes of a text that are cut into words at once, and words that are hashed at once.
STRETCH, CHUNK = 1 << 22, 1 << 17

_ENDS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(_ENDS + b"\t", b"." * len(_ENDS) + b" ")
BREAK = 0
ROW = "lang string, words int, phrase string, f long"
#: Of the hashes of words (Spark's seed) and of pairs.
SEED, SHIFT, MIX = 42, np.uint64(29), (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def pieces(text: str) -> Iterator[list[bytes]]:
    """Words of a text in stretches; `.` stands for one end of a piece or more. No piece is parted between stretches unless it is longer than one."""
    data = text.encode("utf-8").lower().translate(_TABLE)
    at = 0
    while at < len(data):
        end = at + STRETCH
        if end < len(data):
            cut = data.rfind(b".", at, end)
            cut = cut if cut >= 0 else data.find(b".", end)  # a piece longer than a stretch stays whole
            end = cut + 1 if cut >= 0 else len(data)
        yield data[at:end].replace(b".", b" . ").split()
        at = end


class Slice:
    """Texts of one language as numbered words; 0 is the end of a piece."""

    def __init__(self, lang: str):
        self.lang, self.ids, self.parts, self.size = lang, {b".": BREAK}, [], 0

    def add(self, text: str) -> int:
        before, ids = self.size, self.ids
        for words in pieces(text):
            self.parts += [np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int32, len(words)), np.zeros(1, np.int32)]
            self.size += len(words) + 1
        return self.size - before

    def written(self) -> tuple[str, bytes, bytes]:
        """lang, the words by number (no word holds a line end), the texts."""
        return self.lang, b"\n".join(self.ids), np.concatenate(self.parts).tobytes()


class Counted:
    """A written slice, for counting."""

    def __init__(self, lang: str, names: bytes, words: bytes):
        self.lang, self.names, self.x = lang, names.split(b"\n"), np.frombuffer(words, np.int32)

    def single(self) -> Iterator[tuple]:
        """Every word, and the number of all as the empty phrase."""
        counts = np.bincount(self.x, minlength=len(self.names))
        counts[BREAK] = 0
        yield self.lang, 0, "", int(counts.sum())
        for i in np.flatnonzero(counts):
            yield self.lang, 1, self.names[i].decode("utf-8"), int(counts[i])

    def _starts(self, sets: list[Bits]) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
        """By stretches of places: (first place, for each n up to the number of sets which runs of n words may be frequent, hashes of runs of
        one word more)."""
        head = self.lang.encode("utf-8") + b"\0"
        one = np.fromiter((xxhash.xxh64_intdigest(head + w, SEED) for w in self.names), np.uint64, len(self.names))
        known = sets[0].have(one)
        known[BREAK] = False
        for first in range(0, len(self.x), CHUNK):
            part = self.x[first : first + CHUNK + len(sets)]
            h = single = one[part]
            ok = [known[part]]
            for n in range(1, len(sets) + 1):
                h = pair_hash(h[:-1], single[n:])
                if n < len(sets):
                    ok.append(ok[-1][:-1] & ok[-1][1:] & sets[n].have(h))
            most = min(CHUNK, len(self.x) - first)
            yield first, [o[:most] for o in ok[:-1]] + ok[-1:], h

    def hashes(self, sets: list[Bits]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of runs of one word more than there are sets, if all runs within may be frequent, and their numbers."""
        found = []
        for _, ok, h in self._starts(sets):
            both = ok[-1][:-1] & ok[-1][1:]
            found.append(h[both[: len(h)]])
        return np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def runs(self, longest: int, sets: list[Bits]) -> Iterator[tuple]:
        """Runs of two to `longest` words all of whose parts may be frequent."""
        x, names, depth = self.x, self.names, len(sets)
        ok = [np.zeros(len(x), bool) for _ in sets]
        for first, found, _ in self._starts(sets):
            for o, f in zip(ok, found):
                f = f[:CHUNK]
                o[first : first + len(f)] = f
        # code: the number, in this slice, of the run of `size` words that begins at a place; phrases: the runs by number
        code, phrases, here = x, names, ok[0]
        for size in range(2, longest + 1):
            if size <= depth:
                here = ok[size - 1]
            else:
                here[:-1] &= here[1:]
                here[-1:] = False
            at = np.flatnonzero(here)
            distinct, where, counts = np.unique(code[at].astype(np.int64) * len(names) + x[at + size - 1], return_inverse=True, return_counts=True)
            heads, last = np.divmod(distinct, len(names))
            phrases = [phrases[h] + b" " + names[w] for h, w in zip(heads.tolist(), last.tolist())]
            for p, c in zip(phrases, counts.tolist()):
                yield self.lang, size, p.decode("utf-8"), c
            code = np.zeros(len(x), np.int32)
            code[at] = where


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    pair = (first * MIX[0]) ^ ((second ^ (second >> SHIFT)) * MIX[1])
    return pair ^ (pair >> SHIFT)


class Bits:
    """A set of hashes as bits: it may hold more, never less."""

    def __init__(self, bits: int, table: bytes):
        self.mask, self.table = np.uint64((1 << bits) - 1), np.frombuffer(table, np.uint8)

    def have(self, hashes: np.ndarray) -> np.ndarray:
        h = (hashes & self.mask).astype(np.int64)
        return (self.table[h >> 3] >> (h & 7).astype(np.uint8)) & 1 == 1


#: Bits that bitmap_construct_agg puts in one row.
_ROW_BITS = 32768


def bit_set(hashes: DataFrame) -> tuple[int, bytes]:
    """(bits, table) of the set of a column h of hashes: rows of 4 KB, no more of them than the bound of bits allows."""
    bits = min(MOST_BITS, max(15, (hashes.count() * BITS_A_RUN).bit_length()))
    place = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    rows = hashes.select(F.shiftright(place, 15).alias("row"), place.bitwiseAND(F.lit(_ROW_BITS - 1)).alias("bit")).groupBy("row").agg(F.bitmap_construct_agg("bit").alias("bits"))
    table = bytearray(1 << (bits - 3))
    for r in rows.toLocalIterator():
        table[r["row"] * _ROW_BITS // 8 : (r["row"] + 1) * _ROW_BITS // 8] = r["bits"]
    return bits, bytes(table)


def word_hash() -> Column:
    """Hash of lang and phrase as tasks compute it."""
    return F.xxhash64(F.concat(F.encode("lang", "utf-8"), F.lit(b"\0"), F.encode("phrase", "utf-8")))


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Written slices of a task's texts (columns text, lang)."""
    open_: dict[str, Slice] = {}
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        while open_:
            row = open_.popitem()[1].written()
            yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.string()), pa.array([row[1]], pa.binary()), pa.array([row[2]], pa.binary())], names=["lang", "names", "words"])

    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            for text, lang in zip(part.column(0), part.column(1).to_pylist()):
                if t := text.as_py():
                    if lang not in open_:
                        open_[lang] = Slice(lang)
                    held += open_[lang].add(t)
                if held >= SLICE_WORDS:
                    yield from flush()
                    held = 0
    yield from flush()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[Counted]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Counted(*(batch.column(c)[i].as_py() for c in range(3)))


def _phrase_rows(slices: DataFrame, of) -> DataFrame:
    """(lang, words, phrase, f) that `of` gives of each slice, added up within a task, then over all."""
    names, types = ["lang", "words", "phrase", "f"], [pa.string(), pa.int32(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, int] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            rows = iter(total.items())
            while some := list(islice(rows, 50_000)):
                columns = [*zip(*(k for k, _ in some)), [f for _, f in some]]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types)], names=names)
            total.clear()

        for c in _counted(batches):
            for lang, words, phrase, f in of(c):
                key = (lang, words, phrase)
                total[key] = total.get(key, 0) + f
                if len(total) >= TASK_PHRASES:
                    yield from flush()
        yield from flush()

    return slices.mapInArrow(run, ROW).groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))


def _hash_rows(slices: DataFrame, of) -> DataFrame:
    """(h, f) that `of` gives of each slice, added up within a task, then over all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            h, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            f = np.bincount(at, np.concatenate([n for _, n in held]), len(h)).astype(np.int64)
            held.clear()
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(f)], names=["h", "f"])

        for c in _counted(batches):
            held.append(of(c))
            if sum(len(x) for x, _ in held) >= TASK_HASHES:
                yield from flush()
        if held:
            yield from flush()

    return slices.mapInArrow(run, "h long, f long").groupBy("h").agg(F.sum("f").alias("f"))


def _written_slices(rows: DataFrame) -> DataFrame:
    """Slices as a table of small row groups (a row is some megabytes), packed hard: they are read once a pass."""
    path = scratch_path(rows.sparkSession, "phrases-slices")
    rows.write.option("compression", "zstd").option("parquet.block.size", str(16 << 20)).option("parquet.enable.dictionary", "false").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """lang, words, phrase, f of all phrases of 1 to `longest` words with f >= least; words 0 is the number of all words of a language."""
    context = docs.sparkSession.sparkContext
    slices = _written_slices(docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang")).mapInArrow(_sliced, "lang string, names binary, words binary"))

    one = materialise(_phrase_rows(slices, Counted.single).where((F.col("f") >= least) | (F.col("words") == 0)), "phrases-words")
    if longest < 2:
        return one
    sets = [bit_set(one.where("words = 1").select(word_hash().alias("h")))]
    for n in range(2, min(longest, HASHED) + 1):
        known = context.broadcast(sets)
        found = _hash_rows(slices, lambda c, known=known: c.hashes([Bits(*s) for s in known.value])).where(F.col("f") >= least)
        sets = [*sets, bit_set(materialise(found.select("h"), f"phrases-{n}"))]
        known.unpersist()
    known = context.broadcast(sets)
    more = materialise(_phrase_rows(slices, lambda c: c.runs(longest, [Bits(*s) for s in known.value])).where(F.col("f") >= least), "phrases-runs")
    known.unpersist()
    return one.unionByName(more)


def _long(c: str, digits: int = 19) -> str:
    return f"CAST({c} AS DECIMAL({digits}, 0))"


def scored(counts: DataFrame) -> DataFrame:
    """lang, words, phrase, a, l, r, n, score of every candidate, by its weakest cut."""
    phrases = counts.where("words >= 2")
    cuts = phrases.withColumn("w", F.split("phrase", " ")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "words", "phrase", F.col("f").alias("a"), "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.col("words")), " ").alias("rest"))
    part = counts.where("words >= 1")
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cuts = join_lookup(cuts, counts.where("words = 0").select("lang", F.col("f").alias("n")), ["lang"])
    score = F.expr(f"(CAST(1000 AS DECIMAL(4, 0)) * {_long('a')} * {_long('n')}) DIV ({_long('l')} * {_long('r')})").cast("long")
    best = cuts.withColumn("score", score).groupBy("lang", "words", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("x"))
    return best.select("lang", "words", "phrase", "x.a", "x.l", "x.r", "x.n", "x.score")


def subsumed(counts: DataFrame) -> DataFrame:
    """lang, phrase, of (the most occurrences of a phrase that has one word more at an end)."""
    longer = counts.where("words >= 3").withColumn("w", F.split("phrase", " "))
    ends = F.explode(F.array(F.array_join(F.slice("w", F.lit(1), F.col("words") - 1), " "), F.array_join(F.slice("w", F.lit(2), F.col("words") - 1), " ")))
    return longer.select("lang", ends.alias("phrase"), F.col("f").alias("of")).groupBy("lang", "phrase").agg(F.max("of").alias("of"))


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, percent: int = SUBSUMED, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best `top` phrases of each language."""
    counts = phrase_counts(docs, longest, least)
    longer = subsumed(counts)
    kept = scored(counts).alias("c").join(longer.alias("x"), (F.col("c.lang") == F.col("x.lang")) & (F.col("c.phrase") == F.col("x.phrase")) & (100 * F.col("x.of") >= percent * F.col("c.a")), "left_anti")
    # Spark keeps `top` rows of a language in each task before it shuffles
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: The same with every n-gram of every text as a row.
ORACLE_SQL = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, i, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, w, i, unnest(range(1, least({LONGEST}, len(w) - i + 1) + 1)) AS m FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w))),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= {LEAST}),
cut AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM f WHERE m >= 2),
s AS (SELECT cut.lang, cut.m, cut.phrase, a, k, x.f AS l, y.f AS r, n, CAST((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score FROM cut JOIN total ON total.lang = cut.lang
 JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(w[1:k], ' ') JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(w[k + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
held AS (SELECT DISTINCT lang, f, array_to_string(string_split(phrase, ' ')[i:i + j - 1], ' ') AS inner_phrase FROM (SELECT *, unnest(range(1, m - j + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS j FROM f WHERE m >= 3))),
kept AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.lang = b.lang AND h.inner_phrase = b.phrase AND 100 * h.f >= {SUBSUMED} * b.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept QUALIFY rank <= {TOP}"""
