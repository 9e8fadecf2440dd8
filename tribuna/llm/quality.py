"""Quality classifier: a weak-label model over heuristic labellers, whose posterior trains a hashed linear scorer.

Labellers look at a text and vote or abstain: letter case, bars, runs of symbols, shouting, repeated words, repeated lines and
word length against quality, and one for it where none of them is near its fault; words, and word beginnings, that go with
annotated toxic rows for toxicity, and one against it where there are none. Annotations (where a row has any) are one more
labeller of each. One hidden class a row is behind the votes; expectation-maximisation estimates each labeller's accuracy
(how often its votes are right) and each row's posterior. The posteriors train logistic scorers over hashed features of the text (words, word beginnings, binned
measures), in which only features that go with the posterior beyond chance get a weight. The scorers alone decide, for every row.

Labellers overlap and depend on one another: some faults come together, others exclude each other. As abstaining tells
nothing in this model, faults that exclude each other do not speak for soundness; the tests check it on such votes.

Fitting reads a bounded sample (about LABELLED annotated rows and UNLABELLED others, by a hash of id and text); its features,
not its texts, come to the driver. Scoring is one narrow pass over whole texts.

Defined cases: null and empty text are rejected with quality 0; tables without annotations or rows leave the labellers
alone or, with no rows at all, keep everything that has text; annotations repeated for an id count once (the worse of each),
rows with a null id have none; repeated rows are sampled and scored each on their own; equal texts get equal scores; ids keep
their type and value; other columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns

#: Bounds of the sample, number of hash buckets, EM steps, gradient steps.
LABELLED, UNLABELLED, BUCKETS, EM_STEPS, FIT_STEPS = 8000, 2000, 1 << 18, 30, 600
#: A word or beginning, and one of the few dozen binned measures, has weight if its share differs between the classes by so
#: many standard errors; decay of the weights; a lexicon's terms.
SCREEN, BIN_SCREEN, DECAY, LEXICON_ROWS, LEXICON_RATE = 6.0, 3.0, 1e-3, 3, 0.8
#: Accuracy that labellers start with, and for how many votes that counts.
ACCURACY, PRIOR = 0.9, 10.0
#: Least quality and, exclusive, most toxicity of a row that is kept.
THRESHOLD, TOXIC_THRESHOLD = 0.5, 0.7

_WORD = re.compile(r"[^\W\d_]+")
_SYMBOLS = re.compile(r"[%$&*#@^~]{2,}")
BEGINNING = 4
#: Buckets of words that a worker keeps.
KEPT_WORDS = 300_000


def measures(text: str, words: list[str], lower: str) -> dict[str, float]:
    """What the labellers of quality look at. words: of the lower-cased text."""
    letters = sum(map(len, words)) or 1
    a, b = (np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in (text, lower))
    upper = np.count_nonzero(a != b) / letters if len(a) == len(b) else 0.0
    tokens = max(1, text.count(" ") + text.count("\n") + 1)
    lines = [x for x in text.split("\n") if x]
    return {
        "upper": upper, "bars": text.count("|") / tokens, "symbols": len(_SYMBOLS.findall(text)) / tokens, "shouts": text.count("!!") / tokens,
        "distinct": _distinct(words),
        "repeats": 1 - len(set(lines)) / len(lines) if len(lines) > 3 else 0.0, "length": letters / max(1, len(words)), "words": float(len(words)),
    }


def _distinct(words: list[str]) -> float:
    """Mean share of distinct words in stretches of 200 words, so that long texts compare with short ones."""
    if len(words) < 20:
        return 1.0
    shares = [len(set(words[i : i + 200])) / len(words[i : i + 200]) for i in range(0, max(1, len(words) - 100), 200)]
    return sum(shares) / len(shares)


def _spread(words: list[str]) -> float:
    """Distinct words against what Heaps' law lets expect of a text that long."""
    return len(set(words)) / max(1.0, len(words) ** 0.75)


#: (measure, its labeller votes against quality at or beyond, not near the fault at or below); a negative sign turns the measure round.
LABELLERS = (("upper", 0.5, 0.12), ("bars", 0.05, 0.0), ("symbols", 0.05, 0.0), ("shouts", 0.1, 0.0), ("-distinct", -0.35, -0.45), ("-spread", -0.6, -1.0), ("repeats", 0.6, 0.2), ("length", 12.0, 9.0))
BINS = {"upper": (0.06, 0.12, 0.3, 0.5), "bars": (0.005, 0.05, 0.2), "symbols": (0.005, 0.05, 0.2), "shouts": (0.005, 0.05, 0.2), "distinct": (0.1, 0.25, 0.35, 0.45), "spread": (0.1, 0.3, 0.6, 1.0), "repeats": (0.2, 0.4, 0.6, 0.8), "length": (2.5, 9.0, 12.0), "words": (5.0, 20.0)}


def bucket(feature: str) -> int:
    return xxhash.xxh32_intdigest(feature) % BUCKETS


class Reader:
    """Votes and hashed features of texts; buckets of words are kept."""

    def __init__(self):
        self.kept: dict[str, int] = {}

    def bucket(self, name: str) -> int:
        b = self.kept.get(name)
        if b is None:
            if len(self.kept) > KEPT_WORDS:
                self.kept.clear()
            self.kept[name] = b = bucket(name)
        return b

    def read(self, text: str) -> tuple[dict[str, float], set[str], set[str]]:
        """(measures, distinct words, distinct beginnings of longer words)."""
        lower = text.lower()
        words = _WORD.findall(lower)
        m = measures(text, words, lower)
        m["spread"] = _spread(words) if len(words) >= 60 else 2.0
        own = set(words)
        return m, own, {w[:BEGINNING] for w in own if len(w) > BEGINNING}

    def binned(self, m: dict[str, float]) -> list[int]:
        return [self.bucket(f"\x00{k}={sum(m[k] > e for e in edges)}") for k, edges in BINS.items()]


def quality_votes(m: dict[str, float]) -> list[int]:
    """-1 where a measure shows its fault, 0 elsewhere; then 1 if no measure is even near its fault."""
    out, fine = [], True
    for name, against, good in LABELLERS:
        x = -m[name[1:]] if name[0] == "-" else m[name]
        out.append(-1 if x >= against else 0)
        fine = fine and x <= good
    return [*out, 1 if fine else 0]


def fit_votes(votes: np.ndarray, steps: int = EM_STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(P(sound) of each row, accuracy of each labeller) from votes (rows x labellers of -1, 0, 1) by EM.

    A labeller's vote is right with its accuracy; whether it votes at all tells nothing, and neither class is the likelier one
    beforehand, so that a rare fault is not argued away. Accuracies start at ACCURACY, which also counts as PRIOR votes, so the
    classes keep their meaning and a labeller that seldom votes keeps a sensible one."""
    n, labellers = votes.shape
    accuracy, sound = np.full(labellers, ACCURACY), np.full(n, 0.5)
    voted = np.abs(votes).sum(axis=0)
    for _ in range(steps if n else 0):
        sound = 1 / (1 + np.exp(-np.clip(votes @ np.log(accuracy / (1 - accuracy)), -60, 60)))
        right = (votes > 0).T @ sound + (votes < 0).T @ (1 - sound)
        accuracy = np.clip((right + PRIOR * ACCURACY) / (voted + PRIOR), 0.05, 0.999)
    return sound, accuracy


def weak_labels(votes: np.ndarray) -> np.ndarray:
    """P(sound) of each row."""
    return fit_votes(votes)[0]


def shares_of_copies(rows: list[np.ndarray], hashes: int = 8) -> np.ndarray:
    """For each row about 1 / (rows that are near copies of it, itself included), by equal minima of a few hashes of its features."""
    out = np.zeros(len(rows))
    for k in range(hashes):
        mixed = [(x.astype(np.uint64) + np.uint64(1 + k)) * np.uint64(0x9E3779B97F4A7C15 + 2 * k * 0x632BE59BD9B4E019 & (1 << 64) - 1) for x in rows]
        least = np.array([(m ^ (m >> np.uint64(29))).min() if len(m) else i for i, m in enumerate(mixed)], dtype=np.uint64)
        _, at, n = np.unique(least, return_inverse=True, return_counts=True)
        out += 1.0 / n[at]
    return out / hashes


def shares_of_copies(rows: list[np.ndarray], hashes: int = 8) -> np.ndarray:
    """For each row about 1 / (rows that are near copies of it, itself included), by equal minima of a few hashes of its features."""
    out = np.zeros(len(rows))
    for k in range(hashes):
        mixed = [(x.astype(np.uint64) + np.uint64(1 + k)) * np.uint64(0x9E3779B97F4A7C15 + 2 * k * 0x632BE59BD9B4E019 & (1 << 64) - 1) for x in rows]
        least = np.array([(m ^ (m >> np.uint64(29))).min() if len(m) else i for i, m in enumerate(mixed)], dtype=np.uint64)
        _, at, n = np.unique(least, return_inverse=True, return_counts=True)
        out += 1.0 / n[at]
    return out / hashes


def fit_linear(rows: list[np.ndarray], target: np.ndarray, screen: float = SCREEN, steps: int = FIT_STEPS, offset: np.ndarray | None = None, decay: float = DECAY, share: np.ndarray | None = None) -> tuple[dict[int, float], float]:
    """({bucket: weight}, intercept) of a logistic scorer on screened features. rows: buckets of each row, distinct; offset:
    what is added to each row's score beforehand, so that the weights learn only what it leaves open; share: weight of a row."""
    n = len(rows)
    offset = np.zeros(n) if offset is None else offset
    share = np.ones(n) if share is None else share
    if n == 0 or (share * target).sum() < 0.5 or (share * (1 - target)).sum() < 0.5:
        return {}, 0.0 if offset.any() else 4.0 if n == 0 or target.mean() >= 0.5 else -4.0
    at = np.repeat(np.arange(n), [len(r) for r in rows])
    ids = np.concatenate(rows)
    n1, n0 = (share * target).sum(), (share * (1 - target)).sum()
    c1, c0 = (np.bincount(ids, weights=(share * w)[at], minlength=BUCKETS) for w in (target, 1 - target))
    common = (c1 + c0) / (n1 + n0)
    z = (c1 / n1 - c0 / n0) / np.sqrt(np.maximum(common * (1 - common), 1 / n**2) * (1 / n1 + 1 / n0))
    kept = np.flatnonzero((np.abs(z) > screen) & (c1 + c0 >= LEXICON_ROWS))
    place = np.full(BUCKETS, -1)
    place[kept] = np.arange(len(kept))
    col = place[ids]
    at, col = at[col >= 0], col[col >= 0]
    weight = share * (target * 0.5 / n1 + (1 - target) * 0.5 / n0)  # both classes count alike
    w, b = np.zeros(len(kept)), 0.0
    g2, b2 = np.zeros(len(kept)), 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(at, weights=w[col], minlength=n) + b + offset, -30, 30)))
        e = (p - target) * weight
        g = np.bincount(col, weights=e[at], minlength=len(kept)) + decay * w
        gb = e.sum()
        g2, b2 = g2 + g * g, b2 + gb * gb
        w -= 0.3 * g / np.sqrt(g2 + 1e-12)
        b -= 0.3 * gb / np.sqrt(b2 + 1e-12)
    return {int(k): float(x) for k, x in zip(kept, w)}, float(b)


def fit_scorers(docs: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", text_col: str = "text", labelled: int = LABELLED, unlabelled: int = UNLABELLED) -> dict:
    """{"quality": (weights, intercept), "toxic": ...} from a bounded sample."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).where("text IS NOT NULL")
    near = lambda rate: F.pmod(F.xxhash64("id", "text"), F.lit(1 << 24)) < F.lit(rate) * (1 << 24)
    none = F.lit(None).cast("int")
    n = rows.count()
    if labels is None:
        sample = rows.where(near(unlabelled / max(1, n))).select("id", "text", none.alias("quality"), none.alias("toxic"))
    else:
        marks = labels.select(labels[id_col].alias("id"), labels["quality"].cast("int").alias("quality"), labels["toxic"].cast("int").alias("toxic")).where("id IS NOT NULL")
        marks = marks.groupBy("id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
        # ids of the sampled rows only, so that what is joined is bounded; a row is sampled by its text too, repeated ids or not
        known = marks.count()
        rate_l, rate_u = labelled / max(1, known), unlabelled / max(1, n)
        tried = rows.withColumn("u", near(rate_u)).where(near(max(rate_l, rate_u)))
        sample = tried.join(marks.withColumn("marked", F.lit(True)), "id", "left").where((F.col("marked") & near(rate_l)) | (F.col("marked").isNull() & F.col("u"))).select("id", "text", "quality", "toxic")

    def make():
        reader = Reader()
        pack = lambda xs: np.unique(np.array(xs, dtype=np.int32)).tobytes()

        def features(row: dict) -> tuple:
            m, words, begins = reader.read(row["text"])
            notes = [0 if x is None else 1 if x > 0 else -1 for x in (row["quality"], row["toxic"])]
            return np.array([*quality_votes(m), *notes], dtype=np.int8).tobytes(), pack([reader.bucket(w) for w in words]), pack([reader.bucket("^" + w) for w in begins]), pack(reader.binned(m))

        return features

    packed = sample.select(F.xxhash64("id", "text").alias("order"), F.struct("text", "quality", "toxic").alias("row"))
    got = add_columns(packed, "row", make, "votes binary, words binary, begins binary, bins binary", drop=("row",)).toPandas().sort_values(["order", "votes", "words"], kind="stable")
    if got.empty:
        return {"quality": ({}, 4.0), "toxic": ({}, -4.0)}
    votes = np.stack([np.frombuffer(v, np.int8) for v in got["votes"]]).astype(np.int64)
    words, begins, bins = ([np.frombuffer(x, np.int32).astype(np.int64) for x in got[c]] for c in ("words", "begins", "bins"))
    noted = votes[:, -1]
    lexicons = []
    for lists in (words, begins):
        yes, no = (np.bincount(np.concatenate([np.zeros(0, np.int64), *[x for x, v in zip(lists, noted) if v == side]]), minlength=BUCKETS) for side in (1, -1))
        listed = (yes >= LEXICON_ROWS) & (yes >= LEXICON_RATE * (yes + no))
        lexicons.append(np.array([1 if listed[x].any() else 0 for x in lists]))
    # for toxicity one vote for is a find, so the roles of the sides change places
    toxic = 1 - weak_labels(-np.stack([noted, *lexicons, np.where(sum(lexicons) > 0, 0, -1)], axis=1))
    good = weak_labels(votes[:, :-1])
    text = [np.concatenate(x) for x in zip(words, begins)]
    share = shares_of_copies(words)  # the words of a text and its copies count as one's
    weights, intercept = fit_linear(bins, good, BIN_SCREEN, decay=DECAY / 10)
    known = np.array([intercept + sum(weights.get(int(b), 0.0) for b in x) for x in bins])
    more, shift = fit_linear(text, good, offset=known, decay=10 * DECAY, share=share)  # words count for what the measures leave open
    return {"quality": ({**more, **weights}, intercept + shift), "toxic": fit_linear([np.concatenate(x) for x in zip(text, bins)], toxic, share=share)}


def score_quality(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, quality_score, toxic_score, kept of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    out = add_columns(source, "text", lambda: Judge(shared.value).scores, "quality_score double, toxic_score double", drop=("text",))
    return out.select(F.col("id").alias(id_col), "quality_score", "toxic_score", ((F.col("quality_score") >= threshold) & (F.col("toxic_score") < TOXIC_THRESHOLD)).alias("kept"))


class Judge:
    """The two scorers over one text."""

    def __init__(self, model: dict):
        (self.wq, self.bq), (self.wt, self.bt) = model["quality"], model["toxic"]
        self.reader = Reader()

    def scores(self, text: str | None) -> tuple[float, float]:
        if not isinstance(text, str) or not text:
            return 0.0, 0.0
        m, words, begins = self.reader.read(text)
        of = self.reader.bucket
        every = {of(w) for w in words} | {of("^" + w) for w in begins} | set(self.reader.binned(m))
        q = self.bq + sum(self.wq[b] for b in sorted(every & self.wq.keys()))
        t = self.bt + sum(self.wt[b] for b in sorted(every & self.wt.keys()))
        return tuple(float(1 / (1 + np.exp(-max(-30.0, min(30.0, x))))) for x in (q, t))


def classify(docs: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fit on the sample, score every row."""
    return score_quality(docs, fit_scorers(docs, labels, id_col, text_col), id_col, text_col)


def keep_good(docs: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows of docs that the scorers accept; same columns. The texts are scored where they lie, with no join."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_scorers(docs, labels, id_col, text_col))

    @F.pandas_udf("boolean")
    def accepted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        judge = Judge(shared.value)
        for batch in batches:
            yield batch.map(lambda t: (lambda s: s[0] >= threshold and s[1] < TOXIC_THRESHOLD)(judge.scores(t))).astype(bool)

    return docs.where(accepted(docs[text_col]))
