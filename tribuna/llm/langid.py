"""Language proportions of a text by expectation-maximisation over character n-gram likelihoods.

A language is a distribution over hashed character trigrams (letters lower-cased, all else one space). A text is a mixture:
each of its trigrams is drawn from one of its languages. EM estimates the proportions; the set of languages grows one at a
time and a further one stays only if it raises the log-likelihood by more than a penalty that grows with the length.

The model is fitted on a bounded sample of labelled rows, about `per_language` of each language (by a hash of the id), and
its size is bounded: BUCKETS numbers a language, CELLS in all. Prediction is one narrow pass over whole texts.

Defined cases: null text and text without a letter are `und` with score 0, as is every text when nothing was learned; rows
with null language or id are never learned from, and a null id is not held out; ties go to the first language by name; any
number of languages is learned (the more there are, the fewer buckets each has, so that the table stays bounded); equal texts
get equal results; ids keep their type and value; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, slices

#: Buckets of a language, and the numbers of a model: with more than CELLS / BUCKETS languages buckets are halved until they fit.
BUCKETS, CELLS, LEAST_BUCKETS = 1 << 15, 1 << 23, 1 << 8
#: Expected number of rows a language is learned from.
PER_LANGUAGE = 1500
#: Added to each count, EM steps a set, and the penalty of a further language in units of the log of the length.
SMOOTHING, STEPS, PENALTY = 0.5, 8, 3.0
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def bucket_count(languages: int) -> int:
    """Buckets of each of so many languages: a power of two; the table of all has CELLS numbers at most while LEAST_BUCKETS allow."""
    n = BUCKETS
    while n > LEAST_BUCKETS and n * languages > CELLS:
        n //= 2
    return n


def trigrams(text: str | None, buckets: int = BUCKETS) -> np.ndarray | None:
    """Bucket of each trigram of a text; None if it has no letter. buckets: a power of two."""
    if not text:
        return None
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[c]
    if not letter.any():
        return None
    c = np.where(letter, c, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of other characters stands for the run
    c = np.concatenate(([32], c[keep], [32])).astype(np.uint32)
    h = c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1] * np.uint32(0x85EBCA77) ^ c[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(33 - buckets.bit_length())).astype(np.int64)


def proportions(grams: np.ndarray, probs: np.ndarray) -> np.ndarray:
    """Proportion of each language; zero outside the selected set. probs: buckets x languages."""
    ids, counts = np.unique(grams, return_counts=True)
    p, w, n = probs[ids], counts.astype(np.float64), len(grams)
    single = w @ np.log(p)
    chosen, best = [int(single.argmax())], float(single.max())
    share, mix = np.ones(1), p[:, chosen[0]]
    while len(chosen) < p.shape[1]:
        gain = (w / mix) @ p / n  # slope of the likelihood towards each language
        gain[chosen] = -1
        new = int(gain.argmax())
        if gain[new] <= 1:
            break
        m, s = p[:, [*chosen, new]], np.append(share * 0.8, 0.2)
        for _ in range(STEPS):
            s = s * ((w / (m @ s)) @ m) / n
        total = m @ s
        reached = float(w @ np.log(total))
        if reached - best <= PENALTY * np.log(n + 1):
            break
        chosen, best, share, mix = [*chosen, new], reached, s / s.sum(), total
    out = np.zeros(p.shape[1])
    out[chosen] = share
    return out


def held_out(id_column) -> object:
    """Whether a row is held out of training: crc32 of the id as text mod 4 is 2."""
    return F.crc32(id_column.cast("string")) % 4 == 2


def fit_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """(languages, buckets x languages probabilities) from rows that are not held out."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), docs[lang_col].cast("string").alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL AND id IS NOT NULL")
    rows = rows.where(~held_out(F.col("id")))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("rows"))
    buckets = bucket_count(sizes.count())
    sample = rows.join(sizes, "lang").where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.lit(float(per_language)) / F.col("rows") * (1 << 20)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, own in sums.items():
                at = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(own[at], pa.int64())], names=["lang", "bucket", "n"])
            sums.clear()

        for batch in slices(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                if (g := trigrams(text, buckets)) is not None:
                    own = sums.get(lang)
                    if own is None:
                        if len(sums) * buckets >= CELLS:
                            yield from flush()
                        own = sums[lang] = np.zeros(buckets, dtype=np.int64)
                    own += np.bincount(g, minlength=buckets)
        yield from flush()

    counted = sample.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # `buckets` rows a language at most
    langs = sorted(counted["lang"].unique())
    table = np.full((buckets, len(langs)), SMOOTHING)
    column = {lang: i for i, lang in enumerate(langs)}
    table[counted["bucket"].to_numpy(), counted["lang"].map(column).to_numpy(dtype=np.int64)] += counted["n"].to_numpy()
    return langs, table / table.sum(axis=0)


def language_mixtures(docs: DataFrame, langs: list[str], probs: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score, languages and shares of the selected set (largest first)."""
    shared = docs.sparkSession.sparkContext.broadcast((langs, probs.astype(np.float64)))
    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))

    def make():
        names, table = shared.value

        def predict(text: str | None) -> tuple:
            grams = trigrams(text, len(table)) if names else None
            if grams is None:
                return UNKNOWN, 0.0, [], []
            share = proportions(grams, table)
            order = [j for j in np.argsort(-share, kind="stable") if share[j] > 0]
            return names[order[0]], float(min(1.0, share[order[0]])), [names[j] for j in order], [float(share[j]) for j in order]

        return predict

    return add_columns(source, "text", make, "lang_pred string, score double, languages array<string>, shares array<double>", drop=("text",))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The columns of the contract, then the mixture."""
    langs, probs = fit_model(docs, id_col, text_col, lang_col)
    out = language_mixtures(docs, langs, probs, id_col, text_col)
    return out.select(F.col("id").alias(id_col), F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "languages", "shares")
