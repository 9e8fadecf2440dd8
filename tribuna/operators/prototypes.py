"""K-Prototypes of many fits at once: every pass over the packed rows serves all pairs of gamma and k.

Categories travel as the ranks of their values beside the vector. A pass gives each task's sums and counts of values for each
prototype of each fit; Spark adds them and picks the modes, so prototypes, some hundred numbers each, are all that reaches the driver.

Defined cases: rows with a null vector take no part; a null category equals a null and is no mode unless there is no other; ties of
distance go to the first prototype, of modes to the smallest value; a prototype without rows stays where it is.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lloyd
from .ranks import global_rank, small

NULL = 0.0


@dataclass
class Prototypes:
    """One fit: vectors followed by the ranks of the categories, a row a prototype; means and sizes are those of its clusters."""

    gamma: float
    k: int
    at: np.ndarray
    means: np.ndarray | None = None
    sizes: np.ndarray | None = None

    def nearest(self, x: np.ndarray, categories: int) -> np.ndarray:
        d = x.shape[1] - categories
        far = np.empty((len(self.at), len(x)))
        for i, p in enumerate(self.at):
            far[i] = ((x[:, :d] - p[:d]) ** 2).sum(1) + self.gamma * (x[:, d:] != p[d:]).sum(1)
        return far.argmin(0)


def coded(df: DataFrame, numeric: str, categories: Sequence[str], out: str = "_coded") -> DataFrame:
    """df with the vector and, behind it, the rank of each category's value among its values (0 for null)."""
    vector = [F.col(numeric).cast("array<double>")]
    for i, c in enumerate(categories):
        codes = global_rank(df, c, f"_rank{i}").withColumnRenamed(c, f"_value{i}")
        df = df.join(small(codes), F.col(c) == F.col(f"_value{i}"), "left").drop(f"_value{i}")
        vector.append(F.array(F.coalesce(F.col(f"_rank{i}").cast("double"), F.lit(NULL))))
    return df.withColumn(out, F.concat(*vector)).drop(*[f"_rank{i}" for i in range(len(categories))])


def _passed(blocks: DataFrame, fits: Sequence[Prototypes], categories: int) -> None:
    """Means (vectors, then modes) and sizes of every fit's clusters, in one pass; those of empty clusters are the prototypes."""
    shared = blocks.sparkSession.sparkContext.broadcast([(i, Prototypes(f.gamma, f.k, f.at)) for i, f in enumerate(fits)])
    names = ["f", "c", "j", "code", "x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        modes: dict[tuple[int, int, int, float], int] = {}
        for _, _, x in lloyd.unpacked(batches):
            d = x.shape[1] - categories
            for i, fit in shared.value:
                of = fit.nearest(x, categories)
                for c in np.unique(of).tolist():
                    own = x[of == c]
                    total = sums.setdefault((i, c), np.zeros(d + 1))
                    total += np.append(own[:, :d].sum(0), len(own))
                    for m in range(categories):
                        for code, n in zip(*np.unique(own[:, d + m], return_counts=True)):
                            modes[i, c, d + 1 + m, float(code)] = modes.get((i, c, d + 1 + m, float(code)), 0) + int(n)
        rows = [(i, c, j, 0.0, float(v)) for (i, c), total in sums.items() for j, v in enumerate(total)] + [(*k, float(n)) for k, n in modes.items()]
        for at in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows[at : at + 10_000]], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()))], names=names)

    added = blocks.mapInArrow(run, "f int, c int, j int, code double, x double").groupBy("f", "c", "j", "code").agg(F.sum("x").alias("x"))
    most = F.struct(F.col("code") != NULL, "x", -F.col("code"))  # a null is a mode only where there is nothing else
    got = added.groupBy("f", "c", "j").agg(F.max_by("code", most).alias("code"), F.sum("x").alias("x")).collect()  # a prototype's numbers
    shared.unpersist()
    for f in fits:
        f.means, f.sizes = f.at.copy(), np.zeros(len(f.at))
    d = fits[0].at.shape[1] - categories if fits else 0
    for r in got:
        f = fits[r["f"]]
        if r["j"] == d:
            f.sizes[r["c"]] = r["x"]
        else:
            f.means[r["c"], r["j"] if r["j"] < d else r["j"] - 1] = r["x"] if r["j"] < d else r["code"]
    for f in fits:
        on = f.sizes > 0
        f.means[on, :d] /= f.sizes[on, None]


def fit(blocks: DataFrame, first: np.ndarray, pairs: Sequence[tuple[float, int]], categories: int, steps: int = 100, tolerance: float = 1e-9) -> list[Prototypes]:
    """Fits of every (gamma, k) from the first k rows given, until no prototype moves (at most `steps` times)."""
    fits = [Prototypes(gamma, k, first[:k].copy()) for gamma, k in pairs]
    open_, d = list(fits) if len(first) else [], first.shape[1] - categories
    for step in range(steps + 1):
        if not open_:
            break
        _passed(blocks, open_, categories)
        moving = [f for f in open_ if (f.means[:, d:] != f.at[:, d:]).any() or np.sqrt(((f.means[:, :d] - f.at[:, :d]) ** 2).sum(1)).max() > tolerance]
        if step < steps:
            for f in moving:
                f.at = f.means
        open_ = moving
    return fits


def davies_bouldin(blocks: DataFrame, fits: Sequence[Prototypes], categories: int) -> list[float | None]:
    """The index of each fit's clusters by their vectors, in one pass; null under two clusters."""
    shared = blocks.sparkSession.sparkContext.broadcast(list(fits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far = [np.zeros(len(f.at)) for f in shared.value]
        for _, _, x in lloyd.unpacked(batches):
            d = x.shape[1] - categories
            for total, f in zip(far, shared.value):
                of = f.nearest(x, categories)
                total += np.bincount(of, np.sqrt(((x[:, :d] - f.means[of, :d]) ** 2).sum(1)), len(f.at))
        for i, total in enumerate(far):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(total), i, np.int32)), pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["f", "c", "x"])

    far = [np.zeros(len(f.at)) for f in fits]
    for r in blocks.mapInArrow(run, "f int, c int, x double").groupBy("f", "c").agg(F.sum("x").alias("x")).collect():
        far[r["f"]][r["c"]] = r["x"]
    shared.unpersist()
    out: list[float | None] = []
    for f, total in zip(fits, far):
        on = f.sizes > 0 if f.sizes is not None else np.zeros(0, bool)
        if on.sum() < 2:
            out.append(None)
            continue
        m, spread = f.means[on, : f.means.shape[1] - categories], total[on] / f.sizes[on]
        apart = np.sqrt(((m[:, None] - m) ** 2).sum(2))
        ratio = np.divide(spread[:, None] + spread, apart, out=np.zeros_like(apart), where=apart > 0)
        np.fill_diagonal(ratio, 0.0)
        out.append(float(ratio.max(1).mean()))
    return out
