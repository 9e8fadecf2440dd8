"""Measures of partitions: purity, sizes, cross tables, agreement, and validity indices. Data stays in aggregates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from ..sources.scratch import materialise
from . import lloyd
from .ranks import small


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def _merged(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Moments (rows, two means, two sums of squares, sum of products; a row a pair) of two sets of rows together."""
    n = s[:, 0] + t[:, 0]
    part, dx, dy = t[:, 0] / np.maximum(n, 1), t[:, 1] - s[:, 1], t[:, 2] - s[:, 2]
    both = s[:, 0] * part
    return np.column_stack([n, s[:, 1] + dx * part, s[:, 2] + dy * part, s[:, 3] + t[:, 3] + dx * dx * both, s[:, 4] + t[:, 4] + dy * dy * both, s[:, 5] + t[:, 5] + dx * dy * both])


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b, r: Pearson's correlation of each pair of columns over rows that have both; null under two rows and where a column does not vary.
    One pass, nothing is written: a task gives six numbers a pair, which are joined in the order of the tasks."""
    pairs = list(combinations(range(len(columns)), 2))
    data = df.select(*[F.col(c).cast("double").alias(c) for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(pairs), 6))
        for batch in batches:
            known = [np.asarray(c.is_valid()) for c in batch.columns]
            values = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            here = np.zeros((len(pairs), 6))
            for p, (i, j) in enumerate(pairs):
                on = known[i] & known[j]
                x, y = values[i][on], values[j][on]
                if len(x):
                    u, v = x - x.mean(), y - y.mean()
                    here[p] = len(x), x.mean(), y.mean(), u @ u, v @ v, u @ v
            total = _merged(total, here)
        yield pa.RecordBatch.from_arrays([pa.array([int(TaskContext.get().partitionId())], pa.int64()), pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["task", "s"])

    total = np.zeros((len(pairs), 6))
    for r in sorted(data.mapInArrow(run, "task long, s array<double>").collect(), key=lambda r: r["task"]):  # a row a task
        total = _merged(total, np.array(r["s"]).reshape(-1, 6))
    spread = np.sqrt(total[:, 3] * total[:, 4])
    rows = [(columns[i], columns[j], float(total[p, 5] / spread[p]) if total[p, 0] > 1 and spread[p] != 0 else None) for p, (i, j) in enumerate(pairs)]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")


def cumulative_variance(df: DataFrame, order: str, variance: str, enough: float = 0.90) -> DataFrame:
    """Adds share, cumulative, and is_enough (the first rows in order that reach `enough`). A row an axis, so one window is small."""
    w = Window.partitionBy(F.lit(1)).orderBy(order)
    total = F.sum(variance).over(Window.partitionBy(F.lit(1)))
    total = F.when(total > 0, total)
    upto = F.sum(variance).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumns({"share": F.col(variance) / total, "cumulative": upto / total}).withColumn("is_enough", F.col("cumulative") >= enough)


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count("*").alias("n"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: ari. Equal trivial partitions agree fully."""
    cells = contingency(df, a, b)
    pairs = lambda d: d.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0)).alias("s"))
    rows, cols = cells.groupBy(a).agg(F.sum("n").alias("n")), cells.groupBy(b).agg(F.sum("n").alias("n"))
    one = pairs(cells).select(F.col("s").alias("c")).crossJoin(pairs(rows).select(F.col("s").alias("r"))).crossJoin(pairs(cols).select(F.col("s").alias("k"))).crossJoin(cells.agg(F.sum("n").alias("n")))  # single rows
    total = F.col("n") * (F.col("n") - 1) / 2
    expected = F.when(total > 0, F.col("r") * F.col("k") / F.when(total > 0, total)).otherwise(F.lit(0.0))
    spread = (F.col("r") + F.col("k")) / 2 - expected
    return one.select(F.when(spread != 0, (F.col("c") - expected) / F.when(spread != 0, spread)).otherwise(F.lit(1.0)).alias("ari"))


def match_rate(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.avg((F.col(a) == F.col(b)).cast("double")).alias("match_rate"))


def crosstab(df: DataFrame, a: str, b: str, margins: bool = True) -> DataFrame:
    """a, b, level (0 cell, 1 row total, 2 column total, 3 grand total), n: long form, so no driver-side pivot is needed."""
    if not margins:
        return contingency(df, a, b)
    return df.cube(a, b).agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"))


def tag_shares(df: DataFrame, cluster: str, tags: Sequence[str], weight: str | None = None) -> DataFrame:
    """cluster, tag, pos, share: mean of each tag; `weight` as in purity."""
    mean = lambda t: F.sum(F.col(t) * F.col(weight)) / F.sum(F.when(F.col(t).isNotNull(), F.col(weight))) if weight else F.avg(t)
    one = df.groupBy(cluster).agg(*[mean(t).alias(t) for t in tags])
    items = F.array(*[F.struct(F.lit(t).alias("tag"), F.lit(i).alias("pos"), F.col(t).alias("share")) for i, t in enumerate(tags)])
    return one.select(cluster, F.explode(items).alias("x")).select(cluster, "x.tag", "x.pos", "x.share")


def purity(df: DataFrame, cluster: str, tags: Sequence[str], vocabulary: Sequence[str], text: str = "texto_limpio", weight: str | None = None) -> DataFrame:
    """Per cluster: n, strongest tag and its share, most common term and its share of rows, the larger share. One aggregate.

    `weight` names a column with the number of rows that a row stands for."""
    tokens = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+")
    rows = F.col(weight) if weight else F.lit(1)
    share = lambda x: F.sum(x.cast("double") * rows) / F.sum(F.when(x.isNotNull(), rows))
    has = [share(F.array_contains(tokens, t.lower()).cast("double")) for t in vocabulary]
    best = lambda xs: F.array_max(F.array(*[F.struct(x.alias("share"), F.lit(-i).alias("pos"), F.lit(n).alias("name")) for i, (n, x) in enumerate(xs)])) if xs else F.struct(F.lit(0.0).alias("share"), F.lit(0).alias("pos"), F.lit("ninguno").alias("name"))
    got = df.groupBy(cluster).agg(F.sum(rows).cast("long").alias("n"), best([(t, share(F.col(t))) for t in tags]).alias("tag"), best(list(zip(vocabulary, has))).alias("term"))
    name = lambda c: F.when(F.col(f"{c}.share") > 0, F.col(f"{c}.name")).otherwise(F.lit("ninguno"))
    top = lambda c: F.greatest(F.col(f"{c}.share"), F.lit(0.0))
    return got.select(cluster, "n", top("tag").alias("purity_tag"), name("tag").alias("tag_dominante"), top("term").alias("purity_term"), name("term").alias("term_dominante"), F.greatest(top("tag"), top("term")).alias("purity_naming"))


def weighted_purity(per_cluster: DataFrame, column: str = "purity_naming") -> DataFrame:
    return per_cluster.agg((F.sum(F.col("n") * F.col(column)) / F.sum("n")).alias(column))


def cluster_sizes(df: DataFrame, cluster: str, least_share: float = 0.02) -> DataFrame:
    """One row: clusters, smallest, median, smallest share, how many are below the least share."""
    sizes = df.groupBy(cluster).agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("total"))
    return sizes.crossJoin(total).agg(F.count("*").alias("clusters"), F.min("n").alias("smallest"), F.median("n").alias("median"), F.min(F.col("n") / F.col("total")).alias("smallest_share"), F.count_if(F.col("n") / F.col("total") < least_share).alias("degenerate"))


def majority(df: DataFrame, cluster: str, label: str, weight: str | None = None) -> DataFrame:
    """Most common label of each cluster; ties go to the smaller label. `weight` as in purity."""
    cells = df.groupBy(cluster, label).agg(F.sum(weight).alias("n")) if weight else contingency(df, cluster, label)
    return cells.groupBy(cluster).agg(F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias("majority"), F.sum("n").alias("n"))


def rollup_violations(df: DataFrame, micro: str, macro: str) -> DataFrame:
    """Micro-clusters that lie in more than one macro label (none in a sound hierarchy)."""
    return df.groupBy(micro).agg(F.count_distinct(macro).alias("labels")).where("labels <> 1")


def centroids(df: DataFrame, cluster: str, vector: str = "features") -> DataFrame:
    """cluster, n, centroid: means by position. A batch of rows becomes its sums by cluster and position; Spark adds these up."""
    kind = df.schema[cluster].dataType
    rows = df.select(cluster, F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            of, flat = batch.column(0).dictionary_encode(null_encoding="encode"), batch.column(1).flatten()
            length = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            width = int(length.max())
            place = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
            cell = np.repeat(of.indices.to_numpy(zero_copy_only=False), length) * width + place
            known = flat.is_valid().to_numpy(zero_copy_only=False)
            x, cells = flat.to_numpy(zero_copy_only=False), width * len(of.dictionary)
            rows_ = np.bincount(cell, minlength=cells)
            at = np.flatnonzero(rows_)
            columns = [np.bincount(cell[known], x[known], cells)[at], np.bincount(cell[known], minlength=cells)[at], rows_[at]]
            yield pa.RecordBatch.from_arrays([of.dictionary.take(pa.array(at // width)), pa.array((at % width).astype(np.int32)), pa.array(columns[0]), pa.array(columns[1].astype(np.int64)), pa.array(columns[2].astype(np.int64))], names=[cluster, "i", "s", "k", "n"])

    schema = StructType([StructField(cluster, kind), StructField("i", IntegerType()), StructField("s", DoubleType()), StructField("k", LongType()), StructField("n", LongType())])
    long = rows.mapInArrow(run, schema).groupBy(cluster, "i").agg((F.sum("s") / F.when(F.sum("k") > 0, F.sum("k"))).alias("m"), F.sum("n").alias("n"))
    return long.groupBy(cluster).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))  # a row per dimension


def davies_bouldin(df: DataFrame, cluster: str, vector: str = "features") -> DataFrame:
    """One row: the index. Only the k x k centroids are paired."""
    c = small(centroids(df, cluster, vector), 10_000)
    s = df.join(c, cluster).groupBy(cluster).agg(F.avg(F.sqrt(squared_distance(F.col(vector), F.col("centroid")))).alias("s"), F.any_value("centroid").alias("c"))
    a, b = s.select(F.col(cluster).alias("i"), F.col("s").alias("si"), F.col("c").alias("ci")), s.select(F.col(cluster).alias("j"), F.col("s").alias("sj"), F.col("c").alias("cj"))
    d = F.sqrt(squared_distance(F.col("ci"), F.col("cj")))
    pair = a.join(small(b, 10_000), F.col("i") != F.col("j")).withColumn("d", d)
    r = F.when(F.col("d") > 0, (F.col("si") + F.col("sj")) / F.when(F.col("d") > 0, F.col("d"))).otherwise(F.lit(0.0))
    return pair.groupBy("i").agg(F.max(r).alias("r")).agg(F.avg("r").alias("davies_bouldin"))


def calinski_harabasz(df: DataFrame, cluster: str, vector: str = "features") -> DataFrame:
    """One row: the index, from within and between dispersion."""
    c = centroids(df, cluster, vector)
    overall = centroids(df.select(F.lit(0).alias("one"), vector), "one", vector).select(F.col("centroid").alias("g"), F.col("n").alias("total"))
    within = df.join(small(c, 10_000), cluster).agg(F.sum(squared_distance(F.col(vector), F.col("centroid"))).alias("w"))
    between = c.crossJoin(overall).agg(F.sum(F.col("n") * squared_distance(F.col("centroid"), F.col("g"))).alias("b"), F.count("*").alias("k"), F.max("total").alias("n"))
    return within.crossJoin(between).select(((F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("n") - F.col("k")))).alias("calinski_harabasz"))


#: Rows of the sample that a silhouette is measured on, where it is not that of all rows.
SILHOUETTE_ROWS = 2000


def hash_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows by a hash of the seed and the key as text: the same rows in every run and every engine, a bounded top-k, no full sort."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def silhouette(df: DataFrame, cluster: str, key: str, vector: str = "features", sample: int = SILHOUETTE_ROWS, seed: int = 42) -> DataFrame:
    """cluster, n, silhouette (Euclidean) on a bounded sample, which alone is paired with itself; one-row clusters are 0."""
    s = hash_sample(df.select(F.col(key).alias("id"), F.col(cluster).alias("c"), F.col(vector).alias("v")), sample, "id", seed)
    other = F.broadcast(s.select(F.col("id").alias("id2"), F.col("c").alias("c2"), F.col("v").alias("v2")))
    s = s.repartition(s.sparkSession.sparkContext.defaultParallelism, "id")  # few rows, much work: over all cores
    d = s.join(other, F.col("id") != F.col("id2")).groupBy("id", "c", "c2").agg(F.avg(F.sqrt(squared_distance(F.col("v"), F.col("v2")))).alias("d"))
    ab = d.groupBy("id", "c").agg(F.max(F.when(F.col("c") == F.col("c2"), F.col("d"))).alias("a"), F.min(F.when(F.col("c") != F.col("c2"), F.col("d"))).alias("b"))
    top = F.greatest("a", "b")
    value = F.when(F.col("a").isNull() | (top == 0), 0.0).otherwise((F.col("b") - F.col("a")) / F.when(top > 0, top))
    return ab.groupBy(F.col("c").alias(cluster)).agg(F.count("*").alias("n"), F.avg(value).alias("silhouette"))


def silhouette_of_all(df: DataFrame, cluster: str, key: str, vector: str = "features") -> DataFrame:
    """The same over all rows. Every block of rows is held against every block, a pair at a time, and leaves its rows' sums of distances
    to each cluster: quadratic work by nature, in tasks of bounded memory. Rows without a cluster or a vector count as 0 and are nobody's
    neighbours; there may be some hundred clusters."""
    names = [r[0] for r in df.select(cluster).where(F.col(cluster).isNotNull()).distinct().orderBy(cluster).collect()]
    kind = df.schema[cluster].dataType
    code = F.array_position(F.array(*[F.lit(x).cast(kind) for x in names]), F.col(cluster)) - 1 if names else F.lit(None)
    whole = df.where(F.col(cluster).isNotNull() & F.col(vector).isNotNull()).withColumn("_code", code)
    blocks = lloyd.packed(whole, vector, key, "_code")
    sizes = [0] * len(names)
    for r in whole.groupBy("_code").count().collect():  # a row a cluster
        sizes[r["_code"]] = r["count"]
    k, n = len(names), np.array(sizes, float)
    a = blocks.withColumn("at", F.monotonically_increasing_id()).select("at", "labels", F.col("x").alias("xa"), F.col("n").alias("na"))
    b = blocks.select(F.col("labels").alias("lb"), "x", "n")
    pairs = a.repartition(max(1, a.sparkSession.sparkContext.defaultParallelism)).crossJoin(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, own, xa, na, lb, xb, nb in zip(*(batch.column(i).to_pylist() for i in range(7))):
                va, vb = np.frombuffer(xa, float).reshape(na, -1), np.frombuffer(xb, float).reshape(nb, -1)
                one, sums = np.eye(k)[np.frombuffer(lb, np.int64)], np.empty((na, k))
                norms = (vb * vb).sum(1)
                for i in range(0, na, 512):
                    v = va[i : i + 512]
                    near = (v * v).sum(1)[:, None] + norms
                    d = near - 2 * v @ vb.T
                    d[d <= 1e-12 * near] = 0.0
                    sums[i : i + 512] = np.sqrt(d) @ one
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([own], pa.binary()), pa.array([sums.tobytes()], pa.binary())], names=["at", "labels", "s"])

    def value(pdf: pd.DataFrame) -> pd.DataFrame:
        own, sums = np.frombuffer(pdf["labels"].iloc[0], np.int64), sum(np.frombuffer(s, float) for s in pdf["s"]).reshape(-1, k)
        rows = np.arange(len(own))
        inner = sums[rows, own] / np.maximum(n[own] - 1, 1)
        other = sums / n
        other[rows, own] = np.inf
        outer = other.min(1)
        top = np.maximum(inner, outer)
        s = np.where((n[own] > 1) & (top > 0) & np.isfinite(outer), (outer - inner) / np.where(top > 0, top, 1), np.where((n[own] > 1) & ~np.isfinite(outer), np.nan, 0.0))
        return pd.DataFrame({"code": np.arange(k), "s": np.bincount(own, s, k)})

    sums = pairs.mapInArrow(run, "at long, labels binary, s binary").groupBy("at").applyInPandas(value, "code long, s double").groupBy("code").agg(F.sum("s").alias("s"))
    counts = df.groupBy(cluster).agg(F.count("*").alias("n")).withColumn("code", code)
    return counts.join(sums, "code", "left").select(cluster, "n", (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("silhouette"))


def elbow_scores(table: Sequence[tuple[int, float, float]]) -> list[dict]:
    """(k, inertia, Davies-Bouldin) -> distance to the secant plus inverted index, both scaled to [0, 1]; a handful of rows."""
    ks, inertias, dbs = zip(*sorted(table))
    dx, dy = ks[-1] - ks[0], inertias[-1] - inertias[0]
    far = [abs(dx * (y - inertias[0]) - dy * (x - ks[0])) / ((dx * dx + dy * dy) ** 0.5 + 1e-9) for x, y in zip(ks, inertias)]
    scaled = lambda xs: [(x - min(xs)) / (max(xs) - min(xs) + 1e-8) for x in xs]
    turned = [(max(dbs) - d) / (max(dbs) - min(dbs) + 1e-8) for d in dbs]
    return [{"k": k, "inertia": i, "davies_bouldin": d, "distance": f, "score": a + b} for k, i, d, f, a, b in zip(ks, inertias, dbs, far, scaled(far), turned)]
