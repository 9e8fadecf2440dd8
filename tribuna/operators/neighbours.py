"""Neighbour lists from random trees, and a spectral layout of the graph they form.

Rows are dealt into leaves of about LEAF rows by TREES trees of random cuts; each row is held against its leaf in every tree and keeps
the nearest of all. A tree is drawn from a bounded sample (SAMPLE rows by hash): a cut is the sample's median along a random direction.
A row with its vector is sent once a tree, and a tree gives one short list a row, so what is shuffled grows with the rows; candidate pairs
and their vectors are never rows. Leaves that came out large (equal rows, or more rows than SAMPLE can part) are dealt into parts by hash.
Tables of up to LEAF rows are one leaf, so their lists are exact.

The layout solves for the leading directions of the graph's random walk by power iterations: each step is one join and one aggregate
over the edges, with the constant direction taken out and the others made orthogonal from their products (a few numbers).

Defined cases: rows with a null vector take no part; under two rows have no neighbours; equal rows are neighbours at 0; ties go by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from ..sources.scratch import materialise
from .density import bounded_sample

NEIGHBOURS, LEAF, TREES, SAMPLE = 15, 4096, 32, 8192
#: Sampled rows that a leaf holds at least, and rows held against others at once.
LEAF_SAMPLED, AT_ONCE = 8, 256


def random_tree(x: np.ndarray, most: int, rnd: np.random.Generator):
    """A tree of cuts (direction, value, rows up to it, rows beyond) until a node has `most` rows of x or only equal ones; None is a leaf."""
    if len(x) <= most:
        return None
    direction = rnd.normal(size=x.shape[1])
    p = x @ direction
    least, top = p.min(), p.max()
    if top - least <= 1e-9 * max(abs(top), abs(least)):
        return None
    value = np.median(p)
    value = value if value < top else p[p < top].max()
    return direction, value, random_tree(x[p <= value], most, rnd), random_tree(x[p > value], most, rnd)


def leaves(tree, x: np.ndarray) -> np.ndarray:
    """Number of each row's leaf."""
    out, todo, number = np.zeros(len(x), np.int64), [(tree, np.arange(len(x)))], 0
    while todo:
        node, rows = todo.pop()
        if node is None:
            out[rows] = number
            number += 1
        else:
            direction, value, low, high = node
            on = x[rows] @ direction <= value
            todo += [(low, rows[on]), (high, rows[~on])]
    return out


def nearest_places(x: np.ndarray, y: np.ndarray, k: int, same: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places, distances) of the k rows of y (all, if fewer) nearest each row of x, ties by place; `same` is each row's own place in y (-1: none).
    Rows are picked by products and ordered by differences, so equal rows are at 0."""
    d = (y * y).sum(1) - 2 * x @ y.T
    if same is not None:
        own = np.flatnonzero(same >= 0)
        d[own, same[own]] = np.inf
    some = min(k + 8, d.shape[1])
    at = np.sort(np.argpartition(d, some - 1, axis=1)[:, :some], axis=1)
    far = np.sqrt(((x[:, None] - y[at]) ** 2).sum(2))
    far[np.isinf(np.take_along_axis(d, at, 1))] = np.inf
    order = np.argsort(far, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(at, order, 1), np.take_along_axis(far, order, 1)


def vector_cells(x: np.ndarray) -> list[bytes]:
    """Each row's bytes, in single precision where that loses nothing."""
    short = x.astype(np.float32)
    x = short if np.array_equal(short.astype(float), x) else x
    return [row.tobytes() for row in x]


def cell_vectors(cells: list[bytes], dims: int) -> np.ndarray:
    return np.array([np.frombuffer(c, np.float32 if len(c) == 4 * dims else np.float64) for c in cells], float).reshape(len(cells), dims)


def vectors_of(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def neighbour_graph(df: DataFrame, vector: str = "features", key: str = "_row_id", k: int = NEIGHBOURS, trees: int = TREES, leaf: int = LEAF, seed: int = 42) -> DataFrame:
    """a, b, d: the (approximately) k nearest rows of each row, by id (the key must be unique and whole)."""
    spark = df.sparkSession
    points = materialise(df.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")), "points")
    n = points.count()
    _, x = bounded_sample(points, "v", "id", SAMPLE, seed)
    dims, rnd = x.shape[1], np.random.default_rng(seed)
    most = max(LEAF_SAMPLED, leaf * len(x) // max(n, 1))
    grown = [random_tree(x, most, rnd) for _ in range(trees)] if n > leaf else [None]
    shared = spark.sparkContext.broadcast(grown)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = vectors_of(batch.column(1), batch.num_rows) if batch.num_rows else np.zeros((0, dims))
            cells = pa.array(vector_cells(v), pa.binary())
            for t, tree in enumerate(shared.value):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), t)), pa.array(leaves(tree, v)), batch.column(0), cells], names=["tree", "leaf", "id", "v"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in deal(batches):
            yield batch.select(["tree", "leaf"])

    # some hundred leaves a tree; only the large ones are named
    sizes = points.mapInArrow(count, "tree long, leaf long").groupBy("tree", "leaf").agg(F.count("*").alias("n")).where(F.col("n") > 2 * leaf)
    parts = F.broadcast(sizes.select("tree", "leaf", F.ceil(F.col("n") / (2 * leaf)).alias("parts")))
    dealt = points.mapInArrow(deal, "tree long, leaf long, id long, v binary").join(parts, ["tree", "leaf"], "left")
    dealt = dealt.select("tree", "leaf", F.coalesce(F.pmod(F.xxhash64("id", "tree"), F.col("parts")), F.lit(0)).alias("part"), "id", "v")

    def near(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        ids, v = group["id"].to_numpy(), cell_vectors(group["v"].to_pylist(), dims)
        lists: list = []
        for at in range(0, len(ids), AT_ONCE):
            rows = np.arange(at, min(at + AT_ONCE, len(ids)))
            places, d = nearest_places(v[rows], v, k, rows)
            on = np.isfinite(d)
            lists += [[{"d": e, "b": b} for e, b in zip(d[i][on[i]].tolist(), ids[places[i][on[i]]].tolist())] for i in range(len(rows))]
        return pa.table({"a": ids, "near": pa.array(lists, pa.list_(pa.struct([("d", pa.float64()), ("b", pa.int64())])))})

    lists = dealt.groupBy("tree", "leaf", "part").applyInArrow(near, "a long, near array<struct<d: double, b: bigint>>")
    # a pair has the same distance in every tree, so its copies lie side by side
    merged = let(F.sort_array(F.flatten(F.collect_list("near"))), lambda s: F.slice(F.filter(s, lambda e, i: (i == 0) | (F.get(s, i - 1)["b"] != e["b"])), 1, k))
    return materialise(lists.groupBy("a").agg(merged.alias("near")).select("a", F.explode("near").alias("e")).select("a", "e.b", "e.d"), "graph")


def exact_neighbours(df: DataFrame, ids: list[int], vector: str = "features", key: str = "_row_id", k: int = NEIGHBOURS) -> DataFrame:
    """a, b, d of the stated rows by distances to all rows: to measure recall with. The stated rows go to every task, which gives k of its own for each."""
    rows = df.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    asked = sorted((r["id"], r["v"]) for r in rows.where(F.col("id").isin(ids)).collect())
    shared = df.sparkSession.sparkContext.broadcast((np.array([i for i, _ in asked], np.int64), np.array([v for _, v in asked], float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, x = shared.value
        best_b, best_d = np.zeros((len(own), 0), np.int64), np.zeros((len(own), 0))
        for batch in batches:
            if not (len(own) and batch.num_rows):
                continue
            order = np.argsort(batch.column(0).to_numpy(zero_copy_only=False), kind="stable")
            there, y = batch.column(0).to_numpy(zero_copy_only=False)[order], vectors_of(batch.column(1), batch.num_rows)[order]
            at = np.minimum(np.searchsorted(there, own), len(there) - 1)
            same = np.where(there[at] == own, at, -1)
            found = [nearest_places(x[i : i + AT_ONCE], y, k, same[i : i + AT_ONCE]) for i in range(0, len(own), AT_ONCE)]
            b, d = np.concatenate([best_b, there[np.concatenate([p for p, _ in found])]], 1), np.concatenate([best_d, np.concatenate([e for _, e in found])], 1)
            order = np.lexsort((b, d), axis=1)[:, :k]
            best_b, best_d = np.take_along_axis(b, order, 1), np.take_along_axis(d, order, 1)
        on = np.isfinite(best_d)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, on.sum(1))), pa.array(best_b[on]), pa.array(best_d[on])], names=["a", "b", "d"])

    w = Window.partitionBy("a").orderBy("d", "b")  # k rows a task
    return rows.mapInArrow(run, "a long, b long, d double").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def spectral_layout(graph: DataFrame, dims: int = 2, steps: int = 30, seed: int = 42) -> DataFrame:
    """id, xy (array of `dims`): leading directions of the lazy random walk on the graph, both ways of each edge, nearer ones heavier."""
    spread = graph.agg(F.avg("d").alias("s")).first()["s"] or 1.0
    weight = F.exp(-F.col("d") * F.col("d") / (2 * spread * spread))
    edges = graph.select("a", "b", weight.alias("w")).unionByName(graph.select(F.col("b").alias("a"), F.col("a").alias("b"), weight.alias("w")))
    # dealt by b once and kept: a step sends the rows' places to the edges, not the edges
    edges = edges.groupBy("a", "b").agg(F.max("w").alias("w")).repartition(int(graph.sparkSession.conf.get("spark.sql.shuffle.partitions")), "b").persist()
    degree = edges.groupBy("a").agg(F.sum("w").alias("g"))
    start = lambda i: F.xxhash64(F.lit(seed + i), "a") / F.lit(2.0**63)
    state = materialise(degree.select(F.col("a").alias("id"), "g", F.array(*[start(i) for i in range(dims)]).alias("x")), "layout")
    for step in range(steps):
        state = materialise(_orthogonal(state, dims), "layout")
        if step < steps - 1:
            moved = edges.join(state.select(F.col("id").alias("b"), "x"), "b").select("a", "w", *[(F.col("w") * F.col("x")[i]).alias(f"x{i}") for i in range(dims)]).groupBy("a").agg(*[F.sum(f"x{i}").alias(f"x{i}") for i in range(dims)])
            state = state.join(moved, state["id"] == moved["a"]).select("id", "g", F.array(*[(F.col("x")[i] + F.col(f"x{i}") / F.col("g")) / 2 for i in range(dims)]).alias("x"))
    edges.unpersist()
    return state.select("id", F.col("x").alias("xy"))


def _orthogonal(state: DataFrame, dims: int) -> DataFrame:
    """Directions without the constant, orthogonal and of length 1 where rows weigh as their degrees: from sums and products alone."""
    sums = state.agg(F.sum("g").alias("g"), *[F.sum(F.col("g") * F.col("x")[i]).alias(f"m{i}") for i in range(dims)], *[F.sum(F.col("g") * F.col("x")[i] * F.col("x")[j]).alias(f"p{i}_{j}") for i in range(dims) for j in range(i, dims)]).first()
    if not sums["g"]:
        return state
    mean = np.array([sums[f"m{i}"] for i in range(dims)]) / sums["g"]
    product = np.array([[sums[f"p{min(i, j)}_{max(i, j)}"] for j in range(dims)] for i in range(dims)]) - sums["g"] * np.outer(mean, mean)
    root = np.linalg.cholesky(product + 1e-300 * np.eye(dims) + 1e-12 * np.trace(product) * np.eye(dims))
    turn = np.linalg.inv(root)
    centred = [F.col("x")[i] - float(mean[i]) for i in range(dims)]
    return state.withColumn("x", F.array(*[sum((centred[j] * float(turn[i, j]) for j in range(i + 1)), F.lit(0.0)) for i in range(dims)]))
