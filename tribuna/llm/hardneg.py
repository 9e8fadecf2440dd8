"""Hard-negative mining by a vector-approximation file.

Every component becomes a whole number and every dimension is quantised into cells: inner edges are quantiles of a bounded sample
(SAMPLE rows by hash), outer edges the extremes over all rows, so every row's code tells in which interval each of its components
lies. For an anchor, two tables give the least and the greatest product of its component with any value of a cell; their sums over
the dimensions, looked up by code, bound the score of a row from below and above. Only rows whose bounds may reach what is sought
are scored exactly.

Anchors (every hundredth id) are held against all rows in blocks: a grid of blocks of rows and blocks of anchors, each cell of which is one
bounded task. First the positives: the best rows of the anchor's label. Then each positive's score opens a window of scores, and
the best rows of other labels within the windows are the negatives. A cell gives at most as many rows for each anchor, or window,
as are sought; a ranking over the cells follows.

Defined cases: rows with a null label, a null or empty vector, or a null or non-finite component take no part; a vector shorter
than the longest counts as filled up with zeros; numbers beyond 2^27 in size are taken as that, so scores fit a long; a null id is no anchor and
comes after all ids among equal scores; rows that are equal in everything are rows of their own (an anchor leaves out itself only);
an anchor without a positive, or a window without a row, gives nothing; columns other than the three are not read; an empty table
gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import materialise

#: Every so many ids are anchors; positives of an anchor, negatives of a positive, and the window's shares of its score in percent.
EVERY, POSITIVES, NEGATIVES, LOW, HIGH = 100, 5, 10, 30, 90
CELLS, SAMPLE, SCALE, MOST = 64, 4096, 256, 1 << 27
BLOCK_ROWS, BLOCK_ANCHORS = 4096, 1024
#: Anchors whose bounds are computed at once.
STEP = 64
NO_ID = np.iinfo(np.int64).max


def prepared(vectors: DataFrame) -> DataFrame:
    """row, vec_id, id and has_id (an id without nulls, for tasks), label, q (whole numbers) of the rows that take part."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    bad = F.exists(F.col("x"), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = F.transform("x", lambda v: F.greatest(F.least(F.floor(F.greatest(F.least(v, F.lit(2.0**40)), F.lit(-(2.0**40))) * SCALE), F.lit(MOST)), F.lit(-MOST)).cast("int"))
    df = vectors.select("vec_id", F.col("label").cast("long").alias("label"), x.alias("x")).where("label IS NOT NULL AND x IS NOT NULL AND size(x) > 0").where(~F.coalesce(bad, F.lit(False)))
    return df.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("id"), F.col("vec_id").isNotNull().alias("has_id"), "label", whole.alias("q"))


def folded_labels(vectors: DataFrame) -> DataFrame:
    """The query's labels: where the id is divisible by 7, (label + 1) % 10."""
    return vectors.select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))


def cell_edges(rows: DataFrame, cells: int = CELLS, sample: int = SAMPLE) -> np.ndarray:
    """(dimensions, cells + 1) edges: cell c holds values from edge c up to edge c + 1, both included in its bounds."""
    dims = rows.agg(F.max(F.size("q")).alias("d")).first()["d"]
    if not dims:
        return np.zeros((0, cells + 1), np.int64)
    at = F.posexplode(F.concat("q", F.array_repeat(F.lit(0), F.lit(dims) - F.size("q"))))
    ends = {r["pos"]: (r["lo"], r["hi"]) for r in rows.select(at).groupBy("pos").agg(F.min("col").alias("lo"), F.max("col").alias("hi")).collect()}  # a row a dimension
    some = rows.orderBy(F.xxhash64("vec_id", "label", "q")).limit(sample).select("q").collect()
    m = np.zeros((len(some), dims), np.int64)
    for i, r in enumerate(some):
        m[i, : len(r["q"])] = r["q"]
    inner = np.floor(np.quantile(m, np.arange(1, cells) / cells, axis=0)).astype(np.int64).T
    return np.column_stack([[ends[d][0] for d in range(dims)], np.maximum.accumulate(inner, axis=1), [ends[d][1] for d in range(dims)]])


def codes(q: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Cell of each component: the number of inner edges up to it."""
    out = np.empty(q.shape, np.uint8)
    for d in range(q.shape[1]):
        out[:, d] = np.searchsorted(edges[d, 1:-1], q[:, d], side="right")
    return out


def approximated(rows: DataFrame, edges) -> DataFrame:
    """rows and `code`, their approximation: a byte a dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = edges.value
        for batch in batches:
            code = codes(padded(batch.column(batch.schema.get_field_index("q")).to_pylist(), len(e)), e)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in code], pa.binary())], names=[*batch.schema.names, "code"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("code", BinaryType())]))


def bounds(anchors: np.ndarray, code: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) scores of anchors against coded rows, by table lookup; exact whole numbers."""
    kind = np.int32 if int(np.abs(anchors).max(initial=0)) * int(np.abs(edges).max(initial=0)) * max(1, len(edges)) < 2**31 else np.int64
    low, high = (np.zeros((len(anchors), len(code)), kind) for _ in range(2))
    a, e = anchors.astype(kind), edges.astype(kind)
    for d in range(len(edges)):
        one, two = a[:, d, None] * e[d, :-1], a[:, d, None] * e[d, 1:]
        low += np.minimum(one, two)[:, code[:, d]]
        high += np.maximum(one, two)[:, code[:, d]]
    return low, high


def exact(a: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Scores of one anchor against rows."""
    return q @ a


def best(score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the best rows: score descending, id ascending."""
    return np.lexsort((ids, -score))[:most]


class Block:
    """Rows of one block, sorted by label."""

    def __init__(self, pdf: pd.DataFrame, edges: np.ndarray):
        order = np.argsort(pdf["label"].to_numpy(), kind="stable")
        self.label, self.row = pdf["label"].to_numpy()[order], pdf["row"].to_numpy()[order]
        self.ids, self.has_id = pdf["id"].to_numpy()[order], pdf["has_id"].to_numpy()[order]
        self.q = padded(pdf["q"].to_numpy()[order], len(edges))
        self.code = np.frombuffer(b"".join(pdf["code"].to_numpy()[order]), np.uint8).reshape(len(order), len(edges))

    def span(self, label: int) -> slice:
        return slice(*np.searchsorted(self.label, [label, label + 1]))


def padded(vectors: Sequence, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def top_of_label(block: Block, rows: np.ndarray, label: int, q: np.ndarray, edges: np.ndarray, most: int) -> Iterator[tuple]:
    """(anchor's place, row's place, score): an anchor's best rows of its label in this block."""
    own = block.span(label)
    low, high = bounds(q, block.code[own], edges)
    for i, row in enumerate(rows):
        other = block.row[own] != row
        lo, hi = low[i][other], high[i][other]
        if not len(lo):
            continue
        # the `most` greatest lower bounds are reached: nothing whose upper bound is less can be among the best
        bar = np.partition(lo, len(lo) - most)[len(lo) - most] if len(lo) > most else lo.min()
        at = np.flatnonzero(other)[hi >= bar] + own.start
        score = exact(q[i], block.q[at])
        for j in best(score, block.ids[at], most):
            yield i, at[j], score[j]


def in_windows(block: Block, label: int, q: np.ndarray, windows: list[list[tuple]], edges: np.ndarray, low_share: int, high_share: int, most: int) -> Iterator[tuple]:
    """(anchor's place, window's place, row's place, score): the best rows of other labels in each window of an anchor's scores."""
    own = block.span(label)
    for part in (slice(0, own.start), slice(own.stop, len(block.label))):
        low, high = bounds(q, block.code[part], edges)
        ids = block.ids[part]
        for i, of in enumerate(windows):
            score, known = np.zeros(low.shape[1], np.int64), np.zeros(low.shape[1], bool)
            lo, hi = low[i].astype(np.int64), high[i].astype(np.int64)
            for k, positive in enumerate(of):
                least, greatest = -(-low_share * positive // 100), high_share * positive // 100
                if least > greatest:
                    continue
                may = (hi >= least) & (lo <= greatest)
                sure = np.sort(lo[may & (lo >= least) & (hi <= greatest)])
                if len(sure) >= most:  # so many lie in the window for certain and reach this bound
                    may &= hi >= sure[-most]
                at = np.flatnonzero(may)
                new = at[~known[at]]
                score[new], known[new] = exact(q[i], block.q[part][new]), True
                at = at[(score[at] >= least) & (score[at] <= greatest)]
                for j in best(score[at], ids[at], most):
                    yield i, k, at[j] + part.start, score[at[j]]


def _grid(rows: DataFrame, anchors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows and anchors with the cell (rows' block, anchors' block) of the grid in which they meet; each cell is bounded."""
    n, m = rows.count(), anchors.count()
    parallel = rows.sparkSession.sparkContext.defaultParallelism
    over, under = max(1, math.ceil(n / BLOCK_ROWS), min(2 * parallel, n // 256)), max(1, math.ceil(m / BLOCK_ANCHORS))
    block = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    rows = rows.select("row", "id", "has_id", "label", "q", "code")
    return rows.withColumn("rb", block("row", over)).withColumn("ab", every(under)), anchors.withColumn("ab", block("row", under)).withColumn("rb", every(over))


def positives(rows: DataFrame, anchors: DataFrame, edges, most: int = POSITIVES) -> DataFrame:
    """anchor (row), anchor_id, label, q, positive_id, positive_score, place (from 1)."""

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            e = edges.value
            block = Block(left, e)
            for label, group in right.groupby("label"):
                for at in range(0, len(group), STEP):
                    g = group.iloc[at : at + STEP]
                    names = g["row"].to_numpy()
                    out += [(names[i], block.ids[j], block.has_id[j], block.row[j], s) for i, j, s in top_of_label(block, names, label, padded(g["q"].to_numpy(), len(e)), e, most)]
        return pd.DataFrame(out, columns=["anchor", "id", "has_id", "row", "score"])

    a, b = _grid(rows, anchors)
    found = a.groupBy("rb", "ab").cogroup(b.groupBy("rb", "ab")).applyInPandas(cell, "anchor long, id long, has_id boolean, row long, score long")
    w = Window.partitionBy("anchor").orderBy(F.desc("score"), "id", "row")
    top = found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    own = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"), "label", "q")
    return own.join(top, "anchor").select("anchor", "anchor_id", "label", "q", F.when(F.col("has_id"), F.col("id")).alias("positive_id"), F.col("score").alias("positive_score"), "place")


def negatives(rows: DataFrame, found: DataFrame, edges, low: int = LOW, high: int = HIGH, most: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            e = edges.value
            block = Block(left, e)
            for label, group in right.groupby("label"):
                for at in range(0, len(group), STEP):
                    g = group.iloc[at : at + STEP]
                    names, windows = g["row"].to_numpy(), [list(x) for x in g["scores"]]
                    out += [(names[i], k + 1, block.ids[j], block.has_id[j], block.row[j], s) for i, k, j, s in in_windows(block, label, padded(g["q"].to_numpy(), len(e)), windows, e, low, high, most)]
        return pd.DataFrame(out, columns=["anchor", "place", "id", "has_id", "row", "score"])

    windows = found.groupBy("anchor").agg(F.any_value("label").alias("label"), F.any_value("q").alias("q"), F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda x: x["positive_score"]).alias("scores"))  # at most `positives` each
    a, b = _grid(rows, windows.withColumnRenamed("anchor", "row"))
    near = a.groupBy("rb", "ab").cogroup(b.groupBy("rb", "ab")).applyInPandas(cell, "anchor long, place int, id long, has_id boolean, row long, score long")
    w = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "id", "row")
    top = near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    ids = found.select("anchor", "place", "anchor_id", "positive_id", "positive_score")
    return top.join(ids, ["anchor", "place"]).select("anchor_id", "positive_id", "rank", F.when(F.col("has_id"), F.col("id")).alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mine(vectors: DataFrame, every: int = EVERY, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """Hard negatives of vectors (vec_id, label, embedding). Anchors are the rows whose id is divisible by `every`."""
    whole = materialise(prepared(vectors), "vectors")
    edges = vectors.sparkSession.sparkContext.broadcast(cell_edges(whole))  # dimensions x cells numbers
    rows = materialise(approximated(whole, edges), "approximations")
    anchors = rows.where(F.col("vec_id") % every == 0).drop("code")
    found = materialise(positives(rows, anchors, edges, n_positives), "positives")
    return negatives(rows, found, edges, low, high, n_negatives)


def hard_negatives_query(vectors: DataFrame) -> DataFrame:
    return mine(folded_labels(vectors))


_SCORE = "CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT)"
#: The same by scoring every row.
ORACLE_SQL = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
 WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, {_SCORE} AS score FROM (SELECT * FROM v WHERE vec_id % {EVERY} = 0) a, v b WHERE a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INT) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score QUALIFY rank <= {NEGATIVES}"""
