"""K-Means of many starts at once: every pass over the data serves all numbers of clusters, seeds and samples together.

Vectors are packed once into blocks (a row holds some thousand of them). A pass gives each task's sums of rows for each centre of
each start; centres, some hundred numbers each, are all that reaches the driver. A start may be fitted on a sample by hash: a row
belongs to it by its own id, so stability over many samples costs no further pass. First centres are drawn by squared distance
from a bounded sample (SEEDING rows by hash) and moved on it until they rest, then on a larger one (MIDDLE rows, a task a start); the
fit goes on from there over all rows, until it rests there too.

Defined cases: rows with a null vector take no part; a centre without rows stays where it is; fewer distinct rows than centres give
equal centres; an empty table gives no centres and the cost 0.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialise

BLOCK, SEEDING, ITERATIONS, TOLERANCE = 4096, 4096, 300, 1e-4
#: Blocks a file: Spark's reader unpacks up to 4,096 rows of a file at once, and a block is a row of about a MB.
BLOCKS_A_FILE = 16
#: Passes of refits on samples, at most.
REFIT_PASSES = 50
#: Rows of the sample that a task moves a start's centres on before all rows are passed over, and how many times as many rows a table
#: must have for that.
MIDDLE, TIMES = 131_072, 2


@dataclass
class Start:
    """One fit: k centres, a seed, the rows it sees (thousandths, by hash), and a weight for each dimension."""

    k: int
    seed: int = 42
    share: int = 1000
    scale: np.ndarray | None = field(default=None, repr=False)
    centers: np.ndarray | None = field(default=None, repr=False)
    cost: float = 0.0
    done: bool = False

    def light(self) -> Start:
        """What tasks need of it."""
        return Start(self.k, self.seed, self.share, self.scale, self.centers)

    def rows(self, ids: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The rows it sees, weighted."""
        own = x if self.share >= 1000 else x[sampled(ids, self)]
        return own if self.scale is None else own * self.scale


def packed(df: DataFrame, vector: str = "features", key: str | None = None, label: str | None = None) -> DataFrame:
    """Blocks of rows: ids (hashes of the key, or of the vector), labels (whole numbers) and vectors as bytes."""
    ids = F.xxhash64(key) if key else F.xxhash64(vector)
    rows = df.where(F.col(vector).isNotNull()).select(ids.alias("id"), (F.col(label).cast("long") if label else F.lit(0).cast("long")).alias("label"), F.col(vector).cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = part.column(2).flatten().to_numpy(zero_copy_only=False)
                cells = [part.column(0).to_numpy(zero_copy_only=False).tobytes(), part.column(1).to_numpy(zero_copy_only=False).tobytes(), x.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells] + [pa.array([part.num_rows], pa.int32())], names=["ids", "labels", "x", "n"])

    return materialise(rows.mapInArrow(run, "ids binary, labels binary, x binary, n int"), "blocks", BLOCKS_A_FILE)


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, vectors) of each block."""
    for batch in batches:
        for ids, labels, x, n in zip(*(batch.column(i).to_pylist() for i in range(4))):
            yield np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64), np.frombuffer(x, np.float64).reshape(n, -1)


def mixed(ids: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each id and the seed."""
    h = ids.view(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def sampled(ids: np.ndarray, start: Start) -> np.ndarray:
    """Which rows a start sees: a mix of the id and the seed, the same in every pass."""
    if start.share >= 1000:
        return np.ones(len(ids), bool)
    return mixed(ids, start.seed) % np.uint64(1000) < start.share


def nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centre, squared distance to it); ties go to the first centre."""
    d = (x * x).sum(1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(1)
    at = d.argmin(1)
    return at, np.maximum(d[np.arange(len(x)), at], 0.0)


def _seeded(x: np.ndarray, start: Start) -> np.ndarray:
    """k rows, each drawn in proportion to its squared distance from those before; the best of some draws is taken."""
    rnd = np.random.default_rng(start.seed)
    picked = [x[rnd.integers(len(x))]]
    far = ((x - picked[0]) ** 2).sum(1)
    for _ in range(start.k - 1):
        total = far.sum()
        tries = rnd.choice(len(x), 2 + int(np.log(start.k)), p=far / total) if total > 0 else rnd.integers(len(x), size=1)
        options = [np.minimum(far, ((x - x[t]) ** 2).sum(1)) for t in tries]
        best = min(range(len(tries)), key=lambda i: options[i].sum())
        picked.append(x[tries[best]])
        far = options[best]
    return np.array(picked)


class Sums:
    """(rows, sums, cost) of every start's centres. Starts of one weighting are held against a block by one product of matrices, and
    their sums are another; a row counts for a start that sees it."""

    def __init__(self, starts: list[Start]):
        groups: dict[int, list[int]] = {}
        for i, s in enumerate(starts):
            groups.setdefault(id(s.scale), []).append(i)
        self.starts, self.groups = starts, [(g, np.concatenate([starts[i].centers for i in g])) for g in groups.values()]
        self.total = [(np.zeros(len(c)), np.zeros_like(c), np.zeros(len(g))) for g, c in self.groups]

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        seen: dict[tuple[int, int], np.ndarray] = {}
        for (group, centers), (n, sums, costs) in zip(self.groups, self.total):
            scale = self.starts[group[0]].scale
            v = x if scale is None else x * scale
            own, places = (v * v).sum(1), np.arange(len(v))
            d = (centers * centers).sum(1)[:, None] - 2 * (centers @ v.T)
            of, first = np.zeros_like(d), 0
            for g, i in enumerate(group):
                s = self.starts[i]
                least, at = d[first].copy(), np.full(len(v), first)
                for j in range(first + 1, first + s.k):  # the first of equal ones
                    at[d[j] < least] = j
                    np.minimum(least, d[j], out=least)
                cost = np.maximum(least + own, 0.0)
                if s.share < 1000:
                    if (s.seed, s.share) not in seen:
                        seen[s.seed, s.share] = sampled(ids, s).astype(float)
                    mask = seen[s.seed, s.share]
                    of[at, places] = mask
                    costs[g] += (cost * mask).sum()
                else:
                    of[at, places] = 1.0
                    costs[g] += cost.sum()
                first += s.k
            n += of.sum(1)
            sums += of @ v

    def parts(self) -> list[tuple[np.ndarray, np.ndarray, float]]:
        """In the order of the starts."""
        out: list = [None] * len(self.starts)
        for (group, _), (n, sums, costs) in zip(self.groups, self.total):
            first = 0
            for g, i in enumerate(group):
                k = self.starts[i].k
                out[i] = (n[first : first + k], sums[first : first + k], float(costs[g]))
                first += k
        return out


def _sums(blocks: DataFrame, starts: list[Start]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """(rows, sums, cost) of every start's centres over all blocks, in one pass."""
    shared = blocks.sparkSession.sparkContext.broadcast([s.light() for s in starts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Sums(shared.value)
        for ids, _, x in unpacked(batches):
            total.add(ids, x)
        flat = np.concatenate([np.concatenate([n, m.ravel(), [c]]) for n, m, c in total.parts()])
        yield pa.RecordBatch.from_arrays([pa.array([flat], pa.list_(pa.float64()))], names=["s"])

    got = blocks.mapInArrow(run, "s array<double>").select(F.posexplode("s").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
    flat = np.zeros(sum(s.k * (1 + s.centers.shape[1]) + 1 for s in starts))
    for r in got:
        flat[r["i"]] = r["x"]
    shared.unpersist()
    out, at = [], 0
    for s in starts:
        k, d = s.centers.shape
        out.append((flat[at : at + k], flat[at + k : at + k + k * d].reshape(k, d), float(flat[at + k + k * d])))
        at += k + k * d + 1
    return out


def hashed_rows(blocks: DataFrame, most: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of about `most` rows, those of the least hash, by hash; picked within tasks and sent as bytes."""
    n = blocks.agg(F.sum("n")).first()[0] or 0
    limit = (1 << 64) - 1 if n <= most else int(2 * most / n * (1 << 64)) if n > 2 * most else (1 << 64) - 1

    def run(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
        own, rows = np.zeros(0, np.int64), None
        for ids, _, x in unpacked(batches):
            on = mixed(ids, seed) <= np.uint64(limit)
            own, rows = np.concatenate([own, ids[on]]), x[on] if rows is None else np.concatenate([rows, x[on]])
            if len(own) > 2 * most:
                low = np.argsort(mixed(own, seed), kind="stable")[:most]
                own, rows = own[low], rows[low]
        if len(own):
            low = np.argsort(mixed(own, seed), kind="stable")[:most]
            yield pa.RecordBatch.from_arrays([pa.array([own[low].tobytes()], pa.binary()), pa.array([rows[low].tobytes()], pa.binary())], names=["ids", "x"])

    for bound in dict.fromkeys((limit, (1 << 64) - 1)):  # equal rows may all miss the bound
        got = blocks.mapInArrow(lambda b, bound=bound: run(b, bound), "ids binary, x binary").collect()
        if got:
            break
    if not got:
        return np.zeros(0, np.int64), np.zeros(0)
    ids = np.concatenate([np.frombuffer(r["ids"], np.int64) for r in got])
    x = np.concatenate([np.frombuffer(r["x"], np.float64) for r in got]).reshape(len(ids), -1)
    low = np.lexsort((*x.T[::-1], mixed(ids, seed)))[:most]
    return ids[low], x[low]


def row_sample(blocks: DataFrame, most: int = SEEDING, seed: int = 7) -> np.ndarray:
    """Vectors of about `most` rows, those of the least hash."""
    return hashed_rows(blocks, most, seed)[1]


def middle(blocks: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """The sample of MIDDLE rows; None where all rows are few."""
    n = blocks.agg(F.sum("n")).first()[0] or 0
    return hashed_rows(blocks, MIDDLE) if n > TIMES * MIDDLE else None


def settled(spark, sample: tuple[np.ndarray, np.ndarray], starts: list[Start], limits: list[float], passes: int = ITERATIONS) -> None:
    """Moves the centres of each start on the rows of the sample that it sees, a task a start."""
    shared = spark.sparkContext.broadcast((*sample, [s.light() for s in starts], limits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                ids, x, here, most = shared.value
                s = here[i]
                x = s.rows(ids, x)
                if len(x):
                    one = Start(s.k, s.seed, 1000, None, s.centers)
                    refined(x, [one], [most[i]], passes)
                    s = one
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([s.centers.tobytes()], pa.binary())], names=["i", "c"])

    for r in spark.range(0, len(starts), 1, max(1, len(starts))).mapInArrow(run, "i long, c binary").collect():
        s = starts[r["i"]]
        s.centers = np.frombuffer(r["c"], np.float64).reshape(s.centers.shape)
    shared.unpersist()


def refined(sample: np.ndarray, starts: list[Start], limits: list[float], passes: int = 100) -> None:
    """Moves centres on the sample, so that the passes over all rows begin near their end."""
    open_, ids = list(zip(starts, limits)), np.zeros(len(sample), np.int64)
    for _ in range(passes):
        if not open_:
            break
        whole = [Start(s.k, s.seed, 1000, s.scale, s.centers) for s, _ in open_]
        total = Sums(whole)
        total.add(ids, sample)
        still = []
        for (s, most), (n, sums, _) in zip(open_, total.parts()):
            moved = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], s.centers)
            if ((moved - s.centers) ** 2).sum() > most:
                still.append((s, most))
            s.centers = moved
        open_ = still


def fit(blocks: DataFrame, starts: Sequence[Start], iterations: int = ITERATIONS, tolerance: float = TOLERANCE) -> list[Start]:
    """The starts with centres and costs. A start ends when its centres move by less than the tolerance times the mean variance."""
    starts = list(starts)
    larger = middle(blocks) if starts else None
    sample = larger[1][:SEEDING] if larger is not None else row_sample(blocks) if starts else np.zeros(0)
    if not len(sample):
        return starts
    limit = []
    for s in starts:
        seen = sample if s.scale is None else sample * s.scale
        s.centers, s.done = _seeded(seen, s), False
        limit.append(tolerance * float(seen.var(0).mean()))
    refined(sample, starts, limit)
    if larger is not None:
        settled(blocks.sparkSession, larger, starts, limit)
    limits = dict(zip(map(id, starts), limit))
    for _ in range(iterations):
        open_ = [s for s in starts if not s.done]
        if not open_:
            break
        for s, (n, sums, cost) in zip(open_, _sums(blocks, open_)):
            moved = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], s.centers)
            s.done, s.centers, s.cost = bool(((moved - s.centers) ** 2).sum() <= limits[id(s)]), moved, cost
    for s, (_, _, cost) in zip(starts, _sums(blocks, starts)):  # the cost of the last centres
        s.cost = cost
    return starts


def best_of(starts: Sequence[Start]) -> dict[int, Start]:
    """k -> the start of least cost."""
    out: dict[int, Start] = {}
    for s in starts:
        if s.k not in out or s.cost < out[s.k].cost:
            out[s.k] = s
    return out


def ordered(centers: np.ndarray) -> list[list[float]]:
    """Centres in a canonical order."""
    return sorted([float(v) for v in c] for c in centers)


def measures(blocks: DataFrame, starts: Sequence[Start]) -> list[dict]:
    """sizes, inertia, davies_bouldin and calinski_harabasz of each start's clusters, in two passes for all: means, then distances to them.
    Both indices are null where there are under two clusters."""
    means = []
    for s, (n, sums, _) in zip(starts, _sums(blocks, list(starts))):
        means.append(np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], s.centers))
    shared = blocks.sparkSession.sparkContext.broadcast([(s.light(), m) for s, m in zip(starts, means)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((3, s.k)) for s, _ in shared.value]
        for ids, _, x in unpacked(batches):
            for t, (s, m) in zip(total, shared.value):
                own = s.rows(ids, x)
                if len(own):
                    at, _ = nearest(own, s.centers)
                    d = ((own - m[at]) ** 2).sum(1)
                    for i, v in enumerate((np.ones(len(d)), np.sqrt(d), d)):
                        t[i] += np.bincount(at, v, s.k)
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([t.ravel() for t in total]).tolist()], pa.list_(pa.float64()))], names=["s"])

    got = blocks.mapInArrow(run, "s array<double>").select(F.posexplode("s").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
    shared.unpersist()
    flat, at, out = np.zeros(sum(3 * s.k for s in starts)), 0, []
    for r in got:
        flat[r["i"]] = r["x"]
    for s, m in zip(starts, means):
        n, far, within = flat[at : at + 3 * s.k].reshape(3, s.k)
        at += 3 * s.k
        on = n > 0
        n, m, spread, inner = n[on], m[on], (far[on] / n[on]), within.sum()
        one = {"k": s.k, "inertia": s.cost, "sizes": n.astype(int).tolist(), "davies_bouldin": None, "calinski_harabasz": None}
        if len(n) > 1:
            apart = np.sqrt(((m[:, None] - m) ** 2).sum(2))
            ratio = np.divide(spread[:, None] + spread, apart, out=np.zeros_like(apart), where=apart > 0)
            np.fill_diagonal(ratio, 0.0)
            middle = (n[:, None] * m).sum(0) / n.sum()
            between = (n * ((m - middle) ** 2).sum(1)).sum()
            one |= {"davies_bouldin": float(ratio.max(1).mean()), "calinski_harabasz": float(between / (len(n) - 1) / (inner / (n.sum() - len(n)))) if inner > 0 and n.sum() > len(n) else None}
        out.append(one)
    return out


def silhouette_of(x: np.ndarray, label: np.ndarray) -> float | None:
    """Mean silhouette of a bounded sample; noise (-1) is left out, a row alone in its cluster has 0."""
    x, label = x[label >= 0], label[label >= 0]
    names, label = np.unique(label, return_inverse=True)
    if len(names) < 2:
        return None
    one = np.eye(len(names))[label]
    n, total = one.sum(0), np.zeros(len(x))
    for at in range(0, len(x), 512):
        part = slice(at, at + 512)
        d = np.sqrt(np.maximum((x[part] ** 2).sum(1)[:, None] + (x**2).sum(1) - 2 * x[part] @ x.T, 0.0))
        d[np.arange(len(d)), np.arange(at, at + len(d))] = 0.0
        sums, own = d @ one, label[part]
        rows = np.arange(len(d))
        a = sums[rows, own] / np.maximum(n[own] - 1, 1)
        other = sums / n
        other[rows, own] = np.inf
        b = other.min(1)
        total[part] = np.where((n[own] > 1) & (np.maximum(a, b) > 0), (b - a) / np.where(np.maximum(a, b) > 0, np.maximum(a, b), 1), 0.0)
    return float(total.mean())


def silhouettes(spark, x: np.ndarray, labels: Sequence[tuple[np.ndarray, np.ndarray | None]]) -> list[float | None]:
    """Silhouette of each (labels, weights of the dimensions) over one bounded sample; one task each."""
    shared = spark.sparkContext.broadcast((x, list(labels)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                v, (label, scale) = shared.value[0], shared.value[1][i]
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([silhouette_of(v if scale is None else v * scale, label)], pa.float64())], names=["i", "s"])

    got = {r["i"]: r["s"] for r in spark.range(0, len(labels), 1, max(1, len(labels))).mapInArrow(run, "i long, s double").collect()}
    shared.unpersist()
    return [got[i] for i in range(len(labels))]


def contingency(blocks: DataFrame, whole: np.ndarray | None, starts: Sequence[Start]) -> list[dict[tuple[int, int], int]]:
    """For each start: (cluster of the whole fit or label of the row, cluster of the start) -> rows the start sees. One pass."""
    shared = blocks.sparkSession.sparkContext.broadcast([s.light() for s in starts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int, int], int] = {}
        for ids, labels, x in unpacked(batches):
            a = nearest(x, whole)[0] if whole is not None else labels
            for i, s in enumerate(shared.value):
                cells, counts = np.unique(np.column_stack([a[sampled(ids, s)], nearest(s.rows(ids, x), s.centers)[0]]), axis=0, return_counts=True)
                for (p, q), c in zip(cells.tolist(), counts.tolist()):
                    total[i, p, q] = total.get((i, p, q), 0) + c
        rows = [(*k, n) for k, n in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(4)], names=["i", "a", "b", "n"])

    out: list[dict[tuple[int, int], int]] = [{} for _ in starts]
    for r in blocks.mapInArrow(run, "i long, a long, b long, n long").groupBy("i", "a", "b").agg(F.sum("n").alias("n")).collect():  # k x k cells a start
        out[r["i"]][r["a"], r["b"]] = r["n"]
    shared.unpersist()
    return out


def rand_index(cells: dict[tuple[int, int], int]) -> float:
    """Adjusted agreement of two partitions from their contingency; equal trivial partitions agree fully."""
    pairs = lambda xs: sum(n * (n - 1) / 2 for n in xs)
    rows, columns = {}, {}
    for (a, b), n in cells.items():
        rows[a], columns[b] = rows.get(a, 0) + n, columns.get(b, 0) + n
    total = pairs([sum(cells.values())])
    both, r, c = pairs(cells.values()), pairs(rows.values()), pairs(columns.values())
    expected = r * c / total if total else 0.0
    spread = (r + c) / 2 - expected
    return (both - expected) / spread if spread else 1.0


def stability(blocks: DataFrame, whole: dict[int, np.ndarray], rounds: int = 20, share: int = 800, seed: int = 42) -> dict[int, tuple[float, float]]:
    """k -> (mean, population deviation) of the agreement of refits on samples with the whole fit's clusters; all refits of all k at once."""
    starts = fit(blocks, [Start(k, seed + r, share) for k in whole for r in range(rounds)], REFIT_PASSES)
    out = {}
    for k, centers in whole.items():
        own = [s for s in starts if s.k == k]
        scores = np.array([rand_index(c) for c in contingency(blocks, centers, own)])
        out[k] = (float(scores.mean()), float(scores.std()))
    return out
