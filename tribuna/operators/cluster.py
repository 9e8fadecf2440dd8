"""Fits and inference: K-Means over several seeds, diagonal mixture, choice of k, one-to-one labels, two-stage pipeline."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import permutations

import numpy as np
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, token_coverage
from . import lloyd, mixture, prototypes
from .metrics import SILHOUETTE_ROWS, calinski_harabasz, davies_bouldin, elbow_scores, hash_sample, silhouette, squared_distance
from .relative import split_flag
from .space import Space, fit_space, with_features

BORDER, LITTLE_TEXT = 0.15, 0.20
SINGLE = "Admisión Única / Tarifa Plana"
#: Ideal profiles of the archetypes, by feature.
PROFILES = {
    "VIP / Palcos / Premium": {"ratio_precio_max": 0.90, "percentil_precio_evento": 0.85, "peso_aforo": 0.08, "percentil_precio_absoluto_dentro_tipo": 0.90, "tag_palco": 0.6, "tag_vip": 0.4, "tfidf_palco": 0.5, "tfidf_mesa": 0.3},
    "Preferencial / Platea Frontal": {"ratio_precio_max": 0.85, "percentil_precio_evento": 0.82, "peso_aforo": 0.10, "percentil_precio_absoluto_dentro_tipo": 0.82, "tag_platea": 0.8, "tag_preferencial": 0.3, "tfidf_platea": 0.5, "tfidf_central": 0.3},
    "Platea General / Intermedia": {"ratio_precio_max": 0.80, "percentil_precio_evento": 0.70, "peso_aforo": 0.35, "percentil_precio_absoluto_dentro_tipo": 0.65, "tag_platea": 0.4, "tfidf_platea": 0.3},
    "Grada General / Masiva": {"ratio_precio_max": 0.75, "percentil_precio_evento": 0.60, "peso_aforo": 0.75, "percentil_precio_absoluto_dentro_tipo": 0.50, "tag_general": 0.6, "tfidf_general": 0.5},
    "Popular / Balcón / Visibilidad Parcial": {"ratio_precio_max": 0.35, "percentil_precio_evento": 0.30, "peso_aforo": 0.12, "percentil_precio_absoluto_dentro_tipo": 0.30, "tag_balcon": 0.4, "tag_piso_alto": 0.4, "tfidf_balcon": 0.4, "tfidf_piso": 0.3, "tfidf_posterior": 0.3},
}
PROFILES_4 = {
    "VIP / Palcos / Premium": {"ratio_precio_max": 0.90, "percentil_precio_evento": 0.85, "peso_aforo": 0.08, "percentil_precio_absoluto_dentro_tipo": 0.90, "tag_palco": 0.6, "tag_vip": 0.4, "tfidf_palco": 0.5, "tfidf_mesa": 0.3},
    "Preferencial / Platea Frontal": {"ratio_precio_max": 0.80, "percentil_precio_evento": 0.75, "peso_aforo": 0.20, "percentil_precio_absoluto_dentro_tipo": 0.80, "tag_platea": 0.8, "tag_preferencial": 0.3, "tfidf_platea": 0.5, "tfidf_central": 0.3},
    "Popular / Visibilidad Parcial / Balcón": {"ratio_precio_max": 0.35, "percentil_precio_evento": 0.30, "peso_aforo": 0.15, "percentil_precio_absoluto_dentro_tipo": 0.30, "tag_balcon": 0.4, "tag_piso_alto": 0.4, "tfidf_balcon": 0.4, "tfidf_piso": 0.3, "tfidf_posterior": 0.3},
    "Grada General / Masiva": {"ratio_precio_max": 0.60, "percentil_precio_evento": 0.50, "peso_aforo": 0.60, "percentil_precio_absoluto_dentro_tipo": 0.50, "tag_general": 0.6, "tfidf_general": 0.5},
}


@dataclass
class Model:
    """A fitted two-stage model; small enough to be saved as one JSON row."""

    space: Space
    centers: list[list[float]]
    labels: list[str]
    weights: list[float] = field(default_factory=list)
    means: list[list[float]] = field(default_factory=list)
    variances: list[list[float]] = field(default_factory=list)
    version: str = "1"


#: Seeds of a fit, as many as the usual number of starts.
SEEDS = tuple(range(42, 52))


def fit_kmeans(df: DataFrame, k: int, vector: str = "features", seeds: Sequence[int] = SEEDS, iterations: int = lloyd.ITERATIONS, blocks: DataFrame | None = None) -> tuple[list[list[float]], float]:
    """(centres in a canonical order, inertia) of the best of several seeded fits, which share every pass over the data (df's packed
    blocks, where these are given)."""
    best = lloyd.best_of(lloyd.fit(blocks if blocks is not None else lloyd.packed(df, vector), [lloyd.Start(k, s) for s in seeds], iterations))[k]
    return (lloyd.ordered(best.centers) if best.centers is not None else []), best.cost


def bic(log_likelihood: float, n: int, k: int, d: int) -> float:
    """Of a full-covariance mixture."""
    return (k - 1 + k * d + k * d * (d + 1) / 2) * math.log(n) - 2 * log_likelihood


def nearest_two(df: DataFrame, centers: Sequence[Sequence[float]], vector: str = "features") -> DataFrame:
    """Adds cluster, second, d1, d2 and the margin (d2 - d1) / (d2 + 1e-9). Centres ride along as one array, not k x d terms."""
    all_ = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centers])
    d = F.transform(all_, lambda c, i: F.struct(F.sqrt(squared_distance(F.col(vector), c)).alias("d"), i.alias("i")))
    df = df.withColumn("_near", F.slice(F.array_sort(d), 1, 2))
    df = df.withColumn("cluster", F.col("_near")[0]["i"]).withColumn("second", F.get("_near", F.lit(1))["i"])
    df = df.withColumn("d1", F.col("_near")[0]["d"]).withColumn("d2", F.get("_near", F.lit(1))["d"]).drop("_near")
    return df.withColumn("margin", (F.col("d2") - F.col("d1")) / (F.col("d2") + 1e-9))


def choose_k(df: DataFrame, ks: Sequence[int] = (3, 4, 5, 6, 7), vector: str = "features", seeds: Sequence[int] = SEEDS, blocks: DataFrame | None = None) -> tuple[int, list[dict]]:
    """(k of the best score, table of k, inertia, Davies-Bouldin, score). Fits and measures of all k share their passes."""
    blocks = blocks if blocks is not None else lloyd.packed(df, vector)
    best = lloyd.best_of(lloyd.fit(blocks, [lloyd.Start(k, s) for k in ks for s in seeds]))
    table = elbow_scores([(m["k"], m["inertia"], m["davies_bouldin"]) for m in lloyd.measures(blocks, list(best.values()))])
    return max(table, key=lambda r: (r["score"], -r["k"]))["k"], table


def sweep_kmeans(df: DataFrame, key: str, ks: Sequence[int] = (3, 4, 5, 6, 7), vector: str = "features", seeds: Sequence[int] = SEEDS) -> list[dict]:
    """k, inertia, silhouette (on its bounded sample), davies_bouldin, calinski_harabasz of each k."""
    blocks = lloyd.packed(df, vector)
    best = list(lloyd.best_of(lloyd.fit(blocks, [lloyd.Start(k, s) for k in ks for s in seeds])).values())
    x = np.array([r[0] for r in hash_sample(df.select(key, vector), SILHOUETTE_ROWS, key).select(F.col(vector).cast("array<double>")).collect()])
    silhouettes = lloyd.silhouettes(df.sparkSession, x, [(lloyd.nearest(x, s.centers)[0], None) for s in best])
    return [{"k": m["k"], "inertia": m["inertia"], "silhouette": s, "davies_bouldin": m["davies_bouldin"], "calinski_harabasz": m["calinski_harabasz"]} for m, s in zip(lloyd.measures(blocks, best), silhouettes)]


def validity(df: DataFrame, key: str, vector: str = "features", cluster: str = "cluster") -> dict[str, float]:
    """silhouette (on its bounded sample), davies_bouldin, calinski_harabasz of a partition; noise (-1) is left out."""
    x = df.where(F.col(cluster) >= 0).select(key, vector, cluster).persist()
    try:
        s = silhouette(x, cluster, key, vector).agg(F.sum(F.col("n") * F.col("silhouette")) / F.sum("n")).first()[0]
        return {"silhouette": s, "davies_bouldin": davies_bouldin(x, cluster, vector).first()[0], "calinski_harabasz": calinski_harabasz(x, cluster, vector).first()[0]}
    finally:
        x.unpersist()


def sweep_mixture(df: DataFrame, ks: Sequence[int] = (2, 3, 4), vector: str = "features", seed: int = 42) -> list[dict]:
    """k, log_likelihood, bic, aic of full-covariance mixtures."""
    data = df.select(array_to_vector(vector).alias("v")).persist()
    try:
        n, d, rows = data.count(), len(data.first()["v"]), []
        for k in ks:
            ll = GaussianMixture(k=k, seed=seed, featuresCol="v").fit(data).summary.logLikelihood
            parameters = k - 1 + k * d + k * d * (d + 1) / 2
            rows.append({"k": k, "log_likelihood": ll, "bic": bic(ll, n, k, d), "aic": 2 * parameters - 2 * ll})
    finally:
        data.unpersist()
    return rows


def ideal_profiles(space: Space, k: int = 5) -> dict[str, list[float]]:
    """Archetype -> its point in the scaled space."""
    out = {}
    for name, p in (PROFILES_4 if k == 4 else PROFILES).items():
        value = lambda f, p=p: (p.get(f, 0.0) - space.centers.get(f, 0.0)) / space.scales.get(f, 1.0) if f in space.numeric else p.get(f, 0.0) * (space.text_weight if f.startswith("tfidf_") else 1.0)
        out[name] = [value(f) for f in space.names]
    return out


def assign_one_to_one(cost: Sequence[Sequence[float]]) -> list[int]:
    """Row -> column of least total cost, each column once; rows beyond the columns get -1. At most ten rows and columns: a
    search over subsets of columns."""
    n, m = len(cost), len(cost[0]) if cost else 0
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    free = max(0, n - m)
    for i in range(n):
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (total, path) in best.items():
            options = [(j, cost[i][j]) for j in range(m) if not used >> j & 1]
            if path.count(-1) < free:
                options.append((-1, 0.0))
            for j, c in options:
                key = used | (1 << j) if j >= 0 else used
                if key not in step or total + c < step[key][0]:
                    step[key] = (total + c, [*path, j])
        best = step
    return min(best.values(), key=lambda x: x[0])[1] if best else []


def label_centers(centers: Sequence[Sequence[float]], space: Space) -> list[str]:
    """Name of each centre: the best one-to-one match with the profiles; surplus centres are variants of the nearest."""
    profiles = ideal_profiles(space, len(centers))
    names = list(profiles)
    cost = [[math.dist(c, p) for p in profiles.values()] for c in centers]
    pick = assign_one_to_one(cost)
    return [names[j] if j >= 0 else f"{names[min(range(len(names)), key=row.__getitem__)]} (Variante #{i})" for i, (j, row) in enumerate(zip(pick, cost))]


def fit_diagonal_mixture(df: DataFrame, centers: Sequence[Sequence[float]], vector: str = "features", steps: int = 100, floor: float = 1e-6, tolerance: float = 1e-3, blocks: DataFrame | None = None) -> tuple[list[float], list[list[float]], list[list[float]]]:
    """(weights, means, variances) by EM from given centres, until the mean log-likelihood changes by less than the tolerance
    (at most `steps` times). Each step is one pass over packed blocks (df's, where none are given); k x d numbers reach the driver."""
    k, d = len(centers), len(centers[0])
    m = mixture.Mixture(k, full=False, weights=np.full(k, 1.0 / k), means=np.array(centers, float), covariances=np.ones((k, d)))
    blocks, last = blocks if blocks is not None else lloyd.packed(df, vector), None
    for _ in range(steps):
        flat = mixture._pass(blocks, [m])[0]
        if flat is None or last is not None and abs(flat[0] / flat[1] - last) < tolerance:
            break
        last, n = flat[0] / flat[1], np.maximum(flat[2 : 2 + k], 1e-10)
        sums, squares = flat[2 + k :].reshape(2, k, d)
        m.weights, m.means = n / flat[2 : 2 + k].sum(), sums / n[:, None]
        m.covariances = np.maximum(squares / n[:, None] - m.means**2, 0.0) + floor
    return m.weights.tolist(), m.means.tolist(), m.covariances.tolist()


def _log_terms(v, weights: Sequence[float], means: Sequence[Sequence[float]], variances: Sequence[Sequence[float]]):
    """Array of log(weight x density) of a diagonal mixture's components."""
    lits = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    parts = [F.struct(F.lit(math.log(w) - 0.5 * sum(math.log(2 * math.pi * x) for x in var)).alias("c"), lits(m).alias("m"), lits([1 / x for x in var]).alias("p")) for w, m, var in zip(weights, means, variances)]
    quad = lambda s: F.aggregate(F.zip_with(F.zip_with(v, s["m"], lambda x, y: (x - y) * (x - y)), s["p"], lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    return F.transform(F.array(*parts), lambda s: s["c"] - 0.5 * quad(s))


def log_density(v, weights: Sequence[float], means: Sequence[Sequence[float]], variances: Sequence[Sequence[float]]):
    """Logarithm of a diagonal mixture's density, by log-sum-exp over k terms."""
    return let(_log_terms(v, weights, means, variances), lambda xs: let(F.array_max(xs), lambda top: top + F.log(F.aggregate(xs, F.lit(0.0), lambda a, x: a + F.exp(x - top)))))


def posterior(v, weights: Sequence[float], means: Sequence[Sequence[float]], variances: Sequence[Sequence[float]]):
    """Array of posteriors of a diagonal mixture, by log-sum-exp over k terms."""
    logs = _log_terms(v, weights, means, variances)
    shifted = let(logs, lambda xs: let(F.array_max(xs), lambda top: F.transform(xs, lambda x: F.exp(x - top))))
    return let(shifted, lambda ys: let(F.aggregate(ys, F.lit(0.0), lambda a, y: a + y), lambda total: F.transform(ys, lambda y: y / total)))


def train_two_stage(df: DataFrame, k: int | str = 5, mixture_steps: int = 100, seeds: Sequence[int] = SEEDS, text_weight: float = 0.2) -> Model:
    """Fit on rows of multi-zone events: space, K-Means (or k chosen), labels, diagonal mixture."""
    multi = split_flag(df).where("NOT es_monozona").persist()
    try:
        space = fit_space(multi, text_weight=text_weight, stored=True)
        x = with_features(multi, space)
        blocks = lloyd.packed(x)  # once, for both fits
        k = choose_k(x, blocks=blocks)[0] if k == "auto" else k
        centers, _ = fit_kmeans(x, k, seeds=seeds, blocks=blocks)
        weights, means, variances = fit_diagonal_mixture(x, centers, steps=mixture_steps, blocks=blocks)
    finally:
        multi.unpersist()
    return Model(space, centers, label_centers(centers, space), weights, means, variances)


def predict_two_stage(df: DataFrame, model: Model, text: str = "texto_limpio") -> DataFrame:
    """Adds cluster (-1 for single-zone events), archetype, confidence, border flag, second archetype, text coverage, mixture
    posterior. One window for the split; the rest is a projection, with both branches in one `when`."""
    df = nearest_two(with_features(split_flag(df), model.space), model.centers)
    names = F.array(*[F.lit(x) for x in model.labels])
    single = F.col("es_monozona")
    cover = token_coverage(F.col(text), list(model.space.idf))
    post = F.array_max(posterior(F.col("features"), model.weights, model.means, model.variances)) if model.weights else F.lit(None).cast("double")
    out = df.withColumns({
        "arquetipo_demanda": F.when(single, F.lit(SINGLE)).otherwise(F.get(names, "cluster")), "segundo_arquetipo": F.when(~single, F.get(names, "second")),
        "score_confianza": F.when(single, 1.0).otherwise(F.col("margin")), "es_frontera": ~single & F.coalesce(F.col("margin") < BORDER, F.lit(False)),
        "cobertura_texto": cover, "probabilidad_gmm": F.when(single, 1.0).otherwise(post),
    })
    out = out.withColumn("texto_casi_vacio", F.col("cobertura_texto") < LITTLE_TEXT).withColumn("cluster", F.when(single, -1).otherwise(F.col("cluster")))
    return out.drop("features", "second", "d1", "d2", "margin")


def name_by_rank(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """cluster, arquetipo_demanda by ordered picks over cluster means (at most some ten rows): largest quota, then boxes and
    VIP, then by price."""
    info = df.where(F.col(cluster) != -1).groupBy(cluster).agg(F.avg("peso_aforo").alias("q"), F.avg("tag_general").alias("g"), (F.avg("tag_palco") + F.avg("tag_vip")).alias("v"), F.avg("ratio_precio_max").alias("p")).collect()
    left, names = sorted(info, key=lambda r: r[cluster]), {}
    if left:
        top = max(left, key=lambda r: (r["q"], r["g"]))
        names[top[cluster]] = "Grada General / Masiva"
        left.remove(top)
    if left:
        top = max(left, key=lambda r: (r["v"], r["p"]))
        names[top[cluster]] = "VIP / Palcos / Premium"
        left.remove(top)
    left.sort(key=lambda r: -r["p"])
    if left:
        names[left[0][cluster]] = "Preferencial / Platea Frontal"
    if len(left) == 2:
        names[left[1][cluster]] = "Popular / Visibilidad Parcial / Balcón"
    if len(left) >= 3:
        names[left[1][cluster]], names[left[-1][cluster]] = "Platea General / Intermedia", "Popular / Balcón / Visibilidad Parcial"
    rows = [(int(r[cluster]), names.get(r[cluster], f"Segmento #{r[cluster]}")) for r in info] + [(-1, SINGLE)]
    return df.sparkSession.createDataFrame(rows, f"{cluster} int, arquetipo_demanda string")


def principal_axes(df: DataFrame, k: int = 2, vector: str = "features") -> DataFrame:
    """Adds pca: centred projection on the k largest axes of the covariance."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import vector_to_array

    data = df.withColumn("_v", array_to_vector(vector))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="_v", outputCol="_c").fit(data).transform(data)
    return PCA(k=k, inputCol="_c", outputCol="_p").fit(centred).transform(centred).withColumn("pca", vector_to_array("_p")).drop("_v", "_c", "_p")


def first_prototypes(df: DataFrame, coded: str, numeric: str, categories: list[str], k: int, seed: int = 42) -> np.ndarray:
    """Coded vectors of k rows, those of the least hash."""
    rows = df.where(F.col(numeric).isNotNull()).orderBy(F.xxhash64(F.lit(seed), F.to_json(F.struct(numeric, *categories)))).limit(k).select(coded).collect()
    return np.array([r[0] for r in rows], float).reshape(len(rows), len(rows[0][0]) if rows else 0)


def mixed_distance_clusters(df: DataFrame, numeric: str, categories: list[str], k: int, gamma: float, steps: int = 100, seed: int = 42, tolerance: float = 1e-9) -> DataFrame:
    """Adds cluster by K-Prototypes: squared distance plus gamma times the number of differing categories, until no prototype
    moves (at most `steps` times). Each step is one pass over packed rows; k prototypes reach the driver."""
    rows = prototypes.coded(df, numeric, categories)
    first = first_prototypes(rows, "_coded", numeric, categories, k, seed)
    if not len(first):
        return df.withColumn("cluster", F.lit(None).cast("int"))
    got = prototypes.fit(lloyd.packed(rows, "_coded"), first, [(gamma, k)], len(categories), steps, tolerance)[0].at
    d, last = got.shape[1] - len(categories), F.col("_coded")
    options = [F.struct((squared_distance(F.slice(last, 1, d), F.array(*[F.lit(float(x)) for x in p[:d]])) + gamma * sum((F.when(last[d + i] == float(c), 0).otherwise(1) for i, c in enumerate(p[d:])), F.lit(0))).alias("d"), F.lit(i).alias("i")) for i, p in enumerate(got)]
    return rows.withColumn("cluster", F.array_min(F.array(*options))["i"]).drop("_coded")

