"""Protocols: the outside classifier, the shadow run, sweeps, exploration, ablation and comparison of versions."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions.rules import VENUE_TYPES
from ..operators import explore as X
from ..operators import metrics as M
from ..operators import neighbours as N
from ..operators import relative as R
from ..operators import space as S
from ..operators import venue as V
from ..sources import external, shadow
from ..sources.scratch import materialise, scratch_path
from .common import INVENTORY, Registry, kept, rounded
from .domain import inventory, table
from .q_cluster import metrics, predicted, vectors
from .q_inventory import CHECKS_SQL, METRICS_SQL
from .q_venue import _BOTH, dictionary, venue_names

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql

_EXTERNAL = "x AS (SELECT p_partkey, [" + ", ".join(f"'{t}'" for t in VENUE_TYPES) + f"][CAST(length(site) % {len(VENUE_TYPES)} AS INT) + 1] AS ext, round(least(0.70 + (length(site) % 7) / 20.0, 0.99), 3) AS sure FROM names)"


@query(f"{_BOTH}, {_EXTERNAL} SELECT p_partkey, ext AS type_site, round(sure, 3) AS confianza FROM x")
def venue_external_answers(spark, sf_dir):
    names = venue_names(spark, sf_dir)
    got = external.ask(names, external.RuleClient, scratch_path(spark, "ledger"))
    return rounded(names.join(got, "site").select("p_partkey", "type_site", "confianza"), 3)


@query(f"{_BOTH}, {_EXTERNAL} SELECT v.p_partkey, CASE WHEN v.source <> 'dictionary' AND sure >= 0.8 THEN ext ELSE v.type END AS type, CASE WHEN v.source <> 'dictionary' AND sure >= 0.8 THEN 'external' ELSE v.source END AS source FROM v JOIN x USING (p_partkey)")
def venue_consensus_external(spark, sf_dir):
    names = venue_names(spark, sf_dir)
    got = external.ask(names, external.RuleClient, scratch_path(spark, "ledger")).select("site", F.col("type_site").alias("external_type"), F.col("confianza").alias("external_confidence"))
    c = V.classify_venues(V.dictionary_types(names, dictionary(spark)).join(got, "site", "left"))
    return c.select("p_partkey", "verdict.type", "verdict.source")


_MACRO, _MICRO = ["VIP", "POP", "GGM"], ["M-0", "M-1", "M-2", "M-3"]
_SHADOW = f"""WITH {METRICS_SQL}, p AS (SELECT *, ['VIP', 'POP', 'GGM'][CAST(dn_quota % 3 AS INT) + 1] AS macro, 'M-' || CAST(dn_quota % 4 AS INT) AS micro, coalesce(ratio_precio_max, 0.0) AS sure, peso_aforo < 0.1 AS border FROM metrics), {CHECKS_SQL},
m AS (SELECT micro, count(*) AS k, count(*) / (SELECT count(*) FROM p) AS q FROM p GROUP BY micro)
SELECT 'total' AS section, 'total_registros' AS name, CAST(count(*) AS DOUBLE) AS value FROM p UNION ALL SELECT 'total', 'tasa_frontera_pct', round(100 * avg(CASE WHEN border THEN 1.0 WHEN border IS NOT NULL THEN 0.0 END), 2) FROM p UNION ALL SELECT 'total', 'confianza_media', round(avg(sure), 4) FROM p
UNION ALL SELECT 'total', 'psi_global', round(sum((q - 0.25) * ln(q / 0.25)), 4) FROM m UNION ALL SELECT 'check', "check", value FROM checks
UNION ALL SELECT 'macro', macro, count(*) FROM p GROUP BY macro UNION ALL SELECT 'micro', micro, k FROM m UNION ALL SELECT 'macro', 'others', 0 UNION ALL SELECT 'micro', 'others', 0"""


def _ruled(df):
    """A predictor by rule, so that SQL can count what it predicts."""
    name = F.get(F.array(*[F.lit(x) for x in _MACRO]), (F.col("dn_quota") % 3).cast("int"))
    micro = F.concat(F.lit("M-"), (F.col("dn_quota") % 4).cast("int").cast("string"))
    return df.withColumns({"arquetipo_demanda": name, "micro_cluster_id": micro, "label_auto": name, "score_confianza": F.coalesce("ratio_precio_max", F.lit(0.0)), "es_frontera": F.col("peso_aforo") < 0.1})


@query(_SHADOW)
def shadow_run_report(spark, sf_dir):
    rows = R.relative_metrics(inventory(spark, sf_dir))
    report = shadow.shadow_run(rows, _ruled, scratch_path(spark, "shadow"), "lot", "1", _MACRO, _MICRO, key=["t_performance_id", "logical_seat_category"])
    return rounded(shadow.report_rows(spark, report))


@kept(*INVENTORY)
def _zones(spark, sf_dir):
    """(rows of multi-zone events, their space, their keys and vectors), over the whole inventory, made once."""
    rows = materialise(R.split_flag(metrics(spark, sf_dir)).where("NOT es_monozona"), "multi")
    space = S.fit_space(rows, stored=True)
    keyed = lambda s: S.with_features(rows, s).select("_key", "features")
    rows = rows.withColumn("_key", F.concat_ws("-", "t_performance_id", "_row_id"))
    return keyed, space, materialise(keyed(space), "vectors")


def _multi(spark, sf_dir, text_weight: float = S.TEXT_WEIGHT):
    """(keys and vectors of the rows of multi-zone events, the space)."""
    keyed, space, x = _zones(spark, sf_dir)
    if text_weight == space.text_weight:
        return x, space
    space = replace(space, text_weight=text_weight)  # the weight is no part of the fit
    return keyed(space), space


@kept(*INVENTORY)
def families(spark, sf_dir):
    """Each row of multi-zone events with its cluster by each family."""
    return materialise(X.four_families(_multi(spark, sf_dir)[0], 5, "_key"), "families")


@query()
def benchmark_families(spark, sf_dir):
    return rounded(spark.createDataFrame(X.family_table(families(spark, sf_dir), "_key"), X.FAMILY_ROW))


@query()
def family_agreement(spark, sf_dir):
    return rounded(X.agreement(families(spark, sf_dir), X.FAMILIES))


@query()
def density_clusters(spark, sf_dir):
    """Density clusters for three shares of the rows as the least size."""
    return rounded(spark.createDataFrame(X.density_grid(_multi(spark, sf_dir)[0], "_key"), X.DENSITY_ROW))


@query()
def text_weight_sweep(spark, sf_dir):
    x, space = _multi(spark, sf_dir, 1.0)
    rows = X.text_weight_sweep(x, space, "_key")
    return rounded(spark.createDataFrame([(r["name"], r["silhouette"], r["davies_bouldin"], r["calinski_harabasz"], float(r["inertia"])) for r in rows], "text_weight double, silhouette double, davies_bouldin double, calinski_harabasz double, inertia double"), 4)


@query()
def over_clusters(spark, sf_dir):
    x, space = _multi(spark, sf_dir)
    return rounded(spark.createDataFrame(X.over_clusters(x, space, "_key"), "k int, label string, n long, share double"))


@kept(*INVENTORY)
def _arms(spark, sf_dir):
    x, space = _multi(spark, sf_dir)
    rows, labelled = X.ablation(x, space, "_key")
    return rows, materialise(labelled, "arms")


@query()
def ablation(spark, sf_dir):
    return rounded(spark.createDataFrame([(r["name"], r["dimensions"], r["silhouette"], r["davies_bouldin"], r["calinski_harabasz"], float(r["inertia"])) for r in _arms(spark, sf_dir)[0]], "arm string, dimensions int, silhouette double, davies_bouldin double, calinski_harabasz double, inertia double"), 4)


@query()
def ablation_transitions(spark, sf_dir):
    labelled = _arms(spark, sf_dir)[1]
    out = None
    for a, b in (("base", "full"), ("base", "percentile"), ("percentile", "full")):
        one = X.transitions(labelled, a, b).select(F.lit(a).alias("from_arm"), F.lit(b).alias("to_arm"), F.col(a).alias("was"), F.col(b).alias("is"), "n", "share")
        out = one if out is None else out.unionByName(one)
    return rounded(out)


#: Labels of two versions: the second's are numbered anew (3 x + 1), and every ninth row has moved on by one.
_VERSIONS = "v AS (SELECT vec_id, label AS was, CASE WHEN vec_id % 9 = 0 THEN (label + 1) % 10 ELSE label END AS now FROM embeddings)"


@query(f"WITH {_VERSIONS} SELECT was, now, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY was), 6) AS share, (SELECT round(avg(CASE WHEN was = now THEN 1.0 ELSE 0.0 END), 6) FROM v) AS match_rate FROM v GROUP BY was, now")
def version_transitions(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("label").alias("was"), ((F.when(F.col("vec_id") % 9 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")) * 3 + 1) % 10).alias("new"))
    x = X.aligned(v, "was", "new", "now")
    return rounded(X.transitions(x, "was", "now").crossJoin(M.match_rate(x, "was", "now")))  # a single row


@query()
def subspace_weight_sweep(spark, sf_dir):
    df = predicted(spark, sf_dir).where("arquetipo_demanda LIKE 'VIP%'")
    rows = X.subspace_weight_sweep(df, S.MICRO_TAGS) if df.limit(1).count() else []
    return rounded(spark.createDataFrame([(r["weight"], r["k"], float(r["purity"]), float(r["ari"]), bool(r["passes"])) for r in rows], "text_weight double, k int, purity double, ari double, passes boolean"))


@query()
def projection_sweep(spark, sf_dir):
    return rounded(spark.createDataFrame(X.projection_sweep(_multi(spark, sf_dir)[0], "_key"), X.PROJECTION))


@query()
def mixture_sweep(spark, sf_dir):
    """Full mixtures of 8 to 16 and diagonal ones of 4 to 10 components, three starts each."""
    x = _multi(spark, sf_dir)[0]
    rows = [("full", r) for r in X.mixture_sweep(x, "_key", (8, 10, 12, 14, 16))] + [("diag", r) for r in X.mixture_sweep(x, "_key", (4, 5, 6, 7, 8, 9, 10), False)]
    return rounded(spark.createDataFrame([(kind, r["k"], r["log_likelihood"], r["bic"], r["aic"]) for kind, r in rows], "covariance string, k int, log_likelihood double, bic double, aic double"), 1)


@query()
def prototype_grid(spark, sf_dir):
    v = vectors(spark, sf_dir).withColumn("cat", F.col("label").cast("string"))
    return rounded(spark.createDataFrame(X.prototype_grid(v, "features", ["cat"], "vec_id"), "gamma double, k int, clusters long, silhouette double, davies_bouldin double"))


@query()
def neighbour_recall(spark, sf_dir):
    """Share of the exact neighbours of every hundredth row that the improved lists hold."""
    v = vectors(spark, sf_dir)
    graph = N.neighbour_graph(v, key="vec_id")
    asked = [r[0] for r in v.where("vec_id % 100 = 0").select("vec_id").collect()]  # the stated rows
    exact = N.exact_neighbours(v, asked, key="vec_id")
    return rounded(exact.join(graph.select("a", "b", F.lit(1).alias("hit")), ["a", "b"], "left").groupBy("a").agg(F.count("*").alias("k"), F.count("hit").alias("found")).agg(F.count("*").alias("rows"), (F.sum("found") / F.sum("k")).alias("recall")))


@query()
def spectral_layout(spark, sf_dir):
    layout = N.spectral_layout(N.neighbour_graph(vectors(spark, sf_dir), key="vec_id"), 2)
    return rounded(layout.select("id", F.col("xy")[0].alias("x"), F.col("xy")[1].alias("y")))
