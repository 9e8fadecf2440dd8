"""Reports, drill-downs, bounded picks and compression counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import percentile as P
from ..operators import phrases as X
from ..operators import quality as Q
from ..operators import relative as R
from ..operators import selection as S
from ..operators import venue as V
from ..sources.scratch import materialise
from .common import Registry, rounded
from .domain import INV_SQL, inventory, table
from .q_inventory import METRICS_SQL
from .q_mining import _CAND, _CLASS
from .q_venue import _PCT_SQL, typed

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql


@query(f"WITH {INV_SQL}, ok AS (SELECT *, sum(dn_quota) OVER (PARTITION BY t_performance_id) AS s FROM inv WHERE dn_quota > 0 AND performance_quota > 0 AND med_base_unit_amt_itx IS NOT NULL AND net_sold_p_qty >= 0 AND net_sold_c_qty >= 0), k AS (SELECT count(*) AS k FROM ok WHERE s = performance_quota) SELECT count(*) AS total_inicial, 'legacy_v3' AS modo, count(*) - any_value(k) AS total_eliminadas, any_value(k) AS total_final FROM inv, k")
def legacy_report(spark, sf_dir):
    return Q.legacy_report(inventory(spark, sf_dir))


@query(f"WITH {INV_SQL} SELECT t_performance_id, _row_id, logical_seat_category FROM inv WHERE regexp_matches(logical_seat_category, '[0-9]')")
def names_with_digits(spark, sf_dir):
    return S.name_matches(inventory(spark, sf_dir), "logical_seat_category", r"\d").select("t_performance_id", "_row_id", "logical_seat_category")


@query(f"WITH {INV_SQL} SELECT _row_id, logical_seat_category, dn_quota, count(*) OVER () AS event_rows, CAST(sum(dn_quota) OVER () AS BIGINT) AS event_sum FROM inv WHERE t_performance_id = 7")
def event_detail(spark, sf_dir):
    return S.event_detail(inventory(spark, sf_dir), 7).select("_row_id", "logical_seat_category", "dn_quota", "event_rows", "event_sum")


@query(f"WITH {_PCT_SQL} SELECT t_performance_id, _row_id, typed.site AS site, round(k.p, 3) AS percentil_tipo FROM typed JOIN k USING (site, logical_seat_category, type_site) WHERE type_site IN ('TEATRO', 'MUSEO') AND logical_seat_category LIKE 'General%' AND k.p > 0.6 AND dn_quota % 5 <> 0")
def dear_general(spark, sf_dir):
    rows = P.type_percentile(typed(spark, sf_dir)).withColumn("texto_limpio", F.upper("logical_seat_category")).withColumn("cluster", (F.col("dn_quota") % 5 - 1).cast("int"))
    return rounded(S.dear_general(rows, ("TEATRO", "MUSEO")).select("t_performance_id", "_row_id", "site", F.col("percentil_precio_absoluto_dentro_tipo").alias("percentil_tipo")), 3)


@query("WITH l AS (SELECT unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS i FROM embeddings), v AS (SELECT i, var_samp(x) AS v FROM l GROUP BY i), s AS (SELECT i, v / sum(v) OVER () AS share, sum(v) OVER (ORDER BY i) / sum(v) OVER () AS c FROM v) SELECT CAST(i AS INT) AS axis, round(share, 6) AS share, round(c, 6) AS cumulative, c >= 0.9 AS is_enough FROM s")
def cumulative_variance(spark, sf_dir):
    axes = table(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("axis", "x")).groupBy("axis").agg(F.var_samp(F.col("x").cast("double")).alias("v"))
    return rounded(M.cumulative_variance(axes, "axis", "v").select("axis", "share", "cumulative", "is_enough"))


_CARDS_SQL = f"""{METRICS_SQL}, cards AS (SELECT t_performance_id * 10000000000000 + _row_id AS id, logical_seat_category,
 [{', '.join(f"'{c}'" for c in (*S.PREMIUM, *S.MASS, 'AU-0', 'XX-0'))}][CAST(dn_quota % 19 AS INT) + 1] AS micro_cluster_id, CASE WHEN dn_quota % 4 = 1 THEN 'hibrido_k' ELSE 'palco' END AS label_auto,
 coalesce(ratio_precio_max, 0.0) AS score_confianza, peso_aforo < 0.1 AS es_frontera FROM metrics)"""


def _cards(spark, sf_dir):
    """Rows with clusters, scores and borders made from their quota and metrics."""
    ids = F.array(*[F.lit(c) for c in (*S.PREMIUM, *S.MASS, "AU-0", "XX-0")])
    return R.relative_metrics(inventory(spark, sf_dir)).select(
        (F.col("t_performance_id").cast("decimal(20,0)") * F.lit(10000000000000).cast("decimal(14,0)") + F.col("_row_id")).cast("decimal(38,0)").alias("id"), "logical_seat_category", ids[(F.col("dn_quota") % 19).cast("int")].alias("micro_cluster_id"),
        F.when(F.col("dn_quota") % 4 == 1, "hibrido_k").otherwise("palco").alias("label_auto"), F.coalesce("ratio_precio_max", F.lit(0.0)).alias("score_confianza"), (F.col("peso_aforo") < 0.1).alias("es_frontera"),
    )


@query(f"WITH {_CARDS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY micro_cluster_id ORDER BY es_frontera, score_confianza DESC, id) AS n FROM cards) SELECT micro_cluster_id, id, es_frontera FROM k WHERE n = 1")
def cluster_representatives(spark, sf_dir):
    return S.representatives(_cards(spark, sf_dir), "micro_cluster_id", "score_confianza", "es_frontera", "id").select("micro_cluster_id", "id", "es_frontera")


_IN = lambda ids: "(" + ", ".join(f"'{i}'" for i in ids) + ")"


@query(f"""WITH {_CARDS_SQL}, off AS (SELECT *, CASE WHEN micro_cluster_id IN {_IN(S.PREMIUM)} THEN 'premium' WHEN micro_cluster_id IN {_IN(S.MASS)} THEN 'masivos' END AS grupo FROM cards WHERE NOT es_frontera),
one AS (SELECT *, row_number() OVER (PARTITION BY micro_cluster_id, logical_seat_category ORDER BY score_confianza DESC, id) AS k FROM off WHERE grupo IS NOT NULL),
two AS (SELECT *, row_number() OVER (PARTITION BY micro_cluster_id ORDER BY score_confianza DESC, id) AS r, count(*) OVER (PARTITION BY micro_cluster_id) AS names FROM one WHERE k = 1),
three AS (SELECT *, row_number() OVER (PARTITION BY grupo ORDER BY r, CASE WHEN r = 2 THEN -names END, micro_cluster_id) AS c FROM two WHERE r <= 2)
SELECT grupo, 'representante' AS caso, micro_cluster_id, id FROM three WHERE r = 1 OR c <= CASE grupo WHEN 'premium' THEN 8 ELSE 12 END
UNION ALL (SELECT 'especiales', 'representante', micro_cluster_id, id FROM off WHERE micro_cluster_id = 'AU-0' ORDER BY score_confianza DESC, id LIMIT 2)
UNION ALL (SELECT 'especiales', 'frontera', micro_cluster_id, id FROM cards WHERE es_frontera ORDER BY score_confianza, id LIMIT 2)
UNION ALL (SELECT 'especiales', 'hibrido', micro_cluster_id, id FROM off WHERE label_auto LIKE 'hibrido%' ORDER BY score_confianza DESC, id LIMIT 1)""")
def gallery_cards(spark, sf_dir):
    return S.gallery(_cards(spark, sf_dir), tie="id").select("grupo", "caso", "micro_cluster_id", "id")


@query(f"""WITH {_CAND}, good AS (SELECT * FROM cand WHERE n_eventos >= 20), r AS (SELECT *, row_number() OVER (ORDER BY frecuencia DESC, n_eventos DESC, n_tokens DESC, length(ngram) DESC, ngram) AS rk FROM good),
kept AS (SELECT count(*) AS kept FROM r WHERE NOT EXISTS (SELECT 1 FROM r b WHERE b.rk < r.rk AND contains(' ' || b.ngram || ' ', ' ' || r.ngram || ' '))),
n AS (SELECT DISTINCT trim(regexp_replace(strip_accents(upper(product)), '\\s+', ' ', 'g')) AS p, t_performance_id AS e FROM inv WHERE product IS NOT NULL), hit AS ({_CLASS}),
cl AS (SELECT count(*) AS c FROM (SELECT tipo FROM hit WHERE len(m) > 0 GROUP BY tipo HAVING count(DISTINCT e) >= 20))
SELECT (SELECT count(*) FROM cand) AS brutos, kept AS tras_subsumcion, kept + c AS tras_clases, least(kept + c, 100) AS final FROM kept, cl""")
def phrase_compression(spark, sf_dir):
    rows = materialise(inventory(spark, sf_dir).select("t_performance_id", "product").where("product IS NOT NULL").distinct(), "products")  # for both kinds
    return X.compression(X.phrase_candidates(rows), X.phrase_classes(rows))


@query("SELECT count(*) FILTER (c_custkey % 3 = 0) + count(*) FILTER (c_custkey % 5 = 1 AND c_custkey % 3 <> 0) AS lookup_rows, count(*) AS sites, round(100.0 * (count(*) FILTER (c_custkey % 3 = 0) + count(*) FILTER (c_custkey % 5 = 1 AND c_custkey % 3 <> 0)) / count(*), 6) AS pct FROM customer")
def review_coverage(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("site"), "c_custkey")
    automatic = c.where("c_custkey % 3 = 0").select("site", F.lit("PARQUE").alias("type_site"), F.lit(0.8).alias("confianza"), F.lit("reglas_heuristicas").alias("fuente"))
    review = c.where("c_custkey % 5 < 2").select("site", F.when(F.col("c_custkey") % 5 == 1, " TEATRO ").otherwise("?").alias("type_final"))
    return rounded(V.coverage(V.consolidate_review(automatic, review), c))
