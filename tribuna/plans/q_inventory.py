"""Filters, curation, relative metrics, profiles, selection and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curate as C
from ..operators import quality as Q
from ..operators import relative as R
from ..operators import selection as S
from .common import Registry, rounded
from .domain import INV_SQL, LAKE_SQL, inventory, lake, table

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql

RULES_SQL = f"""{INV_SQL},
s1 AS (SELECT *, CASE WHEN logical_seat_category IS NULL OR lower(trim(logical_seat_category)) IN ('', 'nan', 'none', 'null') THEN 'r1_name' WHEN NOT dn_quota > 0 THEN 'r2_quota' WHEN NOT performance_quota > 0 THEN 'r3_event_quota'
 WHEN NOT coalesce(med_base_unit_amt_itx > 0, false) THEN 'r4_price' WHEN NOT (net_sold_p_qty >= 0 AND net_sold_c_qty >= 0) THEN 'r5_quantities' END AS r FROM inv),
s2 AS (SELECT *, row_number() OVER (PARTITION BY t_performance_id, site, logical_seat_category, dn_quota, med_base_unit_amt_itx, r IS NULL ORDER BY _row_id) AS k FROM s1),
s3 AS (SELECT * EXCLUDE (r, k), CASE WHEN r IS NULL AND k > 1 THEN 'r6_duplicate' ELSE r END AS r FROM s2),
s4 AS (SELECT *, sum(CASE WHEN r IS NULL THEN dn_quota END) OVER (PARTITION BY t_performance_id) AS tot FROM s3),
s5 AS (SELECT * EXCLUDE (r, tot), CASE WHEN r IS NULL AND NOT coalesce(tot = performance_quota, false) THEN 'r7_event_sum' ELSE r END AS r FROM s4),
s6 AS (SELECT * EXCLUDE (r), CASE WHEN r IS NULL AND (contains(upper(coalesce(product, '')), 'TEST') OR contains(upper(coalesce(product, '')), 'CANCELAD') OR contains(upper(coalesce(product, '')), 'PARQUEA') OR contains(upper(coalesce(product, '')), 'NO USAR')) THEN 'r8_product' ELSE r END AS r FROM s5),
tagged AS (SELECT * EXCLUDE (r), CASE WHEN r IS NULL AND NOT net_sold_p_qty <= dn_quota THEN 'r9_oversold' ELSE r END AS r FROM s6)"""
RANK_SQL = "CASE WHEN med_base_unit_amt_itx IS NOT NULL THEN (rank() OVER (PARTITION BY t_performance_id ORDER BY med_base_unit_amt_itx ASC NULLS LAST) + (count(med_base_unit_amt_itx) OVER (PARTITION BY t_performance_id, med_base_unit_amt_itx) - 1) / 2.0) / count(med_base_unit_amt_itx) OVER (PARTITION BY t_performance_id) END"
METRICS_SQL = f"""{INV_SQL}, w AS (SELECT *, max(abs(med_base_unit_amt_itx)) OVER (PARTITION BY t_performance_id) AS top, avg(abs(med_base_unit_amt_itx)) OVER (PARTITION BY t_performance_id) AS mean, {RANK_SQL} AS pct FROM inv),
metrics AS (SELECT *, least(greatest(dn_quota / performance_quota, 0), 1) AS peso_aforo,
 CASE WHEN med_base_unit_amt_itx IS NULL THEN NULL WHEN top > 0 THEN least(abs(med_base_unit_amt_itx) / top, 1) WHEN top IS NOT NULL THEN 0 END AS ratio_precio_max, CASE WHEN mean > 0 THEN abs(med_base_unit_amt_itx) / mean WHEN mean IS NOT NULL THEN 1 END AS ratio_precio_mean,
 pct AS percentil_precio_evento, least(greatest((net_sold_p_qty + net_sold_c_qty) / dn_quota, 0), 1) AS tasa_ocupacion, least(greatest(net_sold_p_qty / dn_quota, 0), 1) AS tasa_venta_paga,
 CASE WHEN net_sold_p_qty + net_sold_c_qty > 0 THEN net_sold_c_qty / (net_sold_p_qty + net_sold_c_qty) ELSE 0 END AS ratio_cortesias FROM w)"""
METRICS = ["peso_aforo", "ratio_precio_max", "ratio_precio_mean", "percentil_precio_evento", "tasa_ocupacion", "tasa_venta_paga", "ratio_cortesias"]
_ROUNDED = ", ".join(f"round(CAST({m} AS DOUBLE), 6) + 0.0 AS {m}" for m in METRICS)


@query(f"WITH {METRICS_SQL} SELECT t_performance_id, _row_id, {_ROUNDED} FROM metrics")
def event_relative_metrics(spark, sf_dir):
    return rounded(R.relative_metrics(inventory(spark, sf_dir)).select("t_performance_id", "_row_id", *METRICS))


@query(f"WITH {INV_SQL} SELECT t_performance_id, _row_id, round({RANK_SQL}, 6) AS pct FROM inv")
def event_price_rank_pct(spark, sf_dir):
    return rounded(inventory(spark, sf_dir).select("t_performance_id", "_row_id", R.average_rank_pct("med_base_unit_amt_itx", "t_performance_id").alias("pct")))


@query(f"WITH {METRICS_SQL} SELECT t_performance_id, _row_id, max(peso_aforo) OVER (PARTITION BY t_performance_id) >= 0.99 AS es_monozona, CASE WHEN max(peso_aforo) OVER (PARTITION BY t_performance_id) >= 0.99 THEN 'admision_unica' ELSE 'multizona' END AS segmento_etapa FROM metrics")
def event_single_multi_split(spark, sf_dir):
    return R.split_flag(R.relative_metrics(inventory(spark, sf_dir))).select("t_performance_id", "_row_id", "es_monozona", "segmento_etapa")


@query(f"WITH {INV_SQL} SELECT t_performance_id, _row_id, CAST(sum(dn_quota) OVER (PARTITION BY t_performance_id) AS BIGINT) AS event_sum, count(*) OVER (PARTITION BY t_performance_id) AS event_rows FROM inv")
def event_quota_sum(spark, sf_dir):
    return inventory(spark, sf_dir).selectExpr("t_performance_id", "_row_id", "sum(dn_quota) OVER (PARTITION BY t_performance_id) AS event_sum", "count(*) OVER (PARTITION BY t_performance_id) AS event_rows")


@query(f"WITH {RULES_SQL} SELECT count(*) AS initial_rows, " + ", ".join(f"count(*) FILTER (r = '{r}') AS {r}" for r in Q.RULES) + ", count(*) FILTER (r IS NULL) AS final_rows, round((count(*) - count(*) FILTER (r IS NULL)) / count(*), 6) AS removed_share FROM tagged")
def quality_rules_report(spark, sf_dir):
    return rounded(Q.rule_report(inventory(spark, sf_dir)))


@query(f"WITH {RULES_SQL} SELECT t_performance_id, _row_id, logical_seat_category, dn_quota, med_base_unit_amt_itx FROM tagged WHERE r IS NULL")
def quality_clean_rows(spark, sf_dir):
    return Q.clean_rows(inventory(spark, sf_dir)).select("t_performance_id", "_row_id", "logical_seat_category", "dn_quota", "med_base_unit_amt_itx")


@query(f"WITH {INV_SQL}, ok AS (SELECT * FROM inv WHERE dn_quota > 0 AND performance_quota > 0 AND med_base_unit_amt_itx IS NOT NULL AND net_sold_p_qty >= 0 AND net_sold_c_qty >= 0) SELECT t_performance_id, _row_id FROM (SELECT *, sum(dn_quota) OVER (PARTITION BY t_performance_id) AS s FROM ok) WHERE s = performance_quota")
def legacy_filter(spark, sf_dir):
    return Q.legacy_clean_rows(inventory(spark, sf_dir)).select("t_performance_id", "_row_id")


@query("SELECT l_orderkey, l_linenumber, min(l_partkey) AS first_part FROM lineitem GROUP BY 1, 2")
def dedup_business_key(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("k", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    return S.best_per_group(rows, "k", "l_partkey").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("first_part"))


@query(f"WITH {INV_SQL} SELECT product, count(*) AS n FROM inv WHERE NOT (contains(upper(coalesce(product, '')), 'TEST') OR contains(upper(coalesce(product, '')), 'CANCELAD') OR contains(upper(coalesce(product, '')), 'PARQUEA') OR contains(upper(coalesce(product, '')), 'NO USAR')) GROUP BY product")
def exclude_patterns(spark, sf_dir):
    return inventory(spark, sf_dir).where(~Q.excluded_product(F.col("product"))).groupBy("product").agg(F.count("*").alias("n"))


@query(f"WITH {INV_SQL} SELECT t_performance_id, _row_id, net_sold_p_qty, dn_quota FROM inv WHERE net_sold_p_qty > dn_quota")
def oversell(spark, sf_dir):
    return inventory(spark, sf_dir).where("net_sold_p_qty > dn_quota").select("t_performance_id", "_row_id", "net_sold_p_qty", "dn_quota")


_CURATION = "product IS NOT NULL AND NOT (contains(upper(product), 'TEST') OR contains(upper(product), 'CANCELAD') OR contains(upper(product), 'PARQUEA') OR contains(upper(product), 'NO USAR')) AND performance_quota > 0 AND net_sold_p_qty <= dn_quota"
_FREE = "free AS (SELECT t_performance_id FROM f GROUP BY 1 HAVING count(*) = count(*) FILTER (unit_amt_itx = 0 AND net_sold_c_qty >= 0))"
_AGG = "SELECT t_performance_id, product, logical_seat_category, performance_quota, max(dn_quota) AS dn_quota, avg(unit_amt_itx) AS ave_unit_amt_itx, avg(total_unit_amt_itx) AS ave_total_unit_amt_itx, avg(base_unit_amt_itx) AS ave_base_unit_amt_itx, median(unit_amt_itx) AS med_unit_amt_itx, median(total_unit_amt_itx) AS med_total_unit_amt_itx, median(base_unit_amt_itx) AS med_base_unit_amt_itx, sum(net_sold_p_qty) AS net_sold_p_qty, sum(net_sold_c_qty) AS net_sold_c_qty FROM kept GROUP BY 1, 2, 3, 4"
_CURATED = f"""{LAKE_SQL}, f AS (SELECT * FROM lake WHERE {_CURATION}), {_FREE},
kept AS (SELECT DISTINCT f.* FROM f WHERE t_performance_id NOT IN (SELECT t_performance_id FROM free) AND (unit_amt_itx <> 0 OR net_sold_c_qty > 0)), g AS ({_AGG})"""
_MEASURED = ["ave_unit_amt_itx", "ave_total_unit_amt_itx", "ave_base_unit_amt_itx", "med_unit_amt_itx", "med_total_unit_amt_itx", "med_base_unit_amt_itx"]
_G = "t_performance_id, logical_seat_category, dn_quota, " + ", ".join(f"round({c}, 6) AS {c}" for c in _MEASURED) + ", net_sold_p_qty, net_sold_c_qty"


@query(f"WITH {LAKE_SQL} SELECT t_performance_id, count(*) AS n FROM lake WHERE {_CURATION} GROUP BY 1")
def curation_predicate(spark, sf_dir):
    return C.curation_filter(lake(spark, sf_dir)).groupBy("t_performance_id").agg(F.count("*").alias("n"))


@query(f"WITH {LAKE_SQL}, f AS (SELECT * FROM lake) SELECT t_performance_id FROM (SELECT t_performance_id FROM f GROUP BY 1 HAVING count(*) = count(*) FILTER (unit_amt_itx = 0 AND net_sold_c_qty >= 0))")
def free_events_inner(spark, sf_dir):
    return C.free_events(lake(spark, sf_dir), as_join=True)


@query(f"WITH {LAKE_SQL}, f AS (SELECT * FROM lake), {_FREE} SELECT t_performance_id, count(*) AS n FROM f WHERE t_performance_id NOT IN (SELECT t_performance_id FROM free) GROUP BY 1")
def free_events_anti(spark, sf_dir):
    return C.without_free_events(lake(spark, sf_dir)).groupBy("t_performance_id").agg(F.count("*").alias("n"))


@query(f"WITH {LAKE_SQL}, v AS (SELECT t_performance_id FROM lake GROUP BY 1 HAVING sum(dn_quota) = max(performance_quota)) SELECT t_performance_id, count(*) AS n FROM lake WHERE t_performance_id IN (SELECT t_performance_id FROM v) GROUP BY 1")
def valid_events_semi(spark, sf_dir):
    return C.valid_events(lake(spark, sf_dir)).groupBy("t_performance_id").agg(F.count("*").alias("n"))


@query(f"WITH {LAKE_SQL}, kept AS (SELECT * FROM lake), g AS ({_AGG}) SELECT {_G} FROM g")
def curate_multi_agg(spark, sf_dir):
    df = C.aggregate_measures(lake(spark, sf_dir)).drop("product", "performance_quota")
    return df.select(*[F.round(c, 6).alias(c) if c in _MEASURED else c for c in df.columns])


@query(f"WITH {_CURATED}, v AS (SELECT t_performance_id FROM g GROUP BY 1 HAVING sum(dn_quota) = max(performance_quota)) SELECT {_G} FROM g WHERE t_performance_id IN (SELECT t_performance_id FROM v) AND net_sold_p_qty <= dn_quota")
def curate_events(spark, sf_dir):
    df = C.curate(lake(spark, sf_dir)).drop("product", "performance_quota")
    return df.select(*[F.round(c, 6).alias(c) if c in _MEASURED else c for c in df.columns])


@query("SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem")
def exact_distinct(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag").dropDuplicates()


@query(f"WITH {LAKE_SQL}, e AS (SELECT t_performance_id, sum(dn_quota) = max(performance_quota) AS ok FROM lake GROUP BY 1) SELECT count(*) AS events, count(*) FILTER (ok) AS matches, count(*) FILTER (NOT ok) AS mismatches, round(100.0 * count(*) FILTER (ok) / count(*), 6) AS match_pct FROM e")
def event_validation(spark, sf_dir):
    return rounded(C.validation_summary(C.event_validation(lake(spark, sf_dir))))


_PROFILED = ["dn_quota", "performance_quota", "med_base_unit_amt_itx", "net_sold_p_qty", "net_sold_c_qty"]


@query(f"WITH {INV_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) FILTER ({c} IS NULL) AS nulls, count(*) FILTER ({c} = 0) AS zeros, count(*) FILTER ({c} < 0) AS negatives FROM inv" for c in _PROFILED))
def data_profile(spark, sf_dir):
    return Q.profile(inventory(spark, sf_dir), _PROFILED)


@query(f"WITH {INV_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, CAST(min({c}) AS DOUBLE) AS min, round(CAST(quantile_cont({c}, 0.25) AS DOUBLE), 4) AS q25, round(CAST(quantile_cont({c}, 0.5) AS DOUBLE), 4) AS q50, round(CAST(quantile_cont({c}, 0.75) AS DOUBLE), 4) AS q75, CAST(max({c}) AS DOUBLE) AS max FROM inv" for c in _PROFILED))
def describe_exact(spark, sf_dir):
    return rounded(Q.describe_exact(inventory(spark, sf_dir), _PROFILED), 4)


@query(f"WITH {INV_SQL} SELECT count(*) FILTER (net_sold_p_qty > dn_quota) AS paid_over_quota, count(*) FILTER (net_sold_p_qty + net_sold_c_qty > dn_quota) AS sold_over_quota, count(*) FILTER (dn_quota > performance_quota) AS quota_over_event, count(*) FILTER (net_sold_p_qty < 0) AS negative_paid, count(*) FILTER (net_sold_c_qty < 0) AS negative_free, count(*) FILTER (med_base_unit_amt_itx = 0 AND net_sold_p_qty > 0) AS paid_at_zero_price, count(*) FILTER (med_base_unit_amt_itx < 0) AS negative_price FROM inv")
def logical_inconsistencies(spark, sf_dir):
    return Q.inconsistencies(inventory(spark, sf_dir))


#: Checks A-E over `inv`, as the table `checks`.
CHECKS_SQL = """y AS (SELECT *, sum(dn_quota) OVER (PARTITION BY t_performance_id) AS s FROM inv), checks AS (
SELECT 'a_duplicate_rows' AS "check", CAST(sum(n - 1) AS DOUBLE) AS value FROM (SELECT count(*) AS n FROM inv GROUP BY t_performance_id, logical_seat_category)
UNION ALL SELECT 'b_incoherent_rows', CAST(count(*) FILTER (s <> performance_quota) AS DOUBLE) FROM y UNION ALL SELECT 'c_rows', CAST(count(*) AS DOUBLE) FROM y
UNION ALL SELECT 'c_deviation', round(abs((count(*) - 33775) / 33775), 6) FROM y UNION ALL SELECT 'c_alert', CASE WHEN abs((count(*) - 33775) / 33775) > 0.2 THEN 1.0 ELSE 0.0 END FROM y
UNION ALL SELECT 'd_excluded_products', CAST(count(*) FILTER (contains(upper(coalesce(product, '')), 'TEST') OR contains(upper(coalesce(product, '')), 'CANCELAD') OR contains(upper(coalesce(product, '')), 'PARQUEA') OR contains(upper(coalesce(product, '')), 'NO USAR')) AS DOUBLE) FROM y
UNION ALL SELECT 'e_oversold', CAST(count(*) FILTER (net_sold_p_qty > dn_quota) AS DOUBLE) FROM y)"""


@query(f'WITH {INV_SQL}, {CHECKS_SQL} SELECT "check", value FROM checks')
def input_checks_a_to_e(spark, sf_dir):
    return rounded(Q.input_checks(inventory(spark, sf_dir), key=["t_performance_id", "logical_seat_category"]))


@query(f"WITH {INV_SQL} SELECT bucket, count(*) AS events FROM (SELECT CASE WHEN count(*) <= 5 THEN CAST(count(*) AS VARCHAR) ELSE '>5' END AS bucket FROM inv GROUP BY t_performance_id) GROUP BY bucket")
def bucket_histogram(spark, sf_dir):
    return inventory(spark, sf_dir).groupBy("t_performance_id").count().select(S.count_bucket(F.col("count")).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("events"))


@query(f"WITH {METRICS_SQL} SELECT count(*) FILTER (ratio_precio_max = 1) AS at_top, count(*) FILTER (ratio_precio_max = 1 AND n = 1) AS at_top_alone, count(*) FILTER (ratio_precio_max = 1 AND n > 1) AS at_top_among_more FROM (SELECT *, count(*) OVER (PARTITION BY t_performance_id) AS n FROM metrics)")
def ratio_one_decomposition(spark, sf_dir):
    df = R.relative_metrics(inventory(spark, sf_dir)).withColumn("n", F.expr("count(*) OVER (PARTITION BY t_performance_id)"))
    one = F.col("ratio_precio_max") == 1
    return df.agg(F.count_if(one).alias("at_top"), F.count_if(one & (F.col("n") == 1)).alias("at_top_alone"), F.count_if(one & (F.col("n") > 1)).alias("at_top_among_more"))


@query(f"WITH {INV_SQL}, t AS (SELECT count(*) AS total FROM inv) SELECT site, count(*) AS n, round(100.0 * count(*) / any_value(total), 6) AS pct FROM inv, t GROUP BY site ORDER BY n DESC, site LIMIT 10")
def top_n_share(spark, sf_dir):
    return rounded(S.top_share(inventory(spark, sf_dir), "site", 10))


@query(f"WITH {METRICS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY t_performance_id ORDER BY ratio_precio_max DESC NULLS LAST, _row_id) AS n FROM metrics) SELECT t_performance_id, min(_row_id) AS _row_id FROM k WHERE n = 1 GROUP BY t_performance_id")
def best_per_group(spark, sf_dir):
    return S.best_per_group(R.relative_metrics(inventory(spark, sf_dir)), "t_performance_id", F.desc_nulls_last("ratio_precio_max"), "_row_id").select("t_performance_id", "_row_id")


@query(f"""WITH {INV_SQL}, a AS (SELECT product, logical_seat_category, dn_quota, row_number() OVER (PARTITION BY product, logical_seat_category ORDER BY dn_quota DESC, t_performance_id, _row_id) AS k, t_performance_id, _row_id FROM inv WHERE product IS NOT NULL),
b AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY dn_quota DESC, t_performance_id, _row_id) AS rank FROM a WHERE k = 1) SELECT product, logical_seat_category, t_performance_id, CAST(rank AS INT) AS rank FROM b WHERE rank <= 2""")
def top2_per_group(spark, sf_dir):
    rows = inventory(spark, sf_dir).where("product IS NOT NULL")
    return S.top_per_group(rows, "product", "logical_seat_category", 2, F.desc("dn_quota"), "t_performance_id", "_row_id").select("product", "logical_seat_category", "t_performance_id", "rank")


_STRATA = (("micro", 40), ("pequeno", 80), ("mediano", 120), ("grande", 160), ("estadio", None))


@query(f"""WITH {INV_SQL}, e AS (SELECT t_performance_id, max(performance_quota) AS q FROM inv GROUP BY 1) SELECT CASE WHEN q <= 40 THEN 'micro' WHEN q <= 80 THEN 'pequeno' WHEN q <= 120 THEN 'mediano' WHEN q <= 160 THEN 'grande' ELSE 'estadio' END AS estrato, count(*) AS events FROM e GROUP BY 1""")
def event_strata(spark, sf_dir):
    return S.event_summary(inventory(spark, sf_dir)).groupBy(S.stratum(F.col("performance_quota"), _STRATA).alias("estrato")).agg(F.count("*").alias("events"))


def _pick_sql() -> str:
    """The picks one after another, each without the sites of those before."""
    out, low = [], 0.0
    for i, (name, top) in enumerate(_STRATA):
        free = "TRUE" if not i else "site NOT IN (" + " UNION ALL ".join(f"SELECT site FROM p{j}" for j in range(i)) + ")"
        middle = (low + (top if top is not None else 30000)) / 2
        out.append(f"p{i} AS (SELECT *, '{name}' AS estrato_objetivo FROM pool ORDER BY CASE WHEN {free} AND estrato_real = '{name}' THEN 0 WHEN {free} THEN 1 ELSE 2 END, CASE WHEN {free} AND estrato_real = '{name}' THEN -n_localidades ELSE abs(performance_quota - {middle}) END, t_performance_id LIMIT 1)")
        low = top or low
    return ", ".join(out)


_REAL = "CASE " + " ".join(f"WHEN performance_quota <= {t} THEN '{n}'" for n, t in _STRATA if t is not None) + f" ELSE '{_STRATA[-1][0]}' END"


@query(f"WITH {INV_SQL}, e AS (SELECT t_performance_id, min(product) AS product, min(site) AS site, CAST(max(performance_quota) AS DOUBLE) AS performance_quota, CAST(count(DISTINCT logical_seat_category) AS INT) AS n_localidades FROM inv GROUP BY 1), pool AS (SELECT *, {_REAL} AS estrato_real FROM e WHERE n_localidades >= 4), {_pick_sql()} " + " UNION ALL ".join(f"SELECT t_performance_id, product, site, performance_quota, n_localidades, estrato_objetivo, estrato_real FROM p{i}" for i in range(len(_STRATA))))
def event_strata_pick(spark, sf_dir):
    return S.pick_strata(S.event_summary(inventory(spark, sf_dir)), strata=_STRATA)


@query(f"WITH {INV_SQL} SELECT logical_seat_category, med_base_unit_amt_itx, CAST(greatest((SELECT count(*) FROM inv WHERE t_performance_id = 7) - 12, 0) AS BIGINT) AS rest FROM inv WHERE t_performance_id = 7 ORDER BY med_base_unit_amt_itx DESC NULLS LAST, logical_seat_category LIMIT 12")
def price_ladder(spark, sf_dir):
    return S.price_ladder(inventory(spark, sf_dir), 7, "med_base_unit_amt_itx")


@query(f"WITH {METRICS_SQL}, s AS (SELECT *, max(peso_aforo) OVER (PARTITION BY t_performance_id) >= 0.99 AS m FROM metrics) SELECT m AS es_monozona, count(*) AS n FROM (SELECT * FROM s WHERE m UNION ALL SELECT * FROM s WHERE NOT m) GROUP BY m")
def union_branches(spark, sf_dir):
    one, many = R.split_events(R.relative_metrics(inventory(spark, sf_dir)))
    return one.unionByName(many).groupBy("es_monozona").agg(F.count("*").alias("n"))


@query(f"WITH {METRICS_SQL}, s AS (SELECT *, max(peso_aforo) OVER (PARTITION BY t_performance_id) >= 0.99 AS m FROM metrics) SELECT count(*) AS shared_events FROM (SELECT t_performance_id FROM s WHERE m INTERSECT SELECT t_performance_id FROM s WHERE NOT m)")
def set_intersect(spark, sf_dir):
    one, many = R.split_events(R.relative_metrics(inventory(spark, sf_dir)))
    return one.select("t_performance_id").intersect(many.select("t_performance_id")).agg(F.count("*").alias("shared_events"))


@query("SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def set_diff(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey").exceptAll(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct())


@query("SELECT DISTINCT word FROM (SELECT split_part(p_name, ' ', 1) AS word FROM part UNION SELECT split_part(p_name, ' ', 2) FROM part)")
def set_union(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    word = lambda i: p.select(F.split_part("p_name", F.lit(" "), F.lit(i)).alias("word"))
    return word(1).union(word(2)).distinct()


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('42|' || o_orderkey), o_orderkey LIMIT 1000")
def hash_sample(spark, sf_dir):
    from ..operators.metrics import hash_sample as sample

    return sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 1000, "o_orderkey")
