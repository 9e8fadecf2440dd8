"""The engine's tables made from the star schema that the queries run on, in Spark and as SQL for the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import VENUE_TYPES

ADJECTIVES = {"small": "Palco", "red": "VIP", "hot": "Platea", "large": "General", "old": "Balcón", "blue": "Preferencial", "cold": "Mesa", "new": "Piso 2"}
NOUNS = {"widget": "Occidental", "ring": "Oriental", "plate": "Norte", "rod": "Sur", "bolt": "Lateral", "gizmo": "- Sende Tour", "gear": "Alta (Baja)", "anvil": "301 - 306"}
KEPT = ["_row_id", "t_performance_id", "site", "product", "logical_seat_category", "dn_quota", "performance_quota", "med_base_unit_amt_itx", "net_sold_p_qty", "net_sold_c_qty"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(column: str, words: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in words.items()) + " ELSE 'Zona' END"


#: Expressions that both engines read alike.
SEAT = f"{_case('adj', ADJECTIVES)} || ' ' || {_case('noun', NOUNS)}"
PRODUCT = "CASE WHEN l_orderkey % 13 = 0 THEN 'Evento TEST ' || c_mktsegment WHEN l_orderkey % 17 = 0 THEN 'Parqueadero Norte' WHEN l_orderkey % 19 = 0 THEN NULL WHEN l_orderkey % 23 = 0 THEN 'CANCELADO: ' || c_mktsegment ELSE 'Gira ' || c_mktsegment || ' BOGOTÁ ' || substr(o_orderpriority, 3) || CASE WHEN l_orderkey % 5 = 0 THEN ' MAYO' ELSE '' END END"
PRICE = "CASE WHEN l_partkey % 17 = 0 THEN NULL WHEN l_partkey % 19 = 0 THEN 0.0 WHEN l_partkey % 23 = 0 THEN -l_extendedprice ELSE l_extendedprice END"
PAID = "CASE WHEN l_suppkey % 29 = 0 THEN l_quantity + 1 ELSE CAST(floor(l_quantity * (1 - l_discount)) AS DOUBLE) END"
FREE = "CASE WHEN l_suppkey % 31 = 0 THEN CAST(-1.0 AS DOUBLE) ELSE CAST(floor(l_quantity * l_tax) AS DOUBLE) END"
ROW = "((CAST(l_linenumber AS BIGINT) * 1000000 + l_suppkey) * 100 + CAST(round(l_discount * 100) AS BIGINT)) * 100 + CAST(round(l_tax * 100) AS BIGINT)"

INV_SQL = f"""src AS (SELECT l.*, o_orderpriority, c_name, c_mktsegment, c_nationkey, split_part(p_name, ' ', 1) AS adj, split_part(p_name, ' ', 2) AS noun
 FROM lineitem l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey),
raw AS (SELECT {ROW} AS _row_id, l_orderkey AS t_performance_id, c_name AS site, {PRODUCT} AS product, {SEAT} AS logical_seat_category, CAST(l_quantity AS BIGINT) AS dn_quota,
 CAST({PRICE} AS DOUBLE) AS med_base_unit_amt_itx, {PAID} AS net_sold_p_qty, {FREE} AS net_sold_c_qty FROM src),
inv AS (SELECT *, CAST(sum(dn_quota) OVER (PARTITION BY t_performance_id) AS BIGINT) + CASE WHEN t_performance_id % 7 = 0 THEN 5 ELSE 0 END AS performance_quota FROM raw)"""

_TYPE = "CASE CAST(c_nationkey % 10 AS INT) " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(VENUE_TYPES)) + " END"
LOOKUP_SQL = f"lookup AS (SELECT '  ' || lower(c_name) || ' ' AS site, {_TYPE} AS type_site, c_custkey AS _ord FROM customer WHERE c_nationkey < 20)"
TYPED_SQL = f"{INV_SQL}, {LOOKUP_SQL}, typed AS (SELECT inv.*, coalesce(k.type_site, 'desconocido') AS type_site, CASE WHEN k.type_site IS NULL THEN 1 ELSE 0 END AS flag_site_desconocido FROM inv LEFT JOIN lookup k ON lower(inv.site) = trim(k.site))"


#: Seat rows in a task of the event windows, about: their sorts and sums are held in memory.
ROWS_A_TASK = 400_000


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seat rows of events: orders are events, lines are seat categories. Joins on the order key keep the partitioning that
    the event windows need; it has as many parts as the rows (counted from the files' footers) need."""
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table(spark, sf_dir, "lineitem").count() // ROWS_A_TASK))
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    part = table(spark, sf_dir, "part").select("p_partkey", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("adj"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("noun"))
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    who = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    # what a line and its part give is made before lines are sent: fewer and narrower columns
    seat = line.join(part, line.l_partkey == part.p_partkey).selectExpr("l_orderkey", f"{ROW} AS _row_id", f"{SEAT} AS logical_seat_category", "CAST(l_quantity AS BIGINT) AS dn_quota", f"CAST({PRICE} AS DOUBLE) AS med_base_unit_amt_itx", f"{PAID} AS net_sold_p_qty", f"{FREE} AS net_sold_c_qty")
    src = seat.repartition(tasks, "l_orderkey").join(order.join(who, order.o_custkey == who.c_custkey), F.col("l_orderkey") == F.col("o_orderkey"))
    raw = src.selectExpr("_row_id", "l_orderkey AS t_performance_id", "c_name AS site", f"{PRODUCT} AS product", "logical_seat_category", "dn_quota", "med_base_unit_amt_itx", "net_sold_p_qty", "net_sold_c_qty")
    return raw.withColumn("performance_quota", F.expr("sum(dn_quota) OVER (PARTITION BY t_performance_id) + CASE WHEN t_performance_id % 7 = 0 THEN 5 ELSE 0 END")).select(*KEPT)


def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Venue types for most sites, with names that need normalising."""
    return table(spark, sf_dir, "customer").where("c_nationkey < 20").selectExpr("'  ' || lower(c_name) || ' ' AS site", f"{_TYPE} AS type_site", "c_custkey AS _ord")


def raw_lake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table before curation."""
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS t_performance_id", *LAKE_COLUMNS)


LAKE_COLUMNS = (
    "CASE WHEN l_orderkey % 13 = 0 THEN 'Evento TEST' WHEN l_orderkey % 19 = 0 THEN NULL ELSE 'Gira' END AS product", "CAST(l_linenumber AS BIGINT) AS logical_seat_category", "l_quantity AS dn_quota",
    "CASE WHEN l_orderkey % 11 = 0 OR l_partkey % 5 = 0 THEN 0.0 ELSE l_extendedprice END AS unit_amt_itx", "l_extendedprice * 1.19 AS total_unit_amt_itx", "l_extendedprice AS base_unit_amt_itx",
    "CAST(floor(l_quantity * (1 - l_discount)) AS DOUBLE) AS net_sold_p_qty", "CAST(floor(l_quantity * l_tax) AS DOUBLE) AS net_sold_c_qty",
)
LAKE_SQL = f"lake AS (SELECT l_orderkey AS t_performance_id, {', '.join(LAKE_COLUMNS)}, CAST(sum(l_quantity) OVER (PARTITION BY l_orderkey) AS DOUBLE) + CASE WHEN l_orderkey % 7 = 0 THEN 5 ELSE 0 END AS performance_quota FROM lineitem)"


def lake(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_lake(spark, sf_dir).withColumn("performance_quota", F.expr("CAST(sum(dn_quota) OVER (PARTITION BY t_performance_id) AS DOUBLE) + CASE WHEN t_performance_id % 7 = 0 THEN 5 ELSE 0 END"))
