"""Lake curation as one plan: predicates, fully free events out, distinct, wide aggregation, valid events only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import EXCLUDED

MEASURES = ("dn_quota", "unit_amt_itx", "total_unit_amt_itx", "base_unit_amt_itx", "net_sold_p_qty", "net_sold_c_qty")
EVENT = "t_performance_id"


def curation_filter(df: DataFrame, patterns=EXCLUDED) -> DataFrame:
    """Product known and without patterns, event quota over 0, paid not over quota."""
    clean = reduce(lambda a, b: a & b, [~F.contains(F.upper("product"), F.lit(p)) for p in patterns])
    return df.where(clean & (F.col("performance_quota") > 0) & (F.col("net_sold_p_qty") <= F.col("dn_quota")))


def free_events(df: DataFrame, as_join: bool = False) -> DataFrame:
    """Events of which every row is free. One conditional aggregate; `as_join` keeps the two-aggregate form."""
    free = (F.col("unit_amt_itx") == 0) & (F.col("net_sold_c_qty") >= 0)
    if as_join:
        every = df.groupBy(EVENT).agg(F.count("*").alias("total"))
        some = df.where(free).groupBy(EVENT).agg(F.count("*").alias("free"))
        return every.join(some, EVENT).where("total = free").select(EVENT)
    return df.groupBy(EVENT).agg(F.count("*").alias("total"), F.count_if(free).alias("free")).where("total = free").select(EVENT)


def without_free_events(df: DataFrame) -> DataFrame:
    return df.join(free_events(df), EVENT, "left_anti")


def priced_or_free(df: DataFrame) -> DataFrame:
    """A price other than 0, or courtesies."""
    return df.where((F.col("unit_amt_itx") != 0) | (F.col("net_sold_c_qty") > 0))


def aggregate_measures(df: DataFrame) -> DataFrame:
    """Group by every column that is no measure: maximum quota, means, exact medians and sums."""
    dims = [c for c in df.columns if c not in MEASURES]
    return df.groupBy(*dims).agg(
        F.max("dn_quota").alias("dn_quota"), F.avg("unit_amt_itx").alias("ave_unit_amt_itx"), F.avg("total_unit_amt_itx").alias("ave_total_unit_amt_itx"),
        F.avg("base_unit_amt_itx").alias("ave_base_unit_amt_itx"), F.median("unit_amt_itx").alias("med_unit_amt_itx"), F.median("total_unit_amt_itx").alias("med_total_unit_amt_itx"),
        F.median("base_unit_amt_itx").alias("med_base_unit_amt_itx"), F.sum("net_sold_p_qty").alias("net_sold_p_qty"), F.sum("net_sold_c_qty").alias("net_sold_c_qty"),
    )


def event_validation(df: DataFrame) -> DataFrame:
    """Per event: summed quota, stated quota, whether they are equal."""
    return df.groupBy(EVENT).agg(F.sum("dn_quota").alias("sum_quota"), F.max("performance_quota").alias("performance_quota")).withColumn("coherent", F.col("sum_quota") == F.col("performance_quota"))


def validation_summary(events: DataFrame) -> DataFrame:
    n, ok = F.count("*"), F.count_if("coherent")
    return events.agg(n.alias("events"), ok.alias("matches"), (n - ok).alias("mismatches"), F.when(n > 0, 100 * ok / F.when(n > 0, n)).alias("match_pct"))


def valid_events(df: DataFrame) -> DataFrame:
    """Rows of coherent events."""
    return df.join(event_validation(df).where("coherent").select(EVENT), EVENT, "left_semi")


def curate(df: DataFrame) -> DataFrame:
    """The whole curation."""
    kept = priced_or_free(without_free_events(curation_filter(df)).dropDuplicates())
    return valid_events(aggregate_measures(kept)).where("net_sold_p_qty <= dn_quota")
