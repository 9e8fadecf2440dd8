"""Metrics of a row relative to its event. All windows share one partitioning, so the plan has one exchange."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import PRICE_METRICS, first_present, ratio

EVENT = "t_performance_id"


def average_rank_pct(x: str, *group: str) -> Column:
    """Percentile rank with average ties over the non-null count; null where x is null. Window functions only."""
    w = Window.partitionBy(*group).orderBy(F.col(x).asc_nulls_last())
    peers = F.count(x).over(w.rangeBetween(Window.currentRow, Window.currentRow))
    return F.when(F.col(x).isNotNull(), (F.rank().over(w) + (peers - 1) / 2) / F.count(x).over(Window.partitionBy(*group)))


def relative_metrics(df: DataFrame, price: str | None = None) -> DataFrame:
    """Adds share of quota, price against the event's maximum and mean, price percentile, occupancy, paid rate, courtesy share."""
    price = price or first_present(df, PRICE_METRICS)
    event = Window.partitionBy(EVENT)
    absolute = F.abs(F.col(price))
    paid, free, quota = (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0) for c in ("net_sold_p_qty", "net_sold_c_qty", "dn_quota"))
    top, mean = F.max(absolute).over(event), F.avg(absolute).over(event)
    df = df.withColumns({"_top": top, "_mean": mean, "_pct": average_rank_pct(price, EVENT)})
    known = F.col(EVENT).isNotNull()
    return df.withColumns({
        "peso_aforo": ratio(F.col("dn_quota").cast("double"), F.col("performance_quota").cast("double")),
        "ratio_precio_max": F.when(known & absolute.isNotNull(), F.when(F.col("_top") > 0, F.least(absolute / F.when(F.col("_top") > 0, F.col("_top")), F.lit(1.0))).otherwise(F.when(F.col("_top").isNotNull(), 0.0))),
        "ratio_precio_mean": F.when(known, F.when(F.col("_mean") > 0, absolute / F.when(F.col("_mean") > 0, F.col("_mean"))).otherwise(F.when(F.col("_mean").isNotNull(), 1.0))),
        "percentil_precio_evento": F.when(known, F.col("_pct")),
        "tasa_ocupacion": ratio(paid + free, quota), "tasa_venta_paga": ratio(paid, quota),
        "ratio_cortesias": F.when(paid + free > 0, free / F.when(paid + free > 0, paid + free)).otherwise(F.lit(0.0)),
    }).drop("_top", "_mean", "_pct")


def split_flag(df: DataFrame, least_share: float = 0.99) -> DataFrame:
    """Adds es_monozona: the event has a row with (nearly) all its quota, or, without shares, one row; and segmento_etapa."""
    event = Window.partitionBy(EVENT)
    alone = F.coalesce(F.max("peso_aforo").over(event) >= least_share, F.lit(False)) if "peso_aforo" in df.columns else F.count("*").over(event) == 1
    df = df.withColumn("es_monozona", alone)
    return df.withColumn("segmento_etapa", F.when(F.col("es_monozona"), "admision_unica").otherwise("multizona"))


def split_events(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(single-zone rows, multi-zone rows); an event is never in both."""
    flagged = split_flag(df)
    return flagged.where("es_monozona"), flagged.where("NOT es_monozona")


def paired_rows(df: DataFrame, row: str, of: Sequence[str], price: str | None = None) -> DataFrame:
    """df joined with itself by event and `row`: each row once for every row of the same event and number, with `of` of that one;
    its own values are _own_<column>. `_price` is the price in a row's pair with itself and null in others, so means by `of` count
    a row once. Rows without an event or number have no pair. The windows keep the event's partitioning, so nothing is sent again."""
    same = Window.partitionBy(EVENT, row)
    order = same.orderBy(*of)
    df = df.where(F.col(EVENT).isNotNull() & F.col(row).isNotNull())
    df = df.withColumns({"_place": F.row_number().over(order) - 1, "_all": F.collect_list(F.struct(*of)).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    df = df.select("*", F.posexplode("_all").alias("_at", "_pair")).withColumn("_price", F.when(F.col("_at") == F.col("_place"), F.col(price or first_present(df, PRICE_METRICS))))
    return df.withColumns({f"_own_{c}": F.col(c) for c in of}).withColumns({c: F.col("_pair")[c] for c in of}).drop("_place", "_all", "_at", "_pair")
