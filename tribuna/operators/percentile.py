"""Price percentiles within a venue type: training over means per name, a reference, and ranks against the reference.

Ranks and percentiles are those of `ranks`: a type of any size is spread over ranges. Means are written once, as a mean summed in
another order may differ in its last digit and would not join with itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import UNKNOWN_TYPE
from ..sources.scratch import materialise
from .columns import PRICE_METRICS, PRICE_REFERENCE, first_present
from .ranks import average_pct, positions, quantiles, small

COLD = 50


def mean_prices(df: DataFrame, price: str, name: str = "logical_seat_category") -> DataFrame:
    """Mean price per venue, seat name and type; null keys are left out.

    Millionths are summed as whole numbers and what is finer apart, so equal prices have equal means in whatever order tasks add them:
    a mean that differs in its last digit would lose its ties."""
    return _means(df, ["site", name, "type_site"], price)


def _means(df: DataFrame, keys: list[str], price: str) -> DataFrame:
    rows = df.dropna(subset=keys).select(*keys, F.col(price).cast("double").alias("_x")).withColumn("_whole", F.expr("try_cast(round(_x * 1e6D) AS decimal(28,0))"))
    rest = F.col("_x") - F.coalesce(F.col("_whole").cast("double") / 1e6, F.lit(0.0))
    n = F.when(F.count("_x") > 0, F.count("_x"))
    mean = F.coalesce(F.sum("_whole").cast("double"), F.lit(0.0)) / n / 1e6 + F.sum(rest) / n
    return rows.groupBy(*keys).agg(F.when(F.min("_x") == F.max("_x"), F.min("_x")).otherwise(mean).alias("mean_price"))


def type_percentile(df: DataFrame, price: str | None = None, name: str = "logical_seat_category", cold: int = COLD) -> DataFrame:
    """Adds percentil_precio_absoluto_dentro_tipo and flag_cold_start_tipo (training form)."""
    price = price or first_present(df, PRICE_METRICS)
    # two hashes of 64 bits stand for venue, seat name and type: rows go to their means as 16 bytes, not as three strings
    keys = ["site", name, "type_site"]
    known = F.col(keys[0]).isNotNull() & F.col(keys[1]).isNotNull() & F.col(keys[2]).isNotNull()
    df = df.withColumns({"_k1": F.when(known, F.xxhash64(*keys)), "_k2": F.when(known, F.xxhash64(F.lit(1), *reversed(keys)))})
    # nearly every row has a mean of its own, so rows are sent as they are, not as sums within tasks
    stats = materialise(_means(df.select("_k1", "_k2", "type_site", price).repartition("_k1"), ["_k1", "_k2", "type_site"], price), "mean-prices")
    ranked = positions(stats, ["type_site"], "mean_price").select(F.col("type_site").alias("_t"), F.col("mean_price").alias("_v"), average_pct().alias("_pct"), "n")
    stats = stats.join(ranked, (F.col("type_site") == F.col("_t")) & (F.col("mean_price") == F.col("_v")), "left")
    # a type without a row here has no price at all, and a name without a price has the middle
    counts = stats.groupBy("type_site").agg(F.coalesce(F.max("n"), F.lit(0)).alias("_n"))
    stats = stats.join(small(counts), "type_site")
    is_cold = (F.col("_n") < cold) | (F.col("type_site") == UNKNOWN_TYPE)
    stats = stats.select("_k1", "_k2", F.when(is_cold, 0.5).otherwise(F.coalesce("_pct", F.lit(0.5))).alias("_p"), F.when(is_cold, 1).otherwise(0).alias("_c"))
    out = df.join(stats, ["_k1", "_k2"], "left").drop("_k1", "_k2")
    return out.withColumn("percentil_precio_absoluto_dentro_tipo", F.coalesce("_p", F.lit(0.5))).withColumn("flag_cold_start_tipo", F.coalesce("_c", F.lit(1))).drop("_p", "_c")


def cold_types(means: DataFrame, cold: int = COLD) -> DataFrame:
    """type_site, conteo, es_cold_start of a reference's means."""
    counts = means.groupBy("type_site").agg(F.count("mean_price").alias("conteo"))
    return counts.withColumn("es_cold_start", (F.col("conteo") < cold) | (F.col("type_site") == UNKNOWN_TYPE))


def percentile_reference(df: DataFrame, price: str | None = None, name: str = "logical_seat_category", cold: int = COLD) -> DataFrame:
    """type_site, conteo, es_cold_start, bin_edges (101 interpolated quantiles)."""
    price = price or first_present(df, PRICE_REFERENCE)
    means = materialise(mean_prices(df, price, name), "mean-prices")
    edges = quantiles(means, ["type_site"], "mean_price").groupBy("type_site").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda x: x["q"]).alias("bin_edges"))  # 101 a type
    return cold_types(means, cold).join(edges, "type_site", "left").select("type_site", "conteo", "bin_edges", "es_cold_start")


def reference_prices(df: DataFrame, price: str | None = None, name: str = "logical_seat_category") -> DataFrame:
    """The reference's prices in long form: type_site, mean_price. Not gathered in arrays, so a type may have any number."""
    price = price or first_present(df, PRICE_REFERENCE)
    return mean_prices(df, price, name).where("mean_price IS NOT NULL").select("type_site", "mean_price")


def percentile_of(df: DataFrame, prices: DataFrame, reference: DataFrame, price: str = "med_base_unit_amt_itx") -> DataFrame:
    """Adds the percentile of each price among its type's reference prices: (below + up to it + 1 if any equals) / 2n.

    Both sides are reduced to distinct (type, price) and take their positions in the union of both, in which asked prices have no
    copies: an as-of style join without an array of the reference, a nested loop or a type in one task. A missing price counts as 0.
    """
    x = F.coalesce(F.col(price).cast("double"), F.lit(0.0))
    df = df.withColumn("_x", x)
    asked = df.select("type_site", F.col("_x").alias("v")).distinct().withColumn("k", F.lit(0).cast("long"))
    given = prices.groupBy("type_site", F.col("mean_price").alias("v")).agg(F.count("*").alias("k"))
    p = positions(asked.unionByName(given), ["type_site"], "v", "k")
    ranked = p.select("type_site", F.col("v").alias("_x"), F.when(F.col("n") > 0, (2 * F.col("below") + F.col("k") + F.when(F.col("k") > 0, 1).otherwise(0)) / (2 * F.when(F.col("n") > 0, F.col("n")))).alias("_p"))
    cold = reference.select("type_site", F.col("es_cold_start").alias("_cold"))
    out = df.join(ranked, ["type_site", "_x"], "left").join(small(cold), "type_site", "left")
    is_cold = F.coalesce("_cold", F.lit(True))
    return out.withColumn("percentil_precio_absoluto_dentro_tipo", F.when(is_cold, 0.5).otherwise(F.coalesce("_p", F.lit(0.5)))).withColumn("flag_cold_start_tipo", F.when(is_cold, 1).otherwise(0)).drop("_x", "_p", "_cold")
