"""Rows picked per group, per stratum, and by order; sets of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialise

#: Strata of event quota, by upper bound.
STRATA = (("micro", 500), ("pequeno", 2000), ("mediano", 8000), ("grande", 20000), ("estadio", None))


def best_per_group(df: DataFrame, group: str, *order) -> DataFrame:
    """One row a group; the plan limits each group before it sorts."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where("_n = 1").drop("_n")


def top_per_group(df: DataFrame, group: str, name: str, n: int, *order) -> DataFrame:
    """The best row of each name, then the n best names of each group."""
    one = df.withColumn("_k", F.row_number().over(Window.partitionBy(group, name).orderBy(*order))).where("_k = 1").drop("_k")
    return one.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= n)


def stratum(quota: Column, strata: Sequence[tuple[str, float | None]] = STRATA) -> Column:
    return F.coalesce(*[F.when(quota <= top, F.lit(name)) for name, top in strata if top is not None], F.lit(strata[-1][0]))


def event_summary(df: DataFrame) -> DataFrame:
    """Per event: product, site, quota, number of seat names."""
    return df.groupBy("t_performance_id").agg(F.min("product").alias("product"), F.min("site").alias("site"), F.max("performance_quota").alias("performance_quota"), F.count_distinct("logical_seat_category").alias("n_localidades"))


def pick_strata(events: DataFrame, least_names: int = 4, preferred: dict[str, int] | None = None, strata=STRATA) -> DataFrame:
    """One event per stratum with distinct sites: a preferred one, the one with most names, or the nearest in quota. Five strata
    give five bounded look-ups; each reads one row."""
    pool = materialise(events.where(F.col("n_localidades") >= least_names).withColumn("estrato_real", stratum(F.col("performance_quota"), strata)), "pool")  # read for each
    used, rows = [], []
    low = 0.0
    for name, top in strata:
        free = pool.where(~F.col("site").isin(used)) if used else pool
        row = None
        if preferred and name in preferred:
            row = free.where(F.col("t_performance_id") == preferred[name]).first()
        row = row or free.where(F.col("estrato_real") == name).orderBy(F.desc("n_localidades"), "t_performance_id").first()
        middle = (low + (top if top is not None else 30000)) / 2
        row = row or free.orderBy(F.abs(F.col("performance_quota") - middle), "t_performance_id").first() or pool.orderBy(F.abs(F.col("performance_quota") - middle), "t_performance_id").first()
        if row is not None:
            used.append(row["site"])
            rows.append((row["t_performance_id"], row["product"], row["site"], float(row["performance_quota"]), int(row["n_localidades"]), name, row["estrato_real"]))
        low = top or low
    return events.sparkSession.createDataFrame(rows, "t_performance_id long, product string, site string, performance_quota double, n_localidades int, estrato_objetivo string, estrato_real string")


def top_share(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The n most common values with their share of all rows."""
    total = df.agg(F.count("*").alias("total"))
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n).crossJoin(total).select(column, "n", (100 * F.col("n") / F.col("total")).alias("pct"))


def price_ladder(df: DataFrame, event, price: str, n: int = 12) -> DataFrame:
    """Highest prices of one event, with the number of rows beyond."""
    rows = df.where(F.col("t_performance_id") == event)
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(F.desc(price), "logical_seat_category").limit(n).select("logical_seat_category", price).crossJoin(total).withColumn("rest", F.greatest(F.col("total") - n, F.lit(0))).drop("total")


def name_matches(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose name holds a match of the pattern, in either case; a null name has none."""
    return df.where(F.col(column).rlike(f"(?i){pattern}"))


def event_detail(df: DataFrame, event) -> DataFrame:
    """All rows of one event, each with the event's number of rows and sum of quotas."""
    w = Window.partitionBy("t_performance_id")
    return df.where(F.col("t_performance_id") == event).withColumn("event_rows", F.count("*").over(w)).withColumn("event_sum", F.sum("dn_quota").over(w))


def dear_general(df: DataFrame, types: Sequence[str] = ("teatro", "auditorio"), over: float = 0.60, archetype_cluster: str = "cluster") -> DataFrame:
    """Rows named GENERAL in venues of the types whose price percentile within the type is above `over`, single-zone rows (-1) aside."""
    general = F.coalesce(F.col("texto_limpio"), F.lit("")).rlike(r"\bGENERAL\b")
    return df.where(F.col("type_site").isin(*types) & general & (F.col("percentil_precio_absoluto_dentro_tipo") > over) & (F.col(archetype_cluster) != -1))


def representatives(df: DataFrame, group: str, score: str = "score_confianza", border: str = "es_frontera", *ties: str) -> DataFrame:
    """One row a group: the surest that is off the border, or the surest where all are on it."""
    return best_per_group(df, group, F.coalesce(F.col(border), F.lit(False)), F.desc_nulls_last(score), *ties)


#: Clusters of the gallery's two groups, and how many cards each may hold.
PREMIUM = ("VIP-0", "VIP-1", "VIP-2", "PPF-0", "PPF-1", "PPF-2")
MASS = ("PGI-0", "PGI-1", "PGI-2", "PGI-3", "POP-0", "POP-1", "POP-2", "POP-3", "GGM-0", "GGM-1", "GGM-2")
GALLERY = (("premium", PREMIUM, 8), ("masivos", MASS, 12))


def gallery(df: DataFrame, groups=GALLERY, single: str = "AU-0", excluded: Sequence[str] = (), tie: str = "_row_id") -> DataFrame:
    """Cards with `grupo` and `caso`: the report's bounded pick (its caps are the feature).

    Each group takes the best row of each of its clusters off the border, then the second best names of its most populous
    clusters (by distinct names) up to its cap. Then come two rows of the single-zone cluster, the two least sure border rows and
    the surest hybrid. Ties go by `tie`. Empty clusters give nothing; a null label is no hybrid.
    """
    id_, name, score = "micro_cluster_id", "logical_seat_category", "score_confianza"
    df = df.where(~F.col(id_).isin(*excluded)) if excluded else df
    off = ~F.coalesce(F.col("es_frontera"), F.lit(False))
    best = (F.desc_nulls_last(score), F.col(tie))
    group = F.coalesce(*[F.when(F.col(id_).isin(*ids), F.lit(g)) for g, ids, _ in groups])
    top = top_per_group(df.where(off & group.isNotNull()), id_, name, 2, *best)
    names = df.where(off & group.isNotNull()).groupBy(id_).agg(F.count_distinct(name).alias("_names"))
    ranked = top.join(names, id_).withColumn("grupo", group)
    order = (F.col("rank"), F.when(F.col("rank") == 2, -F.col("_names")), F.col(id_))
    ranked = ranked.withColumn("_card", F.row_number().over(Window.partitionBy("grupo").orderBy(*order)))
    most = F.coalesce(*[F.when(F.col("grupo") == g, F.lit(n)) for g, _, n in groups])
    cards = ranked.where((F.col("rank") == 1) | (F.col("_card") <= most)).withColumn("caso", F.lit("representante")).drop("rank", "_names", "_card")
    special = lambda rows, case, n, *by: rows.orderBy(*by).limit(n).withColumn("grupo", F.lit("especiales")).withColumn("caso", F.lit(case))
    alone = special(df.where(off & (F.col(id_) == single)), "representante", 2, *best)
    edge = special(df.where("es_frontera"), "frontera", 2, F.asc_nulls_last(score), tie)
    mixed = special(df.where(off & F.col("label_auto").startswith("hibrido")), "hibrido", 1, *best)
    return cards.unionByName(alone).unionByName(edge).unionByName(mixed)


def count_bucket(n: Column) -> Column:
    """1 to 5, or more."""
    return F.when(n <= 5, n.cast("string")).otherwise(F.lit(">5"))
