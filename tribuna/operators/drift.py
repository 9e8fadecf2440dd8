"""Drift between a reference and a lot: fixed histograms, population stability, shares, reports and alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import quantiles, small

EPS, BINS, REVIEW, ALERT, SHARE_ALERT, MICRO_ALERT = 1e-4, 10, 0.10, 0.25, 0.05, 0.08
NO_REFERENCE = "NO_REFERENCE"
#: Expected shares of the archetypes, rows of 33775.
EXPECTED = {
    "Admisión Única / Tarifa Plana": 15375 / 33775,
    "Popular / Balcón / Visibilidad Parcial": 6128 / 33775,
    "VIP / Palcos / Premium": 4885 / 33775,
    "Platea General / Intermedia": 3463 / 33775,
    "Preferencial / Platea Frontal": 2934 / 33775,
    "Grada General / Masiva": 990 / 33775,
}


def long_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """variable, x without nulls."""
    items = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("x")) for c in columns])
    return df.select(F.explode(items).alias("i")).select("i.variable", "i.x").where("x IS NOT NULL")


def bin_of(x: Column, lo: Column, hi: Column, bins: int = BINS) -> Column:
    """Bin 1..bins of [lo, hi], the last one closed on the right; null outside."""
    at = F.floor((x - lo) / (hi - lo) * bins).cast("int") + 1
    return F.when((x >= lo) & (x <= hi), F.least(at, F.lit(bins)))


def ranges(values: DataFrame) -> DataFrame:
    """variable, lo, hi: [0, 1] where the maximum is at most 1.05, else [0, 99.5th percentile]."""
    top = values.groupBy("variable").agg(F.max("x").alias("top"))
    p = quantiles(values, ["variable"], "x", 200, (199,)).select("variable", F.col("q").alias("p"))
    return top.join(p, "variable").select("variable", F.lit(0.0).alias("lo"), F.when(F.col("top") <= 1.05, 1.0).otherwise(F.greatest("p", F.lit(1e-9))).alias("hi"))


def histogram(values: DataFrame, limits: DataFrame, bins: int = BINS) -> DataFrame:
    """variable, bin, n for every bin, also empty ones."""
    counted = values.join(small(limits), "variable").withColumn("bin", bin_of(F.col("x"), F.col("lo"), F.col("hi"), bins)).where("bin IS NOT NULL").groupBy("variable", "bin").agg(F.count("*").alias("n"))
    every = limits.select("variable", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    return every.join(counted, ["variable", "bin"], "left").select("variable", "bin", F.coalesce("n", F.lit(0)).alias("n"))


def psi(actual: DataFrame, expected: DataFrame, key: str, value: str = "n", group: str | None = None, renormalise: bool = True, eps: float = EPS) -> DataFrame:
    """Population stability index per group (or one row): shares clipped at eps; renormalised or not; 0 if a side is empty."""
    keys = [group, key] if group else [key]
    a, e = actual.select(*keys, F.col(value).alias("a")), expected.select(*keys, F.col(value).alias("e"))
    both = a.join(e, keys, "full").fillna(0, ["a", "e"])
    g = Window.partitionBy(group if group else F.lit(1))  # histograms: bins or categories of one variable
    share = lambda c: F.when(F.sum(c).over(g) > 0, F.greatest(F.col(c) / F.when(F.sum(c).over(g) > 0, F.sum(c).over(g)), F.lit(eps)))
    both = both.withColumns({"pa": share("a"), "pe": share("e")})
    if renormalise:
        both = both.withColumns({"pa": F.col("pa") / F.sum("pa").over(g), "pe": F.col("pe") / F.sum("pe").over(g)})
    term = (F.col("pa") - F.col("pe")) * F.log(F.col("pa") / F.col("pe"))
    return both.groupBy(*([group] if group else [])).agg(F.coalesce(F.sum(term), F.lit(0.0)).alias("psi"))


def state(c: Column) -> Column:
    return F.when(c < REVIEW, "ESTABLE").when(c <= ALERT, "REVISAR").otherwise("ALERTA")


def numeric_drift(reference: DataFrame, lot: DataFrame, columns: Sequence[str]) -> DataFrame:
    """variable, psi, state."""
    before = long_values(reference, columns)
    limits = ranges(before)
    out = psi(histogram(long_values(lot, columns), limits), histogram(before, limits), "bin", group="variable")
    return out.withColumn("state", state(F.col("psi")))


def shares(df: DataFrame, column: str) -> DataFrame:
    """column, n, share."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


def share_deviation(lot: DataFrame, column: str, expected: DataFrame, alert: float = SHARE_ALERT) -> DataFrame:
    """column, expected, observed, deviation, alert, over the union of categories. expected: column, share."""
    got = shares(lot, column).select(column, F.col("share").alias("observed"))
    both = expected.select(column, F.col("share").alias("expected")).join(got, column, "full").fillna(0.0, ["expected", "observed"])
    return both.withColumn("deviation", F.col("observed") - F.col("expected")).withColumn("alert", F.abs("deviation") > alert)


def micro_drift(lot: DataFrame, column: str, expected: DataFrame, threshold: float = 0.10) -> DataFrame:
    """One row: psi over categories (clipped, not renormalised; an unknown category expects eps), deviating categories, active."""
    dev = share_deviation(lot, column, expected, MICRO_ALERT)
    pa, pe = F.greatest("observed", F.lit(EPS)), F.greatest("expected", F.lit(EPS))
    out = dev.agg(F.coalesce(F.sum((pa - pe) * F.log(pa / pe)), F.lit(0.0)).alias("psi"), F.count_if("alert").alias("deviating"))
    return out.withColumn("active", (F.col("psi") >= threshold) | (F.col("deviating") > 0))


def drift_report(reference: DataFrame | None, lot: DataFrame, columns: Sequence[str], archetype: str = "arquetipo_demanda") -> DataFrame:
    """One row for a lot: largest psi, variables per state, deviating archetypes, border and little-text shares, mean
    confidence, overall state. Without a reference the state says so instead of being stable by default."""
    multi = lot.where("NOT es_monozona") if "es_monozona" in lot.columns else lot
    mean = lambda c: F.avg(F.col(c).cast("double")) if c in lot.columns else F.lit(None).cast("double")
    base = lot.agg(F.count("*").alias("rows"), mean("es_frontera").alias("border_share"), mean("texto_casi_vacio").alias("little_text_share"), mean("score_confianza").alias("mean_confidence"))
    if reference is None:
        return base.select("*", F.lit(None).cast("double").alias("psi_max"), F.lit(0).cast("long").alias("in_alert"), F.lit(0).cast("long").alias("deviating"), F.lit(NO_REFERENCE).alias("state"))
    ref = reference.where("NOT es_monozona") if "es_monozona" in reference.columns else reference
    n = numeric_drift(ref, multi, columns).agg(F.max("psi").alias("psi_max"), F.count_if(F.col("state") == "ALERTA").alias("in_alert"))
    d = share_deviation(lot, archetype, shares(reference, archetype)).agg(F.count_if("alert").alias("deviating"))
    out = base.crossJoin(n).crossJoin(d)  # single rows
    return out.withColumn("state", F.when((F.col("in_alert") > 0) | (F.col("deviating") > 0), "ALERTA").otherwise(state(F.coalesce("psi_max", F.lit(0.0)))))
