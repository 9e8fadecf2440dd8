"""The mixed feature space: robust scaling, tags, weighted one-hot of venue types and tf-idf, as one array column."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import VENUE_TYPES
from ..functions.text import let, terms
from .columns import column_or
from .ranks import quantiles

#: The features of the two spaces and their weights.
NUMERIC = ("ratio_precio_max", "percentil_precio_evento", "peso_aforo", "percentil_precio_absoluto_dentro_tipo")
MACRO_TAGS = ("tag_palco", "tag_vip", "tag_platea", "tag_preferencial", "tag_general", "tag_balcon", "tag_piso_alto")
MICRO_TAGS = (*MACRO_TAGS, "tag_lateral", "tag_occidental", "tag_oriental", "tag_norte", "tag_sur", "tag_mesa")
TYPE_WEIGHT, TEXT_WEIGHT, TERMS = 0.5, 0.2, 15


@dataclass
class Space:
    """Everything that turns a row into its vector."""

    numeric: tuple[str, ...] = NUMERIC
    tags: tuple[str, ...] = MACRO_TAGS
    types: tuple[str, ...] = tuple(VENUE_TYPES)
    type_weight: float = TYPE_WEIGHT
    text_weight: float = TEXT_WEIGHT
    centers: dict[str, float] = field(default_factory=dict)
    scales: dict[str, float] = field(default_factory=dict)
    idf: dict[str, float] = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        types = [f"type_site_{t}" for t in self.types] if self.type_weight else []
        return [*self.numeric, *self.tags, *types, *[f"tfidf_{t}" for t in self.idf]]


def scaling(df: DataFrame, columns: Sequence[str], standard: bool = False, stored: bool = False) -> tuple[dict[str, float], dict[str, float]]:
    """(centres, scales): medians and interquartile ranges with interpolation, or means and deviations; a scale of 0 is 1. stored: df is
    cheap to read again, so its values are not written."""
    if standard:
        row = df.agg(*[F.struct(F.avg(column_or(df, c)).alias("m"), F.stddev_pop(column_or(df, c)).alias("s")).alias(c) for c in columns]).first()
        return {c: row[c]["m"] or 0.0 for c in columns}, {c: row[c]["s"] or 1.0 for c in columns}
    items = F.array(*[F.struct(F.lit(c).alias("c"), column_or(df, c).cast("double").alias("x")) for c in columns])
    got: dict[str, list[float]] = {c: [0.0, 0.0, 1.0] for c in columns}
    for r in quantiles(df.select(F.explode(items).alias("i")).select("i.c", "i.x"), ["c"], "x", 4, (1, 2, 3), stored=stored).collect():  # three numbers a column
        got[r["c"]][r["i"] - 1] = r["q"]
    return {c: q[1] for c, q in got.items()}, {c: (q[2] - q[0]) or 1.0 for c, q in got.items()}


def term_statistics(df: DataFrame, text: str = "texto_limpio") -> DataFrame:
    """term, tf (all occurrences), df (rows that have it)."""
    rows = df.groupBy(text).agg(F.count("*").alias("n")).select(terms(F.col(text)).alias("t"), "n")  # a text is cut once
    cut = rows.select("n", F.explode(F.concat(F.transform("t", lambda x: F.struct(x.alias("term"), F.lit(1).alias("tf"))), F.transform(F.array_distinct("t"), lambda x: F.struct(x.alias("term"), F.lit(0).alias("tf"))))).alias("x"))
    return cut.groupBy("x.term").agg(F.sum(F.col("n") * F.col("x.tf")).alias("tf"), F.sum(F.col("n") * (1 - F.col("x.tf"))).alias("df"))


def vocabulary(df: DataFrame, most: int = TERMS, text: str = "texto_limpio") -> dict[str, float]:
    """term -> smooth idf of the `most` terms by (tf descending, term), in the order of terms."""
    n = df.count()
    top = term_statistics(df, text).orderBy(F.desc("tf"), "term").limit(most).select("term", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf")).collect()
    return {r["term"]: r["idf"] for r in sorted(top, key=lambda r: r["term"])}


def tfidf(text: Column, idf: dict[str, float]) -> Column:
    """Array of L2-normalised tf-idf weights over a frozen vocabulary."""
    if not idf:
        return F.array().cast("array<double>")

    def raw(found: Column) -> Column:
        return F.array(*[F.size(F.filter(found, lambda x: x == F.lit(t))) * F.lit(w) for t, w in idf.items()])

    def unit(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
        return let(norm, lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))))

    return let(let(terms(text), raw), unit)


def fit_space(df: DataFrame, tags: Sequence[str] = MACRO_TAGS, types: bool = True, text_weight: float = TEXT_WEIGHT, most_terms: int = TERMS, text: str = "texto_limpio", stored: bool = False) -> Space:
    centers, scales = scaling(df, NUMERIC, stored=stored)
    return Space(tags=tuple(tags), type_weight=TYPE_WEIGHT if types else 0.0, text_weight=text_weight, centers=centers, scales=scales, idf=vocabulary(df, most_terms, text) if most_terms else {})


def with_features(df: DataFrame, space: Space, text: str = "texto_limpio", out: str = "features") -> DataFrame:
    """Adds the vector; columns that df lacks have their defaults. Terms are one array, not a column each."""
    numeric = [(F.coalesce(column_or(df, c).cast("double"), F.lit(0.0)) - space.centers[c]) / space.scales[c] for c in space.numeric]
    tags = [F.coalesce(column_or(df, c).cast("double"), F.lit(0.0)) for c in space.tags]
    kind = F.col("type_site") if "type_site" in df.columns else F.lit(None).cast("string")
    types = [F.when(kind == t, space.type_weight).otherwise(F.lit(0.0)) for t in space.types] if space.type_weight else []
    vector = F.array(*numeric, *tags, *types)
    if space.idf:
        value = F.col(text) if text in df.columns else F.lit("")
        vector = F.concat(vector, F.transform(tfidf(value, space.idf), lambda x: x * space.text_weight))
    return df.withColumn(out, vector)


def align(vector: Column, present: Sequence[str], wanted: Sequence[str]) -> Column:
    """A vector in the order of `wanted`; what is not present is 0."""
    at = {n: i for i, n in enumerate(present)}
    return F.array(*[vector[at[n]] if n in at else F.lit(0.0) for n in wanted])


def long_form(df: DataFrame, keys: Sequence[str], space: Space, vector: str = "features") -> DataFrame:
    """keys, dim, value."""
    names = F.array(*[F.lit(n) for n in space.names])
    return df.select(*keys, F.explode(F.arrays_zip(names.alias("dim"), F.col(vector).alias("value"))).alias("x")).select(*keys, F.col("x.dim").alias("dim"), F.col("x.value").alias("value"))
