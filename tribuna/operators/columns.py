"""Plan-time choices that depend on which columns a table has; they cost nothing at run time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Candidates for the price column, in order, per use; and for the name column.
PRICE_FILTER = ("med_base_unit_amt_itx", "med_total_unit_amt_itx", "ave_base_unit_amt_itx", "precio")
PRICE_METRICS = ("med_base_unit_amt_itx", "ave_base_unit_amt_itx", "ave_unit_amt_itx", "med_total_unit_amt_itx", "precio")
PRICE_REFERENCE = ("med_base_unit_amt_itx", "ave_base_unit_amt_itx")
NAME = ("logical_seat_category", "texto_limpio", "localidad")


def first_present(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """The first candidate that df has."""
    return next((c for c in candidates if c in df.columns), None)


def column_or(df: DataFrame, name: str, default=None) -> Column:
    """The column, or its default: 0.50 for percentiles, 0.0 for other numbers unless one is given."""
    if name in df.columns:
        return F.col(name)
    return F.lit((0.50 if name.startswith("percentil") else 0.0) if default is None else default)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing numbers are null from ingest on; Spark would order and compare NaN as a number."""
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def with_row_id(df: DataFrame) -> DataFrame:
    """_row_id, for contracts on order and identity; unique and increasing within a partition."""
    return df.withColumn("_row_id", F.monotonically_increasing_id())


def ratio(num: Column, den: Column) -> Column:
    """num / den as clipping to [0, 1] sees it: x/0 is 1 or 0 by sign, 0/0 is null; never an error."""
    safe = num / F.when(den != 0, den)
    clipped = F.when(safe.isNotNull(), F.least(F.greatest(safe, F.lit(0.0)), F.lit(1.0)))  # least and greatest pass over nulls
    return F.when(den == 0, F.when(num > 0, 1.0).when(num < 0, 0.0)).otherwise(clipped)
