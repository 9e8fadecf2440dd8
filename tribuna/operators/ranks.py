"""Exact ranks and percentiles without a group in one task.

Values are reduced to distinct (group, value, copies), dealt into ranges of (group, value), and written with the number of their
range. A small table holds the copies of each group in each range; its running sums are the offsets of the ranges, and a window
within (range, group) does the rest. So a group of any size is spread over all ranges, one value is one row, and a percentile is
the lookup of two positions.

Defined cases: null values have no position; a null group is a group; NaN sorts last; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialise

#: Largest table that may be sent to all executors.
SMALL_ROWS, SMALL_BYTES = 200_000, 64 << 20


def small(df: DataFrame, most: int = SMALL_ROWS, most_bytes: int = SMALL_BYTES) -> DataFrame:
    """df marked for broadcast if it is measured to have at most `most` rows and `most_bytes`, else as it is: Spark joins it by a shuffle then."""
    size = F.lit(0).cast("long")
    for c, kind in df.dtypes:
        cell = F.octet_length(c) if kind in ("string", "binary") else F.octet_length(F.to_json(c)) if kind.startswith(("array", "struct", "map")) else F.lit(8)
        size = size + F.coalesce(cell, F.lit(0)) + 8
    n, held = df.limit(most + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= most and held <= most_bytes else df


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[k])
    return out


def positions(df: DataFrame, keys: Sequence[str], value: str, copies: str | None = None, ranges: int | None = None) -> DataFrame:
    """keys, value, k (its copies), below (copies of smaller values in the group), n (copies of the group)."""
    spark, keys = df.sparkSession, list(keys)
    k = F.sum(copies) if copies else F.count("*")
    distinct = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(k.cast("long").alias("k"))
    n_ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(distinct.repartitionByRange(n_ranges, *keys, value).withColumn("_range", F.spark_partition_id()), "ranges")
    per_range = dealt.groupBy("_range", *keys).agg(F.sum("k").alias("_in"))
    of_group = Window.partitionBy(*keys)
    before = F.sum("_in").over(of_group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = per_range.select("_range", *keys, F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_in").over(of_group).alias("n"))
    o = small(materialise(offsets, "offsets")).alias("o")
    joined = dealt.join(o, (dealt["_range"] == o["_range"]) & _same(dealt, o, keys)).select(dealt["*"], o["_before"], o["n"])
    within = Window.partitionBy("_range", *keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return joined.select(*keys, value, "k", (F.col("_before") + F.coalesce(F.sum("k").over(within), F.lit(0))).alias("below"), "n")


def average_pct(below: Column | str = "below", k: Column | str = "k", n: Column | str = "n") -> Column:
    """Percentile rank with average ties of rows of positions()."""
    below, k, n = (F.col(x) if isinstance(x, str) else x for x in (below, k, n))
    return (below + (k + 1) / 2) / n


#: Equal steps that a group's span of values is counted in.
STEPS = 4096


def _around(df: DataFrame, keys: Sequence[str], value: str, parts: int, wanted: Sequence[int]) -> DataFrame:
    """positions() of the values that hold the wanted quantiles: values are counted in equal steps between the group's least and greatest,
    and only those of a step that holds a wanted position (or the next) are dealt. df has keys, value and _k, and is read three times."""
    keys = list(keys)
    finite = F.when(F.abs(F.col(value)) < float("inf"), F.col(value))  # NaN is above infinity here
    ends = small(materialise(df.groupBy(*keys).agg(F.sum("_k").alias("_total"), F.min(finite).alias("_lo"), F.max(finite).alias("_hi")), "ends"))
    at = F.floor(F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo")) * STEPS)  # never falls as the value rises
    step = F.when(F.isnan(value), STEPS + 3).when(F.col(value) == float("inf"), STEPS + 2).when(F.col(value) == float("-inf"), -1).when(F.col("_hi") - F.col("_lo") > 0, F.when(F.col("_hi") - F.col("_lo") < float("inf"), at).otherwise(0)).otherwise(0).cast("int")
    same = lambda a, b: F.expr(" AND ".join(f"{a}.`{k}` <=> {b}.`{k}`" for k in keys) or "true")
    stepped = df.alias("d").join(ends.alias("e"), same("d", "e")).select("d.*", "_total", step.alias("_step"))
    counts = stepped.groupBy(*keys, "_step", "_total").agg(F.sum("_k").alias("_in"))
    before = F.coalesce(F.sum("_in").over(Window.partitionBy(*keys).orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # some thousand steps a group
    counts = counts.withColumn("_ahead", before)
    low = [F.expr(f"({i} * (_total - 1)) div {parts}") for i in wanted]
    needed = [(p >= F.col("_ahead")) & (p < F.col("_ahead") + F.col("_in")) for i in low for p in (i, F.least(i + 1, F.col("_total") - 1))]
    picked = small(materialise(counts.where(F.greatest(*needed) if len(needed) > 1 else needed[0]).select(*keys, "_step", "_ahead"), "steps"))
    near = stepped.alias("s").join(picked.alias("p"), same("s", "p") & F.expr("s._step = p._step")).select("s.*", "_ahead")
    p = positions(near, [*keys, "_step", "_ahead", "_total"], value, "_k")
    return p.select(*keys, value, "k", (F.col("_ahead") + F.col("below")).alias("below"), F.col("_total").alias("n"))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, parts: int = 100, wanted: Sequence[int] | None = None, copies: str | None = None, stored: bool = False) -> DataFrame:
    """keys, n, i, q: the interpolated quantile i / parts for i in `wanted` (0 to parts by default), of each group with a value.
    stored: df is cheap to read again.

    A few wanted ones are found by counting, so that few values are sorted at all; all of them need every position."""
    if wanted is not None and dict(df.dtypes)[value] in ("double", "float"):
        data = df.where(F.col(value).isNotNull()).select(*keys, value, (F.col(copies) if copies else F.lit(1)).cast("long").alias("_k"))
        p = _around(data if stored else materialise(data, "values"), keys, value, parts, [int(x) for x in wanted])
    else:
        p = positions(df, keys, value, copies)
    m, last = F.lit(parts).cast("long"), F.col("n") - 1
    # the quantile's lower position floor(i * last / parts) lies in this row's from `a` to before `b`: whole numbers only
    whole = lambda x: F.when(last > 0, F.expr(f"({x} * {parts} + n - 2) div (n - 1)")).otherwise(F.lit(0))
    ends = lambda x: F.when(last > 0, F.least(whole(x), m + 1)).otherwise(m + 1)
    span = lambda a, b: F.when(F.greatest(a, F.lit(0)) < b, F.sequence(F.greatest(a, F.lit(0)), b - 1)).otherwise(F.array().cast("array<bigint>"))
    low = span(whole("below"), ends("(below + k)"))
    # the higher position is the next one, or the last itself for i = parts
    high = span(F.when(last > 0, F.when(F.col("below") > 0, whole("(below - 1)")).otherwise(F.lit(0))).otherwise(F.lit(0)), F.when(F.col("below") + F.col("k") == F.col("n"), m + 1).otherwise(ends("(below + k - 1)")))
    keep = (lambda a: F.filter(a, lambda i: i.isin([int(x) for x in wanted]))) if wanted is not None else (lambda a: a)
    sides = p.select(*keys, "n", value, F.explode(F.concat(F.transform(keep(low), lambda i: F.struct(i.alias("i"), F.lit(0).alias("side"))), F.transform(keep(high), lambda i: F.struct(i.alias("i"), F.lit(1).alias("side"))))).alias("_x"))
    got = sides.groupBy(*keys, F.col("_x.i").alias("i")).agg(F.max("n").alias("n"), F.max(F.when(F.col("_x.side") == 0, F.col(value))).alias("_lo"), F.max(F.when(F.col("_x.side") == 1, F.col(value))).alias("_hi"))
    part = (F.col("i") * last % m) / m
    return got.select(*keys, "n", "i", F.when(part == 0, F.col("_lo")).otherwise(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * part).alias("q"))


def global_rank(df: DataFrame, order: str, out: str = "rank") -> DataFrame:
    """order's distinct values and their rank from 1 among them, nulls left out."""
    p = positions(df.select(order).distinct().withColumn("_all", F.lit(0)), ["_all"], order)
    return p.select(order, (F.col("below") + 1).alias(out))
