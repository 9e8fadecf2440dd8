"""How queries are registered."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Collects queries and their SQL by a decorator."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, as the SQL rounds them; -0.0 is 0.0."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_KEPT: dict[tuple, object] = {}


def input_state(spark: SparkSession, sf_dir: str, tables: tuple[str, ...]) -> int:
    """A number of the files, sizes and times of tables: another one as soon as an input is written anew. Footers are not read."""
    states = []
    for t in tables:
        files = spark.read.parquet(f"{sf_dir}/{t}.parquet").select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
        states.append(files.agg(F.count("*"), F.sum(F.xxhash64("file_path", "file_size", "file_modification_time").cast("decimal(38,0)"))).first())
    return hash(tuple(tuple(s) for s in states))


def kept(*tables: str) -> Callable:
    """Keeps what f(spark, sf_dir) gave for the present state of its tables, in this application: queries of one model share its fit."""

    def wrap(f: Callable) -> Callable:
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str):
            key = (spark.sparkContext.applicationId, f.__module__, f.__name__, sf_dir, input_state(spark, sf_dir, tables))
            if key not in _KEPT:
                _KEPT[key] = f(spark, sf_dir)
            return _KEPT[key]

        return run

    return wrap


#: Tables that the seat inventory is made from.
INVENTORY = ("lineitem", "orders", "customer", "part")
