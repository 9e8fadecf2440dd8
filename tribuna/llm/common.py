"""Shared helpers of the training-data operators: scratch tables, table access, null handling."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Name under which a local session without spark.checkpoint.dir keeps its scratch folder.
_OWN: dict[str, str] = {}
#: Rows of an Arrow batch that become Python objects at once. Spark itself bounds the bytes of a batch (64 MB by default).
SLICE_ROWS = 256


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: spark.checkpoint.dir; a local one where the master is local and it is unset.

    On a cluster each executor would write a folder of its own, so an unset spark.checkpoint.dir is an error there."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors share (master is {master})")
        path = _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="tribuna-"))
    return path.rstrip("/")


def fresh(df: DataFrame, name: str) -> str:
    """`name`, or it with underscores until no column of df is called so (names are compared without case, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def arrow_types(fields: str) -> list:
    """Arrow types of the columns of a DDL string."""
    return list(to_arrow_schema(StructType.fromDDL(fields)).types)


def slices(batches: Iterator, rows: int = SLICE_ROWS) -> Iterator:
    """Arrow batches in slices of a bounded number of rows; nothing is copied."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def record_batch(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    """Rows as an Arrow batch of the given types: long integers beside nulls stay what they are."""
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, t in enumerate(types)], names=names)


def add_columns(source: DataFrame, column: str, make: Callable[[], Callable], fields: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """source and the columns `fields` (DDL) that make()(value of `column`) gives as a tuple; make is called once a task.

    All columns of source (but those of `drop`) pass as Arrow data, untouched: an id keeps its type and value whatever stands
    beside it. One narrow step, in input order."""
    kept = [c for c in source.columns if c not in drop]
    added, types = [f.name for f in StructType.fromDDL(fields).fields], arrow_types(fields)
    schema = StructType([source.schema[c] for c in kept] + StructType.fromDDL(fields).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for part in slices(batches):
            rows = [f(x) for x in part.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *record_batch(rows, added, types).columns], names=[*kept, *added])

    return source.mapInArrow(run, schema)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder for one run of one step, so that reruns and parallel queries never meet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(df: DataFrame, column: str = "text"):
    """The text column with null read as the empty text."""
    return F.coalesce(df[column], F.lit(""))


def local_path(uri: str) -> str | None:
    """Path of a file: URI or plain path; None for other stores."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if "://" not in uri else None


def filesystem(uri: str):
    """(pyarrow filesystem, path) for any store that pyarrow reaches; file: needs no further library."""
    from pyarrow import fs

    path = local_path(uri)
    return (fs.LocalFileSystem(), path) if path is not None else fs.FileSystem.from_uri(uri)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public vocabulary file, as the installed package of vocabularies gives it."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


#: Largest table that is sent to all executors (rows of a key and some numbers), and shares of a hot key where it is larger.
SMALL_ROWS, SALTS = 100_000, 32


def join_lookup(df: DataFrame, lookup: DataFrame, keys: list[str], most: int = SMALL_ROWS) -> DataFrame:
    """df and the columns of a lookup with one row for each value of the keys (nulls are values); rows without one are left out.

    The lookup goes to all executors if a count shows at most `most` rows. Else it is joined by a shuffle in which every key is
    dealt over SALTS shares, so that a key with a third of all rows is no single task's."""
    left, right = {c: fresh(df, f"_l_{c}") for c in keys}, [c for c in lookup.columns if c not in keys]
    small = lookup.select(*[F.col(c).alias(left[c]) for c in keys], *right)
    same = F.lit(True)
    for c in keys:
        same = same & df[c].eqNullSafe(F.col(left[c]))
    if lookup.limit(most + 1).count() <= most:
        return df.join(F.broadcast(small), same).drop(*left.values())
    share = fresh(df, "_share")
    df = df.withColumn(share, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(SALTS)))
    small = small.withColumn("_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return df.join(small, same & (df[share] == small["_of"])).drop(*left.values(), share, "_of")
