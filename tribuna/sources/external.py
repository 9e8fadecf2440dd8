"""An outside classifier of venues, given by the caller: called once a venue, in tasks, with a ledger of all answers.

The caller passes a function that makes a client; each task makes one and asks it about its venues, with retries. Every call, answered
or not, is a row of the ledger, which is appended by the same step that calls. What to ask is what has no valid answer of this model
in the ledger yet, so a rerun asks about new and failed venues only, and types always come from the ledger. A task that is lost and
run again may ask again; its first rows were never committed, so the ledger has one row for it all the same.

Defined cases: a venue without a name is not asked; a function that makes None (no key, no library) answers nothing and the ledger stays
as it is; an answer that is no JSON, or has no category of the list, counts as `desconocido` with its confidence; of several valid
answers the latest counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import UTC, datetime
from typing import Protocol

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import UNKNOWN_TYPE, VENUE_TYPES

LEDGER = "site string, aforo_max long, modelo_llm string, prompt string, raw_response string, error string, attempts int, asked_at string"
RETRIES, MODEL = 3, "external"


class Client(Protocol):
    """What a caller's client can do: answer a prompt with text, or raise."""

    def generate(self, prompt: str) -> str: ...


class RuleClient:
    """A deterministic stand-in: the category and the confidence follow from the length of the name. For tests and dry runs."""

    def __init__(self, types: Sequence[str] = VENUE_TYPES):
        self.types = list(types)

    def generate(self, prompt: str) -> str:
        n = len(prompt.split("'")[1])
        return f'```json\n{{"type_site": " {self.types[n % len(self.types)].lower()} ", "confianza": {0.70 + n % 7 / 20:.2f}, "justificacion_semantica": "n={n}"}}\n```'


def prompt(site: str = "site", quota: str = "aforo_max", types: Sequence[str] = VENUE_TYPES):
    """The text that asks for a venue's type."""
    return F.format_string("Clasifica el recinto '%s' (aforo %s) en una de: " + ", ".join(types) + ". Responde en JSON.", F.regexp_replace(F.col(site), "'", " "), F.col(quota).cast("string"))


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """All calls so far; none if there is no ledger yet."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], LEDGER)


def answers(calls: DataFrame, model: str = MODEL, types: Sequence[str] = VENUE_TYPES) -> DataFrame:
    """site, type_site, confianza, justificacion_semantica: the latest answer of a model that can be read."""
    body = F.regexp_replace("raw_response", r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", "")
    r = F.from_json(body, "type_site string, confianza double, justificacion_semantica string, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    read = calls.where(F.col("modelo_llm") == model).where("error IS NULL").withColumn("r", r).where("r IS NOT NULL AND r._corrupt IS NULL")
    last = read.groupBy("site").agg(F.max_by("r", F.struct("asked_at", "raw_response")).alias("r"))
    kind = F.upper(F.trim("r.type_site"))
    sure = F.bround(F.least(F.greatest(F.coalesce("r.confianza", F.lit(0.85)), F.lit(0.50)), F.lit(0.99)), 3)
    return last.select("site", F.when(kind.isin(*types), kind).otherwise(F.lit(UNKNOWN_TYPE)).alias("type_site"), sure.alias("confianza"), F.coalesce(F.trim("r.justificacion_semantica"), F.lit("")).alias("justificacion_semantica"))


def ask(venues: DataFrame, make_client: Callable[[], Client | None], path: str, model: str = MODEL, retries: int = RETRIES, parallel: int | None = None, types: Sequence[str] = VENUE_TYPES) -> DataFrame:
    """Asks about the venues (site, aforo_max) that have no answer yet, appends the calls to the ledger, and gives all answers."""
    spark = venues.sparkSession
    done = answers(ledger(spark, path), model, types).select("site")
    todo = venues.where(F.trim("site") != "").groupBy("site").agg(F.max("aforo_max").cast("long").alias("aforo_max")).join(done, "site", "left_anti")
    todo = todo.withColumn("prompt", prompt(types=types)).repartition(parallel or spark.sparkContext.defaultParallelism, "site")
    began = datetime.now(UTC).isoformat()
    names = [f.split()[0] for f in LEDGER.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()]

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = make_client()
        for batch in batches:
            rows = []
            for site, quota, text in zip(*(batch.column(c).to_pylist() for c in ("site", "aforo_max", "prompt"))) if client is not None else ():
                raw = error = None
                for attempt in range(1, retries + 1):
                    try:
                        raw, error = str(client.generate(text)), None
                        break
                    except Exception as e:  # noqa: BLE001  a client may raise anything; the ledger keeps it
                        error = f"{type(e).__name__}: {e}"
                rows.append((site, quota, model, text, raw, error, attempt, began))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    todo.mapInArrow(call, LEDGER).write.mode("append").parquet(path)
    return answers(ledger(spark, path), model, types)
