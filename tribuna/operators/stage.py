"""The two-stage model as a Spark ML stage: an estimator, and a model with its references, kept by Pipeline.save.

The model holds the fitted space, centres, labels and mixture, and what later lots are held against: histograms of the monitored
variables, shares of the archetypes, and the prices of each venue type with its count. The references are tables beside the model
in its folder, so they may have any size; the rest is one JSON row.

Defined cases: a model that was fitted without `references` has empty ones: percentiles stay as the rows have them, and a drift report
says that there is no reference; loading a model of another version warns; rows without multi-zone events cannot be fitted.
"""

from __future__ import annotations

import json
import warnings
from dataclasses import asdict

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cluster, drift
from .percentile import percentile_of, percentile_reference, reference_prices
from .relative import split_flag
from .space import Space

VERSION = "1"
MONITORED = ("ratio_precio_max", "percentil_precio_evento", "peso_aforo", "percentil_precio_absoluto_dentro_tipo")
PRICE, PERCENTILE = "med_base_unit_amt_itx", "percentil_precio_absoluto_dentro_tipo"


class _Shared(Params):
    k = Param(Params._dummy(), "k", "number of clusters of multi-zone events", TypeConverters.toInt)
    textWeight = Param(Params._dummy(), "textWeight", "weight of the terms in the space", TypeConverters.toFloat)
    references = Param(Params._dummy(), "references", "whether the model keeps drift and percentile references", TypeConverters.toBoolean)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(k=5, textWeight=0.2, references=True)


class ArchetypeClusterer(_Shared, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Fits on enriched rows (relative metrics, venue type, percentile, text features)."""

    @keyword_only
    def __init__(self, *, k: int = 5, textWeight: float = 0.2, references: bool = True) -> None:
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> ArchetypeModel:
        fitted = cluster.train_two_stage(df, self.getOrDefault("k"), text_weight=self.getOrDefault("textWeight"))
        out = ArchetypeModel(fitted)
        if self.getOrDefault("references"):
            multi = split_flag(df).where("NOT es_monozona")
            values = drift.long_values(multi, [c for c in MONITORED if c in df.columns])
            limits = drift.ranges(values)
            out.histograms = drift.histogram(values, limits).join(limits, "variable")
            out.shares = drift.shares(cluster.predict_two_stage(df, fitted), "arquetipo_demanda")
            if {"site", "type_site", "logical_seat_category", PRICE} <= set(df.columns):
                out.prices, out.types = reference_prices(df, PRICE), percentile_reference(df, PRICE)
        return self._copyValues(out)


class ArchetypeModel(_Shared, Model, MLWritable, MLReadable):
    """The fitted stage."""

    TABLES = ("histograms", "shares", "prices", "types")

    def __init__(self, fitted: cluster.Model | None = None) -> None:
        super().__init__()
        self.fitted, self.version = fitted, VERSION
        self.histograms: DataFrame | None = None
        self.shares: DataFrame | None = None
        self.prices: DataFrame | None = None
        self.types: DataFrame | None = None

    def _transform(self, df: DataFrame) -> DataFrame:
        """Predictions. Rows without a percentile get theirs from the saved prices."""
        if PERCENTILE not in df.columns and self.prices is not None:
            df = percentile_of(df, self.prices, self.types, PRICE)
        return cluster.predict_two_stage(df, self.fitted)

    def drift(self, predicted: DataFrame) -> DataFrame:
        """variable, psi, state of a predicted lot against the saved histograms, and a row for the archetypes' shares."""
        spark = predicted.sparkSession
        if self.histograms is None:
            return spark.createDataFrame([(None, None, drift.NO_REFERENCE)], "variable string, psi double, state string")
        known = [r[0] for r in self.histograms.select("variable").distinct().collect()]  # some five
        values = drift.long_values(predicted.where("NOT es_monozona"), [c for c in known if c in predicted.columns])
        limits = self.histograms.select("variable", "lo", "hi").distinct()
        numeric = drift.psi(drift.histogram(values, limits), self.histograms.select("variable", "bin", "n"), "bin", group="variable").withColumn("state", drift.state(F.col("psi")))
        own = drift.micro_drift(predicted, "arquetipo_demanda", self.shares).select(F.lit("arquetipo_demanda").alias("variable"), "psi", drift.state(F.col("psi")).alias("state"))
        return numeric.select("variable", "psi", "state").unionByName(own)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()

    def copy(self, extra=None) -> ArchetypeModel:
        out = super().copy(extra)
        return out


class _Writer(MLWriter):
    def __init__(self, instance: ArchetypeModel) -> None:
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        m, spark = self.instance, self.sparkSession
        tables = [t for t in ArchetypeModel.TABLES if getattr(m, t) is not None]
        DefaultParamsWriter.saveMetadata(m, path, spark, extraMetadata={"version": m.version, "tables": tables})
        spark.createDataFrame([(json.dumps(asdict(m.fitted)),)], "model string").coalesce(1).write.parquet(f"{path}/model")
        for t in tables:
            getattr(m, t).write.parquet(f"{path}/{t}")


class _Reader(MLReader):
    def load(self, path: str) -> ArchetypeModel:
        spark = self.sparkSession
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        if metadata["version"] != VERSION:
            warnings.warn(f"the model has version {metadata['version']}, not {VERSION}", stacklevel=2)
        raw = json.loads(spark.read.parquet(f"{path}/model").first()["model"])
        space = Space(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.pop("space").items()})
        out = ArchetypeModel(cluster.Model(space=space, **raw))
        out.version = metadata["version"]
        for t in metadata["tables"]:
            setattr(out, t, spark.read.parquet(f"{path}/{t}"))
        out._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(out, metadata)
        return out
