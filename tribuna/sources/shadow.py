"""A shadow run: predictions of a lot, their report and one audit line, under one identity.

The identity names the lot and the model. Predictions are written in one pass, and the counters of the report are observed in that
pass. Then the report is written as one JSON document, and last the audit line, whose presence says that the run is complete. A
run that failed is done again from the start and writes over what it left; a run that is complete is not done again, so there is one
line an identity, however often it is called.

Defined cases: an empty lot has shares of 0 and means of null; archetypes and micro-clusters that the caller does not list count as
`others`; without a reference the micro-clusters are held against equal shares.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from datetime import UTC, datetime
from decimal import ROUND_HALF_UP, Decimal

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import input_checks

EPS, ALERT, PSI_ALERT, REVIEW, CRITICAL = 1e-4, 0.08, 0.10, 0.10, 0.25
COLUMNS = ("micro_cluster_id", "label_auto", "arquetipo_demanda", "score_confianza", "es_frontera")


def half_up(x: float, digits: int) -> float:
    """Rounded as SQL rounds: halves of the shortest decimal go away from 0. Python's round would see the binary value just beside it."""
    return float(Decimal(repr(float(x))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) if math.isfinite(x) else x


def identity(lot: str, version: str) -> str:
    """A name for the pair, fit for a folder."""
    return "".join(c if c.isalnum() or c in "-_." else "-" for c in f"{lot}-v{version}")


def write_document(spark: SparkSession, document: dict, path: str) -> None:
    """One JSON document in a folder of its own, in any store."""
    spark.createDataFrame([(json.dumps(document, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_document(spark: SparkSession, path: str) -> dict | None:
    """The document; None if it is not there."""
    try:
        rows = spark.read.text(path, wholetext=True).collect()  # one document
    except AnalysisException:
        return None
    return json.loads(rows[0]["value"]) if rows else None


def shares_against(observed: dict[str, int], reference: dict[str, float], total: int) -> dict:
    """psi, state, deviations and alerts of observed counts against reference shares, over the reference's categories."""
    out: dict = {"psi_global": 0.0, "distribution": {}, "alertas": []}
    for name in sorted(reference):
        p, q = reference[name], observed.get(name, 0) / max(total, 1)
        a, e = max(q, EPS), max(p, EPS)
        out["psi_global"] += (a - e) * math.log(a / e)
        out["distribution"][name] = {"referencia": half_up(p, 4), "observado": half_up(q, 4), "diferencia": half_up(q - p, 4)}
        if abs(q - p) > ALERT:
            out["alertas"].append(f"Desviacion en micro-cluster {name}: {q - p:+.1%}")
    psi = out["psi_global"]
    out["estado"] = "ESTABLE" if psi < REVIEW else "REVISAR" if psi <= CRITICAL else "DRIFT_CRITICO"
    if psi > CRITICAL:
        out["alertas"].append(f"Drift critico global en micro-clusters (PSI = {psi:.4f})")
    return out


def shadow_run(
    df: DataFrame, predict: Callable[[DataFrame], DataFrame], out: str, lot: str, version: str, archetypes: Sequence[str], micro: Sequence[str],
    reference: dict[str, float] | None = None, expected_rows: int = 33775, psi_alert: float = PSI_ALERT, key: Sequence[str] | None = None,
) -> dict:
    """The report of a run; predictions lie under out/run=<identity>/predictions."""
    spark, name = df.sparkSession, identity(lot, version)
    folder = f"{out.rstrip('/')}/run={name}"
    audit = f"{out.rstrip('/')}/audit/run={name}"
    if (line := read_document(spark, audit)) is not None:
        return line["reporte"]
    began = datetime.now(UTC)
    seen = Observation()
    other = lambda c, known: F.count_if(~F.coalesce(F.col(c).isin(*known), F.lit(False)))
    counters = [F.count("*").alias("n"), F.avg(F.col("es_frontera").cast("double")).alias("frontera"), F.avg("score_confianza").alias("confianza"), other("arquetipo_demanda", archetypes).alias("a_others"), other("micro_cluster_id", micro).alias("m_others")]
    counters += [F.count_if(F.col("arquetipo_demanda") == a).alias(f"a_{i}") for i, a in enumerate(archetypes)]
    counters += [F.count_if(F.col("micro_cluster_id") == m).alias(f"m_{i}") for i, m in enumerate(micro)]
    predicted = predict(df)
    predicted.select(*df.columns, *[c for c in COLUMNS if c not in df.columns]).observe(seen, *counters).write.mode("overwrite").parquet(f"{folder}/predictions")
    got = seen.get
    n = got["n"]
    per = {m: got[f"m_{i}"] for i, m in enumerate(micro)}
    drift = shares_against(per, reference or {m: 1 / len(micro) for m in micro}, n)
    pct = lambda k: half_up(100 * k / n, 2) if n else 0.0
    report = {
        "run": name, "version_modelo": version, "total_registros": n, "tasa_frontera_pct": None if got["frontera"] is None else half_up(100 * got["frontera"], 2), "confianza_media": None if got["confianza"] is None else half_up(got["confianza"], 4),
        "macro": {a: {"n": got[f"a_{i}"], "pct": pct(got[f"a_{i}"])} for i, a in enumerate(archetypes)} | {"others": {"n": got["a_others"], "pct": pct(got["a_others"])}},
        "micro": {m: {"n": k, "pct": pct(k)} for m, k in per.items()} | {"others": {"n": got["m_others"], "pct": pct(got["m_others"])}},
        "checks": {r["check"]: r["value"] for r in input_checks(df, expected_rows, key).collect()}, "psi_global": half_up(drift["psi_global"], 4), "estado_drift": drift["estado"], "umbral_psi": psi_alert,
        "alerta_activa": drift["psi_global"] >= psi_alert or bool(drift["alertas"]), "alertas": drift["alertas"], "desviaciones": drift["distribution"],
    }
    write_document(spark, report | {"fecha_ejecucion": began.isoformat()}, f"{folder}/report")
    write_document(spark, {"run": name, "fecha_ejecucion": began.isoformat(), "segundos": round((datetime.now(UTC) - began).total_seconds(), 2), "reporte": report}, audit)
    return report


def report_rows(spark: SparkSession, report: dict) -> DataFrame:
    """section, name, value: the report in long form."""
    rows = [("total", "total_registros", float(report["total_registros"])), ("total", "psi_global", report["psi_global"]), ("total", "tasa_frontera_pct", report["tasa_frontera_pct"]), ("total", "confianza_media", report["confianza_media"])]
    rows += [("check", k, v) for k, v in report["checks"].items()]
    rows += [(level, k, float(v["n"])) for level in ("macro", "micro") for k, v in report[level].items()]
    return spark.createDataFrame(rows, "section string, name string, value double")
