"""The outside classifier's ledger and the shadow run's identity."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tribuna.functions.rules import VENUE_TYPES
from tribuna.sources import external, shadow


def counting(path, fail=(), reply=None):
    """A function that makes clients which note each call in a file."""

    def make():
        class Client:
            def generate(self, prompt):
                site = prompt.split("'")[1]
                with open(path, "a") as f:
                    f.write(site + "\n")
                if site in fail:
                    raise TimeoutError("no answer")
                return reply or external.RuleClient().generate(prompt)

        return Client()

    return make


def calls(path):
    return sorted(open(path).read().split("\n")[:-1]) if os.path.exists(path) else []


def test_venues_are_asked_once(spark, tmp_path):
    log, ledger = str(tmp_path / "calls"), str(tmp_path / "ledger")
    venues = spark.createDataFrame([("Teatro A", 10), ("Teatro A", 30), ("Arena B", 5), ("", 1), (None, 2), ("L'Olympia", 7)], "site string, aforo_max int")
    first = external.ask(venues, counting(log), ledger)
    assert calls(log) == ["Arena B", "L Olympia", "Teatro A"]
    got = {r.site: r for r in first.collect()}
    assert set(got) == {"Teatro A", "Arena B", "L'Olympia"}
    assert got["Teatro A"].type_site == VENUE_TYPES[8 % len(VENUE_TYPES)] and got["Teatro A"].confianza == 0.75
    again = external.ask(venues, counting(log), ledger)
    assert calls(log) == ["Arena B", "L Olympia", "Teatro A"]  # a rerun calls nobody
    assert sorted(again.collect()) == sorted(first.collect())
    more = external.ask(venues.union(spark.createDataFrame([("Bar C", 1)], venues.schema)), counting(log), ledger)
    assert calls(log)[1] == "Bar C" and len(calls(log)) == 4 and more.count() == 4
    rows = external.ledger(spark, ledger).collect()
    assert len(rows) == 4 and {r.aforo_max for r in rows if r.site == "Teatro A"} == {30} and all(r.attempts == 1 and r.error is None for r in rows)


def test_failures_are_kept_and_asked_again(spark, tmp_path):
    log, ledger = str(tmp_path / "calls"), str(tmp_path / "ledger")
    venues = spark.createDataFrame([("A", 1), ("B", 1)], "site string, aforo_max int")
    assert [r.site for r in external.ask(venues, counting(log, fail=("B",)), ledger, retries=3).collect()] == ["A"]
    assert calls(log) == ["A", "B", "B", "B"]
    bad = external.ledger(spark, ledger).where("site = 'B'").first()
    assert bad.attempts == 3 and bad.error == "TimeoutError: no answer" and bad.raw_response is None
    assert {r.site for r in external.ask(venues, counting(log), ledger).collect()} == {"A", "B"}
    assert calls(log) == ["A", "B", "B", "B", "B"]
    # no client: nothing is asked, the ledger's answers remain
    other = spark.createDataFrame([("A", 1), ("Z", 1)], "site string, aforo_max int")
    assert {r.site for r in external.ask(other, lambda: None, ledger).collect()} == {"A", "B"}
    assert external.ledger(spark, ledger).where("site = 'Z'").count() == 0
    # another model has answers of its own
    assert {r.site for r in external.ask(other, counting(log), ledger, model="two").collect()} == {"A", "Z"}


@pytest.mark.parametrize("reply,want", [
    ('{"type_site": "CIRCO", "confianza": 0.9}', ("desconocido", 0.9)), ('```json\n{"type_site": " teatro ", "confianza": 1.7}\n```', ("TEATRO", 0.99)), ('{"type_site": "MUSEO"}', ("MUSEO", 0.85)),
    ('{"type_site": "MUSEO", "confianza": 0.1}', ("MUSEO", 0.5)), ('{"confianza": 0.77777}', ("desconocido", 0.778)), ("I think it is a theatre", None), ("", None),
])
def test_replies(spark, tmp_path, reply, want):
    got = external.ask(spark.createDataFrame([("A", 1)], "site string, aforo_max int"), counting(str(tmp_path / "c"), reply=reply or " "), str(tmp_path / "l")).collect()
    assert [(r.type_site, r.confianza) for r in got] == ([want] if want else [])


LOT = "t_performance_id long, product string, dn_quota long, performance_quota long, net_sold_p_qty double, micro string"


def predict(df):
    return df.withColumns({"micro_cluster_id": F.col("micro"), "label_auto": F.lit("x"), "arquetipo_demanda": F.when(F.col("dn_quota") > 5, "big").otherwise("small"), "score_confianza": F.lit(0.5), "es_frontera": F.col("dn_quota") > 8})


def lot(spark):
    return spark.createDataFrame([(i // 3, "p", i, 10, 1.0, ["A", "B", "C"][min(i % 5, 2)]) for i in range(20)], LOT)


def test_shadow_run_counts_and_writes_once(spark, tmp_path):
    out, df = str(tmp_path / "s"), lot(spark)
    run = lambda: shadow.shadow_run(df, predict, out, "may lot", "3.0", ["big"], ["A", "B"], {"A": 0.5, "B": 0.5}, expected_rows=20)
    r = run()
    assert r["run"] == "may-lot-v3.0" and r["total_registros"] == 20 and r["tasa_frontera_pct"] == 55.0 and r["confianza_media"] == 0.5
    assert r["macro"] == {"big": {"n": 14, "pct": 70.0}, "others": {"n": 6, "pct": 30.0}}
    assert {k: v["n"] for k, v in r["micro"].items()} == {"A": 4, "B": 4, "others": 12}
    assert r["checks"]["c_rows"] == 20 and r["estado_drift"] == "DRIFT_CRITICO" and r["alerta_activa"] and len(r["alertas"]) == 3
    written = spark.read.parquet(f"{out}/run=may-lot-v3.0/predictions")
    assert written.count() == 20 and written.columns == [*df.columns, *shadow.COLUMNS]
    before = shadow.read_document(spark, f"{out}/run=may-lot-v3.0/report")
    assert before["macro"] == r["macro"] and run() == r
    assert shadow.read_document(spark, f"{out}/run=may-lot-v3.0/report") == before  # a complete run is not done again
    lines = spark.read.option("wholetext", True).text(f"{out}/audit").collect()
    assert len(lines) == 1 and json.loads(lines[0].value)["reporte"] == r


def test_failed_shadow_run_leaves_one_line(spark, tmp_path, monkeypatch):
    out, df, write = str(tmp_path / "s"), lot(spark), shadow.write_document

    def failing(*args):
        raise OSError("store is away")

    for step in (predict, lambda d: predict(d).withColumn("score_confianza", F.raise_error(F.lit("lost")).cast("double"))):
        monkeypatch.setattr(shadow, "write_document", failing)
        with pytest.raises(Exception, match="store is away|lost"):
            shadow.shadow_run(df, step, out, "l", "1", ["big"], ["A"])
    monkeypatch.setattr(shadow, "write_document", write)
    r = shadow.shadow_run(df, predict, out, "l", "1", ["big"], ["A"])
    shadow.shadow_run(df, predict, out, "l", "1", ["big"], ["A"])
    assert spark.read.option("wholetext", True).text(f"{out}/audit").count() == 1
    assert spark.read.parquet(f"{out}/run=l-v1/predictions").count() == r["total_registros"] == 20


def test_empty_lot(spark, tmp_path):
    r = shadow.shadow_run(lot(spark).limit(0), predict, str(tmp_path / "s"), "l", "1", ["big"], ["A", "B"])
    assert r["total_registros"] == 0 and r["tasa_frontera_pct"] is None and r["macro"]["big"] == {"n": 0, "pct": 0.0}
