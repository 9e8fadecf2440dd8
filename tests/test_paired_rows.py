"""Two seat rows of one event and number are joined with each other, as the SQL of enriched_rows joins them."""

import os

import duckdb
import pandas as pd
from test_oracle import DIR, TABLES, rows

from tribuna.operators import relative as R
from tribuna.plans.catalogue import ORACLE_SQL, QUERIES


def test_each_row_meets_every_row_of_its_number(spark):
    df = spark.createDataFrame([(1, 7, "a", 2.0), (1, 7, "b", 4.0), (1, 8, "a", 1.0), (2, 7, "c", None), (3, None, "d", 1.0)], "t_performance_id long, _row_id long, seat string, med_base_unit_amt_itx double")
    got = {(r["t_performance_id"], r["_row_id"], r["_own_seat"], r["seat"], r["_price"]) for r in R.paired_rows(df, "_row_id", ["seat"]).collect()}
    assert got == {(1, 7, "a", "a", 2.0), (1, 7, "a", "b", None), (1, 7, "b", "a", None), (1, 7, "b", "b", 4.0), (1, 8, "a", "a", 1.0), (2, 7, "c", "c", None)}


def test_enriched_rows_of_shared_numbers(spark, tmp_path):
    for t in TABLES:
        if t != "lineitem":
            os.symlink(f"{DIR}/{t}.parquet", tmp_path / f"{t}.parquet")
    c = duckdb.connect()
    clean = [(r["t_performance_id"], r["_row_id"]) for r in QUERIES["enriched_rows"](spark, DIR).select("t_performance_id", "_row_id").collect()]
    c.register("clean", pd.DataFrame(clean, columns=["e", "r"]))
    line = f"'{DIR}/lineitem.parquet'"
    # twenty rows of the answer come again with a part of another name
    again = f"SELECT * REPLACE (l_partkey + 1 AS l_partkey) FROM {line} JOIN (SELECT DISTINCT e FROM clean ORDER BY e LIMIT 20) ON l_orderkey = e"
    c.execute(f"COPY (SELECT * FROM {line} UNION ALL SELECT * EXCLUDE (e) FROM ({again})) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    want = c.execute(ORACLE_SQL["enriched_rows"])
    columns, want = [d[0] for d in want.description], want.fetchall()
    df = QUERIES["enriched_rows"](spark, str(tmp_path))
    data = df.collect()
    keys = {(r["t_performance_id"], r["_row_id"]) for r in data}
    assert len(data) > len(keys)
    assert rows(df.columns, data) == rows(columns, want)
