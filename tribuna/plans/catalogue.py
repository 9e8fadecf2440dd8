"""All queries of the library and their SQL: name -> f(spark, sf_dir), name -> DuckDB text."""

from __future__ import annotations

from . import q_cluster, q_inventory, q_mining, q_protocols, q_reports, q_venue

QUERIES = {**q_inventory.QUERIES, **q_venue.QUERIES, **q_cluster.QUERIES, **q_mining.QUERIES, **q_reports.QUERIES, **q_protocols.QUERIES}
ORACLE_SQL = {**q_inventory.ORACLE_SQL, **q_venue.ORACLE_SQL, **q_cluster.ORACLE_SQL, **q_mining.ORACLE_SQL, **q_reports.ORACLE_SQL, **q_protocols.ORACLE_SQL}
