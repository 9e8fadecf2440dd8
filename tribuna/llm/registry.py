"""Queries of the subpackage: opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collocation, decontam, hardneg, langid, media, mixing, neardup, packing, pagetext, quality, secretscan, tokencount, urlrules
from .common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text. Null and empty texts count 0; rows with equal or null ids each give their row; an empty table none."""
    return tokencount.token_counts(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learned from rows that are not held out. Null texts and texts without a letter are `und` with
    score 0; ties go to the first name; null ids are neither held out nor learned from; an empty table gives no rows."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every url. Null urls and those without :// have an empty host and path and are allowed; rows with equal
    or null ids each give their row; an empty table none."""
    return urlrules.judge_urls(table(spark, sf_dir, "pages"), urlrules.query_rules(spark))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document in windows of benchmark items. Null texts have no words; items without words or with a null id are
    not found; equal items all count; empty tables give no hits, or no rows."""
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences. Null and empty texts are a closing id alone; rows with equal or null ids are packed each
    on their own; an empty table gives no rows."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op6_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page. Null and empty html give the empty text, as do pages without content; an empty table gives no rows."""
    return pagetext.extract_text(table(spark, sf_dir, "pages"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text. Null and empty texts have none; equal spans of two kinds both count; an empty table gives no rows."""
    return secretscan.scan_secrets(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality and toxicity of every whole text. Null and empty texts are rejected; without annotations the heuristic labellers
    decide; an empty table gives no rows."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored payload and features of every whole text. Null is the empty text, 64 zero bytes; equal texts give equal values; an empty
    table gives no rows."""
    return media.media_query(table(spark, sf_dir, "documents"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document. Texts without words are linked with nothing; rows with equal or null ids are judged by their own
    texts; an empty table gives no rows."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of each anchor and positive. Rows with a null label, vector or component take no part; null ids come last among
    equal scores; an anchor without positives and a window without rows give nothing; an empty table gives no rows."""
    return hardneg.hard_negatives_query(table(spark, sf_dir, "embeddings"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of each language. Null texts are empty, a null lang is `und`; repeated rows count each; an empty table gives no rows."""
    return collocation.collocations(table(spark, sf_dir, "documents"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document. Null and empty texts have none; a null source is the last one; rows with equal id and
    text are taken alike; an empty table gives no rows."""
    return mixing.mixing_query(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_language_id": op2_language_id,
    "op3_url_rules": op3_url_rules,
    "op4_decontamination": op4_decontamination,
    "op5_packing": op5_packing,
    "op6_page_text": op6_page_text,
    "op7_secret_scan": op7_secret_scan,
    "op8_quality": op8_quality,
    "op9_media_columns": op9_media_columns,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_collocations": op12_collocations,
    "op13_mixing": op13_mixing,
}

ORACLE_SQL: dict[str, str] = {
    "op3_url_rules": urlrules.ORACLE_SQL,
    "op4_decontamination": decontam.ORACLE_SQL,
    "op11_hard_negatives": hardneg.ORACLE_SQL,
    "op12_collocations": collocation.ORACLE_SQL,
    "op13_mixing": mixing.ORACLE_SQL,
}
