"""The queries ``opN_<name>``: each applies an operator to its whole table. ``oracle_sql`` has DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.spread import table
from . import bpe, html_extract, license_scan, mixing, near_dedup, order_minhash, pii, quality_classifier, quality_rules, sharding


def op1_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op1(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op6(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.op2(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op3(table(spark, sf_dir, "documents"))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.op4(table(spark, sf_dir, "pages"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.op5(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.op7(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.op8(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.op9(table(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.op10(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_poisson_mix": op1_poisson_mix,
    "op2_license_scan": op2_license_scan,
    "op3_pii": op3_pii,
    "op4_html_extract": op4_html_extract,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_sharding": op6_sharding,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_order_minhash": op8_order_minhash,
    "op9_quality_rules": op9_quality_rules,
    "op10_near_dedup": op10_near_dedup,
}

ORACLE_SQL: dict[str, str] = {"op1_poisson_mix": mixing.ORACLE_SQL, "op10_near_dedup": near_dedup.ORACLE_SQL}
