"""The operators applied to whole tables: opN_<name>(spark, sf_dir), and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact, fingerprints, language, licences, packing, simhash, suffix, toxicity, wrappers


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(_read(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_read(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.find_toxic(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_read(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_read(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op7_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(_read(spark, sf_dir, "pages"))


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.find_repeats(_read(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.find_copies(_read(spark, sf_dir, "documents"))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_fingerprints, op2_byte_bpe, op3_toxicity, op4_language, op5_simhash, op6_packing, op7_wrappers, op8_suffix_array, op9_exact_dedup, op10_licences)}
ORACLES = {"op1_fingerprints": fingerprints.oracle_sql(), "op8_suffix_array": suffix.ORACLE_SQL, "op9_exact_dedup": exact.ORACLE_SQL, "op10_licences": licences.oracle_sql()}
