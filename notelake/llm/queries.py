"""The registered queries of this subpackage, one for each operator, and their DuckDB SQL."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from notelake.llm import chat_views, collocations, cotrain, dart_minhash, decontaminate, importance, license_scan, mixing, quality_rules, token_planes, toxicity, url_rules, warc_zst


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")).select(*quality_rules.COLUMNS)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judge(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).drop("rid", "key")


def op3_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_planes.write_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_planes.read_tokens(manifest)


def op4_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op6_warc_zst(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc_zst.read_archives(warc_zst.write_archives(_read(spark, sf_dir, "pages")), payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_read(spark, sf_dir, "documents"))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(_read(spark, sf_dir, "pages"), url_rules.rule_table(spark))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op10_chat_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_views.digest(chat_views.rotate(_read(spark, sf_dir, "conversations")))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_read(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


QUERIES = {"op1_quality_rules": op1_quality_rules, "op2_decontaminate": op2_decontaminate, "op3_token_planes": op3_token_planes, "op4_cotraining": op4_cotraining, "op5_dart_minhash": op5_dart_minhash, "op6_warc_zst": op6_warc_zst, "op7_license_scan": op7_license_scan, "op8_url_rules": op8_url_rules, "op9_mixing": op9_mixing, "op10_chat_views": op10_chat_views, "op11_toxicity": op11_toxicity, "op12_collocations": op12_collocations, "op13_importance_resampling": op13_importance_resampling}
ORACLES = {"op1_quality_rules": quality_rules.sql(), "op5_dart_minhash": dart_minhash.sql(), "op7_license_scan": license_scan.sql(), "op8_url_rules": url_rules.sql(), "op9_mixing": mixing.sql(), "op10_chat_views": chat_views.sql(), "op12_collocations": collocations.sql(), "op13_importance_resampling": importance.sql()}
