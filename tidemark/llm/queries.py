"""The registered queries of the dealt operators and the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import (
    chat, cotrain, decontaminate, exact_dedup, line_dedup, near_dups, packing, phrases, quality_rules, secrets, spelling, toxicity,
    turn_repair,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark, sf_dir):
    return quality_rules.op1_quality_rules(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark, sf_dir):
    return cotrain.op2_quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_minhash_dedup(spark, sf_dir):
    return near_dups.op3_minhash_dedup(table(spark, sf_dir, "documents"))


def op4_toxicity(spark, sf_dir):
    return toxicity.op4_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_decontamination(spark, sf_dir):
    return decontaminate.op5_decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_line_dedup(spark, sf_dir):
    return line_dedup.op6_line_dedup(table(spark, sf_dir, "documents"))


def op7_packing(spark, sf_dir):
    return packing.op7_packing(table(spark, sf_dir, "documents"))


def op8_secret_scans(spark, sf_dir):
    return secrets.op8_secret_scans(table(spark, sf_dir, "documents"))


def op9_repeated_phrases(spark, sf_dir):
    return phrases.op9_repeated_phrases(table(spark, sf_dir, "documents"))


def op10_chat_formatting(spark, sf_dir):
    return chat.op10_chat_formatting(table(spark, sf_dir, "conversations"))


def op11_exact_dedup(spark, sf_dir):
    return exact_dedup.op11_exact_dedup(table(spark, sf_dir, "documents"))


def op12_structure_repair(spark, sf_dir):
    return turn_repair.op12_structure_repair(table(spark, sf_dir, "conversations"))


def op13_spelling_variants(spark, sf_dir):
    return spelling.op13_spelling_variants(table(spark, sf_dir, "documents"))


RUNS = (op1_quality_rules, op2_quality_classifier, op3_minhash_dedup, op4_toxicity, op5_decontamination,
        op6_line_dedup, op7_packing, op8_secret_scans, op9_repeated_phrases, op10_chat_formatting,
        op11_exact_dedup, op12_structure_repair, op13_spelling_variants)

#: SQL can't express the fitted operators (2, 4) nor the salted ranks of packing (7).
SQL = {
    "op1_quality_rules": quality_rules.ORACLE_SQL,
    "op3_minhash_dedup": near_dups.ORACLE_SQL,
    "op5_decontamination": decontaminate.ORACLE_SQL,
    "op6_line_dedup": line_dedup.ORACLE_SQL,
    "op8_secret_scans": secrets.ORACLE_SQL,
    "op9_repeated_phrases": phrases.ORACLE_SQL,
    "op10_chat_formatting": chat.ORACLE_SQL,
    "op11_exact_dedup": exact_dedup.ORACLE_SQL,
    "op12_structure_repair": turn_repair.ORACLE_SQL,
    "op13_spelling_variants": spelling.ORACLE_SQL,
}


def queries():
    return {run.__name__: run for run in RUNS}


def oracle_sql():
    return dict(SQL)
