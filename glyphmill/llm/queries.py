"""Queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import crosssplit, languages, leakage, mixing, proportions, prose, reading, repetition, truncation, truncation_oracle
from glyphmill.session import read_table


def _texts(spark: SparkSession, d: str, *tables: str) -> DataFrame:
    """rec_table, rec_id, text and source of the named tables."""
    columns = {"documents": ("doc_id", "text"), "generations": ("id", "generation"), "split_texts": ("id", "text")}
    out = None
    for t in tables:
        key, text = columns[t]
        part = read_table(spark, d, t).select(F.lit(t).alias("rec_table"), F.col(key).cast("string").alias("rec_id"), F.col(text).alias("text"), "source")
        out = part if out is None else out.unionByName(part)
    return out


def p1_sample(spark: SparkSession, d: str) -> DataFrame:
    return proportions.sample(read_table(spark, d, "generations"), read_table(spark, d, "target_shares"))[0]


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return proportions.sample(read_table(spark, d, "generations"), read_table(spark, d, "target_shares"))[1]


def p1_unmet(spark: SparkSession, d: str) -> DataFrame:
    return p1_report(spark, d).filter("not target_met or not minimum_met")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.found({t: read_table(spark, d, t) for t in truncation.TABLES})


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return truncation.report({t: read_table(spark, d, t) for t in truncation.TABLES})


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return crosssplit.found(read_table(spark, d, "split_texts"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return crosssplit.report(read_table(spark, d, "split_texts"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.found(*(read_table(spark, d, t) for t in ("documents", "generations", "stylometric_features")))


def p4_levels(spark: SparkSession, d: str) -> DataFrame:
    return reading.levels(*(read_table(spark, d, t) for t in ("documents", "generations", "stylometric_features")))


def p4_word_grades(spark: SparkSession, d: str) -> DataFrame:
    return reading.word_grades(reading.graded_texts(read_table(spark, d, "generations"), read_table(spark, d, "stylometric_features")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return prose.found(read_table(spark, d, "documents"))


def p5_statistics(spark: SparkSession, d: str) -> DataFrame:
    return prose.statistics(read_table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.found(read_table(spark, d, "documents"), read_table(spark, d, "eval_items"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return leakage.report(read_table(spark, d, "documents"), read_table(spark, d, "eval_items"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(read_table(spark, d, "documents"), read_table(spark, d, "mix_targets"))[0]


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.report(read_table(spark, d, "documents"), read_table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return languages.found(read_table(spark, d, "documents"))


def p10_documents(spark: SparkSession, d: str) -> DataFrame:
    return languages.document_languages(read_table(spark, d, "documents"))


def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    return languages.segments(read_table(spark, d, "documents"))


def p6_ledger(spark: SparkSession, d: str) -> DataFrame:
    return repetition.ledger(_texts(spark, d, "documents", "generations"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.flagged(p6_ledger(spark, d), repetition.POLICIES[0])


def p6_policies(spark: SparkSession, d: str) -> DataFrame:
    return repetition.policy_report(p6_ledger(spark, d))


def p6_ablation(spark: SparkSession, d: str) -> DataFrame:
    return repetition.ablation(p6_ledger(spark, d), repetition.POLICIES[2])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_sample, p1_report, p1_unmet, p2_found, p2_report, p3_found, p3_report, p4_found, p4_levels, p4_word_grades, p5_found, p5_statistics, p6_found, p6_ledger, p6_policies, p6_ablation, p8_found, p8_report, p9_mix, p9_report, p10_found, p10_documents, p10_segments)
}
ORACLE: dict[str, str] = {"p2_found": truncation_oracle.FOUND, "p2_report": truncation_oracle.REPORT}
