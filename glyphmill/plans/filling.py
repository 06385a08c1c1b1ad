"""Queries on filling missing values (p7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.operators import hotdeck
from glyphmill.session import read_table

FIELDS = ("avg_sentence_length", "sentence_length_std", "max_tree_depth")


def p7_table(spark: SparkSession, d: str) -> DataFrame:
    """The whole table with filled values, their states and donors."""
    return hotdeck.impute(read_table(spark, d, "stylometric_features"), hotdeck.stylometric_deck())


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Each value that was to be filled."""
    states = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"{f}_state").alias("state")) for f in FIELDS])
    return p7_table(spark, d).select("row_id", F.explode(states).alias("x")).filter("x.state <> 'observed'").select("row_id", "x.field_name")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """How many values of each field were observed, filled and left."""
    states = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"{f}_state").alias("state")) for f in FIELDS])
    return p7_table(spark, d).select(F.explode(states).alias("x")).groupBy("x.field_name", "x.state").agg(F.count("*").alias("n_values"))


def _missing(field: str) -> str:
    zero = f"({field} = 0 AND n_sentences_doc > 3)" if field.endswith("_std") else f"({field} = 0)"
    return (
        f"SELECT row_id, '{field}' AS field_name, {field} IS NULL OR NOT isfinite({field}) OR {field} < 0 OR coalesce({zero}, false) "
        f"OR ({field} IN (99, 999, 9999, 99999, 999999) AND {field} > coalesce(n_tokens_doc, 0)) AS missing FROM stylometric_features"
    )


_ALL = " UNION ALL ".join(_missing(f) for f in FIELDS)
QUERIES = {f.__name__: f for f in (p7_found, p7_table, p7_report)}
ORACLE = {
    "p7_found": f"SELECT row_id, field_name FROM ({_ALL}) WHERE missing",
    "p7_report": f"SELECT field_name, CASE WHEN missing THEN 'filled' ELSE 'observed' END AS state, count(*) AS n_values FROM ({_ALL}) GROUP BY 1, 2",
}
