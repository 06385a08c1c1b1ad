"""Feature queries written in SQL that Spark and the oracle read alike.

A query names the contract tables it reads; Spark gets them as DataFrames (one lazy plan), the
oracle as CTEs.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.operators import contracts
from glyphmill.session import read_table

#: Contract tables by name: how Spark makes them, and the CTEs the oracle needs.
CONTRACTS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], tuple[str, ...]]] = {}


def contract(name: str, make: Callable[[SparkSession, str], DataFrame], ctes: tuple[str, ...]) -> None:
    CONTRACTS[name] = (make, ctes)


contract("sents", lambda s, d: contracts.sentences(read_table(s, d, "documents")), contracts.oracle("sents"))
contract("tokens", lambda s, d: contracts.tokens(read_table(s, d, "documents")), contracts.oracle("sents", "tokens"))
contract("entities", lambda s, d: contracts.entities_of(read_table(s, d, "documents")), contracts.oracle("sents", "tokens", "entities"))
contract("doc_sizes", lambda s, d: contracts.tokens(read_table(s, d, "documents")).groupBy("doc_id").agg(F.count("*").alias("n")), contracts.oracle("sents", "tokens") + ("doc_sizes AS (SELECT doc_id, count(*) AS n FROM tokens GROUP BY doc_id)",))


def on_spark(sql: str, tables: dict[str, DataFrame], spark: SparkSession) -> DataFrame:
    """``sql`` with the named tables bound to DataFrames."""
    used = {}
    sql = sql.replace("{", "{{").replace("}", "}}")
    for name, df in tables.items():
        pattern = re.compile(rf"\b(FROM|JOIN) {name}\b")
        if pattern.search(sql):
            sql = pattern.sub(rf"\1 {{{name}}}", sql)
            used[name] = df
    return spark.sql(sql, **used)


def query(name: str, sql: str, tables: tuple[str, ...], spark_sql: str | None = None, held: dict[str, Callable[[DataFrame], DataFrame]] | None = None, by: str = "") -> tuple[Callable[[SparkSession, str], DataFrame], str]:
    """The query function and the oracle SQL of ``sql``, which reads ``tables`` (contracts or base tables); for Spark, those in ``held`` are taken from the table ``by``."""
    held = held if held and by in tables else {}

    def run(spark: SparkSession, d: str) -> DataFrame:
        made = {t: CONTRACTS[t][0](spark, d) if t in CONTRACTS else read_table(spark, d, t) for t in tables if t not in held}
        made |= {t: held[t](made[by]) for t in tables if t in held}
        return on_spark(spark_sql or sql, made, spark)

    run.__name__ = name
    seen: list[str] = []
    for t in tables:
        seen += [c for c in CONTRACTS.get(t, (None, ()))[1] if c not in seen]
    if not seen:
        return run, sql
    body = sql.lstrip()
    if body.upper().startswith("WITH "):
        return run, "WITH " + ", ".join(seen) + ", " + body[5:]
    return run, "WITH " + ", ".join(seen) + " " + body
