"""Reading and writing document tables, annotation files and reports."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from glyphmill.operators.ranking import numbered

TEXT_COLUMNS = ("text", "generation")


def text_column(df: DataFrame, prefer: tuple[str, ...] = TEXT_COLUMNS) -> str:
    """The first of the preferred text columns that the table has."""
    for c in prefer:
        if c in df.columns:
            return c
    raise ValueError(f"no text column: none of {', '.join(prefer)} in {', '.join(df.columns)}")


def require(df: DataFrame, *columns: str) -> DataFrame:
    """``df``, if it has the columns."""
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    return df


def with_ids(df: DataFrame, order: str | None = None) -> DataFrame:
    """``df`` with ids ``doc_00000``, ... in the order of a column (else of the file), unless it has ids.

    Numbers are given in two steps, by partition and inside it, so no task sees all rows.
    """
    if "id" in df.columns:
        return df.withColumn("id", F.col("id").cast("string"))
    if order is not None:
        return numbered(df, [order], "__n").select(F.format_string("doc_%05d", "__n").alias("id"), *df.columns)
    placed = df.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33))
    starts = placed.groupBy("__part").agg(F.count("*").alias("__n")).withColumn("__start", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    numbers = placed.join(F.broadcast(starts), "__part").withColumn("__k", F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    return numbers.select(F.format_string("doc_%05d", "__k").alias("id"), *df.columns)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """A document table from CSV, JSON (an array of records), JSON lines, parquet, ORC or text (one document a line)."""
    kind = PurePosixPath(path.strip().strip("'\"")).suffix.lower()
    path = path.strip().strip("'\"")
    if kind == ".csv":
        df = spark.read.csv(path, header=True, multiLine=True, escape='"', quote='"')
    elif kind == ".tsv":
        df = spark.read.csv(path, header=True, sep="\t")
    elif kind == ".json":
        df = spark.read.json(path, multiLine=True)
    elif kind == ".jsonl":
        df = spark.read.json(path)
    elif kind == ".parquet":
        df = spark.read.parquet(path)
    elif kind == ".orc":
        df = spark.read.orc(path)
    elif kind == ".txt":
        df = spark.read.text(path).select(F.trim("value").alias("text")).filter("text <> ''")
    else:
        raise ValueError(f"unsupported file type: {kind or path}")
    text_column(df)
    return with_ids(df)


def read_time_annotations(spark: SparkSession, path: str) -> DataFrame:
    """TimeML files: path, id of the event instance, event id, tense, aspect and class."""
    events = spark.read.format("xml").option("rowTag", "MAKEINSTANCE").load(path)
    return events.select(F.input_file_name().alias("path"), F.col("_eiid").alias("eiid"), F.col("_eventID").alias("eid"), *[F.col(f"_{c}").alias(c) if f"_{c}" in events.columns else F.lit(None).cast("string").alias(c) for c in ("tense", "aspect")])


def read_relation_rows(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated relations (document, two verbs, two event ids, relation), BEFORE and AFTER only, with ids made comparable."""
    rows = spark.read.csv(path, sep="\t", schema="doc string, verb1 string, verb2 string, eid1 string, eid2 string, relation string")
    return rows.filter(F.col("relation").isin("BEFORE", "AFTER")).withColumn("doc_key", F.lower(F.regexp_replace("doc", "[-_.]", "")))


def write(df: DataFrame, path: str, kind: str = "parquet") -> None:
    df.write.mode("overwrite").option("header", True).format(kind).save(path)


def write_merged(documents: DataFrame, features: DataFrame, path: str, key: str = "id", kind: str = "parquet") -> None:
    """Documents with their features, those without features as well."""
    write(documents.join(features, key, "left"), path, kind)


def pending(documents: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Documents that a stage hasn't processed yet, by id."""
    return documents.join(done.select(key).distinct(), key, "left_anti")
