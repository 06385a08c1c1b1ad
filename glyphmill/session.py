"""Session helpers shared by operators: durable checkpoints and table readers."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash_below(value: Column, share: float | Column) -> Column:
    """Whether the 64-bit hash of ``value`` lies in the lowest ``share`` of its range, however small the share is."""
    share = F.lit(share) if isinstance(share, float) else share
    return F.xxhash64(value) / F.lit(2.0**64) + F.lit(0.5) < share


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    A cluster names it in ``spark.checkpoint.dir``; a folder of our own is made
    only where the setting is absent (local tests).
    """
    context = spark.sparkContext
    configured = context.getConf().get(CHECKPOINT_CONF, None)
    current = context.getCheckpointDir()
    if current:
        return current
    if configured is None:
        if not context.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_CONF} must name a folder that all executors share")
        configured = os.path.join(tempfile.gettempdir(), "glyphmill-checkpoints")
    context.setCheckpointDir(configured)
    return configured


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` through a compressed table in the shared checkpoint folder.

    Unlike cached blocks it survives the loss of executors. The table is removed when the driver ends.
    Its compressed size says little about its rows, so it is never broadcast on an estimate (the hint holds for what is
    derived from it row by row, too); a side with a proven bound takes ``F.broadcast`` itself.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/glyphmill-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path).hint("merge")


_written: list[tuple[SparkSession, str]] = []


def drop_materialized() -> None:
    """Remove the tables that ``materialize`` wrote."""
    while _written:
        spark, path = _written.pop()
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001 - the session may have ended already
            return


atexit.register(drop_materialized)
