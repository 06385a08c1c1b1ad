"""Running sums, numbers and exact quantiles over a whole table without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from glyphmill.session import materialize


def running_sums(df: DataFrame, order: list[str | Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with a column for each of ``sums``: the sum over all rows before this one in the order.

    Rows are range-partitioned and sorted once, and written with their partition and place; sums of whole
    partitions (a row each) are added to sums inside a partition. The order should be total.
    """
    placed = df.withColumns({f"__s_{n}": c for n, c in sums.items()}).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(placed.withColumns({"__p": F.spark_partition_id(), "__k": F.monotonically_increasing_id()}))
    inside = W.partitionBy("__p").orderBy("__k").rowsBetween(W.unboundedPreceding, -1)
    # one row for each partition
    ends = placed.groupBy("__p").agg(*[F.sum(f"__s_{n}").alias(f"__t_{n}") for n in sums])
    earlier = W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    starts = ends.select("__p", *[F.coalesce(F.sum(f"__t_{n}").over(earlier), F.lit(0)).alias(f"__b_{n}") for n in sums])
    out = placed.join(F.broadcast(starts), "__p")
    return out.select(*df.columns, *[(F.col(f"__b_{n}") + F.coalesce(F.sum(f"__s_{n}").over(inside), F.lit(0))).alias(n) for n in sums])


def numbered(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """``df`` with the number of each row in the order, from 0."""
    return running_sums(df, order, {name: F.lit(1).cast("bigint")})


def quantiles(df: DataFrame, groups: list[str], value: str, points: list[float]) -> DataFrame:
    """groups and ``q``, the exact quantiles of ``value`` (interpolated) at the points; groups without a value have no row.

    Equal values are counted before the shuffle and then ranked by running sums, so no buffer holds the values of a group.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("__n"))
    summed = running_sums(counts, [*groups, value], {"__below": F.col("__n")})
    ends = summed.groupBy(*groups).agg(F.min("__below").alias("__start"), F.sum("__n").alias("__total"))
    kept = ends.select(*[F.col(g).alias(f"__g_{g}") for g in groups], "__start", "__total")
    on = F.lit(True)
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    placed = summed.join(kept, on) if groups else summed.crossJoin(F.broadcast(kept))
    rank, x = F.col("__below") - F.col("__start"), F.col(value).cast("double")
    cells = []
    for p in points:
        at = F.lit(float(p)) * (F.col("__total") - 1)
        here = lambda k: F.max(F.when((rank <= k) & (k < rank + F.col("__n")), x))
        low, part = here(F.floor(at)), F.max(at - F.floor(at))
        cells.append(low + (here(F.ceil(at)) - low) * part)
    return placed.groupBy(*groups).agg(F.array(*cells).alias("q"))


def class_ranks(df: DataFrame, label: str, order: list[str | Column], name: str, size: str) -> DataFrame:
    """``df`` with the number of each row in its class, from 0, and the class's size; a class may hold most of the rows.

    Labels are few: the table of their sizes is sent to all tasks.
    """
    keyed = df.withColumns({f"__o{i}": F.col(c) if isinstance(c, str) else c for i, c in enumerate(order)})
    placed = numbered(keyed, [label, *[f"__o{i}" for i in range(len(order))]], "__at")
    starts = placed.groupBy(label).agg(F.min("__at").alias("__first"), F.count("*").alias("__size")).withColumnRenamed(label, "__label")
    out = placed.join(F.broadcast(starts), F.col(label).eqNullSafe(F.col("__label")))
    return out.select(*df.columns, (F.col("__at") - F.col("__first")).alias(name), F.col("__size").alias(size))
