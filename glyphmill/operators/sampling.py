"""Quota sampling: allocations over categories, and exact draws of quotas from groups of any size."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import LongType, StructField, StructType

from glyphmill.functions import text as T
from glyphmill.operators.ranking import class_ranks, quantiles

BINS = 4096


def uniform(*parts: Column, seed: int = 0) -> Column:
    """A number in (0, 1) that depends on the seed and the parts alone."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 12) + F.lit(0.5)) / F.lit(float(1 << 52))


def take_by_quota(rows: DataFrame, quotas: DataFrame, groups: list[str], key: str, tie: str) -> DataFrame:
    """Of each group the ``quota`` rows with the smallest ``key`` (a number in (0, 1)), ties by ``tie``.

    A histogram of keys finds the bin that the quota ends in; bins below it are taken whole and only
    that bin is ranked, so a group that holds most of the rows is never sorted in one task. Groups
    without a quota give nothing. Group columns must not be null.
    """
    binned = rows.withColumn("__bin", F.least(F.floor(F.col(key) * BINS), F.lit(BINS - 1)).cast("int"))
    counts = binned.groupBy(*groups, "__bin").agg(F.count("*").alias("__n"))
    earlier = W.partitionBy(*groups).orderBy("__bin").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    ends = counts.join(quotas.select(*groups, F.col("quota").alias("__quota")), groups).filter("__before < __quota")
    placed = binned.join(ends, [*groups, "__bin"])
    whole = placed.filter("__before + __n <= __quota")
    rank = F.row_number().over(W.partitionBy(*groups, "__bin").orderBy(key, tie))
    part = placed.filter("__before + __n > __quota").withColumn("__rank", rank).filter("__before + __rank <= __quota").drop("__rank")
    return whole.unionByName(part).select(*rows.columns)


def order_key(*parts: Column, seed: str) -> Column:
    """The md5 of id and seed: a random order that every engine computes alike."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts], F.lit(seed)))


def largest_remainder(weights: DataFrame, total: int, key: str = "key", weight: str = "weight", order: str = "ord") -> DataFrame:
    """key, quota: floors of the shares, and one more for the largest remainders (earlier ``order`` first)."""
    every = W.partitionBy(F.lit(1))
    share = weights.withColumn("__x", F.coalesce(F.try_divide(F.col(weight), F.sum(weight).over(every)), 1.0 / F.count("*").over(every)) * total)
    parts = share.withColumns({"__f": F.floor(F.round("__x", 9)).cast("bigint")}).withColumn("__r", F.round(F.col("__x") - F.col("__f"), 9))
    left = F.lit(total) - F.sum("__f").over(every)
    return parts.withColumns({"__k": F.row_number().over(W.orderBy(F.desc("__r"), order)), "__left": left}).select(key, (F.col("__f") + (F.col("__k") <= F.col("__left")).cast("bigint")).alias("quota"))


def proportional_allocation(available: DataFrame, total: int, key: str = "key", count: str = "n", order: str = "ord") -> DataFrame:
    """key, quota in proportion to what is there, at most that; all of it if ``total`` exceeds the sum."""
    whole = available.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    if total >= whole:
        return available.select(key, F.col(count).cast("bigint").alias("quota"))
    return largest_remainder(available, total, key, count, order)


def length_bins(df: DataFrame, length: str, weights: dict[str, float]) -> DataFrame:
    """``df`` with ``length_bin``: bins by rising weight, bounded at the percentiles of the cumulated weights."""
    order = sorted(weights, key=lambda k: weights[k])
    total = sum(weights.values()) or 1.0
    at, points = 0.0, []
    for k in order[:-1]:
        at += weights[k] / total
        points.append(at)
    if not points:
        return df.withColumn("length_bin", F.lit(order[0]))
    limits = quantiles(df, [], length, points).withColumnRenamed("q", "__limits")
    out = F.lit(order[-1])
    for i in reversed(range(len(points))):
        out = F.when(F.col(length) <= F.col("__limits")[i], order[i]).otherwise(out)
    return df.crossJoin(F.broadcast(limits)).withColumn("length_bin", F.when(F.col(length).isNotNull(), out)).drop("__limits")


def stratified(df: DataFrame, groups: list[str], total: int, key: str, seed: str = "s") -> DataFrame:
    """About ``total`` rows, split evenly over the values of the first group and in proportion inside.

    Quotas come from a table of counts; rows are drawn in md5 order by histogram, so no stratum is sorted whole.
    """
    counts = df.dropna(subset=groups).groupBy(*groups).agg(F.count("*").alias("n"))
    first, rest = groups[0], groups[1:]
    heads = counts.groupBy(first).agg(F.sum("n").alias("n"))
    every = W.partitionBy(F.lit(1))
    share = heads.withColumns({"__k": F.row_number().over(W.orderBy(first)), "__m": F.count("*").over(every)})
    head = share.select(first, (F.floor(F.lit(total) / F.col("__m")) + (F.col("__k") <= F.lit(total) % F.col("__m")).cast("int")).alias("__head"))
    inner = counts.join(head, first)
    in_head = W.partitionBy(first)
    x = F.round(F.least(F.col("__head"), F.sum("n").over(in_head)) * F.col("n") / F.sum("n").over(in_head), 9)
    parts = inner.withColumn("__x", x).withColumn("__f", F.floor("__x").cast("bigint"))
    left = F.least(F.col("__head"), F.sum("n").over(in_head)) - F.sum("__f").over(in_head)
    ranked = parts.withColumns({"__left": left, "__k": F.row_number().over(in_head.orderBy(F.desc(F.round(F.col("__x") - F.col("__f"), 9)), *rest))})
    quotas = ranked.select(*groups, (F.col("__f") + (F.col("__k") <= F.col("__left")).cast("bigint")).alias("quota"))
    drawn = df.dropna(subset=groups).withColumn("__md5", order_key(F.col(key), seed=seed)).withColumn("__u", F.conv(F.substr("__md5", F.lit(1), F.lit(12)), 16, 10).cast("double") / F.lit(float(1 << 48)))
    return take_by_quota(drawn, quotas, groups, "__u", "__md5").select(*df.columns)


def balance(df: DataFrame, dimensions: list[str], targets: dict[tuple[str, str], float] | None = None) -> DataFrame:
    """dimension, category, n, actual share and target share of each category."""
    every = W.partitionBy("dimension")
    cells = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("category")) for d in dimensions])
    counts = df.select(F.inline(cells)).groupBy("dimension", "category").agg(F.count("*").alias("n"))
    target = F.lit(None).cast("double")
    for (d, c), w in (targets or {}).items():
        target = F.when((F.col("dimension") == d) & (F.col("category") == c), w).otherwise(target)
    return counts.select("dimension", "category", "n", F.round(F.col("n") / F.sum("n").over(every), 6).alias("actual"), target.alias("target"))


def train_test(df: DataFrame, label: str, key: str, test: float = 0.2, seed: str = "split") -> DataFrame:
    """``df`` with ``part`` train or test, the same share of each class, by md5 order."""
    ranked = class_ranks(df, label, [order_key(F.col(key), seed=seed), key], "__k", "__m")
    return ranked.withColumn("part", F.when(F.col("__k") < F.floor(F.col("__m") * test), "test").otherwise("train")).drop("__k", "__m")


def folds(df: DataFrame, label: str, key: str, k: int = 5, seed: str = "fold") -> DataFrame:
    """``df`` with ``fold``: consecutive md5 ranks of each class go round the folds."""
    ranked = class_ranks(df, label, [order_key(F.col(key), seed=seed), key], "__k", "__m")
    return ranked.withColumn("fold", (F.col("__k") % k).cast("int")).drop("__k", "__m")


def presample(df: DataFrame, n: int, key: str, seed: str = "presample") -> DataFrame:
    """``n`` rows in md5 order (all, if there are fewer), found by a histogram of the order."""
    one = df.sparkSession.createDataFrame([(1, n)], "__g int, quota bigint")
    drawn = df.withColumn("__g", F.lit(1)).withColumns(_md5(key, seed))
    return take_by_quota(drawn, one, ["__g"], "__u", "__md5").select(*df.columns)


def _md5(key: str, seed: str) -> dict[str, Column]:
    h = order_key(F.col(key), seed=seed)
    return {"__md5": h, "__u": F.conv(F.substr(h, F.lit(1), F.lit(12)), 16, 10).cast("double") / F.lit(float(1 << 48))}


@dataclass(frozen=True)
class Dimension:
    """A column to stratify by: in given shares (those of values that are there, scaled up), evenly, or as the data are.

    ``only`` limits it to strata in which the first dimension has this value.
    """

    column: str
    weights: dict | None = None
    even: bool = False
    only: object = None


def remainder(total: int, weights: dict) -> dict:
    """Largest-remainder allocation on the driver; ties go to the earlier key."""
    whole = sum(weights.values())
    share = {k: total * w / whole if whole else total / len(weights) for k, w in weights.items()}
    out = {k: math.floor(round(x, 9)) for k, x in share.items()}
    for k in sorted(share, key=lambda k: -round(share[k] - out[k], 9))[: total - sum(out.values())]:
        out[k] += 1
    return out


def nested_quotas(counts: dict[tuple, int], total: int, dimensions: list[Dimension], at: int = 0) -> dict[tuple, int]:
    """Rows of each stratum: every dimension shares out what the one before it was given, at most what is there."""
    if not counts or total <= 0:
        return {}
    if at == len(dimensions):
        (cell, n), = counts.items()
        return {cell: min(total, n)}
    d = dimensions[at]
    values: dict = {}
    for cell, n in counts.items():
        values[cell[at]] = values.get(cell[at], 0) + n
    values = dict(sorted(values.items(), key=lambda x: str(x[0])))
    wanted = {v: w for v, w in (d.weights or {}).items() if v in values}
    if d.only is not None and at and next(iter(counts))[0] != d.only:
        wanted, d = {}, Dimension(d.column)
    if wanted:
        shares = remainder(total, wanted)
    elif d.even and d.weights is None:
        shares = remainder(total, dict.fromkeys(values, 1.0))
    else:
        shares = values if total >= sum(values.values()) else remainder(total, values)
    out: dict[tuple, int] = {}
    for v, n in shares.items():
        out |= nested_quotas({c: k for c, k in counts.items() if c[at] == v}, n, dimensions, at + 1)
    return out


def stratified_by(df: DataFrame, total: int, dimensions: list[Dimension], key: str, seed: str = "s") -> DataFrame:
    """About ``total`` rows in nested strata; dimensions that the table lacks are skipped, rows with a null in one are left out.

    Only the counts of the strata come to the driver, as many as combinations of the dimensions' categories.
    """
    dimensions = [d for d in dimensions if d.column in df.columns]
    names = [d.column for d in dimensions]
    if not names:
        return presample(df, total, key, seed)
    kept = df.dropna(subset=names)
    counts = {tuple(r[n] for n in names): r["n"] for r in kept.groupBy(*names).agg(F.count("*").alias("n")).collect()}
    quotas = [(*c, n) for c, n in nested_quotas(counts, total, dimensions).items()]
    table = df.sparkSession.createDataFrame(quotas, StructType([*[kept.schema[n] for n in names], StructField("quota", LongType())]))
    return take_by_quota(kept.withColumns(_md5(key, seed)), table, names, "__u", "__md5").select(*df.columns)


def many_samples(df: DataFrame, total: int, dimensions: list[Dimension], key: str, samples: int, seed: int = 42) -> DataFrame:
    """Several independent samples, numbered in ``sample``; sample i has the seed ``seed + i + 1``."""
    out = None
    for i in range(samples):
        one = stratified_by(df, total, dimensions, key, str(seed + i + 1)).withColumn("sample", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return out


def dedupe(df: DataFrame, key: str | None, text: str, order: str) -> DataFrame:
    """The first row (by ``order``) of each id, or of each text if the table has no id column."""
    by = key if key is not None and key in df.columns else text
    rest = [c for c in ([order] if order in df.columns else []) + [c for c in df.columns if c != order] if c != by]
    first = df.groupBy(by).agg(F.min(F.struct(*rest)).alias("__x"))
    return first.select(by, "__x.*").select(*df.columns)


def prepared_corpus(df: DataFrame, text: str, key: str, label: Column, exclude: dict[str, tuple] | None = None, most: int | None = None, gate: bool = True) -> DataFrame:
    """Label, excluded values, presample, blanks, first rows, normal form and quality gate, in this order, as one plan."""
    out = df.withColumn("label", label)
    for column, values in (exclude or {}).items():
        out = out.filter(~F.coalesce(F.col(column).isin(*values), F.lit(False)))
    if most is not None:
        out = presample(out, most, key)
    out = out.filter(F.length(F.trim(text)) > 0)
    out = dedupe(out, key, text, text)
    out = out.withColumn(text, T.normalize(text)).filter(F.length(F.trim(text)) > 0)
    if not gate:
        return out
    passed = T.diagnostics(out, text, key).filter(T.gate_reasons() == "").select(key)
    return out.join(passed, key, "left_semi")
