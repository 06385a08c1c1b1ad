"""Operators on wide feature tables: capping, flags, imputation, correlations, checks and merging."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from glyphmill.operators.ranking import quantiles, running_sums

#: Left-closed length bins; values outside have none.
LENGTH_BINS = (0, 100, 250, 500, 10000)


def numeric_features(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in exclude]


def to_number(c: str) -> Column:
    """The value as a double; null if it is none."""
    return F.expr(f"try_cast(`{c}` as double)")


def finite(c: str) -> Column:
    """The value, null where it is NaN or infinite."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def bounds(name: str) -> tuple[float | None, float | None]:
    """Interval that a feature's name implies."""
    if re.search(r"ratio|proportion|rate|diversity", name):
        return 0.0, 1.0
    if "entropy" in name:
        return 0.0, None
    if "per_100" in name:
        return 0.0, 100.0
    return None, None


def select_prefix(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def add_prefix(df: DataFrame, prefix: str, key: str) -> DataFrame:
    return df.select(key, *[F.col(c).alias(prefix + c) for c in df.columns if c != key])


def drop_named(df: DataFrame, names: dict[str, list[str]] | list[str], patterns: tuple[str, ...] = ()) -> DataFrame:
    """``df`` without the named columns and those that match a pattern (any case)."""
    flat = [c for v in names.values() for c in v] if isinstance(names, dict) else list(names)
    flat += [c for c in df.columns if any(re.search(p, c, re.I) for p in patterns)]
    return df.drop(*flat)


def missing_fraction(df: DataFrame, features: list[str]) -> DataFrame:
    """feature, missing share, infinite values: one pass for all columns, then one row a feature."""
    cells = [F.struct(F.lit(f).alias("feature"), F.avg(F.when(finite(f).isNull(), 1.0).otherwise(0.0)).alias("missing"), F.count_if(F.abs(F.col(f)) == float("inf")).alias("n_infinite")) for f in features]
    return df.agg(F.array(*cells).alias("x")).select(F.inline("x"))


def verify(df: DataFrame, features: list[str]) -> DataFrame:
    """feature, nulls, min, max, mean, sample deviation, and whether values leave the interval of the name."""
    def cell(f: str) -> Column:
        v = finite(f)
        lo, hi = bounds(f)
        out = F.lit(False)
        if lo is not None:
            out = out | F.coalesce(F.min(v) < lo, F.lit(False))
        if hi is not None:
            out = out | F.coalesce(F.max(v) > hi, F.lit(False))
        return F.struct(F.lit(f).alias("feature"), F.count_if(v.isNull()).alias("n_missing"), F.min(v).alias("least"), F.max(v).alias("most"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), out.alias("out_of_range"))

    return df.agg(F.array(*[cell(f) for f in features]).alias("x")).select(F.inline("x"))


def caps(df: DataFrame, features: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """One row with the exact percentiles of the finite values of each feature, within the name's interval."""
    cells, found = [], quantiles(long_values(df, features), ["feature"], "value", [low, high])
    for f in features:
        p = F.max(F.when(F.col("feature") == f, F.col("q")))
        lo, hi = bounds(f)
        a, b = p[0], p[1]
        a = F.greatest(a, F.lit(lo)) if lo is not None else a
        b = F.least(b, F.lit(hi)) if hi is not None else b
        cells.append(F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).alias(f))
    return found.agg(*cells)


def long_values(df: DataFrame, features: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, feature, value of all finite values."""
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), finite(f).alias("value")) for f in features])
    return df.select(*keys, F.inline(cells)).filter("value is not null")


def apply_caps(df: DataFrame, limits: DataFrame, features: list[str]) -> DataFrame:
    """``df`` with features clipped to their caps; null stays null."""
    named = limits.select(*[F.col(f).alias(f"__{f}") for f in features])
    clipped = {f: F.when(finite(f).isNotNull(), F.least(F.greatest(finite(f), F.col(f"__{f}")["lo"]), F.col(f"__{f}")["hi"])) for f in features}
    return df.crossJoin(F.broadcast(named)).withColumns(clipped).select(*df.columns)


def zscore_flags(df: DataFrame, features: list[str], n_std: float = 3.0, logged: tuple[str, ...] = ()) -> DataFrame:
    """``<f>_outlier`` for each feature and ``quality_score`` (1 less the share of outliers)."""
    value = {f: F.log1p(finite(f)) if f in logged else finite(f) for f in features}
    moments = df.agg(*[F.struct(F.avg(value[f]).alias("m"), F.stddev_pop(value[f]).alias("s")).alias(f"__{f}") for f in features])
    flags = {f"{f}_outlier": F.coalesce(F.abs(F.try_divide(value[f] - F.col(f"__{f}")["m"], F.col(f"__{f}")["s"])) > n_std, F.lit(False)) for f in features}
    total = sum(F.col(c).cast("int") for c in flags)
    return df.crossJoin(F.broadcast(moments)).withColumns(flags).withColumn("quality_score", F.greatest(F.lit(0.0), 1 - total / float(len(features)))).select(*df.columns, *flags, "quality_score")


def outlier_flags(df: DataFrame, checks: dict[str, Callable[[DataFrame], Column]]) -> DataFrame:
    """A boolean for each named check and their number as ``severity``; a check is a function of the table."""
    flags = {n: F.coalesce(c(df), F.lit(False)) for n, c in checks.items()}
    out = df.withColumns(flags)
    return out.withColumn("severity", sum(F.col(n).cast("int") for n in flags))


def length_bin(c: str, edges: tuple[int, ...] = LENGTH_BINS) -> Column:
    out = F.lit(None).cast("string")
    for lo, hi in zip(edges[:-1], edges[1:]):
        out = F.when((F.col(c) >= lo) & (F.col(c) < hi), F.lit(f"[{lo},{hi})")).otherwise(out)
    return out


def impute_median(df: DataFrame, features: list[str], groups: list[Column] | None = None, most_missing: float = 1.0) -> DataFrame:
    """Nulls filled with the median of the group, then of the table, then 0; features with too many nulls dropped.

    Medians are one aggregation by group and one overall, joined back; the grouped table is small.
    """
    clean = df.withColumns({f: finite(f) for f in features})
    if most_missing < 1.0:
        shares = clean.agg(*[F.avg(F.col(f).isNull().cast("int")).alias(f) for f in features]).first()
        dropped = [f for f in features if (shares[f] or 0.0) > most_missing]
        clean, features = clean.drop(*dropped), [f for f in features if f not in dropped]
    of = lambda f: F.max(F.when(F.col("feature") == f, F.col("q")[0]))
    whole = quantiles(long_values(clean, features), ["feature"], "value", [0.5]).agg(*[of(f).alias(f"__all_{f}") for f in features])
    out = clean.crossJoin(F.broadcast(whole))
    fills = {f: [F.col(f), F.col(f"__all_{f}"), F.lit(0.0)] for f in features}
    if groups:
        keys = {f"__g{i}": g for i, g in enumerate(groups)}
        keyed = out.withColumns(keys)
        medians = quantiles(long_values(keyed, features, tuple(keys)), [*keys, "feature"], "value", [0.5])
        by = medians.groupBy(*keys).agg(*[of(f).alias(f"__by_{f}") for f in features]).withColumnsRenamed({k: f"{k}r" for k in keys})
        same = None
        for k in keys:
            c = F.col(k).eqNullSafe(F.col(f"{k}r"))
            same = c if same is None else same & c
        out = keyed.join(by, same, "left")
        fills = {f: [F.col(f), F.col(f"__by_{f}"), F.col(f"__all_{f}"), F.lit(0.0)] for f in features}
    names = [c for c in clean.columns]
    return out.withColumns({f: F.coalesce(*v) for f, v in fills.items()}).select(*names)


def impute_semantic(df: DataFrame, zeros: list[str], ones: list[str], medians: list[str]) -> DataFrame:
    """0 where nothing means none, 1 where nothing means all, medians elsewhere."""
    filled = df.withColumns({**{c: F.coalesce(finite(c), F.lit(0.0)) for c in zeros}, **{c: F.coalesce(finite(c), F.lit(1.0)) for c in ones}})
    return impute_median(filled, medians) if medians else filled


def correlations(df: DataFrame, features: list[str], ranks: bool = False) -> DataFrame:
    """a, b, r, n of all feature pairs over rows where both are known: moments of all pairs in one pass.

    With ``ranks`` the values are replaced by average ranks first (Spearman).
    """
    clean = df.select(*[finite(f).alias(f) for f in features])
    if ranks:
        for f in features:
            counts = clean.filter(F.col(f).isNotNull()).groupBy(f).agg(F.count("*").alias("n"))
            ranked = running_sums(counts, [f], {"below": F.col("n")}).select(F.col(f).alias("__v"), (F.col("below") + (F.col("n") + 1) / 2.0).alias("__r"))
            clean = clean.join(ranked, F.col(f) == F.col("__v"), "left").withColumn(f, F.col("__r")).drop("__v", "__r")
    cells = []
    for i, a in enumerate(features):
        for b in features[i + 1 :]:
            both = F.col(a).isNotNull() & F.col(b).isNotNull()
            x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
            r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
            cells.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r.alias("r"), F.count(x).alias("n")))
    return clean.agg(F.array(*cells).alias("x")).select(F.inline("x"))


def correlated_drops(pairs: list[tuple[str, str, float]], priority: tuple[str, ...] = (), missing: dict[str, float] | None = None, threshold: float = 0.85) -> list[str]:
    """Greedy choice of features to drop: of each pair above the threshold the one without priority, with more missing values, or later in the alphabet."""
    missing = missing or {}
    dropped: list[str] = []
    for a, b, r in sorted(pairs, key=lambda p: (-abs(p[2] or 0.0), p[0], p[1])):
        if abs(r or 0.0) <= threshold or a in dropped or b in dropped:
            continue
        keep = min((a, b), key=lambda f: (f not in priority, missing.get(f, 0.0), f))
        dropped.append(b if keep == a else a)
    return dropped


def coverage(manifest: list[str], df: DataFrame) -> tuple[list[str], list[str], float]:
    """Manifest names that the table has, those it lacks, and the share it has."""
    have = [f for f in manifest if f in df.columns]
    return have, [f for f in manifest if f not in df.columns], len(have) / len(manifest) if manifest else 1.0


def merge_outer(frames: list[DataFrame], key: str) -> DataFrame:
    """Full outer join of feature tables on the key; columns already there are not taken again."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f.select(key, *[c for c in f.columns if c not in out.columns]), key, "outer")
    return out


def join_families(labels: DataFrame, families: dict[str, DataFrame], key: str) -> DataFrame:
    """Inner join of feature families onto labels; a column of two families gets the family's name."""
    out = labels
    for name, f in families.items():
        out = out.join(f.select(key, *[F.col(c).alias(f"{c}_{name}" if c in out.columns else c) for c in f.columns if c != key]), key)
    return out


@dataclass
class Cleaning:
    """What a cleaning run did."""

    dropped: list[str] = field(default_factory=list)
    correlated: list[str] = field(default_factory=list)
    features: list[str] = field(default_factory=list)

    def report(self) -> str:
        return "\n".join(["Cleaning report", f"dropped by name: {', '.join(self.dropped) or 'none'}", f"dropped as correlated: {', '.join(self.correlated) or 'none'}", f"features left: {len(self.features)}"])


def clean(df: DataFrame, features: list[str], drops: list[str] = (), threshold: float = 0.85, group: Column | None = None) -> tuple[DataFrame, Cleaning]:
    """Named drops, correlated drops, caps and imputation, in this order."""
    done = Cleaning(dropped=[c for c in drops if c in df.columns])
    df, features = df.drop(*done.dropped), [f for f in features if f not in done.dropped]
    pairs = [(r["a"], r["b"], r["r"]) for r in correlations(df, features).collect()] if len(features) > 1 else []
    done.correlated = correlated_drops(pairs, threshold=threshold)
    df, features = df.drop(*done.correlated), [f for f in features if f not in done.correlated]
    df = apply_caps(df, caps(df, features), features)
    done.features = features
    return impute_median(df, features, [group] if group is not None else None), done


def drop_duplicate_columns(df: DataFrame) -> DataFrame:
    """``df`` with the first of the columns that share a name (in any case)."""
    names = [f"__c{i}" for i in range(len(df.columns))]
    first = {c.lower(): i for i, c in reversed(list(enumerate(df.columns)))}
    renamed = df.toDF(*names)
    return renamed.select(*[F.col(names[i]).alias(df.columns[i]) for i in sorted(first.values())])


def fill_plain(df: DataFrame, features: list[str], how: str = "median") -> DataFrame:
    """Missing and infinite values as the table's median (0 if it has none), its mean, or 0."""
    if how == "median":
        return impute_median(df, features)
    clean = df.withColumns({f: finite(f) for f in features})
    if how == "zero":
        return clean.fillna(0.0, features)
    means = clean.agg(*[F.avg(f).alias(f"__{f}") for f in features])
    return clean.crossJoin(F.broadcast(means)).withColumns({f: F.coalesce(f, f"__{f}", F.lit(0.0)) for f in features}).select(*df.columns)


def quick_clean(df: DataFrame, exclude: tuple[str, ...] = ("row_id", "id", "is_ai")) -> tuple[DataFrame, Cleaning]:
    """The cleaning run over all numeric columns with its standard settings."""
    return clean(df, numeric_features(df, exclude))


def most_common(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """groups, the commonest value (the least among equals) and how often it occurs; pre-aggregated, so no group is collected."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*groups).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("x")).select(*groups, F.col("x.v").alias("most_common"), (-F.col("x.m")).alias("n"))


def validation(df: DataFrame, features: list[str], approx: str | None = None) -> DataFrame:
    """feature, nulls and NaNs, infinite values, whether it never varies, and the share of rows marked as approximate."""
    rate = F.avg(F.col(approx).cast("double")) if approx else F.lit(None).cast("double")
    cells = [
        F.struct(F.lit(f).alias("feature"), F.count_if(F.col(f).isNull() | F.isnan(F.col(f).cast("double"))).alias("n_missing"), F.count_if(F.abs(F.col(f)) == float("inf")).alias("n_infinite"), (F.coalesce(F.max(finite(f)) == F.min(finite(f)), F.lit(True))).alias("constant"), rate.alias("approx_rate"))
        for f in features
    ]
    return df.agg(F.array(*cells).alias("x")).select(F.inline("x"))
