"""Two-class statistics of features, and evaluation metrics of predictions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from glyphmill.operators.quality import finite
from glyphmill.operators.ranking import quantiles, running_sums


def long_format(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """label, feature, value (finite values only)."""
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), finite(f).alias("value")) for f in features])
    return df.filter(F.col(label).isNotNull()).select(F.col(label).cast("int").alias("label"), F.inline(cells)).filter("value is not null")


def class_moments(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """feature, then n, mean, sample variance and exact median of both classes."""
    v, ai = F.col("value"), F.col("label") == 1
    per = [x for k, c in (("1", ai), ("0", ~ai)) for x in (F.count_if(c).alias(f"n{k}"), F.avg(F.when(c, v)).alias(f"mean{k}"), F.var_samp(F.when(c, v)).alias(f"var{k}"))]
    long = long_format(df, features, label)
    medians = quantiles(long.withColumn("class", (F.col("label") == 1).cast("int")), ["feature", "class"], "value", [0.5]).groupBy("feature")
    medians = medians.agg(*[F.max(F.when(F.col("class") == k, F.col("q")[0])).alias(f"median{k}") for k in (0, 1)])
    return long.groupBy("feature").agg(*per).join(medians, "feature")


def descriptives(df: DataFrame, features: list[str], label: str) -> DataFrame:
    m = class_moments(df, features, label)
    diff = F.col("mean1") - F.col("mean0")
    return m.select("feature", "n0", "n1", *[F.round(c, 6).alias(c) for c in ("mean0", "mean1", "median0", "median1")], F.round(F.sqrt("var0"), 6).alias("std0"), F.round(F.sqrt("var1"), 6).alias("std1"), F.round(diff, 6).alias("diff"), F.round(F.try_divide(100 * diff, F.abs("mean0")), 4).alias("diff_pct"))


def t_tests(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Pooled and Welch t with degrees of freedom, Cohen's d and its size."""
    m = class_moments(df, features, label)
    n0, n1, v0, v1 = (F.col(c) for c in ("n0", "n1", "var0", "var1"))
    diff = F.col("mean1") - F.col("mean0")
    pooled = F.try_divide((n0 - 1) * v0 + (n1 - 1) * v1, n0 + n1 - 2)
    a, b = F.try_divide(v0, n0), F.try_divide(v1, n1)
    d = F.coalesce(F.try_divide(diff, F.sqrt(pooled)), F.lit(0.0))
    size = F.when(F.abs(d) < 0.2, "negligible").when(F.abs(d) < 0.5, "small").when(F.abs(d) < 0.8, "medium").otherwise("large")
    return m.select(
        "feature", F.round(F.try_divide(diff, F.sqrt(pooled * (1.0 / n0 + 1.0 / n1))), 5).alias("t_pooled"), (n0 + n1 - 2).alias("df_pooled"),
        F.round(F.try_divide(diff, F.sqrt(a + b)), 5).alias("t_welch"), F.round(F.try_divide((a + b) * (a + b), F.try_divide(a * a, n0 - 1) + F.try_divide(b * b, n1 - 1)), 3).alias("df_welch"),
        F.round(d, 6).alias("cohens_d"), size.alias("effect"),
    )


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-12:
            break
    return h


def t_p_value(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    if df <= 0 or math.isnan(t):
        return float("nan")
    a, b, x = df / 2, 0.5, df / (df + t * t)
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if x > 0 else 0.0
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def wilcoxon(a: list[float], b: list[float]) -> tuple[float, float]:
    """Signed-rank statistic of two short paired series and its two-sided normal p; zero differences are left out."""
    gaps = sorted((y - x for x, y in zip(a, b) if y != x), key=abs)
    n, ranks, i = len(gaps), [0.0] * len(gaps), 0
    if not n:
        return 0.0, 1.0
    ties = 0.0
    while i < n:
        j = i
        while j < n and abs(gaps[j]) == abs(gaps[i]):
            j += 1
        for k in range(i, j):
            ranks[k] = (i + j + 1) / 2
        ties += (j - i) ** 3 - (j - i)
        i = j
    plus = sum(r for r, g in zip(ranks, gaps) if g > 0)
    low = min(plus, n * (n + 1) / 2 - plus)
    spread = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    z = (low - n * (n + 1) / 4) / spread if spread else 0.0
    return low, min(1.0, math.erfc(abs(z) / math.sqrt(2)))


def significance(df: DataFrame, features: list[str], label: str, alpha: float = 0.05) -> DataFrame:
    """p values of Welch's test at alpha and Bonferroni's alpha / m; one row a feature comes to the driver."""
    rows = t_tests(df, features, label).collect()
    m = max(1, len(rows))
    out = []
    for r in rows:
        p = t_p_value(r["t_welch"], r["df_welch"]) if r["t_welch"] is not None and r["df_welch"] is not None else None
        out.append((r["feature"], r["cohens_d"], p, p is not None and p < alpha, p is not None and p < alpha / m))
    return df.sparkSession.createDataFrame(out, "feature string, cohens_d double, p_value double, significant boolean, bonferroni boolean")


def histogram(df: DataFrame, features: list[str], label: str, bins: int = 30) -> DataFrame:
    """feature, label, bin, count and density over equal bins of the feature's range."""
    rows = long_format(df, features, label)
    span = rows.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    binned = rows.join(span, "feature").filter("hi > lo").withColumn("bin", F.least(F.lit(bins - 1), F.floor((F.col("value") - F.col("lo")) / width)).cast("bigint")).withColumn("width", width)
    counts = binned.groupBy("feature", "label", "bin").agg(F.count("*").alias("n"), F.max("width").alias("width"))
    total = F.sum("n").over(W.partitionBy("feature", "label"))
    return counts.select("feature", "label", "bin", "n", F.round(F.col("n") / (total * F.col("width")), 6).alias("density"))


def confusion(predictions: DataFrame, label: str, predicted: str) -> DataFrame:
    """tp, fp, fn, tn and the metrics from them, one row."""
    y, p = F.col(label) == 1, F.col(predicted) == 1
    c = predictions.filter(y.isNotNull() & p.isNotNull()).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    precision, recall = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select("*", F.round(F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")), 6).alias("accuracy"), F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(F.try_divide(2 * precision * recall, precision + recall), 6).alias("f1"))


def roc_auc(predictions: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve by rank sums over the distinct scores (ties count half)."""
    by = predictions.filter(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    won = running_sums(by, ["s"], {"below": F.col("n")}).withColumn("won", F.col("p") * (F.col("below") + F.col("n") / 2.0))
    return won.agg(F.round(F.try_divide(F.sum("won"), F.sum("p").cast("double") * F.sum("n")), 6).alias("roc_auc"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """label, n, balanced weight n / (k * n_c)."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(F.col(label).cast("int").alias("label")).agg(F.count("*").alias("n"))
    every = W.partitionBy(F.lit(1))
    return counts.select("label", "n", F.round(F.sum("n").over(every) / (F.count("*").over(every) * F.col("n")), 6).alias("weight"))


def summary_by_family(tests: DataFrame, families: dict[str, list[str]]) -> DataFrame:
    """family, features significant after Bonferroni, mean absolute d of ``tests(feature, cohens_d, bonferroni)``."""
    family = F.lit("other")
    for name, features in families.items():
        family = F.when(F.col("feature").isin(*features), name).otherwise(family)
    return tests.groupBy(family.alias("family")).agg(F.count_if("bonferroni").alias("n_significant"), F.round(F.avg(F.abs("cohens_d")), 4).alias("mean_abs_d"))
