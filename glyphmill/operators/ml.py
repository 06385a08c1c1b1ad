"""Classifiers over feature tables: training, cross-validation, importances, ablation, search and learning curves."""

from __future__ import annotations

import json
import random
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.operators import quality, sampling, stats
from glyphmill.operators.quality import finite
from glyphmill.operators.ranking import numbered
from glyphmill.session import materialize

MODELS: dict[str, tuple[type, dict]] = {
    "gbt": (GBTClassifier, {"maxIter": 20, "maxDepth": 5, "stepSize": 0.15, "subsamplingRate": 0.8, "seed": 42}),
    "random_forest": (RandomForestClassifier, {"numTrees": 40, "maxDepth": 8, "seed": 42}),
    "logistic": (LogisticRegression, {"maxIter": 50}),
    "svc": (LinearSVC, {"maxIter": 30}),
}


def register(name: str, cls: type, defaults: dict) -> None:
    """Make another estimator known by name."""
    MODELS[name] = (cls, defaults)


def prepared(df: DataFrame, features: list[str], label: str, key: str) -> DataFrame:
    """key, label as a double, finite features; rows without a label are left out."""
    return df.filter(F.col(label).isNotNull()).select(key, F.col(label).cast("double").alias("label"), *[finite(f).alias(f) for f in features])


def pipeline(features: list[str], model: str = "gbt", **params) -> Pipeline:
    """Median imputation, assembly and the estimator."""
    cls, defaults = MODELS[model]
    filled = [f"{f}__filled" for f in features]
    return Pipeline(stages=[Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="features"), cls(**(defaults | params))])


def save(fitted: PipelineModel, features: list[str], path: str, threshold: float = 0.5) -> None:
    """The model, with its features in order and its threshold in a JSON table beside it."""
    spark = SparkSession.getActiveSession()
    fitted.write().overwrite().save(f"{path}/model")
    meta = json.dumps({"features": features, "threshold": threshold, "label": "label"})
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load(path: str) -> tuple[PipelineModel, dict]:
    spark = SparkSession.getActiveSession()
    return PipelineModel.load(f"{path}/model"), json.loads(spark.read.text(f"{path}/meta").first()[0])


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    out = model.transform(df)
    score = vector_to_array("probability")[1] if "probability" in out.columns else vector_to_array("rawPrediction")[1]
    return out.select(*df.columns, "prediction", score.alias("score"))


def evaluate(predictions: DataFrame) -> dict[str, float]:
    row = stats.confusion(predictions, "label", "prediction").first().asDict()
    return row | {"roc_auc": stats.roc_auc(predictions, "label", "score").first()[0]}


def holdout(df: DataFrame, features: list[str], label: str, key: str, model: str = "gbt", **params) -> tuple[PipelineModel, dict[str, float], dict[str, float]]:
    """The model of the training part, and the metrics of both parts."""
    parts = materialize(sampling.train_test(prepared(df, features, label, key), "label", key))
    train, test = parts.filter("part = 'train'"), parts.filter("part = 'test'")
    fitted = pipeline(features, model, **params).fit(train)
    return fitted, evaluate(predict(fitted, train)), evaluate(predict(fitted, test))


def cross_validate(df: DataFrame, features: list[str], label: str, key: str, model: str = "gbt", k: int = 5, **params) -> list[dict[str, float]]:
    """Metrics of each of k stratified folds."""
    table = materialize(sampling.folds(prepared(df, features, label, key), "label", key, k))
    out = []
    for i in range(k):
        fitted = pipeline(features, model, **params).fit(table.filter(F.col("fold") != i))
        out.append(evaluate(predict(fitted, table.filter(F.col("fold") == i))))
    return out


def gain_importance(fitted: PipelineModel, features: list[str]) -> list[tuple[str, float, float, int]]:
    """feature, importance, percent, rank."""
    last = fitted.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else abs(last.coefficients.toArray())
    total = float(sum(values)) or 1.0
    ranked = sorted(zip(features, map(float, values)), key=lambda x: (-x[1], x[0]))
    return [(f, v, 100 * v / total, i + 1) for i, (f, v) in enumerate(ranked)]


def permuted(df: DataFrame, column: str, key: str, seed: str) -> DataFrame:
    """``df`` with one column's values dealt to other rows, by joining two hash orders."""
    a = numbered(df.drop(column), [key], "__n")
    mixed = df.select(column, sampling.order_key(F.col(key), seed=seed).alias("__h"), F.col(key).alias("__i"))
    b = numbered(mixed, ["__h", "__i"], "__n").select(column, "__n")
    return a.join(b, "__n").select(*df.columns)


def permutation_importance(fitted: PipelineModel, df: DataFrame, features: list[str], key: str, repeats: int = 3, metric: str = "f1") -> list[tuple[str, float]]:
    """feature, mean loss of the metric when its values are permuted."""
    score = lambda t: (stats.confusion(predict(fitted, t), "label", "prediction").first().asDict() if metric != "roc_auc" else evaluate(predict(fitted, t)))[metric] or 0.0
    base = score(df)
    out = [(f, sum(base - score(permuted(df, f, key, f"{f}{r}")) for r in range(repeats)) / repeats) for f in features]
    return sorted(out, key=lambda x: (-x[1], x[0]))


def scorer(df: DataFrame, features: list[str], label: str, key: str, model: str = "logistic", metric: str = "f1") -> Callable[..., float]:
    """A function from some of the features (and parameters) to a model's score on the held-out part; the table is split once for all calls."""
    parts = materialize(sampling.train_test(prepared(df, features, label, key), "label", key))
    train, test = parts.filter("part = 'train'"), parts.filter("part = 'test'")

    def score(some: list[str], **params) -> float:
        fitted = pipeline(some, model, **params).fit(train)
        return stats.confusion(predict(fitted, test), "label", "prediction").first()[metric] or 0.0

    return score


def ablation(df: DataFrame, families: dict[str, list[str]], label: str, key: str, model: str = "logistic") -> list[tuple[str, float, float]]:
    """family, score without it, and what it adds to the score of all."""
    every = [f for fs in families.values() for f in fs]
    score = scorer(df, every, label, key, model)
    whole = score(every)
    out = []
    for name, fs in families.items():
        rest = [f for f in every if f not in fs]
        part = score(rest) if rest else 0.0
        out.append((name, part, whole - part))
    return out


def incremental(df: DataFrame, families: dict[str, list[str]], label: str, key: str, model: str = "logistic") -> list[tuple[str, float, float]]:
    """family, score with it and all before it, and the gain."""
    used, last, out = [], 0.0, []
    score = scorer(df, [f for fs in families.values() for f in fs], label, key, model)
    for name, fs in families.items():
        used += fs
        now = score(used)
        out.append((name, now, now - last))
        last = now
    return out


def forward_selection(df: DataFrame, candidates: list[str], label: str, key: str, most: int = 20, least_gain: float = 1e-4, model: str = "logistic") -> list[tuple[str, float]]:
    """Features in the order in which each adds most, until none adds ``least_gain``."""
    chosen, last, out = [], 0.0, []
    score = scorer(df, candidates, label, key, model)
    while len(chosen) < min(most, len(candidates)):
        best = max(((score([*chosen, f]), f) for f in candidates if f not in chosen), key=lambda x: (x[0], x[1]))
        if best[0] - last < least_gain:
            break
        chosen.append(best[1])
        last = best[0]
        out.append((best[1], last))
    return out


def feature_elimination(df: DataFrame, ranked: list[str], label: str, key: str, steps: tuple[int, ...] = (1, 2, 3, 5, 7, 10, 15, 20), model: str = "logistic") -> list[tuple[int, float]]:
    """Scores with the first n of the ranked features."""
    sizes = sorted({n for n in steps if n < len(ranked)} | {len(ranked)})
    score = scorer(df, ranked, label, key, model)
    return [(n, score(ranked[:n])) for n in sizes]


@dataclass
class Space:
    """Values of a parameter: a list, or (kind, low, high) with kind int_range, uniform or log_uniform."""

    values: list | tuple
    points: int = 5

    def draw(self, rng: random.Random):
        if isinstance(self.values, list):
            return rng.choice(self.values)
        kind, lo, hi = self.values
        return rng.randint(lo, hi) if kind == "int_range" else rng.uniform(lo, hi) if kind == "uniform" else lo * (hi / lo) ** rng.random()

    def grid(self) -> list:
        if isinstance(self.values, list):
            return self.values
        kind, lo, hi = self.values
        if kind == "int_range":
            return sorted({round(lo + (hi - lo) * i / (self.points - 1)) for i in range(self.points)})
        return [lo + (hi - lo) * i / (self.points - 1) if kind == "uniform" else lo * (hi / lo) ** (i / (self.points - 1)) for i in range(self.points)]


@dataclass
class Search:
    best: dict = field(default_factory=dict)
    score: float = -1.0
    trials: list[tuple[dict, float]] = field(default_factory=list)


def search(df: DataFrame, features: list[str], label: str, key: str, space: dict[str, Space], model: str = "logistic", trials: int | None = None, seed: int = 42, on_trial: Callable[[dict, float], None] | None = None) -> Search:
    """Grid search, or random search if a number of trials is given; the callback may save what was tried."""
    rng = random.Random(seed)
    if trials is None:
        sets: list[dict] = [{}]
        for name, s in space.items():
            sets = [p | {name: v} for p in sets for v in s.grid()]
    else:
        sets = [{n: s.draw(rng) for n, s in space.items()} for _ in range(trials)]
    out = Search()
    score = scorer(df, features, label, key, model)
    for params in sets:
        got = score(features, **params)
        out.trials.append((params, got))
        if got > out.score:
            out.best, out.score = params, got
        if on_trial:
            on_trial(params, got)
    return out


def learning_curve(df: DataFrame, features: list[str], label: str, key: str, shares: tuple[float, ...] = (0.1, 0.25, 0.5, 1.0), model: str = "logistic") -> list[tuple[float, float, float]]:
    """share of the training part, f1 there and on the test part; the parts are nested."""
    parts = sampling.train_test(prepared(df, features, label, key), "label", key)
    parts = materialize(parts.withColumn("__u", sampling.uniform(F.col(key), seed=5)))
    test, out = parts.filter("part = 'test'"), []
    for s in shares:
        part = parts.filter((F.col("part") == "train") & (F.col("__u") <= s))
        fitted = pipeline(features, model).fit(part)
        out.append((s, *[stats.confusion(predict(fitted, t), "label", "prediction").first()["f1"] or 0.0 for t in (part, test)]))
    return out


def linear_attribution(fitted: PipelineModel, df: DataFrame, features: list[str]) -> list[tuple[str, float]]:
    """feature, mean absolute Shapley value of a linear model's score: the coefficient times the distance from the mean, exact for it."""
    table = fitted.transform(df)
    x = vector_to_array("features")
    means = table.agg(*[F.avg(x[i]).alias(f"m{i}") for i in range(len(features))])
    weights = fitted.stages[-1].coefficients.toArray()
    row = table.crossJoin(F.broadcast(means)).agg(*[F.avg(F.abs(F.lit(float(w)) * (x[i] - F.col(f"m{i}")))).alias(f"v{i}") for i, w in enumerate(weights)]).first()
    return sorted(((f, float(row[f"v{i}"] or 0.0)) for i, f in enumerate(features)), key=lambda t: (-t[1], t[0]))


def single_features(df: DataFrame, features: list[str], label: str, key: str, model: str = "logistic") -> list[tuple[str, float]]:
    """feature, score of a model on it alone, best first."""
    score = scorer(df, features, label, key, model)
    return sorted(((f, score([f])) for f in features), key=lambda x: (-x[1], x[0]))


def single_adds(df: DataFrame, backbone: list[str], candidates: list[str], label: str, key: str, model: str = "logistic") -> list[tuple[str, float, float]]:
    """feature, score of the backbone with it, and the gain."""
    score = scorer(df, list(dict.fromkeys([*backbone, *candidates])), label, key, model)
    base = score(backbone) if backbone else 0.0
    out = [(f, score([*backbone, f])) for f in candidates if f not in backbone]
    return sorted(((f, s, s - base) for f, s in out), key=lambda x: (-x[2], x[0]))


def compare_families(df: DataFrame, families: dict[str, list[str]], label: str, key: str, model: str = "logistic", k: int = 5) -> list[tuple[str, int, float, float]]:
    """family, features, mean and deviation of the score over the folds; ``all`` is their union."""
    out, every = [], [f for x in families.values() for f in x]
    table = materialize(sampling.folds(prepared(df, every, label, key), "label", key, k))

    def score(fs: list[str], i: int) -> float:
        fitted = pipeline(fs, model).fit(table.filter(F.col("fold") != i))
        return stats.confusion(predict(fitted, table.filter(F.col("fold") == i)), "label", "prediction").first()["f1"] or 0.0

    for name, fs in [*families.items(), ("all", every)]:
        scores = [score(fs, i) for i in range(k)]
        mean = sum(scores) / len(scores)
        out.append((name, len(fs), mean, (sum((s - mean) ** 2 for s in scores) / len(scores)) ** 0.5))
    return out


def analysis(df: DataFrame, families: dict[str, list[str]], label: str, key: str, model: str = "logistic") -> list[tuple[str, str, float]]:
    """step, name, value of the whole analysis: families, single features, and the first ones of their ranking together."""
    every = [f for fs in families.values() for f in fs]
    single = single_features(df, every, label, key, model)
    out = [("family", n, s) for n, _, s, _ in compare_families(df, families, label, key, model)]
    out += [("single", f, s) for f, s in single]
    return out + [("first", str(n), s) for n, s in feature_elimination(df, [f for f, _ in single], label, key, model=model)]


def search_run(df: DataFrame, features: list[str], label: str, key: str, space: dict[str, Space], model: str = "logistic", trials: int | None = None, fill: str = "median") -> dict[str, object]:
    """The whole search: missing values filled as asked for, search, model of the best parameters, curve and plateau."""
    table = quality.fill_plain(df, features, fill) if fill != "median" else df
    found = search(table, features, label, key, space, model, trials)
    _, train, test = holdout(table, features, label, key, model, **found.best)
    curve = learning_curve(table, features, label, key, model=model)
    return {"best": found.best, "score": found.score, "trials": found.trials, "train_f1": train["f1"] or 0.0, "test_f1": test["f1"] or 0.0, "curve": curve, "plateau": plateau([t for _, _, t in curve])}


def smooth(values: list[float], window: int = 3) -> list[float]:
    """Moving average over ``window`` points, the ends repeated."""
    before, after = window // 2, window - 1 - window // 2
    padded = [values[0]] * before + values + [values[-1]] * after if values else []
    return [sum(padded[i : i + window]) / window for i in range(len(values))]


def plateau(values: list[float], threshold: float = 0.001, patience: int = 2, window: int = 3) -> int | None:
    """The place after the first ``patience`` relative gains of the smoothed curve in a row that stay below the threshold."""
    s = smooth(values, window)
    run = 0
    for i, (a, b) in enumerate(zip(s, s[1:])):
        run = run + 1 if (b - a) / (abs(a) + 1e-10) < threshold else 0
        if run >= patience:
            return i - patience + 2
    return None


def plateau_at(values: list[float], target: float = 0.95, tolerance: float = 0.005) -> int | None:
    """The first place that reaches the target within the tolerance."""
    return next((i for i, v in enumerate(values) if v >= target - tolerance), None)


def plateau_by_halves(values: list[float], alpha: float = 0.05, least: int = 5) -> int | None:
    """The middle, if the second half doesn't differ from the first by the signed-rank test; None below twice ``least`` values."""
    mid = len(values) // 2
    if len(values) < 2 * least:
        return None
    first, second = values[:mid], values[mid : 2 * mid]
    return mid if stats.wilcoxon(second, first)[1] > alpha else None
