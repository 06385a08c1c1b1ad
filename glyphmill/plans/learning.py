"""Model queries: metrics, importances, ablation and curves as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.operators import ml
from glyphmill.session import read_table

FEATURES = ["n_tokens_doc", "avg_word_length", "type_token_ratio", "avg_sentence_length", "sentence_length_std", "max_tree_depth"]
FAMILIES = {"lexical": FEATURES[:3], "syntactic": FEATURES[3:]}


def _table(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "stylometric_features").select("row_id", "is_ai", *FEATURES)


def _metrics(model: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        _, train, test = ml.holdout(_table(s, d), FEATURES, "is_ai", "row_id", model)
        rows = [(k, float(train[k] or 0.0), float(test[k] or 0.0), float(train[k] or 0.0) - float(test[k] or 0.0)) for k in ("accuracy", "precision", "recall", "f1", "roc_auc")]
        return s.createDataFrame(rows, "metric string, train double, test double, gap double")

    run.__name__ = f"{model}_eval"
    return run


def feature_importance(s: SparkSession, d: str) -> DataFrame:
    fitted = ml.pipeline(FEATURES, "gbt").fit(ml.prepared(_table(s, d), FEATURES, "is_ai", "row_id"))
    return s.createDataFrame(ml.gain_importance(fitted, FEATURES), "feature string, importance double, pct double, rank_no int")


def permutation_importance(s: SparkSession, d: str) -> DataFrame:
    table = ml.prepared(_table(s, d), FEATURES, "is_ai", "row_id")
    fitted = ml.pipeline(FEATURES, "logistic").fit(table)
    return s.createDataFrame(ml.permutation_importance(fitted, table, FEATURES, "row_id"), "feature string, importance double")


def family_ablation(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame(ml.ablation(_table(s, d), FAMILIES, "is_ai", "row_id"), "family string, without double, delta double")


def learning_curve(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame(ml.learning_curve(_table(s, d), FEATURES, "is_ai", "row_id"), "share double, train_f1 double, test_f1 double")


def roc_points(s: SparkSession, d: str) -> DataFrame:
    """The points of the ROC curve at 100 thresholds."""
    table = ml.prepared(_table(s, d), FEATURES, "is_ai", "row_id")
    p = ml.predict(ml.pipeline(FEATURES, "logistic").fit(table), table)
    counts = p.groupBy(F.floor(F.col("score") * 100).alias("bin")).agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    from pyspark.sql import Window as W

    above = W.orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, 0)
    every = W.partitionBy(F.lit(1))
    return counts.select((F.col("bin") / 100).alias("threshold"), F.round(F.sum("n").over(above) / F.sum("n").over(every), 6).alias("fpr"), F.round(F.sum("p").over(above) / F.sum("p").over(every), 6).alias("tpr"))


def linear_attribution(s: SparkSession, d: str) -> DataFrame:
    table = ml.prepared(_table(s, d), FEATURES, "is_ai", "row_id")
    return s.createDataFrame(ml.linear_attribution(ml.pipeline(FEATURES, "logistic").fit(table), table, FEATURES), "feature string, mean_abs_value double")


def single_features(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame(ml.single_features(_table(s, d), FEATURES, "is_ai", "row_id"), "feature string, f1 double")


def single_adds(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame(ml.single_adds(_table(s, d), FAMILIES["lexical"], FAMILIES["syntactic"], "is_ai", "row_id"), "feature string, f1 double, gain double")


def family_comparison(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame(ml.compare_families(_table(s, d), FAMILIES, "is_ai", "row_id"), "family string, n_features int, mean_f1 double, std_f1 double")


def family_increments(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame(ml.incremental(_table(s, d), FAMILIES, "is_ai", "row_id"), "family string, f1 double, gain double")


def forward_selection(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame(ml.forward_selection(_table(s, d), FEATURES, "is_ai", "row_id"), "feature string, f1 double")


def feature_elimination(s: SparkSession, d: str) -> DataFrame:
    ranked = [f for f, _ in ml.single_features(_table(s, d), FEATURES, "is_ai", "row_id")]
    return s.createDataFrame(ml.feature_elimination(_table(s, d), ranked, "is_ai", "row_id"), "n_features int, f1 double")


SPACE = {"regParam": ml.Space(("log_uniform", 1e-4, 1.0), 3), "maxIter": ml.Space([20, 50])}


def _trials(s: SparkSession, found: list) -> DataFrame:
    return s.createDataFrame([(float(p["regParam"]), int(p["maxIter"]), f) for p, f in found], "reg_param double, max_iter int, f1 double")


def grid_search(s: SparkSession, d: str) -> DataFrame:
    return _trials(s, ml.search(_table(s, d), FEATURES, "is_ai", "row_id", SPACE).trials)


def random_search(s: SparkSession, d: str) -> DataFrame:
    return _trials(s, ml.search(_table(s, d), FEATURES, "is_ai", "row_id", SPACE, trials=4).trials)


def search_summary(s: SparkSession, d: str) -> DataFrame:
    """Searches with each way to fill missing values: best score, gap, and the place of the plateau."""
    rows = []
    for fill in ("median", "mean", "zero"):
        r = ml.search_run(_table(s, d), FEATURES, "is_ai", "row_id", {"regParam": ml.Space([0.001, 0.1])}, fill=fill)
        rows.append((fill, float(r["score"]), float(r["train_f1"] - r["test_f1"]), r["plateau"]))
    return s.createDataFrame(rows, "fill string, best_f1 double, gap double, plateau int")


def plateaus(s: SparkSession, d: str) -> DataFrame:
    """Where the learning curve's test score levels off, by each of the three ways."""
    curve = [t for _, _, t in ml.learning_curve(_table(s, d), FEATURES, "is_ai", "row_id", tuple(i / 10 for i in range(1, 11)))]
    return s.createDataFrame([("gradient", ml.plateau(curve)), ("threshold", ml.plateau_at(curve)), ("statistical", ml.plateau_by_halves(curve))], "method string, place int")


_EXTRA = (linear_attribution, single_features, single_adds, family_comparison, family_increments, forward_selection, feature_elimination, grid_search, random_search, search_summary, plateaus)
QUERIES = {f.__name__: f for f in (*map(_metrics, ml.MODELS), feature_importance, permutation_importance, family_ablation, learning_curve, roc_points, *_EXTRA)}
ORACLE: dict[str, str] = {}
