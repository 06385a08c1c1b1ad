import random

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import ml, quality, ranking, sampling, stats


def test_quantiles_are_exact(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), float(rng.choice([1, 2, 2, 5, 9])) if i % 7 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r["q"] for r in ranking.quantiles(df, ["g"], "v", [0.01, 0.5, 0.99]).collect()}
    want = {r["g"]: r["q"] for r in df.filter("v is not null").groupBy("g").agg(F.percentile("v", F.array(F.lit(0.01), F.lit(0.5), F.lit(0.99))).alias("q")).collect()}
    assert {k: pytest.approx(v) for k, v in want.items()} == got
    assert ranking.quantiles(df, [], "v", [0.25]).first()["q"][0] == df.agg(F.percentile("v", 0.25)).first()[0]
    assert ranking.quantiles(df.limit(0), ["g"], "v", [0.5]).count() == 0


def test_class_ranks(spark):
    df = spark.createDataFrame([(i, i % 3 if i % 10 else None) for i in range(100)], "k int, y int")
    rows = ranking.class_ranks(df, "y", [-F.col("k")], "r", "n").collect()
    for y in (0, 1, 2, None):
        own = sorted((r for r in rows if r["y"] == y), key=lambda r: -r["k"])
        assert [r["r"] for r in own] == list(range(len(own))) and {r["n"] for r in own} == {len(own)}


def test_nested_quotas_and_allocations():
    assert sampling.remainder(10, {"short": 0.25, "medium": 0.25, "long": 0.5}) == {"short": 3, "medium": 2, "long": 5}
    assert sampling.remainder(10, {"a": 3, "b": 4, "c": 100}) == {"a": 0, "b": 1, "c": 9}
    counts = {(0, "x"): 50, (0, "y"): 5, (1, "x"): 40}
    dims = [sampling.Dimension("l", {0: 0.5, 1: 0.25, 2: 0.25}), sampling.Dimension("s", even=True)]
    assert sampling.nested_quotas(counts, 30, dims) == {(0, "x"): 10, (0, "y"): 5, (1, "x"): 10}
    only = [sampling.Dimension("l", {0: 0.5, 1: 0.5}), sampling.Dimension("s", even=True, only=1)]
    assert sampling.nested_quotas(counts, 20, only) == {(0, "x"): 9, (0, "y"): 1, (1, "x"): 10}
    assert sampling.nested_quotas({}, 5, dims) == {}


def test_samples(spark):
    df = spark.range(400).select(F.col("id").alias("k"), (F.col("id") % 2).cast("int").alias("l"), F.when(F.col("id") % 5 == 0, None).otherwise((F.col("id") % 3).cast("string")).alias("s"))
    dims = [sampling.Dimension("l", {0: 0.75, 1: 0.25}), sampling.Dimension("nowhere"), sampling.Dimension("s")]
    out = sampling.stratified_by(df, 40, dims, "k").collect()
    assert len(out) == 40 and sum(r["l"] == 0 for r in out) == 30 and all(r["s"] for r in out)
    many = sampling.many_samples(df, 20, dims, "k", 2).collect()
    first, second = ({r["k"] for r in many if r["sample"] == i} for i in (0, 1))
    assert len(first) == len(second) == 20 and first != second
    assert sampling.presample(df, 7, "k").count() == 7 and sampling.presample(df, 999, "k").count() == 400 and sampling.presample(df.limit(0), 5, "k").count() == 0


def test_prepared_corpus(spark):
    good = "This is a plain sentence of several words, and it goes on for a while with more of them. " * 5
    rows = [("a", good, "bot", "news"), ("a", good + "zz", "bot", "news"), ("b", "  ", "bot", "news"), ("c", good, "human", "speech"), ("d", "<b>x</b>", "human", "news"), ("e", None, "human", "news"), ("f", good.upper(), None, None)]
    df = spark.createDataFrame(rows, "id string, generation string, model string, domain string")
    out = {r["id"]: r for r in sampling.prepared_corpus(df, "generation", "id", (F.col("model") == "human").cast("int"), {"domain": ("speech",)}, gate=False).collect()}
    assert set(out) == {"a", "d", "f"} and out["d"]["generation"] == "x" and out["a"]["generation"] == good.strip() and out["a"]["label"] == 0 and out["f"]["label"] is None
    assert "d" not in {r["id"] for r in sampling.prepared_corpus(df, "generation", "id", F.lit(1), None).collect()}


def test_small_table_operators(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, None, 4.0), (3, 5.0, float("inf"))], "k int, a double, b double")
    twice = df.select("k", "a", F.col("b").alias("A"))
    assert quality.drop_duplicate_columns(twice).columns == ["k", "a"]
    assert [r["a"] for r in quality.fill_plain(df, ["a"], "mean").orderBy("k").collect()] == [1.0, 3.0, 5.0] and [r["b"] for r in quality.fill_plain(df, ["b"], "zero").orderBy("k").collect()] == [0.0, 4.0, 0.0]
    common = quality.most_common(spark.createDataFrame([("x", 1), ("x", 2), ("x", 2), ("y", 3), ("y", 1), ("z", None)], "g string, v int"), ["g"], "v").collect()
    assert {(r["g"], r["most_common"], r["n"]) for r in common} == {("x", 2, 2), ("y", 1, 1)}
    v = {r["feature"]: r for r in quality.validation(df.withColumn("approx", F.col("k") == 1), ["a", "b"], "approx").collect()}
    assert v["b"]["n_infinite"] == 1 and v["b"]["constant"] and not v["a"]["constant"] and v["a"]["approx_rate"] == pytest.approx(1 / 3)
    tests = spark.createDataFrame([("a", 0.4, True), ("b", -0.2, False), ("c", 1.0, True)], "feature string, cohens_d double, bonferroni boolean")
    s = {r["family"]: (r["n_significant"], r["mean_abs_d"]) for r in stats.summary_by_family(tests, {"x": ["a", "b"]}).collect()}
    assert s == {"x": (1, 0.3), "other": (1, 1.0)}


def test_plateaus():
    assert ml.plateau([0.5, 0.7, 0.8, 0.8, 0.8, 0.8, 0.8]) is not None and ml.plateau([0.1, 0.2, 0.4, 0.8]) is None
    assert ml.plateau_at([0.9, 0.946, 0.97]) == 1 and ml.plateau_at([0.5]) is None
    assert ml.plateau_by_halves([0.5, 0.6, 0.55, 0.58, 0.6, 0.5, 0.61, 0.54, 0.59, 0.6]) == 5 and ml.plateau_by_halves([0.1, 0.2, 0.3, 0.2, 0.1, 0.12, 0.8, 0.9, 0.85, 0.9, 0.8, 0.9]) is None


def test_attribution_and_selection(spark):
    df = spark.range(200).select(F.col("id").alias("k"), (F.col("id") % 2).cast("int").alias("y"), ((F.col("id") % 2) * 2 + F.rand(3)).alias("good"), F.rand(4).alias("bad"))
    table = ml.prepared(df, ["good", "bad"], "y", "k")
    fitted = ml.pipeline(["good", "bad"], "logistic").fit(table)
    assert ml.linear_attribution(fitted, table, ["good", "bad"])[0][0] == "good"
    assert ml.single_features(df, ["good", "bad"], "y", "k")[0][0] == "good" and ml.single_adds(df, ["bad"], ["good"], "y", "k")[0][2] > 0.2
    families = ml.compare_families(df, {"g": ["good"], "b": ["bad"]}, "y", "k", k=2)
    assert [f[0] for f in families] == ["g", "b", "all"] and families[0][2] > families[1][2]
    run = ml.search_run(df, ["good"], "y", "k", {"regParam": ml.Space([0.01, 0.1])}, fill="zero")
    assert run["score"] > 0.9 and len(run["trials"]) == 2
