import math
import random

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import text as T
from glyphmill.operators import coherence, contracts, graphs, lexicons, lm, ml, quality, stats


def test_markup_hidden_and_normal_forms(spark):
    df = spark.createDataFrame([("See https://a.b/c <b>bold</b> `code`\n| a | b |\nend",), (None,), ("plain",)], "text string")
    flags = df.select(*T.markup_flags("text")).collect()
    assert list(flags[0]) == [True, True, True, True] and list(flags[2]) == [False] * 4
    assert [r[0] for r in df.select(T.strip_markup("text")).collect()] == ["See bold end", "", "plain"]
    odd = spark.createDataFrame([("ﬁ​ne \x07x",), (None,)], "t string")
    assert [r[0] for r in odd.select(T.normalize("t")).collect()] == ["fine x", ""]


def test_diagnostics_and_gate(spark):
    df = spark.createDataFrame([(1, "aabb"), (2, ""), (3, None), (4, "This is a plain sentence of several words.")], "doc_id int, text string")
    out = {r["doc_id"]: r for r in T.diagnostics(df).withColumn("reasons", T.gate_reasons()).collect()}
    assert out[1]["entropy_bits"] == 1.0 and out[1]["n_tok"] == 1 and out[1]["reasons"].startswith("too_short_chars;too_few_tokens")
    assert out[2]["n_chars"] == 0 and out[2]["avg_word_length"] is None and out[3]["reasons"] == out[2]["reasons"]
    assert out[4]["reasons"] == ""
    assert df.select(T.compression_ratio("text")).collect()[1][0] is None


def test_tokens_and_entities(spark):
    docs = spark.createDataFrame([(1, "The quick Fox ran. It met Alice!"), (2, None), (3, " ... ")], "doc_id bigint, text string")
    rows = contracts.tokens(docs).orderBy("tok_idx").collect()
    one = [r for r in rows if r["doc_id"] == 1]
    assert [r["text"] for r in one] == ["The", "quick", "Fox", "ran", ".", "It", "met", "Alice", "!"]
    assert [r["sent_idx"] for r in one] == [0] * 5 + [1] * 4 and [r["tok_idx"] for r in one] == list(range(9))
    assert {r["entity"] for r in contracts.entities(contracts.tokens(docs)).collect()} == {"fox", "alice"}
    assert contracts.tokens(docs.limit(0)).count() == 0


def test_components_join_chains(spark):
    nodes = spark.createDataFrame([(1, i) for i in range(8)] + [(2, 0)], "doc_id int, node int")
    edges = spark.createDataFrame([(1, i, i + 1) for i in range(5)] + [(1, 6, 7)], "doc_id int, i int, j int")
    got = {(r["doc_id"], r["node"]): r["component"] for r in coherence.components(nodes, edges).collect()}
    assert [got[1, i] for i in range(8)] == [0] * 6 + [6, 6] and got[2, 0] == 0


def test_graph_fixture_and_cycles(spark):
    e = spark.createDataFrame([(1, "started", "continued", 0.95), (1, "continued", "finished", 0.88), (1, "started", "finished", 0.92), (2, "a", "b", 0.9), (2, "b", "c", 0.8), (2, "c", "a", 0.7), (2, "a", "a", 0.99)], "doc_id bigint, src string, dst string, confidence double")
    dag = graphs.greedy_dag(e)
    kept = {(r["src"], r["dst"]) for r in dag.filter("kept and doc_id = 2").collect()}
    assert kept == {("a", "b"), ("b", "c")} and dag.filter("kept and doc_id = 1").count() == 3
    shape = graphs.shapes(dag.filter("kept and doc_id = 1")).first()
    assert shape["longest_path"] == 2 and math.isclose(shape["mean_depth"], 2 / 3) and shape["global_coherence"] == 1.0 and shape["is_dag"]
    cyc = {r["doc_id"]: r for r in graphs.cycles(e).collect()}
    assert cyc[1]["cycle_count"] == 0 and cyc[2]["cycle_count"] == 2 and cyc[2]["cycle_edges"] == 4


def test_lexicon_files(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"_metadata": {"v": 1}, "strong": {"Clearly": {"certainty": 0.9, "pos": ["ADV"]}}, "nested": {"deep": {"of course": {"certainty": 0.8}}}}')
    rows = {r["marker"]: r for r in lexicons.load(spark, {"boosters": str(tmp_path / "x.json"), "hedges": str(tmp_path / "none.json")}).collect()}
    assert rows["clearly"]["certainty"] == 0.9 and rows["clearly"]["pos"] == ["ADV"] and rows["of course"]["n_words"] == 2 and rows["of course"]["category"] == "deep"


def test_quality_operators(spark):
    df = spark.createDataFrame([(i, float(i), 2.0 * i + 1 if i != 5 else None, float("inf") if i == 3 else 1.0) for i in range(20)], "k int, a double, b double, c_ratio double")
    r = {(x["a"], x["b"]): x["r"] for x in quality.correlations(df, ["a", "b"]).collect()}
    assert math.isclose(r["a", "b"], 1.0)
    assert quality.correlated_drops([("a", "b", 0.99), ("a", "c", 0.2)]) == ["b"] and quality.correlated_drops([("a", "b", 0.99)], priority=("b",)) == ["a"]
    assert quality.impute_median(df, ["b"]).filter("k = 5").first()["b"] is not None
    assert "c_ratio" not in quality.drop_named(df, {}, ("RATIO$",)).columns
    cleaned, done = quality.clean(df, ["a", "b", "c_ratio"])
    assert done.correlated == ["b"] and cleaned.count() == 20 and "b" in done.report()
    assert quality.coverage(["a", "z"], df) == (["a"], ["z"], 0.5)


def test_statistics(spark):
    assert math.isclose(stats.t_p_value(2.228, 10), 0.05, abs_tol=1e-3) and stats.t_p_value(0.0, 5) == 1.0
    p = spark.createDataFrame([(1, 1, 0.9), (1, 0, 0.4), (0, 0, 0.4), (0, 1, 0.6)], "y int, z int, s double")
    m = stats.confusion(p, "y", "z").first()
    assert (m["tp"], m["fp"], m["fn"], m["tn"]) == (1, 1, 1, 1) and m["f1"] == 0.5
    assert stats.roc_auc(p, "y", "s").first()[0] == 0.625
    assert stats.roc_auc(p.limit(0), "y", "s").first()[0] is None


def test_wilcoxon_and_saved_models(spark, tmp_path):
    low, p = stats.wilcoxon([1, 2, 3, 4, 5, 6], [2, 4, 6, 8, 10, 12])
    assert low == 0 and 0.02 < p < 0.04 and stats.wilcoxon([1], [1]) == (0.0, 1.0)
    df = spark.range(40).select(F.col("id").alias("k"), (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 2 * 1.0).alias("x"))
    table = ml.prepared(df, ["x"], "y", "k")
    ml.save(ml.pipeline(["x"], "logistic").fit(table), ["x"], str(tmp_path / "m"))
    model, meta = ml.load(str(tmp_path / "m"))
    assert meta["features"] == ["x"] and ml.evaluate(ml.predict(model, table))["f1"] == 1.0


def test_models_learn_and_curves_plateau(spark):
    df = spark.range(200).select(F.col("id").alias("k"), (F.col("id") % 2).cast("int").alias("y"), ((F.col("id") % 2) * 2 + F.rand(3)).alias("good"), F.rand(4).alias("bad"))
    fitted, _, test = ml.holdout(df, ["good", "bad"], "y", "k", "logistic")
    assert test["f1"] > 0.9 and ml.gain_importance(fitted, ["good", "bad"])[0][0] == "good"
    assert ml.forward_selection(df, ["good", "bad"], "y", "k", most=1)[0][0] == "good"
    assert ml.plateau([0.5, 0.7, 0.8, 0.8, 0.8, 0.8, 0.8]) is not None and ml.plateau([]) is None
    assert ml.Space(("int_range", 1, 5), 3).grid() == [1, 3, 5]


def test_permutation_keeps_values(spark):
    df = spark.range(50).select(F.col("id").alias("k"), F.col("id").alias("v"))
    got = ml.permuted(df, "v", "k", "s").collect()
    assert sorted(r["v"] for r in got) == list(range(50)) and any(r["k"] != r["v"] for r in got)


def test_entry_points():
    import __spark_entry__ as e

    names = e.queries()
    assert set(e.oracle_sql()) <= set(names) and len(names) > 100


@pytest.mark.parametrize("name", ["lexical_counts", "lexicon_density", "perplexity", "mention_chains", "transitivity"])
def test_queries_run_on_the_smallest_tables(spark, name):
    from glyphmill.plans import catalog

    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


@pytest.mark.parametrize("block", [4_000_000, 30])
def test_perturbation_in_rows_equals_perturbation_by_joins(spark, monkeypatch, block):
    monkeypatch.setattr(lm, "BLOCK", block)
    rng = random.Random(3)
    words = ["the", "garden", "walked", "Émile", "it's", "quiet", "river", "7", "and", "ox", "evening"]
    texts = [" ".join(rng.choice(words) + rng.choice(["", "", "", ".", "?!", ","]) for _ in range(n)) for n in (1, 5, 20, 21, 22, 60, 150, 900)] + [None, "", "...", "an ox " * 15, "same word same word. " * 9]
    docs = spark.createDataFrame([(7 * i - 3, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r[0]: r[1] for r in lm.perturbation_of(docs).collect()}
    want = {r[0]: r[1] for r in lm.perturbation_discrepancy(contracts.tokens(docs)).collect()}
    assert set(got) == set(want) and len(got) == len(texts) - 3 and sum(x is not None for x in got.values()) > 5
    for k, x in want.items():
        assert got[k] == (None if x is None else pytest.approx(x, abs=2e-6)), k
    assert lm.perturbation_of(docs.limit(0)).count() == 0


def test_perturbation_moves_no_tokens(spark):
    from glyphmill.plans import catalog

    plan = catalog.QUERIES["perturbation"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
