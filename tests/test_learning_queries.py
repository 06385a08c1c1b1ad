from glyphmill.operators import ml
from glyphmill.plans import learning


def test_permutation_importance_scores_all_features_with_all_repeats(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(ml, "permuted", lambda df, feature, key, seed: calls.append(feature) or df)
    rows = learning.permutation_importance(spark, "/root/testdata/sf0.001").collect()
    assert {r["feature"] for r in rows} == set(learning.FEATURES)
    assert all(calls.count(f) == 3 for f in learning.FEATURES)
