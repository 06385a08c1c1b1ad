import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import mixing as M
from glyphmill.llm import proportions as Q

GEN = "id string, domain string, model string, is_ai int, attack string, received_at timestamp, cell_domain string"
TARGETS = "dimension string, category string, target_share double, min_rows int"


def test_flow_is_of_least_cost():
    rng = np.random.default_rng(1)
    for _ in range(40):
        left, right = np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])
        room, cost = rng.integers(0, 4, 4), rng.integers(0, 9, 4).astype(float)
        need_l, need_r = rng.integers(0, 4, 2), rng.integers(0, 4, 2)
        t = Q.Transport(left, right, room, cost, 2, 2)
        sides = tuple([[[int(n), -100.0]] if n else [] for n in need] for need in (need_l, need_r))
        sent = t.run(sides, 99)
        best = max(((sum(x), -float(np.dot(x, cost))) for x in itertools.product(*[range(r + 1) for r in room]) if x[0] + x[1] <= need_l[0] and x[2] + x[3] <= need_l[1] and x[0] + x[2] <= need_r[0] and x[1] + x[3] <= need_r[1]))
        assert sent == best[0] and np.isclose(float(t.flow @ cost), -best[1])


def test_margins_are_met_where_they_can_be():
    rng = np.random.default_rng(2)
    cells = np.array(list(itertools.product(range(3), range(4), range(2), range(3))))
    available = rng.integers(20, 60, len(cells))
    shares = [np.array([0.5, 0.3, 0.2]), np.array([0.4, 0.3, 0.2, 0.1]), np.array([0.5, 0.5]), np.array([0.6, 0.3, 0.1])]
    quota, goals = Q.quotas(cells, available, shares, [np.zeros(len(s), int) for s in shares], 500)
    assert quota.sum() == 500 and (quota <= available).all() and Q.deviation(cells, quota, goals) == 0
    again, _ = Q.quotas(cells, available, shares, [np.zeros(len(s), int) for s in shares], 500)
    other, _ = Q.quotas(cells, available, shares, [np.zeros(len(s), int) for s in shares], 500, seed=3)
    assert (quota == again).all() and (quota != other).any()


def test_sample_and_report(spark):
    rows = [(f"i{k}", ["essay", " ESSAY", "news", None][k % 4], "human" if k % 3 else "bot", 0 if k % 3 else 1, "none", None, "z") for k in range(600)] + [("i0", "news", "bot", 1, "none", None, "z"), (None, "news", "bot", 1, "none", None, "z")]
    g = spark.createDataFrame(rows, GEN)
    t = spark.createDataFrame([("domain", "essay", 0.5, 10), ("domain", "news", 0.5, 10), ("domain", "sermon", 0.0, 5), ("model", "human", 0.5, 0), ("model", "bot", 0.5, None), ("is_ai", "0", None, 0), ("attack", "none", 1.0, 0), ("other", "x", 1.0, 1), (None, None, None, None)], TARGETS)
    drawn, report = Q.sample(g, t, 200)
    got = drawn.collect()
    assert len(got) == 200 == len({r["id"] for r in got})
    r = {(x["dimension"], x["category"]): x for x in report.collect()}
    assert r["domain", "essay"]["drawn_rows"] == 100 and r["model", "bot"]["drawn_rows"] == 100 and r["domain", "sermon"]["minimum_met"] is False and r["domain", "sermon"]["available"] == 0
    assert Q.sample(g, t, 10**6)[0].count() == 600
    empty, report = Q.sample(g.limit(0), t)
    assert empty.count() == 0 and not any(x["target_met"] for x in report.collect())
    assert Q.sample(g, t.limit(0), 50)[0].count() == 50


DOCS = "doc_id bigint, text string, source string, n_tokens int, key int"


def documents(spark, n=300):
    rows = [(k, "some words of a text " * (1 + k % 7), ["big", "big", "mid", "small"][k % 4] if k % 50 else None, 1, 1) for k in range(n)]
    return spark.createDataFrame([*rows, (1000, None, "big", 1, 1), (1001, "  ", "big", 1, 1), (1002, "huge " * 200_000, "alone", 1, 1)], DOCS)


def test_mix_keeps_budgets_and_repeats(spark):
    t = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.2, 2), ("small", 0.3, 3), ("gone", 0.1, 2), ("alone", None, None)], "source string, target_weight double, max_repeats int")
    drawn, planned = M.mix(documents(spark), t, 6000)
    rows = drawn.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) and {r["source"] for r in rows} <= {"big", "mid", "small"}
    plan = {r["source"]: r for r in planned.collect()}
    for s, most in (("big", 1), ("mid", 2), ("small", 3)):
        own = [r for r in rows if r["source"] == s]
        used = sum(r["times"] * r["n_tokens"] for r in own)
        assert used <= plan[s]["budget"] and max(r["times"] for r in own) <= most and max(r["times"] for r in own) - min(r["times"] for r in own) <= 1
        if plan[s]["budget"] < plan[s]["size"] * most:
            assert plan[s]["budget"] - used < 40
        if plan[s]["epochs"]:
            assert len(own) == plan[s]["n_documents"]  # whole epochs use every document
    report = {r["source"]: r for r in M.report(documents(spark), t, 6000).collect()}
    assert report["gone"]["tokens"] == 0 and report["gone"]["shortfall"] == report["gone"]["budget"] and report[None]["target_share"] == 0 and report["alone"]["budget"] == 0
    assert sorted(map(tuple, M.mix(documents(spark), t, 6000)[0].collect())) == sorted(map(tuple, rows))
    assert M.mix(documents(spark).limit(0), t)[0].count() == 0


def test_fraction_is_a_prefix_of_the_keys(spark):
    t = spark.createDataFrame([("big", 1.0, 1)], "source string, target_weight double, max_repeats int")
    drawn = {r["doc_id"] for r in M.mix(documents(spark), t, 900)[0].collect()}
    order = [r["doc_id"] for r in M.weighed(documents(spark)).filter("source = 'big'").orderBy("key", "doc_id").collect()]
    assert drawn == set(order[: len(drawn)]) and 0 < len(drawn) < len(order)


def test_tokens_are_those_of_the_public_tokenizer():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ["Hello world's end.", "Zoë  x\n\ny", "a " * 50_000]
    assert M.count_tokens(texts) == [len(x.ids) for x in t.encode_batch(texts, add_special_tokens=False)] and M.count_tokens([None, "", " "]) == [0, 0, 0]


def test_quotas_are_as_near_as_any_in_four_dimensions():
    rng = np.random.default_rng(5)
    worst = 0
    for _ in range(12):
        cells = np.array(list(itertools.product(range(2), repeat=4)))[rng.permutation(16)[:7]]
        available = rng.integers(0, 4, len(cells))
        size = int(available.sum()) // 2
        shares = [np.array(p) / sum(p) for p in rng.integers(1, 9, (4, 2))]
        none = [np.zeros(2, int)] * 4
        quota, goals = Q.quotas(cells, available, shares, none, size)
        best = min(Q.deviation(cells, np.array(x), goals) for x in itertools.product(*[range(a + 1) for a in available]) if sum(x) <= size)
        worst = max(worst, Q.deviation(cells, quota, goals) - best)
    assert worst == 0


def test_minimums_come_first_in_every_dimension():
    cells = np.array(list(itertools.product(range(2), repeat=4)))
    available = np.full(len(cells), 10)
    available[cells[:, 3] == 1] = 1
    shares = [np.array([0.9, 0.1])] * 3 + [np.array([1.0, 0.0])]
    quota, _ = Q.quotas(cells, available, shares, [np.zeros(2, int)] * 3 + [np.array([0, 8])], 40)
    assert quota.sum() == 40 and quota[cells[:, 3] == 1].sum() == 8


def test_mix_with_one_quality_throughout(spark):
    rows = [(k, "1 2 3 4 5 6 7 8", "big" if k % 3 else "small", 1, 1) for k in range(3000)]
    t = spark.createDataFrame([("big", 0.6, 1), ("small", 0.4, 1)], "source string, target_weight double, max_repeats int")
    weighed = M.weighed(spark.createDataFrame(rows, DOCS))
    assert weighed.select(F.max("quality")).head()[0] < 0.3
    drawn, planned = M.mix(spark.createDataFrame(rows, DOCS), t, 9000)
    plan = {r["source"]: r for r in planned.collect()}
    for s, ids in ((s, {r["doc_id"] for r in drawn.filter(F.col("source") == s).collect()}) for s in ("big", "small")):
        own = [(r["doc_id"], r["n_tokens"]) for r in weighed.filter(F.col("source") == s).orderBy("key", "doc_id").collect()]
        upto, want = 0, set()
        for doc, n in own:
            upto += n
            if upto > plan[s]["rest"]:
                break
            want.add(doc)
        assert ids == want and want
