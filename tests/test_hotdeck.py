import math
import random

from pyspark.sql import functions as F

from glyphmill.operators import hotdeck

SCHEMA = "row_id bigint, id string, domain string, model string, computed_at timestamp, n_tokens_doc double, n_sentences_doc int, avg_word_length double, avg_sentence_length double, sentence_length_std double, max_tree_depth double, avg_sentence_length_state string, __hd string"


def rows(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        s = rng.randint(1, 20)
        t = float(s * rng.randint(6, 20))
        out.append([i, f"g{i}", rng.choice(["essay", " Essay", None, "news"]), rng.choice(["human", "x"]), None, t, s, 4.5, t / s, 1.5 if s > 1 else 0.0, float(rng.randint(2, 9)), "old", "y"])
    return out


def test_every_form_of_missing_is_filled_and_marked(spark):
    data = rows(80)
    bad = [None, math.nan, math.inf, -math.inf, -1.0, -999.0, 0.0, 9999.0]
    for i, v in enumerate(bad):
        data[i][8] = v
    data[10][9], data[10][6], data[11][9], data[11][6] = 0.0, 9, 0.0, 3  # a deviation of 0 counts from four sentences on
    data[12][8] = 290.0  # large but possible
    out = {r["row_id"]: r for r in hotdeck.impute(spark.createDataFrame(data, SCHEMA), hotdeck.stylometric_deck()).collect()}
    assert len(out) == 80
    for i in range(8):
        assert out[i]["avg_sentence_length_state"] == "filled" and out[i]["avg_sentence_length"] > 0 and out[i]["avg_sentence_length_donor"] not in range(8)
    assert out[10]["sentence_length_std_state"] == "filled" and out[11]["sentence_length_std_state"] == "observed"
    assert out[12]["avg_sentence_length"] == 290.0 and out[12]["avg_sentence_length_state"] == "observed"
    assert out[20]["avg_sentence_length_donor"] is None


def test_values_of_the_nearest_donors_by_brute_force(spark):
    rng = random.Random(3)
    data = [(i, rng.choice("ab"), rng.random() * 10, rng.random() * 5 if rng.random() < 0.9 else None, None if i % 7 == 0 else float(rng.randint(0, 99))) for i in range(120)]
    df = spark.createDataFrame(data, "k int, c string, x double, y double, v double")
    deck = hotdeck.Deck("k", {"v": F.col("v").isNull()}, {"x": F.col("x"), "y": F.col("y")}, {"c": F.col("c")}, ((),), F.col("x"))
    scale = df.agg(*[F.expr(f"percentile_approx({c}, array(0.1, 0.9), 1000)") for c in ("x", "y")]).first()
    scale = [q[1] - q[0] for q in scale]
    for r in hotdeck.impute(df, deck).filter("v_state = 'filled'").collect():
        me = data[r["k"]]

        def far(d, me=me):
            gaps = [min(abs(d[2] - me[2]) / scale[0], 3.0)] + ([min(abs(d[3] - me[3]) / scale[1], 3.0)] if d[3] is not None and me[3] is not None else [])
            return (sum(gaps) + 0.5 * (d[1] != me[1])) / (len(gaps) + 1)

        near = sorted((d for d in data if d[4] is not None), key=lambda d: (far(d), d[0]))[: hotdeck.K]
        assert r["v_donor"] == near[0][0]
        ranked = sorted((d[4], 1 / (far(d) + 0.01)) for d in near)
        half, total = sum(w for _, w in ranked) / 2, 0.0
        for v, w in ranked:
            total += w
            if total >= half:
                break
        assert r["v"] == v


def test_hot_block_is_cut_into_runs(spark, monkeypatch):
    monkeypatch.setattr(hotdeck, "RUN", 50)
    data = rows(900, 5)
    for r in data:
        r[2], r[3], r[5], r[6] = "essay", "human", 100.0, 10  # all alike, all tie
    for r in data[:30]:
        r[10] = None
    deck = hotdeck.stylometric_deck()
    df = spark.createDataFrame(data, SCHEMA)
    assert hotdeck.impute(df, deck).filter("max_tree_depth_state = 'filled'").count() == 30
    pool = hotdeck._prepared(df, deck).withColumns({"__hd_level": F.lit(0), "__hd_block": F.lit(1)})
    largest = hotdeck._runs(pool).groupBy("__hd_level", "__hd_block", "__hd_run", "__hd_part").count().agg(F.max("count")).first()[0]
    assert largest < 250


def test_no_donors_empty_table_and_categories(spark):
    deck = hotdeck.stylometric_deck()
    lone = rows(1)
    lone[0][8] = None
    assert hotdeck.impute(spark.createDataFrame(lone, SCHEMA), deck).first()["avg_sentence_length_state"] == "unfilled"
    assert hotdeck.impute(spark.createDataFrame([], SCHEMA), deck).count() == 0
    own = hotdeck.Deck("k", {"c": F.col("c").isNull()}, {"x": F.col("x")}, {}, ((),), F.col("x"))
    got = hotdeck.impute(spark.createDataFrame([(1, "a", 1.0), (2, "a", 1.1), (3, "b", 9.0), (4, None, 1.05)], "k int, c string, x double"), own).filter("k = 4").first()
    assert got["c"] == "a" and got["c_donor"] in (1, 2)


def test_donors_of_all_runs_are_compared(spark, monkeypatch):
    monkeypatch.setattr(hotdeck, "RUN", 20)
    rng = random.Random(6)
    # the ordering feature says little, so the nearest donors lie in other runs; the last run has an asking record alone
    data = [(i, float(i), rng.random() * 1000, None if i % 6 == 0 or i == 240 else float(rng.randint(0, 99))) for i in range(241)]
    df = spark.createDataFrame(data + data[:1], "k int, o double, y double, v double")
    deck = hotdeck.Deck("k", {"v": F.col("v").isNull()}, {"y": F.col("y")}, {}, ((),), F.col("o"))
    out = {r["k"]: r for r in hotdeck.impute(df, deck).collect()}
    assert hotdeck.impute(df, deck).count() == 242
    for k, _, y, v in data:
        if v is None:
            near = sorted((d for d in data if d[3] is not None), key=lambda d: abs(d[2] - y))[: hotdeck.K]
            assert out[k]["v_state"] == "filled" and out[k]["v_donor"] == near[0][0] and out[k]["v"] in [d[3] for d in near]
