import itertools
import math
import random

import duckdb
import pytest

from glyphmill.operators import contracts, coref, graphs
from glyphmill.plans import coherent, temporal
from glyphmill.plans.portable import on_spark

# The worked example of the feature definitions.
ACTS = [(1, 0, "started", "start", "Past", 10), (1, 1, "continued", "continue", "Past", 30), (1, 2, "finished", "finish", "Past", 50), (2, 0, "will begin", "begin", "Fut", 5), (2, 1, "expects", "expect", "Pres", 25)]
TIMES = [(1, 0, "DATE", "yesterday"), (1, 20, "TIME", "3pm"), (2, 0, "DATE", "tomorrow")]
RELATIONS = [(1, 1, "started", "continued", 10, 30, "BEFORE", 0.95), (1, 2, "continued", "finished", 30, 50, "BEFORE", 0.88), (1, 3, "started", "finished", 10, 50, "BEFORE", 0.92), (2, 1, "will begin", "expects", 5, 25, "AFTER", 0.75)]
TEXTS = [(1, "Yesterday, the meeting started at noon. It continued for two hours and finished at 3pm."), (2, "Tomorrow the project will begin. Everyone expects great results."), (3, "This is a simple text without temporal content.")]
WANT = {
    "temp_num_events": (3, 2), "temp_events_per_sentence": (1.5, 1.0), "temp_num_timex": (2, 1), "temp_timex_event_ratio": (0.666667, 0.5), "temp_event_lexical_diversity": (1.0, 1.0),
    "temp_tense_distribution_entropy": (0, 1.0), "temp_rel_mean_confidence": (0.916667, 0.75), "temp_rel_confidence_variance": (0.000822, 0), "temp_rel_before_after_ratio": (1.0, 0.0),
    "temp_rel_raw_cycle_count": (0, 0), "temp_rel_cycle_edge_ratio": (0, 0), "temp_rel_cycle_approx_flag": (0, 0), "temp_rel_parallel_edge_rate": (0, 0), "temp_rel_type_entropy": (0, 0), "temp_rel_transitivity_violation_rate": (0, 0),
    "tg_degree_entropy": (1.584963, 1.0), "tg_ordering_entropy": (1.584963, 1.0), "tg_avg_in_degree": (1.0, 0.5), "tg_avg_out_degree": (1.0, 0.5), "tg_longest_path": (2, 1), "tg_mean_depth": (0.666667, 0.5),
    "tg_branching_factor": (1.5, 1.0), "tg_global_coherence": (1.0, 1.0), "tg_edge_retention": (1.0, 1.0), "temp_constraint_violation_rate": (0, 0), "temp_constraint_csp_score": (0, 0), "temp_scope_variance": (88.888889, 0),
    "temp_tense_time_alignment": (1.0, 1.0), "temp_deixis_consistency": (0, 0), "temp_ref_time_shifts": (1, 0), "tg_centralization": (0, 0), "tg_clustering_coefficient": (1.0, 0), "tg_density": (0.5, 0.5),
}


def frames(spark):
    return (
        spark.createDataFrame(TEXTS, "doc_id bigint, text string"), spark.createDataFrame(ACTS, "doc_id bigint, pos bigint, word string, lemma string, tense string, place int"),
        spark.createDataFrame(TIMES, "doc_id bigint, pos int, kind string, snippet string"),
        spark.createDataFrame(RELATIONS, "doc_id bigint, seq int, e1 string, e2 string, p1 int, p2 int, relation string, confidence double"),
    )


def test_worked_example(spark):
    got = {r["doc_id"]: r.asDict() for r in temporal.features(*frames(spark)).collect()}
    assert len(WANT) == 33 and set(got[1]) == {"doc_id", *WANT}
    for k, (one, two) in WANT.items():
        assert got[1][k] == pytest.approx(one, abs=1e-6) and got[2][k] == pytest.approx(two, abs=1e-6), k
        assert got[3][k] == (1.0 if k == "temp_tense_time_alignment" else 0), k


def test_graph_features_are_those_of_the_acyclic_graph(spark):
    rng = random.Random(4)
    names = "abcdefg"
    rel = [(d, i, *rng.sample(names, 2), 0, 1, "BEFORE", round(rng.random(), 6)) for d in range(6) for i in range(14)]
    relations = spark.createDataFrame(rel, "doc_id bigint, seq int, e1 string, e2 string, p1 int, p2 int, relation string, confidence double")
    docs = spark.createDataFrame([(d, "") for d in range(6)], "doc_id bigint, text string")
    parts = temporal.graph_features(docs, temporal.edges(relations), relations)
    degrees = {r["doc_id"]: r for r in parts["graph_degrees"].collect()}
    clustering = {r["doc_id"]: r[1] for r in parts["graph_clustering"].collect()}
    retention = {r["doc_id"]: r["tg_edge_retention"] for r in parts["dag_shape"].collect()}
    for d in range(6):
        own = [r for r in rel if r[0] == d]
        best: dict = {}
        for r in own:
            best[r[2], r[3]] = max(best.get((r[2], r[3]), 0), r[7])
        kept: set = set()

        def reaches(a, b):
            return a == b or any(reaches(y, b) for x, y in kept if x == a)

        for (a, b), _ in sorted(best.items(), key=lambda x: (-x[1], x[0])):
            if not reaches(b, a):
                kept.add((a, b))
        nodes = {x for e in best for x in e}
        n, m = len(nodes), len(kept)
        deg = {x: sum(x in e for e in kept) for x in nodes}
        near = {x: {y for e in kept if x in e for y in e if y != x} for x in nodes}
        local = [sum(1 for y, z in itertools.combinations(near[x], 2) if z in near[y]) / (len(near[x]) * (len(near[x]) - 1) / 2) if len(near[x]) > 1 else 0 for x in nodes]
        assert degrees[d]["tg_density"] == pytest.approx(m / (n * (n - 1)), abs=1e-6) and degrees[d]["tg_avg_in_degree"] == pytest.approx(m / n, abs=1e-6)
        assert degrees[d]["tg_centralization"] == pytest.approx(sum((max(deg.values()) - v) / (n - 1) for v in deg.values()) / ((n - 1) * (n - 2)), abs=1e-6)
        assert clustering[d] == pytest.approx(sum(local) / n, abs=1e-6) and retention[d] == pytest.approx(m / len(own), abs=1e-6)


def test_mention_windows_against_counting(spark):
    rng = random.Random(6)
    mentions, entities = [], []
    for t in range(0, 400, 4):
        kind = rng.random()
        if kind < 0.5:
            entities.append((1, t // 20, t, f"n{t % 7}"))
            mentions.append((1, t // 20, t, False, rng.choice([1, 2]), f"n{t % 7}"))
        elif kind < 0.7:
            mentions.append((1, t // 20, t, True, 1, "n1"))
    frames = {
        "documents": spark.createDataFrame([(1, ""), (2, "")], "doc_id int, text string"),
        "mentions": spark.createDataFrame(mentions, "doc_id int, sent_idx int, tok_idx int, is_pronoun boolean, n_tokens int, chain string"),
        "entities": spark.createDataFrame(entities, "doc_id int, sent_idx int, tok_idx int, entity string"),
    }
    contexts = {r["doc_id"]: r for r in on_spark(coherent.SQL["mention_contexts"][0], frames, spark).collect()}
    scales = {r["doc_id"]: r for r in on_spark(coherent.SQL["mention_scales"][0], frames, spark).collect()}
    comp: dict = {"micro": [], "meso": [], "macro": []}
    ents: dict = {"micro": [], "meso": [], "macro": []}
    need, prag = [], []
    for _, s, t, pronoun, n, chain in mentions:
        begin, end = t - n + 1, t + 1
        inside = {"micro": [e for e in entities if abs(e[1] - s) <= 1], "meso": [e for e in entities if begin - 50 <= e[2] < end + 50], "macro": entities}
        for k, found in inside.items():
            ents[k].append(len(found))
            comp[k].append(sum((e[2], e[2] + 1) != (begin, end) for e in found))
        before = [m for m in mentions if m[5] == chain and m[2] < t]
        prag.append(1 if not before or begin - (before[-1][2] + 1) > 100 else 0)
        need.append(1 if comp["micro"][-1] > 0 else 0)
    mean = lambda x: sum(x) / len(x)
    both = need + prag
    row = contexts[1]
    assert row["meso_avg_competitors_moderate"] == pytest.approx(mean(comp["meso"]), abs=1e-6) and row["macro_avg_context_entities"] == pytest.approx(mean(ents["macro"]), abs=1e-6)
    assert row["meso_pragmatic_necessity_rate"] == pytest.approx(mean(prag), abs=1e-6) and row["meso_macro_context_ratio"] == pytest.approx(mean(ents["meso"]) / mean(ents["macro"]), abs=1e-6)
    assert row["micro_macro_competitor_ratio"] == pytest.approx(mean(comp["macro"]) / mean(comp["micro"]), abs=1e-6)
    assert row["necessity_scale_variance"] == pytest.approx(mean([x * x for x in both]) - mean(both) ** 2, abs=1e-6)
    every = comp["micro"] + comp["meso"] + comp["macro"]
    shares = [every.count(x) / len(every) for x in set(every)]
    assert scales[1]["competitor_scale_entropy"] == pytest.approx(-sum(p * math.log2(p) for p in shares), abs=1e-6)
    assert contexts[2]["micro_macro_competitor_ratio"] == 1 and contexts[2]["meso_pragmatic_necessity_rate"] == 0 and scales[2]["scale_consistency_score"] == 1


def test_relation_statistics_at_ties_of_the_sixth_digit(spark):
    rng = random.Random(9)
    schema = "doc_id bigint, seq bigint, e1 string, e2 string, p1 bigint, p2 bigint, relation string, confidence double"
    rows = [(d, 10 * a + b - a, f"a{a}", f"b{b}", 7 * a, 9 * b, rng.choice(("BEFORE", "AFTER")), 0.5 + rng.randrange(1000) / 2000) for d in range(300) for b in range(10, 0, -1) for a in range(max(0, b - 5), b)]
    con = duckdb.connect(config={"threads": 1})
    con.execute("CREATE TABLE documents (doc_id BIGINT); CREATE TABLE relations (doc_id BIGINT, seq BIGINT, e1 VARCHAR, e2 VARCHAR, p1 BIGINT, p2 BIGINT, relation VARCHAR, confidence DOUBLE)")
    con.executemany("INSERT INTO documents VALUES (?)", [(d,) for d in range(301)])
    con.execute("INSERT INTO relations VALUES " + ", ".join(map(str, rows)))
    shuffled = rng.sample(rows, len(rows))
    tables = {"documents": spark.createDataFrame([(d,) for d in range(301)], "doc_id bigint"), "relations": spark.createDataFrame(shuffled, schema)}
    got = sorted(tuple(r) for r in on_spark(temporal.SPARK_SQL["relation_statistics"], tables, spark).collect())
    assert got == sorted(tuple(map(float, r)) for r in con.execute(temporal.SQL["relation_statistics"][0]).fetchall())


def test_path_measures_of_graphs_of_any_size(spark):
    rng = random.Random(11)
    chain = [(1, f"w{i:03}", f"w{i + 1:03}") for i in range(249)]
    wide = sorted({(2, *(f"w{x:03}" for x in sorted(rng.sample(range(300), 2)))) for _ in range(900)})
    got = {r["doc_id"]: r for r in graphs.shapes(spark.createDataFrame(chain + wide, "doc_id bigint, src string, dst string")).collect()}
    assert (got[1]["nodes"], got[1]["longest_path"], got[1]["mean_depth"]) == (250, 249, 124.5) and got[1]["global_coherence"] == pytest.approx(249 / (250 * 249 / 2))
    out: dict = {}
    for _, a, b in wide:
        out.setdefault(a, set()).add(b)

    def below(x):
        seen, stack = set(), [x]
        while stack:
            new = out.get(stack.pop(), set()) - seen
            seen |= new
            stack += new
        return seen

    assert got[2]["nodes"] > 200 and got[2]["global_coherence"] == pytest.approx(len(wide) / sum(len(below(x)) for x in out)) and got[2]["mean_depth"] > 0


def test_mentions_are_found_without_a_shuffle_or_join_of_tokens(spark):
    texts = ["The old Alice met Bob. It was her.  She saw Paris!", "... He left. Then a Bob came.\nBob", None, "", "It. He. They", "We saw the Great Émile's 7 Dogs? their Rex", "\u00a0! Zed and Zed"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    key = ["doc_id", "tok_idx"]
    tokens = contracts.tokens(docs)
    names = ["doc_id", "sent_idx", "tok_idx", "is_pronoun", "n_tokens", "chain"]
    own = coref.mentions_of(docs)
    want = [r[:] for r in coref.mentions(tokens).select(names).sort(key).collect()]
    assert len(want) > 10 and [r[:] for r in own.select(names).sort(key).collect()] == want
    assert sorted(r[:] for r in coref.HELD["entities"](own).collect()) == sorted(r[:] for r in contracts.entities(tokens).collect()) == sorted(r[:] for r in contracts.entities_of(docs).collect())
    sizes = {r["doc_id"]: r["n"] for r in tokens.groupBy("doc_id").agg({"*": "count"}).toDF("doc_id", "n").collect()}
    assert all(sizes[r["doc_id"]] == r["n"] for r in coref.HELD["doc_sizes"](own).collect())
    plan = spark._jvm.PythonSQLUtils.explainString(coherent.CONTRACTS["entities"][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution(), "simple")
    assert "Exchange" not in plan and "Join" not in own._jdf.queryExecution().executedPlan().toString()
    seen = coherent.QUERIES["mention_scales"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in seen.replace("Generated", "") and "tok_idx" in seen


@pytest.mark.parametrize("name", ["mention_chains", "mention_scales", "singletons"])
def test_mention_queries_broadcast_nothing(spark, name):
    plan = coherent.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_features_by_row_equal_those_of_the_tables(spark):
    rng = random.Random(21)
    words = ["walked", "Going", "seized", "realize", "the", "during", "yesterday", "next", "morning", "will", "shall", "Then", "now", "unify", "creates", "ed", "Bob", "red", "later", "week", "moving", "ended", "used"]
    texts = [" ".join(rng.choice(words) + rng.choice(["", "", "", ".", "?!", ","]) for _ in range(n)) for n in (1, 2, 3, 5, 8, 13, 20, 40, 80, 150, 300)] + [None, "", "...", "We walked.", "It ended and ended, ended.", "No act in May."]
    docs = spark.createDataFrame([(3 * i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    tokens = contracts.tokens(docs)
    verbs = temporal.acts(tokens)
    want = temporal.features(docs, verbs, temporal.times(tokens), temporal.relations(verbs))
    got = temporal.features_of(docs)
    assert got.dtypes == want.dtypes
    key = lambda r: r["doc_id"]
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_relations_of_documents_of_any_length(spark):
    docs = spark.createDataFrame([(1, "a, " * 30_000 + "walked and ended.")], "doc_id bigint, text string")
    row = temporal.features_of(docs).first()
    ids = (60_000, 60_002)
    assert row["temp_num_events"] == 2 and row["temp_rel_mean_confidence"] == pytest.approx(0.5 + (ids[0] * 7919 + ids[1] * 104729) % 1000 / 2000, abs=1e-6)


def test_cycles_behind_paths_without_return():
    ahead = [(f"{a:02}", f"{b:02}") for a in range(24) for b in range(a + 1, 24)]
    assert graphs.found_cycles(sorted([*ahead, ("00", "24"), ("24", "00")])) == (1, 2, 0)
    rng = random.Random(8)
    for _ in range(200):
        edges = sorted({(f"{rng.randrange(7)}", f"{rng.randrange(7)}") for _ in range(rng.randint(1, 25))})
        out = {a: {y for x, y in edges if x == a} for a, _ in edges}
        want = {p for n in range(1, 8) for p in itertools.permutations(sorted({x for e in edges for x in e}), n) if p[0] == min(p) and all(y in out.get(x, ()) for x, y in zip(p, (*p[1:], p[0])))} if len(out) < 6 else None
        if want is not None and len(want) < 1000:
            assert graphs.found_cycles(edges) == (len(want), len({e for p in want for e in zip(p, (*p[1:], p[0]))}), 0)
