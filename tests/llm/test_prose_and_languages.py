import numpy as np

from glyphmill.llm import languages as G
from glyphmill.llm import prose as P
from glyphmill.llm import reading as D

PROSE = "The old man walked to the river and looked at the water. It was cold, but he did not mind. He sat on a stone for an hour and thought of the days when he was young."
TEXTS = {
    "prose": PROSE,
    "wrapped": "The old man walked to the river and looked at the\nwater for a long while. It was cold, but he did not\nmind. He sat on a stone for an hour and thought of\nthe days when he was young.",
    "lines": PROSE.replace(". ", ".\n"),
    "list": "\n".join(f"- red ball {i}" for i in range(14)),
    "table": "a | b | c\n" + "\n".join(f"x{i} | {i * 7} | {i}.50" for i in range(14)),
    "junk": "|~$?+;@/<%@<*/+/+<;.-_~;?+?^>|^$@|._|^>$^+<?-!>_%$^_||:\n" * 5,
    "words": "table, green, walked, river, almost, stone, winter, paper, house, seven, light, under, apple, simple, carry, window, orange, bottle, silver, garden",
    "with list": PROSE + "\n- one\n- two\n" + PROSE,
}


def test_lines_are_labelled():
    model = P.LineModel()
    out = P.profile(P.units_of(list(TEXTS.values())), model)
    share = dict(zip(TEXTS, out["prose_share"]))
    assert all(share[k] >= 0.5 for k in ("prose", "wrapped", "lines", "with list")) and all(share[k] < 0.5 for k in ("list", "table", "junk", "words"))
    assert np.allclose(sum(out[f"{s}_share"] for s in P.STATES), 1.0)


def test_batched_paths_equal_single_ones():
    model = P.LineModel()
    codes, _, starts = P.observed(P.units_of([*TEXTS.values(), None, ""]))
    whole = model.label(codes, starts)
    for a, b in zip(starts[:-1], starts[1:]):
        score = sum(e[:, codes[a:b, f]].T for f, e in enumerate(model.log_e))
        if b > a:
            best, back = score[0], []
            for x in score[1:]:
                o = best[:, None] + model.log_m
                back.append(o.argmax(0))
                best = o.max(0) + x
            path = [int(best.argmax())]
            for k in reversed(back):
                path.append(int(k[path[-1]]))
            assert whole[a:b].tolist() == path[::-1]


def test_statistics_cases(spark):
    rows = [(1, PROSE, 9.0), (1, PROSE, 9.0), (2, None, 9.0), (3, " \n ", 9.0), (4, TEXTS["table"], 9.0), (5, (PROSE + "\n") * 3000, 9.0), (6, "x", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, prose_share double")
    out = {r["doc_id"]: r for r in P.statistics(df).collect()}
    assert P.statistics(df).count() == 7 and out[2]["n_words"] == 0 and out[2]["prose_share"] is None and out[3]["prose_share"] is None
    assert out[1]["punctuated_line_share"] == 1.0 and out[5]["prose_share"] > 0.9
    assert [r[0] for r in P.found(df).collect() if r[0] != 6] == [4]
    assert P.found(df.limit(0)).count() == 0


SENTENCES = {
    "en": ["The house is near the river and it was quiet.", "She would not say what they had seen there.", "We have to go home before the night."],
    "de": ["Das Haus steht am Fluss und es war ruhig.", "Sie wollte nicht sagen, was sie dort gesehen hatten.", "Wir müssen vor der Nacht nach Hause gehen."],
    "fr": ["La maison est près de la rivière et elle était calme.", "Elle ne voulait pas dire ce qu'ils avaient vu.", "Nous devons rentrer chez nous avant la nuit."],
    "es": ["La casa está cerca del río y estaba tranquila.", "Ella no quería decir lo que habían visto allí.", "Tenemos que volver a casa antes de la noche."],
    "pt": ["A casa fica perto do rio e estava calma.", "Ela não queria dizer o que eles tinham visto ali.", "Temos de voltar para casa antes da noite."],
    "nl": ["Het huis staat bij de rivier en het was rustig.", "Zij wilde niet zeggen wat zij daar hadden gezien.", "Wij moeten voor de nacht naar huis gaan."],
}


def corpus():
    rows, k = [], 0
    for code, s in SENTENCES.items():
        for i in range(12):
            k += 1
            rows.append((k, " ".join(s[(i + j) % 3] for j in range(3)), code, "x"))
    wrong = [(100, " ".join(SENTENCES["de"]), "en", "x"), (101, " ".join(SENTENCES["fr"]), None, "x"), (102, " ".join(SENTENCES["es"]), "Spanish", "x"), (103, " ".join(SENTENCES["nl"]), "und", "x")]
    mixed = [(104, " ".join(SENTENCES["en"]) + "\n" + " ".join(SENTENCES["de"]), "en", "x"), (105, None, None, "x"), (106, "", "xx", "x"), (107, TEXTS["table"], "n/a", "x"), (101, " ".join(SENTENCES["fr"]), None, "x")]
    return rows + wrong + mixed


def test_labels_and_mixtures(spark):
    df = spark.createDataFrame(corpus(), "doc_id bigint, text string, lang string, label string")
    got = sorted(tuple(r) for r in G.found(df).collect())
    assert got == [(100, "de"), (101, "fr"), (103, "nl"), (104, "de"), (104, "en")]
    runs = G.segments(df).filter("doc_id = 104").orderBy("segment").collect()
    assert [r["lang"] for r in runs] == ["en", "de"] and all(0.3 < r["confidence"] <= 1 for r in runs)
    assert G.found(df.limit(0)).count() == 0


def test_held_out_accuracy(spark):
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", G.label_code(__import__("pyspark").sql.functions.col("lang")).alias("code")).collect() if r["text"] and r["code"] in G.LANGUAGES]
    units = P.units_of([r["text"] for r in rows])
    prose = P.profile(units, P.LineModel())["prose_share"] >= 0.5
    train, test = [i for i in range(len(rows)) if i % 2 and prose[i]], [i for i in range(len(rows)) if not i % 2 and prose[i]]
    model = G.train([u for i in train for u in units[i]], [G.LANGUAGES.index(rows[i]["code"]) for i in train for _ in units[i]])
    guess = [G.shares(*(lambda x: (x[0], x[2], x[3]))(G.segment_batch([units[i]], model)))[0].argmax() for i in test]
    right = np.mean([G.LANGUAGES[g] == rows[i]["code"] for g, i in zip(guess, test)])
    assert right > 0.9  # about one label in twenty is wrong


def test_reading_levels(spark):
    gen, feats, docs = [], [], []
    easy, hard, both = ["cat", "dog", "sun", "run", "big"], ["epistemology", "multiplicity", "stratification", "heterogeneous", "regularization"], ["the", "of"]
    for i in range(60):
        gen.append((f"g{i}", " ".join((easy if i % 2 else hard)[(i + j) % 5] + " " + both[j % 2] for j in range(60)), "x"))
        feats.append((f"g{i}", 100.0 - i % 5 if i % 2 else float(i % 5), 0))
    feats += [("g1", 99.0, 0), ("g2", float("nan"), 0), ("g3", None, 0), ("none", 50.0, 0), ("g5", -9e9, 0)]
    docs = [(1, ("The cat and the dog run to the big sun. " * 15), "en"), (2, "The epistemology of the multiplicity is the stratification of the heterogeneous regularization. " * 12, "en"), (3, None, "en"), (4, "zzz", "en"), (1, ("The cat and the dog run to the big sun. " * 15), "en")]
    docs += [(50 + k, t, lang) for k, (lang, t) in enumerate((c, " ".join(s)) for c, s in SENTENCES.items() for _ in range(6))]
    g, f, d = spark.createDataFrame(gen, "id string, generation string, ease string"), spark.createDataFrame(feats, "id string, flesch_reading_ease double, grade int"), spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    assert {r["word"]: r["acquired"] for r in D.word_grades(D.graded_texts(g, f)).collect()}["cat"] < 5
    levels = {r["doc_id"]: r["reading_ease"] for r in D.levels(d, g, f).collect()}
    assert levels[1] > 75 and levels[2] < 35 and levels[3] is None and levels[4] is None
    assert sorted(tuple(r) for r in D.found(d, g, f).collect()) == [(1, "easy"), (2, "hard")]
    assert D.found(d.limit(0), g, f).count() == 0 and D.found(d, g.limit(0), f).count() == 0


def test_line_model_counts_all_documents(spark):
    texts = [f"{t}\n{i} x" for i in range(900) for t in TEXTS.values()] + [None, " "]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    codes, _, starts = P.observed(P.units_of(texts))
    want = P.LineModel()
    for _ in range(2):
        want = P.LineModel.estimated(want.counts(codes, starts))
    for got in (P.fit(df.repartition(5)), G.fit(df, 20)[0]):
        assert np.allclose(got.moves, want.moves) and all(np.allclose(a, b) for a, b in zip(got.emissions, want.emissions))


def test_repeated_text_does_not_fill_the_sample(spark):
    rows = [(SENTENCES["en"][0], "en")] * 31 + [(t, code) for code, s in SENTENCES.items() if code != "en" for t in s]
    drawn = G.sample(spark.createDataFrame(rows, "text string, lang string"), 30)
    assert drawn.count((SENTENCES["en"][0], "en")) == 30 and len(drawn) == 45


def test_foreign_sentence_on_a_short_line(spark):
    both = SENTENCES["en"][0] + " " + SENTENCES["de"][0]
    assert len(both) <= P.LONG
    df = spark.createDataFrame([*corpus(), (200, both, "en", "x"), (201, both + "\n" + SENTENCES["en"][1] + " " + SENTENCES["de"][1], "en", "x")], "doc_id bigint, text string, lang string, label string")
    runs = [(r["doc_id"], r["lang"]) for r in G.segments(df).filter("doc_id >= 200").orderBy("doc_id", "segment").collect()]
    assert runs == [(200, "en"), (200, "de"), (201, "en"), (201, "de"), (201, "en"), (201, "de")]
    assert {tuple(r) for r in G.found(df).filter("doc_id >= 200").collect()} == {(d, c) for d in (200, 201) for c in ("en", "de")}


def test_a_sample_of_any_corpus_draws_rows(spark):
    from pyspark.sql import functions as F

    from glyphmill.llm import reading
    from glyphmill.session import hash_below

    share = reading.sample_share(10**11, 3000)
    assert 0 < share * 1e11 <= 3001
    ids = spark.range(2_000_000).select(F.col("id").cast("string").alias("id"))
    for part in (0.5, 1e-3, 1e-5):
        n = ids.filter(hash_below(F.col("id"), part)).count()
        assert abs(n - part * 2e6) < 6 * (part * 2e6) ** 0.5 + 1
    assert ids.filter(hash_below(F.col("id"), 1.0)).count() == 2_000_000
