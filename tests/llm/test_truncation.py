import random

import duckdb

from glyphmill.llm import truncation as X
from glyphmill.llm import truncation_oracle

BODY = "The clerk wrote the letter before noon. She read it to the mayor in the hall. "
WHOLE = ["-- Sefa", "#music #art", "More at https://a.example/b", "* one\n* two", "Kind regards,\nAnna and Tom", "All done :)", "(Sefa, page 14)", "She read it to the mayor in the hall..."]
CUT = ["She read it to the", "She read it to the may", "She read it to the mayor in, ", "The clerk wrote the [...]", "The clerk wrote the… (more)", "The clerk wro�", "She read it to the...", "She read it, …", "The clerk wrote &quo"]


def tables(spark, rows, split=()):
    gen = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "id string, generation string, source string, core int")
    return {"generations": gen, "split_texts": spark.createDataFrame(list(split), "id string, text string, source string")}


def test_endings(spark):
    rows = [(f"f{k}", BODY * 2 + f"It was day {k}. " + BODY.strip()) for k in range(30)]
    rows += [(f"thanks{k}", BODY + f"Number {k}.\n\nThanks in advance") for k in range(4)]
    rows += [(f"w{k}", BODY + "\n\n" + t) for k, t in enumerate(WHOLE)] + [(f"c{k}", BODY + t) for k, t in enumerate(CUT)]
    rows += [("null", None), ("blank", "  "), ("none", "!?"), ("one", "word"), ("long", BODY * 5000 + "She read it to the"), ("c0", BODY + CUT[0])]
    sources = tables(spark, rows, [("x", BODY + CUT[1], None)])
    got = {(r["rec_table"], r["rec_id"]) for r in X.found(sources).collect()}
    assert got == {("generations", f"c{k}") for k in range(len(CUT))} | {("generations", "long"), ("split_texts", "x")}
    report = {(r["rec_table"], r["source"]): r for r in X.report(sources).collect()}
    assert report["split_texts", None]["cut_share"] == 1.0 and report["generations", "s"]["n_cut"] == len(CUT) + 1
    assert X.found({t: df.limit(0) for t, df in sources.items()}).count() == 0


def test_abbreviations_that_go_on(spark):
    rows = [(f"f{k}", f"The ship, approx. the old one, left port {k}. It came back in May. The crew was tired.") for k in range(8)] + [("c", "It came back in May. The ship, approx.")]
    assert [r["rec_id"] for r in X.found(tables(spark, rows)).collect()] == ["c"]


NOUNS = "harbour kitchen garden teacher bridge letter window market doctor railway mountain library island captain engine forest".split()
ADJECTIVES = "quiet broken narrow ancient yellow distant careful hollow gentle rusty".split()
VERBS = "visited repaired painted described ignored measured followed carried".split()
PLACES = ["near the river", "before the storm", "after supper", "in the valley", "on the hill", "during the winter"]
#: Closing lines that no form in the module names, each used by several writers, and one whose words also begin sentences.
CLOSERS = ["Over and out", "yours as ever", "Fin", "Typed on a train", "See you soon", "The last page", "With warm wishes from the valley", "Love and kisses"]


def sentence(rng):
    kind = rng.random()
    noun, other = rng.sample(NOUNS, 2)
    if kind < 0.4:
        return f"The {rng.choice(ADJECTIVES)} {noun} {rng.choice(VERBS)} the {other} {rng.choice(PLACES)}."
    if kind < 0.7:
        return f"It seems that every {noun} {rng.choice(VERBS)} a {rng.choice(ADJECTIVES)} {other} {rng.choice(PLACES)}."
    if kind < 0.72:
        return f"The last page of the {noun} was {rng.choice(ADJECTIVES)}."
    return f"When the {noun} {rng.choice(VERBS)} the {rng.choice(ADJECTIVES)} {other}, nobody {rng.choice(VERBS)} it."


def held_out(seed=3, n=1500):
    rng = random.Random(seed)
    rows, cut = [], set()
    for k in range(n):
        text = rng.choice([" ", "\n\n"]).join(sentence(rng) for _ in range(rng.randint(4, 9)))
        if k % 12 == 0:
            tokens = (text + " " + sentence(rng)).split(" ")
            last = len(tokens) - rng.randint(1, 4)
            text = " ".join(tokens[:last])
            if text.endswith("."):
                text = text[:-1].rsplit(" ", 1)[0]
            if rng.random() < 0.4 and len(text.rsplit(" ", 1)[1]) > 3:
                text = text[:-2]
            cut.add(f"r{k:05}")
        elif k % 12 < 4:
            text += rng.choice(["\n\n", "\n", " "]) + rng.choice(CLOSERS)
        rows.append((f"r{k:05}", text))
    return rows, cut


def test_closing_lines_of_other_forms(spark):
    rows, cut = held_out()
    got = {r["rec_id"] for r in X.found(tables(spark, rows)).collect()}
    assert len(got & cut) >= 0.98 * len(got) and len(got & cut) >= 0.95 * len(cut)


def test_other_engine_agrees(spark):
    rows, _ = held_out(seed=9, n=400)
    split = [("x", BODY + CUT[1], None), ("y", BODY + WHOLE[4], "z")]
    rows += [(f"c{k}", BODY + t) for k, t in enumerate(CUT + WHOLE)]
    sources = tables(spark, rows, split)
    con = duckdb.connect()
    for name, df in sources.items():
        con.register(name, df.toPandas())
    assert sorted(con.execute(truncation_oracle.FOUND).fetchall()) == sorted(tuple(r) for r in X.found(sources).collect())
    assert sorted(con.execute(truncation_oracle.REPORT).fetchall(), key=str) == sorted((tuple(r) for r in X.report(sources).collect()), key=str)
