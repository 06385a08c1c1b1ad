import random

from glyphmill.llm import leakage as L


def exists(p, x):
    """Whether some 20 to 40 words of p stand in x with at most one in ten changed."""
    for size in range(20, min(41, len(p) + 1)):
        for s in range(len(p) - size + 1):
            prev = [0] * (len(x) + 1)
            for a in p[s : s + size]:
                cur = [prev[0] + 1]
                for j, b in enumerate(x):
                    cur.append(min(prev[j] + (a != b), prev[j + 1] + 1, cur[j] + 1))
                prev = cur
            if min(prev) * 10 <= size:
                return True
    return False


def test_search_equals_brute_force():
    rng = random.Random(6)
    vocabulary = [f"v{i}" for i in range(40)]
    items = {i: [rng.choice(vocabulary) for _ in range(rng.randint(20, 45))] for i in range(6)}
    search = L._searcher(L.Patterns(items))
    for _ in range(60):
        item = rng.randrange(6)
        p = items[item]
        begin = rng.randint(0, len(p) - 15)
        part = p[begin : begin + rng.randint(15, 30)]
        for _ in range(rng.choice([0, 1, 2, 3, 4])):
            k = rng.randrange(len(part))
            part = part[:k] + [[], ["odd"], ["odd", part[k]]][rng.randrange(3)] + part[k + 1 :]
        text = [rng.choice(vocabulary) for _ in range(8)] + part + [rng.choice(vocabulary) for _ in range(8)]
        out = search({"doc_id": [1], "text": [" ".join(text)]})
        assert set(out["item_id"]) == {i for i in items if exists(items[i], text)}


def test_cases(spark, monkeypatch):
    passage = " ".join(f"word{i}" for i in range(30))
    shared = "Read the passage below and answer with one of the options that follow it, then give a reason for your choice in one or two sentences."
    other = lambda k: " ".join(f"o{k}x{i}" for i in range(25))
    items = spark.createDataFrame([(1, f"{shared}\n{passage}\nWhy does it say so?", "x"), (1, f"{shared}\n{passage}\nWhy does it say so?", "x"), (2, f"{shared}\n{other(2)}", "x"), (3, f"{shared}\n{other(3)}", None), (4, None, "x"), (5, "short", "x")], "item_id bigint, text string, stretch string")
    docs = spark.createDataFrame([(1, "Intro. " + passage.upper().replace(" ", " \n")), (2, shared), (3, None), (4, ""), (5, other(2) + " x " + passage), (1, passage), (6, "filler " * 200_000 + other(3))], "doc_id bigint, text string")
    want = [(1, 1), (5, 1), (5, 2), (6, 3)]
    assert sorted(tuple(r) for r in L.found(docs, items).collect()) == want
    monkeypatch.setattr(L, "BLOCK_WORDS", 20)  # every item in a block of its own
    assert sorted(tuple(r) for r in L.found(docs, items).collect()) == want
    assert L.found(docs.limit(0), items).count() == 0 and L.found(docs, items.limit(0)).count() == 0
    assert {r["item_id"]: r["n_documents"] for r in L.report(docs, items).collect()} == {1: 2, 2: 1, 3: 1}


def test_passages_that_are_shared_or_end_in_a_question(spark):
    passage = [" ".join(f"{c}{i}" for i in range(30)) for c in "abcd"]
    instruction = "Answer the question using only the text below."
    items = [(1, f"{instruction}\n{passage[0]}?"), (2, f"{instruction}\n{passage[1]}\nWhat is b3?"), (3, f"{instruction}\n{passage[1]}\nWhat is b4?"), (4, f"{passage[1]}\nWhat is b5?"), (5, passage[2] + "?"), (6, f"{instruction}\n{passage[3]}\nIs it so?")]
    docs = [(k, "before it. " + p + " and after it") for k, p in enumerate(passage)] + [(9, instruction * 5 + " Is it so? What is b3?")]
    got = {(r["doc_id"], r["item_id"]) for r in L.found(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == {(0, 1), (1, 2), (1, 3), (1, 4), (2, 5), (3, 6)}


def test_markup_of_any_length():
    from glyphmill.llm.words import words

    tag, comment = '<a title="' + "x y " * 500 + '">', "<!-- " + "no word " * 1000 + "-->"
    assert words(f"one {tag}two</a> {comment} three <!-- open") == ["one", "two", "three", "open"]
