import random

from glyphmill.llm import repetition as R
from glyphmill.llm.words import words


def brute(tokens, k=4):
    covered = set()
    for i in range(len(tokens) - k + 1):
        if any(tokens[j : j + k] == tokens[i : i + k] for j in range(i)):
            covered |= set(range(i, i + k))
    return len(covered)


def test_repeated_words_equal_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        t = [rng.choice("abcd") for _ in range(rng.randint(0, 40))]
        assert R.repeated_words(t) == brute(t)


def test_words_ignore_spelling_of_no_account():
    assert words("<p>Th​e  Сat &amp; DOG’s [link](http://x)</p>") == ["the", "cat", "dog", "s", "link"]
    assert words(None) == [] and words(" \n") == [] and words("!!") == []


def test_ledger_cases(spark):
    loop = "one two three four five six. " * 20
    rows = [("d", "1", loop, 1, 0), ("d", "1", loop, 1, 0), ("d", "2", "all words here differ from each other", 2, 0), ("d", "3", None, 3, 0), ("d", "4", "  ", 4, 0), ("g", "1", "word " * 300_000, 5, 0), ("g", None, "a b", 6, 0)]
    df = spark.createDataFrame(rows, "rec_table string, rec_id string, text string, n_words int, failed int")
    ledger = R.ledger(df)
    got = {(r["rec_table"], r["rec_id"]): r for r in ledger.collect()}
    assert ledger.count() == 7 and got["d", "1"]["repeated_stretch_share"] == 114 / 120 and got["d", "2"]["failed"] == 0 and got["d", "3"]["n_words"] == 0 and got["d", "4"]["failed"] == 0
    assert sorted((r["rec_table"], r["rec_id"]) for r in R.flagged(ledger, R.POLICIES[0]).collect()) == [("d", "1"), ("g", "1")]
    any_policy = R.POLICIES[2]
    report = {(r["rec_table"], r["policy"]): r for r in R.policy_report(ledger).collect()}
    assert report["d", "stretches"]["n_dropped"] == 2 and report["d", "any"]["n_texts"] == 5
    alone = {(r["rec_table"], r["rule"]): r["n_only_by_it"] for r in R.ablation(ledger, any_policy).collect()}
    assert alone["d", "repeated_stretch_share"] == 0
    assert R.ledger(df.limit(0)).count() == 0 and R.policy_report(R.ledger(df.limit(0))).count() == 0


def test_rules_hold_their_bits():
    assert R.mask_of(("repeated_stretch_share", "repeated_line_share")) == 5
    n, *m = R.measure("- a\n- a\n- a\n- a\n\nlast words")
    assert n == 6 and m[2] > 0.3
