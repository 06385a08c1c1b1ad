"""Reading level of documents, learned from texts that were graded on the reading-ease scale.

A word's acquisition grade is the reading ease at which readers of ever harder texts have met a quarter
of its uses: the ACQUIRED quantile of its distribution over the graded texts, from the easy end, each
grade weighted to count the same however many texts it has. A document's known words give a
distribution of grades; its quantiles and mean are mapped to the scale by a linear calibration.

Counts of words by grade cover all graded texts and are added up in the tasks before the shuffle. Words
in fewer than MIN_SHARE of the graded texts have no grade; the number of graded words is thus at
most the mean number of distinct words of a text divided by MIN_SHARE, which bounds what is sent to
the tasks. The calibration is fitted on a bounded sample (``fit_texts``), once on all and once without gross
outliers, as a few given values are wrong.

Cases: texts without a finite value in -200..125 grade nothing; texts computed twice count with their mean;
null, blank and wordless documents have a null level; documents without any known word too; repeated
rows get a row each in ``levels`` and one in ``found``; without graded texts every level is null.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.batches import fold_partitions, map_batches
from glyphmill.llm import languages, prose
from glyphmill.llm.words import words
from glyphmill.session import hash_below

EASIEST, HARDEST, WIDTH = 120.0, -80.0, 8.0
GRADES = int((EASIEST - HARDEST) / WIDTH)
ACQUIRED = 0.25
MIN_SHARE = 2e-4
MIN_TEXTS = 3
FIT_TEXTS = 3000
MIN_WORDS = 100
EASY, HARD = 75.0, 35.0
#: Words a partial table may hold before it is given on.
TABLE_WORDS = 200_000
STEPS = 100
_QUANTILES = np.array([0.1, 0.25, 0.4, 0.5, 0.6, 0.75, 0.9])


def graded_texts(generations: DataFrame, features: DataFrame) -> DataFrame:
    """id, text and ease of every generation with a usable value; deliveries of one id count once."""
    value = F.col("flesch_reading_ease")
    usable = features.filter(value.isNotNull() & ~F.isnan(value) & value.between(-200.0, 125.0)).groupBy("id").agg(F.avg(value).alias("ease"))
    texts = generations.select("id", F.col("generation").alias("text")).filter("text is not null")
    return texts.join(usable, "id").dropDuplicates(["id"])


def grade_number(ease: np.ndarray) -> np.ndarray:
    """Grade of a reading ease: 0 is the easiest."""
    return np.clip((EASIEST - np.asarray(ease, float)) / WIDTH, 0, GRADES - 1).astype(int)


def _step(state: dict, columns: dict[str, list]) -> dict:
    for text, grade in zip(columns["text"], grade_number(columns["ease"]).tolist()):
        for w in set(words(text)):
            key = (w, grade)
            state[key] = state.get(key, 0) + 1
    return state


def _flush(state: dict) -> dict[str, object]:
    return {"word": [k[0] for k in state], "grade": [k[1] for k in state], "n": list(state.values())}


def word_grades(graded: DataFrame) -> DataFrame:
    """word, texts, grade (0 easiest) of all words that enough graded texts hold."""
    counts = fold_partitions(graded.select("text", "ease"), dict, _step, _flush, "word string, grade int, n bigint", lambda s: len(s) > TABLE_WORDS)
    counts = counts.groupBy("word", "grade").agg(F.sum("n").alias("n"))
    grades = graded.select(F.least(F.greatest(((EASIEST - F.col("ease")) / WIDTH).cast("int"), F.lit(0)), F.lit(GRADES - 1)).alias("grade")).groupBy("grade").agg(F.count("*").alias("size"))
    total = grades.agg(F.sum("size").alias("total"))
    # a grade with hardly any texts must not weigh like the others
    weighted = counts.join(F.broadcast(grades), "grade").withColumn("w", F.col("n") / (F.col("size") + 5.0))
    by_word = weighted.groupBy("word").agg(F.sum("n").alias("n_texts"), F.sum("w").alias("mass"), F.sort_array(F.collect_list(F.struct("grade", "w"))).alias("spread"))
    enough = by_word.crossJoin(F.broadcast(total)).filter(F.col("n_texts") >= F.greatest(F.lit(MIN_TEXTS), MIN_SHARE * F.col("total")))
    # interpolate in the grade where the accumulated weight passes the quantile
    fold = F.aggregate(
        "spread",
        F.struct(F.lit(0.0).alias("below"), F.lit(-1.0).alias("at")),
        lambda acc, x: F.struct(
            (acc["below"] + x["w"]).alias("below"),
            F.when((acc["at"] < 0) & (acc["below"] + x["w"] >= F.col("mass") * ACQUIRED), x["grade"] + (F.col("mass") * ACQUIRED - acc["below"]) / x["w"]).otherwise(acc["at"]).alias("at"),
        ),
    )
    return enough.select("word", "n_texts", fold["at"].alias("acquired"))


class ReadingModel:
    """Grades of words, and the calibration from a document's grades to the scale."""

    def __init__(self, grades: dict[str, int], coefficients: np.ndarray | None = None):
        self.grades, self.coefficients = grades, coefficients

    def features(self, token_lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Quantiles and mean of the known words' grades of each document, and how many are known."""
        get = self.grades.get
        known = [[g for g in map(get, tokens) if g is not None] for tokens in token_lists]
        n = np.array([len(k) for k in known], np.int64)
        flat = np.fromiter((g for k in known for g in k), np.int64, int(n.sum()))
        owner = np.repeat(np.arange(len(known)), n)
        table = np.bincount(owner * STEPS + flat, minlength=len(known) * STEPS).reshape(-1, STEPS)
        cum = table.cumsum(1)
        whole = np.maximum(n, 1)[:, None]
        out = [np.minimum((cum < np.ceil(q * whole)).sum(1), STEPS - 1) for q in _QUANTILES]
        mean = (table * np.arange(STEPS)).sum(1) / whole[:, 0]
        return np.column_stack([*out, mean, mean * mean / STEPS, np.ones(len(known))]).astype(float), n

    def calibrate(self, token_lists: list[list[str]], ease: np.ndarray) -> ReadingModel:
        x, n = self.features(token_lists)
        keep = n > 0
        beta = None
        for _ in range(3):
            if keep.sum() < 2:
                break
            a = x[keep]
            beta = np.linalg.solve(a.T @ a + np.eye(a.shape[1]) * 1e-3 * len(a), a.T @ ease[keep])
            off = np.abs(x @ beta - ease)
            keep = (n > 0) & (off <= 4 * np.median(off[n > 0]) + 1e-9)
        self.coefficients = beta
        return self

    def levels(self, token_lists: list[list[str]]) -> np.ndarray:
        """Estimated reading ease of each document; NaN where nothing is known."""
        x, n = self.features(token_lists)
        if self.coefficients is None:
            return np.full(len(n), np.nan)
        return np.where(n > 0, x @ self.coefficients, np.nan)


def sample_share(total: int, wanted: int) -> float:
    """Share of the hashes that draws about ``wanted`` of ``total`` rows."""
    return min(1.0, wanted / max(1, total))


def fit(generations: DataFrame, features: DataFrame, fit_texts: int = FIT_TEXTS) -> ReadingModel:
    """Word grades from all graded texts, calibrated on a bounded, hash-drawn sample of them."""
    graded = graded_texts(generations, features)
    grades = {r["word"]: min(STEPS - 1, int(r["acquired"] * STEPS / GRADES)) for r in word_grades(graded).toLocalIterator()}
    model = ReadingModel(grades)
    value = F.col("flesch_reading_ease")
    part = sample_share(features.filter(value.isNotNull()).count(), fit_texts)
    drawn = graded_texts(*(t.filter(hash_below(F.col("id"), part)) for t in (generations, features)))
    # twice the expected number at most, in the order of the same hash
    rows = drawn.select("id", "text", "ease").orderBy(F.xxhash64("id"), "id").limit(2 * fit_texts).collect()
    if grades and not rows:
        raise ValueError("there are graded texts, but none was drawn for the calibration")
    rows.sort(key=lambda r: r["id"])
    tokens = [words(r["text"]) for r in rows]
    return model.calibrate(tokens, np.array([r["ease"] for r in rows], float))


LEVELS = "doc_id bigint, n_words int, reading_ease double, prose_share double, english_share double, second_share double"


def levels(documents: DataFrame, generations: DataFrame, features: DataFrame) -> DataFrame:
    """Reading ease of each document, with what decides whether it is English prose."""
    lines, speech = languages.fit(documents)
    reader = fit(generations, features)
    english = languages.LANGUAGES.index("en")

    def batch(columns: dict[str, list]) -> dict[str, object]:
        units = prose.units_of(columns["text"])
        language, _, n_words, starts = languages.segment_batch(prose.sentences_of(units), speech)
        part = languages.shares(language, n_words, starts)
        tokens = [words(t) for t in columns["text"]]
        return {
            "doc_id": columns["doc_id"],
            "n_words": [len(t) for t in tokens],
            "reading_ease": reader.levels(tokens),
            "prose_share": prose.profile(units, lines)["prose_share"],
            "english_share": part[:, english],
            "second_share": np.sort(part, 1)[:, -2],
        }

    return map_batches(documents.select("doc_id", "text"), batch, LEVELS)


def found(documents: DataFrame, generations: DataFrame, features: DataFrame) -> DataFrame:
    """English prose at both ends of the scale."""
    own = (F.col("prose_share") >= prose.PROSE_SHARE) & (F.col("english_share") > 0.5) & (F.col("second_share") < languages.SHARE) & (F.col("n_words") >= MIN_WORDS)
    band = F.when(F.col("reading_ease") > EASY, "easy").when(F.col("reading_ease") < HARD, "hard")
    return levels(documents, generations, features).filter(own).select("doc_id", band.alias("reading_band")).filter("reading_band is not null").distinct()


def profile(documents: DataFrame, generations: DataFrame, features: DataFrame) -> DataFrame:
    """How many documents lie in each ten points of the scale, by whether they are English prose."""
    own = (F.col("prose_share") >= prose.PROSE_SHARE) & (F.col("english_share") > 0.5) & (F.col("second_share") < languages.SHARE)
    level = F.floor(F.col("reading_ease") / 10) * 10
    return levels(documents, generations, features).groupBy(F.coalesce(own, F.lit(False)).alias("english_prose"), level.cast("int").alias("ease_from")).agg(F.count("*").alias("n_documents"), F.sum("n_words").alias("n_words"))
