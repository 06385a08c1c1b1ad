"""Languages of documents and of their segments, against labels that may be missing or wrong.

A multinomial logistic regression on TF-IDF weighted character pairs and triples, trained by
follow-the-regularised-leader (proximal, one learning rate a coordinate) with elastic-net
penalties, which leaves a sparse model; a temperature fitted on held-out segments turns its scores
into confidences. It is trained on a bounded, hash-drawn sample of documents that carry a usable
label (``fit_documents`` for each language), once on all of its segments and once more without those
that the first model holds for mislabelled. Every document is then scored in whole, segment
by segment. Lines of any length are cut at their sentence ends here; the line model keeps whole short lines.

Letters are mapped to an alphabet of 64 signs, so every pair and triple has its own weight and the
model's size is fixed.

Cases: null, blank and wordless texts have no segment and are never found; a label is usable if it is a
code, a region variant, a three-letter code or a name of one of LANGUAGES, in any case; other labels
count as missing if they are known placeholders, else as wrong; repeated rows are found once; ties between
languages go to the first in LANGUAGES; very short segments lean on their neighbours.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.batches import map_batches
from glyphmill.llm import prose
from glyphmill.session import hash_below

LANGUAGES = ("en", "de", "fr", "es", "pt", "nl")
#: Documents drawn for each language to fit the model on.
FIT_DOCUMENTS = 150
#: A language counts in a document from this share of the words on.
SHARE = 0.2
# Three-letter codes and names of the languages.
ALIASES = {
    "en": ("eng", "english", "englisch", "anglais", "ingles", "inglés"),
    "de": ("deu", "ger", "german", "deutsch", "allemand", "aleman", "alemán"),
    "fr": ("fra", "fre", "french", "francais", "français", "französisch"),
    "es": ("spa", "spanish", "espanol", "español", "castellano", "spanisch"),
    "pt": ("por", "portuguese", "portugues", "português", "portugiesisch"),
    "nl": ("nld", "dut", "dutch", "nederlands", "niederländisch"),
}
# Labels that say nothing.
PLACEHOLDERS = ("", "und", "xx", "unk", "unknown", "n/a", "na", "none", "null", "nan", "mul", "mis", "zxx", "other", "-", "?")

SIGNS = 64
_ACCENTED = "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ"
_PAIR_BASE = SIGNS**3
SIZE = SIGNS**3 + SIGNS**2
CHUNK = 1 << 18
ALPHA, BETA, L1, L2 = 0.6, 1.0, 0.25, 0.5


def _alphabet() -> np.ndarray:
    """Sign of each character up to U+FFFF: 0 none, 1 digit, 2 other letter, then the Latin letters."""
    table = np.zeros(0x10000, np.int32)
    for c in range(0x10000):
        if not 0xD800 <= c < 0xE000:
            x = chr(c)
            if x.isalnum():
                table[c] = 1 if x.isdigit() else 2
    for i, x in enumerate("abcdefghijklmnopqrstuvwxyz" + _ACCENTED):
        table[ord(x)] = 3 + i
    return table


_TABLE = None


def triples(units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the sign triples around each letter of a batch, their units (ascending), and the words of each unit.

    A triple's first two signs are the pair that is counted with it.
    """
    global _TABLE
    if _TABLE is None:
        _TABLE = _alphabet()
    text = "\n".join(units).lower() if units else ""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(len(units), np.int64)
    unit = np.cumsum(points == 10, dtype=np.int32)
    if unit[-1] != len(units) - 1:  # a unit held a line break itself
        return triples([u.replace("\n", " ") for u in units])
    signs = _TABLE[np.minimum(points, 0xFFFF)]
    letter = signs > 0
    before = np.concatenate([[False], letter[:-1]])
    n_words = np.bincount(unit[letter & ~before], minlength=len(units))
    padded = np.concatenate([np.zeros(1, np.int32), signs, np.zeros(1, np.int32)])
    numbers = (padded[:-2] * (SIGNS * SIGNS) + padded[1:-1] * SIGNS + padded[2:])[letter]
    return numbers, unit[letter], n_words


def chunks(units: list[str]) -> list[slice]:
    """Runs of units of about CHUNK characters, so that the arrays stay small."""
    out, begin, size = [], 0, 0
    for i, u in enumerate(units):
        size += len(u)
        if size >= CHUNK:
            out.append(slice(begin, i + 1))
            begin, size = i + 1, 0
    if begin < len(units):
        out.append(slice(begin, len(units)))
    return out


class LanguageModel:
    """Sparse weights by gram and language, idf, and the temperature."""

    def __init__(self, weights: np.ndarray, idf: np.ndarray, temperature: float):
        used = np.flatnonzero(np.abs(weights).sum(1))
        self.used, self.values = used.astype(np.int32), weights[used].astype(np.float32)
        seen = np.flatnonzero(idf)
        self.seen, self.idf_values = seen.astype(np.int32), idf[seen].astype(np.float32)
        self.temperature = temperature
        self._dense = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_dense"} | {"_dense": None}

    def dense(self) -> np.ndarray:
        """A row for each triple: the weights times idf of it and its pair, then the sum of both squared idf."""
        if self._dense is None:
            idf = np.zeros(SIZE, np.float32)
            idf[self.seen] = self.idf_values
            grams = np.zeros((SIZE, len(LANGUAGES) + 2), np.float32)
            grams[self.used, : len(LANGUAGES)] = self.values * idf[self.used][:, None]
            grams[:, len(LANGUAGES)] = idf * idf
            self._dense = grams[:_PAIR_BASE] + np.repeat(grams[_PAIR_BASE:], SIGNS, axis=0)
        return self._dense

    def scores(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of each unit and language (before the temperature), and the units' words."""
        table = self.dense()
        sums = np.zeros((len(units), table.shape[1]), np.float32)
        n_words = np.zeros(len(units), np.int64)
        for part in chunks(units):
            numbers, owner, n_words[part] = triples(units[part])
            if len(numbers):
                first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                sums[part.start + owner[first]] = np.add.reduceat(table[numbers], first, axis=0)
        norm = np.sqrt(sums[:, len(LANGUAGES)])
        norm[norm == 0] = 1.0
        return sums[:, : len(LANGUAGES)].astype(float) / norm[:, None], n_words

    def confidence(self, scores: np.ndarray) -> np.ndarray:
        x = scores / self.temperature
        x = np.exp(x - x.max(1, keepdims=True))
        return x / x.sum(1, keepdims=True)


def _idf(numbers: np.ndarray, owner: np.ndarray, n_units: int) -> np.ndarray:
    once = np.unique(owner.astype(np.int64) * SIZE + numbers) % SIZE
    df = np.bincount(once, minlength=SIZE)
    return np.where(df > 1, np.log((1 + n_units) / (1 + df)) + 1, 0.0)


def _follow(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int, rounds: int = 2) -> np.ndarray:
    """FTRL-proximal with elastic net over sparse rows; the weights at the end."""
    k = len(LANGUAGES)
    z, n = np.zeros((SIZE, k)), np.zeros((SIZE, k))

    def weights(idx: np.ndarray) -> np.ndarray:
        zi = z[idx]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[idx])) / ALPHA + L2))

    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            idx, x = rows[i]
            w = weights(idx)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[labels[i]] -= 1.0
            g = x[:, None] * p[None]
            sigma = (np.sqrt(n[idx] + g * g) - np.sqrt(n[idx])) / ALPHA
            z[idx] += g - sigma * w
            n[idx] += g * g
    return weights(np.arange(SIZE))


def train(units: list[str], labels: list[int], seed: int = 17) -> LanguageModel:
    """The model of labelled segments: fitted, cleaned of mislabelled segments, fitted again, calibrated."""
    y = np.array(labels, np.int64)
    if not len(units):
        return LanguageModel(np.zeros((SIZE, len(LANGUAGES))), np.zeros(SIZE), 1.0)
    numbers, owner, _ = triples(units)
    numbers, owner = np.concatenate([numbers, _PAIR_BASE + numbers // SIGNS]), np.concatenate([owner, owner])
    idf = _idf(numbers, owner, len(units))
    order = np.argsort(owner, kind="stable")
    numbers, owner = numbers[order], owner[order]
    cuts = np.searchsorted(owner, np.arange(len(units) + 1))
    rows = []
    for i in range(len(units)):
        idx, count = np.unique(numbers[cuts[i] : cuts[i + 1]], return_counts=True)
        live = idf[idx] > 0
        idx, count = idx[live], count[live]
        norm = np.sqrt((count * idf[idx] ** 2).sum()) or 1.0
        rows.append((idx, count * idf[idx] / norm))
    held = np.arange(len(units)) % 5 == 4
    keep = ~held
    for last in (False, True):
        picked = np.flatnonzero(keep)
        model = LanguageModel(_follow([rows[i] for i in picked], y[picked], seed), idf, 1.0)
        scores, n_words = model.scores(units)
        guess = scores.argmax(1)
        sure = np.sort(scores, 1)
        wrong = (guess != y) & (sure[:, -1] - sure[:, -2] > 1.0)
        if not last:
            keep &= ~wrong
    test = held & ~wrong if (held & ~wrong).any() else ~wrong
    grid = np.exp(np.linspace(np.log(0.1), np.log(5), 60))
    losses = []
    for t in grid:
        x = scores[test] / t
        x = x - x.max(1, keepdims=True)
        losses.append(-(x[np.arange(len(x)), y[test]] - np.log(np.exp(x).sum(1))).mean())
    model.temperature = float(grid[int(np.argmin(losses))])
    return model


def label_code(column: Column) -> Column:
    """The language a label means, '' for a placeholder or null, 'other' for anything else."""
    low = F.lower(F.trim(F.coalesce(column, F.lit(""))))
    stem = F.regexp_replace(low, "[-_].*$", "")
    out = F.when(low.isin(*PLACEHOLDERS), F.lit(""))
    for code, names in ALIASES.items():
        out = out.when(stem.isin(code, *names), F.lit(code))
    return out.otherwise(F.lit("other"))


def sample(documents: DataFrame, per_language: int = FIT_DOCUMENTS) -> list[tuple[str, str]]:
    """(text, language) of a bounded, hash-drawn sample of labelled documents, about as many for each language; no text more than ``per_language`` times."""
    labelled = documents.select("text", label_code(F.col("lang")).alias("code")).filter(F.col("code").isin(*LANGUAGES) & F.col("text").isNotNull())
    counts = {r["code"]: r["n"] for r in documents.select(label_code(F.col("lang")).alias("code")).groupBy("code").agg(F.count("*").alias("n")).collect()}
    chance = F.lit(0.0)
    for code in LANGUAGES:
        if counts.get(code):
            chance = F.when(F.col("code") == code, F.lit(min(1.0, per_language / counts[code]))).otherwise(chance)
    drawn = labelled.filter(hash_below(F.concat(F.lit("language "), F.col("text")), chance))
    copies = drawn.groupBy("text", "code").agg(F.least(F.count("*"), F.lit(per_language)).alias("n"))
    rows = [x for r in copies.collect() for x in [(r["text"], r["code"])] * r["n"]]
    if not rows and not labelled.isEmpty():
        raise ValueError("there are labelled documents, but none was drawn to fit the model on")
    return rows


def fit(documents: DataFrame, per_language: int = FIT_DOCUMENTS) -> tuple[prose.LineModel, LanguageModel]:
    """The line model, fitted on all documents as for p5, and the language model, fitted on the drawn sample."""
    lines = prose.fit(documents)
    drawn = sorted(sample(documents, per_language))
    units, labels = [], []
    split = prose.units_of([t for t, _ in drawn])
    if drawn:
        share = prose.profile(split, lines)["prose_share"]
        for u, (_, code), s in zip(prose.sentences_of(split), drawn, share):
            if s >= prose.PROSE_SHARE:
                units += u
                labels += [LANGUAGES.index(code)] * len(u)
    return lines, train(units, labels)


def segment_batch(units: list[list[str]], model: LanguageModel) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For a batch: language, confidence and words of every unit, and the starts of the documents."""
    flat = [u for document in units for u in document]
    starts = np.concatenate([[0], np.cumsum([len(u) for u in units], dtype=np.int64)]).astype(np.int64)
    if not flat:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), starts
    scores, n_words = model.scores(flat)
    sure = model.confidence(scores)
    weak = (sure.max(1) < 0.9) | (n_words < 4)
    if weak.any():
        document = np.repeat(np.arange(len(units)), np.diff(starts))
        mass = scores * np.minimum(n_words, 12)[:, None]
        around = mass.copy()
        same = document[1:] == document[:-1]
        around[1:][same] += 0.5 * mass[:-1][same]
        around[:-1][same] += 0.5 * mass[1:][same]
        scores = np.where(weak[:, None], around / np.maximum(1, np.minimum(n_words, 12))[:, None], scores)
        sure = model.confidence(scores)
    return scores.argmax(1), sure.max(1), n_words, starts


def shares(language: np.ndarray, n_words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Share of each document's words in each language; NaN for wordless documents."""
    document = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    table = np.zeros((len(starts) - 1, len(LANGUAGES)))
    np.add.at(table, (document, language), n_words)
    with np.errstate(invalid="ignore"):
        return table / table.sum(1, keepdims=True)


def segments(documents: DataFrame, per_language: int = FIT_DOCUMENTS) -> DataFrame:
    """Runs of one language in each document: place, language, words and mean confidence."""
    _, model = fit(documents, per_language)

    def batch(columns: dict[str, list]) -> dict[str, object]:
        language, sure, n_words, starts = segment_batch(prose.sentences_of(prose.units_of(columns["text"])), model)
        out: dict[str, list] = {k: [] for k in ("doc_id", "segment", "lang", "n_words", "confidence")}
        for d, (doc, a, b) in enumerate(zip(columns["doc_id"], starts[:-1], starts[1:])):
            i, no = a, 0
            while i < b:
                j = i
                while j < b and language[j] == language[i]:
                    j += 1
                w = n_words[i:j]
                for k, v in zip(out, (doc, no, LANGUAGES[language[i]], int(w.sum()), float(np.average(sure[i:j], weights=w)) if w.sum() else float(sure[i:j].mean()))):
                    out[k].append(v)
                i, no = j, no + 1
        return out

    return map_batches(documents.select("doc_id", "text"), batch, "doc_id bigint, segment int, lang string, n_words int, confidence double")


def document_languages(documents: DataFrame, per_language: int = FIT_DOCUMENTS) -> DataFrame:
    """doc_id, label, prose_share, each language with at least SHARE of the words (share, confidence), most words first."""
    lines, model = fit(documents, per_language)
    kept = documents.select("doc_id", "text", label_code(F.col("lang")).alias("label"))

    def batch(columns: dict[str, list]) -> dict[str, object]:
        units = prose.units_of(columns["text"])
        language, sure, n_words, starts = segment_batch(prose.sentences_of(units), model)
        part = shares(language, n_words, starts)
        natural = prose.profile(units, lines)["prose_share"]
        held = np.bincount(np.repeat(np.arange(len(units)), np.diff(starts)) * len(LANGUAGES) + language, sure * n_words, len(units) * len(LANGUAGES)).reshape(-1, len(LANGUAGES))
        words = np.bincount(np.repeat(np.arange(len(units)), np.diff(starts)) * len(LANGUAGES) + language, n_words, len(units) * len(LANGUAGES)).reshape(-1, len(LANGUAGES))
        found = []
        for p, h, w in zip(part, held, words):
            found.append([{"lang": LANGUAGES[c], "share": float(p[c]), "confidence": float(h[c] / w[c])} for c in np.argsort(-np.nan_to_num(p), kind="stable") if p[c] >= SHARE])
        return {"doc_id": columns["doc_id"], "label": columns["label"], "prose_share": natural, "langs": found}

    return map_batches(kept, batch, "doc_id bigint, label string, prose_share double, langs array<struct<lang:string,share:double,confidence:double>>")


def found(documents: DataFrame) -> DataFrame:
    """Documents whose label is missing or wrong, or that are in several languages: a row for each language that counts."""
    known = document_languages(documents).filter((F.col("prose_share") >= prose.PROSE_SHARE) & (F.size("langs") > 0))
    several = F.size("langs") > 1
    return known.filter(several | (F.col("label") != F.col("langs")[0]["lang"])).select("doc_id", F.explode("langs").alias("x")).select("doc_id", F.col("x.lang").alias("lang")).distinct()
