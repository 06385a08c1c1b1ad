"""Per-document text statistics, and the line model that tells prose from lists, tables and junk.

A text is a sequence of lines; a line longer than LONG characters is cut at its sentence ends, so that a text
on a single line is a sequence as well. Each line is observed as a vector of small categorical
features (its statistics in classes). A hidden Markov model with the states prose, list, table and
junk labels the sequence by its most probable path; a document's label shares are shares of its
words (of its characters, where it has hardly any words).

The model starts from stated expectations for each state and is then fitted by two rounds of
Viterbi training on all documents: the tasks add up how often each state has each class and follows each state;
the expectations count as ``PRIOR`` lines, so few or odd documents cannot turn states around.

Cases: null and blank texts have zero words, null in every other measure, and are never found; a text
without any line break is cut into sentences; very long texts are processed whole; repeated rows give
a row each in the statistics and one in ``found``; empty tables give no rows.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.batches import map_batches
from glyphmill.llm.words import visible
from glyphmill.session import materialize

STATES = ("prose", "list", "table", "junk")
LONG = 160
PRIOR = 400.0
#: A document whose share of prose words is below this isn't prose.
PROSE_SHARE = 0.5

# The commonest function words of the six languages.
COMMON = frozenset(
    """the a an of and to in is was it that for on with as at by but not his her my we he she they this from or had be are who what when
    der die das und ist nicht ein eine den dem des zu von mit auf im sich auch es wie dass so noch als man kaum wenn
    le la les de du et est un une que qui dans pour pas sur au aux ne il elle on se plus mais avec sans ce cette
    el los las y en es por con para su no lo una del al casi como más ni
    o os as e da do das dos em na um uma não com mais ao à são foi se
    het een van op te niet dat zijn met aan er maar om voor ook is naar zo""".split()
)

_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’»)]*\s+")
_MARKER = re.compile(r"\s*(?:[-*•·+>o»]\s|\(?\d{1,3}(?:\.\d+)*[.):]\s|\d+\.\d+\s|#)")
_WRAP = 30

# Byte classes of UTF-8: a letter outside ASCII leaves its first byte only, signs of the blocks of general punctuation none.
_CONTINUATION, _SIGNS = set(range(0x80, 0xC0)), {0xC2, 0xE2}
_ALNUM = {c for c in range(128) if chr(c).isalnum()}
_PLAIN = {*b" \t\r\n.,;:!?'\"()-"}
_NOT_LETTERS = bytes(set(range(128)) - _ALNUM | _CONTINUATION | _SIGNS | {0xF0})
_NOT_ODD = bytes(_ALNUM | _PLAIN | _CONTINUATION | _SIGNS | set(range(0xC3, 0xE2)) | set(range(0xE3, 0xF0)))
_NOT_DIGITS = bytes(set(range(256)) - {*b"0123456789"})
_NOT_CAPITALS = bytes(set(range(256)) - {*b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"})

#: Features of a line and how many classes each has.
FEATURES = (("end", 2), ("common", 4), ("odd", 4), ("digits", 3), ("length", 4), ("capitals", 3), ("marker", 2), ("cells", 3), ("word", 3))
#: Stated expectations: for each state and feature the probability of each class.
EXPECTED = {
    "prose": ((0.25, 0.75), (0.02, 0.08, 0.40, 0.50), (0.93, 0.05, 0.015, 0.005), (0.95, 0.045, 0.005), (0.05, 0.20, 0.50, 0.25), (0.96, 0.03, 0.01), (0.98, 0.02), (0.90, 0.09, 0.01), (0.04, 0.93, 0.03)),
    "list": ((0.98, 0.02), (0.50, 0.15, 0.20, 0.15), (0.70, 0.20, 0.08, 0.02), (0.75, 0.20, 0.05), (0.55, 0.35, 0.07, 0.03), (0.45, 0.10, 0.45), (0.45, 0.55), (0.70, 0.20, 0.10), (0.10, 0.85, 0.05)),
    "table": ((0.97, 0.03), (0.70, 0.15, 0.10, 0.05), (0.30, 0.30, 0.30, 0.10), (0.15, 0.35, 0.50), (0.35, 0.45, 0.15, 0.05), (0.60, 0.25, 0.15), (0.85, 0.15), (0.05, 0.35, 0.60), (0.30, 0.65, 0.05)),
    "junk": ((0.93, 0.07), (0.82, 0.15, 0.02, 0.01), (0.15, 0.20, 0.25, 0.40), (0.55, 0.30, 0.15), (0.20, 0.25, 0.25, 0.30), (0.70, 0.15, 0.15), (0.75, 0.25), (0.45, 0.25, 0.30), (0.40, 0.40, 0.20)),
}
STAY = 0.9
SCHEMA = (
    "n_words int, mean_word_length double, symbol_ratio double, punctuated_line_share double, common_word_share double, n_lines int, "
    + ", ".join(f"{s}_share double" for s in STATES)
)


def unwrapped(text: str) -> list[str]:
    """The lines that aren't blank, hard-wrapped ones joined again.

    A line goes on in the next if it is of some width, ends in a letter or comma, and the next one
    begins with a small letter and no list marker.
    """
    out: list[str] = []
    for line in text.split("\n"):
        if not line or line.isspace():
            out.append("")
            continue
        before = out[-1] if out else ""
        if len(before) >= _WRAP and (before[-1].isalpha() or before[-1] == ",") and line[0].islower() and not _MARKER.match(line):
            out[-1] = before + " " + line.rstrip()
        else:
            out.append(line.rstrip())
    return [x for x in out if x]


def lines(text: str) -> list[str]:
    """The units of a text: its lines, long ones cut at sentence ends."""
    out = []
    for line in unwrapped(text) if "\n" in text else [text]:
        if len(line) > LONG:
            out += [x for x in _SENTENCE.split(line) if x and not x.isspace()]
        else:
            out.append(line)
    return out


def observe(line: str) -> tuple[tuple[int, ...], int, int, int, int, int]:
    """Classes of a line's features; then words, letters in words, common words, odd symbols, whether it ends in punctuation."""
    raw = line.encode("utf-8", "surrogatepass")
    tokens = line.lower().split()
    size = len(line)
    letters = len(raw.translate(None, _NOT_LETTERS))
    odd = len(raw.translate(None, _NOT_ODD))
    digits = len(raw.translate(None, _NOT_DIGITS))
    capitals = len(raw.translate(None, _NOT_CAPITALS))
    n = len(tokens) or 1
    common = sum(map(COMMON.__contains__, tokens))
    end = 1 if line.rstrip(" \"'”’»)*_]")[-1:] in (".", "!", "?", "…", ":") else 0
    count = line.count
    cells = count("|") + count("\t") + count(";") + count("=") + count("::") + count("...") + count("   ") + count(": ") + count(",") - count(", ")
    share, rate, figures, capital, mean = common / n, odd / size, digits / size, capitals / n, letters / n
    return (
        (
            end,
            0 if share < 0.06 else 1 if share < 0.16 else 2 if share < 0.35 else 3,
            0 if rate < 0.015 else 1 if rate < 0.05 else 2 if rate < 0.12 else 3,
            0 if figures < 0.03 else 1 if figures < 0.15 else 2,
            0 if n < 4 else 1 if n < 8 else 2 if n < 18 else 3,
            0 if capital < 0.4 or capital > 1.5 or n < 2 else 1 if capital < 0.6 else 2,
            1 if _MARKER.match(line) else 0,
            0 if cells == 0 else 1 if cells < 3 and cells * 6 < n + 3 else 2,
            0 if mean < 3.2 else 1 if mean < 12 else 2,
        ),
        n,
        letters,
        common,
        odd,
        end,
    )


class LineModel:
    """Log probabilities of starts, moves and feature classes for each state."""

    def __init__(self, emissions: list[np.ndarray] | None = None, moves: np.ndarray | None = None):
        k = len(STATES)
        self.emissions = emissions or [np.array([EXPECTED[s][f] for s in STATES]) for f in range(len(FEATURES))]
        self.moves = moves if moves is not None else np.full((k, k), (1 - STAY) / (k - 1)) + np.eye(k) * (STAY - (1 - STAY) / (k - 1))
        self.log_e = [np.log(e) for e in self.emissions]
        self.log_m = np.log(self.moves)

    def label(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Most probable states of all lines of a batch; ``starts``: the first line of each document, then the end.

        Documents are walked in step, the longest first, so the work is a few array operations for each position.
        """
        lengths = np.diff(starts)
        scores = sum(e[:, codes[:, f]].T for f, e in enumerate(self.log_e))
        labels = np.zeros(len(codes), np.int8)
        back = np.zeros((len(codes), len(STATES)), np.int8)
        order = np.argsort(-lengths, kind="stable")
        first = starts[:-1][order]
        length = lengths[order]
        active = int((length > 0).sum())
        if not active:
            return labels
        best = scores[first[:active]].copy()
        final = np.zeros((active, len(STATES)))
        t = 1
        while active:
            still = int((length[:active] > t).sum())
            final[still:active] = best[still:active]
            active = still
            if not active:
                break
            options = best[:active, :, None] + self.log_m[None]
            at = first[:active] + t
            back[at] = options.argmax(1)
            best = options.max(1) + scores[at]
            t += 1
        used = len(final)
        state = final.argmax(1)
        for step in range(int(length[0]) - 1, -1, -1):
            live = int((length[:used] > step).sum())
            at = first[:live] + step
            labels[at] = state[:live]
            if step:
                state[:live] = back[at, state[:live]]
        return labels

    def counts(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """How many lines of a batch the most probable paths have for each feature, state and class; then the moves between states."""
        labels = self.label(codes, starts)
        out = []
        for f, (_, classes) in enumerate(FEATURES):
            seen = np.zeros((len(STATES), classes), np.int64)
            np.add.at(seen, (labels, codes[:, f]), 1)
            out.append(seen.ravel())
        inner = np.ones(len(codes), bool)
        inner[starts[:-1][np.diff(starts) > 0]] = False
        inner = np.flatnonzero(inner)
        seen = np.zeros((len(STATES), len(STATES)), np.int64)
        np.add.at(seen, (labels[inner - 1], labels[inner]), 1)
        return np.concatenate([*out, seen.ravel()])

    @staticmethod
    def estimated(counts: np.ndarray) -> LineModel:
        """The model of summed counts, with the stated expectations as prior lines."""
        base = LineModel()
        parts = np.split(counts.astype(float), np.cumsum([len(STATES) * classes for _, classes in FEATURES]))
        emissions = [x.reshape(len(STATES), -1) + PRIOR * e for x, e in zip(parts, base.emissions)]
        moves = parts[-1].reshape(len(STATES), -1) + PRIOR * base.moves
        return LineModel([e / e.sum(1, keepdims=True) for e in emissions], moves / moves.sum(1, keepdims=True))


def units_of(texts: list[str | None]) -> list[list[str]]:
    """The units of each text; none for null and blank ones."""
    return [lines(visible(t)) if t and not t.isspace() else [] for t in texts]


def sentences_of(units: list[list[str]]) -> list[list[str]]:
    """The units of each text cut at all sentence ends, however short the lines are."""
    return [[x for line in document for x in _SENTENCE.split(line) if x and not x.isspace()] for document in units]


def observed(units: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature codes and counts of all lines of a batch, and the starts of its documents."""
    seen = [observe(line) for document in units for line in document]
    starts = np.concatenate([[0], np.cumsum([len(u) for u in units], dtype=np.int64)]).astype(np.int64)
    codes = np.array([x[0] for x in seen], np.int8).reshape(-1, len(FEATURES))
    counts = np.array([x[1:] for x in seen], np.int64).reshape(-1, 5)
    sizes = np.array([len(line) for document in units for line in document], np.int64).reshape(-1, 1)
    return codes, np.hstack([counts, sizes]), starts


def _coded(columns: dict[str, list]) -> dict[str, object]:
    codes, _, starts = observed(units_of(columns["text"]))
    return {"codes": [codes[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:])]}


def _counter(model: LineModel):
    def count(columns: dict[str, list]) -> dict[str, object]:
        codes = np.frombuffer(b"".join(columns["codes"]), np.int8).reshape(-1, len(FEATURES))
        starts = np.concatenate([[0], np.cumsum([len(c) // len(FEATURES) for c in columns["codes"]], dtype=np.int64)]).astype(np.int64)
        n = model.counts(codes, starts)
        return {"place": np.arange(len(n)), "n": n}

    return count


def fit(documents: DataFrame) -> LineModel:
    """The line model, fitted on all documents; only the sums of its counts come to the driver."""
    model = LineModel()
    coded = materialize(map_batches(documents.select("text").filter(F.col("text").isNotNull()), _coded, "codes binary"))
    size = len(STATES) * (sum(classes for _, classes in FEATURES) + len(STATES))
    for _ in range(2):
        counts = np.zeros(size, np.int64)
        for r in map_batches(coded, _counter(model), "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).collect():
            counts[r["place"]] = r["n"]
        model = LineModel.estimated(counts)
    return model


def profile(units: list[list[str]], model: LineModel) -> dict[str, np.ndarray]:
    """The columns of SCHEMA for a batch of texts given by their units; NaN where a measure has no value."""
    codes, counts, starts = observed(units)
    labels = model.label(codes, starts)

    def total(x: np.ndarray) -> np.ndarray:
        cum = np.concatenate([[0.0], np.cumsum(x, dtype=float)])
        return cum[starts[1:]] - cum[starts[:-1]]

    with np.errstate(divide="ignore", invalid="ignore"):
        n_words, n_lines, size = total(counts[:, 0]), np.diff(starts).astype(float), total(counts[:, 5])
        weight = np.where(counts[:, 0] * 12 >= counts[:, 5], counts[:, 0] * 6, counts[:, 5])  # lines with hardly any words weigh by characters
        whole = total(weight)
        out = {
            "n_words": n_words.astype(np.int64),
            "mean_word_length": total(counts[:, 1]) / n_words,
            "symbol_ratio": total(counts[:, 3]) / size,
            "punctuated_line_share": total(counts[:, 4]) / n_lines,
            "common_word_share": total(counts[:, 2]) / n_words,
            "n_lines": n_lines.astype(np.int64),
        }
        for k, s in enumerate(STATES):
            out[f"{s}_share"] = total(weight * (labels == k)) / whole
    return out


def statistics(documents: DataFrame) -> DataFrame:
    """doc_id with word count, mean word length, ratios and label shares of each document."""
    model = fit(documents)

    def batch(columns: dict[str, list]) -> dict[str, object]:
        return {"doc_id": columns["doc_id"]} | profile(units_of(columns["text"]), model)

    return map_batches(documents.select("doc_id", "text"), batch, "doc_id bigint, " + SCHEMA)


def found(documents: DataFrame) -> DataFrame:
    return statistics(documents).filter(F.col("prose_share") < PROSE_SHARE).select("doc_id").distinct()
