"""Passages of evaluation items inside a corpus, found by multi-pattern search over words.

A Wu-Manber search with words as its letters. Patterns are all windows of WINDOW words of the
passages; a shift table over blocks of two words skips positions where no pattern can end, a
bucket of the last block selects the patterns to test, and a direct comparison confirms each hit.
A hit is then extended to both sides with the fewest changed words, and kept if it is part of a
stretch of at least STRETCH words of the passage with at most one in TOLERANCE changed.

WINDOW loses nothing: a stretch of 20 words with 2 changes keeps a run of 6 unchanged words, and
longer stretches keep longer runs.

The items are a stated query set against all documents. They are taken in blocks of at most
BLOCK_WORDS words, so what is sent to the tasks has a fixed bound however many items there are.

Cases: null, blank and wordless documents or items match nothing; passages shorter than STRETCH
words match nothing; repeated rows of a document or an item give a pair once; lines that SHARED
or more items hold (instructions) and a closing line with a question belong to no passage, unless the item has no passage of
STRETCH words without them: then long shared lines count as a passage of several items, and after those the question, too;
extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.batches import map_batches
from glyphmill.llm.words import words

STRETCH = 20
TOLERANCE = 10
WINDOW = 6
SHARED = 3
BLOCK_WORDS = 200_000
SCHEMA = "doc_id bigint, item_id bigint, stretch int, changed int, at_word int"


class Patterns:
    """Shift table, suffix buckets and passages of one block of items."""

    def __init__(self, passages: dict[int, list[str]]):
        self.passages = passages
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[tuple, list]] = defaultdict(dict)
        for item, tokens in passages.items():
            if len(tokens) < STRETCH:
                continue
            for i in range(len(tokens) - WINDOW + 1):
                window = tuple(tokens[i : i + WINDOW])
                for j in range(2, WINDOW + 1):
                    block = window[j - 2 : j]
                    self.shift[block] = min(self.shift.get(block, WINDOW), WINDOW - j)
                self.buckets[window[-2:]].setdefault(window, []).append((item, i))
        self.buckets = dict(self.buckets)

    def hits(self, tokens: list[str]) -> list[tuple[int, int, int]]:
        """(item, place in the passage, place in the text) of every window that stands in both."""
        out = []
        end, n = WINDOW - 1, len(tokens)
        shift, buckets, most = self.shift.get, self.buckets, WINDOW - 1
        while end < n:
            block = (tokens[end - 1], tokens[end])
            step = shift(block, most)
            if step:
                end += step
                continue
            at = end - WINDOW + 1
            for item, place in buckets[block].get(tuple(tokens[at : end + 1]), ()):
                out.append((item, place, at))
            end += 1
        return out


def _reach(a: list[str], b: list[str], budget: int) -> list[tuple[int, int]]:
    """For 0, 1, ... changed words: how many words of ``a`` the start of ``b`` can cover, and those of ``b``.

    A change replaces, drops or adds one word; the furthest point of every diagonal is kept.
    """
    n, m = len(a), len(b)

    def slide(i: int, j: int) -> int:
        while i < n and j < m and a[i] == b[j]:
            i += 1
            j += 1
        return i

    front = {0: slide(0, 0)}
    out = [(front[0], front[0])]
    for _ in range(budget):
        if out[-1][0] >= n:
            break
        nxt: dict[int, int] = {}
        for d, i in front.items():
            for d2, i2 in ((d, i + 1), (d - 1, i + 1), (d + 1, i)):  # replaced, dropped from b, added to b
                j2 = i2 + d2
                if i2 <= n and 0 <= j2 <= m and nxt.get(d2, -1) < i2:
                    nxt[d2] = i2
        front = {d: slide(i, i + d) for d, i in nxt.items()}
        if not front:
            break
        d, i = max(front.items(), key=lambda x: x[1])
        out.append((i, i + d))
    return out


def stretch_at(passage: list[str], tokens: list[str], place: int, at: int) -> tuple[int, int, int] | None:
    """The longest allowed stretch over a hit: words of the passage, changed words, start in the text."""
    budget = len(passage) // TOLERANCE
    left = _reach(passage[:place][::-1], tokens[max(0, at - 2 * place - budget) : at][::-1], budget)
    right = _reach(passage[place + WINDOW :], tokens[at + WINDOW : at + WINDOW + 2 * len(passage)], budget)
    best = None
    for e1, (i1, j1) in enumerate(left):
        for e2, (i2, _) in enumerate(right):
            length = i1 + WINDOW + i2
            if length >= STRETCH and (e1 + e2) * TOLERANCE <= length and (best is None or length > best[0]):
                best = (length, e1 + e2, at - j1)
    return best


def passages(items: DataFrame) -> DataFrame:
    """``items(item_id, text)`` to their passages: as few of shared lines and the closing question as leave STRETCH words."""
    canonical = map_batches(items.select("item_id", "text"), _lines, "item_id bigint, line_no int, last boolean, line string, question boolean")
    shared = canonical.groupBy("line").agg(F.count_distinct("item_id").alias("n")).filter(F.col("n") >= SHARED).select("line", F.lit(True).alias("shared"))
    n_words = F.size(F.split("line", " "))
    # 0: the item's own; 1: a long line of several items; 2: the closing question; 3: an instruction
    rank = F.when(F.col("shared").isNotNull(), F.when(n_words >= STRETCH, 1).otherwise(3)).when(F.col("last") & F.col("question"), 2).otherwise(0)
    ranked = canonical.join(shared, "line", "left").select("item_id", "line_no", "line", rank.alias("rank"), n_words.alias("n_words")).filter("rank < 3").distinct()
    upto = ranked.groupBy("item_id").agg(*[F.coalesce(F.sum(F.when(F.col("rank") <= k, F.col("n_words"))), F.lit(0)).alias(f"n{k}") for k in (0, 1)])
    most = upto.select("item_id", F.when(F.col("n0") >= STRETCH, 0).when(F.col("n1") >= STRETCH, 1).otherwise(2).alias("most"))
    own = ranked.join(most, "item_id").filter(F.col("rank") <= F.col("most"))
    return own.groupBy("item_id").agg(F.array_join(F.transform(F.sort_array(F.collect_set(F.struct("line_no", "line"))), lambda x: x["line"]), " ").alias("passage"))


def _lines(columns: dict[str, list]) -> dict[str, object]:
    out: dict[str, list] = {"item_id": [], "line_no": [], "last": [], "line": [], "question": []}
    for item, text in zip(columns["item_id"], columns["text"]):
        kept = [(x, " ".join(words(x))) for x in (text or "").split("\n")]
        kept = [x for x in kept if x[1]]
        for i, (raw, line) in enumerate(kept):
            for k, v in (("item_id", item), ("line_no", i), ("last", i > 0 and i == len(kept) - 1), ("line", line), ("question", raw.rstrip().endswith("?"))):
                out[k].append(v)
    return out


def _blocks(items: DataFrame):
    """The passages in blocks of bounded size, fetched row by row."""
    block: dict[int, list[str]] = {}
    size = 0
    for row in passages(items).toLocalIterator():
        tokens = row["passage"].split(" ")
        if block and size + len(tokens) > BLOCK_WORDS:
            yield block
            block, size = {}, 0
        block[row["item_id"]] = tokens
        size += len(tokens)
    if block:
        yield block


def _searcher(patterns: Patterns):
    def search(columns: dict[str, list]) -> dict[str, object]:
        out: dict[str, list] = {k: [] for k in ("doc_id", "item_id", "stretch", "changed", "at_word")}
        for doc, text in zip(columns["doc_id"], columns["text"]):
            tokens = words(text)
            if len(tokens) < STRETCH - STRETCH // TOLERANCE:
                continue
            best: dict[int, tuple] = {}
            done: dict[int, tuple] = {}
            for item, place, at in patterns.hits(tokens):
                before = done.get(item)
                done[item] = (place, at)
                if before == (place - 1, at - 1):
                    continue  # the same run, already extended from its start
                if item in best and best[item][2] <= at < best[item][2] + best[item][0]:
                    continue
                x = stretch_at(patterns.passages[item], tokens, place, at)
                if x and (item not in best or x[0] > best[item][0]):
                    best[item] = x
            for item, x in best.items():
                for k, v in zip(out, (doc, item, *x)):
                    out[k].append(v)
        return out

    return search


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Each document and item with the longest leaked stretch: words, changed words, place in the text."""
    out = None
    for block in _blocks(items):
        part = map_batches(documents.select("doc_id", "text"), _searcher(Patterns(block)), SCHEMA)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return documents.sparkSession.createDataFrame([], SCHEMA)
    return out


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    return leaks(documents, items).select("doc_id", "item_id").distinct()


def report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """For each item that leaked: the documents it stands in, and its longest stretch."""
    return leaks(documents, items).groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_documents"), F.max("stretch").alias("longest"))
