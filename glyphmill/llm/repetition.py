"""Repetition inside single texts, kept as a ledger of rule bits.

Every rule is evaluated once for each text. The ledger stores one measurement a rule and a bit
mask of the rules that failed; a policy is a named, versioned mask over those bits, so policies can
be changed, compared and ablated by bitwise aggregation without reading a text again.

Cases: a null, blank or wordless text has zero in every measurement and no bit; texts shorter than
a rule's window have zero for it; equal ids (several deliveries) keep a ledger row each and one row
in the result of a policy; extra columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.batches import map_batches
from glyphmill.llm.words import words

STRETCH = 4
#: Words from which on the share of a single word says something.
MANY = 20
_BREAK = re.compile(r"[.!?…]+[\"'”’)]*\s+|\n+")
_PARAGRAPH = re.compile(r"\n\s*\n")


@dataclass(frozen=True)
class Rule:
    """A measurement and the share from which on it counts as a failure."""

    name: str
    bit: int
    least: float


@dataclass(frozen=True)
class Policy:
    """A text is repetitive if at least ``need`` of the rules in the mask failed."""

    name: str
    version: int
    rules: tuple[str, ...]
    need: int = 1


RULES = (
    Rule("repeated_stretch_share", 0, 0.4),
    Rule("repeated_sentence_share", 1, 0.3),
    Rule("repeated_line_share", 2, 0.3),
    Rule("repeated_paragraph_share", 3, 0.3),
    Rule("top_word_share", 4, 0.3),
    Rule("top_stretch_share", 5, 0.18),
    Rule("longest_loop_share", 6, 0.3),
)
POLICIES = (
    Policy("stretches", 1, ("repeated_stretch_share",)),
    Policy("units", 1, ("repeated_sentence_share", "repeated_line_share", "repeated_paragraph_share")),
    Policy("any", 1, tuple(r.name for r in RULES)),
    Policy("two_signs", 1, tuple(r.name for r in RULES), 2),
)
LEDGER = "rec_table string, rec_id string, n_words int, " + ", ".join(f"{r.name} double" for r in RULES)


def repeated_words(tokens: list, stretch: int = STRETCH) -> int:
    """How many words lie in stretches of ``stretch`` or more words that stood earlier in the text.

    A word counts if some window of ``stretch`` words over it equals a window that began earlier.
    """
    n = len(tokens) - stretch + 1
    if n < 2:
        return 0
    grams = list(zip(*[tokens[i:] for i in range(stretch)]))
    if len(set(grams)) == n:
        return 0
    seen: set = set()
    count = end = 0
    for i, gram in enumerate(grams):
        if gram in seen:
            begin = i if i > end else end
            end = i + stretch
            count += end - begin
        else:
            seen.add(gram)
    return count


def _longest_loop(tokens: list, stretch: int = STRETCH) -> int:
    """Words of the longest run that repeats what stands a fixed distance before it."""
    best, last, run = 0, {}, 0
    distance = 0
    for i, gram in enumerate(zip(*[tokens[i:] for i in range(stretch)])):
        j = last.get(gram)
        last[gram] = i
        if j is None:
            run = 0
        elif run and i - j == distance:
            run += 1
        else:
            run, distance = stretch, i - j
        if run > best:
            best = run
    return best


def _unit_share(units: list[str], n_chars: int) -> float:
    """Share of characters in units that stood earlier."""
    if len(units) < 2 or len(set(units)) == len(units):
        return 0.0
    seen: set = set()
    again = 0
    for u in units:
        if u in seen:
            again += len(u)
        else:
            seen.add(u)
    return again / max(1, n_chars)


def measure(text: str | None) -> tuple:
    """Number of words and every rule's measurement of one text."""
    tokens = words(text)
    n = len(tokens)
    if not n:
        return (0,) + (0.0,) * len(RULES)
    word = max(Counter(tokens).values()) / n if n >= MANY else 0.0
    line = paragraph = 0.0
    if "\n" in text:
        low = text.lower()
        line = _unit_share([u for u in map(str.strip, low.split("\n")) if u], len(low))
        paragraph = _unit_share([u for u in map(str.strip, _PARAGRAPH.split(low)) if u], len(low)) if "\n\n" in low else 0.0
    again = repeated_words(tokens)
    if not again:  # no window of STRETCH words repeats: the rules on sentences, stretches and loops are zero as well
        return n, 0.0, 0.0, line, paragraph, word, 0.0, 0.0
    low = text.lower()
    sentences = [u for u in _BREAK.split(low) if u.count(" ") >= STRETCH - 1]
    top = max(Counter(zip(*[tokens[i:] for i in range(STRETCH)])).values())
    return n, again / n, _unit_share([u.strip(" .!?\"'") for u in sentences], len(low)), line, paragraph, word, min(1.0, top * STRETCH / n) if top > 2 else 0.0, _longest_loop(tokens) / n


def _batch(columns: dict[str, list]) -> dict[str, object]:
    rows = [measure(t) for t in columns["text"]]
    out = dict(zip(["n_words", *(r.name for r in RULES)], zip(*rows)))
    return {"rec_table": columns["rec_table"], "rec_id": columns["rec_id"]} | {k: list(v) for k, v in out.items()}


def ledger(records: DataFrame) -> DataFrame:
    """Ledger of ``records(rec_table, rec_id, text)``: measurements and the mask of failed rules."""
    measured = map_batches(records.select("rec_table", "rec_id", "text"), _batch, LEDGER)
    bits = [F.when(F.col(r.name) >= r.least, F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("bigint") for r in RULES]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return measured.withColumn("failed", mask)


def mask_of(names: tuple[str, ...]) -> int:
    return sum(1 << r.bit for r in RULES if r.name in names)


def violates(policy: Policy, failed: str = "failed") -> Column:
    """Whether the stored bits break the policy."""
    return F.bit_count(F.col(failed).bitwiseAND(F.lit(mask_of(policy.rules)).cast("bigint"))) >= policy.need


def flagged(rows: DataFrame, policy: Policy) -> DataFrame:
    """The records that break ``policy``, each once."""
    return rows.filter(violates(policy)).select("rec_table", "rec_id").distinct()


def policy_report(rows: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """Texts and words each policy would drop, by table, in one pass over the ledger."""
    per = [F.struct(F.lit(p.name).alias("policy"), F.lit(p.version).alias("version"), violates(p).alias("hit")) for p in policies]
    return (
        rows.select("rec_table", "n_words", F.explode(F.array(*per)).alias("p"))
        .groupBy("rec_table", F.col("p.policy").alias("policy"), F.col("p.version").alias("version"))
        .agg(F.count("*").alias("n_texts"), F.count_if("p.hit").alias("n_dropped"), F.sum(F.when(F.col("p.hit"), F.col("n_words")).otherwise(0)).alias("words_dropped"))
    )


def ablation(rows: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: texts it fails, and texts that only it makes the policy drop."""
    mask = mask_of(policy.rules)
    per = [
        F.struct(
            F.lit(r.name).alias("rule"),
            (F.col("failed").bitwiseAND(F.lit(1 << r.bit).cast("bigint")) != 0).alias("fails"),
            (violates(policy) & (F.bit_count(F.col("failed").bitwiseAND(F.lit(mask & ~(1 << r.bit)).cast("bigint"))) < policy.need)).alias("alone"),
        )
        for r in RULES
        if r.name in policy.rules
    ]
    return (
        rows.select("rec_table", F.explode(F.array(*per)).alias("p"))
        .groupBy("rec_table", F.lit(policy.name).alias("policy"), F.col("p.rule").alias("rule"))
        .agg(F.count_if("p.fails").alias("n_fails"), F.count_if("p.alone").alias("n_only_by_it"))
    )
