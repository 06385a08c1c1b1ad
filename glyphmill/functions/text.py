"""Column functions on raw text: markup, hidden characters, diagnostics, the quality gate and character statistics."""

from __future__ import annotations

import unicodedata
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# The patterns that decide what counts as markup, hidden or a word.
URL = r"(?i)https?://\S+|www\.\S+"
HTML = r"<[^>]+>"
FENCE = r"```[\s\S]*?```"
INLINE = r"`[^`]+`"
TABLE_ROW = r"(?m)^\s*\|.*\|\s*$"
HIDDEN = "[​-‍﻿­‎‏‪-‮⁠⁦-⁩]"
CONTROL = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]"
WORD = r"\p{L}+(?:'\p{L}+)?"

# Thresholds of the quality gate.
GATE = {"min_chars": 30, "min_tokens": 5, "min_avg_word": 2.0, "max_avg_word": 10.0, "min_alpha": 0.55, "max_digit": 0.30, "max_punct": 0.35, "min_entropy": 0.35}


def markup_flags(c: str) -> list[Column]:
    """had_urls, had_html, had_code, had_table of the raw text."""
    x = F.col(c)
    return [x.rlike(URL).alias("had_urls"), x.rlike(HTML).alias("had_html"), (x.rlike(FENCE) | x.rlike(INLINE)).alias("had_code"), x.rlike(TABLE_ROW).alias("had_table")]


def strip_markup(c: str) -> Column:
    """Text without URLs, code, tags and table rows, white space collapsed; '' for null."""
    x = F.coalesce(F.col(c), F.lit(""))
    for pattern in (URL, FENCE, INLINE, HTML):
        x = F.regexp_replace(x, pattern, " ")
    kept = F.filter(F.split(x, r"\r\n|\n|\r"), lambda line: ~line.rlike(r"^\s*\|.*\|\s*$"))
    return F.trim(F.regexp_replace(F.array_join(kept, "\n"), r"\s+", " "))


def nfkc(x: Column) -> Column:
    """Compatibility composition, for which Spark has no function."""

    @F.pandas_udf(StringType())
    def compose(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else v if v.isascii() else unicodedata.normalize("NFKC", v))

    return compose(x)


def drop_hidden(x: Column) -> Column:
    """Text without invisible and control characters, white space collapsed."""
    x = F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), HIDDEN, ""), CONTROL, "")
    return F.trim(F.regexp_replace(F.translate(x, " ", " "), r"\s+", " "))


def normalize(c: str, markup: bool = True, unicode: bool = True) -> Column:
    """The whole normalization: markup, then Unicode."""
    x = strip_markup(c) if markup else F.coalesce(F.col(c), F.lit(""))
    return drop_hidden(nfkc(x)) if unicode else x


def _share(c: str, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)) / F.length(c)


def diagnostics(documents: DataFrame, c: str = "text", key: str = "doc_id") -> DataFrame:
    """Lengths, ratios, word lengths and character entropy of each text.

    Words and characters are counted in arrays inside the row; the entropy is that of the array of
    characters, so no row is exploded or shuffled.
    """
    text = F.coalesce(F.col(c), F.lit(""))
    base = documents.select(key, text.alias("t")).withColumn("w", F.transform(F.regexp_extract_all("t", F.lit(WORD), F.lit(0)), F.length))
    n = F.length("t")
    some = n > 0
    mean = F.aggregate("w", F.lit(0.0), lambda a, x: a + x) / F.size("w")
    base = base.withColumn("m", F.when(F.size("w") > 0, mean))
    std = F.when(F.size("w") > 0, F.sqrt(F.aggregate("w", F.lit(0.0), lambda a, x: a + (x - F.col("m")) * (x - F.col("m"))) / F.size("w")))
    # run lengths of the sorted characters give the counts
    chars = F.array_sort(F.split("t", ""))
    counted = F.aggregate(
        chars,
        F.struct(F.lit("").alias("c"), F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("k"), F.lit(0.0).alias("s")),
        lambda a, x: F.when(a["c"] == x, F.struct(x.alias("c"), (a["n"] + 1).alias("n"), a["k"].alias("k"), a["s"].alias("s"))).otherwise(
            F.struct(x.alias("c"), F.lit(1).cast("bigint").alias("n"), (a["k"] + 1).alias("k"), (a["s"] + F.when(a["n"] > 0, a["n"] * F.log2(a["n"].cast("double"))).otherwise(0.0)).alias("s"))
        ),
        lambda a: F.struct(a["k"].alias("k"), (a["s"] + F.when(a["n"] > 0, a["n"] * F.log2(a["n"].cast("double"))).otherwise(0.0)).alias("s")),
    )
    base = base.withColumn("e", counted)
    entropy = F.when(some, F.log2(n.cast("double")) - F.col("e.s") / n)
    return base.select(
        key, n.cast("bigint").alias("n_chars"), F.size("w").cast("bigint").alias("n_tok"),
        *[F.round(F.when(some, F.regexp_count("t", F.lit(p)) / n).otherwise(0.0), 6).alias(a) for a, p in (("alpha_ratio", r"\p{L}"), ("digit_ratio", r"\p{Nd}"), ("punct_ratio", r"[^\p{L}\p{N}\s]"))],
        F.round("m", 6).alias("avg_word_length"), F.round(std, 6).alias("std_word_length"), F.round(entropy, 6).alias("entropy_bits"),
        F.round(entropy / F.log2(F.greatest(F.lit(2), F.col("e.k")).cast("double")), 6).alias("entropy_norm"),
    )


def gate_reasons() -> Column:
    """Reasons for which the diagnostics fail the gate, joined by ';'; '' if they pass."""
    def low(c: str, k: str) -> Column:
        return F.col(c) < GATE[k]

    checks = (
        ("too_short_chars", low("n_chars", "min_chars")), ("too_few_tokens", low("n_tok", "min_tokens")),
        ("avg_word_length_out_of_range", F.col("avg_word_length").isNull() | low("avg_word_length", "min_avg_word") | (F.col("avg_word_length") > GATE["max_avg_word"])),
        ("low_alpha_ratio", low("alpha_ratio", "min_alpha")), ("high_digit_ratio", F.col("digit_ratio") > GATE["max_digit"]), ("high_punct_ratio", F.col("punct_ratio") > GATE["max_punct"]),
        ("low_entropy", F.col("entropy_norm").isNull() | low("entropy_norm", "min_entropy")),
    )
    return F.concat_ws(";", *[F.when(c, F.lit(n)) for n, c in checks])


def char_classes(c: str) -> list[Column]:
    return [F.round(_share(c, r"\p{Lu}"), 6).alias("uppercase_ratio"), F.round(_share(c, r"\p{Nd}"), 6).alias("digit_ratio"), F.round(_share(c, r"\s"), 6).alias("whitespace_ratio"), F.size(F.array_distinct(F.split(c, ""))).cast("bigint").alias("unique_char_count")]


def char_trigram_statistics(documents: DataFrame) -> DataFrame:
    """Diversity and entropy of character trigrams; texts of less than three characters have none."""
    # by an array of characters: a place in a UTF-8 string is found by walking to it
    chars = documents.filter(F.length("text") >= 3).select("doc_id", F.explode(F.array(F.split("text", ""))).alias("c"))
    grams = chars.select("doc_id", F.explode(F.transform(F.slice("c", F.lit(1), F.size("c") - 2), lambda x, i: F.concat(x, F.get("c", i + 1), F.get("c", i + 2)))).alias("gram"))
    counts = grams.groupBy("doc_id", "gram").agg(F.count("*").cast("double").alias("n"))
    total = F.sum("n")
    return counts.groupBy("doc_id").agg(F.round(F.count("*") / total, 6).alias("char_trigram_diversity"), F.round(F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total, 6).alias("char_trigram_entropy"))


def compression_ratio(c: str) -> Column:
    """Size of the zlib stream (level 6) over the size of the UTF-8 text; null for null and empty texts."""

    @F.pandas_udf(DoubleType())
    def ratio(x: pd.Series) -> pd.Series:
        raw = [s.encode("utf-8", "surrogatepass") if s else None for s in x]
        return pd.Series([len(zlib.compress(r, 6)) / len(r) if r else None for r in raw], dtype="float64")

    return ratio(F.col(c))


def whitespace_counts(c: str) -> list[Column]:
    return [F.size(F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0))).cast("bigint").alias("n_tokens_ws"), F.length(c).cast("bigint").alias("n_chars_ws")]
