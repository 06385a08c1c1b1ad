"""A mix of sources with given shares of the total size in tokens.

Efraimidis-Spirakis sampling: every document of a source gets an exponential key divided by its quality weight,
the keys are sorted within the source, and token counts are summed along them. A source whose budget
exceeds its size is first used in whole epochs, as many as fit and at most ``max_repeats``; what is
left of the budget is filled from the sorted documents, up to the one that would pass it.

Prefix sums run over all sources at once, in the order of source and key: the rows are partitioned by quantiles of this order,
summed within a partition, and get the sum of the partitions before theirs, so a hot source or a heap of like
keys is never in one task.

Cases: null, blank and tokenless documents are never drawn; sources without a target, and targets without
documents, are reported with what they have; null sources count as one without a target; copies are drawn
like other documents; a null or non-positive target is 0 and a null ``max_repeats`` is 1; an
empty corpus gives an empty mix and a report of zeros; extra columns are ignored. The draw depends on the seed, the
id and the text alone.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.batches import map_batches
from glyphmill.operators.ranking import running_sums
from glyphmill.session import materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split of a text before its merges that belongs to the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longest piece handed to the tokenizer at once; pieces are cut at white space, where the pattern cuts as well.
PIECE = 1 << 16


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The public byte-pair tokenizer whose ranks are in ``path``."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(texts: list[str | None], path: str = TOKENIZER) -> list[int]:
    """Tokens of whole texts; 0 for null and blank ones."""
    encode = tokenizer(path).encode_ordinary
    out = []
    for text in texts:
        if not text or text.isspace():
            out.append(0)
        elif len(text) <= PIECE:
            out.append(len(encode(text)))
        else:
            total, at = 0, 0
            while at < len(text):
                cut = text.find(" ", at + PIECE)
                cut = len(text) if cut < 0 else cut
                total += len(encode(text[at:cut]))
                at = cut
            out.append(total)
    return out


def quality(text: Column, n_tokens: Column) -> Column:
    """Weight of a document in the draw, 0.1 to 1: letters among its characters, and whether it has a usable length."""
    letters = F.regexp_count(text, F.lit(r"[\p{L}\s]")) / F.greatest(F.length(text), F.lit(1))
    return F.greatest(F.lit(0.1), letters * F.least(F.lit(1.0), 0.25 + n_tokens / 200.0))


def weighed(documents: DataFrame, path: str = TOKENIZER, seed: int = 7) -> DataFrame:
    """doc_id, source, n_tokens, quality and exponential key of all documents that have tokens."""

    def batch(columns: dict[str, list]) -> dict[str, object]:
        texts = columns["text"]
        return {"doc_id": columns["doc_id"], "source": columns["source"], "n_tokens": count_tokens(texts, path), "quality": columns["quality"], "mark": columns["mark"]}

    text = F.col("text")
    # the uniform number of a document: 52 bits of a hash of seed, id and text
    mark = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), text), 12) + 0.5) / F.lit(float(1 << 52))
    kept = documents.select("doc_id", "source", "text", quality(text, F.length(text) / 5).alias("quality"), mark.alias("mark")).filter("text is not null")
    tokens = map_batches(kept, batch, "doc_id bigint, source string, n_tokens bigint, quality double, mark double").filter("n_tokens > 0")
    return tokens.withColumn("key", -F.log("mark") / F.col("quality"))


def plan(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """Budget of each source: whole epochs and the tokens of the fraction.

    ``sizes(source, n_documents, size)``; ``targets(source, target_weight, max_repeats)``, summed to 1.
    Without ``total_tokens`` the mix is as large as all documents of the targeted sources together.
    """
    weight = F.greatest(F.coalesce(F.col("target_weight"), F.lit(0.0)), F.lit(0.0))
    wanted = targets.groupBy("source").agg(F.max(weight).alias("weight"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    wanted = wanted.withColumnRenamed("source", "of")
    joined = sizes.join(wanted, F.col("source").eqNullSafe(F.col("of")), "full")
    joined = joined.select(F.coalesce("source", "of").alias("source"), F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("size", F.lit(0)).cast("bigint").alias("size"), F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"))
    # the grouped table has a row for each source only
    sums = joined.agg(F.sum("weight").alias("weights"), F.sum(F.when(F.col("weight") > 0, F.col("size"))).alias("targeted"))
    total = F.lit(total_tokens).cast("double") if total_tokens is not None else F.col("targeted").cast("double")
    shared = joined.crossJoin(F.broadcast(sums)).withColumn("share", F.when(F.col("weights") > 0, F.col("weight") / F.col("weights")).otherwise(0.0)).withColumn("budget", F.floor(F.coalesce(total, F.lit(0.0)) * F.col("share")).cast("bigint"))
    epochs = F.least(F.col("max_repeats").cast("bigint"), F.when(F.col("size") > 0, F.floor(F.col("budget") / F.col("size"))).otherwise(0))
    planned = shared.withColumn("epochs", F.greatest(epochs, F.lit(0)))
    rest = F.when(F.col("epochs") < F.col("max_repeats"), F.col("budget") - F.col("epochs") * F.col("size")).otherwise(0)
    return planned.withColumn("rest", F.greatest(rest, F.lit(0)).cast("bigint")).select("source", "n_documents", "size", "share", "max_repeats", "budget", "epochs", "rest")


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, path: str = TOKENIZER, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, n_tokens, times) of every document in the mix, and the plan."""
    rows = materialize(weighed(documents, path, seed))
    sizes = rows.groupBy("source").agg(F.count("*").alias("n_documents"), F.sum("n_tokens").alias("size"))
    planned = materialize(plan(sizes, targets, total_tokens))
    # targeted sources are as few as the targets
    targeted = running_sums(planned.filter("share > 0 and size > 0"), ["source"], {"start": F.col("size")}).select(F.col("source").alias("of"), "epochs", "rest", "start")
    known = rows.join(F.broadcast(targeted), F.col("source").eqNullSafe(F.col("of"))).select("doc_id", "source", "n_tokens", "key", "epochs", "rest", "start")
    summed = running_sums(known, ["source", "key", "doc_id"], {"before": F.col("n_tokens")})
    fits = F.col("before") - F.col("start") + F.col("n_tokens") <= F.col("rest")
    return summed.select("doc_id", "source", "n_tokens", (F.col("epochs") + fits.cast("bigint")).alias("times")).filter("times > 0"), planned


def report(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, path: str = TOKENIZER, seed: int = 7) -> DataFrame:
    """For each source: target and actual share, documents and tokens drawn, and what the budget lacks."""
    drawn, planned = mix(documents, targets, total_tokens, path, seed)
    actual = drawn.groupBy(F.col("source").alias("of")).agg(F.count("*").alias("n_drawn"), F.sum("times").alias("n_uses"), F.max("times").alias("most_uses"), F.sum(F.col("n_tokens") * F.col("times")).alias("tokens"))
    joined = planned.join(actual, F.col("source").eqNullSafe(F.col("of")), "left").select("source", "n_documents", "size", "share", "max_repeats", "budget", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_drawn", "n_uses", "most_uses", "tokens")])
    total = joined.agg(F.sum("tokens").alias("all_tokens"))
    return joined.crossJoin(F.broadcast(total)).select(
        "source", "n_documents", F.col("size").alias("available_tokens"), F.col("share").alias("target_share"), "max_repeats", "budget", "n_drawn", "n_uses", "most_uses", "tokens",
        F.when(F.col("all_tokens") > 0, F.col("tokens") / F.col("all_tokens")).otherwise(0.0).alias("actual_share"),
        F.greatest(F.lit(0), F.col("budget") - F.col("tokens")).alias("shortfall"),
    )
