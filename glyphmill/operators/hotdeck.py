"""Nearest-neighbour hot-deck: missing values are copied from the most similar complete records.

Records are put into hash blocks of their observed mixed features, from fine to coarse. A missing
value looks for donors in the finest block with enough of them. The donors of blocks of any size are cut into
runs of about RUN records along an ordering feature (records that tie on it are spread by a hash), the
asking records into chunks of about RUN, so that no task ever holds a whole hot block; each chunk meets each
run of its block, and the K nearest donors of the runs are merged to those of the block. So the search in a block is
exact, and its work grows with asking records times donors. The value is the weighted median (for
categories the weighted majority) of the K nearest donors, and the nearest donor is named.

Cases: null in any feature leaves it out of the distance; records equal in all features tie and are taken
by key; repeated rows are filled alike; a value without any donor in the whole table stays null with state
'unfilled'; empty tables give no rows; extra columns pass through untouched, but columns already named like a
state or donor are replaced; helper columns carry a reserved prefix and can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from glyphmill.functions.batches import map_batches
from glyphmill.session import materialize

P = "__hd_"
RUN = 4096
K = 5
ENOUGH = 5


@dataclass(frozen=True)
class Deck:
    """What a hot-deck works on.

    fields: column to the condition that its value is missing; numeric: features for distances;
    categories: features that must agree for a distance of 0; levels: block keys from fine to
    coarse; order: the feature along which large blocks are cut; weights: of numeric features in the
    distance, 1 unless given.
    """

    key: str
    fields: dict[str, Column]
    numeric: dict[str, Column]
    categories: dict[str, Column]
    levels: tuple[tuple[Column, ...], ...]
    order: Column
    weights: dict[str, float] = field(default_factory=dict)


def mark(df: DataFrame, deck: Deck) -> DataFrame:
    """``df`` with a boolean helper column for each field: whether its value is missing."""
    return df.withColumns({f"{P}m{i}": F.coalesce(c, F.lit(True)) for i, c in enumerate(deck.fields.values())})


def _prepared(df: DataFrame, deck: Deck) -> DataFrame:
    """Key, values (null where missing), features, order and the block of every level."""
    is_text = {f: isinstance(df.schema[f].dataType, T.StringType) for f in deck.fields}
    values = [F.when(~F.coalesce(c, F.lit(True)), F.col(f)).cast("string" if is_text[f] else "double").alias(f"{P}v{i}") for i, (f, c) in enumerate(deck.fields.items())]
    numeric = [c.cast("double").alias(f"{P}n{i}") for i, c in enumerate(deck.numeric.values())]
    categories = [c.cast("string").alias(f"{P}c{i}") for i, c in enumerate(deck.categories.values())]
    blocks = [F.xxhash64(F.lit(i), *(x.cast("string") for x in level)).alias(f"{P}b{i}") for i, level in enumerate(deck.levels)]
    return df.select(F.col(deck.key).alias(f"{P}key"), *values, *numeric, *categories, F.coalesce(deck.order.cast("double"), F.lit(0.0)).alias(f"{P}o"), *blocks)


def _placed(rows: DataFrame, deck: Deck) -> DataFrame:
    """Each missing field of each record with the level and block it takes its donors from."""
    names = [f"{P}v{i}" for i in range(len(deck.fields))]
    wanted = rows.select("*", F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(n).isNull().alias("m")) for i, n in enumerate(names)])).alias(f"{P}x"))
    wanted = wanted.filter(f"{P}x.m").withColumn(f"{P}f", F.col(f"{P}x.f")).drop(f"{P}x")
    out = wanted.withColumns({f"{P}level": F.lit(None).cast("int"), f"{P}block": F.lit(None).cast("bigint")})
    for level in range(len(deck.levels)):
        b = f"{P}b{level}"
        counts = rows.groupBy(b).agg(*[F.count(n).alias(f"{P}d{i}") for i, n in enumerate(names)])
        last = level == len(deck.levels) - 1
        out = out.join(counts, b, "left")
        donors = F.lit(0)
        for i in range(len(names)):
            donors = F.when(F.col(f"{P}f") == i, F.col(f"{P}d{i}")).otherwise(donors)
        take = F.col(f"{P}level").isNull() & (donors >= (1 if last else ENOUGH))
        out = out.withColumns({f"{P}level": F.when(take, F.lit(level)).otherwise(F.col(f"{P}level")), f"{P}block": F.when(take, F.col(b)).otherwise(F.col(f"{P}block"))})
        out = out.drop(*[f"{P}d{i}" for i in range(len(names))])
    return out


def _runs(pool: DataFrame) -> DataFrame:
    """``pool`` with the run of its block, and the part of the run, that each record belongs to."""
    block = [f"{P}level", f"{P}block"]
    low_high = pool.groupBy(*block).agg(F.min(f"{P}o").alias(f"{P}lo"), F.max(f"{P}o").alias(f"{P}hi"))
    width = F.greatest(F.col(f"{P}hi") - F.col(f"{P}lo"), F.lit(1e-9))
    binned = pool.join(low_high, block).withColumn(f"{P}bin", F.floor((F.col(f"{P}o") - F.col(f"{P}lo")) / width * 2048).cast("int")).drop(f"{P}lo", f"{P}hi")
    bins = binned.groupBy(*block, f"{P}bin").agg(F.count("*").alias(f"{P}size"))
    before = W.partitionBy(*block).orderBy(f"{P}bin").rowsBetween(W.unboundedPreceding, -1)
    bins = bins.withColumn(f"{P}run", F.floor(F.coalesce(F.sum(f"{P}size").over(before), F.lit(0)) / RUN))
    placed = binned.join(bins, [*block, f"{P}bin"])
    parts = F.greatest(F.lit(1), F.ceil(F.col(f"{P}size") / (2 * RUN)))
    return placed.withColumn(f"{P}part", F.pmod(F.xxhash64(f"{P}key"), parts)).drop(f"{P}size", f"{P}bin")


def _weighted_median(values: np.ndarray, weights: np.ndarray) -> float:
    order = np.lexsort((values,))
    cum = np.cumsum(weights[order])
    return values[order][int(np.searchsorted(cum, cum[-1] / 2))]


def _nearest(n_fields: int, n_numeric: int, n_categories: int, scales: list[float], weights: list[float]):
    """For each asking record of a group its K nearest donors there; ``f`` is -1 in donors."""

    def nearest(run: pd.DataFrame) -> pd.DataFrame:
        numeric = run[[f"{P}n{i}" for i in range(n_numeric)]].to_numpy(float) / np.array(scales)
        categories = run[[f"{P}c{i}" for i in range(n_categories)]].apply(lambda c: pd.factorize(c)[0]).to_numpy() if n_categories else np.zeros((len(run), 0), int)
        keys, asked, rows = run[f"{P}key"].to_numpy(), run[f"{P}f"].to_numpy(), run[f"{P}row"].to_numpy()
        values = [run[f"{P}v{i}"].to_numpy() for i in range(n_fields)]
        importance = np.array(weights, float)
        donors_all = np.flatnonzero(asked < 0)
        at, near_at, far = [], [], []
        for f in range(n_fields):
            donors = donors_all[~pd.isna(values[f][donors_all])]
            if not len(donors):
                continue
            donors = donors[np.argsort(keys[donors], kind="stable")]
            for r in np.flatnonzero(asked == f):
                gap = np.minimum(np.abs(numeric[donors] - numeric[r]), 3.0)
                known = ~np.isnan(gap)
                same = (categories[donors] == categories[r]) & (categories[r] >= 0)
                distance = (np.where(known, gap, 0) @ importance + (~same).sum(1) * 0.5) / np.maximum(1, known @ importance + categories.shape[1])
                distance = distance.round(12)  # so that ties are the same in every run
                near = np.argsort(distance, kind="stable")[:K]
                at += [r] * len(near)
                near_at += donors[near].tolist()
                far += distance[near].tolist()
        out = {f"{P}key": keys[at], f"{P}f": asked[at].astype("int32"), f"{P}row": rows[at], f"{P}far": np.array(far, float), f"{P}donor": keys[near_at]}
        for i in range(n_fields):
            out[f"{P}v{i}"] = values[i][near_at]
        return pd.DataFrame(out)

    return nearest


def _value(text: list[bool]):
    """The value that the merged donors of each asking record give."""

    def value(columns: dict[str, list]) -> dict[str, object]:
        out: dict[str, list] = {f"{P}key": columns[f"{P}key"], f"{P}f": columns[f"{P}f"], f"{P}number": [], f"{P}text": [], f"{P}donor": []}
        for f, near in zip(columns[f"{P}f"], columns[f"{P}near"]):
            weight = [1.0 / (d["far"] + 0.01) for d in near]
            if text[f]:
                votes: dict = {}
                for d, w in zip(near, weight):
                    votes[d[f"v{f}"]] = votes.get(d[f"v{f}"], 0.0) + w
                number, word = None, min(votes, key=lambda v: (-votes[v], v))
            else:
                number, word = float(_weighted_median(np.array([d[f"v{f}"] for d in near], float), np.array(weight))), None
            for k, v in ((f"{P}number", number), (f"{P}text", word), (f"{P}donor", near[0]["donor"])):
                out[k].append(v)
        return out

    return value


def impute(df: DataFrame, deck: Deck) -> DataFrame:
    """``df`` with missing fields filled; each field gets ``<field>_state`` and ``<field>_donor``.

    State: 'observed', 'filled' or 'unfilled'.
    """
    rows = _prepared(df, deck)
    n = len(deck.fields)
    key_type = dict(df.dtypes)[deck.key]
    text = [isinstance(df.schema[f].dataType, T.StringType) for f in deck.fields]
    spreads = rows.agg(*[F.expr(f"percentile_approx({P}n{i}, array(0.1, 0.9), 1000)").alias(f"q{i}") for i in range(len(deck.numeric))]).first()
    scales = [max(1e-6, q[1] - q[0]) if q else 1.0 for q in spreads]
    asked = _placed(rows, deck)
    features = [f"{P}n{i}" for i in range(len(deck.numeric))] + [f"{P}c{i}" for i in range(len(deck.categories))]
    kept = [f"{P}key", *[f"{P}v{i}" for i in range(n)], *features, f"{P}o", f"{P}level", f"{P}block", f"{P}f"]
    asked = asked.filter(F.col(f"{P}level").isNotNull()).select(*kept)
    # equal records ask once; the hash tells records apart that share a key
    asked = asked.withColumn(f"{P}row", F.xxhash64(*[c for c in kept if c != f"{P}f"])).dropDuplicates([f"{P}key", f"{P}f", f"{P}row"])
    asked = materialize(asked)
    needed = asked.select(f"{P}level", f"{P}block").distinct()
    levels = F.explode(F.array(*[F.struct(F.lit(i).alias("l"), F.col(f"{P}b{i}").alias("b")) for i in range(len(deck.levels))]))
    donors = rows.select("*", levels.alias(f"{P}x")).withColumns({f"{P}level": F.col(f"{P}x.l"), f"{P}block": F.col(f"{P}x.b"), f"{P}f": F.lit(-1)})
    donors = donors.join(needed, [f"{P}level", f"{P}block"], "left_semi").select(*kept)
    block = [f"{P}level", f"{P}block"]
    place = [*block, f"{P}run", f"{P}part", f"{P}chunk"]
    donors = materialize(_runs(materialize(donors.withColumn(f"{P}row", F.lit(0).cast("bigint")))))
    chunks = asked.groupBy(*block).agg(F.ceil(F.count("*") / RUN).alias(f"{P}chunks"))
    asked = asked.join(chunks, block).withColumn(f"{P}chunk", F.pmod(F.xxhash64(f"{P}key", f"{P}row"), f"{P}chunks")).drop(f"{P}chunks")
    asked = asked.join(donors.select(*block, f"{P}run", f"{P}part").distinct(), block)
    donors = donors.join(chunks, block).withColumn(f"{P}chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"{P}chunks") - 1))).drop(f"{P}chunks")
    types = ["string" if t else "double" for t in text]
    near = donors.unionByName(asked).groupBy(*place).applyInPandas(
        _nearest(n, len(deck.numeric), len(deck.categories), scales, [deck.weights.get(f, 1.0) for f in deck.numeric]),
        f"{P}key {key_type}, {P}f int, {P}row bigint, {P}far double, {P}donor {key_type}, " + ", ".join(f"{P}v{i} {t}" for i, t in enumerate(types)),
    )
    best = F.struct(F.col(f"{P}far").alias("far"), F.col(f"{P}donor").alias("donor"), *[F.col(f"{P}v{i}").alias(f"v{i}") for i in range(n)])
    merged = near.groupBy(f"{P}key", f"{P}f", f"{P}row").agg(F.slice(F.sort_array(F.collect_list(best)), 1, K).alias(f"{P}near")).drop(f"{P}row")
    filled = map_batches(merged, _value(text), f"{P}key {key_type}, {P}f int, {P}number double, {P}text string, {P}donor {key_type}")
    wide = filled.groupBy(f"{P}key").agg(*[F.max(F.when(F.col(f"{P}f") == i, F.struct(F.col(f"{P}number"), F.col(f"{P}text"), F.col(f"{P}donor")))).alias(f"{P}r{i}") for i in range(n)])
    out = mark(df, deck).join(wide, F.col(deck.key) == F.col(f"{P}key"), "left")
    for i, f in enumerate(deck.fields):
        got = F.col(f"{P}r{i}")[f"{P}text" if text[i] else f"{P}number"].cast(df.schema[f].dataType)
        missing = F.col(f"{P}m{i}")
        out = out.withColumns({
            f"{f}_state": F.when(~missing, "observed").when(got.isNotNull(), "filled").otherwise("unfilled"),
            f"{f}_donor": F.when(missing, F.col(f"{P}r{i}")[f"{P}donor"]),
            f: F.when(missing, got).otherwise(F.col(f)),
        })
    added = [c for f in deck.fields for c in (f"{f}_state", f"{f}_donor")]
    return out.select(*[c for c in df.columns if c not in added], *added)


# Numbers that only stand for "missing" where no text is that long.
CODES = (99.0, 999.0, 9999.0, 99999.0, 999999.0)


def unusable(field: str, tokens: str = "n_tokens_doc", sentences: str = "n_sentences_doc") -> Column:
    """Whether a sentence measure can't be a measured value in its row.

    Null, not finite and negative values; zero for a length or a depth, and for a deviation if the
    text has more than three sentences; codes of nines beyond the text's tokens. Other large
    values are possible and kept.
    """
    v = F.col(field)
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    zero = (v == 0) & (F.col(sentences) > 3) if field.endswith("_std") else v == 0
    code = v.isin(*CODES) & (v > F.coalesce(F.col(tokens), F.lit(0.0)))
    return ~finite | (v < 0) | F.coalesce(zero, F.lit(False)) | F.coalesce(code, F.lit(False))


def stylometric_deck() -> Deck:
    """The three sentence measures of a stylometric feature table, from rows of the same domain, model or time."""
    fields = ("avg_sentence_length", "sentence_length_std", "max_tree_depth")
    per_sentence = F.col("n_tokens_doc") / F.greatest(F.col("n_sentences_doc"), F.lit(1))

    def category(c: str) -> Column:
        return F.coalesce(F.lower(F.trim(c)), F.lit("?"))

    def usable(f: str) -> Column:
        return F.when(~unusable(f), F.col(f))

    time = F.unix_timestamp(F.col("computed_at").cast("timestamp")) / 86400.0
    size = F.floor(F.log2(F.col("n_tokens_doc") + 1))
    rate = F.floor(F.log2(per_sentence + 1) * 2)
    return Deck(
        key="row_id",
        fields={f: unusable(f) for f in fields},
        numeric={"n_tokens": F.log2(F.col("n_tokens_doc") + 1), "n_sentences": F.log2(F.col("n_sentences_doc") + 1), "per_sentence": per_sentence, "word": F.col("avg_word_length"), "time": time} | {f: usable(f) for f in fields},
        categories={"domain": category("domain"), "model": category("model")},
        levels=((category("domain"), category("model"), size, rate), (category("domain"), size, rate), (size, rate), (size,), ()),
        order=per_sentence,
        weights={"per_sentence": 4.0},
    )
