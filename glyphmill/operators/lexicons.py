"""Marker lexicons: nested JSON files flattened to rows, and the probe lexicon of frequent words.

A file holds categories of markers, each with attributes (certainty, allowed parts of speech);
categories may be nested one level deeper. Missing files are skipped with a warning; lookups that no
file fills exist all the same and count nothing, so the schema never depends on the files.
"""

from __future__ import annotations

import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

LOOKUPS = ("transitions", "frame_markers", "code_glosses", "evidentials", "endophoric_markers", "attitude_markers", "engagement_markers", "self_mention", "hedges", "boosters", "epistemic", "personal_epistemic", "reformulation", "weasel")
ATTRIBUTES = ("certainty", "pos", "category", "type", "function")
SCHEMA = "lookup string, category string, marker string, n_words int, certainty double, pos array<string>"

log = logging.getLogger(__name__)


def flatten(lookup: str, content: dict, category: str = "") -> list[tuple]:
    """Rows of one file's content; a dict is a marker if its first value is plain or one of its keys is an attribute."""
    rows = []
    for name, value in content.items():
        if name.startswith("_") or not isinstance(value, dict):
            continue
        if any(a in value for a in ATTRIBUTES):
            marker = name.lower()
            certainty = value.get("certainty")
            rows.append((lookup, category, marker, len(marker.split()), float(certainty) if isinstance(certainty, (int, float)) else None, list(value["pos"]) if isinstance(value.get("pos"), list) else None))
        else:
            rows += flatten(lookup, value, name)
    return rows


def load(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """Lexicon rows of JSON files by lookup name."""
    rows = []
    for lookup, path in files.items():
        if not Path(path).exists():
            log.warning("lexicon %s is missing: %s", lookup, path)
            continue
        rows += flatten(lookup, json.loads(Path(path).read_text(encoding="utf-8")))
    return spark.createDataFrame(rows, SCHEMA)


def term_set(lexicon: DataFrame, pos: str | None = None) -> DataFrame:
    """Distinct markers, of one part of speech if named."""
    from pyspark.sql import functions as F

    return (lexicon.filter(F.array_contains("pos", pos)) if pos else lexicon).select("marker").distinct()


# A probe lexicon of words frequent in any English text (lookup, marker, certainty, parts of speech).
PROBE = (
    ("transitions", "however", None, None), ("transitions", "as a result", None, None), ("transitions", "and", None, "CCONJ"), ("transitions", "in addition", None, None),
    ("frame_markers", "at first", None, None), ("frame_markers", "finally", None, "ADV"), ("frame_markers", "in short", None, None),
    ("code_glosses", "for instance", None, None), ("code_glosses", "in practice", None, None),
    ("evidentials", "evidence suggests", None, None), ("evidentials", "most would agree", None, None),
    ("endophoric_markers", "above", None, "ADP"), ("endophoric_markers", "below", None, "ADP"),
    ("attitude_markers", "even so", None, None), ("attitude_markers", "simply", None, "ADV"),
    ("engagement_markers", "look at", None, None), ("engagement_markers", "why", None, None),
    ("self_mention", "i", None, None), ("self_mention", "we", None, None), ("self_mention", "my", None, None),
    ("hedges", "almost", 0.4, "ADV"), ("hedges", "perhaps", 0.3, None), ("hedges", "it may be", 0.35, None), ("hedges", "about", 0.5, "ADP"),
    ("boosters", "truly", 0.95, "ADV"), ("boosters", "there is little doubt", 0.9, None), ("boosters", "clearly", None, "ADV"), ("boosters", "inevitably", 0.9, None),
    ("epistemic", "it seems", 0.5, None), ("epistemic", "it appears", 0.55, None), ("epistemic", "suspect", None, "NOUN"),
    ("personal_epistemic", "i suspect", None, None), ("personal_epistemic", "we believe", None, None),
    ("reformulation", "in other words", None, None), ("reformulation", "by contrast", None, None),
    ("weasel", "some claim", None, None), ("weasel", "one could argue", None, None), ("weasel", "often", None, "ADV"),
)


def probe_sql() -> str:
    """The probe lexicon as SQL rows: lookup, marker, n_words, certainty, pos."""
    text = lambda x: "CAST(NULL AS VARCHAR(20))" if x is None else f"'{x}'"
    number = lambda x: "CAST(NULL AS DOUBLE)" if x is None else f"CAST({x} AS DOUBLE)"
    return " UNION ALL ".join(f"SELECT '{k}' AS lookup, '{m}' AS marker, {len(m.split())} AS n_words, {number(c)} AS certainty, {text(p)} AS pos" for k, m, c, p in PROBE)


def probe(spark: SparkSession) -> DataFrame:
    return spark.sql(probe_sql().replace("VARCHAR(20)", "STRING"))
