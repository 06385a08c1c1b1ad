"""Contract tables: documents as sentences, tokens with stand-in annotations, and entities.

Every feature family is an aggregation over these tables, so an annotator of any kind (a neural tagger as well)
can replace a stand-in by filling the table of the same schema. The stand-ins are deterministic
rules written once as SQL expressions that Spark and the oracle share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTENCE = r"[^.!?]+[.!?]*"
TOKEN = r"\p{L}+(?:'\p{L}+)?|\p{N}+|[^\p{L}\p{N}\s]"

# The tags, and closed word classes of English.
POS_TAGS = ("NOUN", "VERB", "ADJ", "ADV", "PRON", "DET", "ADP", "AUX", "CCONJ", "PART", "NUM", "PUNCT", "X")
CONTENT = ("NOUN", "VERB", "ADJ", "ADV", "NUM")
FUNCTION = ("PRON", "DET", "ADP", "AUX", "CCONJ", "PART", "PUNCT", "X")
CLOSED = {
    "DET": "the a an this that these those every each no some any",
    "PRON": "i you he she it we they me him her us them my your his its our their who whom what nobody both mine",
    "ADP": "of in to on at by for with from into over under near above below behind between through during before after past along around across inside outside within upstairs beside",
    "AUX": "is was are were be been being am has have had do does did may might can could will would shall should must",
    "CCONJ": "and or but nor yet",
    "PART": "not n't 's",
}
STOP_WORDS = frozenset(w for words in CLOSED.values() for w in words.split())
PRONOUNS = ("he", "she", "it", "they", "him", "her", "them", "his", "its", "their")


def listed(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def pos_case(token: str = "text", lower: str = "lower") -> str:
    """Part of speech by closed classes, then by shape and suffix."""
    closed = " ".join(f"WHEN {lower} IN ({', '.join(chr(34) + w + chr(34) for w in words.split())}) THEN '{tag}'" for tag, words in CLOSED.items()).replace('"', "\x00")
    closed = closed.replace("n't\x00", "n''t\x00").replace("\x00's\x00", "\x00''s\x00").replace("\x00", "'")
    ends = lambda *s: " OR ".join(f"{lower} LIKE '%{x}'" for x in s)
    return (
        f"CASE WHEN is_punct THEN 'PUNCT' WHEN is_num THEN 'NUM' WHEN NOT is_alpha THEN 'X' {closed} WHEN {ends('ly')} THEN 'ADV' "
        f"WHEN {ends('ed', 'ing', 'ize', 'izes', 'ates', 'ify')} THEN 'VERB' WHEN {ends('ful', 'ous', 'ive', 'able', 'ible', 'al', 'ic', 'less')} THEN 'ADJ' ELSE 'NOUN' END"
    )


def sentences(documents: DataFrame) -> DataFrame:
    """doc_id, sent_idx, sent: trimmed sentences that aren't blank, with their place."""
    split = F.regexp_extract_all("text", F.lit(SENTENCE), F.lit(0))
    return documents.filter("text is not null").select("doc_id", F.posexplode(split).alias("sent_idx", "raw")).select("doc_id", "sent_idx", F.trim(F.regexp_replace("raw", r"^\s+|\s+$", "")).alias("sent")).filter("sent <> ''")


def _flat() -> Column:
    """The tokens of a document in order: sent_idx, at (place in the sentence), text."""
    split = F.filter(F.transform(F.regexp_extract_all("text", F.lit(SENTENCE), F.lit(0)), lambda s, i: F.struct(i.alias("sent_idx"), s.alias("sent"))), lambda x: F.regexp_like(x["sent"], F.lit(r"\S")))
    return F.flatten(F.transform(split, lambda x: F.transform(F.regexp_extract_all(x["sent"], F.lit(TOKEN), F.lit(0)), lambda t, i: F.struct(x["sent_idx"].alias("sent_idx"), i.alias("at"), t.alias("text")))))


def annotated(rows: DataFrame) -> DataFrame:
    """``rows`` with is_alpha, is_num, is_punct, is_stop and pos of their ``text`` and ``lower``."""
    kinds = rows.withColumns({"is_alpha": F.expr(r"text rlike r'^\p{L}'"), "is_num": F.expr(r"text rlike r'^\p{N}'"), "is_punct": F.expr(r"text rlike r'^[^\p{L}\p{N}]'")})
    return kinds.withColumns({"is_stop": F.col("lower").isin(*sorted(STOP_WORDS)), "pos": F.expr(pos_case())})


def tokens(documents: DataFrame) -> DataFrame:
    """doc_id, sent_idx, tok_idx, text, lower, is_alpha, is_num, is_punct, is_stop, pos.

    Sentences and tokens are built as nested arrays in the row of the document and exploded once,
    so numbering needs no shuffle.
    """
    rows = documents.filter("text is not null").select("doc_id", F.posexplode(_flat()).alias("tok_idx", "x")).select("doc_id", F.col("x.sent_idx").alias("sent_idx"), "tok_idx", F.col("x.text").alias("text"), F.lower("x.text").alias("lower"))
    return annotated(rows)


def words_of(documents: DataFrame) -> DataFrame:
    """doc_id, own: the words of each document in its row, as tok_idx, sent_idx and lower."""
    flat = documents.filter("text is not null").select("doc_id", F.transform(_flat(), lambda x, i: F.struct(i.alias("tok_idx"), x["sent_idx"].alias("sent_idx"), F.lower(x["text"]).alias("lower"), x["text"].alias("text"))).alias("own"))
    words = F.filter("own", lambda x: F.regexp_like(x["text"], F.lit(r"^\p{L}")))
    return flat.select("doc_id", F.transform(words, lambda x: F.struct(x["tok_idx"].alias("tok_idx"), x["sent_idx"].alias("sent_idx"), x["lower"].alias("lower"))).alias("own"))


def lowered() -> Column:
    """The tokens of a document in order, for its row: lower, n (the length of the token's text); null without a text."""
    return F.transform(_flat(), lambda x: F.struct(F.lower(x["text"]).alias("lower"), F.length(x["text"]).alias("n")))


def spots(documents: DataFrame) -> DataFrame:
    """doc_id, sent_idx, tok_idx, lower, is_name, is_pronoun, before (the text of the token before it), doc_tokens: names and pronouns.

    The token before is found in the row of the document, so tokens are neither shuffled nor joined. Names are the entities.
    An inner explode would get a filter by the array's size, which cuts the text once more.
    """
    flat = documents.filter("text is not null").select("doc_id", _flat().alias("own"))
    none = F.array(F.struct(F.lit(None).cast("int").alias("sent_idx"), F.lit(None).cast("int").alias("at"), F.lit(None).cast("string").alias("text")))
    both = F.zip_with("own", F.concat(none, "own"), lambda x, y: F.struct(x["sent_idx"].alias("sent_idx"), x["at"].alias("at"), x["text"].alias("text"), y["text"].alias("before")))
    rows = flat.select("doc_id", F.size("own").alias("doc_tokens"), F.posexplode_outer(both).alias("tok_idx", "x")).select("doc_id", "doc_tokens", "x.sent_idx", "x.at", "tok_idx", "x.text", F.lower("x.text").alias("lower"), "x.before").filter("text is not null")
    name = F.expr("at > 0 AND lower <> text AND length(text) > 2 AND is_alpha AND NOT is_stop")
    return annotated(rows).select("doc_id", "sent_idx", "tok_idx", "lower", name.alias("is_name"), F.col("lower").isin(*PRONOUNS).alias("is_pronoun"), "before", "doc_tokens").filter("is_name OR is_pronoun")


def oracle(*names: str) -> tuple[str, ...]:
    """The same tables as CTEs of the oracle's SQL, in order."""
    parts = {
        "sents": (
            f"""sents AS (SELECT doc_id, x.i AS sent_idx, trim(regexp_replace(x.s, '^\\s+|\\s+$', '', 'g')) AS sent FROM (
            SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '{SENTENCE}'), lambda s, i: {{'i': i - 1, 's': s}})) AS x FROM documents WHERE text IS NOT NULL) AS q
            WHERE regexp_matches(x.s, '\\S'))""",
        ),
        "tokens": (
            f"""tok0 AS (SELECT doc_id, sent_idx, unnest(list_transform(regexp_extract_all(sent, '{TOKEN.replace("'", "''")}'), lambda s, i: {{'i': i, 's': s}})) AS y FROM sents)""",
            r"""tok1 AS (SELECT doc_id, sent_idx, row_number() OVER (PARTITION BY doc_id ORDER BY sent_idx, y.i) - 1 AS tok_idx, y.s AS text, lower(y.s) AS lower,
            regexp_matches(y.s, '^\p{L}') AS is_alpha, regexp_matches(y.s, '^\p{N}') AS is_num, regexp_matches(y.s, '^[^\p{L}\p{N}]') AS is_punct FROM tok0)""".replace("\\\\", "\\"),
            f"""tokens AS (SELECT *, lower IN ({listed(sorted(STOP_WORDS))}) AS is_stop, {pos_case()} AS pos FROM tok1)""",
        ),
        "entities": ("entities AS (" + ENTITIES_SQL + ")",),
    }
    return tuple(cte for n in names for cte in parts[n])


#: Capitalised words that don't begin a sentence stand in for named entities.
ENTITIES_SQL = """SELECT doc_id, sent_idx, tok_idx, lower AS entity FROM (
  SELECT *, min(tok_idx) OVER (PARTITION BY doc_id, sent_idx) AS first_tok FROM tokens) AS e
WHERE is_alpha AND tok_idx > first_tok AND lower <> text AND length(text) > 2 AND NOT is_stop"""


def entities(tokens: DataFrame) -> DataFrame:
    """doc_id, sent_idx, tok_idx, entity."""
    return tokens.sparkSession.sql(ENTITIES_SQL.replace("FROM tokens", "FROM {tokens}"), tokens=tokens)


def entities_of(documents: DataFrame) -> DataFrame:
    """The same from documents, without a shuffle."""
    return spots(documents).filter("is_name").select("doc_id", "sent_idx", "tok_idx", F.col("lower").alias("entity"))
