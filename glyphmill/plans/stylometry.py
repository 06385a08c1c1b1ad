"""Stylometric features over the token table: lexical, character, punctuation, part-of-speech and syntax columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import text as T
from glyphmill.operators.contracts import CONTENT, FUNCTION, POS_TAGS, listed
from glyphmill.plans.portable import query
from glyphmill.session import read_table

#: Words at the start of a text that n-gram and vocabulary measures look at.
NGRAM_WINDOW = 500
LEAST_NGRAMS = 100
SYLLABLES = "greatest(1, length(regexp_replace(regexp_replace(lower, '[aeiouy]+', '#'{g}), '[^#]', ''{g})) - CASE WHEN lower LIKE '%e' AND NOT lower LIKE '%le' THEN 1 ELSE 0 END)"

SQL: dict[str, tuple[str, tuple[str, ...]]] = {}

SQL["lexical_counts"] = ("""
WITH per AS (SELECT doc_id, sent_idx, sum(CASE WHEN is_alpha THEN 1 ELSE 0 END) AS alpha, count(*) AS toks FROM tokens GROUP BY doc_id, sent_idx),
s AS (SELECT doc_id, count(*) AS n_sentences_doc, avg(alpha) AS avg_sentence_length, avg(toks) AS tokens_per_sentence_mean, CASE WHEN count(*) > 1 THEN stddev_pop(toks) ELSE 0 END AS sentence_length_std FROM per GROUP BY doc_id),
w AS (SELECT doc_id, sum(CASE WHEN is_alpha THEN 1 ELSE 0 END) AS n_tokens_doc, avg(CASE WHEN is_alpha THEN length(text) END) AS avg_word_length,
  count(DISTINCT CASE WHEN is_alpha THEN lower END) AS types, sum(CASE WHEN is_alpha AND is_stop THEN 1 ELSE 0 END) AS stops,
  sum(CASE WHEN is_punct THEN length(text) ELSE 0 END) AS punct_chars, sum(length(text)) AS chars FROM tokens GROUP BY doc_id)
SELECT w.doc_id, CAST(n_tokens_doc AS BIGINT) AS n_tokens_doc, CAST(n_sentences_doc AS BIGINT) AS n_sentences_doc, round(avg_sentence_length, 6) AS avg_sentence_length,
  round(CAST(sentence_length_std AS DOUBLE), 6) AS sentence_length_std, round(avg_word_length, 6) AS avg_word_length, round(CAST(types AS DOUBLE) / NULLIF(n_tokens_doc, 0), 6) AS type_token_ratio,
  round(CAST(stops AS DOUBLE) / NULLIF(n_tokens_doc, 0), 6) AS stopword_ratio, round(CAST(punct_chars AS DOUBLE) / NULLIF(chars, 0), 6) AS punctuation_ratio, round(tokens_per_sentence_mean, 6) AS tokens_per_sentence_mean
FROM w JOIN s ON w.doc_id = s.doc_id""", ("tokens",))

READABILITY = """
WITH w AS (SELECT doc_id, count(DISTINCT sent_idx) AS s, CAST(sum(CASE WHEN is_alpha THEN 1 ELSE 0 END) AS DOUBLE) AS n,
  sum(CASE WHEN is_alpha THEN {syl} ELSE 0 END) AS syl, CAST(sum(CASE WHEN is_alpha AND {syl} >= 3 THEN 1 ELSE 0 END) AS DOUBLE) AS poly,
  sum(CASE WHEN is_alpha OR is_num THEN length(text) ELSE 0 END) AS chars FROM tokens GROUP BY doc_id)
SELECT doc_id, CASE WHEN n >= 100 AND s >= 3 THEN round(206.835e0 - 1.015e0 * (n / s) - 84.6e0 * (syl / n), 6) END AS flesch_reading_ease,
  CASE WHEN n >= 100 AND s >= 3 THEN round(0.4e0 * (n / s + 100 * poly / n), 6) END AS gunning_fog,
  CASE WHEN n >= 100 AND s >= 3 AND poly > 0 THEN round(1.043e0 * sqrt(30 * poly / s) + 3.1291e0, 6) END AS smog_index,
  CASE WHEN n >= 100 AND s >= 3 THEN round(4.71e0 * (chars / n) + 0.5e0 * (n / s) - 21.43e0, 6) END AS automated_readability_index FROM w"""

SQL["ngram_statistics"] = (f"""
WITH t AS (SELECT doc_id, lower, row_number() OVER (PARTITION BY doc_id ORDER BY tok_idx) AS rn FROM tokens WHERE is_alpha),
g AS (SELECT doc_id, lower AS a, lead(lower, 1) OVER (PARTITION BY doc_id ORDER BY rn) AS b, lead(lower, 2) OVER (PARTITION BY doc_id ORDER BY rn) AS c FROM t WHERE rn <= {NGRAM_WINDOW}),
u AS (SELECT doc_id, 1 AS k, a AS gram FROM g UNION ALL SELECT doc_id, 2, a || ' ' || b FROM g WHERE b IS NOT NULL UNION ALL SELECT doc_id, 3, a || ' ' || b || ' ' || c FROM g WHERE c IS NOT NULL),
f AS (SELECT doc_id, k, gram, CAST(count(*) AS DOUBLE) AS n FROM u GROUP BY doc_id, k, gram),
h AS (SELECT doc_id, k, sum(n) AS total, count(*) AS types, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS entropy FROM f GROUP BY doc_id, k)
SELECT doc_id, """ + ", ".join(f"max(CASE WHEN k = {k} AND total >= {LEAST_NGRAMS} THEN round(types / total, 6) END) AS {n}gram_diversity, max(CASE WHEN k = {k} AND total >= {LEAST_NGRAMS} THEN round(entropy, 6) END) AS {n}gram_entropy" for k, n in ((1, "uni"), (2, "bi"), (3, "tri"))) + " FROM h GROUP BY doc_id", ("tokens",))

SQL["vocabulary_spectrum"] = (f"""
WITH t AS (SELECT doc_id, lower, row_number() OVER (PARTITION BY doc_id ORDER BY tok_idx) AS rn FROM tokens WHERE is_alpha),
f AS (SELECT doc_id, lower, CAST(count(*) AS DOUBLE) AS n FROM t WHERE rn <= {NGRAM_WINDOW} GROUP BY doc_id, lower),
a AS (SELECT doc_id, lower, CAST(count(*) AS DOUBLE) AS n FROM t GROUP BY doc_id, lower),
b AS (SELECT doc_id, CASE WHEN sum(n) >= 2 AND count(*) >= 2 THEN (stddev_pop(n) - avg(n)) / NULLIF(stddev_pop(n) + avg(n), 0) END AS burst FROM a GROUP BY doc_id),
s AS (SELECT doc_id, sum(n) AS total, count(*) AS types, sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS once, sum(n * n) AS squares FROM f GROUP BY doc_id)
SELECT s.doc_id, round(once / total, 6) AS hapax_legomena_ratio, round(CAST(once AS DOUBLE) / types, 6) AS hapax_type_ratio,
  CASE WHEN total >= 100 THEN round(10000 * (squares - total) / (total * total), 6) END AS yules_k, round(burst, 6) AS token_burstiness
FROM s JOIN b ON s.doc_id = b.doc_id""", ("tokens",))

_MARKS = {"comma": ",", "period": ".", "question": "?", "exclamation": "!", "semicolon": ";", "colon": ":"}
SQL["punctuation_marks"] = ("SELECT doc_id, " + ", ".join(f"round(CAST(sum(CASE WHEN text = '{m}' THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 6) AS {n}_ratio" for n, m in _MARKS.items())
    + ", round(CAST(sum(CASE WHEN text IN ('\"', '“', '”') THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 6) AS quote_ratio FROM tokens GROUP BY doc_id", ("tokens",))

SQL["pos_ratios"] = ("WITH c AS (SELECT doc_id, pos, CAST(count(*) AS DOUBLE) AS n FROM tokens GROUP BY doc_id, pos) SELECT doc_id, "
    + ", ".join(f"round(sum(CASE WHEN pos = '{p}' THEN n ELSE 0 END) / sum(n), 6) AS pos_ratio_{p}" for p in POS_TAGS)
    + ", round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS upos_entropy FROM c GROUP BY doc_id", ("tokens",))

SQL["pos_transitions"] = (f"""
WITH t AS (SELECT doc_id, pos AS a, lead(pos) OVER (PARTITION BY doc_id ORDER BY tok_idx) AS b FROM tokens),
c AS (SELECT doc_id, a, b, CAST(count(*) AS DOUBLE) AS n FROM t WHERE b IS NOT NULL GROUP BY doc_id, a, b),
r AS (SELECT doc_id, a, b, n, sum(n) OVER (PARTITION BY doc_id, a) AS row_n, sum(n) OVER (PARTITION BY doc_id) AS total FROM c)
SELECT doc_id, round(log2(max(total)) - sum(n * log2(n)) / max(total), 6) AS pos_transition_entropy, round(sum(-n / total * log2(n / row_n)), 6) AS pos_row_entropy_weighted,
  round(sum(CASE WHEN a = b THEN n ELSE 0 END) / max(total), 6) AS self_transition_rate,
  round(sum(CASE WHEN a IN ({listed(CONTENT)}) AND b IN ({listed(FUNCTION)}) THEN n ELSE 0 END) / max(total), 6) AS content_to_function_rate,
  round(sum(CASE WHEN a IN ({listed(FUNCTION)}) AND b IN ({listed(CONTENT)}) THEN n ELSE 0 END) / max(total), 6) AS function_to_content_rate,
  round(sum(CASE WHEN (a = 'NOUN' AND b IN ('VERB', 'AUX')) OR (b = 'NOUN' AND a IN ('VERB', 'AUX')) THEN n ELSE 0 END) / max(total), 6) AS noun_verb_alternation_rate
FROM r GROUP BY doc_id""", ("tokens",))

_n = lambda *tags: f"CAST(sum(CASE WHEN pos IN ({listed(tags)}) THEN 1 ELSE 0 END) AS DOUBLE)"
SQL["pos_balance"] = ("SELECT doc_id, " + ", ".join(f"round(coalesce({a} / NULLIF({b}, 0), 0), 6) AS {n}" for n, a, b in (
    ("content_function_ratio", _n(*CONTENT), _n(*FUNCTION)), ("noun_verb_ratio", _n("NOUN"), _n("VERB", "AUX")), ("adj_adv_ratio", _n("ADJ"), _n("ADV"))))
    + ", " + ", ".join(f"round(100 * {_n(*t)} / count(*), 6) AS {n}_per_100" for n, t in (("verbs", ("VERB", "AUX")), ("nouns", ("NOUN",)), ("adj", ("ADJ",)), ("adv", ("ADV",)), ("pron", ("PRON",)), ("punct", ("PUNCT",))))
    + " FROM tokens GROUP BY doc_id", ("tokens",))

SQL["pos_by_sentence"] = (f"""
WITH s AS (SELECT doc_id, sent_idx, {_n('NOUN')} AS nouns, {_n('VERB', 'AUX')} AS verbs, {_n('ADJ')} AS adjs, {_n('ADV')} AS advs, count(DISTINCT pos) AS tags FROM tokens GROUP BY doc_id, sent_idx)
SELECT doc_id, round(avg(nouns), 6) AS mean_nouns_per_sent, round(avg(verbs), 6) AS mean_verbs_per_sent, round(avg(adjs), 6) AS mean_adjs_per_sent, round(avg(advs), 6) AS mean_advs_per_sent,
  round(avg(CASE WHEN verbs > 0 THEN 1.0e0 ELSE 0.0e0 END), 6) AS prop_sents_with_verb, round(avg(tags), 6) AS unique_upos_per_sent_mean FROM s GROUP BY doc_id""", ("tokens",))

SQL["pos_runs"] = ("""
WITH i AS (SELECT doc_id, pos, tok_idx - row_number() OVER (PARTITION BY doc_id, pos ORDER BY tok_idx) AS island FROM tokens),
r AS (SELECT doc_id, pos, island, count(*) AS n FROM i GROUP BY doc_id, pos, island)
SELECT doc_id, CAST(coalesce(max(CASE WHEN pos = 'NOUN' THEN n END), 0) AS BIGINT) AS max_runlen_noun, CAST(coalesce(max(CASE WHEN pos = 'PUNCT' THEN n END), 0) AS BIGINT) AS max_runlen_punct FROM r GROUP BY doc_id""", ("tokens",))

# The head of a token is the nearest verb before it in its sentence, of the first verb and of tokens before it the sentence's first token.
HEADS = """h AS (SELECT doc_id, sent_idx, tok_idx, coalesce(max(CASE WHEN pos IN ('VERB', 'AUX') THEN tok_idx END) OVER (PARTITION BY doc_id, sent_idx ORDER BY tok_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  min(tok_idx) OVER (PARTITION BY doc_id, sent_idx)) AS head_idx, CASE WHEN pos IN ('VERB', 'AUX') THEN 1 ELSE 0 END AS is_verb FROM tokens),
d AS (SELECT *, sum(is_verb) OVER (PARTITION BY doc_id, sent_idx ORDER BY tok_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS verbs_before, min(tok_idx) OVER (PARTITION BY doc_id, sent_idx) AS root FROM h)"""
SQL["dependency_shape"] = (f"""
WITH {HEADS},
s AS (SELECT doc_id, sent_idx, max(CASE WHEN tok_idx = root THEN 0 ELSE 1 + coalesce(verbs_before, 0) END) AS depth, avg(CASE WHEN head_idx <> tok_idx THEN CAST(abs(tok_idx - head_idx) AS DOUBLE) END) AS distance,
  sum(CASE WHEN head_idx <> tok_idx AND tok_idx < head_idx THEN 1 ELSE 0 END) AS lefts, sum(CASE WHEN head_idx <> tok_idx THEN 1 ELSE 0 END) AS deps FROM d GROUP BY doc_id, sent_idx)
SELECT doc_id, round(avg(depth), 6) AS avg_tree_depth, CAST(max(depth) AS BIGINT) AS max_tree_depth, round(coalesce(avg(distance), 0), 6) AS avg_dependency_distance,
  round(coalesce(CAST(sum(lefts) AS DOUBLE) / NULLIF(sum(deps), 0), 0), 6) AS left_dependency_ratio FROM s GROUP BY doc_id""", ("tokens",))

# A small polarity lexicon (word: polarity, subjectivity).
POLARITY = {"good": (0.7, 0.6), "famous": (0.5, 0.8), "kind": (0.6, 0.9), "clever": (0.4, 0.7), "useful": (0.3, 0.2), "gentle": (0.4, 0.6), "sweet": (0.35, 0.65), "bright": (0.5, 0.7), "new": (0.15, 0.45), "modern": (0.2, 0.3), "generous": (0.5, 0.8),
            "bad": (-0.7, 0.7), "broken": (-0.4, 0.4), "sad": (-0.5, 1.0), "cold": (-0.6, 1.0), "noisy": (-0.3, 0.6), "rusty": (-0.25, 0.4), "empty": (-0.1, 0.5), "hidden": (-0.15, 0.3), "loud": (-0.1, 0.8), "dark": (-0.15, 0.4)}
_lexicon = " UNION ALL ".join(f"SELECT '{w}' AS word, CAST({p} AS DOUBLE) AS polarity, CAST({s} AS DOUBLE) AS subjectivity" for w, (p, s) in POLARITY.items())
SQL["sentiment_lexicon"] = (f"""
WITH lex AS ({_lexicon}), t AS (SELECT tk.doc_id, tk.sent_idx, tk.is_alpha, l.polarity, l.subjectivity FROM tokens AS tk LEFT JOIN lex AS l ON l.word = tk.lower),
s AS (SELECT doc_id, sent_idx, coalesce(avg(polarity), 0) AS p FROM t GROUP BY doc_id, sent_idx),
a AS (SELECT doc_id, round(var_pop(p) + 1e-9, 5) AS sentiment_polarity_variance, round(avg(CASE WHEN abs(p) < 0.1 THEN 1.0e0 ELSE 0.0e0 END), 6) AS neutral_sentence_ratio FROM s GROUP BY doc_id),
w AS (SELECT doc_id, round(coalesce(avg(polarity), 0), 6) AS sentiment_polarity, round(coalesce(avg(subjectivity), 0), 6) AS sentiment_subjectivity,
  round(coalesce(CAST(sum(CASE WHEN polarity > 0.1 THEN 1 ELSE 0 END) AS DOUBLE) / NULLIF(sum(CASE WHEN is_alpha THEN 1 ELSE 0 END), 0), 0), 6) AS positive_word_ratio,
  round(coalesce(CAST(sum(CASE WHEN polarity < -0.1 THEN 1 ELSE 0 END) AS DOUBLE) / NULLIF(sum(CASE WHEN is_alpha THEN 1 ELSE 0 END), 0), 0), 6) AS negative_word_ratio FROM t GROUP BY doc_id)
SELECT w.*, a.sentiment_polarity_variance, a.neutral_sentence_ratio FROM w JOIN a ON w.doc_id = a.doc_id""", ("tokens",))

QUERIES, ORACLE = {}, {}
for _name, (_sql, _tables) in SQL.items():
    QUERIES[_name], ORACLE[_name] = query(_name, _sql, _tables)
QUERIES["readability"], ORACLE["readability"] = query("readability", READABILITY.replace("{syl}", SYLLABLES.replace("{g}", ", 'g'")), ("tokens",), READABILITY.replace("{syl}", SYLLABLES.replace("{g}", "")))


def char_trigrams(spark: SparkSession, d: str) -> DataFrame:
    return T.char_trigram_statistics(read_table(spark, d, "documents"))


def char_classes(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").filter("text <> ''").select("doc_id", *T.char_classes("text"))


def zlib_ratio(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", F.round(T.compression_ratio("text"), 6).alias("compression_ratio"))


QUERIES |= {f.__name__: f for f in (char_trigrams, char_classes, zlib_ratio)}
ORACLE["char_trigrams"] = """WITH g AS (SELECT doc_id, unnest(list_transform(range(1, length(text) - 1), lambda i: substring(text, i, 3))) AS gram FROM documents WHERE length(text) >= 3),
f AS (SELECT doc_id, gram, CAST(count(*) AS DOUBLE) AS n FROM g GROUP BY doc_id, gram)
SELECT doc_id, round(count(*) / sum(n), 6) AS char_trigram_diversity, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS char_trigram_entropy FROM f GROUP BY doc_id"""
ORACLE["char_classes"] = r"""SELECT doc_id, round(len(regexp_extract_all(text, '\p{Lu}')) / CAST(length(text) AS DOUBLE), 6) AS uppercase_ratio, round(len(regexp_extract_all(text, '\p{Nd}')) / CAST(length(text) AS DOUBLE), 6) AS digit_ratio,
round(len(regexp_extract_all(text, '\s')) / CAST(length(text) AS DOUBLE), 6) AS whitespace_ratio, CAST(len(list_distinct(string_split(text, ''))) AS BIGINT) AS unique_char_count FROM documents WHERE text <> ''"""
