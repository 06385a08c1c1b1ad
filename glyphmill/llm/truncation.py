r"""Texts that stop inside a word or a sentence, in pure SQL.

Every text is cut into words and sentences. Each word's trigram (over starts of sentences with ``^`` in place of missing
words) is counted by what follows it: another word of the sentence, the end of the sentence, or the bare end of
a text. The trigram at the end of each text is joined to these counts, then its bigram, then its last word, where
the longer one is hardly known. A text without the end of a sentence is cut if what it ends with is frequent inside texts and
almost never a bare end (followed by dots: almost never the end of a sentence). Words that nobody else has count as the
start of a longer word if there are such. A full stop is no end if its word almost always goes on after it.

What texts are complete with is told apart in two ways: by form (list entry, tag, link, smiley, names under a greeting),
and by the same ratio: a last sentence of up to SHORT words whose trigram ends several texts and is seldom inside
others is a closing line, whatever it says. A text's own end doesn't speak for it. The first are no bare ends in the counts.

Three statements: endings with canonical words (written once, texts are cleaned once), counts of trigrams over all different
texts (equal ones count once, so copies of a cut text don't make its ending look usual), and the decision.

Cases: null and blank texts, and texts of less than two words, are never cut; very long texts are
processed whole, endings are judged on whole last lines; repeated rows are found once; null sources are a source of their
own in the report; empty tables give no rows; other columns are ignored. ``truncation_oracle`` says the same in another engine's SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphmill.llm.words import INVISIBLE, LOOKALIKES
from glyphmill.session import materialize

#: Occurrences from which on a trigram, bigram or word says something, and the share of ends below which it is "almost never" at one.
SEEN, RARELY = 3, 0.12
#: Different texts that a closing line ends, at least, and the words its sentence has at most.
CLOSING_TEXTS, SHORT = 3, 6
#: A word that ends texts this much less often than longer words begin with it is a part of such a word.
FRAGMENT = 0.01
#: Occurrences with a full stop inside sentences from which on a word is an abbreviation.
ABBREVIATION = 3

LETTERS_FROM, LETTERS_TO = "".join(LOOKALIKES), "".join(LOOKALIKES.values())
NOT_ASCII = r"[^\x00-\x7F]"
UNSEEN = f"[{INVISIBLE}]"
TAG = r"</?[A-Za-z][^<>]*>|&(#[0-9]+|#x[0-9A-Fa-f]+|[A-Za-z]{2,8});"
CUT_ENTITY = r"&#?[A-Za-z0-9]*$"
ALNUM = r"[\p{L}\p{N}]"
SIGN = r"(\s*(\[ ?(\.\.\.|…|more|truncated|cut) ?\]|\( ?(\.\.\.|…|more|continued|cont\.?) ?\)|…|\.\.\.+|�|\[\.\.|\.\.))+\s*$"
EXPLICIT = r"(\[ ?(\.\.\.|…|more|truncated|cut) ?\]|\( ?(\.\.\.|…|more|continued|cont\.?) ?\)|�|\[\.\.)\s*$"
# Forms of the last word of a text, and of its last lines.
STOP = r"[.!?][\"'”’»)*_\]]*$"
BARE = r"[\p{L}\p{N}][\"'”’»*_]*$"
OPEN = r"([,;:(/&+=“‘«–—-][\"'”’]*|^[\"']+)$"
SMILEY = r"^([:;=8][-o]?[)(DPp3/|*]|<3+|[xX]D|\^_?\^)$"
LINK = r"^([#@].*|.*://.*|www\..*)$"
ENTRY = r"^\s*([-*•·+>~–—]|\(?\d{1,3}[.)]\s)"
GREETING = r"^\s*\n(\S+\s+){0,4}\S+,\s*\n(\S+\s+){0,5}\S+$"
FEW_WORDS = rf"^\s*(\S+\s+){{0,{SHORT - 1}}}\S+\s*$"
# Sentence ends and abbreviations inside a text.
EMPTY_LINE = r"\n\s*\n"
BREAK = r"[.!?…][^\p{L}\p{N}]+([\p{Lu}\p{Lt}\p{Lm}\p{Lo}])"
GOES_ON = r"\.(\s+[\p{Ll}\p{N}])"
NO_WORD = r"[^\p{L}\p{N}\x01\x02]+"

TABLES = {"generations": ("id", "generation"), "split_texts": ("id", "text")}


def _s(x: str) -> str:
    """``x`` as a raw literal."""
    return "r'" + x.replace("'", "\\x27") + "'"


def endings_sql(tables: dict[str, tuple[str, str]] = TABLES) -> str:
    """rec_table, rec_id, source, sign, ending, closing and canonical words of each record with a word.

    ``ending``: 1 the end of a sentence, 2 a word or an open mark, 0 any other sign. In ``said`` a ``.`` stands for the end of a sentence, and
    a word that goes on after a full stop carries the sign \\x02.
    """
    records = " UNION ALL ".join(f"SELECT '{t}' AS rec_table, CAST({key} AS STRING) AS rec_id, source, {text} AS raw FROM {t}" for t, (key, text) in tables.items())
    once = lambda x: f"explode(array({x}))"  # noqa: E731 - computed here and not again wherever it is used
    return f"""
WITH rec AS ({records}),
plain AS (SELECT rec_table, rec_id, source, {once(f"CASE WHEN raw rlike {_s(NOT_ASCII)} THEN translate(regexp_replace(raw, {_s(UNSEEN)}, ''), '{LETTERS_FROM}', '{LETTERS_TO}') ELSE raw END")} AS plain
  FROM rec WHERE raw IS NOT NULL),
bodies AS (SELECT rec_table, rec_id, source, {once(f"rtrim(' \\t\\r\\n', CASE WHEN contains(plain, '<') OR contains(plain, '&') THEN regexp_replace(regexp_replace(plain, {_s(TAG)}, ' '), {_s(CUT_ENTITY)}, '') ELSE plain END)")} AS body FROM plain),
cores AS (
  SELECT rec_table, rec_id, source, body, {once(f"CASE WHEN endswith(body, '..') OR right(body, 1) IN ('…', ')', ']', '�') THEN regexp_replace(body, {_s(SIGN)}, '') ELSE body END")} AS core
  FROM bodies WHERE body rlike {_s(ALNUM)}),
lasts AS (
  SELECT rec_table, rec_id, source, core, CASE WHEN length(core) = length(body) THEN 'none' WHEN body rlike {_s(EXPLICIT)} OR core rlike '[,;:(]$' THEN 'explicit' ELSE 'dots' END AS sign,
    {once("substring_index(core, chr(10), -1)")} AS line, {once("substring_index(substring_index(substring_index(core, chr(10), -1), ' ', -1), chr(9), -1)")} AS last_word
  FROM cores),
ends AS (
  SELECT rec_table, rec_id, source, core, sign, line, last_word,
    {once(f"CASE WHEN last_word rlike {_s(STOP)} THEN 1 WHEN last_word rlike {_s(SMILEY)} THEN 0 WHEN last_word rlike {_s(BARE)} OR last_word rlike {_s(OPEN)} THEN 2 ELSE 0 END")} AS ending
  FROM lasts),
marked AS (
  SELECT rec_table, rec_id, source, sign, ending,
    ending = 0 OR (ending = 2 AND sign = 'none' AND (line rlike {_s(ENTRY)} OR last_word rlike {_s(LINK)} OR substring_index(core, chr(10), -3) rlike {_s(GREETING)})) AS closing,
    contains(core, chr(10)) AND line rlike {_s(FEW_WORDS)} AS own_line,
    regexp_replace(regexp_replace(regexp_replace(core, {_s(EMPTY_LINE)}, '\\x01'), {_s(BREAK)}, '\\x01$1'), {_s(GOES_ON)}, '\\x02$1') AS core
  FROM ends)
SELECT rec_table, rec_id, source, sign, ending, closing, own_line,
  regexp_replace(trim(replace(regexp_replace(lower(core), {_s(NO_WORD)}, ' '), '\\x01', ' . ')), '[ ]+', ' ') AS said
FROM marked"""


_FULL = "concat('^ ^ ', replace(said, ' . ', ' . ^ ^ '))"

#: Over ``ends``: gram, what follows it (``.`` the end of a sentence, ``$`` the bare end of a text, else nothing) and how often.
GRAMS = f"""
WITH texts AS (SELECT DISTINCT said, CASE WHEN ending = 1 THEN ' .' WHEN closing THEN ' !' ELSE ' $' END AS mark FROM ends WHERE said LIKE '% %'),
uses AS (SELECT explode(regexp_extract_all(concat({_FULL}, mark), {_s(r'(?<![^ ])(?=([^ .]+ [^ .]+ [^ .$!^]+ [.$!]?))')}, 1)) AS u FROM texts),
counted AS (SELECT u, count(*) AS n FROM uses GROUP BY u)
SELECT substring_index(u, ' ', 3) AS gram, substring_index(u, ' ', -1) AS next, n FROM counted"""

#: Over ``ends`` and ``grams``: rec_table, rec_id, source and whether the record is cut, for all that don't plainly end a sentence.
JUDGED = f"""
WITH words AS (
  SELECT replace(substring_index(gram, ' ', -1), '\\x02', '') AS word, sum(CASE WHEN gram LIKE '%\\x02' THEN n ELSE 0 END) AS n_dot, sum(CASE WHEN next = '.' THEN n ELSE 0 END) AS n_stop,
    sum(CASE WHEN next IN ('', '.') THEN n ELSE 0 END) AS n_known
  FROM grams GROUP BY replace(substring_index(gram, ' ', -1), '\\x02', '')),
abbreviations AS (SELECT word FROM words WHERE n_dot >= {ABBREVIATION} AND n_dot >= 5 * n_stop),
longer AS (SELECT left(word, k) AS begin, sum(n_known) AS n_longer FROM (SELECT word, n_known, explode(sequence(1, length(word) - 1)) AS k FROM words WHERE length(word) > 1) AS x GROUP BY left(word, k)),
finals AS (
  SELECT rec_table, rec_id, source, sign, own_line, substring_index({_FULL}, ' ', -3) AS gram, size(split(substring_index(replace(said, '\\x02', ' .'), '. ', -1), ' ')) <= {SHORT} AS short
  FROM ends WHERE ending = 2 AND NOT closing AND said LIKE '% %'),
wanted AS (SELECT DISTINCT gram, substring_index(gram, ' ', -2) AS pair, substring_index(gram, ' ', -1) AS word FROM finals),
parts AS (SELECT part, sum(CASE WHEN next = '' THEN n ELSE 0 END) AS n_in, sum(CASE WHEN next = '.' THEN n ELSE 0 END) AS n_stop, sum(CASE WHEN next = '$' THEN n ELSE 0 END) AS n_end
  FROM (SELECT explode(array(gram, substring_index(gram, ' ', -2), substring_index(gram, ' ', -1))) AS part, next, n FROM grams) AS x GROUP BY part),
leveled AS (
  SELECT w.gram, w.level, p.n_in, p.n_stop, p.n_end, l.n_longer
  FROM (SELECT gram, explode(map(3, gram, 2, pair, 1, word)) AS (level, part) FROM wanted) AS w LEFT JOIN parts AS p ON w.part = p.part LEFT JOIN longer AS l ON w.part = l.begin),
known AS (
  SELECT gram, {', '.join(f"max(CASE WHEN level = {k} THEN {c} ELSE 0 END) AS {c[2:]}{k}" for k in (3, 2, 1) for c in ('n_in', 'n_stop', 'n_end'))}, max(CASE WHEN level = 1 THEN n_longer ELSE 0 END) AS longer
  FROM leveled GROUP BY gram),
others AS (SELECT *, {', '.join(f"greatest(end{k} - 1, 0) AS others{k}" for k in (3, 2, 1))} FROM known),
ratios AS (
  SELECT gram, in3, stop3, in2, stop2, in1, stop1, end3,
    in3 + stop3 >= {SEEN} AS seen3, in2 + stop2 >= {SEEN} AS seen2, in1 + stop1 >= {SEEN} AS seen1,
    others3 < {RARELY} * (in3 + stop3 + others3) AS bare3, others2 < {RARELY} * (in2 + stop2 + others2) AS bare2, others1 < {RARELY} * (in1 + stop1 + others1) AS bare1,
    stop3 < {RARELY} * (in3 + stop3) AS rare3, stop2 < {RARELY} * (in2 + stop2) AS rare2, stop1 < {RARELY} * (in1 + stop1) AS rare1,
    end1 + in1 + stop1 < {FRAGMENT} * longer AS fragment
  FROM others)
SELECT rec_table, rec_id, source,
  CASE
    WHEN sign = 'dots' THEN CASE WHEN fragment THEN true WHEN seen3 THEN rare3 WHEN seen2 THEN rare2 WHEN seen1 THEN rare1 ELSE true END
    WHEN sign = 'none' AND short AND NOT fragment AND end3 >= {CLOSING_TEXTS} AND NOT bare3 THEN false
    WHEN fragment OR seen3 AND bare3 THEN true
    WHEN sign = 'explicit' THEN NOT seen3
    WHEN seen2 THEN bare2
    WHEN sign = 'none' AND own_line THEN false
    WHEN seen1 THEN bare1
    ELSE true END AS cut
FROM finals JOIN ratios USING (gram)
UNION ALL
SELECT rec_table, rec_id, source, true AS cut FROM ends JOIN abbreviations ON substring_index(said, ' ', -1) = word WHERE ending = 1 AND said LIKE '% %'"""

#: For each table and source: records with text, cut ones, and their share.
REPORT = """
WITH a AS (SELECT rec_table, source, count(DISTINCT rec_id) AS n_records FROM ends GROUP BY rec_table, source),
b AS (SELECT rec_table, source, count(DISTINCT rec_id) AS n_cut FROM judged WHERE cut GROUP BY rec_table, source)
SELECT a.rec_table, a.source, a.n_records, coalesce(b.n_cut, 0) AS n_cut, round(coalesce(b.n_cut, 0) / CAST(a.n_records AS DOUBLE), 6) AS cut_share
FROM a LEFT JOIN b ON a.rec_table = b.rec_table AND a.source IS NOT DISTINCT FROM b.source"""


def _run(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """``sql`` over the named tables."""
    sql = sql.replace("{", "{{").replace("}", "}}")
    for name in tables:
        for follows in (" ", ")", "\n"):
            for word in ("FROM", "JOIN"):
                sql = sql.replace(f" {word} {name}{follows}", f" {word} {{{name}}}{follows}")
    return spark.sql(sql + " ", **tables)


def judged(sources: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Records with a word, and those among them that don't plainly end a sentence with whether they are cut."""
    spark = next(iter(sources.values())).sparkSession
    ends = materialize(_run(spark, endings_sql({t: TABLES[t] for t in sources}) + " ", **sources))
    grams = materialize(_run(spark, GRAMS, ends=ends))
    return ends, _run(spark, JUDGED, ends=ends, grams=grams)


def found(sources: dict[str, DataFrame]) -> DataFrame:
    """rec_table and rec_id of the cut records; ``sources`` by the names of TABLES."""
    return judged(sources)[1].filter("cut").select("rec_table", "rec_id").distinct()


def report(sources: dict[str, DataFrame]) -> DataFrame:
    ends, cut = judged(sources)
    return _run(ends.sparkSession, REPORT, ends=ends, judged=cut)
