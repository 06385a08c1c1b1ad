"""Cut-off texts once more, for an engine without look-around: words are numbered rows and trigrams a window over them."""

from __future__ import annotations

from glyphmill.llm import truncation as T


def _s(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_BREAK, _ON = "chr(1)", "chr(2)"
_NO_WORD = T.NO_WORD.replace(r"\x01\x02", "\x01\x02")


def _last(x: str, by: str) -> str:
    return f"list_last(string_split({x}, {by}))"


_EVIDENCE = ", ".join(f"coalesce(p{k}.n_in, 0) AS in{k}, coalesce(p{k}.n_stop, 0) AS stop{k}, coalesce(p{k}.n_end, 0) AS end{k}" for k in (3, 2, 1))
_OTHERS = ", ".join(f"(greatest(end{k} - 1, 0) < {T.RARELY} * (in{k} + stop{k} + greatest(end{k} - 1, 0))) AS bare{k}, (stop{k} < {T.RARELY} * (in{k} + stop{k})) AS rare{k}, in{k} + stop{k} >= {T.SEEN} AS seen{k}" for k in (3, 2, 1))

JUDGED = f"""
WITH records AS (SELECT 'generations' AS rec_table, CAST(id AS VARCHAR) AS rec_id, source, generation AS raw FROM generations UNION ALL SELECT 'split_texts', CAST(id AS VARCHAR), source, text FROM split_texts),
latin AS MATERIALIZED (SELECT rec_table, rec_id, source, CASE WHEN regexp_matches(raw, {_s(T.NOT_ASCII)}) THEN translate(regexp_replace(raw, {_s(T.UNSEEN)}, '', 'g'), '{T.LETTERS_FROM}', '{T.LETTERS_TO}') ELSE raw END AS t FROM records WHERE raw IS NOT NULL),
body AS MATERIALIZED (SELECT rec_table, rec_id, source, rtrim(CASE WHEN contains(t, '<') OR contains(t, '&') THEN regexp_replace(regexp_replace(t, {_s(T.TAG)}, ' ', 'g'), {_s(T.CUT_ENTITY)}, '') ELSE t END, ' ' || chr(9) || chr(10) || chr(13)) AS body FROM latin),
core AS MATERIALIZED (SELECT *, CASE WHEN body LIKE '%..' OR right(body, 1) IN ('…', ')', ']', '�') THEN regexp_replace(body, {_s(T.SIGN)}, '') ELSE body END AS core FROM body WHERE regexp_matches(body, {_s(T.ALNUM)})),
lined AS MATERIALIZED (SELECT *, {_last('core', 'chr(10)')} AS line, {_last(_last(_last('core', 'chr(10)'), "' '"), 'chr(9)')} AS last_word, array_to_string(string_split(core, chr(10))[-3:], chr(10)) AS last_lines FROM core),
ending AS MATERIALIZED (
  SELECT rec_table, rec_id, source, core, line, last_word, last_lines,
    CASE WHEN core = body THEN 'none' WHEN regexp_matches(body, {_s(T.EXPLICIT)}) OR regexp_matches(core, '[,;:(]$') THEN 'explicit' ELSE 'dots' END AS sign,
    CASE WHEN regexp_matches(last_word, {_s(T.STOP)}) THEN 1 WHEN regexp_matches(last_word, {_s(T.SMILEY)}) THEN 0 WHEN regexp_matches(last_word, {_s(T.BARE)}) OR regexp_matches(last_word, {_s(T.OPEN)}) THEN 2 ELSE 0 END AS ending
  FROM lined),
said AS MATERIALIZED (
  SELECT rec_table, rec_id, source, sign, ending,
    ending = 0 OR (ending = 2 AND sign = 'none' AND (regexp_matches(line, {_s(T.ENTRY)}) OR regexp_matches(last_word, {_s(T.LINK)}) OR regexp_matches(last_lines, {_s(T.GREETING)}))) AS closing,
    contains(core, chr(10)) AND regexp_matches(line, {_s(T.FEW_WORDS)}) AS own_line,
    list_filter(string_split(replace(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(core, {_s(T.EMPTY_LINE)}, {_BREAK}, 'g'), {_s(T.BREAK)}, {_BREAK} || '\\1', 'g'), {_s(T.GOES_ON)}, {_ON} || '\\1', 'g')), {_s(_NO_WORD)}, ' ', 'g'), {_BREAK}, ' . '), ' '), lambda w: w <> '') AS tokens
  FROM ending),
numbered AS (SELECT row_number() OVER () AS t, tokens, mark FROM (SELECT DISTINCT tokens, CASE WHEN ending = 1 THEN '.' WHEN closing THEN '!' ELSE '$' END AS mark FROM said WHERE len(tokens) > 1)),
placed AS (SELECT t, unnest(list_append(tokens, mark)) AS w, generate_subscripts(list_append(tokens, mark), 1) AS i FROM numbered),
sentences AS (SELECT t, i, w, count(*) FILTER (WHERE w = '.') OVER (PARTITION BY t ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM placed),
windowed AS (
  SELECT w, coalesce(lag(w, 2) OVER per, '^') || ' ' || coalesce(lag(w) OVER per, '^') || ' ' || w AS gram, lead(w) OVER per AS next
  FROM sentences WINDOW per AS (PARTITION BY t, s ORDER BY i)),
grams AS MATERIALIZED (SELECT gram, CASE WHEN next IN ('.', '$', '!') THEN next ELSE '' END AS next, count(*) AS n FROM windowed WHERE w NOT IN ('.', '$', '!') GROUP BY ALL),
parts AS MATERIALIZED (
  SELECT part, coalesce(sum(n) FILTER (WHERE next = ''), 0) AS n_in, coalesce(sum(n) FILTER (WHERE next = '.'), 0) AS n_stop, coalesce(sum(n) FILTER (WHERE next = '$'), 0) AS n_end
  FROM (SELECT gram AS part, next, n FROM grams UNION ALL SELECT split_part(gram, ' ', 2) || ' ' || split_part(gram, ' ', 3), next, n FROM grams UNION ALL SELECT split_part(gram, ' ', 3), next, n FROM grams) GROUP BY part),
vocabulary AS (SELECT replace(part, {_ON}, '') AS word, sum(CASE WHEN contains(part, {_ON}) THEN n_in + n_stop ELSE 0 END) AS n_dot, sum(n_stop) AS n_stop, sum(n_in + n_stop) AS n_known FROM parts WHERE NOT contains(part, ' ') GROUP BY 1),
begins AS (SELECT left(word, k) AS begin, sum(n_known) AS n_longer FROM (SELECT word, n_known, unnest(range(1, length(word))) AS k FROM vocabulary) GROUP BY 1),
finals AS (SELECT rec_table, rec_id, source, sign, own_line, string_split('^ ^ ' || list_last(string_split('. ' || array_to_string(tokens, ' '), '. ')), ' ') AS sentence, string_split(list_last(string_split(replace(array_to_string(tokens, ' '), {_ON}, ' .'), '. ')), ' ') AS clause
  FROM said WHERE ending = 2 AND NOT closing AND len(tokens) > 1),
asked AS (SELECT *, sentence[-3] || ' ' || sentence[-2] || ' ' || sentence[-1] AS gram, sentence[-2] || ' ' || sentence[-1] AS pair, sentence[-1] AS word, len(clause) <= {T.SHORT} AS short FROM finals),
evidence AS (SELECT a.*, {_EVIDENCE}, coalesce(b.n_longer, 0) AS longer FROM asked a LEFT JOIN parts p3 ON p3.part = a.gram LEFT JOIN parts p2 ON p2.part = a.pair LEFT JOIN parts p1 ON p1.part = a.word LEFT JOIN begins b ON b.begin = a.word),
ratios AS (SELECT *, {_OTHERS}, end1 + in1 + stop1 < {T.FRAGMENT} * longer AS fragment FROM evidence),
judged AS (
  SELECT rec_table, rec_id, source,
    CASE WHEN sign = 'dots' THEN fragment OR (CASE WHEN seen3 THEN rare3 WHEN seen2 THEN rare2 WHEN seen1 THEN rare1 ELSE true END)
      WHEN sign = 'none' AND short AND NOT fragment AND end3 >= {T.CLOSING_TEXTS} AND NOT bare3 THEN false
      WHEN fragment OR (seen3 AND bare3) THEN true WHEN sign = 'explicit' THEN NOT seen3 WHEN seen2 THEN bare2
      WHEN sign = 'none' AND own_line THEN false WHEN seen1 THEN bare1 ELSE true END AS cut
  FROM ratios
  UNION ALL
  SELECT rec_table, rec_id, source, true FROM said WHERE ending = 1 AND len(tokens) > 1 AND tokens[-1] IN (SELECT word FROM vocabulary WHERE n_dot >= {T.ABBREVIATION} AND n_dot >= 5 * n_stop))
"""

FOUND = JUDGED + "SELECT DISTINCT rec_table, rec_id FROM judged WHERE cut"
REPORT = (
    JUDGED
    + """SELECT a.rec_table, a.source, a.n_records, coalesce(b.n_cut, 0) AS n_cut, round(coalesce(b.n_cut, 0) / CAST(a.n_records AS DOUBLE), 6) AS cut_share
FROM (SELECT rec_table, source, count(DISTINCT rec_id) AS n_records FROM said GROUP BY ALL) AS a
LEFT JOIN (SELECT rec_table, source, count(DISTINCT rec_id) AS n_cut FROM judged WHERE cut GROUP BY ALL) AS b ON a.rec_table = b.rec_table AND a.source IS NOT DISTINCT FROM b.source"""
)
