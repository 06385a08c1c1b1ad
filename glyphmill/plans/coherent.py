"""Coherence and coreference queries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.operators import coherence, contracts, coref
from glyphmill.plans.portable import CONTRACTS, contract, query
from glyphmill.session import materialize, read_table

_PAIRS = """pairs AS (SELECT a.doc, a.i, b.i AS j, list_cosine_similarity(a.v, b.v) AS sim FROM vecs AS a JOIN vecs AS b ON a.doc = b.doc AND a.i < b.i)"""
#: The vectors table stands for sentences: so many that follow each other are a document, the label is the topic.
SENTENCES = 16
_VECS = f"vecs AS (SELECT vec_id // {SENTENCES} AS doc, row_number() OVER (PARTITION BY vec_id // {SENTENCES} ORDER BY vec_id) - 1 AS i, label AS topic, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_vectors = lambda s, d: read_table(s, d, "embeddings").withColumn("doc", F.expr(f"vec_id div {SENTENCES}"))
contract("vector_pairs", lambda s, d: coherence.vector_pairs(_vectors(s, d), "doc", "vec_id", "embedding"), (_VECS, _PAIRS, "vector_pairs AS (SELECT * FROM pairs)"))
contract("neighbours", lambda s, d: coherence.neighbours(_vectors(s, d), "doc", "vec_id", "embedding", "label"), (_VECS, "neighbours AS (SELECT a.doc, a.i, a.topic, b.topic AS next_topic, list_cosine_similarity(a.v, b.v) AS sim FROM vecs AS a JOIN vecs AS b ON a.doc = b.doc AND b.i = a.i + 1)"))
contract("topics", lambda s, d: _vectors(s, d).selectExpr("doc", "vec_id AS place", "label AS topic"), (_VECS, "topics AS (SELECT doc, i AS place, topic FROM vecs)"))
contract("words", lambda s, d: CONTRACTS["sents"][0](s, d).select("doc_id", "sent_idx", F.size(F.split("sent", r"\s+")).alias("ws")), (*contracts.oracle("sents"), r"words AS (SELECT doc_id, sent_idx, len(string_split_regex(sent, '\s+')) AS ws FROM sents)"))
contract("entity_edges", lambda s, d: coherence.entity_edges(CONTRACTS["entities"][0](s, d)), (*contracts.oracle("sents", "tokens", "entities"), "entity_edges AS (SELECT DISTINCT a.doc_id, a.sent_idx AS i, b.sent_idx AS j FROM entities AS a JOIN entities AS b ON a.doc_id = b.doc_id AND a.entity = b.entity AND a.sent_idx < b.sent_idx)"))

SQL: dict[str, tuple[str, tuple[str, ...]]] = {}
SQL["entity_density"] = ("""WITH t AS (SELECT doc_id, sum(ws) AS n, count(*) AS s FROM words GROUP BY doc_id), e AS (SELECT doc_id, count(*) AS m, count(DISTINCT entity) AS u FROM entities GROUP BY doc_id)
SELECT t.doc_id, CASE WHEN s >= 2 THEN round(1000.0e0 * m / n, 6) END AS entity_mention_density, CASE WHEN s >= 2 THEN round((m - u) / CAST(m AS DOUBLE), 6) END AS entity_reuse_rate FROM t LEFT JOIN e ON e.doc_id = t.doc_id""", ("words", "entities"))
SQL["entity_graph"] = ("""WITH n AS (SELECT doc_id, count(*) AS s FROM sents GROUP BY doc_id), g AS (SELECT doc_id, count(*) AS m FROM entity_edges GROUP BY doc_id),
x AS (SELECT doc_id, i AS k FROM entity_edges UNION SELECT doc_id, j FROM entity_edges), c AS (SELECT doc_id, count(*) AS k FROM x GROUP BY doc_id)
SELECT n.doc_id, CASE WHEN s >= 2 THEN round(coalesce(m, 0) / (s * (s - 1) / 2.0e0), 6) END AS entity_graph_density, CASE WHEN s >= 2 THEN round((s - coalesce(k, 0)) / CAST(s AS DOUBLE), 6) END AS entity_isolated_sentences
FROM n LEFT JOIN g ON g.doc_id = n.doc_id LEFT JOIN c ON c.doc_id = n.doc_id""", ("sents", "entity_edges"))
SQL["entity_continuation"] = ("""WITH d AS (SELECT DISTINCT doc_id, sent_idx, entity FROM entities), k AS (SELECT a.doc_id, a.sent_idx, count(*) AS n, count(b.entity) AS shared FROM d AS a LEFT JOIN d AS b ON b.doc_id = a.doc_id AND b.entity = a.entity AND b.sent_idx = a.sent_idx + 1 GROUP BY a.doc_id, a.sent_idx)
SELECT doc_id, round(avg(CAST(shared AS DOUBLE) / n), 6) AS mean_entity_continuation_rate FROM k GROUP BY doc_id""", ("entities",))
SQL["similarity_adjacent"] = ("SELECT doc, round(avg(sim), 5) AS mean_adjacent_cosine_similarity, round(min(sim), 5) AS min_adjacent_cosine_similarity, round(var_pop(sim), 5) AS adjacent_similarity_variance, round(avg(CASE WHEN topic <> next_topic THEN sim END), 5) AS topic_transition_similarity FROM neighbours GROUP BY doc", ("neighbours",))
SQL["similarity_graph"] = (f"""WITH n AS (SELECT doc, max(j) + 1 AS s FROM vector_pairs GROUP BY doc), e AS (SELECT doc, i, j FROM vector_pairs WHERE sim >= {coherence.THRESHOLD}), m AS (SELECT doc, count(*) AS m FROM e GROUP BY doc),
k AS (SELECT doc, count(*) AS k FROM (SELECT doc, i FROM e UNION SELECT doc, j FROM e) AS u GROUP BY doc)
SELECT n.doc, round(coalesce(m, 0) / (s * (s - 1) / 2.0e0), 6) AS semantic_graph_density, round((s - coalesce(k, 0)) / CAST(s AS DOUBLE), 6) AS semantic_graph_isolated_sentences, round(2.0e0 * coalesce(m, 0) / s, 6) AS semantic_average_degree
FROM n LEFT JOIN m ON m.doc = n.doc LEFT JOIN k ON k.doc = n.doc""", ("vector_pairs",))
SQL["similarity_distance"] = ("""WITH g AS (SELECT doc, CAST(j - i AS DOUBLE) AS dist, avg(sim) AS sim FROM vector_pairs GROUP BY doc, j - i), s AS (SELECT doc, covar_pop(sim, dist) / NULLIF(var_pop(dist), 0) AS slope FROM g GROUP BY doc),
l AS (SELECT doc, avg(CASE WHEN j - i IN (2, 3) THEN sim END) AS near, avg(CASE WHEN j - i >= 4 THEN sim END) AS far FROM vector_pairs GROUP BY doc)
SELECT s.doc, round(coalesce(slope, 0), 6) AS similarity_decay_rate, round(near, 5) AS mean_nonadjacent_similarity, round(far, 5) AS long_range_similarity FROM s JOIN l ON l.doc = s.doc""", ("vector_pairs",))
SQL["topic_flow"] = ("""WITH t AS (SELECT doc, topic, row_number() OVER (PARTITION BY doc ORDER BY place) AS p, lag(topic) OVER (PARTITION BY doc ORDER BY place) AS before FROM topics),
f AS (SELECT *, min(p) OVER (PARTITION BY doc, topic) AS first_p FROM t), w AS (SELECT doc, count(*) AS n, sum(CASE WHEN before <> topic THEN 1 ELSE 0 END) AS switches, sum(CASE WHEN before <> topic AND first_p < p THEN 1 ELSE 0 END) AS again FROM f GROUP BY doc)
SELECT doc, CAST(switches AS BIGINT) AS topic_switching_frequency, CASE WHEN n > 1 THEN round(switches / CAST(n - 1 AS DOUBLE), 6) END AS topic_drift_rate, CASE WHEN n > 1 THEN round(CAST(n AS DOUBLE) / (switches + 1), 6) END AS topic_persistence,
  CASE WHEN n < 3 THEN 0 ELSE round(again / CAST(n - 1 AS DOUBLE), 6) END AS topic_return_rate FROM w""", ("topics",))
SQL["topic_spread"] = ("""WITH c AS (SELECT doc, topic, CAST(count(*) AS DOUBLE) AS n FROM topics WHERE topic <> -1 GROUP BY doc, topic), r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY n, topic) AS rk, count(*) OVER (PARTITION BY doc) AS k, sum(n) OVER (PARTITION BY doc) AS total FROM c),
h AS (SELECT doc, max(k) AS k, max(n) / max(total) AS top, -sum(n / total * ln(n / total)) AS entropy, 2 * sum(rk * n) / (max(k) * max(total)) - (max(k) + 1) / CAST(max(k) AS DOUBLE) AS gini FROM r GROUP BY doc)
SELECT doc, CAST(k AS BIGINT) AS num_distinct_topics, round(top, 6) AS dominant_topic_proportion, round(entropy, 6) AS topic_entropy, round(entropy / CASE WHEN k > 1 THEN ln(k) ELSE 1 END, 6) AS topic_diversity, round(least(1, greatest(0, gini)), 6) AS topic_concentration FROM h""", ("topics",))

contract("mentions", lambda s, d: materialize(coref.mentions_of(read_table(s, d, "documents"))), (*contracts.oracle("sents", "tokens"), f"mentions AS ({coref.MENTIONS_SQL})"))
SQL["mention_chains"] = ("""WITH b AS (SELECT *, tok_idx - n_tokens + 1 AS begin FROM mentions), c AS (SELECT doc_id, chain, count(*) AS len, max(sent_idx) - min(sent_idx) AS span, max(begin) - min(begin) AS width FROM b GROUP BY doc_id, chain),
g AS (SELECT doc_id, chain, lead(begin) OVER (PARTITION BY doc_id, chain ORDER BY tok_idx) - begin AS gap FROM b), v AS (SELECT doc_id, chain, stddev_pop(gap) / NULLIF(avg(gap), 0) AS cv FROM g GROUP BY doc_id, chain),
p AS (SELECT doc_id, avg(CASE WHEN is_pronoun THEN 1.0e0 ELSE 0.0e0 END) AS pr FROM mentions GROUP BY doc_id),
a AS (SELECT c.doc_id, avg(CASE WHEN c.len = 2 THEN 1.0e0 ELSE 0.0e0 END) AS minimal, sum(CASE WHEN c.len = 2 THEN 1 ELSE 0 END) AS minimal_n, avg(c.len) AS mean_len, var_pop(c.len) AS var_len, avg(CASE WHEN c.span >= 3 THEN 1.0e0 ELSE 0.0e0 END) AS far,
  avg(least(c.width / CAST(s.n AS DOUBLE), 1.0e0) * CASE WHEN c.len <= 2 THEN 1.0e0 ELSE 1.0e0 / (1.0e0 + coalesce(v.cv, 0)) END) AS conn FROM c JOIN v ON v.doc_id = c.doc_id AND v.chain = c.chain JOIN doc_sizes AS s ON s.doc_id = c.doc_id WHERE c.len >= 2 GROUP BY c.doc_id)
SELECT d.doc_id, round(coalesce(pr, 0), 6) AS pronoun_ratio, round(coalesce(minimal, 0), 6) AS minimal_chain_ratio, CAST(coalesce(minimal_n, 0) AS BIGINT) AS minimal_chain_count, round(coalesce(mean_len, 0), 6) AS avg_chain_length, round(coalesce(var_len, 0), 6) AS chain_length_variance, round(coalesce(far, 0), 6) AS long_range_coref_ratio, round(coalesce(conn, 0), 6) AS chain_connectivity FROM documents AS d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN a ON a.doc_id = d.doc_id""", ("documents", "mentions", "doc_sizes"))
SQL["repeat_mentions"] = ("""WITH m AS (SELECT doc_id, chain, sent_idx, tok_idx, is_pronoun, n_tokens, row_number() OVER w AS k, first_value(n_tokens) OVER w AS first_n, lag(is_pronoun) OVER w AS before_pronoun, lag(sent_idx) OVER w AS before_sent FROM mentions WINDOW w AS (PARTITION BY doc_id, chain ORDER BY tok_idx)),
a AS (SELECT doc_id, sum(CASE WHEN k > 1 THEN 1 ELSE 0 END) AS again, sum(CASE WHEN k > 1 AND n_tokens > first_n THEN 1 ELSE 0 END) AS longer, sum(CASE WHEN k > 1 AND n_tokens > first_n THEN n_tokens - first_n ELSE 0 END) AS added,
  sum(CASE WHEN k > 1 AND n_tokens > first_n AND NOT before_pronoun AND sent_idx - before_sent <= 1 THEN 1 ELSE 0 END) AS over_n, sum(CASE WHEN k = 2 THEN 1 ELSE 0 END) AS second, sum(CASE WHEN k = 2 AND is_pronoun THEN 1 ELSE 0 END) AS second_p, sum(CASE WHEN k > 1 AND NOT is_pronoun THEN 1 ELSE 0 END) AS full_np FROM m GROUP BY doc_id)
SELECT d.doc_id, round(coalesce(CAST(longer AS DOUBLE) / NULLIF(again, 0), 0), 6) AS repeat_mention_expansion_rate, round(coalesce(CAST(added AS DOUBLE) / NULLIF(longer, 0), 0), 6) AS avg_tokens_added_on_repeat, round(coalesce(CAST(over_n AS DOUBLE) / NULLIF(longer, 0), 0), 6) AS repeat_overspecification_ratio,
  round(coalesce(CAST(second_p AS DOUBLE) / NULLIF(second, 0), 0), 6) AS second_mention_pronoun_rate, round(coalesce(CAST(full_np AS DOUBLE) / NULLIF(again, 0), 0), 6) AS full_np_in_repeats_rate FROM documents AS d LEFT JOIN a ON a.doc_id = d.doc_id""", ("documents", "mentions"))
_PARTS = ("adj", "adp", "rel", "compound", "poss")
_SUM = " + ".join(f"n_{p}" for p in _PARTS)
SQL["mention_modifiers"] = ("""WITH x AS (SELECT m.doc_id, m.chain, m.tok_idx, max(CASE WHEN t.pos = 'ADJ' THEN 1 ELSE 0 END) AS adj, max(CASE WHEN t.pos = 'ADP' THEN 1 ELSE 0 END) AS adp, max(CASE WHEN t.lower IN ('who', 'which', 'that') THEN 1 ELSE 0 END) AS rel,
  max(CASE WHEN t.tok_idx = m.tok_idx - 1 AND t.pos = 'NOUN' THEN 1 ELSE 0 END) AS compound, max(CASE WHEN t.tok_idx < m.tok_idx AND t.lower IN ('my', 'your', 'his', 'her', 'its', 'our', 'their') THEN 1 ELSE 0 END) AS poss, sum(CASE WHEN t.pos IN ('ADJ', 'ADP') THEN 1 ELSE 0 END) AS mods
  FROM mentions AS m LEFT JOIN tokens AS t ON t.doc_id = m.doc_id AND t.sent_idx = m.sent_idx AND t.tok_idx BETWEEN m.tok_idx - 2 AND m.tok_idx + 2 WHERE NOT m.is_pronoun GROUP BY m.doc_id, m.chain, m.tok_idx),
a AS (SELECT doc_id, avg(CAST(adj AS DOUBLE)) AS adj, avg(CAST(adp AS DOUBLE)) AS adp, avg(CAST(rel AS DOUBLE)) AS rel, avg(CAST(mods AS DOUBLE)) AS mods, """ + ", ".join(f"CAST(sum({p}) AS DOUBLE) AS n_{p}" for p in _PARTS) + f""" FROM x GROUP BY doc_id)
SELECT d.doc_id, round(coalesce(adj, 0), 6) AS adjective_modification_rate, round(coalesce(adp, 0), 6) AS prepositional_modification_rate, round(coalesce(rel, 0), 6) AS relative_clause_rate, round(coalesce(mods, 0), 6) AS avg_modifiers_per_mention,
  round(CASE WHEN {_SUM} > 0 THEN log2({_SUM}) - ({' + '.join(f'n_{p} * log2(greatest(n_{p}, 1))' for p in _PARTS)}) / ({_SUM}) ELSE 0 END, 6) + 0.0e0 AS modification_type_entropy FROM documents AS d LEFT JOIN a ON a.doc_id = d.doc_id""", ("documents", "mentions", "tokens"))
# Named entities in three windows around every mention: a sentence to both sides, 50 tokens to both sides, and the sentences up to a gap of
# three tokens. Sentences follow each other without a gap here, so the last is the document. Frames count them without pairing mentions.
_X = """WITH g AS (SELECT *, tok_idx - n_tokens + 1 AS begin, tok_idx - n_tokens + 1 - lag(tok_idx + 1) OVER (PARTITION BY doc_id, chain ORDER BY tok_idx) AS gap FROM mentions),
r AS (SELECT doc_id, sent_idx, begin, n_tokens AS tc, CASE WHEN gap IS NULL OR gap > 100 THEN 1.0e0 ELSE 0.0e0 END AS prag, CASE WHEN is_pronoun OR n_tokens > 1 THEN 0 ELSE 1 END AS own, 0 AS e FROM g UNION ALL SELECT doc_id, sent_idx, tok_idx, NULL, NULL, 0, 1 FROM entities),
w AS (SELECT doc_id, tc, prag, own, sum(e) OVER (PARTITION BY doc_id ORDER BY sent_idx RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS ents_micro, CASE WHEN tc = 1 THEN sum(e) OVER (PARTITION BY doc_id ORDER BY begin RANGE BETWEEN 50 PRECEDING AND 50 FOLLOWING)
  ELSE sum(e) OVER (PARTITION BY doc_id ORDER BY begin RANGE BETWEEN 50 PRECEDING AND 51 FOLLOWING) END AS ents_meso, sum(e) OVER (PARTITION BY doc_id) AS ents_macro FROM r),
x AS (SELECT *, ents_micro - own AS comp_micro, ents_meso - own AS comp_meso, ents_macro - own AS comp_macro FROM w WHERE tc IS NOT NULL)"""
_if = lambda c: f"avg(CASE WHEN {c} THEN 1.0e0 ELSE 0.0e0 END)"
_or = lambda x, default=0: f"round(coalesce({x}, {default}), 6)"
SQL["mention_contexts"] = (_X + f""", a AS (SELECT doc_id, avg(comp_meso) AS meso_c, avg(ents_macro) AS macro_e, avg(ents_meso) AS meso_e, avg(comp_micro) AS micro_c, avg(comp_macro) AS macro_c, {_if('comp_micro > 0')} AS need, avg(prag) AS prag, {_if('comp_macro = 0 AND tc > 2')} AS loose,
  {_if('comp_meso > 0 OR prag > 0')} AS agree, avg((tc - 1) / CAST(comp_macro + 1 AS DOUBLE)) AS ratio FROM x GROUP BY doc_id)
SELECT d.doc_id, {_or('meso_c')} AS meso_avg_competitors_moderate, {_or('macro_e')} AS macro_avg_context_entities, {_or('need')} AS micro_logical_necessity_rate, {_or('prag')} AS meso_pragmatic_necessity_rate, {_or('loose')} AS macro_overspecification_loose_rate, {_or('agree')} AS meso_consensus_score_mean,
  0.0e0 AS micro_statistical_typicality_mean, {_or('ratio')} AS macro_modification_vs_competitors_ratio, {_or('macro_e')} AS meso_context_density, {_or('macro_c / NULLIF(micro_c, 0)', 1)} AS micro_macro_competitor_ratio, {_or('meso_e / NULLIF(macro_e, 0)', 1)} AS meso_macro_context_ratio,
  {_or('(need + prag) / 2 * (1 - (need + prag) / 2)')} AS necessity_scale_variance FROM documents AS d LEFT JOIN a ON a.doc_id = d.doc_id""", ("documents", "mentions", "entities"))
SQL["mention_scales"] = (_X + f""", o AS (SELECT doc_id, {_if('comp_micro = 0 AND tc > 1')} AS micro_os, {_if('comp_meso = 0')} AS meso_os, {_if('comp_macro = 0 AND tc > 2')} AS macro_os FROM x GROUP BY doc_id),
c AS (SELECT doc_id, k, CAST(count(*) AS DOUBLE) AS n FROM (SELECT doc_id, comp_micro AS k FROM x UNION ALL SELECT doc_id, comp_meso FROM x UNION ALL SELECT doc_id, comp_macro FROM x) AS u GROUP BY doc_id, k), h AS (SELECT doc_id, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM c GROUP BY doc_id)
SELECT d.doc_id, {_or('1 - sqrt(greatest(0, (micro_os * micro_os + meso_os * meso_os + macro_os * macro_os) / 3 - (micro_os + meso_os + macro_os) * (micro_os + meso_os + macro_os) / 9))', 1)} AS scale_consistency_score, {_or('meso_os / NULLIF(micro_os, 0)', 1)} AS micro_meso_overspec_gradient, {_or('h')} + 0.0e0 AS competitor_scale_entropy
FROM documents AS d LEFT JOIN o ON o.doc_id = d.doc_id LEFT JOIN h ON h.doc_id = d.doc_id""", ("documents", "mentions", "entities"))
# A modifier can count twice, as adjective and as part of a phrase; the words right before a mention belong to it here.
SQL["minimal_chains"] = ("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, chain ORDER BY tok_idx) AS nth, count(*) OVER (PARTITION BY doc_id, chain) AS len FROM mentions),
m AS (SELECT k.doc_id, k.chain, k.nth, max(CASE WHEN k.is_pronoun THEN 1.0e0 ELSE 0.0e0 END) AS pronoun, sum(CASE WHEN t.pos = 'ADJ' THEN 1.0e0 ELSE 0.0e0 END + CASE WHEN t.pos = 'ADP' THEN 1.0e0 ELSE 0.0e0 END + CASE WHEN t.lower IN ('who', 'which', 'that') THEN 1.0e0 ELSE 0.0e0 END) AS mods
  FROM k LEFT JOIN tokens AS t ON t.doc_id = k.doc_id AND t.tok_idx BETWEEN k.tok_idx - k.n_tokens + 1 AND k.tok_idx WHERE k.len = 2 GROUP BY k.doc_id, k.chain, k.nth),
a AS (SELECT doc_id, avg(CASE WHEN nth = 1 THEN mods END) AS first_mods, avg(CASE WHEN nth = 2 THEN pronoun END) AS second_p, 2 * avg(mods) AS both_mods FROM m GROUP BY doc_id)
SELECT d.doc_id, round(coalesce(first_mods, 0), 6) AS minimal_first_avg_modifiers, round(coalesce(second_p, 0), 6) AS minimal_second_pronoun_rate, round(coalesce(both_mods, 0), 6) AS minimal_avg_total_modifiers FROM documents AS d LEFT JOIN a ON a.doc_id = d.doc_id""", ("documents", "mentions", "tokens"))
# Singletons are entities whose name is in no chain of several mentions. Their spans have no places where modifiers are counted, so those four columns are always 0.
SQL["singletons"] = ("""WITH k AS (SELECT doc_id, chain, count(*) AS n FROM mentions GROUP BY doc_id, chain), e AS (SELECT doc_id, entity, min(tok_idx) AS tok_idx, count(*) AS n FROM entities GROUP BY doc_id, entity),
s AS (SELECT e.doc_id, count(*) AS singles, avg(CAST(length(e.entity) - length(replace(e.entity, ' ', '')) + 1 AS DOUBLE)) AS toks FROM e LEFT JOIN k ON k.doc_id = e.doc_id AND k.chain = e.entity AND k.n > 1 WHERE k.chain IS NULL GROUP BY e.doc_id), m AS (SELECT doc_id, sum(n) AS in_chains FROM k WHERE n > 1 GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(singles, 0) AS BIGINT) AS singleton_count, round(coalesce(singles, 0) / CAST(greatest(1, coalesce(singles, 0) + coalesce(in_chains, 0)) AS DOUBLE), 6) AS singleton_ratio, 0.0e0 AS singleton_avg_modifiers, 0.0e0 AS singleton_descriptive_rate, 0.0e0 AS singleton_vs_chain_first_ratio, 0.0e0 AS singleton_modification_entropy,
  round(coalesce(toks, 0), 6) AS singleton_avg_tokens FROM documents AS d LEFT JOIN s ON s.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id""", ("documents", "mentions", "entities"))



def _merged(sql: str) -> str:
    """``sql`` for Spark: what is joined by document is merged, as the compressed size of the mentions says little about their rows (hints on tables don't reach into CTEs)."""
    for x in "dekm":
        if names := re.findall(rf"LEFT JOIN (?:\w+ AS )?(\w+) ON \w+\.doc_id = {x}\.doc_id", sql):
            sql = sql.replace(f"SELECT {x}.doc_id", f"SELECT /*+ MERGE({', '.join(names)}) */ {x}.doc_id", 1)
    return sql


# The Spark text of queries whose SQL joins the mentions with themselves: chains and documents are summed up one after the other.
SPARK_SQL = {
    "mention_chains": """WITH b AS (SELECT *, tok_idx - n_tokens + 1 AS begin FROM mentions), g AS (SELECT *, lead(begin) OVER (PARTITION BY doc_id, chain ORDER BY tok_idx) - begin AS gap FROM b),
c AS (SELECT doc_id, chain, count(*) AS len, count_if(is_pronoun) AS pronouns, max(sent_idx) - min(sent_idx) AS span, max(begin) - min(begin) AS width, stddev_pop(gap) / NULLIF(avg(gap), 0) AS cv, max(doc_tokens) AS n FROM g GROUP BY doc_id, chain),
a AS (SELECT doc_id, sum(pronouns) / CAST(sum(len) AS DOUBLE) AS pr, avg(CASE WHEN len = 2 THEN 1.0D WHEN len > 2 THEN 0.0D END) AS minimal, count_if(len = 2) AS minimal_n, avg(CASE WHEN len >= 2 THEN len END) AS mean_len, var_pop(CASE WHEN len >= 2 THEN len END) AS var_len, avg(CASE WHEN len >= 2 THEN CASE WHEN span >= 3 THEN 1.0D ELSE 0.0D END END) AS far,
  avg(CASE WHEN len >= 2 THEN least(width / CAST(n AS DOUBLE), 1.0D) * CASE WHEN len <= 2 THEN 1.0D ELSE 1.0D / (1.0D + coalesce(cv, 0)) END END) AS conn FROM c GROUP BY doc_id)
SELECT /*+ MERGE(a) */ d.doc_id, """ + SQL["mention_chains"][0].partition("SELECT d.doc_id, ")[2].replace(" LEFT JOIN p ON p.doc_id = d.doc_id", ""),
}

QUERIES, ORACLE = {}, {}
for _name, (_sql, _tables) in SQL.items():
    _held = "mentions" in _tables
    QUERIES[_name], ORACLE[_name] = query(_name, _sql, _tables, SPARK_SQL.get(_name, _merged(_sql) if _held else _sql), coref.HELD if _held else None, "mentions")


def components(spark: SparkSession, d: str) -> DataFrame:
    """Share of a document's sentences in the largest component of its entity graph."""
    sents = CONTRACTS["sents"][0](spark, d)
    labels = coherence.components(sents.select("doc_id", F.col("sent_idx").alias("node")), CONTRACTS["entity_edges"][0](spark, d))
    sizes = labels.groupBy("doc_id", "component").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.max("n").alias("top"), F.sum("n").alias("s"))
    return sizes.select("doc_id", F.round(F.col("top") / F.col("s"), 6).alias("entity_largest_component_size"))


def semantic_components(spark: SparkSession, d: str) -> DataFrame:
    """Share of a group's vectors in the largest component of its similarity graph."""
    pairs = CONTRACTS["vector_pairs"][0](spark, d)
    nodes = pairs.select("doc", F.col("i").alias("node")).unionByName(pairs.select("doc", F.col("j").alias("node"))).distinct()
    labels = coherence.components(nodes, pairs.filter(F.col("sim") >= coherence.THRESHOLD), "doc")
    sizes = labels.groupBy("doc", "component").agg(F.count("*").alias("n")).groupBy("doc").agg(F.max("n").alias("top"), F.sum("n").alias("s"))
    return sizes.select("doc", F.round(F.col("top") / F.col("s"), 6).alias("semantic_largest_component_size"))


QUERIES |= {f.__name__: f for f in (components, semantic_components)}
ORACLE["semantic_components"] = f"WITH RECURSIVE {_VECS}, {_PAIRS}, " + f"""e AS (SELECT doc, i, j FROM pairs WHERE sim >= {coherence.THRESHOLD} UNION SELECT doc, j, i FROM pairs WHERE sim >= {coherence.THRESHOLD}),
reach AS (SELECT doc, i AS a, i AS b FROM vecs UNION SELECT r.doc, r.a, e.j FROM reach AS r JOIN e ON e.doc = r.doc AND e.i = r.b), z AS (SELECT doc, a, count(*) AS n FROM reach GROUP BY doc, a), s AS (SELECT doc, count(*) AS s FROM vecs GROUP BY doc)
SELECT z.doc, round(max(n) / CAST(max(s.s) AS DOUBLE), 6) AS semantic_largest_component_size FROM z JOIN s ON s.doc = z.doc GROUP BY z.doc"""
ORACLE["components"] = "WITH RECURSIVE " + ", ".join(CONTRACTS["entity_edges"][1]) + """, both_ways AS (SELECT doc_id, i, j FROM entity_edges UNION SELECT doc_id, j, i FROM entity_edges),
reach AS (SELECT doc_id, sent_idx AS a, sent_idx AS b FROM sents UNION SELECT r.doc_id, r.a, e.j FROM reach AS r JOIN both_ways AS e ON e.doc_id = r.doc_id AND e.i = r.b),
sizes AS (SELECT doc_id, a, count(*) AS n FROM reach GROUP BY doc_id, a), s AS (SELECT doc_id, count(*) AS s FROM sents GROUP BY doc_id)
SELECT s.doc_id, round(max(n) / CAST(max(s.s) AS DOUBLE), 6) AS entity_largest_component_size FROM sizes JOIN s ON s.doc_id = sizes.doc_id GROUP BY s.doc_id"""
