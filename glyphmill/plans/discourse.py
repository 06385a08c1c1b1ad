"""Metadiscourse, language-model and calibration features over the token table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.operators import contracts, lexicons, lm
from glyphmill.plans.portable import contract, query
from glyphmill.session import read_table

_MATCHES = """SELECT g.doc_id, g.tok_idx, g.n_words, g.n_tokens, l.lookup, l.marker, l.certainty, CASE WHEN l.n_words > 1 OR l.pos IS NULL OR l.pos = g.pos THEN 1 ELSE 0 END AS gated
FROM (SELECT doc_id, tok_idx, pos, n_tokens, n_words, CASE n_words WHEN 1 THEN a WHEN 2 THEN a || ' ' || b WHEN 3 THEN a || ' ' || b || ' ' || c ELSE a || ' ' || b || ' ' || c || ' ' || d END AS phrase FROM (
  SELECT doc_id, tok_idx, pos, n_words, lower AS a, lead(lower, 1) OVER w AS b, lead(lower, 2) OVER w AS c, lead(lower, 3) OVER w AS d, count(*) OVER (PARTITION BY doc_id, n_words) AS n_tokens
  FROM tokens CROSS JOIN (SELECT 1 AS n_words UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) AS k WINDOW w AS (PARTITION BY doc_id, n_words ORDER BY tok_idx)) AS x) AS g
JOIN probe AS l ON l.marker = g.phrase AND l.n_words = g.n_words"""


def matches(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Every occurrence of a marker: doc_id, tok_idx, n_words, n_tokens, lookup, marker, certainty, gated.

    Phrases of one to four tokens are built in one pass over each document and joined with the
    lexicon, which is broadcast: its size is that of the files it was read from, not of the data.
    Matches of single words that fail the part-of-speech gate are kept with ``gated`` 0.
    """
    from pyspark.sql import Window as W

    w = W.partitionBy("doc_id").orderBy("tok_idx")
    ahead = tokens.select("doc_id", "tok_idx", "pos", F.col("lower").alias("t0"), *[F.lead("lower", i).over(w).alias(f"t{i}") for i in (1, 2, 3)], F.count("*").over(W.partitionBy("doc_id")).alias("n_tokens"))
    phrases = F.array(*[F.struct(F.lit(n).alias("n_words"), F.when(F.col(f"t{n - 1}").isNotNull(), F.concat_ws(" ", *[f"t{i}" for i in range(n)])).alias("phrase")) for n in (1, 2, 3, 4)])
    rows = ahead.select("doc_id", "tok_idx", "pos", "n_tokens", F.inline(phrases)).filter("phrase is not null")
    named = lexicon.select(F.col("marker").alias("phrase"), "n_words", "lookup", "certainty", F.col("pos").alias("allowed"))
    joined = rows.join(F.broadcast(named), ["phrase", "n_words"])
    gated = (F.col("n_words") > 1) | F.col("allowed").isNull() | (F.col("allowed") == F.col("pos"))
    return joined.select("doc_id", "tok_idx", "n_words", "n_tokens", "lookup", F.col("phrase").alias("marker"), "certainty", gated.cast("int").alias("gated"))


contract("matches", lambda s, d: matches(contracts.tokens(read_table(s, d, "documents")), lexicons.probe(s)), contracts.oracle("sents", "tokens") + (f"probe AS ({lexicons.probe_sql()})", f"matches AS ({_MATCHES})"))

SQL: dict[str, tuple[str, tuple[str, ...]]] = {}
SQL["lexicon_density"] = ("WITH c AS (SELECT doc_id, " + ", ".join(f"sum(CASE WHEN lookup = '{k}' THEN gated ELSE 0 END) AS {k}" for k in lexicons.LOOKUPS if k != "weasel") + " FROM matches GROUP BY doc_id) SELECT s.doc_id, CAST(s.n AS BIGINT) AS doc_length_tokens, "
    + ", ".join(f"CAST(coalesce(c.{k}, 0) AS BIGINT) AS {k}_count, round(1000 * CAST(coalesce(c.{k}, 0) AS DOUBLE) / s.n, 6) AS {k}_density" for k in lexicons.LOOKUPS if k not in ("weasel", "reformulation")) + " FROM doc_sizes AS s LEFT JOIN c ON c.doc_id = s.doc_id", ("doc_sizes", "matches"))
SQL["phrase_matches"] = ("SELECT lookup, marker, CAST(count(*) AS BIGINT) AS n_matches, CAST(sum(gated) AS BIGINT) AS n_gated, CAST(count(DISTINCT doc_id) AS BIGINT) AS n_documents FROM matches GROUP BY lookup, marker", ("matches",))
SQL["self_mention_position"] = ("""WITH m AS (SELECT doc_id, n_tokens, CASE WHEN tok_idx + n_words <= floor(n_tokens * 0.2e0) THEN 1 ELSE 0 END AS early, CASE WHEN tok_idx >= floor(n_tokens * 0.2e0) THEN 1 ELSE 0 END AS late FROM matches WHERE lookup = 'self_mention'),
c AS (SELECT doc_id, max(n_tokens) AS n, sum(early) AS early, sum(late) AS late FROM m GROUP BY doc_id),
x AS (SELECT doc_id, 1000.0e0 * early / NULLIF(floor(n * 0.2e0), 0) AS first_density, 1000.0e0 * late / NULLIF(n - floor(n * 0.2e0), 0) AS rest_density FROM c)
SELECT doc_id, round(coalesce(first_density, 0), 6) AS self_mention_first_20pct_density, round(coalesce(rest_density, 0), 6) AS self_mention_rest_80pct_density, round(coalesce(first_density / NULLIF(rest_density, 0), 0), 6) AS self_mention_first_use_ratio FROM x""", ("matches",))
_cert = "coalesce(certainty, 0.5)"
SQL["certainty"] = (f"""WITH m AS (SELECT doc_id, tok_idx, n_words, n_tokens, gated, {_cert} AS flat, coalesce(certainty, CASE WHEN lookup = 'boosters' THEN 0.9 ELSE 0.5 END) AS weighted,
  CASE WHEN tok_idx + n_words <= floor(n_tokens / 3.0e0) THEN 1 ELSE 0 END AS a, CASE WHEN tok_idx >= floor(2 * n_tokens / 3.0e0) THEN 1 ELSE 0 END AS z FROM matches WHERE lookup IN ('hedges', 'boosters', 'epistemic')),
c AS (SELECT doc_id, coalesce(sum(flat * a) / NULLIF(sum(a), 0), 0.5) AS first_third, coalesce(sum(flat * z) / NULLIF(sum(z), 0), 0.5) AS last_third, coalesce(sum(weighted * gated) / NULLIF(sum(gated), 0), 0.5) AS overall FROM m GROUP BY doc_id)
SELECT s.doc_id, round(CAST(coalesce(first_third, 0.5) AS DOUBLE), 6) AS certainty_first_third, round(CAST(coalesce(last_third, 0.5) AS DOUBLE), 6) AS certainty_last_third,
  round(CAST(coalesce(first_third, 0.5) - coalesce(last_third, 0.5) AS DOUBLE), 6) AS certainty_gradient, round(CAST(coalesce(overall, 0.5) AS DOUBLE), 6) AS certainty_overall FROM doc_sizes AS s LEFT JOIN c ON c.doc_id = s.doc_id""", ("doc_sizes", "matches"))
SQL["reformulation_weasel"] = ("""WITH c AS (SELECT doc_id, sum(CASE WHEN lookup IN ('code_glosses', 'reformulation') THEN gated ELSE 0 END) AS r, sum(CASE WHEN lookup = 'weasel' THEN gated ELSE 0 END) AS w, sum(CASE WHEN lookup = 'evidentials' THEN gated ELSE 0 END) AS e FROM matches GROUP BY doc_id)
SELECT s.doc_id, CAST(coalesce(r, 0) AS BIGINT) AS reformulation_count, round(1000.0e0 * coalesce(r, 0) / s.n, 6) AS reformulation_density, CAST(coalesce(w, 0) AS BIGINT) AS weasel_count, CAST(coalesce(e, 0) AS BIGINT) AS evidential_count,
  round(coalesce(CAST(w AS DOUBLE) / NULLIF(w + e, 0), 0), 6) AS weasel_to_evidential_ratio, round(1000.0e0 * coalesce(w, 0) / s.n, 6) AS weasel_density, round(1000.0e0 * coalesce(e, 0) / s.n, 6) AS evidential_density FROM doc_sizes AS s LEFT JOIN c ON c.doc_id = s.doc_id""", ("doc_sizes", "matches"))

contract("token_nll", lambda s, d: lm.token_nll(contracts.tokens(read_table(s, d, "documents"))), contracts.oracle("sents", "tokens") + (f"token_nll AS ({lm.TOKEN_NLL_SQL})",))
contract("sentence_nll", lambda s, d: lm.sentence_nll(lm.token_nll(contracts.tokens(read_table(s, d, "documents")))), contracts.oracle("sents", "tokens") + (f"token_nll AS ({lm.TOKEN_NLL_SQL})", f"sentence_nll AS ({lm.SENTENCE_NLL_SQL})"))
SQL["bigram_model"] = ("SELECT CAST(count(*) AS BIGINT) AS n_tokens, CAST(count(DISTINCT prev || ' ' || lower) AS BIGINT) AS n_bigrams, round(avg(nll), 4) AS mean_nll, round(max(nll), 4) AS max_nll FROM token_nll", ("token_nll",))
SQL["perplexity"] = ("""WITH d AS (SELECT doc_id, CASE WHEN count(*) >= 3 THEN avg(nll) END AS doc_nll, sum(-exp(-nll) * -nll) AS entropy FROM token_nll GROUP BY doc_id),
v AS (SELECT doc_id, nll, row_number() OVER (PARTITION BY doc_id ORDER BY sent_idx) - 1 AS i FROM sentence_nll),
s AS (SELECT doc_id, avg(nll) AS mean_s, CASE WHEN count(*) > 1 THEN var_pop(nll) END AS var_s, CASE WHEN sum(CASE WHEN nll > 0 THEN 1 ELSE 0 END) > 1 THEN max(nll) / NULLIF(min(CASE WHEN nll > 0 THEN nll END), 0) END AS burst,
  CASE WHEN count(*) > 2 THEN covar_pop(nll, CAST(i AS DOUBLE)) / NULLIF(var_pop(CAST(i AS DOUBLE)), 0) END AS slope FROM v GROUP BY doc_id)
SELECT d.doc_id, round(doc_nll, 5) AS doc_perplexity, round(mean_s, 5) AS mean_sentence_perplexity, round(var_s, 5) AS sentence_perplexity_variance, round(entropy, 4) AS token_probability_entropy,
  round(doc_nll - mean_s, 5) AS perplexity_curvature, round(burst, 5) AS perplexity_burstiness, round(slope, 5) AS perplexity_trajectory_slope FROM d LEFT JOIN s ON s.doc_id = d.doc_id""", ("token_nll", "sentence_nll"))

_HEDGE = contracts.listed(sorted(m for k, m, _, _ in lexicons.PROBE if k in ("hedges", "epistemic")))
_BOOST = contracts.listed(sorted(m for k, m, _, _ in lexicons.PROBE if k == "boosters"))
_META = contracts.listed(sorted(m for k, m, _, _ in lexicons.PROBE if k in ("hedges", "epistemic", "boosters", "transitions", "self_mention")))
contract("sentence_density", lambda s, d: lm.sentence_density(contracts.sentences(read_table(s, d, "documents")), _HEDGE, _BOOST, _META), contracts.oracle("sents", "tokens") + (f"sentence_density AS ({lm.density_sql(_HEDGE, _BOOST, _META)})",))
SQL["calibration"] = ("""WITH x AS (SELECT n.doc_id, n.sent_idx, n.nll, d.hedge, d.boost, d.meta FROM sentence_nll AS n JOIN sentence_density AS d ON d.doc_id = n.doc_id AND d.sent_idx = n.sent_idx),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY meta DESC, sent_idx DESC) AS rk, count(*) OVER (PARTITION BY doc_id) AS n FROM x),
c AS (SELECT doc_id, max(n) AS n, var_pop(nll) AS v, max(hedge) AS mh, max(boost) AS mb, covar_pop(hedge, nll) / NULLIF(stddev_pop(hedge) * stddev_pop(nll), 0) AS ch, covar_pop(boost, nll) / NULLIF(stddev_pop(boost) * stddev_pop(nll), 0) AS cb,
  avg(nll) AS m, avg(CASE WHEN rk <= n - greatest(1, floor(0.8e0 * n)) THEN nll END) AS spike, max(n - greatest(1, floor(0.8e0 * n))) AS n_spike FROM r GROUP BY doc_id)
SELECT doc_id, CASE WHEN n >= 5 AND mh > 0 AND v >= 0.000001 THEN round(coalesce(ch, 0), 4) ELSE 0.0e0 END AS hedge_perplexity_correlation, CASE WHEN n >= 5 AND mb > 0 AND v >= 0.000001 THEN round(coalesce(cb, 0), 4) ELSE 0.0e0 END AS booster_perplexity_anticorrelation,
  CASE WHEN n >= 2 AND n_spike >= 3 THEN round(least(coalesce(spike / NULLIF(m, 0), 1.0e0), 2.5e0), 4) ELSE 1.0e0 END AS metacog_spike_perplexity_ratio FROM c""", ("sentence_nll", "sentence_density"))

QUERIES, ORACLE = {}, {}
for _name, (_sql, _tables) in SQL.items():
    QUERIES[_name], ORACLE[_name] = query(_name, _sql, _tables)


def calibration_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Certainty against perplexity, and reformulation against the variance of sentence perplexity."""
    ppl = QUERIES["perplexity"](spark, d).select("doc_id", "doc_perplexity", "sentence_perplexity_variance")
    sure = QUERIES["certainty"](spark, d).select("doc_id", "certainty_overall")
    again = QUERIES["reformulation_weasel"](spark, d).select("doc_id", "reformulation_density")
    v = F.col("sentence_perplexity_variance")
    return ppl.join(sure, "doc_id").join(again, "doc_id").select(
        "doc_id",
        F.round(F.coalesce(1 - F.abs(F.col("certainty_overall") - 1 / (1 + F.col("doc_perplexity"))), F.lit(0.0)), 4).alias("certainty_perplexity_alignment"),
        F.round(F.when(v >= 0.01, F.col("reformulation_density") * v).otherwise(0.0), 2).alias("reformulation_complexity_match"),
    )


def perturbation(spark: SparkSession, d: str) -> DataFrame:
    """Perturbation discrepancy: how far a document's likelihood lies from that of its perturbed copies."""
    return lm.perturbation_of(read_table(spark, d, "documents"))


QUERIES |= {f.__name__: f for f in (calibration_alignment, perturbation)}
