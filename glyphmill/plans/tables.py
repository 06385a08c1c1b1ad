"""Queries on raw text, feature-table quality, statistics, sampling, joins and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from glyphmill.functions import text as T
from glyphmill.operators import quality, ranking, sampling, stats
from glyphmill.session import read_table

FEATURES = ["n_tokens_doc", "avg_word_length", "type_token_ratio", "flesch_reading_ease", "avg_sentence_length", "sentence_length_std", "max_tree_depth"]
_clean = lambda f: f"CASE WHEN isfinite({f}) THEN CAST({f} AS DOUBLE) END"
_BASE = "base AS (SELECT row_id, id, is_ai, domain, model, " + ", ".join(f"{_clean(f)} AS {f}" for f in FEATURES) + " FROM stylometric_features)"
_LONG = "l AS (" + " UNION ALL ".join(f"SELECT is_ai AS label, '{f}' AS feature, {f} AS value FROM base WHERE is_ai IS NOT NULL AND {f} IS NOT NULL" for f in FEATURES) + ")"
ORACLE: dict[str, str] = {}
_QUERIES = []


def q(sql: str | None = None):
    """Register a query with its SQL."""
    def add(f):
        _QUERIES.append(f)
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _docs(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "documents")


def _features(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "stylometric_features")


@q("SELECT printf('doc_%05d', row_number() OVER (ORDER BY doc_id) - 1) AS id, doc_id FROM documents")
def doc_load_ids(s, d):
    return ranking.numbered(_docs(s, d).select("doc_id"), ["doc_id"], "k").select(F.format_string("doc_%05d", "k").alias("id"), "doc_id")


@q(r"SELECT doc_id, regexp_matches(text, '(?i)https?://\S+|www\.\S+') AS had_urls, regexp_matches(text, '<[^>]+>') AS had_html, regexp_matches(text, '`[^`]+`') OR regexp_matches(text, '(?s)```.*?```') AS had_code, regexp_matches(text, '(?m)^[ \t]*\|.*\|[ \t]*$') AS had_table FROM documents WHERE text IS NOT NULL")
def text_markup_flags(s, d):
    return _docs(s, d).filter("text is not null").select("doc_id", *T.markup_flags("text"))


@q(r"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(?i)https?://\S+|www\.\S+', ' ', 'g'), '(?s)```.*?```', ' ', 'g'), '`[^`]+`', ' ', 'g'), '<[^>]+>', ' ', 'g') AS t FROM documents),
b AS (SELECT doc_id, array_to_string(list_filter(string_split_regex(t, '\r\n|\n|\r'), lambda x: NOT regexp_matches(x, '^\s*\|.*\|\s*$')), chr(10)) AS t FROM a) SELECT doc_id, trim(regexp_replace(t, '\s+', ' ', 'g')) AS stripped FROM b""")
def text_strip_markup(s, d):
    return _docs(s, d).select("doc_id", T.strip_markup("text").alias("stripped"))


@q("SELECT id, trim(regexp_replace(replace(regexp_replace(coalesce(generation, ''), '[​-‍﻿­‎‏‪-‮⁠⁦-⁩]|[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), ' ', ' '), '\\s+', ' ', 'g')) AS shown FROM generations")
def text_hidden_chars(s, d):
    return read_table(s, d, "generations").select("id", T.drop_hidden(F.col("generation")).alias("shown"))


@q()
def text_nfkc(s, d):
    return read_table(s, d, "generations").select("id", T.normalize("generation").alias("normal"))


_DIAG = r"""w AS (SELECT doc_id, coalesce(text, '') AS t, list_transform(regexp_extract_all(coalesce(text, ''), '\p{L}+(?:''\p{L}+)?'), lambda x: CAST(length(x) AS DOUBLE)) AS w FROM documents),
c AS (SELECT doc_id, ch, CAST(count(*) AS DOUBLE) AS n FROM (SELECT doc_id, unnest(string_split(t, '')) AS ch FROM w WHERE t <> '') AS x GROUP BY doc_id, ch), e AS (SELECT doc_id, count(*) AS k, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM c GROUP BY doc_id),
diag AS (SELECT w.doc_id, CAST(length(t) AS BIGINT) AS n_chars, CAST(len(w) AS BIGINT) AS n_tok, CASE WHEN t = '' THEN 0 ELSE round(len(regexp_extract_all(t, '\p{L}')) / CAST(length(t) AS DOUBLE), 6) END AS alpha_ratio, CASE WHEN t = '' THEN 0 ELSE round(len(regexp_extract_all(t, '\p{Nd}')) / CAST(length(t) AS DOUBLE), 6) END AS digit_ratio,
CASE WHEN t = '' THEN 0 ELSE round(len(regexp_extract_all(t, '[^\p{L}\p{N}\s]')) / CAST(length(t) AS DOUBLE), 6) END AS punct_ratio, round(CASE WHEN len(w) > 0 THEN list_avg(w) END, 6) AS avg_word_length, round(CASE WHEN len(w) > 0 THEN list_stddev_pop(w) END, 6) AS std_word_length, round(h, 6) AS entropy_bits, round(h / log2(greatest(2, k)), 6) AS entropy_norm FROM w LEFT JOIN e ON e.doc_id = w.doc_id)"""


@q(f"WITH {_DIAG} SELECT * FROM diag")
def text_diagnostics(s, d):
    return T.diagnostics(_docs(s, d))


_GATE = f"""{_DIAG}, gate AS (SELECT doc_id, concat_ws(';', CASE WHEN n_chars < 30 THEN 'too_short_chars' END, CASE WHEN n_tok < 5 THEN 'too_few_tokens' END, CASE WHEN avg_word_length IS NULL OR avg_word_length < 2 OR avg_word_length > 10 THEN 'avg_word_length_out_of_range' END,
CASE WHEN alpha_ratio < 0.55 THEN 'low_alpha_ratio' END, CASE WHEN digit_ratio > 0.3 THEN 'high_digit_ratio' END, CASE WHEN punct_ratio > 0.35 THEN 'high_punct_ratio' END, CASE WHEN entropy_norm IS NULL OR entropy_norm < 0.35 THEN 'low_entropy' END) AS reasons FROM diag)"""


@q(f"WITH {_GATE} SELECT doc_id, reasons, reasons = '' AS passes FROM gate")
def text_gate(s, d):
    return T.diagnostics(_docs(s, d)).select("doc_id", T.gate_reasons().alias("reasons")).withColumn("passes", F.col("reasons") == "")


@q(f"WITH {_GATE} SELECT reason, count(*) AS n_documents FROM (SELECT unnest(string_split(reasons, ';')) AS reason FROM gate WHERE reasons <> '') AS x GROUP BY reason")
def gate_reason_counts(s, d):
    return text_gate(s, d).filter("not passes").select(F.explode(F.split("reasons", ";")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n_documents"))


@q("SELECT id, CASE WHEN model IS NULL THEN NULL ELSE lower(trim(model)) NOT IN ('human') END AS label FROM generations")
def label_derivation(s, d):
    return read_table(s, d, "generations").select("id", (~F.lower(F.trim("model")).isin("human")).alias("label"))


@q("SELECT id, lower(trim(domain)) AS domain FROM generations WHERE lower(trim(domain)) NOT IN ('speech', 'letter')")
def value_exclusion(s, d):
    return read_table(s, d, "generations").select("id", F.lower(F.trim("domain")).alias("domain")).filter(~F.col("domain").isin("speech", "letter"))


@q("SELECT id, source, epoch_us(received_at) AS received_us FROM (SELECT id, source, received_at, row_number() OVER (PARTITION BY id ORDER BY received_at, source) AS k FROM generations WHERE length(trim(generation)) > 0) AS x WHERE k = 1")
def dedupe_keep_first(s, d):
    first = read_table(s, d, "generations").filter(F.length(F.trim("generation")) > 0).groupBy("id").agg(F.min(F.struct("received_at", "source")).alias("x"))
    return first.select("id", "x.source", F.unix_micros(F.col("x.received_at").cast("timestamp")).alias("received_us"))


@q(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS n_tokens_ws, CAST(length(text) AS BIGINT) AS n_chars_ws FROM documents WHERE text IS NOT NULL")
def whitespace_counts(s, d):
    return _docs(s, d).filter("text is not null").select("doc_id", *T.whitespace_counts("text"))


@q("WITH " + " UNION ALL ".join(f"SELECT '{f}' AS feature, round(avg(CASE WHEN isfinite({f}) THEN 0.0 ELSE 1.0 END), 6) AS missing, CAST(sum(CASE WHEN isinf({f}) THEN 1 ELSE 0 END) AS BIGINT) AS n_infinite FROM stylometric_features" for f in FEATURES).join(("x AS (", ") SELECT feature, missing, n_infinite FROM x")))
def missing_fraction(s, d):
    return quality.missing_fraction(_features(s, d), FEATURES).withColumn("missing", F.round("missing", 6))


def _out(f: str) -> str:
    lo, hi = quality.bounds(f)
    return " OR ".join([f"coalesce(min({f}) < {lo}, false)"] * (lo is not None) + [f"coalesce(max({f}) > {hi}, false)"] * (hi is not None)) or "false"


@q(f"WITH {_BASE} " + " UNION ALL ".join(f"SELECT '{f}' AS feature, count(*) - count({f}) AS n_missing, min({f}) AS least, max({f}) AS most, round(avg({f}), 5) AS mean, round(stddev_samp({f}), 4) AS std, {_out(f)} AS out_of_range FROM base" for f in FEATURES))
def verify_ranges(s, d):
    return quality.verify(_features(s, d), FEATURES).withColumns({"mean": F.round("mean", 5), "std": F.round("std", 4)})


def _cap(f: str, p: float) -> str:
    x = f"quantile_cont({f}, {p})"
    lo, hi = quality.bounds(f)
    x = f"greatest({x}, {lo})" if lo is not None else x
    return f"least({x}, {hi})" if hi is not None else x


_CAPS = "caps AS (SELECT " + ", ".join(f"{_cap(f, 0.01)} AS lo_{f}, {_cap(f, 0.99)} AS hi_{f}" for f in FEATURES) + " FROM base)"


@q(f"WITH {_BASE}, {_CAPS} SELECT row_id, " + ", ".join(f"round(CASE WHEN {f} IS NOT NULL THEN least(greatest({f}, lo_{f}), hi_{f}) END, 6) AS {f}" for f in FEATURES) + " FROM base CROSS JOIN caps")
def percentile_caps(s, d):
    t = _features(s, d).select("row_id", *FEATURES)
    return quality.apply_caps(t, quality.caps(t, FEATURES), FEATURES).select("row_id", *[F.round(f, 6).alias(f) for f in FEATURES])


@q(f"WITH {_BASE}, m AS (SELECT " + ", ".join(f"avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}" for f in FEATURES) + " FROM base), x AS (SELECT row_id, " + ", ".join(f"coalesce(abs(({f} - m_{f}) / NULLIF(s_{f}, 0)) > 3, false) AS {f}_outlier" for f in FEATURES) + " FROM base CROSS JOIN m) SELECT *, round(greatest(0, 1 - (" + " + ".join(f"CAST({f}_outlier AS INT)" for f in FEATURES) + f") / {len(FEATURES)}.0e0), 6) AS quality_score FROM x")
def zscore_flags(s, d):
    out = quality.zscore_flags(_features(s, d).select("row_id", *FEATURES), FEATURES)
    return out.drop(*FEATURES).withColumn("quality_score", F.round("quality_score", 6))


@q(f"WITH {_BASE}, t AS (SELECT quantile_cont(n_tokens_doc, 0.05) AS a, quantile_cont(avg_sentence_length, 0.95) AS b FROM base), x AS (SELECT row_id, coalesce(n_tokens_doc < a, false) AS short_text, coalesce(avg_sentence_length > b, false) AS long_sentences, max_tree_depth IS NULL AS no_depth FROM base CROSS JOIN t) SELECT *, CAST(short_text AS INT) + CAST(long_sentences AS INT) + CAST(no_depth AS INT) AS severity FROM x")
def outlier_flags(s, d):
    t = _features(s, d).select("row_id", *[quality.finite(f).alias(f) for f in FEATURES])
    limits = t.agg(F.percentile("n_tokens_doc", F.lit(0.05)).alias("__a"), F.percentile("avg_sentence_length", F.lit(0.95)).alias("__b"))
    t = t.crossJoin(F.broadcast(limits))
    checks = {"short_text": lambda x: x["n_tokens_doc"] < x["__a"], "long_sentences": lambda x: x["avg_sentence_length"] > x["__b"], "no_depth": lambda x: x["max_tree_depth"].isNull()}
    return quality.outlier_flags(t, checks).select("row_id", *checks, "severity")


_BIN = "CASE WHEN n_tokens_doc >= 0 AND n_tokens_doc < 100 THEN 0 WHEN n_tokens_doc >= 100 AND n_tokens_doc < 250 THEN 1 WHEN n_tokens_doc >= 250 AND n_tokens_doc < 500 THEN 2 WHEN n_tokens_doc >= 500 AND n_tokens_doc < 10000 THEN 3 END"


@q(f"WITH {_BASE}, g AS (SELECT *, coalesce({_BIN}, -1) AS bin FROM base), a AS (SELECT " + ", ".join(f"median({f}) AS a_{f}" for f in FEATURES) + " FROM base), b AS (SELECT bin, " + ", ".join(f"median({f}) AS b_{f}" for f in FEATURES) + " FROM g GROUP BY bin) SELECT row_id, " + ", ".join(f"round(coalesce({f}, b_{f}, a_{f}, 0), 6) AS {f}" for f in FEATURES) + " FROM g JOIN b ON b.bin = g.bin CROSS JOIN a")
def impute_median_by_bin(s, d):
    t = _features(s, d).select("row_id", *FEATURES)
    return quality.impute_median(t, FEATURES, [quality.length_bin("n_tokens_doc")]).select("row_id", *[F.round(f, 6).alias(f) for f in FEATURES])


@q(f"WITH {_BASE}, a AS (SELECT " + ", ".join(f"median({f}) AS a_{f}" for f in FEATURES) + " FROM base) SELECT row_id, " + ", ".join(f"round(coalesce({f}, a_{f}, 0), 6) AS {f}" for f in FEATURES) + " FROM base CROSS JOIN a")
def impute_global(s, d):
    return quality.impute_median(_features(s, d).select("row_id", *FEATURES), FEATURES).select("row_id", *[F.round(f, 6).alias(f) for f in FEATURES])


@q(f"WITH {_BASE} SELECT row_id, coalesce(sentence_length_std, 0) AS sentence_length_std, coalesce(type_token_ratio, 1) AS type_token_ratio, round(coalesce(avg_word_length, (SELECT median(avg_word_length) FROM base)), 6) AS avg_word_length FROM base")
def impute_semantic(s, d):
    return quality.impute_semantic(_features(s, d).select("row_id", "sentence_length_std", "type_token_ratio", "avg_word_length"), ["sentence_length_std"], ["type_token_ratio"], ["avg_word_length"]).withColumn("avg_word_length", F.round("avg_word_length", 6))


_PAIRS = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]]


def _corr(a: str, b: str, table: str = "base") -> str:
    return f"SELECT '{a}' AS a, '{b}' AS b, round(covar_pop({a}, {b}) / NULLIF(stddev_pop({a}) * stddev_pop({b}), 0), 5) AS r, count(*) AS n FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL"


@q(f"WITH {_BASE} " + " UNION ALL ".join(_corr(a, b) for a, b in _PAIRS))
def corr_pairs(s, d):
    return quality.correlations(_features(s, d), FEATURES).withColumn("r", F.round("r", 5))


@q(f"WITH {_BASE}, r AS (SELECT " + ", ".join(f"CASE WHEN {f} IS NOT NULL THEN rank() OVER (ORDER BY {f}) + (count(*) OVER (PARTITION BY {f}) - 1) / 2.0e0 END AS {f}" for f in FEATURES[:4]) + " FROM base) " + " UNION ALL ".join(_corr(a, b, "(SELECT " + ", ".join(f"{f} - (SELECT 0) AS {f}" for f in FEATURES[:4]) + " FROM r)") for a, b in _PAIRS if a in FEATURES[:4] and b in FEATURES[:4]))
def corr_spearman(s, d):
    return quality.correlations(_features(s, d), FEATURES[:4], ranks=True).withColumn("r", F.round("r", 5))


@q(f"WITH {_BASE}, {_LONG}, m AS (SELECT feature, count(CASE WHEN label = 0 THEN 1 END) AS n0, count(CASE WHEN label = 1 THEN 1 END) AS n1, avg(CASE WHEN label = 0 THEN value END) AS mean0, avg(CASE WHEN label = 1 THEN value END) AS mean1, median(CASE WHEN label = 0 THEN value END) AS median0, median(CASE WHEN label = 1 THEN value END) AS median1, stddev_samp(CASE WHEN label = 0 THEN value END) AS std0, stddev_samp(CASE WHEN label = 1 THEN value END) AS std1 FROM l GROUP BY feature) SELECT feature, n0, n1, round(mean0, 6) AS mean0, round(mean1, 6) AS mean1, round(median0, 6) AS median0, round(median1, 6) AS median1, round(std0, 6) AS std0, round(std1, 6) AS std1, round(mean1 - mean0, 6) AS diff, round(100 * (mean1 - mean0) / NULLIF(abs(mean0), 0), 4) AS diff_pct FROM m")
def class_descriptives(s, d):
    return stats.descriptives(_features(s, d), FEATURES, "is_ai")


@q(f"""WITH {_BASE}, {_LONG}, m AS (SELECT feature, CAST(count(CASE WHEN label = 0 THEN 1 END) AS DOUBLE) AS n0, CAST(count(CASE WHEN label = 1 THEN 1 END) AS DOUBLE) AS n1, avg(CASE WHEN label = 0 THEN value END) AS mean0, avg(CASE WHEN label = 1 THEN value END) AS mean1, var_samp(CASE WHEN label = 0 THEN value END) AS v0, var_samp(CASE WHEN label = 1 THEN value END) AS v1 FROM l GROUP BY feature),
x AS (SELECT *, ((n0 - 1) * v0 + (n1 - 1) * v1) / NULLIF(n0 + n1 - 2, 0) AS pooled, v0 / n0 AS a, v1 / n1 AS b FROM m), y AS (SELECT *, coalesce((mean1 - mean0) / NULLIF(sqrt(pooled), 0), 0) AS d FROM x)
SELECT feature, round((mean1 - mean0) / NULLIF(sqrt(pooled * (1 / n0 + 1 / n1)), 0), 5) AS t_pooled, CAST(n0 + n1 - 2 AS BIGINT) AS df_pooled, round((mean1 - mean0) / NULLIF(sqrt(a + b), 0), 5) AS t_welch, round((a + b) * (a + b) / NULLIF(a * a / (n0 - 1) + b * b / (n1 - 1), 0), 3) AS df_welch, round(d, 6) AS cohens_d, CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS effect FROM y""")
def t_statistics(s, d):
    return stats.t_tests(_features(s, d), FEATURES, "is_ai")


@q()
def bonferroni(s, d):
    return stats.significance(_features(s, d), FEATURES, "is_ai")


@q(f"WITH {_BASE}, {_LONG}, r AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM l GROUP BY feature), b AS (SELECT l.feature, l.label, CAST(least(29, floor((value - lo) / ((hi - lo) / 30))) AS BIGINT) AS bin, (hi - lo) / 30 AS width FROM l JOIN r ON r.feature = l.feature WHERE hi > lo), c AS (SELECT feature, label, bin, count(*) AS n, max(width) AS width FROM b GROUP BY feature, label, bin) SELECT feature, label, bin, n, round(n / (sum(n) OVER (PARTITION BY feature, label) * width), 6) AS density FROM c")
def class_histogram(s, d):
    return stats.histogram(_features(s, d), FEATURES, "is_ai")


@q("WITH x AS (SELECT lower(trim(domain)) AS domain, count(*) AS n_rows, count(DISTINCT id) AS n_ids, avg(CASE WHEN isfinite(avg_word_length) THEN avg_word_length END) AS m, min(CASE WHEN isfinite(avg_word_length) THEN avg_word_length END) AS lo, max(CASE WHEN isfinite(avg_word_length) THEN avg_word_length END) AS hi FROM stylometric_features GROUP BY 1) SELECT domain, n_rows, n_ids, round(m, 6) AS mean_word, lo, hi FROM x")
def category_summary(s, d):
    v = quality.finite("avg_word_length")
    return _features(s, d).groupBy(F.lower(F.trim("domain")).alias("domain")).agg(F.count("*").alias("n_rows"), F.count_distinct("id").alias("n_ids"), F.round(F.avg(v), 6).alias("mean_word"), F.min(v).alias("lo"), F.max(v).alias("hi"))


_WS = r"ws AS (SELECT doc_id, source, is_ai, len(regexp_extract_all(text, '\S+')) AS n FROM documents WHERE text IS NOT NULL)"


@q(f"WITH {_WS}, p AS (SELECT quantile_cont(n, 0.25) AS a, quantile_cont(n, 0.5) AS b FROM ws) SELECT doc_id, CASE WHEN n <= a THEN 'short' WHEN n <= b THEN 'medium' ELSE 'long' END AS length_bin FROM ws CROSS JOIN p")
def length_bins(s, d):
    t = _docs(s, d).filter("text is not null").select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).alias("n"))
    return sampling.length_bins(t, "n", {"short": 0.25, "medium": 0.25, "long": 0.5}).select("doc_id", "length_bin")


@q("WITH w AS (SELECT source, target_weight, sum(target_weight) OVER () AS t, row_number() OVER (ORDER BY source) AS ord FROM mix_targets), x AS (SELECT source, ord, 1000 * target_weight / t AS x, floor(round(1000 * target_weight / t, 9)) AS f FROM w), y AS (SELECT source, f, row_number() OVER (ORDER BY round(x - f, 9) DESC, ord) AS k, 1000 - sum(f) OVER () AS left_over FROM x) SELECT source, CAST(f + CASE WHEN k <= left_over THEN 1 ELSE 0 END AS BIGINT) AS quota FROM y")
def largest_remainder(s, d):
    return sampling.largest_remainder(read_table(s, d, "mix_targets").withColumn("ord", F.row_number().over(W.orderBy("source"))), 1000, "source", "target_weight")


@q("WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source), x AS (SELECT source, 333.0e0 * n / sum(n) OVER () AS x FROM c), y AS (SELECT source, floor(round(x, 9)) AS f, round(x - floor(round(x, 9)), 9) AS r FROM x), z AS (SELECT source, f, row_number() OVER (ORDER BY r DESC, source) AS k, 333 - sum(f) OVER () AS left_over FROM y) SELECT source, CAST(f + CASE WHEN k <= left_over THEN 1 ELSE 0 END AS BIGINT) AS quota FROM z")
def proportional_allocation(s, d):
    return sampling.proportional_allocation(_docs(s, d).groupBy("source").agg(F.count("*").alias("n")), 333, "source", "n", "source")


_MD5 = "md5(concat_ws('|', CAST(doc_id AS VARCHAR), '{}'))"


@q(f"WITH c AS (SELECT is_ai, source, count(*) AS n FROM documents WHERE is_ai IS NOT NULL AND source IS NOT NULL GROUP BY is_ai, source), h AS (SELECT is_ai, floor(300 / count(*) OVER ()) + CASE WHEN row_number() OVER (ORDER BY is_ai) <= 300 % count(*) OVER () THEN 1 ELSE 0 END AS head FROM (SELECT DISTINCT is_ai FROM c) AS q), x AS (SELECT c.is_ai, c.source, least(head, sum(n) OVER w) AS head, round(least(head, sum(n) OVER w) * n / CAST(sum(n) OVER w AS DOUBLE), 9) AS x FROM c JOIN h ON h.is_ai = c.is_ai WINDOW w AS (PARTITION BY c.is_ai)), y AS (SELECT *, floor(x) AS f, head - sum(floor(x)) OVER (PARTITION BY is_ai) AS left_over, row_number() OVER (PARTITION BY is_ai ORDER BY round(x - floor(x), 9) DESC, source) AS k FROM x), quota AS (SELECT is_ai, source, f + CASE WHEN k <= left_over THEN 1 ELSE 0 END AS quota FROM y), r AS (SELECT doc_id, is_ai, source, row_number() OVER (PARTITION BY is_ai, source ORDER BY {_MD5.format('s')}) AS k FROM documents WHERE is_ai IS NOT NULL AND source IS NOT NULL) SELECT r.doc_id, r.is_ai, r.source FROM r JOIN quota ON quota.is_ai = r.is_ai AND quota.source = r.source WHERE r.k <= quota.quota")
def stratified_sample(s, d):
    return sampling.stratified(_docs(s, d).select("doc_id", "is_ai", "source"), ["is_ai", "source"], 300, "doc_id")


@q("WITH c AS (SELECT 'source' AS dimension, CAST(source AS VARCHAR) AS category FROM documents UNION ALL SELECT 'is_ai', CAST(is_ai AS VARCHAR) FROM documents), n AS (SELECT dimension, category, count(*) AS n FROM c GROUP BY dimension, category) SELECT dimension, category, n, round(n / CAST(sum(n) OVER (PARTITION BY dimension) AS DOUBLE), 6) AS actual, CASE WHEN dimension = 'is_ai' AND category IN ('0', '1') THEN 0.5e0 END AS target FROM n")
def balance_report(s, d):
    return sampling.balance(_docs(s, d), ["source", "is_ai"], {("is_ai", "0"): 0.5, ("is_ai", "1"): 0.5})


@q(f"WITH r AS (SELECT doc_id, is_ai, row_number() OVER (PARTITION BY is_ai ORDER BY {_MD5.format('split')}, doc_id) AS k, count(*) OVER (PARTITION BY is_ai) AS n FROM documents WHERE is_ai IS NOT NULL) SELECT doc_id, CASE WHEN k <= floor(n * 0.2e0) THEN 'test' ELSE 'train' END AS part FROM r")
def stratified_split(s, d):
    return sampling.train_test(_docs(s, d).filter("is_ai is not null").select("doc_id", "is_ai"), "is_ai", "doc_id").select("doc_id", "part")


@q(f"WITH r AS (SELECT doc_id, row_number() OVER (PARTITION BY is_ai ORDER BY {_MD5.format('fold')}, doc_id) AS k FROM documents WHERE is_ai IS NOT NULL) SELECT doc_id, CAST((k - 1) % 5 AS INTEGER) AS fold FROM r")
def kfold_assign(s, d):
    return sampling.folds(_docs(s, d).filter("is_ai is not null").select("doc_id", "is_ai"), "is_ai", "doc_id").select("doc_id", "fold")


@q("SELECT is_ai AS label, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * CAST(count(*) AS DOUBLE)), 6) AS weight FROM documents WHERE is_ai IS NOT NULL GROUP BY is_ai")
def class_weights(s, d):
    return stats.class_weights(_docs(s, d), "is_ai")


@q("WITH m AS (SELECT id, 1 AS one FROM generations WHERE id IS NOT NULL GROUP BY id), r AS (SELECT id, row_number() OVER (ORDER BY md5(concat_ws('|', id, 'presample'))) AS k FROM m) SELECT id FROM r WHERE k <= 500")
def presample_rows(s, d):
    return sampling.presample(read_table(s, d, "generations").filter("id is not null").select("id").distinct(), 500, "id")


#: The strata of the samples: classes in given shares, their sources evenly, and inside as the domains are.
STRATA = [sampling.Dimension("is_ai", {0: 0.6, 1: 0.4}), sampling.Dimension("source", even=True), sampling.Dimension("domain")]


@q()
def stratified_by_weights(s, d):
    return sampling.stratified_by(_docs(s, d).select("doc_id", "is_ai", "source", "domain"), 300, STRATA, "doc_id")


@q()
def many_samples(s, d):
    return sampling.many_samples(_docs(s, d).select("doc_id", "is_ai", "source", "domain"), 100, STRATA, "doc_id", 3)


@q()
def prepared_corpus(s, d):
    """Labelled, filtered, deduplicated, normalized and gated generations."""
    label = F.when(F.col("model").isNotNull(), (F.lower(F.trim("model")) != "human").cast("int"))
    return sampling.prepared_corpus(read_table(s, d, "generations").filter("id is not null").select("id", "generation", "model", "domain"), "generation", "id", label, {"domain": ("speech",)})


@q("SELECT source, domain AS most_common, n FROM (SELECT source, domain, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, domain) AS k FROM documents WHERE domain IS NOT NULL GROUP BY source, domain) AS x WHERE k = 1")
def most_common_domain(s, d):
    return quality.most_common(_docs(s, d), ["source"], "domain")


@q("WITH " + " UNION ALL ".join(f"SELECT '{f}' AS feature, count(*) FILTER (WHERE {f} IS NULL OR isnan({f}::DOUBLE)) AS n_missing, count(*) FILTER (WHERE isinf({f}::DOUBLE)) AS n_infinite, coalesce(max({f}) FILTER (WHERE isfinite({f}::DOUBLE)) = min({f}) FILTER (WHERE isfinite({f}::DOUBLE)), true) AS constant FROM stylometric_features" for f in FEATURES).join(("x AS (", ") SELECT feature, n_missing, n_infinite, constant FROM x")))
def validation_report(s, d):
    return quality.validation(_features(s, d), FEATURES).drop("approx_rate")


@q("WITH " + _BASE + ", m AS (SELECT " + ", ".join(f"median({f}) AS m_{f}" for f in FEATURES) + " FROM base) SELECT row_id, " + ", ".join(f"round(coalesce({f}, m_{f}, 0), 6) AS {f}" for f in FEATURES) + " FROM base CROSS JOIN m")
def fill_median(s, d):
    return quality.fill_plain(_features(s, d), FEATURES).select("row_id", *[F.round(f, 6).alias(f) for f in FEATURES])


@q("WITH " + _BASE + ", m AS (SELECT " + ", ".join(f"avg({f}) AS m_{f}" for f in FEATURES) + " FROM base) SELECT row_id, " + ", ".join(f"round(coalesce({f}, m_{f}, 0), 5) AS {f}" for f in FEATURES) + " FROM base CROSS JOIN m")
def fill_mean(s, d):
    return quality.fill_plain(_features(s, d), FEATURES, "mean").select("row_id", *[F.round(f, 5).alias(f) for f in FEATURES])


@q()
def quick_clean(s, d):
    return quality.quick_clean(_features(s, d))[0]


@q()
def significance_by_family(s, d):
    return stats.summary_by_family(stats.significance(_features(s, d), FEATURES, "is_ai"), {"lexical": FEATURES[:4], "syntactic": FEATURES[4:]})


_PRED = "p AS (SELECT is_ai AS y, CASE WHEN avg_sentence_length > 13 THEN 1 ELSE 0 END AS z, avg_word_length AS score FROM base WHERE is_ai IS NOT NULL AND avg_sentence_length IS NOT NULL)"


def _predictions(s, d) -> DataFrame:
    t = _features(s, d).select("is_ai", quality.finite("avg_sentence_length").alias("x"), quality.finite("avg_word_length").alias("score")).filter("is_ai is not null and x is not null")
    return t.select(F.col("is_ai").alias("y"), F.when(F.col("x") > 13, 1).otherwise(0).alias("z"), "score")


@q(f"WITH {_BASE}, {_PRED}, c AS (SELECT count(CASE WHEN y = 1 AND z = 1 THEN 1 END) AS tp, count(CASE WHEN y <> 1 AND z = 1 THEN 1 END) AS fp, count(CASE WHEN y = 1 AND z <> 1 THEN 1 END) AS fn, count(CASE WHEN y <> 1 AND z <> 1 THEN 1 END) AS tn FROM p), m AS (SELECT *, tp / CAST(NULLIF(tp + fp, 0) AS DOUBLE) AS pr, tp / CAST(NULLIF(tp + fn, 0) AS DOUBLE) AS re FROM c) SELECT tp, fp, fn, tn, round((tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE), 6) AS accuracy, round(pr, 6) AS precision, round(re, 6) AS recall, round(2 * pr * re / NULLIF(pr + re, 0), 6) AS f1 FROM m")
def confusion_metrics(s, d):
    return stats.confusion(_predictions(s, d), "y", "z")


@q(f"WITH {_BASE}, {_PRED}, r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0e0 AS r FROM p WHERE score IS NOT NULL), c AS (SELECT sum(CASE WHEN y = 1 THEN r END) AS rs, CAST(count(CASE WHEN y = 1 THEN 1 END) AS DOUBLE) AS np, CAST(count(CASE WHEN y = 0 THEN 1 END) AS DOUBLE) AS nn FROM r) SELECT round((rs - np * (np + 1) / 2) / (np * nn), 6) AS roc_auc FROM c")
def roc_auc(s, d):
    return stats.roc_auc(_predictions(s, d), "y", "score")


@q("SELECT coalesce(a.id, b.id) AS id, a.n_features, b.n_texts FROM (SELECT id, count(*) AS n_features FROM stylometric_features GROUP BY id) AS a FULL JOIN (SELECT id, count(*) AS n_texts FROM generations GROUP BY id) AS b ON a.id = b.id")
def feature_merge_outer(s, d):
    a = _features(s, d).groupBy("id").agg(F.count("*").alias("n_features"))
    return quality.merge_outer([a, read_table(s, d, "generations").groupBy("id").agg(F.count("*").alias("n_texts"))], "id")


@q("SELECT g.id, g.n, s.n AS n_style FROM (SELECT id, count(*) AS n FROM generations GROUP BY id) AS g JOIN (SELECT id, count(*) AS n FROM stylometric_features GROUP BY id) AS s ON s.id = g.id")
def family_inner_join(s, d):
    labels = read_table(s, d, "generations").groupBy("id").agg(F.count("*").alias("n"))
    return quality.join_families(labels, {"style": _features(s, d).groupBy("id").agg(F.count("*").alias("n"))}, "id")


@q("SELECT g.id, CASE WHEN s.id IS NULL THEN 'train' ELSE 'external' END AS part FROM (SELECT DISTINCT id FROM generations) AS g LEFT JOIN (SELECT DISTINCT id FROM stylometric_features) AS s ON s.id = g.id")
def id_overlap_split(s, d):
    g, f = read_table(s, d, "generations").select("id").distinct(), _features(s, d).select("id").distinct()
    return g.join(f, "id", "left_semi").withColumn("part", F.lit("external")).unionByName(g.join(f, "id", "left_anti").withColumn("part", F.lit("train")))


@q("SELECT row_id, " + ", ".join(f"{f} AS base_{f}" for f in FEATURES[:2]) + " FROM stylometric_features")
def prefix_rename(s, d):
    return quality.add_prefix(_features(s, d).select("row_id", *FEATURES[:2]), "base_", "row_id")


@q("SELECT source FROM documents INTERSECT SELECT source FROM mix_targets")
def set_intersection(s, d):
    return _docs(s, d).select("source").intersect(read_table(s, d, "mix_targets").select("source"))


@q("SELECT source FROM documents EXCEPT SELECT source FROM mix_targets")
def set_difference(s, d):
    return _docs(s, d).select("source").subtract(read_table(s, d, "mix_targets").select("source"))


@q("SELECT doc_id, n_chars, rank_no FROM (SELECT doc_id, n_chars, CAST(row_number() OVER (ORDER BY n_chars DESC, doc_id) AS INTEGER) AS rank_no FROM documents WHERE n_chars IS NOT NULL) AS x WHERE rank_no <= 20")
def top_documents(s, d):
    top = _docs(s, d).filter("n_chars is not null").orderBy(F.desc("n_chars"), "doc_id").limit(20)
    return top.select("doc_id", "n_chars", F.row_number().over(W.orderBy(F.desc("n_chars"), "doc_id")).alias("rank_no"))


@q()
def clean_features(s, d):
    return quality.clean(_features(s, d).select("row_id", *FEATURES), FEATURES, group=quality.length_bin("n_tokens_doc"))[0]


@q("SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_hourly(s, d):
    w = F.window("ts", "1 hour")
    return read_table(s, d, "events").groupBy("event_type", w).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.col("window.start").alias("hour"), "n", "total")


QUERIES = {f.__name__: f for f in _QUERIES}
