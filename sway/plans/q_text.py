"""Queries: text features, cue flags, quote folding, token cost, corpus totals, slugs (step 6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sway.functions import features as FT
from sway.functions.parse import slugify
from sway.plans.catalog import query
from sway.sources.tables import read_table, spread


def _docs(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")


def _duck_flag(alts: str, bounded: bool) -> str:
    if bounded:
        pat = "(?i)(^|[^\\p{L}\\p{N}_])(?:" + alts + ")([^\\p{L}\\p{N}_]|$)"
    else:
        pat = "(?i)(?:" + alts + ")"
    return "regexp_matches(t, '" + pat.replace("'", "''") + "')"


# Letters beyond ASCII, which the oracle's word boundaries don't know: each is read as an x.
_LETTERS = r"[\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2C1}\x{300}-\x{1FFF}\x{2C00}-\x{2DFF}\x{3005}-\x{D7FF}]"
# White space as Unicode has it.
_SPACE = r"\t-\r \x{85}\p{Z}"


def feature_ctes(source: str, key: str) -> str:
    """CTE ``tf``: ``key`` and every text feature of the relation ``source`` (key, text)."""
    count = lambda of, pattern: f"len(regexp_extract_all({of}, '{pattern}'))::INTEGER"
    flags = ", ".join(f"{_duck_flag(alts, bounded)} AS {name}" for name, (alts, bounded) in FT.FLAGS.items())
    return rf"""
tf_text AS (SELECT {key}, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '{_LETTERS}', 'x', 'g') AS w FROM {source}),
tf_counts AS (SELECT {key}, length(t)::INTEGER AS char_count, {count('t', f'[^{_SPACE}]+')} AS word_count,
  greatest({count('t', '[.!?]+')}, 1) AS sentence_count, {count('t', r'[\p{Nd}]')} AS digit_count,
  length(regexp_replace(t, '[{_SPACE}]+', '', 'g')) AS solid, greatest({count('lower(t)', '[aeiouy]+')}, 1) AS syllable_count_est,
  {flags}, contains(t, '?') AS has_question_mark, regexp_matches(t, '["'']') AS has_quote_mark, {_duck_flag(FT.STATS_TERMS, True)} AS stats_hit,
  {_duck_flag(FT.STRICT_STATS, True)} AS strict_hit, {count('t', FT.PERCENT)} AS percent_count,
  {count('w', rf'\b({FT.SOURCE_CUES})\b')} AS source_cue_count, {count('w', rf'\b({FT.NORMATIVE})\b')} AS normative_cue_count,
  {count('w', rf'\b(?:{FT.STATS_TERMS})\b')} AS stats_term_count, {count('t', r'\[[\p{Nd}]+\]')} AS citation_count FROM tf_text),
tf AS (SELECT * EXCLUDE (solid, stats_hit, strict_hit), has_number OR has_percent OR stats_hit AS has_statistics, has_source_cue OR has_citation_marker AS has_source,
  has_citation_marker AS has_strict_source, percent_count > 0 OR strict_hit AS has_strict_statistics, digit_count / greatest(char_count, 1) AS number_density,
  solid / greatest(word_count, 1) AS avg_word_length, word_count / sentence_count AS avg_sentence_length_words,
  0.39 * (word_count / sentence_count) + 11.8 * (syllable_count_est / greatest(word_count, 1)) - 15.59 AS flesch_kincaid_grade_est,
  100 * percent_count / greatest(word_count, 1) AS percent_count_per_100_words, 100 * source_cue_count / greatest(word_count, 1) AS source_cue_count_per_100_words,
  100 * normative_cue_count / greatest(word_count, 1) AS normative_cue_count_per_100_words, 100 * citation_count / greatest(word_count, 1) AS citation_count_per_100_words,
  100 * (digit_count + stats_term_count) / greatest(word_count, 1) AS stats_cue_count_per_100_words FROM tf_counts)"""


_RATES = ("number_density", "avg_word_length", "avg_sentence_length_words", "flesch_kincaid_grade_est", "percent_count_per_100_words",
          "source_cue_count_per_100_words", "normative_cue_count_per_100_words", "citation_count_per_100_words", "stats_cue_count_per_100_words")


@query("text_features", f"WITH {feature_ctes('documents', 'doc_id')} SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in _RATES)}) FROM tf")
def q_text_features(spark, sf_dir):
    """All 37 lexical/readability features per evidence text (documents)."""
    d = spread(_docs(spark, sf_dir), "doc_id")
    return d.select("doc_id", *FT.text_features(F.col("text")))


def _cue_sql() -> str:
    cols = [f"{_duck_flag(a, b)} AS {k}" for k, (a, b) in FT.FLAGS.items()]
    return (
        "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS (SELECT doc_id, "
        + ", ".join(cols)
        + ", contains(t, '?') AS has_question_mark, regexp_matches(t, '[\"'']') AS has_quote_mark, "
        + _duck_flag(FT.STATS_TERMS, True) + " AS stats_hit, "
        + "regexp_matches(t, '" + FT.PERCENT + "') AS pct_hit, "
        + _duck_flag(FT.STRICT_STATS, True) + " AS strict_hit FROM d) "
        "SELECT doc_id, has_number, has_percent, has_source_cue, has_uncertainty, has_causal_language, "
        "has_normative_language, has_policy_legal_terms, has_health_safety_terms, has_economic_terms, "
        "has_comparative_language, has_negation, has_citation_marker, has_question_mark, has_quote_mark, "
        "has_number OR has_percent OR stats_hit AS has_statistics, has_source_cue OR has_citation_marker AS has_source, "
        "has_citation_marker AS has_strict_source, pct_hit OR strict_hit AS has_strict_statistics FROM f"
    )


@query("cue_flags", _cue_sql())
def q_cue_flags(spark, sf_dir):
    """Case-insensitive, Unicode-word-bounded cue flags per document."""
    return spread(_docs(spark, sf_dir), "doc_id").select("doc_id", *FT.cue_flags(F.col("text")))


def _quote_sql() -> str:
    expr = "text"
    for k, v in FT.QUOTE_EXPAND.items():
        expr = f"replace({expr}, chr({ord(k)}), '{v}')"
    for k, v in FT.QUOTE_MAP.items():
        expr = f"replace({expr}, chr({ord(k)}), '{v.replace(chr(39), chr(39) * 2)}')"
    return (f"WITH n AS (SELECT doc_id, {expr} AS t FROM documents) "
            "SELECT doc_id, CAST(length(t) AS INTEGER) AS n_chars_normalised, sha1(t) AS text_sha1 FROM n")


@query("quote_normalise", _quote_sql())
def q_quote_normalise(spark, sf_dir):
    """Typographic punctuation folded to ASCII; length and digest of the result per document."""
    n = FT.normalize_quotes(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.length(n).alias("n_chars_normalised"),
                                       F.sha1(n).alias("text_sha1"))


# Price per million tokens (input, output) of the priced models.
PRICES = (("gpt-4o-mini", 0.075, 0.30), ("gpt-4o", 1.25, 5.00), ("grok-3", 3.00, 15.00),
          ("grok-3-mini", 0.30, 0.50))


@query("token_cost", """
WITH t AS (SELECT count(*) AS n_prompts, sum(floor(length(text) / 4)) AS input_tokens FROM conversations
           WHERE role = 'user'),
p AS (SELECT * FROM (VALUES ('gpt-4o-mini', 0.075, 0.30), ('gpt-4o', 1.25, 5.00), ('grok-3', 3.00, 15.00),
        ('grok-3-mini', 0.30, 0.50)) v(model, price_in, price_out))
SELECT p.model, t.n_prompts, CAST(t.input_tokens AS BIGINT) AS input_tokens,
  round(t.input_tokens * 0.005, 6) AS output_tokens,
  round(t.input_tokens / 1e6 * price_in + t.input_tokens * 0.005 / 1e6 * price_out, 6) AS cost_usd
FROM t CROSS JOIN p
""")
def q_token_cost(spark, sf_dir):
    """Prompt token estimate (characters / 4, per prompt), replies at 0.5 % of the input,
    and the cost under each priced model.  One aggregate, then the short price list
    is expanded with ``explode`` on that single row."""
    c = read_table(spark, sf_dir, "conversations").select("role", "text").filter(F.col("role") == "user")
    t = c.agg(F.count(F.lit(1)).alias("n_prompts"),
              F.sum(F.floor(F.length("text") / 4)).cast("bigint").alias("input_tokens"))
    prices = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(i).alias("pi"), F.lit(o).alias("po"))
                       for m, i, o in PRICES])
    t = t.select("*", F.explode(prices).alias("p"))
    out_tok = F.col("input_tokens") * 0.005
    return t.select(F.col("p.model").alias("model"), "n_prompts", "input_tokens", out_tok.alias("output_tokens"),
                    (F.col("input_tokens") / 1e6 * F.col("p.pi") + out_tok / 1e6 * F.col("p.po")).alias("cost_usd"))


@query("corpus_totals", """
SELECT count(DISTINCT topic) AS topics, count(*) FILTER (WHERE side = 'pro') AS pro_arguments,
  count(*) FILTER (WHERE side = 'con') AS con_arguments,
  count(*) FILTER (WHERE side = 'pro' AND contains(text, '"')) AS pro_quotes,
  count(*) FILTER (WHERE side = 'con' AND contains(text, '"')) AS con_quotes
FROM arguments
""")
def q_corpus_totals(spark, sf_dir):
    """Topics, pro/con arguments and quoted arguments (arguments of a topic = its documents)."""
    from sway.sources import fixtures as fx
    d = fx.arguments(spark, sf_dir)
    pro, quoted = F.col("side") == "pro", F.instr("text", '"') > 0
    return d.agg(F.countDistinct("topic").alias("topics"), F.count_if(pro).alias("pro_arguments"),
                 F.count_if(~pro).alias("con_arguments"), F.count_if(pro & quoted).alias("pro_quotes"),
                 F.count_if(~pro & quoted).alias("con_quotes"))


@query("page_slugs", """
SELECT page_id, replace(string_split(regexp_replace(url, '/+$', ''), '/')[-1], '-debate', '') AS slug FROM pages
""")
def q_page_slugs(spark, sf_dir):
    """URL -> topic slug (last path segment without ``-debate``)."""
    p = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return p.select("page_id", slugify(F.col("url")).alias("slug"))
