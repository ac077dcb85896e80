"""Queries: per-argument evidence effects and their cross-model patterns (build step 7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sway.functions import features as FT
from sway.functions.splits import positions_ctes
from sway.operators import evidence as EV
from sway.plans.catalog import query
from sway.plans.oracle import fisher_two_sided_sql, mann_whitney_exact_sql, normal_two_sided_sql, t_p_sql
from sway.plans.q_text import feature_ctes
from sway.sources import fixtures as fx
from sway.sources.tables import read_table, spread

_EFFECTS = """
WITH ev AS (SELECT doc_id AS evidence_id, sha256(text) AS evidence_hash FROM documents),
nd AS (SELECT max(doc_id) + 1 AS n FROM documents),
te AS (SELECT model, issue, paraphrase_idx AS question, issue_stance, unnest(
         CASE WHEN ecase = 'neither' THEN [NULL]
              WHEN trial_num % 2 = 0 THEN [(l_partkey * 7 + l_orderkey) % n, (l_partkey + l_orderkey * 13) % n]
              ELSE [(l_partkey * 7 + l_orderkey) % n] END) AS evidence_id FROM trials, nd),
t AS (SELECT te.*, ev.evidence_hash FROM te LEFT JOIN ev ON ev.evidence_id = te.evidence_id),
base AS (SELECT model, issue, question, count(*) FILTER (WHERE issue_stance = 'pro') / count(*) AS proportion
         FROM t WHERE evidence_hash IS NULL GROUP BY model, issue, question),
we AS (SELECT model, issue, question, evidence_hash, count(*) FILTER (WHERE issue_stance = 'pro') AS pro_n,
         count(*) AS tot FROM t WHERE evidence_hash IS NOT NULL GROUP BY model, issue, question, evidence_hash),
m AS (SELECT we.*, pro_n / tot - b.proportion AS shift FROM we LEFT JOIN base b USING (model, issue, question)),
effects AS (SELECT model, evidence_hash, round(sum(shift * tot) / sum(tot), 12) AS average_proportion_shift,
              CAST(sum(tot) AS BIGINT) AS n_trials FROM m GROUP BY model, evidence_hash),
summary AS (SELECT evidence_hash, count(average_proportion_shift) AS n_models,
              median(average_proportion_shift) AS median_shift, avg(average_proportion_shift) AS mean_shift,
              median(abs(average_proportion_shift)) AS median_abs_shift,
              avg(abs(average_proportion_shift)) AS mean_abs_shift,
              CASE WHEN count(average_proportion_shift) > 0 THEN
                greatest(count(*) FILTER (WHERE average_proportion_shift > 0),
                         count(*) FILTER (WHERE average_proportion_shift < 0)) / count(average_proportion_shift) END
                AS sign_agreement_rate,
              round(stddev_samp(average_proportion_shift), 12) AS between_model_std
            FROM effects GROUP BY evidence_hash),
a AS (SELECT * FROM summary WHERE n_models >= 3),
labels AS (SELECT a.*, CASE WHEN between_model_std IS NULL THEN 'insufficient-variance-info'
             WHEN sign_agreement_rate >= 0.9 AND between_model_std <= (SELECT median(between_model_std) FROM a)
               THEN 'consensus-effective'
             WHEN sign_agreement_rate < 0.9 AND between_model_std > (SELECT median(between_model_std) FROM a)
               THEN 'polarizing-effective'
             WHEN sign_agreement_rate >= 0.9 THEN 'agreement-with-variable-strength'
             ELSE 'mixed-direction-moderate-variance' END AS evidence_effect_pattern FROM a)
"""


def _evidence_docs(spark, sf_dir):
    """Every document is an evidence item."""
    return read_table(spark, sf_dir, "documents").select("doc_id", "text")


def _evidence(spark, sf_dir):
    d = _evidence_docs(spark, sf_dir)
    return d.select(F.col("doc_id").alias("evidence_id"), F.sha2("text", 256).alias("evidence_hash"))


def _effects(spark, sf_dir):
    """Per (model, evidence item) effects: bounded by models x items, materialised once
    because summaries, labels, ranks and thresholds all read it."""
    from sway.session import materialize
    t = fx.evidence_trials(spark, sf_dir).select("model", "issue", F.col("paraphrase_idx").alias("question"),
                                                 "evidence_ids", "issue_stance")
    return materialize(EV.evidence_effect(t, _evidence(spark, sf_dir)))


@query("evidence_effect", _EFFECTS + """
SELECT model, evidence_hash, round(average_proportion_shift, 6) AS average_proportion_shift, n_trials FROM effects
""")
def q_evidence_effect(spark, sf_dir):
    return _effects(spark, sf_dir)


@query("evidence_summary", _EFFECTS + """
SELECT evidence_hash, n_models, round(median_shift, 6) AS median_shift, round(mean_shift, 6) AS mean_shift,
  round(median_abs_shift, 6) AS median_abs_shift, round(mean_abs_shift, 6) AS mean_abs_shift,
  round(sign_agreement_rate, 6) AS sign_agreement_rate, round(between_model_std, 6) AS between_model_std
FROM summary
""")
def q_evidence_summary(spark, sf_dir):
    return EV.evidence_summary(_effects(spark, sf_dir))


@query("pattern_labels", _EFFECTS + """
SELECT evidence_hash, n_models, round(median_abs_shift, 6) AS median_abs_shift,
  round(sign_agreement_rate, 6) AS sign_agreement_rate, round(between_model_std, 6) AS between_model_std,
  evidence_effect_pattern FROM labels
""")
def q_pattern_labels(spark, sf_dir):
    lab = EV.pattern_labels(EV.evidence_summary(_effects(spark, sf_dir)))
    return lab.select("evidence_hash", "n_models", "median_abs_shift", "sign_agreement_rate",
                      "between_model_std", "evidence_effect_pattern")


@query("pattern_counts", _EFFECTS + """
SELECT evidence_effect_pattern, count(*) AS n_items FROM labels GROUP BY evidence_effect_pattern
""")
def q_pattern_counts(spark, sf_dir):
    lab = EV.pattern_labels(EV.evidence_summary(_effects(spark, sf_dir)))
    return lab.groupBy("evidence_effect_pattern").agg(F.count(F.lit(1)).alias("n_items"))


# The twelve features of the pattern and multivariate tables.
PATTERN_FEATURES = ("has_percent", "has_normative_language", "has_source_cue", "has_strict_source",
                    "has_strict_statistics", "avg_word_length", "flesch_kincaid_grade_est",
                    "percent_count_per_100_words", "source_cue_count_per_100_words",
                    "normative_cue_count_per_100_words", "stats_cue_count_per_100_words",
                    "citation_count_per_100_words")

# The items that the analyses share: labels joined to the features of their texts.
_ITEMS = _EFFECTS + f""", docs AS (SELECT DISTINCT sha256(text) AS evidence_hash, text FROM documents WHERE text IS NOT NULL),
{feature_ctes("docs", "evidence_hash")},
it AS MATERIALIZED (SELECT labels.evidence_hash, labels.median_abs_shift, labels.evidence_effect_pattern, {", ".join("tf." + c for c in PATTERN_FEATURES)}
  FROM labels JOIN tf USING (evidence_hash))
"""
_AS_DOUBLE = ", ".join(f"{c}::DOUBLE AS {c}" for c in PATTERN_FEATURES)


def _long_sql(features) -> str:
    return " UNION ALL ".join(f"SELECT evidence_hash, evidence_effect_pattern, median_abs_shift AS y, '{c}' AS feature, {c}::DOUBLE AS value FROM it" for c in features)


def _ranked(value: str, keys: str, digits: int = 12) -> str:
    """Average ranks within ``keys``, as a window expression."""
    rounded = f"round({value}, {digits}) + 0.0"
    return f"rank() OVER (PARTITION BY {keys} ORDER BY {rounded}) + (count(*) OVER (PARTITION BY {keys}, {rounded}) - 1) / 2.0"


def _item_features(spark, sf_dir):
    """Text features per evidence item (one row per distinct evidence hash).

    Features are computed on the referenced evidence documents only and deduplicated by
    their hash (identical texts have identical features), never by shuffling full texts."""
    d = spread(_evidence_docs(spark, sf_dir), "doc_id")
    f = d.select(F.sha2("text", 256).alias("evidence_hash"),
                 *FT.pattern_features(F.col("text")))
    f = f.select("evidence_hash", *[F.col(c).cast("double").alias(c) for c in PATTERN_FEATURES])
    return f.groupBy("evidence_hash").agg(*[F.max(c).alias(c) for c in PATTERN_FEATURES])


@query("pattern_means", _ITEMS + "SELECT evidence_effect_pattern, count(*) AS n_items, "
       + ", ".join(f"round(avg({c}::DOUBLE), 6) AS {c}" for c in PATTERN_FEATURES) + " FROM it GROUP BY evidence_effect_pattern")
def q_pattern_means(spark, sf_dir):
    """Mean of each feature per pattern with the group size."""
    lab = EV.pattern_labels(EV.evidence_summary(_effects(spark, sf_dir)))
    j = lab.join(_item_features(spark, sf_dir), "evidence_hash")
    return j.groupBy("evidence_effect_pattern").agg(
        F.count(F.lit(1)).alias("n_items"), *[F.avg(c).alias(c) for c in PATTERN_FEATURES])


_SPEARMAN = f"""
, lf AS (SELECT feature, {_ranked("value", "feature", 10)} AS rv, {_ranked("y", "feature", 10)} AS rt FROM (FEATURES)),
sp AS (SELECT feature, CASE WHEN stddev_pop(rv) > 0 AND stddev_pop(rt) > 0 THEN corr(rv, rt) END AS rho, count(*) AS n FROM lf GROUP BY feature)
"""


@query("spearman_features", _ITEMS + _SPEARMAN.replace("FEATURES", _long_sql(PATTERN_FEATURES)) + "SELECT feature, round(rho, 6) AS spearman_rho, n FROM sp")
def q_spearman_features(spark, sf_dir):
    """Spearman rho between each feature and the median absolute shift over items seen by
    at least three models (average ranks)."""
    j = _analysis_items(spark, sf_dir)
    stack = ", ".join(f"'{c}', {c}" for c in PATTERN_FEATURES)
    long = j.selectExpr("evidence_hash", "median_abs_shift",
                        f"stack({len(PATTERN_FEATURES)}, {stack}) AS (feature, value)")
    return EV.spearman_by_feature(long, "median_abs_shift")


@query("pair_alignment", _EFFECTS + """
, rk AS (SELECT model, evidence_hash, average_proportion_shift AS s,
           rank() OVER (PARTITION BY model ORDER BY round(average_proportion_shift, 12))
           + (count(*) OVER (PARTITION BY model, round(average_proportion_shift, 12)) - 1) / 2.0 AS r
         FROM effects WHERE average_proportion_shift IS NOT NULL)
SELECT a.model AS model_a, b.model AS model_b, count(*) AS n, round(corr(a.s, b.s), 6) AS pearson_r,
  round(corr(a.r, b.r), 6) AS spearman_rho
FROM rk a JOIN rk b ON a.evidence_hash = b.evidence_hash AND a.model < b.model
GROUP BY a.model, b.model
""")
def q_pair_alignment(spark, sf_dir):
    """Agreement of two models' per-item effects: Pearson and Spearman (average ranks) for
    every model pair, computed column-wise after one pivot of items x models.  Ranks are
    taken per model over its items (every model covers every item here)."""
    from sway.functions.stats import pearson
    from sway.operators.ranks import average_rank

    e = _effects(spark, sf_dir).filter(F.col("average_proportion_shift").isNotNull())
    r = average_rank(e, ["model"], "average_proportion_shift", "r")
    wide = r.groupBy("evidence_hash").pivot("model").agg(
        F.first("average_proportion_shift").alias("s"), F.first("r").alias("r"))
    models = sorted({c.rsplit("_", 1)[0] for c in wide.columns if c != "evidence_hash"})
    aggs, names = [], []
    for i, a in enumerate(models):
        for b in models[i + 1:]:
            sa, sb, ra, rb = (F.col(f"`{m}_{k}`") for m, k in ((a, "s"), (b, "s"), (a, "r"), (b, "r")))
            aggs += [F.count(F.when(sa.isNotNull() & sb.isNotNull(), 1)), pearson(sa, sb), pearson(ra, rb)]
            names.append((a, b))
    row = wide.agg(*[x.alias(f"c{k}") for k, x in enumerate(aggs)])
    stack = ", ".join(f"'{a}', '{b}', c{3 * k}, c{3 * k + 1}, c{3 * k + 2}" for k, (a, b) in enumerate(names))
    return row.selectExpr(f"stack({len(names)}, {stack}) AS (model_a, model_b, n, pearson_r, spearman_rho)")


# ---- feature associations, pattern tests, family gaps ----

from sway.operators import evstats as ES  # noqa: E402

BINARY_FEATURES = PATTERN_FEATURES[:5]
NUMERIC_FEATURES = PATTERN_FEATURES[5:]


def _analysis_items(spark, sf_dir):
    """Items seen by >= 3 models with their labels and features: one row per evidence item
    (bounded by the study design) that several statistics reuse, so its lineage is cut with
    a reliable checkpoint in the shared checkpoint folder."""
    lab = EV.pattern_labels(EV.evidence_summary(_effects(spark, sf_dir)))
    return lab.join(_item_features(spark, sf_dir), "evidence_hash").checkpoint()


def _gaps_sql() -> str:
    unions = " UNION ALL ".join(f"SELECT evidence_hash, median_abs_shift AS y, '{k}' AS feature, {k} AS flag FROM it" for k in BINARY_FEATURES)
    return _ITEMS.replace("WITH", "WITH RECURSIVE", 1) + f"""
, long AS ({unions}),
obs AS (SELECT feature, count(*) FILTER (WHERE flag) AS n_true, count(*) FILTER (WHERE NOT flag) AS n_false,
          median(y) FILTER (WHERE flag) - median(y) FILTER (WHERE NOT flag) AS gap FROM long GROUP BY feature),
ok AS (SELECT feature FROM obs WHERE n_true >= 5 AND n_false >= 5),
v AS (SELECT l.feature, l.flag, l.y, row_number() OVER (PARTITION BY l.feature, l.flag ORDER BY l.y) - 1 AS idx
      FROM long l JOIN ok USING (feature)),
sz AS (SELECT feature, flag, count(*) AS n,
         ('0x' || substr(md5(concat_ws(':', '42', feature, CASE WHEN flag THEN 'true' ELSE 'false' END)), 1, 7))::BIGINT AS salt FROM v GROUP BY feature, flag),
{positions_ctes("sz", ["feature", "flag"], 3000)},
reps AS (SELECT dx.feature, dx.b, avg(v.y) FILTER (WHERE dx.flag) - avg(v.y) FILTER (WHERE NOT dx.flag) AS g
         FROM drawn dx JOIN v ON v.feature = dx.feature AND v.flag = dx.flag AND v.idx = dx.i GROUP BY dx.feature, dx.b),
ci AS (SELECT feature, quantile_cont(g, 0.025) AS lo, quantile_cont(g, 0.975) AS hi FROM reps GROUP BY feature),
gaps AS (SELECT obs.feature, 'binary' AS feature_type, n_true, n_false,
  round(CASE WHEN n_true >= 5 AND n_false >= 5 THEN gap END, 6) AS effectiveness_gap_true_minus_false,
  round(lo, 6) AS gap_ci_lower, round(hi, 6) AS gap_ci_upper
FROM obs LEFT JOIN ci USING (feature))
"""


@query("feature_gaps", _gaps_sql() + "SELECT * FROM gaps")
def q_feature_gaps(spark, sf_dir):
    """Binary text features: median |shift| gap (true - false) with a 3 000-draw bootstrap
    interval (keyed draws, reproduced by the oracle)."""
    return ES.binary_feature_gaps(_analysis_items(spark, sf_dir), list(BINARY_FEATURES), "median_abs_shift", 3000)


@query("feature_associations", _gaps_sql() + _SPEARMAN.replace("FEATURES", _long_sql(NUMERIC_FEATURES)) + f"""
SELECT *, NULL::DOUBLE AS spearman_rho, NULL::DOUBLE AS spearman_p_value FROM gaps
UNION ALL SELECT feature, 'numeric', NULL, NULL, NULL, NULL, NULL, round(rho, 6),
  round(CASE WHEN n > 2 AND rho IS NOT NULL THEN CASE WHEN abs(rho) >= 1 THEN 0 ELSE {t_p_sql("(rho * sqrt((n - 2) / (1 - rho * rho)))", "(n - 2)")} END END, 6) FROM sp
""")
def q_feature_associations(spark, sf_dir):
    """Association table: binary gaps with intervals, numeric Spearman rho and p."""
    items = _analysis_items(spark, sf_dir)
    gaps = ES.binary_feature_gaps(items, list(BINARY_FEATURES), "median_abs_shift", 3000)
    stack = ", ".join(f"'{c}', {c}" for c in NUMERIC_FEATURES)
    long = items.selectExpr("evidence_hash", "median_abs_shift",
                            f"stack({len(NUMERIC_FEATURES)}, {stack}) AS (feature, value)")
    sp = ES.spearman_with_p(long, "median_abs_shift").select(
        "feature", F.lit("numeric").alias("feature_type"), "spearman_rho", "spearman_p_value")
    out = gaps.unionByName(sp, allowMissingColumns=True)
    return out.orderBy(F.col("effectiveness_gap_true_minus_false").desc_nulls_last(),
                       F.col("spearman_rho").desc_nulls_last())


def _pattern_tests_sql() -> str:
    cells = {"a": "s1", "b": "(n1 - s1)", "c": "(S - s1)", "d": "(n2 - (S - s1))"}
    binary = ", ".join(f"'{c}'" for c in BINARY_FEATURES)
    return _ITEMS + f""", lf AS (SELECT *, {_ranked("value", "feature")} AS rk FROM ({_long_sql(PATTERN_FEATURES)})),
tot AS (SELECT feature, count(*) AS N, sum(value) AS S, sum(value * value) AS SS FROM lf GROUP BY feature),
ties AS (SELECT feature, sum(t * t * t - t) AS tie FROM (SELECT feature, count(*)::DOUBLE AS t FROM lf GROUP BY feature, round(value, 12)) GROUP BY feature),
per AS (SELECT feature, evidence_effect_pattern AS pattern, count(*) AS n1, sum(value) AS s1, sum(value * value) AS ss1, sum(rk) AS r1 FROM lf GROUP BY ALL),
joined AS (SELECT *, N - n1 AS n2, s1 / n1 AS m1, CASE WHEN N > n1 THEN (S - s1) / (N - n1) END AS m2, r1 - n1 * (n1 + 1) / 2 AS u1, feature IN ({binary}) AS bin
      FROM per JOIN tot USING (feature) JOIN ties USING (feature)),
spread AS (SELECT *, CASE WHEN n1 > 1 THEN (ss1 - n1 * m1 * m1) / (n1 - 1) ELSE 0 END AS v1,
        CASE WHEN n2 > 1 THEN (SS - ss1 - n2 * m2 * m2) / (n2 - 1) ELSE 0 END AS v2, greatest(u1, n1 * n2 - u1) AS u FROM joined),
tests AS (SELECT *, CASE WHEN n1 + n2 > 2 THEN sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) END AS pooled,
        CASE WHEN bin THEN {fisher_two_sided_sql(*cells.values())}
             WHEN n1 > 0 AND n2 > 0 AND least(n1, n2) <= 8 AND tie = 0 THEN {mann_whitney_exact_sql("u", "least(n1, n2)", "greatest(n1, n2)")}
             WHEN n1 > 0 AND n2 > 0 THEN {normal_two_sided_sql("(u - n1 * n2 / 2 - 0.5)", "sqrt(greatest(n1 * n2 / 12 * (N + 1 - tie / (N * (N - 1))), 0))")} END AS p FROM spread)
SELECT pattern, feature, CASE WHEN bin THEN 'binary' ELSE 'numeric' END AS feature_type, round(m1, 6) AS mean_in, round(m2, 6) AS mean_out,
  round(m1 - m2, 6) AS effect_size_diff, round(CASE WHEN NOT bin AND pooled > 0 THEN (m1 - m2) / pooled END, 6) AS cohens_d, round(p, 6) AS p_value,
  CASE WHEN p IS NULL THEN '' WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS sig FROM tests"""


@query("pattern_tests", _pattern_tests_sql())
def q_pattern_tests(spark, sf_dir):
    """Each effect pattern vs the rest: Fisher exact (binary), Cohen's d and Mann-Whitney (numeric)."""
    return ES.pattern_tests(_analysis_items(spark, sf_dir), list(BINARY_FEATURES), list(NUMERIC_FEATURES))


def _pairs(spark, sf_dir):
    """Model-pair alignment table (one row per model pair), reused by the permutation test,
    the bootstrap and leave-one-out: checkpointed once."""
    return q_pair_alignment(spark, sf_dir).checkpoint()


def q_family_gap(spark, sf_dir):
    """Same- vs cross-family alignment gap with a 20 000-permutation label test and a
    5 000-draw pair bootstrap."""
    return ES.family_gap(_pairs(spark, sf_dir), fx.model_families(spark, sf_dir),
                         ["pearson_r", "spearman_rho"], 20000, 5000)


_LOMO = _EFFECTS + """
, rk AS (SELECT model, evidence_hash, average_proportion_shift AS s,
           rank() OVER (PARTITION BY model ORDER BY round(average_proportion_shift, 12))
           + (count(*) OVER (PARTITION BY model, round(average_proportion_shift, 12)) - 1) / 2.0 AS r
         FROM effects WHERE average_proportion_shift IS NOT NULL),
pa AS (SELECT a.model AS model_a, b.model AS model_b, corr(a.s, b.s) AS pearson_r, corr(a.r, b.r) AS spearman_rho
       FROM rk a JOIN rk b ON a.evidence_hash = b.evidence_hash AND a.model < b.model GROUP BY 1, 2),
fam AS (SELECT DISTINCT model, 'f' || CAST(floor(CAST(regexp_extract(model, '(\\d+)$', 1) AS INTEGER) / 3) AS BIGINT) AS family
        FROM trials),
fp AS (SELECT pa.*, coalesce(fa.family = fb.family, false) AS same FROM pa
       LEFT JOIN fam fa ON fa.model = pa.model_a LEFT JOIN fam fb ON fb.model = pa.model_b),
long AS (SELECT model_a, model_b, same, 'pearson_r' AS metric, pearson_r AS value FROM fp
         UNION ALL SELECT model_a, model_b, same, 'spearman_rho', spearman_rho FROM fp),
d AS (SELECT m.model AS dropped_model, l.* FROM long l JOIN (SELECT DISTINCT model FROM fam) m
        ON m.model <> l.model_a AND m.model <> l.model_b WHERE l.value IS NOT NULL)
"""


query("family_gap", _LOMO.replace("WITH", "WITH RECURSIVE", 1) + f"""
, pos AS (SELECT *, row_number() OVER (ORDER BY model) AS pos FROM fam),
sh AS (SELECT perm, model, row_number() OVER (PARTITION BY perm ORDER BY md5(concat_ws(':', '42', perm, model)), model) AS pos
       FROM fam, range(1, 20001) r(perm)),
pf AS (SELECT sh.perm, sh.model, pos.family FROM sh JOIN pos USING (pos)),
obs AS (SELECT metric, median(value) FILTER (WHERE same) AS ms, median(value) FILTER (WHERE NOT same) AS mc FROM long WHERE value IS NOT NULL GROUP BY metric),
pg AS (SELECT l.metric, fa.perm, median(value) FILTER (WHERE fa.family = fb.family) - median(value) FILTER (WHERE fa.family <> fb.family) AS pgap
       FROM long l JOIN pf fa ON fa.model = l.model_a JOIN pf fb ON fb.model = l.model_b AND fb.perm = fa.perm WHERE value IS NOT NULL GROUP BY ALL),
pv AS (SELECT metric, avg(CASE WHEN pgap IS NOT NULL THEN CASE WHEN abs(pgap) >= abs(ms - mc) THEN 1.0 ELSE 0.0 END END) AS p FROM pg JOIN obs USING (metric) GROUP BY metric),
vs AS (SELECT metric, same AS flag, value AS y, row_number() OVER (PARTITION BY metric, same ORDER BY value) - 1 AS idx FROM long WHERE value IS NOT NULL),
sz AS (SELECT metric, flag, count(*) AS n,
         ('0x' || substr(md5(concat_ws(':', '42', metric, CASE WHEN flag THEN 'true' ELSE 'false' END)), 1, 7))::BIGINT AS salt FROM vs GROUP BY metric, flag),
{positions_ctes("sz", ["metric", "flag"], 5000)},
reps AS (SELECT x.metric, x.b, avg(vs.y) FILTER (WHERE x.flag) - avg(vs.y) FILTER (WHERE NOT x.flag) AS g
         FROM drawn x JOIN vs ON vs.metric = x.metric AND vs.flag = x.flag AND vs.idx = x.i GROUP BY x.metric, x.b),
ci AS (SELECT metric, quantile_cont(g, 0.025) AS lo, quantile_cont(g, 0.975) AS hi FROM reps GROUP BY metric)
SELECT metric, round(ms, 6) AS median_same_family, round(mc, 6) AS median_cross_family, round(ms - mc, 6) AS median_gap_same_minus_cross,
  round(p, 6) AS label_permutation_p_value, round(lo, 6) AS pair_bootstrap_ci_lower, round(hi, 6) AS pair_bootstrap_ci_upper
FROM obs LEFT JOIN pv USING (metric) LEFT JOIN ci USING (metric)
""")(q_family_gap)


@query("lomo_gap", _LOMO + """
SELECT dropped_model, metric,
  round(median(value) FILTER (WHERE same) - median(value) FILTER (WHERE NOT same), 6) AS median_gap_same_minus_cross
FROM d GROUP BY dropped_model, metric
""")
def q_lomo_gap(spark, sf_dir):
    """Family gap with each model left out in turn."""
    return ES.leave_one_model_out(_pairs(spark, sf_dir), fx.model_families(spark, sf_dir),
                                  ["pearson_r", "spearman_rho"])


@query("lomo_summary", _LOMO + """
, g AS (SELECT dropped_model, metric, median(value) FILTER (WHERE same) - median(value) FILTER (WHERE NOT same) AS gap
        FROM d GROUP BY dropped_model, metric)
SELECT metric, count(gap) AS n_models, round(median(gap), 6) AS median_gap, round(min(gap), 6) AS min_gap, round(max(gap), 6) AS max_gap
FROM g GROUP BY metric
""")
def q_lomo_summary(spark, sf_dir):
    """Median and range of the family gap over the left-out models."""
    g = q_lomo_gap(spark, sf_dir)
    x = F.col("median_gap_same_minus_cross")
    return g.groupBy("metric").agg(F.count(x).alias("n_models"), F.median(x).alias("median_gap"),
                                   F.min(x).alias("min_gap"), F.max(x).alias("max_gap"))
