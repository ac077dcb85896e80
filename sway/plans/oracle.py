"""DuckDB side of the cross-check: the fixture relations as CTEs.

The driver pre-registers the raw tables as views; every oracle query is
prefixed with these CTEs (unused ones cost nothing).  They are the same
rules as ``sway.sources.fixtures``.
"""

from __future__ import annotations

FIXTURE_CTES = """
WITH trials AS (
  SELECT concat('m', l_suppkey % 9) AS model, concat('issue-', l_partkey % 20) AS issue,
    CASE l_orderkey % 6 WHEN 0 THEN 'neither' WHEN 1 THEN 'pro' WHEN 2 THEN '75pro'
         WHEN 3 THEN 'all' WHEN 4 THEN '75con' ELSE 'con' END AS ecase,
    l_linenumber AS trial_num, l_partkey % 6 AS paraphrase_idx, l_partkey,
    CASE WHEN l_partkey % 6 < 4 THEN 'pro' ELSE 'con' END AS question_stance,
    CASE WHEN l_partkey % 20 = 19 THEN 'pro' WHEN l_partkey % 20 = 18 AND l_quantity > 20 THEN 'other'
         WHEN l_partkey % 20 = 17 AND l_orderkey % 6 = 1 THEN 'pro' WHEN l_partkey % 20 = 17 AND l_orderkey % 6 = 5 THEN 'con'
         WHEN l_partkey % 20 = 17 AND l_orderkey % 6 = 0 THEN CASE WHEN l_quantity <= 25 THEN 'pro' ELSE 'con' END
         WHEN l_quantity > 47 THEN 'other'
         WHEN l_quantity <= CASE l_orderkey % 6 WHEN 0 THEN 25 WHEN 1 THEN 40 WHEN 2 THEN 33
                                 WHEN 3 THEN 26 WHEN 4 THEN 16 ELSE 8 END THEN 'pro'
         ELSE 'con' END AS issue_stance,
    CASE l_returnflag WHEN 'A' THEN 'pro' WHEN 'R' THEN 'con' END AS last_argument,
    l_orderkey, l_linenumber
  FROM lineitem
), answers AS (
  SELECT t.*, CASE WHEN issue_stance = 'other' THEN 'Other'
                   WHEN issue_stance = question_stance THEN 'A' ELSE 'B' END AS llm_answer
  FROM trials t
), responses AS (
  SELECT a.*, CASE WHEN llm_answer = 'Other' THEN 'I cannot choose.'
    ELSE CASE trial_num % 4 WHEN 0 THEN concat('position <<', llm_answer, '>>')
              WHEN 1 THEN concat('My answer: position ', llm_answer)
              WHEN 2 THEN concat('<<', lower(llm_answer), '>>') ELSE concat(' ', llm_answer, ' ') END END
      AS response_text,
    concat('request-', replace(replace(issue, '-', ' '), ' ', '_'), '-', trial_num, '-framing-',
           question_stance, '-evidence-', ecase) AS custom_id
  FROM answers a
), judgments AS (
  SELECT concat('issue-', l_partkey % 20) AS topic, l_partkey % 6 AS paraphrase_idx,
    concat('j', l_suppkey % 3) AS judge_model,
    CASE sum(l_orderkey) % 10 WHEN 0 THEN 'leans_pro' WHEN 1 THEN 'leans_con' WHEN 2 THEN 'unknown'
         ELSE 'neutral' END AS label,
    CASE WHEN sum(l_orderkey) % 17 = 0 THEN 'timeout' ELSE '' END AS error
  FROM lineitem GROUP BY 1, 2, 3
), compositions AS (
  SELECT model, issue AS topic, ecase, paraphrase_idx, concat(ecase, '-', trial_num) AS composition_id,
    issue_stance
  FROM trials WHERE ecase IN ('75pro', '75con')
), stance_counts AS (
  SELECT issue, issue_stance, count(*) AS "count", ecase, model
  FROM trials WHERE issue <> 'unknown' GROUP BY issue, issue_stance, ecase, model
), trial_shares AS (
  SELECT model, ecase, issue, trial_num,
    count(*) FILTER (WHERE issue_stance = 'pro') AS pro,
    count(*) FILTER (WHERE issue_stance = 'con') AS con,
    count(*) FILTER (WHERE issue_stance NOT IN ('pro', 'con')) AS other,
    count(*) AS total,
    count(*) FILTER (WHERE issue_stance = 'pro') / count(*) AS pro_share,
    count(*) FILTER (WHERE issue_stance = 'con') / count(*) AS con_share
  FROM trials WHERE issue <> 'unknown' GROUP BY model, ecase, issue, trial_num
), issues_dim AS (
  SELECT DISTINCT concat('issue-', p_partkey % 20) AS issue, lower(replace(concat('issue-', p_partkey % 20), '-', ' '))
    AS question FROM part
), paraphrases_dim AS (
  SELECT *, concat(replace(topic, '-', ' '), ' v', paraphrase_idx) AS question FROM (
    SELECT DISTINCT concat('issue-', p_partkey % 20) AS topic, p_partkey % 6 AS paraphrase_idx,
      CASE WHEN p_partkey % 6 < 4 THEN 'pro' ELSE 'con' END AS orientation FROM part)
), models_dim AS (
  SELECT DISTINCT concat('m', s_suppkey % 9) AS model FROM supplier
), arguments AS (
  SELECT source AS topic, CASE WHEN substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) < '8' OR source = 'src3' THEN 'pro' ELSE 'con' END AS side, doc_id, text
  FROM documents
)
"""


def with_fixtures(sql: str) -> str:
    """Prefix ``sql`` with the fixture CTEs; a leading ``WITH`` (or ``WITH RECURSIVE``) in ``sql`` is merged."""
    body = sql.strip()
    if body[:14].upper() == "WITH RECURSIVE":
        return FIXTURE_CTES.rstrip().replace("WITH", "WITH RECURSIVE", 1) + ",\n" + body[14:].lstrip()
    if body[:4].upper() == "WITH":
        return FIXTURE_CTES.rstrip() + ",\n" + body[4:].lstrip()
    return FIXTURE_CTES + body


# ---- distribution functions as SQL expressions ----

def t_p_sql(t: str, v: str) -> str:
    """Two-sided p of Student's t with ``v`` degrees of freedom: with x = sqrt(v) tan(u) the density is
    proportional to cos(u)^(v - 1), integrated by Simpson's rule."""
    u = f"atan(abs({t}) / sqrt({v}))"
    scale = f"exp(lgamma(({v} + 1) / 2.0) - lgamma({v} / 2.0)) / sqrt(pi())"
    return (f"(1 - 2 * {scale} * {u} / 6000 * list_sum(list_transform(range(0, 2001), lambda i: "
            f"(CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(cos({u} * i / 2000), {v} - 1))))")


def t_quantile_ctes(source: str) -> str:
    """CTE ``tq`` (v, q): the 97.5 % point of Student's t for each v of the query ``source``.

    The density in u (see ``t_p_sql``) is summed by trapezoids with their end correction; from the last
    grid point below the level a second-order step reaches it."""
    return f"""
t_df AS ({source}),
tg AS (SELECT v, i, i * pi() / 40000 AS u, exp(lgamma((v + 1) / 2.0) - lgamma(v / 2.0)) / sqrt(pi()) * pow(cos(i * pi() / 40000), v - 1) AS y
       FROM t_df, range(0, 20000) r(i)),
tc AS (SELECT v, i, u, y, sum(a) OVER (PARTITION BY v ORDER BY i) + pow(pi() / 40000, 2) / 12 * (v - 1) * y * tan(u) AS c FROM (
         SELECT *, coalesce(y + lag(y) OVER (PARTITION BY v ORDER BY i), 0) / 2 * pi() / 40000 AS a FROM tg)),
tq AS (SELECT v, sqrt(v) * tan(u0 + d + d * d / 2 * (v - 1) * tan(u0)) AS q
       FROM (SELECT v, max_by(u, i) AS u0, (0.475 - max_by(c, i)) / max_by(y, i) AS d FROM tc WHERE c <= 0.475 GROUP BY v))"""


def paired_t_sql(m: str, sd: str, n: str) -> str:
    """p of the one-sample t test on paired differences, NULL for n < 2 or when all are 0."""
    t = f"({m} / ({sd} / sqrt({n})))"
    return (f"CASE WHEN {n} > 1 AND {sd} = 0 THEN CASE WHEN {m} = 0 THEN NULL ELSE 0 END "
            f"WHEN {n} > 1 THEN {t_p_sql(t, f'({n} - 1)')} END")


def binomial_half_sql(k: str, n: str) -> str:
    """Exact two-sided p of k of n against one half."""
    return (f"least(1, 2 * list_sum(list_transform(range(0, least({k}, {n} - {k})::BIGINT + 1), lambda i: "
            f"exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) - {n} * ln(2.0)))))")


def hypergeometric_less_sql(a: str, b: str, c: str, d: str) -> str:
    """One-sided Fisher p: at most ``a`` in the first cell given the margins."""
    choose = lambda n, k: f"lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - ({k}) + 1)"
    return (f"least(1, list_sum(list_transform(range(greatest(0, {a} - {d})::BIGINT, {a}::BIGINT + 1), lambda i: "
            f"exp({choose(f'({a} + {c})', 'i')} + {choose(f'({b} + {d})', f'({a} + {b} - i)')} - ({choose(f'({a} + {b} + {c} + {d})', f'({a} + {b})')})))))")


def fisher_two_sided_sql(a: str, b: str, c: str, d: str) -> str:
    """Two-sided Fisher p: all cells at most as likely as the observed one."""
    choose = lambda n, k: f"lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - ({k}) + 1)"
    log_at = lambda i: f"({choose(f'({a} + {c})', i)} + {choose(f'({b} + {d})', f'({a} + {b} - {i})')})"
    total = choose(f"({a} + {b} + {c} + {d})", f"({a} + {b})")
    return (f"least(1, list_sum(list_transform(range(greatest(0, {a} - {d})::BIGINT, least({a} + {b}, {a} + {c})::BIGINT + 1), "
            f"lambda i: CASE WHEN {log_at('i')} <= {log_at(a)} + ln(1 + 1e-7) THEN exp({log_at('i')} - ({total})) ELSE 0 END)))")


def normal_two_sided_sql(top: str, sd: str) -> str:
    """min(1, 2 P(Z > top / sd)), the density integrated by Simpson's rule; 1 for sd = 0 and a negative top."""
    z = f"({top} / {sd})"
    area = (f"0.01 / 3 * list_sum(list_transform(range(0, 1001), lambda i: (CASE WHEN i = 0 OR i = 1000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) "
            f"* exp(-pow({z} + i * 0.01, 2) / 2) / sqrt(2 * pi())))")
    return f"CASE WHEN {sd} = 0 THEN CASE WHEN {top} < 0 THEN 1 WHEN {top} > 0 THEN 0 END WHEN {z} <= 0 THEN 1 ELSE least(1, 2 * {area}) END"


def mann_whitney_exact_sql(u: str, m: str, n: str) -> str:
    """min(1, 2 P(U >= u)) without ties, m <= n: orderings by dynamic programming over the product of
    (1 - q^(n+i)) / (1 - q^i), up to U = m n - u."""
    top = f"({m} * {n} - round({u}))::BIGINT"
    one = f"list_transform(range(0, {top} + 1), lambda j: CASE WHEN j = 0 THEN 1.0::DOUBLE ELSE 0 END)"
    less = f"list_transform(range(0, {top} + 1), lambda j: a[j + 1] - CASE WHEN j >= {n} + e[1] THEN a[j + 1 - ({n} + e[1])::BIGINT] ELSE 0 END)"
    runs = f"list_transform(range(0, {top} + 1), lambda j: list_sum(list_transform(range(0, j // e[1]::BIGINT + 1), lambda t: c[(j - t * e[1])::BIGINT + 1])))"
    step = f"list_transform([{less}], lambda c: {runs})[1]"
    counts = f"list_reduce(list_concat([{one}], list_transform(range(1, ({m})::BIGINT + 1), lambda i: [i::DOUBLE])), lambda a, e: {step})"
    return f"least(1, 2 * list_sum({counts}) / exp(lgamma({m} + {n} + 1) - lgamma({m} + 1) - lgamma({n} + 1)))"


def marker_sql(p: str) -> str:
    return f"CASE WHEN {p} IS NULL THEN '' WHEN {p} < 0.001 THEN '***' WHEN {p} < 0.01 THEN '**' WHEN {p} < 0.05 THEN '*' ELSE 'ns' END"
