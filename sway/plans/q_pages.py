"""Queries: stored pages -> sections and link graph (build step 11)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sway.operators import pages as PG
from sway.operators import topics as TP
from sway.plans.catalog import query
from sway.session import checkpoint_dir
from sway.sources import fixtures as fx
from sway.sources import study_files as SFILES
from sway.sources.tables import read_table


@query("page_sections")
def q_page_sections(spark, sf_dir):
    """Title, heading, article paragraphs, quotes, footnotes and link counts per page
    (HTML parsed in ``mapInPandas``; rows-only check)."""
    return PG.page_sections(read_table(spark, sf_dir, "pages").select("page_id", "html"))


@query("page_links", """
WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages),
r AS (SELECT page_id, href,
        CASE WHEN regexp_matches(href, '^https?://') THEN href
             WHEN starts_with(href, '/') THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || href
             ELSE regexp_extract(url, '^(https?://[^?#]*/)', 1) || href END AS target_url FROM l)
SELECT r.page_id, r.href, r.target_url, coalesce(p.page_id, r.page_id) AS target_page_id,
  p.page_id IS NOT NULL AS found
FROM r LEFT JOIN (SELECT url, min(page_id) AS page_id FROM pages GROUP BY url) p ON p.url = r.target_url
""")
def q_page_links(spark, sf_dir):
    """Links of each page resolved against its URL and joined to the stored pages."""
    return PG.page_links(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query("page_topics")
def q_page_topics(spark, sf_dir):
    """Topic record per page (question, pros, cons, sources) from sectioned markup, with
    argument counts; rows-only (HTML parsed in mapInPandas)."""
    from pyspark.sql import functions as F
    t = PG.page_topics(read_table(spark, sf_dir, "pages").select("page_id", "html"))
    return t.select("page_id", "question", F.size("pros").alias("n_pros"), F.size("cons").alias("n_cons"),
                    F.size("sources").alias("n_sources"), "pros", "cons", "sources")


@query("issue_titles", r"""
WITH t AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages),
s AS (SELECT *, replace(replace(replace(lower(title), '&', 'and'), ' ', '-'), '--', '-') AS slug FROM t),
c AS (SELECT *, string_split(replace(slug, '-', ' '), '') AS cs FROM s)
SELECT page_id, title, slug, array_to_string(list_transform(cs, lambda c, i:
  CASE WHEN i = 1 OR NOT regexp_matches(cs[i - 1], '[\p{Lu}\p{Ll}\p{Lt}]') THEN CASE c WHEN 'ß' THEN 'Ss' ELSE upper(c) END ELSE lower(c) END), '') AS display_title FROM c
""")
def q_issue_titles(spark, sf_dir):
    """Page titles -> issue slug and display title (Python title-case rules)."""
    from pyspark.sql import functions as F
    from sway.functions.parse import issue_slug, issue_title
    p = read_table(spark, sf_dir, "pages").select("page_id", "html")
    title = F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    return p.select("page_id", title.alias("title")).select(
        "page_id", "title", issue_slug(F.col("title")).alias("slug")).withColumn("display_title", issue_title(F.col("slug")))


@query("page_quotes")
def q_page_quotes(spark, sf_dir):
    """Blockquotes per page with their side, context and referenced footnotes (rows-only)."""
    return PG.page_quotes(read_table(spark, sf_dir, "pages").select("page_id", "html"))


# The records straight from the tables, without pages, links or markup.
_TOPICS = r"""
WITH np AS (SELECT count(*) AS n FROM pages),
args AS (SELECT doc_id % n AS topic, doc_id, CASE WHEN substr(md5(doc_id::VARCHAR), 1, 1) < '8' THEN 'pro' ELSE 'con' END AS side,
           regexp_replace(regexp_replace(text, '[\t-\r \x{85}\p{Z}]+', ' ', 'g'), '^ | $', '', 'g') AS words FROM documents, np WHERE doc_id IS NOT NULL AND text IS NOT NULL),
shown AS (SELECT topic, side, doc_id, CASE WHEN doc_id % 3 = 0 THEN list_filter(['On document ' || doc_id, words || (doc_id % 6 + 1)::VARCHAR], lambda x: x <> '')
            WHEN words = '' THEN [] ELSE [words] END AS texts, CASE WHEN doc_id % 3 = 0 THEN words END AS quote,
            CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 6 < 5 THEN 'Source ' || (doc_id % 6 + 1) || ' of topic ' || topic ELSE '' END END AS citation FROM args),
topics AS (SELECT page_id AS topic FROM pages)
"""


@query("topic_records", _TOPICS + """
SELECT t.topic * 4 AS page_id, 'Topic ' || t.topic || ': for & against' AS question,
  coalesce(flatten(list(texts ORDER BY doc_id) FILTER (WHERE side = 'pro')), []) AS pros, coalesce(flatten(list(texts ORDER BY doc_id) FILTER (WHERE side = 'con')), []) AS cons,
  coalesce(list(quote ORDER BY side DESC, doc_id) FILTER (WHERE quote IS NOT NULL), []) AS quotes,
  coalesce(list(citation ORDER BY side DESC, doc_id) FILTER (WHERE citation IS NOT NULL), []) AS citations, 5::INTEGER AS n_sources
FROM topics t LEFT JOIN shown s ON s.topic = t.topic GROUP BY t.topic
""")
def q_topic_records(spark, sf_dir):
    """Question, arguments, quotes and cited sources of every topic, gathered over its linked pages."""
    return TP.topic_records(fx.topic_pages(spark, sf_dir))


@query("topic_links", """
WITH t AS (SELECT page_id AS topic FROM pages),
roles(role, number) AS (VALUES ('pro', 1), ('con', 2), ('sources', 3)),
l AS (SELECT topic, role, number, CASE role WHEN 'sources' THEN 'https://topics.example.org/sources?topic=' || topic ELSE 'https://topics.example.org/t/' || topic || '/' || role END AS target_url
      FROM t, roles)
SELECT topic * 4 AS page_id, role, target_url, CASE WHEN role = 'con' AND topic % 7 = 3 THEN topic * 4 ELSE topic * 4 + number END AS target_page_id,
  NOT (role = 'con' AND topic % 7 = 3) AS found FROM l
UNION ALL SELECT topic * 4, 'pro', NULL, topic * 4, false FROM t
""")
def q_topic_links(spark, sf_dir):
    """Links of the topic hubs by role, however they are written, joined to the stored pages."""
    return TP.topic_links(TP.parsed_pages(fx.topic_pages(spark, sf_dir))).drop("href")


@query("url_list", """
WITH l AS (SELECT page_id, url, page_id % 3 AS shard, unnest([0, 1]) AS blank FROM pages),
n AS (SELECT *, row_number() OVER (ORDER BY shard, page_id, blank) - 1 AS line_no FROM l WHERE blank = 0 OR page_id % 10 = 0)
SELECT line_no, url, row_number() OVER (ORDER BY line_no) - 1 AS position, row_number() OVER (ORDER BY line_no) <= 5 AS first_five FROM n WHERE blank = 0
""")
def q_url_list(spark, sf_dir):
    """URLs of the stored pages written to three list files with blank lines between them, and read back by line."""
    p = read_table(spark, sf_dir, "pages").select("page_id", F.col("url"), (F.col("page_id") % 3).alias("shard"))
    lines = p.select("page_id", "shard", F.posexplode(F.when(F.col("page_id") % 10 == 0, F.array(F.concat(F.lit(" "), "url"), F.lit(" "))).otherwise(F.array("url"))).alias("blank", "value"))
    path = f"{checkpoint_dir(spark).rstrip('/')}/urls-{uuid.uuid4().hex}"
    (lines.repartitionByRange(3, "shard").sortWithinPartitions("shard", "page_id", "blank").select("shard", "value")
     .write.partitionBy("shard").text(path))
    return SFILES.url_list(spark, path).withColumn("first_five", F.col("position") < 5)
