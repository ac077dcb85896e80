"""Topic records: canonical URLs, links that lead nowhere, and assembly over linked pages."""

import pytest

from sway.operators import topics


@pytest.mark.parametrize("url,want", [
    ("HTTPS://Example.ORG:443/a/b/#x", "https://example.org/a/b"), ("http://example.org:80", "http://example.org"), ("http://example.org:8080/", "http://example.org:8080"),
    ("https://example.org/a?", "https://example.org/a"), ("https://example.org/A?b=1#c", "https://example.org/A?b=1"), ("mailto:a@b.org", None), ("/a", None), ("", None), ("http://[x/", None)])
def test_canonical(url, want):
    assert topics.canonical(url) == want


def test_records_over_links(spark):
    hub = ('<h1>Is <b>it</b> so?</h1><a rel="pro" href="p">x</a><a rel="con" href="missing">x</a><a rel="sources" href="../s#top">x</a><a rel="next" href="p">x</a>'
           '<section class="con"><p>Con 1: held here</p></section>')
    pro = '<section class="pro"><p>Pro 1: first</p><h3>Said</h3><blockquote><p>quoted &amp; cited</p><a href="#pcref-9-2">2</a><a href="#pcref-9-7">7</a></blockquote></section><section class="con"><p>not asked for</p></section>'
    sources = '<ol><li id="pcref-9-2">Second <i>source</i></li><li id="pcref-9-1">First</li><li>no number</li></ol>'
    rows = [(1, "https://x.org/t/", hub), (2, "https://X.org/t/p/", pro), (3, "https://x.org/s", sources), (4, "https://x.org/t/p", "<section class='pro'><p>stored later</p></section>"),
            (5, None, None), (6, "https://y.org", "<h1>No links</h1>")]
    out = topics.topic_records(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [tuple(r) for r in out] == [(1, "Is it so?", ["first", "Said", "quoted & cited27"], ["held here"], ["quoted & cited"], ["Second source", ""], 2)]
    links = topics.topic_links(topics.parsed_pages(spark.createDataFrame(rows, "page_id long, url string, html string")))
    assert {(r["role"], r["target_page_id"], r["found"]) for r in links.collect()} == {("pro", 2, True), ("con", 1, False), ("sources", 3, True)}
    assert topics.topic_records(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_are_not_parsed_in_arrow_batches(spark):
    plan = topics.parsed_pages(spark.createDataFrame([(1, "u", "h")], "page_id long, url string, html string"))._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "InPandas" not in plan and "InArrow" not in plan
