"""URL filter: rules against a plain loop, trees by held-out accuracy."""

import random

from sway.llm.queries import URL_RULES
from sway.llm.url_filter import Rule, judge

URLS = ["http://a.example.org/es/1", "https://EXAMPLE.org/en/12?x=/de/", "http://example.org/en/2", "http://notexample.org/es/", "http://x.org", "http://x.org?/",
        "http://x.com/fr/", "http://com/de/a#b", "http://x.com/fr", "http://x.community/de/", "ftp://x.net/a-b?c=1&d=2#e", "no scheme.org/", "://", "http://", None, "",
        "http://x.org/://y.com/de/", "HTTP://É.Org/ö", "http://a.com:80/de/", "http://y.com/" + "q" * 20000, "a://b\n.org/\nc"]


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def brute(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    host, path = lower(rest[:cut]), rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path] + [len(path)])]
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.name)).name if fits else None


def test_rules_and_edges(spark):
    rows = [(i, u, "x", 1.0, 2) for i, u in enumerate(URLS * 3)] + [(None, "http://x.org/", "y", None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, chars double, rule long")
    out = judge(df, URL_RULES, trees=3).collect()
    assert len(out) == len(rows)
    verdicts = {r.name: r.verdict for r in URL_RULES}
    for r in out:
        want = brute(URLS[r["page_id"] % len(URLS)] if r["page_id"] is not None else "http://x.org/")
        assert (r["host"], r["path"], r["rule"]) == want
        assert r["verdict"] == verdicts.get(want[2], r["verdict"]) and r["verdict"] in ("allow", "block")
        assert (r["block_score"] is None) == (want[2] is not None)
    assert judge(df.limit(0), URL_RULES).count() == 0
    none = judge(df, [Rule("allow", "nowhere", "/")])
    assert {r["verdict"] for r in none.collect()} == {"allow"}
    assert {r["verdict"] for r in judge(df, [Rule("block", "org", "/")]).collect()} == {"block"}


def test_trees_learn_from_labelled_urls(spark):
    rng = random.Random(2)
    rows, truth = [], {}
    for i in range(1500):
        bad = rng.random() < .4
        seen = rng.random() < .6
        host = f"{'bad' if bad else 'good'}.seen" if seen else f"h{rng.randrange(9)}.new"
        path = "/" + "/".join("".join(rng.choices("0123456789" if bad else "abcdefgh", k=6)) for _ in range(rng.randrange(3, 6) if bad else rng.randrange(1, 3)))
        rows.append((i, f"http://{host}{path}" + ("?a=1&b=2" if bad else "")))
        truth[i] = ("block" if bad else "allow", seen)
    rules = [Rule("block", "bad.seen", "/"), Rule("allow", "good.seen", "/")]
    out = judge(spark.createDataFrame(rows, "page_id long, url string"), rules, train_rows=400).collect()
    new = [r for r in out if not truth[r["page_id"]][1]]
    assert sum(r["verdict"] == truth[r["page_id"]][0] for r in new) / len(new) > .95


def test_rare_verdict_is_learnt(spark):
    """Eight blocked URLs among four thousand, far beyond the bound of the sample."""
    rows = [(i, f"http://good.seen/{'abcdefgh'[i % 8] * (2 + i % 5)}/{i % 50}") for i in range(4000)]
    rows += [(5000 + i, f"http://bad.seen/1/2/3/4/5/6/7/8/{i}?a=1&b=2&c=3&d=4&e={i}") for i in range(8)]
    rows += [(6000, "http://else.new/1/2/3/4/5/6/7/8/99?a=1&b=2&c=3&d=4&e=5"), (6001, "http://else.new/aaa/3")]
    out = judge(spark.createDataFrame(rows, "page_id long, url string"), [Rule("block", "bad.seen", "/"), Rule("allow", "good.seen", "/")], train_rows=200)
    assert {r["page_id"]: r["verdict"] for r in out.where("page_id >= 6000").collect()} == {6000: "block", 6001: "allow"}
