"""Topic records assembled over the link graph of stored pages.

A topic's hub page links to pages that hold its pro arguments, con arguments and sources.  Every page is
parsed once; links are resolved to canonical URLs and joined to the stored pages, a role whose page isn't
stored falls back to the hub itself, and the records gather what the linked pages hold: arguments by side,
quotes with the texts of the sources that their footnotes name.
"""

from __future__ import annotations

import re
from urllib.parse import urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sway.functions.parse import TITLE_PREFIX
from sway.operators.pages import _PageParser, _QuoteParser, resolve
from sway.session import materialize

ROLES = ("pro", "con", "sources")
DEFAULT_PORTS = {"http": ":80", "https": ":443"}
PARSED = ("url string, question string, links array<struct<role:string,href:string,target:string>>, "
          "args array<struct<side:string,text:string>>, quotes array<struct<side:string,text:string,notes:array<string>>>, "
          "notes map<string,string>")
_PREFIX = re.compile(TITLE_PREFIX)


def canonical(url: str) -> str | None:
    """One spelling per page: scheme and host in lower case, no default port, fragment, empty query or trailing
    slash; None for what isn't a web page."""
    try:
        parts = urlsplit(url)
    except ValueError:
        return None
    if parts.scheme.lower() not in DEFAULT_PORTS or not parts.netloc:
        return None
    host = parts.netloc.lower().removesuffix(DEFAULT_PORTS[parts.scheme.lower()])
    return f"{parts.scheme.lower()}://{host}{parts.path.rstrip('/')}" + (f"?{parts.query}" if parts.query else "")


class _RoleParser(_PageParser):
    """Adds the roles of links, given by their ``rel``."""

    def __init__(self):
        super().__init__()
        self.roles: list[tuple[str, str]] = []

    def handle_starttag(self, tag, attrs):
        super().handle_starttag(tag, attrs)
        a = dict(attrs)
        if tag == "a" and a.get("rel") in ROLES and a.get("href") is not None:
            self.roles.append((a["rel"], a["href"]))


def _parse(url, html):
    """One page; rows come in small batches here, where an Arrow batch would hold thousands of pages at once."""
    norm = lambda parts: " ".join("".join(parts).split())
    p, q = _RoleParser(), _QuoteParser()
    for parser in (p, q):
        parser.feed(html or "")
        parser.close()
    args = [(side, _PREFIX.sub("", norm(x))) for side in ("pro", "con") for x in p.args[side]]
    quotes = [(x["side"], "\n".join(t for t in x["parts"] if t), sorted(x["notes"])) for x in q.quotes]
    return (canonical(url or ""), norm(p.heading) or norm(p.title), [(r, h, canonical(resolve(url or "", h))) for r, h in p.roles],
            [x for x in args if x[1]], quotes, {str(n): norm(v) for n, v in p.footnotes.items()})


def parsed_pages(pages: DataFrame) -> DataFrame:
    """Each page parsed once (``PARSED``)."""
    parse = F.udf(_parse, PARSED, useArrow=False)
    return pages.select("page_id", F.inline(F.array(parse("url", "html"))))


def topic_links(parsed: DataFrame) -> DataFrame:
    """(page_id, role, href, target_url, target_page_id, found) of every link with a role; of pages stored under
    one URL the smallest id counts, and a link to a page that isn't stored falls back to the page itself."""
    links = parsed.select("page_id", F.inline("links"))
    stored = parsed.where(F.col("url").isNotNull()).groupBy(F.col("url").alias("target")).agg(F.min("page_id").alias("stored"))
    return links.join(stored, "target", "left").select(
        "page_id", "role", "href", F.col("target").alias("target_url"), F.coalesce("stored", "page_id").alias("target_page_id"), F.col("stored").isNotNull().alias("found"))


def topic_records(pages: DataFrame) -> DataFrame:
    """(page_id, question, pros, cons, quotes, citations, n_sources) of every hub.

    Pros and cons are those of the pages that the links of that role lead to, in their order; ``quotes`` are the
    quoted texts there and ``citations`` the source texts that their footnotes name, empty where the source is missing."""
    parsed = materialize(parsed_pages(pages))
    reached = topic_links(parsed).select("page_id", "role", "target_page_id").distinct()
    holds = parsed.select(F.col("page_id").alias("target_page_id"), "args", "quotes", "notes")
    gathered = reached.join(holds, "target_page_id")
    args = F.transform(F.filter("args", lambda a: a["side"] == F.col("role")), lambda a: a["text"])
    quotes = F.filter("quotes", lambda q: q["side"] == F.col("role"))
    # a topic has a page or two per role, so what meets here is one topic's record
    sides = gathered.groupBy("page_id").agg(
        *[F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == r, F.struct("target_page_id", args.alias("v"))))), lambda x: x["v"])).alias(f"{r}s") for r in ("pro", "con")],
        F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") != "sources", F.struct((F.col("role") == "con").alias("later"), "target_page_id", quotes.alias("v"))))), lambda x: x["v"])).alias("said"),
        F.flatten(F.collect_list(F.when(F.col("role") == "sources", F.map_entries("notes")))).alias("sources"))
    cited = lambda q: F.transform(q["notes"], lambda n: F.coalesce(F.get(F.filter("sources", lambda s: s["key"] == n), F.lit(0))["value"], F.lit("")))
    return parsed.select("page_id", "question").join(sides, "page_id").select(
        "page_id", "question", "pros", "cons", F.transform("said", lambda q: q["text"]).alias("quotes"),
        F.flatten(F.transform("said", cited)).alias("citations"), F.size("sources").alias("n_sources"))
