"""Stored web pages -> structured records (question, sections, quotes, footnotes, links).

HTML parsing has no Spark built-in, so each partition's pages go through
the standard-library parser inside ``mapInPandas`` (Arrow batches, one
small parser object per page); link following is a self-join of the
pages table on the resolved URL instead of fetching.
"""

from __future__ import annotations

from collections.abc import Iterator
import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sway.functions.parse import TITLE_PREFIX

SECTION_SCHEMA = ("page_id long, title string, heading string, n_paragraphs int, main_text_chars int, "
                  "n_links int, n_quotes int, n_footnotes int, main_text string")
TOPIC_SCHEMA = ("page_id long, question string, pros array<string>, cons array<string>, "
                "sources map<string,string>")


class _PageParser(HTMLParser):
    """Collects title, first h1, article paragraphs, quotes, footnotes and links."""

    SKIP = {"script", "style"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.title, self.heading = [], []
        self.paragraphs: list[list[str]] = []
        self.n_links = self.n_quotes = self.n_footnotes = self.n_h1 = 0
        self.links: list[str] = []
        self.in_article = 0
        # topic record: argument blocks and quotes inside <section class="pro|con">,
        # numbered footnotes <li id="...-N"> inside <ol>
        self.side_stack: list[str | None] = []
        self.args = {"pro": [], "con": []}
        self.footnotes: dict[int, list[str]] = {}
        self.cur_fn: int | None = None

    def _side(self):
        for sd in reversed(self.side_stack):
            if sd:
                return sd
        return None

    def handle_starttag(self, tag, attrs):
        self.stack.append(tag)
        a = dict(attrs)
        if tag == "section":
            cls = (a.get("class") or "").split()
            self.side_stack.append("pro" if "pro" in cls else "con" if "con" in cls else None)
        side = self._side()
        if side and tag in ("p", "blockquote", "h2", "h3", "h4"):
            self.args[side].append([])
        if tag == "li" and "ol" in self.stack:
            m = re.search(r"-(\d+)$", a.get("id") or "")
            self.cur_fn = int(m.group(1)) if m else None
            if self.cur_fn is not None:
                self.footnotes.setdefault(self.cur_fn, [])
        if tag == "h1":
            self.n_h1 += 1
        if tag == "article":
            self.in_article += 1
        elif tag == "p" and self.in_article:
            self.paragraphs.append([])
        elif tag == "a":
            self.n_links += 1
            if a.get("href") is not None:
                self.links.append(a["href"])
        elif tag == "blockquote":
            self.n_quotes += 1
        elif tag == "li" and "ol" in self.stack:
            self.n_footnotes += 1

    def handle_endtag(self, tag):
        if tag == "article":
            self.in_article = max(0, self.in_article - 1)
        if tag == "section" and self.side_stack:
            self.side_stack.pop()
        if tag == "li":
            self.cur_fn = None
        while self.stack:
            if self.stack.pop() == tag:
                break

    def handle_data(self, data):
        if any(t in self.SKIP for t in self.stack):
            return
        side = self._side()
        if side and self.args[side]:
            self.args[side][-1].append(data)
        if self.cur_fn is not None:
            self.footnotes[self.cur_fn].append(data)
        if "title" in self.stack:
            self.title.append(data)
        elif "h1" in self.stack and self.n_h1 == 1:  # the first one, with what its children hold
            self.heading.append(data)
        elif self.in_article and self.paragraphs and "p" in self.stack:
            self.paragraphs[-1].append(data)


def _parse_batch(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        rows = []
        for pid, html in zip(pdf["page_id"], pdf["html"]):
            p = _PageParser()
            p.feed(html or "")
            p.close()
            paras = [" ".join("".join(x).split()) for x in p.paragraphs]
            paras = [x for x in paras if x]
            main = "\n".join(paras)
            rows.append((pid, " ".join("".join(p.title).split()), " ".join("".join(p.heading).split()),
                         len(paras), len(main), p.n_links, p.n_quotes, p.n_footnotes, main))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in SECTION_SCHEMA.split(", ")])


def page_sections(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "html").mapInPandas(_parse_batch, SECTION_SCHEMA)


LINK_SCHEMA = "page_id long, href string, target_url string"


def _link_batch(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        rows = []
        for pid, url, html in zip(pdf["page_id"], pdf["url"], pdf["html"]):
            p = _PageParser()
            p.feed(html or "")
            p.close()
            rows += [(pid, href, resolve(url or "", href)) for href in p.links]
        yield pd.DataFrame(rows, columns=["page_id", "href", "target_url"])


def resolve(base: str, href: str) -> str:
    """Link target by the rules of URL references; what can't be resolved stays as it is."""
    try:
        return urljoin(base, href)
    except ValueError:
        return href


def page_links(pages: DataFrame) -> DataFrame:
    """Links of each page resolved and joined to the stored page they point to (fallback: itself).

    Of pages stored under the same URL the one with the smallest id is the target."""
    links = pages.select("page_id", "url", "html").mapInPandas(_link_batch, LINK_SCHEMA)
    targets = pages.groupBy(F.col("url").alias("target_url")).agg(F.min("page_id").alias("linked_page_id"))
    j = links.join(targets, "target_url", "left")
    return j.select("page_id", "href", "target_url",
                    F.coalesce("linked_page_id", "page_id").alias("target_page_id"),
                    F.col("linked_page_id").isNotNull().alias("found"))


_TITLE_PREFIX = re.compile(TITLE_PREFIX)


def _topic_batch(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        rows = []
        for pid, html in zip(pdf["page_id"], pdf["html"]):
            p = _PageParser()
            p.feed(html or "")
            p.close()
            norm = lambda parts: " ".join("".join(parts).split())
            sides = {sd: [_TITLE_PREFIX.sub("", norm(x)) for x in p.args[sd]] for sd in ("pro", "con")}
            sides = {sd: [x for x in v if x] for sd, v in sides.items()}
            sources = {f"[{n}]": norm(p.footnotes[n]) for n in sorted(p.footnotes)}
            question = norm(p.heading) or norm(p.title)
            rows.append((pid, question, sides["pro"], sides["con"], sources))
        yield pd.DataFrame(rows, columns=["page_id", "question", "pros", "cons", "sources"])


def page_topics(pages: DataFrame) -> DataFrame:
    """One topic record per page: question, pro and con argument texts (title prefixes
    removed), and the footnote map ordered by number."""
    return pages.select("page_id", "html").mapInPandas(_topic_batch, TOPIC_SCHEMA)


QUOTE_SCHEMA = "page_id long, side string, context string, text string, footnotes array<string>"
_FOOTREF = re.compile(r"#pcref-\d+-(\d+)")


class _QuoteParser(HTMLParser):
    """Blockquotes with their context (text of the element just before them when it is a
    p/h2/h3), their paragraph texts and the footnote numbers of their reference links."""

    VOID = {"br", "img", "hr", "meta", "link", "input", "wbr", "source", "area", "col"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        # frames: [tag, text parts, last closed child (tag, text), section side]
        self.frames: list[list] = [["#root", [], None, None]]
        self.quotes: list[dict] = []
        self.cur: dict | None = None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        side = self.frames[-1][3]
        if tag == "section":
            cls = (a.get("class") or "").split()
            side = "pro" if "pro" in cls else "con" if "con" in cls else side
        if tag == "blockquote" and self.cur is None:
            prev = self.frames[-1][2]
            ctx = prev[1] if prev and prev[0] in ("p", "h2", "h3") else ""
            self.cur = {"side": side, "context": ctx, "parts": [], "notes": set(), "depth": len(self.frames)}
        if self.cur is not None and tag == "a":
            m = _FOOTREF.search(a.get("href") or "")
            if m:
                self.cur["notes"].add(m.group(1))
        if tag in self.VOID:
            return
        self.frames.append([tag, [], None, side])

    def handle_endtag(self, tag):
        if tag in self.VOID or len(self.frames) == 1:
            return
        # close up to the matching tag (tolerates unclosed children)
        while len(self.frames) > 1:
            t, parts, _, _ = self.frames.pop()
            text = " ".join("".join(parts).split())
            if self.cur is not None and t in ("p", "ul", "ol") and len(self.frames) >= self.cur["depth"]:
                self.cur["parts"].append(text)
            self.frames[-1][1].append(" " + "".join(parts) + " ")
            self.frames[-1][2] = (t, text)
            if t == "blockquote" and self.cur is not None and len(self.frames) == self.cur["depth"]:
                self.quotes.append(self.cur)
                self.cur = None
            if t == tag:
                break

    def handle_data(self, data):
        self.frames[-1][1].append(data)


def _quote_batch(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        rows = []
        for pid, html in zip(pdf["page_id"], pdf["html"]):
            q = _QuoteParser()
            q.feed(html or "")
            q.close()
            for x in q.quotes:
                text = "\n".join(p for p in x["parts"] if p)
                full = f"{x['context']}\n\n{text}" if x["context"] else text
                rows.append((pid, x["side"], x["context"], full, sorted(x["notes"])))
        yield pd.DataFrame(rows, columns=["page_id", "side", "context", "text", "footnotes"])


def page_quotes(pages: DataFrame) -> DataFrame:
    """One row per blockquote: enclosing side, context, quote text (context first) and the
    footnote numbers it references."""
    return pages.select("page_id", "html").mapInPandas(_quote_batch, QUOTE_SCHEMA)
