"""Web pages: title, main text, links, signs of JavaScript, and a crawl over a table of pages."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..sources.store import keep

#: Fixed values.
REMOVED_TAGS = {"script", "style", "nav", "header", "footer", "aside", "meta", "link", "noscript", "iframe", "svg", "button", "form"}
REMOVED_CLASSES = {"nav", "menu", "sidebar", "footer", "header", "breadcrumb", "advertisement", "ad", "cookie"}
REMOVED_IDS = {"nav", "menu", "sidebar", "footer", "header"}
JAVASCRIPT_SIGNS = ('id="__next"', 'id="app"', 'id="root"', "please enable javascript", "this site requires javascript", "noscript", "loading...", "cloudflare")
BODY_CHARS = 200
BULLETS = "|-•><»« \t\r\n"
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CLOSES_P = {"p", "div", "article", "section", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "main", "nav", "header", "footer", "aside", "form", "pre", "blockquote"}
#: What is read as it stands (scripts, styles, comments), and signs that may begin a reference.
REFERENCE = re.compile(r"<(script|style)\b.*?(?:</\1|\Z)|<!--.*?(?:-->|\Z)|&(#[0-9]+;|#x[0-9a-f]+;|[a-z][a-z0-9]*;)?", re.IGNORECASE | re.DOTALL)


def ended_references(html: str) -> str:
    """The same page, in which only references with a semicolon are such: any other sign is one for itself."""
    whole = lambda name: name and (name[0] == "#" or name in html5)
    return REFERENCE.sub(lambda m: m[0] if m[0][0] == "<" or whole(m[2]) else f"&amp;{m[0][1:]}", html)


class Page(HTMLParser):
    """One pass over a page: title, first heading, text of the body and of the first main element, and hrefs.

    Open elements are counted by name, so that an end tag without a beginning and a piece of text cost the same at any
    depth; each element is put on the stack and taken off it once."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, bool]] = []  # tag, removed from here, main from here
        self.open: Counter[str] = Counter()
        self.title: list[str] | None = None
        self.heading: list[str] | None = None
        self.into: list[str] | None = None
        self.body: list[str] = []
        self.everything: list[str] = []
        self.main: list[str] | None = None
        self.in_main = False
        self.hrefs: list[str] = []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "a" and a.get("href"):
            self.hrefs.append(a["href"])
        if tag in VOID:
            return
        if tag in CLOSES_P and self.stack and self.stack[-1][0] == "p" or tag == "li" and self.stack and self.stack[-1][0] == "li":
            self.handle_endtag(self.stack[-1][0])
        classes, name = set((a.get("class") or "").split()), a.get("id") or ""
        gone = tag in REMOVED_TAGS or bool(classes & REMOVED_CLASSES) or name in REMOVED_IDS
        gone = gone or bool(self.stack and self.stack[-1][1])
        main = not gone and self.main is None and (tag in ("main", "article") or bool(classes & {"content", "main"}) or name in ("content", "main"))
        if main:
            self.main, self.in_main = [], True
        self.stack.append((tag, gone, main))
        self.open[tag] += 1
        if tag == "title" and self.title is None:
            self.title = self.into = []
        if tag == "h1" and self.heading is None:
            self.heading = self.into = []

    def handle_endtag(self, tag):
        if not self.open[tag]:
            return
        top = None
        while top != tag:
            top, _, main = self.stack.pop()
            self.open[top] -= 1
            if main:
                self.in_main = False
        if tag in ("title", "h1"):
            self.into = None

    def handle_data(self, data):
        piece = data.strip()
        if self.into is not None:
            self.into.append(piece)
        if not piece or (self.stack and self.stack[-1][0] == "title"):
            return
        if not self.open["head"]:
            self.everything.append(piece)
        if self.stack and self.stack[-1][1]:
            return
        self.body.append(piece)
        if self.in_main:
            self.main.append(piece)

    def text(self) -> str:
        pieces = self.main if self.main is not None else self.body
        lines = (x.strip() for p in pieces for x in p.split("\n"))
        return "\n".join(x for x in lines if len(x) > 20 and x.strip(BULLETS))

    def heading_or_title(self) -> str:
        return "".join(self.title if self.title is not None else self.heading or [])


@F.udtf(returnType="kind string, place int, value string", useArrow=True)
class PageParts:
    """For SQL: the parts of a page as rows: its title, its text, and its links in order, each once."""

    def eval(self, html: str):
        page = Page(html or "")
        yield "title", 0, page.heading_or_title()
        yield "text", 0, page.text()
        for place, href in enumerate(dict.fromkeys(page.hrefs)):
            yield "link", place, href


def register(spark) -> None:
    """``SELECT p.url, x.* FROM pages p, LATERAL page_parts(p.html) x``"""
    spark.udtf.register("page_parts", PageParts)


def extract(pages: DataFrame, least: int = 100, ended: bool = False, also: tuple[str, ...] = ()) -> DataFrame:
    """(page_id, url, title, text, hrefs, content_length, needs_javascript, method); pages with less text are dropped.
    A page needs JavaScript if its body holds under 200 characters or it shows one of the signs.  ``ended``: a reference
    without its semicolon (``&amp`` where a title is cut off) stays as it is, which browsers would read.  ``also``: columns
    that are kept as they are."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            parsed = [Page(ended_references(h or "") if ended else h or "") for h in part["html"]]
            text = [p.text() for p in parsed]
            yield pd.DataFrame({
                "page_id": part["page_id"], "url": part["url"], "title": [p.heading_or_title() for p in parsed], "text": text, "hrefs": [list(dict.fromkeys(p.hrefs)) for p in parsed],
                "content_length": [len(x) for x in text], "method": "table",
                "needs_javascript": [sum(map(len, p.everything)) < BODY_CHARS or any(s in low for s in JAVASCRIPT_SIGNS) for p, low in zip(parsed, (str(h or "").lower() for h in part["html"]), strict=True)],
                **{c: part[c] for c in also},
            })

    kept = "".join(f", {c} {pages.schema[c].dataType.simpleString()}" for c in also)
    out = pages.select("page_id", "url", "html", *also).mapInPandas(run, f"page_id long, url string, title string, text string, hrefs array<string>, content_length int, needs_javascript boolean, method string{kept}")
    return out.where(F.col("content_length") >= least) if least else out


def links(html: Column) -> Column:
    """Values of href of a elements, in order, each once; without a parser."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r'<a\s[^>]*?href="([^"]+)"'), F.lit(1)))


def has_javascript_sign(html: Column) -> Column:
    low = F.lower(html)
    out = F.lit(False)
    for s in JAVASCRIPT_SIGNS:
        out = out | F.contains(low, F.lit(s))
    return out


def page_links(pages: DataFrame) -> DataFrame:
    """(url, link, place) of valid links, resolved against their page, each once, in order."""
    rows = pages.select("url", F.posexplode(links(F.col("html"))).alias("place", "href"))
    rows = rows.withColumn("link", urls.resolve(F.col("href"), F.col("url"))).where(urls.is_valid(F.col("link")))
    return rows.groupBy("url", "link").agg(F.min("place").alias("place"))


def crawl(starts: DataFrame, pages: DataFrame, edges: DataFrame, max_pages: int | str, depth: int = 2, per_page: int = 10, visited: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """First in, first out over known pages: (by, url, depth, rank), rank from 1 in the order of visits.

    ``starts``: (by, url, rank); ``edges``: (url, link, place), of which the first ``per_page`` of a page are followed;
    ``visited``: (by, url) of earlier runs, which give no page.  ``by`` names columns of crawls that run side by side, as
    many as there are; ``max_pages`` may then name a column of ``starts`` that is the same for all starts of a crawl.
    A crawl ends when it has found that many pages.

    One round for each level: the frontier and what it finds are written to the shared folder, so the plan stays as
    short at any depth, and the loop ends with the last crawl that still looks for pages.  An address belongs to the
    frontier of the first page that links to it; its place there is (rank of that page, place of the link), as numbers.
    """
    by = list(by)
    known = pages.select("url").distinct()
    firsts = edges.withColumn("_n", F.row_number().over(Window.partitionBy("url").orderBy("place", "link"))).where(F.col("_n") <= per_page).select("url", "link", "_n")
    most = F.col(max_pages) if isinstance(max_pages, str) else F.lit(max_pages)
    limits = keep(starts.groupBy(*by).agg(F.max(most).cast("long").alias("_most"))) if by else None
    at = F.struct(F.col("rank").cast("long").alias("page"), F.lit(0).alias("n"))
    frontier = keep(starts.groupBy(*by, "url").agg(F.min(at).alias("_at")))
    seen, out = frontier.select(*by, "url"), None
    total = None if by else (max_pages if isinstance(max_pages, int) else starts.agg(F.max(most)).first()[0])
    for d in range(depth + 1):
        hits = frontier.join(known, "url")
        if visited is not None:
            hits = hits.join(visited.select(*by, "url").distinct(), [*by, "url"], "left_anti")
        if by:
            so_far = out.groupBy(*by).agg(F.count("*").alias("_had")) if out is not None else limits.select(*by).limit(0).withColumn("_had", F.lit(0))
            place = F.row_number().over(Window.partitionBy(*by).orderBy("_at", "url"))
            ranked = hits.join(limits, by).join(so_far, by, "left").withColumn("rank", place + F.coalesce("_had", F.lit(0)))
            found = ranked.where(F.col("rank") <= F.col("_most"))
        else:
            had = out.count() if out is not None else 0
            first = hits.orderBy("_at", "url").limit(max(0, total - had))
            found = first.withColumn("rank", F.row_number().over(Window.orderBy("_at", "url")) + had)  # of ``max_pages`` rows
        found = keep(found.select(*by, "url", F.lit(d).alias("depth"), "rank"))
        out = found if out is None else out.unionByName(found)
        if d == depth:
            break
        if by:
            full = out.groupBy(*by).agg(F.count("*").alias("_had")).join(limits, by).where("_had >= _most").select(*by)
            open_ = found.join(full, by, "left_anti")
        else:
            open_ = found.where(F.lit(out.count() < total))
        links = open_.join(firsts, "url").select(*by, F.col("link").alias("url"), F.struct(F.col("rank").cast("long").alias("page"), F.col("_n").alias("n")).alias("_at"))
        frontier = keep(links.groupBy(*by, "url").agg(F.min("_at").alias("_at")).join(seen, [*by, "url"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.select(*by, "url"))
    return out


def unseen_domains(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows (url, ...) whose host no row of ``seen`` (url) has."""
    host = lambda df: df.withColumn("_host", urls.authority(F.col("url")))
    return host(rows).join(host(seen).select("_host").distinct(), "_host", "left_anti").select(rows.columns)


def new_pages(rows: DataFrame, visited: DataFrame) -> DataFrame:
    """Rows (url, ...) to fetch: valid, not visited in this run or an earlier one, each address once."""
    todo = rows.where(urls.is_valid(F.col("url"))).withColumn("url", urls.normalise(F.col("url"))).dropDuplicates(["url"])
    return todo.join(visited.select(urls.normalise(F.col("url")).alias("url")).distinct(), "url", "left_anti")


def result_pages(results: DataFrame, pages: DataFrame, per_query: int, visited: DataFrame, priority: list[str]) -> DataFrame:
    """Pages of search results: the first provider's, of hosts not seen yet, ``per_query`` of each query; ``extract``
    makes contents of them."""
    fresh = unseen_domains(results, visited)
    picked = new_pages(pick_provider(fresh, priority, per_query).select("query", "url"), visited)
    wanted = picked.select(F.col("url").alias("_normal")).distinct()
    return pages.withColumn("_normal", urls.normalise(F.col("url"))).join(wanted, "_normal", "left_semi").select(pages.columns)


def pick_provider(results: DataFrame, priority: list[str], per_query: int) -> DataFrame:
    """Of search results (query, provider, rank, url) those of the first provider that has any, valid and each once."""
    place = F.array_position(F.array(*map(F.lit, priority)), F.col("provider"))
    valid = results.where(urls.is_valid(F.col("url"))).withColumn("_p", place).where("_p > 0")
    best = valid.groupBy("query").agg(F.min("_p").alias("_p"))
    rows = valid.join(best, ["query", "_p"]).groupBy("query", "provider", "url").agg(F.min("rank").alias("rank"))
    n = F.row_number().over(Window.partitionBy("query").orderBy("rank", "url"))
    return rows.withColumn("_n", n).where(F.col("_n") <= per_query).drop("_n")
