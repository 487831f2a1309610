"""Links out of pages and the crawl frontier, level by level."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import canonical_url
from ..session import checkpointed
from .scans import Counted, scan

#: File endings that are no pages, and those that are documents all the same.
SKIPPED = (
    "jpg", "jpeg", "png", "gif", "svg", "webp", "ico", "bmp", "tiff", "zip", "tar", "gz", "tgz", "rar", "7z", "mp4", "mp3", "mov", "avi", "wmv", "webm",
    "ogg", "wav", "flac", "css", "js", "mjs", "map", "woff", "woff2", "ttf", "otf", "eot", "json", "xml", "rss", "atom", "dmg", "exe", "pkg", "deb", "rpm", "msi",
)
DOCUMENTS = ("pdf", "doc", "docx", "csv", "txt", "json", "xml", "rss", "atom")
_JSON_KEYS = ("url", "@id", "mainEntityOfPage", "sameAs")
_RELATED = re.compile("canonical|alternate|next|prev|sitemap", re.IGNORECASE)
_REFRESH = re.compile(r"url\s*=\s*([^\s;'\"]+)", re.IGNORECASE)


class _Links(HTMLParser):
    """Links as they are written, and the page's first base, which holds for all of them."""

    def __init__(self):
        super().__init__()
        self.base, self.found, self.script = None, [], None

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "base":
            self.base = self.base if self.base is not None else a.get("href")
        elif tag in ("a", "area"):
            self.add(a.get("href"))
        elif tag in ("iframe", "frame"):
            self.add(a.get("src"))
        elif tag == "link" and _RELATED.search(a.get("rel", "")):
            self.add(a.get("href"))
        elif tag == "meta" and a.get("http-equiv", "").lower() == "refresh":
            self.add((_REFRESH.search(a.get("content", "")) or [None, None])[1])
        elif tag == "script":
            self.script = "" if a.get("type", "").lower() == "application/ld+json" else None

    def handle_data(self, data):
        if self.script is not None:
            self.script += data

    def handle_endtag(self, tag):
        if tag == "script" and self.script is not None:
            try:
                self.harvest(json.loads(self.script))
            except (ValueError, RecursionError):
                pass
            self.script = None

    def harvest(self, root):
        """URLs below linked data, however deep, without recursion of our own."""
        todo = [root]
        while todo:
            node = todo.pop(0)
            if isinstance(node, dict):
                for key in _JSON_KEYS:
                    said = node.get(key)
                    for x in said if isinstance(said, list) else [said]:
                        if isinstance(x, str):
                            self.add(x)
                todo.extend(node.values())
            elif isinstance(node, list):
                todo.extend(node)

    def add(self, href):
        href = (href or "").strip()
        if href and not href.lower().startswith(("#", "javascript:", "mailto:", "tel:")):
            self.found.append(href)


def links_of(html: str | None, url: str) -> list[str]:
    """URLs a page leads to, each once; a malformed page gives what was found before."""
    parser = _Links()
    try:
        parser.feed(html or "")
        parser.close()
    except AssertionError:  # the parser gives up on some malformed declarations; what it found stands
        pass
    out = []
    for href in parser.found:
        try:
            out.append(urljoin(urljoin(url, parser.base) if parser.base else url, href))
        except ValueError:
            pass
    return list(dict.fromkeys(u for u in out if u.startswith(("http://", "https://"))))


def links(pages: DataFrame) -> DataFrame:
    """(page_id, place, link) of every page."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, i, u) for p, url, html in zip(f["page_id"], f["url"], f["html"], strict=True) for i, u in enumerate(links_of(html, url or ""))]
            yield pd.DataFrame(rows, columns=["page_id", "place", "link"])

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, place int, link string")


def is_page(url) -> object:
    """Whether a URL may lead to text; endings of documents win over skipped ones."""
    ending = F.lower(F.regexp_extract(url, r"://[^/?#]*/(?:[^?#]*)\.([A-Za-z0-9]+)(?:[?#]|$)", 1))
    return ending.isin(*DOCUMENTS) | ~ending.isin(*SKIPPED)


def root_host(url: Column) -> Column:
    """Lower host of a URL without one leading www., null if it has none."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", ""), F.lit(""))


def frontier(pages: DataFrame, depth: int, cap: int, seeds: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """(source, url, level, place): the pages that a crawl of each source fetches, breadth first, `cap` of a source in all.

    pages: page_id, url, html and maybe final_url, where a redirect led. seeds: source, a root host, and url; without them each
    host is a source and starts from its page of least page_id. A source's crawl stays on its host and that one's subdomains,
    fetches a URL once under its own and its final name, and passes over file endings that are no text. A URL that is no
    page is a failed fetch and takes no slot. place is the order of discovery: by level, then the place of the page that leads
    there, then the link's place in it. Slots of a level are reserved by a count of this order over all ranges of rows at once,
    so the cap is exact and no task holds a source. An empty table gives no rows.
    """
    final = F.coalesce("final_url", "url") if "final_url" in pages.columns else F.col("url")
    known = pages.filter("url is not null").select(canonical_url(F.col("url")).alias("url"), canonical_url(final).alias("final_url"), "page_id").groupBy("url").agg(F.min(F.struct("page_id", "final_url")).alias("p")).select("url", "p.page_id", "p.final_url")
    known = checkpointed(known.withColumn("host", root_host(F.col("url"))))
    edges = checkpointed(links(pages).select("page_id", "place", canonical_url(F.col("link")).alias("link")).filter(is_page(F.col("link"))).groupBy("page_id", "link").agg(F.min("place").alias("place")))
    if seeds is None:
        seeds = known.filter("host is not null").groupBy(F.col("host").alias("source")).agg(F.min(F.struct("page_id", "url")).alias("p")).select("source", "p.url")
    fresh = seeds.select("source", canonical_url(F.col("url")).alias("url"), F.lit(0).alias("parent"), F.lit(0).alias("link_place")).dropDuplicates(["source", "url"])
    fetched = seen = None
    for level in range(depth + 1):
        met = fresh.join(known.select("url", "page_id", "final_url"), "url", "left").withColumn("is_page", F.col("page_id").isNotNull())
        placed = scan(met, ["source"], ["parent", "link_place", "url"], [Counted("is_page", "nth")], parts)
        if fetched is not None:
            taken = fetched.groupBy("source").agg(F.count("*").alias("taken"))
            placed = placed.join(taken, "source", "left")
        placed = checkpointed(placed.withColumn("place", F.col("nth") + (F.coalesce("taken", F.lit(0)) if fetched is not None else F.lit(0))))
        here = placed.filter(F.col("is_page") & (F.col("place") <= cap)).select("source", "url", F.lit(level).alias("level"), "place", "page_id")
        names = placed.select("source", "url").unionByName(placed.filter("is_page").select("source", F.col("final_url").alias("url")))
        seen = checkpointed((names if seen is None else seen.unionByName(names)).distinct())
        fetched = here if fetched is None else fetched.unionByName(here)
        if level == depth or here.isEmpty():
            break
        led = here.select("source", "page_id", F.col("place").alias("parent")).join(edges.withColumnRenamed("place", "link_place"), "page_id")
        inside = (root_host(F.col("link")) == F.col("source")) | F.endswith(root_host(F.col("link")), F.concat(F.lit("."), "source"))
        fresh = led.filter(inside).groupBy("source", F.col("link").alias("url")).agg(F.min(F.struct("parent", "link_place")).alias("f")).select("source", "url", "f.parent", "f.link_place").join(seen, ["source", "url"], "left_anti")
    return fetched.select("source", "url", "level", "place")


def robots_allowed(urls: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """(url, allowed): what each origin's rules say. No rules, or an answer of 400 and up, allow; other schemes are denied.

    robots: origin, status, body, one row an origin. Urls meet their origin's rules by a join, so every task parses each
    origin's file once for a run of its urls.
    """
    from functools import lru_cache
    from urllib.robotparser import RobotFileParser

    web = F.col("url").rlike("(?i)^https?://[^/?#]")
    origin = F.when(web, F.lower(F.regexp_extract("url", r"^([A-Za-z]+://[^/?#]+)", 1)))
    rules = robots.filter("status < 400").select("origin", "body")
    rows = urls.select("url", origin.alias("origin")).join(rules, "origin", "left")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        @lru_cache(maxsize=256)
        def parsed(body: str) -> RobotFileParser:
            p = RobotFileParser()
            p.parse(body.splitlines())
            return p

        for f in frames:
            yield pd.DataFrame({"url": f["url"], "allowed": [parsed(b).can_fetch(agent, u) for u, b in zip(f["url"], f["body"], strict=True)]})

    ruled = rows.filter("body is not null").select("url", "body").mapInPandas(run, "url string, allowed boolean")
    return ruled.unionByName(rows.filter("body is null").select("url", F.col("origin").isNotNull().alias("allowed")))


def retrieved(answers: DataFrame) -> DataFrame:
    """Answers (url, chain, status, content_type, body) as they are kept: final URL, chain of redirects, whether it is HTML."""
    html = F.lower(F.coalesce("content_type", F.lit(""))).contains("html")
    return answers.withColumn("final_url", F.coalesce(F.element_at("chain", -1), "url")).withColumn("redirect_chain", F.when(F.size("chain") > 1, F.col("chain"))).withColumn("is_html", html)
