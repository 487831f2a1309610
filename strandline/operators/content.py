"""The main content of pages: blocks of text, scored by their words and links, smoothed over their neighbours.

A page is cut at block elements. A block's weight is its words outside links; the weights are smoothed over the block before
and after, so a short paragraph between long ones stays and a long line alone among links goes. Parsing is one pass over
the page; the scores of all blocks of a batch are computed at once. Its main-content library of old is not at hand, so the
choice of blocks is our own: precision comes first, and a page without any such block gives all its text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars

#: Least smoothed weight of a block, and the share of a block's letters that links may hold.
LEAST, LINKED = 6.0, 0.4
#: Elements that begin a block, and those whose text is no content.
BLOCKS = frozenset("address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
SILENT = frozenset("script style noscript template svg head button select textarea nav footer".split())
_SPACE = re.compile(r"\s+")


class _Blocks(HTMLParser):
    """(text, letters within links) of each block, and the page's title. Silent elements may stay open to the end."""

    def __init__(self):
        super().__init__()
        self.blocks, self.parts, self.linked = [], [], 0
        self.in_link, self.silent, self.title, self.in_title = 0, [], [], False

    def cut(self):
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            self.blocks.append((text, self.linked))
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag == "title":
            self.in_title = True
        if tag in SILENT:
            self.cut()
            self.silent.append(tag)
        elif tag in BLOCKS:
            self.cut()
        elif tag == "a":
            self.in_link += 1
        if tag == "body":
            self.silent = [t for t in self.silent if t != "head"]  # a head that was never closed ends here

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        if tag in self.silent:
            while self.silent.pop() != tag:
                pass
        elif tag in BLOCKS:
            self.cut()
        elif tag == "a":
            self.in_link = max(0, self.in_link - 1)

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.silent:
            self.parts.append(data)
            if self.in_link:
                self.linked += len(_SPACE.sub("", data))


def blocks_of(html: str | None) -> tuple[list[tuple[str, int]], str]:
    """(blocks, title); what a malformed page holds before the parser gives up."""
    parser = _Blocks()
    try:
        parser.feed((html or "").replace("\x00", ""))
        parser.close()
    except AssertionError:
        pass
    parser.cut()
    return parser.blocks, _SPACE.sub(" ", "".join(parser.title)).strip()


def chosen(words: np.ndarray, letters: np.ndarray, linked: np.ndarray, page: np.ndarray) -> np.ndarray:
    """Which blocks are content; page numbers the page of each block and does not fall."""
    share = linked / np.maximum(letters, 1)
    weight = words * (1 - np.minimum(share, 1))
    smooth = weight / 2
    same = page[1:] == page[:-1]
    smooth[1:] += np.where(same, weight[:-1] / 4, 0)
    smooth[:-1] += np.where(same, weight[1:] / 4, 0)
    return (smooth >= LEAST) & (share <= LINKED) & (words > 0)


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, title, text, blocks, kept) of pages (page_id, html): the content as one line of text, null title if there is none.

    A page of which no block is content gives all its text without tags; null and empty pages give an empty text. A list of
    related pages at the end goes, as in scalars.without_tail. Whole pages are read, malformed ones too.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            parsed = [blocks_of(h) for h in f["html"]]
            page = np.repeat(np.arange(len(parsed)), [len(b) for b, _ in parsed])
            flat = [b for blocks, _ in parsed for b in blocks]
            words = np.array([t.count(" ") + 1 for t, _ in flat], float)
            letters = np.array([len(t) - t.count(" ") for t, _ in flat], float)
            keep = chosen(words, letters, np.array([n for _, n in flat], float), page) if flat else np.zeros(0, bool)
            texts: list[list[str]] = [[] for _ in parsed]
            for i in np.flatnonzero(keep).tolist():
                texts[page[i]].append(flat[i][0])
            yield pd.DataFrame({"page_id": f["page_id"], "title": [t or None for _, t in parsed], "text": ["\n".join(t) for t in texts], "blocks": [len(b) for b, _ in parsed], "kept": [len(t) for t in texts], "html": f["html"]})

    rows = pages.select("page_id", "html").mapInPandas(run, "page_id long, title string, text string, blocks int, kept int, html string")
    whole = F.when(F.col("kept") > 0, F.col("text")).otherwise(F.coalesce(scalars.without_tags(F.col("html")), F.lit("")))
    return rows.select("page_id", "title", scalars.collapsed(scalars.without_tail(whole)).alias("text"), "blocks", "kept")
