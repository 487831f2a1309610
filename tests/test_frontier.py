"""Links of pages and the crawl frontier against a plain breadth-first crawl."""

import random
from urllib.parse import urlsplit

import pytest

from strandline.operators import crawl


def test_links_of_every_kind():
    html = """<A HREF=' first '>x</A><base href="/sub/"><base href="/other/"><area href=two.html><iframe src="//h.org/three"></iframe>
    <link rel="sitemap" href="map.xml"><link rel="stylesheet" href="no.css"><LINK REL="Canonical Next" href="/c"><meta http-equiv="Refresh" content="5; URL = four.html;x">
    <meta http-equiv="refresh" content="5"><script type="application/LD+JSON">{"@id": "five", "x": [{"sameAs": ["six", 3, {"url": "seven"}]}]}</script>
    <script type="application/ld+json">{broken</script><a href="mailto:a@b">m</a><a href="#top">t</a><a href="JavaScript:x()">j</a><a href>n</a><a href="first">again</a>"""
    base = "https://h.org/sub/"
    want = ["first", "two.html", None, "map.xml", None, "four.html", "five", "six", "seven"]
    assert crawl.links_of(html, "https://h.org/dir/page") == [base + w if w else x for w, x in zip(want, ["", "", "https://h.org/three", "", "https://h.org/c", "", "", "", ""], strict=True)]
    assert crawl.links_of(None, "https://h.org/") == [] and crawl.links_of("<a href='http://[bad'>x</a><a href=y>", "https://h.org/") == ["https://h.org/y"]


def brute(pages, links, depth, cap):
    by_url, out = {}, []
    for page, url, _ in sorted(pages):
        by_url.setdefault(url, page)
    host = lambda u: (urlsplit(u).hostname or "").removeprefix("www.")
    for source in {host(u) for u in by_url}:
        first = min((p, u) for u, p in by_url.items() if host(u) == source)[1]
        seen, level, n = {first}, [first], 0
        for k in range(depth + 1):
            here = []
            for u in level:
                if u in by_url and n < cap:
                    n += 1
                    here.append(u)
                    out.append((source, u, k, n))
            level = []
            for u in here:
                for v in links[by_url[u]]:
                    if v not in seen and (host(v) == source or host(v).endswith("." + source)):
                        seen.add(v)
                        level.append(v)
    return sorted(out)


@pytest.mark.parametrize(("depth", "cap", "parts"), [(3, 10_000, 3), (3, 17, 5), (2, 1, 2), (0, 5, 4)])
def test_frontier_is_a_breadth_first_crawl(spark, depth, cap, parts):
    rng = random.Random(cap)
    hosts = ["www.a.org", "a.org", "x.a.org", "b.org", "notb.org"]
    urls = [f"https://{rng.choice(hosts[:3] if i < 60 else hosts)}/p{i}" for i in range(90)]
    links = {i: rng.sample(urls + [f"https://a.org/missing{k}" for k in range(20)] + ["https://b.org/picture.png"], rng.randrange(9)) for i in range(80)}
    pages = [(i, urls[i], "".join(f'<a href="{u}">l</a>' for u in links[i])) for i in range(80)] + [(200, urls[3], "<a href='https://a.org/never'>")]
    links = {i: [u for u in v if not u.endswith("png")] for i, v in links.items()}
    links[200] = []
    got = crawl.frontier(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3), depth, cap, parts=parts)
    assert sorted(map(tuple, got.collect())) == brute(pages, links, depth, cap)


def test_redirects_and_empty(spark):
    pages = [(1, "https://a.org/", "<a href=old><a href=new><a href=third>"), (2, "https://a.org/old", ""), (3, "https://a.org/new", ""), (4, "https://a.org/third", "<a href=new>")]
    rows = [(p, u, h, "https://a.org/new" if p == 2 else None) for p, u, h in pages]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, final_url string")
    got = crawl.frontier(df, 2, 10)
    assert [(r.url, r.level) for r in got.orderBy("place").collect()] == [("https://a.org/", 0), ("https://a.org/old", 1), ("https://a.org/new", 1), ("https://a.org/third", 1)]
    late = crawl.frontier(spark.createDataFrame([(p, u, h.replace("<a href=new>", "", 1) if p == 1 else h, f) for p, u, h, f in rows], df.schema), 2, 10)
    assert "https://a.org/new" not in {r.url for r in late.collect()}  # reached under its final name by the redirect before
    assert crawl.frontier(df.limit(0), 2, 10).count() == 0
