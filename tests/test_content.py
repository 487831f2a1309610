"""Main content against a plain scorer, and token counts against the library."""

import base64
import random
import re

import pytest

from strandline.operators import content, tokens

ARTICLE = "The harbour was rebuilt after the storm of that winter, and the ferry ran again in the spring of the next year."
PAGE = f"""<!doctype html><html><head><title> The  Harbour </title><style>p {{}}</style><script>var a = "<p>no</p>";</script></head><body>
<nav><ul><li><a href=/>Home</a><li><a href=/news>News of the day and of the week before</a></ul></nav>
<div class=menu><a href=1>One page of many pages that there are here</a> <a href=2>Another page of many pages that there are</a></div>
<article><h1>The Harbour</h1><p>{ARTICLE}</p><p>It cost much.</p><p>{ARTICLE} <a href=x>More</a></p></article>
<div><a href=a>Read this other long story about the sea and the land</a></div><footer>Imprint and all that stands at the end of pages like this one</footer></body></html>"""


def test_article_without_menu(spark):
    r = content.extracted(spark.createDataFrame([(1, PAGE, "x")], "page_id long, html string, text string")).first()
    assert r.title == "The Harbour" and r.text == f"The Harbour {ARTICLE} It cost much. {ARTICLE} More"


def plain(blocks):
    weight = []
    for text, linked in blocks:
        letters = len(text.replace(" ", ""))
        weight.append((len(text.split(" ")) * (1 - min(1, linked / max(1, letters))), linked / max(1, letters)))
    out = []
    for i, (text, _) in enumerate(blocks):
        smooth = weight[i][0] / 2 + (weight[i - 1][0] / 4 if i else 0) + (weight[i + 1][0] / 4 if i + 1 < len(blocks) else 0)
        if smooth >= content.LEAST and weight[i][1] <= content.LINKED:
            out.append(text)
    return out


def test_scores_equal_a_plain_version_on_the_pages(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r for r in content.extracted(df).collect()}
    assert len(got) == df.count()
    for r in df.collect():
        blocks, title = content.blocks_of(r.html)
        want = plain(blocks)
        assert (got[r.page_id].kept, got[r.page_id].blocks, got[r.page_id].title) == (len(want), len(blocks), title or None)
        if want and "read more" not in r.html.lower():
            assert got[r.page_id].text == re.sub(r"\s+", " ", " ".join(want)).strip()


@pytest.mark.parametrize("html", [None, "", "<", "<p", "<![bad", "<!--never closed <p>x", "<script>never closed <p>x", "</p></a></nav>", "<a><a><a>x", "<p>" * 5000 + "x", "\x00<p>a\x00b", "&lt;&amp;&#0;&#x110000;"])
def test_malformed_pages(spark, html):
    r = content.extracted(spark.createDataFrame([(1, html)], "page_id long, html string")).first()
    assert r.page_id == 1 and r.text is not None


def test_a_long_page_takes_linear_time(spark):
    page = f"<p>{ARTICLE}</p><a href=x>l</a>" * 20_000
    r = content.extracted(spark.createDataFrame([(1, page)], "page_id long, html string")).first()
    assert r.kept == 20_000 and len(r.text) > 2_000_000


@pytest.fixture(scope="module")
def library():
    import tiktoken

    with open(tokens.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


def test_token_counts_equal_the_library(spark, library):
    encoding, _ = library
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    odd = [(-1, None), (-2, ""), (-3, "  \n\t x  "), (-4, "日本語 ½ é́ \U0001f600‍ <|endoftext|> don't we'LL"), (-5, "a" * 30_000), (-6, " " * 50 + "end "), (-7, "-=" * 4000)]
    rows = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    for r in tokens.counted(rows).collect():
        assert r.n_tokens == len(encoding.encode_ordinary(r.text or "")), r.doc_id


def test_ids_of_random_pieces_equal_the_library(library):
    encoding, ranks = library
    rng = random.Random(2)
    for _ in range(500):
        piece = "".join(rng.choices("abcdeé日", k=rng.randrange(1, 40)))
        assert tokens.merged(piece.encode(), ranks) == encoding._encode_single_piece(piece.encode())
