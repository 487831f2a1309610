import random

import pytest
import sentencepiece

from strandline.llm import pieces as p

LIB = sentencepiece.SentencePieceProcessor(model_file=p.DEFAULT_MODEL)
CODEC = p.Codec(open(p.DEFAULT_MODEL, "rb").read())
ALPHABETS = ["abcdefgh etaoin shrdlu THE ", "aaaa bb", "  a \n\t", "éßñ 日本語 ж я 😀́ x", "<s></s><0x0A>0123456789.,:;(){}[]==--__", "the quick brown foxes jumping internationalization "]


def samples():
    rng = random.Random(7)
    out = ["", " ", "  ", "a", "\n", " a  b ", "▁x", "a" * 3000, "ab" * 999, "\0x", "internationalization" * 40]
    for _ in range(500):
        alphabet = rng.choice(ALPHABETS)
        out.append("".join(rng.choice(alphabet) for _ in range(rng.randrange(90))))
    return out


def test_ids_equal_the_library():
    for text in samples():
        assert CODEC.encode(text).tolist() == LIB.encode(text), repr(text)


def test_decoding_is_exact():
    for text in samples():
        if "▁" not in text:
            assert CODEC.decode(CODEC.encode(text).tolist()) == text == LIB.decode(LIB.encode(text)), repr(text)


@pytest.mark.parametrize("chunk", [17, 40, 333])
def test_chunks_scan_to_the_library(chunk):
    for text in [x for x in samples() if len(x) > chunk]:
        symbols, cells = p.normalised(text), []
        for c in range(0, len(symbols), chunk):
            left = max(0, c - CODEC.longest)
            end = min(len(symbols), c + chunk)
            cells.append((symbols[left : min(len(symbols), c + chunk + CODEC.longest)], c - left, end - left, left, end == len(symbols)))
        rows = [{(e[0] + left, e[1]): {(x[0] + left, x[1]): s for x, s in row.items()} for e, row in CODEC.matrix(part, b, end, k == 0, last).items()} for k, (part, b, end, left, last) in enumerate(cells)]
        path = p.states(rows)
        got = b"".join(CODEC.between(part, b, end, (e[0] - left, e[1]), (x[0] - left, None)) for (part, b, end, left, _), (e, x) in zip(cells, path, strict=True))
        assert list(memoryview(got).cast("i")) == LIB.encode(text), repr(text)


def test_product_is_associative():
    text = p.normalised("some words and an extraordinarily-long-unbroken-token " * 6)
    m = [CODEC.matrix(text, i * 40, (i + 1) * 40, i == 0, False) for i in range(4)]
    assert p.combine(p.combine(m[0], m[1]), p.combine(m[2], m[3])) == p.combine(p.combine(p.combine(m[0], m[1]), m[2]), m[3])


def test_query_over_rows(spark):
    texts = samples()[:60]
    rows = [(i, t, "ids") for i, t in enumerate(texts)] + [(7, texts[7], "again"), (None, "no id", "x"), (900, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = p.encode(docs, chunk=64).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "no id" if r.doc_id is None else "" if r.doc_id == 900 else texts[r.doc_id]
        assert r.ids == LIB.encode(text)
    back = p.decode(p.encode(docs, chunk=64)).filter("doc_id = 13").first()
    assert back.decoded == texts[13]
    assert p.encode_decode(docs.limit(0)).count() == 0


def test_frequent_words_outlast_a_full_cache(monkeypatch):
    """Words that keep coming are encoded once, however many rare ones pass through."""
    monkeypatch.setattr(p, "_CACHE", 50)
    codec, asked = p.Codec(open(p.DEFAULT_MODEL, "rb").read()), []
    word = codec.word
    monkeypatch.setattr(codec, "word", lambda text: asked.append(text) or word(text))
    for k in range(400):
        text = f"extraordinary rare{k}word"
        assert codec.encode(text).tolist() == LIB.encode(text)
    assert asked.count("▁extraordinary") == 1 and len(codec.words) + len(codec.words.older) <= 102
