import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from strandline.llm import suffixes as s

BITS = 18


def brute(rows):
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(raw[i : i + 400] for raw in raws for i in range(len(raw) - 399))
    out = []
    for (d, _), raw in zip(rows, raws, strict=True):
        gone = bytearray(len(raw))
        for i in range(len(raw) - 399):
            if seen[raw[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((str(d), len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus():
    rng = random.Random(17)
    letters = "abcdefgh ijklmnop éß日\n"
    make = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = [make(n) for n in (300, 380, 399, 400, 401, 450, 700, 1500, 4000)]
    rows = []
    for d in range(60):
        parts = [make(rng.randrange(900)) for _ in range(3)]
        for _ in range(rng.randrange(3)):
            passage = rng.choice(shared)
            if rng.random() < 0.5:  # a near copy, changed in one place
                at = rng.randrange(len(passage))
                passage = passage[:at] + "#" + passage[at + 1 :]
            if rng.random() < 0.3:
                at = rng.randrange(len(passage))
                passage = passage[at:]
            parts.insert(rng.randrange(len(parts)), passage)
        rows.append((d, "".join(parts)))
    rows += [(100, rows[3][1]), (3, rows[3][1]), (None, rows[4][1]), (101, None), (102, ""), (103, "a" * 399), (104, "a" * 401), (105, "ab" * 700), (106, shared[7] + shared[7]), (107, "x" * 3000 + make(500))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("hot", "shard", "table"), [(20_000, 2048, 0), (20_000, 16, 0), (3, 2048, 100_000), (3, 2048, 0)])
def test_matches_brute_force(spark, monkeypatch, hot, shard, table):
    monkeypatch.setattr(s, "HOT", hot)
    monkeypatch.setattr(s, "HOT_TABLE", table)
    monkeypatch.setattr(s, "SHARD", shard)
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "k", 1) for d, t in rows], "doc_id long, text string, key string, start int")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in s.digest(docs, BITS).collect())
    assert got == brute(rows)


def test_kept_bytes_and_empty(spark):
    one = "".join(chr(97 + i * i % 26) + str(i) for i in range(200))
    docs = spark.createDataFrame([(1, "<" + one + ">"), (2, one + "!"), (3, "other")], "doc_id long, text string")
    assert {r.doc_id: bytes(r.kept) for r in s.dedup_bytes(docs, BITS).collect()} == {1: b"<>", 2: b"!", 3: b"other"}
    assert s.dedup_bytes(docs.limit(0), BITS).count() == 0


def test_very_long_text(spark):
    rng = random.Random(4)
    make = lambda n: "".join(rng.choices("abcdefghij ", k=n))
    shared = make(600)
    rows = [(1, make(50) + shared), (2, make(1_200_000) + shared + make(400))]  # over two slices
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in s.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows)


@pytest.mark.parametrize("unit", ["a", "abcdefg", "The same line of some sixty letters, over and over, with é.\n", "x" * 150 + "yz" * 30])
def test_very_long_repetitive_texts(spark, unit):
    """Places with a repeated anchor stand as dense as bytes here; the whole text is removed, in one run."""
    n = 6_000_000 // len(unit)
    long = unit * n
    size = len(long.encode())
    rows = [(1, long), (2, "lead " + unit * 10), (3, "free")]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in s.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    body = 10 * len(unit.encode())
    assert got[1] == (size, size, 1) and got[3] == (4, 0, 0)
    assert got[2] == ((5 + body, body, 1) if body >= 400 else (5 + body, 0, 0))


def test_pieces_of_a_long_text_agree_with_brute_force(spark, monkeypatch):
    monkeypatch.setattr(s, "SLICE", 900)
    rows = corpus() + [(200, "".join(t or "" for _, t in corpus()))]
    for hot in (20_000, 3):
        monkeypatch.setattr(s, "HOT", hot)
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in s.digest(docs, BITS).collect())
        assert got == brute(rows)


def test_only_hot_strings_are_hashed(monkeypatch):
    """Of 40 KB under one hot anchor in about 350, the digests are those of the whole slice's and little else is hashed."""
    rng = np.random.default_rng(5)
    data, offs = rng.integers(0, 256, 40_000).astype(np.uint8), np.array([0, 9_000, 9_300, 9_300, 40_000])
    _, _, first, last, key = s.anchors(data, offs)
    cells, bits = s.substrings.cells_of(key, 20)[0], np.zeros(1 << 17, np.uint8)
    chosen = np.array([3, 4, 5, len(key) // 2, len(key) - 1])  # neighbours share bytes
    np.bitwise_or.at(bits, cells[chosen] >> 3, (1 << (cells[chosen] & 7)).astype(np.uint8))
    want = np.concatenate([np.arange(first[i], last[i] + 1) for i in chosen])
    whole = [s.substrings._combined(t[data], s.LENGTH)[want].view(np.int64) for t in s._SEEDS]
    hashed, real = [], s.substrings._combined
    monkeypatch.setattr(s.substrings, "_combined", lambda words, width: hashed.append(len(words)) or real(words, width))
    at, digests = s._hot_strings(data, offs, (bits, 20))
    assert at.tolist() == want.tolist() and all((a == b).all() for a, b in zip(digests, whole, strict=True))
    assert max(hashed) <= 5 * (s.LENGTH + s.LENGTH - s.CONTEXT)
