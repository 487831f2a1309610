import hashlib
import random
import re

import pytest

from strandline.llm import substrings as s

BITS = 18


def brute(rows):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (d, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - 12):
            if d is not None:
                k = tuple(w[i : i + 13])
                first[k] = min(d, first.get(k, d))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = {i + k for i in range(len(w) - 12) if d is not None and first[tuple(w[i : i + 13])] < d for k in range(13)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((str(d), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def corpus():
    rng = random.Random(11)
    words = ["w%d" % i for i in range(300)] + ["é", "日本", "W1"]
    passages = [rng.choices(words, k=rng.choice([12, 13, 14, 40])) for _ in range(6)]
    rows = []
    for d in range(120):
        parts = [rng.choices(words, k=rng.randrange(30)) for _ in range(3)]
        for _ in range(rng.randrange(3)):
            parts.insert(rng.randrange(len(parts)), rng.choice(passages))
        rows.append((d * 3, rng.choice([" ", "\n", "\t "]).join(x for p in parts for x in p)))
    rows += [(2000, rows[0][1]), (5, rows[0][1]), (rows[1][0], rows[1][1]), (None, rows[0][1]), (3000, None), (3001, ""), (3002, "a " * 500), (3003, "a " * 200), (1, " ".join(passages[5]))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("hot", "table"), [(20_000, 1000), (5, 100_000), (5, 0)])
def test_matches_brute_force(spark, monkeypatch, hot, table):
    monkeypatch.setattr(s, "HOT", hot)
    monkeypatch.setattr(s, "HOT_TABLE", table)
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, key string, word int")
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in s.digest(docs, BITS).collect())
    assert got == brute(rows)


def test_crowded_sketch_loses_nothing(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in s.digest(docs, 16).collect())
    assert got == brute(rows)


def test_kept_text_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l m"), (2, "x a b c d e f g h i j k l m\ty")], "doc_id long, text string")
    assert {r.doc_id: r.kept_text for r in s.dedup_windows(docs, BITS).collect()} == {1: "a b c d e f g h i j k l m", 2: "x y"}
    assert s.dedup_windows(docs.limit(0), BITS).count() == 0


def thue_morse(n):
    """Words that every polynomial hash modulo 2**64 with an odd base confuses with their complement."""
    flags = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[f] for f in flags), "".join("ba"[f] for f in flags)


def test_words_are_told_apart(spark):
    one, other = thue_morse(1024)
    common = " ".join(f"c{i}" for i in range(12))
    rows = [(1, f"{common} {one}"), (2, f"{common} {other}"), (3, f"{common} {one}")]
    got = {r.doc_id: r.n_removed for r in s.digest(spark.createDataFrame(rows, "doc_id long, text string"), BITS).collect()}
    assert got == {1: 0, 2: 0, 3: 13}


def test_very_long_text(spark):
    rng = random.Random(5)
    part = " ".join(f"v{rng.randrange(10**6)}" for _ in range(40))
    long = " ".join(f"u{i}" for i in range(600_000))  # over one slice
    rows = [(1, part), (2, f"{long} {part} {long[:2000]}x")]
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in s.digest(spark.createDataFrame(rows, "doc_id long, text string"), None).collect())
    assert got == brute(rows)


def test_bitmap_of_hot_keys_marks_each_and_few_others(spark):
    import numpy as np

    keys = [(k * 7919 - 5, n) for k, n in ((k, 12 if k % 3 == 0 else 2) for k in range(300))]
    rows = spark.createDataFrame(keys, "key long, n int").selectExpr("key", "explode(sequence(1, n)) AS i").select("key")
    marks = s.hot_bitmap(rows, 5)
    flags = s.is_hot(marks, np.array([k for k, _ in keys], np.int64).view(np.uint64))
    hot = np.array([n > 5 for _, n in keys])
    assert flags[hot].all() and flags[~hot].sum() < 20
    assert s.hot_bitmap(rows, 50) is None
