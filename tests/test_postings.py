"""Documents for many questions against a plain search of every text."""

import random
import re

import pytest

from strandline.functions.scalars import STOP_WORDS
from strandline.operators import postings


def terms(text):
    return {t for t in re.findall(r"[a-z][a-z0-9'-]{3,}", (text or "").lower()) if t not in STOP_WORDS}


def brute(questions, docs, k):
    out = []
    for q, text in questions:
        held = [(d, sum(t in (body or "").lower() for t in terms(text))) for d, body in docs]
        out += [(q, d, n) for d, n in sorted((h for h in held if h[1]), reverse=True)[:k]]
    return sorted(out)


@pytest.mark.parametrize("step", [1, 37])
def test_matches_a_plain_search(spark, monkeypatch, step):
    monkeypatch.setattr(postings, "FIRST", 1)
    monkeypatch.setattr(postings, "BLOCK", 4)
    rng = random.Random(step)
    stems = ["harbor", "light", "north-east", "o'neil", "works", "abcd", "x1y2", "zzzz"]
    text = lambda n: " ".join(rng.choice(stems) + rng.choice(["", "s", "1", ", ", "\n"]) if rng.random() < 0.3 else rng.choice(["common", "word", "é"]) for _ in range(n))
    docs = [(i * step - 90, text(rng.randrange(12))) for i in range(120)] + [(900_000, None), (900_001, ""), (900_002, "rarest harbors")]
    questions = [(1, "Where is the Harbor light?"), (2, "common things"), (3, "rarest of all"), (4, "a an it"), (5, None), (6, "ight o'ne"), (7, "north-east works ABCD x1y2 zzzz"), (8, "nowhere at all")]
    frame = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, word string")
    asked = spark.createDataFrame([(q, t, 1) for q, t in questions], "question_id long, text string, block int")
    for k in (3, 50):
        assert sorted(map(tuple, postings.newest_documents(asked, frame, k).collect())) == brute(questions, docs, k)


def test_empty_tables(spark):
    docs, asked = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "harbor")], "question_id long, text string")
    assert postings.ranked_documents(asked, docs).count() == 0
    assert postings.ranked_documents(asked.limit(0), spark.createDataFrame([(1, "harbor")], "doc_id long, text string")).count() == 0


def test_work_does_not_multiply_questions_by_words(spark, monkeypatch):
    """400 questions for one term that 500 words hold: nothing written has a row for each question and word."""
    written, real = [], postings.checkpointed

    def counting(df):
        out = real(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(postings, "checkpointed", counting)
    docs = spark.createDataFrame([(d, " ".join(f"harbor{w}" for w in range(d, 500, 10))) for d in range(10)], "doc_id long, text string")
    asked = spark.createDataFrame([(q, "the harbor") for q in range(400)], "question_id long, text string")
    assert postings.newest_documents(asked, docs, 50).count() == 4000
    assert max(written) <= 1000


@pytest.mark.parametrize("few", [0, 3, 50_000])
def test_terms_by_joins_and_at_hand(spark, monkeypatch, few):
    """Questions of one null id are one; documents share ids and have negative ones, at the borders of blocks."""
    monkeypatch.setattr(postings, "FIRST", 2)
    monkeypatch.setattr(postings, "FEW", few)
    docs = [(d, "harbors" if d % 3 else "old lights") for d in range(-70, 130)] + [(63, "harbor light"), (64, "x" * 70 + "harbor"), (None, "harbor"), (200, None)]
    questions = [(None, "harbor"), (None, "lights"), (1, "lights 'light harbor"), (2, "xxxxharbor"), (3, "lights")]
    got = postings.newest_documents(spark.createDataFrame(questions, "question_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string"), 30).collect()
    texts = {d: " ".join(t or "" for e, t in docs if e == d) for d in {d for d, _ in docs if d is not None}}
    asked = {None: "harbor lights", 1: "lights light harbor", 2: "xxxxharbor", 3: "lights"}
    want = [(q, d, n) for q, t in asked.items() for d, n in sorted(((d, sum(x in body for x in terms(t))) for d, body in texts.items() if any(x in body for x in terms(t))), reverse=True)[:30]]
    assert {tuple(r) for r in got} == set(want) and len(got) == len(want)


def test_old_documents_are_read_for_open_questions_only(spark, monkeypatch):
    """Nothing is written of the words of 2,000 old documents, once each question has its documents or its few terms."""
    written, real = [], postings.checkpointed

    def counting(df):
        out = real(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(postings, "checkpointed", counting)
    docs = spark.range(2000).selectExpr("id AS doc_id", "concat('harbor word', id, CASE WHEN id < 3 THEN ' rarest' ELSE '' END) AS text")
    asked = spark.createDataFrame([(1, "harbor word"), (2, "rarest"), (3, "nowhere")], "question_id long, text string")
    got = postings.newest_documents(asked, docs, 5).collect()
    assert sorted(map(tuple, got)) == [(1, d, 2) for d in range(1995, 2000)] + [(2, d, 1) for d in range(3)]
    assert sum(written) < 50
