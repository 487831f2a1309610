"""The similarity join of names against all pairs."""

import random

import pytest

from strandline.operators import graph


def grams(name):
    words, word = [], ""
    for c in (name or "").lower() + " ":
        if c.isascii() and c.isalnum():
            word += c
        elif word:
            words.append(word)
            word = ""
    return {("  " + w + " ")[i : i + 3] for w in words for i in range(len(w) + 1)}


def brute(left, right, threshold):
    out = set()
    for a in {x for x in left if x is not None}:
        for b in {x for x in right if x is not None}:
            one, two = grams(a), grams(b)
            if one & two and len(one & two) / len(one | two) > threshold:
                out.add((a, b, round(len(one & two) / len(one | two), 9)))
    return out


def names(rng, n):
    stems = ["harbor", "light", "north", "works", "delta", "ida", "lind", "a", "42", "été"]
    made = [" ".join(rng.choices(stems, k=rng.randrange(1, 5))) for _ in range(n)]
    for i in range(0, n, 3):  # near names
        at = rng.randrange(len(made[i]))
        made[i] = made[i][:at] + rng.choice("xyz -") + made[i][at:]
    return made


@pytest.mark.parametrize("threshold", [0.0, 0.3, 0.5, 0.8, 0.999])
def test_no_pair_is_missed(spark, threshold):
    rng = random.Random(7)
    left, right = [*names(rng, 60), None, "", "--", "Harbor"], [*names(rng, 80), "harbor", "HARBOR!", None, ""]
    found = graph.similar_labels(spark.createDataFrame([(x, 1) for x in left * 2], "label string, gram int"), spark.createDataFrame([(x, 1) for x in right], "label string, left int"), threshold)
    rows = [(r["left"], r["right"], round(r.score, 9)) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(left, right, threshold)


def test_many_names_agree_with_one_at_a_time(spark):
    entities = spark.createDataFrame([("e1", "Red Widget"), ("e2", "Blue Widgets"), ("e3", "Green")], "entity_id string, name string")
    aliases = spark.createDataFrame([("e1", "The Red Widgets"), ("e3", "Red Widget"), ("e3", "Red Widget")], "entity_id string, alias string")
    wanted = ["red widgets", "green thing", "red widget"]
    many = graph.resembling_entities(spark.createDataFrame([(w,) for w in wanted], "name string"), entities, aliases)
    one = {(w, *r) for w in wanted for r in graph.trigram_matches(entities, aliases, w).collect()}
    assert {tuple(r) for r in many.collect()} == one


def test_empty_tables(spark):
    none = spark.createDataFrame([], "label string")
    assert graph.similar_labels(none, none).count() == 0
