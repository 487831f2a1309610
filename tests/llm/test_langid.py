import random
import zlib

import numpy as np

from strandline.llm import langid

SYLLABLES = {"en": ["the", "ing", "tion", "er", "wh"], "de": ["sch", "ung", "keit", "ü", "ein"], "fr": ["eau", "oi", "é", "que", "ment"], "el": ["και", "το", "ους", "ής", "μα"]}


def corpus():
    rng = random.Random(9)
    rows = []
    for d in range(400):
        lang = rng.choice(list(SYLLABLES))
        words = ["".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(3, 60))]
        rows.append((d, " ".join(words).title() if d % 5 == 0 else " ".join(words), lang, "s"))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    held = [(d, lang) for d, _, lang, _ in rows if zlib.crc32(str(d).encode()) % 4 == 2]
    assert len(held) > 50 and all(got[d].held_out for d, _ in held) and sum(r.held_out for r in got.values()) == len(held)
    assert np.mean([got[d].lang_pred == lang for d, lang in held]) > 0.97


def test_odd_rows(spark):
    rows = [*corpus(), (1000, None, "en", "s"), (1001, "", "de", "s"), (1002, "123 --- 4", None, "s"), (None, "keitung einschung", None, None), (1003, "ж" * 9, None, "x"), (5, corpus()[5][1], "en", "s")]
    found = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    got = {r.doc_id: r for r in found}
    assert len(found) == len(rows)
    assert [got[d].lang_pred for d in (1000, 1001, 1002)] == ["und"] * 3 and got[None].lang_pred == "de" and not got[None].held_out
    assert got[1003].lang_pred in SYLLABLES and got[1003].score == 0 and all(0 <= r.score <= 1 for r in found)


def test_labels_of_held_out_rows_are_never_read(spark):
    rows = corpus()
    other = [(d, t, "xx" if zlib.crc32(str(d).encode()) % 4 == 2 else lang, s) for d, t, lang, s in rows]
    a, b = (sorted((r.doc_id, r.lang_pred, r.score) for r in langid.identify(spark.createDataFrame(x, "doc_id long, text string, lang string, source string")).collect()) for x in (rows, other))
    assert a == b


def test_many_languages_and_no_labels(spark):
    rows = [(i, f"{chr(0x4E00 + i)}{chr(0x4E80 + i)}" * 20, f"l{i:03}", "s") for i in range(100)]
    rows = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {d: lang for d, _, lang, _ in rows}
    none = spark.createDataFrame([(1, "some text", None, "s")], "doc_id long, text string, lang string, source string")
    assert langid.identify(none).first().lang_pred == "und" and langid.identify(none.limit(0)).count() == 0
