import random

import sentencepiece

import corpus_pipeline
from strandline.llm import pieces


def corpus(tmp_path, spark):
    rng = random.Random(23)
    words = ["".join(rng.choices("abcdefghij", k=rng.randrange(3, 9))) for _ in range(400)]
    make = lambda n: " ".join(rng.choices(words, k=n))
    clean = [(i, make(rng.randrange(40, 90))) for i in range(90)]
    item = make(20)
    rows = [(i, t, "en", f"s{i % 3}") for i, t in clean]
    rows += [(200, clean[3][1], "en", "s0"), (201, "too short", "en", "s0"), (202, "again and again so " * 30, "en", "s1"), (203, " ".join(w + "###" for w in make(40).split()), "en", "s1")]
    rows += [(204, item + " " + make(30), "en", "s2"), (205, make(40) + " password=abcdefgh12345 " + make(5), "en", "s2"), (206, None, None, None), (207, "", "en", "s0")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, "unrelated item text of some words")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return docs, {r[0]: r[1] for r in rows}, {i for i, _ in clean}


def test_stages_take_effect_and_keep_clean_documents(spark, tmp_path):
    docs, texts, clean = corpus(tmp_path, spark)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        rows = {r.doc_id: r for r in docs.collect()}
        kept[name] = set(rows)
        assert clean <= set(rows), name
    assert kept["quality rules"] == clean | {200, 204, 205}
    assert kept["SimHash near-dedup"] == clean | {204, 205}
    assert kept["benchmark decontamination"] == clean | {205}
    assert kept["secret scans"] == clean | {205}
    assert "abcdefgh12345" not in rows[205].text and rows[205].n_chars == len(rows[205].text)
    assert all(rows[i].text == texts[i] for i in clean)
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    last = {r.doc_id: r for r in corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path)).collect()}
    assert {i: r.ids for i, r in last.items()} == {i: lib.encode(r.text) for i, r in rows.items()}


def test_run(spark, tmp_path):
    _, _, clean = corpus(tmp_path, spark)
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == clean | {205}


def test_stages_keep_clashing_columns_repeated_rows_and_empty_tables(spark, tmp_path):
    docs, _, _ = corpus(tmp_path, spark)
    names = ["__row", "row", "base", "added", "kept", "fp", "items", "w"]
    more = docs.union(docs.filter("doc_id < 5")).selectExpr("*", *[f"doc_id * 2 AS {n}" for n in names])
    for name, stage in corpus_pipeline.STAGES[:4]:
        empty = stage(spark, more.limit(0), str(tmp_path))
        assert empty.columns == more.columns and empty.count() == 0, name
        more = stage(spark, more, str(tmp_path))
        rows = more.collect()
        assert rows and all(r[n] == r.doc_id * 2 for r in rows for n in names), name
        assert sum(r.doc_id == 3 for r in rows) == (2 if name == "quality rules" else 1), name
