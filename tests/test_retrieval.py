from strandline.operators import retrieval


def test_answers_keep_more_than_questions(spark):
    turns = spark.createDataFrame([(1, 0, "user", "q" * 13000), (1, 1, "assistant", "a" * 13000), (1, 2, "assistant", "b" * 9000)], "conv_id long, turn int, role string, text string")
    assert {r.turn: len(r.text) for r in retrieval.history(turns).collect()} == {0: 4000, 1: 12000, 2: 9000}
