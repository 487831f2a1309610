import importlib
import sys


def test_every_oracle_has_a_query_and_the_flagship_runs(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_the_rest_works_without_the_corpus_part(monkeypatch):
    import __spark_entry__ as e

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    try:
        bare = importlib.reload(e)
        assert "source_coverage" in bare.queries() and not any(q.startswith("op1_") for q in bare.queries())
    finally:
        monkeypatch.undo()
        importlib.reload(e)
