"""Registered queries take all their rows; counted here without their SQL."""

from collections import Counter

import __spark_entry__ as e
from strandline.plans.bridge import logical

SF = "/root/testdata/sf0.001"


def test_claim_detail_answers_for_every_claim(spark):
    claims, entities = logical(spark, SF, "claims").collect(), {r.entity_id: r.name for r in logical(spark, SF, "entities").collect()}
    backing = {}
    for r in logical(spark, SF, "evidence").collect():
        backing.setdefault(r.claim_id, set()).add((r.source_id, r.raw_id, r.document_id))
    want = Counter()  # ids repeat in the made data
    for c in claims:
        if c.subject_id in entities:
            parts = (entities[c.subject_id], c.predicate, entities.get(c.object_id) or c.object_value)
            want[c.claim_id, " ".join(p.replace("_", " ").strip() for p in parts if p), len(backing.get(c.claim_id, ()))] += 1
    got = Counter(tuple(r) for r in e.queries()["claim_detail"](spark, SF).collect())
    assert got == want and got.total() == len(claims)


def test_answer_context_has_whole_turns(spark):
    turns = {}
    for r in logical(spark, SF, "conversations").collect():
        turns.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    want = {k: " | ".join(f"{role}: {text}" for _, role, text in sorted(v)) for k, v in turns.items()}
    assert max(len(text) for v in turns.values() for *_, text in v) > 40
    assert {r.conv_id: r.context for r in e.queries()["answer_context"](spark, SF).collect()} == want


def test_source_state_sees_every_run(spark, tmp_path):
    """Runs 7, 11 and 22 are active by the bridge, 5 and 13 are not; src9 has none."""
    docs = [(i, f"body {i}", "en", f"src{i}", 6) for i in (5, 7, 9, 11, 13)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    runs = [(7, 7, "click"), (11, 11, "view"), (22, 11, "click"), (5, 5, "click"), (13, 13, "view")]
    spark.createDataFrame([(*r, 1.0, "{}") for r in runs], "event_id long, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.source_id: r.state for r in e.queries()["source_state"](spark, str(tmp_path)).collect()}
    assert {k for k, v in got.items() if v == "active"} == {"src7", "src11"} and set(got) == {f"src{i}" for i in (5, 7, 9, 11, 13)}
