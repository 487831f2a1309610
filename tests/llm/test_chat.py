"""op12: layouts, the template and its way back."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from strandline.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, part string, layout int"


def brute(rows):
    rows = [(*r[:2], r[2] or "", r[3] or "") for r in rows] + [(-7, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))]
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        said, loss = "".join(f"{r[2]}\n{r[3]}\n" for r in own), "".join(r[3] for r in own if r[2] == "assistant")
        out.append((conv, len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows):
    return sorted((tuple(r)[:5] for r in chat.digest(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()), key=str)


def hostile(rng):
    bits = ["<", "[", "\\", "s>", "/s>", "INST]", "/INST]", "</s>", "[INST]", "[/INST]", "<s>", "$1", "\n", "é", "😀", " ", "x", "%5B", "\x00"]
    return "".join(rng.choices(bits, k=rng.randrange(30)))


def test_digest_matches_brute_force(spark):
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "Assistant", "to ol", "[INST]\n", "", None, "human"]
    rows = [(rng.randrange(9), rng.randrange(6), rng.choice(roles), rng.choice([hostile(rng), None, ""]), "p", 1) for _ in range(150)]
    rows += rows[:5] + [(None, 1, "user", "lost", "p", 1), (None, None, "assistant", "found", "p", 1), (3, None, "user", "first", "p", 1)]
    assert found(spark, rows) == brute(rows)


def test_empty_table_and_long_texts(spark):
    assert found(spark, []) == brute([])
    rows = [(1, 0, "user", "[INST]" * 300_000, "", 0), (1, 1, "assistant", "<" * 1_000_000, "", 0), *[(2, k, "assistant", "\\</s>", "", 0) for k in range(3000)]]
    assert found(spark, rows) == brute(rows)


def test_no_control_string_survives_in_a_text(spark):
    rng = random.Random(6)
    texts = [hostile(rng) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escaped(F.col("t")).alias("e")).withColumn("u", chat.unescaped(F.col("e")))
    for r in df.collect():
        assert r.u == r.t and not re.search(r"</?s>|\[/?INST\]", r.e)


def test_mask_covers_the_assistant_alone(spark):
    rows = [(1, 0, "system", "é"), (1, 1, "user", "😀</s>"), (1, 2, "assistant", "[INST]a😀"), (1, 3, "assistant", "")]
    r = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert r.formatted == "<s>[INST]system\né[/INST][INST]user\n😀<\\/s>[/INST][\\INST]a😀</s></s>"
    assert [r.formatted[m.start : m.end] for m in r.mask] == ["[\\INST]a😀", ""]


CASES = [
    ('{"prompt":"a","completion":"b","id":3}', "prompt and completion", [("user", "a"), ("assistant", "b")]),
    ('{"prompt":5,"completion":1.5}', "prompt and completion", [("user", "5"), ("assistant", "1.5")]),
    ('{"system":"s","prompt":"a","response":"b"}', "prompt and response", [("system", "s"), ("user", "a"), ("assistant", "b")]),
    ('{"instruction":"do","input":"this","output":"ok","meta":{"a":[1,2,{"b":2}]}}', "instruction", [("user", "do\n\nthis"), ("assistant", "ok")]),
    ('{"instruction":"do","input":"","output":"ok"}', "instruction", [("user", "do"), ("assistant", "ok")]),
    ('{"instruction":"do","output":null}', "instruction", [("user", "do"), ("assistant", "")]),
    ('{"context":"c","question":"q","answer":"a","we ird`x.y":1.25}', "question and answer", [("user", "c\n\nq"), ("assistant", "a")]),
    ('{"messages":[{"role":"human","content":"x"},{"role":"gpt","content":null,"name":"z"}]}', "messages", [("user", "x"), ("assistant", None)]),
    ('{"conversations":[{"from":"human","value":"h"}],"system":"S"}', "from and value", [("system", "S"), ("user", "h")]),
    ('{"data":{"messages":[{"role":"user","content":"{\\"prompt\\":1}"}]}}', "nested messages", [("user", '{"prompt":1}')]),
    ('{"prompt":"a"}', None, None),
    ('{"prompt":{"a":1},"completion":"x"}', None, None),
    ('{"prompt":"a","completion":"b","response":"c"}', None, None),
    ('{"messages":[]}', None, None),
    ("[]", None, None),
    ("3", None, None),
    ("nonsense", None, None),
    (None, None, None),
]


def test_layouts_are_chosen_by_fingerprint(spark):
    df = spark.createDataFrame([(i, c[0], "own") for i, c in enumerate(CASES)], "id int, js string, layout string")
    rows = chat.canonical_turns(df.withColumn("record", F.try_parse_json("js")), F.col("record")).orderBy("id").select("layout", "turns").collect()
    for r, (js, layout, turns) in zip(rows, CASES, strict=True):
        assert (r.layout, r.turns and [tuple(t) for t in r.turns]) == (layout, turns), js


def test_fingerprints_are_unambiguous():
    marks = [m for layout in (*chat.LAYOUTS, chat.TURN_ROW) for m in layout.fingerprints()]
    assert len(marks) == len(set(marks))


@pytest.mark.parametrize("js,paths", [('{"a":{"b":[{"c":1},{"d":[2]}]},"e":{}}', ["a.b[].c", "a.b[].d[]"]), ('{"x":1.5,"y":[[1]]}', ["x", "y[][]"])])
def test_field_paths(spark, js, paths):
    df = spark.createDataFrame([(js,)], "js string").select(chat.field_paths(F.try_parse_json("js")).alias("p"))
    assert df.first().p == paths


def test_main_path_is_native(spark):
    plan = chat.digest(spark.createDataFrame([], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)
