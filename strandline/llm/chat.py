"""Chat formatting: records of any known layout become canonical turns, turns become one marked text with a loss mask.

A record is a VARIANT. Its fingerprint is the hash of its nested field paths, as far as some mapping knows them (fields that
none knows are ignored), and selects the mapping: which fields hold which turns. All of it is expressions; the schema that
`schema_of_variant` reports a record is folded into paths, so depth is not limited.

The template: `<s>`, then a turn of the assistant as `text</s>` and any other as `[INST]role`, a line feed, `text[/INST]`. A
control string inside a text gets a backslash after its first character, one more if there are some already, so no text
holds a control string and taking one away again restores it. Roles are percent-encoded. The mask lists, in code points
of the formatted text, where the assistant's texts stand.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BEGIN, END, OPEN, CLOSE = "<s>", "</s>", "[INST]", "[/INST]"
LOSS_ROLE = "assistant"
_CONTROL = r"(/?s>|/?INST\])"
_TURNS = "array<struct<role:string,text:string>>"

#: Names that layouts use for the canonical roles.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}


@dataclass(frozen=True)
class Layout:
    """A declarative mapping. fields: (role, paths whose texts are joined by an empty line) in order; or listed: the path of a
    list with the names of its role and text, after `fields`. Paths in optional may be absent."""

    name: str
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    listed: tuple[str, str, str] | None = None
    optional: frozenset[str] = frozenset()
    renamed: bool = True  # whether ROLES applies

    @property
    def paths(self) -> frozenset[str]:
        named = {p for _, ps in self.fields for p in ps}
        return frozenset(named | ({f"{self.listed[0]}[].{c}" for c in self.listed[1:]} if self.listed else set()))

    def fingerprints(self) -> list[str]:
        must = self.paths - self.optional
        return [fingerprint_of(must | set(extra)) for n in range(len(self.optional) + 1) for extra in combinations(sorted(self.optional), n)]


def fingerprint_of(paths: frozenset[str] | set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


_SYSTEM = (("system", ("system",)),)
LAYOUTS = (
    Layout("prompt and completion", (*_SYSTEM, ("user", ("prompt",)), ("assistant", ("completion",))), optional=frozenset({"system"})),
    Layout("prompt and response", (*_SYSTEM, ("user", ("prompt",)), ("assistant", ("response",))), optional=frozenset({"system"})),
    Layout("question and answer", (*_SYSTEM, ("user", ("context", "question")), ("assistant", ("answer",))), optional=frozenset({"system", "context"})),
    Layout("instruction", (*_SYSTEM, ("user", ("instruction", "input")), ("assistant", ("output",))), optional=frozenset({"system", "input"})),
    Layout("messages", listed=("messages", "role", "content")),
    Layout("from and value", _SYSTEM, ("conversations", "from", "value"), frozenset({"system"})),
    Layout("nested messages", listed=("data.messages", "role", "content")),
)
#: A table row that is itself one turn; its role stands as it is.
TURN_ROW = Layout("turn", listed=("turn", "role", "text"), renamed=False)


def field_paths(record: Column) -> Column:
    """The paths of a variant's scalar fields, `[]` after a list: array<string>, sorted and distinct."""
    tokens = F.regexp_extract_all(F.schema_of_variant(record), F.lit(r"OBJECT<|ARRAY<|>|`(?:[^`]|``)*`: |[^<>,:`\s]+: |[^<>,:`\s(]+(?:\([^)]*\))?"), F.lit(0))
    top = lambda s: F.element_at(s.stack, -1)
    popped = lambda s: F.slice(s.stack, 1, F.size(s.stack) - 1)

    def step(s: Column, t: Column) -> Column:
        name = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, ": $", ""), "^`|`$", ""), "``", "`")
        below = F.when(top(s) == "", name).otherwise(F.concat(top(s), F.lit("."), name))
        stack = F.when(t == "OBJECT<", s.stack).when(t == "ARRAY<", F.concat(s.stack, F.array(F.concat(top(s), F.lit("[]"))))).when(t.endswith(": "), F.concat(s.stack, F.array(below))).otherwise(popped(s))
        scalar = ~t.isin("OBJECT<", "ARRAY<", ">") & ~t.endswith(": ")
        return F.struct(stack.alias("stack"), F.when(scalar, F.concat(s.paths, F.array(top(s)))).otherwise(s.paths).alias("paths"))

    none = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.aggregate(tokens, F.struct(F.array(F.lit("")).alias("stack"), none.alias("paths")), step, lambda s: s.paths)))


def fingerprint(record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    known = sorted({p for layout in layouts for p in layout.paths})
    return F.sha2(F.array_join(F.array_intersect(field_paths(record), F.array(*map(F.lit, known))), "\n"), 256)


def layout_name(record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """The layout whose fingerprint the record has, null if none."""
    chosen = F.lit(None).cast("string")
    mark = fingerprint(record, layouts)
    for layout in layouts:
        chosen = F.when(mark.isin(*layout.fingerprints()), layout.name).otherwise(chosen)
    return chosen


def _canonical_role(role: Column) -> Column:
    out = role
    for said, meant in ROLES.items():
        out = F.when(role == said, meant).otherwise(out)
    return out


def _turns_of(record: Column, layout: Layout) -> Column:
    text = lambda path: F.try_variant_get(record, f"$.{path}", "string")
    parts = []
    for role, paths in layout.fields:
        there = F.filter(F.array(*map(text, paths)), lambda p: p.isNotNull() & (p != ""))
        turn = F.array(F.struct(F.lit(role).alias("role"), F.array_join(there, "\n\n").alias("text")))
        parts.append(F.when(F.size(there) > 0, turn).otherwise(F.array().cast(_TURNS)) if set(paths) <= layout.optional else turn)
    if layout.listed:
        path, role, said = layout.listed
        listed = F.try_variant_get(record, f"$.{path}", f"array<struct<`{role}`:string,`{said}`:string>>")
        parts.append(F.transform(listed, lambda m: F.struct((_canonical_role(m[role]) if layout.renamed else m[role]).alias("role"), m[said].alias("text"))))
    return F.concat(*parts).cast(_TURNS)


def canonical_turns(df: DataFrame, record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """df with `layout` and `turns`, an array of (role, text). record: a variant, such as F.try_parse_json of a JSON text.

    Both are null for a record of no known layout, with fields of two layouts, malformed or null; such rows stay, so that
    nothing is lost unseen. An optional field that is absent, null or empty gives no turn; other null texts stay null here
    and count as empty when they are formatted. df's own columns `layout` and `turns` are replaced.
    """
    held = df.withColumn("layout", layout_name(record, layouts))
    turns = F.lit(None).cast(_TURNS)
    for layout in layouts:
        turns = F.when(F.col("layout") == layout.name, _turns_of(record, layout)).otherwise(turns)
    return held.withColumn("turns", turns)


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _CONTROL, r"$1$2\\$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)\\" + _CONTROL, "$1$2$3")


def formatted(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, mask) of rows (conv_id, turn, role, text), a conversation a row.

    Turns stand in order of turn, then role, then text, nulls first, so repeated rows are repeated turns and ties are settled.
    Null texts and roles are empty. Rows without conv_id are one conversation, whose conv_id is null. An empty table gives
    no rows; further columns are not read. A conversation becomes one value, so it must fit in a task.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    plain = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    lost = F.col("role") == LOSS_ROLE
    part = F.when(lost, F.concat(escaped(F.col("text")), F.lit(END))).otherwise(F.concat(F.lit(OPEN), F.url_encode("role"), F.lit("\n"), escaped(F.col("text")), F.lit(CLOSE)))
    upto = F.sum(F.length("part")).over(Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)) + len(BEGIN)
    placed = plain.withColumn("part", part).select("conv_id", upto.alias("upto"), "part", lost.alias("lost"))
    parts = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("upto", "part", "lost"))).alias("parts"))  # a part is never empty, so upto rises
    mask = F.transform(F.filter("parts", lambda p: p.lost), lambda p: F.struct((p.upto - F.length(p.part)).alias("start"), (p.upto - len(END)).alias("end")))
    return parts.select("conv_id", F.concat(F.lit(BEGIN), F.array_join(F.col("parts.part"), "")).alias("formatted"), mask.alias("mask"))


def read_back(texts: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns, loss_text) from (conv_id, formatted, mask): the turns and the text under the mask, unescaped."""
    parts = F.filter(F.split(F.substr("formatted", F.lit(len(BEGIN) + 1)), r"(?<=\[/INST\])|(?<=</s>)"), lambda p: p != "")

    def turn(part: Column) -> Column:
        inner = F.substr(part, F.lit(len(OPEN) + 1), F.length(part) - len(OPEN) - len(CLOSE))
        name = F.substring_index(inner, "\n", 1)
        own = F.struct(F.lit(LOSS_ROLE).alias("role"), unescaped(F.substr(part, F.lit(1), F.length(part) - len(END))).alias("text"))
        other = F.struct(F.url_decode(name).alias("role"), unescaped(F.substr(inner, F.length(name) + 2)).alias("text"))
        return F.when(part.startswith(OPEN), other).otherwise(own)

    loss = F.array_join(F.transform("mask", lambda m: unescaped(F.substr("formatted", (m.start + 1).cast("int"), (m.end - m.start).cast("int")))), "")
    return texts.select("conv_id", "formatted", F.transform(parts, turn).alias("turns"), loss.alias("loss_text"))


def turn_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of rows that each are one turn, through the mapping that their fingerprint selects."""
    body = F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    record = F.to_variant_object(F.struct(F.array(body).alias("turn")))
    known = canonical_turns(rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), record.alias("record")), F.col("record"), (*LAYOUTS, TURN_ROW))
    return known.select("conv_id", "turn", F.explode("turns").alias("said")).select("conv_id", "turn", "said.role", "said.text")


def planted(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts are control strings."""
    return spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(f"{END}{OPEN} ok {CLOSE}").alias("text"))


def digest(conversations: DataFrame) -> DataFrame:
    """The contract's columns, read back from the formatted text of each conversation and of the planted one."""
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(planted(conversations.sparkSession))
    back = read_back(formatted(turn_rows(rows)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\2\\\3', 'g')) AS n FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
  3 + sum(CASE WHEN role = 'assistant' THEN n + 4 ELSE n + length(role) + 14 END) AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g
"""
