"""Matches of a pattern with their places, in DataFrame operations only.

Spark gives matches without offsets. Splitting a text at the same pattern gives the stretches between the matches, and
the lengths of both, summed in turn, give every start. Lengths count code points. Patterns must not match the empty
string, and repeated groups in them are possessive, so that no text can exhaust the regex engine's stack.

Running sums over an array are folded in blocks, and lists of spans are searched by halving, so a text with a hundred
thousand matches costs little more a match than one with ten.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_TYPE = "array<struct<kind:string,start:int,end:int,value:string,part:string,before:string>>"
#: Items of a block: a block's output array grows by copying, and so does the array of the blocks' states.
BLOCK = 256
#: Code points before a match that are kept with it, as far as the previous match leaves them.
CONTEXT = 16
_CUT = 1024


def none() -> Column:
    return F.array().cast(_TYPE)


def folded(items: Column, zero: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str) -> Column:
    """emit(state before item, item) for each item in turn, with state -> step(state, item); kind is the result's type."""
    empty = F.array().cast(kind)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK)))

    def whole(blocks: Column) -> Column:
        before = F.aggregate(F.slice(blocks, F.lit(1), F.size(blocks) - 1), F.array(zero), lambda acc, block: F.concat(acc, F.array(F.aggregate(block, F.element_at(acc, -1), step))))

        def one(block: Column, state: Column) -> Column:
            start = F.struct(state.alias("state"), empty.alias("out"))
            add = lambda s, x: F.struct(step(s["state"], x).alias("state"), F.concat(s["out"], F.array(emit(s["state"], x))).alias("out"))
            return F.aggregate(block, start, add, lambda s: s["out"])

        return F.flatten(F.zip_with(blocks, before, one))

    # An array of one element binds the blocks, so that they are cut once.
    return F.when(F.size(items) > 0, F.get(F.transform(F.array(blocks), whole), F.lit(0))).otherwise(empty)


def matches(kind: str, text: Column, pattern: str, part: int = 0) -> Column:
    """All leftmost non-overlapping matches as (kind, start, end, value, part, before); part is a group of the match."""
    between = F.transform(F.split(text, pattern, -1), lambda x: F.struct(F.length(x).alias("n"), F.right(x, F.lit(CONTEXT)).alias("end")))
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"), F.regexp_extract_all(text, F.lit(pattern), F.lit(part)).alias("part"))
    # zip_with pads the shorter side: the stretch after the last match has no match of its own.
    steps = F.filter(F.zip_with(between, found, lambda gap, hit: F.struct(gap["n"].alias("gap"), gap["end"].alias("before"), F.length(hit["value"]).alias("size"), hit["value"].alias("value"), hit["part"].alias("part"))), lambda s: s["value"].isNotNull())

    def span(at: Column, s: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), (at + s["gap"]).alias("start"), (at + s["gap"] + s["size"]).alias("end"), s["value"].alias("value"), s["part"].alias("part"), s["before"].alias("before"))

    once = F.transform(F.array(steps), lambda items: folded(items, F.lit(0), lambda at, s: at + s["gap"] + s["size"], span, _TYPE))
    return F.get(once, F.lit(0))


def last_before(spans: Column, bound: Column) -> Column:
    """The last of spans, sorted and free of overlaps, that starts before bound; null if none does."""
    rounds = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.log2(F.size(spans) + F.lit(1))).cast("int")))
    start = F.struct(F.lit(0).alias("low"), F.size(spans).alias("high"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        right = (s["low"] < s["high"]) & (F.get(spans, middle)["start"] < bound)
        return F.struct(F.when(right, middle + 1).otherwise(s["low"]).alias("low"), F.when(right | (s["low"] >= s["high"]), s["high"]).otherwise(middle).alias("high"))

    return F.get(spans, F.aggregate(rounds, start, halve, lambda s: s["low"]) - 1)


def of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def touches(a: Column, *lists: Column) -> Column:
    """Whether a overlaps a span of any list; each list is sorted and free of overlaps."""
    out = F.lit(False)
    for spans in lists:
        out = out | F.coalesce(last_before(spans, a["end"])["end"] > a["start"], F.lit(False))
    return out


def without_overlap(more: Column, base: Column, kinds: tuple[str, ...]) -> Column:
    """The spans of `more` that touch no span of `base`, whose spans are of these kinds."""
    split = F.array(F.struct(*[of_kind(base, k).alias(k) for k in kinds]))
    return F.get(F.transform(split, lambda b: F.filter(more, lambda a: ~touches(a, *[b[k] for k in kinds]))), F.lit(0))


def replaced(text: Column, spans: Column, by: str) -> Column:
    """text with each maximal overlapping run of spans replaced."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    runs = folded(ordered, F.lit(0), lambda at, s: F.greatest(at, s["end"]), lambda at, s: F.struct(at.alias("from"), s["start"].alias("upto")), "array<struct<from:int,upto:int>>")
    kept = F.filter(runs, lambda r: r["upto"] >= r["from"])
    # Blocks of code points: a stretch is cut from its own block, not counted from the text's beginning.
    blocks = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{_CUT}}}"), F.lit(0))

    def stretch(parts: Column, a: Column, b: Column) -> Column:
        first, last = F.floor(a / _CUT).cast("int"), F.floor(b / _CUT).cast("int")
        piece = lambda i: F.coalesce(F.get(parts, i), F.lit(""))
        one = F.substring(piece(first), a % _CUT + 1, b - a)
        several = F.concat(F.substring(piece(first), a % _CUT + 1, F.lit(_CUT)), F.array_join(F.slice(parts, first + 2, last - first - 1), ""), F.substring(piece(last), F.lit(1), b % _CUT))
        return F.when(first == last, one).otherwise(several)

    end = F.array_max(F.transform(spans, lambda s: s["end"]))
    bound = F.array(F.struct(blocks.alias("parts"), kept.alias("kept"), end.alias("end"), F.length(text).alias("n")))
    out = F.transform(bound, lambda x: F.concat(F.array_join(F.transform(x["kept"], lambda r: F.concat(stretch(x["parts"], r["from"], r["upto"]), F.lit(by))), ""), stretch(x["parts"], x["end"], x["n"])))
    return F.when(F.size(spans) > 0, F.get(out, F.lit(0))).otherwise(text)


def text_of(spans: Column, order: dict[str, int], by_kind: bool) -> Column:
    """kind:start:end, comma-joined; ordered by kind as listed then start, or by start then kind."""
    rank = lambda kind: F.coalesce(F.create_map(*[F.lit(x) for pair in order.items() for x in pair])[kind], F.lit(len(order)))
    fields = lambda s: [rank(s["kind"]).alias("k"), s["start"].alias("s")]
    keyed = F.transform(spans, lambda s: F.struct(*(fields(s) if by_kind else fields(s)[::-1]), s["end"].alias("e"), F.concat_ws(":", s["kind"], s["start"], s["end"]).alias("t")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: s["t"]), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(of_kind(spans, kind)).cast("long")
