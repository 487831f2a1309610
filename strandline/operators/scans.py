"""Ordered state of each key by a segmented parallel scan, so that no task holds a key.

Rows are dealt by ranges of (key, order): a hot key covers many ranges, a range holds many small keys. What a range does to
the state of a key is one element of a monoid (the last value, a running maximum, a map from state to state), whose
elements compose associatively. Two passes over the dealt rows, which are written once to the shared checkpoint folder:

1. Each range folds its first and its last key to an element each. That is one row a task; composing them in order gives
   the state in which each range is entered.
2. Each range applies its own prefixes to the state that it is entered in.

Within a range rows come in batches, and prefixes are computed for a batch at once, so memory does not depend on the range.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed


class Fold:
    """One state a key. column: what a row brings; output and type: what it gets. Elements are plain values that JSON can hold, None is the identity."""

    column: str
    output: str
    type: str

    def total(self, values: np.ndarray) -> Any:
        """The element of consecutive rows of one key."""
        raise NotImplementedError

    def join(self, first: Any, then: Any) -> Any:
        raise NotImplementedError

    def prefix(self, values: np.ndarray, begins: np.ndarray, entered: Any) -> np.ndarray:
        """The output of each row. begins: where a row is the first of its key; before the first of these, the key was entered in `entered`."""
        raise NotImplementedError


@dataclass(frozen=True)
class Previous(Fold):
    """The value of the row before of the same key, null on the first."""

    column: str
    output: str
    type: str = "string"

    def total(self, values):
        return (values[-1],)

    def join(self, first, then):
        return first if then is None else then

    def prefix(self, values, begins, entered):
        out = np.empty(len(values), object)
        out[1:] = values[:-1]
        out[0] = entered[0] if entered is not None else None
        out[np.flatnonzero(begins)] = None
        return out


@dataclass(frozen=True)
class RunningMax(Fold):
    """The largest value so far of the same key, this row's included; nulls are passed over."""

    column: str
    output: str
    type: str = "double"

    def total(self, values):
        known = [v for v in values if v is not None]
        return max(known) if known else None

    def join(self, first, then):
        return then if first is None else first if then is None else max(first, then)

    def prefix(self, values, begins, entered):
        number = np.cumsum(begins)
        known = np.array([-np.inf if v is None else v for v in values], float)
        if not begins[0] and entered is not None:
            known[0] = max(known[0], entered)
        shift = 1
        while shift < len(known):  # doubling: each step reaches twice as far within the key
            same = number[shift:] == number[:-shift]
            known[shift:] = np.where(same, np.maximum(known[shift:], known[:-shift]), known[shift:])
            shift *= 2
        return np.array([None if v == -np.inf else v for v in known], object)


@dataclass(frozen=True)
class Counted(Fold):
    """How many rows of the key so far have a true column, this one included."""

    column: str
    output: str
    type: str = "bigint"

    def total(self, values):
        return int(sum(map(bool, values)))

    def join(self, first, then):
        return then if first is None else first if then is None else first + then

    def prefix(self, values, begins, entered):
        flags = np.array([bool(v) for v in values], np.int64)
        counted = np.cumsum(flags)
        starts = np.flatnonzero(begins)
        before = np.concatenate([[-(entered or 0)], (counted - flags)[starts]])  # what the key's count starts from
        return counted - before[np.searchsorted(starts, np.arange(len(flags)), "right")]


@dataclass(frozen=True)
class Machine(Fold):
    """The state of a finite machine after each row. moves: (state, event) to state; any other event leaves the state as it is.

    A key starts in `start`. An event is a map of all states to states, and maps compose.
    """

    column: str
    output: str
    start: str
    moves: tuple[tuple[str, str, str], ...]
    type: str = "string"

    @property
    def states(self) -> list[str]:
        return sorted({self.start, *(m[0] for m in self.moves), *(m[2] for m in self.moves)})

    def _maps(self, values: np.ndarray) -> np.ndarray:
        number = {s: i for i, s in enumerate(self.states)}
        stay = np.arange(len(number), dtype=np.int16)
        by_event = {e: stay.copy() for _, e, _ in self.moves}
        for before, event, after in self.moves:
            by_event[event][number[before]] = number[after]
        return np.stack([by_event.get(v, stay) for v in values])

    def total(self, values):
        maps = self._maps(values)
        while len(maps) > 1:  # neighbours are composed pairwise
            odd = maps[-1:] if len(maps) % 2 else maps[:0]
            maps = np.concatenate([np.take_along_axis(maps[1::2], maps[: len(maps) // 2 * 2 : 2].astype(np.int64), axis=1), odd])
        return tuple(maps[0].tolist())

    def join(self, first, then):
        return then if first is None else first if then is None else tuple(then[s] for s in first)

    def prefix(self, values, begins, entered):
        number, maps = np.cumsum(begins), self._maps(values)
        shift = 1
        while shift < len(maps):
            same = number[shift:] == number[:-shift]
            composed = np.take_along_axis(maps[shift:], maps[:-shift].astype(np.int64), axis=1)
            maps[shift:] = np.where(same[:, None], composed, maps[shift:])
            shift *= 2
        start = self.states.index(self.start)
        first = np.full(len(maps), start)
        if entered is not None:
            first[number == 0] = entered[start]
        return np.array(self.states, object)[maps[np.arange(len(maps)), first]]


@dataclass(frozen=True)
class Kept(Fold):
    """Whether a row finds an answer that was made less than `seconds` before it; a row that does not makes one. Rows come by time.

    What rows do to the time of the last answer is a step function: [first time, [[limit, made], ..]], where the first limit
    that is `seconds` or more after the answer tells when the new one was made, and without one the answer stands. An answer is
    no later than the first time, so steps are kept up to `seconds` after it.
    """

    column: str
    output: str
    seconds: int
    type: str = "boolean"

    def _made(self, element: Any, made: int | None) -> int | None:
        for limit, out in element[1]:
            if made is None or limit >= made + self.seconds:
                return out
        return made

    def _steps(self, first: int, steps: list) -> list:
        out: list = []
        for limit, made in steps:
            if out and out[-1][1] == made:
                out[-1][0] = limit
            else:
                out.append([limit, made])
            if limit >= first + self.seconds:
                break
        return [first, out]

    def total(self, values):
        times = values.astype(np.int64)
        after = np.searchsorted(times, times + self.seconds)
        made = times.tolist()
        for i in range(len(made) - 1, -1, -1):
            if after[i] < len(made):
                made[i] = made[after[i]]
        return self._steps(int(times[0]), [list(x) for x in zip(times.tolist(), made, strict=True)])

    def join(self, first, then):
        if first is None or then is None:
            return then if first is None else first
        reached = [[limit, self._made(then, made)] for limit, made in first[1]]
        last = reached[-1][0]
        return self._steps(first[0], reached + [[limit, made] for limit, made in then[1] if limit > last])

    def prefix(self, values, begins, entered):
        out, made = np.empty(len(values), object), None if entered is None else self._made(entered, None)
        for i, (at, new) in enumerate(zip(values.tolist(), begins.tolist(), strict=True)):
            made = None if new else made
            out[i] = made is not None and at - made < self.seconds
            made = made if out[i] else at
        return out


def _runs(batch: pa.RecordBatch, key: Sequence[str], before: tuple | None) -> tuple[np.ndarray, list[tuple]]:
    """(begins, keys): whether each row begins another key than the row before it, and each row's key where it does."""
    columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in key]
    rows = list(zip(*columns, strict=True))
    begins = np.array([a != b for a, b in zip(rows, [before, *rows[:-1]], strict=True)])
    return begins, rows


def scan(rows: DataFrame, key: Sequence[str], order: Sequence[str], folds: Sequence[Fold], parts: int | None = None) -> DataFrame:
    """rows with the folds' outputs, each over the rows of a key in the given order, nulls first; the order must be total up to equal rows.

    An output replaces a column of its name. Rows of a null key are one key. An empty table stays empty. parts: ranges, the
    session's shuffle width times four if not given; each is one task, and one row of summary.
    """
    spark = rows.sparkSession
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = rows.drop(*[f.output for f in folds if f.output in rows.columns])
    by = [*key, *order]
    dealt = checkpointed(kept.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("__range", F.spark_partition_id()))
    values = lambda batch, f: np.array(batch.column(batch.schema.get_field_index(f.column)).to_pylist(), object)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(range, first key, last key, whether they are one, the last key's elements)."""
        number, first, last, whole, sums = None, None, None, True, [None] * len(folds)
        for batch in batches:
            if not batch.num_rows:
                continue
            begins, keys = _runs(batch, key, last)
            if first is None:
                number, first = batch.column(batch.schema.get_field_index("__range"))[0].as_py(), keys[0]
                begins[0] = False
            whole &= not begins.any()
            tail = int(np.flatnonzero(begins)[-1]) if begins.any() else 0
            sums = [f.join(None if begins.any() else s, f.total(values(batch, f)[tail:])) for f, s in zip(folds, sums, strict=True)]
            last = keys[-1]
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (number, repr(first), repr(last), whole, json.dumps(sums))], names=["range", "first", "last", "whole", "sums"])

    def enter() -> dict[int, list[Any]]:
        """The elements of the keys' earlier rows with which each range is entered; one row a task comes to the driver."""
        summaries = sorted(dealt.mapInArrow(totals, "range long, first string, last string, whole boolean, sums string").collect(), key=lambda r: r["range"])
        nothing = [None] * len(folds)
        entered, carried, before = {}, nothing, None
        for r in summaries:
            sums = json.loads(r["sums"])
            own = carried if r["first"] == before else nothing
            entered[r["range"]] = own
            carried = [f.join(o, s) for f, o, s in zip(folds, own, sums, strict=True)] if r["whole"] else sums
            before = r["last"]
        return entered

    shared = spark.sparkContext.broadcast(enter())

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sums = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.schema.get_field_index("__range")
            begins, keys = _runs(batch, key, last)
            if last is None:
                sums = shared.value[batch.column(at)[0].as_py()]
                begins[0] = all(s is None for s in sums)
            tail = np.flatnonzero(begins)
            out = []
            for i, f in enumerate(folds):
                own = values(batch, f)
                out.append(f.prefix(own, begins, sums[i]))
                rest = f.total(own[tail[-1] if len(tail) else 0 :])
                sums = [*sums[:i], rest if len(tail) else f.join(sums[i], rest), *sums[i + 1 :]]
            last = keys[-1]
            body = [c for k, c in enumerate(batch.columns) if k != at]
            yield pa.RecordBatch.from_arrays([*body, *[pa.array(o, kinds[f.output]) for o, f in zip(out, folds, strict=True)]], names=[*[n for n in batch.schema.names if n != "__range"], *[f.output for f in folds]])

    kinds = {f.output: {"string": pa.string(), "double": pa.float64(), "bigint": pa.int64(), "boolean": pa.bool_()}[f.type] for f in folds}
    fields = [*[f"`{x.name}` {x.dataType.simpleString()}" for x in kept.schema], *[f"`{f.output}` {f.type}" for f in folds]]
    return dealt.mapInArrow(apply, ", ".join(fields))
