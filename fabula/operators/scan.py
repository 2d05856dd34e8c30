"""Order-dependent operators as passes over sorted rows.

``sorted_scan``: rows are shuffled by key, sorted within partitions and streamed through a
small state machine, so a key with very many rows needs no more memory than any other; it
is one task, though.

``segmented_scan``: rows are dealt by ranges of key and order, so that one key may be many
tasks. Only the first key of a range may have begun before it; all others are done at once. What a
range does to any state it may begin with is summarised; the summaries are composed, range after
range, to the state each one begins with; then the first keys of all ranges are replayed from there.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BooleanType, DataType, StringType, StructField, StructType

from fabula.plans.storage import materialize


def _listed(column: pa.Array) -> list:
    """The values of a column; strings and whole columns of numbers by numpy, which is much faster."""
    kind = column.type
    plain = pa.types.is_string(kind) or (column.null_count == 0 and (pa.types.is_integer(kind) or pa.types.is_floating(kind)))
    return column.to_numpy(zero_copy_only=False).tolist() if plain else column.to_pylist()


def sorted_scan(df: DataFrame, key: str, order: list, reads: list[str], start: Callable[[], object], step: Callable[[object, tuple], object], out: str, out_type: DataType) -> DataFrame:
    """Adds column ``out``: what ``step(state, values of reads)`` returns for each row, with
    a state from ``start()`` for every new value of ``key``."""
    schema = StructType([*df.schema.fields, StructField(out, out_type)])
    kind = to_arrow_type(out_type)
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = object(), None
        for batch in batches:
            keys = _listed(batch.column(names.index(key)))
            rows = zip(*(_listed(batch.column(names.index(c))) for c in reads), strict=True)
            made = []
            for k, row in zip(keys, rows, strict=True):
                if k != current:
                    current, state = k, start()
                made.append(step(state, row))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, kind)], names=names)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


class Machine(Protocol):
    """States and summaries are what JSON can hold. A summary's size doesn't grow with its rows."""

    def start(self) -> dict: ...

    def step(self, state: dict, row: tuple) -> Any:
        """The value for a row; ``state`` becomes what it is after it."""

    def summary(self, rows: list[tuple]) -> Any:
        """What the rows do to any state."""

    def apply(self, state: dict, summary: Any) -> dict:
        """The state after the rows of a summary."""


class Resets:
    """A machine that numbers segments. A row may begin a new segment anyway, or because a
    value differs from the last one that the segment has of the same name; what a segment
    has not said yet never begins a new one.

    ``read(row)`` gives whether the row begins one anyway, the values that it compares, and
    those that it sets, which include all compared ones. From an unknown state only the first
    compared value of each name may or may not begin a segment, until something in the range
    itself surely does; so a summary has one case for each name, and one for none of them.
    """

    def __init__(self, read: Callable[[tuple], tuple[bool, dict[str, str], dict[str, str]]]):
        self.read = read

    def start(self) -> dict:
        return {"segment": 0, "last": {}}

    def step(self, state: dict, row: tuple) -> int:
        anyway, compared, sets = self.read(row)
        last = state["last"]
        if not state["segment"] or anyway or any(last.get(k) not in (None, v) for k, v in compared.items()):
            state["segment"] += 1
            state["last"] = last = {}
        last.update(sets)
        return state["segment"]

    def summary(self, rows: list[tuple]) -> dict:
        def fresh(i: int) -> list:
            state = self.start()
            for row in rows[i:]:
                self.step(state, row)
            return [state["segment"], state["last"]]

        known: dict[str, str] = {}
        cases = []
        for i, row in enumerate(rows):
            anyway, compared, sets = self.read(row)
            if anyway or any(known.get(k) not in (None, v) for k, v in compared.items()):
                return {"first": fresh(0), "cases": cases, "reset": fresh(i)}
            doubtful = [(k, v) for k, v in compared.items() if k not in known]
            if doubtful:
                after = fresh(i)
                cases += [[k, v, after] for k, v in doubtful]
            known.update(sets)
        return {"first": fresh(0), "cases": cases, "known": known}

    def apply(self, state: dict, summary: dict) -> dict:
        segment, last = state["segment"], state["last"]
        if not segment:
            return {"segment": summary["first"][0], "last": dict(summary["first"][1])}
        for k, v, after in summary["cases"]:
            if last.get(k) not in (None, v):
                return {"segment": segment + after[0], "last": dict(after[1])}
        if "reset" in summary:
            return {"segment": segment + summary["reset"][0], "last": dict(summary["reset"][1])}
        return {"segment": segment, "last": last | summary["known"]}


class Previous:
    """A machine whose value is that of the row before, null for the first."""

    def start(self) -> dict:
        return {"value": None}

    def step(self, state: dict, row: tuple) -> Any:
        before, state["value"] = state["value"], row[0]
        return before

    def summary(self, rows: list[tuple]) -> Any:
        return rows[-1][0]

    def apply(self, state: dict, summary: Any) -> dict:
        return {"value": summary}


_RANGE, _TAIL, _STATE, _OPEN = "__range", "__tail", "__state", "__open"


def _runs(keys: list) -> list[tuple[int, int]]:
    """Where runs of equal keys begin and end."""
    at = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
    return list(zip(at[:-1], at[1:], strict=True)) if keys else []


def segmented_scan(df: DataFrame, key: str, order: list[str | Column], reads: list[str], machine: Machine, out: str, out_type: DataType, ranges: int | None = None) -> DataFrame:
    """Adds column ``out``: the machine's value for each row, with a state of its own for every
    value of ``key``. ``order`` should tell all rows of a key apart. A task holds the values
    of ``reads`` of its range; ranges are Spark's, even for a key with most of the rows."""
    by = [key, *order]
    dealt = df.repartitionByRange(ranges, *by) if ranges else df.repartitionByRange(*by)
    dealt = dealt.withColumn(_RANGE, F.spark_partition_id()).sortWithinPartitions(*by)
    names = df.columns
    at_key, at_reads = names.index(key), [names.index(c) for c in reads]
    values = lambda batch: list(zip(*(_listed(batch.column(i)) for i in at_reads), strict=True))
    kind = to_arrow_type(out_type)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows with their values, those of the first key left open; the last one of a range
        has what is to be known of its ends."""
        held, first, run, alone, state = None, None, [], True, None
        for batch in batches:
            if not len(batch):
                continue
            keys, rows = _listed(batch.column(at_key)), values(batch)
            made, opened = [], []
            for begin, end in _runs(keys):
                if first is None:
                    first = current = [keys[begin]]
                elif keys[begin] != current[0]:
                    run, alone, current, state = [], False, [keys[begin]], machine.start()
                run += rows[begin:end]
                made += [None] * (end - begin) if alone else [machine.step(state, row) for row in rows[begin:end]]
                opened += [alone] * (end - begin)
            if held is not None:
                yield _with(held, None)
            held = pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, kind), pa.array(opened)], names=[*batch.schema.names, out, _OPEN])
        if held is not None:
            summary = machine.summary(run)
            yield _with(held, json.dumps({"first": _told(first[0]), "last": _told(current[0]), "alone": alone, "summary": summary}))

    def _with(batch: pa.RecordBatch, tail: str | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([None] * (len(batch) - 1) + [tail], pa.string())], names=[*batch.schema.names, _TAIL])

    added = [StructField(out, out_type), StructField(_OPEN, BooleanType()), StructField(_TAIL, StringType())]
    kept = materialize(dealt.mapInArrow(summarise, StructType([*dealt.schema.fields, *added])), "ranges")

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The state that a range begins with, where its first key began before."""
        of, state = None, None
        for batch in batches:
            found = []
            for n, tail in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                t = json.loads(tail)
                if of == t["first"]:
                    found.append((n, json.dumps(state)))
                before = state if of == t["first"] and t["alone"] else machine.start()
                of, state = t["last"], machine.apply(before, t["summary"])
            yield pa.RecordBatch.from_pydict({_RANGE: pa.array([n for n, _ in found], pa.int32()), _STATE: pa.array([s for _, s in found], pa.string())})

    # one small row for each range, not for each row of the input
    ends = kept.where(F.col(_TAIL).isNotNull()).select(_RANGE, _TAIL)
    states = ends.coalesce(1).sortWithinPartitions(_RANGE).mapInArrow(compose, f"{_RANGE} int, {_STATE} string")

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, current, state = None, None, None
        for batch in batches:
            keys, rows = _listed(batch.column(at_key)), values(batch)
            where, given = _listed(batch.column(len(names))), batch.column(len(names) + 1)
            made = []
            for i, (k, row) in enumerate(zip(keys, rows, strict=True)):
                if place != where[i]:
                    place, current = where[i], k
                    began = given[i].as_py()
                    state = json.loads(began) if began else machine.start()
                elif k != current:
                    current, state = k, machine.start()
                made.append(machine.step(state, row))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(made, kind)], names=[*names, out])

    rows = kept.where(_OPEN).select(*names, _RANGE).join(states, _RANGE, "left").select(*names, _RANGE, _STATE)
    rows = rows.repartition(_RANGE).sortWithinPartitions(_RANGE, *by)
    replayed = rows.mapInArrow(replay, StructType([*df.schema.fields, added[0]]))
    return kept.where(~F.col(_OPEN)).select(*names, out).union(replayed)


def _told(key: Any) -> str:
    return json.dumps(key, default=str)
