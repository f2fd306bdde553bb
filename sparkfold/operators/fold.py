"""Folds of the user's own over groups of rows in an order (E03), streamed, with partial results for large groups.

A merger says how a state begins, takes rows, takes in the state of the rows behind it, and what its result is.
Rows are dealt out by ranges of key and order, so a group of any size is the work of many tasks and each task has
a stretch of it; a task walks its sorted rows and hands on one state per group.  The states of a group are then
joined in the order of the stretches.  No group is ever gathered: what is held is one state at a time.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from .lookup import fresh


class Merger:
    """A rule for the rows of a group; a subclass overrides all four.  States are pickled, so they hold plain values."""

    def start(self) -> Any:
        raise NotImplementedError

    def add(self, state: Any, row: dict) -> Any:
        """The state after one more row, which follows those that it has seen."""
        raise NotImplementedError

    def join(self, first: Any, second: Any) -> Any:
        """The state of two stretches, the first before the second."""
        raise NotImplementedError

    def result(self, state: Any) -> dict:
        """Values of the result columns."""
        raise NotImplementedError


def _groups(batches: Iterator[pa.RecordBatch], n: int, width: int) -> Iterator[tuple[tuple, list[dict]]]:
    """Stretches of rows with equal keys (the first n columns) of sorted batches; a group may come in several."""
    for batch in batches:
        keys = list(zip(*[batch.column(i).to_pylist() for i in range(n)], strict=True))
        rows = batch.select(range(n, width)).to_pylist()
        at = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[at]:
                yield keys[at], rows[at:i]
                at = i


def fold(rows: DataFrame, keys: list[str], order: list[str], merger: Merger, schema: str | StructType) -> DataFrame:
    """keys and the columns of ``schema``: the merger's result for the rows of each key, in the order of ``order``.

    Rows that are equal in keys and order come in any order.  Null keys are a group like any other.
    """
    kinds = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    n, width = len(keys), len(rows.columns)
    rest = [c for c in rows.columns if c not in keys]
    target = rows.select(*keys, *rest)
    state, part = fresh("state", rows), fresh("part", rows)
    between = StructType([*target.schema.fields[:n], StructField(part, IntegerType()), StructField(state, BinaryType())])
    arrow = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in between.fields])
    final = StructType([*target.schema.fields[:n], *kinds.fields])
    final_arrow = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in final.fields])

    def emit(found: list[tuple], shape: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), shape, strict=True)], schema=shape)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One state for each group of a range of rows."""
        number, key, held, found = TaskContext.get().partitionId(), None, None, []
        for k, stretch in _groups(batches, n, width):
            if k != key or held is None:
                if held is not None:
                    found.append((*key, number, pickle.dumps(held[0])))
                key, held = k, [merger.start()]
            for row in stretch:
                held[0] = merger.add(held[0], row)
            if len(found) >= 1000:
                yield emit(found, arrow)
                found = []
        if held is not None:
            found.append((*key, number, pickle.dumps(held[0])))
        if found:
            yield emit(found, arrow)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The states of each group joined, in the order of the ranges."""
        key, held, found = None, None, []
        for k, stretch in _groups(batches, n, n + 2):
            if k != key or held is None:
                if held is not None:
                    found.append((*key, *_values(merger.result(held[0]), kinds)))
                key, held = k, [pickle.loads(stretch[0][state])]
                stretch = stretch[1:]
            for row in stretch:
                held[0] = merger.join(held[0], pickle.loads(row[state]))
            if len(found) >= 1000:
                yield emit(found, final_arrow)
                found = []
        if held is not None:
            found.append((*key, *_values(merger.result(held[0]), kinds)))
        if found:
            yield emit(found, final_arrow)

    states = target.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).mapInArrow(walk, between)
    return states.repartition(*keys).sortWithinPartitions(*keys, part).mapInArrow(close, final)


def _values(result: dict, kinds: StructType) -> list:
    return [result.get(f.name) for f in kinds.fields]


def to_arrow_type(kind: Any) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type as convert

    return convert(kind)
