"""Columns of numbers packed into bytes, and tables of counts that tasks add up."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from reviewlake.llm._shared import squeezed, unsqueezed

#: (name, type, stored bytes, whether differences are stored)
Fields = tuple[tuple[str, type, int, bool], ...]
SLICES = 64


def pack(columns: dict[str, np.ndarray], fields: Fields) -> bytes:
    """The columns, all of one length, byte by byte and compressed."""
    parts = []
    for name, kind, size, differences in fields:
        column = columns[name].astype(kind, copy=False)
        column = np.diff(column, prepend=column.dtype.type(0)) if differences else column
        parts.append(np.ascontiguousarray(column).view(np.uint8).reshape(len(column), 8)[:, :size].T.tobytes())
    return squeezed(b"".join(parts))


def unpack(blobs: list[bytes], fields: Fields) -> dict[str, np.ndarray]:
    """The columns of all blobs, one after another."""
    width = sum(f[2] for f in fields)
    parts = [np.frombuffer(unsqueezed(blob), np.uint8).reshape(width, -1) for blob in blobs]
    parts = [p for p in parts if p.shape[1]]
    lengths = np.array([p.shape[1] for p in parts], np.int64)
    starts = np.cumsum(lengths) - lengths
    rows, at, out = np.concatenate(parts, axis=1) if parts else np.zeros((width, 0), np.uint8), 0, {}
    del parts
    for name, kind, size, differences in fields:
        wide = np.zeros((rows.shape[1], 8), np.uint8)
        wide[:, :size] = rows[at : at + size].T
        column = wide.view(kind).reshape(-1)
        if differences and len(column):
            # Sums wrap around, so what came before a blob is taken off again.
            sums = np.cumsum(column, dtype=kind)
            column = sums - np.repeat(np.concatenate([np.zeros(1, kind), sums[starts[1:] - 1]]), lengths)
        out[name] = column
        at += size
    return out


def dealt(part: np.ndarray, columns: dict[str, np.ndarray], fields: Fields, within: str | None = None) -> Iterator[tuple[int, bytes]]:
    """The rows of each part, packed as pack() does, in their order or in that of a column of less than 40 bits.

    The bytes of all rows are laid out at once, so a part costs little more than its compression.
    """
    if not len(part):
        return
    order = np.argsort(part, kind="stable") if within is None else np.argsort((part << 40) | columns[within])
    part = part[order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
    rows, at = np.empty((sum(f[2] for f in fields), len(part)), np.uint8), 0
    for name, kind, size, differences in fields:
        column = columns[name][order].astype(kind, copy=False)
        if differences:
            steps = np.diff(column, prepend=column.dtype.type(0))
            steps[cuts[:-1]] = column[cuts[:-1]]
            column = steps
        rows[at : at + size] = np.ascontiguousarray(column).view(np.uint8).reshape(len(column), 8)[:, :size].T
        at += size
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield int(part[i]), squeezed(rows[:, i:j].tobytes())


def gathered(batches: Iterator[pa.RecordBatch], key: str, *names: str) -> Iterator[tuple[int, list[tuple]]]:
    """The rows of each key, from batches sorted by it."""
    rows = (row for batch in batches for row in zip(*(batch.column(n).to_pylist() for n in (key, *names)), strict=True))
    for value, group in groupby(rows, key=lambda r: r[0]):
        yield value, [r[1:] for r in group]


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, total = None, np.zeros(0, np.int64)
    for batch in batches:
        for number, blob in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            counts = np.frombuffer(unsqueezed(blob), np.int64)
            if number != held and held is not None:
                yield pa.RecordBatch.from_arrays([pa.array([held], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["slice", "counts"])
            held, total = number, counts if number != held else total + counts
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([held], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["slice", "counts"])


def tally(frame: DataFrame, values: Callable[[pa.RecordBatch], Iterator[np.ndarray]], entries: int) -> np.ndarray:
    """How many of the values, not below 0, that batches give are equal to 0, 1, 2, ... modulo entries, a multiple of SLICES.

    Each task counts in a table of its own; slices of the tables are added up on the executors, and the sum, of a fixed
    size, comes to the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(entries, np.int64)
        for batch in batches:
            for found in values(batch):
                np.add.at(table, (found % found.dtype.type(entries)).astype(np.int64), 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLICES)), pa.array([squeezed(x.tobytes()) for x in table.reshape(SLICES, -1)], pa.binary())], ["slice", "counts"])

    schema = "slice long, counts binary"
    parts = frame.mapInArrow(count, schema).repartition(SLICES, "slice").sortWithinPartitions("slice").mapInArrow(_add, schema)
    table = np.zeros((SLICES, entries // SLICES), np.int64)
    for row in parts.collect():  # SLICES rows
        table[row["slice"]] = np.frombuffer(row["counts"], np.int64)
    return table.reshape(-1)
