"""Arrays of numbers as binary values, so that a row carries many of them through a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from broadsheet.llm import wordhash


def to_blobs(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """One binary value for each values[bounds[i]:bounds[i+1]]."""
    values = np.ascontiguousarray(values)
    offsets = pa.py_buffer((bounds.astype(np.int64) * values.itemsize).tobytes())
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, offsets, pa.py_buffer(values)]).cast(pa.binary())


def from_blobs(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All values one after another, and the bounds of each row's; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    size = np.dtype(kind).itemsize
    if not len(column):
        return np.zeros(0, kind), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, kind), np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    return np.frombuffer(raw.tobytes(), kind), (at - at[0]) // size


def split(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts by key (0 .. n-1, stable), and the bounds of each key."""
    order = np.argsort(keys, kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(keys, minlength=n))])


def rows_of(values: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and bounds of some rows only."""
    sizes = np.diff(bounds)[rows]
    return values[wordhash.ragged(bounds[:-1][rows], sizes)], np.concatenate([[0], np.cumsum(sizes)])


def filled(batch: pa.RecordBatch, *columns: str) -> pa.RecordBatch:
    """The rows of a batch in which any of these binary columns is not empty."""
    sizes = sum(pc.binary_length(batch.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    return batch.take(pa.array(np.flatnonzero(sizes)))


def table(columns: dict[str, object], schema: str) -> pa.RecordBatch:
    """A batch with columns cast to the types of a schema in SQL notation."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
    names = [f.split() for f in schema.split(", ")]
    arrays = [c if isinstance(c := columns[n], pa.Array) else pa.array(c, kinds[k]) for n, k in names]
    return pa.RecordBatch.from_arrays([a.cast(kinds[k]) for a, (_, k) in zip(arrays, names, strict=True)], names=[n for n, _ in names])


def pieces(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Runs of a batch's rows whose binary values of a column have about ``most`` bytes together; a larger value is a run of its own."""
    behind = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    row = 0
    while row < batch.num_rows:
        stop = int(np.searchsorted(behind, (behind[row - 1] if row else 0) + most, "right"))
        stop = max(stop, row + 1)
        yield batch.slice(row, stop - row)
        row = stop


#: Buckets of hashes that one batch is divided into, at most.
MOST_BUCKETS = 4096


def refined(rows: DataFrame, schema: str, bucket_of: Callable[[np.ndarray], np.ndarray], hashed: list[tuple[str, ...]], loose: tuple[str, ...]) -> DataFrame:
    """Rows (``schema``, with a column bucket) of coarse buckets dealt anew to fine ones.

    A batch that goes to very many buckets would send a row for nearly each hash. So it sends coarse buckets, which meet here and are
    divided by what ``bucket_of`` says of their hashes. hashed: columns of 64-bit hashes, each with the columns that go with it, as
    "name:kind"; loose: columns that may lie in any bucket and stay together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sorted_by, found = [], []
            for names in hashed:
                values = [from_blobs(batch.column(batch.schema.get_field_index(n)), k)[0] for n, k in (c.split(":") for c in names)]
                fine = bucket_of(values[0])
                order = np.argsort(fine, kind="stable")
                sorted_by.append(fine[order])
                found.append([v[order] for v in values])
            used = np.unique(np.concatenate(sorted_by))
            rest = [from_blobs(batch.column(batch.schema.get_field_index(n)), k)[0] for n, k in (c.split(":") for c in loose)]
            if not len(used):
                used = np.unique(batch.column(batch.schema.get_field_index("bucket")).to_numpy())[:1]
            columns: dict[str, object] = {"bucket": used}
            for names, by, values in zip(hashed, sorted_by, found, strict=True):
                cuts = np.append(np.searchsorted(by, used), len(by))
                columns |= {c.split(":")[0]: to_blobs(v, cuts) for c, v in zip(names, values, strict=True)}
            for c, v in zip(loose, rest, strict=True):
                columns[c.split(":")[0]] = to_blobs(v, np.concatenate([[0], np.full(len(used), len(v))]))
            yield table(columns, schema)

    return rows.repartition("bucket").mapInArrow(run, schema)
