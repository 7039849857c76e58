"""Arrays to rows, and batches in parts of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rows_of(df: DataFrame, keep: list[Column | str], items: Column, position: str,
            item: str) -> DataFrame:
    """One row per array item with its position from 0; nothing for an empty or null array.

    The outer form with a filter above it: for the inner form Spark also puts a filter on the
    array below the explode, and computes an expensive array three times over.
    """
    exploded = df.select(*keep, F.posexplode_outer(items).alias(position, item))
    return exploded.where(F.col(position).isNotNull())


# Bytes of a batch that are Python objects at a time; a batch may hold many times that.
MAX_PART_BYTES = 4 * 1024 * 1024


def parts_of(column: pa.Array, most: int = MAX_PART_BYTES) -> Iterator[tuple[int, int]]:
    """First row and number of rows of the parts of a column, each of about `most` bytes or of one row."""
    at, n = 0, len(column)
    step = max(1, n * most // max(1, column.nbytes))
    while at < n:
        rows = min(step, n - at)
        while rows > 1 and column.slice(at, rows).nbytes > 2 * most:
            rows = -(-rows // 2)
        yield at, rows
        at += rows


def row_by_row(column: pa.Array, function: Callable[[Any], Any], kind: pa.DataType) -> pa.Array:
    """The function of each row, of which only some rows are Python objects at a time."""
    made = [pa.array([function(v.as_py()) for v in column.slice(at, rows)], kind) for at, rows in parts_of(column)]
    whole = pa.concat_arrays(made) if made else pa.array([], kind)
    del made
    pa.default_memory_pool().release_unused()  # the parts, and what the batch before held
    return whole
