"""Ordered work over keys of any size: running totals, state machines and folds.

Rows are range-partitioned by (key, order), so a key that holds a large share of all rows is
spread over many blocks. Each block is read as a stream of Arrow batches; one small row per block
goes to the driver, and the value a block begins with goes back to it.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.session import materialise

BLOCK = "_block"


def range_blocks(df: DataFrame, key: list[str], order: list[str],
                 expand: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Rows sorted by (key, order), cut into blocks, written to the checkpoint folder.

    `expand` is a narrow step that keeps the order (one row to several, say). It runs after the
    rows have been placed, so that finding the range bounds does not run it a second time.
    """
    columns = [*key, *order]
    placed = df.repartitionByRange(*columns).sortWithinPartitions(*columns)
    if expand is not None:
        placed = expand(placed)
    return materialise(placed.withColumn(BLOCK, F.spark_partition_id()))


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _key_of(batch: pa.RecordBatch, key: list[str], row: int) -> tuple:
    return tuple(_column(batch, k)[row].as_py() for k in key)


def _breaks(batch: pa.RecordBatch, key: list[str], previous: tuple) -> np.ndarray:
    """Where a sorted batch goes over to another key than the row before."""
    n = batch.num_rows
    breaks = np.zeros(n, dtype=bool)
    breaks[0] = _key_of(batch, key, 0) != previous
    for k in key:
        values = _column(batch, k)
        if n > 1:
            same = pc.equal(values.slice(1), values.slice(0, n - 1))
            both_null = pc.and_(values.slice(1).is_null(), values.slice(0, n - 1).is_null())
            equal = pc.fill_null(pc.or_kleene(same, both_null), False)
            breaks[1:] |= ~equal.to_numpy(zero_copy_only=False)
    return breaks


def _batches(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, int]]:
    """Non-empty batches of one block with their breaks and the block; its first row is none."""
    previous = None
    for batch in batches:
        if batch.num_rows:
            if previous is None:
                previous, block = _key_of(batch, key, 0), _column(batch, BLOCK)[0].as_py()
            yield batch, _breaks(batch, key, previous), block
            previous = _key_of(batch, key, batch.num_rows - 1)


_ENDS = T.StructType([T.StructField(BLOCK, T.IntegerType()), T.StructField("ends", T.BinaryType())])


def _ends_row(block: int, ends: Any) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({BLOCK: [block], "ends": [pickle.dumps(ends)]},
                                      schema=pa.schema([(BLOCK, pa.int32()), ("ends", pa.binary())]))


def _per_block(blocks: DataFrame, columns: list[str], scan: Callable) -> dict[int, Any]:
    """What `scan` gives for each block, in order of the blocks: one row per block is collected."""
    rows = blocks.select(BLOCK, *dict.fromkeys(columns)).mapInArrow(scan, _ENDS).collect()
    return {r[BLOCK]: pickle.loads(r["ends"]) for r in sorted(rows, key=lambda r: r[BLOCK])}


def _with_columns(batch: pa.RecordBatch, names: list[str], arrays: list[pa.Array]) -> pa.RecordBatch:
    """The batch without its block and with further columns."""
    kept = [i for i, n in enumerate(batch.schema.names) if n != BLOCK]
    return pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], *arrays],
                                      names=[*[batch.schema.names[i] for i in kept], *names])


def _schema(blocks: DataFrame, more: list[T.StructField]) -> T.StructType:
    return T.StructType([*[f for f in blocks.schema if f.name != BLOCK], *more])


# --- running totals -----------------------------------------------------------------------


def number_rows(df: DataFrame, key: list[str], order: list[str], name: str, start: int = 0,
                expand: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Position of each row within its key, counted from `start` in the given order."""
    return running_totals(df, key, order, None, name, start, expand)


def running_totals(df: DataFrame, key: list[str], order: list[str], value: str | None, name: str, start: int = 0,
                   expand: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """`start` and the sum of a whole-number column over the rows before each row of its key; without a column, their number."""
    blocks = range_blocks(df, key, order, expand)

    def values_of(batch: pa.RecordBatch) -> np.ndarray:
        if value is None:
            return np.ones(batch.num_rows, np.int64)
        return pc.fill_null(_column(batch, value).cast(pa.int64()), 0).to_numpy(zero_copy_only=False)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, tail, whole = None, 0, True
        for batch, breaks, block in _batches(batches, key):
            first = first if first is not None else (_key_of(batch, key, 0),)
            at = np.flatnonzero(breaks)
            values = values_of(batch)
            tail = int(values[at[-1]:].sum()) if len(at) else tail + int(values.sum())
            whole = whole and not len(at)
            last = _key_of(batch, key, batch.num_rows - 1)
        if first is not None:
            yield _ends_row(block, (first[0], last, tail, whole))

    carry, running, before = {}, 0, None
    for block, (first, last, tail, whole) in _per_block(blocks, [*key, *([value] if value else [])], scan).items():
        carry[block] = running if before == (first,) else 0
        running = (carry[block] if whole else 0) + tail
        before = (last,)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        position = None
        for batch, breaks, block in _batches(batches, key):
            position = carry.get(block, 0) if position is None else position
            values = values_of(batch)
            total = np.cumsum(values) - values
            last_break = np.maximum.accumulate(np.where(breaks, np.arange(len(values)), -1))
            sums = np.where(last_break < 0, total + position, total - total[last_break])
            position = int(sums[-1] + values[-1])
            yield _with_columns(batch, [name], [pa.array(sums + start, pa.int64())])

    return blocks.mapInArrow(number, _schema(blocks, [T.StructField(name, T.LongType(), False)]))


# --- state machines -----------------------------------------------------------------------


@dataclass(frozen=True)
class Machine:
    """A machine of few states. A symbol it does not know, or null, leaves the state as it is.

    A symbol is a map from states to states. Maps compose associatively, so the rows of a block
    become one map whatever it begins with, and blocks are combined like partial aggregates.
    """

    states: list
    start: Any
    symbols: list[str]
    following: Callable[[Any, str], Any]

    def table(self) -> np.ndarray:
        """Next state by symbol and state; the last row is that of unknown symbols."""
        index = {s: i for i, s in enumerate(self.states)}
        rows = [[index[self.following(s, symbol)] for s in self.states] for symbol in self.symbols]
        return np.array([*rows, list(range(len(self.states)))], np.intp)


def _maps(batch: pa.RecordBatch, breaks: np.ndarray, symbol: str, symbols: pa.Array, table: np.ndarray, start: int) -> np.ndarray:
    """The map of every row; that of a key's first row gives the same for any state before it."""
    codes = pc.fill_null(pc.index_in(_column(batch, symbol), value_set=symbols), len(symbols))
    maps = table[codes.to_numpy(zero_copy_only=False)]
    maps[breaks] = maps[breaks][:, [start]]
    return maps


def _product(maps: np.ndarray) -> np.ndarray:
    """All maps one after the other."""
    while len(maps) > 1:
        pairs = np.take_along_axis(maps[1::2], maps[:len(maps) // 2 * 2:2], axis=1)
        maps = np.concatenate([pairs, maps[-1:]]) if len(maps) % 2 else pairs
    return maps[0]


def _states_after(maps: np.ndarray, state: int) -> np.ndarray:
    """The state after each map: prefix products of many short segments side by side, then along the segments."""
    n, n_states = maps.shape
    width = max(1, int(np.sqrt(n)))
    height = -(-n // width)
    filler = np.tile(np.arange(n_states, dtype=np.intp), (height * width - n, 1))
    products = np.concatenate([maps, filler]).reshape(height, width, n_states)
    for i in range(1, width):
        products[:, i] = np.take_along_axis(products[:, i], products[:, i - 1], axis=1)
    begins = np.empty(height, np.intp)
    for i in range(height):
        begins[i], state = state, products[i, -1, state]
    return np.take_along_axis(products, np.broadcast_to(begins[:, None, None], (height, width, 1)), axis=2).reshape(-1)[:n]


def replay(df: DataFrame, key: list[str], order: list[str], machine: Machine, symbol: str,
           before: str = "before", after: str = "after") -> DataFrame:
    """Rows with the number of the machine's state before and after each."""
    blocks = range_blocks(df, key, order)
    table, start = machine.table(), machine.states.index(machine.start)
    symbols = pa.array(machine.symbols, pa.string())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, whole = None, table[-1]
        for batch, breaks, block in _batches(batches, key):
            first = first if first is not None else (_key_of(batch, key, 0),)
            at = np.flatnonzero(breaks)
            tail = slice(int(at[-1]) if len(at) else 0, None)  # what lies before a key's first row does not matter
            maps = _maps(batch.slice(tail.start), breaks[tail], symbol, symbols, table, start)
            whole = _product(np.concatenate([whole[None], maps]))
            last = _key_of(batch, key, batch.num_rows - 1)
        if first is not None:
            yield _ends_row(block, (first[0], last, whole.tolist()))

    carry, state, previous = {}, start, None
    for block, (first, last, whole) in _per_block(blocks, [*key, symbol], scan).items():
        carry[block] = state if previous == (first,) else start
        state, previous = whole[carry[block]], (last,)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch, breaks, block in _batches(batches, key):
            state = carry.get(block, start) if state is None else state
            states = _states_after(_maps(batch, breaks, symbol, symbols, table, start), state)
            earlier = np.concatenate([[state], states[:-1]])
            earlier[breaks] = start
            state = int(states[-1])
            yield _with_columns(batch, [before, after], [pa.array(earlier, pa.int32()), pa.array(states, pa.int32())])

    return blocks.mapInArrow(run, _schema(blocks, [T.StructField(n, T.IntegerType(), False) for n in (before, after)]))


# --- folds --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Fold:
    """State carried over the ordered rows of a key, for states that are too many for a machine.

    `step(state, values)` returns (next state, outputs). With `gap`, a number column and a
    distance: a row that far or farther behind the row before it begins from `start` again.
    """

    start: Any
    step: Callable[[Any, tuple], tuple[Any, tuple]]
    inputs: list[str]
    outputs: list[T.StructField]
    gap: tuple[str, int] | None = None


def _values(batch: pa.RecordBatch, columns: list[str]) -> list[tuple]:
    return list(zip(*[_column(batch, c).to_pylist() for c in columns]))


def _fresh(batch: pa.RecordBatch, breaks: np.ndarray, fold: Fold, last: int | None) -> tuple[np.ndarray, int | None]:
    """Rows that begin from the start state, and the last value of the gap column."""
    if fold.gap is None:
        return breaks, None
    values = _column(batch, fold.gap[0]).to_numpy(zero_copy_only=False)
    far = np.diff(values, prepend=values[0] if last is None else last) >= fold.gap[1]
    return breaks | far, int(values[-1])


def _carried_states(blocks: DataFrame, key: list[str], order: list[str], fold: Fold) -> dict[int, Any]:
    """The state each block begins with, where that is not the start state.

    Segments between breaks are independent. One job finds what each block's last segment ends
    with. Only where a segment goes on through whole blocks do these need the state before them;
    each such chain is read in order, by one task, as a stream, all chains in one job.
    """
    column = [fold.gap[0]] if fold.gap else []

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last_value, state, closed = None, None, fold.start, False
        for batch, breaks, block in _batches(batches, key):
            first = first if first is not None else (_key_of(batch, key, 0), _column(batch, column[0])[0].as_py() if column else None)
            fresh, last_value = _fresh(batch, breaks, fold, last_value)
            at = np.flatnonzero(fresh)
            if len(at):
                state, closed = fold.start, True
            for values in _values(batch.slice(int(at[-1]) if len(at) else 0), fold.inputs):
                state = fold.step(state, values)[0]
            last = _key_of(batch, key, batch.num_rows - 1)
        if first is not None:
            yield _ends_row(block, (*first, last, last_value, closed, state))

    found = _per_block(blocks, [*key, *column, *fold.inputs], scan)
    order_of = list(found)
    carry: dict[int, Any] = {}
    ends: dict[int, Any] = {}
    chains: list[list[int]] = []  # whole blocks in turn; the state before the first one is known
    waits: dict[int, int] = {}  # block to the block whose end it needs
    for before, block in zip([None, *order_of], order_of):
        first, first_value, _, _, closed, state = found[block]
        goes_on = before is not None and found[before][2] == first and not (
            fold.gap and first_value - found[before][3] >= fold.gap[1])
        if not goes_on or closed:
            ends[block] = state
        if goes_on and before in ends:
            carry[block] = ends[before]
            if not closed:
                chains.append([block])
        elif goes_on:
            waits[block] = before
            if not closed:
                chains[-1].append(block)
    if waits:
        needed = set(waits.values())
        chains = [own for chain in chains if (own := [b for b in chain if b in needed])]
        begins = {i: carry[chain[0]] for i, chain in enumerate(chains)}
        later = _chain_ends(blocks, order, fold, chains, begins)
        carry.update({block: later[before] for block, before in waits.items()})
    return carry


def _chain_ends(blocks: DataFrame, order: list[str], fold: Fold, chains: list[list[int]], begins: dict[int, Any]) -> dict[int, Any]:
    """State at the end of every block of the chains; no other block is read."""
    places = blocks.sparkSession.createDataFrame(
        [(b, i) for i, chain in enumerate(chains) for b in chain], f"{BLOCK} int, _chain int")
    own = blocks.where(F.col(BLOCK).isin([b for chain in chains for b in chain]))
    rows = own.select(BLOCK, *dict.fromkeys([*order, *fold.inputs])).join(F.broadcast(places), BLOCK)  # one row per block

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = block = state = None
        for batch in batches:
            for now, at, *values in _values(batch, ["_chain", BLOCK, *fold.inputs]):
                if at != block:
                    if block is not None:
                        yield _ends_row(block, state)
                    block = at
                if now != chain:
                    chain, state = now, begins[now]
                state = fold.step(state, tuple(values))[0]
        if block is not None:
            yield _ends_row(block, state)

    placed = rows.repartition(len(chains), "_chain").sortWithinPartitions("_chain", BLOCK, *order)
    return {r[BLOCK]: pickle.loads(r["ends"]) for r in placed.mapInArrow(follow, _ENDS).collect()}  # one row per block


def ordered_fold(df: DataFrame, key: list[str], order: list[str], fold: Fold) -> DataFrame:
    """Rows with the outputs of the fold."""
    from pyspark.sql.pandas.types import to_arrow_type

    blocks = range_blocks(df, key, order)
    carry = _carried_states(blocks, key, order, fold)
    kinds = [to_arrow_type(f.dataType, prefers_large_types=False) for f in fold.outputs]
    names = [f.name for f in fold.outputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, state, last = False, fold.start, None
        for batch, breaks, block in _batches(batches, key):
            if not begun:
                begun, state = True, carry.get(block, fold.start)
            fresh, last = _fresh(batch, breaks, fold, last)
            produced = []
            for anew, values in zip(fresh.tolist(), _values(batch, fold.inputs)):
                state, out = fold.step(fold.start if anew else state, values)
                produced.append(out)
            yield _with_columns(batch, names, [pa.array(column, kind) for column, kind in zip(zip(*produced), kinds)])

    return blocks.mapInArrow(run, _schema(blocks, fold.outputs))
