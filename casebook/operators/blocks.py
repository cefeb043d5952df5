"""A matrix packed into blocks of rows, for jobs that evaluate many models in one pass.

A block is a row of a DataFrame: values as bytes, labels, the part each case belongs to and a hash of its id.
Part -1 is a table of its own (a balanced training table, say); parts 0, 1, ... are folds of another. A model
names its rows by one number: ``MAIN`` takes part -1, ``ALL`` every fold, and f every fold but f.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.functions.exprs import col
from casebook.session import kept
from casebook.spec import MatrixSpec

MAIN, ALL = -1, -2
#: Rows of a block, and least rows of a task: the sums of all models are shuffled once for each task.
ROWS, TASK = 4096, 20_000
#: Up to so many tasks send their sums to the driver as they are; more are summed by a shuffle first.
FEW = 8
SCHEMA = "x binary, y binary, part binary, key binary"


@dataclass(frozen=True)
class Block:
    x: np.ndarray  # cases by columns
    y: np.ndarray  # 0 or 1
    part: np.ndarray
    key: np.ndarray  # a hash of the case id

    def taken(self, rows: int) -> np.ndarray:
        if rows == MAIN:
            return self.part == -1
        return (self.part >= 0) & (self.part != rows)


@dataclass(frozen=True)
class Blocks:
    """``wide`` has the columns (doubles) with _y, _part and _key; ``data`` the same packed, kept for many passes."""

    columns: tuple[str, ...]
    wide: DataFrame
    data: DataFrame
    tasks: int

    def release(self) -> None:
        self.data.unpersist()

    def index(self, names) -> tuple[int, ...]:
        return tuple(self.columns.index(n) for n in names)

    def each(self, task: Callable[[Iterator[Block]], Iterator[tuple[int, bytes]]]) -> DataFrame:
        """(id, v) rows that ``task`` yields for the blocks of every partition."""
        width = len(self.columns)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = list(task(unpacked(batches, width)))
            if found:
                ids, cells = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(cells, pa.binary())], ["id", "v"])

        return self.data.mapInArrow(run, "id long, v binary")

    def sums(self, task: Callable[[Iterator[Block]], dict[int, np.ndarray]]) -> dict[int, np.ndarray]:
        """Sums over all partitions of the vectors that ``task`` returns by id; one row an id reaches the driver."""

        def cells(blocks: Iterator[Block]) -> Iterator[tuple[int, bytes]]:
            return ((i, np.asarray(v, float).tobytes()) for i, v in task(blocks).items())

        total: dict[int, np.ndarray] = {}
        if self.tasks <= FEW:
            for r in self.each(cells).collect():
                total[r.id] = total.get(r.id, 0.0) + np.frombuffer(r.v)
            return total

        def added(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
            total = 0.0
            for cell in rows.column("v"):
                total = total + np.frombuffer(cell.as_py())
            return pa.table({"id": pa.array([key[0].as_py()], pa.int64()), "v": pa.array([total.tobytes()], pa.binary())})

        rows = self.each(cells).groupBy("id").applyInArrow(added, "id long, v binary").collect()
        return {r.id: np.frombuffer(r.v) for r in rows}


def unpacked(batches: Iterator[pa.RecordBatch], width: int, dtype=float) -> Iterator[Block]:
    for batch in batches:
        for x, y, part, key in zip(*(c.to_pylist() for c in batch.columns)):
            yield Block(np.frombuffer(x, dtype).reshape(-1, width), np.frombuffer(y), np.frombuffer(part, np.int32), np.frombuffer(key, np.int64))


def wide_table(df: DataFrame, spec: MatrixSpec, columns: dict[str, Column], part: Column) -> DataFrame:
    """The columns of ``columns`` by name, with _y, _part and _key."""
    return df.select(
        *[c.cast("double").alias(n) for n, c in columns.items()],
        col(spec.label).cast("double").alias("_y"),
        part.cast("int").alias("_part"),
        F.xxhash64(col(spec.case_id)).alias("_key"),
    )


def packed(wide: DataFrame, rows: int = ROWS) -> Blocks:
    columns = tuple(c for c in wide.columns if c not in ("_y", "_part", "_key"))
    tasks = -(-wide.count() // TASK)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), rows):
                b = batch.slice(at, rows)
                x = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in columns]).astype(float)
                y, part, key = (b.column(c).to_numpy(zero_copy_only=False) for c in ("_y", "_part", "_key"))
                cells = [np.ascontiguousarray(x), y.astype(float), part.astype(np.int32), key.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cells], ["x", "y", "part", "key"])

    data = kept(wide.select(*columns, "_y", "_part", "_key").coalesce(max(1, tasks)).mapInArrow(pack, SCHEMA))
    return Blocks(columns, wide, data, max(1, tasks))


def table_blocks(df: DataFrame, spec: MatrixSpec, part: Column | None = None) -> Blocks:
    """One matrix as blocks; all of it is part 0 if no part is named."""
    return packed(wide_table(df, spec, {f: col(f) for f in spec.features}, F.lit(0) if part is None else part))


def mixed(h: np.ndarray) -> np.ndarray:
    """A hash of 64-bit integers, as unsigned ones."""
    h = h.astype(np.uint64)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(by)
    h ^= h >> np.uint64(31)
    return h


def hashes(key: np.ndarray, seed: int) -> np.ndarray:
    salt = mixed(np.array([seed], np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return mixed(key.view(np.uint64) ^ salt)


def _share(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(float) / float(1 << 53)


def uniform(key: np.ndarray, seed: int) -> np.ndarray:
    """A repeatable draw in [0, 1) for every case; cases of one id draw alike."""
    return _share(hashes(key, seed))


class Steps:
    """How many of at most 254 rising cut points ``uniform`` reaches, by its leading 16 bits; only draws that share them with a cut are compared."""

    def __init__(self, cuts):
        self.cuts = np.asarray(cuts, float)
        low = np.searchsorted(self.cuts, np.arange(1 << 16) / (1 << 16), side="right")
        high = np.searchsorted(self.cuts, np.nextafter(np.arange(1, (1 << 16) + 1) / (1 << 16), 0.0), side="right")
        self.table = np.where(low == high, low, 255).astype(np.uint8)

    def drawn(self, key: np.ndarray, seed: int) -> np.ndarray:
        h = hashes(key, seed)
        out = self.table[h >> np.uint64(48)]
        near = np.flatnonzero(out == 255)
        out[near] = np.searchsorted(self.cuts, _share(h[near]), side="right")
        return out
