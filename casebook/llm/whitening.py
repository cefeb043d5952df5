"""Whitening of embeddings: blockwise QR of the centred vectors and the singular directions of the last triangle.

No covariance matrix is formed. Every task reduces its rows, block by block, to one triangle; triangles are
joined sixteen at a time until few are left, whose QR is the R of all rows. ``bidiagonal`` solves R.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.llm.bidiagonal import EPS, bidiagonalise, right_vectors, squared_singular_values
from casebook.llm.common import record, written

SCALE = 256
#: Triangles that one task joins, and numbers of a block of rows.
FAN, BLOCK = 16, 4_000_000

OUTPUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Whitening:
    """``n`` distinct vectors, their sums, and directions (a row each) with eigenvalues and shares of the trace."""

    n: int
    sums: tuple[int, ...]
    directions: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x`` less the mean in double precision; whole numbers are subtracted first, so large means cost no digits."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        part = np.array([(s % self.n) / self.n for s in self.sums])
        return (x - whole).astype(float) - part

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of ``(n * x - S) ** 2``, exact; None where a long cannot hold it."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n for s in self.sums], np.int64)
        near = x - whole
        bound = (int(np.abs(near).max(initial=0)) + 1) * self.n
        if bound * bound * max(1, x.shape[1]) < 2**63:
            return ((near * self.n - rest) ** 2).sum(axis=1).tolist()
        exact = ((near.astype(object) * self.n - rest.astype(object)) ** 2).sum(axis=1)
        return [v if v < 2**63 else None for v in exact]

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.directions.T / np.sqrt(self.values)


def usable(vector: Column) -> Column:
    """True for vectors without a null or non-finite entry; false for null and empty ones."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def whole_vectors(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and x, the entries times ``SCALE`` rounded down, of the vectors of the most common length."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
    rows = rows.filter(usable(F.col("v")))
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    x = F.transform("v", lambda c: F.floor(c * SCALE).cast("long"))
    return rows.filter(F.size("v") == (lengths["d"] if lengths else 0)).select("vec_id", x.alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _joined(r: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows if r is None else np.vstack((r, rows)), mode="r")


def triangle(distinct: DataFrame, model: Whitening) -> np.ndarray:
    """R of the centred rows of ``distinct.x``; square, with rows of zeros if there are fewer vectors than dimensions."""
    d = len(model.sums)
    step = max(d, BLOCK // max(1, d))
    schema = pa.schema([("part", pa.int64()), ("r", pa.binary())])

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            x = _matrix(batch.column(0))
            for i in range(0, len(x), step):
                r = _joined(r, model.centred(x[i : i + step]))
        if r is not None:
            yield record(schema, [TaskContext.get().partitionId()], [r.tobytes()])

    def merged(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        r = None
        for cell in rows.sort_by("part").column("r"):
            r = _joined(r, np.frombuffer(cell.as_py()).reshape(-1, d))
        return pa.table({"part": [key[0].as_py()], "r": [r.tobytes()]}, schema=schema)

    parts = written(distinct.select("x").mapInArrow(reduced, "part long, r binary"), "triangles")
    while parts.count() > FAN:
        parts = written(parts.groupBy(F.floor(F.col("part") / FAN).alias("g")).applyInArrow(merged, "part long, r binary"), "triangles")
    r = None
    for row in parts.orderBy("part").collect():
        r = _joined(r, np.frombuffer(row["r"]).reshape(-1, d))
    out = np.zeros((d, d))
    if r is not None:
        out[: len(r)] = r
    return out


def fit(vectors: DataFrame, components: int = 4) -> Whitening | None:
    """Directions of the distinct ``x`` of ``vectors``; None without any vector.

    Only directions with an eigenvalue above rounding are kept, so there are fewer than ``components`` where
    the vectors span fewer dimensions, and none if all are equal.
    """
    distinct = written(vectors.select("x").distinct(), "whitening-fit")
    entry = F.posexplode("x").alias("i", "c")
    sums = distinct.select(entry).groupBy("i").agg(F.sum(F.col("c").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"))
    found = sums.orderBy("i").collect()
    if not found:
        return None
    d = len(found)
    model = Whitening(found[0]["n"], tuple(int(r["s"]) for r in found), np.zeros((0, d)), np.zeros(0), np.zeros(0))
    a, b, w = bidiagonalise(triangle(distinct, model))
    squares = squared_singular_values(a, b)
    total = float(squares.sum())
    leading = squares[:components]
    leading = leading[leading > (d * EPS) ** 2 * total]
    directions = (w @ right_vectors(a, b, leading)).T
    model = Whitening(model.n, model.sums, directions, leading / model.n, leading / total if total else leading)
    return Whitening(model.n, model.sums, directions, model.values, model.explained, _identity_error(distinct, model))


def _identity_error(distinct: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened covariance over the fit list minus the identity; 0 without components."""
    k = len(model.values)
    if not k:
        return 0.0
    schema = pa.schema([(f"w{i}", pa.float64()) for i in range(k)])

    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield record(schema, *np.ascontiguousarray(model.whiten(_matrix(batch.column(0))).T))

    rows = distinct.select("x").mapInArrow(whitened, ", ".join(f"w{i} double" for i in range(k)))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    got = rows.agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(got[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whitened(embeddings: DataFrame, components: int = 4) -> DataFrame:
    """A row for each usable vector and component: place on the component over the root of its eigenvalue.

    Entries become whole numbers, ``floor(256 * c)``; each distinct vector counts once in means and
    covariances, and every row, repeated ones too, is whitened. Vectors that are null, empty or hold a null
    or non-finite entry give no row, nor do vectors of another length than the most common one (the greater
    length on a tie). Components whose eigenvalue is zero are left out, so equal vectors, a single vector and
    an empty table give no row. Tied eigenvalues share a plane, of which some orthogonal directions are taken.
    A null ``vec_id`` is returned as it is; ``deviation`` is null where a long cannot hold it. Other columns
    are ignored, whatever their names.
    """
    spark = embeddings.sparkSession
    vectors = whole_vectors(embeddings)
    model = fit(vectors, components)
    if model is None or not len(model.values):
        return spark.createDataFrame([], OUTPUT)
    k = len(model.values)
    schema = pa.schema(
        [("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64())]
        + [(name, pa.float64()) for name in ("whitened", "explained", "identity_error")]
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column("x"))
            m = len(x)
            each = np.repeat(np.arange(m), k)
            yield record(
                schema,
                batch.column("vec_id").take(pa.array(each)),
                np.tile(np.arange(1, k + 1, dtype=np.int32), m),
                np.full(m * k, model.n),
                pa.array(model.deviation(x), pa.int64()).take(pa.array(each)),
                model.whiten(x).reshape(-1),
                np.tile(model.explained, m),
                np.full(m * k, model.identity_error),
            )

    return vectors.mapInArrow(rows, OUTPUT)
