"""Approximate nearest neighbours with a hierarchical k-means tree.

The tree is fitted on a bounded sample and every vector descends to a leaf. A query visits leaves
best-bin-first: a priority queue over the tree's nodes pops the nearest centre, opens inner nodes and
lists leaves. How many leaves a query visits is calibrated: the exact neighbours of some queries are
found by brute force, and visits are widened until the share of them in visited leaves is reached.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casebook.llm.common import record, written

SAMPLE = 20_000  # vectors that the tree is fitted on, at most
LEAF = 256  # vectors a leaf, about, as long as the sample can tell so many leaves apart
BRANCHES = 8
CALIBRATION = 200  # queries with exact neighbours, at most
RECALL = 0.96  # their share that visited leaves must hold
VECTORS_A_BLOCK = 512
QUERIES_A_BLOCK = 4096


@dataclass
class Tree:
    """Nodes in the order made, the root first: centre, children, and the leaf's number or -1."""

    centres: np.ndarray
    children: list[list[int]]
    leaf: list[int]

    @property
    def leaves(self) -> int:
        return max(self.leaf) + 1

    @classmethod
    def fit(cls, sample: np.ndarray, leaf_size: float, branches: int = BRANCHES, seed: int = 7) -> Tree:
        rng = np.random.default_rng(seed)
        centres, children, leaf, numbered = [sample.mean(axis=0)], [[]], [-1], 0
        todo = [(0, sample)]
        while todo:
            node, rows = todo.pop()
            groups = _means(rows, min(branches, max(2, int(np.ceil(len(rows) / leaf_size)))), rng) if len(rows) > leaf_size else None
            if groups is None:
                leaf[node], numbered = numbered, numbered + 1
                continue
            for centre, own in groups:
                centres.append(centre)
                children.append([])
                leaf.append(-1)
                children[node].append(len(centres) - 1)
                todo.append((len(centres) - 1, own))
        return cls(np.array(centres), children, leaf)

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest child, level by level."""
        out = np.zeros(len(rows), np.int64)
        todo = [(0, np.arange(len(rows)))]
        while todo:
            node, own = todo.pop()
            if not len(own):
                continue
            if self.leaf[node] >= 0:
                out[own] = self.leaf[node]
                continue
            kids = np.array(self.children[node])
            near = kids[np.argmin(squared(rows[own], self.centres[kids]), axis=1)]
            todo.extend((int(kid), own[near == kid]) for kid in kids)
        return out

    def visits(self, query: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves that the query opens, nearest centre first."""
        queue, out = [(0.0, 0)], []
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                out.append(self.leaf[node])
                continue
            kids = self.children[node]
            for distance, kid in zip(((self.centres[kids] - query) ** 2).sum(axis=1).tolist(), kids):
                heapq.heappush(queue, (distance, kid))
        return out


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by products; near zero they carry the rounding of the norms."""
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T, 0)


def _means(rows: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 15) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """k-means groups (centre, rows); None if all rows are the same."""
    distinct = np.unique(rows, axis=0)
    if len(distinct) < 2:
        return None
    centres = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(rounds):
        near = np.argmin(squared(rows, centres), axis=1)
        used = np.unique(near)
        centres = np.array([rows[near == i].mean(axis=0) for i in used])
    near = np.argmin(squared(rows, centres), axis=1)
    groups = [(centres[i], rows[near == i]) for i in np.unique(near)]
    if len(groups) < 2:  # all nearest to one centre: cut between two different rows instead
        far = squared(rows, distinct[:1])[:, 0] > squared(rows, distinct[-1:])[:, 0]
        groups = [(rows[side].mean(axis=0), rows[side]) for side in (far, ~far)]
    return groups


def usable(vector: Column) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1) if rows else np.zeros((0, 0))


def nearest_rows(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int, slice_rows: int = 4096):
    """(query position, row position, distance) of each query's k nearest rows but itself, ties to the smaller id.

    Products pick the candidates, with room for their rounding; distances are those of the differences.
    """
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(queries), 256):
        q, ids = queries[at : at + 256], query_ids[at : at + 256]
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(q)
        for begin in range(0, len(rows), slice_rows):
            part, part_ids = rows[begin : begin + slice_rows], row_ids[begin : begin + slice_rows]
            rough = squared(q, part)
            rough[ids[:, None] == part_ids[None, :]] = np.inf
            cut = np.partition(rough, min(k, len(part)) - 1, axis=1)[:, min(k, len(part)) - 1]
            room = 1e-9 * (1 + (q * q).sum(axis=1) + (part * part).sum(axis=1).max())
            for i in range(len(q)):
                near = np.flatnonzero((rough[i] <= cut[i] + room[i]) & np.isfinite(rough[i]))
                exact = np.sqrt(((part[near] - q[i]) ** 2).sum(axis=1))
                where, distance = np.append(best[i][0], begin + near), np.append(best[i][1], exact)
                order = np.lexsort((row_ids[where], distance))[:k]
                best[i] = (where[order], distance[order])
        for i, (where, distance) in enumerate(best):
            out.append((np.full(len(where), at + i), where, distance))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out))


FOUND = "query_id long, vec_id long, score double"
FOUND_SCHEMA = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def brute_force(vectors: DataFrame, query_ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """Exact neighbours of a bounded number of queries: each task scans its vectors in slices."""
    sent = vectors.sparkSession.sparkContext.broadcast((query_ids, queries))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, own = sent.value
        for batch in batches:
            if batch.num_rows:
                rows = batch.column("vec_id").to_numpy()
                q, r, distance = nearest_rows(own, ids, _matrix(batch.column("vector")), rows, k)
                yield record(FOUND_SCHEMA, ids[q], rows[r], distance)

    return ranked(vectors.select("vec_id", "vector").mapInArrow(scan, FOUND), k)


def search(
    table: DataFrame,
    is_query: Column,
    k: int = 10,
    sample: int = SAMPLE,
    leaf: int = LEAF,
    recall: float = RECALL,
    calibration: int = CALIBRATION,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row that ``is_query`` picks.

    Score is the Euclidean distance in double precision; ties go to the smaller ``vec_id``; a query is
    not its own neighbour. Rows whose ``vec_id`` is null, or whose ``embedding`` is null, empty, zero or
    holds null or non-finite components, take no part. Vectors must have one length. Repeated ids are
    rows of their own and no neighbours of each other. A table without queries gives no row. Other
    columns are ignored, whatever their names.
    """
    spark = table.sparkSession
    rows = table.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), is_query.alias("asks")
    )
    by_hash = F.xxhash64("vec_id")
    fitted = _matrix(rows.orderBy(by_hash, "vec_id").limit(sample).select("vector").toArrow().column("vector"))
    if not len(fitted):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    total = rows.count()
    tree = Tree.fit(fitted, max(16, leaf * len(fitted) / total))
    sent = spark.sparkContext.broadcast(tree)
    assigned = pa.schema([("vec_id", pa.int64()), ("vector", pa.list_(pa.float64())), ("asks", pa.bool_()), ("leaf", pa.int64())])

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield record(assigned, *batch.columns, sent.value.assign(_matrix(batch.column("vector"))))

    index = written(rows.mapInArrow(descend, "vec_id long, vector array<double>, asks boolean, leaf long"), "ann-index")
    asked = index.filter("asks").select(F.col("vec_id").alias("query_id"), "vector")
    visits = calibrated(index, asked, tree, k, recall, calibration)
    crowds = np.zeros(tree.leaves, np.int64)  # vectors of each leaf: as many numbers as leaves, of which the sample bounds the number
    for r in index.groupBy("leaf").agg(F.count("*").alias("n")).collect():
        crowds[r["leaf"]] = r["n"]
    wanted = pa.schema([("query_id", pa.int64()), ("vector", pa.list_(pa.float64())), ("leaf", pa.int64())])

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                part = batch.slice(begin, 64)
                opened = [_enough(sent.value, q, visits, crowds, k) for q in _matrix(part.column("vector"))]
                own = pa.array(np.repeat(np.arange(len(opened)), [len(x) for x in opened]), pa.int64())
                leaves = np.concatenate([np.array(x, np.int64) for x in opened])
                yield record(wanted, part.column("query_id").take(own), part.column("vector").take(own), leaves)

    reached = written(asked.mapInArrow(traverse, "query_id long, vector array<double>, leaf long"), "ann-visits")
    sizes = index.groupBy("leaf").agg(F.count("*").alias("vectors"))
    asks = reached.groupBy("leaf").agg(F.count("*").alias("queries"))
    parts = sizes.join(asks, "leaf").select(
        "leaf", F.ceil(F.col("vectors") / VECTORS_A_BLOCK).alias("v_parts"), F.ceil(F.col("queries") / QUERIES_A_BLOCK).alias("q_parts")
    )

    def dealt(side: DataFrame, id_name: str, own: str, other: str) -> DataFrame:
        """Rows with their leaf's block pairs: their own block, and every block of the other side."""
        out = side.join(parts, "leaf").withColumn(own, F.pmod(F.xxhash64(id_name, "vector"), F.col(f"{own}_parts")))
        return out.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}_parts") - 1))).select(id_name, "vector", "leaf", "v", "q")

    left = dealt(reached, "query_id", "q", "v").groupBy("leaf", "v", "q")
    right = dealt(index.select("vec_id", "vector", "leaf"), "vec_id", "v", "q").groupBy("leaf", "v", "q")

    def compared(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        if not (queries.num_rows and vectors.num_rows):
            return FOUND_SCHEMA.empty_table()
        ids, rows = queries.column("query_id").to_numpy(), vectors.column("vec_id").to_numpy()
        q, r, distance = nearest_rows(_matrix(queries.column("vector")), ids, _matrix(vectors.column("vector")), rows, k)
        return pa.table([ids[q], rows[r], distance], schema=FOUND_SCHEMA)

    found = left.cogroup(right).applyInArrow(compared, FOUND)
    return ranked(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _enough(tree: Tree, query: np.ndarray, visits: int, crowds: np.ndarray, k: int) -> list[int]:
    """The leaves that a query opens: ``visits`` of them, and on until they hold more than k vectors."""
    leaves = tree.visits(query, visits)
    while crowds[leaves].sum() <= k and len(leaves) < tree.leaves:
        visits = min(tree.leaves, 2 * visits)
        leaves = tree.visits(query, visits)
    return leaves


def calibrated(index: DataFrame, asked: DataFrame, tree: Tree, k: int, recall: float, calibration: int) -> int:
    """The number of leaves to visit so that the calibration queries find ``recall`` of their exact neighbours."""
    chosen = asked.orderBy(F.xxhash64(F.lit("calibration"), "query_id"), "query_id").limit(calibration).toArrow()
    if not chosen.num_rows:
        return 1
    ids, queries = chosen.column("query_id").to_numpy(), _matrix(chosen.column("vector"))
    true = brute_force(index, ids, queries, k)
    pairs = true.join(index.select("vec_id", "leaf"), "vec_id").select("query_id", "leaf").toArrow()  # k rows a query
    order = {int(i): tree.visits(q, tree.leaves) for i, q in zip(ids, queries)}
    rank = [order[q].index(leaf) for q, leaf in zip(pairs.column("query_id").to_pylist(), pairs.column("leaf").to_pylist())]
    visits = 1
    while visits < tree.leaves and rank and np.mean(np.array(rank) < visits) < recall:
        visits += max(1, visits // 16)
    return min(visits, tree.leaves)
