"""Packing documents into token sequences of a fixed size.

A document's ids, its end id included, are cut into full pieces and a remainder. Documents are dealt
at random to groups; in each group first-fit decreasing places the remainders, and a tournament tree
over the bins' free room finds the first bin with enough of it in logarithmic time. What the emptiest
bins hold is then cut into the gaps of the others, so that a group ends with at most one open sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.llm.common import in_slices, record, whole_text
from casebook.llm.wordcodec import encoder

DOCS_A_GROUP = 512
PIECE = "doc_id long, start long, length int, doc_tokens long, part long, ids binary"
PIECES_A_BATCH = 4096
PIECES = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("doc_tokens", pa.int64()), ("part", pa.int64()), ("ids", pa.binary())]
)
PACKED = "doc_id long, start long, length int, doc_tokens long, sequence_id long, offset int, ids binary"


class Tournament:
    """Free room of bins in a complete binary tree whose inner nodes hold the larger of two children."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [room] * (2 * self.leaves)

    def first(self, size: int) -> int:
        """The first bin with room for ``size``; there is one as long as a bin a size is kept."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        return node - self.leaves

    def take(self, bin_no: int, size: int) -> None:
        room, node = self.room, bin_no + self.leaves
        room[node] -= size
        node //= 2
        while node:
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
            node //= 2


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each size (1 to ``capacity``); equal sizes go in the order given."""
    tree = Tournament(max(1, len(sizes)), capacity)
    out = np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable"):
        out[i] = tree.first(int(sizes[i]))
        tree.take(int(out[i]), int(sizes[i]))
    return out


def close_gaps(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> list[tuple[int, int, int, int]]:
    """(item, from, length, bin): the emptiest bins' items, cut to fill the room of the fullest."""
    fill = np.bincount(bins, weights=sizes, minlength=1).astype(np.int64)
    order = [int(b) for b in np.argsort(fill, kind="stable") if fill[b]]
    held: dict[int, list[int]] = {}
    for i, b in enumerate(bins):
        held.setdefault(int(b), []).append(i)
    out, low, high = [], 0, len(order) - 1
    room = capacity - fill
    moved = set()
    left_room = sum(int(room[b]) for b in order)
    while low < high:
        source = order[low]
        left_room -= int(room[source])  # the room of the bins behind the source
        if fill[source] > left_room:
            break
        left_room -= int(fill[source])
        for item in held[source]:
            at, left = 0, int(sizes[item])
            while left:
                while room[order[high]] == 0:
                    high -= 1
                target = order[high]
                n = min(left, int(room[target]))
                out.append((item, at, n, target))
                room[target] -= n
                at, left = at + n, left - n
        moved.add(source)
        low += 1
    out += [(i, 0, int(sizes[i]), int(b)) for i, b in enumerate(bins) if int(b) not in moved]
    return out


def token_pieces(docs: DataFrame, tokenizer_json: str, end_id: int, capacity: int, groups: int) -> DataFrame:
    """Rows of at most ``capacity`` ids: each document's ids and the end id, cut from its start, with a group.

    The group is a hash of the row, its task, and how many equal rows the task met before: equal rows spread over
    the groups, and a task that runs again deals them as before (whole numbers hash alike in every process).
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(vocabulary.value)
        task, seen = TaskContext.get().partitionId(), {}
        for rows, texts in in_slices(batches):
            ids = [np.append(x, np.uint32(end_id)).astype("<u4") for x in code.encode(texts)]
            part_of = []
            for h in rows.column("row").to_pylist():
                seen[h] = seen.get(h, -1) + 1
                part_of.append(hash((h, task, seen[h])) % groups)
            part_of = pa.array(part_of, pa.int64())
            cuts = [(row, at) for row, own in enumerate(ids) for at in range(0, len(own), capacity)]
            for i in range(0, len(cuts), PIECES_A_BATCH):
                part = cuts[i : i + PIECES_A_BATCH]
                row = pa.array([r for r, _ in part], pa.int64())
                own = [ids[r][at : at + capacity] for r, at in part]
                total = [len(ids[r]) for r, _ in part]
                yield record(
                    PIECES,
                    rows.column("doc_id").take(row),
                    [at for _, at in part],
                    [len(x) for x in own],
                    total,
                    part_of.take(row),
                    [x.tobytes() for x in own],
                )

    return docs.mapInArrow(cut, PIECE)


def pack(docs: DataFrame, tokenizer_json: str, end_id: int, capacity: int = 1024, docs_a_group: int = DOCS_A_GROUP) -> DataFrame:
    """Pieces of all rows' texts with the sequence and the place that each has there.

    Null texts count as empty and give one piece, the end id. Repeated rows and rows with null
    ``doc_id`` are packed like any others. An empty table gives no row. Other columns are ignored,
    whatever their names. ``ids`` are little-endian unsigned 32-bit integers; ``sequence_id`` is
    unique over all groups, and offsets in a sequence run from 0 without gaps.
    """
    groups = max(1, -(-docs.count() // docs_a_group))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    rows = rows.withColumn("row", F.xxhash64(F.lit("group"), "doc_id", "text"))

    def placed(key: tuple[pa.Scalar, ...], pieces: pa.Table) -> pa.Table:
        pieces = pieces.sort_by([("doc_id", "ascending"), ("start", "ascending")])
        length = pieces.column("length").to_numpy().astype(np.int64)
        whole = np.flatnonzero(length == capacity)
        rest = np.flatnonzero(length < capacity)
        moves = close_gaps(length[rest], first_fit_decreasing(length[rest], capacity), capacity) if len(rest) else []
        moves.sort(key=lambda x: (x[3], x[0], x[1]))
        bins = np.array([m[3] for m in moves], np.int64)
        sequence = np.concatenate([np.arange(len(whole)), len(whole) + np.searchsorted(np.unique(bins), bins)])
        item = np.concatenate([whole, rest[[m[0] for m in moves]]]).astype(np.int64)
        at = np.concatenate([np.zeros(len(whole), np.int64), np.array([m[1] for m in moves], np.int64)])
        n = np.concatenate([length[whole], np.array([m[2] for m in moves], np.int64)])
        ends = np.cumsum(n)
        opens = np.concatenate([[0], np.flatnonzero(np.diff(sequence)) + 1])
        offset = ends - n - np.repeat((ends - n)[opens], np.diff(np.append(opens, len(sequence))))
        ids, own = pieces.column("ids"), pieces.take(pa.array(item))
        return pa.table(
            [
                own.column("doc_id"),
                pa.array(own.column("start").to_numpy() + at, pa.int64()),
                pa.array(n, pa.int32()),
                own.column("doc_tokens"),
                pa.array((key[0].as_py() << 32) + sequence, pa.int64()),
                pa.array(offset, pa.int32()),
                pa.array([ids[int(i)].as_py()[4 * a : 4 * (a + k)] for i, a, k in zip(item, at, n)], pa.binary()),
            ],
            names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
        )

    return token_pieces(rows, tokenizer_json, end_id, capacity, groups).groupBy("part").applyInArrow(placed, PACKED)
