"""Many trees at once, on values that are binned once.

Splits of all nodes of one level come from one aggregate of (model, node, column, bin, class) sums. As soon as a
node holds few enough cases, they are sent to one task, which grows the rest of that tree; for small tables that is
the whole tree, and trees that use the same cases travel together. Boosted one-split trees of any number of
models share one weighted histogram a round.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.operators.blocks import SCHEMA, Block, Blocks, Steps, unpacked
from casebook.session import kept, opened, shared_folder

#: Bins of a column, cases that one task grows a subtree from, and trees that travel together.
BINS, SUBTREE, TOGETHER = 1024, 400_000, 16
#: Tasks a core that sum a level, and the mark of a node to be asked again.
TASKS_A_CORE, MORE = 3, -2
#: A node: column (-1 for a leaf), last bin on the left, children, the value between the bins, share of class 1 (of leaves).
NODE = np.dtype([("column", "<i4"), ("bin", "<i4"), ("left", "<i4"), ("right", "<i4"), ("cut", "<f8"), ("share", "<f8")])
#: Cumulative chances of a Poisson draw of mean one.
_POISSON = Steps(np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)]))


@dataclass(frozen=True)
class TreeTask:
    """One tree: ``draw`` weighs cases by Poisson draws of the seed, ``tried`` columns are looked at in a node."""

    columns: tuple[int, ...]
    rows: int
    seed: int = 0
    draw: bool = False
    tried: int | None = None
    depth: int = 30
    criterion: str = "gini"

    def weights(self, block: Block) -> np.ndarray:
        return block.taken(self.rows) * self.draws(block.key)

    def drawn(self, block: Block, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of some cases of a block have weight, and their weights."""
        some = some[block.taken(self.rows)[some]]
        w = self.draws(block.key[some])
        return some[w > 0], w[w > 0]

    def of(self, block: Block) -> np.ndarray:
        """The columns of the task."""
        return block.x if self.columns == tuple(range(block.x.shape[1])) else block.x[:, self.columns]

    def draws(self, key: np.ndarray) -> np.ndarray:
        if not self.draw:
            return np.ones(len(key))
        return _POISSON.drawn(key, self.seed + 1).astype(float)

    def order(self, node: int) -> list[int]:
        """Columns in the order in which a node looks at them."""
        if self.tried is None:
            return list(range(len(self.columns)))
        return np.random.default_rng([self.seed, node % 2**63]).permutation(len(self.columns)).tolist()


@dataclass(frozen=True)
class Tree:
    """Nodes in a row: column (-1 for a leaf), last bin on the left, children, share of class 1 (of leaves)."""

    column: tuple[int, ...]
    bin: tuple[int, ...]
    left: tuple[int, ...]
    right: tuple[int, ...]
    share: tuple[float, ...]


@dataclass(frozen=True)
class StoredTree:
    """The top of a tree, a field of ``NODE`` each; a leaf with a ``left`` goes on in that part (file, first byte, bytes)."""

    column: tuple[int, ...]
    bin: tuple[int, ...]
    left: tuple[int, ...]
    right: tuple[int, ...]
    cut: tuple[float, ...]
    share: tuple[float, ...]
    parts: tuple[tuple[str, int, int], ...]

    def whole(self, folder: str) -> Tree:
        """All nodes, a node before those below it and the left before the right."""
        below = [read_nodes(folder, p) for p in self.parts]
        cells: list[list] = [[], [], [], [], []]
        top = np.array(list(zip(self.column, self.bin, self.left, self.right, self.cut, self.share)), NODE)
        open_ = [(top, 0, None)]
        while open_:
            nodes, k, parent = open_.pop()
            if nodes is top and top["column"][k] < 0 and top["left"][k] >= 0:
                nodes, k = below[top["left"][k]], 0
            at = len(cells[0])
            if parent is not None:
                cells[parent[0]][parent[1]] = at
            n = nodes[k]
            for cell, v in zip(cells, (n["column"].item(), n["bin"].item(), -1, -1, n["share"].item())):
                cell.append(v)
            if n["column"] >= 0:
                open_ += [(nodes, int(n["right"]), (3, at)), (nodes, int(n["left"]), (2, at))]
        return Tree(*map(tuple, cells))


def _summary(values: np.ndarray, weights: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values with their weights, thinned to ``size`` evenly spaced by weight if there are more."""
    values, place = np.unique(values, return_inverse=True)
    weights = np.bincount(place, weights, len(values))
    if len(values) <= size:
        return values, weights
    past = np.cumsum(weights)
    kept_ = np.unique(np.searchsorted(past, np.linspace(past[0], past[-1], size), side="left"))
    return values[kept_], np.diff(past[kept_], prepend=0.0)


def column_cuts(blocks: Blocks, bins: int = BINS) -> list[np.ndarray]:
    """Thresholds of every column, half way between its quantiles: all of them if it has at most ``bins`` values.

    Every task keeps a summary of eight times as many values for each column, in one pass; a column's summaries
    are merged in one task.
    """
    size, width = 8 * bins, len(blocks.columns)

    def summaries(each: Iterator[Block]) -> Iterator[tuple[int, bytes]]:
        kept_ = [(np.zeros(0), np.zeros(0))] * width
        for block in each:
            for i, (v, w) in enumerate(kept_):
                kept_[i] = _summary(np.concatenate((v, block.x[:, i])), np.concatenate((w, np.ones(len(block.x)))), size)
        return ((i, np.concatenate(k).tobytes()) for i, k in enumerate(kept_))

    def cuts(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        pairs = [np.frombuffer(v.as_py()).reshape(2, -1) for v in rows.column("v")]
        v, w = _summary(*np.concatenate(pairs, axis=1), size)
        if len(v) > bins:
            v, _ = _summary(v, w, bins)
        return pa.table({"id": pa.array([key[0].as_py()], pa.int64()), "v": pa.array([((v[1:] + v[:-1]) / 2).tobytes()], pa.binary())})

    found = blocks.each(summaries).groupBy("id").applyInArrow(cuts, "id long, v binary").collect()
    by = {r.id: np.frombuffer(r.v) for r in found}
    return [by.get(i, np.zeros(0)) for i in range(width)]


@dataclass(frozen=True)
class Binned:
    blocks: Blocks  # x holds bin numbers, two bytes each
    cuts: list[np.ndarray]

    def release(self) -> None:
        self.blocks.release()

    def each(self, task, schema: str, most: int | None = None) -> DataFrame:
        """Rows that ``task`` yields for the blocks of every partition, of which there are at most ``most`` a core."""
        width, data = len(self.cuts), self.blocks.data
        data = data if most is None else data.coalesce(most * data.sparkSession.sparkContext.defaultParallelism)
        return data.mapInArrow(lambda batches: task(unpacked(batches, width, np.uint16)), schema)


def binned(blocks: Blocks, bins: int = BINS) -> Binned:
    cuts = column_cuts(blocks, bins)
    width = len(cuts)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for (x,) in zip(batch.column("x").to_pylist()):
                x = np.frombuffer(x).reshape(-1, width)
                cells.append(np.column_stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(cuts)]).astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.binary()), *batch.columns[1:]], ["x", "y", "part", "key"])

    return Binned(replace(blocks, data=kept(blocks.data.mapInArrow(code, SCHEMA))), cuts)


def _impurity(ones: np.ndarray, all_: np.ndarray, criterion: str) -> np.ndarray:
    """Impurity times weight of nodes with ``ones`` of class 1 in ``all_``."""
    with np.errstate(divide="ignore", invalid="ignore"):
        p = np.where(all_ > 0, ones / all_, 0.0)
        if criterion == "gini":
            return 2 * all_ * p * (1 - p)
        terms = [np.where(q > 0, q * np.log2(np.where(q > 0, q, 1.0)), 0.0) for q in (p, 1 - p)]
        return -all_ * (terms[0] + terms[1])


def _best_of(ones: np.ndarray, all_: np.ndarray, criterion: str) -> tuple[float, int] | None:
    """Least impurity and bin from the class-1 and total weights by bin; None if all cases share a bin."""
    left, left_ones = np.cumsum(all_)[:-1], np.cumsum(ones)[:-1]
    total, total_ones = all_.sum(), ones.sum()
    fits = np.flatnonzero((all_[:-1] > 0) & (left > 0) & (left < total))
    if not len(fits):
        return None
    cost = _impurity(left_ones[fits], left[fits], criterion) + _impurity(total_ones - left_ones[fits], total - left[fits], criterion)
    i = int(np.argmin(cost))
    return float(cost[i]), int(fits[i])


def _choose(order: list[int], tried: int | None, best) -> tuple[int, int] | None:
    """The best (column, bin) of the first ``tried`` columns, or of the first later one that can be split."""
    found, tried = None, len(order) if tried is None else tried
    for k, j in enumerate(order):
        if k >= tried and found is not None:
            break
        own = best(j)
        if own is not None and (found is None or own[0] < found[0] - 1e-12):
            found = (own[0], j, own[1])
    return None if found is None else found[1:]


def _splits(x: np.ndarray, w: np.ndarray, wy: np.ndarray, starts: np.ndarray, criterion: str) -> tuple[np.ndarray, np.ndarray]:
    """For every node the least impurity and the last bin on the left, infinite for a column of one bin.

    Cases lie node by node, from ``starts`` on; ``x`` is the bin of each in the column its node looks at.
    """
    sizes = np.diff(starts, append=len(x))
    node = np.repeat(np.arange(len(starts)), sizes)
    if len(starts) <= 1 << 16:  # two sorts of short numbers, which take no comparisons
        order = np.argsort(x, kind="stable")
        order = order[np.argsort(node.astype(np.uint16)[order], kind="stable")]
    else:
        order = np.argsort((node << 16) + x, kind="stable")
    v = x[order]
    past, ones = np.cumsum(w[order]), np.cumsum(wy[order])
    ends = starts + sizes - 1
    before = lambda c: np.r_[0.0, c[ends[:-1]]]  # weights are whole, so differences of sums are exact
    past_before, ones_before = before(past), before(ones)
    at = np.flatnonzero((node[1:] == node[:-1]) & (v[1:] != v[:-1]))
    cost, bin_ = np.full(len(starts), np.inf), np.zeros(len(starts), np.int64)
    if len(at):
        own = node[at]
        left, left_ones = past[at] - past_before[own], ones[at] - ones_before[own]
        total, total_ones = (past[ends] - past_before)[own], (ones[ends] - ones_before)[own]
        all_ = _impurity(left_ones, left, criterion) + _impurity(total_ones - left_ones, total - left, criterion)
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        least = np.minimum.reduceat(all_, first)
        hits = np.flatnonzero(all_ == np.repeat(least, np.diff(first, append=len(own))))
        hits = hits[np.r_[True, own[hits][1:] != own[hits][:-1]]]
        cost[own[first]], bin_[own[first]] = least, v[at[hits]]
    return cost, bin_


def _best_splits(x: np.ndarray, rows: np.ndarray, w: np.ndarray, wy: np.ndarray, starts: np.ndarray, order: np.ndarray, task: TreeTask) -> tuple[np.ndarray, np.ndarray]:
    """(column or -1, last bin on the left) of every node, as ``_choose`` finds them."""
    count = len(starts)
    sizes = np.diff(starts, append=len(rows))
    column, bin_, least = np.full(count, -1), np.zeros(count, np.int64), np.full(count, np.inf)
    tried = order.shape[1] if task.tried is None else task.tried
    for k in range(order.shape[1]):
        some = np.arange(count) if k < tried else np.flatnonzero(column < 0)
        if not len(some):
            break
        if len(some) < count:
            asked = np.zeros(count, bool)
            asked[some] = True
            at = np.flatnonzero(np.repeat(asked, sizes))
        else:
            at = slice(None)
        own, looked = sizes[some], order[some, k]
        cost, found = _splits(x[rows[at], np.repeat(looked, own)], w[rows[at]], wy[rows[at]], np.cumsum(own) - own, task.criterion)
        better = np.isfinite(cost) & ((column[some] < 0) | (cost < least[some] - 1e-12))
        column[some[better]], bin_[some[better]], least[some[better]] = looked[better], found[better], cost[better]
    return column, bin_


def grown(x: np.ndarray, y: np.ndarray, w: np.ndarray, task: TreeTask, node: int = 1, depth: int = 0) -> np.ndarray:
    """The nodes of a whole (sub)tree from the bins of its cases, level by level; ``x`` has the task's columns.

    All nodes of a level are split together: deep levels have as many nodes as a few cases each.
    """
    wy = w * y
    rows = np.flatnonzero(w > 0)
    names, starts = [node], np.zeros(1, np.int64)
    levels, known = [], 0
    if not len(rows):
        out = np.zeros(1, NODE)
        out["column"], out["left"], out["right"], out["share"] = -1, -1, -1, 0.5
        return out
    while names:
        sizes = np.diff(starts, append=len(rows))
        total, ones = np.add.reduceat(w[rows], starts), np.add.reduceat(wy[rows], starts)
        level = np.zeros(len(names), NODE)
        level["column"], level["left"], level["right"] = -1, -1, -1
        open_ = np.flatnonzero((ones > 0) & (ones < total)) if depth < task.depth else np.zeros(0, np.int64)
        inside = np.zeros(len(names), bool)
        inside[open_] = True
        rows, sizes = rows[np.repeat(inside, sizes)], sizes[open_]
        starts = np.cumsum(sizes) - sizes
        if len(open_):
            order = np.array([task.order(names[i]) for i in open_.tolist()])
            column, bin_ = _best_splits(x, rows, w, wy, starts, order, task)
            split = column >= 0
            rows, sizes, open_, column, bin_ = rows[np.repeat(split, sizes)], sizes[split], open_[split], column[split], bin_[split]
        level["share"] = ones / total
        children = known + len(names) + 2 * np.arange(len(open_))
        levels.append(level)
        known += len(names)
        if not len(open_):
            break
        level["column"][open_], level["bin"][open_], level["share"][open_] = column, bin_, 0.0
        level["left"][open_], level["right"][open_] = children, children + 1
        high = x[rows, np.repeat(column, sizes)] > np.repeat(bin_, sizes)
        child = 2 * np.repeat(np.arange(len(open_)), sizes) + high
        by = np.argsort(child, kind="stable")
        rows = rows[by]
        starts = np.flatnonzero(np.diff(child[by], prepend=-1))
        names = [c for i in open_.tolist() for c in (2 * names[i], 2 * names[i] + 1)]
        depth += 1
    return np.concatenate(levels)


def descended(nodes, limit, x: np.ndarray) -> np.ndarray:
    """The leaf of every case: ``nodes`` has column, left and right, a case goes left up to ``limit``."""
    at, open_ = np.zeros(len(x), np.int64), np.arange(len(x))
    column, left, right, limit = (np.ascontiguousarray(c) for c in (nodes["column"], nodes["left"], nodes["right"], limit))
    own = at
    while len(open_):
        inner = np.flatnonzero(column[own] >= 0)
        open_, own = open_[inner], own[inner]
        own = np.where(x[open_, column[own]] <= limit[own], left[own], right[own])
        at[open_] = own
    return at


def _leading_to(nodes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The nodes with a leaf in place of every node that none of the wanted ones lies below, so that descents end there."""
    kept_, out = np.array(wanted), nodes.copy()
    for k in range(len(nodes) - 1, -1, -1):  # a node stands before those below it
        if nodes["column"][k] >= 0:
            kept_[k] = kept_[nodes["left"][k]] or kept_[nodes["right"][k]]
            if not kept_[k]:
                out["column"][k] = -1
    return out


class _Partial:
    """A tree of which only the top is known: splits and leaves by node number (children of n: 2 n and 2 n + 1)."""

    def __init__(self):
        self.split: dict[int, tuple[int, int]] = {}
        self.share: dict[int, float] = {}
        self.part: dict[int, tuple[str, int, int]] = {}

    def top(self) -> tuple[np.ndarray, np.ndarray]:
        """The known nodes, and their numbers."""
        nodes, numbers = [], []
        open_ = [(1, None)]
        while open_:
            node, parent = open_.pop()
            at = len(nodes)
            if parent is not None:
                nodes[parent[1]][parent[0]] = at
            j, b = self.split.get(node, (-1, 0))
            nodes.append([j, b, -1, -1, 0.0, self.share.get(node, 0.0)])
            numbers.append(node)
            if j >= 0:
                open_ += [(2 * node + 1, (3, at)), (2 * node, (2, at))]
        return np.array([tuple(n) for n in nodes], NODE), np.array(numbers, object)

    def stored(self, cuts: list[np.ndarray]) -> StoredTree:
        nodes, numbers = self.top()
        parts = []
        for at, node in enumerate(numbers):
            if nodes["column"][at] >= 0:
                nodes["cut"][at] = cuts[nodes["column"][at]][nodes["bin"][at]]
            elif node in self.part:
                nodes["left"][at] = len(parts)
                parts.append(self.part[node])
        return StoredTree(*(tuple(nodes[c].tolist()) for c in NODE.names), tuple(parts))


def read_nodes(folder: str, part: tuple[str, int, int]) -> np.ndarray:
    file, first, size = part
    with opened(f"{folder}/{file}") as stream:
        stream.seek(first)
        data = stream.read(size)
    if len(data) != size:
        raise OSError(f"{file} ends before its tree")
    return np.frombuffer(data, NODE)


def trees(data: Binned, tasks: list[TreeTask], subtree: int = SUBTREE, together: int = TOGETHER) -> list[Tree]:
    """Fit all tasks and fetch the trees whole, for a few small ones; equal tasks are fitted once."""
    folder, stored = stored_trees(data, tasks, subtree, together)
    return [t.whole(folder) for t in stored]


def stored_trees(
    data: Binned, tasks: list[TreeTask], subtree: int = SUBTREE, together: int = TOGETHER
) -> tuple[str, list[StoredTree]]:
    """Fit all tasks: a shared folder with the subtrees, and the top of every tree. Equal tasks are fitted once."""
    distinct = list(dict.fromkeys(tasks))
    folder = shared_folder(data.blocks.wide.sparkSession, "trees")
    counts = _case_counts(data, sorted({t.rows for t in distinct}))
    partial = [_Partial() for _ in distinct]
    large = {(i, 1, False): 0 for i, t in enumerate(distinct) if counts[t.rows] > subtree}
    small = [(i, 1, 0) for i, t in enumerate(distinct) if counts[t.rows] <= subtree]
    while large:
        nodes, large = large, {}
        for i, node, every, j, b, sizes, share in _level(data, distinct, partial, list(nodes)):
            depth = nodes[i, node, every]
            if j == MORE and depth < distinct[i].depth:
                large[i, node, True] = depth
                continue
            if j < 0 or depth >= distinct[i].depth:
                partial[i].share[node] = share
                continue
            partial[i].split[node] = (j, b)
            for child, size in zip((2 * node, 2 * node + 1), sizes):
                if size > subtree:
                    large[i, child, False] = depth + 1
                else:
                    small.append((i, child, depth + 1))
    _finish(data, distinct, partial, small, together, folder)
    done = {t: p.stored([data.cuts[c] for c in t.columns]) for t, p in zip(distinct, partial)}
    return folder, [done[t] for t in tasks]


def _case_counts(data: Binned, rows: list[int]) -> dict[int, int]:
    names = [f"n{i}" for i in range(len(rows))]

    def count(blocks: Iterator[Block]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(rows))
        for b in blocks:
            total += [b.taken(r).sum() for r in rows]
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in total], names)

    got = data.each(count, ", ".join(f"{n} double" for n in names)).agg(*[F.sum(n).alias(n) for n in names]).head()
    return {r: int(got[n] or 0) for r, n in zip(rows, names)}


def _larger(blocks: Iterator[Block], rows: int = 65_536) -> Iterator[Block]:
    """The same cases in blocks of about ``rows``."""
    own: list[Block] = []
    for block in blocks:
        own.append(block)
        if sum(len(b.y) for b in own) >= rows:
            yield _joined(own)
            own = []
    if own:
        yield _joined(own)


def _joined(blocks: list[Block]) -> Block:
    return Block(*(np.concatenate([getattr(b, c) for b in blocks]) for c in ("x", "y", "part", "key")))


def _level(data: Binned, tasks: list[TreeTask], partial: list[_Partial], nodes: list[tuple[int, int, bool]]):
    """(task, node, every, column or -1, bin, cases of both children by weight, share) of the given nodes, from one aggregate.

    A node sums the columns it tries first; if none of them can be split, its column is ``MORE`` and it is to be asked
    again with ``every`` column. Tasks are no more than a few a core, because each sends its sums of every node.
    """
    bins = max(len(c) for c in data.cuts) + 1
    by_task: dict[tuple[int, bool], list[int]] = {}
    for i, node, every in nodes:
        by_task.setdefault((i, every), []).append(node)
    looked = lambda i, node, every: tasks[i].order(node)[: None if every else tasks[i].tried]
    plans = {}
    for (i, every), own in by_task.items():
        top, numbers = partial[i].top()
        slots = {n: k for k, n in enumerate(own)}
        of = np.array([slots.get(n, -1) for n in numbers])
        plans[i, every] = _leading_to(top, of >= 0), of, np.array([looked(i, n, every) for n in own])

    def histograms(blocks: Iterator[Block]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros((own.shape[1], len(own), 2, bins)) for k, (_, _, own) in plans.items()}
        for block in _larger(blocks):
            y = block.y == 1
            for (i, every), (top, slots, columns) in plans.items():
                x = tasks[i].of(block)
                slot = slots[descended(top, top["bin"], x)]
                mine, w = tasks[i].drawn(block, np.flatnonzero(slot >= 0))
                slot, cell = slot[mine], total[i, every]
                base = (2 * slot + y[mine]) * bins
                for k in range(columns.shape[1]):
                    cell[k] += np.bincount(base + x[mine, columns[slot, k]], w, cell[k].size).reshape(cell[k].shape)
        for (i, every), cell in total.items():
            for k, node in enumerate(by_task[i, every]):
                own = cell[:, k]
                if own.any():
                    v = own.astype("<u4").tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([str(node)]), pa.array([every]), pa.array([v])], ["task", "node", "every", "v"])

    def chosen(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        i, node, every = key[0].as_py(), int(key[1].as_py()), key[2].as_py()
        task, order = tasks[i], looked(i, node, every)
        cell = sum(np.frombuffer(v.as_py(), "<u4").astype(float) for v in rows.column("v")).reshape(len(order), 2, bins)
        all_, ones_ = dict(zip(order, cell.sum(axis=1))), dict(zip(order, cell[:, 1]))
        total, ones = cell[0].sum(), cell[0, 1].sum()
        j, b, low = -1, 0, 0.0
        if 0 < ones < total:
            split = _choose(order, task.tried, lambda j: _best_of(ones_[j], all_[j], task.criterion))
            if split is not None:
                j, b = split
                low = all_[j][: b + 1].sum()
            elif len(order) < len(task.columns):
                j = MORE
        out = {"task": [i], "node": [str(node)], "every": [every], "j": [j], "b": [b], "low": [int(low)], "high": [int(total - low)], "share": [ones / total]}
        return pa.table(out)

    schema = "task long, node string, every boolean, j long, b long, low long, high long, share double"
    sums = data.each(histograms, "task long, node string, every boolean, v binary", most=TASKS_A_CORE)
    rows = sums.groupBy("task", "node", "every").applyInArrow(chosen, schema).collect()
    return [(r.task, int(r.node), r.every, r.j, r.b, (r.low, r.high), r.share) for r in rows]


def _finish(data: Binned, tasks: list[TreeTask], partial: list[_Partial], small: list[tuple[int, int, int]], together: int, folder: str) -> None:
    """Send the cases of small nodes to one task each, which grows what is left there and stores it; only its place returns.

    Whole trees of the same cases share a task and draw there; below a top, cases travel with the tree's columns and their draw.
    """
    groups: list[list[tuple[int, int, int]]] = [[s] for s in small if s[1] != 1]
    number = {(s[0], s[1]): g for g, (s,) in enumerate(groups)}
    roots: dict[int, list[tuple[int, int, int]]] = {}
    for s in small:
        if s[1] == 1:
            roots.setdefault(tasks[s[0]].rows, []).append(s)
    first_root = len(groups)
    for own in roots.values():
        groups += [own[a : a + together] for a in range(0, len(own), together)]
    if not groups:
        return
    plans = {}
    for i in {i for i, _ in number}:
        top, numbers = partial[i].top()
        of = np.array([number.get((i, n), -1) for n in numbers])
        plans[i] = _leading_to(top, of >= 0), of
    sets = [(g, tasks[groups[g][0][0]].rows) for g in range(first_root, len(groups))]

    def send(blocks: Iterator[Block]) -> Iterator[pa.RecordBatch]:
        for block in _larger(blocks):
            for i, (top, of) in plans.items():
                x = tasks[i].of(block)
                group = of[descended(top, top["bin"], x)]
                mine, w = tasks[i].drawn(block, np.flatnonzero(group >= 0))
                by = np.argsort(group[mine], kind="stable")
                mine, w = mine[by], w[by]
                ends = np.flatnonzero(np.diff(group[mine], append=-1)) + 1
                spans = [slice(a, b) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
                pieces = [mine[s] for s in spans]
                if pieces:
                    cells = [[x[m].tobytes() for m in pieces], [block.y[m].astype(np.int8).tobytes() for m in pieces], [w[s].astype(np.uint8).tobytes() for s in spans]]
                    yield pa.RecordBatch.from_arrays([pa.array([int(group[m[0]]) for m in pieces], pa.int64()), *[pa.array(c, pa.binary()) for c in cells]], ["g", "x", "y", "w"])
            for g, rows in sets:
                mine = block.taken(rows)
                if mine.any():
                    cells = (block.x[mine], block.y[mine].astype(np.int8), block.key[mine])
                    yield pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), *[pa.array([c.tobytes()], pa.binary()) for c in cells]], ["g", "x", "y", "w"])

    width, cuts = len(data.cuts), data.cuts

    def grow(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        g = key[0].as_py()
        members = groups[g]
        below = g < first_root
        joined = lambda c, dtype: np.frombuffer(b"".join(rows.column(c).to_pylist()), dtype)
        x = joined("x", np.uint16).reshape(-1, len(tasks[members[0][0]].columns) if below else width)
        y = joined("y", np.int8)
        drawn = joined("w", np.uint8 if below else np.int64)
        # Equal cases are one with their weights together: the same tree, whatever the order of arrival.
        order = np.lexsort((y, *x.T))
        x, y, drawn = x[order], y[order].astype(float), drawn[order]
        first = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]).any(axis=1) | (y[1:] != y[:-1]))))
        out, at, file = [], 0, f"{uuid.uuid4().hex}.bin"
        with opened(f"{folder}/{file}", write=True) as stream:
            for i, node, depth in members:
                task = tasks[i]
                w = drawn.astype(float) if below else task.draws(drawn)
                own = x[first] if below else x[first][:, task.columns]
                nodes = grown(own, y[first], np.add.reduceat(w, first), task, node, depth)
                for j, c in enumerate(task.columns):
                    mine = nodes["column"] == j
                    nodes["cut"][mine] = cuts[c][nodes["bin"][mine]]
                stream.write(nodes.tobytes())
                out.append({"task": i, "node": str(node), "file": file, "first": at, "size": nodes.nbytes})
                at += nodes.nbytes
        return pa.Table.from_pylist(out, _STORED)

    sent = data.each(send, "g long, x binary, y binary, w binary")
    parts = min(len(groups), 8 * sent.sparkSession.sparkContext.defaultParallelism)
    schema = "task long, node string, file string, first long, size long"
    for r in sent.repartition(max(parts, 1), "g").groupBy("g").applyInArrow(grow, schema).collect():
        partial[r.task].part[int(r.node)] = (r.file, r.first, r.size)
    for i, node, _ in small:  # a node that no drawn case reaches
        if node not in partial[i].part:
            partial[i].share[node] = 0.5


_STORED = pa.schema([("task", pa.int64()), ("node", pa.string()), ("file", pa.string()), ("first", pa.int64()), ("size", pa.int64())])


def boosted(data: Binned, tasks: list[TreeTask], rounds: list[int]) -> list[list[tuple[int, int, int, float]]]:
    """SAMME rules (column of the task, last bin on the left, vote there, weight) of every task.

    Case weights follow from the rules so far, so only rules are carried from round to round. A model ends when no
    split is better than a constant, or when one makes no error.
    """
    bins = max(len(c) for c in data.cuts) + 1
    rules: list[list[tuple[int, int, int, float]]] = [[] for _ in tasks]
    live = set(range(len(tasks)))

    def task_sums(open_: list[int], so_far: list[list[tuple]]):
        def run(blocks: Iterator[Block]) -> Iterator[pa.RecordBatch]:
            total = {i: np.zeros((len(tasks[i].columns), bins, 2)) for i in open_}
            for block in blocks:
                truth = np.where(block.y == 1, 1, -1)
                for i in open_:
                    w = tasks[i].weights(block)
                    mine = w > 0
                    x, w, own = block.x[mine][:, tasks[i].columns], w[mine], truth[mine]
                    for j, b, low, alpha in so_far[i]:
                        w = w * np.exp(alpha * (np.where(x[:, j] <= b, low, -low) != own))
                    for j in range(x.shape[1]):
                        total[i][j, :, 0] += np.bincount(x[:, j], w, bins)
                        total[i][j, :, 1] += np.bincount(x[:, j], w * (own == 1), bins)
            for i, cell in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([cell.tobytes()])], ["id", "v"])

        return run

    def added(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        cell = sum(np.frombuffer(v.as_py()) for v in rows.column("v"))
        return pa.table({"id": pa.array([key[0].as_py()], pa.int64()), "v": pa.array([cell.tobytes()], pa.binary())})

    while live:
        sums = data.each(task_sums(sorted(live), rules), "id long, v binary").groupBy("id").applyInArrow(added, "id long, v binary")
        for r in sums.collect():
            cell = np.frombuffer(r.v).reshape(-1, bins, 2)
            found = _stump(cell, tasks[r.id].criterion)
            if found is None:
                live.discard(r.id)
                continue
            j, b, low, error = found
            rules[r.id].append((j, b, low, math.log((1 - error) / max(error, 1e-12))))
            if error <= 0 or len(rules[r.id]) >= rounds[r.id]:
                live.discard(r.id)
    return rules


def _stump(cell: np.ndarray, criterion: str) -> tuple[int, int, int, float] | None:
    """(column, bin, vote at or below, error) of the best split of weighted sums; None if both sides vote alike."""
    split = _choose(list(range(len(cell))), None, lambda j: _best_of(cell[j, :, 1], cell[j, :, 0], criterion))
    if split is None:
        return None
    j, b = split
    total, ones = cell[j, :, 0].sum(), cell[j, :, 1].sum()
    low, low_ones = cell[j, : b + 1, 0].sum(), cell[j, : b + 1, 1].sum()
    votes = [1 if 2 * a > n else -1 for a, n in ((low_ones, low), (ones - low_ones, total - low))]
    if votes[0] == votes[1]:
        return None
    wrong = low - low_ones + ones - low_ones if votes[0] == 1 else low_ones + (total - low) - (ones - low_ones)
    error = float(wrong / total)
    return None if error >= 0.5 else (j, b, votes[0], max(error, 0.0))
