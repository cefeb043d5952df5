"""Feed-forward networks, many in one pass: a job is one epoch of all networks that are still open.

Every task takes the shared weights through its own cases in mini-batches (Adam, rectified units, log-loss). The
weights and running moments of the tasks are then averaged by their cases, so one job an epoch is enough however
large the table is; with one task this is the plain mini-batch method, and a job runs several epochs. Mini-batches follow a hash of case id and
epoch, so a lost task repeats the same steps. A network ends when its loss has not fallen by ``tol`` for
``patience`` epochs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from casebook.operators.blocks import ROWS, Block, Blocks, uniform

#: Fixed values of the solver: cases of a mini-batch, decay of the two running moments, floor of the step's divisor.
BATCH, DECAY, FLOOR = 200, (0.9, 0.999), 1e-8
#: Numbers that a job sums at once, over all networks; epochs of a job on a table that one task holds anyway.
CELLS, PASSES = 4_000_000, 20


@dataclass(frozen=True)
class NetTask:
    """One network: ``hidden`` has the width of each hidden layer (none: a logistic regression), ``alpha`` weighs half
    the squared weights (not the offsets) against the summed loss of a mini-batch, ``rate`` is the first step size."""

    columns: tuple[int, ...]
    rows: int
    hidden: tuple[int, ...] = (100,)
    alpha: float = 1e-4
    rate: float = 1e-3
    epochs: int = 200
    seed: int = 0
    tol: float = 1e-4
    patience: int = 10

    @property
    def sizes(self) -> tuple[int, ...]:
        return (len(self.columns), *self.hidden, 1)

    @property
    def width(self) -> int:
        return sum((a + 1) * b for a, b in zip(self.sizes, self.sizes[1:]))

    def start(self) -> np.ndarray:
        """Uniform weights whose spread keeps the variance of a layer's output near that of its input."""
        draw, parts = np.random.default_rng(self.seed), []
        for a, b in zip(self.sizes, self.sizes[1:]):
            bound = np.sqrt(6 / (a + b))
            parts.append(draw.uniform(-bound, bound, (a + 1) * b))
        return np.concatenate(parts)


def layers(weights: np.ndarray, sizes: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Matrix and offset of every layer, as views of the one vector."""
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:]):
        out.append((weights[at : at + a * b].reshape(a, b), weights[at + a * b : at + (a + 1) * b]))
        at += (a + 1) * b
    return out


def activations(weights: np.ndarray, sizes: tuple[int, ...], x: np.ndarray) -> list[np.ndarray]:
    """The input and the output of every layer; the last one is the log-odds."""
    seen, parts = [x], layers(weights, sizes)
    for i, (matrix, offset) in enumerate(parts):
        z = seen[-1] @ matrix + offset
        seen.append(np.maximum(z, 0) if i + 1 < len(parts) else z)
    return seen


def loss_and_gradient(weights: np.ndarray, sizes: tuple[int, ...], x: np.ndarray, y: np.ndarray, alpha: float):
    """Mean log-loss with its penalty, and the slope by every weight."""
    seen, n = activations(weights, sizes, x), len(x)
    z = seen[-1][:, 0]
    e = np.exp(-np.abs(z))
    loss = (np.log1p(e) + np.maximum(z, 0) - z * y).mean()
    back = ((np.where(z >= 0, 1.0, e) / (1 + e) - y) / n)[:, None]
    slopes = []
    for (matrix, _), before in zip(reversed(layers(weights, sizes)), reversed(seen[:-1])):
        loss += alpha / (2 * n) * (matrix * matrix).sum()
        slopes += [back.sum(axis=0), (before.T @ back + alpha / n * matrix).ravel()]
        back = (back @ matrix.T) * (before > 0)
    return loss, np.concatenate(slopes[::-1])


@dataclass
class _State:
    """Weights, running mean and square of the slope, and steps taken."""

    weights: np.ndarray
    mean: np.ndarray
    square: np.ndarray
    steps: float = 0.0

    def step(self, task: NetTask, x: np.ndarray, y: np.ndarray) -> float:
        loss, slope = loss_and_gradient(self.weights, task.sizes, x, y, task.alpha)
        a, b = DECAY
        self.steps += 1
        self.mean = a * self.mean + (1 - a) * slope
        self.square = b * self.square + (1 - b) * slope * slope
        rate = task.rate * np.sqrt(1 - b**self.steps) / (1 - a**self.steps)
        self.weights = self.weights - rate * self.mean / (np.sqrt(self.square) + FLOOR)
        return loss

    def vector(self) -> np.ndarray:
        return np.concatenate((self.weights, self.mean, self.square, [self.steps]))

    @staticmethod
    def of(vector: np.ndarray) -> "_State":
        weights, mean, square = np.split(vector[:-1], 3)
        return _State(weights, mean, square, float(vector[-1]))


def _gathered(each: Iterator[Block]) -> Iterator[Block]:
    """Small blocks laid together, so that mini-batches are not cut at every block's end."""
    held: list[Block] = []
    for block in each:
        held.append(block)
        if sum(len(b.y) for b in held) >= ROWS:
            yield _joined(held)
            held = []
    if held:
        yield _joined(held)


def _joined(parts: list[Block]) -> Block:
    return Block(*(np.concatenate([getattr(b, name) for b in parts]) for name in ("x", "y", "part", "key")))


@dataclass(frozen=True)
class _Progress:
    """Epochs run, least loss and epochs in a row that did not lower it by the tolerance."""

    epoch: int = 0
    least: float = np.inf
    idle: int = 0

    def after(self, loss: float, task: NetTask) -> "_Progress":
        idle = self.idle + 1 if loss > self.least - task.tol else 0
        return _Progress(self.epoch + 1, min(self.least, loss), idle)

    def done(self, task: NetTask) -> bool:
        return self.idle > task.patience or self.epoch >= task.epochs


def _epochs(blocks: Blocks, work: list[tuple[int, NetTask, np.ndarray, _Progress]], passes: int) -> dict[int, np.ndarray]:
    """(cases, summed loss of each pass, passes times cases, state times cases) after ``passes`` epochs of every
    network, or fewer where it ends. More than one pass is for a table that one task holds."""

    def run(each: Iterator[Block]) -> dict[int, np.ndarray]:
        states = {i: _State.of(v) for i, _, v, _ in work}
        lost, count, ran = ({i: np.zeros(passes) for i in states}, dict.fromkeys(states, 0), dict.fromkeys(states, 0))
        at_hand = _gathered(each) if passes == 1 else list(_gathered(each))
        still = work
        for k in range(passes):
            count.update((i, 0) for i, *_ in still)
            for block in at_hand:
                order: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
                for i, task, _, progress in still:
                    key = (task.rows, progress.epoch)
                    if key not in order:
                        at = np.argsort(uniform(block.key, progress.epoch), kind="stable")
                        at = at[block.taken(task.rows)[at]]
                        order[key] = block.x[at], (block.y[at] == 1).astype(float)
                    x, y = order[key]
                    if not len(x):
                        continue
                    x = x[:, task.columns]
                    for part in np.array_split(np.arange(len(x)), -(-len(x) // BATCH)):
                        lost[i][k] += states[i].step(task, x[part], y[part]) * len(part)
                    count[i] += len(x)
            onward = []
            for i, task, v, progress in still:
                ran[i] += 1
                progress = progress.after(lost[i][k] / max(count[i], 1), task)
                if count[i] and np.isfinite(lost[i][k]) and not progress.done(task):
                    onward.append((i, task, v, progress))
            still = onward
        return {i: np.concatenate(([n], lost[i], [n * ran[i]], n * states[i].vector())) for i, n in count.items() if n}

    return blocks.sums(run)


class _Training:
    """The state of one network between jobs."""

    def __init__(self, task: NetTask):
        self.task = task
        zero = np.zeros(task.width)
        self.state = _State(task.start(), zero, zero).vector()
        self.progress = _Progress()

    @property
    def open(self) -> bool:
        return not self.progress.done(self.task)

    def take(self, cell: np.ndarray | None, passes: int) -> None:
        if cell is None:
            raise ValueError(f"rows {self.task.rows} hold no case")
        n, ran = cell[0], round(cell[1 + passes] / cell[0])
        losses = cell[1 : 1 + ran] / n
        if not np.isfinite(losses).all():
            raise ValueError("a column holds a null or infinite value")
        for loss in losses.tolist():
            self.progress = self.progress.after(loss, self.task)
        self.state = cell[2 + passes :] / n


@dataclass(frozen=True)
class NetFit:
    weights: tuple[float, ...]
    sizes: tuple[int, ...]
    loss: float
    converged: bool


def train(blocks: Blocks, tasks: list[NetTask], cells: int = CELLS) -> list[NetFit]:
    """Fit all networks; equal ones share their work."""
    distinct = list(dict.fromkeys(tasks))
    nets = [_Training(t) for t in distinct]
    passes = PASSES if blocks.tasks == 1 else 1
    while any(n.open for n in nets):
        work, size = [], 0
        for i, n in enumerate(nets):
            if n.open and size <= cells:
                work.append((i, n.task, n.state, n.progress))
                size += len(n.state)
        found = _epochs(blocks, work, passes)
        for i, *_ in work:
            nets[i].take(found.get(i), passes)
    fits = {}
    for n in nets:
        settled = n.progress.idle > n.task.patience
        fits[n.task] = NetFit(tuple(n.state[: n.task.width].tolist()), n.task.sizes, float(n.progress.least), settled)
    return [fits[t] for t in tasks]
