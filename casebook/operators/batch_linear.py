"""Many linear models in one pass: every job evaluates all models that are still open.

A model minimises the mean loss of its rows and columns plus penalties. A job returns, for each open model at its
trial point, the sums of loss, gradient and curvature; the driver takes a Newton step (by coordinates under an
absolute penalty) and drops models whose slope is gone. Where the objective rose, the next job sums the losses of
several halvings of the step at once. The hinge loss is rounded off over a width that shrinks whenever the rounded
problem is solved. Steps are solved per unit of each column, so that their number does not grow with the cases when
columns are divided by their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from casebook.operators.blocks import Block, Blocks, uniform

#: Share of cases on which a margin is calibrated, and numbers a job sums at once.
CALIBRATION_SHARE, CELLS = 1 / 3, 4_000_000
#: Widths over which the hinge is rounded, one after the other.
WIDTHS = (4.0, 0.5, 0.05)
#: Halvings of a step that a job tries together.
HALVINGS = 10


@dataclass(frozen=True)
class Task:
    """One model: ``l1`` and ``l2`` weigh the sum of absolute and of half squared coefficients against the summed loss.

    ``third`` 0 takes the cases that calibrate, 1 the others, None all. With ``through`` (coefficients and
    intercept) the model sees one column, that linear score.
    """

    columns: tuple[int, ...]
    rows: int
    hinge: bool = False
    l1: float = 0.0
    l2: float = 0.0
    third: int | None = None
    through: tuple[float, ...] | None = None
    start: tuple[float, ...] | None = None  # coefficients and intercept near the solution
    tol: float = 1e-6
    max_iter: int = 200

    @property
    def width(self) -> int:
        return 2 if self.through else len(self.columns) + 1

    def design(self, x: np.ndarray) -> np.ndarray:
        """The columns and a last one of ones."""
        x = x[:, self.columns]
        if self.through:
            x = (x @ np.array(self.through[:-1]) + self.through[-1])[:, None]
        return np.column_stack((x, np.ones(len(x))))


def _loss(z: np.ndarray, width: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, slope and curvature at signed margins ``z``: logistic without a width, else a rounded hinge."""
    if width is None:
        e = np.exp(-np.abs(z))
        p = np.where(z >= 0, e, 1.0) / (1.0 + e)  # chance of the other class
        return np.log1p(e) + np.maximum(-z, 0), -p, p * (1 - p)
    short = 1 - z
    inside = (short > 0) & (short < width)
    loss = np.where(inside, short * short / (2 * width), np.maximum(short - width / 2, 0))
    return np.where(short <= 0, 0, loss), np.where(inside, -short / width, np.where(short > 0, -1.0, 0.0)), inside / width


def _evaluate(blocks: Blocks, work: list[tuple[int, Task, np.ndarray, float | None]]) -> dict[int, np.ndarray]:
    """(cases, loss, gradient, squares of the columns, curvature) summed for every (id, task, coefficients, width).

    Where the coefficients are a table of points, one a column, only the cases and the loss at each point.
    """

    def total(each: Iterator[Block]) -> dict[int, np.ndarray]:
        out = {i: np.zeros(1 + at.shape[1] if at.ndim > 1 else 2 + 2 * t.width + t.width**2) for i, t, at, _ in work}
        for block in each:
            chosen: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
            for i, task, at, width in work:
                rows = (task.rows, task.third)
                if rows not in chosen:
                    mask = block.taken(task.rows)
                    if task.third is not None:
                        mask = mask & ((uniform(block.key, 0) >= CALIBRATION_SHARE) == bool(task.third))
                    chosen[rows] = block.x[mask], np.where(block.y[mask] == 1, 1.0, -1.0)
                x, sign = chosen[rows]
                if not len(x):
                    continue
                design = task.design(x)
                cell, k = out[i], task.width
                cell[0] += len(x)
                if at.ndim > 1:
                    cell[1:] += _loss((design @ at) * sign[:, None], width)[0].sum(axis=0)
                    continue
                loss, slope, curve = _loss((design @ at) * sign, width)
                cell[1] += loss.sum()
                cell[2 : 2 + k] += design.T @ (slope * sign)
                cell[2 + k : 2 + 2 * k] += (design * design).sum(axis=0)
                cell[2 + 2 * k :] += ((design * curve[:, None]).T @ design).ravel()
        return out

    return blocks.sums(total)


class _Descent:
    """The state of one model between jobs."""

    def __init__(self, task: Task):
        self.task = task
        self.at = self.trial = np.zeros(task.width) if task.start is None else np.array(task.start)
        self.widths = (WIDTHS if task.start is None else WIDTHS[-1:]) if task.hinge else (None,)
        self.value: float | None = None
        self.step, self.scale, self.fall = np.zeros(task.width), 1.0, 0.0
        self.shorter: np.ndarray | None = None  # scales of the step that the next job compares
        self.steps, self.open, self.converged = 0, True, False

    def wanted(self) -> np.ndarray:
        """The trial point, or a table of points on the way to it."""
        return self.trial if self.shorter is None else self.at[:, None] + self.step[:, None] * self.shorter

    def _fell(self, value, scale):
        return value <= self.value + 1e-4 * scale * self.fall + 1e-12 * abs(self.value)

    def _halve(self, scale: float) -> None:
        self.shorter = scale * 0.5 ** np.arange(1, HALVINGS + 1)
        self.open = bool(self.shorter[0] > 1e-9)

    def take(self, cell: np.ndarray) -> None:
        task, k = self.task, self.task.width
        n = max(cell[0], 1.0)
        ridge, lasso = np.full(k, task.l2 / n), np.full(k, task.l1 / n)
        ridge[-1] = lasso[-1] = 0.0  # the intercept is free
        w = self.wanted()
        if self.shorter is not None:
            scales, self.shorter = self.shorter, None
            fell = self._fell(cell[1:] / n + 0.5 * ridge @ (w * w) + lasso @ np.abs(w), scales)
            if fell.any():
                self.scale, self.trial = float(scales[fell.argmax()]), w[:, fell.argmax()]
            else:
                self._halve(float(scales[-1]))
            return
        value = cell[1] / n + 0.5 * ridge @ (w * w) + lasso @ np.abs(w)
        if self.value is None and not np.isfinite(value):
            raise ValueError("a column holds a null or infinite value")
        if self.value is not None and not self._fell(value, self.scale):
            self._halve(self.scale)
            return
        self.at, self.value = w, value
        slope = cell[2 : 2 + k] / n + ridge * w
        curve = cell[2 + 2 * k :].reshape(k, k) / n + np.diag(ridge)
        pull = np.where(w != 0, np.abs(slope + lasso * np.sign(w)), np.maximum(np.abs(slope) - lasso, 0))
        size = np.sqrt(cell[2 + k : 2 + 2 * k] / n)  # slopes are judged per unit of their column
        if (pull <= task.tol * size + 1e-15).all():
            if len(self.widths) == 1:
                self.open, self.converged = False, True
            else:
                self.widths, self.value = self.widths[1:], None
            return
        self.steps += 1
        if self.steps > task.max_iter:
            self.open = False
            return
        unit = np.where(size > 0, size, 1.0)
        curve = curve / np.outer(unit, unit)
        curve = curve + np.diag(1e-9 * np.diag(curve) + 1e-7 * np.diag(curve).max(initial=0) + 1e-12)
        if task.l1:
            self.step = _by_coordinates(slope / unit, curve, w * unit, lasso / unit) / unit
        else:
            self.step = -np.linalg.lstsq(curve, slope / unit, rcond=None)[0] / unit
        self.fall = float(slope @ self.step + lasso @ (np.abs(w + self.step) - np.abs(w)))
        self.scale, self.trial = 1.0, w + self.step


def _by_coordinates(slope: np.ndarray, curve: np.ndarray, w: np.ndarray, lasso: np.ndarray, sweeps=500) -> np.ndarray:
    """The step that minimises the quadratic model plus the absolute penalty."""
    step, moved = np.zeros_like(w), curve @ np.zeros_like(w)
    for _ in range(sweeps):
        largest = 0.0
        for j in range(len(w)):
            c = max(curve[j, j], 1e-12)
            target = w[j] + step[j] - (slope[j] + moved[j]) / c
            new = np.sign(target) * max(abs(target) - lasso[j] / c, 0.0) - w[j]
            if new != step[j]:
                largest = max(largest, abs(new - step[j]) * np.sqrt(c))
                moved = moved + curve[:, j] * (new - step[j])
                step[j] = new
        if largest < 1e-12:
            break
    return step


@dataclass(frozen=True)
class Fit:
    coef: tuple[float, ...]
    intercept: float
    converged: bool


def solve(blocks: Blocks, tasks: list[Task], cells: int = CELLS) -> list[Fit]:
    """Fit all tasks; equal ones share their work."""
    distinct = list(dict.fromkeys(tasks))
    models = [_Descent(t) for t in distinct]
    while any(m.open for m in models):
        work, size = [], 0
        for i, m in enumerate(models):
            if m.open and size <= cells:
                work.append((i, m.task, m.wanted(), m.widths[0]))
                size += m.task.width**2
        for i, cell in _evaluate(blocks, work).items():
            models[i].take(cell)
    fits = {t: Fit(tuple(m.at[:-1].tolist()), float(m.at[-1]), m.converged) for t, m in zip(distinct, models)}
    return [fits[t] for t in tasks]
