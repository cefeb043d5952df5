"""Binary classifiers over a matrix, many of them fitted in shared passes.

``fit_many`` fits any number of requests (classifier, columns, rows, options) on one packed table: linear models
by ``batch_linear``, trees by ``batch_trees``, networks by ``batch_networks``, discriminant and Bayes models from class
moments. A single fit is a batch of one. Linear models and Gaussian Bayes become plain column expressions, so their
scores run inside code generation and on streams; trees and networks score Arrow batches.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.functions.exprs import assembled, col, sum_of
from casebook.operators.batch_linear import Fit, Task, solve
from casebook.operators.batch_networks import NetTask, activations, train
from casebook.operators.batch_trees import NODE, Binned, TreeTask, binned, boosted, descended, read_nodes, stored_trees
from casebook.operators.blocks import ALL, MAIN, Block, Blocks, table_blocks
from casebook.operators.normalize import state_table
from casebook.operators.splitting import stratified_folds
from casebook.operators.stats import per_feature
from casebook.session import kept, opened
from casebook.spec import MatrixSpec

VAR_SMOOTHING = 1e-9
#: Numbers of a chunk of cases that all models score at once.
CHUNK_CELLS = 4_000_000


def logistic_map(z: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(z))
    return np.where(z >= 0, 1.0, e) / (1.0 + e)


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def _chance_by_batch(model) -> Column:
    """The scores of a model that works on arrays of cases."""

    @F.pandas_udf("double")
    def chance(x: pd.Series) -> pd.Series:
        return pd.Series(model.chance(np.stack(x.to_numpy()).astype(float)) if len(x) else np.zeros(0))

    return chance(F.array(*[col(f).cast("double") for f in model.features]))


@dataclass(frozen=True)
class LinearScore:
    """Probability = sigmoid(scale * (intercept + coef . x) + shift)."""

    name: str
    features: tuple[str, ...]
    coef: tuple[float, ...]
    intercept: float
    scale: float = 1.0
    shift: float = 0.0
    converged: bool = True

    def chance(self, x: np.ndarray) -> np.ndarray:
        return logistic_map((x @ np.array(self.coef) + self.intercept) * self.scale + self.shift)

    def margin(self) -> Column:
        return F.lit(self.intercept) + sum_of([col(f) * F.lit(w) for f, w in zip(self.features, self.coef)])

    def predict(self, df: DataFrame, out="pred") -> DataFrame:
        return df.withColumn(out, sigmoid(self.margin() * F.lit(self.scale) + F.lit(self.shift)))

    def coefficients(self, spark) -> DataFrame:
        rows = [{"feature": f, "coef": float(w)} for f, w in zip(self.features, self.coef)]
        return state_table(spark, rows + [{"feature": "intercept", "coef": float(self.intercept)}])


@dataclass(frozen=True)
class BayesScore:
    """Gaussian naive Bayes as the logistic of the log-odds."""

    name: str
    features: tuple[str, ...]
    log_prior: float  # log P(1) - log P(0)
    mean: tuple[tuple[float, ...], tuple[float, ...]]
    var: tuple[tuple[float, ...], tuple[float, ...]]

    def chance(self, x: np.ndarray) -> np.ndarray:
        m, v = np.array(self.mean), np.array(self.var)
        logs = [((x - m[k]) ** 2 / (2 * v[k])).sum(axis=1) for k in (0, 1)]
        return logistic_map(self.log_prior + 0.5 * np.log(v[0] / v[1]).sum() + logs[0] - logs[1])

    def predict(self, df: DataFrame, out="pred") -> DataFrame:
        terms = [F.lit(self.log_prior)]
        for i, f in enumerate(self.features):
            m0, m1, v0, v1 = self.mean[0][i], self.mean[1][i], self.var[0][i], self.var[1][i]
            terms.append(
                F.lit(0.5 * math.log(v0 / v1))
                + (col(f) - m0) * (col(f) - m0) / (2 * v0)
                - (col(f) - m1) * (col(f) - m1) / (2 * v1)
            )
        return df.withColumn(out, sigmoid(sum_of(terms)))


@dataclass(frozen=True)
class BoostScore:
    """A weighted vote of one-split rules: (feature, threshold, vote at or below, weight)."""

    name: str
    features: tuple[str, ...]
    rules: tuple[tuple[str, float, int, float], ...]

    def chance(self, x: np.ndarray) -> np.ndarray:
        total = sum(r[3] for r in self.rules) or 1.0
        votes = (np.where(x[:, self.features.index(f)] <= t, low, -low) * (w / total) for f, t, low, w in self.rules)
        return logistic_map(sum(votes, np.zeros(len(x))))

    @staticmethod
    def vote(rule) -> Column:
        f, threshold, low, _ = rule
        return F.when(col(f) <= F.lit(threshold), float(low)).otherwise(float(-low))

    def predict(self, df: DataFrame, out="pred") -> DataFrame:
        total = sum(r[3] for r in self.rules) or 1.0
        decision = sum_of([self.vote(r) * F.lit(r[3] / total) for r in self.rules])
        return df.withColumn(out, sigmoid(decision))


@dataclass(frozen=True)
class ForestScore:
    """The mean class share of trees. A tree is its top, the fields of ``StoredTree`` in order; the subtrees below lie in
    files of ``folder``, and only those that cases of a chunk reach are read, one after the other."""

    name: str
    features: tuple[str, ...]
    folder: str
    trees: tuple[tuple, ...]

    def chance(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for cells in self.trees:
            *fields, parts = cells
            top = np.array(list(zip(*fields)), NODE)
            leaf = descended(top, top["cut"], x)
            part = np.where(top["left"][leaf] >= 0, top["left"][leaf], -1)
            share = top["share"][leaf]
            order = np.argsort(part, kind="stable")
            ends = np.flatnonzero(np.diff(part[order], append=-2)) + 1
            for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
                rows = order[a:b]
                if len(rows) and part[rows[0]] >= 0:
                    nodes = read_nodes(self.folder, parts[part[rows[0]]])
                    share[rows] = nodes["share"][descended(nodes, nodes["cut"], x[rows])]
            total += share
        return total / len(self.trees)

    def predict(self, df: DataFrame, out="pred") -> DataFrame:
        keep = [c for c in df.columns if c != out]
        chosen = [(tuple(range(len(self.features))), self, None)]
        return score_many(df, keep, [col(f) for f in self.features], chosen, names=("_model", out)).drop("_model")

    def copied(self, folder: str) -> "ForestScore":
        """The same model with its files in another folder, one at a time."""
        for file in sorted({p[0] for t in self.trees for p in t[-1]}):
            with opened(f"{self.folder}/{file}") as source, opened(f"{folder}/{file}", write=True) as target:
                while data := source.read(1 << 24):
                    target.write(data)
        return replace(self, folder=folder)


@dataclass(frozen=True)
class NetworkScore:
    """A feed-forward network with rectified units; ``sizes`` has the width of every layer, input and output included."""

    name: str
    features: tuple[str, ...]
    weights: tuple[float, ...]
    sizes: tuple[int, ...]
    converged: bool = True

    def chance(self, x: np.ndarray) -> np.ndarray:
        return logistic_map(activations(np.array(self.weights), tuple(self.sizes), x)[-1][:, 0])

    def predict(self, df: DataFrame, out="pred") -> DataFrame:
        return df.withColumn(out, _chance_by_batch(self))


@dataclass(frozen=True)
class TransformerScore:
    """Any fitted Spark ML classifier with a probability column."""

    name: str
    features: tuple[str, ...]
    model: Model = field(compare=False)

    def predict(self, df: DataFrame, out="pred") -> DataFrame:
        scored = self.model.transform(assembled(df, self.features, "_v"))
        drop = ["_v", "rawPrediction", "probability", "prediction"]
        return scored.withColumn(out, vector_to_array("probability")[1]).drop(*drop)


def _training(df: DataFrame, spec: MatrixSpec) -> DataFrame:
    """Assembled vectors and the label as double, kept for the passes of an iterative solver."""
    cols = df.select(
        spec.case_id, col(spec.label).cast("double").alias("y"), *[col(f).cast("double").alias(f) for f in spec.features]
    )
    return kept(assembled(cols, spec.features, "_v").select(spec.case_id, "y", "_v"))


def _single(name: str, df: DataFrame, spec: MatrixSpec, **options):
    """A batch of one on all rows of a matrix."""
    blocks = table_blocks(df, spec)
    try:
        return fit_many(blocks, [Request(name, spec.features, options=tuple(options.items()))])[0]
    finally:
        blocks.release()


def logistic(df: DataFrame, spec: MatrixSpec, tol=1e-3, max_iter=1000) -> LinearScore:
    """Unpenalised logistic regression; ``tol`` bounds the slope of the mean loss."""
    return _single("LR", df, spec, tol=tol, max_iter=max_iter)


def lasso_logistic(df: DataFrame, spec: MatrixSpec, c=1.0, tol=3e-4, max_iter=100) -> LinearScore:
    """L1 logistic regression; the penalty weight is 1 / (C n) on the mean loss. The intercept is free."""
    return _single("LRLasso", df, spec, c=c, tol=tol, max_iter=max_iter)


def linear_svm(df: DataFrame, spec: MatrixSpec, c=1.0, max_iter=200) -> LinearScore:
    """Linear SVM with a logistic map of the margin, fitted on a held-out third of the cases."""
    return _single("SVM", df, spec, c=c, max_iter=max_iter)


@dataclass(frozen=True)
class ClassMoments:
    """Class sizes, means, variances and the pooled within-class covariance of a table.

    Discriminant and Bayes models of any feature subset follow from these without
    touching the cases again.
    """

    features: tuple[str, ...]
    n: tuple[int, int]
    mean: np.ndarray  # 2 x p
    var: np.ndarray  # 2 x p, population
    overall: np.ndarray  # p
    pooled: np.ndarray | None  # p x p, divided by n - 2

    def sub(self, features) -> "ClassMoments":
        i = [self.features.index(f) for f in features]
        pooled = None if self.pooled is None else self.pooled[np.ix_(i, i)]
        return ClassMoments(tuple(features), self.n, self.mean[:, i], self.var[:, i], self.overall[i], pooled)


def class_moments(df: DataFrame, spec: MatrixSpec, covariance=True) -> ClassMoments:
    """One aggregate, and one correlation pass when the covariance is wanted."""
    y = col(spec.label) == 1
    rows = per_feature(
        df,
        spec,
        {
            "m0": lambda c: F.avg(F.when(~y, c)),
            "m1": lambda c: F.avg(F.when(y, c)),
            "v0": lambda c: F.var_pop(F.when(~y, c)),
            "v1": lambda c: F.var_pop(F.when(y, c)),
            "v": F.var_pop,
            "n0": lambda c: F.count_if(~y),
            "n1": lambda c: F.count_if(y),
        },
    ).collect()
    by = {r.feature: r for r in rows}
    pick = lambda *keys: np.array([[by[f][k] for f in spec.features] for k in keys], dtype=float)
    n0, n1 = by[spec.features[0]].n0, by[spec.features[0]].n1
    mean, var = pick("m0", "m1"), pick("v0", "v1")
    pooled = None
    if covariance:
        centred = df.select(
            *[
                (col(f).cast("double") - F.when(y, F.lit(float(b))).otherwise(F.lit(float(a)))).alias(f)
                for f, a, b in zip(spec.features, *mean)
            ]
        )
        sd = np.sqrt((n0 * var[0] + n1 * var[1]) / (n0 + n1 - 2))
        pooled = _corr(centred, spec.features) * np.outer(sd, sd)
    return ClassMoments(spec.features, (n0, n1), mean, var, pick("v")[0], pooled)


def bayes_from(m: ClassMoments) -> BayesScore:
    eps = VAR_SMOOTHING * float(m.overall.max())
    pair = lambda a: (tuple(a[0].tolist()), tuple(a[1].tolist()))
    return BayesScore("NB", m.features, math.log(m.n[1] / m.n[0]), pair(m.mean), pair(m.var + eps))


def gaussian_bayes(df: DataFrame, spec: MatrixSpec) -> BayesScore:
    return bayes_from(class_moments(df, spec, covariance=False))


def _discriminant(m: ClassMoments, cov: np.ndarray) -> LinearScore:
    coef = np.linalg.lstsq(cov, m.mean[1] - m.mean[0], rcond=None)[0]
    intercept = -0.5 * float((m.mean[1] + m.mean[0]) @ coef) + math.log(m.n[1] / m.n[0])
    return LinearScore("LDA", m.features, tuple(coef.tolist()), intercept)


def discriminant_from(m: ClassMoments) -> LinearScore:
    return _discriminant(m, m.pooled)


def _corr(df: DataFrame, features) -> np.ndarray:
    if len(features) == 1:
        return np.ones((1, 1))
    c = Correlation.corr(assembled(df.select(*features), features, "_v"), "_v").head()[0].toArray()
    c = np.nan_to_num(c)
    np.fill_diagonal(c, 1.0)
    return c


def _shrunk_corr(df: DataFrame, features, mean, var) -> np.ndarray:
    """Ledoit-Wolf shrinkage of the correlation matrix; the fourth-moment term is one scalar sum."""
    sd = np.sqrt(np.where(var > 0, var, 1.0))
    norm2 = sum_of([((col(f) - F.lit(float(m))) / F.lit(float(s))) ** 2 for f, m, s in zip(features, mean, sd)])
    row = df.agg(F.sum(norm2 * norm2).alias("b"), F.count(F.lit(1)).alias("n")).head()
    c = _corr(df, features)
    p, n = len(features), row.n
    mu = np.trace(c) / p
    d2 = float((c**2).sum())
    beta = (row.b / n - d2) / (p * n)
    delta = (d2 - 2 * mu * np.trace(c) + p * mu * mu) / p
    s = 0.0 if delta == 0 else min(beta, delta) / delta
    return (1 - s) * c + s * mu * np.eye(p)


def discriminant(df: DataFrame, spec: MatrixSpec, shrinkage: str | None = None) -> LinearScore:
    """Linear discriminant from class means and the pooled within-class covariance.

    With ``shrinkage='auto'`` each class's covariance is shrunk (Ledoit-Wolf on the
    standardised features) and the classes are averaged by size.
    """
    if shrinkage is None:
        return discriminant_from(class_moments(df, spec))
    m = class_moments(df, spec, covariance=False)
    cov = np.zeros((len(spec.features),) * 2)
    for k, size in enumerate(m.n):
        part = df.filter(col(spec.label) == k)
        sd = np.sqrt(m.var[k])
        cov += size / sum(m.n) * _shrunk_corr(part, spec.features, m.mean[k], m.var[k]) * np.outer(sd, sd)
    return _discriminant(m, cov)


def decision_tree(df, spec, max_depth=30, criterion="gini", max_features=None) -> ForestScore:
    return _single("DT", df, spec, max_depth=max_depth, criterion=criterion, max_features=max_features)


def random_forest(df, spec, trees=10, max_depth=30, criterion="gini") -> ForestScore:
    """Trees on Poisson draws of the cases; a node looks at the root of the number of features."""
    return _single("RF", df, spec, trees=trees, max_depth=max_depth, criterion=criterion)


def ada_boost(df: DataFrame, spec: MatrixSpec, rounds=50) -> BoostScore:
    """SAMME boosting of one-split trees."""
    return _single("AB", df, spec, rounds=rounds)


def perceptron(df, spec, hidden=(100,), alpha=1e-4, rate=1e-3, max_iter=200) -> NetworkScore:
    """A network of rectified units, fitted by Adam in mini-batches until its loss falls no more."""
    return _single("AE", df, spec, hidden=tuple(hidden), alpha=alpha, rate=rate, max_iter=max_iter)


# ---------------------------------------------------------------- many models at once


@dataclass(frozen=True)
class Request:
    """One model to fit: ``columns`` of the packed table (``names`` in the model, if others) and rows as ``blocks`` counts them."""

    classifier: str
    columns: tuple[str, ...]
    rows: int = ALL
    options: tuple[tuple[str, object], ...] = ()
    names: tuple[str, ...] | None = None

    @property
    def features(self) -> tuple[str, ...]:
        return self.names or self.columns


#: Classifiers that ``fit_many`` knows.
BATCHED = ("LR", "LRLasso", "SVM", "LDA", "NB", "DT", "RF", "AB", "AE")


def fit_many(blocks: Blocks, requests: list[Request]) -> list:
    """A fitted model for every request; all models of a kind share their passes."""
    out: list = [None] * len(requests)
    own = lambda *kinds: [(i, r, dict(r.options)) for i, r in enumerate(requests) if r.classifier in kinds]
    unknown = {r.classifier for r in requests} - set(BATCHED)
    if unknown:
        raise ValueError(f"not fitted in batches: {sorted(unknown)}")
    linear = own("LR", "LRLasso", "SVM")
    if linear:
        for (i, r, _), model in zip(linear, _linear(blocks, linear)):
            out[i] = model
    moments = own("LDA", "NB")
    if moments:
        shared = block_moments(blocks, sorted({r.rows for _, r, _ in moments}))
        for i, r, options in moments:
            m = shared[r.rows].sub(r.columns)
            out[i] = FROM_MOMENTS[r.classifier](ClassMoments(r.features, m.n, m.mean, m.var, m.overall, m.pooled), **options)
    trees_ = own("DT", "RF", "AB")
    if trees_:
        data = binned(blocks)
        for i, model in _forests(data, [t for t in trees_ if t[1].classifier != "AB"]) + _boosts(data, [t for t in trees_ if t[1].classifier == "AB"]):
            out[i] = model
        data.release()
    nets = own("AE")
    if nets:
        for (i, _, _), model in zip(nets, _networks(blocks, nets)):
            out[i] = model
    return out


def _networks(blocks: Blocks, wanted) -> list[NetworkScore]:
    tasks = []
    for _, r, options in wanted:
        plain = {k: v for k, v in options.items() if k in ("hidden", "alpha", "rate")}
        tasks.append(NetTask(blocks.index(r.columns), r.rows, epochs=options.get("max_iter", 200), **plain))
    return [
        NetworkScore(r.classifier, r.features, fit.weights, fit.sizes, fit.converged)
        for (_, r, _), fit in zip(wanted, train(blocks, tasks))
    ]


def _linear(blocks: Blocks, wanted) -> list[LinearScore]:
    first, calibrating = [], []
    for _, r, options in wanted:
        columns, tol, steps = blocks.index(r.columns), options.get("tol"), options.get("max_iter", 200)
        if r.classifier == "LR":
            first.append([Task(columns, r.rows, tol=tol or 1e-3, max_iter=steps)])
        elif r.classifier == "LRLasso":
            first.append([Task(columns, r.rows, l1=1 / options.get("c", 1.0), tol=tol or 3e-4, max_iter=steps)])
        else:
            ridge = {"hinge": True, "l2": 1 / options.get("c", 1.0), "tol": tol or 1e-3, "max_iter": steps}
            first.append([Task(columns, r.rows, **ridge), Task(columns, r.rows, third=1, **ridge)])
    solved = iter(solve(blocks, [t for tasks in first for t in tasks]))
    fits: list[list[Fit]] = [[next(solved) for _ in tasks] for tasks in first]
    for tasks, got in zip(first, fits):
        if len(got) == 2:
            calibrating.append(Task(tasks[0].columns, tasks[0].rows, third=0, through=(*got[1].coef, got[1].intercept), tol=1e-4))
    maps = iter(solve(blocks, calibrating))
    out = []
    for (_, r, _), got in zip(wanted, fits):
        scale, shift, done = 1.0, 0.0, got[0].converged
        if len(got) == 2:
            m = next(maps)
            scale, shift, done = m.coef[0], m.intercept, done and got[1].converged
        out.append(LinearScore(r.classifier, r.features, got[0].coef, got[0].intercept, scale, shift, done))
    return out


def _tried(option, n: int) -> int | None:
    if option == "sqrt":
        return max(1, int(math.sqrt(n)))
    return max(1, int(math.log2(n))) if option == "log2" else None


def _forests(data: Binned, wanted) -> list[tuple[int, ForestScore]]:
    tasks, owner = [], []
    for i, r, options in wanted:
        forest = r.classifier == "RF"
        columns = data.blocks.index(r.columns)
        tried = _tried("sqrt" if forest else options.get("max_features"), len(columns))
        for seed in range(options.get("trees", 10) if forest else 1):
            depth, criterion = options.get("max_depth", 30), options.get("criterion", "gini")
            tasks.append(TreeTask(columns, r.rows, seed, forest, tried, depth, criterion))
            owner.append(i)
    grown: dict[int, list] = {}
    folder, found = stored_trees(data, tasks) if tasks else ("", [])
    for i, tree in zip(owner, found):
        grown.setdefault(i, []).append((tree.column, tree.bin, tree.left, tree.right, tree.cut, tree.share, tree.parts))
    return [(i, ForestScore(r.classifier, r.features, folder, tuple(grown[i]))) for i, r, _ in wanted]


def _boosts(data: Binned, wanted) -> list[tuple[int, BoostScore]]:
    if not wanted:
        return []
    tasks = [TreeTask(data.blocks.index(r.columns), r.rows) for _, r, _ in wanted]
    out = []
    for (i, r, _), task, rules in zip(wanted, tasks, boosted(data, tasks, [o.get("rounds", 50) for _, _, o in wanted])):
        if not rules:
            raise ValueError("no feature separates the classes better than chance")
        named = tuple((r.features[j], float(data.cuts[task.columns[j]][b]), low, alpha) for j, b, low, alpha in rules)
        out.append((i, BoostScore("AB", r.features, named)))
    return out


def block_moments(blocks: Blocks, rows: list[int]) -> dict[int, ClassMoments]:
    """Class moments of several row choices from two passes: sums by part and class, then products about the mean."""
    p = len(blocks.columns)
    name = lambda part, label: 2 * (part + 1) + label

    def totals(each: Iterator[Block], about: np.ndarray | None) -> dict[int, np.ndarray]:
        out: dict[int, np.ndarray] = {}
        for block in each:
            for part in np.unique(block.part).tolist():
                for label in (0, 1):
                    x = block.x[(block.part == part) & ((block.y == 1) == bool(label))]
                    if about is None:
                        cell = np.concatenate(([len(x)], x.sum(axis=0)))
                    else:
                        x = x - about
                        cell = (x.T @ x).ravel()
                    out[name(part, label)] = out.get(name(part, label), 0.0) + cell
        return out

    sums = blocks.sums(lambda each: totals(each, None))
    whole = sum(sums.values())
    about = whole[1:] / max(whole[0], 1.0)
    products = blocks.sums(lambda each: totals(each, about))
    parts = sorted({i // 2 - 1 for i in sums})
    found = {}
    for choice in rows:
        taken = [q for q in parts if (q == MAIN if choice == MAIN else q >= 0 and q != choice)]
        n, mean, scatter = [], [], []
        for label in (0, 1):
            own = sum((sums[name(q, label)] for q in taken), np.zeros(p + 1))
            size = int(own[0])
            if size == 0:
                raise ValueError(f"rows {choice} hold no case of class {label}")
            centre = own[1:] / size
            off = centre - about
            cross = sum((products[name(q, label)] for q in taken), np.zeros(p * p)).reshape(p, p)
            n.append(size)
            mean.append(centre)
            scatter.append(cross - size * np.outer(off, off))
        var = np.array([np.maximum(np.diag(s), 0) / k for s, k in zip(scatter, n)])
        centre = (n[0] * mean[0] + n[1] * mean[1]) / sum(n)
        overall = sum(k * (v + (m - centre) ** 2) for k, v, m in zip(n, var, mean)) / sum(n)
        pooled = (scatter[0] + scatter[1]) / max(sum(n) - 2, 1)
        found[choice] = ClassMoments(blocks.columns, tuple(n), np.array(mean), var, overall, pooled)
    return found


def score_many(
    df: DataFrame,
    keep: list[str],
    columns: list[Column],
    chosen: list[tuple[tuple[int, ...], object, int | None]],
    by: str | None = None,
    names: tuple[str, str] = ("model", "pred"),
) -> DataFrame:
    """``keep``, model (its place in ``chosen``) and pred: all models in one read of the table.

    ``chosen`` has the places of each model's features among ``columns``, the model, and the value of the kept column
    ``by`` that a case must have to be scored by it (None: any).
    """
    kept_ = df.select(*[col(k) for k in keep], F.array(*[c.cast("double") for c in columns]).alias("_x"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept_.drop("_x").schema.fields) + f", `{names[0]}` int, `{names[1]}` double"
    most = max(1, CHUNK_CELLS // max(1, len(columns)))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        own: list[pa.RecordBatch] = []
        for batch in batches:
            own.append(batch)
            if sum(map(len, own)) >= most:
                yield pa.Table.from_batches(own).combine_chunks()
                own = []
        if own:
            yield pa.Table.from_batches(own).combine_chunks()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A model scores a whole chunk at once, because it may have to be read; the scores of a few go out together."""
        for chunk in chunks(batches):
            if not len(chunk):
                continue
            x = pa.concat_arrays([c.flatten() for c in chunk.column("_x").chunks]).to_numpy(zero_copy_only=False).reshape(len(chunk), -1)
            group = chunk.column(by).to_numpy() if by else None
            rows, model, pred, size = [], [], [], 0
            for i, (places, m, only) in enumerate(chosen):
                mine = np.arange(len(x)) if only is None else np.flatnonzero(group == only)
                if len(mine):
                    rows.append(mine)
                    model.append(np.full(len(mine), i, np.int32))
                    pred.append(m.chance(x[np.ix_(mine, places)]))
                    size += len(mine)
                if rows and (size >= 400_000 or i == len(chosen) - 1):
                    yield from scored(chunk, rows, model, pred)
                    rows, model, pred, size = [], [], [], 0
            if rows:
                yield from scored(chunk, rows, model, pred)

    def scored(chunk: pa.Table, rows, model, pred) -> Iterator[pa.RecordBatch]:
        at = pa.array(np.concatenate(rows))
        keys = chunk.select(keep).take(at)
        cells = [pa.array(np.concatenate(model)), pa.array(np.concatenate(pred))]
        yield from pa.Table.from_arrays([*keys.columns, *cells], [*keep, *names]).to_batches()

    return kept_.mapInArrow(score, schema)


CLASSIFIERS: dict[str, Callable] = {
    "LR": logistic,
    "LRLasso": lasso_logistic,
    "SVM": linear_svm,
    "LDA": discriminant,
    "NB": gaussian_bayes,
    "DT": decision_tree,
    "RF": random_forest,
    "AE": perceptron,
    "AB": ada_boost,
}

FROM_MOMENTS: dict[str, Callable] = {"LDA": discriminant_from, "NB": bayes_from}

# Option lists per classifier; a list of dicts is the union of their cross products.
GRIDS: dict[str, list[dict]] = {
    "LR": [{"tol": [0.0001, 0.001, 0.003], "max_iter": [500, 1000]}],
    "LRLasso": [{"c": [0.1, 1.0], "tol": [0.00003, 0.0003], "max_iter": [100]}],
    "SVM": [{"c": [0.1, 0.3, 1.0, 3.0]}],
    "LDA": [{"shrinkage": [None]}, {"shrinkage": ["auto"]}],
    "NB": [{}],
    "DT": [{"criterion": ["gini", "entropy"], "max_features": [None, "sqrt", "log2"]}],
    "RF": [{"trees": [10, 50, 100], "criterion": ["gini", "entropy"]}],
    "AE": [{"hidden": [(30,), (100,)], "alpha": [0.0001, 0.001], "rate": [0.001, 0.01]}],
    "AB": [{"rounds": [10, 50, 100]}],
}


def grid_points(grids: list[dict]) -> list[dict]:
    """Union of cross products; options equal to the text 'None' are left at their default."""
    out = []
    for g in grids:
        keys = [k for k, v in g.items() if v != "None"]
        out += [dict(zip(keys, combo)) for combo in itertools.product(*[g[k] for k in keys])]
    return out or [{}]


def cross_predict(df: DataFrame, spec: MatrixSpec, fit: Callable | str, folds=5, **options) -> DataFrame:
    """Out-of-fold scores: case_id, label, fold, pred; the model is refitted for every fold.

    ``fit`` is a function (df, spec) -> model, or the name of a classifier that is fitted in batches.
    """
    marked = kept(stratified_folds(spec.project(df), spec, folds))
    if isinstance(fit, str):
        return _held_out(marked, spec, fit, [options], folds).drop("option")
    parts = None
    for f in range(folds):
        model = fit(marked.filter(F.col("fold") != f), spec)
        part = model.predict(marked.filter(F.col("fold") == f)).select(*spec.keys, "fold", "pred")
        parts = part if parts is None else parts.unionByName(part)
    return parts


def _held_out(marked: DataFrame, spec: MatrixSpec, name: str, points: list[dict], folds: int) -> DataFrame:
    """Out-of-fold scores of every option, all fitted together: keys, fold, option, pred."""
    blocks = table_blocks(marked, spec, F.col("fold"))
    asked = [Request(name, spec.features, f, tuple(p.items())) for p in points for f in range(folds)]
    models = fit_many(blocks, asked)
    blocks.release()
    places = tuple(range(len(spec.features)))
    chosen = [(places, m, r.rows) for m, r in zip(models, asked)]
    scored = score_many(marked, [*spec.keys, "fold"], [col(f) for f in spec.features], chosen, by="fold")
    return scored.select(*spec.keys, "fold", F.floor(F.col("model") / folds).cast("int").alias("option"), "pred")


def grid_search(df: DataFrame, spec: MatrixSpec, name: str, grids: list[dict] | None = None, folds=5):
    """(best fitted model, table of options and fold accuracy) by cross-validated accuracy.

    Ties go to the earlier option, as does a grid of one. Options of classifiers that are fitted in batches share
    all passes.
    """
    fit = CLASSIFIERS[name]
    points = grid_points(grids or GRIDS[name])
    right = F.avg(((F.col("pred") > 0.5).cast("int") == col(spec.label)).cast("double")).alias("a")
    accuracy = dict.fromkeys(range(len(points)), 0.0)
    if len(points) > 1 and name in BATCHED and not any("shrinkage" in p for p in points):
        marked = kept(stratified_folds(spec.project(df), spec, folds))
        per = _held_out(marked, spec, name, points, folds).groupBy("option", "fold").agg(right).groupBy("option").agg(F.avg("a").alias("a"))
        accuracy |= {r.option: r.a for r in per.collect()}
        marked.unpersist()
    elif len(points) > 1:
        for i, p in enumerate(points):
            scored = cross_predict(df, spec, lambda d, s, p=p: fit(d, s, **p), folds)
            accuracy[i] = scored.groupBy("fold").agg(right).agg(F.avg("a").alias("a")).head().a
    rows = [{"option": i, "parameters": str(p), "accuracy": float(accuracy[i])} for i, p in enumerate(points)]
    best = max(rows, key=lambda r: (r["accuracy"], -r["option"]))["option"]
    return fit(df, spec, **points[best]), rows


def spark_grid_search(df: DataFrame, spec: MatrixSpec, estimator, grids: list[dict], folds=5, parallelism=4):
    """Grid search of any Spark ML estimator with ``CrossValidator`` over the stratified folds.

    ``grids`` maps parameter names of the estimator to value lists.
    """
    maps = []
    for g in grids:
        b = ParamGridBuilder()
        for k, v in g.items():
            if v != "None":
                b = b.addGrid(estimator.getParam(k), v)
        maps += b.build()
    data = assembled(stratified_folds(spec.project(df), spec, folds), spec.features, estimator.getFeaturesCol())
    data = kept(data.withColumn(estimator.getLabelCol(), col(spec.label).cast("double")))
    cv = CrossValidator(
        estimator=estimator,
        estimatorParamMaps=maps,
        evaluator=MulticlassClassificationEvaluator(metricName="accuracy", labelCol=estimator.getLabelCol()),
        numFolds=folds,
        foldCol="fold",
        parallelism=parallelism,
    )
    model = cv.fit(data)
    data.unpersist()
    return model


def linear_shap(df: DataFrame, spec: MatrixSpec, model: LinearScore, background: DataFrame | None = None) -> DataFrame:
    """Signed contribution of every feature to every case's margin, against the mean case."""
    mu = (df if background is None else background).agg(*[F.avg(col(f)).alias(f) for f in model.features]).head()
    phi = [((col(f) - F.lit(mu[f])) * F.lit(w)).alias(f) for f, w in zip(model.features, model.coef)]
    return df.select(spec.case_id, *phi)
