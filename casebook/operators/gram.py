"""One correlation pass over the cases, shared by everything that needs feature-feature products.

Only p x p numbers leave Spark. Redundancy filters, inflation factors and feature
clustering then work on that small matrix.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.functions.exprs import assembled, col
from casebook.spec import MatrixSpec


@dataclass(frozen=True)
class FeatureGram:
    """Counts, first and second moments of the features (and optionally the label, last)."""

    names: tuple[str, ...]
    n: int
    mean: np.ndarray
    sd: np.ndarray
    corr: np.ndarray  # NaN rows and columns for constant features
    gram: np.ndarray  # sum over cases of scaled x_i * x_j

    def sub(self, names) -> "FeatureGram":
        i = [self.names.index(x) for x in names]
        return FeatureGram(
            tuple(names), self.n, self.mean[i], self.sd[i], self.corr[np.ix_(i, i)], self.gram[np.ix_(i, i)]
        )


def feature_gram(df: DataFrame, spec: MatrixSpec, with_label=False, scaling: str | None = None) -> FeatureGram:
    """Moments in one aggregate and correlations in one pass. ``scaling='minmax'`` describes the
    features mapped to [0, 1] without rescaling the data."""
    names = [*spec.features, *([spec.label] if with_label else [])]
    cols = df.select(*[col(c).cast("double").alias(c) for c in names])
    aggs = []
    for i, c in enumerate(names):
        aggs += [
            F.avg(col(c)).alias(f"m{i}"),
            F.stddev_pop(col(c)).alias(f"s{i}"),
            F.min(col(c)).alias(f"l{i}"),
            F.max(col(c)).alias(f"h{i}"),
        ]
    row = cols.agg(F.count(F.lit(1)).alias("n"), *aggs).head()
    p = len(names)
    mean = np.array([row[f"m{i}"] for i in range(p)], dtype=float)
    sd = np.array([row[f"s{i}"] for i in range(p)], dtype=float)
    if scaling == "minmax":
        low = np.array([row[f"l{i}"] for i in range(p)], dtype=float)
        span = np.array([row[f"h{i}"] for i in range(p)], dtype=float) - low
        safe = np.where(span > 0, span, 1.0)
        mean, sd = (mean - low) / safe, sd / safe
    corr = np.full((p, p), np.nan)
    live = [i for i in range(p) if sd[i] > 0]
    if len(live) == 1:
        corr[live[0], live[0]] = 1.0
    elif live:
        picked = cols.select(*[col(names[i]).alias(f"c{i}") for i in live])
        c = Correlation.corr(assembled(picked, [f"c{i}" for i in live], "v"), "v").head()[0].toArray()
        corr[np.ix_(live, live)] = c
    cov = np.where(np.isnan(corr), 0.0, corr) * np.outer(sd, sd)
    gram = row.n * (cov + np.outer(mean, mean))
    return FeatureGram(tuple(names), row.n, mean, sd, corr, gram)


def uncorrelated(gram: FeatureGram, label: str, threshold=0.99) -> list[str]:
    """Greedy redundancy filter in feature order.

    A newcomer that correlates above the threshold with a kept feature competes with
    the first such feature: the one closer to the label stays. Strict comparisons.
    """
    feats = [f for f in gram.names if f != label]
    r = np.abs(np.nan_to_num(gram.corr))
    at = {f: gram.names.index(f) for f in gram.names}
    to_label = {f: r[at[f], at[label]] for f in feats}
    keep: list[str] = []
    for f in feats:
        rival = next((i for i, g in enumerate(keep) if r[at[f], at[g]] > threshold), None)
        if rival is None:
            keep.append(f)
        elif to_label[f] > to_label[keep[rival]]:
            keep[rival] = f
    return sorted(keep, key=feats.index)


def inflation(gram: FeatureGram) -> dict[str, float]:
    """Variance inflation factor per feature; infinite where features are exactly dependent."""
    c = np.nan_to_num(gram.corr)
    np.fill_diagonal(c, 1.0)
    if len(c) and np.linalg.matrix_rank(c, hermitian=True, tol=1e-10) < len(c):
        vals, vecs = np.linalg.eigh(c)
        null = vecs[:, vals < 1e-10]
        involved = (np.abs(null) > 1e-6).any(axis=1)
        inv = np.linalg.pinv(c, rcond=1e-10, hermitian=True)
        return {f: float("inf") if involved[i] else float(inv[i, i]) for i, f in enumerate(gram.names)}
    return dict(zip(gram.names, np.diag(np.linalg.inv(c)).astype(float)))


def _to_centres(g: np.ndarray, labels: np.ndarray, k: int) -> np.ndarray:
    """Squared distance of every feature to every cluster mean, from the Gram matrix alone."""
    d = np.full((len(g), k), np.inf)
    for c in range(k):
        m = np.flatnonzero(labels == c)
        if len(m):
            d[:, c] = np.diag(g) - 2 * g[:, m].mean(axis=1) + g[np.ix_(m, m)].mean()
    return np.maximum(d, 0.0)


def cluster_features(gram: FeatureGram, k: int, seed=0, restarts=10, rounds=300) -> np.ndarray:
    """k-means over the features as points (kernel form, k-means++ starts); cluster per feature."""
    g = gram.gram
    p = len(g)
    k = min(k, p)
    rng = np.random.default_rng(seed)
    pair = np.maximum(np.diag(g)[:, None] + np.diag(g)[None, :] - 2 * g, 0.0)
    best, best_sse = np.zeros(p, dtype=int), np.inf
    for _ in range(restarts):
        centres = [int(rng.integers(p))]
        while len(centres) < k:
            near = pair[:, centres].min(axis=1)
            free = [i for i in range(p) if i not in centres]
            centres.append(int(rng.choice(p, p=near / near.sum())) if near.sum() > 0 else free[0])
        labels = pair[:, centres].argmin(axis=1)
        labels[centres] = np.arange(k)
        for _ in range(rounds):
            d = _to_centres(g, labels, k)
            new = d.argmin(axis=1)
            for c in np.setdiff1d(np.arange(k), new):  # refill an empty cluster with the farthest point
                crowded = np.flatnonzero(np.bincount(new, minlength=k)[new] > 1)
                new[crowded[d[crowded, new[crowded]].argmax()]] = c
            if (new == labels).all():
                break
            labels = new
        sse = _to_centres(g, labels, k)[np.arange(p), labels].sum()
        if sse < best_sse - 1e-12:
            best, best_sse = labels.copy(), sse
    return best


def representatives(gram: FeatureGram, labels: np.ndarray) -> list[str]:
    """Per cluster the feature nearest to the cluster mean (first on ties)."""
    k = int(labels.max()) + 1
    d = _to_centres(gram.gram, labels, k)
    out = []
    for c in range(k):
        m = np.flatnonzero(labels == c)
        if len(m):
            out.append(gram.names[m[d[m, c].argmin()]])
    return out


def cluster_sweep(gram: FeatureGram, k_max: int | None = None, seed=0) -> list[dict]:
    """Within-cluster sum of squares and mean silhouette for k = 2 .. min(p, 50) - 1."""
    g = gram.gram
    p = len(g)
    top = k_max or min(p, 50) - 1
    dist = np.sqrt(np.maximum(np.diag(g)[:, None] + np.diag(g)[None, :] - 2 * g, 0.0))
    rows = []
    for k in range(2, top + 1):
        lab = cluster_features(gram, k, seed, restarts=3)
        sse = float(_to_centres(g, lab, k)[np.arange(p), lab].sum())
        sums = np.stack([dist[:, lab == c].sum(axis=1) for c in range(k)], axis=1)
        size = np.bincount(lab, minlength=k)
        own = size[lab]
        a = sums[np.arange(p), lab] / np.maximum(own - 1, 1)
        other = sums / np.maximum(size, 1)
        other[np.arange(p), lab] = np.inf
        b = other.min(axis=1)
        s = np.where(own > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)
        rows.append({"k": k, "sse": sse, "silhouette": float(s.mean())})
    return rows
