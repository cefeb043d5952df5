"""Singular values and right singular vectors of a small upper triangle, to high relative accuracy.

Householder reflections make the triangle bidiagonal, differential qd steps with shifts (dqds) find the
squares of its singular values, and twisted factorisations of the shifted qd representation give the vectors.
"""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(float).eps)


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, w): diagonal and superdiagonal of a bidiagonal B with ``r = U B w.T`` for some orthogonal U."""
    r = np.array(r, float)
    d = len(r)
    w = np.eye(d)
    for i in range(d):
        _reflect(r[i:, i:], 0)
        if i < d - 2:
            v = _householder(r[i, i + 1 :])
            if v is not None:
                r[i:, i + 1 :] -= np.outer(r[i:, i + 1 :] @ v, 2 * v)
                w[:, i + 1 :] -= np.outer(w[:, i + 1 :] @ v, 2 * v)
    return np.diag(r).copy(), np.diag(r, 1).copy(), w


def _householder(x: np.ndarray) -> np.ndarray | None:
    """The unit vector whose reflection maps ``x`` to a multiple of the first axis; None for zero."""
    scale = np.abs(x).max(initial=0.0)
    if scale == 0:
        return None
    v = x / scale
    v[0] += np.copysign(np.linalg.norm(v), v[0])
    return v / np.linalg.norm(v)


def _reflect(block: np.ndarray, column: int) -> None:
    v = _householder(block[:, column])
    if v is not None:
        block -= np.outer(2 * v, v @ block)


def squared_singular_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squares of the singular values of the bidiagonal (a, b), largest first.

    A step without shift also yields ``1 / sum(1 / d)``, which never exceeds the smallest value left, so
    every shift is safe and no digit is lost by subtraction. Blocks that fall apart go on alone.
    """
    tolerance = (100 * EPS) ** 2
    found: list[float] = []
    blocks = [((a * a).tolist(), (b * b).tolist(), 0.0)]
    while blocks:
        q, e, shift = blocks.pop()
        while q:
            if len(q) == 1:
                found.append(shift + q[0])
                break
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= tolerance * (shift + min(q[i], q[i + 1]))), None)
            if cut is not None:
                blocks.append((q[: cut + 1], e[:cut], shift))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            q, e, d = _qd_step(q, e, 0.0)
            if min(d) > 0:
                tau = (1 - 4 * len(q) * EPS) / sum(1 / x for x in d)
                for _ in range(4):
                    moved = _qd_step(q, e, tau)
                    if min(moved[2]) >= 0:
                        if shift + tau > shift:
                            q, e, shift = moved[0], moved[1], shift + tau
                        else:  # the shift is lost in rounding: what is left is converged to full accuracy
                            q, e = moved[0], moved[1]
                        break
                    tau *= 0.75
    return np.sort(np.array(found))[::-1]


def _qd_step(q: list[float], e: list[float], tau: float) -> tuple[list[float], list[float], list[float]]:
    """One differential qd step with shift ``tau``: new q, new e and the auxiliary d."""
    d = q[0] - tau
    nq, ne, ds = [], [], [d]
    for i, off in enumerate(e):
        top = d + off
        t = q[i + 1] / top if top > 0 else 0.0
        nq.append(top)
        ne.append(off * t)
        d = d * t - tau
        ds.append(d)
    nq.append(d)
    return nq, ne, ds


def right_vectors(a: np.ndarray, b: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) of ``B.T @ B`` for the given eigenvalues, which are in falling order.

    A vector starts from the twist whose pivot is smallest. Values closer than a millionth of each other
    share a cluster: a vector that lies in the span of the cluster's earlier ones is taken from the next
    twist, so the cluster's vectors stay orthogonal.
    """
    norm = max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0))
    a = np.where(np.abs(a) < norm * EPS * EPS, norm * EPS * EPS, a)
    b = np.where(np.abs(b) < norm * EPS / 8, 0.0, b)  # the matrix falls apart there
    out: list[np.ndarray] = []
    for j, value in enumerate(squares):
        near = [out[i] for i in range(j) if squares[i] - value <= 1e-6 * squares[i]]
        best, size = None, -1.0
        for z in _twisted(a, b, float(value)):
            for _ in range(2):
                for other in near:
                    z = z - other * (other @ z)
            left = float(np.linalg.norm(z))
            if left > size:
                best, size = z, left
            if left > 0.5:
                break
        out.append(best / np.linalg.norm(best))
    return np.array(out).T if out else np.zeros((len(a), 0))


def _twisted(a: np.ndarray, b: np.ndarray, value: float):
    """Unit vectors of twisted factorisations of ``L D L.T - value``, smallest pivot first."""
    n = len(a)
    d, l = a * a, b / a[: n - 1]
    least = EPS * value  # a pivot of zero becomes one of rounding size
    s, lower = np.empty(n), np.empty(max(0, n - 1))
    s[0] = -value
    for i in range(n - 1):
        if abs(s[i] + d[i]) < least:
            s[i] += 2 * least
        top = s[i] + d[i]
        lower[i] = d[i] * l[i] / top
        s[i + 1] = lower[i] * l[i] * s[i] - value
    p, upper = np.empty(n), np.empty(max(0, n - 1))
    p[n - 1] = d[n - 1] - value
    for i in range(n - 2, -1, -1):
        if abs(d[i] * l[i] * l[i] + p[i + 1]) < least:
            p[i + 1] += 2 * least
        t = d[i] / (d[i] * l[i] * l[i] + p[i + 1])
        upper[i] = l[i] * t
        p[i] = p[i + 1] * t - value
    pivots = np.abs(s + p + value)
    for k in np.argsort(pivots, kind="stable"):
        z = np.zeros(n)
        z[k] = 1.0
        for i in range(k - 1, -1, -1):
            z[i] = -lower[i] * z[i + 1]
        for i in range(k, n - 1):
            z[i + 1] = -upper[i] * z[i]
        norm = np.linalg.norm(z)
        if np.isfinite(norm):
            yield z / norm
