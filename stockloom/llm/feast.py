"""Greatest eigenpairs of a symmetric matrix by contour integration, with counts that prove none is missed.

Inertia: the number of eigenvalues below a shift is the number of negative pivots when the shifted
matrix is factorised symmetrically. Such counts cut the upper end of the spectrum into intervals of a
few eigenvalues each. For an interval the integral of the resolvent around a circle through its ends is
the projector onto its eigenvectors; quadrature turns that into a few complex shifted solves. The
projected block gives a small Rayleigh-Ritz problem, and is projected anew until as many pairs as
the inertia promises have residuals of rounding size. A block that fails is widened, at last to the
whole space, where the Ritz pairs are the eigenpairs.
"""

from __future__ import annotations

import numpy as np

#: Diagonal entries of at least this share of the greatest other entry serve as pivots alone; else a block of two does.
ALONE = (1 + 17**0.5) / 8


def below(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric matrix ``a`` lie below ``shift``."""
    rest, found = a - shift * np.eye(len(a)), 0
    while len(rest):
        size = np.abs(rest)
        on = np.diag(size).copy()
        np.fill_diagonal(size, 0)
        one, (p, q) = int(on.argmax()), divmod(int(size.argmax()), len(rest))
        if on[one] == 0 and size[p, q] == 0:
            break  # what is left is zero, and so not below
        if on[one] >= ALONE * size[p, q]:
            pivot = [one]
            found += bool(rest[one, one] < 0)
        else:  # the determinant is negative: one eigenvalue of each sign
            pivot = [p, q]
            found += 1
        left = np.delete(np.arange(len(rest)), pivot)
        side = rest[np.ix_(left, pivot)]
        rest = rest[np.ix_(left, left)] - side @ np.linalg.solve(rest[np.ix_(pivot, pivot)], side.T)
        rest = (rest + rest.T) / 2
    return found


def intervals(a: np.ndarray, k: int, floor: float, top: float, most: int = 4) -> list[tuple[float, float, int]]:
    """Intervals (low, high, eigenvalues inside) that hold the ``k`` greatest eigenvalues above ``floor``
    (all, if fewer), with at most ``most`` each unless they lie too close to be told apart."""
    narrow = 1e-12 * top
    above = lambda x: len(a) - below(a, x)
    low, high, held = floor, top, above(floor)
    if held > k:
        while high - low > narrow and held != k:
            middle = (low + high) / 2
            n = above(middle)
            if n >= k:
                low, held = middle, n
            else:
                high = middle
    out, todo = [], [(low, top, held, 0)]
    while todo:
        lo, hi, over_lo, over_hi = todo.pop()
        if over_lo - over_hi <= most or hi - lo <= narrow:
            if over_lo > over_hi:
                out.append((lo, hi, over_lo - over_hi))
            continue
        middle = (lo + hi) / 2
        n = above(middle)
        todo += [(lo, middle, over_lo, n), (middle, hi, n, over_hi)]
    return out


def project(a: np.ndarray, low: float, high: float, block: np.ndarray, nodes: int = 8) -> np.ndarray:
    """``block`` projected onto the eigenvectors of the interval, by Gauss quadrature on the upper half circle."""
    x, w = np.polynomial.legendre.leggauss(nodes)
    turns = np.exp(0.5j * np.pi * (1 - x))
    centre, radius = (low + high) / 2, (high - low) / 2
    one = np.eye(len(a))
    return sum(0.5 * wj * np.real(radius * t * np.linalg.solve((centre + radius * t) * one - a, block.astype(complex))) for wj, t in zip(w, turns))


def ritz(a: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ritz values and vectors of the space that the columns of ``block`` span."""
    basis = np.linalg.qr(block)[0]
    small = basis.T @ a @ basis
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return values, basis @ vectors


def in_interval(a: np.ndarray, low: float, high: float, n: int, error: float, rounds: int = 12) -> np.ndarray:
    """The ``n`` eigenvectors whose eigenvalues lie in the interval, as columns."""
    d, width = len(a), max(2 * n, n + 6)
    draw = np.random.default_rng(0)
    while width < d:
        block = draw.standard_normal((d, width))
        for _ in range(rounds):
            values, block = ritz(a, project(a, low, high, block))
            residual = np.linalg.norm(a @ block - block * values, axis=0)
            sound = (values > low) & (values < high) & (residual <= error)
            if sound.sum() == n:
                return block[:, sound]
        width *= 2
    values, vectors = ritz(a, np.eye(d))
    near = np.argsort(np.maximum(low - values, values - high), kind="stable")[:n]
    return vectors[:, near]


def greatest(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` greatest positive eigenvalues of a symmetric matrix without negative ones, falling, and
    unit eigenvectors as columns. Eigenvalues of rounding size count as zero, so fewer may come."""
    d = len(a)
    norm = float(np.abs(a).sum(1).max()) if d else 0.0
    if norm == 0:
        return np.zeros(0), np.zeros((d, 0))
    error = 8 * d * np.finfo(float).eps * norm
    parts = intervals(a, k, error, norm * (1 + 1e-9) + error)
    if not parts:
        return np.zeros(0), np.zeros((d, 0))
    found = np.concatenate([in_interval(a, low, high, n, error) for low, high, n in parts], axis=1)
    values, vectors = ritz(a, found)  # once more over all intervals, so that all are at right angles
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    lead = np.abs(vectors).argmax(0)
    return values, vectors * np.sign(vectors[lead, np.arange(len(values))])
