"""Eigenpairs of a symmetric matrix: Householder tridiagonal form, divide and conquer, and a refinement in extended precision."""

from __future__ import annotations

import numpy as np

EPS = np.finfo(np.float64).eps


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and Q of a = Q T Q'."""
    a, n = np.array(a, np.float64), len(a)
    q, least = np.eye(n), EPS * EPS * np.abs(a).max(initial=0.0)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        norm = np.linalg.norm(x)
        if norm <= least:  # squares of such numbers are no longer exact to double precision
            a[k + 1 :, k] = a[k, k + 1 :] = 0
            continue
        if norm == abs(x[0]):
            continue
        x[0] += np.copysign(norm, x[0])
        x /= np.linalg.norm(x)
        p = a[k + 1 :, k + 1 :] @ x
        w = p - x * (x @ p)
        a[k + 1 :, k + 1 :] -= 2 * (np.outer(x, w) + np.outer(w, x))
        a[k + 1 :, k] -= 2 * x * (x @ a[k + 1 :, k])
        a[k, k + 1 :] = a[k + 1 :, k]
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ x, x)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def secular_roots(d: np.ndarray, z: np.ndarray, rho: float) -> np.ndarray:
    """root[j] - d[i] for all roots of 1 + rho sum(z**2 / (d - x)) = 0; d rises, rho is positive, no z is 0.

    Each root is bisected as its distance from the nearer pole, down to neighbouring floating-point numbers.
    """
    gap = np.append(np.diff(d), rho * (z @ z))
    apart = d[None, :] - d[:, None]  # [i, j]: d[j] - d[i]
    value = lambda base, mu: 1 + rho * np.sum(z**2 / (base - mu[:, None]), axis=1)
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        right = (value(apart, gap / 2) < 0) & (np.arange(len(d)) < len(d) - 1)
        origin = np.arange(len(d)) + right
        base = apart[origin]
        last = np.arange(len(d)) == len(d) - 1
        low = np.where(right, -gap / 2, 0.0)
        high = np.where(right, 0.0, np.where(last, gap, gap / 2))
        for _ in range(1200):
            mid = low + (high - low) / 2
            if not ((mid > low) & (mid < high)).any():
                break
            up = value(base, mid) < 0  # the function rises from -inf to +inf between poles
            low, high = np.where(up, mid, low), np.where(up, high, mid)
    mu = np.where(right, low, high)
    return (d[origin] - d[:, None]) + mu  # [i, j]: root[j] - d[i]


def merged(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs of diag(d) + rho z z' with a positive rho: those that do not move are taken out, the others are roots."""
    n, order = len(d), np.argsort(d, kind="stable")
    d, z, turn = d[order].copy(), z[order].copy(), np.eye(n)
    tol = 8 * EPS * max(np.abs(d).max(), rho * np.abs(z).max())
    stays = rho * np.abs(z) <= tol
    at = -1
    for j in range(n):
        if stays[j]:
            continue
        if at >= 0:
            tau = np.hypot(z[at], z[j])
            c, s = z[j] / tau, -z[at] / tau
            if abs((d[j] - d[at]) * c * s) <= tol:  # so near that a rotation moves both weights to one
                z[at], z[j] = 0.0, tau
                turn[:, [at, j]] = turn[:, [at, j]] @ np.array([[c, -s], [s, c]])
                d[at], d[j] = d[at] * c * c + d[j] * s * s, d[at] * s * s + d[j] * c * c
                stays[at] = True
        at = j
    vectors, values = turn.copy(), d.copy()
    own = np.flatnonzero(~stays)
    if len(own):
        own = own[np.argsort(d[own], kind="stable")]
        dd, k = d[own], len(own)
        away = secular_roots(dd, z[own], rho)
        # Weights that have these roots exactly, so that the vectors are orthogonal however near the roots are.
        apart = dd[None, :] - dd[:, None]
        i, j = np.indices((k, k))
        below, above = j < i, (j >= i) & (j < k - 1)
        factor = np.ones((k, k))
        factor[below] = away[below] / apart[below]
        factor[above] = away[above] / apart[i[above], j[above] + 1]
        weight = np.sqrt(np.abs(factor.prod(axis=1) * away[:, k - 1] / rho)) * np.sign(z[own])
        v = weight[:, None] / -away
        v /= np.linalg.norm(v, axis=0)
        vectors[:, own] = turn[:, own] @ v
        values[own] = dd + np.diag(away)
    out = np.empty_like(vectors)
    out[order] = vectors
    return values, out


def divided(d: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs of a symmetric tridiagonal matrix: two halves, and what ties them as a change of rank one."""
    n = len(d)
    if n == 1 or not np.any(e):
        return d.copy(), np.eye(n)
    k = n // 2
    tie, sign = abs(e[k - 1]), np.sign(e[k - 1]) or 1.0
    upper, lower = d[:k].copy(), d[k:].copy()
    upper[-1] -= tie
    lower[0] -= tie
    (d1, q1), (d2, q2) = divided(upper, e[: k - 1]), divided(lower, e[k:])
    q = np.zeros((n, n))
    q[:k, :k], q[k:, k:] = q1, q2
    both = np.concatenate((d1, d2))
    if tie == 0:
        return both, q
    values, v = merged(both, np.concatenate((q1[-1], sign * q2[0])) / np.sqrt(2), 2 * tie)
    return values, q @ v


def refined(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One quadratically converging step in extended precision; pairs so near that it would not be small are made orthogonal only."""
    a, x = a.astype(np.longdouble), x.astype(np.longdouble)
    r = np.eye(len(a)) - x.T @ x
    s = x.T @ a @ x
    value = np.diag(s) / (1 - np.diag(r))
    size = lambda m: float(np.sqrt(np.sum(m * m)))
    near = 2 * (size(s - np.diag(value)) + size(a) * size(r))
    apart = value[None, :] - value[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        e = np.where(np.abs(apart) > near, (s + value[None, :] * r) / apart, 0)
    small = (np.abs(apart) > near) & (np.abs(e) < 1e-9)
    # Turned by the antisymmetric part, made orthogonal by the symmetric one.
    e = np.where(small & small.T, (e - e.T) / 2, 0) + r / 2
    return value, x + x @ e


def eigenpairs(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns. `a` may have extended precision."""
    n = len(a)
    if not n:
        return np.zeros(0), np.zeros((0, 0))
    scale = float(np.abs(a).max()) or 1.0
    d, e, q = tridiagonal((a / scale).astype(np.float64))
    e[np.abs(e) <= EPS / 16 * max(np.abs(d).max(), np.abs(e).max(initial=0.0))] = 0  # below the rounding of the whole matrix
    _, v = divided(d, e)
    values, vectors = refined(a / scale, q @ v)
    vectors = vectors / np.sqrt(np.sum(vectors * vectors, axis=0))
    order = np.argsort(-values, kind="stable")
    return (values[order] * scale).astype(np.float64), vectors[:, order].astype(np.float64)
