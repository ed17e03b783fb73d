"""Maximum likelihood of GARCH(1,1) and GJR with Student-t errors for many series at once, by a bounded quasi-Newton search
with analytic gradients.

Series of a batch are the columns of one array: a step of the variance recursion, of its derivatives and of the search is one
numpy operation over all of them. Series that have converged leave the search.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

#: Bounds of the free numbers (mean, log level, persistence, share of beta, log of nu - 2.05, split of the pull).
LOWER, UPPER = np.array([-5.0, -25.0, -8.0, -8.0, -6.0, -8.0]), np.array([5.0, 12.0, 12.0, 16.0, 8.0, 8.0])
LARGEST, MIN_OBS = 0.9999, 100


def digamma(x: np.ndarray) -> np.ndarray:
    """By recurrence up to 6, then the asymptotic series."""
    x, out = np.array(x, float), np.zeros_like(x, float)
    for _ in range(6):
        low = x < 6
        out[low] -= 1 / x[low]
        x[low] += 1
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def natural(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Free numbers (series, 5 or 6) to (mu, omega, alpha, beta, gamma, nu) as rows, and their derivatives
    (parameter, free number, series). alpha + beta + gamma / 2 stays below LARGEST, nu above 2.05."""
    n, k = q.shape
    total, share = LARGEST * _sigmoid(q[:, 2]), _sigmoid(q[:, 3])
    half = _sigmoid(q[:, 5]) if k == 6 else np.ones(n)
    d_total, d_share, d_half = total * (1 - total / LARGEST), share * (1 - share), half * (1 - half)
    pull = total * (1 - share)
    p = np.stack([q[:, 0], np.exp(q[:, 1]), pull * half, total * share, 2 * pull * (1 - half), 2.05 + np.exp(q[:, 4])])
    d = np.zeros((6, k, n))
    d[0, 0], d[1, 1], d[5, 4] = 1, p[1], p[5] - 2.05
    d[2, 2], d[3, 2], d[4, 2] = (1 - share) * half * d_total, share * d_total, 2 * (1 - share) * (1 - half) * d_total
    d[2, 3], d[3, 3], d[4, 3] = -total * half * d_share, total * d_share, -2 * total * (1 - half) * d_share
    if k == 6:
        d[2, 5], d[4, 5] = pull * d_half, -2 * pull * d_half
    return p, d


def variance_paths(p: np.ndarray, x: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Errors (day, series), variances (one day more), and the variances' derivatives (day, parameter, series)."""
    mu, omega, alpha, beta, gamma = p[:5]
    e = x - mu
    below = e < 0
    squares = e * e
    weight = alpha + gamma * below
    added = omega + weight * squares
    step = np.stack([-2 * weight * e, np.ones_like(e), squares, np.zeros_like(e), below * squares], 1)
    h = omega + (alpha + beta + gamma / 2) * back
    d = np.stack([np.zeros_like(h), np.ones_like(h), back, back, back / 2])
    all_h, all_d = np.empty((len(x) + 1, len(h))), np.empty((len(x), 5, len(h)))
    for t in range(len(x)):
        all_h[t], all_d[t] = h, d
        d = beta * d + step[t]
        d[3] += h
        h = added[t] + beta * h
    all_h[-1] = h
    return e, all_h, all_d


def loss(q: np.ndarray, x: np.ndarray, n: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean negative log likelihood of each series and its gradient in the free numbers. x: (day, series), 0 after day n."""
    p, dp = natural(q)
    nu = p[5]
    with np.errstate(all="ignore"):
        e, h, d = variance_paths(p, x, back)
        h = h[:-1]
        w = (np.arange(len(x))[:, None] < n) / n
        squares, wide = e * e, h * (nu - 2)
        z = squares / wide
        const = _lgamma((nu + 1) / 2) - _lgamma(nu / 2) - 0.5 * np.log(np.pi * (nu - 2))
        out = -const + (w * (0.5 * np.log(h) + (nu + 1) / 2 * np.log1p(z))).sum(0)
        by_h = w * (0.5 / h - (nu + 1) / 2 * squares / (h * (wide + squares)))
        g = np.empty((6, len(n)))
        g[:5] = np.einsum("tb,tkb->kb", by_h, d)
        g[0] -= (w * (nu + 1) * e / (wide + squares)).sum(0)
        by_nu = w * (-0.5 * np.log1p(z) + (nu + 1) / 2 * z / ((nu - 2) * (1 + z)))
        g[5] = -(0.5 * (digamma((nu + 1) / 2) - digamma(nu / 2)) - 0.5 / (nu - 2)) - by_nu.sum(0)
        out = np.where(np.isfinite(out) & (h.min(0) > 0), out, np.inf)
        return out, np.einsum("kb,kjb->bj", g, dp)


def minimise_batch(f: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], q: np.ndarray, lower: np.ndarray, upper: np.ndarray, steps: int = 300, tol: float = 1e-7) -> tuple[np.ndarray, np.ndarray]:
    """(points, values): a projected BFGS search from every row of q. f(points, numbers of the rows) gives values and
    gradients."""
    q = np.clip(q, lower, upper)
    live = np.arange(len(q))
    best, g = f(q, live)
    inverse = np.tile(np.eye(q.shape[1]), (len(q), 1, 1))
    fresh = np.ones(len(q), bool)
    for _ in range(steps):
        held = ((q[live] <= lower) & (g[live] > 0)) | ((q[live] >= upper) & (g[live] < 0))
        pushed = np.where(held, 0.0, g[live])
        live_on = np.isfinite(best[live]) & (np.abs(pushed).max(1) > tol)
        live, pushed, held = live[live_on], pushed[live_on], held[live_on]
        if not len(live):
            break
        way = np.where(held, 0.0, -np.einsum("bij,bj->bi", inverse[live], pushed))
        slope = (way * pushed).sum(1)
        lost = ~(slope < 0)
        way[lost], inverse[live[lost]], fresh[live[lost]] = -pushed[lost], np.eye(q.shape[1]), True
        slope = (way * pushed).sum(1)
        shrink = np.minimum(1.0, 2.0 / np.maximum(np.abs(way).max(1), 1e-12))
        way, slope = way * shrink[:, None], slope * shrink
        step, wait, moved = np.ones(len(live)), np.arange(len(live)), np.zeros(len(live), bool)
        at, value, gradient = q[live].copy(), best[live].copy(), g[live].copy()
        for _ in range(30):
            trial = np.clip(q[live[wait]] + step[wait, None] * way[wait], lower, upper)
            v, dv = f(trial, live[wait])
            good = (v <= best[live[wait]] + 1e-4 * step[wait] * slope[wait]) & np.isfinite(dv).all(1)
            done = wait[good]
            at[done], value[done], gradient[done], moved[done] = trial[good], v[good], dv[good], True
            wait = wait[~good]
            if not len(wait):
                break
            step[wait] /= 2
        s, y = at - q[live], gradient - g[live]
        sy, yy = (s * y).sum(1), (y * y).sum(1)
        turn = moved & (sy > 1e-12)
        rows = live[turn]
        s, y, sy, yy = s[turn], y[turn], sy[turn], yy[turn]
        first = fresh[rows]
        inverse[rows[first]] *= (sy[first] / yy[first])[:, None, None]
        fresh[rows] = False
        left = np.eye(q.shape[1]) - s[:, :, None] * y[:, None, :] / sy[:, None, None]
        inverse[rows] = left @ inverse[rows] @ left.transpose(0, 2, 1) + s[:, :, None] * s[:, None, :] / sy[:, None, None]
        gain = best[live] - value
        q[live], best[live], g[live] = at, value, gradient
        live = live[moved & (gain > 1e-10)]
    return q, best


def fit_garch_batch(series: list[np.ndarray], asymmetric: bool = False, min_obs: int = MIN_OBS) -> list[dict[str, float]]:
    """Parameters, next variance (squared percent) and log likelihood of each series of returns."""
    short = next((len(r) for r in series if len(r) < min_obs), None)
    if short is not None:
        raise ValueError(f"{short} returns; at least {min_obs} are needed")
    n = np.array([len(r) for r in series])
    x = np.zeros((n.max(), len(n)))
    for b, r in enumerate(series):
        x[: len(r), b] = np.asarray(r) * 100
    inside = np.arange(len(x))[:, None] < n
    mean = x.sum(0) / n
    centred = np.where(inside, x - mean, 0.0)
    w = np.where(inside[:75], (0.94 ** np.arange(min(75, len(x))))[:, None], 0.0)
    back = (w * centred[:75] ** 2).sum(0) / w.sum(0)
    level = np.log(np.maximum((centred**2).sum(0) / n * 0.05, 1e-8))
    k = 6 if asymmetric else 5
    q = np.column_stack([mean, level, np.full(len(n), 3.0), np.full(len(n), 2.5), np.full(len(n), math.log(6.0)), np.zeros(len(n))])[:, :k]
    q, value = minimise_batch(lambda q, b: loss(q, x[:, b], n[b], back[b]), q, LOWER[:k], UPPER[:k])
    p, _ = natural(q)
    _, h, _ = variance_paths(p, x, back)
    names = ("mu", "omega", "alpha", "beta", "gamma", "nu")
    return [{**dict(zip(names, map(float, p[:, b]), strict=True)), "next_variance": float(h[n[b], b]), "loglik": float(-value[b] * n[b])} for b in range(len(n))]
