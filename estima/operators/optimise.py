"""Optimisers for the driver: they see functions of a few parameters, never rows."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np


def numeric_gradient(f: Callable, x: np.ndarray, h: float = 1e-6) -> np.ndarray:
    out = np.empty(len(x))
    for i in range(len(x)):
        step = h * max(1.0, abs(x[i]))
        up, down = x.copy(), x.copy()
        up[i] += step
        down[i] -= step
        out[i] = (f(up) - f(down)) / (2 * step)
    return out


def numeric_hessian(f: Callable, x: np.ndarray, h: float = 1e-4) -> np.ndarray:
    k = len(x)
    out, step = np.empty((k, k)), h * np.maximum(1.0, np.abs(x))
    base = f(x)
    e = np.diag(step)
    for i in range(k):
        out[i, i] = (f(x + e[i]) - 2 * base + f(x - e[i])) / step[i] ** 2
        for j in range(i):
            out[i, j] = out[j, i] = (f(x + e[i] + e[j]) - f(x + e[i] - e[j]) - f(x - e[i] + e[j]) + f(x - e[i] - e[j])) / (4 * step[i] * step[j])
    return out


def check_gradient(f: Callable, gradient: Callable, x: np.ndarray) -> float:
    """The largest relative gap between a gradient and finite differences."""
    a, b = np.asarray(gradient(x)), numeric_gradient(f, np.asarray(x, float))
    return float(np.max(np.abs(a - b) / (1 + np.abs(b))))


def minimise(f: Callable, start: np.ndarray, gradient: Callable | None = None, memory: int = 10, rounds: int = 500, tol: float = 1e-8) -> tuple[np.ndarray, float, bool]:
    """(x, f(x), converged) by L-BFGS with backtracking (Armijo) steps."""
    grad = gradient or (lambda x: numeric_gradient(f, x))
    x = np.asarray(start, float).copy()
    value, g = f(x), grad(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        if np.abs(g).max() <= tol * max(1.0, abs(value)):
            return x, value, True
        q, a = g.copy(), []
        for s, y in reversed(pairs):
            a.append(s @ q / (s @ y))
            q -= a[-1] * y
        if pairs:
            s, y = pairs[-1]
            q *= s @ y / (y @ y)
        else:
            q /= max(1.0, np.abs(g).max())
        for (s, y), c in zip(pairs, reversed(a)):
            q += (c - y @ q / (s @ y)) * s
        slope = g @ q
        if not slope > 0:
            q, slope, pairs = g.copy(), g @ g, []
        step = 1.0
        while True:
            new = x - step * q
            now = f(new)
            if math.isfinite(now) and now <= value - 1e-4 * step * slope:
                break
            step /= 2
            if step < 1e-16:
                return x, value, False
        g_new = grad(new)
        s, y = new - x, g_new - g
        if s @ y > 1e-12 * math.sqrt((s @ s) * (y @ y)):
            pairs = [*pairs[-memory + 1 :], (s, y)]
        small = abs(value - now) <= 1e-14 * max(1.0, abs(value))
        x, value, g = new, now, g_new
        if small:
            return x, value, True
    return x, value, False


def prox_l1(z: np.ndarray, t: float) -> np.ndarray:
    return np.sign(z) * np.maximum(np.abs(z) - t, 0)


def prox_l2(z: np.ndarray, t: float) -> np.ndarray:
    return z / (1 + t)


def prox_elastic(z: np.ndarray, t: float, l1_ratio: float) -> np.ndarray:
    return prox_l1(z, t * l1_ratio) / (1 + t * (1 - l1_ratio))


def fista(gradient: Callable, prox: Callable, start: np.ndarray, step: float, rounds: int = 5000, tol: float = 1e-10) -> np.ndarray:
    """Accelerated proximal gradient: prox(z, step) after each gradient step."""
    x = y = np.asarray(start, float)
    t = 1.0
    for _ in range(rounds):
        new = prox(y - step * gradient(y), step)
        if (y - new) @ (new - x) > 0:
            t = 1.0
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        done = np.abs(new - x).max() < tol * (1 + np.abs(new).max())
        x, t = new, t_new
        if done:
            break
    return x


def golden(f: Callable[[float], float], low: float, high: float, tol: float = 1e-8) -> float:
    """Where a function of one number is smallest."""
    r = (math.sqrt(5) - 1) / 2
    a, b = high - r * (high - low), low + r * (high - low)
    fa, fb = f(a), f(b)
    while high - low > tol * (1 + abs(low) + abs(high)):
        if fa < fb:
            high, b, fb = b, a, fa
            a = high - r * (high - low)
            fa = f(a)
        else:
            low, a, fa = a, b, fb
            b = low + r * (high - low)
            fb = f(b)
    return (low + high) / 2


def branch_and_bound(c, a, b, most: int = 10_000) -> tuple[list[int] | None, float, int]:
    """(x, c x, nodes) of the 0/1 programme min c x with a x <= b; None if nothing is feasible. The bound is the sum of
    the negative costs that are still free."""
    c, a, b = np.asarray(c, float), np.atleast_2d(np.asarray(a, float)), np.asarray(b, float)
    n, best, at, nodes = len(c), math.inf, None, 0
    order = np.argsort(-np.abs(c), kind="stable")
    rest = np.concatenate([np.cumsum(np.minimum(c[order], 0)[::-1])[::-1], [0.0]])
    least = np.concatenate([np.cumsum(np.minimum(a[:, order], 0)[:, ::-1], axis=1)[:, ::-1], np.zeros((len(b), 1))], axis=1)
    stack = [(0, 0.0, np.zeros(len(b)), ())]
    while stack and nodes < most:
        depth, cost, used, x = stack.pop()
        nodes += 1
        if cost + rest[depth] >= best or (used + least[:, depth] > b + 1e-9).any():
            continue
        if depth == n:
            best, at = cost, x
            continue
        j = order[depth]
        first = 1 if c[j] < 0 else 0
        for v in (1 - first, first):
            stack.append((depth + 1, cost + c[j] * v, used + a[:, j] * v, (*x, v)))
    if at is None:
        return None, math.inf, nodes
    out = [0] * n
    for j, v in zip(order, at):
        out[j] = v
    return out, float(best), nodes


def simplex_projection(v: np.ndarray) -> np.ndarray:
    """The nearest point whose parts are at least 0 and sum to 1."""
    u = np.sort(v)[::-1]
    total = np.cumsum(u) - 1
    k = np.nonzero(u - total / np.arange(1, len(v) + 1) > 0)[0][-1]
    return np.maximum(v - total[k] / (k + 1), 0)


def simplex_weights(gram: np.ndarray, cross: np.ndarray, rounds: int = 20_000, tol: float = 1e-12) -> np.ndarray:
    """min w'Gw - 2 w'c over the simplex, by accelerated projected gradient."""
    step = 1 / (2 * max(np.linalg.eigvalsh(gram).max(), 1e-300))
    return fista(lambda w: 2 * (gram @ w - cross), lambda z, _: simplex_projection(z), np.full(len(cross), 1 / len(cross)), step, rounds, tol)
