"""Minimisation within bounds from values and slopes; what they are sums over, a task's arrays or a whole table, is the caller's."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def minimised(f: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, lower: np.ndarray | None = None, upper: np.ndarray | None = None, steps: int = 100, least: float = 1e-7, memory: int = 8) -> tuple[np.ndarray, float]:
    """x and f(x) after limited-memory quasi-Newton steps, each shortened until f falls; x stays within its bounds.

    Coordinates at a bound that would leave it take no part in a step.  Ends where a step gains less than `least` of f.
    """
    low = np.full(len(start), -np.inf) if lower is None else np.asarray(lower, float)
    high = np.full(len(start), np.inf) if upper is None else np.asarray(upper, float)
    x = np.clip(np.asarray(start, float), low, high)
    value, g = f(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        free = ~((x <= low) & (g > 0) | (x >= high) & (g < 0))
        q, tips = np.where(free, g, 0.0), []
        if not np.abs(q).max(initial=0):
            break
        for s, y in reversed(pairs):
            a = s @ q / (s @ y)
            tips.append(a)
            q = q - a * y
        if pairs:
            s, y = pairs[-1]
            q = q * (s @ y) / (y @ y)
        else:
            q = q / max(1.0, np.abs(q).max())
        for (s, y), a in zip(pairs, reversed(tips), strict=True):
            q = q + s * (a - y @ q / (s @ y))
        way = np.where(free, -q, 0.0)
        if way @ g >= 0:
            way, pairs = np.where(free, -g, 0.0), []
        size, gained = 1.0, False
        for _ in range(25):
            new = np.clip(x + size * way, low, high)
            v, h = f(new)
            if v <= value + 1e-4 * g @ (new - x) and np.isfinite(v):
                gained = True
                break
            size /= 2.5
        if not gained:
            if not pairs:
                break
            pairs = []  # once more along the slope
            continue
        s, y, fell = new - x, h - g, value - v
        if s @ y > 1e-12 * (y @ y):
            pairs = [*pairs[1 - memory :], (s, y)] if memory > 1 else [(s, y)]
        x, value, g = new, v, h
        if fell <= least * (abs(value) + 1e-12):
            break
    return x, float(value)
