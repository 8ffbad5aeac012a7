"""Linear SVM on mapped features that are made anew in every pass.

The machine of MLlib's ``LinearSVC`` (same objective, same optimiser, same stopping
rules), for maps whose features are too large to keep: the rows before the map are kept
as ``Blocks``, and every pass maps a block, uses it and drops it.

Optimiser. OWL-QN as MLlib runs it, without an L1 term: L-BFGS with ten pairs over the
features divided by their standard deviations and centred, a weight that would change its
sign is set to 0, backtracking by strong Wolfe conditions. A pass evaluates the point
asked for and the two points that may follow it on the line, so that most steps take one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from panelkit.models.batched import Blocks, sum_over_rows

MEMORY, MEMORY_OF_VALUES = 10, 20
SHRINK_FIRST, SHRINK, GROW = 0.1, 0.5, 2.1
ARMIJO, WOLFE, LINE_STEPS, MIN_STEP, MAX_STEP = 1e-4, 0.9, 20, 1e-10, 1e10


class LineFailed(Exception):
    """No step along the direction will do."""


def fit_linear_svm(data: Blocks, features: list[str], label: str, make: Callable[[np.ndarray], np.ndarray], width: int, cost: float,
                   n_rows: int | None, max_iter: int, tol: float) -> tuple[np.ndarray, float, int]:
    """Coefficients, intercept and iterations of the machine on ``make(rows x features)``, labels 0/1;
    ``cost`` counts for ``n_rows`` rows (all)."""
    p, columns = len(features), [*features, label]
    n, *total = sum_over_rows(data, columns, lambda b: np.concatenate([[len(b)], make(b[:, :p]).sum(0)]), 1 + width)
    if not n:
        raise ValueError("no complete rows")
    mean, reg = np.array(total) / n, 1.0 / (cost * (n if n_rows is None else n_rows))
    square = sum_over_rows(data, columns, lambda b: ((make(b[:, :p]) - mean) ** 2).sum(0), width)
    std = np.sqrt(square / max(n - 1, 1))
    inverse = np.divide(1.0, std, out=np.zeros(width), where=std > 0)
    centre = mean * inverse

    def evaluate(points: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
        at = np.array(points)
        slopes, offsets = (at[:, :-1] * inverse).T, at[:, -1] - at[:, :-1] @ centre

        def block(b: np.ndarray) -> np.ndarray:
            z, sign = make(b[:, :p]), 2 * b[:, p] - 1
            short = 1 - sign[:, None] * (z @ slopes + offsets)
            push = np.where(short > 0, -sign[:, None], 0.0)
            return np.column_stack([np.maximum(short, 0.0).sum(0), push.T @ z, push.sum(0)]).ravel()

        sums = sum_over_rows(data, columns, block, len(at) * (2 + width)).reshape(len(at), -1) / n
        told = []
        for x, row in zip(at, sums):
            pull = reg * x[:-1] * inverse ** 2
            told.append((row[0] + 0.5 * float(pull @ x[:-1]), np.append(row[1:-1] * inverse - row[-1] * centre + pull, row[-1])))
        return told

    x, iterations = owlqn(evaluate, np.zeros(width + 1), max_iter, tol)
    return x[:-1] * inverse, float(x[-1] - x[:-1] @ centre), iterations


def owlqn(evaluate: Callable[[list[np.ndarray]], list[tuple[float, np.ndarray]]], x: np.ndarray, max_iter: int, tol: float) -> tuple[np.ndarray, int]:
    """The point where the values stand still, and the steps taken. ``evaluate`` gives value and gradient at several points."""
    (value, grad), = evaluate([x])
    first, values, pairs, it, failed = value, [np.inf], [], 0, False
    while not (it >= max_iter or len(values) >= 2 and abs(value - max(values)) <= tol * abs(first)
               or np.linalg.norm(grad) <= max(tol * abs(value), 1e-8)):
        try:
            way = direction(grad, pairs)
            new = search(evaluate, x, value, grad, way, it)
        except LineFailed:
            if failed:
                break
            failed, pairs = True, []
            continue
        failed = False
        pairs = [(new[0] - x, new[2] - grad), *pairs][:MEMORY]
        x, value, grad = new
        values, it = [*values, value][-MEMORY_OF_VALUES:], it + 1
    return x, it


def direction(grad: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    q, kept = grad.copy(), []
    for s, y in pairs:
        a = float(s @ q) / float(s @ y) if s @ y else np.nan
        if np.isnan(a):
            raise LineFailed
        q -= a * y
        kept.append(a)
    if pairs:
        s, y = pairs[0]
        if s @ y < 0:
            raise LineFailed
        q *= float(s @ y) / float(y @ y)
    for (s, y), a in zip(reversed(pairs), reversed(kept)):
        q += s * (a - float(y @ q) / float(s @ y))
    return np.where(-q * grad < 0, -q, 0.0)


def search(evaluate, x: np.ndarray, value: float, grad: np.ndarray, way: np.ndarray, it: int) -> tuple[np.ndarray, float, np.ndarray]:
    """Point, value and gradient that end the line."""
    orthant, shrink = np.sign(np.where(x != 0, x, -grad)), SHRINK if it else SHRINK_FIRST
    slope, step, known = float(grad @ way), 1.0 if it else 0.5 / float(np.linalg.norm(grad)), {}

    def point(s: float) -> np.ndarray:
        to = x + way * s
        return np.where(np.sign(to) == orthant, to, 0.0)

    # MLlib's search judges its first step by the value it starts from, which always shortens it
    k = int(slope < 0)
    step *= shrink ** k
    while True:
        if step not in known:
            steps = [step, step * shrink, step * GROW]
            known.update(zip(steps, evaluate([point(s) for s in steps])))
        new, new_grad = known[step]
        along = float(new_grad @ way)
        if new > value + step * slope * ARMIJO:
            factor = shrink
        elif along < WOLFE * slope:
            factor = GROW
        elif along > -WOLFE * slope:
            factor = shrink
        else:
            return point(step), new, new_grad
        step *= factor
        if k >= LINE_STEPS or not MIN_STEP <= step <= MAX_STEP:
            raise LineFailed
        k += 1
