"""Driver-side optimisers.  An objective or gradient may run one aggregation over
data; parameters are small arrays."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Vec = np.ndarray
Grad = Callable[[Vec], Vec]
Objective = Callable[[Vec], float]


def adadelta(x: Vec, grad: Grad, steps: int, rho: float = 0.9, eps: float = 1e-5) -> Vec:
    x, g2, d2 = np.array(x, float), np.zeros(len(x)), np.zeros(len(x))
    for _ in range(steps):
        g = grad(x)
        g2 = rho * g2 + (1 - rho) * g * g
        d = -np.sqrt(d2 + eps) / np.sqrt(g2 + eps) * g
        d2 = rho * d2 + (1 - rho) * d * d
        x = x + d
    return x


def adagrad(x: Vec, grad: Grad, steps: int, rate: float = 0.001, eps: float = 1e-8) -> Vec:
    x, g2 = np.array(x, float), np.zeros(len(x))
    for _ in range(steps):
        g = grad(x)
        g2 = g2 + g * g
        x = x - rate * g / (np.sqrt(g2) + eps)
    return x


def _adam(x: Vec, grad: Grad, steps: int, rate: float, b1: float, b2: float, eps: float, decay: float, second) -> Vec:
    x, m, v = np.array(x, float), np.zeros(len(x)), np.zeros(len(x))
    for t in range(1, steps + 1):
        g = grad(x)
        m = b1 * m + (1 - b1) * g
        v = second(v, g * g, b2)
        x = x - rate * (m / (1 - b1**t) / (np.sqrt(v / (1 - b2**t)) + eps) + decay * x)
    return x


def adam(x: Vec, grad: Grad, steps: int, rate: float = 0.001, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8) -> Vec:
    return _adam(x, grad, steps, rate, b1, b2, eps, 0.0, lambda v, g2, b: b * v + (1 - b) * g2)


def adamw(x: Vec, grad: Grad, steps: int, rate: float = 0.001, decay: float = 0.01, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8) -> Vec:
    return _adam(x, grad, steps, rate, b1, b2, eps, decay, lambda v, g2, b: b * v + (1 - b) * g2)


def yogi(x: Vec, grad: Grad, steps: int, rate: float = 0.01, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-3) -> Vec:
    return _adam(x, grad, steps, rate, b1, b2, eps, 0.0, lambda v, g2, b: v - (1 - b) * np.sign(v - g2) * g2)


def lion(x: Vec, grad: Grad, steps: int, rate: float = 0.001, b1: float = 0.9, b2: float = 0.99, decay: float = 0.01) -> Vec:
    x, m = np.array(x, float), np.zeros(len(x))
    for _ in range(steps):
        g = grad(x)
        x = x - rate * (np.sign(b1 * m + (1 - b1) * g) + decay * x)
        m = b2 * m + (1 - b2) * g
    return x


def rmsprop(x: Vec, grad: Grad, steps: int, rate: float = 0.001, gamma: float = 0.999, eps: float = 1e-8) -> Vec:
    x, v = np.array(x, float), np.zeros(len(x))
    for _ in range(steps):
        g = grad(x)
        v = gamma * v + (1 - gamma) * g * g
        x = x - rate * g / (np.sqrt(v) + eps)
    return x


def proximal_gradient(x: Vec, grad: Grad, penalty: Objective, steps: int, rate: float = 0.1, inner: int = 200) -> Vec:
    """Of a smooth part and a penalty, whose proximal point an inner coordinate
    search finds."""
    x = np.array(x, float)
    for _ in range(steps):
        z = x - rate * grad(x)
        x = coordinate_descent(z, lambda u, z=z: float(((u - z) ** 2).sum()) / (2 * rate) + penalty(u), inner)
    return x


def gauss_newton(x: Vec, grad: Grad, hess: Callable[[Vec], np.ndarray], steps: int) -> Vec:
    x = np.array(x, float)
    for _ in range(steps):
        x = x - np.linalg.solve(hess(x), grad(x))
    return x


def _damped(x: Vec, error: Callable[[Vec], Vec], jacobian: Callable[[Vec], np.ndarray], steps: int, damp) -> Vec:
    x, lam = np.array(x, float), 1e-3
    e = error(x)
    for _ in range(steps):
        j = jacobian(x)
        a = j.T @ j
        new = x - np.linalg.solve(a + damp(a, lam), j.T @ e)
        e2 = error(new)
        if e2 @ e2 <= e @ e:
            x, e, lam = new, e2, lam / 10
        else:
            lam *= 10
    return x


def levenberg(x: Vec, error: Callable[[Vec], Vec], jacobian: Callable[[Vec], np.ndarray], steps: int) -> Vec:
    return _damped(x, error, jacobian, steps, lambda a, lam: lam * np.eye(len(a)))


def marquardt(x: Vec, error: Callable[[Vec], Vec], jacobian: Callable[[Vec], np.ndarray], steps: int) -> Vec:
    return _damped(x, error, jacobian, steps, lambda a, lam: lam * np.diag(np.diag(a)))


def third_order(x: Vec, grad: Grad, hess: Callable[[Vec], np.ndarray], steps: int) -> Vec:
    """A Newton step, then one with Simpson's mean of the Hessians at its start,
    middle and end."""
    x = np.array(x, float)
    for _ in range(steps):
        g, h = grad(x), hess(x)
        y = x - np.linalg.solve(h, g)
        mean = (h + 4 * hess((x + y) / 2) + hess(y)) / 6
        x = x - np.linalg.solve(mean, g)
    return x


def minimise_on_simplex(p: int, grad: Grad, steps: int, rate: float = 0.05) -> Vec:
    """Weights that sum to one, by softmax and Adam."""

    def chain(z: Vec) -> Vec:
        w = np.exp(z - z.max())
        w = w / w.sum()
        g = grad(w)
        return w * (g - w @ g)

    z = adam(np.zeros(p), chain, steps, rate)
    w = np.exp(z - z.max())
    return w / w.sum()


def binary_quadratic(n: int, grad: Grad, steps: int = 500, rate: float = 0.05) -> Vec:
    """0/1 vector by mirror descent on tanh coordinates, rounded."""
    z = np.zeros(n)
    for _ in range(steps):
        x = (1 + np.tanh(z)) / 2
        z = np.clip(z - rate * grad(x), -20, 20)
    return (z > 0).astype(float)


def _project_binary(c: Vec, a: np.ndarray, b: Vec, steps: int, pull) -> Vec:
    x = np.full(len(c), 0.5)
    for t in range(steps):
        violation = np.maximum(0, a @ x - b)
        g = c + 10 * a.T @ violation + pull(x, t)
        x = np.clip(x - g / (10 + 10 * np.linalg.norm(a) ** 2 + t * 0.01), 0, 1)
    return repair(np.round(x), c, a, b)


def repair(x: Vec, c: Vec, a: np.ndarray, b: Vec) -> Vec:
    """Feasible rounding of ``a x <= b``: single flips that lessen the violation
    most, then single flips that lessen the cost."""
    x = x.copy()
    for penalty in (True, False):
        for _ in range(4 * len(x)):
            flips = np.eye(len(x)) * (1 - 2 * x)
            now = np.maximum(0, a @ x - b).sum()
            after = np.array([np.maximum(0, a @ (x + f) - b).sum() for f in flips])
            gain = now - after if penalty else np.where(after <= 1e-12, -(flips @ c), -np.inf)
            k = int(np.argmax(gain))
            if gain[k] <= 1e-12:
                break
            x = x + flips[k]
    return x


def binary_linear_penalty(c: Vec, a: np.ndarray, b: Vec, steps: int = 500, rho: float = 0.1) -> Vec:
    """min c'x, a x <= b, x binary: exact penalty that grows towards the corners."""
    return _project_binary(np.asarray(c, float), np.asarray(a, float), np.asarray(b, float), steps, lambda x, t: -rho * min(1, t / steps) * (2 * x - 1))


def binary_linear_admm(c: Vec, a: np.ndarray, b: Vec, steps: int = 500, rho: float = 0.1) -> Vec:
    """The same with a multiplier on the distance from the corners."""
    u = np.zeros(len(c))

    def pull(x: Vec, t: int) -> Vec:
        nonlocal u
        corner = np.round(x)
        u = 0.9 * u + (x - corner)
        return rho * (x - corner + u)

    return _project_binary(np.asarray(c, float), np.asarray(a, float), np.asarray(b, float), steps, pull)


# Coordinate descent on an objective.


def _slope(f: Objective, x: Vec, i: int, h: float = 1e-5) -> tuple[float, float]:
    e = np.zeros(len(x))
    e[i] = h
    up, at, down = f(x + e), f(x), f(x - e)
    return (up - down) / (2 * h), (up - 2 * at + down) / (h * h)


def _newton_move(f: Objective, x: Vec, i: int) -> Vec:
    g, c = _slope(f, x, i)
    move = -g / c if c > 1e-8 else -0.1 * g
    here = f(x)
    for _ in range(30):
        y = x.copy()
        y[i] += move
        if f(y) <= here:
            return y
        move /= 2
    return x


def _gradient(f: Objective, x: Vec) -> Vec:
    return np.array([_slope(f, x, i)[0] for i in range(len(x))])


def coordinate_descent(x: Vec, f: Objective, steps: int, order: str = "cyclic", seed: int = 1) -> Vec:
    """Newton-like moves, one coordinate a step: ``cyclic``, ``random``, ``greedy``
    (largest slope) or ``sweep`` (all, largest slope first)."""
    x, rng = np.array(x, float), np.random.default_rng(seed)
    for t in range(steps):
        if order == "cyclic":
            picks = [t % len(x)]
        elif order == "random":
            picks = [int(rng.integers(len(x)))]
        else:
            ranked = np.argsort(-np.abs(_gradient(f, x)), kind="stable")
            picks = ranked[:1].tolist() if order == "greedy" else ranked.tolist()
        for i in picks:
            x = _newton_move(f, x, i)
    return x


def steepest_coordinate(x: Vec, f: Objective, steps: int, rate: float = 0.01) -> Vec:
    x = np.array(x, float)
    for _ in range(steps):
        g = _gradient(f, x)
        i = int(np.argmax(np.abs(g)))
        x[i] -= rate * g[i]
    return x


def accelerated_coordinate(x: Vec, f: Objective, steps: int, rate: float = 0.01, pick: str = "greedy", seed: int = 1) -> Vec:
    """Nesterov's two sequences.  ``pick``: ``greedy`` and ``random`` choose one
    coordinate for both, ``semigreedy`` a greedy one for x and a random one for z."""
    x, rng, n = np.array(x, float), np.random.default_rng(seed), len(x)
    z, theta = x.copy(), 1 / n
    for _ in range(steps):
        y = (1 - theta) * x + theta * z
        g = _gradient(f, y)
        greedy, chance = int(np.argmax(np.abs(g))), int(rng.integers(n))
        i = chance if pick == "random" else greedy
        j = greedy if pick == "greedy" else chance
        x = y.copy()
        x[i] -= rate * g[i]
        z[j] -= rate / (n * theta) * g[j]
        theta = (np.sqrt(theta**4 + 4 * theta**2) - theta**2) / 2
    return x


def block_descent(x: Vec, f: Objective, size: int, steps: int, order: str = "cyclic", rate: float = 0.1, seed: int = 1) -> Vec:
    """Gradient steps in blocks of ``size`` coordinates, halved until they help."""
    x, rng, n = np.array(x, float), np.random.default_rng(seed), len(x)
    for t in range(steps):
        g = _gradient(f, x)
        if order == "cyclic":
            block = [(t * size + k) % n for k in range(size)]
        elif order == "random":
            block = rng.choice(n, min(size, n), replace=False).tolist()
        else:
            block = np.argsort(-np.abs(g), kind="stable")[:size].tolist()
        move = np.zeros(n)
        move[block] = -rate * g[block]
        here = f(x)
        for _ in range(30):
            if f(x + move) <= here:
                x = x + move
                break
            move /= 2
    return x


def learning_rate(step: int, steps: int) -> float:
    """Falls from one by a half cosine."""
    return 0.5 * (1 + np.cos(np.pi * step / steps))


def adaptive_block_descent(x: Vec, f: Objective, steps: int, rate: float = 0.1) -> Vec:
    """Blocks are the coordinates whose slope is at least the trimean of all."""
    x = np.array(x, float)
    for t in range(steps):
        g = np.abs(_gradient(f, x))
        q = np.quantile(g, [0.25, 0.5, 0.75])
        size = max(1, int((g >= (q[0] + 2 * q[1] + q[2]) / 4).sum()))
        x = block_descent(x, f, size, 1, "greedy", rate * max(0.05, learning_rate(t, steps)))
    return x
