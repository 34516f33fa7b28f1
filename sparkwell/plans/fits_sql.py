"""DuckDB SQL for fits and draws, written out step by step.

Iterations become chains of common table expressions: one aggregates the data
under the coefficients before, the next solves the system.
"""

from __future__ import annotations

import math


def uniform(seed: int | str, *keys: str) -> str:
    """The number that ``functions.expr.uniform`` draws for the keys.  A seed given
    as text is an SQL expression."""
    parts = [f"{seed}" if isinstance(seed, str) else f"'{seed}'", *keys]
    text = " || '|' || ".join(f"({p})::VARCHAR" for p in parts)
    return f"(('0x' || substr(md5({text}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


_SOLVED = "(c * u - b * v) / (a * c - b * b)", "(a * v - b * u) / (a * c - b * b)"
_SUMS = "sum(w) a, sum(w * x) b, sum(w * x * x) c, sum({t}) u, sum({t} * x) v"
_BOTH = "SELECT 0 AS term, round(b0, {d}) + 0.0::DOUBLE AS coefficient FROM {last} UNION ALL SELECT 1, round(b1, {d}) + 0.0::DOUBLE FROM {last}"


def _start(target: str) -> list[str]:
    return [
        f"s0 AS (SELECT {_SUMS.format(t='w * ' + target)} FROM r)",
        f"b0 AS (SELECT {_SOLVED[0]} b0, {_SOLVED[1]} b1 FROM s0)",
    ]


def newton(rows: str, start: str, mean: str, curvature: str, steps: int, digits: int = 5) -> str:
    """Coefficients of a constant and ``x`` for ``rows`` with ``x`` and ``y``: least
    squares on ``start``, then steps with the mean (of ``e``) and the curvature
    (of ``m``)."""
    chain = [f"r AS MATERIALIZED (SELECT x, y, 1.0::DOUBLE w, {start} z FROM ({rows}))", *_start("z")]
    for k in range(1, steps + 1):
        chain += [
            f"m{k} AS (SELECT x, y, b0, b1, {mean.replace('e_', f'(b0 + b1 * x)')} m FROM r, b{k - 1})",
            f"s{k} AS MATERIALIZED (SELECT any_value(b0) b0, any_value(b1) b1, {_SUMS.format(t='(y - m)')} FROM (SELECT *, {curvature} w FROM m{k}))",
            f"b{k} AS (SELECT b0 + {_SOLVED[0]} b0, b1 + {_SOLVED[1]} b1 FROM s{k})",
        ]
    return f"WITH {', '.join(chain)} " + _BOTH.format(d=digits, last=f"b{steps}")


def least_absolute(rows: str, steps: int, digits: int) -> str:
    """Reweighted least squares for ``rows`` with ``x``, ``y`` and the weight ``w0``."""
    chain = [f"r AS MATERIALIZED (SELECT x, y, w0, w0 w FROM ({rows}))", *_start("y")]
    for k in range(1, steps + 1):
        chain += [
            f"s{k} AS MATERIALIZED (SELECT {_SUMS.format(t='w * y')} FROM (SELECT x, y, w0 / greatest(abs(y - b0 - b1 * x), 1e-6::DOUBLE) w FROM r, b{k - 1}))",
            f"b{k} AS (SELECT {_SOLVED[0]} b0, {_SOLVED[1]} b1 FROM s{k})",
        ]
    return f"WITH {', '.join(chain)} " + _BOTH.format(d=digits, last=f"b{steps}")


def three_lags(series: str, digits: int = 6) -> str:
    """Centred least squares on three lags, by Cramer's rule.  ``series`` ends in a
    table ``t`` of ``day`` and ``x``."""
    names = ["y1", "y2", "y3"]
    sums = [f"sum({a} * {b}) {a}{b}" for i, a in enumerate(names) for b in [*names[i:], "z"]]

    def det(rows: list[list[str]]) -> str:
        (a, b, c), (d, e, f), (g, h, i) = rows
        return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"

    gram = [[f"{min(a, b)}{max(a, b)}" for b in names] for a in names]
    terms = []
    for k in range(3):
        swapped = [[f"{names[i]}z" if j == k else x for j, x in enumerate(row)] for i, row in enumerate(gram)]
        terms.append(f"SELECT {k} AS term, round({det(swapped)} / {det(gram)}, {digits}) + 0.0::DOUBLE AS coefficient FROM g")
    return (
        series + ', k AS (SELECT "day", x - (SELECT avg(x) FROM t) z FROM t), '
        'l AS (SELECT z, lag(z) OVER w y1, lag(z, 2) OVER w y2, lag(z, 3) OVER w y3 FROM k WINDOW w AS (ORDER BY "day")), '
        f"g AS MATERIALIZED (SELECT {', '.join(sums)} FROM l WHERE y3 IS NOT NULL) " + " UNION ALL ".join(terms)
    )


def moving_average(source: str, passes: int) -> list[str]:
    """Tables ``h0`` to ``h{passes}`` with the coefficient ``q`` of a moving average
    of order one fitted to ``z`` (centred) of table ``source``."""
    chain = [f'e0 AS MATERIALIZED (SELECT "day", z, z e FROM {source})']
    for k in range(1, passes + 1):
        chain += [
            f'l{k} AS MATERIALIZED (SELECT "day", z, coalesce(lag(e) OVER (ORDER BY "day"), 0) s FROM e{k - 1})',
            f"h{k} AS MATERIALIZED (SELECT sum(s * z) / sum(s * s) q FROM l{k})",
            f'e{k} AS MATERIALIZED (SELECT "day", z, z - q * s e FROM l{k}, h{k})',
        ]
    return chain


def capture_recapture(rows: str, n_lists: int, steps: int, rate: float, decay: float) -> str:
    """The number of all from ``rows`` with ``x`` and ``y0`` ..., by Lion steps."""
    names = [f"{i}{j}" for i in range(n_lists) for j in (0, 1)]
    seen = " + ".join(f"y{i}" for i in range(n_lists))

    def chances(of: str) -> str:
        p = ", ".join(f"1 / (1 + exp(-(b{i}0 + b{i}1 * x))) p{i}" for i in range(n_lists))
        missed = " * ".join(f"(1 - p{i})" for i in range(n_lists))
        return f"SELECT *, {missed} missed FROM (SELECT *, {p} FROM r, {of})"

    chain = [
        f"r AS MATERIALIZED (SELECT * FROM ({rows}) WHERE {seen} > 0)",
        f"c0 AS (SELECT {', '.join(f'0.0::DOUBLE b{n}, 0.0::DOUBLE m{n}' for n in names)})",
    ]
    for k in range(steps):
        kept = ", ".join(f"any_value(b{n}) b{n}, any_value(m{n}) m{n}" for n in names)
        pulls = ", ".join(
            f"-avg((y{i} - p{i} - p{i} * missed / (1 - missed)){' * x' if j else ''}) g{i}{j}" for i in range(n_lists) for j in (0, 1)
        )
        size = rate * (1 - k / steps)
        moved = ", ".join(f"b{n} - {size!r}::DOUBLE * (sign(0.9::DOUBLE * m{n} + 0.1::DOUBLE * g{n}) + {decay!r}::DOUBLE * b{n}) b{n}, 0.99::DOUBLE * m{n} + 0.01::DOUBLE * g{n} m{n}" for n in names)
        chain += [f"g{k} AS MATERIALIZED (SELECT {kept}, {pulls} FROM ({chances(f'c{k}')}))", f"c{k + 1} AS MATERIALIZED (SELECT {moved} FROM g{k})"]
    return f"WITH {', '.join(chain)} SELECT round(sum(1 / (1 - missed)), 3) AS n_hat FROM ({chances(f'c{steps}')})"


def poisson_copies(u: str) -> str:
    """A Poisson number with mean one from the uniform number ``u``."""
    steps, step, below = [], math.exp(-1), 0.0
    for k in range(1, 18):
        below += step
        step /= k
        steps.append(f"({u} >= {below!r}::DOUBLE)::INT")
    return " + ".join(steps)


def normal(seed: int | str, *keys: str) -> str:
    """The number that ``functions.expr.normal`` draws."""
    first, second = (f"(2 * ({seed}) + {i})" for i in (0, 1))
    return f"sqrt(-2 * ln(greatest({uniform(first, *keys)}, 1e-300::DOUBLE))) * cos(2 * pi() * {uniform(second, *keys)})"


def gamma(shape: float, seed: int, *keys: str) -> str:
    """Marsaglia and Tsang's first candidate that is taken, for a shape of one or
    more and scale one."""
    d = shape - 1 / 3
    v = f"pow(1 + {1 / math.sqrt(9 * d)!r}::DOUBLE * r.z, 3)"
    drawn = f"{{'z': {normal(f'{seed * 101} + i', *keys)}, 'u': greatest({uniform(f'({seed * 103 + 1} + 7 * i)', *keys)}, 1e-300::DOUBLE)}}"
    taken = f"{v} > 0 AND ln(r.u) < 0.5 * r.z * r.z + {d!r}::DOUBLE - {d!r}::DOUBLE * {v} + {d!r}::DOUBLE * ln(CASE WHEN {v} > 0 THEN {v} ELSE 1 END)"
    found = f"list_transform(list_filter(list_transform(range(0, 16), lambda i: {drawn}), lambda r: {taken}), lambda r: {d!r}::DOUBLE * {v})"
    return f"coalesce({found}[1], {d!r}::DOUBLE)"


def first_above(u: str, probabilities: list[float]) -> str:
    """The smallest whole number whose distribution function reaches ``u``."""
    below, total = [], 0.0
    for p in probabilities[:-1]:
        total += p
        below.append(f"({u} > {total + 1e-12!r}::DOUBLE)::INT")
    return "(" + " + ".join(below) + ")::DOUBLE"
