"""One-qubit states as a struct column ``(ar, ai, br, bi)`` and gates on it."""

from __future__ import annotations

import cmath
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import num, uniform

Gate = list[list[complex]]

I2: Gate = [[1, 0], [0, 1]]
X: Gate = [[0, 1], [1, 0]]
Y: Gate = [[0, -1j], [1j, 0]]
Z: Gate = [[1, 0], [0, -1]]
SQRT_NOT: Gate = [[(1 + 1j) / 2, (1 - 1j) / 2], [(1 - 1j) / 2, (1 + 1j) / 2]]
HADAMARD: Gate = [[1 / math.sqrt(2), 1 / math.sqrt(2)], [1 / math.sqrt(2), -1 / math.sqrt(2)]]


def rotation(axis: str, angle: float) -> Gate:
    c, s = math.cos(angle / 2), math.sin(angle / 2)
    if axis == "x":
        return [[c, -1j * s], [-1j * s, c]]
    if axis == "y":
        return [[c, -s], [s, c]]
    return [[cmath.exp(-0.5j * angle), 0], [0, cmath.exp(0.5j * angle)]]


def phase_shift(delta: float, mode: str = "standard") -> Gate:
    """The reference turns both amplitudes."""
    turn = cmath.exp(1j * delta)
    return [[turn if mode == "reference" else 1, 0], [0, turn]]


def state(ar=1.0, ai=0.0, br=0.0, bi=0.0) -> Column:
    return F.struct(*[num(v).alias(n) for v, n in zip((ar, ai, br, bi), ("ar", "ai", "br", "bi"), strict=True)])


def apply(gate: Gate, q: Column) -> Column:
    rows = []
    for u, v in gate:
        u, v = complex(u), complex(v)
        rows.append(u.real * q["ar"] - u.imag * q["ai"] + v.real * q["br"] - v.imag * q["bi"])
        rows.append(u.real * q["ai"] + u.imag * q["ar"] + v.real * q["bi"] + v.imag * q["br"])
    return state(*rows)


def probability_one(q: Column) -> Column:
    """Of observing 1; also the expectation."""
    return q["br"] * q["br"] + q["bi"] * q["bi"]


def observe(q: Column, seed: int, *keys) -> Column:
    return (uniform(seed, *keys) < probability_one(q)).cast("int")
