"""Probability distributions as column expressions.

``d`` density or probability, ``p`` distribution function, ``q`` quantile, ``r``
draw.  Parameters are numbers or columns; invalid ones, and probabilities
outside [0, 1], give null.  Draws take a seed and the columns that name the row,
so they do not depend on partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import bound, erf, log_gamma, normal, num, uniform

Num = Column | float


def _prob(p: Column, value: Column) -> Column:
    return F.when((p >= 0) & (p <= 1), value)


def _whole(x: Column) -> Column:
    return x == F.floor(x)


def _log_choose(n: Column, k: Column) -> Column:
    return log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1)


def _sum_to(x: Column, term, first: Column | int = 0) -> Column:
    """Sum of ``term`` from ``first`` to ``x`` in whole steps."""
    first = F.lit(first).cast("long") if isinstance(first, int) else first.cast("long")
    last = F.floor(x).cast("long")
    each = F.aggregate(F.sequence(first, F.greatest(last, first)), F.lit(0.0), lambda s, k: s + term(k.cast("double")))
    return F.when(last >= first, F.least(F.lit(1.0), each)).otherwise(F.lit(0.0))


def _scan(p: Column, term, last: Column | float) -> Column:
    """Smallest whole number whose distribution function reaches ``p``."""

    def of(p: Column) -> Column:
        def step(a: Column, k: Column) -> Column:
            x = k.cast("double")
            added = bound(a["s"] + term(x), lambda s: F.struct(s.alias("s"), F.when(s >= p - 1e-12, x).otherwise(F.lit(-1.0)).alias("q")))
            return F.when(a["q"] >= 0, a).otherwise(added)

        start = F.struct(F.lit(0.0).alias("s"), F.lit(-1.0).alias("q"))
        return F.aggregate(F.sequence(F.lit(0).cast("long"), num(last).cast("long")), start, step, lambda a: a["q"])

    def found(p: Column) -> Column:
        state = bound(of(p), lambda q: F.when(q < 0, num(last)).otherwise(q))
        return _prob(p, state)

    return bound(p, found)


def _draw_from(u: Column, probabilities: list[float]) -> Column:
    """The first whole number whose distribution function reaches ``u``: how many of its
    steps, which are listed once for all rows, lie below ``u``."""
    steps, below = [], 0.0
    for p in probabilities[:-1]:
        below += p
        steps.append(below + 1e-12)

    def among(v: Column, low: int, high: int) -> Column:
        if low == high:
            return F.lit(float(low))
        mid = (low + high) // 2
        return F.when(v > steps[mid], among(v, mid + 1, high)).otherwise(among(v, low, mid))

    return bound(u, lambda v: among(v, 0, len(steps)))


def _numbers(*parameters: Num) -> bool:
    return all(isinstance(p, (int, float)) for p in parameters)


#: Whole numbers whose probabilities are listed.
MOST_LISTED = 1000

# Bernoulli


def dbern(x: Num, prob: Num) -> Column:
    x, q = num(x), num(prob)
    return F.when((q >= 0) & (q <= 1), F.when(x == 1, q).when(x == 0, 1 - q).otherwise(F.lit(0.0)))


def pbern(x: Num, prob: Num) -> Column:
    x, q = num(x), num(prob)
    return F.when((q >= 0) & (q <= 1), F.when(x < 0, 0.0).when(x < 1, 1 - q).otherwise(F.lit(1.0)))


def qbern(p: Num, prob: Num, mode: str = "standard") -> Column:
    """1 above ``1 - prob``; the reference compares with ``prob`` instead."""
    p, q = num(p), num(prob)
    return _prob(p, (p <= q if mode == "reference" else p > 1 - q).cast("double"))


def rbern(prob: Num, seed: int, *keys) -> Column:
    return (uniform(seed, *keys) < num(prob)).cast("int")


# Binomial


def dbinom(x: Num, n: Num, prob: Num) -> Column:
    x, n, q = num(x), num(n), num(prob)
    inside = (x >= 0) & (x <= n) & _whole(x)
    log = _log_choose(n, x) + x * F.log(q) + (n - x) * F.log(1 - q)
    edge = F.when(q == 0, (x == 0).cast("double")).when(q == 1, (x == n).cast("double"))
    return F.when((q >= 0) & (q <= 1), F.when(inside, F.coalesce(edge, F.exp(log))).otherwise(F.lit(0.0)))


def pbinom(x: Num, n: Num, prob: Num) -> Column:
    x, n = num(x), num(n)
    return F.when(x >= n, F.lit(1.0)).otherwise(_sum_to(x, lambda k: dbinom(k, n, prob)))


def qbinom(p: Num, n: Num, prob: Num) -> Column:
    return _scan(num(p), lambda k: dbinom(k, n, prob), num(n))


def rbinom(n: Num, prob: Num, seed: int, *keys) -> Column:
    u = uniform(seed, *keys)
    if _numbers(n, prob) and n == int(n) and 0 <= n <= MOST_LISTED and 0 < prob < 1:
        log = lambda k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(prob) + (n - k) * math.log1p(-prob)
        return _draw_from(u, [math.exp(log(k)) for k in range(int(n) + 1)])
    return qbinom(u, n, prob)


# Geometric: failures before the first success


def dgeom(x: Num, prob: Num) -> Column:
    x, q = num(x), num(prob)
    return F.when((q > 0) & (q <= 1), F.when((x >= 0) & _whole(x), q * F.pow(1 - q, x)).otherwise(F.lit(0.0)))


def pgeom(x: Num, prob: Num) -> Column:
    x, q = num(x), num(prob)
    return F.when((q > 0) & (q <= 1), F.when(x >= 0, 1 - F.pow(1 - q, F.floor(x) + 1)).otherwise(F.lit(0.0)))


def qgeom(p: Num, prob: Num) -> Column:
    p, q = num(p), num(prob)
    return F.when((p >= 0) & (p < 1), F.greatest(F.lit(0.0), F.ceil(F.log1p(-p) / F.log1p(-q) - 1 - 1e-12).cast("double")))


def rgeom(prob: Num, seed: int, *keys) -> Column:
    return bound(uniform(seed, *keys), lambda p: qgeom(p, prob))


# Hypergeometric: x of k drawn are among m of m + n


def dhyper(x: Num, m: Num, n: Num, k: Num) -> Column:
    x, m, n, k = num(x), num(m), num(n), num(k)
    inside = (x >= F.greatest(F.lit(0.0), k - n)) & (x <= F.least(m, k)) & _whole(x)
    return F.when(inside, F.exp(_log_choose(m, x) + _log_choose(n, k - x) - _log_choose(m + n, k))).otherwise(F.lit(0.0))


def phyper(x: Num, m: Num, n: Num, k: Num, mode: str = "standard") -> Column:
    """The reference leaves out ``x`` itself."""
    x = num(x) - (1 if mode == "reference" else 0)
    return _sum_to(F.least(x, num(k)), lambda j: dhyper(j, m, n, k))


def qhyper(p: Num, m: Num, n: Num, k: Num) -> Column:
    return _scan(num(p), lambda j: dhyper(j, m, n, k), num(k))


def rhyper(m: Num, n: Num, k: Num, seed: int, *keys) -> Column:
    u = uniform(seed, *keys)
    if _numbers(m, n, k) and all(v == int(v) and v >= 0 for v in (m, n, k)) and k <= min(m + n, MOST_LISTED):
        m, n, k = int(m), int(n), int(k)
        return _draw_from(u, [math.comb(m, j) * math.comb(n, k - j) / math.comb(m + n, k) for j in range(k + 1)])
    return qhyper(u, m, n, k)


# Poisson


def dpois(x: Num, lam: Num) -> Column:
    x, m = num(x), num(lam)
    return F.when(m > 0, F.when((x >= 0) & _whole(x), F.exp(x * F.log(m) - m - log_gamma(x + 1))).otherwise(F.lit(0.0)))


def ppois(x: Num, lam: Num) -> Column:
    return _sum_to(num(x), lambda k: dpois(k, lam))


def qpois(p: Num, lam: Num) -> Column:
    m = num(lam)
    return _scan(num(p), lambda k: dpois(k, lam), F.ceil(m + 12 * F.sqrt(m) + 20).cast("double"))


def rpois(lam: Num, seed: int, *keys) -> Column:
    u = uniform(seed, *keys)
    last = math.ceil(lam + 12 * math.sqrt(lam) + 20) if _numbers(lam) and lam > 0 else MOST_LISTED + 1
    if last <= MOST_LISTED:
        return _draw_from(u, [math.exp(k * math.log(lam) - lam - math.lgamma(k + 1)) for k in range(last + 1)])
    return qpois(u, lam)


# Continuous


def dunif(x: Num, a: Num, b: Num) -> Column:
    x, a, b = num(x), num(a), num(b)
    return F.when(a < b, F.when((x >= a) & (x <= b), 1 / (b - a)).otherwise(F.lit(0.0)))


def punif(x: Num, a: Num, b: Num) -> Column:
    x, a, b = num(x), num(a), num(b)
    return F.when(a < b, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - a) / (b - a))))


def qunif(p: Num, a: Num, b: Num) -> Column:
    p, a, b = num(p), num(a), num(b)
    return _prob(p, a + p * (b - a))


def runif(a: Num, b: Num, seed: int, *keys) -> Column:
    return bound(uniform(seed, *keys), lambda p: qunif(p, a, b))


def dexp(x: Num, rate: Num) -> Column:
    x, r = num(x), num(rate)
    return F.when(r > 0, F.when(x >= 0, r * F.exp(-r * x)).otherwise(F.lit(0.0)))


def pexp(x: Num, rate: Num) -> Column:
    x, r = num(x), num(rate)
    return F.when(r > 0, F.when(x >= 0, 1 - F.exp(-r * x)).otherwise(F.lit(0.0)))


def qexp(p: Num, rate: Num) -> Column:
    p, r = num(p), num(rate)
    return F.when((p >= 0) & (p < 1), -F.log1p(-p) / r)


def rexp(rate: Num, seed: int, *keys) -> Column:
    return bound(uniform(seed, *keys), lambda p: qexp(p, rate))


def dlaplace(x: Num, m: Num, s: Num) -> Column:
    """Density ``exp(-2 |x - m| / s) / s``: the scale is twice the usual one."""
    x, m, s = num(x), num(m), num(s)
    return F.when(s > 0, F.exp(-2 * F.abs(x - m) / s) / s)


def plaplace(x: Num, m: Num, s: Num, mode: str = "standard") -> Column:
    """The reference has ``1 - e`` in place of ``1 - e / 2`` above the middle."""
    x, m, s = num(x), num(m), num(s)
    e = F.exp(-2 * F.abs(x - m) / s)
    return F.when(s > 0, F.when(x < m, 0.5 * e).otherwise(1 - (e if mode == "reference" else 0.5 * e)))


def qlaplace(p: Num, m: Num, s: Num) -> Column:
    p, m, s = num(p), num(m), num(s)
    return F.when((p > 0) & (p < 1), m - 0.5 * s * F.signum(p - 0.5) * F.log(1 - 2 * F.abs(p - 0.5)))


def rlaplace(m: Num, s: Num, seed: int, *keys) -> Column:
    return bound(uniform(seed, *keys), lambda p: qlaplace(p, m, s))


def dlogis(x: Num, m: Num, s: Num) -> Column:
    x, m, s = num(x), num(m), num(s)
    e = F.exp(-F.abs(x - m) / s)
    return F.when(s > 0, e / (s * (1 + e) * (1 + e)))


def plogis(x: Num, m: Num, s: Num) -> Column:
    x, m, s = num(x), num(m), num(s)
    return F.when(s > 0, 1 / (1 + F.exp(-(x - m) / s)))


def qlogis(p: Num, m: Num, s: Num) -> Column:
    p, m, s = num(p), num(m), num(s)
    return F.when((p > 0) & (p < 1), m + s * F.log(p / (1 - p)))


def rlogis(m: Num, s: Num, seed: int, *keys) -> Column:
    return bound(uniform(seed, *keys), lambda p: qlogis(p, m, s))


def dcauchy(x: Num, m: Num, s: Num) -> Column:
    x, m, s = num(x), num(m), num(s)
    z = (x - m) / s
    return F.when(s > 0, 1 / (math.pi * s * (1 + z * z)))


def pcauchy(x: Num, m: Num, s: Num) -> Column:
    x, m, s = num(x), num(m), num(s)
    return F.when(s > 0, 0.5 + F.atan((x - m) / s) / math.pi)


def qcauchy(p: Num, m: Num, s: Num) -> Column:
    p, m, s = num(p), num(m), num(s)
    return F.when((p > 0) & (p < 1), m + s * F.tan(math.pi * (p - 0.5)))


def rcauchy(m: Num, s: Num, seed: int, *keys) -> Column:
    return bound(uniform(seed, *keys), lambda p: qcauchy(p, m, s))


def dcos(x: Num, m: Num, s: Num) -> Column:
    """Raised cosine on ``m`` plus and minus ``pi s``."""
    x, m, s = num(x), num(m), num(s)
    z = (x - m) / s
    return F.when(s > 0, F.when(F.abs(z) <= math.pi, (1 + F.cos(z)) / (2 * math.pi * s)).otherwise(F.lit(0.0)))


def pcos(x: Num, m: Num, s: Num) -> Column:
    x, m, s = num(x), num(m), num(s)
    z = (x - m) / s
    inside = (math.pi + z + F.sin(z)) / (2 * math.pi)
    return F.when(s > 0, F.when(z < -math.pi, 0.0).when(z > math.pi, 1.0).otherwise(inside))


def qcos(p: Num, m: Num, s: Num, steps: int = 60) -> Column:
    """By halving the interval."""
    m, s = num(m), num(s)

    def halved(p: Column) -> Column:
        # the middle of the interval goes up or down by half of what is left
        half = F.aggregate(
            F.array(*[F.lit(math.pi / 2 ** (i + 1)) for i in range(steps)]),
            F.lit(0.0),
            lambda z, w: z + F.when(math.pi + z + F.sin(z) < 2 * math.pi * p, w).otherwise(-w),
        )
        return _prob(p, m + s * half)

    return bound(num(p), halved)


def rcos(m: Num, s: Num, seed: int, *keys) -> Column:
    return qcos(uniform(seed, *keys), m, s)


def dtriang(x: Num, m: Num, s: Num) -> Column:
    """Symmetric triangle on ``m`` plus and minus ``s``."""
    x, m, s = num(x), num(m), num(s)
    return F.when(s > 0, F.greatest(F.lit(0.0), (1 - F.abs(x - m) / s) / s))


def ptriang(x: Num, m: Num, s: Num) -> Column:
    x, m, s = num(x), num(m), num(s)
    z = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (x - m) / s))
    return F.when(s > 0, F.when(z < 0, (1 + z) * (1 + z) / 2).otherwise(1 - (1 - z) * (1 - z) / 2))


def qtriang(p: Num, m: Num, s: Num) -> Column:
    p, m, s = num(p), num(m), num(s)
    return _prob(p, m + s * F.when(p < 0.5, F.sqrt(2 * p) - 1).otherwise(1 - F.sqrt(2 * (1 - p))))


def rtriang(m: Num, s: Num, seed: int, *keys) -> Column:
    return bound(uniform(seed, *keys), lambda p: qtriang(p, m, s))


# Normal and log-normal


def dnorm(x: Num, m: Num = 0.0, s: Num = 1.0) -> Column:
    x, m, s = num(x), num(m), num(s)
    z = (x - m) / s
    return F.when(s > 0, F.exp(-0.5 * z * z) / (s * math.sqrt(2 * math.pi)))


def pnorm(x: Num, m: Num = 0.0, s: Num = 1.0) -> Column:
    x, m, s = num(x), num(m), num(s)
    return F.when(s > 0, 0.5 * (1 + erf((x - m) / (s * math.sqrt(2)))))


def _horner(coefficients: list[float], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


# Published coefficients of rational approximations to the normal
# quantile, highest power first.
_ACKLAM_A = [-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239]
_ACKLAM_B = [-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0]
_ACKLAM_C = [-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783]
_ACKLAM_D = [0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0]
_WICHURA_A = [2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608]
_WICHURA_B = [5226.495278852545925, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867, 5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0]
_WICHURA_C = [7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734]
_WICHURA_D = [1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0]
_WICHURA_E = [2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772]
_WICHURA_F = [2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0]


def qnorm_acklam(p: Num, m: Num = 0.0, s: Num = 1.0) -> Column:
    p, m, s = num(p), num(m), num(s)
    q = p - 0.5
    mid = _horner(_ACKLAM_A, q * q) * q / _horner(_ACKLAM_B, q * q)
    t = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    tail = _horner(_ACKLAM_C, t) / _horner(_ACKLAM_D, t)
    z = F.when(p < 0.02425, tail).when(p > 1 - 0.02425, -tail).otherwise(mid)
    return F.when((p > 0) & (p < 1), m + s * z)


def qnorm_wichura(p: Num, m: Num = 0.0, s: Num = 1.0) -> Column:
    """To about 16 digits."""
    p, m, s = num(p), num(m), num(s)
    q = p - 0.5
    r = 0.180625 - q * q
    mid = q * _horner(_WICHURA_A, r) / _horner(_WICHURA_B, r)
    t = F.sqrt(-F.log(F.least(p, 1 - p)))
    near = _horner(_WICHURA_C, t - 1.6) / _horner(_WICHURA_D, t - 1.6)
    far = _horner(_WICHURA_E, t - 5) / _horner(_WICHURA_F, t - 5)
    tail = F.signum(q) * F.when(t <= 5, near).otherwise(far)
    return F.when((p > 0) & (p < 1), m + s * F.when(F.abs(q) <= 0.425, mid).otherwise(tail))


def qnorm(p: Num, m: Num = 0.0, s: Num = 1.0) -> Column:
    return qnorm_wichura(p, m, s)


def _by_tail(p: Num, m: Num, s: Num, size, mode: str) -> Column:
    """Approximations of low accuracy give the size of the quantile from the
    smaller tail.  The reference returns the upper-tail quantile's sign."""
    p, m, s = num(p), num(m), num(s)
    sign = F.when(p <= 0.5, F.lit(1.0 if mode == "reference" else -1.0)).otherwise(F.lit(-1.0 if mode == "reference" else 1.0))
    return F.when((p > 0) & (p < 1), m + s * F.when(p == 0.5, F.lit(0.0)).otherwise(sign * size(F.least(p, 1 - p))))


def qnorm_odeh_evans(p: Num, m: Num = 0.0, s: Num = 1.0, mode: str = "standard") -> Column:
    top = [-0.0000453642210148, -0.0204231210245, -0.342242088547, -1.0, -0.322232431088]
    bottom = [0.0038560700634, 0.10353775285, 0.531103462366, 0.588581570495, 0.099348462606]

    def size(q: Column) -> Column:
        t = F.sqrt(-2 * F.log(q))
        return t + _horner(top, t) / _horner(bottom, t)

    return _by_tail(p, m, s, size, mode)


def qnorm_hastings_67(p: Num, m: Num = 0.0, s: Num = 1.0, mode: str = "standard") -> Column:
    def size(q: Column) -> Column:
        t = F.sqrt(-2 * F.log(q))
        return t - (2.30753 + 0.27061 * t) / (1 + 0.99229 * t + 0.04481 * t * t)

    return _by_tail(p, m, s, size, mode)


def qnorm_hastings_68(p: Num, m: Num = 0.0, s: Num = 1.0, mode: str = "standard") -> Column:
    def size(q: Column) -> Column:
        t = F.sqrt(-2 * F.log(q))
        return t - _horner([0.010328, 0.802853, 2.515517], t) / _horner([0.001308, 0.189269, 1.432788, 1.0], t)

    return _by_tail(p, m, s, size, mode)


def qnorm_beasley_springer(p: Num, m: Num = 0.0, s: Num = 1.0) -> Column:
    """Central and tail approximations together."""
    p, m, s = num(p), num(m), num(s)
    q = p - 0.5
    r = q * q
    mid = q * _horner([-25.44106049637, 41.39119773534, -18.61500062529, 2.50662823884], r)
    mid = mid / _horner([3.13082909833, -21.06224101826, 23.08336743743, -8.47351093090, 1.0], r)
    tail = F.signum(q) * _beasley_tail(F.least(p, 1 - p))
    return F.when((p > 0) & (p < 1), m + s * F.when(F.abs(q) <= 0.42, mid).otherwise(tail))


def _beasley_tail(q: Column) -> Column:
    t = F.sqrt(-F.log(q))
    return _horner([2.32121276858, 4.85014127135, -2.29796479134, -2.78718931138], t) / _horner([1.63706781897, 3.54388924762, 1.0], t)


def qnorm_beasley_springer_tail(p: Num, m: Num = 0.0, s: Num = 1.0, mode: str = "standard") -> Column:
    return _by_tail(p, m, s, _beasley_tail, mode)


def qnorm_hill_davis(p: Num, m: Num = 0.0, s: Num = 1.0, mode: str = "standard") -> Column:
    def size(q: Column) -> Column:
        t = F.sqrt(-2 * F.log(q))
        return t - _horner([7.45551, 450.636, 1271.059], t) / _horner([1.0, 110.4212, 750.365, 500.756], t)

    return _by_tail(p, m, s, size, mode)


def _bailey(q: Column) -> Column:
    y = -math.pi / 2 * F.log(4 * q * (1 - q))
    return F.sqrt(y) * _horner([4.3728e-6, -2.881e-4, 0.0078365, 1.0], y)


def qnorm_bailey_central(p: Num, m: Num = 0.0, s: Num = 1.0, mode: str = "standard") -> Column:
    return _by_tail(p, m, s, _bailey, mode)


def qnorm_bailey(p: Num, m: Num = 0.0, s: Num = 1.0, mode: str = "standard") -> Column:
    """The central form, and another one far out in the tails."""

    def size(q: Column) -> Column:
        u = -2 * F.log(q)
        y = F.sqrt(u - F.log(2 * math.pi * u))
        return F.when(q < 2.2e-6, y + (0.5962 + 0.1633 * y) / (y * y * y)).otherwise(_bailey(q))

    return _by_tail(p, m, s, size, mode)


def qnorm_koehler(p: Num, m: Num = 0.0, s: Num = 1.0, mode: str = "standard") -> Column:
    def size(q: Column) -> Column:
        y = F.sqrt(-F.log(4 * q * (1 - q)))
        return y / (0.81 - 0.0193 * y)

    return _by_tail(p, m, s, size, mode)


def rnorm(m: Num, s: Num, seed: int, *keys) -> Column:
    return num(m) + num(s) * normal(seed, *keys)


def dlnorm(x: Num, m: Num = 0.0, s: Num = 1.0) -> Column:
    x = num(x)
    return F.when(x > 0, dnorm(F.log(x), m, s) / x).otherwise(F.lit(0.0))


def plnorm(x: Num, m: Num = 0.0, s: Num = 1.0) -> Column:
    x = num(x)
    return F.when(x > 0, pnorm(F.log(x), m, s)).otherwise(F.lit(0.0))


def qlnorm(p: Num, m: Num = 0.0, s: Num = 1.0) -> Column:
    return F.exp(qnorm(p, m, s))


def rlnorm(m: Num, s: Num, seed: int, *keys) -> Column:
    return F.exp(rnorm(m, s, seed, *keys))


# Gamma, beta, Dirichlet


def dgamma(x: Num, alpha: Num, beta: Num) -> Column:
    """Shape ``alpha``, scale ``beta``."""
    x, a, b = num(x), num(alpha), num(beta)
    log = (a - 1) * F.log(x) - x / b - a * F.log(b) - log_gamma(a)
    return F.when((a > 0) & (b > 0), F.when(x > 0, F.exp(log)).otherwise(F.lit(0.0)))


def rgamma(alpha: Num, beta: Num, seed: int, *keys, tries: int = 16) -> Column:
    """Marsaglia and Tsang's method: the first of ``tries`` candidates that is
    taken (each is with a probability above 0.95)."""
    a = num(alpha)
    d = F.when(a < 1, a + 1).otherwise(a) - 1 / 3
    c = 1 / F.sqrt(9 * d)

    def candidate(i: Column) -> Column:
        u = F.log(F.greatest(uniform(seed * 103 + 1 + 7 * i, *keys), F.lit(1e-300)))

        def taken(z: Column) -> Column:
            v = F.pow(1 + c * z, F.lit(3.0))
            return F.when((v > 0) & (u < 0.5 * z * z + d - d * v + d * F.log(F.when(v > 0, v).otherwise(F.lit(1.0)))), d * v)

        # the normal number is bound to a variable, else it is drawn at each place
        return F.get(F.transform(F.array(normal(seed * 101 + i, *keys)), taken), 0)

    out = F.aggregate(F.sequence(F.lit(0), F.lit(tries - 1)), F.lit(None).cast("double"), lambda got, i: F.coalesce(got, candidate(i)))
    boost = F.when(a < 1, F.pow(F.greatest(uniform(seed * 107 + 3, *keys), F.lit(1e-300)), 1 / a)).otherwise(F.lit(1.0))
    return num(beta) * boost * F.coalesce(out, d)


def dbeta(x: Num, alpha: Num, beta: Num) -> Column:
    x, a, b = num(x), num(alpha), num(beta)
    log = (a - 1) * F.log(x) + (b - 1) * F.log1p(-x) + log_gamma(a + b) - log_gamma(a) - log_gamma(b)
    return F.when((a > 0) & (b > 0), F.when((x > 0) & (x < 1), F.exp(log)).otherwise(F.lit(0.0)))


def rbeta(alpha: Num, beta: Num, seed: int, *keys) -> Column:
    parts = [rgamma(alpha, 1.0, 2 * seed, *keys), rgamma(beta, 1.0, 2 * seed + 1, *keys)]
    return bound(F.array(*parts), lambda xs: F.get(xs, 0) / (F.get(xs, 0) + F.get(xs, 1)))


def ddirichlet(xs: Column, alphas: list[float]) -> Column:
    """Of an array that sums to one; null for others."""
    log = F.lit(math.lgamma(sum(alphas)) - sum(map(math.lgamma, alphas)))
    total = F.lit(0.0)
    for i, a in enumerate(alphas):
        log = log + (a - 1) * F.log(F.get(xs, i))
        total = total + F.get(xs, i)
    return F.when((F.abs(total - 1) < 1e-10) & (F.array_min(xs) > 0), F.exp(log))


def _shares(parts: list[Column]) -> Column:
    # bound: a part is drawn once, not again for each share
    return bound(F.array(*parts), lambda xs: F.transform(xs, lambda v: v / sum((F.get(xs, i) for i in range(1, len(parts))), F.get(xs, 0))))


def rdirichlet(alphas: list[float], seed: int, *keys) -> Column:
    parts = [rgamma(a, 1.0, seed * 31 + i, *keys) for i, a in enumerate(alphas)]
    return _shares(parts)


def dunifsimplex(xs: Column, p: int) -> Column:
    inside = (F.abs(F.aggregate(xs, F.lit(0.0), lambda s, v: s + v) - 1) < 1e-10) & (F.array_min(xs) >= 0)
    return F.when(inside, F.lit(float(math.gamma(p)))).otherwise(F.lit(0.0))


def runifsimplex(p: int, seed: int, *keys) -> Column:
    parts = [rexp(1.0, seed * 31 + i, *keys) for i in range(p)]
    return _shares(parts)
