"""Closed-form pricing functions.

All are total: a NULL, non-numeric or degenerate argument and a non-finite result
give NULL.  Everything is an expression of Spark's functions; the error function, which
Spark lacks, is approximated by rational functions in three ranges to double precision."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .builtins import Typed, leaf_number, to_bool
from .registry import Registry, Scalar

MAX_PERIODS = 12_000
MAX_SWAP_PERIODS = 200

# W. J. Cody's rational Chebyshev approximations of the error function (1969), highest power first.
SMALL = ((1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3),
         (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3))
MIDDLE = ((2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2,
           8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3),
          (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3,
           3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3))
LARGE = ((1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4),
         (1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3))


def _ratio(coefficients, x: Column) -> Column:
    over, under = (reduce(lambda sum_, c: sum_ * x + F.lit(c), p[1:], F.lit(p[0])) for p in coefficients)
    return over / under


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _cdf(x: Column, y: Column) -> Column:
    """``y``: |x| / sqrt(2)."""
    small = 0.5 + 0.5 * F.signum(x) * y * _ratio(SMALL, y * y)
    tail = lambda i: F.exp(-y * y) / y * (1 / math.sqrt(math.pi) - i * _ratio(LARGE, i))
    beyond = 0.5 * F.when(y <= 4.0, F.exp(-y * y) * _ratio(MIDDLE, y)).otherwise(let(1 / (y * y), tail))
    return F.when(y <= 0.46875, small).otherwise(let(beyond, lambda p: F.when(x < 0, p).otherwise(1 - p)))


def cdf(value: Column) -> Column:
    """The normal distribution."""
    return let(value, lambda x: let(F.abs(x) / math.sqrt(2.0), lambda y: _cdf(x, y)))


def pdf(x: Column) -> Column:
    return F.exp(-0.5 * x * x) / math.sqrt(2.0 * math.pi)


def black_scholes(what: str, s: Column, k: Column, t: Column, r: Column, q: Column, v: Column, call: Column) -> Column:
    """Price or sensitivity with continuous rates; vega per unit of volatility, theta per year."""
    sign = F.when(call, 1.0).otherwise(-1.0)
    root = F.sqrt(t)
    eq, er = F.exp(-q * t), F.exp(-r * t)

    def out(d1: Column) -> Column:
        d2 = d1 - v * root
        if what == "price":
            return sign * (s * eq * cdf(sign * d1) - k * er * cdf(sign * d2))
        if what == "delta":
            return sign * eq * cdf(sign * d1)
        if what == "gamma":
            return eq * pdf(d1) / (s * v * root)
        if what == "vega":
            return s * eq * pdf(d1) * root
        return -s * eq * pdf(d1) * v / (2 * root) - sign * r * k * er * cdf(sign * d2) + sign * q * s * eq * cdf(sign * d1)

    d1 = (F.log(s / k) + (r - q + 0.5 * v * v) * t) / (v * root)
    return finite(F.when((s > 0) & (k > 0) & (t > 0) & (v > 0) & call.isNotNull(), let(d1, out)))


def finite(value: Column) -> Column:
    return let(value, lambda x: F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x))


def number(x: Typed) -> Column:
    x = leaf_number(x)
    return x.col.cast("double") if x.kind in ("long", "double") else F.lit(None).cast("double")


def bond(what: str, face: Column, coupon: Column, years: Column, yld: Column, freq: Column) -> Column:
    """Level-coupon bond by geometric sums: price, modified duration, value of a basis point."""
    f = F.rint(freq)
    n = F.rint(years * freq)
    y = yld / f
    c = face * coupon / f
    v = 1 / (1 + y)
    vn = F.pow(v, n)
    near = F.abs(y) < 1e-12
    annuity = F.when(near, n).otherwise((1 - vn) / y)
    # The sum of k v^k for k = 1..n.
    weighted = F.when(near, n * (n + 1) / 2).otherwise(((1 + y) * annuity - n * vn) / y)
    price = c * annuity + face * vn
    modified = (c * weighted + n * face * vn) / f / price / (1 + y)
    out = {"price": price, "duration": modified, "dv01": modified * price * 1e-4}[what]
    good = (f >= 1) & (n >= 1) & (n <= MAX_PERIODS) & (1 + y > 0)
    return finite(F.when(good, out))


def swap_npv(notional: Column, fixed: Column, years: Column, flat: Column, pay_fixed: Column) -> Column:
    """Annual payments, flat annually compounded curve."""
    n = F.rint(years)
    v = 1 / (1 + flat)
    df = F.pow(v, n)
    annuity = F.when(F.abs(flat) < 1e-12, n).otherwise((1 - df) / flat)
    value = notional * (1 - df) - notional * fixed * annuity
    good = (n >= 1) & (n <= MAX_SWAP_PERIODS) & (1 + flat > 0)
    return finite(F.when(good, F.when(pay_fixed, value).otherwise(F.when(~pay_fixed, -value))))


def install(registry: Registry) -> Registry:
    double = lambda kinds: "double"
    for what in ("price", "delta", "gamma", "vega", "theta"):
        build = lambda a, what=what: black_scholes(what, *[number(x) for x in a[:6]], to_bool(a[6]).col)
        registry.register(Scalar(f"BS_{what.upper()}", (7,), double, build))
    for what in ("price", "dv01", "duration"):
        registry.register(Scalar(f"BOND_{what.upper()}", (5,), double, lambda a, what=what: bond(what, *map(number, a))))
    npv = lambda a: swap_npv(*map(number, a[:4]), to_bool(a[4]).col)

    def dv01(a):
        up = swap_npv(number(a[0]), number(a[1]), number(a[2]), number(a[3]) + 1e-4, to_bool(a[4]).col)
        return F.abs(up - npv(a))

    registry.register(Scalar("IRS_NPV", (5,), double, npv))
    registry.register(Scalar("IRS_DV01", (5,), double, dv01))
    registry.register(Scalar("FX_FWD", (4,), double, lambda a: finite(number(a[0]) * F.exp((number(a[1]) - number(a[2])) * number(a[3])))))
    return registry
